"""M7 + L4: records -> features -> 2-D points -> clusters -> score -> cards.

One configuration object replaces the reference's sidebar/tab controls (Q2).
The fitted models (vocabulary, projection, k-means) label rows one by one, so the
texts are tokenised once for the vocabulary and once for the vectors, kept with
them, and reach the cards without a join.  Points, labels and cards feed several
consumers and are checkpointed to the session's shared folder, whatever the
input's size: a generator runs once for each prompt, and a lost executor re-reads them.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoal.functions import text as TX
from shoal.operators import cluster as C
from shoal.operators import evaluate as E
from shoal.operators import features as FT
from shoal.operators import labels as L
from shoal.operators import reduce as RD
from shoal.operators.filters import require_min_rows
from shoal.session import ensure_checkpoint_dir


@dataclass
class PipelineConfig:
    use_density: bool = False           # the tab's first choice is k-means
    k: int = 8
    restarts: int = 10
    seed: int = 42
    min_cluster_size: int = 5
    min_samples: int = 3
    layout: str = "pca"                 # or "neighbours": the neighbour-graph layout
    neighbours: int = 15
    min_dist: float = 0.1
    silhouette: str = "squared_euclidean"   # O(n*k); "euclidean" is the all-pairs score, "euclidean_tree" the same within a bound
    num_partitions: int | None = None   # deal the records anew where the scan has too few splits
    tfidf: FT.TfidfParams = field(default_factory=FT.TfidfParams)
    word_pattern: str = TX.CJK_RUN      # label words; T10 default
    make_tokenizer: Callable | None = None  # T11: label words from an analyser instead
    use_external: bool = False
    make_embedder: Callable | None = None
    make_generator: Callable[[], Callable[[str, int], str]] | None = None


@dataclass
class FitResult:
    points: DataFrame        # (record_id, x, y)
    assignments: DataFrame   # (record_id, cluster)
    run_stats: DataFrame     # one row (M8)
    cards: DataFrame         # one row per cluster (L4)
    features_kind: str
    layout: str              # the layout used: "pca" or "neighbours"


def fit(records: DataFrame, config: PipelineConfig = PipelineConfig()) -> FitResult:
    spark = records.sparkSession
    ensure_checkpoint_dir(spark)
    require_min_rows(records, 3)
    if config.num_partitions:
        records = records.repartition(config.num_partitions)
    n = records.count()
    text = ("document_text",)
    feats, kind = FT.choose_features(records, config.use_external, config.make_embedder,
                                     text_col="document_text", params=config.tfidf, keep=text)
    # read by the projection's three passes and by the cards
    feats = feats.persist(StorageLevel.MEMORY_AND_DISK)
    placed, layout = RD.layout2(feats, n_rows=n, keep=text, method=config.layout, neighbours=config.neighbours,
                                min_dist=config.min_dist, seed=config.seed)
    points = placed.select("record_id", "x", "y").checkpoint()
    run = C.cluster_points(points, config.use_density, config.k, config.restarts, config.seed,
                           config.min_cluster_size, config.min_samples, n)
    labelled = run.label(points).checkpoint()
    assignments = labelled.select("record_id", "cluster")
    sil = None
    if run.n_clusters > 1:
        sil = E.silhouette(labelled, config.silhouette, n_clusters=run.n_clusters)
    stats = run.run_stats(spark, sil)
    texts = run.label(placed).select("record_id", "document_text", "cluster")
    words_col = None
    if config.make_tokenizer is not None:
        texts, words_col = FT.analyser_words(texts, config.make_tokenizer), "words"
    cards = L.cluster_cards(texts, pattern=config.word_pattern, words_col=words_col,
                            with_samples=config.make_generator is not None)
    cards = L.generated_cards(cards, config.make_generator).checkpoint()
    feats.unpersist()
    return FitResult(points, assignments, stats, cards, kind, layout)


def assignments_with_points(res: FitResult) -> DataFrame:
    return res.points.join(res.assignments, "record_id").select("record_id", "x", "y", F.col("cluster"))
