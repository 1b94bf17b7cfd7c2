"""Text features: tokens, n-grams, vocabulary, smoothed TF-IDF (T1-T7) and
external embeddings (T8, T9, T11).

Plan shape, whatever the corpus size:

* tokens, n-grams and a document's different terms are computed inside each row
  -- no shuffle; tokens that are read several times are a written table, not a cache;
* document frequency and corpus frequency per term: one shuffle on ``term``
  with a map-side partial aggregate (hot terms combine before the shuffle);
* the vocabulary is the top ``max_features`` terms (a TakeOrdered, at most
  1000 rows): the only thing gathered on the driver, and its size is the cap;
* weights are applied per row again: JVM-side ``CountVectorizerModel`` ->
  ``ElementwiseProduct`` (idf) -> ``Normalizer`` for the vector path, or array
  functions over a one-row broadcast map for the long-table path.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shoal.functions import text as TX
from shoal.session import ensure_checkpoint_dir, written


@dataclass(frozen=True)
class TfidfParams:
    max_features: int = 1000
    ngram_max: int = 2
    min_df: int = 2
    max_df: float = 0.95
    fallback_max_features: int = 500


class EmptyVocabulary(ValueError):
    pass


# -- T1 / T2 ------------------------------------------------------------------

def ngrams(tokens: Column, n_max: int = 2) -> Column:
    """Unigrams then bigrams (``"a b"``) ... up to ``n_max`` over the token array.

    Pass a column reference (not an expression): the tokens are read several times.
    """
    out = [tokens]
    size = F.size(tokens)
    for n in range(2, n_max + 1):
        m = F.greatest(size - (n - 1), F.lit(0))
        if n == 2:
            out.append(F.zip_with(F.slice(tokens, 1, m), F.slice(tokens, 2, m),
                                  lambda a, b: F.concat(a, F.lit(" "), b)))
            continue
        joined = F.arrays_zip(*[F.slice(tokens, i + 1, m) for i in range(n)])

        def gram(s, n=n):
            return F.concat_ws(" ", *[s[str(i)] for i in range(n)])
        out.append(F.transform(joined, lambda s: gram(s)))
    return F.concat(*out) if len(out) > 1 else tokens


def tokens(df: DataFrame, text_col: str = "document_text", id_col: str = "record_id",
           keep: tuple[str, ...] = ()) -> DataFrame:
    """T1 + P6: ``(record_id, _tok ARRAY<STRING>)`` per document, and the columns in ``keep``."""
    src = df.select(F.col(id_col).alias("record_id"), F.col(text_col).alias("_text"), *keep)
    return src.select("record_id", *keep, TX.word_tokens(TX.blank_to_space(F.col("_text"))).alias("_tok"))


def terms(df: DataFrame, text_col: str = "document_text", id_col: str = "record_id",
          ngram_max: int = 2, keep: tuple[str, ...] = ()) -> DataFrame:
    """T1 + T2 + P6: ``(record_id, terms ARRAY<STRING>)`` per document, and the columns in ``keep``.

    The token array is projected once, then the n-grams read that column.
    """
    toks = tokens(df, text_col, id_col, keep)
    return toks.select("record_id", *keep, ngrams(F.col("_tok"), ngram_max).alias("terms"))


def _only(toks: DataFrame, words: list[str]) -> DataFrame:
    """Tokens outside ``words`` become null in their place (a hash set in the row, no join)."""
    return toks.withColumn("_tok", F.transform("_tok", lambda t: F.when(t.isin(words), t)))


def _whole(a: Column) -> Column:
    return F.filter(a, lambda t: t.isNotNull())


def _bigrams(tok: Column) -> Column:
    """The bigrams of neighbouring tokens that are both there (null marks a token left out)."""
    m = F.greatest(F.size(tok) - 1, F.lit(0))
    return F.zip_with(F.slice(tok, 1, m), F.slice(tok, 2, m), lambda a, b: F.concat(a, F.lit(" "), b))


def with_term_counts(term_df: DataFrame, terms_col: str = "terms", out_col: str = "tc") -> DataFrame:
    """Add per-document ``ARRAY<STRUCT<term, tf>>`` counted inside the row (no shuffle).

    The sorted term array is projected once as its own column; run starts are
    found with one sequential ``zip_with`` and the run lengths are the counts:
    O(n log n) per document.
    """
    keep = [c for c in term_df.columns if c != terms_col]
    s = term_df.select(*keep, F.sort_array(F.col(terms_col)).alias("_s"))
    prev = F.slice(F.concat(F.array(F.lit(None).cast("string")), F.col("_s")), 1, F.size("_s"))
    flags = F.zip_with(F.col("_s"), prev, lambda a, b: b.isNull() | (a != b))
    starts = F.filter(F.transform(flags, lambda f, i: F.when(f, i + 1)), lambda x: x.isNotNull())
    s = s.select(*keep, "_s", starts.alias("_st"))
    n = F.size("_s")
    nxt = F.slice(F.concat(F.col("_st"), F.array(n + 1)), 2, F.size("_st"))
    tc = F.zip_with(F.col("_st"), nxt, lambda a, b: F.struct(
        F.element_at(F.col("_s"), a).alias("term"), (b - a).cast("bigint").alias("tf")))
    return s.select(*keep, tc.alias(out_col))


def doc_term_freqs(term_df: DataFrame) -> DataFrame:
    """``(record_id, term, tf)`` long table (explode of :func:`with_term_counts`, no shuffle)."""
    # explode_outer + a null filter: an inner explode makes the optimizer infer
    # ``size(tc) > 0`` and push it below the projections, re-running the counting.
    return with_term_counts(term_df.select("record_id", "terms")).select(
        "record_id", F.explode_outer("tc").alias("p")).where(F.col("p").isNotNull()) \
        .select("record_id", F.col("p.term").alias("term"), F.col("p.tf").alias("tf"))


def term_stats(term_df: DataFrame) -> DataFrame:
    """``(term, df, ctf)``: documents containing the term and total occurrences.

    A row gives each of its different terms once, then all its terms: the first
    ones are counted as documents, the others as occurrences, in one hash table.
    """
    once = term_df.select("terms", F.array_distinct("terms").alias("_d"))
    # outer explode + null filter, as in doc_term_freqs
    each = once.select(F.size("_d").alias("_n"), F.posexplode_outer(F.concat("_d", "terms")).alias("_i", "term"))
    return each.where(F.col("term").isNotNull()).groupBy("term").agg(
        F.count_if(F.col("_i") < F.col("_n")).alias("df"), F.count_if(F.col("_i") >= F.col("_n")).alias("ctf"))


# -- T3 / T4 / T6 -------------------------------------------------------------

#: Up to so many frequent words serve to prune bigrams (a literal set in the plan); beyond, all bigrams are counted.
MOST_PRUNING = 20_000


def _within(params: TfidfParams, n_docs: int) -> Column:
    """The document frequencies allowed."""
    most = params.max_df * n_docs if isinstance(params.max_df, float) else params.max_df
    if most < params.min_df:
        raise EmptyVocabulary("max_df corresponds to fewer documents than min_df")
    return (F.col("df") >= params.min_df) & (F.col("df") <= F.lit(most))


def _top(stats: DataFrame, params: TfidfParams) -> DataFrame:
    return stats.orderBy(F.col("ctf").desc(), F.col("term").asc()).limit(params.max_features)


def vocabulary(term_df: DataFrame, n_docs: int, params: TfidfParams = TfidfParams()) -> DataFrame:
    """T3 + T4: terms with ``min_df <= df <= max_df * N``, top ``max_features`` by
    corpus frequency (ties by term): ``(term, df)``.  Counts every term."""
    return _top(term_stats(term_df).where(_within(params, n_docs)), params).select("term", "df")


def pruned_vocabulary(toks: DataFrame, n_docs: int, params: TfidfParams = TfidfParams()) -> DataFrame:
    """The rows of :func:`vocabulary` for words and bigrams, without counting all bigrams.

    Words are counted first.  If ``max_features`` of them are allowed, the last
    one's frequency is a bound that every term of the vocabulary reaches.  A
    bigram occurs at most as often as either of its words, so one with a word
    below the bound can't be in: only bigrams of frequent words are counted
    and shuffled, and the vocabulary is the same.
    """
    allowed = _within(params, n_docs)
    if params.ngram_max != 2:
        return vocabulary(toks.select("record_id", ngrams(F.col("_tok"), params.ngram_max).alias("terms")), n_docs, params)
    ensure_checkpoint_dir(toks.sparkSession)
    words = term_stats(toks.select("record_id", F.col("_tok").alias("terms"))).checkpoint()
    best = _top(words.where(allowed), params)
    last = best.agg(F.count(F.lit(1)).alias("n"), F.min("ctf").alias("ctf")).first()
    bound = max(params.min_df, last["ctf"] if last["n"] >= params.max_features else 0)
    often = [r["term"] for r in words.where(F.col("ctf") >= bound).select("term").limit(MOST_PRUNING + 1).collect()]
    kept = toks if len(often) > MOST_PRUNING else _only(toks, often)
    pairs = kept.select("record_id", "_tok").select("record_id", _whole(_bigrams(F.col("_tok"))).alias("terms"))
    return _top(best.unionByName(term_stats(pairs).where(allowed)), params).select("term", "df")


def stored_tokens(df: DataFrame, text_col: str = "document_text") -> DataFrame:
    """The rows of :func:`tokens`, from a written table with one string a document.

    They are read several times.  Cached as arrays they take several times the texts'
    memory, and the serializer holds up to 100 batches of them beyond what Spark counts.
    """
    joined = tokens(df, text_col).select("record_id", F.array_join("_tok", " ").alias("_t"))     # a token has no space
    each = F.when(F.col("_t") == "", F.array().cast("array<string>")).otherwise(F.split("_t", " "))
    return written(joined, "tokens").select("record_id", each.alias("_tok"))


def fit_vocabulary(df: DataFrame, text_col: str = "document_text", params: TfidfParams = TfidfParams(),
                   toks: DataFrame | None = None):
    """T3/T4 with the T6 fallback; returns ``(vocab list, df list, n_docs, used_fallback)``.

    The vocabulary (at most ``max_features`` rows) is the one driver-side
    result; it configures the JVM-side vectoriser.  ``toks`` are the frame's stored tokens, if there are any yet.
    """
    toks = stored_tokens(df, text_col) if toks is None else toks             # read by the counts of words and of bigrams
    n_docs = toks.count()
    rows = []
    try:
        rows = pruned_vocabulary(toks, n_docs, params).collect()
    except EmptyVocabulary:
        rows = []
    fallback = not rows
    if fallback:
        p2 = TfidfParams(max_features=params.fallback_max_features, ngram_max=1, min_df=1, max_df=1.0)
        rows = vocabulary(toks.select("record_id", F.col("_tok").alias("terms")), n_docs, p2).collect()
        if not rows:
            raise EmptyVocabulary("empty vocabulary: the documents contain no tokens")
    rows = sorted(rows, key=lambda r: r["term"])
    return [r["term"] for r in rows], [int(r["df"]) for r in rows], n_docs, fallback


def smooth_idf(df_count: int, n_docs: int) -> float:
    """T5 idf: ln((1 + N) / (1 + df)) + 1."""
    return math.log((1.0 + n_docs) / (1.0 + df_count)) + 1.0


# -- T5 / T7 ------------------------------------------------------------------

def tfidf_long(df: DataFrame, text_col: str = "document_text", params: TfidfParams = TfidfParams()) -> DataFrame:
    """T5 long form ``(record_id, term, weight)``, with the T6 fallback: the vectors' entries, no shuffle.

    A document's counts, weights and norm are taken in its row; the vocabulary
    (at most ``max_features`` terms) is a literal array.
    """
    from pyspark.ml.functions import vector_to_array

    model = fit_tfidf(df, text_col, params)
    entries = model.transform(df, text_col).select("record_id", vector_to_array("features").alias("_v"))
    words = F.split(F.lit("\n".join(model.vocabulary)), "\n")                # one literal once folded; a term has no line break
    pairs = F.filter(F.zip_with("_v", words, lambda w, t: F.struct(t.alias("term"), w.alias("weight"))), lambda e: e["weight"] > 0)
    # explode_outer: an inner explode would repeat the vectors for an inferred size filter
    return entries.select("record_id", pairs.alias("_p")).select("record_id", F.explode_outer("_p").alias("e")) \
        .where(F.col("e").isNotNull()).select("record_id", "e.term", "e.weight")


@dataclass
class TfidfModel:
    vocabulary: list[str]
    idf: list[float]
    n_docs: int
    used_fallback: bool
    ngram_max: int
    #: The frame and text column that the model was fitted on, with their stored tokens.
    fitted_on: tuple[DataFrame, str, DataFrame] | None = field(default=None, repr=False, compare=False)

    def transform(self, df: DataFrame, text_col: str = "document_text", id_col: str = "record_id",
                  output_col: str = "features", keep: tuple[str, ...] = ()) -> DataFrame:
        """``(record_id, features)`` sparse L2-normalised vectors, JVM-side, with the columns in ``keep``.

        A document with no vocabulary term gets the zero vector (no row is dropped).
        """
        from pyspark.ml.feature import CountVectorizerModel, ElementwiseProduct, Normalizer
        from pyspark.ml.linalg import Vectors

        toks = None
        if self.fitted_on is not None and (id_col, tuple(keep)) == ("record_id", ()):
            frame, column, stored = self.fitted_on
            toks = stored if frame is df and column == text_col else None
        tdf = self._terms(tokens(df, text_col, id_col, keep) if toks is None else toks, keep)
        cv = CountVectorizerModel.from_vocabulary(self.vocabulary, inputCol="terms", outputCol="_tf")
        ep = ElementwiseProduct(scalingVec=Vectors.dense(self.idf), inputCol="_tf", outputCol="_w")
        nz = Normalizer(p=2.0, inputCol="_w", outputCol=output_col)
        return nz.transform(ep.transform(cv.transform(tdf))).select("record_id", *keep, output_col)

    def _terms(self, toks: DataFrame, keep: tuple[str, ...]) -> DataFrame:
        """The terms that may be in the vocabulary: n-grams are only joined where all their words are in some term of it."""
        if self.ngram_max > 2:
            return toks.select("record_id", *keep, ngrams(F.col("_tok"), self.ngram_max).alias("terms"))
        tok = F.col("_tok")
        some = _only(toks, _words_of(self.vocabulary)).select("record_id", *keep, "_tok")
        every = _whole(tok) if self.ngram_max == 1 else F.concat(_whole(tok), _whole(_bigrams(tok)))
        return some.select("record_id", *keep, every.alias("terms"))


def _words_of(vocabulary: list[str]) -> list[str]:
    return sorted({w for t in vocabulary for w in t.split(" ")})


def fit_tfidf(df: DataFrame, text_col: str = "document_text", params: TfidfParams = TfidfParams()) -> TfidfModel:
    """Fit the vocabulary and idf; T7 via :meth:`TfidfModel.transform`."""
    toks = stored_tokens(df, text_col)
    vocab, dfs, n_docs, fallback = fit_vocabulary(df, text_col, params, toks)
    return TfidfModel(vocab, [smooth_idf(d, n_docs) for d in dfs], n_docs, fallback,
                      1 if fallback else params.ngram_max, (df, text_col, toks))


# -- T8 / T9 / T11: external models --------------------------------------------

def embed(df: DataFrame, make_embedder: Callable[[], Callable], text_col: str = "document_text",
          batch_size: int = 100, output_col: str = "features", keep: tuple[str, ...] = ()) -> DataFrame:
    """Vectors from a user model, in batches of ``batch_size`` texts.

    ``make_embedder()`` runs once per Python worker and returns
    ``fn(list[str]) -> list[list[float]]``; it must give one vector per text
    (checked: a mismatch fails the task rather than misaligning rows, Q14).
    """
    from pyspark.ml.functions import array_to_vector, predict_batch_udf

    def make_predict():
        fn = make_embedder()

        def predict(texts):
            import numpy as np
            items = [t if str(t).strip() else " " for t in texts]
            vecs = fn(list(items))
            if len(vecs) != len(items):
                raise ValueError(f"embedder returned {len(vecs)} vectors for {len(items)} texts")
            return np.asarray(vecs, dtype=np.float32)
        return predict

    udf = predict_batch_udf(make_predict, return_type=T.ArrayType(T.FloatType()), batch_size=batch_size)
    out = df.select("record_id", *keep, udf(F.col(text_col)).alias("_emb"))
    return out.select("record_id", *keep, array_to_vector("_emb").alias(output_col))


def choose_features(df: DataFrame, use_external: bool, make_embedder: Callable | None,
                    supports_embedding: bool = True, text_col: str = "document_text",
                    params: TfidfParams = TfidfParams(), keep: tuple[str, ...] = ()):
    """External vectors when enabled and the model embeds, else TF-IDF; ``keep`` as in T7.

    Returns ``(features DataFrame, description string)``.
    """
    if use_external and make_embedder is not None and supports_embedding:
        return embed(df, make_embedder, text_col, keep=keep), "external"
    model = fit_tfidf(df, text_col, params)
    return model.transform(df, text_col, keep=keep), "tfidf-fallback" if model.used_fallback else "tfidf"


# The parts of speech that count as words.
KEEP_POS = ("名詞", "動詞", "形容詞")


def analyser_words(df: DataFrame, make_tokenizer: Callable[[], Callable[[list[str]], list[list[tuple[str, str]]]]],
                   text_col: str = "document_text", keep_pos: tuple[str, ...] = KEEP_POS,
                   stopwords: list[str] | None = None, min_length: int = 2) -> DataFrame:
    """Words from a pluggable morphological analyser.

    ``make_tokenizer()`` runs once per task and returns
    ``fn(texts) -> [[(base_form, pos), ...], ...]``, called on Arrow batches; POS and
    word filters (F9, analyser path) are JVM-side.  Returns the input with a
    ``words ARRAY<STRING>`` column, which the card operators take as ``words_col``.
    """
    import pandas as pd

    from shoal.operators.filters import analyser_word_ok
    from shoal.operators.labels import STOPWORDS

    sw = STOPWORDS if stopwords is None else stopwords
    tok_type = T.ArrayType(T.StructType([T.StructField("word", T.StringType()), T.StructField("pos", T.StringType())]))

    def analyse_batches(batches):
        fn = make_tokenizer()
        for texts in batches:
            out = fn([t if isinstance(t, str) else "" for t in texts])
            yield pd.Series([[{"word": w, "pos": p} for w, p in toks] for toks in out])
    # real (not postponed) annotations mark this as an iterator pandas UDF
    analyse_batches.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    analyse = F.pandas_udf(analyse_batches, tok_type)

    toks = analyse(F.coalesce(F.col(text_col), F.lit("")))
    kept = F.filter(toks, lambda s: s["pos"].isin(list(keep_pos)) & analyser_word_ok(s["word"], sw, min_length))
    return df.withColumn("words", F.transform(kept, lambda s: s["word"]))
