"""Toxicity by subword-bag embeddings averaged into a linear softmax.

A text's bag holds the 3- to 6-grams of its words' bytes, word ends included; a
gram's bucket has a vector, the bag's vectors are averaged, and a linear softmax
gives the chance of label 1.  Vectors and softmax are trained jointly in numpy.
A misspelt word shares most of its grams with the word it comes from.

An average over a long text would hide a few words, so a text is read in passages
of ``PASSAGE`` bytes (about two words), each a bag of its own.  The text's odds are the mean
of its passages' odds, in training as in use: one toxic passage outweighs many
others, and every passage takes part in what is learned.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoal.llm.common import documents, first_by_hash, held_out, map_arrow, prepare, table

#: Gram sizes, buckets, vector length.
GRAMS, BUCKETS, DIM = (3, 4, 5, 6), 1 << 16, 8
#: Bytes of a passage (a text's last one may be shorter); at most 63, as a passage's grams are counted in 8 bits.
PASSAGE = 12
#: Training reads at most so many documents labelled 0 and 1.
TRAIN_ROWS = (4000, 1500)
#: And at most so many bytes of text: whole documents in the order of the hash, without those that would exceed it.
TRAIN_BYTES = 12 << 20
#: Steps of training, whatever the sample's size; documents a step; rate, falling to a tenth; decay of the vectors.
STEPS, BATCH, RATE, DECAY, SEED = 600, 64, 0.02, 0.1, 11
#: A document labelled 1 weighs as much as so many labelled 0.
TOXIC_WEIGHT = 2.0
#: Powers of the passages' odds whose mean is taken: from the first, near the geometric mean, to the second.
SHARPNESS = (0.5, 1.0)
#: Bytes hashed at once.
BYTES_AT_ONCE = 1 << 20
_FOLD = bytes(c if c > 127 or chr(c).isalnum() or chr(c) == "!" else 32 for c in bytes(range(256)).lower())
_MULT = np.uint32(0x01000193)


@dataclass
class Model:
    E: np.ndarray
    w: np.ndarray
    b: float
    fitted: bool = True

    def bucket_scores(self) -> np.ndarray:
        """What each bucket adds to the log odds, before the mean is taken."""
        return (self.E @ self.w).astype(np.float32)


def folded(text: bytes | None) -> bytes:
    """Words in lower case with one space around each; ASCII punctuation but ``!`` separates words."""
    return b" " + b" ".join((text or b"").translate(_FOLD).split()) + b" "


def grams(flat: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each gram size: the bucket of the gram at every position, and whether it lies within a word."""
    b = flat.astype(np.uint32)
    space = flat == 32
    h = (np.uint32(0x811C9DC5) ^ b) * _MULT
    inner = np.zeros(len(b), bool)
    for n in range(2, max(GRAMS) + 1):
        m = len(b) - n + 1
        if m <= 0:
            return
        if n > 2:
            inner = inner[:m] | space[n - 2:n - 2 + m]
        h = (h[:m] ^ b[n - 1:]) * _MULT
        if n in GRAMS:
            mixed = h ^ (h >> np.uint32(15))
            yield ((mixed * np.uint32(0x2C1B3C6D)) >> np.uint32(16)).astype(np.int64) & (BUCKETS - 1), ~inner[:m]


def passages(texts: list[bytes | None]) -> Iterator[tuple[np.ndarray, np.ndarray, int, int]]:
    """Groups of texts: their folded bytes, each position's passage, the passages' number, and the texts'."""
    i = 0
    while i < len(texts):
        parts, size = [], 0
        while i + len(parts) < len(texts) and size < BYTES_AT_ONCE:
            parts.append(folded(texts[i + len(parts)]))
            size += len(parts[-1])
        flat = np.frombuffer(b"".join(parts), np.uint8)
        count = [max(1, -(-len(p) // PASSAGE)) for p in parts]
        first = np.cumsum([0, *count])
        which = np.concatenate([f + np.arange(len(p)) // PASSAGE for f, p in zip(first.tolist(), parts)])
        yield flat, which, first, len(parts)
        i += len(parts)


def log_odds(texts: list[bytes | None], scores: np.ndarray, bias: float) -> np.ndarray:
    """The mean odds of each text's passages, as a logarithm: a passage's is the mean of its grams' scores, plus the bias.

    Passages without grams don't count; a text without any has the bias.
    """
    out = []
    for flat, which, first, _ in passages(texts):
        total, n = np.zeros(first[-1]), np.zeros(first[-1])
        for bucket, ok in grams(flat):
            at = which[:len(bucket)]
            total += np.bincount(at, np.where(ok, scores[bucket], 0), first[-1])
            n += np.bincount(at, ok, first[-1])
        z = np.where(n > 0, total / np.maximum(n, 1), -np.inf)
        top = np.maximum.reduceat(z, first[:-1])
        some = top > -np.inf
        top = np.where(some, top, 0)
        odds = np.add.reduceat(np.exp(SHARPNESS[1] * (z - np.repeat(top, np.diff(first)))), first[:-1])
        count = np.add.reduceat((n > 0).astype(float), first[:-1])
        out.append(top + np.log(np.where(some, odds / np.maximum(count, 1), 1)) / SHARPNESS[1] + bias)
    return np.concatenate(out) if out else np.zeros(0)


def bags(text: bytes | None) -> list[tuple[np.ndarray, np.ndarray]]:
    """The bags of a text's passages: buckets and counts."""
    out = []
    for flat, which, first, _ in passages([text]):
        found = [(b[ok], which[:len(b)][ok]) for b, ok in grams(flat)]
        if not found:
            continue
        bucket, at = np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])
        both, n = np.unique(at * BUCKETS + bucket, return_counts=True)
        cuts = np.searchsorted(both // BUCKETS, np.arange(1, first[-1]))
        out += list(zip(np.split(both % BUCKETS, cuts), np.split(n, cuts)))
    return [(b, n) for b, n in out if len(b)]


@dataclass
class Sample:
    """One training document: the buckets and counts of its passages one after another, each passage's length, the label."""

    buckets: np.ndarray        # 16 bits
    counts: np.ndarray         # 8 bits, as are the sizes: a passage has fewer than 256 grams
    sizes: np.ndarray
    label: int


def sample(found: list[tuple[np.ndarray, np.ndarray]], label: int) -> Sample:
    return Sample(np.concatenate([b for b, _ in found] or [[]]).astype(np.uint16),
                  np.concatenate([n for _, n in found] or [[]]).astype(np.uint8),
                  np.array([len(b) for b, _ in found], np.uint8), label)


def train(rows: list[Sample], steps: int = STEPS, batch: int = BATCH, rate: float = RATE, seed: int = SEED) -> Model:
    """Fit to documents given as the bags of their passages, and labels 0 or 1.

    Without both labels nothing can be learned: all scores are then the label's share.
    """
    rng = np.random.default_rng(seed)
    E = (rng.standard_normal((BUCKETS, DIM)) * 0.02).astype(np.float32)
    w, b = (rng.standard_normal(DIM) * 0.5).astype(np.float32), np.zeros(1, np.float32)
    rows = [r for r in rows if len(r.sizes)]
    labels = np.array([r.label for r in rows], np.float32)
    if len(set(labels.tolist())) < 2:
        return Model(E * 0, w, 6.0 if len(labels) and labels[0] else -6.0, False)
    b[0] = np.log(labels.mean() / (1 - labels.mean()))
    params = [E, w, b]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    order = np.zeros(0, np.int64)
    for step in range(1, steps + 1):
        while len(order) < batch:
            order = np.concatenate([order, rng.permutation(len(rows))])
        pick, order = order[:batch], order[batch:]
        done = step / steps
        sharp, now = SHARPNESS[0] * (SHARPNESS[1] / SHARPNESS[0]) ** done, rate * (1 - 0.9 * done)
        bucket = np.concatenate([rows[k].buckets for k in pick]).astype(np.int32)
        size = np.concatenate([rows[k].sizes for k in pick]).astype(np.int64)
        start = np.cumsum(size) - size
        share = np.concatenate([rows[k].counts for k in pick]).astype(np.float32)
        share /= np.repeat(np.add.reduceat(share, start), size)
        per = np.array([len(rows[k].sizes) for k in pick])
        doc = np.cumsum(per) - per
        z = np.add.reduceat((E @ w)[bucket] * share, start)
        top = np.maximum.reduceat(z, doc)
        odds = np.exp(sharp * (z - np.repeat(top, per)))
        total = np.add.reduceat(odds, doc)
        p = 1 / (1 + np.exp(-(top + np.log(total / per) / sharp + b[0])))
        err = (p - labels[pick]) * np.where(labels[pick] > 0, TOXIC_WEIGHT, 1) / len(pick)
        # a passage carries the share of the gradient that it has in the document's odds
        part = np.repeat(err / total, per) * odds
        g = np.bincount(bucket, np.repeat(part, size) * share, BUCKETS).astype(np.float32)
        grads = [g[:, None] * w, E.T @ g, np.array([err.sum()], np.float32)]
        for q, gr, a, c in zip(params, grads, first, second):
            a += 0.1 * (gr - a)
            c += 0.01 * (gr * gr - c)
            q -= now * (a / (1 - 0.9 ** step)) / (np.sqrt(c / (1 - 0.99 ** step)) + 1e-8)
        E *= np.float32(1 - now * DECAY)
    return Model(E, w, float(b[0]))


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", label: str = "toxic",
        most: tuple[int, int] = TRAIN_ROWS, most_bytes: int = TRAIN_BYTES) -> Model:
    """Train on at most ``most`` documents labelled 0 and 1, the first by a hash of the id, and on
    at most ``most_bytes`` of their texts: whole documents, taken as long as they fit.

    Held-out documents, null labels and labels other than 0 and 1 are left out;
    a document labelled twice counts with its highest label.  The chosen ids are
    broadcast (at most ``sum(most)``) and their documents' bags come to the driver.
    """
    prepare(docs.sparkSession)
    known = labels.where(F.col(label).isin(0, 1) & F.col(doc_id).isNotNull() & ~held_out(doc_id)) \
        .groupBy(F.col(doc_id).alias("doc_id")).agg(F.max(label).cast("int").alias("y"))
    known = known.withColumn("h", F.xxhash64(F.lit(SEED), "doc_id"))
    chosen = first_by_hash(known, "y", "h", {0: most[0], 1: most[1]}, ["doc_id"]).select("doc_id", "y", "h")
    texts = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("binary").alias("text"))
    sized = texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "y", "h") \
        .agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0))).alias("bytes")).collect()   # at most sum(most) rows
    fits, left = [], most_bytes
    for r in sorted(sized, key=lambda r: (r["h"] % (1 << 64), r["doc_id"])):
        if r["bytes"] <= left:
            fits.append((r["doc_id"], r["y"]))
            left -= r["bytes"]
    kind = docs.schema[doc_id].dataType.simpleString()
    taken = docs.sparkSession.createDataFrame(fits, f"doc_id {kind}, y int")
    src = texts.join(F.broadcast(taken), "doc_id").select("doc_id", "y", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [sample(bags(t), 0) for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array([x.buckets.astype("<u2").tobytes() for x in found], pa.binary()),
                 pa.array([x.counts.tobytes() for x in found], pa.binary()),
                 pa.array([x.sizes.tobytes() for x in found], pa.binary())],
                ["doc_id", "y", "b", "n", "sizes"])

    got = map_arrow(src, run, f"doc_id {kind}, y int, b binary, n binary, sizes binary").toArrow()

    def bits(column: str, i: int, dtype: str) -> np.ndarray:
        return np.frombuffer(got[column][i].as_buffer(), dtype)
    key = sorted(range(got.num_rows), key=lambda i: (got["doc_id"][i].as_py(), bits("b", i, "u1").tobytes()))
    return train([Sample(bits("b", i, "<u2"), bits("n", i, "u1"), bits("sizes", i, "u1"), got["y"][i].as_py()) for i in key])


def score(docs: DataFrame, model: Model, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per input row: ``doc_id, held_out, score`` (0 to 1) and ``predicted`` (1 from 0.5 on).

    Null and empty texts and texts without words get the score of the bias alone.
    Repeated rows and null ids are rows like others; an empty table gives an empty
    result.  Only the two columns are read.
    """
    prepare(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast((model.bucket_scores(), model.b))
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, bias = shared.value
        for b in batches:
            p = 1 / (1 + np.exp(-np.clip(log_odds(b.column(2).to_pylist(), weights, bias), -50, 50)))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(p, pa.float64()),
                                              pa.array((p >= 0.5).astype(np.int32))],
                                             ["doc_id", "held_out", "score", "predicted"])

    src = docs.select(F.col(doc_id).alias("doc_id"), held_out(doc_id).alias("held_out"),
                      F.col(text).cast("binary").alias("text"))
    return map_arrow(src, run, f"doc_id {kind}, held_out boolean, score double, predicted int")


def op8_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return score(docs, fit(docs, table(spark, sf_dir, "labels")))
