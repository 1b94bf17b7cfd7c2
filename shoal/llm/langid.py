"""Language identification by a bidirectional gated recurrent network over bytes.

A text's UTF-8 bytes are read in segments of ``SEGMENT`` bytes by two gated
recurrent layers, one from each end.  Every byte gets a probability for each
language from the two states that meet at it; a document's probabilities are
the means over all its bytes.  The network is trained in numpy by
backpropagation through time.  Its squashing function is x / (1 + |x|), for
states and gates alike, as it costs less than a tenth of an exponential.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoal.llm.common import documents, first_by_hash, held_out, map_arrow, prepare

#: Units of each direction; bytes that a state is carried over.
UNITS, SEGMENT = 8, 128
#: Training reads at most so many documents of a language, a window of ``SEGMENT`` bytes of each.
TRAIN_PER_LANG = 1000
#: Training steps, windows in a step, Adam's rate, seed.
STEPS, BATCH, RATE, SEED = 160, 128, 0.02, 7
#: Segments worked on at once.
LANES = 4096
#: Learned languages: more distinct values than this are refused (the sample is bounded by this).
MOST_LANGS = 512
UNKNOWN = "und"
_LETTER = re.compile(r"[^\W\d_]")
_ASCII_LETTER = re.compile(rb"[A-Za-z]")


@dataclass
class Model:
    """``W``: input rows of the bytes, ``U``: recurrent weights, of both directions; ``O``, ``o``: output."""

    langs: list[str]
    W: list[np.ndarray]
    U: list[np.ndarray]
    O: np.ndarray  # noqa: E741
    o: np.ndarray


def _step(x: np.ndarray, h: np.ndarray, u: np.ndarray, keep: list | None = None) -> np.ndarray:
    """One byte: update gate, reset gate and candidate from the input row ``x`` and the state."""
    n = h.shape[1]
    a = h @ u
    g = x[:, :2 * n] + a[:, :2 * n]
    g /= np.abs(g) + np.float32(1)
    g *= np.float32(0.5)
    g += np.float32(0.5)
    c = a[:, 2 * n:] * g[:, n:]
    c += x[:, 2 * n:]
    c /= np.abs(c) + np.float32(1)
    out = h - c
    out *= g[:, :n]
    out += c
    if keep is not None:
        keep.append((h, g, c, a[:, 2 * n:]))
    return out


def _states(m: Model, lanes: np.ndarray, keep: list | None = None) -> list[np.ndarray]:
    """The states of both directions at every byte: two arrays (bytes, lanes, units)."""
    t, b, n = lanes.shape[1], lanes.shape[0], m.U[0].shape[0]
    by = np.ascontiguousarray(lanes.T)
    out = []
    for side in (0, 1):
        h, all_, saved = np.zeros((b, n), np.float32), np.empty((t, b, n), np.float32), []
        for k in range(t) if side == 0 else range(t - 1, -1, -1):
            h = _step(np.take(m.W[side], by[k], axis=0), h, m.U[side], saved if keep is not None else None)
            all_[k] = h
        out.append(all_)
        if keep is not None:
            keep.append(saved)
    return out


def _probabilities(m: Model, states: list[np.ndarray]) -> np.ndarray:
    n = states[0].shape[2]
    z = states[0] @ m.O[:n]
    z += states[1] @ m.O[n:]
    z += m.o
    z -= z.max(axis=2, keepdims=True)
    np.exp(z, out=z)
    z /= z.sum(axis=2, keepdims=True)
    return z


def label_positions(m: Model, lanes: np.ndarray) -> np.ndarray:
    """Language probabilities of every byte: (lanes, bytes, languages) for a byte array (lanes, bytes)."""
    return _probabilities(m, _states(m, lanes)).transpose(1, 0, 2)


def segments(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Texts as lanes of ``SEGMENT`` bytes (the last one padded with 0), lane lengths, and each lane's text."""
    n = np.array([max(1, -(-len(t) // SEGMENT)) for t in texts], np.int64)
    flat = np.zeros(int(n.sum()) * SEGMENT, np.uint8)
    lens = np.full(int(n.sum()), SEGMENT, np.int64)
    at = 0
    for t, k in zip(texts, n.tolist()):
        flat[at:at + len(t)] = np.frombuffer(t, np.uint8)
        lens[at // SEGMENT + k - 1] = len(t) - (k - 1) * SEGMENT
        at += k * SEGMENT
    return flat.reshape(-1, SEGMENT), lens, np.repeat(np.arange(len(texts)), n)


def pooled(m: Model, texts: list[bytes]) -> np.ndarray:
    """(texts, languages): the mean probabilities over all bytes of each text."""
    lanes, lens, owner = segments(texts)
    sums = np.zeros((len(lanes), len(m.langs)))
    for i in range(0, len(lanes), LANES):
        p = _probabilities(m, _states(m, lanes[i:i + LANES]))
        inside = np.arange(SEGMENT)[:, None] < lens[i:i + LANES]
        sums[i:i + LANES] = np.einsum("tbl,tb->bl", p, inside.astype(np.float32))
    out = np.zeros((len(texts), len(m.langs)))
    np.add.at(out, owner, sums)
    return out / np.maximum(1, np.array([len(t) for t in texts]))[:, None]


def train(rows: list[tuple[bytes, str]], steps: int = STEPS, batch: int = BATCH, units: int = UNITS,
          rate: float = RATE, seed: int = SEED) -> Model:
    """Fit the network to windows and their languages; the order of ``rows`` doesn't matter."""
    rows = sorted(r for r in rows if r[0])
    langs = sorted({lang for _, lang in rows})
    rng = np.random.default_rng(seed)
    n, k = units, max(1, len(langs))
    scale = lambda *s: (rng.standard_normal(s) * 0.3).astype(np.float32)
    m = Model(langs, [scale(256, 3 * n) for _ in "fb"], [scale(n, 3 * n) for _ in "fb"], scale(2 * n, k),
              np.zeros(k, np.float32))
    if len(langs) < 2:
        return m
    lanes, lens, _ = segments([t[:SEGMENT] for t, _ in rows])
    target = np.array([langs.index(lang) for _, lang in rows])
    by_lang = [np.flatnonzero(target == i) for i in range(k)]
    params = [*m.W, *m.U, m.O, m.o]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for step in range(1, steps + 1):
        # as many windows of each language, whatever their shares
        pick = np.concatenate([rng.choice(ix, max(1, batch // k)) for ix in by_lang])
        grads = _gradients(m, lanes[pick], lens[pick], target[pick])
        lr = rate * min(1.0, 2 * (1 - step / (steps + 1)))
        for p, g, a, b in zip(params, grads, first, second):
            a += 0.1 * (g - a)
            b += 0.01 * (g * g - b)
            p -= (lr * (a / (1 - 0.9 ** step)) / (np.sqrt(b / (1 - 0.99 ** step)) + 1e-8)).astype(np.float32)
    return m


def _gradients(m: Model, lanes: np.ndarray, lens: np.ndarray, target: np.ndarray) -> list[np.ndarray]:
    """Of the mean cross entropy over all bytes, by backpropagation through time."""
    n, t = m.U[0].shape[0], lanes.shape[1]
    keep: list = []
    states = _states(m, lanes, keep)
    p = _probabilities(m, states)
    p[:, np.arange(len(target)), target] -= 1
    p *= ((np.arange(t)[:, None] < lens) / lens.sum()).astype(np.float32)[:, :, None]
    dw, du = [np.zeros_like(w) for w in m.W], [np.zeros_like(u) for u in m.U]
    do = np.concatenate([np.einsum("tbn,tbl->nl", s, p) for s in states])
    for side in (0, 1):
        back = p @ m.O[side * n:(side + 1) * n].T
        dh = np.zeros_like(back[0])
        order = range(t - 1, -1, -1) if side == 0 else range(t)
        for k in order:
            h, g, c, ac = keep[side][k if side == 0 else t - 1 - k]
            dh = dh + back[k]
            dc = dh * (1 - g[:, :n]) * (1 - np.abs(c)) ** 2
            dg = np.concatenate([dh * (h - c), dc * ac], 1) * 0.5 * (1 - np.abs(2 * g - 1)) ** 2
            da = np.concatenate([dg, dc * g[:, n:]], 1)
            np.add.at(dw[side], lanes[:, k], np.concatenate([dg, dc], 1))
            du[side] += h.T @ da
            dh = dh * g[:, :n] + da @ m.U[side].T
    return [*dw, *du, do, p.sum((0, 1))]


def training_rows(docs: DataFrame, text: str = "text", lang: str = "lang", doc_id: str = "doc_id",
                  per_lang: int = TRAIN_PER_LANG) -> list[tuple[bytes, str]]:
    """At most ``per_lang`` labelled documents of each language, the first by a hash of id and text.

    Held-out documents are left out.  Of each comes one window of ``SEGMENT`` bytes, at a
    place of the whole text that the hash decides.
    """
    raw = F.col(text).cast("binary")
    h = F.xxhash64(F.lit(SEED), F.col(doc_id), raw)
    place = F.pmod(F.xxhash64(h), F.greatest(F.lit(1), F.octet_length(raw) - SEGMENT + 1)).cast("int") + 1
    rows = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull() & (F.octet_length(raw) > 0)
                      & ~held_out(doc_id)) \
        .select(F.col(lang).alias("lang"), h.alias("h"), F.substring(raw, place, F.lit(SEGMENT)).alias("w"))
    langs = [r["lang"] for r in rows.select("lang").distinct().limit(MOST_LANGS + 1).collect()]
    if len(langs) > MOST_LANGS:
        raise ValueError(f"more than {MOST_LANGS} values of {lang}")
    chosen = first_by_hash(rows, "lang", "h", dict.fromkeys(langs, per_lang), ["w"])
    return [(bytes(r["w"]), r["lang"]) for r in chosen.select("w", "lang").collect()]


def has_letter(raw: bytes) -> bool:
    return bool(_ASCII_LETTER.search(raw) or _LETTER.search(raw.decode("utf-8", "replace")))


def predict(m: Model, texts: list[bytes | None]) -> tuple[list[str], list[float]]:
    """The language of each text and its pooled probability; ``und`` and 0 without a letter or a language."""
    able = [i for i, t in enumerate(texts) if t and m.langs and has_letter(t)]
    langs, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
    if able:
        p = pooled(m, [texts[i] for i in able])
        for i, best, score in zip(able, p.argmax(1).tolist(), p.max(1).tolist()):
            langs[i], scores[i] = m.langs[best], min(1.0, max(0.0, score))
    return langs, scores


def fit(docs: DataFrame, **columns: str) -> Model:
    """Train on the driver, on the bounded sample of :func:`training_rows`."""
    return train(training_rows(docs, **columns))


def identify(docs: DataFrame, model: Model, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per input row: ``doc_id, held_out, lang_pred, score``.

    Null texts and texts without a letter get ``und`` and 0; so do all if nothing was
    learned.  Repeated rows and null ids are rows like others (a null id hashes as the
    empty string); an empty table gives an empty result.  Only the two columns are read.
    """
    prepare(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            langs, scores = predict(shared.value, b.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(langs, pa.string()),
                                              pa.array(scores, pa.float64())],
                                             ["doc_id", "held_out", "lang_pred", "score"])

    src = docs.select(F.col(doc_id).alias("doc_id"), held_out(doc_id).alias("held_out"),
                      F.col(text).cast("binary").alias("text"))
    return map_arrow(src, run, f"doc_id {kind}, held_out boolean, lang_pred string, score double")


def keep_known(docs: DataFrame, model: Model, min_score: float, text: str = "text") -> DataFrame:
    """The documents whose language is known with at least ``min_score``, with all their columns."""
    prepare(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            langs, scores = predict(shared.value, b.column(at).cast(pa.binary()).to_pylist())
            yield b.filter(pa.array([x != UNKNOWN and s >= min_score for x, s in zip(langs, scores)], pa.bool_()))

    plain = ", ".join(f"c{i} {f.dataType.simpleString()}" for i, f in enumerate(docs.schema))
    return map_arrow(docs.toDF(*[f"c{i}" for i in range(len(docs.columns))]), run, plain).toDF(*docs.columns)


def op3_language_id(spark, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return identify(docs, fit(docs))
