"""Benchmark decontamination: CGK embedding, sampled keys, exact edit verification.

Texts become word sequences.  The CGK embedding of a window walks over its
words: step j writes the current word, and a random bit that j and the word
decide says whether to go on to the next.  A key is made of a few sampled
places of the embedding, so equal windows always share their key.

Every window of an item and of a document has a key.  Windows are so short that
the edits a match may have, wherever they stand, leave some windows of the item
as they are; an item that shares at least that many keys with a document is
compared exactly by edit distance.  So no match is missed, at any distance up to
the limit.  Items go in blocks of bounded size against all documents; nothing
is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import ceil
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoal.llm.common import documents, map_arrow, prepare, table

#: Largest edit distance of a match, as a share of the item's words.
MAX_EDIT = 0.2
#: The share of edited words that the search is made for: all that a match may have.
DESIGN_EDIT = MAX_EDIT
#: Sampled places in a key at most; windows of four words and less have them all, so few other windows share a key.
PLACES = 12
#: UTF-8 bytes of items that are sent to the tasks at once.
BLOCK_BYTES = 1 << 20
#: Words that one step works on at once.
WORDS_AT_ONCE = 1 << 20
_PAD = np.uint32(0)
#: ASCII letters and digits stay (lower-cased), other ASCII becomes a space, bytes over 127 stay.
_FOLD = bytes(c if c > 127 or chr(c).isalnum() else 32 for c in bytes(range(256)).lower())


def words(text: bytes | None) -> np.ndarray:
    """CRC-32 of each word: case and ASCII punctuation don't count."""
    w = (text or b"").translate(_FOLD).split()
    return np.fromiter(map(crc32, w), np.uint32, len(w))


@dataclass(frozen=True)
class Shape:
    """Windows of ``length`` words; a key samples ``places`` of the walk's steps."""

    length: int
    places: int

    @property
    def steps(self) -> int:
        return 3 * self.length


def shape_of(n_words: int, most: int) -> Shape:
    """The longest windows of which ``most`` edits leave one as it is: ``most + 1`` of them fit in the item side by side."""
    length = next(k for k in (12, 8, 4, 3, 2, 1) if k <= max(1, n_words // (most + 1)))
    return Shape(length, min(PLACES, 3 * length))


def left_over(n_words: int, most: int, shape: Shape) -> int:
    """Windows of an item that ``most`` edits leave as they are, at least: an edit changes ``length`` of them."""
    return max(1, n_words - shape.length + 1 - most * shape.length)


def keys(ids: np.ndarray, starts: np.ndarray, ends: np.ndarray, shape: Shape, walk: int = 0) -> np.ndarray:
    """The 64-bit key of the window at each start; words from ``ends`` on read as padding."""
    rng = np.random.default_rng([1, shape.length, walk])
    odd = np.uint32(rng.integers(1 << 31) * 2 + 1)
    places = set(rng.choice(shape.steps, shape.places, replace=False).tolist())
    coin = ids * odd
    at, stop = starts.copy(), np.minimum(starts + shape.length, ends)
    last = max(0, len(ids) - 1)
    key = np.full(len(starts), rng.integers(1 << 62), np.uint64)
    mult = np.uint64(0x9E3779B97F4A7C15)
    for j in range(shape.steps):
        inside = at < stop
        here = np.minimum(at, last)
        if j in places:
            key = (key ^ np.where(inside, ids[here], _PAD)) * mult
            key ^= key >> np.uint64(29)
        at += ((coin[here] >> np.uint32(31 - j % 31)) & np.uint32(1)).astype(np.int64) * inside
    return key


class Index:
    """The keys of a block of items, by window shape, for matches of up to ``max_edit`` of an item's words."""

    def __init__(self, items: list[tuple[object, bytes]], max_edit: float = MAX_EDIT) -> None:
        if not 0 <= max_edit < 1:
            raise ValueError("max_edit must be at least 0 and under 1")
        self.ids = [i for i, _ in items]
        self.words = [words(t) for _, t in items]
        self.most = [int(max_edit * len(w)) for w in self.words]
        self.need = np.zeros(len(items), np.int64)
        self.tables: dict[Shape, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = {}
        by_shape: dict[Shape, list[int]] = {}
        for k, w in enumerate(self.words):
            if len(w):
                shape = shape_of(len(w), self.most[k])
                self.need[k] = left_over(len(w), self.most[k], shape)
                by_shape.setdefault(shape, []).append(k)
        for shape, members in by_shape.items():
            flat = np.concatenate([self.words[k] for k in members])
            lens = [len(self.words[k]) for k in members]
            item, end, begin = (np.repeat(x, lens) for x in (members, np.cumsum(lens), np.cumsum(lens) - lens))
            start = np.flatnonzero(np.arange(len(flat)) + shape.length <= end)
            key = keys(flat, start, end[start], shape)
            order = np.argsort(key, kind="stable")
            seen = np.zeros(1 << 20, bool)
            seen[(key >> np.uint64(44)).astype(np.int64)] = True
            self.tables[shape] = (key[order], item[start][order], (start - begin[start])[order], seen)

    def candidates(self, ids: np.ndarray, doc: np.ndarray, ends: np.ndarray) -> list[tuple[int, int, int]]:
        """``(document, item, word where the item would begin)``, sorted, for the keys that a document and an item
        share, if these are of as many windows of the item as a match leaves."""
        n_items, longest = len(self.ids), max(map(len, self.words), default=0) + 1
        at, found = np.arange(len(ids)), []
        for shape, (key, item, offset, seen) in self.tables.items():
            k = keys(ids, at, ends, shape)
            near = np.flatnonzero(seen[(k >> np.uint64(44)).astype(np.int64)])
            lo, hi = np.searchsorted(key, k[near], "left"), np.searchsorted(key, k[near], "right")
            n = hi - lo
            here = np.repeat(near, n)
            there = np.arange(len(here)) + np.repeat(lo - (np.cumsum(n) - n), n)
            pair, off = doc[here] * n_items + item[there], offset[there]
            pairs, shared = np.unique(np.unique(pair * longest + off) // longest, return_counts=True)
            enough = np.isin(pair, pairs[shared >= self.need[pairs % n_items]])
            found += zip((pair[enough] // n_items).tolist(), (pair[enough] % n_items).tolist(),
                         (here[enough] - off[enough]).tolist())
        return sorted(set(found))


def edit_in(pattern: list[int], text: list[int], most: int) -> tuple[int, int]:
    """The smallest edit distance of ``pattern`` to any run of ``text``, and where that run ends.

    Exact, by bit-parallel columns (one Python integer holds a column).
    ``(most + 1, -1)`` if the distance is larger than ``most``.
    """
    m = len(pattern)
    peq: dict[int, int] = {}
    for i, c in enumerate(pattern):
        peq[c] = peq.get(c, 0) | (1 << i)
    full, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score, best, end = full, 0, m, most + 1, -1
    if m <= most:
        best, end = m, 0
    for j, c in enumerate(text):
        eq = peq.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph, mh = mv | (~(xh | pv) & full), pv & xh
        score += 1 if ph & top else -1 if mh & top else 0
        ph, mh = (ph << 1) & full, (mh << 1) & full
        pv, mv = mh | (~(xv | ph) & full), ph & xv
        if score < best:
            best, end = score, j + 1
    return best, end


def find(index: Index, texts: list[bytes | None]) -> list[tuple[int, int, int, int]]:
    """``(text, item, distance, word where the match ends)``: the best match of each text and item."""
    out: dict[tuple[int, int], tuple[int, int]] = {}
    first = 0
    while first < len(texts):
        parts, n = [], 0
        while first + len(parts) < len(texts) and n < WORDS_AT_ONCE:
            parts.append(words(texts[first + len(parts)]))
            n += len(parts[-1])
        lens = np.array([len(p) for p in parts])
        ids = np.concatenate(parts)
        stop = np.cumsum(lens)
        doc, ends = np.repeat(np.arange(len(parts)), lens), np.repeat(stop, lens)
        spots: dict[tuple[int, int], list[list[int]]] = {}      # runs of words to compare; those that overlap go together
        for d, k, s in index.candidates(ids, doc, ends):
            reach = index.most[k] + 4
            lo, hi = max(int(stop[d] - lens[d]), s - reach), min(int(stop[d]), s + len(index.words[k]) + reach)
            runs = spots.setdefault((d, k), [])
            if runs and lo <= runs[-1][1]:
                runs[-1][1] = max(hi, runs[-1][1])
            else:
                runs.append([lo, hi])
        for (d, k), runs in spots.items():
            pattern, most = index.words[k].tolist(), index.most[k]
            for lo, hi in runs:
                dist, end = edit_in(pattern, ids[lo:hi].tolist(), most)
                if dist <= most and dist < out.get((first + d, k), (most + 1, 0))[0]:
                    out[first + d, k] = (dist, lo + end - int(stop[d] - lens[d]))
        first += len(parts)
    return [(d, k, *v) for (d, k), v in sorted(out.items())]


def item_blocks(items: DataFrame, item_id: str, text: str) -> Iterator[list[tuple[object, bytes]]]:
    """The items, ``BLOCK_BYTES`` of text at a time; null ids and texts come along."""
    t = F.coalesce(F.col(text), F.lit(""))
    rows = items.select(F.col(item_id).alias("i"), t.cast("binary").alias("t"))
    size = rows.agg(F.sum(F.octet_length("t") + 16)).first()[0] or 0
    n = max(1, ceil(size / BLOCK_BYTES))
    for b in range(n):
        part = rows if n == 1 else rows.where(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == b)
        yield [(r["i"], bytes(r["t"])) for r in part.collect()]


def matches(docs: DataFrame, items: DataFrame, text: str = "text", doc_id: str = "doc_id",
            item_id: str = "item_id", item_text: str = "text", max_edit: float = MAX_EDIT) -> DataFrame:
    """``(doc_id, item_id, distance, item_words, end_word)``: a row for each document and item found in it.

    ``distance`` is the least number of words to insert, delete or change to turn
    the item into a run of the document, at most ``max_edit`` of the item's words.
    Null and empty texts match nothing, items without a word are never found.
    Items of one text are found under each of their ids, repeated rows give repeated
    matches.  Only the named columns are read.
    """
    spark = docs.sparkSession
    prepare(spark)
    ids, iids = docs.schema[doc_id].dataType.simpleString(), items.schema[item_id].dataType.simpleString()
    src = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("binary").alias("text"))
    out = None
    for block in item_blocks(items, item_id, item_text):
        index = spark.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            idx = Index(index.value, max_edit)
            for b in batches:
                hit = find(idx, b.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(pa.array([h[0] for h in hit], pa.int64())),
                     pa.array([idx.ids[h[1]] for h in hit]).cast(_arrow(iids)),
                     pa.array([h[2] for h in hit], pa.int32()),
                     pa.array([len(idx.words[h[1]]) for h in hit], pa.int32()),
                     pa.array([h[3] for h in hit], pa.int64())],
                    ["doc_id", "item_id", "distance", "item_words", "end_word"])

        part = map_arrow(src, run, f"doc_id {ids}, item_id {iids}, distance int, item_words int, end_word bigint")
        out = part if out is None else out.unionByName(part)
    return out


def _arrow(kind: str) -> pa.DataType:
    return {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[kind]


def decontaminate(docs: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id",
                  item_text: str = "text", max_edit: float = MAX_EDIT) -> DataFrame:
    """The documents in which no item is found, with all their columns; nothing is shuffled."""
    spark = docs.sparkSession
    prepare(spark)
    plain = ", ".join(f"c{i} {f.dataType.simpleString()}" for i, f in enumerate(docs.schema))
    out = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    at = docs.columns.index(text)
    for block in item_blocks(items, item_id, item_text):
        index = spark.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            idx = Index(index.value, max_edit)
            for b in batches:
                keep = np.ones(b.num_rows, bool)
                keep[[h[0] for h in find(idx, b.column(at).cast(pa.binary()).to_pylist())]] = False
                yield b.filter(pa.array(keep))

        out = map_arrow(out, run, plain)
    return out.toDF(*docs.columns)


def op5_decontamination(spark, sf_dir: str) -> DataFrame:
    return matches(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))
