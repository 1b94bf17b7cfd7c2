"""SimHash near-dedup: fingerprints, tiled exact comparison, linked groups.

Two fingerprints at Hamming distance d have, lane by lane, population counts
that differ by d in sum at most.  So fingerprints are put into tiles by their
counts in ``LANES`` lanes, and only tiles whose counts differ by no more than the
radius in sum are compared: exactly, all against all, by numpy exclusive-or and
bit counts.  A fingerprint visits a number of tiles that the radius fixes, not
the number of rows; equal fingerprints are one row before anything is compared,
and a tile emits a spanning forest of its links, not all its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shoal.llm.common import attach, components, documents, map_arrow, materialise

#: Words in a shingle and the largest distance of a link.
SHINGLE, MAX_BITS = 3, 3
#: Fingerprints in the sides of one comparison (a tile pair is compared in such pieces).
HOME_SIDE, VISIT_SIDE = 512, 2048
#: Shingles counted at once, so that one text's memory is bounded.
SHINGLES_AT_ONCE = 1 << 16
_HASH_SEED = 42
_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)
_LANE = (np.arange(8) * 256).astype(np.int64)


def fingerprint(text: bytes | None, width: int = SHINGLE) -> int:
    """The 64-bit SimHash of a UTF-8 text: a bit is 1 if set in over half of the shingles' XXH64.

    A-Z are lower-cased and words are runs without U+0020 and U+0009 to U+000D.
    Fewer words than ``width`` make one shingle, none give fingerprint 0.
    """
    import xxhash

    words = (text or b"").lower().split()
    if not words:
        return 0
    grams = map(b" ".join, zip(*(words[i:] for i in range(width)))) if len(words) >= width else iter([b" ".join(words)])
    n = max(1, len(words) - width + 1)
    ones = np.zeros((8, 8), np.int64)
    digest = xxhash.xxh64_intdigest
    for start in range(0, n, SHINGLES_AT_ONCE):
        m = min(SHINGLES_AT_ONCE, n - start)
        h = np.fromiter((digest(g, _HASH_SEED) for g, _ in zip(grams, range(m))), np.uint64, m)
        lanes = h.view(np.uint8).reshape(m, 8) + _LANE
        ones += np.bincount(lanes.ravel(), minlength=2048).reshape(8, 256) @ _BITS
    bits = (2 * ones.ravel() > n).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", width: int = SHINGLE,
                 key: Column | None = None) -> DataFrame:
    """``(doc_id, fp bigint)`` for every row, and ``key`` (a string) if given; null texts count as empty."""
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(t.as_py(), width) for t in b.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps), *b.columns[2:]], ["doc_id", "fp", "key"][:b.num_columns])

    src = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("binary").alias("text"),
                      *([] if key is None else [key.alias("key")]))
    return map_arrow(src, run, f"doc_id {kind}, fp bigint" + ("" if key is None else ", key string"))


def _lanes(max_bits: int) -> int:
    """Lanes of a fingerprint: more lanes skip more tiles, but cost more visits at a large radius."""
    return 4 if max_bits <= 3 else 2 if max_bits <= 8 else 1


def _tile(counts: list[Column], base: int) -> Column:
    c = F.lit(0)
    for x in counts:
        c = c * base + x
    return c


def tiled(fps: DataFrame, max_bits: int) -> DataFrame:
    """``(tile, visit, fp)``: every fingerprint in its own tile and as a visitor in the near ones.

    Each unordered pair of near tiles is met once: the visitor comes from the
    tile that is lower by the first count that differs.
    """
    lanes = _lanes(max_bits)
    width, base = 64 // lanes, 64 // lanes + 1
    mask = -1 if lanes == 1 else (1 << width) - 1
    counts = [F.bit_count(F.shiftrightunsigned("fp", i * width).bitwiseAND(F.lit(mask).cast("bigint")))
              for i in range(lanes)]
    steps = [d for d in product(range(-max_bits, max_bits + 1), repeat=lanes)
             if sum(map(abs, d)) <= max_bits and d > (0,) * lanes]
    moves = F.array(*[F.array(*map(F.lit, d)) for d in [(0,) * lanes, *steps]])
    at = fps.select("fp", *[c.alias(f"c{i}") for i, c in enumerate(counts)]) \
        .select("fp", *[f"c{i}" for i in range(lanes)], F.explode(moves).alias("d"))
    to = [F.col(f"c{i}") + F.element_at("d", i + 1) for i in range(lanes)]
    inside = F.lit(True)
    for t in to:
        inside = inside & t.between(0, width)
    visit = F.lit(False)
    for i in range(lanes):
        visit = visit | (F.element_at("d", i + 1) != 0)
    return at.where(inside).select(_tile(to, base).cast("int").alias("tile"), visit.alias("visit"), "fp")


class _Forest:
    """Union-find over fingerprints; ``edges`` are the links that joined two trees."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}
        self.edges: list[tuple[int, int]] = []

    def root(self, x: int) -> int:
        up = self.up
        while (p := up.get(x, x)) != x:
            up[x] = up.get(p, p)
            x = p
        return x

    def link(self, a: int, b: int) -> None:
        ra, rb = self.root(a), self.root(b)
        if ra != rb:
            self.up[max(ra, rb)] = min(ra, rb)
            self.edges.append((a, b))


def _link_tile(forest: _Forest, home: np.ndarray, visit: np.ndarray, max_bits: int, same: bool) -> None:
    """Link all pairs of the two sides within the radius; ``same``: the sides are one array."""
    for i in range(0, len(home), HOME_SIDE):
        a = home[i:i + HOME_SIDE]
        for j in range(i if same else 0, len(visit), VISIT_SIDE):
            b = visit[j:j + VISIT_SIDE]
            near = np.bitwise_count(a[:, None] ^ b[None, :]) <= max_bits
            if same:
                near &= a[:, None] < b[None, :]
            rows, cols = near.any(1).nonzero()[0], near.any(0).nonzero()[0]
            if not len(rows):
                continue
            near, x, y = near[np.ix_(rows, cols)], a[rows].tolist(), b[cols].tolist()
            while True:                         # one link for each visitor that is still apart from a neighbour
                la = np.array([forest.root(v) for v in x], np.uint64)
                lb = np.array([forest.root(v) for v in y], np.uint64)
                apart = near & (la[:, None] != lb[None, :])
                todo = apart.any(0).nonzero()[0]
                if not len(todo):
                    break
                for c, r in zip(todo.tolist(), apart[:, todo].argmax(0).tolist()):
                    forest.link(x[r], y[c])


def links(fps: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """Links ``(a, b)`` that connect distinct ``fps(fp)`` exactly as all pairs within the radius do.

    A task holds one tile's own fingerprints and streams the visitors.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile, parts, home, forest = None, [], None, _Forest()

        def edges() -> Iterator[pa.RecordBatch]:
            if forest.edges:
                e = np.array(forest.edges, np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(e[:, 0]), pa.array(e[:, 1])], ["a", "b"])

        def settle() -> np.ndarray:
            """All of the tile's own fingerprints have come: compare them with each other."""
            h = np.sort(np.concatenate(parts)) if parts else np.zeros(0, np.uint64)
            _link_tile(forest, h, h, max_bits, True)
            return h

        for b in batches:
            tiles, visits = b.column(0).to_numpy(), b.column(1).to_numpy(zero_copy_only=False)
            fp = b.column(2).to_numpy().view(np.uint64)
            cuts = np.flatnonzero((np.diff(tiles) != 0) | (np.diff(visits.astype(np.int8)) != 0)) + 1
            for i, j in zip([0, *cuts], [*cuts, len(tiles)]):
                if tiles[i] != tile:
                    if tile is not None and home is None:
                        settle()
                    yield from edges()
                    tile, parts, home, forest = tiles[i], [], None, _Forest()
                if not visits[i]:
                    parts.append(fp[i:j].copy())
                else:
                    if home is None:
                        home = settle()
                    _link_tile(forest, home, fp[i:j], max_bits, False)
        if tile is not None and home is None:
            settle()
        yield from edges()

    dealt = tiled(fps, max_bits).repartition("tile").sortWithinPartitions("tile", "visit")
    return map_arrow(dealt, run, "a bigint, b bigint")


def _rooted(rows: DataFrame, first: Column, max_bits: int) -> DataFrame:
    """``(fp, first, n, root)`` for the distinct fingerprints of ``rows``: ``first`` is an aggregate of a
    fingerprint's rows, ``n`` their number, ``root`` the same for all that are linked."""
    fps = materialise(rows.groupBy("fp").agg(first.alias("first"), F.count(F.lit(1)).alias("n")), "op1-distinct")
    comp = components(links(fps.select("fp"), max_bits))
    return materialise(fps.join(comp.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", "first", "n", F.coalesce("component", "fp").alias("root")), "op1-roots")


def simhash_groups(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", width: int = SHINGLE,
                   max_bits: int = MAX_BITS) -> DataFrame:
    """One row per input row: ``doc_id, fingerprint`` (16 hex digits) and ``component_id``.

    ``component_id`` is the smallest ``doc_id`` reachable over links of at most
    ``max_bits`` differing bits, itself included; null ids are passed over
    unless a whole group has none.  Texts without a word (null, empty) have
    fingerprint 0 and link like any other.  Repeated rows give repeated rows, an
    empty table an empty result.  Only the two named columns are read.
    """
    rows = materialise(fingerprints(docs, text, doc_id, width), "op1-fp")
    placed = _rooted(rows, F.min("doc_id"), max_bits)
    least = placed.groupBy("root").agg(F.min("first").alias("component_id"), F.count(F.lit(1)).alias("members"))
    ids = attach(placed, least, ["root"], "members").select("fp", "component_id", "n")
    return attach(rows, ids, ["fp"], "n").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def simhash_dedup(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", width: int = SHINGLE,
                  max_bits: int = MAX_BITS) -> DataFrame:
    """The documents that stay, with all their columns: exactly one row of each linked group.

    It is the row with the smallest ``doc_id``, null last; among rows of one id, or
    without any, that with the smallest fingerprint, then the smallest hash of its
    text.  Rows of one id whose texts are in different groups are different
    documents.  Rows of the same id and text are one document.
    """
    part = lambda c: F.coalesce(F.concat(F.lit("="), c), F.lit("null"))
    key = F.md5(F.concat_ws(",", part(F.md5(F.col(text).cast("binary"))), part(F.col(doc_id).cast("string"))).cast("binary"))
    rows = materialise(fingerprints(docs, text, doc_id, width, key), "op1-fp")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "fp", "key")
    stay = _rooted(rows, F.min(order), max_bits).groupBy("root").agg(F.min("first").alias("first")) \
        .select(F.col("first.key").alias("_key"))
    wide = docs.select(key.alias("_key"), F.struct("*").alias("_row"))
    return wide.join(stay, "_key", "left_semi").dropDuplicates(["_key"]).select("_row.*")


def op1_simhash(spark, sf_dir: str) -> DataFrame:
    return simhash_groups(documents(spark, sf_dir))
