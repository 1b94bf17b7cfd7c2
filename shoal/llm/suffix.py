"""Suffix-array dedup: bytes in a repeated string of ``length`` bytes are removed.

Sorting every suffix of a large corpus would move many times its size, so
suffixes are first brought together where they can match.  A window of
``length`` bytes is governed by its least ``GRAM``-byte hash, its anchor: equal
windows have equal anchors at the same place.  Windows of one anchor are taken in
runs; a run's windows share a core of bytes, and only runs with equal cores
can hold equal windows.  Runs that are equal as a whole are counted; of the
others, one for each content goes into the sort of its core.

There the suffixes from the anchor on are sorted deep-shallow: multikey
quicksort to a shallow depth, blind tries for the groups with longer common
prefixes; so are the reversed prefixes.  Common prefix lengths in both orders
give, for each run, which of its windows occur in another run.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoal.llm.common import attach, documents, map_arrow, materialise

LENGTH, GRAM, RUN = 400, 16, 193
#: Bytes of multikey quicksort; deeper groups go to blind tries.
SHALLOW = 32
#: A core with more different runs than this is settled window by window instead, by counting.
MAX_GROUP = 4096
#: Texts are worked on in pieces of at most so many bytes.
PIECE = 1 << 20
#: Bits of the filter that says which documents may be needed; its size is fixed, errors only cost time.
FILTER_BITS = 1 << 24
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_SHIFT_LO, _SHIFT_AT, _MASK = 16, 32, 0xFFFF


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


class _Hashes:
    """Hashes of any stretch of a byte array, in constant time each."""

    _up = _down = np.ones(1, np.uint64)

    def __init__(self, b: np.ndarray) -> None:
        n = len(b) + 1
        if len(_Hashes._up) < n:
            for name, base in (("_up", _BASE), ("_down", _INVERSE)):
                t = np.full(n, base, np.uint64)
                t[0] = 1
                setattr(_Hashes, name, np.multiply.accumulate(t))
        self.sums = np.zeros(n, np.uint64)
        np.cumsum((b.astype(np.uint64) + np.uint64(1)) * _Hashes._up[:n - 1], out=self.sums[1:])

    def of(self, lo: np.ndarray, hi: np.ndarray, salt: np.ndarray | int = 0) -> np.ndarray:
        h = (self.sums[hi] - self.sums[lo]) * _Hashes._down[lo]
        return _mix(h + np.asarray(salt).astype(np.uint64) * np.uint64(0xD1B54A32D192ED03))


def _grams(b: np.ndarray, gram: int) -> np.ndarray:
    """A 32-bit hash of the ``gram`` bytes from each position on."""
    h = b.astype(np.uint64) + np.uint64(1)
    size = 1
    while size < gram:                                   # from stretches of ``size`` bytes to longer ones
        step = min(size, gram - size)
        h = _mix(h[:len(h) - step] * np.uint64(_BASE) + h[step:])
        size += step
    return h >> np.uint64(32)


def _least(x: np.ndarray, width: int) -> np.ndarray:
    """The minimum of each ``width`` neighbours, from prefix and suffix minima of blocks."""
    n = len(x) - width + 1
    pad = -len(x) % width
    rows = np.concatenate([x, np.full(pad, np.iinfo(np.uint64).max, np.uint64)]).reshape(-1, width)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    back = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[width - 1:width - 1 + n])


def runs(text: bytes, length: int = LENGTH, gram: int = GRAM, run: int = RUN) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(core, content, at)`` of the runs of a text's windows, as 64-bit integers.

    ``at`` packs the anchor's position and the smallest and largest distance from a
    window's start to the anchor.  ``core`` is a hash of the bytes that all windows of
    such a run share, ``content`` one of all its bytes.
    """
    out = []
    width = length - gram + 1
    for base in range(0, max(0, len(text) - length + 1), PIECE):
        b = np.frombuffer(text[base:base + PIECE + length - 1], np.uint8)
        keyed = (_grams(b, gram) << np.uint64(32)) | np.arange(len(b) - gram + 1, dtype=np.uint64)
        anchor = (_least(keyed, width) & np.uint64(0xFFFFFFFF)).astype(np.int64)
        first = np.flatnonzero(np.diff(anchor, prepend=-1))
        last = np.append(first[1:], len(anchor)) - 1
        m = anchor[first]
        far, near = m - first, m - last
        n = far // run - near // run + 1
        m, far, near, first = np.repeat(m, n), np.repeat(far, n), np.repeat(near, n), np.cumsum(n) - n
        part = near // run + np.arange(len(m)) - np.repeat(first, n)
        lo, hi = np.maximum(near, part * run), np.minimum(far, part * run + run - 1)
        h = _Hashes(b)
        core = h.of(m - part * run, m - np.minimum(part * run + run - 1, width - 1) + length, part + 1)
        content = h.of(m - hi, m - lo + length, (hi + 1) * 1000 + lo)
        out.append((core, content, ((m + base) << _SHIFT_AT) | (lo << _SHIFT_LO) | hi))
    if not out:
        return (np.zeros(0, np.int64),) * 3
    core, content, at = (np.concatenate(c) for c in zip(*out))
    return core.view(np.int64), content.view(np.int64), at.astype(np.int64)


def unpack(at: int) -> tuple[int, int, int]:
    """Anchor, smallest and largest distance."""
    return at >> _SHIFT_AT, (at >> _SHIFT_LO) & _MASK, at & _MASK


# ---- deep-shallow sorting -------------------------------------------------------------------------------

def common(a: bytes, b: bytes, start: int = 0) -> int:
    """Length of the common prefix, known to be ``start`` at least."""
    lo, hi = start, min(len(a), len(b))
    if a[lo:hi] == b[lo:hi]:
        return hi
    while hi - lo > 1:
        mid = (lo + hi) // 2
        if a[lo:mid] == b[lo:mid]:
            lo = mid
        else:
            hi = mid
    return lo


def multikey_quicksort(strings: list[bytes], depth: int, order: list[int]) -> Iterator[list[int]]:
    """Ternary quicksort by one byte after another, down to ``depth``.

    Yields the ids in order, in groups that agree on ``depth`` bytes.
    """
    work = [(order, 0)]
    while work:
        ids, d = work.pop()
        if len(ids) == 1 or d == depth:
            yield ids
            continue
        byte = [strings[i][d] if d < len(strings[i]) else -1 for i in ids]
        pivot = sorted((byte[0], byte[len(byte) // 2], byte[-1]))[1]
        less = [i for i, c in zip(ids, byte) if c < pivot]
        same = [i for i, c in zip(ids, byte) if c == pivot]
        more = [i for i, c in zip(ids, byte) if c > pivot]
        for part, at in ((more, d), (same, depth if pivot < 0 else d + 1), (less, d)):
            if part:
                work.append((part, at))


class BlindTrie:
    """Holds strings by the bytes where they part, not by the bytes between.

    To insert, follow the branches blindly to any leaf, compare with that leaf's
    string once, and branch off where they differ.
    """

    def __init__(self, strings: list[bytes], first: int) -> None:
        self.strings, self.root = strings, first              # a node is a leaf's id or [depth, {byte: node}]
        self.same: dict[int, list[int]] = {}                  # equal strings, by the first of them

    def insert(self, i: int, start: int = 0) -> None:
        s, strings = self.strings[i], self.strings
        path, node = [], self.root
        while isinstance(node, list):
            path.append(node)
            d, kids = node
            c = s[d] if d < len(s) else -1
            node = kids[c] if c in kids else next(iter(kids.values()))
        t = strings[node]
        d = common(s, t, start)
        if d == len(s) == len(t):
            self.same.setdefault(node, []).append(i)
            return
        a, b = (s[d] if d < len(s) else -1), (t[d] if d < len(t) else -1)
        while path and path[-1][0] > d:
            path.pop()
        if path and path[-1][0] == d:
            path[-1][1][a] = i
        elif path:
            depth, kids = path[-1]
            key = s[depth] if depth < len(s) else -1
            kids[key] = [d, {b: kids[key], a: i}]
        else:
            self.root = [d, {b: self.root, a: i}]

    def ordered(self) -> list[int]:
        out, work = [], [self.root]
        while work:
            node = work.pop()
            if isinstance(node, list):
                work += [node[1][c] for c in sorted(node[1], reverse=True)]
            else:
                out += [node, *self.same.get(node, ())]
        return out


def deep_shallow_sort(strings: list[bytes], shallow: int = SHALLOW) -> list[int]:
    """The ids of the strings in order (the suffix array of a group)."""
    out: list[int] = []
    for ids in multikey_quicksort(strings, shallow, list(range(len(strings)))):
        if len(ids) > 1:
            trie = BlindTrie(strings, ids[0])
            for i in ids[1:]:
                trie.insert(i)
            ids = trie.ordered()
        out += ids
    return out


def repeated(left: list[bytes], right: list[bytes], length: int) -> list[list[tuple[int, int]]]:
    """For each run, the stretches before and after the anchor that another run shares over ``length`` bytes.

    ``left`` are the reversed bytes before the anchor, ``right`` those from it on.
    Walking the left order's common-prefix tree from its deepest nodes up, the
    sets below a node are merged, the smaller into the larger, in right order; only
    an inserted run and its two neighbours there can gain a longer match.
    """
    n = len(left)
    rank = [0] * n
    for r, i in enumerate(by_right := deep_shallow_sort(right)):
        rank[i] = r
    found: list[list[tuple[int, int]]] = [[] for _ in range(n)]
    order = deep_shallow_sort(left)
    stack: list[tuple[int, list[int]]] = []                   # (depth, ranks below, in order)

    def merge(a: list[int], b: list[int], depth: int) -> list[int]:
        if len(a) < len(b):
            a, b = b, a
        for x in b:
            k = bisect_left(a, x)
            for y in a[max(0, k - 1):k + 1]:
                i, j = by_right[x], by_right[y]
                r = common(right[i], right[j])
                if depth + r >= length:
                    found[i].append((depth, r))
                    found[j].append((depth, r))
            insort(a, x)
        return a

    for p, i in enumerate(order):
        here = [rank[i]]
        depth = common(left[order[p - 1]], left[i]) if p else 0
        while len(stack) > 1 and stack[-1][0] > depth:        # close the nodes deeper than the new branch
            d, ranks = stack.pop()
            low, ranks_below = stack.pop()
            stack.append((low, merge(ranks_below, ranks, d)))
        stack.append((depth if p else 0, here))
    while len(stack) > 1:
        d, ranks = stack.pop()
        low, ranks_below = stack.pop()
        stack.append((low, merge(ranks_below, ranks, d)))
    return found


# ---- Spark ----------------------------------------------------------------------------------------------

def anchored(docs: DataFrame, text: str, doc_id: str, length: int) -> DataFrame:
    """A written table ``(uid, doc_id, n_bytes, sha, text, core, content, at)``: every text with its runs as arrays."""
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ints = pa.list_(pa.int64())
        gram, step = _sizes(length)
        for b in batches:
            texts = [t or b"" for t in b.column(2).to_pylist()]
            found = [runs(t, length, gram, step) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array([len(t) for t in texts], pa.int64()),
                 pa.array([hashlib.sha256(t).hexdigest() for t in texts], pa.string()), pa.array(texts, pa.binary()),
                 *(pa.array([f[i] for f in found], ints) for i in range(3))],
                ["uid", "doc_id", "n_bytes", "sha", "text", "core", "content", "at"])

    src = docs.select(F.monotonically_increasing_id().alias("uid"), F.col(doc_id).alias("doc_id"),
                      F.col(text).cast("binary").alias("text"))
    return materialise(map_arrow(
        src, run, f"uid bigint, doc_id {kind}, n_bytes bigint, sha string, text binary, core array<bigint>, "
                  "content array<bigint>, at array<bigint>"), "op9-texts", compression="zstd")


def _sizes(length: int) -> tuple[int, int]:
    """Gram and run for a window length: 16 and 193 at 400."""
    return (GRAM, RUN) if length == LENGTH else (max(2, length // 25), max(2, length // 2))


def _slot(uid: np.ndarray) -> np.ndarray:
    return (_mix(uid.astype(np.uint64)) % np.uint64(FILTER_BITS)).astype(np.int64)


def wanted_texts(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """``(uid, text)`` of at least the documents in ``wanted(uid)``: most others are left out before the shuffle."""
    def slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = np.unique(_slot(b.column(0).to_numpy()))
            yield pa.RecordBatch.from_arrays([pa.array(s >> 6), pa.array(np.left_shift(np.int64(1), s & 63))], ["w", "b"])

    words = map_arrow(wanted.select("uid"), slots, "w bigint, b bigint").groupBy("w").agg(F.bit_or("b").alias("b")).collect()
    bits = np.zeros(FILTER_BITS >> 6, np.int64)               # at most this many rows: 2 MB
    for r in words:
        bits[r["w"]] = r["b"]
    shared = texts.sparkSession.sparkContext.broadcast(bits)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = _slot(b.column(0).to_numpy())
            yield b.filter(pa.array((shared.value[s >> 6] >> (s & 63)) & 1 == 1))

    return map_arrow(texts.select("uid", "text"), keep, "uid bigint, text binary")


def _settle_groups(snippets: DataFrame, length: int) -> DataFrame:
    """``(uid, lo, hi)``: removed stretches of runs that share windows with other runs of their core.

    A group holds at most ``MAX_GROUP`` runs of under two windows' bytes each.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for b in batches for r in zip(*(b.column(i).to_pylist() for i in range(5))))
        out: list[tuple[int, int, int]] = []
        for _, group in groupby(rows, key=lambda r: r[0]):
            group = list(group)
            left, right, single = [], [], []
            for _, n, uid, at, text in group:
                m, _, hi = unpack(at)
                left.append(text[:hi][::-1])
                right.append(text[hi:])
                single.append((uid, m) if n == 1 else None)
            for who, found in zip(single, repeated(left, right, length)):
                if who:
                    out += [(who[0], who[1] - a, who[1] + r) for a, r in set(found)]
            if len(out) > 1000:
                yield _stretches(out)
                out = []
        if out:
            yield _stretches(out)

    dealt = snippets.select("core", "n", "uid", "at", "snippet").repartition("core").sortWithinPartitions("core")
    return map_arrow(dealt, run, "uid bigint, lo bigint, hi bigint")


def _stretches(rows: list[tuple[int, int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], ["uid", "lo", "hi"])


def _settle_windows(snippets: DataFrame, length: int) -> DataFrame:
    """The same for cores with too many different runs: every window is counted by a 128-bit hash."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for n, uid, at, text in zip(*(b.column(i).to_pylist() for i in range(4))):
                m, lo, hi = unpack(at)
                o = np.arange(lo, hi + 1)
                digests = [hashlib.blake2b(text[hi - x:hi - x + length], digest_size=16, salt=b"%d" % x).digest()
                           for x in o.tolist()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(o), n)), pa.array(np.full(len(o), uid)), pa.array(m - o), pa.array(digests, pa.binary())],
                    ["n", "uid", "lo", "w"])

    every = materialise(map_arrow(snippets.select("n", "uid", "at", "snippet"), run,
                                  "n bigint, uid bigint, lo bigint, w binary"), "op9-windows")
    twice = every.groupBy("w").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
    return attach(every.where("n = 1"), twice, ["w"], "c").select("uid", "lo", (F.col("lo") + length).alias("hi"))


def repeated_stretches(texts: DataFrame, length: int) -> DataFrame:
    """``(uid, lo, hi)``: stretches that together cover exactly the bytes to remove."""
    each = texts.select("uid", F.explode(F.arrays_zip("core", "content", "at")).alias("r")).select(
        "uid", "r.core", "r.content", "r.at")
    cores = each.groupBy("core").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
    shared = materialise(attach(each, cores, ["core"], "c"), "op9-shared")
    kinds = materialise(shared.groupBy("core", "content").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct("uid", "at")).alias("one")), "op9-kinds")
    whole = attach(shared, kinds.where("n > 1").select("core", "content", "n"), ["core", "content"], "n")
    m, lo, hi = F.shiftright("at", _SHIFT_AT), F.shiftright("at", _SHIFT_LO).bitwiseAND(_MASK), F.col("at").bitwiseAND(_MASK)
    out = whole.select("uid", (m - hi).alias("lo"), (m - lo + length).alias("hi"))

    # cores of several kinds: one run of each kind is fetched and sorted
    mixed = kinds.groupBy("core").agg(F.count(F.lit(1)).alias("g"), F.min("n").alias("least")) \
        .where("g > 1 AND least = 1").select("core", "g", F.col("g").alias("members"))
    asked = materialise(attach(kinds, mixed, ["core"], "members").select("core", "g", "n", "one.uid", "one.at"), "op9-asked")
    by_doc = asked.groupBy("uid").agg(F.collect_list(F.struct("core", "g", "n", "at")).alias("asked"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for uid, text, want in zip(*(b.column(i).to_pylist() for i in range(3))):
                for i in range(0, len(want), 2000):
                    part = want[i:i + 2000]
                    at = [unpack(w["at"]) for w in part]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([w["core"] for w in part], pa.int64()), pa.array([w["g"] for w in part], pa.int64()),
                         pa.array([w["n"] for w in part], pa.int64()), pa.array([uid] * len(part), pa.int64()),
                         pa.array([w["at"] for w in part], pa.int64()),
                         pa.array([text[m - hi:m - lo + length] for m, lo, hi in at], pa.binary())],
                        ["core", "g", "n", "uid", "at", "snippet"])

    fetched = wanted_texts(texts, asked).join(by_doc, "uid").select("uid", "text", "asked")
    snippets = materialise(map_arrow(fetched, cut, "core bigint, g bigint, n bigint, uid bigint, at bigint, snippet binary"),
                           "op9-snippets", compression="zstd")
    out = out.unionByName(_settle_groups(snippets.where(F.col("g") <= MAX_GROUP), length))
    if not snippets.where(F.col("g") > MAX_GROUP).isEmpty():
        out = out.unionByName(_settle_windows(snippets.where(F.col("g") > MAX_GROUP), length))
    return out


def joined(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The union of stretches as maximal runs, in order."""
    out: list[list[int]] = []
    for lo, hi in sorted(spans):
        if out and lo <= out[-1][1]:
            out[-1][1] = max(out[-1][1], hi)
        else:
            out.append([lo, hi])
    return [(a, b) for a, b in out]


def remove_repeats(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", length: int = LENGTH) -> DataFrame:
    """``(uid, doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept)``: one row per input row.

    A byte goes if a string of ``length`` bytes that covers it also starts anywhere
    else in the input, the same text and overlaps included; all occurrences go.
    Texts are UTF-8 bytes, null is empty, shorter texts stay whole; equal rows are
    copies of each other; an empty table gives an empty result.  ``kept`` is the
    remaining bytes where something was removed, else null (the text stays whole).
    Only the two named columns are read.
    """
    texts = anchored(docs, text, doc_id, length)
    spans = materialise(repeated_stretches(texts, length), "op9-spans")
    by_doc = spans.groupBy("uid").agg(F.collect_set(F.struct("lo", "hi")).alias("spans"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for uid, raw, spans in zip(*(b.column(i).to_pylist() for i in range(3))):
                gone = joined([(s["lo"], s["hi"]) for s in spans])
                edges = [0, *(x for s in gone for x in s), len(raw)]
                kept = b"".join(raw[i:j] for i, j in zip(edges[::2], edges[1::2]))
                out.append((uid, len(raw) - len(kept), len(gone), hashlib.sha256(kept).hexdigest(), kept))
            cols = list(zip(*out)) or [()] * 5
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()))],
                ["uid", "n_removed", "n_spans", "kept_sha256", "kept"])

    fetched = wanted_texts(texts, spans).join(by_doc, "uid").select("uid", "text", "spans")
    changed = map_arrow(fetched, cut, "uid bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept binary")
    return texts.select("uid", "doc_id", "n_bytes", "sha").join(changed, "uid", "left").select(
        "uid", "doc_id", "n_bytes", F.coalesce("n_removed", F.lit(0).cast("bigint")).alias("n_removed"),
        F.coalesce("n_spans", F.lit(0).cast("bigint")).alias("n_spans"),
        F.coalesce("kept_sha256", "sha").alias("kept_sha256"), "kept")


def op9_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    return remove_repeats(documents(spark, sf_dir)).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
