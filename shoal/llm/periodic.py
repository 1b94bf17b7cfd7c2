"""Periodic runs of words, found online on the diagonals of a text compared with itself.

The diagonal of lag q holds, for each word, whether it equals the word q places
before.  A stretch of period q with at least ``REPEATS`` periods has 3 q such
words in a row, so only few diagonals ever matter: lags from B to 2 B - 1 (B a
power of two) are followed at the blocks of B words that begin at multiples of
B.  A block's earlier occurrences at those lags add B to the match lengths of
the lags that were active at the block before; a lag without a match ends there
and, if long enough, gives its run at once, its ends measured word by word.
Blocks are named by equality (a pair of names is a name of the next level), so
nothing rests on a hash, and a block without a second occurrence drops out of
all further levels.  A block has at most B matches at its level, so a text of n
words takes n log n steps at most; blocks whose earlier occurrences all lie in one
run of a smaller period are passed over, as their lags are no smallest periods.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shoal.llm.common import documents, map_arrow

#: A run is at least so many words long and holds at least so many periods (3 whole blocks need 4 of them).
MIN_LENGTH, REPEATS = 6, 4

Run = tuple[int, int, int]


def _within(block: np.ndarray, size: int, runs: list[Run]) -> np.ndarray:
    """Whether one of ``runs`` holds all that a block is compared with, and the block."""
    if not runs:
        return np.zeros(len(block), bool)
    start, end = np.array(sorted((s, s + m) for s, m, _ in runs)).T
    at = np.searchsorted(start, block - 2 * size + 1, "right") - 1
    return (at >= 0) & (np.maximum.accumulate(end)[at] >= block + size)


def _matches(at: np.ndarray, name: np.ndarray, size: int, n: int, runs: list[Run]) -> Iterator[tuple[int, list[int]]]:
    """The blocks at multiples of ``size`` with earlier occurrences ``size`` to ``2 * size - 1`` words before, and those lags.

    Inside one of ``runs``, whose periods are smaller, a block matches at multiples
    of that period only, and on them just as far as the run goes: nothing to find.
    """
    order = np.argsort(name, kind="stable")
    keys = name[order] * (n + 1) + at[order]
    home = at % size == 0
    home[home] = ~_within(at[home], size, runs)
    block, base = at[home], name[home] * (n + 1)
    first = np.searchsorted(keys, base + np.maximum(block - 2 * size + 1, 0))
    number = np.searchsorted(keys, base + block - size, "right") - first
    some = (number > 0) & (block >= size)
    block, first, number = block[some], first[some], number[some]
    if not len(block):
        return
    ends = np.cumsum(number)
    earlier = at[order[np.arange(ends[-1]) - np.repeat(ends - number - first, number)]]
    lags = np.repeat(block, number) - earlier
    for i, a, b in zip(block.tolist(), (ends - number).tolist(), ends.tolist()):
        yield i, lags[a:b].tolist()


def _run(ids: np.ndarray, lag: int, start: int, stop: int, size: int) -> Run | None:
    """The run whose whole blocks on the diagonal ``lag`` are ``start`` to ``stop``, if it is long enough and ``lag`` its smallest period."""
    if stop - start + 2 * (size - 1) < max(MIN_LENGTH - lag, (REPEATS - 1) * lag):
        return None
    low = max(lag, start - size + 1)
    odd = np.flatnonzero(ids[low:start] != ids[low - lag:start - lag])
    start = low + int(odd[-1]) + 1 if len(odd) else low
    high = min(len(ids), stop + size - 1)
    odd = np.flatnonzero(ids[stop:high] != ids[stop - lag:high - lag])
    stop = stop + int(odd[0]) if len(odd) else high
    first = start - lag
    if stop - first < max(MIN_LENGTH, REPEATS * lag):
        return None
    # a smaller period of so long a stretch divides the lag
    for p in _primes(lag):
        d = lag // p
        if np.array_equal(ids[first:first + lag - d], ids[first + d:first + lag]):
            return None
    return first, stop - first, lag


def _primes(n: int) -> list[int]:
    out, p = [], 2
    while p * p <= n:
        if n % p == 0:
            out.append(p)
            while n % p == 0:
                n //= p
        p += 1
    return [*out, n] if n > 1 else out


def _level(ids: np.ndarray, at: np.ndarray, name: np.ndarray, size: int, runs: list[Run]) -> Iterator[Run]:
    """Runs with periods from ``size`` to ``2 * size - 1``; ``runs`` are those with smaller ones."""
    active: dict[int, int] = {}
    last = 0

    def ended(lags: dict[int, int]) -> Iterator[Run]:
        for lag, start in lags.items():
            if found := _run(ids, lag, start, last + size, size):
                yield found

    for block, lags in _matches(at, name, size, len(ids), runs):
        if block != last + size:
            yield from ended(active)
            active = {}
        now = {lag: active.pop(lag, block) for lag in lags}
        yield from ended(active)
        active, last = now, block
    yield from ended(active)


def _repeats(ids: np.ndarray) -> bool:
    """Whether any four words in a row occur twice, as they do in every run (numbers over 2**15 aren't looked at)."""
    if ids.max() >> 15:
        return True
    pair = ids[:-1] << 15 | ids[1:]
    four = np.sort(pair[:-2] << 30 | pair[2:])
    return bool((four[1:] == four[:-1]).any())


def runs_of(ids: np.ndarray) -> list[Run]:
    """``(start, length, period)`` of every run of a sequence of word numbers, by start, then period."""
    n, found = len(ids), []
    if n < MIN_LENGTH or not _repeats(ids):
        return found
    at = np.flatnonzero(np.bincount(ids)[ids] > 1)
    name, size = ids[at], 1
    while len(at) and REPEATS * size <= n:
        found += list(_level(ids, at, name, size, found))
        after = np.searchsorted(at, at + size)
        ok = after < len(at)
        ok[ok] = at[after[ok]] == at[ok] + size
        pair = name[ok] * (n + 1) + name[after[ok]]
        _, inverse, number = np.unique(pair, return_inverse=True, return_counts=True)
        again = number[inverse] > 1
        at, name = at[ok][again], inverse[again]
        size *= 2
    return sorted(found, key=lambda r: (r[0], r[2]))


def split_words(doc_id, text: bytes | None) -> list[bytes]:
    """Words: runs without U+0020 and U+0009 to U+000D."""
    return (text or b"").split()


def collapse(words: list[bytes], runs: list[Run]) -> list[bytes]:
    """The words that no run holds after its first period."""
    if not runs:
        return words
    depth = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        depth[start + period] += 1
        depth[start + length] -= 1
    return [words[i] for i in np.flatnonzero(np.cumsum(depth[:-1]) == 0).tolist()]


def numbers(words: list[bytes]) -> np.ndarray:
    """Equal words have equal numbers, from 0 in the order of their first occurrence."""
    seen: dict[bytes, int] = {}
    return np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words))


def periodic_runs(docs: DataFrame, text: str = "text", doc_id: str = "doc_id",
                  words_of: Callable[[object, bytes | None], list[bytes]] = split_words) -> DataFrame:
    """One row per input row: ``doc_id, n_words, runs`` (start, length, period of each, by start, then period) and ``collapsed``.

    A run is a stretch of consecutive words with smallest period q and a length of
    at least ``MIN_LENGTH`` and ``REPEATS * q`` that no neighbouring word extends
    keeping period q.  ``collapsed`` has the words that no run holds after its
    first q words, joined by one space.  Null texts count as empty: no words, no
    runs, an empty ``collapsed``.  Runs may overlap; all are listed.  A text is read
    whole, in one task.  Repeated rows and null ids are rows like others; an empty
    table gives an empty result.  Only the two named columns are read.
    """
    kind = docs.schema[doc_id].dataType.simpleString()
    shape = pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, every, kept = [], [], []
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                words = words_of(i, t)
                found = runs_of(numbers(words))
                n.append(len(words))
                every.append([{"start": s, "length": m, "period": q} for s, m, q in found])
                kept.append(b" ".join(collapse(words, found)))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(n, pa.int64()), pa.array(every, shape), pa.array(kept, pa.binary()).cast(pa.string())],
                ["doc_id", "n_words", "runs", "collapsed"])

    src = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("binary").alias("text"))
    return map_arrow(src, run, f"doc_id {kind}, n_words bigint, "
                     "runs array<struct<start: bigint, length: bigint, period: bigint>>, collapsed string")


def repeated_tail(doc_id, text: bytes | None) -> list[bytes]:
    """The words of the contract: a tenth of the documents, by crc32 of the id, repeat a stretch up to their end.

    A null id counts as the empty string.
    """
    import zlib

    words = split_words(doc_id, text)
    n, h = len(words), zlib.crc32(b"" if doc_id is None else str(doc_id).encode())
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + i % p] for i in range(n - a)]


def _best(runs: Column) -> Column:
    """The run with the greatest exact length / period, the first of equals; null without runs."""
    more = lambda a, r: a.isNull() | (r["length"] * a["period"] > a["length"] * r["period"])
    none = F.lit(None).cast("struct<start: bigint, length: bigint, period: bigint>")
    return F.aggregate(runs, none, lambda a, r: F.when(more(a, r), r).otherwise(a))


def op11_periodic_runs(spark, sf_dir: str) -> DataFrame:
    found = periodic_runs(documents(spark, sf_dir), words_of=repeated_tail)
    line = F.transform("runs", lambda r: F.concat(F.concat_ws(",", *(r[c].cast("string") for c in ("start", "length", "period"))), F.lit("\n")))
    return found.withColumn("best", _best(F.col("runs"))).select(
        "doc_id", F.size("runs").cast("bigint").alias("n_runs"), "best.start", "best.length", "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(line, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
