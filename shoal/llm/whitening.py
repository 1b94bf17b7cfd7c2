"""PCA whitening of integer vectors whose scatter is counted bit by bit.

A dimension's numbers, less their least, are cut into bit planes; a plane's bits
across the rows are packed into 64-bit words.  The sum of products of two
dimensions is the sum, over their pairs of planes, of the AND's popcount times
both planes' weights: exact integers that add up over tasks in any order.  They
are centred as integers (n * sum(ab) - sum(a) * sum(b)) before anything becomes
floating point, so no digits are lost however far the values are from zero.
Only that matrix, one number for each pair of dimensions, reaches the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoal.llm.common import map_arrow, prepare, table

#: Components returned at most.
COMPONENTS = 32
#: An entry c becomes floor(SCALE * c) + OFFSET.
SCALE, OFFSET = 64, 1_000_000
#: Rows packed at once, and the most bytes of their numbers.
ROWS_AT_ONCE, BYTES_AT_ONCE = 1 << 14, 1 << 25
#: Numbers of more bits are counted in parts of so many, whose products stay exact in 64 bits.
LIMB = 16
#: floor(SCALE * c) is held within this, so that numbers and their differences fit 64 bits.
FAR = 1 << 61
#: Components whose variance is below this share of the largest can't be whitened and are left out.
FLAT = 1e-12


def as_integers(entries: np.ndarray) -> np.ndarray:
    """floor(SCALE * c) + OFFSET as int64, the floor held within ``FAR``."""
    return np.clip(np.floor(entries.astype(np.float64) * SCALE), -FAR, FAR).astype(np.int64) + OFFSET


def usable(column: pa.Array, width: int | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """``(row numbers, matrix)`` of the vectors of each length (or of ``width``) without null or non-finite entries."""
    sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    flat = column.flatten()                                  # null lists have no entries there
    entries = pc.fill_null(flat.cast(pa.float64()), float("nan")).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes)
    for w in [width] if width else np.unique(sizes).tolist():
        rows = np.flatnonzero(sizes == w)
        if w and len(rows):
            m = entries[(ends[rows] - w)[:, None] + np.arange(w)]
            good = np.isfinite(m).all(1)
            if good.any():
                yield rows[good], m[good]


def planes(u: np.ndarray, bits: list[int]) -> np.ndarray:
    """Bit planes of the columns of ``u`` (uint64), ``bits[d]`` of column d, each packed into 64-bit words across the rows."""
    rows = -(-len(u) // 64) * 64
    out = np.zeros((sum(bits), rows // 64), np.uint64)
    k = 0
    for d, many in enumerate(bits):
        for p in range(many):
            bit = np.zeros(rows, np.uint8)
            bit[:len(u)] = (u[:, d] >> np.uint64(p)) & np.uint64(1)
            out[k] = np.packbits(bit, bitorder="little").view(np.uint64)
            k += 1
    return out


def scatter(u: np.ndarray, bits: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Sums and sums of products of the parts of the columns of ``u``: a part is ``LIMB`` bits of a column, low ones first."""
    words = planes(u, bits)
    part = [(d, p // LIMB) for d, many in enumerate(bits) for p in range(many)]
    firsts = [k for k in range(len(part)) if not k or part[k] != part[k - 1]]
    weight = np.array([1 << (p % LIMB) for many in bits for p in range(many)], np.int64)
    total = np.add.reduceat(weight * np.bitwise_count(words).sum(1, dtype=np.int64), firsts)
    cross = np.zeros((len(firsts), len(firsts)), np.int64)
    home = np.searchsorted(firsts, np.arange(len(part)), "right") - 1
    for k in range(len(part)):
        of = firsts[home[k]]                                  # parts from this plane's own on: the matrix is symmetric
        both = np.bitwise_count(words[k] & words[of:]).sum(1, dtype=np.int64) * weight[of:]
        cross[home[k], home[k]:] += weight[k] * np.add.reduceat(both, np.array(firsts[home[k]:]) - of)
    return total, cross


@dataclass
class Fit:
    """The whitening: ``n`` rows, the least number and the sum of each dimension, and the components with their variances."""

    width: int
    n: int
    low: list[int]
    span: int                   # the largest difference of two numbers of a dimension
    sums: list[int]             # of x
    values: np.ndarray          # falling
    vectors: np.ndarray         # width x components
    trace: float


def _ranges(vectors: DataFrame) -> tuple[int, int, list[int], list[int]]:
    """Width, rows, least and greatest number by dimension, for the most frequent length of vector (of equals, the longest)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, list] = {}
        for b in batches:
            for rows, m in usable(b.column(0)):
                x = as_integers(m)
                old = seen.get(m.shape[1])
                low, high = x.min(0), x.max(0)
                seen[m.shape[1]] = [len(rows), low, high] if old is None else [
                    old[0] + len(rows), np.minimum(old[1], low), np.maximum(old[2], high)]
        for w, (n, low, high) in seen.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(w, w)), pa.array(np.arange(w)), pa.array(np.full(w, n)),
                                              pa.array(low), pa.array(high)], ["width", "d", "n", "low", "high"])

    found = map_arrow(vectors, run, "width bigint, d bigint, n bigint, low bigint, high bigint") \
        .groupBy("width", "d").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"))
    of = F.sort_array(F.collect_list(F.struct("d", "low", "high")))               # one entry for each dimension
    most = found.groupBy("width").agg(F.max("n").alias("n"), of.alias("of")).orderBy(F.desc("n"), F.desc("width")).first()
    if most is None:
        return 0, 0, [], []
    return most["width"], most["n"], [r["low"] for r in most["of"]], [r["high"] for r in most["of"]]


def _counted(vectors: DataFrame, width: int, low: list[int], bits: list[int]) -> tuple[list[int], list[list[int]]]:
    """Exact sums and sums of products of the numbers less ``low``, by dimension."""
    at_once = max(64, min(ROWS_AT_ONCE, BYTES_AT_ONCE // (8 * width)))
    least = np.array(low, np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        total, many = None, 0

        def add():
            nonlocal total, many, held
            s, c = scatter(np.concatenate(held), bits)
            parts = np.concatenate([s, c[np.triu_indices(len(s))]]).astype(object)
            total, many, held = parts if total is None else total + parts, 0, []

        for b in batches:
            for _, m in usable(b.column(0), width):
                held.append((as_integers(m) - least).view(np.uint64))
                many += len(m)
            if many >= at_once:
                add()
        if many:
            add()
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array([str(v) for v in total])], ["i", "v"])

    found = map_arrow(vectors, run, "i bigint, v string").groupBy("i").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("v"))
    got = {r["i"]: int(r["v"]) for r in found.collect()}      # one number for each pair of dimensions
    weight = [(d, 1 << (LIMB * p)) for d, many in enumerate(bits) for p in range(-(-many // LIMB))]
    sums, cross = [0] * width, [[0] * width for _ in range(width)]
    for k, (d, w) in enumerate(weight):
        sums[d] += w * got[k]
    pairs = zip(*(x.tolist() for x in np.triu_indices(len(weight))))
    for k, (i, j) in enumerate(pairs, len(weight)):
        (a, v), (b, w) = weight[i], weight[j]
        value = v * w * got[k] * (2 if a == b and i != j else 1)
        cross[a][b] += value
        if a != b:
            cross[b][a] += value
    return sums, cross


def fit(vectors: DataFrame, vector: str = "embedding", components: int = COMPONENTS) -> Fit | None:
    """The whitening of the usable vectors (see :func:`whiten`); None if there is none."""
    prepare(vectors.sparkSession)
    src = vectors.select(F.col(vector).cast("array<double>").alias("v"))
    width, n, low, high = _ranges(src)
    if not n:
        return None
    bits = [max(1, (h - m).bit_length()) for m, h in zip(low, high)]
    sums, cross = _counted(src, width, low, bits)
    square = n * n
    v = np.array([[(n * cross[a][b] - sums[a] * sums[b]) / square for b in range(width)] for a in range(width)])
    values, axes = np.linalg.eigh(v)
    order = np.argsort(values)[::-1][:components]
    order = order[values[order] > FLAT * max(values[order[0]], 0)]
    return Fit(width, n, low, max(h - m for m, h in zip(low, high)), [s + n * m for s, m in zip(sums, low)], values[order], axes[:, order], float(np.trace(v)))


def _centred(m: np.ndarray, f: Fit) -> tuple[np.ndarray, np.ndarray | None]:
    """``n * x - S`` as floating point, and as int64 where all of it fits."""
    u = as_integers(m) - np.array(f.low, np.int64)
    s = [a - f.n * b for a, b in zip(f.sums, f.low)]
    if f.n * (f.span + 1) < 1 << 62:
        exact = f.n * u - np.array(s, np.int64)
        return exact.astype(np.float64), exact
    exact = f.n * u.view(np.uint64).astype(object) - np.array(s, object)
    return exact.astype(np.float64), exact


def _deviations(exact: np.ndarray) -> list[int | None]:
    """The sum of squares of each row, exact; null where it doesn't fit a long."""
    if exact.dtype != object:
        most = int(np.abs(exact).max(initial=0))
        if most * most * exact.shape[1] < 1 << 63:
            return (exact * exact).sum(1).tolist()
    totals = [sum(int(v) ** 2 for v in row) for row in exact]
    return [t if t < 1 << 63 else None for t in totals]


def project(vectors: DataFrame, f: Fit, vector: str = "embedding", keep: tuple[str, ...] = ("vec_id",)) -> DataFrame:
    """Each usable vector with the columns in ``keep``, ``deviation`` and ``whitened``, an array of one number for each component."""
    prepare(vectors.sparkSession)
    shared = vectors.sparkSession.sparkContext.broadcast(f)    # the square of the vectors' length

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = shared.value
        out = f.vectors / (np.sqrt(f.values) * f.n)
        for b in batches:
            for rows, m in usable(b.column(0), f.width):
                real, exact = _centred(m, f)
                w = real @ out
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, w.size + 1, max(1, w.shape[1]), dtype=np.int32)[:len(w) + 1]
                                                          if w.size else np.zeros(len(w) + 1, np.int32)), pa.array(w.ravel()))
                taken = b.take(pa.array(rows))
                yield pa.RecordBatch.from_arrays([*taken.columns[1:], pa.array(_deviations(exact), pa.int64()), lists],
                                                 [*b.schema.names[1:], "deviation", "whitened"])

    src = vectors.select(F.col(vector).cast("array<double>").alias("_v"), *(F.col(c).alias(f"_k{i}") for i, c in enumerate(keep)))
    kinds = ", ".join(f"_k{i} {vectors.schema[c].dataType.simpleString()}" for i, c in enumerate(keep))
    got = map_arrow(src, run, f"{kinds}{', ' if kinds else ''}deviation bigint, whitened array<double>")
    return got.toDF(*keep, "deviation", "whitened")


def identity_error(projected: DataFrame, f: Fit) -> float:
    """The largest absolute entry of the whitened rows' covariance minus the identity."""
    k = len(f.values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(k * k + k)
        for b in batches:
            w = b.column(0).flatten().to_numpy().reshape(-1, k)
            total += np.concatenate([w.sum(0), (w.T @ w).ravel()])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], ["i", "v"])

    got = map_arrow(projected.select("whitened"), run, "i bigint, v double").groupBy("i").agg(F.sum("v").alias("v")).collect()
    total = np.zeros(k * k + k)
    for r in got:                                              # one number for each pair of components
        total[r["i"]] = r["v"] / f.n
    mean, second = total[:k], total[k:].reshape(k, k)
    return float(np.abs(second - np.outer(mean, mean) - np.eye(k)).max())


def whiten(vectors: DataFrame, vector: str = "embedding", keep: tuple[str, ...] = ("vec_id",),
           components: int = COMPONENTS) -> tuple[DataFrame, Fit | None]:
    """The whitened vectors (see :func:`project`) and the fit.

    Every entry becomes floor(SCALE * c) + OFFSET; components are unit eigenvectors
    of those numbers' covariance (divisor n) by falling variance.  Null vectors,
    empty ones and ones with a null or non-finite entry are dropped, and so are
    vectors of another length than the most frequent one (of equally frequent ones
    the longest).  Entries beyond 2**61 / SCALE count as that.  Components whose
    variance is below ``FLAT`` of the largest have no whitened value and are left
    out; if all vectors are equal, none is left and the arrays are empty.  A deviation that doesn't
    fit a long is null.  Repeated rows count as often as they occur; null ids stay null;
    without usable vectors the result is empty and the fit None.  Other columns aren't read.
    """
    f = fit(vectors, vector, components)
    if f is None:
        shape = ", ".join([*(f"`{c}` {vectors.schema[c].dataType.simpleString()}" for c in keep), "deviation bigint, whitened array<double>"])
        return vectors.sparkSession.createDataFrame([], shape), None
    return project(vectors, f, vector, keep), f


def components_of(vectors: DataFrame, vector: str = "embedding", vec_id: str = "vec_id", components: int = COMPONENTS) -> DataFrame:
    """One row for each usable vector and component: id, component from 1, n, deviation, whitened, explained, identity_error."""
    rows, f = whiten(vectors, vector, (vec_id,), components)
    share = [float(v) / f.trace for v in f.values] if f is not None else []
    error = identity_error(rows, f) if share else 0.0
    explained = F.element_at(F.array(*map(F.lit, share)) if share else F.array(F.lit(0.0)), F.col("at") + 1)
    return rows.select(F.col(vec_id).alias("vec_id"), "deviation", F.posexplode("whitened").alias("at", "whitened")).select(
        "vec_id", (F.col("at") + 1).alias("component"), F.lit(f.n if f else 0).cast("bigint").alias("n"), "deviation",
        "whitened", explained.alias("explained"), F.lit(error).alias("identity_error"))


def op13_whitening(spark, sf_dir: str) -> DataFrame:
    return components_of(table(spark, sf_dir, "embeddings"))
