"""Whitening of embeddings from an exact integer scatter.

Entries become integers, a shift is subtracted, and sums and cross-products are added up without
rounding: blocks by matrix products of limbs short enough that doubles hold them exactly, tasks as integers of any
length, tasks' totals as limbs of 30 bits that Spark adds as longs. n * X'X - S * S' is formed in integers and only then becomes
floating point, for one decomposition of a matrix whose size is that of the vectors, not of the table.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from fathom.llm._common import stage, table

TOP = 8
SCALE, SHIFT = 1024, 100_000
#: Integers stop at this size, so that the shift can be subtracted in 64 bits.
LARGEST = 1 << 62
#: Rows and bits of one exact block product: 2 * 20 + 12 bits fit into a double's 53.
BLOCK, LIMB = 4096, 20
#: Spark adds totals in limbs of 30 bits; seven hold squares of 63 bits over 2 ** 64 rows.
WIDE, LIMBS = 30, 7


def integers(batch: pa.RecordBatch, column: str) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """By length of the vectors: the positions of the usable rows in the batch, and floor(SCALE * entry) + SHIFT, less SHIFT, as longs."""
    lists = batch.column(column)
    values = lists.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)  # nulls become NaN
    size = np.asarray(lists.value_lengths().fill_null(0)).astype(np.int64)
    start = np.cumsum(size) - size
    for d in np.unique(size[size > 0]):
        at = np.flatnonzero(size == d)
        x = values[start[at][:, None] + np.arange(d)]
        fine = np.isfinite(x).all(axis=1)
        with np.errstate(over="ignore"):
            whole = np.clip(np.floor(x[fine] * SCALE), -float(LARGEST), float(LARGEST))
        if fine.any():
            yield at[fine], np.clip(whole.astype(np.int64), SHIFT - LARGEST, LARGEST - SHIFT)


def scatter(v: np.ndarray) -> np.ndarray:
    """v'v of a block of longs, exactly: as longs where one limb holds each entry, else as Python integers."""
    if int(np.abs(v).max(initial=0)) < 1 << LIMB:
        x = v.astype(np.float64)
        return (x.T @ x).astype(np.int64)
    parts = [(v >> (LIMB * k) & ((1 << LIMB) - 1) if k < 3 else v >> (LIMB * k)).astype(np.float64) for k in range(4)]
    total = np.zeros((v.shape[1], v.shape[1]), object)
    for k, a in enumerate(parts):
        for m, b in enumerate(parts):
            total += (a.T @ b).astype(np.int64).astype(object) << LIMB * (k + m)
    return total


def limbs_of(total: int) -> list[int]:
    """total as sum of limb k times 2 ** (WIDE * k); the last limb has the sign."""
    out = []
    for _ in range(LIMBS - 1):
        out.append(total & ((1 << WIDE) - 1))
        total >>= WIDE
    return [*out, total]


class _Totals:
    """n, sums and cross-products of vectors of one length; longs are emptied into Python integers before they could overflow."""

    def __init__(self, d: int) -> None:
        self.n, self.blocks = 0, 0
        self.sums, self.products = np.zeros(d, object), np.zeros((d, d), object)
        self.near = np.zeros((d, d), np.int64)

    def add(self, v: np.ndarray) -> None:
        self.n += len(v)
        for k in range(0, len(v), BLOCK):
            block = v[k : k + BLOCK]
            got = scatter(block)
            if got.dtype == object:
                self.products += got
                self.sums += block.astype(object).sum(axis=0)
                continue
            self.near += got  # below 2 ** 52 each
            self.sums += block.sum(axis=0).astype(object)
            self.blocks += 1
            if self.blocks == 1024:
                self.flush()

    def flush(self) -> None:
        self.products += self.near.astype(object)
        self.near[:], self.blocks = 0, 0


def _scatter_rows(column: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_length: dict[int, _Totals] = {}
        for batch in batches:
            for _, v in integers(batch, column):
                by_length.setdefault(v.shape[1], _Totals(v.shape[1])).add(v)
        for d, total in by_length.items():
            total.flush()
            upper = [(i, j, total.products[i, j]) for i in range(d) for j in range(i, d)]
            rows = [(-1, -1, total.n), *((i, -1, s) for i, s in enumerate(total.sums)), *upper]
            cut = list(zip(*(limbs_of(int(x)) for _, _, x in rows)))
            names = ["d", "i", "j", *(f"l{k}" for k in range(LIMBS))]
            cols = [pa.array([d] * len(rows), pa.int32()), pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int32()), *(pa.array(c, pa.int64()) for c in cut)]
            yield pa.RecordBatch.from_arrays(cols, names=names)

    return run


def fit(rows: DataFrame, vec: str = "embedding") -> tuple[int, list[int], np.ndarray]:
    """n, the sums of the shifted integers, and n * X'X - S * S' as Python integers, of all usable vectors.

    Of vectors of several lengths those of the most frequent one are fitted, the longer of two as frequent. Only the statistics reach the
    driver: about d * d / 2 numbers for vectors of d entries, whatever the number of rows. n is 0 if no vector is usable.
    """
    limbs = ", ".join(f"l{k} long" for k in range(LIMBS))
    parts = rows.select(vec).mapInArrow(_scatter_rows(vec), f"d int, i int, j int, {limbs}")
    parts = stage(parts.groupBy("d", "i", "j").agg(*(F.sum(f"l{k}").alias(f"l{k}") for k in range(LIMBS))), "scatter")
    whole = lambda r: sum(r[f"l{k}"] << WIDE * k for k in range(LIMBS))
    most = parts.filter("i = -1").orderBy(*(F.desc(f"l{k}") for k in reversed(range(LIMBS - 1))), F.desc("d")).first()
    if most is None:
        return 0, [], np.zeros((0, 0), object)
    d, n = most["d"], whole(most)
    sums, products = [0] * d, np.zeros((d, d), object)
    for r in parts.filter((F.col("d") == d) & (F.col("i") >= 0)).collect():
        if r["j"] < 0:
            sums[r["i"]] = whole(r)
        else:
            products[r["i"], r["j"]] = products[r["j"], r["i"]] = whole(r)
    s = np.array(sums, object)
    return n, sums, n * products - np.outer(s, s)


def components(n: int, m: np.ndarray, top: int = TOP) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Unit eigenvectors of m / n ** 2 as columns, their eigenvalues, falling, and each one's share of the trace.

    An eigenvalue within rounding of 0 is 0: along its vector the data do not vary.
    """
    v = np.array([[int(x) / (n * n) for x in row] for row in m])
    e, q = np.linalg.eigh(v)
    e, q = e[::-1][:top], q[:, ::-1][:, :top]
    e = np.where(e > len(v) * np.finfo(float).eps * max(e[0], 0.0), e, 0.0)
    trace = int(np.trace(m)) / (n * n)
    return q, e, e / trace if trace > 0 else np.zeros(len(e))


def _project(vec: str, n: int, sums: list[int], q: np.ndarray, e: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The columns kept, then deviation, exact_deviation and w (the whitened components) of each usable row."""
    d, high = len(sums), max((abs(s) for s in sums), default=0)
    scale = np.array([1 / x**0.5 if x > 0 else np.nan for x in e])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, v in integers(batch, vec):
                if v.shape[1] != d:
                    continue
                bound = n * int(np.abs(v).max()) + high
                if bound * bound * d < 1 << 63:
                    y = n * v - np.array(sums, np.int64)
                    dev = (y * y).sum(axis=1)
                    centred = y / n
                else:
                    y = n * v.astype(object) - np.array(sums, object)
                    dev = (y * y).sum(axis=1)
                    centred = np.array([[int(x) / n for x in row] for row in y])
                w = centred @ q * scale
                dev = [int(x) for x in dev]
                kept = batch.take(pa.array(at)).columns[:-1]
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1) * w.shape[1], pa.int32()), pa.array(w.ravel(), pa.float64(), from_pandas=True))
                cols = [*kept, pa.array([x if x < 1 << 63 else None for x in dev], pa.int64()), pa.array(map(str, dev), pa.string()), lists]
                yield pa.RecordBatch.from_arrays(cols, names=[*batch.schema.names[:-1], "deviation", "exact_deviation", "w"])

    return run


def whiten(rows: DataFrame, vec: str = "embedding", id: str = "vec_id", top: int = TOP) -> DataFrame:
    """vec_id, component, n, deviation, exact_deviation, whitened, explained, identity_error: a row for each usable row and component.

    Rows whose vector is null, empty, or holds nulls or non-finite entries are left out, and of several lengths all but the most frequent one. Each
    entry is floor(1024 * entry) + 100000, held within 2 ** 62. deviation is null where it is beyond a long; exact_deviation
    has all its digits. Along components without variance whitened is null and explained 0; identity_error is over the others, and null if
    there is none. Repeated rows count, and are returned, each. A null id is kept. Ties of eigenvalues are in the decomposition's order. An
    empty table gives no rows. Further columns are ignored, whatever their names. There are no texts here; a vector of any length is read whole.
    """
    used = rows.select(F.col(id).alias("vec_id"), F.col(vec).alias("vec"))
    n, sums, m = fit(used, "vec")
    q, e, share = components(n, m, top) if n else (np.zeros((0, 0)), np.zeros(0), np.zeros(0))
    kind = dict(used.dtypes)["vec_id"]
    done = stage(used.mapInArrow(_project("vec", n, sums, q, e), f"vec_id {kind}, deviation long, exact_deviation string, w array<double>"), "whitened")
    # Covariances of the whitened rows as they are written, centred, over n.
    pairs = [(i, j) for i in range(len(e)) for j in range(i, len(e)) if e[i] > 0 and e[j] > 0]
    away = [F.abs(F.covar_pop(F.get("w", F.lit(i)), F.get("w", F.lit(j))) - float(i == j)).alias(f"p{i}_{j}") for i, j in pairs]
    error = max(done.agg(*away).first()) if away else None
    shares = F.array(*map(F.lit, share.tolist())) if len(share) else F.lit(None).cast("array<double>")
    long = done.select("vec_id", "deviation", "exact_deviation", F.posexplode("w").alias("at", "whitened"))
    return long.select("vec_id", (F.col("at") + 1).alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "exact_deviation", "whitened", F.get(shares, F.col("at")).alias("explained"), F.lit(error).cast("double").alias("identity_error"))


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings")).drop("exact_deviation")
