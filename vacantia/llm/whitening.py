"""Whitening of embeddings by an exact bit-sliced scatter matrix.

Entries become integers. Per dimension they are shifted to start at zero and cut into bit planes; a plane of 64 rows is one machine word.
The cross-product of two dimensions is the sum of the popcounts of their planes' ANDs, each weighted by its power of two: exact, whatever the
order of rows or the number of tasks. Tasks send one number per pair of dimensions. The covariance is centred in integers of any size, and only
the finished matrix becomes doubles for the eigenvectors.

Defined results: a vector that is null or holds an entry that is null, not finite, or too large for an exact integer (2**53 after
scaling) is dropped. All remaining vectors need one length: the most frequent one counts (of equally frequent ones the longest), vectors of
others lack entries and are dropped like those with null entries; empty vectors have nothing to whiten. Repeated rows and ids count and return
as often as they stand there; a null id stays. A direction without variance (an eigenvalue of 1e-11 of the largest or less) has a null
``whitened``. No remaining vector: an empty result. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vacantia.llm.common import keyed, ship

#: Bits that are cut from a block of rows at a time.
BLOCK_BITS = 1 << 22
#: Of the largest eigenvalue: what counts as no variance.
FLAT = 1e-11


def integers(vectors: DataFrame, id_col: str, vector_col: str, scale: int, shift: int) -> DataFrame:
    """``id, x``: the vectors that can be used, as arrays of long."""
    rows = keyed(vectors, id_col, vector_col, "v").select("id", F.col("v").cast("array<double>").alias("v"))
    exact = lambda c: F.when(F.abs(c) <= float(2**53 // scale), (F.floor(c * scale) + shift).cast("bigint"))
    rows = rows.select("id", F.transform("v", exact).alias("x"))
    return rows.where((F.size("x") > 0) & F.forall("x", lambda c: c.isNotNull()))


def matrix(column: pa.Array) -> np.ndarray:
    """Rows x dimensions of a column of lists of equal length."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def planes(y: np.ndarray, dim: np.ndarray, bit: np.ndarray) -> np.ndarray:
    """Bit ``bit[p]`` of column ``dim[p]`` of all rows, 64 rows a word (planes x words)."""
    packed = np.packbits(((y[:, dim] >> bit) & 1).astype(np.uint8), axis=0).T
    return np.ascontiguousarray(np.pad(packed, ((0, 0), (0, -packed.shape[1] % 8)))).view(np.uint64)


def cross_products(y: np.ndarray, bits: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Sums of each column and of each product of two columns (upper triangle) of non-negative integers below ``2**bits``, as Python integers."""
    d = len(bits)
    sums, products = np.zeros(d, object), np.zeros((d, d), object)
    dim = np.repeat(np.arange(d), bits)
    bit = np.concatenate([np.arange(b) for b in bits]) if len(dim) else np.zeros(0, np.int64)
    if not len(dim):
        return sums, products
    start = np.concatenate([[0], np.cumsum(bits)])
    filled = [i for i in range(d) if bits[i]]
    step = max(64, BLOCK_BITS // len(dim) // 64 * 64)
    kind = np.int64 if 2 * max(bits) + step.bit_length() < 62 else object
    weight = np.array([1 << int(b) for b in bit], kind)
    for at in range(0, len(y), step):
        words = planes(y[at:at + step], dim, bit)
        ones = np.bitwise_count(words).sum(1, dtype=np.int64).astype(kind) * weight
        sums[filled] += np.add.reduceat(ones, start[filled]).astype(object)
        for k, i in enumerate(filled):
            a, b = start[i], start[i + 1]
            both = np.bitwise_count(words[a:b, None] & words[None, a:]).sum(2, dtype=np.int64).astype(kind)
            rest = filled[k:]
            row = np.add.reduceat((both * weight[a:b, None]).sum(0) * weight[a:], start[rest] - a)
            products[i, rest] += row.astype(object)
    return sums, products


def scatter(rows: DataFrame, lo: list[int], hi: list[int]) -> tuple[int, list[int], list[list[int]]]:
    """Number of rows, and the sums and cross-products of ``x - lo``, exact."""
    d, bits = len(lo), [(h - l).bit_length() for l, h in zip(lo, hi, strict=True)]
    base = np.array(lo, np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums, products = 0, np.zeros(d, object), np.zeros((d, d), object)
        for b in batches:
            if b.num_rows:
                s, p = cross_products(matrix(b.column(0)) - base, bits)
                n, sums, products = n + b.num_rows, sums + s, products + p
        i, j = np.triu_indices(d)
        values = [Decimal(int(v)) for v in (n, *sums, *products[i, j])]
        i, j = np.concatenate([[-1], np.arange(d), i]), np.concatenate([[-1], np.full(d, -1), j])
        yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(values, pa.decimal128(38, 0))], names=["i", "j", "v"])

    parts = rows.select("x").mapInArrow(run, "i int, j int, v decimal(38,0)")
    sums, products, n = [0] * d, [[0] * d for _ in range(d)], 0
    for i, j, v in parts.groupBy("i", "j").agg(F.sum("v").cast("decimal(38,0)").alias("v")).collect():  # d * (d + 3) / 2 + 1 rows
        if i < 0:
            n = int(v)
        elif j < 0:
            sums[i] = int(v)
        else:
            products[i][j] = products[j][i] = int(v)
    return n, sums, products


def eigen(n: int, sums: list[int], products: list[list[int]], components: int) -> tuple[np.ndarray, np.ndarray, float]:
    """Largest eigenvalues, their unit vectors (dimensions x components) and the trace of the covariance of divisor ``n``."""
    centred = [[n * p - si * sj for p, sj in zip(row, sums, strict=True)] for row, si in zip(products, sums, strict=True)]
    e, v = np.linalg.eigh(np.array([[c / (n * n) for c in row] for row in centred]))
    top = np.argsort(-e, kind="stable")[:components]
    return e[top], v[:, top], sum(centred[k][k] for k in range(len(sums))) / (n * n)


def exact_centred(x: np.ndarray, lo: np.ndarray, n: int, sums: np.ndarray, wide: bool) -> np.ndarray:
    """``n * x`` less the sums of ``x``, from the shifted values; Python integers where a long would not hold the sum of squares."""
    y = x - lo
    return y.astype(object) * n - sums if wide else y * n - sums


def whiten(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = 32, scale: int = 64, shift: int = 1_000_000) -> DataFrame:
    """``id, component, n, deviation, whitened, explained, identity_error`` of each remaining row and component.

    ``deviation`` is a decimal(38,0). ``identity_error`` is measured on the whitened rows in two further passes: their means, then centred products.
    The driver holds one matrix of dimensions x dimensions.
    """
    spark = vectors.sparkSession
    ship(spark)
    result = f"id {keyed(vectors, id_col).schema['id'].dataType.simpleString()}, component int, deviation decimal(38,0), whitened double"
    finish = lambda df, n, explained, error: df.select(
        "id", "component", F.lit(n).cast("bigint").alias("n"), "deviation", "whitened", F.get(F.lit(explained).cast("array<double>"), F.col("component") - 1).alias("explained"), F.lit(error).cast("double").alias("identity_error"))
    rows = integers(vectors, id_col, vector_col, scale, shift)
    lengths = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    if not lengths:
        return finish(spark.createDataFrame([], result), 0, [], None)
    d = lengths[0].d
    rows = rows.where(F.size("x") == d)
    ranges = rows.select(F.posexplode("x")).groupBy("pos").agg(F.min("col").alias("lo"), F.max("col").alias("hi")).orderBy("pos").collect()
    lo, hi = [r.lo for r in ranges], [r.hi for r in ranges]
    n, sums, products = scatter(rows, lo, hi)
    e, v, trace = eigen(n, sums, products, min(components, d))
    flat = e <= FLAT * max(e[0], 0)
    v = np.where(flat, np.nan, v / np.sqrt(np.where(flat, 1, e)))
    widest = max(max(n * (h - l) - s, s) for l, h, s in zip(lo, hi, sums, strict=True))
    wide = d * widest * widest >= 2**62
    base, total, k = np.array(lo, np.int64), np.array(sums, object if wide else np.int64), len(e)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 4096):
                b = whole.slice(at, 4096)
                centred = exact_centred(matrix(b.column(1)), base, n, total, wide)
                deviation = [Decimal(int(s)) for s in (centred * centred).sum(1)]
                z = (centred / n).astype(np.float64) @ v
                at_row = pa.array(np.repeat(np.arange(b.num_rows), k))
                yield pa.RecordBatch.from_arrays([
                    b.column(0).take(at_row), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), b.num_rows)),
                    pa.array(deviation, pa.decimal128(38, 0)).take(at_row), pa.array(z.ravel(), from_pandas=True)], names=["id", "component", "deviation", "whitened"])

    done = rows.mapInArrow(run, result)
    return finish(done, n, [float(x) / trace if trace else None for x in np.maximum(e, 0)], identity_error(done, n, [c + 1 for c in range(k) if not flat[c]]))


def identity_error(done: DataFrame, n: int, components: list[int]) -> float | None:
    """Largest absolute entry of the covariance of ``whitened`` (divisor ``n``) minus the identity, over the components that have a value."""
    if not components:
        return None
    own = done.select("component", "whitened").where(F.col("whitened").isNotNull())
    means = {r.component: r.m for r in own.groupBy("component").agg(F.avg("whitened").alias("m")).collect()}
    mean, k = np.array([means[c] for c in components]), len(components)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, rest = np.zeros((k, k)), np.zeros(0)
        for b in batches:
            values = np.concatenate([rest, b.column(0).to_numpy()])  # a row's components follow each other; a batch may end within a row
            full = len(values) // k * k
            z, rest = values[:full].reshape(-1, k) - mean, values[full:]
            total += z.T @ z
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(k * k)), pa.array(total.ravel())], names=["at", "v"])

    parts = own.select("whitened").mapInArrow(run, "at bigint, v double").groupBy("at").agg(F.sum("v").alias("v")).collect()
    covariance = np.zeros(k * k)
    for r in parts:
        covariance[r["at"]] = r.v / n
    return float(np.abs(covariance.reshape(k, k) - np.eye(k)).max())
