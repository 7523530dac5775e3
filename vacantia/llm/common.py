"""Small helpers shared by the corpus operators."""

from __future__ import annotations

import os
import shutil
import tempfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vacantia.util import materialize, shared_dir

__all__ = ["Memo", "components", "keyed", "materialize", "partitions", "shared_dir", "ship", "slices", "table", "top_partitions"]

_PACKAGE = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give the Python workers this package, once per application, and whole texts in batches of fewer rows than Spark's default (a session's own number stays)."""
    sc = spark.sparkContext
    if spark.conf.get(_BATCH, "10000") == "10000":
        spark.conf.set(_BATCH, "1000")
    if sc.applicationId not in _shipped:
        to = os.path.join(tempfile.mkdtemp(prefix="vacantia-src-"), "vacantia_llm")
        sc.addPyFile(shutil.make_archive(to, "zip", os.path.dirname(_PACKAGE), os.path.basename(_PACKAGE)))
        _shipped.add(sc.applicationId)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def keyed(df: DataFrame, id_col: str, *cols: str) -> DataFrame:
    """Only the named columns, so that further columns of ``df`` can clash with nothing."""
    return df.select(F.col(f"`{id_col}`").alias("id"), *(F.col(f"`{c}`").alias(n) for c, n in zip(cols[::2], cols[1::2], strict=True)))


def slices(batches: Iterator[pa.RecordBatch], rows: int = 256, nbytes: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Cut batches into pieces of few rows and few bytes (one row at least), so that a task's Python objects stay small."""
    for b in batches:
        step, at = max(1, min(rows, int(rows * nbytes / max(1, b.nbytes / max(1, b.num_rows) * rows)))), 0
        while at < b.num_rows:
            yield b.slice(at, step)
            at += step
    pa.default_memory_pool().release_unused()  # a worker lives on


class Memo(dict):
    """``f`` by key, remembering about ``2 * size`` recent keys: when the young generation is full it becomes the old one."""

    def __init__(self, f, size: int) -> None:
        super().__init__()
        self.f, self.size, self.old = f, size, {}

    def __missing__(self, key):
        v = self.old.get(key)
        if v is None:
            v = self.f(key)
        if len(self) >= self.size:
            self.old = dict(self)
            self.clear()
        self[key] = v
        return v


def top_partitions(spark: SparkSession, rows: int, per: int = 1 << 20) -> int:
    """Enough partitions for ``rows`` rows, never fewer than the session's own number."""
    return max(partitions(spark), -(-rows // per))


def components(edges: DataFrame, rounds: int = 100) -> DataFrame:
    """``node, component`` (the smallest node) of every node of the edges ``a, b``.

    Each round takes the least label among neighbours, then the label's own label, so paths shorten by halves. Every round is written out.
    """
    both = materialize(edges.select(F.col("a").alias("node"), F.col("b").alias("other")).unionByName(edges.select(F.col("b").alias("node"), F.col("a").alias("other"))), "edges")
    labels = materialize(both.groupBy("node").agg(F.min("other").alias("m")).select("node", F.least("node", "m").alias("component")), "labels")
    for _ in range(rounds):
        near = both.join(labels.select(F.col("node").alias("other"), "component"), "other").groupBy("node").agg(F.min("component").alias("m"))
        least = labels.join(near, "node").select("node", F.least("component", "m").alias("c"), F.col("component").alias("before"))
        jump = labels.select(F.col("node").alias("c"), F.col("component").alias("cc"))
        new = materialize(least.join(jump, "c", "left").select("node", F.least("c", "cc").alias("component"), "before"), "labels")
        changed = new.where("component <> before").limit(1).count()
        labels = new.select("node", "component")
        if not changed:
            return labels
    raise RuntimeError(f"components are not settled after {rounds} rounds")
