"""Small DataFrame helpers shared by the operators."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Characters that a text "strip" removes.
WHITESPACE = " \t\n\r\x0b\x0c"

# Spark's own map-side group limit applies up to this rank (its default threshold).
GROUP_LIMIT = 1000


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def read_table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{directory}/{name}.parquet")


def strip(c: str | Column) -> Column:
    return F.trim(col(c), F.lit(WHITESPACE))


def blank_to_null(c: str | Column) -> Column:
    """NULL for a value without visible characters, the unchanged value otherwise."""
    return F.when(strip(c) != "", col(c))


def empty_to_null(c: str | Column) -> Column:
    return F.when(col(c) != "", col(c))


def contains_any(c: Column, words: Sequence[str]) -> Column:
    """Substring test against a fixed word list."""
    out = F.lit(False)
    for w in words:
        out = out | c.contains(w)
    return out


def rlike_any(c: Column, patterns: Sequence[str]) -> Column:
    return c.rlike("(?i)" + "|".join(f"(?:{p})" for p in patterns))


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Keep the first row of each key.

    Spark plans ``row_number() = 1`` with a group limit before the shuffle, so a hot key
    sends one row per map task, not its whole group.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def top_per_key(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    k: int,
    rank_col: str = "rank",
    row: str | None = None,
    salts: int = 64,
) -> DataFrame:
    """Keep the ``k`` first rows of each key and number them from 1.

    Up to Spark's group-limit threshold the limit runs map-side by itself. For a larger k
    a first pass salted on the row id does the same: the final window never sees more than
    ``k * salts`` rows of one key.
    """
    if k > GROUP_LIMIT:
        if row is None:
            raise ValueError("a large k needs the row id column to salt on")
        # Salted on data, not on rand(): a recomputed task must place its rows as before.
        df = df.withColumn("_salt", F.pmod(F.xxhash64(row), F.lit(salts)))
        pre = Window.partitionBy(*keys, "_salt").orderBy(*order)
        df = df.withColumn("_pre", F.row_number().over(pre)).filter(F.col("_pre") <= k).drop("_pre", "_salt")
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank_col, F.row_number().over(w)).filter(F.col(rank_col) <= k)


def join_on(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join on equally named keys in which NULL meets NULL, so that rows with a missing key are kept."""
    r = right.select(*[F.col(k).alias(f"__{k}") for k in keys], *[c for c in right.columns if c not in keys])
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"__{k}"))
    return left.join(r, on, how).drop(*[f"__{k}" for k in keys])


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Hash-partition by the grouping keys over the full shuffle width.

    Python work per group costs far more than its bytes suggest, so adaptive coalescing by
    size would leave it to a few tasks. The grouping reuses this partitioning.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def r6(c: str | Column) -> Column:
    return F.round(col(c), 6)


def r6e(c: str | Column) -> Column:
    """Six digits with a nudge, so that values on a rounding tie do not depend on float noise."""
    return F.round(col(c) + 1e-9, 6)


def percent(c: Column) -> Column:
    """``0.734`` -> ``73%``; half-even, like number formatting in text templates."""
    return F.concat(F.bround(F.round(c * 100, 7), 0).cast("bigint").cast("string"), F.lit("%"))


def shared_dir(spark: SparkSession, label: str) -> str:
    """A fresh folder that every executor can reach: under ``spark.checkpoint.dir``, else the context's checkpoint folder, else the warehouse."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.sql.warehouse.dir", None)
    if not root:
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return f"{root.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write once to the shared folder and read back: the lineage is cut and survives lost executors."""
    path = shared_dir(df.sparkSession, label)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
