"""Multi-objective ranking per user: objectives, Pareto layers, diversity, calibration."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import RankerConfig
from ..functions import scoring as sc
from ..util import join_on, materialize, spread, top_per_key
from .matching import relax

CHUNK_ROWS = 4096


def with_objectives(scored: DataFrame, cfg: RankerConfig | None = None, breakdowns: bool = False) -> DataFrame:
    cfg = cfg or RankerConfig()
    parts = {"relevance": sc.relevance_parts(cfg), "feasibility": sc.feasibility_parts(cfg), "growth": sc.growth_parts(cfg, F.col("n_hits") if "n_hits" in scored.columns else None)}
    out = scored.withColumns({n: sc.weighted_with_missing(p) for n, p in parts.items()})
    if breakdowns:
        out = out.withColumns({f"{n}_breakdown": sc.breakdown(p) for n, p in parts.items()})
    return out.withColumn("final_score", sc.final_score(cfg))


def score_order(score: str = "final_score") -> list[Column]:
    """Scores equal to nine digits tie and fall back to match order, then the id."""
    return [F.desc(F.round(score, 9)), F.desc(F.round("match_score", 9)), F.col("p_job_id")]


# --- Pareto -------------------------------------------------------------------------------

def _layers(values: np.ndarray) -> np.ndarray:
    """Layer of every row, 1 = dominated by no other row.

    In descending lexicographic order all rows that dominate a row come before it, so its
    layer is one more than the deepest layer among them.
    """
    order = np.lexsort(tuple(-values[:, j] for j in range(values.shape[1] - 1, -1, -1)))
    v = values[order]
    depth = np.zeros(len(v), dtype=np.int64)
    for i in range(len(v)):
        seen = v[:i]
        above = (seen >= v[i]).all(axis=1) & (seen > v[i]).any(axis=1)
        depth[i] = 1 + (depth[:i][above].max() if above.any() else 0)
    out = np.empty_like(depth)
    out[order] = depth
    return out


def _front(values: np.ndarray, block: int = 256) -> np.ndarray:
    """True for rows that no other row dominates; rows meet the front found so far in blocks."""
    order = np.lexsort(tuple(-values[:, j] for j in range(values.shape[1] - 1, -1, -1)))
    v = values[order]
    front = v[:0]
    keep = np.zeros(len(v), dtype=bool)
    for lo in range(0, len(v), block):
        b = v[lo:lo + block]
        # A dominator always comes earlier, so it is in the front or in this block.
        for rivals in (front, b):
            if len(rivals) and len(b):
                hit = ((rivals[None] >= b[:, None]).all(axis=2) & (rivals[None] > b[:, None]).any(axis=2)).any(axis=1)
                if rivals is front:
                    alive = ~hit
                else:
                    alive &= ~hit
            elif rivals is front:
                alive = np.ones(len(b), dtype=bool)
        keep[lo:lo + block] = alive
        front = np.vstack([front, b[alive]])
    out = np.empty_like(keep)
    out[order] = keep
    return out


def _chunks(df: DataFrame, user: str, rows: int) -> DataFrame:
    """Number the chunks of each user so that a chunk holds about ``rows`` rows."""
    n = df.groupBy(user).agg(F.ceil(F.count(F.lit(1)) / rows).cast("int").alias("_nc"))
    return join_on(df, n, [user]).withColumn("_chunk", F.pmod(F.xxhash64("_row"), F.col("_nc")).cast("int"))


def skyline(df: DataFrame, user: str, row: str, objectives: Sequence[str], chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Rows of each user that no other row of the user dominates.

    First every chunk keeps its own skyline. The survivors of a user are then checked block
    against block; a task holds two chunks, whatever the size of the user's group.
    """
    objs = list(objectives)
    base = df.select(F.col(user).alias("_user"), F.col(row).alias("_row"), *[F.col(o).cast("double").alias(o) for o in objs])

    def local(pdf: pd.DataFrame) -> pd.DataFrame:
        return pdf[_front(pdf[objs].to_numpy())]

    first = _chunks(base, "_user", chunk_rows)
    kept = spread(first, "_user", "_chunk").groupBy("_user", "_chunk").applyInPandas(local, first.schema).drop("_nc", "_chunk")
    # Survivors are needed on both sides below: write them once.
    kept = _chunks(materialize(kept, "skyline"), "_user", chunk_rows)
    every = F.explode(F.expr("sequence(0, _nc - 1)"))
    target = kept.withColumn("_other", every)
    rival = kept.toDF(*kept.columns).withColumn("_other", F.col("_chunk")).withColumn("_chunk", every)

    def beaten(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        a, b = left[objs].to_numpy(), right[objs].to_numpy()
        hit = np.zeros(len(a), dtype=bool)
        for lo in range(0, len(a), 256):
            x = a[lo:lo + 256, None, :]
            hit[lo:lo + 256] = ((b[None] >= x).all(axis=2) & (b[None] > x).any(axis=2)).any(axis=1)
        return left.loc[hit, ["_user", "_row"]]

    keys = ["_user", "_chunk", "_other"]
    lost = (spread(target, *keys).groupBy(*keys)
            .cogroup(spread(rival, *keys).groupBy(*keys))
            .applyInPandas(beaten, kept.select("_user", "_row").schema).distinct())
    front = join_on(kept, lost, ["_user", "_row"], "left_anti").select(F.col("_user").alias(user), F.col("_row").alias(row))
    return join_on(df, front, [user, row], "left_semi")


def pareto_layers(df: DataFrame, user: str, row: str, objectives: Sequence[str], max_group: int = 20_000) -> DataFrame:
    """``pareto_rank`` of every row of each user.

    Groups up to ``max_group`` rows are layered in one task. Larger ones lose one skyline
    per round until what is left fits, so no group is ever gathered whole.
    """
    objs = list(objectives)
    rest = df.select(F.col(user).alias("_user"), F.col(row).alias("_row"), *[F.col(o).cast("double").alias(o) for o in objs])
    done = None
    layer = 0
    while True:
        size = rest.groupBy("_user").agg(F.count(F.lit(1)).alias("_n"))
        big = size.filter(F.col("_n") > max_group)
        any_big = not big.isEmpty()
        small_rows = join_on(rest, big, ["_user"], "left_anti") if any_big else rest

        def all_layers(pdf: pd.DataFrame) -> pd.DataFrame:
            return pd.DataFrame({"_user": pdf["_user"], "_row": pdf["_row"], "pareto_rank": _layers(pdf[objs].to_numpy())})

        schema = T.StructType([*rest.select("_user", "_row").schema.fields, T.StructField("pareto_rank", T.LongType())])
        part = spread(small_rows, "_user").groupBy("_user").applyInPandas(all_layers, schema).withColumn("pareto_rank", F.col("pareto_rank") + layer)
        done = part if done is None else done.unionByName(part)
        if not any_big:
            break
        layer += 1
        large = materialize(join_on(rest, big.select("_user"), ["_user"], "left_semi"), "pareto-rest")
        front = skyline(large, "_user", "_row", objs).select("_user", "_row")
        front = materialize(front, "pareto-front")
        done = done.unionByName(front.withColumn("pareto_rank", F.lit(layer).cast("bigint")))
        rest = materialize(join_on(large, front, ["_user", "_row"], "left_anti"), "pareto-rest")
    return join_on(df, done.select(F.col("_user").alias(user), F.col("_row").alias(row), "pareto_rank"), [user, row])


# --- diversity ----------------------------------------------------------------------------

def greedy_pick(scores: np.ndarray, features: np.ndarray, factor: float, limit: int) -> list[int]:
    """Positions in pick order: each step takes the best score after the similarity penalty.

    The list is re-sorted stably at each step, so equal scores keep the order of the step before.
    """
    n = len(scores)
    if n <= 1:
        return list(range(n))
    limit = max(1, min(limit, n))
    order = np.arange(1, n)
    similar = (features[1:] == features[0]).mean(axis=1)
    picked = [0]
    while len(order) and len(picked) < limit:
        adjusted = scores[order] * (1 - factor * similar)
        idx = np.argsort(-adjusted, kind="stable")
        order, similar = order[idx], similar[idx]
        best, order, similar = order[0], order[1:], similar[1:]
        picked.append(int(best))
        similar = np.maximum(similar, (features[order] == features[best]).mean(axis=1))
    return picked


def diversify(top: DataFrame, cfg: RankerConfig, user: str = "u_user_id", row: str = "p_job_id") -> DataFrame:
    """Greedy re-ordering of each user's pickable rows (narrow ones); ``position`` counts from 0."""
    factor, limit = cfg.diversity_factor, cfg.top_k
    # Read by the picker and by the join below: write the capped list once.
    top = materialize(top, "capped")
    narrow = top.select(user, row, F.round("final_score", 9).alias("final_score"), F.round("match_score", 9).alias("match_score"), "p_company", "p_industry", "p_work_type")

    def pick(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["final_score", "match_score", row], ascending=[False, False, True]).reset_index(drop=True)
        feats = np.column_stack([pd.factorize(pdf[c], use_na_sentinel=False)[0] for c in ("p_company", "p_industry", "p_work_type")])
        chosen = greedy_pick(pdf["final_score"].to_numpy(), feats, factor, limit)
        out = pdf.loc[chosen, [user, row]].copy()
        out["position"] = np.arange(len(out), dtype=np.int32)
        return out

    schema = T.StructType([*narrow.select(user, row).schema.fields, T.StructField("position", T.IntegerType())])
    picks = spread(narrow, user).groupBy(user).applyInPandas(pick, schema)
    return join_on(top, picks, [user, row])


def calibrate(df: DataFrame) -> DataFrame:
    """Position, popularity and freshness factors on the unpenalised score."""
    popular = F.when(F.coalesce(F.col("p_view_count") > 1000, F.lit(False)), 0.95).otherwise(1.0)
    stale = F.when(F.coalesce(F.col("p_days_since_posted") > 30, F.lit(False)), 0.9).otherwise(1.0)
    return df.withColumn("final_score", F.col("final_score") * (1.0 - F.col("position") * 0.01) * popular * stale)


def rank(matched: DataFrame, cfg: RankerConfig | None = None, breakdowns: bool = False) -> DataFrame:
    """Per user the ``top_k`` rows with ``rank``; ``matched`` comes from the matcher.

    Nothing is dropped that could be in the list; ``candidate_cap`` limits the diversity pick only when it is set.
    """
    cfg = cfg or RankerConfig()
    return rank_scored(with_objectives(matched, cfg, breakdowns), cfg)


def rank_scored(rows: DataFrame, cfg: RankerConfig) -> DataFrame:
    """``rank`` of rows that have their objectives."""
    by_pass = [F.desc("passes")]
    if cfg.use_pareto:
        # Layers are defined over the gated rows, so the gate is settled per user first.
        rows = relaxed(rows).drop("used_relaxed")
        rows = pareto_layers(materialize(rows, "pareto-input"), "u_user_id", "p_job_id", ["relevance", "feasibility", "growth"])
        rows = rows.withColumn("final_score", F.try_divide(F.lit(1.0), F.col("pareto_rank").cast("double")))
    diverse = cfg.diversity_factor > 0
    order = by_pass + score_order()
    if diverse:
        top = relax(pickable(rows, cfg))
        if cfg.candidate_cap > 0:
            top = top_per_key(top, ["u_user_id"], order, cfg.candidate_cap, "score_rank", row="p_job_id")
        top = diversify(top, cfg)
    elif not cfg.calibration or cfg.top_k <= 100:
        # Past position 100 the position factor is not positive, so these rows cannot be in a shorter top list.
        limit = 101 if cfg.calibration else cfg.top_k
        top = relax(top_per_key(rows, ["u_user_id"], order, limit, "score_rank", row="p_job_id")).withColumn("position", F.col("score_rank") - 1)
    else:
        top = positions(relaxed(rows), ["u_user_id"], order).withColumn("score_rank", F.col("position") + 1)
    return listed(top, cfg)


def listed(top: DataFrame, cfg: RankerConfig) -> DataFrame:
    """The final list of rows that have a ``position``: calibrated if asked for, then the first ``top_k``."""
    if cfg.calibration:
        top = calibrate(top)
    last = [F.desc(F.round("final_score", 9)), F.col("position")] if cfg.calibration else [F.col("position")]
    return top_per_key(top, ["u_user_id"], last, cfg.top_k, "rank", row="p_job_id")


def relaxed(rows: DataFrame, user: str = "u_user_id") -> DataFrame:
    """Passing rows of each user, or all rows when none passes; the gate is combined map-side."""
    gate = rows.groupBy(user).agg(F.max("passes").alias("_any"))
    return join_on(rows, gate, [user]).withColumn("used_relaxed", ~F.col("_any")).filter(F.col("passes") | F.col("used_relaxed")).drop("_any")


def pickable(rows: DataFrame, cfg: RankerConfig, user: str = "u_user_id") -> DataFrame:
    """Rows that the greedy diversity pick can choose, exactly.

    Rows of one user that agree in company, industry and work type always have the same penalty, so only the first ``top_k`` of them can be
    picked. And as a penalty takes at most the share ``diversity_factor``, no row below that share of the
    user's ``top_k``-th score can.
    """
    features = ["p_company", "p_industry", "p_work_type"]
    first = top_per_key(relaxed(rows, user).drop("used_relaxed"), [user, *features], score_order(), cfg.top_k, "_of_kind", row="p_job_id").drop("_of_kind")
    first = materialize(first, "pickable")
    best = top_per_key(first.select(user, "p_job_id", "final_score", "match_score"), [user], score_order(), cfg.top_k, "_r", row="p_job_id")
    least = best.groupBy(user).agg(F.when(F.count(F.lit(1)) >= cfg.top_k, F.min("final_score") * (1 - min(1.0, cfg.diversity_factor))).alias("_least"))
    return join_on(first, least, [user]).filter(F.col("_least").isNull() | (F.col("final_score") >= F.col("_least") - 1e-8)).drop("_least")


def positions(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Position of each row in its key's order, from 0.

    Rows are range-partitioned by key and order; a partition numbers its own rows and starts from the counts before it, so no key is
    sorted in one task.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = materialize(df.repartitionByRange(n, *[F.col(k) for k in keys], *order).withColumn("_part", F.spark_partition_id()), "positions")
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = placed.groupBy(*keys, "_part").agg(F.count(F.lit(1)).alias("_n")).select(*keys, "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    own = F.row_number().over(Window.partitionBy(*keys, "_part").orderBy(*order))
    return join_on(placed.withColumn("_own", own), counts, [*keys, "_part"]).withColumn("position", F.col("_before") + F.col("_own") - 1).drop("_before", "_own", "_part")


def ranking_summary(ranked: DataFrame) -> DataFrame:
    s = F.col("final_score")
    return ranked.groupBy("u_user_id").agg(
        F.count(F.lit(1)).alias("total_jobs"),
        *[F.avg(c).alias(f"avg_{c}") for c in ("relevance", "feasibility", "growth")],
        *[F.max(c).alias(f"top_{c}") for c in ("relevance", "feasibility", "growth")],
        F.count_if(s >= 0.8).alias("high_quality"), F.count_if((s >= 0.6) & (s < 0.8)).alias("medium_quality"),
        F.count_if(s < 0.6).alias("low_quality"))


def rescale(df: DataFrame, keys: Sequence[str], value: str, lo: float = 0.0, hi: float = 1.0) -> DataFrame:
    """Min-max rescale inside each key; all-equal groups get ``lo``, a NULL value stays NULL, NULL is a key like others.

    Aggregated and joined back instead of a window, so a hot key is combined map-side.
    """
    ends = df.groupBy(*keys).agg(F.min(value).alias("_min"), F.max(value).alias("_max"))
    return join_on(df, ends, list(keys)).withColumn(
        "scaled", F.when(F.col(value).isNull(), None).when(F.col("_min") == F.col("_max"), lo)
        .otherwise(lo + F.try_divide((F.col(value) - F.col("_min")) * (hi - lo), F.col("_max") - F.col("_min")))).drop("_min", "_max")


def percentile_rank(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Mid-rank percentile of each row; a NULL value has none and does not count, NULL is a key like others.

    Distinct values with their counts are range-partitioned; running sums stay inside a
    partition and start from the totals of the partitions before it, so a key with many
    values is never sorted in one task.
    """
    keys = list(keys)
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counts = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"))
    counts = materialize(counts.repartitionByRange(n, *keys, value).withColumn("_part", F.spark_partition_id()), "ranks")
    sums = counts.groupBy(*keys, "_part").agg(F.sum("_n").alias("_s"))
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*keys, "_part", F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_before"),
                       F.sum("_s").over(Window.partitionBy(*keys)).alias("_total"))
    upto = Window.partitionBy(*keys, "_part").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    ranks = join_on(counts.withColumn("_upto", F.sum("_n").over(upto)), sums, [*keys, "_part"])
    ranks = ranks.select(*keys, value, ((F.col("_before") + F.col("_upto") - F.col("_n") * 0.5) / F.col("_total")).alias("percentile"))
    return join_on(df, ranks, [*keys, value], "left")
