"""Rows with missing keys or values stay; the diversity pick loses nothing to pruning."""

import random

import numpy as np
from pyspark.sql import functions as F

from vacantia.config import RankerConfig
from vacantia.operators import ranking as rk

ROWS = [("a", "r1", 1.0), ("a", "r2", 3.0), ("a", "r3", None), (None, "r4", 2.0), (None, "r5", 4.0), ("b", None, 5.0), ("b", "r7", 5.0), ("c", "r8", None)]


def frame(spark):
    return spark.createDataFrame(ROWS, "k string, r string, v double")


def test_rescale(spark):
    got = {(x.k, x.r): x.scaled for x in rk.rescale(frame(spark), ["k"], "v").collect()}
    assert got == {("a", "r1"): 0.0, ("a", "r2"): 1.0, ("a", "r3"): None, (None, "r4"): 0.0, (None, "r5"): 1.0, ("b", None): 0.0, ("b", "r7"): 0.0, ("c", "r8"): None}


def test_percentile_rank(spark):
    got = {(x.k, x.r): x.percentile for x in rk.percentile_rank(frame(spark), ["k"], "v").collect()}
    assert got == {("a", "r1"): 0.25, ("a", "r2"): 0.75, ("a", "r3"): None, (None, "r4"): 0.25, (None, "r5"): 0.75, ("b", None): 0.5, ("b", "r7"): 0.5, ("c", "r8"): None}


def test_skyline_and_layers(spark):
    df = frame(spark).withColumn("w", F.coalesce("v", F.lit(0.0)))
    assert {(x.k, x.r) for x in rk.skyline(df, "k", "r", ["w"]).collect()} == {("a", "r2"), (None, "r5"), ("b", None), ("b", "r7"), ("c", "r8")}
    for most in (20_000, 1):
        got = {(x.k, x.r): x.pareto_rank for x in rk.pareto_layers(df, "k", "r", ["w"], most).collect()}
        assert got == {("a", "r1"): 2, ("a", "r2"): 1, ("a", "r3"): 3, (None, "r4"): 2, (None, "r5"): 1, ("b", None): 1, ("b", "r7"): 1, ("c", "r8"): 1}


def test_diverse_pick_equals_pick_over_all_rows(spark):
    rng = random.Random(3)
    rows = [(f"u{u}", f"p{i:03}", round(rng.choice([0.9, 0.7, rng.random()]), 3), rng.random(), rng.choice("xyz"), rng.choice(["i", "j", None]), rng.choice("fp"), u < 2 or i % 2 == 0) for u in range(3) for i in range(120)]
    df = spark.createDataFrame(rows, "u_user_id string, p_job_id string, final_score double, match_score double, p_company string, p_industry string, p_work_type string, passes boolean")
    cfg = RankerConfig(top_k=9, diversity_factor=0.3)
    got = {(r.u_user_id, r.position): r.p_job_id for r in rk.diversify(rk.pickable(df, cfg), cfg).collect()}
    pruned = rk.pickable(df, cfg).count()
    assert pruned < len(rows)
    for u in range(3):
        own = sorted((r for r in rows if r[0] == f"u{u}" and r[7]), key=lambda r: (-round(r[2], 9), -round(r[3], 9), r[1]))
        kinds = np.array([[hash(str(x)) for x in r[4:7]] for r in own])
        want = [own[i][1] for i in rk.greedy_pick(np.array([r[2] for r in own]), kinds, 0.3, 9)]
        assert [got[f"u{u}", k] for k in range(9)] == want


def test_positions(spark):
    rng = random.Random(5)
    rows = [(rng.choice(["a", "b", None]), i, rng.random()) for i in range(500)]
    got = {r.i: r.position for r in rk.positions(spark.createDataFrame(rows, "k string, i int, v double"), ["k"], [F.desc("v"), F.col("i")]).collect()}
    for k in ("a", "b", None):
        own = sorted((r for r in rows if r[0] == k), key=lambda r: (-r[2], r[1]))
        assert [got[r[1]] for r in own] == list(range(len(own)))
