import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from vacantia.config import MatcherConfig, RankerConfig
from vacantia.functions import scoring as sc
from vacantia.operators import matching as m
from vacantia.operators import ranking as rk
from vacantia.operators.features import posting_features, profile_features
from vacantia.operators.textjoin import contains_pairs, joints

PROFILE = ("user_id string, name string, skills array<struct<name:string,proficiency:double,years_of_experience:double>>, "
           "education array<struct<level:string,major:string,gpa:double,ranking:string>>, work_experience array<struct<company:string,duration_years:double>>, "
           "preferences array<struct<preference_type:string,value:string,weight:double>>, "
           "constraints struct<locations:array<string>,min_salary:double,max_salary:double,work_type:string,start_date:date,industries:array<string>,"
           "company_types:array<string>,exclude_companies:array<string>,max_commute_time:double>")
POST = ("job_id string, title string, company string, location string, salary_min double, salary_max double, job_type string, industry string, "
        "required_skills array<string>, required_education string, required_experience_years double, description string")


def user(uid, locs=(), lo=None, hi=None, work=None, ind=(), skills=(), edu=(), years=0.0, prefs=(), excl=()):
    return (uid, uid, list(skills), list(edu), [("Acme", years)], list(prefs), (list(locs), lo, hi, work, None, list(ind), [], list(excl), None))


def post(jid, loc="York", sal=None, work="Full-time", ind="IT", skills=(), edu=None, years=0.0, company="Org"):
    return (jid, "Engineer", company, loc, sal, sal, work, ind, list(skills), edu, years, "")


def frames(spark, us, ps):
    return profile_features(spark.createDataFrame(us, PROFILE)), posting_features(spark.createDataFrame(ps, POST), "2024-01-01 00:00:00")


def scored(spark, u, p, cfg=None):
    us, ps = frames(spark, [u], [p])
    pairs = spark.createDataFrame([(u[0], p[0])], "user_id string, job_id string")
    return m.score_given_pairs(pairs, us, ps, cfg).first()


def test_salary_short_circuit(spark):
    u = user("a", lo=30.0, work="Remote")
    ok = post("j", sal=36.0)
    assert scored(spark, u, ok).constraints_satisfied                      # a met salary skips the work type
    assert not scored(spark, u, ok, MatcherConfig(strict_constraints=True)).constraints_satisfied
    assert not scored(spark, u, post("j", sal=None)).constraints_satisfied  # no salary: later checks run
    assert not scored(spark, user("b", lo=30.0), post("j", sal=20.0)).constraints_satisfied  # plausible, too low
    assert scored(spark, user("b", lo=30.0), post("j", sal=2.0)).constraints_satisfied       # other unit: not rejected


def test_missing_data_never_rejects(spark):
    u = user("a", locs=["Leeds"], work="Remote", ind=["IT"], excl=["Org"])
    p = ("j", "T", None, None, None, None, None, None, [], None, 0.0, "")
    # an unset work type becomes the default type, as for every posting
    assert not scored(spark, u, p).constraints_satisfied
    assert scored(spark, user("a", locs=["Leeds"], ind=["IT"]), p).constraints_satisfied


def test_scores_by_hand(spark):
    u = user("a", lo=10.0, hi=10.0, skills=[("Python", 0.8, 5.0), ("SQL", 0.5, 0.0)], edu=[("Bachelor", "CS", 3.8, None), ("High School", "", None, None)],
             years=2.0, prefs=[("Industry", "IT", 1.0), ("Innovation", "x", 1.0)])
    r = scored(spark, u, post("j", sal=10.0, skills=["python", "Java", "go", "rust"], edu="MSc degree", years=4.0))
    cov, wgt, jac = 0.25, 1.0 / 4, 1 / 5          # 0.8 * 1.5 is capped at 1
    assert r.skill_score == pytest.approx(cov * .5 + wgt * .3 + jac * .2 - (.5 - cov) * .5)
    assert r.education_score == pytest.approx(min(1, 3 / 4 * 1.1))
    assert r.experience_score == pytest.approx(1 / (1 + math.exp(-5 * (0.5 - 0.7))))
    assert r.preference_score == pytest.approx((1.0 + 0.5) / 2)
    assert r.salary_score == pytest.approx(0.7)   # equal bounds: ratio 0 instead of a division by zero
    assert r.location_score == 1.0
    none = scored(spark, user("b"), post("j", skills=["x"], edu="PhD"))
    assert (none.skill_score, none.education_score, none.preference_score, none.salary_score) == (0.0, 0.3, 0.5, 0.5)


def test_weights_renormalise(spark):
    df = spark.createDataFrame([(0.5, None), (None, None), (1.0, 0.0)], "a double, b double")
    parts = [("a", F.col("a"), 0.3), ("b", F.col("b"), 0.7)]
    rows = df.select(sc.weighted_with_missing(parts).alias("v"), sc.breakdown(parts).alias("d")).collect()
    assert [round(r.v, 6) for r in rows] == [0.5, 0.5, 0.3]
    assert rows[0].d.components.a.effective_weight == 1.0 and rows[0].d.missing == ["b"] and rows[1].d.missing == ["a", "b"]


def test_needles_of_several_words_are_known_by_their_joints(spark):
    texts = ["a large ring of gold", "xlarge ringy", "large  ring", "Brand#12 and more", "no such thing", "", "é la carte é", "largering"]
    needles = ["large ring", "ring of", "Brand#12", "la carte", "e r", "#", "ring", "thing"]
    for some in (needles, needles[:4]):
        n = spark.createDataFrame([(x,) for x in some], "needle string")
        t = spark.createDataFrame(list(enumerate(texts)), "tid int, text string")
        got = {tuple(r) for r in contains_pairs(n, t, "needle", "text", "tid").collect()}
        assert got == {(x, i) for x in some for i, y in enumerate(texts) if x in y}
    assert t.filter("tid = 0").select(joints(F.col("text"))).first()[0] == ["ge ri", "ng of", "of go"]


def test_contains_pairs_equals_brute_force(spark):
    rnd = random.Random(3)
    texts = ["".join(rnd.choice("abc d") for _ in range(rnd.randint(1, 30))) for _ in range(60)] + ["ab", "a\nb c"]
    needles = sorted({"".join(rnd.choice("abc d") for _ in range(rnd.randint(1, 6))) for _ in range(80)} | {"a\nb"})
    n = spark.createDataFrame([(x,) for x in needles], "needle string")
    t = spark.createDataFrame(list(enumerate(texts)), "tid int, text string")
    got = {tuple(r) for r in contains_pairs(n, t, "needle", "text", "tid").select("needle", "tid").collect()}
    assert got == {(x, i) for x in needles for i, s in enumerate(texts) if x in s}


@pytest.mark.parametrize("block_rows", [2, 20_000])
def test_candidate_pairs_equal_brute_force(spark, monkeypatch, block_rows):
    monkeypatch.setattr(m, "BLOCK_ROWS", block_rows)
    places = ["York", "North York", "Yor", "Leeds", "leeds", "Bath, UK", "", None]
    us = [user(f"u{i}", locs=l) for i, l in enumerate([[], ["York"], ["Leeds", "Bath"], [""], ["Bath, UK, Europe", "Bath"], ["York"], ["York"]])]
    ps = [post(f"j{i}", loc=p) for i, p in enumerate(places * 2)]
    uf, pf = frames(spark, us, ps)
    got = [tuple(r) for r in m.candidate_pairs(uf, pf).select("u_user_id", "p_job_id").collect()]
    want = {(u[0], p[0]) for u in us for p in ps if not u[6][0] or not p[3] or any(x in p[3] or p[3] in x for x in u[6][0])}
    assert len(got) == len(set(got)) and set(got) == want


def test_gate_relaxes_per_user(spark):
    us = [user("good", skills=[("x", 1.0, 0.0)], edu=[("PhD", "", None, None)], years=5.0), user("poor", lo=1e9, locs=["Nowhere"])]
    ps = [post("j1", skills=["x"]), post("j2", skills=["y", "z"], edu="PhD", years=50.0, loc=None)]
    uf, pf = frames(spark, us, ps)
    got = {(r.u_user_id, r.p_job_id): r.used_relaxed for r in m.top_matches(m.match(uf, pf, MatcherConfig(min_match_score=0.45)), 5).collect()}
    assert got[("good", "j1")] is False and got[("poor", "j2")] is True


def brute_layers(v):
    rest, out, layer = set(range(len(v))), {}, 0
    while rest:
        layer += 1
        front = {i for i in rest if not any((v[j] >= v[i]).all() and (v[j] > v[i]).any() for j in rest)}
        out.update({i: layer for i in front})
        rest -= front
    return out


def test_layers_and_skyline(spark):
    rng = np.random.default_rng(1)
    v = rng.integers(0, 6, (120, 3)).astype(float)
    want = brute_layers(v)
    assert {i: int(x) for i, x in enumerate(rk._layers(v))} == want
    assert [bool(x) for x in rk._front(v, block=16)] == [want[i] == 1 for i in range(len(v))]
    df = spark.createDataFrame([("u", f"r{i}", *map(float, x)) for i, x in enumerate(v)], "u string, r string, a double, b double, c double")
    sky = {r.r for r in rk.skyline(df, "u", "r", ["a", "b", "c"], chunk_rows=20).collect()}
    assert sky == {f"r{i}" for i, k in want.items() if k == 1}
    got = {r.r: r.pareto_rank for r in rk.pareto_layers(df, "u", "r", ["a", "b", "c"], max_group=100).collect()}
    assert got == {f"r{i}": k for i, k in want.items()}


def slow_pick(scores, feats, factor, limit):
    picked, rest = [0], list(range(1, len(scores)))
    while rest and len(picked) < limit:
        adj = {i: scores[i] * (1 - factor * max(sum(a == b for a, b in zip(feats[i], feats[p])) / len(feats[i]) for p in picked)) for i in rest}
        rest.sort(key=lambda i: adj[i], reverse=True)
        picked.append(rest.pop(0))
    return picked


def test_greedy_pick_equals_slow_form():
    rng = np.random.default_rng(5)
    for n in (1, 2, 30):
        s = np.sort(rng.integers(0, 8, n) / 8)[::-1]
        f = rng.integers(0, 3, (n, 3))
        assert rk.greedy_pick(s, f, 0.1, 12) == slow_pick(s, f, 0.1, 12)[:max(1, min(12, n))]


def test_rank_with_diversity_and_calibration(spark):
    us = [user("u", skills=[("x", 1.0, 0.0)])]
    ps = [post(f"j{i}", skills=["x"] if i < 3 else ["y"], company=f"c{i % 2}") for i in range(6)]
    uf, pf = frames(spark, us, ps)
    rows = rk.rank(m.match(uf, pf), RankerConfig(top_k=4)).orderBy("rank").collect()
    assert [r.rank for r in rows] == [1, 2, 3, 4] and all(0 <= r.final_score <= 1 for r in rows)
    assert [r.final_score for r in rows] == sorted((r.final_score for r in rows), reverse=True)


def test_all_gaps_are_listed(spark):
    from vacantia.operators import reasoning as rs
    rows = spark.createDataFrame([([f"s{i}" for i in range(7)], [("s9", 0.2, 0.5)])],
                                 "missing_skills array<string>, weak_skills array<struct<skill:string,proficiency:double,years:double>>")
    rows = rows.selectExpr("*", "array('x') AS matched_skills", "cast(array() AS array<string>) AS matched_preferred", "0.5D AS education_score", "0.5D AS location_score",
                           "0.5D AS final_score", "0.5D AS relevance")
    r = rs.gap_report(rows).first()
    assert [(g["skill"], g["status"]) for g in r["skill_gaps"]] == [(f"s{i}", "missing") for i in range(7)] + [("s9", "needs_improvement")]
    assert len(r["learning_suggestions"]) == 3 and "address: s0, s1, s2, s3. " in r["reasoning"]
    assert len(rs.gap_report(rows, max_gaps=5).first()["skill_gaps"]) == 5


def test_given_pairs_meet_postings_first(spark):
    """Pairs of unknown postings are gone before a user's arrays are joined; rows and repeated pairs as before."""
    us, ps = frames(spark, [user("u1", skills=[("sql", 0.9, 2.0)]), user("u2")], [post("j1", skills=["sql"]), post("j2")])
    pairs = spark.createDataFrame([("u1", "j1"), ("u1", "j1"), ("u1", "gone"), ("u2", "j2"), ("none", "j1"), (None, "j1")], "user_id string, job_id string")
    got = m.score_given_pairs(pairs, us, ps)
    assert sorted((r.u_user_id, r.p_job_id, r.n_hits) for r in got.collect()) == [("u1", "j1", 1), ("u2", "j2", 0)]
    plan = got._jdf.queryExecution().analyzed().toString().splitlines()
    joins = [line for line in plan if "Join" in line]
    assert "u_user_id" in joins[0] and "p_job_id" in joins[1]
