import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from vacantia.config import SkillConfig
from vacantia.functions import text as tx
from vacantia.operators import graph as g
from vacantia.operators import loose as lo
from vacantia.operators import similarity as sim
from vacantia.operators import skills as k

TITLED = "About us\nWe sell.\nRequirements:\n- Python\n- SQL\nBenefits\nLunch"
BULLETS = "We sell things, daily.\n- runs tests\n* equal opportunity\n1. writes code\nYou must travel."
CUES = "We sell things, daily. You must know Spark! Our lunch is free, always. Knowledge of SQL helps."


def test_requirement_text(spark):
    df = spark.createDataFrame([(TITLED,), (BULLETS,), (CUES,), ("Nothing here, at all.",)], "t string")
    got = [r[0] for r in df.select(k.requirement_text("t")).collect()]
    assert got[0] == "- Python\n- SQL"
    assert got[1] == "- runs tests\n1. writes code\nYou must travel."
    assert got[2] == CUES and got[3] == ""      # one line with a cue keeps the whole line
    two = spark.createDataFrame([("We sell, daily.\nFree lunch, always.",)], "t string")
    assert two.select(k.extraction_text("t")).first()[0].startswith("We sell")


def test_gazetteer_rules(spark):
    t = spark.createDataFrame([("1", "Uses C++ and javascript; metadata analysis daily."), ("2", "Java, data  analysis")], "job_id string, text string")
    v = spark.createDataFrame([("Java",), ("data analysis",), ("C++",), ("ANALYSIS",)], "label string")
    got = {(r.job_id, r.label, r.score) for r in k.gazetteer(t, v).collect()}
    # words need boundaries, phrases match as substrings, 'C++' needs a word character after it
    assert got == {("1", "data analysis", 0.9), ("1", "ANALYSIS", 0.95), ("2", "Java", 0.95), ("2", "ANALYSIS", 0.95)}


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        prev = 0
        for j, y in enumerate(b, 1):
            prev, row[j] = row[j], prev + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def test_token_ratio(spark):
    rnd = random.Random(2)
    for _ in range(200):
        a, b = ("".join(rnd.choice("abcd ") for _ in range(rnd.randint(1, 90))) for _ in range(2))
        assert sim._lcs_ratio(a, b) == pytest.approx(200 * lcs(a, b) / (len(a) + len(b)))
    df = spark.createDataFrame([("Machine-Learning", "learning machine"), ("abc", "abd"), (None, "x")], "a string, b string")
    assert [r[0] for r in df.select(sim.token_sort_ratio(F.col("a"), F.col("b"))).collect()] == [100.0, 67.0, None]


@pytest.mark.parametrize("block", [4, 4096])
def test_nearest_and_gates(spark, block):
    rng = np.random.default_rng(0)
    lib = [(i, i, f"skill {i}", [float(x) for x in (rng.normal(size=8) if i else np.zeros(8))]) for i in range(23)]
    q = [(f"skill {i}", [float(x) for x in rng.normal(size=8)]) for i in range(9)]
    ld = spark.createDataFrame(lib, "label_id int, skill_id int, name string, embedding array<float>")
    qd = spark.createDataFrame(q, "phrase string, embedding array<float>")
    got = {(r.phrase, r.rank): r.label_id for r in sim.nearest(qd, ld, 3, block=block, floor=-1.0).collect()}
    for ph, v in q:
        s = sorted(range(1, 23), key=lambda i: -np.dot(lib[i][3], v) / np.linalg.norm(lib[i][3]) / np.linalg.norm(v))
        assert [got[(ph, r)] for r in (1, 2, 3)] == s[:3]
    best = {r.phrase: (r.name, r.method) for r in sim.normalize_phrases(qd, ld, SkillConfig(embedding_threshold=2.0, fuzzy_threshold=100)).collect()}
    assert best["skill 4"] == ("skill 4", "fuzzy")


def test_fuzzy_matches_are_found_beyond_the_nearest(spark):
    rng, rnd = np.random.default_rng(1), random.Random(5)
    word = lambda: "".join(rnd.choice("abcdefé") for _ in range(rnd.randint(0, 9)))
    names = [" ".join((word(), word(), word())) for _ in range(700)] + ["x" * 70 + " y", None]
    lib = [(i, i, n, [1.0, *(float(x) for x in rng.normal(size=3) / 9)]) for i, n in enumerate(names)]
    asked = ["-".join(reversed(n.split())) + "a" for n in names[:700:70]] + ["y, " + "x" * 69]
    q = [(p, [-1.0, 0.1, 0.1, 0.1]) for p in dict.fromkeys(asked)]
    ld = spark.createDataFrame(lib, "label_id int, skill_id int, name string, embedding array<float>")
    qd = spark.createDataFrame(q, "phrase string, embedding array<float>")

    def tokens(x):
        return " ".join(sorted("".join(c if c.isalnum() else " " for c in x.lower()).split()))

    def cosine(i, v):
        return np.dot(lib[i][3], v) / np.linalg.norm(lib[i][3]) / np.linalg.norm(v)
    want = {}
    for p, v in q:
        ratio = {i: round(sim._lcs_ratio(tokens(p), tokens(n))) for i, n in enumerate(names) if n is not None}
        best = sorted((i for i in ratio if ratio[i] >= 70), key=lambda i: (-ratio[i], -cosine(i, v), i))[:2]
        want |= {(p, i): ratio[i] / 100 for i in best}
    assert len(want) > 9
    for block in (100, 4096):
        assert {(r.phrase, r.label_id): r.similarity for r in sim.fuzzy_labels(qd, ld, 70, 2, block).collect()} == want
    got = {(r.phrase, r.skill_id): r.similarity for r in sim.normalize_phrases(qd, ld, SkillConfig(embedding_threshold=2.0, fuzzy_threshold=70), top_k=2).collect()}
    assert got == want


def edges(spark, rnd, jobs, skills, hot):
    rows = []
    for j in range(jobs):
        mine = {f"s{rnd.randrange(skills)}" for _ in range(rnd.randint(1, 4))} | {h for h in hot if rnd.random() < 0.7}
        rows += [(f"j{j:03d}", s) for s in mine for _ in range(rnd.randint(1, 2))]
    return rows, g.skill_edges(spark.createDataFrame(rows, "job_id string, skill string"))


@pytest.mark.parametrize("hot", [1, 4, 10_000])
def test_related_postings_equal_brute_force(spark, hot):
    rows, e = edges(spark, random.Random(7), 60, 40, ["h1", "h2", "h3"])
    cnt, sets = Counter(rows), {}
    for j, s in rows:
        sets.setdefault(j, set()).add(s)
    want = {}
    for a in sets:
        sc = sorted(((-sum(cnt[(b, s)] for s in sets[a] & sets[b]), b) for b in sets if b != a and sets[a] & sets[b]))[:4]
        want[a] = [(b, -n) for n, b in sc]
    got = {}
    for r in g.related_postings(e, k=4, hot=hot).orderBy("job_id", "rank").collect():
        got.setdefault(r.job_id, []).append((r.related_id, r.shared))
    assert got == want


def test_related_postings_do_not_pair_a_crowd(spark):
    """Postings that share one skill only are never paired; a posting without id has no links."""
    crowd = [(f"c{k:03}", "common") for k in range(300)] + [(f"c{k:03}", "common") for k in (250, 260)]
    rows = [*crowd, ("c007", "rare"), ("c299", "rare"), ("c007", "own"), (None, "common"), (None, "rare")]
    e = g.skill_edges(spark.createDataFrame(rows, "job_id string, skill string"))
    src = e.select(F.col("job_id").alias("a"), "skill")
    met = g.pairs_sharing_two(src, src.withColumnRenamed("a", "b"), spark.createDataFrame([], "skill string"))
    assert {tuple(r) for r in met.collect()} == {("c007", "c299"), ("c299", "c007")}
    got = {}
    for r in g.related_postings(e, k=3).orderBy("job_id", "rank").collect():
        got.setdefault(r.job_id, []).append((r.related_id, r.shared))
    assert len(got) == 300 and got["c100"] == [("c250", 2), ("c260", 2), ("c000", 1)]
    assert got["c007"] == [("c250", 2), ("c260", 2), ("c299", 2)] and got["c250"] == [("c260", 2), ("c000", 1), ("c001", 1)]


@pytest.mark.parametrize("most", [2, 64])
def test_sets_with_one_common_skill_are_not_compared(spark, monkeypatch, most):
    monkeypatch.setattr(g, "PAIRED_SKILLS", most)
    sets = {f"c{k:03}": [*(f"z{k}-{j}" for j in range(2)), "common"] for k in range(60)} | {"d1": ["common", "p", "q", "r"], "d2": ["common", "p", "s"], "e1": ["common"], "e2": ["common", "p"]}
    rare = {x: sum(x in v for v in sets.values()) for v in sets.values() for x in v}
    rows = [(j, len(v), sorted((rare[x], x) for x in v)) for j, v in sets.items()]
    found = {tuple(r) for r in g.set_candidates(spark.createDataFrame(rows, "set_id string, n int, toks array<struct<df:bigint,skill:string>>"), 0.3).collect()}
    linked = {(a, b) for a in sets for b in sets if a < b and len({*sets[a]} & {*sets[b]}) >= 0.3 * len({*sets[a]} | {*sets[b]}) - 1e-9}
    assert linked <= found and ("d1", "d2") in linked and len(linked) > 60
    assert most < 64 or found - linked == set()
    e = g.skill_edges(spark.createDataFrame([(j, x) for j, v in sets.items() for x in v], "job_id string, skill string"))
    got = {(r.source, r.target) for r in g.similar_postings(*g.similar_sets(e, 0.3)).collect()}
    assert got == linked


@pytest.mark.parametrize("t", [0.3, 0.5, 1.0])
def test_similar_sets_equal_brute_force(spark, t):
    rows, e = edges(spark, random.Random(11), 70, 8, ["h1"])
    sets = {}
    for j, s in rows:
        sets.setdefault(j, set()).add(s)
    want = {(a, b): len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for a in sets for b in sets if a < b}
    want = {p: w for p, w in want.items() if w >= t}
    members, links = g.similar_sets(e, t)
    got = {(r.source, r.target): r.weight for r in g.similar_postings(members, links).collect()}
    assert got == pytest.approx(want)
    assert g.similar_set_report(members, links).agg(F.sum("pairs")).first()[0] == len(want)


def test_fallbacks_equal_brute_force(spark):
    rnd = random.Random(4)
    posts = [(f"j{i:02d}", f"{rnd.choice(['red', 'blue'])} {rnd.choice(['bolt', 'nut', 'ring'])}", rnd.choice(["a", "b", ""]), "x") for i in range(40)]
    pd_ = spark.createDataFrame(posts, "job_id string, text string, category string, source string")
    terms = spark.createDataFrame([(p[0], 0, rnd.choice(["bolt", "RED", "d n", "zzz"])) for p in posts], "job_id string, pos int, term string")
    got = {}
    for r in g.related_by_text(terms, pd_, k=3).orderBy("job_id", "rank").collect():
        got.setdefault(r.job_id, []).append(r.related_id)
    want = {}
    for j, _, t in terms.collect():
        hit = sorted((p[0] for p in posts if t.lower() in p[1] and p[0] != j), reverse=True)[:3]
        if hit:
            want[j] = hit
    assert got == want
    lab = {}
    for r in g.related_by_label(pd_, k=3, labels=("category",)).orderBy("job_id", "rank").collect():
        lab.setdefault(r.job_id, []).append(r.related_id)
    assert lab == {p[0]: sorted((q[0] for q in posts if q[2] == p[2] and q[0] != p[0]), reverse=True)[:3] for p in posts if p[2]}


def test_related_by_text_forms_agree_and_shuffle_no_candidates(spark):
    rnd = random.Random(5)
    # repeated and missing ids and texts; terms in any case, empty, missing, unknown
    posts = [(rnd.choice([f"j{rnd.randrange(30):02d}", None]) if i % 9 == 0 else f"j{rnd.randrange(60):02d}", rnd.choice([f"{rnd.choice(['Red', 'blue'])} {rnd.choice(['bolt', 'nut', 'ring'])}", None])) for i in range(80)]
    asked = [(rnd.choice([f"j{rnd.randrange(70):02d}"] * 9 + [None]), i % 3, rnd.choice(["bolt", "RED", "d n", "zzz", "", None])) for i in range(150)]
    pd_, terms = spark.createDataFrame(posts, "job_id string, text string"), spark.createDataFrame(asked, "job_id string, pos int, term string")
    for max_terms in (None, 2):
        newest = {}
        for t in {t.lower() for _, _, t in asked if t}:
            newest[t] = sorted((j for j, x in posts if j and x and t in x.lower()), reverse=True)[:4]
        want = {}
        for j in {j for j, _, _ in asked if j}:
            ids = {r for a, pos, t in asked if a == j and t and (max_terms is None or pos < max_terms) for r in newest[t.lower()]} - {j}
            want.update({(j, r): i + 1 for i, r in enumerate(sorted(ids, reverse=True)[:3])})
        for few in (256, 0):
            out = g.related_by_text(terms, pd_, 3, max_terms, few=few)
            assert {(r.job_id, r.related_id): r["rank"] for r in out.collect()} == want
            assert few == 0 or "hashpartitioning(job_id" not in out._jdf.queryExecution().executedPlan().toString()


def test_loose_records(spark):
    rows = [(1, {"Funding Amount": "£1,000", "Company": "X", "employer": "Longer X"}, {}),
            (2, {"details": "we pay"}, {"Pay & More": "Salary of £30,000 yearly"}),
            (3, {"full_description": "earn $50,000 - $60,000 per year"}, {}),
            (4, {"notes": "x" * 60 + " 20,000 GBP"}, {"Award": "on request"}),
            (5, {"required-skills": "a", "contract": "b", "title": "t"}, {})]
    df = spark.createDataFrame(rows, "rec_id int, fields map<string,string>, sections map<string,string>")
    got = {r.rec_id: r.normalized for r in lo.normalize_records(df, lo.alias_table(spark, {"extra": ["notes"]})).collect()}
    assert got[1]["employer"] == "Longer X" and got[1]["salary"] == "£1,000" and "url" in got[1]
    assert got[2]["salary"] == "£30,000 year" and got[3]["salary"] == "$50,000 - $60,000 per" and got[4]["salary"] == "on request"
    assert got[4]["extra"].endswith("GBP") and got[5]["skills"] == "a" and got[5]["contract_type"] == "b" and got[5]["title"] == "t"


def test_dates_and_numbers(spark):
    df = spark.createDataFrame([("9th March 2026",), ("1 Sept 2025",), ("2024-01-31T10:00:00Z",), ("03/04/2024",), ("soon",)], "d string")
    got = [str(r[0])[:10] for r in df.select(tx.parse_timestamp("d")).collect()]
    assert got == ["2026-03-09", "2025-09-01", "2024-01-31", "2024-04-03", "None"]
    n = spark.createDataFrame([("£30,000 to £35,000, 37.5 hours",), ("n/a",)], "d string").select(tx.all_numbers("d"), tx.first_number("d")).collect()
    assert sorted(n[0][0]) == [37.5, 30000.0, 35000.0] and n[0][1] == 30000.0 and n[1][1] is None


def test_set_links_give_back_posting_pairs(spark):
    rng = random.Random(8)
    sets = [tuple(sorted(rng.sample("abcdefgh", rng.randint(1, 4)))) for _ in range(12)]
    rows = [(f"j{i}", s) for i in range(60) for s in sets[i % 12 if i % 3 else 0]]
    edges = g.skill_edges(spark.createDataFrame(rows, "job_id string, skill string"))
    members, links = g.similar_sets(edges, 0.5)
    pairs = {(r.source, r.target, round(r.weight, 9)) for r in g.similar_postings(members, links).collect()}
    graph = g.set_links(members, links)
    found = g.linked_postings(graph, members.select("job_id").distinct())
    got = {(r.source[4:], r.target[4:], round(r.weight, 9)) for r in found.collect()}
    assert len(pairs) > 200 and got == pairs | {(b, a, w) for a, b, w in pairs} and found.count() == len(got)
    n = len(set(sets))
    assert graph.filter("type = 'has_set'").count() == 60 and graph.filter("type = 'related_role'").count() <= n * (n + 1) / 2
    one = g.linked_postings(graph, spark.createDataFrame([("j1",)], "job_id string"))
    assert {(r.source, r.target) for r in one.collect()} == {(f"job:{a}", f"job:{b}") for a, b, _ in got if a == "j1"}
    assert g.linked_postings(graph, spark.createDataFrame([], "job_id string")).count() == 0


def test_related_by_label_orders_combinations_not_postings(spark):
    """Equals comparing all postings, also for repeated and missing ids; no window runs over the candidates of every posting."""
    rows = [(f"j{i % 50:02}" if i % 7 else None, ("a", "b", " a ", "", None)[i % 5], ("x", "y", None)[i % 3]) for i in range(75)]
    got = g.related_by_label(spark.createDataFrame(rows, "job_id string, category string, source string"), k=4)
    want = set()
    values = lambda c, s: {("c", c.strip()) if c and c.strip() else None, ("s", s) if s else None} - {None}
    newest = {}
    for v in {v for _, c, s in rows for v in values(c, s)}:
        newest[v] = sorted((j for j, c, s in rows if j and v in values(c, s)), reverse=True)[:5]
    for job in {j for j, _, _ in rows if j}:
        near = {r for j, c, s in rows if j == job for v in values(c, s) for r in newest[v]} - {job}
        want |= {(job, r, i) for i, r in enumerate(sorted(near, reverse=True)[:4], 1)}
    assert {(r.job_id, r.related_id, r["rank"]) for r in got.collect()} == want
    assert "windowspecdefinition(job_id" not in got._jdf.queryExecution().toString()
