"""Keys of substring joins are selective, and letter vectors are made once for a phrase."""

import time

from pyspark.sql import functions as F

from vacantia.functions import text as tx
from vacantia.operators import skills as k
from vacantia.operators import textjoin as tj


def test_numbered_names_do_not_meet_other_numbered_names(spark, monkeypatch):
    """Names with a common stem and a number are not looked up in every text that holds another stem with a number."""
    written = []
    keep = tj.materialize
    monkeypatch.setattr(tj, "materialize", lambda df, label: written.append(keep(df, label)) or written[-1])
    needles = [f"supplier#{i:09}" for i in range(40)] + ["brand#12", "large ring of gold", "ring", "a b"]
    texts = [f"full text: large ring of gold at customer#{i:09}" for i in range(50)] + ["at supplier#000000007, brand#123", "a b c", "xa bx"]
    n = spark.createDataFrame([(x,) for x in needles], "needle string")
    t = spark.createDataFrame(list(enumerate(texts)), "tid int, text string")
    got = {tuple(r) for r in tj.contains_pairs(n, t, "needle", "text", "tid").collect()}
    assert got == {(x, i) for x in needles for i, y in enumerate(texts) if x in y}
    looked_up = {(r.tid, r._gram) for r in written[0].collect()}
    assert not any("#" in gram for tid, gram in looked_up if tid < 50)


def test_joints_of_every_width_equal_brute_force(spark):
    texts = ["one two", "nineteen-eleven letters", "ab cd", "a-b", "x ab cd y", "seventeen seventeen", "one\ntwo three", "é é ab", "12345678 12345678 1234"]
    needles = sorted({t[i:j] for t in texts for i in range(0, len(t), 3) for j in range(i + 1, len(t) + 1, 2)})
    n = spark.createDataFrame([(x,) for x in needles], "needle string")
    t = spark.createDataFrame(list(enumerate(texts)), "tid int, text string")
    got = [tuple(r) for r in tj.contains_pairs(n, t, "needle", "text", "tid").collect()]
    assert len(got) == len(set(got)) and set(got) == {(x, i) for x in needles for i, y in enumerate(texts) if x in y}


def test_letter_vectors_of_many_phrases(spark):
    phrases = [f"Supplier number {i:09}" for i in range(3000)] + ["", " é Ring ", None]
    df = spark.createDataFrame(list(enumerate(phrases)), "i int, t string").coalesce(4)
    start = time.time()
    rows = df.select("t", tx.trigram_vector(F.col("t")).alias("v")).collect()
    assert time.time() - start < 15, "worked out once for each of its 256 places, these took over 25 s"
    for r in rows[::97] + rows[-3:]:
        want = [0.0] * 256
        low = None if r.t is None else f" {r.t.strip().lower()} "
        for i in range(max(1, len(low) - 2) if low else 0):
            a, b, c = (ord(x) if x else 0 for x in (low[i:i + 1], low[i + 1:i + 2], low[i + 2:i + 3]))
            want[(a * 961 + b * 31 + c) % 256] += 1
        assert r.v == want


def test_texts_of_the_chain_are_cut_once(spark, monkeypatch):
    labels = []
    keep = k.materialize
    monkeypatch.setattr(k, "materialize", lambda df, label: labels.append(label) or keep(df, label))
    posts = spark.createDataFrame([("j1", "A large ring and a gold pin", None, "gold pin; x"), ("j2", None, None, None)], "job_id string, description string, full_description string, requirements string")
    voc = spark.createDataFrame([("large ring",), ("gold",)], "label string")
    got = {tuple(r)[:2] for r in k.extracted_mentions(posts, voc).collect()}
    assert got == {("j1", "large ring"), ("j1", "gold"), ("j1", "gold pin"), ("j1", "x")} and labels == ["texts"]
