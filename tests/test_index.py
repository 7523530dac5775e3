"""The inverted file against all rows; the extraction chain by hand."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from vacantia.functions import text as tx
from vacantia.operators import similarity as sim
from vacantia.operators import skills as k


def table(spark, x, name):
    return spark.createDataFrame([(i, None if v is None else [float(c) for c in v]) for i, v in enumerate(x)], f"{name} bigint, embedding array<double>")


@pytest.mark.parametrize("block", [4096, 40])
def test_index_of_clusters(spark, block):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(12, 16)) * 4
    x = [*(centres[rng.integers(12, size=600)] + rng.normal(size=(600, 16))), np.zeros(16), None]
    q = [*(centres[rng.integers(12, size=40)] + rng.normal(size=(40, 16))), np.zeros(16), None]
    phrases, library = table(spark, q, "phrase"), table(spark, x, "label_id")
    exact = sim.nearest(phrases.filter("embedding IS NOT NULL"), library.filter("embedding IS NOT NULL"), 5, floor=-1.0)
    found = sim.nearest_indexed(phrases, library, 5, probes=0.25, block=block)
    assert sim.recall(found, exact).first()["recall"] >= 0.9
    whole = sim.nearest_indexed(phrases, library, 5, probes=1.0, block=block)
    rows = lambda df: sorted((r.phrase, r["rank"], r.label_id, round(r.similarity, 9)) for r in df.collect())
    assert rows(whole) == rows(exact) and {r.phrase for r in whole.collect()} == set(range(40))


def test_only_probed_cells_meet(spark):
    rng = np.random.default_rng(5)
    library = table(spark, rng.normal(size=(400, 8)), "label_id")
    centres = sim.fit_centroids(library, "label_id", "embedding", 20, sample=100)
    assert centres.shape == (20, 8) and np.allclose(np.linalg.norm(centres, axis=1), 1)
    placed = sim.in_cells(library, "label_id", "embedding", centres, 3)
    assert placed.count() == 1200 and placed.select("label_id", "cell").distinct().count() == 1200
    assert sim.in_cells(library, "label_id", "embedding", centres, 1).count() == 400


def test_trigram_vectors(spark):
    rows = spark.createDataFrame([("Red  ring",), ("a",), ("",)], "t string").select(tx.trigram_vector(F.col("t"), 32).alias("v")).collect()
    text = " red  ring "
    want = [0.0] * 32
    for i in range(len(text) - 2):
        want[(ord(text[i]) * 961 + ord(text[i + 1]) * 31 + ord(text[i + 2])) % 32] += 1
    assert rows[0].v == want and sum(rows[1].v) == 1 and len(rows[2].v) == 32


def test_extraction_chain_by_hand(spark):
    lib = spark.createDataFrame([(1, "python", False), (2, "machine learning", False), (3, "C++", True), (4, "Go", False)], "id int, name string, is_alternative boolean")
    posts = spark.createDataFrame([("a", "We use Python and machine learning.", "", "Pythn; C++"), ("b", "going far", None, None), ("c", None, "learning machine wanted, GO", "[]")],
                                  "job_id string, description string, full_description string, requirements string")
    mentions, records = k.extraction_chain(posts, lib, sim.best_of_names)
    assert {(r.job_id, r.skill_text, r.method) for r in mentions.collect()} == {
        ("a", "python", "keyword_match_exact"), ("a", "machine learning", "keyword_match_substring"), ("a", "Pythn", "listed_phrase"), ("a", "C++", "listed_phrase"), ("c", "Go", "keyword_match_exact")}
    assert {(r.job_id, r.raw, r.normalized, r.normalization_method) for r in records.collect()} == {
        ("a", "python", "python", "embedding"), ("a", "machine learning", "machine learning", "embedding"), ("a", "Pythn", "python", "fuzzy"), ("a", "C++", "C++", "embedding"), ("c", "Go", "Go", "embedding")}


@pytest.mark.parametrize(("n", "k"), [(3, 5), (40, 5), (700, 5), (700, 11)])
def test_best_entries_equal_a_full_sort(n, k):
    rng = np.random.default_rng(n)
    x = np.round(rng.normal(size=(30, n)), 1)  # many equal entries
    rows, cols = sim._best(x, k)
    want = np.argsort(-x, axis=1, kind="stable")[:, :k]
    assert cols.reshape(30, -1).tolist() == want.tolist() and rows.tolist() == np.repeat(np.arange(30), min(n, k)).tolist()


def test_few_rows_are_multiplied_at_a_time(monkeypatch):
    rng = np.random.default_rng(1)
    side = lambda name, n: pd.DataFrame({name: np.arange(n), "_v": list(rng.normal(size=(n, 4)))})
    a, b = side("_q", 70), side("_l", 90)
    whole = sim._best_pairs(a, b, 3, -1.5)
    seen, best = [], sim._best
    monkeypatch.setattr(sim, "ROWS", 16)
    monkeypatch.setattr(sim, "_best", lambda x, k: seen.append(len(x)) or best(x, k))
    pd.testing.assert_frame_equal(sim._best_pairs(a, b, 3, -1.5), whole)
    assert max(seen) == 16 and sum(seen) == 70
