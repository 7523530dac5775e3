"""Jaccard links against comparison of all pairs."""

import random
import re
from collections import Counter

import numpy as np

from vacantia.llm import forest, queries
from vacantia.llm import jaccard_rtree as m


def shingle_set(text, n=3):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda c: chr(ord(c[0]) + 32), text or ""))
    return frozenset(tuple(words[i:i + n]) for i in range(len(words) - n + 1)) if len(words) >= n else frozenset([tuple(words)] if words else [])


def brute(rows, percent=90, n=3):
    """Overlaps by an inverted index over all sets: every pair with a common shingle is judged."""
    sets, by = [shingle_set(t, n) for _, t in rows], {}
    once = {s: k for k, s in reversed(list(enumerate(sets)))}
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i
    for k, s in enumerate(sets):
        if s and once[s] != k:
            up[root(k)] = root(once[s])
    for s, k in once.items():
        common = Counter(j for x in s for j in by.get(x, ()))
        for j, c in common.items():
            if 100 * c >= percent * (len(s) + len(sets[j]) - c):
                up[root(k)] = root(j)
        for x in s:
            by.setdefault(x, []).append(k)
    ids = {}
    for i, (k, _) in enumerate(rows):
        ids.setdefault(root(i), []).append(k)
    least = {r: min((k for k in v if k is not None), default=None) for r, v in ids.items()}
    return Counter((k, len(sets[i]), least[root(i)] if sets[i] else k) for i, (k, _) in enumerate(rows))


def rows_of(frame):
    return Counter((r.id, r.n_shingles, r.component_id) for r in frame.collect())


def near_texts(rng, groups=25, vocabulary=3000):
    words = [f"w{k}" for k in range(vocabulary)]
    rows = []
    for _ in range(groups):
        base = rng.choices(words, k=rng.choice([1, 2, 3, 4, 11, 12, 13, 30, 60, 150, 600]))
        for _ in range(rng.choice([1, 2, 5, 20])):
            own = list(base)
            for _ in range(rng.randrange(1 + max(1, len(own) // 30))):
                k = rng.randrange(len(own))
                own[k:k + rng.choice([0, 1, 2])] = rng.choices(words, k=rng.choice([0, 1, 1]))
                own = own or ["x"]
            rows.append(" ".join(own))
    return rows


def test_linked_sets_share_a_key():
    rng = np.random.default_rng(1)
    top, differ = m.size_classes(90, 100_000)
    for size in [*range(1, 60), 100, 333, 1000, 5000]:
        for _ in range(6):
            a = np.unique(rng.integers(1, 2**62, size).astype(np.uint64))
            most = (len(a) * 10) // 95  # replacements and removals up to the threshold
            gone = rng.integers(0, most + 1)
            b = np.unique(np.concatenate([a[gone:], rng.integers(1, 2**62, rng.integers(0, gone + 1)).astype(np.uint64)]))
            common = len(np.intersect1d(a, b))
            if 100 * common >= 90 * (len(a) + len(b) - common) and len(a) != common:
                assert set(m.keys_of(a, 90, top, differ).tolist()) & set(m.keys_of(b, 90, top, differ).tolist())


def test_empty_blocks_are_told_in_combinations():
    a = np.arange(1, 4, dtype=np.uint64)
    keys = m.block_keys(a, 3, 9)
    assert len(keys) in (3 + 20, 2 + 35, 1 + 56) and len(set(keys.tolist())) == len(keys)  # three elements fill one to three of nine blocks


def test_tree_keeps_every_link_and_prunes():
    rng = np.random.default_rng(2)
    base = [np.unique(rng.integers(1, 2**62, rng.integers(5, 400)).astype(np.uint64)) for _ in range(300)]
    sets = base + [np.unique(np.concatenate([b[rng.integers(0, 3):], rng.integers(1, 2**62, 1).astype(np.uint64)])) for b in base]
    at = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
    tree = m.RTree(m.points(np.concatenate(sets), at), np.diff(at))
    q, found, computed = tree.search(m.points(np.concatenate(sets), at), np.diff(at), 90)
    got = set(zip(q.tolist(), found.tolist(), strict=True))
    assert all((k, k + 300) in got for k in range(300) if len(np.intersect1d(sets[k], sets[k + 300])) >= 0.95 * max(len(sets[k]), len(sets[k + 300])))
    assert len(got) < 3 * len(sets) and computed < len(sets) ** 2 / 4


def test_equals_brute_force(spark, frame, monkeypatch):
    rng = random.Random(3)
    rows = [(k, t) for k, t in enumerate(near_texts(rng))]
    rows += [(None, rows[0][1]), (5001, None), (5002, ""), (5003, " \t\n"), (5004, "Ä ä x"), (5004, "ä Ä X"), rows[3], (5005, rows[4][1].upper()), (5006, "a b"), (5007, "A\vb")]
    rng.shuffle(rows)
    want = brute(rows)
    assert rows_of(m.linked(frame(rows).repartition(3))) == want
    monkeypatch.setattr(forest, "SIDE", 500)  # many blocks of a bucket
    monkeypatch.setattr(forest, "TOGETHER", 2000)
    assert rows_of(m.linked(frame(rows))) == want
    assert rows_of(m.linked(frame(rows), n=1, percent=70)) == brute(rows, 70, 1)


def test_chain_in_a_bucket(frame):
    """Neighbours in a chain are linked, others are not; one part of the text stays the same in all."""
    words = [f"w{k}" for k in range(400)]
    rows = []
    for k in range(60):
        words[5 * (k % 12) + 1] = f"v{k}"
        rows.append((k, " ".join(words)))
    got = rows_of(m.linked(frame(rows)))
    assert got == brute(rows) and {c for _, _, c in got} == {0}


def test_empty_table(frame):
    got = m.linked(frame([]))
    assert got.collect() == [] and got.columns == ["id", "n_shingles", "component_id"]


def test_registered_query(spark):
    d = "/root/testdata/sf0.01"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect()]
    got = queries.op11_jaccard_rtree(spark, d)
    assert got.columns == ["doc_id", "n_shingles", "component_id"]
    assert rows_of(got.withColumnRenamed("doc_id", "id")) == brute(rows)
