"""Spelling variants against plain comparison of all words."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from vacantia.llm import queries
from vacantia.llm import spelling as m


def one_edit(u, v):
    short, long = sorted((u, v), key=len)
    if u == v or len(long) - len(short) > 1:
        return False
    k = 0
    while k < len(short) and short[k] == long[k]:
        k += 1
    return short[k + 1:] == long[k + 1:] if len(short) == len(long) else short[k:] == long[k + 1:]


def neighbours(words):
    """All pairs of one edit, by deleting each letter: exact, and quick enough for a whole vocabulary."""
    by, out = {}, {w: set() for w in words}
    for w in words:
        by.setdefault(w, set()).add(w)
        for k in range(len(w)):
            by.setdefault(w[:k] + w[k + 1:], set()).add(w)
    for group in by.values():
        group = sorted(group)
        for i, u in enumerate(group):
            for v in group[:i]:
                if one_edit(u, v):
                    out[u].add(v)
                    out[v].add(u)
    return out


def brute(rows, min_length=5, min_count=3, every=97):
    n = Counter()
    for key, text in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in w)
            h = zlib.crc32(f"{'' if key is None else key}:{w}".encode())
            if every and h % every == 0:
                w = w[:h % len(w)] + w[h % len(w) + 1:]
            if len(w) >= min_length:
                n[w] += 1
    n = {w: c for w, c in n.items() if c >= min_count}
    near, form = neighbours(n), {}
    for w, c in n.items():
        best = min(near[w], key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 2 * c else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w
    return {(w, form[w], root(w), c, len(near[w]), n.get(form[w])) for w, c in n.items()}


def rows_of(frame):
    return {(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in frame.collect()}


@pytest.mark.parametrize(("letters", "low", "high", "n"), [("ab", 1, 7, 60), ("abcé÷", 2, 9, 400), ("a", 1, 9, 9), ("abcdefgh", 5, 10, 800)])
def test_index_finds_all_pairs_once(letters, low, high, n):
    rng = random.Random(1)
    words = ["".join(rng.choice(letters) for _ in range(rng.randint(low, high))) for _ in range(n)]
    words = list(dict.fromkeys(words + [w[:2] + "z" + w[2:] for w in words[:20]]))
    asked, index, counts = [*words, "qqqqq", "x" * 3000], m.Index(words), np.arange(len(words))
    got = [p for left in (False, True) for u, v, c in m.near_in_range(index, words, counts, asked, left) for p in zip(u, v, c.tolist(), strict=True)]
    assert len(got) == len(set(got))
    assert set(got) == {(u, v, k) for u in asked for k, v in enumerate(words) if one_edit(u, v)}


def test_equals_brute_force(spark, frame, monkeypatch):
    monkeypatch.setattr(m, "RANGE", 40)
    monkeypatch.setattr(m, "SEARCHES", 16)
    monkeypatch.setattr(m, "HELD", 50)
    rng = random.Random(5)
    stems = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(4, 9))) for _ in range(60)] + ["x" * 2000, "aaaaa", "aaaaaa", "aaaab", "ABCÀdef", "abcàdef"]
    slip = lambda w: w[:(k := rng.randrange(len(w)))] + rng.choice(["", "z", w[k] * 2]) + w[k + 1:]
    rows = [(k, " ".join((w if rng.random() < 0.7 else slip(w)) + rng.choice(["", ".", "中", "1x"]) for w in rng.choices(stems, [1 / (i + 1) for i in range(len(stems))], k=60))) for k in range(80)]
    rows += [(None, "hello hallo hello hallo hello hallo hello Hello hello"), (3, None), (4, ""), (5, "...")] + [rows[0]] * 3
    for every in (97, 3, None):
        assert rows_of(m.variants(frame(rows).repartition(3), every=every)) == brute(rows, every=every)
    chains = [(1, " ".join(["abcde"] * 40 + ["abcdf"] * 20 + ["abcgf"] * 10 + ["abhgf"] * 5))]
    assert {r.word: r.root for r in m.variants(frame(chains), every=None).collect()} == dict.fromkeys(["abcde", "abcdf", "abcgf", "abhgf"], "abcde")


def test_no_words(frame):
    for rows in ([], [(1, None), (2, "a b c 12345")]):
        got = m.variants(frame(rows))
        assert got.collect() == [] and got.columns == ["word", "form", "root", "n", "n_near", "form_n"]


def test_registered_query(spark):
    d = "/root/testdata/sf0.01"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect()]
    got = queries.op12_spelling_variants(spark, d)
    assert dict(got.dtypes) == {"word": "string", "form": "string", "root": "string", "n": "bigint", "n_near": "bigint", "form_n": "bigint"}
    assert rows_of(got) == brute(rows)
