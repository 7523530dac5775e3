"""Near-duplicates and repeated passages against brute force."""

import random
from collections import Counter

import numpy as np
import pytest

from vacantia.llm import common, forest
from vacantia.llm import dart_minhash as m
from vacantia.llm import suffix_dedup as s


def test_darts_estimate_weighted_similarity():
    rng = np.random.default_rng(1)
    for share in (0.3, 0.8):
        hits = []
        for _ in range(12):
            x = rng.integers(1, 2**62, 500).astype(np.uint64)
            n = int(500 * share)
            hits.append(np.mean(np.equal(*m.signatures([x[:400], np.concatenate([x[:n], x[n + 100:]])[:400]]))))
        a, b = set(range(400)), {*range(n), *range(n + 100, 500)}
        b = set(sorted(b)[:400])
        assert abs(np.mean(hits) - len(a & b) / len(a | b)) < 0.06
    x = np.arange(1, 80, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for u, v in ((2.5, 1.5), (0.4, 0.3), (3.0, 3.0)):
        got = np.mean([np.mean(np.equal(*m.signatures([m.mix(x + np.uint64(k)), m.mix(x + np.uint64(k))], [np.full(79, u), np.full(79, v)]))) for k in range(10)])
        assert abs(got - v / u) < 0.06


def test_signatures_do_not_depend_on_company():
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(1, 2**62, n).astype(np.uint64)) for n in (1, 2, 30, 1000)]
    together = m.signatures(sets)
    assert all((m.signatures([x])[0] == t).all() for x, t in zip(sets, together, strict=True))


def classes(rows, threshold=0.8):
    sets = []
    for _, text in rows:
        words = (text or "").lower().split()
        n = min(5, len(words))
        sets.append({tuple(words[i:i + n]) for i in range(len(words) - n + 1)} if words else None)
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and len(sets[i] & sets[j]) >= threshold * len(sets[i] | sets[j]):
                up[root(i)] = root(j)
    ids = {}
    for i, (k, _) in enumerate(rows):
        if sets[i]:
            ids.setdefault(root(i), []).append(k)
    least = {r: min((k for k in v if k is not None), default=None) for r, v in ids.items()}
    return Counter((k, least[root(i)] if sets[i] else k, len(ids[root(i)]) if sets[i] else 1) for i, (k, _) in enumerate(rows))


def test_near_duplicates(spark, frame):
    rng = random.Random(4)
    text = lambda n: [f"w{rng.randrange(3000)}" for _ in range(n)]
    rows = [(i, " ".join(text(rng.randint(1, 80)))) for i in range(20)]
    base = text(150)
    for i in range(40):  # copies of a base that are alike only through it
        words = base[:]
        for _ in range(2):
            words[rng.randrange(150)] = f"x{i}"
        rows.append((100 + i, " ".join(words)))
    rows += [(200, " ".join(base)), (201, " ".join(base).upper()), (202, None), (203, ""), (204, " \n"), (205, "a b"), (206, "A  b"), (None, " ".join(base)), (None, "nobody else"), (205, "a b"), (7, "other text of id seven"),
             (300, " ".join(text(30_000)))]
    rows.append((301, rows[-1][1] + " tail"))
    got = Counter((r["id"], r["class_id"], r["class_size"]) for r in m.near_duplicates(frame(rows)).collect())
    assert got == classes(rows)
    assert m.near_duplicates(frame([])).collect() == []


def test_a_bucket_larger_than_its_parts(spark, frame, monkeypatch):
    monkeypatch.setattr(m, "PART", 8)
    rng = random.Random(6)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(120):
        words = base[:]
        words[rng.randrange(120)] = f"x{i}"
        rows.append((i, " ".join(words)))
    assert {r["class_id"] for r in m.near_duplicates(frame(rows)).collect()} == {0}


@pytest.mark.parametrize("side", [1 << 18, 1500])
def test_a_large_bucket_is_compared_completely(spark, frame, monkeypatch, side):
    monkeypatch.setattr(m, "FEW", 0)  # whatever the neighbours find
    monkeypatch.setattr(forest, "SIDE", side)  # elements of a block: seven texts of this test
    monkeypatch.setattr(forest, "TOGETHER", 4 * side)
    rng = random.Random(12)
    base, rows = [f"w{i}" for i in range(200)], []
    for i in range(40):  # pairs that are alike, on a template that is not alike enough to join them
        words = [*base[:100], *(f"p{i}_{j}" for j in range(24)), *base[100:]]
        for k in range(2):
            copy = words[:]
            copy[rng.randrange(len(copy))] = f"x{k}"
            rows.append((2 * i + k, " ".join(copy)))
    got = Counter((r["id"], r["class_id"], r["class_size"]) for r in m.near_duplicates(frame(rows)).collect())
    assert got == classes(rows)


def test_weighted_similarity(frame):
    """A repeated shingle counts as often as it stands there; brute force over multisets."""
    rng = random.Random(21)
    rows = []
    for k in range(30):
        line = [f"l{k}_{j}" for j in range(6)]
        own = [f"t{k}_{j}" for j in range(rng.choice([10, 30, 60]))]
        for copy in range(3):
            rows.append((3 * k + copy, " ".join(line * rng.choice([1, 5, 6, 20]) + own)))
    sets = [Counter(tuple(w[i:i + 5]) for i in range(len(w) - 4)) for w in (t.split() for _, t in rows)]
    up = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if (sets[i] & sets[j]).total() >= 0.8 * (sets[i] | sets[j]).total():
                old, new = max(up[i], up[j]), min(up[i], up[j])
                up = [new if x == old else x for x in up]
    got = {r["id"]: r["class_id"] for r in m.near_duplicates(frame(rows), weighted=True).collect()}
    assert got == {k: up[k] for k in range(len(rows))}
    assert got != {r["id"]: r["class_id"] for r in m.near_duplicates(frame(rows)).collect()}


def test_links_of_a_block_are_a_forest():
    rng = np.random.default_rng(3)
    base = rng.integers(1, 2**62, 60)
    sets = [np.unique(np.concatenate([base[rng.permutation(60)[:rng.integers(50, 60)]], rng.integers(1, 2**62, 4)])) for _ in range(40)]
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in sets + sets[30:]])])
    found = forest.links_of_block(np.concatenate(sets + sets[30:]), offsets, 40, np.array([*range(40), *range(30, 40)]), lambda c, both: c >= 0.8 * (both - c))
    common = lambda i, j: len(np.intersect1d(sets[i], sets[j]))
    true = {(i, j) for i in range(30, 40) for j in range(40) if i != j and common(i, j) >= 0.8 * (len(sets[i]) + len(sets[j]) - common(i, j))}
    assert len(found) < 40 and {(k - 10, r) for k, r in found} <= true
    label = list(range(40))
    for edges in ({(k - 10, r) for k, r in found}, true):
        now = list(range(40))
        for i, j in edges:
            now = [min(now[i], now[j]) if x in (now[i], now[j]) else x for x in now]
        label, before = now, label
    assert label == before


def test_components(spark):
    rng, edges = random.Random(1), [(i, i + 1) for i in range(60)] + [(100, 200), (300, 200), (400, 400)]
    rng.shuffle(edges)
    got = {r["node"]: r["component"] for r in common.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {i: 0 for i in range(61)} | {100: 100, 200: 100, 300: 100, 400: 400}
    assert common.components(spark.createDataFrame([], "a bigint, b bigint")).collect() == []


def brute(rows, length, keep):
    order = sorted(((i, (t or "").encode()) for i, t in rows), key=lambda x: (x[0] is not None, x[0] or 0))
    count, first = Counter(), {}
    for i, b in order:
        for j in range(len(b) - length + 1):
            count[b[j:j + length]] += 1
            first.setdefault(b[j:j + length], (i, b, j))
    out = []
    for i, b in order:
        gone = bytearray(len(b))
        for j in range(len(b) - length + 1):
            w = b[j:j + length]
            if count[w] > 1 if keep == "none" else first[w] != (i, b, j):
                gone[j:j + length] = b"\1" * length
        out.append((str(i), len(b), sum(gone), bytes(x for x, g in zip(b, gone, strict=True) if not g)))
    return sorted(out)


@pytest.mark.parametrize("keep", ["none", "first"])
@pytest.mark.parametrize("most", [1 << 19, 0])
def test_repeats(spark, frame, monkeypatch, keep, most):
    monkeypatch.setattr(s, "ANCHOR_MOST", most)  # 0: every anchor is spread
    rng = random.Random(9)
    letters = lambda n: "".join(rng.choice("abcé \n") for _ in range(n))
    passages = [letters(n) for n in (20, 39, 40, 41, 60, 200)]
    rows = [(i, letters(rng.randint(0, 60)) + rng.choice(passages) + letters(rng.randint(0, 30)) + rng.choice(passages)) for i in range(40)]
    rows += [(50, None), (51, ""), (52, "x" * 39), (53, "ab" * 90), (54, "y" * 300), (55, rows[0][1]), (55, rows[0][1]), (55, "z" + rows[0][1]), (None, rows[1][1]), (None, "once " * 30), (56, letters(30_000) + passages[5])]
    got = [(str(r["id"]), r["n_bytes"], sum(x["end"] - x["start"] for x in r["spans"]), bytes(r["kept"])) for r in s.remove_repeats(frame(rows), length=40, keep=keep).collect()]
    assert sorted(got) == brute(rows, 40, keep)
    assert all(a["end"] < b["start"] for r in s.remove_repeats(frame(rows[:12]), length=40, keep=keep).collect() for a, b in zip(r["spans"], r["spans"][1:], strict=False))
    assert s.remove_repeats(frame([]), length=40, keep=keep).collect() == []


def test_runs_cover_each_window_once_in_long_texts():
    rng = random.Random(3)
    texts = ["".join(rng.choice("ab") for _ in range(n)).encode() for n in (0, 15, 16, 17, 500, 3000)]
    seen = Counter()
    for group in s.chunks(texts, 16, most=200):
        size = np.array([len(p) for _, _, p in group])
        ends = np.cumsum(size)
        of, a, z, *_ = s.runs_of(np.frombuffer(b"".join(p for _, _, p in group), np.uint8), ends - size, ends, 16)
        for k, x, y in zip(of, a, z, strict=True):
            row, at, _ = group[k]
            seen.update((row, at + int(w - (ends - size)[k])) for w in range(x, y + 1))
    assert seen == Counter((row, w) for row, t in enumerate(texts) for w in range(len(t) - 15))


def test_equal_windows_share_an_anchor():
    rng = random.Random(8)
    passage = "".join(rng.choice("abcd") for _ in range(64))
    texts = [("".join(rng.choice("abcd") for _ in range(rng.randint(0, 50))) + passage + "".join(rng.choice("abcd") for _ in range(30))).encode() for _ in range(20)]
    anchors = []
    for t in texts:
        of, a, z, anchor, _ = s.runs_of(np.frombuffer(t, np.uint8), np.array([0]), np.array([len(t)]), 64)
        at = t.index(passage.encode())
        anchors.append([int(h) for x, y, h in zip(a, z, anchor, strict=True) if x <= at <= y])
    assert len({tuple(x) for x in anchors}) == 1


def test_previous_and_next_factors():
    rng = random.Random(1)
    for _ in range(30):
        runs = ["".join(rng.choice("ab") for _ in range(rng.randint(16, 60))).encode() for _ in range(6)]
        of, before, after = s.factors(runs, [len(r) - 15 for r in runs], 16)
        windows = [r[j:j + 16] for r in runs for j in range(len(r) - 15)]
        assert [w in windows[:k] for k, w in enumerate(windows)] == before.tolist()
        assert [w in windows[k + 1:] for k, w in enumerate(windows)] == after.tolist()
