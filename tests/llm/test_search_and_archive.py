"""Decontamination, archive and license scan against brute force."""

import base64
import hashlib
import random

import pytest

from vacantia.llm import decontaminate as d
from vacantia.llm import license_align as la
from vacantia.llm import warc_store as w


def test_even_budgets_are_kept():
    rng = random.Random(7)
    for n in (24, 29, 81, 45):
        item = "".join(rng.choice("abcdefgh") for _ in range(n))
        m = d.Matcher([item], 0.1, 8)
        assert m.budget == [min(n // 10, n // 8 - 1)] and m.budget[0] % 2 == 0
        for _ in range(40):
            text = list(item)
            for at in rng.sample(range(n), m.budget[0]):
                text[at] = "X"
            text = "zz " + "".join(text).lower() + " zz"
            assert [(i, k) for i, k, _, _ in m.matches(text)] == [(0, min(table_of(m.items[0], text)))]


def table_of(a, b):
    row, out = [0] * (len(b) + 1), []
    for i, x in enumerate(a, 1):
        before, row[0] = row[:], i
        for j, y in enumerate(b, 1):
            row[j] = min(before[j] + 1, row[j - 1] + 1, before[j - 1] + (x != y))
    out = row[1:]
    return out


def test_bit_parallel_distance():
    rng = random.Random(1)
    for _ in range(200):
        a, b = ("".join(rng.choice("ab ") for _ in range(rng.randint(1, n))) for n in (90, 60))
        assert list(d.myers(d.letter_masks(a), len(a), b)) == table_of(a, b)


@pytest.mark.parametrize("rate", [0.0, 0.05, 0.15])
def test_no_match_within_the_budget_is_lost(rate):
    rng = random.Random(5)
    items = ["".join(rng.choice("abcde ") for _ in range(rng.randint(1, 120))) for _ in range(8)]
    m = d.Matcher(items, rate, 6)
    for _ in range(150):
        text = []
        for _ in range(3):
            t = list(rng.choice(m.items) or "x")
            for _ in range(rng.randint(0, 12)):
                t[rng.randrange(len(t))] = rng.choice(["", "x", "yz", "a"])
            text.append("".join(t))
        text = d.normal(" ".join(text))
        want = {i: min(table_of(x, text)) for i, x in enumerate(m.items) if x and text and min(table_of(x, text)) <= m.budget[i]}
        got = m.matches(text)
        assert {i: k for i, k, _, _ in got} == want
        for i, k, a, z in got:
            assert list(d.myers(d.letter_masks(m.items[i]), len(m.items[i]), text[a:z], anchored=True) or [len(m.items[i])])[-1:] in ([k], [])


def test_contaminated(spark, frame):
    item = "The quick brown fox jumps over the lazy dog and runs away from the angry farmer."
    docs = frame([(1, f"before {item} after"), (2, f"BEFORE {item.upper()}"), (3, item.replace("quick", "quirk")), (4, "clean text of no interest"), (5, None), (6, ""), (None, item), (1, item), (7, ("pad " * 50_000) + item)])
    bench = spark.createDataFrame([(10, item, "t"), (10, item, "u"), (11, None, "t"), (12, " ", "t"), (None, "another benchmark item, which is nowhere", "t")], "item_id bigint, text string, id string")
    got = sorted((r["id"] is None, r["id"], r["item_id"], r["distance"]) for r in d.contaminated(docs, bench).collect())
    assert got == sorted([(False, 1, 10, 0), (False, 1, 10, 0), (False, 2, 10, 0), (False, 3, 10, 1), (False, 7, 10, 0), (True, None, 10, 0)])
    blocks = sorted((r["id"] is None, r["id"], r["item_id"], r["distance"]) for r in d.contaminated(docs, bench, block_bytes=64).collect())
    assert blocks == got
    assert d.contaminated(frame([]), bench).collect() == [] and d.contaminated(docs, bench.where("false")).collect() == []


def expected(rows, least=0):
    out = []
    for i, html in rows:
        x = (html or "").encode()
        same = [k for k, h in rows if (h or "").encode() == x and k is not None]
        top = max(same) if same else None
        own = len(x) < least or i == top
        out.append((i, len(x), base64.b32encode(hashlib.sha1(x).digest()).decode(), "response" if own else "revisit", None if own else top))
    return sorted(out, key=str)


@pytest.mark.parametrize("least", [0, 3])
def test_archive(spark, least):
    rows = [(1, "a<b>"), (2, "a<b>"), (7, "a<b>"), (3, None), (4, ""), (5, "ü\r\n\r\nWARC-Type: no"), (6, "x" * 200_000), (8, "x" * 200_000), (7, "a<b>"), (None, "a<b>"), (None, "only")]
    pages = spark.createDataFrame([(i, None if i == 4 else f"http://x/{i}\r\nX: y", h, "c", "c") for i, h in rows], "page_id bigint, url string, html string, digest string, id string")
    got = w.round_trip(pages, min_bytes=least)
    assert sorted(((r["id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got.collect()), key=str) == expected(rows, least)
    assert w.round_trip(pages.where("false")).collect() == []


def test_archive_keeps_payloads_once_and_notices_damage(spark, tmp_path):
    pages = spark.createDataFrame([(i, f"http://x/{i}", f"body {i % 3}") for i in range(30)], "page_id bigint, url string, html string")
    path = str(tmp_path / "a")
    w.write_archive(pages, path)
    payloads = spark.read.parquet(f"{path}/payloads")
    assert payloads.count() == 3
    records = w.parse(w.read_archive(spark, path)).collect()
    assert len(records) == 30 and {bytes(r["payload"]).decode() for r in records if r["warc_type"] == "response"} == {"body 0", "body 1", "body 2"}
    uris = {r["record_uri"] for r in records}
    assert len(uris) == 30 and all(r["refers_uri"] in uris for r in records if r["warc_type"] == "revisit")
    assert {r["target_uri"] for r in records} == {f"http://x/{i}" for i in range(30)}
    for r in records:
        head, block = bytes(r["record"]).split(b"\r\n\r\n", 1)
        length = int([x for x in head.split(b"\r\n") if x.startswith(b"Content-Length")][0].split(b": ")[1])
        assert block[length:] == b"\r\n\r\n"
    other = str(tmp_path / "b")
    payloads.withColumn("payload", payloads["payload"].substr(1, 3)).write.parquet(f"{other}/payloads")
    spark.read.parquet(f"{path}/headers").write.parquet(f"{other}/headers")
    with pytest.raises(Exception, match="damaged payload"):
        w.read_archive(spark, other).collect()


def test_patience():
    assert la.patience([], ["a"]) == []
    assert la.patience("x a b y c z".split(), "a b c".split()) == [(1, 0), (2, 1), (4, 2)]
    assert la.increasing([(0, 3), (1, 1), (2, 2), (3, 0)]) == [(1, 1), (2, 2)]
    rng = random.Random(2)
    for _ in range(200):
        a, b = ([rng.choice("abcdefgh") for _ in range(rng.randint(0, 12))] for _ in range(2))
        pairs = la.patience(a, b)
        assert all(a[i] == b[j] for i, j in pairs) and all(x[0] < y[0] and x[1] < y[1] for x, y in zip(pairs, pairs[1:], strict=False))


def test_license_scan(spark, frame):
    mit = la.TEMPLATES["MIT"]
    rows = [(1, f"code\n{mit}\nmore"), (2, mit.replace("free of charge", "at no cost").upper()), (3, "We got a driving license and some software."), (4, None), (5, ""),
            (6, "Licensed under CC BY-NC 4.0. " * 3), (None, "Released under the MIT License."), (7, "word " * 60_000 + "Released under the MIT License."), (6, "Licensed under CC BY-NC 4.0.")]
    got = sorted((str(r["id"]), r["license"], r["coverage"] == 1) for r in la.scan(frame(rows)).collect())
    assert got == [("1", "MIT", True), ("2", "MIT", False), ("6", "CC-BY-NC-4.0 notice", True), ("6", "CC-BY-NC-4.0 notice", True), ("7", "MIT notice", True), ("None", "MIT notice", True)]
    one = la.scan(frame(rows[:1])).first()
    assert rows[0][1][one["match_start"]:one["match_end"]].startswith("Permission is") and rows[0][1][one["match_start"]:one["match_end"]].endswith("NONINFRINGEMENT")
    assert la.scan(frame([])).collect() == [] and la.scan(frame(rows), {}).collect() == []
    assert la.scan(frame(rows), {"odd": "...", "one": "word"}).where("license = 'one'").count() == 1


def test_every_notice_has_a_row(spark, frame):
    nc, by, mit = (la.TEMPLATES[x] for x in ("CC-BY-NC-4.0 notice", "CC-BY-4.0 notice", "MIT notice"))
    both = [("CC-BY-4.0 notice", by), ("CC-BY-NC-4.0 notice", nc)]
    texts = [f"{nc} Some text between them. {by} The end.", f"{by} {nc}", f"{nc} {nc} {by} {nc}", f"{nc} {by}\n{mit}"]
    got = la.scan(frame(list(enumerate(texts)))).collect()
    for k, text in enumerate(texts):
        rows = sorted((r["license"], r["coverage"], text[r["match_start"]:r["match_end"]]) for r in got if r["id"] == k)
        assert rows == [(n, 1, x.rstrip(".")) for n, x in both] + [("MIT notice", 1, mit.rstrip("."))] * (k == 3)
