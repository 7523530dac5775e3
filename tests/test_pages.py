from urllib.parse import urljoin

from pyspark.sql import functions as F

from vacantia.operators import pages as pg

PAGE = """<html><head><title> A &amp; B </title><meta name="description" content="short"><meta property="og:site" content="S">
<script type="application/ld+json">{"@type": "JobPosting", "title": "LD", "datePosted": "2024-01-02", "employmentType": "Full Time, Fixed-Term",
"hiringOrganization": {"name": "Org"}, "baseSalary": {"currency": "GBP", "value": {"minValue": 1000, "maxValue": 2500.9}}}</script></head>
<body><nav><p>This navigation paragraph is long enough.</p></nav><h1>Head</h1><p class="lead">Uni – Dept</p>
<table><tr><th>Closes:</th><td>9th May</td></tr><tr><th>Advert ID</th><td>77</td></tr></table>
<div><strong>REQUIREMENTS</strong></div><p>Needs a lot of Python skill.</p><div><strong>BENEFITS</strong></div><p>Lunch for everybody here.</p>
<h2>Person Specification</h2><p>Somebody with long experience.</p><ul><li>one</li><li>two</li></ul><a href="/apply" id="apply-link">go</a></body></html>"""
JOB = """<script>var job = {"job": {"employer_name": "E", "salary_min": 10, "salary_max": 20, "salary_comment": "pa", "job_types": [{"category_name": "T"}],
"subject_areas": {"a": {"category_name": "S1"}, "b": {"category_name": "S2"}}}};</script><p>Some paragraph of at least twenty.</p>"""


def frame(spark):
    return spark.createDataFrame([(1, "https://www.jobs.ac.uk/x", PAGE), (2, "https://jobs.ac.uk/y", JOB), (3, "https://a.example/z", PAGE), (4, "https://a.example/w", "")],
                                 "page_id bigint, url string, html string")


def test_pieces(spark):
    d = pg.parse_pages(frame(spark).withColumn("url", F.lit("https://h.example/a/")), resolve_links=True).filter("page_id = 1").first()
    assert d.title == "A & B" and d.og == {"site": "S"} and d.meta_description == "short"
    assert d.tables == {"closing_date": "9th May", "job_ref": "77"}
    assert d.upper_sections == {"REQUIREMENTS": "Needs a lot of Python skill.", "BENEFITS": "Lunch for everybody here.\nPerson Specification\nSomebody with long experience."}
    assert d.heading_sections == {"Person Specification": "Somebody with long experience."}
    assert d.ul == [["one", "two"]] and d.links[0].url == "https://h.example/apply"
    assert not any("navigation" in p for p in d.paragraphs) and "navigation" not in d.main_text


def test_links_resolve_like_the_library(spark):
    links = ["x", "./x", "../x", "../../x", "/r", "//o.example/p", "?q=1", "#f", "", "http://z.example/", "mailto:a@b", "x/../y"[:1], "a/b?c=../d"]
    bases = ["https://h.example", "https://h.example/", "https://h.example/a/b/c.html?x=1#y", "https://h.example/a/b/"]
    rows = [(b, x) for b in bases for x in links]
    got = spark.createDataFrame(rows, "b string, x string").select("b", "x", pg.resolve("b", F.col("x")).alias("r")).collect()
    wrong = [(r.b, r.x, r.r, urljoin(r.b, r.x)) for r in got if r.r != urljoin(r.b, r.x) and "../" not in r.x]
    assert not wrong
    assert [r.r for r in got if r.b == bases[2] and "../" in r.x] == ["https://h.example/a/x", "https://h.example/x", "https://h.example/a/b/a/b?c=../d"]


def test_record_priority(spark):
    r = {x.page_id: x for x in pg.posting_record(pg.parse_pages(frame(spark))).collect()}
    assert (r[1].title, r[1].employer, r[1].hours, r[1].contract_type) == ("LD", "Org", "Full Time", "Fixed-Term")
    assert r[1].salary == "£1,000 to £2,500" and r[1].closing_date == "9th May" and r[1].apply_url == "/apply"
    assert r[1].requirements.startswith("Needs a lot of Python skill.")
    assert (r[2].employer, r[2].salary, r[2].job_type, r[2].subcategory) == ("E", "£10 to £20 pa", "T", "S1, S2")


def test_enrichment(spark):
    fields = pg.page_fields(pg.parse_pages(frame(spark)))
    posts = spark.createDataFrame([("p1", "adzuna", "https://a.example/w", "https://a.example/z", None, "Old"), ("p2", "other", "ftp://x", None, None, None),
                                   ("p3", "other", "https://a.example/w", None, None, None)],
                                  "job_id string, source string, url string, redirect_url string, apply_url string, full_description string")
    got = {r.job_id: r for r in pg.enrich(posts, fields, min_chars=40).collect()}
    assert got["p1"].outcome == "ok" and got["p1"].new_description.startswith("Old\n\n---") and "[Person Specification]" in got["p1"].new_description
    assert got["p2"].outcome == "no_http_url" and got["p3"].outcome == "too_short" and got["p3"].new_description is None


def test_pages_are_shuffled_once_and_not_written(spark):
    import os
    kept = spark.conf.get("spark.checkpoint.dir")
    before = set(os.listdir(kept))
    plan = pg.parse_pages(frame(spark))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and set(os.listdir(kept)) == before


def test_rows_of_one_page_count_together_and_without_an_id_say_nothing(spark):
    html = "<html><head><title>T</title></head><body><p>Some paragraph of at least twenty.</p><ul><li>x</li></ul></body></html>"
    rows = spark.createDataFrame([(1, "u", html), (1, "v", html), (2, "w", html), (None, "n", html), (3, "z", None)], "page_id bigint, url string, html string")
    got = {r.url: r for r in pg.parse_pages(rows).collect()}
    assert [got[u].title for u in "uvwnz"] == ["TT", "TT", "T", None, None]
    assert got["u"].ul == [["xx"] * 4] and got["w"].ul == [["x"]] and got["n"].paragraphs == [] and got["n"].main_text == ""
    assert got["w"].paragraphs == ["Some paragraph of at least twenty."] and len(got["u"].paragraphs) == 2
