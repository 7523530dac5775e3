"""Loose records and landed pages."""

from pyspark.sql import functions as F

from vacantia.functions import text as tx
from vacantia.operators import loose as lo
from vacantia.operators import pages as pg
from vacantia.plans.bindings import bind, duck
from vacantia.sources import readers as rd
from vacantia.util import r6, read_table

from .merge import UNIFIED, unified

LOOSE_SQL = """SELECT o_orderkey AS rec_id, c_name AS company, n_name AS city, o_orderpriority AS prio, c_mktsegment AS seg,
  CAST(CAST(floor(o_totalprice / 10) AS BIGINT) AS STRING) AS amount FROM {orders} JOIN {customer} ON o_custkey = c_custkey JOIN {nation} ON c_nationkey = n_nationkey"""


def loose(s, d):
    base = bind(s, d, LOOSE_SQL)
    is_ = lambda p: F.col("prio") == p
    fields = F.map_filter(F.create_map(
        F.lit("Company Name"), F.col("company"), F.lit("company"), F.concat(F.lit("c"), F.substring("company", 1, 3)), F.lit("City:"), F.col("city"),
        F.lit("Funding Amount"), F.when(is_("1-URGENT"), F.concat(F.lit(" £"), "amount")),
        F.lit("about"), F.when(is_("3-MEDIUM"), F.concat(F.lit("The team pays £"), "amount", F.lit(" per annum, plus a good pension scheme"))).otherwise(F.col("seg")),
        F.lit("Required-Skills"), F.col("seg"), F.lit("Grade / Band"), F.col("prio")), lambda k, v: v.isNotNull())
    sections = F.create_map(F.lit("Pay and Benefits"), F.when(is_("2-HIGH"), F.concat(F.lit("up to €"), "amount", F.lit(" and more"))).when(is_("5-LOW"), F.lit("on request ")))
    return base.select("rec_id", fields.alias("fields"), sections.alias("sections"))


def normalized(s, d):
    out = lo.normalize_records(loose(s, d), lo.alias_table(s, {"band": ["Grade / Band"]}))
    get = lambda k: F.try_element_at("normalized", F.lit(k))
    return out.select("rec_id", *[get(k).alias(k) for k in ("employer", "location", "salary", "skills", "description", "band")], F.map_contains_key("normalized", "title").alias("has_title"))


def key_names(s, d):
    rows = loose(s, d).select(F.explode(F.map_keys("fields")).alias("raw")).distinct()
    return rows.select("raw", lo.normalize_key("raw").alias("key"))


def salary_texts(s, d):
    u = unified(s, d)
    return u.select("job_id", tx.salary_phrase(F.concat_ws(" ", F.lit("pays"), "salary", "description")).alias("phrase"))


def pages(s, d):
    return read_table(s, d, "pages")


def parsed(s, d):
    return pg.parse_pages(pages(s, d))


def links(s, d):
    return pg.link_table(parsed(s, d)).select("page_id", "url", "text")


def hosts(s, d):
    out = pg.link_table(pg.parse_pages(pages(s, d), resolve_links=True))
    return out.groupBy(pg.host("url").alias("host"), pg.host_class("url").alias("kind")).agg(F.count(F.lit(1)).alias("n"))


def meta(s, d):
    return parsed(s, d).select("page_id", "title", "h1", F.size("og").alias("n_og"))


def lists(s, d):
    return parsed(s, d).select("page_id", F.posexplode(F.flatten("ul")).alias("pos", "item"))


def paragraphs(s, d):
    return parsed(s, d).select("page_id", F.size("paragraphs").alias("n"), F.char_length(F.array_join("paragraphs", "\n\n")).alias("chars"), F.char_length("main_text").alias("main_chars"))


PORTAL_SQL = "SELECT p_partkey AS page_id, p_name, p_type, p_brand, 'Box ' || CAST(p_size AS STRING) AS pack, CAST(p_size AS STRING) AS size, p_partkey % 3 AS form FROM {part}"


def portal_pages(s, d):
    """Pages of a portal written from the parts: tables, sections, tags, and embedded JSON, JSON-LD or neither by turns."""
    t = lambda x: F.lit(x)
    base = bind(s, d, PORTAL_SQL)
    ld = F.concat(t('<script type="application/ld+json">{"@type": "JobPosting", "title": "LD '), "p_name", t('", "employmentType": "Full Time, Permanent", "hiringOrganization": {"name": "'), "p_brand",
                  t('"}, "baseSalary": {"currency": "GBP", "value": {"minValue": '), "size", t(', "maxValue": 90000}}}</script>'))
    js = F.concat(t('<script>var job = {"job": {"title": "JS '), "p_name", t('", "employer_name": "'), "pack", t('", "salary_min": '), "size", t(', "salary_max": 99, "job_types": [{"category_name": "'), "p_type", t('"}]}};</script>'))
    html = F.concat(
        t("<html><head><title> "), "p_name", t(' &amp; co </title><meta property="og:title" content="'), "p_type", t('"><meta name="description" content="'), "p_brand", t('">'),
        F.when(F.col("form") == 0, ld).when(F.col("form") == 1, js).otherwise(""), t("</head><body><nav><p>This menu is long enough to count.</p></nav><h1>Head "), "p_name",
        t("</h1><table><tr><th>Closes:</th><td> "), "size", t(" May</td></tr><tr><th>Pack Type</th><td>"), "pack", t("</td></tr></table><div><strong>REQUIREMENTS</strong></div><p>Needs <b>"), "p_type",
        t("</b> at hand, always.</p><h2>Person Specification</h2><p>Somebody who knows "), "p_brand", t(" well.</p><footer>Closing words of the site.</footer></body></html>"))
    return base.select("page_id", F.concat(t("https://www.jobs.ac.uk/job/"), F.col("page_id").cast("string")).alias("url"), html.alias("html"))


def portal_pieces(s, d):
    get = lambda c, k: F.try_element_at(c, F.lit(k))
    return pg.parse_pages(portal_pages(s, d)).select(
        "page_id", "title", "meta_description", get("og", "title").alias("og_title"), get("tables", "closing_date").alias("closes"), get("tables", "pack_type").alias("pack"), get("upper_sections", "REQUIREMENTS").alias("upper"),
        get("heading_sections", "Person Specification").alias("heading"), F.array_join("paragraphs", "|").alias("paragraphs"), "main_text")


def portal_records(s, d):
    return pg.posting_record(pg.parse_pages(portal_pages(s, d))).select("page_id", "title", "employer", "salary", "hours", "job_type", "closing_date", "requirements")


def portal_fields(s, d):
    f = pg.page_fields(pg.parse_pages(portal_pages(s, d)))
    return f.select("page_id", "host_class", pg.supplement(f).alias("supplement"))


def script_vars(s, d):
    return pages(s, d).select("page_id", pg.script_variable("html", "t").alias("t"), pg.script_variable("html", "missing").alias("missing"))


def records(s, d):
    return pg.posting_record(parsed(s, d)).select("page_id", "title", "employer", F.char_length("full_description").alias("chars"))


def fields_by_host(s, d):
    f = pg.page_fields(parsed(s, d))
    return f.select("page_id", "host_class", F.char_length(pg.supplement(f)).alias("chars"))


def page_postings(s, d):
    """Postings that point at the landed pages."""
    p = pages(s, d).withColumn("nxt", F.col("page_id") + 1)
    q = pages(s, d).select(F.col("page_id").alias("nxt"), F.col("url").alias("other"))
    return p.join(q, "nxt", "left").select(
        F.concat_ws("-", F.lit("p"), "page_id").alias("job_id"), F.when(F.col("url").like("%m.%"), "adzuna").otherwise("jobs_ac_uk").alias("source"), "url",
        F.col("other").alias("redirect_url"), F.lit("ftp://x").alias("apply_url"), F.lit(None).cast("string").alias("requirements"), F.lit("Base").alias("full_description"))


def link_candidates(s, d):
    return pg.candidate_links(unified(s, d)).select("job_id", "pos", "url")


def needs(s, d):
    return unified(s, d).filter(pg.needs_enrichment()).select("job_id")


#: Postings with links to the portal's pages: their own, a page that never landed, a neighbour's, or none that is http.
LINKED_SQL = """SELECT p_partkey, 'p-' || CAST(p_partkey AS STRING) AS job_id, CASE WHEN p_partkey % 3 = 0 THEN 'adzuna' ELSE 'jobs_ac_uk' END AS source,
  CASE WHEN p_partkey % 4 = 1 THEN 'ftp://x' ELSE 'https://www.jobs.ac.uk/job/' || CAST(p_partkey AS STRING) END AS url, 'https://gone.example.org/' || CAST(p_partkey AS STRING) AS redirect_url,
  CASE WHEN p_partkey % 2 = 0 THEN 'https://www.jobs.ac.uk/job/' || CAST(p_partkey + 1 AS STRING) END AS apply_url, CAST(NULL AS STRING) AS requirements,
  CASE WHEN p_partkey % 5 = 0 THEN ' ' ELSE 'Base ' || p_name END AS full_description FROM {part}"""


def enriched_rows(s, d):
    return pg.enrich(bind(s, d, LINKED_SQL), pg.page_fields(pg.parse_pages(portal_pages(s, d))), min_chars=185)


def enriched(s, d):
    return enriched_rows(s, d).select("job_id", "outcome", "used_url", "new_description")


def outcomes(s, d):
    return pg.outcome_report(enriched_rows(s, d))


def landed_outcomes(s, d):
    """Outcomes over the landed pages themselves, whatever they hold."""
    return pg.outcome_report(pg.enrich(page_postings(s, d), pg.page_fields(parsed(s, d))))


def cleaned(s, d):
    return pages(s, d).select("page_id", F.md5(tx.clean_text("html")).alias("digest"))


def landed_json(s, d):
    from vacantia.util import shared_dir
    path = shared_dir(s, "api-json")
    src = bind(s, d, """SELECT CAST(l_orderkey AS STRING) || '-' || CAST(l_linenumber AS STRING) || '-' || CAST(l_partkey AS STRING) AS id, p_name AS title, s_name, n_name, r_name, p_type, l_extendedprice AS salary_max, l_shipdate
        FROM {lineitem} JOIN {part} ON l_partkey = p_partkey JOIN {supplier} ON l_suppkey = s_suppkey JOIN {nation} ON s_nationkey = n_nationkey JOIN {region} ON n_regionkey = r_regionkey""")
    src.select("id", "title", F.struct(F.col("s_name").alias("display_name")).alias("company"),
               F.struct(F.col("n_name").alias("display_name"), F.array("r_name", "n_name").alias("area")).alias("location"),
               F.struct(F.col("p_type").alias("label")).alias("category"), "salary_max",
               F.date_format("l_shipdate", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("created")).write.json(path)
    return rd.read_api(s, path).select("job_id", "title", "company", "location", "area", "category", F.col("salary_max").cast("double").alias("salary_max"), F.col("created").cast("timestamp_ntz").alias("created"))


def overlay(s, d):
    feed = bind(s, d, "SELECT CAST(o_orderkey AS STRING) AS url, o_orderpriority AS title, o_orderstatus AS employer, '' AS salary, CAST(NULL AS STRING) AS hours FROM {orders}")
    feed = feed.withColumn("job_id", rd.feed_id("url"))
    page = bind(s, d, "SELECT CAST(l_orderkey AS STRING) AS url, max(l_returnflag) AS employer, max(l_linestatus) AS title, max(CASE WHEN l_quantity > 45 THEN '£9' ELSE '' END) AS salary, min(l_linestatus) AS hours FROM {lineitem} GROUP BY l_orderkey")
    page = page.withColumn("job_id", rd.feed_id("url")).drop("url")
    return rd.overlay_pages(feed, page).select("url", "job_id", "title", "employer", "salary", "hours")


def polling(s, d):
    """Entries of the second polling round that the first one did not bring."""
    ev = bind(s, d, "SELECT event_id, ts, 'https://e.example/' || CAST(user_id AS STRING) || '/' || event_type || props AS url FROM {events}").withColumn("job_id", rd.feed_id("url"))
    first, second = ev.filter("ts < '2024-01-16'"), ev.filter("ts >= '2024-01-16'")
    return second.join(first.select("job_id").distinct(), "job_id", "left_anti").select("event_id", "job_id")


def dates(s, d):
    u = bind(s, d, "SELECT o_orderkey, CAST(day(o_orderdate) AS STRING) || 'th ' || CASE month(o_orderdate) WHEN 9 THEN 'Sept' WHEN 3 THEN 'March' ELSE 'January' END || ' ' || CAST(year(o_orderdate) AS STRING) AS a, CAST(day(o_orderdate) AS STRING) || '/' || CAST(month(o_orderdate) AS STRING) || '/' || CAST(year(o_orderdate) AS STRING) AS b FROM {orders}")
    return u.select("o_orderkey", tx.parse_timestamp("a").cast("date").cast("string").alias("a"), tx.parse_timestamp("b").cast("date").cast("string").alias("b"))


def numbers(s, d):
    u = unified(s, d)
    n = tx.all_numbers("salary")
    return u.select("job_id", tx.first_number("salary").alias("first"), F.array_min(n).alias("lo"), F.array_max(n).alias("hi"))


QUERIES = {
    "p11_key_names": key_names,
    "p12_p14_e02_loose_records": normalized,
    "p13_salary_phrase": salary_texts,
    "p15_c10_numbers_in_text": numbers,
    "p22_human_dates": dates,
    "p23_clean_text": cleaned,
    "s03_landed_api_json": landed_json,
    "s04_overlay_page_fields": overlay,
    "j21_second_round_entries": polling,
    "h01_h03_tables_and_sections": lambda s, d: parsed(s, d).select("page_id", F.size("tables").alias("n_tables"), F.size("upper_sections").alias("n_upper"),
                                                                  F.size("heading_sections").alias("n_heading")),
    "h01_h09_portal_pieces": portal_pieces,
    "h08_h10_portal_records": portal_records,
    "h11_c25_portal_fields": portal_fields,
    "h02_meta_and_titles": meta,
    "h04_h09_paragraphs_and_main_text": paragraphs,
    "h05_list_items": lists,
    "h06_links": links,
    "h06_f17_link_hosts": hosts,
    "h07_h08_script_variables": script_vars,
    "h10_posting_record": records,
    "h11_c25_fields_by_host": fields_by_host,
    "f07_needs_enrichment": needs,
    "f17_candidate_links": link_candidates,
    "j19_enrich_from_pages": enriched,
    "a23_enrichment_outcomes": outcomes,
    "a23_landed_page_outcomes": landed_outcomes,
}
W = f"WITH {UNIFIED}"
_SALP = "coalesce(" + ", ".join(f"nullif(regexp_extract(x, '(?i){p}', 0), '')" for p in tx.SALARY_PATTERNS) + ")"
_T = "trim(replace(regexp_extract(html, '<title>(.*?)</title>', 1), '&amp;', '&'))"
LOOSE = f"lr AS ({duck(LOOSE_SQL)})"
_SUP = r"""sup AS (SELECT p_partkey AS page_id, concat_ws(chr(10) || chr(10), needs || ' Person Specification ' || person || ' Closing words of the site.', needs || ' ' || person,
  '[REQUIREMENTS]' || chr(10) || concat_ws(chr(10), needs, 'Person Specification', person, 'Closing words of the site.')) AS supplement
  FROM (SELECT p_partkey, 'Needs' || p_type || 'at hand, always.' AS needs, 'Somebody who knows ' || p_brand || ' well.' AS person FROM part))"""
_ENRICHED = f"""{_SUP}, posts_ AS ({duck(LINKED_SQL)}),
  tries AS (SELECT job_id, unnest(CASE WHEN source = 'adzuna' THEN [redirect_url, apply_url, url] ELSE [url] END) AS link, unnest(CASE WHEN source = 'adzuna' THEN [1, 2, 3] ELSE [3] END) AS pos FROM posts_),
  judged AS (SELECT job_id, link, pos, supplement, CASE WHEN supplement IS NULL THEN 'missing' WHEN length(supplement) < 185 THEN 'too_short' ELSE 'ok' END AS state
    FROM tries LEFT JOIN sup ON link = 'https://www.jobs.ac.uk/job/' || page_id WHERE link LIKE 'http%' QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY state <> 'ok', pos) = 1),
  enriched_ AS (SELECT p.job_id, coalesce(state, 'no_http_url') AS outcome, link AS used_url, CASE WHEN state = 'ok' THEN CASE WHEN trim(full_description) <> '' THEN trim(full_description) || chr(10) || chr(10) || '--- [added from posting page] ---' || chr(10) || chr(10) || supplement ELSE supplement END END AS new_description
    FROM posts_ p LEFT JOIN judged j ON j.job_id = p.job_id)"""
ORACLE = {
    "j19_enrich_from_pages": f"WITH {_ENRICHED} SELECT job_id, outcome, used_url, new_description FROM enriched_",
    "a23_enrichment_outcomes": f"WITH {_ENRICHED} SELECT outcome, count(*) AS n, round(count(*) / (SELECT count(*) FROM enriched_), 6) AS rate FROM enriched_ GROUP BY 1",
    "h01_h03_tables_and_sections": """SELECT page_id, CAST(len(regexp_extract_all(html, '<tr')) AS INT) AS n_tables, CAST(len(regexp_extract_all(html, '<strong')) AS INT) AS n_upper,
        CAST(len(regexp_extract_all(html, '<h[23]')) AS INT) AS n_heading FROM pages""",
    "h01_h09_portal_pieces": r"""WITH p AS (SELECT *, 'Needs' || p_type || 'at hand, always.' AS needs, 'Somebody who knows ' || p_brand || ' well.' AS person FROM part)
        SELECT p_partkey AS page_id, p_name || ' & co' AS title, p_brand AS meta_description, p_type AS og_title, p_size || ' May' AS closes, 'Box ' || p_size AS pack, needs || chr(10) || 'Person Specification' || chr(10) || person || chr(10) || 'Closing words of the site.' AS upper,
        person AS heading, needs || '|' || person AS paragraphs, concat_ws(chr(10), 'Head ' || p_name, 'Closes:', p_size || ' May', 'Pack Type', 'Box ' || p_size, 'REQUIREMENTS', 'Needs', p_type, 'at hand, always.', 'Person Specification', person) AS main_text FROM p""",
    "h08_h10_portal_records": r"""SELECT p_partkey AS page_id, CASE p_partkey % 3 WHEN 0 THEN 'LD ' || p_name WHEN 1 THEN 'JS ' || p_name ELSE 'Head ' || p_name END AS title, CASE p_partkey % 3 WHEN 0 THEN p_brand WHEN 1 THEN 'Box ' || p_size END AS employer,
        CASE p_partkey % 3 WHEN 0 THEN '£' || p_size || ' to £90,000' WHEN 1 THEN '£' || p_size || ' to £99' END AS salary, CASE WHEN p_partkey % 3 = 0 THEN 'Full Time' END AS hours, CASE WHEN p_partkey % 3 = 1 THEN p_type END AS job_type,
        p_size || ' May' AS closing_date, 'Needs' || p_type || 'at hand, always. Person Specification Somebody who knows ' || p_brand || ' well. Closing words of the site.' AS requirements FROM part""",
    "h11_c25_portal_fields": r"""WITH p AS (SELECT p_partkey AS page_id, 'Needs' || p_type || 'at hand, always.' AS needs, 'Somebody who knows ' || p_brand || ' well.' AS person FROM part)
        SELECT page_id, 'portal_a' AS host_class, concat_ws(chr(10) || chr(10), needs || ' Person Specification ' || person || ' Closing words of the site.', needs || ' ' || person,
          '[REQUIREMENTS]' || chr(10) || concat_ws(chr(10), needs, 'Person Specification', person, 'Closing words of the site.')) AS supplement FROM p""",
    "p11_key_names": f"""WITH lr AS ({duck(LOOSE_SQL)}), k AS (SELECT unnest(['Company Name', 'company', 'City:', 'about', 'Required-Skills', 'Grade / Band']) AS raw FROM lr UNION SELECT 'Funding Amount' FROM lr WHERE prio = '1-URGENT')
        SELECT DISTINCT raw, trim(regexp_replace(replace(replace(replace(replace(lower(raw), ' ', '_'), '-', '_'), ':', ''), '/', '_'), '_+', '_', 'g'), '_') AS key FROM k""",
    "p12_p14_e02_loose_records": f"""WITH {LOOSE} SELECT rec_id, company AS employer, city AS location, CASE prio WHEN '1-URGENT' THEN ' £' || amount WHEN '2-HIGH' THEN '€' || amount WHEN '5-LOW' THEN 'on request'
        WHEN '3-MEDIUM' THEN '£' || amount || ' per' END AS salary, seg AS skills, CASE WHEN prio = '3-MEDIUM' THEN 'The team pays £' || amount || ' per annum, plus a good pension scheme' ELSE seg END AS description, prio AS band, true AS has_title FROM lr""",
    "p13_salary_phrase": f"{W}, q AS (SELECT job_id, concat_ws(' ', 'pays', salary, description) AS x FROM unified) SELECT job_id, trim({_SALP}) AS phrase FROM q",
    "p15_c10_numbers_in_text": f"""{W}, q AS (SELECT job_id, list_transform(regexp_extract_all(salary, '\\d[\\d,]*\\.?\\d*'), lambda x: CAST(replace(x, ',', '') AS DOUBLE)) AS n FROM unified)
        SELECT job_id, n[1] AS first, list_min(n) AS lo, list_max(n) AS hi FROM q""",
    "p22_human_dates": "SELECT o_orderkey, strftime(make_date(year(o_orderdate), CASE month(o_orderdate) WHEN 9 THEN 9 WHEN 3 THEN 3 ELSE 1 END, day(o_orderdate)), '%Y-%m-%d') AS a, strftime(o_orderdate, '%Y-%m-%d') AS b FROM (SELECT o_orderkey, o_orderdate FROM orders)",
    "p23_clean_text": r"""SELECT page_id, md5(replace(replace(replace(replace(replace(replace(trim(regexp_replace(coalesce(html, ''), '[\s\x0B]+', ' ', 'g')), '&nbsp;', ' '), '&amp;', '&'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#039;', chr(39))) AS digest FROM pages""",
    "s03_landed_api_json": """SELECT CAST(l_orderkey AS VARCHAR) || '-' || CAST(l_linenumber AS VARCHAR) || '-' || CAST(l_partkey AS VARCHAR) AS job_id, p_name AS title, s_name AS company, n_name AS location, r_name || ', ' || n_name AS area, p_type AS category,
        l_extendedprice AS salary_max, date_trunc('second', l_shipdate) AS created FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
    "s04_overlay_page_fields": """WITH p AS (SELECT l_orderkey AS k, max(l_returnflag) AS e, max(CASE WHEN l_quantity > 45 THEN '£9' ELSE '' END) AS s, min(l_linestatus) AS h FROM lineitem GROUP BY 1)
        SELECT CAST(o_orderkey AS VARCHAR) AS url, md5(CAST(o_orderkey AS VARCHAR)) AS job_id, o_orderpriority AS title, coalesce(e, o_orderstatus) AS employer, coalesce(nullif(s, ''), '') AS salary, h AS hours FROM orders LEFT JOIN p ON k = o_orderkey""",
    "j21_second_round_entries": """WITH ev AS (SELECT event_id, ts, md5('https://e.example/' || CAST(user_id AS VARCHAR) || '/' || event_type || props) AS job_id FROM events)
        SELECT event_id, job_id FROM ev WHERE ts >= TIMESTAMP '2024-01-16' AND job_id NOT IN (SELECT job_id FROM ev WHERE ts < TIMESTAMP '2024-01-16')""",
    "h02_meta_and_titles": f"SELECT page_id, nullif({_T}, '') AS title, nullif(trim(replace(regexp_extract(html, '<h1>(.*?)</h1>', 1), '&amp;', '&')), '') AS h1, 0 AS n_og FROM pages",
    "h05_list_items": "WITH p AS (SELECT page_id, regexp_extract_all(regexp_extract(html, '<nav>(.*?)</nav>', 1), '<a href=\"[^\"]*\">(.*?)</a>', 1) AS l FROM pages) SELECT page_id, CAST(unnest(range(len(l))) AS INT) AS pos, replace(unnest(l), '&amp;', '&') AS item FROM p",
    "h06_links": "WITH p AS (SELECT page_id, regexp_extract_all(html, '<a href=\"([^\"]*)\">', 1) AS u, regexp_extract_all(html, '<a href=\"[^\"]*\">(.*?)</a>', 1) AS t FROM pages) SELECT page_id, replace(unnest(u), '&amp;', '&') AS url, replace(unnest(t), '&amp;', '&') AS text FROM p",
    "h06_f17_link_hosts": "WITH p AS (SELECT url, unnest(regexp_extract_all(html, '<a href=\"([^\"]*)\">', 1)) AS u FROM pages) SELECT lower(regexp_extract(url, '://([^/:]+)', 1)) AS host, 'generic' AS kind, count(*) AS n FROM p GROUP BY 1",
    "h07_h08_script_variables": "SELECT page_id, nullif(regexp_extract(html, 'var\\s+t\\s*=\\s*[\"'']([^\"'']*)[\"'']', 1), '') AS t, NULL::VARCHAR AS missing FROM pages",
    "f07_needs_enrichment": f"{W} SELECT job_id FROM unified WHERE requirements IS NULL OR trim(requirements) IN ('', '[]')",
    "f17_candidate_links": f"""{W}, l AS (SELECT job_id, list_filter(CASE source WHEN 'adzuna' THEN [redirect_url, apply_url, url] ELSE [url] END, lambda x: x LIKE 'http%') AS u FROM unified),
        x AS (SELECT job_id, unnest(u) AS url, unnest(range(len(u))) AS p FROM l), y AS (SELECT job_id, url, min(p) AS p FROM x GROUP BY 1, 2) SELECT job_id, CAST(row_number() OVER (PARTITION BY job_id ORDER BY p) - 1 AS INT) AS pos, url FROM y""",
}
