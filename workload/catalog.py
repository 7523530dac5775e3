"""Catalogue queries: filters, listings, statistics, label lists, feeds, exports."""

from pyspark.sql import functions as F

from vacantia.operators import catalog as c
from vacantia.plans.bindings import HISTORY_SQL, MENTIONED_SQL, NORMALIZED_SQL, bind, duck, source_a
from vacantia.util import r6
from vacantia.sources import sinks

from .merge import UNIFIED, postings, unified

AS_OF = "2001-12-01 00:00:00"
FIELDS = ["title", "company", "location", "salary", "description", "url", "category", "contract_type", "apply_url"]
W = f"WITH {UNIFIED}"
NORM = f"norm AS ({duck(NORMALIZED_SQL)})"
HIST = f"hist AS ({duck(HISTORY_SQL)})"


def history(spark, d):
    return bind(spark, d, HISTORY_SQL)


def filters(spark, d):
    p = c.posting_filter(location="nation_1", job_type="perm", category="econ", min_salary=20000, max_salary=70000,
                         keywords="bolt", source="adz")
    return unified(spark, d).filter(p).select("job_id", "title", "location", "category")


def wildcard(spark, d):
    plain = unified(spark, d).filter(c.posting_filter(keywords="r_d b%t")).select("job_id", F.lit("wildcard").alias("kind"))
    esc = unified(spark, d).filter(c.posting_filter(keywords="r_d b%t", escape=True)).select("job_id", F.lit("escaped").alias("kind"))
    return plain.unionByName(esc)


def skills_joined(spark, d):
    post = unified(spark, d).filter("source = 'jobs_ac_uk'").select("source_job_id", "title")
    out = c.with_skills(post.withColumnRenamed("source_job_id", "job_id"), bind(spark, d, NORMALIZED_SQL))
    return out.select("job_id", "title", F.concat_ws("|", "required_skills").alias("skills"), F.size("required_skills").alias("n_skills"))


def labels_first_spelling(spark, d):
    from pyspark.sql import Window  # noqa: F401
    vals = c.distinct_union(unified(spark, d), "job_type", "contract_type", None)
    return c.dedupe_labels(vals, "value", [F.col("value")]).select("label_key", "value")


def category_labels(spark, d):
    u = unified(spark, d)
    cats = c.distinct_union(u.select("category", F.col("contract_type").alias("subcategory")), "category", "subcategory", None)
    types = c.distinct_union(u.filter("source = 'jobs_ac_uk'"), "job_type", "department", None)
    return c.drop_work_types(cats, types)


def options(spark, d):
    part_types = unified(spark, d).select(F.col("category").alias("value")).distinct()
    presets = bind(spark, d, "SELECT r_name AS value, r_regionkey AS pos FROM {region} UNION ALL SELECT 'large', 9 FROM {region}")
    return c.merge_options(presets, part_types).select("value", "grp", "ord")


#: History rows about the postings of both sources: an even event is about the feed posting, an odd one about a listed one of the same order.
BOTH_SQL = f"""SELECT h.user_id, CASE WHEN event_id % 2 = 0 THEN 'jobs_ac_uk_' || job_id ELSE b_id END AS job_id, final_score, explanation, matched_at, event_id
  FROM ({HISTORY_SQL}) h LEFT JOIN (SELECT CAST(l_orderkey AS STRING) AS o_id, min('adzuna_' || CAST(l_orderkey AS STRING) || '-' || CAST(l_linenumber AS STRING) || '-' || CAST(l_partkey AS STRING) || '-' || CAST(l_suppkey AS STRING)) AS b_id
    FROM {{lineitem}} GROUP BY l_orderkey) b ON o_id = job_id"""
BOTH = f"hist AS ({duck(BOTH_SQL)})"


def history_of_both(spark, d):
    return bind(spark, d, BOTH_SQL).filter("job_id IS NOT NULL")


def feed_rows(spark, d):
    return c.recommendation_feed(history_of_both(spark, d), unified(spark, d).dropDuplicates(["job_id"]), 5)


def detail(spark, d):
    skills = bind(spark, d, MENTIONED_SQL).groupBy("job_id").agg(F.array_sort(F.collect_set("skill_text")).alias("required_skills"))
    out = c.detail_shape(postings(spark, d).join(skills, "job_id", "left"))
    return out.withColumn("required_skills", F.array_join("required_skills", "|"))


def recommended(spark, d):
    out = c.recommendation_shape(feed_rows(spark, d))
    return out.withColumn("score", r6("score")).drop("relevance", "feasibility", "growth", "match_score")


def feed(spark, d):
    return feed_rows(spark, d).select(
        "user_id", "job_id", r6("final_score").alias("final_score"), "rank", "title", "location", "company", "salary")


def detail_shape(spark, d):
    return c.listing_shape(unified(spark, d))


def paged(spark, d):
    p = unified(spark, d).filter(c.posting_filter(location="nation_2"))
    return c.page(p, number=2, size=25).select("job_id", "title", "original_scraped_at", "total")


def export_csv(spark, d):
    path = sinks.export_csv(postings(spark, d), "original_scraped_at", "raw_data")
    cols = ["job_id", "title", "company", "salary"]
    return spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path).select(*cols)


def export_json(spark, d):
    path = sinks.export_json(postings(spark, d).select("job_id", "title", "original_scraped_at"), "original_scraped_at", limit=300)
    return spark.read.schema("job_id string, title string, original_scraped_at string").json(path)


def rebuilt(spark, d):
    """Full reload of the merged table, partitioned by source, read back and counted."""
    from vacantia.util import shared_dir
    path = shared_dir(spark, "rebuild")
    sinks.rebuild(postings(spark, d).select("job_id", "source", "title"), path, ["source"])
    return spark.read.parquet(path).groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("job_id").alias("ids"))


def label_coverage(spark, d):
    """Coverage over labelled documents: blank-free fields and label presence."""
    docs = bind(spark, d, "SELECT doc_id, lang, source, quality, toxic FROM {documents} LEFT JOIN {labels} USING (doc_id)")
    return c.field_coverage(docs, ["lang", "source", "quality", "toxic"], strip_values=True)


_TOP = "ORDER BY n DESC, {0} LIMIT {1}"
QUERIES = {
    "f02_catalogue_filters": filters,
    "f02_wildcards_and_escape": wildcard,
    "f03_keyword_search": lambda s, d: c.search(unified(s, d), "GIZMO", 50).select("job_id", "title", "original_scraped_at"),
    "f04_location_search": lambda s, d: c.by_location(unified(s, d), "nation_7", 50).select("job_id", "location", "original_scraped_at"),
    "f05_recent_rows": lambda s, d: c.recent(unified(s, d), "2001-06-01 00:00:00", 200).select("job_id", "original_scraped_at"),
    "s15_retention": lambda s, d: c.retain(unified(s, d), "2001-06-01 00:00:00", 700, "original_scraped_at").select("job_id", "original_scraped_at"),
    "a02_field_coverage": lambda s, d: c.field_coverage(unified(s, d), FIELDS),
    "a02_label_coverage": label_coverage,
    "a03_top_locations": lambda s, d: c.top_locations(unified(s, d), 40),
    "a04_top_companies": lambda s, d: c.top_companies(unified(s, d), 20),
    "a05_table_statistics": lambda s, d: c.table_stats(unified(s, d), "2001-06-20 12:00:00"),
    "a06_j03_postings_with_skills": skills_joined,
    "a07_count_filtered": lambda s, d: c.count_postings(unified(s, d), c.posting_filter(category="large", keywords="blue")),
    "l01_paged_listing": paged,
    "l02_newest_history": lambda s, d: c.newest(history(s, d), "matched_at", 100, "event_id").select("user_id", "job_id", "matched_at"),
    "l03_w02_j18_recommendation_feed": feed,
    "w02_latest_history_per_posting": lambda s, d: c.latest_history(history(s, d)).select("user_id", "job_id", "matched_at", r6("final_score").alias("final_score")),
    "u02_distinct_types": lambda s, d: c.distinct_union(unified(s, d), "job_type", "contract_type", None),
    "u02_distinct_categories": lambda s, d: c.distinct_union(unified(s, d), "category", "subcategory", None),
    "u04_first_spelling_per_label": labels_first_spelling,
    "f16_category_labels": category_labels,
    "u05_presets_then_values": options,
    "u06_distinct_sources": lambda s, d: c.distinct_sources(unified(s, d)),
    "p35_p21_listing_shape": detail_shape,
    "p35_detail_shape": detail,
    "p35_recommendation_shape": recommended,
    "s09_full_rebuild": rebuilt,
    "s13_export_csv": export_csv,
    "s14_export_json": export_json,
}
_KEY = r"regexp_replace(lower(trim({0})), '[\s\-_]+', '', 'g')"
ORACLE = {
    "f02_catalogue_filters": f"""{W} SELECT job_id, title, location, category FROM unified WHERE location ILIKE '%nation_1%'
        AND (coalesce(job_type,'') ILIKE '%perm%' OR coalesce(contract_type,'') ILIKE '%perm%')
        AND (coalesce(category,'') ILIKE '%econ%' OR coalesce(subcategory,'') ILIKE '%econ%')
        AND salary_min >= 20000 AND salary_max <= 70000 AND (title ILIKE '%bolt%' OR description ILIKE '%bolt%') AND source ILIKE '%adz%'""",
    "f02_wildcards_and_escape": f"""{W} SELECT job_id, 'wildcard' AS kind FROM unified WHERE title ILIKE '%r_d b%t%' OR description ILIKE '%r_d b%t%'
        UNION ALL SELECT job_id, 'escaped' FROM unified WHERE contains(lower(title), 'r_d b%t') OR contains(lower(description), 'r_d b%t')""",
    "f03_keyword_search": f"{W} SELECT job_id, title, original_scraped_at FROM unified WHERE title ILIKE '%gizmo%' OR description ILIKE '%gizmo%' ORDER BY original_scraped_at DESC NULLS LAST, job_id LIMIT 50",
    "f04_location_search": f"{W} SELECT job_id, location, original_scraped_at FROM unified WHERE location ILIKE '%nation_7%' ORDER BY original_scraped_at DESC NULLS LAST, job_id LIMIT 50",
    "f05_recent_rows": f"{W} SELECT job_id, original_scraped_at FROM unified WHERE original_scraped_at > TIMESTAMP '2001-06-01' - INTERVAL 200 DAY",
    "s15_retention": f"{W} SELECT job_id, original_scraped_at FROM unified WHERE original_scraped_at IS NULL OR NOT original_scraped_at < TIMESTAMP '2001-06-01' - INTERVAL 700 DAY",
    "a02_field_coverage": f"{W} " + " UNION ALL ".join(
        f"SELECT '{f}' AS field, count(*) FILTER ({f} IS NOT NULL AND {f} <> '') AS filled, count(*) AS total, round(count(*) FILTER ({f} IS NOT NULL AND {f} <> '') * 100.0 / count(*), 6) AS pct FROM unified"
        for f in FIELDS),
    "a02_label_coverage": "WITH x AS (SELECT doc_id, lang, source, quality, toxic FROM documents LEFT JOIN labels USING (doc_id)) " + " UNION ALL ".join(
        f"SELECT '{f}' AS field, count({f}) AS filled, count(*) AS total, round(count({f}) * 100.0 / count(*), 6) AS pct FROM x" for f in ("lang", "source", "quality", "toxic")),
    "a03_top_locations": f"{W} SELECT trim(location) AS location, count(*) AS n FROM unified WHERE trim(location) <> '' GROUP BY 1 {_TOP.format('location', 40)}",
    "a04_top_companies": f"{W} SELECT trim(coalesce(company, employer)) AS company, count(*) AS n FROM unified GROUP BY 1 {_TOP.format('1', 20)}",
    "a05_table_statistics": f"""{W} SELECT count(*) AS total, max(original_scraped_at) AS latest,
        count(*) FILTER (original_scraped_at > TIMESTAMP '2001-06-20 12:00:00' - INTERVAL 24 HOUR) AS last_24h,
        count(*) FILTER (original_scraped_at > TIMESTAMP '2001-06-20 12:00:00' - INTERVAL 7 DAY) AS last_7d,
        count(*) FILTER (salary <> '') AS with_salary, round(count(*) FILTER (salary <> '') * 100.0 / count(*), 6) AS salary_pct FROM unified""",
    "a06_j03_postings_with_skills": f"""{W}, {NORM}, sk AS (SELECT job_id, string_agg(DISTINCT normalized_skill_name, '|' ORDER BY normalized_skill_name) AS skills,
        count(DISTINCT normalized_skill_name) AS n FROM norm GROUP BY 1)
        SELECT source_job_id AS job_id, title, coalesce(skills,'') AS skills, CAST(coalesce(n,0) AS INT) AS n_skills FROM unified LEFT JOIN sk ON sk.job_id = source_job_id WHERE source='jobs_ac_uk'""",
    "a07_count_filtered": f"""{W} SELECT count(DISTINCT job_id) AS n FROM unified WHERE (coalesce(category,'') ILIKE '%large%' OR coalesce(subcategory,'') ILIKE '%large%')
        AND (title ILIKE '%blue%' OR description ILIKE '%blue%')""",
    "l01_paged_listing": f"""{W}, f AS (SELECT * FROM unified WHERE location ILIKE '%nation_2%') SELECT job_id, title, original_scraped_at, (SELECT count(*) FROM f) AS total
        FROM f ORDER BY original_scraped_at DESC NULLS LAST, job_id LIMIT 25 OFFSET 25""",
    "l02_newest_history": f"WITH {HIST} SELECT user_id, job_id, matched_at FROM hist ORDER BY matched_at DESC, event_id LIMIT 100",
    "p35_detail_shape": f"""{W}, sk AS (SELECT job_id, array_to_string(list_sort(list(DISTINCT skill_text)), '|') AS l FROM ({duck(MENTIONED_SQL)}) GROUP BY 1)
        SELECT job_id, title, coalesce(nullif(employer,''), nullif(company,''), '') AS company, location, coalesce(nullif(salary,''), 'Salary not provided') AS salary, salary AS salary_text,
        coalesce(nullif(description,''), nullif(full_description,''), '') AS description, coalesce(requirements, '') AS requirements, coalesce(nullif(trim(apply_url),''), nullif(trim(url),'')) AS job_url,
        coalesce(nullif(job_type,''),'Full-time') AS job_type, source, coalesce(l, '') AS required_skills, url, apply_url, strftime(closing_date, '%Y-%m-%d') AS closing_date FROM postings LEFT JOIN sk USING (job_id)""",
    "p35_recommendation_shape": f"""WITH {BOTH}, {UNIFIED}, u1 AS (SELECT * FROM unified QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY job_id) = 1), l AS (SELECT * FROM hist WHERE job_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY user_id, job_id ORDER BY matched_at DESC, event_id DESC) = 1),
        r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY final_score DESC NULLS LAST, job_id) AS rank FROM l QUALIFY rank <= 5)
        SELECT user_id, CAST(rank AS INT) AS rank, r.job_id, round(final_score, 6) AS score, matched_at, coalesce(title, '') AS title, coalesce(location, '') AS location, coalesce(nullif(employer,''), nullif(company,''), '') AS company,
        coalesce(nullif(trim(apply_url),''), nullif(trim(url),'')) AS job_url, coalesce(salary, '') AS salary, coalesce(job_type, '') AS job_type, coalesce(explanation, '') AS explanation,
        coalesce(nullif(description,''), nullif(full_description,'')) AS description_snippet, department, hours, strftime(closing_date, '%Y-%m-%d') AS closing_date, source, category FROM r LEFT JOIN u1 ON u1.job_id = r.job_id""",
    "l03_w02_j18_recommendation_feed": f"""WITH {BOTH}, {UNIFIED}, a AS (SELECT * FROM unified QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY job_id) = 1), l AS (SELECT * FROM hist WHERE job_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY user_id, job_id ORDER BY matched_at DESC, event_id DESC) = 1),
        r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY final_score DESC NULLS LAST, job_id) AS rank FROM l QUALIFY rank <= 5)
        SELECT user_id, r.job_id, round(final_score,6) AS final_score, CAST(rank AS INT) AS rank, a.title, a.location, a.company, a.salary
        FROM r LEFT JOIN a ON a.job_id = r.job_id""",
    "w02_latest_history_per_posting": f"WITH {HIST} SELECT user_id, job_id, matched_at, round(final_score,6) AS final_score FROM hist QUALIFY row_number() OVER (PARTITION BY user_id, job_id ORDER BY matched_at DESC, event_id DESC) = 1",
    "u02_distinct_types": f"{W} SELECT trim(job_type) AS value FROM unified WHERE trim(job_type) <> '' UNION SELECT trim(contract_type) FROM unified WHERE trim(contract_type) <> ''",
    "u02_distinct_categories": f"{W} SELECT trim(category) AS value FROM unified WHERE trim(category) <> '' UNION SELECT trim(subcategory) FROM unified WHERE trim(subcategory) <> ''",
    "u04_first_spelling_per_label": f"""{W}, v AS (SELECT trim(job_type) AS value FROM unified WHERE trim(job_type) <> '' UNION SELECT trim(contract_type) FROM unified WHERE trim(contract_type) <> '')
        SELECT {_KEY.format('value')} AS label_key, min(value) AS value FROM v GROUP BY 1""",
    "f16_category_labels": f"""{W}, v AS (SELECT trim(category) AS value FROM unified WHERE trim(category) <> '' UNION SELECT trim(contract_type) FROM unified WHERE trim(contract_type) <> ''),
        k AS (SELECT {_KEY.format('job_type')} AS k FROM unified WHERE source='jobs_ac_uk' UNION SELECT {_KEY.format('department')} FROM unified WHERE source='jobs_ac_uk')
        SELECT value FROM v WHERE {_KEY.format('value')} NOT IN (SELECT k FROM k WHERE k IS NOT NULL)
        AND NOT regexp_matches(lower(value), '^\\s*(full|part)\\s*-?\\s*time\\s*$|^\\s*(permanent|temporary|contract|fixed[- ]?term|internship|hybrid|seasonal|freelance)\\s*$|^\\s*remote\\s*$')""",
    "u05_presets_then_values": f"""{W}, p AS (SELECT r_name AS value, CAST(r_regionkey AS BIGINT) AS pos FROM region UNION SELECT 'large', 9),
        k AS (SELECT DISTINCT category AS value FROM unified) SELECT value, 0 AS grp, pos AS ord FROM p
        UNION ALL SELECT value, 1, 0 FROM k WHERE value <> '' AND {_KEY.format('value')} NOT IN (SELECT {_KEY.format('value')} FROM p)""",
    "u06_distinct_sources": f"{W} SELECT DISTINCT source FROM unified",
    "p35_p21_listing_shape": f"""{W} SELECT job_id, title, coalesce(nullif(employer,''), nullif(company,''), 'Unknown Company') AS company, location,
        coalesce(nullif(salary,''), 'Salary not provided') AS salary, coalesce(nullif(job_type,''),'Full-time') AS job_type, source,
        coalesce(nullif(trim(apply_url),''), nullif(trim(url),'')) AS job_url, strftime(closing_date, '%Y-%m-%d') AS closing_date FROM unified""",
    "s09_full_rebuild": f"{W} SELECT source, count(*) AS n, count(DISTINCT job_id) AS ids FROM postings GROUP BY 1",
    "s13_export_csv": f"{W} SELECT job_id, title, company, salary FROM postings",
    "s14_export_json": f"{W} SELECT job_id, title, strftime(original_scraped_at, '%Y-%m-%dT%H:%M:%S') AS original_scraped_at FROM postings ORDER BY original_scraped_at DESC NULLS LAST, job_id LIMIT 300",
}
