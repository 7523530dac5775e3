"""Merge queries: scan, map, reject, de-duplicate, report."""

from pyspark.sql import functions as F

from vacantia.operators import unify as u
from vacantia.plans.bindings import SOURCE_A_SQL, SOURCE_B_SQL, duck, source_a, source_b
from vacantia.util import r6

CUT = "1998-01-01"

YEARS = r"regexp_extract({t}, '(\d+(?:\.\d+)?)\s*\+?\s*(?:years?|yrs?)', 1)"


def _edu(t: str) -> str:
    return f"""CASE WHEN contains({t},'phd') OR contains({t},'doctorate') THEN 'PhD'
      WHEN contains({t},'master') OR contains({t},'msc') OR contains({t},'ms ') THEN 'Master'
      WHEN contains({t},'bachelor') OR contains({t},'undergraduate') OR contains({t},'bs ') OR contains({t},'bsc') THEN 'Bachelor' END"""


def _norm(x: str) -> str:
    return (rf"trim(regexp_replace(regexp_replace(lower(coalesce({x},'')), '\s+', ' ', 'g'), "
            rf"'[^\p{{L}}\p{{N}}_\s]', '', 'g'))")


# The unified table in plain SQL; every catalogue oracle starts from it.
UNIFIED = f"""
src_a AS ({duck(SOURCE_A_SQL)}), src_b AS ({duck(SOURCE_B_SQL)}),
txt_a AS (SELECT *, lower(coalesce(title,'') || ' ' || coalesce(requirements,'') || ' ' || coalesce(description,'') || ' ' || coalesce(full_description,'')) AS t FROM src_a),
txt_b AS (SELECT *, lower(coalesce(title,'') || '  ' || coalesce(description,'') || ' ') AS t FROM src_b),
mapped AS (
 SELECT 'jobs_ac_uk' AS source, job_id AS source_job_id, title, employer AS company, employer, department, location,
   NULL::VARCHAR AS area, salary, NULL::DECIMAL(10,2) AS salary_min, NULL::DECIMAL(10,2) AS salary_max, hours, job_type,
   contract_type, NULL::VARCHAR AS contract_time, description, full_description, requirements, url,
   coalesce(nullif(apply_url,''), url) AS apply_url, NULL::VARCHAR AS redirect_url, published_date, closing_date, placed_on,
   NULL::TIMESTAMP AS created, category, subcategory, {_edu('t')} AS required_education,
   TRY_CAST(nullif({YEARS.format(t='t')},'') AS DOUBLE) AS required_experience_years,
   coalesce(nullif(category,''), nullif(subcategory,'')) AS industry,
   CAST(json_extract_string(raw_data,'$.impressions') AS INT) AS view_count,
   CAST(json_extract_string(raw_data,'$.applications') AS INT) AS application_count,
   NULL::DOUBLE AS competition_level, 'uk' AS country, feed_source, scraped_at AS original_scraped_at, raw_data
 FROM txt_a
 UNION ALL
 SELECT 'adzuna', job_id, title, company, company, NULL, location, area,
   CASE WHEN salary_min <> 0 AND salary_max <> 0 AND salary_min = salary_max THEN '£' || format('{{:,.0f}}', salary_min::DOUBLE)
        WHEN salary_min <> 0 AND salary_max <> 0 THEN '£' || format('{{:,.0f}}', salary_min::DOUBLE) || ' - £' || format('{{:,.0f}}', salary_max::DOUBLE)
        WHEN salary_min <> 0 THEN '£' || format('{{:,.0f}}', salary_min::DOUBLE) || '+'
        WHEN salary_max <> 0 THEN 'Up to £' || format('{{:,.0f}}', salary_max::DOUBLE) END,
   salary_min, salary_max, NULL, contract_type, contract_type, contract_time, description, description, NULL, url,
   coalesce(nullif(redirect_url,''), url), redirect_url, NULL, NULL, NULL, created, category, NULL, {_edu('t')},
   TRY_CAST(nullif({YEARS.format(t='t')},'') AS DOUBLE), coalesce(nullif(category,''), json_extract_string(raw_data,'$.sector')),
   CAST(json_extract_string(raw_data,'$.views') AS INT), NULL, CAST(json_extract_string(raw_data,'$.competition_level') AS DOUBLE),
   country, 'adzuna', scraped_at, raw_data
 FROM txt_b),
keyed AS (
 SELECT *, source || '_' || source_job_id AS job_id,
   sha256({_norm('title')} || '|' || {_norm("coalesce(nullif(company,''), employer)")} || '|' || {_norm('location')}) AS dedup_hash,
   (trim(coalesce(title,'')) <> '' AND trim(coalesce(company,'')) <> '' AND trim(coalesce(location,'')) <> '') AS complete
 FROM mapped),
unified AS (SELECT * FROM keyed WHERE complete),
postings AS (
 SELECT * FROM unified QUALIFY row_number() OVER (PARTITION BY dedup_hash
   ORDER BY CASE source WHEN 'jobs_ac_uk' THEN 0 ELSE 1 END, original_scraped_at DESC NULLS LAST, source_job_id) = 1)
"""


def all_rows(spark, d):
    return u.unify(source_a(spark, d), source_b(spark, d))


def unified(spark, d):
    return all_rows(spark, d).filter(u.is_complete())


def mapped(spark, d):
    return u.map_a(source_a(spark, d)).unionByName(u.map_b(source_b(spark, d)))


def sources(spark, d):
    return [(source_a(spark, d), u.MAPPING_A, False), (source_b(spark, d), u.MAPPING_B, True)]


def postings(spark, d):
    return u.unique_sources(sources(spark, d))


def stored(spark, d):
    """Merged table as an earlier run left it: everything scraped before the cut-off date."""
    return postings_before(spark, d)


def postings_before(spark, d):
    return u.unique_sources(sources(spark, d), F.col("original_scraped_at") < CUT)


MERGED_SQL = f"""merged AS (SELECT * FROM unified WHERE original_scraped_at < TIMESTAMP '{CUT}' QUALIFY row_number() OVER (
  PARTITION BY dedup_hash ORDER BY CASE source WHEN 'jobs_ac_uk' THEN 0 ELSE 1 END, original_scraped_at DESC NULLS LAST, source_job_id) = 1)"""

PROJ = ("job_id source title company location salary salary_min salary_max hours job_type contract_type contract_time "
        "apply_url category subcategory required_education required_experience_years industry view_count "
        "application_count competition_level country feed_source dedup_hash").split()


def _proj(df):
    return df.select(*[F.col(c).cast("double").alias(c) if c in ("salary_min", "salary_max") else F.col(c) for c in PROJ])


_PROJ_SQL = ", ".join(f"CAST({c} AS DOUBLE) AS {c}" if c in ("salary_min", "salary_max") else c for c in PROJ)


def flagship(spark, d):
    """Unified, de-duplicated postings with counts per source and share of the total."""
    from vacantia.operators.catalog import source_distribution
    return source_distribution(postings(spark, d))


def scan_sources(spark, d):
    def side(df, name, company):
        return df.groupBy().agg(
            F.lit(name).alias("source"), F.count(F.lit(1)).alias("n"), F.count_distinct("job_id").alias("ids"),
            F.count(company).alias("with_company"), F.count("title").alias("with_title"),
            F.max("scraped_at").alias("latest"))
    return side(source_a(spark, d), "a", "employer").unionByName(side(source_b(spark, d), "b", "company"))


def new_only(spark, d):
    m = stored(spark, d)
    a = u.only_new(source_a(spark, d), m, "jobs_ac_uk").select(F.lit("a").alias("source"), "job_id")
    b = u.only_new(source_b(spark, d), m, "adzuna").select(F.lit("b").alias("source"), "job_id")
    return a.unionByName(b)


def not_stored_hash(spark, d):
    return u.drop_known_hashes(unified(spark, d), stored(spark, d)).select("job_id", "dedup_hash")


def refresh_hash(spark, d):
    return u.drop_known_hashes(unified(spark, d), stored(spark, d), refresh=True).select("job_id", "dedup_hash")


def absent_rows(spark, d):
    return u.insert_if_absent(unified(spark, d), stored(spark, d)).select("job_id", "title", "original_scraped_at")


def incremental(spark, d):
    return u.merge_new_rows(source_a(spark, d), source_b(spark, d), stored(spark, d)).select("job_id", "title", "company", "location", "dedup_hash")


def upserted(spark, d):
    target = stored(spark, d).select("job_id", "title", "salary", "original_scraped_at")
    batch = (unified(spark, d).filter(F.col("original_scraped_at") >= "1997-06-01")
             .select("job_id", F.concat(F.lit("re-scraped "), "title").alias("title"), "salary", "original_scraped_at"))
    return u.upsert(target, batch, ["job_id"], [F.desc("original_scraped_at")])


def report(spark, d):
    rows = all_rows(spark, d)
    return u.merge_report(u.disposition(rows, stored(spark, d)))


def rejected(spark, d):
    return all_rows(spark, d).filter(~u.is_complete()).select("job_id", "source", "company", "location")


def display_salary(spark, d):
    return unified(spark, d).filter("source = 'adzuna'").select(
        "job_id", "salary", F.col("salary_min").cast("double").alias("lo"), F.col("salary_max").cast("double").alias("hi"))


W = f"WITH {UNIFIED}"
WM = f"WITH {UNIFIED}, {MERGED_SQL}"
QUERIES = {
    "s01_s02_scan_sources": scan_sources,
    "p01_map_to_unified_schema": lambda s, d: _proj(all_rows(s, d)),
    "p02_p06_aliases_and_derived": lambda s, d: all_rows(s, d).groupBy("source", "required_education", "industry").agg(
        F.count(F.lit(1)).alias("n"), r6(F.avg("required_experience_years")).alias("avg_years"),
        F.sum("view_count").alias("views"), F.sum("application_count").alias("applications"),
        r6(F.sum("competition_level")).alias("competition")),
    "p07_salary_range_text": display_salary,
    "p08_p10_unified_id_and_hash": lambda s, d: all_rows(s, d).select("source", "source_job_id", "job_id", "dedup_hash"),
    "f01_rejected_rows": rejected,
    "u01_union_of_sources": lambda s, d: unified(s, d).select("source", "job_id", "title", "company", "location"),
    "w01_first_row_per_hash": lambda s, d: postings(s, d).select("job_id", "dedup_hash", "original_scraped_at"),
    "a01_source_distribution": flagship,
    "j01_only_new_rows": new_only,
    "j02_drop_known_hashes": not_stored_hash,
    "j02_drop_known_hashes_refresh": refresh_hash,
    "s08_insert_if_absent": absent_rows,
    "s07_upsert_last_write_wins": upserted,
    "x02_incremental_merge_batch": incremental,
    "a16_merge_report": report,
}
ORACLE = {
    "s01_s02_scan_sources": f"""{W} SELECT 'a' AS source, count(*) AS n, count(DISTINCT job_id) AS ids, count(employer) AS with_company,
        count(title) AS with_title, max(scraped_at) AS latest FROM src_a UNION ALL
        SELECT 'b', count(*), count(DISTINCT job_id), count(company), count(title), max(scraped_at) FROM src_b""",
    "p01_map_to_unified_schema": f"{W} SELECT {_PROJ_SQL} FROM keyed",
    "p02_p06_aliases_and_derived": f"""{W} SELECT source, required_education, industry, count(*) AS n, round(avg(required_experience_years),6) AS avg_years,
        CAST(sum(view_count) AS BIGINT) AS views, CAST(sum(application_count) AS BIGINT) AS applications, round(sum(competition_level),6) AS competition
        FROM keyed GROUP BY ALL""",
    "p07_salary_range_text": f"{W} SELECT job_id, salary, CAST(salary_min AS DOUBLE) AS lo, CAST(salary_max AS DOUBLE) AS hi FROM unified WHERE source='adzuna'",
    "p08_p10_unified_id_and_hash": f"{W} SELECT source, source_job_id, job_id, dedup_hash FROM keyed",
    "f01_rejected_rows": f"{W} SELECT job_id, source, company, location FROM keyed WHERE NOT complete",
    "u01_union_of_sources": f"{W} SELECT source, job_id, title, company, location FROM unified",
    "w01_first_row_per_hash": f"{W} SELECT job_id, dedup_hash, original_scraped_at FROM postings",
    "a01_source_distribution": f"""{W} SELECT source, count(*) AS n, round(count(*) * 100.0 / sum(count(*)) OVER (), 6) AS share_pct
        FROM postings GROUP BY source""",
    "j01_only_new_rows": f"""{WM} SELECT 'a' AS source, job_id FROM src_a WHERE NOT EXISTS (SELECT 1 FROM merged m WHERE m.job_id = 'jobs_ac_uk_' || src_a.job_id)
        UNION ALL SELECT 'b', job_id FROM src_b WHERE NOT EXISTS (SELECT 1 FROM merged m WHERE m.job_id = 'adzuna_' || src_b.job_id)""",
    "j02_drop_known_hashes": f"{WM} SELECT job_id, dedup_hash FROM unified x WHERE NOT EXISTS (SELECT 1 FROM merged m WHERE m.dedup_hash = x.dedup_hash)",
    "j02_drop_known_hashes_refresh": f"""{WM} SELECT job_id, dedup_hash FROM unified x WHERE NOT EXISTS (
        SELECT 1 FROM merged m WHERE m.dedup_hash = x.dedup_hash AND m.job_id <> x.job_id)""",
    "s08_insert_if_absent": f"{WM} SELECT job_id, title, original_scraped_at FROM unified x WHERE NOT EXISTS (SELECT 1 FROM merged m WHERE m.job_id = x.job_id) QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY original_scraped_at DESC NULLS LAST, dedup_hash) = 1",
    "s07_upsert_last_write_wins": f"""{WM}, batch AS (SELECT job_id, 're-scraped ' || title AS title, salary, original_scraped_at FROM unified
        WHERE original_scraped_at >= TIMESTAMP '1997-06-01')
        SELECT * FROM batch UNION ALL SELECT job_id, title, salary, original_scraped_at FROM merged WHERE job_id NOT IN (SELECT job_id FROM batch)""",
    "x02_incremental_merge_batch": f"""{WM} SELECT job_id, title, company, location, dedup_hash FROM unified
        WHERE job_id NOT IN (SELECT job_id FROM merged) AND dedup_hash NOT IN (SELECT dedup_hash FROM merged)
        QUALIFY row_number() OVER (PARTITION BY dedup_hash ORDER BY CASE source WHEN 'jobs_ac_uk' THEN 0 ELSE 1 END,
        original_scraped_at DESC NULLS LAST, source_job_id) = 1""",
    "a16_merge_report": f"""{WM}, win AS (SELECT job_id FROM postings), tagged AS (
        SELECT source, CASE WHEN NOT complete THEN 'filtered'
          WHEN dedup_hash IN (SELECT dedup_hash FROM merged) OR job_id NOT IN (SELECT job_id FROM win) THEN 'duplicate'
          WHEN job_id IN (SELECT job_id FROM merged) THEN 'skipped' ELSE 'inserted' END AS d FROM keyed),
        g AS (SELECT coalesce(source,'(all)') AS source, count(*) AS fetched, count(*) FILTER (d='filtered') AS filtered,
          count(*) FILTER (d='duplicate') AS duplicates, count(*) FILTER (d='skipped') AS skipped, count(*) FILTER (d='inserted') AS inserted
          FROM tagged GROUP BY ROLLUP(source))
        SELECT source, fetched, filtered, fetched - filtered AS valid, duplicates, skipped, inserted,
          round(filtered * 100.0 / fetched, 6) AS filtered_pct, round(duplicates * 100.0 / (fetched - filtered), 6) AS duplicate_pct FROM g""",
}
