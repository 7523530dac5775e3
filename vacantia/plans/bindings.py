"""Role bindings: posting, profile and skill tables expressed over the star-schema tables.

Each binding is a SELECT whose ``{table}`` placeholders name input tables, so a role can be
re-bound by passing other frames.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..util import read_table

SOURCE_B_SQL = """
SELECT CAST(l_orderkey AS STRING) || '-' || CAST(l_linenumber AS STRING) || '-' || CAST(l_partkey AS STRING)
         || '-' || CAST(l_suppkey AS STRING) AS job_id,
       p_name AS title, s_name AS company, n_name AS location, r_name AS area,
       CAST(CAST(l_extendedprice AS DECIMAL(12,2)) * (1 - CAST(l_discount AS DECIMAL(4,2))) AS DECIMAL(10,2)) AS salary_min,
       CAST(l_extendedprice AS DECIMAL(10,2)) AS salary_max,
       CASE l_returnflag WHEN 'A' THEN 'permanent' WHEN 'N' THEN 'contract' END AS contract_type,
       CASE l_linestatus WHEN 'F' THEN 'full_time' ELSE 'part_time' END AS contract_time,
       p_brand || ' ' || p_type || ' role, ' || CAST(p_size % 12 AS STRING) || '+ years of ' || p_name
         || CASE WHEN p_size % 5 = 0 THEN ' and a master degree' ELSE '' END AS description,
       p_type AS category,
       'https://listing.example.org/ad/' || CAST(l_orderkey AS STRING) AS url,
       CASE WHEN l_linenumber % 2 = 0 THEN 'https://employer.example.net/' || CAST(l_suppkey AS STRING) END AS redirect_url,
       l_shipdate AS created, 'gb' AS country, l_shipdate AS scraped_at,
       '{{"views": "' || CAST(l_partkey % 2500 AS STRING) || '", "sector": "' || p_brand || '"'
         || CASE WHEN l_linenumber = 3 THEN ', "competition_level": 0.4' ELSE '' END || '}}' AS raw_data
FROM {lineitem} JOIN {part} ON l_partkey = p_partkey JOIN {supplier} ON l_suppkey = s_suppkey
JOIN {nation} ON s_nationkey = n_nationkey JOIN {region} ON n_regionkey = r_regionkey
"""

SOURCE_A_SQL = """
SELECT CAST(o_orderkey AS STRING) AS job_id, p_name AS title, c_name AS employer, c_mktsegment AS department,
       'District ' || CAST(c_custkey % 40 AS STRING) || ', ' || n_name AS location,
       CASE o_orderpriority
         WHEN '1-URGENT' THEN '£' || CAST(CAST(floor(o_totalprice / 10) AS BIGINT) AS STRING) || ' to £'
              || CAST(CAST(floor(o_totalprice / 8) AS BIGINT) AS STRING) || ' per annum'
         WHEN '2-HIGH' THEN '£' || CAST(CAST(floor(o_totalprice / 10) AS BIGINT) AS STRING)
         WHEN '3-MEDIUM' THEN 'Competitive'
         WHEN '5-LOW' THEN CAST(CAST(floor(o_totalprice / 9) AS BIGINT) AS STRING) || ' GBP' END AS salary,
       CASE o_orderstatus WHEN 'F' THEN 'Full Time' WHEN 'O' THEN 'Part Time' END AS hours,
       CASE o_orderstatus WHEN 'F' THEN 'Full-time' WHEN 'O' THEN 'part time' ELSE ' Full Time ' END AS job_type,
       CASE WHEN o_totalprice > 250000 THEN 'Permanent' ELSE 'Fixed-Term' END AS contract_type,
       p_name || ' post, ' || CAST(p_size % 9 AS STRING) || ' yrs experience in ' || c_mktsegment
         || CASE WHEN p_size % 7 = 0 THEN ', PhD preferred' WHEN p_size % 7 = 1 THEN ', bachelor degree' ELSE '' END AS description,
       'Full text: ' || p_name || ' at ' || c_name AS full_description,
       CASE o_orderpriority WHEN '1-URGENT' THEN p_name || '; ' || p_type || '; ' || p_brand
            WHEN '2-HIGH' THEN '[]' WHEN '3-MEDIUM' THEN '  ' WHEN '5-LOW' THEN '["' || p_name || '", "' || p_type || '"]' END AS requirements,
       'https://feed.example.org/job/' || CAST(o_orderkey AS STRING) AS url,
       CASE WHEN o_orderstatus = 'F' THEN '' ELSE NULL END AS apply_url,
       o_orderdate AS published_date, o_orderdate + INTERVAL '30' DAY AS closing_date,
       CAST(day(o_orderdate) AS STRING) || '/' || CAST(month(o_orderdate) AS STRING) || '/' || CAST(year(o_orderdate) AS STRING) AS placed_on,
       c_mktsegment AS category, p_type AS subcategory, 'feed-' || c_mktsegment AS feed_source,
       o_orderdate AS scraped_at,
       CASE WHEN o_orderstatus = 'O' THEN '{{"impressions": ' || CAST(o_orderkey % 3000 AS STRING) || ', "applications": 12}}' END AS raw_data
FROM {orders} JOIN {customer} ON o_custkey = c_custkey JOIN {nation} ON c_nationkey = n_nationkey
LEFT JOIN (SELECT l_orderkey AS f_order, min(struct_pack_line) AS f_line FROM (
             SELECT l_orderkey, CAST(l_linenumber AS BIGINT) * 1000000000000 + l_partkey AS struct_pack_line FROM {lineitem}) x
           GROUP BY l_orderkey) f ON o_orderkey = f_order
LEFT JOIN {part} ON p_partkey = f_line % 1000000000000
"""

# posting -> skill mentions: one row per order line
MENTIONS_SQL = """
SELECT CAST(l_orderkey AS STRING) AS job_id, p_name AS skill_text,
       CASE WHEN p_size % 3 = 0 THEN 'TOOL' ELSE 'SKILL' END AS skill_type,
       CAST(0.5 + CAST(l_linenumber AS DECIMAL(5,4)) / 20 AS DECIMAL(5,4)) AS confidence_score,
       CASE WHEN p_size % 2 = 0 THEN 'keyword_match_exact' ELSE 'pretrained_ner' END AS extraction_method,
       l_shipdate AS created_at
FROM {lineitem} JOIN {part} ON l_partkey = p_partkey
"""

# merged posting -> skill mentions: of feed postings one row per order line, of listed ones the part they offer
MENTIONED_SQL = """
SELECT 'jobs_ac_uk_' || CAST(l_orderkey AS STRING) AS job_id, p_name AS skill_text FROM {lineitem} JOIN {part} ON l_partkey = p_partkey
UNION ALL
SELECT 'adzuna_' || CAST(l_orderkey AS STRING) || '-' || CAST(l_linenumber AS STRING) || '-' || CAST(l_partkey AS STRING) || '-' || CAST(l_suppkey AS STRING), p_name
FROM {lineitem} JOIN {part} ON l_partkey = p_partkey
"""

NORMALIZED_SQL = """
SELECT CAST(l_orderkey AS STRING) AS job_id, p_name AS raw_skill_text, p_name || ' (' || p_type || ')' AS normalized_skill_name,
       CAST(0.6 + CAST(l_discount AS DECIMAL(5,4)) * 4 AS DECIMAL(5,4)) AS similarity_score,
       CASE WHEN l_linenumber % 3 = 0 THEN 'fuzzy' ELSE 'embedding' END AS normalization_method,
       CAST(p_partkey AS INT) AS esco_skill_id, l_shipdate AS created_at
FROM {lineitem} JOIN {part} ON l_partkey = p_partkey
"""

# the same for the postings of both sources, by merged id
NORMALIZED_ALL_SQL = """
SELECT 'jobs_ac_uk_' || CAST(l_orderkey AS STRING) AS job_id, p_name || ' (' || p_type || ')' AS normalized_skill_name, CAST(0.6 + CAST(l_discount AS DECIMAL(5,4)) * 4 AS DECIMAL(5,4)) AS similarity_score
FROM {lineitem} JOIN {part} ON l_partkey = p_partkey
UNION ALL
SELECT 'adzuna_' || CAST(l_orderkey AS STRING) || '-' || CAST(l_linenumber AS STRING) || '-' || CAST(l_partkey AS STRING) || '-' || CAST(l_suppkey AS STRING),
  p_name || ' (' || p_type || ')', CAST(0.6 + CAST(l_tax AS DECIMAL(5,4)) * 5 AS DECIMAL(5,4))
FROM {lineitem} JOIN {part} ON l_partkey = p_partkey
"""

# fine-grained edges: the vocabulary grows with the data
EDGES_SQL = """
SELECT CAST(l_orderkey AS STRING) AS job_id, 'P' || CAST(l_partkey AS STRING) AS skill FROM {lineitem}
"""

# the same for the postings of both sources, by merged id
EDGES_ALL_SQL = """
SELECT 'jobs_ac_uk_' || CAST(l_orderkey AS STRING) AS job_id, 'P' || CAST(l_partkey AS STRING) AS skill FROM {lineitem}
UNION ALL
SELECT 'adzuna_' || CAST(l_orderkey AS STRING) || '-' || CAST(l_linenumber AS STRING) || '-' || CAST(l_partkey AS STRING) || '-' || CAST(l_suppkey AS STRING), 'P' || CAST(l_partkey AS STRING)
FROM {lineitem}
"""

USER_SKILLS_SQL = """
SELECT 'u' || CAST(o_custkey AS STRING) AS user_id, p_name AS name,
       CAST(least(1.0, sum(l_quantity) / 60) AS DOUBLE) AS proficiency,
       CAST(count(*) AS DOUBLE) AS years_of_experience
FROM {orders} JOIN {lineitem} ON o_orderkey = l_orderkey JOIN {part} ON l_partkey = p_partkey
GROUP BY o_custkey, p_name
"""

HISTORY_SQL = """
SELECT 'u' || CAST(user_id AS STRING) AS user_id, CAST(CAST(substr(props, 7, length(props) - 7) AS INT) AS STRING) AS job_id,
       value / 20 AS final_score, event_type AS explanation, ts AS matched_at, event_id FROM {events}
"""

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def bind(spark: SparkSession, directory: str, sql: str) -> DataFrame:
    """Run a binding over the tables of a folder; only the named tables are read."""
    used = {t: read_table(spark, directory, t) for t in TABLES if "{" + t + "}" in sql}
    return spark.sql(sql, **used)


def source_a(spark: SparkSession, d: str) -> DataFrame:
    return bind(spark, d, SOURCE_A_SQL)


def source_b(spark: SparkSession, d: str) -> DataFrame:
    return bind(spark, d, SOURCE_B_SQL)


def duck(sql: str) -> str:
    """The same SELECT with plain table names."""
    return sql.format(**{t: t for t in TABLES})

USERS_SQL = """
SELECT 'u' || CAST(c_custkey AS STRING) AS user_id, c_name AS name, n_name AS nation, c_mktsegment AS segment,
  CASE WHEN c_custkey % 1000 = 7 THEN NULL WHEN c_custkey % 50 = 0 THEN n_name
       ELSE 'District ' || CAST(c_custkey % 40 AS STRING) || ', ' || n_name END AS place,
  c_acctbal * 3 AS min_salary, CASE WHEN c_custkey % 3 = 0 AND c_acctbal > 0 THEN c_acctbal * 6 END AS max_salary,
  CASE c_mktsegment WHEN 'BUILDING' THEN 'Full-time' WHEN 'MACHINERY' THEN 'Part time' END AS work_type,
  CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment END AS industry,
  CASE WHEN c_custkey % 4 = 1 THEN c_name END AS excluded,
  CASE WHEN c_custkey % 5 = 2 THEN TIMESTAMP '1996-06-01 00:00:00' END AS start_date,
  CAST(c_custkey % 6 AS INT) AS edu, CAST(2.5 + (c_custkey % 20) / 10.0 AS DOUBLE) AS gpa,
  CASE WHEN c_custkey % 7 = 0 THEN '985' END AS ranking, CAST((c_custkey % 13) / 2.0 AS DOUBLE) AS years
FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey
"""


def profiles(spark: SparkSession, d: str) -> DataFrame:
    """Nested user profiles from the customer side."""
    from pyspark.sql import functions as F

    u = bind(spark, d, USERS_SQL)
    skills = bind(spark, d, USER_SKILLS_SQL).groupBy("user_id").agg(
        F.array_sort(F.collect_list(F.struct("name", "proficiency", "years_of_experience"))).alias("skills"))
    levels = F.array(*[F.lit(x) for x in ("High School", "Associate", "Bachelor", "Master", "PhD")])

    def pref(kind, value, weight):
        return F.struct(F.lit(kind).alias("preference_type"), value.alias("value"), F.lit(weight).alias("weight"))

    def one(c):
        return F.when(F.col(c).isNotNull(), F.array(c)).otherwise(F.array().cast("array<string>"))
    return u.join(skills, "user_id", "left").select(
        "user_id", "name", F.coalesce("skills", F.array().cast("array<struct<name:string,proficiency:double,years_of_experience:double>>")).alias("skills"),
        F.when(F.col("edu") > 0, F.array(F.struct(
            F.element_at(levels, F.col("edu")).alias("level"), F.lit("").alias("major"), "gpa", "ranking")))
        .otherwise(F.array().cast("array<struct<level:string,major:string,gpa:double,ranking:string>>")).alias("education"),
        F.array(F.struct(F.lit("").alias("company"), F.col("years").alias("duration_years"))).alias("work_experience"),
        F.array(pref("Industry", F.col("segment"), 0.6), pref("Company Size", F.lit("Unknown"), 0.3),
                pref("Innovation", F.lit("high"), 0.2)).alias("preferences"),
        F.struct(one("place").alias("locations"), "min_salary", "max_salary", "work_type", F.col("start_date").cast("date").alias("start_date"),
                 one("industry").alias("industries"), F.array().cast("array<string>").alias("company_types"),
                 one("excluded").alias("exclude_companies"), F.lit(None).cast("double").alias("max_commute_time")).alias("constraints"))
