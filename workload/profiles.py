"""Profile queries: payloads, guards, child tables, per-user aggregates."""

from pyspark.sql import functions as F

from vacantia.config import EDUCATION_LEVELS
from vacantia.operators import profiles as pf
from vacantia.operators import skills as k
from vacantia.operators.catalog import newest
from vacantia.operators.unify import replace_users
from vacantia.plans.bindings import USER_SKILLS_SQL, USERS_SQL, bind, duck, profiles
from vacantia.util import r6, r6e

from .skills import BEST_OF_USERS, best_of

PAY_SQL = """SELECT 'u' || CAST(c_custkey AS STRING) AS user_id, c_custkey,
  '{{"name": "' || CASE WHEN c_mktsegment = 'BUILDING' THEN ' ' ELSE c_name END || '", "education": [{{"level": "' || c_mktsegment || '", "graduation_year": ' || CAST(1900 + c_nationkey * 10 AS STRING) || ', "gpa": ' || CAST(c_nationkey / 4.0 AS STRING)
  || '}}], "skills": [{{"name": "' || n_name || '", "proficiency": ' || CAST(c_acctbal / 5000 AS STRING) || ', "years_of_experience": ' || CAST(c_nationkey * 4 AS STRING) || '}}, {{"name": ""}}], "preferences": [{{"preference_type": "Innovation", "weight": 2}}], "constraints": {{"min_salary": '
  || CAST(c_acctbal AS STRING) || ', "max_salary": 4000, "locations": [" ' || n_name || ' ", ""], "start_date": "2024/03/0' || CAST(1 + c_nationkey % 9 AS STRING) || '"}}}}' AS payload
FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey"""


def typed(s, d):
    return pf.parse_payload(bind(s, d, PAY_SQL))


def payload(s, d):
    t = typed(s, d)
    e, k0 = F.col("education")[0], F.col("skills")[0]
    return t.select("user_id", "name", e["level"].alias("level"), e["graduation_year"].alias("year"), r6(e["gpa"]).alias("gpa"), k0["category"].alias("category"),
                    r6(k0["proficiency"]).alias("proficiency"), F.col("preferences")[0]["preference_type"].alias("pref"), F.size("work_experience").alias("n_work"),
                    F.col("constraints.start_date").cast("string").alias("start_date"), F.size("skills").alias("n_skills"))


def sanitized(s, d):
    t = pf.sanitize(typed(s, d), 2024)
    return t.select("user_id", F.size("skills").alias("n_skills"), r6(F.col("skills")[0]["proficiency"]).alias("proficiency"), r6(F.col("skills")[0]["years_of_experience"]).alias("years"),
                    r6(F.col("preferences")[0]["weight"]).alias("weight"), F.array_join("constraints.locations", "|").alias("locations"), r6("constraints.min_salary").alias("min_salary"),
                    r6(F.col("education")[0]["gpa"]).alias("gpa"))


def broken(s, d):
    return pf.violations(typed(s, d))


def lists(s, d):
    u = bind(s, d, "SELECT c_custkey, c_name || ' ;' || c_mktsegment || ',, ' || n_name AS a, ' x: ' || c_name || chr(10) || 'bad line' || chr(10) || 'x:' || n_name || ':2' AS l FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey")
    m = pf.parse_languages("l")
    return u.select("c_custkey", F.array_join(pf.parse_list("a"), "|").alias("items"), F.array_join(pf.parse_lines("a"), "|").alias("lines"), F.element_at(m, "x").alias("x"), F.size(m).alias("n"))


def packed(s, d):
    presets = F.array(F.lit("AUTOMOBILE"), F.lit("BUILDING"), F.lit("FURNITURE"))
    u = bind(s, d, "SELECT c_custkey, c_mktsegment || ', BUILDING, ' || n_name AS plain, c_mktsegment || ', BUILDING' || chr(1) || n_name AS packed, c_mktsegment AS seg, n_name FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey")
    a, b = pf.decode_preference("plain", presets), pf.decode_preference("packed", presets)
    merged = pf.merge_choices(presets, F.array("seg", F.lit("BUILDING")), F.array("n_name", F.lit("BUILDING")))
    return u.select("c_custkey", F.array_join(a["checked"], "|").alias("a_checked"), a["other"].alias("a_other"), F.array_join(b["checked"], "|").alias("b_checked"), b["other"].alias("b_other"),
                    F.array_join(merged, "|").alias("merged"))


def us(s, d):
    return bind(s, d, USER_SKILLS_SQL)


def weights(s, d):
    w = pf.skill_weights(us(s, d))
    return w.select("user_id", "n_skills", F.explode("skill_weights").alias("skill", "w")).select("user_id", "n_skills", "skill", r6("w").alias("w"))


def edu_rows(s, d):
    """Two entries per user: the bound level and a bachelor degree."""
    u = bind(s, d, USERS_SQL)
    names = F.array(*[F.lit(x) for x in EDUCATION_LEVELS])
    a = u.filter("edu > 0").select("user_id", F.element_at(names, F.col("edu")).alias("level"), F.lit("a").alias("major"), "gpa", "ranking", F.lit(1).alias("seq"))
    b = u.select("user_id", F.lit("Bachelor").alias("level"), F.lit("b").alias("major"), "gpa", "ranking", F.lit(2).alias("seq"))
    return a.unionByName(b)


def best_edu(s, d):
    return pf.highest_education(edu_rows(s, d)).select("user_id", "level", "major")


def years(s, d):
    w = bind(s, d, "SELECT 'u' || CAST(o_custkey AS STRING) AS user_id, o_totalprice / 100000 AS duration_years FROM {orders}")
    return pf.total_years(w).select("user_id", r6e("years").alias("years"))


#: Child tables of a profile that skills and education do not cover: name, rows (``user_id, seq, ...``).
CHILDREN = {
    "work_experience": "SELECT 'u' || CAST(o_custkey AS STRING) AS user_id, o_orderkey AS seq, o_orderpriority AS company, CAST(o_totalprice / 100000 AS DOUBLE) AS duration_years FROM {orders} WHERE o_orderstatus = 'F'",
    "preferences": """SELECT 'u' || CAST(c_custkey AS STRING) AS user_id, 1 AS seq, 'Industry' AS preference_type, c_mktsegment AS value, CAST(0.6 AS DOUBLE) AS weight FROM {customer}
        UNION ALL SELECT 'u' || CAST(c_custkey AS STRING), 2, 'Innovation', 'high', CAST(0.2 AS DOUBLE) FROM {customer} WHERE c_custkey % 3 = 0""",
    "constraints": "SELECT 'u' || CAST(c_custkey AS STRING) AS user_id, 1 AS seq, n_name AS location, CAST(c_acctbal * 3 AS DOUBLE) AS min_salary FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey WHERE c_custkey % 2 = 0",
    "certifications": "SELECT DISTINCT 'u' || CAST(o_custkey AS STRING) AS user_id, 0 AS seq, 'Cert ' || o_orderpriority AS name FROM {orders} WHERE o_orderstatus = 'P'",
    "languages": "SELECT 'u' || CAST(c_custkey AS STRING) AS user_id, r_regionkey AS seq, r_name AS language FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey JOIN {region} ON r_regionkey <= n_regionkey",
    "projects": "SELECT DISTINCT 'u' || CAST(user_id AS STRING) AS user_id, 0 AS seq, event_type AS name FROM {events}",
}


def assembled(s, d):
    """Whole profiles: the user's row with eight child tables."""
    u = bind(s, d, "SELECT 'u' || CAST(c_custkey AS STRING) AS user_id, c_name AS name FROM {customer}")
    out = pf.assemble(u, {"skills": us(s, d), "education": edu_rows(s, d), **{name: bind(s, d, sql) for name, sql in CHILDREN.items()}})
    joined = lambda c, f: F.array_join(F.transform(c, f), "|")
    return out.select(
        "user_id", "name", F.size("skills").alias("n_skills"), F.size("education").alias("n_education"), joined("skills", lambda x: x["name"]).alias("skills"),
        joined("work_experience", lambda x: x["company"]).alias("companies"), r6e(F.aggregate("work_experience", F.lit(0.0), lambda t, x: t + x["duration_years"])).alias("years"),
        joined("preferences", lambda x: F.concat(x["preference_type"], F.lit("="), x["value"])).alias("preferences"), F.get("constraints", F.lit(0))["location"].alias("location"),
        joined("certifications", lambda x: x["name"]).alias("certifications"), joined("languages", lambda x: x["language"]).alias("languages"), joined("projects", lambda x: x["name"]).alias("projects"))


def replaced(s, d):
    old = us(s, d).select("user_id", "name")
    new = bind(s, d, "SELECT 'u' || CAST(c_custkey AS STRING) AS user_id, n_name AS name FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey WHERE c_mktsegment = 'BUILDING'")
    return replace_users(old, new)


def display(s, d):
    n = k.user_skill_records(us(s, d), best_of(us(s, d), s, d, "name"))
    return pf.skills_with_names(us(s, d).select("user_id", "name"), n).select("user_id", "name", "display_name")


def latency(s, d):
    runs = bind(s, d, "SELECT value AS client_total_ms, value / 2 AS server_match_rank_ms, value / 4 AS server_total_ms, user_id AS jobs_processed, CASE event_type WHEN 'error' THEN 'boom' END AS error FROM {events}")
    out = pf.latency_summary(runs)
    return out.select("runs", *[r6(c).alias(c) for c in out.columns if c != "runs"])


def users_newest(s, d):
    u = bind(s, d, "SELECT 'u' || CAST(o_custkey AS STRING) AS user_id, max(o_orderdate) AS seen FROM {orders} GROUP BY o_custkey")
    return newest(u, "seen", 50, "user_id")


QUERIES = {
    "p31_typed_payload": payload, "p32_sanitized_profile": sanitized, "p33_violations": broken, "p34_text_lists": lists, "p38_packed_preferences": packed,
    "a12_skill_weights": weights, "a13_highest_education": best_edu, "a14_total_years": years, "a15_assembled_profiles": assembled,
    "s10_replace_child_rows": replaced, "j04_skills_with_names": display, "a24_latency_summary": latency, "l02_newest_users": users_newest,
}
US = f"us AS ({duck(USER_SKILLS_SQL)})"
UU = f"uu AS ({duck(USERS_SQL)})"
C = "FROM customer JOIN nation ON c_nationkey = n_nationkey"
_ED = "yr"
ORACLE = {
    "p31_typed_payload": f"""SELECT 'u' || c_custkey AS user_id, CASE WHEN c_mktsegment = 'BUILDING' THEN 'u' || c_custkey ELSE c_name END AS name, 'Bachelor' AS level, CASE WHEN c_nationkey BETWEEN 5 AND 20 THEN 1900 + c_nationkey * 10 ELSE 2020 END AS year,
        round(c_nationkey / 4.0, 6) AS gpa, 'General' AS category, round(c_acctbal / 5000, 6) AS proficiency, 'Innovation' AS pref, 0 AS n_work, '2024-03-0' || (1 + c_nationkey % 9) AS start_date, 2 AS n_skills {C}""",
    "p32_sanitized_profile": f"""SELECT 'u' || c_custkey AS user_id, 1 AS n_skills, round(least(1, greatest(0, c_acctbal / 5000)), 6) AS proficiency, round(least(60, c_nationkey * 4)::DOUBLE, 6) AS years, 1.0 AS weight, n_name AS locations,
        round(greatest(0, c_acctbal), 6) AS min_salary, round(least(5, c_nationkey / 4.0), 6) AS gpa {C}""",
    "p33_violations": f"""WITH p AS (SELECT 'u' || c_custkey AS user_id, * {C}) SELECT user_id, 'Education #1: GPA should be between 0 and 5 (or leave blank).' AS message FROM p WHERE c_nationkey / 4.0 > 5
        UNION ALL SELECT user_id, 'Skill #1: proficiency must be between 0 and 1.' FROM p WHERE c_acctbal / 5000 NOT BETWEEN 0 AND 1 UNION ALL SELECT user_id, 'Skill #1: years of experience must be between 0 and 60.' FROM p WHERE c_nationkey * 4 > 60
        UNION ALL SELECT user_id, 'Preference #1: weight must be between 0 and 1.' FROM p UNION ALL SELECT user_id, 'Minimum expected salary cannot be greater than maximum salary.' FROM p WHERE c_acctbal > 4000""",
    "p34_text_lists": f"SELECT c_custkey, c_name || '|' || c_mktsegment || '|' || n_name AS items, c_name || '|' || c_mktsegment || ',, ' || n_name AS lines, n_name || ':2' AS x, 1 AS n {C}",
    "p38_packed_preferences": f"""SELECT c_custkey, array_to_string(list_filter([c_mktsegment, 'BUILDING'], lambda x: x IN ('AUTOMOBILE','BUILDING','FURNITURE')), '|') AS a_checked,
        array_to_string(list_filter([c_mktsegment, n_name], lambda x: x NOT IN ('AUTOMOBILE','BUILDING','FURNITURE')), ', ') AS a_other, array_to_string(list_filter([c_mktsegment, 'BUILDING'], lambda x: x IN ('AUTOMOBILE','BUILDING','FURNITURE')), '|') AS b_checked,
        n_name AS b_other, array_to_string(list_concat(list_filter(['AUTOMOBILE','BUILDING','FURNITURE'], lambda x: x IN (c_mktsegment, 'BUILDING')), [n_name]), '|') AS merged {C}""",
    "a12_skill_weights": f"WITH {US}, n AS (SELECT user_id, count(*) AS n_skills FROM us GROUP BY 1) SELECT user_id, n_skills, lower(name) AS skill, round(proficiency * (1 + years_of_experience * 0.1), 6) AS w FROM us JOIN n USING (user_id)",
    "a13_highest_education": f"WITH {UU} SELECT user_id, CASE WHEN edu > 3 THEN ['High School','Associate','Bachelor','Master','PhD'][edu] ELSE 'Bachelor' END AS level, CASE WHEN edu >= 3 THEN 'a' ELSE 'b' END AS major FROM uu",
    "a14_total_years": "SELECT 'u' || o_custkey AS user_id, round(sum(o_totalprice / 100000) + 1e-9, 6) AS years FROM orders GROUP BY o_custkey",
    "a15_assembled_profiles": f"""WITH {US}, {UU}, g AS (SELECT user_id, count(*) AS n, string_agg(name, '|' ORDER BY name) AS l FROM us GROUP BY 1),
        w AS (SELECT user_id, string_agg(company, '|' ORDER BY seq) AS c, sum(duration_years) AS y FROM ({duck(CHILDREN['work_experience'])}) GROUP BY 1), pr AS (SELECT user_id, string_agg(preference_type || '=' || value, '|' ORDER BY seq) AS l FROM ({duck(CHILDREN['preferences'])}) GROUP BY 1),
        co AS ({duck(CHILDREN['constraints'])}), ce AS (SELECT user_id, string_agg(name, '|' ORDER BY name) AS l FROM ({duck(CHILDREN['certifications'])}) GROUP BY 1), la AS (SELECT user_id, string_agg(language, '|' ORDER BY seq) AS l FROM ({duck(CHILDREN['languages'])}) GROUP BY 1),
        pj AS (SELECT user_id, string_agg(name, '|' ORDER BY name) AS l FROM ({duck(CHILDREN['projects'])}) GROUP BY 1)
        SELECT uu.user_id, uu.name, CAST(coalesce(g.n, 0) AS INT) AS n_skills, CASE WHEN edu > 0 THEN 2 ELSE 1 END AS n_education, coalesce(g.l, '') AS skills, coalesce(w.c, '') AS companies, round(coalesce(w.y, 0) + 1e-9, 6) AS years, coalesce(pr.l, '') AS preferences, co.location,
        coalesce(ce.l, '') AS certifications, coalesce(la.l, '') AS languages, coalesce(pj.l, '') AS projects FROM uu LEFT JOIN g USING (user_id) LEFT JOIN w USING (user_id) LEFT JOIN pr USING (user_id) LEFT JOIN co USING (user_id) LEFT JOIN ce USING (user_id) LEFT JOIN la USING (user_id) LEFT JOIN pj USING (user_id)""",
    "s10_replace_child_rows": f"WITH {US}, nw AS (SELECT 'u' || c_custkey AS user_id, n_name AS name {C} WHERE c_mktsegment = 'BUILDING') SELECT user_id, name FROM us WHERE user_id NOT IN (SELECT user_id FROM nw) UNION ALL SELECT * FROM nw",
    "j04_skills_with_names": f"WITH RECURSIVE {US}, {BEST_OF_USERS} SELECT user_id, name, coalesce(normalized, name) AS display_name FROM us LEFT JOIN best ON phrase = name",
    "a24_latency_summary": """SELECT count(*) AS runs, round(avg(value), 6) AS avg_client_ms, round(avg(value / 2), 6) AS avg_match_rank_ms, round(avg(value / 4), 6) AS avg_total_ms, round(min(value), 6) AS min_client_ms, round(max(value), 6) AS max_client_ms,
        round(avg(user_id), 6) AS avg_jobs FROM events WHERE event_type <> 'error'""",
    "l02_newest_users": "SELECT 'u' || o_custkey AS user_id, max(o_orderdate) AS seen FROM orders GROUP BY o_custkey ORDER BY seen DESC, user_id LIMIT 50",
}
