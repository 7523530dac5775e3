"""Matching and ranking queries: all users against all postings."""

from pyspark.sql import functions as F

from vacantia.config import RankerConfig
from vacantia.functions import scoring as sc
from vacantia.operators import matching as m
from vacantia.operators import ranking as rk
from vacantia.operators import reasoning as rs
from vacantia.operators import recommend as rc
from vacantia.operators.catalog import salary_display
from vacantia.operators.features import posting_features, profile_features
from vacantia.plans.bindings import MENTIONED_SQL, USER_SKILLS_SQL, USERS_SQL, bind, duck, profiles
from vacantia.sources import sinks
from vacantia.util import r6, r6e

from . import merge
from .merge import UNIFIED

AS_OF = "1998-06-01 00:00:00"


def users(spark, d):
    return profile_features(profiles(spark, d))


def postings(spark, d):
    """The merged table, each posting once, with the skills mentioned for it."""
    skills = bind(spark, d, MENTIONED_SQL).groupBy("job_id").agg(F.array_sort(F.collect_set("skill_text")).alias("required_skills"))
    return posting_features(merge.postings(spark, d).join(skills, "job_id", "left"), AS_OF)


def matched(spark, d):
    return m.match(users(spark, d), postings(spark, d))


SCORES = ["skill_score", "education_score", "experience_score", "preference_score", "salary_score", "location_score"]


def ids(df, *more):
    return df.select(F.col("u_user_id").alias("user_id"), F.col("p_job_id").alias("job_id"), *more)


# --- SQL twin of the whole chain -----------------------------------------------------------
def _sig(x, k, x0=0.0):
    return f"(1.0 / (1.0 + exp(least(700, -({k}) * (({x}) - ({x0}))))))"


USERS = f"users AS ({duck(USERS_SQL)})"
USK = f"usk AS (SELECT user_id, lower(name) AS skill, proficiency, years_of_experience AS yrs, proficiency * (1 + years_of_experience * 0.1) AS w FROM ({duck(USER_SKILLS_SQL)})), un AS (SELECT user_id, count(*) AS nu FROM usk GROUP BY 1)"
JSK = f"jsk AS (SELECT DISTINCT m.job_id, skill_text AS skill FROM ({duck(MENTIONED_SQL)}) m JOIN postings USING (job_id)), jn AS (SELECT job_id, count(*) AS nj FROM jsk GROUP BY 1)"
POST = f"""p0 AS (SELECT *, list_transform(regexp_extract_all(salary, '\\d[\\d,]*\\.?\\d*'), lambda x: CAST(replace(x, ',', '') AS DOUBLE)) AS nums,
  CAST(floor((epoch(TIMESTAMP '{AS_OF}') - epoch(coalesce(published_date, created))) / 86400.0) AS INT) AS days0,
  CAST(floor((epoch(closing_date) - epoch(TIMESTAMP '{AS_OF}')) / 86400.0) AS INT) AS to_close FROM postings),
p1 AS (SELECT *, coalesce(salary_min::DOUBLE, CASE WHEN salary_max IS NULL THEN list_min(nums) END) AS lo, coalesce(salary_max::DOUBLE, CASE WHEN salary_min IS NULL THEN list_max(nums) END) AS hi, greatest(0, days0) AS days FROM p0),
post AS (SELECT job_id, title, company, location, salary AS salary_text, (lo + hi) / 2.0 AS sal, lo, hi, coalesce(required_experience_years, 0) AS req_years, required_education AS req_edu,
  lower(trim(industry)) AS ind, industry, coalesce(nullif(job_type,''), 'Full-time') AS wt, coalesce(published_date, created)::DATE AS start_d, days, to_close, description,
  coalesce(view_count, 0) AS views, coalesce(application_count, 0) AS apps,
  CASE WHEN competition_level IS NOT NULL THEN least(1.0, greatest(0.0, competition_level)) WHEN coalesce(view_count,0) > 0 OR coalesce(application_count,0) > 0 THEN least(1.0, least(1.0, coalesce(view_count,0) / 5000.0) * 0.7 + least(1.0, coalesce(application_count,0) / 200.0) * 0.3)
       WHEN days <= 3 THEN 0.7 WHEN days <= 14 THEN 0.5 WHEN days <= 30 THEN 0.35 ELSE 0.25 END AS comp,
  0.6 * least(1.0, 0.45 + 0.08 * ({' + '.join(f"contains(tr, '{w}')::INT" for w in ('ai', 'machine learning', 'data', 'cloud', 'security', 'platform', 'backend', 'software', 'analytics', 'product'))}))
    + 0.4 * CASE WHEN days <= 7 THEN 0.9 WHEN days <= 21 THEN 0.75 WHEN days <= 45 THEN 0.6 ELSE 0.45 END AS market
 FROM (SELECT *, lower(title || ' ' || coalesce(category,'') || ' ' || coalesce(subcategory,'') || ' ' || coalesce(industry,'Unknown')) AS tr FROM p1))"""
#: Pairs to score whether they fit or not: users with the postings made from their own orders and order lines.
GIVEN_SQL = """SELECT 'u' || CAST(o_custkey AS STRING) AS user_id, 'jobs_ac_uk_' || CAST(o_orderkey AS STRING) AS job_id FROM {orders}
UNION SELECT 'u' || CAST(o_custkey AS STRING), 'adzuna_' || CAST(l_orderkey AS STRING) || '-' || CAST(l_linenumber AS STRING) || '-' || CAST(l_partkey AS STRING) || '-' || CAST(l_suppkey AS STRING)
FROM {orders} JOIN {lineitem} ON o_orderkey = l_orderkey"""
_SCALE = [1.0, 1000.0, 10000.0]
_OKS = " OR ".join(f"(sal/{x} >= min_salary AND coalesce(sal/{x} <= max_salary*3.0, true))" for x in _SCALE)
_PLS = " OR ".join(f"(sal/{x} >= min_salary/2.0 AND sal/{x} <= coalesce(max_salary, min_salary)*2.0)" for x in _SCALE)
CANDS = f"""cand AS (SELECT * FROM users CROSS JOIN post WHERE place IS NULL OR contains(location, place) OR contains(place, location)),
chk AS (SELECT *, CASE WHEN sal IS NULL THEN NULL ELSE ({_OKS}) END AS s_ok, ({_PLS}) AS s_pl,
  (CASE WHEN work_type IS NULL THEN true WHEN contains(lower(work_type),'full') THEN contains(lower(wt),'full')
        ELSE contains(lower(wt),'part') END)
  AND (industry_u IS NULL OR contains(ind, lower(industry_u)) OR contains(lower(industry_u), ind))
  AND NOT coalesce(start_d < start_date::DATE, false)
  AND NOT coalesce(contains(lower(company), lower(excluded)) OR contains(lower(excluded), lower(company)), false) AS rest
  FROM (SELECT * RENAME (industry_1 AS industry_p) FROM (SELECT c.*, c.industry AS industry_u FROM cand c) x)),
base AS (SELECT * FROM chk WHERE CASE WHEN sal IS NULL THEN rest ELSE s_ok OR (NOT s_pl AND rest) END)"""


def chain(pairs: str = "base") -> str:
    return f"""
ov AS (SELECT b.user_id, b.job_id, count(*) AS hit, sum(least(w, 1.0)) AS sw FROM {pairs} b JOIN jsk USING (job_id) JOIN usk ON usk.user_id = b.user_id AND usk.skill = jsk.skill GROUP BY 1, 2),
f AS (SELECT b.*, coalesce(nj,0) AS nj, coalesce(nu,0) AS nu, coalesce(hit,0) AS hit, coalesce(sw,0.0) AS sw,
  CASE req_edu WHEN 'Bachelor' THEN 3 WHEN 'Master' THEN 4 WHEN 'PhD' THEN 5 END AS need
  FROM {pairs} b LEFT JOIN jn USING (job_id) LEFT JOIN un ON un.user_id = b.user_id LEFT JOIN ov ON ov.user_id = b.user_id AND ov.job_id = b.job_id),
s0 AS (SELECT *, hit / nj AS cov, (hit / nj) * 0.5 + (sw / nj) * 0.3 + (hit / (nj + nu - hit)) * 0.2 AS raw,
  CASE WHEN edu >= need THEN 1.0 ELSE greatest(0.3, edu / need) END AS e0 FROM f),
s1 AS (SELECT *, CASE WHEN nj = 0 THEN 0.5 WHEN nu = 0 THEN 0.0 ELSE least(1.0, CASE WHEN cov < 0.5 THEN greatest(0.0, raw - (0.5 - cov) * 0.5) ELSE raw END) END AS skill_score,
  CASE WHEN gpa >= 3.5 THEN least(1.0, e0 * 1.1) ELSE e0 END AS e1 FROM s0),
s2 AS (SELECT *, CASE WHEN need IS NULL THEN 1.0 WHEN edu = 0 THEN 0.3 WHEN ranking = '985' THEN least(1.0, e1 * 1.15) ELSE e1 END AS education_score,
  CASE WHEN req_years = 0 THEN 1.0 WHEN years >= req_years THEN CASE WHEN years <= req_years * 1.5 THEN 1.0 ELSE 1.0 - {_sig('years - req_years * 1.5', 0.3, 2.0)} * 0.3 END
       ELSE {_sig('years / req_years', 5.0, 0.7)} END AS experience_score,
  ((CASE WHEN industry_p = segment THEN 1.0 ELSE 0.3 END) * 0.6 + 1.0 * 0.3 + 0.5 * 0.2) / 1.1 AS preference_score,
  CASE WHEN sal IS NULL OR sal = 0 THEN 0.5
       WHEN min_salary <> 0 AND coalesce(max_salary, 0) <> 0 THEN CASE WHEN min_salary <= sal AND sal <= max_salary THEN 0.7 + 0.3 * (sal - min_salary) / (max_salary - min_salary) WHEN sal > max_salary THEN 1.0 ELSE 0.3 END
       WHEN min_salary <> 0 THEN CASE WHEN sal >= min_salary THEN least(1.0, 0.7 + 0.3 * {_sig('(sal - min_salary) / min_salary', 2.0)}) ELSE 0.3 END ELSE 0.5 END AS salary_score,
  CASE WHEN place IS NULL THEN 1.0 WHEN place = location THEN 1.0 WHEN contains(location, place) OR contains(place, location) THEN 0.8 ELSE 0.3 END AS location_score FROM s1),
sm AS (SELECT *, skill_score * 0.4 + education_score * 0.15 + experience_score * 0.15 + preference_score * 0.15 + salary_score * 0.1 + location_score * 0.05 AS match_score FROM s2),
so AS (SELECT *, match_score >= 0.3 AS passes,
  CASE WHEN industry_u IS NULL THEN (match_score * 0.45 + skill_score * 0.30 + preference_score * 0.15) / 0.90
       ELSE match_score * 0.45 + skill_score * 0.30 + preference_score * 0.15 + (CASE WHEN contains(ind, lower(industry_u)) OR contains(lower(industry_u), ind) THEN 1.0 ELSE 0.35 END) * 0.10 END AS relevance,
  CASE WHEN sal IS NULL THEN NULL WHEN max_salary > min_salary THEN CASE WHEN min_salary <= sal AND sal <= max_salary THEN 1.0 WHEN sal < min_salary THEN greatest(0.25, sal / min_salary) ELSE greatest(0.35, 1.0 - least((sal - max_salary) / greatest(max_salary, 1e-6), 1.0) * 0.65) END
       WHEN min_salary > 0 THEN least(1.0, {_sig('sal / min_salary - 1.0', 2.0)}) END AS attain,
  CASE WHEN nj > 0 THEN 0.7 * least(1.0, (nj - hit) * 0.12) + 0.3 * (nj - hit) / nj END AS g_skill,
  CASE WHEN sal <> 0 AND min_salary <> 0 THEN least(1.0, {_sig('sal / greatest(min_salary, 1e-6) - 1', 2.2, 0.15)}) END AS g_sal, 0.65 AS g_car FROM sm),
sf AS (SELECT *, (skill_score * 0.30 + experience_score * 0.20 + education_score * 0.15 + coalesce(attain * 0.15, 0) + location_score * 0.10 + greatest(0.2, 1.0 - 0.7 * comp) * 0.10)
    / (0.30 + 0.20 + 0.15 + CASE WHEN attain IS NULL THEN 0 ELSE 0.15 END + 0.10 + 0.10) AS feasibility,
  (coalesce(g_skill * 0.35, 0) + coalesce(g_sal * 0.25, 0) + g_car * 0.20 + market * 0.20) / (CASE WHEN g_skill IS NULL THEN 0 ELSE 0.35 END + CASE WHEN g_sal IS NULL THEN 0 ELSE 0.25 END + 0.40) AS growth FROM so),
scored AS (SELECT *, relevance * 0.4 + feasibility * 0.35 + growth * 0.25 AS final_score FROM sf),
gate AS (SELECT user_id, bool_or(passes) AS any_pass FROM scored GROUP BY 1),
gated AS (SELECT s.*, NOT any_pass AS used_relaxed FROM scored s JOIN gate USING (user_id) WHERE passes OR NOT any_pass)"""


W0 = f"WITH {UNIFIED}, {USERS}, {POST}, {CANDS}"
W = f"WITH {UNIFIED}, {USERS}, {USK}, {JSK}, {POST}, {CANDS}, {chain()}"
PAIRS = f"given AS (SELECT user_id AS gu, job_id AS gj FROM ({duck(GIVEN_SQL)}))"
WG = f"""WITH {UNIFIED}, {USERS}, {USK}, {JSK}, {POST}, {PAIRS},
chk AS (SELECT *, CASE WHEN sal IS NULL THEN NULL ELSE ({_OKS}) END AS s_ok, ({_PLS}) AS s_pl, (place IS NULL OR contains(location, place) OR contains(place, location)) AS loc_ok,
  (CASE WHEN work_type IS NULL THEN true WHEN contains(lower(work_type),'full') THEN contains(lower(wt),'full') ELSE contains(lower(wt),'part') END)
  AND (industry_u IS NULL OR contains(ind, lower(industry_u)) OR contains(lower(industry_u), ind)) AND NOT coalesce(start_d < start_date::DATE, false)
  AND NOT coalesce(contains(lower(company), lower(excluded)) OR contains(lower(excluded), lower(company)), false) AS rest
  FROM (SELECT u.*, u.industry AS industry_u, p.* RENAME (industry AS industry_p) FROM given JOIN users u ON gu = user_id JOIN post p ON gj = job_id)), {chain('chk')}"""


def given_pairs(spark, d):
    return bind(spark, d, GIVEN_SQL)


def given_scored(spark, d):
    return m.score_given_pairs(given_pairs(spark, d), users(spark, d), postings(spark, d))


def features(spark, d):
    return postings(spark, d).select(
        F.col("p_job_id").alias("job_id"), r6e("p_salary").alias("salary"), F.col("p_required_experience_years").alias("years"),
        F.col("p_required_education").alias("education"), F.col("p_industry").alias("industry"), F.col("p_work_type").alias("work_type"),
        F.col("p_days_since_posted").alias("days"), F.col("p_days_to_close").alias("to_close"), F.col("p_view_count").alias("views"),
        F.col("p_application_count").alias("applications"), r6e("p_competition_level").alias("competition"), r6e("p_market_signal").alias("market"),
        F.col("p_title_seniority_level").alias("seniority"), F.col("p_description_snippet").alias("snippet"))


def salary_shown(spark, d):
    return postings(spark, d).select(F.col("p_job_id").alias("job_id"), salary_display("p_salary_text", "p_salary_min", "p_salary_max").alias("shown"),
                                     salary_display(F.lit(None).cast("string"), F.col("p_salary_min").cast("bigint"), F.col("p_salary_max").cast("bigint")).alias("range_only"))


def constraint_flags(spark, d):
    rows = given_pairs(spark, d).select(F.col("user_id").alias("u_user_id"), F.col("job_id").alias("p_job_id"))
    rows = m.given_rows(rows, users(spark, d), postings(spark, d))
    return ids(rows, sc.location_ok().alias("location"), sc.salary_ok().alias("salary"), sc.work_type_ok().alias("work_type"),
               sc.industry_ok().alias("industry"), sc.start_date_ok().alias("start_date"), sc.company_allowed().alias("company"),
               sc.constraints_ok().alias("all_default"), sc.constraints_ok(True).alias("all_strict"))


def scored_all(spark, d):
    return ids(m.all_scored(users(spark, d), postings(spark, d), [*SCORES, "match_score"]), *[r6e(c).alias(c) for c in SCORES], r6e("match_score").alias("match_score"))


def explained(spark, d):
    best = rc.best_rows(rc.Sides(users(spark, d), postings(spark, d)), 5, "match_score")
    return ids(m.top_matches(best.drop("score_rank"), 5), "match_rank", r6e("match_score").alias("match_score"), "used_relaxed", "explanation")


def objectives(spark, d):
    names = ["relevance", "feasibility", "growth", "final_score"]
    return ids(m.all_scored(users(spark, d), postings(spark, d), names), *[r6e(c).alias(c) for c in names])


PLAIN = RankerConfig(diversity_factor=0.0, calibration=False, top_k=10)
CALIBRATED = RankerConfig(diversity_factor=0.0, top_k=10)


def listed(spark, d, cfg):
    return rc.recommend(users(spark, d), postings(spark, d), cfg)


def ranked(cfg):
    def run(spark, d):
        return ids(listed(spark, d, cfg), "rank", r6e("final_score").alias("final_score"), "used_relaxed")
    return run


def capped(spark, d):
    top = m.relax(rc.best_rows(rc.Sides(users(spark, d), postings(spark, d)), 2000))
    return ids(top, "score_rank", r6e("final_score").alias("final_score"))


def ranking_text(spark, d):
    top = listed(spark, d, PLAIN)
    return ids(top, sc.ranking_explanation().alias("explanation"))


def summary(spark, d):
    s = rk.ranking_summary(listed(spark, d, PLAIN))
    return s.select(F.col("u_user_id").alias("user_id"), "total_jobs", *[r6e(c).alias(c) for c in (
        "avg_relevance", "avg_feasibility", "avg_growth", "top_relevance", "top_feasibility", "top_growth")],
        "high_quality", "medium_quality", "low_quality")


def recommendations(spark, d):
    """Default ranking with diversity and calibration, explained and shaped for the history."""
    top = listed(spark, d, RankerConfig(top_k=10))
    out = rs.gap_report(rs.skill_sets(top))
    return ids(out, "rank", r6e("final_score").alias("final_score"), sc.ranking_explanation().alias("explanation"), "reasoning",
               rs.format_gaps().alias("gaps"))


def gap_sets(spark, d):
    rows = rs.skill_sets(given_scored(spark, d))
    return ids(rows, F.array_join("matched_skills", "|").alias("matched"), F.array_join("missing_skills", "|").alias("missing"),
               F.array_join(F.transform("weak_skills", lambda w: w["skill"]), "|").alias("weak"), "constraints_satisfied",
               r6e("match_score").alias("match_score"))


def gap_texts(spark, d):
    rows = rs.gap_report(rs.skill_sets(rk.with_objectives(given_scored(spark, d))))
    return ids(rows, F.array_join("strengths", "; ").alias("strengths"), rs.format_gaps().alias("gaps"), "reasoning",
               F.size("learning_suggestions").alias("n_suggestions"))


def merged_answers(spark, d):
    rows = rs.gap_report(rs.skill_sets(rk.with_objectives(given_scored(spark, d)))).withColumnsRenamed({"u_user_id": "user_id", "p_job_id": "job_id"})
    answers = bind(spark, d, """SELECT 'u' || CAST(o_custkey AS STRING) AS user_id, 'jobs_ac_uk_' || CAST(o_orderkey AS STRING) AS job_id,
        CASE o_orderstatus WHEN 'F' THEN '{{"recommendation_reasoning": "external view of ' || o_orderpriority || '", "skill_gaps": [{{"skill": "welding"}}, {{"importance": "low"}}], "strengths": ["  "]}}'
             WHEN 'O' THEN '{{"recommendation_reasoning": "", "strengths": ["steady", ""]}}' ELSE 'not json' END AS answer_json FROM {orders}""")
    out = rs.overlay_answers(rows, answers.dropDuplicates(["user_id", "job_id"]), ["user_id", "job_id"])
    return out.select("user_id", "job_id", "reasoning", F.array_join("strengths", "; ").alias("strengths"), rs.format_gaps().alias("gaps"))


def diagnostics(spark, d):
    u, p = users(spark, d), postings(spark, d)
    return m.run_diagnostics(u, p, rc.recommend(u, p, PLAIN)).withColumnRenamed("u_user_id", "user_id")


def breakdowns(spark, d):
    """Effective weights per part of the three objectives, with the missing parts."""
    rows = rk.with_objectives(given_scored(spark, d), breakdowns=True)
    return ids(rows, r6e("feasibility_breakdown.components.salary_attainability.effective_weight").alias("salary_weight"),
               r6e("relevance_breakdown.components.match_alignment.effective_weight").alias("match_weight"),
               F.array_join("growth_breakdown.missing", "|").alias("growth_missing"))


def persisted(spark, d):
    """Append ranked rows to a history folder and read them back."""
    from vacantia.util import shared_dir
    top = rk.with_objectives(listed(spark, d, PLAIN), PLAIN, breakdowns=True).withColumn("explanation", sc.ranking_explanation())
    rec = sinks.match_records(top.withColumnsRenamed({"u_user_id": "user_id", "p_job_id": "job_id"}), "run-1", F.lit(AS_OF).cast("timestamp_ntz"),
                              {n: f"{n}_breakdown" for n in ("relevance", "feasibility", "growth")})
    path = shared_dir(spark, "history")
    sinks.append_matches(rec, path)
    back = spark.read.parquet(path)
    return back.select("user_id", "job_id", r6e("final_score").alias("final_score"), "explanation", "run_id",
                       r6e(F.get_json_object("score_breakdown_json", "$.relevance.components.match_alignment.effective_weight").cast("double")).alias("match_weight"))


def skyline(spark, d):
    lines = bind(spark, d, """SELECT l_suppkey, CAST(l_orderkey AS STRING) || '-' || CAST(l_linenumber AS STRING) || '-' || CAST(l_partkey AS STRING) AS line_id,
        l_quantity, l_extendedprice, l_discount FROM {lineitem}""")
    return rk.skyline(lines, "l_suppkey", "line_id", ["l_quantity", "l_extendedprice", "l_discount"], chunk_rows=1000).select("l_suppkey", "line_id")


def layers(spark, d):
    orders = bind(spark, d, "SELECT o_custkey, o_orderkey, o_totalprice, CAST(day(o_orderdate) AS DOUBLE) AS day, CAST(month(o_orderdate) AS DOUBLE) AS month FROM {orders}")
    return rk.pareto_layers(orders, "o_custkey", "o_orderkey", ["o_totalprice", "day", "month"]).select("o_custkey", "o_orderkey", "pareto_rank")


def pairwise_functions(spark, d):
    """Set, map and list similarities of each user's skills and each of the user's orders' skills."""
    u, p = users(spark, d), postings(spark, d)
    keys = given_pairs(spark, d).distinct().select(F.col("user_id").alias("u_user_id"), F.col("job_id").alias("p_job_id"))
    rows = m.given_rows(keys, u, p).withColumnsRenamed({"u_user_id": "user_id", "p_job_id": "job_id"})
    job_map = F.map_from_entries(F.transform("p_skills", lambda s: F.struct(s, F.lit(1.0))))
    o = sc.skill_overlap(F.col("u_skill_names"), F.col("p_skills"))
    return rows.select("user_id", "job_id", r6e(sc.jaccard(F.col("u_skill_names"), F.col("p_skills"))).alias("jaccard"),
                       r6e(o["coverage"]).alias("coverage"), r6e(o["match_rate"]).alias("match_rate"),
                       r6e(sc.sparse_cosine(F.col("u_skill_weights"), job_map)).alias("cosine"),
                       r6e(sc.weighted_skill_match(F.col("u_skill_weights"), job_map)).alias("weighted"))


def numeric_functions(spark, d):
    li = bind(spark, d, "SELECT l_orderkey, l_linenumber, l_partkey, l_quantity AS q, l_discount AS x, l_tax AS t FROM {lineitem}")
    q, x, t = F.col("q"), F.col("x"), F.col("t")
    return li.select(
        "l_orderkey", "l_linenumber", "l_partkey", r6e(sc.sigmoid(x, 5.0, 0.05)).alias("sig"), r6e(sc.exponential_decay(q, 0.1, 20.0)).alias("decay"),
        r6e(sc.linear_interpolation(q, F.lit(1.0), F.lit(0.0), F.lit(50.0), F.lit(1.0))).alias("lerp"),
        r6e(sc.weighted_average(F.array(q, x, t), F.array(F.lit(1.0), x, F.lit(2.0)))).alias("wavg"),
        sc.dominates([q, x], [F.lit(25.0), t]).alias("dom"), r6e(sc.safe_score(q / 40.0)).alias("safe"))


def rescaled(spark, d):
    li = bind(spark, d, "SELECT l_suppkey, l_orderkey, l_linenumber, l_partkey, l_quantity FROM {lineitem}")
    return rk.rescale(li, ["l_suppkey"], "l_quantity").select("l_suppkey", "l_orderkey", "l_linenumber", "l_partkey", r6e("scaled").alias("scaled"))


def percentiles(spark, d):
    ev = bind(spark, d, "SELECT event_id, event_type, value FROM {events}")
    return rk.percentile_rank(ev, ["event_type"], "value").select("event_id", r6e("percentile").alias("percentile"))


QUERIES = {
    "p15_p20_posting_features": features,
    "p21_salary_display": salary_shown,
    "f10_f14_constraint_flags": constraint_flags,
    "j15_c12_c16_all_pairs_scored": scored_all,
    "f15_w04_c17_top_matches_explained": explained,
    "c18_c20_objectives": objectives,
    "w03_ranked_top_10": ranked(PLAIN),
    "w07_calibrated_ranking": ranked(CALIBRATED),
    "w08_diverse_ranking": ranked(RankerConfig(top_k=10)),
    "w09_pareto_ranking": ranked(RankerConfig(top_k=10, use_pareto=True, diversity_factor=0.0, calibration=False)),
    "w10_candidate_cap": capped,
    "c21_ranking_explanation": ranking_text,
    "a18_ranking_summary": summary,
    "j23_j17_gap_sets_of_given_pairs": gap_sets,
    "c22_c26_gap_texts": gap_texts,
    "c23_overlay_external_answers": merged_answers,
    "a26_run_diagnostics": diagnostics,
    "a17_score_breakdowns": breakdowns,
    "s11_append_match_history": persisted,
    "recommendations_end_to_end": recommendations,
    "j20_skyline_per_group": skyline,
    "w09_pareto_layers": layers,
    "c01_c06_pair_similarities": pairwise_functions,
    "c03_c11_numeric_helpers": numeric_functions,
    "w11_rescale": rescaled,
    "w12_percentile_rank": percentiles,
}
def _pc(x):
    return f"(CAST(round_even(round(({x}) * 100, 7), 0) AS BIGINT)::VARCHAR || '%')"


_RANKED = "SELECT user_id, job_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY round(final_score, 9) DESC, round(match_score, 9) DESC, job_id) AS INT) AS rank, round(final_score + 1e-9, 6) AS final_score, used_relaxed FROM gated"
_REXP = " || ' | ' || ".join(
    f"(CASE WHEN {c} >= 0.8 THEN '{a}' WHEN {c} >= 0.6 THEN '{b}' ELSE '{z}' END || ' (' || {_pc(c)} || ')')" for c, a, b, z in (
        ("relevance", "Highly relevant", "Moderately relevant", "Partially relevant"),
        ("feasibility", "Strong chance of landing this role", "Some chance of landing this role", "Competitive / difficult to land"),
        ("growth", "High growth potential", "Some growth opportunities", "Limited growth potential")))
_TOP10 = "top10 AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY round(final_score, 9) DESC, round(match_score, 9) DESC, job_id) AS rn FROM gated QUALIFY rn <= 10)"
_GAPS = """gs AS (SELECT s.user_id, s.job_id, string_agg(j.skill, '|' ORDER BY j.skill) FILTER (k.skill IS NOT NULL) AS matched, string_agg(j.skill, '|' ORDER BY j.skill) FILTER (k.skill IS NULL) AS missing,
  string_agg(j.skill, '|' ORDER BY j.skill) FILTER (k.proficiency < 0.65 OR k.yrs < 1) AS weak FROM scored s JOIN jsk j USING (job_id) LEFT JOIN usk k ON k.user_id = s.user_id AND k.skill = j.skill GROUP BY 1, 2)"""
_LISTS = """gl AS (SELECT s.user_id, s.job_id, coalesce(list(j.skill ORDER BY j.skill) FILTER (k.skill IS NOT NULL), []) AS ml, coalesce(list(j.skill ORDER BY j.skill) FILTER (j.skill IS NOT NULL AND k.skill IS NULL), []) AS mi,
  coalesce(list(j.skill ORDER BY j.skill) FILTER (k.proficiency < 0.65 OR k.yrs < 1), []) AS wk FROM scored s LEFT JOIN jsk j USING (job_id) LEFT JOIN usk k ON k.user_id = s.user_id AND k.skill = j.skill GROUP BY 1, 2),
  gt AS (SELECT s.*, ml, list_concat(mi[1:5], wk)[1:5] AS gn, list_concat(list_transform(mi[1:5], lambda x: x || ' (high)'), list_transform(wk, lambda x: x || ' (medium)'))[1:5] AS gx FROM scored s JOIN gl USING (user_id, job_id))"""
_R = "WITH RECURSIVE " + W.removeprefix("WITH ")
_PICKED = f"""{_R}, start AS (SELECT *, round(final_score, 9) AS fs, row_number() OVER (PARTITION BY user_id ORDER BY round(final_score, 9) DESC, round(match_score, 9) DESC, job_id) AS ord FROM gated),
walk AS (SELECT user_id, job_id, fs, company, industry_p, wt, ord, 0.0::DOUBLE AS sim, 0 AS step, ord = 1 AS chosen FROM start
  UNION ALL SELECT user_id, job_id, fs, company, industry_p, wt, ord2, sim2, step + 1, ord2 = 1 FROM (
    SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY fs * (1 - 0.1::DOUBLE * sim2) DESC, ord) AS ord2 FROM (
      SELECT *, greatest(sim, ((company = c1)::INT + (industry_p = i1)::INT + (wt = w1)::INT) / 3.0::DOUBLE) AS sim2 FROM (
        SELECT *, max(CASE WHEN chosen THEN company END) OVER u AS c1, max(CASE WHEN chosen THEN industry_p END) OVER u AS i1, max(CASE WHEN chosen THEN wt END) OVER u AS w1
        FROM walk WINDOW u AS (PARTITION BY user_id)) WHERE NOT chosen)) WHERE step < 9),
cal AS (SELECT g.* EXCLUDE (final_score), step, final_score * (1.0 - step * 0.01) * CASE WHEN views > 1000 THEN 0.95 ELSE 1.0 END * CASE WHEN days > 30 THEN 0.9 ELSE 1.0 END AS final_score
  FROM walk w JOIN gated g ON g.user_id = w.user_id AND g.job_id = w.job_id WHERE chosen),
lst AS (SELECT *, CAST(row_number() OVER (PARTITION BY user_id ORDER BY round(final_score, 9) DESC, step) AS INT) AS rank FROM cal)"""
_LIST_ROWS = """gl AS (SELECT s.user_id, s.job_id, coalesce(list(j.skill ORDER BY j.skill) FILTER (k.skill IS NOT NULL), []) AS ml, coalesce(list(j.skill ORDER BY j.skill) FILTER (j.skill IS NOT NULL AND k.skill IS NULL), []) AS mi,
  coalesce(list(j.skill ORDER BY j.skill) FILTER (k.proficiency < 0.65 OR k.yrs < 1), []) AS wk FROM lst s LEFT JOIN jsk j USING (job_id) LEFT JOIN usk k ON k.user_id = s.user_id AND k.skill = j.skill GROUP BY 1, 2),
  gt AS (SELECT s.*, list_concat(mi[1:5], wk)[1:5] AS gn, list_concat(list_transform(mi[1:5], lambda x: x || ' (high)'), list_transform(wk, lambda x: x || ' (medium)'))[1:5] AS gx FROM lst s JOIN gl USING (user_id, job_id))"""
ORACLE = {
    "w08_diverse_ranking": f"{_PICKED} SELECT user_id, job_id, rank, round(final_score + 1e-9, 6) AS final_score, used_relaxed FROM lst",
    "recommendations_end_to_end": f"""{_PICKED}, {_LIST_ROWS} SELECT user_id, job_id, rank, round(final_score + 1e-9, 6) AS final_score, {_REXP} AS explanation,
        'Overall fit is about ' || {_pc('round(final_score, 4)')} || ' (relevance ' || {_pc('round(relevance, 4)')} || '). Use that as a rough readiness signal alongside your own review of the full posting.'
        || CASE WHEN len(gn) > 0 THEN ' Concrete gaps to address: ' || array_to_string(gn[1:4], ', ') || '. Closing these will materially improve alignment.'
           ELSE ' Against the skills we can see, you largely meet requirements; focus next on depth, proof of impact, and any niche tools the employer stresses.' END
        || ' Plan development in short milestones (courses, certifications, or scoped projects) rather than vague study goals.' AS reasoning,
        CASE WHEN len(gx) = 0 THEN 'No obvious skill gaps identified' ELSE array_to_string(gx[1:3], ', ') END AS gaps FROM gt""",
    "c22_c26_gap_texts": f"""{WG}, {_LISTS} SELECT user_id, job_id, concat_ws('; ', CASE WHEN len(ml) > 0 THEN 'Covered core skills: ' || array_to_string(ml[1:3], ', ') END,
        CASE WHEN education_score >= 0.9 THEN 'Education background is well aligned with the job requirements.' END, CASE WHEN location_score >= 0.8 THEN 'Job location matches the user''s preference.' END) AS strengths,
        CASE WHEN len(gx) = 0 THEN 'No obvious skill gaps identified' ELSE array_to_string(gx[1:3], ', ') END AS gaps,
        'Overall fit is about ' || {_pc('round(final_score, 4)')} || ' (relevance ' || {_pc('round(relevance, 4)')} || '). Use that as a rough readiness signal alongside your own review of the full posting.'
        || CASE WHEN len(gn) > 0 THEN ' Concrete gaps to address: ' || array_to_string(gn[1:4], ', ') || '. Closing these will materially improve alignment.'
           ELSE ' Against the skills we can see, you largely meet requirements; focus next on depth, proof of impact, and any niche tools the employer stresses.' END
        || ' Plan development in short milestones (courses, certifications, or scoped projects) rather than vague study goals.' AS reasoning, CAST(CASE WHEN len(gx) = 0 THEN 1 ELSE least(3, len(gx)) END AS INT) AS n_suggestions FROM gt""",
    "c23_overlay_external_answers": f"""{WG}, {_LISTS}, st AS (SELECT DISTINCT 'jobs_ac_uk_' || CAST(o_orderkey AS VARCHAR) AS job_id, o_orderstatus, o_orderpriority FROM orders),
        b AS (SELECT gt.user_id, gt.job_id, o_orderstatus AS os, o_orderpriority AS op, concat_ws('; ', CASE WHEN len(ml) > 0 THEN 'Covered core skills: ' || array_to_string(ml[1:3], ', ') END,
        CASE WHEN education_score >= 0.9 THEN 'Education background is well aligned with the job requirements.' END, CASE WHEN location_score >= 0.8 THEN 'Job location matches the user''s preference.' END) AS str,
        CASE WHEN len(gx) = 0 THEN 'No obvious skill gaps identified' ELSE array_to_string(gx[1:3], ', ') END AS gp,
        'Overall fit is about ' || {_pc('round(final_score, 4)')} || ' (relevance ' || {_pc('round(relevance, 4)')} || '). Use that as a rough readiness signal alongside your own review of the full posting.'
        || CASE WHEN len(gn) > 0 THEN ' Concrete gaps to address: ' || array_to_string(gn[1:4], ', ') || '. Closing these will materially improve alignment.'
           ELSE ' Against the skills we can see, you largely meet requirements; focus next on depth, proof of impact, and any niche tools the employer stresses.' END
        || ' Plan development in short milestones (courses, certifications, or scoped projects) rather than vague study goals.' AS rsn FROM gt LEFT JOIN st USING (job_id))
        SELECT user_id, job_id, CASE WHEN os = 'F' THEN 'external view of ' || op ELSE rsn END AS reasoning, CASE WHEN os = 'O' THEN 'steady' ELSE str END AS strengths,
        CASE WHEN os = 'F' THEN 'welding (medium)' ELSE gp END AS gaps FROM b""",
    "p15_p20_posting_features": f"""WITH {UNIFIED}, {POST} SELECT job_id, round(sal + 1e-9, 6) AS salary, req_years AS years, req_edu AS education, industry, wt AS work_type, days, to_close,
        views, apps AS applications, round(comp + 1e-9, 6) AS competition, round(market + 1e-9, 6) AS market, 0.65 AS seniority, description AS snippet FROM post""",
    "p21_salary_display": f"""WITH {UNIFIED}, {POST} SELECT job_id, CASE WHEN salary_text <> '' THEN salary_text WHEN coalesce(lo,0) = 0 AND coalesce(hi,0) = 0 THEN 'Salary not provided' ELSE CAST(lo AS VARCHAR) END AS shown,
        CASE WHEN coalesce(trunc(lo),0) = 0 AND coalesce(trunc(hi),0) = 0 THEN 'Salary not provided' WHEN coalesce(trunc(hi),0) = 0 OR trunc(lo) = trunc(hi) THEN CAST(CAST(trunc(lo) AS BIGINT) AS VARCHAR) WHEN coalesce(trunc(lo),0) = 0 THEN CAST(CAST(trunc(hi) AS BIGINT) AS VARCHAR)
          ELSE CAST(CAST(trunc(lo) AS BIGINT) AS VARCHAR) || '-' || CAST(CAST(trunc(hi) AS BIGINT) AS VARCHAR) END AS range_only FROM post""",
    "f10_f14_constraint_flags": f"""WITH {UNIFIED}, {USERS}, {POST}, {PAIRS}, x AS (SELECT u.*, u.industry AS industry_u, p.* RENAME (industry AS industry_p) FROM given JOIN users u ON gu = user_id JOIN post p ON gj = job_id),
        y AS (SELECT *, (place IS NULL OR contains(location, place) OR contains(place, location)) AS location_f, ({_OKS}) AS ok, ({_PLS}) AS pl,
        (CASE WHEN work_type IS NULL THEN true WHEN contains(lower(work_type),'full') THEN contains(lower(wt),'full') ELSE contains(lower(wt),'part') END) AS wf,
        (industry_u IS NULL OR contains(ind, lower(industry_u)) OR contains(lower(industry_u), ind)) AS indf, NOT coalesce(start_d < start_date::DATE, false) AS sf,
        NOT coalesce(contains(lower(company), lower(excluded)) OR contains(lower(excluded), lower(company)), false) AS cf FROM x)
        SELECT user_id, job_id, location_f AS location, (sal IS NULL OR ok OR NOT pl) AS salary, wf AS work_type, indf AS industry, sf AS start_date, cf AS company,
        location_f AND CASE WHEN sal IS NULL THEN wf AND indf AND sf AND cf ELSE ok OR (NOT pl AND wf AND indf AND sf AND cf) END AS all_default,
        location_f AND (sal IS NULL OR ok OR NOT pl) AND wf AND indf AND sf AND cf AS all_strict FROM y""",
    "j15_c12_c16_all_pairs_scored": f"{W} SELECT user_id, job_id, {', '.join(f'round({c} + 1e-9, 6) AS {c}' for c in SCORES)}, round(match_score + 1e-9, 6) AS match_score FROM scored",
    "f15_w04_c17_top_matches_explained": f"""{W}, t AS (SELECT *, CAST(row_number() OVER (PARTITION BY user_id ORDER BY round(match_score,9) DESC, job_id) AS INT) AS match_rank FROM gated QUALIFY match_rank <= 5)
        SELECT user_id, job_id, match_rank, round(match_score + 1e-9, 6) AS match_score, used_relaxed,
        concat_ws(';', CASE WHEN skill_score >= 0.8 THEN 'Your skills are a strong match for the job requirements (' || {_pc('skill_score')} || ')'
          WHEN skill_score >= 0.6 THEN 'Your skills broadly cover the job requirements (' || {_pc('skill_score')} || ')'
          ELSE 'Your skills partially match the job requirements (' || {_pc('skill_score')} || '); you may need to learn new skills' END,
          CASE WHEN education_score >= 0.9 THEN 'Your education background fully meets the requirements' END,
          CASE WHEN experience_score >= 0.8 THEN 'Your work experience is very matched' WHEN experience_score < 0.5 THEN 'This job may need more related experience' END,
          CASE WHEN salary_score >= 0.8 THEN 'Salary meets your expectations' END) AS explanation FROM t""",
    "c18_c20_objectives": f"{W} SELECT user_id, job_id, round(relevance + 1e-9, 6) AS relevance, round(feasibility + 1e-9, 6) AS feasibility, round(growth + 1e-9, 6) AS growth, round(final_score + 1e-9, 6) AS final_score FROM scored",
    "w03_ranked_top_10": f"{W} {_RANKED} QUALIFY rank <= 10",
    "w07_calibrated_ranking": f"""{W}, o AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY round(final_score,9) DESC, round(match_score,9) DESC, job_id) - 1 AS pos FROM gated),
        c AS (SELECT *, final_score * (1.0 - pos * 0.01) * CASE WHEN views > 1000 THEN 0.95 ELSE 1.0 END * CASE WHEN days > 30 THEN 0.9 ELSE 1.0 END AS fs FROM o)
        SELECT user_id, job_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY round(fs,9) DESC, pos) AS INT) AS rank, round(fs + 1e-9, 6) AS final_score, used_relaxed FROM c QUALIFY rank <= 10""",
    "w10_candidate_cap": f"{W} SELECT user_id, job_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY round(final_score,9) DESC, round(match_score,9) DESC, job_id) AS INT) AS score_rank, round(final_score + 1e-9, 6) AS final_score FROM gated QUALIFY score_rank <= 2000",
    "c21_ranking_explanation": f"{W}, {_TOP10} SELECT user_id, job_id, {_REXP} AS explanation FROM top10",
    "a18_ranking_summary": f"""{W}, {_TOP10} SELECT user_id, count(*) AS total_jobs, round(avg(relevance) + 1e-9, 6) AS avg_relevance, round(avg(feasibility) + 1e-9, 6) AS avg_feasibility, round(avg(growth) + 1e-9, 6) AS avg_growth,
        round(max(relevance) + 1e-9, 6) AS top_relevance, round(max(feasibility) + 1e-9, 6) AS top_feasibility, round(max(growth) + 1e-9, 6) AS top_growth, count(*) FILTER (final_score >= 0.8) AS high_quality,
        count(*) FILTER (final_score >= 0.6 AND final_score < 0.8) AS medium_quality, count(*) FILTER (final_score < 0.6) AS low_quality FROM top10 GROUP BY 1""",
    "j23_j17_gap_sets_of_given_pairs": f"""{WG}, {_GAPS} SELECT s.user_id, s.job_id, coalesce(matched,'') AS matched, coalesce(missing,'') AS missing, coalesce(weak,'') AS weak,
        loc_ok AND CASE WHEN sal IS NULL THEN rest ELSE s_ok OR (NOT s_pl AND rest) END AS constraints_satisfied, round(match_score + 1e-9, 6) AS match_score FROM scored s LEFT JOIN gs USING (user_id, job_id)""",
    "a26_run_diagnostics": f"""{W}, {_TOP10}, g AS (SELECT user_id, count(*) AS n, bool_or(used_relaxed) AS r FROM top10 GROUP BY 1)
        SELECT u.user_id, (SELECT count(*) FROM post) AS jobs_loaded, coalesce(n,0) AS returned, coalesce(r,false) AS used_relaxed_match,
        CASE WHEN n IS NULL THEN 'no_matches_after_constraints' END AS empty_reason FROM users u LEFT JOIN g USING (user_id)""",
    "a17_score_breakdowns": f"""{WG} SELECT user_id, job_id, round(CASE WHEN attain IS NULL THEN 0 ELSE 0.15 / 1.0 END + 1e-9, 6) AS salary_weight, round(CASE WHEN industry_u IS NULL THEN 0.45 / 0.9 ELSE 0.45 END + 1e-9, 6) AS match_weight,
        concat_ws('|', CASE WHEN g_skill IS NULL THEN 'skill_growth_potential' END, CASE WHEN g_sal IS NULL THEN 'salary_growth_potential' END) AS growth_missing FROM scored""",
    "s11_append_match_history": f"{W}, {_TOP10} SELECT user_id, job_id, round(final_score + 1e-9, 6) AS final_score, {_REXP} AS explanation, 'run-1' AS run_id, round(CASE WHEN industry_u IS NULL THEN 0.45 / 0.9 ELSE 0.45 END + 1e-9, 6) AS match_weight FROM top10",
    "j20_skyline_per_group": """WITH x AS (SELECT l_suppkey, CAST(l_orderkey AS STRING) || '-' || CAST(l_linenumber AS STRING) || '-' || CAST(l_partkey AS STRING) AS line_id, l_quantity AS a, l_extendedprice AS b, l_discount AS c FROM lineitem)
        SELECT l_suppkey, line_id FROM x WHERE NOT EXISTS (SELECT 1 FROM x y WHERE y.l_suppkey = x.l_suppkey AND y.a >= x.a AND y.b >= x.b AND y.c >= x.c AND (y.a > x.a OR y.b > x.b OR y.c > x.c))""",
    "w09_pareto_layers": """WITH RECURSIVE o AS (SELECT o_custkey, o_orderkey, o_totalprice AS a, day(o_orderdate) AS b, month(o_orderdate) AS c FROM orders),
        dom AS (SELECT x.o_custkey, x.o_orderkey AS lo, y.o_orderkey AS hi FROM o x JOIN o y ON y.o_custkey = x.o_custkey AND y.a >= x.a AND y.b >= x.b AND y.c >= x.c AND (y.a > x.a OR y.b > x.b OR y.c > x.c)),
        walk AS (SELECT o_custkey, o_orderkey, 1 AS depth FROM o UNION SELECT d.o_custkey, d.lo, w.depth + 1 FROM walk w JOIN dom d ON d.hi = w.o_orderkey)
        SELECT o_custkey, o_orderkey, CAST(max(depth) AS BIGINT) AS pareto_rank FROM walk GROUP BY 1, 2""",
    "c01_c06_pair_similarities": f"""WITH {UNIFIED}, {USERS}, {USK}, {JSK}, {POST}, g AS (SELECT DISTINCT gu AS user_id, gj AS job_id FROM ({PAIRS.split(' AS ', 1)[1][1:-1]}) JOIN post ON gj = job_id),
        nrm AS (SELECT user_id, sqrt(sum(w * w)) AS nw FROM usk GROUP BY 1),
        o AS (SELECT g.user_id, g.job_id, count(*) AS hit, sum(w) AS sw, sum(least(w,1.0)) AS lw FROM g JOIN jsk USING (job_id) JOIN usk ON usk.user_id = g.user_id AND usk.skill = jsk.skill GROUP BY 1, 2)
        SELECT g.user_id, g.job_id, round(CASE WHEN coalesce(nj,0) = 0 OR coalesce(nu,0) = 0 THEN 0 ELSE coalesce(hit,0) / (nj + nu - coalesce(hit,0)) END + 1e-9, 6) AS jaccard,
        round(CASE WHEN coalesce(nj,0) = 0 THEN 1 ELSE coalesce(hit,0) / nj END + 1e-9, 6) AS coverage, round(CASE WHEN coalesce(nj,0) = 0 THEN 1 WHEN coalesce(nu,0) = 0 THEN 0 ELSE coalesce(hit,0) / nu END + 1e-9, 6) AS match_rate,
        round(coalesce(sw / (sqrt(nj) * nw), 0) + 1e-9, 6) AS cosine, round(CASE WHEN coalesce(nj,0) = 0 THEN 1 ELSE coalesce(lw,0) / nj END + 1e-9, 6) AS weighted
        FROM g LEFT JOIN o USING (user_id, job_id) LEFT JOIN jn USING (job_id) LEFT JOIN un ON un.user_id = g.user_id LEFT JOIN nrm ON nrm.user_id = g.user_id""",
    "c03_c11_numeric_helpers": """SELECT l_orderkey, l_linenumber, l_partkey, round(1.0 / (1.0 + exp(-5.0 * (l_discount - 0.05))) + 1e-9, 6) AS sig, round(exp(-0.1 * greatest(0, l_quantity - 20.0)) + 1e-9, 6) AS decay,
        round((l_quantity - 1.0) / 49.0 + 1e-9, 6) AS lerp, round((l_quantity + l_discount * l_discount + 2 * l_tax) / (3.0 + l_discount) + 1e-9, 6) AS wavg,
        CASE WHEN (l_quantity > 25 OR l_discount > l_tax) AND NOT (l_quantity < 25 OR l_discount < l_tax) THEN 1
             WHEN (l_quantity < 25 OR l_discount < l_tax) AND NOT (l_quantity > 25 OR l_discount > l_tax) THEN -1 ELSE 0 END AS dom,
        round(least(1.0, greatest(0.0, l_quantity / 40.0)) + 1e-9, 6) AS safe FROM lineitem""",
    "w11_rescale": """WITH e AS (SELECT l_suppkey, min(l_quantity) AS a, max(l_quantity) AS b FROM lineitem GROUP BY 1)
        SELECT l_suppkey, l_orderkey, l_linenumber, l_partkey, round(CASE WHEN a = b THEN 0 ELSE (l_quantity - a) / (b - a) END + 1e-9, 6) AS scaled FROM lineitem JOIN e USING (l_suppkey)""",
    "w12_percentile_rank": """SELECT event_id, round((rank() OVER (PARTITION BY event_type ORDER BY value) - 1 + 0.5 * count(*) OVER (PARTITION BY event_type, value)) / count(*) OVER (PARTITION BY event_type) + 1e-9, 6) AS percentile FROM events""",
}
