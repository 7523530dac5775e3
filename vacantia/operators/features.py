"""Posting and profile features that the scores read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scoring as sc
from ..functions import text as tx
from ..util import blank_to_null, empty_to_null, strip
from .catalog import job_link, snippet
from .unify import raw_value


def _has(df: DataFrame, name: str, typ: str = "string") -> Column:
    return F.col(name) if name in df.columns else F.lit(None).cast(typ)


def _first_count(df: DataFrame, column: str, *payload: str) -> Column:
    """First non-zero whole number among a column and payload keys, else 0."""
    opts = [_has(df, column).try_cast("double")]
    if "raw_data" in df.columns:
        opts += [F.get_json_object("raw_data", f"$.{k}").try_cast("double") for k in (column, *payload)]
    ints = [o.try_cast("int") for o in opts]
    return F.coalesce(*[F.when(i != 0, i) for i in ints], F.lit(0))


def salary_bounds(df: DataFrame) -> DataFrame:
    """Resolve the numeric range (columns, else every number of the text) and its midpoint."""
    lo, hi = _has(df, "salary_min", "double").cast("double"), _has(df, "salary_max", "double").cast("double")
    df = df.withColumn("_nums", F.when(lo.isNull() & hi.isNull(), tx.all_numbers(_has(df, "salary"))))
    lo, hi = F.coalesce(lo, F.array_min("_nums")), F.coalesce(hi, F.array_max("_nums"))
    df = df.withColumn("_lo", lo).withColumn("_hi", hi)
    mid = F.when(F.col("_lo").isNotNull() & F.col("_hi").isNotNull(), (F.col("_lo") + F.col("_hi")) / 2.0).otherwise(
        F.coalesce("_lo", "_hi"))
    return df.withColumn("salary_value", mid).drop("_nums")


def competition(explicit: Column, views: Column, applications: Column, days: Column) -> Column:
    proxy = F.least(F.lit(1.0), F.least(F.lit(1.0), views / 5000.0) * 0.7 + F.least(F.lit(1.0), applications / 200.0) * 0.3)
    return (F.when(explicit.isNotNull(), F.least(F.greatest(explicit, F.lit(0.0)), F.lit(1.0)))
            .when((views > 0) | (applications > 0), proxy)
            .when(days.isNull(), 0.5).when(days <= 3, 0.7).when(days <= 14, 0.5).when(days <= 30, 0.35).otherwise(0.25))


def plain(c: Column) -> Column:
    return F.lower(strip(F.coalesce(c, F.lit(""))))


def plain_list(values: Column) -> Column:
    """Trimmed, lower-cased entries that are not empty."""
    return F.filter(F.transform(F.coalesce(values, F.array().cast("array<string>")), lambda x: F.lower(strip(x))), lambda x: F.coalesce(x != "", F.lit(False)))


def posting_features(df: DataFrame, as_of: str, skills: str = "required_skills") -> DataFrame:
    """One row per posting with ``p_`` columns, all relative to ``as_of``."""
    now = F.lit(as_of).cast("timestamp_ntz")
    df = salary_bounds(df)

    def ts(*names: str) -> Column:
        """First non-empty column of the list, as a timestamp."""
        opts = []
        for n in names:
            if n in df.columns:
                c = F.col(n)
                opts.append(tx.parse_timestamp(c).cast("timestamp_ntz") if dict(df.dtypes)[n] == "string" else c.cast("timestamp_ntz"))
        return F.coalesce(*opts) if opts else F.lit(None).cast("timestamp_ntz")

    df = df.withColumn("_posted", ts("published_date", "created", "placed_on"))
    df = df.withColumn("_days", F.greatest(F.lit(0), sc.days_between(now, F.col("_posted"))))
    df = df.withColumn("_days", F.when(F.col("_posted").isNotNull(), F.col("_days")))
    df = df.withColumn("_views", _first_count(df, "view_count", "views", "impressions"))
    df = df.withColumn("_apps", _first_count(df, "application_count", "applications"))
    years = F.coalesce(raw_value(df, "required_experience_years").try_cast("double"),
                       raw_value(df, "experience_years").try_cast("double"),
                       tx.required_years_in_text(tx.joined_lower(*[c for c in ("title", "requirements", "description", "full_description") if c in df.columns])),
                       F.lit(0.0))
    industry = F.coalesce(empty_to_null(_has(df, "industry")), raw_value(df, "sector"), empty_to_null(_has(df, "category")))
    work = F.coalesce(empty_to_null(_has(df, "job_type")), empty_to_null(_has(df, "position_type")), F.lit("Full-time"))
    explicit = F.coalesce(_has(df, "competition_level", "double").try_cast("double"), raw_value(df, "competition_level").try_cast("double"))
    trend = F.lower(F.concat_ws(" ", *[F.coalesce(_has(df, c), F.lit("")) for c in ("title", "category", "subcategory")],
                                F.coalesce(industry, F.lit("Unknown"))))
    size = raw_value(df, "company_size", "organization_size")
    desc = F.coalesce(empty_to_null(_has(df, "description")), empty_to_null(_has(df, "full_description")), F.lit(""))
    edu = raw_value(df, "required_education", "education_requirement")
    skill_col = F.coalesce(_has(df, skills, "array<string>"), F.array().cast("array<string>"))
    return df.select(
        F.col("job_id").alias("p_job_id"), F.coalesce("title", F.lit("Unknown Title")).alias("p_title"),
        F.coalesce(empty_to_null(_has(df, "employer")), empty_to_null(_has(df, "company")), F.lit("Unknown Company")).alias("p_company"),
        _has(df, "location").alias("p_location"),
        F.coalesce("_lo", F.lit(0.0)).alias("p_salary_min"), F.coalesce("_hi", F.lit(0.0)).alias("p_salary_max"),
        F.col("salary_value").alias("p_salary"), _has(df, "salary").alias("p_salary_text"),
        _has(df, "description").alias("p_description"), _has(df, "requirements").alias("p_requirements"),
        snippet(desc).alias("p_description_snippet"),
        F.array_distinct(F.transform(skill_col, F.lower)).alias("p_skills"), skill_col.alias("p_skill_labels"),
        _has(df, "preferred_skills", "array<string>").alias("p_preferred_skills"),
        edu.alias("p_required_education"), sc.education_score(edu).alias("p_required_education_level"),
        years.alias("p_required_experience_years"), F.coalesce(industry, F.lit("Unknown")).alias("p_industry"),
        raw_value(df, "company_type", "organization_type").alias("p_company_type"),
        work.alias("p_work_type"), F.coalesce(size, F.lit("Unknown")).alias("p_company_size"),
        sc.company_size_score(size).alias("p_company_size_score"),
        ts("start_date", "published_date", "placed_on", "created").cast("date").alias("p_start_date"),
        F.coalesce(tx.first_number(_has(df, "commute_time")), tx.first_number(_has(df, "commute_minutes"))).alias("p_commute_time"),
        F.col("_days").alias("p_days_since_posted"),
        sc.days_between(ts("closing_date"), now).alias("p_days_to_close"),
        sc.title_seniority(F.col("title")).alias("p_title_seniority_level"),
        F.col("_views").alias("p_view_count"), F.col("_apps").alias("p_application_count"),
        competition(explicit, F.col("_views"), F.col("_apps"), F.col("_days")).alias("p_competition_level"),
        sc.market_signal(trend, F.col("_days")).alias("p_market_signal"),
        _has(df, "preferred_majors", "array<string>").alias("p_preferred_majors"),
        _has(df, "preferred_industries", "array<string>").alias("p_preferred_industries"),
        *[_has(df, c, "double").cast("double").alias(f"p_{c}") for c in
          ("work_life_balance_score", "career_growth_score", "innovation_score")],
        # Plain forms that the pair scores compare, made once per posting.
        plain(work).alias("p_work_plain"), plain(F.coalesce(industry, F.lit("Unknown"))).alias("p_industry_plain"),
        plain(F.coalesce(empty_to_null(_has(df, "employer")), empty_to_null(_has(df, "company")), F.lit("Unknown Company"))).alias("p_company_plain"),
        plain(raw_value(df, "company_type", "organization_type")).alias("p_company_type_plain"),
        sc.education_ordinal(empty_to_null(edu)).alias("p_education_need"),
        (job_link() if {"apply_url", "url"} <= set(df.columns) else F.lit(None).cast("string")).alias("p_job_url"),
        _has(df, "source").alias("p_source"), _has(df, "category").alias("p_category"))


def skill_map(skills: Column) -> Column:
    """Lower-cased name -> weight; the last duplicate wins."""
    weight = F.transform(skills, lambda s: F.struct(
        F.lower(s["name"]).alias("k"), (s["proficiency"] * (1 + s["years_of_experience"] * 0.1)).alias("v")))
    names = F.array_distinct(F.transform(weight, lambda e: e["k"]))
    # Keep for every name its last entry, so no duplicate key reaches the map.
    return F.map_from_entries(F.transform(names, lambda n: F.struct(
        n.alias("k"), F.element_at(F.filter(weight, lambda e: e["k"] == n), -1)["v"].alias("v"))))


def highest_education(education: Column) -> Column:
    """Entry with the highest level; the first one among equals."""
    def level(e: Column) -> Column:
        out = F.lit(0)
        for i, name in enumerate(sc.EDUCATION_LEVELS, 1):
            out = F.when(e["level"] == name, F.lit(i)).otherwise(out)
        return out
    best = F.array_max(F.transform(education, level))
    return F.get(F.filter(education, lambda e: level(e) == best), F.lit(0))


def profile_features(profiles: DataFrame) -> DataFrame:
    """One row per user with ``u_`` columns, from nested profiles."""
    edu = highest_education(F.col("education"))
    level = F.lit(None).cast("int")
    for i, name in enumerate(sc.EDUCATION_LEVELS, 1):
        level = F.when(edu["level"] == name, F.lit(i)).otherwise(level)
    skills = F.coalesce("skills", F.array().cast("array<struct<name:string,proficiency:double,years_of_experience:double>>"))
    c = F.col("constraints")
    prefs = F.coalesce("preferences", F.array().cast("array<struct<preference_type:string,value:string,weight:double>>"))

    def weight_of(*kinds: str) -> Column:
        return F.aggregate(prefs, F.lit(0.0), lambda s, p: s + F.when(p["preference_type"].isin(*kinds), p["weight"]).otherwise(0.0))
    by_score = {"work_life_balance": "Work-Life Balance", "career_growth": "Career Growth", "innovation": "Innovation"}
    compared = F.filter(prefs, lambda p: p["preference_type"].isin("Industry", "Company Size"))
    return profiles.withColumn("_edu", edu).select(
        F.col("user_id").alias("u_user_id"), F.col("name").alias("u_name"),
        skill_map(skills).alias("u_skill_weights"),
        F.array_distinct(F.transform(skills, lambda s: F.lower(s["name"]))).alias("u_skill_names"),
        F.transform(skills, lambda s: F.struct(F.lower(s["name"]).alias("key"), s["proficiency"].alias("proficiency"),
                                               s["years_of_experience"].alias("years"))).alias("u_skill_levels"),
        level.alias("u_education_level"), edu["major"].alias("u_major"), edu["gpa"].alias("u_gpa"), edu["ranking"].alias("u_ranking"),
        F.aggregate(F.coalesce("work_experience", F.array().cast("array<struct<company:string,duration_years:double>>")),
                    F.lit(0.0), lambda s, w: s + w["duration_years"]).alias("u_experience_years"),
        F.transform("work_experience", lambda w: w["company"]).alias("u_employers"),
        F.transform("preferences", lambda p: F.struct(p["preference_type"].alias("preference_type"), p["value"].alias("value"),
                                                      p["weight"].alias("weight"))).alias("u_preferences"),
        c["locations"].alias("u_locations"), c["min_salary"].alias("u_min_salary"), c["max_salary"].alias("u_max_salary"),
        c["work_type"].alias("u_work_type"), c["start_date"].cast("date").alias("u_start_date"),
        c["industries"].alias("u_industries"), c["company_types"].alias("u_company_types"),
        c["exclude_companies"].alias("u_exclude_companies"), c["max_commute_time"].cast("double").alias("u_max_commute_time"),
        # Plain forms and sums that the pair scores use, made once per user.
        plain(c["work_type"]).alias("u_work_plain"), plain_list(c["industries"]).alias("u_industries_plain"),
        plain_list(c["company_types"]).alias("u_company_types_plain"), plain_list(c["exclude_companies"]).alias("u_exclude_plain"),
        F.transform(compared, lambda p: F.struct(
            (p["preference_type"] == "Industry").alias("industry"), p["value"].alias("value"), p["weight"].alias("weight"))).alias("u_compared_preferences"),
        F.aggregate(prefs, F.lit(0.0), lambda s, p: s + p["weight"]).alias("u_preference_total"),
        F.struct(*[weight_of(kind).alias(name) for name, kind in by_score.items()],
                 (F.aggregate(prefs, F.lit(0.0), lambda s, p: s + p["weight"]) - weight_of("Industry", "Company Size", *by_score.values())).alias("other")).alias("u_preference_weights"))
