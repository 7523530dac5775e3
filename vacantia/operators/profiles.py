"""Profiles: typed payloads, guards, child tables, per-user aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import EDUCATION_LEVELS, PREFERENCE_TYPES
from ..functions import text as tx
from ..util import blank_to_null, col, empty_to_null, strip

PAYLOAD = (
    "struct<name:string,education:array<struct<level:string,major:string,school:string,graduation_year:int,gpa:double,ranking:string>>,"
    "skills:array<struct<name:string,raw_name:string,proficiency:double,years_of_experience:double,category:string,verified:boolean>>,"
    "preferences:array<struct<preference_type:string,value:string,weight:double>>,"
    "constraints:struct<locations:array<string>,min_salary:double,max_salary:double,work_type:string,start_date:string,"
    "industries:array<string>,company_types:array<string>,exclude_companies:array<string>,max_commute_time:int>,"
    "work_experience:array<struct<company:string,position:string,duration_years:double,responsibilities:array<string>,achievements:array<string>>>,"
    "certifications:array<string>,languages:map<string,string>,"
    "projects:array<struct<name:string,description:string,tech_stack:array<string>,url:string>>>")
# fixed values: limits of profile fields
YEAR_MIN, YEAR_MAX, DEFAULT_YEAR = 1950, 2100, 2020
LIST_MAX, TEXT_MAX, NAME_MAX = 200, 8000, 200


def _or(c: Column, default) -> Column:
    return F.coalesce(c, F.lit(default))


def _one_of(c: Column, allowed: tuple[str, ...], default: str) -> Column:
    return F.when(c.isin(*allowed), c).otherwise(F.lit(default))


def parse_payload(df: DataFrame, payload: str = "payload") -> DataFrame:
    """JSON profile payload to the typed nested profile, with defaults for missing values."""
    p = F.from_json(payload, PAYLOAD)
    df = df.withColumn("_p", p)
    p = F.col("_p")

    def arr(c: Column, typ: str) -> Column:
        return F.filter(F.coalesce(c, F.array().cast(typ)), lambda x: x.isNotNull())
    txt = "array<string>"
    year = lambda e: F.when(e["graduation_year"].between(YEAR_MIN, YEAR_MAX), e["graduation_year"]).otherwise(DEFAULT_YEAR)
    edu_t = PAYLOAD.split("education:")[1].split(",skills:")[0]
    skl_t = PAYLOAD.split("skills:")[1].split(",preferences:")[0]
    prf_t = "array<struct<preference_type:string,value:string,weight:double>>"
    wrk_t = PAYLOAD.split("work_experience:")[1].split(",certifications:")[0]
    c = p["constraints"]
    out = df.select(
        "user_id", F.coalesce(blank_to_null(strip(p["name"])), F.col("user_id")).alias("name"),
        F.transform(arr(p["education"], edu_t), lambda e: F.struct(
            _one_of(e["level"], EDUCATION_LEVELS, "Bachelor").alias("level"), _or(e["major"], "").alias("major"), _or(e["school"], "").alias("school"),
            year(e).alias("graduation_year"), e["gpa"].alias("gpa"), empty_to_null(e["ranking"]).alias("ranking"))).alias("education"),
        F.transform(arr(p["skills"], skl_t), lambda s: F.struct(
            _or(s["name"], "").alias("name"), s["raw_name"].alias("raw_name"), _or(s["proficiency"], 0.5).alias("proficiency"),
            _or(s["years_of_experience"], 0.0).alias("years_of_experience"), _or(s["category"], "General").alias("category"),
            _or(s["verified"], False).alias("verified"))).alias("skills"),
        F.transform(arr(p["preferences"], prf_t), lambda x: F.struct(
            _one_of(x["preference_type"], PREFERENCE_TYPES, "Industry").alias("preference_type"), _or(x["value"], "").alias("value"),
            _or(x["weight"], 1.0).alias("weight"))).alias("preferences"),
        F.struct(arr(c["locations"], txt).alias("locations"), c["min_salary"].alias("min_salary"), c["max_salary"].alias("max_salary"),
                 empty_to_null(c["work_type"]).alias("work_type"), tx.parse_date(c["start_date"]).alias("start_date"),
                 arr(c["industries"], txt).alias("industries"), arr(c["company_types"], txt).alias("company_types"),
                 F.array_distinct(F.filter(arr(c["exclude_companies"], txt), lambda x: x != "")).alias("exclude_companies"),
                 c["max_commute_time"].alias("max_commute_time")).alias("constraints"),
        F.transform(arr(p["work_experience"], wrk_t), lambda w: F.struct(
            _or(w["company"], "").alias("company"), _or(w["position"], "").alias("position"), _or(w["duration_years"], 0.0).alias("duration_years"),
            arr(w["responsibilities"], txt).alias("responsibilities"), arr(w["achievements"], txt).alias("achievements"))).alias("work_experience"),
        F.filter(arr(p["certifications"], txt), lambda x: x != "").alias("certifications"),
        F.coalesce(p["languages"], F.create_map().cast("map<string,string>")).alias("languages"), p["projects"].alias("projects"))
    return out


def strip_controls(c: Column) -> Column:
    return F.regexp_replace(c, r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]", "")


def single_line(c: Column, limit: int | None = None) -> Column:
    line = strip(strip_controls(c))
    return line if limit is None else F.substring(line, 1, limit)


def clamp(c: Column, lo: float, hi: float) -> Column:
    """Value inside the bounds; NULL and NaN become the lower bound."""
    return F.when(c.isNull() | F.isnan(c), F.lit(lo)).otherwise(F.least(F.greatest(c, F.lit(lo)), F.lit(hi)))


def cap_list(c: Column, n: int | None, item: int | None) -> Column:
    items = F.filter(F.transform(F.coalesce(c, F.array().cast("array<string>")), lambda x: single_line(x, item)), lambda x: x != "")
    return items if n is None else F.slice(items, 1, n)


def sanitize(profiles: DataFrame, default_year: int, cut: bool = False) -> DataFrame:
    """Clamp numbers and clean texts of nested profiles; no block is removed. Lists and texts keep their length unless ``cut`` asks for the limits."""
    most = (lambda n: n) if cut else (lambda n: None)
    text = lambda c: F.substring(strip_controls(c), 1, TEXT_MAX) if cut else strip_controls(c)
    def year(y: Column) -> Column:
        return F.when(y.isNull() | (y == 0), default_year).otherwise(F.least(F.greatest(y, F.lit(YEAR_MIN)), F.lit(YEAR_MAX)))
    c = F.col("constraints")
    nonneg = lambda x: F.when(x.isNotNull(), F.greatest(F.lit(0.0), x))
    name = single_line(F.col("name"), most(NAME_MAX))
    langs = F.filter(F.transform(F.map_entries("languages"), lambda e: F.struct(
        single_line(e["key"], most(80)).alias("key"), single_line(e["value"], most(200)).alias("value"))), lambda e: (e["key"] != "") & (e["value"] != ""))
    out = profiles.withColumns({
        "name": F.when(name != "", name).otherwise(F.col("name")),
        "education": F.transform("education", lambda e: e.withField("major", single_line(e["major"], most(500))).withField("school", single_line(e["school"], most(500)))
                                 .withField("ranking", single_line(e["ranking"], most(200))).withField("graduation_year", year(e["graduation_year"]))
                                 .withField("gpa", F.when(e["gpa"].isNotNull(), clamp(e["gpa"], 0.0, 5.0)))),
        "skills": F.transform(F.filter("skills", lambda s: single_line(F.coalesce(s["name"], F.lit("")), most(200)) != ""), lambda s: s
                              .withField("name", single_line(s["name"], most(200)))
                              .withField("category", single_line(F.coalesce(empty_to_null(s["category"]), F.lit("General")), most(120)))
                              .withField("proficiency", clamp(s["proficiency"], 0.0, 1.0)).withField("years_of_experience", clamp(s["years_of_experience"], 0.0, 60.0))),
        "preferences": F.transform("preferences", lambda p: p.withField("value", text(F.coalesce(p["value"], F.lit(""))))
                                   .withField("weight", clamp(p["weight"], 0.0, 1.0))),
        "constraints": c.withField("locations", cap_list(c["locations"], most(LIST_MAX), most(200))).withField("industries", cap_list(c["industries"], most(LIST_MAX), most(200)))
                        .withField("company_types", cap_list(c["company_types"], most(LIST_MAX), most(120))).withField("exclude_companies", cap_list(c["exclude_companies"], most(LIST_MAX), most(200)))
                        .withField("work_type", single_line(c["work_type"], most(120))).withField("min_salary", nonneg(c["min_salary"])).withField("max_salary", nonneg(c["max_salary"]))
                        .withField("max_commute_time", F.when(c["max_commute_time"].isNotNull(), F.least(F.greatest(c["max_commute_time"], F.lit(0)), F.lit(1440)))),
        "work_experience": F.transform("work_experience", lambda w: w.withField("company", single_line(w["company"], most(300))).withField("position", single_line(w["position"], most(300)))
                                       .withField("duration_years", clamp(w["duration_years"], 0.0, 60.0))
                                       .withField("responsibilities", cap_list(w["responsibilities"], most(200), most(2000))).withField("achievements", cap_list(w["achievements"], most(200), most(2000)))),
        "certifications": cap_list(F.col("certifications"), most(LIST_MAX), most(500)),
        "languages": language_map(F.slice(langs, 1, 80) if cut else langs),
        "projects": F.transform("projects", lambda p: p.withField("name", single_line(p["name"], most(300))).withField("description", text(p["description"]))
                                .withField("url", single_line(p["url"], most(2000))).withField("tech_stack", cap_list(p["tech_stack"], most(100), most(120)))),
    })
    return out.withColumn("user_id", single_line(F.col("user_id"), most(64)))


def violations(profiles: DataFrame) -> DataFrame:
    """One row per rule a profile breaks."""
    def each(items: str, label: str, test, text: str) -> Column:
        return F.filter(F.transform(items, lambda x, i: F.when(test(x), F.concat(F.lit(f"{label} #"), (i + 1).cast("string"), F.lit(f": {text}")))), lambda m: m.isNotNull())
    out_of = lambda f, lo, hi: (lambda x: F.coalesce((x[f] < lo) | (x[f] > hi), F.lit(False)))
    bad_year = lambda e: ~F.coalesce(e["graduation_year"].between(YEAR_MIN, YEAR_MAX), F.lit(False))
    c = F.col("constraints")
    found = F.concat(
        F.when(F.coalesce(strip("name"), F.lit("")) == "", F.array(F.lit("Display name cannot be empty."))).otherwise(F.array().cast("array<string>")),
        each("education", "Education", bad_year, f"graduation year must be between {YEAR_MIN} and {YEAR_MAX}."),
        each("education", "Education", out_of("gpa", 0, 5), "GPA should be between 0 and 5 (or leave blank)."),
        each("skills", "Skill", out_of("proficiency", 0, 1), "proficiency must be between 0 and 1."),
        each("skills", "Skill", out_of("years_of_experience", 0, 60), "years of experience must be between 0 and 60."),
        each("preferences", "Preference", out_of("weight", 0, 1), "weight must be between 0 and 1."),
        F.when(F.coalesce(c["min_salary"] > c["max_salary"], F.lit(False)), F.array(F.lit("Minimum expected salary cannot be greater than maximum salary."))).otherwise(F.array().cast("array<string>")),
        each("work_experience", "Work experience", out_of("duration_years", 0, 60), "duration (years) must be between 0 and 60."))
    return profiles.select("user_id", F.explode(found).alias("message"))


def parse_list(c: str | Column) -> Column:
    return tx.split_list(c, r"[\n,;]")


def parse_lines(c: str | Column) -> Column:
    return tx.split_list(c, r"\n|;")


def language_map(entries: Column) -> Column:
    """Map from key/value structs; the last value of a repeated key wins."""
    keys = F.array_distinct(F.transform(entries, lambda e: e["key"]))
    return F.map_from_entries(F.transform(keys, lambda k: F.element_at(F.filter(entries, lambda e: e["key"] == k), -1)))


def parse_languages(c: str | Column) -> Column:
    lines = F.transform(F.split(F.coalesce(col(c), F.lit("")), "\n"), lambda x: F.split(x, ":", 2))
    pairs = F.transform(F.filter(lines, lambda p: (F.size(p) >= 2) & (strip(p[0]) != "")),
                        lambda p: F.struct(strip(p[0]).alias("key"), strip(F.get(p, F.lit(1))).alias("value")))
    return language_map(pairs)


SEPARATOR = "\u0001"


def decode_preference(c: str | Column, presets: Column) -> Column:
    """Struct of checked presets and free text of a packed preference value."""
    v = F.coalesce(col(c), F.lit(""))
    packed = v.contains(SEPARATOR)
    halves = F.split(v, SEPARATOR)
    left = tx.split_list(F.when(packed, halves[0]).otherwise(v), ",")
    checked = F.filter(left, lambda t: F.array_contains(presets, t))
    free = F.array_join(F.filter(left, lambda t: ~F.array_contains(presets, t)), ", ")
    return F.struct(checked.alias("checked"), F.when(packed, F.coalesce(F.get(halves, F.lit(1)), F.lit(""))).otherwise(free).alias("other"))


def merge_choices(presets: Column, chosen: Column, custom: Column) -> Column:
    """Chosen presets in preset order, then custom values, without repeats."""
    return F.array_union(F.array_intersect(presets, chosen), custom)


# --- per-user aggregates over child tables --------------------------------------------------

def skill_weights(skills: DataFrame) -> DataFrame:
    """Per user the skill set and the weight of each skill (last entry of a repeated name)."""
    from ..util import first_per_key
    seq = F.desc("seq") if "seq" in skills.columns else F.desc("years_of_experience")
    one = first_per_key(skills.withColumn("skill", F.lower("name")), ["user_id", "skill"], [seq])
    weight = F.col("proficiency") * (1 + F.col("years_of_experience") * 0.1)
    return one.groupBy("user_id").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("skill", weight.alias("w"))))).alias("skill_weights"),
        F.count(F.lit(1)).alias("n_skills"))


def highest_education(education: DataFrame) -> DataFrame:
    """Row with the highest level per user, first one among equals (``seq``)."""
    rank = F.lit(0)
    for i, name in enumerate(EDUCATION_LEVELS, 1):
        rank = F.when(F.col("level") == name, F.lit(i)).otherwise(rank)
    best = F.max_by(F.struct("level", "major", "gpa", "ranking"), F.struct(rank.alias("r"), (-F.col("seq")).alias("s")))
    return education.groupBy("user_id").agg(best.alias("e")).select("user_id", "e.*")


def total_years(work: DataFrame) -> DataFrame:
    return work.groupBy("user_id").agg(F.sum("duration_years").alias("years"))


def _fields_of(items: str, cols: list[str]) -> Column:
    return F.transform(items, lambda e: F.struct(*[e[c].alias(c) for c in cols]))


def assemble(users: DataFrame, children: dict[str, DataFrame]) -> DataFrame:
    """Nested profiles from child tables; each child is nested first, then joined on the user."""
    out = users
    for name, child in children.items():
        cols = [c for c in child.columns if c not in ("user_id", "seq")]
        key = ["seq", *cols] if "seq" in child.columns else cols
        nested = child.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct(*key))).alias(name))
        nested = nested.withColumn(name, _fields_of(name, cols))
        out = out.join(nested, "user_id", "left").withColumn(name, F.coalesce(name, F.array().cast(nested.schema[name].dataType)))
    return out


def skills_with_names(raw: DataFrame, normalized: DataFrame) -> DataFrame:
    """Raw user skills with their normalised name, or the raw one."""
    n = normalized.select("user_id", F.col("raw").alias("name"), "normalized", "similarity")
    return raw.join(n, ["user_id", "name"], "left").withColumn("display_name", F.coalesce("normalized", "name"))


def latency_summary(runs: DataFrame) -> DataFrame:
    """Average, minimum and maximum over successful runs."""
    ok = runs.filter(F.coalesce(F.col("error"), F.lit("")) == "")
    return ok.agg(F.count(F.lit(1)).alias("runs"), F.avg("client_total_ms").alias("avg_client_ms"), F.avg("server_match_rank_ms").alias("avg_match_rank_ms"),
                  F.avg("server_total_ms").alias("avg_total_ms"), F.min("client_total_ms").alias("min_client_ms"),
                  F.max("client_total_ms").alias("max_client_ms"), F.avg("jobs_processed").alias("avg_jobs"))
