"""Scores of one (user, posting) pair as column expressions.

Pair frames carry user columns with the prefix ``u_`` and posting columns with ``p_``.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import COMPANY_SIZE_WORDS, DEMAND_WORDS, EDUCATION_LEVELS, EDUCATION_ORDINAL_WORDS, EDUCATION_SCORE_WORDS, MatcherConfig, RankerConfig, SENIORITY_WORDS, TOP_SCHOOL_RANKS
from ..util import col, contains_any, empty_to_null, percent, strip
from . import text as tx




# --- general helpers ---------------------------------------------------------------------

def jaccard(a: Column, b: Column) -> Column:
    both = F.size(F.array_union(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / both)


def sparse_cosine(a: Column, b: Column) -> Column:
    """Cosine of two string->double maps; 0 when a side is empty or has no length."""
    def norm(m: Column) -> Column:
        return F.sqrt(F.aggregate(F.map_values(m), F.lit(0.0), lambda s, x: s + x * x))
    dot = F.aggregate(F.map_keys(a), F.lit(0.0), lambda s, k: s + F.element_at(a, k) * F.coalesce(F.try_element_at(b, k), F.lit(0.0)))
    return F.coalesce(F.try_divide(dot, norm(a) * norm(b)), F.lit(0.0))


def weighted_average(scores: Column, weights: Column) -> Column:
    total = F.aggregate(weights, F.lit(0.0), lambda s, w: s + w)
    dot = F.aggregate(F.zip_with(scores, weights, lambda x, w: x * w), F.lit(0.0), lambda s, x: s + x)
    usable = (F.size(scores) > 0) & (F.size(scores) == F.size(weights)) & (total != 0)
    return F.when(usable, F.try_divide(dot, total)).otherwise(F.lit(0.0))


def sigmoid(x: Column, k: float = 1.0, x0: float = 0.0) -> Column:
    return 1.0 / (1.0 + F.exp(-k * (x - x0)))


def exponential_decay(v: Column, rate: float = 0.1, threshold: float = 0.0) -> Column:
    return F.exp(-rate * F.greatest(F.lit(0.0), v - threshold))


def linear_interpolation(x: Column, x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.when(x2 == x1, y1).otherwise(y1 + F.try_divide((x - x1) * (y2 - y1), x2 - x1))


def safe_score(c: Column) -> Column:
    v = c.try_cast("double")
    return F.when(v.isNotNull() & ~F.isnan(v), F.least(F.greatest(v, F.lit(0.0)), F.lit(1.0)))


def skill_overlap(user: Column, job: Column) -> Column:
    """Struct of coverage, match rate and Jaccard for two distinct skill arrays."""
    hit = F.size(F.array_intersect(user, job)).cast("double")
    def part(v: Column) -> Column:
        return F.when(F.size(job) == 0, F.lit(1.0)).when(F.size(user) == 0, F.lit(0.0)).otherwise(v)
    return F.struct(part(F.try_divide(hit, F.size(job).cast("double"))).alias("coverage"),
                    part(F.try_divide(hit, F.size(user).cast("double"))).alias("match_rate"),
                    part(jaccard(user, job)).alias("jaccard"))


def weighted_skill_match(user: Column, job: Column) -> Column:
    """Share of job weight covered by the user's levels (each level capped at 1)."""
    total = F.aggregate(F.map_values(job), F.lit(0.0), lambda s, w: s + w)
    got = F.aggregate(
        F.map_keys(job), F.lit(0.0),
        lambda s, k: s + F.least(F.coalesce(F.try_element_at(user, k), F.lit(0.0)), F.lit(1.0)) * F.element_at(job, k))
    return (F.when(F.size(job) == 0, F.lit(1.0)).when((F.size(user) == 0) | (total == 0), F.lit(0.0))
            .otherwise(F.try_divide(got, total)))


def dominates(a: Sequence[Column], b: Sequence[Column]) -> Column:
    """1 when a dominates b, -1 for the reverse, 0 otherwise."""
    better, worse = F.lit(False), F.lit(False)
    for x, y in zip(a, b, strict=True):
        better, worse = better | (x > y), worse | (x < y)
    return F.when(better & ~worse, 1).when(worse & ~better, -1).otherwise(0)


# --- posting features --------------------------------------------------------------------

def _by_words(c: Column, table, empty: float | None, otherwise: float) -> Column:
    """Value of the first group of words of which the text contains one."""
    t = F.lower(strip(F.coalesce(c, F.lit(""))))
    out = F.when(t == "", F.lit(empty))
    for value, words in table:
        out = out.when(contains_any(t, words), F.lit(value))
    return out.otherwise(otherwise)


def education_score(c: Column) -> Column:
    return _by_words(c, EDUCATION_SCORE_WORDS, None, 0.5)


def title_seniority(c: Column) -> Column:
    return _by_words(c, SENIORITY_WORDS, 0.5, 0.65)


def company_size_score(c: Column) -> Column:
    return _by_words(c, COMPANY_SIZE_WORDS, None, 0.6)


def days_between(later: Column, earlier: Column) -> Column:
    """Whole days, rounded down (also for negative spans)."""
    secs = F.unix_timestamp(later.cast("timestamp")) - F.unix_timestamp(earlier.cast("timestamp"))
    return F.floor(secs / 86400.0).cast("int")


def education_ordinal(c: Column) -> Column:
    t = F.lower(strip(c))
    out = F.lit(None).cast("int")
    for i, level in enumerate(EDUCATION_LEVELS, 1):
        out = F.when(c == level, F.lit(i)).otherwise(out)
    scan = F.lit(0)
    for value, words in reversed(EDUCATION_ORDINAL_WORDS):
        scan = F.when(contains_any(t, words), F.lit(value)).otherwise(scan)
    return F.coalesce(out, scan)


# --- hard constraints ---------------------------------------------------------------------

def _either_way(values: Column, text: Column) -> Column:
    return F.exists(values, lambda v: text.contains(v) | v.contains(text))


def location_ok() -> Column:
    locs, job = F.col("u_locations"), F.col("p_location")
    free = (F.size(F.coalesce(locs, F.array().cast("array<string>"))) == 0) | F.coalesce(job == "", F.lit(True))
    return free | F.coalesce(_either_way(locs, job), F.lit(False))


def _salary_scales() -> tuple[Column, Column, Column]:
    """(salary check applies, some scale satisfies, some scale is plausible)."""
    s, lo, hi = F.col("p_salary"), F.col("u_min_salary"), F.col("u_max_salary")
    applies = (lo.isNotNull() | hi.isNotNull()) & s.isNotNull()
    ok, plausible = F.lit(False), F.lit(False)
    for scale in (1.0, 1000.0, 10000.0):
        v = s / scale
        fits = F.coalesce(v >= lo, F.lit(True)) & F.coalesce(v <= hi * 3.0, F.lit(True))
        low_ref, high_ref = F.coalesce(lo, hi), F.coalesce(hi, lo)
        plausible = plausible | ((v >= low_ref / 2.0) & (v <= high_ref * 2.0))
        ok = ok | fits
    return applies, F.coalesce(ok, F.lit(False)), F.coalesce(plausible, F.lit(False))


def salary_ok() -> Column:
    applies, ok, plausible = _salary_scales()
    return ~applies | ok | ~plausible


def work_type_ok() -> Column:
    want, have = F.col("u_work_plain"), F.col("p_work_plain")
    by_word = (F.when(want.contains("remote"), have.contains("remote"))
               .when(want.contains("intern"), have.contains("intern"))
               .when(want.contains("full"), have.contains("full"))
               .when(want.contains("part"), have.contains("part"))
               .otherwise(have.contains(want) | want.contains(have)))
    return F.when((F.coalesce("u_work_type", F.lit("")) == "") | (have == ""), True).otherwise(by_word)


def _free(values: str) -> Column:
    return F.coalesce(F.size(values) <= 0, F.lit(True))


def industry_hit() -> Column:
    return _either_way(F.col("u_industries_plain"), F.col("p_industry_plain"))


def industry_ok() -> Column:
    return _free("u_industries") | F.col("p_industry_plain").isin("", "unknown") | industry_hit()


def company_type_ok() -> Column:
    return _free("u_company_types") | (F.col("p_company_type_plain") == "") | _either_way(F.col("u_company_types_plain"), F.col("p_company_type_plain"))


def start_date_ok() -> Column:
    return ~F.coalesce(F.col("p_start_date") < F.col("u_start_date"), F.lit(False))


def commute_ok() -> Column:
    return ~F.coalesce(F.col("p_commute_time") > F.col("u_max_commute_time"), F.lit(False))


def company_allowed() -> Column:
    return _free("u_exclude_plain") | (F.col("p_company_plain") == "") | ~_either_way(F.col("u_exclude_plain"), F.col("p_company_plain"))


def constraints_ok(strict: bool = False, located: bool = False) -> Column:
    """All hard constraints. A satisfied salary skips the later checks unless ``strict``; ``located``: the place is known to fit."""
    place = F.lit(True) if located else location_ok()
    rest = (work_type_ok() & industry_ok() & company_type_ok() & start_date_ok() & commute_ok() & company_allowed())
    if strict:
        return salary_ok() & rest & place
    applies, ok, plausible = _salary_scales()
    return F.when(applies, ok | (~plausible & rest)).otherwise(rest) & place


# --- match score --------------------------------------------------------------------------

def skill_hits() -> Column:
    """Skills of the posting that the user has; the scores read its size and weights."""
    return F.array_intersect("p_skills", "u_skill_names")


def skill_score(cfg: MatcherConfig, hits: Column | None = None) -> Column:
    hits = skill_hits() if hits is None else hits
    n, users = F.size("p_skills").cast("double"), F.size("u_skill_names")
    hit = F.size(hits).cast("double")
    coverage = F.try_divide(hit, n)
    weighted = F.try_divide(F.aggregate(hits, F.lit(0.0), lambda s, k: s + F.least(F.coalesce(F.try_element_at("u_skill_weights", k), F.lit(0.0)), F.lit(1.0))), n)
    raw = coverage * 0.5 + weighted * 0.3 + F.try_divide(hit, n + users - hit) * 0.2
    low = coverage < cfg.min_skill_coverage
    raw = F.when(low, F.greatest(F.lit(0.0), raw - (cfg.min_skill_coverage - coverage) * 0.5)).otherwise(raw)
    return F.when(n == 0, 0.5).when((users == 0) | (hit == 0), F.lit(0.0)).otherwise(F.least(F.lit(1.0), raw))


def education_match() -> Column:
    req = empty_to_null("p_required_education")
    need, have = F.col("p_education_need"), F.col("u_education_level")
    base = F.when(have >= need, F.lit(1.0)).otherwise(F.greatest(F.lit(0.3), F.try_divide(have.cast("double"), need.cast("double"))))
    major = F.coalesce(F.array_contains("p_preferred_majors", F.col("u_major")), F.lit(False))
    base = F.when(major, F.least(F.lit(1.0), base * 1.2)).otherwise(base)
    base = F.when(F.coalesce(F.col("u_gpa") >= 3.5, F.lit(False)), F.least(F.lit(1.0), base * 1.1)).otherwise(base)
    base = F.when(F.coalesce(F.col("u_ranking").isin(*TOP_SCHOOL_RANKS), F.lit(False)), F.least(F.lit(1.0), base * 1.15)).otherwise(base)
    return F.when(req.isNull(), F.lit(1.0)).when(have.isNull(), 0.3).otherwise(base)


def experience_match() -> Column:
    req, years = F.col("p_required_experience_years"), F.coalesce("u_experience_years", F.lit(0.0))
    base = (F.when(years >= req, F.when(years <= req * 1.5, F.lit(1.0))
                   .otherwise(1.0 - sigmoid(years - req * 1.5, 0.3, 2.0) * 0.3))
            .otherwise(sigmoid(F.try_divide(years, req), 5.0, 0.7)))
    bonus = F.coalesce(F.exists("p_preferred_industries", lambda i: F.exists("u_employers", lambda e: e.contains(i))), F.lit(False))
    base = F.when(bonus, F.least(F.lit(1.0), base * 1.2)).otherwise(base)
    return F.when(req == 0, F.lit(1.0)).otherwise(base)


def preference_tokens(v: Column) -> Column:
    """Tokens of a packed value: presets joined by ', ', then a separator, then free text."""
    return F.filter(F.transform(F.split(v, "[,\u0001]"), strip), lambda x: x != "")


def preference_match(cfg: MatcherConfig) -> Column:
    def equal(p: Column) -> Column:
        have = F.when(p["industry"], F.col("p_industry")).otherwise(F.col("p_company_size"))
        hit = F.array_contains(preference_tokens(p["value"]), have) if cfg.split_preference_values else have == p["value"]
        return F.coalesce(hit, F.lit(False))

    total, weights = F.col("u_preference_total"), F.col("u_preference_weights")
    got = F.aggregate("u_compared_preferences", F.lit(0.0), lambda s, p: s + p["weight"] * F.when(equal(p), 1.0).when(p["industry"], 0.3).otherwise(0.5))
    for kind in ("work_life_balance", "career_growth", "innovation"):
        got = got + weights[kind] * F.coalesce(f"p_{kind}_score", F.lit(0.5))
    got = got + weights["other"] * 0.5
    return F.when(F.coalesce(F.size("u_preferences") <= 0, F.lit(True)) | (total == 0), 0.5).otherwise(F.try_divide(got, total))


def salary_match() -> Column:
    s, lo, hi = F.col("p_salary"), F.col("u_min_salary"), F.col("u_max_salary")
    has_lo, has_hi = F.coalesce(lo != 0, F.lit(False)), F.coalesce(hi != 0, F.lit(False))
    inside = 0.7 + 0.3 * F.coalesce(F.try_divide(s - lo, hi - lo), F.lit(0.0))
    only_min = F.when(s >= lo, F.least(F.lit(1.0), 0.7 + 0.3 * sigmoid(F.try_divide(s - lo, lo), 2.0))).otherwise(0.3)
    both = F.when((lo <= s) & (s <= hi), inside).when(s > hi, 1.0).otherwise(0.3)
    return (F.when(F.coalesce(s == 0, F.lit(True)), 0.5).when(has_lo & has_hi, both)
            .when(has_lo, only_min).otherwise(0.5))


def location_match() -> Column:
    job, locs = F.col("p_location"), F.coalesce("u_locations", F.array().cast("array<string>"))
    return (F.when(F.coalesce(job == "", F.lit(True)), 0.5).when(F.size(locs) == 0, 1.0)
            .when(F.array_contains(locs, job), 1.0).when(_either_way(locs, job), 0.8).otherwise(0.3))


def match_columns(cfg: MatcherConfig, hits: Column | None = None) -> dict[str, Column]:
    return {"skill_score": skill_score(cfg, hits), "education_score": education_match(),
            "experience_score": experience_match(), "preference_score": preference_match(cfg),
            "salary_score": salary_match(), "location_score": location_match()}


def match_total(cfg: MatcherConfig) -> Column:
    return (F.col("skill_score") * cfg.skill_weight + F.col("education_score") * cfg.education_weight
            + F.col("experience_score") * cfg.experience_weight + F.col("preference_score") * cfg.preference_weight
            + F.col("salary_score") * cfg.salary_weight + F.col("location_score") * cfg.location_weight)


# --- objectives ---------------------------------------------------------------------------

def weighted_with_missing(parts: Sequence[tuple[str, Column, float]]) -> Column:
    """Weighted mean over the present parts, weights renormalised, 0.5 when none is present."""
    total, dot = F.lit(0.0), F.lit(0.0)
    for _, v, w in parts:
        total = total + F.when(v.isNotNull(), F.lit(w)).otherwise(F.lit(0.0))
        dot = dot + F.coalesce(v * w, F.lit(0.0))
    return F.when(total > 0, F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.try_divide(dot, total)))).otherwise(0.5)


def breakdown(parts: Sequence[tuple[str, Column, float]]) -> Column:
    """Per part its value and effective weight, plus the names of missing parts."""
    total = F.lit(0.0)
    for _, v, w in parts:
        total = total + F.when(v.isNotNull(), F.lit(w)).otherwise(F.lit(0.0))
    comps = F.struct(*[F.struct(
        v.alias("value"),
        F.coalesce(F.when(v.isNotNull(), F.try_divide(F.lit(w), total)), F.lit(0.0)).alias("effective_weight")).alias(n)
        for n, v, w in parts])
    missing = F.filter(F.array(*[F.when(v.isNull(), F.lit(n)) for n, v, _ in parts]), lambda x: x.isNotNull())
    return F.struct(comps.alias("components"), missing.alias("missing"))


def _parts(values: dict[str, Column], weights: dict[str, float]) -> list[tuple[str, Column, float]]:
    return [(n, values[n], w) for n, w in weights.items()]


def relevance_parts(cfg: RankerConfig) -> list[tuple[str, Column, float]]:
    hit = (F.col("p_industry_plain") != "") & industry_hit()
    has_prefs = F.coalesce(F.size("u_preferences") > 0, F.lit(False))
    return _parts({
        "match_alignment": safe_score(F.col("match_score")), "skill_alignment": safe_score(F.col("skill_score")),
        "preference_alignment": F.when(has_prefs, safe_score(F.col("preference_score"))),
        "industry_alignment": F.when(~_free("u_industries"), F.when(hit, 1.0).otherwise(0.35)),
    }, cfg.relevance_parts)


def salary_attainability() -> Column:
    s, lo, hi = F.col("p_salary"), F.col("u_min_salary"), F.col("u_max_salary")
    over = F.try_divide(s - hi, F.greatest(hi, F.lit(1e-6)))
    both = (F.when((lo <= s) & (s <= hi), 1.0)
            .when(s < lo, F.greatest(F.lit(0.25), F.try_divide(s, lo)))
            .otherwise(F.greatest(F.lit(0.35), 1.0 - F.least(over, F.lit(1.0)) * 0.65)))
    return (F.when(s.isNull(), None).when(hi > lo, both)
            .when(lo > 0, F.least(F.lit(1.0), sigmoid(F.try_divide(s, lo) - 1.0, 2.0)))
            .when(hi > 0, F.greatest(F.lit(0.35), 1.0 - F.least(F.try_divide(s, hi), F.lit(2.0)) * 0.3)))


def feasibility_parts(cfg: RankerConfig) -> list[tuple[str, Column, float]]:
    comp = safe_score(F.col("p_competition_level"))
    return _parts({
        "skill_readiness": safe_score(F.col("skill_score")), "experience_fit": safe_score(F.col("experience_score")),
        "education_fit": safe_score(F.col("education_score")), "salary_attainability": salary_attainability(),
        "location_commute_fit": safe_score(F.col("location_score")),
        "market_competition_adjustment": F.when(comp.isNotNull(), F.greatest(F.lit(0.2), 1.0 - 0.7 * comp)),
    }, cfg.feasibility_parts)


def demand_hits(text: Column) -> Column:
    hits = F.lit(0)
    for w in DEMAND_WORDS:
        hits = hits + text.contains(w).cast("int")
    return hits


def market_signal(trend_text: Column, days: Column) -> Column:
    fresh = (F.when(days.isNull(), 0.6).when(days <= 7, 0.9).when(days <= 21, 0.75).when(days <= 45, 0.6).otherwise(0.45))
    return 0.6 * F.least(F.lit(1.0), 0.45 + demand_hits(trend_text) * 0.08) + 0.4 * fresh


def growth_parts(cfg: RankerConfig, n_hits: Column | None = None) -> list[tuple[str, Column, float]]:
    n = F.size("p_skills")
    new = n - (F.size(skill_hits()) if n_hits is None else n_hits)
    s, lo = F.col("p_salary"), F.col("u_min_salary")
    usable = F.coalesce((s != 0) & (lo != 0), F.lit(False))
    ratio = F.try_divide(s, F.greatest(lo, F.lit(1e-6)))
    return _parts({
        "skill_growth_potential": F.when(n > 0, 0.7 * F.least(F.lit(1.0), new * 0.12) + 0.3 * F.try_divide(new.cast("double"), n.cast("double"))),
        "salary_growth_potential": F.when(usable, F.least(F.lit(1.0), sigmoid(ratio - 1, 2.2, 0.15))),
        "career_ladder_signal": safe_score(F.col("p_title_seniority_level")),
        "market_future_signal": F.col("p_market_signal"),
    }, cfg.growth_parts)


def final_score(cfg: RankerConfig) -> Column:
    return (F.col("relevance") * cfg.relevance_weight + F.col("feasibility") * cfg.feasibility_weight
            + F.col("growth") * cfg.growth_weight)


# fixed values: the sentences of the two explanations are output text
# --- explanations -------------------------------------------------------------------------

def match_explanation() -> Column:
    s, e, x, y = (F.col(f"{n}_score") for n in ("skill", "education", "experience", "salary"))
    skill = (F.when(s >= 0.8, F.concat(F.lit("Your skills are a strong match for the job requirements ("), percent(s), F.lit(")")))
             .when(s >= 0.6, F.concat(F.lit("Your skills broadly cover the job requirements ("), percent(s), F.lit(")")))
             .otherwise(F.concat(F.lit("Your skills partially match the job requirements ("), percent(s),
                                 F.lit("); you may need to learn new skills"))))
    return F.concat_ws(
        ";", skill, F.when(e >= 0.9, "Your education background fully meets the requirements"),
        F.when(x >= 0.8, "Your work experience is very matched").when(x < 0.5, "This job may need more related experience"),
        F.when(y >= 0.8, "Salary meets your expectations"))


def ranking_explanation() -> Column:
    def part(name: str, high: str, mid: str, low: str) -> Column:
        v = F.col(name)
        return F.concat(F.when(v >= 0.8, high).when(v >= 0.6, mid).otherwise(low), F.lit(" ("), percent(v), F.lit(")"))
    return F.concat_ws(
        " | ", part("relevance", "Highly relevant", "Moderately relevant", "Partially relevant"),
        part("feasibility", "Strong chance of landing this role", "Some chance of landing this role", "Competitive / difficult to land"),
        part("growth", "High growth potential", "Some growth opportunities", "Limited growth potential"))
