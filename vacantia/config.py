"""Settings of the matcher, ranker and skill normaliser, and fixed vocabularies."""

from __future__ import annotations

from dataclasses import dataclass, field

# --- fixed values: posting sources -------------------------------------------------------
SOURCE_A = "jobs_ac_uk"
SOURCE_B = "adzuna"
SOURCE_PRIORITY = {SOURCE_A: 0, SOURCE_B: 1}

# --- fixed values: education levels, lowest first ----------------------------------------
EDUCATION_LEVELS = ("High School", "Associate", "Bachelor", "Master", "PhD")
PREFERENCE_TYPES = ("Industry", "Company Size", "Work-Life Balance", "Career Growth", "Innovation")

# --- fixed values: words counted as demand signals ---------------------------------------
DEMAND_WORDS = (
    "ai", "machine learning", "data", "cloud", "security", "platform",
    "backend", "software", "analytics", "product",
)
# --- fixed values: words of texts and what they stand for, first hit first ----------------
EDUCATION_SCORE_WORDS = ((1.0, ("phd", "doctor")), (0.8, ("master", "msc", "ms ")), (0.6, ("bachelor", "undergraduate", "bsc", "ba ")), (0.4, ("associate", "diploma")))
EDUCATION_ORDINAL_WORDS = ((5, ("phd", "doctor")), (4, ("master", "msc", "m.sc")), (3, ("bachelor", "undergraduate", "bsc", "b.sc")), (2, ("associate", "diploma")), (1, ("high school",)))
SENIORITY_WORDS = ((0.85, ("intern", "trainee", "graduate", "entry", "junior", "assistant")), (0.35, ("lead", "principal", "staff", "architect", "manager", "director", "head")),
                   (0.45, ("senior", "sr.", "sr ", "mid-level")))
COMPANY_SIZE_WORDS = ((0.75, ("startup", "small", "1-10", "11-50", "51-200")), (0.65, ("201-500", "501-1000", "medium")), (0.55, ("enterprise", "1000+", "large", "multinational")))
TOP_SCHOOL_RANKS = ("985", "211", "QS Top 100")


# fixed values: weights and thresholds of the matcher, the ranker and the phrase mapper
@dataclass(frozen=True)
class MatcherConfig:
    skill_weight: float = 0.40
    education_weight: float = 0.15
    experience_weight: float = 0.15
    preference_weight: float = 0.15
    salary_weight: float = 0.10
    location_weight: float = 0.05
    min_skill_coverage: float = 0.5
    min_match_score: float = 0.3
    # True runs every constraint; False keeps the salary short circuit.
    strict_constraints: bool = False
    # True compares each token of a packed preference value.
    split_preference_values: bool = False


@dataclass(frozen=True)
class RankerConfig:
    relevance_weight: float = 0.40
    feasibility_weight: float = 0.35
    growth_weight: float = 0.25
    relevance_parts: dict[str, float] = field(default_factory=lambda: {
        "match_alignment": 0.45, "skill_alignment": 0.30,
        "preference_alignment": 0.15, "industry_alignment": 0.10,
    })
    feasibility_parts: dict[str, float] = field(default_factory=lambda: {
        "skill_readiness": 0.30, "experience_fit": 0.20, "education_fit": 0.15,
        "salary_attainability": 0.15, "location_commute_fit": 0.10,
        "market_competition_adjustment": 0.10,
    })
    growth_parts: dict[str, float] = field(default_factory=lambda: {
        "skill_growth_potential": 0.35, "salary_growth_potential": 0.25,
        "career_ladder_signal": 0.20, "market_future_signal": 0.20,
    })
    diversity_factor: float = 0.1
    candidate_cap: int = 0
    use_pareto: bool = False
    calibration: bool = True
    top_k: int = 20


@dataclass(frozen=True)
class SkillConfig:
    embedding_threshold: float = 0.68
    fuzzy_threshold: int = 78
    fuzzy_candidates: int | None = None  # None: all labels; a number: only so many nearest ones
    use_fuzzy: bool = True
    best_effort: bool = False
    best_effort_min: float = 0.5
    allow_raw_unmapped: bool = False
    raw_unmapped_min_len: int = 5
    canonical: bool = False
