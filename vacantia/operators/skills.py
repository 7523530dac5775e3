"""Skill mentions: requirement text, phrases, gazetteer, normalisation records, statistics, backfill."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import SkillConfig
from ..functions import text as tx
from ..util import blank_to_null, col, empty_to_null, first_per_key, materialize, r6e, rlike_any, strip, top_per_key
from .textjoin import contains_pairs

# --- fixed values: section titles and cue words of requirement text --------------------------
REQUIREMENT_TITLES = (
    r"requirements?", r"qualifications?", r"essential", r"what you(?:'|’)ll need", r"what we(?:'|’)re looking for",
    r"skills?", r"experience", r"education", r"must have", r"required", r"you will need",
)
OTHER_TITLES = (
    r"responsibilities?", r"duties", r"about (?:us|the role|the company)", r"benefits?", r"equal opportunity",
    r"how to apply", r"privacy", r"gdpr",
)
CUES = (
    r"\bmust\b", r"\brequired\b", r"\bshould\b", r"\bneed to\b", r"\bexperience (?:in|with)\b", r"\bproficient in\b",
    r"\bfamiliar with\b", r"\bknowledge of\b", r"\bability to\b",
)
LEGAL = r"\b(equal opportunity|gdpr|privacy|benefits?)\b"
TITLE_LINE = r"^\s*([A-Za-z][A-Za-z\s/&\-]{2,40})\s*:?\s*$"
BULLET_LINE = r"^\s*(?:[-*•]|(\d+[\.\)]))\s+.+$"
# fixed values: entity label -> mention type; other labels become SKILL
LABEL_TYPES = {"MISC": "SKILL", "ORG": "TOOL", "PER": "O", "LOC": "O", "O": "O"}

_BREAK = "\u0001"


def lines_of(c: str | Column) -> Column:
    return F.transform(F.split(col(c), r"\r\n|\n|\r"), lambda x: F.regexp_replace(x, r"\s+$", ""))


def sections(c: str | Column) -> Column:
    """Text cut at title lines: structs of title and body in order.

    Title lines get a mark and the text is split there, so one pass over the row does it:
    no explode, no window over lines.
    """
    marked = F.transform(lines_of(c), lambda x: F.when(x.rlike(TITLE_LINE), F.concat(F.lit(_BREAK), x, F.lit("\n"))).otherwise(x))
    parts = F.split(F.array_join(marked, "\n"), _BREAK)

    def one(part: Column, i: Column) -> Column:
        head = F.when(i > 0, F.regexp_extract(F.split(part, "\n", 2)[0], TITLE_LINE, 1)).otherwise("")
        body = F.when(i > 0, F.get(F.split(part, "\n", 2), F.lit(1))).otherwise(part)
        return F.struct(strip(head).alias("title"), strip(F.coalesce(body, F.lit(""))).alias("body"))
    return F.filter(F.transform(parts, one), lambda s: (s["title"] != "") | (s["body"] != ""))


def requirement_text(c: str | Column) -> Column:
    """Requirement part of a description: titled sections, else cue or bullet lines, else cue sentences, else ''."""
    low = F.lower
    picked = F.filter(sections(c), lambda s: rlike_any(low(s["title"]), REQUIREMENT_TITLES)
                      & ~rlike_any(low(s["title"]), OTHER_TITLES) & (s["body"] != ""))
    titled = F.array_join(F.transform(picked, lambda s: s["body"]), "\n")
    cue_lines = F.filter(lines_of(c), lambda x: (x.rlike(BULLET_LINE) | rlike_any(low(x), CUES)) & ~low(x).rlike(LEGAL))
    # A break mark after each sentence end keeps the punctuation with its sentence.
    raw = F.array_join(lines_of(c), "\n")
    sents = F.split(F.regexp_replace(raw, r"([.?!])\s+", "$1" + _BREAK), _BREAK)
    cue_sents = F.transform(F.filter(sents, lambda x: rlike_any(low(x), CUES)), strip)
    return F.when(F.size(picked) > 0, titled).when(F.size(cue_lines) > 0, strip(F.array_join(cue_lines, "\n"))).otherwise(
        strip(F.array_join(cue_sents, "\n")))


def extraction_text(c: str | Column) -> Column:
    """Text that extraction reads: the requirement part, or all of it when there is none."""
    return F.coalesce(empty_to_null(requirement_text(c)), col(c))


def map_labels(mentions: DataFrame, label: str = "label") -> DataFrame:
    kind = F.lit("SKILL")
    for k, v in LABEL_TYPES.items():
        kind = F.when(F.col(label) == k, F.lit(v)).otherwise(kind)
    return mentions.withColumn("skill_type", F.coalesce(kind, F.lit("SKILL"))).filter("skill_type <> 'O'")


def candidate_phrases(df: DataFrame, max_len: int | None = None, max_n: int | None = None) -> DataFrame:
    """Distinct phrases of each posting in field order; ``max_len``: only shorter ones, ``max_n``: at most so many per posting."""
    def field(name: str) -> Column:
        if name not in df.columns:
            return F.array().cast("array<string>")
        if dict(df.dtypes)[name].startswith("array"):
            return F.filter(F.transform(F.coalesce(name, F.array().cast("array<string>")), strip), lambda x: x != "")
        return tx.split_skill_values(name)
    phrases = F.concat(field("required_skills"), field("preferred_skills"), field("requirements"), field("description"),
                       tx.split_list("title", r"[/|,+()\-]"))
    short = phrases if max_len is None else F.filter(phrases, lambda x: F.char_length(x) <= max_len)
    low = F.transform(short, F.lower)
    # First spelling of each key: the key's first position must be its own.
    first = F.filter(F.zip_with(short, F.sequence(F.lit(1), F.greatest(F.size(short), F.lit(1))),
                                lambda x, i: F.struct(x.alias("phrase"), i.alias("pos"))),
                     lambda e: e["phrase"].isNotNull() & (F.array_position(low, F.lower(e["phrase"])) == e["pos"]))
    return df.select("job_id", F.posexplode(first if max_n is None else F.slice(first, 1, max_n)).alias("pos", "e")).select(
        "job_id", "pos", F.col("e.phrase").alias("phrase"))


# --- gazetteer ----------------------------------------------------------------------------

WORD = r"[\p{L}\p{N}_]+"


def gazetteer(texts: DataFrame, vocabulary: DataFrame, key: str = "job_id", text: str = "text", label: str = "label") -> DataFrame:
    """Vocabulary labels inside each text with score and method, each once per text.

    Plain words meet the text's distinct words in an equi-join. Labels of several words, and
    single ones with other characters, go through the gram join and are verified there.
    """
    voc = vocabulary.select(F.col(label).alias("label"), F.lower(label).alias("_low")).filter(strip("label") != "").distinct()
    words = F.size(tx.split_list("_low", r"\s+")) > 1
    plain = ~words & F.col("_low").rlike(f"^{WORD}$")
    low = texts.select(key, F.lower(text).alias("_text"))
    tokens = low.select(key, F.explode(F.array_distinct(F.regexp_extract_all("_text", F.lit(WORD), F.lit(0)))).alias("_low"))
    exact = tokens.join(voc.filter(plain), "_low").select(key, "label", F.lit(0.95).alias("score"), F.lit("keyword_match_exact").alias("method"))
    rest = voc.filter(~plain).withColumn("_multi", words)
    found = contains_pairs(rest.select("_low").distinct(), low, "_low", "_text", key).join(rest, "_low")
    multi = found.filter("_multi").select(key, "label", F.lit(0.90).alias("score"), F.lit("keyword_match_substring").alias("method"))
    odd = (found.filter("not _multi").join(low, key)
           .filter(F.expr(r"concat(' ', _text, ' ') RLIKE concat('\\b\\Q', _low, '\\E\\b')"))
           .select(key, "label", F.lit(0.95).alias("score"), F.lit("keyword_match_exact").alias("method")))
    return exact.unionByName(multi).unionByName(odd)


def extracted_mentions(postings: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """``job_id, skill_text, skill_type, score, method`` of postings: vocabulary labels in the part of the description that extraction reads, and listed requirements.

    A text counts once per posting in lower case: the best score first, then the listed one.
    """
    text = F.coalesce(empty_to_null("full_description"), empty_to_null("description"))
    # The gazetteer reads the texts several times: cut them out once.
    read = materialize(postings.select("job_id", extraction_text(text).alias("text")).filter("text IS NOT NULL"), "texts")
    found = gazetteer(read, vocabulary).select("job_id", F.col("label").alias("skill_text"), "score", "method", F.lit(1).alias("seq"))
    listed = postings.select("job_id", F.explode(tx.split_phrases("requirements")).alias("skill_text")).select(
        "job_id", "skill_text", F.lit(0.95).alias("score"), F.lit("listed_phrase").alias("method"), F.lit(0).alias("seq"))
    one = distinct_mentions(found.unionByName(listed), ["job_id"], "skill_text", "score", "seq")
    return one.select("job_id", "skill_text", F.lit("SKILL").alias("skill_type"), "score", "method")


def extraction_chain(postings: DataFrame, lib: DataFrame, best_of_names, cfg: SkillConfig | None = None) -> tuple[DataFrame, DataFrame]:
    """(mentions, normalised records) of postings against a taxonomy library; ``best_of_names`` maps distinct texts, see ``similarity``."""
    mentions = materialize(extracted_mentions(postings, keywords(lib)), "mentions")
    return mentions, skill_records(mentions.drop("score", "method"), best_of_names(mentions, lib, cfg, column="skill_text"), cfg)


def distinct_mentions(mentions: DataFrame, keys: list[str], text: str, score: str, seq: str) -> DataFrame:
    """One mention per lower-cased text, highest score first, then first seen."""
    return (first_per_key(mentions.withColumn("_key", F.lower(text)), [*keys, "_key"], [F.desc(score), F.col(seq)]).drop("_key"))


# --- taxonomy -----------------------------------------------------------------------------

def library(taxonomy_a: DataFrame, taxonomy_b: DataFrame | None = None) -> DataFrame:
    """Preferred and alternative labels as separate rows (and elements of the second taxonomy)."""
    base = taxonomy_a.filter(F.col("preferred_label") != "")
    cols = ["id", "skill_uri", "skill_type"]
    main = base.select(*cols, F.col("preferred_label").alias("name"), F.lit(False).alias("is_alternative"), F.lit("A").alias("source"))
    alt = (base.select(*cols, F.explode("alternative_labels").alias("name")).withColumn("name", strip("name")).filter("name <> ''")
           .withColumn("is_alternative", F.lit(True)).withColumn("source", F.lit("A")))
    out = main.unionByName(alt)
    if taxonomy_b is not None:
        out = out.unionByName(taxonomy_b.filter(F.col("element_name") != "").select(
            "id", F.col("element_id").alias("skill_uri"), F.col("category").alias("skill_type"),
            F.col("element_name").alias("name"), F.lit(False).alias("is_alternative"), F.lit("B").alias("source")))
    return out


def keywords(lib: DataFrame) -> DataFrame:
    return lib.select(strip("name").alias("label")).filter("label <> ''").distinct()


def canonical_names(matches: DataFrame, lib: DataFrame, skill_id: str = "skill_id") -> DataFrame:
    """Replace synonyms by the preferred label of their entry."""
    pref = lib.filter("not is_alternative").select(F.col("id").alias(skill_id), F.col("name").alias("_pref"))
    return matches.join(pref, skill_id, "left").withColumn("normalized", F.coalesce("_pref", "normalized")).drop("_pref")


# --- normalised records -------------------------------------------------------------------

def skill_records(mentions: DataFrame, best: DataFrame, cfg: SkillConfig | None = None) -> DataFrame:
    """Mentions with their best match; unmatched ones vanish, or keep their raw text if allowed.

    ``best`` has one row per distinct phrase: phrase, normalized, similarity, method, skill_id.
    """
    cfg = cfg or SkillConfig()
    rows = (mentions.filter(F.col("skill_type").isin("SKILL", "TOOL")).withColumn("raw", strip("skill_text")).filter("raw <> ''")
            .join(best.withColumnRenamed("phrase", "raw"), "raw", "left"))
    hit = F.col("normalized").isNotNull()
    raw_ok = F.lit(cfg.allow_raw_unmapped) & (F.char_length("raw") >= cfg.raw_unmapped_min_len)
    return rows.filter(hit | raw_ok).select(
        "job_id", "raw", "skill_type", F.coalesce("normalized", "raw").alias("normalized"),
        F.coalesce("similarity", F.lit(0.0)).alias("similarity"),
        F.coalesce("method", F.lit("raw_unmapped")).alias("normalization_method"), "skill_id")


def user_skill_records(user_skills: DataFrame, best: DataFrame) -> DataFrame:
    """Every user skill with its match; unmatched ones keep their text with method ``no_match``."""
    rows = user_skills.withColumn("raw", strip("name")).filter("raw <> ''").join(best.withColumnRenamed("phrase", "raw"), "raw", "left")
    return rows.select("user_id", "raw", F.coalesce("normalized", "raw").alias("normalized"),
                       F.coalesce("similarity", F.lit(0.0)).alias("similarity"),
                       F.coalesce("method", F.lit("no_match")).alias("normalization_method"), "skill_id")


def _first_seen(df: DataFrame, name: str, seq: str) -> DataFrame:
    """Distinct names per posting on their lower-case key, joined by '; ' in first-seen order."""
    named = df.withColumn("_name", strip(name)).filter("_name <> ''").withColumn("_key", F.lower("_name"))
    one = first_per_key(named, ["job_id", "_key"], [F.col(seq)])
    ordered = F.array_sort(F.collect_list(F.struct(F.col(seq).alias("s"), F.col("_name").alias("n"))))
    return one.groupBy("job_id").agg(F.array_join(F.transform(ordered, lambda e: e["n"]), "; ").alias("text"))


def requirements_text(normalized: DataFrame, mentions: DataFrame) -> DataFrame:
    """Requirement text per posting: normalised names, else SKILL/TOOL mentions."""
    a = _first_seen(normalized, "normalized", "seq")
    b = _first_seen(mentions.filter(F.col("skill_type").isin("SKILL", "TOOL")), "skill_text", "seq").withColumnRenamed("text", "fallback")
    return a.join(b, "job_id", "full").select("job_id", F.coalesce("text", "fallback").alias("requirements_text"))


def requirements_json(normalized: DataFrame, name: str = "normalized_skill_name") -> DataFrame:
    n = normalized.withColumn("_n", F.trim(name)).filter("_n <> ''")
    return n.groupBy("job_id").agg(F.to_json(F.array_sort(F.collect_set("_n"))).alias("requirements_json"))


def backfill_if_empty(postings: DataFrame, texts: DataFrame) -> DataFrame:
    fill = F.when(tx.requirements_empty("requirements"), F.coalesce(empty_to_null("requirements_text"), F.col("requirements")))
    return postings.join(texts, "job_id", "left").withColumn("requirements", fill.otherwise(F.col("requirements"))).drop("requirements_text")


def backfill_always(postings: DataFrame, texts: DataFrame) -> DataFrame:
    return (postings.join(texts, "job_id", "left")
            .withColumn("requirements", F.coalesce("requirements_json", "requirements")).drop("requirements_json"))


def with_normalized_flag(postings: DataFrame, normalized: DataFrame) -> DataFrame:
    ids = normalized.select("job_id").distinct().withColumn("has_normalized", F.lit(True))
    return postings.join(ids, "job_id", "left").withColumn("has_normalized", F.coalesce("has_normalized", F.lit(False)))


def route(flagged: DataFrame, only_open: bool = True) -> DataFrame:
    """Extraction candidates and the way each one takes."""
    def has(c: str) -> Column:
        return F.coalesce(F.trim(c) != "", F.lit(False))
    req = has("requirements") & (F.trim("requirements") != "[]")
    rows = flagged.filter(has("full_description") | has("description") | F.coalesce(req, F.lit(False)))
    if only_open:
        rows = rows.filter(tx.requirements_empty("requirements") | ~F.col("has_normalized"))
    return rows.withColumn("route", F.when(F.col("has_normalized"), "backfill_only").when(F.coalesce(req, F.lit(False)), "phrases_only").otherwise("extract"))


def skills_of(skills: DataFrame, ids: DataFrame) -> DataFrame:
    return skills.join(ids.select("job_id").distinct(), "job_id", "left_semi")


# --- statistics ---------------------------------------------------------------------------

def corpus_statistics(mentions: DataFrame, normalized: DataFrame) -> DataFrame:
    a = mentions.agg(F.count_distinct("job_id").alias("total_jobs"), F.count(F.lit(1)).alias("total_extracted"),
                     F.count_distinct("skill_text").alias("unique_extracted"))
    b = normalized.agg(F.count(F.lit(1)).alias("total_normalized"), F.count_distinct("normalized_skill_name").alias("unique_normalized"),
                       F.coalesce(F.avg(F.col("similarity_score").cast("double")), F.lit(0.0)).alias("avg_similarity"))
    for c in b.columns:
        a = a.withColumn(c, b.select(c).scalar())
    return a


def top_skills(normalized: DataFrame, n: int, name: str = "normalized_skill_name") -> DataFrame:
    return (normalized.filter(F.col(name).isNotNull()).groupBy(name).agg(F.count(F.lit(1)).alias("n"))
            .orderBy(F.desc("n"), name).limit(n))


def statistics_by_group(skills: DataFrame, dims: list[str], raw: str) -> DataFrame:
    """Counts overall and per value of each dimension in one grouping-sets pass."""
    sets = [[]] + [[d] for d in dims]
    out = skills.groupingSets(sets, *dims).agg(
        F.grouping_id().alias("_g"), F.count(F.lit(1)).alias("n"), F.count_distinct(raw).alias("unique_raw"),
        r6e(F.avg(F.col("similarity_score").cast("double"))).alias("avg_similarity"))
    full = (1 << len(dims)) - 1
    dim, val = F.lit("overall"), F.lit(None).cast("string")
    for i, d in enumerate(dims):
        mine = F.col("_g") == full - (1 << (len(dims) - 1 - i))
        dim, val = F.when(mine, F.lit(d)).otherwise(dim), F.when(mine, F.col(d)).otherwise(val)
    return out.select(dim.alias("dimension"), val.alias("value"), "n", "unique_raw", "avg_similarity")


def mapping_report(normalized: DataFrame, n: int = 100) -> DataFrame:
    g = (normalized.filter("normalized_skill_name is not null")
         .groupBy("raw_skill_text", "normalized_skill_name", "similarity_score", "normalization_method")
         .agg(F.count(F.lit(1)).alias("frequency")))
    band = F.when(F.col("similarity_score") >= 0.9, "high").when(F.col("similarity_score") >= 0.7, "medium").otherwise("low")
    return (g.orderBy(F.desc("frequency"), "raw_skill_text", "normalized_skill_name", "similarity_score", "normalization_method")
            .limit(n).withColumn("band", band))


def mention_counts(mentions: DataFrame) -> DataFrame:
    """Mentions per posting and type, with totals per posting and overall (rollup)."""
    return mentions.rollup("job_id", "skill_type").agg(F.count(F.lit(1)).alias("n"))


def mention_averages(mentions: DataFrame) -> DataFrame:
    per = mentions.groupBy("job_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("skill_type") == "TOOL").alias("tools"))
    return per.agg(F.count(F.lit(1)).alias("postings"), F.avg("n").alias("avg_mentions"), F.avg("tools").alias("avg_tools"))
