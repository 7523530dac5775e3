"""Text, number and date expressions (all built-in columns, no Python UDF)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..util import blank_to_null, col, strip


def normalize_text(c: str | Column) -> Column:
    """Lower-case, single spaces, no punctuation; the order matters ("a - b" keeps two spaces)."""
    t = F.regexp_replace(F.lower(F.coalesce(col(c), F.lit(""))), r"\s+", " ")
    return strip(F.regexp_replace(t, r"[^\p{L}\p{N}_\s]", ""))


def dedup_text(title: str | Column, company: str | Column, location: str | Column) -> Column:
    """What the duplicate hash is made of; equal texts and equal hashes are the same thing."""
    return F.concat_ws("|", *(normalize_text(c) for c in (title, company, location)))


def dedup_hash(title: str | Column, company: str | Column, location: str | Column) -> Column:
    return F.sha2(dedup_text(title, company, location), 256)


def unified_id(source: Column, source_job_id: str | Column, hash_col: str | Column) -> Column:
    sid = blank_to_null(strip(col(source_job_id).cast("string")))
    return F.concat_ws("_", source, F.coalesce(sid, F.md5(col(hash_col))))


def filter_key(c: str | Column) -> Column:
    """Key on which 'Full Time', 'Full-time' and 'full_time' are the same label."""
    return F.regexp_replace(F.lower(strip(F.coalesce(col(c), F.lit("")))), r"[\s\-_]+", "")


def clean_text(c: str | Column) -> Column:
    t = strip(F.regexp_replace(F.coalesce(col(c), F.lit("")), r"\s+", " "))
    # fixed values: entities that survive extraction, replaced in this order
    for entity, char in (("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"),
                         ("&gt;", ">"), ("&quot;", '"'), ("&#039;", "'")):
        t = F.replace(t, F.lit(entity), F.lit(char))
    return t


def first_number(c: str | Column) -> Column:
    """First number inside a text such as '£36,636' or '36k'; NULL when there is none."""
    hit = F.regexp_extract(col(c).cast("string"), r"[-+]?\d[\d,]*\.?\d*", 0)
    return F.replace(hit, F.lit(","), F.lit("")).try_cast("double")


def all_numbers(c: str | Column) -> Column:
    """Every number of a text as an array of doubles."""
    hits = F.regexp_extract_all(col(c), F.lit(r"\d[\d,]*\.?\d*"), F.lit(0))
    nums = F.transform(hits, lambda h: F.replace(h, F.lit(","), F.lit("")).try_cast("double"))
    return F.filter(nums, lambda x: x.isNotNull())


def required_years_in_text(text: Column) -> Column:
    hit = F.regexp_extract(text, r"(\d+(?:\.\d+)?)\s*\+?\s*(?:years?|yrs?)", 1)
    # No hit leaves NULL; greatest() alone would turn it into 0.
    return F.when(hit != "", F.greatest(F.lit(0.0), hit.try_cast("double")))


def joined_lower(*cols: str) -> Column:
    """Texts joined by one blank, missing parts as '', lower-cased."""
    return F.lower(F.concat_ws(" ", *(F.coalesce(F.col(c), F.lit("")) for c in cols)))


def parse_timestamp(c: str | Column) -> Column:
    """Human date to timestamp: ordinal suffix, 'Sept', ISO first, then day-first formats."""
    s = strip(col(c))
    s = F.regexp_replace(s, r"(?i)(\d+)(st|nd|rd|th)\b", "$1")
    s = F.regexp_replace(s, r"Sept(?!ember)", "Sep")
    s = F.regexp_replace(s, r"(?i)^(?:mon|tue|wed|thu|fri|sat|sun)[a-z]*,?\s+", "")
    s = F.regexp_replace(s, r"\s+(?:GMT|UTC|\+0000)$", "")
    iso = F.regexp_replace(s, r"Z$", "")
    iso = F.regexp_replace(iso, r"^(\d{4}-\d{2}-\d{2})T", "$1 ")
    tries = [F.try_to_timestamp(iso, F.lit(f)) for f in
             ("yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd HH:mm:ss.SSS", "yyyy-MM-dd HH:mm", "yyyy-MM-dd",
              "yyyy/MM/dd HH:mm:ss", "yyyy/MM/dd")]
    tries += [F.try_to_timestamp(s, F.lit(f)) for f in
              ("d MMMM yyyy", "d MMM yyyy", "MMMM d, yyyy", "MMM d, yyyy", "d/M/yyyy", "d-M-yyyy", "d.M.yyyy",
               "d MMMM yyyy HH:mm", "d/M/yyyy HH:mm", "d MMM yyyy HH:mm:ss")]
    return F.coalesce(*tries)


def parse_date(c: str | Column) -> Column:
    """The four date layouts that profiles and postings may carry; anything else is NULL."""
    s = strip(col(c))
    return F.coalesce(*[F.try_to_timestamp(s, F.lit(f)) for f in
                        ("yyyy-MM-dd", "yyyy/MM/dd", "yyyy-MM-dd HH:mm:ss", "yyyy/MM/dd HH:mm:ss")]).cast("date")


# fixed values: salary phrases, first hit wins
SALARY_PATTERNS = (
    r"£[\d,]+(?:\s*-\s*£[\d,]+)?(?:\s*(?:per|p\.a\.|pa|annually|per annum|year))?",
    r"\$[\d,]+(?:\s*-\s*\$[\d,]+)?(?:\s*(?:per|p\.a\.|pa|annually|per annum|year))?",
    r"€[\d,]+(?:\s*-\s*€[\d,]+)?(?:\s*(?:per|p\.a\.|pa|annually|per annum|year))?",
    r"[\d,]+\s*(?:GBP|USD|EUR)(?:\s*-\s*[\d,]+\s*(?:GBP|USD|EUR))?",
    r"funding\s+(?:of|amount:?)\s+£[\d,]+",
    r"stipend\s+(?:of|amount:?)\s+£[\d,]+",
    r"salary\s+(?:of|range:?)\s+£[\d,]+",
    r"(?:salary|funding|stipend|pay)[\s:]+[\d,]+\s*-\s*[\d,]+",
)


def salary_phrase(c: str | Column) -> Column:
    hits = [F.regexp_extract(col(c), "(?i)" + p, 0) for p in SALARY_PATTERNS]
    return strip(F.coalesce(*[F.when(h != "", h) for h in hits]))


def split_list(c: str | Column, separators: str) -> Column:
    """Split, strip and drop empty parts; NULL becomes an empty array."""
    parts = F.transform(F.split(F.coalesce(col(c), F.lit("")), separators), strip)
    return F.filter(parts, lambda x: x != "")


def split_phrases(c: str | Column) -> Column:
    """Requirement phrases: a JSON array of strings, else text split on ';' and line ends."""
    s = strip(F.coalesce(col(c), F.lit("")))
    as_json = F.filter(
        F.transform(F.from_json(F.when(s.startswith("["), s), "array<string>"), strip),
        lambda x: x.isNotNull() & (x != ""))
    parts = split_list(s, r"[;\n\r]+")
    plain = F.when(s == "", F.array().cast("array<string>")).when(F.size(parts) > 0, parts).otherwise(F.array(s))
    return F.when(s.startswith("[") & F.from_json(s, "array<string>").isNotNull(), as_json).otherwise(plain)


def split_skill_values(c: str | Column) -> Column:
    """Skill values of a field: a JSON array, else split on common separators."""
    s = strip(F.coalesce(col(c), F.lit("")))
    is_json = s.startswith("[") & s.endswith("]") & F.from_json(s, "array<string>").isNotNull()
    as_json = F.filter(F.transform(F.from_json(s, "array<string>"), strip), lambda x: x != "")
    return F.when(is_json, as_json).otherwise(split_list(s, r"[,\n;/|]+"))


def requirements_empty(c: str | Column) -> Column:
    """True for NULL, blank and '[]'."""
    t = F.trim(col(c))
    return col(c).isNull() | t.isin("", "[]")


def is_work_type_label(c: str | Column) -> Column:
    # fixed values: labels that describe a contract, not a category
    return col(c).rlike(
        r"(?i)^\s*(full|part)\s*[-]?\s*time\s*$|"
        r"^\s*(permanent|temporary|contract|fixed[- ]?term|internship|hybrid|seasonal|freelance)\s*$|"
        r"^\s*remote\s*$")


def node_id(prefix: str, key: str | Column) -> Column:
    return F.concat(F.lit(prefix + "_"), F.substring(F.md5(col(key)), 1, 16))


def trigram_vector(c: Column, dims: int = 256) -> Column:
    """Counts of the letter triples of a phrase (lower case, a blank at both ends) in ``dims`` places: a vector for phrases that no model has embedded.

    A triple's place follows from its code points alone: ``(961 a + 31 b + c) mod dims``.
    """
    low = F.concat(F.lit(" "), F.lower(strip(c)), F.lit(" "))
    places = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.char_length(low) - 2)), lambda i: (
        F.ascii(F.substring(low, i, F.lit(1))) * 961 + F.ascii(F.substring(low, i + 1, F.lit(1))) * 31 + F.ascii(F.substring(low, i + 2, F.lit(1)))) % dims)
    # The places are worked out once, as a variable of the outer step, and not again for each of the dims counts.
    return F.get(F.transform(F.array(places), lambda ps: F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda k: (F.size(ps) - F.size(F.array_remove(ps, k))).cast("double"))), F.lit(0))
