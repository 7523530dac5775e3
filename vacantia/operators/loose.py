"""Records with arbitrary keys: alias names, collapse to standard fields, salary search."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..util import col, first_per_key, strip

# --- fixed values: spellings of each standard field; a later field takes over shared spellings ---
ALIASES: dict[str, tuple[str, ...]] = {
    "salary": ("salary", "funding", "funding amount", "fundingamount", "remuneration", "pay", "compensation", "stipend", "wage",
               "earnings", "package", "salary range", "annual salary", "hourly rate", "funding available", "bursary",
               "scholarship", "award", "grant", "financial support"),
    "employer": ("employer", "company", "organization", "organisation", "institution", "university", "college",
                 "employer name", "company name", "institution name"),
    "location": ("location", "place", "city", "region", "country", "address", "workplace", "site"),
    "job_type": ("job type", "employment type", "position type", "role type", "contract", "hours", "working hours",
                 "full time", "part time"),
    "contract_type": ("contract type", "contract", "duration", "term", "tenure", "fixed term", "permanent", "temporary"),
    "closing_date": ("closing date", "deadline", "application deadline", "expires", "expiry date", "close date", "end date"),
    "posted_date": ("posted date", "published date", "placed on", "date posted", "publication date", "start date"),
    "description": ("description", "job description", "full description", "details", "about", "overview", "summary"),
    "requirements": ("requirements", "qualifications", "essential qualifications", "essential requirements",
                     "required qualifications", "required skills", "prerequisites", "criteria"),
    "skills": ("skills", "required skills", "desired skills", "competencies", "abilities", "expertise"),
}
SALARY_WORDS = ("salary", "funding", "remuneration", "stipend", "pay", "compensation", "award", "grant", "bursary")
HIDDEN_KEYS = ("raw_data", "sections", "meta", "lists", "_raw_data")
REQUIRED = ("title", "employer", "location", "description", "url")


def normalize_key(c: str | Column) -> Column:
    k = F.replace(F.regexp_replace(F.lower(col(c)), "[ -]", "_"), F.lit(":"), F.lit(""))
    return F.trim(F.regexp_replace(F.replace(k, F.lit("/"), F.lit("_")), "_+", "_"), F.lit("_"))


def alias_table(spark: SparkSession, custom: Mapping[str, Sequence[str]] | None = None) -> DataFrame:
    """Normalised spelling -> standard field. Custom spellings join their field's list."""
    lists = {k: list(v) for k, v in ALIASES.items()}
    for k, v in (custom or {}).items():
        lists.setdefault(k, []).extend(v)
    rows = [(k, alias, i) for i, (k, v) in enumerate(lists.items()) for alias in v]
    df = spark.createDataFrame(rows, "field string, alias string, seq int").withColumn("key", normalize_key("alias"))
    return first_per_key(df, ["key"], [F.desc("seq")]).select("key", "field")


def normalize_records(records: DataFrame, aliases: DataFrame, rec: str = "rec_id", fields: str = "fields", sections: str | None = "sections") -> DataFrame:
    """One row per record with the map of standard (and unmapped) fields.

    Among spellings of one field the longest value wins, then the first.
    """
    entries = records.select(rec, F.posexplode(F.map_entries(fields)).alias("pos", "e")).select(
        rec, "pos", F.col("e.key").alias("raw_key"), F.col("e.value").alias("value"))
    entries = entries.filter((F.col("value") != "") & ~F.col("raw_key").isin(*HIDDEN_KEYS)).withColumn("key", normalize_key("raw_key"))
    # The alias table is a fixed dictionary of a few hundred short rows.
    named = entries.join(F.broadcast(aliases), "key", "left").withColumn("std", F.coalesce("field", "raw_key"))
    best = first_per_key(named, [rec, "std"], [F.desc(F.char_length("value")), F.col("pos")])
    maps = best.groupBy(rec).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("std", "value")))).alias("normalized"))
    out = records.join(maps, rec, "left").withColumn("normalized", F.coalesce("normalized", F.create_map().cast("map<string,string>")))
    salary = F.coalesce(F.try_element_at("normalized", F.lit("salary")), salary_search(fields, sections))
    rest = F.map_filter("normalized", lambda k, v: k != "salary")
    out = out.withColumn("_salary", salary).withColumn(
        "normalized", F.when(F.col("_salary").isNotNull(), F.map_concat(rest, F.create_map(F.lit("salary"), F.col("_salary")))).otherwise(rest))
    for f in REQUIRED:
        out = out.withColumn("normalized", F.when(F.map_contains_key("normalized", f), F.col("normalized")).otherwise(
            F.map_concat("normalized", F.create_map(F.lit(f), F.lit(None).cast("string")))))
    return out.drop("_salary")


def salary_search(fields: str, sections: str | None) -> Column:
    """Salary by priority: a salary-named field, a salary section, known text fields, any long text."""
    m = F.map_entries(fields)
    names = [a.replace(" ", "_") for a in ALIASES["salary"]]

    def named(n: str) -> Column:
        return F.get(F.filter(m, lambda e: (normalize_key(e["key"]) == n) & (strip(e["value"]) != "")), F.lit(0))
    direct = F.coalesce(*[strip(named(n)["value"]) for n in names])
    parts = [direct]
    if sections:
        hits = F.transform(
            F.filter(F.map_entries(sections), lambda e: (e["value"] != "") & F.lower(e["key"]).rlike("|".join(SALARY_WORDS))),
            lambda e: F.coalesce(tx.salary_phrase(e["value"]), F.when(F.char_length(e["value"]) < 500, strip(e["value"]))))
        parts.append(F.get(F.filter(hits, lambda x: x.isNotNull()), F.lit(0)))
    parts += [tx.salary_phrase(F.try_element_at(F.col(fields), F.lit(f))) for f in ("full_description", "description", "summary", "overview")]
    long = F.transform(F.filter(m, lambda e: F.char_length(e["value"]) > 50), lambda e: tx.salary_phrase(e["value"]))
    parts.append(F.get(F.filter(long, lambda x: x.isNotNull()), F.lit(0)))
    return F.coalesce(*parts)
