"""Catalogue filters, listings and statistics over the unified postings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..util import blank_to_null, col, empty_to_null, first_per_key, strip, top_per_key


def like(c: Column, needle: str, escape: bool = False) -> Column:
    """Case-insensitive containment; '%' and '_' act as wildcards unless escaped."""
    if escape:
        needle = needle.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")
    return c.ilike(f"%{needle}%")


def posting_filter(location: str | None = None, job_type: str | None = None, category: str | None = None,
                   min_salary: float | None = None, max_salary: float | None = None,
                   keywords: str | None = None, source: str | None = None, escape: bool = False) -> Column:
    """Conjunction of the filters that are set; pushed to the scan where Parquet can use it."""
    def any_of(a: str, b: str, needle: str) -> Column:
        return (like(F.coalesce(F.col(a), F.lit("")), needle, escape)
                | like(F.coalesce(F.col(b), F.lit("")), needle, escape))
    p = F.lit(True)
    if location:
        p = p & like(F.col("location"), location, escape)
    if job_type:
        p = p & any_of("job_type", "contract_type", job_type)
    if category:
        p = p & any_of("category", "subcategory", category)
    if min_salary is not None:
        p = p & (F.col("salary_min") >= min_salary)
    if max_salary is not None:
        p = p & (F.col("salary_max") <= max_salary)
    if keywords:
        p = p & (like(F.col("title"), keywords, escape) | like(F.col("description"), keywords, escape))
    if source:
        p = p & like(F.col("source"), source, escape)
    return p


def search(df: DataFrame, keyword: str, limit: int = 10, ts: str = "original_scraped_at") -> DataFrame:
    hit = like(F.col("title"), keyword) | like(F.col("description"), keyword)
    return df.filter(hit).orderBy(F.desc_nulls_last(ts), "job_id").limit(limit)


def by_location(df: DataFrame, location: str, limit: int = 100, ts: str = "original_scraped_at") -> DataFrame:
    return df.filter(like(F.col("location"), location)).orderBy(F.desc_nulls_last(ts), "job_id").limit(limit)


def recent(df: DataFrame, as_of: str, days: int = 7, limit: int | None = None, ts: str = "original_scraped_at") -> DataFrame:
    start = F.lit(as_of).cast("timestamp_ntz") - F.expr(f"INTERVAL {int(days)} DAYS")
    out = df.filter(F.col(ts) > start).orderBy(F.desc(ts), "job_id")
    return out.limit(limit) if limit else out


def retain(df: DataFrame, as_of: str, days: int = 30, ts: str = "scraped_at") -> DataFrame:
    """Rows that survive retention; rows without a timestamp are kept."""
    start = F.lit(as_of).cast("timestamp_ntz") - F.expr(f"INTERVAL {int(days)} DAYS")
    return df.filter((F.col(ts) >= start) | F.col(ts).isNull())


def page(df: DataFrame, number: int = 1, size: int = 20, order: Sequence[Column] | None = None) -> DataFrame:
    """One page with the number of rows that match in all, newest first."""
    number, size = max(1, number), min(max(size, 1), 100)
    order = order or [F.desc_nulls_last("original_scraped_at"), F.col("job_id")]
    total = df.agg(F.count_distinct("job_id").alias("total"))
    rows = df.orderBy(*order).offset((number - 1) * size).limit(size)
    return rows.withColumn("total", total.scalar())


def newest(df: DataFrame, ts: str, n: int, tie: str) -> DataFrame:
    return df.orderBy(F.desc_nulls_last(ts), tie).limit(n)


def source_distribution(df: DataFrame) -> DataFrame:
    g = df.groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    # One row per source is left, so the unpartitioned window is a handful of rows.
    return g.select("source", "n", F.round(F.col("n") * 100.0 / F.sum("n").over(Window.partitionBy()), 6).alias("share_pct"))


def field_coverage(df: DataFrame, fields: Sequence[str], strip_values: bool = False) -> DataFrame:
    """Non-blank count and percentage per field, all in one pass."""
    def filled(f: str) -> Column:
        c = F.col(f).cast("string")
        return F.count_if((strip(c) if strip_values else c) != "")
    one = df.agg(F.count(F.lit(1)).alias("total"), *[filled(f).alias(f) for f in fields])
    return one.unpivot(["total"], list(fields), "field", "filled").select(
        "field", "filled", "total", F.round(F.try_divide(F.col("filled") * 100.0, F.col("total")), 6).alias("pct"))


def top_values(df: DataFrame, value: Column, n: int, name: str = "value") -> DataFrame:
    """Most frequent non-blank values, ties by name."""
    return (df.select(F.trim(value).alias(name)).filter(F.col(name) != "").groupBy(name)
            .agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), name).limit(n))


def top_locations(df: DataFrame, n: int = 120) -> DataFrame:
    return top_values(df, F.col("location"), n, "location")


def top_companies(df: DataFrame, n: int = 10) -> DataFrame:
    return top_values(df, F.coalesce("company", "employer"), n, "company")


def table_stats(df: DataFrame, as_of: str, ts: str = "original_scraped_at") -> DataFrame:
    now = F.lit(as_of).cast("timestamp_ntz")
    with_salary = F.count_if(F.col("salary") != "")
    return df.agg(
        F.count(F.lit(1)).alias("total"), F.max(ts).alias("latest"),
        F.count_if(F.col(ts) > now - F.expr("INTERVAL 24 HOURS")).alias("last_24h"),
        F.count_if(F.col(ts) > now - F.expr("INTERVAL 7 DAYS")).alias("last_7d"),
        with_salary.alias("with_salary"),
        F.round(F.try_divide(with_salary * 100.0, F.count(F.lit(1))), 6).alias("salary_pct"))


def skills_per_posting(normalized: DataFrame, name: str = "normalized_skill_name") -> DataFrame:
    return (normalized.filter(F.col(name).isNotNull()).groupBy("job_id")
            .agg(F.array_sort(F.collect_set(name)).alias("required_skills")))


def with_skills(postings: DataFrame, normalized: DataFrame) -> DataFrame:
    """Attach each posting's skills; they are aggregated first, so the join does not fan out."""
    return (postings.join(skills_per_posting(normalized), "job_id", "left")
            .withColumn("required_skills", F.coalesce("required_skills", F.array().cast("array<string>"))))


def count_postings(df: DataFrame, predicate: Column) -> DataFrame:
    return df.filter(predicate).agg(F.count_distinct("job_id").alias("n"))


def distinct_union(df: DataFrame, first: str, second: str, limit: int | None, name: str = "value") -> DataFrame:
    a = df.select(F.trim(F.col(first)).alias(name))
    b = df.select(F.trim(F.col(second)).alias(name))
    out = a.union(b).filter(F.col(name) != "").distinct().orderBy(name)
    return out.limit(limit) if limit else out


def dedupe_labels(labels: DataFrame, value: str, order: Sequence[Column]) -> DataFrame:
    """One spelling per spacing/hyphen-free key, the first in the given order."""
    return (first_per_key(labels.filter(strip(value) != "").withColumn("label_key", tx.filter_key(value)), ["label_key"], order)
            .withColumn(value, strip(value)))


def drop_work_types(categories: DataFrame, job_types: DataFrame, value: str = "value") -> DataFrame:
    """Category labels that are neither contract words nor known job types."""
    keys = job_types.select(tx.filter_key(value).alias("label_key")).distinct()
    return (categories.filter(~tx.is_work_type_label(value)).withColumn("label_key", tx.filter_key(value))
            .join(keys, "label_key", "left_anti").drop("label_key"))


def merge_options(presets: DataFrame, values: DataFrame, value: str = "value", pos: str = "pos") -> DataFrame:
    """Presets in their own order, then the other values A-Z; ``position`` numbers the list."""
    p = dedupe_labels(presets, value, [F.col(pos)]).select("label_key", value, F.lit(0).alias("grp"), F.col(pos).cast("long").alias("ord"))
    rest = (values.filter(F.col(value) != "").withColumn("label_key", tx.filter_key(value))
            .join(p.select("label_key"), "label_key", "left_anti")
            .select("label_key", value, F.lit(1).alias("grp"), F.lit(0).cast("long").alias("ord")))
    return p.unionByName(rest).select(value, "grp", "ord", F.lower(value).alias("low")).orderBy("grp", "ord", "low", value)


def distinct_sources(df: DataFrame, limit: int | None = None) -> DataFrame:
    return df.filter(F.trim("source") != "").select("source").distinct() if limit is None else df.filter(F.trim("source") != "").select("source").distinct().orderBy("source").limit(limit)


def latest_history(history: DataFrame) -> DataFrame:
    """Latest row per user and posting."""
    return first_per_key(history, ["user_id", "job_id"], [F.desc("matched_at"), F.desc("event_id")])


def recommendation_feed(history: DataFrame, postings: DataFrame, limit: int = 10) -> DataFrame:
    """Per user the best latest rows with posting columns; the limit is clamped to 1-10."""
    n = min(max(int(limit), 1), 10)
    best = top_per_key(latest_history(history), ["user_id"], [F.desc_nulls_last("final_score"), F.col("job_id")], n)
    return best.join(postings, "job_id", "left")


def listing_shape(df: DataFrame) -> DataFrame:
    return df.select(
        "job_id", F.coalesce("title", F.lit("")).alias("title"),
        F.coalesce(empty_to_null("employer"), empty_to_null("company"), F.lit("Unknown Company")).alias("company"),
        F.coalesce("location", F.lit("")).alias("location"),
        salary_display().alias("salary"),
        F.coalesce(empty_to_null("job_type"), F.lit("Full-time")).alias("job_type"),
        F.coalesce("source", F.lit("")).alias("source"),
        job_link().alias("job_url"),
        F.substring(F.col("closing_date").cast("string"), 1, 10).alias("closing_date"))


def detail_shape(df: DataFrame, skills: str = "required_skills", limit: int | None = None) -> DataFrame:
    """One posting's page: the listing's columns, whole texts (``limit``: only so many characters), its skills and both links."""
    def whole(c: str) -> Column:
        text = F.coalesce(F.col(c), F.lit(""))
        return text if limit is None else F.substring(text, 1, limit)
    own = F.coalesce(skills, F.array().cast("array<string>")) if skills in df.columns else F.array().cast("array<string>")
    return df.select(
        "job_id", F.coalesce("title", F.lit("")).alias("title"),
        F.coalesce(empty_to_null("employer"), empty_to_null("company"), F.lit("")).alias("company"), F.coalesce("location", F.lit("")).alias("location"),
        salary_display().alias("salary"), F.col("salary").alias("salary_text"),
        F.coalesce(empty_to_null("description"), empty_to_null("full_description"), F.lit("")).alias("description") if limit is None else whole("description").alias("description"),
        whole("requirements").alias("requirements"), job_link().alias("job_url"),
        F.coalesce(empty_to_null("job_type"), F.lit("Full-time")).alias("job_type"), F.coalesce("source", F.lit("")).alias("source"), own.alias("required_skills"), "url", "apply_url",
        F.substring(F.col("closing_date").cast("string"), 1, 10).alias("closing_date"))


def recommendation_shape(feed: DataFrame) -> DataFrame:
    """Rows of a stored recommendation list (``recommendation_feed`` over merged postings) as a client reads them; missing texts are empty."""
    def text(c: str) -> Column:
        return F.coalesce(F.col(c), F.lit("")) if c in feed.columns else F.lit("")
    scores = {"score": "final_score", "relevance": "relevance_score", "feasibility": "feasibility_score", "growth": "growth_score", "match_score": "match_score"}
    return feed.select(
        "user_id", "rank", F.col("job_id").cast("string").alias("job_id"),
        *[(F.col(c).cast("double") if c in feed.columns else F.lit(None).cast("double")).alias(name) for name, c in scores.items()],
        "matched_at", text("title").alias("title"), text("location").alias("location"),
        F.coalesce(empty_to_null("employer"), empty_to_null("company"), F.lit("")).alias("company"), job_link().alias("job_url"),
        text("salary").alias("salary"), text("job_type").alias("job_type"), text("explanation").alias("explanation"),
        blank_to_null(strip(snippet(F.coalesce(empty_to_null("description"), empty_to_null("full_description"), F.lit(""))))).alias("description_snippet"),
        "department", "hours", F.substring(F.col("closing_date").cast("string"), 1, 10).alias("closing_date"), "source", "category")


def salary_display(text: str | Column = "salary", lo: str | Column = "salary_min", hi: str | Column = "salary_max") -> Column:
    """Salary text, else the numeric range, else a fixed phrase."""
    lo, hi = col(lo), col(hi)
    has_lo, has_hi = F.coalesce(lo != 0, F.lit(False)), F.coalesce(hi != 0, F.lit(False))
    return (F.when(col(text) != "", col(text))
            .when(~has_lo & ~has_hi, F.lit("Salary not provided"))
            .when(has_lo & ~has_hi, lo.cast("string"))
            .when(has_hi & ~has_lo, hi.cast("string"))
            .when(lo == hi, lo.cast("string"))
            .otherwise(F.concat_ws("-", lo.cast("string"), hi.cast("string"))))


def job_link() -> Column:
    return F.coalesce(blank_to_null(strip("apply_url")), blank_to_null(strip("url")))


def snippet(c: Column, limit: int = 320) -> Column:
    cut = F.concat(F.rtrim(F.substring(c, 1, limit - 3), F.lit(" \t\n\r\x0b\x0c")), F.lit("…"))
    return F.when(F.char_length(c) > limit, cut).otherwise(c)
