"""Map both sources to one schema, reject incomplete rows, drop duplicates."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import SOURCE_A, SOURCE_B, SOURCE_PRIORITY
from ..functions import text as tx
from ..util import blank_to_null, contains_any, empty_to_null, first_per_key, strip

# A target field is a source column name, nothing, or an expression built from the frame.
FieldRule = str | None | Callable[[DataFrame], Column]
REQUIRED_FIELDS = ("title", "company", "location")


def raw_value(df: DataFrame, *keys: str, payload: str = "raw_data") -> Column:
    """First non-empty value among alias columns, then among payload keys."""
    options = [empty_to_null(F.col(k).cast("string")) for k in keys if k in df.columns]
    if payload in df.columns:
        options += [empty_to_null(F.get_json_object(F.col(payload), f"$.{k}")) for k in keys]
    return F.coalesce(*options) if options else F.lit(None).cast("string")


def float_metric(df: DataFrame, *keys: str) -> Column:
    return raw_value(df, *keys).try_cast("double")


def int_metric(df: DataFrame, *keys: str) -> Column:
    return float_metric(df, *keys).try_cast("int")


def _posting_text(df: DataFrame) -> Column:
    if "_posting_text" in df.columns:
        return F.col("_posting_text")
    fields = [c if c in df.columns else None for c in ("title", "requirements", "description", "full_description")]
    return F.lower(F.concat_ws(" ", *[F.coalesce(F.col(c), F.lit("")) if c else F.lit("") for c in fields]))


def required_education(df: DataFrame, word_boundaries: bool = False) -> Column:
    direct = strip(raw_value(df, "required_education", "education_requirement", "education_level", "qualification"))
    text = _posting_text(df)
    # fixed values: first matching group wins
    groups = (("PhD", ("phd", "doctorate")), ("Master", ("master", "msc", "ms ")),
              ("Bachelor", ("bachelor", "undergraduate", "bs ", "bsc")))
    scan = F.lit(None).cast("string")
    for level, words in reversed(groups):
        if word_boundaries:
            hit = text.rlike("|".join(rf"\b{w.strip()}" + (r"\b" if w.endswith(" ") else "") for w in words))
        else:
            hit = contains_any(text, words)
        scan = F.when(hit, F.lit(level)).otherwise(scan)
    return F.coalesce(empty_to_null(direct), scan)


def required_years(df: DataFrame) -> Column:
    direct = float_metric(df, "required_experience_years", "experience_years", "min_experience_years")
    return F.when(direct.isNotNull(), F.greatest(F.lit(0.0), direct)).otherwise(
        tx.required_years_in_text(_posting_text(df)))


def stripped_value(*keys: str) -> Callable[[DataFrame], Column]:
    return lambda df: empty_to_null(strip(raw_value(df, *keys)))


_DERIVED: dict[str, FieldRule] = {
    "required_education": required_education,
    "required_experience_years": required_years,
    "company_size": stripped_value("company_size", "organization_size", "employer_size"),
    "industry": stripped_value("industry", "sector", "category", "subcategory"),
    "company_type": stripped_value("company_type", "employer_type", "organization_type"),
    "view_count": lambda df: int_metric(df, "view_count", "views", "impressions"),
    "application_count": lambda df: int_metric(df, "application_count", "applications"),
    "competition_level": lambda df: float_metric(df, "competition_level"),
}

# Every target field in output order, with its type for the gaps.
UNIFIED_TYPES: dict[str, str] = {
    "source": "string", "source_job_id": "string", "title": "string", "company": "string", "employer": "string",
    "department": "string", "location": "string", "area": "string", "salary": "string",
    "salary_min": "decimal(10,2)", "salary_max": "decimal(10,2)", "hours": "string", "job_type": "string",
    "contract_type": "string", "contract_time": "string", "description": "string", "full_description": "string",
    "requirements": "string", "responsibilities": "string", "url": "string", "apply_url": "string",
    "redirect_url": "string", "published_date": "timestamp_ntz", "closing_date": "timestamp_ntz",
    "expires": "string", "placed_on": "string", "created": "timestamp_ntz", "category": "string",
    "subcategory": "string", "required_education": "string", "required_experience_years": "double",
    "company_size": "string", "industry": "string", "company_type": "string", "view_count": "int",
    "application_count": "int", "competition_level": "double", "country": "string", "job_ref": "string",
    "feed_source": "string", "original_scraped_at": "timestamp_ntz", "raw_data": "string",
}


def _same(*names: str) -> dict[str, FieldRule]:
    return {n: n for n in names}


MAPPING_A: dict[str, FieldRule] = {
    **_same("title", "employer", "department", "location", "salary", "hours", "job_type", "contract_type",
            "description", "full_description", "requirements", "responsibilities", "url", "apply_url",
            "published_date", "closing_date", "expires", "placed_on", "category", "subcategory", "job_ref",
            "feed_source", "raw_data"),
    **_DERIVED,
    "source": lambda df: F.lit(SOURCE_A), "source_job_id": "job_id", "company": "employer",
    "country": lambda df: F.lit("uk"), "original_scraped_at": "scraped_at",
}

MAPPING_B: dict[str, FieldRule] = {
    **_same("title", "company", "location", "area", "salary_min", "salary_max", "contract_type", "contract_time",
            "description", "url", "redirect_url", "created", "category", "country", "raw_data"),
    **_DERIVED,
    "source": lambda df: F.lit(SOURCE_B), "source_job_id": "job_id", "employer": "company",
    "job_type": "contract_type", "full_description": "description", "apply_url": "redirect_url",
    "feed_source": lambda df: F.lit(SOURCE_B), "original_scraped_at": "scraped_at",
}


def salary_text(lo: Column, hi: Column) -> Column:
    """Display text of a numeric range; a bound of 0 counts as missing."""
    has_lo, has_hi = F.coalesce(lo != 0, F.lit(False)), F.coalesce(hi != 0, F.lit(False))
    flo = F.concat(F.lit("£"), F.format_number(lo.cast("double"), 0))
    fhi = F.concat(F.lit("£"), F.format_number(hi.cast("double"), 0))
    return (F.when(has_lo & has_hi & (lo == hi), flo)
            .when(has_lo & has_hi, F.concat(flo, F.lit(" - "), fhi))
            .when(has_lo, F.concat(flo, F.lit("+")))
            .when(has_hi, F.concat(F.lit("Up to "), fhi)))


def map_source(df: DataFrame, mapping: Mapping[str, FieldRule], salary_from_range: bool = False, later: Sequence[str] = (), carried: Sequence[str] = ()) -> DataFrame:
    """Apply a declarative field mapping; unmapped targets become typed NULLs.

    Fields named in ``later`` are left out; columns named in ``carried`` are added as ``_raw_<name>``.
    """
    out = [(F.col(k).cast("string") if k in df.columns else F.lit(None).cast("string")).alias(f"_raw_{k}") for k in carried]
    # Built once as a column: several derived fields scan it.
    df = df.withColumn("_posting_text", _posting_text(df))
    for name, typ in UNIFIED_TYPES.items():
        if name in later:
            continue
        rule = mapping.get(name)
        c = rule(df) if callable(rule) else F.lit(None) if rule is None or rule not in df.columns else F.col(rule)
        out.append(c.cast(typ).alias(name))
    res = df.select(*out)
    if salary_from_range:
        res = res.withColumn("salary", F.coalesce(empty_to_null("salary"), salary_text(F.col("salary_min"), F.col("salary_max"))))
    return res.withColumn("apply_url", F.coalesce(empty_to_null("apply_url"), F.col("url")))


def map_a(df: DataFrame) -> DataFrame:
    return map_source(df, MAPPING_A)


def map_b(df: DataFrame) -> DataFrame:
    return map_source(df, MAPPING_B, salary_from_range=True)


def is_complete(fields: tuple[str, ...] = REQUIRED_FIELDS) -> Column:
    ok = F.lit(True)
    for f in fields:
        ok = ok & F.coalesce(strip(f) != "", F.lit(False))
    return ok


def with_keys(df: DataFrame) -> DataFrame:
    """Add the duplicate hash and the stable id."""
    company = F.coalesce(empty_to_null("company"), F.col("employer"))
    return (df.withColumn("dedup_hash", tx.dedup_hash("title", company, "location"))
            .withColumn("job_id", tx.unified_id(F.col("source"), "source_job_id", "dedup_hash")))


def unify(a: DataFrame, b: DataFrame) -> DataFrame:
    """All mapped rows of both sources with their keys (nothing rejected yet)."""
    return with_keys(map_a(a).unionByName(map_b(b)))


def only_new(source: DataFrame, merged: DataFrame, name: str) -> DataFrame:
    """Source rows with an id whose unified id is not merged yet."""
    rows = source.filter(F.coalesce(F.trim(F.col("job_id").cast("string")) != "", F.lit(False)))
    known = merged.select(F.col("job_id").alias("_known"))
    return rows.join(known, F.concat(F.lit(name + "_"), F.col("job_id").cast("string")) == F.col("_known"), "left_anti")


def drop_known_hashes(batch: DataFrame, merged: DataFrame, refresh: bool = False) -> DataFrame:
    """Rows whose duplicate hash is not stored. ``refresh`` lets a row match its own stored copy."""
    if refresh:
        known = merged.select("dedup_hash", F.col("job_id").alias("_owner"))
        return batch.join(known, (batch.dedup_hash == known.dedup_hash) & (batch.job_id != known._owner), "left_anti")
    return batch.join(merged.select("dedup_hash").filter("dedup_hash is not null"), "dedup_hash", "left_anti")


def _keep_order() -> list[Column]:
    prio = F.lit(len(SOURCE_PRIORITY))
    for name, p in SOURCE_PRIORITY.items():
        prio = F.when(F.col("source") == name, F.lit(p)).otherwise(prio)
    return [prio, F.desc_nulls_last("original_scraped_at"), F.col("source_job_id")]


def first_per_hash(df: DataFrame) -> DataFrame:
    return first_per_key(df, ["dedup_hash"], _keep_order())


def unique_postings(mapped: DataFrame) -> DataFrame:
    """Complete mapped rows with keys, the first one per duplicate hash.

    Rows meet once, by the text that is hashed; wide rows are not shuffled a second time by their hash, which is made for the rows that stay.
    """
    company = F.coalesce(empty_to_null("company"), F.col("employer"))
    rows = mapped.filter(is_complete()).withColumn("_same", tx.dedup_text("title", company, "location"))
    return with_keys(first_per_key(rows, ["_same"], _keep_order()).drop("_same"))


#: A raw source: its rows, its mapping, and whether the salary text may come from the range.
Source = tuple[DataFrame, Mapping[str, FieldRule], bool]
#: Columns that the derived fields read, besides the payload.
DERIVED_INPUTS = ("title", "requirements", "description", "full_description", "required_education", "education_requirement", "education_level", "qualification",
                  "required_experience_years", "experience_years", "min_experience_years", "company_size", "organization_size", "employer_size", "industry", "sector", "category", "subcategory",
                  "company_type", "employer_type", "organization_type", "view_count", "views", "impressions", "application_count", "applications", "competition_level", "raw_data")


def unique_sources(sources: Sequence[Source], where: Column | None = None) -> DataFrame:
    """``unique_postings`` of the mapped sources, with the derived fields computed for the rows that stay.

    Duplicates are found by title, company, place and age alone, so texts and payloads are searched once per posting and not once per raw row.
    ``where`` reads fields that are not derived.
    """
    later = [n for n, rule in _DERIVED.items() if all(m.get(n) is rule for _, m, _ in sources)]
    simple = [n for n in UNIFIED_TYPES if n not in later]
    same = {k: [i for i, (df, m, _) in enumerate(sources) if k in df.columns and k in simple and m.get(k) == k] for k in DERIVED_INPUTS}
    # Inputs that no mapped field holds travel beside it.
    carried = [k for k in DERIVED_INPUTS if any(k in df.columns and i not in same[k] for i, (df, _, _) in enumerate(sources))]
    rows = None
    for i, (df, mapping, salary_from_range) in enumerate(sources):
        part = map_source(df, mapping, salary_from_range, later, carried).withColumn("_side", F.lit(i))
        part = part if where is None else part.filter(where)
        rows = part if rows is None else rows.unionByName(part)
    rows = unique_postings(rows)

    # The frame as the derived fields read it: a column that a source does not have is NULL for its rows.
    kept = {n: n for n in simple}
    for k in DERIVED_INPUTS:
        if k in carried:
            value = F.col(f"_raw_{k}")
        elif k in simple and any(m.get(k) is not None and i not in same[k] for i, (_, m, _) in enumerate(sources)):
            value = F.when(F.col("_side").isin(same[k]), F.col(k))
        else:
            continue
        if k in simple:
            kept[k] = f"_kept_{k}"
            rows = rows.withColumn(kept[k], F.col(k))
        rows = rows.withColumn(k, value)
    rows = rows.withColumn("_posting_text", _posting_text(rows))
    return rows.select(*[(_DERIVED[n](rows).cast(t) if n in later else F.col(kept[n])).alias(n) for n, t in UNIFIED_TYPES.items()], "dedup_hash", "job_id")


def insert_if_absent(batch: DataFrame, target: DataFrame, key: str = "job_id") -> DataFrame:
    """Rows to append: keys not in the target, one row per key."""
    one = first_per_key(batch, [key], [F.desc_nulls_last("original_scraped_at"), F.col("dedup_hash")])
    return one.join(target.select(key), key, "left_anti")


def merge_new_rows(a: DataFrame, b: DataFrame, merged: DataFrame) -> DataFrame:
    """Rows an incremental merge appends to ``merged``."""
    rows = map_a(only_new(a, merged, SOURCE_A)).unionByName(map_b(only_new(b, merged, SOURCE_B)))
    # The winner of a hash does not depend on what is stored, so the cheap map-side step comes first.
    return insert_if_absent(drop_known_hashes(unique_postings(rows), merged), merged)


def upsert(target: DataFrame, batch: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """New state of the target: per key the batch row if there is one, latest batch row first."""
    both = (batch.withColumn("_side", F.lit(0))
            .unionByName(target.withColumn("_side", F.lit(1)), allowMissingColumns=True))
    return first_per_key(both, keys, [F.col("_side"), *order]).drop("_side")


def replace_users(target: DataFrame, batch: DataFrame, user_col: str = "user_id",
                  users: DataFrame | None = None) -> DataFrame:
    """Child rows after all rows of the given users were replaced by the batch."""
    owners = (users if users is not None else batch).select(user_col).distinct()
    return target.join(owners, user_col, "left_anti").unionByName(batch)


def disposition(rows: DataFrame, merged: DataFrame) -> DataFrame:
    """Tag each fetched row with what the merge does to it: filtered, duplicate, skipped or inserted."""
    stored = merged.select("dedup_hash").distinct().withColumn("_stored", F.lit(True))
    ids = merged.select("job_id").distinct().withColumn("_has_id", F.lit(True))
    tagged = rows.withColumn("_ok", is_complete()).join(stored, "dedup_hash", "left").join(ids, "job_id", "left")
    # The winner of each hash among complete rows, found without gathering a hot hash in one task.
    winners = (first_per_hash(rows.filter(is_complete()))
               .select("dedup_hash", "source", "source_job_id").withColumn("_first", F.lit(True)))
    tagged = tagged.join(winners, ["dedup_hash", "source", "source_job_id"], "left")
    return tagged.withColumn(
        "disposition",
        F.when(~F.col("_ok"), "filtered")
        .when(F.col("_stored").isNotNull() | F.col("_first").isNull(), "duplicate")
        .when(F.col("_has_id").isNotNull(), "skipped")
        .otherwise("inserted")).drop("_ok", "_stored", "_has_id", "_first")


def merge_report(tagged: DataFrame) -> DataFrame:
    """Counts and rates per source plus a total row, in one aggregation pass."""
    def n(d: str) -> Column:
        return F.count_if(F.col("disposition") == d)
    agg = tagged.rollup("source").agg(
        F.count(F.lit(1)).alias("fetched"), n("filtered").alias("filtered"), n("duplicate").alias("duplicates"),
        n("skipped").alias("skipped"), n("inserted").alias("inserted"))
    valid = F.col("fetched") - F.col("filtered")
    return agg.select(
        F.coalesce("source", F.lit("(all)")).alias("source"), "fetched", "filtered", valid.alias("valid"),
        "duplicates", "skipped", "inserted",
        F.round(F.try_divide(F.col("filtered") * 100.0, F.col("fetched")), 6).alias("filtered_pct"),
        F.round(F.try_divide(F.col("duplicates") * 100.0, valid), 6).alias("duplicate_pct"))
