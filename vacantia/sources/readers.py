"""Readers of landed files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..util import empty_to_null, first_per_key, strip

API_SCHEMA = (
    "id string, title string, company struct<display_name:string>, location struct<display_name:string,area:array<string>>, "
    "category struct<label:string>, salary_min double, salary_max double, contract_type string, contract_time string, "
    "description string, redirect_url string, created string")
TAXONOMY_A_SCHEMA = "conceptUri string, preferredLabel string, altLabels string, description string, skillType string, reuseLevel string, code string"
TAXONOMY_B_SCHEMA = "`Element ID` string, `Element Name` string, `Description` string, `Scale ID` string, `Data Value` string"


def jdbc_table(spark: SparkSession, url: str, table: str, key: str, lower: int, upper: int, parts: int, **options: str) -> DataFrame:
    """A database table read in parallel ranges of a numeric key."""
    return (spark.read.format("jdbc").option("url", url).option("dbtable", table).option("partitionColumn", key)
            .option("lowerBound", lower).option("upperBound", upper).option("numPartitions", parts).options(**options).load())


def api_postings(landed: DataFrame, country: str = "gb") -> DataFrame:
    """Flatten landed API records to source-B rows."""
    def s(c: str):
        return F.coalesce(F.col(c), F.lit(""))
    return landed.select(
        F.col("id").alias("job_id"), "title", s("company.display_name").alias("company"), s("location.display_name").alias("location"),
        F.array_join(F.coalesce("location.area", F.array().cast("array<string>")), ", ").alias("area"),
        F.col("salary_min").try_cast("decimal(10,2)").alias("salary_min"), F.col("salary_max").try_cast("decimal(10,2)").alias("salary_max"),
        "contract_type", "contract_time", "description", s("category.label").alias("category"),
        F.col("redirect_url").alias("url"), "redirect_url", tx.parse_timestamp("created").alias("created"),
        F.lit(country).alias("country"), F.to_json(F.struct("*")).alias("raw_data"))


def read_api(spark: SparkSession, path: str) -> DataFrame:
    return api_postings(spark.read.schema(API_SCHEMA).json(path))


def taxonomy_a(raw: DataFrame) -> DataFrame:
    """Label rows with their synonyms as an array; rows without a key are skipped."""
    def s(c: str):
        return strip(F.coalesce(F.col(c), F.lit("")))
    return raw.select(
        s("conceptUri").alias("skill_uri"), s("code").alias("skill_code"), s("preferredLabel").alias("preferred_label"),
        tx.split_list("altLabels", "\n").alias("alternative_labels"), s("description").alias("description"),
        s("skillType").alias("skill_type"), s("reuseLevel").alias("skill_reuse_level")).filter("skill_uri <> ''")


def read_taxonomy_a(spark: SparkSession, path: str) -> DataFrame:
    """Columns are taken by header name (files differ in order and extra columns)."""
    raw = spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("inferSchema", False).csv(path)
    names = [f.name for f in spark.createDataFrame([], TAXONOMY_A_SCHEMA).schema]
    return taxonomy_a(raw.select(*[F.col(n) if n in raw.columns else F.lit(None).cast("string").alias(n) for n in names]))


def taxonomy_b(raw: DataFrame, category: str) -> DataFrame:
    def s(c: str):
        return strip(F.coalesce(F.col(f"`{c}`"), F.lit("")))
    return raw.select(
        s("Element ID").alias("element_id"), s("Element Name").alias("element_name"), s("Description").alias("description"),
        F.lit(category).alias("category"), s("Scale ID").alias("scale_id"),
        F.coalesce(s("Data Value").try_cast("double"), F.lit(0.0)).alias("data_value"))


def read_taxonomy_b(spark: SparkSession, files: dict[str, str]) -> DataFrame:
    """Union of tab-separated files, category -> path."""
    out = None
    for category, path in files.items():
        raw = spark.read.option("header", True).option("sep", "\t").option("inferSchema", False).csv(path)
        wanted = ("Element ID", "Element Name", "Description", "Scale ID", "Data Value")
        part = taxonomy_b(raw.select(*[F.col(f"`{n}`") if n in raw.columns else F.lit(None).cast("string").alias(n) for n in wanted]), category)
        out = part if out is None else out.unionByName(part)
    return out


def last_per_key(df: DataFrame, key: str, seq: str) -> DataFrame:
    return first_per_key(df, [key], [F.desc(seq)])


def longest_description(df: DataFrame, key: str = "element_id", seq: str = "seq") -> DataFrame:
    return first_per_key(df, [key], [F.desc(F.char_length("description")), F.col(seq)])


# fixed values: page fields that replace feed fields; the others only fill gaps
OVERWRITE = ("full_description", "requirements", "responsibilities", "employer", "department", "salary", "location", "hours",
             "contract_type", "job_type", "apply_url", "closing_date", "placed_on", "job_ref", "subcategory")


def overlay_pages(feed: DataFrame, pages: DataFrame, key: str = "job_id") -> DataFrame:
    """Feed entries with page fields laid over them: replace the listed fields, fill the others."""
    shared = [c for c in pages.columns if c != key]
    p = pages.select(key, *[F.col(c).alias(f"_p_{c}") for c in shared])
    out = feed.join(p, key, "left")
    cols = {}
    for c in shared:
        new = empty_to_null(f"_p_{c}")
        old = empty_to_null(F.col(c)) if c in feed.columns else F.lit(None).cast("string")
        cols[c] = F.coalesce(new, F.col(c) if c in feed.columns else old) if c in OVERWRITE else F.coalesce(old, new)
    return out.withColumns(cols).drop(*[f"_p_{c}" for c in shared])


def feed_id(url: str = "url"):
    return F.md5(F.col(url))
