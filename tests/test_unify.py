import datetime as dt
import hashlib

from pyspark.sql import functions as F

from vacantia.operators import unify as u
from vacantia.sources import sinks
from vacantia.streaming import streams as st

A = ("job_id string, title string, employer string, location string, description string, requirements string, url string, apply_url string, "
     "category string, subcategory string, scraped_at timestamp_ntz, raw_data string")
T1, T2 = dt.datetime(2024, 1, 1), dt.datetime(2024, 2, 1)


def rows_a(spark):
    return spark.createDataFrame([
        ("1", "Lecturer - Maths", "Uni X", "York", "2+ years needed", None, "u1", "", "Edu", None, T1, '{"experience_years": "-3", "views": 7}'),
        ("2", "lecturer   maths", "uni x!", "York", "", None, "u2", "a2", "Edu", None, T2, None),
        ("3", " ", "Uni X", "York", "", None, "u3", None, "Edu", None, T2, None),
        ("4", "Clerk", "Uni Y", "Bath", "programs ", None, "u4", None, "", "Sub", T1, '{"sector": "Health", "education_level": " PhD "}'),
        (" ", "Guard", "Uni Z", "Bath", "over 3.5 yrs", None, "u5", None, None, None, None, "not json"),
    ], A)


def test_mapping_and_keys(spark):
    got = {r.source_job_id: r for r in u.with_keys(u.map_a(rows_a(spark))).collect()}
    assert got["1"].required_experience_years == 0.0 and got["1"].view_count == 7
    assert got["1"].apply_url == "u1" and got["2"].apply_url == "a2"
    # columns win over the payload, the payload wins over nothing
    assert got["4"].industry == "Sub" and got["4"].required_education == "PhD"
    assert got[" "].required_experience_years == 3.5 and got["2"].required_experience_years is None
    key = hashlib.sha256("lecturer  maths|uni x|york".encode()).hexdigest()
    assert got["1"].dedup_hash == key and got["1"].job_id == "jobs_ac_uk_1"
    assert got[" "].job_id == "jobs_ac_uk_" + hashlib.md5(got[" "].dedup_hash.encode()).hexdigest()


def test_education_words(spark):
    df = rows_a(spark).filter("job_id = '4'").withColumn("raw_data", F.lit(None).cast("string"))
    loose, strict = df.select(u.required_education(df), u.required_education(df, word_boundaries=True)).first()
    assert loose == "Master" and strict is None


def test_first_per_hash_is_idempotent_and_spacing_counts(spark):
    rows = u.with_keys(u.map_a(rows_a(spark))).filter(u.is_complete())
    once = u.first_per_hash(rows)
    # "a - b" keeps two blanks, so it is not the duplicate of "a b"
    assert once.count() == 4
    assert sorted(r.job_id for r in u.first_per_hash(once).collect()) == sorted(r.job_id for r in once.collect())


def test_raw_collapse_changes_nothing(spark):
    mapped = u.map_a(rows_a(spark).unionByName(rows_a(spark).withColumn("job_id", F.concat(F.lit("9"), "job_id"))))
    want = u.first_per_hash(u.with_keys(mapped).filter(u.is_complete()))
    assert sorted(r.job_id for r in u.unique_postings(mapped).collect()) == sorted(r.job_id for r in want.collect())


def test_duplicates_meet_in_one_shuffle(spark):
    a = rows_a(spark)
    again = a.withColumn("job_id", F.concat(F.lit("9"), "job_id")).withColumn("title", F.upper("title"))
    mapped = u.map_a(a.unionByName(again).unionByName(a))
    out = u.unique_postings(mapped)
    want = u.first_per_hash(u.with_keys(mapped).filter(u.is_complete()))
    assert sorted((r.dedup_hash, r.job_id) for r in out.collect()) == sorted((r.dedup_hash, r.job_id) for r in want.collect())
    plan = out._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("simple"))
    assert plan.split("== Initial Plan ==")[0].count("Exchange hashpartitioning") == 1


def test_stream_equals_batch(spark, tmp_path):
    src = rows_a(spark)
    src.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(src.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = st.merge_stream(stream, u.map_a, "t").select("dedup_hash").collect()
    want = u.first_per_hash(u.with_keys(u.map_a(src)).filter(u.is_complete())).select("dedup_hash").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want))


def test_salary_text(spark):
    df = spark.createDataFrame([(10.0, 10.0), (10.5, 2000.0), (5.0, None), (0.0, 7.0), (None, 0.0)], "a double, b double")
    got = [r[0] for r in df.select(u.salary_text(F.col("a"), F.col("b"))).collect()]
    assert got == ["£10", "£10 - £2,000", "£5+", "Up to £7", None]


def test_custom_mapping(spark):
    mapping = {"source": lambda df: F.lit("board"), "source_job_id": "job_id", "title": lambda df: F.upper("title"), "company": "employer", "location": "nowhere"}
    r = u.with_keys(u.map_source(rows_a(spark).filter("job_id = '4'"), mapping)).first()
    assert (r.job_id, r.title, r.company, r.location, r.salary) == ("board_4", "CLERK", "Uni Y", None, None)


def test_derived_fields_are_made_after_duplicates_are_dropped(spark):
    """Same rows as mapping everything first, also where a source has a column that its mapping ignores; texts are searched above the last window."""
    a = rows_a(spark)
    b = a.withColumn("job_id", F.concat(F.lit("b"), "job_id")).withColumnRenamed("employer", "company").withColumn("views", F.lit("9")).withColumn("sector", F.lit("Law")).withColumn("full_description", F.lit("PhD"))
    b = b.withColumn("location", F.lit("Hull")).unionByName(b)
    cast = [c for c in u.UNIFIED_TYPES]
    want = u.unique_postings(u.map_a(a).unionByName(u.map_b(b)))
    got = u.unique_sources([(a, u.MAPPING_A, False), (b, u.MAPPING_B, True)])
    assert got.columns == want.columns == [*cast, "dedup_hash", "job_id"]
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and got.filter("required_education = 'PhD' and view_count = 9").count() > 0
    plan = got._jdf.queryExecution().optimizedPlan().toString().splitlines()
    assert not any("doctorate" in line for line in plan[max(k for k, line in enumerate(plan) if "Window" in line):])
    early = u.unique_sources([(a, u.MAPPING_A, False)], F.col("original_scraped_at") < "2024-01-15")
    assert {r.job_id for r in early.collect()} == {r.job_id for r in u.unique_postings(u.map_a(a).filter(F.col("original_scraped_at") < "2024-01-15")).collect()}


def test_export_makes_its_rows_once(spark, tmp_path):
    made = spark.sparkContext.accumulator(0)

    def text(i):
        made.add(1)
        return f"t{i}"
    rows = spark.range(100).repartition(3).select(F.col("id").cast("string").alias("job_id"), F.udf(text)("id").alias("title"), (F.col("id") % 7).alias("at"), F.lit("x").alias("raw_data"))
    path = sinks.export_csv(rows, "at", path=str(tmp_path / "csv"))
    assert made.value == 100
    back = spark.read.option("header", True).csv(path)
    assert back.columns == ["job_id", "title", "at"] and {(r.job_id, r.title) for r in back.collect()} == {(str(i), f"t{i}") for i in range(100)}
