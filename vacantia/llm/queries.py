"""Registered queries of the corpus operators: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vacantia.llm import dart_minhash, decontaminate, jaccard_rtree, lang_cnn, license_align, main_text, ngram_quality, piece_bpe, spelling, suffix_dedup, url_trees, warc_store, whitening
from vacantia.llm.common import table


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).withColumnRenamed("id", "doc_id")


def op2_warc_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_store.round_trip(table(spark, sf_dir, "pages")).withColumnRenamed("id", "page_id")


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"), length=400, keep="none")
    return done.select(
        F.col("id").alias("doc_id"), "n_bytes", F.aggregate("spans", F.lit(0).cast("bigint"), lambda a, s: a + s["end"] - s["start"]).alias("n_removed"),
        F.size("spans").cast("bigint").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"),
        F.make_valid_utf8(F.col("kept").cast("string")).alias("text"))


def op4_license_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_align.scan(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


#: Policy of the URL filter: verdict, host, path.
URL_RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
#: Words that mark a host as unwanted: the labels for training. The trees never see words, only counts and shares.
UNWANTED = ("ads", "adult", "bets", "casino", "pills", "spam", "track")


def op5_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text.extract(table(spark, sf_dir, "pages")).withColumnRenamed("id", "page_id")


def op6_url_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    host = url_trees.split_url(F.col("url"))["host"]
    label = F.when(host != "", host.rlike(f"(^|[.-])({'|'.join(UNWANTED)})([.-]|$)").cast("int"))
    return url_trees.judge(table(spark, sf_dir, "pages"), label, URL_RULES).withColumnRenamed("id", "page_id")


def op7_lang_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lang_cnn.predict(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op8_dart_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dart_minhash.near_duplicates(table(spark, sf_dir, "documents"), weighted=True).withColumnRenamed("id", "doc_id")


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers
    vocabulary = piece_bpe.read_vocabulary(public_tokenizers.path("piece_bpe_32k.model"))
    done = piece_bpe.encode_decode(table(spark, sf_dir, "documents"), vocabulary)
    return done.select(F.col("id").alias("doc_id"), F.size("ids").cast("bigint").alias("n_tokens"), F.sha2(F.array_join("ids", " "), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op10_ngram_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_quality.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).withColumnRenamed("id", "doc_id")


def op11_jaccard_rtree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_rtree.linked(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings")).withColumnRenamed("id", "vec_id").withColumn("deviation", F.col("deviation").cast("bigint"))


QUERIES = {f.__name__: f for f in (op1_decontamination, op2_warc_store, op3_suffix_dedup, op4_license_align, op5_main_text, op6_url_trees, op7_lang_cnn, op8_dart_minhash, op9_sentencepiece, op10_ngram_quality, op11_jaccard_rtree, op12_spelling_variants, op13_whitening)}

#: Twins for the driver's SQL engine.
ORACLE: dict[str, str] = {
    "op2_warc_store": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
        m AS (SELECT page_id, h, sha1(h) AS x, max(page_id) OVER (PARTITION BY h) AS top FROM p)
        SELECT page_id, CAST(octet_length(encode(h)) AS BIGINT) AS payload_bytes,
            array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                CAST((CAST('0x' || substr(x, CAST(5 * (i // 4) + 1 AS INT), 5) AS INT) >> CAST(15 - 5 * (i % 4) AS INT)) & 31 AS INT) + 1, 1)), '') AS payload_digest,
            CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
            CASE WHEN page_id = top THEN NULL ELSE top END AS refers_to
        FROM m""",
}
