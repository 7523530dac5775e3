"""Corpus cleaning in five stages: quality rules, near-duplicates, repeated passages, benchmark leaks, tokens.

Each stage takes the documents that the one before left; all but the last return the columns they were given. Documents are told apart by
``doc_id``, null being an id like others. Rows of one id share their fate: they stay if one of them passes the quality rules, if one of
them is the first of its class of near-duplicates, and if none of them holds a benchmark item. Null texts do not pass the quality rules.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vacantia.llm import dart_minhash, decontaminate, ngram_quality, piece_bpe, suffix_dedup
from vacantia.llm.common import materialize, table

#: Bytes of a passage that counts as repeated. Any 51 words of two letters on average reach it (152 bytes with their blanks); of the stretches
#: of 51 words in sf0.1 and check_s, under 0.1 % in any language are shorter (runs of one word of one letter). Most passages of 50 words are twice as long.
PASSAGE = 150
#: Ids of dropped documents to broadcast at most; more are joined by shuffle.
BROADCAST_ROWS = 300_000


def _staying(docs: DataFrame, judged: DataFrame, stays: Column) -> DataFrame:
    """``docs`` without the ids of ``judged`` of which no row stays; texts are not shuffled if these are few."""
    gone = judged.groupBy("id").agg(F.max(stays).alias("__stays")).where("NOT __stays").select(F.col("id").alias("__gone"))
    gone = materialize(gone, "gone")
    return docs.join(F.broadcast(gone) if gone.count() <= BROADCAST_ROWS else gone, F.col("doc_id").eqNullSafe(F.col("__gone")), "left_anti")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the n-gram score keep."""
    return _staying(docs, ngram_quality.quality(docs, table(spark, sf_dir, "labels")), F.col("kept"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near-duplicates the document with the smallest id, once."""
    found = materialize(dart_minhash.near_duplicates(docs), "classes")
    left = _staying(docs, found, F.col("id").eqNullSafe(F.col("class_id")))
    repeated = found.groupBy("id").count().where("count > 1").limit(1).count()
    return left.dropDuplicates(["doc_id", "text"]) if repeated else left


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, later copies of passages cut out of their texts."""
    done = suffix_dedup.remove_repeats(docs, length=PASSAGE, keep="first", carry=True)
    text = F.when(~F.col("row.__null"), F.col("left"))
    columns = {c: F.col("row").getField(c) for c in docs.columns if c != "text"} | {"text": text} | ({"n_chars": F.length(text).cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {})
    return done.select(*(columns[c].alias(c) for c in docs.columns))


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item, within its error budget."""
    return _staying(docs, decontaminate.contaminated(docs, table(spark, sf_dir, "benchmark")), F.lit(False))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, ids, n_tokens, text`` (decoded from the ids)."""
    import public_tokenizers
    vocabulary = piece_bpe.read_vocabulary(public_tokenizers.path("piece_bpe_32k.model"))
    done = piece_bpe.encode_decode(docs, vocabulary)
    return done.select(F.col("id").alias("doc_id"), "ids", F.size("ids").cast("bigint").alias("n_tokens"), F.col("decoded").alias("text"))


STAGES = [
    ("quality rules", quality_rules),
    ("MinHash near-dedup", near_duplicates),
    ("suffix-array dedup", repeated_passages),
    ("benchmark decontamination", benchmark_leaks),
    ("SentencePiece encoding and decoding", tokens),
]

#: No stage but the base rules can be said in SQL; tests compare with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what is between two stages is written to the shared folder."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.split()[0].lower())
    return STAGES[-1][1](spark, docs, sf_dir)


QUERIES = {"pipeline": run}
ORACLE: dict[str, str] = {}
