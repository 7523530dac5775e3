"""Quality rules: base counts of a text, and a log-likelihood ratio of hashed n-grams.

Two multinomials over ``buckets`` hashed unigrams and bigrams are counted: one over the documents of a
trusted target, one over all documents. A document's score is the mean over its n-grams of
``log p_target - log p_raw``. The threshold is the score at which the labelled documents are parted with
the best balanced accuracy; it comes from exact counts of scores rounded to three digits, so that neither the
order of rows nor of tasks moves it. Every document is then judged by the same threshold.

Only the bucket counts (``buckets`` long numbers), and the counts of scores (at most 20,001), reach the driver.

Defined results: null text and text without a word have zero counts, score null and fail the base
rules (fewer than ``min_words`` words). Without a trusted document, or with labels of one class only, there is no
threshold and the method keeps every document. Labels of unknown documents are ignored; a document labelled twice is trusted if any
of its labels is. Repeated rows are judged one by one; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vacantia.llm.common import Memo, keyed, materialize, ship, slices

WORD = re.compile("[^\x20\x09-\x0d]+")
SYMBOL = re.compile("[#*$%&|<>]+")
GRAM = re.compile(r"\w+|[^\w\s]+")
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Trusted ids to broadcast at most, about 16 MB.
BROADCAST_ROWS = 500_000


def base_counts(text: str | None, words: list[str]) -> tuple[int, int, int, int, int]:
    """``COUNTS`` of one text and its words."""
    if not text:
        return 0, 0, 0, 0, 0
    lines = [line for line in text.split("\n") if WORD.search(line)]
    return (len(words), sum(map(len, words)), sum(map(len, SYMBOL.findall(text))), len(lines) - len(set(lines)), repeated_words(words))


def repeated_words(words: list[str]) -> int:
    """Words that stand in a window of three words found twice or more."""
    n = len(words)
    if n < 4:
        return 0
    ids: dict[str, int] = {}
    w = np.fromiter((ids.setdefault(x, len(ids)) for x in words), np.int64, n)
    size = len(ids)
    if size < 1 << 21:
        key = (w[:-2] * size + w[1:-1]) * size + w[2:]
    else:  # three numbers no longer fit one: number the pairs first
        pair = np.unique(w[:-2] * size + w[1:-1], return_inverse=True)[1]
        key = pair * size + w[2:]
    order = np.argsort(key, kind="stable")
    same = np.diff(key[order]) == 0
    if not same.any():
        return 0
    again = np.zeros(len(key) + 1, bool)
    again[1:-1] = same
    again[:-2] |= same
    hit = np.zeros(len(key), bool)
    hit[order] = again[:-1]
    covered = np.zeros(n, bool)
    for k in range(3):
        covered[k:k + len(key)] |= hit
    return int(covered.sum())


def gram_buckets(words: list[str], hashed: Memo, buckets: int) -> np.ndarray:
    """Buckets of the unigrams and bigrams of a text's tokens: runs of letters and digits, and runs of other signs."""
    h = np.frombuffer(b"".join(map(hashed.__getitem__, words)), np.uint64)
    pairs = (h[:-1] * np.uint64(0x9E3779B97F4A7C15) ^ (h[1:] + np.uint64(0x7F4A7C15))) * np.uint64(0xD6E8FEB86659FD93)
    return (np.concatenate([h, pairs ^ pairs >> np.uint64(32)]) % np.uint64(buckets)).astype(np.int64)


def _hasher() -> Memo:
    """Hashes of a word's tokens."""
    return Memo(lambda word: b"".join([xxhash.xxh3_64_digest(t)[::-1] for t in GRAM.findall(word)]), 100_000)


def bucket_counts(texts: DataFrame, buckets: int) -> DataFrame:
    """``bucket, target, raw``: counts over all rows of ``text, trusted``, summed within each task first."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashed, counts = _hasher(), np.zeros((2, buckets), np.int64)
        for b in slices(batches):
            for text, trusted in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if text:
                    grams = gram_buckets(WORD.findall(text), hashed, buckets)
                    np.add.at(counts[1], grams, 1)
                    if trusted:
                        np.add.at(counts[0], grams, 1)
        some = np.flatnonzero(counts[1])
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(counts[0][some]), pa.array(counts[1][some])], names=["bucket", "target", "raw"])

    return texts.mapInArrow(run, "bucket bigint, target bigint, raw bigint").groupBy("bucket").agg(F.sum("target").alias("target"), F.sum("raw").alias("raw"))


def log_ratios(counts: list, buckets: int) -> np.ndarray:
    """Logarithm of the two smoothed probabilities' ratio by bucket."""
    c = np.zeros((2, buckets))
    for bucket, target, raw in counts:
        c[:, bucket] = target, raw
    p = (c + 1) / (c.sum(1, keepdims=True) + buckets)
    return np.log(p[0]) - np.log(p[1])


def best_threshold(histogram: list[tuple[float, bool, int]]) -> float | None:
    """Lowest score to keep, so that labelled rows are parted with the best balanced accuracy; of equals the lowest."""
    good, bad = (sum(n for _, q, n in histogram if q is side) for side in (True, False))
    if not good or not bad:
        return None
    scores = sorted({s for s, _, _ in histogram})
    by = {(s, q): n for s, q, n in histogram}
    best, at, lost, gone = 0, scores[0], 0, 0
    for s, after in zip(scores, [*scores[1:], None], strict=True):
        lost, gone = lost + by.get((s, True), 0), gone + by.get((s, False), 0)
        gain = gone * good - lost * bad
        if after is not None and gain > best:
            best, at = gain, round((s + after) / 2, 6)
    return at


def quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", trusted: str = "quality = 1",
            buckets: int = 10_000, min_words: int = 50, max_repeat_percent: int = 50) -> DataFrame:
    """``id``, ``COUNTS``, ``score``, ``base_failed``, ``kept`` of every row; ``trusted``: the labels that make the target."""
    spark = docs.sparkSession
    ship(spark)
    rows = keyed(docs, id_col, text_col, "text")
    marked = labels.select(F.col(id_col).alias("id"), F.expr(trusted).alias("trusted")).where("id IS NOT NULL AND trusted IS NOT NULL").groupBy("id").agg(F.max("trusted").alias("trusted"))
    # A left join that broadcasts the trusted ids keeps the texts where they are read; a label table beyond that size is joined by shuffle.
    target = marked.where("trusted")
    if target.count() <= BROADCAST_ROWS:
        target = F.broadcast(target)
    texts = rows.join(target, "id", "left").select("text", F.coalesce("trusted", F.lit(False)).alias("trusted"))
    ratios = log_ratios([tuple(r) for r in bucket_counts(texts, buckets).collect()], buckets)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashed = _hasher()
        for b in slices(batches):
            out, scores = [], []
            for text in b.column(1).to_pylist():
                words = WORD.findall(text or "")
                out.append(base_counts(text, words))
                g = gram_buckets(words, hashed, buckets)
                scores.append(round(float(ratios[g].mean()), 3) + 0.0 if len(g) else None)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, pa.int64()) for c in (zip(*out, strict=True) if out else [[]] * 5)), pa.array(scores, pa.float64())], names=["id", *COUNTS, "score"])

    kinds = f"id {rows.schema['id'].dataType.simpleString()}, {', '.join(f'{c} bigint' for c in COUNTS)}, score double"
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    judged = materialize(rows.mapInArrow(run, kinds).withColumn("base_failed", failed), "quality")  # read twice below
    known = judged.where("NOT base_failed AND score IS NOT NULL").join(marked, "id").groupBy("score", "trusted").count()
    at = best_threshold([tuple(r) for r in known.collect()])
    good = F.lit(True) if at is None else F.coalesce(F.col("score") >= at, F.lit(True))
    return judged.withColumn("kept", ~F.col("base_failed") & good)
