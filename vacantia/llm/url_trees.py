"""URL filter: policy rules first, then gradient-boosted trees on lexical features.

Features are columns (no Python): lengths, depth, digit share, entropy of the letters, parameters, hyphens, labels of the host, and
statistics of the host's suffix: how common it is and how often training rows of it are unwanted. Trees are trained by Spark's own
distributed gradient boosting on labelled URLs.

Training takes about ``train_rows`` labelled rows at most, chosen by a hash of the URL (a documented bound of the sample;
the trees have few splits, which more rows do not change); everything else covers all rows.

Defined results: a null URL or one without ``://`` has an empty host and path, fits no rule, and is judged by its features like others
(null counts as empty). With labels of one class only there are no trees and all is allowed. Repeated rows give
repeated rows, an empty table an empty result, and other columns are ignored.
"""

from __future__ import annotations

import string

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vacantia.llm.common import materialize

FEATURES = ("url_length", "host_length", "path_length", "depth", "digit_share", "entropy", "parameters", "query_length", "hyphens", "host_labels", "longest_label", "suffix_rows", "suffix_rate")
#: Suffixes to broadcast at most; beyond it their statistics are joined by shuffle.
BROADCAST_ROWS = 100_000

Rule = tuple[str, str, str]  # verdict, host, path


def split_url(url: Column) -> dict[str, Column]:
    """``host`` (ASCII letters lower-cased), ``path`` and ``query`` of a URL; empty without ``://``."""
    url = F.coalesce(url, F.lit(""))
    rest = F.when(F.instr(url, "://") > 0, url.substr(F.instr(url, "://") + F.lit(3), F.length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    after = rest.substr(F.length(host) + F.lit(1), F.length(rest))
    return {"host": F.translate(host, string.ascii_uppercase, string.ascii_lowercase), "path": F.regexp_extract(after, "^[^?#]*", 0), "query": F.regexp_extract(after, r"\?([^#]*)", 1)}


def rule_of(rules: list[Rule], host: Column, path: Column) -> Column:
    """The longest rule that fits as ``struct(verdict, rule)``, or null. The rules are a policy list given by the caller, not data."""
    out = F.lit(None).cast("struct<verdict:string,rule:string>")
    for verdict, h, p in sorted(rules, key=lambda r: (len(r[1]) + len(r[2]), len(r[1]), r)):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        out = F.when(fits, F.struct(F.lit(verdict).alias("verdict"), F.lit(h + p).alias("rule"))).otherwise(out)
    return out


def lexical(df: DataFrame) -> DataFrame:
    """Adds the features that need one URL only, and its ``suffix``; ``df`` has ``url, host, path, query``."""
    url = F.coalesce("url", F.lit(""))
    letters = F.split(url, "")
    n = F.length(url)
    share = lambda k: k / F.greatest(n, F.lit(1))
    entropy = F.aggregate(F.transform(F.array_distinct(letters), lambda c: F.size(F.filter(letters, lambda x: x == c)).cast("double")), F.lit(0.0), lambda a, k: a - share(k) * F.log2(share(k)))
    labels = F.split("host", r"\.")
    return df.select(
        "*",
        n.cast("double").alias("url_length"), F.length("host").cast("double").alias("host_length"), F.length("path").cast("double").alias("path_length"),
        F.size(F.filter(F.split("path", "/"), lambda x: x != "")).cast("double").alias("depth"),
        share(F.length(F.regexp_replace(url, "[^0-9]", ""))).cast("double").alias("digit_share"), F.when(n > 0, entropy).otherwise(0.0).alias("entropy"),
        F.size(F.filter(F.split("query", "&"), lambda x: x != "")).cast("double").alias("parameters"), F.length("query").cast("double").alias("query_length"),
        F.length(F.regexp_replace("host", "[^-]", "")).cast("double").alias("hyphens"), F.size(labels).cast("double").alias("host_labels"),
        F.array_max(F.transform(labels, lambda x: F.length(x))).cast("double").alias("longest_label"), F.element_at(labels, -1).alias("suffix"))


def suffix_statistics(rows: DataFrame, prior: float = 10.0) -> DataFrame:
    """``suffix, suffix_rows`` (logarithm) and ``suffix_rate`` (smoothed share of unwanted among labelled rows)."""
    one = rows.groupBy("suffix").agg(F.count("*").alias("n"), F.count("label").alias("known"), F.sum(F.coalesce("label", F.lit(0.0))).alias("bad"))
    return one.select("suffix", F.log1p("n").alias("suffix_rows"), (F.col("bad") / (F.col("known") + prior)).alias("suffix_rate"))


def train(labelled: DataFrame, trees: int = 20, depth: int = 3, seed: int = 7) -> GBTClassificationModel | None:
    """Trees on ``features, label``; classes weigh the same. ``None`` if only one class is there."""
    n = {r["label"]: r["count"] for r in labelled.groupBy("label").count().collect()}
    if len(n) < 2:
        return None
    weighted = labelled.withColumn("weight", F.when(F.col("label") == 1, sum(n.values()) / (2 * n[1.0])).otherwise(sum(n.values()) / (2 * n[0.0])))
    return GBTClassifier(maxIter=trees, maxDepth=depth, seed=seed, weightCol="weight", maxBins=32).fit(weighted)


def judge(urls: DataFrame, label: Column, rules: list[Rule], id_col: str = "page_id", url_col: str = "url", train_rows: int = 200_000, threshold: float = 0.5) -> DataFrame:
    """``id, host, path, rule, verdict, score`` of every row.

    ``label``: 1 unwanted, 0 wanted or null unknown, as an expression over the columns of ``urls``.
    """
    rows = urls.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{url_col}`").alias("url"), label.cast("double").alias("label"))
    parts = split_url(F.col("url"))
    rows = lexical(rows.select("*", *(c.alias(k) for k, c in parts.items())))
    stats = suffix_statistics(rows)
    stats = materialize(stats, "suffixes")
    rows = rows.join(F.broadcast(stats) if stats.count() <= BROADCAST_ROWS else stats, "suffix", "left")
    rows = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(rows)
    known = rows.where("label IS NOT NULL")
    share = min(1.0, train_rows / max(1, known.count()))
    sample = known.where(F.pmod(F.xxhash64("url"), F.lit(1_000_000)) < int(share * 1_000_000)).select("features", "label")
    model = train(materialize(sample, "url-sample"))
    score = F.lit(0.0)
    if model is not None:
        rows, score = model.transform(rows), vector_to_array("probability")[1]
    rule = rule_of(rules, F.col("host"), F.col("path"))
    rows = rows.select("id", "host", "path", F.round(score, 6).alias("score"), rule.alias("r"))
    return rows.select("id", "host", "path", F.col("r.rule").alias("rule"), F.coalesce("r.verdict", F.when(F.col("score") >= threshold, "block").otherwise("allow")).alias("verdict"), "score")
