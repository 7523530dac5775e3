"""Exact substring joins without comparing every pair."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..util import first_per_key, materialize

GRAM = 3


def grams(c: Column, q: int = GRAM) -> Column:
    """Distinct q-grams of a text; the look-ahead walks the text once."""
    return F.array_distinct(F.regexp_extract_all(c, F.lit(f"(?s)(?=(.{{{q}}}))"), F.lit(1)))


#: Characters that a joint has before and behind its middle one, widest joints first.
JOINTS = ((8, 8), (4, 4), (2, 2))


def joints(c: Column, before: int = 2, behind: int = 2) -> Column:
    """Distinct strings with one character in the middle that is no ASCII letter or digit: far fewer and rarer than all q-grams."""
    return F.array_distinct(F.regexp_extract_all(c, F.lit(f"(?s)(?=(.{{{before}}}[^A-Za-z0-9].{{{behind}}}))"), F.lit(1)))


def contains_pairs(needles: DataFrame, texts: DataFrame, needle: str, text: str, text_id: str) -> DataFrame:
    """All (needle, text id) with the needle inside the text.

    A needle is looked up by its rarest gram, so only texts that hold this gram are
    verified. Needles of several words are known by what stands around a word's end, as much of it as they
    have, so that numbered names with a common stem do not meet each other's texts; the others by
    q-grams; those of 1 or 2 characters use grams of their own length. ``needles`` must
    hold distinct non-empty values and ``texts`` one row per ``text_id``.
    """
    n = needles.select(F.col(needle).alias("_needle"))
    size = F.char_length("_needle")
    widest = F.lit(None).cast("int")
    for i, shape in reversed(list(enumerate(JOINTS))):
        widest = F.when(F.size(joints(F.col("_needle"), *shape)) > 0, i).otherwise(widest)
    n = n.withColumn("_shape", widest)
    jointed = F.col("_shape").isNotNull()
    # Grams of a kind are only cut when some needle needs them: one row decides.
    shapes, shortest = n.agg(F.collect_set("_shape"), F.min(F.when(~jointed, size))).first()
    sizes = range(min(shortest or GRAM, GRAM), GRAM + 1) if shortest is not None or not shapes else ()
    own = F.lit(None).cast("array<string>")
    for q in sizes:
        own = F.when(size >= GRAM if q == GRAM else size == q, grams(F.col("_needle"), q)).otherwise(own)
    for i in shapes:
        own = F.when(F.col("_shape") == i, joints(F.col("_needle"), *JOINTS[i])).otherwise(own)
    wanted = n.select("_needle", F.explode(own).alias("_gram"))
    all_grams = F.concat(*[joints(F.col(text), *JOINTS[i]) for i in shapes], *[grams(F.col(text), q) for q in sizes])
    # Counted and looked up: texts are cut once, and what some needle wants is written.
    have = materialize(texts.select(text_id, F.explode(all_grams).alias("_gram"))
                       .join(wanted.select("_gram").distinct(), "_gram", "left_semi"), "grams")
    freq = have.groupBy("_gram").agg(F.count(F.lit(1)).alias("_df"))
    # A gram no text has rules its needle out; else the rarest one is the key.
    key = first_per_key(wanted.join(freq, "_gram", "left").fillna({"_df": 0}), ["_needle"], [F.col("_df"), F.col("_gram")])
    hits = have.join(key.filter("_df > 0").select("_needle", "_gram"), "_gram").select(text_id, "_needle")
    found = hits.join(texts.select(text_id, F.col(text).alias("_text")), text_id).filter(F.contains("_text", "_needle"))
    return found.select(F.col("_needle").alias(needle), text_id)
