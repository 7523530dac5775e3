"""Benchmark decontamination by pigeonhole edit matching.

An item of ``m`` letters may differ from a passage by ``k = rate * m`` edits. Cut into ``k + 1`` pieces, one
piece at least must then stand in the passage unchanged. An automaton over all pieces finds these hits in one pass of
each text; around them Myers' bit-parallel distance decides. No passage within the budget is lost.

Letters are compared in lower case and white space as one space, in items and texts alike. An item's pieces have
``min_piece`` letters at least, so a short item's budget is smaller. Pieces pair off: a hit counts if the partner is near with one edit at most; the odd last piece of
an even budget has no partner and counts by itself. An item with no letter but white space is ignored.

The items are a query set against all texts: they are taken in blocks of about ``block_bytes``, each broadcast, so that the memory
of a task does not depend on the number of items.

Defined results: a row for each text and item that match, with the best passage (the leftmost of equals). Null
and empty texts match nothing. Repeated rows of a text give repeated rows, a repeated item (same id and
text) counts once, items with equal texts are each reported. Empty tables give an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vacantia.llm.common import keyed, ship, slices

FOUND = "item_at int, distance int, match_start int, match_end int"


def normal(text: str) -> str:
    return " ".join(text.lower().split())


def pieces(item: str, rate: float, min_piece: int) -> tuple[int, list[tuple[int, str]]]:
    """Error budget and the (offset, piece) it asks for."""
    n = len(item)
    k = max(0, min(int(rate * n), n // min_piece - 1))
    cuts = [n * i // (k + 1) for i in range(k + 2)]
    return k, [(a, item[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


def letter_masks(pattern: str) -> dict[str, int]:
    masks: dict[str, int] = defaultdict(int)
    for i, c in enumerate(pattern):
        masks[c] |= 1 << i
    return masks


def myers(masks: dict[str, int], m: int, text: str, anchored: bool = False) -> Iterator[int]:
    """Edit distance of the pattern to the best passage that ends at each letter of ``text`` (``anchored``: to the whole prefix)."""
    full, top = (1 << m) - 1, 1 << m - 1
    plus, minus, score = full, 0, m
    carry = 1 if anchored else 0
    for c in text:
        eq = masks.get(c, 0)
        xv = eq | minus
        xh = (((eq & plus) + plus) ^ plus) | eq
        up = minus | full & ~(xh | plus)
        down = plus & xh
        if up & top:
            score += 1
        elif down & top:
            score -= 1
        up = up << 1 & full | carry
        down = down << 1 & full
        plus = down | full & ~(xv | up)
        minus = up & xv
        yield score


class Matcher:
    def __init__(self, items: list[str], rate: float, min_piece: int) -> None:
        self.items = [normal(t) for t in items]
        self.budget, by = [], defaultdict(list)
        for i, t in enumerate(self.items):
            k, parts = pieces(t, rate, min_piece)
            self.budget.append(k)
            for n, (at, part) in enumerate(parts if t else []):
                partner = parts[n ^ 1][1] if n ^ 1 < len(parts) else ""  # near to any hit
                half = len(partner) // 2
                by[part].append((i, at, n % 2 == 0, partner[:half], partner[half:]))
        self.masks = [letter_masks(t) for t in self.items]
        self.automaton = ahocorasick.Automaton()
        for part, places in by.items():
            self.automaton.add_word(part, (len(part), places))
        if by:
            self.automaton.make_automaton()

    def windows(self, text: str) -> dict[int, list[list[int]]]:
        """By item, the stretches of the text that can hold it; overlapping ones are one."""
        found: dict[int, set[int]] = defaultdict(set)
        for end, (n, places) in self.automaton.iter(text):
            start, end = end - n + 1, end + 1
            for i, at, first, a, b in places:
                na, nb = len(a), len(b)
                if first:
                    near = text.startswith(a, end) or text.find(b, max(0, end + na - 1), end + na + nb + 1) >= 0
                else:
                    near = text.endswith(b, 0, start) or text.find(a, max(0, start - na - nb - 1), max(0, start - nb + 1)) >= 0
                if near:
                    found[i].add(start - at)
        out = {}
        for i, starts in found.items():
            k, m, merged = self.budget[i], len(self.items[i]), []
            for s in sorted(starts):
                a, b = max(0, s - k), min(len(text), s + m + k)
                if merged and a <= merged[-1][1]:
                    merged[-1][1] = max(b, merged[-1][1])
                else:
                    merged.append([a, b])
            out[i] = merged
        return out

    def matches(self, text: str | None) -> list[tuple[int, int, int, int]]:
        """(item, distance, start, end) of the best passage of each item within its budget, in the normalised text."""
        if not text or not len(self.automaton):
            return []
        text, out = normal(text), []
        for i, stretches in self.windows(text).items():
            m, best = len(self.items[i]), (self.budget[i] + 1, 0)
            for a, b in stretches:
                for at, score in enumerate(myers(self.masks[i], m, text[a:b]), a + 1):
                    if score < best[0]:
                        best = score, at
            distance, end = best
            if distance <= self.budget[i]:
                back = myers(letter_masks(self.items[i][::-1]), m, text[max(0, end - m - distance):end][::-1], anchored=True)
                length = next((n for n, score in enumerate(back, 1) if score == distance), 0)
                out.append((i, distance, end - length, end))
        return out


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
                 rate: float = 0.1, min_piece: int = 8, block_bytes: int = 4 << 20) -> DataFrame:
    """``id, item_id, distance, budget, match_start, match_end`` of every text and item that match."""
    spark = docs.sparkSession
    ship(spark)
    rows = keyed(docs, id_col, text_col, "text")
    items = benchmark.select(F.col(f"`{item_col}`").alias("item_id"), F.col(f"`{item_text_col}`").alias("item")).where("item IS NOT NULL").distinct()
    kind = items.schema["item_id"].dataType
    total = items.agg(F.coalesce(F.sum(F.octet_length("item") + 16), F.lit(0))).first()[0]
    blocks = max(1, -(-total // block_bytes))
    out = None
    for k in range(blocks):
        found = _search(rows, items.where(F.pmod(F.xxhash64("item_id", "item"), F.lit(blocks)) == k), kind, rate, min_piece)
        out = found if out is None else out.unionByName(found)
    return out


def _search(rows: DataFrame, block: DataFrame, kind, rate: float, min_piece: int) -> DataFrame:
    spark = rows.sparkSession
    items = sorted((tuple(r) for r in block.collect()), key=lambda r: (r[0] is not None, r[0], r[1]))
    shared = spark.sparkContext.broadcast([t for _, t in items])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = None
        for b in slices(batches):
            if matcher is None:
                matcher = Matcher(shared.value, rate, min_piece)
            take, found = [], []
            for k, text in enumerate(b.column(1).to_pylist()):
                for m in matcher.matches(text):
                    take.append(k)
                    found.append((*m, matcher.budget[m[0]]))
            columns = zip(*found, strict=True) if found else [[]] * 5
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(take, pa.int64())), *(pa.array(c, pa.int32()) for c in columns)], names=["id", "item_at", "distance", "match_start", "match_end", "budget"])

    hits = rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, {FOUND}, budget int")
    names = spark.createDataFrame([(n, i[0]) for n, i in enumerate(items)], f"item_at int, item_id {kind.simpleString()}")
    return hits.join(F.broadcast(names), "item_at").select("id", "item_id", "distance", "budget", "match_start", "match_end")
