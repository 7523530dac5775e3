"""Spelling variants: words that differ by one code point, found by search schemes in bidirectional FM-indexes.

The vocabulary is cut twice into ranges of bounded size, once in the order of its words and once in the order of the reversed words. Each range gets an index
over its words with delimiters between them: the Burrows-Wheeler transforms of the text and of its reverse, whose suffix-rank intervals move together,
so that a pattern can grow at either end. If two words differ by one edit, one half of the first is untouched. A word therefore
searches twice: its first half exactly (with the delimiter before it), then to the right across the second half with one error, in the ranges of words that
can start with that half; and its second half exactly, then to the left across the first, in the ranges of reversed words. All words of
a range take each step together. A range that very many words search is copied, and its searches are dealt over the copies.

Words are maximal runs of A-Z, a-z and U+00C0 to U+00FF, lower-cased in A-Z only. A document's run whose CRC-32 of "<doc_id>:<run>" is a multiple of ``every``
loses one code point first (the planted slip that the query asks for); ``every=None`` counts runs as they are.

Defined results: null texts have no words, a null id reads as nothing before the colon. Repeated rows count as often as they stand there. Words below ``min_length`` or
``min_count`` are neither words nor near words. Of equally frequent near words the smallest in code-point order is the form. No
words: an empty result. Other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vacantia.llm.common import keyed, materialize, partitions, ship, slices

#: Runs in Latin-1, where a byte is a code point; what Latin-1 lacks is no part of a run.
RUN = re.compile(rb"[a-z\xc0-\xff]+")
#: Words that a task counts before it hands on what it has; words of a range; searches of a copy of a range; searches that step together.
HELD, RANGE, SEARCHES, STEP = 200_000, 32_768, 131_072, 4096


def counted(docs: DataFrame, min_length: int, every: int | None) -> DataFrame:
    """``word, n`` of ``id`` (text) and ``text``: partial counts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter[bytes] = Counter()

        def held() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array([w.decode("latin-1") for w in total], pa.string()), pa.array(total.values(), pa.int64())], names=["word", "n"])
            total.clear()
            return out
        for b in slices(batches):
            for key, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if not text:
                    continue
                start = zlib.crc32(f"{key or ''}:".encode())
                for w, n in Counter(RUN.findall(text.encode("latin-1", "replace").lower())).items():
                    if len(w) < min_length:
                        continue
                    if every and not (h := zlib.crc32(w if w.isascii() else w.decode("latin-1").encode(), start)) % every:
                        at = h % len(w)
                        w = w[:at] + w[at + 1:]
                        if len(w) < min_length:
                            continue
                    total[w] += n
                if len(total) >= HELD:
                    yield held()
        yield held()

    return docs.mapInArrow(run, "word string, n bigint")


def vocabulary(docs: DataFrame, id_col: str, text_col: str, min_length: int, min_count: int, every: int | None) -> DataFrame:
    rows = keyed(docs, id_col, text_col, "text").select(F.col("id").cast("string").alias("id"), "text")
    return counted(rows, min_length, every).groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)


class Transform:
    """Ranks in the Burrows-Wheeler transform of a cyclic text of symbols: for each block of 64 places and each symbol the number, and the places, of smaller ones."""

    def __init__(self, text: np.ndarray, symbols: int) -> None:
        n = len(text)
        rank, width = text.astype(np.int64), 1
        order = np.argsort(rank, kind="stable")
        while True:  # rotations by their first 1, 2, 4 ... symbols
            key = rank * (n + 1) + np.roll(rank, -width) if width > 1 or n > 1 else rank
            order = np.argsort(key, kind="stable")
            fresh = np.concatenate([[0], np.cumsum(np.diff(key[order]) != 0)])
            rank = np.empty(n, np.int64)
            rank[order] = fresh
            if fresh[-1] == n - 1:
                break
            width *= 2
        self.places = order
        last = np.pad(text[order - 1], (0, 64 - n % 64), constant_values=symbols)
        smaller = last[:, None] < np.arange(symbols + 1)
        blocks = smaller.reshape(-1, 64, symbols + 1)
        counts = blocks.sum(1)
        self.before = np.concatenate([np.zeros((1, symbols + 1), np.int64), np.cumsum(counts, 0)[:-1]])
        self.bits = (blocks.astype(np.uint64) << np.arange(64, dtype=np.uint64)[:, None]).sum(1, dtype=np.uint64)
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=symbols))])

    def all(self, at: np.ndarray) -> np.ndarray:
        """Number of smaller symbols than each symbol before each place."""
        block, mask = at >> 6, (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[block] + np.bitwise_count(self.bits[block] & mask[:, None])

    def one(self, at: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        block, mask = at >> 6, (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[block, symbol] + np.bitwise_count(self.bits[block, symbol] & mask)


class Index:
    """Bidirectional index over distinct words, each after a delimiter (symbol 0), in a circle."""

    def __init__(self, words: list[str]) -> None:
        codes = [np.frombuffer(w.encode("utf-32-le"), np.uint32) for w in words]
        self.letters = np.unique(np.concatenate(codes))
        lengths = np.array([len(c) for c in codes])
        starts = np.cumsum(lengths + 1) - lengths - 1
        text = np.zeros(int((lengths + 1).sum()), np.int64)
        inside = np.ones(len(text), bool)
        inside[starts] = False
        text[inside] = 1 + np.searchsorted(self.letters, np.concatenate(codes))
        self.size, self.symbols = len(text), len(self.letters) + 1
        self.forward, self.backward = Transform(text, self.symbols), Transform(text[::-1], self.symbols)
        self.word_at = np.full(len(text), -1)
        self.word_at[starts] = np.arange(len(words))

    def encoded(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Symbols of the words in a row (-1: in no word of the index), and where each word starts."""
        codes = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
        at = np.minimum(np.searchsorted(self.letters, codes), len(self.letters) - 1)
        return np.where(self.letters[at] == codes, at + 1, -1), np.concatenate([[0], np.cumsum([len(w) for w in words])])

    @staticmethod
    def grow(over: Transform, a: np.ndarray, b: np.ndarray, size: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Interval ``a`` in ``over`` and its partner ``b`` in the other transform after one more symbol at the end where ``over`` grows; size 0 if nothing matches."""
        s = np.maximum(symbol, 0)
        low, high = over.one(a, s), over.one(a + size, s)
        low1, high1 = over.one(a, s + 1), over.one(a + size, s + 1)
        return over.first[s] + low1 - low, b + high - low, np.where(symbol < 0, 0, (high1 - low1) - (high - low))

    def search(self, words: list[str], halves: list[int], left: bool) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (number of the word searched, number of the word found) at exactly one edit behind the first ``halves`` letters of a word.

        ``left``: words are given reversed, and patterns grow to the left in the end.
        """
        exact, wide = (self.backward, self.forward) if left else (self.forward, self.backward)
        text, start = self.encoded(words)
        text = np.append(text, -1)
        length, half = np.diff(start), np.array(halves)
        q = np.arange(len(words))
        a, b, size = np.zeros(len(q), np.int64), np.zeros(len(q), np.int64), np.full(len(q), self.size)
        for step in range(int(half.max(initial=0)) + 1):  # the half from its inner end outwards, then the delimiter
            todo = np.flatnonzero(half[q] >= step)
            place = half[q[todo]] - 1 - step
            symbol = np.where(place >= 0, text[start[q[todo]] + np.maximum(place, 0)], 0)
            a[todo], b[todo], size[todo] = self.grow(exact, a[todo], b[todo], size[todo], symbol)
            alive = size > 0
            q, a, b, size = q[alive], a[alive], b[alive], size[alive]
        # Now the other end: ``a`` belongs to ``wide``. Clean states carry no error, spent ones have made theirs.
        a, b = b, a
        clean, spent = (q, half[q], a, b, size), tuple(np.zeros(0, np.int64) for _ in range(5))
        found_q, found_w = [], []
        while len(clean[0]) or len(spent[0]):
            q, at, a, b, size = spent
            done = at >= length[q]
            symbol = np.where(done, 0, text[np.where(done, 0, start[q] + at)])
            a, b, size = self.grow(wide, a, b, size, symbol)
            alive = size > 0
            end = alive & done
            found_q.append(q[end])
            found_w.append(self.word_at[self.forward.places[(a if left else b)[end]]])
            go = alive & ~done
            new = [(q[go], at[go] + 1, a[go], b[go], size[go])]
            q, at, a, b, size = clean
            inner = at < length[q]
            symbol = np.where(inner, text[np.where(inner, start[q] + at, 0)], -1)
            follows = np.where(at + 1 < length[q], text[np.minimum(start[q] + at + 1, len(text) - 1)], -2)
            skip = inner & (follows != symbol) | inner & (symbol < 0)  # of equal letters the last is left out
            new.append((q[skip], at[skip] + 1, a[skip], b[skip], size[skip]))
            low, high = wide.all(a), wide.all(a + size)
            less = high - low
            sizes = np.diff(less, axis=1)
            sizes[:, 0] = 0  # a delimiter is no letter
            row, letter = np.nonzero(sizes)
            child = (q[row], at[row], wide.first[letter] + low[row, letter + 1] - low[row, letter], b[row] + less[row, letter], sizes[row, letter])
            same = letter == symbol[row]
            clean = tuple(x[same] + (k == 1) for k, x in enumerate(child))
            other, replaced = ~same, ~same & inner[row]
            new.append(tuple(x[other] for x in child))  # inserted; a letter like the next one is inserted behind that
            new.append(tuple(x[replaced] + (k == 1) for k, x in enumerate(child)))
            spent = tuple(np.concatenate(x) for x in zip(*new, strict=True))
        return np.concatenate(found_q), np.concatenate(found_w)


def first_half(word: str, left: bool) -> int:
    """Letters of the half that is matched exactly."""
    return len(word) - len(word) // 2 if left else len(word) // 2


def near_in_range(found: Index, words: list[str], counts: np.ndarray, asked: list[str], left: bool) -> Iterator[tuple[list[str], list[str], np.ndarray]]:
    """Near words of ``asked``, some at a time; to the left only those that a search to the right would not find."""
    for at in range(0, len(asked), STEP):
        some = asked[at:at + STEP]
        q, w = found.search([x[::-1] for x in some] if left else some, [first_half(x, left) for x in some], left)
        one, two = [some[k] for k in q], [words[k] for k in w]
        if left:
            keep = np.array([not v.startswith(u[:len(u) // 2]) for u, v in zip(one, two, strict=True)], bool)
            one, two, w = [u for u, k in zip(one, keep, strict=True) if k], [v for v, k in zip(two, keep, strict=True) if k], w[keep]
        yield one, two, counts[w]


def near_words(words: DataFrame, left: bool) -> DataFrame:
    """``word, near, near_n`` for all ``word, n``: the pairs whose first (``left``: second, and not the first) half agrees."""
    spark = words.sparkSession
    count = max(partitions(spark), -(-words.count() // RANGE))
    ranged = words.withColumn("key", F.reverse("word") if left else F.col("word")).repartitionByRange(count, "key")
    ranged = materialize(ranged.withColumn("range", F.spark_partition_id()), "ranges")
    bounds = ranged.groupBy("range").agg(F.min("key").alias("low"), F.max("key").alias("high")).orderBy("low").collect()  # a row for each RANGE words
    lows, highs, names = [r.low for r in bounds], [r.high for r in bounds], [r["range"] for r in bounds]

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            word, to = [], []
            for w, key in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                half = key[:first_half(w, left)]
                k = bisect_left(highs, half)
                while k < len(lows) and (lows[k] <= half or lows[k].startswith(half)):
                    word.append(w)
                    to.append(names[k])
                    k += 1
            yield pa.RecordBatch.from_arrays([pa.array(word, pa.string()), pa.array(to, pa.int32())], names=["word", "range"])

    asked = materialize(ranged.select("word", "key").mapInArrow(route, "word string, range int"), "searches")
    copies = F.broadcast(asked.groupBy("range").agg(F.ceil(F.count("*") / SEARCHES).cast("int").alias("copies")))  # a row for each range
    asked = asked.join(copies, "range").select("range", F.pmod(F.xxhash64("word"), F.col("copies")).cast("int").alias("copy"), "word", F.lit(None).cast("bigint").alias("n"))
    held = ranged.join(copies, "range").select("range", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("copy"), "word", "n")

    def run(table: pa.Table) -> pa.Table:
        counts = table.column("n").combine_chunks()
        is_word = counts.is_valid()
        own, asks = table.filter(is_word), table.filter(counts.is_null()).column("word").to_pylist()
        if not own.num_rows or not asks:
            return pa.table({"word": pa.array([], pa.string()), "near": pa.array([], pa.string()), "near_n": pa.array([], pa.int64())})
        names, n = own.column("word").to_pylist(), own.column("n").to_numpy()
        parts = [pa.table({"word": pa.array(u, pa.string()), "near": pa.array(v, pa.string()), "near_n": pa.array(c, pa.int64())}) for u, v, c in near_in_range(Index(names), names, n, asks, left)]
        return pa.concat_tables(parts)

    return held.unionByName(asked).groupBy("range", "copy").applyInArrow(run, "word string, near string, near_n bigint")


def roots(forms: DataFrame) -> DataFrame:
    """``word, root`` of ``word, form``: the form's form, and so on, by doubling steps; counts at least double from form to form, so this ends."""
    now = materialize(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("further"))
        now = materialize(now.join(ahead, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "roots")
        moved = now.where("moved").limit(1).count()
        now = now.select("word", "root")
        if not moved:
            return now


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = 5, min_count: int = 3, every: int | None = 97, ratio: int = 2) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` of every word."""
    spark: SparkSession = docs.sparkSession
    ship(spark)
    words = materialize(vocabulary(docs, id_col, text_col, min_length, min_count, every), "vocabulary")
    if not words.limit(1).count():
        return words.select("word", F.col("word").alias("form"), F.col("word").alias("root"), "n", F.col("n").alias("n_near"), F.col("n").alias("form_n"))
    pairs = near_words(words, left=False).unionByName(near_words(words, left=True))
    best = pairs.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("minus"), "near")).alias("best"))
    form = F.when(-F.col("best.minus") >= ratio * F.col("n"), F.struct(F.col("best.near").alias("word"), (-F.col("best.minus")).alias("n")))
    known = words.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"), form.alias("form"))
    known = materialize(known.select("word", F.col("form.word").alias("form"), "n", "n_near", F.col("form.n").alias("form_n")), "forms")
    found = roots(known.where("form IS NOT NULL").select("word", "form"))
    return known.join(found, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
