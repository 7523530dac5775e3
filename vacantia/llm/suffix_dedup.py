"""Removal of repeated passages by longest previous factors.

A byte goes if it is covered by a string of ``length`` bytes that also starts elsewhere (``keep="none"``), or elsewhere earlier
(``keep="first"``: later copies go, the first stays). Earlier is meant in the order of ids, then of places in a text.

A window (a string of ``length`` bytes) can only have equals where the least hash of its shorter strings is the same. So every
text is cut into runs of windows with the same such anchor, and runs are brought together by anchor:

* Runs with equal bytes need no comparison: all their windows have equals, or all but the first run's.
* Different runs of one anchor overlap in part. Their bytes go to bins of bounded size; each bin gets its suffix array (by doubling), in which
  equal windows stand side by side. In that order, equal ones sorted by place, the previous smaller position is the neighbour before and the
  next smaller one, seen from the other end, the neighbour behind: they hold the longest previous and next factor of the window if that
  is ``length`` bytes or more.
* An anchor whose runs alone would overfill a bin (a passage that very many texts cut differently) is spread instead by the windows' own 128-bit
  hashes, counted with partial sums; so no anchor meets in one task.

Equal texts are one text with a count. Hashes only bring candidates together in bins, where bytes are compared; equal runs and spread windows are taken as equal by 128 bits.

Defined results: null text counts as empty; a text shorter than ``length`` keeps all. Repeated rows are copies like others: with ``keep="first"``
all rows of the smallest id among equal texts count as first (nulls before others). Matches never cross texts. An empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from vacantia.llm.common import keyed, materialize, partitions, ship, slices
from vacantia.llm.dart_minhash import mix

#: Bytes of text hashed at once; bytes of runs in a bin, and of one anchor in a bin at most.
CHUNK, BIN, ANCHOR_MOST = 1 << 20, 1 << 20, 1 << 19
#: Bytes of what is known of texts that are broadcast to them; more is joined by shuffle.
BROADCAST_BYTES = 48 << 20
_P = np.uint64(0x9E3779B97F4A7C15)
_BYTES = mix(np.arange(1, 257, dtype=np.uint64) * _P)


def hashes(data: np.ndarray, lengths: list[int]) -> dict[int, np.ndarray]:
    """Hash of the string of each length (powers of two) that starts at each place; strings that pass the end are not hashed."""
    h, n, out, power = _BYTES[data], 1, {}, _P
    while n < max(lengths):
        h = h[:-n] * power + h[n:]
        power = np.uint64(int(power) * int(power) % (1 << 64))
        n *= 2
        if n in (8, 64):  # not a plain polynomial, whose equal hashes are known
            h = h ^ h >> np.uint64(29)
            h *= np.uint64(0xBF58476D1CE4E5B9)
        if n in lengths:
            out[n] = h
    return out


def lengths_for(length: int) -> tuple[int, int]:
    """Length of an anchor's string, and the largest power of two in a window."""
    whole = 1 << length.bit_length() - 1
    return max(1, whole // 2), whole


def window_hashes(h: np.ndarray, whole: int, length: int, at: np.ndarray) -> np.ndarray:
    """Hash of the windows at some places: of their first and last ``whole`` bytes."""
    return mix(h[at] * _P + h[at + length - whole])


def runs_of(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Runs of windows with one anchor in texts at ``[starts, ends)``: first window, last window, anchor hash, hash of the run."""
    short, whole = lengths_for(length)
    h = hashes(data, [short, whole])
    key = mix(h[short])
    bits = np.uint64(max(1, len(data)).bit_length())
    places = np.arange(len(key), dtype=np.uint64)
    least, n, reach = (key >> bits << bits) | places, 1, length - short + 1
    while 2 * n <= reach:
        least = np.minimum(least[:-n], least[n:])
        n *= 2
    if reach > n:
        least = np.minimum(least[:n - reach], least[reach - n:])
    count = np.maximum(0, ends - starts - length + 1)
    of = np.repeat(np.arange(len(starts)), count)
    at = np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(starts, count)
    anchor = (least[at] & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    new = np.ones(len(at), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (of[1:] != of[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(at))[:len(first)] - 1
    a, b = at[first], at[last]
    run = mix(window_hashes(h[whole], whole, length, a) * _P + window_hashes(h[whole], whole, length, b) + (b - a).astype(np.uint64))
    return of[first], a, b, key[anchor[first]].view(np.int64), run.view(np.int64)


def chunks(texts: list[bytes], length: int, most: int = CHUNK) -> Iterator[list[tuple[int, int, bytes]]]:
    """Groups of (row, place in the text, bytes); a long text is cut into parts that overlap, so that each window is whole in one."""
    group, held = [], 0
    for row, text in enumerate(texts):
        for at in range(0, max(1, len(text) - length + 1), most):
            part = text[at:at + most + length - 1]
            if len(part) >= length:
                if held + len(part) > most and group:
                    yield group
                    group, held = [], 0
                group.append((row, at, part))
                held += len(part)
    if group:
        yield group


def anchored(rows: DataFrame, length: int) -> DataFrame:
    """``id, digest, runs`` of ``id, digest, text``: the runs of each text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, nbytes=CHUNK):
            texts = [t.encode() for t in b.column(2).to_pylist()]
            found = [[] for _ in range(5)]
            for group in chunks(texts, length):
                size = np.array([len(p) for _, _, p in group])
                ends = np.cumsum(size)
                of, a, z, anchor, run = runs_of(np.frombuffer(b"".join([p for _, _, p in group]), np.uint8), ends - size, ends, length)
                shift = np.array([at for _, at, _ in group]) - (ends - size)
                for k, x in enumerate((np.array([row for row, _, _ in group])[of], a + shift[of], z - a + 1, anchor, run)):
                    found[k].append(x)
            of, a, n, anchor, run = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in found)
            offsets = np.searchsorted(of, np.arange(b.num_rows + 1)).astype(np.int32)
            part = lambda x, kind: pa.ListArray.from_arrays(pa.array(offsets), pa.array(x, kind))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), part(a, pa.int32()), part(n, pa.int32()), part(anchor, pa.int64()), part(run, pa.int64())], names=["id", "digest", "at", "n", "anchor", "run"])

    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, digest binary, at array<int>, n array<int>, anchor array<bigint>, run array<bigint>")


def looked_up(rows: DataFrame, wanted: DataFrame, listed: str, how: str) -> DataFrame:
    """Join texts with what is known by ``digest``; texts stay in place if that is small, its array ``listed`` counted by length."""
    size = wanted.agg(F.sum(F.lit(100) + 60 * F.greatest(F.lit(0), F.size(listed)))).first()[0] or 0
    return rows.join(F.broadcast(wanted) if size <= BROADCAST_BYTES else wanted, "digest", how)


def cut_out(rows: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """``node, id, anchor, at, n, total, crowded, bytes`` of the wanted runs, each a struct in ``runs`` of ``digest, node, first, runs``."""
    # Only one of equal texts is read: that of the first id.
    picked = looked_up(rows, wanted, "runs", "inner").where(F.col("id").eqNullSafe(F.col("first"))).select("node", "id", "text", "runs")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, nbytes=CHUNK):
            out, ids = [], []
            for k, (node, text, runs) in enumerate(zip(b.column(0).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)):
                data = text.encode()
                for r in runs:
                    out.append((node, r["anchor"], r["at"], r["n"], r["total"], r["crowded"], data[r["at"]:r["at"] + r["n"] - 1 + length]))
                    ids.append(k)
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.bool_(), pa.binary())
            columns = [pa.array(x, t) for x, t in zip(zip(*out, strict=True) if out else [[]] * 7, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(1).take(pa.array(ids, pa.int64())), *columns], names=["id", "node", "anchor", "at", "n", "total", "crowded", "bytes"])

    kind = f"id {rows.schema['id'].dataType.simpleString()}, node bigint, anchor bigint, at int, n int, total bigint, crowded boolean, bytes binary"
    return picked.mapInArrow(run, kind).dropDuplicates(["node", "at"])  # a repeated row gives its runs twice


def window_ranks(text: np.ndarray, length: int) -> np.ndarray:
    """Rank of the first ``length`` letters of each suffix, by doubling from 7 letters (of 9 bits each) in one number."""
    padded = np.concatenate([text, np.zeros(length + 7, np.int64)])
    n, reach = len(text) + length, min(7, length)
    key = np.zeros(n, np.int64)
    for j in range(reach):
        key = key << 9 | padded[j:j + n]
    while True:
        rank = np.unique(key, return_inverse=True)[1]
        if reach == length:
            return rank[:len(text)]
        step = min(reach, length - reach)
        behind = np.zeros(n, np.int64)
        behind[:n - step] = rank[step:]
        key = rank * n + behind
        reach += step


def factors(runs: list[bytes], counts: list[int], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For the windows of the runs, in their order: the run, and whether the window has an equal one before and after it."""
    size = np.array([len(r) for r in runs])
    text = np.frombuffer(b"".join([r + b"\0" for r in runs]), np.uint8).astype(np.int64) + 1
    starts = np.cumsum(size + 1) - size - 1
    text[starts + size] = 0  # no letter: windows do not pass it
    n = np.array(counts)
    of = np.repeat(np.arange(len(runs)), n)
    at = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n) + starts[of]
    rank = window_ranks(text, length)[at]
    order = np.argsort(rank, kind="stable")  # suffix order, equal windows by place
    same = rank[order[1:]] == rank[order[:-1]]
    before, after = np.zeros(len(at), bool), np.zeros(len(at), bool)
    before[order[1:]], after[order[:-1]] = same, same
    return of, before, after


def spans_of_flags(of: np.ndarray, at: np.ndarray, flags: np.ndarray, length: int) -> list[tuple[int, int, int]]:
    """(run, start, end) of the bytes that flagged windows cover, windows side by side as one."""
    k = np.flatnonzero(flags)
    if not len(k):
        return []
    new = np.ones(len(k), bool)
    new[1:] = (np.diff(k) > 1) | (of[k[1:]] != of[k[:-1]])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(k)) - 1
    return list(zip(of[k[first]].tolist(), at[k[first]].tolist(), (at[k[last]] + length).tolist(), strict=True))


def binned(runs: DataFrame, bins: int, length: int, first_stays: bool) -> DataFrame:
    """``node, start, end`` of the bytes to remove among the runs of ``cut_out`` whose anchors are not crowded."""
    def run(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: (r["id"] is not None, r["id"], r["node"], r["at"]))
        counts = [r["n"] for r in rows]
        of, before, after = factors([r["bytes"] for r in rows], counts, length)
        flags = before if first_stays else before | after
        n = np.array(counts)
        at = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n) + np.array([r["at"] for r in rows])[of]
        found = [(rows[k]["node"], a, z) for k, a, z in spans_of_flags(of, at, flags, length)]
        return pa.table({"node": pa.array([x[0] for x in found], pa.int64()), "start": pa.array([x[1] for x in found], pa.int32()), "end": pa.array([x[2] for x in found], pa.int32())})

    return runs.withColumn("bin", F.pmod("anchor", F.lit(bins))).groupBy("bin").applyInArrow(run, "node bigint, start int, end int")


def spread(runs: DataFrame, length: int, first_stays: bool) -> DataFrame:
    """As ``binned``, by counting the windows' hashes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = lengths_for(length)[1]
        for b in slices(batches, rows=64):
            for k, data in enumerate(b.column("bytes").to_pylist()):
                h = hashes(np.frombuffer(data, np.uint8), [whole])[whole]
                n = b.column("n")[k].as_py()
                at = b.column("at")[k].as_py() + np.arange(n, dtype=np.int32)
                take = pa.array(np.full(n, k))
                yield pa.RecordBatch.from_arrays([b.column("id").take(take), b.column("node").take(take), b.column("anchor").take(take), pa.array(at, pa.int32()), pa.array(window_hashes(h, whole, length, np.arange(n)).view(np.int64))], names=["id", "node", "anchor", "at", "window"])

    windows = materialize(runs.mapInArrow(run, f"id {runs.schema['id'].dataType.simpleString()}, node bigint, anchor bigint, at int, window bigint"), "windows")
    place = F.struct("id", "node", "at")
    seen = windows.groupBy("anchor", "window").agg(F.count("*").alias("n"), F.min(place).alias("first")).where("n > 1")
    found = windows.join(seen, ["anchor", "window"])
    if first_stays:
        found = found.where(~place.eqNullSafe(F.col("first")))
    return found.select("node", F.col("at").alias("start"), (F.col("at") + length).alias("end"))


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, z in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(z, out[-1][1])
        else:
            out.append([a, z])
    return [(a, z) for a, z in out]


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 400, keep: str = "none", carry: bool = False) -> DataFrame:
    """``id, n_bytes, spans`` (removed stretches), ``kept`` (remaining bytes) of every row.

    ``carry``: also ``row``, the row as it was given, and ``left``, the remaining bytes as text without letters cut in two (null for null).
    """
    if keep not in ("none", "first") or length < 16:
        raise ValueError("keep is 'none' or 'first', length at least 16")
    spark = docs.sparkSession
    ship(spark)
    stays = keep == "first"
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    rest = [F.struct(*(F.col(f"`{c}`") for c in docs.columns if c != text_col), F.col(f"`{text_col}`").isNull().alias("__null")).alias("row")] if carry else []
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), text.alias("text"), F.unhex(F.md5(text)).alias("digest"), *rest)
    texts = anchored(rows.where(F.octet_length("text") >= length).select("id", "digest", "text"), length)
    nodes = texts.groupBy("digest").agg(F.min("id").alias("id"), F.max(F.col("id").isNull()).alias("nameless"), F.count("*").alias("copies"), *(F.first(c).alias(c) for c in ("at", "n", "anchor", "run")))
    nodes = materialize(nodes.withColumn("id", F.when(F.col("nameless"), F.lit(None)).otherwise(F.col("id"))).drop("nameless").withColumn("node", F.monotonically_increasing_id()), "texts")

    runs = nodes.select("id", "node", "copies", F.explode(F.arrays_zip("at", "n", "anchor", "run")).alias("r")).select("id", "node", "copies", "r.*")
    shared = runs.groupBy("anchor").agg(F.sum("copies").alias("c"), F.min("run").alias("a"), F.max("run").alias("b")).where("c > 1").select("anchor", (F.col("a") != F.col("b")).alias("mixed"))
    met = materialize(runs.join(shared, "anchor"), "runs")
    place = F.struct("id", "node", "at")
    kinds = materialize(met.groupBy("anchor", "run").agg(F.sum("copies").alias("total"), F.first("mixed").alias("mixed"), F.min(place).alias("first"), F.first("n").alias("n")), "kinds")

    # Equal runs.
    equal = met.select("anchor", "run", "id", "node", "at").join(kinds.where("total > 1").select("anchor", "run", "first", "n"), ["anchor", "run"])
    if stays:
        equal = equal.where(~place.eqNullSafe(F.col("first")))
    spans = equal.select("node", F.col("at").alias("start"), (F.col("at") + F.col("n") - 1 + length).alias("end"))

    # Different runs of one anchor.
    mixed = kinds.where("mixed").select("anchor", "total", "n", F.col("first.node").alias("node"), F.col("first.at").alias("at"))
    weight = mixed.groupBy("anchor").agg(F.sum(F.col("n") + length).alias("weight"))
    crowded = (F.col("weight") > ANCHOR_MOST).alias("crowded")
    wanted = mixed.join(weight, "anchor").groupBy("node").agg(F.collect_list(F.struct("anchor", "at", "n", "total", crowded)).alias("runs"))  # of one text
    wanted = materialize(wanted.join(nodes.select("node", "digest", F.col("id").alias("first")), "node"), "wanted")
    cut = materialize(cut_out(rows, wanted, length), "cut")
    size = cut.where("NOT crowded").agg(F.coalesce(F.sum(F.octet_length("bytes")), F.lit(0))).first()[0]
    spans = spans.unionByName(binned(cut.where("NOT crowded"), max(partitions(spark), -(-size // BIN)), length, stays))
    spans = spans.unionByName(spread(cut.where("crowded"), length, stays))

    # Spans of a text that touch become one.
    before = Window.partitionBy("node").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    island = F.count_if(F.col("new")).over(Window.partitionBy("node").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    spans = spans.distinct().withColumn("new", F.coalesce(F.col("start") > F.max("end").over(before), F.lit(True))).withColumn("island", island)
    spans = spans.groupBy("node", "island").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    spans = spans.groupBy("node").agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    found = nodes.select("node", "digest", F.col("id").alias("first"), "copies").join(spans, "node", "left" if stays else "inner")
    found = materialize(found.where("spans IS NOT NULL OR copies > 1").select("digest", "first", "copies", "spans"), "spans")
    joined = looked_up(rows, found, "spans", "left")
    later = F.coalesce((F.col("copies") > 1) & ~F.col("id").eqNullSafe(F.col("first")), F.lit(False)) if stays else F.lit(False)
    whole = F.array(F.struct(F.lit(0).alias("start"), F.octet_length("text").alias("end")))
    return _without(joined.select("id", "text", F.when(later, whole).otherwise(F.col("spans")).alias("spans"), *(["row"] if carry else [])))


def _without(rows: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            sizes, spans, kept = [], [], []
            for text, found in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                data = text.encode()
                gone = merged([(s["start"], s["end"]) for s in found or ()])
                at, parts = 0, []
                for a, z in gone:
                    parts.append(data[at:a])
                    at = z
                sizes.append(len(data))
                spans.append([{"start": a, "end": z} for a, z in gone])
                kept.append(b"".join([*parts, data[at:]]) if gone else data)
            kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
            more = [b.column(3), pa.array([k.decode("utf-8", "ignore") for k in kept], pa.string())] if carry else []
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes, pa.int64()), pa.array(spans, kind), pa.array(kept, pa.binary()), *more], names=names)

    carry = "row" in rows.columns
    names = ["id", "n_bytes", "spans", "kept", *(["row", "left"] if carry else [])]
    kind = [rows.schema["id"], *StructType.fromDDL("n_bytes bigint, spans array<struct<start:int,end:int>>, kept binary").fields]
    return rows.mapInArrow(run, StructType([*kind, rows.schema["row"], *StructType.fromDDL("left string").fields] if carry else kind))
