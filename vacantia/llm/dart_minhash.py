"""Near-duplicate documents by DartMinHash.

A document is a weighted set of shingles of five words. Each element throws darts by a Poisson process whose randomness comes
from the element's hash alone: a dart has a place in the element's weight, a rank and a coordinate. Of the darts that fall below an element's
weight, each coordinate keeps the one of least rank; two sets keep the same dart with the probability of their weighted Jaccard
similarity. Ranks are only thrown up to a limit at which all coordinates are likely filled (and further where one
is not), so the cost grows with the size of the set plus the number of coordinates, not with their product.

Documents with equal words are one node. Nodes that agree in a whole band of coordinates are candidates. Within a bucket no pairs
are listed: every node is compared with the bucket's most widely connected node, then, where that left different components,
with its neighbours in the order of the following bands' keys, which puts the most similar nodes side by side. A bucket of more than
``PART`` nodes is parted by the following band's key (by a salt where that does not part it). Buckets of up to nine nodes are so compared completely;
these candidates are first judged by their signatures (far below the threshold: dropped), then by the exact similarity of their shingles.
In larger ones that still hold different components, every node outside the largest one is then compared with all nodes of other components by exact similarity, in blocks
of bounded size that yield only links between components (``forest``). So each pair that shares a band is compared or joined already. Links make components; a
document's class is the smallest id of its component.

``weighted``: a shingle weighs as often as it stands in the text, and the similarity is the weighted one (smaller counts over larger counts); else each weighs one.

Defined results: words are split at white space and compared in lower case. A text with fewer than five words is one shingle of all its words;
null texts and texts without a word are alone, each row its own class. Repeated rows and ids have the class of their text; a null id
counts only if a class has no other. An empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vacantia.llm.common import Memo, components, keyed, materialize, ship, slices
from vacantia.llm.forest import open_blocks, settled

COORDINATES, BANDS = 96, 24
ROWS = COORDINATES // BANDS
#: Comparisons of a node with those before it in a bucket, and in one that this does not cover; nodes of a part.
NEIGHBOURS, FEW, PART = 8, 4, 128
#: Nodes whose sets are fetched by broadcasting their digests; more are joined by shuffle.
BROADCAST_ROWS = 300_000
_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))


def mix(x: np.ndarray) -> np.ndarray:
    """A well-spread 64-bit number from another."""
    x = (x ^ x >> np.uint64(30)) * _B
    x = (x ^ x >> np.uint64(27)) * _C
    return x ^ x >> np.uint64(31)


def uniform(x: np.ndarray) -> np.ndarray:
    """In (0, 1]."""
    return ((x >> np.uint64(11)).astype(np.float64) + 1) / 2.0**53


def word_hashes(size: int = 50_000) -> Memo:
    return Memo(xxhash.xxh3_64_intdigest, size)


def all_shingles(words: list[str], hashed: Memo, n: int = 5) -> np.ndarray:
    """Hashes of all runs of ``n`` words, in order; of fewer words that of all of them."""
    w = np.fromiter(map(hashed.__getitem__, words), np.uint64, len(words))
    if not len(w):
        return w
    n = min(n, len(w))
    h = np.zeros(len(w) - n + 1, np.uint64)
    for j in range(n):
        h = mix(h + w[j:len(w) - n + 1 + j] + _A)
    return h


def shingles(words: list[str], hashed: Memo, n: int = 5) -> np.ndarray:
    """Sorted distinct hashes of all runs of ``n`` words."""
    return np.unique(all_shingles(words, hashed, n))


def unrolled(elements: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """A set in which each element stands as often as it weighs, told apart by its number: overlaps are sums of smaller counts."""
    number = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    out = np.repeat(elements, counts)
    return np.unique(np.where(number > 0, mix(out + number.astype(np.uint64) * _B), out))


def throw(elements: np.ndarray, weights: np.ndarray, of: np.ndarray, limit: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Least rank and dart of each set's coordinates (sets x k), from all darts of rank below the set's limit; an unfilled one has rank infinity.

    ``elements, weights, of``: hash, weight and set of each element. A weight above 1 takes one unit cell after another.
    """
    cells = np.maximum(1, np.ceil(weights)).astype(np.int64)
    at = np.repeat(np.arange(len(elements)), cells)
    cell = np.arange(len(at)) - np.repeat(np.cumsum(cells) - cells, cells)
    state = mix(elements[at] + cell.astype(np.uint64) * _C)
    room, of = weights[at] - cell, of[at]
    rank = np.zeros(len(at))
    best, dart = np.full(len(limit) * k, np.inf), np.zeros(len(limit) * k, np.uint64)
    while len(state):
        state = mix(state + _A)
        rank = rank - np.log(uniform(state))
        live = rank < limit[of]
        state, rank, of, room = state[live], rank[live], of[live], room[live]
        name = mix(state ^ _B)
        hit = uniform(mix(name + _C)) <= room
        place = of[hit] * k + (name[hit] % np.uint64(k)).astype(np.int64)
        got, names = rank[hit], name[hit]
        before = best[place]
        np.minimum.at(best, place, got)
        won = (best[place] == got) & (got < before)
        dart[place[won]] = names[won]
    return best.reshape(-1, k), dart.reshape(-1, k)


def signatures(sets: list[np.ndarray], weights: list[np.ndarray] | None = None, k: int = COORDINATES) -> np.ndarray:
    """Darts (sets x k) of non-empty sets of positive weights."""
    weights = weights or [np.ones(len(s)) for s in sets]
    out = np.zeros((len(sets), k), np.uint64)
    todo, factor = np.arange(len(sets)), 1.0
    while len(todo):
        elements, w = np.concatenate([sets[i] for i in todo]), np.concatenate([weights[i] for i in todo])
        of = np.repeat(np.arange(len(todo)), [len(sets[i]) for i in todo])
        total = np.bincount(of, w, len(todo))
        best, dart = throw(elements, w, of, factor * (k * np.log(k) + 2 * k) / total, k)
        full = np.isfinite(best).all(1)
        out[todo[full]] = dart[full]
        todo, factor = todo[~full], 2 * factor
    return out


def band_keys(darts: np.ndarray, bands: int = BANDS) -> np.ndarray:
    parts = darts.reshape(len(darts), bands, -1)
    h = np.broadcast_to(np.arange(bands, dtype=np.uint64) * _A, parts.shape[:2])
    for j in range(parts.shape[2]):
        h = mix(h + parts[:, :, j])
    return h.view(np.int64)


def words_of(text: str | None) -> list[str]:
    return text.lower().split() if text else []


def digest_of(words: list[str]) -> bytes:
    return hashlib.md5(" ".join(words).encode("utf-8", "replace"), usedforsecurity=False).digest()


def sketched(rows: DataFrame, weighted: bool) -> DataFrame:
    """``id, digest, keys, sketch`` of ``id, text``: band keys, and 16 bits of each dart; null without words."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashed = word_hashes()
        for b in slices(batches, nbytes=2 << 20):
            digests, sets, weights, at = [None] * b.num_rows, [], [], []
            for i, text in enumerate(b.column(1).to_pylist()):
                if words := words_of(text):
                    digests[i] = digest_of(words)
                    own, counts = np.unique(all_shingles(words, hashed), return_counts=True)
                    sets.append(own)
                    weights.append(counts.astype(np.float64) if weighted else np.ones(len(own)))
                    at.append(i)
            keys, sketch = [None] * b.num_rows, [None] * b.num_rows
            if sets:
                darts = signatures(sets, weights)
                for i, key, d in zip(at, band_keys(darts), darts, strict=True):
                    keys[i], sketch[i] = key, (d >> np.uint64(48)).astype(np.uint16).tobytes()
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(digests, pa.binary()), pa.array(keys, pa.list_(pa.int64())), pa.array(sketch, pa.binary())], names=["id", "digest", "keys", "sketch"])

    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, digest binary, keys array<bigint>, sketch binary")


def promising(pairs: DataFrame, nodes: DataFrame, least: float) -> DataFrame:
    """Pairs ``a, b`` whose sketches agree in a share of at least ``least``."""
    one = nodes.select(F.col("node").alias("a"), F.col("sketch").alias("x"))
    two = nodes.select(F.col("node").alias("b"), F.col("sketch").alias("y"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x, y = (np.frombuffer(b"".join(b.column(c).to_pylist()), np.uint16).reshape(b.num_rows, -1) for c in (2, 3))
                b = b.filter(pa.array((x == y).mean(1) >= least))
            yield b.select([0, 1])

    return pairs.join(one, "a").join(two, "b").select("a", "b", "x", "y").mapInArrow(run, "a bigint, b bigint")


def shingle_sets(rows: DataFrame, wanted: DataFrame, weighted: bool) -> DataFrame:
    """``node, shingles`` (hashes, each as often as it weighs) of the wanted ``node, id, digest``."""
    few = wanted.count() <= BROADCAST_ROWS
    wanted = wanted.withColumnRenamed("id", "first")
    picked = rows.join(F.broadcast(wanted) if few else wanted, F.col("id").eqNullSafe(F.col("first"))).select("node", "digest", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashed = word_hashes()
        for b in slices(batches, nbytes=2 << 20):
            nodes, sets = [], []
            for node, digest, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                words = words_of(text)
                if digest_of(words) == digest:  # an id may stand at several texts
                    nodes.append(node)
                    own = unrolled(*np.unique(all_shingles(words, hashed), return_counts=True)) if weighted else shingles(words, hashed)
                    sets.append(own.view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(sets, pa.list_(pa.int64()))], names=["node", "shingles"])

    return picked.mapInArrow(run, "node bigint, shingles array<bigint>").dropDuplicates(["node"])


def verified(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """Pairs ``a, b`` whose shingle sets have a Jaccard similarity of at least the threshold."""
    one = sets.select(F.col("node").alias("a"), F.col("shingles").alias("x"))
    two = sets.select(F.col("node").alias("b"), F.col("shingles").alias("y"))
    common, both = F.size(F.array_intersect("x", "y")), F.size("x") + F.size("y")
    can = (F.size("x") >= threshold * F.size("y")) & (F.size("y") >= threshold * F.size("x"))
    # Row by row in the JVM: batches of many long sets for Python could outgrow an executor.
    return pairs.join(one, "a").join(two, "b").where(can).where(common >= threshold * (both - common)).select("a", "b")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.8, weighted: bool = False) -> DataFrame:
    """``id, class_id, class_size`` of every row: smallest id and number of rows of its class."""
    ship(docs.sparkSession)
    rows = keyed(docs, id_col, text_col, "text")
    marked = materialize(sketched(rows, weighted), "sketches")
    nodes = marked.where("digest IS NOT NULL").groupBy("digest").agg(F.min("id").alias("id"), F.count("*").alias("n"), F.first("keys").alias("keys"), F.first("sketch").alias("sketch"))
    nodes = materialize(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")

    # Buckets of two nodes or more, with how widely each node is connected.
    bands = nodes.select("node", "keys", F.posexplode("keys").alias("pos", "key"))
    ahead = lambda k: F.get("keys", (F.col("pos") + k) % BANDS)
    bands = bands.select("key", "node", ahead(1).alias("next"), ahead(2).alias("after"))
    shared = bands.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    buckets = materialize(bands.join(shared, "key"), "buckets")
    reach = buckets.groupBy("node").agg(F.sum("n").alias("reach"))
    buckets = materialize(buckets.join(reach, "node"), "reach")
    first = F.struct("reach", (-F.col("node")).alias("minus"))
    leads = buckets.groupBy("key").agg((-F.max(first)["minus"]).alias("lead"))

    wanted = nodes.join(buckets.select("node").distinct(), "node", "left_semi").select("node", "id", "digest")
    sets = materialize(shingle_sets(rows, materialize(wanted, "wanted"), weighted), "sets")
    loose = threshold - 0.2  # five standard deviations of the share of equal coordinates, about

    def links(pairs: DataFrame, label: str) -> DataFrame:
        ordered = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct()
        return materialize(verified(materialize(promising(ordered, nodes, loose), f"{label}-pairs"), sets, threshold), label)

    stars = links(buckets.join(leads, "key").select(F.col("lead").alias("a"), F.col("node").alias("b")), "stars")
    groups = components(stars)

    # What the leaders did not join is compared further, between components only.
    part = F.when(F.col("n") > PART, F.pmod(F.xxhash64("next"), F.ceil(F.col("n") / PART))).otherwise(0)
    placed = buckets.join(groups, "node", "left").withColumn("component", F.coalesce("component", "node")).withColumn("part", part)
    crowds = placed.groupBy("key", "part").agg(F.count("*").alias("crowd")).where(F.col("crowd") > 4 * PART)
    salt = F.coalesce(F.pmod(F.xxhash64("node"), F.ceil(F.col("crowd") / PART)), F.lit(0)).alias("salt")
    placed = placed.join(crowds, ["key", "part"], "left").select("key", "n", "node", "next", "after", "component", "part", salt)
    w = Window.partitionBy("key", "part", "salt").orderBy("next", "after", "node")
    me, large = F.struct("node", "component"), F.col("n") > NEIGHBOURS + 1
    others = F.array(*(F.lag(me, k).over(w) if k <= FEW else F.when(~large, F.lag(me, k).over(w)) for k in range(1, NEIGHBOURS + 1)))
    more = placed.withColumn("others", others).withColumn("others", F.filter("others", lambda x: x.isNotNull() & (x["component"] != F.col("component"))))
    second = links(more.where(F.size("others") > 0).select(F.col("node").alias("a"), F.explode("others.node").alias("b")), "more")
    joined = stars.unionByName(second)
    groups = components(joined)

    # Large buckets are not compared completely so far: what is still apart in them.
    sized = buckets.where(large).select("key", "node").join(sets.select("node", F.size("shingles").cast("bigint").alias("size")), "node")
    third = materialize(settled(open_blocks(sized, groups), sets, lambda common, both: common >= threshold * (both - common)), "apart")
    if third.limit(1).count():
        groups = components(joined.unionByName(third))

    known = nodes.join(groups, "node", "left").select("digest", "id", "n", F.coalesce("component", "node").alias("component"))
    classes = known.groupBy("component").agg(F.min("id").alias("class_id"), F.sum("n").alias("class_size"))
    of = known.join(classes, "component").select("digest", "class_id", "class_size")
    alone = marked.where("digest IS NULL").select("id", F.col("id").alias("class_id"), F.lit(1).cast("bigint").alias("class_size"))
    return marked.where("digest IS NOT NULL").select("id", "digest").join(of, "digest").select("id", "class_id", "class_size").unionByName(alone)
