"""Jaccard join of word n-gram sets through R-trees over count vectors.

A document is the set of its distinct shingles. Shingles are hashed into groups, and a set's counts by group are a point. The overlap of
two sets is at most the sum of the smaller of their two counts in each group; with a box of points in place of one of them, at most the sum of the minima with the
box's upper corner. Points are packed into R-trees by size, then by the coordinate that varies most; a search goes down into the boxes whose
bound, with the sizes, still allows the threshold. Surviving pairs are verified by their exact overlap.

One tree over all points would be one task's. So points meet in many trees: groups are dealt into as many blocks of coordinates as links may have different
shingles, and a few more, so linked points agree exactly in some blocks. Points with equal counts in a block of one size class (fine groups here, hashed with
their counts to a key) form a bucket. Sizes that a link can carry over the upper edge of their class are dealt by the next class as well.
A bucket is first joined around its most widely connected point. If that leaves components apart, every point outside the largest is searched
in trees over all points of the bucket, in blocks of bounded size. The trees pass on a few pairs for each point, or the points themselves that have a
possible link to another component. Only their sets are fetched, and verified links come out where they join components. So no link between different sets is lost, and no
list of all pairs of a bucket arises.

Defined results: words are maximal runs of other characters than space, tab, line feed, vertical tab, form feed and return, A-Z lower-cased. With fewer words than
``n`` the whole sequence is one shingle. Null texts and texts without words are empty sets, linked with nothing. Repeated rows and ids are
linked if their sets are; a null id is a component's name only if it has no other. Shingles count as equal by 64 bits of hash. An empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vacantia.llm.common import components, keyed, materialize, ship, slices
from vacantia.llm.dart_minhash import mix, shingles, word_hashes
from vacantia.llm.forest import near_links, open_blocks, star_blocks

#: Coordinates of a point; points of a leaf, and boxes of a box.
GROUPS, LEAF, FAN = 128, 16, 16
#: Largest size over smallest, of a class; blocks of coordinates beyond what must agree: so many may be empty without being told.
CLASS, SPARE = 1.4, 2
#: Nodes whose sets are fetched by broadcasting their digests; more are joined by shuffle.
BROADCAST_ROWS = 300_000
_S, _T = np.uint64(0xD1B54A32D192ED03), np.uint64(0x8CB92BA72F3D8DD7)


def words_of(text: str | None) -> list[bytes]:
    return text.encode().lower().split() if text else []  # of bytes: A-Z only, and the six white spaces


def size_classes(percent: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Largest size of each class, and how many elements two linked sets of it can differ by."""
    tops = [1]
    while tops[-1] < most:
        tops.append(max(tops[-1] + 1, int(tops[-1] * CLASS)))
    top = np.array(tops)
    return top, 2 * top * (100 - percent) // (100 + percent)


def block_keys(elements: np.ndarray, cls: int, blocks: int) -> np.ndarray:
    """Keys of the blocks of one set's point: equal if and only if (by 64 bits) the counts in the block are. Of empty blocks, combinations beyond ``SPARE``."""
    seed = mix(np.uint64((cls + 1) * int(_S) % (1 << 64)) + np.arange(blocks + 1, dtype=np.uint64))
    spread = mix(elements ^ seed[-1])
    block = (spread >> np.uint64(32)) % np.uint64(blocks)
    sums = np.zeros(blocks, np.uint64)
    np.add.at(sums, block.astype(np.int64), mix(spread + _T))  # adding the fine groups' numbers counts them
    filled = np.bincount(block.astype(np.int64), minlength=blocks) > 0
    keys = mix(sums[filled] + seed[:-1][filled])
    empty = np.flatnonzero(~filled)
    if len(empty) > SPARE:
        keys = np.concatenate([keys, [mix(seed[list(c)].sum(keepdims=True) ^ _T)[0] for c in combinations(empty.tolist(), SPARE + 1)]])
    return keys


def keys_of(elements: np.ndarray, percent: int, top: np.ndarray, differ: np.ndarray) -> np.ndarray:
    """Keys of a set in its class, and in the next one if a link can reach there. Sets so small that links have no difference need none."""
    size, out = len(elements), []
    cls = int(np.searchsorted(top, size))
    for c in (cls, cls + 1) if size * 100 >= percent * (int(top[cls]) + 1) else (cls,):
        if differ[c]:
            out.append(block_keys(elements, c, int(differ[c]) + 1 + SPARE))
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def sketched(rows: DataFrame, n: int, percent: int) -> DataFrame:
    """``id, digest, size, keys`` of ``id, text``; of empty sets the digest is null."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashed = word_hashes()
        top, differ = size_classes(percent, 1 << 16)
        for b in slices(batches, nbytes=2 << 20):
            digests, sizes, keys = [None] * b.num_rows, [0] * b.num_rows, [None] * b.num_rows
            for i, text in enumerate(b.column(1).to_pylist()):
                if words := words_of(text):
                    own = shingles(words, hashed, n)
                    if len(own) * 2 > top[-1]:
                        top, differ = size_classes(percent, 4 * len(own))
                    digests[i], sizes[i] = hashlib.md5(own.tobytes(), usedforsecurity=False).digest(), len(own)
                    keys[i] = keys_of(own, percent, top, differ).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(digests, pa.binary()), pa.array(sizes, pa.int64()), pa.array(keys, pa.list_(pa.int64()))], names=["id", "digest", "size", "keys"])

    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, digest binary, size bigint, keys array<bigint>")


def shingle_sets(rows: DataFrame, wanted: DataFrame, n: int) -> DataFrame:
    """``node, size, point, shingles`` of the wanted ``node, id, digest``."""
    few = wanted.count() <= BROADCAST_ROWS
    wanted = wanted.withColumnRenamed("id", "first")
    picked = rows.join(F.broadcast(wanted) if few else wanted, F.col("id").eqNullSafe(F.col("first"))).select("node", "digest", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashed = word_hashes()
        for b in slices(batches, nbytes=2 << 20):
            nodes, sets, at = [], [], []
            for node, digest, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                own = shingles(words_of(text), hashed, n)
                if hashlib.md5(own.tobytes(), usedforsecurity=False).digest() == digest:  # an id may stand at several texts
                    nodes.append(node)
                    sets.append(own.view(np.int64))
                    at.append(points(own, np.array([0, len(own)]))[0])
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([len(x) for x in sets], pa.int64()), pa.array(at, pa.list_(pa.int32())), pa.array(sets, pa.list_(pa.int64()))], names=["node", "size", "point", "shingles"])

    return picked.mapInArrow(run, "node bigint, size bigint, point array<int>, shingles array<bigint>").dropDuplicates(["node"])


def points(elements: np.ndarray, offsets: np.ndarray, groups: int = GROUPS) -> np.ndarray:
    """Counts by group of each set."""
    of = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    group = (mix(elements.view(np.uint64) ^ _T) % np.uint64(groups)).astype(np.int64)
    return np.bincount(of * groups + group, minlength=(len(offsets) - 1) * groups).reshape(-1, groups)


class RTree:
    """Packed boxes over points: by size in slabs, then by the coordinate of the largest variance."""

    def __init__(self, at: np.ndarray, size: np.ndarray) -> None:
        leaves = -(-len(size) // LEAF)
        slab = LEAF * max(1, round(leaves ** 0.5))
        order = np.argsort(size, kind="stable")
        wide = at[:, at.var(0).argmax()]
        order = np.concatenate([part[np.argsort(wide[part], kind="stable")] for part in (order[k:k + slab] for k in range(0, len(order), slab))])
        self.order = order
        #: From the points up: upper corners, least and largest size.
        self.levels, fan = [(at[order], size[order], size[order])], LEAF
        while len(self.levels[-1][0]) > 1:
            upper, low, high = self.levels[-1]
            cuts = np.arange(0, len(upper), fan)
            self.levels.append((np.maximum.reduceat(upper, cuts), np.minimum.reduceat(low, cuts), np.maximum.reduceat(high, cuts)))
            fan = FAN

    def search(self, at: np.ndarray, size: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray, int]:
        """(searching point, point found) of all pairs whose bounds reach the threshold; and the number of bounds that were computed."""
        q, box, computed = np.repeat(np.arange(len(size)), len(self.levels[-1][0])), np.tile(np.arange(len(self.levels[-1][0])), len(size)), 0
        for level in range(len(self.levels) - 1, -1, -1):
            upper, low, high = self.levels[level]
            keep = np.zeros(len(q), bool)
            for k in range(0, len(q), 1 << 16):
                part, own = box[k:k + (1 << 16)], q[k:k + (1 << 16)]
                most = np.minimum(np.minimum(at[own], upper[part]).sum(1), np.minimum(size[own], high[part]))
                union = size[own] + np.maximum(low[part], most) - most
                keep[k:k + (1 << 16)] = 100 * most >= percent * union
            computed += len(q)
            q, box = q[keep], box[keep]
            if level:
                fan = LEAF if level == 1 else FAN
                below = len(self.levels[level - 1][0])
                n = np.minimum(fan, below - box * fan)
                first = np.repeat(box * fan, n)
                box, q = first + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n), np.repeat(q, n)
        return q, self.order[box], computed


def tree_search(percent: int, step: int = 256):
    """For ``pruned``: searches from the left in the R-tree over the right side of a block."""
    def search(left: np.ndarray, left_size: np.ndarray, right: np.ndarray, right_size: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        tree = RTree(right, right_size)
        for at in range(0, len(left), step):
            q, found, _ = tree.search(left[at:at + step], left_size[at:at + step], percent)
            yield q + at, found
    return search


def linked(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 3, percent: int = 90) -> DataFrame:
    """``id, n_shingles, component_id`` of every row: links are pairs of sets with ``100 * overlap >= percent * union``."""
    ship(docs.sparkSession)
    rows = keyed(docs, id_col, text_col, "text")
    marked = materialize(sketched(rows, n, percent), "sets")
    known = marked.where("digest IS NOT NULL")
    nodes = known.groupBy("digest").agg(F.min("id").alias("id"), F.first("size").alias("size"))
    nodes = materialize(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")

    # Keys of a set's first row; many, so they are stored once and travel with a node's number only.
    dealt = known.groupBy("digest").agg(F.first("keys").alias("keys")).join(nodes.select("digest", "node"), "digest").select("node", F.explode("keys").alias("key"))
    shared = dealt.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    buckets = materialize(dealt.join(shared, "key"), "keys")
    buckets = materialize(buckets.join(nodes.select("node", "size"), "node"), "buckets")
    reach = buckets.groupBy("node").agg(F.sum("n").alias("reach"))
    buckets = materialize(buckets.join(reach, "node"), "reach")
    wanted = nodes.join(reach, "node", "left_semi").select("node", "id", "digest")
    sets = materialize(shingle_sets(rows, materialize(wanted, "wanted"), n), "shingles")
    search = tree_search(percent)
    enough = lambda common, both: 100 * common >= percent * (both - common)
    lead = F.max(F.struct("reach", (-F.col("node")).alias("minus"), F.col("size").alias("lead_size")))
    leads = buckets.groupBy("key").agg(lead.alias("lead")).select("key", (-F.col("lead.minus")).alias("lead"), "lead.lead_size")
    can = (F.col("size") * 100 >= F.col("lead_size") * percent) & (F.col("lead_size") * 100 >= F.col("size") * percent)
    stars = materialize(buckets.join(leads, "key").where(can & (F.col("lead") != F.col("node"))).select("lead", "node", "size").distinct(), "stars")
    first, judged = near_links(star_blocks(stars), sets, search, enough, None, "first")
    second, _ = near_links(open_blocks(buckets, components(first)), sets, search, enough, judged, "second")
    groups = components(first.unionByName(second))

    known = nodes.join(groups, "node", "left").select("digest", "id", F.coalesce("component", "node").alias("component"))
    names = known.groupBy("component").agg(F.min("id").alias("component_id"))
    of = known.join(names, "component").select("digest", "component_id")
    alone = marked.where("digest IS NULL").select("id", F.col("size").alias("n_shingles"), F.col("id").alias("component_id"))
    return marked.where("digest IS NOT NULL").select("id", "size", "digest").join(of, "digest").select("id", F.col("size").alias("n_shingles"), "component_id").unionByName(alone)
