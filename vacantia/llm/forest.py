"""Complete comparison inside buckets: blocks of bounded size that yield spanning forests of true links, not pairs.

A bucket holds nodes that may be linked. Its nodes come to blocks, first with a short vector each, if the caller has one that bounds the overlap: only nodes
with a partner in another component that they may be linked with stay. Then they come together with their sets; a block judges pairs by their exact overlap and
passes on only links between components that it has not joined yet: fewer than it has nodes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vacantia.llm.common import materialize, partitions

#: Elements on each side of a block, and of the blocks that a task takes together; rows with vectors that it takes together; pairs
#: that a block may pass on for each of its rows.
SIDE, TOGETHER, ROWS, PAIRS = 1 << 18, 1 << 19, 1 << 14, 4

#: Of overlaps and sums of sizes: which are links.
Enough = Callable[[np.ndarray, np.ndarray], np.ndarray]
#: Of vectors and sizes on the left and on the right: pairs (left, right) that may be links, some at a time.
Search = Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray], Iterator[tuple[np.ndarray, np.ndarray]]]


def _chunks(elements: str) -> Column:
    return F.ceil(F.col(elements) / SIDE).cast("int")


def _chunk(count: str) -> Column:
    return F.pmod(F.xxhash64("node"), F.col(count)).cast("int")


def star_blocks(stars: DataFrame) -> DataFrame:
    """Blocks of distinct ``lead, node, size``: each lead with all its nodes."""
    chunks = stars.groupBy("lead").agg(F.sum("size").alias("elements")).select("lead", _chunks("elements").alias("chunks"))
    dealt = stars.join(chunks, "lead").select(F.xxhash64("lead", _chunk("chunks")).alias("block"), "node")
    leads = chunks.select(F.col("lead").alias("node"), F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk")).select(F.xxhash64("node", "chunk").alias("block"), "node")
    return dealt.select("block", F.lit(True).alias("side"), "node", F.col("node").alias("component")).unionByName(leads.select("block", F.lit(False).alias("side"), "node", F.col("node").alias("component")))


def open_blocks(buckets: DataFrame, groups: DataFrame) -> DataFrame:
    """Blocks of the buckets (``key, node, size``) that hold several components: every node outside the largest one with all nodes. Buckets of equal nodes count once."""
    known = buckets.select("key", "node", "size").join(groups, "node", "left").withColumn("component", F.coalesce("component", "node"))
    parts = known.groupBy("key", "component").agg(F.count("*").alias("m"), F.sum("size").alias("w"), F.sum(F.xxhash64("node").cast("decimal(20,0)")).alias("h"))
    mixed = parts.groupBy("key").agg(F.sum("w").alias("all"), F.max(F.struct("m", "w", "component")).alias("top"), F.sum("h").alias("h"), F.sum("m").alias("m"), F.count("*").alias("c")).where("c > 1")
    once = mixed.groupBy("m", "h").agg(F.min(F.struct("key", "all", "top")).alias("x")).select("x.*")
    once = once.select("key", F.col("top.component").alias("most"), _chunks("all").alias("cols"), F.ceil((F.col("all") - F.col("top.w")) / SIDE).cast("int").alias("rows"))
    placed = materialize(known.join(once, "key").select("key", "node", "component", "most", "rows", "cols"), "open")
    every = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    left = placed.where("component <> most").select("key", "node", "component", F.lit(True).alias("side"), _chunk("rows").alias("i"), every("cols").alias("j"))
    right = placed.select("key", "node", "component", F.lit(False).alias("side"), _chunk("cols").alias("j"), every("rows").alias("i"))
    return left.unionByName(right).select(F.xxhash64("key", "i", "j").alias("block"), "side", "node", "component")


def pruned(blocks: DataFrame, vectors: DataFrame, search: Search) -> DataFrame:
    """What of the blocks may be linked across components: ``a, b`` in blocks with few such pairs, else the rows that have one (``block, side, node, component``).

    ``vectors``: ``node, size, point``. A block passes on at most ``PAIRS`` pairs for each of its rows.
    """
    sent = blocks.join(vectors, "node")
    bins = max(partitions(blocks.sparkSession), -(-blocks.count() // ROWS))

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("block", "ascending"), ("side", "ascending"), ("node", "ascending")]).combine_chunks()
        block, node, component, size = (table.column(c).to_numpy() for c in ("block", "node", "component", "size"))
        side = table.column("side").to_numpy(zero_copy_only=False)
        points = table.column("point").chunk(0).flatten().to_numpy().reshape(len(block), -1)
        cuts = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), len(block)]
        keep, pairs = np.zeros(len(block), bool), [np.zeros((2, 0), np.int64)]
        for start, end in zip(cuts, cuts[1:], strict=False):
            middle = start + int((~side[start:end]).sum())
            own, few = [], PAIRS * (end - start)
            if start < middle < end:
                for left, right in search(points[middle:end], size[middle:end], points[start:middle], size[start:middle]):
                    apart = component[middle + left] != component[start + right]
                    left, right = middle + left[apart], start + right[apart]
                    keep[left], keep[right] = True, True
                    few -= len(left)
                    own = [*own, np.stack([node[left], node[right]])] if few >= 0 else []
            if few >= 0:
                keep[start:end] = False
                pairs += own
        pairs, rows = np.concatenate(pairs, 1), table.select(["block", "side", "node", "component"]).filter(pa.array(keep))
        none = lambda n: pa.nulls(n, pa.int64())
        n = pairs.shape[1]
        rows = rows.append_column("a", none(len(rows))).append_column("b", none(len(rows)))
        own = pa.table({"block": none(n), "side": pa.nulls(n, pa.bool_()), "node": none(n), "component": none(n), "a": pa.array(pairs.min(0), pa.int64()), "b": pa.array(pairs.max(0), pa.int64())})
        return pa.concat_tables([rows, own])

    return sent.withColumn("bin", F.pmod(F.xxhash64("block"), F.lit(bins))).groupBy("bin").applyInArrow(run, "block bigint, side boolean, node bigint, component bigint, a bigint, b bigint")


def near_links(blocks: DataFrame, sets: DataFrame, search: Search, enough: Enough, known: DataFrame | None, label: str) -> tuple[DataFrame, DataFrame]:
    """(links ``a, b`` of the blocks as ``settled`` finds them, pairs ``a, b`` that were judged). ``known``: pairs judged before. ``sets``: ``node, size, point, shingles``."""
    found = materialize(pruned(blocks, sets.select("node", "size", "point"), search), f"{label}-near")
    pairs = found.where("a IS NOT NULL").select("a", "b").distinct()
    if known is not None:
        pairs = pairs.join(known, ["a", "b"], "left_anti")
    pairs = materialize(pairs, f"{label}-pairs")
    stars = star_blocks(pairs.select(F.col("a").alias("lead"), F.col("b").alias("node")).join(sets.select("node", "size"), "node"))
    dense = found.where("a IS NULL").select("block", "side", "node", "component")
    return materialize(settled(stars.unionByName(dense), sets, enough), label), pairs


def links_of_block(sets: np.ndarray, offsets: np.ndarray, middle: int, component: np.ndarray, enough: Enough) -> list[tuple[int, int]]:
    """(left, right) links that join components: nodes before ``middle`` are the right side, those behind it the left."""
    size = np.diff(offsets)
    if not 0 < middle < len(size):
        return []
    right = sets[:offsets[middle]]
    owner = np.repeat(np.arange(middle), size[:middle])
    order = np.argsort(right, kind="stable")
    right, owner = right[order], owner[order]
    label, found = component.copy(), []
    for k in range(middle, len(size)):
        free = label[:middle] != label[k]
        if not free.any():
            continue
        own = sets[offsets[k]:offsets[k + 1]]
        low, high = np.searchsorted(right, own, "left"), np.searchsorted(right, own, "right")
        n = high - low
        hits = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)
        common = np.bincount(owner[hits], minlength=middle)
        linked = np.flatnonzero(free & enough(common, size[:middle] + size[k]))
        for r in linked[np.unique(label[linked], return_index=True)[1]]:
            found.append((k, int(r)))
            label[label == label[r]] = label[k]
    return found


def settled(blocks: DataFrame, sets: DataFrame, enough: Enough) -> DataFrame:
    """``a, b`` (``a < b``): links that join all nodes of a block that true links join. ``sets``: ``node, shingles`` (distinct elements)."""
    sent = blocks.join(sets.select("node", "shingles"), "node")
    elements = blocks.join(sets.select("node", F.size("shingles").alias("n")), "node").agg(F.sum("n")).first()[0] or 0
    bins = max(partitions(blocks.sparkSession), -(-elements // TOGETHER))

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("block", "ascending"), ("side", "ascending"), ("node", "ascending")]).combine_chunks()
        block, node, component = (table.column(c).to_numpy() for c in ("block", "node", "component"))
        side = table.column("side").to_numpy(zero_copy_only=False)
        lists = table.column("shingles").chunk(0)
        offsets, flat = lists.offsets.to_numpy().astype(np.int64), lists.values.to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), len(node)]
        a, b = [], []
        for start, end in zip(cuts, cuts[1:], strict=False):
            base = offsets[start]
            for x, y in links_of_block(flat[base:offsets[end]], offsets[start:end + 1] - base, int((~side[start:end]).sum()), component[start:end], enough):
                a.append(min(node[start + x], node[start + y]))
                b.append(max(node[start + x], node[start + y]))
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return sent.withColumn("bin", F.pmod(F.xxhash64("block"), F.lit(bins))).groupBy("bin").applyInArrow(run, "a bigint, b bigint")
