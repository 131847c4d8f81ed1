"""Shared core of the fuzzy joins: buckets of signatures to candidate groups, then exact Jaccard.

A record is ``rid`` (a 64-bit hash of its content) with ``sig``, a MinHash signature of ``bins`` unsigned integers.
``candidates`` ties together all records that share a bucket and look alike; ``exact`` verifies
every pair within the groups found, on the whole shingle sets."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm import spread, text

#: Buckets of at most so many records are compared pair by pair, and blocks of larger ones.
LIMIT = 256
#: Signatures this similar are tied (far below the threshold of the exact check that follows), ...
ALIKE = 0.5
#: ... in a large bucket, to each of its pivots, from this on ...
NEAR_PIVOT = 0.35
#: ... and a record leaves a large bucket if it is this similar to a pivot: whatever is within 0.2 of it
#: is then, with room for the signatures' error, tied to that pivot as well.
SAME = 0.7
MAX_DEPTH = 4
#: What is left of a large bucket is cut into blocks of LIMIT / 2 at once if there are so many at most; that loses nothing.
BLOCKS = 16
#: Where only signatures are compared, a block has so many times that: each record is then in at most BLOCKS / WIDER tiles, for the same pairs.
WIDER = 4
#: Pivots of a large bucket.
PIVOTS = 4
#: A child of a large bucket is what agrees in so many bins.
SPLIT_BINS = 2
#: Records of a group that are verified in one piece.
TILE = 256


def _alike(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a == b).mean(1)


def _brute(bins: int, dtype):
    """All pairs of each small bucket, as ties of each record to the least one of its connected part."""

    def pairs(batches):
        held = None
        for batch in batches:
            table = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            path = np.asarray(table.column("path"))
            cut = int(np.flatnonzero(path != path[-1])[-1]) + 1 if (path != path[-1]).any() else 0
            held = table.slice(cut)
            if cut:
                yield from ties(table.slice(0, cut))
        if held is not None and held.num_rows:
            yield from ties(held)

    def ties(table):
        path, rid = np.asarray(table.column("path")), np.asarray(table.column("rid"))
        sig = text.from_binary(table.column("sig"), dtype, bins)
        a, b = [], []
        for gap in range(1, len(path)):
            left = np.flatnonzero(path[gap:] == path[:-gap])
            if not len(left):
                break
            left = left[_alike(sig[left], sig[left + gap]) >= ALIKE]
            a.append(left)
            b.append(left + gap)
        if not a:
            return
        a, b = np.concatenate(a), np.concatenate(b)
        label = spanning(a, b, len(path))
        at = np.flatnonzero(label != np.arange(len(path)))
        if len(at):
            edge = np.unique(np.stack([rid[at], rid[label[at]]], 1), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(edge[:, 0]), pa.array(edge[:, 1])], names=["a", "b"])

    return pairs


def spanning(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Each record's least index that edges (a, b) connect it with."""
    label = np.arange(n)
    while len(a):
        before = label.copy()
        low = np.minimum(label[a], label[b])
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        np.minimum.at(label, before[a], low)
        np.minimum.at(label, before[b], low)
        label = label[label]
        if (label == before).all():
            break
    return label


def _compare(bins: int, dtype):
    """Of each record its likeness to the nearest of its bucket's pivots, and the pivots that are near."""

    def est(batches):
        for batch in batches:
            sig, rid = text.from_binary(batch.column("sig"), dtype, bins), np.asarray(batch.column("rid"))
            pivot = np.stack([np.asarray(batch.column(f"pivot{k}")) for k in range(PIVOTS)], 1)
            alike = np.stack([_alike(sig, text.from_binary(batch.column(f"sig{k}"), dtype, bins)) for k in range(PIVOTS)], 1)
            near = (alike >= NEAR_PIVOT) & (pivot != rid[:, None])
            ends = np.append(0, np.cumsum(near.sum(1))).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column("path"), batch.column("rid"), pa.array(alike.max(1)), pa.ListArray.from_arrays(pa.array(ends), pa.array(pivot[near]))], names=["path", "rid", "est", "near"])

    return est


def _star(large: DataFrame, sig: DataFrame, bins: int, dtype) -> DataFrame:
    """(path, rid, est, near) of the records of large buckets, each bucket having PIVOTS pivots: the least rids by as many orders."""
    rows = large.select("path", "rid").join(sig, "rid")
    picked = rows.groupBy("path").agg(*(F.min_by(F.struct("rid", "sig"), F.xxhash64("rid", F.lit(k))).alias(f"p{k}") for k in range(PIVOTS)))
    picked = picked.select("path", *(F.col(f"p{k}.rid").alias(f"pivot{k}") for k in range(PIVOTS)), *(F.col(f"p{k}.sig").alias(f"sig{k}") for k in range(PIVOTS)))
    return rows.join(picked, "path").mapInArrow(_compare(bins, dtype), "path long, rid long, est double, near array<long>")


def miss(bins: int, threshold: float, keys: int, rows: int, draws: int, splits: int = MAX_DEPTH - 1) -> float:
    """How often a pair at the threshold shares no compared bucket: none of ``keys`` keys of ``rows`` bins each
    that all lie in buckets which are split ``splits`` times, by ``draws`` draws each time.

    Summed over how many bins of the two signatures agree, as all draws are from the same signatures. Keys count as
    drawn with replacement; disjoint ones miss less."""
    total = 0.0
    for k in range(bins + 1):
        share, lost = k / bins, 0.0
        for _ in range(splits):
            lost = (1 - share**SPLIT_BINS * (1 - lost)) ** draws
        total += math.comb(bins, k) * threshold**k * (1 - threshold) ** (bins - k) * (1 - share**rows * (1 - lost)) ** keys
    return total


def draws_for(bins: int, threshold: float, keys: int, rows: int, more: float) -> int:
    """Draws of a split, so that splitting down to MAX_DEPTH adds at most ``more`` to the miss of the keys themselves."""
    draws = 1
    while miss(bins, threshold, keys, rows, draws) > miss(bins, threshold, keys, rows, 0, 0) + more:
        draws += 1
    return draws


def splitter(bins: int, width: int, draws: int) -> Callable[[DataFrame], DataFrame]:
    """Chosen-path children: each node draws ``draws`` pairs of bins; a child is what agrees in both."""

    def split(rows: DataFrame) -> DataFrame:
        children = []
        for k in range(draws):
            one = F.pmod(F.xxhash64("path", F.lit(f"draw{k}")), F.lit(bins))
            two = F.pmod(one + 1 + F.pmod(F.xxhash64("path", F.lit(f"other{k}")), F.lit(bins - 1)), F.lit(bins))
            pair = F.least(one, two).cast("int"), F.greatest(one, two).cast("int")
            children.append(F.xxhash64("path", *pair, *(F.col("sig").substr(i * width + 1, F.lit(width)) for i in pair)))
        return rows.select(F.explode(F.array_distinct(F.array(*children))).alias("path"), "rid")

    return split


def token(path, i: int, width: int, bins: int = 1):
    """The child of a node for what the signature has in ``bins`` bins from the i-th on."""
    return F.xxhash64(path, F.lit(i), F.substring("sig", width * i + 1, width * bins))


def in_buckets(signed: Callable[[DataFrame], DataFrame], buckets: DataFrame, bins: int, dtype, draws: int, wider: int = 1) -> tuple[DataFrame, DataFrame | None]:
    """(path, rid) of the small buckets in which records meet, each set of records once, and ties (a, b) to the pivots of large ones.

    buckets: (path, rid); signed: gives (rid, sig) of distinct rids. In a large bucket all are compared with its pivots,
    PIVOTS records drawn by hash; those near are tied to each, and the nearest leave; the rest is cut into blocks of ``wider`` * LIMIT / 2, each two of which are a small bucket,
    or, where that would be many, split again by ``draws`` drawn pairs of bins (``miss`` says what that loses) down to the last depth."""
    split = splitter(bins, np.dtype(dtype).itemsize, draws)
    small, ties, sig, depth = None, None, None, 0
    while True:
        whole = Window.partitionBy("path")
        number = F.try_sum(F.shiftrightunsigned(F.xxhash64("rid"), 24)).over(whole)
        shared = buckets.select("path", "rid", F.count(F.lit(1)).over(whole).alias("c"), F.min("rid").over(whole).alias("least"), F.max("rid").over(whole).alias("other"), number.alias("number")).where("c > 1 and other > least")
        shared = spread.stored(shared.select("path", "rid", "c", F.xxhash64("c", "least", "other", "number").alias("set")), "buckets")
        found, large = shared.where(F.col("c") <= LIMIT).select(F.col("set").alias("path"), "rid"), shared.where(F.col("c") > LIMIT)
        small = found if small is None else small.union(found)
        if large.isEmpty():
            break
        if sig is None:
            sig = spread.stored(signed(large.select("rid").distinct()), "signatures")
        star = spread.stored(_star(large, sig, bins, dtype), "star")
        near = star.select(F.col("rid").alias("a"), F.explode("near").alias("b"))
        ties = near if ties is None else ties.union(near)
        rest = star.where(F.col("est") < SAME).select("path", "rid", F.count(F.lit(1)).over(whole).alias("n"))
        depth += 1
        few = F.lit(depth == MAX_DEPTH) | (F.col("n") <= BLOCKS * (LIMIT // 2))
        tiles = rest.where(few & (F.col("n") > 1)).select("path", "rid", F.ceil(F.col("n") / F.lit(wider * (LIMIT // 2))).cast("long").alias("blocks"))
        small = small.union(_tiled(tiles, "path", "rid").select("path", "rid"))
        rest = rest.where(~few)
        if depth == MAX_DEPTH or rest.isEmpty():
            break
        buckets = split(rest.join(sig, "rid"))
    return spread.stored(small.distinct(), "small"), None if ties is None else spread.stored(ties.distinct(), "ties")


def candidates(records: DataFrame, buckets: DataFrame, bins: int, dtype, draws: int) -> DataFrame:
    """Edges (a, b) that tie every two records which share a bucket and look alike, through others or directly."""
    sig = records.select("rid", "sig")
    small, ties = in_buckets(lambda rids: sig.join(rids, "rid", "left_semi"), buckets, bins, dtype, draws, WIDER)
    found = _brute_edges(small, sig, bins, dtype)
    return found if ties is None else found.union(ties)


def _brute_edges(rows: DataFrame, sig: DataFrame, bins: int, dtype) -> DataFrame:
    return rows.join(sig, "rid").repartition("path").sortWithinPartitions("path", "rid").select("path", "rid", "sig").mapInArrow(_brute(bins, dtype), "a long, b long").distinct()


def _tiled(rows: DataFrame, key: str, rid: str) -> DataFrame:
    """Each record once for each pair of blocks with its own; ``key`` becomes that of the pair."""
    block = F.pmod(F.xxhash64(rid, F.lit(3)), "blocks")
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    rows = rows.withColumn("block", block).withColumn("other", other).withColumn("alone", F.col("block") == F.col("other"))
    return rows.withColumn(key, F.xxhash64(key, F.least("block", "other"), F.greatest("block", "other"))).drop("other", "blocks")


def sets64(column) -> tuple[np.ndarray, np.ndarray]:
    """Sets that are stored as their sorted 64-bit hashes."""
    data, offsets = text.utf8(column)
    return data.view(np.uint64), offsets // 8


def bucket_links(small: DataFrame, items: DataFrame, threshold: float, decode: Callable = sets64) -> DataFrame:
    """Edges (a, b) of records that share a small bucket (path, rid) and whose sets, decoded from (rid, items), reach the
    threshold: of each connected part within a bucket, one edge of every record to the least."""

    def verify(batches):
        for table in text.whole_groups(batches, "path", "items", 1 << 19):
            path, rid = np.asarray(table.column("path")), np.asarray(table.column("rid"))
            label = _linked(path, *decode(table.column("items")), threshold, lambda *_: None)
            at = np.flatnonzero(rid[label] != rid)
            if len(at):
                yield pa.RecordBatch.from_arrays([pa.array(rid[at]), pa.array(rid[label[at]])], names=["a", "b"])

    return small.join(items, "rid").select("path", "rid", "items").repartition("path").sortWithinPartitions("path", "rid").mapInArrow(verify, "a long, b long").distinct()


def _linked(group: np.ndarray, items: np.ndarray, offsets: np.ndarray, threshold: float, tell: Callable) -> np.ndarray:
    """Each record's least index that links within its group connect it with. tell: gets first indices of pairs that
    link in groups of two, and, for each larger group, its bounds and a matrix of links."""
    bounds = np.append(np.flatnonzero(np.append(True, group[1:] != group[:-1])), len(group))
    size, label = np.diff(bounds), np.arange(len(group))
    first = bounds[:-1][size == 2]
    near = first[pairs_near(items, offsets, first, threshold)]
    label[near + 1] = near
    tell(near, None, None)
    for low, high in zip(bounds[:-1][size > 2], bounds[1:][size > 2], strict=True):
        near = jaccard(items[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low], threshold)
        label[low:high] = low + spanning(*np.nonzero(near), high - low)
        tell(near, low, high)
    return label


def group_links(members: DataFrame, threshold: float, decode: Callable = sets64) -> DataFrame:
    """(rid, links, tied) of records that have a link: Jaccard similarity of at least ``threshold``.

    members: (grp, c, rid, weight, items), c being the size of the group, from whose items ``decode`` makes sets of
    distinct hashes; any two records that may be linked have the same grp. links: the weights of partners.
    tied: the least record that links connect with, within a tile. Groups of over TILE records are compared block by
    block, each pair of blocks in a task of its own."""
    rows = _tiled(members.withColumn("blocks", F.ceil(F.col("c") / F.lit(TILE)).cast("long")), "grp", "rid")

    def verify(batches):
        for table in text.whole_groups(batches, "grp", "items", 1 << 19):
            grp, rid, weight, block, alone = (np.asarray(table.column(k)) for k in ("grp", "rid", "weight", "block", "alone"))
            links = np.zeros(len(rid), np.int64)

            def count(near, low, high, links=links, weight=weight, block=block, alone=alone):
                if low is None:
                    near = near[alone[near] | (block[near] != block[near + 1])]  # pairs within one block count in its own tile
                    links[near], links[near + 1] = weight[near + 1], weight[near]
                else:
                    own = slice(low, high)
                    links[own] = ((near if alone[low] else near & (block[own][:, None] != block[own][None, :])) * weight[own][None, :]).sum(1)

            label = _linked(grp, *decode(table.column("items")), threshold, count)
            at = np.flatnonzero((links > 0) | (label != np.arange(len(rid))))
            if len(at):
                yield pa.RecordBatch.from_arrays([pa.array(rid[at]), pa.array(links[at]), pa.array(rid[label[at]])], names=["rid", "links", "tied"])

    return rows.select("grp", "rid", "weight", "block", "alone", "items").repartition("grp").sortWithinPartitions("grp").mapInArrow(verify, "rid long, links long, tied long")


def exact(members: DataFrame, threshold: float, decode: Callable = sets64) -> DataFrame:
    """(rid, links, label) of records that have a link; label: of the connected part."""
    found = spread.stored(group_links(members, threshold, decode), "verified")
    labels = spread.components(found.where("rid != tied").select(F.col("rid").alias("a"), F.col("tied").alias("b")))
    return found.groupBy("rid").agg(F.sum("links").alias("links")).join(labels.withColumnRenamed("id", "rid"), "rid")


def counted(edges: DataFrame) -> DataFrame:
    """(rid, grp, c) of the groups that edges make, stored."""
    groups = spread.components(edges).select(F.col("id").alias("rid"), F.col("label").alias("grp"))
    return spread.stored(groups.join(groups.groupBy("grp").agg(F.count(F.lit(1)).alias("c")), "grp").select("rid", "grp", "c"), "groups")


def distinct_sets(hashes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes of each row, of ``counts`` hashes in order, and their offsets."""
    out, ends = hashes.copy(), np.append(0, np.cumsum(counts))
    for low, high in zip(ends.tolist(), ends[1:].tolist(), strict=False):
        out[low:high].sort()
    new = np.ones(len(out), bool)
    new[1:] = out[1:] != out[:-1]
    new[ends[:-1][counts > 0]] = True
    return out[new], np.append(0, np.cumsum(new))[ends]


def pairs_near(items: np.ndarray, offsets: np.ndarray, first: np.ndarray, threshold: float) -> np.ndarray:
    """Which of the sets ``first`` reach the threshold with the set after them."""
    size, shared = offsets[first + 2] - offsets[first], np.zeros(len(first), np.int64)
    for i, (low, high) in enumerate(zip(offsets[first].tolist(), offsets[first + 2].tolist(), strict=True)):
        both = items[low:high].copy()
        both.sort()
        shared[i] = np.count_nonzero(both[1:] == both[:-1])
    return (shared > 0) & (shared >= threshold * (size - shared) - 1e-9)


def jaccard(items: np.ndarray, offsets: np.ndarray, threshold: float) -> np.ndarray:
    """Which pairs of the sets reach the threshold, exactly; the diagonal is false."""
    n = len(offsets) - 1
    size = np.diff(offsets)
    order = np.argsort(items, kind="stable")
    owner = text.row_of(offsets)[order]
    new = np.ones(len(items), bool)
    new[1:] = items[order][1:] != items[order][:-1]
    at = np.cumsum(new) - 1
    common = np.bincount(at) > 1 if len(at) else np.zeros(0, bool)
    keep = common[at]
    owner, at = owner[keep], (np.cumsum(common) - 1)[at[keep]]
    shared = np.zeros((n, n), np.float64)
    total = int(common.sum())
    for low in range(0, total, 8192):
        inside = slice(*np.searchsorted(at, [low, low + 8192]))
        block = np.zeros((n, min(8192, total - low)), np.float32)
        block[owner[inside], at[inside] - low] = 1
        shared += block @ block.T
    union = size[:, None] + size[None, :] - shared
    near = (shared > 0) & (shared >= threshold * union - 1e-9)
    np.fill_diagonal(near, False)
    return near


def wanted(ids: DataFrame, bits: int = 24):
    """A broadcast bitmap of the ids, to leave out most other records early; an exact join follows."""
    return ids.sparkSession.sparkContext.broadcast(spread.membership(ids, ids.columns[0], bits)), bits
