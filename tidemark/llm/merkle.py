"""Merkle manifest of a dataset as a persistent tree (op12).

A leaf is the sha256 of a document's doc_id, source, lang, n_chars and text, each ``-`` if null, else its number of UTF-8 bytes,
``:`` and its value. Within a source leaves ascend by doc_id; every three consecutive nodes (the last run: fewer, even one) are hashed
to their parent until one remains, the source's subroot; the subroots, ordered by source, make the dataset's tree likewise.
Digests are concatenated as lowercase hex.

Positions come from one range partitioning and counts of (source, partition), so no task holds a source. A tree is built from
blocks of 3 ** ``LEVELS`` aligned leaves, each in one task, whose tops are the next tier's leaves. Paths (each node's place in its run
and its siblings) then go down tier by tier, one row a block joined to the block's nodes. A change of a leaf makes a new version of
the tree by path copying: in the leaf's block only its ancestors are copied, then the version goes on through the copies of upper
tiers' nodes along its block's path; all other nodes are the base tree's own. Every version has one changed leaf.

``tree`` keeps the tiers, ``versions`` gives each document's digests and the nodes that its version copied.
Defined cases: a null source is a source of its own, before all others, a null doc_id comes first in its source and isn't tampered; equal doc_ids
of a source are ordered by leaf, equal rows are leaves of their own; a null text has no newlines, an empty one is ``0:``; a change that leaves a
leaf as it is makes no version; a lone leaf is its source's subroot, a lone subroot the root, and the proof of a lone leaf of a lone source
is the hash of nothing; very long texts are hashed whole; an empty table gives no rows; other columns are left out, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm import spread, text

ARITY, LEVELS = 3, 7
#: Nodes that a task takes up at a time: whole blocks, until there are so many bytes of digests.
SLICE = 1 << 19


def leaf(*values: Column) -> Column:
    """Digest of a row's values, as 32 bytes."""
    parts = []
    for value in values:
        value = value.cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-")))
    return F.unhex(F.sha2(F.concat(*parts).cast("binary"), 256))


def tampered() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0, F.lit(False))


def without_newlines() -> Column:
    return F.regexp_replace("text", "\n", "")


def leaves(docs: DataFrame, changed: Column | None = None, text_then: Column | None = None) -> DataFrame:
    """doc_id, source, leaf and, where ``changed``, the leaf ``then`` (null otherwise, or where it is the same) of each document."""
    fields = [F.col("doc_id").cast("long"), F.col("source"), F.col("lang"), F.col("n_chars").cast("long")]
    then = F.lit(None).cast("binary") if changed is None else F.when(changed, leaf(*fields, text_then))
    rows = docs.select(fields[0].alias("doc_id"), F.col("source").cast("string").alias("source"), leaf(*fields, F.col("text")).alias("leaf"), then.alias("then"))
    return rows.withColumn("then", F.when(F.col("then") != F.col("leaf"), F.col("then")))


def placed(rows: DataFrame) -> DataFrame:
    """The rows with part (number of their source in its order), pos (their number in it) and n (leaves of the source), stored."""
    rows = spread.stored(rows, "leaves")
    order = [F.asc_nulls_first("source"), F.asc_nulls_first("doc_id"), F.asc("leaf")]
    ranges = rows.repartitionByRange(spread.partitions(rows), *order).sortWithinPartitions(*order)
    rows = spread.stored(ranges.withColumn("id", F.monotonically_increasing_id()), "ordered")
    pid = F.shiftrightunsigned("id", 33)
    runs = spread.stored(rows.groupBy(F.col("source").alias("s"), pid.alias("pid")).agg(F.min("id").alias("low"), F.count(F.lit(1)).alias("c")), "runs")
    own = Window.partitionBy("s").orderBy("pid")
    runs = runs.select("s", "pid", "low", F.coalesce(F.sum("c").over(own.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"), F.sum("c").over(Window.partitionBy("s")).alias("n"), F.first("pid").over(own).alias("first"))
    # sources are numbered within the partition in which they begin, and partitions, a bounded number, by how many begin before
    starts = runs.where("pid = first").select("s", "pid", (F.row_number().over(Window.partitionBy("pid").orderBy(F.asc_nulls_first("s"))) - 1).alias("number"))
    begun = starts.groupBy("pid").agg(F.count(F.lit(1)).alias("begun"))
    begun = begun.select(F.col("pid").alias("first"), F.coalesce(F.sum("begun").over(Window.orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("sources"))
    starts = starts.select(F.col("s").alias("t"), F.col("pid").alias("first"), "number").join(begun, "first")
    runs = runs.join(starts.drop("first"), F.col("s").eqNullSafe(F.col("t"))).select("s", "pid", "low", "before", "n", (F.col("sources") + F.col("number")).cast("long").alias("part"))
    joined = rows.withColumn("at", pid).join(runs, F.col("source").eqNullSafe(F.col("s")) & (F.col("at") == F.col("pid")))
    return spread.stored(joined.select("doc_id", "source", "leaf", "then", "part", (F.col("id") - F.col("low") + F.col("before")).alias("pos"), "n"), "placed")


def _hash(digests: list[bytes]) -> bytes:
    return hashlib.sha256(b"".join(digests).hex().encode()).digest()


def height(n: int) -> int:
    """Levels above n leaves."""
    out = 0
    while n > 1:
        n, out = -(-n // ARITY), out + 1
    return out


def _levels(nodes: list[bytes], n: int, most: int) -> list[list[bytes]]:
    """A block's nodes, level by level: up to ``most`` above the given ones, or to the root of a tree of n."""
    out = [nodes]
    for _ in range(min(most, height(n))):
        below = out[-1]
        out.append([_hash(below[i : i + ARITY]) for i in range(0, len(below), ARITY)])
    return out


def _block(levels: int) -> Column:
    """Number of a node's block: of its tree and within it."""
    return F.col("part") * F.lit(1 << 32) + F.expr(f"pos div {ARITY**levels}")


def _blocks(batches: Iterator[pa.RecordBatch], sized: str) -> Iterator[tuple[pa.Table, int, int]]:
    """Whole blocks of a partition sorted by block: a table, first and last row."""
    for table in text.whole_groups(batches, "block", sized, SLICE):
        block = np.asarray(table.column("block"))
        cuts = np.append(np.flatnonzero(np.append(True, block[1:] != block[:-1])), len(block)).tolist()
        for low, high in zip(cuts, cuts[1:], strict=False):
            yield table, low, high


def tops(nodes: DataFrame, levels: int) -> DataFrame:
    """(part, pos, n, node) one tier up: each block's top, numbered in its tree, and how many tops the tree has."""
    width = ARITY**levels

    def top(batches):
        for table, low, high in _blocks(batches, "node"):
            n = table.column("n")[low].as_py()
            yield pa.RecordBatch.from_pydict({
                "part": pa.array([table.column("part")[low].as_py()], pa.int64()),
                "pos": pa.array([table.column("pos")[low].as_py() // width], pa.int64()),
                "n": pa.array([-(-n // width)], pa.int64()),
                "node": pa.array([_levels(table.column("node").slice(low, high - low).to_pylist(), n, levels)[-1][0]], pa.binary()),
            })

    rows = nodes.select("part", "pos", "n", "node", _block(levels).alias("block")).repartition("block").sortWithinPartitions("block", "pos")
    return rows.mapInArrow(top, "part long, pos long, n long, node binary")


def tiers(nodes: DataFrame, levels: int) -> list[DataFrame]:
    """Stored (part, pos, n, node) of each tier, down from the leaves to the roots of all trees."""
    out = [nodes]
    while len(out) == 1 or not out[-1].where("n > 1").isEmpty():
        out.append(spread.stored(tops(out[-1], levels), "tops"))
    return out


def _paths(levels: list[list[bytes]]) -> list[bytes]:
    """Each leaf's path within its block: a level's place in the run and length of the run as one byte each, then the siblings."""
    out = [b""] * len(levels[-1])
    for below in reversed(levels[:-1]):
        parent, out = out, []
        for i in range(len(below)):
            run = i - i % ARITY
            siblings = below[run : i] + below[i + 1 : run + ARITY]
            out.append(bytes((i % ARITY, len(siblings))) + b"".join(siblings) + parent[i // ARITY])
    return out


def steps(path: bytes) -> Iterator[tuple[int, list[bytes]]]:
    """Place in the run and siblings, level by level."""
    at = 0
    while at < len(path):
        place, count = path[at], path[at + 1]
        yield place, [path[at + 2 + 32 * i : at + 34 + 32 * i] for i in range(count)]
        at += 2 + 32 * count


def proof(path: bytes) -> bytes:
    return _hash([x for _, siblings in steps(path) for x in siblings])


def copied(node: bytes, path: bytes) -> list[bytes]:
    """Digests of the ancestors that a version with this leaf copies, up to its root."""
    out = []
    for place, siblings in steps(path):
        node = _hash([*siblings[:place], node, *siblings[place:]])
        out.append(node)
    return out


def folded(node: bytes, path: bytes) -> bytes:
    """The root that a leaf and the siblings on its path make."""
    return copied(node, path)[-1] if path else node


def _descend(nodes: DataFrame, above: DataFrame, levels: int, function, schema: str) -> DataFrame:
    """function(a block's rows, their paths to the root of all, subroot) for each block; above: (part, pos, path, subroot) of its top."""
    keep = [c for c in nodes.columns if c not in ("part", "pos", "n", "node")]

    def go(batches):
        for table, low, high in _blocks(batches, "node"):
            head, subroot = table.column("path")[low].as_py(), table.column("subroot")[low].as_py()
            here = table.slice(low + 1, high - low - 1).combine_chunks()
            paths = _paths(_levels(here.column("node").to_pylist(), here.column("n")[0].as_py(), levels))
            yield function(here, [x + head for x in paths], subroot)

    rows = nodes.select("part", "pos", "n", "node", *keep, F.lit(None).cast("binary").alias("path"), F.lit(None).cast("binary").alias("subroot"), _block(levels).alias("block"))
    # a block's head comes before its nodes
    heads = above.select("part", F.lit(-1).cast("long").alias("pos"), "path", "subroot", (F.col("part") * F.lit(1 << 32) + F.col("pos")).alias("block"))
    rows = rows.unionByName(heads, allowMissingColumns=True).repartition("block").sortWithinPartitions("block", "pos")
    return rows.mapInArrow(go, schema)


def paths(tiers_: list[DataFrame], above: DataFrame, down_to: int, levels: int) -> DataFrame:
    """(part, pos, path, subroot) of the nodes of a tier: their paths up to the root of all, ``above`` being those of the trees' roots."""

    def told(here, found, subroot):
        return pa.RecordBatch.from_pydict({"part": here.column("part").chunk(0), "pos": here.column("pos").chunk(0), "path": pa.array(found, pa.binary()), "subroot": pa.array([subroot] * len(found), pa.binary())})

    for tier in reversed(tiers_[down_to:-1]):
        above = spread.stored(_descend(tier, above, levels, told, "part long, pos long, path binary, subroot binary"), "paths")
    return above


class Tree:
    """Leaves in their places, the tiers of all sources' trees, those of the tree of subroots, and the root (None for no documents)."""

    def __init__(self, rows: DataFrame, levels: int = LEVELS):
        self.rows, self.levels = placed(rows), levels
        self.tiers = tiers(self.rows.select("part", "pos", "n", F.col("leaf").alias("node")), levels)
        subroots = self.tiers[-1]
        n = subroots.count()
        self.upper = tiers(subroots.select(F.lit(0).cast("long").alias("part"), F.col("part").alias("pos"), F.lit(n).cast("long").alias("n"), "node"), levels)
        top = self.upper[-1].head()
        self.root = top and bytes(top["node"])

    def versions(self) -> DataFrame:
        """doc_id, source, part, pos, leaf, subroot, proof, ``copied`` and ``folded`` of each document. copied: digests of the nodes that its own version of the
        tree copied, from its leaf's parent up to the version's root; null where the leaf didn't change and there is no version. folded: the root
        recomputed from the leaf, the changed one where there is one, and the siblings on its path."""
        top = self.upper[-1].select("part", "pos", F.lit(b"").alias("path"), F.lit(None).cast("binary").alias("subroot"))
        above = paths(self.upper, top, 0, self.levels).select(F.col("pos").alias("part"), F.lit(0).cast("long").alias("pos"), "path")
        above = paths(self.tiers, above.join(self.tiers[-1].select("part", F.col("node").alias("subroot")), "part"), 1, self.levels)

        def finish(here, found, subroot):
            then, node = here.column("then").to_pylist(), here.column("node").to_pylist()
            return pa.RecordBatch.from_pydict({
                **{c: here.column(c).chunk(0) for c in ("doc_id", "source", "part", "pos")},
                "leaf": here.column("node").chunk(0),
                "subroot": pa.array([subroot] * len(found), pa.binary()),
                "proof": pa.array([proof(x) for x in found], pa.binary()),
                "copied": pa.array([None if t is None else [t, *copied(t, x)] for t, x in zip(then, found, strict=True)], pa.list_(pa.binary())),
                "folded": pa.array([folded(own if t is None else t, x) for own, t, x in zip(node, then, found, strict=True)], pa.binary()),
            })

        rows = self.rows.select("part", "pos", "n", F.col("leaf").alias("node"), "doc_id", "source", "then")
        return _descend(rows, above, self.levels, finish, "doc_id long, source string, part long, pos long, leaf binary, subroot binary, proof binary, copied array<binary>, folded binary")


def tree(docs: DataFrame, changed: Column | None = None, text_then: Column | None = None, levels: int = LEVELS) -> Tree:
    """The manifest of documents and, where ``changed``, of versions in which their text is ``text_then``."""
    return Tree(leaves(docs, changed, text_then), levels)


def checked(found: Tree) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root and verified of each document, in hex; folded_root is recomputed from each leaf and its path."""
    digest = [F.lower(F.hex(c)).alias(name) for c, name in (("leaf", "leaf"), ("subroot", "subroot"), (F.lit(found.root), "root"), ("proof", "proof_sha256"), ("folded", "folded_root"))]
    return found.versions().select("doc_id", *digest).withColumn("verified", F.col("folded_root") == F.col("root"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checked(tree(spark.read.parquet(f"{sf_dir}/documents.parquet"), tampered(), without_newlines()))
