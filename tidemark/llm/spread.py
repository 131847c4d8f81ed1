"""Spark-side helpers: shared tables, membership bitmaps, connected components."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.text import mix, unsigned

SHARD_BITS = 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, only a session in one process gets one of our own."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder and not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return (folder or "/tmp/checkpoints/tidemark").rstrip("/")


def stored(df: DataFrame, name: str, codec: str = "snappy", level: int = 3) -> DataFrame:
    """Written to the shared folder and read back: lineage ends there and a lost executor costs nothing."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", codec).option("parquet.compression.codec.zstd.level", level).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def text_key() -> Column:
    """With doc_id, the key of a document's row; equal rows share it. A null text is an empty one."""
    return F.xxhash64(F.coalesce(F.col("text"), F.lit("")))


def slim(docs: DataFrame) -> DataFrame:
    """doc_id, text and text key, whatever other columns there are."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"), text_key().alias("th"))


def free_names(df: DataFrame, *names: str) -> list[str]:
    """Names like these that no column has, whatever its case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name in taken:
            name += "_"
        taken.add(name)
        out.append(name)
    return out


def apart(docs: DataFrame, keys: DataFrame, key: Column | None = None, bits: int = 24) -> tuple[DataFrame, DataFrame]:
    """The documents whose ``key``, or else text key, is, or by chance seems to be, among stored ``keys``, and all others, which need no join.

    A bitmap of fixed size tells; where it is full all documents are in the first part and only the join's shuffle is as large as without it."""
    bitmap = docs.sparkSession.sparkContext.broadcast(membership(keys, keys.columns[0], bits))

    @F.arrow_udf("boolean")
    def known(key: pa.Array) -> pa.Array:
        return pa.array(in_bitmap(bitmap.value, unsigned(key), bits))

    key = text_key() if key is None else key
    return docs.where(known(key)), docs.where(~known(key))


def partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def arrow_schema(fields: dict[str, pa.DataType]) -> pa.Schema:
    return pa.schema(list(fields.items()))


# --- count-min / membership bitmaps of a fixed width -----------------------


def cells(values: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Two cells of 2 ** bits for each 64-bit value."""
    x = mix(values ^ np.uint64(0xA0761D6478BD642F))
    low = np.uint64((1 << bits) - 1)
    return x & low, (x >> np.uint64(64 - bits)) & low


class Sketch:
    """Counts of one partition for two hash rows, kept sparse and saturating at ``least``."""

    def __init__(self, bits: int, least: int, hold: int = 1_000_000):
        self.bits, self.least, self.hold, self.parts, self.size = bits, least, hold, [], 0

    def add(self, values: np.ndarray) -> Iterator[pa.RecordBatch]:
        self.parts.append(values)
        self.size += len(values)
        if self.size >= self.hold:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if not self.size:
            return
        values = np.concatenate(self.parts)
        self.parts, self.size = [], 0
        shards, packed = [], []
        width = np.uint64((1 << SHARD_BITS) - 1)
        for row, cell in enumerate(cells(values, self.bits)):
            cell, count = np.unique(cell, return_counts=True)
            entry = ((cell & width).astype(np.uint32) << np.uint32(8)) | np.minimum(count, self.least).astype(np.uint32)
            shard = (cell >> np.uint64(SHARD_BITS)).astype(np.int64)
            cuts = np.flatnonzero(np.diff(shard, prepend=-1))
            for start, stop in zip(cuts, [*cuts[1:], len(shard)], strict=True):
                shards.append(row << 32 | int(shard[start]))
                packed.append(entry[start:stop].tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(shards, pa.int64()), pa.array(packed, pa.binary())], names=["shard", "cells"])


def merged_bitmap(parts: DataFrame, bits: int, least: int) -> list[np.ndarray]:
    """Adds up partition sketches shard by shard and brings back one bit for each cell,
    set where the sum reaches ``least``: 2 * 2 ** bits bits, whatever the input's size."""

    def merge(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for shard, packed in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                entry = np.frombuffer(packed.as_buffer(), np.uint32)
                total = sums.setdefault(shard, np.zeros(1 << SHARD_BITS, np.uint8))
                at = entry >> np.uint32(8)
                total[at] = np.minimum(total[at] + (entry & np.uint32(255)).astype(np.uint8), least)
        for shard, total in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int64()), pa.array([np.packbits(total >= least, bitorder="little").tobytes()], pa.binary())], names=["shard", "bits"])

    n = 1 << bits - SHARD_BITS
    out = [np.zeros((1 << bits) // 8, np.uint8) for _ in range(2)]
    for x in parts.repartition(min(2 * n, partitions(parts)), "shard").mapInArrow(merge, "shard long, bits binary").collect():
        row, shard = x["shard"] >> 32, x["shard"] & 0xFFFFFFFF
        size = 1 << SHARD_BITS - 3
        out[row][shard * size : (shard + 1) * size] = np.frombuffer(x["bits"], np.uint8)
    return out


def in_bitmap(bitmap: list[np.ndarray], values: np.ndarray, bits: int) -> np.ndarray:
    """True for each value whose two cells are set: for all that were counted often enough, and a few others."""
    out = np.ones(len(values), bool)
    for row, cell in zip(bitmap, cells(values, bits), strict=True):
        out &= (row[(cell >> np.uint64(3)).astype(np.int64)] >> (cell & np.uint64(7)).astype(np.uint8)) & 1 > 0
    return out


def membership(df: DataFrame, column: str, bits: int) -> list[np.ndarray]:
    """A bitmap of a non-null long column's values."""

    def count(batches):
        sketch = Sketch(bits, 1)
        for batch in batches:
            yield from sketch.add(unsigned(batch.column(0)))
        yield from sketch.flush()

    return merged_bitmap(df.select(column).mapInArrow(count, "shard long, cells binary"), bits, 1)


# --- connected components ---------------------------------------------------


def components(edges: DataFrame) -> DataFrame:
    """(id, label) of all ids of edges (a, b), the label being the least id that is connected.

    Large-star and small-star rounds: each node's neighbours are tied to its least neighbour
    until nothing changes. Links never leave the executors; each round's links are written to
    the shared folder, so that plans stay short and lost executors don't matter."""
    links = stored(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b"), "links")
    while True:
        ends = links.select(F.col("a").alias("u"), F.col("b").alias("m"), F.lit(False).alias("under")).union(links.select("b", F.lit(None).cast("long"), F.lit(True)))
        # a hub that is the least of its neighbours is not among these few, which get a shuffle of their own: so Spark can broadcast them or split hubs
        inner = ends.groupBy("u").agg(F.min("m").alias("m"), F.max("under").alias("under")).where("under and m is not null").select("u", "m").repartition("u")
        large = links.join(inner, F.col("b") == F.col("u"), "left").select("a", F.coalesce("m", "b").alias("b"), F.col("m").isNotNull().alias("moved"))
        large = large.repartition("a").groupBy("a", "b").agg(F.max("moved").alias("moved")).withColumn("m", F.min("b").over(Window.partitionBy("a")))
        other = F.col("b") > F.col("m")
        links = stored(large.select(F.when(other, F.col("b")).otherwise(F.col("a")).alias("a"), F.col("m").alias("b"), (other | F.col("moved")).alias("moved")), "links")
        moved, links = links.where("moved"), links.select("a", "b")
        if moved.isEmpty():
            break
    links = links.distinct()
    roots = links.select(F.col("b").alias("id")).distinct()
    return links.select(F.col("a").alias("id"), F.col("b").alias("label")).union(roots.select("id", F.col("id").alias("label")))
