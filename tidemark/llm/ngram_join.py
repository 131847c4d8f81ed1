"""N-gram Jaccard self-join of documents by chosen paths (op3).

A document is the set of its ``words``-word shingles (words: runs of non-space bytes, A-Z lower-cased;
a text of fewer words is one shingle). Each of several runs splits the sets by the MinHash tokens of sampled
bins: at the root each bin is drawn with probability 1 / (threshold * bins), so that two sets
at the threshold share one child on average, while others part quickly. Small buckets are compared by
brute force on the signatures; large ones shed what is all but equal to a pivot and are split again, by drawn
pairs of bins. Runs are repeated until the roots miss a pair at the threshold with less than 1 - ``recall``, and the draws
of each further split until all splits down to the last depth add less than half of that (with the runs and
draws of the default settings 8e-8 and 2e-5).
Whatever looks alike is then verified exactly, on whole shingle sets.

Equal word sequences are joined once, with their number as weight. Only ids of candidates pass a
bitmap of fixed size on the second reading; the exact join on the id follows.

Result: one row per document row: doc_id, class_id (least doc_id of its class), n_links (other
documents at the threshold, copies included). Defined cases: a null or empty text has no
set, no links and a class of its own; equal rows are links of each other; a null doc_id takes
part, and a class of null ids only has a null class_id; very long texts are whole sets; an empty table gives no rows;
columns may have any names.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import similar, spread, text

THRESHOLD, WORDS, BINS, RECALL = 0.8, 5, 64, 0.999


def runs_for(recall: float) -> int:
    """A run's root draws a Poisson number of shared tokens with mean one for a pair at the threshold."""
    return math.ceil(math.log(1 - recall) / -1.0)


def _draw(bins: int, threshold: float, run: int) -> list[int]:
    """Bins drawn at the root of a run."""
    u = text.mix(np.arange(bins, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1_000_003 * (run + 1))) / 2.0**64
    return np.flatnonzero(u < 1 / (threshold * bins)).tolist()


def split_draws(threshold: float, bins: int, recall: float) -> int:
    """Draws of each further split: a pair all of whose root buckets are large is lost below them with half of 1 - recall at most."""
    drawn = {i for run in range(runs_for(recall)) for i in _draw(bins, threshold, run)}
    return similar.draws_for(bins, threshold, len(drawn), 1, (1 - recall) / 2)


def _sets(column, words: int):
    buf, offsets = text.utf8(column)
    buf = text.LOWER[buf]
    starts, ends, rows = text.runs(text.NON_SPACE[buf], offsets)
    hashes = text.byte_hashes(buf, starts, ends)
    rid = text.sequence_hashes(hashes, rows[:-1], rows[1:])
    return rid, np.diff(rows), *text.shingles(hashes, rows, words)


def signatures(docs: DataFrame, words: int, bins: int) -> DataFrame:
    """(doc_id, th, rid, n, sig) of each document row; n is the number of words."""

    def sign(batches):
        for batch in batches:
            for part in text.slices(batch):
                rid, n, hashes, counts = _sets(part.column("text"), words)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("th"), text.longs(rid), text.longs(n), text.to_binary(text.one_permutation(hashes, counts, bins))], names=["doc_id", "th", "rid", "n", "sig"])

    return spread.slim(docs).mapInArrow(sign, "doc_id long, th long, rid long, n long, sig binary")


def shingle_sets(docs: DataFrame, rids: DataFrame, words: int) -> DataFrame:
    """(rid, items) of documents whose rid is (nearly always) among ``rids``: sorted distinct hashes."""
    bitmap, bits = similar.wanted(rids)

    def sets(batches):
        for batch in batches:
            for part in text.slices(batch):
                rid, _, hashes, counts = _sets(part.column("text"), words)
                take = spread.in_bitmap(bitmap.value, rid, bits)
                _, first = np.unique(rid, return_index=True)
                once = np.zeros(len(rid), bool)
                once[first] = True
                take &= once
                hashes, at = similar.distinct_sets(hashes[np.repeat(take, counts)], counts[take])
                yield pa.RecordBatch.from_arrays([text.longs(rid[take]), text.blobs(hashes.view(np.uint8), 8 * at)], names=["rid", "items"])

    return spread.slim(docs).select("text").mapInArrow(sets, "rid long, items binary")


def classes(docs: DataFrame, threshold: float = THRESHOLD, words: int = WORDS, bins: int = BINS, recall: float = RECALL) -> DataFrame:
    """doc_id, th, rid, label, n, class_id, n_links of each document row."""
    base = spread.stored(signatures(docs, words, bins), "signatures")
    records = base.where("n > 0").groupBy("rid").agg(F.count(F.lit(1)).alias("weight"), F.first("sig").alias("sig"))
    records = spread.stored(records, "records")
    tokens = [similar.token(F.lit(run), i, 4) for run in range(runs_for(recall)) for i in _draw(bins, threshold, run)]
    buckets = records.select(F.explode(F.array(*tokens)).alias("path"), "rid")

    edges = similar.candidates(records, buckets, bins, np.uint32, split_draws(threshold, bins, recall))
    groups = similar.counted(edges)
    sets = shingle_sets(docs, groups.select("rid"), words).join(groups, "rid").groupBy("rid").agg(F.first("grp").alias("grp"), F.first("c").alias("c"), F.first("items").alias("items"))
    linked = similar.exact(sets.join(records.select("rid", "weight"), "rid"), threshold)
    keyed = base.select("doc_id", "th", "rid", "n").join(records.select("rid", "weight"), "rid", "left").join(linked, "rid", "left")
    keyed = spread.stored(keyed.select("doc_id", "th", "rid", "n", F.coalesce("label", "rid").alias("label"), F.when(F.col("n") > 0, F.col("weight") - 1 + F.coalesce("links", F.lit(0))).otherwise(0).cast("long").alias("n_links")), "classes")
    least = keyed.where("n > 0 and n_links > 0").groupBy("label").agg(F.min("doc_id").alias("least"))
    return keyed.join(least, "label", "left").select("doc_id", "th", "rid", "label", "n", F.when((F.col("n") > 0) & (F.col("n_links") > 0), F.col("least")).otherwise(F.col("doc_id")).alias("class_id"), "n_links")


def one_of_each(docs: DataFrame, **settings) -> DataFrame:
    """One document of each class, first by (doc_id, text hash), with its own columns; of equal rows one."""
    found = spread.stored(classes(docs, **settings).where("n_links > 0").select("doc_id", "th", "label"), "linked")
    first = found.groupBy("label").agg(F.min(F.struct("doc_id", "th")).alias("first"))
    places = found.groupBy("label", F.struct("doc_id", "th").alias("place")).agg(F.count(F.lit(1)).alias("rows")).join(first, "label")
    d, h, n = spread.free_names(docs, "d", "h", "rows")
    # 0 for those that go, and the number of equal rows for those that stay
    told = places.select(F.col("place.doc_id").alias(d), F.col("place.th").alias(h), F.when(F.col("place") == F.col("first"), F.col("rows")).otherwise(F.lit(0)).alias(n)).where(F.col(n) != 1)
    told = spread.stored(told, "told")
    likely, others = spread.apart(docs, told.select(h))
    joined = likely.join(told, F.col("doc_id").cast("long").eqNullSafe(F.col(d)) & (spread.text_key() == F.col(h)), "left").where(F.coalesce(n, F.lit(1)) != 0)
    columns = [F.col(f"`{c}`") for c in docs.columns]
    single, equal = joined.where(F.col(n).isNull()), joined.where(F.col(n).isNotNull())
    return others.union(single.select(*columns)).union(equal.dropDuplicates([d, h]).select(*columns))


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "class_id", "n_links")
