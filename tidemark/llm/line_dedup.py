"""Fuzzy line dedup by MinHash (op1).

Lines are stripped of spaces; blank ones are left alone. A line's set has its shingles of
``chars`` characters (a shorter line is one shingle). Each distinct line gets a one-permutation MinHash
signature, cut into bands; lines that share a band's bucket are compared by exact Jaccard similarity, within the bucket.
Large buckets are split by signatures, by as many draws as keep what that adds to the misses of the bands below ``MORE_MISSED``. Distributed union-find over the
verified links makes components; of each, the occurrence that is first by (doc_id, text
hash, line number) stays and all others go, wherever they are.

A line that stands everywhere is one record: signatures, bands and verification work on
distinct lines, and only (line hash, document, line number) is kept for each place. First places are
aggregated by component, with partial sums before the shuffle.

Defined cases: a null or empty text has no lines; equal rows (same doc_id and text) are one
document, and get the same verdicts; a null doc_id sorts first; very long lines are whole
sets; an empty table gives no rows; documents may end up empty; other columns pass through ``dedup_lines``, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import similar, spread, text

CHARS, BANDS, ROWS, THRESHOLD = 8, 8, 3, 0.8
#: What the splitting of large buckets may add to the share of pairs that the bands miss (0.004 at the threshold).
MORE_MISSED = 0.002
#: Bytes of text that are shingled at once: each gives a shingle, and a few numbers with it.
SLICE = 1 << 18


def _lines(column):
    """Buffer, starts and ends of non-blank stripped lines, offsets of each row's, and their numbers in the text."""
    buf, offsets = text.utf8(column)
    newline = np.flatnonzero(buf == 0x0A)
    row = np.searchsorted(offsets, newline, "right") - 1
    per = np.bincount(row, minlength=len(offsets) - 1) + 1
    owner = np.repeat(np.arange(len(per)), per)
    first = np.append(0, np.cumsum(per))
    starts, ends = np.empty(first[-1], np.int64), np.empty(first[-1], np.int64)
    head, tail = np.zeros(first[-1], bool), np.zeros(first[-1], bool)
    head[first[:-1]], tail[first[1:] - 1] = True, True
    starts[head], starts[~head] = offsets[:-1], newline + 1
    ends[tail], ends[~tail] = offsets[1:], newline
    starts, ends = _stripped(buf, starts, ends)
    full = np.flatnonzero(ends > starts)
    return buf, starts[full], ends[full], np.searchsorted(owner[full], np.arange(len(offsets))), full - first[owner[full]]


def _stripped(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray):
    """The ranges without spaces at either end; most have few, which are taken off one by one, and long runs of them are found at once."""
    for _ in range(16):
        left = np.flatnonzero(starts < ends)
        left = left[text.SPACE[buf[starts[left]]]]
        right = np.flatnonzero(starts < ends)
        right = right[text.SPACE[buf[ends[right] - 1]]]
        if not len(left) and not len(right):
            return starts, ends
        starts[left] += 1
        right = right[ends[right] > starts[right]]
        ends[right] -= 1
    solid = np.flatnonzero(text.NON_SPACE[buf])
    low, high = np.searchsorted(solid, starts), np.searchsorted(solid, ends)
    full = high > low
    starts[full], ends[full] = solid[low[full]], solid[high[full] - 1] + 1
    ends[~full] = starts[~full]
    return starts, ends


def _shingles(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, chars: int):
    """Hashes of character shingles of byte ranges that don't overlap, in order, and how many each has; a shorter range is one shingle."""
    codes, inner = text.code_points(buf)
    low, high = starts - np.searchsorted(inner, starts), ends - np.searchsorted(inner, ends)
    grams = text.char_grams(codes, chars)
    count = np.maximum(high - low - chars + 1, 1)
    whole = high - low >= chars
    hashes = grams[text.inside(len(grams), low[whole], high[whole] - chars + 1)]
    if whole.all():
        return hashes, count
    out = np.empty(int(count.sum()), np.uint64)
    own = np.zeros(len(out), bool)
    own[(np.cumsum(count) - count)[~whole]] = True
    out[~own], out[own] = hashes, text.range_hashes(buf, starts[~whole], ends[~whole], 7)
    return out, count


def _line_rows(chars: int, bands: int, rows_: int):
    def rows_of(batches):
        for batch in batches:
            for part in text.slices(batch, limit=SLICE):
                buf, starts, ends, rows, number = _lines(part.column("text"))
                lid = text.range_hashes(buf, starts, ends)
                _, first = np.unique(lid, return_index=True)
                first.sort()
                sig = text.one_permutation(*_shingles(buf, starts[first], ends[first], chars), bands * rows_).astype(np.uint16)
                packed = np.zeros((len(first), bands, 4), np.uint16)
                packed[:, :, :rows_] = sig.reshape(-1, bands, rows_)
                size = np.zeros(len(lid) + part.num_rows, np.int64)
                size[first] = bands
                data = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(size)).astype(np.int32)), pa.array(packed.view(np.int64).reshape(-1)))
                row = np.append(text.row_of(rows), np.arange(part.num_rows))
                owners = pa.array(row)
                head = np.arange(len(row)) >= len(lid)
                lids = pa.array(np.append(lid.view(np.int64), np.zeros(part.num_rows, np.int64)), mask=head)
                yield pa.RecordBatch.from_arrays([lids, part.column("doc_id").take(owners), part.column("th").take(owners), pa.array(np.append(number, np.diff(rows)).astype(np.int32)), data], names=["lid", "doc_id", "th", "no", "bands"])

    return rows_of


def _unpacked(bands: int, rows_: int):
    """A band's values are 16 bits each, in one long; as one signature of all bands."""

    def unpack(batches):
        for batch in batches:
            packed = np.stack([np.asarray(batch.column(f"b{i}")) for i in range(bands)], 1).view(np.uint16).reshape(-1, bands, 4)
            yield pa.RecordBatch.from_arrays([batch.column("rid"), text.to_binary(packed[:, :, :rows_].reshape(-1, bands * rows_))], names=["rid", "sig"])

    return unpack


def _wanted_lines(bitmap, bits: int):
    def rows_of(batches):
        for batch in batches:
            for part in text.slices(batch, limit=SLICE):
                buf, starts, ends, *_ = _lines(part.column("text"))
                lid = text.range_hashes(buf, starts, ends)
                _, first = np.unique(lid, return_index=True)
                first = first[spread.in_bitmap(bitmap.value, lid[first], bits)]
                data = pa.array([buf[a:b].tobytes() for a, b in zip(starts[first], ends[first], strict=True)], pa.binary())
                yield pa.RecordBatch.from_arrays([text.longs(lid[first]), data], names=["rid", "items"])

    return rows_of


def _decoder(chars: int):
    def decode(column):
        buf, offsets = text.utf8(column)
        return similar.distinct_sets(*_shingles(buf, offsets[:-1], offsets[1:], chars))

    return decode


def duplicate_lines(docs: DataFrame, chars: int = CHARS, bands: int = BANDS, rows: int = ROWS, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, th, n_lines and the numbers of lines to remove, for every document row. ``rows``, of a band, are 4 at most."""
    own, bins = spread.slim(docs), bands * rows
    lines = spread.stored(own.mapInArrow(_line_rows(chars, bands, rows), "lid long, doc_id long, th long, no int, bands array<long>"), "lines")
    placed = lines.where("lid is not null")
    # a band is a long, so that the aggregate is by hashing
    each = placed.where("size(bands) > 0").select(F.col("lid").alias("rid"), *(F.col("bands")[i].alias(f"b{i}") for i in range(bands)))
    records = spread.stored(each.groupBy("rid").agg(*(F.first(f"b{i}").alias(f"b{i}") for i in range(bands))), "records")
    paths = F.array(*(F.xxhash64(F.lit(i), f"b{i}") for i in range(bands)))
    draws = similar.draws_for(bins, threshold, bands, rows, MORE_MISSED)
    small, ties = similar.in_buckets(lambda rids: records.join(rids, "rid", "left_semi").mapInArrow(_unpacked(bands, rows), "rid long, sig binary"), records.select(F.explode(paths).alias("path"), "rid"), bins, np.uint16, draws)
    wanted = small.select("rid") if ties is None else small.select("rid").union(ties.select("a")).union(ties.select("b"))
    bitmap, bits = similar.wanted(wanted)
    whole = own.select("text").mapInArrow(_wanted_lines(bitmap, bits), "rid long, items binary")
    items = spread.stored(whole.groupBy("rid").agg(F.first("items").alias("items")), "items")
    edges = similar.bucket_links(small, items, threshold, _decoder(chars))
    if ties is not None:
        groups = similar.counted(ties)
        members = items.join(groups, "rid").withColumn("weight", F.lit(1).cast("long"))
        edges = edges.union(similar.group_links(members, threshold, _decoder(chars)).where("rid != tied").select("rid", "tied"))
    linked = spread.components(edges).withColumnRenamed("id", "lid")
    # stored, so that joins have a plain shuffle on both sides: Spark then splits a line or component that stands everywhere
    known = placed.groupBy("lid").agg(F.count(F.lit(1)).alias("c")).join(linked, "lid", "left").where("c > 1 or label is not null").select("lid", F.coalesce("label", "lid").alias("label"))
    places = spread.stored(placed.select("lid", F.struct("doc_id", "th", "no").alias("place")).join(spread.stored(known, "known"), "lid").select("label", "place"), "places")
    firsts = spread.stored(places.groupBy("label").agg(F.min("place").alias("first")), "firsts")
    gone = places.join(firsts, "label").where("place != first").groupBy("place.doc_id", "place.th").agg(F.sort_array(F.collect_set("place.no")).alias("removed")).withColumnsRenamed({"doc_id": "d", "th": "h"})
    heads = lines.where("lid is null").select("doc_id", "th", F.col("no").cast("long").alias("n_lines"))
    return heads.join(gone, heads.doc_id.eqNullSafe(gone.d) & (heads.th == gone.h), "left").select("doc_id", "th", "n_lines", F.coalesce("removed", F.expr("cast(array() as array<int>)")).alias("removed"))


def dedup_lines(docs: DataFrame, **settings) -> DataFrame:
    """The documents without their duplicate lines; those of which nothing is left go, n_chars follows the text.

    Other columns pass through, whatever their names; a document that was blank before stays as it is."""
    d, h, gone = spread.free_names(docs, "d", "h", "removed")
    found = spread.stored(duplicate_lines(docs, **settings).where(F.size("removed") > 0).select(F.col("doc_id").alias(d), F.col("th").alias(h), F.col("removed").alias(gone)), "gone")
    touched, others = spread.apart(docs, found.select(h))
    joined = touched.join(found.dropDuplicates([d, h]), F.col("doc_id").cast("long").eqNullSafe(F.col(d)) & (spread.text_key() == F.col(h)), "left")
    left = F.array_join(F.filter(F.split("text", "\n"), lambda line, i: ~F.array_contains(gone, i)), "\n")
    out = joined.withColumn("text", F.when(F.col(gone).isNull(), F.col("text")).otherwise(left))
    out = out.where(F.col(gone).isNull() | F.col("text").rlike(r"\S"))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col(gone).isNull(), F.col("n_chars")).otherwise(F.length("text")).cast(docs.schema["n_chars"].dataType))
    return others.union(out.select(*(F.col(f"`{c}`") for c in docs.columns)))


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = duplicate_lines(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "n_lines", F.size("removed").cast("long").alias("n_removed"), F.array_join(F.col("removed").cast("array<string>"), ",").alias("removed"))
