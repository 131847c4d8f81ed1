"""Removal of repeated word windows (op9): a count-min prefilter, then exact grouping.

Words are runs of non-space bytes, unchanged. A window is ``window`` consecutive words of one
document. Every word inside a window whose word sequence also starts somewhere else, in
the same document too, goes.

1. A window's *anchor* is the least hash among the ``gram``-word grams inside it, so equal
   windows have equal anchors, and windows that follow each other mostly share one: such a
   *run* is one entry, and two if it holds a window twice. Each partition counts its runs' anchors in a
   count-min sketch of fixed width. The merged sketch is never below an anchor's count, and that is two
   at least for a window that stands twice, in one run or in two: none is lost.
2. Runs whose anchor is estimated at two or more are grouped exactly, first as whole runs, then (where one anchor has different runs) window by window,
   by the 64-bit anchor and another 64-bit hash. Nothing that repeats can be lost; a full
   sketch would only pass on more runs. Each slice sends a run once with all its places, so
   a passage that a third of all documents share is a few rows a partition.

Defined cases: a null or empty text has no words; a document of fewer words than a window
keeps all; equal rows (same doc_id and text) each count as a place and get equal results;
a null doc_id is kept as a key of its own; a very long text is whole; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm import spread, text

WINDOW, GRAM, BITS, LONGEST_RUN = 35, 20, 26, 64


def _word_hashes(column):
    buf, offsets = text.utf8(column)
    starts, ends, rows = text.runs(text.NON_SPACE[buf], offsets)
    return buf, offsets, starts, ends, rows, text.byte_hashes(buf, starts, ends)


def _runs(words: np.ndarray, rows: np.ndarray, window: int, gram: int):
    """First window, number of windows and anchor of each run of windows that share an anchor."""
    none = np.zeros(0, np.int64)
    if len(words) < window:
        return none, none, np.zeros(0, np.uint64)
    least, width, want = text.gram_hashes(words, gram), 1, window - gram + 1
    while width < want:
        step = min(width, want - width)
        least = np.minimum(least[:-step], least[step:])
        width += step
    row = text.row_of(rows)
    at = np.flatnonzero(np.arange(len(least)) + window <= rows[1:][row[: len(least)]])
    if not len(at):
        return none, none, np.zeros(0, np.uint64)
    anchor = least[at]
    new = np.ones(len(at), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (at[1:] != at[:-1] + 1) | (row[at[1:]] != row[at[:-1]])
    first = np.flatnonzero(new)
    run = np.cumsum(new) - 1
    new |= (np.arange(len(at)) - first[run]) % LONGEST_RUN == 0
    first = np.flatnonzero(new)
    return at[first], np.diff(np.append(first, len(at))), anchor[first]


def _windows(words: np.ndarray, s: np.ndarray, n: np.ndarray, window: int):
    """Hashes of all windows by where they start, and which runs hold one of them twice."""
    hashes = text.gram_hashes(words, window)
    bounds = np.append(0, np.cumsum(n))
    place = np.repeat(s - bounds[:-1], n)
    place += np.arange(bounds[-1])
    each, twice = hashes[place], np.zeros(len(s), bool)
    for gap in range(1, int(n.max(initial=1))):  # only in periodic text is a run longer than window - gram + 1
        same = np.flatnonzero(each[gap:] == each[:-gap])
        if len(same):
            owner = np.searchsorted(bounds, same, "right")
            twice[owner[owner == np.searchsorted(bounds, same + gap, "right")] - 1] = True
    return hashes, twice


def repeated_intervals(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, bits: int = BITS) -> DataFrame:
    """(d, h, spans): for each document with repeated windows, their places as (s, n): n windows from word s on."""

    def sketch(batches):
        counts = spread.Sketch(bits, 2)
        for batch in batches:
            for part in text.slices(batch):
                *_, rows, words = _word_hashes(part.column("text"))
                s, n, anchor = _runs(words, rows, window, gram)
                yield from counts.add(np.concatenate([anchor, anchor[_windows(words, s, n, window)[1]]]))
        yield from counts.flush()

    bitmap = docs.sparkSession.sparkContext.broadcast(spread.merged_bitmap(docs.select("text").mapInArrow(sketch, "shard long, cells binary"), bits, 2))

    def candidates(batches):
        for batch in batches:
            for part in text.slices(batch):
                *_, rows, words = _word_hashes(part.column("text"))
                s, n, anchor = _runs(words, rows, window, gram)
                hashes, twice = _windows(words, s, n, window)
                take = np.flatnonzero(spread.in_bitmap(bitmap.value, anchor, bits))
                if not len(take):
                    continue
                whole = text.sequence_hashes(words, s[take], s[take] + n[take] + window - 1)
                order = np.lexsort((whole, anchor[take]))
                take, whole = take[order], whole[order]
                new = np.ones(len(take), bool)
                new[1:] = (whole[1:] != whole[:-1]) | (anchor[take[1:]] != anchor[take[:-1]])
                group = np.flatnonzero(new)
                lead = take[group]
                row = text.row_of(rows)[s[take]]
                places = pa.StructArray.from_arrays(
                    [part.column("doc_id").take(pa.array(row)), part.column("th").take(pa.array(row)), pa.array((s[take] - rows[row]).astype(np.int32)), pa.array(n[take].astype(np.int32))], names=["d", "h", "s", "n"]
                )
                at = np.append(group, len(take)).astype(np.int32)
                size = n[lead]
                ends = np.append(0, np.cumsum(size))
                inner = hashes[np.repeat(s[lead] - ends[:-1], size) + np.arange(ends[-1])]
                yield pa.RecordBatch.from_arrays(
                    [text.longs(anchor[lead]), text.longs(whole[group]), text.longs(np.diff(at).astype(np.int64)), pa.array(twice[lead]), pa.ListArray.from_arrays(pa.array(at), places), pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), text.longs(inner))],
                    names=["m", "run", "cnt", "twice", "places", "windows"],
                )

    found = docs.mapInArrow(candidates, "m long, run long, cnt long, twice boolean, places array<struct<d:long,h:long,s:int,n:int>>, windows array<long>")
    by_anchor, by_run = Window.partitionBy("m"), Window.partitionBy("m", "run")
    found = (
        found.withColumn("total", F.sum("cnt").over(by_run))
        .withColumn("mixed", (F.min("run").over(by_anchor) != F.max("run").over(by_anchor)) & (F.min("total").over(by_anchor) == 1))
        .where("total > 1 or mixed or twice")
    )
    none = F.lit(None).cast("long")
    as_run = F.when(F.col("total") > 1, F.transform("places", lambda p: F.struct(p["d"].alias("d"), p["h"].alias("h"), p["s"].alias("s"), p["n"].alias("n"), none.alias("w"), F.lit(2).alias("weight"))))
    first = F.col("places")[0]
    as_windows = F.when(
        F.col("mixed") | F.col("twice"),
        F.transform("windows", lambda w, i: F.struct(first["d"].alias("d"), first["h"].alias("h"), (first["s"] + i).alias("s"), F.lit(1).alias("n"), w.alias("w"), F.when(F.col("total") > 1, 2).otherwise(1).alias("weight"))),
    )
    empty = F.expr("cast(array() as array<struct<d:long,h:long,s:int,n:int,w:long,weight:int>>)")
    spans = found.select("m", F.explode(F.concat(F.coalesce(as_run, empty), F.coalesce(as_windows, empty))).alias("x")).select("m", "x.*")
    # whole runs need no count; they are spread over groups of their own
    tally = F.sum("weight").over(Window.partitionBy("m", "w", F.when(F.col("w").isNull(), F.col("s"))))
    spans = spans.withColumn("tally", tally).where("w is null or (weight = 1 and tally > 1)")
    return spans.groupBy("d", "h").agg(F.collect_set(F.struct("s", "n")).alias("spans"))


def removed(batches, window: int = WINDOW):
    """Per document: bytes of the kept words and how many words there are."""
    for batch in batches:
        for part in text.slices(batch):
            buf, offsets, starts, ends, rows, _ = _word_hashes(part.column("text"))
            spans = part.column("spans")
            lists = spans.offsets.to_numpy() if len(spans) else np.zeros(1, np.int32)
            values = spans.values
            s, n = np.asarray(values.field("s")).astype(np.int64), np.asarray(values.field("n")).astype(np.int64)
            owner = np.repeat(np.arange(len(spans)), np.diff(lists))
            s, n = s[lists[0] : lists[-1]] + rows[:-1][owner], n[lists[0] : lists[-1]]
            delta = np.zeros(len(starts) + 1, np.int64)
            np.add.at(delta, s, 1)
            np.add.at(delta, s + n + window - 1, -1)
            keep = np.cumsum(delta[:-1]) == 0
            yield part, buf, offsets, starts, ends, rows, keep


def kept_text(buf, offsets, starts, ends, rows, keep) -> tuple[np.ndarray, np.ndarray]:
    """Kept words joined by one space, as bytes and offsets of each document."""
    row = text.row_of(rows)
    kept = np.flatnonzero(keep)
    level = np.zeros(len(buf) + 1, np.int8)
    level[starts[kept]] += 1
    level[ends[kept]] -= 1
    mask = np.cumsum(level[:-1], dtype=np.int8).astype(bool)
    more = np.zeros(len(kept), bool)  # another kept word of the same document follows
    more[:-1] = row[kept[1:]] == row[kept[:-1]]
    gaps = ends[kept[more]]
    out = buf.copy()
    out[gaps] = 0x20
    mask[gaps] = True
    sizes = np.append(0, np.cumsum(mask))
    return out[mask], sizes[offsets]


def remove_repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, bits: int = BITS) -> DataFrame:
    """doc_id, n_words, n_removed and the kept text of every document."""
    return _with_spans(docs, window, gram, bits, digest=False)


def _with_spans(docs: DataFrame, window: int, gram: int, bits: int, digest: bool) -> DataFrame:
    own = spread.slim(docs)
    found = spread.stored(repeated_intervals(own, window, gram, bits), "spans")
    none = F.expr("cast(array() as array<struct<s:int,n:int>>)")
    likely, others = spread.apart(own, found.select("h"), F.col("th"))
    joined = likely.join(found, likely.doc_id.eqNullSafe(found.d) & (likely.th == found.h), "left").select("doc_id", "text", F.coalesce("spans", none).alias("spans"))
    joined = joined.union(others.select("doc_id", "text", none))

    def apply(batches):
        for part, buf, offsets, starts, ends, rows, keep in removed(batches, window):
            data, at = kept_text(buf, offsets, starts, ends, rows, keep)
            kept = np.append(0, np.cumsum(keep))
            words = np.diff(rows)
            gone = words - (kept[rows[1:]] - kept[rows[:-1]])
            if digest:
                view = memoryview(np.ascontiguousarray(data))
                last = pa.array([hashlib.sha256(view[a:b]).hexdigest() for a, b in zip(at, at[1:], strict=False)], pa.string())
            else:
                last = text.blobs(data, at, pa.string())
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), text.longs(words), text.longs(gone), last], names=["doc_id", "n_words", "n_removed", "kept"])

    return joined.mapInArrow(apply, "doc_id long, n_words long, n_removed long, kept string")


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return _with_spans(docs, WINDOW, GRAM, BITS, digest=True).withColumnRenamed("kept", "kept_sha256")
