"""Benchmark decontamination by suffix arrays of the training text (op4).

Each slice of the documents is a shard with a suffix array of its own: word positions
sorted by the ``window`` words that follow. A suffix that cannot match is left out: one with a word
that no benchmark item has before the shortest window ends. All test suffixes are
binary-searched in every shard; the range found holds every verbatim occurrence, which is then
extended to its longest match, whose length and places are reported. Documents with a match go.

The test set is read in blocks of bounded size, each broadcast alone and passed over all documents,
so neither the number of items nor of documents is limited. A shard never leaves its task and
nothing is shuffled.

Words: A-Z lower-cased, then ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``. A window: ``window`` consecutive
words of an item; an item of fewer words, but not none, is one window. Defined cases: a null or
empty text has no words and is clean; items with equal windows all count; items of equal
id count once; a null item_id hits but is in no list; equal document rows get equal
results; no benchmark rows: all is clean; no documents: no rows; very long texts are whole (a shard of their own); of equally
long matches the first in the document counts, then that of the least item_id; columns may have any names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import spread, text

WINDOW = 10
SHARD_BYTES = (2 << 20) - 64
BLOCK_BYTES = 16 << 20
WORD = text.byte_class((0x30, 0x39), (0x61, 0x7A), (0x80, 0xFF))


def _words(column):
    buf, offsets = text.utf8(column)
    buf = text.LOWER[buf]
    starts, ends, rows = text.runs(WORD[buf], offsets)
    return text.byte_hashes(buf, starts, ends), rows


class TestSuffixes:
    """Suffixes of a block of benchmark items as sortable keys over a small vocabulary."""

    def __init__(self, ids: list[int | None], texts: list[str], window: int):
        self.ids = ids
        hashes, rows = _words(pa.array(texts, pa.string()))
        counts = np.diff(rows)
        self.vocabulary = np.unique(hashes)
        self.words = np.searchsorted(self.vocabulary, hashes).astype(np.uint32) + 1
        self.rows, row = rows, text.row_of(rows)
        length = np.minimum(counts, window)[row] if len(row) else np.zeros(0, np.int64)
        starts = np.flatnonzero(np.arange(len(self.words)) + length <= rows[1:][row]) if len(row) else np.zeros(0, np.int64)
        self.starts, self.length, self.item = starts, length[starts], row[starts]
        self.shortest = int(self.length.min()) if len(starts) else 0
        self.depth = int(window)
        low, high = self.keys(self.words, starts, self.length, 0), self.keys(self.words, starts, self.length, 0xFFFFFFFF)
        self.low, first, self.window_of = np.unique(low, return_index=True, return_inverse=True)
        self.high, self.window_length = high[first], self.length[first]
        order = np.argsort(self.window_of, kind="stable")
        self.by_window, self.window_at = order, np.searchsorted(self.window_of[order], np.arange(len(self.low) + 1))

    def keys(self, words: np.ndarray, starts: np.ndarray, length: np.ndarray, fill: int) -> np.ndarray:
        """The next ``depth`` words from each start, filled up after ``length``, as bytes that sort like them."""
        key = np.full((len(starts), self.depth), fill, ">u4")
        for j in range(self.depth if len(words) else 0):
            key[:, j] = np.where(j < length, words[np.minimum(starts + j, len(words) - 1)], np.uint32(fill))
        return key.view(f"S{4 * self.depth}").reshape(-1)


def _shard(tests: TestSuffixes, column):
    """Matches in one shard: row, position in it, item's row in the block, position in that, length of window."""
    hashes, rows = _words(column)
    none = np.zeros(0, np.int64)
    if not len(hashes) or not len(tests.low):
        return rows, (none,) * 5, hashes
    at = np.searchsorted(tests.vocabulary, hashes)
    at[at == len(tests.vocabulary)] = 0
    words = np.where(tests.vocabulary[at] == hashes, at + 1, 0).astype(np.uint32)
    row = text.row_of(rows)
    stop = np.where(words == 0, np.arange(len(words)), len(words))
    reach = np.minimum(np.minimum.accumulate(stop[::-1])[::-1], rows[1:][row]) - np.arange(len(words))
    position = np.flatnonzero(reach >= tests.shortest)
    keys = tests.keys(words, position, np.minimum(reach[position], tests.depth), 0)
    order = np.argsort(keys, kind="stable")  # the suffix array
    suffix, keys = position[order], keys[order]
    low, high = np.searchsorted(keys, tests.low, "left"), np.searchsorted(keys, tests.high, "right")
    hit = np.flatnonzero(high > low)
    size = (high - low)[hit]
    ends = np.append(0, np.cumsum(size))
    where = suffix[np.repeat(low[hit] - ends[:-1], size) + np.arange(ends[-1])]
    window = np.repeat(hit, size)
    return rows, (row[where], where, window, tests.window_length[window], words), hashes


def _blocks(benchmark: DataFrame, limit: int):
    """Items in blocks of at most ``limit`` bytes of text, one item at least; read one partition at a time."""
    ids, texts, size = [], [], 0
    for x in benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("text is not null").toLocalIterator():
        if texts and size + len(x.text) > limit:
            yield ids, texts
            ids, texts, size = [], [], 0
        ids.append(x.item_id)
        texts.append(x.text)
        size += len(x.text)
    if texts:
        yield ids, texts


def _hits(tests: TestSuffixes, batches, last: bool):
    """Adds a block's hits to each document's spans and items."""
    for batch in batches:
        for part in text.slices(batch, limit=SHARD_BYTES):
            rows, (row, where, window, length, words), hashes = _shard(tests, part.column("text"))
            old, owner = _flat(part.column("spans"))
            delta = np.zeros(len(hashes) + 1, np.int64)
            np.add.at(delta, where, 1)
            np.add.at(delta, where + length, -1)
            np.add.at(delta, rows[owner] + old[0], 1)
            np.add.at(delta, rows[owner] + old[1], -1)
            hit = np.append(np.cumsum(delta[:-1]) > 0, False)
            edge = np.zeros(len(hashes) + 1, bool)
            edge[rows] = True
            before = np.append(False, hit[:-1])
            s, e = np.flatnonzero(hit & (~before | edge)), np.flatnonzero((~hit | edge) & before)
            owner = np.searchsorted(rows, s, "right") - 1
            spans = pa.ListArray.from_arrays(pa.array(np.searchsorted(owner, np.arange(part.num_rows + 1)).astype(np.int32)), pa.StructArray.from_arrays([pa.array((s - rows[owner]).astype(np.int32)), pa.array((e - rows[owner]).astype(np.int32))], names=["s", "e"]))
            items = [set(x) for x in part.column("items").to_pylist()]
            for r, w in np.unique(np.stack([row, window], 1), axis=0) if len(row) else ():
                items[r].update(tests.ids[tests.item[x]] for x in tests.by_window[tests.window_at[w] : tests.window_at[w + 1]])
            longest = _longest(tests, rows, _extended(tests, rows, row, where, window, length, words), part.column("longest"))
            columns = {"doc_id": part.column("doc_id"), "th": part.column("th"), "n_words": text.longs(np.diff(rows)), "spans": spans, "longest": longest, "items": pa.array([sorted(x for x in i if x is not None) for i in items], pa.list_(pa.int64()))}
            if not last:
                columns["text"] = part.column("text")
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))


def _extended(tests: TestSuffixes, rows, row, where, window, length, words):
    """Maximal verbatim matches that start with an occurrence of a window: document row, place, length, item and place in it."""
    if not len(row):
        return (np.zeros(0, np.int64),) * 5
    size = np.diff(tests.window_at)[window]
    ends = np.append(0, np.cumsum(size))
    which = tests.by_window[np.repeat(tests.window_at[window] - ends[:-1], size) + np.arange(ends[-1])]
    row, p, n = np.repeat(row, size), np.repeat(where, size), np.repeat(length, size)
    q, item = tests.starts[which], tests.item[which]
    starts = (p == rows[row]) | (q == tests.rows[item]) | (words[np.maximum(p - 1, 0)] != tests.words[np.maximum(q - 1, 0)])
    row, p, n, q, item = (x[starts] for x in (row, p, n, q, item))
    live = np.arange(len(p))
    while len(live):
        at, to = p[live] + n[live], q[live] + n[live]
        live = live[(at < rows[row[live] + 1]) & (to < tests.rows[item[live] + 1])]
        at, to = p[live] + n[live], q[live] + n[live]
        live = live[words[at] == tests.words[to]]
        n[live] += 1
    return row, p - rows[row], n, item, q - tests.rows[item]


LONGEST = "struct<length:long,doc_pos:long,item_id:long,item_pos:long>"


def _longest(tests: TestSuffixes, rows, found, before):
    """Each row's longest match so far: of equally long ones the first, then that of the least item."""
    row, p, n, item, q = found
    best = before.to_pylist()
    ids = np.array([np.iinfo(np.int64).max if i is None else i for i in tests.ids], np.int64)[item] if len(item) else item
    order = np.lexsort((q, ids, p, -n, row))
    for j in order[np.unique(row[order], return_index=True)[1]] if len(row) else ():
        now, old = (int(n[j]), int(p[j]), tests.ids[item[j]], int(q[j])), best[row[j]]
        rank = lambda x: (-x[0], x[1], np.iinfo(np.int64).max if x[2] is None else x[2], x[3])
        if rank(now) < rank((old["length"], old["doc_pos"], old["item_id"], old["item_pos"])):
            best[row[j]] = dict(zip(("length", "doc_pos", "item_id", "item_pos"), now, strict=True))
    return pa.array(best, pa.struct([(k, pa.int64()) for k in ("length", "doc_pos", "item_id", "item_pos")]))


def _flat(lists):
    """Fields s and e of a list<struct> column, flat, and the row of each entry."""
    ends = lists.offsets.to_numpy()
    values = lists.values.slice(ends[0], ends[-1] - ends[0])
    return [np.asarray(values.field(k)).astype(np.int64) for k in ("s", "e")], np.repeat(np.arange(len(lists)), np.diff(ends))


def longest_matches(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, doc_pos, item_id, item_pos, length: every maximal verbatim match that holds a window, in words."""

    def extend(tests, batches):
        for batch in batches:
            for part in text.slices(batch, limit=SHARD_BYTES):
                rows, found, _ = _shard(tests, part.column("text"))
                row, p, n, item, q = _extended(tests, rows, *found)
                if len(row):
                    yield pa.RecordBatch.from_arrays([part.column("doc_id").take(pa.array(row)), text.longs(p), pa.array([tests.ids[i] for i in item], pa.int64()), text.longs(q), text.longs(n)], names=["doc_id", "doc_pos", "item_id", "item_pos", "length"])

    own, out, schema = spread.slim(docs), None, "doc_id long, doc_pos long, item_id long, item_pos long, length long"
    for ids, texts in _blocks(benchmark, block_bytes):
        tests = own.sparkSession.sparkContext.broadcast(TestSuffixes(ids, texts, window))
        part = own.mapInArrow(lambda batches, tests=tests: extend(tests.value, batches), schema)
        out = part if out is None else out.union(part)
    return out if out is not None else own.sparkSession.createDataFrame([], schema)


def report(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Per document row: doc_id, th, n_words, spans of hit words (s, e), longest match (length, doc_pos, item_id, item_pos; 0 and nulls
    where there is none), n_hit, n_items, items, contaminated."""
    schema = f"doc_id long, th long, n_words long, spans array<struct<s:int,e:int>>, longest {LONGEST}, items array<long>"
    out = spread.slim(docs).select("doc_id", "th", "text", F.expr("cast(array() as array<struct<s:int,e:int>>)").alias("spans"), F.expr(f"cast(struct(0L, null, null, null) as {LONGEST})").alias("longest"), F.expr("cast(array() as array<long>)").alias("items"))
    blocks = iter(_blocks(benchmark, block_bytes))
    block, done = next(blocks, ([], [])), 0
    while block is not None:
        following = next(blocks, None)
        last = following is None
        tests = out.sparkSession.sparkContext.broadcast(TestSuffixes(*block, window))
        out = out.select("doc_id", "th", "text", "spans", "longest", "items").mapInArrow(lambda batches, tests=tests, last=last: _hits(tests.value, batches, last), schema if last else f"{schema}, text string")
        done += 1
        if not last and done % 4 == 0:
            out = spread.stored(out, "decontaminate")
        block = following
    items = F.array_sort(F.transform("items", lambda i: i.cast("string")))
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, x: a + x["e"] - x["s"])
    return out.select("doc_id", "th", "n_words", "spans", "longest", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), items.alias("items")).withColumn("contaminated", F.col("n_hit") > 0)


def clean(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The documents without a match, with all their columns; of rows that share a doc_id only those whose own text matches go."""
    d, h = spread.free_names(docs, "d", "h")
    found = spread.stored(report(docs, benchmark, window).where("longest.length > 0").select(F.col("doc_id").alias(d), F.col("th").alias(h)).distinct(), "contaminated")
    likely, others = spread.apart(docs, found.select(h))
    return others.union(likely.join(found, F.col("doc_id").cast("long").eqNullSafe(F.col(d)) & (spread.text_key() == F.col(h)), "left_anti"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = report(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return out.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), "contaminated", *(F.col(f"longest.{c}").alias(f"longest_{c}") for c in ("length", "doc_pos", "item_id", "item_pos")))
