"""WARC archives of pages with a two-level capture index (op10).

Writing: every page is a record, a gzip member of its own, of an archive of bounded size. Archives are
kept as rows (archive, offset, data) of a table in the shared folder, in which a range read is a
filter; the rows of one archive, in order, are a .warc.gz file. Of records with equal payloads of
at least ``least`` bytes the one with the largest page_id is the response, others revisit it.

Index: each capture is a line ``key page_id archive offset length kind``, keyed by the URL with its host
reversed. Lines are range-partitioned and sorted, cut into compressed blocks, and each partition has a
sparse directory of its blocks' first keys; above them stands one row per partition. A lookup finds
partitions by binary search in that top level, whose size is the number of partitions, meets
their directories there, finds blocks by binary search again, decompresses those and range-reads the records.

Defined cases: a null html is an empty payload, a null url an empty one; equal rows are captures of
their own, of which one can be the response; a null page_id ranks last; spaces and control
characters in URLs are escaped in headers and keys; very long pages are whole records, larger than an archive if need be; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from bisect import bisect_left, bisect_right
from urllib.parse import quote, urlsplit

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm import spread

LEAST, ARCHIVE_BYTES, BLOCK_LINES = 1000, 64 << 20, 256
#: A lookup that finds so many records at most reads their ranges; a larger one joins the places with the archives.
RANGES = 4096
_SAFE = "".join(chr(c) for c in range(0x21, 0x7F))


def surt(url: str) -> str:
    """The sort key of a URL: reversed host, then port, path and query; scheme, user, www and fragment don't count."""
    url = quote(url, safe=_SAFE)
    try:
        parts = urlsplit(url if "//" in url else f"//{url}")
        host, port = parts.hostname or "", parts.port
    except ValueError:
        return f"){url}"
    host = ",".join(reversed(host.removeprefix("www.").split(".")))
    return f"{host}{f':{port}' if port and port not in (80, 443) else ''}){parts.path or '/'}{f'?{parts.query}' if parts.query else ''}"


def _member(headers: list[tuple[str, str]], body: bytes) -> bytes:
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in headers) + f"Content-Length: {len(body)}\r\n\r\n"
    packer = zlib.compressobj(1, zlib.DEFLATED, 31)
    return packer.compress(head.encode() + body + b"\r\n\r\n") + packer.flush()


def parse(member: bytes) -> tuple[dict[str, str], bytes]:
    """Headers, with lower-case names, and body of a record."""
    data = zlib.decompress(member, 31)
    cut = data.index(b"\r\n\r\n")
    lines = data[:cut].decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    headers = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}
    size = int(headers["content-length"])
    return headers, data[cut + 4 : cut + 4 + size]


def write_archives(pages: DataFrame, least: int = LEAST, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """(archive, offset, data) of all records, stored in the shared folder."""
    html = F.coalesce(F.col("html"), F.lit(""))
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce("url", F.lit("")).alias("url"), html.alias("html"), F.sha1(html.cast("binary")).alias("digest"))
    copies = own.where(F.octet_length("html") >= least).groupBy("digest", "page_id").agg(F.count(F.lit(1)).alias("n")).groupBy("digest").agg(F.max(F.struct("page_id", "n")).alias("top"), F.sum("n").alias("c"))
    shared = spread.stored(copies.where("c > 1").select("digest", "top", F.xxhash64("digest").alias("key")), "shared")
    # a payload that stands alone meets no join; of equal rows of the top page one is numbered first, within one evaluation
    likely, alone = spread.apart(own, shared.select("key"), F.xxhash64("digest"))
    joined = likely.join(shared.drop("key"), "digest", "left").withColumn("equal", F.col("page_id").eqNullSafe(F.col("top.page_id")) & (F.col("top.n") > 1))
    copies = Window.partitionBy("digest").orderBy("url")
    first = joined.where("not equal or top is null").withColumn("number", F.when(F.col("page_id").eqNullSafe(F.col("top.page_id")), 1).otherwise(2))
    joined = first.union(joined.where("equal and top is not null").withColumn("number", F.row_number().over(copies)))
    marked = joined.select("page_id", "url", "html", "digest", (F.col("top").isNotNull() & (F.octet_length("html") >= least) & (F.col("number") > 1)).alias("revisit"), F.col("top.page_id").alias("refers"))
    marked = marked.union(alone.select("page_id", "url", "html", "digest", F.lit(False), F.lit(None).cast("long")))

    def rows(batches):
        task, number, offset = TaskContext.get().partitionId(), 0, 0
        for batch in batches:
            names, offsets, members = [], [], []
            for page_id, url, html, digest, revisit, refers in zip(*(batch.column(k).to_pylist() for k in ("page_id", "url", "html", "digest", "revisit", "refers")), strict=True):
                url = quote(url, safe=_SAFE)
                headers = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Target-URI", url), ("WARC-Record-ID", f"<urn:page:{'' if page_id is None else page_id}>"), ("WARC-Payload-Digest", f"sha1:{digest}")]
                if revisit:
                    headers += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", f"<urn:page:{'' if refers is None else refers}>")]
                member = _member(headers, b"" if revisit else html.encode())
                if offset + len(member) > archive_bytes and offset:
                    number, offset = number + 1, 0
                names.append(f"pages-{task:06d}-{number:06d}")
                offsets.append(offset)
                members.append(member)
                offset += len(member)
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(offsets, pa.int64()), pa.array(members, pa.binary())], names=["archive", "offset", "data"])

    return spread.stored(marked.mapInArrow(rows, "archive string, offset long, data binary"), "warc")


def captures(archives: DataFrame) -> DataFrame:
    """(key, line) of each record in the archives."""

    def rows(batches):
        for batch in batches:
            keys, lines = [], []
            for archive, offset, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                headers, _ = parse(data.as_py())
                keys.append(surt(headers["warc-target-uri"]))
                lines.append(f"{keys[-1]} {headers['warc-record-id'][10:-1] or '-'} {archive} {offset} {len(data.as_buffer())} {headers['warc-type']}")
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(lines, pa.string())], names=["key", "line"])

    return archives.select("archive", "offset", "data").mapInArrow(rows, "key string, line string")


def build_index(lines: DataFrame, block_lines: int = BLOCK_LINES) -> DataFrame:
    """(part, block, first, last, data), stored: compressed blocks of sorted lines with their first and last key."""

    def rows(batches):
        part, block, held = TaskContext.get().partitionId(), 0, []

        def cut(n):
            nonlocal held, block
            now, held = held[:n], held[n:]
            block += 1
            return {"part": part, "block": block - 1, "first": now[0][0], "last": now[-1][0], "data": zlib.compress("\n".join(x for _, x in now).encode())}

        schema = pa.schema([("part", pa.int32()), ("block", pa.int32()), ("first", pa.string()), ("last", pa.string()), ("data", pa.binary())])
        for batch in batches:
            held += zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)
            out = []
            while len(held) >= block_lines:
                out.append(cut(block_lines))
            yield pa.RecordBatch.from_pylist(out, schema)
        if held:
            yield pa.RecordBatch.from_pylist([cut(len(held))], schema)

    # lines of one key may stand in several partitions: what is sorted is (key, line)
    ordered = lines.repartitionByRange(spread.partitions(lines), "key", "line").sortWithinPartitions("key", "line")
    return spread.stored(ordered.mapInArrow(rows, "part int, block int, first string, last string, data binary"), "index")


def lookup(index: DataFrame, archives: DataFrame, urls: DataFrame) -> DataFrame:
    """page_id, url, payload, digest, record_type, refers_to of all captures of the URLs; a revisit has no payload of its own."""
    spark = index.sparkSession
    top = index.groupBy("part").agg(F.min("first").alias("first"), F.max("last").alias("last")).orderBy("part").collect()  # one row a partition
    parts, firsts, lasts = [x.part for x in top], [x.first for x in top], [x.last for x in top]
    level = spark.sparkContext.broadcast((parts, firsts, lasts))

    def route(batches):
        parts, firsts, lasts = level.value
        for batch in batches:
            keys = [surt(u) for u in batch.column(0).to_pylist()]
            pairs = [(parts[i], k) for k in dict.fromkeys(keys) for i in range(bisect_left(lasts, k), bisect_right(firsts, k))]
            yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in pairs], pa.int32()), pa.array([k for _, k in pairs], pa.string())], names=["part", "key"])

    routed = urls.select(F.coalesce("url", F.lit("")).alias("url")).mapInArrow(route, "part int, key string").distinct()
    # each partition's directory comes first, then its keys in a stream: no key carries the directory
    blocks = index.select("part", F.lit(0).alias("kind"), F.col("first").alias("key"), "last", "block")
    both = blocks.union(routed.select("part", F.lit(1), "key", F.lit(None).cast("string"), F.lit(None).cast("int"))).repartition("part").sortWithinPartitions("part", "kind", "block", "key")

    def find(batches):
        own, ids, low, high = None, [], [], []
        for batch in batches:
            out = []
            for part, kind, key, last, block in zip(*(batch.column(c).to_pylist() for c in ("part", "kind", "key", "last", "block")), strict=True):
                if part != own:
                    own, ids, low, high = part, [], [], []
                if kind == 0:
                    ids.append(block)
                    low.append(key)
                    high.append(last)
                else:
                    out += [(part, ids[j], key) for j in range(bisect_left(high, key), bisect_right(low, key))]
            columns = list(zip(*out, strict=True)) or [[], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.string())], names=["part", "block", "key"])

    wanted = both.mapInArrow(find, "part int, block int, key string").groupBy("part", "block").agg(F.collect_set("key").alias("keys"))

    def read(batches):
        for batch in batches:
            out = []
            for keys, data in zip(batch.column("keys").to_pylist(), batch.column("data"), strict=True):
                keys = set(keys)
                for line in zlib.decompress(data.as_py()).decode().split("\n"):
                    key, _, archive, offset, _, _ = line.rsplit(" ", 5)
                    if key in keys:
                        out.append((archive, int(offset)))
            columns = list(zip(*out, strict=True)) or [[], []]
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), pa.array(columns[1], pa.int64())], names=["archive", "offset"])

    places = spread.stored(index.join(wanted, ["part", "block"]).select("keys", "data").mapInArrow(read, "archive string, offset long"), "places")

    def records(batches):
        schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload", pa.binary()), ("digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])
        for batch in batches:
            out = []
            for data in batch.column(0):
                headers, body = parse(data.as_py())
                number = {k: int(headers[k][10:-1]) if headers.get(k, "")[10:-1] else None for k in ("warc-record-id", "warc-refers-to")}
                revisit = headers["warc-type"] == "revisit"
                out.append({"page_id": number["warc-record-id"], "url": headers["warc-target-uri"], "payload": None if revisit else body, "digest": headers["warc-payload-digest"][5:], "record_type": headers["warc-type"], "refers_to": number["warc-refers-to"]})
            yield pa.RecordBatch.from_pylist(out, schema)

    few = places.limit(RANGES + 1).count() <= RANGES
    if few:
        # range reads: the filters reach the Parquet scan, whose row groups and pages of other archives and offsets are left out
        at = places.collect()
        archives = archives.where(F.col("archive").isin(sorted({x.archive for x in at})) & F.col("offset").isin(sorted({x.offset for x in at})))
    return archives.join(F.broadcast(places) if few else places, ["archive", "offset"]).select("data").mapInArrow(records, "page_id long, url string, payload binary, digest string, record_type string, refers_to long")


def report(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every page, from the archives read back."""
    archives = write_archives(pages, least)
    found = lookup(build_index(captures(archives)), archives, pages.select("url"))
    # digests of responses are taken from the payload that was read
    slim = spread.stored(found.select("page_id", F.octet_length("payload").cast("long").alias("payload_bytes"), F.coalesce(F.sha1("payload"), F.col("digest")).alias("payload_digest"), "record_type", "refers_to"), "records")
    sizes = slim.where((F.col("record_type") == "response") & (F.col("payload_bytes") >= least)).groupBy("payload_digest").agg(F.first("payload_bytes").alias("full"))
    revisits = slim.where("record_type = 'revisit'").join(sizes, "payload_digest", "left").select("page_id", F.col("full").alias("payload_bytes"), "payload_digest", "record_type", "refers_to")
    return slim.where("record_type = 'response'").union(revisits)


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(spark.read.parquet(f"{sf_dir}/pages.parquet"))
