"""WARC archives of pages and their capture index.

Records go to gzip members, one file per task, and each task leaves a *run*: its captures
sorted by (URL key, timestamp, page). The index is the merge of all runs: the key space is
cut at sampled keys, every range is merged by its own task with a loser tree over the runs,
which are read block by block from the first block of the range, and more than ``fan_in``
runs are merged in several passes. No task holds more than ``fan_in`` blocks.

Files carry the name of the attempt that wrote them; tables written by Spark name those
that count, so a lost or repeated task leaves nothing wrong behind.
"""

from __future__ import annotations

import bisect
import gzip
import hashlib
import json
import re
import uuid
import zlib
from collections.abc import Iterator
from datetime import UTC, datetime, timedelta

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfold.llm.common import by_size, partitions
from wayfold.llm.token_files import file_system
from wayfold.session import fresh_dir

#: Payloads under this size are always stored.
LEAST_SHARED = 100
#: Captures of a table without capture times count seconds by page from here.
EPOCH = datetime(2024, 1, 1, tzinfo=UTC)
BLOCK_ROWS = 500
FAN_IN = 64

CAPTURE = (
    "url_key string, captured string, page_id long, url string, record_type string, payload_digest string, "
    "payload_bytes long, refers_to long, path string, offset long, length long"
)
NAMES = [c.split()[0] for c in CAPTURE.split(", ")]
KINDS = [pa.int64() if c.endswith(" long") else pa.string() for c in CAPTURE.split(", ")]
RUN = "path string, rows long, blocks array<struct<url_key:string,captured:string,page_id:long>>"


def url_key(url: str | None) -> str:
    """Sort key of a URL: host labels reversed, lower case, without scheme, 'www.', port 80/443 or fragment."""
    found = re.match(r"(?:[A-Za-z][A-Za-z0-9+.-]*://)?([^/?#]*)([^#]*)", url or "")
    host, rest = found.group(1).lower().rpartition("@")[2], found.group(2)
    host = re.sub(r":(80|443)?$", "", host)
    host = host.removeprefix("www.")
    return ",".join(reversed(host.split("."))) + ")" + (rest or "/")


def decide(pages: DataFrame) -> DataFrame:
    """Adds payload, digest, record type and the page that a revisit refers to.

    Of pages with equal payloads of at least 100 bytes the one with the smallest page_id is the
    response, the others revisit it. Rows that share that smallest id are all responses. The
    shuffle for the smallest id combines before it; the join back is on the digest, whose hot
    values Spark's skew join splits.
    """
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload")
    ).withColumns({"payload_bytes": F.octet_length("payload").cast("long"), "payload_digest": F.sha2("payload", 256)})
    shared = F.col("payload_bytes") >= LEAST_SHARED
    first = (
        rows.filter(shared).groupBy("payload_digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n"))
        .filter("n > 1").select(F.col("payload_digest").alias("digest"), "first")
    )
    joined = rows.join(first, F.col("payload_digest") == F.col("digest"), "left")
    revisit = shared & F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    return joined.select(
        "page_id", "url", F.when(~F.coalesce(revisit, F.lit(False)), F.col("payload")).alias("payload"), "payload_bytes",
        "payload_digest", F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        F.when(revisit, F.col("first")).alias("refers_to"),
    )


def record(page_id, url, payload, size, digest, kind, refers, captured: str) -> bytes:
    """One WARC/1.1 record; a revisit has no payload and names the record that holds it."""
    status = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nContent-Length: %d\r\n\r\n" % size
    block = status + (payload or b"")
    head = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Date: {captured}", f"WARC-Payload-Digest: sha256:{digest}", f"WARC-Payload-Length: {size}",
        "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    if url is not None:
        head.insert(3, "WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    if kind == "revisit":
        head += [
            f"WARC-Refers-To: <urn:page:{refers}>",
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
        ]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> dict:
    """Fields of a record: page, type, payload (None for a revisit), digest and length as recorded."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    page = lambda name: int(found) if (found := fields[name][10:-1]) else None
    kind = fields["WARC-Type"]
    return {
        "page_id": page("WARC-Record-ID"), "url": fields.get("WARC-Target-URI"), "record_type": kind,
        "refers_to": page("WARC-Refers-To") if kind == "revisit" else None,
        "payload": None if kind == "revisit" else block.partition(b"\r\n\r\n")[2],
        "digest": fields["WARC-Payload-Digest"].partition(":")[2], "length": int(fields["WARC-Payload-Length"]),
        "captured": fields["WARC-Date"],
    }


def sort_key(row: tuple) -> tuple:
    """(URL key, time, page) with a null page first, then the place of the record, so that no two are equal."""
    page = row[2]
    return (row[0], row[1], page is not None, page or 0, row[8], row[9])


class Run:
    """A sorted run in a file: zlib blocks of rows as JSON lines and, at the end, their first keys and places."""

    def __init__(self, source):
        self.source = source
        size = source.size()
        source.seek(size - 16)
        at = int(source.read(16))
        source.seek(at)
        self.blocks = json.loads(zlib.decompress(source.read(size - 16 - at)))

    def rows(self, low: tuple | None, high: tuple | None) -> Iterator[tuple]:
        """Rows with low <= (URL key, time, page) < high, from the first block that may hold one."""
        firsts = [range_key(b[0]) for b in self.blocks]
        start = max(0, bisect.bisect_left(firsts, low) - 1) if low is not None else 0
        for (first, offset, length) in self.blocks[start:]:
            if high is not None and range_key(first) >= high:
                return
            self.source.seek(offset)
            for line in zlib.decompress(self.source.read(length)).decode().splitlines():
                row = tuple(json.loads(line))
                key = range_key(row)
                if high is not None and key >= high:
                    return
                if low is None or key >= low:
                    yield row


def range_key(row) -> tuple:
    return (row[0], row[1], row[2] is not None, row[2] or 0)


class RunWriter:
    def __init__(self, store, path: str):
        self.out = store.open_output_stream(path, compression=None)
        self.blocks, self.lines, self.first, self.at, self.count = [], [], None, 0, 0

    def add(self, row: tuple) -> None:
        if not self.lines:
            self.first = row[:3]
        self.lines.append(json.dumps(row))
        self.count += 1
        if len(self.lines) == BLOCK_ROWS:
            self.flush()

    def flush(self) -> None:
        if self.lines:
            body = zlib.compress("\n".join(self.lines).encode(), 1)
            self.out.write(body)
            self.blocks.append((self.first, self.at, len(body)))
            self.at += len(body)
            self.lines = []

    def close(self) -> None:
        self.flush()
        self.out.write(zlib.compress(json.dumps(self.blocks).encode()) + b"%016d" % self.at)
        self.out.close()


def merge(runs: list[Iterator[tuple]]) -> Iterator[tuple]:
    """k-way merge with a loser tree: one comparison per level for each row.

    Leaves k..2k-1 are the runs; an inner node keeps the loser of its match and the winner goes
    up. After the winner's run moves on, only the matches on its path are played again.
    """
    k = len(runs)
    if k == 0:
        return
    heads: list[tuple | None] = [next(r, None) for r in runs]
    keys = [None if h is None else sort_key(h) for h in heads]

    def beats(a: int, b: int) -> bool:
        return keys[a] is not None and (keys[b] is None or (keys[a], a) < (keys[b], b))

    losers = [-1] * k
    winners = [-1] * k + list(range(k))
    for node in range(k - 1, 0, -1):
        a, b = winners[2 * node], winners[2 * node + 1]
        winners[node], losers[node] = (a, b) if beats(a, b) else (b, a)
    best = winners[1]
    while keys[best] is not None:
        yield heads[best]
        heads[best] = next(runs[best], None)
        keys[best] = None if heads[best] is None else sort_key(heads[best])
        node = (best + k) // 2
        while node:
            if beats(losers[node], best):
                best, losers[node] = losers[node], best
            node //= 2


def write(pages: DataFrame, folder: str | None = None, part_bytes: int = 8_000_000) -> DataFrame:
    """Writes archives and sorted runs below ``folder``; returns the table of runs.

    pages: (page_id, url, html). A null html is an empty payload, a null url has the key of an
    empty one, a null page_id is kept. Other columns are ignored.
    """
    spark = pages.sparkSession
    folder = folder or fresh_dir(spark, "warc")

    def save(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = file_system(folder)
        store.create_dir(root, recursive=True)
        name, out, at = "", None, 0
        captures: list[tuple] = []
        runs: list[tuple] = []

        def finish() -> None:
            out.close()
            captures.sort(key=sort_key)
            writer = RunWriter(store, f"{root}/{name}.run")
            for row in captures:
                writer.add(row)
            writer.close()
            runs.append((f"{folder}/{name}.run", len(captures), [dict(zip(NAMES, b[0])) for b in writer.blocks]))
            captures.clear()

        for batch in by_size(batches, "payload", part_bytes):
            for page, url, payload, size, digest, kind, refers in zip(*(c.to_pylist() for c in batch.columns)):
                if out is None or at >= part_bytes:
                    if out is not None:
                        finish()
                    name = f"part-{uuid.uuid4().hex}"
                    out, at = store.open_output_stream(f"{root}/{name}.warc.gz", compression=None), 0
                captured = (EPOCH + timedelta(seconds=(page or 0) % (1 << 31))).strftime("%Y-%m-%dT%H:%M:%SZ")
                body = gzip.compress(record(page, url, payload, size, digest, kind, refers, captured), 3, mtime=0)
                out.write(body)
                captures.append(
                    (url_key(url), captured, page, url, kind, digest, size, refers, f"{folder}/{name}.warc.gz", at, len(body))
                )
                at += len(body)
        if out is not None:
            finish()
        yield runs_batch(runs)

    rows = decide(pages).select("page_id", "url", "payload", "payload_bytes", "payload_digest", "record_type", "refers_to")
    return kept(rows.mapInArrow(save, RUN), f"{folder}/runs-0")


def runs_batch(runs: list[tuple]) -> pa.RecordBatch:
    key = pa.struct([("url_key", pa.string()), ("captured", pa.string()), ("page_id", pa.int64())])
    columns = list(zip(*runs)) if runs else [[]] * 3
    arrays = [pa.array(list(c), t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.list_(key)))]
    return pa.RecordBatch.from_arrays(arrays, names=["path", "rows", "blocks"])


def kept(df: DataFrame, path: str) -> DataFrame:
    df.write.mode("errorifexists").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def index(runs: DataFrame, folder: str | None = None, ranges: int | None = None, fan_in: int = FAN_IN) -> DataFrame:
    """The global capture index: all captures with ``range_no`` and ``range_pos``, which order them.

    The bounds are sampled quantiles of the first keys of all blocks, at most one per range, so a URL
    with very many captures is cut by time. A pass merges at most ``fan_in`` runs per group and
    range; passes go on until one group is left.
    """
    spark = runs.sparkSession
    folder = folder or fresh_dir(spark, "captures")
    count = ranges or partitions(spark)
    key = F.struct("b.url_key", "b.captured", F.col("b.page_id").isNotNull().alias("has"), F.coalesce("b.page_id", F.lit(0)).alias("page"))
    firsts = runs.select(F.explode("blocks").alias("b")).select(key.alias("key"))
    # One row per block of captures, dealt into sampled ranges; their least keys are the bounds.
    dealt = firsts.repartitionByRange(count, "key").withColumn("t", F.spark_partition_id())
    bounds = sorted({tuple(r["key"]) for r in dealt.groupBy("t").agg(F.min("key").alias("key")).collect()})[1:]
    limits = list(zip([None, *bounds], [*bounds, None]))
    current = runs.select("path", F.lit(-1).alias("range_no"))
    n, step = current.count(), 0
    places = F.array(*(F.lit(k) for k in range(len(limits))))

    def merged(rows: list[tuple], at: int) -> Iterator[tuple]:
        low, high = limits[at]
        sources = []
        for path in rows:
            store, inner = file_system(path)
            sources.append(store.open_input_file(inner))
        try:
            yield from merge([Run(s).rows(low, high) for s in sources])
        finally:
            for s in sources:
                s.close()

    def tasks(df: DataFrame, groups: int) -> DataFrame:
        """(range_no, paths): the runs of a group in a range; at most ``fan_in`` paths per group."""
        ranged = df.withColumn("at", F.explode(F.when(F.col("range_no") < 0, places).otherwise(F.array("range_no"))))
        group = F.expr(f"ntile({groups}) over (partition by at order by path)")
        listed = ranged.withColumn("g", group).groupBy("at", "g").agg(F.sort_array(F.collect_list("path")).alias("paths"))
        return listed.repartition(max(count, 1), "at", "g")

    while n > fan_in:
        groups, step = -(-n // fan_in), step + 1

        def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            store, root = file_system(folder)
            store.create_dir(root, recursive=True)
            for batch in batches:
                for at, paths in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    name = f"merge-{uuid.uuid4().hex}.run"
                    writer = RunWriter(store, f"{root}/{name}")
                    for row in merged(paths, at):
                        writer.add(row)
                    writer.close()
                    yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{name}"]), pa.array([at], pa.int32())], names=["path", "range_no"])

        current = kept(tasks(current, groups).select("at", "paths").mapInArrow(again, "path string, range_no int"), f"{folder}/pass-{step}")
        n = groups

    def last(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch_of(at: int, start: int, rows: list[tuple]) -> pa.RecordBatch:
            columns = [pa.array(list(c), k) for c, k in zip(zip(*rows), KINDS)]
            places = [pa.array([at] * len(rows), pa.int64()), pa.array(range(start, start + len(rows)), pa.int64())]
            return pa.RecordBatch.from_arrays([*columns, *places], names=[*NAMES, "range_no", "range_pos"])

        for batch in batches:
            for at, paths in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows, start = [], 0
                for row in merged(paths, at):
                    rows.append(row)
                    if len(rows) == 2000:
                        yield batch_of(at, start, rows)
                        start, rows = start + len(rows), []
                if rows:
                    yield batch_of(at, start, rows)

    out = tasks(current, 1).select("at", "paths").mapInArrow(last, f"{CAPTURE}, range_no long, range_pos long")
    return kept(out, f"{folder}/index")


def read(captures: DataFrame, columns: str = "payload") -> DataFrame:
    """Reads the record of every capture back from its archive.

    Adds ``payload`` (``columns='payload'``) or only its recomputed digest and size. A response's
    payload must have the recorded digest, else it raises.
    """
    whole = columns == "payload"
    schema = (
        "page_id long, url string, captured string, record_type string, refers_to long, payload_bytes long, "
        "payload_digest string, payload binary, range_no long, range_pos long"
    )
    kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.int64(), pa.int64()]

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened, source = "", None
        for batch in batches:
            rows = []
            for path, offset, length, at, pos in zip(*(c.to_pylist() for c in batch.columns)):
                if path != opened:
                    if source is not None:
                        source.close()
                    store, inner = file_system(path)
                    opened, source = path, store.open_input_file(inner)
                source.seek(offset)
                found = parse(zlib.decompress(source.read(length), 31))
                payload, digest, size = found["payload"], found["digest"], found["length"]
                if payload is not None:
                    digest, size = hashlib.sha256(payload).hexdigest(), len(payload)
                    if digest != found["digest"] or size != found["length"]:
                        raise ValueError(f"record at {offset} of {path} doesn't match its digest")
                rows.append((
                    found["page_id"], found["url"], found["captured"], found["record_type"], found["refers_to"], size,
                    digest, payload if whole else None, at, pos,
                ))
            if rows:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(list(c), k) for c, k in zip(zip(*rows), kinds)], names=[p.split()[0] for p in schema.split(", ")]
                )
        if source is not None:
            source.close()

    by_file = captures.select("path", "offset", "length", "range_no", "range_pos")
    # A fixed count: by the bytes of the index alone, all archives would go to a few tasks.
    dealt = by_file.repartition(partitions(captures.sparkSession), "path")
    return dealt.sortWithinPartitions("path", "offset").mapInArrow(load, schema)
