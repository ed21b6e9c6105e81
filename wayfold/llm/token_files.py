"""Token ids in files of independent zstandard frames.

A shard holds the documents of one range of ids in ascending order. Layout:

* one zstandard frame per document: its ids as little-endian unsigned integers;
* a skippable frame with the document ids (zstandard over 64-bit integers) and the width
  of an id in bytes;
* a skippable frame with the seek table of zstandard's seekable format: per frame the
  compressed size, the plain size and the low 32 bits of the XXH64 of the plain bytes.

A reader takes the tail of a file, then only the frames of the documents it wants, and
checks each against its checksum. Every attempt of a task writes a file of its own name
and the manifest, a Spark table, names the files of the attempts that succeeded, so a
lost or repeated task leaves no wrong file in the set.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wayfold.llm import units
from wayfold.llm.common import by_size, partitions, texts_of
from wayfold.session import fresh_dir

#: Fixed values of the zstandard seekable format.
SEEKABLE_MAGIC = 0x8F92EAB1
SKIPPABLE_TABLE = 0x184D2A5E
SKIPPABLE_IDS = 0x184D2A5D
CHECKSUMS = 0x80

MANIFEST = "shard int, path string, docs long, tokens long, bytes long"
BATCH_BYTES = 3_000_000


def file_system(uri: str):
    """(file system, path) of a URI; every store that Arrow knows, or a plain path."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


class ShardWriter:
    """Writes one file; ``close`` appends the two tables."""

    def __init__(self, out, width: int, level: int):
        self.out, self.width = out, width
        self.packer = zstandard.ZstdCompressor(level=level, write_checksum=False, write_content_size=True)
        self.ids, self.entries, self.tokens, self.bytes = [], [], 0, 0

    def write(self, data: bytes) -> None:
        self.out.write(data)
        self.bytes += len(data)

    def add(self, doc_id: int | None, plain: bytes) -> None:
        packed = self.packer.compress(plain)
        self.write(packed)
        self.ids.append(doc_id)
        self.entries.append((len(packed), len(plain), xxhash.xxh64_intdigest(plain) & 0xFFFFFFFF))
        self.tokens += len(plain) // self.width

    def close(self) -> None:
        none = np.array([i is None for i in self.ids], np.uint8)
        ids = np.array([i or 0 for i in self.ids], "<i8")
        body = self.packer.compress(bytes([self.width]) + none.tobytes() + ids.tobytes())
        self.write(struct.pack("<II", SKIPPABLE_IDS, len(body)) + body)
        rows = np.array(self.entries, "<u4").tobytes()
        foot = struct.pack("<IBI", len(self.entries), CHECKSUMS, SEEKABLE_MAGIC)
        self.write(struct.pack("<II", SKIPPABLE_TABLE, len(rows) + len(foot)) + rows + foot)
        self.out.close()


class ShardReader:
    """Random access to the documents of a file."""

    def __init__(self, source):
        self.source = source
        size = source.size()
        n, flags, magic = struct.unpack("<IBI", self.at(size - 9, 9))
        if magic != SEEKABLE_MAGIC or not flags & CHECKSUMS:
            raise ValueError("not a file of token frames with checksums")
        self.entries = np.frombuffer(self.at(size - 9 - 12 * n, 12 * n), "<u4").reshape(n, 3)
        self.offsets = np.concatenate([[0], np.cumsum(self.entries[:, 0].astype(np.int64))])
        end = int(self.offsets[-1])
        kind, length = struct.unpack("<II", self.at(end, 8))
        if kind != SKIPPABLE_IDS:
            raise ValueError("the table of document ids is missing")
        self.unpacker = zstandard.ZstdDecompressor()
        body = self.unpacker.decompress(self.at(end + 8, length))
        self.width = body[0]
        none = np.frombuffer(body[1 : 1 + n], np.uint8)
        ids = np.frombuffer(body[1 + n :], "<i8")
        self.ids = [None if x else int(i) for x, i in zip(none, ids)]

    def at(self, offset: int, size: int) -> bytes:
        self.source.seek(offset)
        return self.source.read(size)

    def document(self, k: int) -> np.ndarray:
        """Ids of the k-th document; a wrong checksum raises."""
        packed = self.at(int(self.offsets[k]), int(self.entries[k, 0]))
        return self.checked(k, packed)

    def checked(self, k: int, packed: bytes) -> np.ndarray:
        plain = self.unpacker.decompress(packed, max_output_size=int(self.entries[k, 1]))
        if xxhash.xxh64_intdigest(plain) & 0xFFFFFFFF != self.entries[k, 2]:
            raise ValueError(f"frame {k} doesn't match its checksum")
        return np.frombuffer(plain, f"<u{self.width}")


def encode(
    docs: DataFrame, tokenizer: str, end_id: int, width: int = 2, id_col: str = "doc_id", text_col: str = "text",
    batch_bytes: int = BATCH_BYTES,
) -> DataFrame:
    """(doc_id, ids): ids of each whole text and the end id, packed to ``width`` bytes each (2 or 4)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = units.word_level(tokenizer)
        for batch in by_size(batches, "text", batch_bytes):
            keys, sizes = units.split_all(texts_of(batch, "text"), units.words)
            rows = found.rows(keys)
            ends = np.cumsum(units.sums(found.counts(rows), sizes))
            ids = found.ids(rows)
            if len(ids) and int(ids.max()) >= 1 << 8 * width:
                raise ValueError("an id doesn't fit the width")
            ids = np.insert(ids, ends, end_id).astype(f"<u{width}")
            cuts = np.concatenate([[0], ends + np.arange(1, len(ends) + 1)]).astype(np.int64) * width
            packed = pa.Array.from_buffers(
                pa.large_binary(), batch.num_rows, [None, pa.py_buffer(cuts), pa.py_buffer(ids)]
            ).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), packed], names=["doc_id", "ids"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, ids binary")


def write(encoded: DataFrame, ids_of: DataFrame, folder: str, width: int = 2, shards: int | None = None, level: int = 3) -> DataFrame:
    """Writes the shards below ``folder`` and returns the manifest, read from its own table.

    ``ids_of``: the documents, of which only ``doc_id`` is read for the bounds of the shards
    (sampled quantiles; the number of bounds is the number of shards). Null ids come first;
    rows of one id are ordered by their packed ids.
    """
    spark = encoded.sparkSession
    count = shards or partitions(spark)
    shares = [k / count for k in range(1, count)]
    column = ids_of.select(F.col("doc_id").cast("long").alias("doc_id"))
    bounds = np.unique(np.array(column.approxQuantile("doc_id", shares, 0.25 / count) if shares else [], np.int64))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).fill_null(np.iinfo(np.int64).min).to_numpy(zero_copy_only=False)
            shard = np.searchsorted(bounds, ids, side="left").astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(shard), batch.column(0), batch.column(1)], names=["shard", "doc_id", "ids"])

    def save(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = file_system(folder)
        store.create_dir(root, recursive=True)
        writer, shard, path = None, None, ""
        done: list[tuple] = []

        def finish() -> None:
            writer.close()
            done.append((shard, path, len(writer.ids), writer.tokens, writer.bytes))

        for batch in batches:
            for at, doc_id, plain in zip(*(batch.column(k).to_pylist() for k in range(3))):
                if at != shard:
                    if writer:
                        finish()
                    shard, path = at, f"{folder}/shard-{at:06d}-{uuid.uuid4().hex}.zst"
                    writer = ShardWriter(store.open_output_stream(f"{root}/{path.rpartition('/')[2]}", compression=None), width, level)
                writer.add(doc_id, plain)
        if writer:
            finish()
        names = ["shard", "path", "docs", "tokens", "bytes"]
        kinds = [pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
        columns = list(zip(*done)) if done else [[]] * 5
        yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], names=names)

    placed = encoded.select("doc_id", "ids").mapInArrow(place, "shard int, doc_id long, ids binary")
    # The shard is the partition, so no task writes two.
    ordered = placed.repartitionById(count, F.col("shard")).sortWithinPartitions("shard", F.col("doc_id").asc_nulls_first(), "ids")
    ordered.mapInArrow(save, MANIFEST).write.mode("errorifexists").parquet(f"{folder}/manifest")
    return spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")


def read(manifest: DataFrame, wanted: DataFrame | None = None, with_ids: bool = True) -> DataFrame:
    """(doc_id, start, n_tokens, ids, ids_crc32) of the documents of a manifest.

    ``start``: ids of all documents before it. ``wanted``: one row per document with its
    ``shard`` and ``doc_id``; only frames of these documents are then decompressed.
    ``with_ids=False`` leaves ``ids`` null where only the digest is needed.
    """
    # One row per shard file, so this window is as small as the manifest.
    order = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    shards = manifest.select("shard", "path", F.coalesce(F.sum("tokens").over(order), F.lit(0)).alias("before"))
    if wanted is None:
        shards = shards.withColumn("only", F.lit(None).cast("array<long>"))
    else:
        shards = shards.join(wanted.groupBy("shard").agg(F.collect_set("doc_id").alias("only")), "shard")

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "start", "n_tokens", "ids", "ids_crc32"]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64()]
        for batch in batches:
            for _, path, before, only in zip(*(c.to_pylist() for c in batch.columns)):
                store, inner = file_system(path)
                only = None if only is None else set(only)
                with store.open_input_file(inner) as source:
                    reader = ShardReader(source)
                    starts = before + np.concatenate([[0], np.cumsum(reader.entries[:, 1].astype(np.int64) // reader.width)])
                    rows: list[tuple] = []
                    for k, doc_id in enumerate(reader.ids):
                        if only is not None and doc_id not in only:
                            continue
                        ids = reader.document(k).astype("<u4").tobytes()
                        rows.append((doc_id, int(starts[k]), len(ids) // 4, ids if with_ids else None, zlib.crc32(ids)))
                        if len(rows) == 2000 or k == len(reader.ids) - 1:
                            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows), kinds)], names=names)
                            rows = []
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows), kinds)], names=names)

    count = partitions(manifest.sparkSession)
    spread = shards.repartitionById(count, F.pmod("shard", F.lit(count)))
    return spread.mapInArrow(load, "doc_id long, start long, n_tokens long, ids binary, ids_crc32 long")


def store_tokens(docs: DataFrame, tokenizer: str, end_id: int, folder: str | None = None, width: int = 2, **kwargs) -> DataFrame:
    """Encodes every text, writes the files and returns their manifest.

    Null and empty texts hold the end id only. An empty table gives an empty manifest.
    Repeated ids are kept, each row as a document. Other columns are ignored.
    """
    folder = folder or fresh_dir(docs.sparkSession, "tokens")
    return write(encode(docs, tokenizer, end_id, width), docs, folder, width, **kwargs)
