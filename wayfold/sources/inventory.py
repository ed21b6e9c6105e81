"""File receipts and the task inventory."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfold.operators import inventory

# Header of a large-file pointer and magic of a database file.
POINTER_HEADER = "version https://git-lfs.github.com/spec/v1"
DATABASE_MAGIC = "DUCK"
#: Bytes of a file's head that tell its kind.
HEAD = 512
#: Larger files are streamed, in blocks of so many bytes.
WHOLE_FILE, BLOCK = 256 * 2**20, 8 * 2**20
PUBLIC_METADATA = ("difficulty", "category", "tags", "db_name")


def _listed(spark: SparkSession, root: str, glob: str) -> DataFrame:
    """(path below root, bytes, content, _file); the content is only read where a query asks for it."""
    found = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", glob)
        .load(root)
    )
    below = r"^(?:file:)?/*\Q" + root.removeprefix("file:").strip("/") + r"\E/+"
    path = F.regexp_replace(F.url_decode(F.replace("path", F.lit("+"), F.lit("%2B"))), below, "")
    return found.select(path.alias("path"), F.col("length").alias("bytes"), "content", F.col("path").alias("_file"), "length")


def files(spark: SparkSession, root: str, glob: str = "*") -> DataFrame:
    """(path, bytes, content) of the files below root; one file is one row, up to 2 GiB."""
    return _listed(spark, root, glob).select("path", "bytes", "content")


def hashed_files(spark: SparkSession, root: str, glob: str = "*", *, whole: int = WHOLE_FILE, block: int = BLOCK) -> DataFrame:
    """(path, bytes, head, sha256) of the files below root, of any size.

    Files of at most ``whole`` bytes are read by Spark as a row, from any store that Spark reads. Larger ones are
    streamed through the digest in blocks by one task each, and never lie in memory or in a cell; their store has to be one
    that Arrow opens by its address (local, HDFS, S3, GCS).
    """
    listed = _listed(spark, root, glob)
    head = F.substring("content", 1, HEAD)
    small = listed.filter(F.col("length") <= whole).select("path", "bytes", head.alias("head"), F.sha2("content", 256).alias("sha256"))
    large = listed.filter(F.col("length") > whole).select("path", "bytes", "_file")

    def stream(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                first, digest = digest_of(row[2], block)
                yield pd.DataFrame({"path": [row[0]], "bytes": [row[1]], "head": [first], "sha256": [digest]})

    # One task per file, whatever the sizes of the listing's rows.
    apart = large.repartition(max(1, large.count()), "path")
    return small.unionByName(apart.mapInPandas(stream, "path string, bytes long, head binary, sha256 string"))


def digest_of(address: str, block: int = BLOCK) -> tuple[bytes, str]:
    """(first bytes, SHA-256) of a file, read block by block."""
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri("file://" + address.removeprefix("file:") if address.startswith("file:/") else address)
    digest, first = hashlib.sha256(), b""
    with store.open_input_stream(path, compression=None, buffer_size=block) as source:
        while data := source.read(block):
            first += data[: HEAD - len(first)]
            digest.update(data)
    return first, digest.hexdigest()


def receipts(found: DataFrame) -> DataFrame:
    """Path, size and SHA-256 of every file."""
    return found.select("path", "bytes", F.sha2("content", 256).alias("sha256"))


def database_receipts(found: DataFrame, expected: DataFrame | None = None) -> DataFrame:
    """Receipts with the kind of file: pointer, database file, other; or missing.

    ``found``: rows of ``hashed_files`` or of ``files``. A pointer is not the data it points at. ``expected`` lists wanted paths.
    """
    streamed = "head" in found.columns
    start = F.col("head") if streamed else F.substring("content", 1, HEAD)
    head = F.decode(start, "ISO-8859-1")
    pointer = head.startswith(POINTER_HEADER)
    magic = F.decode(F.substring(start, 9, 4), "ISO-8859-1") == DATABASE_MAGIC
    field = lambda name: F.when(
        pointer, F.nullif(F.regexp_extract(head, rf"(?m)^{name} (\S+)", 1), F.lit(""))
    )
    rows = found.select(
        "path",
        "bytes",
        F.col("sha256") if streamed else F.sha2("content", 256).alias("sha256"),
        F.when(pointer, "git_lfs_pointer").when(magic, "duckdb_file").otherwise("unrecognized_binary").alias("status"),
        (~pointer & magic).alias("materialized"),
        field("oid").alias("lfs_oid"),
        field("size").try_cast("long").alias("expected_bytes"),
    )
    if expected is None:
        return rows
    return expected.select("path").join(rows, "path", "left").fillna({"status": "missing", "materialized": False})


def tasks(metadata: DataFrame, found: DataFrame) -> DataFrame:
    """One row per task: allowed metadata, labels, instruction hash, file receipts.

    ``metadata`` holds the task settings as a table (task_id and any fields; only
    the public ones pass). Files are below ``tasks/<task_id>/``. A task of the
    metadata without an instruction, and so one without files, stops the job; so does
    metadata that lists no task.
    """
    if metadata.isEmpty():
        raise ValueError("no task found")
    task = F.regexp_extract("path", r"(?:^|/)tasks/([^/]+)/", 1)
    listed = found.withColumn("task_id", task).filter("task_id <> ''")
    per_file = receipts(listed).withColumn("task_id", task)
    packed = per_file.groupBy("task_id").agg(
        F.count(F.lit(1)).alias("file_count"),
        F.sum("bytes").alias("file_bytes"),
        F.sort_array(F.collect_list(F.struct("path", "bytes", "sha256"))).alias("files"),
    )
    text = listed.filter(F.col("path").rlike(r"(?:^|/)tasks/[^/]+/instruction\.md$")).select(
        "task_id", F.decode("content", "UTF-8").alias("instruction")
    )
    public = [c for c in metadata.columns if c in PUBLIC_METADATA]
    for name, kind in (("category", "string"), ("tags", "array<string>"), ("difficulty", "string")):
        if name not in public:
            metadata, public = metadata.withColumn(name, F.lit(None).cast(kind)), [*public, name]
    rows = metadata.select("task_id", *public).join(packed, "task_id", "left").join(text, "task_id", "left")
    return inventory.labelled(rows.withColumn("instruction", _required(F.col("instruction"))))


def _required(instruction: Column) -> Column:
    return F.when(instruction.isNotNull(), instruction).otherwise(
        F.raise_error(F.concat(F.lit("task lacks an instruction: "), F.col("task_id")))
    )
