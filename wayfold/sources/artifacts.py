"""Committed artifacts of a run and the redacted review export."""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfold.session import cut_lineage

#: Bytes of files that one task writes, and of a block when parts are put together.
STRETCH, COPIED = 64 * 2**20, 8 * 2**20
MANIFEST = "artifact string, run string, committed_at timestamp, commit string"


def publish(df: DataFrame, root: str, name: str) -> str:
    """Writes one complete version and then commits it with a manifest row.

    Every writer has its own folders for the rows and for the manifest row, so two
    writers never mix; a version that was not committed is invisible.
    """
    spark = df.sparkSession
    run = uuid.uuid4().hex
    df.write.mode("errorifexists").parquet(f"{root}/{name}/run={run}")
    commit = spark.range(1).select(
        F.lit(name).alias("artifact"), F.lit(run).alias("run"), F.current_timestamp().alias("committed_at")
    )
    commit.coalesce(1).write.mode("errorifexists").parquet(f"{root}/manifest/commit={run}")
    return run


def write_files(chunks: DataFrame, root: str, *, stretch: int = STRETCH) -> DataFrame:
    """Writes files below root from (path, place, content) rows, a file's chunks in the order of their places; (path, bytes).

    The chunks are dealt into sampled ranges of path and place of about ``stretch`` bytes, so neither a large file nor several
    files of one hash fill a task. Each range writes its part of a file under a name of its own. A file's parts are then
    put together by one task per file, block by block, under a name of its own that is moved to the path when it is
    complete, so a repeated task leaves no half of a file.
    """
    spark = chunks.sparkSession
    where = "file://" + root if root.startswith("/") else root

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(where)
        path, out, size, made = None, None, 0, []

        def close() -> None:
            out.close()
            made.append((path, part, draft, size))

        for batch in batches:
            for row in batch.itertuples(index=False):
                if row[0] != path:
                    if out is not None:
                        close()
                    path, size, part = row[0], 0, row[2]
                    store.create_dir(f"{base}/{path}".rsplit("/", 1)[0], recursive=True)
                    draft = f"{path}.{uuid.uuid4().hex}.part"
                    out = store.open_output_stream(f"{base}/{draft}", compression=None)
                out.write(row[1])
                size += len(row[1])
        if out is not None:
            close()
        yield pd.DataFrame(made, columns=["path", "part", "draft", "bytes"]).astype({"path": str, "part": "int32", "draft": str, "bytes": "int64"})

    def join(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(where)
        for batch in batches:
            for path, drafts, size in batch.itertuples(index=False):
                parts = [f"{base}/{d}" for d in drafts]
                there = [f.is_file for f in store.get_file_info(parts)]
                # An earlier attempt may have got as far as the removal of the parts.
                if not all(there) and store.get_file_info(f"{base}/{path}").size != size:
                    raise FileNotFoundError(f"parts of {path}")
                if all(there) and len(parts) == 1:
                    store.move(parts[0], f"{base}/{path}")
                elif all(there):
                    draft = f"{base}/{path}.{uuid.uuid4().hex}.part"
                    with store.open_output_stream(draft, compression=None) as out:
                        for part in parts:
                            with store.open_input_stream(part, compression=None) as source:
                                while data := source.read(COPIED):
                                    out.write(data)
                    store.move(draft, f"{base}/{path}")
                for part, left in zip(parts, there, strict=True):
                    if left and len(parts) > 1 or left and not all(there):
                        store.delete_file(part)
                yield pd.DataFrame({"path": [path], "bytes": [size]})

    rows = chunks.select("path", "place", "content")
    size = rows.agg(F.sum(F.octet_length("content"))).first()[0] or 0
    ranges = max(spark.sparkContext.defaultParallelism, -(-size // stretch))
    dealt = rows.repartitionByRange(ranges, "path", "place").sortWithinPartitions("path", "place")
    parts = dealt.select("path", "content", F.spark_partition_id().alias("part"))
    written = cut_lineage(parts.mapInPandas(write, "path string, part int, draft string, bytes long"))
    files = written.groupBy("path").agg(F.sort_array(F.collect_list(F.struct("part", "draft"))).alias("parts"), F.sum("bytes").alias("bytes"))
    # The tasks are handed names only. A range parts two files at most, so those in several parts are no more than the ranges: a task for each.
    named = cut_lineage(files.select("path", F.transform("parts", lambda p: p["draft"]).alias("drafts"), "bytes"))
    several = named.filter(F.size("drafts") > 1)
    single = named.filter(F.size("drafts") == 1).repartition(spark.sparkContext.defaultParallelism)
    shape = "path string, bytes long"
    joined = several.repartition(max(1, several.count())).mapInPandas(join, shape)
    return cut_lineage(single.mapInPandas(join, shape).unionByName(joined))


def latest_run(spark: SparkSession, root: str, name: str) -> str:
    manifest = spark.read.schema(MANIFEST).parquet(f"{root}/manifest").filter(F.col("artifact") == name)
    row = manifest.agg(F.max(F.struct("committed_at", "run"))["run"].alias("run")).first()
    if row["run"] is None:
        raise FileNotFoundError(f"no committed version of {name}")
    return row["run"]


def read_latest(spark: SparkSession, root: str, name: str) -> DataFrame:
    """Newest committed version of an artifact."""
    return spark.read.parquet(f"{root}/{name}/run={latest_run(spark, root, name)}")


def redacted(text: Column, root: str) -> Column:
    """Text without the absolute folder it was made in."""
    return F.replace(text, F.lit(root.rstrip("/") + "/"), F.lit(""))


def redact_columns(df: DataFrame, root: str) -> DataFrame:
    names = {f.name for f in df.schema.fields if f.dataType.simpleString() == "string"}
    return df.select(*[redacted(F.col(c), root).alias(c) if c in names else F.col(c) for c in df.columns])


def review_rows(
    artifacts: DataFrame, allowed: Sequence[str], root: str, kept: Sequence[str]
) -> DataFrame:
    """Allowed artifacts only, tasks only when validated, chosen fields, no root.

    ``artifacts`` has name, kind and status next to the fields of ``kept``.
    """
    open_rows = artifacts.filter(
        F.col("name").isin(*allowed) & ((F.col("kind") != "task") | (F.col("status") == "validated"))
    )
    return redact_columns(open_rows.select("name", "kind", *kept), root)


def export(artifacts: Mapping[str, DataFrame], allowed: Sequence[str], root: str, target: str) -> list[str]:
    """Writes the allowed artifacts of a run below ``target``, text redacted."""
    written = [n for n in allowed if n in artifacts]
    for name in written:
        redact_columns(artifacts[name], root).write.mode("overwrite").parquet(f"{target}/{name}")
    return written
