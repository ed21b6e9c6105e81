"""Token counts of whole texts.

Arrow functions return lengths only: no ids leave the worker. Batches are balanced by
bytes and long texts are cut at safe boundaries (see ``units``); the counts equal the
library's on the whole text. There is no shuffle, and a lost task is simply run again.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfold.llm import units
from wayfold.llm.common import by_size, texts_of

BATCH_BYTES = 3_000_000


def count_tokens(
    docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 512,
    batch_bytes: int = BATCH_BYTES,
) -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) of every row.

    ``tokenizer``: file of a byte-level tokenizer without a normaliser. Null and empty
    texts have 0 bytes and 0 tokens; a null id stays null; repeated rows are counted each;
    other columns are ignored; an empty table gives an empty result.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = units.byte_level(tokenizer)
        for batch in by_size(batches, "text", batch_bytes):
            keys, sizes = units.split_all(texts_of(batch, "text"), units.spaced_pieces)
            tokens = units.sums(found.counts(found.rows(keys)), sizes)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(tokens, pa.int64()), pa.array(tokens > limit, pa.bool_())],
                names=["id", "n_bytes", "n_tokens", "over_limit"],
            )

    rows = docs.select(
        F.col(id_col).cast("long").alias("id"),
        F.col(text_col).alias("text"),
        F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes"),
    )
    out = rows.mapInArrow(count, "id long, n_bytes long, n_tokens long, over_limit boolean")
    return out.withColumnRenamed("id", id_col)
