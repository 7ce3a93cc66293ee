"""Operator 10: token counts. Lengths only, in Arrow, with tasks balanced by bytes and long texts split at safe boundaries."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bpe, words

#: A text's tokens beyond which it is marked.
LIMIT = 1024


def token_counts(docs: DataFrame, tokenizer: str, id_column: str = "doc_id", text_column: str = "text", limit: int = LIMIT) -> DataFrame:
    """Per row: the id, ``n_bytes``, ``n_tokens`` and ``over_limit`` (n_tokens > limit).

    Null and empty texts: 0 bytes, 0 tokens, not over. Rows with a null or repeated id are
    counted like any other; other columns are not read. An empty table gives no rows. A
    batch is encoded in slices of about equal bytes; a text of any length is encoded in
    chunks, so a worker holds the ids of one chunk only.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = bpe.opened(tokenizer)
        for batch in batches:
            for part in words.sliced(batch):
                texts = pc.fill_null(part.column("text"), "")
                n = pa.array([enc.count(t) for t in texts.to_pylist()], pa.int64())
                n_bytes = pc.binary_length(texts).cast(pa.int64())
                yield pa.RecordBatch.from_arrays([part.column("id"), n_bytes, n, pc.greater(n, limit)], ["id", "n_bytes", "n_tokens", "over_limit"])

    source = docs.select(F.col(id_column).cast("bigint").alias("id"), F.col(text_column).alias("text"))
    out = source.mapInArrow(count, "id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean")
    return out.withColumnRenamed("id", id_column)
