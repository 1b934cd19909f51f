"""Sizes of texts in words, as columns."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brindle.llm import text as tx
from brindle.session import bound_batches

#: Bytes whose words are hashed at once.
BYTES_AT_ONCE = 1 << 18
#: What separates words in Spark's regular expressions.
GAP = r"[\x20\x09-\x0D]+"


@F.arrow_udf(T.LongType())
def word_count(text: pa.Array) -> pa.Array:
    """Words of a text: runs of bytes other than 0x20 and 0x09 to 0x0D; null has none."""
    return pa.array(tx.word_counts(*tx.utf8(text)))


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = tx.utf8(batch.column("text"))
        for a, b in tx.groups(offsets, BYTES_AT_ONCE):
            hashes, at = tx.words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
            n = np.diff(at)
            place = np.arange(len(hashes)) - np.repeat(at[:-1], n)
            total = np.concatenate([np.zeros(1, tx.U), np.cumsum(tx.mix(hashes ^ tx.mix(place.astype(tx.U))), dtype=tx.U)])
            cluster = tx.mix(total[at[1:]] - total[at[:-1]] + n.astype(tx.U)).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id")[a:b], batch.column("source")[a:b], pa.array(n), pa.array(cluster)], ["doc_id", "source", "size", "cluster"])


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, source, size in words, and cluster: a hash that texts with the same lower-cased words share."""
    bound_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("source").cast("string").alias("source"), "text").mapInArrow(_measure, "doc_id bigint, source string, size bigint, cluster bigint")
