"""Hash partitions, physical row addresses and tagged words as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from brindle.errors import ConfigError


def hash_bucket(buckets: int, *keys: Column, level: int = 0) -> Column:
    """Bucket of a row by its keys; another level gives independent buckets.

    The first 32 bits of the md5 of level and keys as text, so that any other engine can find the same bucket.
    """
    if buckets < 1:
        raise ConfigError("at least one bucket is needed")
    text = F.concat_ws("\x1f", F.lit(str(level)), *[F.coalesce(k.cast("string"), F.lit("\x00")) for k in keys])
    return F.pmod(F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint"), F.lit(buckets)).cast("int")


def item_pointer(row_id: Column, slots: int = 128) -> tuple[Column, Column]:
    """Block and offset of a row where each block has so many slots."""
    return F.floor(row_id / slots).cast("bigint"), F.pmod(row_id, F.lit(slots)).cast("bigint")


def tagged(tx: Column) -> Column:
    """A transaction id as a 64-bit word that no timestamp equals: its top bit is set."""
    return F.lit(-(1 << 63)).bitwiseOR(tx.cast("bigint"))


def is_owner(word: Column) -> Column:
    """Whether a word holds a transaction id; in signed arithmetic it is then negative."""
    return word < 0


def owner(word: Column) -> Column:
    """The transaction id of a word, or null for a timestamp."""
    return F.when(is_owner(word), word.bitwiseAND(F.lit((1 << 63) - 1)))
