"""Finite streams of batches.

The engine's operators work on bounded tables. A bounded stream of batches with one schema becomes
one table, lazily, so the operators apply to it unchanged.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import DataFrame

from brindle.errors import ValueError_


def replay(batches: Iterable[DataFrame]) -> DataFrame:
    """The rows of all batches; their columns have to agree."""
    batches = list(batches)
    if not batches:
        raise ValueError_("a stream without batches has no schema")
    return reduce(DataFrame.unionByName, batches)
