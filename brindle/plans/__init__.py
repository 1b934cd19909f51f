"""Plan nodes and their translation to DataFrames."""

from brindle.plans.nodes import (  # noqa: F401
    Aggregate,
    Delete,
    Distinct,
    Filter,
    HashJoin,
    IndexScan,
    Insert,
    Limit,
    NestedLoopJoin,
    Project,
    RangeScan,
    RawInput,
    SeqScan,
    Update,
    lower,
)
