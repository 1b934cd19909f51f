"""The plan language: a tree of nodes that ``lower`` turns into one lazy DataFrame."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import singledispatch

from pyspark.sql import Column, DataFrame

from brindle.errors import InternalError
from brindle.operators import dml, join, relational
from brindle.sources import scan


class Plan:
    """Base class of nodes."""


@dataclass(frozen=True)
class RawInput(Plan):
    data: DataFrame


@dataclass(frozen=True)
class SeqScan(Plan):
    table: DataFrame
    columns: tuple[str, ...] | None = None
    predicate: str | None = None


@dataclass(frozen=True)
class IndexScan(Plan):
    table: DataFrame
    key: str
    value: object


@dataclass(frozen=True)
class RangeScan(Plan):
    table: DataFrame
    key: str
    lower: object = None
    upper: object = None
    options: dict = field(default_factory=dict)


@dataclass(frozen=True)
class Filter(Plan):
    child: Plan
    predicate: str | Column


@dataclass(frozen=True)
class Project(Plan):
    child: Plan
    targets: dict


@dataclass(frozen=True)
class HashJoin(Plan):
    left: Plan
    right: Plan
    on: tuple[tuple[str, str], ...]
    strategy: str = "auto"
    null_safe: bool = False


@dataclass(frozen=True)
class NestedLoopJoin(Plan):
    left: Plan
    right: Plan
    condition: str


@dataclass(frozen=True)
class Aggregate(Plan):
    child: Plan
    keys: tuple[str, ...]
    aggregates: dict


@dataclass(frozen=True)
class Distinct(Plan):
    child: Plan
    columns: tuple[str, ...] | None = None


@dataclass(frozen=True)
class Limit(Plan):
    child: Plan
    n: int
    order: tuple[Column, ...] | None = None


@dataclass(frozen=True)
class Insert(Plan):
    table: Plan
    source: Plan


@dataclass(frozen=True)
class Update(Plan):
    table: Plan
    changes: dict
    predicate: str


@dataclass(frozen=True)
class Delete(Plan):
    table: Plan
    predicate: str


@singledispatch
def lower(plan: Plan) -> DataFrame:
    """The DataFrame of a plan."""
    raise InternalError(f"no rule for {type(plan).__name__}")


@lower.register
def _(p: RawInput) -> DataFrame:
    return p.data


@lower.register
def _(p: SeqScan) -> DataFrame:
    df = p.table if p.predicate is None else p.table.filter(p.predicate)
    return scan.seq_scan(df, None if p.columns is None else list(p.columns))


@lower.register
def _(p: IndexScan) -> DataFrame:
    return scan.index_scan(p.table, p.key, p.value)


@lower.register
def _(p: RangeScan) -> DataFrame:
    return scan.range_scan(p.table, p.key, p.lower, p.upper, **p.options)


@lower.register
def _(p: Filter) -> DataFrame:
    return relational.where(lower(p.child), p.predicate)


@lower.register
def _(p: Project) -> DataFrame:
    return relational.project(lower(p.child), p.targets)


@lower.register
def _(p: HashJoin) -> DataFrame:
    return join.equi_join(lower(p.left), lower(p.right), list(p.on), p.strategy, p.null_safe)


@lower.register
def _(p: NestedLoopJoin) -> DataFrame:
    return join.nested_loop_join(lower(p.left), lower(p.right), p.condition)


@lower.register
def _(p: Aggregate) -> DataFrame:
    return relational.aggregate(lower(p.child), list(p.keys), p.aggregates)


@lower.register
def _(p: Distinct) -> DataFrame:
    return relational.distinct(lower(p.child), None if p.columns is None else list(p.columns))


@lower.register
def _(p: Limit) -> DataFrame:
    return relational.limit(lower(p.child), p.n, None if p.order is None else list(p.order))


@lower.register
def _(p: Insert) -> DataFrame:
    return dml.insert(lower(p.table), lower(p.source))


@lower.register
def _(p: Update) -> DataFrame:
    return dml.update(lower(p.table), p.changes, p.predicate)


@lower.register
def _(p: Delete) -> DataFrame:
    return dml.delete(lower(p.table), p.predicate)
