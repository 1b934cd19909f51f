"""Joins.

The inner equi-join is the central operator. Rows pair when all keys are equal; a null key equals
nothing unless ``null_safe``; every pair is returned; left columns come first, then right ones,
renamed where names clash. Catalyst picks the strategy from sizes. A hint can ask for another one:
sort-merge spills, can be split where keys are skewed and so holds at any size; shuffled hash needs
one partition's right side in memory; broadcast needs the whole right side there.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.errors import ConfigError
from brindle.functions.types import check_keys

#: Strategy names and the hints that ask for them.
STRATEGIES = {"auto": None, "merge": "merge", "shuffle_hash": "shuffle_hash", "broadcast": "broadcast"}

#: Largest estimated right side, in bytes, that an asked-for broadcast is granted.
BROADCAST_LIMIT = 256 << 20


def _apart(left: DataFrame, right: DataFrame, prefixes: tuple[str, str]) -> tuple[DataFrame, DataFrame]:
    both = {c for c in left.columns if c in set(right.columns)}
    name = lambda prefix, c: f"{prefix}{c}" if c in both else c
    return (
        left.select(*[F.col(f"`{c}`").alias(name(prefixes[0], c)) for c in left.columns]),
        right.select(*[F.col(f"`{c}`").alias(name(prefixes[1], c)) for c in right.columns]),
    )


def estimated_bytes(df: DataFrame) -> int:
    """The optimizer's estimate of a table's size."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def equi_join(left: DataFrame, right: DataFrame, on: list[tuple[str, str]], strategy: str = "auto", null_safe: bool = False, prefixes: tuple[str, str] = ("l_", "r_")) -> DataFrame:
    """Inner join on pairs of key columns. A broadcast is granted only below ``BROADCAST_LIMIT``."""
    if strategy not in STRATEGIES:
        raise ConfigError(f"unknown strategy {strategy}; one of {', '.join(STRATEGIES)}")
    check_keys(left, right, on)
    both = {c for c in left.columns if c in set(right.columns)}
    left, right = _apart(left, right, prefixes)
    hint = STRATEGIES[strategy]
    if hint == "broadcast" and estimated_bytes(right) > BROADCAST_LIMIT:
        hint = None
    if hint:
        right = right.hint(hint)
    conditions = []
    for a, b in on:
        x = left[f"{prefixes[0]}{a}" if a in both else a]
        y = right[f"{prefixes[1]}{b}" if b in both else b]
        conditions.append(x.eqNullSafe(y) if null_safe else x == y)
    return left.join(right, reduce(lambda p, q: p & q, conditions), "inner")


def skew_join(left: DataFrame, right: DataFrame, on: list[tuple[str, str]], share: float = 0.01, salts: int = 16, null_safe: bool = False, prefixes: tuple[str, str] = ("l_", "r_")) -> DataFrame:
    """``equi_join`` whose heavy keys are dealt to ``salts`` parts each.

    A key with more than ``share`` of the left rows is heavy, so there are fewer than 1 / share of them,
    which is what bounds the broadcast of their list. A left row of a heavy key goes to one part by a hash
    of the row, and the right rows of the key to all parts. Equal left rows stay together, and adaptive
    execution splits those.
    """
    if not 0 < share <= 1 or salts < 1:
        raise ConfigError("share has to be above 0 and at most 1, and salts at least 1")
    check_keys(left, right, on)
    salt, names = "_salt", [f"_key{i}" for i in range(len(on))]
    keys = left.groupBy(*[F.col(f"`{a}`").alias(n) for (a, _), n in zip(on, names, strict=True)]).agg(F.count("*").alias("_n"))
    total = F.broadcast(keys.agg(F.sum("_n").alias("_all")))
    heavy = F.broadcast(keys.join(total).filter(F.col("_n") > F.lit(share) * F.col("_all")).select(*names, F.lit(True).alias("_heavy")))

    def marked(df: DataFrame, columns: list[str]) -> DataFrame:
        return df.join(heavy, reduce(lambda p, q: p & q, [F.col(f"`{c}`").eqNullSafe(F.col(n)) for c, n in zip(columns, names, strict=True)]), "left")

    dealt = F.when(F.col("_heavy"), F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in left.columns]), F.lit(salts)).cast("int")).otherwise(F.lit(0))
    copies = F.when(F.col("_heavy"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    one = marked(left, [a for a, _ in on]).select(*[F.col(f"`{c}`") for c in left.columns], dealt.alias(salt))
    two = marked(right, [b for _, b in on]).select(*[F.col(f"`{c}`") for c in right.columns], F.explode(copies).alias(salt))
    out = equi_join(one, two, [*on, (salt, salt)], null_safe=null_safe, prefixes=prefixes)
    both = set(left.columns) & set(right.columns)
    return out.select(*[F.col(f"`{p}{c}`" if c in both else f"`{c}`") for df, p in ((left, prefixes[0]), (right, prefixes[1])) for c in df.columns])


def nested_loop_join(left: DataFrame, right: DataFrame, condition: str | Column, prefixes: tuple[str, str] = ("l_", "r_")) -> DataFrame:
    """Inner join on any condition over the renamed columns.

    Each pair of rows is looked at, so one side has to be small: the right one is broadcast if the
    optimizer's estimate of it is below ``BROADCAST_LIMIT``, or else the left one by the same rule. With two
    larger sides the pairs are dealt to tasks as a product of partitions, which no memory bounds but time does.
    """
    left, right = _apart(left, right, prefixes)
    if estimated_bytes(right) <= BROADCAST_LIMIT:
        right = F.broadcast(right)
    elif estimated_bytes(left) <= BROADCAST_LIMIT:
        left = F.broadcast(left)
    return left.join(right, F.expr(condition) if isinstance(condition, str) else condition, "inner")
