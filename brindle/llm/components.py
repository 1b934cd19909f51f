"""Connected components of links between integer nodes, in rounds over shared tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.session import materialize, release


#: Rows up to which a table of ids is broadcast; each takes about 50 bytes.
BROADCAST_ROWS = 500_000


def small(table: DataFrame) -> DataFrame:
    """Broadcasts a written table if it has few rows; beyond that, joins shuffle and skew is split."""
    return F.broadcast(table) if table.count() <= BROADCAST_ROWS else table


def _mark(links: DataFrame) -> tuple[int, int]:
    found = links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return found[0], int(found[1] or 0)


def _settled(links: DataFrame) -> bool:
    """Whether all links, from greater to lesser nodes, lead to the root of their component at once."""
    again = links.groupBy("u").agg(F.count("*").alias("n")).filter("n > 1").select("u")
    inner = links.join(links.select(F.col("v").alias("w")), F.col("u") == F.col("w"), "left_semi").select("u")
    return again.unionAll(inner).isEmpty()


def components(links: DataFrame) -> DataFrame:
    """The component of every node that has a link: columns node and root, the least node.

    ``links`` has integer columns u and v in any order. Alternating star contraction: every node
    passes its least neighbour on to its greater neighbours, then to its lesser ones, until all links
    of a component lead to its least node, in rounds that grow with the logarithm of its diameter. Only the minimum of each node is aggregated, in part before
    the shuffle; a node with very many links is spread by the skew join, because both of its sides
    are written tables. Each round is written to shared storage, which also cuts the lineage.
    """
    now = materialize(links.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    mark = _mark(now)
    while mark[0] and not _settled(now):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = materialize(both.groupBy(F.col("u").alias("w")).agg(F.min("v").alias("m")).select("w", F.least("w", "m").alias("m")), "least")
        large = both.join(small(least), F.col("u") == F.col("w")).filter("v > u AND v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = materialize(large, "large")
        lower = materialize(large.groupBy(F.col("u").alias("w")).agg(F.min("v").alias("m")), "lower")
        fewer = large.join(small(lower), F.col("u") == F.col("w")).filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = materialize(fewer.unionByName(lower.select(F.col("w").alias("u"), F.col("m").alias("v"))).distinct(), "links")
        then, old = _mark(after), now
        now = after
        release(old, least, large, lower)
        if then == mark:
            break
        mark = then
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
