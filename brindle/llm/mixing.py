"""Mixing sources to target weights by capped water-filling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brindle.llm.sizes import word_count
from brindle.session import bound_batches, materialize, scratch

#: Rows up to which the table of sources is broadcast.
BROADCAST_ROWS = 100_000


def sized(docs: DataFrame) -> DataFrame:
    """A written table of doc_id, source, size in words and name, as ``plan`` takes it.

    name is what orders documents: the doc_id, or without one the md5 of the text, so that rows without an id differ.
    """
    bound_batches(docs.sparkSession)
    return materialize(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("source").cast("string").alias("source"), word_count("text").alias("size"), name_of(F.col("doc_id"), F.col("text")).alias("name")), "sizes")


def name_of(doc_id: Column, text: Column) -> Column:
    return F.coalesce(doc_id.cast("bigint").cast("string"), F.md5(F.coalesce(text, F.lit(""))))


def place(seed: int, name: Column) -> Column:
    """A document's place in its source's seeded order: a hash of its name as 32 hexadecimal digits."""
    return F.md5(F.concat(F.lit(f"{seed}:"), name))


def _numbered(totals: DataFrame) -> DataFrame:
    """Sources with their number in order of code points, null last, from 0.

    The order is made by ranges: a source's number is that within its range plus the sizes of the ranges
    before, of which there are as many as partitions.
    """
    ranged = materialize(totals.repartitionByRange(F.col("source").asc_nulls_last()).withColumn("range", F.spark_partition_id()), "sources")
    sizes = sorted((r["range"], r["count"]) for r in ranged.groupBy("range").count().collect())
    before, rows = 0, [(-1, 0)]
    for number, count in sizes:
        rows.append((number, before))
        before += count
    offsets = totals.sparkSession.createDataFrame(rows, "range int, before bigint")
    within = F.row_number().over(Window.partitionBy("range").orderBy(F.col("source").asc_nulls_last())) - 1
    return ranged.withColumn("within", within).join(F.broadcast(offsets), "range").select("source", "source_size", (F.col("within") + F.col("before")).alias("number"))


def targets(totals: DataFrame, weights: Sequence[float], epochs: int) -> DataFrame:
    """The words wanted of each source: columns source, source_size, target.

    ``totals`` has source and source_size. Sources in order of code points, null last, take the
    weights in turn. Water-filling: each takes its weight's share of all words; those above ``epochs``
    times their size are held there and what they leave is dealt out again by weight, in rounds, until
    none is above. A round is one aggregation over the sources that gives two sums.
    """
    turn = F.pmod(F.col("number"), F.lit(len(weights)))
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (turn + 1).cast("int"))
    s = materialize(_numbered(totals).select("source", "source_size", w.alias("w"), (F.col("source_size") * epochs).alias("most")), "weights")
    total, free = s.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("w"), F.lit(0.0))).first()
    level, held = (total / free if free else 0.0), 0
    while True:
        over = F.col("w") * F.lit(level) > F.col("most")
        used, free, now = s.agg(F.coalesce(F.sum(F.when(over, F.col("most"))), F.lit(0)), F.coalesce(F.sum(F.when(~over, F.col("w"))), F.lit(0.0)), F.count_if(over)).first()
        if now == held or not free:
            break
        level, held = (total - used) / free, now
    return s.select("source", "source_size", F.when(over, F.col("most").cast("double")).otherwise(F.col("w") * F.lit(level)).alias("target"))


def plan(sizes: DataFrame, weights: Sequence[float] = (5, 2, 1), epochs: int = 3, seed: int = 17, digits: int = 3) -> DataFrame:
    """How much of each source the mix takes, a row a source.

    ``sizes`` has source, size and name. Columns: source, source_size, target, whole (times that
    every document is taken), cut (documents whose place is before it are taken once more), part and
    unit (the document at the cut gives part of its unit words). The cut is found in two steps, by
    sums over ranges of places and then within the one range that holds it, so nothing sorts a source.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").cast("bigint").alias("source_size"))
    goal = targets(totals, weights, epochs)
    whole = F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(epochs))).otherwise(F.lit(0)).cast("bigint")
    goal = goal.withColumn("whole", whole).withColumn("rest", F.floor(F.col("target") + 0.5).cast("bigint") - F.col("whole") * F.col("source_size"))
    goal = materialize(goal.withColumn("rest", F.greatest(F.col("rest"), F.lit(0))), "goal")

    placed = sizes.select("source", "size", place(seed, F.col("name")).alias("h"))
    ranges = placed.groupBy("source", F.substring("h", 1, digits).alias("r")).agg(F.sum("size").alias("n"))
    before = F.sum("n").over(Window.partitionBy("source").orderBy("r").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("n")
    ranges = ranges.select(F.col("source").alias("_s"), "r", "n", before.alias("before"))
    cut_range = ranges.join(goal, F.col("_s").eqNullSafe(F.col("source"))).filter("before < rest AND rest <= before + n").select("_s", "r", "before", "rest")
    cut_range = materialize(cut_range, "range")
    near = placed.join(_few(cut_range), F.col("source").eqNullSafe(F.col("_s")) & (F.substring("h", 1, digits) == F.col("r"))).groupBy("_s", "h").agg(F.sum("size").alias("unit"), F.first("before").alias("before"), F.first("rest").alias("rest"))
    upto = F.sum("unit").over(Window.partitionBy("_s").orderBy("h").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("unit") + F.col("before")
    cut = near.withColumn("upto", upto).filter("upto < rest AND rest <= upto + unit").select("_s", F.col("h").alias("cut"), (F.col("rest") - F.col("upto")).alias("part"), "unit")
    out = goal.join(cut, F.col("source").eqNullSafe(F.col("_s")), "left")
    return out.select("source", "source_size", "target", "whole", F.coalesce("cut", F.lit("")).alias("cut"), F.coalesce("part", F.lit(0)).alias("part"), F.coalesce("unit", F.lit(1)).alias("unit"))


def _few(table: DataFrame) -> DataFrame:
    """Broadcasts a table with a row a source if it is small; else the skew join spreads the heavy source."""
    return F.broadcast(table) if table.count() <= BROADCAST_ROWS else table


def taken(docs: DataFrame, mix: DataFrame, seed: int = 17) -> DataFrame:
    """``docs``, which has source, size and name, with source_size, target and taken.

    ``mix`` is a written table of ``plan``. taken counts words, with repeats: whole times the size, and
    once more for documents before the source's cut; the one at the cut gives only what is still
    missing, so that a source's words sum up to its rounded target. Rows that share the name at the
    cut give their parts in proportion.
    """
    m = _few(mix.select(F.col("source").alias("_source"), "source_size", "target", "whole", "cut", "part", "unit"))
    h = place(seed, F.col("name"))
    more = F.when(h < F.col("cut"), F.col("size")).when(h == F.col("cut"), F.floor(F.col("size") * F.col("part") / F.col("unit")).cast("bigint")).otherwise(F.lit(0))
    out = docs.join(m, F.col("source").eqNullSafe(F.col("_source")))
    return out.select(*docs.columns, "source_size", "target", (F.col("whole") * F.col("size") + more).alias("taken"))


def mixed_sizes(sizes: DataFrame, weights: Sequence[float] = (5, 2, 1), epochs: int = 3, seed: int = 17) -> DataFrame:
    """doc_id, size, source_size, target and taken for a table that ``sized`` wrote.

    Defined results: a null text has size 0 and is taken 0 times; a text of any length counts whole; a null
    source is a source of its own, the last one; rows that repeat a doc_id, or a text without one, are taken
    alike, so no order of rows matters; an empty table gives none; other columns are left alone. The plan
    and the sizes stay until the caller's ``scratch`` ends.
    """
    with scratch() as keep:
        mix = keep(materialize(plan(sizes, weights, epochs, seed), "mix"))
    return taken(sizes, mix, seed).select("doc_id", "size", "source_size", "target", "taken")


def mixed_documents(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), epochs: int = 3, seed: int = 17) -> DataFrame:
    """The mix itself: a row for each time a document is taken, with the columns of ``docs``.

    Documents stay whole: the one at its source's cut is taken once more if at least half of its words are
    wanted, so a source's words are off its target by half of that document at most. Rows that share a name
    at the cut are all taken or none.

    Defined results: those of ``mixed_sizes``; a document without words is not in the mix; columns may have
    any names.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")  # apart, as its columns may have any names
    with scratch() as keep:
        sizes = sized(docs.select("doc_id", "source", "text"))
        mix = keep(materialize(plan(sizes, weights, epochs, seed).withColumn("part", F.when(2 * F.col("part") >= F.col("unit"), F.col("unit")).otherwise(F.lit(0))), "mix"))
    # not deterministic for the optimizer, which would else count a text's words again for each use, in workers of their own
    count = word_count.asNondeterministic()
    own = docs.select(row, "source", count("text").alias("size"), name_of(F.col("doc_id"), F.col("text")).alias("name"))
    df = taken(own, mix, seed).filter("taken > 0")
    df = df.withColumn("copy", F.explode(F.sequence(F.lit(1), F.floor(F.col("taken") / F.col("size")).cast("int"))))
    return df.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])
