"""Near-duplicate documents by fast similarity sketches, banding and exact verification."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.llm import sketch as sk
from brindle.llm import text as tx
from brindle.llm.components import components, small
from brindle.session import bound_batches, materialize, release, scratch

#: Shingles that one call of the sketch handles.
SHINGLES_AT_ONCE = 1 << 15

_SKETCH = "doc_id bigint, raw binary, own struct<id:bigint,source:string>, n_words bigint, n_shingles bigint, bands array<bigint>, bits array<bigint>"


def _sketched(k: int, t: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = tx.utf8(batch.column("text"))
            for a, b in tx.groups(offsets, 8 * SHINGLES_AT_ONCE):
                part = offsets[a : b + 1] - offsets[a]
                words = tx.words(data[offsets[a] : offsets[b]], part)
                sh, at = tx.distinct(*tx.shingles(*words, k))
                n = np.diff(at)
                keys, bits = [], []
                for i, j in tx.groups(at, SHINGLES_AT_ONCE):
                    s = sk.sketches(sh[at[i] : at[j]], at[i : j + 1] - at[i], t)
                    keys.append(sk.bands(s, rows))
                    bits.append(sk.low_bits(s))
                keys, bits = np.concatenate(keys), np.concatenate(bits)

                def lists(x: np.ndarray) -> pa.Array:
                    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel()))

                yield pa.RecordBatch.from_arrays([batch.column("doc_id")[a:b], batch.column("raw")[a:b], batch.column("own")[a:b], pa.array(np.diff(words[1])), pa.array(n), lists(keys), lists(bits)], ["doc_id", "raw", "own", "n_words", "n_shingles", "bands", "bits"])

    return run


def _sets(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = tx.utf8(batch.column("text"))
            for a, b in tx.groups(offsets, 8 * SHINGLES_AT_ONCE):
                part = offsets[a : b + 1] - offsets[a]
                sh, at = tx.distinct(*tx.shingles(*tx.words(data[offsets[a] : offsets[b]], part), k))
                yield pa.RecordBatch.from_arrays([batch.column("node")[a:b], batch.column("again")[a:b], pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(sh.view(np.int64)))], ["node", "again", "items"])

    return run


def _common(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """A written table of the pairs (a, b) of a written table, with the sizes x and y of their sets and what these have in common."""

    def side(some: DataFrame, name: str, size: str, items: str) -> DataFrame:
        return some.select(F.col("node").alias(name), F.size("items").cast("bigint").alias(size), F.col("items").alias(items))

    wanted = materialize(pairs.select(F.col("b").alias("_node")).distinct(), "side")
    one = side(sets, "a", "x", "xs").join(small(pairs.select("a", "b")), "a")
    two = side(sets.join(small(wanted), F.col("node") == F.col("_node"), "left_semi"), "b", "y", "ys")
    both = one.join(two, "b")
    return materialize(both.select("a", "b", "x", "y", F.size(F.array_intersect("xs", "ys")).cast("bigint").alias("common")), "common")


def _links(common: DataFrame, share: int, of: int) -> DataFrame:
    """Pairs that have share / of of their union in common or more, as u and v."""
    return common.filter(of * F.col("common") >= share * (F.col("x") + F.col("y") - F.col("common"))).select(F.col("a").alias("u"), F.col("b").alias("v"))


def _possible(a: str, b: str, share: int, of: int, most_bits: int) -> Column:
    """What two sets have to fulfil: sizes near enough, and no more differing bits than chance allows."""
    sizes = (of * F.least(f"{a}n", f"{b}n") >= share * F.greatest(f"{a}n", f"{b}n"))
    apart = sum((F.bit_count(F.col(f"{a}bits")[i].bitwiseXOR(F.col(f"{b}bits")[i])) for i in (0, 1)), F.lit(0))
    return sizes & (apart <= most_bits)


def _divided(placed: DataFrame) -> DataFrame:
    """A written table of the keys of buckets whose members have more than one root."""
    return materialize(placed.groupBy("key").agg(F.min("root").alias("x"), F.max("root").alias("y")).filter("x < y").select("key"), "keys")


def _merged(roots: DataFrame, links: DataFrame) -> DataFrame:
    """Components with more links."""
    if links.isEmpty():
        return roots
    return materialize(components(roots.filter("node <> root").select(F.col("node").alias("u"), F.col("root").alias("v")).unionByName(links)), "roots")


def near_duplicates(docs: DataFrame, k: int = 5, share: int = 75, of: int = 100, t: int = 128, rows: int = 4) -> DataFrame:
    """doc_id, n_shingles, component_id and kept, a row for each row of ``docs``; see ``grouped``."""
    return grouped(docs, k, share, of, t, rows).select("doc_id", "n_shingles", "component_id", "kept")


def keep_one(docs: DataFrame, **options: int) -> DataFrame:
    """``docs`` without near duplicates: of each component the row with the least doc_id stays.

    If several rows have that id, one of those with the least text hash stays. Documents without words
    all stay, and so do the rows of a component that has no doc_id at all, which nothing tells apart.
    """
    found = materialize(grouped(docs, **options), "groups")
    first = found.filter("kept AND n_shingles > 0 AND component_id IS NOT NULL")
    several = first.groupBy("component_id").agg(F.count("*").alias("times"), F.min("raw").alias("_brindle_raw")).filter("times > 1")
    several = materialize(several.select(F.col("component_id").alias("_brindle_id"), "_brindle_raw"), "several")
    extra = first.join(several, (F.col("component_id") == F.col("_brindle_id")) & (F.col("raw") != F.col("_brindle_raw")))
    gone = found.filter("NOT kept").select("doc_id", "raw").unionByName(extra.select("doc_id", "raw")).distinct()
    gone = materialize(gone.select(F.col("doc_id").alias("_brindle_id"), F.col("raw").alias("_brindle_raw")), "gone")
    raw = F.unhex(F.md5("text"))
    out = docs.join(small(gone), F.col("doc_id").eqNullSafe(F.col("_brindle_id")) & (raw == F.col("_brindle_raw")), "left_anti")
    if not several.isEmpty():
        hit = (F.col("doc_id") == F.col("_brindle_id")) & (raw == F.col("_brindle_raw"))
        once = out.join(small(several), hit, "left_semi").dropDuplicates(["doc_id"])
        out = out.join(small(several), hit, "left_anti").unionByName(once)
    return out


def grouped(docs: DataFrame, k: int = 5, share: int = 75, of: int = 100, t: int = 128, rows: int = 4) -> DataFrame:
    """Groups documents that are linked, directly or through others.

    ``docs`` has doc_id and text; other columns are left alone. Returns doc_id, raw (the md5 of the
    text), n_shingles, component_id and kept, a row for each row.

    A document's set holds its different runs of k lower-cased words (the whole sequence if it has
    fewer). Two are linked if the intersection is at least share / of of the union, on full sets of
    64-bit hashes. Sets of t = 128 coordinates in 32 bands of 4 rows: at a similarity of 0.75 a pair
    shares no band with a chance of (1 - 0.75^4)^32 = 5e-6. Differing low bits of coordinates number
    t (1 - J) / 2 = 16 with a deviation of 3.7 there, so the limit of 40 loses none in 1e9.

    Exact copies are one class before any pair is made. In each band's bucket every class is first
    compared with the bucket's least class only, so a bucket of n makes n pairs, however large. Buckets
    that this leaves in several components get a second centre, the member with the fewest shingles of
    its own. What is still apart then is compared pair by pair, so that no link is lost, but only members
    outside of a bucket's largest component with others: work grows with their number times the bucket's.
    Most of these pairs are ruled out by an exact bound: of a set, m shingles occur in any other set of the
    divided buckets, k of them in the centre's; so two sets have at most min(k, k') + min(m - k, m' - k')
    in common. A heavily changed copy in a large group of copies has too many shingles of its own to be
    linked with any of them, and is left out before. A pair is made in one bucket only.

    All intermediate tables are released; the two that the result is read from stay until the caller's
    ``scratch`` ends.

    Defined results: a null or empty text, or one without words, has n_shingles 0, is linked with
    nothing and has its own doc_id as component_id; a text of any length is read whole; a repeated doc_id
    has a row each time, by its own text; a null doc_id takes part, but can't name a component:
    component_id is the smallest that is not null, and null where there is none, and kept is then true.
    Otherwise kept is doc_id = component_id. A similarity of exactly share / of is a link. An empty table
    gives no rows, and columns other than doc_id and text may have any names.
    """
    ids, names = _grouped(docs, k, share, of, t, rows)
    out = ids.join(small(names), (F.col("raw") == F.col("_raw")) & (F.col("n_shingles") > 0), "left")
    component = F.coalesce("component_id", "doc_id")
    return out.select("doc_id", "raw", "n_shingles", component.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull()))


def sized_components(docs: DataFrame, k: int = 5, share: int = 75, of: int = 100, t: int = 128, rows: int = 4) -> tuple[DataFrame, DataFrame]:
    """Two written tables of one pass over the texts, for documents that are told apart without an id, too.

    The first has raw, the md5 of the text, own, a struct of the document's id and source, and n_words of all
    rows; the second _raw and component_id, a row for each different text that occurs again or is linked; see
    ``grouped``. Rows without a doc_id are named by a hash of their text.
    """
    id_, source = F.col("doc_id").cast("bigint"), F.col("source").cast("string")
    named = docs.select(F.coalesce(id_, F.xxhash64("text")).alias("doc_id"), "text", F.struct(id_.alias("id"), source.alias("source")).alias("own"))
    return _grouped(named, k, share, of, t, rows, True)


def _grouped(docs: DataFrame, k: int, share: int, of: int, t: int, rows: int, carried: bool = False) -> tuple[DataFrame, DataFrame]:
    """Two written tables: doc_id, raw, own, n_words and n_shingles of all rows, and the components by text."""
    if t != 128:
        raise ValueError("low bits are compared as two 64-bit numbers, so t has to be 128")
    bound_batches(docs.sparkSession)
    none = F.lit(None).cast("struct<id:bigint,source:string>")
    with scratch() as keep:
        base = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.unhex(F.md5("text")).alias("raw"), "text", F.col("own") if carried else none.alias("own"))
        sketched = materialize(base.mapInArrow(_sketched(k, t, rows), _SKETCH).withColumn("uid", F.monotonically_increasing_id()), "sketches")
        ids = keep(materialize(sketched.select("doc_id", "raw", "own", "n_words", "n_shingles"), "ids"))
        some = sketched.filter("n_shingles > 0")
        once = some.groupBy("raw", "doc_id").agg(F.min("uid").alias("uid"), F.count("*").alias("times"))
        classes = materialize(once.groupBy("raw").agg(F.min("uid").alias("node"), F.min("doc_id").alias("first_id"), (F.max("times") > 1).alias("again"), F.sum("times").alias("copies")), "classes")
        held = some.join(classes.select("node", "again"), F.col("uid") == F.col("node"), "left_semi").select(F.col("uid").alias("node"), F.col("n_shingles").alias("n"), "bits", "bands", "doc_id", "raw")
        held = materialize(held, "held")
        release(sketched)
        return ids, keep(_names(base, held, classes, k, share, of))


def _names(base: DataFrame, held: DataFrame, classes: DataFrame, k: int, share: int, of: int, most_bits: int = 40) -> DataFrame:
    """A written table of _raw and component_id, a row for each class of several rows or with links. Releases ``held``."""
    # buckets that more than one class shares
    keys = held.select(F.explode("bands").alias("key"), "node")
    least = materialize(keys.groupBy("key").agg(F.min("node").alias("least"), F.max("node").alias("most")).filter("least < most").select("key", "least"), "shared")
    shared = materialize(keys.join(small(least), "key"), "buckets")

    # full sets of what is in them
    wanted = materialize(shared.select("node").distinct(), "members")
    wanted = held.join(small(wanted), "node", "left_semi").join(classes.select("node", "again"), "node")
    wanted = materialize(wanted.select("node", F.col("doc_id").alias("_id"), F.col("raw").alias("_raw"), "again", "n", "bits"), "wanted")
    release(held, least)
    found = base.join(small(wanted.drop("n", "bits")), (F.col("raw") == F.col("_raw")) & F.col("doc_id").eqNullSafe(F.col("_id"))).select("node", "again", "text")
    items = materialize(found.mapInArrow(_sets(k), "node bigint, again boolean, items array<bigint>"), "items")
    sets = items.filter("NOT again").unionByName(items.filter("again").dropDuplicates(["node"]))

    def known(df: DataFrame, side: str) -> DataFrame:
        return df.join(small(wanted.select(F.col("node").alias(side), F.col("n").alias(f"{side}n"), F.col("bits").alias(f"{side}bits"))), side)

    # everyone against the least of the bucket
    stars = shared.filter("node <> least").select(F.col("node").alias("b"), F.col("least").alias("a")).distinct()
    stars = materialize(known(known(stars, "a"), "b").filter(_possible("a", "b", share, of, most_bits)).select("a", "b"), "stars")
    roots = materialize(components(_links(_common(stars, sets), share, of)), "roots")

    # the rest of the pairs in buckets that are not yet one component
    placed = shared.select("key", "node").join(small(roots), "node", "left").select("key", "node", F.coalesce("root", "node").alias("root"))
    divided = materialize(placed.join(small(_divided(placed)), "key", "left_semi").select("key", "node"), "divided")
    open_nodes = materialize(divided.select("node").distinct(), "open")
    own = sets.join(small(open_nodes), "node", "left_semi")
    alone = own.select("node", F.explode("items").alias("item")).groupBy("item").agg(F.min("node").alias("node"), F.max("node").alias("other")).filter("node = other").groupBy("node").agg(F.count("*").alias("alone"))
    able = known(open_nodes.select(F.col("node").alias("s")), "s").join(alone, F.col("s") == F.col("node"), "left").select("s", "sn", "sbits", (F.col("sn") - F.coalesce("alone", F.lit(0))).alias("sm"))
    able = materialize(able.filter(of * F.col("sm") >= share * F.col("sn")), "able")
    rest = materialize(divided.join(small(able), F.col("node") == F.col("s")).drop("node"), "rest")
    # the member with the fewest shingles of its own is nearest to the text the others were made from
    centre = materialize(rest.groupBy("key").agg(F.max_by("s", F.struct(F.col("sm") / F.col("sn"), "s")).alias("centre")), "centres")
    rest = rest.join(small(centre), "key")
    near = _common(materialize(rest.select(F.col("s").alias("a"), F.col("centre").alias("b")).distinct(), "near"), sets)
    roots = _merged(roots, _links(near, share, of))
    rest = rest.join(small(near.select(F.col("a").alias("s"), F.col("b").alias("centre"), F.col("common").alias("sk"))), ["s", "centre"])
    rest = rest.join(small(roots), F.col("s") == F.col("node"), "left").withColumn("sroot", F.coalesce("root", "s")).drop("node", "root")
    rest = materialize(rest.join(small(_divided(rest.withColumnRenamed("sroot", "root"))), "key", "left_semi"), "open")
    main = rest.groupBy("key", "sroot").agg(F.count("*").alias("n")).groupBy("key").agg(F.max_by("sroot", F.struct("n", "sroot")).alias("main"))
    rest = rest.join(small(materialize(main, "main")), "key")
    rest = rest.join(rest.groupBy(F.col("s").alias("t")).agg(F.sort_array(F.collect_set("key")).alias("skeys")), F.col("s") == F.col("t"))
    rest = materialize(rest.select("key", "s", "sroot", "sn", "sm", "sk", "sbits", "skeys", "main"), "open")
    one, two = (rest.select("key", "main", *[F.col(f"s{c}").alias(f"{x}{c}") for c in ("", "root", "n", "m", "k", "bits", "keys")]) for x in "ab")
    one = one.filter(F.col("aroot") != F.col("main")).drop("main")
    most = F.least("ak", "bk") + F.least(F.col("am") - F.col("ak"), F.col("bm") - F.col("bk"))
    bound = of * most >= share * (F.col("an") + F.col("bn") - most)
    first = F.array_min(F.array_intersect("akeys", "bkeys")) == one["key"]
    turn = (F.col("broot") == F.col("main")) | (F.col("a") < F.col("b"))
    pairs = one.join(two, (one["key"] == two["key"]) & turn & (F.col("aroot") != F.col("broot")) & bound & _possible("a", "b", share, of, most_bits) & first)
    pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    pairs = materialize(pairs.join(small(stars), ["a", "b"], "left_anti"), "pairs")
    roots = _merged(roots, _links(_common(pairs, sets), share, of))

    ids = roots.join(classes.select("node", "first_id"), "node").groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = materialize(roots.join(small(materialize(ids, "ids")), "root").select("node", "component_id"), "named")
    names = classes.join(small(named.withColumn("linked", F.lit(True))), "node", "left").filter("linked OR copies > 1")
    names = names.select(F.col("raw").alias("_raw"), F.coalesce("component_id", "first_id").alias("component_id"))
    return materialize(names, "names")
