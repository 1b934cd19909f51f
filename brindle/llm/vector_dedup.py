"""Near-duplicate vectors by counting collisions in many one-dimensional projections."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructType

from brindle.llm.components import components, small
from brindle.session import materialize, release, scratch

#: Vectors of a block; a task holds two blocks. A label's vectors are copied once for each of its blocks.
BLOCK_ROWS = 4096
#: Rows and columns of a matrix of counts between parts of two blocks.
PART_ROWS = 1024
#: Chance that a pair at the least similarity is not counted often enough.
MISS = 1e-7
#: Chance that such a pair shares no bucket in any table.
TABLES_MISS = 1e-6
#: Most signs of a bucket's key.
MOST_SIGNS = 40
#: Projections that one matrix product gives.
SIGNS_AT_ONCE = 1 << 21


def calibrate(cosine: float, projections: int, miss: float = MISS) -> tuple[float, int]:
    """The half-width of windows and the count of collisions that a pair has to reach.

    For unit vectors at an angle of the given cosine, the difference of their projections on a Gaussian
    direction is normal with variance 2 - 2 cos, whatever the vectors. With windows of one and a
    quarter of its deviation they collide with chance p, and in ``projections`` directions with a
    binomial count; the least count is the largest number that a pair reaches but with chance ``miss``.
    """
    width = 1.25 * math.sqrt(2 - 2 * cosine)
    p = math.erf(1.25 / math.sqrt(2))
    below, count = 0.0, 0
    while True:
        below += math.comb(projections, count) * p**count * (1 - p) ** (projections - count)
        if below > miss:
            return width, count
        count += 1


def tables_of(cosine: float, signs: int, miss: float = TABLES_MISS) -> int:
    """How many tables with keys of ``signs`` signs retrieve a pair of the given cosine but with chance ``miss``.

    The projections of two vectors on a Gaussian direction have one sign with chance 1 - angle / pi,
    whatever the vectors.
    """
    p = (1 - math.acos(cosine) / math.pi) ** signs
    return 1 if p >= 1 else math.ceil(math.log(miss) / math.log1p(-p))


def directions(dim: int, projections: int, seed: int) -> np.ndarray:
    """Fixed Gaussian directions."""
    return np.random.default_rng([seed, dim]).standard_normal((dim, projections))


def collisions(queries: np.ndarray, points: np.ndarray, width: float) -> np.ndarray:
    """How often each point lies in the window around each query, by projection.

    The points of each projection are sorted once; a query's window is then a range of ranks, found by
    two binary searches, and a point collides if its rank is within it.
    """
    out = np.zeros((len(queries), len(points)), np.uint8)
    rank, hit = np.empty(len(points), np.uint16), np.empty(out.shape, np.uint16)
    for j in range(queries.shape[1]):
        order = np.argsort(points[:, j], kind="stable")
        rank[order] = np.arange(len(points), dtype=np.uint16)
        line = points[order, j]
        low = np.searchsorted(line, queries[:, j] - width, "left").astype(np.uint16)
        high = np.searchsorted(line, queries[:, j] + width, "right").astype(np.uint16)
        np.subtract(rank[None, :], low[:, None], out=hit)  # wraps round below the window
        out += hit < (high - low)[:, None]
    return out


def _keyed(cosine: float, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            signs, value = batch.column("signs").to_numpy(zero_copy_only=False), batch.column("vector")
            dims = np.diff(value.offsets.to_numpy())
            start = np.concatenate([[0], np.cumsum(dims)])
            flat = value.flatten().to_numpy(zero_copy_only=False)
            keys: list = [[0]] * len(signs)
            for k, dim in {(int(k), int(d)) for k, d in zip(signs, dims, strict=True) if k}:
                same = np.flatnonzero((signs == k) & (dims == dim))
                tables = tables_of(cosine, k)
                lines = directions(dim, tables * k, seed + 1)
                step = max(1, SIGNS_AT_ONCE // (tables * k))
                for at in range(0, len(same), step):
                    rows = same[at : at + step]
                    x = flat[start[rows][:, None] + np.arange(dim)]
                    positive = x / np.abs(x).max(axis=1)[:, None] @ lines >= 0
                    found = positive.reshape(len(rows), tables, k) @ (1 << np.arange(k, dtype=np.int64))
                    for row, key in zip(rows.tolist(), found, strict=True):
                        keys[row] = key
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(keys, pa.list_(pa.int64()))], [*batch.schema.names[:-1], "keys"])

    return run


def _tables(held: DataFrame, sizes: DataFrame, cosine: float, block_rows: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """``held`` with keys, a vector's bucket in each table, and the buckets of two rows or more with their numbers of rows.

    A label that fits a block has one bucket; so has one whose tables would compare more than half of its
    pairs. Buckets of equal size hold the fewest pairs, so with few signs that is known before any are counted.
    """
    worth = next((k for k in range(1, MOST_SIGNS + 1) if 2 * tables_of(cosine, k) < 2**k), MOST_SIGNS + 1)
    signs = F.least(F.ceil(F.log2(F.col("rows") / block_rows)), F.lit(MOST_SIGNS)).cast("int")
    sizes = sizes.withColumn("signs", F.when(signs >= worth, signs).otherwise(0))
    whole = sizes.select("_label", F.lit(0).alias("_table"), F.lit(0).cast("bigint").alias("_bucket"), "rows")
    if sizes.filter("signs > 0").isEmpty():
        return held.withColumn("keys", F.array(F.lit(0).cast("bigint"))), whole.filter("rows > 1")
    rows = held.join(small(sizes), F.col("label") == F.col("_label")).select("node", "times", "label", "vector", "signs")
    schema = StructType(rows.drop("signs").schema.fields).add("keys", ArrayType(LongType()))
    keyed = materialize(rows.mapInArrow(_keyed(cosine, seed), schema), "keyed")
    buckets = keyed.select(F.col("label").alias("_label"), F.posexplode("keys").alias("_table", "_bucket"))
    buckets = materialize(buckets.groupBy("_label", "_table", "_bucket").agg(F.count("*").alias("rows")), "buckets")
    work = buckets.groupBy("_label").agg(F.sum(F.col("rows").cast("double") ** 2).alias("work"))
    many = work.join(sizes, "_label").filter((F.col("signs") > 0) & (2 * F.col("work") < F.col("rows").cast("double") ** 2)).select("_label")
    many = small(materialize(many, "many"))
    buckets = buckets.join(many, "_label", "left_semi").unionByName(whole.join(many, "_label", "left_anti"))
    tables = many.select(F.col("_label").alias("_many"))
    keyed = keyed.join(tables, F.col("label") == F.col("_many"), "left")
    keys = F.when(F.col("_many").isNotNull(), F.col("keys")).otherwise(F.array(F.lit(0).cast("bigint")))
    return keyed.select("node", "times", "label", "vector", keys.alias("keys")), buckets.filter("rows > 1")


def _linked(cosine: float, projections: int, least: int, width: float, seed: int):
    def run(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches))
        node, times = (table.column(c).to_numpy() for c in ("node", "times"))
        part = table.column("part").to_numpy()
        keys = table.column("keys").combine_chunks().flatten().to_numpy().reshape(len(node), -1)
        earlier, one, other = key[1].as_py(), key[3].as_py(), key[4].as_py()
        value = table.column("vector").combine_chunks()
        flat = value.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        dims = np.diff(value.offsets.to_numpy())
        start = np.concatenate([[0], np.cumsum(dims)])
        found, root = np.zeros(len(node), np.int64), np.arange(len(node))

        def top(i: int) -> int:
            while root[i] != i:
                root[i] = root[root[i]]
                i = root[i]
            return i

        for dim in np.unique(dims):  # only vectors of one length can be compared
            rows = np.flatnonzero(dims == dim)
            x = flat[start[rows][:, None] + np.arange(dim)]
            x /= np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]
            p = x @ directions(int(dim), projections, seed)
            same = one == other
            a = np.arange(len(rows)) if same else np.flatnonzero(part[rows] == one)
            b = a if same else np.flatnonzero(part[rows] == other)
            if not len(a) or not len(b):
                continue
            for lo in range(0, len(a), PART_ROWS):
                for at in range(lo if same else 0, len(b), PART_ROWS):
                    qa, qb = a[lo : lo + PART_ROWS], b[at : at + PART_ROWS]
                    i, j = np.nonzero(collisions(p[qa], p[qb], width) >= least)
                    i, j = qa[i], qb[j]
                    if same:
                        i, j = i[i < j], j[i < j]
                    for s in range(0, len(i), 1 << 16):
                        u, v = i[s : s + (1 << 16)], j[s : s + (1 << 16)]
                        near = np.einsum("ij,ij->i", x[u], x[v]) >= cosine
                        for t in range(earlier):  # a pair counts in the first table that it shares a bucket of
                            near &= keys[rows[u], t] != keys[rows[v], t]
                        u, v = rows[u[near]], rows[v[near]]
                        found += np.bincount(u, weights=times[v], minlength=len(node)).astype(np.int64)
                        found += np.bincount(v, weights=times[u], minlength=len(node)).astype(np.int64)
                        for m, n in zip(u.tolist(), v.tolist(), strict=True):
                            m, n = top(m), top(n)
                            if m != n:
                                root[max(m, n)] = min(m, n)
        hit = np.flatnonzero(found)
        tops = np.array([top(i) for i in hit.tolist()], np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(node[hit]), pa.array(node[tops]), pa.array(found[hit])], ["node", "root", "links"])

    return run


def near_vectors(vectors: DataFrame, cosine: float = 0.93, projections: int = 64, block_rows: int = BLOCK_ROWS, seed: int = 11) -> DataFrame:
    """Links vectors of one label with a cosine of ``cosine`` or more.

    ``vectors`` has vec_id, embedding and label. Returns vec_id, n_links, component_id and kept, a row
    for each row. Candidates are pairs that collide often enough in windows of one-dimensional
    projections (see ``calibrate``); their cosine is then computed in double precision.

    Equal vectors of a label are one class with a number of copies, so copies are never paired. A label
    of n classes that doesn't fit a block has tables of buckets: a bucket is where log2(n / block_rows)
    projections have given signs, and there are as many tables as let a pair at the limit share no bucket with a chance of
    ``TABLES_MISS`` only. A pair counts in the first table that it shares a bucket of, which both rows' keys
    tell, so no pairs are sent to find those met twice. The classes of a bucket are dealt by hash to
    blocks of about ``block_rows``, and a task gets two blocks; a large bucket so makes more tasks, not
    larger ones. A task returns counts of links and a spanning forest, not pairs: a row a vector at most.
    At a cosine of 0.93 the pairs compared grow as a power of 1.18 of a label's vectors if these are spread.
    Where the buckets, which are counted first, hold more than half as many pairs as the label, as in
    one group of near copies whose links all have to be counted, the label is one bucket, and its work
    grows with the square of its size.

    All intermediate tables are released but the two that the result is read from, which stay until the
    caller's ``scratch`` ends.

    Defined results: an empty table gives no rows; columns beyond those named are left out; a cosine equal to
    the limit is a link; a vector that is null, empty, zero or has a component that is null, NaN or
    infinite, and one without a label, is linked with nothing; vectors of different lengths are not
    linked; a repeated vec_id has a row each time, by its own vector; a null vec_id takes part but can't
    name a component, and is kept only if its component has no other name.
    """
    with scratch() as keep:
        width, least = calibrate(cosine, projections)
        v = F.col("embedding")
        fine = F.col("label").isNotNull() & v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
        rows = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), v.cast("array<double>").alias("vector"), F.col("label").alias("label")).withColumn("embedding", F.col("vector"))
        rows = rows.select("vec_id", "label", "vector", F.coalesce(fine, F.lit(False)).alias("fine"))
        # 0.0 and -0.0 are one value
        plain = F.transform("vector", lambda x: F.when(x == 0, F.lit(0.0)).otherwise(x))
        rows = rows.select("vec_id", "fine", "label", F.when(F.col("fine"), plain).alias("vector"))
        rows = materialize(rows.withColumn("class", F.when(F.col("fine"), F.sha2(F.concat_ws(",", F.col("label").cast("string"), F.col("vector").cast("array<string>")), 256))).withColumn("uid", F.monotonically_increasing_id()), "vectors")
        own = keep(materialize(rows.select("vec_id", "class"), "ids"))
        classes = materialize(rows.filter("fine").groupBy("class").agg(F.min("uid").alias("node"), F.min("vec_id").alias("first_id"), F.count("*").alias("times")), "classes")
        held = rows.join(classes.select("node", "times"), F.col("uid") == F.col("node")).select("node", "times", "label", "vector")
        held = materialize(held, "held")
        release(rows)
        sizes = materialize(held.groupBy(F.col("label").alias("_label")).agg(F.count("*").alias("rows")), "sizes")
        keyed, buckets = _tables(held, sizes, cosine, block_rows, seed)
        buckets = small(materialize(buckets.withColumn("parts", F.ceil(F.col("rows") / block_rows).cast("int")).drop("rows"), "parts"))
        placed = keyed.select("*", F.posexplode("keys").alias("table", "bucket"))
        part = F.pmod(F.xxhash64(F.lit(seed), "node"), F.col("parts")).cast("int")
        inside = (F.col("label") == F.col("_label")) & (F.col("table") == F.col("_table")) & (F.col("bucket") == F.col("_bucket"))
        dealt = placed.join(buckets, inside).withColumn("part", part).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        dealt = dealt.select("label", "table", "bucket", F.least("part", "other").alias("p"), F.greatest("part", "other").alias("q"), "part", "node", "times", "vector", "keys")
        found = dealt.groupBy("label", "table", "bucket", "p", "q").applyInArrow(_linked(cosine, projections, least, width, seed), "node bigint, root bigint, links bigint")
        found = materialize(found, "links")
        roots = materialize(components(found.select(F.col("node").alias("u"), F.col("root").alias("v"))), "roots")
        links = found.groupBy("node").agg(F.sum("links").alias("links"))
        ids = roots.join(classes.select("node", "first_id"), "node").groupBy("root").agg(F.min("first_id").alias("component_id"))
        named = materialize(roots.join(small(materialize(ids, "ids")), "root").select("node", "component_id"), "named")
        known = classes.join(links, "node", "left").join(small(named), "node", "left")
        known = keep(materialize(known.select(F.col("class").alias("c"), (F.coalesce("links", F.lit(0)) + F.col("times") - 1).alias("n_links"), F.coalesce("component_id", "first_id").alias("component_id")), "names"))
    out = own.join(known, F.col("class") == F.col("c"), "left")
    component = F.when(F.col("class").isNotNull(), F.col("component_id")).otherwise(F.col("vec_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), component.alias("component_id")).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.col("component_id").isNull()))
