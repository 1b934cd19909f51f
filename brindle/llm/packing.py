"""Packing documents into training sequences: best fit under conflicts."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.llm.components import small
from brindle.llm.near_dedup import sized_components
from brindle.session import materialize, scratch

#: Documents of a shard, which one task packs; its memory is bounded by this.
SHARD_DOCS = 4096

_PACKED = "doc_id bigint, piece int, start bigint, length bigint, bin_id bigint, place bigint"


class Bins:
    """Open bins by residual capacity.

    Bin b has the capacity ``residual[b]`` left and carries bitmaps: ``sources[b]`` is a list of them, one a
    level, where a source's bit is set in the first j levels if j of its documents are in; ``clusters[b]``
    has a bit for each duplicate cluster that is in. ``levels[r]`` is the bitmap of bins with r left, and bit
    r of ``mask`` tells whether there are any. ``full`` and ``holding`` are the bins' bitmaps the other way
    round, by source and by cluster, so that the search passes over all incompatible bins of a level at once.
    """

    def __init__(self, capacity: int, per_source: int):
        self.capacity, self.per_source = capacity, per_source
        self.residual: list[int] = []
        self.sources: list[list[int]] = []
        self.clusters: list[int] = []
        self.levels: dict[int, int] = {}
        self.mask = 0
        self.full: dict[int, int] = {}
        self.holding: dict[int, int] = {}

    def open(self, residual: int) -> int:
        """A new bin."""
        self.residual.append(residual)
        self.sources.append([0] * self.per_source)
        self.clusters.append(0)
        return len(self.residual) - 1

    def fit(self, need: int, source: int, clusters: int) -> int:
        """The compatible bin with the least residual of need or more, the first opened of these; else a new one."""
        blocked = self.full.get(source, 0)
        for c in _bits(clusters):
            blocked |= self.holding.get(c, 0)
        above = self.mask >> need << need
        while above:
            found = self.levels[(above & -above).bit_length() - 1] & ~blocked
            if found:
                return (found & -found).bit_length() - 1
            above &= above - 1
        return self.open(self.capacity)

    def put(self, b: int, need: int, source: int, clusters: int) -> int:
        """Puts a piece into a bin and returns its place there."""
        r, bit = self.residual[b], 1 << b
        left = self.levels.get(r, 0) & ~bit
        if left:
            self.levels[r] = left
        else:
            self.levels.pop(r, None)
            self.mask &= ~(1 << r)
        for level, held in enumerate(self.sources[b]):
            if not held >> source & 1:
                self.sources[b][level] = held | 1 << source
                break
        if self.sources[b][-1] >> source & 1:
            self.full[source] = self.full.get(source, 0) | bit
        self.clusters[b] |= clusters
        for c in _bits(clusters):
            self.holding[c] = self.holding.get(c, 0) | bit
        self.residual[b] = r - need
        if r > need:
            self.levels[r - need] = self.levels.get(r - need, 0) | bit
            self.mask |= 1 << r - need
        return self.capacity - r


def _bits(bitmap: int) -> Iterator[int]:
    while bitmap:
        yield (bitmap & -bitmap).bit_length() - 1
        bitmap &= bitmap - 1


def pack(sizes: list[int], sources: list[int], clusters: list[int], capacity: int, per_source: int) -> list[tuple[int, int, int, int, int, int]]:
    """(document, piece, start, length, bin, place) of all pieces, largest remainder first.

    Whole capacities are cut off a long document first, each filling a bin of its own; what remains is
    placed by best fit in descending order. ``clusters`` has each document's bitmap of clusters, 0 without copies.
    """
    bins, out = Bins(capacity, per_source), []
    for d, size in enumerate(sizes):
        for piece in range(size // capacity):
            out.append((d, piece, piece * capacity, capacity, bins.open(0), 0))
    for d in sorted((d for d, size in enumerate(sizes) if size % capacity), key=lambda d: -(sizes[d] % capacity)):
        whole, need = divmod(sizes[d], capacity)
        b = bins.fit(need, sources[d], clusters[d])
        out.append((d, whole, whole * capacity, need, b, bins.put(b, need, sources[d], clusters[d])))
    return out


def _packer(capacity: int, per_source: int):
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("size", "descending"), ("doc_id", "ascending"), ("cluster", "ascending"), ("source", "ascending")])
        sizes = table.column("size").to_pylist()
        sources = table.column("source").combine_chunks().dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False) + 1
        clusters, bit = [0] * len(sizes), 0
        for name in ("cluster", "doc_id"):  # equal texts, and rows of one document, of which some may be cut
            rows: dict = {}
            for i, value in enumerate(table.column(name).to_pylist()):
                rows.setdefault(value, []).append(i)
            for value, same in rows.items():
                if len(same) > 1 and value is not None:
                    for i in same:
                        clusters[i] |= 1 << bit
                    bit += 1
        found = pack(sizes, sources.tolist(), clusters, capacity, per_source)
        d, piece, start, length, bins, place = np.array(found, np.int64).reshape(-1, 6).T
        shard = table.column("shard")[0].as_py() << 32
        return pa.table({"doc_id": table.column("doc_id").combine_chunks().take(pa.array(d)), "piece": pa.array(piece.astype(np.int32)), "start": pa.array(start), "length": pa.array(length), "bin_id": pa.array(bins + shard), "place": pa.array(place)})

    return run


def clustered(docs: DataFrame) -> DataFrame:
    """A written table of doc_id, source, size in words and cluster, as ``best_fit`` takes it.

    cluster is the component of near duplicates (see ``near_dedup.grouped``), so that exact and near
    copies share it; rows without a doc_id, too, by a hash of their text in its place. A text without
    words has none.
    """
    with scratch() as keep:
        rows, names = sized_components(docs)
        cluster = F.when(F.col("n_words") > 0, F.coalesce("component_id", "own.id", F.xxhash64("raw"))).alias("cluster")
        found = rows.join(small(names), F.col("raw") == F.col("_raw"), "left")
        return keep(materialize(found.select(F.col("own.id").alias("doc_id"), F.col("own.source").alias("source"), F.col("n_words").alias("size"), cluster), "clustered"))


def best_fit(sizes: DataFrame, capacity: int = 2048, per_source: int = 4, shard_docs: int = SHARD_DOCS, seed: int = 7) -> DataFrame:
    """Packs all documents into bins of ``capacity`` words.

    ``sizes`` is a written table of doc_id, source, size and cluster: ``clustered`` has those of near
    duplicates, ``sizes.measured`` of exact copies only, which is enough after near-duplicate removal. A bin takes at most
    ``per_source`` documents of a source, one of a duplicate cluster and one row of a doc_id. Returns a row for each piece:
    doc_id, piece, start and length in words, bin_id and place (first word in the bin). A document of
    ``capacity`` or more is cut into whole bins and a remainder.

    Documents are dealt to shards by a hash of id, size and cluster, so that a source or a cluster with a
    third of all rows is spread evenly and a shard has about ``shard_docs``; each is packed on its own in one
    task. Equal rows, of which there may be as many, are counted first and dealt to shards in parts. Copies
    that meet in a shard are in different bins of it.

    Defined results: a document without words has one piece of length 0 without a bin, and takes no part in
    the packing; a null source is a source of its own, and a null doc_id a document of its own each time;
    repeated rows are documents of their own and, as copies, in different bins; documents of one size are
    placed in order of doc_id, and of several tightest bins the first opened is taken; a document of any
    length is cut into whole bins; an empty table gives no rows; columns beyond those named are left out.
    """
    keys = ("doc_id", "source", "size", "cluster")
    some = sizes.select(*keys, F.monotonically_increasing_id().alias("row")).filter("size > 0")
    shards = max(1, -(-some.count() // shard_docs))
    most = max(1, shard_docs // 16)
    heavy = some.groupBy(*keys).agg(F.count("*").alias("n")).filter(F.col("n") > most)
    heavy = materialize(heavy.select(*[F.col(c).alias(f"_{c}") for c in keys], F.ceil(F.col("n") / most).alias("parts")), "heavy")
    salt = F.lit(0).cast("bigint")
    if not heavy.isEmpty():
        some = some.join(small(heavy), reduce(lambda p, q: p & q, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in keys]), "left")
        salt = F.pmod(F.col("row"), F.coalesce("parts", F.lit(1)))
    shard = F.pmod(F.xxhash64(F.lit(seed), "doc_id", "size", "cluster", salt), F.lit(shards))
    packed = some.select(*keys, shard.alias("shard")).groupBy("shard").applyInArrow(_packer(capacity, per_source), _PACKED)
    zero = F.lit(0).cast("bigint")
    empty = sizes.filter("size <= 0 OR size IS NULL").select("doc_id", F.lit(0).alias("piece"), zero.alias("start"), zero.alias("length"), F.lit(None).cast("bigint").alias("bin_id"), zero.alias("place"))
    return packed.unionAll(empty)
