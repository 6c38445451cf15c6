"""Hard negatives by best-first search in R-trees packed by sort-tile-recursive.

Vectors are integers. Rows of a label are cut into tiles along the coordinates with the
widest spread (the cuts come from a sample of about ``SAMPLE`` rows; every row is indexed), sorted
by label and tile over all tasks, and packed into pages of at most ``PAGE`` rows. A page is an
R-tree: leaves of ``LEAF`` vectors, sorted and tiled again within the page, under nodes of
``FANOUT`` leaves, each with the least and greatest value of every coordinate. For a query the
products with both ends of a coordinate give an interval, and their sums bound every inner product
below a box.

A queue holds the boxes of a page for a block of queries, the one with the highest bound first.
A box is dropped for a query if its interval lies outside the query's score window or its upper
bound is strictly below the query's kth best so far; ties are followed, as the smaller id
comes first. Leaves are scored exactly by matrix products.

Queries and pages meet in cells of a grid, about ``SLAB_PAGES`` pages with ``CHUNK`` queries, both
by a hash: all queries against all rows, in blocks. One slab in ``SEEDED`` goes first, and the kth
best found there bounds what the other cells return, so a query's candidates do not grow
with the rows. A task holds one cell.

Defined results: rows without an id, label or vector, or with a missing or non-finite component,
take no part. A shorter vector counts as ending in zeros. Scores that do not fit a long are an
error. Rows that share an id are rows of their own, but none is another's positive or
negative; equal anchors are one. Other columns are not read.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from haulmark.llm.common import arrow_schema, keep, record

PAGE, LEAF, FANOUT = 8192, 64, 8
SLAB_PAGES, CHUNK, BLOCK = 4, 32768, 1024
SAMPLE, SEEDED = 8192, 64
#: Coordinates that tiles are cut along.
AXES = 3
BEST = 5
#: Parts of 1 that components are counted in.
UNIT = 256.0

_LOW, _HIGH = -(1 << 62), 1 << 62
_EXACT, _LONG = 2.0**53, 2.0**63


def whole_units(component: Column) -> Column:
    """A component as the number of 1/``UNIT`` at or below it."""
    return F.floor(F.lit(UNIT) * component.cast("double"))


def rows_of(df: DataFrame, id_col: str, label: Column, vector: Column) -> DataFrame:
    """``vec_id``, ``label`` and integer ``vector`` of the rows that take part."""
    finite = F.forall(vector, lambda x: F.coalesce(F.abs(x.cast("double")) < float("inf"), F.lit(False)))
    known = F.col(id_col).isNotNull() & label.isNotNull() & F.coalesce(finite, F.lit(False))
    return df.filter(known).select(
        F.col(id_col).cast("long").alias("vec_id"),
        label.cast("long").alias("label"),
        F.transform(vector, whole_units).alias("vector"),
    )


# --- packing -----------------------------------------------------------------------------


def matrix(vectors: pa.Array) -> np.ndarray:
    """Lists as rows, shorter ones ending in zeros."""
    vectors = vectors.combine_chunks() if isinstance(vectors, pa.ChunkedArray) else vectors
    size = np.diff(vectors.offsets.to_numpy())
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    width = int(size.max(initial=0))
    if (size == width).all():
        return flat.reshape(len(size), width)
    out = np.zeros((len(size), width), dtype=np.int64)
    out[np.arange(width) < size[:, None]] = flat
    return out


def widened(a: np.ndarray, width: int) -> np.ndarray:
    return a if a.shape[1] == width else np.pad(a, ((0, 0), (0, width - a.shape[1])))


def packed(vectors: np.ndarray, leaf: int = LEAF) -> np.ndarray:
    """An order of the rows in which each run of ``leaf`` lies together.

    The rows are sorted along the coordinate with the widest spread and cut into slices, each of
    whole leaves; every slice is sorted along the next one, and so on.
    """
    axes = np.argsort(-np.ptp(vectors, axis=0) if len(vectors) else [], kind="stable")[:AXES]

    def tile(rows: np.ndarray, depth: int) -> list[np.ndarray]:
        if depth == len(axes) or len(rows) <= leaf:
            return [rows]
        rows = rows[np.argsort(vectors[rows, axes[depth]], kind="stable")]
        leaves = ceil(len(rows) / leaf)
        slices = ceil(leaves ** (1 / (len(axes) - depth)))
        step = ceil(leaves / slices) * leaf
        return [part for i in range(0, len(rows), step) for part in tile(rows[i : i + step], depth + 1)]

    return np.concatenate(tile(np.arange(len(vectors)), 0))


def boxes(low: np.ndarray, high: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The boxes around each ``size`` boxes, or points, in turn."""
    starts = np.arange(0, len(low), size)
    return np.minimum.reduceat(low, starts), np.maximum.reduceat(high, starts)


_PAGE = "label long, task int, page int, rows int, ids binary, vectors binary"


def _cuts(sample: np.ndarray, rows: int) -> list:
    """Nested cuts of the sample, [axis, edges, parts], so that a tile holds about a page."""
    pages = ceil(rows / PAGE)
    if pages < 2 or not len(sample) or not sample.shape[1]:
        return []
    axes = np.argsort(-sample.std(axis=0), kind="stable")[:AXES]

    def cut(points: np.ndarray, pages: int, depth: int) -> list:
        if depth == len(axes) or pages < 2 or len(points) < 2:
            return []
        axis, slices = int(axes[depth]), ceil(pages ** (1 / (len(axes) - depth)))
        points = points[np.argsort(points[:, axis], kind="stable")]
        at = [len(points) * i // slices for i in range(slices + 1)]
        edges = points[at[1:-1], axis]
        return [axis, edges, [cut(points[b:e], ceil(pages / slices), depth + 1) for b, e in zip(at, at[1:], strict=False)]]

    return cut(sample, pages, 0)


def _tiles(vectors: np.ndarray, cuts: list) -> np.ndarray:
    """The tile of each row: a number that keeps the order of the slices."""
    out = np.zeros(len(vectors), dtype=np.int64)
    if cuts:
        axis, edges, parts = cuts
        values = vectors[:, axis] if axis < vectors.shape[1] else np.zeros(len(vectors), dtype=np.int64)
        slice_of = np.searchsorted(edges, values, side="right")
        for i in np.unique(slice_of):
            mine = slice_of == i
            out[mine] = (int(i) << 40) + (_tiles(vectors[mine], parts[i]) >> 20)
    return out


def pages_of(rows: DataFrame) -> DataFrame:
    """The rows as R-tree pages of one label each, written."""
    spark = rows.sparkSession
    n = rows.count()
    share = min(1.0, SAMPLE / max(n, 1))
    drawn = F.pmod(F.xxhash64("vec_id", "vector"), F.lit(1 << 30)) < F.lit(share * (1 << 30))
    sample = rows.filter(drawn).select("vector").toArrow()
    cuts = spark.sparkContext.broadcast(_cuts(matrix(sample.column("vector")), n))
    tiled_ddl = "vec_id long, label long, vector array<long>, tile long"
    tiled_schema, page_schema = arrow_schema(tiled_ddl), arrow_schema(_PAGE)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols = {name: batch.column(name) for name in batch.schema.names}
            yield record(cols | {"tile": _tiles(matrix(batch.column("vector")), cuts.value)}, tiled_schema)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, number = TaskContext.get().partitionId(), 0
        held: list[pa.RecordBatch] = []

        def page(part: pa.Table) -> pa.RecordBatch:
            nonlocal number
            vectors, ids = matrix(part.column("vector")), part.column("vec_id").to_numpy()
            order = packed(vectors)
            number += 1
            cols = {"label": [part.column("label")[0].as_py()], "task": [task], "page": [number], "rows": [len(ids)]}
            cols |= {"ids": [ids[order].tobytes()], "vectors": [vectors[order].tobytes()]}
            return record(cols, page_schema)

        for batch in batches:
            labels = batch.column("label").to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(labels)) + 1).tolist(), len(labels)]
            for begin, end in zip(edges, edges[1:], strict=False):
                while begin < end:
                    if held and held[0].column("label")[0].as_py() != labels[begin]:
                        yield page(pa.Table.from_batches(held))
                        held = []
                    take = min(end - begin, PAGE - sum(h.num_rows for h in held))
                    held.append(batch.slice(begin, take))
                    begin += take
                    if sum(h.num_rows for h in held) == PAGE:
                        yield page(pa.Table.from_batches(held))
                        held = []
        if held:
            yield page(pa.Table.from_batches(held))

    tiled = rows.select("vec_id", "label", "vector").mapInArrow(assign, tiled_ddl)
    placed = tiled.repartitionByRange("label", "tile", "vec_id").sortWithinPartitions("label", "tile", "vec_id")
    return keep(placed.select("vec_id", "label", "vector").mapInArrow(pack, _PAGE), "vector-pages")


# --- searching ---------------------------------------------------------------------------


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of the rows of two integer matrices."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(a.shape[1], 1)
    if most < _EXACT:
        return (a.astype(float) @ b.T.astype(float)).astype(np.int64)
    if most < _LONG / 128:
        return a @ b.T
    raise ValueError("an inner product of these vectors does not fit a long")


class Tree:
    """A page: leaves in order, their boxes, and the boxes of ``FANOUT`` leaves."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        self.ids, self.vectors = ids, vectors
        self.leaves = boxes(vectors, vectors, LEAF)
        self.nodes = boxes(*self.leaves, FANOUT)


def bounds(vectors: np.ndarray, box: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest inner product of each query with a point of each box."""
    up, down = np.maximum(vectors, 0), np.minimum(vectors, 0)
    low, high = box
    return products(up, low) + products(down, high), products(up, high) + products(down, low)


class Search:
    """The best rows of a block of queries so far; a query is a vector and a score window."""

    def __init__(self, vectors: np.ndarray, own: np.ndarray, ids: np.ndarray, low: np.ndarray, high: np.ndarray, k: int):
        """``own`` is each query's row of ``vectors``, ``ids`` the id that is not to be found."""
        self.vectors, self.own, self.not_id, self.low, self.high = vectors, own, ids, low, high
        self.scores = np.full((len(own), k), _LOW, dtype=np.int64)
        self.found = np.full((len(own), k), _HIGH, dtype=np.int64)

    def least(self) -> np.ndarray:
        """Scores below this are not wanted any more."""
        return np.maximum(self.low, self.scores[:, -1])

    def scan(self, tree: Tree, which: np.ndarray) -> None:
        """Best-first through a page for the queries ``which``."""
        below, above = bounds(self.vectors, tree.nodes)
        leaf_below, leaf_above = bounds(self.vectors, tree.leaves)
        queue = [(-int(above[self.own[which], i].max()), 0, i) for i in range(above.shape[1])] if len(which) else []
        heapq.heapify(queue)
        while queue:
            _, is_leaf, i = heapq.heappop(queue)
            low, high = (leaf_below, leaf_above) if is_leaf else (below, above)
            own = self.own[which]
            wanted = which[(high[own, i] >= self.least()[which]) & (low[own, i] <= self.high[which])]
            if not len(wanted):
                continue
            if is_leaf:
                self._leaf(tree, i, wanted)
                continue
            own = self.own[wanted]
            for j in range(i * FANOUT, min((i + 1) * FANOUT, leaf_above.shape[1])):
                heapq.heappush(queue, (-int(leaf_above[own, j].max()), 1, j))

    def _leaf(self, tree: Tree, i: int, wanted: np.ndarray) -> None:
        ids = tree.ids[i * LEAF : (i + 1) * LEAF]
        used, back = np.unique(self.own[wanted], return_inverse=True)
        scores = products(self.vectors[used], tree.vectors[i * LEAF : (i + 1) * LEAF])[back]
        fit = (scores >= self.least()[wanted, None]) & (scores <= self.high[wanted, None])
        fit &= ids != self.not_id[wanted, None]
        some = fit.any(1)
        rows = wanted[some]
        scores = np.concatenate((self.scores[rows], np.where(fit[some], scores[some], _LOW)), axis=1)
        found = np.concatenate((self.found[rows], np.where(fit[some], ids, _HIGH)), axis=1)
        order = np.lexsort((found, -scores))[:, : self.scores.shape[1]]
        self.scores[rows] = np.take_along_axis(scores, order, 1)
        self.found[rows] = np.take_along_axis(found, order, 1)


_HIT = "query long, anchor_id long, window long, high long, vec_id long, score long"
_TOLD = ["query", "anchor_id", "window", "high"]


def _cells(queries: DataFrame, pages: DataFrame, slabs: int, chunks: int, same_label: bool, k: int) -> DataFrame:
    """The best k rows of every query and window in each cell of the grid."""
    schema = arrow_schema(_HIT)

    def meet(asked: pa.Table, held: pa.Table) -> pa.Table:
        out = []
        label = asked.column("label").to_numpy()
        width = asked.column("wide").to_numpy()
        trees = []
        for row in held.select(["label", "rows", "ids", "vectors"]).to_pylist():
            ids = np.frombuffer(row["ids"], dtype=np.int64)
            trees.append((row["label"], Tree(ids, np.frombuffer(row["vectors"], dtype=np.int64).reshape(row["rows"], -1))))
        order = np.lexsort((asked.column("query").to_numpy(), label))
        for begin in range(0, len(order) if trees else 0, BLOCK):
            mine = order[begin : begin + BLOCK]
            block = asked.take(pa.array(mine))
            vectors = matrix(block.column("vector"))
            counts = width[mine]
            own = np.repeat(np.arange(len(mine)), counts)
            window, low, high = (
                np.array(block.column(c).combine_chunks().flatten(), dtype=np.int64) for c in ("window", "low", "high")
            )
            ids = block.column("anchor_id").to_numpy()
            search = Search(vectors, own, ids[own], low, high, k)
            for of, tree in trees:
                which = np.flatnonzero((label[mine][own] == of) == same_label)
                dims = max(vectors.shape[1], tree.vectors.shape[1])
                if tree.vectors.shape[1] != dims:
                    tree = Tree(tree.ids, widened(tree.vectors, dims))
                search.vectors = widened(vectors, dims)
                search.scan(tree, which)
            q, at = np.nonzero(search.found < _HIGH)
            cols = {"query": block.column("query").to_numpy()[own[q]], "anchor_id": ids[own[q]], "window": window[q]}
            cols |= {"high": high[q], "vec_id": search.found[q, at], "score": search.scores[q, at]}
            out.append(record(cols, schema))
        return pa.Table.from_batches(out, schema=schema)

    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = queries.withColumn("chunk", F.pmod("query", F.lit(chunks)).cast("int")).withColumn("slab", every(slabs))
    right = pages.withColumn("chunk", every(chunks))
    return left.groupBy("slab", "chunk").cogroup(right.groupBy("slab", "chunk")).applyInArrow(meet, _HIT)


def best(hits: DataFrame, k: int) -> DataFrame:
    """The first k hits of every query and window, with their rank."""
    first = Window.partitionBy("query", "window").orderBy(F.desc("score"), "vec_id")
    return hits.withColumn("rank", F.row_number().over(first)).filter(F.col("rank") <= k)


def search(queries: DataFrame, pages: DataFrame, same_label: bool, k: int = BEST) -> DataFrame:
    """The best k rows of every query's windows, with rank.

    ``queries`` has ``query`` (its key), ``anchor_id``, ``label``, ``vector`` and arrays ``window``,
    ``low`` and ``high`` of the same length. Rows of the query's own label are searched, or those of
    all others.
    """
    slabs, chunks = ceil(max(pages.count(), 1) / SLAB_PAGES), ceil(max(queries.count(), 1) / CHUNK)
    queries = queries.withColumn("wide", F.size("window").cast("long"))
    slabbed = pages.withColumn("slab", F.pmod(F.xxhash64("task", "page"), F.lit(slabs)).cast("int"))
    seed = F.pmod("slab", F.lit(SEEDED)) == 0
    seeded = keep(best(_cells(queries, slabbed.filter(seed), slabs, chunks, same_label, k), k), "vector-seeds")
    kth = seeded.filter(F.col("rank") == k).groupBy("query").agg(
        F.map_from_entries(F.collect_list(F.struct("window", "score"))).alias("kth")
    )
    raised = F.zip_with("window", "low", lambda w, low: F.greatest(low, F.coalesce(F.try_element_at("kth", w), low)))
    bounded = queries.join(kth, "query", "left").withColumn("low", F.when(F.col("kth").isNull(), F.col("low")).otherwise(raised))
    rest = _cells(bounded.drop("kth"), slabbed.filter(~seed), slabs, chunks, same_label, k)
    return best(seeded.drop("rank").unionByName(rest), k)


def mine(rows: DataFrame, anchors: Column, positives: int = BEST, negatives: int = BEST) -> DataFrame:
    """Hard negatives of the rows that ``anchors`` picks.

    For each anchor its first ``positives`` other rows of the same label, and for each of those
    the first ``negatives`` rows of other labels whose score is at least 80 and at most 100
    percent of the positive's. Higher scores come first, ties by smaller id.
    """
    rows = keep(rows, "vectors")
    pages = pages_of(rows)
    asked = rows.filter(anchors).dropDuplicates()
    key = F.xxhash64("vec_id", "label", "vector")
    one = lambda value: F.array(F.lit(value).cast("long"))
    queries = asked.select(key.alias("query"), F.col("vec_id").alias("anchor_id"), "label", "vector")
    plain = queries.withColumns({"window": one(0), "low": one(_LOW), "high": one(_HIGH)})
    near = keep(search(plain, pages, True, positives), "positives")
    # positives by their rank, as rows may share an id
    windows = near.groupBy("query").agg(F.array_sort(F.collect_list(F.struct("rank", "vec_id", "score"))).alias("near"))
    # the least integer of at least four fifths of the score
    least = lambda p: F.call_function("div", F.lit(4) * p["score"] + F.when(p["score"] > 0, 4).otherwise(0), F.lit(5))
    wanted = queries.join(windows, "query").select(
        "query",
        "anchor_id",
        "label",
        "vector",
        F.transform("near", lambda p: p["rank"].cast("long")).alias("window"),
        F.transform("near", least).alias("low"),
        F.transform("near", lambda p: p["score"]).alias("high"),
    )
    found = search(wanted, pages, False, negatives).join(windows, "query")
    return found.select(
        "anchor_id",
        F.element_at("near", F.col("window").cast("int"))["vec_id"].alias("positive_id"),
        F.col("rank").cast("int").alias("rank"),
        F.col("vec_id").alias("negative_id"),
        F.col("high").alias("positive_score"),
        F.col("score").alias("negative_score"),
    )
