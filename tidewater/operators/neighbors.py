"""Nearest-neighbour scoring (survey J14, K01-K03).

Exact k-NN join by pivots: references lie in the Voronoi cells of a bounded set of
pivots, cut into rings by their distance from the pivot and into blocks of bounded
rows.  A first round looks into the block around each query and gives an upper
bound of its k-th distance; a second round visits only the blocks that the
triangle inequality can't exclude under that bound.
"""

from __future__ import annotations

import math
from typing import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewater.session import cut_lineage

__all__ = ["dimension_stats", "knn_topk", "knn_evaluations", "knn_score", "masked_topk", "loo_attribution", "local_surrogate"]

#: Pivots (the square root of the references, at most so many), rows of a reference block and of a query chunk.
MOST_PIVOTS = 512
REF_ROWS = 8192
QUERY_ROWS = 8192
#: Pairs of a query and a reference that a task looks at together.
PAIRS = 2 << 20
#: Masked queries in a chunk of ``masked_topk``, numbers looked at together, most and least references in a group, and references whose
#: ids a task holds at least.
MASKED_ROWS = 1 << 19
BLOCK = 1 << 18
GROUP_ROWS = 1 << 21
LEAST_ROWS = 1 << 10
KEPT_ROWS = 1 << 18
#: Relative allowance for rounding in the bounds; it only lets in more candidates.
SLACK = 1e-9
#: The same for squared distances from a matrix product, as a part of the squared norms.
ROUGH = 1e-10


def dimension_stats(refs: DataFrame, vec: str = "embedding") -> DataFrame:
    """Per-dimension mean and population std (0 → 1) of the reference vectors."""
    e = refs.select(F.posexplode(vec).alias("dim", "x"))
    a = e.groupBy("dim").agg(F.avg(F.col("x").cast("double")).alias("mean"),
                             F.stddev_pop(F.col("x").cast("double")).alias("__s"))
    return a.select("dim", "mean", F.when(F.col("__s") == 0, F.lit(1.0)).otherwise(F.col("__s")).alias("std"))


class _Space:
    """Standardised RMS distance and the cells of the pivots: what every task needs, bounded by
    ``MOST_PIVOTS`` and the vectors' width."""

    def __init__(self, mean, std, pivots):
        self.mean, self.std = mean, std
        self.pivots = self.standard(pivots)
        self.width_of_vectors = self.pivots.shape[1]

    def standard(self, vectors) -> np.ndarray:
        x = np.asarray(vectors, dtype=np.float64)
        return x if self.mean is None else (x - self.mean) / self.std

    @staticmethod
    def distances(a: np.ndarray, x: np.ndarray) -> np.ndarray:
        out = np.empty((len(a), len(x)))
        step = max(1, (4 << 20) // max(1, x.size))  # bounds the (rows x rows x dims) buffer
        for s in range(0, len(a), step):
            out[s:s + step] = np.sqrt(((a[s:s + step, None, :] - x[None, :, :]) ** 2).mean(axis=2))
        return out

    def with_cells(self, rows: list, ref_rows: int) -> None:
        """``rows``: (cell, n, low, high) of the cells that hold references."""
        n = len(self.pivots)
        self.count, self.low, self.high = np.zeros(n), np.full(n, np.inf), np.zeros(n)
        for cell, rows_in, low, high in rows:
            self.count[cell], self.low[cell], self.high[cell] = rows_in, low, high
        self.rings = np.maximum(1, np.ceil(self.count / ref_rows))
        self.width = np.where(self.high > 0, self.high / self.rings, 1.0)
        # neighbouring cells are packed up to ``ref_rows`` references; a cell of several rings is alone
        self.pack, at, held = np.zeros(n, dtype=np.int32), -1, math.inf
        for cell in range(n):
            if held + self.count[cell] > ref_rows:
                at, held = at + 1, 0
            self.pack[cell], held = at, held + self.count[cell]
        self.starts = np.searchsorted(self.pack, np.arange(at + 1))
        self.lead = np.array([a + self.count[a:b].argmax() for a, b in zip(self.starts, [*self.starts[1:], n])])

    def ring(self, cell, dist):
        return np.clip(np.floor(dist / self.width[cell]), 0, self.rings[cell] - 1).astype(np.int64)

    def first_bound(self, d: np.ndarray, k: int) -> np.ndarray:
        """For rows of pivot distances, a distance within which k references surely lie: every reference of a
        cell is at most (distance of its pivot + radius of the cell) away."""
        far = d + self.high
        order = np.argsort(far, axis=1)
        enough = np.cumsum(self.count[order], axis=1) >= k
        first = np.argmax(enough, axis=1)
        bound = np.take_along_axis(far, order, axis=1)[np.arange(len(d)), first]
        return np.where(enough.any(axis=1), bound, np.inf)

    def open_cells(self, d: np.ndarray, least: np.ndarray, reach: np.ndarray, cells) -> np.ndarray:
        """For rows of distances from the pivots of ``cells``, which of them may hold a reference within ``reach`` of the query: by
        the triangle inequality through the cell's pivot, and as a reference of a cell is no nearer to
        the query's own pivot, ``least`` away, than to the cell's."""
        nearest = np.maximum.reduce([d - self.high[cells], self.low[cells] - d, (d - least[:, None]) / 2])
        return (nearest <= reach[:, None]) & (self.count[cells] > 0)

    def visits(self, d: np.ndarray, bound: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, pack, ring) that may hold a reference within its ``bound`` of a query whose pivot distances are a row of ``d``."""
        reach = bound * (1 + SLACK) + SLACK
        open_ = self.open_cells(d, d.min(axis=1), reach, np.arange(len(self.pivots)))
        row, pack = np.nonzero(np.logical_or.reduceat(open_, self.starts, axis=1))
        # a pack's most populous cell is its only one where there are rings
        cell = self.lead[pack]
        inner = np.maximum(self.low[cell], d[row, cell] - reach[row]) * (1 - SLACK)
        outer = np.minimum(self.high[cell], d[row, cell] + reach[row]) * (1 + SLACK)
        ringed = self.rings[cell] > 1
        first, last = np.where(ringed, self.ring(cell, inner), 0), np.where(ringed, self.ring(cell, outer), 0)
        n = np.maximum(0, last - first + 1)
        ring = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first, n)
        return np.repeat(row, n), np.repeat(pack, n), ring


def _type(df: DataFrame, name: str) -> str:
    return df.schema[name].dataType.simpleString()


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """A list column as a matrix of doubles; missing elements are NaN."""
    if len(column) and pc.any(pc.not_equal(pc.list_value_length(column), width)).as_py():
        raise ValueError(f"vectors must have {width} elements")
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), width)


def _numbers(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(name).to_numpy(zero_copy_only=False)


def _with(batch: pa.RecordBatch, **columns) -> pa.RecordBatch:
    names = [n for n in batch.schema.names if n not in columns]
    return pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), *map(pa.array, columns.values())], [*names, *columns])


class _Slab:
    """The references of one slab inside a task: at most about ``ref_rows`` rows."""

    def __init__(self, batches: list[pa.RecordBatch], space: _Space):
        rows = pa.Table.from_batches(batches).combine_chunks().to_batches()[0]
        self.ids, self.y = rows.column("i"), rows.column("y")
        self.x = space.standard(_matrix(rows.column("v"), space.width_of_vectors))
        self.dist, self.cell = _numbers(rows, "dist"), _numbers(rows, "cell")
        self.cells, self.at = np.unique(self.cell, return_inverse=True)
        self.norm = (self.x ** 2).sum(axis=1)

    def order(self) -> np.ndarray:
        """Place of each row by its id."""
        place = np.empty(len(self.ids), dtype=np.int64)
        place[pc.array_sort_indices(self.ids, null_placement="at_start").to_numpy()] = np.arange(len(self.ids))
        return place

    def rows_of(self) -> dict:
        rows: dict = {}
        for n, i in enumerate(self.ids.to_pylist()):
            rows.setdefault(i, []).append(n)
        return rows

    def open_pairs(self, space: _Space, a: np.ndarray, least: np.ndarray, reach: np.ndarray) -> np.ndarray:
        """Which references the bounds leave open for each query: those in open cells and in the ring
        |distance from the pivot - the query's own| <= reach."""
        d = space.distances(a, space.pivots[self.cells])
        open_ = space.open_cells(d, least, reach, self.cells)
        return open_[:, self.at] & (np.abs(self.dist - d[:, self.at]) <= reach[:, None])


def _by_slab(it: Iterator[pa.RecordBatch], space: _Space, work) -> Iterator[pa.RecordBatch]:
    """Calls ``work`` with each slab (None without references) and the batches of its queries; rows come
    sorted by slab, references first, so that a task holds one slab and one batch."""
    key, held, slab = None, [], None
    for batch in it:
        if not batch.num_rows:
            continue
        keys = np.stack([_numbers(batch, c) for c in ("pack", "ring", "sub", "chunk", "side")], axis=1)
        cuts = [0, *(np.flatnonzero((np.diff(keys, axis=0) != 0).any(axis=1)) + 1).tolist(), len(keys)]
        for a, b in zip(cuts, cuts[1:]):
            part, at = batch.slice(a, b - a), tuple(keys[a, :4])
            if at != key:
                key, held, slab = at, [], None
            if keys[a, 4] == 0:
                held.append(part)
                continue
            if held:
                slab, held = _Slab(held, space), []
            rows = PAIRS if slab is None else max(1, PAIRS // len(slab.ids))
            for s in range(0, part.num_rows, rows):
                yield from work(slab, part.slice(s, rows))


def _meetings(refs: DataFrame, queries: DataFrame, k: int, id_col: str, vec: str, outcome: str, query_id: str,
              scale: bool, self_id: str | None, query_rows: int, ref_rows: int) -> tuple[DataFrame, _Space]:
    """Rows of the second round, partitioned and sorted for ``_by_slab``: each slab's references, then the queries whose
    bounds leave one of its cells open.  A slab is a pack of whole cells, or a part of a ring of a cell with more
    than ``ref_rows`` references; queries are dealt into chunks of about ``query_rows`` that meet a slab apart."""
    refs, queries = refs.where(F.col(vec).isNotNull()), queries.where(F.col(vec).isNotNull())
    dims = dimension_stats(refs, vec).orderBy("dim").collect()  # one row per dimension (bounded by width)
    mean = np.array([r["mean"] for r in dims]) if scale else None
    std = np.array([r["std"] for r in dims]) if scale else None
    n_pivots = min(MOST_PIVOTS, max(1, math.isqrt(refs.count())))
    pivots = refs.orderBy(F.xxhash64(id_col), id_col).select(vec).limit(n_pivots).collect()
    own = F.lit(None).cast(_type(refs, id_col)) if self_id is None else F.col(self_id)
    v_type = "array<float>" if _type(refs, vec) == _type(queries, vec) == "array<float>" else "array<double>"
    q_type, r_type, y_type = _type(queries, query_id), _type(refs, id_col), _type(refs, outcome)
    q = queries.select(F.col(query_id).alias("q"), F.col(vec).cast(v_type).alias("v"), own.cast(r_type).alias("i"))
    r = refs.select(F.col(id_col).alias("i"), F.col(vec).cast(v_type).alias("v"), F.col(outcome).alias("y"))
    space = _Space(mean, std, [p[vec] for p in pivots]) if pivots else None
    # references and queries travel in one layout; a query's "i" is the id of its own row
    layout = {"q": q_type, "i": r_type, "y": y_type, "v": v_type, "cell": "int", "dist": "double", "bound": "double", "least": "double",
              "pack": "int", "ring": "bigint", "sub": "bigint", "chunk": "bigint", "side": "int"}
    chunks = max(1, -(-queries.count() // query_rows))

    def together(some_refs: DataFrame, some_queries: DataFrame) -> DataFrame:
        """Both sides, a slab and chunk in one partition, references first."""
        some_refs = some_refs.withColumns({"side": F.lit(0), "chunk": F.explode(F.sequence(F.lit(0).cast("long"), F.lit(chunks - 1).cast("long")))})
        some_queries = some_queries.withColumns({"side": F.lit(1), "chunk": F.pmod(F.xxhash64("q"), F.lit(chunks).cast("long"))})
        full = lambda df: df.select(*[(F.col(c) if c in df.columns else F.lit(None)).cast(t).alias(c) for c, t in layout.items()])
        key = ["pack", "ring", "sub", "chunk"]
        return full(some_refs).unionByName(full(some_queries)).repartition(*key).sortWithinPartitions(*key, "side")

    if space is None:  # no reference at all
        return together(r.limit(0), q.limit(0)), space

    def place(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            if batch.num_rows:
                d = space.distances(space.standard(_matrix(batch.column("v"), space.width_of_vectors)), space.pivots)
                cell = d.argmin(axis=1)
                yield _with(batch, cell=cell.astype(np.int32), dist=d[np.arange(len(d)), cell])

    placed = cut_lineage(r.mapInArrow(place, f"i {r_type}, v {v_type}, y {y_type}, cell int, dist double"))
    cells = placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.min("dist").alias("low"), F.max("dist").alias("high"))
    space.with_cells([tuple(c) for c in cells.collect()], ref_rows)  # a row per pivot at most
    where = refs.sparkSession.createDataFrame([(n, *at) for n, at in enumerate(zip(space.pack.tolist(), space.rings.tolist(), space.width.tolist()))],
                                              "cell int, pack int, rings double, width double")
    ring = F.least(F.floor(F.col("dist") / F.col("width")), F.col("rings").cast("long") - 1)
    placed = placed.join(F.broadcast(where), "cell").withColumn("ring", ring).drop("rings", "width")
    # a ring is cut by a hash of the id where it holds more rows than a block (copies of one vector share a ring)
    crowds = placed.groupBy("pack", "ring").agg(F.count(F.lit(1)).alias("n")).withColumn("subs", F.ceil(F.col("n") / ref_rows)).drop("n")
    blocks = placed.join(crowds, ["pack", "ring"]).withColumn("sub", F.pmod(F.xxhash64("i"), F.col("subs"))).drop("subs")
    kk = int(k) + (self_id is not None)
    fields = f"q {q_type}, v {v_type}, i {r_type}"

    def around(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The block around each query and a bound from the cells alone."""
        for batch in it:
            if batch.num_rows:
                d = space.distances(space.standard(_matrix(batch.column("v"), space.width_of_vectors)), space.pivots)
                home = np.where(space.count > 0, d, np.inf).argmin(axis=1)
                yield _with(batch, cell=home.astype(np.int32), pack=space.pack[home], ring=space.ring(home, d[np.arange(len(d)), home]),
                            bound=space.first_bound(d, kk), least=d.min(axis=1))

    def bounds(slab: _Slab | None, part: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        """First round: the k-th distance within the query's block, where it is less."""
        bound = _numbers(part, "bound").copy()
        if slab is not None:
            a, home = space.standard(_matrix(part.column("v"), space.width_of_vectors)), _numbers(part, "cell")
            for cell in np.unique(home):
                x, rows = slab.x[slab.cell == cell], np.flatnonzero(home == cell)
                if len(x) >= kk:
                    bound[rows] = np.minimum(bound[rows], np.partition(space.distances(a[rows], x), kk - 1, axis=1)[:, kk - 1])
        yield _with(part.select(["q", "v", "i", "least"]), bound=bound)

    def spread(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Second round: the packs and rings that each query visits."""
        for batch in it:
            for s in range(0, batch.num_rows, 256):
                part = batch.slice(s, 256)
                d = space.distances(space.standard(_matrix(part.column("v"), space.width_of_vectors)), space.pivots)
                row, pack, ring = space.visits(d, _numbers(part, "bound"))
                yield _with(part.take(pa.array(row)), pack=pack.astype(np.int32), ring=ring)

    near = q.mapInArrow(around, fields + ", cell int, pack int, ring long, bound double, least double").withColumn("sub", F.lit(0).cast("long"))
    first = together(blocks.where("sub = 0"), near)
    bounded = cut_lineage(first.mapInArrow(lambda it: _by_slab(it, space, bounds), fields + ", least double, bound double"))
    visits = bounded.mapInArrow(spread, fields + ", least double, bound double, pack int, ring long").join(crowds, ["pack", "ring"])
    visits = visits.withColumn("sub", F.explode(F.sequence(F.lit(0).cast("long"), F.col("subs") - 1))).drop("subs")
    return together(blocks, visits), space


def _opened(slab: _Slab, part: pa.RecordBatch, space: _Space) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(standardised queries, their reach, open references of each)."""
    a = space.standard(_matrix(part.column("v"), space.width_of_vectors))
    reach = _numbers(part, "bound") * (1 + SLACK) + SLACK
    return a, reach, slab.open_pairs(space, a, _numbers(part, "least"), reach)


def knn_topk(refs: DataFrame, queries: DataFrame, k: int, id_col: str, vec: str, outcome: str,
             query_id: str = "query_id", scale: bool = True, self_id: str | None = None, query_rows: int = QUERY_ROWS,
             ref_rows: int = REF_ROWS) -> DataFrame:
    """Exact top-k neighbours per query by standardised RMS distance.

    Returns (query_id, ref id, distance, outcome, rank).  Ties break on the
    reference id.  ``self_id`` names the queries' column with the id of the reference
    that is the query's own row and no neighbour of it.  Rows without a vector are in no
    result.  Both sides stay distributed; the driver holds the pivots and a row per cell.

    Inside a slab squared distances from a matrix product leave out what is surely farther than
    the k-th; the distances of the rest are then computed term by term.
    """
    meetings, space = _meetings(refs, queries, k, id_col, vec, outcome, query_id, scale, self_id, query_rows, ref_rows)
    kk = int(k) + (self_id is not None)

    def nearest(slab: _Slab | None, part: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        if slab is None:
            return
        a, reach, able = _opened(slab, part, space)
        if self_id is not None:
            if not hasattr(slab, "own"):
                slab.own = slab.rows_of()
            for n, own in enumerate(part.column("i").to_pylist()):
                if own is not None:
                    able[n, slab.own.get(own, [])] = False
        norm = (a ** 2).sum(axis=1)
        rough = np.where(able, norm[:, None] + slab.norm - 2 * (a @ slab.x.T), np.inf)
        most = space.width_of_vectors * reach ** 2
        if len(slab.x) > kk:
            most = np.fmin(np.partition(rough, kk - 1, axis=1)[:, kk - 1], most)
        most = most + ROUGH * (1 + norm + np.nanmax(slab.norm))  # more than the product's rounding
        rows, at = np.nonzero(able & (rough <= most[:, None]))
        d = np.empty(len(rows))
        for s in range(0, len(rows), 1 << 16):  # copies of one vector can all be as near
            e = slice(s, s + (1 << 16))
            d[e] = np.sqrt(((a[rows[e]] - slab.x[at[e]]) ** 2).mean(axis=1))
        near = d <= reach[rows]
        rows, at, d = rows[near], at[near], d[near]
        if not hasattr(slab, "place"):
            slab.place = slab.order()
        sort = np.lexsort((slab.place[at], d, rows))  # ties of the distance break on the id
        rows, at, d = rows[sort], at[sort], d[sort]
        best = np.arange(len(rows)) - np.searchsorted(rows, rows) < kk
        rows, at = pa.array(rows[best]), pa.array(at[best])
        yield pa.RecordBatch.from_arrays([part.column("q").take(rows), slab.ids.take(at), pa.array(d[best]), slab.y.take(at)],
                                         ["__qid", "__rid", "distance", "__y"])

    schema = f"__qid {_type(queries, query_id)}, __rid {_type(refs, id_col)}, distance double, __y {_type(refs, outcome)}"
    w = Window.partitionBy("__qid").orderBy("distance", "__rid")  # <= visited slabs x k rows per query
    top = meetings.mapInArrow(lambda it: _by_slab(it, space, nearest), schema)
    top = top.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return top.select(F.col("__qid").alias(query_id), F.col("__rid").alias(id_col), "distance",
                      F.col("__y").alias(outcome), "rank")


def knn_evaluations(refs: DataFrame, queries: DataFrame, k: int, id_col: str, vec: str, outcome: str,
                    query_id: str = "query_id", scale: bool = True, self_id: str | None = None, query_rows: int = QUERY_ROWS,
                    ref_rows: int = REF_ROWS) -> DataFrame:
    """(query_id, evaluated): the references that the second round of ``knn_topk`` leaves open for each query."""
    meetings, space = _meetings(refs, queries, k, id_col, vec, outcome, query_id, scale, self_id, query_rows, ref_rows)

    def count(slab: _Slab | None, part: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        if slab is not None:
            n = _opened(slab, part, space)[2].sum(axis=1)
            yield pa.RecordBatch.from_arrays([part.column("q"), pa.array(n.astype(np.int64))], ["i", "n"])

    n = meetings.mapInArrow(lambda it: _by_slab(it, space, count), f"i {_type(queries, query_id)}, n long")
    return n.groupBy(F.col("i").alias(query_id)).agg(F.sum("n").alias("evaluated"))


def knn_score(refs: DataFrame, queries: DataFrame, k: int, id_col: str, vec: str, outcome: str,
              query_id: str = "query_id", min_dist: float = 0.05, self_id: str | None = None) -> DataFrame:
    """Weighted mean outcome of the k nearest references; weight
    1 / max(d, min_dist); k clamped to 1..15."""
    k = max(1, min(15, int(k)))
    top = knn_topk(refs, queries, k, id_col, vec, outcome, query_id, self_id=self_id)
    return _weighted(top, [query_id], outcome, min_dist)


def _weighted(top: DataFrame, by: list[str], outcome: str, min_dist: float) -> DataFrame:
    wgt = F.lit(1.0) / F.greatest(F.col("distance"), F.lit(min_dist))
    return top.groupBy(*by).agg(
        (F.sum(wgt * F.col(outcome).cast("double")) / F.sum(wgt)).alias("score"),
        F.count(F.lit(1)).alias("k"), F.avg("distance").alias("mean_distance"))


class _Masks:
    """A chunk of queries in a task, each with itself (mask 0) and its copies with one dimension at the mean, and for each of
    these the ``k`` nearest of the references that have gone past.

    References come in the order of their ids, so of equally far ones the earlier stays.  Setting dimension j of a query a to
    the mean, 0, adds 2 a_j x_j - a_j^2 to its squared distance from x: one product with the unmasked queries tells which pairs can matter to any mask,
    and only these are looked at mask by mask.  Held are the chunk, ``k`` places a mask and the ids and outcomes in these places."""

    def __init__(self, batches: list[pa.RecordBatch], mean: np.ndarray, std: np.ndarray, k: int):
        rows = pa.Table.from_batches(batches).combine_chunks().to_batches()[0]
        self.mean, self.std, self.k, self.width = mean, std, k, len(mean)
        a = (_matrix(rows.column("v"), self.width) - mean) / std
        some = np.flatnonzero(np.isfinite(a).all(axis=1))  # a query that lacks an element has no neighbours
        self.a, self.q = a[some], rows.column("q").take(pa.array(some))
        self.norm = (self.a ** 2).sum(axis=1)
        self.owners: dict = {}
        for n, own in enumerate(rows.column("i").take(pa.array(some)).to_pylist()):
            if own is not None:
                self.owners.setdefault(own, []).append(n)
        cells = len(some) * (self.width + 1)  # one for each query and mask
        self.dist, self.place = np.full((cells, k), np.inf), np.full((cells, k), -1, dtype=np.int64)
        self.ids, self.y, self.stored, self.most = [], [], 0, KEPT_ROWS

    def _few_copies(self, x: np.ndarray, ids: pa.Array) -> np.ndarray:
        """Rows without those that are no query's neighbours for the copies of the same vector that come first: ``k`` rows of each
        of the first ``k`` + 1 ids suffice, as a query leaves out one id."""
        which = np.unique(np.ascontiguousarray(x).view(np.dtype((np.void, 8 * max(1, self.width)))).ravel(), return_inverse=True)[1].ravel()
        if which.max(initial=-1) + 1 == len(x):
            return np.arange(len(x))
        order, n = np.argsort(which, kind="stable"), np.arange(len(x))
        which, name = which[order], ids.dictionary_encode("encode").indices.to_numpy()[order]
        other = np.append(True, which[1:] != which[:-1])
        fresh = other | np.append(True, name[1:] != name[:-1])
        nth_id = np.cumsum(fresh) - np.maximum.accumulate(np.where(other, np.cumsum(fresh), 0))
        nth_row = n - np.maximum.accumulate(np.where(fresh, n, 0))
        return np.sort(order[(nth_id <= self.k) & (nth_row < self.k)])

    def meet(self, batch: pa.RecordBatch) -> None:
        x = (_matrix(batch.column("v"), self.width) - self.mean) / self.std
        some = np.flatnonzero(np.isfinite(x).all(axis=1))
        some = some[self._few_copies(x[some], batch.column("i").take(pa.array(some)))]
        if not len(some) or not len(self.a):
            return
        x, ids = x[some], batch.column("i").take(pa.array(some))
        own = [(n, at) for at, i in enumerate(ids.to_pylist()) for n in self.owners.get(i, ())]
        own = np.array(own, dtype=np.int64).reshape(-1, 2)
        norm, low, high = (x ** 2).sum(axis=1), x.min(axis=0), x.max(axis=0)
        step = max(1, BLOCK // len(x))
        for s in range(0, len(self.a), step):
            mine = own[(own[:, 0] >= s) & (own[:, 0] < s + step)]
            self._meet(slice(s, s + step), x, norm, low, high, mine[:, 0] - s, mine[:, 1])
        self.ids.append(ids)
        self.y.append(batch.column("y").take(pa.array(some)))
        self.stored += len(some)
        if self.stored > self.most:
            self._forget()

    def _meet(self, part: slice, x: np.ndarray, norm: np.ndarray, low: np.ndarray, high: np.ndarray, own_row: np.ndarray, own_at: np.ndarray) -> None:
        a, masks, k = self.a[part], self.width + 1, self.k
        first = part.start * masks  # number of the first cell
        square = (-2 * a) @ x.T
        square += norm
        square += self.norm[part][:, None]
        square[own_row, own_at] = np.nan  # compares as false
        most = self.dist[first:first + len(a) * masks, -1].reshape(-1, masks) ** 2 * self.width
        fresh = np.flatnonzero(np.isinf(most).any(axis=1))
        if len(fresh) and len(x) >= k:  # no reference of the k nearest is farther than these k
            at = np.argpartition(square[fresh], k - 1, axis=1)[:, :k]  # missing ones come last
            near = np.take_along_axis(square[fresh], at, axis=1)[:, :, None]
            near = np.concatenate([near, near + a[fresh][:, None, :] * (2 * x[at] - a[fresh][:, None, :])], axis=2).max(axis=1)
            most[fresh] = np.fmin(most[fresh], near)
        rough = ROUGH * (1 + self.norm[part] + norm.max())  # more than the product's rounding
        most += rough[:, None]
        shift = a ** 2 + np.maximum(-2 * a * low, -2 * a * high)  # by which a mask can lessen the squared distance at most
        reach = np.maximum(most[:, 0], (most[:, 1:] + shift).max(axis=1, initial=-np.inf)) + rough
        rows, ats = np.divmod(np.flatnonzero(square <= reach[:, None]), len(x))
        step = max(1, BLOCK // masks)
        for s in range(0, len(rows), step):
            row, at = rows[s:s + step], ats[s:s + step]
            whole = square[row, at][:, None]
            masked = x[at]
            masked *= 2
            masked -= a[row]
            masked *= a[row]
            masked += whole
            near = np.hstack([whole <= most[row, :1], masked <= most[row, 1:]])
            pair, mask = np.divmod(np.flatnonzero(near), masks)
            for e in range(0, len(pair), BLOCK // 32):
                p, m = pair[e:e + BLOCK // 32], mask[e:e + BLOCK // 32]
                apart = a[row[p]] - x[at[p]]
                cut = np.flatnonzero(m > 0)
                apart[cut, m[cut] - 1] = -x[at[p[cut]], m[cut] - 1]
                self._keep(first + row[p] * masks + m, np.sqrt((apart ** 2).mean(axis=1)), self.stored + at[p])

    def _keep(self, cell: np.ndarray, d: np.ndarray, place: np.ndarray) -> None:
        nearer = np.flatnonzero(d < self.dist[cell, -1])
        nearer = nearer[np.lexsort((place[nearer], d[nearer], cell[nearer]))]
        cell, d, place = cell[nearer], d[nearer], place[nearer]
        nth = np.arange(len(cell)) - np.searchsorted(cell, cell)
        cell, d, place, nth = (v[nth < self.k] for v in (cell, d, place, nth))
        cells, at = np.unique(cell, return_inverse=True)
        dist, places = np.full((len(cells), self.k), np.inf), np.full((len(cells), self.k), -1, dtype=np.int64)
        dist[at, nth], places[at, nth] = d, place
        dist, places = np.hstack([self.dist[cells], dist]), np.hstack([self.place[cells], places])
        best = np.argsort(dist, axis=1, kind="stable")[:, :self.k]
        self.dist[cells], self.place[cells] = np.take_along_axis(dist, best, axis=1), np.take_along_axis(places, best, axis=1)

    def _forget(self) -> None:
        """Drops the ids and outcomes that are in no place."""
        used = np.unique(self.place[self.place >= 0])
        self.ids = [pa.chunked_array(self.ids).take(pa.array(used)).combine_chunks()]
        self.y = [pa.chunked_array(self.y).take(pa.array(used)).combine_chunks()]
        self.place = np.where(self.place >= 0, np.searchsorted(used, self.place), -1)
        self.stored, self.most = len(used), max(KEPT_ROWS, 2 * len(used))

    def found(self) -> Iterator[pa.RecordBatch]:
        """(query, masked dimension or -1, reference, distance, outcome)."""
        if not self.stored:
            return
        self._forget()
        ids, y, masks = self.ids[0], self.y[0], self.width + 1
        for s in range(0, len(self.place), BLOCK // 4):
            cell, nth = np.nonzero(self.place[s:s + BLOCK // 4] >= 0)
            cell += s
            place = pa.array(self.place[cell, nth])
            yield pa.RecordBatch.from_arrays(
                [self.q.take(pa.array(cell // masks)), pa.array((cell % masks - 1).astype(np.int32)), ids.take(place),
                 pa.array(self.dist[cell, nth]), y.take(place)], ["__qid", "dim", "__rid", "distance", "__y"])


def masked_topk(refs: DataFrame, queries: DataFrame, k: int, id_col: str, vec: str, outcome: str, query_id: str = "query_id",
                self_id: str | None = None, masked_rows: int = MASKED_ROWS) -> DataFrame:
    """Exact top-k neighbours, as by ``knn_topk``, of each query (``dim`` -1) and of each of its copies with one dimension at
    the references' mean (``dim`` from 0): (query_id, dim, ref id, distance, outcome, rank).

    Masked copies are made inside the tasks only.  References are dealt into groups and queries into chunks of about
    ``masked_rows`` masked ones; a task meets one chunk with one group and returns the k nearest.  So references are shuffled
    once a chunk, queries once a group, and there are about as many groups as keep all cores busy."""
    refs, queries = refs.where(F.col(vec).isNotNull()), queries.where(F.col(vec).isNotNull())
    spark = refs.sparkSession
    own = F.lit(None).cast(_type(refs, id_col)) if self_id is None else F.col(self_id)
    v_type = "array<float>" if _type(refs, vec) == _type(queries, vec) == "array<float>" else "array<double>"
    q_type, r_type, y_type = _type(queries, query_id), _type(refs, id_col), _type(refs, outcome)
    # written, as rows are dealt out by their number
    r = cut_lineage(refs.select(F.col(id_col).alias("i"), F.col(vec).cast(v_type).alias("v"), F.col(outcome).alias("y")))
    q = cut_lineage(queries.select(F.col(query_id).alias("q"), F.col(vec).cast(v_type).alias("v"), own.cast(r_type).alias("i")))
    dims = dimension_stats(r, "v").orderBy("dim").collect()  # one row per dimension (bounded by width)
    mean, std = np.array([float(d["mean"]) for d in dims]), np.array([float(d["std"]) for d in dims])
    if not dims:  # no reference at all
        q = q.limit(0)
    n_refs = r.count()
    chunks = max(1, -(-q.count() * (len(dims) + 1) // masked_rows))
    groups = max(-(-2 * spark.sparkContext.defaultParallelism // chunks), -(-n_refs // GROUP_ROWS))
    groups = min(groups, max(1, -(-n_refs // LEAST_ROWS)))

    def part(n: int):
        return F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(n).cast("long"))

    def every(n: int):
        return F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))

    # numbers that hash partitioning deals into a partition for each meeting
    meetings = chunks * groups
    slots = spark.range(64 * meetings).groupBy(F.pmod(F.hash("id"), F.lit(meetings)).cast("long").alias("meeting")).agg(F.min("id").alias("slot"))
    layout = {"q": q_type, "i": r_type, "y": y_type, "v": v_type, "meeting": "long", "side": "int"}
    sides = (q.withColumn("chunk", part(chunks)).withColumn("group", every(groups)).withColumn("side", F.lit(0)),
             r.withColumn("group", part(groups)).withColumn("chunk", every(chunks)).withColumn("side", F.lit(1)))
    queries_, refs_ = (df.withColumn("meeting", F.col("chunk") * groups + F.col("group")).select(
        *[(F.col(c) if c in df.columns or c == "meeting" else F.lit(None)).cast(t).alias(c) for c, t in layout.items()]) for df in sides)
    # queries first, then references by id
    dealt = queries_.unionByName(refs_).join(F.broadcast(slots), "meeting", "left").withColumn("slot", F.coalesce("slot", "meeting"))
    dealt = dealt.repartition(meetings, "slot").drop("slot").sortWithinPartitions("meeting", "side", "i")
    k = int(k)

    def nearest(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, masks = None, [], None
        for batch in it:
            keys = np.stack([_numbers(batch, c) for c in ("meeting", "side")], axis=1)
            cuts = [0, *(np.flatnonzero((np.diff(keys, axis=0) != 0).any(axis=1)) + 1).tolist(), len(keys)]
            for a, b in zip(cuts, cuts[1:]):
                if a == b:
                    continue
                if keys[a, 0] != at:
                    if masks is not None:
                        yield from masks.found()
                    at, held, masks = keys[a, 0], [], None
                if keys[a, 1] == 0:
                    held.append(batch.slice(a, b - a))
                elif held or masks is not None:
                    if held:
                        masks, held = _Masks(held, mean, std, k), []
                    masks.meet(batch.slice(a, b - a))
        if masks is not None:
            yield from masks.found()

    schema = f"__qid {q_type}, dim int, __rid {r_type}, distance double, __y {y_type}"
    w = Window.partitionBy("__qid", "dim").orderBy("distance", "__rid")  # <= groups x k rows of each masked query
    top = dealt.mapInArrow(nearest, schema).repartition("__qid")
    top = top.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return top.select(F.col("__qid").alias(query_id), "dim", F.col("__rid").alias(id_col), "distance",
                      F.col("__y").alias(outcome), "rank")


def loo_attribution(refs: DataFrame, queries: DataFrame, k: int, id_col: str, vec: str, outcome: str,
                    query_id: str = "query_id", top: int = 10, min_dist: float = 0.05, self_id: str | None = None) -> DataFrame:
    """Leave-one-feature-out attribution.

    Each dimension j of a query is replaced by the reference mean, the
    masked query is re-scored with K01, and attribution_j = score - masked
    score; the ``top`` dimensions by |attribution| are kept per query.  The
    |queries| x width masked ones are made inside the tasks (``masked_topk``).
    """
    k = max(1, min(15, int(k)))
    near = masked_topk(refs, queries, k, id_col, vec, outcome, query_id, self_id)
    scores = cut_lineage(_weighted(near, [query_id, "dim"], outcome, min_dist))  # read twice
    sc = queries.select(query_id).join(scores.select(query_id, "dim", "score"), query_id)
    b = sc.where(F.col("dim") == -1).select(query_id, F.col("score").alias("base_score"))
    m = sc.where(F.col("dim") >= 0).select(query_id, "dim", "score").join(b, query_id)
    m = m.withColumn("attribution", F.col("base_score") - F.col("score"))
    w = Window.partitionBy(query_id).orderBy(F.abs("attribution").desc(), "dim")  # width rows per query
    return m.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top) \
        .select(query_id, "dim", "base_score", F.col("score").alias("masked_score"), "attribution", "rank")


def local_surrogate(refs: DataFrame, queries: DataFrame, id_col: str, vec: str, outcome: str,
                    query_id: str = "query_id", bandwidth: float = 0.75, ridge: float = 0.05,
                    min_rows: int = 120, rows_per_dim: int = 5, self_id: str | None = None) -> DataFrame:
    """Local weighted linear surrogate around each query.

    The nearest max(min_rows, rows_per_dim * width) references (exact k-NN)
    get kernel weights exp(-d^2 / bandwidth^2); a weighted ridge regression
    (penalty on slopes only) of the outcome on the standardised vector is
    solved per query — one group of k rows, bounded by k — and reported as
    (query, dim, coefficient) with the intercept and weighted R^2.
    """
    stats = dimension_stats(refs, vec).orderBy("dim").collect()  # bounded by width
    mu = np.array([r["mean"] for r in stats])
    sd = np.array([r["std"] for r in stats])
    width = len(stats)
    k = max(int(min_rows), int(rows_per_dim) * width)
    top = knn_topk(refs, queries, k, id_col, vec, outcome, query_id, self_id=self_id)
    rows = top.join(refs.select(F.col(id_col), F.col(vec).alias("__rv")), id_col)
    qtype = queries.schema[query_id].dataType.simpleString()
    schema = f"{query_id} {qtype}, dim int, coef double, intercept double, r2 double, n long"
    bw2, lam = float(bandwidth) ** 2, float(ridge)

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        X = (np.vstack(pdf["__rv"].map(lambda a: np.asarray(a, dtype=np.float64)).to_numpy()) - mu) / sd
        y = pdf[outcome].to_numpy(dtype=np.float64)
        w = np.exp(-(pdf["distance"].to_numpy(dtype=np.float64) ** 2) / bw2)
        A = np.column_stack([np.ones(len(y)), X])
        pen = np.eye(A.shape[1]) * lam
        pen[0, 0] = 0.0
        beta = np.linalg.solve(A.T @ (A * w[:, None]) + pen, A.T @ (w * y))
        fitted = A @ beta
        ybar = np.sum(w * y) / np.sum(w)
        sst = np.sum(w * (y - ybar) ** 2)
        r2 = 1.0 - np.sum(w * (y - fitted) ** 2) / sst if sst > 0 else np.nan
        return pd.DataFrame({query_id: pdf[query_id].iloc[0], "dim": np.arange(width, dtype="int32"),
                             "coef": beta[1:], "intercept": beta[0], "r2": r2, "n": len(y)})

    return rows.select(query_id, "distance", outcome, "__rv").groupBy(query_id).applyInPandas(fit, schema)
