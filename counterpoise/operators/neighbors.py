"""Exact k-nearest-neighbour join.

Contract: one row per (query, neighbour) with ``qid, rank, nid, dist``. Neighbours are
ranked by 32-bit distance, ties by ascending key; rows at distance zero (the row itself
and exact copies) and rows with missing or NaN features never count. A query with fewer
than k neighbours returns those it has.

Two ways to run, one result:

``broadcast``  the candidate side was measured to be small, so it travels to every task
               and nothing but the queries moves.
``cells``      space is cut into cells of similar candidate load. Every query is sent to
               the cells its k nearest can lie in, blocks of queries meet blocks of
               candidates in an equi-join on the cell, and a window merges the lists.
"""

from __future__ import annotations

import json
import math
import pickle
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Accumulator
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from counterpoise.functions.distance import check_metric
from counterpoise.functions.features import Features, feature_vector, measurable
from counterpoise.materialize import materialize
from counterpoise.operators import kernel
from counterpoise.operators.sampling import task_count

STRATEGIES = ("auto", "broadcast", "cells")

# Candidate bytes that may travel to every task.
BROADCAST_BYTES = 32 << 20
# Up to this width cells are small and prune well; beyond it they are few and large.
PRUNED_WIDTH = 8
CELL_ROWS = 512
CELL_BYTES = 256 << 20
TASKS_PER_SLOT = 4
# Candidates of a block in a pivot cell.
PIVOT_ROWS = 512
# Queries per task slot from which on they are searched in their input splits.
SPREAD_ROWS = 100_000
# Bounds of what the driver plans with.
MAX_CELLS = 65_536
MAX_PIVOTS = 1_024
SAMPLE_BYTES = 64 << 20
# Bounds of what one call of the kernel holds.
BLOCK_ROWS = 32_768
BLOCK_BYTES = 8 << 20
QUERY_BLOCK_ROWS = 1_024
QUERY_BLOCK_BYTES = 1 << 20
ROUTE_ROWS = 4_096
SENT_ROWS = 65_536
SENT_BYTES = 8 << 20


@dataclass(frozen=True)
class Index:
    """Candidates laid out for the cells strategy, for any number of joins.

    ``blocks`` are packed candidates (cell, low, high, crows), ``grids`` the finer cells of
    oversized ones, ``fields`` the columns of a candidate. Up to ``k`` neighbours can be
    asked for.
    """

    blocks: DataFrame
    grids: DataFrame | None
    cells: kernel.Cells | kernel.Pivots
    fields: T.StructType
    k: int
    metric: str
    width: int
    salts: int

    @property
    def prune(self) -> bool:
        return isinstance(self.cells, kernel.Cells)

    def write(self, path: str) -> Index:
        """Store everything under ``path``; returns what ``open_index`` gives."""
        spark = self.blocks.sparkSession
        self.blocks.write.parquet(f"{path}/blocks")
        if self.grids is not None:
            self.grids.write.parquet(f"{path}/grids")
        facts = pa.table({
            "cells": pa.array([pickle.dumps(vars(self.cells))], pa.binary()),
            "pivots": [not self.prune], "finer": [self.grids is not None],
            "fields": [self.fields.json()], "k": [self.k], "metric": [self.metric],
            "width": [self.width], "salts": [self.salts]})
        spark.createDataFrame(facts).write.parquet(f"{path}/manifest")
        return open_index(spark, path)


def open_index(spark: SparkSession, path: str) -> Index:
    """An index that ``Index.write`` stored."""
    row = spark.read.parquet(f"{path}/manifest").first()
    kind = kernel.Pivots if row["pivots"] else kernel.Cells
    return Index(
        spark.read.parquet(f"{path}/blocks"),
        spark.read.parquet(f"{path}/grids") if row["finer"] else None,
        kind(**pickle.loads(bytes(row["cells"]))), T.StructType.fromJson(json.loads(row["fields"])),
        row["k"], row["metric"], row["width"], row["salts"])


def knn_index(candidates: DataFrame, *, k: int, key: str, features: Features,
              metric: str = "euclidean", candidate_columns: Sequence[str] = ()) -> Index:
    """An index of ``candidates`` for ``knn_join``, not yet stored; no rows is an error."""
    check_metric(metric)
    c = _candidates(candidates, key, features, candidate_columns)
    index = _build_index(c, k, metric)
    if index is None:
        raise ValueError("no candidate has measurable features")
    return index


@dataclass(frozen=True)
class Known:
    """Upper bounds of sizes that a caller has measured already."""

    query_rows: int | None = None
    candidate_bytes: float | None = None


def knn_join(
    queries: DataFrame,
    candidates: DataFrame | Index,
    *,
    k: int,
    key: str,
    features: Features,
    metric: str = "euclidean",
    query_columns: Sequence[str] = (),
    candidate_columns: Sequence[str] = (),
    vectors: bool = False,
    strategy: str = "auto",
    known: Known | None = None,
    compared: Accumulator | None = None,
) -> DataFrame:
    """k nearest candidates of every query row.

    ``query_columns`` / ``candidate_columns`` travel along as ``q_<name>`` / ``n_<name>``,
    ``vectors`` adds both feature vectors as ``qvec`` and ``nvec``; carrying them saves
    joining neighbours back to the table. What ``known`` says is not measured by a job;
    ``compared`` counts the pairs of points that the cells strategy looks at. With an
    ``Index`` as candidates nothing is read but its blocks; key and features are those of
    the queries.
    """
    check_metric(metric)
    if k < 1:
        raise ValueError("k must be at least 1")
    if strategy not in STRATEGIES:
        raise ValueError(f"strategy must be one of {STRATEGIES}, not {strategy!r}")
    q = queries.select(
        F.col(key).alias("qid"), feature_vector(queries, features).alias("qvec"),
        *[F.col(c).alias(f"q_{c}") for c in query_columns])
    q = q.where(measurable(F.col("qvec")))
    if isinstance(candidates, Index):
        if candidates.metric != metric or k > candidates.k:
            raise ValueError(f"the index is for {candidates.metric} and k up to {candidates.k}")
        return _search_index(q, candidates, k, _found_schema(q, candidates.fields, vectors), compared)
    c = _candidates(candidates, key, features, candidate_columns)
    out = _found_schema(q, c.schema, vectors)
    if strategy != "cells":
        known = known or Known()
        asked, size = known.query_rows, known.candidate_bytes
        if size is None:
            n, _, size = _measure(c)
            asked = n if queries is candidates else asked
        if size <= BROADCAST_BYTES:
            return _broadcast_join(q, c, k, metric, out, asked)
        if strategy == "broadcast":
            raise ValueError(f"candidate rows of {size} bytes are too many to broadcast")
    index = _build_index(c, k, metric)
    if index is None:
        return q.sparkSession.createDataFrame([], out)
    return _search_index(q, index, k, out, compared)


def _candidates(candidates: DataFrame, key: str, features: Features,
                columns: Sequence[str]) -> DataFrame:
    c = candidates.select(
        F.col(key).alias("nid"), feature_vector(candidates, features).alias("nvec"),
        *[F.col(n).alias(f"n_{n}") for n in columns])
    return c.where(measurable(F.col("nvec")))


def _measure(c: DataFrame) -> tuple[int, int, float]:
    """Rows, vector width and an upper bound of the bytes of a candidate frame."""
    size = F.lit(8.0) * F.size("nvec")
    for field in c.schema.fields:
        if isinstance(field.dataType, (T.StringType, T.BinaryType)):
            size = size + F.coalesce(F.octet_length(field.name), F.lit(0)) + 8
        elif isinstance(field.dataType, (T.ArrayType, T.MapType, T.StructType, T.VariantType)):
            # A nested column other than the vector itself has no known bound.
            size = size if field.name == "nvec" else size + F.lit(float("inf"))
        else:
            size = size + 16
    row = c.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("nvec")).alias("width"),
                F.sum(size).alias("bytes")).first()
    return row["n"], row["width"] or 0, row["bytes"] or 0.0


def _found_schema(q: DataFrame, candidate: T.StructType, vectors: bool) -> T.StructType:
    types = {f.name: f.dataType for f in [*q.schema.fields, *candidate.fields]}
    types |= {"rank": T.IntegerType(), "dist": T.FloatType()}
    names = ["qid", "rank", "nid", "dist", *[n for n in types if n[:2] in ("q_", "n_")]]
    names += ["qvec", "nvec"] if vectors else []
    return T.StructType([T.StructField(n, types[n]) for n in names])


def _broadcast_join(q: DataFrame, c: DataFrame, k: int, metric: str, out: T.StructType,
                    asked: int | None = None) -> DataFrame:
    """Join with candidates whose size was measured: they are handed to every task.

    In key order, with copies beyond the k-th left out; many narrow ones are laid out cell
    by cell, so that a query looks at a few cells only.
    """
    table = c.toArrow().sort_by("nid").combine_chunks()
    points = kernel.matrix(table.column("nvec").combine_chunks()) if table.num_rows else None
    cells = starts = order = None
    if points is not None:
        order = kernel.at_most_k_copies(points, k)
        points = points[order]
        n, d = points.shape
        if n >= 8 * CELL_ROWS and d <= PRUNED_WIDTH:
            per_cell = _sample_per_cell(k)
            step = max(1, CELL_ROWS // per_cell)
            cells = kernel.Cells.from_sample(points[::step], per_cell, k + 1, metric)
            home = cells.home(points)
            by_cell = np.argsort(home, kind="stable")
            order, points = order[by_cell], points[by_cell]
            starts = np.searchsorted(home[by_cell], np.arange(len(cells.points) + 1))
        table = table.take(pa.array(order)).combine_chunks()
    shared = q.sparkSession.sparkContext.broadcast(
        (table, points, cells and vars(cells), starts, order))
    names = out.fieldNames()

    def run(batches):
        table, points, cells, starts, order = shared.value
        if points is None:
            return
        grid = cells and kernel.Cells(**cells)
        rows = table.to_batches()[0]

        def search(asked):
            if grid is None:
                return kernel.nearest(asked, points, k, metric)
            return kernel.nearest_in_cells(asked, points, grid, starts, order, k, metric)

        for batch in kernel.larger(batches, SENT_ROWS, BROADCAST_BYTES):
            if not batch.num_rows:
                continue
            qi, ci, dist, rank = kernel.once_per_point(
                kernel.matrix(batch.column("qvec")), search)
            yield kernel.side_by_side(batch, pa.array(qi), rows, pa.array(ci), dist, rank, names)

    # The work per query is far larger than the row: few queries are spread by key, many
    # have enough input splits and stay where they are.
    slots = task_count(q)
    if (q.count() if asked is None else asked) < slots * SPREAD_ROWS:
        q = q.repartition(slots, "qid")
    return q.mapInArrow(run, out)


CELL, PLACE = T.StructField("cell", T.LongType()), T.StructField("place", T.LongType())
NEAR = T.StructField("near", T.ArrayType(T.DoubleType()))
REACH = T.StructField("radius", T.FloatType())


def _build_index(c: DataFrame, k: int, metric: str) -> Index | None:
    """Blocks of candidates (nid, nvec and more); None without rows."""
    # Among exact copies only the k lowest keys can ever be chosen. The row limit is
    # applied before the shuffle too, so a hot copy shrinks to k rows per map task.
    # The hash in front spares the sort most comparisons of whole vectors.
    copies = Window.partitionBy("_hash", "nvec").orderBy("nid")
    c = materialize(c.withColumn("_hash", F.xxhash64("nvec"))
                    .withColumn("_copy", F.row_number().over(copies))
                    .where(F.col("_copy") <= k).drop("_hash", "_copy"))
    n, d, _ = _measure(c)
    if not n:
        return None
    prune = d <= PRUNED_WIDTH
    salts = 1
    if prune:
        cells = _cut_cells(c, n, d, -(-n // CELL_ROWS), k, metric)
    else:
        # Where pivots do not help, nearly every query visits every cell. A grid of
        # (cell, salt) then copies queries and candidates about equally often, and the
        # copies grow with its size: it has some tasks per slot, not one per partition.
        tasks = TASKS_PER_SLOT * c.sparkSession.sparkContext.defaultParallelism
        wanted = max(math.isqrt(tasks), n * 8 * d // CELL_BYTES, 1)
        cells = _choose_pivots(c, n, d, wanted, k, metric)
        salts = -(-tasks // len(np.unique(cells.cell)))
    kind = type(cells)
    shared = c.sparkSession.sparkContext.broadcast(vars(cells))

    def house(batches):
        grid = kind(**shared.value)
        for batch in batches:
            for start in range(0, batch.num_rows, grid.routed_rows(ROUTE_ROWS)):
                part = batch.slice(start, grid.routed_rows(ROUTE_ROWS))
                points = kernel.matrix(part.column("nvec"))
                if prune:
                    home = grid.home(points)
                    place, near = grid.place(points, home), points[:, :0]
                else:
                    home, place, near = grid.house(points)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(home, pa.int64()), pa.array(place), kernel.lists(near), *part.columns],
                    names=["cell", "place", "near", *part.schema.names])

    housed = c.mapInArrow(house, T.StructType([CELL, PLACE, NEAR, *c.schema.fields]))
    # In pivot cells a block is smaller, so that more of them can be left out.
    block_rows = min(BLOCK_ROWS if prune else PIVOT_ROWS, BLOCK_BYTES // (8 * d) + 1)
    grids = None
    if prune and -(-n // CELL_ROWS) > MAX_CELLS:
        grids = materialize(_finer_cells(housed, k, metric))
        housed = _cut_again(_pack_by_cell(housed, "rows", block_rows, "nvec", "nid"), grids, "nvec",
                            k, housed.schema)
    blocks = _pack_by_cell(housed, "crows", block_rows, "nvec" if prune else "near", "nid")
    return Index(blocks.drop("reach"), grids, cells, c.schema, k, metric, d, salts)


def _search_index(q: DataFrame, index: Index, asked_k: int, out: T.StructType,
                  compared: Accumulator | None = None) -> DataFrame:
    # As many neighbours are looked for as a point may have copies in the index.
    k, metric, prune, salts = index.k, index.metric, index.prune, index.salts
    kind = type(index.cells)
    shared = q.sparkSession.sparkContext.broadcast(vars(index.cells))

    def route(batches):
        grid = kind(**shared.value)
        for batch in batches:
            for start in range(0, batch.num_rows, grid.routed_rows(ROUTE_ROWS)):
                part = batch.slice(start, grid.routed_rows(ROUTE_ROWS))
                points = kernel.matrix(part.column("qvec"))
                if prune:
                    qi, cell, radius = grid.route(points, k)
                    near = points[:, :0]
                else:
                    qi, cell, radius, own, near = grid.route(points, k)
                step = min(SENT_ROWS, SENT_BYTES // (8 * max(1, points.shape[1])) + 1)
                for at in range(0, len(qi), step):
                    rows, there = qi[at:at + step], cell[at:at + step]
                    sent = part.take(pa.array(rows))
                    place = grid.place(points[rows], there) if prune else own[rows]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(there, pa.int64()), pa.array(place), kernel.lists(near[rows]),
                         pa.array(radius[rows]), *sent.columns],
                        names=["cell", "place", "near", "radius", *sent.schema.names])

    # Neighbours are found per distinct query vector, which two independent 64-bit hashes
    # stand for from here on; the query's own columns come back by a join on them.
    q = q.withColumns({"_h1": F.xxhash64("qvec"), "_h2": F.xxhash64(F.lit("second"), "qvec")})
    vectors = q.select("_h1", "_h2", "qvec").distinct()
    found = T.StructType([
        vectors.schema["_h1"], vectors.schema["_h2"], T.StructField("dist", T.FloatType()),
        *[f for f in index.fields.fields if f.name in out.fieldNames()]])
    names = found.fieldNames()

    def meet(batches):
        last, best = None, None
        for batch in batches:
            left, right = batch.column("qrows"), batch.column("crows")
            lrows = pa.RecordBatch.from_struct_array(left.flatten())
            rrows = pa.RecordBatch.from_struct_array(right.flatten())
            points = kernel.matrix(lrows.column("qvec"))
            targets = kernel.matrix(rrows.column("nvec"))
            radius = lrows.column("radius").to_numpy(zero_copy_only=False)
            if not prune:
                qnear, cnear = kernel.matrix(lrows.column("near")), kernel.matrix(rrows.column("near"))
            loff = left.offsets.to_numpy() - left.offsets[0].as_py()
            roff = right.offsets.to_numpy() - right.offsets[0].as_py()
            for i in range(batch.num_rows):
                ls, rs = slice(loff[i], loff[i + 1]), slice(roff[i], roff[i + 1])
                this = (batch.column("cell")[i].as_py(), points[ls.start].tobytes())
                if this != last:  # else: the same queries meet the cell's next block
                    last, best = this, np.full((ls.stop - ls.start, k), np.inf, np.float32)
                bound = np.minimum(radius[ls], best[:, -1])
                if prune:
                    low, high = targets[rs].min(axis=0), targets[rs].max(axis=0)
                    near = np.flatnonzero(kernel.outside(points[ls], low, high, metric) <= bound)
                else:
                    low, high = cnear[rs].min(axis=0), cnear[rs].max(axis=0)
                    near = np.flatnonzero(~kernel.beyond_pivots(qnear[ls], low, high, bound))
                if not len(near):
                    continue
                if compared is not None:
                    compared.add(len(near) * (rs.stop - rs.start))
                qi, ci, dist, rank = kernel.nearest(
                    points[ls][near], targets[rs], k, metric, bound[near])
                qi = near[qi]
                if len(qi):
                    best = kernel.tighten(best, qi, dist, rank)
                    yield kernel.side_by_side(lrows, pa.array(qi + ls.start), rrows,
                                              pa.array(ci + rs.start), dist, rank, names)
            # Block pairs are large: a batch goes before the next one is read.
            del batch, left, right, lrows, rrows, points, targets, radius
            qnear = cnear = None

    routed = vectors.mapInArrow(route, T.StructType([CELL, PLACE, NEAR, REACH, *vectors.schema.fields]))
    asked_rows = min(QUERY_BLOCK_ROWS, QUERY_BLOCK_BYTES // (8 * index.width) + 1)
    if index.grids is not None:
        routed = _cut_again(_pack_by_cell(routed, "rows", asked_rows, "qvec"), index.grids, "qvec",
                            k, routed.schema)
    asked = _pack_by_cell(routed, "qrows", asked_rows, "qvec" if prune else "near")
    blocks = index.blocks
    on = ["cell"]
    if salts > 1:
        on = ["cell", "salt"]
        salt = F.pmod(F.col("qrows")[0]["_h1"], F.lit(salts)).cast("int")
        asked = asked.withColumn("salt", salt)
        blocks = blocks.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    # Blocks of one cell that lie further apart than any radius never meet.
    asked = asked.withColumnsRenamed({"low": "q_low", "high": "q_high"})
    met = (asked.join(blocks, on).where(_box_gap(metric) <= F.col("reach") if prune else ~_pivot_gap())
           .select("cell", "qrows", "crows").mapInArrow(meet, found))
    order = Window.partitionBy("_h1", "_h2").orderBy("dist", "nid")
    near = met.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= asked_k)
    # Joined on the swapped pair, which is not the window's own partitioning: so the join
    # has an exchange on both sides, and a vector shared by very many queries can be split
    # at run time.
    near = near.withColumn("_join", F.xxhash64("_h2", "_h1"))
    back = q.withColumn("_join", F.xxhash64("_h2", "_h1"))
    return back.join(near, ["_join", "_h1", "_h2"]).select(*out.fieldNames())


def _box_gap(metric: str):
    """Rounded distance between the boxes of a query block and a candidate block.

    Summed like a distance, of which every step is monotone, so no pair can be nearer.
    """
    apart = F.zip_with(
        F.zip_with("q_low", "high", lambda a, b: a - b),
        F.zip_with("low", "q_high", lambda a, b: a - b),
        lambda a, b: F.greatest(a, b, F.lit(0.0)))
    if metric == "manhattan":
        return F.aggregate(apart, F.lit(0.0), lambda t, g: t + g).cast("float")
    return F.sqrt(F.aggregate(apart, F.lit(0.0), lambda t, g: t + g * g)).cast("float")


def _pivot_gap():
    """Whether a query block and a candidate block, told by their distances from the pivots,
    lie further apart than the queries' radius and what rounding may add."""
    apart = F.zip_with(
        F.zip_with("q_low", "high", lambda a, b: a - b),
        F.zip_with("low", "q_high", lambda a, b: a - b), lambda a, b: F.greatest(a, b))
    size = F.array_max("high") + F.array_max("q_high")
    reach = F.col("reach").cast("double") * (1 + 2.0**-20) + size * kernel.ROUNDING
    return F.exists(apart, lambda g: ~F.isnan(g) & (g > reach))


def _pack_by_cell(rows: DataFrame, name: str, block_rows: int, vector: str,
                  order: str | None = None) -> DataFrame:
    """Bring a cell's rows together and pack them into compact blocks of bounded size.

    A block never exceeds ``block_rows``, and rebalancing may split a hot cell over
    several tasks: a cell simply has more blocks then. Rows that lie together share a
    block, inside which they are in the order of the column ``order``.
    """
    corner = T.ArrayType(T.DoubleType())
    packed = T.StructType([
        T.StructField("cell", T.LongType()), T.StructField("low", corner),
        T.StructField("high", corner), T.StructField("reach", T.FloatType()),
        T.StructField("rows", T.ArrayType(T.StructType(
            [f for f in rows.schema.fields if f.name not in ("cell", "place")])))])

    def run(batches):
        return kernel.pack(batches, block_rows, vector, order)

    return (rows.hint("rebalance", "cell").sortWithinPartitions("cell", "place")
            .mapInArrow(run, packed).withColumnRenamed("rows", name))


def _finer_cells(housed: DataFrame, k: int, metric: str) -> DataFrame:
    """(cell, grid): cells of about CELL_ROWS candidates inside each of the cells that the
    driver cut, from a sample of their rows, which a task per cell holds."""
    per_cell = _sample_per_cell(k)
    draw = F.pmod(F.xxhash64("nid"), F.lit(1 << 30)) < F.lit(int(per_cell / CELL_ROWS * (1 << 30)))

    def cut(rows: pa.Table) -> pa.Table:
        points = kernel.matrix(rows.column("nvec").combine_chunks())
        return pa.table({"cell": rows.column("cell")[:1].cast(pa.int64()), "grid": pa.array(
            [kernel.cut_cells(points, per_cell, k + 1, metric)], pa.binary())})

    return housed.where(draw).select("cell", "nvec").groupBy("cell").applyInArrow(
        cut, "cell long, grid binary")


def _cut_again(packed: DataFrame, grids: DataFrame, vector: str, k: int,
               schema: T.StructType) -> DataFrame:
    """Rows of packed cells in finer cells; those of a cell without a grid stay as they are."""
    def run(batches):
        return kernel.cut_again(batches, "rows", vector, k)

    def unpack(batches):
        for batch in batches:
            rows = batch.column("rows")
            cell = np.repeat(batch.column("cell").to_numpy() << kernel.FINER_BITS,
                             rows.value_lengths().to_numpy())
            block = pa.RecordBatch.from_struct_array(rows.flatten())
            yield pa.RecordBatch.from_arrays(
                [pa.array(cell), pa.array(np.zeros(len(cell), np.int64)), *block.columns],
                names=["cell", "place", *block.schema.names])

    rows = packed.select("cell", "rows")
    finer = rows.join(grids, "cell").mapInArrow(run, schema)
    return finer.unionByName(rows.join(grids, "cell", "left_anti").mapInArrow(unpack, schema))


def _choose_pivots(c: DataFrame, n: int, d: int, cells: int, k: int, metric: str) -> kernel.Pivots:
    """Pivots for wide points, from a candidate sample whose size is bounded."""
    per_pivot = 4 * _sample_per_cell(k)
    wanted = max(1, min(MAX_PIVOTS, max(cells, n // CELL_ROWS), SAMPLE_BYTES // (8 * d * per_pivot)))
    return kernel.Pivots.from_sample(
        _sampled(c, n, d, wanted * per_pivot), wanted, cells, per_pivot, metric)


def _sample_per_cell(k: int) -> int:
    return max(32, 2 * (k + 1))


def _cut_cells(c: DataFrame, n: int, d: int, wanted: int, k: int, metric: str) -> kernel.Cells:
    """About ``wanted`` cells, cut from a candidate sample whose size is bounded."""
    per_cell = _sample_per_cell(k)
    wanted = min(wanted, MAX_CELLS, max(1, SAMPLE_BYTES // (8 * d * per_cell)))
    return kernel.Cells.from_sample(_sampled(c, n, d, wanted * per_cell), per_cell, k + 1, metric)


def _sampled(c: DataFrame, n: int, d: int, rows: int) -> np.ndarray:
    """About ``rows`` points, drawn by the hash of their key."""
    share = min(1.0, rows / n)
    draw = F.pmod(F.xxhash64("nid"), F.lit(1 << 30)) < F.lit(int(share * (1 << 30)))
    sample = (c.where(draw) if share < 1.0 else c).select("nvec")
    drawn = sample.limit(2 * rows + 64).toArrow().column(0).combine_chunks()
    return kernel.matrix(drawn) if len(drawn) else np.empty((0, d))
