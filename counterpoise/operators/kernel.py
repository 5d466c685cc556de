"""Array work done inside neighbour tasks: distances, top-k, cell lookup, packing.

Plain numpy and Arrow helpers over one bounded block at a time; all data movement is
done by Spark in ``neighbors.py``.
"""

from __future__ import annotations

import pickle
import sys
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle

# Executors need not have this package installed for the tasks below to run there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

TILE = 1 << 18  # distances held at once per task
# Largest sums that still round to a 32-bit distance of zero.
ZERO_SQUARE = 2.0**-300 * (1 + 2.0**-52)
ZERO_SUM = 2.0**-150
# Pivots whose distances travel with a row.
NEAR_PIVOTS = 16
# A bound of the relative error of distances of up to some million features.
ROUNDING = 2.0**-30
# Bits of a cell's number that tell the finer cells of one cell apart.
FINER_BITS = 24


def matrix(column: pa.Array) -> np.ndarray:
    """A list<double> Arrow column as an (n, d) array."""
    if not len(column):
        return np.empty((0, 0))
    widths = column.value_lengths().to_numpy(zero_copy_only=False)
    if (widths != widths[0]).any():
        raise ValueError("feature vectors differ in length")
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def floor_of(metric: str) -> float:
    """Raw sums up to this are a rounded distance of zero."""
    return ZERO_SUM if metric == "manhattan" else ZERO_SQUARE


def raw_distance(gaps, metric: str) -> np.ndarray:
    """Squared (euclidean) or plain (manhattan) sum of gaps, added in feature order."""
    total = None
    # Infinite features give undefined or infinite sums on purpose.
    with np.errstate(invalid="ignore", over="ignore"):
        for gap in gaps:
            term = np.abs(gap, out=gap) if metric == "manhattan" else np.square(gap, out=gap)
            total = term if total is None else np.add(total, term, out=total)
    return total


def rounded(raw: np.ndarray, metric: str) -> np.ndarray:
    with np.errstate(over="ignore", invalid="ignore"):
        return (raw if metric == "manhattan" else np.sqrt(raw)).astype(np.float32)


def raw_bound(radius: np.ndarray, metric: str) -> np.ndarray:
    """A raw sum that no candidate within the rounded ``radius`` exceeds."""
    with np.errstate(over="ignore"):
        above = np.nextafter(radius.astype(np.float32), np.float32(np.inf)).astype(np.float64)
        return above if metric == "manhattan" else above * above


def kth_smallest(raw: np.ndarray, k: int) -> np.ndarray:
    """Per row the k-th smallest entry; infinity where there are fewer than k."""
    if raw.shape[1] < k:
        return np.full(len(raw), np.inf)
    kth = np.partition(raw, k - 1, axis=1)[:, k - 1]
    return np.where(np.isnan(kth), np.inf, kth)


def rough_distances(q: np.ndarray, c: np.ndarray, norms: np.ndarray, metric: str):
    """Raw distances up to a slack, less a shift per query: (rough, shift, slack).

    Squared distances come from one matrix product, whose rounding error the slack
    covers; they only decide which pairs are looked at exactly.
    """
    if metric == "euclidean":
        own = np.einsum("ij,ij->i", q, q)
        slack = 2.0**-50 * (q.shape[1] + 8) * (own + norms.max())
        if np.isfinite(slack).all():
            rough = q @ (-2.0 * c.T)
            rough += norms
            return rough, own, slack
    with np.errstate(invalid="ignore", over="ignore"):
        rough = raw_distance((q[:, j, None] - c[None, :, j] for j in range(q.shape[1])), metric)
    return rough, np.zeros(len(q)), np.zeros(len(q))


def _ranked(part: np.ndarray, columns: np.ndarray, close: np.ndarray, k: int, metric: str,
            radius: np.ndarray | None):
    """The k nearest of the ``close`` candidates of every query, distances taken exactly."""
    qi, ci = np.divmod(np.flatnonzero(close), columns.shape[1])
    own = np.ascontiguousarray(part.T)
    with np.errstate(invalid="ignore", over="ignore"):
        raw = raw_distance((x[qi] - y[ci] for x, y in zip(own, columns)), metric)
    valid = raw > floor_of(metric)
    dist = rounded(raw, metric)
    if radius is not None:
        valid &= dist <= radius[qi]
    qi, ci, dist = qi[valid], ci[valid], dist[valid]
    order = np.lexsort((dist, qi))  # stable: equal distances stay in key order
    qi, ci, dist = qi[order], ci[order], dist[order]
    rank = np.arange(len(qi)) - np.searchsorted(qi, qi) + 1
    keep = rank <= k
    return qi[keep], ci[keep], dist[keep], rank[keep]


def nearest(q: np.ndarray, c: np.ndarray, k: int, metric: str, radius: np.ndarray | None = None):
    """Top k candidates of every query by (rounded distance, candidate position).

    ``c`` must be in key order, so that positions break ties like keys do, and hold no
    point more than k times. ``radius`` optionally gives a rounded distance per query
    beyond which nothing can count.
    Returns (query position, candidate position, distance, rank from 1).
    """
    if len(q) and len(c) and q.shape[1] != c.shape[1]:
        raise ValueError("query and candidate vectors differ in length")
    found = []
    step = max(1, TILE // max(1, len(c)))
    # Of the 2k nearest points at most k are copies of the query itself, so the 2k-th
    # distance, even among a part of the candidates, bounds the k-th true neighbour, unless
    # other points lie so near that their distance rounds to zero. Queries left with fewer
    # than k neighbours are therefore searched once more without that bound. Wide points
    # are dear to look at exactly, so there all candidates are asked.
    stride = max(1, min(8, len(c) // max(256, 16 * k))) if q.shape[-1] <= 16 else 1
    columns = np.ascontiguousarray(c.T)
    with np.errstate(over="ignore"):
        norms = np.einsum("ij,ij->i", c, c) if len(c) else np.empty(0)
    for start in range(0, len(q) if len(c) else 0, step):
        part = q[start:start + step]
        with np.errstate(over="ignore", invalid="ignore"):
            rough, shift, slack = rough_distances(part, c, norms, metric)
            bound = kth_smallest(rough[:, ::stride], 2 * k) + shift + slack
            bound = raw_bound(rounded(np.maximum(bound, 0.0), metric), metric)
            own = None if radius is None else radius[start:start + step]
            limit = np.full(len(part), np.inf) if own is None else raw_bound(own, metric)
            close = rough <= (np.minimum(bound, limit) + slack - shift)[:, None]
        qi, ci, dist, rank = _ranked(part, columns, close, k, metric, own)
        short = (np.bincount(qi, minlength=len(part)) < k) & (bound < limit)
        if short.any():
            rows = np.flatnonzero(short)
            with np.errstate(invalid="ignore"):
                close = rough[rows] <= (limit + slack - shift)[rows, None]
            again = _ranked(part[rows], columns, close, k, metric, own if own is None else own[rows])
            rest = ~short[qi]
            qi, ci, dist, rank = (np.concatenate([x[rest], y]) for x, y in zip(
                (qi, ci, dist, rank), (rows[again[0]], *again[1:])))
            order = np.lexsort((rank, qi))
            qi, ci, dist, rank = qi[order], ci[order], dist[order], rank[order]
        found.append((qi + start, ci, dist, rank.astype(np.int32)))
    if not found:
        return (np.empty(0, np.int64), np.empty(0, np.int64),
                np.empty(0, np.float32), np.empty(0, np.int32))
    return tuple(np.concatenate(part) for part in zip(*found))


def group_copies(points: np.ndarray):
    """Rows sorted by point, copies in their order, and where each distinct point begins."""
    order = np.lexsort(points.T)
    by_point = points[order]
    new = np.r_[True, (by_point[1:] != by_point[:-1]).any(axis=1)]
    return order, np.flatnonzero(new), np.cumsum(new) - 1


def at_most_k_copies(points: np.ndarray, k: int) -> np.ndarray:
    """Positions of the first k rows of every distinct point, in order."""
    if not len(points):
        return np.empty(0, np.int64)
    order, starts, group = group_copies(points)
    rank = np.arange(len(order)) - starts[group]
    return np.sort(order[rank < k])


def once_per_point(q: np.ndarray, search):
    """Run ``search`` on the distinct query points and give every copy its result."""
    if not len(q):
        return search(q)
    order, starts, group = group_copies(q)
    if len(starts) == len(q):
        return search(q)
    near, ci, dist, rank = search(q[order[starts]])
    first = np.searchsorted(near, np.arange(len(starts) + 1))
    which = np.empty(len(q), np.int64)
    which[order] = group
    size = np.diff(first)[which]
    qi = np.repeat(np.arange(len(q)), size)
    at = np.arange(len(qi)) - np.repeat(np.cumsum(size) - size, size) + first[which[qi]]
    return qi, ci[at], dist[at], rank[at]


def best_cut(part: np.ndarray, per_cell: int, min_cell: int):
    """Median cut of the widest feature that leaves enough points on both sides."""
    if len(part) <= per_cell:
        return -1, 0.0
    with np.errstate(invalid="ignore"):
        spread = np.nan_to_num(part.max(axis=0) - part.min(axis=0), nan=0.0)
    for axis in np.argsort(-spread):
        values = np.sort(part[:, axis])
        at = values[(len(values) - 1) // 2]
        below = np.searchsorted(values, at, side="right")
        if len(values) - below < min_cell:  # ties reach up: cut under them instead
            under = np.searchsorted(values, at, side="left")
            at, below = (values[under - 1], under) if under else (at, len(values))
        if min_cell <= below <= len(values) - min_cell and np.isfinite(at):
            return int(axis), float(at)
    return -1, 0.0


@dataclass
class Cells:
    """Axis-parallel cells cut from a bounded sample of candidate points.

    Cells only decide which task compares which rows. Each cell keeps its sample points
    (real candidates), which give every query a radius that surely holds k neighbours.
    The fields are plain arrays so that they can be broadcast as they are.
    """

    metric: str
    dim: np.ndarray     # per node: feature it is cut on
    cut: np.ndarray     # per node: value it is cut at, left side inclusive
    child: np.ndarray   # per node: left and right node
    leaf: np.ndarray    # per node: cell number, or -1
    low: np.ndarray     # per node: lower corner
    high: np.ndarray    # per node: upper corner
    points: np.ndarray  # per cell: its sample points, padded with NaN

    @classmethod
    def from_sample(cls, sample: np.ndarray, per_cell: int, min_cell: int, metric: str) -> Cells:
        points = np.unique(sample, axis=0)
        d = points.shape[1]
        dim, cut, child, low, high, leaf, groups = [], [], [], [], [], [], []
        todo = [(points, np.full(d, -np.inf), np.full(d, np.inf), None)]
        while todo:
            part, lo, hi, parent = todo.pop()
            node = len(dim)
            if parent is not None:
                child[parent[0]][parent[1]] = node
            axis, at = best_cut(part, per_cell, min_cell)
            dim.append(max(axis, 0))
            cut.append(at)
            child.append([node, node])
            low.append(lo)
            high.append(hi)
            if axis < 0:
                leaf.append(len(groups))
                groups.append(part)
                continue
            leaf.append(-1)
            below = part[:, axis] <= at
            hi_left, lo_right = hi.copy(), lo.copy()
            hi_left[axis] = lo_right[axis] = at
            todo.append((part[below], lo, hi_left, (node, 0)))
            todo.append((part[~below], lo_right, hi, (node, 1)))
        padded = np.full((len(groups), max(len(g) for g in groups), d), np.nan)
        for i, group in enumerate(groups):
            padded[i, :len(group)] = group
        return cls(metric, np.array(dim), np.array(cut), np.array(child), np.array(leaf),
                   np.array(low), np.array(high), padded)

    def routed_rows(self, rows: int) -> int:
        """Rows of one call, ``rows`` at most."""
        return rows

    def home(self, q: np.ndarray) -> np.ndarray:
        node = np.zeros(len(q), np.int64)
        rows = np.arange(len(q))
        while len(q) and (self.leaf[node] < 0).any():
            right = q[rows, self.dim[node]] > self.cut[node]
            node = self.child[node, right.astype(np.int64)]
        return self.leaf[node]

    def place(self, q: np.ndarray, home: np.ndarray) -> np.ndarray:
        """A number by which rows of a cell that lie together get close numbers.

        Per feature the row's rank among the cell's sample points; the ranks' bits are
        interleaved. It only orders rows, so that blocks of them are compact.
        """
        d = q.shape[1]
        out = np.zeros(len(q), np.int64)
        step = max(1, TILE // max(1, self.points.shape[1]))
        for start in range(0, len(q) if d <= 8 else 0, step):
            part = slice(start, start + step)
            code = np.zeros(len(out[part]), np.int64)
            with np.errstate(invalid="ignore"):
                rank = np.stack([(self.points[home[part], :, j] < q[part, j, None]).sum(1)
                                 for j in range(d)], 1)
            rank = np.minimum(rank, 63)
            for bit in range(5, -1, -1):
                for j in range(d):
                    code = code << 1 | rank[:, j] >> bit & 1
            out[part] = code
        return out

    def radius(self, q: np.ndarray, k: int) -> np.ndarray:
        """Rounded distance within which each query has k neighbours among the sample."""
        out = np.empty(len(q), np.float32)
        home = self.home(q)
        step = max(1, TILE // max(1, self.points.shape[1]))
        for start in range(0, len(q), step):
            part = slice(start, start + step)
            near = self.points[home[part]]
            with np.errstate(invalid="ignore", over="ignore"):
                total = raw_distance((q[part, j, None] - near[:, :, j]
                                      for j in range(q.shape[1])), self.metric)
            total[total <= floor_of(self.metric)] = np.nan
            out[part] = rounded(kth_smallest(total, k), self.metric)
        return out

    def _gaps(self, q, qi, node):
        """Per feature, how far each query lies outside the slab of a node."""
        with np.errstate(invalid="ignore"):
            for j in range(q.shape[1]):
                x = q[qi, j]
                gap = np.maximum(self.low[node, j] - x, x - self.high[node, j])
                yield np.where(gap > 0, gap, 0.0)  # inside, or undefined

    def reached(self, q: np.ndarray, radius: np.ndarray):
        """All (query, cell) pairs whose cell may hold a row within the query's radius.

        The gap to a cell is summed in the same order as a distance, and rounding is
        monotone, so no row inside the cell can be nearer than the gap says.
        Returns (query position, cell, rounded gap).
        """
        qi = np.arange(len(q))
        node, gap = np.zeros(len(q), np.int64), np.zeros(len(q), np.float32)
        done = []
        while len(qi):
            ends = self.leaf[node] >= 0
            done.append((qi[ends], self.leaf[node[ends]], gap[ends]))
            qi, node = np.repeat(qi[~ends], 2), self.child[node[~ends]].reshape(-1)
            gap = rounded(raw_distance(self._gaps(q, qi, node), self.metric), self.metric)
            inside = gap <= radius[qi]
            qi, node, gap = qi[inside], node[inside], gap[inside]
        return tuple(np.concatenate(part) for part in zip(*done))

    def route(self, q: np.ndarray, k: int, refine: bool = True):
        """Which cells each query must visit: (query position, cell, radius per query).

        The home cell's sample gives a first radius; with ``refine`` the samples of the
        cells within it then give the k-th nearest sample point of all, which is tighter.
        """
        radius = self.radius(q, k)
        qi, cell, gap = self.reached(q, radius)
        if not refine:
            return qi, cell, radius
        order = np.argsort(qi, kind="stable")
        qi, cell, gap = qi[order], cell[order], gap[order]
        near = [np.empty((0, k), np.float32)]
        step = max(1, TILE // max(1, self.points.shape[1]))
        for start in range(0, len(qi), step):
            part = slice(start, start + step)
            points = self.points[cell[part]]
            with np.errstate(invalid="ignore", over="ignore"):
                raw = raw_distance((q[qi[part], j, None] - points[:, :, j]
                                    for j in range(q.shape[1])), self.metric)
            raw[~(raw > floor_of(self.metric))] = np.inf
            width = min(k, raw.shape[1])
            dist = rounded(np.partition(raw, width - 1, axis=1)[:, :width], self.metric)
            near.append(np.pad(dist, ((0, 0), (0, k - width)), constant_values=np.inf))
        dist = np.concatenate(near).ravel()
        owner = np.repeat(qi, k)
        order = np.lexsort((dist, owner))
        owner, dist = owner[order], dist[order]
        kth = np.searchsorted(owner, np.arange(len(q))) + k - 1
        radius = np.minimum(radius, dist[kth])
        keep = gap <= radius[qi]
        return qi[keep], cell[keep], radius


@dataclass
class Pivots:
    """Cells around pivots, for points too wide for axis-parallel cells.

    Pivots are sample points far from one another; a point belongs to its nearest pivot,
    and pivots that lie together to one cell. Distances from pivots bound distances between
    points by the triangle inequality. Each pivot keeps some of its sample points, real
    candidates, for radii.
    """

    metric: str
    pivots: np.ndarray  # (pivot, feature)
    points: np.ndarray  # per pivot: its sample points, padded with NaN
    cell: np.ndarray    # per pivot: its cell

    @classmethod
    def from_sample(cls, sample: np.ndarray, wanted: int, cells: int, per_cell: int,
                    metric: str) -> Pivots:
        def away(q, pivots):
            return cls(metric, pivots, pivots[:0], pivots[:0]).distances(q)

        points = np.unique(sample, axis=0)
        if not len(points):
            return cls(metric, np.zeros((1, sample.shape[1])), np.full((1, 1, sample.shape[1]), np.nan),
                       np.zeros(1, np.int64))
        finite = points[np.isfinite(points).all(axis=1)]
        chosen = (finite if len(finite) else points)[:1]
        apart = away(finite, chosen)[:, 0]
        while len(chosen) < wanted and len(apart) and apart.max() > 0:
            chosen = np.concatenate([chosen, finite[[apart.argmax()]]])
            apart = np.minimum(apart, away(finite, chosen[-1:])[:, 0])
        home = away(points, chosen).argmin(axis=1)
        groups = [points[home == p] for p in range(len(chosen))]
        groups = [g[np.linspace(0, len(g) - 1, min(len(g), per_cell)).astype(int)] for g in groups]
        padded = np.full((len(groups), max(1, *map(len, groups), 1), points.shape[1]), np.nan)
        for i, group in enumerate(groups):
            padded[i, :len(group)] = group
        # The first pivots are the furthest apart: each is the middle of a cell.
        return cls(metric, chosen, padded, away(chosen, chosen[:cells]).argmin(axis=1))

    def routed_rows(self, rows: int) -> int:
        """Rows of one call, ``rows`` at most, whose distances from all pivots are bounded."""
        return max(1, min(rows, 2 * TILE // len(self.pivots)))

    def distances(self, q: np.ndarray) -> np.ndarray:
        """Distance of every point from every pivot; infinite where it is undefined."""
        out = np.empty((len(q), len(self.pivots)))
        step = max(1, TILE // max(1, len(self.pivots)))
        for start in range(0, len(q), step):
            part = slice(start, start + step)
            raw = raw_distance((q[part, j, None] - self.pivots[None, :, j]
                                for j in range(q.shape[1])), self.metric)
            out[part] = raw if self.metric == "manhattan" else np.sqrt(raw)
        out[np.isnan(out)] = np.inf
        return out

    def house(self, q: np.ndarray):
        """(cell, place, near): near are the distances from the first pivots, place brings
        rows at about the same distance from the same pivot together."""
        away = self.distances(q)
        home = away.argmin(axis=1)
        own = away[np.arange(len(q)), home].astype(np.float32)
        place = home << 32 | own.view(np.int32).astype(np.int64)
        return self.cell[home], place, away[:, :NEAR_PIVOTS]

    def route(self, q: np.ndarray, k: int):
        """(query position, cell, radius per query, place per query, near per query).

        A point of a pivot is no further from its own pivot than from the query's, so it is
        at least half as far from the query as the two pivots are apart, seen from there.
        """
        away = self.distances(q)
        home = away.argmin(axis=1)
        own = away[np.arange(len(q)), home]
        radius = np.empty(len(q), np.float32)
        step = max(1, 4 * TILE // max(1, self.points[0].size))  # sample points of a query are copied
        for start in range(0, len(q), step):
            part = slice(start, start + step)
            near = self.points[home[part]]
            with np.errstate(invalid="ignore", over="ignore"):
                total = raw_distance((q[part, j, None] - near[:, :, j]
                                      for j in range(q.shape[1])), self.metric)
            total[total <= floor_of(self.metric)] = np.nan
            radius[part] = rounded(kth_smallest(total, k), self.metric)
        with np.errstate(invalid="ignore"):
            gap = (away - own[:, None]) / 2
            meets = ~(gap > loose(radius, own)[:, None] + ROUNDING * away)
        turn = np.argsort(self.cell, kind="stable")
        first = np.flatnonzero(np.diff(self.cell[turn], prepend=-1))
        qi, cell = np.nonzero(np.logical_or.reduceat(meets[:, turn], first, axis=1))
        return qi, self.cell[turn][first][cell], radius, home << 32, away[:, :NEAR_PIVOTS]


def loose(radius: np.ndarray, size: np.ndarray) -> np.ndarray:
    """``radius``, a rounded distance, and what sums of about ``size`` may be wrong by."""
    return radius.astype(np.float64) * (1 + 2.0**-20) + ROUNDING * size


def beyond_pivots(near: np.ndarray, low: np.ndarray, high: np.ndarray,
                  radius: np.ndarray) -> np.ndarray:
    """Whether queries (``near``: distances from pivots) have no candidate within ``radius``
    in a block whose distances from the pivots lie between ``low`` and ``high``."""
    with np.errstate(invalid="ignore"):
        gap = np.maximum(low - near, near - high)
        return (gap > loose(radius, high.max())[:, None] + ROUNDING * near).any(axis=1)


def cut_cells(points: np.ndarray, per_cell: int, min_cell: int, metric: str) -> bytes:
    """Cells of a sample, as bytes that travel in a row."""
    return pickle.dumps(vars(Cells.from_sample(points, per_cell, min_cell, metric)))


def cut_again(batches, rows: str, vector: str, k: int):
    """Rows of packed blocks (cell, rows, grid) in the finer cells of their cell's grid.

    A row with a ``radius`` goes to every finer cell within it, the radius made smaller
    where the grid's own sample allows.
    """
    for batch in batches:
        for i in range(batch.num_rows):
            grid = Cells(**pickle.loads(batch.column("grid")[i].as_py()))
            block = pa.RecordBatch.from_struct_array(batch.column(rows)[i].values)
            points = matrix(block.column(vector))
            if "radius" in block.schema.names:
                radius = block.column("radius").to_numpy(zero_copy_only=False)
                radius = np.minimum(radius, grid.radius(points, k))
                at, sub, _ = grid.reached(points, radius)
                block = block.set_column(
                    block.schema.get_field_index("radius"), "radius", pa.array(radius, pa.float32()))
                block = block.take(pa.array(at))
            else:
                at, sub = np.arange(len(points)), grid.home(points)
            cell = (batch.column("cell")[i].as_py() << FINER_BITS) + sub
            yield pa.RecordBatch.from_arrays(
                [pa.array(cell), pa.array(grid.place(points[at], sub)), *block.columns],
                names=["cell", "place", *block.schema.names])


def nearest_in_cells(q: np.ndarray, c: np.ndarray, cells: Cells, starts: np.ndarray,
                     order: np.ndarray, k: int, metric: str):
    """``nearest`` over candidates laid out cell by cell.

    ``starts`` says where each cell's rows begin in ``c``, and ``order`` gives every row's
    place in key order; rows of a cell are in key order.
    """
    qi, cell, radius = cells.route(q, k)
    by_cell = np.argsort(cell, kind="stable")
    qi, cell = qi[by_cell], cell[by_cell]
    cuts = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]]) if len(cell) else []
    found = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.float32))]
    for first, end in zip(cuts, np.r_[cuts[1:], len(cell)]):
        asked, at = qi[first:end], cell[first]
        near, ci, dist, _ = nearest(q[asked], c[starts[at]:starts[at + 1]], k, metric,
                                    radius[asked])
        found.append((asked[near], ci + starts[at], dist))
    qi, ci, dist = (np.concatenate(part) for part in zip(*found))
    best = np.lexsort((order[ci], dist, qi))
    qi, ci, dist = qi[best], ci[best], dist[best]
    rank = (np.arange(len(qi)) - np.searchsorted(qi, qi) + 1).astype(np.int32)
    keep = rank <= k
    return qi[keep], ci[keep], dist[keep], rank[keep]


def tighten(best: np.ndarray, qi: np.ndarray, dist: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Fold newly found distances into each query's k smallest so far."""
    new = np.full_like(best, np.inf)
    new[qi, rank - 1] = dist
    return np.sort(np.concatenate([best, new], axis=1), axis=1)[:, :best.shape[1]]


def larger(batches, rows: int, size: int):
    """Join small batches up to about ``rows`` rows or ``size`` bytes."""
    held, n, held_bytes = [], 0, 0
    for batch in batches:
        held.append(batch)
        n, held_bytes = n + batch.num_rows, held_bytes + batch.nbytes
        if n >= rows or held_bytes >= size:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held, n, held_bytes = [], 0, 0
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def outside(q: np.ndarray, low: np.ndarray, high: np.ndarray, metric: str) -> np.ndarray:
    """Rounded distance of every query from a box; no point in it can be nearer."""
    with np.errstate(invalid="ignore", over="ignore"):
        gaps = (np.maximum(np.maximum(low[j] - q[:, j], q[:, j] - high[j]), 0.0)
                for j in range(q.shape[1]))
        return rounded(raw_distance(gaps, metric), metric)


def pack(batches, block_rows: int, vector: str, order: str | None = None):
    """Turn rows sorted by cell into one row per (cell, block of at most ``block_rows``).

    A block comes with the box of its ``vector`` column and its largest ``radius``, if it
    has one; its rows are put in the order of the column ``order``.
    """
    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        if held is not None:
            batch = pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
        cells = batch.column("cell").to_numpy(zero_copy_only=False)
        starts = np.flatnonzero(np.r_[True, cells[1:] != cells[:-1]])
        ends = np.r_[starts[1:], len(cells)]
        cuts = np.concatenate([np.arange(s, e, block_rows) for s, e in zip(starts, ends)])
        held = batch.slice(cuts[-1])  # the last block may go on in the next batch
        if len(cuts) > 1:
            yield _blocks(batch.slice(0, cuts[-1]), cuts, vector, order)
    if held is not None:
        yield _blocks(held, np.array([0, held.num_rows]), vector, order)


def _blocks(batch: pa.RecordBatch, cuts: np.ndarray, vector: str,
            order: str | None) -> pa.RecordBatch:
    """Rows between consecutive cuts as one list each."""
    if order is not None:
        block = np.repeat(np.arange(len(cuts) - 1), np.diff(cuts))
        keys = pa.table({"block": block, "key": batch.column(order)})
        batch = batch.take(pc.sort_indices(
            keys, [("block", "ascending"), ("key", "ascending")]))
    points = matrix(batch.column(vector))
    low, high = (f.reduceat(points, cuts[:-1], axis=0) for f in (np.minimum, np.maximum))
    reach = np.zeros(len(cuts) - 1, np.float32)
    if "radius" in batch.schema.names:
        radius = batch.column("radius").to_numpy(zero_copy_only=False)
        reach = np.maximum.reduceat(radius, cuts[:-1]).astype(np.float32)
    fields = [f for f in batch.schema if f.name not in ("cell", "place")]
    rows = pa.StructArray.from_arrays([batch.column(f.name) for f in fields], fields=fields)
    return pa.RecordBatch.from_arrays(
        [batch.column("cell").take(pa.array(cuts[:-1])), lists(low), lists(high), pa.array(reach),
         pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), rows)],
        names=["cell", "low", "high", "reach", "rows"])


def lists(values: np.ndarray) -> pa.ListArray:
    n, d = values.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * d),
                                    pa.array(values.ravel()))


def side_by_side(left, li, right, ri, dist, rank, names) -> pa.RecordBatch:
    """Query and candidate rows side by side, in the order of ``names``."""
    made = {"dist": pa.array(dist), "rank": pa.array(rank)}
    columns = []
    for name in names:
        if name in made:
            columns.append(made[name])
        elif name in left.schema.names:
            columns.append(left.column(name).take(li))
        else:
            columns.append(right.column(name).take(ri))
    return pa.RecordBatch.from_arrays(columns, names=list(names))
