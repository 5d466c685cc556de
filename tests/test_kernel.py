import tracemalloc

import numpy as np
import pytest
from conftest import brute_force
from hypothesis import given, settings
from hypothesis import strategies as st

from counterpoise.operators import kernel


def found(q, c, k, metric, radius=None):
    out = {}
    for qi, ci, dist, rank in zip(*kernel.nearest(q, c, k, metric, radius)):
        out.setdefault(int(qi), []).append((int(ci), float(dist)))
        assert rank == len(out[int(qi)])
    return out


def check(q, c, k, metric):
    keep = kernel.at_most_k_copies(c, k)
    got = found(q, c[keep], k, metric)
    got = {i: [(int(keep[n]), d) for n, d in near] for i, near in got.items()}
    assert got == brute_force(list(enumerate(q)), list(enumerate(c)), k, metric)


@pytest.mark.parametrize("metric", ["euclidean", "manhattan"])
@pytest.mark.parametrize("k", [1, 3, 7])
@pytest.mark.parametrize("d", [1, 2, 5, 40])
def test_nearest_matches_brute_force(metric, k, d):
    rng = np.random.default_rng(d * 10 + k)
    check(rng.normal(size=(40, d)) * 100, rng.normal(size=(300, d)) * 100, k, metric)


@pytest.mark.parametrize("metric", ["euclidean", "manhattan"])
def test_ties_and_copies(metric):
    rng = np.random.default_rng(1)
    lattice = rng.integers(0, 4, size=(400, 2)).astype(float)
    check(lattice[:60], lattice, 5, metric)


def test_far_from_the_origin_stays_exact():
    rng = np.random.default_rng(2)
    points = 1e9 + rng.integers(0, 50, size=(300, 3)).astype(float) / 8
    check(points[:50], points, 4, "euclidean")


def test_extreme_values():
    points = np.array([[0.0], [1e200], [-1e200], [np.inf], [-np.inf], [5e-324], [1e-200], [3.0]])
    check(points, points, 3, "euclidean")
    check(points, points, 3, "manhattan")


def test_merge_of_local_lists():
    # Distances [1, 5] in one block and [2, 3] in another: the two nearest are 1 and 2.
    q = np.array([[0.0]])
    best = np.full((1, 2), np.inf, np.float32)
    for block in (np.array([[1.0], [5.0]]), np.array([[2.0], [3.0]])):
        qi, _, dist, rank = kernel.nearest(q, block, 2, "euclidean", best[:, -1])
        best = kernel.tighten(best, qi, dist, rank)
    assert best.tolist() == [[1.0, 2.0]]


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 2**32 - 1), st.integers(1, 3), st.integers(1, 4),
       st.sampled_from(["euclidean", "manhattan"]))
def test_cells_never_miss_a_neighbour(seed, d, k, metric):
    rng = np.random.default_rng(seed)
    points = np.round(rng.normal(size=(300, d)) * rng.choice([1, 30]), rng.integers(0, 3))
    cells = kernel.Cells.from_sample(points[rng.random(300) < 0.4], 2 * (k + 1), k + 1, metric)
    queries = np.concatenate([points[:40], rng.normal(size=(10, d)) * 50])
    home, radius = cells.home(points), cells.radius(queries, k)
    qi, reached, refined = cells.route(queries, k)
    assert (refined <= radius).all()
    radius = refined
    visited = set(zip(qi.tolist(), reached.tolist()))
    expected = brute_force(list(enumerate(queries)), list(enumerate(points)), k, metric)
    for query, near in expected.items():
        for candidate, dist in near:
            assert (query, home[candidate]) in visited
            assert dist <= radius[query]


def test_cells_of_identical_points():
    cells = kernel.Cells.from_sample(np.ones((50, 2)), 4, 2, "euclidean")
    assert cells.points.shape == (1, 1, 2)
    assert np.isinf(cells.radius(np.ones((3, 2)), 1)).all()


def test_pack_bounds_blocks():
    import pyarrow as pa

    cells = np.sort(np.random.default_rng(0).integers(0, 5, 1000)).astype(np.int32)
    x = np.random.default_rng(1).permutation(1000)
    rows = pa.RecordBatch.from_arrays(
        [pa.array(cells), pa.array(x), pa.array([[float(v), -v / 2] for v in x])],
        names=["cell", "x", "v"])
    blocks = [(b.column("cell")[i].as_py(), [r["x"] for r in b.column("rows")[i].as_py()])
              for b in kernel.pack([rows.slice(i, 90) for i in range(0, 1000, 90)], 64, "v", "x")
              for i in range(b.num_rows)]
    assert max(len(xs) for _, xs in blocks) <= 64
    assert sorted(v for _, xs in blocks for v in xs) == list(range(1000))
    assert all(xs == sorted(xs) for _, xs in blocks)
    of = dict(zip(x.tolist(), cells.tolist()))
    assert all(of[v] == cell for cell, xs in blocks for v in xs)
    assert len(blocks) <= 5 + 1000 // 64


@pytest.mark.parametrize("k", [1, 4])
def test_candidates_laid_out_in_cells(k):
    rng = np.random.default_rng(k)
    points = rng.normal(size=(900, 3)).round(1)
    order = kernel.at_most_k_copies(points, k)
    cells = kernel.Cells.from_sample(points[::7], 2 * (k + 1), k + 1, "euclidean")
    home = cells.home(points[order])
    order = order[np.argsort(home, kind="stable")]
    starts = np.searchsorted(np.sort(home), np.arange(len(cells.points) + 1))
    got = {}
    for qi, ci, dist, _ in zip(*kernel.nearest_in_cells(
            points, points[order], cells, starts, order, k, "euclidean")):
        got.setdefault(int(qi), []).append((int(order[ci]), float(dist)))
    rows = list(enumerate(points))
    assert got == brute_force(rows, rows, k)


def test_copies_among_queries_are_searched_once():
    rng = np.random.default_rng(3)
    points = rng.integers(0, 5, size=(200, 2)).astype(float)
    sizes = []

    def search(asked):
        sizes.append(len(asked))
        return kernel.nearest(asked, points[kernel.at_most_k_copies(points, 3)], 3, "euclidean")

    got, want = kernel.once_per_point(points, search), search(points)
    assert sizes == [25, 200]
    for a, b in zip(got, want):
        assert a.tolist() == b.tolist()


def test_routing_by_many_pivots_holds_little():
    rng = np.random.default_rng(8)
    pivots = rng.normal(size=(1024, 64))
    grid = kernel.Pivots("euclidean", pivots, rng.normal(size=(1024, 128, 64)), np.arange(1024) % 6)
    asked = rng.normal(size=(4096, 64))
    found = [grid.route(asked[at:at + 512], 5) for at in range(0, 4096, grid.routed_rows(4096))]
    whole = grid.route(asked, 5)
    assert grid.routed_rows(4096) == 512
    assert np.array_equal(np.concatenate([f[2] for f in found]), whole[2])
    assert sum(len(f[0]) for f in found) == len(whole[0])
    tracemalloc.start()
    grid.route(asked[:512], 5)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 40 << 20
