"""The multi-index against brute force."""

import numpy as np
import pytest

from foldspark.llm import multiindex


def brute(rows, threshold):
    """(n_links, component) by comparing all pairs."""
    def unit(v):
        if v is None or not len(v) or any(x is None or not np.isfinite(x) for x in v) or not any(v):
            return None
        x = np.array(v, np.float32).astype(float)
        x = x / np.abs(x).max()
        return x / np.sqrt((x * x).sum())

    units = [unit(v) if label is not None else None for _, v, label in rows]
    n = len(rows)
    links, label = [0] * n, list(range(n))
    for i in range(n):
        for j in range(n):
            a, b = units[i], units[j]
            if i != j and a is not None and b is not None and rows[i][2] == rows[j][2] and len(a) == len(b) and a @ b >= threshold:
                links[i] += 1
                x, y = label[i], label[j]
                label = [min(x, y) if z in (x, y) else z for z in label]
    least = {}
    for (vec, _, _), x in zip(rows, label):
        if vec is not None:
            least[x] = min(least.get(x, vec), vec)
    return [(r[0], k, least.get(x)) for r, k, x in zip(rows, links, label)]


@pytest.mark.parametrize("crowded", [False, True])
def test_links_and_components(spark, monkeypatch, crowded):
    rng = np.random.default_rng(5)
    rows = []
    for i in range(600):
        v = rng.standard_normal(16)
        if i % 3 == 0 and i:
            v = np.array(rows[rng.integers(0, i)][1]) + 0.12 * rng.standard_normal(16)
        rows.append((i, [float(np.float32(x)) for x in v], int(i % 2)))
    rows += [(700 + i, rows[3][1], rows[3][2]) for i in range(40)]
    if crowded:
        monkeypatch.setattr(multiindex, "BLOCK", 16)
        monkeypatch.setattr(multiindex, "VISITORS", 32)
    got = multiindex.vector_classes(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"), recall=0.999).collect()
    want = brute(rows, 0.93)
    found, there = sum(r.n_links for r in got), sum(w[1] for w in want)
    assert found <= there and found >= 0.99 * there
    if found == there:
        assert sorted((r.vec_id, r.n_links, r.component_id) for r in got) == sorted(want)
    assert all(r.kept == (r.vec_id == r.component_id) for r in got)


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, None, 1), (2, [], 1), (3, [0.0, 0.0], 1), (4, [nan, 1.0], 1), (5, [inf, 1.0], 1), (6, [None, 1.0], 1), (7, [1.0, 0.0], None),
            (8, [1.0, 0.0], 1), (9, [1.0, 0.0], 1), (9, [1.0, 0.0], 1), (None, [2.0, 0.0], 1), (10, [1.0, 0.0, 0.0], 1), (11, [1.0, 0.0], 2),
            (12, [1e-38, 0.0], 1), (13, [1e38, 1e30], 1)]
    got = multiindex.vector_classes(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()
    want = brute(rows, 0.93)
    assert sorted(map(str, ((r.vec_id, r.n_links, r.component_id) for r in got))) == sorted(map(str, want))
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert multiindex.vector_classes(empty).count() == 0


def test_doubles_are_judged_as_doubles(spark):
    x = float(np.sqrt(1 - 0.93 ** 2))
    rows = [(1, [1.0, 0.0], 1), (2, [0.93 + 1e-9, x], 1), (3, [0.93 - 1e-9, -x], 1)]
    got = multiindex.vector_classes(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    assert {r.vec_id: r.n_links for r in got} == {1: 1, 2: 1, 3: 0}


def test_a_crowd_lists_no_pairs(spark):
    rng = np.random.default_rng(8)
    base = rng.standard_normal(32)
    rows = [(i, [float(x) for x in base + 0.01 * rng.standard_normal(32)], 1) for i in range(1500)]
    nodes = spark.createDataFrame([(i, 1, 1, v) for i, v, _ in rows], "node long, label long, copies long, embedding array<float>")
    assert multiindex.vector_links(nodes).count() < 40 * 1500
    got = multiindex.vector_classes(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()
    assert {(r.n_links, r.component_id) for r in got} == {(1499, 0)}


def test_forests_span_and_visits_follow_the_order():
    rng = np.random.default_rng(9)
    for _ in range(30):
        near = rng.random((12, 9)) < 0.12
        rows, columns = np.arange(12), np.concatenate([np.arange(100, 106), np.arange(3)])
        near &= rows[:, None] != columns[None]
        links = multiindex.forest(near, rows, columns)
        every = [(int(rows[i]), int(columns[j])) for i, j in zip(*np.nonzero(near))]

        def groups(pairs):
            label = {x: x for x in [*rows.tolist(), *columns.tolist()]}
            for a, b in pairs:
                x, y = label[a], label[b]
                label = {k: min(x, y) if v in (x, y) else v for k, v in label.items()}
            return label

        assert groups(links) == groups(every) and len(links) == len(label_set(groups([]))) - len(label_set(groups(every)))
    x = multiindex.normal(rng.standard_normal((300, 8)))
    books = (multiindex.codebook(x[:, :4], 6), multiindex.codebook(x[:, 4:], 6))
    visits = multiindex.needed_visits(x, books, 0.93, 0.95)
    away = np.random.default_rng(11).standard_normal(x.shape)
    away -= (away * x).sum(axis=1, keepdims=True) * x
    moved = 0.93 * x + np.sqrt(1 - 0.93 ** 2) * multiindex.normal(away)
    target = multiindex.cells_in_order(moved, books, 1)
    share = lambda n: (multiindex.cells_in_order(x, books, n) == target).any(axis=1).mean()
    assert share(visits) >= 0.95 and (visits == 1 or share(visits - 1) <= 0.96)


def label_set(groups):
    return set(groups.values())


def test_the_walk_is_in_order_of_distance():
    rng = np.random.default_rng(3)
    x, books = rng.standard_normal((20, 8)), (rng.standard_normal((9, 4)), rng.standard_normal((9, 4)))
    full = multiindex.cells_in_order(x, books, 81)
    for visits in (1, 5, 30):
        assert (multiindex.cells_in_order(x, books, visits) == full[:, :visits]).all()
