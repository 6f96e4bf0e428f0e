"""Lattice keys, near-duplicate vectors and graph search against brute force."""

import numpy as np
import pytest

from resaleworth.llm import graph_search, lattice, lattice_dedup

SCHEMA = "vec_id long, embedding array<double>, label string"
ODD = [None, [], [0.0] * 16, [float("nan")] * 16, [float("inf")] + [1.0] * 15, [None] + [1.0] * 15]


def test_lattice_point_is_the_nearest():
    rng = np.random.default_rng(1)
    x = rng.standard_normal((500, 8)) * 2
    point = lattice.nearest_e8(x)
    away = ((x - point) ** 2).sum(axis=1)
    assert len(lattice.roots()) == 240
    for root in lattice.roots():
        assert (((x - point - root) ** 2).sum(axis=1) >= away - 1e-9).all()


def groups(seed=3, dim=16):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(24):
        base = rng.standard_normal(dim)
        rows += [(base + rng.standard_normal(dim) * rng.choice([0.0, 0.1, 0.2])).tolist() for _ in range((1, 2, 4, 20)[i % 4])]
    rows += [rows[0], rows[0], [1.0, 2.0], [2.0, 4.0], *ODD]
    ids = rng.permutation(3 * len(rows))[: len(rows)].tolist()
    return list(zip(ids, rows, ["x"] * len(rows), strict=True))


def usable(v):
    return bool(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)


def expected_links(rows, least):
    good = [(i, np.array(v) / np.linalg.norm(v)) for i, v, _ in rows if usable(v)]
    links = {i: set() for i, _, _ in rows}
    for i, u in good:
        links[i] |= {j for j, w in good if i != j and len(u) == len(w) and u @ w >= least}
    return links


@pytest.mark.parametrize("block", [1024, 8])
def test_near_duplicates(spark, monkeypatch, block):
    monkeypatch.setattr(lattice_dedup, "BLOCK", block)
    rows = groups()
    links = expected_links(rows, 0.9)
    table = spark.createDataFrame(rows, SCHEMA).withColumnRenamed("label", "n_links").repartition(4)
    found = {r["vec_id"]: r for r in lattice_dedup.near_duplicates(table, tables=12).collect()}
    assert len(found) == len(rows)
    for i, linked in links.items():
        assert found[i]["n_links"] == len(linked)
        seen, todo = {i}, [i]
        while todo:
            new = links[todo.pop()] - seen
            seen |= new
            todo += new
        assert found[i]["component_id"] == min(seen)
        assert found[i]["kept"] == (min(seen) == i)


def test_near_duplicates_of_odd_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert lattice_dedup.near_duplicates(empty).collect() == []
    rows = [(None, [1.0, 0.0], "a"), (None, [1.0, 0.0], "a"), (1, [1.0, 0.0], "a"), (1, [1.0, 0.0], "a"), (2, None, "b")]
    found = lattice_dedup.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((r["vec_id"] or 0, r["n_links"], r["component_id"] or 0) for r in found) == [(0, 0, 0), (0, 0, 0), (1, 1, 1), (1, 1, 1), (2, 0, 2)]


@pytest.mark.parametrize("size", [10_000, 300])
def test_graph_search(spark, size):
    rng = np.random.default_rng(7)
    rows = [(i, (rng.standard_normal(12) * rng.choice([0.5, 1.0, 2.0])).tolist(), "x") for i in range(700)]
    rows += [(1000 + i, rows[0][1], "copy") for i in range(40)] + [(2000 + i, v, "odd") for i, v in enumerate(ODD)]
    table = spark.createDataFrame(rows, SCHEMA).repartition(3)
    found = graph_search.nearest_rows(table, lambda i: i % 20 == 0, k=20, shard_size=size)
    near = {}
    for r in found.collect():
        near.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    good = {i: np.array(v) for i, v, _ in rows if usable(v)}
    hits = 0
    queries = [i for i in good if i % 20 == 0]
    assert set(near) == set(queries)
    for q in queries:
        best = sorted((-(good[q] * v).sum(), i) for i, v in good.items() if i != q)[:20]
        got = sorted(near[q])
        assert [r for r, _, _ in got] == list(range(1, 21))
        assert all(abs(score - good[q] @ good[i]) < 1e-9 for _, i, score in got)
        assert got == sorted(got, key=lambda x: (-x[2], x[1]))
        hits += len({i for _, i in best} & {i for _, i, _ in got})
    assert hits >= 0.9 * 20 * len(queries)


def test_graph_search_of_few_rows(spark):
    assert graph_search.nearest_rows(spark.createDataFrame([], SCHEMA), lambda i: i % 20 == 0).collect() == []
    rows = [(0, [1.0, 0.0], "a"), (1, [0.0, 1.0], "b"), (2, [0.0, 1.0], "b"), (3, [1.0], "c"), (None, [1.0, 1.0], "d")]
    found = graph_search.nearest_rows(spark.createDataFrame(rows, SCHEMA), lambda i: i % 20 == 0).collect()
    assert [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in sorted(found, key=lambda r: r["rank"])] == [(0, 1, 1, 0.0), (0, 2, 2, 0.0)]


@pytest.mark.parametrize("kind", ["unit", "gaussian", "lengths", "clusters"])
def test_recall_of_a_full_shard(kind):
    """The query's own settings on one shard of 8,192 vectors of 64 components, against brute force."""
    rng = np.random.default_rng(1)
    points = rng.standard_normal((8192, 64))
    if kind == "unit":
        points /= np.linalg.norm(points, axis=1, keepdims=True)
    if kind == "lengths":
        points *= rng.uniform(0.5, 2, (8192, 1))
    if kind == "clusters":
        points = (points[rng.integers(0, 60, 8192)] + 0.3 * rng.standard_normal((8192, 64))) * rng.uniform(0.3, 3, (8192, 1))
    points = points[np.argsort(-(points * points).sum(axis=1), kind="stable")]
    asked = points[rng.choice(8192, 200, replace=False)]
    edges = graph_search.banded_edges(points, 24, 48, 1.2, 4)
    found, scores = graph_search.banded_search(points, edges, asked, 21, 64)
    exact = asked @ points.T
    best = np.argsort(-exact, axis=1)[:, :21]
    assert np.allclose(scores, np.take_along_axis(exact, found, axis=1))
    assert np.mean([len(set(a) & set(b)) / 21 for a, b in zip(best, found)]) >= 0.95


def test_bands_hold_like_lengths():
    lengths = np.sort(np.random.default_rng(2).lognormal(0, 1, 5000))[::-1]
    starts = graph_search.bands(lengths)
    sizes = np.diff([*starts, 5000])
    assert starts[0] == 0 and sizes.max() <= graph_search.BAND and (sizes[:-1] >= graph_search.LEAST).all()
    assert list(graph_search.bands(np.ones(3))) == [0] and list(graph_search.bands(np.ones(0))) == [0]


def test_equal_scores_across_shards(spark):
    """Rows of equal score, some of them exact copies, lie in different shards: ids decide."""
    rows = [(i, [1.0, float(i % 50) / 100, 0.0], "x") for i in range(1, 400)] + [(400, [1.0, 0.0, 0.0], "q")]
    found = graph_search.nearest_rows(spark.createDataFrame(rows, SCHEMA), lambda i: i == 400, k=20, shard_size=10)
    got = [(r["rank"], r["vec_id"], r["score"]) for r in sorted(found.collect(), key=lambda r: r["rank"])]
    assert got == [(n + 1, n + 1, 1.0) for n in range(20)]


def test_query_settings_find_pairs_at_the_threshold(spark):
    """Planted pairs of 64 components around cosine 0.9, with the settings of the query: hardly one above it is missed, none below found."""
    rng = np.random.default_rng(5)
    rows, above, below = [], 0, 0
    for i in range(1500):
        a, b = rng.standard_normal(64), rng.standard_normal(64)
        a /= np.linalg.norm(a)
        b -= (a @ b) * a
        cosine = rng.uniform(0.88, 0.92)
        b = cosine * a + np.sqrt(1 - cosine**2) * b / np.linalg.norm(b)
        above, below = above + (cosine >= 0.9), below + (cosine < 0.9)
        rows += [(2 * i, a.tolist(), "x"), (2 * i + 1, (b * rng.uniform(0.2, 5)).tolist(), "y")]
    good = {i: np.array(v) / np.linalg.norm(v) for i, v, _ in rows}
    found = lattice_dedup.near_duplicates(spark.createDataFrame(rows, SCHEMA), min_cosine=0.9).collect()
    linked = {r["vec_id"] // 2 for r in found if r["n_links"]}
    assert all(r["n_links"] <= 1 and (not r["n_links"] or good[r["vec_id"] // 2 * 2] @ good[r["vec_id"] // 2 * 2 + 1] >= 0.9 - 1e-12) for r in found)
    assert above > 600 and below > 600 and len(linked) >= 0.98 * above
