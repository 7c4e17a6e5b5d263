"""The inverted-cell index against brute force."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sievemill.operators import dedup, neighbours, similarity

SCHEMA = "id string, vector array<double>"


def _clusters(n=3000, centres=40, d=16, spread=0.35):
    draw = np.random.default_rng(5)
    x = draw.normal(size=(centres, d))[draw.integers(centres, size=n) * (draw.random(n) > 0.3)] + spread * draw.normal(size=(n, d))  # a third of all in one cluster
    x[7] = x[8]
    return x


def _brute(x, metric):
    if metric == "cosine":
        y = x / np.linalg.norm(x, axis=1, keepdims=True)
        s = y @ y.T
    else:
        s = 1 / (1 + np.maximum((x * x).sum(1)[:, None] + (x * x).sum(1)[None] - 2 * x @ x.T, 0))
    np.fill_diagonal(s, -np.inf)
    return s.max(axis=1)


@pytest.mark.parametrize("metric", ["proxy_l2sq", "cosine"])
def test_nearest_by_index(spark, metric):
    x = _clusters()
    want = _brute(x, metric)
    rows = spark.createDataFrame([(str(i), v.tolist()) for i, v in enumerate(x)] + [("none", None)], SCHEMA)
    index = neighbours.build(rows, metric)
    assert index.rows.count() == len(x) and len(index.centroids) == 54
    asked = rows.where("id = 'none' or id % 10 = 7")
    got = lambda **more: {r.id: r.similarity for r in neighbours.nearest(asked, index, **more).collect()}
    exact = got(exact=True, probes=1, block=500)
    assert len(exact) == 301 and exact.pop("none") == 0.0
    assert all(abs(s - want[int(i)]) < 1e-9 for i, s in exact.items())
    assert 1 <= neighbours.probes_for(rows, index, 0.5) <= neighbours.probes_for(rows, index, 0.99) <= 54
    probed = got()
    assert np.mean([abs(probed[i] - want[int(i)]) < 1e-9 for i in exact]) >= 0.9  # recall
    limit = float(np.median(want))
    told = got(at_least=limit)
    assert all((told[i] >= limit) == (s >= limit) and (s < limit or abs(told[i] - s) < 1e-9) for i, s in exact.items())


def test_index_edges(spark, tmp_path):
    path, none = str(tmp_path / "index"), spark.createDataFrame([], SCHEMA)
    neighbours.write_index(none, path, "s0")  # no vector, no centroids
    one = spark.createDataFrame([("a", [1.0, 0.0])], SCHEMA)
    for _ in range(2):
        neighbours.write_index(one, path, "s1")
    index = neighbours.read_index(spark, path)
    assert index.rows.count() == 1 and [r.similarity for r in neighbours.nearest(one, index).collect()] == [0.0]  # itself only
    neighbours.write_index(spark.createDataFrame([("b", [0.0, 0.0]), ("c", None), ("d", [1.0, 0.0])], SCHEMA), path, "s2")
    assert [r.similarity for r in neighbours.nearest(one, neighbours.read_index(spark, path), probes=1).collect()] == [1.0]
    first = neighbours.read_index(spark, path, spark.createDataFrame([("s1",)], "step string"))
    assert first.rows.count() == 1 and neighbours.nearest(none, first).count() == 0
    assert [r.similarity for r in neighbours.nearest(one, neighbours.VectorIndex(index.centroids, index.rows.where("id = 'x'"), index.metric)).collect()] == [0.0]
    with pytest.raises(Exception, match="matmul|shape|dimension"):
        neighbours.nearest(spark.createDataFrame([("z", [1.0, 2.0, 3.0])], SCHEMA), index).collect()


def test_dedup_by_index(spark):
    """Layer 2 against stored vectors is the same through an index of these."""
    x = _clusters(400, 40, 8, 0.3)
    rows = spark.createDataFrame([(i, None, v.tolist()) for i, v in enumerate(x[:150])], "ord long, text string, vector array<double>")
    stored = spark.createDataFrame([(str(i), v.tolist()) for i, v in enumerate(x[150:])], SCHEMA)
    plain, indexed = (sorted((r.ord, r.reason) for r in dedup.deduplicate(rows, metric="cosine", **how).collect()) for how in ({"stored_vectors": stored}, {"stored_index": neighbours.build(stored, "cosine")}))
    assert plain == indexed and len({r for _, r in plain}) == 2
    with pytest.raises(ValueError, match="index is by"):
        dedup.deduplicate(rows, stored_index=neighbours.build(stored, "cosine"))
    assert dedup.deduplicate(rows.where(F.col("ord") < 0), metric="cosine", stored_index=neighbours.build(stored, "cosine")).count() == 0


def test_rows_go_to_parts_of_cells():
    """A row travels once to each of about 16 parts of the cells, however many cells there are; a cell of more rows than a block stands alone."""
    even = pd.DataFrame({"cell": range(800), "n": 800})
    part = neighbours._parts(even, 65536)
    assert (np.diff(part) >= 0).all() and part[-1] + 1 <= similarity.SIDES + 1
    hot = neighbours._parts(pd.DataFrame({"cell": range(5), "n": [10, 90_000, 10, 10, 10]}), 65536)
    assert hot.tolist() == [0, 1, 2, 2, 2]


def test_exact_where_every_cell_is_looked_into(spark):
    """Vectors without clusters, so that no cell is ruled out: many cells in a part, many parts, blocks on both sides."""
    x = np.random.default_rng(3).normal(size=(2500, 24))
    rows = spark.createDataFrame([(str(i), v.tolist()) for i, v in enumerate(x)], SCHEMA)
    index, want = neighbours.build(rows, cells=200), _brute(x, "proxy_l2sq")
    got = {r.id: r.similarity for r in neighbours.nearest(rows, index, exact=True, block=700).collect()}
    assert len(got) == 2500 and all(abs(s - want[int(i)]) < 1e-9 for i, s in got.items())
    assert neighbours.nearest(rows.where("id = 'x'"), index, exact=True).count() == 0
