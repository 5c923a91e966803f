"""Similar vectors against comparing all pairs."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from dosegrid.llm import embeddings
from dosegrid.llm.embeddings import principal_axes, similar_vectors

COLUMNS = ["vec_id", "n_links", "component_id", "kept"]


def usable(v):
    return v is not None and len(v) and all(x is not None and math.isfinite(x) for x in v) and any(v)


def plain(rows, threshold=0.95):
    n = len(rows)
    good = [i for i, (k, v) in enumerate(rows) if k is not None and usable(v)]
    links = {i: set() for i in range(n)}
    for x, i in enumerate(good):
        for j in good[:x]:
            u, v = (np.array(rows[k][1], float) for k in (i, j))
            if len(u) == len(v):
                u, v = u / abs(u).max(), v / abs(v).max()
                if u @ v / (np.linalg.norm(u) * np.linalg.norm(v)) >= threshold:
                    links[i].add(j)
                    links[j].add(i)
    label = list(range(n))
    for start in range(n):
        queue = [start]
        while queue:
            i = queue.pop()
            for j in links[i]:
                if label[j] != label[start]:
                    label[j] = label[start]
                    queue.append(j)
    out = []
    for i, (k, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(n) if label[j] == label[i]]
        least = min(ids) if k is not None else None
        out.append((k, len(links[i]), least, k == least if k is not None else True))
    return sorted(out, key=str)


def got(df):
    return sorted((tuple(r[c] for c in COLUMNS) for r in df.collect()), key=str)


def frame(spark, rows, kind="float", parts=3):
    return spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>").repartition(parts)


def clustered(seed, n=240, d=12, spread=0.12, groups=30):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((groups, d))
    vectors = centres[rng.integers(0, groups, n)] + spread * rng.standard_normal((n, d))
    ids = rng.permutation(10 * n)[:n]
    return [(int(i), [float(np.float32(x)) for x in v]) for i, v in zip(ids, vectors)]


@pytest.mark.parametrize("seed", range(3))
@pytest.mark.parametrize("kind", ["float", "double"])
def test_random_groups(spark, seed, kind):
    rows = clustered(seed)
    out = similar_vectors(frame(spark, rows, kind), interval_bytes=640, leaf=4)
    assert got(out) == plain(rows)


def test_chains_copies_and_a_hot_vector(spark):
    rng = np.random.default_rng(1)
    steps = [(math.cos(t), math.sin(t)) for t in np.arange(0, 3, 0.3)]  # each links to the next one
    rows = [(i + 100, [x, y, 0.0]) for i, (x, y) in enumerate(steps)]
    rows += [(i + 500, [0.0, 0.0, -2.0]) for i in range(60)]
    rows += [(i + 700, [0.0, float(e), -3.0]) for i, e in enumerate(rng.normal(0, 0.05, 60))]
    rows += [(3, [1.0, 0.0, 0.0]), (9, [7.0, 0.0, 0.0]), (9, [-7.0, 0.0, 0.0]), (9, [-7.0, 0.0, 0.0])]
    for leaf in (2, 64):
        assert got(similar_vectors(frame(spark, rows), interval_bytes=120, leaf=leaf)) == plain(rows)


def test_nulls_and_odd_vectors(spark):
    rows = [
        (1, [1.0, 0.0]), (2, [1.0, -0.0]), (3, None), (4, []), (5, [0.0, 0.0]), (6, [1.0, None]),
        (7, [float("nan"), 1.0]), (8, [float("inf"), 1.0]), (None, [1.0, 0.0]), (9, [1.0, 0.0, 0.0]),
        (10, [2.0, 0.0, 0.0]), (11, [1e300, 0.0]), (12, [1e-300, 0.0]), (13, [5.0]), (14, [-5.0]), (15, [1.0]),
        (1, [0.0, 3.0]), (16, [0.0, 3.0]),
    ]
    assert got(similar_vectors(frame(spark, rows, "double"))) == plain(rows)


def test_at_the_threshold(spark):
    rows = [(1, [3.0, 4.0]), (2, [1.0, 0.0]), (3, [0.0, 1.0]), (4, [4.0, 3.0])]
    for threshold in (0.6, 0.8, 0.96):
        out = got(similar_vectors(frame(spark, rows, "double"), threshold))
        assert out == plain(rows, threshold)
    assert got(similar_vectors(frame(spark, rows, "double"), 0.96))[0][1] == 1


def test_without_broadcast(spark, no_broadcast):
    rows = clustered(7)
    assert got(similar_vectors(frame(spark, rows), interval_bytes=640, leaf=4)) == plain(rows)


def test_distant_intervals_are_skipped(spark, monkeypatch):
    rng = np.random.default_rng(2)
    rows = [(i, [math.cos(t), math.sin(t), 0.01]) for i, t in enumerate(rng.uniform(0, 6.28, 400))]
    kept = []
    near = embeddings.near_intervals
    monkeypatch.setattr(
        embeddings, "near_intervals", lambda *a: kept.append((near(*a), a[0].count())) or kept[-1][0]
    )
    similar_vectors(frame(spark, rows), interval_bytes=120)
    pairs, n = kept[0]
    assert n >= 40 and pairs.count() < 0.35 * n * (n + 1) / 2


def test_axes_are_principal(spark):
    rng = np.random.default_rng(0)
    base = np.linalg.qr(rng.standard_normal((20, 20)))[0]
    vectors = rng.standard_normal((500, 20)) * ([5, 4, 3] + [0.1] * 17) @ base.T
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)]
    axes = principal_axes(frame(spark, rows, "double"), 3)
    assert np.allclose(axes.T @ axes, np.eye(axes.shape[1]), atol=1e-9)
    assert np.linalg.norm(base[:, :3].T @ axes, 2) > 0.99


def test_clashing_columns(spark):
    rows = clustered(4, n=60)
    names = "row key node copies cell part nth interval a b n root label class_id label".split()
    df = frame(spark, rows).withColumns({c: F.lit("x") for c in dict.fromkeys(names)})
    assert got(similar_vectors(df)) == plain(rows)


def test_empty(spark):
    out = similar_vectors(frame(spark, []))
    assert out.columns == COLUMNS and out.count() == 0
