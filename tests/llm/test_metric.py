import numpy as np
import pytest
from pyspark.sql import functions as F

from shroudline.llm import metric

from .conftest import CLASH

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, threshold=0.95):
    able = [v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v) for _, v in rows]
    dims = max((len(v) for (_, v), a in zip(rows, able) if a), default=1)
    x = np.zeros((len(rows), dims))
    for row, (_, v), a in zip(x, rows, able):
        if a:
            row[: len(v)] = np.array(v, dtype=np.float32)
            row /= np.linalg.norm(row)
    near = (x @ x.T >= threshold) & ~np.eye(len(rows), dtype=bool)
    out, seen = [None] * len(rows), set()
    for i in range(len(rows)):
        if i not in seen:
            group, todo = {i}, [i]
            while todo:
                new = set(np.flatnonzero(near[todo.pop()]).tolist()) - group
                group |= new
                todo += new
            seen |= group
            least = min((rows[k][0] for k in group if rows[k][0] is not None), default=None)
            for k in group:
                out[k] = (rows[k][0], int(near[k].sum()), least, rows[k][0] == least)
    return sorted(out, key=str)


def near_vectors(seed, n=60, dims=12, noise=(0.02, 0.08, 0.15)):
    """Vectors of random directions, some with looser or tighter crowds about them, some chains and exact copies."""
    rng = np.random.default_rng(seed)
    out = []
    for k in range(n):
        v = rng.normal(size=dims)
        out.append(v)
        for _ in range(int(rng.choice([0, 0, 1, 4]))):
            out.append((v + rng.normal(size=dims) * rng.choice(noise) * np.linalg.norm(v) / 3) * rng.uniform(0.1, 9))
        if k % 9 == 0:
            out.append(v)
        if k % 15 == 0:  # a chain: each is near the one before
            w = rng.normal(size=dims)
            for t in np.linspace(0, 1.4, 8):
                out.append(v / np.linalg.norm(v) * np.cos(t) + w / np.linalg.norm(w) * np.sin(t))
    crowd = rng.normal(size=dims)
    out += [crowd + rng.normal(size=dims) * 0.05 for _ in range(80)]
    out = [v.astype(np.float32).tolist() for v in out]
    rng.shuffle(out)
    return [(k, v) for k, v in enumerate(out)]


def frame(spark, rows, extra=()):
    df = spark.createDataFrame([(k, v, 1) for k, v in rows], SCHEMA)
    for name in extra:
        df = df.withColumn(name, F.lit(7))
    return df


def result(df):
    return sorted([(r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in df.collect()], key=str)


@pytest.mark.parametrize("dims, small", [(12, True), (3, True), (40, False)])
def test_links_equal_brute_force(spark, monkeypatch, dims, small):
    rows = near_vectors(dims, dims=dims)
    if small:  # many small blocks, pivots from a part of the rows
        monkeypatch.setattr(metric, "LEAST_ROWS", 16)
        monkeypatch.setattr(metric, "SAMPLE", 120)
        monkeypatch.setattr(metric, "SLICE", 7)
        monkeypatch.setattr(metric, "ROUTED", 40)
    got, want = result(metric.near_duplicates(frame(spark, rows, CLASH).repartition(3))), brute(rows)
    assert max(r[1] for r in want) > 40
    assert got == want


def test_the_triangle_inequality_spares_tiles(spark):
    """Far crowds: every vector is routed to a few of the blocks only, and a core is not routed to itself."""
    rng = np.random.default_rng(1)
    centres = np.linalg.qr(rng.normal(size=(30, 30)))[0]
    x = np.concatenate([c + rng.normal(size=(50, 30)) * 0.01 for c in centres])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    cells = metric.Cells(*metric.choose_pivots(x[::3], 4, 0.316), 0.316)
    cell, d = cells.place(x)
    assert cells.dense == 30 and (cell < 30).all()
    sizes = {k: (int((cell == k).sum()), d[cell == k].min(), d[cell == k].max()) for k in set(cell.tolist())}
    assert cells.counted(sizes, 1000).reach(x, cell).sum() == 0


def test_odd_rows(spark):
    v = [0.5, 0.5, 0.0]
    rows = [(1, None), (2, [0.0, 0.0, 0.0]), (3, []), (4, [1.0, None, 0.0]), (5, [float("nan"), 1.0, 0.0]), (6, [float("inf"), 1.0, 0.0]), (7, v), (7, v), (7, [0.0, 0.0, 1.0]), (None, v), (None, [0.0, 1.0, 0.0]), (9, [0.5, 0.5]), (10, [-0.0, 0.0, 2e-38]), (11, [0.0, 0.0, 3e38])]
    assert result(metric.near_duplicates(frame(spark, rows))) == brute(rows)


def test_tables_without_links(spark):
    assert result(metric.near_duplicates(frame(spark, []))) == []
    assert result(metric.near_duplicates(frame(spark, [(1, None)]))) == [(1, 0, 1, True)]
    assert result(metric.near_duplicates(frame(spark, [(1, [1.0])]))) == [(1, 0, 1, True)]


def test_doubles_and_other_thresholds(spark):
    rows = [(k, [float(x) for x in v]) for k, v in near_vectors(5, n=20)]
    df = frame(spark, rows).withColumn("embedding", F.col("embedding").cast("array<double>"))
    for threshold in (0.5, 0.9, 0.999):
        assert result(metric.near_duplicates(df, threshold=threshold)) == brute(rows, threshold)
