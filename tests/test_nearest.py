"""Nearest of many centres, and ranks of many columns, against numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkmetrica.operators import arrays as A
from sparkmetrica.operators import order as O


@pytest.mark.parametrize("block_bytes", [A.CENTRE_BYTES, 700])
def test_nearest_in_any_number_of_blocks(spark, block_bytes):
    rng = np.random.default_rng(2)
    x, c = rng.normal(size=(200, 5)) + 1000, np.round(rng.normal(size=(90, 5)), 1) + 1000
    c[50:70] = c[:20]  # equal centres: the smaller label
    x[:10] = c[:10]
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(900, None), (901, [1.0, None, 0.0, 0.0, 0.0])], "id long, v array<double>").repartition(3)
    centres = spark.createDataFrame([(i * 3, v.tolist()) for i, v in enumerate(c)] + [(-5, [float("nan")] * 5)], "name long, at array<double>")
    far = ((x[:, None] - c) ** 2).sum(axis=2)
    want = {i: (3 * int(np.argmin(d)), float(np.sqrt(d.min()))) for i, d in enumerate(far)}
    got = {r["id"]: (r["nearest"], r["distance"]) for r in A.nearest_of(rows, "id", "v", centres, "name", "at", block_bytes=block_bytes).collect()}
    assert {k: v[0] for k, v in got.items()} == {k: v[0] for k, v in want.items()}
    assert all(got[k][1] == pytest.approx(want[k][1], abs=1e-12) for k in want)
    none = A.nearest_of(rows, "id", "v", centres.where("false"), "name", "at").collect()
    assert len(none) == 200 and all(r["nearest"] is None for r in none)


def test_other_leaves_out_the_row_itself_only(spark):
    rows = spark.createDataFrame([(1, [0.0, 0.0]), (2, [0.0, 0.0]), (3, [3.0, 4.0])], "id long, v array<float>")
    got = {r["id"]: (r["nearest"], r["distance"]) for r in A.nearest_of(rows, "id", "v", rows, "id", "v", other=True).collect()}
    assert got == {1: (2, 0.0), 2: (1, 0.0), 3: (1, 5.0)}


def test_ranks_of_many_columns_in_one_order(spark):
    rng = np.random.default_rng(7)
    table = [tuple(None if rng.random() < 0.1 else float(rng.integers(0, 8 if j == 1 else 1000)) for j in range(4)) for _ in range(400)]
    df = spark.createDataFrame(table, "a double, b double, c double, d double").repartition(4)
    keyed = df.withColumn("id", F.monotonically_increasing_id())
    got = O.all_ranks(df, ["a", "b", "c", "d"])
    for j, c in enumerate("abcd"):
        v = np.array([t[j] for t in table if t[j] is not None])
        ranks = [(v < x).sum() + ((v == x).sum() + 1) / 2 for x in v]
        assert sorted(r[0] for r in got.select(c).collect() if r[0] is not None) == sorted(ranks)
    both = got.where("a IS NOT NULL AND c IS NOT NULL")
    one = [(t[0], t[2]) for t in table]
    x = [np.array([t[i] if t[i] is not None else np.nan for t in one]) for i in (0, 1)]
    rank = [np.array([np.nan if np.isnan(q) else (v < q).sum() + ((v == q).sum() + 1) / 2 for q in v]) for v in x]
    ok = ~np.isnan(rank[0]) & ~np.isnan(rank[1])
    assert both.agg(F.corr("a", "c")).first()[0] == pytest.approx(np.corrcoef(rank[0][ok], rank[1][ok])[0, 1], abs=1e-12) and keyed.count() == 400


def test_blocks_of_centres_don_t_pile_up(spark):
    """One block at a time is in the tasks: however many there are, the plan has one step in Python, which holds few distances at once."""
    rng = np.random.default_rng(3)
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rng.normal(size=(60, 4)))], "id long, v array<double>").repartition(2)
    for block_bytes in (A.CENTRE_BYTES, 400):
        plan = A.nearest_of(rows, "id", "v", rows, "id", "v", other=True, block_bytes=block_bytes)._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("MapInArrow") == 1
