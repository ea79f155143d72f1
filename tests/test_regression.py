"""Regressions of several columns against the same with a column for each id, or with whole matrices."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from fathomline.operators import density, panel, regression


@pytest.fixture(scope="module")
def rows(spark):
    # Ids of one to seven rows with an effect each.
    ids = spark.range(30).select(F.col("id"), (2 * F.randn(1)).alias("a"), F.explode(F.sequence(F.lit(0), F.col("id") % 7)).alias("time"))
    return ids.select("id", "time", F.randn(2).alias("x"), (100 + F.randn(3)).alias("z"), "a").withColumn("y", 3 + 0.5 * F.col("x") - 0.2 * F.col("z") + F.col("a") + 0.3 * F.randn(4)).cache()


def by_term(df):
    return {r["term"]: (r["estimate"], r["std_error"]) for r in df.collect()}


def test_pooled_and_fixed(rows):
    data = rows.toPandas()
    y, one = data["y"].to_numpy(), np.ones(len(data))
    dummies = (data["id"].to_numpy()[:, None] == np.unique(data["id"])[None, :]).astype(float)
    for effect, other in (("none", one[:, None]), ("fixed", dummies)):
        x = np.column_stack([data["x"], data["z"], other])
        b = np.linalg.lstsq(x, y, rcond=None)[0]
        s2 = ((y - x @ b) ** 2).sum() / (len(y) - x.shape[1])
        se = np.sqrt(s2 * np.diag(np.linalg.inv(x.T @ x)))
        found = by_term(regression.regression(rows, "y", ["x", "z"], effect))
        for k, t in enumerate(("x", "z")):
            assert found[t] == pytest.approx((b[k], se[k]), rel=1e-6)
    assert found["_cons"][1] is None


def test_random(rows):
    data = rows.toPandas().sort_values(["id", "time"])
    y, x = data["y"].to_numpy(), np.column_stack([np.ones(len(data)), data["x"], data["z"]])
    group = data.groupby("id")
    t = group["y"].transform("size").to_numpy()
    my, mx = group["y"].transform("mean").to_numpy(), np.column_stack([np.ones(len(data)), group["x"].transform("mean"), group["z"].transform("mean")])
    wb = np.linalg.lstsq((x - mx)[:, 1:], y - my, rcond=None)[0]
    firms = group.ngroups
    s2e = ((y - my - (x - mx)[:, 1:] @ wb) ** 2).sum() / (len(y) - firms - 2)
    means = group[["y", "x", "z"]].mean()
    bx = np.column_stack([np.ones(firms), means["x"], means["z"]])
    bb = np.linalg.lstsq(bx, means["y"], rcond=None)[0]
    s2v = max(0, ((means["y"] - bx @ bb) ** 2).sum() / (firms - 3) - s2e * (1 / group.size()).mean())
    share = 1 - np.sqrt(s2e / (t * s2v + s2e))
    xq, yq = x - share[:, None] * mx, y - share * my
    b = np.linalg.lstsq(xq, yq, rcond=None)[0]
    se = np.sqrt(((yq - xq @ b) ** 2).sum() / (len(y) - 3) * np.diag(np.linalg.inv(xq.T @ xq)))
    found = by_term(regression.regression(rows, "y", ["x", "z"], "random"))
    for k, term in enumerate(("_cons", "x", "z")):
        assert found[term] == pytest.approx((b[k], se[k]), rel=1e-6)


def test_repeated_rows_and_transitions(spark):
    few = spark.createDataFrame([(1, 2), (2, 0), (3, None)], "id long, n int")
    assert [tuple(r) for r in panel.repeated(few, F.col("n")).orderBy("place").collect()] == [(1, 2, 1), (1, 2, 2)]
    with pytest.raises(ValueError):
        density.transitions([[F.lit(0.0)]])
    p = density.transitions([[F.lit(1.0), F.lit(-2.0)], [F.lit(0.5), F.lit(0.1)], [F.lit(3.0), F.lit(0.0)]])
    got = spark.range(1).select(*[c for r in p for c in r]).first()
    for i in range(3):
        assert sum(got[3 * i : 3 * i + 3]) == pytest.approx(1)
    assert got[0] == pytest.approx(1 / (1 + np.e + np.exp(-2)))
