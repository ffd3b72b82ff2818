"""Exact quantiles by selection against numpy."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest

from marlstone.operators import selection as X


def sample() -> list[tuple]:
    rng = random.Random(9)
    rows = [("hot", rng.choice([rng.gauss(0, 1), 10 ** rng.uniform(-30, 30), 7.0])) for _ in range(4000)]  # most of the rows, heavy tails, a common value
    rows += [("two", float(i % 2)) for i in range(500)] + [("one", 3.0)] * 400 + [(None, float(i)) for i in range(301)] + [("few", 2.0), ("few", 5.0), ("none", None)]
    rows += [("odd", v) for v in [math.inf, -math.inf, 0.0, -0.0, 1.0] * 60] + [("hot", None)] * 5
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("limit", [20, 350, 10**6])
def test_quantiles_of_groups(spark, limit):
    rows, probs = sample(), [0.0, 0.1, 0.5, 0.95, 1.0]
    got = {r.key: (r.n, r.quantiles) for r in X.exact_quantiles(spark.createDataFrame(rows, "key string, value double"), "value", probs, ["key"], limit=limit).collect()}
    groups = {k: sorted(v for g, v in rows if g == k and v is not None) for k in {g for g, v in rows if v is not None}}
    assert set(got) == set(groups)
    for k, values in groups.items():
        assert got[k][0] == len(values)
        for p, q in zip(probs, got[k][1], strict=True):
            at = p * (len(values) - 1)
            a, b = values[math.floor(at)], values[math.ceil(at)]
            assert q == (a if a == b else pytest.approx((math.ceil(at) - at) * a + (at - math.floor(at)) * b))


def test_quantiles_of_a_whole_table(spark):
    values = np.random.default_rng(3).lognormal(size=20_001)
    df = spark.createDataFrame([(float(v),) for v in values] + [(None,)], "v double")
    row = X.exact_quantiles(df, "v", [0.25, 0.5, 0.999], limit=50).collect()
    assert len(row) == 1 and row[0].n == 20_001 and row[0].quantiles == pytest.approx(np.quantile(values, [0.25, 0.5, 0.999]).tolist())
    assert X.exact_quantiles(df.limit(0), "v", [0.5]).isEmpty() and X.exact_medians(df.filter("v IS NULL"), "v").isEmpty()
    assert X.exact_medians(spark.createDataFrame([(float("nan"),)] * 60 + [(1.0,)] * 30, "v double"), "v", limit=10).first().median != X.exact_medians(df, "v").first().median
