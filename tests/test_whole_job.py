"""The registered queries do the whole job: all of a strategy's sets, all features, all rounds."""

from math import prod

import pytest

from tickloom.operators import compact
from tickloom.plans import strategies
from tickloom.plans.queries import QUERIES, hourly
from tickloom.sources import bars as B


@pytest.mark.parametrize("name", ["bollinger_breakout", "rsi_mean_reversion"])
def test_finder_query_ranks_every_set(spark, data, name):
    got = QUERIES[f"finder_{name}"](spark, data).toPandas()
    ranges = strategies.get(name).ranges
    ranked = got[got["part"] == "ranked"]
    assert (ranked.groupby("symbol")["params"].nunique() == prod(map(len, ranges.values()))).all()
    for k, values in ranges.items():
        assert all(ranked["params"].str.contains(f'"{k}":{float(v)}').any() for v in values)
    folds = got[got["part"] == "walk_forward"]
    assert set(folds["symbol"]) == set(ranked["symbol"])
    assert (folds.groupby("symbol").size() == 2).all()


def test_importances_cover_every_feature(spark, data):
    got = QUERIES["feature_importances"](spark, data).toPandas()
    assert got["n"].sum() == len(B.numeric_features(compact.compact_features(hourly(spark, data))))
    assert abs(got["total"].sum() - 1) < 1e-3
