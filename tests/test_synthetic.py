import statistics

import numpy as np
import pytest

from vellum.operators import evaluate as E
from vellum.operators import tables as TB
from vellum.sources import synthetic as S


def test_generator_and_evaluation_at_scale(spark):
    t = S.truths(spark, 2)
    rows = t.collect()
    assert len(rows) == 18 and len({r.stem for r in rows}) == 18
    table = next(b.html for b in rows[0].blocks if b.type == "table")
    assert TB.grid(table)[1:] == (5, 4) and TB.teds(table, table, True) == 1.0
    assert S.page(3, "ar", "mild") == S.page(3, "ar", "mild")
    same = E.evaluate(t, S.noisy_prediction(t, 10_000))
    assert same["overall"].first().page_cer == 0.0 and {r.teds for r in same["tables"].collect()} == {1.0} and same["overall"].first().reading_order_tau > 0.5  # equal sentences are found at their first place
    worse = {r.grouping: r for r in E.evaluate(t, S.noisy_prediction(t, 12))["rates"].where("grouping = 'overall'").collect()}
    assert 0.03 < worse["overall"].cer < 0.3


def test_degrading_keeps_the_shape():
    p = np.full((60, 40, 3), 240, np.uint8)
    for level in S.LEVELS:
        img, info = S.degraded(p, level, 1)
        assert img.shape == p.shape and info["level"] == level
    patch = np.dstack([np.zeros((10, 10, 3), np.uint8), np.full((10, 10), 255, np.uint8)])
    assert S.composed(p, patch, 5, 5)[8, 8].tolist() == [0, 0, 0]


def test_exclusive_quartiles(spark):
    for values in ([1.0, 2.0], [5.0, 1.0, 9.0], [3.0, 1.0, 4.0, 1.0, 5.0, 9.0, 2.0, 6.0]):
        got = E.exclusive_quartiles(spark.createDataFrame([("a", v) for v in values] + [("b", 1.0)], "k string, v double"), "k", "v").collect()
        want = [min(max(values), max(min(values), q)) for q in statistics.quantiles(values, n=4)]
        assert [r.k for r in got] == ["a"] and [got[0].q1, got[0].q2, got[0].q3] == pytest.approx(want)
