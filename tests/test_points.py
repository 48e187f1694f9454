"""Points of regressions: text, scaled columns, samples."""

import numpy as np
import pytest

from tidemark.functions.points import parse_points, sample_points, scaled_points
from tidemark.functions.regression import regression


def test_parse_and_scale(spark):
    lines = spark.createDataFrame([("1.5,4, 2,-3",), (None,), ("0,1,1e3,0.5",)], "value string")
    points = parse_points(lines, 2)
    assert [tuple(r) for r in points.collect()] == [(1.5, 4.0, 2.0, -3.0), (None,) * 4, (0.0, 1.0, 1000.0, 0.5)]
    scaled = scaled_points(points, ["x1", "x2"]).collect()
    assert scaled[0].row == [2.0, 4.0, -6.0] and scaled[0].target == 3.0
    assert scaled_points(points, ["x1"], intercept=False).first().row == [4.0]
    bars = spark.createDataFrame([("1|2|3",)], "text string")
    assert tuple(parse_points(bars, 1, "text", "|").first()) == (1.0, 2.0, 3.0)
    for bad in ("1,2", "1,2,x,4", "1,2,3,4,5", ""):
        with pytest.raises(Exception, match="not 4 fields|not a number"):
            parse_points(spark.createDataFrame([(bad,)], "value string"), 2).collect()


def test_sample(spark):
    points = sample_points(spark, [2.0, -1.0], 0.5, 2000, 4, 0.1, 7)
    assert points.collect() == sample_points(spark, [2.0, -1.0], 0.5, 2000, 4, 0.1, 7).collect()
    assert points.where("weight < 0.5").count() == 0
    model = regression(points, "label", ["x1", "x2"], "weight")
    assert np.allclose(model.beta, [0.5, 2.0, -1.0], atol=0.02)
    rows = scaled_points(points, ["x1", "x2"]).toPandas()
    assert np.allclose(np.linalg.lstsq(np.stack(rows.row), rows.target, rcond=None)[0], model.beta)
    assert sample_points(spark, [], 1.0, 0).count() == 0
