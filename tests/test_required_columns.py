"""Absent columns are named before any job runs."""

import pytest

from tieout.operators import checks as C
from tieout.operators import gate as G


@pytest.fixture(scope="module")
def frames(spark):
    return (spark.createDataFrame([("a", 1.0)], "Id string, value double"),
            spark.createDataFrame([("a", 1.0)], "other string, value double"))


@pytest.mark.parametrize("call,named", [
    (lambda a, b: C.run_all(a, b, ["id"], "value"), "the target has no column 'id'"),
    (lambda a, b: C.run_all(a, a, ["id"], "amount"), "the source has no column 'amount'"),
    (lambda a, b: G.validate(a, b, record_id_col="id", value_col="x"), "the current batch has no column 'x'"),
    (lambda a, b: G.validate(a, b), "the current batch has no column 'record_id'"),
    (lambda a, b: G.validate(a, b, record_id_col="id", history_value_col="y"), "the history has no column 'y'"),
    (lambda a, b: G.validate(a, b, record_id_col="id", ts_col="ts", as_of="2024-01-01"),
     "the history has no column 'ts'"),
    (lambda a, b: G.validate_segmented(a, b, record_id_col="id", segment_col="other"),
     "the current batch has no column 'other'"),
    (lambda a, b: G.validate_segmented(a, b, record_id_col="id", segment_col="id"), "the history has no column 'id'"),
    (lambda a, b: G.baseline(a, segment_col="s"), "the history has no column 's'"),
])
def test_absent_columns_are_named(frames, call, named):
    with pytest.raises(ValueError, match=named):
        call(*frames)


def test_names_are_compared_without_case(frames):
    a, _ = frames
    assert C.run_all(a, a, ["ID"], "Value").count() == 3
