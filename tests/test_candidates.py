"""Operators over candidates against results by hand."""

from quantloom.operators import candidates as C


def test_first_kept_wins_by_skeleton_or_windows(spark):
    rows = [
        (1, "ts_mean(close, 5)"),
        (2, "ts_mean(close, 20)"),  # the skeleton of 1
        (3, "ts_mean(close, 5)"),
        (4, "ts_mean(volume, 5)"),  # other fields
        (5, "add(ts_mean(close, 4), 10)"),
        (6, "add(10, ts_mean(close, 8))"),  # another skeleton, windows close to 5
        (7, "add(add(ts_mean(close, 1), 1), 9)"),  # other operators
        (8, "add(14, ts_mean(close, 12))"),  # close to 6 only, which isn't kept
        (9, "rank(close)"),
        (10, "rank((close))"),  # no windows, so only equal skeletons would do
    ]
    got = {r.candidate_id: r.duplicate_of for r in C.first_kept_duplicates(spark.createDataFrame(rows, "candidate_id long, expression string")).collect()}
    assert got == {1: None, 2: 1, 3: 1, 4: None, 5: None, 6: 5, 7: None, 8: None, 9: None, 10: None}
