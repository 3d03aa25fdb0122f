"""Calendar gaps against a brute-force spine."""

from fluvio.operators.calendar import calendar_gaps


def test_gaps_inside_before_and_after(spark):
    rows = [(1, 2000, m) for m in (1, 2, 5, 6)] + [(2, 2000, m) for m in (3, 4)] + [(2, 2001, 1)]
    df = spark.createDataFrame(rows, "station_id long, year int, month int")
    got = sorted((r.station_id, r.year, r.month) for r in calendar_gaps(df).collect())
    months = [(2000, m) for m in range(1, 13)] + [(2001, 1)]
    present = set(rows)
    exp = sorted((s, y, m) for s in (1, 2) for (y, m) in months if (s, y, m) not in present)
    assert got == exp
