"""Dates in any form: each format is tried where it can fit."""
import datetime

from pyspark.sql import functions as F

from carelake.functions import expr as X


def test_dates_are_only_parsed_by_formats_that_can_fit(spark):
    forms = {"2001-05-31": (2001, 5, 31), "31.5.2001": (2001, 5, 31), "31-05-2001": (2001, 5, 31), "5/31/2001": (2001, 5, 31),
             "2001-05-31T10:00:00": (2001, 5, 31), "0007-01-2000": (2000, 1, 7), "+12001-1-1": None, "2001-13-01": None, "37042.5": (2001, 5, 31),
             "1.2": (1899, 12, 31), "n/a": None, "": None, "-": None, "2001.05.31": None, "31/5/2001": None}
    df = spark.createDataFrame([(x,) for x in forms], "x string").select("x", X.parse_any_date("x").cast("string").alias("d"))
    got = {r["x"]: r["d"] for r in df.collect()}
    for x, d in forms.items():
        if d is not None:
            assert got[x] == str(datetime.date(*d)), x
        elif x != "+12001-1-1":      # a year of five digits: whatever the format says
            assert got[x] is None, x
    # the same as trying every format on every text
    day, s = X.date_part("x"), F.trim(F.col("x"))
    plain = F.coalesce(*[F.try_to_timestamp(day, F.lit(f)).cast("date") for f in X.DATE_FORMATS],
                       F.when(s.rlike(r"^\d{1,6}(\.\d+)?$"), F.date_add(F.lit(X.SPREADSHEET_EPOCH).cast("date"), s.try_cast("double").cast("int"))))
    assert df.select("x").where(~plain.cast("string").eqNullSafe(X.parse_any_date("x").cast("string"))).count() == 0
    # no format is tried without its mark
    text = df._jdf.queryExecution().optimizedPlan().toString()
    assert "RLIKE" in text and all(m in text for m in (", .)", ", -)", ", /)"))
