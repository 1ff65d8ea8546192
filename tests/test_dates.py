"""Dates in the forms that people write."""

from datetime import datetime

from pyspark.sql import functions as F

from corpusforge.functions.dates import written_date

DAYS = [datetime(2021, 3, 4), datetime(1999, 12, 31), datetime(2000, 2, 29), datetime(2023, 11, 15), datetime(1985, 7, 1)]
DUTCH = ["januari", "februari", "maart", "april", "mei", "juni", "juli", "augustus", "september", "oktober", "november", "december"]
#: Forms of a day, each with the day that it means (month first in doubt).
FORMS = [
    "%Y-%m-%d", "%Y/%m/%d", "%Y.%m.%d", "%Y%m%d", "%m/%d/%Y", "%m-%d-%Y", "%m.%d.%Y", "%m/%d/%y", "%d %B %Y", "%B %d, %Y", "%b %d %Y", "%d %b %Y", "%d-%b-%Y", "%d-%b-%y", "%A, %d %B %Y", "%a %d %b %Y", "%Y %B %d",
    "Created on %d %B %Y by someone", "the %dth of %B %Y", "  %Y-%m-%d  ", "%B %dst, %Y", "[%Y-%m-%d]", "date: %m/%d/%Y.",
]
TIMES = [("%s 14:05", (14, 5, 0)), ("%sT14:05:09", (14, 5, 9)), ("%s 2:05 pm", (14, 5, 0)), ("%s 12:00 AM", (0, 0, 0)), ("%s 12:30 p.m.", (12, 30, 0)), ("%sT08:15:30Z", (8, 15, 30)), ("%s 08:15:30.123+02:00", (8, 15, 30)), ("%s 23:59:59 UTC", (23, 59, 59)), ("%s, 7:01 GMT+1", (7, 1, 0)), ("5 pm on %s", (17, 0, 0))]
OTHERS = {
    "13/02/2020": datetime(2020, 2, 13), "02/13/2020": datetime(2020, 2, 13), "2020-13-02": datetime(2020, 2, 13), "3/4/2021 5:06 PM UTC": datetime(2021, 3, 4, 17, 6), "March 2021": datetime(2021, 3, 1), "2021-03": datetime(2021, 3, 1), "03/2021": datetime(2021, 3, 1),
    "20210304T050607": datetime(2021, 3, 4, 5, 6, 7), "20210304050607": datetime(2021, 3, 4, 5, 6, 7), "5 mrt 2019": datetime(2019, 3, 5), "1 okt. 2018": datetime(2018, 10, 1), "1/2/68": datetime(2068, 1, 2), "1/2/69": datetime(1969, 1, 2),
    **dict.fromkeys(["", "  ", "nan", "NaN", "nonsense", "2021", "March", "5 March", "12:30", "31/31/2020", "2021-02-30", "29 February 2021", "1/2", "1 2 3 4", "123/4/2020", "may be", "version 1.2", "0/0/0000", "99999999", "marching 5 2020 on", "12345"]),
}
OTHERS["marching 5 2020 on"] = datetime(2020, 5, 1)


def cases():
    out = dict(OTHERS)
    for d in DAYS:
        out |= {d.strftime(f): d for f in FORMS}
        out[f"{d.day} {DUTCH[d.month - 1]} {d.year}"] = d
        out[f"{d.day}-{d.month}-{d.year}" if d.day > 12 else f"{d.month}-{d.day}-{d.year}"] = d
    for k, (form, clock) in enumerate(TIMES):
        d = DAYS[k % len(DAYS)]
        for day in ("%Y-%m-%d", "%m/%d/%Y", "%B %d, %Y"):
            if not (form.startswith("%sT") and day != "%Y-%m-%d"):
                out[form % d.strftime(day)] = d.replace(hour=clock[0], minute=clock[1], second=clock[2])
    return out


def test_written_forms(spark):
    want = cases()
    assert len(want) >= 170
    rows = spark.createDataFrame([(x,) for x in [*want, None]], "t string").select("t", written_date(F.col("t")).alias("d")).collect()
    wrong = {r["t"]: (r["d"], want[r["t"]]) for r in rows if r["t"] is not None and r["d"] != want[r["t"]]}
    assert not wrong and [r["d"] for r in rows if r["t"] is None] == [None]


def test_no_python_in_the_plan(spark):
    plan = spark.range(1).select(written_date(F.lit("2021-03-04")).alias("d"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "UDF" not in plan


def test_each_step_stands_once_in_the_plan(spark):
    """The steps build on each other; written out at each place of use, the plan of one column had grown beyond all bounds."""
    df = spark.range(1).select(F.concat(F.lit("2021-03-"), F.col("id")).alias("t")).select(written_date(F.col("t")).alias("d"))
    assert df._jdf.queryExecution().optimizedPlan().toString().count("regexp_replace") <= 8
