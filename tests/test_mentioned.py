"""Dates and addresses that texts mention: the whole text is read a few times, not once for each pattern and place of use."""

import time
from datetime import date

import pytest
from pyspark.sql import functions as F

from corpusforge import catalog
from corpusforge.functions import text

catalog.load()


def of(spark, value, form):
    return spark.createDataFrame([(value,)], "x string").select(form(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize("name", ["doc_metadata", "extract_dates"])
def test_each_month_is_replaced_once(spark, sf_dir, name):
    """Written out at each place of use, the twelve names stood in the plan hundreds of times."""
    plan = catalog.QUERIES[name](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace") == len(text.MONTHS)


@pytest.mark.parametrize("name", ["doc_metadata", "extract_email_domains"])
def test_text_is_lowered_once(spark, sf_dir, name):
    assert catalog.QUERIES[name](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString().count("lower(") == 1


def test_markers_without_cc_take_time_as_the_text(spark):
    """From each "to" the search for a "cc" went on to the end of the text."""
    began = time.time()
    got = of(spark, "cc@x.nl from@y.nl " + "to " * 40_000 + "@a.nl", text.email_headers)
    assert (got["email_from"], got["email_to"], got["email_cc"]) == ("@y.nl", None, "@x.nl") and time.time() - began < 30


@pytest.mark.parametrize(
    ("value", "to"),
    [("to @a.nl cc", "@a.nl"), ("to@b.nl aan @a.nl ccc", "@a.nl, @b.nl"), ("cc to @a.nl", None), ("to @a.nlcc", "@a.nlcc"), ("cc @x.nl", None), ("TO @A.NL Cc @b.nl", "@a.nl"), ("", None), (None, None)],
)
def test_to(spark, value, to):
    assert of(spark, value, text.email_headers)["email_to"] == to


@pytest.mark.parametrize(
    ("value", "first", "last"),
    [
        ("van 3 mei\n 2001 tot 4  juni 2002, 2003-1-2", date(2001, 5, 3), date(2003, 1, 2)),
        ("1-2-2003-4-5", date(2003, 2, 1), date(2003, 4, 5)),
        ("123-1-2-2003", date(2003, 2, 1), date(2003, 2, 1)),
        ("1-2-2003 4 mei 2005", date(2003, 2, 1), date(2005, 5, 4)),
        ("a1-2-2003", date(2003, 2, 1), date(2003, 2, 1)),
        ("\U0001d49c1-2-2003", date(2003, 2, 1), date(2003, 2, 1)),
        ("1-2-2003a", None, None),
        ("1;2-2003", date(2003, 2, 1), date(2003, 2, 1)),
        ("1 mei; 2003", None, None),
        ("1 Mei 2003", None, None),
        ("1-" * 100_000 + "2-2003", date(2003, 2, 1), date(2003, 2, 1)),
        ("1" * 100_000 + " 7 mei 2003" + " " * 100_000 + "2004", date(2003, 5, 7), date(2003, 5, 7)),
        (None, None, None),
    ],
)
def test_runs_of_numbers(spark, value, first, last):
    got = of(spark, value, lambda c: text.mentioned_dates(c, 2026))
    assert (got["first"], got["last"]) == (first, last)
