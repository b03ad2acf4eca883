import datetime as dt

from pyspark.sql import functions as F

from helpers import one_col
from eventlens.functions.dates import published_at_utc
from eventlens.functions.sections import item_8k, mdna, relevant_section
from eventlens.operators.news import preprocess_news, summary_from_description


def test_item_priority_not_position(spark):
    df = one_col(spark, ["Item 8.01 Other. a Item 2.02 Results. b Item 9.01 x",
                         "x ITEM 3.03 Only item here", "no items at all",
                         "item 5.07 votes\nmore"])
    got = [r[0] for r in df.select(item_8k("t")).collect()]
    assert got == ["Item 2.02 Results. b ", "ITEM 3.03 Only item here", "no items at all",
                   "item 5.07 votes\nmore"]


def test_mdna_no_end_alternative(spark):
    df = one_col(spark, ["Item 7. Management's Discussion and Analysis text Item 7A. x Item 8. y",
                         "Item 7 Management's Discussion and Analysis last section"])
    got = [r[0] for r in df.select(mdna("t")).collect()]
    assert got[0] == "Item 7. Management's Discussion and Analysis text Item 7A. x "
    assert got[1] == "Item 7 Management's Discussion and Analysis last section"


def test_form_dispatch(spark):
    df = spark.createDataFrame([("Item 2.02 a Item 3.01 b", "8-k"), ("Item 2.02 a Item 3.01 b", "S-1")],
                               "t string, f string")
    assert [r[0] for r in df.select(relevant_section("t", "f")).collect()] == [
        "Item 2.02 a ", "Item 2.02 a Item 3.01 b"]


def test_publication_time(spark):
    df = one_col(spark, ["2024-01-01T10:00:00.000Z", "2024-01-01T10:00:00Z", "bad", None])
    got = [r[0] for r in df.select(published_at_utc("t")).collect()]
    assert got[0] == got[1] == dt.datetime(2024, 1, 1, 10, 0) and got[2] is None and got[3] is None


def test_description(spark):
    df = one_col(spark, ['[{"content":"a"},{"k":1},{"content":"b"}]', "<p>plain</p> text", None,
                         '["a", 3]', '[{"content": "<i>x</i>"}, "y"]'])
    assert [r[0] for r in df.select(summary_from_description("t")).collect()] == [
        "a b", "plain text", "", "", "x"]


def test_preprocess_news_and_guard(spark):
    raw = spark.createDataFrame(
        [("1", ("2024-01-02T09:00:00Z",), "<b>T</b>", '[{"content":"Up due to demand."}]'),
         ("2", ("nope",), "x", "y")],
        "articlesId string, publishedAt struct<date:string>, articlesName string, articlesDescription string")
    rows = preprocess_news(raw).collect()
    assert len(rows) == 1 and rows[0].title == "T" and rows[0].has_causal_keyword
    assert rows[0].published_date_utc == dt.date(2024, 1, 2)
    missing = preprocess_news(raw.drop("articlesName"))
    assert missing.count() == 0 and "summary" in missing.columns


def test_publication_time_offsets(spark):
    df = one_col(spark, ["2024-01-01T10:00:00.000+02:00", "2024-01-01T10:00:00+02:00"])
    got = [r[0] for r in df.select(published_at_utc("t")).collect()]
    assert got == [dt.datetime(2024, 1, 1, 10, 0), dt.datetime(2024, 1, 1, 8, 0)]
