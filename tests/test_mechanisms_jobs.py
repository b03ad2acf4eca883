"""Mechanisms of the jobs: late page fetch, pages of articles, quarantine,
headings in one pass, batches by prompt length, bucketed prices, ticker files."""
import random
import re
import uuid

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from eventlens.functions import sections
from eventlens.operators.filings import _file_groups, fetch_pages, filings_with_text, page_places, preprocess_filings
from eventlens.operators.labels import standardise_files
from eventlens.operators.predict import length_batches, run_predictors
from eventlens.operators.returns import daily_returns
from eventlens.plans import bindings as B
from eventlens.schemas import PAGE_NUMBERS, RAW_NEWS
from eventlens.session import scratch_path
from eventlens.sources import readers, writers
from eventlens.sources.landing import missing_pages, to_pages
from helpers import SF_SMALL, one_col


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def pages_table(spark, n=60, files=5):
    path = scratch_path(spark, "t-landed pages")  # a space in the path
    rows = spark.range(0, n, 1, files).select(F.concat(F.lit("u"), "id").alias("url"),
                                              F.concat(F.lit("<body><p>text of "), "id", F.lit("</p></body>")).alias("html"))
    rows.write.parquet(path)
    return path


def test_late_fetch_reads_only_the_wanted_pages(spark):
    places = page_places(spark, pages_table(spark))
    assert "html" not in plan(places).split("ReadSchema")[1].split("\n")[0].replace("html_url", "")
    wanted = places.where(F.col("html_url").isin("u3", "u17", "u18", "u59"))
    for max_rows in (1_000_000, 2, 1):
        got = {r.html_url: r.html for r in fetch_pages(wanted, max_rows=max_rows).collect()}
        assert got == {u: f"<body><p>text of {u[1:]}</p></body>" for u in ("u3", "u17", "u18", "u59")}
    assert fetch_pages(places.where("false")).collect() == []


def test_no_exchange_carries_a_page(spark):
    places = page_places(spark, pages_table(spark))
    for max_rows in (1_000_000, 3):
        p = plan(fetch_pages(places, max_rows=max_rows))
        for k, part in enumerate(p.split("Exchange")[1:]):
            scan = part.split("FileScan")[1] if "FileScan" in part.split("BroadcastHashJoin")[0] else ""
            assert "html#" not in scan.split("]")[0]
        assert "SortMergeJoin" not in p and "Exchange hashpartitioning" not in p


def test_filings_without_a_page_keep_a_null_text(spark):
    path = pages_table(spark)
    index = one_col(spark, ["u1", "u1", "nowhere", None], "html_url")
    rows = sorted((r.html_url or "", r.full_filing_text) for r in filings_with_text(index, page_places(spark, path)).collect())
    assert rows == [("", None), ("nowhere", None), ("u1", "text of 1"), ("u1", "text of 1")]


def test_files_are_grouped_by_their_wanted_rows():
    files = [("a", 3), ("b", 2), ("c", 9), ("d", 1), ("e", 4)]
    groups = _file_groups(files, 5)
    assert groups == [["a", "b"], ["c"], ["d", "e"]]
    assert [f for g in groups for f in g] == [f for f, _ in files]


def test_pages_hold_all_articles_in_whole_pages(spark):
    raw = B.news_raw(spark, SF_SMALL).repartition(3)
    pages = to_pages(raw, 20)
    rows = pages.select("page", "allPages", F.size("articles").alias("n")).collect()
    total = len(rows)
    assert sorted(r.page for r in rows) == list(range(1, total + 1)) and {r.allPages for r in rows} == {total}
    assert max(r.n for r in rows) == 20 and sum(r.n < 20 for r in rows) <= 3
    back = pages.select(F.explode("articles").alias("a")).select("a.*")
    key = lambda df: sorted(map(repr, df.collect()))
    assert key(back) == key(raw)
    assert to_pages(raw.where("false")).collect() == []


def test_missing_pages_are_found(spark):
    pages = to_pages(B.news_raw(spark, SF_SMALL).repartition(2), 7)
    total = pages.count()
    assert total > 6 and missing_pages(pages).collect() == []
    lost = missing_pages(pages.where("page not in (2, 5)"))
    assert sorted(r.page for r in lost.collect()) == [2, 5]
    path = scratch_path(spark, "t-pages")
    writers.write_landing(pages.where("page <> 1"), path)
    assert [r.page for r in missing_pages(spark.read.schema(PAGE_NUMBERS).json(path)).collect()] == [1]
    assert missing_pages(pages.where("false")).collect() == []


def test_quarantine_holds_what_broke(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"articlesId": "1"}, {"articlesId": "2", "publishedAt": "odd"}]\n[{"articlesId": \n')
    (tmp_path / "b.json").write_text('not json\n[{"articlesId": "3"}]\nworse {\n')
    got = readers.load_json_array(spark, str(tmp_path), RAW_NEWS, scratch_path(spark, "t-quarantine"), multi_line=False)
    assert (got.n_good, got.n_broken) == (3, 3)
    assert sorted(r.articlesId for r in got.good.collect()) == ["1", "2", "3"] and got.good.columns == [f.name for f in RAW_NEWS.fields]
    broken = {r.file.rsplit("/", 1)[1]: (r.n_broken, r.sample) for r in got.broken.collect()}
    assert broken == {"a.json": (1, '[{"articlesId": '), "b.json": (2, "not json")}


def section_texts():
    r = random.Random(8)
    parts = ["Item 2.02", "item  1.01", "ITEM\n5.02", "Item 8.01", "Item 9.01", "Item 5.07", "Item 2.021", "Item 7.", "Item 12.02", "Item",
             "ITEM3.03", "Items 2.02", " Results. ", "\n", " ", "text", "é", "Item 2.0", "Item 2."]
    return ["".join(r.choice(parts) for _ in range(r.randrange(9))) for _ in range(1500)] + ["Item 2.02", "Item 2.02\n", "Item 2.02x\n", None]


def test_headings_give_the_sections_of_the_patterns(spark):
    df = one_col(spark, section_texts())
    form = F.when(F.length("t") % 5 == 0, F.lit("10-K")).otherwise(F.lit("8-k"))
    staged = sections.with_relevant_section(df.withColumn("f", form), "t", "f", "staged")
    rows = staged.select("t", sections.item_8k("t").alias("a"), sections._by_pattern(F.col("t")).alias("b"), "staged",
                         sections.relevant_section("t", "f").alias("plain")).collect()
    assert [(r.t, r.a) for r in rows if r.a != r.b] == [] and [(r.t, r.staged) for r in rows if r.staged != r.plain] == []
    odd = one_col(spark, ["Item 10.1 a Item 2.02 b"])  # codes of another form
    assert odd.select(sections.item_8k("t", ("10.1",))).first()[0] == odd.select(sections._by_pattern(F.col("t"), ("10.1",))).first()[0]


def test_a_text_without_items_is_scanned_twice_not_six_times(spark):
    p = plan(preprocess_filings(B.filings_raw(spark, SF_SMALL), F.col("form"), text_mode="plain"))
    by_code = len(re.findall(r"2\\\\?\.02", p.split("_codes")[0]))
    assert "regexp_extract_all" in p and by_code <= 1


def test_batches_are_of_like_length_within_the_budget():
    r = random.Random(1)
    texts = [None, "", "x" * 9000] + ["y" * r.randrange(1, 800) for _ in range(3000)]
    frames = [pd.DataFrame({"prompt": texts[k:k + 700], "k": range(k, min(k + 700, len(texts)))}) for k in range(0, len(texts), 700)]
    batches = list(length_batches(iter(frames), "prompt", 2000))
    assert sorted(i for b in batches for i in b["k"]) == list(range(len(texts)))
    for b in batches:
        longest = max(len(t or "") for t in b["prompt"]) // 4 + 1
        assert len(b) == 1 or longest * len(b) <= 2000
    padded = sum(len(b) * max(len(t or "") for t in b["prompt"]) for b in batches)
    assert padded < 1.2 * sum(len(t or "") for t in texts) and len(batches) < len(texts) / 4
    assert list(length_batches(iter([]), "prompt", 10)) == []


def test_answers_do_not_depend_on_batches(spark):
    df = spark.createDataFrame([(i, "p" * (i * 37 % 300)) for i in range(500)], "event_id int, prompt string").repartition(3)
    make = lambda: lambda b: b["prompt"].map(len).astype(str)
    got = [sorted(map(tuple, run_predictors(df, {"m": make}, token_budget=n).collect())) for n in (None, 50, 10**9)]
    assert got[0] == got[1] == got[2] == sorted((i, "m", str(i * 37 % 300)) for i in range(500))


def test_the_plan_carries_the_profile(spark, monkeypatch):
    from pyspark.sql import DataFrame
    from eventlens.operators.predict import accelerator_profile
    profile = accelerator_profile(cpus=2, gpu=1)
    assert profile.taskResources["gpu"].amount == 1.0 and profile.executorResources["gpu"].amount == 1
    seen = []
    real = type(spark.range(1)).mapInPandas
    monkeypatch.setattr(type(spark.range(1)), "mapInPandas",
                        lambda self, f, schema, barrier=False, profile=None: seen.append(profile) or real(self, f, schema))
    df = one_col(spark, ["a"], "prompt")
    run_predictors(df, {"m": lambda: lambda b: b["prompt"]}, profile=profile)
    assert seen == [profile] and DataFrame is not None


def test_bucketed_prices_need_no_exchange_and_no_sort(spark):
    name = f"prices_{uuid.uuid4().hex}"
    bars = B.bars(spark, SF_SMALL)
    writers.write_price_table(bars, name, scratch_path(spark, "t-prices"), 4)
    try:
        table = daily_returns(spark.table(name))
        p = plan(table)
        below = p[p.index("Window "):]
        assert "Exchange" not in below and "Sort " not in below
        key = lambda df: sorted(map(repr, df.select(sorted(df.columns)).collect()))
        assert key(table) == key(daily_returns(bars))
    finally:
        spark.sql(f"DROP TABLE {name}")


def test_ticker_files_are_written_and_read_at_once(spark):
    rows = [("n1", "A", 0.5, "Up \"q\"", None), ("n2", "B_B", float("nan"), None, "text, with é"), ("n3", "A", None, "x", "")]
    df = spark.createDataFrame(rows, "news_id string, ticker string, ret_pct_d1 double, cat_d1 string, summary string")
    path = scratch_path(spark, "t-tickers")
    writers.write_ticker_files(df, path, ("ret_pct_d1", "cat_d1"))
    lines = {r.value for r in readers.read_ticker_lines(spark, path).collect()}
    assert '{"news_id":"n1","A_ret_pct_D+1":0.5,"A_cat_D+1":"Up \\"q\\"","summary":null}' in lines
    types = T.StructType([f for f in df.schema.fields if f.name != "ticker"])
    back = standardise_files(readers.read_ticker_lines(spark, path), types, "news_id", "summary")
    assert back.columns == ["ticker", "event_id", "ret_pct_d1", "cat_d1", "event_text"]
    assert sorted(map(tuple, back.collect())) == [("A", "n1", 0.5, 'Up "q"', None), ("A", "n3", None, "x", ""),
                                                  ("B_B", "n2", None, None, "text, with é")]
    assert "Union" not in plan(back)
