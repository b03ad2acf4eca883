"""SQL twins of the driver queries, for DuckDB over the same parquet tables.

They are written independently of the Spark code paths: the bindings are
re-expressed as CTEs, regexes use RE2 forms without look-around (RE2 has
none), and the answer parser's expected labels come from the answer *shape*,
not from parsing. Shared inputs are only the fixed values (patterns, phrase
list, thresholds, prompt text).
"""

from __future__ import annotations

import re

from eventlens.functions.answers import PROMPT_PREFIX, PROMPT_SUFFIX
from eventlens.functions.returns import CATEGORIZE_SQL
from eventlens.functions.text import CAUSAL_PHRASES, FILING_LIMITS, NEWS_LIMITS, WHITESPACE
from eventlens.operators.align import reference_name
from eventlens.plans import bindings as B

RETURN_OUT = ("adj_close", "ret_pct_d0", "cat_d0", "ret_pct_d1", "cat_d1", "ret_pct_d2", "cat_d2")
WORD = r"[^\p{L}\p{N}_]"  # not a word character (Python's \w for str)
TAG, NONE, ALL = "<[^>]+>", "", "g"


def _re2_class(chars: str) -> str:
    """RE2 character class of ``chars`` (consecutive code points as ranges)."""
    cps, out, i = sorted(ord(c) for c in chars), [], 0
    while i < len(cps):
        j = i
        while j + 1 < len(cps) and cps[j + 1] == cps[j] + 1:
            j += 1
        out.append(f"\\x{{{cps[i]:x}}}" + (f"-\\x{{{cps[j]:x}}}" if j > i else ""))
        i = j + 1
    return "[" + "".join(out) + "]"


# Python's whitespace (str.isspace / re's \s for str): RE2's \s is ASCII only.
WS = _re2_class(WHITESPACE)
WS_NOT_NL = _re2_class(WHITESPACE.replace("\n", ""))
WS_CHARS = "(" + " || ".join(f"chr({ord(c)})" for c in WHITESPACE) + ")"


def lit(s: str) -> str:
    """SQL string literal (newlines kept as characters)."""
    return "'" + s.replace("'", "''") + "'"


def trimu(x: str) -> str:
    return f"trim({x}, {WS_CHARS})"


def strip_tags(x: str) -> str:
    return f"coalesce({trimu(f'regexp_replace({x}, {lit(TAG)}, {lit(NONE)}, {lit(ALL)})')}, '')"


def keyword(x: str) -> str:
    alt = "|".join(CAUSAL_PHRASES)
    return f"coalesce(regexp_matches(lower({x}), '(?:^|{WORD})(?:{alt})(?:$|{WORD})'), false)"


def cat(x: str) -> str:
    return re.sub(r"\bx\b", x, CATEGORIZE_SQL)


def r6(x: str, alias: str | None = None) -> str:
    return f"round({x}, 6) AS {alias or x}"


def ticker_of(doc_id: str) -> str:
    whens = " ".join(f"WHEN {i} THEN {lit(t)}" for i, t in enumerate(B.TICKERS))
    return f"CASE {doc_id} % 5 {whens} END"


def boilerplate_ctes(src: str, x: str, prefix: str) -> tuple[list[str], str]:
    """F3 as CTE stages: returns (ctes, last cte); adds column ``{prefix}_b``."""
    pats = [r"(?is)The information contained in this Current Report.*?shall not be deemed.*?filed.*?\.",
            r"(?is)Pursuant to the requirements of the Securities Exchange Act of 1934.*?\.",
            r"(?is)SIGNATURES.*$",
            r"(?im)Exhibit" + WS + r"*\d+\.\d+.*$"]
    ctes, prev, col = [], src, x
    for i, p in enumerate(pats):
        name = f"{prefix}_bp{i}"
        ctes.append(f"{name} AS (SELECT *, {trimu(f'regexp_replace({col}, {lit(p)}, {lit(NONE)}, {lit(ALL)})')} "
                    f"AS {prefix}_b{i} FROM {prev})")
        prev, col = name, f"{prefix}_b{i}"
    ctes.append(f"{prefix}_bpx AS (SELECT *, {col} AS {prefix}_b FROM {prev})")
    return ctes, f"{prefix}_bpx"


def sentences_expr(x: str, n: int) -> str:
    marked = rf"regexp_replace({x}, '([.!?]){WS}+([A-Z])', '\1' || chr(1) || '\2', 'g')"
    return trimu(f"array_to_string(list_slice(string_split({marked}, chr(1)), 1, {n}), ' ')")


def truncate_expr(x: str, m: int) -> str:
    head = f"left({x}, {m})"
    by_dot = f"left({head}, length({head}) - strpos(reverse({head}), '.')) || '.'"
    by_space = (f"(CASE WHEN strpos({head}, ' ') > 0 THEN left({head}, length({head}) - "
                f"strpos(reverse({head}), ' ')) ELSE {head} END) || '...'")
    return (f"CASE WHEN length({x}) > {m} THEN (CASE WHEN strpos({head}, '.') > 0 THEN {by_dot} "
            f"ELSE {by_space} END) ELSE {x} END")


def clean_ctes(src: str, x: str, prefix: str, limits: tuple[int, int]) -> tuple[list[str], str]:
    """F6 as CTE stages over ``src``; adds column ``{prefix}_clean``."""
    m, n = limits
    ctes, last = boilerplate_ctes(src, x, prefix)
    ctes.append(f"{prefix}_s AS (SELECT *, {sentences_expr(prefix + '_b', n)} AS {prefix}_sent FROM {last})")
    ctes.append(f"{prefix}_t AS (SELECT *, {truncate_expr(prefix + '_sent', m)} AS {prefix}_trunc FROM {prefix}_s)")
    ctes.append(
        f"{prefix}_c AS (SELECT *, CASE WHEN {x} IS NULL THEN 'N/A' "
        f"WHEN {x} = 'N/A' OR {trimu(x)} = '' THEN {x} "
        f"WHEN {prefix}_trunc = '' THEN 'N/A (Cleaned to empty)' ELSE {prefix}_trunc END AS {prefix}_clean "
        f"FROM {prefix}_t)")
    return ctes, f"{prefix}_c"


# ------------------------------------------------------------------ bindings as CTEs
BARS = """bars AS (
  SELECT upper(event_type) AS ticker, CAST(ts AS DATE) AS trade_date,
         first(value ORDER BY ts, event_id) AS open, max(value) AS high, min(value) AS low,
         last(value ORDER BY ts, event_id) AS close, CAST(count(*) AS BIGINT) AS volume,
         last(value ORDER BY ts, event_id) AS adj_close
  FROM events GROUP BY 1, 2)"""


def returns_ctes(src: str = "bars", name: str = "rets") -> str:
    cats = ", ".join(f"{cat(f'ret_pct_d{i}')} AS cat_d{i}" for i in (0, 1, 2))
    return f"""{name}_w AS (
  SELECT *, lag(adj_close) OVER w AS _p0, lead(adj_close, 1) OVER w AS _n1,
         lead(adj_close, 2) OVER w AS _n2
  FROM {src} WINDOW w AS (PARTITION BY ticker ORDER BY trade_date)),
{name}_r AS (
  SELECT ticker, trade_date, open, high, low, close, adj_close, volume,
         CASE WHEN _p0 = 0 THEN NULL ELSE (adj_close / _p0 - 1) * 100 END AS ret_pct_d0,
         CASE WHEN adj_close = 0 THEN NULL ELSE (_n1 / adj_close - 1) * 100 END AS ret_pct_d1,
         CASE WHEN adj_close = 0 THEN NULL ELSE (_n2 / adj_close - 1) * 100 END AS ret_pct_d2
  FROM {name}_w),
{name} AS (SELECT *, {cats} FROM {name}_r)"""


def news_ctes() -> str:
    desc = (f"CASE WHEN doc_id % 11 = 10 THEN text WHEN doc_id % 3 = 0 THEN "
            f"{lit(B.CAUSAL_LEAD + ' ')} || text ELSE text END")
    day = f"CAST(DATE '{B.NEWS_EPOCH}' + CAST(doc_id % {B.NEWS_DAYS} AS INTEGER) AS DATE)"
    stamp = (f"CASE WHEN doc_id % 37 = 36 THEN 'not a date' WHEN doc_id % 2 = 0 "
             f"THEN CAST({day} AS VARCHAR) || 'T10:00:00.000Z' ELSE CAST({day} AS VARCHAR) || 'T10:00:00Z' END")
    base = f"""news_in AS (
  SELECT doc_id, text, source,
         TRY_CAST(replace(split_part({stamp}, '.', 1), 'Z', '') AS TIMESTAMP) AS published_ts
  FROM documents),
news_src AS (
  SELECT CAST(doc_id AS VARCHAR) AS news_id, {ticker_of('doc_id')} AS ticker,
         CAST(published_ts AS DATE) AS published_date_utc,
         {strip_tags(f"'<b>' || source || '</b> report ' || CAST(doc_id AS VARCHAR)")} AS title,
         {strip_tags(desc)} AS summary_raw
  FROM news_in WHERE published_ts IS NOT NULL)"""
    ctes, last = clean_ctes("news_src", "summary_raw", "nw", NEWS_LIMITS)
    final = f"""news AS (
  SELECT news_id, ticker, published_date_utc,
         strftime(CAST(published_date_utc AS TIMESTAMP) + INTERVAL 10 HOUR, '%Y-%m-%dT%H:%M:%S') AS published_datetime_utc,
         title, nw_clean AS summary, {keyword('nw_clean')} AS has_causal_keyword
  FROM {last})"""
    return ",\n".join([base, *ctes, final])


def filing_raw_expr() -> str:
    tail = ("\nThe information contained in this Current Report shall not be deemed filed "
            "for any purpose.\nItem 9.01 Financial Statements and Exhibits.\n"
            "Exhibit 99.1 Press release of the company\n"
            "Pursuant to the requirements of the Securities Exchange Act of 1934, the "
            "registrant has duly signed this report.\nSIGNATURES\nBy: Officer")
    code = "CASE doc_id % 8 " + " ".join(f"WHEN {i} THEN {lit(c)}" for i, c in enumerate(B.FILING_8K_CODES)) + " END"
    return (f"CASE WHEN doc_id % 8 < 5 THEN {lit('Cover page.' + chr(10) + 'Item 8.01 Other Events. Notice given.' + chr(10) + 'Item ')} "
            f"|| {code} || ' Results. ' || text || {lit(tail)} "
            f"WHEN doc_id % 8 = 5 THEN {lit('Cover page.' + chr(10) + 'ITEM 3.03 Rights. ')} || text || {lit(tail)} "
            f"WHEN doc_id % 8 = 6 THEN 'Cover page. ' || text || {lit(tail)} "
            f"ELSE {lit('Annual report.' + chr(10) + 'Item 7. Management' + chr(39) + 's Discussion and Analysis of Results. ')} "
            f"|| text || {lit(chr(10) + 'Item 8. Financial Statements.' + chr(10) + 'SIGNATURES' + chr(10) + 'By: Officer')} END")


# Python's (and Java's, with UNIX_LINES) "$" also matches just before a final
# newline; RE2's only at the very end, hence "\n?$".
def item_expr(x: str, code: str) -> str:
    c = code.replace(".", r"\.")
    return rf"nullif(regexp_extract({x}, '(?is)(Item{WS}+{c}.+?)(?:Item{WS}+\d\.|\n?$)', 1), '')"


def any_item_expr(x: str) -> str:
    return rf"nullif(regexp_extract({x}, '(?is)(ITEM{WS}*\d+\.\d+.+?)(?:ITEM{WS}*\d+\.\d+|\n?$)', 1), '')"


def mdna_expr(x: str) -> str:
    return (rf"nullif(regexp_extract({x}, '(?is)(Item{WS}+7\.?{WS}*Management''s Discussion and Analysis.+?)"
            rf"(?:Item{WS}+[78]\.|Item{WS}+\d{{2}}\.)', 1), '')")


def items_8k(x: str) -> str:
    return f"coalesce({', '.join(item_expr(x, c) for c in B.FILING_8K_CODES)}, {any_item_expr(x)}, {x})"


def section_expr(x: str, form: str) -> str:
    return (f"CASE WHEN upper({form}) = '8-K' THEN {items_8k(x)} "
            f"WHEN upper({form}) IN ('10-K', '10-Q') THEN coalesce({mdna_expr(x)}, {x}) ELSE {x} END")


def drop_blank_lines(x: str) -> str:
    return rf"regexp_replace({trimu(x)}, '\n(?:{WS_NOT_NL}*\n)+', chr(10), 'g')"


def filings_src() -> str:
    day = f"CAST(DATE '{B.NEWS_EPOCH}' + CAST((doc_id * 7) % {B.FILING_DAYS} AS INTEGER) AS DATE)"
    return f"""fil_src AS (
  SELECT doc_id, {ticker_of('doc_id')} AS ticker,
         '0000000000-24-' || lpad(CAST(doc_id AS VARCHAR), CAST(greatest(6, length(CAST(doc_id AS VARCHAR))) AS INTEGER), '0') AS id,
         CASE WHEN doc_id % 41 = 40 THEN 'n/a' ELSE CAST({day} AS VARCHAR) END AS filing_date_text,
         CASE WHEN doc_id % 8 = 7 THEN '10-K' ELSE '8-K' END AS form,
         {filing_raw_expr()} AS full_filing_text
  FROM documents)"""


def filings_ctes() -> str:
    base = f"""fil_t AS (
  SELECT id AS filing_id, ticker, TRY_CAST(filing_date_text AS DATE) AS filing_date,
         {section_expr(drop_blank_lines('full_filing_text'), 'form')} AS section
  FROM fil_src WHERE TRY_CAST(filing_date_text AS DATE) IS NOT NULL)"""
    ctes, last = clean_ctes("fil_t", "section", "fl", FILING_LIMITS)
    final = f"""filings AS (
  SELECT filing_id, ticker, filing_date, fl_clean AS item_text,
         {keyword('fl_clean')} AS has_causal_keyword FROM {last})"""
    return ",\n".join([filings_src(), base, *ctes, final])


def answers_ctes() -> str:
    yn = lambda v: f"CASE WHEN {v} = 1 THEN 'Yes' ELSE 'No' END"
    tf = lambda v: f"CASE WHEN {v} = 1 THEN 'true' ELSE 'false' END"
    obj = (f"""'{{"causal": "' || {yn('pc')} || '", "assoc": "' || {yn('pa')} || '", "cause": " demand ' """
           f"""|| CAST(doc_id AS VARCHAR) || ' ", "effect": "price"}}'""")
    raw = (f"CASE shape WHEN 0 THEN {obj} "
           f"""WHEN 1 THEN 'Sure. {{"a" oops}} Here: {{"causal": ' || {tf('pc')} || ', "assoc": "' || lower({yn('pa')}) || '", "cause": "x"}} done' || repeat('z', 300) """
           f"WHEN 2 THEN {lit('```json' + chr(10))} || {obj} || {lit(chr(10) + '```')} "
           f"""WHEN 3 THEN '{{''causal'': ''' || {yn('pc')} || ''', ''assoc'': ''' || {yn('pa')} || '''}}' """
           f"""WHEN 4 THEN '{{"causal": "' || upper({yn('pc')}) || '", "assoc" : "' || lower({yn('pa')}) || '", "cause": "trunc' """
           f"""ELSE '{{"causal": ' || {tf('pc')} || ', "assoc": ' || {tf('pa')} || ', "cause": null}}' END""")
    return f"""ans_base AS (
  SELECT l.doc_id, m.model, CASE WHEN m.model = 'm3' THEN 3 ELSE (l.doc_id + m.shift) % 6 END AS shape,
         CASE WHEN l.doc_id % 4 = 0 THEN 1 - l.quality ELSE l.quality END AS pc,
         CASE WHEN l.doc_id % 5 = 0 THEN 1 - l.toxic ELSE l.toxic END AS pa,
         CASE l.quality WHEN 1 THEN 'Yes' WHEN 0 THEN 'No' ELSE '' END AS ground_causal,
         CASE l.toxic WHEN 1 THEN 'Yes' WHEN 0 THEN 'No' ELSE '' END AS ground_assoc
  FROM labels l CROSS JOIN (VALUES ('m1', 0), ('m2', 3), ('m3', 0)) AS m(model, shift)),
parsed AS (
  SELECT model, CAST(doc_id AS VARCHAR) AS event_id, {ticker_of('doc_id')} AS ticker,
         ground_causal, ground_assoc,
         CASE WHEN shape IN (2, 3) THEN 'ParseErr_Causal' ELSE {yn('pc')} END AS causal_llm_pred,
         CASE WHEN shape IN (2, 3) THEN 'ParseErr_Assoc' ELSE {yn('pa')} END AS assoc_llm_pred,
         CASE shape WHEN 0 THEN 'demand ' || CAST(doc_id AS VARCHAR) WHEN 1 THEN 'x'
                    WHEN 5 THEN 'None' ELSE 'N/A' END AS cause_llm_pred,
         CASE shape WHEN 0 THEN 'price' ELSE 'N/A' END AS effect_llm_pred,
         left({raw}, 300) AS raw_llm
  FROM ans_base)"""


METRICS = """long AS (
  SELECT model, 'causal' AS target, ground_causal AS truth, causal_llm_pred AS pred FROM parsed
  UNION ALL SELECT model, 'assoc', ground_assoc, assoc_llm_pred FROM parsed),
agg AS (
  SELECT model, target,
         count(*) FILTER (WHERE truth IN ('Yes','No') AND pred IN ('Yes','No')) AS n_valid,
         count(*) FILTER (WHERE truth IN ('Yes','No') AND pred IN ('Yes','No') AND truth = pred) AS correct,
         count(*) FILTER (WHERE truth IN ('Yes','No') AND truth = 'Yes' AND pred = 'Yes') AS tp,
         count(*) FILTER (WHERE truth IN ('Yes','No') AND truth = 'No' AND pred = 'Yes') AS fp,
         count(*) FILTER (WHERE pred IN ('Yes','No') AND truth = 'Yes' AND pred = 'No') AS fn
  FROM long GROUP BY model, target),
metrics AS (
  SELECT model, target, CAST(n_valid AS BIGINT) AS n_valid,
         CASE WHEN n_valid > 0 THEN correct / n_valid END AS accuracy,
         CASE WHEN n_valid > 0 THEN coalesce(tp / nullif(tp + fp, 0), 0.0) END AS precision,
         CASE WHEN n_valid > 0 THEN coalesce(tp / nullif(tp + fn, 0), 0.0) END AS recall,
         CASE WHEN n_valid > 0 THEN coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0.0) END AS f1
  FROM agg)"""


def aligned_news() -> str:
    return f"""aligned AS (
  SELECT n.*, n.published_date_utc AS event_date, r.adj_close, r.ret_pct_d0, r.cat_d0,
         r.ret_pct_d1, r.cat_d1, r.ret_pct_d2, r.cat_d2
  FROM news n LEFT JOIN rets r ON n.ticker = r.ticker AND n.published_date_utc = r.trade_date)"""


def aligned_filings() -> str:
    return """aligned_f AS (
  SELECT f.*, f.filing_date AS event_date, r.adj_close, r.ret_pct_d0, r.cat_d0,
         r.ret_pct_d1, r.cat_d1, r.ret_pct_d2, r.cat_d2
  FROM filings f LEFT JOIN rets r ON f.ticker = r.ticker AND f.filing_date = r.trade_date)"""


def w(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


RET_SELECT = ", ".join(r6(c) if c.startswith(("adj", "ret")) else c for c in RETURN_OUT)
NEWS_ALIGNED = (BARS, returns_ctes(), news_ctes(), aligned_news())


def _wide_cols() -> str:
    out = []
    for t in B.TICKERS:
        for c in RETURN_OUT:
            v = f"CASE WHEN ticker = {lit(t)} THEN {c} END"
            name = f'"{t}_{reference_name(c)}"'
            out.append(f"round({v}, 6) AS {name}" if not c.startswith("cat") else f"{v} AS {name}")
    return ", ".join(out)


def _bench_select() -> str:
    a = "CASE WHEN cat_d1 IN ('Significant Up', 'Significant Down') THEN 'Yes' ELSE 'No' END"
    c = "CASE WHEN has_causal_keyword THEN 'Yes' ELSE 'No' END"
    k = "CASE WHEN has_causal_keyword THEN 'keyword' ELSE 'none' END"
    raw = (f"""'{{"assoc":"' || {a} || '","causal":"' || {c} || '","cause":"' || {k} || '","effect":"' || """
           f"""coalesce(cat_d1, 'N/A') || '"}}'""")
    return a, c, k, raw


_A, _C, _K, _RAW = _bench_select()

LATEST_IDX = """idx AS (
  SELECT CAST(o_custkey AS VARCHAR) AS cik, o_orderkey,
         lpad(CAST(o_custkey AS VARCHAR), CAST(greatest(10, length(CAST(o_custkey AS VARCHAR))) AS INTEGER), '0') || '-' || strftime(o_orderdate, '%y') || '-' || lpad(CAST(o_orderkey AS VARCHAR), CAST(greatest(6, length(CAST(o_orderkey AS VARCHAR))) AS INTEGER), '0') AS accession,
         CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS filing_date,
         'doc' || CAST(o_orderkey AS VARCHAR) || '.htm' AS primary_document,
         row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS rn
  FROM orders WHERE o_orderpriority = '1-URGENT'),
latest AS (
  SELECT accession AS id, filing_date,
         'https://www.sec.gov/Archives/edgar/data/' || cik || '/' || replace(accession, '-', '') || '/' || primary_document AS html_url,
         cik, CAST(rn AS BIGINT) AS rank, o_orderkey
  FROM idx WHERE rn <= 5)"""
LATEST_FILINGS_SQL = "WITH " + LATEST_IDX + "\nSELECT id, filing_date, html_url, cik, rank FROM latest"
_PCT = lambda m: f"printf('%.2f%%', {m} * 100) AS {m}_pct"

ORACLE = {
    "daily_returns": w(BARS, returns_ctes()) + "SELECT ticker, trade_date, " + ", ".join(
        r6(c) for c in ("open", "high", "low", "close", "adj_close")) + ", volume, " + ", ".join(
        r6(f"ret_pct_d{i}") + f", cat_d{i}" for i in (0, 1, 2)) + " FROM rets",
    "return_categories": w(BARS, returns_ctes()) + """SELECT ticker, horizon, category, CAST(count(*) AS BIGINT) AS n_days FROM (
  SELECT ticker, 'D0' AS horizon, cat_d0 AS category FROM rets UNION ALL
  SELECT ticker, 'D+1', cat_d1 FROM rets UNION ALL SELECT ticker, 'D+2', cat_d2 FROM rets)
GROUP BY 1, 2, 3""",
    "price_range_prune": w(f"""obars AS (SELECT {ticker_of('l_suppkey')} AS ticker, CAST(l_shipdate AS DATE) AS trade_date,
  max(l_extendedprice) AS adj_close FROM lineitem GROUP BY 1, 2)""",
                           f"""bounds AS (SELECT {ticker_of('o_custkey')} AS ticker, min(CAST(o_orderdate AS DATE)) - 30 AS lo,
  max(CAST(o_orderdate AS DATE)) + 30 AS hi FROM orders GROUP BY 1)""")
    + "SELECT b.ticker, b.trade_date, round(b.adj_close, 6) AS adj_close FROM obars b JOIN bounds s "
      "ON b.ticker = s.ticker WHERE b.trade_date >= s.lo AND b.trade_date < s.hi",
    "returns_from_raw_bars": w(BARS, """raw_bars AS (SELECT ticker,
  CASE WHEN ticker = 'ERROR' AND day(trade_date) = 15 THEN '2024-13-45' ELSE CAST(trade_date AS VARCHAR) END AS date_text,
  open, high, low, close,
  CASE WHEN day(trade_date) = 10 THEN 'n/a' ELSE CAST(adj_close AS VARCHAR) END AS adj_text, volume FROM bars),
bars2 AS (SELECT ticker, TRY_CAST(date_text AS DATE) AS trade_date, open, high, low, close,
  TRY_CAST(adj_text AS DOUBLE) AS adj_close, volume FROM raw_bars
  WHERE TRY_CAST(date_text AS DATE) IS NOT NULL)""", returns_ctes("bars2"))
    + "SELECT ticker, trade_date, " + ", ".join(
        r6(c) for c in ("open", "high", "low", "close", "adj_close")) + ", volume, " + ", ".join(
        r6(f"ret_pct_d{i}") + f", cat_d{i}" for i in (0, 1, 2)) + " FROM rets",
    "align_events": w(*NEWS_ALIGNED) + f"SELECT news_id, ticker, event_date, has_causal_keyword, {RET_SELECT} FROM aligned",
    "align_empty_prices": w(news_ctes()) + """SELECT news_id, ticker, published_date_utc AS event_date,
  CAST(NULL AS DOUBLE) AS adj_close, CAST(NULL AS DOUBLE) AS ret_pct_d0, CAST(NULL AS VARCHAR) AS cat_d0,
  CAST(NULL AS DOUBLE) AS ret_pct_d1, CAST(NULL AS VARCHAR) AS cat_d1,
  CAST(NULL AS DOUBLE) AS ret_pct_d2, CAST(NULL AS VARCHAR) AS cat_d2 FROM news""",
    "align_wide_prefixed": w(*NEWS_ALIGNED) + f"SELECT news_id, ticker, event_date, {_wide_cols()} FROM aligned",
    "align_all_tickers": w(*NEWS_ALIGNED, filings_ctes(), aligned_filings())
    + """SELECT 'news' AS source, news_id AS event_id, ticker, strftime(event_date, '%Y-%m-%d') AS event_date,
  has_causal_keyword, cat_d0, cat_d1, cat_d2 FROM aligned
UNION ALL SELECT 'filings', filing_id, ticker, strftime(event_date, '%Y-%m-%d'), has_causal_keyword,
  cat_d0, cat_d1, cat_d2 FROM aligned_f""",
    "strip_tags": f"SELECT page_id, {strip_tags('html')} AS text FROM pages",
    "keyword_screen": w(news_ctes()) + """SELECT ticker, CAST(count(*) FILTER (WHERE has_causal_keyword) AS BIGINT) AS n_keyword,
  CAST(count(*) AS BIGINT) AS n_events FROM news GROUP BY ticker""",
    "clean_boilerplate": w(filings_src(), *boilerplate_ctes("fil_src", "full_filing_text", "cb")[0])
    + "SELECT id, cb_b AS cleaned FROM cb_bpx",
    "first_sentences": f"SELECT doc_id, {sentences_expr('text', NEWS_LIMITS[1])} AS sentences FROM documents",
    "truncate_text": f"SELECT doc_id, {truncate_expr('text', 300)} AS truncated FROM documents",
    "clean_text": w("docs AS (SELECT doc_id, text FROM documents)",
                    *clean_ctes("docs", "text", "ct", NEWS_LIMITS)[0])
    + "SELECT doc_id, ct_clean AS cleaned FROM ct_c",
    "publish_time": w(news_ctes()) + "SELECT news_id, published_datetime_utc, published_date_utc FROM news",
    "news_events": w(news_ctes()) + """SELECT news_id, ticker, published_datetime_utc, published_date_utc, title,
  summary, has_causal_keyword FROM news""",
    "filing_sections": w(filings_src()) + f"SELECT id, form, {section_expr(drop_blank_lines('full_filing_text'), 'form')} AS section FROM fil_src",
    "mdna_sections": w(filings_src()) + f"SELECT id, coalesce({mdna_expr(drop_blank_lines('full_filing_text'))}, {drop_blank_lines('full_filing_text')}) AS section FROM fil_src",
    "item_sections": w(filings_src(), f"fs AS (SELECT id, {drop_blank_lines('full_filing_text')} AS t FROM fil_src)")
    + f"SELECT id, {items_8k('t')} AS section FROM fs",
    "filing_events": w(filings_ctes()) + "SELECT filing_id, ticker, filing_date, item_text, has_causal_keyword FROM filings",
    "latest_filings": LATEST_FILINGS_SQL,
    "annotation_sheet": w(*NEWS_ALIGNED) + "SELECT news_id, ticker, event_date, cat_d1, '' AS causal_label, '' AS assoc_label FROM aligned",
    "standardise_union": w(*NEWS_ALIGNED, filings_ctes(), aligned_filings())
    + """SELECT news_id AS event_id, ticker, event_date, summary AS event_text, title, cat_d1, 'news' AS source FROM aligned
UNION ALL BY NAME SELECT filing_id AS event_id, ticker, event_date, item_text AS event_text, cat_d1, 'filings' AS source FROM aligned_f""",
    "prompts": w(*NEWS_ALIGNED) + f"""SELECT news_id AS event_id,
  {lit(PROMPT_PREFIX)} || '{{"event": ' || coalesce(to_json(left(summary, 1024)), 'null') || ', "reaction": '
  || coalesce(to_json(cat_d1), 'null') || '}}' || {lit(PROMPT_SUFFIX)} AS prompt FROM aligned""",
    "parse_answers": w(answers_ctes()) + "SELECT * FROM parsed",
    "predict_keyword": w(*NEWS_ALIGNED) + f"""SELECT 'keyword' AS model, news_id AS event_id, {_C} AS causal_llm_pred,
  {_A} AS assoc_llm_pred, {_K} AS cause_llm_pred, coalesce(cat_d1, 'N/A') AS effect_llm_pred FROM aligned""",
    "score_models": w(answers_ctes(), METRICS) + "SELECT model, target, n_valid, " + ", ".join(
        r6(m) for m in ("accuracy", "precision", "recall", "f1")) + " FROM metrics",
    "benchmark_end_to_end": w(*NEWS_ALIGNED) + f"""SELECT 'keyword' AS model, a.news_id AS event_id, a.ticker,
  coalesce(CASE l.quality WHEN 1 THEN 'Yes' WHEN 0 THEN 'No' END, '') AS ground_causal,
  coalesce(CASE l.toxic WHEN 1 THEN 'Yes' WHEN 0 THEN 'No' END, '') AS ground_assoc,
  {_C} AS causal_llm_pred, {_A} AS assoc_llm_pred, left({_RAW}, 300) AS raw_llm
FROM aligned a LEFT JOIN labels l ON a.news_id = CAST(l.doc_id AS VARCHAR)""",
    "score_report": w(answers_ctes(), METRICS) + "SELECT model, target, n_valid, " + ", ".join(
        _PCT(m) for m in ("accuracy", "precision", "recall", "f1")) + " FROM metrics",
    "convert_columns": w(answers_ctes()) + """SELECT model, event_id, raw_llm AS event, ground_causal,
  cause_llm_pred AS ground_cause, effect_llm_pred AS ground_effect FROM parsed""",
    "jsonl_roundtrip": w(*NEWS_ALIGNED) + f"SELECT news_id, ticker, event_date, has_causal_keyword, {RET_SELECT} FROM aligned",
    "results_glob": w(answers_ctes()) + "SELECT model, event_id, ground_causal, causal_llm_pred, assoc_llm_pred, raw_llm FROM parsed",
    "macro_series": """SELECT CAST(o_orderdate AS DATE) AS date,
  CAST(sum(CAST(o_totalprice AS DECIMAL(18, 2))) AS DOUBLE) / count(*) AS CPIAUCSL
FROM orders GROUP BY 1""",
    "row_counts": " UNION ALL ".join(
        f"SELECT '{t}' AS table_name, CAST(count(*) AS BIGINT) AS n_rows FROM {t}" for t in B.TABLES),
    "first_rows": "SELECT doc_id, lang, source, n_chars FROM documents ORDER BY doc_id LIMIT 10",
    "schema_guard": w(*NEWS_ALIGNED) + "SELECT news_id AS event_id, round(ret_pct_d1, 6) AS ret_pct_d1, cat_d1 AS reaction, '' AS ground_causal FROM aligned",
    "sql_functions": w(BARS, returns_ctes()) + f"""SELECT ticker, trade_date, {cat('ret_pct_d1')} AS cat_d1,
  ticker || ' ' || CAST(trade_date AS VARCHAR) AS label, day(trade_date) % 2 = 0 AS flagged FROM rets""",
}
ORACLE["sql_clean_text"] = ORACLE["clean_text"]
# CSV writes empty strings and nulls alike, so empty labels read back as null
# (as a pandas round trip turns '' into NaN).
ORACLE["csv_roundtrip"] = w(*NEWS_ALIGNED) + """SELECT news_id, ticker, event_date, cat_d1,
  CAST(NULL AS VARCHAR) AS causal_label, CAST(NULL AS VARCHAR) AS assoc_label, summary FROM aligned"""
ORACLE["landing_roundtrip"] = w(news_ctes()) + """SELECT news_id, published_datetime_utc, published_date_utc,
  title, summary, has_causal_keyword FROM news"""
ORACLE["stream_news_events"] = ORACLE["align_events"]
# HTML -> text for the generated pages: every page has a <body> and no
# <document>, and nothing dropped (script/style/title/...) sits inside the body,
# so the text nodes are the pieces between tags of the body; comments end a
# node; the entities present are decoded ("&amp" also without its ";" when
# the name ends there, as the tokenizer reads it).
_ENTITIES = (("&copy;", "©"), ("&middot;", "·"), ("&quot;", '"'), ("&lt;", "<"), ("&gt;", ">"))


def _decode(x: str) -> str:
    for ent, ch in _ENTITIES:
        x = f"replace({x}, {lit(ent)}, {lit(ch)})"
    # "&amp" is a whole entity name when followed by ";", by a character that
    # cannot continue a name, or by the end of the text node (a tag follows);
    # pieces between "&"s are decided one by one, so "&amp&amp" decodes twice
    piece = (r"CASE WHEN i = 1 THEN p WHEN regexp_matches(p, '^amp(;|[^-.a-zA-Z0-9]|$)') "
             r"THEN '&' || regexp_replace(p, '^amp;?', '') ELSE '&' || p END")
    return f"array_to_string(list_transform(string_split({x}, '&'), lambda p, i: {piece}), '')"


PAGE_TEXT = f"""body AS (
  SELECT page_id,
         regexp_replace(regexp_replace(regexp_extract(html, '(?s)<body[^>]*>(.*)', 1),
                        '(?s)</body>.*$', ''), '(?s)<!--.*?-->', '<c>', 'g') AS b
  FROM pages),
nodes AS (
  SELECT page_id, list_filter(list_transform(regexp_split_to_array(b, '</?[A-Za-z][^>]*>'),
                                             lambda x: {trimu(_decode('x'))}),
                              lambda x: x <> '') AS parts
  FROM body),
page_text AS (
  SELECT page_id, {drop_blank_lines("array_to_string(parts, chr(10))")} AS text FROM nodes)"""
ORACLE["html_text"] = "WITH " + PAGE_TEXT + "\nSELECT page_id, text FROM page_text"
# Landed pages are stored under the URL of the order whose key is the page id.
ORACLE["filings_with_text"] = "WITH " + LATEST_IDX + ",\n" + PAGE_TEXT + """
SELECT l.html_url, l.id, l.filing_date, l.cik, l.rank, t.text AS full_filing_text
FROM latest l LEFT JOIN page_text t ON t.page_id = l.o_orderkey"""
# JSON Lines and CSV hand-overs change nothing but empty labels.
ORACLE["align_job"] = ORACLE["align_all_tickers"]
ORACLE["score_from_files"] = ORACLE["score_models"]
ORACLE["convert_job"] = ORACLE["convert_columns"]
ORACLE["annotate_job"] = ORACLE["csv_roundtrip"]
ORACLE["benchmark_labelled"] = w(*NEWS_ALIGNED) + f"""SELECT 'keyword' AS model, a.news_id AS event_id, a.ticker,
  coalesce(CASE l.quality WHEN 1 THEN 'Yes' WHEN 0 THEN 'No' END, '') AS ground_causal,
  coalesce(CASE l.toxic WHEN 1 THEN 'Yes' WHEN 0 THEN 'No' END, '') AS ground_assoc,
  {_C} AS causal_llm_pred, {_A} AS assoc_llm_pred, coalesce(cat_d1, 'N/A') AS effect_llm_pred
FROM aligned a LEFT JOIN labels l ON a.news_id = CAST(l.doc_id AS VARCHAR)"""
ORACLE["landed_articles"] = f"""SELECT CAST(doc_id AS VARCHAR) AS news_id, {ticker_of('doc_id')} AS ticker,
  '<b>' || source || '</b> report ' || CAST(doc_id AS VARCHAR) AS title,
  CASE WHEN doc_id % 29 = 0 THEN NULL WHEN doc_id % 37 = 36 THEN 'not a date'
       ELSE CAST(CAST(DATE '{B.NEWS_EPOCH}' + CAST(doc_id % {B.NEWS_DAYS} AS INTEGER) AS DATE) AS VARCHAR)
            || CASE WHEN doc_id % 2 = 0 THEN 'T10:00:00.000Z' ELSE 'T10:00:00Z' END END AS published
FROM documents"""
# Out of its document root, without the dropped parts, the parser gets the filing's own text.
ORACLE["filing_events_html"] = ORACLE["filing_events"]
ORACLE["results_rerun"] = ORACLE["results_glob"]
WEEKDAY_BARS = BARS.replace("CAST(ts AS DATE) AS trade_date",
                            "CAST(ts AS DATE) + CASE dayofweek(ts) WHEN 6 THEN 2 WHEN 0 THEN 1 ELSE 0 END AS trade_date")
ORACLE["align_next_day"] = w(WEEKDAY_BARS, returns_ctes(), news_ctes(), """found AS (
  SELECT n.news_id, n.ticker, n.published_date_utc AS event_date,
         CASE WHEN r.trade_date - n.published_date_utc <= 5 THEN r.trade_date END AS trade_date
  FROM news n ASOF LEFT JOIN rets r ON n.ticker = r.ticker AND n.published_date_utc <= r.trade_date)""") + f"""
SELECT news_id, f.ticker, event_date, f.trade_date, {RET_SELECT} FROM found f
LEFT JOIN rets r ON f.ticker = r.ticker AND f.trade_date = r.trade_date"""
ORACLE["union_mixed_types"] = """
SELECT o_orderkey AS event_id, 'orders' AS source, CAST(o_orderkey AS VARCHAR) AS code, CAST(o_custkey AS DOUBLE) AS size,
  strftime(CAST(CAST(o_orderdate AS DATE) AS TIMESTAMP), '%Y-%m-%dT%H:%M:%S') AS at FROM orders
UNION ALL SELECT p_partkey, 'part', p_name, round(p_retailprice, 6), NULL FROM part
UNION ALL SELECT event_id, 'events', CAST(user_id % 2 = 0 AS VARCHAR), NULL, strftime(ts, '%Y-%m-%dT%H:%M:%S') FROM events"""
ORACLE["saved_counts"] = w(news_ctes(), filings_ctes()) + """SELECT 'load filings' AS step, CAST(count(*) AS BIGINT) AS n_rows FROM documents
UNION ALL SELECT 'load news', count(*) FROM documents
UNION ALL SELECT 'save filings', count(*) FROM filings UNION ALL SELECT 'save news', count(*) FROM news"""
ORACLE["predict_batched"] = ORACLE["predict_keyword"]
ORACLE["returns_from_price_table"] = ORACLE["daily_returns"]
ORACLE["landed_quarantine"] = """
SELECT 'read' AS kind, CAST(count(*) FILTER (doc_id % 31 <> 0) AS BIGINT) AS n FROM documents
UNION ALL SELECT 'broken', count(*) FILTER (doc_id % 31 = 0) FROM documents
UNION ALL SELECT 'counted good', count(*) FILTER (doc_id % 31 <> 0) FROM documents
UNION ALL SELECT 'counted broken', count(*) FILTER (doc_id % 31 = 0) FROM documents"""
ORACLE["landed_pages_check"] = "SELECT CAST(doc_id AS VARCHAR) AS news_id FROM documents"
