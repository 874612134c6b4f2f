"""The driver's queries of the verification operators, over whole tables, and SQL for the same rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from veritrail.functions import numbers as N, scoring as S, text as T
from veritrail.operators import blocks as B, claims as C, index as I, match as M, retrieve as R
from veritrail.plans import decisions as D, payload as O, review as V, verify as P
from veritrail.sources import tables as X
from veritrail.sources.encoded import read_encoded
from veritrail.sources.objects import write_objects
from veritrail.sources.staging import shared_folder, spread, staged


#: Tables whose rows have work in them: texts, and what reports are made from.
WORK = ("conversations", "documents", "orders", "pages")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    scan = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(scan) if name in WORK else scan


def reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A conversation's assistant turns, as one report."""
    turns = table(spark, sf_dir, "conversations").where("role = 'assistant'")
    return turns.groupBy(F.col("conv_id").alias("case_id")).agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("t")).select("case_id", F.array_join("t.text", "\n\n").alias("text"))


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The other turns, as its source's pages."""
    return table(spark, sf_dir, "conversations").where("role <> 'assistant'").select(F.col("conv_id").alias("case_id"), (F.col("turn") + 1).cast("int").alias("page"), "text")


def turn_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assistant turns, each one claim."""
    return table(spark, sf_dir, "conversations").where("role = 'assistant'").select(F.col("conv_id").alias("case_id"), F.col("turn").cast("int").alias("claim_id"), F.col("text").alias("claim_norm"))


def page_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.chunks(pages(spark, sf_dir), "pdf")


def sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order told as a sentence, and the same order's sentence with the other trend."""
    price = F.format_number(F.floor("o_totalprice"), 0)
    told = lambda up, down: F.concat(F.year("o_orderdate").cast("string"), F.lit("년 매출액은 "), price, F.lit("백만원으로 전년 대비 "), F.when(F.col("o_orderkey") % 2 == 0, up).otherwise(down), F.lit("했다."))
    other = F.when(F.col("o_orderkey") % 3 == 0, told("감소", "증가")).otherwise(told("증가", "감소"))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("case_id"), told("증가", "감소").alias("claim"), other.alias("evidence"), F.concat(price, F.lit("백만원")).alias("token"), F.floor("o_totalprice").cast("double").alias("price"))


SENTENCES = """s AS (SELECT o_orderkey, o_custkey AS case_id, y || '년 매출액은 ' || p || '백만원으로 전년 대비 ' || CASE WHEN o_orderkey % 2 = 0 THEN '증가' ELSE '감소' END || '했다.' AS claim,
 y || '년 매출액은 ' || p || '백만원으로 전년 대비 ' || CASE WHEN (o_orderkey % 2 = 0) = (o_orderkey % 3 <> 0) THEN '증가' ELSE '감소' END || '했다.' AS evidence, p || '백만원' AS token, v, y, p
 FROM (SELECT o_orderkey, o_custkey, CAST(year(o_orderdate) AS VARCHAR) AS y, CAST(floor(o_totalprice) AS BIGINT) AS v, format('{:,}', CAST(floor(o_totalprice) AS BIGINT)) AS p FROM orders))"""


#: Lines of every kind that the claims', blocks' and text functions tell apart; {n} is an order's amount.
LINES = (
    "# Head {n}", "- ## under {n}", "* + # deep", "\\# escaped", "plain # inside {n}", "  ### spaced", "-# no space", "1. Title words", "12. 매출 현황", "{n}. Outlook", "3. Title with 9 digits", "4. a title that is far too long to be one of them",
    "---", "   ***", "    ***", "____  ", "-- -", "--- x", "| 거래구분 | 과목 | 금액 | 기한 | 담보 | 신용 | 보증인 |", "| 거래구분 | 과목 | 금액 | 기한 | 담보 | 신용 |", "- | 거래구분 | 과목 | 금액 | 기한 | 담보 | 신용 | 보증인 | x |", "거래구분 | 과목 | 금액 | 기한 | 담보 | 신용 | 보증인 |",
    "| 총자산 | 자기자본 | 매출액 | 영업이익 | x |", "| 총자산 | 총자산 | 총자산 | 총자산 |", "| 총자산 | 자기자본 | 매출액 | y |", "| 2020 | {n} | 1,234 | 5.6% | 7 | 8 | 9 |", "| 2021 | {n} | 2 | 3 | 4 | 5 | 6 | 7 |", "| 1999 | 1 | 2 | 3 | 4 | 5 | 6 |", "| 2020 | - | ? | 3% | 4 | 5 | 6 | 7 |", "| 1820 | 1% | 2 | 3 | 4 | 5 | 6 |", "| 2022 | a | b | 3% | 4 | 5 | 6 |",
    "a\u00a0b\u2009c％ of {n}", "zero\u200bwidth\ufeff", "what?is?this? no? x", "full．stop，comma＃", "\ufffd bad <tag> & 'quoted' \"twice\"", "U.S. output rose a lot. It fell by 3.5 then.", "Sales rose (+) to {n}. Costs fell ( - ) again - and again", "one - two + three words here", "code ```inside it``` and a note[^1] after?[^2]b",
    "[bracketed {n}]", "【둘】", "o item {n}", "• dot", "name\tsum\t{n}", "\tleft\t1", "", "plain words of some length, {n} of them", "", "| name | value of {n} |", "|---|---|", "| alpha | 12345 |", "Revenue of 5만원, 12%p and 3 배 in 2023 년! Was it 1,234,567원?", "",
)


def line_of(key: str, amount: Column) -> Column:
    return F.replace(F.element_at(F.array(*map(F.lit, LINES)), (F.col(key) % len(LINES) + 1).cast("int")), F.lit("{n}"), amount)


def order_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("case_id"), line_of("o_orderkey", F.floor("o_totalprice").cast("long").cast("string")).alias("line"))


LINE_SQL = "replace([" + ", ".join("'" + x.replace("'", "''") + "'" for x in LINES) + f"][o_orderkey % {len(LINES)} + 1], '{{n}}', CAST(CAST(floor(o_totalprice) AS BIGINT) AS VARCHAR))"
TEXTS = f"t AS (SELECT 'document' AS kind, doc_id AS id, text FROM documents UNION ALL SELECT 'line', o_orderkey, {LINE_SQL} FROM orders)"
REPORTS = f"""rp AS (SELECT 'document' AS kind, doc_id AS case_id, text FROM documents UNION ALL SELECT 'lines', o_custkey, string_agg(line, chr(10) ORDER BY o_orderkey) FROM (SELECT o_custkey, o_orderkey, {LINE_SQL} AS line FROM orders) GROUP BY o_custkey)"""


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """kind, id, text: the documents, and lines of all kinds, one for each order."""
    docs = table(spark, sf_dir, "documents").select(F.lit("document").alias("kind"), F.col("doc_id").alias("id"), "text")
    return docs.unionByName(order_lines(spark, sf_dir).select(F.lit("line").alias("kind"), F.col("o_orderkey").alias("id"), F.col("line").alias("text")))


def line_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """kind, case_id, text: the documents, and each customer's lines as a report."""
    docs = table(spark, sf_dir, "documents").select(F.lit("document").alias("kind"), F.col("doc_id").alias("case_id"), "text")
    own = order_lines(spark, sf_dir).groupBy("case_id").agg(F.array_sort(F.collect_list(F.struct("o_orderkey", "line"))).alias("t"))
    return docs.unionByName(own.select(F.lit("lines").alias("kind"), "case_id", F.array_join("t.line", "\n").alias("text")))


def tales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order told as a claim and as evidence: metrics, numbers, units and trends that agree, differ, stand apart or are missing."""
    c = F.col
    pick = lambda n, *xs: F.element_at(F.array(*[x if isinstance(x, Column) else F.lit(x) for x in xs]), (c("o_orderkey") % n + 1).cast("int"))
    base = table(spark, sf_dir, "orders").select("o_orderkey", c("o_custkey").alias("case_id"), F.year("o_orderdate").alias("y"), F.floor("o_totalprice").cast("long").alias("v"))
    full = base.withColumn("p", F.format_number("v", 0)).withColumn("m", pick(7, *METRIC_WORDS)).withColumn("d", pick(3, *TRENDS)).withColumn("od", pick(2, *TRENDS))
    full = full.withColumn("num", pick(5, F.concat("p", F.lit("백만원")), F.concat(F.floor(c("v") / 100).cast("string"), F.lit("억원")), F.concat(F.format_number(c("v") * 1000000, 0), F.lit("원")), F.concat((c("v") % 100).cast("string"), F.lit(".5%")), F.concat((c("v") % 50).cast("string"), F.lit("배"))))
    claim = F.when(c("o_orderkey") % 11 == 0, F.concat(F.lit("The outlook of the company is "), "d", F.lit(" as before."))).when(c("o_orderkey") % 13 == 0, F.concat(c("y").cast("string"), F.lit("년 부채비율은 12 %로 "), "d", F.lit("했다."))).otherwise(F.concat(c("y").cast("string"), F.lit("년 "), "m", F.lit("은 "), "num", F.lit("으로 전년 대비 "), "d", F.lit("했다.")))
    evidence = pick(
        4, F.concat(c("y").cast("string"), F.lit("년 "), "m", F.lit("은 "), "p", F.lit("백만원으로 "), "d", F.lit("했다.")),
        F.concat((c("y") - 1).cast("string"), F.lit("년 "), "m", F.lit(" 현황. 하나. 둘! 셋? The outlook of the company. "), "num", F.lit("였다.")),
        F.concat(F.lit("회사는 "), "p", F.lit("백만원을 기록하고 "), "od", F.lit("했다.\n12 % of all")), F.concat("m", F.lit("은 "), F.repeat(F.lit("긴 글 "), 14), "num", F.lit(" and "), "od"),
    )
    return full.select("o_orderkey", "case_id", claim.alias("claim"), evidence.alias("evidence"), F.when(c("o_orderkey") % 13 == 0, "12%").otherwise(c("num")).alias("token"), c("v").cast("double").alias("price"))


METRIC_WORDS = ("매출액", "영업이익", "부채비율", "ROE", "총자산", "매출", "유동비율")
TRENDS = ("증가", "감소", "유지")
_pick = lambda n, *xs: f"[{', '.join(xs)}][o_orderkey % {n} + 1]"
_quoted = lambda *xs: [f"'{x}'" for x in xs]
TALES = f"""ta AS (SELECT o_orderkey, o_custkey AS case_id, CAST(year(o_orderdate) AS BIGINT) AS y, CAST(floor(o_totalprice) AS BIGINT) AS v, format('{{:,}}', CAST(floor(o_totalprice) AS BIGINT)) AS p, {_pick(7, *_quoted(*METRIC_WORDS))} AS m, {_pick(3, *_quoted(*TRENDS))} AS d, {_pick(2, *_quoted(*TRENDS[:2]))} AS od FROM orders),
tb AS (SELECT *, {_pick(5, "p || '백만원'", "CAST(v // 100 AS VARCHAR) || '억원'", "format('{:,}', v * 1000000) || '원'", "CAST(v % 100 AS VARCHAR) || '.5%'", "CAST(v % 50 AS VARCHAR) || '배'")} AS num FROM ta),
s AS (SELECT o_orderkey, case_id, CASE WHEN o_orderkey % 11 = 0 THEN 'The outlook of the company is ' || d || ' as before.' WHEN o_orderkey % 13 = 0 THEN y || '년 부채비율은 12 %로 ' || d || '했다.' ELSE y || '년 ' || m || '은 ' || num || '으로 전년 대비 ' || d || '했다.' END AS claim,
 {_pick(4, "y || '년 ' || m || '은 ' || p || '백만원으로 ' || d || '했다.'", "(y - 1) || '년 ' || m || ' 현황. 하나. 둘! 셋? The outlook of the company. ' || num || '였다.'", "'회사는 ' || p || '백만원을 기록하고 ' || od || '했다.' || chr(10) || '12 % of all'", "m || '은 ' || repeat('긴 글 ', 14) || num || ' and ' || od")} AS evidence,
 CASE WHEN o_orderkey % 13 = 0 THEN '12%' ELSE num END AS token, CAST(v AS DOUBLE) AS price FROM tb)"""


def of_texts(name: str, make: Callable[[], list[Column]]):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return texts(spark, sf_dir).select("kind", "id", *make())

    run.__name__ = name
    return run


def of_tales(name: str, make: Callable[[], list[Column]]):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return tales(spark, sf_dir).select("o_orderkey", *make())

    run.__name__ = name
    return run


def lines(test, name: str):
    return of_texts(name, lambda: [F.size(F.filter(F.split("text", "\n"), test)).cast("long").alias("n_lines")])


def index_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = C.chunks(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("case_id"), F.lit(1).alias("page"), "text"), "pdf")
    return cut.select("case_id", F.col("chunk_id").cast("long").alias("chunk_id"), F.length("text").cast("long").alias("n"), F.md5("text").alias("md5"))


def split_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_reports(spark, sf_dir).select("kind", "case_id", F.posexplode_outer(C.claims_of("text")).alias("at", "claim")).where("claim is not null")
    return found.select("kind", "case_id", (F.col("at") + 1).cast("long").alias("claim_id"), F.col("claim").alias("claim_text"), T.normalize_invisibles("claim").alias("claim_norm"))


def char_tfidf(spark: SparkSession, sf_dir: str) -> DataFrame:
    weights, _ = R.char_tfidf(page_chunks(spark, sf_dir))
    return weights.groupBy("case_id", F.col("ord.place").cast("long").alias("page"), F.col("ord.chunk_id").cast("long").alias("chunk_id")).agg(F.count("*").alias("n_ngrams"), F.round(F.sum("w"), 6).alias("w_sum"))


def topk_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = R.topk_evidence(turn_claims(spark, sf_dir), page_chunks(spark, sf_dir))
    return top.select("case_id", F.col("claim_id").cast("long").alias("claim_id"), F.col("rank").cast("long").alias("rank"), F.col("ord.place").cast("long").alias("page"), F.col("ord.chunk_id").cast("long").alias("chunk_id"), F.round("score", 6).alias("score"))


def topk_large_case(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as the pages of one case, and the benchmark's items as its claims."""
    own = table(spark, sf_dir, "documents").select(F.lit(0).cast("long").alias("case_id"), F.col("doc_id").cast("int").alias("page"), "text")
    asked = table(spark, sf_dir, "benchmark").select(F.lit(0).cast("long").alias("case_id"), F.col("item_id").alias("claim_id"), F.col("text").alias("claim_norm"))
    top = R.topk_evidence(asked, C.chunks(own, "pdf"))
    return top.select("claim_id", F.col("rank").cast("long").alias("rank"), F.col("ord.place").cast("long").alias("page"), F.col("ord.chunk_id").cast("long").alias("chunk_id"), F.round("score", 6).alias("score"))


def best_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = page_chunks(spark, sf_dir)
    found = R.evidence(R.topk_evidence(turn_claims(spark, sf_dir), chunks), chunks)
    first = F.get("evidence", F.lit(0))
    return found.select("case_id", F.col("claim_id").cast("long").alias("claim_id"), F.round("sim_best", 6).alias("sim_best"), first["page"].cast("long").alias("page"), F.md5(first["snippet"]).alias("snippet_md5"), F.md5("evidence_text").alias("text_md5"))


def word_idf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.word_idf(page_chunks(spark, sf_dir)).select("case_id", "token", F.round("idf", 6).alias("idf"))


def number_presence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which orders' numbers, in which spellings, some evidence of the same customer has."""
    told = tales(spark, sf_dir)
    needles = staged(told.select("o_orderkey", "case_id", F.explode(N.number_variants("token")).alias("needle")), "needles")
    asked = needles.select("case_id", F.lit("pdf").alias("source"), "needle").distinct()
    held = M.present(asked, told.select("case_id", F.lit("pdf").alias("source"), F.col("evidence").alias("text")))
    return needles.join(held, ["case_id", "needle"]).select("o_orderkey", "needle")


def amount_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    asked = orders.select(F.col("o_custkey").alias("case_id"), (F.floor(F.col("o_totalprice") / 100) * 100).cast("double").alias("v")).distinct()
    return M.amount_match(asked, orders.select(F.col("o_custkey").alias("case_id"), (F.col("o_totalprice") + 900).alias("x")))


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as a sheet for each nation: a header row, then name, balance, share and balance again."""
    s = table(spark, sf_dir, "supplier")
    base = [F.col("s_nationkey").cast("long").alias("case_id"), F.lit(0).alias("file_idx"), F.lit("s1").alias("sheet")]
    value = lambda *v: F.posexplode(F.array(*v)).alias("col_no", "value")
    head = s.select(*base[:1]).distinct().select("case_id", *base[1:], F.lit(1).alias("row_no"), value(*map(F.lit, ("항목", "매출액", "비율(%)", "잔액(억원)"))))
    whole = F.floor(F.abs("s_acctbal")).cast("long")
    rows = s.select(*base, (F.col("s_suppkey") + 2).cast("int").alias("row_no"), value(F.col("s_name"), F.when(F.col("s_suppkey") % 10 == 0, F.concat(F.format_number(whole, 0), F.lit("백만원"))).otherwise(whole.cast("string")), (F.col("s_suppkey") % 100).cast("string"), F.round("s_acctbal").cast("long").cast("string")))
    return head.unionByName(rows)


def sheet_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.sheet_rows(cells(spark, sf_dir)).select("case_id", F.col("row_no").cast("long").alias("row_no"), "text")


def sheet_amounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.sheet_amounts(cells(spark, sf_dir)).select("case_id", F.col("row_no").cast("long").alias("row_no"), "cell_text", F.round("value_mkrw", 6).alias("value_mkrw"))


def json_text_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as documents of four shapes: rows under a key, a list of strings, one object, and no JSON at all."""
    of = lambda *parts: F.concat(*[x if isinstance(x, Column) else F.lit(x) for x in parts])
    kind, props = F.col("event_type"), F.coalesce("props", F.lit("null"))
    shapes = F.array(of('{"skip": "no", "items": [{"t": " ', kind, '  now", "props": ', props, '}, {"n": 1}, {"a": ["x\\t\\ty", {"b": "z\\nw"}]}, "\\u200b", {"u": "\\u200b"}, "last"]}'), of('["', kind, '", "two  words", " "]'), of('{"rows": 5, "t": "', kind, '", "deep": {"e": ["f", 2, true]}}'), of("no json: ", kind))
    docs = table(spark, sf_dir, "events").select(F.col("event_id").alias("case_id"), F.element_at(shapes, (F.col("event_id") % 4 + 1).cast("int")).alias("json"))
    return X.json_text_rows(docs).select("case_id", F.col("row_no").cast("long").alias("row_no"), "text")


def clean_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.md5(X.clean_page(F.regexp_replace("html", "<[^>]*>", " "))).alias("md5"))


def scored_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as claims' features."""
    c = F.col
    feats = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", (c("l_discount") * 10).alias("sim"), (c("l_tax") * 10).alias("cov"), (c("l_quantity") / 50).alias("block"), (c("l_discount") * 5 + 0.2).alias("near"), (c("l_quantity") / 100).alias("big"),
        (c("l_tax") * 5).alias("unit"), (c("l_linenumber") / 7).alias("dir"), (c("l_returnflag") == "R").alias("conflict"), (c("l_linestatus") == "O").alias("numeric"), (c("l_quantity") > 40).cast("int").alias("exact"), (c("l_linenumber") % 2 == 0).alias("metric"),
    )
    return feats.withColumn("score", S.final_score(c("sim"), c("cov"), c("block"), c("near"), c("big"), c("unit"), c("dir"), c("conflict"), c("numeric")))


def final_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored_lines(spark, sf_dir).select("l_orderkey", F.col("l_linenumber").cast("long").alias("l_linenumber"), F.round("score", 6).alias("score"))


def decide_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    status = S.decide_status(F.round("score", 9), c("sim"), c("cov"), c("big"), c("exact"), c("numeric"), c("conflict"), c("block"), c("metric"))
    return scored_lines(spark, sf_dir).select("l_orderkey", F.col("l_linenumber").cast("long").alias("l_linenumber"), status.alias("status"))


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as results of claims: a case for each supplier."""
    c = F.col
    status = lambda k: F.element_at(F.array(F.lit("SUPPORTED"), F.lit("PARTIAL"), F.lit("UNSUPPORTED")), ((c("l_linenumber") + k) % 3 + 1).cast("int"))
    digits = F.floor("l_extendedprice").cast("long").cast("string")
    return table(spark, sf_dir, "lineitem").select(
        c("l_suppkey").cast("long").alias("case_id"), (c("l_orderkey") * 10 + c("l_linenumber")).cast("long").alias("claim_id"), F.concat(F.lit("line "), digits).alias("claim_norm"),
        F.when(c("l_quantity") > 10, F.array(digits, F.lit("7"))).otherwise(F.array().cast("array<string>")).alias("numbers"),
        F.when((c("l_quantity") > 10) & (c("l_returnflag") == "R"), F.array(digits)).when((c("l_quantity") > 10) & (c("l_returnflag") == "A"), F.array(F.lit("7"))).otherwise(F.array().cast("array<string>")).alias("missing_all"),
        status(0).alias("status_overall"), status(1).alias("status_pdf"), status(2).alias("status_xlsx"), (c("l_discount") * 10).alias("score_overall"), (c("l_discount") * 10).alias("score_pdf"), (c("l_tax") * 5).alias("score_xlsx"),
        (c("l_tax") * 10).alias("coverage_pdf"), (c("l_discount") * 2).alias("proximity_pdf"), ((c("l_linestatus") == "O") & (c("l_linenumber") == 1)).alias("direction_conflict_pdf"), (c("l_linenumber") == 5).alias("num_conflict_pdf"), F.lit(False).alias("num_conflict_xlsx"),
    )


def decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two decisions for some lines, one for others, none for the rest."""
    c = F.col
    of = lambda k: F.element_at(F.array(*map(F.lit, ("CONFIRMED", "EDIT", "DELETE", "HOLD", "NONE"))), ((c("claim_id") + k) % 5 + 1).cast("int"))
    base = results(spark, sf_dir).select("case_id", "claim_id")
    first = base.select("*", of(1).alias("decision"), F.lit("first").alias("note"), F.timestamp_seconds(F.lit(1000)).alias("updated_at"))
    again = base.where((c("claim_id") % 7 == 0)).select("*", of(0).alias("decision"), F.lit("again").alias("note"), F.timestamp_seconds(F.lit(2000)).alias("updated_at"))
    return first.unionByName(again)


def running_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log in files whose order has nothing to do with time, read as a stream of as many batches into the running table."""
    log, folder = decisions(spark, sf_dir), _own_folder(spark, "decisions")
    for k in range(4):
        log.where(F.pmod(F.xxhash64("case_id", "claim_id", "note"), F.lit(4)) == k).coalesce(1).write.parquet(f"{folder}/log/{k}")
    kept = D.DecisionTable(spark, f"{folder}/table")
    stream = spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{folder}/log")
    kept.follow(stream, f"{folder}/checkpoint").awaitTermination()
    return kept.current().select("case_id", "claim_id", "decision", "note", F.unix_timestamp("updated_at").alias("updated_at"))


def reviewed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.reviewed(results(spark, sf_dir), decisions(spark, sf_dir))


def review_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reviewed(spark, sf_dir).select("case_id", "claim_id", "decision", "note", F.array_join("tags", ",").alias("tags"), F.round("weight", 6).alias("weight"), F.round("quality", 6).alias("quality"), "mismatch", F.round("priority", 6).alias("priority"), "insufficient", "attention", "must_review", "action", F.array_join("reasons", ",").alias("reasons"))


def review_kpis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.review_kpis(reviewed(spark, sf_dir))


def review_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = V.review_scores(reviewed(spark, sf_dir)).withColumn("grade", V.report_grade("quality_score"))
    return scores.select("case_id", "total", "reviewed", "audit_risk", "required_undecided", *[F.round(k, 4).alias(k) for k in ("weight_sum", "quality_score", "completion", "edit_share", "mismatch_share", "delete_share")], "grade")


def queued(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reviewed(spark, sf_dir).select("case_id", "claim_id", "score_overall", F.round("priority", 9).alias("priority"))


def review_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.review_queue(queued(spark, sf_dir)).select("case_id", "claim_id", F.col("place").cast("long").alias("place"))


def whole_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All cases' claims in one order, by score from the highest."""
    return V.whole_queue(queued(spark, sf_dir), "score_desc").select("case_id", "claim_id", "place")


def queue_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The queue's page of 40 claims after the most urgent one of case 7."""
    rows = queued(spark, sf_dir)
    last = rows.where("case_id = 7").orderBy("priority", "claim_id").select("priority", "case_id", "claim_id").head()
    return V.queue_page(rows, size=40, after=tuple(last)).select("case_id", "claim_id", F.col("priority").alias("queue_key"))


def grade_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.grade_counts(V.review_scores(reviewed(spark, sf_dir)).withColumn("quality_score", F.round("quality_score", 9)))


def kpi_drilldown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.kpi_drilldown(reviewed(spark, sf_dir))


def filter_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.filter_results(reviewed(spark, sf_dir), query="LINE 1", ids="9000-10, 70000-90000", status="PARTIAL", risk="NUM_MISSING", decision="EDIT").select("case_id", "claim_id")


def review_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.review_export(reviewed(spark, sf_dir).withColumn("quality", F.round("quality", 9))).withColumn("updated_at", F.unix_timestamp("updated_at"))


def verify_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations verified: assistant turns against the others."""
    flat = P.flat_report(P.verify_cases(reports(spark, sf_dir), pages(spark, sf_dir)))
    kinds = dict(flat.dtypes)
    return flat.select([F.round(k, 6).alias(k) if kinds[k] == "double" else k for k in flat.columns])


def order_sources(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Customers' orders told as reports; as pages the evidence of all of a customer's orders; a sheet of their amounts."""
    told = tales(spark, sf_dir)
    by = F.array_sort(F.collect_list(F.struct("o_orderkey", "claim")))
    own = told.groupBy("case_id").agg(by.alias("t")).select("case_id", F.array_join("t.claim", "\n\n").alias("text"))
    source = told.select("case_id", F.col("o_orderkey").cast("int").alias("page"), F.col("evidence").alias("text"))
    base = [F.col("case_id"), F.lit(0).alias("file_idx"), F.lit("s1").alias("sheet")]
    sheet = told.select("case_id").distinct().select(*base, F.lit(1).alias("row_no"), F.lit(0).alias("col_no"), F.lit("매출액").alias("value")).unionByName(told.select(*base, (F.col("o_orderkey") + 2).cast("int").alias("row_no"), F.lit(0).alias("col_no"), F.col("price").cast("long").cast("string").alias("value")))
    return own, source, sheet.withColumn("file_name", F.lit("sales.xlsx"))


def order_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.verify_cases(*order_sources(spark, sf_dir), top_k=1)


def _report_columns(results: DataFrame) -> DataFrame:
    flat = P.flat_report(results)
    kinds = dict(flat.dtypes)
    return flat.select([F.round(k, 6).alias(k) if kinds[k] == "double" else F.col(k).cast("long").alias(k) if kinds[k] == "int" else k for k in flat.columns])


def verify_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _report_columns(order_results(spark, sf_dir))


def orders_index(spark: SparkSession, sf_dir: str) -> I.Index:
    """An index of the orders' sources that has come about in two versions: the first lacks some pages, and has some that are wrong or of no order; the second removes and adds them."""
    _, source, sheet = order_sources(spark, sf_dir)
    source = staged(source, "pages")
    late, wrong = F.col("page") % 3 == 0, F.col("page") % 5 == 1
    first = source.where(~late).withColumn("text", F.when(wrong, F.concat(F.lit("draft: "), "text")).otherwise(F.col("text")))
    extra = source.where(late).select("case_id", (-F.col("page") - 1).alias("page"), "text")
    places = lambda df: df.select("case_id", F.lit("pdf").alias("source"), F.lit(0).alias("file_idx"), F.lit("").alias("sheet"), F.col("page").alias("place"))
    index = P.index_sources(I.Index.at(spark, f"{shared_folder(spark)}/orders-index-{uuid.uuid4().hex}"), first.unionByName(extra), sheet)
    return P.index_sources(index, source.where(late | wrong), removed=places(extra).unionByName(places(source.where(~late & wrong))))


def verify_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """verify_orders() with a customer's evidence as the rows of one JSON document, in place of pages."""
    own, source, sheet = order_sources(spark, sf_dir)
    rows = F.array_sort(F.collect_list(F.struct("page", F.struct(F.col("text").alias("told"), F.col("page").alias("n")).alias("row"))))
    docs = source.groupBy("case_id").agg(rows.alias("r")).select("case_id", F.to_json(F.struct(F.lit("no row").alias("title"), F.col("r.row").alias("items"))).alias("json"))
    return _report_columns(P.verify_cases(own, P.json_pages(docs), sheet, top_k=1))


def payload_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """verify_orders()' results for readers: scores, numbers, and evidence with its highlights."""
    rows = O.evidence_payload(order_results(spark, sf_dir))
    first = lambda s, f: F.get(f"evidence_{s}", F.lit(0))[f]
    shown = [x for s, place in (("pdf", "page"), ("xlsx", "row")) for x in (F.size(f"evidence_{s}").cast("long").alias(f"n_{s}"), first(s, place).cast("long").alias(f"{s}_{place}"), F.round(first(s, "score"), 6).alias(f"{s}_score"), first(s, "snippet_raw").alias(f"{s}_raw"), first(s, "snippet_html").alias(f"{s}_html"))]
    return rows.select("case_id", F.col("claim_id").cast("long").alias("claim_id"), "claim", "overall", "overall_raw", F.round("score_overall", 6).alias("score_overall"), F.round("coverage_pdf", 6).alias("coverage_pdf"), "num_conflict_xlsx", F.array_join("numbers", "|").alias("numbers"), F.array_join("missing_numbers", "|").alias("missing_numbers"), F.col("num_total").cast("long").alias("num_total"), F.col("num_missing").cast("long").alias("num_missing"), *shown)


def repaired_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """split_claims() with acronyms as they were."""
    found = line_reports(spark, sf_dir).select("kind", "case_id", F.posexplode_outer(C.claims_of("text", repair_acronyms=True)).alias("at", "claim_text")).where("claim_text is not null")
    return found.select("kind", "case_id", (F.col("at") + 1).cast("long").alias("claim_id"), "claim_text")


def index_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of JSON rows: each document as one of three rows."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("case_id"), F.to_json(F.struct(F.array(F.lit("head"), F.lit(" "), F.coalesce("text", F.lit(""))).alias("rows"))).alias("json"))
    cut = C.chunks(X.json_text_rows(docs), "json", "row_no")
    return cut.select("case_id", F.col("place").cast("long").alias("row_no"), F.col("chunk_id").cast("long").alias("chunk_id"), F.length("text").cast("long").alias("n"), F.md5("text").alias("md5"))


def verify_indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """verify_orders() against the stored index, after its update."""
    return _report_columns(P.verify_against(order_sources(spark, sf_dir)[0], orders_index(spark, sf_dir), top_k=1))


def _own_folder(spark: SparkSession, what: str) -> str:
    return f"{shared_folder(spark)}/{what}-{uuid.uuid4().hex}"


def report_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """verify_orders()' results written as one JSON object for each case, and read back."""
    path = _own_folder(spark, "reports")
    O.write_reports_json(order_results(spark, sf_dir), path)
    record = "claim_id: int, status_overall: string, best_score: double, numbers_in_claim: array<string>, missing_numbers_all: array<string>, evidence: array<struct<snippet: string>>"
    held = spark.read.option("recursiveFileLookup", True).text(f"{path}/*", wholetext=True).select(F.regexp_extract(F.input_file_name(), r"([^/]+)\.json$", 1).cast("long").alias("case_id"), F.from_json("value", f"total_claims long, results array<struct<{record}>>").alias("r"))
    rows = held.select("case_id", "r.total_claims", F.inline("r.results"))
    return rows.select("case_id", F.col("claim_id").cast("long").alias("claim_id"), "total_claims", F.col("status_overall").alias("raw_status_overall"), F.round("best_score", 6).alias("best_score_overall"), F.array_join("numbers_in_claim", " | ").alias("numbers_in_claim"), F.array_join("missing_numbers_all", " | ").alias("missing_numbers_all"), F.get("evidence.snippet", F.lit(0)).alias("pdf_top_snippet"))


def report_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same as one CSV file for each case, and read back."""
    path = _own_folder(spark, "reports")
    O.write_reports_csv(order_results(spark, sf_dir), path)
    kinds = {"num_total": "long", "pdf_num_matched": "long", "best_score_pdf": "double"}
    held = spark.read.option("recursiveFileLookup", True).option("header", True).option("multiLine", True).option("escape", '"').csv(f"{path}/*")
    return held.select(F.regexp_extract(F.input_file_name(), r"([^/]+)\.csv$", 1).cast("long").alias("case_id"), F.col("claim_id").cast("long").alias("claim_id"), "claim_text", "status_overall", *[F.round(F.col(k).cast(v), 6).alias(k) if v == "double" else F.col(k).cast(v).alias(k) for k, v in kinds.items()])


def read_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents, after a word that needs it, written as a file each in seven encodings (with a byte order mark, UTF-8, two of Hangul where they have the text's letters, three of UTF-16), and read back."""
    path = _own_folder(spark, "texts")

    @F.pandas_udf("binary")
    def encoded_as(text: pd.Series, kind: pd.Series) -> pd.Series:
        names = ("utf-8-sig", "utf-8", "cp949", "euc-kr", "utf-16", "utf-16-le", "utf-16-be")
        of = lambda x, k: (b"\xfe\xff" if k == 6 else b"") + x.encode(names[k])

        def any_of(x: str, k: int) -> bytes:
            try:
                return of(x, k)
            except UnicodeEncodeError:
                return of(x, 1)

        return pd.Series([any_of(x, k) for x, k in zip(text, kind, strict=True)])

    told = F.concat(F.lit("매출％ "), F.coalesce("text", F.lit("")))
    rows = table(spark, sf_dir, "documents").select("doc_id", F.lit(1).alias("kind"), encoded_as(told, (F.col("doc_id") % 7).cast("int")).alias("piece"))
    write_objects(rows, path, "doc_id", [], ".md")
    held = read_encoded(spark, path)
    return held.select(F.regexp_extract("path", r"([^/]+)\.md$", 1).cast("long").alias("doc_id"), F.length("text").cast("long").alias("n"), F.md5("text").alias("md5"), F.col("error").isNull().alias("good"))


def segment_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = B.segment_blocks(line_reports(spark, sf_dir).select(F.struct("kind", F.col("case_id").alias("id")).alias("case_id"), "text"))
    return found.select("case_id.kind", F.col("case_id.id").alias("case_id"), F.col("block_id").cast("long").alias("block_id"), F.col("kind").alias("block_kind"), F.size("rows").cast("long").alias("n_rows"), F.md5("text").alias("md5"))


def locate_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers' orders told as reports, every claim short of evidence, found in the reports' blocks."""
    told = sentences(spark, sf_dir)
    by = F.array_sort(F.collect_list(F.struct("o_orderkey", "claim")))
    blocks = B.segment_blocks(told.groupBy("case_id").agg(by.alias("t")).select("case_id", F.array_join("t.claim", "\n\n").alias("text")))
    decided = F.element_at(F.array(*map(F.lit, ("NONE", "CONFIRMED", "EDIT", "DELETE", "HOLD"))), (F.col("o_orderkey") % 5 + 1).cast("int"))
    rows = told.select("case_id", F.col("o_orderkey").alias("claim_id"), F.col("claim").alias("claim_norm"), decided.alias("decision"), (F.col("o_orderkey") % 3 > 0).alias("insufficient"))
    return V.locate_claims(rows, blocks).select("case_id", "claim_id", "mark", F.col("block_id").cast("long").alias("block_id"))


def highlights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order's evidence marked with what its claim asks."""
    return tales(spark, sf_dir).select("o_orderkey", O.highlighted(F.concat(F.lit("<a & b> "), "evidence"), O.claim_tokens("claim")).alias("html"))


def evidence_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations verified, with their evidence for readers."""
    rows = O.evidence_payload(P.verify_cases(reports(spark, sf_dir), pages(spark, sf_dir)))
    kinds = dict(rows.dtypes)
    return rows.select([F.round(k, 6).alias(k) if kinds[k] == "double" else F.to_json(k).alias(k) if kinds[k].startswith("array<struct") else k for k in rows.columns])


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers of each claim found in its evidence, and what is made of them."""
    told = tales(spark, sf_dir).withColumn("numbers", N.extract_numbers("claim")).withColumn("big", N.big_numbers("numbers")).withColumn("near", N.match_numbers_in_text("numbers", T.norm_for_match("evidence"))).withColumn("spellings", F.transform("numbers", N.number_variants))
    told = staged(told, "told")
    return told.select("o_orderkey", _joined("near", "matched"), F.round(S.big_number_recall(F.col("numbers"), F.col("big"), F.col("near")), 6).alias("recall"), F.round(S.proximity("claim", "evidence", "numbers", "spellings"), 6).alias("proximity"))


def combine_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return results(spark, sf_dir).select("claim_id", S.combine_status("status_pdf", "status_xlsx").alias("status"))


def unique_keep_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return texts(spark, sf_dir).select("kind", "id", F.md5(F.array_join(T.unique_keep_order(F.split("text", "[ \n]")), "|")).alias("md5"))


_joined = lambda c, name: F.array_join(c, "|").alias(name)
QUERIES = {
    "verify_cases": verify_cases,
    "verify_orders": verify_orders, "verify_indexed": verify_indexed, "verify_json": verify_json, "payload_orders": payload_orders, "repaired_claims": repaired_claims, "index_rows": index_rows, "report_files": report_files, "report_csv": report_csv, "read_reports": read_reports,
    "normalize_invisibles": of_texts("normalize_invisibles", lambda: [F.md5(T.normalize_invisibles("text")).alias("md5")]),
    "norm_for_match": of_texts("norm_for_match", lambda: [F.md5(T.norm_for_match("text")).alias("md5")]),
    "word_tokens": of_texts("word_tokens", lambda: [F.size(T.word_tokens("text")).cast("long").alias("n"), F.md5(F.array_join(T.word_tokens("text"), "|")).alias("md5")]),
    "split_sentences": of_texts("split_sentences", lambda: [F.size(T.split_sentences("text")).cast("long").alias("n"), F.md5(F.array_join(T.split_sentences("text"), "|")).alias("md5")]),
    "html_escape": of_texts("html_escape", lambda: [F.md5(T.html_escape("text")).alias("md5")]),
    "acronym_dots": of_texts("acronym_dots", lambda: [F.md5(T.protect_acronym_dots("text")).alias("kept"), F.md5(T.restore_acronym_dots(T.protect_acronym_dots("text"))).alias("restored")]),
    "unique_keep_order": unique_keep_order,
    "is_heading": lines(T.is_heading, "is_heading"),
    "is_numbered_title": lines(T.is_numbered_title, "is_numbered_title"),
    "is_rule_line": lines(T.is_rule_line, "is_rule_line"),
    "is_excluded_table_header": lines(T.is_excluded_table_header, "is_excluded_table_header"),
    "is_excluded_finance_row": lines(T.is_excluded_finance_row, "is_excluded_finance_row"),
    "extract_numbers": of_texts("extract_numbers", lambda: [_joined(N.extract_numbers("text"), "numbers")]),
    "number_tokens": of_tales("number_tokens", lambda: [_joined(N.extract_numbers("claim"), "numbers"), _joined(N.extract_years("evidence"), "years"), _joined(N.extract_units("claim"), "units"), _joined(N.extract_metrics("claim"), "metrics"), _joined(N.big_numbers(N.extract_numbers("claim")), "big"), N.claim_amount("token").alias("amount")]),
    "number_variants": of_tales("number_variants", lambda: [_joined(N.number_variants("token"), "variants")]),
    "unit_match": of_tales("unit_match", lambda: [F.round(S.unit_match("claim", "evidence"), 6).alias("unit_match")]),
    "direction": of_tales("direction", lambda: [S.direction_score("claim", "evidence").alias("score"), S.direction_conflict("claim", "evidence").alias("conflict")]),
    "fact_block": of_tales("fact_block", lambda: [S.fact_block("claim", "evidence").alias("score")]),
    "features": features, "combine_status": combine_status,
    "index_pages": index_documents, "split_claims": split_claims, "char_tfidf": char_tfidf, "topk_evidence": topk_evidence, "topk_large_case": topk_large_case, "best_evidence": best_evidence, "word_idf": word_idf,
    "number_presence": number_presence, "amount_match": amount_match, "sheet_rows": sheet_rows, "sheet_amounts": sheet_amounts, "json_text_rows": json_text_rows, "clean_pages": clean_pages,
    "segment_blocks": segment_blocks, "locate_claims": locate_claims, "highlights": highlights, "evidence_payload": evidence_payload,
    "final_score": final_score, "decide_status": decide_status, "review_rows": review_rows, "review_kpis": review_kpis, "review_scores": review_scores, "running_decisions": running_decisions, "review_queue": review_queue, "whole_queue": whole_queue, "queue_page": queue_page, "grade_counts": grade_counts, "kpi_drilldown": kpi_drilldown, "filter_results": filter_results, "review_export": review_export,
}
