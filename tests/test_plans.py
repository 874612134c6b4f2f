"""Whole queries: against SQL, and on claims of known truth."""

import duckdb
import pytest
from pyspark.sql import functions as F

from veritrail.operators import blocks as B
from veritrail.oracles import ORACLES
from veritrail.plans import payload as O, verify as P
from veritrail.queries import QUERIES
from veritrail.sources import tables as X

DATA = "/root/testdata/sf0.001"
TABLES = ("supplier", "orders", "lineitem", "events", "documents", "pages", "conversations", "benchmark")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_sql(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    want = duck.sql(ORACLES[name])
    names = want.columns
    assert sorted(names) == columns
    assert sorted(repr(tuple(x[c] for c in columns)) for x in df.collect()) == sorted(repr(tuple(x[names.index(c)] for c in columns)) for x in want.fetchall())


def test_known_truth(spark):
    reports = spark.createDataFrame([(1, "2020년 매출액은 1,234백만원으로 전년 대비 증가했다.\n\n2021년 매출액은 9,999백만원으로 전년 대비 증가했다."), (2, "nothing of this is here at all.")], "case_id long, text string")
    pages = spark.createDataFrame([(1, 1, "2020년 매출액은 1,234백만원으로 전년 대비 증가했다."), (1, 2, "2021년 매출액은 5,555백만원으로 전년 대비 증가했다."), (2, 1, "zzz qqq"), (3, 1, " ")], "case_id long, page int, text string")
    got = {(x["case_id"], x["claim_id"]): x for x in P.verify_cases(reports, pages, top_k=1).collect()}
    assert got[1, 1]["status_overall"] == "SUPPORTED" and got[1, 1]["missing_all"] == []
    assert got[1, 2]["missing_all"] == ["9,999백만원"]
    assert got[2, 1]["status_overall"] == "UNSUPPORTED" and len(got[2, 1]["evidence_pdf"]) == 1


def test_cases_do_not_touch_each_other(spark):
    reports = spark.createDataFrame([(1, "alpha beta gamma delta."), (2, "alpha beta gamma delta.")], "case_id long, text string")
    pages = spark.createDataFrame([(1, 1, "alpha beta gamma"), (2, 1, "omega")], "case_id long, page int, text string")
    both = {x["case_id"]: x["score_pdf"] for x in P.verify_cases(reports, pages).collect()}
    alone = P.verify_cases(reports.where("case_id = 1"), pages.where("case_id = 1")).first()["score_pdf"]
    assert both[1] == pytest.approx(alone) and alone > both[2]
    assert [x["case_id"] for x in P.cases_without_text(reports, pages.where("case_id = 1")).collect()] == [2]


def test_json_rows_of_any_shape(spark):
    docs = spark.createDataFrame([(1, '{"items": [{"a": "x", "b": [1, "y"]}, {}]}'), (2, '["p", {"q": " r  s "}]'), (3, "no json"), (4, None)], "case_id long, json string")
    assert [(x["case_id"], x["row_no"], x["text"]) for x in X.json_text_rows(docs).orderBy("case_id", "row_no").collect()] == [(1, 1, "x y"), (2, 1, "p"), (2, 2, "r s")]


def test_decoding(spark, tmp_path):
    (tmp_path / "a.md").write_bytes("매출".encode("cp949"))
    (tmp_path / "b.md").write_bytes("매출".encode("utf-8-sig"))
    assert [x["text"] for x in X.read_reports(spark, str(tmp_path)).collect()] == ["매출", "매출"]


def test_header_units(spark):
    cells = spark.createDataFrame([(1, 0, "s", 1, 0, "금액(백만원)"), (1, 0, "s", 2, 0, "5"), (1, 0, "s", 3, 0, "5억원"), (1, 0, "s", 4, 0, None)], "case_id long, file_idx int, sheet string, row_no int, col_no int, value string")
    assert sorted(x["value_mkrw"] for x in X.sheet_amounts(cells).collect()) == pytest.approx([5e-6, 500.0])
    assert sorted(x["value_mkrw"] for x in X.sheet_amounts(cells, "longest").collect()) == [5.0, 500.0]


def test_empty_tables(spark):
    nothing = spark.createDataFrame([], "case_id long, text string")
    assert P.verify_cases(nothing, nothing.withColumn("page", F.lit(1))).count() == 0


def test_blocks(spark):
    text = "1. Head\n[part]\no one\n- two\nName\t Sum \n\tleft\n2. inside\t9\nrest of it\n- swallowed\n\n\tfirst\tof all\n3. Next\nplain"
    rows = spark.createDataFrame([(1, text), (2, None), (3, " \n ")], "case_id long, text string")
    got = [(x["case_id"], x["block_id"], x["kind"], x["rows"]) for x in B.segment_blocks(rows).orderBy("case_id", "block_id").collect()]
    assert got == [
        (1, 1, "h2", ["1. Head"]), (1, 2, "h3", ["[part]"]), (1, 3, "list", ["one", "two"]), (1, 4, "table", ["Name\tSum", "\tleft", "2. inside\t9"]), (1, 5, "paragraph", ["rest of it - swallowed"]),
        (1, 6, "table", ["\tfirst\tof all"]), (1, 7, "h2", ["3. Next"]), (1, 8, "paragraph", ["plain"]),
    ]


def test_payload_and_report(spark, tmp_path):
    reports = spark.createDataFrame([(1, "2020년 매출액은 1,234백만원으로 A&B 증가했다.")], "case_id long, text string")
    pages = spark.createDataFrame([(1, 1, "매출액은 <1,234백만원>, amp & more")], "case_id long, page int, text string")
    results = P.verify_cases(reports, pages)
    row = O.evidence_payload(results).first()
    shown = row["evidence_pdf"][0]
    assert "<b>" in shown["snippet_html"] and "&lt;" in shown["snippet_html"] and "&amp;" in shown["snippet_html"] and shown["snippet_raw"].startswith("매출액은 <1,234")
    assert row["evidence_xlsx"] == [] and row["num_total"] == len(row["numbers"])
    O.write_report_json(results, str(tmp_path / "report"))
    claims, heads = spark.read.json(f"{tmp_path}/report/claims"), spark.read.json(f"{tmp_path}/report/heads").first()
    assert claims.count() == 1 and "evidence_pdf" in claims.columns and heads["total_claims"] == 1 and heads["thresholds"]["number_partial"] == 0.22
