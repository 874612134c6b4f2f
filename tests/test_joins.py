"""Joins over whole cases: both plans of the top-k, large cases in blocks, needles, sheets and the review's figures."""

import random

import pytest
from pyspark.sql import functions as F

from veritrail.operators import claims as C, match as M, retrieve as R
from veritrail.plans import review as V, verify as P
from veritrail.sources import staging, tables as X


def corpus(spark, chunks=40, claims=12):
    rng = random.Random(1)
    words = ["alpha", "beta", "gamma", "delta", "매출액", "증가", "12,345", "of", "the"]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    pages = [(case, p, text(rng.randint(1, 20)) if p % 9 else "same page again") for case in (1, 2) for p in range(chunks if case == 1 else 3)] + [(3, 1, "zzz")]
    asked = [(case, k, text(rng.randint(1, 8)) if k else "qqq") for case in (1, 2, 3, 4) for k in range(claims)]
    cut = C.chunks(spark.createDataFrame(pages, "case_id long, page int, text string"), "pdf")
    return spark.createDataFrame(asked, "case_id long, claim_id long, claim_norm string"), cut


def ranked(df):
    return sorted((x["case_id"], x["claim_id"], x["rank"], x["ord"]["place"], round(x["score"], 9)) for x in df.collect())


def test_both_plans_agree(spark):
    claims, chunks = corpus(spark)
    want = ranked(R.topk_by_join(claims, chunks))
    assert len(want) == 12 * (3 + 3 + 1) and ranked(R.topk_evidence(claims, chunks)) == want


def test_blocks_of_a_large_case_agree(spark, monkeypatch):
    claims, chunks = corpus(spark)
    want = ranked(R.topk_by_join(claims, chunks))
    monkeypatch.setattr(R, "CHUNKS", 7)
    monkeypatch.setattr(R, "CLAIMS", 5)
    assert ranked(R.topk_evidence(claims, chunks)) == want


@pytest.mark.parametrize(("needles", "texts", "filters"), [(100_000, 4096, 1024), (3, 4, 1024), (3, 1, 2)])
def test_needles_in_blocks(spark, monkeypatch, needles, texts, filters):
    for name, value in (("NEEDLES", needles), ("TEXTS", texts), ("FILTERS", filters)):
        monkeypatch.setattr(M, name, value)
    rng = random.Random(2)
    word = lambda n: "".join(rng.choice("ab1매\0") for _ in range(n))
    held = [(case, "pdf", at, word(rng.randint(0, 12)) if at % 5 else None) for case in (1, 2) for at in range(20)] + [(3, "pdf", 0, "ab")]
    asked = sorted({(case, "pdf", word(rng.randint(1, 4))) for case in (1, 2, 3, 4) for _ in range(40)})
    needles, texts = spark.createDataFrame(asked, "case_id long, source string, needle string"), spark.createDataFrame(held, "case_id long, source string, at long, text string")
    want = {(c, n): min(at for k, _, at, t in held if k == c and t and n in t) for c, _, n in asked if any(k == c and t and n in t for k, _, _, t in held)}
    assert {(x["case_id"], x["needle"]): x["at"] for x in M.first_text(needles, texts).collect()} == want
    assert sorted((x["case_id"], x["needle"]) for x in M.present(needles, texts.drop("at")).collect()) == sorted(want)
    empty = spark.createDataFrame([(1, "pdf", ""), (4, "pdf", "")], "case_id long, source string, needle string")
    assert [x["case_id"] for x in M.present(empty, texts.drop("at")).collect()] == [1]


def test_needles_travel_to_blocks_that_can_hold_them(spark, monkeypatch):
    """One case twice as large, in needles and in texts, shuffles twice the rows."""
    monkeypatch.setattr(M, "TEXTS", 20)
    shuffled = []
    by_group = M.by_group
    monkeypatch.setattr(M, "by_group", lambda df, *x, **y: (shuffled.append(df), by_group(df, *x, **y))[1])

    def rows(n):
        texts = spark.range(n).select(F.lit(1).alias("case_id"), F.lit("pdf").alias("source"), F.concat(F.lit("the common words, "), F.sha2(F.col("id").cast("string"), 256)).alias("text"))
        some = spark.range(n).select(F.lit(1).alias("case_id"), F.lit("pdf").alias("source"), F.explode(F.array(F.substring(F.sha2(F.col("id").cast("string"), 256), 5, 12), F.concat(F.lit("absent "), F.col("id").cast("string")))).alias("needle"))
        common = spark.createDataFrame([(1, "pdf", x) for x in ("the", "common", "words, ")], "case_id int, source string, needle string")
        shuffled.clear()
        assert M.present(some.unionByName(common), texts).count() == n + 3
        return sum(x.count() for x in shuffled)

    small, large = rows(600), rows(1200)
    assert small < 600 * 8 and large < 2.3 * small


def test_sheets_keep_their_rows_apart(spark):
    cells = spark.createDataFrame([(1, 0, "books.xlsx", s, r, 0, f"{s} row {r} " + "매출 " * 200) for s in ("b", "a") for r in (2, 1)], "case_id long, file_idx int, file_name string, sheet string, row_no int, col_no int, value string")
    rows = X.sheet_rows(cells).withColumn("place", F.col("row_no"))
    cut = C.chunks(rows, "xlsx", "place")
    assert [(x["ord"]["sheet"], x["place"]) for x in cut.orderBy("ord").collect()] == [("a", 1), ("a", 2), ("b", 1), ("b", 2)]
    claim = spark.createDataFrame([(1, 1, "b row 2")], "case_id long, claim_id long, claim_norm string")
    found = R.evidence(R.topk_evidence(claim, cut, 1), cut, cells.select("case_id", "file_idx", "file_name").distinct()).first()
    shown = found["evidence"][0]["snippet"]
    assert shown.startswith("[books.xlsx] row 2: b row 2 매출") and len(shown) <= len("[books.xlsx] row 2: ") + 450 and not shown.endswith(" ")


def test_snippets_are_stripped_before_lines_are_joined(spark):
    chunks = C.chunks(spark.createDataFrame([(1, 1, "x" * 499 + "\ny")], "case_id long, page int, text string"), "pdf")
    claim = spark.createDataFrame([(1, 1, "xx")], "case_id long, claim_id long, claim_norm string")
    assert R.evidence(R.topk_evidence(claim, chunks), chunks).first()["evidence"][0]["snippet"] == "x" * 499


def test_json_that_is_none(spark):
    docs = spark.createDataFrame([(1, '["a"]'), (2, "{"), (3, None), (4, '{"x": "one\\ntwo  \\t three"}'), (5, '["\\u200b", {"k": "\\u200b"}, "z"]')], "case_id long, json string")
    assert sorted(x["case_id"] for x in X.invalid_json(docs).collect()) == [2, 3]
    assert sorted((x["case_id"], x["row_no"], x["text"]) for x in X.json_text_rows(docs).collect()) == [(1, 1, "a"), (4, 1, "one\ntwo three"), (5, 1, ""), (5, 2, "z")]


def test_report_columns(spark):
    reports = spark.createDataFrame([(1, "2020년 매출액은 1,234백만원으로 전년 대비 증가했다.")], "case_id long, text string")
    pages = spark.createDataFrame([(1, 1, "매출액은 1,234백만원이다")], "case_id long, page int, text string")
    flat = P.flat_report(P.verify_cases(reports, pages))
    both = lambda *names: [f"{k}_{s}" for k in names for s in ("pdf", "xlsx")]
    assert flat.columns == [
        "case_id", "claim_id", *[f"{r}status_{s}" for s in ("overall", "pdf", "xlsx") for r in ("", "raw_")], "best_score_overall", "best_score_pdf", "best_score_xlsx",
        *both("sim_best", "coverage", "proximity", "big_num_recall", "exact_big_num_matches", "unit_match", "direction_score", "direction_conflict"),
        "num_total", "pdf_num_matched", "xlsx_num_matched", "num_missing_all", "numbers_in_claim", "matched_numbers_pdf", "matched_numbers_xlsx", "missing_numbers_all", "num_conflict_pdf", "num_conflict_xlsx", "claim_text",
        *[f"pdf_top_{k}" for k in ("page", "chunk", "score", "snippet")], *[f"xlsx_top_{k}" for k in ("row", "chunk", "score", "snippet")],
    ]
    row = flat.first()
    assert (row["raw_status_xlsx"], row["best_score_xlsx"], row["unit_match_xlsx"], row["xlsx_top_row"], row["matched_numbers_pdf"]) == ("UNSUPPORTED", 0.0, 0.5, None, "1,234백만원")


def test_batch_decisions_keep_notes(spark):
    log = spark.createDataFrame([(1, 1, "EDIT", "why", 1), (1, 2, "HOLD", "", 1)], "case_id long, claim_id long, decision string, note string, at long").select("case_id", "claim_id", "decision", "note", F.timestamp_seconds("at").alias("updated_at"))
    ids = spark.createDataFrame([(1, 1), (1, 3), (1, 3)], "case_id long, claim_id long")
    after = V.latest_decision(V.batch_decision(log, ids, "DELETE", F.timestamp_seconds(F.lit(9))))
    assert sorted((x["claim_id"], x["decision"], x["note"]) for x in after.collect()) == [(1, "DELETE", "why"), (2, "HOLD", ""), (3, "DELETE", "")]


@pytest.mark.parametrize(("by", "want"), [("priority", [2, 3, 1]), ("id_asc", [1, 2, 3]), ("score_desc", [1, 2, 3]), ("score_asc", [3, 2, 1])])
def test_queue_orders(spark, by, want):
    rows = spark.createDataFrame([(1, 1, 5.0, 0.9), (1, 2, 1.0, 0.5), (1, 3, 1.0, 0.1)], "case_id long, claim_id long, priority double, score_overall double")
    assert [x["claim_id"] for x in V.review_queue(rows, by).orderBy("place").collect()] == want


def test_unit_mismatch_needs_sheet_features(spark):
    columns = {"numbers": F.array(F.lit("5")), "missing_all": F.array().cast("array<string>"), "status_pdf": F.lit("PARTIAL"), "status_xlsx": F.lit("PARTIAL"), "num_conflict_pdf": F.lit(False), "num_conflict_xlsx": F.lit(False)}
    rows = spark.range(1).withColumns(columns)
    for s, v in (("pdf", 0.1), ("xlsx", 0.2)):
        rows = rows.withColumns({f"unit_match_{s}": F.lit(v), f"coverage_{s}": F.lit(0.6 if s == "xlsx" else 0.1), f"proximity_{s}": F.lit(0.0), f"direction_conflict_{s}": F.lit(s == "xlsx")})
    assert rows.select(V.risk_tags()).first()[0] == []
    assert rows.select(V.risk_tags(use_sheet_features=True)).first()[0] == ["DISPERSED", "DIR_CONFLICT", "UNIT_MISMATCH"]


def test_a_cluster_needs_a_shared_folder(spark):
    class Away:
        conf = spark.conf
        class sparkContext:  # noqa: N801
            master, applicationId = "spark://elsewhere:7077", "app"
            @staticmethod
            def getConf():
                return spark.sparkContext.getConf()

    if not (spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")):
        with pytest.raises(ValueError):
            staging.shared_folder(Away)


def test_one_order_over_many_tasks(spark):
    rng = random.Random(8)
    rows = [(1 if k % 3 else rng.randint(2, 9), k, float(rng.randint(0, 5)), rng.random()) for k in range(500)]  # case 1 has two thirds
    df = spark.createDataFrame(rows, "case_id long, claim_id long, priority double, score_overall double").repartition(5)
    got = [(x["case_id"], x["claim_id"]) for x in V.whole_queue(df).orderBy("place").collect()]
    want = [(c, k) for p, c, k in sorted((p, c, k) for c, k, p, _ in rows)]
    assert got == want and {x["place"] for x in V.whole_queue(df).collect()} == set(range(1, 501))
    own = {(x["case_id"], x["claim_id"]): x["place"] for x in V.review_queue(df, "score_desc").collect()}
    for case in {c for c, *_ in rows}:
        assert [own[case, k] for k, _ in sorted(((k, s) for c, k, _, s in rows if c == case), key=lambda x: (-x[1], x[0]))] == list(range(1, sum(c == case for c, *_ in rows) + 1))
    pages, after = [], None
    while part := V.queue_page(df, size=64, after=after).collect():
        pages += part
        after = (part[-1]["queue_key"], part[-1]["case_id"], part[-1]["claim_id"])
    assert [(x["case_id"], x["claim_id"]) for x in pages] == want
    assert "TakeOrdered" in V.queue_page(df)._jdf.queryExecution().executedPlan().toString()
    assert V.whole_queue(df.limit(0)).count() == 0


def test_a_large_case_keeps_no_postings(spark, tmp_path, monkeypatch):
    """What a large case writes follows its texts, whose postings take some fifteen times as much, and a block is counted in few texts at once."""
    from veritrail.operators import recounted as L
    from veritrail.sources import staging

    rows = [(1, p, " ".join(f"word{(p * 37 + k * k) % 501}" for k in range(120))) for p in range(60)]
    chunks = C.chunks(spark.createDataFrame(rows, "case_id long, page int, text string"), "pdf")
    claims = spark.createDataFrame([(1, k, rows[k][2][:80]) for k in range(0, 60, 7)], "case_id long, claim_id long, claim_norm string")
    want = sorted((x["claim_id"], x["rank"], x["ord"]["place"], x["ord"]["chunk_id"], round(x["score"], 9)) for x in R.topk_by_join(claims, chunks).collect())
    for name, value in (("LEAST", 16), ("MOST", 16), ("FEW", 5), ("AT_ONCE", 40), ("TOLD", 50), ("CLAIMS", 4)):
        monkeypatch.setattr(L, name, value)
    monkeypatch.setattr(R, "CHUNKS", 20)
    monkeypatch.setattr(staging.shared_folder, "own", str(tmp_path), raising=False)
    got = R.topk_evidence(claims, chunks).collect()
    assert sorted((x["claim_id"], x["rank"], x["ord"]["place"], x["ord"]["chunk_id"], round(x["score"], 9)) for x in got) == want
    written = sum(x.stat().st_size for x in tmp_path.rglob("*.parquet"))
    assert written < 3 * sum(len(x[2]) for x in rows)


def told_cases(spark):
    """Reports, pages and cells of a few cases: numbers as text, as amounts near and far, words in one page of many, a page without text."""
    reports = spark.createDataFrame([(k, f"2020년 매출액은 1,23{k}백만원으로 전년 대비 증가했다. 영업이익은 {k}.5%이고 12억원 또한 감소했다. The Outlook of company {k} is stable.") for k in range(5)], "case_id long, text string")
    pages = spark.createDataFrame([(k, p, None if p == 3 else f"page {p} 매출액 123{p}백만원, {p}.5 ％ outlook\ncompany {k} 120,000만원") for k in range(5) for p in range(k + 1)], "case_id long, page int, text string")
    cells = spark.createDataFrame([(k, 0, "s", r, 0, "매출액" if r == 1 else str(1224 + 3 * r)) for k in range(4) for r in (1, 2, 3, 4)], "case_id long, file_idx int, sheet string, row_no int, col_no int, value string")
    return reports, pages, cells


@pytest.mark.parametrize("limit", ["TEXTS", "NEEDLES"])
def test_cases_in_one_task_agree_with_joins(spark, monkeypatch, limit):
    """Some cases (TEXTS), then all (NEEDLES), through joins: the same features to the last bit that counts."""
    rows = lambda: sorted(tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in P.flat_report(P.verify_cases(*told_cases(spark), top_k=1)).collect())
    want = rows()
    monkeypatch.setattr(M, limit, 2 if limit == "TEXTS" else 20)
    monkeypatch.setattr(M, "PLAIN", 0)
    assert len(want) >= 15 and rows() == want


def test_a_case_of_few_texts_shuffles_no_needles(spark, monkeypatch):
    """Words, numbers and their spellings stay in arrays of their claim: no table of needles is written."""
    from veritrail.plans import verify

    written = []
    put = verify.staged
    monkeypatch.setattr(verify, "staged", lambda df, what: (written.append(what), put(df, what))[1])
    P.verify_cases(*told_cases(spark), top_k=1)
    assert not {"asked", "needles"} & set(written)


def test_fact_block_takes_spellings_from_the_table(spark):
    from veritrail.functions import numbers as N, scoring as S

    rows = spark.createDataFrame([("2020년 매출액은 1,234백만원 12 ％ 증가", "2020년 매출액은 12.34억원이다. 하나. 12%"), ("매출 5?5배", "매출 5배"), ("ROE 7%p", ""), ("", "매출 1")], "c string, e string").withColumn("n", N.extract_numbers("c")).withColumn("s", F.transform("n", N.number_variants))
    assert all(a == b for a, b in rows.select(S.fact_block("c", "e"), S.fact_block("c", "e", numbers="n", spellings="s")).collect())


def test_rows_with_bytes_travel_in_small_batches(spark):
    from veritrail.operators import grouped

    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    try:
        spark.conf.set(key, "10000")
        rows = spark.range(1000).select(F.lit(1).alias("k"), "id", F.encode(F.col("id").cast("string"), "utf-8").alias("x"))
        assert grouped.by_group(rows, ["k"], ["id"], lambda key, held: [(len(held),)], "n long", kept=1).first()["n"] == 1000
        assert int(spark.conf.get(key)) == grouped.FEW
    finally:
        spark.conf.set(key, before)
