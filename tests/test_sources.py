"""Files that tasks write and read: one report for each case, texts in any encoding."""

import json

import pandas as pd
import pytest
from pyspark.sql import functions as F

from veritrail.plans import payload as O, verify as P
from veritrail.sources import encoded, objects


def files(path):
    return sorted(str(x.relative_to(path)) for x in path.rglob("*") if x.is_file() and not x.name.endswith(".crc"))


def results_of(spark, cases=5):
    told = "2020년 매출액은 1,234백만원으로 \"전년\" 대비, 증가했다. 영업이익은 50억원이다."
    reports = spark.createDataFrame([(c, told) for c in range(cases)], "case_id long, text string")
    pages = spark.createDataFrame([(c, 1, f"매출액은 {c},234백만원이다") for c in range(cases)], "case_id long, page int, text string")
    return P.verify_cases(reports, pages)


def test_reports_are_written_and_read_back(spark, tmp_path):
    results = results_of(spark)
    names = spark.createDataFrame([(c, f"r{c}.md", f"s{c}.pdf") for c in range(4)], "case_id long, md_file string, pdf_file string")
    O.write_reports_json(results, str(tmp_path / "json"), names, {"number_partial": 0.5})
    held = {int(x.stem): json.loads(x.read_text()) for x in (tmp_path / "json").rglob("*.json")}
    assert set(held) == set(range(5)) and held[2]["md_file"] == "r2.md" and held[4]["pdf_file"] is None
    assert held[0]["total_claims"] == 2 and held[0]["thresholds"]["number_partial"] == 0.5 and held[0]["thresholds"]["text_partial"] == 0.22
    want = {(x["case_id"], x["claim_id"]): x for x in O.claim_records(results).collect()}
    for case, report in held.items():
        assert [x["claim_id"] for x in report["results"]] == [1, 2] and len(report["results"][0]) == 35
        for x in report["results"]:
            row = want[case, x["claim_id"]].asDict(True)
            row.pop("case_id")
            assert {k: pytest.approx(v) if isinstance(v, float) else v for k, v in row.items()} == x
    O.write_reports_csv(results, str(tmp_path / "csv"))
    paths = list((tmp_path / "csv").rglob("*.csv"))
    assert len(paths) == 5 and all(x.read_bytes().startswith(b"\xef\xbb\xbfclaim_id,") for x in paths)
    flat = {(x["case_id"], x["claim_id"]): x for x in P.flat_report(results).collect()}
    for path in paths:
        for _, x in pd.read_csv(path, encoding="utf-8-sig").iterrows():
            row = flat[int(path.stem), x["claim_id"]]
            assert (x["claim_text"], x["numbers_in_claim"], x["raw_status_pdf"]) == (row["claim_text"], row["numbers_in_claim"], row["raw_status_pdf"]) and x["best_score_pdf"] == pytest.approx(row["best_score_pdf"])
    with pytest.raises(Exception, match="already"):
        O.write_reports_csv(results, str(tmp_path / "csv"))
    O.write_reports_csv(results.where("case_id = 1"), str(tmp_path / "csv"), overwrite=True)
    assert [x for x in files(tmp_path / "csv") if x.endswith("1.csv")] and len(files(tmp_path / "csv")) == 2


def test_names_do_not_collide(spark, tmp_path):
    names = ["a/b", "a%2Fb", ".", "..", "", None, "null", "%null", "x" * 500, "x" * 499 + "y", "매출", "a b", "A B"]
    rows = spark.createDataFrame([(n, k, 1, f"{n}:{k}") for n in names for k in range(3)], "name string, at int, kind int, piece string").repartition(5)
    objects.write_objects(rows, str(tmp_path / "out"), "name", ["at"], ".txt", "|")
    held = sorted(x.read_text() for x in (tmp_path / "out").rglob("*.txt"))
    assert held == sorted("|".join(f"{n}:{k}" for k in range(3)) for n in names)
    assert all(x.startswith(("bucket-", "_SUCCESS")) for x in files(tmp_path / "out"))


def test_a_failed_task_leaves_nothing(spark, tmp_path):
    rows = spark.range(50).select(F.col("id").alias("name"), F.lit(1).alias("kind"), F.when(F.col("id") == 33, F.raise_error(F.lit("broken"))).otherwise(F.lit("x")).alias("piece"))
    with pytest.raises(Exception, match="broken"):
        objects.write_objects(rows, str(tmp_path / "out"), "name", [])
    assert not (tmp_path / "out").exists() or files(tmp_path / "out") == []
    objects.write_objects(rows.where("name <> 33"), str(tmp_path / "out"), "name", [])
    assert len(files(tmp_path / "out")) == 50


def test_texts_in_all_encodings(spark, tmp_path):
    text = "매출％ 1?2 a​b"
    raw = {
        "utf-8-sig": text.encode("utf-8-sig"), "utf-8": text.encode(), "cp949": "매출％ 뷁 1?2 ab".encode("cp949"), "utf-16": text.encode("utf-16"), "be": b"\xfe\xff" + text.encode("utf-16-be"), "le": text.encode("utf-16-le"),
        "broken": b"\xff\xfe\x00\xd8\x41", "empty": b"", ".hidden": b"x",
    }
    (tmp_path / "deep").mkdir()
    for name, content in raw.items():
        (tmp_path / "deep" / name).write_bytes(content)
    rows = encoded.read_encoded(spark, str(tmp_path), task_bytes=1)
    got = {x["path"].rpartition("/")[2]: x for x in rows.collect()}
    want = "매출% 1 2 ab"
    assert rows.rdd.getNumPartitions() == len(raw) - 1 == len(got)
    assert all(got[k]["text"] == want for k in ("utf-8-sig", "utf-8", "utf-16", "be", "le")) and got["cp949"]["text"] == "매출% 뷁 1 2 ab" and got["empty"]["text"] == ""
    assert [got[k]["encoding"] for k in ("utf-8-sig", "cp949", "utf-16", "be", "le")] == ["utf-8-sig", "cp949", "utf-16", "utf-16", "utf-16"]
    assert [x["path"].rpartition("/")[2] for x in encoded.unreadable(rows).collect()] == ["broken"] and "�" not in got["broken"]["text"]
    assert [len(x.paths) for x in encoded.planned([("a", 5), ("b", 5), ("c", 1 << 30), ("d", 1)], 3 << 20)] == [2, 1, 1]
    (tmp_path / "none").mkdir()
    assert encoded.read_encoded(spark, str(tmp_path / "none")).count() == 0
