"""Cases from report and sources to claims with evidence, scores and statuses."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, functions as F

from veritrail.functions import numbers as N, scoring as S
from veritrail.functions.text import norm_for_match, normalize_invisibles, once, status_label, word_tokens
from veritrail.operators import claims as C, match as M, retrieve as R
from veritrail.operators.grouped import by_group
from veritrail.operators.index import Index
from veritrail.sources.staging import staged

KEYS = ["case_id", "claim_id"]


def asked_tokens(claims: DataFrame) -> DataFrame:
    """case_id, claim_id, token, numeric, weight (without idf), needles: what a claim asks of a source's words and numbers."""
    words = F.transform(R.without_stop_words(word_tokens("claim_norm")), lambda w: F.struct(w.alias("token"), F.lit(False).alias("numeric")))
    plain = F.transform("numbers", lambda n: F.struct(n.alias("token"), F.lit(True).alias("numeric")))
    each = claims.select(*KEYS, F.explode_outer(F.concat(words, plain)).alias("t")).where("t is not null").select(*KEYS, "t.token", "t.numeric")
    each = each.groupBy(*KEYS, "token").agg(F.max("numeric").alias("numeric"))
    digits = F.length(N.digits_only(F.col("token")))
    weight = F.when(F.col("numeric"), F.when(digits >= 3, 2.0).otherwise(1.0) * F.greatest(F.when(digits > 0, digits).otherwise(F.length("token")), F.lit(1))).otherwise(F.greatest(F.length("token"), F.lit(1)).cast("double"))
    needles = F.when(F.col("numeric"), F.transform(N.number_variants("token"), F.lower)).otherwise(F.array(norm_for_match("token")))
    return each.select(*KEYS, "token", "numeric", weight.alias("weight"), needles.alias("needles"))


def coverage(claims: DataFrame, found: DataFrame, pages: DataFrame, idf: DataFrame) -> DataFrame:
    """Weighted shares of a claim's words and numbers: in its evidence and in its whole source, blended. case_id, source, claim_id, coverage."""
    asked = asked_tokens(claims)
    normal = pages.select("case_id", "source", norm_for_match("text").alias("text"))
    per_source = asked.join(found.select(*KEYS, "source", norm_for_match("evidence_text").alias("near")), KEYS)
    per_source = staged(per_source, "asked")
    needles = per_source.select("case_id", "source", F.explode("needles").alias("needle")).distinct()
    held = M.present(needles, normal).withColumn("held", F.lit(True))
    token_keys = ["case_id", "source", "claim_id", "token"]
    far = per_source.select(*token_keys, F.explode("needles").alias("needle")).join(held, ["case_id", "source", "needle"]).groupBy(*token_keys).agg(F.max("held").alias("far"))
    normed = idf.withColumnRenamed("token", "word")
    rated = per_source.withColumn("word", F.when(~F.col("numeric"), norm_for_match("token"))).join(normed, ["case_id", "source", "word"], "left").join(far, token_keys, "left")
    weighed = rated.withColumn("w", F.col("weight") * F.when(F.col("numeric"), 1.0).otherwise(F.coalesce("idf", F.lit(1.0))))
    near = F.exists("needles", lambda n: F.contains(F.col("near"), n))
    shares = weighed.groupBy("case_id", "source", "claim_id").agg((F.sum(F.when(near, F.col("w")).otherwise(0.0)) / F.sum("w")).alias("local"), (F.sum(F.when(F.col("far"), F.col("w")).otherwise(0.0)) / F.sum("w")).alias("whole"))
    return shares.select("case_id", "source", "claim_id", F.least(F.greatest("local", 0.85 * F.col("whole") + 0.15 * F.col("local"), F.lit(0.0)), F.lit(1.0)).alias("coverage"))


def matched_anywhere(claims: DataFrame, pages: DataFrame, amounts: DataFrame | None) -> DataFrame:
    """case_id, source, claim_id, matched: a claim's numbers that the whole source has, as text or as an amount."""
    each = claims.select(*KEYS, F.posexplode("numbers").alias("at", "number"))
    needles = staged(each.select("case_id", "number").distinct().select("case_id", "number", F.explode(N.number_variants("number")).alias("needle")), "needles")
    sources = pages.select("case_id", "source").distinct()
    asked = needles.join(sources, "case_id").select("case_id", "source", "needle").distinct()
    normal = pages.select("case_id", "source", normalize_invisibles("text").alias("text"))
    held = needles.join(M.present(asked, normal), ["case_id", "needle"]).select("case_id", "source", "number").distinct()
    if amounts is not None:
        valued = each.select("case_id", "number", N.claim_amount("number").alias("v")).where("v is not null").distinct()
        hit = valued.join(M.amount_match(valued.select("case_id", "v").distinct(), amounts.select("case_id", F.col("value_mkrw").alias("x"))), ["case_id", "v"]).select("case_id", F.lit("xlsx").alias("source"), "number", F.lit(True).alias("amount"))
        held = held.withColumn("amount", F.lit(False)).unionByName(hit).groupBy("case_id", "source", "number").agg(F.max("amount").alias("amount"))
    else:
        held = held.withColumn("amount", F.lit(False))
    rows = F.array_sort(F.collect_list(F.struct("at", "number", "amount")))
    amounts_of = F.transform(F.filter("rows", lambda r: r["amount"]), lambda r: r["number"])  # before the others, as they are listed
    return each.join(held, ["case_id", "number"]).groupBy("case_id", "source", "claim_id").agg(rows.alias("rows")).select("case_id", "source", "claim_id", F.array_distinct(F.concat(amounts_of, F.col("rows.number"))).alias("matched"), amounts_of.alias("matched_amounts"))


#: As numbers.digits_only(): what is no digit of ASCII. Spellings of numbers have no letters that Python lowers otherwise than Spark.
_NO_DIGIT = re.compile(r"[^0-9]")


def held_in_sources(claims: DataFrame, found: DataFrame, pages: DataFrame, idf: DataFrame, amounts: DataFrame | None) -> DataFrame:
    """case_id, source, claim_id, coverage, matched, matched_amounts: coverage() and matched_anywhere() of each claim and source found, in one task for each source of a case with all its texts and claims. Cases with a source of more than M.TEXTS texts, or that ask more than M.NEEDLES needles, go through those two as joins."""
    each = claims.join(found.select(*KEYS, "source", norm_for_match("evidence_text").alias("near")), KEYS)
    words = F.transform(F.array_except(R.without_stop_words(word_tokens("claim_norm")), "numbers"), norm_for_match)
    number = "numbers array<string>, spellings array<array<string>>, values array<double>, words array<string>"
    kinds = {"kind": "int", "id": dict(claims.dtypes)["claim_id"], "text": "string", "plain": "string", "value": "double"} | dict(x.split(" ", 1) for x in number.split(", "))
    shape = lambda df, **have: df.select("case_id", "source", *[have.get(x, F.lit(None)).cast(k).alias(x) for x, k in kinds.items()])

    many = pages.groupBy("case_id", "source").agg(F.count("*").alias("n")).where(F.col("n") > M.TEXTS).select("case_id")
    asking = claims.groupBy("case_id").agg(F.sum(F.size(F.flatten("spellings")) + F.size(word_tokens("claim_norm"))).alias("n")).where(F.col("n") > M.NEEDLES).select("case_id")
    large = staged(many.union(asking).distinct(), "large")
    some = not large.isEmpty()
    small = (lambda df: df.join(large, "case_id", "left_anti")) if some else (lambda df: df)

    rows = shape(small(pages), kind=F.lit(0), text=norm_for_match("text"), plain=normalize_invisibles("text"))
    rows = rows.unionByName(shape(small(idf), kind=F.lit(1), text=F.col("token"), value=F.col("idf")))
    if amounts is not None:
        rows = rows.unionByName(shape(small(amounts.select("case_id", F.lit("xlsx").alias("source"), "value_mkrw").where("value_mkrw is not null")), kind=F.lit(2), value=F.col("value_mkrw")))
    rows = rows.unionByName(shape(small(each), kind=F.lit(3), id=F.col("claim_id"), text=F.col("near"), numbers=F.col("numbers"), spellings=F.col("spellings"), values=F.transform("numbers", N.claim_amount), words=words))

    def step(key: tuple, rows: list[tuple]) -> list[tuple]:
        normal, plain, weights, amounts, asks = [], [], {}, set(), []
        for kind, id_, text, raw, value, *asked in rows:
            if kind == 0:
                normal.append(text or "")
                plain.append(raw or "")
            elif kind == 1:
                weights[text] = value
            elif kind == 2:
                amounts.add(value)
            else:
                asks.append((id_, text or "", *asked))
        if not asks:
            return []
        # Needles have no line break, so none goes over the end of a text.
        spelled = M.occurring({v for x in asks for vs in x[3] for v in vs}, "\n".join(plain))
        far = M.occurring({v for x in asks for vs in x[3] for v in map(str.lower, vs)} | {w for x in asks for w in x[5]}, "\n".join(normal)) if normal else set()
        valued = M.near_amounts({v for x in asks for v in x[4] if v is not None}, amounts)
        out = []
        for id_, near, numbers, spellings, values, words in asks:
            total = local = whole = 0.0
            for n, needles in zip(numbers, spellings, strict=True):
                digits = len(_NO_DIGIT.sub("", n))
                w = (2.0 if digits >= 3 else 1.0) * max(digits or len(n), 1)
                needles = [x.lower() for x in needles]
                total += w
                local += w if any(x in near for x in needles) else 0.0
                whole += w if any(x in far for x in needles) else 0.0
            for word in words:
                w = max(len(word), 1) * weights.get(word, 1.0)
                total += w
                local += w if word in near else 0.0
                whole += w if word in far else 0.0
            local, whole = (local / total, whole / total) if total else (0.0, 0.0)
            by_amount = [n for n, v in zip(numbers, values, strict=True) if v in valued]
            held = [n for n, vs, v in zip(numbers, spellings, values, strict=True) if v in valued or plain and any(x in spelled for x in vs)]
            out.append((id_, min(max(local, 0.85 * whole + 0.15 * local, 0.0), 1.0), list(dict.fromkeys(by_amount + held)), by_amount))
        return out

    told = by_group(rows, ["case_id", "source"], ["kind"], step, "claim_id =id, coverage double, matched array<string>, matched_amounts array<string>", kept=2)
    if not some:
        return told
    mine = lambda df: df.join(large, "case_id", "left_semi")
    by_join = coverage(mine(claims), mine(found), mine(pages), mine(idf)).join(matched_anywhere(mine(claims), mine(pages), mine(amounts) if amounts is not None else None), [*KEYS, "source"], "full")
    return told.unionByName(by_join.select(told.columns))


def features(claims: DataFrame, chunks: DataFrame, pages: DataFrame, amounts: DataFrame | None = None, top_k: int = 3, thresholds: dict | None = None, files: DataFrame | None = None, index: Index | None = None) -> DataFrame:
    """A row for each claim and source it has: similarity, evidence, features, score and status. files: case_id, file_idx, file_name of the sheets, where they have names. index: the sources' stored index, else their n-grams and words are counted."""
    top, idf = (index.topk(claims, top_k), index.word_idf()) if index else (R.topk_evidence(claims, chunks, top_k), R.word_idf(chunks))
    found = staged(R.evidence(top, chunks, files), "evidence")
    base = claims.join(found, KEYS)
    covered = base.join(staged(held_in_sources(claims, found, pages, idf, amounts), "held"), [*KEYS, "source"], "left")
    none = F.array().cast("array<string>")
    matched = covered.withColumn("coverage", F.coalesce("coverage", F.lit(0.0))).withColumn("matched", F.coalesce("matched", none)).withColumn("matched_amounts", F.coalesce("matched_amounts", none))
    near = once(norm_for_match("evidence_text"), lambda e: F.filter("numbers", lambda n, i: F.exists(F.get("spellings", i), lambda v: F.contains(e, v))))
    asked = F.when(F.size("big") > 0, F.col("big")).otherwise(F.col("numbers"))
    rich = (
        matched.withColumn("near", F.when(F.col("source") == "xlsx", F.array_intersect(asked, "matched_amounts")).otherwise(near))
        .withColumn("big_num_recall", S.big_number_recall(F.col("numbers"), F.col("big"), F.col("near")))
        .withColumn("exact_big_num_matches", F.size(F.array_intersect("big", "near")))
        .withColumn("proximity", S.proximity("claim_norm", "evidence_text", "numbers", "spellings"))
        .withColumn("unit_match", S.unit_match("claim_norm", "evidence_text"))
        .withColumn("direction_score", S.direction_score("claim_norm", "evidence_text"))
        .withColumn("direction_conflict", S.direction_conflict("claim_norm", "evidence_text"))
        .withColumn("fact_block", S.fact_block("claim_text", "evidence_text", numbers="numbers", spellings="spellings"))
        .withColumn("has_numbers", F.size("numbers") > 0)
    )
    c = F.col
    scored = rich.withColumn("score", S.final_score(c("sim_best"), c("coverage"), c("fact_block"), c("proximity"), c("big_num_recall"), c("unit_match"), c("direction_score"), c("direction_conflict"), c("has_numbers")))
    status = S.decide_status(c("score"), c("sim_best"), c("coverage"), c("big_num_recall"), c("exact_big_num_matches"), c("has_numbers"), c("direction_conflict"), c("fact_block"), N.has_metric("claim_text"), **(thresholds or {}))
    return scored.withColumn("status", status)


def prepared(reports: DataFrame, repair_acronyms: bool = False) -> DataFrame:
    return C.split_claims(reports, repair_acronyms).withColumn("numbers", N.extract_numbers("claim_norm")).withColumn("big", N.big_numbers("numbers")).withColumn("spellings", F.transform("numbers", N.number_variants))


def json_pages(docs: DataFrame) -> DataFrame:
    """case_id, page, text of JSON documents (case_id, json): their rows are the pages of a case that has no others."""
    from veritrail.sources.tables import json_text_rows

    return json_text_rows(docs).withColumnRenamed("row_no", "page")


def source_texts(pages: DataFrame, cells: DataFrame | None = None) -> DataFrame:
    """case_id, source, file_idx, sheet, place, text of pages (case_id, page, text) and cells as in sources.tables."""
    from veritrail.sources.tables import clean_page, sheet_rows

    texts = pages.select("case_id", F.lit("pdf").alias("source"), F.lit(0).alias("file_idx"), F.lit("").alias("sheet"), F.col("page").alias("place"), clean_page("text").alias("text"))
    return texts if cells is None else texts.unionByName(sheet_rows(cells).select("case_id", F.lit("xlsx").alias("source"), "file_idx", "sheet", F.col("row_no").alias("place"), "text"))


def file_names(cells: DataFrame | None) -> DataFrame | None:
    """case_id, file_idx, file_name, where the cells have names."""
    return None if cells is None or "file_name" not in cells.columns else cells.groupBy("case_id", "file_idx").agg(F.min("file_name").alias("file_name"))


def verify_cases(reports: DataFrame, pages: DataFrame, cells: DataFrame | None = None, top_k: int = 3, thresholds: dict | None = None, repair_acronyms: bool = False) -> DataFrame:
    """reports: case_id, text; pages: case_id, page, text, or json_pages(); cells as in sources.tables. A row for each claim of a case that has pages, with what each source says and the combined status. Cases without text in their pages come back in cases_without_text()."""
    from veritrail.sources.tables import sheet_amounts

    claims = staged(prepared(reports, repair_acronyms), "claims")
    amounts = staged(sheet_amounts(cells), "amounts") if cells is not None else None
    texts = staged(source_texts(pages, cells), "texts")
    chunks = staged(C.chunks(texts.where("source = 'pdf'"), "pdf", "place").unionByName(C.chunks(texts.where("source = 'xlsx'"), "xlsx", "place")), "chunks")
    return _results(claims, features(claims, chunks, texts.select("case_id", "source", "text"), amounts, top_k, thresholds, file_names(cells)), thresholds)


def index_sources(index: Index, pages: DataFrame, cells: DataFrame | None = None, removed: DataFrame | None = None) -> Index:
    """The next version of the index, with these pages and cells; removed: case_id, source, file_idx, sheet, place."""
    from veritrail.sources.tables import sheet_amounts

    amounts = None if cells is None else sheet_amounts(cells).select("case_id", F.lit("xlsx").alias("source"), "file_idx", "sheet", F.col("row_no").alias("place"), "value_mkrw")
    return index.updated(source_texts(pages, cells), removed, amounts, file_names(cells))


def verify_against(reports: DataFrame, index: Index, top_k: int = 3, thresholds: dict | None = None) -> DataFrame:
    """verify_cases() against sources of a stored index, without counting them again."""
    claims = staged(prepared(reports), "claims")
    return _results(claims, features(claims, index.chunks(), index.texts().select("case_id", "source", "text"), index.amounts(), top_k, thresholds, index.files(), index), thresholds)


def _results(claims: DataFrame, each: DataFrame, thresholds: dict | None) -> DataFrame:
    kept = ["status", "score", "sim_best", "coverage", "proximity", "big_num_recall", "exact_big_num_matches", "unit_match", "direction_score", "direction_conflict", "matched", "evidence"]
    each = staged(each.select(*KEYS, "source", *kept), "features")
    of = lambda s: each.where(F.col("source") == s).select(*KEYS, *[F.col(k).alias(f"{k}_{s}") for k in kept])
    both = claims.join(of("pdf"), KEYS).join(of("xlsx"), KEYS, "left")
    defaults = {"status_xlsx": "UNSUPPORTED", "score_xlsx": 0.0, "sim_best_xlsx": 0.0, "coverage_xlsx": 0.0, "proximity_xlsx": 0.0, "big_num_recall_xlsx": 0.5, "exact_big_num_matches_xlsx": 0, "unit_match_xlsx": 0.5, "direction_score_xlsx": 0.5, "direction_conflict_xlsx": False}
    both = both.fillna(defaults).withColumn("matched_xlsx", F.coalesce("matched_xlsx", F.array().cast("array<string>")))
    low = (thresholds or {}).get("number_partial", 0.22)
    union = F.array_union("matched_pdf", "matched_xlsx")
    missing = {s: F.array_except("numbers", f"matched_{s}") for s in ("pdf", "xlsx")}
    conflict = lambda s: (F.size("numbers") > 0) & (F.size(f"evidence_{s}") > 0) & (F.col(f"score_{s}") >= low) & (F.size(missing[s]) > 0)
    return both.withColumns({
        "status_overall": S.combine_status("status_pdf", "status_xlsx"),
        "score_overall": F.greatest("score_pdf", "score_xlsx"),
        "missing_pdf": missing["pdf"], "missing_xlsx": missing["xlsx"], "missing_all": F.array_except("numbers", union), "matched_all": F.filter("numbers", lambda n: F.array_contains(union, n)),
        "num_conflict_pdf": conflict("pdf"), "num_conflict_xlsx": F.coalesce(conflict("xlsx"), F.lit(False)),
    })


def cases_without_text(reports: DataFrame, pages: DataFrame) -> DataFrame:
    """case_id of reports none of whose pages has text."""
    from veritrail.sources.tables import clean_page

    return reports.select("case_id").distinct().join(pages.where(clean_page("text") != "").select("case_id"), "case_id", "left_anti")


def flat_report(results: DataFrame) -> DataFrame:
    """One plain row for each claim, in the columns of the shared report, case_id ahead; those of the first evidence are null, and blank in a CSV file, where there is none."""
    listed = lambda c: F.array_join(c, " | ")
    first = lambda s, f: F.get(f"evidence_{s}", F.lit(0))[f]
    pairs = lambda *names: [F.col(f"{k}_{s}") for k in names for s in ("pdf", "xlsx")]
    flags = lambda name: [F.col(f"{name}_{s}").cast("int").alias(f"{name}_{s}") for s in ("pdf", "xlsx")]
    out = [F.col("case_id"), F.col("claim_id")]
    for s in ("overall", "pdf", "xlsx"):
        out += [status_label(f"status_{s}").alias(f"status_{s}"), F.col(f"status_{s}").alias(f"raw_status_{s}")]
    out += [F.col(f"score_{s}").alias(f"best_score_{s}") for s in ("overall", "pdf", "xlsx")]
    out += pairs("sim_best", "coverage", "proximity", "big_num_recall", "exact_big_num_matches", "unit_match", "direction_score") + flags("direction_conflict")
    out += [F.size("numbers").alias("num_total"), F.size("matched_pdf").alias("pdf_num_matched"), F.size("matched_xlsx").alias("xlsx_num_matched"), F.size("missing_all").alias("num_missing_all")]
    out += [listed("numbers").alias("numbers_in_claim"), listed("matched_pdf").alias("matched_numbers_pdf"), listed("matched_xlsx").alias("matched_numbers_xlsx"), listed("missing_all").alias("missing_numbers_all"), *flags("num_conflict"), F.col("claim_norm").alias("claim_text")]
    for s, place in (("pdf", "page"), ("xlsx", "row")):
        out += [first(s, "page").alias(f"{s}_top_{place}"), first(s, "chunk_id").alias(f"{s}_top_chunk"), first(s, "score").alias(f"{s}_top_score"), first(s, "snippet").alias(f"{s}_top_snippet")]
    return results.select(*out)
