"""Review of results: tags, priorities, weights, quality, counts and grades. Results have the columns of flat results: numbers, missing_all, status_*, score_*, coverage_pdf, proximity_pdf, direction_conflict_pdf, num_conflict_*, unit_match_*."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from veritrail import rules
from veritrail.functions.numbers import digits_only
from veritrail.functions.text import col
from veritrail.operators.order import numbered, numbered_within, page

#: Tags that call for attention, and the severe ones; further down the actions and reasons as they are shown.
ATTENTION = ["NUM_MISSING", "BIG_NUM_MISSING", "DIR_CONFLICT", "UNIT_MISMATCH", "NUM_CONFLICT"]
SEVERE = ["BIG_NUM_MISSING", "DIR_CONFLICT", "NUM_CONFLICT", "UNIT_MISMATCH"]


def _has(key: str) -> Column:
    return F.array_contains("tags", key)


def _numbers() -> Column:
    return F.size("numbers") > 0


def risk_tags(use_sheet_features: bool = False) -> Column:
    """Keys in fixed order. Spread evidence, direction and unit look at the pages alone, and a unit never mismatches, unless the sheets' features are used."""
    both = lambda k: F.greatest(f"{k}_pdf", f"{k}_xlsx") if use_sheet_features else F.col(f"{k}_pdf")
    direction = (F.col("direction_conflict_pdf") | F.col("direction_conflict_xlsx")) if use_sheet_features else F.col("direction_conflict_pdf")
    unit = _numbers() & (F.greatest("unit_match_pdf", "unit_match_xlsx") < 0.5) if use_sheet_features else F.lit(False)
    pdf, xlsx = F.col("status_pdf") == "SUPPORTED", F.col("status_xlsx") == "SUPPORTED"
    tests = {
        "NUM_MISSING": _numbers() & (F.size("missing_all") > 0),
        "BIG_NUM_MISSING": F.exists("missing_all", lambda n: F.length(digits_only(n)) >= 3),
        "DISPERSED": (both("coverage") >= 0.55) & (both("proximity") <= 0.15),
        "PDF_ONLY": pdf & ~xlsx, "JSON_ONLY": xlsx & ~pdf,
        "DIR_CONFLICT": direction, "NUM_CONFLICT": F.col("num_conflict_pdf") | F.col("num_conflict_xlsx"), "UNIT_MISMATCH": unit,
    }
    return F.array_compact(F.array(*[F.when(t, F.lit(k)) for k, t in tests.items()]))


def tag_labels(tags: Column | str) -> Column:
    return F.transform(col(tags), lambda t: F.create_map(*[F.lit(x) for p in rules.TAG_LABELS.items() for x in p])[t])


def needs_attention() -> Column:
    return (F.col("decision") != "CONFIRMED") & ((F.col("status_overall") != "SUPPORTED") | F.arrays_overlap("tags", F.array(*map(F.lit, ATTENTION))))


def evidence_insufficient() -> Column:
    return (F.col("status_overall") != "SUPPORTED") | F.arrays_overlap("tags", F.array(*map(F.lit, ATTENTION))) | (F.col("score_overall") <= 0.20)


def claim_weight() -> Column:
    # What numbers, tags and statuses add.
    plus = lambda test, v: F.when(test, v).otherwise(0.0)
    tags = sum((plus(_has(k), v) for k, v in (("NUM_MISSING", 0.4), ("BIG_NUM_MISSING", 0.6), ("DIR_CONFLICT", 0.7), ("UNIT_MISMATCH", 0.3))), F.lit(0.0))
    return 1.0 + plus(_numbers(), 0.3) + tags + F.when(F.col("status_overall") == "UNSUPPORTED", 0.4).when(F.col("status_overall") == "PARTIAL", 0.2).otherwise(0.0)


def must_review() -> Column:
    return (F.col("decision") == "NONE") & (evidence_insufficient() | (claim_weight() >= 1.8) | F.arrays_overlap("tags", F.array(*map(F.lit, SEVERE))))


def recommended_action() -> Column:
    st = F.col("status_overall")
    return (
        F.when(_has("DIR_CONFLICT") | _has("BIG_NUM_MISSING"), "수정 권장").when((st == "UNSUPPORTED") & _numbers(), "수정/삭제 권장")
        .when((st == "SUPPORTED") & (F.size("tags") == 0), "확인 권장").when(st == "PARTIAL", "수정 또는 보류 권장").otherwise("검토 필요")
    )


def reason_codes() -> Column:
    return F.array_compact(F.array(
        F.when(_has("DISPERSED"), "R: 근거분산(coverage↑ proximity↓)"), F.when(_has("NUM_MISSING"), F.concat(F.lit("R: 숫자누락 "), F.size("missing_all").cast("string"), F.lit("개"))),
        F.when(_has("DIR_CONFLICT"), "R: 방향성 모순"), F.when(_has("UNIT_MISMATCH"), "R: 단위 불일치"),
        F.when(F.col("status_overall") == "UNSUPPORTED", "R: 근거미확인").when(F.col("status_overall") == "PARTIAL", "R: 부분근거"),
    ))


def priority_rank() -> Column:
    st = F.col("status_overall")
    # Places by status, and what tags take off.
    base = F.when(st == "UNSUPPORTED", F.when(_numbers(), 0.0).otherwise(1.0)).when(st == "PARTIAL", F.when(_numbers(), 2.0).otherwise(3.0)).otherwise(5.0)
    less = sum((F.when(_has(k), v).otherwise(0.0) for k, v in (("NUM_MISSING", 0.6), ("BIG_NUM_MISSING", 0.4), ("DIR_CONFLICT", 0.6), ("UNIT_MISMATCH", 0.2), ("DISPERSED", 0.15))), F.lit(0.0))
    return base - less + (1.0 - F.least(F.greatest("score_overall", F.lit(0.0)), F.lit(1.0)))


#: Base by decision; change by status and decision.
BASE = {"CONFIRMED": 0.92, "EDIT": 0.70, "DELETE": 0.52, "HOLD": 0.58, "NONE": 0.25}
CHANGE = {
    "SUPPORTED": {"CONFIRMED": 0.05, "EDIT": -0.05, "DELETE": -0.14, "HOLD": 0.0, "NONE": -0.08},
    "PARTIAL": {"CONFIRMED": 0.04, "EDIT": -0.08, "DELETE": -0.18, "HOLD": -0.02, "NONE": -0.12},
    "UNSUPPORTED": {"CONFIRMED": 0.03, "EDIT": -0.10, "DELETE": -0.22, "HOLD": -0.05, "NONE": -0.20},
}


def quality_action_score() -> Column:
    """What a claim adds to its report's quality, 0 to 1, once decided on."""
    s = F.least(F.greatest("score_overall", F.lit(0.0)), F.lit(1.0))
    first = F.when((F.col("status_overall") == "SUPPORTED") & (s < 0.35), "PARTIAL").otherwise(F.col("status_overall"))
    st = F.when((first == "PARTIAL") & (s < 0.20), "UNSUPPORTED").otherwise(first)
    d = F.col("decision")
    table = F.create_map(*[x for a, row in CHANGE.items() for b, v in row.items() for x in (F.lit(f"{a}:{b}"), F.lit(BASE[b] + v))])
    gain = (
        F.when(d == "CONFIRMED", F.when(st == "SUPPORTED", 0.13).when(st == "PARTIAL", 0.11).otherwise(0.10) * s + F.when(s >= 0.85, 0.015).otherwise(0.0))
        .when(d == "EDIT", 0.08 * s - 0.05 * (1 - s)).when(d == "DELETE", 0.06 * s - 0.14 * (1 - s)).when(d == "HOLD", 0.05 * s).otherwise(0.02 * s)
    )
    sure = d == "CONFIRMED"
    against = F.when(sure, 0.12 + 0.20 * (1 - s)).otherwise(1.0)
    lacking = F.when(sure, 0.10 + 0.25 * (1 - s)).otherwise(0.55 + 0.45 * (1 - s))
    lost = sum((F.when(_has(k), v * scale).otherwise(0.0) for k, v, scale in (("DIR_CONFLICT", 0.22, against), ("NUM_CONFLICT", 0.22, against), ("BIG_NUM_MISSING", 0.12, lacking), ("UNIT_MISMATCH", 0.08, lacking), ("NUM_MISSING", 0.05, lacking))), F.lit(0.0))
    q = table[F.concat_ws(":", st, d)] + gain - lost
    return F.least(F.greatest(F.when(sure, F.greatest(q, F.lit(0.78))).otherwise(q), F.lit(0.0)), F.lit(1.0))


def alignment_mismatch() -> Column:
    """1 where the decision is not what the status leads to expect, 0 where it is, null before a decision."""
    d, st = F.col("decision"), F.col("status_overall")
    fits = F.when(st == "SUPPORTED", d == "CONFIRMED").when(st == "PARTIAL", d.isin("EDIT", "HOLD")).otherwise(d.isin("EDIT", "DELETE", "HOLD"))
    return F.when(d != "NONE", F.when(fits, 0.0).otherwise(1.0))


def latest_decision(decisions: DataFrame) -> DataFrame:
    """decisions: case_id, claim_id, decision, note, updated_at. The last of each claim; of several at one time the first by decision and note."""
    order = Window.partitionBy("case_id", "claim_id").orderBy(F.desc("updated_at"), "decision", "note")
    return decisions.withColumn("r", F.row_number().over(order)).where("r = 1").drop("r")


def batch_decision(decisions: DataFrame, ids: DataFrame, decision: str, at: Column | None = None) -> DataFrame:
    """The log with one decision added for all of ids (case_id, claim_id); notes are kept."""
    notes = latest_decision(decisions).select("case_id", "claim_id", "note")
    return decisions.unionByName(ids.select("case_id", "claim_id").distinct().join(notes, ["case_id", "claim_id"], "left").select("case_id", "claim_id", F.lit(decision).alias("decision"), F.coalesce("note", F.lit("")).alias("note"), (at if at is not None else F.current_timestamp()).alias("updated_at")))


def results_with_decisions(results: DataFrame, decisions: DataFrame) -> DataFrame:
    last = latest_decision(decisions).select("case_id", "claim_id", "decision", "note", "updated_at")
    joined = results.join(last, ["case_id", "claim_id"], "left")
    return joined.withColumn("decision", F.coalesce("decision", F.lit("NONE"))).withColumn("note", F.coalesce("note", F.lit("")))


def reviewed(results: DataFrame, decisions: DataFrame, use_sheet_features: bool = False) -> DataFrame:
    """Results with decision, tags, weight, quality and the rest of the review's columns."""
    base = results_with_decisions(results, decisions).withColumn("tags", risk_tags(use_sheet_features))
    return base.withColumns({"weight": claim_weight(), "quality": quality_action_score(), "mismatch": alignment_mismatch(), "priority": priority_rank(), "insufficient": evidence_insufficient(), "attention": needs_attention(), "must_review": must_review(), "action": recommended_action(), "reasons": reason_codes()})


def review_kpis(rows: DataFrame) -> DataFrame:
    st = F.col("status_overall")
    return rows.groupBy("case_id").agg(F.count("*").alias("total"), F.count_if(st == "SUPPORTED").alias("supported"), F.count_if(st == "PARTIAL").alias("partial"), F.count_if(st == "UNSUPPORTED").alias("unsupported"), F.count_if(_has("NUM_MISSING")).alias("number_risk"), F.count_if(F.col("decision") != "NONE").alias("decided"))


def review_scores(rows: DataFrame) -> DataFrame:
    """A case's quality, completion and shares, in percent, and its counts."""
    d, w = F.col("decision"), F.col("weight")
    sums = rows.groupBy("case_id").agg(
        F.count("*").alias("total"), F.count_if(d != "NONE").alias("reviewed"), F.sum(w).alias("weight_sum"), F.sum(w * F.col("quality")).alias("q"), F.sum(F.when(d == "EDIT", w).otherwise(0.0)).alias("e"),
        F.sum(F.coalesce(w * F.col("mismatch"), F.lit(0.0))).alias("m"), F.count_if(d == "DELETE").alias("deleted"),
        F.count_if((F.col("status_overall") == "UNSUPPORTED") & (d == "CONFIRMED") & _numbers()).alias("audit_risk"), F.count_if((d == "NONE") & F.col("insufficient")).alias("required_undecided"),
    )
    share = lambda part, of: F.coalesce(100.0 * F.try_divide(F.col(part).cast("double"), F.col(of).cast("double")), F.lit(0.0))
    return sums.select("case_id", "total", "reviewed", "weight_sum", share("q", "weight_sum").alias("quality_score"), share("reviewed", "total").alias("completion"), "audit_risk", share("e", "weight_sum").alias("edit_share"), share("m", "weight_sum").alias("mismatch_share"), share("deleted", "total").alias("delete_share"), "required_undecided")


def report_grade(score: Column | str) -> Column:
    return F.coalesce(*[F.when(col(score) >= at, F.lit(g)) for at, g in rules.GRADES], F.lit("F"))


def kpi_drilldown(rows: DataFrame, *kinds: str) -> DataFrame:
    """kind, case_id, claim_id: the claims behind each of these figures, in one pass over the rows."""
    d = F.col("decision")
    tests = {
        "quality_kept": d != "DELETE", "completion_unreviewed": d == "NONE", "edit": d == "EDIT", "delete": d == "DELETE", "mismatch": F.col("mismatch") == 1.0,
        "audit_risk": (F.col("status_overall") == "UNSUPPORTED") & (d == "CONFIRMED") & _numbers(),
    }
    held = F.array_compact(F.array(*[F.when(tests[k], F.lit(k)) for k in kinds or tests]))
    return rows.select(F.explode_outer(held).alias("kind"), "case_id", "claim_id").where("kind is not null")


def id_ranges(spec: str | None) -> list[tuple[int, int]]:
    """Ranges of a text like 1-10, 12; what is neither a number nor a range is passed over."""
    import re

    out = []
    for part in (spec or "").split(","):
        if m := re.fullmatch(r"\s*(\d+)\s*(?:-\s*(\d+)\s*)?", part):
            a, b = int(m[1]), int(m[2] or m[1])
            out.append((min(a, b), max(a, b)))
    return out


def filter_results(rows: DataFrame, query: str = "", ids: str = "", status: str = "ALL", risk: str = "ALL", decision: str = "ALL") -> DataFrame:
    q = (query or "").strip().lower()
    if q:
        rows = rows.where(F.contains(F.lower("claim_norm"), F.lit(q)) | F.contains(F.lower(F.array_join("numbers", " ")), F.lit(q)))
    if ranges := id_ranges(ids):
        test = F.lit(False)
        for a, b in ranges:
            test = test | F.col("claim_id").between(a, b)
        rows = rows.where(test)
    for name, value in (("status_overall", status), ("decision", decision)):
        if value != "ALL":
            rows = rows.where(F.col(name) == value)
    return rows.where(_has(risk)) if risk != "ALL" else rows


def _queued(rows: DataFrame, by: str) -> DataFrame:
    """The rows with the key that a queue is in ascending order of."""
    key = {"priority": F.col("priority"), "id_asc": F.col("claim_id"), "score_desc": -F.col("score_overall"), "score_asc": F.col("score_overall")}[by]
    return rows.withColumn("queue_key", key)


def review_queue(rows: DataFrame, by: str = "priority") -> DataFrame:
    """Each case's rows with their place in its queue; equal ones by claim. A case's rows may be in many tasks."""
    return numbered_within(_queued(rows, by), "case_id", ["queue_key", "claim_id"]).drop("queue_key")


def whole_queue(rows: DataFrame, by: str = "priority") -> DataFrame:
    """All rows with their place in one queue over all cases; equal ones by case and claim."""
    return numbered(_queued(rows, by), ["queue_key", "case_id", "claim_id"])


def queue_page(rows: DataFrame, by: str = "priority", size: int = 50, after: tuple | None = None) -> DataFrame:
    """A page of the queue over all cases, in order. after: queue_key, case_id, claim_id of the last row of the page before."""
    return page(_queued(rows, by), ["queue_key", "case_id", "claim_id"], size, after)


def grade_counts(scores: DataFrame) -> DataFrame:
    """grade, cases: how many cases have each grade. scores: quality_score."""
    return scores.groupBy(report_grade("quality_score").alias("grade")).agg(F.count("*").alias("cases"))


def review_export(rows: DataFrame) -> DataFrame:
    """The columns of the shared review file."""
    flat = F.translate("claim_norm", "\n", " ")
    quoted = F.replace(flat, F.lit('"'), F.lit('""'))
    joined = lambda c: F.array_join(c, "|")
    from veritrail.functions.text import status_label

    three = lambda c: F.format_string("%.3f", F.col(c))
    return rows.select(
        "case_id", "claim_id", quoted.alias("claim_text"), F.col("status_overall").alias("system_status"), F.round("weight", 1).alias("quality_w"), F.round("quality", 1).alias("quality_a"), joined("tags").alias("quality_tags"),
        "decision", F.translate("note", "\n", " ").alias("note"), "updated_at", three("score_pdf").alias("pdf_score"), three("score_xlsx").alias("xlsx_score"), joined("missing_all").alias("missing_numbers"), joined(tag_labels("tags")).alias("risk_tags"),
        F.col("claim_id").alias("id"), *[x for s in ("overall", "pdf", "xlsx") for x in (status_label(f"status_{s}").alias(s), F.col(f"status_{s}").alias(f"{s}_raw"), three(f"score_{s}").alias(f"score_{s}"))],
        F.size("numbers").alias("num_total"), F.size("missing_all").alias("num_missing"), joined("numbers").alias("numbers"), quoted.alias("claim"),
    )


def locate_claims(rows: DataFrame, blocks: DataFrame) -> DataFrame:
    """blocks: case_id, block_id, text. Claims short of evidence with the first block of their report that holds them, and how to mark them."""
    from veritrail.functions.text import collapsed
    from veritrail.operators.match import first_text

    asked = rows.where("insufficient").select("case_id", F.lit("").alias("source"), "claim_id", collapsed(F.col("claim_norm")).alias("needle"), F.when(F.col("decision").isin("CONFIRMED", "EDIT", "DELETE"), F.lower("decision")).otherwise("must_review").alias("mark"))
    held = blocks.select("case_id", F.lit("").alias("source"), F.col("block_id").alias("at"), collapsed(F.col("text")).alias("text"))
    found = first_text(asked.where("needle <> ''").select("case_id", "source", "needle").distinct(), held)
    return asked.join(found, ["case_id", "source", "needle"]).select("case_id", "claim_id", "mark", F.col("at").alias("block_id"))
