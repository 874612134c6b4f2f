"""Reports into claims, texts into chunks: one row into many, without a shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from veritrail.functions import text as T
from veritrail.functions.text import LINE_BREAK, col, collapsed, normalize_invisibles, once, protect_acronym_dots, restore_acronym_dots, trimmed, without_inner_question_marks

#: The least length of a claim, lines of a keyed kind that go, separators of tables, rules inside text; marks and bullets that become paragraph breaks, and what they become.
MIN_CLAIM = 8
KEYED = r"^\s*\(?\s*씅씅\s*[:씅]\s*[^)]+\)?\s*$"
SEPARATOR = r"^\|\s*[-: ]+\s*(\|\s*[-: ]+\s*)+\|$"
RULE_INSIDE = r"(?U)\s(?:-{3,}|\*{3,}|_{3,})\s"
BREAKS = ((r"\s*\(\s*[+-]\s*\)\s*", "\n\n"), (r"(?md)(^|\s)\+\s+(?=\D)", "$1\n\n"), (r"(?md)(^|\s)-\s+(?=\D)", "$1\n\n"), (r"\n{3,}", "\n\n"))


def _of_table(block: Column) -> Column:
    lines = F.filter(F.transform(F.split(block, LINE_BREAK), lambda x: without_inner_question_marks(trimmed(x))), lambda x: x.startswith("|") & x.endswith("|") & ~x.rlike(SEPARATOR))
    rows = lambda held: F.filter(F.transform(held, collapsed), lambda x: ~T._is_heading(x) & ~T._is_excluded(x) & (F.length(x) >= MIN_CLAIM))
    return once(lines, lambda held: F.when(F.coalesce(T._of_row(F.get(held, F.lit(0)), T._is_header), F.lit(False)), F.array().cast("array<string>")).otherwise(rows(held)))


def _of_prose(block: Column) -> Column:
    pieces = F.split(block, r"(?<=(?<!\d)\.)(?!\d)")
    whole = lambda x: once(collapsed(without_inner_question_marks(x)), lambda y: F.when(y.rlike("-{3}|\\*{3}|_{3}"), F.regexp_replace(y, RULE_INSIDE, " ")).otherwise(y))
    return F.filter(F.transform(pieces, whole), lambda x: (F.length(x) >= MIN_CLAIM) & ~T._is_heading(x))


def claims_of(text: Column | str, repair_acronyms: bool = False) -> Column:
    """The claims of a report in order: table rows, and sentences that end at a dot which no digit touches. repair_acronyms: acronyms come back as they were; else they keep part of the mark that stood for their dots, as in the reports made so far."""
    mark = T.WHOLE_DOT if repair_acronyms else T.DOT
    bare = F.regexp_replace(F.regexp_replace(normalize_invisibles(F.coalesce(col(text), F.lit(""))), r"(?s)```.*?```", ""), r"\[\^[^\]]+\]", "")
    # What goes may bring a question mark between letters, so they are looked for again; then every line is normal.
    lines = F.filter(F.split(without_inner_question_marks(bare), LINE_BREAK), lambda x: ~(T._is_heading(x) | T._is_numbered_title(x) | x.rlike(KEYED) | T._is_rule_line(x) | T._is_excluded(x)))
    joined = F.translate(F.array_join(lines, "\n"), "씅", "-")
    for pattern, into in BREAKS:
        joined = F.regexp_replace(joined, pattern, into)
    blocks = F.filter(F.transform(F.split(protect_acronym_dots(joined, mark), r"\n{2,}"), trimmed), lambda b: b != "")
    table = lambda b: b.contains("|") & b.contains("\n") & b.rlike(r"(?md)^\|.*\|$")
    found = F.flatten(F.transform(blocks, lambda b: F.when(T._is_excluded(b), F.array().cast("array<string>")).when(table(b), _of_table(b)).otherwise(_of_prose(b))))
    kept = F.filter(found, lambda c: ~(T._is_heading(c) | T._is_rule_line(c) | T._is_numbered_title(c)))
    return F.transform(kept, lambda c: restore_acronym_dots(c, mark))


def split_claims(reports: DataFrame, repair_acronyms: bool = False) -> DataFrame:
    """reports: case_id, text (one report a case). case_id, claim_id from 1, claim_text, claim_norm."""
    found = reports.select("case_id", claims_of("text", repair_acronyms).alias("claims"))
    return found.select("case_id", F.posexplode_outer("claims").alias("at", "claim_text")).where("claim_text is not null").select("case_id", (F.col("at") + 1).alias("claim_id"), "claim_text", normalize_invisibles("claim_text").alias("claim_norm"))


def chunk_text(text: Column | str, size: int = 900, overlap: int = 120) -> Column:
    """Windows of size characters, each overlapping the one before; stripped, blank ones dropped."""
    if not 0 <= overlap < size:
        raise ValueError("overlap must be less than size")
    whole = F.coalesce(col(text), F.lit(""))
    last = F.greatest(F.ceil((F.length(whole) - size) / (size - overlap)), F.lit(0)).cast("int")
    pieces = F.transform(F.sequence(F.lit(0), last), lambda k: trimmed(F.substring(whole, k * (size - overlap) + 1, F.lit(size))))
    return F.filter(pieces, lambda x: x != "")


def chunks(texts: DataFrame, source: str, place: str = "page", size: int = 900, overlap: int = 120, keep: list[str] | None = None) -> DataFrame:
    """texts: case_id, place, text, and file_idx and sheet if there are any. case_id, source, place, file_idx, chunk_id, ord, text. ord is what a case's chunks are in order by: file, sheet (by name), place and chunk; no case is gathered to number them. keep: more columns of texts to keep."""
    own = lambda name, kind, none: (F.coalesce(name, none) if name in texts.columns else none).cast(kind).alias(name)
    cut = texts.select("case_id", *(keep or []), F.lit(source).alias("source"), F.col(place).cast("int").alias("place"), own("file_idx", "int", F.lit(0)), own("sheet", "string", F.lit("")), F.posexplode_outer(chunk_text("text", size, overlap)).alias("chunk_id", "text")).where("text is not null")
    return cut.select("case_id", *(keep or []), "source", "place", "file_idx", "chunk_id", F.struct("file_idx", "sheet", "place", "chunk_id").alias("ord"), "text")
