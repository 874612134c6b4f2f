"""Per-row text functions, as Column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

from veritrail import rules

HANGUL = "가-힣"
LINE_BREAK = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"
_BULLETS = r"^(?:[-*+]\s+)+"
#: White space as texts are stripped of it and split at it: Unicode's, and the four separators of ASCII.
SPACES = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
_SPACE = r"(?U)[\s\x1c-\x1f]"
#: Odd spaces and the replacement mark, which become spaces; full-width marks, which become ASCII; zero-width characters, which go.
ODD_SPACES, _WIDE, ZERO_WIDTH = "\u00a0\u202f\u2009\u200a\u2007\ufffd", "＃％，．", "\ufeff\u200b\u200c\u200d\u2060"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def once(c: Column, f: Callable[[Column], Column]) -> Column:
    """f of c, with c computed once however often f names it."""
    return F.get(F.transform(F.array(c), f), F.lit(0))


def trimmed(c: Column) -> Column:
    return F.btrim(c, F.lit(SPACES))


def collapsed(c: Column) -> Column:
    return trimmed(F.regexp_replace(c, rf"{_SPACE}+", " "))


def _plain_marks(c: Column) -> Column:
    return once(c, lambda t: F.when(F.octet_length(t) == F.length(t), t).when(t.rlike(f"[{ODD_SPACES}{_WIDE}{ZERO_WIDTH}]"), F.translate(t, ODD_SPACES + _WIDE + ZERO_WIDTH, " " * len(ODD_SPACES) + "#%,.")).otherwise(t))


def without_inner_question_marks(c: Column) -> Column:
    inside = f"[0-9A-Za-z{HANGUL}]"
    return once(c, lambda t: F.when(t.contains("?"), F.regexp_replace(t, rf"(?<={inside})\?(?={inside})", " ")).otherwise(t))


def normalize_invisibles(c: Column | str) -> Column:
    """Odd spaces become spaces, zero-width characters go, full-width marks become ASCII, and a question mark inside a word a space."""
    return without_inner_question_marks(_plain_marks(col(c)))


def norm_for_match(c: Column | str) -> Column:
    return collapsed(F.lower(normalize_invisibles(c)))


#: What stands for an acronym's dot: the fixed value, of which normalization takes a part away between letters, and one that it leaves alone.
DOT, WHOLE_DOT = "?DOT?", "\ue000"


def protect_acronym_dots(c: Column | str, mark: str = DOT) -> Column:
    return F.regexp_replace(col(c), r"(?i)(?<=[A-Z])\.(?=[A-Z]\.)|(?<=[A-Z]\.[A-Z])\.", mark)


def restore_acronym_dots(c: Column | str, mark: str = DOT) -> Column:
    return F.replace(col(c), F.lit(mark), F.lit("."))


def unique_keep_order(c: Column | str) -> Column:
    return F.array_distinct(F.filter(col(c), lambda x: x.isNotNull() & (x != "")))


def html_escape(c: Column | str) -> Column:
    out = col(c)
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#039;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def highlight_snippet(snippet: Column | str, tokens: Column | str) -> Column:
    """Marks the tokens that occur, longest first."""
    indexed = F.transform(unique_keep_order(tokens), lambda t, i: F.struct((-F.length(t)).alias("n"), i.alias("i"), html_escape(t).alias("t")))
    return F.aggregate(F.array_sort(indexed), html_escape(snippet), lambda acc, x: F.when(F.length(x["t"]) > 0, F.replace(acc, x["t"], F.concat(F.lit("<b>"), x["t"], F.lit("</b>")))).otherwise(acc))


def word_tokens(c: Column | str) -> Column:
    return F.array_distinct(F.regexp_extract_all(normalize_invisibles(c), F.lit(rf"[{HANGUL}]{{2,}}|[A-Za-z]{{2,}}[A-Za-z0-9\-_/]*"), F.lit(0)))


def split_sentences(c: Column | str) -> Column:
    return F.filter(F.transform(F.split(F.coalesce(col(c), F.lit("")), r"[\n.?!]+"), trimmed), lambda x: x != "")


def status_label(c: Column | str) -> Column:
    out = col(c)
    return F.coalesce(F.create_map(*[F.lit(x) for pair in rules.STATUS_LABELS.items() for x in pair])[out], out)


#: The tests below that begin with an underscore take lines whose invisibles are normalized already.
def _is_heading(line: Column) -> Column:
    bare = F.regexp_replace(trimmed(line), _BULLETS, "")
    return line.contains("#") & F.regexp_replace(bare, r"^\\+(?=#)", "").rlike(r"(?U)^[\s\x1c-\x1f]*#")


def is_heading(c: Column | str) -> Column:
    return once(normalize_invisibles(c), _is_heading)


def _is_numbered_title(line: Column) -> Column:
    return trimmed(line).rlike(rf"(?d)^\d+\.\s+[{HANGUL}A-Za-z\s]{{1,20}}$")


def is_numbered_title(c: Column | str) -> Column:
    return once(normalize_invisibles(trimmed(col(c))), lambda line: line.rlike(rf"(?d)^\d+\.\s+[{HANGUL}A-Za-z\s]{{1,20}}$"))


def _is_rule_line(line: Column) -> Column:
    return line.rlike(r"(?d)^\s{0,3}(?:-{3,}|\*{3,}|_{3,})\s*$")


def is_rule_line(c: Column | str) -> Column:
    return _is_rule_line(normalize_invisibles(c))


def _cells(line: Column) -> Column:
    return F.transform(F.split(F.regexp_replace(line, r"^\|+|\|+$", ""), r"\|"), trimmed)


def _of_row(line: Column, test: Callable[[Column], Column]) -> Column:
    """The test of a line's cells, if it is a table's row at all."""
    bare = once(F.regexp_replace(trimmed(line), rf"^\s*{_BULLETS[1:]}", ""), lambda x: F.when(x.startswith("|") & x.endswith("|"), once(_cells(x), test)).otherwise(False))
    return F.when(line.contains("|"), bare).otherwise(False)


def _is_header(cells: Column) -> Column:
    loan = F.size(F.array_except(F.array(*map(F.lit, rules.EXCLUDED_HEADERS)), cells)) == 0
    return loan | (F.size(F.filter(cells, lambda x: x.isin(rules.FINANCE_KEYS))) >= 4)


def _is_yearly(cells: Column) -> Column:
    def counted(rest: Column) -> Column:
        plain = F.filter(rest, lambda x: ~x.isin("-", "?"))
        numeric = F.size(F.filter(plain, lambda x: F.regexp_replace(x, "씅$", "").rlike(r"^-?(?:\d{1,3}(?:,\d{3})+|\d+)(?:\.\d+)?(?:%|%p|p)?$")))
        percent = F.exists(plain, lambda x: x.contains("%"))
        return (F.size(rest) >= 6) & (numeric >= 5) & (percent | (numeric >= 7))

    rest = F.transform(F.filter(F.slice(cells, 2, F.greatest(F.size(cells) - 1, F.lit(0))), lambda x: x != ""), lambda x: F.replace(normalize_invisibles(x), F.lit(" "), F.lit("")))
    return F.when(F.get(cells, F.lit(0)).rlike(r"^(?:19|20)\d{2}$"), once(rest, counted)).otherwise(False)


def is_excluded_table_header(c: Column | str) -> Column:
    """A loan table's header, or one with four finance keys."""
    return once(normalize_invisibles(c), lambda line: _of_row(line, _is_header))


def is_excluded_finance_row(c: Column | str) -> Column:
    """A row of yearly figures: a year, then six cells or more that are mostly numbers."""
    return once(normalize_invisibles(c), lambda line: _of_row(line, _is_yearly))


def _is_excluded(line: Column) -> Column:
    return _of_row(line, lambda cells: _is_header(cells) | _is_yearly(cells))
