"""Numbers, units and metrics in text, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from veritrail import rules
from veritrail.functions.text import col, normalize_invisibles, once, trimmed, unique_keep_order

#: Units of numbers, a number with its unit as it is found in text, and as it is taken apart.
NUMBER_UNITS = ("%", "배", "개월", "년", "원", "백만원", "억원", "%p", "p")
NUMBER = rf"(?:(?:\d{{1,3}}(?:,\d{{3}})+)|\d+)(?:\.\d+)?(?:\s?(?:{'|'.join(NUMBER_UNITS)}))?"
TOKEN = r"^([0-9][0-9,]*(?:\.[0-9]+)?)(.*)$"


def extract_numbers(c: Column | str) -> Column:
    return F.array_distinct(F.transform(F.regexp_extract_all(normalize_invisibles(c), F.lit(NUMBER), F.lit(0)), lambda x: F.regexp_replace(x, r"(?U)\s+", "")))


def with_commas(digits: Column) -> Column:
    return F.regexp_replace(digits, r"(?<=\d)(?=(\d{3})+$)", ",")


def _of_token(token: Column) -> Column:
    parts = F.struct(F.regexp_extract(token, TOKEN, 1).alias("number"), F.regexp_extract(token, TOKEN, 2).alias("unit"))
    factor = F.create_map(*[x for k, v in rules.WON.items() for x in (F.lit(k), F.lit(float(v)))])

    def spelled(x: Column) -> Column:
        plain, unit = F.replace(x["number"], F.lit(","), F.lit("")), x["unit"]
        whole, rest = F.regexp_extract(plain, r"^(\d+)", 1), F.regexp_extract(plain, r"(\.\d+)$", 1)
        base = F.array(F.concat(x["number"], unit), F.concat(plain, unit), F.concat(with_commas(whole), rest, unit))
        signs = F.flatten(F.transform(base, lambda b: F.array(b, F.when(b.contains("%"), F.replace(b, F.lit("%"), F.lit("％"))), F.when(b.contains("％"), F.replace(b, F.lit("％"), F.lit("%"))))))
        into = lambda won, k, v: F.when(unit == k, F.array().cast("array<string>")).otherwise(once(won / F.lit(float(v)), lambda x: in_unit(x, F.lit(k))))
        money = lambda won: F.concat(*[into(won, k, v) for k, v in rules.WON.items()])
        return F.when(unit.isin(*rules.WON), F.concat(signs, once(plain.try_cast("double") * F.try_element_at(factor, unit), money))).otherwise(signs)

    def in_unit(v: Column, unit: Column) -> Column:
        digits = F.floor(v).cast("decimal(38,0)").cast("string")
        return F.when(v >= 1, F.array(F.concat(digits, unit), F.concat(with_commas(digits), unit))).otherwise(F.array(F.concat(F.format_number(v, 3), unit)))

    return F.when(token.rlike(TOKEN), once(parts, spelled)).otherwise(F.array(token))


def number_variants(c: Column | str) -> Column:
    """Spellings of one number: with and without commas, either percent sign, and a money amount in each other unit."""
    return unique_keep_order(once(trimmed(normalize_invisibles(c)), _of_token))


def extract_years(c: Column | str) -> Column:
    return F.transform(F.regexp_extract_all(F.coalesce(col(c), F.lit("")), F.lit(r"(?U)(?:19|20)\d{2}\s*년?"), F.lit(0)), lambda x: F.translate(x, " 년", ""))


def extract_units(c: Column | str) -> Column:
    return once(normalize_invisibles(c), lambda text: F.filter(F.array(*map(F.lit, rules.UNITS)), lambda u: F.contains(text, u)))


def metric_spellings(c: Column | str) -> Column:
    """All spellings, in lower case, of the metrics that a text names."""
    known = F.array(*[F.array(*[F.lit(x.lower()) for x in syns]) for syns in rules.METRICS.values()])
    return once(F.lower(F.coalesce(col(c), F.lit(""))), lambda text: F.flatten(F.filter(known, lambda syns: F.exists(syns, lambda x: F.contains(text, x)))))


def extract_metrics(c: Column | str) -> Column:
    known = F.array(*[F.struct(F.lit(canon).alias("canon"), F.array(*[F.lit(x.lower()) for x in syns]).alias("syns")) for canon, syns in rules.METRICS.items()])
    return once(F.lower(F.coalesce(col(c), F.lit(""))), lambda text: F.transform(F.filter(known, lambda m: F.exists(m["syns"], lambda x: F.contains(text, x))), lambda m: m["canon"]))


def has_metric(c: Column | str) -> Column:
    return F.size(extract_metrics(c)) > 0


def digits_only(c: Column) -> Column:
    return F.regexp_replace(c, r"\D", "")


def big_numbers(c: Column | str) -> Column:
    return unique_keep_order(F.filter(col(c), lambda x: F.length(digits_only(x)) >= 3))


def match_numbers_in_text(numbers: Column | str, text: Column | str) -> Column:
    """The numbers of which some spelling occurs in the text."""
    return unique_keep_order(F.filter(col(numbers), lambda n: F.exists(number_variants(n), lambda v: F.contains(col(text), v))))


def claim_amount(c: Column | str) -> Column:
    """Millions of won; null without a money unit."""
    token = trimmed(normalize_invisibles(c))
    number = F.replace(F.regexp_extract(token, r"^[-+]?([0-9][0-9,]*(?:\.[0-9]+)?)", 1), F.lit(","), F.lit("")).try_cast("double")
    unit = trimmed(F.regexp_extract(token, r"^[-+]?[0-9][0-9,]*(?:\.[0-9]+)?(.*)$", 1))
    return F.when(token.startswith("-"), -number).otherwise(number) * F.try_element_at(F.create_map(*[x for k, v in rules.WON.items() for x in (F.lit(k), F.lit(v / 1e6))]), unit)
