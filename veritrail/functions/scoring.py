"""Features of a claim and its evidence, their score and status, as Column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

from veritrail import rules
from veritrail.functions.numbers import NUMBER_UNITS, extract_numbers, extract_units, extract_years, match_numbers_in_text, metric_spellings, number_variants
from veritrail.functions.text import col, norm_for_match, normalize_invisibles, once, split_sentences


def _held(words: list[str], text: Column) -> Column:
    return F.filter(F.array(*map(F.lit, words)), lambda w: F.contains(text, w))


def unit_match(claim: Column | str, evidence: Column | str) -> Column:
    share = lambda units: F.when(F.size(units) == 0, 0.5).otherwise(once(normalize_invisibles(evidence), lambda text: F.size(F.filter(units, lambda u: F.contains(text, u)))) / F.greatest(F.size(units), F.lit(1)))
    return once(extract_units(claim), share)


def _both(claim: Column | str, evidence: Column | str, f: Callable[[Column, Column], Column]) -> Column:
    return once(F.struct(normalize_invisibles(claim).alias("c"), normalize_invisibles(evidence).alias("e")), lambda x: f(x["c"], x["e"]))


def _conflict(c: Column, e: Column) -> Column:
    pairs = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for x, y in rules.OPPOSITES for a, b in ((x, y), (y, x))])
    return F.exists(pairs, lambda p: F.contains(c, p["a"]) & F.contains(e, p["b"]))


def direction_conflict(claim: Column | str, evidence: Column | str) -> Column:
    return _both(claim, evidence, _conflict)


def direction_score(claim: Column | str, evidence: Column | str) -> Column:
    def rated(c: Column, e: Column) -> Column:
        share = lambda own: F.size(F.filter(own, lambda w: F.contains(e, w))) / F.greatest(F.size(own), F.lit(1))
        return once(_held(rules.UP_WORDS + rules.DOWN_WORDS, c), lambda own: F.when(F.size(own) == 0, 0.5).when(_conflict(c, e), 0.0).otherwise(0.5 + 0.5 * share(own)))

    return _both(claim, evidence, rated)


def _rung(h: Column) -> Column:
    return F.when(h["m"] & h["n"], F.when(h["y"] & h["u"], 1.0).when(h["y"] | h["u"], 0.85).otherwise(0.65)).when(h["m"] & (h["y"] | h["u"]), 0.45).when(h["m"] | h["n"], 0.20).otherwise(0.0)


def _facts(asked: Column, text: Column) -> Column:
    """What of the asked facts a text has: m, y, u; e: asked numbers that are extracted from it, v: those of which it has a spelling."""
    some = lambda wanted, test: (F.size(wanted) == 0) | test
    plain = once(normalize_invisibles(text), lambda t: F.exists(asked["u"], lambda u: F.contains(t, u)))
    low = once(F.lower(text), lambda t: F.exists(asked["m"], lambda x: F.contains(t, x)))
    spelled = once(norm_for_match(text), lambda t: F.filter(asked["n"], lambda n: F.exists(n["v"], lambda v: F.contains(t, v))))
    return F.struct(low.alias("m"), some(asked["y"], F.arrays_overlap(extract_years(text), asked["y"])).alias("y"), some(asked["u"], plain).alias("u"), F.array_intersect(extract_numbers(text), asked["n"]["t"]).alias("e"), F.transform(spelled, lambda n: n["t"]).alias("v"))


def fact_block(claim: Column | str, evidence: Column | str, window: int = 3, numbers: Column | str | None = None, spellings: Column | str | None = None) -> Column:
    """How much of a claim's metric, number, year and unit stands within a few sentences of the evidence, at best.

    Facts are looked for once in each sentence, and a window has what its sentences have: no metric, spelling, unit or year goes over the space between two. A number may take its unit from the next sentence; where one could, windows are searched as whole texts. numbers, spellings: extract_numbers() of the claim and number_variants() of each, where a table has them already.
    """
    if numbers is None or spellings is None:
        own = F.transform(match_numbers_in_text(extract_numbers(claim), norm_for_match(claim)), lambda n: F.struct(n.alias("t"), number_variants(n).alias("v")))
    else:
        each = F.transform(col(numbers), lambda n, i: F.struct(n.alias("t"), F.get(col(spellings), i).alias("v")))
        own = once(norm_for_match(claim), lambda c: F.filter(each, lambda n: F.exists(n["v"], lambda v: F.contains(c, v))))
    told = F.struct(metric_spellings(claim).alias("m"), own.alias("n"), extract_years(claim).alias("y"), extract_units(claim).alias("u"))
    starts = lambda s: F.when(F.size(s) == 0, F.array().cast("array<int>")).otherwise(F.sequence(F.lit(1), F.greatest(F.size(s), F.lit(1))))
    joined = lambda f: F.struct(F.exists(f, lambda x: x["m"]).alias("m"), F.exists(f, lambda x: x["y"]).alias("y"), F.exists(f, lambda x: x["u"]).alias("u"), F.arrays_overlap(F.flatten(f["e"]), F.flatten(f["v"])).alias("n"))

    def best(asked: Column) -> Column:
        by_sentence = lambda s: once(F.transform(s, lambda x: _facts(asked, x)), lambda f: F.array_max(F.transform(starts(s), lambda i: once(joined(F.slice(f, i, F.lit(window))), _rung))))
        by_text = lambda s: F.array_max(F.transform(starts(s), lambda i: once(joined(F.array(_facts(asked, F.array_join(F.slice(s, i, F.lit(window)), " ")))), _rung)))
        units, other = "|".join((*NUMBER_UNITS, "％")), "[^0-9A-Za-z가-힣%％]*"
        meets = lambda s: F.exists(F.zip_with(s, F.slice(s, F.lit(2), F.greatest(F.size(s), F.lit(1))), lambda a, b: a.rlike(f"[0-9]{other}$") & b.rlike(f"^{other}(?:{units})")), lambda x: F.coalesce(x, F.lit(False)))
        top = once(split_sentences(evidence), lambda s: F.when(meets(s), by_text(s)).otherwise(by_sentence(s)))
        return F.when((F.size(asked["m"]) == 0) | (F.size(asked["n"]) == 0), 0.0).otherwise(F.coalesce(top, F.lit(0.0)))

    return once(told, best)


#: Characters between an indicator and its number in a claim, and around an indicator in evidence.
PAIR, AROUND = 80, 40


def _occurrences(text: Column, word: Column) -> Column:
    """Where a word begins in a text, from 0, each after the end of the one before."""
    pieces = F.split(text, F.concat(F.lit("\\Q"), word, F.lit("\\E")), -1)
    none = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("found"))
    step = lambda acc, x: F.struct((acc["at"] + F.length(x) + F.length(word)).alias("at"), F.concat(acc["found"], F.array(acc["at"] + F.length(x))).alias("found"))
    return once(pieces, lambda p: F.aggregate(F.slice(p, F.lit(1), F.size(p) - 1), none, step, lambda acc: acc["found"]))


def proximity(claim: Column | str, evidence: Column | str, numbers: Column | str, spellings: Column | str) -> Column:
    """Share of a claim's (indicator, nearest number) pairs of which the evidence has a spelling of the number about the indicator. spellings: number_variants() of each of the numbers, as a column of a table.

    Places of the indicators that the claim has, and of its numbers, make the pairs; only spellings that the evidence has at all are looked for in the windows around an indicator there.
    """
    bare = lambda x: F.replace(x, F.lit(" "), F.lit(""))

    def paired(x: Column) -> Column:
        placed = once(bare(x["c"]), lambda c: F.filter(F.transform(x["n"], lambda n, k: F.struct(F.position(bare(n), c).alias("p"), k.alias("k"))), lambda a: a["p"] > 0))
        nearest = lambda w, at: F.array_min(F.transform(at, lambda a: F.struct(F.abs(a["p"] - F.position(w, x["c"])).alias("far"), a["k"].alias("k"))))
        own = F.filter(F.array(*map(F.lit, rules.INDICATORS)), lambda w: F.contains(x["c"], w))
        return F.filter(once(placed, lambda at: F.transform(own, lambda w: F.struct(w.alias("w"), nearest(w, at).alias("at")))), lambda p: p["at"]["far"] <= PAIR)

    def held(x: Column, p: Column) -> Column:
        spelled = F.filter(F.get(x["s"], p["at"]["k"]), lambda v: (v != "") & F.contains(x["e"], v))
        first = lambda at: F.greatest(at - AROUND, F.lit(0))
        around = lambda at: F.substring(x["e"], first(at) + 1, at + F.length(p["w"]) + AROUND - first(at))
        about = lambda vs: F.exists(_occurrences(x["e"], p["w"]), lambda at: once(around(at), lambda text: F.exists(vs, lambda v: F.contains(text, v))))
        return F.contains(x["e"], p["w"]) & once(spelled, lambda vs: F.when(F.size(vs) > 0, about(vs)).otherwise(False))

    share = lambda x: once(paired(x), lambda pairs: F.when(F.size(pairs) == 0, 0.5).otherwise(F.size(F.filter(pairs, lambda p: held(x, p))) / F.greatest(F.size(pairs), F.lit(1))))
    all_ = F.struct(normalize_invisibles(claim).alias("c"), F.coalesce(normalize_invisibles(evidence), F.lit("")).alias("e"), col(numbers).alias("n"), col(spellings).alias("s"))
    return once(all_, lambda x: F.when(x["e"] == "", F.when(F.size(x["n"]) > 0, 0.0).otherwise(0.5)).otherwise(share(x)))


def final_score(sim: Column, coverage: Column, block: Column, near: Column, big: Column, unit: Column, direction: Column, conflict: Column, has_numbers: Column) -> Column:
    parts = (sim, coverage, block, near, big, unit, direction)
    total = F.when(has_numbers, sum((w * p for w, p in zip(rules.NUMBER_WEIGHTS, parts, strict=True)), F.lit(0.0))).otherwise(sum((w * p for w, p in zip(rules.TEXT_WEIGHTS, parts, strict=True)), F.lit(0.0)))
    return F.least(F.greatest(total - F.when(conflict, 0.15).otherwise(0.0), F.lit(0.0)), F.lit(1.0))


def decide_status(score: Column, sim: Column, coverage: Column, big: Column, exact: Column, has_numbers: Column, conflict: Column, block: Column, metric: Column, number_supported: float = 0.30, number_partial: float = 0.22, text_supported: float = 0.30, text_partial: float = 0.22) -> Column:
    enough = F.when(has_numbers, score >= number_partial).otherwise(score >= text_partial)
    numeric = (
        F.when((score >= number_supported) & ((block >= 0.65) | (metric & (big > 0) & (coverage >= 0.45)) | (exact >= 1)), "SUPPORTED")
        .when((score >= number_partial) & ((block >= 0.35) | (big > 0) | (coverage >= 0.30) | (sim >= 0.20)), "PARTIAL")
        .when((block >= 0.55) & ((coverage >= 0.35) | (sim >= 0.25)), "PARTIAL")
        .otherwise("UNSUPPORTED")
    )
    textual = F.when((score >= text_supported) & (coverage >= 0.45), "SUPPORTED").when((score >= text_partial) & (coverage >= 0.30) | (coverage >= 0.55) & (sim >= 0.18), "PARTIAL").otherwise("UNSUPPORTED")
    return F.when(conflict, F.when(enough, "PARTIAL").otherwise("UNSUPPORTED")).when(has_numbers, numeric).otherwise(textual)


def combine_status(a: Column | str, b: Column | str) -> Column:
    either = lambda s: (col(a) == s) | (col(b) == s)
    return F.when(either("SUPPORTED"), "SUPPORTED").when(either("PARTIAL"), "PARTIAL").otherwise("UNSUPPORTED")


def big_number_recall(numbers: Column, big: Column, matched: Column) -> Column:
    """Share of the big numbers matched, of all if none is big; a half without numbers. matched: numbers found in the evidence."""
    asked = F.when(F.size(big) > 0, big).otherwise(numbers)
    return F.when(F.size(numbers) == 0, 0.5).otherwise(F.size(F.array_intersect(asked, matched)) / F.greatest(F.size(asked), F.lit(1)))
