"""Language identification by Bayesian evidence fusion.

Four kinds of evidence are multiplied for each language: the text's character trigrams under models trained on a
bounded sample of labelled texts (TRAINING rows, the first by a hash of their id), the language its markup declares,
the suffix of its address, and a prior of its host. A host's prior is its other texts' evidence, summed by a grouped
aggregation and smoothed towards its domain's, and that towards all texts'. A text also competes with "und", a model
without language, and is rejected where no language reaches ACCEPT of the evidence, which takes a text that looks like
none and nothing else to say what it is.

Null, empty and letterless texts have no text evidence and rest on the others, and are accepted as what these say;
without any they keep the prior of all texts. Unknown declared languages, suffixes and null hosts say nothing. Repeated rows get a row each, and count as often
for their host. Texts of any length are read whole. Of languages equally likely the first by name is told. Without
labelled texts every language is "und" and nothing is rejected; an empty table gives no rows. Only the columns named are
read, whatever others are called.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from veritrail.llm.common import in_small_batches, staged, table

BUCKETS = 8192
TRAINING = 4000
#: Trigrams overlap, so their evidence counts a third, and that of at most LONGEST of them.
TEMPER, LONGEST = 1 / 3, 600
UND, UND_PRIOR = "und", 0.01
#: How often a declared language, or that of an address's suffix, is the text's.
DECLARED_TRUST, SUFFIX_TRUST = 0.9, 0.8
#: Texts' worth of weight that a host borrows from its domain and a domain from all.
SMOOTH = 8.0
ACCEPT = 0.5
#: Suffixes of addresses that stand for a language.
SUFFIXES = {"de": "de", "at": "de", "fr": "fr", "es": "es", "mx": "es", "ar": "es", "uk": "en", "us": "en", "au": "en", "it": "it", "pt": "pt", "br": "pt", "nl": "nl", "pl": "pl", "ru": "ru", "jp": "ja", "kr": "ko", "cn": "zh"}
#: Labels under which a country's names are given out one level further down.
SECOND_LEVEL = "co|com|org|net|ac|gov|gob|gouv|edu|or|ne|go|nom|gen|govt|school"
NOT_TEXT = re.compile(r"<!--.*?-->|<(script|style)\b.*?</\1\s*>|<[^>]*>", re.DOTALL | re.IGNORECASE)


def plain(page: str) -> str:
    """A page's text: no comments, scripts, styles or tags, entities resolved."""
    return html.unescape(NOT_TEXT.sub(" ", page))


def trigrams(text: str | None) -> np.ndarray:
    """Buckets of the trigrams of the letters of the text, runs of anything else as one space."""
    points = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32) if text else np.zeros(0, np.uint32)
    letter = ((points >= 97) & (points <= 122)) | (points >= 0xC0)
    points = np.where(letter, points, 32).astype(np.uint64)
    points = points[letter | np.concatenate(([True], letter[:-1]))[: len(points)]] if len(points) else points
    if not letter.any():
        return np.zeros(0, np.int64)
    mixed = (points[:-2] * np.uint64(0x9E3779B1) + points[1:-1] * np.uint64(0x85EBCA77) + points[2:] * np.uint64(0xC2B2AE3D)) & np.uint64(0xFFFFFFFF)
    return ((mixed * np.uint64(0x27D4EB2F) & np.uint64(0xFFFFFFFF)) >> np.uint64(19)).astype(np.int64)


def models(labelled: DataFrame, rows: int = TRAINING) -> tuple[list[str], np.ndarray]:
    """labelled: id, text, lang. Languages and their log trigram probabilities, "und" last, from the texts of the first ids by a hash; rows without an id teach nothing."""
    usable = labelled.where("id is not null and text is not null and lang is not null")
    first = usable.select("id").orderBy(F.xxhash64("id"), "id").limit(rows)  # ids alone go to one task, not texts
    few = usable.join(F.broadcast(first), "id", "left_semi").select("text", "lang")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for lang, part in batch.groupby("lang"):
                n = np.bincount(np.concatenate([trigrams(x) for x in part["text"]]), minlength=BUCKETS)
                at = n.nonzero()[0]
                yield pd.DataFrame({"lang": lang, "bucket": at, "n": n[at]})

    got = few.mapInPandas(run, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()  # at most rows x BUCKETS, of the sampled languages
    langs = sorted(got["lang"].unique()) if len(got) else []
    table_ = np.full((len(langs) + 1, BUCKETS), 0.5)
    for k, lang in enumerate(langs):
        own = got[got["lang"] == lang]
        table_[k, own["bucket"].to_numpy(int)] += own["n"].to_numpy(float)
    return [*langs, UND], np.log(table_ / table_.sum(axis=1, keepdims=True))


def identify(docs: DataFrame, labelled: DataFrame, markup: bool = False) -> DataFrame:
    """docs: id, text, declared, suffix, host, domain (all but id and text may be null); markup: texts are pages. id, lang, probability, text_lang, accepted for each row."""
    langs, logs = models(labelled)
    at = {x: k for k, x in enumerate(langs)}
    n = len(langs)
    start = np.log(np.array([(1 - UND_PRIOR) / max(1, n - 1)] * (n - 1) + [UND_PRIOR if n > 1 else 1.0]))
    columns = [f"l{k}" for k in range(n)]
    sums = [f"s{k}" for k in range(n)]

    def spoken(claimed: str | None, trust: float) -> np.ndarray:
        k = at.get((claimed or "").lower().replace("_", "-").split("-")[0])
        return np.zeros(n) if k is None or n < 3 else np.log(np.where(np.arange(n) == k, trust, (1 - trust) / (n - 1)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            heard, text_lang = np.zeros((len(batch), n)), []
            for i, (text, declared, suffix) in enumerate(zip(batch["text"].tolist(), batch["declared"].tolist(), batch["suffix"].tolist(), strict=True)):
                own = trigrams(plain(text) if markup and text else text)
                told = logs[:, own].sum(axis=1) / max(1, len(own)) * min(len(own), LONGEST) * TEMPER
                text_lang.append(langs[int(np.argmax(told + start))] if len(own) else None)
                heard[i] = told + spoken(declared, DECLARED_TRUST) + spoken(SUFFIXES.get((suffix or "").lower()), SUFFIX_TRUST)
            out = pd.DataFrame(heard - heard.max(axis=1, keepdims=True), columns=columns)
            post = np.exp(out.to_numpy() + start)
            post /= post.sum(axis=1, keepdims=True)
            yield pd.concat([batch[["id", "host", "domain"]].reset_index(drop=True), pd.Series(text_lang, name="text_lang", dtype=object), out, pd.DataFrame(post, columns=sums)], axis=1)

    shape = "id long, host string, domain string, text_lang string, " + ", ".join(f"{x} double" for x in columns + sums)
    told = staged(in_small_batches(docs).select(F.col("id").cast("long").alias("id"), F.col("text").cast("string").alias("text"), F.col("declared").cast("string").alias("declared"), F.col("suffix").cast("string").alias("suffix"), F.coalesce("host", F.lit("")).alias("host"), F.coalesce("domain", F.lit("")).alias("domain")).mapInPandas(run, shape), "evidence")
    # whole millionths, so that the sums don't hang on the order in which rows come
    hosts = staged(told.groupBy("domain", "host").agg(*[F.sum(F.round(F.col(x) * 1e6).cast("long")).alias(f"h{x}") for x in sums]), "hosts")
    domains = hosts.groupBy("domain").agg(*[(F.sum(f"h{x}") / 1e6).alias(f"d{x}") for x in sums])
    every = [(x or 0) / 1e6 for x in hosts.agg(*[F.sum(f"h{x}") for x in sums]).first()]
    total = math.fsum(every) + n
    overall = [(x + 1) / total for x in every]

    def share(own: Column, whole: Column, above: Column | float) -> Column:
        return (F.greatest(own, F.lit(0.0)) + SMOOTH * above) / (F.greatest(whole, F.lit(0.0)) + SMOOTH)

    def added(prefix: str) -> Column:
        return sum((F.col(f"{prefix}{x}") for x in sums[1:]), F.col(f"{prefix}{sums[0]}"))

    prior = hosts.select("domain", "host", *[(F.col(f"h{x}") / 1e6).alias(f"h{x}") for x in sums]).join(domains, "domain")
    fused = told.join(prior, ["domain", "host"])  # a host of very many rows is one row on the other side: a skewed join, which Spark splits
    named = F.col("host") != ""
    logs_of = [
        F.col(columns[k]) + F.log(F.when(named, share(F.col(f"h{s}") - F.col(s), added("h") - 1, share(F.col(f"d{s}") - F.col(s), added("d") - 1, overall[k]))).otherwise(overall[k]))
        for k, s in enumerate(sums)
    ]
    scored = fused.select("id", "text_lang", F.array(*logs_of).alias("v")).withColumn("top", F.array_max("v"))
    mass = F.aggregate("v", F.lit(0.0), lambda acc, x: acc + F.exp(x - F.col("top")))
    best = scored.select("id", "text_lang", F.element_at(F.array(*map(F.lit, langs)), F.array_position("v", F.col("top")).cast("int")).alias("lang"), (1 / mass).alias("probability"))
    return best.select("id", "lang", "probability", "text_lang", ((F.col("lang") != UND) & ((F.col("probability") >= ACCEPT) | F.col("text_lang").isNull()) | F.lit(n < 2)).alias("accepted"))


def of_pages(pages: DataFrame) -> DataFrame:
    """What identify() asks of pages: page_id, url, html."""
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@]*@)?([^/:?#]+)", 1))
    declared = F.regexp_extract(F.coalesce("html", F.lit("")), r"""(?i)<html\b[^>]*?\blang\s*=\s*["']?([a-zA-Z-]+)""", 1)
    return pages.select(F.col("page_id").alias("id"), F.col("html").alias("text"), declared.alias("declared"), F.regexp_extract(host, r"([^.]+)$", 1).alias("suffix"), host.alias("host"), F.regexp_extract(host, rf"([^.]+\.(?:{SECOND_LEVEL})\.[a-z][a-z]|[^.]+\.[^.]+)$", 1).alias("domain"))


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    labelled = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text", "lang")
    return identify(of_pages(table(spark, sf_dir, "pages")), labelled, markup=True).withColumnRenamed("id", "page_id")
