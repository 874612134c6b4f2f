"""Order MinHash fingerprints, sensitive to edits and to the order of what is kept.

A text's k-mers of code points are numbered by occurrence, so that repeats differ, and hashed. The hash deals them
into buckets; in each bucket the TUPLE smallest are taken (a bucket with fewer goes on into the next), put in the order
in which they stand in the text, and hashed together to 16 bits. Two texts are alike by the share of equal buckets.

Every document is compared with its edited self and with its neighbour by descending doc_id. Rows are dealt out by
ranges of doc_id; the two rows that face each other across a border of ranges are matched afterwards.

Null and empty texts have the zero fingerprint and are like each other alone. Repeated rows stand next to each other
(equal doc_ids by a hash of their text). A single row is its own neighbour. Rows without a doc_id come last. Texts of
any length are hashed whole and alike; k-mers whose kept hash bits are equal stand in text order. An empty table gives
no rows. Only doc_id and text are read, whatever other columns are called.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from veritrail.llm.common import in_order, in_small_batches, table
from veritrail.llm.hashing import mixed

KMER, BUCKETS, TUPLE = 8, 64, 2
PLACE_BITS = 20
RESULT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
_NAMES = [x.split()[0] for x in RESULT.split(", ")]


def _sorted_places(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes without their PLACE_BITS lowest bits, whatever the text's length, in order and where they stood; equal ones in text order."""
    n = len(hashes)
    low = np.uint64((1 << PLACE_BITS) - 1)
    hashes = hashes & ~low
    if n >> PLACE_BITS:
        at = np.argsort(hashes, kind="stable")
        return hashes[at], at
    both = np.sort(hashes | np.arange(n, dtype=np.uint64))
    return both & ~low, (both & low).astype(np.int64)


def order_minhash(text: str) -> np.ndarray:
    """BUCKETS 16-bit signatures of the whole text."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    if not len(points):
        return np.zeros(BUCKETS, np.uint16)
    k = min(KMER, len(points))
    n = len(points) - k + 1
    grams = np.zeros(n, np.uint64)
    for j in range(k):
        grams = grams * np.uint64(0x9E3779B97F4A7C15) + points[j : j + n]
    grams, places = _sorted_places(mixed(grams + np.uint64(k)))
    new = np.flatnonzero(np.concatenate(([True], grams[1:] != grams[:-1])))
    occurrence = np.arange(n) - np.repeat(new, np.diff(np.append(new, n)))
    numbered, at = _sorted_places(mixed(grams + occurrence.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)))
    starts = np.searchsorted(numbered, np.arange(BUCKETS, dtype=np.uint64) << np.uint64(64 - BUCKETS.bit_length() + 1))
    taken = (starts[:, None] + np.arange(TUPLE)) % n
    inner = np.argsort(places[at[taken]], axis=1, kind="stable")
    tuples = np.take_along_axis(numbered[taken], inner, axis=1)
    out = np.zeros(BUCKETS, np.uint64)
    for j in range(TUPLE):
        out = mixed(out * np.uint64(31) + tuples[:, j] + np.uint64(1))
    return (out >> np.uint64(48)).astype(np.uint16)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    return float((a == b).mean())


def written(signature: np.ndarray) -> str:
    return signature.astype(">u2").tobytes().hex()


def edited(text: str, following: str) -> str:
    """The last third's code points give way to the first as many (or all) of the following text."""
    n = len(text) // 3
    return text[: len(text) - n] + following[:n]


def _frame(rows: list[tuple]) -> pd.DataFrame:
    """RESULT's columns, strings as plain objects."""
    kinds = {"doc_id": "Int64", "n_chars": "Int64", "near_edited": "float64", "near_next": "float64"}
    return pd.DataFrame(rows, columns=_NAMES, dtype=object).astype(kinds)


def _row(doc: int | None, text: str, own: np.ndarray, following: str, after: np.ndarray) -> tuple:
    changed = edited(text, following)
    other = order_minhash(changed) if changed != text else own
    return doc, len(text), hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest(), written(own), written(other), likeness(own, other), likeness(own, after)


def fingerprints(docs: DataFrame) -> DataFrame:
    """docs: doc_id, text. doc_id, n_chars, fingerprint for each row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = [x if isinstance(x, str) else "" for x in batch["text"].tolist()]
            yield pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64"), "n_chars": [len(x) for x in texts], "fingerprint": [written(order_minhash(x)) for x in texts]})

    return in_small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInPandas(run, "doc_id long, n_chars long, fingerprint string")


def edits_and_neighbours(docs: DataFrame) -> DataFrame:
    """docs: doc_id, text. RESULT for each row."""
    spark = docs.sparkSession

    def step(batches: Iterator[pd.DataFrame], part: int) -> Iterator[pd.DataFrame]:
        held = first = None
        for batch in batches:
            out = []
            for doc, text in zip(batch["doc_id"].tolist(), batch["text"].tolist(), strict=True):
                text = text if isinstance(text, str) else ""
                now = (None if pd.isna(doc) else int(doc), text, order_minhash(text))
                if held:
                    out.append(_row(*held, text, now[2]))
                first, held = first or now, now
            yield _frame(out).assign(part=part, edge=None, text=None)
        if held:
            edges = _frame([(x[0], *[None] * (len(_NAMES) - 1)) for x in (first, held)])
            yield edges.assign(part=part, edge=pd.Series(["first", "last"], dtype=object), text=pd.Series([first[1], held[1]], dtype=object))

    plain = in_small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    order = [F.col("doc_id").desc_nulls_last(), F.xxhash64("text")]
    found = in_order(plain, order, step, f"{RESULT}, part int, edge string, text string", "fingerprints")
    parts = sorted(x["part"] for x in found.where("edge = 'first'").select("part").collect())  # one for each task
    facing = spark.createDataFrame([(a, b) for a, b in zip(parts, [*parts[1:], *parts[:1]], strict=True)], "part int, following int")
    last = found.where("edge = 'last'").select("part", "doc_id", "text").join(facing, "part")
    pairs = last.join(found.where("edge = 'first'").select(F.col("part").alias("following"), F.col("text").alias("next")), "following").select("doc_id", "text", "next")

    def across(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [_row(None if pd.isna(d) else int(d), a, order_minhash(a), b, order_minhash(b)) for d, a, b in zip(batch["doc_id"].tolist(), batch["text"].tolist(), batch["next"].tolist(), strict=True)]
            yield _frame(rows)

    return found.where("edge is null").select(_NAMES).unionByName(pairs.mapInPandas(across, RESULT))


def op7_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edits_and_neighbours(table(spark, sf_dir, "documents"))
