"""Helpers that several operators share: reading, word patterns, tables that cut lineage, neighbours in a global order."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from veritrail.sources.staging import staged  # noqa: F401

#: Words of letters and digits, and words between white space, on lower-cased UTF-8 bytes: bytes over 0x7F all belong to words, as their code points do.
ALNUM_WORDS = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SPACE_WORDS = re.compile(rb"[^\x20\x09-\x0D]+")
ASCII_UPPER, ASCII_LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def low_bytes(text: str | None) -> bytes:
    """UTF-8 bytes with only A-Z lower-cased; null is empty."""
    return text.encode("utf-8", "surrogatepass").lower() if text else b""


#: Texts in an Arrow batch; they may be long, and both sides hold a whole batch in memory.
BATCH = 1000


def in_small_batches(docs: DataFrame) -> DataFrame:
    """The same rows; from now on the session sends BATCH of them to Python at a time at most. It stays so for later queries of the session, whose results don't hang on it."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    conf = docs.sparkSession.conf
    if not 0 < int(conf.get(key)) <= BATCH:
        conf.set(key, BATCH)
    return docs


def at_once(texts: list[str], most: int) -> Iterator[tuple[int, int]]:
    """Stretches of texts with so many characters at most, or one text of more."""
    first = size = 0
    for at, text in enumerate(texts):
        if size and size + len(text) > most:
            yield first, at
            first, size = at, 0
        size += len(text)
    if first < len(texts):
        yield first, len(texts)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def runs(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    """Groups of equal keys from batches that are sorted by them; a group may span batches."""
    held: list[pd.DataFrame] = []
    for batch in batches:
        if batch.empty:
            continue
        change = np.ones(len(batch), bool)
        change[1:] = np.any([batch[k].to_numpy()[1:] != batch[k].to_numpy()[:-1] for k in keys], axis=0)
        change[0] = not held or any(held[-1][k].iloc[-1] != batch[k].iloc[0] for k in keys)
        starts = [*change.nonzero()[0], len(batch)]
        if starts[0]:
            held.append(batch.iloc[: starts[0]])
        for a, b in zip(starts, starts[1:], strict=False):
            if held:
                yield pd.concat(held) if len(held) > 1 else held[0]
            held = [batch.iloc[a:b]]
    if held:
        yield pd.concat(held) if len(held) > 1 else held[0]


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the smallest node reachable, for every node of the links. Labels fall to the smallest neighbour's and then jump to their label's label, so long chains take a logarithmic number of rounds."""
    links = links.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b")
    edges = staged(links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = staged(edges.groupBy(F.col("a").alias("node")).agg(F.least(F.min("a"), F.min("b")).alias("component")), "labels")
    while True:
        near = edges.join(labels, edges.b == labels.node).groupBy("a").agg(F.min("component").alias("near"))
        lower = labels.join(near, labels.node == near.a).select("node", F.col("component").alias("was"), F.least("component", "near").alias("component"))
        jump = labels.select(F.col("node").alias("at"), F.col("component").alias("next"))
        after = staged(lower.join(jump, F.col("component") == F.col("at")).select("node", "was", F.least("component", "next").alias("component")), "labels")
        if after.where("was <> component").isEmpty():
            return after.select("node", "component")
        labels = after.select("node", "component")


def in_order(df: DataFrame, order: list, step: Callable[[Iterator[pd.DataFrame], int], Iterator[pd.DataFrame]], schema: str, what: str) -> DataFrame:
    """Range-partitions by the order, sorts within, and stages what step(batches, partition) yields. Neighbours across two partitions are joined by the caller from edge rows, at most two a partition."""
    from pyspark import TaskContext

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        return step(batches, TaskContext.get().partitionId())

    ranged = df.repartitionByRange(partitions(df.sparkSession), *order).sortWithinPartitions(*order)
    return staged(ranged.mapInPandas(run, schema), what)


#: doc_ids that are sent to all executors at most; more are joined by a shuffle.
MAX_SENT = 500_000


def without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """The rows of docs whose doc_id is not in gone; rows without a doc_id stay."""
    gone = sent_if_small(staged(gone.select("doc_id").where("doc_id is not null").distinct(), "gone"))
    return docs.join(gone, "doc_id", "left_anti").select(docs.columns)


def sent_if_small(ids: DataFrame) -> DataFrame:
    """ids (one column of numbers, written already) to be sent to all executors if there are MAX_SENT at most."""
    return F.broadcast(ids) if ids.count() <= MAX_SENT else ids
