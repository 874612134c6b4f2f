"""Toxicity by compression distance.

Two zstandard dictionaries are trained on a bounded sample of labelled rows: one on ordinary texts, one on the
stretches of toxic texts that mark them out (words far more frequent among toxic texts than among ordinary ones).
A text is cut into windows, all of it, and each window is compressed with the ordinary dictionary and with the
toxic one set before it. A window that the toxic dictionary makes shorter holds what toxic texts share. The texts'
savings (largest, mean, how many windows reach a level) go through a logistic scale fitted on labelled rows that
no dictionary has seen; its threshold is set where it parts those rows best and stands at 0.5.

SAMPLE rows of a class, half for the dictionaries and half for the scale, the first by a hash of their doc_id, bound
the training, and so do SAMPLE_CHARS characters of a class: where its rows have more, the longest are left out, but of
the FEWEST shortest what doesn't fit is cut to a FEWEST-th of that, so that no class is emptied. Every row is scored. Rows with a null label, and of doc_ids
held out, teach nothing; a doc_id labelled twice is toxic if it is once. Null and empty texts are one empty window.
Without toxic or ordinary labels every score is 0. Repeated rows get a row each; an empty table gives none. Texts of any
length are scored whole. Rows of equal hash are taken by doc_id, texts of equal length by that hash. Pieces too few for
the dictionary builder are the dictionary themselves. Other columns, whatever they are called, are not read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from veritrail.llm.common import ALNUM_WORDS, in_small_batches, low_bytes, table

SAMPLE, SAMPLE_CHARS, FEWEST = 3000, 20_000_000, 8
FOLDS = 5
WINDOW = 96
ORDINARY_BYTES, TOXIC_BYTES = 65536, 16384
#: A marking word's least documents, its least standard scores, its least ratio of rates.
LEAST, SCORE, RATIO = 0.007, 3.0, 8.0
LEVELS = (1, 2, 3, 4, 6)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(FOLDS)) == 0, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame, each: int = SAMPLE) -> tuple[list[tuple[bytes, int]], float]:
    """At most each texts of a class, lower-cased and distinct, in the order of a hash of their doc_id; ordinary rows to a toxic one among all labels."""
    known = labels.where("toxic is not null and doc_id is not null").where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    order = F.xxhash64("doc_id")
    chosen = [known.where(F.col("toxic") == t).orderBy(order, "doc_id").limit(each) for t in (0, 1)]
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen[0].union(chosen[1])), "doc_id")  # 2 * each rows at most
    shortest = Window.partitionBy("toxic").orderBy(F.length("text"), order, "doc_id", "text")
    fits = F.when(F.col("upto") <= SAMPLE_CHARS, F.col("text")).when(F.col("rank") <= FEWEST, F.substring("text", 1, SAMPLE_CHARS // FEWEST))
    ranked = texts.where("text is not null").withColumn("upto", F.sum(F.length("text")).over(shortest)).withColumn("rank", F.row_number().over(shortest))
    rows = ranked.withColumn("text", fits).where("text is not null").select("doc_id", "text", "toxic").collect()
    of = {x["toxic"]: x["count"] for x in known.groupBy("toxic").count().collect()}
    texts = {low_bytes(x["text"]): x["toxic"] for x in sorted(rows, key=lambda x: (x["doc_id"], x["text"]))}
    return list(texts.items()), of.get(0, 0) / max(1, of.get(1, 0))


def marking_words(toxic: list[bytes], ordinary: list[bytes]) -> set[bytes]:
    """Words of toxic texts that ordinary ones hardly have."""
    count = [Counter(), Counter()]
    for k, texts in enumerate((ordinary, toxic)):
        for x in texts:
            count[k].update(set(ALNUM_WORDS.findall(x)))
    n0, n1, out = len(ordinary), len(toxic), set()
    for w, b in count[1].items():
        a = count[0][w]
        p = (a + b) / (n0 + n1)
        if b >= max(2, LEAST * n1) and b / n1 >= RATIO * a / n0 and b / n1 - a / n0 >= SCORE * math.sqrt(p * (1 - p) * (1 / n0 + 1 / n1)):
            out.add(w)
    return out


def trained(pieces: list[bytes], size: int, k: int) -> bytes:
    """A trained dictionary's bytes; too few pieces to train on are the dictionary themselves."""
    try:
        return zstandard.train_dictionary(size, pieces, d=6, k=k, steps=0).as_bytes()
    except zstandard.ZstdError:
        return b"".join(w for w, _ in Counter(pieces).most_common())[:size]


def cut(data: bytes) -> list[bytes]:
    return [data[i : i + WINDOW] for i in range(0, max(1, len(data)), WINDOW)]


class Distance:
    """Savings of a text's windows by the toxic dictionary."""

    def __init__(self, ordinary: bytes, toxic: bytes) -> None:
        params = zstandard.ZstdCompressionParameters(format=zstandard.FORMAT_ZSTD1_MAGICLESS, window_log=17, chain_log=16, hash_log=15, search_log=6, min_match=4, target_length=64, strategy=zstandard.STRATEGY_BTLAZY2, write_checksum=0, write_content_size=0, write_dict_id=0)
        self.both = [zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(x, dict_type=zstandard.DICT_TYPE_RAWCONTENT), compression_params=params) for x in (ordinary, toxic + ordinary)]

    def features(self, data: bytes) -> list[float]:
        plain, other = self.both
        saved = np.array([len(plain.compress(w)) - len(other.compress(w)) for w in cut(data)], float)
        n = len(saved)
        return [min(saved.max(), 12), saved.mean(), math.log1p(np.maximum(saved, 0).sum()), *(math.log1p((saved >= t).sum()) for t in LEVELS), *((saved >= t).mean() for t in LEVELS[1:4]), math.log1p(n)]


def fitted(x: np.ndarray, y: np.ndarray, ratio: float = 1.0, penalty: float = 1.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Logistic weights by Newton's steps on standardised features; the last weight is moved so that 0.5 is where F1 is highest for ratio ordinary rows to a toxic one."""
    mean, spread = x.mean(axis=0), x.std(axis=0) + 1e-9
    z = np.column_stack([(x - mean) / spread, np.ones(len(x))])
    w, hold = np.zeros(z.shape[1]), penalty * np.eye(z.shape[1])
    hold[-1, -1] = 1e-3
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        w += np.linalg.solve((z.T * (p * (1 - p))) @ z + hold, z.T @ (y - p) - hold @ w)
    v = z @ w
    order = np.argsort(-v, kind="stable")
    right, each = np.cumsum(y[order]), ratio * y.sum() / max(1.0, len(y) - y.sum())
    best = int(np.argmax(2 * right / (right + each * (np.arange(1, len(y) + 1) - right) + y.sum())))
    w[-1] -= (v[order[best]] + v[order[min(best + 1, len(y) - 1)]]) / 2
    return mean, spread, w


def train(rows: list[tuple[bytes, int]], ratio: float = 1.0) -> tuple | None:
    """(ordinary dictionary, toxic dictionary, mean, spread, weights), or None without both classes."""
    of = [[x for x, t in rows if t == k] for k in (0, 1)]
    if min(map(len, of)) < 2:
        return None
    (ordinary, fit0), (toxic, fit1) = [(x[::2], x[1::2]) for x in of]
    marks = marking_words(toxic, ordinary)
    stretches = [b" " + w + b" " for x in toxic for w in ALNUM_WORDS.findall(x) if w in marks]
    windows = [x[i : i + 64] for x in ordinary for i in range(0, len(x), 64)]
    dictionaries = trained(windows, ORDINARY_BYTES, 64), trained(stretches, TOXIC_BYTES, 32)
    if not all(dictionaries):
        return None
    distance = Distance(*dictionaries)
    x = np.array([distance.features(t) for t in fit0 + fit1])
    return (*dictionaries, *fitted(x, np.array([0.0] * len(fit0) + [1.0] * len(fit1)), ratio))


def score(docs: DataFrame, labels: DataFrame, each: int = SAMPLE) -> DataFrame:
    """docs: doc_id, text; labels: doc_id, toxic. doc_id, score for each row of docs."""
    docs = in_small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    model = train(*sample(docs, labels, each))
    if model is None:
        return docs.select("doc_id", F.lit(0.0).alias("score"))
    ordinary, toxic, mean, spread, weights = model

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        distance = Distance(ordinary, toxic)
        for batch in batches:
            x = np.array([distance.features(low_bytes(t if isinstance(t, str) else None)) for t in batch["text"].tolist()]).reshape(len(batch), len(mean))
            z = ((x - mean) / spread) @ weights[:-1] + weights[-1]
            yield pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64"), "score": 1 / (1 + np.exp(-np.clip(z, -30, 30)))})

    return docs.mapInPandas(run, "doc_id long, score double")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
