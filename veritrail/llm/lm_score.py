"""Language-model scores: the marginal probability of a text over all its segmentations into subwords.

The subwords are those of a public tokenizer's vocabulary. Its own scores weight the segmentations: they are the first
weights, and the prior of PRIOR tokens' worth in each of ROUNDS rounds of expectation over the training documents'
counted words, every word's segmentations weighed by the forward and backward sums, which fit the weights to the corpus. A word's probability is the sum over all segmentations
of the mark of a word's start and its characters (log-space forward recursion); characters outside the vocabulary go
by their bytes. A text's is the product of its words' and of the end token's.

Words are counted over all documents in Spark. A word of at least one in HEAD tokens is scored from a table that is
sent to the workers, of HEAD words at most; the others are joined by the word, and none of them can be a hot key.

Null and empty texts are the end token alone. Repeated rows get a row each, and are learnt from as often. A null doc_id
counts as training. With no training text every count is zero and the vocabulary's weights are used; an empty table
gives no rows. Texts and words may be of any length, and are scored whole. Words seen equally often are all sent or all
joined. Only doc_id and text are read, whatever other columns are called.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from veritrail.llm.common import SPACE_WORDS, in_small_batches, low_bytes, staged, table
from veritrail.llm.hashing import mixed


HEAD = 1_000_000
FOLDS, HELD_OUT = 7, 2
MARK, END = "▁", "</s>"
PRIOR = 30_000.0
ROUNDS = 2
FLUSH = 300_000


def vocabulary(path: str | None = None) -> dict[str, float]:
    """Log weights from the tokenizer's own scores: a score of -r stands for the r-th merge, weighted as 1 / (r + 1)."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path or public_tokenizers.path("piece_bpe_32k.model"))
    raw = {model.id_to_piece(i): 1 / (1 + abs(model.get_score(i))) for i in range(model.get_piece_size()) if not (model.is_unknown(i) or model.is_unused(i) or model.id_to_piece(i) == "<s>")}
    raw = {k: v / 1000 if k.startswith("<0x") else v for k, v in raw.items()}
    total = math.log(math.fsum(raw.values()))
    return {k: math.log(v) - total for k, v in raw.items()}


class Lattice:
    """All segmentations of a word."""

    def __init__(self, weights: dict[str, float]) -> None:
        self.weights, self.longest = weights, max(map(len, weights))

    def byte_weight(self, char: str) -> float:
        return math.fsum(self.weights[f"<0x{b:02X}>"] for b in char.encode("utf-8", "surrogatepass"))

    def edges(self, text: str) -> list[list[tuple[int, float, str]]]:
        """For each place the pieces that end there: where they start, their weight, what they are."""
        get, longest, out = self.weights.get, self.longest, []
        for j in range(1, len(text) + 1):
            here = [(i, w, p) for i in range(max(0, j - longest), j) if (w := get(p := text[i:j])) is not None]
            if text[j - 1] not in self.weights:
                here.append((j - 1, self.byte_weight(text[j - 1]), text[j - 1]))
            out.append(here)
        return out

    def forward(self, edges: list) -> list[float]:
        a = [0.0]
        for here in edges:
            terms = [a[i] + w for i, w, _ in here]
            top = max(terms)
            a.append(top if len(terms) == 1 else top + math.log(sum(math.exp(t - top) for t in terms)))
        return a

    def log_probability(self, word: str) -> float:
        """Natural logarithm of the word's marginal probability."""
        return self.forward(self.edges(MARK + word))[-1]

    def expect(self, word: str, times: float, into: dict[str, float]) -> None:
        """Adds each piece's expected count in the word's segmentations."""
        edges = self.edges(MARK + word)
        a = self.forward(edges)
        n, whole = len(edges), a[-1]
        b = [-math.inf] * n + [0.0]
        for j in range(n, 0, -1):
            for i, w, p in edges[j - 1]:
                t = w + b[j]
                into[p] = into.get(p, 0.0) + times * math.exp(a[i] + t - whole)
                lo, hi = (t, b[i]) if t < b[i] else (b[i], t)
                b[i] = hi + math.log1p(math.exp(lo - hi)) if lo > -math.inf else hi


class Lattices:
    """Lattice's sums for many words at once: words of one length have the same edges, so their recursions run side by side. Long words, and those with characters outside the vocabulary, go by Lattice one by one."""

    LONG, BASE = 40, 0x100000001B3

    def __init__(self, weights: dict[str, float]) -> None:
        self.single, self.pieces = Lattice(weights), list(weights)
        self.indexed()
        self.log = np.append(np.fromiter(weights.values(), float, len(weights)), -np.inf)  # the last stands for no piece

    def indexed(self) -> None:
        """Pieces by a 64-bit hash of their characters, in two tables: the second has those whose slot in the first is taken."""
        none, self.keys = len(self.pieces), np.zeros(len(self.pieces) + 1, np.uint64)
        for i, p in enumerate(self.pieces):
            h = 0
            for c in p:
                h = (h * self.BASE + ord(c)) & 0xFFFFFFFFFFFFFFFF
            self.keys[i] = h
        self.again, spread = np.uint64(0x9E3779B97F4A7C15), mixed(self.keys[:-1])
        self.tables = [np.full(1 << 20, none, np.int32) for _ in range(2)]
        slot = (spread >> np.uint64(44)).astype(np.int64)
        _, first = np.unique(slot, return_index=True)
        self.tables[0][slot[first]] = first
        rest = np.setdiff1d(np.arange(none), first)
        while len(np.unique(other := ((spread[rest] * self.again) >> np.uint64(44)).astype(np.int64))) < len(rest):
            self.again += np.uint64(2)
        self.tables[1][other] = rest

    def piece_of(self, h: np.ndarray) -> np.ndarray:
        none, spread = len(self.pieces), mixed(h)
        first = self.tables[0][(spread >> np.uint64(44)).astype(np.int64)]
        second = self.tables[1][((spread * self.again) >> np.uint64(44)).astype(np.int64)]
        return np.where(self.keys[first] == h, first, np.where(self.keys[second] == h, second, none))

    def groups(self, words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray | None, np.ndarray, np.ndarray]]:
        """(which words, their edges' pieces, the edges' starts, their ends); no pieces for words that go one by one."""
        by: dict[int, list[int]] = {}
        for k, w in enumerate(words):
            by.setdefault(len(w) + 1, []).append(k)
        none = len(self.pieces)
        for n, which in by.items():
            which = np.array(which)
            if n > self.LONG:
                yield which, None, which, which
                continue
            edges = [(i, j) for j in range(1, n + 1) for i in range(max(0, j - self.single.longest), j)]
            starts, ends = np.array([e[0] for e in edges]), np.array([e[1] for e in edges])
            at = {e: k for k, e in enumerate(edges)}
            for part in np.array_split(which, -(-len(which) // 4096)):
                points = np.frombuffer("".join(MARK + words[k] for k in part).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(part), n).astype(np.uint64)
                ids, h = np.empty((len(part), len(edges)), np.int32), np.zeros((len(part), n + 1), np.uint64)
                for size in range(1, min(n, self.single.longest) + 1):
                    h = h[:, : n - size + 1] * np.uint64(self.BASE) + points[:, size - 1 :]
                    ids[:, [at[i, i + size] for i in range(n - size + 1)]] = self.piece_of(h)
                odd = (ids[:, ends - starts == 1] == none).any(axis=1)
                if odd.any():
                    yield part[odd], None, starts, ends
                if not odd.all():
                    yield part[~odd], ids[~odd], starts, ends

    @staticmethod
    def total(terms: np.ndarray) -> np.ndarray:
        """Logarithm of the rows' summed exponentials; every row has a finite term."""
        top = terms.max(axis=1)
        return top + np.log(np.exp(terms - top[:, None]).sum(axis=1))

    def forward(self, weight: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        a = np.zeros((len(weight), int(ends[-1]) + 1))
        cuts = np.searchsorted(ends, np.arange(1, a.shape[1] + 1))  # edges are in order of their ends
        for j in range(1, a.shape[1]):
            here = slice(cuts[j - 1], cuts[j])
            a[:, j] = self.total(a[:, starts[here]] + weight[:, here])
        return a

    def log_probability(self, words: list[str]) -> np.ndarray:
        out = np.empty(len(words))
        for which, ids, starts, ends in self.groups(words):
            out[which] = [self.single.log_probability(words[k]) for k in which] if ids is None else self.forward(self.log[ids], starts, ends)[:, -1]
        return out

    def expect(self, words: list[str], times: list[int], into: np.ndarray, others: dict[str, float]) -> None:
        """Adds the pieces' expected counts; those of words that go one by one to others."""
        times_ = np.array(times, float)
        for which, ids, starts, ends in self.groups(words):
            if ids is None:
                for k in which:
                    self.single.expect(words[k], times_[k], others)
                continue
            weight = self.log[ids]
            a = self.forward(weight, starts, ends)
            b = np.zeros_like(a)
            for i in range(a.shape[1] - 2, -1, -1):
                here = np.flatnonzero(starts == i)
                b[:, i] = self.total(b[:, ends[here]] + weight[:, here])
            share = np.exp(a[:, starts] + weight + b[:, ends] - a[:, -1:]) * times_[which][:, None]
            into += np.bincount(ids.ravel(), share.ravel(), minlength=len(into))


def gathered(batches: Iterator[pa.RecordBatch], rows: int = 20_000) -> Iterator[pa.Table]:
    """Small batches together, so that many words of one length meet."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= rows:
            yield pa.Table.from_batches(held)
            held, n = [], 0
    if held:
        yield pa.Table.from_batches(held)


def _training() -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(FOLDS)) != HELD_OUT, F.lit(True))


def word_counts(docs: DataFrame) -> DataFrame:
    """docs: text, train. (word, c, seen): how often a word stands in training texts, and in all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        train, all_, names = Counter(), Counter(), ["word", "c", "seen"]

        def out() -> pa.RecordBatch:
            words = list(all_)
            got = pa.RecordBatch.from_arrays([pa.array([w.decode("utf-8", "replace") for w in words], pa.string()), pa.array([train[w] for w in words], pa.int64()), pa.array([all_[w] for w in words], pa.int64())], names)
            train.clear()
            all_.clear()
            return got

        for batch in batches:
            for text, own in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                words = SPACE_WORDS.findall(low_bytes(text.as_py()))
                all_.update(words)
                if own:
                    train.update(words)
                if len(all_) > FLUSH:
                    yield out()
        if all_:
            yield out()

    return docs.select("text", "train").mapInArrow(run, "word string, c long, seen long").groupBy("word").agg(F.sum("c").alias("c"), F.sum("seen").alias("seen"))


def unigram(words: DataFrame, ends: int, first: dict[str, float], scores: dict[str, float]) -> dict[str, float]:
    """Log weights of the pieces after a round of expectation over the counted training words, with the vocabulary's scores as the prior; a row for each piece of the vocabulary comes back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattices, others = Lattices(first), {}
        into = np.zeros(len(first) + 1)
        for batch in gathered(batches):
            lattices.expect(batch.column(0).to_pylist(), batch.column(1).to_pylist(), into, others)
        kept = {p: float(v) for p, v in zip(first, into, strict=False) if v}
        for p, v in others.items():
            for q in [p] if p in first else [f"<0x{b:02X}>" for b in p.encode("utf-8", "surrogatepass")]:
                kept[q] = kept.get(q, 0.0) + v
        yield pa.RecordBatch.from_arrays([pa.array(list(kept), pa.string()), pa.array(list(kept.values()), pa.float64())], ["piece", "n"])

    rows = words.where("c > 0").select("word", "c").mapInArrow(run, "piece string, n double").groupBy("piece").agg(F.sum("n").alias("n")).collect()
    counts = {x["piece"]: x["n"] for x in rows} | {END: float(ends)}
    total = math.log(math.fsum(counts.values()) + PRIOR)
    return {p: math.log(counts.get(p, 0.0) + PRIOR * math.exp(scores[p])) - total for p in first}


def score(docs: DataFrame, vocabulary_path: str | None = None, head: int = HEAD) -> DataFrame:
    """docs: doc_id, text, train. doc_id, train, n_tokens, n_known, train_tokens, base_score, score for each row."""
    spark = docs.sparkSession
    docs = in_small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), "train")
    counted = staged(word_counts(docs), "words")
    totals = counted.agg(F.sum("c").alias("n"), F.sum("seen").alias("all"), F.count_if(F.col("c") > 0).alias("v")).first()
    ends = docs.where("train").count()
    n, v = (totals["n"] or 0) + ends, totals["v"] + (ends > 0)
    first = vocabulary(vocabulary_path)
    weights = first
    for _ in range(ROUNDS if ends else 0):
        weights = unigram(counted, ends, weights, first)
    floor, log10 = float(n + v + 1), math.log(10)

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattices = Lattices(weights)
        for words in gathered(batches):
            own = lattices.log_probability(words.column("word").to_pylist()) / log10
            yield from words.append_column("lattice", pa.array(own, pa.float64())).combine_chunks().to_batches()

    rated = staged(counted.mapInArrow(rate, "word string, c long, seen long, lattice double"), "rated")
    least = max(1, -(-(totals["all"] or 0) // head))
    common = {x["word"].encode(): (math.log10((x["c"] + 1) / floor), x["lattice"], x["c"] > 0) for x in rated.where(F.col("seen") >= least).collect()}  # at most head words
    sent = spark.sparkContext.broadcast(common)
    names = ["row", "doc_id", "train", "word", "n", "known", "base", "lattice"]
    kinds = [pa.int64(), pa.int64(), pa.bool_(), pa.string(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
    end_base, end_lattice = math.log10((ends + 1) / floor), weights[END] / log10

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each text with what its common words give, and one for each of its other words."""
        get, row = sent.value.get, TaskContext.get().partitionId() << 33
        for batch in batches:
            rows, ids, train, word, times, known, base, lattice = ([] for _ in range(8))

            def out() -> pa.RecordBatch:
                return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip((rows, ids, train, word, times, known, base, lattice), kinds, strict=True)], names)

            for doc, text, own in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
                words = Counter(SPACE_WORDS.findall(low_bytes(text.as_py())))
                b, s, k, other = end_base, end_lattice, int(ends > 0), []
                for w, c in words.items():
                    if got := get(w):
                        b += c * got[0]
                        s += c * got[1]
                        k += c * got[2]
                    else:
                        other.append((w.decode("utf-8", "replace"), c))
                rows += [row] * (1 + len(other))
                ids += [doc] + [None] * len(other)
                train += [own] + [None] * len(other)
                word += [None, *(w for w, _ in other)]
                times += [1 + words.total(), *(c for _, c in other)]
                known += [k] + [None] * len(other)
                base += [b] + [None] * len(other)
                lattice += [s] + [None] * len(other)
                row += 1
                if len(rows) > 200_000:
                    yield out()
                    rows, ids, train, word, times, known, base, lattice = ([] for _ in range(8))
            if rows:
                yield out()

    parts = staged(docs.mapInArrow(split, "row long, doc_id long, train boolean, word string, n long, known long, base double, lattice double"), "tokens")
    rare = parts.where("word is not null").select("row", "word", "n").join(rated.where(F.col("seen") < least).select("word", "c", "lattice"), "word")
    each = rare.groupBy("row").agg(F.sum(F.col("n") * (F.col("c") > 0).cast("long")).alias("rare_known"), F.sum(F.col("n") * F.log10((F.col("c") + 1) / floor)).alias("rare_base"), F.sum(F.col("n") * F.col("lattice")).alias("rare_lattice"))
    whole = parts.where("word is null").select("row", "doc_id", "train", "n", "known", "base", "lattice").join(each, "row", "left")
    plus = lambda a, b: F.col(a) + F.coalesce(F.col(b), F.lit(0))
    return whole.select("doc_id", "train", F.col("n").alias("n_tokens"), plus("known", "rare_known").cast("long").alias("n_known"), F.lit(n).cast("long").alias("train_tokens"), plus("base", "rare_base").alias("base_score"), plus("lattice", "rare_lattice").alias("score"))


def op8_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", _training().alias("train"))
    return score(docs).select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
