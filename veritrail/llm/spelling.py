"""Spelling variants: each word of a vocabulary, the words one edit away, and the far more frequent one it stands for.

The edits of a word are made in tasks and asked of a blocked Bloom filter of the vocabulary, which is sharded by word
length: a word's shard is of the length that the edit has, and a block of 512 bits in it holds all bits of a word. Only
edits that the filter may hold are shuffled, to a join with the vocabulary that drops the false ones. A pair of near
words is found once, from the longer word by deletion or from the one that is smaller at the replaced letter, and then
turned both ways.

The filter is broadcast and never has over MAX_WORDS words: a larger vocabulary is dealt out by hash, and each part has
its own filter and asks all edits again. It is put together from segments that tasks fill; what comes to the driver
are its bits.

Words are counted before they are shuffled, so a frequent one is no hot key. A word has at most some hundred near words,
one edit apart in letters that the vocabulary has, so no group grows with the table.

Null and empty texts have no words. Texts of any length are read whole. Rows repeated under one doc_id count as often as
they occur, and their words lose the same letters; rows without a doc_id are counted, and their words lose none. Of near
words with equal counts the first in code-point order is the form. An empty table has no words. Only doc_id and text are
read, whatever other columns are called.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from veritrail.llm.common import ASCII_LOWER, ASCII_UPPER, partitions, staged, table
from veritrail.llm.hashing import mixed

#: Maximal runs of letters, what is left out of one in so many, least length and count, how much more frequent a form is.
RUN, EVERY, LEAST_LENGTH, LEAST_COUNT, TIMES = r"[A-Za-z\x{00C0}-\x{00FF}]+", 199, 6, 5, 5
#: Words of one filter, its bits for each, and bits set by each.
MAX_WORDS, BITS_A_WORD, PROBES = 16_000_000, 16, 5
#: Blocks of a segment, of 64 bytes each, which one group of rows fills.
SEGMENT = 1024
#: Lengths have shards of their own up to this one; longer words share the last.
LONGEST_SHARD = 64
#: Words, and letters of words padded to the longest, that are held at once; one longer word is held alone.
WORDS, LETTERS = 2000, 400_000


def words(docs: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, drop: bool = True) -> DataFrame:
    """(word, n) of docs (doc_id, text): runs of letters, lower-cased in A-Z, that occur least_count times. drop: of one run in EVERY by its hash with the doc_id a letter goes."""
    runs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.explode(F.regexp_extract_all(F.col("text").cast("string"), F.lit(RUN), F.lit(0))).alias("run"))
    low = runs.select("doc_id", F.translate("run", ASCII_UPPER, ASCII_LOWER).alias("run"))
    word: Column = F.col("run")
    if drop:
        h = F.crc32(F.concat(F.col("doc_id").cast("string"), F.lit(":"), F.col("run")))
        at = (h % F.length("run")).cast("int")
        word = F.when(h % EVERY == 0, F.concat(F.substring(F.col("run"), F.lit(1), at), F.substring(F.col("run"), at + 2, F.length("run")))).otherwise(word)
    return low.select(word.alias("word")).where(F.length("word") >= least_length).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_count)


def letters(text: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    """Code points of each word, padded with 0, and the lengths."""
    sizes = text.str.len().to_numpy(np.int64)
    flat = np.frombuffer("".join(text.tolist()).encode("utf-32-le"), "<u4").astype(np.uint64)
    out = np.zeros((len(text), int(sizes.max(initial=0))), np.uint64)
    out[np.arange(out.shape[1]) < sizes[:, None]] = flat
    return out, sizes


def lots(batch: pd.DataFrame) -> Iterator[pd.DataFrame]:
    """The batch's rows in lots of words of like lengths."""
    batch = batch.iloc[np.argsort(batch["word"].str.len().to_numpy(np.int64), kind="stable")]
    sizes, first = batch["word"].str.len().to_numpy(np.int64), 0
    while first < len(batch):
        n = 1
        while first + n < len(batch) and n < WORDS and (n + 1) * sizes[first + n] <= LETTERS:
            n += 1
        yield batch.iloc[first : first + n]
        first += n


#: Odd, so that it has an inverse among the 64-bit numbers.
ODD_STEP = np.uint64(0x9E3779B97F4A7C15)


def powers(n: int) -> np.ndarray:
    return np.concatenate(([np.uint64(1)], np.cumprod(np.full(n, ODD_STEP, np.uint64), dtype=np.uint64)))


def sums(codes: np.ndarray) -> np.ndarray:
    """Of each prefix, the empty one first: the sum of letters times the powers of ODD_STEP by place. A word's hash is the whole sum, mixed; an edit's is had from prefixes."""
    out = np.zeros((len(codes), codes.shape[1] + 1), np.uint64)
    np.cumsum(mixed(codes + np.uint64(1)) * powers(codes.shape[1])[: codes.shape[1]] * (codes > 0), axis=1, out=out[:, 1:])
    return out


def finished(total: np.ndarray, size: np.ndarray) -> np.ndarray:
    return mixed(total ^ mixed(size.astype(np.uint64) + np.uint64(77)))


class Filter:
    """Where the bits of a word are: shards of blocks by length. sizes: the words of every length up to LONGEST_SHARD."""

    def __init__(self, sizes: np.ndarray) -> None:
        blocks = -(-sizes * BITS_A_WORD // 512)
        self.blocks, self.first = blocks.astype(np.uint64), np.concatenate(([0], np.cumsum(blocks)))[:-1].astype(np.uint64)
        self.n_blocks = int(blocks.sum())

    def block(self, hashes: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        shard = np.minimum(lengths, LONGEST_SHARD)
        return self.first[shard] + (hashes >> np.uint64(40)) % np.maximum(self.blocks[shard], np.uint64(1))

    @staticmethod
    def bits(hashes: np.ndarray) -> np.ndarray:
        """PROBES places of 512 for each hash, from its lower bits."""
        again = mixed(hashes)
        return np.stack([(again >> np.uint64(9 * k)) & np.uint64(511) for k in range(PROBES)])

    def may_hold(self, held: np.ndarray, hashes: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Places of hashes that the filter may hold. held: its bytes. Those that fail a probe aren't asked the next."""
        shard = np.minimum(lengths, LONGEST_SHARD)
        left = np.flatnonzero(self.blocks[shard] > 0)
        base = self.block(hashes[left], lengths[left]).astype(np.int64) * 64
        again = mixed(hashes[left])
        for k in range(PROBES):
            bit = (again >> np.uint64(9 * k) & np.uint64(511)).astype(np.int64)
            on = (held[base + (bit >> 3)] >> (bit & 7).astype(np.uint8) & 1).astype(bool)
            left, base, again = left[on], base[on], again[on]
        return left


def word_hashes(text: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    codes, sizes = letters(text)
    return finished(sums(codes)[:, -1], sizes), sizes


def filled(vocabulary: DataFrame, plan: Filter) -> np.ndarray:
    """The filter of the words, put together from segments that tasks fill."""

    def places(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in (x for batch in batches for x in lots(batch)):
            hashes, sizes = word_hashes(part["word"])
            block = plan.block(hashes, sizes).astype(np.int64)
            yield pd.DataFrame({"segment": block // SEGMENT, "block": block % SEGMENT, "h": hashes.view(np.int64)})

    def segment(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        bits = np.zeros(SEGMENT * 512, bool)
        for at in Filter.bits(rows["h"].to_numpy(np.int64).view(np.uint64)):
            bits[rows["block"].to_numpy(np.int64) * 512 + at.astype(np.int64)] = True
        return pd.DataFrame({"segment": [key[0]], "bits": [np.packbits(bits, bitorder="little").tobytes()]})

    held = np.zeros(-(-plan.n_blocks // SEGMENT) * SEGMENT * 64, np.uint8)
    found = vocabulary.select("word").mapInPandas(places, "segment long, block long, h long").groupBy("segment").applyInPandas(segment, "segment long, bits binary")
    for row in staged(found, "filter").toLocalIterator():
        at = row["segment"] * SEGMENT * 64
        held[at : at + SEGMENT * 64] = np.frombuffer(row["bits"], np.uint8)
    return held


def edits(codes: np.ndarray, sizes: np.ndarray, alphabet: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(words, place, letter or 0 for none, hash, length) of deletions, one of a run of equal letters, and of replacements by a greater letter."""
    before, step = sums(codes), powers(codes.shape[1])
    total = before[:, -1]
    for at in range(codes.shape[1]):
        here = codes[:, at]
        cut = np.flatnonzero((at < sizes) & ((at == 0) | (here != codes[:, at - 1])))
        # letters after the one that goes stand one place earlier: their sum is divided by the step, which is odd and so has an inverse
        rest = (total[cut] - before[cut, at + 1]) * INVERSE
        yield cut, np.full(len(cut), at), np.zeros(len(cut), np.uint64), finished(before[cut, at] + rest, sizes[cut] - 1), sizes[cut] - 1
        there = np.flatnonzero(at < sizes)
        bare = total[there] - mixed(here[there] + np.uint64(1)) * step[at]
        who, which = np.nonzero(alphabet[None, :] > here[there][:, None])
        letter = alphabet[which]
        yield there[who], np.full(len(who), at), letter, finished(bare[who] + mixed(letter + np.uint64(1)) * step[at], sizes[there][who]), sizes[there][who]


#: The inverse of ODD_STEP among the 64-bit numbers.
INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def probed(vocabulary: DataFrame, plan: Filter, held: np.ndarray, alphabet: list[int]) -> DataFrame:
    """(word, n, edit): the edits that the filter may hold."""
    sent = vocabulary.sparkSession.sparkContext.broadcast(held)
    own = np.array(alphabet, np.uint64)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in (x for batch in batches for x in lots(batch)):
            text, n = part["word"].tolist(), part["n"].to_numpy()
            out: list[tuple[str, int, str]] = []
            for who, place, letter, hashes, size in edits(*letters(part["word"]), own):
                for k in plan.may_hold(sent.value, hashes, size).tolist():
                    word, at = text[who[k]], place[k]
                    out.append((word, n[who[k]], word[:at] + (chr(letter[k]) if letter[k] else "") + word[at + 1 :]))
            yield pd.DataFrame(out, columns=["word", "n", "edit"])

    return vocabulary.select("word", "n").mapInPandas(run, "word string, n long, edit string")


def near_words(vocabulary: DataFrame) -> DataFrame:
    """vocabulary: word (distinct), n; written already. Rows (word, near, near_n): all words one edit away, both ways."""
    spark = vocabulary.sparkSession
    sizes = vocabulary.groupBy(F.least(F.length("word"), F.lit(LONGEST_SHARD)).alias("size")).agg(F.count("*").alias("n")).collect()  # a row for each length
    alphabet = sorted(ord(x[0]) for x in vocabulary.select(F.explode(F.split("word", "")).alias("x")).where("x <> ''").distinct().collect())  # the letters
    total = sum(x["n"] for x in sizes)
    parts = max(1, -(-total // MAX_WORDS))
    counts = np.zeros(LONGEST_SHARD + 1, np.int64)
    for x in sizes:
        counts[x["size"]] = -(-x["n"] // parts)
    plan, found = Filter(counts), None
    for k in range(parts):
        part = vocabulary.where(F.pmod(F.xxhash64("word"), F.lit(parts)) == k) if parts > 1 else vocabulary
        asked = probed(vocabulary.repartition(4 * partitions(spark)), plan, filled(part, plan), alphabet)
        there = part.select(F.col("word").alias("edit"), F.col("n").alias("edit_n"))
        pairs = staged(asked.join(there, "edit"), "near-pairs")
        found = pairs if found is None else found.union(pairs)
    both = F.array(F.struct("word", F.col("edit").alias("near"), F.col("edit_n").alias("near_n")), F.struct(F.col("edit").alias("word"), F.col("word").alias("near"), F.col("n").alias("near_n")))
    return found.select(F.inline(both))


def roots(links: DataFrame) -> DataFrame:
    """(word, root) of links (word, form), written already, in which no word follows itself: pointers jump to their pointer's pointer until all have arrived."""
    at = links.select("word", F.col("form").alias("root"))
    while True:
        ahead = at.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = staged(at.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        at = moved.select("word", "root")
        if moved.where("moved").isEmpty():
            return at


def variants(vocabulary: DataFrame, times: int = TIMES) -> DataFrame:
    """vocabulary: word (distinct), n. One row for each word: form (its most frequent near word, if that is times as frequent), root (the last of the forms' chain), n, n_near, form_n."""
    vocabulary = staged(vocabulary.select("word", "n"), "vocabulary")
    best = F.min(F.struct((-F.col("near_n")).alias("less"), "near"))
    near = near_words(vocabulary).groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best"))
    is_form = -F.col("best.less") >= times * F.col("n")
    told = staged(vocabulary.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(is_form, F.col("best.near")).alias("form"), F.when(is_form, -F.col("best.less")).alias("form_n")), "forms")
    ends = roots(told.where("form is not null").select("word", "form"))
    return told.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(words(table(spark, sf_dir, "documents")))
