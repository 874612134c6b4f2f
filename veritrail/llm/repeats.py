"""Repeated passages by a sparse suffix array over minimisers.

A passage of LEAST words or more stands in two documents exactly if all its windows of LEAST words do, so the words
that a document's repeated windows cover are its repeated words. Only suffixes at minimisers are kept: the places whose
k-mer of words has the smallest hash of some window of LEAST words. Equal windows have theirs at the same place, so two
texts that share a window have suffixes of one k-mer there, with the rest of the window to the left and right of it in
common. A suffix carries the words that a window can reach: LEAST - KMER to its right and as many to its left. Suffixes
of k-mers that stand in one document only are dropped.

Suffixes are sorted by k-mer and the words to the right, in one order over all tasks, and read in blocks of whole
k-mers. Common prefixes of neighbours give the runs that have any number of words to the right in common; a second
order of the block, by the words to the left read backwards, gives the runs that have any number to the left in common.
Suffixes of two documents in one run of each, of LEAST words together, share a window; each is extended left and right
to the ends of all windows it shares. Looking at the runs instead of the next neighbour alone keeps passages beside a
line that many texts have, whose neighbours in either order are other texts.

A k-mer of more than BLOCK suffixes, or one at a task's border, is read in several blocks. Suffixes with windows in a
run that goes on beyond its block are sorted once more, by the words to the left over all tasks, and compared in the
same way: beside a frequent line one of the two orders sets texts apart at once. Only windows in runs that go on in
both orders are told one by one: one row for a window that two documents of the block have, else the places of the one
document; rows of equal windows from several blocks are put together by a partial aggregate. So no group is held whole,
however many documents share a passage.

Equal texts are one class: one of them goes through the above, and if it has LEAST words all of it is repeated. Texts
that are null, empty or shorter than LEAST words repeat nothing. Rows repeated under one doc_id are copies like
others, and different texts under one doc_id are different documents; a text that no row with a doc_id has is compared
with its own copies alone. Texts of any length are
taken whole. Places of equal hashes in a window are all its minimisers. Words are compared by 32 bits of their hashes,
k-mers by 64. An empty table gives no rows. Words are those between white space, A-Z lower-cased. Only doc_id and
text are read, whatever other columns are called.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from veritrail.llm.common import SPACE_WORDS, in_small_batches, low_bytes, partitions, sent_if_small, staged, table
from veritrail.llm.hashing import WordHashes, grams, mixed

LEAST, KMER = 50, 10
#: Words that a window can have on one side of its minimiser; suffixes that are compared at once.
SIDE, BLOCK = LEAST - KMER, 50_000


def smallest(hashes: np.ndarray) -> np.ndarray:
    """The smallest k-mer hash in every window of LEAST words."""
    span, low, width = LEAST - KMER + 1, hashes, 1
    while width < span:
        step = min(width, span - width)
        low, width = np.minimum(low[:-step], low[step:]), width + step
    return low


def selected(hashes: np.ndarray) -> np.ndarray:
    """Whether each k-mer is the smallest of some window: of the smallest of the windows that hold it, the largest is its own."""
    most, width = np.concatenate([np.zeros(SIDE, np.uint64), smallest(hashes), np.zeros(SIDE, np.uint64)]), 1
    while width < SIDE + 1:
        step = min(width, SIDE + 1 - width)
        most, width = np.maximum(most[:-step], most[step:]), width + step
    return most == hashes


def class_of(words: list[bytes]) -> bytes:
    return xxhash.xxh128_digest(b" ".join(words))


def part_of(digest: bytes) -> int:
    return int.from_bytes(digest[:8], "big", signed=True)


def minimisers(docs: DataFrame) -> DataFrame:
    """docs: doc_id, text. doc_id, n_words, class and own, a part of it (null below LEAST words), kmers (array of the minimisers' hashes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for batch in batches:
            ids, n, classes, kmers = batch.column(0), [], [], []
            for text in batch.column(1):
                words = SPACE_WORDS.findall(low_bytes(text.as_py()))
                n.append(len(words))
                if len(words) < LEAST:
                    classes.append(None)
                    kmers.append(np.zeros(0, np.int64))
                    continue
                classes.append(class_of(words))
                kmers.append(np.unique(smallest(grams(known.of(words), KMER))).view(np.int64))
            offsets = np.concatenate(([0], np.cumsum([len(x) for x in kmers]))).astype(np.int32)
            flat = pa.array(np.concatenate([np.zeros(0, np.int64), *kmers]))
            own = [part_of(x) if x else None for x in classes]
            yield pa.RecordBatch.from_arrays([ids, pa.array(n, pa.int64()), pa.array(classes, pa.binary()), pa.array(own, pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), flat)], ["doc_id", "n_words", "class", "own", "kmers"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, n_words long, class binary, own long, kmers array<long>")


SUFFIX = ["h", "doc", "place", "still", "words_right", "words_left"]


class Suffixes:
    """Suffixes in order: k-mer, document and place of each, its windows that are still open (bit k: that of k words to the left), and the words to its right and to its left (backwards), 0 beyond the text."""

    def __init__(self, kmer: np.ndarray, doc: np.ndarray, place: np.ndarray, still: np.ndarray, right: np.ndarray, left: np.ndarray) -> None:
        self.kmer, self.doc, self.place, self.still, self.right, self.left = kmer, doc, place, still, right, left

    def __len__(self) -> int:
        return len(self.kmer)

    def __getitem__(self, which) -> Suffixes:
        return Suffixes(*(x[which] for x in self.columns()))

    def columns(self) -> tuple[np.ndarray, ...]:
        return self.kmer, self.doc, self.place, self.still, self.right, self.left

    @staticmethod
    def of_text(words: np.ndarray, hashes: np.ndarray, at: np.ndarray, doc: int) -> Suffixes:
        """Of a text's word and k-mer hashes, at these places."""
        short = np.zeros(len(words) + 2 * SIDE, ">u4")
        short[SIDE:-SIDE] = np.maximum(words >> np.uint64(32), np.uint64(1))
        around = np.lib.stride_tricks.sliding_window_view(short, SIDE)
        return Suffixes(hashes[at].view(np.int64), np.full(len(at), doc, np.int64), at.astype(np.int32), np.full(len(at), -1), around[at + SIDE + KMER], around[at][:, ::-1])

    @staticmethod
    def joined(parts: list[Suffixes]) -> Suffixes:
        return parts[0] if len(parts) == 1 else Suffixes(*(np.concatenate(x) for x in zip(*(p.columns() for p in parts), strict=True)))

    @staticmethod
    def of_batch(batch: pa.RecordBatch) -> Suffixes:
        numbers = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(4)]
        words = []
        for k in (4, 5):
            held = batch.column(k)
            first = int(np.frombuffer(held.buffers()[1], np.int32, 1, held.offset * 4)[0])
            words.append(np.frombuffer(held.buffers()[2], ">u4", len(held) * SIDE, first).reshape(len(held), SIDE))
        return Suffixes(*numbers, *words)

    def batches(self, most: int = 10_000) -> Iterator[pa.RecordBatch]:
        for k in range(0, len(self), most):
            part = self[slice(k, k + most)]
            ends = pa.py_buffer(np.arange(len(part) + 1, dtype=np.int32) * (SIDE * 4))
            sides = [pa.Array.from_buffers(pa.binary(), len(part), [None, ends, pa.py_buffer(np.ascontiguousarray(x).tobytes())]) for x in (part.right, part.left)]
            yield pa.RecordBatch.from_arrays([pa.array(part.kmer), pa.array(part.doc), pa.array(part.place), pa.array(part.still), *sides], SUFFIX)


def common(group: np.ndarray, words: np.ndarray) -> np.ndarray:
    """How many first words each row has in common with the row before it, -1 at the start of a group."""
    same = (words[1:] == words[:-1]) & (words[1:] != 0)
    out = np.full(len(words), -1)
    out[1:] = np.where(group[1:] != group[:-1], -1, np.where(same.all(axis=1), SIDE, same.argmin(axis=1)))
    return out


def beside(shared: np.ndarray, least: int) -> np.ndarray:
    """Rows that have at least so many words in common with the row before or after."""
    near = shared >= least
    return near | np.append(near[1:], False)


def merged(doc: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, ...]:
    """Spans of each document, those that touch put together."""
    order = np.lexsort((start, doc))
    doc, start, end = doc[order], start[order], end[order]
    number = np.cumsum(np.append(False, doc[1:] != doc[:-1])) << 32
    upto = np.maximum.accumulate(number + end)
    new = np.append(True, number[1:] + start[1:] > upto[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(doc)) - 1
    return doc[first], start[first], (upto - number)[last]


TOLD = ["doc", "start", "end", "edge", "h", "w", "words_right", "words_left"]


def told(doc: np.ndarray, start: np.ndarray, end: np.ndarray, edge: int, h: np.ndarray, w: np.ndarray) -> pa.RecordBatch:
    n = len(doc)
    return pa.RecordBatch.from_arrays([pa.array(doc), pa.array(start.astype(np.int32)), pa.array(end.astype(np.int32)), pa.array(np.full(n, edge, np.int32)), pa.array(h), pa.array(w), pa.nulls(n, pa.binary()), pa.nulls(n, pa.binary())], TOLD)


def by_key(key: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """An order by key, where each key starts in it, and whether it is of two documents or more."""
    order = np.argsort(key, kind="stable")
    starts = np.flatnonzero(np.append(True, key[order][1:] != key[order][:-1]))
    ordered = doc[order]
    return order, starts, np.minimum.reduceat(ordered, starts) != np.maximum.reduceat(ordered, starts)


def matches(block: Suffixes, before: bool, after: bool, turned: bool = False) -> Iterator[pa.RecordBatch]:
    """Spans of the windows that two documents of the block share (edge 0). Of runs that may go on before or after the block their suffixes (3), two of a window known to be repeated; in the second order, where left and right are turned, for a window of two documents that it is repeated (2), for others where they stand (1)."""
    first, last = block.kmer == block.kmer[0], block.kmer == block.kmer[-1]
    open_kmers = (first & before) | (last & after)
    alone = np.append(True, block.kmer[1:] != block.kmer[:-1])
    alone &= np.append(alone[1:], True)
    block = block[~alone | open_kmers]
    n = len(block)
    if not n:
        return
    first, last = block.kmer == block.kmer[0], block.kmer == block.kmer[-1]
    group = np.cumsum(np.append(False, block.kmer[1:] != block.kmer[:-1]))
    right = common(group, block.right)
    backwards = np.concatenate([group.astype(">u4")[:, None], block.left], axis=1).astype(">u4")
    turn = np.argsort(np.ascontiguousarray(backwards).view(f"S{4 * (SIDE + 1)}").ravel(), kind="stable")
    left = common(group[turn], block.left[turn])
    lowest, highest = np.full(n, SIDE + 1), np.full(n, -1)
    open_rows = np.flatnonzero((first & before) | (last & after))
    ahead = np.zeros((SIDE + 1, len(open_rows)), np.uint64)  # hashes of the first words to the right
    for k in range(SIDE if turned and len(open_rows) else 0):
        ahead[k + 1] = mixed(ahead[k] + block.right[open_rows, k].astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    behind = np.zeros(len(open_rows), np.uint64)
    still = np.zeros(n, np.int64)
    for reach in range(SIDE + 1):  # words to the left in the window
        rest = SIDE - reach
        begins = rest if turned else reach
        whole = np.ones(n, bool)
        if rest:
            whole &= block.right[:, rest - 1] != 0
        if reach:
            whole &= block.left[:, reach - 1] != 0
            behind = mixed(behind + block.left[open_rows, reach - 1].astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
        by_right, by_left, paired = np.cumsum(right < rest), np.zeros(n, np.int64), np.zeros(n, bool)
        by_left[turn] = np.cumsum(left < reach)
        paired[turn] = beside(left, reach)
        here = np.flatnonzero(whole & paired & beside(right, rest))
        if len(here):
            order, starts, twice = by_key(by_right[here] * (n + 1) + by_left[here], block.doc[here])
            hit = here[order][np.repeat(twice, np.diff(np.append(starts, len(here))))]
            lowest[hit], highest[hit] = np.minimum(lowest[hit], begins), np.maximum(highest[hit], begins)
        goes_on = whole[open_rows] & (((by_right[open_rows] == by_right[0]) & before) | ((by_right[open_rows] == by_right[-1]) & after)) & (block.still[open_rows] >> begins & 1).astype(bool)
        if not turned and goes_on.any():
            rows = open_rows[goes_on]
            key = by_right[rows] * (n + 1) + by_left[rows]
            order = np.lexsort((block.doc[rows], key))
            new = np.append(True, key[order][1:] != key[order][:-1])
            ends = np.append(new[1:], True)
            firsts, lasts = rows[order[new]], rows[order[ends]]
            twice = np.repeat(block.doc[firsts] != block.doc[lasts], np.diff(np.append(np.flatnonzero(new), len(rows))))
            still[rows[order[~twice | new | ends]]] |= 1 << begins  # of a repeated window two documents stand for it
        elif goes_on.any():
            rows = open_rows[goes_on]
            w = mixed(mixed(ahead[rest][goes_on] + np.uint64(reach)) + behind[goes_on]).view(np.int64)
            order, starts, twice = by_key(by_right[rows] * (n + 1) + by_left[rows], block.doc[rows])
            each = np.repeat(twice, np.diff(np.append(starts, len(rows))))
            for kind, which in ((2, order[starts[twice]]), (1, order[~each])):
                if len(which):
                    start = block.place[rows[which]] - begins
                    yield told(block.doc[rows[which]], start, start + LEAST, kind, block.kmer[rows[which]], w[which])
    hit = np.flatnonzero(highest >= 0)
    if len(hit):
        doc, start, end = merged(block.doc[hit], block.place[hit] - highest[hit], block.place[hit] - lowest[hit] + LEAST)
        none = np.zeros(len(doc), np.int64)
        yield told(doc, start, end, 0, none, none)
    block.still = still
    for left_open in block[still != 0].batches():
        h, doc, place, mask, *sides = left_open.columns
        zero, edge = (pa.array(np.full(len(left_open), x, np.int32)) for x in (0, 3))
        yield pa.RecordBatch.from_arrays([doc, place, zero, edge, h, mask, *sides], TOLD)


def in_blocks(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[Suffixes, bool, bool]]:
    """Blocks of whole k-mers, or of one that is cut; whether the first and the last k-mer may go on before and after."""
    held: list[Suffixes] = []
    before = True
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(Suffixes.of_batch(batch))
        if sum(map(len, held)) < most:
            continue
        block = Suffixes.joined(held)
        cut = int(np.flatnonzero(block.kmer == block.kmer[-1])[0])
        if cut:
            yield block[:cut], before, False
            held, before = [block[cut:]], False
        else:
            yield block, before, True
            held, before = [], True
    if held:
        yield Suffixes.joined(held), before, True


def spans(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """docs: doc_id, text. doc_id, n_words, spans (array of start, end in words, merged and in order) for each row."""
    docs = in_small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = staged(minimisers(docs), "minimisers")
    classes = staged(found.where("class is not null").groupBy("class", "own").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies")), "classes")
    reps = found.join(classes.where("rep is not null"), (found["class"] == classes["class"]) & (found["doc_id"] == classes["rep"])).select("rep", found["own"], F.explode("kmers").alias("h"))
    often = staged(reps.groupBy("h").agg(F.min("own").alias("a"), F.max("own").alias("b")).where("a <> b").select("h"), "often")  # written, so that a k-mer with very many rows isn't tied to the task that counted it
    kept = staged(reps.join(sent_if_small(often), "h").groupBy("rep", "own").agg(F.collect_set("h").alias("kmers")), "kept")
    texts = docs.withColumnRenamed("doc_id", "rep").join(sent_if_small(kept.select("rep").distinct()), "rep", "left_semi").join(kept, "rep")

    def suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for batch in batches:
            for doc, text, kmers in zip(batch.column("own").to_pylist(), batch.column("text"), batch.column("kmers"), strict=True):
                words = SPACE_WORDS.findall(low_bytes(text.as_py()))
                if len(words) < LEAST or part_of(class_of(words)) != doc:  # a doc_id may have other texts too
                    continue
                own = known.of(words)
                hashes = grams(own, KMER)
                at = np.flatnonzero(selected(hashes) & np.isin(hashes.view(np.int64), kmers.values.to_numpy(zero_copy_only=False)))
                for k in range(0, len(at), BLOCK):
                    yield from Suffixes.of_text(own, hashes, at[k : k + BLOCK], doc).batches()

    def in_suffix_order(rows: DataFrame, turned: bool, what: str) -> DataFrame:
        def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part, before, after in in_blocks(batches, block):
                yield from matches(part, before, after, turned)

        ranged = rows.select(SUFFIX).repartitionByRange(partitions(docs.sparkSession), "h", "words_right", "words_left", "doc", "place").sortWithinPartitions("h", "words_right")
        return staged(ranged.mapInArrow(compared, "doc long, start int, end int, edge int, h long, w long, words_right binary, words_left binary"), what)

    rows = texts.select("own", "text", "kmers").mapInArrow(suffixes, "h long, doc long, place int, still long, words_right binary, words_left binary")
    forwards = in_suffix_order(rows, False, "repeats")
    left_open = forwards.where("edge = 3").select("h", "doc", F.col("start").alias("place"), F.col("w").alias("still"), F.col("words_left").alias("words_right"), F.col("words_right").alias("words_left"))
    ordered = forwards.where("edge = 0").unionByName(in_suffix_order(left_open, True, "repeats_turned")).select("doc", "start", "end", "edge", "h", "w")
    inner = ordered.where("edge = 0").select("doc", "start", "end")
    edges = ordered.where("edge > 0")
    over = edges.groupBy("h", "w").agg(F.min("doc").alias("a"), F.max("doc").alias("b"), F.max("edge").alias("most")).where("a <> b or most = 2").select("h", "w")
    border = edges.where("edge = 1").join(over, ["h", "w"]).select("doc", "start", "end")  # a window has the rows of one document for each block at most
    put_together = F.aggregate(
        F.array_sort(F.collect_set(F.struct("start", "end"))),
        F.array().cast("array<struct<start:int,end:int>>"),
        lambda acc, x: F.when((F.size(acc) > 0) & (F.element_at(acc, -1)["end"] >= x["start"]), F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(F.element_at(acc, -1)["start"].alias("start"), F.greatest(F.element_at(acc, -1)["end"], x["end"]).alias("end"))))).otherwise(F.concat(acc, F.array(x))),
    )
    of_rep = inner.unionByName(border).groupBy("doc").agg(put_together.alias("spans"))
    of_class = classes.join(of_rep, F.col("own") == F.col("doc"), "left").select("class", "copies", "spans")
    none = F.array().cast("array<struct<start:int,end:int>>")
    whole = F.array(F.struct(F.lit(0).alias("start"), F.col("n_words").cast("int").alias("end")))
    return found.select("doc_id", "n_words", "class").join(of_class, "class", "left").select("doc_id", "n_words", F.when(F.col("copies") > 1, whole).otherwise(F.coalesce("spans", none)).alias("spans"))


def op9_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = spans(table(spark, sf_dir, "documents"))
    covered = F.aggregate("spans", F.lit(0), lambda acc, x: acc + x["end"] - x["start"]).cast("long")
    return found.select("doc_id", "n_words", covered.alias("n_repeated"), F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string"))), ",").alias("spans"), (F.size("spans") > 0).alias("repeats"))
