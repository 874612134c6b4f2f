"""MinHash near-duplicates, with odd sketches ahead of the exact check.

1. Every document's set of five-word shingles is hashed; equal sets are one class, and only classes go on.
2. A class's MinHash samples are cut into bands; classes that share a band meet at the band's smallest class, its
   leader. The same samples, folded into a parity bitmap, are the class's odd sketch.
3. All who meet at a leader are one group. A group is dealt out in blocks, the leader in every one of them, and a
   block's members are compared: sizes bound the overlap, the odd sketches' XOR population count estimates it, and full
   sets confirm it. Only links that join something new leave the task, so their number follows the members'.
4. A group of one block is settled by that. Members of larger groups that are not all joined by now meet again in
   smaller company, by the rule that two sets so similar share one of their rarest shingles (a prefix of each set, the
   group's members' shingles ordered by how many of them have each). Where still more than a block meet, those outside
   the largest set of already joined ones are held, block by block, against all others there. Rows follow the
   members' number but for texts below the threshold that agree even on their rarest shingles.
5. Components over the links give every document the smallest doc_id it reaches.

Two sets at a similarity of 0.85 share no band with probability (1 - 0.85^5)^25, under one in a million. The sketch
estimate drops a pair only at SLACK below the threshold, over five standard errors.

Texts that are null, empty or without words have an empty set and stay alone, each the component of its own doc_id;
rows repeated with one doc_id are one document, with all their texts' links. A null doc_id has no component unless
others link to it. Texts may be of any length: a set is held whole by one task, never cut. Equal sets are linked
whatever else they share; at exactly the threshold a pair is linked. An empty table gives no rows. Other columns, and
what they are called, play no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from veritrail.llm.common import SPACE_WORDS, components, in_small_batches, low_bytes, partitions, runs, sent_if_small, staged, table
from veritrail.llm.hashing import WordHashes, grams, minima, mixed

SHINGLE = 5
BANDS, ROWS = 25, 5
SKETCH_BITS = 512
#: Members that are compared in one task, and those that a block of them is held against.
BLOCK, TOLD = 256, 512
#: Members from which on a shingle is no key of a join.
HOT = 256
ASKS, LEADS, MEETS, HEARS = range(4)
SLACK = 0.2
_random = np.random.Generator(np.random.PCG64(20240607))
TIMES = _random.integers(0, 2**63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
PLUS = _random.integers(0, 2**63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2)
SIGNED = "doc_id long, n_shingles long, class binary, bands array<long>, sketch binary"
_schema = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("class", pa.binary()), ("bands", pa.list_(pa.int64())), ("sketch", pa.binary())])


def shingle_set(text: str | None, known: WordHashes, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct shingle hashes of the whole text; a text of fewer words is one shingle."""
    hashes = known.of(SPACE_WORDS.findall(low_bytes(text)))
    return np.unique(grams(hashes, size if len(hashes) >= size else max(1, len(hashes))))


def odd_sketch(samples: np.ndarray, bits: int = SKETCH_BITS) -> bytes:
    """A bitmap of parities: each sample, with its number, flips one bit."""
    at = mixed(samples ^ mixed(np.arange(1, len(samples) + 1, dtype=np.uint64))) % np.uint64(bits)
    return np.packbits(np.bincount(at.astype(np.int64), minlength=bits) & 1).astype(np.uint8).tobytes()


def estimated(ones: np.ndarray, samples: int = BANDS * ROWS, bits: int = SKETCH_BITS) -> np.ndarray:
    """Similarity from the number of ones in two sketches' XOR."""
    differ = -bits / 2 * np.log(np.maximum(1 - 2 * ones / bits, 1e-9))
    return 1 - differ / (2 * samples)


def signatures(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """docs: doc_id, text. SIGNED for each row; class, bands and sketch are null for an empty set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for batch in batches:
            out: list[tuple] = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                own = shingle_set(text.as_py(), known, size)
                if not len(own):
                    out.append((doc, 0, None, None, None))
                    continue
                low = minima(own, TIMES, PLUS)
                parts = low.reshape(BANDS, ROWS)
                bands = np.fromiter((xxhash.xxh64_intdigest(x.tobytes(), i) for i, x in enumerate(parts)), np.uint64, BANDS)
                out.append((doc, len(own), xxhash.xxh128_digest(own.tobytes()), bands.view(np.int64).tolist(), odd_sketch(low)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out, strict=True), _schema, strict=True)], schema=_schema)

    return in_small_batches(docs).select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, SIGNED)


def joined(sets: list[np.ndarray], sketches: np.ndarray, labels: list[int], percent: int, asking: int | None = None) -> list[tuple[int, int]]:
    """Links among the members: a spanning set of all that hold, found without comparing those already joined, as equal labels are. asking: so many of the first are held against the rest, and nothing else; all against all if it is None."""
    numbers: dict[int, int] = {}
    parent = [numbers.setdefault(x, k) for k, x in enumerate(labels)]

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    sizes, links = np.array([len(x) for x in sets]), []
    roots = np.array(parent)
    for i in range(len(sets) - 1 if asking is None else asking):
        rest = np.arange(i + 1 if asking is None else asking, len(sets))
        rest = rest[(roots[rest] != roots[i]) & (100 * np.minimum(sizes[i], sizes[rest]) >= percent * np.maximum(sizes[i], sizes[rest]))]
        if len(rest):
            ones = np.bitwise_count(sketches[rest] ^ sketches[i]).sum(axis=1)
            rest = rest[estimated(ones) >= percent / 100 - SLACK]
        found = len(links)
        for j in rest:
            if root(i) != root(j):
                same = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                if 100 * same >= percent * (sizes[i] + sizes[j] - same):
                    parent[root(j)] = root(i)
                    links.append((i, int(j)))
        if len(links) > found:
            roots = np.array([root(x) for x in range(len(sets))])
    return links


def compared(members: DataFrame, keys: list[str], percent: int) -> DataFrame:
    """members: keys, role, rep, label, sketch, shingles; those of equal keys are compared in one task: all with all in order of role, or those that ask with those that hear. (a, b) by rep."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out: list[tuple[int, int]] = []
        for group in runs(batches, keys):
            group = group.drop_duplicates(["role", "rep", "shingles"])
            ids, role = group["rep"].tolist(), group["role"].to_numpy()
            sketches = np.frombuffer(b"".join(group["sketch"]), np.uint64).reshape(len(ids), -1)
            asking = int((role == ASKS).sum()) if role[0] == ASKS or role[-1] == HEARS else None
            out += [(ids[a], ids[b]) for a, b in joined([np.frombuffer(x, np.uint64) for x in group["shingles"]], sketches, group["label"].tolist(), percent, asking)]
            if len(out) > 10_000:
                yield pd.DataFrame(out, columns=["a", "b"])
                out = []
        yield pd.DataFrame(out, columns=["a", "b"]).astype("int64")

    dealt = members.select(*keys, "role", "rep", "label", "sketch", "shingles")
    return dealt.repartition(partitions(members.sparkSession), *keys).sortWithinPartitions(*keys, "role").mapInPandas(run, "a long, b long")


def blocks_of(n: Column, size: int) -> Column:
    return F.ceil(n / size).cast("int")


def in_blocks(met: DataFrame, full: DataFrame) -> DataFrame:
    """Every group's members dealt out in blocks, with the leader in each of them, for compared()."""
    sizes = met.groupBy("leader").agg(blocks_of(F.count("*") + 1, BLOCK).alias("blocks"))
    own = met.join(sizes, "leader").select("leader", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int").alias("block"), "rep")
    heads = sizes.select("leader", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.col("leader").alias("rep"))
    return own.unionByName(heads).join(full, "rep").withColumn("label", F.col("rep")).withColumn("role", F.when(F.col("rep") == F.col("leader"), LEADS).otherwise(MEETS))


def rarest(members: DataFrame, percent: int) -> DataFrame:
    """members: rep, label, shingles. (rep, label, h, first): the rarest shingles of each, as many as it must share one of with any set this similar; first: of these the ones that it must share one of with any as large or larger."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rep, label, own, held in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                h = np.frombuffer(held, np.int64)
                for at in range(0, len(h), 50_000):
                    part = h[at : at + 50_000]
                    yield pa.RecordBatch.from_arrays([*(pa.array(np.full(len(part), x, np.int64)) for x in (rep, label, own, len(h))), pa.array(part)], ["rep", "label", "own", "n", "h"])

    each = staged(members.select("rep", "label", F.xxhash64("shingles").alias("own"), "shingles").mapInArrow(run, "rep long, label long, own long, n long, h long"), "shingles")
    often = staged(each.groupBy("h").agg(F.count("*").alias("often")), "often")
    # Shingles of very many members would be one key: there are few of them, so they are sent to the rows instead.
    hot = sent_if_small(often.where(F.col("often") > HOT).withColumnRenamed("often", "hot"))
    marked = each.join(hot, "h", "left")
    counted = marked.where("hot is not null").withColumnRenamed("hot", "often").unionByName(marked.where("hot is null").drop("hot").join(often.where(F.col("often") <= HOT), "h"))
    ranked = counted.groupBy("rep", "label", "own", "n").agg(F.array_sort(F.collect_set(F.struct("often", "h"))).alias("of"))
    prefix, shorter = (F.col("n") - F.ceil(F.col("n") * a / b) + 1 for a, b in ((percent, 100), (2 * percent, 100 + percent)))
    return ranked.select("rep", "label", shorter.alias("few"), F.posexplode(F.slice("of", F.lit(1), prefix.cast("int"))).alias("at", "x")).select("rep", "label", "x.h", (F.col("at") < F.col("few")).alias("first"))


def unsettled(met: DataFrame, labels: DataFrame, full: DataFrame, percent: int) -> DataFrame | None:
    """Links between members of groups of several blocks that are not all joined yet; labels: node, component. None if there are no such groups."""
    label = F.coalesce("component", "rep").alias("label")
    large = met.groupBy("leader").agg(F.count("*").alias("n")).where(F.col("n") >= BLOCK).select("leader")
    everyone = met.unionByName(met.select("leader", F.col("leader").alias("rep")).distinct()).join(large, "leader", "left_semi")
    told = staged(everyone.join(labels, F.col("rep") == F.col("node"), "left").select("leader", "rep", label), "large")
    open_ = told.groupBy("leader").agg(F.min("label").alias("a"), F.max("label").alias("b")).where("a <> b").select("leader")
    members = staged(told.join(open_, "leader", "left_semi").select("rep", "label").distinct(), "open")
    if members.isEmpty():
        return None
    sets = members.join(full, "rep")
    keyed = staged(rarest(sets, percent), "rarest")
    shared = staged(keyed.groupBy("h").agg(F.min("rep").alias("leader"), F.min("label").alias("x"), F.max("label").alias("y"), F.max("first").alias("any")).where("x <> y and any").select("h", "leader"), "shared")
    again = staged(keyed.join(sent_if_small(shared), "h").groupBy("leader", "rep", "label").agg(F.max("first").alias("first")), "again")
    sizes = again.groupBy("leader", "label").agg(F.count("*").alias("n")).groupBy("leader").agg(F.sum("n").alias("n"), F.max_by("label", F.struct("n", "label")).alias("most"))
    placed = again.join(sizes, "leader")
    few = placed.where(F.col("n") <= BLOCK).select("leader", F.lit(0).alias("kind"), F.lit(0).alias("i"), F.lit(0).alias("j"), F.lit(MEETS).alias("role"), "rep", "label")
    # One of a pair has the shingle among its first, and one is outside the largest set of joined ones: 1, the same one is both; 2, it takes one each.
    outside = F.col("label") != F.col("most")
    many = placed.where(F.col("n") > BLOCK).select("leader", "rep", "label", F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), asks.alias("asks"), hears.alias("hears")) for k, asks, hears in ((1, outside & F.col("first"), F.lit(True)), (2, outside & ~F.col("first"), ~outside & F.col("first")))])).alias("k")).select("leader", "rep", "label", "k.*")
    counts = many.groupBy("leader", "kind").agg(blocks_of(F.count_if("asks"), BLOCK).alias("asking"), blocks_of(F.count_if("hears"), TOLD).alias("telling")).where("asking > 0 and telling > 0")
    dealt = many.join(counts, ["leader", "kind"])
    spread = lambda blocks: F.explode(F.sequence(F.lit(0), F.col(blocks) - 1))
    own = lambda blocks: F.pmod(F.xxhash64("rep"), F.col(blocks)).cast("int")
    asks = dealt.where("asks").select("leader", "kind", own("asking").alias("i"), spread("telling").alias("j"), F.lit(ASKS).alias("role"), "rep", "label")
    tells = dealt.where("hears").select("leader", "kind", spread("asking").alias("i"), own("telling").alias("j"), F.lit(HEARS).alias("role"), "rep", "label")
    return compared(few.unionByName(asks).unionByName(tells).join(full, "rep"), ["leader", "kind", "i", "j"], percent)


def near_duplicates(docs: DataFrame, percent: int = 85, size: int = SHINGLE) -> DataFrame:
    """docs: doc_id, text. doc_id, n_shingles, component_id, kept for each row: documents are linked where 100 * intersection >= percent * union."""
    spark = docs.sparkSession
    signed = staged(signatures(docs, size), "signatures")
    classes = staged(signed.where("class is not null").groupBy("class").agg(F.min("doc_id").alias("rep"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch")), "classes")
    bands = classes.where("rep is not null").select("rep", F.explode("bands").alias("band"))
    leaders = bands.groupBy("band").agg(F.min("rep").alias("leader"), F.count("*").alias("n")).where("n > 1").drop("n")
    met = staged(bands.join(leaders, "band").where("rep <> leader").groupBy("leader", "rep").count().drop("count"), "met")
    involved = sent_if_small(staged(met.select("rep").union(met.select("leader")).distinct(), "involved"))
    whole = docs.select(F.col("doc_id").cast("long").alias("rep"), F.col("text").cast("string").alias("text"))

    def sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = WordHashes()
        for batch in batches:
            own = [shingle_set(x, known, size).tobytes() for x in batch["text"]]
            same = [xxhash.xxh128_digest(x) == y for x, y in zip(own, batch["class"], strict=True)]  # a doc_id may have other texts too
            yield batch.assign(shingles=own)[["rep", "sketch", "shingles"]][same]

    held = whole.join(involved, "rep", "left_semi").join(classes.select("rep", "class", "sketch"), "rep")
    full = staged(held.mapInPandas(sets, "rep long, sketch binary, shingles binary"), "sets")
    found = components(compared(in_blocks(met, full), ["leader", "block"], percent))
    more = unsettled(met, found, full, percent)
    if more is not None:
        label = lambda x: found.select(F.col("node").alias(x), F.col("component").alias(f"{x}_label"))
        between = more.join(label("a"), "a", "left").join(label("b"), "b", "left").select(F.coalesce("a_label", "a").alias("a"), F.coalesce("b_label", "b").alias("b"))
        above = components(between).select(F.col("node").alias("under"), F.col("component").alias("above"))
        alone = above.join(found, F.col("under") == F.col("node"), "left_anti").select(F.col("under").alias("node"), F.col("under").alias("component"))
        found = found.unionByName(alone).join(above, F.col("component") == F.col("under"), "left").select("node", F.coalesce("above", "component").alias("component"))
    of_class = classes.select("class", "rep").join(found, F.col("rep") == F.col("node"), "left").select("class", F.coalesce("component", "rep").alias("component"))
    return (
        signed.select("doc_id", "n_shingles", "class")
        .join(of_class, "class", "left")
        .select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
        .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull()))
    )


def op4_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
