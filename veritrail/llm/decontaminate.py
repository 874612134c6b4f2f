"""Benchmark decontamination as a prefix-filtered set join, in DataFrame functions alone.

An item's windows (ten consecutive words, or a shorter item whole) are sets of word shingles. Shingles are ordered by
their frequency over all documents; a window can only occur where its rarest shingle, its necessary prefix, occurs, so
documents are joined on that shingle alone. The shingle's place gives the only place the window could have; length
and positional bounds drop places beyond the document's ends, and what is left is verified word for word. Windows
that stand together round one prefix are verified as one item-sized stretch of places.

A document whose text is null, empty or without words has no hits; an item without words has no windows; equal items
count as often as they occur. A repeated document row gets a row each, and so does one without a doc_id. Texts of any
length are searched whole. Of shingles equally rare the smallest hash is the prefix, and of its places in a window the
first. An empty table of documents gives no rows, an empty benchmark no hits. Other columns play no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from veritrail.llm.common import ASCII_LOWER, ASCII_UPPER, staged, table

WINDOW, SHINGLE = 10, 3
#: Windows of a block of the benchmark; a block's windows and shingles are broadcast, so this bounds what is broadcast.
BLOCK = 200_000
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column | str) -> Column:
    """Words of a text whose A-Z are lower-cased; none for null."""
    low = F.translate(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")), ASCII_UPPER, ASCII_LOWER)
    return F.filter(F.split(low, NOT_WORD), lambda w: w != "")


def shingles(name: str, size: int) -> Column:
    """A hash for each place where size words stand in the array column name."""
    last = F.size(name) - size
    return F.when(last >= 0, F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(F.lit(size), *[F.get(F.col(name), i + k) for k in range(size)]))).otherwise(F.array().cast("array<bigint>"))


def windows(items: DataFrame, size: int = WINDOW) -> DataFrame:
    """(window, item_ids, n, k): the distinct windows, who has them, their words and their shingles' size."""
    split = items.select(F.col("item_id").cast("string").alias("item_id"), words("text").alias("w")).where(F.size("w") > 0)
    places = split.select("item_id", "w", F.explode(F.sequence(F.lit(1), F.greatest(F.size("w") - size + 1, F.lit(1)))).alias("at"))
    return places.groupBy(F.slice("w", F.col("at"), F.lit(size)).alias("window")).agg(F.sort_array(F.collect_set("item_id")).alias("item_ids")).select("*", F.size("window").alias("n"), F.least(F.size("window"), F.lit(SHINGLE)).alias("k"))


def hits(docs: DataFrame, items: DataFrame, size: int = WINDOW) -> DataFrame:
    """docs: row_key, text. One row for each document: row_key, n_words, n_hit, item_ids (array, sorted as strings)."""
    split = docs.select("row_key", words("text").alias("w"))
    found = staged(windows(items, size), "windows")
    bound = found.agg(F.count("*").alias("n"), F.collect_set("k").alias("k")).first()
    base = split.select("row_key", F.size("w").cast("long").alias("n_words"))
    sizes, blocks = sorted(bound["k"]), -(-bound["n"] // BLOCK)
    if not blocks:
        return base.select("*", F.lit(0).cast("long").alias("n_hit"), F.array().cast("array<string>").alias("item_ids"))
    # Shingles of all sizes stand in one array, so that a text is hashed in one pass; the size is part of the hash. The
    # outer forms of explode below: a plain one would have Spark test the hashes' size ahead of it, and hash every text twice.
    hashed = split.select("row_key", "w", (F.concat(*[shingles("w", k) for k in sizes]) if len(sizes) > 1 else shingles("w", sizes[0])).alias("s"))
    own_shingles = F.coalesce(*[F.when(F.col("k") == k, shingles("window", k)) for k in sizes])
    ahead = sum((F.when(F.col("a.k") > k, F.greatest(F.size("w") - k + 1, F.lit(0))).otherwise(0) for k in sizes[:-1]), F.lit(0))  # shingles of smaller sizes stand first
    placed = None
    for block in range(blocks):
        own = found.where(F.pmod(F.xxhash64("window"), F.lit(blocks)) == block).select("window", "item_ids", "n", "k", own_shingles.alias("s"))
        asked = F.broadcast(own.select(F.explode("s").alias("h")).distinct())
        count = hashed.select(F.explode_outer("s").alias("h")).join(asked, "h", "left_semi").groupBy("h").agg(F.count("*").alias("freq"))
        rated = own.select("window", "item_ids", "n", "k", F.posexplode("s").alias("o", "h")).join(F.broadcast(count), "h")
        prefix = rated.groupBy("window", "item_ids", "n", "k").agg(F.min_by(F.struct("h", "o"), F.struct("freq", "h", "o")).alias("p"))
        probe = F.broadcast(staged(prefix.select("window", "item_ids", "n", "k", "p.h", "p.o"), "prefixes").groupBy("h").agg(F.collect_list(F.struct("window", "item_ids", "n", "k", "o")).alias("asks")))
        at = hashed.select("row_key", "w", F.posexplode_outer("s").alias("at", "h"))
        near = at.join(probe, "h").select("row_key", "w", "at", F.explode("asks").alias("a")).withColumn("start", F.col("at") - ahead - F.col("a.o"))
        inside = near.where((F.col("start") >= 0) & (F.col("start") + F.col("a.n") <= F.size("w")))
        held = inside.where(F.slice("w", F.col("start") + 1, F.col("a.n")) == F.col("a.window")).select("row_key", "start", "a.n", "a.item_ids")
        placed = held if placed is None else placed.unionByName(held)
    grown = F.aggregate(
        F.array_sort(F.collect_list(F.struct("start", (F.col("start") + F.col("n")).alias("end")))),
        F.struct(F.lit(0).alias("hit"), F.lit(0).alias("end")),
        lambda acc, x: F.struct((acc["hit"] + F.greatest(x["end"] - F.greatest(x["start"], acc["end"]), F.lit(0))).alias("hit"), F.greatest(acc["end"], x["end"]).alias("end")),
        lambda acc: acc["hit"].cast("long"),
    )
    covered = placed.groupBy("row_key").agg(grown.alias("n_hit"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("item_ids")))).alias("item_ids"))
    return base.join(covered, "row_key", "left").select("row_key", "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"), F.coalesce("item_ids", F.array().cast("array<string>")).alias("item_ids"))


def decontaminate(docs: DataFrame, items: DataFrame, size: int = WINDOW) -> DataFrame:
    """docs: doc_id, text; items: item_id, text. doc_id, n_words, n_hit, item_ids, for each row of docs."""
    keyed = docs.select(F.struct("doc_id", F.xxhash64("text").alias("of")).alias("row_key"), "text")
    return hits(keyed, items, size).select("row_key.doc_id", "n_words", "n_hit", "item_ids")


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


_WORDS = r"""list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"""
OP6_SQL = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
i AS (SELECT CAST(item_id AS VARCHAR) AS item_id, {_WORDS} AS w FROM benchmark),
q AS (SELECT DISTINCT item_id, array_to_string(w[a:a + 9], ' ') AS s, len(w[a:a + 9]) AS n FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS a FROM i WHERE len(w) > 0)),
n AS (SELECT DISTINCT n FROM q),
g AS (SELECT doc_id, a, n, array_to_string(w[a:a + n - 1], ' ') AS s FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS a FROM d, n)),
m AS (SELECT g.doc_id, g.a, g.n, q.item_id FROM g JOIN q ON g.s = q.s AND g.n = q.n),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(a, a + n)) AS p FROM m) GROUP BY doc_id),
t AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id, ',' ORDER BY item_id) AS ids FROM m GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)
"""
