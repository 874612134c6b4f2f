"""Hard negatives by inner product: for each anchor and each of its positives, the best rows of other labels whose score
lies in a window below the positive's.

The rows are packed into a tree of three levels by sort-tile-recursion: ranges of two coordinates make tiles, at most
about TILE rows each, and in a tile ranges of its widest coordinates make leaves of LEAF rows. A node holds the least and
the greatest value of every coordinate, and so an interval of the inner products that its rows can have with an anchor,
and its smallest id. Each anchor goes through a tile's leaves from the highest upper bound down, and stops where all that
is left lies outside its score windows or strictly below the last row that it would keep (at equal scores: behind it by
id). Anchors go through the leaves in step, so that one product of matrices serves all that stand at one leaf.

First every tile serves its own anchors, which gives them a first bound; then anchors, in blocks, meet the other tiles
that their bounds leave. Anchors are a stated query set against all rows: work is at most anchors by rows, and in many
coordinates without clusters the boxes leave out little. A tile is one row of bytes, and so is a block; what is
shuffled is a tile for each block that meets it. Rows that no coordinate tells apart, as copies of one vector, are dealt
out over tiles by their ids.

Rows with a null id or label, a null vector, or any null or non-finite component take no part. Of rows that share an id
one takes part, that of the smallest label and components. A shorter vector has zeros where others go on. Scores are
exact: where products could exceed what a double holds, integers of any size are used, and a score must fit a long. Of
equal scores the smaller id comes first. An anchor without positives, or a positive without negatives, has no rows; an
empty table has none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from veritrail.llm.common import partitions, staged, table

TILE, LEAF, BLOCK = 4096, 64, 2048
#: Positives of an anchor and negatives of a positive; the window, in hundredths of the positive's score.
POSITIVES, NEGATIVES, LOW, HIGH = 5, 3, 50, 95
LEAST = np.iinfo(np.int64).min
LEAST, MOST = np.iinfo(np.int64).min, np.iinfo(np.int64).max
TILES = "tile int, n int, width int, ids binary, labels binary, values binary, box_low array<double>, box_high array<double>"
BLOCKS = "block int, width int, slots int, least long, greatest long, ids binary, labels binary, values binary, low binary, high binary, last binary, last_id binary, box_low array<double>, box_high array<double>"
FOUND = "anchor long, slot int, id long, score long"
#: Packed rows that a Python worker gets at once; each has some MB.
AT_ONCE = 4


def vectors(rows: DataFrame) -> DataFrame:
    """rows: vec_id, label, embedding. (id, label, x) of those that take part, components as whole 256ths."""
    x = F.transform("embedding", lambda v: F.floor(F.lit(256.0) * v.cast("double")))
    good = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull() & F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    own = rows.where(F.coalesce(good, F.lit(False))).select(F.col("vec_id").cast("long").alias("id"), F.struct(F.col("label").cast("long").alias("label"), x.cast("array<long>").alias("x")).alias("row"))
    return own.groupBy("id").agg(F.min("row").alias("row")).select("id", "row.label", "row.x")


def tiled(rows: DataFrame) -> DataFrame:
    """(id, label, x, tile), the ranges of two coordinates and what deals out a tile that is still too large. rows are written already."""
    n = rows.count()
    slabs = max(1, round((n / TILE) ** 0.5))
    at = lambda k: F.coalesce(F.get("x", F.lit(k)), F.lit(0))
    share = [k / slabs for k in range(1, slabs)]
    range_of = lambda x, cuts: F.size(F.filter(cuts, lambda c: c < x))
    if share:
        first = rows.select(F.percentile_approx(at(0), share, 10_000)).head()[0]
        rows = rows.withColumn("slab", range_of(at(0), F.array(*map(F.lit, first))))
        cuts = rows.groupBy("slab").agg(F.percentile_approx(at(1), share, 10_000).alias("cuts"))
        rows = rows.join(F.broadcast(cuts), "slab").withColumn("cell", F.col("slab") * slabs + range_of(at(1), F.col("cuts"))).drop("slab", "cuts")  # as many rows as slabs
    else:
        rows = rows.withColumn("cell", F.lit(0))
    sizes = sorted((x["cell"], x["n"]) for x in rows.groupBy("cell").agg(F.count("*").alias("n")).collect())  # a row for each cell, one for TILE rows
    parts, first = {}, 0
    for cell, size in sizes:
        parts[cell] = (first, -(-size // TILE))
        first += parts[cell][1]
    if not parts:
        return rows.withColumn("tile", F.lit(0)).drop("cell")
    deal = rows.sparkSession.createDataFrame([(c, a, b) for c, (a, b) in parts.items()], "cell int, first int, parts int")
    return rows.join(F.broadcast(deal), "cell").select("id", "label", "x", (F.col("first") + F.pmod(F.xxhash64("id"), F.col("parts").cast("long"))).cast("int").alias("tile"))


def grid(rows: pd.Series, width: int | None = None, fill: int = 0) -> np.ndarray:
    """Lists as rows of one table, filled up at their ends."""
    width = max(map(len, rows), default=0) if width is None else width
    out = np.full((len(rows), width), fill, np.int64)
    for k, x in enumerate(rows):
        out[k, : len(x)] = x
    return out


def leaf_order(values: np.ndarray, rows: np.ndarray) -> list[np.ndarray]:
    """Sort-tile-recursion: rows in two halves of whole leaves by their widest coordinate, and so on to leaves."""
    if len(rows) <= LEAF or not values.shape[1]:
        return [rows]
    here = values[rows]
    k, half = int((here.max(axis=0) - here.min(axis=0)).argmax()), -(-len(rows) // LEAF) // 2 * LEAF
    rows = rows[np.argsort(here[:, k], kind="stable")]
    return [*leaf_order(values, rows[:half]), *leaf_order(values, rows[half:])]


def packed_tile(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    """A tile as one row, its rows in the order of leaves and of equal coordinates by id."""
    rows = rows.sort_values("id")
    values = grid(rows["x"])
    order = np.concatenate(leaf_order(values, np.arange(len(rows))))
    values, ids, labels = values[order], rows["id"].to_numpy(np.int64)[order], rows["label"].to_numpy(np.int64)[order]
    one = (key[0], len(rows), values.shape[1], ids.tobytes(), labels.tobytes(), values.tobytes(), values.min(axis=0).astype(float).tolist(), values.max(axis=0).astype(float).tolist())
    return pd.DataFrame([one], columns=[x.split()[0] for x in TILES.split(", ")])


def packed_block(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    """A block of anchors as one row. Windows that an anchor has fewer of than others hold nothing."""
    rows = rows.sort_values("anchor")
    values, low = grid(rows["x"]), grid(rows["low"], fill=1)
    high, last, last_id = grid(rows["high"], low.shape[1]), grid(rows["last"], low.shape[1], LEAST), grid(rows["last_id"], low.shape[1], MOST)
    real = low <= high
    least = int(np.maximum(low, last)[real].min(initial=MOST))
    one = (key[0], values.shape[1], low.shape[1], least, int(high[real].max(initial=LEAST)), *(rows[c].to_numpy(np.int64).tobytes() for c in ("anchor", "label")), *(x.tobytes() for x in (values, low, high, last, last_id)), values.min(axis=0).astype(float).tolist(), values.max(axis=0).astype(float).tolist())
    return pd.DataFrame([one], columns=[x.split()[0] for x in BLOCKS.split(", ")])


class Tile:
    def __init__(self, ids: bytes, labels: bytes, values: bytes, width: int) -> None:
        self.ids, self.labels = np.frombuffer(ids, np.int64), np.frombuffer(labels, np.int64)
        self.values = np.frombuffer(values, np.int64).reshape(len(self.ids), width)
        self.leaves = [slice(a, a + LEAF) for a in range(0, len(self.ids), LEAF)]
        self.low, self.high = (np.stack([f(self.values[x], axis=0) for x in self.leaves]).astype(np.float64) for f in (np.min, np.max))
        self.first = np.array([self.ids[x].min() for x in self.leaves])


class Search:
    """Anchors, each with windows of scores (columns of low, high, last and last_id), and the best rows found for them. What comes behind last, or at that score behind last_id, is left out. same: whether rows must have the anchor's label or another one."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, values: np.ndarray, low: np.ndarray, high: np.ndarray, last: np.ndarray, last_id: np.ndarray, same: bool, keep: int) -> None:
        self.ids, self.labels, self.values, self.low, self.high, self.same, self.keep = ids, labels, values, low, high, same, keep
        self.last, self.last_id = last.copy(), last_id.copy()
        self.scores, self.found = np.full((*low.shape, keep), LEAST), np.full((*low.shape, keep), -1)

    def visit(self, tile: Tile) -> None:
        """All of a tile's rows that belong to the best, leaf by leaf from each anchor's highest upper bound down."""
        width = max(self.values.shape[1], tile.values.shape[1])
        wide = lambda x: np.pad(x, ((0, 0), (0, width - x.shape[1])))
        mine, theirs = wide(self.values), wide(tile.values)
        most = float(np.abs(mine.astype(float)).max(initial=0)) * float(np.abs(theirs.astype(float)).max(initial=0)) * max(width, 1)
        kind = np.float64 if most < 2.0**53 else object
        up, down = np.maximum(mine, 0).astype(float), np.minimum(mine, 0).astype(float)
        low, high = wide(tile.low), wide(tile.high)
        slack = 0.0 if kind is np.float64 else most * 1e-14
        upper, lower = up @ high.T + down @ low.T + slack, up @ low.T + down @ high.T - slack
        mine, theirs = mine.astype(kind), theirs.astype(kind)
        queue, alive = np.argsort(-upper, axis=1, kind="stable"), np.arange(len(self.ids))
        for step in range(len(tile.leaves)):
            at = queue[alive, step]
            top = upper[alive, at][:, None]
            goes_on = ((top >= self.low[alive]) & (top >= self.last[alive])).any(axis=1)  # else nothing that is left in the queue has room
            alive, at, top = alive[goes_on], at[goes_on], top[goes_on]
            if not len(alive):
                return
            last = self.last[alive]
            ahead = (top > last) | (top == last) & (tile.first[at][:, None] <= self.last_id[alive])
            wanted = ((top >= self.low[alive]) & (lower[alive, at][:, None] <= self.high[alive]) & ahead).any(axis=1)
            who, at = alive[wanted], at[wanted]
            order = np.argsort(at, kind="stable")
            for part in np.split(order, np.flatnonzero(np.diff(at[order])) + 1):
                if len(part):
                    rows = tile.leaves[at[part[0]]]
                    scores = mine[who[part]] @ theirs[rows].T
                    scores = scores if kind is np.float64 else np.clip(scores, LEAST + 1, MOST)
                    self.merge(who[part], scores.astype(np.int64), tile.ids[rows], tile.labels[rows])

    def merge(self, who: np.ndarray, scores: np.ndarray, ids: np.ndarray, labels: np.ndarray) -> None:
        fits = ((labels[None] == self.labels[who][:, None]) == self.same) & (ids[None] != self.ids[who][:, None])
        for k in range(self.low.shape[1]):
            last = self.last[who, k][:, None]
            good = fits & (scores >= self.low[who, k][:, None]) & (scores <= self.high[who, k][:, None]) & ((scores > last) | (scores == last) & (ids[None] <= self.last_id[who, k][:, None]))
            hit = np.flatnonzero(good.any(axis=1))
            if len(hit):
                to = who[hit]
                both = np.concatenate((self.scores[to, k], np.where(good[hit], scores[hit], LEAST)), axis=1)
                names = np.concatenate((self.found[to, k], np.broadcast_to(ids, (len(hit), len(ids)))), axis=1)
                best = np.lexsort((names, -np.maximum(both, LEAST + 1)), axis=1)[:, : self.keep]
                both, names = np.take_along_axis(both, best, 1), np.take_along_axis(names, best, 1)
                self.scores[to, k], self.found[to, k] = both, names
                full = both[:, -1] > LEAST
                self.last[to[full], k], self.last_id[to[full], k] = both[full, -1], names[full, -1]

    def rows(self) -> pd.DataFrame:
        who, slot, place = np.nonzero(self.scores > LEAST)
        return pd.DataFrame({"anchor": self.ids[who], "slot": slot.astype(np.int32), "id": self.found[who, slot, place], "score": self.scores[who, slot, place]})


def _searched(pairs: DataFrame, same: bool, keep: int, what: str) -> DataFrame:
    """FOUND rows of pairs of a packed block and a packed tile, whose columns begin with t_."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for row in (x for batch in batches for x in batch.itertuples(index=False)):
            ids, labels = np.frombuffer(row.ids, np.int64), np.frombuffer(row.labels, np.int64)
            values = np.frombuffer(row.values, np.int64).reshape(len(ids), row.width)
            of = Search(ids, labels, values, *(np.frombuffer(x, np.int64).reshape(len(ids), row.slots) for x in (row.low, row.high, row.last, row.last_id)), same, keep)
            of.visit(Tile(row.t_ids, row.t_labels, row.t_values, row.t_width))
            yield of.rows()

    conf, key = pairs.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    was = conf.get(key)
    conf.set(key, AT_ONCE)
    try:
        return staged(pairs.repartition(4 * partitions(pairs.sparkSession), "block", "tile").mapInPandas(run, FOUND), what)
    finally:
        conf.set(key, was)


def best(tiles: DataFrame, asking: DataFrame, same: bool, keep: int) -> DataFrame:
    """FOUND rows and rank: for each anchor and window the first keep rows of all tiles. asking, written already: anchor, label, x, tile (its own), block, low and high, lists of windows."""
    spark = tiles.sparkSession
    theirs = tiles.select("tile", *(F.col(c).alias(f"t_{c}") for c in ("width", "ids", "labels", "values")))
    open_end = lambda v: F.transform("low", lambda _: F.lit(v).cast("long"))
    free = asking.withColumns({"last": open_end(LEAST), "last_id": open_end(MOST)})
    at_home = free.select("anchor", "label", "x", "low", "high", "last", "last_id", "tile").groupBy("tile").applyInPandas(packed_block, BLOCKS)
    first = _searched(at_home.withColumn("tile", F.col("block")).join(theirs, "tile"), same, keep, "own-tiles")
    # the last of keep rows found at home: what comes behind it can't be among the best
    ends = first.groupBy("anchor", "slot").agg(F.count("*").alias("n"), F.min(F.struct("score", (-F.col("id")).alias("less"))).alias("end")).where(F.col("n") == keep)
    ends = ends.groupBy("anchor").agg(F.map_from_entries(F.collect_list(F.struct("slot", "end"))).alias("ends"))
    known = lambda field, none, sign: F.transform("low", lambda _, k: F.coalesce(sign * F.get(F.array(F.try_element_at("ends", k.cast("int"))), F.lit(0))[field], F.lit(none).cast("long")))
    bounded = free.drop("last", "last_id").join(ends, "anchor", "left").withColumns({"last": known("score", LEAST, 1), "last_id": known("less", MOST, -1)})
    blocks = staged(bounded.select("anchor", "label", "x", "low", "high", "last", "last_id", "block").groupBy("block").applyInPandas(packed_block, BLOCKS), "blocks")
    n = tiles.count()
    boxes = tiles.select("tile", F.col("box_low").alias("t_low"), F.col("box_high").alias("t_high"))
    met = blocks.where("least <= greatest").select("block", "least", "greatest", "box_low", "box_high", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("tile")).join(boxes, "tile")
    zero = F.lit(0.0)
    corner = lambda a, b: F.coalesce(a, zero) * F.coalesce(b, zero)
    corners = F.transform(F.arrays_zip("box_low", "box_high", "t_low", "t_high"), lambda x: F.array(*(corner(x[p], x[q]) for p in ("box_low", "box_high") for q in ("t_low", "t_high"))))
    total = lambda of: F.aggregate(corners, zero, lambda s, x: s + of(x))
    met = met.select("block", "tile", "least", "greatest", total(F.array_max).alias("upper"), total(F.array_min).alias("lower"))
    met = met.where(F.expr("upper + abs(upper) * 1e-12 + 1 >= least and lower - abs(lower) * 1e-12 - 1 <= greatest")).select("block", "tile")
    found = _searched(met.join(blocks, "block").join(theirs, "tile"), same, keep, "all-tiles")
    return found.withColumn("rank", F.expr("row_number() over (partition by anchor, slot order by score desc, id)")).where(F.col("rank") <= keep)


def hard_negatives(rows: DataFrame, every: int = 50, positives: int = POSITIVES, negatives: int = NEGATIVES) -> DataFrame:
    """rows: vec_id, label, embedding. Rows (anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for the anchors, whose ids every divides."""
    dealt = staged(tiled(staged(vectors(rows), "vectors")), "tiled")
    tiles = staged(dealt.groupBy("tile").applyInPandas(packed_tile, TILES), "tiles")
    anchors = dealt.where(F.col("id") % every == 0).select(F.col("id").alias("anchor"), "label", "x", "tile")
    # blocks of whole runs of tiles, or of a part of one tile's anchors
    deal, block, size = [], -1, BLOCK
    for tile, n in sorted((x["tile"], x["n"]) for x in anchors.groupBy("tile").agg(F.count("*").alias("n")).collect()):  # a row for each tile
        if size + n > BLOCK:
            block, size = block + 1, 0
        parts = -(-n // BLOCK)
        deal.append((tile, block, parts))
        block, size = block + parts - 1, size + n
    blocks = rows.sparkSession.createDataFrame(deal, "tile int, first int, parts int")
    anchors = anchors.join(F.broadcast(blocks), "tile").select("anchor", "label", "x", "tile", (F.col("first") + F.pmod(F.xxhash64("anchor"), F.col("parts").cast("long"))).cast("int").alias("block"))
    anchors = staged(anchors, "anchors")
    whole = lambda v: F.array(F.lit(v).cast("long"))
    near = staged(best(tiles, anchors.withColumns({"low": whole(LEAST + 1), "high": whole(MOST)}), True, positives), "positives")
    # LOW * score <= 100 * negative <= HIGH * score, in whole numbers that don't run over
    low = F.expr(f"if(score < 0, 1, (score div 100) * {LOW} + ((score % 100) * {LOW} + 99) div 100)")
    high = F.expr(f"if(score < 0, 0, (score div 100) * {HIGH} + ((score % 100) * {HIGH}) div 100)")
    sides = near.groupBy("anchor").agg(F.array_sort(F.collect_list(F.struct("rank", low.alias("low"), high.alias("high")))).alias("w"))
    asking = staged(anchors.join(sides, "anchor").select("anchor", "label", "x", "tile", "block", F.col("w.low").alias("low"), F.col("w.high").alias("high")), "windows")
    far = best(tiles, asking, False, negatives).select("anchor", "slot", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    pairs = near.select("anchor", (F.col("rank") - 1).alias("slot"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    return pairs.join(far, ["anchor", "slot"]).select(F.col("anchor").alias("anchor_id"), "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return hard_negatives(rows.select("vec_id", F.expr("if(vec_id % 7 = 0, (label + 1) % 10, label)").alias("label"), "embedding"))


#: The same rows in SQL, every anchor against every row.
OP13_SQL = """
with good as (
  select vec_id as id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, list_transform(embedding, lambda v: floor(256 * v::double)) as x
  from embeddings
  where vec_id is not null and label is not null and embedding is not null and len(list_filter(embedding, lambda v: v is null or not isfinite(v))) = 0),
scored as (
  select a.id as anchor_id, b.id, a.label = b.label as same, list_inner_product(a.x, b.x)::bigint as score
  from good a join good b on a.id % 50 = 0 and a.id <> b.id),
positives as (
  select anchor_id, id as positive_id, score as positive_score from scored where same
  qualify row_number() over (partition by anchor_id order by score desc, id) <= 5)
select p.anchor_id, p.positive_id, row_number() over (partition by p.anchor_id, p.positive_id order by s.score desc, s.id)::int as rank, s.id as negative_id, p.positive_score, s.score as negative_score
from positives p join scored s on s.anchor_id = p.anchor_id and not s.same and 50 * p.positive_score <= 100 * s.score and 100 * s.score <= 95 * p.positive_score
qualify row_number() over (partition by p.anchor_id, p.positive_id order by s.score desc, s.id) <= 3
"""
