"""Reports into typed blocks: headings, lists, tables and paragraphs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from veritrail.functions.text import LINE_BREAK, normalize_invisibles, trimmed

NUMBERED = r"(?U)^\d+\.\s+\S"
ITEM = r"(?U)(?i)^[o•-]\s+"


def segment_blocks(reports: DataFrame) -> DataFrame:
    """reports: case_id, text (one report a case). case_id, block_id from 1, kind (h2, h3, list, table, paragraph), rows (a list's items, a table's lines with trimmed cells, else one text), text (the rows by line). A line opens a block by its look; a table goes on while lines have tabs, a paragraph until a blank line whatever its lines look like. Null and blank reports have no blocks."""
    lines = F.split(trimmed(normalize_invisibles(F.coalesce("text", F.lit("")))), LINE_BREAK)
    each = reports.select("case_id", F.posexplode(lines).alias("at", "raw")).withColumn("raw", F.regexp_replace("raw", r"(?U)\s+$", "")).withColumn("line", trimmed(F.col("raw")))
    line, tabbed = F.col("line"), F.contains("raw", F.lit("\t"))
    bracketed = line.startswith("[") & line.endswith("]") | line.startswith("【") & line.endswith("】")
    opens = F.when(line.rlike(NUMBERED), "h2").when(bracketed, "h3").when(line.rlike(ITEM), "list").when(F.contains(line, F.lit("\t")), "table").otherwise("paragraph")
    order = Window.partitionBy("case_id").orderBy("at")
    numbered = each.select("*", opens.alias("opens"), F.sum((line == "").cast("int")).over(order).alias("run"), F.sum((~tabbed).cast("int")).over(order).alias("tabs"))
    seen = lambda test, *keys: F.max(test).over(Window.partitionBy("case_id", *keys).orderBy("at"))
    full = numbered.where(line != "")
    tables = full.withColumn("opens", F.when(tabbed & seen(F.col("opens") == "table", "run", "tabs"), "table").otherwise(F.col("opens")))
    kinds = tables.withColumn("kind", F.when(seen(F.col("opens") == "paragraph", "run"), "paragraph").otherwise(F.col("opens")))
    before = F.lag(F.struct("run", "kind")).over(order)
    starts = F.col("kind").isin("h2", "h3") | before.isNull() | (before != F.struct("run", "kind"))
    cells = F.array_join(F.transform(F.split("raw", "\t"), trimmed), "\t")
    part = F.when(F.col("kind") == "list", F.regexp_replace("line", ITEM, "")).when(F.col("kind") == "table", cells).otherwise(F.col("line"))
    placed = kinds.select("case_id", "at", "kind", part.alias("part"), starts.cast("int").alias("starts")).withColumn("block_id", F.sum("starts").over(order).cast("int"))
    blocks = placed.groupBy("case_id", "block_id", "kind").agg(F.array_sort(F.collect_list(F.struct("at", "part"))).alias("p"))
    rows = F.when(F.col("kind") == "paragraph", F.array(F.array_join("p.part", " "))).otherwise(F.col("p.part"))
    return blocks.select("case_id", "block_id", "kind", rows.alias("rows")).withColumn("text", F.array_join("rows", "\n"))
