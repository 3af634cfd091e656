"""Page text from placed glyphs: lines by their baselines, blanks by the gaps between glyphs.

Glyphs are rows (doc_id, page, pos, s, x, y, width, font): ``pos`` is their order in the file,
``y`` grows upwards. The sweep down a page streams sorted rows with one baseline in hand, and
blanks come from a window over a line, so a page of any size needs no array of its glyphs.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TOLERANCE = 3.0  # of baselines of one line
FONT = 12.0  # where a glyph has none
GAP, BLANK, MOST = 0.25, 0.5, 24  # of the font's size: the least gap, the width of a blank; blanks at most


def _swept(batches):
    """Numbers the lines of sorted glyphs: a line holds what lies within the tolerance of its highest baseline."""
    page = top = line = None
    for batch in batches:
        numbers = []
        for *key, y in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "page", "y"))):
            if key != page:
                page, top, line = key, y, 0
            elif top - y > TOLERANCE:
                top, line = y, line + 1
            numbers.append(line)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(numbers, pa.int64())], [*batch.schema.names, "line"])


def lines_of(glyphs: DataFrame) -> DataFrame:
    """``glyphs`` with the number of their line on the page, from the top; empty ones are left out."""
    rows = glyphs.where("s <> ''").select("doc_id", "page", "pos", "s", *(F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in ("x", "y", "width", "font")))
    schema = ", ".join(f"`{c}` {kind}" for c, kind in rows.dtypes) + ", line long"
    return rows.repartition("doc_id", "page").sortWithinPartitions("doc_id", "page", F.desc("y"), "pos").mapInArrow(_swept, schema)


def blanks(gap: Column, font: Column) -> Column:
    """How many blanks a gap stands for."""
    size = F.when(font > 0, font).otherwise(FONT)
    return F.when(gap < size * GAP, 0).otherwise(F.least(F.greatest(F.round(gap / (size * BLANK)), F.lit(1)), F.lit(MOST))).cast("int")


def page_text(glyphs: DataFrame) -> DataFrame:
    """(doc_id, page, text) of every page; a page without text is empty. Glyphs at one place keep the file's order."""
    right = F.col("x") + F.when((F.col("width") <= 0) & (F.col("font") > 0), F.col("font") * BLANK * F.length("s")).otherwise(F.col("width"))
    w = Window.partitionBy("doc_id", "page", "line").orderBy("x", "pos")
    placed = lines_of(glyphs).withColumn("right", right).withColumns({"last": F.lag("right").over(w), "before": F.lag("s").over(w)})
    parted = F.col("before").isNotNull() & (F.col("s") != " ") & ~F.endswith("before", F.lit(" "))
    piece = F.concat(F.repeat(F.lit(" "), F.when(parted, blanks(F.col("x") - F.col("last"), F.col("font"))).otherwise(0)), "s")
    joined = lambda items, end: F.array_join(F.transform(F.array_sort(F.collect_list(items)), lambda i: i["piece"]), end)
    lines = placed.select("doc_id", "page", "line", "x", "pos", piece.alias("piece")).groupBy("doc_id", "page", "line").agg(joined(F.struct("x", "pos", "piece"), "").alias("piece"))
    pages = lines.groupBy("doc_id", "page").agg(joined(F.struct("line", "piece"), "\n").alias("text"))
    return glyphs.select("doc_id", "page").distinct().join(pages, ["doc_id", "page"], "left").select("doc_id", "page", F.coalesce("text", F.lit("")).alias("text"))
