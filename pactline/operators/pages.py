"""Pages of documents: line ends, repeated headers and footers, blank lines, joining."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pactline.functions import text as x

MARGIN = 3  # lines from either end of a page that may be a header or footer


def is_blank(line: Column) -> Column:
    return ~line.rlike(r"\S")


def cleaned(pages: DataFrame) -> DataFrame:
    """(doc_id, page, text): pages without the margin lines that repeat through their document.

    A header stands among the first ``MARGIN`` lines with something in them, a footer among the
    last. Of two or three pages, two must hold it; of more, half of them, rounded up. Lines are
    counted by (document, line), so a long document is not gathered in one place.
    """
    lines = F.split(x.line_endings(F.col("text")), "\n", -1)
    rows = pages.select("doc_id", "page", F.posexplode(lines).alias("at", "line"))
    full = rows.where(~is_blank(F.col("line")))
    # a line's place among the lines with something in them, from either end of its page
    order = F.transform(F.array_sort(F.collect_list("at")), lambda a: a)
    placed = full.groupBy("doc_id", "page").agg(order.alias("places"))
    n = F.size("places")
    margins = placed.select("doc_id", "page", F.slice("places", 1, MARGIN).alias("top"), F.slice("places", F.greatest(F.lit(1), n - (MARGIN - 1)), MARGIN).alias("bottom"))
    marked = full.join(margins, ["doc_id", "page"]).select("doc_id", "page", "at", "line", F.array_contains("top", F.col("at")).alias("top"), F.array_contains("bottom", F.col("at")).alias("bottom")).where("top or bottom")
    total = pages.groupBy("doc_id").agg(F.count("*").alias("n_pages"))
    seen = marked.groupBy("doc_id", "line").agg(F.count_if("top").alias("tops"), F.count_if("bottom").alias("bottoms")).join(total, "doc_id")
    least = F.when(F.col("n_pages") >= 4, F.floor((F.col("n_pages") + 1) / 2)).otherwise(2)
    known = seen.select("doc_id", "line", ((F.col("n_pages") > 1) & (F.col("tops") >= least)).alias("header"), ((F.col("n_pages") > 1) & (F.col("bottoms") >= least)).alias("footer")).where("header or footer")
    gone = marked.join(known, ["doc_id", "line"]).where("(top and header) or (bottom and footer)").groupBy("doc_id", "page").agg(F.collect_set("at").alias("gone"))
    kept = F.filter(lines, lambda _, i: ~F.coalesce(F.array_contains(F.col("gone"), i), F.lit(False)))
    return pages.join(gone, ["doc_id", "page"], "left").select("doc_id", "page", x.collapse_blank_lines(F.array_join(kept, "\n")).alias("text"))


def joined(pages: DataFrame) -> DataFrame:
    """(doc_id, text): a document's pages in order, with a blank line between them."""
    return pages.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", "text"))), lambda p: p["text"]), "\n\n").alias("text"))


def extraction_status(pages: DataFrame) -> DataFrame:
    """(doc_id, status): whether a document's pages hold any text."""
    return pages.groupBy("doc_id").agg(F.max(~is_blank(F.coalesce("text", F.lit("")))).alias("any")).select("doc_id", F.when(F.col("any"), "metin").otherwise("metin_katmani_yok").alias("status"))
