"""Parsed pages: their form, what cannot be read, and tables that go on over a page."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Points that column edges may differ, and the share of a page that counts as its edge.
COLUMN_SLACK, EDGE = 2.0, 0.12
#: A first row with this share of the columns at most is a torn one; images of this share of a page count.
TORN, LARGE = 0.5, 0.25


def page_form(chars: Column, text_area: Column, image_area: Column, ink: Column, text_chars: int = 80, text_share: float = 0.02, few_chars: int = 20, image_share: float = 0.5, watermark_share: float = 0.3, ink_share: float = 0.01) -> Column:
    """(form, rule) by four ordered rules; unknown ink does not speak against a scan."""
    as_ = lambda form, rule: F.struct(F.lit(form).alias("form"), F.lit(rule).alias("rule"))
    bare = (chars < few_chars) & (image_area >= image_share)
    return (
        F.when((chars >= text_chars) & (text_area >= text_share), as_("text", "R1_text_layer"))
        .when(bare & (ink.isNull() | (ink >= ink_share)), as_("scanned", "R2_no_text_big_image_ink"))
        .when(bare, as_("mixed", "R2_rejected_blank_image"))
        .when((chars >= few_chars) & (text_area < text_share) & (image_area >= watermark_share), as_("scanned", "R3_watermark_text_big_image"))
        .otherwise(as_("mixed", "R4_fallback_mixed"))
    )


def unreadable_regions(images: Column, width: Column, height: Column) -> Column:
    """Boxes of images that cover a quarter of the page or more, rounded."""
    area = lambda x: F.greatest(F.lit(0.0), x[2] - x[0]) * F.greatest(F.lit(0.0), x[3] - x[1])
    side = lambda c: F.when(F.coalesce(c, F.lit(0.0)) == 0, 1.0).otherwise(c)
    return F.transform(F.filter(images, lambda x: area(x) / (side(width) * side(height)) >= LARGE), lambda x: F.transform(x, lambda v: F.round(v, 2)))


def continued_tables(pages: DataFrame, tables: DataFrame) -> DataFrame:
    """(doc_id, page, table_id, continued_from): the first table of a page that goes on from the last of the one before.

    ``tables``: (doc_id, page, pos, table_id, n_cols, region). Same columns, same side edges, both at the page's edge.
    """
    ends = Window.partitionBy("doc_id", "page")
    t = tables.withColumns({"first": F.min("pos").over(ends), "last": F.max("pos").over(ends)})
    low = t.where("pos = last").select("doc_id", (F.col("page") + 1).alias("page"), F.col("page").alias("from_page"), F.col("table_id").alias("continued_from"), F.col("n_cols").alias("n"), F.col("region").alias("r"))
    top = t.where("pos = first").select("doc_id", "page", "table_id", "n_cols", "region")
    size = pages.select("doc_id", "page", "height")
    both = top.join(low, ["doc_id", "page"]).join(size, ["doc_id", "page"]).join(size.select("doc_id", F.col("page").alias("from_page"), F.col("height").alias("from_height")), ["doc_id", "from_page"])
    near = lambda k: F.abs(F.col("region")[k] - F.col("r")[k]) <= COLUMN_SLACK
    at_edge = (F.col("from_height") - F.col("r")[3] <= EDGE * F.col("from_height")) & (F.col("region")[1] <= EDGE * F.col("height"))
    return both.where((F.col("n_cols") == F.col("n")) & near(0) & near(2) & at_edge).select("doc_id", "page", "table_id", "continued_from")


def torn_cells(cells: DataFrame, tables: DataFrame, continued: DataFrame) -> DataFrame:
    """(doc_id, table_id, col, continues): cells of a torn first row, with the cell above the page break.

    A first row is torn if it fills half of the columns at most; each of its cells goes on from the same
    column of the last row before.
    """
    first = cells.where("row = 0").join(continued, ["doc_id", "table_id"]).join(tables.select("doc_id", "table_id", "n_cols"), ["doc_id", "table_id"])
    first = first.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("doc_id", "table_id"))).where(F.col("n") <= TORN * F.col("n_cols"))
    last = cells.withColumn("end", F.max("row").over(Window.partitionBy("doc_id", "table_id"))).where("row = end").select("doc_id", F.col("table_id").alias("continued_from"), "col", F.col("cell_id").alias("continues"))
    return first.join(last, ["doc_id", "continued_from", "col"]).select("doc_id", "table_id", "col", "continues")


def paragraph_pairs(blocks: DataFrame) -> DataFrame:
    """(doc_id, pos, text, joined): each usable paragraph, and with the one before on its page that ends no sentence.

    Usable are paragraphs with a page, a text, and an id that is theirs alone.
    """
    order = Window.partitionBy("doc_id").orderBy("pos")
    alone = F.count(F.lit(1)).over(Window.partitionBy("doc_id", "block_id")) == 1
    rows = blocks.withColumn("ok", F.coalesce(alone & F.col("block_id").isNotNull() & (F.col("page") > 0) & (F.col("kind") == "paragraph") & F.col("text").isNotNull(), F.lit(False)))
    rows = rows.withColumns({"before": F.lag("text").over(order), "before_ok": F.lag("ok").over(order), "before_page": F.lag("page").over(order)})
    bare = lambda c: F.regexp_replace(c, r"(?U)\s+", "")
    joins = F.col("before_ok") & (F.col("before_page") == F.col("page")) & ~F.col("before").rlike(r"[。！？；;](?U:\s)*$")
    return rows.where("ok").select("doc_id", "pos", bare(F.col("text")).alias("text"), F.when(joins, F.concat(bare(F.col("before")), bare(F.col("text")))).alias("joined"))


def block_export(pages: DataFrame) -> DataFrame:
    """(doc_id, page, pos, block): every block of (doc_id, page, blocks), unchanged and in order."""
    return pages.select("doc_id", "page", F.posexplode("blocks").alias("pos", "block"))


def blocks_together(blocks: DataFrame) -> DataFrame:
    """(doc_id, page, blocks): the blocks of each page in order; the inverse of ``block_export``."""
    return blocks.groupBy("doc_id", "page").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "block"))), lambda x: x["block"]).alias("blocks"))
