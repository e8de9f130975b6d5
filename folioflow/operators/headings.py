"""Heading levels and the section tree."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioflow.functions.text import numbering_depth, strip
from folioflow.operators.running import latest, numbered
from folioflow.session import saved

#: Fixed: sizes closer than this to the largest of their rank share it.
TOLERANCE = 0.6
HEADINGS = ("title", "section_header")


def heading_rows(ordered: DataFrame) -> DataFrame:
    """The non-blank headings of each document, numbered ``i`` from 0 in page and emit order."""
    kept = ordered.filter(F.col("type").isin(*HEADINGS) & (strip(F.coalesce("text", F.lit(""))) != ""))
    # few beside the blocks, and read several times
    return numbered(saved(kept), ["emit_index"], "i")


def size_ranks(headings: DataFrame) -> DataFrame:
    """doc_id, font_size and size_rank: greedy against the first size of each rank, from large to small.

    A fold over the distinct sizes of a document, of which there are few.
    """
    # titles have their level anyway, but their size is ranked with the others
    sizes = headings.filter("font_size is not null").groupBy("doc_id").agg(F.sort_array(F.collect_set("font_size"), asc=False).alias("sizes"))
    fold = F.expr(
        f"""aggregate(sizes, cast(struct(null as rep, 0 as rk, array() as out) as struct<rep:double,rk:int,out:array<struct<font_size:double,size_rank:int>>>),
        (a, s) -> cast(if(a.rep is null or a.rep - s > {TOLERANCE},
            struct(s as rep, a.rk + 1 as rk, concat(a.out, array(struct(s as font_size, a.rk + 1 as size_rank))) as out),
            struct(a.rep as rep, a.rk as rk, concat(a.out, array(struct(s as font_size, a.rk as size_rank))) as out))
          as struct<rep:double,rk:int,out:array<struct<font_size:double,size_rank:int>>>),
        a -> a.out)"""
    )
    return sizes.select("doc_id", F.inline(fold))


def assign_levels(headings: DataFrame) -> DataFrame:
    """The headings with ``level``: a title 1, else the rank of the size plus the numbering's depth less one.

    An unmeasured heading has the level of the one before it, 1 if there is none.
    """
    ranked = headings.join(size_ranks(headings), ["doc_id", "font_size"], "left")
    own = F.when(F.col("type") == "title", 1).when(F.col("font_size").isNotNull(), F.col("size_rank") + F.coalesce(numbering_depth(F.col("text")) - 1, F.lit(0)))
    known = latest(ranked.withColumn("_level", own), "i", {"_latest": F.col("_level")}, itself=True)
    return known.withColumn("level", F.coalesce("_latest", F.lit(1)).cast("int")).select(*headings.columns, "level")


def _deepest(leveled: DataFrame) -> int:
    return leveled.agg(F.max("level")).first()[0] or 0


def build_sections(leveled: DataFrame) -> DataFrame:
    """The section tree: section_id, title, level, parent_section_id, path, heading_block_id, page_start.

    Running values keep the last heading of each level, of which there are few.
    A heading's parent is the latest of those above its level; the ancestors are
    those of ever smaller level, from the latest back.  No document is gathered
    into one row, however many headings it has.
    """
    leveled = saved(leveled.select("doc_id", "i", "level", strip(F.col("text")).alias("title"), "block_id", "page_number"))
    levels = range(1, _deepest(leveled))
    seen = latest(leveled, "i", {f"_at{n}": F.when(F.col("level") == n, F.struct("i", "level", "title")) for n in levels})
    kind = "array<struct<i:int,level:int,title:string>>"
    above = F.array_compact(F.array(*[f"_at{n}" for n in levels])).cast(kind) if levels else F.array().cast(kind)
    rows = seen.withColumn("_above", above).withColumn("_above", F.sort_array(F.filter("_above", lambda x: x["level"] < F.col("level")), asc=False))
    chain = F.expr(f"aggregate(_above, cast(array() as {kind}), (a, x) -> if(size(a) = 0 or x.level < a[size(a) - 1].level, concat(a, array(x)), a))")
    tree = rows.withColumn("_chain", chain)
    parent = F.get("_chain", 0)["i"]
    return tree.select(
        "doc_id", "i", F.format_string("s%03d", "i").alias("section_id"), "title", "level", F.when(parent.isNotNull(), F.format_string("s%03d", parent)).alias("parent_section_id"),
        F.concat(F.transform(F.reverse("_chain"), lambda x: x["title"]), F.array("title")).alias("path"), F.col("block_id").alias("heading_block_id"), F.col("page_number").alias("page_start"),
    )


def section_of_blocks(ordered: DataFrame, sections: DataFrame) -> DataFrame:
    """The blocks with section_id: the last heading at or before them in emit order, across pages.

    Within a page by a window over the page, from earlier pages by a window over
    one row per page.
    """
    starts = sections.select("doc_id", F.col("heading_block_id").alias("block_id"), F.col("section_id").alias("_s"))
    joined = ordered.join(starts, ["doc_id", "block_id"], "left")
    on_page = Window.partitionBy("doc_id", "page_number").orderBy("emit_index").rowsBetween(Window.unboundedPreceding, 0)
    here = joined.withColumn("_here", F.last("_s", ignorenulls=True).over(on_page))
    lasts = sections.groupBy("doc_id", F.col("page_start").alias("page_number")).agg(F.max("i").alias("_i"))
    earlier = Window.partitionBy("doc_id").orderBy("page_number").rowsBetween(Window.unboundedPreceding, -1)
    pages = ordered.select("doc_id", "page_number").distinct().join(lasts, ["doc_id", "page_number"], "left").withColumn("_before", F.last("_i", ignorenulls=True).over(earlier)).select("doc_id", "page_number", "_before")
    carried = F.when(F.col("_before").isNotNull(), F.format_string("s%03d", "_before"))
    return here.join(pages, ["doc_id", "page_number"]).withColumn("section_id", F.coalesce("_here", carried)).drop("_s", "_here", "_before")


def section_pages(sections: DataFrame, blocks: DataFrame) -> DataFrame:
    """The sections with page_end: the last page of their blocks and of the sections below them.

    Below a section lies all up to the next of its level or above; pages only
    grow along the document, so its end is that of the last one below it.
    """
    own = blocks.filter("section_id is not null").groupBy("doc_id", "section_id").agg(F.max("page_number").alias("own_end"))
    sections = saved(sections)
    levels = range(1, _deepest(sections) + 1)
    paged = latest(sections.withColumn("page_number", F.col("page_start")), "i", {f"_at{n}": F.when(F.col("level") == n, F.col("i")) for n in levels}, following=True)
    nexts = [F.when(F.col("level") >= n, F.col(f"_at{n}")) for n in levels]
    stop = F.array_min(F.array_compact(F.array(*nexts))) if nexts else F.lit(None).cast("int")
    last = sections.groupBy("doc_id").agg(F.max("i").alias("_last"))
    spans = paged.withColumn("_stop", stop).select(*sections.columns, "_stop").join(last, "doc_id").withColumn("_to", F.coalesce(F.col("_stop") - 1, F.col("_last")))
    ends = sections.select("doc_id", F.col("i").alias("_to"), "section_id", "page_start").join(own, ["doc_id", "section_id"], "left").select("doc_id", "_to", F.greatest(F.col("page_start"), F.coalesce("own_end", F.col("page_start"))).cast("int").alias("page_end"))
    return spans.join(ends, ["doc_id", "_to"]).drop("_stop", "_last", "_to")


def without_headings(ordered: DataFrame, sections: DataFrame) -> DataFrame:
    """doc_id and the warning of documents that have blocks and no section."""
    return ordered.select("doc_id").distinct().join(sections.select("doc_id").distinct(), "doc_id", "left_anti").withColumn("code", F.lit("NO_HEADINGS_DETECTED"))
