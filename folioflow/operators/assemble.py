"""From raw frames to finished document frames, and the nested document."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioflow.operators import furniture, headings, mapping, reading_order, running, scale, tables
from folioflow.session import distinct_rows, parallelism, saved

PROCESSING_VERSION = "2"
CONTRACT_VERSION = "1.0"


def raw_frames(spark, sf_dir: str) -> dict[str, DataFrame]:
    """The raw tables below a folder, each row once."""
    from folioflow.session import table

    keys = {"raw_pages": ["doc_id", "page_number"], "raw_blocks": ["block_key"], "raw_tables": ["block_key"], "raw_cells": ["cell_key"]}
    return {name[4:]: distinct_rows(table(spark, sf_dir, name), k) for name, k in keys.items()}


def assemble(raw: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """pages, blocks, sections, tables, cells and warnings from pages, blocks, tables and cells.

    The order is part of the meaning: furniture is relabelled before the order
    and the levels are found, sections run on across pages.  All of it is
    grouped by document, then page.
    """
    relabelled = furniture.reclassify(raw["blocks"], raw["pages"])
    # read by all that follows
    ordered = saved(reading_order.order_blocks(relabelled, raw["pages"]))
    heads = headings.assign_levels(headings.heading_rows(ordered))
    sections = headings.build_sections(heads)
    with_section = headings.section_of_blocks(ordered, sections)
    with_level = with_section.join(heads.select("doc_id", "block_id", F.col("level").alias("heading_level")), ["doc_id", "block_id"], "left")
    on_page = with_level.filter("type = 'table'").select("doc_id", "page_number", "block_ord", "block_id", "emit_index", "section_id")
    ids = running.numbered(on_page, ["emit_index"], "_n").withColumn("table_id", F.format_string("t%03d", "_n")).drop("_n")
    sources = tables.scale_sources(raw["tables"], raw["cells"], ordered)
    units = scale.detect_scale(sources, tables.KEYS)
    built = raw["tables"].join(ids.drop("emit_index"), tables.KEYS).join(units, tables.KEYS, "left").withColumn("scale", F.coalesce("scale", F.lit(1.0)))
    values = tables.cell_values(raw["cells"], built.select(*tables.KEYS, "scale", "currency")).join(ids.select(*tables.KEYS, "table_id"), tables.KEYS)
    cells = values.withColumn("cell_id", F.format_string("%s_r%d_c%d", "table_id", "row_idx", "col_idx"))
    blocks = with_level.join(ids.select("doc_id", "block_id", "table_id"), ["doc_id", "block_id"], "left")
    pages = raw["pages"].withColumn("low_confidence", mapping.low_confidence(F.col("ocr_confidence"))).join(reading_order.reading_order(ordered), ["doc_id", "page_number"], "left")
    low = pages.filter("low_confidence").select("doc_id", F.lit("LOW_OCR_CONFIDENCE").alias("code"), F.format_string("confidence %.2f", "ocr_confidence").alias("message"), F.col("page_number").alias("page"))
    none = headings.without_headings(ordered, sections).select("doc_id", "code", F.lit("no headings").alias("message"), F.lit(None).cast("int").alias("page"))
    failed = pages.filter("extraction_source = 'failed'").select("doc_id", F.lit("PAGE_EXTRACTION_FAILED").alias("code"), F.lit("page could not be read").alias("message"), F.col("page_number").alias("page"))
    return {"pages": pages, "blocks": blocks, "sections": headings.section_pages(sections, with_section), "tables": built, "cells": cells, "warnings": low.unionByName(none).unionByName(failed)}


def chunk_metadata(blocks: DataFrame, sections: DataFrame) -> DataFrame:
    """document, page, section path and content type of every block that retrieval sees, in order."""
    paths = sections.select("doc_id", "section_id", F.array_join("path", " > ").alias("section"))
    body = blocks.filter("order_index is not null").join(paths, ["doc_id", "section_id"], "left")
    return body.select("doc_id", "page_number", "order_index", "block_id", F.coalesce("section", F.lit("")).alias("section"), F.col("type").alias("content_type"))


def iter_blocks(pages: DataFrame, blocks: DataFrame) -> DataFrame:
    """The blocks in the order of the pages' reading orders, numbered by document; unknown ids are skipped."""
    listed = pages.select("doc_id", "page_number", F.posexplode("reading_order").alias("pos", "block_id"))
    joined = listed.join(blocks.select("doc_id", "block_id", "type", "text"), ["doc_id", "block_id"])
    return running.numbered(joined, ["pos"], "n").select("doc_id", "n", "page_number", "block_id", "type", "text")


def looked_up(wanted: DataFrame, frame: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The rows of ``wanted`` with the first row of ``frame`` (by ``order``) of their keys, nulls if there is none."""
    rest = [c for c in frame.columns if c not in keys]
    first = frame.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_row"))
    return wanted.join(first, keys, "left").select(*wanted.columns, *[F.col(f"_row.{c}").alias(c) for c in rest])


def _parts(frames: dict[str, DataFrame]) -> list[tuple[str, DataFrame, Column]]:
    """name, rows and struct of each array of a nested document; the structs in order are the array's order."""
    blocks = frames["blocks"].groupBy("doc_id", "page_number").agg(F.sort_array(F.collect_list(F.struct("emit_index", "block_id", "type", "text", "section_id", "order_index", "heading_level", "table_id"))).alias("blocks"))
    return [
        ("pages", frames["pages"].join(blocks, ["doc_id", "page_number"], "left"), F.struct("page_number", "width", "height", "rotation", "extraction_source", "ocr_confidence", "low_confidence", "reading_order", "blocks")),
        ("sections", frames["sections"], F.struct("i", "section_id", "title", "level", "parent_section_id", "path", "heading_block_id", "page_start", "page_end")),
        ("tables", frames["tables"], F.struct("table_id", "block_id", "page_number", "section_id", "caption", "n_rows", "n_cols", "header_rows", "header_cols", "scale", "scale_label", "currency")),
        ("warnings", frames["warnings"], F.struct("code", "page", "message")),
    ]


def nested(frames: dict[str, DataFrame]) -> DataFrame:
    """One row per document with its pages, sections, tables and warnings nested, arrays in order."""
    (pages, *rest) = [(name, df.groupBy("doc_id").agg(F.sort_array(F.collect_list(item)).alias(name))) for name, df, item in _parts(frames)]
    out = pages[1]
    for _, rolled in rest:
        out = out.join(rolled, "doc_id", "left")
    return out.withColumn("contract_version", F.lit(CONTRACT_VERSION))


def parts(frames: dict[str, DataFrame]) -> DataFrame:
    """What ``nested`` nests, a row each: doc_id, and a page, section, table or warning in the column of its name, nulls in the others.

    As there, a document is one that has pages, and a null doc_id has nothing but them.
    """
    listed = [(name, df if name == "pages" else df.filter("doc_id is not null"), item) for name, df, item in _parts(frames)]
    rows = [df.select("doc_id", item.alias(name)) for name, df, item in listed]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), rows)


def stable_hash(parts: DataFrame) -> DataFrame:
    """doc_id and a hash of all that doesn't depend on the run, from the ``parts`` of the documents.

    It is the SHA-256 of the nested document's JSON, read part by part in
    order, so that no document is gathered into one row, however long it is.
    """
    kept = [c for c in parts.columns if c not in ("processing", "doc_id")]
    part = F.coalesce(*[F.when(F.col(c).isNotNull(), i) for i, c in enumerate(kept)])
    placed = parts.select("doc_id", part.alias("_part"), *kept).repartition(parallelism(parts.sparkSession), "doc_id").sortWithinPartitions("doc_id", "_part", *kept)
    opening, end = [f'"{c}":['.encode() for c in kept], f'],"contract_version":"{CONTRACT_VERSION}"}}'.encode()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # the document at hand, which goes on from batch to batch; no digest if it has no pages
        doc, last, digest = object(), None, None
        for batch in batches:
            docs, hashes = [], []
            for other, at, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).cast(pa.binary()).to_pylist()):
                if other != doc:
                    if digest:
                        digest.update(end)
                        docs.append(doc)
                        hashes.append(digest.hexdigest())
                    doc, last, digest = other, None, None if at else hashlib.sha256()
                if digest:
                    digest.update(b"," if at == last else (b"{" if last is None else b"],") + opening[at])
                    digest.update(text)
                last = at
            yield pa.RecordBatch.from_arrays([pa.array(docs, pa.string()), pa.array(hashes, pa.string())], ["doc_id", "stable_hash"])
        if digest:
            digest.update(end)
            yield pa.RecordBatch.from_arrays([pa.array([doc], pa.string()), pa.array([digest.hexdigest()], pa.string())], ["doc_id", "stable_hash"])

    return placed.select("doc_id", "_part", F.coalesce(*[F.to_json(c) for c in kept]).alias("_json")).mapInArrow(run, "doc_id string, stable_hash string")
