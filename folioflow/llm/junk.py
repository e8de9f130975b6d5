"""Keyword-stuffed pages and link lists.

Each text is laid out in lines, and lines of one kind are gathered in blocks:
links, tags, figures (tables, contents, indexes), bare words and sentences.  A
block of words or sentences is reduced to its letters and compressed; the
logarithm of its ratio is held against the median of all blocks of that
language and length, so redundancy counts beyond what its length and language
explain.  Extreme redundancy makes a block junk if it is confirmed by what
sentences of reports would have: function words, full stops and figures.
Blocks of links and of tags need no compression, their letters are mostly
addresses or joined keywords.  A document is junk if most of its characters are
in junk blocks.

One pass in Python turns a text into a few rows of numbers; medians and
decisions are plain aggregates over all of them.

Edge cases: null, empty and blank texts have no blocks and are not junk;
neither are very short texts (under ``LEAST`` characters); a null language is a
language of its own; a document sent twice is found once.
"""

from __future__ import annotations

import math
import re
import unicodedata
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflow.session import saved

#: Fixed: frequent function words of English, German, French and Spanish.
FUNCTION_WORDS = frozenset(
    "the of and to in a is that for by with at from as on are was were be which or an our this not than has have its it we "
    "der die das und zu den von mit im auf für des eine ein ist sich dem aus bei als wird werden wurde durch nach zum zur über sowie "
    "le la les de du et à en un une dans pour par sur au aux est sous que qui ne se sont leur plus "
    "el los las del y con su al una por lo como más no sobre entre".split()
)
LINK = re.compile(r"(?:[a-z]+:)?//[^\s<>\"']+|\b[\w-]+(?:\.[\w-]+)*\.[a-z]{2,}(?:/[^\s<>\"']*)?(?=[\s<>\"']|$)|</?a\b[^>]*>?|<br\s*/?>", re.I)
TAG = re.compile(r"#\w[\w'-]{2,}|\b[^\W\d_]++(?:['’][^\W\d_]++)?(?:[-_+][^\W\d_]++)+(?!\w)")
#: Without these a line has no link and no tag; cheap to look for.
MAY_LINK, MAY_TAG = re.compile(r"//|[<>]|[\w-]\.[A-Za-zſK]{2}"), re.compile(r"#|[-_+][^\W\d_]")
WORD = re.compile(r"[^\W\d_]+")
NUMBER = re.compile(r"\d+")
STOP = re.compile(r"[.!?](?=\s|$)")
#: Characters of a block, and of a text that can be junk at all.
BLOCK, LEAST = 1500, 150
#: The last bin of lengths, that of full blocks.
LAST_BIN = 21
#: Medians that are broadcast; there are at most LAST_BIN + 1 rows a language.
MOST_MEDIANS = 100_000
#: Kinds of blocks.
LINKS, TAGS, FIGURES, WORDS, SENTENCES = range(5)


def _lines(text: str) -> Iterator[str]:
    for line in text.split("\n"):
        while len(line) > BLOCK:
            at = line.rfind(" ", 0, BLOCK)
            at = at if at > BLOCK // 2 else BLOCK
            yield line[:at]
            line = line[at:]
        if line and not line.isspace():
            yield line


def _kind(line: str) -> tuple[int, list[str], int]:
    """The line's kind, its words without links, and its figures."""
    figures = len(NUMBER.findall(line))
    length = len(line.strip())
    addresses = sum(len(m.group()) for m in LINK.finditer(line)) if MAY_LINK.search(line) else 0
    words = WORD.findall(LINK.sub(" ", line) if addresses else line)
    if addresses >= 0.3 * length and addresses >= 8:
        return LINKS, words, figures
    tags = [m.group() for m in TAG.finditer(line)] if MAY_TAG.search(line) else []
    joined = sum(map(len, tags))
    if len(tags) >= 3 and joined >= 0.5 * sum(map(len, words)) and not STOP.search(line.rstrip()[:-1]) and (2 * sum(t[0] == "#" or t.islower() for t in tags) > len(tags) or len(set(tags)) <= 0.75 * len(tags)):
        return TAGS, words, figures
    if not words or "...." in line or line.count("|") >= 2 and figures or figures >= 0.25 * len(words) and not line.rstrip().endswith((".", "!", "?")):
        return FIGURES, words, figures
    functional = sum(map(FUNCTION_WORDS.__contains__, words))
    return (WORDS if functional < 0.12 * len(words) else SENTENCES), words, figures


def blocks(text: str) -> list[tuple]:
    """(kind, characters, words, bytes compressed from, log ratio, function words, full stops, figures, repeated pairs, distinct words) of each block."""
    text = unicodedata.normalize("NFKC", text)
    out: list[tuple] = []
    held: dict[int, list] = {}

    def close(kind: int) -> None:
        chars, words, stops, figures = held.pop(kind)
        data = " ".join(words).encode()
        ratio = math.log(len(zlib.compress(data, 6)) / len(data)) if data else 0.0
        pairs = Counter(zip(words, words[1:]))
        repeated = sum([n for n in pairs.values() if n >= 3]) / max(1, len(words) - 1)
        functional = sum(map(FUNCTION_WORDS.__contains__, words)) / max(1, len(words))
        out.append((kind, chars, len(words), len(data), ratio, functional, stops / max(1, len(words)), figures / max(1, len(words)), repeated, len(set(words)) / max(1, len(words))))

    for line in _lines(text):
        kind, words, figures = _kind(line)
        chars = len(line.strip())
        if kind in held and held[kind][0] + chars > BLOCK:
            close(kind)
        block = held.setdefault(kind, [0, [], 0, 0])
        block[0] += chars
        block[1] += map(str.lower, words)
        block[2] += len(STOP.findall(line)) if "." in line or "!" in line or "?" in line else 0
        block[3] += figures
    for kind in list(held):
        close(kind)
    return out


COLUMNS = ("kind", "chars", "words", "size", "ratio", "functional", "stops", "figures", "repeated", "types")


def block_rows(documents: DataFrame) -> DataFrame:
    """A row for each block of each text: doc_id, language and the numbers of ``blocks``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for doc, language, text in zip(*(c.to_pylist() for c in batch.columns)):
                if text and len(text) >= LEAST:
                    rows += [(doc, language, *b) for b in blocks(text)]
            columns = list(zip(*rows)) if rows else [()] * (2 + len(COLUMNS))
            kinds = [batch.schema.field(0).type, pa.string(), *[pa.int32()] * 4, *[pa.float64()] * 6]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], ["doc_id", "language", *COLUMNS])

    kept = documents.select("doc_id", F.lower(F.trim(F.coalesce("lang", F.lit("none")))).alias("language"), "text")
    kind = dict(kept.dtypes)["doc_id"]
    return kept.mapInArrow(run, f"doc_id {kind}, language string, kind int, chars int, words int, size int, ratio double, functional double, stops double, figures double, repeated double, types double")


def scores(documents: DataFrame) -> DataFrame:
    """doc_id, chars and junk_chars of each document with text."""
    rows = saved(block_rows(documents)).withColumn("bin", F.least(F.floor(3 * F.log(F.greatest("size", F.lit(1)))), F.lit(LAST_BIN)))
    # one row for each language and length, a small table whatever the corpus
    usual = saved(rows.filter("kind = 4").groupBy("language", "bin").agg(F.percentile_approx("ratio", 0.5).alias("by_language"), F.count("*").alias("n")))
    overall = rows.filter("kind = 4").groupBy("bin").agg(F.percentile_approx("ratio", 0.5).alias("by_length"))
    z = F.col("ratio") - F.when(F.col("n") >= 100, F.col("by_language")).otherwise(F.col("by_length"))
    # one row a language and length: broadcast where that is few, so that a frequent one is no hot key
    few = usual.count() <= MOST_MEDIANS
    usual, overall = (F.broadcast(usual) if few else usual), F.broadcast(overall)
    scored = rows.join(usual, ["language", "bin"], "left").join(overall, "bin", "left").withColumn("z", F.coalesce(z, F.lit(0.0)))
    plain = F.col("figures") < 0.05
    junk = (
        F.col("kind").isin(LINKS, TAGS)
        | ((F.col("kind") == WORDS) & (F.col("words") >= 15) & (F.col("stops") < 0.03) & (F.col("figures") < 0.25) & ((F.col("z") < -0.12) | (F.col("types") < 0.6)))
        | ((F.col("kind") == WORDS) & (F.col("words") >= 15) & plain & (F.col("types") < 0.45) & (F.col("z") < -0.3))
        | ((F.col("kind") == SENTENCES) & plain & (F.col("types") < F.when(F.col("words") < 90, 0.33).otherwise(0.38)) & (F.col("z") < -0.38) & (F.col("repeated") > 0.25))
        | ((F.col("kind") == SENTENCES) & plain & (F.col("stops") < 0.025) & (F.col("words") >= 30) & (F.col("types") < 0.5) & (F.col("z") < -0.12))
    )
    return scored.groupBy("doc_id").agg(F.sum("chars").alias("chars"), F.sum(F.when(junk, F.col("chars")).otherwise(0)).alias("junk_chars"))


def found(documents: DataFrame) -> DataFrame:
    return scores(documents).filter("2 * junk_chars > chars").select("doc_id")
