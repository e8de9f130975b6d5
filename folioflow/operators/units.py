"""Figures recorded in different units, brought to common ones: money and counts in ones, percent, kWh, kg.

A figure's unit is the closest one stated: in its own text, its row label, its
column header, or the table's declaration (the caption, else the header row,
else a row label in a row without figures, else the block directly before the
table).  The table's declaration never reaches percentages, per-share amounts
or numbers of things; a phrase that only sizes one figure declares nothing.

The figures of a row are the readings of one device, with the unit as hidden
state.  The states are the units stated anywhere for the row, and ones.  Every
statement is evidence of a weight of its own, the closer the heavier, and the
absence of any is weak evidence of ones; jumps of the logarithm of the amount
from reading to reading, in one kind, and switches of the unit cost.  A Viterbi
pass decodes the units.  So a statement in the figure's own text always holds, a
level that fits all neighbours outweighs the absence of a statement, or a remote
statement against a near one that is not there.

Amounts are exact: a figure is its digits and a power of ten, never a float.

Edge cases: null and blank texts, dashes and figures not written as the page's
language writes them have no amount; zero has none; a page without language
counts as English; cells sent twice count once; extra columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.functions.charmap import folded
from folioflow.session import distinct_rows, table

MONEY, PERCENT, ENERGY, MASS = "money", "percent", "energy", "mass"
Unit = tuple[str, int]
ONES: Unit = (MONEY, 0)

_CURRENCY = r"(?:us\$|[$€£¥₹]|\b(?:usd|eur|gbp|jpy|inr|chf|rmb|rs\.?)(?![a-z]))"
#: Fixed: unit phrases and their kind and power of ten, the longer before the shorter they contain.
_PHRASES: tuple[tuple[str, Unit], ...] = (
    (r"\btwh\b|terawatt", (ENERGY, 9)),
    (r"\bgwh\b|gigawatt", (ENERGY, 6)),
    (r"\bmwh\b|megawatt", (ENERGY, 3)),
    (r"\bkwh\b|kilowatt", (ENERGY, 0)),
    (r"kilo-?tonn?e|\bkt\b", (MASS, 6)),
    (r"\bkg\b|kilogram|kilogramm", (MASS, 0)),
    (r"\btonn?es?\b|\btonnen\b|\btoneladas\b|metric tons?|\bt co2e?\b|\(t\)", (MASS, 3)),
    (r"hundreds? of millions", (MONEY, 8)),
    (r"tens? of millions", (MONEY, 7)),
    (r"hundreds? of thousands", (MONEY, 5)),
    (r"tens? of thousands", (MONEY, 4)),
    (r"\bmiles de millones\b|\bmil millones\b", (MONEY, 9)),
    (r"\bcrores?\b", (MONEY, 7)),
    (r"\blakhs?\b", (MONEY, 5)),
    (r"\btrillions?\b", (MONEY, 12)),
    (r"\bbillions?\b|\bbn\b|bn\b|\bmrd\b|\bmilliarden?\b|\bmilliards?\b|\bmd\s?€|\bmd\b", (MONEY, 9)),
    (r"\bmillion(?:s|en|es)?\b|\bmillones\b|\bmill\.|\bmio\b|\bmn\b|\bmm\b|(?<=[$€£¥₹])\s?mm?\b|\bm\s?[$€£¥₹]|" + _CURRENCY + r"\s?m\b|\(m\)", (MONEY, 6)),
    (r"\bthousands?\b|\btausend\b|\btsd\b|\bteur\b|\bt\s?€|\bk\s?[$€£¥₹]|\bmilliers\b|\bmiles\b|['’]000\b|(?<=[$€£¥₹])\s?['’]?000s?\b|" + _CURRENCY + r"\s?['’]?k\b|\bk€|\(k\)", (MONEY, 3)),
    (r"\bhundreds?\b", (MONEY, 2)),
    (r"whole (?:dollars|euros)|actual amounts|\bin (?:dollars|euros?|usd|eur|us\$|pounds)\b|\bdollars\b", (MONEY, 0)),
)
_PHRASE = [(re.compile(p), unit) for p, unit in _PHRASES]
_MAGNITUDE = r"(?:thousands?|millions?|billions?|trillions?|tausend|tsd\.?|mio\.?|mrd\.?|millionen|milliarden|milliers|milliards?|millones|mil(?: millones)?|miles de millones|mn|bn|k|m|mm)"
#: A figure and its size, which declares nothing; a bare year before a unit is no figure.
_SIZED = re.compile(rf"(?:{_CURRENCY}\s?|(?<![\d.,])(?!(?:19|20)\d\d\s))\d[\d.,]*(?:\s\d{{3}})*\s?{_MAGNITUDE}(?![a-z])(?:\s(?:d['’]|de\s)?(?:euros?|€))?")
_LEAD = re.compile(r"present|stated|expressed|amounts?\b|angegeben|angaben|exprim|expresad|figures? (?:are|is)|\(|in\s*$|en\s*$|^\W*$")
#: Fixed: what follows a figure in its own text.
_SUFFIX: dict[str, Unit | None] = {
    "": None, "%": (PERCENT, 0), "percent": (PERCENT, 0), "pct": (PERCENT, 0), "prozent": (PERCENT, 0), "bps": (PERCENT, -2), "bp": (PERCENT, -2), "basis points": (PERCENT, -2),
    "k": (MONEY, 3), "thousand": (MONEY, 3), "thousands": (MONEY, 3), "mil": (MONEY, 3), "tsd": (MONEY, 3), "tausend": (MONEY, 3), "t€": (MONEY, 3), "teur": (MONEY, 3), "miles": (MONEY, 3), "milliers": (MONEY, 3),
    "m": (MONEY, 6), "mn": (MONEY, 6), "mm": (MONEY, 6), "mio": (MONEY, 6), "million": (MONEY, 6), "millions": (MONEY, 6), "millionen": (MONEY, 6), "millones": (MONEY, 6), "mill": (MONEY, 6),
    "bn": (MONEY, 9), "billion": (MONEY, 9), "billions": (MONEY, 9), "mrd": (MONEY, 9), "md": (MONEY, 9), "milliard": (MONEY, 9), "milliards": (MONEY, 9), "milliarden": (MONEY, 9), "mil millones": (MONEY, 9), "miles de millones": (MONEY, 9),
    "lakh": (MONEY, 5), "lakhs": (MONEY, 5), "crore": (MONEY, 7), "crores": (MONEY, 7), "trillion": (MONEY, 12), "cents": (MONEY, -2),
    "kwh": (ENERGY, 0), "mwh": (ENERGY, 3), "gwh": (ENERGY, 6), "twh": (ENERGY, 9), "kg": (MASS, 0), "t": (MASS, 3), "tonnes": (MASS, 3), "tonne": (MASS, 3), "tons": (MASS, 3), "t co2e": (MASS, 3), "kt": (MASS, 6),
}
_FIGURE = re.compile(
    r"^(?P<open>\()?\s*(?P<sign>[-−–+])?\s*(?P<open2>\()?\s*(?:us\$|usd|eur|gbp|rmb|inr|rs\.?|[$€£¥₹])?\s?(?P<sign2>[-−–+])?\s?(?P<number>\d[\d.,]*(?:[  ]\d{3})*(?:,\d+)?)\s*(?P<suffix>[^\d()]*?)\s*(?P<close>\))?\s*(?P<after>%|percent)?$"
)
_EN = re.compile(r"(?:\d{1,3}(?:,\d{3})+|\d+)(?:\.\d+)?")
_DE = re.compile(r"(?:\d{1,3}(?:\.\d{3})+|\d+)(?:,\d+)?")
_FR = re.compile(r"(?:\d{1,3}(?: \d{3})+|\d+)(?:,\d+)?")


@lru_cache(maxsize=1 << 16)
def declared(text: str, running: bool = False) -> Unit | None:
    """The unit a text declares; ``running``: it is running text, where only a declarative phrase counts."""
    t = _SIZED.sub(" ", folded(text).lower().replace("\n", " "))
    for pattern, unit in _PHRASE:
        for m in pattern.finditer(t):
            if not running or len(t) <= 90 or _LEAD.search(t[max(0, m.start() - 40) : m.start()].rpartition(". ")[2]):
                return unit
    return None


@lru_cache(maxsize=1 << 16)
def declares_before(text: str) -> Unit | None:
    """The unit that the block before a table declares for it.

    A remark on the discussion, or any sentence that isn't about what is
    presented, says nothing of the table.
    """
    if re.search(r"(?i)\bdiscussion\b", text):
        return None
    return declared(text, True)


@lru_cache(maxsize=1 << 16)
def label_unit(label: str) -> Unit | None:
    """The unit a row label states: a kind of its own, or the size of a number of things."""
    t = folded(label).lower().strip()
    if "%" in t or re.search(r"\bpercent|\bprozent\b|\bpour cent\b|\bpor ciento\b", t):
        return (PERCENT, 0)
    if re.search(r"\bbps?\b|basis points?|basispunkt|points de base|puntos básicos", t):
        return (PERCENT, -2)
    if re.search(r"\bper share\b|\bje aktie\b|\bpar action\b|\bpor acción\b", t):
        return (MONEY, -2) if re.search(r"\bcents?\b|\bcent\b|\bcéntimos\b|\bcentimes\b", t) else ONES
    if re.search(r"\(cents?\)", t):
        return (MONEY, -2)
    if re.search(r"\((?:number|in number|anzahl|nombre|número|units|count)\)|\bnumber of\b|\banzahl\b|\bnombre de\b|\bnúmero de\b", t):
        return ONES
    inside = re.search(r"\(([^()]*)\)\s*:?$", t) or re.search(r",\s*(in [^,]+|[$€£¥₹][^,]*|[kmg]wh|kg|kt|tonnes)$", t)
    if not inside:
        return None
    found = declared(f"({inside.group(1)})")
    return found or {"m": (MONEY, 6), "k": (MONEY, 3), "t": (MASS, 3)}.get(inside.group(1).strip())


@lru_cache(maxsize=1 << 16)
def header_unit(header: str) -> Unit | None:
    """The unit a column header states for its column."""
    t = folded(header).lower().strip()
    if "%" in t or re.search(r"\bpercent\b|\bprozent\b", t):
        return (PERCENT, 0)
    if re.search(r"\bbps\b|basis points", t):
        return (PERCENT, -2)
    return declared(header)


@lru_cache(maxsize=1 << 18)
def figure(text: str, language: str) -> tuple[int, str, int, Unit | None] | None:
    """(sign, digits, power of ten, unit stated with it) of a text that is one figure."""
    t = folded(text).strip()
    t = re.sub(r"[\s*†‡§]+$", "", t).lower()
    m = _FIGURE.match(t)
    if not m or bool(m["open"] or m["open2"]) != bool(m["close"]):
        return None
    suffix = m["suffix"].strip()
    if suffix not in _SUFFIX:
        suffix = re.sub(r"\s*(?:us\$|[$€£¥₹]|\beuros?\b|\beur\b|\busd\b|\bdollars\b)\s*", " ", suffix).replace("d'", " ").strip(" .*†‡§")
        if suffix not in _SUFFIX:
            suffix = suffix.removesuffix(" de").strip()
            if suffix not in _SUFFIX:
                return None
    unit = _SUFFIX[suffix]
    if m["after"]:
        if unit:
            return None
        unit = (PERCENT, 0)
    number = re.sub(r"[  ]", " ", m["number"])
    point = "." if language not in ("de", "es", "fr") else ","
    form = {"de": _DE, "es": _DE, "fr": _FR}.get(language, _EN)
    if not form.fullmatch(number):
        return None
    whole, _, rest = number.partition(point)
    digits = re.sub(r"\D", "", whole) + rest
    sign = -1 if m["open"] or m["open2"] or (m["sign"] or m["sign2"] or "+") not in "+" else 1
    stripped = digits.rstrip("0")
    power = len(digits) - len(stripped) - len(rest)
    stripped = stripped.lstrip("0")
    return (sign, stripped, power, unit) if stripped else None


def amount(read: tuple[int, str, int, Unit | None], unit: Unit) -> str:
    """The exact amount as a key: kind, sign, digits, power of ten."""
    sign, digits, power, _ = read
    return f"{unit[0]}{'-' if sign < 0 else '+'}{digits}e{power + unit[1]}"


#: Weights of the statements of a figure's own text, its row label, its column header and its table, and of none (ones).
WEIGHTS = (16.0, 12.0, 8.0, 4.0, 4.0)
#: Cost of a jump of the level by a power of ten, the most that a jump costs, cost of a switch of the unit.
JUMP, MOST_JUMP, SWITCH = 0.55, 1.6, 0.7


def viterbi(levels: list[float], statements: list[tuple[Unit | None, ...]], weights: tuple[float, ...] = WEIGHTS) -> list[Unit]:
    """The units of the readings of one device, from the log10 of each and what is stated of it, the closest first."""
    evidence: list[dict[Unit, float]] = []
    for stated in statements:
        of = {ONES: weights[-1]} if not any(stated) else {}
        for unit, weight in zip(stated, weights):
            if unit:
                of[unit] = max(of.get(unit, 0.0), weight)
        evidence.append(of)
    states = sorted({u for of in evidence for u in of} | {ONES})
    if all(len(of) == 1 for of in evidence) and len({u for of in evidence for u in of}) == 1:
        return [next(iter(of)) for of in evidence]
    score = {s: evidence[0].get(s, 0.0) for s in states}
    back: list[dict[Unit, Unit]] = []
    for i in range(1, len(levels)):
        step, new = {}, {}
        for s in states:
            here = levels[i] + s[1]
            best, best_score = s, -math.inf
            for p in states:
                cost = 0.0 if p == s else SWITCH
                if p[0] == s[0]:
                    cost += min(MOST_JUMP, JUMP * abs(here - levels[i - 1] - p[1]))
                if score[p] - cost > best_score:
                    best, best_score = p, score[p] - cost
            step[s], new[s] = best, best_score + evidence[i].get(s, 0.0)
        back.append(step)
        score = new
    at = max(states, key=score.__getitem__)
    path = [at]
    for step in reversed(back):
        at = step[at]
        path.append(at)
    return path[::-1]


def table_amounts(cells: list[tuple[int, int, int, str]], language: str, caption: str | None, before: str | None, candidates: list[tuple[str, str]], weights: tuple[float, ...] = WEIGHTS) -> list[tuple[int, str]]:
    """(cell_key, amount) of the body figures of one table; cells are (row, column, key, text)."""
    grid: dict[tuple[int, int], tuple[int, str]] = {}
    for row, column, key, text in cells:
        grid[row, column] = (key, text or "")
    rows: dict[int, list[int]] = {}
    for row, column in sorted(grid):
        rows.setdefault(row, []).append(column)
    columns = {c: header_unit(grid[0, c][1]) for c in rows.get(0, ()) if c > 0 and grid[0, c][1]}
    said = dict.fromkeys(("caption", "header", "row_stem", "preceding_text"))
    said["caption"] = declared(caption) if caption else None
    said["header"] = declared(grid[0, 0][1]) if (0, 0) in grid and grid[0, 0][1] else None
    for row, cs in rows.items():
        label = grid.get((row, 0), (0, ""))[1]
        if row and label and said["row_stem"] is None and not any(grid[row, c][1].strip() for c in cs if c):
            said["row_stem"] = declared(label)
    said["preceding_text"] = declares_before(before) if before else None
    # a declaration recorded beside the table, whose text the table itself no longer has
    for source, text in candidates:
        if source in ("caption", "header") and said.get(source) is None and not (source == "header" and any(columns.values())) and text:
            said[source] = declared(text)
    table_unit = next((unit for unit in said.values() if unit), None)
    out = []
    for row, cs in rows.items():
        if row == 0:
            continue
        label = grid.get((row, 0), (0, ""))[1]
        of_row = label_unit(label) if label else None
        reads, stated, keys = [], [], []
        for c in cs:
            if c == 0:
                continue
            key, text = grid[row, c]
            read = figure(text, language) if text else None
            if read:
                reads.append(read)
                stated.append((read[3], of_row, columns.get(c), table_unit))
                keys.append(key)
        if reads:
            units = viterbi([math.log10(float(r[1])) + r[2] for r in reads], stated, weights)
            out += [(key, amount(r, u)) for key, r, u in zip(keys, reads, units)]
    return out


def cell_amounts(cells: DataFrame, tables: DataFrame, blocks: DataFrame, pages: DataFrame, candidates: DataFrame) -> DataFrame:
    """doc_id, page_number, cell_key and amount of every body cell that holds a figure."""
    at = ["doc_id", "page_number", "block_ord"]
    # a group is one table of one page
    grouped = cells.groupBy(*at).agg(F.collect_list(F.struct(F.col("row_idx").alias("r"), F.col("col_idx").alias("c"), F.col("cell_key").alias("k"), F.col("text").alias("t"), F.coalesce("is_header", F.lit(False)).alias("h"))).alias("cells"))
    captions = tables.groupBy(*at).agg(F.max("caption").alias("caption"))
    before = blocks.select("doc_id", "page_number", (F.col("block_ord") + 1).alias("block_ord"), F.col("text").alias("before")).filter("before is not null").dropDuplicates(at)
    recorded = candidates.filter("source in ('caption', 'header')").groupBy(*at).agg(F.sort_array(F.collect_set(F.struct("candidate_ord", "source", "text"))).alias("recorded"))
    language = pages.groupBy("doc_id", "page_number").agg(F.max(F.lower(F.trim("language"))).alias("language"))
    whole = grouped.join(captions, at, "left").join(before, at, "left").join(recorded, at, "left").join(language, ["doc_id", "page_number"], "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs, page, _, cells_, captions_, before_, recorded_, languages = batch.columns
            inner = cells_.flatten()
            r, c, k, t, h = (inner.field(i).to_pylist() for i in range(5))
            offsets = cells_.offsets.to_pylist()
            base = offsets[0]
            doc_, page_, keys, amounts = [], [], [], []
            for i, (doc, number, caption, prior, found, lang) in enumerate(zip(docs.to_pylist(), page.to_pylist(), captions_.to_pylist(), before_.to_pylist(), recorded_.to_pylist(), languages.to_pylist())):
                a, b = offsets[i] - base, offsets[i + 1] - base
                rows = table_amounts(list(zip(r[a:b], c[a:b], k[a:b], t[a:b])), lang or "en", caption, prior, [(x["source"], x["text"]) for x in found or ()])
                header = {key for key, is_header in zip(k[a:b], h[a:b]) if is_header}
                for key, value in rows:
                    if key not in header:
                        doc_.append(doc)
                        page_.append(number)
                        keys.append(key)
                        amounts.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(doc_, pa.string()), pa.array(page_, pa.int32()), pa.array(keys, pa.int64()), pa.array(amounts, pa.string())], ["doc_id", "page_number", "cell_key", "amount"])

    order = whole.select("doc_id", "page_number", "block_ord", "cells", "caption", "before", "recorded", "language")
    return order.mapInArrow(run, "doc_id string, page_number int, cell_key bigint, amount string")


#: Fixed: spellings of a gold answer's scale.
SCALES: dict[str, Unit] = {
    "": ONES, "none": ONES, "thousand": (MONEY, 3), "thousands": (MONEY, 3), "k": (MONEY, 3), "million": (MONEY, 6), "millions": (MONEY, 6), "mn": (MONEY, 6), "m": (MONEY, 6),
    "billion": (MONEY, 9), "billions": (MONEY, 9), "bn": (MONEY, 9), "percent": (PERCENT, 0), "pct": (PERCENT, 0), "%": (PERCENT, 0),
}


def answer_amount(answer: str | None, scale: str | None) -> str | None:
    """The amount of an answer that is one figure, by the unit in its text, else by its scale."""
    read = figure(answer, "en") if answer else None
    unit = read and (read[3] or SCALES.get(folded(scale or "").strip().lower()))
    return amount(read, unit) if read and unit else None


def question_amounts(questions: DataFrame) -> DataFrame:
    """question_key, doc_id, page_number and amount of the questions whose answer is one figure."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [answer_amount(a, s) for a, s in zip(batch.column(3).to_pylist(), batch.column(4).to_pylist())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(values, pa.string())], ["question_key", "doc_id", "page_number", "amount"])

    kept = questions.select("question_key", F.col("doc_uid").alias("doc_id"), F.col("page").alias("page_number"), "answer", "scale").filter("answer rlike '[0-9]'")
    return kept.mapInArrow(run, "question_key bigint, doc_id string, page_number int, amount string").filter("amount is not null")


def found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """question_key, cell_key of each gold answer and each body cell of its page that record the same amount."""
    asked = question_amounts(table(spark, sf_dir, "gold_questions"))
    # only pages with such a question can have a pair
    pages_asked = asked.select("doc_id", "page_number").distinct()
    cells = table(spark, sf_dir, "raw_cells").join(pages_asked, ["doc_id", "page_number"], "left_semi")
    of = all_amounts(spark, sf_dir, cells)
    return asked.join(of, ["doc_id", "page_number", "amount"]).select("question_key", "cell_key").distinct()


def all_amounts(spark: SparkSession, sf_dir: str, cells: DataFrame | None = None) -> DataFrame:
    """The amounts of all body cells, or of those of ``cells``."""
    blocks = table(spark, sf_dir, "raw_blocks").filter("type is null or type <> 'table'")
    return cell_amounts(
        table(spark, sf_dir, "raw_cells") if cells is None else cells,
        table(spark, sf_dir, "raw_tables"),
        blocks,
        table(spark, sf_dir, "raw_pages"),
        table(spark, sf_dir, "scale_candidates"),
    )
