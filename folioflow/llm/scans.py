"""Repairing the text of scanned pages into continuous paragraphs.

A page's blocks are gathered in one row, once; all that follows is narrow passes
over these rows and joins of small ones.

Counting.  One pass counts the words of all texts and the shapes of all short
lines (numbers and names masked), by type and by place on the page.  The most
frequent counts, up to ``KNOWN``, are broadcast; a text that asks for others gets
them by a join, so every count is used and nothing depends on ``KNOWN``.

Furniture.  A shape that stands almost only in headers and footers, by type or by
place, is furniture wherever it stands; bare numbers also need the place.

Words.  A text is a lattice over its stream of characters.  Its edges are words:
as they stand, with misrecognised characters (a fixed table of confusions), two
words run together, neighbours that a space breaks apart, neighbours on both
sides of a mark at the end of a line, as one word or as a compound.  An edge costs
the negative logarithm of its words' smoothed frequency and of what went wrong in
it; the cheapest path gives the text.  Where every token is a known word
that none of its variants outweighs, the path is the text itself.

A word cut at the end of a block or a page goes on in the next one: pages are
decoded apart, the last token of a page and the first of the next are joined
afterwards.

Paragraphs.  Boundaries between lines and blocks are chosen by dynamic programming
over the costs of breaking (in mid sentence), of joining (across a full stop, a
heading, a bullet) and of single lines; a paragraph may go on over pages.

Edge cases: null and blank texts have no defects; tables are left out; a block
sent twice counts once; a block without a box is judged by its shape alone; a
block without document or page number is a page of its own.
"""

from __future__ import annotations

import math
import re
import unicodedata
import uuid
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioflow.functions.charmap import mappings
from folioflow.session import parallelism, saved, table

#: Fixed: misrecognised characters and what they stand for.
CONFUSIONS = (
    ("0", "o"), ("1", "l"), ("1", "i"), ("!", "i"), ("!", "l"), ("|", "l"), ("|", "i"), ("5", "s"), ("8", "b"), ("9", "g"), ("6", "b"), ("†", "t"), ("£", "f"), ("€", "e"),
    ("l", "i"), ("i", "l"), ("rn", "m"), ("m", "rn"), ("m", "in"), ("m", "ni"), ("cl", "d"), ("d", "cl"), ("ii", "u"), ("ii", "n"), ("ri", "n"), ("n", "ri"), ("vv", "w"),
    ("w", "vv"), ("b", "h"), ("h", "b"), ("c", "e"), ("e", "c"), ("f", "t"), ("t", "f"), ("i", "r"), ("r", "i"), ("h", "ti"), ("h", "li"), ("li", "h"), ("n", "rt"), ("u", "n"),
    ("n", "u"), ("c", "o"), ("o", "c"), ("nn", "m"), ("iu", "m"), ("fi", "h"), ("j", "i"), ("tl", "d"), ("ct", "d"),
)
#: Fixed: letters that stand for digits within a figure.
DIGITS = {"O": "0", "o": "0", "l": "1", "I": "1", "!": "1", "|": "1", "S": "5", "s": "5", "B": "8", "Z": "2", "G": "6", "g": "9"}
#: How much more frequent a word must be than the token taken for its misreading: letters only, with other characters, in a name.
RATIO, ODD_RATIO, NAME_RATIO = 15.0, 6.0, 60.0
#: What an unseen word counts as, in general and in a name.
UNSEEN, UNSEEN_NAME = 0.2, 0.05
#: Costs of two words run together, of a word broken by a space, of a compound beside its rarer part.
SPLIT, MERGE, COMPOUND = 2.0, 4.0, 1.6
MARKS = "-=¬–‐­"
#: Rows of counts that are broadcast; the others are joined.
KNOWN = 200_000
#: Entries of a memo or a task's counters; they are emptied then.
MEMO = 1 << 19

_FOLD = {ord(a): b for a, b, _ in mappings()}


def _plain_class() -> str:
    """Characters that neither fold nor combine, as ranges."""
    plain = [c for c in range(0x2100) if c not in _FOLD and not unicodedata.combining(chr(c)) and unicodedata.category(chr(c)) != "Cn"]
    spans: list[list[int]] = []
    for c in plain:
        if spans and c == spans[-1][1] + 1:
            spans[-1][1] = c
        else:
            spans.append([c, c])
    return "".join(f"\\u{x:04x}-\\u{y:04x}" for x, y in spans)


_PLAIN = re.compile(f"[{_plain_class()}]*+")
_TOKEN = re.compile(r"[\w!|†£€]+")
_PAREN = re.compile(r"(?<![^\W_])[^\W_]*+\([^\W\d_]{2,}+(?![\w]*\))")
_FIGURE = re.compile(r"(?<![\w.,!|-])[$€£¥₹]?\s?([\dOolISsBZGg!|]++(?:[.,][\dOolISsBZGg!|]++)*+)(?=%|[.,;:)]?(?:\s|$)|[.,;:)])")
#: Without this a text has no figure with a letter in it.
_MIXED = re.compile(r"\d[.,]?[OolISsBZGg!|]|[OolISsBZGg!|][.,]?\d")
#: What may follow a figure and says that it is one.
_MAGNITUDE = re.compile(r"\s?%|\s(?:percent|per cent|Prozent|thousand|million|billion|trillion|Tausend|Mio|Mrd|Million(?:en)?|Milliarden?|mill(?:ier|ion|iard)s?|mil|mill(?:ón|ones))\b")
_GAP = re.compile(rf"[{MARKS}][ \t\r]*\n[ \t]*")
_CUT = re.compile(rf"[\w!|†£][{MARKS}][ \t\r]*\n[ \t]*[^\W_]")
_TAIL = re.compile(rf"(?<![\w!|†£])([\w!|†£]++)[{MARKS}]\s*$")
_HEAD = re.compile(r"\s*([^\W_][\w!|†£]*)")
_SPACE = re.compile(r"[ \t\r]*\n?[ \t]*")


def ordinary(text: str) -> str:
    """Look-alikes folded, accents composed."""
    if text.isascii() or _PLAIN.fullmatch(text):
        return text
    return unicodedata.normalize("NFC", text.translate(_FOLD))


class Reader:
    """Edges of the lattice and their costs, under counts of words."""

    def __init__(self, counts: dict[str, int], total: int = 0, lengths: set[int] | None = None) -> None:
        self.known = counts
        # the lengths that words have, for what none can be a misreading of
        self.lengths = {len(w) for w in counts} if lengths is None else lengths
        self.extra: dict[str, int] = {}
        self.scale = math.log(max(total or sum(counts.values()), 1))
        self.singles: dict[tuple[str, bool], tuple[float, str, bool, bool]] = {}
        self.sound: set[str] = set()
        self.rules: dict[str, list[tuple[str, str]]] = {}
        for wrong, right in CONFUSIONS:
            self.rules.setdefault(wrong[0], []).append((wrong, right))

    def count(self, word: str) -> int:
        return self.known.get(word) or self.extra.get(word, 0)

    def cost(self, word: str, unseen: float = UNSEEN) -> float:
        return self.scale - math.log(self.count(word) + unseen)

    def variants(self, token: str) -> set[str]:
        out = set()
        for i, c in enumerate(token):
            for wrong, right in self.rules.get(c, ()):
                if token.startswith(wrong, i):
                    out.add(token[:i] + right + token[i + len(wrong) :])
        return out

    def misread(self, token: str, name: bool = False) -> tuple[float, str | None]:
        """The cheapest word that the token is a misreading of; one confusion, in longer tokens two."""
        odd = not token.isalpha()
        if len(token) < 3 and not odd:
            return math.inf, None
        # a confusion changes a length by one at most
        size = len(token)
        if self.lengths.isdisjoint(range(size - 2, size + 3)):
            return math.inf, None
        unseen, ratio = (UNSEEN_NAME, NAME_RATIO) if name and not odd else (UNSEEN, ODD_RATIO if odd else RATIO)
        once = self.variants(token)
        best = max(((self.count(v), v) for v in once if v.isalpha()), default=(0, None))
        if best[0]:
            return self.scale - math.log(best[0] + unseen) + math.log(ratio), best[1]
        if not self.count(token) and (odd or len(token) >= 7) and not name:
            best = max(((self.count(v), v) for w in once for v in self.variants(w) if v != token and v.isalpha()), default=(0, None))
            if best[0]:
                return self.scale - math.log(best[0] + unseen) + 2 * math.log(ratio), best[1]
        return math.inf, None

    def single(self, token: str, name: bool = False) -> tuple[float, str, bool, bool]:
        """(cost, text, misread, unknown) of the cheapest edge over one token."""
        known = self.singles.get((token, name))
        if known is None:
            if len(self.singles) >= MEMO:
                self.singles.clear()
                self.sound.clear()
            known = self.singles[token, name] = self._single(token, name)
            if not name and known[1] == token and not known[3]:
                self.sound.add(token)
        return known

    def _single(self, token: str, name: bool) -> tuple[float, str, bool, bool]:
        plain = token.rstrip("!|€£†")
        size = len(token.rstrip("!|€£")) if plain and self.count(plain.lower()) else len(token)
        core, rest = token[:size], token[size:]
        letters, digits = sum(map(str.isalpha, core)), sum(map(str.isdigit, core))
        # figures, and fixed forms of a letter or two with digits (5G, CO2), are no words
        if not letters or (digits and letters < 3 and len(core) < 4):
            return 0.0, token, False, False
        lower = core.lower()
        own = self.cost(lower, UNSEEN_NAME if name and core.isalpha() else UNSEEN)
        cost, word = self.misread(lower, name)
        unknown = not self.count(lower)
        if word and cost < own:
            return cost, _restore(core, word) + rest, True, False
        if unknown and core.isalpha() and len(core) > 5:
            parted = min((self.cost(lower[:i]) + self.cost(lower[i:]) + SPLIT, i) for i in range(2, len(core) - 1))
            if parted[0] < own and len(lower) == len(core):
                return parted[0], f"{core[: parted[1]]} {core[parted[1] :]}{rest}", False, False
        return own, token, False, unknown

    def whole(self, left: str, right: str) -> tuple[float, str, bool]:
        """(cost, text, misread) of the cheapest edge over two tokens as one word."""
        token, lower = left + right, (left + right).lower()
        cost, word = self.misread(lower)
        own = self.cost(lower)
        return (cost, _restore(token, word), True) if word and cost < own else (own, token, False)

    def cut(self, left: str, right: str) -> tuple[float, str, bool] | None:
        """The edge over two tokens that a mark at a line's end cuts; None if the mark is their own."""
        a, b = left.lower(), right.lower()
        one, pair = self.whole(left, right), self.cost(f"{a}-{b}")
        known, compound = self.count(a + b), self.count(f"{a}-{b}")
        parts = max(self.cost(a), self.cost(b)) + COMPOUND
        if not known and not compound:
            # a capital begins a name's second part
            if right[0].isupper() and not (left.isupper() and right.isupper() and min(len(left), len(right)) < 4):
                return None
            return one if one[0] < parts else None
        return one if one[0] < pair else None

    def merged(self, left: str, right: str) -> tuple[float, str, bool] | None:
        """The edge over two tokens that a space breaks apart."""
        if not (left.isalpha() and right.isalpha() and (right.islower() or left.isupper())):
            return None
        lower = (left + right).lower()
        return (self.cost(lower) + MERGE, left + right, False) if self.count(lower) else None

    def bracket(self, token: str) -> bool:
        """Whether the bracket in a token is a misread c."""
        word, rest = token.replace("(", "c").lower(), token.partition("(")[2].lower()
        known = self.count(rest)
        return self.count(word) + UNSEEN >= RATIO * UNSEEN and not known


class _Noting(dict):
    """Counts that note the words they lack."""

    def __init__(self, known: dict) -> None:
        super().__init__()
        self.of, self.lacking = known, set()

    def get(self, key, default=None):
        found = self.of.get(key)
        if found is None:
            self.lacking.add(key)
        return found or default


def _figure_misread(figure: str, money: bool = False, measured: bool = False) -> str | None:
    """The figure meant, if letters stand among its digits; None if it is none or sound.

    ``money`` says that a currency sign stands before it, ``measured`` that a
    magnitude or percent follows; either makes it a figure, whatever its letters.
    """
    digits = sum(c.isdigit() for c in figure)
    letters = [c for c in figure if c in DIGITS]
    # the zeros of a magnitude (000s) are no figure
    if not digits or not letters or not figure.rstrip("sS").strip("0"):
        return None
    parts = re.split(r"[.,]", figure)
    plain = len(parts) == 1
    if plain:
        size = len(figure)
        if size < 3 and not set(letters) <= set("Ol|!"):
            return None
        if size == 2 and (figure[0] == "O" or figure[1] == "l"):
            return None
        if size >= 3 and digits * 2 < size:
            return None
        # a last letter may be a unit ($36B, $20s), unless one follows
        stated = measured or money and not (figure[-1] in "BGgsS" and figure[:-1].isdigit())
        if size > 4 and not set(letters) <= set("OlI") and not stated:
            return None
        if size == 3 and set(letters) & set("SsGgZB") and not stated:
            return None
    elif not all(1 <= len(p) <= 3 for p in parts):
        return None
    return "".join(DIGITS.get(c, c) for c in figure)


def _restore(token: str, word: str) -> str:
    if token[:1].isupper() or not token[:1].isalpha() and token[1:2].isupper():
        return word.upper() if token.isupper() and len(token) > 1 else word[0].upper() + word[1:]
    return word


def decode(reader: Reader, text: str, following: str | None = None, begins: str | None = None, skip: bool = False, open_end: bool = False) -> tuple[bool, bool, str, str | None]:
    """(a word is cut, something is misread, the repaired stream, the word that goes on) of a block.

    ``following`` is the text that comes next.  ``begins`` is the word that went
    on from the text before and now stands for this one's first token.  ``skip``
    leaves out of account the first token, ``open_end`` a cut last one, whose
    other halves stand on pages not known here.
    """
    text = ordinary(text)
    cut = misread = False
    if "(" in text:

        def unparen(m: re.Match) -> str:
            # a bracket read for a c: only within a word, or where no bracket closes
            nonlocal misread
            if reader.bracket(m.group()):
                misread = True
                return m.group().replace("(", "c")
            return m.group()

        text = _PAREN.sub(unparen, text)
    goes_on = None
    tail = _TAIL.search(text)
    if tail and any(map(str.isalpha, tail.group(1))):
        head = _HEAD.match(ordinary(following)) if following else None
        joined = reader.cut(tail.group(1), head.group(1)) if head else None
        if joined:
            cut, goes_on = True, joined[1]
            misread |= joined[2]
        reader.single(tail.group(1))
        if joined or open_end:
            text = text[: tail.start()]
    prefix = ""
    first = _HEAD.match(text) if begins is not None or skip else None
    if first:
        reader.single(first.group(1))
        prefix, text = begins if begins is not None else first.group(), text[first.end() :]
    unsound = set(_TOKEN.findall(text)) - reader.sound
    if unsound or _CUT.search(text):
        for token in unsound:
            reader.single(token)
        if not unsound <= reader.sound or _CUT.search(text):
            text, joined, wrong = _path(reader, text)
            cut |= joined
            misread |= wrong

    def amount(m: re.Match) -> str:
        nonlocal misread
        meant = _figure_misread(m.group(1), m.group()[0] in "$€£¥₹", bool(_MAGNITUDE.match(text, m.end())))
        if meant is None:
            return m.group()
        misread = True
        return m.group().replace(m.group(1), meant)

    # the substitution sets the flag, so it comes first
    whole = _FIGURE.sub(amount, text) if _MIXED.search(text) else text
    return cut, misread, prefix + whole, goes_on


def _path(reader: Reader, text: str) -> tuple[str, bool, bool]:
    """(the text of the cheapest path, a word was cut, something was misread)."""
    tokens = [(m.start(), m.end(), m.group()) for m in _TOKEN.finditer(text)]
    n = len(tokens)
    gaps = [text[tokens[i][1] : tokens[i + 1][0]] for i in range(n - 1)]
    ones = []
    for a, b, token in tokens:
        ones.append(reader.single(token, token[0].isupper() and "-" in text[max(0, a - 1) : a] + text[b : b + 1]))
    best: list[float] = [0.0] + [math.inf] * n
    # the number of tokens, the text, cut and misread of the edge that ends at each position
    back: list[tuple[int, str, bool, bool]] = [(0, "", False, False)] * (n + 1)
    for i in range(n):
        cost, out, wrong, unknown = ones[i]
        if best[i] + cost < best[i + 1]:
            best[i + 1], back[i + 1] = best[i] + cost, (1, out, False, wrong)
        if i + 1 == n:
            break
        left, right, gap = tokens[i][2], tokens[i + 1][2], gaps[i]
        if gap[:1] in MARKS and _GAP.fullmatch(gap):
            if not any(map(str.isalpha, left)) or not (right[0].isalnum()):
                continue
            joined = reader.cut(left, right)
            if joined:
                edge = (2, joined[1], True, joined[2])
                cost = joined[0]
            else:
                edge = (2, f"{out}-{ones[i + 1][1]}", False, wrong or ones[i + 1][2])
                cost = max(cost, ones[i + 1][0])
            if best[i] + cost < best[i + 2]:
                best[i + 2], back[i + 2] = best[i] + cost, edge
        elif (unknown or ones[i + 1][3]) and _SPACE.fullmatch(gap):
            joined = reader.merged(left, right)
            if joined and best[i] + joined[0] < best[i + 2]:
                best[i + 2], back[i + 2] = best[i] + joined[0], (2, joined[1], False, False)
    parts: list[str] = []
    cut = misread = False
    end = n
    while end:
        size, out, joined, wrong = back[end]
        parts += [text[tokens[end - 1][1] : tokens[end][0] if end < n else len(text)], out]
        cut, misread, end = cut or joined, misread or wrong, end - size
    parts.append(text[: tokens[0][0]] if n else text)
    return "".join(reversed(parts)), cut, misread


# furniture -------------------------------------------------------------------


def _letters(kind: str) -> str:
    return "".join(chr(c) for c in range(0x250) if unicodedata.category(chr(c)) == kind)


_NAME = re.compile("[{0}][{1}]+-[{0}][{1}]+|(?<!\\w)[{0}]{{3,}}-[{0}]{{3,}}(?!\\w)".format(_letters("Lu"), _letters("Ll")))
_NUMBER = re.compile(r"\b(?=[\dOlI!|SBZ]*\d)[\dOlI!|SBZ]+\b")
_ROMAN = re.compile(r"(?i)(?=[ivxlc])c{0,3}(?:xc|xl|l?x{0,3})(?:ix|iv|v?i{0,3})")
_BARE_LINE = re.compile(r"\s*[\dOlI]{1,3}\s*|\s*[ivxlc]{1,7}\s*")
#: Where headers end and footers begin, as shares of the page's height, on data without typed ones.
TOP, BOTTOM = 0.06, 0.88
HEADINGS = ("title", "section_header")


def shape(line: str) -> str:
    """The line with names and numbers masked, misread letters in numbers included."""
    text = " ".join(ordinary(line).split())
    if "-" in text:
        text = _NAME.sub("N", text)
    text = _NUMBER.sub("#", text)
    return "roman" if text and _ROMAN.fullmatch(text) else text


class Block:
    """A block of a page, and what its type and place say of it."""

    __slots__ = ("key", "order", "type", "text", "typed", "edge", "top", "placed", "titled", "single")

    def __init__(self, key: int, order: int, type_: str | None, y: float | None, font: float | None, text: str, height: float | None, zones: tuple[float, float]) -> None:
        self.key, self.order, self.type, self.text = key, order, type_, text
        self.typed = type_ in ("page_header", "page_footer")
        self.placed = y is not None and bool(height)
        self.top = self.placed and y < zones[0] * height
        self.edge = self.top or self.placed and y >= zones[1] * height
        self.titled = type_ == "title" or (font or 0.0) > 15
        self.single = "\n" not in text.strip(" ")


Item = tuple[int, int, str, float, float, str]


def page_blocks(items: list[Item], height: float | None, zones: tuple[float, float]) -> list[Block]:
    """The blocks of a page in order, each once; an item has the fields of ``_pages``."""
    seen = {b[0]: b for b in reversed(items)}
    ordered = sorted(seen.values(), key=lambda b: (-1 if b[1] is None else b[1], -1 if b[0] is None else b[0]))
    return [Block(*b, height, zones) for b in ordered]


def _rows(batch: pa.RecordBatch) -> Iterator[tuple]:
    """The columns of each page, its blocks as items."""
    *columns, blocks, more = batch.columns
    fields = list(zip(*(f.to_pylist() for f in blocks.flatten().flatten())))
    offsets = blocks.offsets.to_pylist()
    others = more.to_pylist() if more.null_count < len(more) else [None] * len(more)
    for i, (*row, extra) in enumerate(zip(*(c.to_pylist() for c in columns), others)):
        yield *row, fields[offsets[i] - offsets[0] : offsets[i + 1] - offsets[0]], extra


def furniture(blocks: list[Block], shapes, sizes: set[int] | None = None) -> list[tuple[bool, list[int]]]:
    """(is furniture, its furniture lines) of each block; ``shapes`` gives the share of each shape in headers and footers, by ``get``.

    ``sizes`` are the numbers of words that any of these shapes has: masks keep
    it, so a line of another number needs no shape.
    """
    out = []
    for b in blocks:
        if b.typed:
            out.append((True, []))
        elif b.single:
            is_ = shape(b.text) if sizes is None or len(ordinary(b.text).split()) in sizes else ""
            share = shapes.get(is_, 0.0) if is_ else 0.0
            if share:
                one = b.edge or not b.titled and is_ not in ("#", "roman") and share >= 0.75 and (not b.placed or "#" in is_)
            else:
                one = False
            # at the very top nothing else is set in one line that is no sentence
            out.append((bool(one or b.top and not _ENDS.search(b.text.rstrip())), []))
        else:
            lines = b.text.split("\n")
            drop = []
            inked = [i for i, line in enumerate(lines) if line and not line.isspace()]
            for i in inked:
                line = lines[i]
                if sizes is not None and len(ordinary(line).split()) not in sizes:
                    continue
                is_ = shape(line)
                bare = is_ in ("#", "roman")
                if bare and not (i in (inked[0], inked[-1]) and _BARE_LINE.fullmatch(line)):
                    continue
                share = shapes.get(is_, 0.0)
                if share >= 0.75 or bare and share:
                    drop.append(i)
            out.append((False, drop))
    return out


# the whole ---------------------------------------------------------------------

PAGE = ["doc_id", "page_number", "alone"]
MORE = "array<struct<kind:string,key:string,n:bigint,share:double>>"


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, page_number, alone (the block without either), height and the blocks of each page."""
    heights = table(spark, sf_dir, "raw_pages").groupBy("doc_id", "page_number").agg(F.max("height").alias("height"))
    blocks = table(spark, sf_dir, "raw_blocks").filter("text is not null and trim(text) <> '' and (type is null or type <> 'table')")
    alone = F.when(F.col("doc_id").isNull() | F.col("page_number").isNull(), F.col("block_key"))
    item = F.struct("block_key", "block_ord", "type", F.col("bbox.y0").cast("double").alias("y"), F.col("font_size").cast("double").alias("font_size"), "text")
    # reading is work beside its bytes: a fixed number of partitions is not coalesced by size
    pages = blocks.select("doc_id", "page_number", alone.alias("alone"), item.alias("item")).repartition(parallelism(spark), *PAGE).groupBy(*PAGE).agg(F.collect_list("item").alias("blocks"))
    return saved(pages.join(heights, ["doc_id", "page_number"], "left").select(*PAGE, "height", "blocks"))


def _zones(spark: SparkSession, sf_dir: str) -> tuple[float, float]:
    """Where headers end and footers begin: as far again as most typed headers stand, a line above most typed footers."""
    heights = table(spark, sf_dir, "raw_pages").groupBy("doc_id", "page_number").agg(F.max("height").alias("height"))
    y = F.col("y0") / F.col("height")
    blocks = table(spark, sf_dir, "raw_blocks").select("doc_id", "page_number", "type", F.col("bbox.y0").alias("y0"))
    typed = blocks.filter("type in ('page_header', 'page_footer') and y0 is not null").join(heights.filter("height > 0"), ["doc_id", "page_number"])
    at = typed.agg(F.percentile_approx(F.when(F.col("type") == "page_header", y), 0.95).alias("top"), F.percentile_approx(F.when(F.col("type") == "page_footer", y), 0.05).alias("bottom")).collect()[0]
    return (TOP if at["top"] is None else 2 * at["top"], BOTTOM if at["bottom"] is None else at["bottom"] - 0.02)


_UNCUT = re.compile(rf"(?<![^\W_])[^\W_]++[{MARKS}][ \t\r]*(?:\n\s*[^\W_]+|\s*$)")
_WORD = re.compile(r"(?<![\w!|†£])[^\W\d_]+(?:-[^\W\d_]+)*(?![\w!|†£])")


def counted(pages: DataFrame, zones: tuple[float, float]) -> DataFrame:
    """kind (word or shape), key and n of words seen twice or more, and share of shapes of headers and footers."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw: Counter[str] = Counter()
        shapes: dict[str, list[int]] = {}

        def rows() -> pa.RecordBatch:
            words: Counter[str] = Counter()
            for token, n in raw.items():
                for word in _WORD.findall(token):
                    words[word] += n
                    if "-" in word:
                        for part in word.split("-"):
                            words[part] += n
            out = [("word", w, n, 0, 0) for w, n in words.items()] + [("shape", s, *v) for s, v in shapes.items()]
            types = (pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(types)], ["kind", "key", "n", "edge", "typed"])

        for batch in batches:
            for *_, height, items, _ in _rows(batch):
                for b in page_blocks(items, height, zones):
                    lower = b.text.lower()
                    raw.update((_UNCUT.sub(" ", lower) if "\n" in lower or lower.rstrip()[-1] in MARKS else lower).split())
                    if b.single and not b.titled and (is_ := shape(b.text)):
                        seen = shapes.setdefault(is_, [0, 0, 0])
                        seen[0] += 1
                        seen[1] += b.typed or b.edge
                        seen[2] += b.typed
            if len(raw) + len(shapes) >= MEMO:
                yield rows()
                raw.clear()
                shapes.clear()
        yield rows()

    sums = pages.select(*PAGE, "height", "blocks", F.lit(None).cast(MORE).alias("more")).mapInArrow(count, "kind string, key string, n bigint, edge bigint, typed bigint").groupBy("kind", "key").agg(*[F.sum(c).alias(c) for c in ("n", "edge", "typed")])
    share = F.when(F.col("kind") == "shape", F.col("edge") / F.col("n")).otherwise(1.0)
    return saved(sums.select("kind", "key", "n", share.alias("share"), "typed").filter("(kind = 'word' and n >= 2) or (typed >= 1 and share >= 0.3)").select("kind", "key", "n", "share"))


class Counts:
    """The most frequent counts, sent to all workers, and the sum of all words."""

    def __init__(self, counts: DataFrame, most: int) -> None:
        rows = counts.orderBy(F.desc("n"), "kind", "key").limit(most).collect()
        self.words = {r["key"]: r["n"] for r in rows if r["kind"] == "word"}
        self.shapes = {r["key"]: r["share"] for r in rows if r["kind"] == "shape"}
        whole = counts.filter("kind = 'word'").agg(F.sum("n").alias("total"), F.collect_set(F.length("key")).alias("lengths")).collect()[0]
        # of all shapes, also of those not sent
        self.sizes = set(counts.filter("kind = 'shape'").agg(F.collect_set(F.size(F.split("key", " ")))).collect()[0][0])
        self.total, self.lengths = whole["total"] or 0, set(whole["lengths"])


_readers: dict[str, Reader] = {}


class Tools:
    """What a worker needs: the broadcast counts and the zones of a page; ``others`` are the counts beyond."""

    def __init__(self, sent, zones: tuple[float, float]) -> None:
        self.sent, self.zones, self.name = sent, zones, uuid.uuid4().hex

    def reader(self) -> Reader:
        """The worker's reader; what it has read before serves its later tasks."""
        if self.name not in _readers:
            _readers.clear()
            _readers[self.name] = Reader(self.sent.value.words, self.sent.value.total, self.sent.value.lengths)
        return _readers[self.name]

    def page(self, items: list[Item], height: float | None, shapes) -> tuple[list[Block], list[tuple[bool, list[int]]]]:
        blocks = page_blocks(items, height, self.zones)
        return blocks, furniture(blocks, shapes, self.sent.value.sizes)




def _prepared(spark: SparkSession, sf_dir: str, known: int) -> tuple[DataFrame, Tools, DataFrame | None]:
    """The pages with the counts that they need beyond those broadcast, what a worker needs, and the other counts."""
    pages, zones = _pages(spark, sf_dir), _zones(spark, sf_dir)
    counts = counted(pages, zones)
    tools = Tools(spark.sparkContext.broadcast(Counts(counts, known)), zones)
    pages = pages.withColumn("more", F.lit(None).cast(MORE))
    if counts.count() <= known:
        return pages, tools, None
    others = saved(counts.join(counts.orderBy(F.desc("n"), "kind", "key").limit(known).select("kind", "key"), ["kind", "key"], "left_anti"))
    # shapes first: which lines are furniture decides what words meet
    for kind in ("shape", "word"):
        pages = saved(_with_counts(pages, others.filter(F.col("kind") == kind), kind, tools))
    return pages, tools, others


def _with_counts(pages: DataFrame, others: DataFrame, kind: str, tools: Tools) -> DataFrame:
    """The pages with the counts they ask for among ``others``."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = tools.reader()
        for batch in batches:
            out: list[tuple] = []
            for doc, page, alone, height, items, more in _rows(batch):
                shapes, words = _Noting(tools.sent.value.shapes | _more(more, "shape")), _Noting(reader.known)
                blocks, marks = tools.page(items, height, shapes)
                if kind == "word":
                    asking = Reader({}, 1, tools.sent.value.lengths)
                    asking.known = words
                    decoded(asking, blocks, marks)
                out += [(doc, page, alone, key) for key in sorted((words if kind == "word" else shapes).lacking)]
            yield _batch(out, (pa.string(), pa.int32(), pa.int64(), pa.string()), [*PAGE, "key"])

    asked = pages.select(*PAGE, "height", "blocks", "more").mapInArrow(ask, "doc_id string, page_number int, alone bigint, key string")
    given = asked.join(others, "key").groupBy(*[F.col(c).alias(f"{c}_") for c in PAGE]).agg(F.collect_list(F.struct("kind", "key", "n", "share")).alias("given"))
    same = [F.col(c).eqNullSafe(F.col(f"{c}_")) for c in PAGE]
    none = F.array().cast(MORE)
    return pages.join(given, same, "left").select(*PAGE, "height", "blocks", F.concat(F.coalesce("more", none), F.coalesce("given", none)).alias("more"))


def _batch(rows: list[tuple], types: tuple, names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names)


def _more(rows: list[dict] | None, kind: str) -> dict:
    return {r["key"]: r["n" if kind == "word" else "share"] for r in rows or () if r["kind"] == kind}


class Decoded:
    """A block of a page that is no furniture, decoded; ``begins`` is the word that goes on from the block before."""

    __slots__ = ("block", "body", "begins", "cut", "misread", "text")

    def __init__(self, block: Block, body: str, begins: str | None) -> None:
        self.block, self.body, self.begins = block, body, begins

    def mask(self, reader: Reader, first: bool, last: bool) -> tuple[str | None, str | None, int]:
        """(the page's first word, the cut word at its end, misread or not as bits: as it stands, without the one, the other, both)."""
        body = ordinary(self.body)
        head = _HEAD.match(body) if first else None
        tail = _TAIL.search(body) if last else None
        tail = tail if tail and any(map(str.isalpha, tail.group(1))) else None
        bits = 15 * self.misread
        if self.misread and (head or tail):
            bits = sum(decode(reader, self.body, None, self.begins, bool(skip and head), bool(end and tail))[1] << (skip + 2 * end) for skip in (0, 1) for end in (0, 1))
        return head and head.group(1), tail and tail.group(1), bits


def decoded(reader: Reader, blocks: list[Block], marks: list[tuple[bool, list[int]]]) -> list[Decoded]:
    """The blocks of a page that are no furniture, in order, furniture lines left out."""
    bodies = []
    for b, (is_one, drop) in zip(blocks, marks):
        if not is_one:
            bodies.append((b, "\n".join(t for i, t in enumerate(b.text.split("\n")) if i not in drop) if drop else b.text))
    out, begins = [], None
    for i, (b, body) in enumerate(bodies):
        one = Decoded(b, body, begins)
        one.cut, one.misread, one.text, begins = decode(reader, body, bodies[i + 1][1] if i + 1 < len(bodies) else None, begins)
        out.append(one)
    return out


def _defects(pages: DataFrame, tools: Tools) -> DataFrame:
    """The defects of each block that has one or that its page begins or ends with (head, tail: the words there)."""
    types = {"block_key": pa.int64(), "doc_id": pa.string(), "page_number": pa.int32(), "cut": pa.bool_(), "furniture": pa.bool_(), "line": pa.bool_(), "misread": pa.int32(), "head": pa.string(), "tail": pa.string()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, shapes = tools.reader(), tools.sent.value.shapes
        for batch in batches:
            out: list[tuple] = []
            for doc, page, _, height, items, more in _rows(batch):
                reader.extra = _more(more, "word")
                blocks, marks = tools.page(items, height, shapes | _more(more, "shape") if more else shapes)
                out += [(b.key, doc, page, False, True, False, 0, None, None) for b, (one, _) in zip(blocks, marks) if one and not b.typed]
                with_line = {b.key for b, (_, drop) in zip(blocks, marks) if drop}
                rows = decoded(reader, blocks, marks)
                for i, x in enumerate(rows):
                    head, tail, bits = x.mask(reader, i == 0, i == len(rows) - 1)
                    line = x.block.key in with_line
                    if x.cut or bits or line or head or tail:
                        out.append((x.block.key, doc, page, x.cut, False, line, bits, head, tail))
            yield _batch(out, tuple(types.values()), list(types))

    return pages.select(*PAGE, "height", "blocks", "more").mapInArrow(run, "block_key bigint, doc_id string, page_number int, cut boolean, furniture boolean, line boolean, misread int, head string, tail string")


def _joined(tails: DataFrame, heads: DataFrame, tools: Tools, others: DataFrame | None) -> DataFrame:
    """doc_id, page_number and ``whole`` where the cut word at a page's end (tail) and the next page's first word (head) are one."""
    at = ["doc_id", "page_number"]
    met = tails.select("doc_id", "page_number", "tail").join(heads.select("doc_id", (F.col("page_number") - 1).alias("page_number"), "head"), at)
    met = met.withColumn("more", F.lit(None).cast(MORE))
    if others is not None:

        def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                out = []
                for doc, page, tail, head in zip(*(c.to_pylist() for c in batch.columns)):
                    asking = Reader({}, 1, tools.sent.value.lengths)
                    asking.known = _Noting(tools.sent.value.words)
                    asking.cut(tail, head)
                    out += [(doc, page, key) for key in sorted(asking.known.lacking)]
                yield _batch(out, (pa.string(), pa.int32(), pa.string()), [*at, "key"])

        met = saved(met)
        given = met.select(*at, "tail", "head").mapInArrow(ask, "doc_id string, page_number int, key string").join(others.filter("kind = 'word'"), "key")
        met = met.drop("more").join(given.groupBy(*at).agg(F.collect_list(F.struct("kind", "key", "n", "share")).alias("more")), at, "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = tools.reader()
        for batch in batches:
            out = []
            for doc, page, tail, head, more in zip(*(c.to_pylist() for c in batch.columns)):
                reader.extra = _more(more, "word")
                one = reader.cut(tail, head)
                if one:
                    out.append((doc, page, one[1]))
            yield _batch(out, (pa.string(), pa.int32(), pa.string()), [*at, "whole"])

    return met.select(*at, "tail", "head", "more").mapInArrow(run, "doc_id string, page_number int, whole string")


def found(spark: SparkSession, sf_dir: str, known: int = KNOWN) -> DataFrame:
    """block_key and defect, a row for each defect of each block; ``known`` counts are broadcast, the others joined."""
    pages, tools, others = _prepared(spark, sf_dir, known)
    rows = saved(_defects(pages, tools))
    joined = saved(_joined(rows.filter("tail is not null"), rows.filter("head is not null"), tools, others))
    ends = joined.select("doc_id", "page_number", F.lit(True).alias("ends"))
    begins = joined.select("doc_id", (F.col("page_number") + 1).alias("page_number"), F.lit(True).alias("begins"))
    known_ends = rows.join(ends, ["doc_id", "page_number"], "left").join(begins, ["doc_id", "page_number"], "left")
    ends_here = F.col("tail").isNotNull() & F.col("ends").isNotNull()
    bit = F.when(F.col("head").isNotNull() & F.col("begins").isNotNull(), 1).otherwise(0) + F.when(ends_here, 2).otherwise(0)
    defects = F.array(
        F.when(F.col("cut") | ends_here, F.lit("hyphen")),
        F.when(F.element_at(F.transform(F.array(*map(F.lit, range(4))), lambda i: F.expr("misread").bitwiseAND(F.pow(F.lit(2), i).cast("int")) > 0), bit + 1), F.lit("misread")),
        F.when(F.col("furniture"), F.lit("furniture")),
        F.when(F.col("line"), F.lit("furniture_line")),
    )
    return known_ends.select("block_key", F.explode(F.array_compact(defects)).alias("defect")).distinct()


# paragraphs ----------------------------------------------------------------------

_ENDS = re.compile(r"[.!?:][\"'”’)\]]*$")
_ITEM = re.compile(r"^\s*(?:[•*·–-]\s|\(?[a-z0-9]{1,3}[.)]\s)")
#: A short line that is neither heading nor item seldom stands alone.
LONE = 0.3


def paragraphs_of(lines: list[tuple[str, bool, bool]]) -> list[str]:
    """Paragraphs of a page's lines ``(text, first of its block, heading)``, boundaries by dynamic programming.

    A boundary costs more within a sentence, a join more across an end of one, a
    short line alone costs too; of each line the least cost is kept with and
    without a boundary before it.
    """
    n = len(lines)
    if not n:
        return []
    usual = sorted(len(t) for t, *_ in lines)[n // 2]
    lone = [LONE * (not h and not _ITEM.match(t) and 2 * len(t) < usual) for t, _, h in lines]
    with_, without = [0.0], [math.inf]
    back: list[tuple[bool, bool]] = [(True, True)]
    for i in range(1, n):
        (before, _, head), (text, first, heading) = lines[i - 1], lines[i]
        ended = bool(_ENDS.search(before.rstrip()))
        item = bool(_ITEM.match(text))
        upper = text.lstrip()[:1].isupper() or item
        join = 6.0 * (head or heading) + 3.0 * item + 2.0 * (first and ended) + 1.0 * (ended and len(before) < 0.7 * usual) + 0.5 * (first and upper)
        break_ = 0.2 + 2.5 * (not ended and not head) + 1.5 * (not upper) + 0.8 * (not first)
        alone = with_[-1] + lone[i - 1]
        back.append((alone <= without[-1], with_[-1] <= without[-1]))
        new = min(alone, without[-1]) + break_, min(with_[-1], without[-1]) + join
        with_.append(new[0])
        without.append(new[1])
    starts, here = [], with_[-1] + lone[-1] <= without[-1]
    for i in range(n - 1, -1, -1):
        if here or not i:
            starts.append(i)
        here = back[i][0 if here else 1]
    starts = [*starts[::-1], n]
    return [re.sub(r"\s+", " ", " ".join(t for t, *_ in lines[a:b])).strip() for a, b in zip(starts, starts[1:])]


def paragraphs(spark: SparkSession, sf_dir: str, known: int = KNOWN) -> DataFrame:
    """doc_id, page_number, paragraph (from 0) and text, furniture removed, words whole.

    A paragraph that goes on over pages stands on the page where it begins; the
    others keep their numbers.
    """
    pages, tools, others = _prepared(spark, sf_dir, known)
    names = ["doc_id", "page_number", "paragraph", "text", "first", "last", "open", "head", "tail"]
    types = (pa.string(), pa.int32(), pa.int32(), pa.string(), pa.bool_(), pa.bool_(), pa.bool_(), pa.string(), pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, shapes = tools.reader(), tools.sent.value.shapes
        for batch in batches:
            out: list[tuple] = []
            for doc, page, _, height, items, more in _rows(batch):
                reader.extra = _more(more, "word")
                rows = decoded(reader, *tools.page(items, height, shapes | _more(more, "shape") if more else shapes))
                lines = []
                for x in rows:
                    heading = x.block.type in HEADINGS
                    lines += [(t, not i, heading) for i, t in enumerate(t for t in x.text.split("\n") if t.strip())]
                made = paragraphs_of(lines)
                for i, text in enumerate(made):
                    first, last = not i, i == len(made) - 1
                    head, tail, _ = rows[0 if first else -1].mask(reader, first, False)[0], rows[-1].mask(reader, False, last)[1], 0
                    # text that may go on: after no heading and no end of a sentence, before a small letter
                    open_ = last and not lines[-1][2] and not _ENDS.search(text)
                    begins = head if first and not lines[0][2] and text[:1].islower() else None
                    out.append((doc, page, i, text, first, last, open_, begins, tail))
            yield _batch(out, types, names)

    rows = saved(pages.select(*PAGE, "height", "blocks", "more").mapInArrow(run, "doc_id string, page_number int, paragraph int, text string, first boolean, last boolean, open boolean, head string, tail string"))
    tails, heads = rows.filter("last and open"), rows.filter("first and head is not null")
    whole = _joined(tails.filter("tail is not null"), heads, tools, others)
    over = tails.select("doc_id", "page_number").join(heads.select("doc_id", (F.col("page_number") - 1).alias("page_number")), ["doc_id", "page_number"]).join(whole, ["doc_id", "page_number"], "left")
    after = over.select("doc_id", (F.col("page_number") + 1).alias("page_number"), F.lit(True).alias("goes_on"), "whole")
    before = over.select("doc_id", "page_number", F.lit(True).alias("runs_over"))
    ends = rows.filter("first or last").join(after, ["doc_id", "page_number"], "left").join(before, ["doc_id", "page_number"], "left")
    goes_on, runs_over = F.col("first") & F.col("goes_on").isNotNull(), F.col("last") & F.col("runs_over").isNotNull()
    parts = ends.select("doc_id", "page_number", "paragraph", "text", goes_on.alias("goes_on"), F.when(goes_on, F.col("whole")).alias("whole"), runs_over.alias("runs_over")).filter("goes_on or runs_over")
    # a row for each page whose text runs over, however long the document
    in_order = Window.partitionBy("doc_id").orderBy("page_number", "paragraph")
    chains = saved(parts.withColumn("chain", F.sum(F.when(F.col("goes_on"), 0).otherwise(1)).over(in_order)))
    grouped = chains.groupBy("doc_id", "chain").agg(F.sort_array(F.collect_list(F.struct("page_number", "paragraph", "text", "whole"))).alias("parts"))

    def stitch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc, parts_ in zip(*(c.to_pylist() for c in batch.columns)):
                text = parts_[0]["text"]
                for part in parts_[1:]:
                    if part["whole"]:
                        tail, head = _TAIL.search(text), _HEAD.match(part["text"])
                        text = text[: tail.start()] + part["whole"] + part["text"][head.end() :] if tail and head else f"{text} {part['text']}"
                    else:
                        text = f"{text} {part['text']}"
                out.append((doc, parts_[0]["page_number"], parts_[0]["paragraph"], text))
            yield _batch(out, types[:4], names[:4])

    merged = grouped.select("doc_id", "parts").mapInArrow(stitch, "doc_id string, page_number int, paragraph int, text string")
    alone = rows.join(chains.select("doc_id", "page_number", "paragraph"), ["doc_id", "page_number", "paragraph"], "left_anti")
    return alone.select(*names[:4]).unionByName(merged)
