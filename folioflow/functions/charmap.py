"""Tables of characters that look like others, built by rule from the Unicode data."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

#: Fixed: letters of other scripts and the Latin letters they look like, pairwise.
ALIKE = (
    # Cyrillic
    ("АВЕЅІЇЈКМНОРСТУХԌԚԜҮҺ", "ABESIÏJKMHOPCTYXGQWYH"),
    ("аеёѕіїјорсухһԁԛԝѵүӏ", "aeësiïjopcyxhdqwvyl"),
    # Greek
    ("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧϹ", "ABEZHIKMNOPTYXC"),
    ("αγικνορυχϲϳ", "ayikvopuxcj"),
    # Armenian
    ("ՏՍՕԼ", "SUOL"),
    ("ոօհսցզյ", "nohugqj"),
    # Latin letters of phonetic spelling
    ("ɑɡɩ", "agi"),
)
#: Fixed: signs that look like an ASCII sign.
SIGNS = ("‚․∕⁄∶꞉∗∣ǀǃʼ’‘“”＂", ",.//::*||!'''\"\"\"")
#: Decompositions that change the look only; others (super, sub, fraction, circle, square, ...) have a meaning.
LOOKS = {"<wide>", "<narrow>", "<font>", "<small>", "<noBreak>", "<isolated>", "<initial>", "<medial>", "<final>"}
#: Fixed: blocks of ligatures and of Roman numerals, whose <compat> decomposition looks the same.
COMPAT = ((0xFB00, 0xFB06), (0x2160, 0x217F))
#: Fixed: invisible characters that are no format characters; and letters that are signs of their own (litre, ohm, micro).
HIDDEN = (0x034F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x3164, 0xFFA0)
OWN = "ℓΩµℹ"


@lru_cache(maxsize=1)
def mappings() -> list[tuple[str, str, str]]:
    """(character, what it becomes, kind) by rule; kind is space, invisible, plain or alike. About 3,500 rows."""
    rows = {}
    # the planes between hold ideographs only, or nothing
    for cp in (*range(0x80, 0x30000), *range(0xE0000, 0xE0200)):
        ch = chr(cp)
        kind = unicodedata.category(ch)
        if ch in OWN or kind in ("Cn", "Cs", "Co"):
            continue
        if kind == "Zs":
            rows[ch] = (" ", "space")
        elif kind == "Cf" or cp in HIDDEN or 0xFE00 <= cp <= 0xFE0F or 0xE0100 <= cp <= 0xE01EF or (kind == "Cc" and cp != 0x85):
            rows[ch] = ("", "invisible")
        elif found := unicodedata.decomposition(ch):
            tag, *rest = found.split()
            if tag in LOOKS or any(a <= cp <= b for a, b in COMPAT) or (tag[0] != "<" and not rest and not 0xF900 <= cp <= 0xFAFF):
                to = unicodedata.normalize("NFKC", ch)
                if to != ch:
                    rows[ch] = (to, "plain")
            elif tag[0] != "<" and not 0xF900 <= cp <= 0xFAFF and unicodedata.normalize("NFC", ch) != ch:
                # characters that are never composed again
                rows[ch] = (unicodedata.normalize("NFC", ch), "plain")
    for foreign, latin in ALIKE:
        rows |= {a: (b, "alike") for a, b in zip(foreign, latin, strict=True)}
    rows |= {a: (b, "plain") for a, b in zip(*SIGNS, strict=True)}
    return [(ch, to, kind) for ch, (to, kind) in sorted(rows.items())]


@lru_cache(maxsize=1)
def marks() -> list[tuple[str, int]]:
    """Combining marks and their class."""
    return [(chr(cp), unicodedata.combining(chr(cp))) for cp in range(0x300, 0x1E950) if unicodedata.combining(chr(cp))]


@lru_cache(maxsize=1)
def compositions() -> list[tuple[str, str]]:
    """Pairs of a character and the one after it, and their one character, but for Hangul syllables. About 950 rows."""
    out = []
    for cp in (*range(0xC0, 0xAC00), *range(0xF900, 0x1F000)):
        found = unicodedata.decomposition(chr(cp))
        if found and found[0] != "<" and " " in found:
            pair = "".join(chr(int(x, 16)) for x in found.split())
            if unicodedata.normalize("NFC", pair) == chr(cp):
                out.append((pair, chr(cp)))
    return out


@lru_cache(maxsize=1)
def decompositions() -> list[tuple[str, str]]:
    """Each character that is composed, Hangul syllables left out, and its parts."""
    return [(one, unicodedata.normalize("NFD", one)) for _, one in compositions()]


def joining() -> set[str]:
    """Characters without a combining class that compose with the one before them, Hangul vowels and finals among them."""
    return {pair[1] for pair, _ in compositions() if not unicodedata.combining(pair[1])} | {chr(c) for c in (*range(0x1161, 0x1176), *range(0x11A8, 0x11C3))}


@lru_cache(maxsize=1)
def folding() -> dict[int, str]:
    """A table for str.translate that gives every mapped character its ordinary form."""
    return {ord(a): b for a, b, _ in mappings()}


def folded(text: str) -> str:
    """The text with mapped characters in their ordinary form, marks composed."""
    return text if text.isascii() else unicodedata.normalize("NFC", text.translate(folding()))
