"""Text normal forms as Column expressions; only NFKC needs Python, and only for texts beyond ASCII."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fixed: characters that mean a dash.
DASHES = "-‐‑‒–—―−"


@F.pandas_udf(T.StringType())
def _nfkc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: unicodedata.normalize("NFKC", t), na_action="ignore")


def nfkc(text: Column) -> Column:
    """Compatibility composition; the worker only sees texts with a character beyond ASCII."""
    return F.coalesce(_nfkc(F.when(F.octet_length(text) > F.char_length(text), text)), text)


def squeeze(text: Column) -> Column:
    """White space runs of any script as one space, none at the ends."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def strip(text: Column) -> Column:
    """Without white space of any script at the ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def casefold(text: Column) -> Column:
    """Lower case, with the sharp s as two letters."""
    return F.replace(F.lower(text), F.lit("ß"), F.lit("ss"))


def normal(text: Column) -> Column:
    """The form both sides of a text comparison use: NFKC, dashes as hyphens, caseless, squeezed."""
    return squeeze(casefold(F.translate(nfkc(text), DASHES, "-" * len(DASHES))))


def furniture_key(text: Column) -> Column:
    """A line with its numbers masked, so that page numbers don't tell lines apart."""
    return casefold(squeeze(F.regexp_replace(text, r"(?U)\d+", "#")))


def split_kind(name: Column) -> Column:
    """train, dev or test of a split's name however it is spelled, null of another."""
    plain = F.regexp_replace(F.lower(name), r"(?U)[\s_-]+", "")
    return F.when(plain == "train", "train").when(plain.isin("dev", "validation"), "dev").when(plain.isin("test", "testgold"), "test")


#: Fixed: how a heading's numbering begins, and the depth it states; the first that fits holds.
NUMBERING = (
    (r"\d+\.\d+\.\d+[.)]?\s+", 3),
    (r"\d+\.\d+[.)]?\s+", 2),
    (r"\d+[.)]\s+", 1),
    (r"\(?[a-z]\)\s+", 3),
    (r"(?:PART|ITEM|NOTE|SECTION)\s+[IVXLC\d]+", 1),
)


def numbering_depth(text: Column) -> Column:
    """Depth of a heading's numbering, null if it has none."""
    out = F.lit(None).cast("int")
    for pattern, depth in reversed(NUMBERING):
        out = F.when(text.rlike(f"(?iU)^\\s*{pattern}"), depth).otherwise(out)
    return out
