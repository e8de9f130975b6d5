"""Printed figures to values: sign, currency, unit, footnotes, all as Catalyst expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.functions.text import DASHES, NUMBERING, nfkc, squeeze

#: Fixed: currency signs and codes, in the order they are looked for.
SYMBOLS = {"$": "USD", "€": "EUR", "£": "GBP", "¥": "JPY", "₩": "KRW", "₹": "INR", "₽": "RUB", "₣": "FRF"}
#: Fixed: words that mean nothing here.
DASH_WORDS = ("n/a", "na", "nil", "none", "not applicable", "—", "–")
#: Fixed: a footnote mark, and a figure with its thousands grouped or not.
_MARKER = r"\s*(?:\([0-9a-z]{1,3}\)|[*†‡§]{1,3})"
_NUMBER = r"^[+-]?(?:\d{1,3}(?:[, ]\d{3})+|\d+)(?:\.\d+)?$"

VALUE = "struct<num:double,scaled:double,currency:string,unit:string,is_negative:boolean,negative_style:string,is_dash:boolean,footnote_refs:array<string>>"


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once.

    A lambda's variable is no alias that the optimizer could write out again, so
    chained steps stay as long as they are.
    """
    return F.get(F.transform(F.array(value), body), 0)


def _inside(text: Column) -> Column:
    """The text without its first and last character."""
    return F.trim(F.substring(text, F.lit(2), F.length(text) - 2))


def _symbol(text: Column) -> Column:
    """(code, rest): the currency sign a text begins or ends with, and the text without it."""
    code: Column = F.lit(None).cast("string")
    rest: Column = text
    for symbol, iso in reversed(SYMBOLS.items()):
        leads, trails = F.startswith(text, F.lit(symbol)), F.endswith(text, F.lit(symbol))
        code = F.when(leads | trails, iso).otherwise(code)
        rest = F.when(leads, F.trim(F.substring(text, F.lit(2), F.length(text)))).when(trails, F.trim(F.substring(text, F.lit(1), F.length(text) - 1))).otherwise(rest)
    return F.struct(code.alias("code"), rest.alias("rest"))


def value_of(text: Column, scale: Column, currency: Column) -> Column:
    """The value of a printed text under a table's scale and currency, as one expression."""
    wrapped = r"^\(.*\)$"
    trailing = f"(?i)^(.+?)((?:{_MARKER})+)\\s*$"

    def dash(x: Column) -> Column:
        bare = F.lower(F.regexp_replace(x, r"^[ .]+|[ .]+$", ""))
        return F.rlike(x, F.lit(f"^[{DASHES}]+$")) | bare.isin(*DASH_WORDS)

    def refs(marks: Column) -> Column:
        return F.transform(F.regexp_extract_all(marks, F.lit(f"(?i){_MARKER}"), F.lit(0)), lambda r: F.regexp_replace(F.trim(r), r"^\(|\)$", ""))

    def figure(x: Column, marks: Column, a: Column) -> Column:
        outer = F.rlike(a, F.lit(wrapped)) & (F.length(a) > 2)
        return _let(
            F.struct(outer.alias("outer"), F.when(outer, _inside(a)).otherwise(a).alias("b")),
            lambda s: _let(
                F.struct(s["outer"].alias("outer"), F.endswith(s["b"], F.lit("%")).alias("pct"), _symbol(F.when(F.endswith(s["b"], F.lit("%")), F.trim(F.substring(s["b"], F.lit(1), F.length(s["b"]) - 1))).otherwise(s["b"])).alias("sym")),
                lambda t: _let(
                    F.struct(t["outer"].alias("outer"), t["pct"].alias("pct"), t["sym"]["code"].alias("code"), t["sym"]["rest"].alias("d"), (~t["outer"] & F.rlike(t["sym"]["rest"], F.lit(wrapped)) & (F.length(t["sym"]["rest"]) > 2)).alias("inner")),
                    lambda u: _let(
                        F.struct((u["outer"] | u["inner"]).alias("paren"), u["pct"].alias("pct"), F.coalesce(u["code"], currency).alias("cur"), F.when(u["inner"], _inside(u["d"])).otherwise(u["d"]).alias("e")),
                        lambda v: F.when(
                            F.rlike(v["e"], F.lit(_NUMBER)),
                            _let(
                                F.struct(F.when(v["paren"], -F.abs(F.regexp_replace(v["e"], "[, ]", "").try_cast("double"))).otherwise(F.regexp_replace(v["e"], "[, ]", "").try_cast("double")).alias("num"), v["paren"].alias("paren"), v["pct"].alias("pct"), v["cur"].alias("cur")),
                                lambda w: F.struct(
                                    w["num"].alias("num"), F.when(w["pct"], w["num"]).otherwise(w["num"] * scale).alias("scaled"), w["cur"].alias("currency"),
                                    F.when(w["pct"], "percent").when(w["cur"].isNotNull(), "currency").alias("unit"), (w["num"] < 0).alias("is_negative"),
                                    F.when(w["paren"], "parentheses").when(w["num"] < 0, "minus").alias("negative_style"), F.lit(False).alias("is_dash"), refs(marks).alias("footnote_refs"),
                                ).cast(VALUE),
                            ),
                        ),
                    ),
                ),
            ),
        )

    nothing = F.struct(
        F.lit(None).cast("double").alias("num"), F.lit(None).cast("double").alias("scaled"), currency.alias("currency"), F.when(currency.isNotNull(), "currency").alias("unit"),
        F.lit(False).alias("is_negative"), F.lit(None).cast("string").alias("negative_style"), F.lit(True).alias("is_dash"), F.array().cast("array<string>").alias("footnote_refs"),
    ).cast(VALUE)
    return _let(
        squeeze(nfkc(text)),
        lambda x: F.when(x.isNull() | (x == ""), None)
        .when(dash(x), nothing)
        .otherwise(
            _let(
                F.struct(x.alias("x"), F.regexp_extract(x, trailing, 2).alias("marks")),
                lambda m: figure(m["x"], m["marks"], F.when(m["marks"] != "", F.trim(F.regexp_extract(m["x"], trailing, 1))).otherwise(m["x"])),
            )
        ),
    )


def parse_values(df: DataFrame, text: Column, scale: Column | None = None, currency: Column | None = None, out: str = "value") -> DataFrame:
    """``df`` with the value of ``text`` in ``out``: null if the text is no figure and no dash.

    ``scale`` and ``currency`` are those the table declares.  Percentages are
    never scaled; a negative in brackets keeps its style; a dash is no number.
    """
    by = F.lit(1.0) if scale is None else F.coalesce(scale, F.lit(1.0))
    return df.withColumn(out, value_of(text, by, F.lit(None).cast("string") if currency is None else currency))


def looks_numeric(value: Column) -> Column:
    """Whether a value is a figure rather than a dash or nothing."""
    return F.coalesce(value["num"].isNotNull(), F.lit(False))


def register(spark: SparkSession) -> None:
    """The scalar operators as SQL functions that stay Catalyst expressions."""
    made = {
        "furniture_key": "lower(trim(regexp_replace(regexp_replace(x, '(?U)\\\\d+', '#'), '(?U)\\\\s+', ' ')))",
        "numbering_depth": reduce(lambda rest, rule: f"CASE WHEN x RLIKE '(?iU)^\\\\s*{rule[0].replace(chr(92), chr(92) * 2)}' THEN {rule[1]} ELSE {rest} END", reversed(NUMBERING), "CAST(NULL AS INT)"),
    }
    kinds = {"furniture_key": "STRING", "numbering_depth": "INT"}
    for name, body in made.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(x STRING) RETURNS {kinds[name]} RETURN {body}")
