"""Bringing texts that look alike to one spelling.

Only tokens (runs between ASCII white space) that hold a character of the
mapping tables are looked at, each distinct one once.  They are exploded to
positioned code points and joined with the broadcast mapping table (built by
rule from the Unicode data, a fixed size): invisible characters vanish, spaces
become the space, width and font variants and ligatures their plain letters.
Combining marks are ordered by class within their base and composed, any number of
them, by the public rule of canonical composition (a table of pairs, Hangul by
arithmetic), then the token is put together again.  A word whose
foreign letters all have a Latin look-alike, and a mixed word, becomes Latin; a
word wholly in another script stays.

Kept as they are: ASCII, Latin letters with an accent as one character, dashes
and minus signs, bullets, currency signs, footnote marks, fractions,
superscripts and signs such as the trade mark.

Edge cases: a null text stays null, an empty one empty; a token of nothing but
invisible characters becomes empty; texts sent twice count once.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioflow.functions.charmap import ALIKE, compositions, decompositions, joining, mappings, marks
from folioflow.session import saved, table

WHITE = r" \n\r\t"


@lru_cache(maxsize=1)
def suspicious() -> str:
    """A character class of all mapped characters and marks, as ranges."""
    points = sorted({ord(ch) for ch, *_ in mappings()} | {ord(ch) for ch, _ in marks()} | set(map(ord, joining())))
    spans: list[list[int]] = []
    for p in points:
        if spans and p == spans[-1][1] + 1:
            spans[-1][1] = p
        else:
            spans.append([p, p])
    return "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in spans)


def _tokens(text: Column) -> Column:
    """The tokens with a mapped character.

    Tokens beyond ASCII are taken first, each position of the text visited once;
    the long character class is tried on these only.
    """
    beyond = F.regexp_extract_all(text, F.lit(f"(?<![^{WHITE}])[\\x21-\\x7e]*+[^\\x00-\\x7f][^{WHITE}]*+"), F.lit(0))
    return F.filter(F.array_distinct(beyond), lambda token: token.rlike(f"[{suspicious()}]"))


def occurrences(items: DataFrame) -> DataFrame:
    """item_kind, item_key, item_pos and token, distinct, of the items (those columns and text) with a mapped character."""
    beyond = items.filter(F.octet_length("text") > F.char_length("text"))
    return beyond.select("item_kind", "item_key", "item_pos", F.explode(_tokens(F.col("text"))).alias("token")).distinct()


def _syllable(first: Column, second: Column) -> Column:
    """The Hangul syllable of a consonant and a vowel, or of a syllable and a final; null of others."""
    a, b = F.ascii(first), F.ascii(second)
    open_ = F.when(a.between(0x1100, 0x1112) & b.between(0x1161, 0x1175), 0xAC00 + ((a - 0x1100) * 21 + b - 0x1161) * 28)
    closed = F.when(a.between(0xAC00, 0xD7A3) & ((a - 0xAC00) % 28 == 0) & b.between(0x11A8, 0x11C2), a + b - 0x11A7)
    return F.decode(F.unhex(F.hex(F.coalesce(open_, closed).cast("bigint"))), "UTF-16BE")


def composed(run: Column) -> Column:
    """The text of an array of (class, character) in canonical order, canonically composed.

    Of the text so far the last starter, what follows it and the class before are
    kept: a character composes with the starter unless one of its own class or
    a higher one stands between.
    """
    pairs = F.create_map(*[F.lit(x) for pair in compositions() for x in pair])
    start = F.struct(F.lit("").alias("done"), F.lit("").alias("starter"), F.lit("").alias("rest"), F.lit(0).alias("last"))

    def step(state: Column, x: Column) -> Column:
        done, starter, rest, last, ch, ccc = state["done"], state["starter"], state["rest"], state["last"], x["ch"], x["ccc"]
        pair = F.concat(starter, ch)
        one = F.coalesce(F.try_element_at(pairs, pair), _syllable(starter, ch))
        free = (starter != "") & F.when(rest == "", F.lit(True)).otherwise((ccc > 0) & (last < ccc))
        both = F.struct(done.alias("done"), one.alias("starter"), rest.alias("rest"), last.alias("last"))
        begins = F.struct(F.concat(done, starter, rest).alias("done"), ch.alias("starter"), F.lit("").alias("rest"), F.lit(0).alias("last"))
        follows = F.struct(done.alias("done"), starter.alias("starter"), F.concat(rest, ch).alias("rest"), ccc.alias("last"))
        return F.when(free & one.isNotNull(), both).when(ccc == 0, begins).otherwise(follows)

    return F.aggregate(run, start, step, lambda state: F.concat(state["done"], state["starter"], state["rest"]))


def ordinary_tokens(tokens: DataFrame) -> DataFrame:
    """token and its ordinary spelling, for each distinct ``token``."""
    spark = tokens.sparkSession
    table_ = F.broadcast(spark.createDataFrame(mappings(), "ch string, to string, kind string"))
    classes = F.broadcast(spark.createDataFrame(marks(), "ch string, ccc int"))
    apart = F.broadcast(spark.createDataFrame(decompositions(), "ch string, parts string"))
    whole = tokens.select("token").distinct().select("token", F.posexplode(F.split("token", "")).alias("at", "ch")).join(apart, "ch", "left")
    # accents of a composed letter take part in the order of marks
    points = whole.select("token", "at", F.posexplode(F.split(F.coalesce("parts", "ch"), "")).alias("part", "ch")).select("token", F.struct("at", "part").alias("pos"), "ch")
    mapped = points.join(table_, "ch", "left").join(classes, "ch", "left").filter("kind is null or kind <> 'invisible'")
    # a mark belongs to the last character before it that is none
    in_order = Window.partitionBy("token").orderBy("pos")
    based = mapped.withColumn("ccc", F.coalesce("ccc", F.lit(0))).withColumn("base", F.sum(F.when(F.col("ccc") == 0, 1).otherwise(0)).over(in_order))
    keep = F.when(F.col("kind") == "alike", F.col("ch")).otherwise(F.coalesce("to", "ch"))
    runs = based.groupBy("token").agg(F.sort_array(F.collect_list(F.struct("base", "ccc", "pos", keep.alias("keep"), F.coalesce("to", "ch").alias("all"), F.col("ch").alias("own")))).alias("run"))
    built = runs.select("token", *[composed(F.transform("run", lambda x: F.struct(x["ccc"].alias("ccc"), x[side].alias("ch")))).alias(side) for side in ("keep", "all", "own")])
    # word by word: letters that have no Latin look-alike keep their word as it is
    runs = F.lit(r"[\p{L}\p{M}]+|[^\p{L}\p{M}]+")
    alike = "".join(a for a, _ in ALIKE)
    zipped = F.zip_with(
        F.regexp_extract_all("keep", runs, F.lit(0)),
        F.regexp_extract_all("all", runs, F.lit(0)),
        lambda kept, latin: F.when(kept.rlike(f"^[\\p{{IsLatin}}\\p{{M}}{alike}]+$"), latin).otherwise(kept),
    )
    # full-width signs are the ordinary ones within a script that is written wide
    wide = F.col("token").rlike(r"[\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsHangul}]") & ~F.col("token").rlike(r"[\x{ff10}-\x{ff19}\x{ff21}-\x{ff3a}\x{ff41}-\x{ff5a}A-Za-z]|\p{Cf}")
    return tokens.select("token").distinct().join(built, "token", "left").select("token", F.when(wide, F.col("own")).otherwise(F.coalesce(F.array_join(zipped, ""), F.lit(""))).alias("ordinary"))


def text_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text of cells, blocks and facts: item_kind, item_key, item_pos, text."""
    cells = table(spark, sf_dir, "raw_cells").select(F.lit("cell").alias("item_kind"), F.col("cell_key").alias("item_key"), F.lit(0).alias("item_pos"), "text")
    blocks = table(spark, sf_dir, "raw_blocks").select(F.lit("block").alias("item_kind"), F.col("block_key").alias("item_key"), F.lit(0).alias("item_pos"), "text")
    facts = table(spark, sf_dir, "gold_questions").select(F.lit("fact").alias("item_kind"), F.col("question_key").alias("item_key"), F.posexplode("facts").alias("item_pos", "text"))
    return cells.unionByName(blocks).unionByName(facts)


def found(items: DataFrame) -> DataFrame:
    """The items with a token whose ordinary spelling is another."""
    # small beside the items, read twice
    seen = saved(occurrences(items))
    changed = ordinary_tokens(seen).filter("ordinary <> token")
    return seen.join(changed, "token", "left_semi").select("item_kind", "item_key", "item_pos").distinct()


def normalised(items: DataFrame) -> DataFrame:
    """The items with their text in the ordinary spelling; an item is its kind, key and position."""
    seen = saved(occurrences(items))
    changed = ordinary_tokens(seen).filter("ordinary <> token")
    keys = ["item_kind", "item_key", "item_pos"]
    per_item = seen.join(changed, "token").groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("token", "ordinary"))).alias("spelling"))
    runs = F.regexp_extract_all("text", F.lit(f"[^{WHITE}]+|[{WHITE}]+"), F.lit(0))
    rebuilt = F.array_join(F.transform(runs, lambda x: F.coalesce(F.try_element_at("spelling", x), x)), "")
    return items.join(per_item, keys, "left").select(*keys, F.when(F.col("spelling").isNull(), F.col("text")).otherwise(rebuilt).alias("text"))
