import random

from folioflow.llm import junk, scans

PROSE = [
    "The carrying amount of goodwill was $12 million at December 31, 2015, in line with our expectations.", "Management reviews revenue at each reporting date and adjusts the estimate when circumstances change.",
    "Changes in inventories were driven by a change in the product mix and by the timing of customer shipments.", "No single customer accounted for more than 12.5% of trade receivables in either period.",
    "The auditors obtained sufficient evidence regarding the valuation of long-term debt held by the company.", "Our long-term objectives depend on currency movements, and the year-end position reflects that dependency.",
]
SCHEMA = "doc_id bigint, text string, lang string, extra int"


def test_junk(spark):
    rng = random.Random(4)
    prose = [" ".join(rng.sample(PROSE, 5)) + f" See note {i}." for i in range(150)]
    junk_texts = [
        "\n".join(rng.choice(["ratio cheat sheet", "stock screener", "tax table calculator"]) for _ in range(60)), "\n".join(f"https://site{i}.test/cash-flow-{i}" for i in range(40)),
        "Tags: audit-checklist, ledger-app, stock-screener, ledger-app\n" * 12, " ".join(rng.choice(["download", "template", "free", "report"]) for _ in range(150)),
    ]
    sound = [
        "\n".join(f"Exhibit {i}.1  Agreement dated 20{i:02d} between Lenren-Lamel and Lanes-Dr{i}, filed with the report for 2019" for i in range(10, 25)), "\n".join(f"| item {i} | {i * 37} | {i * 91} |" for i in range(30)),
        "\n".join(f"{i}. Leases and other matters ............ {i * 3}" for i in range(1, 20)), PROSE[0] + "\nhttps://a.test/x", "short", "", None, "   ",
    ]
    rows = [(i, t, "en", 0) for i, t in enumerate(prose)] + [(1000 + i, t, None, 0) for i, t in enumerate(junk_texts)] + [(2000 + i, t, "en", 0) for i, t in enumerate(sound)]
    docs = spark.createDataFrame(rows, SCHEMA)
    assert {r["doc_id"] for r in junk.found(docs).collect()} == {1000, 1001, 1002, 1003}
    assert junk.found(docs.limit(0)).count() == 0


COUNTS = {w: 500 for w in "the amount of revenue position contracts income term long goodwill agreement impairment dividends recognised and is".split()} | {"long-term": 400, "clamar": 40, "damar": 45}


def decode(text, following=None, begins=None):
    return scans.decode(scans.Reader(COUNTS, 20_000), text, following, begins)


def test_misread():
    for text in ("the am0unt", "po5ition", "iricome", "clividends", "arnount", "con†racts", "rec0gnised", "in 2O20.", "$l,234,567", "impairrnent"):
        assert decode(text)[1], text
    for text in ("the amount", "See also 5G and CO2", "Rule 7b-4", "Clamar", "IFRS 16", "2020", "$1,234", "goodwill†", "0" * 3000, "unseenword"):
        assert not decode(text)[1], text


def test_cut_words():
    assert decode("the agree-\nment is")[0] and decode("the agree¬\nment")[2] == "the agreement"
    assert not decode("long-\nterm")[0] and decode("long-\nterm")[2] == "long-term"
    assert not decode("Duri-\nMarren")[0]
    assert decode("the agree-", "ment is")[0] and not decode("the agree-", None)[0] and not decode("the agree-", "")[0]
    assert not decode("ment is", None, "agreement")[1] and decode("the agree-", "ment is")[3] == "agreement" and decode("ment is", None, "agreement")[2] == "agreement is"


def test_paragraphs():
    lines = [("Leases", True, True), ("The amount of", True, False), ("revenue is long.", False, False), ("And the position", True, False), ("is goodwill.", True, False)]
    assert scans.paragraphs_of(lines) == ["Leases", "The amount of revenue is long.", "And the position is goodwill."]
    assert scans.paragraphs_of([]) == []


def test_joint_decoding():
    for text, meant in {
        "the impair ment of it.": "the impairment of it.", "the goodwillamount is": "the goodwill amount is", "the impair-\nrnent is": "the impairment is",
        "rec0gnised agree-\nment of con tracts": "recognised agreement of contracts", "long-\nterm am0unt": "long-term amount",
    }.items():
        assert decode(text)[2] == meant, text
    # known words are not merged, a misreading costs more than the word it would be
    assert decode("the long term and is")[2] == "the long term and is"


def test_length_has_no_limit():
    assert decode("x" * 3000)[:2] == (False, False) and decode("the am0unt " * 5000)[1]
    lines = [(f"line {i} of a paragraph that goes on", not i, False) for i in range(1000)]
    assert len(scans.paragraphs_of(lines)) == 1


def test_no_word_is_beyond_the_lexicon(spark, tmp_path):
    # 200,100 words seen three times each, and one seen twice beside a neighbour seen 15 times
    many = ["".join("agkpqsxyz"[i // 9**k % 9] for k in range(6)) for i in range(200_100)]
    texts = [" ".join(many[i : i + 300]) for i in range(0, len(many), 300)] * 3 + ["contract"] * 15 + ["contraet", "the contraet is"]
    blocks = [(i, "d", 1, i, "text", t) for i, t in enumerate(texts)]
    schema = "block_key bigint, doc_id string, page_number int, block_ord int, type string, text string"
    box = "named_struct('x0', 0d, 'y0', 400d, 'x1', 9d, 'y1', 410d) as bbox"
    spark.createDataFrame(blocks, schema).selectExpr("*", box, "10d as font_size", "timestamp'2020-01-01' as ingested_at").write.parquet(f"{tmp_path}/raw_blocks.parquet")
    spark.sql("select 'd' as doc_id, 1 as page_number, 800d as height, timestamp'2020-01-01' as ingested_at").write.parquet(f"{tmp_path}/raw_pages.parquet")
    for known in (scans.KNOWN, 1000):
        assert scans.found(spark, str(tmp_path), known).filter(f"block_key >= {len(texts) - 2}").count() == 0


def test_stated_figures():
    for text, meant in {"$36B thousand": "$368 thousand", "$B87 thousand": "$887 thousand", "$59S thousand": "$595 thousand", "$3B2": "$382", "3S4 million": "354 million", "€12S45.": "€12545.", "12G%": "126%"}.items():
        assert decode(text)[1:3] == (True, meant), text
    for text in ("$36B", "$20s", "B2B", "36B pages", "12S45", "5G million users"):
        assert not decode(text)[1], text


def pages(spark, path, blocks):
    """blocks: (key, page, order, type, text, y0)."""
    rows = [(k, "d", p, o, t, x, y) for k, p, o, t, x, y in blocks]
    frame = spark.createDataFrame(rows, "block_key bigint, doc_id string, page_number int, block_ord int, type string, text string, y double")
    box = "case when y is not null then named_struct('x0', 0d, 'y0', y, 'x1', 9d, 'y1', y + 10) end as bbox"
    frame.selectExpr("block_key", "doc_id", "page_number", "block_ord", "type", "text", box, "10d as font_size", "timestamp'2020-01-01' as ingested_at", "1 as height").write.parquet(f"{path}/raw_blocks.parquet")
    spark.sql("select 'd' as doc_id, explode(sequence(1, 9)) as page_number, 800d as height, timestamp'2020-01-01' as ingested_at").write.parquet(f"{path}/raw_pages.parquet")
    return str(path)


TEXTS = [
    (1, 1, 0, "page_header", "Duri-Marren Report 2019", 20.0), (2, 1, 1, "text", "The agreement and the amount of the long-\nterm position.", 300.0), (3, 1, 2, "text", "The impairment is recog-", 400.0),
    (4, 1, 3, "text", "nised and the amount of income is in the agree-", 500.0), (5, 1, 4, "page_footer", "12", 760.0),
    (6, 2, 0, "text", "Hinsta-Vexkel Report 2018", 20.0), (7, 2, 1, "text", "ment of the long-term position and", 300.0), (8, 3, 0, "text", "goes on. The c0ntract is recognised.", 300.0), (9, 3, 1, "text", "in the\n13\n", 500.0), (9, 3, 1, "text", "in the\n13\n", 500.0),
    (10, 4, 0, None, None, None), (11, 4, 1, "text", "  ", None), (12, None, 1, "text", "the agreement", None),
    *[(100 + i, 5, i, "text", "contract impairment agreement position recognised amount long-term", 300.0) for i in range(30)],
]


def test_pages_are_stitched(spark, tmp_path):
    path = pages(spark, tmp_path, TEXTS)
    for known in (scans.KNOWN, 3):
        rows = {(r["block_key"], r["defect"]) for r in scans.found(spark, path, known).collect()}
        assert rows == {(3, "hyphen"), (4, "hyphen"), (6, "furniture"), (8, "misread"), (9, "furniture_line")}, (known, rows)
        texts = {(r["page_number"], r["paragraph"]): r["text"] for r in scans.paragraphs(spark, path, known).collect()}
        assert texts[1, 0] == "The agreement and the amount of the long-term position." and texts[3, 1] == "in the"
        assert texts[1, 1] == "The impairment is recognised and the amount of income is in the agreement of the long-term position and goes on. The contract is recognised."
        assert (2, 0) not in texts and texts[None, 0] == "the agreement"


def test_scans_of_nothing(spark, tmp_path):
    path = pages(spark, tmp_path, [])
    assert scans.found(spark, path).count() == 0 == scans.paragraphs(spark, path).count()
