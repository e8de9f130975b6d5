from folioflow.llm import lookalike as L

SCHEMA = "item_kind string, item_key bigint, item_pos int, text string"
TEXTS = {
    "plain text": "plain text",
    "２０１６": "2016",
    "Cоst of sales": "Cost of sales",  # a Cyrillic o
    "Emplօyee": "Employee",
    "no break": "no break",
    "zero​width": "zerowidth",
    "été": "été",
    "ậ": "ậ",
    "ậ": "ậ",
    "signiﬁcant": "significant",
    "𝐀𝐁": "AB",
    "m² ½ ™ – − € • †": "m² ½ ™ – − € • †",
    "Καλλιρέα": "Καλλιρέα",
    "Заречье": "Заречье",
    "größer Łozinek": "größer Łozinek",
    "n∕a": "n/a",
    "​": "",
    "line\nbreak two": "line\nbreak two",
}


def test_forms(spark):
    rows = [("cell", i, 0, t) for i, t in enumerate(TEXTS)] + [("cell", 900, 0, None), ("fact", 901, 2, "")]
    items = spark.createDataFrame(rows, SCHEMA)
    out = {r["item_key"]: r["text"] for r in L.normalised(items).collect()}
    for i, (text, want) in enumerate(TEXTS.items()):
        assert out[i] == want, ascii(text)
    assert out[900] is None and out[901] == ""
    hit = {r["item_key"] for r in L.found(items.union(items)).collect()}
    assert hit == {i for i, (a, b) in enumerate(TEXTS.items()) if a != b}


def test_long_and_empty(spark):
    items = spark.createDataFrame([("block", 1, 0, "あ" * 50_000 + "а"), ("block", 2, 0, "x" * 200_000)], SCHEMA)
    assert {r["item_key"] for r in L.found(items).collect()} <= {1}
    assert L.found(items.limit(0)).count() == 0


def test_composition_is_the_public_one(spark):
    import random
    import unicodedata

    from folioflow.functions.charmap import joining, mappings, marks

    rng = random.Random(8)
    mapped = {ch for ch, *_ in mappings()}
    some = [ch for ch, _ in marks() if ch not in mapped and unicodedata.normalize("NFC", ch) == ch]
    bases = list("aeoAuyscにかハ") + ["각", "가", "ᄀ", "ᄒ", "ᅡ", "ᆨ", "ᆼ", "é", "ç", "ệ", "क", "ক", "ே"]
    frequent = list("़゙̧̨̣̥̀́̂̃̈")
    tokens = {"é̥", "é̥", "が", "한", "ậ́"}
    while len(tokens) < 1500:
        n = rng.randrange(1, 4)
        token = "".join(rng.choice(bases) + "".join(rng.choice(frequent if rng.random() < 0.7 else some) for _ in range(rng.randrange(5))) + (rng.choice(sorted(joining())) if rng.random() < 0.2 else "") for _ in range(n))
        if not mapped.intersection(token):
            tokens.add(token)
    rows = spark.createDataFrame([(t,) for t in sorted(tokens)], "token string")
    got = {r["token"]: r["ordinary"] for r in L.ordinary_tokens(rows).collect()}
    assert len(got) == len(tokens) and {t for t in tokens if got[t] != unicodedata.normalize("NFC", t)} == set()
