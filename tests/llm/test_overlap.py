import random

from folioflow.llm import overlap as O


def same(a, b):
    return O.same_question(O._words(a), O._words(b))


BASE = "What was the percentage change in deferred tax at Hinros-Hovjul between 2018 and 2019?"


def test_the_same():
    for other in (
        BASE.upper() + " as reported?", "Based on the table, " + BASE, BASE.replace("change", "chagne"), BASE.replace("the ", ""), "Q: " + BASE, BASE.replace("between", "beetween"), BASE.replace("H", "Н"),
        "Between 2018 and 2019, what was the percentage change in deferred tax at Hinros-Hovjul?", BASE.replace("was", "is"), BASE + " (see page)",
    ):
        assert same(BASE, other) and same(other, BASE), other


def test_not_the_same():
    for other in (
        BASE.replace("2019", "2020"), BASE.replace("Hinros", "Hinsta"), BASE.replace("Hovjul", "Hovjus"), BASE.replace("deferred tax", "revenue"), BASE.replace("percentage", "average"),
        "By how much did the deferred tax of Hinros-Hovjul change from 2018 to 2019?", "",
    ):
        assert not same(BASE, other) and not same(other, BASE), other


def test_search_equals_brute_force():
    names = [f"{a}{b}-{c}{d}" for a in ("hin", "ros", "vex") for b in ("ta", "lo") for c in ("zel", "mar") for d in ("ba", "nor")]
    texts = [" ".join(O._words(f"What was the {i} of {n} in {y}?")) for n in names for i in ("revenue", "cost of sales") for y in (2011, 2012)]
    typed = [t.replace("what", "waht") for t in texts[::3]] + [t + " as reported" for t in texts[::5]] + [t.replace("the ", "") for t in texts[::7]]
    training, held = sorted(set(texts[::2] + typed)), sorted(set(texts[1::2] + typed[::2]))
    brute = {(a, b) for a in training for b in held if O.same_question(a.split(), b.split())}
    assert set(O.search(training, O.Shard(held))) == brute and len(brute) > 20
    assert O.search([], O.Shard(held)) == [] == O.search(training, O.Shard([]))


def test_index_finds_every_place():
    rng = random.Random(3)
    texts = ["".join(rng.choice("abcé ") for _ in range(rng.randrange(60))) for _ in range(200)]
    index = O.Index([t.encode() for t in texts])
    patterns = ["ab", "a", "é", "cab", "b c", "zz", "abcabc"]
    low, high = index.places([p.encode() for p in patterns])
    for p, a, b in zip(patterns, low.tolist(), high.tolist()):
        places = sorted(index.texts_of(O.np.arange(a, b)).tolist())
        assert places == sorted(i for i, t in enumerate(texts) for at in range(len(t)) if t.startswith(p, at)), p


def test_search_misses_no_pair_of_common_words():
    # every piece the twins share around the edit stands in far more than 48 evaluation texts
    names = [f"{a}{b}{c}e" for a in "bcdfghjklm" for b in "aeiou" for c in "nrst"]
    held = [f"what was revenue of {n} in 2019" for n in ("acme", *names)] + [f"what was revenue of {n} in 2018" for n in names]
    training = ["what was revenue of acmee in 2019", "q what was revenue of ac me in 2019", "in 2019 what was revenue of acme", "2019", "what was cost of acme in 2019"]
    training += [f"what was revnue of {n} in 2018 please" for n in names[:5]] + [names[7] + " revenue what was in 2019"]
    brute = {(a, b) for a in training for b in held if O.same_question(a.split(), b.split())}
    assert set(O.search(training, O.Shard(held))) == brute and ("what was revenue of acmee in 2019", "what was revenue of acme in 2019") in brute and len(brute) >= 9
    assert set(O.search(held, O.Shard(training))) == {(b, a) for a, b in brute}


def test_a_template_that_all_share_is_searched_in_full():
    # 66 evaluation questions with one tail, a training question equal to one of them plus a word before it
    names = [f"{a}{b}{a}o" for a in "bcdfghjklmn" for b in "aeiouy"]
    held = [f"{n} revenue reported for the group in 2019" for n in names]
    assert O.search([f"q {held[40]}"], O.Shard(held)) == [(f"q {held[40]}", held[40])]


def test_report_counts_copies_by_multiplicity(spark, tmp_path):
    at = "2024-01-01 00:00:00"
    pages = [("d", p, "s", split) for p, split in ((1, "train"), (2, " Dev "), (3, "TEST_gold"), (4, "other"))]
    spark.createDataFrame([(*r, at) for r in pages], "doc_uid string, page int, source string, split_name string, ingested_at string").write.parquet(f"{tmp_path}/gold_documents.parquet")
    asked = [(k, "d", p, f"What was revenue of acme in {y}{'?' * (k % 3)}") for k, (p, y) in enumerate([(1, 2019)] * 5 + [(2, 2019)] * 4 + [(3, 2019)] * 3 + [(3, 2018)] + [(4, 2019)])]
    asked += [(90, "d", 1, None), (91, "d", 2, ""), (5, "d", 2, asked[5][3])]
    spark.createDataFrame([(*r, at) for r in asked], "question_key bigint, doc_uid string, page int, question string, ingested_at string").write.parquet(f"{tmp_path}/gold_questions.parquet")
    rows = {r["split"]: (r["source"], r["questions"], r["pairs"]) for r in O.report(spark, str(tmp_path)).collect()}
    assert rows == {"dev": ("s", 4, 20), "test": ("s", 3, 15)}
    assert O.found(spark, str(tmp_path)).count() == 35


def test_shards_give_what_one_shard_gives(spark):
    names = [f"{a}{b}{c}" for a in "bcd" for b in "aei" for c in "nrst"]
    rows = [(f"revenue of {n} in 2019", "train") for n in names] + [(f"what revenue of {n} in 2019", "dev") for n in names]
    questions = spark.createDataFrame(rows, "form string, split string")
    one, many = (sorted(map(tuple, O.pairs(questions, texts=n).collect())) for n in (1000, 5))
    assert one == many and len(one) == len(names)


def test_one_side_without_questions(spark):
    rows = [("revenue of acme in 2019", "train"), ("revenue of acme in 2018", "train")]
    questions = spark.createDataFrame(rows, "form string, split string")
    assert O.pairs(questions).count() == 0 == O.pairs(questions.limit(0)).count()
    assert O.pairs(questions.withColumn("split", O.F.lit("dev"))).count() == 0
    # more shards than texts: some are empty
    both = questions.union(questions.withColumn("split", O.F.lit("test")))
    assert O.pairs(both.union(spark.createDataFrame([(f"cost of {i}{i}x", "dev") for i in range(9)], both.schema)), texts=1).count() == 2
