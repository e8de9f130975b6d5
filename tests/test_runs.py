"""Runs, gold and result files, running values, phrases and numbers against brute force."""

import hashlib
import json
import random

from pyspark.sql import functions as F

from folioflow.functions.finance import looks_numeric, parse_values
from folioflow.operators import assemble, evaluate, mapping, report, running, runs, validate
from folioflow.plans import catalog
from folioflow.sources import gold, results

SF = "/root/testdata/sf0.001"


def test_gold_files(spark, tmp_path):
    records = [
        {"doc": {"uid": "a", "page": 1, "source": "s"}, "questions": [{"uid": "q1", "order": 2, "question": "How much?", "facts": ["1", None, "2"]}, {"uid": "q2"}]},
        {"doc": {"uid": None}, "questions": []}, {"doc": {"uid": "b", "page": 3}, "questions": []},
    ]
    (tmp_path / "gold_test_gold.json").write_text(json.dumps(records))
    read = gold.read_split(spark, f"{tmp_path}/gold_{{split}}.json", "test")
    rows = {r["uid"]: r for r in gold.questions(read).collect()}
    assert rows["q1"]["facts"] == ["1", "2"] and rows["q1"]["ord"] == 2 and rows["q2"]["question"] == "" and rows["q2"]["req_comparison"] is False
    here, missing = gold.present_and_missing(read, spark.createDataFrame([("a",)], "uid string"))
    assert here.count() == 1 and [r["uid"] for r in missing.collect()] == ["b"]


def test_results_are_read_as_written(spark, tmp_path):
    run = spark.sql("select 'layout' as backend, 'dev' as split, 7 as seed")
    rows = spark.sql("select concat('d', id) as document_uid, id <> 1 as ok, 0.5 as elapsed_s, if(id = 1, 'ValueError: x', null) as error from range(3)")
    results.write_results(rows.filter("document_uid <> 'd2'"), f"{tmp_path}/r", run)
    results.write_results(rows.filter("document_uid = 'd2'"), f"{tmp_path}/r")
    (tmp_path / "r" / "broken.json").write_text('{"record": "docu')
    head, documents = results.read_written(spark, f"{tmp_path}/r")
    assert [(r["backend"], r["seed"]) for r in head.collect()] == [("layout", 7)]
    assert {(r["document_uid"], r["ok"], r["error"]) for r in documents.collect()} == {("d0", True, None), ("d1", False, "ValueError: x"), ("d2", True, None)}


def test_reports(spark):
    metrics = catalog.QUERIES["run_roll_up"](spark, SF)
    sliced, outcomes = catalog.QUERIES["report_slices"](spark, SF), catalog.QUERIES["report_outcomes"](spark, SF)
    text = report.render(metrics, sliced, outcomes)
    assert "fact recall" in text and "overall" in text and "table_cell_text" in text
    failed = spark.createDataFrame([("d9", "ValueError: x")], "doc_id string, error string")
    causes = spark.createDataFrame([("a", 2), ("b", 5)], "cause string, facts bigint")
    worst = spark.createDataFrame([("d1", 3)], "doc_id string, unsupported bigint")
    lines = report.render_failures(causes, failed, worst).split("\n")
    assert lines[0] == "7 facts not recovered" and lines[1].split() == ["b", "5"] and "d9: ValueError: x" in lines[3] and "d1: 3" in lines[4]
    assert json.loads(report.to_json(causes).collect()[0]["json"])["cause"] == "a"


def test_empty_runs(spark):
    none = spark.createDataFrame([], "doc_id string, ok boolean, from_cache boolean, elapsed_s double, error string")
    structure = spark.createDataFrame([], "doc_id string, pages bigint, blocks bigint, furniture bigint, tables bigint, scaled_tables bigint, cells bigint, parsed_numbers bigint")
    matches = spark.createDataFrame([], "doc_id string, question_key bigint, outcome string, candidates bigint")
    value = {r["metric"]: r["value"] for r in runs.roll_up(none, structure, matches).collect()}
    assert value["documents"] == 0 and value["fact_recall"] == 0 and value["seconds_per_page"] == 0
    assert runs.failures(none).count() == 0 == runs.resumed(none, none).count()


def test_samples(spark):
    ids = spark.createDataFrame([(f"d{i}",) for i in range(50)], "doc_uid string")
    drawn = {r["doc_uid"] for r in report.sample(ids, 10, 7).collect()}
    assert len(drawn) == 10 and drawn == {r["doc_uid"] for r in report.sample(ids.repartition(7), 10, 7).collect()}
    assert report.sample(ids, None, 7).count() == 50 and report.sample(ids, 0, 7).count() == 0
    assert report.exact_sample(["b", "a"], 5, 7) == ["a", "b"] and len(report.exact_sample([str(i) for i in range(9)], 3, 7)) == 3


def test_running_values_equal_a_fold(spark):
    rng = random.Random(6)
    rows = sorted((f"d{d}", p, o) for d in range(3) for p in range(6) for o in range(rng.randrange(5)))
    values = [rng.choice([None, rng.randrange(9)]) for _ in rows]
    df = spark.createDataFrame([(*r, v) for r, v in zip(rows, values)], "doc_id string, page_number int, o int, v int").repartition(3)
    for itself, following in ((False, False), (True, False), (False, True)):
        got = {(r["doc_id"], r["page_number"], r["o"]): r["x"] for r in running.latest(df, "o", {"x": F.col("v")}, itself, following).collect()}
        for i, key in enumerate(rows):
            own = [j for j in range(len(rows)) if rows[j][0] == key[0] and values[j] is not None and (j > i if following else j < i + itself)]
            assert got[key] == (values[own[0 if following else -1]] if own else None), (itself, following, key)
    numbers = {(r["doc_id"], r["page_number"], r["o"]): r["n"] for r in running.numbered(df, ["o"], "n").collect()}
    assert all(numbers[key] == sum(r[0] == key[0] for r in rows[:i]) for i, key in enumerate(rows))


def test_phrases_equal_brute_force(spark):
    rng = random.Random(9)
    words = ["cash", "flow", "net", "income", "a.b", "c++", "x", "-- --", "état"]
    texts = [(i, f"d{i % 2}", " ".join(rng.choices(words, k=6))) for i in range(80)]
    needles = sorted({(f"d{rng.randrange(2)}", " ".join(rng.choices(words, k=rng.randrange(1, 4)))) for _ in range(60)} | {("d0", "ash flow"), ("d1", "----")})
    indexed = spark.createDataFrame([(d, k, t, 1) for k, d, t in texts], "doc_id string, block_key bigint, haystack string, extra int")
    got = {(r["doc_id"], r["needle"], r["block_key"]) for r in evaluate.phrase_places(indexed, spark.createDataFrame(needles, "doc_id string, needle string")).collect()}
    word = lambda c: c.isalnum() or c == "_"
    want = set()
    for d, n in needles:
        for k, e, t in texts:
            at = t.find(n) if d == e else -1
            while at >= 0:
                if not (at and word(t[at - 1])) and not (at + len(n) < len(t) and word(t[at + len(n)])):
                    want.add((d, n, k))
                at = t.find(n, at + 1)
    assert got == want and len(want) > 20


def test_numbers_on_both_sides_of_a_bin(spark):
    pairs = [(1.0, 1.0 + 5e-10), (0.0, 0.0), (-3.5, -3.5 * (1 + 9e-10)), (9.9999999999, 10.0), (1e12, 1e12 + 100), (2.0, 2.00000001), (1.0, -1.0), (0.0, 1e-300), (1e-300, 1e-300)]
    df = spark.createDataFrame(pairs, "a double, b double")
    rows = df.select("a", "b", evaluate.same_number(F.col("a"), F.col("b")).alias("same"), (F.abs(evaluate._bin(F.col("a")) - evaluate._bin(F.col("b"))) <= 1).alias("near")).collect()
    assert [r["same"] for r in rows] == [True, True, True, True, True, False, False, False, True]
    assert all(r["near"] for r in rows if r["same"])


def test_documents(spark):
    rows = catalog.QUERIES["nested_document"](spark, SF)
    hashes = catalog.QUERIES["stable_hash"](spark, SF)
    n = assemble.raw_frames(spark, SF)["pages"].select("doc_id").distinct().count()
    assert rows.count() == n and hashes.select("doc_id").distinct().count() == n
    assert {(r[0], r[1]) for r in hashes.collect()} == {(r[0], r[1]) for r in catalog.QUERIES["stable_hash"](spark, SF).collect()}


def test_hashes_gather_no_document(spark, tmp_path):
    nested = catalog.QUERIES["nested_document"](spark, SF)
    want = nested.select("doc_id", F.sha2(F.to_json(F.struct(*[c for c in nested.columns if c != "doc_id"])), 256)).collect()
    hashes, holds = catalog.QUERIES["stable_hash"](spark, SF), catalog.QUERIES["stable_hash_holds"](spark, SF)
    assert sorted(map(tuple, hashes.collect())) == sorted(map(tuple, want))
    for df in (hashes, holds):
        gathered = [line for line in df._jdf.queryExecution().optimizedPlan().toString().split("\n") if "collect_list" in line]
        assert gathered and all("Aggregate [doc_id" in line and "page_number" in line.split("]")[0] for line in gathered)
    # a null key is a key like any other, also in batches of one row
    for name in ("raw_blocks", "raw_tables", "raw_cells", "raw_pages"):
        df = spark.read.parquet(f"{SF}/{name}.parquet")
        (df if name != "raw_pages" else df.unionByName(df.limit(1).withColumn("doc_id", F.lit(None).cast("string")))).write.parquet(f"{tmp_path}/{name}.parquet")
    size = "spark.sql.execution.arrow.maxRecordsPerBatch"
    usual = spark.conf.get(size)
    spark.conf.set(size, 1)
    try:
        assert {(r["doc_id"], r["same"]) for r in catalog.QUERIES["stable_hash_holds"](spark, str(tmp_path)).collect()} == {(r["doc_id"], True) for r in want} | {(None, True)}
    finally:
        spark.conf.set(size, usual)


def test_hashes_of_parts(spark):
    kind = "doc_id string, pages struct<n:int,t:string>, warnings struct<code:string,page:int>"
    rows = [("b", None, ("X", 2)), ("a", (2, "é"), None), ("a", (1, None), None), ("c", None, ("X", 1)), ("a", None, ("X", None)), ("b", (1, '"'), None)]
    got = {r["doc_id"]: r["stable_hash"] for r in assemble.stable_hash(spark.createDataFrame(rows, kind).withColumn("processing", F.rand())).collect()}
    want = {"a": '{"pages":[{"n":1},{"n":2,"t":"é"}],"warnings":[{"code":"X"}],"contract_version":"1.0"}', "b": '{"pages":[{"n":1,"t":"\\""}],"warnings":[{"code":"X","page":2}],"contract_version":"1.0"}'}
    assert got == {d: hashlib.sha256(t.encode()).hexdigest() for d, t in want.items()}
    assert assemble.stable_hash(spark.createDataFrame([], kind)).count() == 0


def test_cell_values_and_units(spark):
    units = {(r["doc_id"], r["page_number"], r["block_ord"]): r["scale"] for r in catalog.QUERIES["table_units"](spark, SF).collect()}
    raw = assemble.raw_frames(spark, SF)
    at = {r["cell_key"]: (r["doc_id"], r["page_number"], r["block_ord"]) for r in raw["cells"].collect()}
    rows = catalog.QUERIES["cell_values"](spark, SF).collect()
    assert len(rows) == len(at) and set(units.values()) <= {1.0, 1e3, 1e6, 1e9, 1e12}
    for r in rows:
        if r["scaled"] is not None and r["unit"] != "percent":
            assert r["scaled"] in (r["num"], r["num"] * units[at[r["cell_key"]]]), r


def test_figures_and_admission(spark):
    read = parse_values(spark.createDataFrame([("1,234",), ("—",), (None,), ("n/a",), ("(5)",)], "t string"), F.col("t")).select("t", looks_numeric(F.col("value")).alias("n"))
    assert {r["t"]: r["n"] for r in read.collect()} == {"1,234": True, "—": False, None: False, "n/a": False, "(5)": True}
    said = spark.createDataFrame([("Incorrect password",), (None,)], "m string").select(validate.open_error(F.col("m")).alias("c")).collect()
    assert [r["c"] for r in said] == ["ENCRYPTED_PDF", "INVALID_PDF"]
    one = spark.sql("select cast(null as int) as port, 5 as max_upload_mb, 0 as max_pages, -1 as text_density_threshold, 1.0d as low_confidence_threshold, 1 as render_dpi, 1 as threads, 'slow' as table_mode")
    assert validate.settings_errors(one).collect()[0]["errors"] == ["max_pages", "text_density_threshold", "table_mode"]


def test_items_of_nothing(spark):
    items = spark.createDataFrame([("d", None, 0, None, None, None, None, None), ("d", 1, 1, None, " ", None, None, None), ("d", 1, 2, "Picture", None, None, None, None), ("d", 1, 3, None, None, True, None, 2)], "doc_id string, page_number int, item_ord int, label string, text string, has_grid boolean, n_rows int, n_cols int")
    blocks, warnings = mapping.walk_items(items)
    assert {(r["item_ord"], r["type"], r["text"]) for r in blocks.collect()} == {(2, "figure", ""), (3, "table", "")}
    assert {r["code"] for r in warnings.collect()} == {"PAGE_EXTRACTION_FAILED", "TABLE_STRUCTURE_UNCERTAIN"}
    none, quiet = mapping.walk_items(items.limit(0))
    assert none.count() == 0 == quiet.count()
