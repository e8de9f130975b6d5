import random

from folioflow.llm import chunks

SCHEMA = "block_key bigint, text string, is_table boolean, max_chars int, overlap_chars int, extra string"


def _check(rows, limit, overlap, text):
    rows = sorted(rows, key=lambda r: r["piece"])
    assert [r["piece"] for r in rows] == list(range(rows[0]["n_pieces"]))
    assert rows[0]["piece_start"] == 0 and rows[-1]["piece_end"] == len(text)
    for r in rows:
        assert r["piece_text"] == text[r["piece_start"] : r["piece_end"]] and 0 < len(r["piece_text"]) <= limit
    for a, b in zip(rows, rows[1:]):
        assert abs(a["piece_end"] - b["piece_start"] - overlap) <= overlap // 4


def test_pieces(spark):
    rng = random.Random(3)
    words = lambda n: " ".join("".join(rng.choices("abcdé", k=rng.randint(1, 9))) + rng.choice(["", "", ".", ",", "\n\n"]) for _ in range(n))
    texts = {1: words(2000), 2: "x" * 5000, 3: "日本。" * 900, 4: "| a | b |\n" * 700, 5: "short", 7: "y" * 120_000 + " z", 8: "a" * 1200, 9: "a" * 1201}
    rows = [(k, t, k == 4, 1200, 150, "e") for k, t in texts.items()] + [(10, None, False, 10, 2, None), (11, "", False, 10, 2, None), (12, "z" * 9000, False, None, None, None)]
    out = {}
    for r in chunks.split_texts(spark.createDataFrame(rows, SCHEMA), ["block_key"]).collect():
        out.setdefault(r["block_key"], []).append(r)
    for k, t in texts.items():
        _check(out[k], 1200, 150, t)
    assert len(out[5]) == len(out[8]) == 1 and len(out[9]) == 2
    assert 10 not in out and out[11][0]["piece_text"] == "" and len(out[12]) == 1
    assert all(r["piece_text"].endswith("\n") for r in out[4])


def test_files_by_ranges(spark, tmp_path):
    text = "Ein Satz – mit Umlauten: größer.\nNoch einer. " * 3000
    path = tmp_path / "big.txt"
    path.write_text(text)
    rows = chunks.split_files(spark, [str(path)], 500, 60, range_bytes=10_007).collect()
    _check(rows, 500, 60, text)
    # the same pieces as from the whole text, whatever the ranges; by URI too
    frame = spark.createDataFrame([(1, text, False, 500, 60, "e")], SCHEMA)
    whole = sorted((r["piece"], r["piece_start"], r["piece_end"]) for r in chunks.split_texts(frame, ["block_key"]).collect())
    for size in (1_003, 1 << 22):
        again = chunks.split_files(spark, [path.as_uri()], 500, 60, range_bytes=size).collect()
        assert sorted((r["piece"], r["piece_start"], r["piece_end"]) for r in again) == whole


def test_empty_file(spark, tmp_path):
    path = tmp_path / "none.txt"
    path.write_text("")
    assert [r["piece_text"] for r in chunks.split_files(spark, [str(path)], 500, 60).collect()] == [""]
