import random

import pytest
import tiktoken

from folioflow.llm import packing, tokens


@pytest.fixture(scope="module")
def read():
    return tokens.vocabulary()[1]


def test_encoder_equals_the_merges(read):
    ranks = {read.token(i): i for i in range(len(read.left))}
    plain = tiktoken.Encoding("t", pat_str=tokens.PIECES, mergeable_ranks=ranks, special_tokens={})
    encoder = tokens.Encoder(read)
    rng = random.Random(1)
    parts = ["a", "b", "th", "e", " ", "  ", "\n", "ing", "é", "日", "0", "1", "==", "the", "an", "tion", "<|endoftext|>", "🙂", "​"]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 60))) for _ in range(3000)] + ["a" * 5000, " " * 3000 + "x", "ab" * 4000]
    for text in texts:
        ids = encoder.encode(text)
        assert ids == plain.encode_ordinary(text)
        assert tokens.decode(ids, read) == text and encoder.count(text) == len(ids)


def test_null_and_empty(spark):
    df = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, "Hello world", "x")], "doc_id bigint, text string, ids string")
    out = {r["doc_id"]: r["ids"] for r in tokens.encode(df).collect()}
    assert out[1] == out[2] == [] and len(out[3]) == 2
    assert tokens.encode(df.limit(0)).count() == 0


def test_fill_is_tight():
    rng = random.Random(2)
    histogram = {}
    for _ in range(3000):
        n = min(512, int(rng.expovariate(1 / 120)) + 1)
        histogram[n] = histogram.get(n, 0) + 1
    plan = packing.fill(histogram, 512)
    used = {}
    for pattern, times in plan:
        assert sum(s * n for s, n in pattern) <= 512 and times > 0
        for s, n in pattern:
            used[s] = used.get(s, 0) + n * times
    assert used == histogram
    total = sum(s * n for s, n in histogram.items())
    assert sum(t for _, t in plan) <= -(-total // 512) + 2


def test_pack(spark):
    rows = [(i, n) for i, n in enumerate([5, 5, 3, 7, 25, 10, None, 0, 1, 1])] + [(0, 5), (None, 4)]
    items = spark.createDataFrame(rows, "doc_id bigint, n_tokens bigint")
    out = packing.pack(items, [("ten", 10), ("big", 100)]).collect()
    for name, capacity in (("ten", 10), ("big", 100)):
        mine = [r for r in out if r["size_name"] == name]
        load = {}
        for r in mine:
            load[r["container_id"]] = load.get(r["container_id"], 0) + r["n_tokens"]
        assert max(load.values()) <= capacity and sorted(load) == list(range(len(load)))
        assert {r["doc_id"] for r in mine} == {0, 1, 2, 3, 4, 5, 8, 9} and sum(load.values()) == 57
        assert all(r["part"] == 0 for r in mine if r["doc_id"] != 4)
    assert packing.pack(items.limit(0), [("ten", 10)]).count() == 0
    assert packing.pack(items, []).count() == 0
    with pytest.raises(ValueError):
        packing.pack(items, [("bad", 0)])


def test_closest_sum_equals_brute_force(monkeypatch):
    import itertools
    import random

    rng = random.Random(2)
    for _ in range(200):
        monkeypatch.setattr(packing, "KEPT", rng.choice([1 << 26, 3, 0]))
        capacity = rng.randrange(3, 60)
        held = {rng.randrange(1, capacity + 1): rng.randrange(1, 6) for _ in range(rng.randrange(1, 6))}
        largest = max(held)
        pattern = packing._closest(sorted(held, reverse=True), held, capacity)
        sums = (sum(a * b for a, b in zip(held, ns)) for ns in itertools.product(*[range((k == largest), held[k] + 1) for k in held]))
        assert sum(a * b for a, b in pattern) == max(x for x in sums if x <= capacity) and all(b <= held[a] for a, b in pattern)
        left = dict(held)
        for pattern, times in packing.fill(held, capacity):
            for size, n in pattern:
                left[size] -= n * times
        assert not any(left.values())
