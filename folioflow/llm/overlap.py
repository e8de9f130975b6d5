"""Questions of evaluation splits that the training split also asks.

Questions are brought to one form (look-alikes folded, lower case, words only),
and copies to one representative.  The representatives of dev and test are
spread over shards of bounded size.  Each shard is built once into a compressed
full-text index (Burrows-Wheeler transform with block ranks and a sampled suffix
array, about five bytes a character) and written to the shared folder; the
training texts are streamed past it, read once, whatever the number of shards.

A training text's words, what they may be mistyped of and the words it may have
run together or apart are searched for backwards.  Of two equal questions, one
has a counterpart in the other for each of its words that isn't small, and their
numbers are equal.  So either the evaluation text holds all words of the training
text: the places of its rarest word are merged with those of the others; or the
training text holds all words of the evaluation text: its rarest word stands with
its numbers at the head of its entry, one search finds the entries.  Neither way
has a limit; the pairs that remain are compared word by word.

Two questions are the same if, up to typing errors (a letter lost, doubled or
swapped with the next), their words are the same in whatever order, but for
small words and for words added before or after the whole question.  Numbers
must agree exactly; a word replaced by another is a difference.

Skew: copies are one text on both sides; a shard is of bounded size, and a batch
of training texts looks up each distinct word once.  The report counts copies by
multiplicity and never expands them into pairs.

Edge cases: null and empty questions are in no pair, neither are questions
without a gold document or of an unknown split; a question sent twice counts
once; no evaluation or no training questions give no rows.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.functions.charmap import mappings
from folioflow.functions.text import split_kind
from folioflow.session import distinct_rows, read_bytes, saved, shared_folder, table

#: Distinct evaluation texts of a shard, and training texts looked up at a time, about.
SHARD, BATCH = 200_000, 40_000
#: Rows between block ranks, and between sampled suffixes.
BLOCK, SAMPLE = 64, 8
#: Candidate pairs checked at a time, about; all are.
PLACES = 1_000_000
#: Fixed: words that may come, go or be exchanged within a question.
SMALL = frozenset("a an the of in at on for to from by and is was are were be did do does has had have its their year".split())
#: Words that may stand before or after the whole question.
AROUND = 9


def _words(text: str) -> list[str]:
    return re.findall(r"\w+", unicodedata.normalize("NFC", text.translate(_FOLD)).lower().replace("_", " "))


_FOLD = {ord(a): b for a, b, _ in mappings()}


def normal_form(question):
    """A pandas UDF: the question's words in lower case, null for none."""

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: " ".join(_words(t)) or None if t else None)

    return run(question)


@lru_cache(maxsize=1 << 18)
def _has_digit(word: str) -> bool:
    return any(c.isdigit() for c in word)


def _required(words: list[str]) -> list[str]:
    """The words that need a counterpart: neither small nor numbers."""
    return [w for w in dict.fromkeys(words) if w not in SMALL and not _has_digit(w)]


def _numbers(words: list[str]) -> str:
    """The numbers of a question, as a key."""
    return " ".join(sorted(w for w in words if _has_digit(w)))


class Index:
    """Backward search over the bytes of texts.

    An interval of suffixes stands for all places of a pattern and is extended
    to the left by one byte at a time, for many patterns at once.
    """

    def __init__(self, texts: list[bytes]) -> None:
        joined = b"\0" + b"\0".join(texts) + b"\0"
        symbols = np.frombuffer(joined, np.uint8)
        suffixes = _suffix_array(symbols)
        self.size = len(symbols)
        self.bwt = symbols[suffixes - 1]
        present = np.unique(symbols)
        self.code = np.full(256, -1, np.int64)
        self.code[present] = np.arange(len(present))
        self.first = np.concatenate([[0], np.cumsum(np.bincount(symbols, minlength=256)[present])]).astype(np.int64)
        coded = self.code[self.bwt]
        blocks = -(-self.size // BLOCK)
        counts = np.bincount(coded + len(present) * (np.arange(self.size) // BLOCK), minlength=blocks * len(present)).reshape(blocks, -1)
        self.ranks = np.concatenate([np.zeros((1, len(present)), np.int64), np.cumsum(counts, axis=0)]).astype(np.int32)
        # no byte of UTF-8 is 255, so a code is below it
        self.bwt = np.concatenate([coded, np.full(BLOCK, 255)]).astype(np.uint8)
        sampled = suffixes % SAMPLE == 0
        self.sampled = np.packbits(sampled)
        self.sampled_before = np.concatenate([[0], np.cumsum(sampled.reshape(-1) if len(sampled) % 8 == 0 else np.concatenate([sampled, np.zeros(-len(sampled) % 8, bool)]).reshape(-1))[7::8]]).astype(np.int32)
        self.samples = suffixes[sampled].astype(np.int32)
        self.starts = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])]).astype(np.int64)

    def rank(self, code: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """How often each code stands in the transform before each row."""
        out = np.empty(len(rows), np.int64)
        for begin in range(0, len(rows), 1 << 15):
            c, r = code[begin : begin + (1 << 15)], rows[begin : begin + (1 << 15)]
            block, rest = r // BLOCK, r % BLOCK
            near = self.bwt[(block * BLOCK)[:, None] + np.arange(BLOCK)] == c[:, None].astype(np.uint8)
            out[begin : begin + (1 << 15)] = self.ranks[block, c] + (near & (np.arange(BLOCK) < rest[:, None])).sum(axis=1)
        return out

    def places(self, patterns: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The intervals of suffixes that begin with the patterns."""
        lengths = np.array([len(p) for p in patterns], np.int64)
        codes = self.code[np.frombuffer(b"".join(patterns), np.uint8)]
        first = np.cumsum(lengths) - lengths
        low, high = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.size, np.int64)
        for step in range(1, int(lengths.max(initial=0)) + 1):
            on = np.flatnonzero((lengths >= step) & (high > low))
            code = codes[first[on] + lengths[on] - step]
            high[on[code < 0]] = low[on[code < 0]]
            on, code = on[code >= 0], code[code >= 0]
            low[on], high[on] = self.first[code] + self.rank(code, low[on]), self.first[code] + self.rank(code, high[on])
        return low, high

    def texts_of(self, rows: np.ndarray) -> np.ndarray:
        """The text that each suffix stands in: steps to the left, up to the next sampled suffix."""
        rows, steps = rows.astype(np.int64), np.zeros(len(rows), np.int64)
        open_ = np.arange(len(rows))
        while len(open_):
            at = rows[open_]
            hit = (self.sampled[at >> 3] >> (7 - (at & 7))) & 1
            open_ = open_[hit == 0]
            code = self.bwt[rows[open_]].astype(np.int64)
            rows[open_] = self.first[code] + self.rank(code, rows[open_])
            steps[open_] += 1
        byte = self.sampled[rows >> 3].astype(np.int64)
        before = self.sampled_before[rows >> 3] + _POPULATION[byte >> (8 - (rows & 7))]
        return np.searchsorted(self.starts, self.samples[before] + steps, side="right") - 1


_POPULATION = np.array([bin(i).count("1") for i in range(256)], np.int64)


def _suffix_array(symbols: np.ndarray) -> np.ndarray:
    """Prefix doubling from seven bytes on, until all suffixes differ."""
    n, step = len(symbols), 7
    padded = np.concatenate([symbols.astype(np.int64), np.zeros(step, np.int64)])
    key = np.zeros(n, np.int64)
    for i in range(step):
        key = (key << 8) + padded[i : i + n]
    while True:
        order = np.argsort(key, kind="stable")
        rank = np.empty(n, np.int64)
        rank[order] = np.concatenate([[0], np.cumsum(np.diff(key[order]) != 0)])
        if rank[order[-1]] == n - 1 or step >= n:
            return order
        key = rank * (n + 1)
        key[:-step] += rank[step:] + 1
        step *= 2


def _shortened(word: str) -> set[str]:
    """The word with a letter lost; words that are mistyped of each other share one of these or are one."""
    return {word[:i] + word[i + 1 :] for i in range(len(word))} if len(word) > 2 else set()


class Shard:
    """The index of a shard's texts, with what a search needs of their words."""

    def __init__(self, texts: list[str]) -> None:
        self.texts = texts
        split = [t.split() for t in texts]
        found = Counter(w for words in split for w in set(words))
        self.vocabulary = sorted(found)
        self.ids = {w: i for i, w in enumerate(self.vocabulary)}
        number_keys = [_numbers(words) for words in split]
        self.kinds = {k: i for i, k in enumerate(sorted(set(number_keys)))}
        self.numbers = np.array([self.kinds[k] for k in number_keys], np.int64)
        required = [_required(words) for words in split]
        rarest = [min(words, key=lambda w: (found[w], w), default="") for words in required]
        # an entry: its numbers and rarest word at the head, then the text
        self.index = Index([f"\1{k}\1{r}\2 {t} ".encode() for k, r, t in zip(number_keys, rarest, texts)])
        self.required = _lists([[self.ids[w] for w in words] for words in required])
        self.words = _lists([[self.ids[w] for w in set(words)] for words in split])
        self.near: dict[str, list[str]] = {}
        for word in self.vocabulary:
            for key in (word, *_shortened(word)):
                self.near.setdefault(key, []).append(word)

    def counterparts(self, word: str) -> set[str]:
        """The word, what it is mistyped of, and the two words it is written as, as far as any text has them."""
        near = {v for key in (word, *_shortened(word)) for v in self.near.get(key, ()) if v == word or _mistyped(word, v)}
        return near | {f"{word[:i]} {word[i:]}" for i in range(1, len(word)) if word[:i] in self.ids and word[i:] in self.ids}


def _lists(rows: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """Lists as one array and their bounds in it."""
    return np.array([x for row in rows for x in row], np.int64), np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int64)


def _spread(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """first, first + 1, ... for each of count."""
    return np.repeat(first - (np.cumsum(count) - count), count) + np.arange(count.sum())


def _parts(total: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of about PLACES each, by running totals; one element at least."""
    begin = 0
    while begin < len(total):
        end = max(begin + 1, int(np.searchsorted(total, (total[begin - 1] if begin else 0) + PLACES, side="right")))
        yield begin, end
        begin = end


def candidates(shard: Shard, texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions in ``texts`` and in the shard of pairs of which one holds counterparts of all words of the other.

    No pair is left out: numbers are equal, and every other word that isn't
    small has a counterpart, on one side at least.
    """
    width = len(shard.vocabulary) + 1
    split = [t.split() for t in texts]
    kinds = np.array([shard.kinds.get(_numbers(words), -1) for words in split], np.int64)
    known = np.flatnonzero(kinds >= 0)
    asked: dict[tuple, int] = {}
    of: list[list[int]] = []
    for t in known.tolist():
        words, mine = split[t], {}
        for i, word in enumerate(words):
            if _has_digit(word):
                continue
            # two words written as one there
            joined = [x for x in (words[i - 1] + word if i else "", word + words[i + 1] if i + 1 < len(words) else "") if x in shard.ids]
            k = asked.setdefault((word, *joined), len(asked))
            mine[k] = word not in SMALL
        of.append([2 * k + need for k, need in mine.items()])
    patterns = [(k, p) for (word, *joined), k in asked.items() for p in sorted(shard.counterparts(word).union(joined))]
    condition = np.array([k for k, _ in patterns], np.int64)
    low, high = shard.index.places([f" {p} ".encode() for _, p in patterns])
    count = np.bincount(condition, high - low, minlength=len(asked)).astype(np.int64)
    # the words of the shard that count for each condition
    id_condition, ids = np.array(sorted({(k, shard.ids[w]) for k, p in patterns for w in p.split()}), np.int64).reshape(-1, 2).T
    id_bounds = np.searchsorted(id_condition, np.arange(len(asked) + 1))
    flat, bounds = _lists(of)
    row = np.repeat(np.arange(len(known)), np.diff(bounds))
    needed, flat = flat % 2 == 1, flat // 2
    n_needed = np.bincount(row[needed], minlength=len(known)).astype(np.int64)
    # (text, word of the shard, condition), sorted: what each text accepts
    n_ids = np.diff(id_bounds)[flat]
    at_ids = _spread(id_bounds[flat], n_ids)
    accepted = np.repeat(row, n_ids) * width + ids[at_ids]
    accepts, order = np.unique(accepted), np.argsort(accepted, kind="stable")
    by_condition, for_condition = accepted[order], np.repeat(np.where(needed, flat, -1), n_ids)[order]

    # the shard's text holds all words of the training text: start from its rarest word
    with_need = np.flatnonzero(n_needed)
    if len(with_need):
        keyed = count[flat[needed]] * (len(asked) + 1) + flat[needed]
        rarest = np.minimum.reduceat(keyed, np.cumsum(n_needed[with_need]) - n_needed[with_need]) % (len(asked) + 1)
        wanted = np.unique(rarest)
        some = np.flatnonzero(np.isin(condition, wanted) & (high > low))
        holder = np.repeat(condition[some], (high - low)[some])
        text = shard.index.texts_of(_spread(low[some], (high - low)[some]))
        # places by condition and numbers, so that only those with the text's numbers are met
        n_kinds = len(shard.kinds)
        places = np.unique((holder * n_kinds + shard.numbers[text]) * len(shard.texts) + text)
        key = (rarest * n_kinds + kinds[known[with_need]]) * len(shard.texts)
        begin, end = np.searchsorted(places, key), np.searchsorted(places, key + len(shard.texts))
        for a, b in _parts(np.cumsum((end - begin) * (1 + n_needed[with_need]))):
            n = (end - begin)[a:b]
            mine, theirs = np.repeat(with_need[a:b], n), places[_spread(begin[a:b], n)] % len(shard.texts)
            # the conditions that the words of the place meet
            n_words = np.diff(shard.words[1])[theirs]
            pair = np.repeat(np.arange(len(mine)), n_words)
            word = mine[pair] * width + shard.words[0][_spread(shard.words[1][theirs], n_words)]
            x, y = np.searchsorted(by_condition, word), np.searchsorted(by_condition, word, side="right")
            met = np.repeat(pair, y - x) * (len(asked) + 2) + for_condition[_spread(x, y - x)] + 1
            met = np.unique(met[met % (len(asked) + 2) > 0]) // (len(asked) + 2)
            keep = np.bincount(met, minlength=len(mine)) == n_needed[mine]
            yield known[mine[keep]], theirs[keep]

    # the training text holds all words of the shard's text: its numbers and its rarest word head the entry
    heads = {(t, w) for t, mine in enumerate(of) for k in mine for w in ids[id_bounds[k // 2] : id_bounds[k // 2 + 1]].tolist()}
    heads = sorted(heads | {(t, -1) for t in range(len(known))})
    keys = sorted(shard.kinds, key=shard.kinds.__getitem__)
    number = kinds[known].tolist()
    names = {(number[t], w) for t, w in heads}
    names = {name: i for i, name in enumerate(sorted(names))}
    low, high = shard.index.places([f"\1{keys[k]}\1{shard.vocabulary[w] if w >= 0 else ''}\2".encode() for k, w in names])
    entry = np.array([names[number[t], w] for t, w in heads], np.int64)
    mine, n = np.array([t for t, _ in heads], np.int64), (high - low)[entry]
    mine, entry, n = mine[n > 0], entry[n > 0], n[n > 0]
    for a, b in _parts(np.cumsum(n)):
        rows, inverse = np.unique(_spread(low[entry[a:b]], n[a:b]), return_inverse=True)
        theirs, t = shard.index.texts_of(rows)[inverse], np.repeat(mine[a:b], n[a:b])
        n_words = np.diff(shard.required[1])[theirs]
        pair = np.repeat(np.arange(len(t)), n_words)
        word = t[pair] * width + shard.required[0][_spread(shard.required[1][theirs], n_words)]
        place = np.minimum(np.searchsorted(accepts, word), max(0, len(accepts) - 1))
        missing = np.bincount(pair[accepts[place] != word] if len(accepts) else pair, minlength=len(t))
        yield known[t[missing == 0]], theirs[missing == 0]


def _mistyped(a: str, b: str) -> bool:
    """Whether one is the other with a letter lost or doubled, or two neighbours swapped."""
    if len(a) == len(b):
        d = [i for i in range(len(a)) if a[i] != b[i]]
        return len(a) > 2 and len(d) == 2 and d[1] == d[0] + 1 and a[d[0]] == b[d[1]] and a[d[1]] == b[d[0]]
    if len(a) > len(b):
        a, b = b, a
    return len(a) > 1 and len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def _rest_is_small(words: list[str], left: Counter) -> bool:
    """Whether the words left over stand around the question or are small."""
    left = +left
    if sum(left.values()) > AROUND + 4:
        return False
    for side in (words, words[::-1]):
        for taken, word in enumerate(side):
            if taken >= AROUND or not left[word]:
                break
            left[word] -= 1
    return all(word in SMALL for word in +left)


def same_question(a: list[str], b: list[str]) -> bool:
    """Whether two questions, as words, ask the same in the same words.

    One of nothing but small words and numbers asks nothing; it only equals another such.
    """
    if bool(_required(a)) != bool(_required(b)):
        return False
    left_a, left_b = Counter(a), Counter(b)
    both = left_a & left_b
    left_a, left_b = left_a - both, left_b - both
    if any(_has_digit(w) for w in (*left_a, *left_b)):
        return False
    for x in list(left_a):
        for y in list(left_b):
            if left_a[x] > 0 and left_b[y] > 0 and _mistyped(x, y):
                left_a[x] -= 1
                left_b[y] -= 1
    left_a, left_b = +left_a, +left_b
    # a word written as two, or two as one
    for one, two, words in ((left_a, left_b, b), (left_b, left_a, a)):
        for i in range(len(words) - 1):
            x, y = words[i], words[i + 1]
            if one[x + y] > 0 and two[x] > 0 and two[y] > 0:
                one[x + y] -= 1
                two[x] -= 1
                two[y] -= 1
    left_a, left_b = +left_a, +left_b
    if sum(both.values()) < 0.5 * min(len(a), len(b)):
        return False
    small_a, small_b = all(w in SMALL for w in left_a), all(w in SMALL for w in left_b)
    if small_a and small_b:
        return sum(left_a.values()) <= 3 and sum(left_b.values()) <= 3
    return (small_a and sum(left_a.values()) <= 2 and _rest_is_small(b, left_b)) or (small_b and sum(left_b.values()) <= 2 and _rest_is_small(a, left_a))


def search(training: list[str], shard: Shard) -> list[tuple[str, str]]:
    """The pairs of equal questions of distinct normal forms and those of a shard."""
    if not training or not shard.texts:
        return []
    n = len(shard.texts)
    pairs_ = np.unique(np.concatenate([np.zeros(0, np.int64), *(a * n + b for a, b in candidates(shard, training))]))
    out = []
    for pair in pairs_.tolist():
        x, y = training[pair // n], shard.texts[pair % n]
        if same_question(x.split(), y.split()):
            out.append((x, y))
    return out


def _questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """question_key, form, split and source of each question."""
    of = distinct_rows(table(spark, sf_dir, "gold_documents"), ["doc_uid", "page"]).select("doc_uid", "page", split_kind(F.col("split_name")).alias("split"), F.lower(F.trim("source")).alias("source"))
    asked = distinct_rows(table(spark, sf_dir, "gold_questions").select("question_key", "doc_uid", "page", "question", "ingested_at"), ["question_key"])
    known = asked.join(of.filter("split is not null"), ["doc_uid", "page"])
    return known.select("question_key", normal_form(F.col("question")).alias("form"), "split", "source").filter("form is not null")


_loaded: dict[str, Shard] = {}


def _shard(path: str) -> Shard:
    """A shard from the shared folder; a worker keeps the last one."""
    import pickle

    if path not in _loaded:
        _loaded.clear()
        _loaded[path] = pickle.loads(read_bytes(path, "data"))
    return _loaded[path]


def pairs(questions: DataFrame, texts: int = SHARD) -> DataFrame:
    """train_form and eval_form of equal questions, by representatives; shards have about ``texts`` texts."""
    import pickle

    spark = questions.sparkSession
    held = questions.filter("split <> 'train'").select("form").distinct()
    shards = max(1, -(-held.count() // texts))
    folder = shared_folder(spark, "overlap")

    def build(frame: pd.DataFrame) -> pd.DataFrame:
        shard = Shard(sorted(frame["form"]))
        return pd.DataFrame({"shard": [int(frame["shard"].iloc[0])], "data": [pickle.dumps(shard, 4)]})

    sharded = held.withColumn("shard", F.pmod(F.xxhash64("form"), F.lit(shards)).cast("int"))
    sharded.repartition(shards, "shard").groupBy("shard").applyInPandas(build, "shard int, data binary").write.partitionBy("shard").parquet(folder)
    # a hash may leave a shard without texts
    paths = [f"{folder}/shard={r['shard']}" for r in sharded.select("shard").distinct().collect()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[str] = []

        def look_up() -> pa.RecordBatch:
            found_ = [pair for path in paths for pair in search(waiting, _shard(path))]
            return pa.RecordBatch.from_arrays([pa.array([p[i] for p in found_], pa.string()) for i in (0, 1)], ["train_form", "eval_form"])

        for batch in batches:
            waiting += batch.column(0).to_pylist()
            if len(waiting) >= BATCH:
                yield look_up()
                waiting.clear()
        if waiting:
            yield look_up()

    # searching is work beside its bytes: a fixed number of partitions is not coalesced by size
    asked = questions.filter("split = 'train'").select("form")
    train = asked.repartition(max(spark.sparkContext.defaultParallelism, -(-asked.count() // BATCH)), "form").distinct()
    return train.mapInArrow(run, "train_form string, eval_form string")


def found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """key_a, key_b (the smaller first) of each train and dev or test question that are the same."""
    questions = saved(_questions(spark, sf_dir))
    train = questions.filter("split = 'train'").select(F.col("form").alias("train_form"), F.col("question_key").alias("train_key"))
    held = questions.filter("split <> 'train'").select(F.col("form").alias("eval_form"), F.col("question_key").alias("eval_key"))
    keyed = pairs(questions).join(train, "train_form").join(held, "eval_form")
    return keyed.select(F.least("train_key", "eval_key").alias("key_a"), F.greatest("train_key", "eval_key").alias("key_b")).distinct()


def report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per split and source: its questions also asked in training, and the pairs, counted by multiplicity."""
    questions = saved(_questions(spark, sf_dir))
    times = questions.filter("split = 'train'").groupBy(F.col("form").alias("train_form")).agg(F.countDistinct("question_key").alias("n"))
    partners = pairs(questions).join(times, "train_form").groupBy(F.col("eval_form").alias("form")).agg(F.sum("n").alias("n"))
    held = questions.filter("split <> 'train'").select("question_key", "form", "split", "source").distinct()
    return held.join(partners, "form").groupBy("split", "source").agg(F.countDistinct("question_key").alias("questions"), F.sum("n").alias("pairs"))
