"""Units of figures: what is stated closest holds, amounts are exact."""

import pytest

from folioflow.operators import units as U


@pytest.mark.parametrize(
    ("text", "unit"),
    [
        ("(in thousands)", ("money", 3)), ("RMB'Million", ("money", 6)), ("$MM", ("money", 6)), ("£000s", ("money", 3)), ("US$ '000", ("money", 3)), ("€m", ("money", 6)), ("₹ in lakhs", ("money", 5)),
        ("₹ crore", ("money", 7)), ("in hundreds of millions", ("money", 8)), ("en miles de millones de euros", ("money", 9)), ("en miles de euros", ("money", 3)), ("Md€", ("money", 9)), ("in TEUR", ("money", 3)),
        ("T€", ("money", 3)), ("in whole dollars", ("money", 0)), ("in kilowatt hours", ("energy", 0)), ("GWh", ("energy", 6)), ("in metric tons", ("mass", 3)), ("kt", ("mass", 6)), ("t CO2e", ("mass", 3)),
        ("In millions, except percentages", ("money", 6)), ("Revenue rose by $30.3 million over the prior year.", None), ("Segment results", None), ("2016 Thousands of euros", ("money", 3)),
    ],
)
def test_declared(text, unit):
    assert U.declared(text) == unit


@pytest.mark.parametrize(
    ("text", "language", "key"),
    [
        ("$ 123.8", "en", "money+1238e-1"), ("(567)", "en", "money-567e0"), ("1.219,5", "de", "money+12195e-1"), ("99 880", "fr", "money+9988e1"), ("436.0k", "en", "money+436e3"), ("977,1 Mrd. €", "de", "money+9771e8"),
        ("33 bps", "en", "percent+33e-2"), ("(22.1)%", "en", "percent-221e-1"), ("1.2 GWh", "en", "energy+12e5"), ("−118", "en", "money-118e0"), ("0.12 *", "en", "money+12e-2"), ("１２．８", "en", "money+128e-1"),
    ],
)
def test_figures(text, language, key):
    read = U.figure(text, language)
    assert U.amount(read, read[3] or U.ONES) == key


@pytest.mark.parametrize("text", ["", "—", "n/a", "0", "0.00", "12 34", "1,23", "text", "(5"])
def test_no_figure(text):
    assert U.figure(text, "en") is None


def test_precedence():
    cells = [(0, 0, 1, ""), (0, 1, 2, "2019"), (0, 2, 3, "% change"), (1, 0, 4, "Revenue"), (1, 1, 5, "5"), (1, 2, 6, "3"), (2, 0, 7, "Rate (%)"), (2, 1, 8, "4"), (3, 0, 9, "Earnings per share"), (3, 1, 10, "0.5"), (4, 0, 11, "Cash"), (4, 1, 12, "2 mn")]
    got = dict(U.table_amounts(cells, "en", "(in thousands)", None, []))
    assert got == {5: "money+5e3", 6: "percent+3e0", 8: "percent+4e0", 10: "money+5e-1", 12: "money+2e6"}
    stem = [(0, 0, 1, ""), (0, 1, 2, "2019"), (1, 0, 3, "(US$ billions)"), (1, 1, 4, ""), (2, 0, 5, "Cash"), (2, 1, 6, "7")]
    assert dict(U.table_amounts(stem, "en", None, "Amounts in thousands.", [])) == {6: "money+7e9"}


def test_answers():
    assert U.answer_amount("(1,577.0 kg)", "") == "mass-1577e0"
    assert U.answer_amount("0.0137", "million") == "money+137e2"
    assert U.answer_amount("12", None) == U.answer_amount("12", "none") == "money+12e0"
    assert U.answer_amount("a; b", "") is None and U.answer_amount(None, None) is None


MILLION, THOUSAND, PERCENT = ("money", 6), ("money", 3), ("percent", 0)


def stated(own=None, row=None, header=None, table=None):
    return (own, row, header, table)


def test_viterbi_follows_statements():
    assert U.viterbi([1.0, 4.0, 1.2], [stated(own=u) for u in (MILLION, THOUSAND, MILLION)]) == [MILLION, THOUSAND, MILLION]
    # the closer of two statements, against every jump
    assert U.viterbi([1.0, 1.0, 1.0], [stated(own=MILLION), stated(row=THOUSAND, table=MILLION), stated(own=MILLION)])[1] == THOUSAND
    assert U.viterbi([1.0], [stated()]) == [U.ONES] and U.viterbi([2.0, 1.0], [stated(table=PERCENT)] * 2) == [PERCENT] * 2


def test_the_level_decides_where_statements_are_missing_or_weak():
    # 5.1 million, 5.2, 5.3 million: no statement for the second, whose level fits millions only
    assert U.viterbi([0.71, 0.72, 0.72], [stated(own=MILLION), stated(), stated(own=MILLION)]) == [MILLION] * 3
    # 5.1 million, 5,200,000, 5.3 million: ones, as the level says too
    assert U.viterbi([0.71, 6.72, 0.72], [stated(own=MILLION), stated(), stated(own=MILLION)]) == [MILLION, U.ONES, MILLION]
    # the table says thousands, both neighbours' own texts say millions
    assert U.viterbi([0.71, 0.72, 0.72], [stated(own=MILLION), stated(table=THOUSAND), stated(own=MILLION)]) == [MILLION] * 3
    # one neighbour is not enough
    assert U.viterbi([0.71, 0.72], [stated(own=MILLION), stated(table=THOUSAND)]) == [MILLION, THOUSAND]


def test_viterbi_is_the_best_path():
    import itertools
    import random

    rng = random.Random(5)
    units = [MILLION, THOUSAND, PERCENT, U.ONES]
    for _ in range(200):
        n = rng.randrange(1, 5)
        levels, said = [rng.uniform(0, 7) for _ in range(n)], [tuple(rng.choice([None, None, *units]) for _ in range(4)) for _ in range(n)]

        def score(path):
            total = 0.0
            for i, unit in enumerate(path):
                of = [w for u, w in zip(said[i], U.WEIGHTS) if u == unit]
                total += max(of, default=U.WEIGHTS[-1] if not any(said[i]) and unit == U.ONES else 0.0)
                if i:
                    before = path[i - 1]
                    total -= U.SWITCH * (unit != before)
                    if unit[0] == before[0]:
                        total -= min(U.MOST_JUMP, U.JUMP * abs(levels[i] + unit[1] - levels[i - 1] - before[1]))
            return total

        states = {u for of in said for u in of if u} | {U.ONES}
        assert score(U.viterbi(levels, said)) == pytest.approx(max(map(score, itertools.product(states, repeat=n))))


def test_empty_and_null(spark):
    cells = spark.createDataFrame([("d", 1, 0, 0, 1, 1, None, None, 5, "x")], "doc_id string, page_number int, block_ord int, cell_ord int, row_idx int, col_idx int, text string, is_header boolean, cell_key bigint, extra string")
    t = spark.createDataFrame([], "doc_id string, page_number int, block_ord int, caption string")
    b = spark.createDataFrame([], "doc_id string, page_number int, block_ord int, text string")
    p = spark.createDataFrame([], "doc_id string, page_number int, language string")
    s = spark.createDataFrame([], "doc_id string, page_number int, block_ord int, candidate_ord int, source string, text string")
    assert U.cell_amounts(cells, t, b, p, s).count() == 0
    assert U.cell_amounts(cells.limit(0), t, b, p, s).count() == 0
