"""Re-parameterised, shifted and number-heavy copies of benchmark items."""

import pytest

from alertweft.llm import templates

TOM = "Tom has 3 apples in the small basket and 5 pears on the wide table, then Tom buys 4 more of both at the corner shop for 3 dollars each."
TWELVE = "12 apples lie in the large wooden basket near the door and 12 of them are red while all others are green"
LONG = ("during the last week of summer the farmer near our village picked ripe plums every morning before the sun came up and carried them "
        "down to the old market where his sister sold them by noon")
NUMBERS = "1 2 3 4 and 5 6 7 8 then 9 10 11 12 or 13 14"


@pytest.fixture(scope="module")
def bench(spark):
    return spark.createDataFrame([(1, TOM), (2, TWELVE), (3, LONG), (4, NUMBERS)], "item_id long, text string")


def found(docs, bench):
    return {(r.doc_id, r.item_id): r for r in templates.leaks(docs, bench).collect()}


def test_runs_end_with_the_sentence_and_numbers_may_coincide(spark, docs_of, bench):
    bert = TOM.replace("Tom", "Bert")
    rows = {10: "Question: " + bert.replace(" 3 ", " 7 "), 11: "Question " + bert, 12: "1. " + TWELVE, 13: "1 " + TWELVE,
            14: bert.replace(" 3 ", " 4 ").replace(" 5 ", " 4 "), 15: bert.replace("3 apples", "8 apples"),
            17: "Some other plain words about 3 apples and Tom."}
    got = found(docs_of(rows), bench)
    assert {k for k in got} == {(10, 1), (11, 1), (12, 2), (13, 2), (14, 1), (15, 1)}
    assert all(got[k].coverage == 1.0 for k in got) and got[12, 2].changed == got[13, 2].changed == 0


def test_a_word_put_in_or_left_out(spark, docs_of, bench):
    words = LONG.split()
    rows = {20: " ".join([*words[:18], "rather", *words[18:]]), 21: " ".join([*words[:18], *words[19:]]), 22: " ".join(words[1:13])}
    got = found(docs_of(rows), bench)
    assert set(got) == {(20, 3), (21, 3)} and got[20, 3].matched == len(words) - 7 - 7


def test_items_without_a_window(spark, docs_of, bench):
    rows = {30: f"see {NUMBERS} there", 31: NUMBERS.replace("9", "19"), 32: NUMBERS.upper() + "."}
    assert set(found(docs_of(rows), bench)) == {(30, 4), (32, 4)}
    assert {r.doc_id for r in templates.drop_leaks(docs_of(rows), bench).collect()} == {31}
