from pyspark.sql import functions as F

from quillon.llm import decontamination as D

ITEM = "A train leaves the station at 40 km from the old Paris bridge and reaches the 90 meters tall tower after 12 minutes of slow travel."
OTHER = "Every careful reader of these lengthy passages will remember how the quiet miller counted seven grey geese beside the river."


def found(spark, docs, items, **kw):
    bench = spark.createDataFrame(items, "item_id long, text string, h string, pos string")
    return {(r["doc_id"], r["item_id"]): (r["windows"], r["coverage"], r["changed"]) for r in D.leaks(docs, bench, **kw).collect()}


def test_verbatim_parameters_and_consistency(spark, make_docs, prose):
    other = ITEM.replace("40", "75").replace("Paris", "London").replace("90", "88").replace("km", "miles")
    same = "The box holds 5 red balls and the bag holds 5 blue balls so that together they hold twice 5 balls in all."
    consistent, broken = same.replace("5", "8"), same.replace("5", "8", 1).replace("5", "9", 1)
    rows = [
        (1, prose(1) + " " + ITEM + " " + prose(2)), (2, prose(3) + ". " + other + " " + prose(4)), (3, prose(5)), (4, OTHER.split(" of ")[0]), (5, consistent), (6, broken),
        (7, None), (8, ""), (None, ITEM), (9, (prose(9, 40_000) + ".\n") + OTHER), (10, OTHER), (10, OTHER), (11, "NUM " * 50),
    ]
    got = found(spark, make_docs(rows), [(1, ITEM, "", ""), (2, OTHER, "", ""), (3, same, "", ""), (4, None, "", ""), (None, "x", "", ""), (5, "", "", ""), (6, "too short", "", ""), (7, "...", "", "")])
    assert {k for k in got} == {(1, 1), (2, 1), (5, 3), (9, 2), (10, 2)}
    assert got[1, 1][2] == 0 and got[2, 1][2] == 4 and got[5, 3][2] == 1 and got[10, 2][1] == 1.0


def test_short_items_partial_passages_and_empty_tables(spark, make_docs):
    words = OTHER.split(" ")
    rows = [(1, "And then. " + " ".join(words[2:15])), (2, "But no. " + " ".join(words[2:10])), (3, "Some text. What is the capital now? More text."), (4, "He said. Five words are enough here, no?")]
    got = found(spark, make_docs(rows), [(1, OTHER, "", ""), (2, "What is the capital now", "", ""), (3, "Five words are enough here", "", "")])
    assert set(got) == {(1, 1), (3, 2), (4, 3)}
    assert found(spark, make_docs([]), [(1, OTHER, "", "")]) == {} and found(spark, make_docs(rows), []) == {}


def test_clean_keeps_columns(spark, make_docs):
    docs = make_docs([(1, OTHER), (2, "clean"), (None, OTHER), (3, None)])
    bench = spark.createDataFrame([(1, OTHER)], "item_id long, text string")
    kept = D.clean(docs, D.leaks(docs, bench))
    assert kept.columns == docs.columns and sorted((r["doc_id"] or 0) for r in kept.collect()) == [0, 2, 3]


def test_names_that_open_sentences_case_and_values_of_several_words(spark, make_docs, prose):
    tom = "Tom has 3 apples. Tom buys 5 more. Tom gives 2 away. Tom sells 4 of them."
    long = "The old miller paid 40 coins for six sacks to Paris traders"
    lower = "now how is many with the other thing. "
    rows = [
        (1, lower + prose(1) + ".\n" + tom.replace("Tom", "Ann").replace("3", "7")), (2, prose(2) + " " + long.upper()), (3, prose(3) + " " + ITEM.lower()),
        (4, prose(4) + ". " + long.replace("40", "1,000").replace("Paris", "New York")), (5, prose(5) + ". " + tom.replace("Tom buys", "Ann buys").replace("Tom sells", "Bob sells")),
        (6, "the capital is where it was, and what it was. Where is the capital now?"), (7, "so he said What is the capital now"),
    ]
    got = found(spark, make_docs(rows), [(1, tom, "", ""), (2, long, "", ""), (3, ITEM, "", ""), (4, "What is the capital now?", "", "")])
    assert set(got) == {(1, 1), (2, 2), (3, 3), (4, 2), (7, 4)}
    assert got[1, 1][2] == 2 and got[4, 2][2] == 2


def test_items_rich_in_slots_are_found_verbatim(spark, make_docs, prose):
    items = [(1, "3 4 5 12 13 8 15 17 7 24 25 20 21 29", "", ""), (2, "Add Anna Bauer Carl Dorn Emil Frank Gina Haas", "", ""), (3, "WHO WROTE THE BOOK OF JUNGLE TALES IN LONDON", "", "")]
    rows = [(i, prose(i) + ". " + t + " " + prose(10 + i)) for i, t, _, _ in items] + [(4, prose(4) + " 3 4 5 12 13 8 15 99 7 24 25 20 21 29")]
    assert set(found(spark, make_docs(rows), items)) == {(1, 1), (2, 2), (3, 3)}


def test_items_of_few_words_are_found_as_whole_lines(spark, make_docs, prose):
    items = [(1, "Seven plus four?", "", ""), (2, "Yes", "", ""), (3, "7 + 4 = 11", "", ""), (4, "Name the capital city", "", "")]
    rows = [(1, prose(1) + "\n  seven PLUS four ?\n" + prose(2)), (2, "It is said that seven plus four is eleven, yes."), (3, "YES"), (4, "7 + 4 = 11\nmore"), (5, "1 7 4 11"), (6, "yes\nseven plus\nfour"), (7, "a b c\nName the capital city")]
    assert {k: v[:2] for k, v in found(spark, make_docs(rows), items).items()} == {(1, 1): (1, 1.0), (3, 2): (1, 1.0), (4, 3): (1, 1.0), (6, 1): (1, 1.0), (6, 2): (1, 1.0), (7, 4): (1, 1.0)}


def test_rows_of_one_id_are_documents_and_items_of_their_own(spark, make_docs, prose):
    words = OTHER.split(" ")
    rows = [(1, " ".join(words[:9])), (1, " ".join(["x"] * 6 + words[6:])), (2, OTHER), (2, prose(1)), (3, prose(2) + ". " + ITEM)]
    got = found(spark, make_docs(rows), [(1, OTHER, "", ""), (1, ITEM, "", "")])
    assert set(got) == {(1, 1), (2, 1), (3, 1)} and got[2, 1][1] == got[3, 1][1] == 1.0 and got[1, 1][0] == len(words) - 6 - 7


def test_clean_with_clashing_names(spark, make_docs):
    docs = make_docs([(1, OTHER), (2, "clean")]).withColumns({c: F.lit(1) for c in ("gone", "__gone", "gone_")})
    kept = D.clean(docs, D.leaks(docs, spark.createDataFrame([(1, OTHER)], "item_id long, text string")))
    assert kept.columns == docs.columns and [r["doc_id"] for r in kept.collect()] == [2]
