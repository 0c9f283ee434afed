from traceloom.llm import simhash


def test_a_keepers_other_row_goes_with_its_group(spark):
    a, b, c = ("one text about rivers and stones in the north", "quite another text on ships, harbours and lights", "the third says nothing of either of those two")
    rows = [(5, a), (3, b), (5, b), (7, c), (8, c), (9, c)]
    kept = simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(map(tuple, kept.collect())) == [(3, b), (5, a), (7, c)]
