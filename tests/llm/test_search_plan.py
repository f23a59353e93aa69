"""The search of opened groups isn't one large plan: the driver would optimize it anew after each shuffle."""

from lumafind.llm import ngram_join


def test_search_plan(spark):
    docs = spark.createDataFrame([(1, "a b c d e f g h i j k"), (2, "a b c d e f g h i j k"), (3, "other words")], "doc_id long, text string")
    asked = spark.createDataFrame([(2, 1)], "holds long, u long")
    members = spark.createDataFrame([(2, 2), (2, 3)], "holds long, v long")
    found = ngram_join.searched(asked, members, docs)
    assert [tuple(r) for r in found.collect()] == [(1, 2)]
    #: 21 shuffles before sizes, members and texts were written.
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Join") <= 4
