"""Near groups of a table whose columns clash with the operator's own names."""

from test_dedup_shard import HOT_IDS, brute_near, tuples

from convolens.llm.simhash import near_groups, one_per_group

SCHEMA = "doc_id long, text string, fp long, first string, u int, v int, node long, component string, hash int, row int, key int, n int"


def test_clashing_names(spark):
    rows = [(d, t, 1, "f", 2, 3, 4, "c", 5, 6, 7, 8) for d, t, *_ in HOT_IDS if d is not None]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    assert tuples(near_groups(df)) == sorted(brute_near(rows), key=repr)
    assert one_per_group(df).columns == df.columns
