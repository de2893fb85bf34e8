"""prefixes are made as long as names are, and never sent to the driver."""

from canopia.operators import runs


def test_prefixes_of_used_lengths(spark):
    trees = spark.createDataFrame([("ab",), ("abcd",), ("x",), ("",), (None,)], "tree string")
    files = spark.createDataFrame([("abcde",), ("ab",), ("a",), ("xy",), (None,)], "file string")
    df = runs.runs_of_prefix(trees, files, exact=False)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in plan and "sequence" not in plan
    assert sorted((r.tree, r.file) for r in df.collect()) == [("ab", "ab"), ("ab", "abcde"), ("abcd", "abcde"), ("x", "xy")]
    assert runs.runs_of_prefix(trees.limit(0), files, exact=False).count() == 0
