"""Many models of one tree: grouping files by name, and summaries over the runs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canopia.functions.names import run_name


def named(files: DataFrame, file: str = "file") -> DataFrame:
    return files.select("*", *[c.alias(k) for k, c in run_name(F.col(file)).items()])


def over_runs(files: DataFrame, values: list[str], by: str = "tree") -> DataFrame:
    """Per tree: number of runs, mean and sample deviation of each value (null of a single run), and the last run's parameters."""
    aggregates = [f(c).alias(f"{c}_{n}") for c in values for n, f in (("mean", F.avg), ("sd", F.stddev_samp))]
    return named(files).groupBy(by).agg(F.count(F.lit(1)).alias("n"), *aggregates, F.max_by("parameters", "iteration").alias("parameters"))


def spread(files: DataFrame, values: list[str], by: str = "tree") -> DataFrame:
    """Long: per tree and attribute its mean, least, most, sample deviation and coefficient of variation in percent."""
    long = named(files).unpivot([by], values, "attribute", "value")
    return long.groupBy(by, "attribute").agg(
        F.avg("value").alias("mean"), F.min("value").alias("least"), F.max("value").alias("most"), F.stddev_samp("value").alias("sd"),
        (F.stddev_samp("value") / F.nullif(F.avg("value"), F.lit(0.0)) * 100).alias("cv_pct"),
    )


def runs_of_prefix(trees: DataFrame, files: DataFrame, exact: bool = True) -> DataFrame:
    """Files of each tree. ``exact`` compares names; otherwise a file belongs to every tree whose name it starts with, as a glob would have it.

    The names a file can belong to are its own prefixes, as long as some tree's name is, so this is an equality join as well. Spark does not know how many
    rows a file becomes and would broadcast them all, so it is told to join sorted rows.
    """
    f = named(files) if exact else files
    if exact:
        return trees.join(f, "tree")
    lengths = sorted(n for (n,) in trees.select(F.length("tree")).distinct().collect() if n)
    own = F.filter(F.array(*[F.lit(n) for n in lengths]).cast("array<int>"), lambda n: n <= F.length("file"))
    prefixes = files.withColumn("tree", F.explode(F.transform(own, lambda n: F.substring(F.col("file"), F.lit(1), n))))
    return trees.join(prefixes.hint("merge"), "tree")


def not_done(work: DataFrame, done: DataFrame, key: str = "file") -> DataFrame:
    """What is still to do: rows whose key no finished item has."""
    return work.join(done.select(key), key, "left_anti")
