"""Retrieval metrics and statistics of samples, as aggregates and windows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import written

KS = (1, 3, 5, 10, 20)


def running(df: DataFrame, amount: Column, *order: Column | str, name: str = "upto") -> DataFrame:
    """df with the sum of a whole-number amount over all rows up to each, in an order of all rows. Rows are cut into ranges
    of the order; each range is summed by itself and starts at the sum of those before it, one row a range."""
    order = [F.col(o) if isinstance(o, str) else o for o in order]
    cut = df.withColumn("_amount", amount.cast("long")).repartitionByRange(*order).withColumn("_range", F.spark_partition_id())
    cut = written(cut, "running")  # so that both uses below see the same ranges
    ranges = cut.groupBy("_range").agg(F.sum("_amount").alias("_sum"))
    before = ranges.select("_range", (F.sum("_sum").over(Window.orderBy("_range")) - F.col("_sum")).alias("_before"))
    own = F.sum("_amount").over(Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return cut.join(F.broadcast(before), "_range").withColumn(name, F.col("_before") + own).drop("_range", "_before", "_amount")


def average_ranks(df: DataFrame, value: str = "value") -> DataFrame:
    """df with `rank`: ties share the mean of their places. Counted per value first, so only distinct values are ordered."""
    per = running(df.groupBy(value).agg(F.count(F.lit(1)).alias("_n")), F.col("_n"), value)
    per = per.select(F.col(value).alias("_v"), (F.col("upto") - F.col("_n") + (F.col("_n") + 1) / 2.0).alias("rank"))
    return df.join(per, df[value] == per["_v"]).drop("_v")


def normal_cdf(z: Column) -> Column:
    """Abramowitz and Stegun 7.1.26."""
    # Coefficients of the approximation.
    p, a = 0.3275911, (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)
    x = F.abs(z) / F.sqrt(F.lit(2.0))
    t = 1.0 / (1.0 + p * x)
    poly = ((((a[4] * t + a[3]) * t + a[2]) * t + a[1]) * t + a[0]) * t
    return 0.5 * (1.0 + F.when(z < 0, -1.0).otherwise(1.0) * (1.0 - poly * F.exp(-x * x)))


def cohens_d(m1: Column, v1: Column, n1: Column, m2: Column, v2: Column, n2: Column) -> Column:
    pooled = F.sqrt(((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2))
    return F.when(pooled > 0, (m1 - m2) / pooled).otherwise(0.0)


def effect_label(d: Column) -> Column:
    return F.when(F.abs(d) < 0.2, "negligible").when(F.abs(d) < 0.5, "small").when(F.abs(d) < 0.8, "medium").otherwise("large")


def mann_whitney(df: DataFrame, group: str, first: object, second: object, value: str = "value") -> DataFrame:
    """One row: u, z, p, d of two groups of a column."""
    both = average_ranks(df.where(F.col(group).isin(first, second)).select(F.col(group).alias("g"), F.col(value).alias("value")))
    one = lambda f, g: f(F.when(F.col("g") == g, F.col("value")))
    count = lambda g: F.sum(F.when(F.col("g") == g, 1).otherwise(0)).cast("double")
    s = both.agg(count(first).alias("n1"), count(second).alias("n2"), F.sum(F.when(F.col("g") == first, F.col("rank"))).alias("r1"), one(F.avg, first).alias("m1"), one(F.avg, second).alias("m2"), one(F.var_pop, first).alias("v1"), one(F.var_pop, second).alias("v2"))
    c = F.col
    u1 = c("n1") * c("n2") + c("n1") * (c("n1") + 1) / 2 - c("r1")
    u = F.least(u1, c("n1") * c("n2") - u1)
    sd = F.sqrt(c("n1") * c("n2") * (c("n1") + c("n2") + 1) / 12)
    s = s.select("*", u.alias("u")).withColumn("z", F.when(sd > 0, (c("u") - c("n1") * c("n2") / 2) / sd).otherwise(0.0))
    return s.select("u", "z", (2 * (1 - normal_cdf(F.abs("z")))).alias("p"), cohens_d(c("m1"), c("v1"), c("n1"), c("m2"), c("v2"), c("n2")).alias("d"))


def hash_order(key: Column, seed: int) -> Column:
    """A seeded order that any engine can repeat."""
    return F.md5(F.concat(key.cast("string"), F.lit(f":{seed}")).cast("binary"))


def folds(df: DataFrame, key: str, k: int, seed: int = 42) -> DataFrame:
    """df with `fold` 0..k-1: equal folds in seeded order, what is left over in the last."""
    placed = running(df, F.lit(1), hash_order(F.col(key), seed), key, name="_place")
    n = placed.agg(F.count(F.lit(1)).alias("_n"))
    fold = F.least(F.lit(k - 1), F.floor((F.col("_place") - 1) / F.greatest(F.lit(1), F.floor(F.col("_n") / k))))
    return placed.crossJoin(F.broadcast(n)).withColumn("fold", fold.cast("int")).drop("_place", "_n")


def cross_validated(df: DataFrame, key: str, k: int, train_and_evaluate: Callable[[DataFrame, DataFrame], float], seed: int = 42) -> tuple[list[float], float, float]:
    """Scores of k folds, their mean and deviation: train_and_evaluate(train, test) of each fold's complement and the fold."""
    parts = written(folds(df, key, k, seed), "folds")
    scores = [float(train_and_evaluate(parts.where(F.col("fold") != i).drop("fold"), parts.where(F.col("fold") == i).drop("fold"))) for i in range(k)]
    mean = sum(scores) / k if k else 0.0
    return scores, mean, (sum((s - mean) ** 2 for s in scores) / k) ** 0.5 if k else 0.0


def stratified(df: DataFrame, key: str, size: int, seed: int = 42, stratum: str = "difficulty") -> DataFrame:
    """A third of the size from each of easy, medium, hard; the remainder from hard."""
    rn = F.row_number().over(Window.partitionBy(stratum).orderBy(hash_order(F.col(key), seed), key))
    quota = F.when(F.col(stratum) == "hard", size // 3 + size % 3).otherwise(size // 3)
    return df.where(F.col(stratum).isin("easy", "medium", "hard")).withColumn("_rn", rn).where(F.col("_rn") <= quota).drop("_rn")


#: Draws of a bootstrap that one task makes and counts.
DRAWS = 1 << 20


def bootstrap(df: DataFrame, value: str, key: str, rounds: int = 1000, confidence: float = 0.95, seed: int = 42) -> DataFrame:
    """One row: mean, lo, hi and std_error of an interval by resampling. In each round as many rows are drawn as there are,
    with replacement; the places drawn are md5 of round and draw, so any engine can repeat them. No row gives zeros, one
    row its value."""
    some = df.where(F.col(value).isNotNull())
    placed = running(some.select(F.col(key), F.col(value).alias("v")), F.lit(1), key, name="place").select((F.col("place") - 1).alias("place"), "v")
    n = placed.count()
    if not n:
        return df.sparkSession.range(1).select(*[F.lit(0.0).alias(c) for c in ("mean", "lo", "hi", "std_error")])
    # So many tasks that none holds more than DRAWS draws, however few partitions the rows come in.
    tasks = max(df.sparkSession.sparkContext.defaultParallelism, -(-n * rounds // DRAWS))
    draws = placed.select(F.col("place").alias("draw")).repartition(tasks).withColumn("round", F.explode(F.sequence(F.lit(1), F.lit(rounds))))
    drawn = F.conv(F.substring(F.md5(F.concat_ws(":", "round", "draw", F.lit(seed)).cast("binary")), 1, 13), 16, 10).cast("long") % n
    # Each place is drawn by some rounds times: counted before the values are joined.
    times = draws.groupBy("round", drawn.alias("place")).agg(F.count(F.lit(1)).alias("times"))
    means = times.join(placed, "place").groupBy("round").agg((F.sum(F.col("v") * F.col("times")) / n).alias("m"))
    at = lambda q: F.element_at(F.sort_array(F.collect_list("m")), F.lit(min(rounds, int(q * rounds) + 1)))  # noqa: E731  `rounds` values
    alpha = 1 - confidence
    one = means.agg(at(round(alpha / 2, 12)).alias("lo"), at(round(1 - alpha / 2, 12)).alias("hi"), F.stddev_pop("m").alias("std_error"))
    return one.crossJoin(F.broadcast(some.agg(F.avg(value).alias("mean")))).select("mean", "lo", "hi", "std_error")


def judged(runs: DataFrame, relevant: DataFrame) -> DataFrame:
    """runs (query_id, doc_id, rank) with rel (0 or 1) by the relevant pairs (query_id, doc_id)."""
    r = relevant.select("query_id", "doc_id").distinct().withColumn("rel", F.lit(1))
    return runs.join(r, ["query_id", "doc_id"], "left").withColumn("rel", F.coalesce("rel", F.lit(0)))


def ir_metrics(runs: DataFrame, relevant: DataFrame) -> DataFrame:
    """For each query: p1, p3, p5, p10, p20, recall, rr, ap and ndcg (binary)."""
    n = relevant.select("query_id", "doc_id").distinct().groupBy("query_id").agg(F.count(F.lit(1)).alias("n_rel"))
    j = judged(runs, relevant).withColumn("cum", F.sum("rel").over(Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)))
    at = [(F.sum(F.when(F.col("rank") <= k, F.col("rel")).otherwise(0)) / float(k)).alias(f"p{k}") for k in KS]
    per = j.groupBy("query_id").agg(*at, F.sum("rel").alias("hits"), F.coalesce(1.0 / F.min(F.when(F.col("rel") == 1, F.col("rank"))), F.lit(0.0)).alias("rr"), F.sum(F.when(F.col("rel") == 1, F.col("cum") / F.col("rank")).otherwise(0.0)).alias("aps"), F.sum(F.col("rel") / F.log2(F.col("rank") + 1.0)).alias("dcg"))
    out = per.join(n, "query_id", "left").withColumn("n_rel", F.coalesce("n_rel", F.lit(0)))
    ideal = F.aggregate(F.sequence(F.lit(1), F.greatest(F.lit(1), F.col("n_rel").cast("int"))), F.lit(0.0), lambda s, i: s + 1.0 / F.log2(i + 1.0))
    some = F.col("n_rel") > 0
    share = lambda c: F.when(some, c).otherwise(0.0)
    return out.select("query_id", *[f"p{k}" for k in KS], share(F.col("hits") / F.col("n_rel")).alias("recall"), "rr", share(F.col("aps") / F.col("n_rel")).alias("ap"), share(F.col("dcg") / ideal).alias("ndcg"))


def graded_ndcg(runs: DataFrame, grades: DataFrame) -> DataFrame:
    """query_id, ndcg with gains 2^grade - 1; the ideal list is all graded documents."""
    gain = lambda g, r: (F.pow(F.lit(2.0), g) - 1) / F.log2(r + 1.0)
    dcg = runs.join(grades, ["query_id", "doc_id"], "left").groupBy("query_id").agg(F.sum(gain(F.coalesce("grade", F.lit(0)), F.col("rank"))).alias("dcg"))
    order = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("grade")))
    ideal = grades.withColumn("r", order).groupBy("query_id").agg(F.sum(gain(F.col("grade"), F.col("r"))).alias("idcg"))
    return dcg.join(ideal, "query_id", "left").select("query_id", F.when(F.col("idcg") > 0, F.col("dcg") / F.col("idcg")).otherwise(0.0).alias("ndcg"))


def set_scores(found: Column, expected: Column, hit: Column) -> tuple[Column, Column, Column]:
    """precision, recall, f1 of two sets' sizes and their common size: nothing found where nothing is expected is right."""
    p = F.when(found > 0, hit / found).when(expected == 0, 1.0).otherwise(0.0)
    r = F.when(expected > 0, hit / expected).otherwise(1.0)
    return p, r, F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0)


def compared(baseline: DataFrame, current: DataFrame) -> DataFrame:
    """metrics (name, value, lower_is_better) side by side: change in percent, whether over 10, and the direction."""
    b, c = baseline.select("name", F.col("value").alias("was"), "lower_is_better"), current.select("name", F.col("value").alias("now"))
    change = F.when(F.col("was") != 0, (F.col("now") - F.col("was")) / F.col("was") * 100).otherwise(0.0)
    better = F.when(F.col("lower_is_better"), F.col("now") < F.col("was")).otherwise(F.col("now") > F.col("was"))
    return b.join(c, "name").select("name", change.alias("change"), (F.abs(change) > 10).alias("significant"), better.alias("improved"))


def assessment(comparison: DataFrame) -> DataFrame:
    """One row: improved, regressed or unchanged by counts of significant changes."""
    up = F.count_if(F.col("significant") & F.col("improved"))
    down = F.count_if(F.col("significant") & ~F.col("improved"))
    return comparison.agg(F.when(up > down, "improved").when(down > up, "regressed").otherwise("unchanged").alias("assessment"))


def nearest_rank(value: str, *percents: float) -> list[Column]:
    """Percentiles by nearest rank: the value at place ceil(p n / 100)."""
    return [F.expr(f"percentile_disc({p / 100}) WITHIN GROUP (ORDER BY {value})").alias(f"p{p:g}") for p in percents]


def floor_index(value: str, *percents: float) -> list[Column]:
    """Percentiles at index floor(p n / 100) of the sorted values. For bounded logs (a retained window of records)."""
    values = F.sort_array(F.collect_list(value))
    return [F.element_at(values, (F.floor(F.count(value) * p / 100) + 1).cast("int")).alias(f"p{p:g}") for p in percents]


def dependency_completeness(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """One row: edges expected and found, completeness min(1, actual / expected), the share of expected roots and of expected
    leaves that the actual graph has as such (1 where none is expected), and passed: completeness 0.8 and both shares 0.7."""
    e, a = expected.select("src", "dst").distinct(), actual.select("src", "dst").distinct()
    ends = lambda g, one, other: g.select(F.col(one).alias("node")).distinct().join(g.select(F.col(other).alias("node")).distinct(), "node", "left_anti")

    def share(one: str, other: str, name: str) -> DataFrame:
        want = ends(e, one, other).withColumn("want", F.lit(1))
        both = want.join(ends(a, one, other).withColumn("have", F.lit(1)), "node", "left")
        return both.agg(F.coalesce(F.sum("have") / F.sum("want"), F.when(F.count(F.lit(1)) == 0, 1.0).otherwise(0.0)).alias(name))

    n = e.agg(F.count(F.lit(1)).alias("expected")).crossJoin(a.agg(F.count(F.lit(1)).alias("actual")))  # one-row tables
    out = n.crossJoin(share("src", "dst", "roots")).crossJoin(share("dst", "src", "leaves"))
    out = out.withColumn("completeness", F.when(F.col("expected") == 0, 1.0).otherwise(F.least(F.lit(1.0), F.col("actual") / F.col("expected"))))
    return out.withColumn("passed", (F.col("completeness") >= 0.8) & (F.col("roots") >= 0.7) & (F.col("leaves") >= 0.7))


def progress(runs: DataFrame, by: str, *order: str) -> DataFrame:
    """runs with `iteration` (from 1), `total` and `share` done, for each group in its order."""
    w = Window.partitionBy(by)
    n = F.row_number().over(w.orderBy(*order))
    out = runs.withColumns({"iteration": n, "total": F.count(F.lit(1)).over(w)})
    return out.withColumn("share", F.col("iteration") / F.col("total"))
