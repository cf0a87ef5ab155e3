"""Analytics of query, token, memory and task records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.shared import small

REPEAT_SECONDS, SESSION_GAP = 300, 1800
PRICE = 3.0


def seconds(ts: str) -> Column:
    return F.col(ts).cast("timestamp").cast("double")


def cache_hits(log: DataFrame, key: str = "query") -> DataFrame:
    """The log with `hit`: the same query less than five minutes after its last occurrence."""
    w = Window.partitionBy(T.query_key(F.col(key))).orderBy("ts", "event_id")
    return log.withColumn("hit", F.coalesce(seconds("ts") - F.lag(seconds("ts")).over(w) < REPEAT_SECONDS, F.lit(False)))


def query_totals(log: DataFrame) -> DataFrame:
    h = cache_hits(log)
    return h.agg(F.count(F.lit(1)).alias("total"), F.count_if("hit").alias("hits"), F.count_if(~F.col("hit")).alias("misses"), F.round(F.count_if("hit") / F.count(F.lit(1)), 9).alias("hit_rate"))


def last_n(df: DataFrame, n: int, *order: Column, part: str | None = None) -> DataFrame:
    """The newest n rows (of each part); the limit runs in each task before the shuffle."""
    w = Window.partitionBy(part) if part else Window.partitionBy()
    return df.withColumn("_rn", F.row_number().over(w.orderBy(*order))).where(F.col("_rn") <= n).drop("_rn")


def patterns(log: DataFrame, k: int = 20) -> DataFrame:
    """pattern, n, avg_latency, avg_results, examples (three least): the k most frequent, exact."""
    p = log.groupBy(T.query_pattern(F.col("query")).alias("pattern")).agg(F.count(F.lit(1)).alias("n"), F.avg("latency_ms").alias("avg_latency"), F.avg("results_count").alias("avg_results"), F.slice(F.array_sort(F.collect_set("query")), 1, 3).alias("examples"))
    return p.orderBy(F.desc("n"), "pattern").limit(k)


def token_savings(df: DataFrame, *by: str) -> DataFrame:
    """records (used, naive): totals, saved, percent and cost, by columns or overall."""
    d = df.withColumn("saved", F.greatest(F.lit(0), F.col("naive") - F.col("used")))
    used, saved = F.sum("used"), F.sum("saved")
    pct = F.when(used + saved > 0, saved / (used + saved) * 100).otherwise(0.0)
    return d.groupBy(*by).agg(F.count(F.lit(1)).alias("queries"), used.alias("used"), saved.alias("saved"), F.round(pct, 6).alias("percent"), F.round(saved / 1e6 * PRICE, 9).alias("cost"))


def sessions(events: DataFrame, gap: int = SESSION_GAP, key: str = "user_id") -> DataFrame:
    """key, session number, first, last, n: a pause of at least `gap` seconds starts a new one."""
    w = Window.partitionBy(key).orderBy("ts", "event_id")
    new = F.when(seconds("ts") - F.lag(seconds("ts")).over(w) < gap, 0).otherwise(1)
    marked = events.withColumn("new", new).withColumn("session", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy(key, "session").agg(F.min("ts").alias("first"), F.max("ts").alias("last"), F.count(F.lit(1)).alias("n"))


def samples(events: DataFrame, every: int = 5, keep: int = 100) -> DataFrame:
    """start and peak of tumbling windows of `every` seconds, the newest `keep`."""
    bucket = F.floor(seconds("ts") / every) * every
    out = events.groupBy(bucket.cast("long").alias("start")).agg(F.max("value").alias("peak"), F.count(F.lit(1)).alias("n"))
    return out.orderBy(F.desc("start")).limit(keep)


def operations(events: DataFrame, start: str, end: str, key: str = "user_id") -> DataFrame:
    """Each start event with the next end event of its key, and the peak value from one to the other."""
    is_end = (F.col("event_type") == end).cast("int")
    before = Window.partitionBy(key).orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    # What lies between two ends, the second included, is a stretch; from its end back to a start is a running maximum.
    placed = events.withColumns({"_end": is_end, "_stretch": F.coalesce(F.sum(is_end).over(before), F.lit(0))})
    back = Window.partitionBy(key, "_stretch").orderBy(F.desc("ts"), F.desc("event_id")).rowsBetween(Window.unboundedPreceding, 0)
    told = placed.withColumns({"peak": F.max("value").over(back), "n": F.count(F.lit(1)).over(back), "_ended": F.max("_end").over(back)})
    return told.where((F.col("event_type") == start) & (F.col("_ended") == 1)).select(key, F.col("event_id").alias("op"), "peak", "n")


def breakdown(df: DataFrame, values: DataFrame, by: str, *aggregates: Column) -> DataFrame:
    """Aggregates for every value of a dimension, zero where it has no rows."""
    per = df.groupBy(by).agg(*aggregates)
    out = values.select(by).distinct().join(per, by, "left")
    return out.na.fill(0)


def latest(changes: DataFrame, key: str, order: str) -> DataFrame:
    """The newest row of each key of a change log."""
    w = Window.partitionBy(key).orderBy(F.desc(order))
    return changes.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def review(code: Column, strictness: str = "normal") -> tuple[Column, Column, Column]:
    """errors, warnings and decision of the two review rules."""
    errors = (F.contains(code, F.lit("eval(")) | F.contains(code, F.lit("exec("))).cast("int")
    warnings = ((F.length(code) > 500) & ~F.contains(code, F.lit("//"))).cast("int")
    return errors, warnings, decision(errors, warnings, strictness)


def decision(errors: Column, warnings: Column, strictness: str) -> Column:
    if strictness == "strict":
        return F.when((errors > 0) | (warnings > 2), "rejected").otherwise("approved")
    if strictness == "lenient":
        return F.when(errors > 2, "rejected").otherwise("approved")
    return F.when(errors > 0, "rejected").when(warnings > 5, "escalated").otherwise("approved")


def autoscale(busy: Column, total: Column, target: float, least: int, most: int) -> Column:
    use = busy / F.greatest(total, F.lit(1)) * 100
    return F.when((use > target) & (total < most), 1).when((use < target / 2) & (total > least), -1).otherwise(0)


def assign(tasks: DataFrame, agents: DataFrame) -> DataFrame:
    """(task, agent): the first idle agent of the asked role with all asked languages. Agents are broadcast where they are few."""
    fit = (F.col("role").isNull() | (F.col("role") == F.col("agent_role"))) & (F.size(F.array_except("languages", "agent_languages")) == 0)
    pairs = tasks.join(small(agents.where("idle")), fit, "left")
    return pairs.groupBy("task").agg(F.min("agent").alias("agent"))
