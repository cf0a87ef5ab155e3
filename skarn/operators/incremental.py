"""Incremental index maintenance: differences of manifests, plans, merged diffs, and their application."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import written

def manifest_diff(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """relative_path, state (new, changed, deleted, unchanged) in one full outer join."""
    a = files.select("relative_path", F.col("hash").alias("now"))
    b = manifest.select("relative_path", F.col("hash").alias("was"))
    both = a.join(b, "relative_path", "full_outer")
    state = F.when(F.col("was").isNull(), "new").when(F.col("now").isNull(), "deleted").when(F.col("was") != F.col("now"), "changed").otherwise("unchanged")
    return both.select("relative_path", state.alias("state"))


def plan(diff: DataFrame) -> DataFrame:
    """relative_path, action (add, update, delete) for what is not unchanged."""
    action = F.when(F.col("state") == "new", "add").when(F.col("state") == "changed", "update").otherwise("delete")
    return diff.where("state <> 'unchanged'").select("relative_path", action.alias("action"))


def parse_name_status(lines: DataFrame, col: str = "line") -> DataFrame:
    """status, path, old_path, and the other columns, of lines of a name-status diff: A, M, D, or Rnn with two paths."""
    parts = F.split(col, "\t")
    renamed = parts[0].startswith("R")
    return lines.select(*[c for c in lines.columns if c != col], F.substring(parts[0], 1, 1).alias("status"), F.when(renamed, F.try_element_at(parts, F.lit(3))).otherwise(parts[1]).alias("path"), F.when(renamed, parts[1]).alias("old_path"))


def merge_changes(committed: DataFrame, working: DataFrame) -> DataFrame:
    """(path, status) of both; the working tree wins, but what a commit added stays added."""
    both = committed.select("path", "status", F.lit(1).alias("p")).unionByName(working.select("path", "status", F.lit(0).alias("p")))
    w = Window.partitionBy("path")
    added = F.max((F.col("p") == 1) & (F.col("status") == "A")).over(w)
    first = both.withColumn("added", added).withColumn("rn", F.row_number().over(w.orderBy("p", "status"))).where("rn = 1")
    return first.select("path", F.when(F.col("added") & (F.col("status") == "M"), "A").otherwise(F.col("status")).alias("status"))


def first_wins(*sides: DataFrame) -> DataFrame:
    """(path, status) of several lists; of one path the earliest list's row stays."""
    all_ = None
    for i, s in enumerate(sides):
        one = s.select("path", "status", F.lit(i).alias("p"))
        all_ = one if all_ is None else all_.unionByName(one)
    return all_.withColumn("rn", F.row_number().over(Window.partitionBy("path").orderBy("p", "status"))).where("rn = 1").select("path", "status")


def apply_plan(index: DataFrame, actions: DataFrame, fresh: DataFrame) -> DataFrame:
    """The index (any rows keyed by relative_path) without rows of planned paths, and with the fresh rows."""
    return index.join(actions.select("relative_path"), "relative_path", "left_anti").unionByName(fresh)


# ---- plans from a history of commits

# Order of what one commit does to a path: it is left before it is taken again.
_OUT, _IN, _MOD = 0, 1, 2


def _segments(log: DataFrame) -> DataFrame:
    """Stays of a file at a path: path, seg (0 for a file from before the log), born, came (the rename that brought it), left
    (the rename that took it), gone (nothing of it is at the path at the end)."""
    link = F.struct("seq", "old_path", F.col("path").alias("new_path"))
    renames = log.where("status = 'R'")
    none = F.lit(None).cast(renames.select(link.alias("x")).schema["x"].dataType)
    touches = (
        log.where("status = 'A'").select("path", "seq", F.lit(_IN).alias("kind"), none.alias("link"))
        .unionByName(log.where("status = 'M'").select("path", "seq", F.lit(_MOD).alias("kind"), none.alias("link")))
        .unionByName(log.where("status = 'D'").select("path", "seq", F.lit(_OUT).alias("kind"), none.alias("link")))
        .unionByName(renames.select("path", "seq", F.lit(_IN).alias("kind"), link.alias("link")))
        .unionByName(renames.select(F.col("old_path").alias("path"), "seq", F.lit(_OUT).alias("kind"), link.alias("link")))
    )
    by = Window.partitionBy("path").orderBy("seq", "kind", F.col("link.old_path"), F.col("link.new_path"))
    seg = F.sum((F.col("kind") == _IN).cast("int")).over(by.rowsBetween(Window.unboundedPreceding, 0))
    each = touches.withColumn("seg", seg).withColumn("at", F.row_number().over(by))
    first = lambda kind: F.min(F.when(F.col("kind") == kind, F.struct("at", "link")))
    stays = each.groupBy("path", "seg").agg(first(_IN).alias("i"), first(_OUT).alias("o"))
    last = F.max("seg").over(Window.partitionBy("path"))
    return stays.select("path", "seg", F.col("i").isNotNull().alias("born"), F.col("i.link").alias("came"), F.col("o.link").alias("left"), (F.col("o").isNotNull() | (F.col("seg") < last)).alias("gone"))


def net_changes(log: DataFrame) -> DataFrame:
    """status (A, M, D, R), path, old_path: what a history of commits (seq, status, path, old_path) does altogether.

    Files are followed through renames of renames: a rename joins the stay that it ends to the one that it begins, and each
    file's last stay is found by pointer jumping, in as many rounds as the longest chain has binary digits. A file that comes
    and goes within the history leaves nothing; one that is renamed back is modified. Of one commit, what leaves a path counts
    before what comes to it. In a history that does not add up, the rename of a file that is gone counts as an addition, an
    addition over a living file replaces it, and what else befalls a missing file counts for nothing. Null paths are left out."""
    log = log.select("seq", "status", "path", "old_path").distinct()
    stays = _segments(log.where("path is not null and (status <> 'R' or old_path is not null)"))
    stays = written(stays.withColumn("id", F.struct("path", "seg")), "stays")
    onward = stays.where("came is not null").select(F.col("came").alias("link"), F.col("id").alias("next"))
    to = written(stays.join(onward, stays["left"] == onward["link"], "left").select("id", "next"), "stays-next")
    heads = stays.join(to.where("next is not null").select(F.col("next").alias("id")), "id", "left_anti")
    while True:  # to: where each stay goes on, at twice the distance each round
        ahead = to.where("next is not null").select(F.col("id").alias("next"), F.col("next").alias("beyond"))
        if to.join(ahead.select("next"), "next", "left_semi").isEmpty():
            break
        to = written(to.join(ahead, "next", "left").select("id", F.coalesce("beyond", "next").alias("next")), "stays-next")
    end = stays.select(F.col("id").alias("end"), F.col("path").alias("to_path"), F.col("gone"))
    each = heads.select("id", "path", "born").join(to, "id").withColumn("end", F.coalesce("next", "id")).drop("next").join(end, "end")
    status = F.when(F.col("born"), "A").when(F.col("gone"), "D").when(F.col("path") == F.col("to_path"), "M").otherwise("R")
    out = each.where("not (born and gone)").withColumn("status", status)
    return out.select("status", F.when(F.col("status") == "D", F.col("path")).otherwise(F.col("to_path")).alias("path"), F.when(F.col("status") == "R", F.col("path")).alias("old_path"))


def git_plan(files: DataFrame, manifest: DataFrame, net: DataFrame) -> DataFrame:
    """relative_path, action (add, update, delete), reason (added, modified, renamed, deleted, replaced, catch_all), old_path.

    What the history takes away is deleted, unless it is there again; what it adds, changes or renames is indexed where the
    crawl has it; files that neither the history nor the manifest knows are added at the end."""
    there = files.select(F.col("relative_path").alias("path")).distinct()
    gone = net.where("status in ('D', 'R')").select(F.when(F.col("status") == "D", F.col("path")).otherwise(F.col("old_path")).alias("path")).distinct().withColumn("gone", F.lit(True))
    came = net.where("status <> 'D'").join(there, "path", "left_semi")
    came = came.groupBy("path").agg(F.min(F.struct("status", "old_path")).alias("c"))  # a path is one file's
    both = came.join(gone, "path", "full_outer").join(there.withColumn("there", F.lit(True)), "path", "left")
    changed = both.select(
        F.col("path").alias("relative_path"),
        F.when(F.col("c").isNull() & F.col("there").isNull(), "delete").when(F.col("gone").isNotNull() | (F.col("c.status") == "M"), "update").otherwise("add").alias("action"),
        F.when(F.col("c").isNull() & F.col("there").isNull(), "deleted").when(F.col("gone").isNotNull(), "replaced").when(F.col("c.status") == "M", "modified").when(F.col("c.status") == "R", "renamed").otherwise("added").alias("reason"),
        F.col("c.old_path").alias("old_path"),
    )
    missed = there.withColumnRenamed("path", "relative_path").join(manifest.select("relative_path"), "relative_path", "left_anti").join(changed.select("relative_path"), "relative_path", "left_anti")
    return changed.unionByName(missed.select("relative_path", F.lit("add").alias("action"), F.lit("catch_all").alias("reason"), F.lit(None).cast("string").alias("old_path")))


def plan_stats(plan: DataFrame, files: DataFrame) -> DataFrame:
    """One row: total, added (without what only the catch-all found), updated, deleted, caught, unchanged."""
    n = lambda cond: F.count(F.when(F.expr(cond), 1))
    counts = plan.agg(n("action = 'add' and reason <> 'catch_all'").alias("added"), n("action = 'update'").alias("updated"), n("action = 'delete'").alias("deleted"), n("reason = 'catch_all'").alias("caught"))
    return counts.crossJoin(files.agg(F.countDistinct("relative_path").alias("total"))).withColumn("unchanged", F.col("total") - F.col("added") - F.col("updated") - F.col("caught"))
