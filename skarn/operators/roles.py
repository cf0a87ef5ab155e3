"""Roles, permissions and assignments as an event log: what holds when are intervals, and a state is one point of them.

Events: seq (distinct), op, role, item. Ops: create (a role anew, without permissions and parents), delete (the role, its
permissions, parents and assignments), grant / revoke (a permission in `item`), inherit / disinherit (a parent), assign /
unassign (a user), leave (a user from all roles; role is null). What is done to a role that does not exist counts for nothing,
as do permissions that are not well formed. Parents need not exist and cycles are not refused while the log grows: `problems`
reports both, and `imported` refuses them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .evaluation import running
from .graph import closure

KINDS = {"permission": ("grant", "revoke"), "parent": ("inherit", "disinherit"), "user": ("assign", "unassign")}
# Roles that an import can start from.
TEMPLATES = {
    "readonly": ["file:read", "tool:execute:analyze_dependency", "tool:execute:find_symbol", "tool:execute:validate_code"],
    "developer": ["file:read", "file:write", "file:create", "tool:execute:*"],
    "admin": ["*"],
}


def _lives(log: DataFrame) -> DataFrame:
    """role, life, born, died (null: still there) of each time that a role existed."""
    w = Window.partitionBy("role").orderBy("seq")
    turns = log.where("op in ('create', 'delete') and role is not null").select("role", "seq", "op", F.lead("seq").over(w).alias("died"))
    return turns.where("op = 'create'").select("role", F.col("seq").alias("born"), "died")


def intervals(log: DataFrame, kind: str) -> DataFrame:
    """role, item, since, until (null: still so) of a kind: permission, parent or user. Each event belongs to the life of its
    role that it falls in; runs of the same state are one interval."""
    on, off = KINDS[kind]
    lives = _lives(log)
    valid = T.permission_valid(F.col("item")) if kind == "permission" else F.lit(True)
    own = log.where(F.col("op").isin(on, off) & F.col("item").isNotNull() & valid).select("role", "item", "seq", (F.col("op") == on).alias("on"))
    if kind == "user":
        left = log.where("op = 'leave'").select("item", "seq")
        held = own.select("role", "item").distinct()
        own = own.unionByName(held.join(left, "item").select("role", "item", "seq", F.lit(False).alias("on")))
    # The life that an event falls in: the last one that began before it.
    w = Window.partitionBy("role").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    marks = lives.select("role", F.col("born").alias("seq"), F.lit(None).cast("string").alias("item"), F.lit(None).cast("boolean").alias("on"), F.struct("born", "died").alias("life"))
    placed = marks.unionByName(own.withColumn("life", F.lit(None).cast(marks.schema["life"].dataType))).withColumn("life", F.last("life", ignorenulls=True).over(w))
    placed = placed.where("item is not null and life is not null and (life.died is null or seq < life.died)")
    w = Window.partitionBy("role", "item", "life.born").orderBy("seq")
    turns = placed.withColumn("was", F.lag("on").over(w)).where("(was is null and on) or was <> on")
    turns = turns.withColumn("next", F.lead("seq").over(w))
    return turns.where("on").select("role", "item", F.col("seq").alias("since"), F.coalesce("next", "life.died").alias("until"))


def holds(at: Column) -> Column:
    """Whether an interval holds at a point of the log, after the event of that seq."""
    return (F.col("since") <= at) & (F.col("until").isNull() | (F.col("until") > at))


#: Bits of a point of the log that one level of the aligned ranges of `held_at` drops.
STEP = 3


def _ends(points: DataFrame) -> tuple[int, int]:
    ends = points.agg(F.min("seq"), F.max("seq")).first()
    return (ends[0], ends[1]) if ends[0] is not None else (0, 0)


def held_at(points: DataFrame, spans: DataFrame, key: str, ends: tuple[int, int] | None = None) -> DataFrame:
    """points (key, seq and others) with the spans (key, since, until and others) of their key that hold at that seq. ends: no
    point lies outside of them; they are looked up where none are given.

    A span is cut into the fewest ranges of 8^l numbers that begin at a multiple of their length; a point lies in one range of
    each length. Exactly one range of a span is also a range of a point in it, so an equal join of ranges gives each pair once
    and meets no other pair."""
    low, high = ends or _ends(points)
    most = 0
    while (high >> STEP * most) - (low >> STEP * most) >= 1 << STEP:
        most += 1
    levels = F.explode(F.sequence(F.lit(0), F.lit(most))).alias("_level")
    own = points.select("*", levels).withColumn("_range", F.expr(f"shiftright(cast(seq as bigint), {STEP} * _level)"))

    # Outside of all points nothing need be cut.
    inside = spans.withColumns({"_a": F.greatest(F.col("since").cast("long"), F.lit(low).cast("long")), "_b": F.least(F.coalesce(F.col("until").cast("long"), F.lit(high + 1).cast("long")), F.lit(high + 1).cast("long"))})
    inside = inside.where("_a < _b").select("*", levels)
    up, down = (lambda plus: F.expr(f"-shiftright(-_a, {STEP} * (_level + {plus}))")), (lambda plus: F.expr(f"shiftright(_b, {STEP} * (_level + {plus}))"))
    inside = inside.withColumns({"_lo": up(0), "_hi": down(0), "_lo2": up(1), "_hi2": down(1)}).where("_lo < _hi")
    # What the next level leaves over at both ends; all, where it takes nothing.
    run = lambda a, b: F.when(a < b, F.sequence(a, b - 1)).otherwise(F.array().cast("array<bigint>"))
    rest = F.concat(run(F.col("_lo"), F.col("_lo2") * (1 << STEP)), run(F.col("_hi2") * (1 << STEP), F.col("_hi")))
    ranges = F.when((F.col("_level") < most) & (F.col("_lo2") < F.col("_hi2")), rest).otherwise(F.sequence("_lo", F.col("_hi") - 1))
    cut = inside.withColumn("_range", F.explode(ranges)).drop("_a", "_b", "_lo", "_hi", "_lo2", "_hi2")
    return own.join(cut, [key, "_level", "_range"]).drop("_level", "_range")


def exported(log: DataFrame, at: int | None = None) -> DataFrame:
    """kind (role, permission, parent, user), role, item of the state after event `at`, or after the last."""
    log = log if at is None else log.where(F.col("seq") <= at)
    out = _lives(log).where("died is null").select(F.lit("role").alias("kind"), "role", F.lit(None).cast("string").alias("item"))
    for kind in KINDS:
        out = out.unionByName(intervals(log, kind).where("until is null").select(F.lit(kind).alias("kind"), "role", "item"))
    return out


def problems(state: DataFrame) -> DataFrame:
    """problem (cycle, dangling parent, dangling user, bad permission), role, item of an exported state."""
    roles = state.where("kind = 'role'").select("role").distinct()
    parents = state.where("kind = 'parent'").select("role", F.col("item").alias("parent")).distinct()
    loose = parents.join(roles.withColumnRenamed("role", "parent"), "parent", "left_anti").select(F.lit("dangling parent").alias("problem"), "role", F.col("parent").alias("item"))
    reach = closure(parents.select(F.col("role").alias("src"), F.col("parent").alias("dst")), parents.select(F.col("role").alias("node")).distinct())
    back = parents.join(reach.select(F.col("start").alias("parent"), F.col("node").alias("role")), ["parent", "role"], "left_semi").select(F.lit("cycle").alias("problem"), "role", F.col("parent").alias("item"))
    users = state.where("kind = 'user'").join(roles, "role", "left_anti").select(F.lit("dangling user").alias("problem"), "role", "item")
    bad = state.where("kind = 'permission'").where(~T.permission_valid(F.col("item"))).select(F.lit("bad permission").alias("problem"), "role", "item")
    return loose.unionByName(back).unionByName(users).unionByName(bad)


def imported(state: DataFrame, first: int = 1) -> DataFrame:
    """A log whose state is the one given: roles first, then what they hold. Refuses a state with problems."""
    found = problems(state).limit(3).collect()
    if found:
        raise ValueError("; ".join(f"{r.problem}: {r.role} {r.item}" for r in found))
    op = F.when(F.col("kind") == "role", "create")
    for kind, (on, _) in KINDS.items():
        op = op.when(F.col("kind") == kind, on)
    placed = running(state.distinct().withColumn("_held", F.col("kind") != "role"), F.lit(1), "_held", "role", "kind", "item", name="_n")
    return placed.select((F.col("_n") + (first - 1)).cast("long").alias("seq"), op.alias("op"), "role", "item")


def template(spark, name: str, first: int = 1) -> DataFrame:
    """The log that makes one of the roles that come with the engine."""
    rows = [(first, "create", name, None)] + [(first + i, "grant", name, p) for i, p in enumerate(TEMPLATES[name], 1)]
    return spark.createDataFrame(rows, "seq long, op string, role string, item string")


def allowed_then(log: DataFrame, requests: DataFrame) -> DataFrame:
    """requests (request_id, user, request, seq) with `granted`: whether a role that the user had after event `seq` had a
    permission then that matches. Two joins as of that point (`held_at`); inheritance is not followed."""
    users, perms = intervals(log, "user").withColumnRenamed("item", "user"), intervals(log, "permission").withColumnRenamed("item", "permission")
    ends = _ends(requests)
    had = held_at(requests.select("request_id", "user", "request", "seq"), users, "user", ends).select("request_id", "request", "seq", "role")
    held = held_at(had, perms, "role", ends).select("request_id", "request", "permission")
    ok = held.where(T.permission_matches(F.col("permission"), F.col("request"))).select("request_id").distinct()
    return requests.join(ok.withColumn("_ok", F.lit(True)), "request_id", "left").withColumn("granted", F.coalesce("_ok", F.lit(False))).drop("_ok")
