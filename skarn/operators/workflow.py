"""Workflows as a transition table that is folded over each execution's ordered outcomes."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Retries of a stage without a policy of its own.
RETRIES = 3


@dataclass(frozen=True)
class Stage:
    """veto: a rejection sends the stage back. After `retries` rejections it goes on, and is escalated where there were as many
    as `escalate_at` (0: never)."""

    id: str
    veto: bool = False
    retries: int = RETRIES
    escalate_at: int = 0


@dataclass(frozen=True)
class Workflow:
    """Stages and the transitions (from, to) between them; of several from one stage the first counts. It ends behind a
    terminal stage, or one that nothing follows."""

    name: str
    entry: str
    stages: tuple[Stage, ...]
    transitions: tuple[tuple[str, str], ...] = ()
    terminal: tuple[str, ...] = field(default=())

    def __post_init__(self) -> None:
        known = {s.id for s in self.stages}
        missing = ({self.entry} | {x for t in self.transitions for x in t} | set(self.terminal)) - known
        if missing:
            raise ValueError(f"unknown stages: {', '.join(sorted(missing))}")

    def following(self) -> dict[str, str]:
        out: dict[str, str] = {}
        for a, b in self.transitions:
            if a not in self.terminal:
                out.setdefault(a, b)
        return out


# The workflows that come with the engine.
TEMPLATES = {
    "code-review": Workflow("code-review", "implement", (Stage("implement"), Stage("review", True, 3, 2)), (("implement", "review"),), ("review",)),
    "tdd-cycle": Workflow("tdd-cycle", "write-test", (Stage("write-test"), Stage("implement"), Stage("refactor", True)), (("write-test", "implement"), ("implement", "refactor")), ("refactor",)),
    "parallel-analysis": Workflow("parallel-analysis", "analyze", (Stage("analyze"), Stage("synthesize")), (("analyze", "synthesize"),), ("synthesize",)),
}


def _of(values: dict[str, object], key: Column, default: object) -> Column:
    if not values:
        return F.lit(default)
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in values.items() for x in kv]), key), F.lit(default))


def outcome(workflow: Workflow, decisions: Column, carry: bool = True) -> Column:
    """The state after an array of decisions (approved, rejected, error): stage, retries, status (running, completed, failed),
    escalations, steps, and the path of stages run. Decisions after the end count for nothing; an unknown or null one approves.

    carry: the count of rejections goes on from stage to stage; else each stage starts with none."""
    stages = {s.id: s for s in workflow.stages}
    veto = {i: True for i, s in stages.items() if s.veto}
    most, at = {i: s.retries for i, s in stages.items()}, {i: s.escalate_at for i, s in stages.items() if s.escalate_at}
    following = workflow.following()

    def step(a: Column, d: Column) -> Column:
        made = lambda stage, retries, status, escalations: F.struct(
            stage.alias("stage"), retries.alias("retries"), status.alias("status"), escalations.alias("escalations"), (a["steps"] + 1).alias("steps"), F.concat(a["path"], F.array(a["stage"])).alias("path"))
        rejected = _of(veto, a["stage"], False) & F.coalesce(d == "rejected", F.lit(False))
        again = rejected & (a["retries"] < _of(most, a["stage"], RETRIES))
        limit = _of(at, a["stage"], 0)
        escalated = a["escalations"] + F.when(rejected & (limit > 0) & (a["retries"] >= limit), 1).otherwise(0)
        onward = _of(following, a["stage"], "")
        kept = a["retries"] if carry else F.lit(0)
        return (
            F.when(a["status"] != "running", a)
            .when(F.coalesce(d == "error", F.lit(False)), made(a["stage"], a["retries"], F.lit("failed"), a["escalations"]))
            .when(again, made(a["stage"], a["retries"] + 1, a["status"], a["escalations"]))
            .when(onward == "", made(a["stage"], a["retries"], F.lit("completed"), escalated))
            .otherwise(made(onward, kept, a["status"], escalated))
        )

    zero = F.struct(F.lit(workflow.entry).alias("stage"), F.lit(0).alias("retries"), F.lit("running").alias("status"), F.lit(0).alias("escalations"), F.lit(0).alias("steps"), F.array().cast("array<string>").alias("path"))
    return F.aggregate(decisions, zero, step)


def executions(events: DataFrame, workflow: Workflow, by: str = "execution", order: str = "seq", decision: str = "decision", carry: bool = True) -> DataFrame:
    """by, stage, retries, status, escalations, steps, path of each execution in events (by, order, decision). One shuffle by
    execution; an execution's decisions are one array."""
    each = events.groupBy(by).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.coalesce(F.col(decision), F.lit("")).alias("d")))).alias("_d"))
    return each.withColumn("_s", outcome(workflow, F.transform("_d", lambda x: x["d"]), carry)).select(by, "_s.*")
