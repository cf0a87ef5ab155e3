"""Roles, permissions, audit trail and compliance as joins over tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.shared import small
from .graph import closure

# Controls of the SOC 2 catalogue: id, name, category, evidence types, least evidence.
CONTROLS = [
    ("CC1.1", "COSO Principle 1", "Control Environment", ["user_action"], 1),
    ("CC6.1", "Logical and Physical Access Controls", "Security", ["security_event", "user_action"], 1),
    ("CC6.2", "System Access Restrictions", "Security", ["security_event"], 1),
    ("CC6.3", "Credential Management", "Security", ["security_event", "user_action"], 1),
    ("CC6.6", "Transmission Security", "Security", ["security_event"], 1),
    ("CC7.1", "Detection and Monitoring", "Operations", ["tool_invocation", "security_event"], 1),
    ("CC7.2", "Incident Response", "Operations", ["security_event", "error"], 1),
    ("CC8.1", "Change Management", "Change Management", ["file_change", "tool_invocation"], 1),
]


def controls(spark) -> DataFrame:
    return spark.createDataFrame(CONTROLS, "control string, name string, category string, evidence array<string>, least int")


def role_closure(inherits: DataFrame, roles: DataFrame) -> DataFrame:
    """(role, from_role): each role and all that it inherits from."""
    reach = closure(inherits.select(F.col("role").alias("src"), F.col("parent").alias("dst")), roles.select(F.col("role").alias("node")))
    return reach.select(F.col("start").alias("role"), F.col("node").alias("from_role"))


def effective_permissions(user_roles: DataFrame, inherits: DataFrame, role_permissions: DataFrame) -> DataFrame:
    """(user, permission), distinct, over all roles and what they inherit."""
    reach = role_closure(inherits, user_roles.select("role").distinct())
    return user_roles.join(reach, "role").join(role_permissions.withColumnRenamed("role", "from_role"), "from_role").select("user", "permission").distinct()


def decisions(user_roles: DataFrame, inherits: DataFrame, role_permissions: DataFrame, role_policies: DataFrame, requests: DataFrame) -> DataFrame:
    """(user, request, matched, granted, explained) of requests (user, request). role_policies: role, policy, passes.

    granted: some role matches with all policies of that role passing. explained: some role matches and no policy of any
    matching role fails. Policies are inherited like permissions. The wildcard match runs on the distinct pairs of
    permission and request, which are few."""
    reach = role_closure(inherits, user_roles.select("role").distinct())
    own = reach.join(role_permissions.withColumnRenamed("role", "from_role"), "from_role").select("role", "permission").distinct()
    pols = reach.join(role_policies.withColumnRenamed("role", "from_role"), "from_role").groupBy("role").agg(F.bool_and("passes").alias("passes"))
    pairs = own.select("permission").distinct().crossJoin(small(requests.select("request").distinct())).where(T.permission_matches(F.col("permission"), F.col("request")))
    role_ok = own.join(pairs, "permission").select("role", "request").distinct().join(pols, "role", "left").withColumn("passes", F.coalesce("passes", F.lit(True)))
    hit = requests.join(user_roles, "user").join(role_ok, ["role", "request"]).groupBy("user", "request").agg(F.bool_or("passes").alias("granted"), F.bool_and("passes").alias("explained"))
    out = requests.join(hit, ["user", "request"], "left")
    return out.select("user", "request", F.col("granted").isNotNull().alias("matched"), F.coalesce("granted", F.lit(False)).alias("granted"), F.coalesce("explained", F.lit(False)).alias("explained"))


def evidence(catalogue: DataFrame, audit: DataFrame) -> DataFrame:
    """(control, event): events of each control's evidence types; one scan of the trail. Events of a type that a control
    lists are counted per type before the join when only counts are needed."""
    return catalogue.select("control", F.explode("evidence").alias("type")).join(audit, "type")


def assess(catalogue: DataFrame, audit: DataFrame, overrides: DataFrame | None = None) -> DataFrame:
    """(control, name, category, status, n, last_at): an override, or not-tested without evidence types, or by count."""
    per_type = audit.groupBy("type").agg(F.count(F.lit(1)).alias("n"), F.max("ts").alias("last_at"))
    each = catalogue.select("control", F.explode("evidence").alias("type")).join(small(per_type), "type").groupBy("control").agg(F.sum("n").alias("n"), F.max("last_at").alias("last_at"))
    out = catalogue.join(each, "control", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    status = F.when(F.size("evidence") == 0, "not-tested").when(F.col("n") >= F.col("least"), "compliant").otherwise("non-compliant")
    if overrides is not None:
        out = out.join(overrides.select("control", F.col("status").alias("_o")), "control", "left")
        status = F.coalesce("_o", status)
    return out.select("control", "name", "category", status.alias("status"), "n", "least", "last_at")


def compliance_score(assessed: DataFrame) -> DataFrame:
    n = lambda s: F.count_if(F.col("status") == s)
    tested = F.count(F.lit(1)) - n("not-tested")
    score = F.when(tested > 0, n("compliant") / tested * 100).otherwise(0.0)
    return assessed.agg(F.count(F.lit(1)).alias("total"), n("compliant").alias("compliant"), n("non-compliant").alias("non_compliant"), n("not-tested").alias("not_tested"), (F.floor(score * 100 + 0.5) / 100).alias("score"))


def gaps(assessed: DataFrame) -> DataFrame:
    reason = F.format_string("Insufficient evidence: found %d, required %d", "n", "least")
    return assessed.where("status = 'non-compliant'").select("control", reason.alias("reason"))


def enriched(events: DataFrame) -> DataFrame:
    """Audit events with a session, masked fields and an integrity hash."""
    session = F.concat(F.lit("s-"), F.col("user_id").cast("string"), F.lit("-"), F.date_format("ts", "yyyyMMdd"))
    out = events.select("event_id", "type", "user_id", session.alias("session"), F.regexp_replace("props", r'"(token|secret|password)":"[^"]*"', '"$1":"[REDACTED]"').alias("props"))
    return out.withColumn("hash", T.integrity_hash(*[F.col(c) for c in ("event_id", "type", "user_id", "session")]))
