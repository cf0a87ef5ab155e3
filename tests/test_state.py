"""Role logs, workflows and audit files against plain Python."""

import random

import pytest

from skarn.operators import roles, workflow

LOG = "seq long, op string, role string, item string"


def replayed(log, at):
    state = {}
    for seq, op, role, item in sorted(log):
        if seq > at:
            break
        if op == "create":
            state[role] = {"permission": set(), "parent": set(), "user": set()}
        elif op == "delete":
            state.pop(role, None)
        elif op == "leave":
            for r in state.values():
                r["user"].discard(item)
        elif role in state and item is not None:
            for kind, (on, off) in roles.KINDS.items():
                if op == on and not (kind == "permission" and item == "bad one"):
                    state[role][kind].add(item)
                elif op == off:
                    state[role][kind].discard(item)
    out = {("role", r, None) for r in state}
    return out | {(k, r, x) for r, held in state.items() for k, items in held.items() for x in items}


def some_log(seed, n=120):
    rng = random.Random(seed)
    ops = ["create", "create", "delete", "grant", "grant", "revoke", "inherit", "disinherit", "assign", "assign", "unassign", "leave"]
    out = []
    for seq in range(1, n + 1):
        op = rng.choice(ops)
        item = {"create": None, "delete": None, "grant": rng.choice(["p1", "a:b", "bad one", None]), "revoke": rng.choice(["p1", "a:b"]), "leave": rng.choice("uv")}.get(op, rng.choice("abuv"))
        out.append((seq, op, None if op == "leave" else rng.choice("abc"), item))
    return out


@pytest.mark.parametrize("seed", range(2))
def test_role_log_against_a_replay(spark, seed):
    log = some_log(seed)
    df = spark.createDataFrame(log, LOG)
    for at in (0, 17, 60, None):
        got = {tuple(r) for r in roles.exported(df, at).collect()}
        assert got == replayed(log, 10**9 if at is None else at)


def test_intervals_are_points_in_time(spark):
    log = some_log(5)
    df = spark.createDataFrame(log, LOG)
    held = roles.intervals(df, "user").collect()
    for at in range(1, 121, 7):
        want = {(r, x) for k, r, x in replayed(log, at) if k == "user"}
        assert {(r.role, r.item) for r in held if r.since <= at and (r.until is None or r.until > at)} == want


def test_import_refuses_problems(spark):
    made = lambda rows: spark.createDataFrame(rows, "kind string, role string, item string")
    good = [("role", "a", None), ("role", "b", None), ("parent", "a", "b"), ("permission", "b", "x:y"), ("user", "a", "u")]
    log = roles.imported(made(good), 5)
    assert {tuple(r) for r in roles.exported(log).collect()} == set(good)
    assert sorted(r.seq for r in log.collect()) == [5, 6, 7, 8, 9]
    for bad, what in ((("parent", "b", "a"), "cycle"), (("parent", "a", "gone"), "dangling parent"), (("user", "gone", "u"), "dangling user"), (("permission", "a", "bad one"), "bad permission")):
        with pytest.raises(ValueError, match=what):
            roles.imported(made([*good, bad]))
    assert {r.item for r in roles.exported(roles.template(spark, "developer")).where("kind = 'permission'").collect()} == set(roles.TEMPLATES["developer"])


def test_allowed_then(spark):
    log = spark.createDataFrame([(1, "create", "r", None), (2, "assign", "r", "u"), (3, "grant", "r", "file:read"), (5, "revoke", "r", "file:read"), (6, "grant", "r", "file:*"), (8, "delete", "r", None)], LOG)
    asks = spark.createDataFrame([(i, "u", "file:read", i) for i in range(1, 10)] + [(20, "v", "file:read", 4)], "request_id long, user string, request string, seq long")
    assert {r.request_id for r in roles.allowed_then(log, asks).collect() if r.granted} == {3, 4, 6, 7}


def test_spans_meet_only_the_points_they_hold(spark):
    """Random spans and points of few keys, against all pairs; no join compares what does not hold."""
    r = random.Random(5)
    for low, high in ((-900, 900), (10**12, 10**12 + 70), (7, 7)):
        spans = [(i, r.choice("ab"), a := r.randint(low - 5, high + 5), r.choice([None, a, a + 1, a + r.randint(0, 1 << r.randint(1, 12))])) for i in range(150)]
        points = [(i, r.choice(["a", "b", None]), r.choice([None, *[r.randint(low, high)] * 9])) for i in range(150)]
        want = sorted((p[0], s[0]) for p in points for s in spans if p[1] == s[1] and p[2] is not None and s[2] <= p[2] and (s[3] is None or s[3] > p[2]))
        df = roles.held_at(spark.createDataFrame(points, "p long, key string, seq long"), spark.createDataFrame(spans, "s long, key string, since long, until long"), "key")
        assert sorted((x.p, x.s) for x in df.collect()) == want
        joins = [x for x in df._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join" in x]
        assert len(joins) == 1 and "<" not in joins[0]
    none = roles.held_at(spark.createDataFrame([], "p long, key string, seq long"), spark.createDataFrame([(1, "a", 1, None)], "s long, key string, since long, until long"), "key")
    assert none.count() == 0


def walked(flow, decisions, carry):
    stages, stage, retries, status, up, path = {s.id: s for s in flow.stages}, flow.entry, 0, "running", 0, []
    for d in decisions:
        if status != "running":
            break
        path.append(stage)
        s = stages[stage]
        if d == "error":
            status = "failed"
        elif s.veto and d == "rejected" and retries < s.retries:
            retries += 1
        else:
            up += bool(s.veto and d == "rejected" and s.escalate_at and retries >= s.escalate_at)
            nxt = next((b for a, b in flow.transitions if a == stage), None) if stage not in flow.terminal else None
            status, stage, retries = ("completed", stage, retries) if nxt is None else (status, nxt, retries if carry else 0)
    return stage, retries, status, up, len(path), path


@pytest.mark.parametrize("name", sorted(workflow.TEMPLATES))
def test_workflows_by_hand(spark, name):
    rng, flow = random.Random(name), workflow.TEMPLATES[name]
    runs = {f"e{i}": [rng.choice(["approved", "rejected", "rejected", None, "error" if i % 3 == 0 else "other"]) for _ in range(i)] for i in range(1, 25)}
    rows = [(e, n, d) for e, ds in runs.items() for n, d in enumerate(ds)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "execution string, seq int, decision string")
    for carry in (True, False):
        got = {r.execution: (r.stage, r.retries, r.status, r.escalations, r.steps, list(r.path)) for r in workflow.executions(df, flow, carry=carry).collect()}
        assert got == {e: walked(flow, ds, carry) for e, ds in runs.items()}


def test_unknown_stages_are_refused():
    with pytest.raises(ValueError):
        workflow.Workflow("w", "a", (workflow.Stage("a"),), (("a", "b"),))
