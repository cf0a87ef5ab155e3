"""Cross references, imports and large chunks against hand-written code and plain Python."""

import random
from hashlib import md5

import pytest

from skarn.api import Engine
from skarn.operators import chunk, xref

CODE = r'''
import { a } from "./a"; import './side';
const fs = require("fs"), lazy = import("later");
// function no() { ghost(); }
/* class Nope { x() { ghost() } } */
function outer(x) {
  const inner = (y) => { deep(y); };
  if (x) { inner(x); while (other()) { new Thing(); } }
  function nested() { return `text ${ghost2() }`; }
}
class Box extends Base {
  static async open(a, b = call0()): Promise<void> { this.shut(); a.b.chained(); }
  shut() { for (;;) { helper({ k: () => { sub(); } }); } }
  field = built();
  get size() { return 1 }
}
export default function main() { outer("}"); "function s() {"; }
declare function later(): void;
top();
const short = x => { last(); }
function open_ended( ) { cut(
'''


def found(spark, rows):
    defs, sites = xref.references(spark.createDataFrame(rows, "relative_path string, content string"))
    return defs.collect(), sites.collect()


def test_code_by_hand(spark):
    defs, sites = found(spark, [("f.ts", CODE), ("empty.ts", ""), ("null.ts", None), ("odd.ts", "}}} ) ( {{{ name(")])
    got = {r.fqn: (r.type, r.start_line, r.end_line, list(r.calls)) for r in defs if r.relative_path == "f.ts"}
    assert got == {
        "outer": ("function", 6, 10, ["Thing", "deep", "inner", "other"]), "outer.inner": ("arrow", 7, 7, ["deep"]), "outer.nested": ("function", 9, 9, []),
        "Box.open": ("method", 12, 12, ["call0", "chained", "shut"]), "Box.shut": ("method", 13, 13, ["helper", "sub"]), "Box.size": ("method", 15, 15, []),
        "main": ("function", 17, 17, ["outer"]), "short": ("arrow", 20, 20, ["last"]), "open_ended": ("function", 21, 21, ["cut"]),
    }
    calls = {(r.name, r.line, r.caller, r.receiver) for r in sites if r.relative_path == "f.ts"}
    assert {("deep", 7, "outer.inner", None), ("inner", 8, "outer", None), ("top", 19, "module", None), ("built", 14, "module", None), ("shut", 12, "Box.open", "this"), ("chained", 12, "Box.open", "b"), ("call0", 12, "Box.open", None), ("sub", 13, "Box.shut", None)} <= calls
    assert not {n for n, *_ in calls} & {"ghost", "ghost2", "no", "s", "later", "if", "while", "for"}
    assert {(r.name, r.caller) for r in sites if r.relative_path == "odd.ts"} == {("name", "module")}


def test_imports(spark):
    got = xref.imports(spark.createDataFrame([("f.ts", CODE)], "relative_path string, content string")).collect()
    assert {(r.module, r.line) for r in got} == {("./a", 2), ("./side", 2), ("fs", 3), ("later", 3)}


def test_long_and_deep_files(spark):
    deep = "".join(f"function f{i}() {{ " for i in range(60)) + "leaf(); " + "} " * 60
    long = "\n".join(f"function g{i}() {{ call{i % 7}('" + "x" * 200 + "'); }" for i in range(2000))
    defs, sites = found(spark, [("deep.ts", deep), ("long.ts", long)])
    assert [r.caller for r in sites if r.relative_path == "deep.ts"] == [".".join(f"f{i}" for i in range(60))]
    assert sum(r.relative_path == "long.ts" for r in defs) == 2000 and {r.name: r.caller for r in sites if r.line == 1999} == {"call3": "g1998"}


def test_engine_references(spark):
    files = spark.createDataFrame([("f.ts", "typescript", CODE, "h", 1)], "relative_path string, language string, content string, hash string, size long")
    engine = Engine(files)
    defs, sites = engine.references()
    assert [r.caller for r in engine.xrefs(defs, sites, "outer").collect()] == ["main"]


def split_by_hand(lines, most, ratio, head, more):
    out, start, part = [], 0, 0
    while start < len(lines):
        room = max(0, most - 2 - len(head) - len(str(part + 1)) - (len(more) if part else 0))
        end = start + 1
        while end < len(lines) and len("\n".join(lines[start : end + 1])) <= room:
            end += 1
        out.append((part, start, end))
        if end >= len(lines):
            break
        n = end - start
        start, part = end - (min(max(1, int(n * ratio)), n - 1) if n > 1 else 0), part + 1
    return out


@pytest.mark.parametrize("ratio", [0.0, 0.25, 0.9, 5.0, float("nan")])
def test_split_chunks_by_hand(spark, ratio):
    rng = random.Random(7)
    texts = ["\n".join("w" * rng.choice([0, 0, 3, 20, 60, 300]) for _ in range(rng.randint(1, 60))) + "\nend" for _ in range(30)]
    rows = [(f"p{i}", "python", t, 10, f"p{i}", "method", "m", "# one\n# two") for i, t in enumerate(texts)] + [("blank", "en", " \n\t", 1, "s", "t", "n", None), ("null", "en", None, 1, "s", "t", "n", None)]
    df = spark.createDataFrame(rows, "relative_path string, language string, content string, start_line int, scope string, type string, name string, docstring string")
    got = {}
    for r in chunk.split_chunks(df, 64, ratio, 2).collect():
        got.setdefault(r.relative_path, []).append((r.part, r.start_line, r.end_line, r.name, r.content))
    assert set(got) == {f"p{i}" for i in range(30)}
    for i, t in enumerate(texts):
        lines = t.split("\n")
        head = f"# Scope: p{i}\n# Symbol: method m\n# Doc: one two\n# Part: "
        more = "\n# Grounding (start of symbol):\n" + "\n".join(f"# {x}" if x else "#" for x in lines[:2])
        kept = 0.0 if ratio != ratio else min(0.9, ratio)
        want = [(k, 10 + s, 9 + e, f"m_part{k}", head + str(k + 1) + (more if k else "") + "\n\n" + "\n".join(lines[s:e])) for k, s, e in split_by_hand(lines, 256, kept, head, more)]
        assert sorted(got[f"p{i}"]) == want


def test_split_chunks_of_few_columns(spark):
    df = spark.createDataFrame([("p", "go", "a\nb")], "relative_path string, language string, content string")
    assert [tuple(r) for r in chunk.split_chunks(df).collect()] == [("p", 0, 1, 2, None, "// Part: 1\n\na\nb")]


PY = '''import os, sys.path as p
from ..a.b import (c,
    d)
# def ghost(): call()
x = top(1)

class Box(Base):
    """def no(): ghost()"""
    size = make_it()

    @deco(1)
    async def open(self, a=first(),
b=2):
        def inner():
            deep()
            return "call()"

        # comment at any place
    # less
        self.shut(inner())
    def shut(self): helper(); return 1
def outer(
  x):
    if x:
        return \\
  cont(x)
    for y in (1,
2):
        last()
def one(): pass
end_()
'''


def test_indented_code_against_a_parser(spark):
    import ast

    def walk(node, scope=()):
        for n in ast.iter_child_nodes(node):
            if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                name = (*scope, n.name)
                if not isinstance(n, ast.ClassDef):
                    n.decorator_list = []  # what decorates a function stands outside of it
                    called = {c.func.id if isinstance(c.func, ast.Name) else c.func.attr for c in ast.walk(n) if isinstance(c, ast.Call)}
                    yield ".".join(name), ("method" if isinstance(node, ast.ClassDef) else "function"), n.lineno, n.end_lineno, sorted(called)
                yield from walk(n, name)
            else:
                yield from walk(n, scope)

    files = spark.createDataFrame([("f.py", PY), ("empty.py", ""), ("null.py", None), ("odd.py", "  def )x(\n class"), ("last.py", "def f():\n\tg(1")], "relative_path string, content string")
    defs, sites = xref.indented_references(files)
    got = {(r.fqn, r.type, r.start_line, r.end_line, tuple(r.calls)) for r in defs.collect() if r.relative_path == "f.py"}
    assert got == {(*x[:4], tuple(x[4])) for x in walk(ast.parse(PY))}
    assert {(r.name, r.line, r.caller) for r in sites.collect() if r.relative_path in ("f.py", "last.py")} >= {("top", 5, "module"), ("deco", 11, "module"), ("first", 12, "Box.open"), ("deep", 15, "Box.open.inner"), ("end_", 31, "module")}
    assert {(r.fqn, r.end_line) for r in defs.collect() if r.relative_path == "last.py"} == {("f", 2)}
    got = {(r.module, r.line) for r in xref.indented_imports(files).collect() if r.relative_path == "f.py"}
    assert got == {("os", 1), ("sys.path", 1), ("..a.b", 2)}
    own = xref.indented_references(files.where("content is null"))
    assert own[0].count() == 0 and own[1].count() == 0


def test_docstrings_and_parse_cache(spark):
    code = "/** one\n * more */\nexport async function a() {}\n// two\nconst x = 1;\nfunction b() {}\nclass K {\n  // three\n  m() {}\n  n() {}\n}\n"
    files = spark.createDataFrame([("f.ts", code), ("copy.ts", code), ("n.ts", None)], "relative_path string, content string")
    defs, _ = xref.parsed_once(files)
    assert {(r.relative_path, r.name) for r in defs.collect()} == {(p, n) for p in ("f.ts", "copy.ts") for n in "abmn"}
    docs = xref.docstrings(files, defs)
    assert {(r.name, r.line, r.doc) for r in docs.where("relative_path = 'f.ts'").collect()} == {("a", 3, "/** one\n * more */"), ("m", 9, "// three")}


def test_resolution_falls_back(spark):
    defs = spark.createDataFrame([("f", "run", "A.run"), ("g", "run", "B.run"), ("g", "Run", "Run")], "relative_path string, name string, fqn string")
    got = xref.resolved(spark.createDataFrame([("A.run",), ("run",), ("RUN",), ("x.run",), ("none",), (None,)], "query string"), defs).collect()
    found = {}
    for r in got:
        found.setdefault((r.query, r.level), set()).add(r.fqn)
    assert found == {("A.run", "qualified"): {"A.run"}, ("run", "name"): {"A.run", "B.run"}, ("x.run", "name"): {"A.run", "B.run"}, ("RUN", "any case"): {"A.run", "B.run", "Run"}}


def test_source_view_is_read_without_a_row_for_each_token(spark):
    """Neither definitions nor sites write or shuffle anything between the files and what is found in them."""
    from skarn.sources import tables

    def plan(df):
        return df._jdf.queryExecution().executedPlan().toString()

    files = tables.sources(spark, "/root/testdata/sf0.001")
    for read, indented in ((xref.references, False), (xref.indented_references, True)):
        for df in read(tables.sources(spark, "/root/testdata/sf0.001", indented)):
            assert "Exchange" not in plan(df) and "Window" not in plan(df) and "regexp_extract_all" in plan(df)
    assert "Exchange" not in plan(xref.docstrings(files)) and "Exchange" not in plan(xref.indented_imports(files))


def test_docstrings_of_a_files_own_definitions(spark):
    code = "// one\nfunction a() {}\n// two\nb(); const c = () => {}\n// three\nexport default function d() {}\nfunction e() {}\n"
    files = spark.createDataFrame([("f.ts", code), ("n.ts", None)], "relative_path string, content string")
    assert {(r.name, r.line, r.doc) for r in xref.docstrings(files).collect()} == {("a", 2, "// one"), ("d", 6, "// three")}


def test_conditions_on_source_text_do_not_reach_below_it(spark):
    """Pushed below the view, a condition on the content would match a document's words anew for each name in it."""
    from skarn.sources import tables

    files = tables.sources(spark, "/root/testdata/sf0.001")
    text = files.where("content <> '' and content is not null")._jdf.queryExecution().optimizedPlan().toString()
    assert text.count("regexp_extract_all") == 1


def test_resolution_makes_definitions_once(spark):
    made = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            made.add(b.num_rows)
            yield b

    rows = spark.createDataFrame([(f"f{i}.ts", n, n) for i, n in enumerate(("run", "Run", "go"))], "relative_path string, name string, fqn string")
    names = spark.createDataFrame([("run",), ("RUN",), ("x.go",)], "query string")
    got = xref.resolved(names, rows.mapInArrow(counted, rows.schema)).collect()
    assert {(r.query, r.level, r.fqn) for r in got} == {("run", "qualified", "run"), ("RUN", "any case", "run"), ("RUN", "any case", "Run"), ("x.go", "name", "go")}
    assert made.value == 3


def test_outermost_definitions_are_found_where_a_file_is_read(spark):
    """as the join of calls with definitions, also where some share lines, but without a shuffle and in one reading."""
    from skarn.operators import graph
    from skarn.plans import QUERIES

    shared = "function a() { one(); } function b() { two(); }\nfunction c() {\n  const d = () => { six();\n  }; six(); six(); } function e() {\n}\nfunction f() { ten(); } const g = () => {\n  ten(); }\nfree();\nclass K {\n  h() { low(); } x = low(); y = high(); }\nfunction open() { cut(\n  cut("
    rng, bits = random.Random(11), ["function f{}() {{", "const g{} = () => {{", "class K{} {{ m{}() {{", "call{}();", "}}", "}} }}", "\n", "\n"]
    rows = [("f.ts", CODE), ("shared.ts", shared), ("empty.ts", ""), ("null.ts", None), ("calls.ts", "one(); two();"), ("defs.ts", "function a() {}")]
    rows += [(f"r{i}.ts", " ".join(rng.choice(bits).replace("{}", str(rng.randrange(10, 14))).replace("{{", "{").replace("}}", "}") for _ in range(80))) for i in range(40)]
    texts = [("f.py", PY), ("last.py", "def f():\n  def g(): one(); two()\n  one()\none()"), ("null.py", None)]
    for read, own, data in ((xref.references, xref.scan.scan, rows), (xref.indented_references, xref.scan.indented_scan, texts)):
        files = spark.createDataFrame(data, "relative_path string, content string")
        defs, sites = read(files)
        defs = defs.selectExpr("relative_path AS file", "fqn AS name", "start_line AS start", "end_line AS end")
        want = graph.enclosing(sites.selectExpr("relative_path AS file", "line", "name AS callee"), defs).collect()
        got = xref.enclosed(files, own).collect()
        assert want and sorted(map(tuple, got)) == sorted(map(tuple, want))
    plan = QUERIES["jn05b_outermost_definition"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and plan.count("regexp_extract_all") == 1


def test_callers_in_code_are_found_in_one_reading(spark):
    """as the join of names with all their callers, but no file is read twice and no row holds a name's callers."""
    from skarn.operators import graph
    from skarn.plans import QUERIES

    rng = random.Random(2)
    rows = [("f.ts", CODE), ("empty.ts", ""), ("null.ts", None)]
    rows += [(f"r{i}.ts", "".join(f"function f{rng.randrange(9)}0() {{ f{rng.randrange(12)}0(); const g{i % 3}0 = () => {{ f{i % 9}0(); }}; }} f{i % 4}0();\n" for _ in range(6))) for i in range(30)]
    files = spark.createDataFrame(rows, "relative_path string, content string")
    defs, sites = xref.references(files)
    want = sorted((r.fqn, len(r.called_by), md5(",".join(r.called_by).encode()).hexdigest()) for r in graph.called_by(defs, sites.selectExpr("name", "caller")).collect())
    links = xref.links(files)
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")  # names go on from batch to batch
        got = graph.called_by_digests(links.union(links)).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    assert len(want) > 10 and sorted(map(tuple, got)) == want
    plan = QUERIES["gr09b_called_by_in_code"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("regexp_extract_all") == 1 and "Join" not in plan
