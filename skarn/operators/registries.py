"""What an application adds: validators of files, access policies and languages, each a Column or DataFrame builder by name."""

from __future__ import annotations

from collections.abc import Callable
from typing import Generic, TypeVar

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import xref

Built = TypeVar("Built")


class Registry(Generic[Built]):
    """Builders by name; a later one of the name replaces the earlier."""

    def __init__(self, what: str):
        self.what, self.known = what, {}

    def register(self, name: str) -> Callable[[Built], Built]:
        def put(builder: Built) -> Built:
            self.known[name] = builder
            return builder

        return put

    def drop(self, name: str) -> None:
        self.known.pop(name, None)

    def of(self, name: str) -> Built:
        if name not in self.known:
            raise LookupError(f"no {self.what} {name}; known: {', '.join(sorted(self.known)) or 'none'}")
        return self.known[name]


#: Of a file's text: an array of (severity, message), severity error or warning. Columns in, a Column out, so all run in one pass.
VALIDATORS: Registry[Callable[[Column], Column]] = Registry("validator")
#: Of a context (any columns of the rows that are judged): whether the policy passes.
POLICIES: Registry[Callable[[], Column]] = Registry("policy")
#: Of files (relative_path, content): definitions and call sites as `xref.references` gives them.
LANGUAGES: Registry[Callable[[DataFrame], tuple[DataFrame, DataFrame]]] = Registry("language")

for _name in ("typescript", "javascript"):
    LANGUAGES.register(_name)(xref.references)
LANGUAGES.register("python")(xref.indented_references)

FOUND = "array<struct<severity:string,message:string>>"


def message(severity: str, text: str | Column, when: Column) -> Column:
    """What a validator gives where a condition holds."""
    one = F.array(F.struct(F.lit(severity).alias("severity"), (F.lit(text) if isinstance(text, str) else text).alias("message")))
    return F.when(when, one).otherwise(F.array().cast(FOUND))


def validated(files: DataFrame, names: list[str] | None = None, text_col: str = "content") -> DataFrame:
    """files with errors, warnings, passed and findings (validator, severity, message) of the validators named, or all. A null
    text is empty. Columns of those names go."""
    names = sorted(VALIDATORS.known) if names is None else names
    text = F.coalesce(F.col(text_col), F.lit(""))
    own = lambda n: F.transform(VALIDATORS.of(n)(text), lambda x: F.struct(F.lit(n).alias("validator"), x["severity"].alias("severity"), x["message"].alias("message")))
    none = F.array().cast("array<struct<validator:string,severity:string,message:string>>")
    found = F.concat(none, *[own(n) for n in names])
    kept = [c for c in files.columns if c not in ("findings", "errors", "warnings", "passed")]
    out = files.select(*kept, found.alias("findings"))
    n = lambda s: F.size(F.filter("findings", lambda x: x["severity"] == s))
    return out.withColumns({"errors": n("error"), "warnings": n("warning")}).withColumn("passed", F.col("errors") == 0)


def policies_pass(role_policies: DataFrame, contexts: DataFrame) -> DataFrame:
    """contexts with role, policy, passes for each policy (role, policy) of the row's role; a policy whose condition is null
    does not pass. Contexts have a column role; unknown policies are an error before anything runs."""
    names = [r.policy for r in role_policies.select("policy").distinct().collect()]  # bounded by the registry, else refused
    passes = F.lit(False)
    for name in names:
        passes = F.when(F.col("policy") == name, F.coalesce(POLICIES.of(name)(), F.lit(False))).otherwise(passes)
    return contexts.join(role_policies, "role").withColumn("passes", passes)


def references(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Definitions and call sites of files (relative_path, language, content), each by the strategy of its language; files of
    languages without one have none. Languages that share a strategy are read together."""
    by: dict[int, tuple[Callable, list[str]]] = {}
    for name, strategy in sorted(LANGUAGES.known.items()):
        by.setdefault(id(strategy), (strategy, []))[1].append(name)
    pairs = [strategy(files.where(F.col("language").isin(names))) for strategy, names in by.values()]
    defs, sites = pairs[0]
    for d, s in pairs[1:]:
        defs, sites = defs.unionByName(d.select(defs.columns)), sites.unionByName(s.select(sites.columns))
    return defs, sites
