"""Scalar text functions as Column expressions; everything stays in generated JVM code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Node types of parsers and the categories that they stand for.
CHUNK_TYPES = {
    "function_declaration": "function", "function_definition": "function", "function_item": "function", "arrow_function": "function",
    "method_definition": "method", "method_declaration": "method",
    "class_declaration": "class", "class_definition": "class", "class_specifier": "class",
    "interface_declaration": "interface", "interface_type": "interface",
    "type_alias_declaration": "type", "type_declaration": "type",
    "struct_item": "struct", "struct_specifier": "struct",
    "enum_declaration": "enum", "enum_item": "enum", "enum_specifier": "enum",
    "impl_item": "impl", "trait_item": "trait", "mod_item": "module", "module": "module",
    "namespace_definition": "namespace", "namespace_declaration": "namespace",
    "export_statement": "export", "decorated_definition": "decorated",
}
DEFINITION_TYPES = {
    "function_declaration": "function", "function_definition": "function", "function_item": "function", "arrow_function": "function",
    "method_definition": "method", "method_declaration": "method", "constructor_declaration": "constructor", "singleton_method": "method",
}
# Names of built-in functions that no call graph should hold.
BUILTIN_NAMES = """console log error warn info debug print println printf sprintf require import export default toString valueOf
hasOwnProperty length push pop shift unshift slice splice map filter reduce forEach find findIndex some every includes indexOf join
split trim replace match test exec JSON parse stringify Object Array String Number Boolean Date Math Promise async await then catch
finally len str int float list dict set tuple range enumerate zip open read write close append extend keys values items get format
isinstance type super self __init__ __str__ __repr__ make new append copy delete panic recover fmt Println Printf Sprintf unwrap
expect clone into from as_ref as_mut iter collect ok err""".split()
# Names too general to tell anything.
GENERIC_NAMES = """constructor toString valueOf init setup teardown get set run start stop handle process data value result error
options config params args props state context callback handler listener observer subscriber""".split()
# Patterns of entry-point file names and of exported definitions.
ENTRY_POINTS = [
    r"\bindex\.(ts|js|tsx|jsx|py|go|rs|java|rb)$", r"\bmain\.(ts|js|tsx|jsx|py|go|rs|java|rb|c|cpp)$", r"\bapp\.(ts|js|tsx|jsx|py|go|rs|rb)$",
    r"\bserver\.(ts|js|tsx|jsx|py|go|rs|rb)$", r"\bmod\.rs$", r"\b__init__\.py$",
]
EXPORTS = [
    r"^\s*export\s+(default\s+)?(function|const|let|var|class|interface|type|enum)", r"^\s*export\s*\{", r"^\s*export\s+\*",
    r"__all__\s*=", r"^\s*pub\s+(fn|struct|enum|trait|type|mod|const|static)", r"^(func|type|var|const)\s+[A-Z]",
]
# What is masked in messages.
SECRET_TOKEN = r"[a-zA-Z0-9_-]{20,}"
EMAIL = r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}"
# ASCII word borders: Spark's \b takes accented letters for word characters.
_EDGE, _END = r"(?<![A-Za-z0-9_])", r"(?![A-Za-z0-9_])"
IPV4 = _EDGE + r"[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}" + _END


def code_tokens(text: Column) -> Column:
    """Words of code: camel case and underscores part words; lower case; at least two characters. Null has none."""
    spread = F.regexp_replace(F.regexp_replace(text, "([a-z])([A-Z])", "$1 $2"), "_", " ")
    return F.coalesce(F.filter(F.split(F.lower(spread), "[^a-z0-9]+"), lambda t: F.length(t) > 1), F.array().cast("array<string>"))


def normalize_symbol(name: Column) -> Column:
    out = F.regexp_replace(name, "([a-z])([A-Z])", "$1 $2")
    out = F.regexp_replace(out, "([A-Z]+)([A-Z][a-z])", "$1 $2")
    out = F.regexp_replace(out, "([a-zA-Z])([0-9])", "$1 $2")
    out = F.regexp_replace(out, "([0-9])([a-zA-Z])", "$1 $2")
    return F.trim(F.regexp_replace(F.lower(F.regexp_replace(out, "_", " ")), r"\s+", " "))


def similarity(a: Column, b: Column) -> Column:
    """1 - edit distance / longer length; two empty strings are equal."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, F.lit(1.0)).otherwise(1.0 - F.levenshtein(a, b) / longest.cast("double"))


def token_estimate(text: Column) -> Column:
    return F.ceil(F.length(text) / 4).cast("long")


def short_hash(text: Column) -> Column:
    """First 16 hex digits of sha256."""
    return F.substring(F.sha2(text.cast("binary"), 256), 1, 16)


def chunk_id(path: Column, start: Column, end: Column, content: Column) -> Column:
    return short_hash(F.concat_ws(":", path, start.cast("string"), end.cast("string"), content))


def recency(modified: Column, now: Column, half_life: float = 30.0) -> Column:
    """Exponential decay to a half after half_life days; unknown 0.5, not before now 1."""
    days = (now.cast("timestamp").cast("double") - modified.cast("timestamp").cast("double")) / 86400.0
    return F.when(modified.isNull(), F.lit(0.5)).when(days <= 0, F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.exp(-days * F.lit(0.6931471805599453 / half_life)))))


def is_entry_point(path: Column) -> Column:
    return path.rlike("(?i)" + "|".join(f"(?:{p})" for p in ENTRY_POINTS))


def is_exported(code: Column) -> Column:
    return F.coalesce((F.trim(code) != "") & code.rlike("(?m)" + "|".join(f"(?:{p})" for p in EXPORTS)), F.lit(False))


def mapped(value: Column, names: dict[str, str]) -> Column:
    """The value's name in a small fixed table, or the value itself."""
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in names.items() for x in kv]), value), value)


def chunk_type(node: Column) -> Column:
    return mapped(node, CHUNK_TYPES)


def definition_type(node: Column) -> Column:
    return mapped(node, DEFINITION_TYPES)


def comment_prefix(language: Column) -> Column:
    return F.when(language.isin("python", "ruby"), F.lit("#")).otherwise(F.lit("//"))


def docstring_preview(doc: Column, most: int = 200) -> Column:
    """Lines without comment marks joined by a space, cut to `most` characters."""

    def bare(line: Column) -> Column:
        for mark in (r"^/\*\*?", r"^\*/$", r"^\*", "^//", "^#", "^'''", '^"""'):
            line = F.regexp_replace(F.trim(line) if mark == r"^/\*\*?" else line, mark, "")
        return F.trim(line)

    one = F.trim(F.array_join(F.filter(F.transform(F.split(doc, "\n"), bare), lambda x: x != ""), " "))
    return F.when(F.length(one) <= most, one).otherwise(F.concat(F.rtrim(F.substring(one, 1, most - 3)), F.lit("...")))


def is_noise_name(name: Column) -> Column:
    return (F.length(name) <= 2) | name.isin(*dict.fromkeys(BUILTIN_NAMES))


def is_generic_name(name: Column) -> Column:
    return (F.length(name) <= 2) | name.isin(*GENERIC_NAMES)


def query_key(query: Column, type_: Column | None = None, language: Column | None = None) -> Column:
    """Cache key: lower case, trimmed; with filters, both are appended."""
    base = F.lower(F.trim(query))
    if type_ is None and language is None:
        return base
    empty = F.lit("")
    return F.concat_ws("|", base, F.coalesce(type_, empty) if type_ is not None else empty, F.coalesce(language, empty) if language is not None else empty)


def query_pattern(query: Column) -> Column:
    out = F.regexp_replace(F.trim(F.lower(query)), r"\s+", " ")
    out = F.regexp_replace(F.regexp_replace(out, '"[^"]*"', "<string>"), "'[^']*'", "<string>")
    out = F.regexp_replace(out, _EDGE + "[0-9]+" + _END, "<num>")
    out = F.regexp_replace(out, _EDGE + r"(function|method|class|interface|type)\s+[A-Za-z0-9_]+", "$1 <name>")
    return F.when(F.length(out) > 50, F.concat(F.substring(out, 1, 50), F.lit("..."))).otherwise(out)


def _units(n: Column) -> tuple[Column, Column]:
    power = F.when(n >= 1 << 30, 3).when(n >= 1 << 20, 2).when(n >= 1 << 10, 1).otherwise(0)
    return n / F.pow(F.lit(1024.0), power), F.element_at(F.array(*[F.lit(u) for u in ("B", "KB", "MB", "GB")]), power + 1)


def bytes_short(n: Column) -> Column:
    """At most two decimals, no trailing zeros."""
    value, unit = _units(n)
    digits = F.regexp_replace(F.format_string("%.2f", value), r"\.?0+$", "")
    return F.when(n == 0, F.lit("0 B")).otherwise(F.concat(digits, F.lit(" "), unit))


def bytes_fixed(n: Column) -> Column:
    """Always one decimal."""
    value, unit = _units(n)
    return F.when(n == 0, F.lit("0 B")).otherwise(F.concat(F.format_string("%.1f", value), F.lit(" "), unit))


def thousands(n: Column) -> Column:
    return F.when(n >= 1_000_000, F.format_string("%.1fM", n / 1e6)).when(n >= 1000, F.format_string("%.1fK", n / 1e3)).otherwise(n.cast("string"))


def round_half_up(x: Column, digits: int = 2) -> Column:
    """Rounds halves towards positive infinity."""
    scale = float(10**digits)
    return F.floor(x * scale + 0.5) / scale


def parse_memory(text: Column) -> Column:
    """Bytes of a size like 256m or 1.5 GB; null where it has another form."""
    pattern = r"(?i)^([0-9]+(?:\.[0-9]+)?)\s*([kmg])?b?$"
    unit = F.lower(F.regexp_extract(text, pattern, 2))
    times = F.when(unit == "k", 1 << 10).when(unit == "m", 1 << 20).when(unit == "g", 1 << 30).otherwise(1)
    return F.when(text.rlike(pattern), F.floor(F.regexp_extract(text, pattern, 1).try_cast("double") * times)).cast("long")


def parse_cpu(text: Column) -> Column:
    """Fraction of a percentage up to 100%; null where it has another form."""
    value = F.regexp_extract(text, r"^([0-9]+(?:\.[0-9]+)?)\s*%$", 1).try_cast("double")
    return F.when(value <= 100, value / 100)


def format_memory(n: Column) -> Column:
    part = lambda bits, unit: F.concat(F.floor(n / (1 << bits)).cast("string"), F.lit(unit))
    return F.when(n >= 1 << 30, part(30, "g")).when(n >= 1 << 20, part(20, "m")).when(n >= 1 << 10, part(10, "k")).otherwise(n.cast("string"))


def redact(text: Column) -> Column:
    """Long tokens, then mail addresses, then IPv4 addresses."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(text, SECRET_TOKEN, "[REDACTED]"), EMAIL, "[EMAIL]"), IPV4, "[IP]")


# Parts of names of fields that hold secrets.
SENSITIVE_FIELDS = ["apiKey", "api_key", "password", "secret", "token", "authorization", "auth", "credential", "private", "privateKey"]


def is_sensitive(key: Column) -> Column:
    return F.lower(key).rlike("|".join(s.lower() for s in SENSITIVE_FIELDS))


def redact_fields(fields: Column) -> Column:
    """A map with the values of sensitive keys masked."""
    return F.transform_values(fields, lambda k, v: F.when(is_sensitive(k), F.lit("[REDACTED]")).otherwise(v))


def integrity_hash(*fields: Column) -> Column:
    """Short hash of the fields as JSON in the order given."""
    return short_hash(F.to_json(F.struct(*fields)))


def path_error(path: Column, root: str | None = None) -> Column:
    """Null for a valid path, else why it is not."""
    clean = F.regexp_replace(path, r"\\", "/")
    out = F.when(F.contains(path, F.lit("\0")), "Path contains null bytes").when(F.contains(clean, F.lit("../")), "Path traversal detected")
    if root is not None:
        out = out.when(~path.startswith(root), "Path outside allowed root")
    return out.when(clean.rlike("(?i)^/(etc|proc|sys|dev)/|^[a-z]:/(windows|system32)"), "Access to system path denied")


def query_error(query: Column) -> Column:
    return F.when(F.coalesce(query, F.lit("")) == "", "Query must be a non-empty string").when(F.length(query) > 10000, "Query too long (max 10000 characters)").when(F.contains(query, F.lit("\0")), "Query contains null bytes")


def number_error(value: Column, least: float | None = None, most: float | None = None, name: str = "value") -> Column:
    out = F.when(value.isNull() | F.isnan(value), f"{name} must be a valid number")
    if least is not None:
        out = out.when(value < least, f"{name} must be at least {least:g}")
    if most is not None:
        out = out.when(value > most, f"{name} must be at most {most:g}")
    return out


def glob_regex(pattern: str) -> str:
    """A regex for a glob: ** crosses slashes, * and ? do not, {a,b} are choices."""
    out, i, depth = "", 0, 0
    while i < len(pattern):
        c = pattern[i]
        if pattern.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 2
        elif pattern.startswith("**", i):
            out, i = out + ".*", i + 1
        elif c == "*":
            out += "[^/]*"
        elif c == "?":
            out += "[^/]"
        elif c == "{":
            out, depth = out + "(?:", depth + 1
        elif c == "}" and depth:
            out, depth = out + ")", depth - 1
        elif c == "," and depth:
            out += "|"
        elif c.isalnum() or c in "_/-":
            out += c
        else:
            out += "\\" + c
        i += 1
    return f"^{out}$"


def in_scope(path: Column, include: list[str] | None = None, exclude: list[str] | None = None) -> Column:
    """Any of the included globs (all paths without any) and none of the excluded."""
    any_of = lambda globs: path.rlike("|".join(f"(?:{glob_regex(g)})" for g in globs))
    out = any_of(include) if include else F.lit(True)
    return out & ~any_of(exclude) if exclude else out


def permission_valid(permission: Column) -> Column:
    parts = F.split(permission, ":")
    return (permission == "*") | permission.rlike("^[a-zA-Z0-9_-]+$") | ((F.size(parts) >= 2) & (F.element_at(parts, 1) != "") & (F.try_element_at(parts, F.lit(2)) != ""))


def _path_matches(pattern: Column, path: Column) -> Column:
    halves = F.split(pattern, r"\*\*")
    after = F.coalesce(F.try_element_at(halves, F.lit(2)), F.lit(""))
    return (
        F.when(pattern == path, True)
        .when(pattern.endswith("*"), F.startswith(path, F.substring(pattern, F.lit(1), F.length(pattern) - 1)))
        .when(F.contains(pattern, F.lit("**")), F.startswith(path, F.element_at(halves, 1)) & ((after == "") | F.endswith(path, after)))
        .otherwise(False)
    )


def permission_matches(granted: Column, requested: Column) -> Column:
    """action:resource[:path] with wildcards; single words match themselves; * matches everything."""
    colon = F.lit(":")
    g, r = F.split(granted, ":"), F.split(requested, ":")
    part = lambda k: (F.try_element_at(g, F.lit(k)) == "*") | (F.try_element_at(g, F.lit(k)) == F.try_element_at(r, F.lit(k)))
    rest = lambda a: F.array_join(F.slice(a, 3, 1_000_000), ":")
    simple = ~F.contains(granted, colon) | ~F.contains(requested, colon)
    return (
        F.when(granted == "*", True)
        .when(simple, granted == requested)
        .when(~(part(1) & part(2)), False)
        .when(F.size(g) <= 2, True)
        .when(F.size(r) > 2, _path_matches(rest(g), rest(r)))
        .otherwise(False)
    )


def import_kind(path: Column) -> Column:
    return F.when(path.startswith("./") | path.startswith("../"), "relative").when(path.startswith("/"), "absolute").otherwise("package")


def import_difficulty(path: Column) -> Column:
    return F.when((path == "./") | path.rlike(r"^\./[^/]+$"), "easy").when(F.regexp_count(path, F.lit(r"\.\./")) > 2, "hard").otherwise("medium")


def latex_escape(text: Column) -> Column:
    return F.regexp_replace(text, r"([&%$#_{}])", r"\\$1")


def csv_field(text: Column) -> Column:
    return F.when(text.rlike('[,"\n]'), F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text)


def naive_tokens(content_tokens: Column, result_tokens: Column) -> Column:
    """Tokens of whole files, three times those of the results where unknown."""
    return F.coalesce(content_tokens, result_tokens * 3)


def sql_literal(value: str) -> str:
    """A string literal with quotes doubled, so no value can end it."""
    return "'" + value.replace("'", "''") + "'"


def equals_filter(**values: str | None) -> Column:
    """Conjunction of equalities for the values that are given."""
    out = F.lit(True)
    for name, value in values.items():
        if value is not None:
            out = out & (F.col(name) == value)
    return out


def grep_line(line: Column) -> Column:
    """file, line and content of file:line:content; null for other lines."""
    pattern = r"^(.+?):([0-9]+):(.*)$"
    part = lambda k: F.regexp_extract(line, pattern, k)
    return F.when(line.rlike(pattern), F.struct(part(1).alias("file"), part(2).try_cast("int").alias("line"), F.trim(part(3)).alias("content")))


def compiler_message(line: Column) -> Column:
    """Parts of file(line,column): error TS1234: text; null for other lines."""
    pattern = r"^(.+)\(([0-9]+),([0-9]+)\):\s*(error|warning)\s*(TS[0-9]+):\s*(.+)$"
    part = lambda k: F.regexp_extract(line, pattern, k)
    return F.when(line.rlike(pattern), F.struct(part(1).alias("file"), part(2).cast("int").alias("line"), part(3).cast("int").alias("col"), part(4).alias("severity"), part(5).alias("rule"), F.concat(part(5), F.lit(": "), part(6)).alias("message")))


LINT_SCHEMA = "array<struct<filePath:string,messages:array<struct<line:int,column:int,message:string,ruleId:string,severity:int>>>>"


def lint_messages(report: Column) -> Column:
    """Messages of a JSON lint report: severity 2 is an error, 1 a warning, others are left out."""
    files = F.from_json(report, LINT_SCHEMA)
    each = F.flatten(F.transform(files, lambda f: F.transform(f.messages, lambda m: F.struct(
        f.filePath.alias("file"), F.coalesce(F.nullif(m.line, F.lit(0)), F.lit(1)).alias("line"), F.coalesce(F.nullif(m.column, F.lit(0)), F.lit(1)).alias("col"),
        m.message.alias("message"), m.ruleId.alias("rule"), F.when(m.severity == 2, "error").when(m.severity == 1, "warning").alias("severity")))))
    return F.filter(each, lambda m: m.severity.isNotNull())


def grep_score(query: str, content: Column) -> Column:
    """1 for the query itself, 0.8 in another case, else half the share of its words."""
    low = F.lower(content)
    words = [w for w in query.lower().split()]
    share = sum((F.contains(low, F.lit(w)).cast("int") for w in words), F.lit(0)) / F.lit(float(max(1, len(words))))
    return F.when(F.contains(content, F.lit(query)), 1.0).when(F.contains(low, F.lit(query.lower())), 0.8).otherwise(share * 0.5)
