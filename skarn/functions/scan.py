"""The scan of one source text: what opens a body, what is called, what a comment or an import stands for. `xref` runs it in
tasks, file by file; all between files is columns.

A text is split into tokens by a pattern; counts of open braces and parentheses, and the names that wait for the next brace at
their own depths, are all that is kept while they pass by."""

from __future__ import annotations

import re

#: Names, line ends, comments, strings (unrolled, so that long ones do not recurse), arrows, and any other sign.
TOKEN = re.compile(r"""[A-Za-z_$][A-Za-z0-9_$]*|\n|//[^\n]*|/\*(?s:.*?)(?:\*/|\Z)|"[^"\\\n]*(?:\\[^\n\r\x85\u2028\u2029][^"\\\n]*)*"|'[^'\\\n]*(?:\\[^\n\r\x85\u2028\u2029][^'\\\n]*)*'|`[^`\\]*(?:\\[\s\S][^`\\]*)*`|=>|[^\sA-Za-z_$]""", re.ASCII)
#: Comments, strings of three quotes and of one, names, a line end with the next line's indentation, and any other sign.
INDENTED_TOKEN = re.compile(r"""#[^\n]*|"{3}(?s:.*?)(?:"{3}|\Z)|'{3}(?s:.*?)(?:'{3}|\Z)|"[^"\\\n]*(?:\\(?s:.)[^"\\\n]*)*"|'[^'\\\n]*(?:\\(?s:.)[^'\\\n]*)*'|[A-Za-z_][A-Za-z0-9_]*|\\\n|\n[ \t]*|[^\sA-Za-z_]""", re.ASCII)
# Words that stand before a parenthesis or a name and are no names themselves.
KEYWORDS = frozenset("if for while switch catch function return new typeof await yield delete void in of do else case throw with super import export class extends const let var async static get set public private protected readonly override abstract declare default try finally instanceof this".split())
INDENTED_KEYWORDS = frozenset("if elif while for in is not and or return yield await lambda assert del raise except with as import from def class pass else print match case global nonlocal".split())
BINDERS = frozenset(("const", "let", "var"))
#: What stands before a name that is called or typed, not defined.
USED = frozenset((".", "new", "=", "(", ",", "function", "?", "&", "|", "return", "await", "throw"))
FIRST = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz_$")
QUOTES = frozenset("\"'`")
MODULE = "module"
LAST = 2**62  # behind all tokens


def tokens(content: str) -> tuple[list[str], list[int], list[int], list[tuple[int, str]]]:
    """Tokens that are no comments and no line ends, their numbers among all, their lines; comments with the count of tokens
    before them."""
    toks, at, lines, comments, line = [], [], [], [], 1
    for i, t in enumerate(TOKEN.findall(content)):
        if t == "\n":
            line += 1
            continue
        if t[0] == "/" and len(t) > 1:
            comments.append((len(toks), t))
        else:
            toks.append(t)
            at.append(i)
            lines.append(line)
        if len(t) > 1 and (t[0] == "`" or t[0] == "/"):
            line += t.count("\n")
    return toks, at, lines, comments


def scan(content: str, noise) -> tuple[list[tuple], list[tuple]]:
    """(bodies, calls): i, name, type, line, open, close, end_line of each interval, and i, name, line, receiver of each call, by
    i, the number of the token. A class's body is one that gives scope only. Most tokens only pass: what a name is shows at the
    sign behind it."""
    curly = round_ = 0
    braces, parens = [], []  # open ones: their tokens
    close, typed = {}, set()  # partners of braces; parentheses behind whose partner a body or a result type begins
    waiting, classes, found, calls = {}, {}, [], []
    line, at, closed, prev, prev2, prev3 = 1, -1, -1, "", "", ""
    at_line = 1
    for i, t in enumerate(TOKEN.findall(content)):
        if t == "\n":
            line += 1
            continue
        c = t[0]
        if c in FIRST:
            if (prev == "class" or prev == "new") and t not in KEYWORDS:
                if prev == "class":
                    waiting.setdefault((curly, round_), []).append((i, t, "class", line, -1))
                elif t not in noise and len(t) > 2:
                    calls.append((i, t, line, None))
        elif c == "(":
            if prev and prev[0] in FIRST and prev not in KEYWORDS:
                if prev2 == "function" or (prev2 == "*" and prev3 == "function"):
                    waiting.setdefault((curly, round_), []).append((at, prev, "function", at_line, i))
                elif prev2 and prev2 != "class" and at + 1 == i and classes.get(curly - 1) and prev2 not in USED:
                    waiting.setdefault((curly, round_), []).append((at, prev, "method", at_line, i))
                if prev2 != "function" and prev2 != "new" and prev not in noise and len(prev) > 2:
                    calls.append((at, prev, at_line, prev3 if prev2 == "." and prev3 and prev3[0] in FIRST else None))
            parens.append(i)
            round_ += 1
        elif c == ")":
            round_ -= 1
            closed = parens.pop() if parens else -1
        elif c == "{":
            if prev == ")":
                typed.add(closed)
            curly_class = False
            for b in waiting.pop((curly, round_), ()):
                if b[2] != "arrow" or prev == "=>":
                    found.append((*b, i))
                    curly_class |= b[2] == "class"
            classes[curly] = curly_class
            braces.append(i)
            curly += 1
        elif c == ";":
            waiting.pop((curly, round_), None)
        elif c == "}":
            waiting.pop((curly, round_), None)
            curly -= 1
            if braces:
                close[braces.pop()] = (i, line)
        elif (c == "=" and len(t) == 1) or c == ":":
            if c == ":" and prev == ")":
                typed.add(closed)
            if prev2 in BINDERS and prev[0] in FIRST and prev not in KEYWORDS:
                waiting.setdefault((curly, round_), []).append((at, prev, "arrow", at_line, -1))
        elif c == "/" and len(t) > 1:
            if t[1] == "*":
                line += t.count("\n")
            continue
        prev3 = prev2
        prev2 = prev
        prev = t
        at = i
        at_line = line
        if c == "`":
            line += t.count("\n")
    last, bodies = (at, at_line), []
    for i, name, kind, begin, paren, open_ in sorted(found):
        if kind != "method" or paren in typed:
            end, end_line = close.get(open_, last)
            bodies.append((i, name, kind, begin, open_, end, end_line))
    named = {b[0] for b in bodies}
    return bodies, [x for x in calls if x[0] not in named]


def indented_tokens(content: str) -> tuple[list[str], list[int], list[int]]:
    """Tokens, numbers and lines; of line ends only those that begin a logical line: outside brackets, with something else than
    a comment or another line end behind them. The text has a line end put before it, so that its first line begins too."""
    toks, at, lines, line, depth, end = [], [], [], 0, 0, None
    for i, t in enumerate(INDENTED_TOKEN.findall("\n" + content)):
        c = t[0]
        if c == "\n":
            line += 1
            end = (t, i, line) if depth <= 0 else None
            continue
        if c == "#":
            continue
        if c == "\\" and len(t) > 1:
            line += 1
            continue
        if end:
            toks.append(end[0])
            at.append(end[1])
            lines.append(end[2])
            end = None
        toks.append(t)
        at.append(i)
        lines.append(line)
        if c in "([{":
            depth += 1
        elif c in ")]}":
            depth -= 1
        elif len(t) > 1 and (c == '"' or c == "'"):
            line += t.count("\n")
    return toks, at, lines


def indented_scan(content: str, noise) -> tuple[list[tuple], list[tuple]]:
    """`scan` of text whose scopes are indentations: from the name to the last token before the next logical line that is
    indented no further."""
    toks, at, lines = indented_tokens(content)
    n, indent, open_, bodies, calls, last = len(toks), 0, [], [], [], None
    for k, t in enumerate(toks):
        if t[0] == "\n":
            indent = len(t) - 1
            while open_ and open_[-1][1] >= indent:
                b, _ = open_.pop()
                bodies.append((at[b], toks[b], "class" if toks[b - 1] == "class" else "function", lines[b], b, at[last], lines[last]))
            continue
        last = k
        if t[0] not in FIRST or t[0] == "$":
            continue
        prev = toks[k - 1] if k else None
        if prev == "def" or prev == "class":
            if k > 1 and (toks[k - 2][0] == "\n" or toks[k - 2] == "async"):
                open_.append((k, indent))
        elif k + 1 < n and toks[k + 1] == "(" and t not in INDENTED_KEYWORDS and t not in noise and len(t) > 2:
            calls.append((at[k], t, lines[k], toks[k - 2] if k > 1 and prev == "." and toks[k - 2][0] in FIRST else None))
    for b, _ in open_:
        bodies.append((at[b], toks[b], "class" if toks[b - 1] == "class" else "function", lines[b], b, at[last], lines[last]))
    return sorted(bodies), calls


def _walk(bodies: list[tuple], calls: list[tuple], sites: bool) -> tuple[list[str], dict[int, set], list[tuple]]:
    """One pass over both: the scope of each body; the names called in each, by its opening token, or with sites the calls with
    their callers. What holds a token is, at each level, the interval that was opened last there."""
    ends = sorted(b[5] for b in bodies)
    names, kinds, opens = [], [], []  # of the intervals around a token, outermost first
    inner, scopes, found = {b[4]: set() for b in bodies}, [], []
    caller, b, e, begin, end = MODULE, 0, 0, *((bodies[0][0], ends[0]) if bodies else (LAST, LAST))
    for call in [*calls, (LAST,)]:
        k = call[0]
        while begin < k:
            while end < begin:
                names.pop(), kinds.pop(), opens.pop()
                e += 1
                end = ends[e] if e < len(ends) else LAST
            names.append(bodies[b][1]), kinds.append(bodies[b][2]), opens.append(bodies[b][4])
            scopes.append(".".join(names))
            b, caller = b + 1, None
            begin = bodies[b][0] if b < len(bodies) else LAST
        if k == LAST:
            break
        while end < k:
            names.pop(), kinds.pop(), opens.pop()
            e, caller = e + 1, None
            end = ends[e] if e < len(ends) else LAST
        if not sites:
            for o in opens:
                inner[o].add(call[1])
            continue
        if caller is None:  # the innermost definition; a class body's own calls belong to what holds the class
            m = len(kinds)
            while m and kinds[m - 1] == "class":
                m -= 1
            caller = ".".join(names[:m]) or MODULE
        found.append((*call, caller))
    return scopes, inner, found


def placed(bodies: list[tuple], calls: list[tuple], by_class: bool, sites: bool) -> list[tuple]:
    """Sites: i, name, line, receiver, caller; or definitions: name, type, start_line, end_line, fqn, calls. by_class: a function
    directly in a class is a method."""
    scopes, inner, found = _walk(bodies, calls, sites)
    if sites:
        return found
    classes = {x[1] for x in bodies if x[2] == "class"} if by_class else ()
    for (_, name, kind, line, open_, _, end_line), fqn in zip(bodies, scopes, strict=True):
        if kind != "class":
            if classes and "." in fqn and fqn.split(".")[-2] in classes:
                kind = "method"
            found.append((name, kind, line, end_line, fqn, sorted(inner[open_])))
    return found


def linked(bodies: list[tuple], calls: list[tuple]) -> set[str]:
    """What defines and what calls a name, from one pass: the name, NUL, 0 and the caller of a call, or 1 and the fqn of a
    definition. As plain strings, which hash and sort fast."""
    scopes, _, found = _walk(bodies, calls, True)
    out = {f"{b[1]}\0001{fqn}" for b, fqn in zip(bodies, scopes, strict=True) if b[2] != "class"}
    out.update([f"{c[1]}\0000{c[4]}" for c in found])
    return out


def outline(bodies: list[tuple], calls: list[tuple], most: int) -> tuple:
    """How many definitions there are, the distinct names that are defined and called, and name, type, line of the first `most`
    functions by line and name. For text with braces, where a body's type does not depend on what is around it."""
    defs = [(b[3], b[1], b[2]) for b in bodies if b[2] != "class"]
    first = sorted(x for x in defs if x[2] == "function")[:most]
    return len(defs), sorted({x[1] for x in defs}), sorted({c[1] for c in calls}), [{"name": n, "type": t, "start_line": line} for line, n, t in first]


def outermost(bodies: list[tuple], calls: list[tuple]) -> list[tuple]:
    """line, name, caller of each distinct call on a line that a definition's lines hold: of these definitions the first, then
    the longest. Behind the last line of a definition no call asks for it, so one pass over both finds them."""
    defs = sorted((start, -end, fqn) for _, _, start, end, fqn, _ in placed(bodies, [], False, False))
    out, k, n = [], 0, len(defs)
    for line, name in sorted({(c[2], c[1]) for c in calls}):
        while k < n and -defs[k][1] < line:
            k += 1
        if k == n:
            break
        if defs[k][0] <= line:
            out.append((line, name, defs[k][2]))
    return out


def commented(content: str, noise) -> list[tuple]:
    """name, line, doc, defines of each name that a comment stands before, with none of ; { } ) between them; whether the name
    is a definition's. Of definitions of one name on one line the first counts."""
    toks, at, lines, comments = tokens(content)
    defined = {b[0] for b in scan(content, noise)[0] if b[2] != "class"} if comments else ()
    out, seen = [], set()
    for j, (k, doc) in enumerate(comments):
        end = comments[j + 1][0] if j + 1 < len(comments) else len(toks)
        for m in range(k, end):
            t = toks[m]
            if t[0] in FIRST:
                defines = at[m] in defined and (t, lines[m]) not in seen
                if defines:
                    seen.add((t, lines[m]))
                out.append((t, lines[m], doc, defines))
            elif t in (";", "{", "}", ")"):
                break
    return out


def imported(content: str) -> list[tuple]:
    """module, line of `import ... from "m"`, `export ... from "m"`, `import "m"`, `import("m")`, `require("m")`."""
    toks, _, lines, _ = tokens(content)
    out = []
    for k, t in enumerate(toks):
        if t[0] in QUOTES and len(t) > 1 and k and (toks[k - 1] in ("from", "import") or (k > 1 and toks[k - 1] == "(" and toks[k - 2] in ("require", "import"))):
            out.append((t[1:-1], lines[k]))
    return out


def indented_imported(content: str) -> list[tuple]:
    """words, line of each logical line that begins with import or from."""
    toks, _, lines = indented_tokens(content)
    out = []
    for k, t in enumerate(toks):
        if t[0] == "\n":
            head = toks[k + 1]
            if head in ("import", "from"):
                out.append(([], lines[k + 1]))
            else:
                head = None
        elif out and head:
            out[-1][0].append('"' if len(t) > 1 and t[0] in "\"'" else t)
    return out
