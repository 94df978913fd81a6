"""What one Java source file declares and calls: a lexer and a stack of braces.

A small helper for ``operators.javasource``, which runs it over files in Arrow
batches; names are looked up across files there, by joins. One pass over the tokens
(comments out, literals kept) gives classes with their extent and enclosing class,
methods with their bodies, fields of a class's own body, and the calls that set up jobs,
with the class and the method they stand in.

Expressions are string literals, ``+``, ``new Path(..)``, local variables (the last
assignment before the use counts) and names of constants. A value is a list of terms, each a
text or a name; None is a value that the text does not tell. A field that is not final and is
assigned in a method has none.
"""

from __future__ import annotations

import re

from shuffleworks.constants import JOB_CALLS

TOKEN = re.compile(
    r'"""(?:[^\\]|\\.)*?(?:"""|\Z)|"(?:[^"\\\n]|\\.)*"|\'(?:[^\'\\\n]|\\.)*\'|//[^\n]*|/\*.*?(?:\*/|\Z)|[\w$]+|[^\s\w]', re.S
)
NAME = re.compile(r"[^\W\d][\w$]*\Z")
ESCAPE = re.compile(r"\\(u+[0-9a-fA-F]{4}|.)", re.S)
ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "b": "\b", "f": "\f", "s": " ", "0": "\0"}
TYPES = ("class", "interface", "enum", "record")
MODIFIERS = {"public", "protected", "private", "static", "final", "transient", "volatile", "abstract", "synchronized", "native", "default", "strictfp", "sealed"}
OPEN, CLOSE = {"(", "[", "{"}, {")", "]", "}"}


def literal(token: str) -> str:
    """The text of a string or character literal."""
    quotes = 3 if token.startswith('"""') else 1
    body = token[quotes:-quotes]
    return ESCAPE.sub(lambda m: chr(int(m[1].lstrip("u"), 16)) if m[1][0] == "u" and len(m[1]) > 1 else ESCAPES.get(m[1], m[1]), body)


def split(tokens: list[str], mark: str) -> list[list[str]]:
    """Cut at a mark that is outside all brackets."""
    parts, depth = [[]], 0
    for t in tokens:
        depth += (t in OPEN) - (t in CLOSE)
        if t == mark and depth == 0:
            parts.append([])
        else:
            parts[-1].append(t)
    return parts


def closing(tokens: list[str], start: int) -> int:
    """Where the bracket at ``start`` is closed, or the end."""
    depth = 0
    for i in range(start, len(tokens)):
        depth += (tokens[i] in OPEN) - (tokens[i] in CLOSE)
        if depth == 0:
            return i
    return len(tokens)


def terms(tokens: list[str], value_of) -> list[tuple[str | None, str | None]] | None:
    """An expression as (text, name of a constant elsewhere) pairs; ``value_of`` knows the names of this file."""
    while tokens[:1] == ["("] and closing(tokens, 0) == len(tokens) - 1:
        tokens = tokens[1:-1]
    parts = split(tokens, "+")
    if len(parts) > 1:
        found = [terms(p, value_of) if p else None for p in parts]
        return None if None in found else [t for p in found for t in p]
    if len(tokens) == 1 and tokens[0][0] in "\"'":
        return [(literal(tokens[0]), None)]
    if len(tokens) == 1 and tokens[0].isdigit():
        return [(tokens[0], None)]
    if tokens[:1] == ["new"] and "(" in tokens:
        at = tokens.index("(")
        if tokens[at - 1] != "Path" or closing(tokens, at) != len(tokens) - 1:
            return None
        found = [terms(p, value_of) for p in split(tokens[at + 1 : -1], ",")]
        return None if None in found or len(found) > 2 else found[0] if len(found) == 1 else [*found[0], ("/", None), *found[1]]
    if tokens and len(tokens) % 2 and tokens[-1] != "class" and all(NAME.match(t) for t in tokens[::2]) and set(tokens[1::2]) <= {"."}:
        return value_of("".join(tokens))
    return None


def class_name(tokens: list[str]) -> str | None:
    """The X of ``X.class``."""
    return "".join(tokens[:-2]) if tokens[-2:] == [".", "class"] and all(NAME.match(t) for t in tokens[:-2:2]) else None



class File:
    """One scan. Scopes are (kind, number): a type, a method of a type, or any other pair of braces."""

    def __init__(self, content: str):
        self.package, self.imports = None, []
        self.types: list[dict] = []
        self.methods: list[dict] = []
        self.fields: list[dict] = []
        self.calls: list[dict] = []
        self.assigned: set[tuple[int, str]] = set()  # (type, field) given a value after its declaration
        self.scan(content)
        for field in self.fields:
            given = (field["type"], field["name"]) in self.assigned and not field["is_final"]
            value = field.pop("value")
            field["terms"] = None if given or value is None else terms(value, lambda n: [(None, n.removeprefix("this."))])

    # --- braces -------------------------------------------------------------------------

    def scan(self, content: str) -> None:
        stack: list[tuple] = []  # kind, number, the statement that goes on after the brace, its open brackets and start
        head: list[str] = []
        depth, start = 0, 0
        for match in TOKEN.finditer(content):
            token = match[0]
            if token.startswith(("//", "/*")) and len(token) > 1:
                continue
            if not head:
                start = match.start()
            if token == "{":
                kind, number = self.opened(head, depth, stack, start, match.end())
                keeps = kind == "value"
                stack.append((kind, number, [*head, "{", "}"] if keeps else [], depth if keeps else 0, start))
                head, depth = [], 0
            elif token == "}":
                if stack:
                    kind, number, head, depth, start = stack.pop()
                    if kind in ("type", "method"):
                        (self.types if kind == "type" else self.methods)[number]["end"] = match.end()
                else:
                    head, depth = [], 0
            elif token == ";" and depth == 0:
                self.statement(head, stack)
                head = []
            else:
                depth += (token in "([") - (token in ")]")
                head.append(token)
        for kind, number, *_ in stack:  # braces that are never closed end with the file
            if kind in ("type", "method"):
                (self.types if kind == "type" else self.methods)[number]["end"] = len(content)

    def opened(self, head: list[str], depth: int, stack: list[tuple], start: int, body: int) -> tuple[str, int | None]:
        """What a brace opens, from the statement before it."""
        outer = next((n for k, n, *_ in reversed(stack) if k == "type"), None)
        bare = self.without_annotations(head)
        flat = self.flat(bare)
        at = next((i for i, t in enumerate(flat) if t in TYPES and flat[i - 1 : i] != ["."] and i + 1 < len(flat) and NAME.match(flat[i + 1])), None)
        if depth == 0 and at is not None and "=" not in flat and set(flat[:at]) <= MODIFIERS | {"non", "-", "@"}:
            name = flat[at + 1]
            qualified = f"{self.types[outer]['qualified']}.{name}" if outer is not None else name
            parts = self.heritage(bare[bare.index(name, bare.index(flat[at])) + 1 :])
            self.types.append(
                {"class_name": name, "qualified": qualified, "outer": self.types[outer]["qualified"] if outer is not None else None, "above": outer, "kind": flat[at], "start": start, "body": body, "end": body} | parts
            )
            return "type", len(self.types) - 1
        value = depth > 0 or "=" in flat or "new" in flat or flat[-1:] in (["]"], [">"]) or flat[:1] == ["return"]
        inside = stack[-1][0] if stack else None
        if inside == "type" and "(" in bare and not value:
            at = bare.index("(")
            inner = bare[at + 1 : closing(bare, at)]
            given = {p[-1] for p in split(inner, ",") if p and NAME.match(p[-1])}
            self.methods.append({"type": outer, "name": bare[at - 1] if at else "", "start": start, "body": body, "end": body, "locals": dict.fromkeys(given), "given": {}})
            return "method", len(self.methods) - 1
        if value:
            return "value", None
        self.statement(head, stack)
        return "block", None

    @staticmethod
    def flat(tokens: list[str]) -> list[str]:
        """Tokens outside round and square brackets, the brackets themselves kept."""
        out, depth = [], 0
        for t in tokens:
            depth -= t in (")", "]")
            if depth <= 0:
                out.append(t)
            depth += t in ("(", "[")
        return out

    @staticmethod
    def without_annotations(tokens: list[str]) -> list[str]:
        out, i = [], 0
        while i < len(tokens):
            if tokens[i] == "@" and tokens[i + 1 : i + 2] not in ([], ["interface"]):
                i += 2
                while tokens[i : i + 1] == ["."]:
                    i += 2
                if tokens[i : i + 1] == ["("]:
                    i = closing(tokens, i) + 1
            else:
                out.append(tokens[i])
                i += 1
        return out

    @staticmethod
    def heritage(tokens: list[str]) -> dict:
        """What follows ``extends`` and ``implements``, outside the type's own parameters."""
        parts: dict[str, list[str]] = {"extends": [], "implements": [], "permits": []}
        depth, into = 0, None
        for t in tokens:
            depth += (t == "<") - (t == ">")
            if depth == 0 and t in parts:
                into = t
            elif into:
                parts[into].append(t)
        text = lambda ts: re.sub(r" ?([.<>,\[\]]) ?", r"\1", " ".join(ts)).replace(",", ", ")
        lists, depth = [[]], 0
        for t in parts["implements"]:
            depth += (t == "<") - (t == ">")
            if t == "," and depth == 0:
                lists.append([])
            else:
                lists[-1].append(t)
        return {"extends": text(parts["extends"]) or None, "implements": [text(i) for i in lists if i]}

    # --- statements ---------------------------------------------------------------------

    def statement(self, head: list[str], stack: list[tuple]) -> None:
        head = self.without_annotations(head)
        if not head:
            return
        if not stack:
            if head[0] == "package":
                self.package = "".join(head[1:])
            elif head[0] == "import":
                self.imports.append(" ".join(head[1:2]) + " " + "".join(head[2:]) if head[1:2] == ["static"] else "".join(head[1:]))
            return
        kind, number = stack[-1][:2]
        if kind == "type":
            self.field(head, number)
            return
        method = next((n for k, n, *_ in reversed(stack) if k == "method"), None)
        if method is not None:
            self.assign(head, method)
            self.call(head, method)

    def field(self, head: list[str], owner: int) -> None:
        parts = self.commas([t for t in head if t not in MODIFIERS])
        kind: list[str] = []
        for part in parts:
            eq = part.index("=") if "=" in part else len(part)
            left = [t for t in part[:eq] if t not in "[]"] if kind else part[:eq]
            if "(" in left or not left or not NAME.match(left[-1]) or not (kind or left[:-1]):
                return  # a method without a body, or the constants of an enum
            kind = kind or left[:-1]
            flags = {f"is_{m}": m in head for m in ("static", "final")}
            self.fields.append({"type": owner, "name": left[-1], "java_type": "".join(kind), "value": part[eq + 1 :] or None} | flags)

    @staticmethod
    def commas(tokens: list[str]) -> list[list[str]]:
        parts, depth = [[]], 0
        for t in tokens:
            depth += (t in "<([{") - (t in ">)]}")
            if t == "," and depth == 0:
                parts.append([])
            else:
                parts[-1].append(t)
        return parts

    def assign(self, head: list[str], method: int) -> None:
        known = self.methods[method]["locals"]
        flat = self.flat(head)
        if "=" not in flat:
            if len(head) >= 2 and all(NAME.match(t) for t in head[-2:]) and head[0] not in ("return", "throw", "import"):
                known[head[-1]] = None  # declared, without a value yet
            return
        at = head.index("=", 1) if "=" in head[1:] else 0
        if not at or head[at + 1 : at + 2] == ["="] or head[at - 1] in ("!", "<", ">", "="):
            return
        plain = NAME.match(head[at - 1]) is not None
        name = head[at - 1] if plain else next((t for t in reversed(head[:at]) if NAME.match(t)), "")
        declares = plain and at >= 2 and (NAME.match(head[at - 2]) is not None or head[at - 2] in (">", "]"))
        value = terms(head[at + 1 :], lambda n: self.seen(n, method)) if plain else None
        if declares or name in known and head[at - 2 : at - 1] != ["."]:
            known[name] = value
        elif name:
            owner = self.methods[method]["type"]
            self.assigned.add((owner, name))
            self.methods[method]["given"][name] = value  # inside this method

    def seen(self, name: str, method: int):
        """A name as it stands in a method: what is known of a local variable, else a field or a constant of another file."""
        simple = name.removeprefix("this.")
        for known in (self.methods[method]["locals"], self.methods[method]["given"]):
            if simple in known:
                return known[simple]
        if simple.split(".")[0] in self.methods[method]["locals"]:
            return None
        return [(None, simple)]

    def call(self, head: list[str], method: int) -> None:
        known = self.methods[method]["locals"]
        for i in range(len(head) - 1):
            if head[i + 1] != "(" or head[i] not in JOB_CALLS or not i:
                continue
            args = split(head[i + 2 : closing(head, i + 1)], ",")
            made = head[i - 1] == "new"  # new Job(conf, name): the variable that is assigned
            if made or head[i] == "getInstance":
                if not made and head[i - 2 : i - 1] != ["Job"] or len(args) < 2 or "=" not in head[:i]:
                    continue
                var, rest = head[head.index("=") - 1], args[-1:]
            elif head[i - 1] != ".":
                continue
            elif head[i - 2][0].isupper():  # FileInputFormat.addInputPath(job, path)
                var, rest = "".join(args[0]).removeprefix("this."), args[1:]
            else:
                var, rest = head[i - 2], args
            if NAME.match(var) and rest:
                values = [(class_name(a), terms(a, lambda n: self.seen(n, method))) for a in rest]
                self.calls.append({"method": method, "var": var, "is_local": var in known, "call": head[i], "args": values})
