"""A small sandboxed template language for conversations: parsed to a syntax tree, folded, and compiled to Python closures.

    text {{ expression }} {% if e %}..{% elif e %}..{% else %}..{% endif %} {% for m in messages %}..{% endfor %}
    {% generation %}..{% endgeneration %}   marks what a model is trained to write

Expressions: strings, integers, true, false, none, names and dotted fields, == !=, ~ (join), and, or, not, parentheses, and filters (| name).
Names reach only what the caller passes in dictionaries; there are no calls, no attributes of Python objects and no loops but over
the messages, so a template can't reach anything else and always ends.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field


def escape(text: str) -> str:
    """Puts a backslash before each character that can begin or end a control string."""
    return re.sub(r"[\\<\[\]]", r"\\\g<0>", text)


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


FILTERS: dict[str, Callable[[str], str]] = {"escape": escape, "trim": str.strip, "upper": str.upper, "lower": str.lower}


class TemplateError(ValueError):
    pass


@dataclass
class Text:
    value: str


@dataclass
class Const:
    value: object


@dataclass
class Name:
    path: tuple[str, ...]


@dataclass
class Op:
    kind: str
    args: list


@dataclass
class Output:
    value: object


@dataclass
class If:
    cases: list  # (condition, body)


@dataclass
class For:
    var: str
    body: list


@dataclass
class Generation:
    body: list


TOKEN = re.compile(r"""\s*(?:(?P<str>'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*")|(?P<int>\d+)|(?P<name>[A-Za-z_]\w*(?:\.[A-Za-z_]\w*)*)|(?P<op>==|!=|[~|()]))""", re.S)
ESCAPES = {"n": "\n", "t": "\t", "r": "\r"}


class Parser:
    def __init__(self, source: str):
        self.parts = [p for p in re.split(r"(\{\{.*?\}\}|\{%.*?%\}|\{#.*?#\})", source, flags=re.S) if p and not p.startswith("{#")]
        self.i = 0

    def body(self, ends: tuple[str, ...]) -> tuple[list, str]:
        out = []
        while self.i < len(self.parts):
            part = self.parts[self.i]
            self.i += 1
            if part.startswith("{{"):
                out.append(Output(expression(part[2:-2])))
            elif part.startswith("{%"):
                word, _, rest = part[2:-2].strip().partition(" ")
                if word in ends:
                    return out, f"{word} {rest}".strip()
                out.append(self.statement(word, rest))
            else:
                out.append(Text(part))
        if ends:
            raise TemplateError(f"missing {' or '.join(ends)}")
        return out, ""

    def statement(self, word: str, rest: str):
        if word == "if":
            cases, condition = [], expression(rest)
            while True:
                body, end = self.body(("elif", "else", "endif"))
                cases.append((condition, body))
                if end.startswith("elif"):
                    condition = expression(end[5:])
                elif end == "else":
                    body, _ = self.body(("endif",))
                    cases.append((Const(True), body))
                    return If(cases)
                else:
                    return If(cases)
        if word == "for":
            m = re.fullmatch(r"([A-Za-z_]\w*)\s+in\s+messages", rest.strip())
            if not m:
                raise TemplateError("loops go over messages only")
            return For(m[1], self.body(("endfor",))[0])
        if word == "generation":
            return Generation(self.body(("endgeneration",))[0])
        raise TemplateError(f"unknown statement {word!r}")


def expression(source: str):
    tokens, at = [], 0
    source = source.strip()
    while at < len(source):
        m = TOKEN.match(source, at)
        if not m:
            raise TemplateError(f"unexpected {source[at:]!r}")
        tokens.append((m.lastgroup, m[m.lastgroup]))
        at = m.end()
    tokens.append(("end", ""))
    pos = 0

    def peek() -> tuple[str, str]:
        return tokens[pos]

    def take() -> tuple[str, str]:
        nonlocal pos
        pos += 1
        return tokens[pos - 1]

    def binary(level: int):
        levels = (("name", ("or",)), ("name", ("and",)), ("op", ("==", "!=")), ("op", ("~",)))
        if level == len(levels):
            return filtered()
        if level == 2 and peek() == ("name", "not"):
            take()
            return Op("not", [binary(level)])
        left = binary(level + 1)
        kind, words = levels[level]
        while peek()[0] == kind and peek()[1] in words:
            left = Op(take()[1], [left, binary(level + 1)])
        return left

    def filtered():
        value = atom()
        while peek() == ("op", "|"):
            take()
            kind, name = take()
            if kind != "name" or name not in FILTERS:
                raise TemplateError(f"unknown filter {name!r}")
            value = Op(f"|{name}", [value])
        return value

    def atom():
        kind, text = take()
        if kind == "str":
            return Const(re.sub(r"\\(.)", lambda m: ESCAPES.get(m[1], m[1]), text[1:-1], flags=re.S))
        if kind == "int":
            return Const(int(text))
        if kind == "name":
            known = {"true": True, "false": False, "none": None}
            if any(p.startswith("_") for p in text.split(".")):
                raise TemplateError(f"{text!r} is out of reach")
            return Const(known[text]) if text in known else Name(tuple(text.split(".")))
        if (kind, text) == ("op", "("):
            value = binary(0)
            if take() != ("op", ")"):
                raise TemplateError("missing )")
            return value
        raise TemplateError(f"unexpected {text!r}")

    value = binary(0)
    if peek()[0] != "end":
        raise TemplateError(f"unexpected {peek()[1]!r}")
    return value


def shown(value: object) -> str:
    return "" if value is None else str(value)


OPS: dict[str, Callable] = {"==": lambda a, b: a == b, "!=": lambda a, b: a != b, "~": lambda a, b: shown(a) + shown(b), "and": lambda a, b: a and b, "or": lambda a, b: a or b, "not": lambda a: not a}
OPS |= {f"|{name}": (lambda f: lambda a: f(shown(a)))(f) for name, f in FILTERS.items()}


def fold(node):
    """Constant operations done, constant conditions decided, neighbouring text joined."""
    if isinstance(node, Op):
        args = [fold(a) for a in node.args]
        if all(isinstance(a, Const) for a in args):
            return Const(OPS[node.kind](*[a.value for a in args]))
        if node.kind in ("and", "or") and isinstance(args[0], Const):
            return args[1] if bool(args[0].value) == (node.kind == "and") else args[0]
        return Op(node.kind, args)
    return node


def fold_body(body: list) -> list:
    out: list = []
    for node in body:
        if isinstance(node, Output):
            value = fold(node.value)
            node = [Text(shown(value.value)) if isinstance(value, Const) else Output(value)]
        elif isinstance(node, If):
            cases = []
            for condition, inner in node.cases:
                condition = fold(condition)
                if isinstance(condition, Const) and not condition.value:
                    continue
                cases.append((condition, fold_body(inner)))
                if isinstance(condition, Const):
                    break
            node = (cases[0][1] if isinstance(cases[0][0], Const) else [If(cases)]) if cases else []
        elif isinstance(node, For):
            node = [For(node.var, fold_body(node.body))]
        elif isinstance(node, Generation):
            node = [Generation(fold_body(node.body))]
        else:
            node = [node]
        for x in node:
            if isinstance(x, Text) and out and isinstance(out[-1], Text):
                out[-1] = Text(out[-1].value + x.value)
            elif not isinstance(x, Text) or x.value:
                out.append(x)
    return out


@dataclass
class Out:
    """What a template has written: text, and the spans of it between generation markers."""

    parts: list[str] = field(default_factory=list)
    length: int = 0
    spans: list[tuple[int, int]] = field(default_factory=list)

    def write(self, text: str) -> None:
        self.parts.append(text)
        self.length += len(text)


def compiled_value(node) -> Callable[[dict], object]:
    if isinstance(node, Const):
        return lambda env, value=node.value: value
    if isinstance(node, Name):
        path = node.path

        def look(env: dict):
            value: object = env
            for key in path:
                value = value.get(key) if isinstance(value, dict) else None
            return value

        return look
    f, args = OPS[node.kind], [compiled_value(a) for a in node.args]
    if node.kind == "and":
        return lambda env: args[0](env) and args[1](env)
    if node.kind == "or":
        return lambda env: args[0](env) or args[1](env)
    if len(args) == 1:
        return lambda env, a=args[0]: f(a(env))
    return lambda env, a=args[0], b=args[1]: f(a(env), b(env))


def compiled_body(body: list) -> Callable[[dict, Out], None]:
    steps = [compiled_node(node) for node in body]

    def run(env: dict, out: Out) -> None:
        for step in steps:
            step(env, out)

    return run


def compiled_node(node) -> Callable[[dict, Out], None]:
    if isinstance(node, Text):
        return lambda env, out, text=node.value: out.write(text)
    if isinstance(node, Output):
        value = compiled_value(node.value)
        return lambda env, out: out.write(shown(value(env)))
    if isinstance(node, If):
        cases = [(compiled_value(c), compiled_body(b)) for c, b in node.cases]

        def choose(env: dict, out: Out) -> None:
            for condition, run in cases:
                if condition(env):
                    return run(env, out)

        return choose
    if isinstance(node, Generation):
        run = compiled_body(node.body)

        def marked(env: dict, out: Out) -> None:
            start = out.length
            run(env, out)
            out.spans.append((start, out.length))

        return marked
    raise TemplateError("a loop can't stand inside another statement")


class Template:
    """A compiled template: what stands before the loop, its body for one message at a time, and what stands after it."""

    def __init__(self, source: str):
        body = fold_body(Parser(source).body(())[0])
        loops = [i for i, node in enumerate(body) if isinstance(node, For)]
        if len(loops) != 1:
            raise TemplateError("a template has one loop over messages")
        at = loops[0]
        self.var = body[at].var
        self.before, self.each, self.after = compiled_body(body[:at]), compiled_body(body[at].body), compiled_body(body[at + 1 :])

    def message(self, message: dict, first: bool, last: bool, out: Out | None = None) -> Out:
        """One message's share of the output: with what comes before the loop if first, and after it if last."""
        out = out or Out()
        env = {self.var: message, "first": first, "last": last}
        if first:
            self.before({}, out)
        self.each(env, out)
        if last:
            self.after({}, out)
        return out

    def render(self, messages: list[dict]) -> tuple[str, list[tuple[int, int]]]:
        out = Out()
        for i, message in enumerate(messages):
            self.message(message, i == 0, i == len(messages) - 1, out)
        return "".join(out.parts), out.spans
