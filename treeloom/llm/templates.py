"""A small sandboxed template language for chat formats, compiled to Python closures.

Text stands for itself; `{{ expression }}` writes a value; `{# ... #}` is a comment; statements are `{% for x in list %}`,
`{% if %} / elif / else`, `{% set name = expression %}` and `{% generation %}`, whose text is what a model shall learn; blocks
end with `{% end... %}`. A `-` inside a tag's brace strips white space on that side. Expressions have literals, names, members
(`m.role`, `m['role']`), `~` (joins as text), `+ - * // %` (numbers), comparisons, `in`, `and / or / not`, `a if c else b`, and
filters (`x | trim`). Members are looked up in mappings and lists only, never on Python objects; nothing can be called;
names are the given ones; a name set inside a loop ends with the round. So templates can neither reach Python nor carry
anything from one round of a loop to the next, and a conversation's turns can be rendered apart from each other.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Mapping
from typing import Any, NamedTuple


class TemplateError(ValueError):
    """A template that is not of the language, or does what it may not do."""


class Node(NamedTuple):
    """A node of the syntax tree: its kind and its parts (values, names, nodes, lists of nodes)."""

    kind: str
    parts: tuple = ()


# ---- source to syntax tree -------------------------------------------------------------------------------------------

_TAG = re.compile(r"\{\{-?|\{%-?|\{#-?")
_CLOSE = {"{{": re.compile(r"-?\}\}"), "{%": re.compile(r"-?%\}"), "{#": re.compile(r"-?#\}")}
_TOKEN = re.compile(r"""\s*(?:(?P<number>\d+)|(?P<name>[A-Za-z_]\w*)|(?P<text>'(?:\\.|[^'\\])*'|"(?:\\.|[^"\\])*")|(?P<mark>==|!=|<=|>=|//|[-+*%~<>|.,\[\]()=]))""", re.S)
_STRING = re.compile(r"'(?:\\.|[^'\\])*'|\"(?:\\.|[^\"\\])*\"", re.S)
_WORDS = {"and", "or", "not", "in", "if", "else", "true", "false", "none"}
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r"}
MOST_NESTED = 60


def pieces(source: str) -> list[tuple[str, str]]:
    """(kind, content): kind is text, {{ or {%. White space is stripped where tags say so."""
    out, at, strip = [], 0, False
    while True:
        tag = _TAG.search(source, at)
        text = source[at : tag.start() if tag else len(source)]
        text = text.lstrip() if strip else text
        text = text.rstrip() if tag and tag[0].endswith("-") else text
        if text:
            out.append(("text", text))
        if not tag:
            return out
        kind, at = tag[0][:2], tag.end()
        close = _end_of(source, at, kind)
        if kind != "{#":
            out.append((kind, source[at : close.start()]))
        at, strip = close.end(), close[0].startswith("-")


def _end_of(source: str, at: int, kind: str) -> re.Match:
    """Where a tag ends; quoted texts are skipped."""
    start = at
    while at < len(source):
        if close := _CLOSE[kind].match(source, at):
            return close
        quoted = kind != "{#" and _STRING.match(source, at)
        at = quoted.end() if quoted else at + 1
    raise TemplateError(f"a tag is not closed: {source[start - 2 : start + 30]!r}")


class _Expression:
    """Recursive descent over one expression's tokens."""

    def __init__(self, source: str):
        self.tokens, self.at, self.nested, end = [], 0, 0, 0
        source = source.rstrip()
        while end < len(source):
            found = _TOKEN.match(source, end)
            if not found:
                raise TemplateError(f"not an expression: {source!r}")
            end = found.end()
            kind = found.lastgroup
            word = found[kind]
            self.tokens.append(("word" if kind == "name" and word in _WORDS else kind, word))

    def next_is(self, *words: str) -> bool:
        return self.at < len(self.tokens) and self.tokens[self.at][0] in ("word", "mark") and self.tokens[self.at][1] in words

    def take(self, *words: str) -> str | None:
        if not self.next_is(*words):
            return None
        self.at += 1
        return self.tokens[self.at - 1][1]

    def need(self, kind: str, word: str | None = None) -> str:
        if self.at >= len(self.tokens) or self.tokens[self.at][0] != kind or word not in (None, self.tokens[self.at][1]):
            raise TemplateError(f"expected {word or kind} in {' '.join(t[1] for t in self.tokens)!r}")
        self.at += 1
        return self.tokens[self.at - 1][1]

    def whole(self) -> Node:
        node = self.choice()
        if self.at < len(self.tokens):
            raise TemplateError(f"{self.tokens[self.at][1]!r} is one too many")
        return node

    def choice(self) -> Node:
        self.nested += 1
        if self.nested > MOST_NESTED:
            raise TemplateError("an expression is nested too deeply")
        node = self.either()
        if self.take("if"):
            test = self.either()
            node = Node("choice", (test, node, self.choice() if self.take("else") else Node("value", (None,))))
        self.nested -= 1
        return node

    def either(self) -> Node:
        node = self.both()
        while self.take("or"):
            node = Node("or", (node, self.both()))
        return node

    def both(self) -> Node:
        node = self.negated()
        while self.take("and"):
            node = Node("and", (node, self.negated()))
        return node

    def negated(self) -> Node:
        nots = 0
        while self.take("not"):
            nots += 1
        node = self.compared()
        return node if not nots else Node("not", (node,)) if nots % 2 else Node("not", (Node("not", (node,)),))

    def compared(self) -> Node:
        node = self.joined()
        while True:
            if word := self.take("==", "!=", "<", "<=", ">", ">=", "in"):
                node = Node("binary", (word, node, self.joined()))
            elif self.next_is("not") and self.tokens[self.at + 1 : self.at + 2] == [("word", "in")]:
                self.at += 2
                node = Node("not", (Node("binary", ("in", node, self.joined())),))
            else:
                return node

    def joined(self) -> Node:
        return self._left(self.summed, "~")

    def summed(self) -> Node:
        return self._left(self.multiplied, "+", "-")

    def multiplied(self) -> Node:
        return self._left(self.filtered, "*", "//", "%")

    def _left(self, part: Callable[[], Node], *marks: str) -> Node:
        node = part()
        while mark := self.take(*marks):
            node = Node("binary", (mark, node, part()))
        return node

    def filtered(self) -> Node:
        node = self.member()
        while self.take("|"):
            name = self.need("name")
            if name not in FILTERS:
                raise TemplateError(f"there is no filter {name}")
            node = Node("filter", (name, node))
        return node

    def member(self) -> Node:
        node = self.atom()
        while True:
            if self.take("."):
                node = Node("member", (node, Node("value", (self.need("name"),))))
            elif self.take("["):
                node = Node("member", (node, self.choice()))
                self.need("mark", "]")
            else:
                return node

    def atom(self) -> Node:
        if self.at >= len(self.tokens):
            raise TemplateError("an expression is cut off")
        kind, word = self.tokens[self.at]
        self.at += 1
        if kind == "number":
            return Node("value", (int(word),))
        if kind == "text":
            return Node("value", (re.sub(r"\\(.)", lambda m: _ESCAPES.get(m[1], m[1]), word[1:-1], flags=re.S),))
        if kind == "name":
            return Node("name", (word,))
        if word in ("true", "false", "none"):
            return Node("value", ({"true": True, "false": False, "none": None}[word],))
        if word == "(":
            node = self.choice()
            self.need("mark", ")")
            return node
        if word == "-":
            return Node("binary", ("-", Node("value", (0,)), self.member()))
        raise TemplateError(f"unexpected {word!r}")


def parsed(source: str) -> Node:
    """The syntax tree of a template: a block of text, write, if, for, set and generation nodes."""
    stack: list[tuple[str, list, list]] = [("", [], [])]  # (what ends the block, its nodes, what is open)
    for kind, content in pieces(source):
        nodes = stack[-1][1]
        if kind == "text":
            nodes.append(Node("text", (content,)))
            continue
        if kind == "{{":
            nodes.append(Node("write", (_Expression(content).whole(),)))
            continue
        word, _, rest = content.strip().partition(" ")
        if len(stack) > MOST_NESTED:
            raise TemplateError("blocks are nested too deeply")
        if word == "set":
            expression = _Expression(rest)
            name = expression.need("name")
            expression.need("mark", "=")
            nodes.append(Node("set", (name, expression.whole())))
        elif word == "for":
            expression = _Expression(rest)
            name = expression.need("name")
            expression.need("word", "in")
            stack.append(("endfor", [], [name, expression.whole()]))
        elif word == "generation":
            stack.append(("endgeneration", [], []))
        elif word == "if":
            stack.append(("endif", [], [(_Expression(rest).whole(), None)]))
        elif word in ("elif", "else") and stack[-1][0] == "endif":
            end, nodes, arms = stack.pop()
            if arms[-1][0] is None:
                raise TemplateError("nothing follows an else")
            arms[-1] = (arms[-1][0], Node("block", tuple(nodes)))
            arms.append((_Expression(rest).whole() if word == "elif" else None, None))
            stack.append((end, [], arms))
        elif word == stack[-1][0]:
            end, nodes, opened = stack.pop()
            body = Node("block", tuple(nodes))
            if end == "endfor":
                node = Node("for", (*opened, body))
            elif end == "endgeneration":
                node = Node("generation", (body,))
            else:
                opened[-1] = (opened[-1][0], body)
                node = Node("if", tuple(opened))
            stack[-1][1].append(node)
        else:
            raise TemplateError(f"unexpected {word!r}")
    if len(stack) > 1:
        raise TemplateError(f"{stack[-1][0]} is missing")
    return Node("block", tuple(stack[0][1]))


# ---- values ----------------------------------------------------------------------------------------------------------


def shown(value: Any) -> str:
    return "" if value is None else "true" if value is True else "false" if value is False else str(value)


def _member(holder: Any, key: Any) -> Any:
    if isinstance(holder, Mapping):
        return holder.get(key)
    if isinstance(holder, (list, tuple)) and isinstance(key, int) and -len(holder) <= key < len(holder):
        return holder[key]
    if isinstance(holder, (list, tuple)) or holder is None:
        return None
    raise TemplateError(f"{type(holder).__name__} has no members")


def _number(value: Any) -> int:
    if isinstance(value, bool) or not isinstance(value, int):
        raise TemplateError(f"{shown(value)!r} is no number")
    return value


def _contains(value: Any, holder: Any) -> bool:
    if isinstance(holder, str):
        return shown(value) in holder
    if isinstance(holder, (list, tuple, Mapping)):
        return value in holder
    raise TemplateError("in needs a text, a list or a mapping")


BINARY: dict[str, Callable[[Any, Any], Any]] = {
    "~": lambda a, b: shown(a) + shown(b), "+": lambda a, b: a + b if isinstance(a, str) and isinstance(b, str) else _number(a) + _number(b),
    "-": lambda a, b: _number(a) - _number(b), "*": lambda a, b: _number(a) * _number(b), "//": lambda a, b: _number(a) // _number(b), "%": lambda a, b: _number(a) % _number(b),
    "==": lambda a, b: a == b, "!=": lambda a, b: a != b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b, "in": _contains,
}
#: Filters of the language; a template is given further ones by name.
FILTERS: dict[str, Callable[[Any], Any]] = {
    "trim": lambda x: shown(x).strip(), "upper": lambda x: shown(x).upper(), "lower": lambda x: shown(x).lower(), "length": lambda x: len(x) if isinstance(x, (str, list, tuple, Mapping)) else 0, "guarded": shown,
}


# ---- syntax tree to closures -----------------------------------------------------------------------------------------


def folded(node: Any, kept: frozenset[str] = frozenset({"guarded"})) -> Any:
    """The same tree with constant parts computed: expressions over literals, branches that are certain, texts side by side.
    What fails stays, to fail when it runs. kept: filters that are not known yet."""
    if isinstance(node, tuple) and not isinstance(node, Node):
        return tuple(folded(n, kept) for n in node)
    if not isinstance(node, Node):
        return node
    node = Node(node.kind, folded(node.parts, kept))
    kind, parts = node
    known = lambda n: isinstance(n, Node) and n.kind == "value"
    try:
        if kind == "binary" and known(parts[1]) and known(parts[2]):
            return Node("value", (BINARY[parts[0]](parts[1].parts[0], parts[2].parts[0]),))
        if kind == "filter" and known(parts[1]) and parts[0] not in kept:
            return Node("value", (FILTERS[parts[0]](parts[1].parts[0]),))
        if kind == "member" and known(parts[0]) and known(parts[1]):
            return Node("value", (_member(parts[0].parts[0], parts[1].parts[0]),))
    except (TemplateError, TypeError, ZeroDivisionError):
        return node
    if kind == "not" and known(parts[0]):
        return Node("value", (not parts[0].parts[0],))
    if kind in ("and", "or") and known(parts[0]):
        return parts[0] if bool(parts[0].parts[0]) is (kind == "or") else parts[1]
    if kind == "choice" and known(parts[0]):
        return parts[1] if parts[0].parts[0] else parts[2]
    if kind == "write" and known(parts[0]):
        return Node("text", (shown(parts[0].parts[0]),))
    if kind == "if":
        arms = []
        for test, body in parts:
            if test is not None and known(test):
                if not test.parts[0]:
                    continue
                test = None
            arms.append((test, body))
            if test is None:
                break
        if not arms:
            return Node("block")
        return arms[0][1] if arms[0][0] is None else Node("if", tuple(arms))
    if kind == "block":
        nodes: list[Node] = []
        for inner in parts:
            for n in inner.parts if inner.kind == "block" else (inner,):
                if n.kind == "text" and nodes and nodes[-1].kind == "text":
                    nodes[-1] = Node("text", (nodes[-1].parts[0] + n.parts[0],))
                elif n != Node("text", ("",)):
                    nodes.append(n)
        return Node("block", tuple(nodes))
    return node


class Written:
    """What a rendering has written: texts, their length so far, and the spans of generated text."""

    def __init__(self) -> None:
        self.texts, self.length, self.spans, self.begun = [], 0, [], None

    def text(self, text: str) -> None:
        self.texts.append(text)
        self.length += len(text)


Names = dict[str, Any]


def _valued(node: Node, filters: Mapping[str, Callable]) -> Callable[[Names], Any]:
    kind, parts = node
    if kind == "value":
        value = parts[0]
        return lambda names: value
    if kind == "name":
        name = parts[0]
        return lambda names: names.get(name)
    if kind == "filter":
        call, inner = filters[parts[0]], _valued(parts[1], filters)
        return lambda names: call(inner(names))
    if kind == "not":
        inner = _valued(parts[0], filters)
        return lambda names: not inner(names)
    if kind == "choice":
        test, then, other = (_valued(p, filters) for p in parts)
        return lambda names: then(names) if test(names) else other(names)
    if kind == "binary":
        call, left, right = BINARY[parts[0]], _valued(parts[1], filters), _valued(parts[2], filters)

        def compute(names: Names) -> Any:
            try:
                return call(left(names), right(names))
            except (TypeError, ZeroDivisionError) as e:
                raise TemplateError(str(e)) from None

        return compute
    left, right = _valued(parts[0], filters), _valued(parts[1], filters)
    if kind == "and":
        return lambda names: left(names) and right(names)
    if kind == "or":
        return lambda names: left(names) or right(names)
    return lambda names: _member(left(names), right(names))


Step = Callable[[Names, Written], None]


def loop_names(name: str, value: Any, index0: int, length: int) -> Names:
    return {name: value, "loop": {"index0": index0, "index": index0 + 1, "first": index0 == 0, "last": index0 == length - 1, "length": length}}


def _run(node: Node, filters: Mapping[str, Callable]) -> Step:
    kind, parts = node
    if kind == "text":
        text = parts[0]
        return lambda names, out: out.text(text)
    if kind == "write":
        value = _valued(parts[0], filters)
        return lambda names, out: out.text(shown(value(names)))
    if kind == "set":
        target, value = parts[0], _valued(parts[1], filters)
        return lambda names, out: names.__setitem__(target, value(names))
    if kind == "block":
        steps = [_run(p, filters) for p in parts]

        def run_all(names: Names, out: Written) -> None:
            for step in steps:
                step(names, out)

        return run_all
    if kind == "if":
        arms = [(None if test is None else _valued(test, filters), _run(body, filters)) for test, body in parts]

        def run_arm(names: Names, out: Written) -> None:
            for test, body in arms:
                if test is None or test(names):
                    return body(names, out)

        return run_arm
    if kind == "for":
        name, values, body = parts[0], _valued(parts[1], filters), _run(parts[2], filters)

        def run_loop(names: Names, out: Written) -> None:
            all_values = values(names)
            if all_values is not None and not isinstance(all_values, (list, tuple)):
                raise TemplateError("a loop runs over a list")
            for i, value in enumerate(all_values or ()):
                body(names | loop_names(name, value, i, len(all_values)), out)

        return run_loop
    body = _run(parts[0], filters)

    def run_generation(names: Names, out: Written) -> None:
        if out.begun is not None:
            raise TemplateError("generated text inside generated text")
        out.begun = out.length
        body(names, out)
        out.spans.append((out.begun, out.length))
        out.begun = None

    return run_generation


class Template:
    """A compiled template. filters: further ones, or others for those of the language."""

    def __init__(self, source: str, filters: Mapping[str, Callable] | None = None):
        self.tree = folded(parsed(source))
        known = FILTERS | dict(filters or {})
        self._whole = _run(self.tree, known)
        top = self.tree.parts
        loops = [i for i, n in enumerate(top) if n.kind == "for" and n.parts[1] == Node("name", ("messages",))]
        self._parts = None
        if len(loops) == 1 and not any(_names("messages", n) for i, n in enumerate(top) if i != loops[0]) and not _names("messages", top[loops[0]].parts[2]):
            at = loops[0]
            self._loop_name = top[at].parts[0]
            self._parts = [_run(Node("block", tuple(p)), known) for p in (top[:at], [top[at].parts[2]], top[at + 1 :])]

    def render(self, messages: Iterable[Mapping[str, str]], **names: Any) -> tuple[str, list[tuple[int, int]]]:
        """The text of a conversation, and the spans of it (begin, end) that are generated."""
        out = Written()
        self._whole(names | {"messages": list(messages)}, out)
        return "".join(out.texts), out.spans

    def piece(self, message: Mapping[str, str], index0: int, length: int, **names: Any) -> tuple[str, list[tuple[int, int]]]:
        """What message number index0 of length adds to the text, and its generated spans within that: all pieces of a
        conversation, in order, are the text that render() gives. Only for templates whose one use of messages is a loop."""
        if self._parts is None:
            raise TemplateError("not one loop over messages: such a template renders whole conversations only")
        before, body, after = self._parts
        out = Written()
        names = dict(names)
        started = out if index0 == 0 else Written()
        before(names, started)  # the names that it sets count in every round
        body(names | loop_names(self._loop_name, message, index0, length), out)
        if index0 == length - 1:
            after(names, out)
        return "".join(out.texts), out.spans


def _names(name: str, node: Any) -> bool:
    """Whether the tree reads the name anywhere."""
    if isinstance(node, Node):
        return node == Node("name", (name,)) or _names(name, node.parts)
    return isinstance(node, tuple) and any(_names(name, n) for n in node)
