"""Functions of languages with braces: ECMAScript and Vue, Go, Java, C#, C and Rust.

A tokenizer drops comments and the insides of strings; a statement parser by matching brackets follows, which knows of expressions only what the
metrics need. One graph builder serves all languages; what differs among them is in RULES.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from dataclasses import dataclass, field

from .flow import Flow

ECMA = {"TypeScript", "TypeScriptReact", "JavaScript", "JavaScriptReact", "Vue"}
_TOKEN = re.compile(
    r"""(?P<skip>\s+|//[^\n]*|/\*.*?\*/|\#!\[?[^\n]*)|(?P<str>"(?:\\.|[^"\\\n])*"|'(?:\\.|[^'\\\n])*'|`(?:\\.|[^`\\])*`)|(?P<num>\d[\w.]*)|(?P<id>[A-Za-z_$@\#][\w$]*!?(?!=))|(?P<id2>[A-Za-z_$][\w$]*)|(?P<op>\?\?=|\?\.|\?\?|=>|->|<-|::|&&=|\|\|=|&&|\|\||[-+*/%&|^<>=!]=|\+\+|--|<<|>>|\.\.\.?|[^\s\w])""",
    re.S | re.X,
)


@dataclass
class Token:
    text: str
    kind: str
    at: int
    line: int


@dataclass
class Statement:
    kind: str
    parts: list = field(default_factory=list)  # lists of statements
    inner: list = field(default_factory=list)  # bodies of functions inside the expression
    flags: dict = field(default_factory=dict)


@dataclass
class Rules:
    starts: bool  # branches begin with a node of their own
    returns: bool  # return and throw are nodes
    nesting: frozenset
    exits: frozenset
    case_extra: bool = False
    default_extra: bool = False
    catch_extra: bool = False
    ternary_extra: bool = False
    nullish_extra: bool = False
    tail_free: bool = False
    callee: str = "chain"


_LOOPS = {"while", "do", "for"}
RULES = {
    "ecma": Rules(True, False, frozenset({"if", "switch", "try", *_LOOPS}), frozenset({"return", "throw", "break", "continue"}), case_extra=True, catch_extra=True, tail_free=True),
    "Go": Rules(True, True, frozenset({"if", "for", "switch", "select"}), frozenset({"return", "defer", "panic"}), case_extra=True, default_extra=True),
    "Java": Rules(False, False, frozenset({"if", "switch", "try", "synchronized", *_LOOPS}), frozenset({"return", "throw", "break", "continue"}), ternary_extra=True, callee="whole"),
    "CSharp": Rules(False, False, frozenset({"if", "switch", "try", *_LOOPS}), frozenset({"return", "throw", "break", "continue"}), ternary_extra=True, nullish_extra=True, callee="whole"),
    "C": Rules(False, False, frozenset({"if", "switch", *_LOOPS}), frozenset({"return", "break", "continue", "goto"}), ternary_extra=True, callee="chain"),
    "Rust": Rules(True, True, frozenset({"if", "match", "loop", "while", "for"}), frozenset({"return", "?"}), case_extra=True, tail_free=True, callee="last"),
}
_OPEN, _CLOSE = {"(": ")", "[": "]", "{": "}"}, {")", "]", "}"}
_CONTROL = {"if", "for", "while", "switch", "catch", "return", "do", "else", "try", "throw", "new", "await", "typeof", "sizeof", "synchronized", "match", "loop", "function", "fn", "func", "foreach", "using", "lock", "case", "delete", "void", "in", "of", "yield", "super", "unless", "fixed"}


def tokenize(text: str, language: str) -> list[Token]:
    breaks = [i for i, c in enumerate(text) if c == "\n"]
    out, pos = [], 0
    while pos < len(text):
        if language in ECMA and text[pos] == "/" and text[pos : pos + 2] not in ("//", "/*") and (not out or out[-1].text in "(,=:[!&|?{};+-*%<>~^" or out[-1].text in ("return", "&&", "||", "=>", "==", "!=", "typeof", "case")):
            m = re.compile(r"/(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\n])+/[a-z]*").match(text, pos)
            if m:
                out.append(Token("/re/", "str", pos, bisect_right(breaks, pos - 1) + 1))
                pos = m.end()
                continue
        if language == "Rust" and text[pos] == "'" and (m := re.compile(r"'[A-Za-z_]\w*(?!')").match(text, pos)):
            out.append(Token(m.group(), "life", pos, bisect_right(breaks, pos - 1) + 1))
            pos = m.end()
            continue
        if language == "C" and text[pos] == "#" and (not out or out[-1].line < bisect_right(breaks, pos - 1) + 1):
            end = pos
            while (end := text.find("\n", end)) >= 0 and text[end - 1] == "\\":
                end += 1
            pos = len(text) if end < 0 else end
            continue
        m = _TOKEN.match(text, pos)
        kind = m.lastgroup
        if kind != "skip":
            word = m.group()
            if kind in ("id", "id2"):
                kind = "id"
                if word.endswith("!") and language != "Rust":
                    word = word[:-1]
            out.append(Token(word, kind, pos, bisect_right(breaks, pos - 1) + 1))
            pos += len(word)
        else:
            pos = m.end()
    return out


class Parser:
    def __init__(self, text: str, language: str):
        self.text, self.language = text, language
        self.rules = RULES["ecma" if language in ECMA else language]
        self.t = tokenize(text, language)
        self.match = self._brackets()
        self.newline_ends = language in ECMA or language == "Go"

    def _brackets(self) -> dict[int, int]:
        stack, out = [], {}
        for i, t in enumerate(self.t):
            if t.kind != "op":
                continue
            if t.text in _OPEN:
                stack.append(i)
            elif t.text in _CLOSE:
                if not stack or _OPEN[self.t[stack[-1]].text] != t.text:
                    raise ValueError(f"unbalanced bracket in line {t.line}")
                a = stack.pop()
                out[a], out[i] = i, a
        if stack:
            raise ValueError("bracket without end")
        return out

    def word(self, i: int) -> str:
        return self.t[i].text if 0 <= i < len(self.t) else ""

    # Statements -------------------------------------------------------------------------------------------------------------------

    def block(self, i: int) -> list[Statement]:
        """The statements between the brace at i and its match."""
        return self.statements(i + 1, self.match[i])

    def statements(self, i: int, end: int) -> list[Statement]:
        out = []
        while i < end:
            if self.word(i) in (";", ","):
                i += 1
                continue
            s, i = self.statement(i, end)
            out.append(s)
        return out

    def _body(self, i: int, end: int) -> tuple[list[Statement], int]:
        if self.word(i) == "{":
            return self.block(i), self.match[i] + 1
        if self.word(i) == ";":
            return [], i + 1
        s, j = self.statement(i, end)
        return [s], j

    def _head(self, i: int, end: int) -> int:
        """The brace that begins the body of a statement whose head isn't in parentheses."""
        while i < end and self.word(i) != "{":
            i = self.match[i] + 1 if self.word(i) in ("(", "[") else i + 1
        return i

    def statement(self, i: int, end: int) -> tuple[Statement, int]:
        w, free = self.word(i), self.language in ("Go", "Rust")
        if self.t[i].kind == "life" and self.word(i + 1) == ":":
            return self.statement(i + 2, end)
        if self.t[i].kind == "id" and self.word(i + 1) == ":" and self.word(i + 2) != ":" and w not in ("default", "case") and self.language not in ("Rust",):
            if i + 2 >= end:
                return Statement("label"), i + 2
            s, j = self.statement(i + 2, end)
            return (Statement("labelled", [[s]], flags={"name": w}), j)
        if w == "{":
            return Statement("block", [self.block(i)]), self.match[i] + 1
        if w in ("async", "await") and self.word(i + 1) in ("for", "using"):
            return self.statement(i + 1, end)
        if w == "if":
            head = self._head(i + 1, end) if free else self.match[i + 1] + 1
            then, j = self._body(head, end)
            other = None
            if self.word(j) == "else" and j < end:
                other, j = self._body(j + 1, end)
            return Statement("if", [then, other or []], self.closures(i + 1, head), {"else": other is not None, "cond": (i + 1, head)}), j
        if w in ("while", "loop") or w in ("for", "foreach"):
            head = self._head(i + 1, end) if free else (self.match[i + 1] if self.word(i + 1) == "(" else self.match[i + 2]) + 1
            body, j = self._body(head, end)
            inside = [x.text for x in self.t[i + 1 : head]]
            flags = {"label": None, "cond": (i + 1, head) if w != "for" else (i + 1 + [x.text for x in self.t[i + 1 : head]].index("in") + 1, head) if "in" in [x.text for x in self.t[i + 1 : head]] else (head, head)}
            kind = w
            if w == "for":
                depth, semis, parts = 0, [], [x for x in range(i + 2, head - 1)]
                for x in range(i + (1 if free else 2), head - (0 if free else 1)):
                    depth += (self.word(x) in _OPEN) - (self.word(x) in _CLOSE)
                    if self.word(x) == ";" and depth == 0:
                        semis.append(x)
                if len(semis) == 2:
                    flags |= {"init": semis[0] > i + (1 if free else 2), "test": semis[1] > semis[0] + 1, "update": semis[1] + 1 < head - (0 if free else 1)}
                else:
                    kind = "forin" if ("in" in inside or "of" in inside or ":" in inside or "range" in inside or self.language == "Rust") else "for"
                    flags |= {"init": False, "test": len(inside) > 0, "update": False}
            elif w == "foreach":
                kind = "forin"
            return Statement({"foreach": "forin"}.get(kind, kind), [body], self.closures(i + 1, head), flags), j
        if w == "do":
            body, j = self._body(i + 1, end)
            if self.word(j) == "while":
                j = self.match[j + 1] + 1
            return Statement("do", [body]), j
        if w in ("switch", "select", "match"):
            head = self._head(i + 1, end)
            return Statement(w, self.cases(head, w), self.closures(i + 1, head), {"cases": self.labels(head, w), "default": self._has_default(head), "cond": (i + 1, head)}), self.match[head] + 1
        if w == "try" and self.word(i + 1) == "(":  # with resources: one plain statement
            j = self.match[self.match[i + 1] + 1] + 1
            while self.word(j) in ("catch", "finally"):
                while self.word(j) != "{":
                    j = self.match[j] + 1 if self.word(j) == "(" else j + 1
                j = self.match[j] + 1
            return Statement("simple", [], self.closures(i, j)), j
        if w == "try":
            j, inner = i + 1, []
            body, j = self._body(j, end)
            catches, last = [], None
            while self.word(j) in ("catch", "finally") and j < end:
                what = self.word(j)
                j += 1
                while self.word(j) != "{":
                    j = self.match[j] + 1 if self.word(j) == "(" else j + 1
                part, j = self._body(j, end)
                if what == "catch":
                    catches.append(part)
                else:
                    last = part
            return Statement("try", [body, *catches, last or []], inner, {"finally": last is not None, "catches": len(catches)}), j
        if w in ("synchronized", "lock", "using", "fixed", "unsafe", "checked") and self.language in ("Java", "CSharp") and self.word(i + 1) == "(":
            body, j = self._body(self.match[i + 1] + 1, end)
            return Statement("synchronized" if w == "synchronized" else "with", [body]), j
        if w in ("function", "class", "interface", "enum", "namespace") or (w == "async" and self.word(i + 1) == "function"):
            if self.language in ECMA:
                j = self._head(i + 1, end)
                return Statement("simple", [], self.closures(i, self.match.get(j, j) + 1)), self.match.get(j, j) + 1
        j = self.expression_end(i, end)
        kind = w if w in ("return", "throw", "break", "continue", "goto", "defer") else "panic" if self.language == "Go" and w == "panic" else "simple"
        label = self.word(i + 1) if kind in ("break", "continue") and i + 1 < j and self.t[i + 1].kind == "id" and self.t[i + 1].line == self.t[i].line else None
        s = Statement(kind, [], self.closures(i, j), {"label": label, "tail": self.word(j - 1) != ";" and self.word(j) != ";"})
        if self.language == "Rust":
            s.flags |= {"span": (i, j), "let": True}
            s.inner = self._rust_inner(i, j)
        return s, max(j, i + 1)

    def _rust_inner(self, i: int, j: int) -> list[list[Statement]]:
        """The if, match or loop that a `let` takes its value from."""
        for x in range(i, j):
            if self.word(i) == "let" and self.word(x) in ("match", "if", "loop") and self.word(x - 1) == "=":
                return [[self.statement(x, j)[0]]]
            if self.word(x) in ("(", "[", "{", ";"):
                break
        return []

    def rust_counts(self, body: list[Statement]) -> tuple[int, int, list[str]]:
        """Complexity extras, exits and callees. Only the outermost expression of a statement, condition, arm or initial value is looked at: what is in parentheses, arguments or operands isn't."""
        extras, exits, calls = 0, 0, set()

        def root(i: int, j: int, statement: bool) -> None:
            nonlocal extras, exits
            if self.word(i) == "return":
                exits += 1
                return
            if self.word(i) == "let":
                x = i
                while x < j and self.word(x) != "=":
                    x = self.match[x] + 1 if self.word(x) in _OPEN else x + 1
                i, statement = x + 1, False
                if self.word(i) in ("match", "if", "loop"):
                    return
            if self.word(j - 1) == ";":
                j -= 1
            elif statement and self.t[i].kind == "id" and self.word(i).endswith("!") and self.word(i + 1) != "{":
                statement = False
            flat, x = [], i
            while x < j:
                flat.append(x)
                x = self.match[x] + 1 if self.word(x) in _OPEN else x + 1
            ops = [x for x in flat if self.t[x].kind == "op" and self.word(x) not in ("(", "[", "{", ".", "::", "?", "&", "<", ">", ",")]
            extras += sum(self.word(x) in ("&&", "||") for x in flat)
            if not flat:
                return
            if self.t[i].kind == "id" and self.word(i).endswith("!") and len(flat) == 2:
                calls.add(self.word(i)[:-1])
                exits += not statement and self.word(i) in ("panic!", "unreachable!", "todo!", "unimplemented!")
            elif self.word(flat[-1]) == "?" and not ops:
                exits += 1
            elif self.word(flat[-1]) == "(" and not ops and len(flat) > 1 and self.t[flat[-2]].kind == "id":
                name = self.word(flat[-2])
                calls.add(name)
                exits += name in ("unwrap", "expect", "unwrap_or", "unwrap_or_else") and self.word(flat[-2] - 1) == "."

        def walk(part: list[Statement]) -> None:
            nonlocal extras
            for s in part:
                if "cond" in s.flags:
                    i, j = s.flags["cond"]
                    if self.word(i) == "let":
                        while i < j and self.word(i) != "=":
                            i = self.match[i] + 1 if self.word(i) in _OPEN else i + 1
                        i += 1
                    if i < j:
                        root(i, j, False)
                if s.kind == "match":
                    extras += s.flags["cases"]
                if "span" in s.flags:
                    root(*s.flags["span"], True)
                for inner in (*s.parts, *(s.inner if s.flags.get("let") else [])):
                    walk(inner)

        walk(body)
        return extras, exits, sorted(calls)

    def expression_end(self, i: int, end: int) -> int:
        j = i
        while j < end:
            w = self.word(j)
            if w == ";":
                return j + 1
            if w in _OPEN:
                k = self.match[j] + 1
                if w == "{" and self.language == "Rust" and self.word(i) not in ("let", "return") and self.word(k) not in (".", "?", ";", ")"):
                    return k
                if w == "{" and k < end and self.language in ("Java", "CSharp", "C") and self.word(k) not in (";", ")", ",", ".", "(", "}"):
                    return k
                j = k
            else:
                j += 1
            if self.newline_ends and j < end and self.t[j].line > self.t[j - 1].line and self._breaks(j):
                return j
        return j

    def _breaks(self, j: int) -> bool:
        a, b = self.t[j - 1], self.t[j]
        if self.language == "Go":
            return a.kind in ("id", "num", "str") or a.text in (")", "]", "}", "++", "--")
        going = a.kind == "op" and a.text not in (")", "]", "}", "++", "--")
        coming = b.kind == "op" and b.text not in ("{", "[", "++", "--", "!", "~", "}") and b.text != "@"
        return not going and not coming and b.text not in ("instanceof", "in", "of", "as") and a.text not in ("=>", "new", "=")

    def cases(self, head: int, kind: str) -> list[list[Statement]]:
        out, i, end = [], head + 1, self.match[head]
        if kind == "match":
            while i < end:
                while i < end and self.word(i) != "=>":
                    i = self.match[i] + 1 if self.word(i) in _OPEN else i + 1
                i += 1
                if self.word(i) == "{":
                    out.append(self.block(i))
                    i = self.match[i] + 1
                else:
                    j = i
                    while j < end and self.word(j) != ",":
                        j = self.match[j] + 1 if self.word(j) in _OPEN else j + 1
                    out.append(self.statements(i, j) if j > i else [])
                    i = j
                if self.word(i) == ",":
                    i += 1
            return out
        marks = []
        while i < end:
            if self.word(i) in ("case", "default") and self.word(i - 1) != ".":
                j = i + 1
                while j < end and self.word(j) not in (":", "->"):
                    j = self.match[j] + 1 if self.word(j) in _OPEN else j + 1
                marks.append((i, j + 1))
                i = j + 1
            else:
                i = self.match[i] + 1 if self.word(i) in _OPEN else i + 1
        for (_, a), (b, _) in zip(marks, [*marks[1:], (end, end)]):
            out.append(self.statements(a, b))
        return out

    def labels(self, head: int, kind: str) -> int:
        return len(self.cases(head, kind))

    def _has_default(self, head: int) -> bool:
        i = head + 1
        while i < self.match[head]:
            if self.word(i) == "default" and self.word(i + 1) in (":", "->"):
                return True
            i = self.match[i] + 1 if self.word(i) in _OPEN else i + 1
        return False

    # Functions --------------------------------------------------------------------------------------------------------------------

    def closures(self, i: int, j: int) -> list[list[Statement]]:
        """The bodies of functions inside an expression."""
        out, x = [], i
        while x < j:
            f = self.function_at(x)
            if f and f["open"] < j and f["block"]:
                out.append(self.block(f["open"]))
                x = self.match[f["open"]] + 1
            elif self.language in ("Java", "CSharp") and self.word(x) in ("->", "=>") and self.word(x + 1) == "{":
                out.append(self.block(x + 1))
                x = self.match[x + 1] + 1
            elif self.language == "Java" and self.word(x) == "switch" and x > i:
                out.append([self.statement(x, j)[0]])
                x = self.match[self._head(x, j)] + 1
            else:
                x += 1
        return out

    def function_at(self, i: int) -> dict | None:
        """The function whose name or parameters begin at token i: its name, body and first token."""
        w, lang = self.word(i), self.language
        if lang in ECMA:
            if w == "function":
                j = i + 1 + (self.word(i + 1) == "*")
                name = self.word(j) if self.t[j].kind == "id" else ""
                j += bool(name)
                if self.word(j) != "(":
                    return None
                k = self._to_body(self.match[j] + 1)
                first = i - (self.word(i - 1) == "async")
                return k is not None and {"name": name or self.assigned(first), "open": k, "block": True, "first": first} or None
            if w == "=>" and i > 0:
                a = self.match[i - 1] if self.word(i - 1) == ")" else i - 1
                if self.word(i - 1) not in (")",) and self.t[i - 1].kind != "id":
                    return None
                if self.t[i - 1].kind == "id" and self.word(i - 2) == ":" and self.word(i - 3) == ")":
                    a = self.match[i - 3]
                first = a - (self.word(a - 1) == "async")
                return {"name": self.assigned(first), "open": i + 1, "block": self.word(i + 1) == "{", "first": first, "arrow": True}
            if self.t[i].kind == "id" and self.word(i + 1) == "(" and w not in _CONTROL and self.word(i - 1) not in (".", "new", "function", "*") or (self.t[i].kind == "id" and self.word(i + 1) == "(" and w not in _CONTROL and self.word(i - 1) == "*" and self.word(i - 2) in ("{", "}", ";", ",", "async", "static")):
                k = self._to_body(self.match[i + 1] + 1)
                if k is not None and self.word(i - 1) in ("{", "}", ";", ",", "async", "static", "get", "set", "public", "private", "protected", "readonly", "override", "abstract", "*") or (k is not None and i > 0 and self.t[i - 1].line < self.t[i].line and self.word(i - 1) not in ("=", "(", "return", "=>")):
                    first = i
                    while self.word(first - 1) in ("async", "static", "get", "set", "public", "private", "protected", "readonly", "override", "*"):
                        first -= 1
                    return {"name": w, "open": k, "block": True, "first": first}
            return None
        if lang == "Go":
            if w != "func":
                return None
            j, name = i + 1, ""
            if self.word(j) == "(" and self.t[self.match[j] + 1].kind == "id" and self.word(self.match[j] + 2) == "(":
                j = self.match[j] + 1
            if self.t[j].kind == "id":
                name, j = self.word(j), j + 1
                if self.word(j) == "[":
                    j = self.match[j] + 1
            if self.word(j) != "(":
                return None
            k = self.match[j] + 1
            while self.word(k) != "{" and k < len(self.t) and self.t[k].line == self.t[k - 1].line:
                k = self.match[k] + 1 if self.word(k) in ("(", "[") else k + 1
            return {"name": name, "open": k, "block": True, "first": i} if self.word(k) == "{" else None
        if lang == "Rust":
            if w != "fn" or self.t[i + 1].kind != "id":
                return None
            k = i + 2
            while k < len(self.t) and self.word(k) not in ("{", ";"):
                k = self.match[k] + 1 if self.word(k) in ("(", "[") else k + 1
            return {"name": self.word(i + 1), "open": k, "block": True, "first": i} if self.word(k) == "{" else None
        # Java, C#, C: a name, parameters, and a body; what comes before is a type or a modifier.
        if self.t[i].kind == "id" and self.word(i + 1) == "(" and w not in _CONTROL and self.word(i - 1) not in (".", "new", "=", "return", "->", "(", ",", "!", "&&", "||", "?", ":", "+", "throw", "else", "=>"):
            k = self.match[i + 1] + 1
            while k < len(self.t) and self.word(k) in ("throws", "const", "where", "noexcept", ":", ",", ".") or (self.word(k - 1) in ("throws", ",", ".", ":", "where") and self.t[k].kind == "id"):
                k += 1
                if self.word(k) == "(":
                    k = self.match[k] + 1
            if self.word(k) == "{" and i > 0:
                first = i
                while first > 0 and self.word(first - 1) not in (";", "}", "{", ")"):
                    first -= 1
                return {"name": w, "open": k, "block": True, "first": first}
        return None

    def _to_body(self, k: int) -> int | None:
        """The brace after parameters, past a return type."""
        if self.word(k) == ":":
            k += 1
            while k < len(self.t) and not (self.word(k) == "{" and self.word(k - 1) not in (":", "|", "&", "<", ",")):
                if self.word(k) in (";", ")", "=", "}"):
                    return None
                k = self.match[k] + 1 if self.word(k) in _OPEN else k + 1
        return k if self.word(k) == "{" else None

    def assigned(self, first: int) -> str:
        """The name that a function expression is given, if it is."""
        if self.word(first - 1) == "=" and self.t[first - 2].kind == "id" and self.word(first - 3) in ("const", "let", "var"):
            return self.word(first - 2)
        x = first - 1
        if self.word(x) == "=":
            while x > 0 and self.t[x].line == self.t[first].line:
                if self.word(x) in ("const", "let", "var"):
                    return self.word(x + 1)
                x -= 1
        return "<anonymous>"

    def functions(self) -> list[dict]:
        out, i, scopes = [], 0, []
        while i < len(self.t):
            while scopes and i > scopes[-1][1]:
                scopes.pop()
            if self.language == "Rust" and self.word(i) == "impl":
                head = self._head(i + 1, len(self.t))
                names = [x.text for x in self.t[i + 1 : head] if x.kind == "id"]
                if head < len(self.t):
                    own = names[names.index("for") + 1] if "for" in names else names[0] if names else ""
                    scopes.append((own, self.match[head]))
            f = self.function_at(i)
            if f and f["open"] < len(self.t):
                if self.language == "Rust" and scopes:
                    f["name"] = f"{scopes[-1][0]}::{f['name']}"
                if f["name"] or self.language in ECMA:
                    out.append(f)
            i += 1
        return out

    # Metrics ----------------------------------------------------------------------------------------------------------------------

    def metrics(self, f: dict) -> dict:
        r = self.rules
        if f["block"]:
            body, last = self.block(f["open"]), self.match[f["open"]]
            span = range(f["open"] + 1, last)
        else:
            last = self.expression_end_arrow(f["open"])
            body = [Statement("return", [], self.closures(f["open"], last + 1))]
            span = range(f["open"], last + 1)
        b = _Builder(r, self.language)
        if self.language == "Go" and body or self.language == "Java" and not body and re.search("//|/\\*", self.text[self.t[f["open"]].at : self.t[last].at]):
            b.step()
        else:
            b.block(body)
        b.finish()
        if self.language == "Rust":
            extras, exits, calls = self.rust_counts(body)
        else:
            extras, exits, calls = self.extras(span), self.exits(span), self.callees(span)
        if r.tail_free and body and body[-1].kind == "return":
            exits = max(0, exits - 1)
        line, stop = self.t[f["first"]].line, self.t[last].line
        return {"function": f["name"] or "<anonymous>", "line": line, "end_line": stop, "cc": b.complexity() + extras, "nd": depth(body, r), "fo": len(calls), "ns": exits, "loc": stop - line + 1, "callees": calls}

    def expression_end_arrow(self, i: int) -> int:
        j = i
        while j < len(self.t):
            w = self.word(j)
            if w in _OPEN:
                j = self.match[j]
            nxt = self.word(j + 1)
            if nxt in (",", ";", ")", "]", "}", "") or (self.t[j + 1].line > self.t[j].line and self._breaks(j + 1)):
                return j
            j += 1
        return len(self.t) - 1

    def extras(self, span: range) -> int:
        r, n = self.rules, 0
        for i in span:
            w = self.word(i)
            if self.t[i].kind == "op":
                n += w in ("&&", "||")
                n += r.nullish_extra and w == "??"
                n += r.ternary_extra and w == "?" and self.word(i + 1) not in (">", ",", ".") and self._is_ternary(i)
            elif self.t[i].kind == "id":
                n += r.catch_extra and w == "catch" and self.word(i - 1) == "}"
                n += r.case_extra and w == "case" and self.language != "Rust" and self.word(i - 1) != "."
                n += (r.default_extra or self.language in ECMA) and w == "default" and self.word(i + 1) == ":" and self.word(i - 1) != "."
        return n

    def _is_ternary(self, i: int) -> bool:
        depth = 0
        for j in range(i + 1, min(len(self.t), i + 400)):
            w = self.word(j)
            depth += (w in _OPEN) - (w in _CLOSE)
            if depth < 0 or (w == ";" and depth == 0):
                return False
            if w == ":" and depth == 0:
                return True
        return False

    def exits(self, span: range) -> int:
        n = 0
        for i in span:
            w = self.word(i)
            if self.language == "Go":
                n += w in ("return", "defer") and self.t[i].kind == "id"
                n += self.word(i + 1) == "(" and (w == "panic" or (self.word(i - 1) == "." and (w == "Exit" or w.startswith("Fatal"))))
            else:
                n += self.t[i].kind == "id" and w in self.rules.exits and self.word(i - 1) != "."
        return n

    def callees(self, span: range) -> list[str]:
        out = set()
        for i in span:
            if self.word(i) != "(" or i == 0:
                continue
            a = i - 1
            if self.t[a].kind != "id" or self.word(a) in _CONTROL and self.word(a) != "super":
                continue
            if self.word(a - 1) in ("function", "fn", "func") or (self.function_at(a) and self.language != "Go"):
                continue
            s = a
            while s - 2 >= 0 and self.word(s - 1) in (".", "?.", "::", "->") and (self.t[s - 2].kind == "id" or self.word(s - 2) in (")", "]")):
                s -= 2
                if self.word(s) in (")", "]"):
                    s = self.match[s]
                    while s > 0 and self.t[s - 1].kind == "id" and self.word(s) in ("(", "["):
                        s -= 1
            if self.word(s - 1) == "new" and self.language not in ("C",):
                continue
            if self.rules.callee == "whole":
                out.add(self.text[self.t[s].at : self.t[self.match[i]].at + 1])
            elif self.language in ECMA:
                chain = [self.word(x) for x in range(s, a + 1) if self.t[x].kind == "id" or self.word(x) == "."]
                out.add("".join("." if c == "?." else c for c in chain) if self.word(s) not in ("(", "[") else self.word(a))
            else:
                out.add(self.text[self.t[s].at : self.t[a].at + len(self.word(a))])
        if self.language == "Go":
            out |= {f"<go@{self.t[i].at}>" for i in span if self.word(i) == "go" and self.t[i].kind == "id" and self.word(i - 1) in ("{", "}", ";", ")")}
        return sorted(out)


def depth(body: list[Statement], r: Rules) -> int:
    best = 0
    for s in body:
        own = (s.kind if s.kind != "forin" else "for") in r.nesting
        parts = [depth(p, r) for p in (*s.parts, *s.inner)]
        best = max(best, own + max(parts, default=0))
    return best


class _Builder(Flow):
    def __init__(self, rules: Rules, language: str):
        super().__init__()
        self.r, self.language = rules, language

    def block(self, body: list[Statement]) -> None:
        for s in body:
            self.visit(s)

    def branch(self, source: int, body: list[Statement]) -> int | None:
        """A branch from a condition; where control is at its end."""
        self.at = self.node(source) if self.r.starts else source
        self.block(body)
        return self.at

    def visit(self, s: Statement, label: str | None = None) -> None:
        kind = s.kind
        if kind in ("labelled", "label") and self.language == "C":
            self.at = self.node(self.at if self.at is not None else self.ENTRY)
        if self.at is None:
            return
        if kind == "labelled":
            self.visit(s.parts[0][0], s.flags["name"])
        elif kind in ("block", "with"):
            if kind == "with":
                self.step()
            self.block(s.parts[0])
        elif kind == "if":
            cond = self.node(self.at)
            then = self.branch(cond, s.parts[0])
            other = self.branch(cond, s.parts[1]) if s.flags["else"] else cond
            if then is None and other is None:
                self.at = None
            else:
                self.at = self.node(*dict.fromkeys(x for x in (other, then) if x is not None)) if then != other else self.node(then, then)
        elif kind in ("while", "for", "forin", "loop"):
            self.loop(s, label)
        elif kind == "do":
            head = self.node(self.at)
            target = {"label": label, "break": None, "continue": head}
            self.targets.append(target)
            end = self.branch(head, s.parts[0])
            self.targets.pop()
            after = target["break"]
            if end is not None:
                cond = self.node(end)
                self.edge(cond, head)
                after = after if after is not None else self.node()
                self.edge(cond, after)
            self.at = after
        elif kind in ("switch", "select", "match"):
            self.switch(s, label)
        elif kind == "try":
            self.try_(s)
        elif kind == "synchronized":
            self.at = self.node(self.at)
            self.block(s.parts[0])
        elif kind in ("return", "throw", "goto", "panic"):
            if self.r.returns or kind == "goto":
                self.step()
            self.edge(self.at, self.EXIT)
            if self.language != "Rust":
                self.at = None
        elif kind in ("break", "continue") and self.language != "Rust":
            self.jump(kind, s.flags["label"])
        else:
            self.step()

    def loop(self, s: Statement, label: str | None) -> None:
        if s.kind == "for" and s.flags.get("init"):
            self.step()
        head = self.node(self.at)
        tested = s.kind != "loop" and (s.kind != "for" or s.flags["test"])
        cond = self.node(head) if tested else head
        target = {"label": label, "break": self.node(cond) if tested else None, "continue": head}
        self.targets.append(target)
        end = self.branch(cond, s.parts[0])
        self.targets.pop()
        if end is not None:
            if s.kind == "for" and s.flags.get("update"):
                end = self.node(end)
            self.edge(end, head)
        if target["break"] is None and self.language == "Rust":
            target["break"] = self.node(head)
        self.at = target["break"]

    def switch(self, s: Statement, label: str | None) -> None:
        cond = self.node(self.at)
        if self.language == "Java":  # its labels are taken as plain statements in a row
            self.at = cond
            for _ in s.parts:
                self.step()
            self.at = self.node(self.at, cond)
            return
        target = {"label": label, "break": None, "continue": None}
        self.targets.append(target)
        falls = self.language not in ("Go", "Rust")
        end, ends = None, []
        for part in s.parts:
            start = self.node(cond)
            if falls and end is not None:
                self.edge(end, start)
            self.at = start
            self.block(part)
            end = self.at
            if not falls and end is not None:
                ends.append(end)
        self.targets.pop()
        if falls and end is not None:
            ends.append(end)
        if self.language in ("C", "CSharp"):
            ends.append(cond)
        if ends:
            after = target["break"] if target["break"] is not None else self.node()
            for e in ends:
                self.edge(e, after)
            self.at = after
        else:
            self.at = target["break"]

    def try_(self, s: Statement) -> None:
        start = self.at = self.node(self.at)
        body, catches, last, ecma = s.parts[0], s.parts[1 : 1 + s.flags["catches"]], s.parts[-1], self.language in ECMA
        self.block(body)
        if ecma:
            self.finish()
        ends = [self.at]
        for c in catches:
            self.at = self.node(start)
            self.block(c)
            if ecma:
                self.finish()
            ends.append(self.at)
        live = [e for e in ends if e is not None]
        if ecma and not catches and not s.flags["finally"]:
            self.edge(start, self.EXIT)
        if s.flags["finally"] and ecma:
            self.at = self.node(*(live or [start]))
            self.block(last)
            self.finish()
            if self.at is not None:
                self.at = self.node(self.at)
            return
        self.at = self.node(*live) if live else None

    def jump(self, kind: str, label: str | None) -> None:
        for t in reversed(self.targets):
            if (label is None or t["label"] == label) and (kind == "break" or t["continue"] is not None):
                if kind == "break" and t["break"] is None:
                    t["break"] = self.node()
                self.edge(self.at, t[kind])
                break
        self.at = None


def extract_braces(text: str, language: str) -> list[dict]:
    shift = 0
    if language == "Vue":
        m = re.search(r"<script\b([^>]*)>(.*?)</script>", text, re.S)
        if not m:
            return []
        shift, text = text[: m.start(2)].count("\n"), m.group(2)
    if language not in ECMA and language not in RULES:
        return []
    p = Parser(text, language)
    out = [p.metrics(f) for f in p.functions()]
    for f in out:
        f["line"] += shift
        f["end_line"] += shift
    return sorted(out, key=lambda x: x["line"])
