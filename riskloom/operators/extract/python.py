"""Functions of Python files, by the standard library's parser."""

from __future__ import annotations

import ast

from .flow import Flow

NESTING = (ast.If, ast.While, ast.For, ast.AsyncFor, ast.Try, ast.TryStar, ast.With, ast.AsyncWith, ast.Match)
EXITS = (ast.Return, ast.Raise, ast.Break, ast.Continue)
COMPS = (ast.ListComp, ast.DictComp, ast.SetComp, ast.GeneratorExp)


def _decides(node: ast.AST) -> bool:
    """Whether an expression has a conditional, a boolean operator or a filtered comprehension; comprehensions hide what is inside them."""
    if isinstance(node, COMPS):
        return any(g.ifs for g in node.generators)
    return isinstance(node, (ast.IfExp, ast.BoolOp)) or any(_decides(c) for c in ast.iter_child_nodes(node))


def _extras(node: ast.AST) -> int:
    n = sum(map(_extras, ast.iter_child_nodes(node)))
    if isinstance(node, ast.BoolOp):
        n += len(node.values) - 1
    elif isinstance(node, ast.IfExp) or (isinstance(node, COMPS) and any(g.ifs for g in node.generators)):
        n += 1
    return n


def _depth(nodes: list[ast.AST], chained: bool = False) -> int:
    best = 0
    for node in nodes:
        if isinstance(node, ast.If):
            orelse = node.orelse
            tail = _depth(orelse) if not (len(orelse) == 1 and isinstance(orelse[0], ast.If) and getattr(orelse[0], "_elif", False)) else _depth(orelse) - 1
            best = max(best, 1 + max(_depth(node.body), _depth([node.test]), tail))
        else:
            best = max(best, isinstance(node, NESTING) + _depth(list(ast.iter_child_nodes(node))))
    return best


class _Builder(Flow):
    def block(self, body: list[ast.stmt]) -> None:
        for s in body:
            self.visit(s)
        self.finish()

    def join(self, ends: list[int]) -> None:
        j = self.node()
        for e in ends:
            if e != self.EXIT:
                self.edge(e, j)
        self.at = j

    def visit(self, s: ast.stmt) -> None:
        kind = type(s)
        if kind is ast.If:
            self.if_(s)
        elif kind in (ast.While, ast.For, ast.AsyncFor):
            head = self.node(self.at)
            body = self.node(head)
            after = self.node()
            self.targets.append({"break": after, "continue": head})
            self.at = body
            self.block(s.body)
            if self.at != self.EXIT:
                self.edge(self.at, head)
            self.targets.pop()
            self.edge(head, after)
            self.at = after
        elif kind in (ast.Try, ast.TryStar):
            self.try_(s)
        elif kind in (ast.With, ast.AsyncWith):
            self.step()
            self.block(s.body)
        elif kind in (ast.Return, ast.Raise):
            self.edge(self.at, self.EXIT)
            self.at = self.EXIT
        elif kind in (ast.Break, ast.Continue):
            if self.targets:
                to = self.targets[-1]["break" if kind is ast.Break else "continue"]
                self.edge(self.at, to)
                self.at = to
        else:
            self.step()

    def if_(self, s: ast.If) -> None:
        cond = self.node(self.at)
        self.at = self.node(cond)
        self.block(s.body)
        ends, after = [self.at], self.node()
        while len(s.orelse) == 1 and isinstance(s.orelse[0], ast.If) and s.orelse[0]._elif:
            s = s.orelse[0]
            cond = self.node(cond)
            self.at = self.node(cond)
            self.block(s.body)
            ends.append(self.at)
        if s.orelse:
            self.at = self.node(cond)
            self.block(s.orelse)
            ends.append(self.at)
        self.edge(cond, after)
        for e in ends:
            if e != self.EXIT:
                self.edge(e, after)
        self.at = after

    def try_(self, s: ast.Try) -> None:
        before = self.at
        start = self.at = self.node(before)
        self.block(s.body)
        body_end = self.at
        ends = [body_end]
        for h in s.handlers:
            self.at = self.node(self.node(before))
            self.block(h.body)
            ends.append(self.at)
        if s.orelse:
            self.at = self.node(body_end)
            self.block(s.orelse)
            ends.append(self.at)
        if s.finalbody:
            live = [e for e in ends if e != self.EXIT]
            self.at = self.node(*(live or [start]))
            self.block(s.finalbody)
            ends = [self.at]
        live = [e for e in ends if e != self.EXIT]
        if live:
            self.at = self.node(*live)
        else:
            self.at = self.EXIT


def extract_python(text: str) -> list[dict]:
    tree = ast.parse(text)
    lines = text.splitlines()
    for node in ast.walk(tree):
        if isinstance(node, ast.If) and len(node.orelse) == 1 and isinstance(node.orelse[0], ast.If):
            inner = node.orelse[0]
            inner._elif = lines[inner.lineno - 1][inner.col_offset :].startswith("elif") or lines[inner.lineno - 1].lstrip().startswith("elif")
    out = []
    for f in ast.walk(tree):
        if not isinstance(f, (ast.FunctionDef, ast.AsyncFunctionDef)):
            continue
        b = _Builder()
        b.block(f.body)
        inner = [n for s in f.body for n in ast.walk(s)]
        calls = sorted({ast.get_source_segment(text, n.func) or "" for n in inner if isinstance(n, ast.Call)})
        out.append({
            "function": f.name, "line": f.lineno, "end_line": f.end_lineno, "cc": b.complexity() + sum(map(_extras, f.body)), "nd": _depth(f.body), "fo": len(calls),
            "ns": sum(isinstance(n, EXITS) for n in inner), "loc": f.end_lineno - f.lineno + 1, "callees": calls,
        })
    return sorted(out, key=lambda x: x["line"])
