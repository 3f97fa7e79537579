"""Python's own parser, in the common tree."""

from __future__ import annotations

import ast
import io
import tokenize

from treeloom.parse.tree import Node

#: Python's node classes and our kinds.
KINDS = {
    "FunctionDef": "function", "AsyncFunctionDef": "function", "Lambda": "closure", "ClassDef": "class", "If": "if", "IfExp": "ternary", "For": "for", "AsyncFor": "for", "While": "while",
    "Match": "match", "match_case": "arm", "Try": "try", "TryStar": "try", "ExceptHandler": "catch", "Return": "exit", "Raise": "exit", "Break": "exit", "Continue": "exit", "Assign": "assign",
    "AnnAssign": "assign", "AugAssign": "aug_assign", "Expr": "expr_stmt", "Call": "call", "Attribute": "field", "Subscript": "index", "BinOp": "binary", "BoolOp": "binary", "Compare": "binary",
    "Name": "ident", "Import": "use", "ImportFrom": "use", "TypeAlias": "type_alias", "With": "with", "AsyncWith": "with", "Await": "await", "arg": "parameter",
}
ROLES = {"body": "body", "orelse": "alternative", "test": "condition", "func": "function", "left": "left", "right": "right", "target": "left", "value": "value", "iter": "value", "pattern": "pattern", "operand": "argument", "annotation": "type", "subject": "value"}


class Builder:
    def __init__(self, text: str) -> None:
        self.text = text
        self.starts = [0]
        for line in text.split("\n"):
            self.starts.append(self.starts[-1] + len(line) + 1)
        self.lines = text.split("\n")

    def place(self, line: int, byte: int) -> int:
        body = self.lines[line - 1] if line <= len(self.lines) else ""
        return self.starts[line - 1] + (byte if body.isascii() else len(body.encode()[:byte].decode("utf-8", "ignore")))

    def span(self, node: ast.AST) -> tuple[int, int] | None:
        if not hasattr(node, "lineno") or node.end_lineno is None:
            return None
        return self.place(node.lineno, node.col_offset), self.place(node.end_lineno, node.end_col_offset)

    def build(self, tree: ast.Module) -> Node:
        root = Node("file", 0, len(self.text))
        for child in tree.body:
            root.add(self.node(child))
        root.end = len(self.text)
        return root

    def group(self, kind: str, parts: list[ast.AST], role: str) -> Node | None:
        made = [n for p in parts if (n := self.node(p)) is not None]
        if not made:
            return None
        out = Node(kind, min(n.start for n in made), max(n.end for n in made), role=role)
        out.children = made
        return out

    def node(self, a: ast.AST) -> Node | None:
        name = type(a).__name__
        if isinstance(a, ast.match_case):
            body = self.group("block", a.body, "value")
            pattern = self.node(a.pattern)
            out = Node("arm", pattern.start if pattern else body.start, body.end)
            out.add(pattern, "pattern")
            out.add(self.node(a.guard) if a.guard else None, "guard")
            out.add(body, "value")
            return out
        span = self.span(a)
        if span is None:
            return None
        start, end = span
        if isinstance(a, ast.Constant):
            kind = "string" if isinstance(a.value, (str, bytes)) else "number" if isinstance(a.value, (int, float, complex)) and not isinstance(a.value, bool) else "literal"
            return Node(kind, start, end)
        if isinstance(a, ast.JoinedStr):
            return Node("string", start, end)
        kind = KINDS.get(name, "not" if isinstance(a, ast.UnaryOp) and isinstance(a.op, ast.Not) else "unary" if isinstance(a, ast.UnaryOp) else "pattern" if name.startswith("Match") else "expr")
        label = getattr(a, "name", None) or getattr(a, "id", None) or getattr(a, "attr", None) or getattr(a, "arg", None)
        out = Node(kind, start, end, label if isinstance(label, str) else name.lower() if kind == "exit" else None)
        if isinstance(a, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
            for d in a.decorator_list:
                if (s := self.span(d)) is not None:
                    out.children.append(Node("attribute", self.text.rfind("@", 0, s[0]), s[1]))
        if isinstance(a, (ast.FunctionDef, ast.AsyncFunctionDef, ast.Lambda)):
            args = a.args
            every = [*args.posonlyargs, *args.args, *([args.vararg] if args.vararg else []), *args.kwonlyargs, *([args.kwarg] if args.kwarg else [])]
            out.add(self.group("parameters", every, "parameters"))
            if isinstance(a, ast.Lambda):
                out.add(self.node(a.body), "body")
                return out
            if a.returns is not None and (s := self.span(a.returns)):
                out.children.append(Node("type", *s, self.text[slice(*s)], "returns"))
            out.add(self.group("block", a.body, "body"))
            return out
        if isinstance(a, ast.arg):
            if a.annotation is not None and (s := self.span(a.annotation)):
                out.children.append(self.type_(a.annotation))
            return out
        if isinstance(a, ast.ClassDef):
            out.add(self.group("class_body", a.body, "body"))
            return out
        for key, value in ast.iter_fields(a):
            if isinstance(value, list) and value and isinstance(value[0], ast.AST):
                role = ROLES.get(key, key)
                if key == "cases":
                    out.add(self.group("arms", value, "body"))
                elif isinstance(a, ast.If) and key == "orelse" and len(value) == 1 and isinstance(value[0], ast.If):
                    out.add(self.node(value[0]), "alternative")
                elif key in ("body", "orelse", "finalbody"):
                    out.add(self.group("block", value, "consequence" if isinstance(a, ast.If) and key == "body" else role))
                else:
                    for v in value:
                        out.add(self.node(v), "left" if key == "targets" else role)
            elif isinstance(value, ast.AST):
                if key == "annotation":
                    out.children.append(self.type_(value))
                else:
                    role = ROLES.get(key, key)
                    out.add(self.node(value), "right" if isinstance(a, (ast.Assign, ast.AnnAssign, ast.AugAssign)) and key == "value" else "object" if key == "value" and isinstance(a, (ast.Attribute, ast.Subscript)) else role)
        out.end = max(end, out.start)
        return out

    def type_(self, a: ast.AST) -> Node:
        s = self.span(a)
        return Node("type", *s, self.text[slice(*s)], "type")


def parse(text: str) -> Node:
    """The tree of a Python text; one ``error`` node if it has a syntax error."""
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError) as e:
        root = Node("file", 0, len(text))
        builder = Builder(text)
        line = min(max(getattr(e, "lineno", 1) or 1, 1), len(builder.lines))
        start = builder.starts[line - 1]
        root.children.append(Node("error", start, start + len(builder.lines[line - 1])))
        return root
    builder = Builder(text)
    root = builder.build(tree)
    comments = []
    try:
        for t in tokenize.generate_tokens(io.StringIO(text).readline):
            if t.type == tokenize.COMMENT:
                comments.append((builder.starts[t.start[0] - 1] + t.start[1], builder.starts[t.end[0] - 1] + t.end[1]))
    except (tokenize.TokenError, IndentationError):
        pass
    for start, end in comments:
        node = root
        while inner := next((x for x in node.children if x.start <= start and end <= x.end and x.kind != "comment"), None):
            node = inner
        node.children.insert(next((i for i, x in enumerate(node.children) if x.start > start), len(node.children)), Node("comment", start, end))
    return root
