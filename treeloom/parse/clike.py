"""A tolerant parser for Rust and TypeScript.

One lexer and one recursive parser read both: items, statements, and
expressions by binding power. What can't be read becomes an ``error`` node, and
reading goes on after it. Macro arguments stay unread.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from treeloom.parse.tree import Node


@dataclass(frozen=True)
class Token:
    kind: str  # comment, string, number, ident, life, op, end
    text: str
    start: int
    end: int


OPERATORS = [
    "<<=", ">>=", "...", "..=", "===", "!==", "**=", "&&=", "||=", "??=", "=>", "->", "::", "&&", "||", "==", "!=", "<=", ">=", "+=", "-=", "*=", "/=", "%=", "^=",
    "&=", "|=", "..", "?.", "??", "**", "++", "--",
]
PARTS = {
    "rust": r"""(?P<comment>//[^\n]*)|(?P<block>/\*)|(?P<raw>b?r(?P<h>\#*)"(?:.|\n)*?"(?P=h))|(?P<string>b?"(?:\\(?:.|\n)|[^"\\])*"|b?'(?:\\(?:u\{[^}]*\}|x..|.)|[^'\\\n])')|(?P<life>'[A-Za-z_]\w*)""",
    "ts": r"""(?P<comment>//[^\n]*)|(?P<block>/\*)|(?P<raw>`)|(?P<string>"(?:\\(?:.|\n)|[^"\\\n])*"|'(?:\\(?:.|\n)|[^'\\\n])*')""",
}
REST = r"""|(?P<number>\d(?:[\w]|\.(?=\d))*(?:\.(?![.\w]))?)|(?P<ident>(?:r\#)?[A-Za-z_$\u0080-￿][\w$]*)|(?P<op>""" + "|".join(re.escape(o) for o in OPERATORS) + r"""|[^\s\w])|(?P<space>\s+)"""
LEXERS = {k: re.compile(v + REST) for k, v in PARTS.items()}
REGEX = re.compile(r"/(?:\\.|\[(?:\\.|[^\]\n\\])*\]|[^/\n\\\[])+/[a-z]*")
ENDS_VALUE = {")", "]", "}"}


def lex(text: str, lang: str) -> list[Token]:
    out, at, pattern = [], 0, LEXERS[lang]
    last: Token | None = None
    while at < len(text):
        if lang == "ts" and text[at] == "/" and text[at : at + 2] not in ("//", "/*"):
            value = last is not None and (last.kind in ("number", "string") or last.text in ENDS_VALUE or last.kind == "ident" and last.text not in ("return", "case", "typeof", "in", "of"))
            if not value and (m := REGEX.match(text, at)):
                last = Token("string", m[0], at, m.end())
                out.append(last)
                at = m.end()
                continue
        m = pattern.match(text, at)
        if m is None:
            at += 1
            continue
        kind, end = m.lastgroup, m.end()
        if kind == "block":
            depth, end = 1, at + 2
            while depth and end < len(text):
                if lang == "rust" and text.startswith("/*", end):
                    depth, end = depth + 1, end + 2
                elif text.startswith("*/", end):
                    depth, end = depth - 1, end + 2
                else:
                    end += 1
            kind = "comment"
        elif kind in ("raw", "h"):
            kind = "string"
            if lang == "ts":
                end, depth = at + 1, 0
                while end < len(text) and (depth or text[end] != "`"):
                    if text[end] == "\\":
                        end += 1
                    elif text.startswith("${", end):
                        depth, end = depth + 1, end + 1
                    elif text[end] == "}" and depth:
                        depth -= 1
                    end += 1
                end = min(end + 1, len(text))
        if kind != "space":
            token = Token(kind, text[at:end], at, end)
            out.append(token)
            if kind != "comment":
                last = token
        at = end
    return out


BINARY = {
    "=": (1, True), "+=": (1, True), "-=": (1, True), "*=": (1, True), "/=": (1, True), "%=": (1, True), "^=": (1, True), "&=": (1, True), "|=": (1, True), "<<=": (1, True), ">>=": (1, True),
    "**=": (1, True), "&&=": (1, True), "||=": (1, True), "??=": (1, True), "..": (3, False), "..=": (3, False), "||": (4, False), "??": (4, False), "&&": (5, False),
    "==": (6, False), "!=": (6, False), "===": (6, False), "!==": (6, False), "<": (7, False), ">": (7, False), "<=": (7, False), ">=": (7, False), "instanceof": (7, False), "in": (7, False),
    "|": (8, False), "^": (9, False), "&": (10, False), "+": (12, False), "-": (12, False), "*": (13, False), "/": (13, False), "%": (13, False), "**": (14, True),
}
EXITS = {"return", "break", "continue", "throw"}
RUST_ITEMS = {"fn", "struct", "enum", "trait", "impl", "mod", "const", "static", "type", "use", "union", "macro_rules", "extern"}
TS_ITEMS = {"function", "class", "interface", "enum", "type", "namespace", "module", "import", "export", "abstract", "declare", "async", "const", "let", "var"}


class Parser:
    def __init__(self, text: str, lang: str) -> None:
        self.text, self.rust = text, lang == "rust"
        every = lex(text, lang)
        self.tokens = [t for t in every if t.kind != "comment"] + [Token("end", "", len(text), len(text))]
        self.comments = [t for t in every if t.kind == "comment"]
        self.i = 0

    # --- tokens ---

    @property
    def t(self) -> Token:
        return self.tokens[self.i]

    def peek(self, n: int = 1) -> Token:
        return self.tokens[min(self.i + n, len(self.tokens) - 1)]

    def next(self) -> Token:
        t = self.t
        if t.kind != "end":
            self.i += 1
        return t

    def at(self, *texts: str) -> bool:
        return self.t.text in texts and self.t.kind in ("op", "ident")

    def eat(self, text: str) -> Token | None:
        return self.next() if self.at(text) else None

    def before(self) -> int:
        return self.tokens[self.i - 1].end if self.i else 0

    def bad(self, into: Node) -> None:
        t = self.next()
        into.add(Node("error", t.start, t.end))

    def need(self, text: str, into: Node) -> None:
        if not self.eat(text):
            into.add(Node("error", self.t.start, min(self.t.end, self.t.start + 1)))

    def balanced(self, into: Node | None = None) -> tuple[int, int]:
        """Skips a bracketed group; (start, end)."""
        start, depth = self.t.start, 0
        while self.t.kind != "end":
            t = self.next()
            if t.kind == "op" and t.text in "([{":
                depth += 1
            elif t.kind == "op" and t.text in ")]}":
                depth -= 1
                if depth == 0:
                    return start, t.end
        if into is not None:
            into.add(Node("error", start, self.before()))
        return start, self.before()

    # --- files and items ---

    def file(self) -> Node:
        root = Node("file", 0, len(self.text))
        while self.t.kind != "end":
            if self.at("}", ")", "]"):
                self.bad(root)
            else:
                self.statement(root)
        self.place_comments(root)
        return root

    def place_comments(self, root: Node) -> None:
        """Puts comments into the innermost node around them, in order."""
        for c in self.comments:
            node = root
            while True:
                inner = next((x for x in node.children if x.start <= c.start and c.end <= x.end and x.kind != "comment"), None)
                if inner is None:
                    break
                node = inner
            place = next((i for i, x in enumerate(node.children) if x.start > c.start), len(node.children))
            node.children.insert(place, Node("comment", c.start, c.end))

    def attributes(self) -> list[Node]:
        out = []
        while self.rust and self.at("#") and self.peek().text in ("[", "!"):
            start = self.next().start
            self.eat("!")
            out.append(Node("attribute", start, self.balanced()[1]))
        while not self.rust and self.at("@"):
            start = self.next().start
            self.next()
            while self.eat("."):
                self.next()
            end = self.balanced()[1] if self.at("(") else self.before()
            out.append(Node("attribute", start, end))
        return out

    def statement(self, into: Node) -> None:
        for a in self.attributes():
            into.add(a)
        if self.eat(";"):
            return
        before = self.i
        item = self.rust_item() if self.rust else self.ts_item()
        if item is None:
            item = self.simple_statement()
        if self.i == before:
            self.bad(into)
        else:
            into.add(item)

    def body_block(self, kind: str = "block") -> Node | None:
        if not self.at("{"):
            return None
        block = Node(kind, self.t.start, self.t.end)
        self.next()
        while not self.at("}") and self.t.kind != "end":
            self.statement(block)
        self.need("}", block)
        block.end = max(block.end, self.before())
        return block

    def visibility(self) -> tuple[int, str] | None:
        if self.at("pub"):
            t = self.next()
            if self.at("(") and self.peek().text in ("crate", "super", "self", "in"):
                return t.start, "pub" + self.text[slice(*self.balanced())]
            return t.start, "pub"
        return None

    def rust_item(self) -> Node | None:
        save, start = self.i, self.t.start
        vis = self.visibility()
        while (self.at("async", "unsafe", "const", "default") and self.peek().text in ("fn", "unsafe", "async", "extern", "impl", "trait")) or (self.at("extern") and self.peek().kind == "string" and self.peek(2).text == "fn"):
            self.next()
            if self.t.kind == "string":
                self.next()
        word = self.t.text if self.t.kind == "ident" else ""
        if word not in RUST_ITEMS or (word == "const" and self.peek().text == "{") or (word == "union" and self.peek(2).text not in ("{", "<")) or (word == "macro_rules" and self.peek().text != "!"):
            self.i = save
            return None
        self.next()
        node = Node({"fn": "function", "use": "use", "type": "type_alias", "extern": "use", "union": "struct", "macro_rules": "macro_def"}.get(word, word), start, self.before())
        if vis:
            node.add(Node("visibility", vis[0], vis[0] + len(vis[1]), vis[1]))
        if word == "use" or word == "extern":
            while not self.at(";") and self.t.kind != "end":
                self.balanced() if self.at("{") else self.next()
            self.eat(";")
        elif word == "fn":
            self.function(node)
        elif word == "impl":
            if self.at("<"):
                self.generics()
            first = self.type_()
            node.add(first, "type")
            if self.eat("for"):
                first.role = "trait"
                node.add(self.type_(), "type")
            self.where()
            node.add(self.body_block(), "body")
        elif word in ("const", "static"):
            self.eat("mut")
            node.name = self.next().text
            if self.eat(":"):
                node.add(self.type_(), "type")
            if self.eat("="):
                node.add(self.expression(), "value")
            self.eat(";")
        elif word == "macro_rules":
            self.eat("!")
            node.name = self.next().text
            if self.at("{", "(", "["):
                self.balanced(node)
            self.eat(";")
        else:
            node.name = self.next().text
            if self.at("<"):
                self.generics()
            if word == "type":
                if self.eat(":"):
                    self.type_()
                if self.eat("="):
                    node.add(self.type_(), "value")
                self.eat(";")
            else:
                if word == "trait" and self.eat(":"):
                    self.type_()
                self.where()
                if word in ("struct", "union", "enum"):
                    self.fields(node, word)
                else:
                    node.add(self.body_block(), "body") or self.eat(";")
        node.end = max(node.end, self.before())
        return node

    def generics(self) -> None:
        depth = 0
        while self.t.kind != "end":
            t = self.next()
            depth += {"<": 1, ">": -1, ">>=": -2, ">=": -1}.get(t.text, 0) if t.kind == "op" else 0
            if depth <= 0:
                return

    def where(self) -> None:
        if self.eat("where"):
            while not self.at("{", ";") and self.t.kind != "end":
                self.balanced() if self.at("(", "[") else self.next()

    def fields(self, node: Node, word: str) -> None:
        if self.at("("):
            group = Node("fields", self.t.start, self.t.end)
            self.next()
            while not self.at(")") and self.t.kind != "end":
                self.attributes()
                self.visibility()
                f = Node("field_def", self.t.start, self.t.end)
                f.add(self.type_(), "type")
                group.add(f)
                if not self.eat(","):
                    break
            self.need(")", group)
            node.add(group, "body")
            self.where()
            self.eat(";")
        elif self.at("{"):
            group = Node("fields", self.t.start, self.t.end)
            self.next()
            while not self.at("}") and self.t.kind != "end":
                self.attributes()
                vis = self.visibility()
                f = Node("variant" if word == "enum" else "field_def", vis[0] if vis else self.t.start, self.t.end, self.next().text)
                if word == "enum":
                    if self.at("(", "{"):
                        self.balanced(f)
                    if self.eat("="):
                        f.add(self.expression())
                elif self.eat(":"):
                    f.add(self.type_(), "type")
                f.end = self.before()
                group.add(f)
                if not self.eat(","):
                    break
            self.need("}", group)
            group.end = self.before()
            node.add(group, "body")
        else:
            self.eat(";")

    def function(self, node: Node, named: bool = True) -> None:
        if named and self.t.kind in ("ident", "string", "number"):
            node.name = self.next().text
        if self.at("<"):
            self.generics()
        self.parameters(node)
        if self.eat("->" if self.rust else ":"):
            node.add(self.type_(), "returns")
        self.where()
        node.add(self.body_block(), "body") or self.eat(";")

    def parameters(self, node: Node) -> None:
        if not self.at("("):
            return
        group = Node("parameters", self.t.start, self.t.end)
        self.next()
        while not self.at(")") and self.t.kind != "end":
            self.attributes()
            p = Node("parameter", self.t.start, self.t.end)
            while not self.at(",", ")", ":", "=") and self.t.kind != "end":
                t = self.t
                if t.text in ("{", "[", "("):
                    self.balanced(p)
                else:
                    self.next()
                    if t.kind == "ident" and t.text not in ("mut", "ref", "public", "private", "protected", "readonly"):
                        p.name = t.text
            if self.eat(":"):
                p.add(self.type_(), "type")
            if self.eat("="):
                p.add(self.expression(comma=False), "default")
            p.end = max(p.end, self.before())
            group.add(p)
            if not self.eat(","):
                break
        self.need(")", group)
        group.end = self.before()
        node.add(group, "parameters")

    def type_(self) -> Node:
        """A type: names, generic arguments and brackets, up to what can't belong to it."""
        node = Node("type", self.t.start, self.t.start)
        while self.t.kind != "end":
            t = self.t
            if t.text in (",", ";", ")", "]", "}", "=>", ">", ">=", ">>=") and t.kind == "op" or t.text == "=" and t.kind == "op":
                break
            if t.text == "{" and (self.rust or node.end > node.start and self.tokens[self.i - 1].text not in ("|", "&", ":", "=")):
                break
            if t.kind == "ident" and t.text in ("where", "for") and self.rust and not (t.text == "for" and self.peek().text == "<"):
                break
            if t.kind == "ident" and not self.rust and node.end > node.start and self.tokens[self.i - 1].kind == "ident" and self.tokens[self.i - 1].text not in ("keyof", "typeof", "readonly", "infer", "is", "extends", "asserts", "unique", "new") and t.text not in ("is", "extends", "in"):
                break
            if t.kind == "op" and t.text in "([{":
                inner = Node("group", t.start, t.end)
                self.next()
                while not self.at(")", "]", "}") and self.t.kind != "end":
                    before = self.i
                    inner.add(self.type_())
                    if self.at(",", ";", "=", "=>", ">"):
                        self.next()
                    elif self.i == before:
                        self.next()
                self.next()
                node.children += [c for x in inner.children for c in (x.children if x.kind == "type" else [x])]
                if not self.rust and self.at("=>"):
                    self.next()
            elif t.text == "<" and t.kind == "op":
                start = node.children[-1].start if node.children and node.children[-1].end == t.start else t.start
                generic = Node("generic", start, t.end, self.text[start : t.start])
                if node.children and node.children[-1].start == start:
                    node.children.pop()
                self.next()
                while not self.at(">", ">=", ">>=") and self.t.kind != "end":
                    before = self.i
                    generic.add(self.type_())
                    if self.at(",", "="):
                        self.next()
                    elif self.i == before:
                        self.next()
                if self.at(">"):
                    self.next()
                generic.end = self.before()
                generic.children = [c for x in generic.children for c in ((x.children or [x]) if x.kind == "type" else [x])]
                node.children.append(generic)
            else:
                self.next()
                if t.kind == "ident":
                    node.children.append(Node("type_name", t.start, t.end, t.text))
            node.end = self.before()
        node.name = self.text[node.start : node.end].strip()
        return node

    # --- TypeScript items ---

    def ts_item(self) -> Node | None:
        save, start, exported = self.i, self.t.start, False
        while self.at("export", "default", "declare", "abstract", "async") and (self.t.text != "async" or self.peek().text == "function"):
            if self.t.text in ("export",) and self.peek().text in ("{", "*", "="):
                break
            exported = exported or self.t.text == "export"
            self.next()
        word = self.t.text if self.t.kind == "ident" else ""
        kinds = {"function": "function", "class": "class", "interface": "interface", "enum": "enum", "type": "type_alias", "namespace": "mod", "module": "mod", "import": "use", "export": "use", "const": "let", "let": "let", "var": "let"}
        if word not in kinds or word in ("type", "namespace", "module") and self.peek().kind not in ("ident", "string") or word == "import" and self.peek().text in ("(", "."):
            if not exported:
                self.i = save
                return None
            node = Node("expr_stmt", start, self.before())
            node.add(self.expression())
            self.eat(";")
            return node
        self.next()
        if word == "const" and self.at("enum"):
            word = "enum"
            self.next()
        node = Node(kinds[word], start, self.before())
        if exported:
            node.add(Node("visibility", start, start + 6, "export"))
        if word in ("import", "export"):
            while not self.at(";") and self.t.kind != "end":
                t = self.t
                self.balanced() if self.at("{") else self.next()
                if t.kind == "string":
                    break
            self.eat(";")
        elif word == "function":
            self.eat("*")
            self.function(node)
        elif word in ("const", "let", "var"):
            self.declarators(node)
        elif word == "type":
            node.name = self.next().text
            if self.at("<"):
                self.generics()
            self.eat("=")
            node.add(self.type_(), "value")
            self.eat(";")
        elif word in ("namespace", "module"):
            node.name = self.next().text
            while self.eat("."):
                node.name += "." + self.next().text
            node.add(self.body_block(), "body")
        elif word == "enum":
            node.name = self.next().text
            group = Node("fields", self.t.start, self.t.end)
            self.next()
            while not self.at("}") and self.t.kind != "end":
                v = Node("variant", self.t.start, self.t.end, self.next().text)
                if self.eat("="):
                    v.add(self.expression(comma=False))
                group.add(v)
                if not self.eat(","):
                    break
            self.need("}", group)
            group.end = self.before()
            node.add(group, "body")
        else:
            if self.t.kind == "ident" and not self.at("extends"):
                node.name = self.next().text
            if self.at("<"):
                self.generics()
            while self.at("extends", "implements", ","):
                self.next()
                self.type_()
            node.add(self.members(word == "interface"), "body")
        node.end = max(node.end, self.before())
        return node

    def members(self, interface: bool) -> Node | None:
        if not self.at("{"):
            return None
        body = Node("class_body", self.t.start, self.t.end)
        self.next()
        while not self.at("}") and self.t.kind != "end":
            for a in self.attributes():
                body.add(a)
            if self.eat(";") or self.eat(","):
                continue
            start, before = self.t.start, self.i
            while self.at("public", "private", "protected", "static", "readonly", "abstract", "async", "override", "declare", "get", "set", "*", "accessor") and self.peek().text not in ("(", ":", "=", ";", "?", "!", "<"):
                self.next()
            member = Node("field_def", start, self.t.end)
            if self.at("["):
                self.balanced(member)
            elif self.at("#"):
                self.next()
                member.name = "#" + self.next().text
            else:
                member.name = self.next().text
            if self.at("?", "!"):
                self.next()
            if self.at("(", "<"):
                member.kind = "method_sig" if interface else "function"
                self.function(member, named=False)
            else:
                if self.eat(":"):
                    member.add(self.type_(), "type")
                if self.eat("="):
                    member.add(self.expression(), "value")
                self.eat(";")
            member.end = self.before()
            if self.i == before:
                self.bad(body)
            else:
                body.add(member)
        self.need("}", body)
        body.end = self.before()
        return body

    def declarators(self, node: Node) -> None:
        while self.t.kind != "end":
            if self.at("{", "["):
                start, end = self.balanced(node)
                node.add(Node("pattern", start, end))
            else:
                t = self.next()
                node.name = node.name or t.text
                node.add(Node("ident", t.start, t.end, t.text), "name")
            self.eat("!")
            if self.eat(":"):
                node.add(self.type_(), "type")
            if self.eat("="):
                node.add(self.expression(comma=False), "value")
            if not self.eat(","):
                break
        self.eat(";")

    # --- statements ---

    def simple_statement(self) -> Node:
        start, word = self.t.start, self.t.text if self.t.kind == "ident" else ""
        if self.rust and word == "let":
            node = self.let()
            if self.eat("else"):
                node.add(self.body_block(), "alternative")
            self.eat(";")
            node.end = self.before()
            return node
        if not self.rust:
            if word in ("if", "for", "while", "do", "switch", "try"):
                return self.control()
            if word in ("case", "default"):
                return Node("error", start, self.next().end)
        node = Node("expr_stmt", start, start)
        value = self.expression()
        node.add(value)
        ended = self.eat(";")
        node.end = max(self.before(), value.end if value else start)
        if value is not None and (not ended and self.rust or value.kind in ("if", "match", "for", "while", "loop", "block") or value.kind == "exit"):
            return value
        return node

    def let(self) -> Node:
        node = Node("let", self.t.start, self.t.end)
        self.next()
        node.name = self.peek().text if self.at("mut", "ref") else self.t.text if self.t.kind == "ident" else None
        node.add(self.pattern(":", "=", ";"), "pattern")
        if self.eat(":"):
            node.add(self.type_(), "type")
        if self.eat("="):
            node.add(self.expression(struct=False) if node.role == "condition" else self.expression(), "value")
        node.end = self.before()
        return node

    def pattern(self, *stops: str) -> Node:
        node = Node("pattern", self.t.start, self.t.start)
        while self.t.kind != "end" and not self.at(*stops):
            if self.at("(", "[", "{"):
                self.balanced(node)
            elif self.at(")", "]", "}"):
                break
            else:
                t = self.next()
                if t.kind == "string":
                    node.add(Node("string", t.start, t.end))
            node.end = self.before()
        return node

    def condition(self) -> Node | None:
        if not self.rust:
            self.eat("(")
            c = self.expression()
            self.eat(")")
            return c
        if self.at("let"):
            node = Node("let", self.t.start, self.t.end)
            self.next()
            node.name = self.peek().text if self.at("mut", "ref") else self.t.text if self.t.kind == "ident" else None
            node.add(self.pattern("="), "pattern")
            self.eat("=")
            node.add(self.expression(struct=False, least=6), "value")
            while self.at("&&", "||"):
                self.next()
                node.add(self.condition())
            return node
        return self.expression(struct=False)

    def one(self) -> Node | None:
        """A block, or a single statement as one."""
        if self.at("{"):
            return self.body_block()
        holder = Node("block", self.t.start, self.t.start)
        self.statement(holder)
        return holder

    def control(self) -> Node:
        t = self.next()
        node = Node(t.text, t.start, t.end)
        if t.text == "if":
            node.add(self.condition(), "condition")
            node.add(self.one(), "consequence")
            if self.eat("else"):
                node.add(self.control() if self.at("if") else self.one(), "alternative")
        elif t.text == "while":
            node.add(self.condition(), "condition")
            node.add(self.one(), "body")
        elif t.text == "loop":
            node.add(self.body_block(), "body")
        elif t.text == "do":
            node.kind = "while"
            node.add(self.one(), "body")
            if self.eat("while"):
                node.add(self.condition(), "condition")
            self.eat(";")
        elif t.text == "for" and self.rust:
            node.add(self.pattern("in"), "pattern")
            self.eat("in")
            node.add(self.expression(struct=False), "value")
            node.add(self.body_block(), "body")
        elif t.text == "for":
            self.eat("await")
            self.eat("(")
            if self.at("const", "let", "var"):
                self.next()
                node.add(self.pattern("=", "of", "in", ")", ";"), "pattern")
                if self.eat("="):
                    node.add(self.expression(), "value")
            elif not self.at(";"):
                node.add(self.expression(), "value")
            if self.at("of", "in"):
                self.next()
                node.add(self.expression(), "value")
            else:
                while self.eat(";"):
                    if not self.at(";", ")"):
                        node.add(self.expression())
            self.need(")", node)
            node.add(self.one(), "body")
        elif t.text in ("match", "switch"):
            node.kind = "match"
            node.add(self.expression(struct=False) if self.rust else self.condition(), "value")
            node.add(self.arms(), "body")
        elif t.text == "try":
            node.add(self.body_block(), "body")
            if self.at("catch"):
                c = Node("catch", self.next().start, self.before())
                if self.at("("):
                    self.balanced(c)
                c.add(self.body_block(), "body")
                node.add(c)
            if self.eat("finally"):
                node.add(self.body_block(), "finally")
        node.end = max(node.end, self.before())
        return node

    def arms(self) -> Node:
        block = Node("arms", self.t.start, self.t.end)
        self.need("{", block)
        while not self.at("}") and self.t.kind != "end":
            self.attributes()
            before = self.i
            arm = Node("arm", self.t.start, self.t.end)
            if self.rust:
                arm.add(self.pattern("=>", "if"), "pattern")
                if self.eat("if"):
                    arm.add(self.condition(), "guard")
                self.need("=>", arm)
                arm.add(self.expression(), "value")
                self.eat(",")
            else:
                default = self.at("default")
                self.next()
                if not default:
                    arm.add(self.expression(), "pattern")
                self.need(":", arm)
                while not self.at("case", "default", "}") and self.t.kind != "end":
                    self.statement(arm)
            arm.end = max(arm.end, self.before())
            if self.i == before:
                self.bad(block)
            else:
                block.add(arm)
        self.need("}", block)
        block.end = self.before()
        return block

    # --- expressions ---

    def expression(self, struct: bool = True, comma: bool = True, least: int = 0) -> Node | None:
        left = self.unary(struct, comma)
        while left is not None:
            t = self.t
            op = t.text
            if self.rust and op == "as" or not self.rust and op in ("as", "satisfies"):
                self.next()
                left = self.wrap("cast", left)
                left.add(self.cast_type())
                continue
            if op == ">" and self.peek().text == ">" and self.peek().start == t.end and least <= 11 and t.kind == "op":
                self.next()
                self.next()
                left = self.wrap("binary", left, ">>")
                left.add(self.expression(struct, comma, 12), "right")
                continue
            if not self.rust and op == "?" and t.kind == "op" and least <= 2:
                self.next()
                left = self.wrap("ternary", left)
                left.add(self.expression(struct, False))
                self.need(":", left)
                left.add(self.expression(struct, False))
                continue
            if op not in BINARY or t.kind == "string" or BINARY[op][0] < least or op in ("in", "instanceof") and self.rust:
                break
            power, right = BINARY[op]
            self.next()
            kind = "assign" if op == "=" else "aug_assign" if power == 1 else "range" if op in ("..", "..=") else "binary"
            left = self.wrap(kind, left, op)
            if kind == "range" and (self.at(")", "]", "}", ",", ";", "{") or self.t.kind == "end"):
                continue
            left.children[0].role = "left"
            left.add(self.expression(struct, comma, power if right else power + 1), "right")
        return left

    def wrap(self, kind: str, inner: Node, name: str | None = None) -> Node:
        node = Node(kind, inner.start, self.before(), name)
        node.add(inner, inner.role)
        inner.role = None
        return node

    def cast_type(self) -> Node:
        node = Node("type", self.t.start, self.t.end)
        while self.at("&", "*", "mut", "const", "dyn", "keyof", "typeof"):
            self.next()
        if self.at("(", "[", "{"):
            self.balanced(node)
        else:
            self.next()
            while self.at("::", "."):
                self.next()
                self.next()
        if self.at("<") and self.rust:
            self.generics()
        while self.at("[") and not self.rust and self.peek().text == "]":
            self.next()
            self.next()
        node.end = self.before()
        return node

    def unary(self, struct: bool, comma: bool) -> Node | None:
        t = self.t
        if t.kind == "op" and t.text == "!":
            self.next()
            node = Node("not", t.start, t.end)
            node.add(self.unary(struct, comma), "argument")
            return node
        if t.kind == "op" and t.text in ("-", "+", "*", "**", "&", "&&", "~", "++", "--", "...") or t.kind == "ident" and not self.rust and t.text in ("typeof", "void", "delete", "await", "new", "yield"):
            self.next()
            self.eat("mut") if self.rust else None
            node = Node("await" if t.text == "await" else "unary", t.start, t.end, t.text)
            node.add(self.unary(struct, comma), "argument")
            return node
        if t.kind == "op" and t.text in ("..", "..="):
            self.next()
            node = Node("range", t.start, t.end)
            if not self.at(")", "]", "}", ",", ";"):
                node.add(self.expression(struct, comma, 4))
            return node
        return self.postfix(self.primary(struct), struct)

    def postfix(self, node: Node | None, struct: bool) -> Node | None:
        while node is not None:
            t = self.t
            if t.kind != "op":
                break
            if t.text in (".", "?.") and self.peek().kind in ("ident", "number", "op"):
                self.next()
                if self.at("(", "["):
                    continue
                self.eat("#")
                member = self.next()
                node = self.wrap("field", node, member.text)
                node.children[0].role = "object"
                if self.at("::"):
                    self.next()
                    self.generics()
            elif t.text == "(":
                node = self.wrap("call", node, node.name)
                node.children[0].role = "function"
                self.arguments(node, ")")
            elif t.text == "[":
                node = self.wrap("index", node)
                node.children[0].role = "object"
                self.arguments(node, "]")
            elif t.text == "?" and self.rust:
                self.next()
                node = self.wrap("try_op", node)
            elif t.text == "!" and not self.rust and self.peek().text not in ("=",) and "\n" not in self.text[self.before() : t.start]:
                self.next()
                node.end = self.before()
            elif t.text in ("++", "--") and not self.rust:
                self.next()
                node = self.wrap("unary", node, t.text)
            elif t.text == "<" and not self.rust and self.call_generics():
                continue
            else:
                break
        if node is not None and not self.rust and self.t.kind == "string" and self.t.text[0] == "`":
            t = self.next()
            node = self.wrap("call", node, node.name)
            node.add(Node("string", t.start, t.end))
        return node

    def call_generics(self) -> bool:
        """Skips ``<...>`` before a call, if that is what it is."""
        save = self.i
        self.generics()
        if self.at("(") and self.i - save < 40:
            return True
        self.i = save
        return False

    def arguments(self, node: Node, close: str) -> None:
        group = Node("arguments", self.t.start, self.t.end)
        self.next()
        while not self.at(close) and self.t.kind != "end":
            before = self.i
            self.attributes() if self.rust else None
            group.add(self.expression(comma=False))
            if self.rust and self.eat(";"):
                continue
            if not self.eat(",") and self.i == before:
                self.bad(group)
        self.need(close, group)
        group.end = self.before()
        node.add(group, "arguments")

    def primary(self, struct: bool) -> Node | None:
        t = self.t
        if t.kind in ("number", "string"):
            self.next()
            return Node(t.kind, t.start, t.end)
        if t.kind == "life":
            self.next()
            self.eat(":")
            return self.primary(struct) if self.at("loop", "while", "for", "{") else Node("ident", t.start, t.end, t.text)
        if t.kind == "op":
            if t.text == "(":
                if not self.rust and self.arrow():
                    return self.closure()
                node = Node("paren", t.start, t.end)
                self.arguments(node, ")")
                node.children = node.children[0].children
                node.end = self.before()
                return node
            if t.text == "[":
                node = Node("array", t.start, t.end)
                self.arguments(node, "]")
                return node
            if t.text == "{":
                return self.body_block() if self.rust else self.object()
            if t.text in ("|", "||") and self.rust:
                return self.closure()
            if t.text == "<" and self.rust:
                self.generics()
                node = Node("ident", t.start, self.before(), "")
                return self.path(node)
            if t.text == "#" and self.rust:
                self.attributes()
                return self.unary(struct, True)
            if t.text == "<" and not self.rust:
                start = t.start
                self.generics()
                return self.unary(struct, True) or Node("error", start, self.before())
            return None
        if t.kind != "ident":
            return None
        word = t.text
        if self.rust:
            if word in ("if", "match", "while", "for", "loop"):
                return self.control()
            if word in ("unsafe", "async", "const") and self.peek().text in ("{", "move"):
                self.next()
                self.eat("move")
                return self.closure() if self.at("|", "||") else self.body_block()
            if word == "move" or word == "async" and self.peek().text in ("|", "||"):
                self.next()
                self.eat("move")
                return self.closure()
            if word == "let":
                return self.condition()
        else:
            if word == "function" or word == "async" and self.peek().text == "function":
                self.eat("async")
                node = Node("function", t.start, self.next().end)
                self.eat("*")
                self.function(node)
                node.end = self.before()
                return node
            if word == "class":
                node = Node("class", t.start, self.next().end)
                if self.t.kind == "ident" and not self.at("extends"):
                    node.name = self.next().text
                while self.at("extends", "implements", ","):
                    self.next()
                    self.type_()
                node.add(self.members(False), "body")
                return node
            if self.peek().text == "=>" or word == "async" and (self.peek(2).text == "=>" or self.peek().text == "("):
                if word != "async" or self.peek().text == "=>" or self.peek(2).text == "=>" or self.arrow(1):
                    return self.closure()
        if word in EXITS:
            self.next()
            node = Node("exit", t.start, t.end, word)
            if self.t.kind == "life":
                self.next()
            if not self.at(";", "}", ",", ")") and self.t.kind != "end" and (self.rust or "\n" not in self.text[t.end : self.t.start]):
                node.add(self.expression(struct), "value")
            if not self.rust:
                self.eat(";")
            node.end = max(node.end, self.before())
            return node
        if word in ("else", "case", "in", "of") and not (not self.rust and word == "of"):
            return None
        self.next()
        node = Node("ident", t.start, t.end, word)
        if self.rust:
            node = self.path(node)
            if self.at("!") and self.peek().text in ("(", "[", "{"):
                self.next()
                macro = Node("macro", node.start, self.balanced()[1], node.name)
                return macro
            if struct and self.at("{") and self.literal():
                return self.struct_literal(node)
        return node

    def path(self, node: Node) -> Node:
        while self.at("::"):
            self.next()
            if self.at("<"):
                self.generics()
            else:
                t = self.next()
                node.name = f"{node.name}::{t.text}"
            node.end = self.before()
        return node

    def literal(self) -> bool:
        """Whether the brace ahead opens a struct literal."""
        a, b = self.peek(), self.peek(2)
        return a.text == "}" or a.text == ".." or a.text == "#" or a.kind in ("ident", "number") and b.text in (":", ",", "}") and not (b.text == "}" and not self.tokens[self.i - 1].text[:1].isupper())

    def struct_literal(self, name: Node) -> Node:
        node = Node("struct_literal", name.start, self.t.end, name.name)
        self.next()
        while not self.at("}") and self.t.kind != "end":
            self.attributes()
            before = self.i
            if self.eat(".."):
                node.add(self.expression())
            else:
                t = self.next()
                if self.eat(":"):
                    node.add(self.expression())
                else:
                    node.add(Node("ident", t.start, t.end, t.text))
            if not self.eat(",") and self.i == before:
                self.bad(node)
        self.need("}", node)
        node.end = self.before()
        return node

    def object(self) -> Node:
        node = Node("object", self.t.start, self.t.end)
        self.next()
        while not self.at("}") and self.t.kind != "end":
            before = self.i
            if self.eat("..."):
                node.add(self.expression(comma=False))
            else:
                start = self.t.start
                while self.at("get", "set", "async", "*") and self.peek().text not in (":", ",", "}", "("):
                    self.next()
                name = self.t
                self.balanced(node) if self.at("[") else self.next()
                if self.at("(", "<"):
                    f = Node("function", start, name.end, name.text)
                    self.function(f, named=False)
                    f.end = self.before()
                    node.add(f)
                elif self.eat(":"):
                    node.add(self.expression(comma=False))
                elif self.eat("="):
                    node.add(self.expression(comma=False))
                else:
                    node.add(Node("ident", name.start, name.end, name.text))
            if not self.eat(",") and self.i == before:
                self.bad(node)
        self.need("}", node)
        node.end = self.before()
        return node

    def arrow(self, ahead: int = 0) -> bool:
        """Whether the bracket ahead holds the parameters of an arrow function."""
        save = self.i
        self.i += ahead
        self.balanced()
        found = self.at("=>")
        if not found and self.at(":"):
            depth, j = 0, self.i + 1
            while j < len(self.tokens) - 1 and j < self.i + 60:
                text = self.tokens[j].text
                depth += (text in ("(", "[", "{", "<")) - (text in (")", "]", "}", ">"))
                if text == "=>" and depth <= 0:
                    found = True
                    break
                if depth < 0 or depth == 0 and text in (";", ",", "?"):
                    break
                j += 1
        self.i = save
        return found

    def closure(self) -> Node:
        node = Node("closure", self.t.start, self.t.end)
        if self.rust:
            group = Node("parameters", self.t.start, self.t.end)
            if not self.eat("||"):
                self.next()
                while not self.at("|") and self.t.kind != "end":
                    p = Node("parameter", self.t.start, self.t.end, self.t.text)
                    p.end = self.pattern(",", "|", ":").end
                    if self.eat(":"):
                        kind = Node("type", self.t.start, self.t.end)
                        while not self.at(",", "|") and self.t.kind != "end":
                            self.generics() if self.at("<") else self.balanced() if self.at("(", "[") else self.next()
                        kind.end, kind.name = self.before(), self.text[kind.start : self.before()]
                        p.add(kind, "type")
                    group.add(p)
                    if not self.eat(","):
                        break
                self.eat("|")
            group.end = self.before()
            node.add(group, "parameters")
            if self.eat("->"):
                self.type_()
            node.add(self.expression(), "body")
        else:
            self.eat("async")
            if self.at("("):
                self.parameters(node)
                if self.eat(":"):
                    node.add(self.type_(), "returns")
            else:
                t = self.next()
                group = Node("parameters", t.start, t.end)
                group.add(Node("parameter", t.start, t.end, t.text))
                node.add(group, "parameters")
            self.need("=>", node)
            node.add(self.body_block() if self.at("{") else self.expression(comma=False), "body")
        node.end = self.before()
        return node


def parse(text: str, lang: str) -> Node:
    """The tree of a Rust (``rust``) or TypeScript (``ts``) text."""
    return Parser(text, lang).file()
