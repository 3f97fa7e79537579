"""The syntax tree that all parsers give, and its form as rows.

Node kinds are our own and the same for all languages, so that rules need no
table of grammars.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field


@dataclass
class Node:
    """``start`` and ``end`` are character offsets; rows of nodes carry bytes and lines."""

    kind: str
    start: int
    end: int
    name: str | None = None
    role: str | None = None
    children: list[Node] = field(default_factory=list)

    def add(self, child: Node | None, role: str | None = None) -> Node | None:
        if child is not None:
            child.role = role or child.role
            self.children.append(child)
            self.end = max(self.end, child.end)
        return child

    def walk(self) -> Iterator[Node]:
        todo = [self]
        while todo:
            node = todo.pop()
            yield node
            todo.extend(reversed(node.children))

    def first(self, *kinds: str) -> Node | None:
        return next((c for c in self.children if c.kind in kinds), None)

    def by_role(self, role: str) -> Node | None:
        return next((c for c in self.children if c.role == role), None)


class Places:
    """Byte offsets and lines of character offsets."""

    def __init__(self, text: str) -> None:
        self.ascii = text.isascii()
        self.bytes = None
        if not self.ascii:
            total, self.bytes = 0, [0]
            for c in text:
                total += len(c.encode("utf-8", "surrogatepass"))
                self.bytes.append(total)
        self.lines = [0]
        for i, c in enumerate(text):
            if c == "\n":
                self.lines.append(i + 1)

    def byte(self, at: int) -> int:
        return at if self.ascii else self.bytes[at]

    def row(self, at: int) -> int:
        import bisect

        return bisect.bisect_right(self.lines, at) - 1


#: Kinds whose text rows carry whole; others carry none, their text is their children's.
WITH_TEXT = {"comment", "string", "number", "ident", "field", "call", "macro", "type", "generic", "not", "let", "assign", "aug_assign", "use", "binary", "pattern", "parameter", "expr_stmt", "error"}


def rows(root: Node, text: str) -> Iterator[tuple]:
    """(pre, post, parent_pre, depth, kind, role, name, sib_idx, n_sibs, byte_start, byte_end, row_start, row_end, text) in order of pre.

    ``pre`` and ``post`` come from one counter, so that a node's numbers
    enclose those of what is below it.
    """
    places, counter, out = Places(text), 0, []
    todo: list[tuple] = [(root, None, 0, 0, 1, False)]
    opened: dict[int, int] = {}
    while todo:
        node, parent, depth, idx, n, closing = todo.pop()
        if closing:
            out[opened[id(node)]][1] = counter
            counter += 1
            continue
        pre, counter = counter, counter + 1
        opened[id(node)] = len(out)
        body = text[node.start : node.end] if node.kind in WITH_TEXT else None
        out.append([pre, None, parent, depth, node.kind, node.role, node.name, idx, n, places.byte(node.start), places.byte(node.end), places.row(node.start), places.row(max(node.start, node.end - 1)), body])
        todo.append((node, parent, depth, idx, n, True))
        for i in range(len(node.children) - 1, -1, -1):
            todo.append((node.children[i], pre, depth + 1, i, len(node.children), False))
    return map(tuple, out)


NODE_COLUMNS = "pre long, post long, parent_pre long, depth int, kind string, role string, name string, sib_idx int, n_sibs int, byte_start long, byte_end long, row_start long, row_end long, text string"


def errors(root: Node, text: str) -> list[tuple[int, int, str]]:
    """(row, byte, text of at most 120 bytes) of the parts that could not be read."""
    places = Places(text)
    return [(places.row(n.start), places.byte(n.start), text[n.start : n.end].encode()[:120].decode("utf-8", "ignore")) for n in root.walk() if n.kind == "error"]


def validate(root: Node, text: str) -> str | None:
    """None if the text could be read, else a message with the first three places."""
    found = errors(root, text)
    if not found:
        return None
    return f"{len(found)} syntax error(s): " + "; ".join(f"line {row + 1}: {body!r}" for row, _, body in found[:3])
