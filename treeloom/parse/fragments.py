"""Fragments: the named parts of a file, by language.

Every decomposer gives :class:`Fragment` trees in character offsets; rows of
them carry bytes, lines, nested names and documentation.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

from treeloom.parse import clike, python
from treeloom.parse.tree import Node, Places

MAX_DEPTH = 5
#: Kinds of fragments that structure a file but can't be visited.
STRUCTURAL = {"imports", "file_doc", "docstring", "decorator", "preamble"}


@dataclass
class Fragment:
    name: str
    kind: str
    start: int
    end: int
    name_at: int | None = None
    signature: str | None = None
    visibility: str | None = None
    doc: str | None = None
    level: int | None = None
    lang: str | None = None
    children: list[Fragment] = field(default_factory=list)


@dataclass(frozen=True)
class Language:
    """A decomposer and how its names are told apart."""

    name: str
    decompose: Callable[[str, int], list[Fragment]]
    numbered: bool = False
    tree: Callable[[str], Node] | None = None


#: Decomposers by extension; ``register`` adds more.
LANGUAGES: dict[str, Language] = {}


def register(language: Language, *exts: str) -> None:
    for ext in exts:
        LANGUAGES[ext] = language


def language_for(name: str) -> tuple[Language, str | None] | None:
    """The decomposer of a file name; for ``x.ext.j2`` the template's, with the inner extension."""
    parts = name.rsplit("/", 1)[-1].split(".")
    if len(parts) >= 3 and parts[-1] == "j2" and parts[-2] in LANGUAGES:
        return LANGUAGES["j2"], parts[-2]
    return (LANGUAGES[parts[-1]], None) if len(parts) >= 2 and parts[-1] in LANGUAGES else None


# --- languages with a tree ---

#: Node kinds that are symbols, and what they are called.
SYMBOLS = {
    "rust": {"function": "Function", "struct": "Struct", "enum": "Enum", "trait": "Trait", "impl": "Impl", "mod": "Module", "const": "Const", "static": "Static", "type_alias": "TypeAlias", "macro_def": "Macro"},
    "ts": {"function": "Function", "class": "Class", "interface": "Interface", "enum": "Enum", "type_alias": "TypeAlias", "let": "Variable", "mod": "Module", "field_def": "Field", "method_sig": "Function"},
    "py": {"function": "Function", "class": "Class", "type_alias": "TypeAlias", "assign": "Variable"},
}
DOCS = {"rust": re.compile(r"///|//!|/\*\*"), "ts": re.compile(r"/\*\*")}


def impl_label(node: Node) -> str:
    flat = lambda t: re.sub(r"[<>, ]", "", (t or "").replace("::", "_"))
    trait, type_ = node.by_role("trait"), node.by_role("type")
    return f"{flat(trait.name)}_for_{flat(type_.name)}" if trait is not None else flat(type_.name if type_ else "")


def clean_comment(text: str) -> str:
    lines = text.removeprefix("/**").removeprefix("/*").removesuffix("*/").split("\n")
    return "\n".join(re.sub(r"^\s*(?:///|//!|//|\*|#)? ?", "", x).rstrip() for x in lines).strip()


def python_doc(node: Node, text: str) -> str | None:
    body = node.by_role("body")
    first = next((c for c in (body.children if body else node.children) if c.kind != "comment"), None)
    if first is None or first.kind != "expr_stmt" or not first.children or first.children[0].kind != "string":
        return None
    raw = re.sub(r"^[A-Za-z]*(\"\"\"|'''|\"|')(.*)\1$", r"\2", text[first.start : first.end], flags=re.S)
    lines = raw.split("\n")
    indent = min((len(x) - len(x.lstrip()) for x in lines[1:] if x.strip()), default=0)
    return "\n".join([lines[0].strip(), *(x[indent:].rstrip() for x in lines[1:])]).strip()


def symbols(node: Node, text: str, lang: str, depth: int) -> list[Fragment]:
    out, table = [], SYMBOLS[lang]
    pending: list[Node] = []
    for child in node.children:
        if child.kind in ("comment", "attribute"):
            pending.append(child)
            continue
        kind = table.get(child.kind)
        name = impl_label(child) if child.kind == "impl" else child.name
        if lang == "py" and child.kind == "assign":
            left = child.by_role("left")
            name = left.name if left is not None and left.kind == "ident" else None
        if kind is None or not name:
            pending = []
            continue
        run, at = [], child.start
        for p in reversed(pending):
            if p.kind == "comment" and not (lang in DOCS and DOCS[lang].match(text, p.start)) or text.count("\n", p.end, at) > 1:
                break
            run.insert(0, p)
            at = p.start
        docs = [p for p in run if p.kind == "comment"]
        attributes = [p for p in [*run, *child.children] if p.kind == "attribute"]
        body = child.by_role("body")
        head_end = body.start if body is not None and child.kind != "assign" else child.end
        head = text[child.start : head_end] if lang != "py" else text[max([child.start, *(p.end for p in child.children if p.kind == "attribute")]) : head_end]
        signature = re.sub(r"\s+", " ", head.split("=", 1)[0] if child.kind in ("const", "static", "assign") else head).strip().rstrip("{:;").strip()
        vis = child.first("visibility")
        doc = python_doc(child, text) if lang == "py" else "\n".join(clean_comment(text[d.start : d.end]) for d in docs) or None
        at = text.find(name, child.start, child.end)
        made = Fragment(name, kind, child.start, child.end, at if at >= 0 else None, signature, vis.name if vis else None, doc)
        if docs:
            made.children.append(Fragment("docstring", "docstring", docs[0].start, docs[-1].end))
        elif doc and lang == "py":
            first = next(c for c in body.children if c.kind != "comment")
            made.children.append(Fragment("docstring", "docstring", first.start, first.end))
        if attributes:
            made.children.append(Fragment("decorators", "decorator", attributes[0].start, attributes[-1].end))
        if depth > 1 and body is not None and child.kind in ("impl", "trait", "mod", "class", "interface"):
            made.children += symbols(body, text, lang, depth - 1)
        out.append(made)
        pending = []
    return out


def whole_file(root: Node, text: str, lang: str, depth: int) -> list[Fragment]:
    """Symbols, the imports as one span, and the comment or docstring a file begins with; by start."""
    out = symbols(root, text, lang, depth)
    uses = [c for c in root.children if c.kind == "use"]
    if uses:
        out.append(Fragment("imports", "imports", uses[0].start, uses[-1].end))
    head = []
    for c in root.children:
        if c.kind != "comment" or lang == "rust" and not text.startswith("//!", c.start) or lang == "ts" and not text.startswith("/**", c.start):
            break
        head.append(c)
    if lang == "py" and (doc := python_doc(root, text)) is not None:
        first = next(c for c in root.children if c.kind != "comment")
        out.append(Fragment("file_doc", "file_doc", first.start, first.end, doc=doc))
    elif head and lang != "py":
        taken = {f.children[0].start for f in out if f.children and f.children[0].kind == "docstring"}
        head = [c for c in head if c.start not in taken]
        if head:
            out.append(Fragment("file_doc", "file_doc", head[0].start, head[-1].end, doc="\n".join(clean_comment(text[c.start : c.end]) for c in head)))
    return sorted(out, key=lambda f: f.start)


def with_tree(name: str, key: str, tree: Callable[[str], Node]) -> Language:
    return Language(name, lambda text, depth: whole_file(tree(text), text, key, depth), tree=tree)


# --- languages read by their lines and brackets ---


def toml(text: str, depth: int) -> list[Fragment]:
    """Tables, and what stands before the first as a preamble."""
    out, masked = [], re.sub(r"\"\"\".*?\"\"\"|'''.*?'''", lambda m: re.sub(r"[^\n]", " ", m[0]), text, flags=re.S)
    heads = list(re.finditer(r"^[ \t]*\[\[?[ \t]*([^\[\]\n]+?)[ \t]*\]\]?[ \t]*(?:#[^\n]*)?$", masked, re.M))
    first = heads[0].start() if heads else len(text)
    if text[:first].strip():
        out.append(Fragment("preamble", "preamble", 0, first))
    for i, h in enumerate(heads):
        end = heads[i + 1].start() if i + 1 < len(heads) else len(text)
        out.append(Fragment(h[1], "Module", h.start(), end, h.start(1), h[0].strip()))
    return out


def markdown(text: str, depth: int) -> list[Fragment]:
    """Nested sections, a preamble, and fenced blocks inside their innermost section."""
    heads, blocks, fence, at = [], [], None, 0
    for line in text.splitlines(True):
        mark = re.match(r" {0,3}(`{3,}|~{3,})[ \t]*([^ \t\n`{]*)", line)
        if fence:
            if mark and mark[1][0] == fence[0][0] and len(mark[1]) >= len(fence[0]) and not mark[2]:
                blocks.append((fence[2], at + len(line), fence[1]))
                fence = None
        elif mark:
            fence = (mark[1], mark[2] or None, at)
        elif h := re.match(r" {0,3}(#{1,6})(?:[ \t]+(.*?))?(?:[ \t]+#+)?[ \t]*$", line.rstrip("\n")):
            heads.append((at, len(h[1]), (h[2] or "").strip()))
        at += len(line)
    if fence:
        blocks.append((fence[2], len(text), fence[1]))
    top: list[Fragment] = []
    opened: list[Fragment] = []
    for i, (start, level, name) in enumerate(heads):
        end = next((s for s, other, _ in heads[i + 1 :] if other <= level), len(text))
        made = Fragment(name or "section", "section", start, end, start, "#" * level + " " + name, level=level)
        while opened and opened[-1].level >= level:
            opened.pop()
        (opened[-1].children if opened else top).append(made)
        opened.append(made)
    for start, end, lang in blocks:
        into = top
        while inner := next((f for f in into if f.kind == "section" and f.start <= start and end <= f.end), None):
            into = inner.children
        into.append(Fragment(lang or "txt", "code", start, end, lang=lang))
    first = heads[0][0] if heads else len(text)
    if text[:first].strip():
        top.insert(0, Fragment("preamble", "preamble", 0, first))
    todo = [top]
    while todo:
        siblings = todo.pop()
        siblings.sort(key=lambda f: f.start)
        todo += [f.children for f in siblings]
    return top


def masked(text: str, patterns: str) -> str:
    """``text`` with what matches made blank, at the same places."""
    return re.sub(patterns, lambda m: re.sub(r"[^\n]", " ", m[0]), text, flags=re.S)


def closing(text: str, at: int) -> int:
    """The place after the bracket that closes the one at ``at``."""
    depth = 0
    for i in range(at, len(text)):
        if text[i] in "([{":
            depth += 1
        elif text[i] in ")]}":
            depth -= 1
            if depth == 0:
                return i + 1
    return len(text)


def nix(text: str, depth: int) -> list[Fragment]:
    """Bindings; those whose value is a set are modules with bindings of their own."""
    bare = masked(text, r"#[^\n]*|/\*.*?\*/|\"(?:\\.|[^\"\\])*\"|''(?:''['$\\]|.)*?''")

    def bindings(begin: int, end: int, left: int) -> list[Fragment]:
        out, at = [], begin
        while at < end:
            m = re.compile(r"([A-Za-z_\"][\w\-'.\"]*)\s*=(?!=)").search(bare, at, end)
            if m is None:
                break
            stop, i = end, m.end()
            while i < end:
                if bare[i] in "([{":
                    i = closing(bare, i)
                    continue
                if bare[i] == ";":
                    stop = i + 1
                    break
                i += 1
            value = re.compile(r"\s*(?:rec\s*)?\{").match(bare, m.end(), stop)
            made = Fragment(text[m.start(1) : m.end(1)], "Variable", m.start(), stop, m.start(1), text[m.start() : m.end(1)])
            if value and closing(bare, value.end() - 1) >= stop - 1 - len(bare[:stop]) + len(bare[: stop - 1].rstrip()):
                made.kind = "Module"
                if left > 1:
                    made.children = bindings(value.end(), stop, left - 1)
            out.append(made)
            at = stop
        return out

    return bindings(0, len(bare), depth)


def fennel(text: str, depth: int) -> list[Fragment]:
    """Top-level forms that name something; what is bound to a ``require`` counts as an import."""
    bare = masked(text, r";[^\n]*|\"(?:\\.|[^\"\\])*\"")
    out, uses, at = [], [], 0
    while (at := next((i for i in range(at, len(bare)) if bare[i] == "("), -1)) >= 0:
        end = closing(bare, at)
        m = re.compile(r"\(\s*(fn|lambda|λ|local|var|global|macro|set)\s+([^\s()\[\]{}]+)").match(bare, at)
        if m:
            if m[1] in ("local", "var") and re.compile(r"\s*\(\s*require\b").match(bare, m.end()):
                uses.append((at, end))
            else:
                kind = "Macro" if m[1] == "macro" else "Function" if m[1] in ("fn", "lambda", "λ") else "Variable"
                out.append(Fragment(m[2], kind, at, end, m.start(2), " ".join(text[at:end].split("\n")[0].split())))
        elif re.compile(r"\(\s*local\s+\{[^}]*\}\s*\(\s*require\b").match(bare, at):
            uses.append((at, end))
        at = end
    if uses:
        out.append(Fragment("imports", "imports", uses[0][0], uses[-1][1]))
    return sorted(out, key=lambda f: f.start)


TAG = re.compile(r"\{%-?\s*(\w+)\s*([^%]*?)\s*-?%\}|\{#.*?#\}|\{\{.*?\}\}", re.S)


def jinja(text: str, depth: int) -> list[Fragment]:
    """Blocks, macros and assignments of a template; what it extends and imports is a preamble."""
    top: list[Fragment] = []
    stack: list[tuple[str, Fragment | None, list[Fragment]]] = []
    heads, here = [], top
    for m in TAG.finditer(text):
        word, rest = m[1], (m[2] or "").strip()
        if word is None:
            continue
        if word in ("extends", "import", "from", "include"):
            heads.append(m)
        elif word in ("block", "macro", "call", "filter", "for", "if", "raw", "with", "autoescape") or word == "set" and "=" not in rest:
            name = re.match(r"\w*", rest)[0]
            kind = {"block": "Module", "macro": "Function", "set": "Variable"}.get(word)
            made = Fragment(name, kind, m.start(), m.end(), m.start(2), m[0]) if kind else None
            stack.append((word, made, here))
            here = made.children if made else here
        elif word == "set":
            name = rest.split("=", 1)[0].strip()
            here.append(Fragment(name, "Variable", m.start(), m.end(), m.start(2), m[0]))
        elif word.startswith("end"):
            while stack:
                opened, made, outer = stack.pop()
                here = outer
                if made is not None and opened == word.removeprefix("end"):
                    made.end = m.end()
                    outer.append(made)
                if opened == word.removeprefix("end"):
                    break
    if heads:
        top.append(Fragment("preamble", "preamble", heads[0].start(), heads[-1].end()))
    return sorted(top, key=lambda f: f.start)


def content_regions(text: str) -> list[tuple[int, int]]:
    """The parts of a template between its tags."""
    out, at = [], 0
    for m in TAG.finditer(text):
        if m.start() > at:
            out.append((at, m.start()))
        at = m.end()
    if at < len(text):
        out.append((at, len(text)))
    return out


def injected(text: str, inner: Language, depth: int) -> list[Fragment]:
    """A template's own fragments and those of the language between its tags, at their places in the template."""
    regions, starts, total = content_regions(text), [], 0
    for a, b in regions:
        starts.append(total)
        total += b - a
    import bisect

    def real(at: int, last: bool) -> int:
        k = max(0, bisect.bisect_right(starts, at - last) - 1)
        return min(regions[k][0] + at - starts[k], regions[k][1]) if regions else 0

    def moved(f: Fragment) -> Fragment:
        k = max(0, bisect.bisect_right(starts, f.start) - 1)
        end = min(real(f.end, True), regions[k][1]) if f.kind not in ("section", "Module", "Class", "Impl") else real(f.end, True)
        return Fragment(f.name, f.kind, real(f.start, False), end, None if f.name_at is None else real(f.name_at, False), f.signature, f.visibility, f.doc, f.level, f.lang, [moved(c) for c in f.children])

    body = "".join(text[a:b] for a, b in regions)
    both = [*jinja(text, depth), *(moved(f) for f in inner.decompose(body, depth))]
    return sorted(both, key=lambda f: f.start)


register(with_tree("Rust", "rust", lambda t: clike.parse(t, "rust")), "rs")
register(with_tree("TypeScript", "ts", lambda t: clike.parse(t, "ts")), "ts", "tsx")
register(with_tree("Python", "py", python.parse), "py")
register(Language("TOML", toml, numbered=True), "toml")
register(Language("Markdown", markdown, numbered=True), "md", "mdx")
register(Language("Nix", nix), "nix")
register(Language("Fennel", fennel), "fnl")
register(Language("Jinja2", jinja), "j2")


# --- names and rows ---


def slug(text: str) -> str:
    s = re.sub(r"([A-Z]+)([A-Z][a-z])", r"\1-\2", re.sub(r"([a-z0-9])([A-Z])", r"\1-\2", text))
    return re.sub(r"[^A-Za-z0-9]+", "-", s).strip("-").lower()


def named(fragments: list[Fragment], numbered: bool) -> list[str | None]:
    """File-system names of siblings; clashes get their kind, or a number."""
    base: list[str | None] = []
    sections = blocks = 0
    for f in fragments:
        if f.kind == "code":
            blocks += 1
            base.append(f"{blocks}.{f.lang or 'txt'}")
        elif f.kind == "section":
            short = slug(f.name)
            short = short if len(short) <= 40 else re.sub(r"-[^-]*$", "", short[:40])
            base.append(f"{sections:02d}-{short or 'section'}")
            sections += 1
        elif f.kind in STRUCTURAL:
            base.append(None)
        else:
            base.append(slug(f.name) or None if numbered else f.name)
    out, seen = [], {}
    for f, name in zip(fragments, base, strict=True):
        if name is None or base.count(name) == 1:
            out.append(name)
            continue
        key = (name, None if numbered else f.kind)
        seen[key] = nth = seen.get(key, 0) + 1
        tail = "" if numbered else f"~{f.kind}"
        out.append(f"{name}{tail}" + (f"-{nth}" if nth > 1 else ""))
    return out


FRAGMENT_COLUMNS = (
    "frag_id long, parent_id long, depth int, ord int, name string, kind string, level int, code_lang string, byte_start long, byte_end long, full_start long, full_end long, name_off long, "
    "line_start long, line_end long, signature string, visibility string, doc string, parent_name string, fs_name string, fs_path array<string>"
)


def fragment_rows(fragments: list[Fragment], text: str, numbered: bool) -> Iterator[tuple]:
    """Flat rows in order; lines count from 0 and are half open."""
    places, out = Places(text), []

    def go(siblings: list[Fragment], parent: int | None, parent_name: str | None, depth: int, path: list[str]) -> None:
        for i, (f, fs_name) in enumerate(zip(siblings, named(siblings, numbered), strict=True)):
            here, nested = len(out), [*path, fs_name] if fs_name else path
            full = min([f.start, *(c.start for c in f.children)]), max([f.end, *(c.end for c in f.children)])
            out.append((
                here, parent, depth, i, f.name, f.kind, f.level, f.lang, places.byte(f.start), places.byte(f.end), places.byte(full[0]), places.byte(full[1]), None if f.name_at is None else places.byte(f.name_at),
                places.row(full[0]), places.row(f.end) + 1, f.signature, f.visibility, f.doc, parent_name, fs_name, nested if fs_name else None,
            ))
            go(f.children, here, f.name, depth + 1, nested)

    go(fragments, None, None, 0, [])
    return iter(out)


def decompose(path: str, text: str, depth: int = MAX_DEPTH) -> tuple[str, list[Fragment], bool] | None:
    """(language, fragments, whether names are numbered) of a file; None without a decomposer."""
    found = language_for(path)
    if found is None:
        return None
    language, inner = found
    if inner is not None:
        return language.name, injected(text, LANGUAGES[inner], depth), LANGUAGES[inner].numbered
    return language.name, language.decompose(text, depth), language.numbered
