"""Who answers a request: providers in order, routes over path segments, plugins and their scripts.

Providers, routes and plugins are Python objects of this process, a handful
each; requests are rows. A chain or a tree is compiled into one expression, so
that answering takes no join and no shuffle.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from treeloom.operators.graph import CycleError


@dataclass(frozen=True)
class Provider:
    """Answers the requests that ``accepts`` holds for; the terminal one comes last."""

    id: str
    accepts: Column
    answer: Column
    needs: tuple[str, ...] = ()
    priority: int = 0
    terminal: bool = False


def in_order(providers: Iterable[Provider]) -> list[Provider]:
    """By dependency depth, priority and id, terminal ones last; needs of unknown providers don't count."""
    known = {p.id: p for p in providers}
    regular = {i: [n for n in p.needs if n != i and n in known and not known[n].terminal] for i, p in known.items() if not p.terminal}
    depth: dict[str, int] = {}
    while len(depth) < len(regular):
        ready = [i for i, needs in regular.items() if i not in depth and all(n in depth for n in needs)]
        if not ready:
            raise CycleError(f"a circle of dependencies at {min(set(regular) - set(depth))}")
        depth.update({i: 1 + max((depth[n] for n in regular[i]), default=-1) for i in ready})
    return sorted(known.values(), key=lambda p: (p.terminal, depth.get(p.id, 0), 0 if p.terminal else p.priority, p.id))


def answered(providers: Iterable[Provider]) -> Column:
    """A struct (provider, answer) of the first provider in order that accepts the row; null if none does."""
    taken = [F.when(p.accepts, F.struct(F.lit(p.id).alias("provider"), p.answer.alias("answer"))) for p in in_order(providers)]
    return F.coalesce(*taken) if taken else F.lit(None)


@dataclass
class Route:
    """A level of a route tree: fixed folders, and the capture or rest that was declared first."""

    handler: str | None = None
    dirs: dict[str, Route] = field(default_factory=dict)
    open: tuple[str, bool, Route] | None = None

    def add(self, pattern: str, handler: str) -> Route:
        """Adds ``a/{name}/{rest..}``: a fixed folder, a captured segment, all that is left. Equal folders are merged."""
        at = self
        for part in [p for p in pattern.split("/") if p]:
            captured = re.fullmatch(r"\{(\w+)(\.\.)?\}", part)
            if captured is None:
                at = at.dirs.setdefault(part, Route())
                continue
            name, rest = captured[1], captured[2] is not None
            if at.open is None:
                at.open = (name, rest, Route())
            at = at.open[2] if at.open[:2] == (name, rest) else Route()  # what is declared later is never reached
        at.handler = at.handler or handler
        return self


def routed(tree: Route, segments: Column) -> Column:
    """A struct (handler, params) for an array of path segments; null if the tree passes the request on.

    A fixed folder goes before a capture, and what it lacks is not looked for
    elsewhere. A rest takes one or more segments, joined by slashes.
    """

    def here(node: Route, params: list[Column]) -> Column:
        made = F.map_from_entries(F.array(*params)) if params else F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
        row = F.struct(F.lit(node.handler).alias("handler"), made.alias("params"))
        return F.when(F.lit(node.handler is not None), row)

    def below(node: Route, depth: int, params: list[Column]) -> Column:
        head = F.get(segments, F.lit(depth))
        out = F.when(F.size(segments) <= depth, here(node, params))
        for name, child in node.dirs.items():
            out = out.when(head == name, below(child, depth + 1, params))
        if node.open is not None:
            name, rest, child = node.open
            value = F.array_join(F.slice(segments, depth + 1, F.greatest(F.size(segments) - depth, F.lit(0))), "/") if rest else head
            taken = [*params, F.struct(F.lit(name).alias("key"), value.alias("value"))]
            out = out.otherwise(here(child, taken) if rest else below(child, depth + 1, taken))
        return out

    return below(tree, 0, [])


Script = Callable[[bytes], bytes]


def script_address(address: Column) -> Column:
    """Whether an address is three parts between dots, none of them empty."""
    parts = F.split(address, r"\.")
    return (F.size(parts) == 3) & ~F.array_contains(parts, "")


@dataclass(frozen=True)
class Plugin:
    """What one plugin adds: providers, scripts and control commands by name, and settings under its id."""

    id: str
    providers: tuple[Provider, ...] = ()
    scripts: dict[str, Script] = field(default_factory=dict)
    commands: frozenset[str] = frozenset()
    config: dict = field(default_factory=dict)


@dataclass
class Active:
    """All plugins together. Of scripts with one address the last counts."""

    providers: list[Provider]
    scripts: dict[str, Script]
    commands: frozenset[str]
    config: dict[str, dict]


def activate(plugins: Iterable[Plugin]) -> Active:
    plugins = list(plugins)
    scripts = {f"provider.{p.id}.{name}": s for p in plugins for name, s in p.scripts.items()}
    wrong = [a for a in scripts if len(a.split(".")) != 3 or "" in a.split(".")]
    if wrong:
        raise ValueError(f"not an address of three parts: {wrong[0]}")
    return Active(
        in_order(p for plugin in plugins for p in plugin.providers), scripts,
        frozenset().union(*[p.commands for p in plugins]), {p.id: p.config for p in plugins},
    )


def run_scripts(active: Active, address: Column, given: Column) -> Column:
    """What the script at each row's address makes of its bytes; null for addresses without one. Arrow batches."""
    scripts = active.scripts

    @F.pandas_udf("binary")
    def run(addresses: pd.Series, inputs: pd.Series) -> pd.Series:
        return pd.Series([scripts[a](i if i is not None else b"") if a in scripts else None for a, i in zip(addresses, inputs, strict=True)], dtype=object)

    return run(address, given)


#: The requests that the server itself knows, and the one that passes on namespaces.
CORE_REQUESTS = ("Exec", "Register", "Unregister", "ListProcesses")
NAMESPACES = "GetNamespaceFds"
#: The fields a core request can't do without, and their JSON types.
REQUEST_FIELDS = {"Exec": {"address": "string", "stdin": "string"}, "Register": {"pid": "int", "command": "string"}, "Unregister": {"pid": "int"}, "ListProcesses": {}}


def control_request(line: Column, commands: Iterable[str]) -> Column:
    """A struct (kind, name, error) of a JSON line: ``namespaces``, ``core``, ``plugin`` or ``error``.

    A core request that lacks a field is looked up among the plugins' commands,
    as any other name is.
    """
    parsed = F.try_parse_json(line)
    name = F.try_variant_get(parsed, "$.type", "string")
    textual = F.schema_of_variant(F.try_variant_get(parsed, "$.type", "variant")) == "STRING"
    name = F.when(textual, name)
    row = lambda kind, error: F.struct(F.lit(kind).alias("kind"), name.alias("name"), error.alias("error"))
    none = F.lit(None).cast("string")
    out = F.when(parsed.isNull(), row("error", F.lit("not JSON"))).when(name == NAMESPACES, row("namespaces", none))
    for request, fields in REQUEST_FIELDS.items():
        whole = F.lit(True)
        for f, kind in fields.items():
            typed = F.schema_of_variant(F.try_variant_get(parsed, f"$.{f}", "variant")) == {"string": "STRING", "int": "BIGINT"}[kind]
            whole = whole & F.coalesce(typed, F.lit(False))
        out = out.when((name == request) & whole, row("core", none))
    named = sorted(commands)
    out = out.when(name.isNull(), row("error", F.lit('missing "type" field')))
    return out.when(name.isin(named) if named else F.lit(False), row("plugin", none)).otherwise(row("error", F.concat(F.lit("unknown command: "), name)))
