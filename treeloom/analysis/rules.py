"""Thirty rules over syntax trees, each a function from nodes to findings.

``nodes`` are rows of :func:`treeloom.parse.tables.nodes`. Rules see them only
by file, so everything shuffles by path, once; the shuffled nodes are settled
before the rules read them, so no file is parsed twice. Counts over children and
ancestors are grouped counts and running sums; rules that look for a name
elsewhere join on path and name.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from treeloom.functions import text
from treeloom.operators import graph, intervals, sequences

#: Limits of the rules.
NESTING, GENERICS, METHODS_REQUIRED, FIELDS, CLOSURE_LINES, ARMS, PARAMETERS, LOCALS, METHODS, RUN, STRING_ARMS, ELSE_IFS = 3, 3, 8, 10, 15, 8, 5, 10, 15, 3, 3, 3
#: Kinds that nest control flow, functions and loops.
CONTROL = ["if", "for", "while", "loop", "match", "try", "catch", "with"]
FUNCTION, LOOP = ["function", "closure"], ["for", "while", "loop"]
#: Types that are truth values.
BOOL = ["bool", "boolean", "Boolean"]
#: Phrases that mark deprecated or deferred code, in order, and what they are called.
MARKERS = [
    ("backwards compatibility", "backwards-compatibility language"), ("backward compatible", "backwards-compatibility language"),
    ("for compatibility", "backwards-compatibility language"), ("back-compat", "backwards-compatibility language"),
    ("compat layer", "compatibility layer"), ("compatibility layer", "compatibility layer"),
    ("@deprecated", "deprecation marker"), ("deprecated", "deprecation marker"), ("will be removed", "deprecation marker"),
    ("slated for removal", "deprecation marker"), ("to be removed", "deprecation marker"),
    ("deferred to", "deferred implementation"), ("future implementation", "deferred implementation"), ("implement later", "deferred implementation"),
    ("placeholder for", "deferred implementation"), ("stub for", "deferred implementation"), ("not yet implemented", "deferred implementation"),
    ("will be implemented", "deferred implementation"),
    ("legacy", "legacy code"), ("shim", "migration shim"), ("wrapper for old", "legacy wrapper"), ("migrate later", "deferred migration"), ("old api", "legacy API"),
    ("old implementation", "kept-for-reference code"), ("previous version", "kept-for-reference code"), ("kept for reference", "kept-for-reference code"),
    ("original version", "kept-for-reference code"),
    ("phase 2", "future work deferral"), ("different phase", "future work deferral"), ("later milestone", "future work deferral"),
    ("future sprint", "future work deferral"), ("next version", "future work deferral"),
]
#: Tags of open work, in order.
TAGS = ["FIXME", "SAFETY", "HACK", "XXX", "TODO"]
#: Parts of names that say a type.
TYPE_PARTS = ["string", "str", "vec", "map", "hash", "list", "array", "set", "dict", "tuple", "bool", "int", "float", "i32", "i64", "u32", "u64", "f32", "f64", "usize", "isize"]
#: Numbers that need no name.
TRIVIAL = ["0", "1", "2", "0.0", "1.0"]
#: Kinds under which numbers and strings need no name.
NUMBER_SAFE = ["index", "range", "type", "generic", "unary", "const", "static", "variant"]
STRING_SAFE = ["macro", "attribute", "use", "call", "const", "static", "variant"]
SEPARATORS = "-=─═━~*"


@dataclass(frozen=True)
class Rule:
    id: str
    severity: str
    default: bool
    find: Callable[[DataFrame], DataFrame]
    suggestions: tuple[str, ...]


RULES: dict[str, Rule] = {}


def rule(id_: str, severity: str, *suggestions: str, default: bool = True):
    """Registers a rule; its function gives nodes with a ``message`` column."""

    def add(f: Callable[[DataFrame], DataFrame]):
        RULES[id_] = Rule(id_, severity, default, f, suggestions)
        return f

    return add


def kind(*kinds: str) -> Column:
    return F.col("kind").isin(*kinds)


def children(n: DataFrame, **counts: Column) -> DataFrame:
    """(path, pre, counts) of nodes with children: how many children satisfy each condition."""
    made = [F.count_if(c).alias(name) for name, c in counts.items()]
    return n.where("parent_pre is not null").groupBy("path", F.col("parent_pre").alias("pre")).agg(*made)


def parents(n: DataFrame, *columns: str) -> DataFrame:
    return n.select("path", F.col("pre").alias("parent_pre"), *[F.col(c).alias(f"parent_{c}") for c in columns if c != "pre"])


def owned(inner: DataFrame, owners: DataFrame) -> DataFrame:
    """``inner`` with ``owner``: the pre of the innermost of ``owners`` around each node."""
    spans = owners.select("path", F.col("pre").alias("owner"), (F.col("pre") + 1).alias("o_start"), F.col("post").alias("o_end"))
    points = inner.select("path", "pre").distinct()
    best = intervals.deepest(points, spans, "path", "pre", "o_start", "o_end", "owner", "owner").select("path", "pre", "owner")
    return inner.join(best, ["path", "pre"])


def under(n: DataFrame, *kinds: str) -> DataFrame:
    """``n`` with ``nested``: how many ancestors are of these kinds."""
    return sequences.nesting(n, "path", kind(*kinds))


def counted(n: DataFrame, outer: Column, group: Column, what: Column, most: int, message: str) -> DataFrame:
    """Nodes of ``outer`` whose child group has more than ``most`` children that are ``what``."""
    inside = children(n, n_found=what)
    groups = n.where(group).join(inside, ["path", "pre"]).select("path", F.col("parent_pre").alias("pre"), "n_found")
    totals = groups.groupBy("path", "pre").agg(F.sum("n_found").alias("n_found")).where(F.col("n_found") > most)
    return n.where(outer).join(totals, ["path", "pre"]).withColumn("message", F.format_string(message, F.col("n_found"), F.coalesce("name", F.lit(""))))


def statements(n: DataFrame) -> DataFrame:
    """Nodes that stand directly in a block or file, with their block's pre and post."""
    blocks = n.where(kind("block", "file")).select("path", F.col("pre").alias("parent_pre"), F.col("pre").alias("block_pre"), F.col("post").alias("block_post"))
    return n.where(~kind("comment", "attribute")).join(blocks, ["path", "parent_pre"])


@rule("ascii-separator", "warning", "Use a plain comment or a doc heading")
def ascii_separator(n):
    bare = lambda x: F.trim(F.regexp_replace(F.trim(x), r"^(?:///|//!|//|/\*\*|/\*|\*/|#|\* )", ""))
    pure, framed = f"^[{SEPARATORS}]{{3,}}$", rf"^[{SEPARATORS}]{{2,}}\s*[^{SEPARATORS}\s].*?[{SEPARATORS}]{{2,}}$"
    hit = F.exists(F.split("text", "\n"), lambda x: bare(x).rlike(pure) | bare(x).rlike(framed))
    return n.where(kind("comment") & hit).withColumn("message", F.lit("ASCII separator in a comment"))


@rule("boolean-parameter", "info", "Use an enum or two functions")
def boolean_parameter(n):
    typed = n.where(kind("type") & (F.col("role") == "type") & F.col("name").isin(*BOOL)).select("path", F.col("parent_pre").alias("pre"))
    params = n.where(kind("parameter")).join(typed, ["path", "pre"], "left_semi")
    groups = n.where(kind("parameters")).select("path", F.col("pre").alias("parent_pre"), F.col("parent_pre").alias("f"))
    counts = params.select("path", "parent_pre", "name").join(groups, ["path", "parent_pre"]).groupBy("path", F.col("f").alias("pre")).agg(F.concat_ws(", ", F.array_sort(F.collect_list("name"))).alias("names"))
    return n.where(kind(*FUNCTION)).join(counts, ["path", "pre"]).withColumn("message", F.concat(F.lit("Boolean parameter: "), F.col("names")))


@rule("deep-nesting", "warning", "Return early, or extract a function")
def deep_nesting(n):
    deep = under(n, *CONTROL).where(kind(*CONTROL) & (F.col("nested") + 1 > NESTING))
    return deep.withColumn("message", F.format_string("Control flow nested %d deep", F.col("nested") + 1)).drop("nested")


@rule("deep-super-import", "warning", "Import from the crate root")
def deep_super_import(n):
    return n.where(kind("use") & F.col("text").rlike(r"super\s*::\s*super")).withColumn("message", F.lit("Import climbs more than one module"))


@rule("deeply-nested-type", "info", "Name the type with an alias")
def deeply_nested_type(n):
    generics = under(n, "generic").where(kind("generic"))
    order = Window.partitionBy("path").orderBy("pre").rowsBetween(Window.unboundedPreceding, 0)
    rooted = generics.withColumn("outer", F.last(F.when(F.col("nested") == 0, F.col("pre")), ignorenulls=True).over(order))
    depth = rooted.groupBy("path", F.col("outer").alias("pre")).agg((F.max("nested") + 1).alias("n_found")).where(F.col("n_found") >= GENERICS)
    free = under(n, "type_alias").where(kind("generic") & (F.col("nested") == 0)).drop("nested")
    return free.join(depth, ["path", "pre"]).withColumn("message", F.format_string("Type nested %d deep", F.col("n_found"))).drop("n_found")


@rule("deprecation-marker", "warning", "Remove what is deprecated, or open an issue")
def deprecation_marker(n):
    low = F.lower("text")
    found = F.coalesce(*[F.when(low.contains(p), F.lit(label)) for p, label in MARKERS])
    return n.where(kind("comment")).withColumn("message", found).where("message is not null")


@rule("else-if-chain", "warning", "Use match, or a table")
def else_if_chain(n):
    ifs = n.where(kind("if")).select("path", "pre", "parent_pre", "role")
    alt = ifs.where("role = 'alternative'").join(ifs.select("path", F.col("pre").alias("parent_pre")), ["path", "parent_pre"], "left_semi").select("path", "pre", "parent_pre")
    heads = ifs.join(alt.select("path", "pre"), ["path", "pre"], "left_anti").select("path", F.col("pre").alias("head"), F.col("pre").alias("at"))
    for _ in range(ELSE_IFS):
        heads = heads.join(alt.select("path", F.col("parent_pre").alias("at"), F.col("pre").alias("next")), ["path", "at"]).select("path", "head", F.col("next").alias("at"))
    long = heads.select("path", F.col("head").alias("pre")).distinct()
    return n.join(long, ["path", "pre"], "left_semi").withColumn("message", F.lit("Long else-if chain"))


@rule("empty-catch", "warning", "Handle the error, or say why it can be ignored")
def empty_catch(n):
    inside = children(n, n_real=~kind("comment"))
    full = n.where(kind("block") & (F.col("role") == "body")).join(inside.where("n_real > 0"), ["path", "pre"], "left_semi").select("path", F.col("parent_pre").alias("pre"))
    return n.where(kind("catch")).join(full, ["path", "pre"], "left_anti").withColumn("message", F.lit("Empty catch block"))


@rule("fat-trait", "warning", "Split the trait")
def fat_trait(n):
    bodies = n.where((F.col("role") == "body")).select("path", F.col("parent_pre").alias("pre"))
    required = n.where(kind("function")).join(bodies, ["path", "pre"], "left_anti").select("path", "pre").withColumn("req", F.lit(True))
    marked = n.join(required, ["path", "pre"], "left")
    return counted(marked, kind("trait"), F.col("role") == "body", F.coalesce("req", F.lit(False)), METHODS_REQUIRED, "Trait requires %d methods: %s").drop("req", "n_found")


@rule("god-struct", "warning", "Split it by what belongs together")
def god_struct(n):
    return counted(n, kind("struct", "class"), kind("fields", "class_body"), kind("field_def", "assign"), FIELDS, "%d fields in %s").drop("n_found")


@rule("index-in-loop", "info", "Iterate over the elements")
def index_in_loop(n):
    loops = n.where(kind("for"))
    var = n.where((F.col("role").isin("pattern", "left")) & kind("pattern", "ident")).select("path", F.col("parent_pre").alias("pre"), F.trim("text").alias("var"))
    over = n.where((F.col("role") == "value") & (kind("range") | (kind("call") & (F.col("text").startswith("range("))))).select("path", F.col("parent_pre").alias("pre"))
    counted_ = loops.join(var, ["path", "pre"]).join(over, ["path", "pre"], "left_semi")
    plain = n.where(kind("arguments")).select("path", F.col("pre").alias("arg"), F.col("parent_pre").alias("ix"))
    index = n.where(kind("index")).select("path", F.col("pre").alias("ix"))
    direct = n.where(kind("ident")).select("path", F.col("parent_pre").alias("holder"), F.col("name").alias("var"), F.col("pre").alias("id_pre"))
    by_arg = direct.join(plain.withColumnRenamed("arg", "holder"), ["path", "holder"]).join(index, ["path", "ix"], "left_semi").select("path", "var", "id_pre")
    by_self = direct.withColumnRenamed("holder", "ix").join(index, ["path", "ix"], "left_semi").select("path", "var", "id_pre")
    used = by_arg.unionByName(by_self)
    hit = counted_.join(used, ["path", "var"]).where((F.col("id_pre") > F.col("pre")) & (F.col("id_pre") < F.col("post"))).select("path", "pre").distinct()
    return loops.join(hit, ["path", "pre"], "left_semi").withColumn("message", F.lit("Loop indexes by its counter"))


@rule("large-closure", "info", "Make it a named function")
def large_closure(n):
    size = F.col("row_end") - F.col("row_start") + 1
    return n.where(kind("closure") & (size > CLOSURE_LINES)).withColumn("message", F.format_string("Closure of %d lines", size))


@rule("long-match", "warning", "Split it, or use a table")
def long_match(n):
    return counted(n, kind("match"), kind("arms"), kind("arm"), ARMS, "%d arms%s").drop("n_found")


@rule("long-parameter-list", "warning", "Group parameters in a struct")
def long_parameter_list(n):
    return counted(n, kind(*FUNCTION), kind("parameters"), kind("parameter"), PARAMETERS, "%d parameters of %s").drop("n_found")


@rule("magic-number", "info", "Name the number", default=False)
def magic_number(n):
    loose = under(n, *NUMBER_SAFE).where(kind("number") & (F.col("nested") == 0) & ~F.col("text").isin(*TRIVIAL))
    return loose.withColumn("message", F.concat(F.lit("Magic number "), "text")).drop("nested")


@rule("magic-string", "info", "Name the string", default=False)
def magic_string(n):
    body = F.regexp_replace("text", "^[A-Za-z]*#*[\"'`]+|[\"'`]+#*$", "")
    shaped = body.contains("{}") | body.contains("{0") | body.startswith("/") | body.contains("://")
    loose = under(n, *STRING_SAFE).where(kind("string") & (F.col("nested") == 0) & (F.octet_length(body) >= 4) & ~shaped)
    return loose.withColumn("message", F.concat(F.lit("Magic string "), "text")).drop("nested")


@rule("manual-map", "info", "Use map")
def manual_map(n):
    arms = n.where(kind("arm")).select("path", F.col("pre").alias("arm"), F.col("parent_pre").alias("arms"))
    part = n.where(F.col("role").isin("pattern", "value")).select("path", F.col("parent_pre").alias("arm"), "role", F.trim("text").alias("t"))
    sides = part.groupBy("path", "arm").agg(F.max(F.when(F.col("role") == "pattern", F.col("t"))).alias("p"), F.max(F.when(F.col("role") == "value", F.col("t"))).alias("v"))
    some, none = F.col("p").startswith("Some(") & F.col("v").startswith("Some("), (F.col("p") == "None") & (F.col("v") == "None")
    per = arms.join(sides, ["path", "arm"]).groupBy("path", "arms").agg(F.count(F.lit(1)).alias("n"), F.count_if(some).alias("some"), F.count_if(none).alias("none")).where("n = 2 and some = 1 and none = 1")
    groups = n.where(kind("arms")).join(per.select("path", F.col("arms").alias("pre")), ["path", "pre"], "left_semi").select("path", F.col("parent_pre").alias("pre"))
    return n.where(kind("match")).join(groups, ["path", "pre"], "left_semi").withColumn("message", F.lit("Match that maps an option by hand"))


@rule("negated-condition", "info", "Swap the branches")
def negated_condition(n):
    negated = n.where(kind("not") & (F.col("role") == "condition")).select("path", F.col("parent_pre").alias("pre"))
    other = n.where(F.col("role") == "alternative").select("path", F.col("parent_pre").alias("pre"))
    both = n.where(kind("if")).join(negated, ["path", "pre"], "left_semi").join(other, ["path", "pre"], "left_semi")
    return both.withColumn("message", F.lit("Negated condition with an else"))


@rule("redundant-clone", "warning", "Remove the clone", default=False)
def redundant_clone(n):
    fn = n.where(kind("field") & (F.col("role") == "function") & (F.col("name") == "clone")).select("path", F.col("parent_pre").alias("pre"), F.regexp_extract("text", r"^(.*)\.\s*clone$", 1).alias("receiver"))
    calls = n.where(kind("call")).join(fn, ["path", "pre"]).where(F.col("receiver").rlike(r"^\w+$"))
    inside = owned(calls, statements(n)).select("path", "pre", "receiver", "owner")
    s = statements(n).select("path", F.col("pre").alias("owner"), F.col("post").alias("s_post"), "block_post", "sib_idx", "n_sibs")
    open_ = inside.join(s, ["path", "owner"])
    later = n.where(~kind("comment")).select("path", F.col("pre").alias("x"))
    with_later = open_.join(later, "path").where((F.col("x") > F.col("s_post")) & (F.col("x") < F.col("block_post"))).select("path", "pre").distinct()
    ids = n.where(kind("ident")).select("path", F.col("name").alias("receiver"), F.col("pre").alias("x"))
    macros = n.where(kind("macro")).select("path", F.col("pre").alias("x"), F.explode(F.regexp_extract_all("text", F.lit(r"([A-Za-z_]\w*)"))).alias("receiver")).select("path", "receiver", "x")
    used = open_.join(ids.unionByName(macros), ["path", "receiver"]).where((F.col("x") > F.col("s_post")) & (F.col("x") < F.col("block_post"))).select("path", "pre").distinct()
    hit = inside.join(with_later, ["path", "pre"], "left_semi").join(used, ["path", "pre"], "left_anti").select("path", "pre", "receiver")
    return n.join(hit, ["path", "pre"]).withColumn("message", F.concat(F.lit("Clone of "), F.col("receiver"), F.lit(", which isn't used afterwards"))).drop("receiver")


@rule("repeated-field-access", "info", "Bind the prefix to a local")
def repeated_field_access(n):
    bodies = n.where((F.col("role") == "body") & kind("block")).select("path", F.col("pre").alias("parent_pre"), F.col("parent_pre").alias("f"))
    functions = n.where(kind(*FUNCTION)).select("path", F.col("pre").alias("f"))
    lines_ = n.where(~kind("comment")).join(bodies.join(functions, ["path", "f"], "left_semi"), ["path", "parent_pre"])
    chain = F.regexp_extract("text", r"^\s*((?:[A-Za-z_$][\w$]*\.)+[\w$]+)\s*(?:\(|=|\+=|;|$)", 1)
    prefix = F.regexp_replace(chain, r"\.[^.]*$", "")
    shaped = lines_.withColumn("prefix", F.when(prefix.contains("."), prefix)).withColumn("key", F.struct("path", "f"))
    runs = sequences.longest_run(shaped.withColumn("prefix", F.coalesce("prefix", F.concat(F.lit("#"), F.col("pre").cast("string")))), "key", "pre", "prefix", RUN)
    hit = runs.select(F.col("key.path").alias("path"), F.col("first").alias("pre"), "prefix")
    return n.join(hit, ["path", "pre"]).withColumn("message", F.concat(F.lit("Repeated access to "), F.col("prefix"))).drop("prefix")


@rule("single-use-variable", "info", "Use the expression in place", default=False)
def single_use_variable(n):
    lets = statements(n).where(kind("let", "assign") & F.col("name").isNotNull() | kind("let")).where("name is not null")
    following = n.where(~kind("comment")).select("path", "parent_pre", F.col("sib_idx").alias("nx_idx"), F.col("pre").alias("nx_pre"), F.col("post").alias("nx_post"))
    after = Window.partitionBy("path", "parent_pre", "pre").orderBy("nx_idx")
    nxt = lets.join(following, ["path", "parent_pre"]).where("nx_idx > sib_idx").withColumn("r", F.row_number().over(after)).where("r = 1").drop("r")
    ids = n.where(kind("ident")).select("path", "name", F.col("pre").alias("x"))
    macros = n.where(kind("macro")).select("path", F.col("pre").alias("x"), F.explode(F.regexp_extract_all("text", F.lit(r"([A-Za-z_]\w*)"))).alias("name")).select("path", "name", "x")
    uses = nxt.join(ids.unionByName(macros), ["path", "name"]).where((F.col("x") > F.col("post")) & (F.col("x") < F.col("block_post")))
    once = uses.groupBy("path", "pre").agg(F.count(F.lit(1)).alias("n"), F.count_if((F.col("x") >= F.col("nx_pre")) & (F.col("x") < F.col("nx_post"))).alias("near")).where("n = 1 and near = 1")
    return n.join(once.select("path", "pre"), ["path", "pre"], "left_semi").withColumn("message", F.concat(F.lit("Variable used once: "), F.col("name")))


@rule("string-concat-loop", "warning", "Collect and join, or push to a buffer")
def string_concat_loop(n):
    text_in = n.where(kind("string")).select("path", F.col("pre").alias("x"))
    sums = n.where((kind("aug_assign") & F.col("text").contains("+=")) | kind("assign"))
    inside = sums.join(text_in, "path").where((F.col("x") > F.col("pre")) & (F.col("x") < F.col("post"))).drop("x").distinct()
    left = F.trim(F.regexp_extract("text", r"^([^=+]*?)\s*\+?=", 1))
    again = F.trim(F.regexp_extract("text", r"=\s*([\w.]+)\s*\+", 1))
    concat = inside.where(kind("aug_assign") | ((left == again) & (left != "")))
    near = owned(concat, n.where(kind(*LOOP, *FUNCTION))).select("path", F.col("owner").alias("pre")).distinct()
    return n.where(kind(*LOOP)).join(near, ["path", "pre"], "left_semi").withColumn("message", F.lit("String built by concatenation in a loop"))


@rule("string-format-push", "info", "Use push_str", default=False)
def string_format_push(n):
    return n.where(kind("macro") & F.col("text").rlike(r'^format!\s*\(\s*"(?:[^"{}]|\{\})*"\s*,')).withColumn("message", F.lit("Format with plain holes only"))


@rule("stringly-typed-match", "warning", "Use an enum")
def stringly_typed_match(n):
    direct = n.where(kind("string") & (F.col("role") == "pattern")).select("path", F.col("parent_pre").alias("arm"))
    pattern = n.where(kind("pattern")).select("path", F.col("pre").alias("p"), F.col("parent_pre").alias("arm"))
    held = n.where(kind("string", "expr")).select("path", F.col("parent_pre").alias("p"), "kind").where("kind = 'string'").join(pattern, ["path", "p"]).select("path", "arm")
    arms = n.where(kind("arm")).join(direct.unionByName(held).distinct().withColumnRenamed("arm", "pre"), ["path", "pre"], "left_semi").select("path", F.col("parent_pre").alias("g"))
    many = arms.groupBy("path", "g").agg(F.count(F.lit(1)).alias("n_found")).where(F.col("n_found") >= STRING_ARMS)
    groups = n.where(kind("arms")).select("path", F.col("pre").alias("g"), F.col("parent_pre").alias("pre")).join(many, ["path", "g"]).select("path", "pre", "n_found")
    return n.where(kind("match")).join(groups, ["path", "pre"]).withColumn("message", F.format_string("%d arms match strings", "n_found")).drop("n_found")


@rule("todo-fixme", "info", "Resolve it, or open an issue")
def todo_fixme(n):
    said = lambda t: text.tag_suffix(F.regexp_extract("text", rf"(?s)\b{t}(.*)$", 1))
    found = F.coalesce(*[F.when(F.col("text").contains(t) & said(t).isNotNull(), F.concat(F.lit(f"{t} comment found: "), text.first_line(said(t)))) for t in TAGS])
    return n.where(kind("comment")).withColumn("message", found).where("message is not null")


@rule("too-many-locals", "warning", "Extract a function")
def too_many_locals(n):
    functions = n.where(kind(*FUNCTION))
    bound = n.where(kind("let", "assign"))
    first = Window.partitionBy("path", "owner", "name", F.col("kind") == "assign").orderBy("pre")
    named = owned(bound.withColumn("name", F.coalesce("name", F.regexp_extract("text", r"^\s*(\w+)", 1))), functions)
    fresh = named.withColumn("r", F.row_number().over(first)).where((F.col("kind") == "let") | (F.col("r") == 1))
    many = fresh.groupBy("path", F.col("owner").alias("pre")).agg(F.count(F.lit(1)).alias("n_found")).where(F.col("n_found") > LOCALS)
    return functions.join(many, ["path", "pre"]).withColumn("message", F.format_string("%d local variables", "n_found")).drop("n_found")


@rule("too-many-methods", "warning", "Split the type")
def too_many_methods(n):
    return counted(n, kind("impl", "class"), F.col("role") == "body", kind("function"), METHODS, "%d methods in %s").drop("n_found")


@rule("type-in-variable-name", "info", "Name it for its purpose", default=False)
def type_in_variable_name(n):
    name = F.coalesce("name", F.regexp_extract("text", r"^\s*(\w+)", 1))
    hit = F.coalesce(*[F.when(name.contains(f"_{p}") | name.contains(f"{p}_"), F.lit(p)) for p in TYPE_PARTS])
    return n.where(kind("let", "assign")).withColumn("part", hit).where("part is not null").withColumn("message", F.concat(name, F.lit(" names its type: "), F.col("part"))).drop("part")


@rule("unnecessary-else", "warning", "Drop the else")
def unnecessary_else(n):
    last = n.where(~kind("comment")).groupBy("path", "parent_pre").agg(F.max_by(F.struct("kind", "pre"), "sib_idx").alias("last"))
    wrapped = n.where(kind("exit")).select("path", F.col("parent_pre").alias("w")).distinct()
    ends = last.withColumn("w", F.col("last.pre")).join(wrapped.withColumn("in_statement", F.lit(True)), ["path", "w"], "left").select("path", "parent_pre", ((F.col("last.kind") == "exit") | ((F.col("last.kind") == "expr_stmt") & F.col("in_statement").isNotNull())).alias("exits"))
    then = n.where(F.col("role") == "consequence").select("path", F.col("pre").alias("b"), F.col("parent_pre").alias("pre"))
    done = then.join(ends.where("exits").withColumnRenamed("parent_pre", "b"), ["path", "b"], "left_semi").select("path", "pre")
    other = n.where((F.col("role") == "alternative") & kind("block")).select("path", F.col("parent_pre").alias("pre"))
    return n.where(kind("if")).join(done, ["path", "pre"], "left_semi").join(other, ["path", "pre"], "left_semi").withColumn("message", F.lit("Else after a branch that leaves"))


@rule("unwrap-chain", "warning", "Use ? or handle the cases")
def unwrap_chain(n):
    fn = n.where(kind("field") & (F.col("role") == "function") & (F.col("name") == "unwrap")).select("path", F.col("parent_pre").alias("pre"))
    calls = n.where(kind("call")).join(fn, ["path", "pre"], "left_semi")
    stmts = statements(n)
    many = owned(calls, stmts).groupBy("path", F.col("owner").alias("pre")).agg(F.count(F.lit(1)).alias("n_found")).where("n_found >= 2")
    return n.join(many, ["path", "pre"]).withColumn("message", F.format_string("%d unwraps in one statement", "n_found")).drop("n_found")


def enabled(rules: list[str] | None = None, disabled: tuple[str, ...] = ()) -> list[Rule]:
    """The rules to run: without a list the default ones, with an empty list all, else those listed.

    Unknown ids raise, so that a misspelt one isn't silently off.
    """
    unknown = [r for r in (*(rules or ()), *disabled) if r not in RULES]
    if unknown:
        raise ValueError(f"unknown rules: {', '.join(unknown)}")
    chosen = [r for r in RULES.values() if r.default] if rules is None else list(RULES.values()) if not rules else [RULES[r] for r in rules]
    return [r for r in chosen if r.id not in disabled]


def analyse(nodes: DataFrame, chosen: list[Rule] | None = None) -> DataFrame:
    """(path, rule_id, severity, row_start, row_end, message, suggestions, node_pre); rows from 0, ends inclusive."""
    n = graph.settled(nodes.repartition("path"))
    parts = []
    for r in chosen if chosen is not None else enabled():
        found = r.find(n)
        parts.append(found.select(
            "path", F.lit(r.id).alias("rule_id"), F.lit(r.severity).alias("severity"), "row_start", "row_end", "message",
            F.array(*map(F.lit, r.suggestions)).alias("suggestions"), F.col("pre").alias("node_pre"),
        ))
    return reduce(DataFrame.unionByName, parts)


def view(hints: DataFrame) -> DataFrame:
    """Findings as shown: lines from 1; three or more of a rule in a file become one row."""
    from treeloom.operators.aggregates import collapsed

    shown = hints.withColumns({"line_start": F.col("row_start") + 1, "line_end": F.col("row_end") + 1})
    return collapsed(shown.drop("row_start", "row_end"), ["path"], "rule_id", "node_pre")


def suggestions(hints: DataFrame) -> DataFrame:
    """(rule_id, suggestion, first): each once, by where it was first given."""
    each = hints.select("rule_id", "node_pre", F.posexplode("suggestions").alias("i", "suggestion"))
    return each.groupBy("rule_id", "suggestion").agg(F.min(F.struct("node_pre", "i")).alias("first"))
