"""What hooks read out of a session's events: paths in commands and tool inputs, failures, context."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from treeloom.functions import paths

#: Hooks by the event that they run on.
HOOKS = {
    "PreToolUse": ("pre-tool-use-file-access", "pre-tool-use-grep-symbol"),
    "PostToolUse": ("post-tool-use-bash-hints", "post-tool-use-cli-alts", "post-tool-use-vfs-reread", "post-tool-use-ssot", "post-tool-use-diagnostics"),
    "PostToolUseFailure": ("post-tool-use-failure",),
    "SessionStart": ("session-start",),
    "Stop": ("stop",),
    "StatusLine": ("statusline",),
}
#: The tools that hooks look at, where not all are meant.
TOOLS = {
    "pre-tool-use-file-access": ("Read", "Edit", "Write"), "pre-tool-use-grep-symbol": ("Grep",), "post-tool-use-bash-hints": ("Bash",),
    "post-tool-use-cli-alts": ("Grep", "Glob"), "post-tool-use-vfs-reread": ("Edit", "Write"), "post-tool-use-ssot": ("Edit", "Write"),
    "post-tool-use-diagnostics": ("Edit", "Write"), "post-tool-use-failure": ("Edit",),
}


def due(event: Column, tool: Column, disabled: tuple[str, ...] = ()) -> Column:
    """The hooks (array of string) that an event with a tool runs, in order; none for unknown events."""
    out = F.array().cast("array<string>")
    for name, hooks in reversed(HOOKS.items()):
        live = [F.when(tool.isin(*TOOLS[h]), F.lit(h)) if h in TOOLS else F.lit(h) for h in hooks if h not in disabled]
        out = F.when(event == name, F.array_compact(F.array(*live)) if live else F.array().cast("array<string>")).otherwise(out)
    return out


def mentioned_paths(command: Column, root: Column) -> Column:
    """Paths below ``root`` that a command names, relative to it; companions' paths don't count."""
    tokens = F.filter(F.split(F.trim(command), r"\s+"), lambda t: t != "")
    below = F.transform(tokens, lambda t: paths.strip_root(F.regexp_replace(t, "[,:;]+$", ""), root))
    return F.filter(below, lambda p: p.isNotNull() & paths.companion(p)["source"].isNull())


def tool_path(tool: Column, given: Column) -> Column:
    """The file that a Read, Edit or Write names in its JSON input; null for other tools."""
    return F.when(tool.isin("Read", "Edit", "Write"), F.get_json_object(given, "$.file_path"))


def source_path(tool: Column, given: Column, root: Column) -> Column:
    """The source file, relative to ``root``, behind the file of a tool's input; null outside of it."""
    below = paths.strip_root(tool_path(tool, given), root)
    return F.coalesce(paths.companion(below)["source"], below)


def symbol_moved(tool: Column, given: Column, error: Column) -> Column:
    """Whether a tool failed because the symbol it edits is no longer there."""
    at = F.when(tool == "Edit", F.get_json_object(given, "$.file_path"))
    return F.coalesce(error.contains("ENOENT") & at.contains("@/symbols/"), F.lit(False))


def session_context(date: Column, root: Column, branch: Column, host_root: Column, platform: Column, shell: Column) -> Column:
    """What a session is told when it starts, a line for each fact; a repository without a branch says so."""
    facts = {"Date": date, "Worktree": root, "Branch": F.coalesce(branch, F.lit("(no repo)")), "Project": host_root, "Platform": platform, "Shell": F.coalesce(shell, F.lit(""))}
    return F.array_join(F.array(*[F.concat(F.lit(f"{k}: "), v) for k, v in facts.items()]), "\n")
