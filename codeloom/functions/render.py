"""Comment and prompt rendering as string expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def permalink(owner: Column, repo: Column, ref: Column, path: Column, start: Column, end: Column, site: str = "https://github.com") -> Column:
    """Link to a line or a range of lines; empty without owner or repository."""
    base = F.concat(F.lit(f"{site}/"), owner, F.lit("/"), repo, F.lit("/blob/"), ref, F.lit("/"), path, F.lit("#L"), start.cast("string"))
    full = F.when(end > start, F.concat(base, F.lit("-L"), end.cast("string"))).otherwise(base)
    return F.when((F.coalesce(owner, F.lit("")) == "") | (F.coalesce(repo, F.lit("")) == ""), F.lit("")).otherwise(full)


def highlight_name(path: Column) -> Column:
    return F.when(path.endswith(".py"), F.lit("python")).when(path.endswith(".java"), F.lit("java")).otherwise(F.lit(""))


def code_fence(code: Column, language: Column, first_line: Column, marked: Column) -> Column:
    """A fenced block; lines whose number in the file is in ``marked`` get an arrow. Blank code gives nothing."""
    lines = F.transform(F.split(code, "\n", -1), lambda x, i: F.when(F.array_contains(marked, i + first_line), F.concat(x, F.lit("  # <--"))).otherwise(x))
    return F.when(F.trim(F.coalesce(code, F.lit(""))) == "", F.lit("")).otherwise(F.concat(F.lit("```"), language, F.lit("\n"), F.array_join(lines, "\n"), F.lit("\n```")))


def with_context(lines: Column, before: Column, after: Column) -> Column:
    """Lines between markers that say how many lines are left out on either side."""
    mark = lambda n: F.format_string("... (%d more lines)", n)
    a = F.when(before > 0, F.array_prepend(lines, mark(before))).otherwise(lines)
    return F.when(after > 0, F.array_append(a, mark(after))).otherwise(a)


def entity_section(name: Column, kind: Column, path: Column, score: Column, link: Column, reason: Column) -> Column:
    head = F.format_string("### %s `%s`\n- File: [%s](%s)\n- Score: %.2f", kind, name, path, link, score)
    return F.when(F.coalesce(reason, F.lit("")) != "", F.concat(head, F.lit("\n- Why: "), reason)).otherwise(head)


def prompt_candidate(id_: Column, kind: Column, path: Column, cls: Column, name: Column, code: Column, most: int = 1500) -> Column:
    return F.concat_ws("\n", F.concat(F.lit("ID: "), id_), F.concat(F.lit("Type: "), kind), F.concat(F.lit("File: "), path), F.concat(F.lit("Class: "), F.coalesce(cls, F.lit("-"))), F.concat(F.lit("Name: "), name), F.concat(F.lit("Code:\n"), F.substring(F.coalesce(code, F.lit("")), 1, most)))


def graph_context(name: Column, callers: Column, callees: Column) -> Column:
    shown = lambda a: F.when(F.size(a) > 0, F.array_join(a, ", ")).otherwise(F.lit("none"))
    return F.concat(name, F.lit("\n  Called by: "), shown(callers), F.lit("\n  Calls: "), shown(callees))


def candidate_line(rank: Column, name: Column, path: Column, link: Column) -> Column:
    shown = F.concat(F.lit("`"), name, F.lit("`"))
    return F.concat(rank.cast("string"), F.lit(". **"), F.when(link != "", F.concat(F.lit("["), shown, F.lit("]("), link, F.lit(")"))).otherwise(shown), F.lit("** in `"), path, F.lit("`\n\n"))


def error_comment(message: Column) -> Column:
    return F.concat(F.lit("## Bug localisation failed\n\n"), F.coalesce(message, F.lit("unknown error")))
