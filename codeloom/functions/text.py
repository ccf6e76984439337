"""Text and path functions as column expressions.

All are built-in expressions, so they stay in the JVM. Null texts count as empty
unless said otherwise.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: File extensions and their languages.
LANGUAGES = {".py": "python", ".java": "java"}
#: Directories that a repository scan leaves out.
EXCLUDED_DIRS = [".git", "__pycache__", "venv", "env", ".venv", "node_modules", "build", "dist", "target", ".idea", "out"]
#: Unicode's space separators.
BLANKS = " \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"
#: Cleaning patterns in order: Markdown headers, links, fenced code, inline code, tags, URLs, other characters, blanks.
CLEANING = [
    (r"(?m)^#+\s+", ""),
    (r"\[([^\]]+)\]\([^\)]+\)", "$1"),
    (r"```[\s\S]*?```", ""),
    (r"`[^`]+`", ""),
    (r"<[^>]+>", ""),
    (r"http[s]?://\S+", ""),
    (r"[^\p{L}\p{N}_\s.,!?-]", " "),
    (r"\s+", " "),
]


def clean_text(c: Column) -> Column:
    return F.trim(reduce(lambda x, step: F.regexp_replace(x, *step), CLEANING, F.coalesce(c, F.lit(""))))


def normalize_text(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"\s+", " "))


def word_count(c: Column) -> Column:
    t = F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " "))
    return F.when(t == "", F.lit(0)).otherwise(F.size(F.split(t, " ")))


def long_enough(c: Column, least: int = 5) -> Column:
    """Whether an issue text has enough words to be worth retrieving for."""
    return word_count(c) >= least


def compact_prompt(c: Column) -> Column:
    """Tabs to four blanks, lines without trailing blanks, no empty lines."""
    lines = F.transform(F.split(F.replace(F.coalesce(c, F.lit("")), F.lit("\t"), F.lit("    ")), "\n"), lambda x: F.rtrim(x, F.lit(BLANKS)))
    return F.array_join(F.filter(lines, lambda x: x != ""), "\n")


def truncated(c: Column, most: int, suffix: str = "") -> Column:
    return F.when(F.length(c) > most, F.concat(F.substring(c, 1, most), F.lit(suffix))).otherwise(c)


def stable_id(*parts: Column) -> Column:
    """First 16 hex digits of the MD5 of the parts joined by colons; null parts are empty."""
    return F.substring(F.md5(F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])), 1, 16)


def safe_name(repo: Column) -> Column:
    return F.replace(repo, F.lit("/"), F.lit("_"))


def relative_path(path: Column, root: Column) -> Column:
    return F.regexp_replace(F.when(path.startswith(root), F.substring(path, F.length(root) + 1, F.lit(1 << 20))).otherwise(path), "^/+", "")


def normal_path(path: Column) -> Column:
    """Resolves '.', '..' and repeated slashes; the empty path is '.'."""
    parts = F.filter(F.split(path, "/"), lambda x: (x != "") & (x != "."))
    rooted = path.startswith("/")

    def step(acc: Column, x: Column) -> Column:
        last = F.try_element_at(acc, F.lit(-1))
        back = (x == "..") & (F.size(acc) > 0) & (last != "..")
        drop = (x == "..") & (F.size(acc) == 0) & rooted
        return F.when(back, F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).when(drop, acc).otherwise(F.array_append(acc, x))

    joined = F.array_join(F.aggregate(parts, F.array().cast("array<string>"), step), "/")
    return F.when(rooted, F.concat(F.lit("/"), joined)).when(joined == "", F.lit(".")).otherwise(joined)


def has_source_extension(path: Column) -> Column:
    return path.rlike("(" + "|".join(x.replace(".", r"\.") for x in LANGUAGES) + ")$")


def is_prose_file(path: Column) -> Column:
    """Read-me and text files, which a list of files to look at leaves out."""
    base = F.lower(F.element_at(F.split(path, "/"), -1))
    return base.endswith(".txt") | base.startswith("readme")


def iso_utc(ts: Column) -> Column:
    return F.concat(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+00:00"))


def in_excluded_dir(path: Column) -> Column:
    return F.exists(F.slice(F.split(path, "/"), 1, F.greatest(F.size(F.split(path, "/")) - 1, F.lit(0))), lambda x: x.isin(EXCLUDED_DIRS))


def language_of(path: Column, languages: dict[str, str] | None = None, default: str | None = None) -> Column:
    suffix = F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))
    out = F.lit(default).cast("string")
    for ext, lang in (languages or LANGUAGES).items():
        out = F.when(suffix == ext, F.lit(lang)).otherwise(out)
    return out


def is_test_entity(path: Column, name: Column) -> Column:
    p, n = F.lower(F.coalesce(path, F.lit(""))), F.lower(F.coalesce(name, F.lit("")))
    base = F.element_at(F.split(p, "/"), -1)
    return p.contains("/test/") | p.contains("/tests/") | base.contains("test_") | p.contains("_test.py") | n.startswith("test_")


def fenced_json(c: Column) -> Column:
    """The text between JSON fences, else between plain ones, else all of it."""
    tagged = F.regexp_extract(c, r"```json\s*([\s\S]*?)```", 1)
    plain = F.regexp_extract(c, r"```\s*([\s\S]*?)```", 1)
    return F.regexp_replace(F.when(c.contains("```json"), tagged).when(c.contains("```"), plain).otherwise(c), r"^\s+|\s+$", "")


def query_text(query: Column, names: Column, title: Column, body: Column) -> Column:
    """Search text with class names; without a query the first 200 characters of title and body."""
    merged = F.trim(F.concat_ws(" ", query, F.array_join(names, " ")))
    fallback = F.trim(F.substring(F.concat_ws(" ", title, body), 1, 200))
    return F.when(F.length(F.coalesce(merged, F.lit(""))) > 0, merged).otherwise(fallback)


def repo_of_url(url: Column) -> Column:
    """owner/name of a repository, issue or diff address; null without one."""
    found = F.regexp_extract(url, r"^https?://[^/]+/([^/]+/[^/?#]+)", 1)
    return F.when(found != "", F.regexp_replace(found, r"\.git$", ""))


def lines_between(text: Column, start: Column, end: Column) -> Column:
    """Lines start..end (from 1, both included), clamped to the text; empty if there are none."""
    lines = F.split(text, "\n", -1)
    a = F.greatest(start, F.lit(1))
    n = F.greatest(F.least(end, F.size(lines)) - a + 1, F.lit(0))
    return F.coalesce(F.array_join(F.slice(lines, a, n), "\n"), F.lit(""))


def literal_list(c: Column) -> Column:
    """A list written as a Python literal of strings; empty if it does not parse."""
    return F.coalesce(F.from_json(F.replace(c, F.lit("'"), F.lit('"')), "array<string>"), F.array().cast("array<string>"))


def safe_ratio(num: Column, den: Column) -> Column:
    return F.when(den > 0, num / den).otherwise(F.lit(0.0))


def hunk_entity(context: Column, language: Column) -> Column:
    """(kind, name) of a hunk header's context: a class or interface first, else a function; null if none."""
    # What counts as a declaration, and words that are no method names.
    python_class, python_function = r"class\s+([A-Z][a-zA-Z0-9_]*)", r"def\s+([a-zA-Z_][a-zA-Z0-9_]*)"
    java_interface = r"interface\s+([A-Z][a-zA-Z0-9_]*)"
    java_method = r"\w+(?:<[^>]+>)?\s+([a-zA-Z_][a-zA-Z0-9_]*)\s*\("
    no_methods = ["class", "interface", "enum", "extends", "implements", "throws"]
    found = lambda pattern: F.regexp_extract(context, pattern, 1)
    pair = lambda kind, pattern: F.struct(F.lit(kind).alias("kind"), found(pattern).alias("name"))
    java = language == "java"
    return (
        F.when(found(python_class) != "", pair("class", python_class))
        .when(java & (found(java_interface) != ""), pair("class", java_interface))
        .when(java & (found(java_method) != "") & ~found(java_method).isin(no_methods), pair("function", java_method))
        .when((language == "python") & (found(python_function) != ""), pair("function", python_function))
    )
