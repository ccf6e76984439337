"""Source files to functions, classes, imports and calls.

Parsing needs Python: batches of files go through ``mapInPandas``, one pass for
all four results. ``register_parser`` adds languages. Python files are read by
the standard library's syntax trees, and by indentation where they do not parse;
Java files by matching braces after strings and comments are blanked. Method
calls of Java carry the method's name.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.functions.text import stable_id

FUNCTION = "struct<name:string,signature:string,start_line:int,end_line:int,docstring:string,class_name:string,body:string>"
CLASS = "struct<name:string,start_line:int,end_line:int,functions:array<string>,docstring:string,class_type:string>"
SCHEMA = f"repo string, path string, language string, functions array<{FUNCTION}>, classes array<{CLASS}>, imports array<string>, calls map<string,array<string>>, error string"

PIECE_FILES, PIECE_CHARS = 256, 1 << 20

_parsers: dict[str, Callable[[str], tuple[list, list, list, dict]]] = {}


def register_parser(language: str, parse: Callable[[str], tuple[list, list, list, dict]]) -> None:
    """``parse``: text to (functions, classes, imports, calls); it travels to the executors with the job."""
    _parsers[language] = parse


def registered() -> list[str]:
    return sorted(_parsers)


def parse_python(text: str) -> tuple[list, list, list, dict]:
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError):
        return _by_indentation(text)
    lines = text.split("\n")
    functions, classes, imports, calls = [], [], [], {}

    def cut(node: ast.AST) -> str:
        return "\n".join(lines[node.lineno - 1 : node.end_lineno])

    def names_in(node: ast.AST) -> list[str]:
        found: list[str] = []
        stack = list(reversed(node.body))
        while stack:
            x = stack.pop()
            if isinstance(x, (ast.FunctionDef, ast.AsyncFunctionDef)):
                continue  # its names are its own
            if isinstance(x, ast.Name):
                found.append(x.id)
            elif isinstance(x, ast.Attribute):
                found.append(x.attr)
            stack.extend(reversed(list(ast.iter_child_nodes(x))))
        return list(dict.fromkeys(found))

    def walk(node: ast.AST, cls: str | None) -> None:
        for x in ast.iter_child_nodes(node):
            if isinstance(x, (ast.FunctionDef, ast.AsyncFunctionDef)):
                first = x.body[0].lineno if x.body else x.lineno
                head = "\n".join(lines[x.lineno - 1 : max(x.lineno, first - 1)]).strip()
                signature = re.split(r":\s*(?:#.*)?$", head)[0].strip() + ":" if head.rstrip().endswith(":") else head.split(":")[0].strip() + ":"
                functions.append({"name": x.name, "signature": signature, "start_line": x.lineno, "end_line": x.end_lineno, "docstring": ast.get_docstring(x), "class_name": cls, "body": cut(x)})
                calls[x.name] = names_in(x)
                walk(x, cls)
            elif isinstance(x, ast.ClassDef):
                own = [y.name for y in x.body if isinstance(y, (ast.FunctionDef, ast.AsyncFunctionDef)) and not y.decorator_list]
                classes.append({"name": x.name, "start_line": x.lineno, "end_line": x.end_lineno, "functions": own, "docstring": ast.get_docstring(x), "class_type": "class"})
                walk(x, x.name)
            else:
                if isinstance(x, (ast.Import, ast.ImportFrom)):
                    imports.append(ast.get_source_segment(text, x))
                walk(x, cls)

    walk(tree, None)
    del walk  # it names itself, and would hold what was found until a late collection
    return functions, classes, imports, calls


def _by_indentation(text: str) -> tuple[list, list, list, dict]:
    """For files that do not parse: blocks end where the indentation ends."""
    lines = text.split("\n")
    functions, classes, imports, calls = [], [], [], {}
    open_classes: list[tuple[int, str, int]] = []
    for i, line in enumerate(lines):
        if not line.strip():
            continue
        indent = len(line) - len(line.lstrip())
        open_classes = [c for c in open_classes if c[0] < indent]
        if re.match(r"\s*(?:import|from)\s+\w", line):
            imports.append(line.strip())
        m = re.match(r"\s*(?:async\s+)?(def|class)\s+(\w+)", line)
        if not m:
            continue
        end = i
        for k in range(i + 1, len(lines)):
            if lines[k].strip() and len(lines[k]) - len(lines[k].lstrip()) <= indent:
                break
            end = k if lines[k].strip() else end
        body = "\n".join(lines[i : end + 1])
        if m[1] == "class":
            classes.append({"name": m[2], "start_line": i + 1, "end_line": end + 1, "functions": re.findall(r"(?m)^\s+def\s+(\w+)", body), "docstring": None, "class_type": "class"})
            open_classes.append((indent, m[2], end))
        else:
            functions.append({"name": m[2], "signature": line.strip(), "start_line": i + 1, "end_line": end + 1, "docstring": None, "class_name": open_classes[-1][1] if open_classes else None, "body": body})
            calls[m[2]] = list(dict.fromkeys(re.findall(r"[A-Za-z_]\w*", "\n".join(lines[i + 1 : end + 1]))))
    return functions, classes, imports, calls


_JAVA_BLANK = re.compile(r'"(?:\\.|[^"\\\n])*"|\'(?:\\.|[^\'\\\n])*\'|//[^\n]*|/\*[\s\S]*?\*/')
_JAVA_TYPE = re.compile(r"\b(class|interface|enum)\s+(\w+)[^{;]*\{")
_JAVA_METHOD = re.compile(r"((?:(?:public|private|protected|static|final|abstract|synchronized|native|default)\s+)*(?:<[^>{;]+>\s*)?[\w.]+(?:<[^{;()]*>)?(?:\[\])*)\s+(\w+)\s*(\([^)]*\))\s*(?:throws\s+[\w.,\s]+)?([{;])")
_NO_CALLS = {"if", "for", "while", "switch", "catch", "return", "new", "synchronized", "super", "this", "else", "throw", "assert"}


def parse_java(text: str) -> tuple[list, list, list, dict]:
    blank = _JAVA_BLANK.sub(lambda m: re.sub(r"[^\n]", " ", m[0]), text)
    line_of = lambda at: text.count("\n", 0, at) + 1

    def close(at: int) -> int:
        depth = 0
        for k in range(at, len(blank)):
            depth += (blank[k] == "{") - (blank[k] == "}")
            if not depth:
                return k
        return len(blank) - 1

    def doc(at: int) -> str | None:
        before = re.search(r"/\*((?:(?!\*/)[\s\S])*)\*/\s*(?:@\w+(?:\([^)]*\))?\s*)*(?:\w+\s+)*$", text[:at])
        if not before:
            return None
        rows = [re.sub(r"^\s*\*+\s?", "", x).strip() for x in before[1].split("\n")]
        return " ".join(x.strip("* ") for x in rows if x.strip("* ")) or None

    types = [(m.start(), close(m.end() - 1), m) for m in _JAVA_TYPE.finditer(blank)]
    inside = lambda at: max((t for t in types if t[0] < at <= t[1]), key=lambda t: t[0], default=None)
    functions, calls = [], {}
    for m in _JAVA_METHOD.finditer(blank):
        owner = inside(m.start())
        first_word = m[1].split()[-1]
        if owner is None or first_word in _NO_CALLS or m[2] in _NO_CALLS or m[2] == owner[2][2]:
            continue
        end = close(m.end() - 1) if m[4] == "{" else m.end() - 1
        functions.append({"name": m[2], "signature": re.sub(r"\s+", " ", f"{m[1]} {m[2]}{m[3]}").strip(), "start_line": line_of(m.start()), "end_line": line_of(end), "docstring": doc(m.start()), "class_name": owner[2][2], "body": text[m.start() : end + 1]})
        calls[m[2]] = list(dict.fromkeys(x for x in re.findall(r"(\w+)\s*\(", blank[m.end() : end]) if x not in _NO_CALLS))
    classes = [{"name": m[2], "start_line": line_of(a), "end_line": line_of(b), "functions": [f["name"] for f in functions if f["class_name"] == m[2]], "docstring": doc(a), "class_type": m[1]} for a, b, m in types]
    imports = [x.strip() for x in re.findall(r"(?m)^\s*(import\s+[^;]+;)", blank)]
    return functions, classes, imports, calls


register_parser("python", parse_python)
register_parser("java", parse_java)


def _pieces(pdf: pd.DataFrame) -> Iterator[pd.DataFrame]:
    """Rows of ``pdf``, few files and about a million characters at a time: what is found in a file takes many times its size."""
    piece = pdf["content"].str.len().fillna(0).cumsum().floordiv(PIECE_CHARS).to_numpy()
    cuts = [0]
    for i in range(1, len(pdf)):
        if i - cuts[-1] >= PIECE_FILES or piece[i] != piece[i - 1]:
            cuts.append(i)
    for a, b in zip(cuts, [*cuts[1:], len(pdf)], strict=True):
        yield pdf.iloc[a:b]


def parse_files(files: DataFrame) -> DataFrame:
    """Rows of ``files`` (repo, path, language, content) with what they declare; a file that
    cannot be parsed has its error, and nothing else fails for it."""
    parsers = dict(_parsers)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in (part for whole in batches for part in _pieces(whole)):
            rows = []
            for repo, path, language, content in zip(pdf["repo"], pdf["path"], pdf["language"], pdf["content"], strict=True):
                parse, error = parsers.get(language), None
                found: tuple[list, list, list, dict] = ([], [], [], {})
                if parse is None or content is None:
                    error = "no parser" if parse is None else "no content"
                else:
                    try:
                        found = parse(content)
                    except (ValueError, RecursionError, IndexError) as e:
                        error = str(e)
                rows.append((repo, path, language, *found, error))
            yield pd.DataFrame(rows, columns=["repo", "path", "language", "functions", "classes", "imports", "calls", "error"])

    # By the plan a file's results are as small as its row in the table it came from, so Spark would send
    # what is made of them through the driver in broadcasts. The hint holds up to the next join.
    return files.select("repo", "path", "language", "content").mapInPandas(run, SCHEMA).hint("merge")


def entities(parsed: DataFrame) -> DataFrame:
    """One row for each function, class and file, with its stable id; files are parsed once for all."""
    null = lambda name, kind: F.lit(None).cast(kind).alias(name)
    path, kind = F.col("path"), lambda x: F.lit(x).alias("entity_type")
    listed = lambda c, of: F.coalesce(F.transform(c, of), F.array())
    fn = listed("functions", lambda f: F.struct(kind("function"), f["name"].alias("name"), f["class_name"].alias("class_name"), f["start_line"].alias("start_line"), f["end_line"].alias("end_line"), f["signature"].alias("signature"), f["docstring"].alias("docstring"), f["body"].alias("body"), stable_id(F.col("repo"), path, f["name"], f["start_line"]).alias("id")))
    cls = listed("classes", lambda c: F.struct(kind("class"), c["name"].alias("name"), c["name"].alias("class_name"), c["start_line"].alias("start_line"), c["end_line"].alias("end_line"), F.concat(F.lit("class "), c["name"]).alias("signature"), c["docstring"].alias("docstring"), null("body", "string"), stable_id(F.col("repo"), path, c["name"]).alias("id")))
    file = F.array(F.struct(kind("file"), F.element_at(F.split(path, "/"), -1).alias("name"), null("class_name", "string"), null("start_line", "int"), null("end_line", "int"), null("signature", "string"), null("docstring", "string"), null("body", "string"), stable_id(F.col("repo"), path).alias("id")))
    return parsed.select("repo", path.alias("file_path"), "language", F.explode(F.concat(fn, cls, file)).alias("e")).select("repo", "file_path", "language", "e.*")


def call_pairs(parsed: DataFrame) -> DataFrame:
    """(repo, caller id, callee name); of functions with one name in a file the last one calls."""
    last = parsed.select("repo", "path", F.explode("functions").alias("f")).groupBy("repo", "path", F.col("f.name").alias("caller_name")).agg(F.max("f.start_line").alias("start_line"))
    pairs = parsed.select("repo", "path", F.explode("calls").alias("caller_name", "names")).select("repo", "path", "caller_name", F.explode("names").alias("callee"))
    return pairs.join(last, ["repo", "path", "caller_name"]).select("repo", stable_id(F.col("repo"), F.col("path"), F.col("caller_name"), F.col("start_line")).alias("caller"), "callee")


def embedding_texts(all_entities: DataFrame, with_methods: DataFrame, parsed: DataFrame) -> DataFrame:
    """(id, text) to embed: functions by signature, docstring and body; classes by name,
    docstring and method signatures; files by path, imports and contents."""
    line = lambda c: F.when(F.coalesce(c, F.lit("")) != "", c)
    fn = all_entities.filter(F.col("entity_type") == "function").select("id", F.concat_ws("\n", line(F.col("signature")), line(F.col("docstring")), line(F.col("body"))).alias("text"))
    cls = with_methods.select("id", F.concat_ws("\n", F.concat(F.lit("class "), "name"), line(F.col("docstring")), F.array_join("methods", "\n")).alias("text"))
    free = F.transform(F.filter("functions", lambda f: f["class_name"].isNull()), lambda f: f["name"])
    contents = F.concat(F.transform("classes", lambda c: c["name"]), free)
    file = parsed.select(stable_id(F.col("repo"), F.col("path")).alias("id"), F.concat_ws("\n", F.concat(F.lit("File: "), "path"), F.array_join("imports", "\n"), F.array_join(contents, ", ")).alias("text"))
    return fn.union(cls).union(file)


def diff_entities(diffs: DataFrame) -> DataFrame:
    """(id, diff) to (id, file_path, line, text): added lines with their new line numbers,
    and the context of their hunk."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for key, diff in zip(pdf["id"], pdf["diff"], strict=True):
                path, at, context = None, 0, ""
                for row in (diff or "").split("\n"):
                    if row.startswith("diff --git"):
                        path = row.split(" b/")[-1]
                    elif row.startswith("+++ b/"):
                        path = row[6:]
                    elif m := re.match(r"@@ -\d+(?:,\d+)? \+(\d+)(?:,\d+)? @@ ?(.*)", row):
                        at, context = int(m[1]), m[2]
                    elif row.startswith("+") and not row.startswith("+++"):
                        out.append((key, path, at, context))
                        at += 1
                    elif not row.startswith("-"):
                        at += 1
            yield pd.DataFrame(out, columns=["id", "file_path", "line", "context"])

    return diffs.select(F.col("id").cast("string").alias("id"), "diff").mapInPandas(run, "id string, file_path string, line int, context string")


def diff_hunks(diffs: DataFrame) -> DataFrame:
    """(id, diff) to (id, seq, file_path, context, lines): each hunk with the new numbers of its
    added lines; a file also has one row without a context."""

    def rows(diff: str) -> Iterator[list]:
        path, hunk, at = None, None, 0
        for row in diff.split("\n"):
            if row.startswith(("diff --git", "+++ b/")):
                path = row.split(" b/")[-1] if row.startswith("diff") else row[6:].strip()
                hunk = [path, None, []]
                yield hunk
            elif m := re.match(r"@@ -\d+(?:,\d+)? \+(\d+)(?:,\d+)? @@\s*(.*)", row):
                at, hunk = int(m[1]), [path, m[2], []]
                yield hunk
            elif row.startswith("+") and not row.startswith("+++"):
                if hunk is not None:
                    hunk[2].append(at)
                at += 1
            elif row.startswith(" "):
                at += 1

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = [(key, i, *hunk) for key, diff in zip(pdf["id"], pdf["diff"], strict=True) for i, hunk in enumerate(list(rows(diff or "")))]
            yield pd.DataFrame(out, columns=["id", "seq", "file_path", "context", "lines"])

    return diffs.select(F.col("id").cast("string").alias("id"), "diff").mapInPandas(run, "id string, seq int, file_path string, context string, lines array<int>")
