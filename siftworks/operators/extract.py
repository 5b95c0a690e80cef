"""Fact extraction from source files as one Spark job: declarations, calls, control regions, headers and coverage.

Python is parsed by the standard library's ast (whose columns are UTF-8 bytes already) in Arrow batches; a syntax error
fails its own document alone, and other languages get a coverage row that says so.
"""

from __future__ import annotations

import ast
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A declaration's header, in order of its source; kinds of parameters: positional, plain, variadic, keyword, keywords.
HEADER = "struct<modifiers:array<string>,type_parameters:array<string>,parameters:array<struct<name:string,kind:string>>,result:string,bases:array<string>>"
FACTS = f"tag string, path string, kind string, name string, owner string, start long, end long, detail string, header {HEADER}"
_REGIONS = {ast.If: "branch", ast.For: "loop", ast.While: "loop", ast.Try: "try", ast.With: "with", ast.Match: "branch", ast.AsyncFor: "loop", ast.AsyncWith: "with"}


class _Walk(ast.NodeVisitor):
    """Rows of one document; owner is the dotted name of the enclosing declaration, empty for the module."""

    def __init__(self, path: str, source: bytes):
        self.path, self.rows, self.owner, self.within = path, [], [], []
        at, self.starts = 0, []
        for line in source.splitlines(keepends=True):
            self.starts.append(at)
            at += len(line)

    def add(self, tag: str, kind: str, name: str | None, node: ast.AST, header: dict | None = None) -> None:
        start = self.starts[node.lineno - 1] + node.col_offset
        end = self.starts[node.end_lineno - 1] + node.end_col_offset
        self.rows.append((tag, self.path, kind, name, ".".join(self.owner), start, end, None, header))

    def declared(self, node, kind: str, parameters: list[dict], result: str | None, bases: list[str]) -> None:
        modifiers = [ast.unparse(d) for d in node.decorator_list] + (["async"] if isinstance(node, ast.AsyncFunctionDef) else [])
        types = [ast.unparse(t) for t in getattr(node, "type_params", [])]
        self.add("declaration", kind, node.name, node, {"modifiers": modifiers, "type_parameters": types, "parameters": parameters, "result": result, "bases": bases})
        self.owner.append(node.name)
        self.within.append(type(node))
        self.generic_visit(node)
        self.within.pop()
        self.owner.pop()

    def visit_ClassDef(self, node):
        named = [f"{k.arg}={ast.unparse(k.value)}" if k.arg else f"**{ast.unparse(k.value)}" for k in node.keywords]
        self.declared(node, "class", [], None, [ast.unparse(b) for b in node.bases] + named)

    def visit_FunctionDef(self, node):
        a = node.args
        groups = ((a.posonlyargs, "positional"), (a.args, "plain"), ([a.vararg] if a.vararg else [], "variadic"), (a.kwonlyargs, "keyword"), ([a.kwarg] if a.kwarg else [], "keywords"))
        parameters = [{"name": x.arg, "kind": kind} for args, kind in groups for x in args]
        kind = "method" if self.within and self.within[-1] is ast.ClassDef else "function"
        self.declared(node, kind, parameters, ast.unparse(node.returns) if node.returns else None, [])

    visit_AsyncFunctionDef = visit_FunctionDef

    def visit_Call(self, node):
        self.add("call", "call", ast.unparse(node.func), node)
        self.generic_visit(node)

    def generic_visit(self, node):
        kind = _REGIONS.get(type(node))
        if kind:
            self.add("region", kind, None, node)
        super().generic_visit(node)


def _extract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = ["tag", "path", "kind", "name", "owner", "start", "end", "detail", "header"]
    for batch in batches:
        rows = []
        for path, lang, data in zip(batch["path"], batch["language"], batch["bytes"], strict=True):
            if lang != "python":
                rows.append(("coverage", path, "unsupported", None, "", None, None, lang, None))
                continue
            try:
                walk = _Walk(path, bytes(data))
                walk.visit(ast.parse(bytes(data)))
                rows += walk.rows
                rows.append(("coverage", path, "complete", None, "", None, None, lang, None))
            except (SyntaxError, ValueError, RecursionError, IndexError) as e:
                rows.append(("coverage", path, "failed", None, "", None, None, type(e).__name__, None))
        yield pd.DataFrame(rows, columns=names).astype({"start": "Int64", "end": "Int64"})


def extract_facts(docs: DataFrame) -> DataFrame:
    """tag (declaration, call, region or coverage), path, kind, name, owner, start, end, detail (of coverage), header (of
    declarations) of documents (path, language, bytes). Nothing is shuffled."""
    return docs.select("path", "language", "bytes").mapInPandas(_extract, FACTS)


def header_facts(facts: DataFrame) -> DataFrame:
    """path, owner, name, kind, start and the header's parts as columns, of each declaration."""
    return facts.filter("tag = 'declaration'").select("path", "owner", "name", "kind", "start", "header.*")
