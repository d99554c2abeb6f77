"""Python sources to entity rows, by the standard library's syntax tree.

A file with errors keeps what can be read: it is taken apart into its top-level blocks, and in a block that does not
parse the lines at fault are left out one by one.

Rows come in pre-order: imports, classes, functions, decorated definitions (as a row of their own before the
definition) and calls, each with its place in lines and UTF-8 bytes and its nearest enclosing definition."""

from __future__ import annotations

import ast
import warnings
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanweave.schemas import ENTITY_DDL


def call_name(node: ast.AST, text: str) -> str:
    """Dotted name of what is called: names and attributes; a call stands for its function; all else for its text."""
    if isinstance(node, ast.Name):
        return node.id
    if isinstance(node, ast.Attribute):
        return f"{call_name(node.value, text)}.{node.attr}"
    if isinstance(node, ast.Call):
        return call_name(node.func, text)
    return ast.get_source_segment(text, node) or ""


def _tidy(name: str) -> str:
    kept = "".join(c if c.isalnum() or c in "_.-" else "_" for c in name)
    return ".".join(p for p in kept.split(".") if p)


class _Walker:
    def __init__(self, text: str):
        self.text = text
        self.bytes = text.encode("utf-8")
        starts = [0]
        for line in self.bytes.split(b"\n"):
            starts.append(starts[-1] + len(line) + 1)
        self.line_at = starts
        self.rows: list[dict] = []

    def row(self, kind: str, name: str, node: ast.AST, scope: list[tuple[str, str]], first: ast.AST | None = None, **more: object) -> None:
        top = first or node
        start = self.line_at[top.lineno - 1] + top.col_offset - (1 if first is not None else 0)  # a decorator's sign
        end = self.line_at[node.end_lineno - 1] + node.end_col_offset
        self.rows.append({
            "seq": len(self.rows), "entity_type": kind, "name": _tidy(name) or kind.lower(), "start_line": top.lineno, "end_line": node.end_lineno, "start_byte": start, "end_byte": end,
            "snippet": self.bytes[start:end].decode("utf-8", "ignore"), "parent_type": scope[-1][0] if scope else None, "parent_name": scope[-1][1] if scope else None,
            "module_name": more.get("module"), "imported_items": more.get("items"),
        })

    def visit(self, node: ast.AST, scope: list[tuple[str, str]]) -> None:
        inner = scope
        if isinstance(node, ast.Import):
            self.row("Import", node.names[0].name, node, scope, items=[a.name if not a.asname else f"{a.name} as {a.asname}" for a in node.names])
        elif isinstance(node, ast.ImportFrom):
            module = "." * node.level + (node.module or "")
            self.row("ImportFrom", module, node, scope, module=module, items=[a.name if not a.asname else f"{a.name} as {a.asname}" for a in node.names])
        elif isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
            kind = "Class" if isinstance(node, ast.ClassDef) else "Function"
            if node.decorator_list:
                self.row("DecoratedDefinition", node.name, node, scope, first=node.decorator_list[0])
            for d in node.decorator_list:
                self.visit(d, scope)
            self.row(kind, node.name, node, scope)
            inner = [*scope, (kind, node.name)]
        elif isinstance(node, ast.Call):
            self.row("Call", call_name(node.func, self.text), node, scope)
        for child in ast.iter_child_nodes(node):
            if child in getattr(node, "decorator_list", ()):
                continue
            self.visit(child, inner)


#: Lines left out of one block before the whole block is.
MOST_REPAIRS = 20


def _tree(text: str) -> ast.AST | None:
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            return ast.parse(text)
    except (ValueError, RecursionError, MemoryError):
        return None


def repaired(block: str) -> ast.AST | None:
    """The tree of a block without the lines at fault, on the same lines and columns. A line left out becomes `pass`, or,
    if it opened a block, `if 1:`; after MOST_REPAIRS lines the block is given up."""
    lines = block.split("\n")
    left_out: set[int] = set()
    for _ in range(MOST_REPAIRS + 1):
        try:
            return _tree("\n".join(lines))
        except SyntaxError as e:
            at = min(max((e.lineno or 1) - 1, 0), len(lines) - 1)
        # the line named; if that was left out before, the nearest line above that was not, else below
        order = [*range(at, -1, -1), *range(at + 1, len(lines))]
        at = next((i for i in order if i not in left_out and lines[i].strip()), None)
        if at is None:
            return None
        indent = lines[at][: len(lines[at]) - len(lines[at].lstrip())]
        opens = lines[at].rstrip().endswith(":") or at + 1 < len(lines) and len(lines[at + 1]) - len(lines[at + 1].lstrip()) > len(indent) and bool(lines[at + 1].strip())
        lines[at] = indent + ("if 1:" if opens else "pass")
        left_out.add(at)
    return None


def trees(text: str) -> list[ast.AST]:
    """The tree of a file, or those of its blocks if the file does not parse. A block starts at a line at the margin;
    a decorator belongs to what follows, a closing bracket or `else` to what precedes."""
    try:
        whole = _tree(text)
        return [whole] if whole is not None else []
    except SyntaxError:
        pass
    lines = text.split("\n")
    starts = [i for i, x in enumerate(lines) if x[:1].strip() and x[0] not in ")]}#" and not x.startswith(("else", "elif", "except", "finally"))]
    starts = [i for k, i in enumerate(starts) if not (k and lines[starts[k - 1]].startswith("@"))]
    out = []
    for lo, hi in zip(starts, [*starts[1:], len(lines)]):
        block = "\n".join(lines[lo:hi])
        try:
            tree = _tree(block)
        except SyntaxError:
            tree = repaired(block)
        if tree is not None:
            out.append(ast.increment_lineno(tree, lo))
    return out


def extract(text: str | None) -> list[dict]:
    """Entity rows of one file; none for null and blank text."""
    if not text or not text.strip():
        return []
    w = _Walker(text)
    for tree in trees(text):
        kept = len(w.rows)
        try:
            w.visit(tree, [])
        except (RecursionError, ValueError, IndexError):  # nested too deeply
            del w.rows[kept:]
    return w.rows


FIELDS = [f.strip().split(" ", 1) for f in ENTITY_DDL.split(", ")]


def extract_entities(files: DataFrame) -> DataFrame:
    """Entities of (graph_id, path, content), a narrow map over files."""
    kinds = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "array<string>": pa.list_(pa.string())}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [{"graph_id": g, "source_file": p, **r} for g, p, t in zip(*(b.column(c).to_pylist() for c in ("graph_id", "path", "content"))) for r in extract(t)]
            yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], kinds[k]) for n, k in FIELDS], names=[n for n, _ in FIELDS])

    return files.select("graph_id", "path", "content").mapInArrow(run, ENTITY_DDL)


def qualified_names(unique: DataFrame, root: str = "") -> DataFrame:
    """Module-qualified name of functions and classes; the first by place wins."""
    from spanweave.functions.text import module_path

    u = unique.where("entity_type in ('Function', 'Class')")
    parent = F.when(F.col("parent_name").isNotNull(), F.concat(F.col("parent_name"), F.lit("."))).otherwise(F.lit(""))
    q = F.concat(module_path(F.col("source_file"), root), F.lit("."), parent, F.col("name"))
    return u.groupBy("graph_id", q.alias("qualified_name")).agg(F.min_by("id", F.struct("source_file", "start_byte", "id")).alias("id"))
