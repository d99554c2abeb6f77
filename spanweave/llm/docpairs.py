"""Problem 1: functions paired with their documentation.

Method. Each function record is parsed: its docstring, or failing that its description, documents it unless it
says nothing. Class headers give the hierarchy; methods left without documentation, or whose docstring only
carries an inheritance tag, are joined round by round with the method they override in the classes above, and
the nearest documentation resolves to them. What no round resolves is dropped. One operator, `pairs`, gives all rows:
its pairs of own documentation are what p1_found asks for, its pairs of any are p1_pairs.

Classes are told apart by file. A base is the class of that name in the same file; else the one that the file imports
under the name, from the file of the module; else, if the file imports no such name, the only class of that name in the
graph. A base of several possible files is the first by path; one that is none of these is outside.

Defined cases: a null, cut off or unparsable snippet gives no pair; null name, description, parent or graph
never fail (a method without class inherits nothing); repeated records each count; the snippet decides where
both docstring and description say something; a cycle in the hierarchy ends where nothing new is met.
"""

from __future__ import annotations

import ast
import re
import warnings
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanweave.llm.badfiles import clean_path

#: Words of notices and placeholders (fixed values). One of the first kind must occur.
NOTICE = frozenset("description descriptions docstring docstrings documentation doc docs documented undocumented todo tbd fixme xxx placeholder stub summary na none llm unavailable missing null nil empty wip tba".split())
NOTICE_FILL = frozenset("no not n a the this is yet add here goes write later available provided given error could generate generated generating generation failed request timed out be was for to of and please fill in auto automatically long short extended timeout none exist exists found model response document describe me your text function method".split())
#: Words that add nothing to a function's own name (fixed values).
FILLER = frozenset("the a an this that function method will does is it of to for and in on".split())
TYPE_WORDS = frozenset("int str float bool list dict tuple set bytes none any optional object callable self cls type".split())
INHERIT = re.compile(r"\{@inheritDoc\}|:inherit(?:ed)?-?doc:|@inheritdoc|^\s*(?:see|inherited from) (?:the )?(?:base|parent|super)\s?class\.?\s*$|^\s*inherited\.?\s*$", re.I)
WORD = re.compile(r"[^\W_]+")
HUMP = re.compile(r"(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])")
SECTION = re.compile(r"^\s*(?:args|arguments|parameters|params|returns?|raises|yields|keyword arguments|other parameters|rtype|attributes)\s*:?\s*$", re.I)
RULE = re.compile(r"^\s*[-=~^]{3,}\s*$")
FIELD = re.compile(r"^\s*[:@](?:param|parameter|arg|argument|type|key|keyword|return|returns|rtype|raise|raises|yield|yields)\b\s*([\w*]*)\s*(?:\w+\s*)?:?(.*)$", re.I)
ENTRY = re.compile(r"^\s*\*{0,2}(\w+)\s*(?:\(([^)]*)\))?\s*:(.*)$")


def plain_words(text: str) -> list[str]:
    """The words in lower case; a name in mixed case counts as the words it is put together from."""
    return [w.lower() for w in WORD.findall(HUMP.sub(" ", text))]


def own_words(name: str | None) -> set[str]:
    """The words of a function's or class's own name, and the name as one word."""
    words = plain_words(re.sub(r"\(.*$", "", (name or "").strip()).rpartition(".")[2])
    return {*words, "".join(words)}


def _adds_nothing(words: list[str], own: set[str]) -> bool:
    rest = [w for w in words if w not in FILLER and w not in own and not (w.endswith("s") and (w[:-1] in own or w[:-2] in own and w.endswith("es")))]
    return not rest


def says_nothing(text: str | None, name: str | None) -> bool:
    """Null, blank, punctuation, a placeholder or notice, the function's own name, or an empty parameter form."""
    if text is None:
        return True
    words = plain_words(text)
    if not words:
        return True
    own = own_words(name)
    if _adds_nothing(words, own):
        return True
    joined = ["na" if re.fullmatch(r"\W*n\s*/\s*a\W*", text, re.I) else ""] + words
    if any(w in NOTICE for w in joined) and all(w in NOTICE or w in NOTICE_FILL or w in FILLER or w == "" or w in own for w in joined):
        return True
    if ":" not in text and "@" not in text and "---" not in text and "===" not in text:
        return False
    # without the lines of an empty form nothing may remain
    left: list[str] = []
    in_form = False
    for line in text.splitlines():
        if not line.strip() or RULE.match(line):
            continue
        if SECTION.match(line):
            in_form = True
            continue
        m = FIELD.match(line)
        if m or in_form and (m := ENTRY.match(line)):
            in_form = True
            subject = set(plain_words(m.group(1) or ""))
            said = plain_words(m.group(m.lastindex or 1) if m.lastindex and m.lastindex > 1 else "")
            left += [w for w in said if w not in subject and w not in TYPE_WORDS and w not in FILLER]
            continue
        head = re.match(r"^\s*(?:args|arguments|parameters|params|returns?)\s*:(.*)$", line, re.I)
        if head:
            in_form = True
            left += plain_words(head.group(1))
            continue
        left += plain_words(line)
    return not left or _adds_nothing(left, own)


def parse_definition(snippet: str | None) -> ast.AST | None:
    """The definition a snippet holds, or None if it is null or not whole."""
    if snippet is None or not snippet.strip():
        return None
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        for text in (snippet, "if 1:\n" + snippet if snippet[:1] in " \t" else None):
            if text is None:
                continue
            try:
                body = ast.parse(text).body
            except (SyntaxError, ValueError, RecursionError, MemoryError):
                continue
            node = body[0].body[0] if text is not snippet else body[0]
            if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                return node
    return None


def docstring(node: ast.AST) -> str | None:
    """The first statement, if it is a plain string (formatted strings, bytes and later strings are none)."""
    first = node.body[0]
    if isinstance(first, ast.Expr) and isinstance(first.value, ast.Constant) and isinstance(first.value.value, str):
        return first.value.value
    return None


def simple_name(c: Column) -> Column:
    """Without blanks, brackets after it, or the class before it."""
    return F.regexp_extract(F.regexp_replace(F.trim(c), r"\s*\(.*$", ""), r"([^.]*)$", 1)


def documented(entities: DataFrame, keep: Sequence[str] = ("name", "entity_type", "snippet")) -> DataFrame:
    """Every Function record with: whole (bool), documentation (null if nothing says anything), doc_from
    (docstring, description or null), inherits (the docstring only refers to the base), and `keep`. A narrow map; only the
    function rows and the columns named here are read."""
    src = entities.where(F.col("entity_type") == "Function").select("rec_id", "graph_id", clean_path(F.col("source_file")).alias("file"), "name", "entity_type", "parent_type", "parent_name", "snippet", "description")
    back = [c for c in src.columns if c in keep or c in ("rec_id", "graph_id", "file", "name", "parent_type", "parent_name")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            whole, docs, whence, tags = [], [], [], []
            for name, snippet, desc in zip(*(b.column(c).to_pylist() for c in ("name", "snippet", "description"))):
                node = parse_definition(snippet)
                ok = node is not None and not isinstance(node, ast.ClassDef)
                text = docstring(node) if ok else None
                tag = bool(text and INHERIT.search(text))
                if not ok:
                    got = (None, None)
                elif text is not None and not tag and not says_nothing(text, name):
                    got = (text, "docstring")
                elif not says_nothing(desc, name):
                    got = (desc, "description")
                else:
                    got = (None, None)
                whole.append(ok)
                docs.append(got[0])
                whence.append(got[1])
                tags.append(tag)
            cols = [b.column(c) for c in back] + [pa.array(whole, pa.bool_()), pa.array(docs, pa.string()), pa.array(whence, pa.string()), pa.array(tags, pa.bool_())]
            yield pa.RecordBatch.from_arrays(cols, names=[*back, "whole", "documentation", "doc_from", "inherits"])

    schema = f"{', '.join(f'{f.name} {f.dataType.simpleString()}' for f in src.schema if f.name in back)}, whole boolean, documentation string, doc_from string, inherits boolean"
    return src.mapInArrow(run, schema)


#: String literals and comments of a header; the pieces of a base list; what opens a class.
LITERAL = re.compile(r"\"\"\".*?\"\"\"|\'\'\'.*?\'\'\'|\"(?:\\.|[^\"\\\n])*\"|\'(?:\\.|[^\'\\\n])*\'|#[^\n]*", re.S)
CLASS_HEAD = re.compile(r"^\s*(?:@[^\n]*\n\s*)*class\s+(\w+)\s*")


def base_names(snippet: str | None) -> tuple[str, list[str]]:
    """The class name of a header and the names of its bases, dotted as they stand there, in order: a balanced scan, so that a header of a cut-off
    class counts too. with_metaclass(M, Base), under any name that begins so, gives the bases after M; what another
    call returns is unknown and gives none; a subscript gives the name before it, keywords none. A list that doesn't
    close gives none."""
    m = CLASS_HEAD.match(snippet or "")
    if not m:
        return "", []
    text = LITERAL.sub(lambda x: " " if x.group()[0] == "#" else "0", snippet[m.end() :])
    if text[:1] == "[":  # type parameters
        depth = 0
        for i, c in enumerate(text):
            depth += (c in "([{") - (c in ")]}")
            if not depth:
                text = text[i + 1 :].lstrip()
                break
    if text[:1] != "(":
        return m.group(1), []
    depth, parts, closed = 0, [""], False
    for c in text:
        depth -= c in ")]}"
        if not depth and c == ")":
            closed = True
            break
        if c == "," and depth == 1:
            parts.append("")
        elif depth:
            parts[-1] += c
        depth += c in "([{"
    names: list[str] = []

    def read(part: str) -> None:
        part = part.strip()
        if re.match(r"\w+\s*=(?!=)|\*", part):
            return
        name = re.match(r"((?:\w+\s*\.\s*)*)([^\W\d]\w*)\s*", part)
        if not name:
            return
        rest = part[name.end() :]
        if rest[:1] != "(":
            names.append(re.sub(r"\s", "", name.group(1)) + name.group(2))
        elif re.match(r"with_?meta", name.group(2), re.I) and rest.endswith(")"):
            depth, inner = 0, [""]
            for c in rest[1:-1]:
                depth += (c in "([{") - (c in ")]}")
                if c == "," and not depth:
                    inner.append("")
                else:
                    inner[-1] += c
            for x in inner[1:]:
                read(x)

    for part in parts if closed else []:
        read(part)
    return m.group(1), list(dict.fromkeys(names))


def classes(entities: DataFrame) -> DataFrame:
    """(graph_id, file, class_name, bases): the Class records by file, with the bases of their headers as they stand
    there. A row per different header."""
    c = entities.where((F.col("entity_type") == "Class") & F.col("graph_id").isNotNull() & F.col("source_file").isNotNull())
    c = c.select("graph_id", clean_path(F.col("source_file")).alias("file"), simple_name(F.col("name")).alias("name"), "snippet").distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [base_names(s) for s in b.column("snippet").to_pylist()]
            names = [n or own for (n, _), own in zip(got, b.column("name").to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column("graph_id"), b.column("file"), pa.array(names, pa.string()), pa.array([x for _, x in got], pa.list_(pa.string()))], names=["graph_id", "file", "class_name", "bases"])

    return c.mapInArrow(run, "graph_id string, file string, class_name string, bases array<string>").where("class_name <> ''")


def imported_names(entities: DataFrame) -> DataFrame:
    """(graph_id, file, local, original, module): what `from module import original as local` gives a file."""
    i = entities.where("entity_type = 'ImportFrom' and graph_id is not null and source_file is not null and imported_items is not null")
    i = i.select("graph_id", clean_path(F.col("source_file")).alias("file"), F.coalesce("module_name", "name").alias("module"), F.explode("imported_items").alias("item"))
    parts = F.split(F.trim("item"), r"\s+(?:as\s+)?")
    return i.select("graph_id", "file", F.get(parts, F.size(parts) - 1).alias("local"), F.get(parts, F.lit(0)).alias("original"), F.regexp_replace("module", r"^\.+", "").alias("module")).distinct()


def resolved_bases(found_classes: DataFrame, imports: DataFrame) -> DataFrame:
    """(graph_id, file, class_name, ord, base_file, base): the direct bases that are classes of the graph, each once."""
    known = found_classes.select("graph_id", "file", "class_name").distinct()
    b = found_classes.select("graph_id", "file", "class_name", F.posexplode("bases").alias("ord", "full"))
    b = b.groupBy("graph_id", "file", "class_name", "full").agg(F.min("ord").alias("ord"))
    b = b.withColumn("base", F.substring_index("full", ".", -1)).withColumn("via", F.when(F.contains("full", F.lit(".")), F.substring_index(F.substring_index("full", ".", -2), ".", 1)))
    target = known.select("graph_id", F.col("file").alias("base_file"), F.col("class_name").alias("base"))
    # in the same file
    here = b.where("via is null and base <> class_name").join(known.select("graph_id", "file", F.col("class_name").alias("base")), ["graph_id", "file", "base"])
    here = here.select("graph_id", "file", "class_name", "ord", "full", F.col("file").alias("base_file"), "base")
    away = b.join(here.select("graph_id", "file", "class_name", "full"), ["graph_id", "file", "class_name", "full"], "left_anti")
    # imported, or written with its module: the last step of the module is the file's name, the rest its folders
    stem = F.regexp_replace(F.regexp_replace("base_file", r"(?i)\.py$", ""), "/__init__$", "")
    at = target.withColumn("dotted", F.translate(stem, "/", ".")).withColumn("step", F.substring_index("dotted", ".", -1))
    named = away.where("via is null").join(imports.withColumnRenamed("local", "base"), ["graph_id", "file", "base"])
    wanted = named.select("graph_id", "file", "class_name", "ord", "full", F.col("original").alias("base"), "module").unionByName(away.where("via is not null").select("graph_id", "file", "class_name", "ord", "full", "base", F.col("via").alias("module")))
    met = wanted.withColumn("step", F.substring_index("module", ".", -1)).join(at, ["graph_id", "base", "step"])
    met = met.where((F.col("dotted") == F.col("module")) | F.endswith("dotted", F.concat(F.lit("."), F.col("module"))))
    # neither: the only class of the name
    only = target.groupBy("graph_id", "base").agg(F.min("base_file").alias("base_file"), F.count(F.lit(1)).alias("n")).where("n = 1").drop("n")
    rest = away.where("via is null and base <> class_name").join(named.select("graph_id", "file", "base").distinct(), ["graph_id", "file", "base"], "left_anti").join(only, ["graph_id", "base"])
    every = here.unionByName(met.select(here.columns)).unionByName(rest.select(here.columns)).where("not (base_file = file and base = class_name)")
    return every.groupBy("graph_id", "file", "class_name", "base_file", "base").agg(F.min("ord").alias("ord"))


def pairs(entities: DataFrame, keep: Sequence[str] = ("name", "entity_type", "snippet")) -> DataFrame:
    """(rec_id, `keep`, documentation, doc_from, doc_class): whole functions with documentation of their own (docstring
    or description) or inherited from the nearest class above that documents the method.

    Each round is one join of the shrinking unresolved methods with the bases and with one documentation per
    (graph, file, class, method); per step up the first base in the header wins. Rounds go on until no unresolved method
    comes to a class it has not been at, so a hierarchy of any height is climbed and a cycle ends. Lineage is cut
    after each round."""
    from spanweave.session import cut_lineage

    own = documented(entities, keep).where("whole").select("rec_id", *keep, "documentation", "doc_from", "graph_id", "file", F.col("parent_type") == "Class", simple_name(F.col("parent_name")).alias("cls"), simple_name(F.col("name")).alias("m"))
    own = cut_lineage(own.toDF("rec_id", *keep, "documentation", "doc_from", "graph_id", "file", "of_class", "cls", "m"))
    got = own.where("documentation is not null").select("rec_id", *keep, "documentation", "doc_from", F.lit(None).cast("string").alias("doc_class"))
    bases = cut_lineage(resolved_bases(cut_lineage(classes(entities)), imported_names(entities)))
    method = own.where("of_class and cls is not null and m is not null and graph_id is not null and file is not null")
    key = ["graph_id", "file", "cls"]
    # only methods of classes with a base in the graph climb
    todo = method.where("documentation is null").select("rec_id", "m", *key).join(bases.select("graph_id", "file", F.col("class_name").alias("cls")), key, "left_semi")
    seen = todo = cut_lineage(todo)
    known = method.where("documentation is not null").groupBy(*key, "m").agg(F.min_by("documentation", F.struct(F.col("doc_from") != "docstring", "rec_id")).alias("inherited"))
    solved = None
    while not todo.isEmpty():
        # one row per (class, base): a hot class meets its few bases, not other rows of its own
        up = todo.join(bases.withColumnRenamed("class_name", "cls"), key).select("rec_id", "m", "graph_id", F.col("base_file").alias("file"), F.col("base").alias("cls"), "ord")
        step = cut_lineage(up.join(known, [*key, "m"], "left"))
        hit = step.where("inherited is not null").groupBy("rec_id").agg(F.min_by(F.struct("inherited", "cls"), F.struct("ord", "cls", "file")).alias("h"))
        solved = hit if solved is None else solved.unionByName(hit)
        todo = step.join(hit, "rec_id", "left_anti").select("rec_id", "m", *key).distinct()
        todo = cut_lineage(todo.join(seen.select("rec_id", *key), ["rec_id", *key], "left_anti"))
        seen = seen.unionByName(todo)
    if solved is None:
        return got
    more = own.join(solved, "rec_id").select("rec_id", *keep, F.col("h.inherited").alias("documentation"), F.lit("inherited").alias("doc_from"), F.col("h.cls").alias("doc_class"))
    return got.unionByName(more)


def documentation_pairs(entities: DataFrame) -> DataFrame:
    return pairs(entities)


def found(entities: DataFrame) -> DataFrame:
    """(rec_id) of the pairs whose documentation is the record's own."""
    return pairs(entities, ()).where("doc_from <> 'inherited'").select("rec_id")
