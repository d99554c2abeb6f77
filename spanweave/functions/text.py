"""Scalar text expressions. Every function takes and returns Columns and stays in generated code.

Nulls give null unless a default is stated."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that keyword search ignores (fixed values).
STOP_WORDS = ["the", "and", "or", "in", "is", "to", "a", "of", "for", "with", "how"]
#: Prefix of descriptions that were never written (fixed value).
DEFAULT_DESCRIPTION = "Default description for"
#: Names that a call resolves to without a definition (fixed values).
BUILTINS = (
    "abs all any ascii bin bool breakpoint bytearray bytes callable chr classmethod compile complex delattr dict dir divmod enumerate eval exec "
    "filter float format frozenset getattr globals hasattr hash help hex id input int isinstance issubclass iter len list locals map max memoryview "
    "min next object oct open ord pow print property range repr reversed round set setattr slice sorted staticmethod str sum super tuple type vars zip "
    "__import__ Exception TypeError ValueError NameError IndexError KeyError AttributeError ImportError FileNotFoundError ZeroDivisionError "
    "True False None NotImplemented Ellipsis __debug__"
).split()


def clean_path(c: Column) -> Column:
    """Forward slashes, single, without blanks around; from `repos/` on where the path has it."""
    c = F.regexp_replace(F.translate(F.regexp_replace(c, r"^\s+|\s+$", ""), "\\", "/"), "/+", "/")
    return F.regexp_replace(c, r"^.*?(repos/)", "$1")


def sanitize_id(c: Column) -> Column:
    """Letters, digits, `_ . -` stay, all else becomes `_`; null becomes `unnamed`."""
    return F.coalesce(F.regexp_replace(c, r"[^\p{L}\p{N}_.\-]", "_"), F.lit("unnamed"))


def sanitize_name(c: Column, fallback: str = "unnamed") -> Column:
    """As sanitize_id, with empty dotted segments squeezed out; nothing left gives `fallback`."""
    s = F.regexp_replace(F.regexp_replace(F.regexp_replace(c, r"[^\p{L}\p{N}_.\-]", "_"), r"\.{2,}", "."), r"^\.|\.$", "")
    return F.coalesce(F.nullif(s, F.lit("")), F.lit(fallback))


def sanitize_path(c: Column) -> Column:
    return F.regexp_replace(c, r"[^\p{L}\p{N}_.\-/]", "_")


def sanitize_label(c: Column) -> Column:
    """A label of letters, digits and `_`; prefixed by `Type_` unless it starts in upper case; empty is UnknownEntity."""
    s = F.regexp_replace(c, r"[^\p{L}\p{N}_]", "_")
    return F.when(c.isNull() | (s == ""), F.lit("UnknownEntity")).when(s.rlike(r"^\p{Lu}"), s).otherwise(F.concat(F.lit("Type_"), s))


def sanitize_relationship(c: Column) -> Column:
    s = F.upper(F.regexp_replace(c, r"[^\p{L}\p{N}_]", "_"))
    return F.coalesce(F.nullif(s, F.lit("")), F.lit("RELATED_TO"))


def stable_id(prefix: Column, *key: Column) -> Column:
    """A content-derived id: the sanitised prefix and a digest of the key."""
    return F.concat(F.regexp_replace(prefix, r"[^\p{L}\p{N}_\-]", "_"), F.lit(":"), F.md5(F.concat_ws("\u0001", *(F.coalesce(k.cast("string"), F.lit("")) for k in key))))


def token_count(c: Column) -> Column:
    """Characters divided by 4, rounded down; 0 for null."""
    return F.coalesce(F.floor(F.length(c) / 4).cast("int"), F.lit(0))


def last_segment(c: Column) -> Column:
    return F.substring_index(c, ".", -1)


def entity_text(entity_type: Column, name: Column, source_file: Column, start_line: Column, parent_type: Column, parent_name: Column, description: Column) -> Column:
    """The text an entity is embedded by: type, name, place, context if any, description; one per line."""
    line = lambda label, v: F.concat(F.lit(label + ": "), F.coalesce(v.cast("string"), F.lit("N/A")), F.lit("\n"))
    context = F.when(parent_type.isNotNull() & parent_name.isNotNull(), F.concat(F.lit("Context: Defined within "), parent_type, F.lit(" '"), parent_name, F.lit("'\n"))).otherwise(F.lit(""))
    place = F.concat(F.lit("Source File: "), F.coalesce(source_file, F.lit("N/A")), F.lit(":"), F.coalesce(start_line.cast("string"), F.lit("N/A")), F.lit("\n"))
    return F.concat(line("Entity Type", entity_type), line("Name", name), place, context, line("Description", description))


def default_description(description: Column, entity_type: Column, name: Column) -> Column:
    return F.coalesce(description, F.concat(F.lit(DEFAULT_DESCRIPTION + " "), F.coalesce(entity_type, F.lit("")), F.lit(" '"), F.coalesce(name, F.lit("")), F.lit("'.")))


def change_type(query: Column) -> Column:
    """The kind of change a question asks for; the first rule that holds decides."""
    q = F.lower(query)
    has = lambda *ws: F.greatest(*[q.contains(w) for w in ws]) if len(ws) > 1 else q.contains(ws[0])
    return (
        F.when(has("add method", "new method"), "add_method").when(has("modify function", "change function"), "modify_function")
        .when(has("add feature", "new feature"), "add_feature").when(has("fix bug", "fix issue", "fix error"), "fix_bug")
        .when(has("refactor", "clean up"), "refactor").otherwise("other")
    )


INTENTS = ["general_question", "code_explanation", "change_request", "function_request"]


def intent_label(answer: Column) -> Column:
    """The first category named in a model's answer; general_question if none is."""
    a = F.lower(F.trim(answer))
    out = None
    for k in INTENTS:
        out = F.when(a.contains(k), k) if out is None else out.when(a.contains(k), k)
    return out.otherwise("general_question")


def keyword_intent(query: Column) -> Column:
    """Intent without a model: verbs of adding, changing and explaining."""
    q = F.lower(query)
    return (
        F.when(q.rlike(r"\b(add|create|implement|introduce|write)\b.*\b(function|method|class|feature|endpoint|test)"), "function_request")
        .when(q.rlike(r"\b(modify|change|refactor|fix|rename|remove|delete|replace|update)\b"), "change_request")
        .when(q.rlike(r"\b(how does|how do|explain|what does .* do|why does|where is|which functions)\b"), "code_explanation")
        .otherwise("general_question")
    )


def word_count(c: Column) -> Column:
    t = F.regexp_replace(c, r"^\s+|\s+$", "")
    return F.when(t == "", 0).otherwise(F.size(F.split(t, r"\s+")))


def dynamic_hops(query: Column, intent: Column, hops: Column) -> Column:
    """Hops by intent, else by the length of the question: over 15 words one more (3 at most), under 5 one less (1 at least)."""
    n = word_count(query)
    return (
        F.when(intent.isin("change_request", "function_request"), F.greatest(hops, F.lit(2)))
        .when(n > 15, F.least(hops + 1, F.lit(3))).when(n < 5, F.greatest(hops - 1, F.lit(1))).otherwise(hops)
    ).cast("int")


def keywords(query: Column) -> Column:
    """The words of a question in lower case without stop words, in order, each once."""
    words = F.regexp_extract_all(F.lower(query), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))
    return F.array_distinct(F.filter(words, lambda w: ~w.isin(*STOP_WORDS)))


def expanded_query(query: Column, answer: Column) -> Column:
    """The question and the first line of a model's expansion."""
    strip = lambda c: F.regexp_replace(c, r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")
    first = strip(F.substring_index(strip(F.coalesce(answer, F.lit(""))), "\n", 1))
    return F.when(first == "", query).otherwise(F.concat_ws(" ", query, first))


def gated_description(description: Column, label: Column, name: Column, gate: int = 20, cut: int = 300) -> Column:
    """A description longer than `gate`, cut to `cut` characters, else label and name."""
    return F.when(F.length(description) > gate, F.substring(description, 1, cut)).otherwise(F.concat_ws(" ", label, name))


def special_term(entity_type: Column, name: Column) -> Column:
    """Type and name as a search term; null unless both are there."""
    return F.when((F.trim(entity_type) != "") & (F.trim(name) != ""), F.concat_ws(" ", entity_type, name))


def relationship_priority(rel_type: Column) -> Column:
    return F.when(rel_type == "CONTAINS_METHOD", 5).when(rel_type == "CALLS", 4).when(rel_type == "CONTAINS", 3).when(rel_type == "IMPORTS", 2).otherwise(1)


def indent(line: Column) -> Column:
    return F.length(line) - F.length(F.regexp_replace(line, r"^\s+", ""))


def module_path(path: Column, root: str = "") -> Column:
    """Dotted module of a Python path: root, extension and `__init__` removed."""
    p = F.regexp_replace(clean_path(path), "^" + root.strip("/") + "/", "") if root else clean_path(path)
    return F.regexp_replace(F.translate(F.regexp_replace(p, r"(?i)\.py$", ""), "/", "."), r"\.?__init__$", "")


def score_color(score: Column) -> Column:
    return F.when(score >= 7, "green").when(score >= 4, "orange").otherwise("red")


def day_month_year(ts: Column) -> Column:
    return F.date_format(ts, "dd/MM/yyyy")


def markdown_html(c: Column) -> Column:
    """The small part of Markdown that answers use, as HTML, by replacements in a fixed order."""
    rules = [
        (r"(?s)```(\w*)\n(.*?)```", "<pre><code class=\"$1\">$2</code></pre>"), (r"`([^`\n]+)`", "<code>$1</code>"),
        (r"(?m)^### (.*)$", "<h3>$1</h3>"), (r"(?m)^## (.*)$", "<h2>$1</h2>"), (r"(?m)^# (.*)$", "<h1>$1</h1>"),
        (r"\*\*([^*\n]+)\*\*", "<strong>$1</strong>"), (r"\*([^*\n]+)\*", "<em>$1</em>"), (r"(?m)^[-*] (.*)$", "<li>$1</li>"), (r"\n", "<br>"),
    ]
    for pattern, to in rules:
        c = F.regexp_replace(c, pattern, to)
    return c
