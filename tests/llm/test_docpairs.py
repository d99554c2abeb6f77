import datetime as dt

import pytest

from spanweave.llm import docpairs as D

DDL = "rec_id long, graph_id string, id string, entity_type string, name string, source_file string, start_byte int, snippet string, parent_type string, parent_name string, description string, indexed_at timestamp, extra string, whole string, module_name string, imported_items array<string>"


def rows(*xs):
    out = []
    for i, x in enumerate(xs):
        base = dict(rec_id=i, graph_id="g", id=str(i), entity_type="Function", name="f", source_file="repos/a.py", start_byte=0, snippet=None, parent_type=None, parent_name=None, description=None, indexed_at=dt.datetime(2025, 1, 1), extra="x", whole="clash", module_name=None, imported_items=None)
        out.append(tuple({**base, **x}.values()))
    return out


@pytest.mark.parametrize("text,name,nothing", [
    (None, "f", True), ("", "f", True), ("  \n", "f", True), ("---", "f", True), ("TODO", "f", True), ("TODO: write docs", "f", True), ("N/A", "f", True), ("[LLM unavailable]", "f", True),
    ("Error generating description: request timed out", "f", True), ("Collect the batch.", "collect_batch", True), ("The collect_batch function.", "collect_batch", True), ("To Dict", "to_dict", True),
    ("This function will init.", "__init__", True), ("Args:\n    a:\n    b:\n\nReturns:", "f", True), (":param a: a\n:return:\n:rtype:", "f", True), ("@param a\n@return", "f", True), ("Parameters\n----------\na :\n\nReturns\n-------", "f", True),
    ("_summary_", "f", True), ("Auto-generated stub.", "f", True), ("Collect TODO markers of a file.", "collect", False), ("None is returned if the hub is empty.", "f", False), ("Args:\n    a: the tree that is handed on", "f", False),
    ("Merges sorted runs.", "f", False), ("Collect the batch and drop it.", "collect_batch", False), (":param a: number of rows kept", "f", False), ("Thread safe; callers own it.", "run", False),
])
def test_says_nothing(text, name, nothing):
    assert D.says_nothing(text, name) is nothing


def test_docstring_rules():
    doc = lambda s: D.docstring(D.parse_definition(s))
    assert doc('def f():\n    # c\n    """Says it."""\n') == "Says it."
    assert doc('def f():\n        ("Says "\n         "it.")\n        return 1') == "Says it."
    assert doc('def f():\n    f"""No docstring."""') is None
    assert doc('def f():\n    x = 1\n    """Late."""') is None
    assert D.parse_definition("def f():\n    for x") is None
    assert D.parse_definition("    def f():\n        return 1") is not None


def test_pairs_found_and_inherited(spark):
    data = rows(
        dict(name="A", entity_type="Class", snippet="class A:\n    pass"), dict(name="B", entity_type="Class", snippet="class B(A):\n    pass"), dict(name="C", entity_type="Class", snippet="class C(B, A):\n    pass"),
        dict(name="run", parent_type="Class", parent_name="A", snippet='def run(self):\n    """Starts the engine slowly."""'),
        dict(name="C.run()", parent_type="Class", parent_name="C", snippet="def run(self):\n    return 1"), dict(name="stop", parent_type="Class", parent_name="C", snippet="def stop(self):\n    return 1"),
        dict(name="g", snippet="def g(): return 1", description="Counts the rows of a table."), dict(name="g", snippet="def g(): return", description="TODO"), dict(name="g", snippet="def g(): return (", description="Counts rows."),
        dict(name=None, snippet=None), dict(name=None, snippet='def x():\n    "Adds numbers."', graph_id=None),
    )
    e = spark.createDataFrame(data, DDL)
    assert sorted(r[0] for r in D.found(e).collect()) == [3, 6, 10]
    got = {r["rec_id"]: r for r in D.documentation_pairs(e).collect()}
    assert sorted(got) == [3, 4, 6, 10]
    assert got[4]["documentation"] == "Starts the engine slowly." and got[4]["doc_from"] == "inherited" and got[4]["doc_class"] == "A"


def test_empty_table_and_cycle(spark):
    e = spark.createDataFrame([], DDL)
    assert D.found(e).count() == 0 and D.documentation_pairs(e).count() == 0
    loop = spark.createDataFrame(rows(dict(name="A", entity_type="Class", snippet="class A(B): pass"), dict(name="B", entity_type="Class", snippet="class B(A): pass"), dict(name="m", parent_type="Class", parent_name="A", snippet="def m(self): pass")), DDL)
    assert D.documentation_pairs(loop).count() == 0


def test_bases_of_headers_with_brackets():
    for header, bases in (
        ("class A(Base, metaclass=make()): pass", ["Base"]), ("class A(with_meta(M), Base): pass", ["Base"]), ("class A(six.with_metaclass(M, m.Base, Other)): pass", ["m.Base", "Other"]), ("class A[T: (int, str)](Base[T], x.Other): pass", ["Base", "x.Other"]),
        ("class A(\n    Base,  # the (old) one\n    Generic[Map(K, V)], key='a)b', **kw\n):\n    x = (", ["Base", "Generic"]), ("class A(make(B), C): pass", ["C"]), ("class A(B, C", []), ("class A: pass", []), ("class A(B, B): pass", ["B"]),
    ):
        assert D.base_names(header) == ("A", bases), header
    assert D.base_names(None) == ("", []) and D.base_names("def f(): pass") == ("", [])


def test_documentation_nine_classes_up(spark):
    data = rows(
        *(dict(name=f"K{i}", entity_type="Class", snippet=f"class K{i}(K{i + 1}, metaclass=make()):\n    pass") for i in range(9)), dict(name="K9", entity_type="Class", snippet="class K9:\n    pass"),
        dict(name="run", parent_type="Class", parent_name="K9", snippet='def run(self):\n    """Starts the engine slowly."""'), dict(name="run", parent_type="Class", parent_name="K0", snippet="def run(self):\n    return 1"),
    )
    got = [r for r in D.documentation_pairs(spark.createDataFrame(data, DDL)).collect() if r["doc_from"] == "inherited"]
    assert [(r["documentation"], r["doc_class"]) for r in got] == [("Starts the engine slowly.", "K9")]


def test_bases_are_found_by_file_and_import(spark):
    cls = lambda file, name, head, **k: dict(name=name, entity_type="Class", source_file=file, snippet=f"class {head}:\n    pass", **k)
    method = lambda file, owner, doc=None, name="run": dict(name=name, parent_type="Class", parent_name=owner, source_file=file, snippet=f'def {name}(self):\n    """{doc}"""' if doc else f"def {name}(self):\n    return 1")
    imp = lambda file, module, *items: dict(name=module, entity_type="ImportFrom", source_file=file, module_name=module, imported_items=list(items))
    data = rows(
        cls("repos/x/one.py", "Base", "Base"), method("repos/x/one.py", "Base", "Says one thing."), cls("repos/x/two.py", "Base", "Base"), method("repos/x/two.py", "Base", "Says two things."),
        cls("repos/x/one.py", "Own", "Own(Base)"), method("repos/x/one.py", "Own"), cls("repos/x/c.py", "Far", "Far(B)"), method("repos/x/c.py", "Far"), imp("repos/x/c.py", "x.two", "Base as B"),
        cls("repos/x/d.py", "Named", "Named(one.Base)"), method("repos/x/d.py", "Named"), cls("repos/x/e.py", "Which", "Which(Base)"), method("repos/x/e.py", "Which"),
        cls("repos/x/f.py", "Out", "Out(Enum)"), method("repos/x/f.py", "Out"), imp("repos/x/f.py", "enum", "Enum"), cls("repos/x/g.py", "Enum", "Enum"), method("repos/x/g.py", "Enum", "Ours alone."),
        cls("repos/x/h.py", "In", "In(Enum)"), method("repos/x/h.py", "In"), cls("repos/x/i.py", "Kin", "Kin(Base)"), method("repos/x/i.py", "Kin"), imp("repos/x/i.py", ".one", "Base"),
        cls("repos/x/one.py", "Base", "Base", graph_id="other"), cls("repos/x/k.py", "Base", "Base(two.Base)"), method("repos/x/k.py", "Base"),
    )
    got = {data[r["rec_id"]][9] + "@" + data[r["rec_id"]][5][-4]: r["documentation"] for r in D.documentation_pairs(spark.createDataFrame(data, DDL)).collect() if r["doc_from"] == "inherited"}
    assert got == {"Own@e": "Says one thing.", "Far@c": "Says two things.", "Named@d": "Says one thing.", "In@h": "Ours alone.", "Kin@i": "Says one thing.", "Base@k": "Says two things."}
