import pytest

from spanweave.llm import markup as M


@pytest.mark.parametrize("text,kinds", [
    (None, []), ("", []), ("Pass *args and **kwargs on to f, then __init__ works.", []), ("x == y, a < b and b > 4, 3 * 702 * 2, List<str>, [[1, 2], [3, 4]], C:\\new\\tables\\x, $5 or $9, $HOME and $PATH, Q&A, Issue #3 tracks the # of rows", []),
    ("<p>Hello</p>", ["html"]), ("a<br/>b", ["html"]), ("<b>open", ["html"]), ("dict&lt;str&gt; &amp; more", ["html"]), ("**Bold** text", ["markdown"]), ("*two words* here", ["markdown"]), ("__two words__", ["markdown"]), ("# Head", ["markdown"]),
    ("- a\n- b", ["markdown"]), ("1. a", ["markdown"]), ("> q", ["markdown"]), ("a\n\n---\n\nb", ["markdown"]), ("[a](http://x.y)", ["markdown"]), ("| a | b |\n| --- | ---: |\n| 1 | 2 |", ["markdown"]), ("see `x`", ["markdown"]),
    ("== Head ==", ["wiki"]), ("'''bold'''", ["wiki"]), ("[[Page|text]]", ["wiki"]), ("{{Note|x}}", ["wiki"]), ('{| class="wikitable"\n! a !! b\n|-\n| 1 || 2\n|}', ["wiki"]),
    ("\\section{A} text", ["latex"]), ("cost $O(n \\log n)$.", ["latex"]), ("$$\\sum_i w_i$$", ["latex"]), ("\\begin{itemize}\n\\item a\n\\end{itemize}", ["latex"]), ("\\textbf{a}", ["latex"]),
    ("```html\n<b>x</b>\n== a ==\n\\frac{1}{2}\n```", ["markdown"]), ("`<b>` and `$x_1$`", ["markdown"]), ("<pre><code>x = [[a]]\n**b**</code></pre>", ["html"]), ("```py\nopen", ["markdown"]),
])
def test_kinds(text, kinds):
    assert M.markup_kinds(text) == kinds


def test_clean_text_keeps_structure():
    t = "<h2>Title</h2><p>First &amp; second.</p><ul><li>one</li><li>two</li></ul>\n\n== Wiki ==\n'''Bold''' [[A|link]].\n\n* item `x`\n\n```py\nif a < b:\n    pass\n```\n\n\\[ \\frac{a}{b} \\]\nCost $O(n)$ and \\textbf{more}."
    c = M.clean_text(t)
    for part in ("## Title", "First & second.", "- one", "- two", "# Wiki", "Bold link.", "- item x", "```\nif a < b:\n    pass\n```", "\\frac{a}{b}", "$O(n)$ and more."):
        assert part in c, (part, c)
    for mark in ("<", "'''", "[[", "\\textbf", "&amp;"):
        assert mark not in c.replace("a < b", "")
    assert M.clean_text(None) is None and M.clean_text("") == "" and M.clean_text("plain. text") == "plain. text"


def test_boilerplate_paths_are_dropped():
    t = "<nav><a href='x'>Home</a> <a href='y'>About</a></nav><p>" + "A long sentence, with words. " * 20 + "</p><footer>Imprint</footer><script>var x = 1;</script>"
    c = M.clean_text(t)
    assert "long sentence" in c and "Home" not in c and "Imprint" not in c and "var x" not in c


def test_long_text_is_read_whole():
    t = ("Words and more words. " * 20 + "\n\n") * 2000 + "<b>end</b>"
    assert M.markup_kinds(t) == ["html"] and M.clean_text(t).endswith("end")


def test_tables(spark):
    ddl = "conversation_id string, history array<struct<user:string,assistant:string,timestamp:string>>, markup string, turn string"
    rows = [("a", [("q", "<b>x</b> and **y z**", "t"), None, ("q", None, "t")], "m", "t"), ("a", [("q", "<b>x</b> and **y z**", "t"), None, ("q", None, "t")], "m", "t"), ("b", None, "m", "t"), (None, [("q", "x", "t")], "m", "t")]
    c = spark.createDataFrame(rows, ddl)
    assert sorted(tuple(r) for r in M.found(c).collect()) == [("a", 0, "html"), ("a", 0, "markdown")]
    assert {(r["conversation_id"], r["turn"], r["text"]) for r in M.cleaned(c).collect()} == {("a", 0, "x and y z"), ("a", 2, None), (None, 0, "x")}
    assert M.found(spark.createDataFrame([], ddl)).count() == 0


def test_prose_beside_long_structure_stays():
    says = "This is the sentence that says what the list below is for."
    code = "x = [(a, b), c.d];" * 60
    for t in (f"{says}\n\n- one\n- two\n- three\n\n```py\n{code}\n```", f"{says}\n\n- one\n- two\n\n| a | b |\n| --- | --- |\n" + "| 1, 2. | 3; 4 |\n" * 90):
        assert says in M.clean_text(t)


@pytest.mark.parametrize("text,kinds,clean", [
    ("x[0](y) and dict[str](x)", [], "x[0](y) and dict[str](x)"), ("see [doc](a.md)", ["markdown"], "see doc"), ("Title\n=====\ntext", ["markdown"], "# Title\n\ntext"), ("a\n---\nb", ["markdown"], "## a\n\nb"),
    ("* a\n** sub\n* b", ["wiki"], "- a\n  - sub\n- b"), ("a<br>", ["html"], "a"), ("<nav>Home</nav>", ["html"], ""), ("[1]: http://a.b\n", ["markdown"], ""), ("a `x` and $a_1$", ["latex", "markdown"], "a x and $a_1$"),
])
def test_kinds_come_from_the_paths(text, kinds, clean):
    assert M.read_turn(text) == (kinds, clean)
    nodes = M.Reader(text).nodes
    table = M.tag_paths(nodes)
    assert sorted({k for p in table.values() for k in p.kinds}) == kinds and {n.path for n in nodes} == set(table)
