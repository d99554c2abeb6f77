import ast
import json
import tomllib

import pytest

from spanweave.llm import badfiles as B

GOOD = {
    "py": ["", "x = 1\n", "def f(a, *, b=2) -> dict[str, int]:\n    '''(['''\n    return {\n        'a': [1,\n2]}\n", 'x = """\n<<<<<<< HEAD\n=======\n>>>>>>> b\n"""\n', "if a:\n    pass\nelif b: pass\nelse:\n    x = f'{a!r:>{w}}'\n", "class A:\n    @p\n    def f(self): ...\n", "match = 1\nmatch x:\n    case 1: pass\n", "a = b if c else d\n", "from . import (a,\n  b)\n", "for i in range(3): print(i)\n", "x = 1 if y else 2; z = not x\n", "x = a \\\n  + b\n"],
    "json": ['{"a": [1, -2.5e3, true, null, {"b": "\\u00e9{["}]}', "[]", ' "x" ', "0"],
    "toml": ["", 'a = 1\n[t.x]\nb = [1, 2,\n 3]\nc = {d = "e", f = 1.5}\ng = """\n[[x]]\n"""\n[[arr]]\nd = 2024-01-01T00:00:00Z\n', "# only\n", "a.b.'c d' = true\n"],
    "ts": ["", "import { A } from './a';\nexport class B<T> extends A implements C {\n  private x?: number = 1;\n  f(a: string[], b = 2): void { const r = /^[a-z(]+$/.test(`x ${a[0]} )`); if (r) { return; } }\n}\n", "/* <<<<<<< HEAD\n=======\n*/\nconst a = { 'k': 1, b: [1, 2] };\nlet s = \"it's (\";\n", "export interface D { id: string; n: number[]; }\ntype U = 'a' | 'b';\nfor (const x of xs) { y.push(x); }\nconst f = async (x: number) => { await g(x); };\n", "#!/usr/bin/env node\nvar a = b ? c : d;\nenum E { A, B }\n", "const t = `a ${b ? `c ${d}` : '}'} e`;\n", "let q = a / b / c;\nconst re = /[/]\\//g;\n"],
}
BAD = {
    "py": ["def f(:\n", "x = (1,\n", "'abc\n", '"""abc\n', "def f():\n", "<<<<<<< HEAD\nx = 1\n=======\nx = 2\n>>>>>>> b\n", "The cat sat on the mat.\n", "for embedd\n", "import { A } from './a';\n", "# Title\n\n- a b c\n", "if x:\nprint(1)\n", "x = [1}\n", "x =\n", "  x = 1\n y = 2\n", "x = 1²\n"],
    "json": ["", "{", '{"a": 1,}', "{'a': 1}", '{"a" 1}', "[1 2]", '"abc', "nul", "NaN", "# x\n", '{"a": 1}}', "a = 1\n", "<<<<<<< HEAD\n{}\n"],
    "toml": ["a = ", "a = [1, 2\n", 'a = "x\n', "[t\n", "<<<<<<< HEAD\na = 1\n", "just words here\n", 'a = """x', "a = 1 b = 2\n", "<section>\n", '{"a": 1}\n'],
    "ts": ["class A {\n", "import { A } from", "const x = 'abc\n", "const x = `abc", "<<<<<<< HEAD\nlet a = 1;\n=======\nlet a = 2;\n>>>>>>> b\n", "# Title\n\ntext here\n", "def f(x):\n    return 1\n", "SELECT a FROM b WHERE c = 1;\n", "import threading as th\n", 'if [ -f "x" ]; then\n  ls\nfi\n', "let x = (1];\n", '{"a": 1}', "const x = ;\n", "node id;label;file name\n", "/* open\n", "export interface A\n", "key_a:\n  - b/c.py\n  - limit: 65\n"],
}


@pytest.mark.parametrize("ext,text", [(e, t) for e, ts in GOOD.items() for t in ts])
def test_good_files_pass(ext, text):
    assert B.judge(text, ext) is None
    assert B.SCANNERS[ext](text) is None


@pytest.mark.parametrize("ext,text", [(e, t) for e, ts in BAD.items() for t in ts])
def test_bad_files_are_found_by_the_lexer_alone(ext, text):
    assert B.judge(text, ext) is not None
    if text != "  x = 1\n y = 2\n":
        assert B.SCANNERS[ext](text) is not None


def test_whole_tables_against_the_parsers(spark, small):
    """On every Python, JSON and TOML file the result is the parser's."""
    chunks = spark.read.parquet(f"{small}/chunks.parquet")
    texts = {(r["graph_id"], r["source_file"]): (r["ext"], r["text"]) for r in B.whole_files(chunks).collect()}
    for r in B.judged_files(chunks).collect():
        ext, text = texts[r["graph_id"], r["source_file"]]
        try:
            {"py": ast.parse, "json": json.loads, "toml": tomllib.loads}[ext](text) if ext != "ts" else None
            ok = True
        except (SyntaxError, ValueError):
            ok = False
        if ext != "ts":
            assert (r["defect"] is None) == ok


def test_files_from_chunks(spark):
    ddl = "graph_id string, id string, text string, metadata struct<source_file:string,language:string,chunk_index:int,start_line:int,end_line:int,token_count:int>, indexed_at timestamp, ext string, defect string"
    m = lambda p, i: (p, None, i, None, None, None)
    data = [("g", "b", "  pass", m("repos\\g\\A.PY ", 2), None, "x", "y"), ("g", "a", "def f():", m(" repos//g/A.PY", 1), None, "x", "y"), ("g", "a", "def f():", m("repos/g/A.PY", 1), None, "x", "y"), ("g", "c", "{", m("x/repos/g/b.json", 1), None, "x", "y"), ("g", "d", None, m("repos/g/e.json", 1), None, "x", "y"), ("g", "e", "t", m(None, None), None, "x", "y"), (None, "f", "x = 1", m("repos/n.toml", None), None, "x", "y")]
    got = {r["source_file"]: r["defect"] for r in B.judged_files(spark.createDataFrame(data, ddl)).collect()}
    assert got == {"repos/g/A.PY": None, "repos/g/b.json": "premature end", "repos/g/e.json": "premature end", "repos/n.toml": None}
    assert {(r["language"], r["files"], r["rejected"]) for r in B.rates(spark.createDataFrame(data, ddl)).collect()} == {("python", 1, 0), ("json", 2, 2), ("toml", 1, 0)}
    assert B.judged_files(spark.createDataFrame([], ddl)).count() == 0


VALID_TS = r"""
const a = foo<Bar>(x);
const f = <T,>(x: T): T => x;
abstract class A { abstract run(): void; protected constructor(private readonly x: number, public y?: string) { super(); } }
class B2 { get x(): number { return this._x; } set x(v: number) { this._x = v; } static async *gen() { yield* other(); } }
@Component({ selector: 'app', template: `<div>{{ x }}</div>` }) export class C3 { @Input() name!: string; @Output() go = new EventEmitter<string>(); }
const v = a?.b?.[0]?.(c) ?? d!;
const t = ['a', 'b'] as const;
const cfg = { a: 1, b: { c: 2 }, ...rest, [key]: 3, 'quoted-key': 4, method() { return 1; }, get z() { return 2; }, async go() {} } satisfies Cfg;
const enum E1 { A = 1, B = A << 1, C = 'x'.length }
declare const enum E2 { A }
namespace N.M { export const x = 1; }
declare module 'x' { export function f(a: string): void; }
function isS(x: unknown): x is string { return typeof x === 'string'; }
function assertS(x: unknown): asserts x is string {}
function over(a: string): string; function over(a: number): number; function over(a: any) { return a; }
type M1<T> = { readonly [K in keyof T]?: T[K] };
type Cond<T> = T extends (infer U)[] ? U : never;
type L = `a-${string}`;
interface I1 { [key: string]: number; (x: number): string; new (x: string): I1; readonly a: string; b?(): void; 'quoted': string; }
import type { A5 } from 'b';
import D5, { type E5, F5 as G5 } from './m';
import * as ns from "ns";
import './side';
import x6 = require('y');
export * from './x';
export * as q from './y';
export { a, b as c } from './z';
export default class { x = 1; }
export default function () { return 1; }
export = foo;
outer: for (let i = 0; i < 10; i++) { if (i > 5) continue outer; else break outer; }
const g = () => ({ a: 1 });
const re = s.replace(/[/"'`]/g, '').split(/\s+/);
if (a) return b; else c();
do { x++; } while (x < 5);
for await (const x of y) { await z(x); }
for (const [k, v2] of Object.entries(o)) console.log(k, v2);
let u: typeof y, w: keyof Foo, z: unique symbol;
const n = new Map<string, Array<{ a: number }>>();
try { a(); } catch { b(); } finally { c(); }
try { a(); } catch (e: unknown) { throw new Error(`x ${e}`); }
switch (x) { case 'a': case "b": y(); break; default: z(); }
const big = 1_000n, hex = 0xff, fl = .5e-3, oct = 0o17;
let x7: string | undefined = undefined, y7 = a ? b : c ? d : e;
const long = a
  ? b
  : c;
const chain = foo
  .bar()
  .baz(x => x.y)
  .map(async ({ id, name = 'x' }) => { await go(id); });
let a8 = b8, c8
let d8 = 1
a8 = <any>b8;
var fn = function named(a = {}, { b, c } = {}, ...rest) { };
label: { break label; }
async function af() { await Promise.all([a(), b()]); return; }
let tpl = tag`x ${1}`;
export type Fn = (a: string, b?: number) => Promise<void>;
export abstract class Q9<T extends object = {}> implements I1, I2<T> { declare x: number; accessor y = 1; override z(): void {} #priv = 1; static { init(); } }
type Rec = Record<string, { a: string; b: number[] }>;
let opt = obj!.a!.b;
const o2 = { if: 1, class: 2, import: 3, new: 4, default: 5, for: 6 }; o2.class; o2.if; o2.import;
if (x) { } else if (y) { } else { }
while (true) { break; }
const s2 = 'it\'s', s3 = "a\
b";
let neg = -1, not = !a, bit = ~b, vd = void 0, ty = typeof x === 'a', inn = 'k' in o, ins = a instanceof B;
delete o.a; throw new Error('x');
enum Color { Red = 'RED', Green = 'GREEN' }
let a10 = b10 as unknown as string[];
let x11 = y11 < z11 && a11 > b11;
function f12(this: Window, cb: (err: Error | null, data?: Buffer) => void): void {}
const { a: a13, b: { c: c13 }, ...r13 } = obj13;
let tuple: [string, number?, ...boolean[]] = ['a'];
export const routes: Routes = [{ path: '', component: Home }, { path: '**', redirectTo: '' }];
let getset = { get: 1, set: 2, of: 3, type: 4 }; const type = 5; let of = 1; type;
"""


def test_valid_typescript_constructs_raise_no_alarm():
    blocks, current = [], ""
    for line in VALID_TS.strip("\n").split("\n"):
        if line.startswith("  ") or current.endswith("\\"):
            current += "\n" + line
        else:
            blocks.append(current)
            current = line
    blocks.append(current)
    assert [b for b in blocks if B.scan_typescript(b)] == []
    assert B.scan_typescript("\n".join(blocks)) is None
    # any of them cut off inside a bracket, a string or a comment is found
    for b in blocks:
        opened = max(b.rfind("{"), b.rfind("("), b.rfind("["))
        if opened > 0 and b.endswith(("}", ")", ";")) and b.count("{") > 0 and not b.startswith(("const re", "const f =")):
            assert B.scan_typescript(b[: b.find("{") + 1]) is not None, b


TS_BAD = ["x = = y;", "foo(,);", "let class = 1;", "else { }", "class A extends { }", "for (let i = 0; i < 3) {}", "try { f(); }", "if () {}", "switch (x) { case 1: break; }\ncase 2:", "=> x", "throw;", "x = new;", "function (x) {}", "class { }", "foo(a,,b);", "const a = {, b: 1};", "while () {}", "let x = a && || b;"]
TS_GOOD = 'type A =\n  | "x"\n  | "y";\nlet [a, , b] = f();\nfor (const x of xs) {}\nfor (;;) {}\ntry { f(); } catch { g(); }\nexport default function (x: number) { return x; }\nif (a) b(); else c();\nswitch (x) { case 1: break; default: y(); }\nconst f = <T,>(x: T) => x;\nlet g: (a?: number, b?: string) => void = () => {};\nfoo\n  .bar();\nclass B extends A<{ x: number }> implements C { private x = 1; }\nconst o = { if: 1, case: 2, else: 3, class: 4, new: 5 };\no.if.else;\ndo { x++; } while (x < 3);\nasync function* gen() { for await (const v of w) { yield v; } }\nif (a) { b(); } else if (c) { d(); } else { e(); }\nconst enum E { A, B }\nif (x) {\n} // c\nelse {\n}\n'


def test_statements_of_typescript():
    assert [t for t in TS_BAD if not B.scan_typescript(t)] == []
    assert B.scan_typescript(TS_GOOD) is None and B.scan_typescript("export default class { a = 1; }") is None


def test_the_lexer_flags_and_the_parser_only_confirms(monkeypatch):
    asked = []
    monkeypatch.setattr(B, "_exact", lambda t, e: asked.append(t))
    assert B.judge("x = 1\n", "py") is None and asked == []
    assert B.judge("x = = 1\n", "py") and asked == ["x = = 1\n"]


def test_python_automaton_against_the_compiler():
    """Changed library files: nearly all that the compiler refuses are flagged, nearly none that it accepts."""
    import pathlib
    import random
    import re
    import sysconfig

    rng = random.Random(7)
    texts = [p.read_text("utf-8") for p in sorted(pathlib.Path(sysconfig.get_paths()["stdlib"]).glob("*.py")) if p.stat().st_size < 20_000]
    assert sum(bool(B.scan_python(t)) for t in texts) <= len(texts) // 50
    wrong = missed = 0
    while wrong < 250:
        t = rng.choice(texts)
        tokens = list(re.finditer(r"\w+|[^\w\s]", t))
        if not tokens:
            continue
        m, o = rng.choice(tokens), rng.choice(tokens)
        changed = rng.choice([t[: m.start()], t[: m.start()] + t[m.end() :], f"{t[: m.end()]} {t[m.start() :]}", t[: m.start()] + o.group() + t[m.end() :], f"{t[: m.start()]}{rng.choice(')([}=:,')} {t[m.start() :]}"])
        if B._exact(changed, "py") is False:
            wrong += 1
            missed += not B.scan_python(changed)
    assert missed <= 10


@pytest.mark.parametrize("text,ok", [
    ("a = 1\na = 2\n", False), ("[t]\na = 1\n[t]\n", False), ("[[t]]\na = 1\n[[t]]\na = 2\n", True), ("a.b = 1\na.c = 2\n", True), ("a = 1\na.b = 2\n", False), ("[a.b]\nx = 1\n[a]\ny = 2\n", True), ("[a]\nb.c = 1\n[a.b]\n", False), ("a = 01\n", False), ("a = 1__0\n", False), ('a = "\\q"\n', False), ('a = """x"""\n', True), ("a = ''\n", True),
])
def test_toml_keys_and_values(text, ok):
    assert (B.scan_toml(text) is None) is ok and B._exact(text, "toml") is ok


def test_formatted_literals():
    for good in ("f'{a!r:>{w}} {{x}}'", "f'{x['a']}'", 'rf"\\{tag}"', "f'\\N{DASH} {a:%H:%M}'", "f'{(lambda x: 1)(2)}'"):
        assert B.scan_python(good) is None, good
    for bad in ("f'{a'", "f'a}'", "f'{}'", "f'{a[}'"):
        assert B.scan_python(bad), bad
