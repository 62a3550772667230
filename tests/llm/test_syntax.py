"""The syntax checker against sources known to be valid or not."""

import sys

import pytest

from lodestitch.llm import syntax
from lodestitch.llm.ecma_parser import syntax_errors

VALID = {
    "js": [
        "", "// only a comment", "let a = 1\nlet b = a\n++b", "for (const [k, v] of Object.entries(x)) { if (k) continue; }", "a = b / c / d; e = /[/\\]]+/g.test(f)",
        "const f = async ({ a = 1, ...r }, [b, , c] = []) => ({ a, b })", "class A extends (b, C) { static #x = 1; get y() { return this.#x } static { init() } async *z() {} }",
        "label: for (;;) { break label }", "x = `a${b ? `c${d}` : ''}e`", "if (a) b; else c\ndo x(); while (y) z()", "({ a, b: { c = 2 } } = d)", "import x, { y as z } from 'm'; export * as q from 'q'",
        "var async = 1; async = async\nget = set", "new a.b(c)?.d?.[e]?.(f)", "#!/usr/bin/env node\nrun()", "x = a ? (b) : c => d", "export default async function () { await y }", "with (a) { b }", "a ??= b ** -c",
        "const re = x => /\\//u", "switch (a) { case 1: default: break }", "yield_ = function* () { yield* x; const y = yield }", "'use strict'; let \\u0061b = 1", "/* <<<<<<< */ `\n=======\n`",
    ],
    "mjs": ["await x; export const a = import.meta.url"],
    "cjs": ["const a = require('a'); module.exports = { a }; import('x').then(y)"],
    "jsx": ["const a = <div className='b' {...c}>text isn't {d.map((x) => <li key={x}>{x} &gt; 4</li>)}<></></div>", "x = <A.B c={<d/>} e:f='g' />"],
    "ts": [
        "interface A<T extends B = C> extends D { readonly a?: T; [k: string]: any; (x: number): void; new (y): A; m?<U>(u: U): u is string }",
        "type X = { [K in keyof T as `get${K}`]-?: T[K] } | (abstract new () => void) | readonly string[] | [a: number, b?: string, ...c: X[]]", "type Y<T> = T extends (infer U extends string)[] ? U : never",
        "enum E { A = 1, B = A << 2 } declare module 'x' { export const y: number } namespace N.M { let z }", "const f = <T,>(x: T): x is NonNullable<T> => x!", "let a = <any>b; let c = d as unknown as E<F>; g satisfies H",
        "class A { constructor(private readonly a: string, public b?: number) { super() } declare c: D; abstract e(): void; f!: G; override h?(): i; [j: string]: k }",
        "function f(this: Window, a?: number): asserts a is number; function f(a) {}", "import type { A } from 'a'; export type { B } from 'b'; import c = require('c'); export = c", "new Map<string, Array<{ a: number }>>(); a < b > (c)", "@dec() class Z { @x y: number }",
        "let v = a ? (b, c) : (d): e => f; for (const q of r as S[]) {}", "abstract class Q<T> implements A, B<T> { protected abstract x: T }",
    ],
    "cts": ["import x = require('y'); const a: number = 1"],
    "tsx": ["const A = <T,>(p: P<T>) => <div<T> a={p}>{p as string}</div>", "let x: Array<number> = y"],
}
INVALID = {
    "js": [
        "function f() {", "let a: number = 1", "const x = <div/>", "return 1", "a +", "'abc", "`abc", "/* abc", "<<<<<<< HEAD\na\n=======\nb\n>>>>>>> x", "if (a {", "let = 1 2", "class { }", "x = { a: 1, b }, }", "1 = a", "a => { } ()",
        "for (const x of y", "{ \"a\": 1, \"b\": 2 }", "import { a from 'b'", "max-snapshot = 54", "var 1a", "const a", "({ a = 1 })", "break", "new.target = 1 +", ".panel { color: #fff; }", "def f(x):\n  return x", "const a = 1;\n}\n", "try { }", "interface A {}",
    ],
    "mjs": ["with (a) {}", "x = 010"],
    "cjs": ["import a from 'a'", "export const a = 1", "await x"],
    "jsx": ["x = <a><b></a></b>", "x = <a>{</a>", "let a: string", "<template><p>{{ x }}</p></template>\n<script setup></script>"],
    "ts": ["const x = <div>a</div>", "type A = { b: }", "interface A { b: string", "let x: Array<number = 1", "enum { A }", "class A { private x y }"],
    "cts": ["import a from 'a'"],
    "tsx": ["let a = <any>b; c", "const A = <T>(x: T) => x"],
}


@pytest.mark.parametrize("ext,source", [(e, s) for e, xs in VALID.items() for s in xs])
def test_valid(ext, source):
    assert syntax_errors(source, ext) == []


@pytest.mark.parametrize("ext,source", [(e, s) for e, xs in INVALID.items() for s in xs])
def test_invalid(ext, source):
    assert syntax_errors(source, ext)


def test_every_prefix_of_a_class_ends():
    source = "export class A<T> { #a = `x${1}`; m(b: number): T[] { return [<T>b].map((c) => ({ c })) } }"
    for n in range(len(source)):
        syntax_errors(source[:n], "ts")
        syntax_errors(source[n:], "tsx")


def test_panic_mode_reports_later_errors_too():
    found = syntax_errors("let a = ;\nfunction ok() { return 1 }\nlet b = (;\nlet c = 1\n", "js")
    assert [at for at, _ in found] == [8, 46]


@pytest.mark.parametrize("ext,source", [
    ("js", "a" + ".then(function () { return b" * 500 + " })" * 500), ("ts", "x = " + "[" * 20_000 + "]" * 20_000), ("jsx", "x = " + "<a>" * 5000 + "</a>" * 5000),
    ("ts", "type A = " + "Array<" * 5000 + "B" + ">" * 5000), ("js", "x = " + "`${" * 5000 + "1" + "}`" * 5000), ("js", "{" * 5000 + "}" * 5000),
])
def test_depth_is_no_error(ext, source):
    limit = sys.getrecursionlimit()
    sys.setrecursionlimit(syntax.RECURSION)
    try:
        assert syntax_errors(source, ext) == []
        assert syntax_errors(source[:-1], ext)
    finally:
        sys.setrecursionlimit(limit)


def test_files_and_rates(spark):
    files = spark.createDataFrame([(1, "a/b.ts", "r", "x"), (2, "c.JS", "r", "x"), (3, "d.md", "r", "x"), (4, "e.js", None, "x"), (5, "f.js", "r", "x")], "id long, path string, repo string, content string")
    texts = spark.createDataFrame([(1, "let a: = 1"), (2, "ok()"), (3, "# no"), (4, None), (4, None), (6, "x")], "file_id long, content string")
    rows = {r.file_id: r for r in syntax.check_files(files, texts).collect()}
    assert {i: r.valid for i, r in rows.items()} == {1: False, 2: True, 3: None, 4: True}
    assert rows[1].first_line == 1 and rows[1].n_errors == 1
    rates = {(r.repo, r.language): (r.n_files, r.n_invalid) for r in syntax.rates(syntax.check_files(files, texts), files).collect()}
    assert rates == {("r", "ts"): (1, 1), ("r", "js"): (1, 0), (None, "js"): (1, 0)}
    log = spark.createDataFrame([("r", "C:\\x\\a\\b.ts", " PARSE "), ("r", "c.JS", None)], "repo string, path string, stage string")
    assert {r.file_id: r.logged for r in syntax.with_hints(syntax.check_files(files, texts), files, log).collect()} == {1: True, 2: False, 3: False, 4: False}


def test_long_chains_and_deep_nesting(spark):
    chain = "if (a) b();" + " else if (a) b();" * 1000 + " else c();"
    arms = "x = " + "a ? b : " * 1000 + "c"
    deep = "x = " + "[" * 300 + "]" * 300
    texts = [chain, arms, deep, "x = " + "[" * 9000 + "]" * 9000, "let = = 1;\nx = " + "[" * 9000, chain + "\nlet a = ;", arms + " ? "]
    files = spark.createDataFrame([(k, f"f{k}.js", "r") for k in range(len(texts))], "id long, path string, repo string")
    sources = spark.createDataFrame(list(enumerate(texts)), "file_id long, content string")
    got = {r.file_id: r.valid for r in syntax.check_files(files, sources).collect()}
    assert got == {0: True, 1: True, 2: True, 3: True, 4: False, 5: False, 6: False}
