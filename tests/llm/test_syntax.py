"""Grammars on valid and broken fixtures of every language."""

import sys

import pytest

from corpusmill.llm import lexers, syntax

VALID = {
    "python": ["def f(a, *b, c=1, **d) -> int:\n    return f'{a!r:>{c}}'\n", "async def g():\n    async with a as b: await c\n", "x = [i for i in y if i]\nmatch x:\n    case [1, *_]: pass\n"],
    "javascript": [
        "const f = async (a, {b, c: [d]}, ...e) => ({a, [b]: c, ...d, get x() { return 1; }, async *g() {}});\n",
        "if (a) b(); else if (c) { d } else e\nfor (let i = 0, j; i < 3; i++) f(i)\nfor (const x of y) {}\nfor (k in o);\nwhile (a--) ;\ndo { x } while (y)\n",
        "label: for (;;) { break label; }\nswitch (a) { case 1: b(); break; default: c }\ntry { a } catch { b } finally { c }\n",
        "class A extends B.c { static x = 1; #p; constructor() { super(); } get y() { return this.#p } static { z } async *m() {} [k]() {} }\n",
        "import a, {b as c} from 'd'\nimport * as e from \"f\"\nexport default function () {}\nexport {a as b}\nexport * from 'g'\n",
        "const r = /[/\\]]+/g.test(x) ? a / b / c : `t${`n${1}`}`\nlet z = x ?? y?.[0]?.(1)\n",
        "!function(t,n){if(!t)throw{f:t};q=[f,a,\"F\"];k&&(s=q||{},f=253)}(window)\n",
        "a\n  .b()\n  .c()\nvar x = function* () { yield 1 }, y = new Map([[1, 2]])\n",
    ],
    "typescript": [
        "interface A<T extends B = C> extends D { readonly a?: string; b(x: number): void; [k: string]: unknown; new (x: T): A<T> }\n",
        "type F<T> = (a: T, b?: string[]) => Promise<Map<string, T | null>>;\nenum E { A = 1, B, 'c' = 3 }\n",
        "abstract class C<T> implements A, B { private readonly x: T; constructor(private y: string) {} abstract m(): void; get z(): T { return this.x as unknown as T } }\n",
        "export namespace N { const a: Record<string, number> = { b: 1 }; }\ndeclare module 'm' { function f(a: any): asserts a is string; }\n",
        "const g = <T,>(x: T): x is T => x!;\nlet t: [a: string, ...b: number[]] = foo<string>('x');\nfunction h(this: Window, a: keyof typeof b, c: A['d']): void {}\n",
    ],
    "java": [
        "package a.b;\nimport java.util.*;\nimport static x.Y.z;\n@A(b = 1) public final class C<T extends D & E> extends F<T> implements G, H<Map<String, List<T>>> {\n  private static final int[] a = {1, 2}, b[] = new int[3][];\n  static { x(); }\n  public C(int a, String... b) throws E { super(a); }\n  @Override public <R> List<R> m(final Map<String, Integer> x) throws A, B { return x.stream().map(y -> y + 1).map(Z::new).toList(); }\n  abstract void n();\n}\n",
        "enum E { A(1) { void f() {} }, B(2); E(int x) {} }\ninterface I { default void f() { } int X = 1; }\nrecord R(int a, String b) { }\n",
        "class A { void f() { for (int i = 0; i < 3; i++) { if (a < b && c > d) continue; else break; } for (String s : t) u(s); try (R r = q()) { } catch (A | B e) { throw e; } finally { } int x = (int) y; Object o = new Object() { int z; }; switch (k) { case 1: case 2: f(); break; default: g(); } var v = switch (k) { case 1 -> 2; default -> { yield 3; } }; do { } while (a); synchronized (this) { } char c = '{'; x = a ? b : c ? d : e; } }\n",
    ],
    "go": [
        "package a\n\nimport (\n\t\"fmt\"\n\tb \"c/d\"\n)\n\ntype T struct {\n\tx, y int `json:\"x\"`\n\t*E\n\tf func(a int) (b error)\n}\n\ntype I interface {\n\tm(x int) error\n\tfmt.Stringer\n}\n",
        "package a\n\nfunc (t *T) m(a, b int, c ...string) (int, error) {\n\tif err := f(); err != nil {\n\t\treturn 0, err\n\t} else if x {\n\t}\n\tfor i, v := range m {\n\t\tgo func() { ch <- v }()\n\t}\n\tfor i := 0; i < 3; i++ {\n\t}\n\tfor {\n\t\tbreak\n\t}\n\tswitch x := y.(type) {\n\tcase int, string:\n\t\tfallthrough\n\tdefault:\n\t}\n\tselect {\n\tcase v := <-c:\n\tcase c <- 1:\n\t}\n\tm := map[string][]int{\"a\": {1, 2}}\n\ts := a[1:2]\n\tp := &T{x: 1}\n\tdefer p.m()\n\tr := 'x'\n\treturn g[int](a...)\n}\n",
        "package a\n\nconst (\n\tA = iota\n\tB\n)\n\nvar x, y = 1, 2\n\ntype G[T any] struct{ v T }\n\nfunc F[K comparable, V int | float64](m map[K]V) V {\n\treturn *m\n}\n",
    ],
    "rust": [
        "use std::{fs, io::{self, Read}};\npub(crate) struct A<'a, T: B + 'a> where T: C { pub x: &'a T, y: Vec<Option<T>> }\nenum E { A, B(i32), C { x: u8 } }\n",
        "impl<T> D for A<T> { fn m(&mut self, a: &str) -> Result<(), Box<dyn E>> { let x = match a { Some(v) if v > 1 => v, 1 | 2 => { 3 } _ => return Ok(()), }; for i in 0..n { x.push(i + 1); } while let Some(y) = z { } if let Ok(q) = r { } else { } loop { break; } let c = |a, b: i32| a + b; println!(\"{}\", x); v.iter().map(|x| x * 2).collect::<Vec<_>>()?; x as usize } }\n",
        "#[derive(Debug)]\npub mod m { pub const X: [u8; 3] = [1, 2, 3]; static S: &str = r#\"a\"b\"#; type T = fn(i32) -> i32; trait P: Q { fn f(&self); type O; } macro_rules! k { ($a:expr) => { $a }; } }\nfn main() { let c = '}'; let t = (1, 'a', b'x'); unsafe { f() } }\n",
    ],
    "c": [
        "#include <a.h>\n#define M(x) \\\n  do { x } while (0)\ntypedef struct s { int a, *b[3]; unsigned c : 4; } s_t;\nstatic const char *const names[] = { \"a\", [2] = \"b\" \"c\" };\nenum e { A = 1, B };\nint f(void);\n",
        "static size_t f(char *a, int (*g)(int), ...) {\n  for (size_t i = 0; i < 3; i++) { x += a[i]; }\n  while (v-- > 0) y <<= 1;\n  do { z(); } while (a && b);\n  switch (c) { case 1: case 'a': break; default: goto out; }\n  if (p->q.r) return (int) *p; else if (!q) { }\n  int k = a ? '{' : '}', *m = (int *) malloc(sizeof(int) * 3);\nout:\n  return -1;\n}\n",
    ],
    "ruby": [
        "require 'a'\nmodule M\n  class A < B::C\n    attr_reader :x, :y\n    X = { a: 1, 'b' => 2 }.freeze\n    def m(a, b = 1, *c, k: 2, **d, &e)\n      return if a.nil?\n      if a > 1 then b else c end\n      x.each do |y, z|\n        puts \"#{y} #{z ? 'a' : \"b\"}\"\n      end\n      while a < 3\n        a += 1\n      end\n      case a\n      when 1, 2 then b\n      else c\n      end\n      begin\n        f\n      rescue E => e\n        raise\n      ensure\n        g\n      end\n      v = w.map { |q| q * 2 }.select(&:ok?)\n      raise 'x' unless v\n    end\n  end\nend\n",
        "def self.f\n  yield 1 if block_given?\n  @a ||= %w[a b c]\n  t = <<~E\n    text end\n  E\n  a, b = b, a\nend\n",
    ],
    "json": ['{"a": [1, 2.5e3, null, true, "\\u00e9"]}', "[]", '"x"'],
    "yaml": ["a:\n  - b: 1\n    c: [1, 2]\n  - |\n    text\n---\nd: \"e\"\n", "# only a comment\n"],
}
BROKEN = {
    "python": ["def f()\n    pass\n", "x = (1\n", "if a:\nb\n"],
    "javascript": ["function f( {\n}\n", "const = 1\n", "class A { m( }\n", "let a = 'x\n", "if (a { }\n", "}\n", "x = = 1\n", "async func"],
    "typescript": ["interface A { a: }\n", "let x: = 1\n", "type A = \n", "class A {\n", "function f(a: string { }\n"],
    "java": ["class A { void f( { } }\n", "class A { int x = ; }\n", "public class { }\n", "class A { void f() { return 1 } }\n", "import a b;\nclass A { }\n", "class A {\n"],
    "go": ["package a\nfunc f( {\n}\n", "func f() {}\n", "package a\nfunc f() {\n\tx := \n}\n", "package a\ntype T struct {\n\tx int\n"],
    "rust": ["fn f( { }\n", "let x = 1;\n", "fn f() { let = 1; }\n", "struct A { x i32 }\n", "fn f() {\n"],
    "c": ["int f( { }\n", "int x = ;\n", "void f() { return 1 }\n", "int a[;\n", "void f() {\n"],
    "ruby": ["def f\n", "class A\n  def m\n  end\n", "x = (1\n", "end\n", "if a\n  b\n"],
    "json": ["{'a': 1}", "[1,]", "{\"a\": NaN}", "// x\n{}", "{\"a\": 1"],
    "yaml": ["a: [1, 2\nb: 3\n", "a:\n\tb: 1\n", "a: b: c: d\n- e\n"],
}
MARKS = "<<<<<<< HEAD\n%s=======\n%s>>>>>>> other\n"


@pytest.mark.parametrize("language,text", [(k, t) for k, ts in VALID.items() for t in ts])
def test_valid(language, text):
    assert syntax.valid(language, syntax.plain("﻿" + text.replace("\n", "\r\n")))
    assert syntax.valid(language, text)


@pytest.mark.parametrize("language,text", [(k, t) for k, ts in BROKEN.items() for t in ts])
def test_broken(language, text):
    assert not syntax.valid(language, text)


@pytest.mark.parametrize("language", [k for k in VALID if k != "yaml"])
def test_conflict_marks_and_truncation(language):
    text = VALID[language][0]
    assert not syntax.valid(language, MARKS % (text, text))
    if language not in ("json", "python"):
        closed = next(t for t in VALID[language] if t.rstrip()[-1] in "}d")
        assert not syntax.valid(language, closed.rstrip()[:-1])


def test_wrong_endings_are_recognised():
    for language, texts in VALID.items():
        if language not in ("json", "yaml", "typescript", "javascript", "c"):
            assert syntax.foreign("json", texts[0]) == language


@pytest.mark.parametrize("text", ["a: [1, 2\n", "a: 1\n"])
def test_yaml_without_its_library_is_an_error(monkeypatch, text):
    monkeypatch.setitem(sys.modules, "yaml", None)
    with pytest.raises(ImportError):
        syntax.valid("yaml", text)
    with pytest.raises(ImportError):
        syntax.foreign("json", text)


def test_odd_yaml_is_decided():
    assert not syntax.valid("yaml", 'a: "\\UFFFFFFFF"\n') and syntax.valid("yaml", 'a: "\\U0010FFFF"\n')
    assert not syntax.valid("yaml", f"%YAML 1.{'9' * 5000}\n---\na\n")
    deep = "[\n" * 3000 + "%s" + "]\n" * 3000
    assert syntax.valid("yaml", deep % "a b") and not syntax.valid("yaml", deep % "a: b: c") and not syntax.valid("yaml", deep % "}")


def test_operator(spark, files):
    df = files((1, "a.py", "def f(:\n"), (1, "a.py", "def f(:\n"), (2, "a.js", VALID["go"][0]), (3, "b.py", None), (4, "c.py", " \n"), (5, "d.txt", "x"), (6, "e.rb", "x = 1\n"), (7, None, "x"), (8, "f.json", "x" * 300_000))
    got = {r.file_id: (r.valid, r.parsed_as) for r in syntax.parsed(df).collect()}
    assert got == {1: (False, None), 2: (False, "go"), 6: (True, "ruby"), 8: (False, got[8][1])}
    assert sorted(r.file_id for r in syntax.found(df).collect()) == [1, 2, 8]
    assert syntax.found(df.limit(0)).count() == 0
    assert {(r.language, r.files, r.invalid) for r in syntax.rates(df).collect()} == {("python", 1, 1), ("javascript", 1, 1), ("ruby", 1, 0), ("json", 1, 1)}


def test_spans():
    s = lexers.scan("javascript", "a = 1 / 2; // c\nb = /\\/x/.test('s') + `t${'u'}`;")
    assert [k for _, _, k in s.spans] == ["#", "/", '"', '"'] and s.ok
    assert not lexers.scan("c", 'x = "a\n').ok


ODD = {"prose": "word " * 20_000, "calls": "word word, other (thing) x[0]\n" * 300 + "}}", "rows": "x[0]\n" * 400 + "end end", "ifs": "fn f() {" + "if x {} ; " * 200 + " ) }", "switch": "switch(a){case 1:" + "function f(){};" * 200 + "= }", "deep": "(" * 1000 + ")" * 1000, "sums": "a + " * 5000, "choices": "x = a ? b : " * 300 + "c;", "angles": "a < b, c > d " * 1000}


@pytest.mark.parametrize("language", ["javascript", "typescript", "java", "go", "rust", "c", "ruby"])
def test_odd_texts_take_no_time(language):
    import time

    started = time.process_time()
    for text in ODD.values():
        syntax.valid(language, text)
    assert time.process_time() - started < 30
