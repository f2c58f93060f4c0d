"""Documented functions of every language, and what is trivial."""

import pytest

from corpusmill.llm import docpairs, prose

REAL = "Reads the whole table and drops rows that are broken."
CASES = [
    ("python", "a.py", f'class A:\n    @d\n    async def f(\n        self):\n        """{REAL}"""\n\n        def g():\n            "x"\n    def h(self): "TODO"\n', [3]),
    ("javascript", "a.js", f"/** {REAL} */\nexport default async function f(a) {{\n}}\n/** {REAL} */\nconst g = (a) => a;\nclass A {{\n  /** {REAL} */\n  static m() {{}}\n  /** {REAL} */\n  x = 1;\n}}\n/** {REAL} */\n\nfunction h() {{}}\n// {REAL}\nfunction i() {{}}\n", [2, 5, 8]),
    ("typescript", "a.ts", f"/** {REAL} */\nfunction f(a: string): Promise<void> {{ }}\ninterface I {{\n  /** {REAL} */\n  m(): void;\n}}\nabstract class B {{\n  /** {REAL} */\n  abstract n(): void;\n  /** {REAL} */\n  @dec()\n  private o<T>(x: T): T {{ return x; }}\n}}\n", [2, 12]),
    ("java", "A.java", f"class A {{\n  /** {REAL} */\n  @Override\n  @X(y = 1)\n  public static <T> Map<String, T> f(int a) throws E {{ return null; }}\n  /** {REAL} */\n  abstract void g();\n  /* {REAL} */\n  void h() {{ }}\n}}\n", [5]),
    ("go", "a.go", f"package a\n\n// {REAL}\nfunc (t *T) F(x int) (int, error) {{\n}}\n\n// {REAL}\n\nfunc G() {{\n}}\n\n/* {REAL} */\nfunc H() {{\n}}\n", [4]),
    ("rust", "a.rs", f"/// {REAL}\n#[inline]\npub(crate) fn f<T: A>(x: T) -> u8 {{ 1 }}\ntrait P {{\n    /// {REAL}\n    fn g(&self);\n    /** {REAL} */\n    fn h(&self) {{ }}\n}}\n// {REAL}\nfn i() {{ }}\n", [3, 8]),
    ("c", "a.c", f"/* {REAL} */\nstatic const char *f(int a,\n    int b) {{\n  return 0;\n}}\n/// {REAL}\nint g(void);\n// {REAL}\nint h(void) {{ return 1; }}\n/* {REAL}\n */\nint\nlast(void) {{ return 2; }}\n", [2, 13]),
    ("ruby", "a.rb", f"class A\n  # {REAL}\n  def self.f(a)\n    a\n  end\n\n  # {REAL}\n\n  def g\n  end\nend\n", [3]),
]
TRIVIAL = ["", "TODO", "FIXME: later", "???", "*** fill in ***", "Lorem ipsum dolor sit amet again", "n/a", "read_table", "Read table function.", "The read table.", "read_table()", "@param rows\n@param cols\n@return", ":param rows:\n:return:", "@inheritDoc", "eslint-disable-next-line no-shadow", "rubocop:disable Metrics/MethodLength", "rows = cols.map { |x| x + 1 }", "if (rows == cols) {", "To be written.", "未記入", "待补充"]


@pytest.mark.parametrize("language,path,text,lines", CASES)
def test_found(spark, files, language, path, text, lines):
    df = files((1, path, text), (1, path, text))
    assert sorted(r.start_line for r in docpairs.documented(df).collect()) == lines


@pytest.mark.parametrize("doc", TRIVIAL)
def test_trivial(doc):
    assert not prose.informative(doc, "read_table", ["rows", "cols"])


@pytest.mark.parametrize("doc", [REAL, f"TODO {REAL}", f"eslint-disable\n{REAL}", "Liest die ganze Tabelle und prüft jede Zeile.", "テーブルを読み込み、誤りを確認します。", "Читает всю таблицу и проверяет каждую строку."])
def test_real(doc):
    assert prose.informative(doc, "read_table", ["rows", "cols"])


def test_inherited_documentation(spark, files):
    base = f'class Base:\n    def m(self):\n        """{REAL}"""\n'
    mid = "class Mid(Base):\n    x = 1\n    def k(self):\n        pass\n"
    low = "class Low(Mid):\n    def m(self):\n        return 1\n    def n(self):\n        return 2\n"
    got = {(r.file_id, r.name): (r.description, r.inherited) for r in docpairs.pairs(files((1, "a.py", base), (2, "b.py", mid), (3, "c.py", low), (4, "d.py", None))).collect()}
    assert got[1, "m"] == (REAL, False) and (3, "n") not in got and (2, "k") not in got
    direct = "class Kid(Base):\n    def m(self):\n        return 1\n"
    got = {(r.file_id, r.name): (r.description, r.inherited) for r in docpairs.pairs(files((1, "a.py", base), (5, "e.py", direct))).collect()}
    assert got[5, "m"] == (REAL, True)


def test_inherited_through_bare_classes_and_interfaces(spark, files):
    chain = [f'class C0:\n    def m(self):\n        """{REAL}"""\n', *(f"class C{i}(C{i - 1}):\n    x = 1\n" for i in range(1, 17)), "class C17(C16):\n    def m(self):\n        return 1\n"]
    loop = "class P(Q):\n    def z(self):\n        return 1\nclass Q(P):\n    x = 1\n"
    face = f"public interface Face {{\n  /** {REAL} */\n  int m(int a);\n}}\n"
    kid = "public class Kid\n    implements Face {\n  /** {@inheritDoc} */\n  public int m(int a) { return 1; }\n}\n"
    rows = docpairs.pairs(files((1, "a.py", "".join(chain)), (2, "l.py", loop), (3, "Face.java", face), (4, "Kid.java", kid))).collect()
    got = {(r.file_id, r.name, r.inherited): r.description for r in rows}
    assert got == {(1, "m", False): REAL, (1, "m", True): REAL, (4, "m", True): REAL} and all(r.kind != "class" and r.code for r in rows)


def test_overriding_methods_and_imported_parents(spark, files):
    face = f"public class Face {{\n  /** {REAL} */\n  public int m(int a) {{ return 2; }}\n}}\n"
    kid = "public class Kid extends Face {\n  @Override\n  public int m(int a) { return 1; }\n}\n"
    one = 'class Base:\n    def m(self):\n        """Writes nothing at all to the other table but its name."""\n'
    two = f'class Base:\n    def m(self):\n        """{REAL}"""\n'
    low = "from pack.two import Base\nclass Low(Base):\n    def m(self):\n        return 1\n"
    rows = docpairs.pairs(files((1, "Face.java", face), (2, "Kid.java", kid), (3, "pack/one.py", one), (4, "pack/two.py", two), (5, "low.py", low))).collect()
    got = {(r.file_id, r.name, r.inherited): r.description for r in rows}
    assert got[2, "m", True] == REAL and got[5, "m", True] == REAL and len(got) == 5
    assert sorted(r.file_id for r in docpairs.documented(files((1, "Face.java", face), (2, "Kid.java", kid))).collect()) == [1]


def test_whole_signature(spark, files):
    text = "def f(\n" + "".join(f"    a{i},\n" for i in range(40)) + f'):\n    """{REAL}"""\n'
    assert docpairs.pairs(files((1, "a.py", text))).first().signature.endswith("a39, ):")


def test_empty(spark, files):
    assert docpairs.documented(files((1, "a.py", "")).limit(0)).count() == 0
