"""Declarations of small sources."""

import pytest

from sparkloom.operators import facts

SOURCES = {
    "go": ("package x\n// func no() {}\nfunc (s *Store) Get(k string) int {\n\treturn find(k)\n}\ntype Store struct {\n}\nfunc main() {\n\trun(\"func bad() {\")\n}\n", {("Store.Get", "method", 3, 5), ("Store", "struct", 6, 7), ("main", "function", 8, 10)}),
    "javascript": ("export class A extends B {\n  go(x) {\n    if (x) {\n      this.run(x)\n    }\n  }\n}\nconst f = (a) => {\n  return g(a)\n}\n/* class No {} */\n", {("A", "class", 1, 7), ("A.go", "method", 2, 6), ("f", "function", 8, 10)}),
    "rust": ("pub struct P {\n}\nimpl Show for P {\n    pub fn draw(&self) {\n    }\n}\nfn main() {}\n", {("P", "struct", 1, 2), ("P.draw", "method", 4, 5), ("main", "function", 7, 7)}),
    "java": ("public class T extends U {\n  private int n(int a) {\n    return a;\n  }\n  public static void main(String[] a) {\n  }\n}\n", {("T", "class", 1, 7), ("T.n", "method", 2, 4), ("T.main", "method", 5, 6)}),
    "ruby": ("module M\n  class C < D\n    def ok?\n      call(1)\n    end\n  end\nend\n", {("M", "module", 1, 7), ("M.C", "class", 2, 6), ("M.C.ok?", "method", 3, 5)}),
    "python": ("class A(B):\n    def f(self):\n        return 1\n\ndef g(:\n    pass\n", {("A", "class", 1, 4), ("A.f", "method", 2, 4), ("g", "function", 5, 7)}),
    "shell": ("#!/bin/sh\nf() {\n  echo\n}\n", {("f", "function", 2, 2)}),
    "sql": ("-- create table no (a int);\nCREATE TABLE IF NOT EXISTS t (a int);\ncreate or replace view v as select 1;\n", {("t", "table", 2, 2), ("v", "view", 3, 3)}),
    "markdown": ("# A\ntext\n## B\n```\n# no\n```\n# C\n", {("A", "section", 1, 6), ("A > B", "section", 3, 6), ("C", "section", 7, 8)}),
    "cpp": ("namespace n {\nclass K : public L {\n  int get() {\n    return 1;\n  }\n};\n}\nint K::put(int a)\n{\n  return a;\n}\n", {("n", "module", 1, 7), ("n.K", "class", 2, 6), ("n.K.get", "method", 3, 5), ("K.put", "method", 8, 11)}),
}


@pytest.mark.parametrize("lang", sorted(SOURCES))
def test_scan(lang):
    text, expected = SOURCES[lang]
    symbols, *_ = facts.scan(text, lang)
    assert {(s["qualname"], s["kind"], s["line"], s["end_line"]) for s in symbols} == expected


def test_bases_calls_entry(spark):
    rows = [(f"f.{k}", k, v[0]) for k, v in SOURCES.items()] + [("e", "go", ""), ("n", "go", None), ("u", "elvish", "x"), ("j", "json", "{}")]
    out = {r["path"]: r for r in facts.source_facts(spark.createDataFrame(rows, "path string, lang string, text string")).collect()}
    assert len(out) == len(rows) and out["n"]["symbols"] == [] and out["e"]["loc"] == 0
    assert [(b["qualname"], b["base"]) for b in out["f.javascript"]["bases"]] == [("A", "B")]
    assert {(c["owner"], c["raw"]) for c in out["f.javascript"]["calls"]} >= {("A.go", "this.run"), ("f", "g")}
    assert out["f.go"]["entry"] and out["f.java"]["entry"] and not out["f.ruby"]["entry"] and out["f.shell"]["entry"]


def test_every_language_takes_any_text():
    from hypothesis import given, settings
    from hypothesis import strategies as st

    @settings(max_examples=60, deadline=None)
    @given(st.sampled_from(sorted(facts.LANGUAGES)), st.text(alphabet="abc {}()\"'`/*#\n\t;=>:class fn def", max_size=200))
    def check(lang, text):
        for s in facts.scan(text, lang)[0]:
            assert 1 <= s["line"] <= s["end_line"] <= text.count("\n") + 1

    check()


MORE = {
    "kotlin": ("data class P(val a: Int) : Q() {\n  override fun <T> f(x: T) = 1\n}\nobject O\nenum class E {\n}\n", {("P", "class"), ("P.f", "method"), ("O", "object"), ("E", "class")}),
    "scala": ("case class A(x: Int) extends B {\n  def go(y: Int): Int = y\n}\ntrait T\n", {("A", "class"), ("A.go", "method"), ("T", "trait")}),
    "swift": ("public final class A: B {\n  static func f() -> Int {\n  }\n}\nextension A {\n}\nprotocol P {\n}\n", {("A", "class"), ("A.f", "method"), ("A", "extension"), ("P", "protocol")}),
    "php": ("abstract class A extends B {\n  public function f($x) {\n  }\n}\nfunction &g() {\n}\n", {("A", "class"), ("A.f", "method"), ("g", "function")}),
    "dart": ("class A extends B {\n  static int f(int x) {\n    return g(x);\n  }\n}\nextension E on A {\n}\n", {("A", "class"), ("A.f", "method"), ("E", "extension")}),
    "csharp": ("namespace N;\npublic class A : B {\n  [X]\n  public async Task<int> F(int x) {\n    return await G(x);\n  }\n  public A(int y) {\n  }\n}\n", {("A", "class"), ("A.F", "method"), ("A.A", "method")}),
    "typescript": ("export type X = A | B;\ninterface I extends J {\n}\nexport default async function* f() {\n}\nlet g = async x => x;\nlet h = 5;\nclass C {\n  k = (a) => a;\n}\n", {("X", "type"), ("I", "interface"), ("f", "function"), ("g", "function"), ("C", "class"), ("C.k", "method")}),
    "c": ("struct s {\n  int a;\n};\nstatic int *f(int a,\n  int b)\n{\n  return g(a);\n}\nint h(void);\nenum e { A };\n", {("s", "struct"), ("f", "function"), ("e", "enum")}),
    "go": ("type A[T any] struct {\n}\ntype I interface {\n}\ntype N int\nfunc (A) f() {\n}\nfunc g[T any](x T) {\n}\n", {("A", "struct"), ("I", "interface"), ("N", "type"), ("A.f", "method"), ("g", "function")}),
    "rust": ("pub(crate) enum E {\n}\nimpl<T> E {\n  pub async fn f(&self) {}\n}\nmod m {\n  trait R {}\n}\nmod far;\ntype Y = u8;\n", {("E", "enum"), ("E.f", "method"), ("m", "module"), ("m.R", "trait"), ("Y", "type")}),
    "bitbake": ("do_install() {\n}\npython do_x () {\n}\ndef f(d):\n", {("do_install", "function"), ("do_x", "function"), ("f", "function")}),
    "devicetree": ("/ {\n  uart0: serial@10 {\n  };\n};\n&i2c {\n};\n", {("/", "node"), ("serial@10", "node"), ("&i2c", "node")}),
}


@pytest.mark.parametrize("lang", sorted(MORE))
def test_declarations(lang):
    text, expected = MORE[lang]
    assert {(s["qualname"], s["kind"]) for s in facts.scan(text, lang)[0]} == expected
