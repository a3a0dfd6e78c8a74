"""Symbols and types from nested source text: goldens by language."""

from __future__ import annotations

from lodestone.operators import syntax

CODE = {
    "a.py": '''import os
class Shop(Base, mixins.Named):
    """class Not: def no(): pass"""
    def open(self, a,
             b=(1, 2)):
        def inner():
            return 1
        return inner

    async def close(self):
        text = "def fake(): {"  # def other():
        return text

def free(x):
    return """
def quoted():
    pass
"""
x = 1
''',
    "src/Shop.java": """package com.demo;
/* class Gone { void no() {} }
*/
public class Shop<T extends Item> extends Base<T>
    implements Facade<Map<String, T>>, java.io.Closeable {
  private final Keys keys; // void comment() {
  public Shop(Keys keys) { this.keys = keys; }
  @Override
  public Map<String, List<T>> all(int n) throws Bad {
    for (int i = 0; i < n; i++) { run("void fake() {"); }
    return keys.all(n);
  }
  abstract void later(String s);
  enum Kind { A, B }
  interface Inner extends Runnable, Facade {
    int size();
  }
}
""",
    "web/app.ts": """export interface Shape extends Base, Named {
  area(): number;
}
export type Pair = { a: string };
export default class Circle extends Round<Shape> implements Shape {
  private r = `function no() {`;
  constructor(r: number) { super(); }
  area(): number {
    if (this.r) { return call(1); }
    return 2;
  }
}
export const twice = (x: number) => x * 2
const later = async function () {
  return 1;
};
export async function main(args: string[]) {
  const inner = (y: number): number => {
    return y;
  };
}
""",
}


def lines(spark, code=None):
    rows = [(p, k, x) for p, text in (code or CODE).items() for k, x in enumerate(text.split("\n"), 1)]
    return spark.createDataFrame(rows, "path string, line int, content string").repartition(3)


def test_symbols(spark):
    got = {(r.path, r.kind, r.name, r.line, r.end, r.around) for r in syntax.symbols(lines(spark)).collect()}
    assert got == {
        ("a.py", "class", "Shop", 2, 12, None), ("a.py", "method", "open", 4, 8, 2), ("a.py", "method", "inner", 6, 7, 4), ("a.py", "method", "close", 10, 12, 2),
        ("a.py", "function", "free", 14, 18, None),
        ("src/Shop.java", "class", "Shop", 4, 18, None), ("src/Shop.java", "method", "Shop", 7, 7, 4), ("src/Shop.java", "method", "all", 9, 12, 4),
        ("src/Shop.java", "method", "later", 13, 13, 4), ("src/Shop.java", "type", "Kind", 14, 14, 4), ("src/Shop.java", "type", "Inner", 15, 17, 4), ("src/Shop.java", "method", "size", 16, 16, 15),
        ("web/app.ts", "type", "Shape", 1, 3, None), ("web/app.ts", "method", "area", 2, 2, 1), ("web/app.ts", "type", "Pair", 4, 4, None), ("web/app.ts", "class", "Circle", 5, 12, None),
        ("web/app.ts", "method", "constructor", 7, 7, 5), ("web/app.ts", "method", "area", 8, 11, 5), ("web/app.ts", "function", "twice", 13, 13, None),
        ("web/app.ts", "function", "later", 14, 16, None), ("web/app.ts", "function", "main", 17, 21, None), ("web/app.ts", "function", "inner", 18, 20, 17),
    }
    assert syntax.symbols(lines(spark)).where("name = 'main'").first().id == "symbol:web/app.ts:main:17"


def test_type_relations(spark):
    found = syntax.type_relations(lines(spark))
    got = {(r.path, r.owner, r.line, r.kind, r.to) for r in found.collect()}
    assert got == {
        ("a.py", "Shop", 2, "extends", "Base"), ("a.py", "Shop", 2, "extends", "mixins.Named"),
        ("src/Shop.java", "Shop", 4, "extends", "Base"), ("src/Shop.java", "Shop", 4, "implements", "Facade"), ("src/Shop.java", "Shop", 4, "implements", "java.io.Closeable"),
        ("src/Shop.java", "Inner", 15, "extends", "Runnable"), ("src/Shop.java", "Inner", 15, "extends", "Facade"),
        ("web/app.ts", "Shape", 1, "extends", "Base"), ("web/app.ts", "Shape", 1, "extends", "Named"), ("web/app.ts", "Circle", 5, "extends", "Round"), ("web/app.ts", "Circle", 5, "implements", "Shape"),
    }
    more = {**CODE, "b.py": "class Base:\n    pass\n", "c.py": "class Named: pass\nclass Own(Named): pass\n", "d.py": "class Named: pass\n"}
    every = lines(spark, more)
    got = {(r.path, r.owner, r.to): (r.to_file, r.ambiguous) for r in syntax.resolved_types(syntax.type_relations(every), syntax.symbols(every)).collect()}
    assert got["a.py", "Shop", "Base"] == ("b.py", None) and got["a.py", "Shop", "mixins.Named"] == (None, 2) and got["c.py", "Own", "Named"] == ("c.py", None)


def test_masks():
    code, inside = syntax._code("a = 'it\\'s # no' + b  # yes", "py", None)
    assert code == "a = " + " " * len("'it_'s # no'") + " + b  " + " " * len("# yes") and inside is None
    assert syntax._code('x = """a', "py", None) == ("x =     ", '"""') and syntax._code('b""" + y', "py", '"""') == ("     + y", None)
    assert syntax._code("f(1) /* { */ + 2 // }", "java", None)[0] == "f(1)         + 2     "


def test_a_long_file_needs_no_array(spark):
    """Deep and long: every second line defines something."""
    text = "\n".join(f"def f{k}():\n    return {k}" for k in range(5_000))
    rows = syntax.symbols(lines(spark, {"long.py": text})).collect()
    assert len(rows) == 5_000 and all(r.end == r.line + 1 for r in rows)
    assert syntax.symbols(lines(spark, {"none.py": ""})).count() == 0


def test_heads_of_odd_lines(spark):
    """Rows that come twice, gaps between numbers, heads that reach into each other, and nulls; names that come twice in a head count once."""
    rows = [
        ("twice.java", 1, "class A extends B"), ("twice.java", 1, "class A extends B"), ("twice.java", 2, "{ }"),
        ("two.java", 1, "class A implements B, B {"), ("two.java", 1, "class A implements B, B {"), ("two.java", 2, "interface C extends D, D, E {"),
        ("far.java", 1, "class A"), ("far.java", 12, "extends B"), ("far.java", 13, "implements C {"), ("far.java", 40, "class D"), ("far.java", 60, "extends E {"),
        ("near.java", 2, "class A extends B"), ("near.java", 3, "class C extends D {"), ("near.java", 4, "class E extends F {"),
        ("odd.java", None, "class A extends B {"), ("odd.java", 2, None), ("odd.java", 3, "class C extends D {"), ("odd.java", 3, None),
        ("same.py", 1, "class A(B, B, c.B):"), ("same.py", 2, "class B(A,"), ("same.py", 3, "        A): pass"), (None, 1, None), (None, 2, ""),
    ]
    found = syntax.type_relations(spark.createDataFrame(rows, "path string, line int, content string"))
    known = [("a", "class", "B"), ("a", "class", "B"), ("b", "type", "B"), (None, "class", "C"), ("c", "class", None), (None, "class", "D"), ("d", "class", "D"), ("two.java", "class", "E"), ("e", "type", "E"), ("f", "method", "A")]
    got = [tuple(r) for r in syntax.resolved_types(found, spark.createDataFrame(known, "path string, kind string, name string")).collect()]
    assert sorted(got, key=str) == [
        ("far.java", "A", 1, "extends", "B", None, 2), ("near.java", "C", 3, "extends", "D", "d", None), ("near.java", "E", 4, "extends", "F", None, None), ("odd.java", "C", 3, "extends", "D", "d", None),
        ("same.py", "A", 1, "extends", "B", None, 2), ("same.py", "A", 1, "extends", "c.B", None, 2), ("same.py", "B", 2, "extends", "A", None, None),
        ("two.java", "A", 1, "implements", "B", None, 2), ("two.java", "C", 2, "extends", "D", "d", None), ("two.java", "C", 2, "extends", "E", "two.java", None),
    ]


def test_lines_are_dealt_once_for_heads(spark):
    """Lines are exchanged by path and never again: heads are put together where the lines lie, and both joins on types read one exchange."""
    every = lines(spark)
    alone = syntax.type_relations(every)._jdf.queryExecution().executedPlan().toString()
    assert alone.count("Exchange hashpartitioning(path") == 1 and alone.count("Exchange hashpartitioning") == 1 and "Join" not in alone
    found = syntax.resolved_types(syntax.type_relations(every), syntax.symbols(every))
    assert len(found.collect()) == 11
    final = found._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert final.count("MapInArrow") == 4  # masks and heads; masks and symbols, for both joins
