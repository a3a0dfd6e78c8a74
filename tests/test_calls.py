"""Java receivers, wildcard imports, dispatch and calls: goldens."""

from __future__ import annotations

from lodestone.operators import calls
from tests.test_syntax import lines

MAIN, TEST = "src/main/java/com/demo/", "src/test/java/com/demo/"
CODE = {
    MAIN + "DemoApplication.java": "package com.demo;\nimport com.demo.shop.ShopController;\npublic class DemoApplication {\n  public static void main(String[] a) {\n    new ShopController().open(1);\n  }\n}\n",
    MAIN + "shop/ShopController.java": """package com.demo.shop;
import com.demo.order.IOrderFacade;
import static com.demo.util.Keys.KEY;
import com.demo.util.*;
public class ShopController extends Base<Keys> {
  private final IOrderFacade facade = null;
  private ShopService service;
  public int open(int n) {
    Metrics.count("Counters.count()"); // Counters.count()
    facade.place(n);
    service.load(n);
    int left = helper(n);
    return open(left);
  }
  int helper(int n) { return n > 0 ? helper(n - 1) : other.place(n); }
}
""",
    MAIN + "shop/ShopService.java": "package com.demo.shop;\nimport com.demo.util.Keys;\nclass ShopService {\n  public int load(int n) {\n    Keys.make();\n    return n;\n  }\n  void place() {}\n}\n",
    MAIN + "shop/Base.java": "package com.demo.shop;\npublic abstract class Base<T> {\n  int load(int n) { return n; }\n}\n",
    MAIN + "order/IOrderFacade.java": "package com.demo.order;\npublic interface IOrderFacade {\n  int place(int n);\n}\n",
    MAIN + "order/OrderFacadeImpl.java": "package com.demo.order;\n// class X implements Base {\npublic class OrderFacadeImpl\n    implements IOrderFacade, com.demo.shop.Base.Inner {\n  public int place(int n) { return n; }\n}\n",
    MAIN + "util/Keys.java": "package com.demo.util;\npublic class Keys {\n  static void make() {}\n}\n",
    MAIN + "util/Metrics.java": "package com.demo.util;\npublic class Metrics {\n  public static void count(String s) {}\n}\n",
    MAIN + "util/Counters.java": "package com.demo.util;\npublic class Counters {\n  public static void count() {}\n}\n",
    TEST + "util/MetricsTest.java": "package com.demo.util;\npublic class MetricsTest {\n  void t(Metrics m) { m.count(\"\"); }\n}\n",
    "tool/a.py": "from tool import b\n\ndef run():\n    go()\n    run()\n    go(); stop()\n",
    "tool/b.py": "def go():\n    pass\n",
}


def test_imports_and_dispatch(spark):
    every = lines(spark, CODE)
    types = calls.java_types(every)
    edges = {(r.src.removeprefix(MAIN), r.dst.removeprefix(MAIN)) for r in calls.java_file_imports(every, types).collect()}
    assert edges == {
        ("DemoApplication.java", "shop/ShopController.java"), ("shop/ShopService.java", "util/Keys.java"),
        ("shop/ShopController.java", "order/IOrderFacade.java"), ("shop/ShopController.java", "util/Keys.java"), ("shop/ShopController.java", "util/Metrics.java"),
        ("shop/ShopController.java", "util/Counters.java"),
    }  # fmt: skip  (mentioned in a string: a mention is any word below the imports)
    got = {(r.path.removeprefix(MAIN), r.target.removeprefix(MAIN), r.kind, r.line) for r in calls.dispatch_edges(every, types).collect()}
    assert got == {("order/OrderFacadeImpl.java", "order/IOrderFacade.java", "implements", 3), ("order/OrderFacadeImpl.java", "shop/Base.java", "implements", 3), ("shop/ShopController.java", "shop/Base.java", "extends", 5)}


def test_calls(spark):
    every = lines(spark, CODE)
    imports = calls.java_file_imports(every, calls.java_types(every)).union(spark.createDataFrame([("tool/a.py", "tool/b.py")], "src string, dst string"))
    short = lambda i: None if i is None else (i.split(":")[1].rsplit("/", 1)[-1], *i.split(":")[2:])
    got = {(short(r.caller), short(r.callee), r.line) for r in calls.call_edges(every, imports).collect()}
    shop = "ShopController.java"
    assert got == {
        (("DemoApplication.java", "main", "4"), (shop, "ShopController", "5"), 5), (("DemoApplication.java", "main", "4"), (shop, "open", "8"), 5),
        ((shop, "open", "8"), ("Metrics.java", "count", "3"), 9), ((shop, "open", "8"), ("IOrderFacade.java", "place", "3"), 10), ((shop, "open", "8"), ("ShopService.java", "load", "4"), 11),
        ((shop, "open", "8"), (shop, "helper", "15"), 12), ((shop, "open", "8"), (shop, "open", "8"), 13),
        ((shop, "helper", "15"), (shop, "helper", "15"), 15), ((shop, "helper", "15"), ("IOrderFacade.java", "place", "3"), 15),
        (("ShopService.java", "load", "4"), ("Keys.java", "make", "3"), 5),
        (("a.py", "run", "3"), ("b.py", "go", "1"), 4), (("a.py", "run", "3"), ("a.py", "run", "3"), 5), (("a.py", "run", "3"), ("b.py", "go", "1"), 6),
    }


def test_empty(spark):
    every = lines(spark, {"x.java": ""})
    assert calls.call_edges(every, spark.createDataFrame([], "src string, dst string")).count() == 0


def test_no_side_goes_through_the_driver(spark):
    """Types, symbols and lines grow with the tree: however small Spark guesses them to be, no join broadcasts them."""
    from lodestone.plans import javatree

    for q in (javatree.j07_java_imports, javatree.x12_java_calls, javatree.x13_dispatch_edges, javatree.x17_type_relations):
        plan = q(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert "Broadcast" not in plan and "SortMergeJoin" in plan, q.__name__


def test_lines_are_masked_and_scanned_once(spark, monkeypatch):
    """Calls, receivers, symbols and scopes come from one masking and one scan, both kept: the query's plan runs neither again."""
    from lodestone.plans import javatree

    runs = []
    for name in ("code_lines", "_found"):
        monkeypatch.setattr(calls.syntax, name, lambda df, f=getattr(calls.syntax, name), name=name: runs.append(name) or f(df))
    plan = javatree.x12_java_calls(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert sorted(runs) == ["_found", "code_lines"] and "MapInArrow" not in plan


def test_a_name_is_looked_up_once_a_file(spark):
    """A file's own symbol comes first, then the first imported one; repeated calls share the look-up."""
    from lodestone.operators import code

    sites = spark.createDataFrame([("a.py", k, 0, None, n) for k, n in enumerate(["f", "f", "g", "g", "own", "none"], 10)], "path string, line int, nth int, receiver string, name string")
    symbols = spark.createDataFrame([("a.py", "function", "own", 1, 9), ("b.py", "function", "own", 1, 2), ("c.py", "function", "f", 5, 6), ("b.py", "function", "f", 7, 8), ("b.py", "function", "f", 3, 4), ("d.py", "function", "g", 1, 2)], "path string, kind string, name string, line int, end int")
    imports = spark.createDataFrame([("a.py", "c.py"), ("a.py", "b.py"), ("b.py", "d.py")], "src string, dst string")
    asked = [tuple(r) for r in code.call_targets(sites, symbols, imports).where("path = 'a.py'").collect()]
    assert sorted(asked) == [("a.py", "f", "b.py", 3), ("a.py", "own", "a.py", 1)]
    got = {(r.line, r.name, r.callee_path, r.callee_line) for r in code.resolved_calls(sites, symbols, imports).collect()}
    assert got == {(10, "f", "b.py", 3), (11, "f", "b.py", 3), (14, "own", "a.py", 1)}
