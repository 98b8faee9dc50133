"""The front end: metrics of bodies, declarations, calls, signatures."""

import pytest

from callatlas.sources import csharp as C

BODIES = [
    ("", 0, 0),
    ("if (true) { }", 1, 1),
    ("if (true) { } else { }", 2, 1),
    ("if (true) { } else if (false) { } else { }", 3, 2),
    ("if (true) { if (true) { } }", 3, 2),
    ("for (int i = 0; i < 10; i++) { while (true) { if (false) { } } }", 6, 3),
    ("for (int i = 0; i < 10; i++) { }", 1, 1),
    ("while (true) { }", 1, 1),
    ("do { } while (true);", 1, 1),
    ("switch (0) { case 0: break; }", 1, 1),
    ("try { } catch { }", 1, 1),
    ("try { if (a) { } } catch (Exception e) when (e.X && b) { if (c) { } } finally { f(); }", 5, 2),
    ("if (true && false) { }", 2, 1),
    ("if (true && false && true) { }", 2, 1),
    ("if (true && false || true) { }", 3, 1),
    ("if (a && b || c && d) { }", 4, 1),
    ("var x = true ? 1 : 0;", 1, 0),
    ("var x = a ? b : c ? d : e;", 3, 0),
    ("goto end; end: return;", 1, 0),
    ("System.Action a = () => { if (true) { } };", 2, 2),
    ("if (true) { } else if (true) { } else if (true) { } else { }", 4, 3),
    ("return x ?? new object();", 1, 0),
    ("return x ?? y ?? z;", 2, 0),
    ("int? n = null; string? s = o?.ToString(); var y = l?[0]; x ??= 3;", 0, 0),
    ("var r = x switch { 1 => \"a\", _ when p && q => \"b\", _ => f(c ? 1 : 2) };", 4, 0),
    ("using (var s = Open()) { lock (o) { foreach (var x in xs) { } } }", 1, 3),
    ("int Local(int a) { return a > 0 ? 1 : 2; } Local(3);", 2, 0),
    ("var q = xs.Where(x => x.A && x.B).Select(async (y) => await G(y));", 1, 1),
    ("var s = $\"{(a ? b : c)} {d}\"; var t = @\"if (x) { \"\" }\"; // if (y)\n /* while */ char c2 = '{';", 1, 0),
    ("var d = new Dictionary<string, List<int>> { [\"a\"] = new() { 1 } }; bool z = i < 3 && j > 4;", 1, 0),
    ("foreach (var (a, b) in pairs) if (a) return; else Do();", 4, 2),
]


@pytest.mark.parametrize("body,complexity,depth", BODIES)
def test_metrics(body, complexity, depth):
    (m,) = [m for m in C.File("f", "class C { void M() { " + body + " } }").methods if not m["is_local"]]
    assert (m["complexity"], m["depth"]) == (complexity, depth)


def test_local_functions_and_arrows():
    f = C.File("f", "class C { int A(int x) => x > 0 ? 1 : 2; void B() { int L() { if (a) { } return 1; } L(); } abstract void D(); }")
    assert {m["name"]: (m["complexity"], m["depth"]) for m in f.methods} == {"A": (1, 0), "B": (2, 1), "L": (1, 1), "D": (None, None)}


SHOP = """
using System;
namespace Shop.Orders;

public interface IStore { void Save(Order o); int Count { get; } }
public abstract class Base { protected virtual void Log(string m) { Console.WriteLine("log " + m); } public Base(int n) { } }
public static class Extensions { public static string Shout(this string s) => s.ToUpper() + "!"; }
public record Order(int Id);
public class OrderService : Base, IStore
{
    private readonly IStore _store;
    private Func<int, int> _f = x => x > 0 ? x : -x;
    public int Total { get; private set; } = 3;
    public OrderService(IStore store) : base(1) { _store = store; }
    public OrderService() : this(null) { }
    public bool ProcessOrder(string name, int? count = null)
    {
        var helper = new Helper<int>(2);
        if (name != null && count > 3) { Validate(name); helper.Run(); _store.Save(new Order(1)); }
        Log("processed order 42");
        return name.Shout() == "x";
    }
    private void Validate(string name) { int n = 1, k = 0; n += k; Helper<int>.Make(n); }
    protected override void Log(string m) { }
    void IStore.Save(Order o) { }
    class Nested { static async void Go() { } }
    enum Color { Red, Green }
    delegate void Done(int x);
}
class Helper<T> { public Helper(int a) { } public Helper() { } public void Run() { Only(); } public void Run(int x) { } public static void Make(int n) { } void Only() { } }
"""


def test_declarations():
    f = C.File("/src/shop.cs", SHOP)
    assert {t["id"]: t["kind"] for t in f.types} == {
        "Shop.Orders.IStore": "Interface", "Shop.Orders.Base": "Class", "Shop.Orders.Extensions": "Class", "Shop.Orders.Order": "Record", "Shop.Orders.OrderService": "Class",
        "Shop.Orders.OrderService.Nested": "Class", "Shop.Orders.OrderService.Color": "Enum", "Shop.Orders.OrderService.Done": "Delegate", "Shop.Orders.Helper<T>": "Class",
    }
    m = {x["id"]: x for x in f.methods}
    process = m["Shop.Orders.OrderService.ProcessOrder(string, int?)"]
    assert process["full_name"] == "bool Shop.Orders.OrderService.ProcessOrder(string name, int? count)" and process["accessibility"] == "Public" and process["start_line"] == 16 and process["end_line"] == 22
    assert process["complexity"] == 2 and process["literals"] == ["processed order 42", "x"]
    assert m["Shop.Orders.OrderService.Log(string)"]["is_override"] and m["Shop.Orders.Base.Log(string)"]["is_virtual"] and m["Shop.Orders.IStore.Save(Order)"]["is_abstract"]
    assert m["Shop.Orders.OrderService.Nested.Go()"]["is_async"] and m["Shop.Orders.OrderService.Nested.Go()"]["is_static"]
    assert [x for x in m if ".ctor" in x] == ["Shop.Orders.Base..ctor(int)", "Shop.Orders.OrderService..ctor(IStore)", "Shop.Orders.OrderService..ctor()", "Shop.Orders.Helper<T>..ctor(int)", "Shop.Orders.Helper<T>..ctor()"]
    assert len(m) == 17


def test_signature():
    f = C.File("f", 'class C { void M() { int count = 10; string s = "x"; if (count > 5 && true) { s.count(s, null, \'c\'); } for (var i = 0; ; ) { } } }')
    assert " ".join(f.methods[0]["signature"].split()) == "{ int v0 = LIT_NUM; string v1 = LIT_STR; if (v0 > LIT_NUM && LIT_BOOL) { v1.count(v1, LIT_NULL, LIT_CHAR); } for (var v2 = LIT_NUM; ; ) { } }"


def test_ingest(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "shop.cs").write_text(SHOP)
    (tmp_path / "bad.cs").write_text("class X { void M( { }")
    (tmp_path / "main.cs").write_text("using System;\nvar s = new Shop.Orders.OrderService();\ns.ProcessOrder(\"a\", 1);\nvoid Inner() { }\nInner();\n")
    t, calls, errors = C.ingest(spark, C.read_sources(spark, str(tmp_path)))
    assert [r.path.split("/")[-1] for r in errors.collect()] == ["bad.cs"]
    p = "Shop.Orders."
    got = {(r.caller_id.replace(p, ""), r.callee_id.replace(p, "")): r.kind for r in calls.collect()}
    process = "OrderService.ProcessOrder(string, int?)"
    assert got == {
        (process, "Helper<T>..ctor(int)"): "Constructor", (process, "OrderService.Validate(string)"): "Direct", (process, "Helper<T>.Run()"): "Direct", (process, "IStore.Save(Order)"): "Interface",
        (process, "OrderService.Log(string)"): "Virtual", (process, "Extensions.Shout(string)"): "Extension", ("OrderService.Validate(string)", "Helper<T>.Make(int)"): "Direct",
        ("Helper<T>.Run()", "Helper<T>.Only()"): "Direct", ("OrderService..ctor(IStore)", "Base..ctor(int)"): "Constructor", ("OrderService..ctor()", "OrderService..ctor(IStore)"): "Constructor",
        ("<top-level>", "OrderService..ctor()"): "Constructor", ("<top-level>", process): "Direct",
    }
    assert {(r.type_id, r.interface_id) for r in t.type_implements.collect()} == {(p + "OrderService", p + "IStore")}
    rows = {r.method_id: r for r in t.metrics.collect()}
    assert rows[p + process].cognitive_complexity == 2 and rows[p + process].lines_of_code == 6 and rows[p + process].nesting_depth == 1
    payload = {r.method_id: r.semantic_payload for r in t.normalized_methods.collect()}
    assert payload[p + process].startswith("process order string int bool validate run")
    assert t.namespaces.count() == 1 and t.methods.count() == 17
