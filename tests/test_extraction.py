"""Definitions, spans, nesting and calls on small sources."""

import random
import re

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from spanloom.functions import languages as lang
from spanloom.operators import extraction as ex
from spanloom.operators import graph as gr
from spanloom.operators import lines as ln
from spanloom.plans import ordered
from spanloom.plans.callgraph import call_graph
from spanloom.session import cut

EXAMPLE = '''# main.py

def func_c():
    print("in func_c")

def func_b():
    func_c()

def func_a():
    func_b()

def main():
    func_a()
    func_b()

if __name__ == "__main__":
    main()
'''
CLASSES = '''import sys


def total(prices):
    return sum(prices)


def report(prices, out=sys.stdout):
    print(total(prices), file=out)
    return out


class Basket:
    size = 0

    def add(self, price):
        self.size += 1
        self.last = price

    def clear(self): self.size = 0
'''
RUST_PAIR = "fn foo() {\n    bar();\n}\nfn bar() {\n}  \n"


def files(spark, *pairs):
    return spark.createDataFrame(list(pairs), "path STRING, content STRING")


def spans(df):
    return sorted((r.target_id, r.name, r.start_line, r.end_line) for r in df.collect())


def edges(graph):
    return sorted((r.caller_id, r.callee_id, r.line_start) for r in graph.edges.collect())


def test_example_graph(spark):
    graph = call_graph(files(spark, ("main.py", EXAMPLE)), materialize=False)
    assert spans(graph.found) == [
        ("function", "func_a", 9, 10), ("function", "func_b", 6, 7), ("function", "func_c", 3, 4), ("function", "main", 12, 14),
    ]
    assert edges(graph) == [
        ("main.py:12:main", "main.py:6:func_b", 14),
        ("main.py:12:main", "main.py:9:func_a", 13),
        ("main.py:6:func_b", "main.py:3:func_c", 7),
        ("main.py:9:func_a", "main.py:6:func_b", 10),
    ]


@pytest.mark.parametrize("path,content", [("/example.py", "def foo():\n    bar()\ndef bar():\n    pass\n"), ("/example.rs", RUST_PAIR)])
def test_pairs(spark, path, content):
    graph = call_graph(files(spark, (path, content)), materialize=True)
    assert graph.nodes.count() == 2
    rows = graph.edges.collect()
    assert [(r.caller_id, r.callee_id) for r in rows] == [
        (f"{path}:1:foo", f"{path}:{3 if path.endswith('py') else 4}:bar")
    ]


def test_class_sample(spark):
    code = ex.code_lines(files(spark, ("/example.py", CLASSES)))
    found = ex.span_ends(code)
    assert spans(found) == [
        ("class", "Basket", 13, 20), ("function", "add", 16, 18), ("function", "clear", 20, 20),
        ("function", "report", 8, 10), ("function", "total", 4, 5),
    ]
    functions, classes = found.where("target_id = 'function'"), found.where("target_id = 'class'")
    assert spans(ex.exclude_claimed(functions, classes)) == [("function", "report", 8, 10), ("function", "total", 4, 5)]
    nested = ex.nest(classes, functions)
    assert {(r.name, r.parent_id) for r in nested.collect()} == {
        ("add", "/example.py:13:Basket"), ("clear", "/example.py:13:Basket"),
    }
    view = ex.nested_view(nested).collect()
    assert [c.name for c in view[0].children] == ["add", "clear"]


PY_HARD = '''@deco
async def one(
    a,
    b=call_default(),
):
    two()

def two(): three(); return "x(1)"
class A(Base):

    def m(self):
        def inner():
            deep()
        inner()


    x = 1
def three():
\tif a:
\t\tfour()   # five()


'''


def test_python_corner_cases(spark):
    source = files(spark, ("a.py", PY_HARD))
    code = ex.code_lines(source)
    found = ex.span_ends(code)
    assert spans(found) == [
        ("class", "A", 9, 17), ("function", "inner", 12, 13), ("function", "m", 11, 14),
        ("function", "one", 2, 6), ("function", "three", 18, 20), ("function", "two", 8, 8),
    ]
    functions = found.where("target_id = 'function'")
    calls = sorted((r.caller_id, r.callee_name, r.line_no) for r in ex.find_calls(code, functions).collect())
    assert calls == [
        ("a.py:11:m", "deep", 13), ("a.py:11:m", "inner", 14), ("a.py:12:inner", "deep", 13),
        ("a.py:18:three", "four", 20), ("a.py:2:one", "call_default", 4), ("a.py:2:one", "two", 6),
        ("a.py:8:two", "three", 8),
    ]
    inner = ex.find_calls(code, functions, innermost=True).where("line_no = 13").collect()
    assert [r.caller_id for r in inner] == ["a.py:12:inner"]


C_TEXT = '''int add(int a, int b);
static int
helper(void);
int add(int a, int b)
{
    if (a > b) { return helper(); }
    for (int i = 0; i < 3; i++) {
        log_it("}{ not a brace");  // }
    }
    return sizeof(a);
}
struct point { int x; };
void one(void) { two(); }
'''
CPP_TEXT = '''class Shape {
public:
    void draw() {
        paint(1);
    }
};
void Shape::move(int x) {
    draw();
}
'''
GO_TEXT = '''package main
type T struct {
    x int
}
func (t *T) Get(i int) int {
    return helper(i)
}
func main() {
    go run()
}
'''
RS_TEXT = '''struct Unit;
impl<T> Shape for Circle {
    pub fn area(&self) -> [u8; 2] {
        match self { _ => { compute() } }
    }
    fn decl(&self);
}
pub async fn top()
where T: X
{
    area()
}
'''


def test_brace_languages(spark):
    source = files(spark, ("a.c", C_TEXT), ("b.cpp", CPP_TEXT), ("c.go", GO_TEXT), ("d.rs", RS_TEXT))
    code = ex.code_lines(source)
    found = ex.span_ends(code)
    got = sorted((r.path, r.target_id, r.name, r.start_line, r.end_line) for r in found.collect())
    assert got == [
        ("a.c", "class", "point", 12, 12), ("a.c", "function", "add", 4, 11), ("a.c", "function", "one", 13, 13),
        ("b.cpp", "class", "Shape", 1, 6), ("b.cpp", "function", "draw", 3, 5), ("b.cpp", "function", "move", 7, 9),
        ("c.go", "class", "T", 2, 4), ("c.go", "function", "Get", 5, 7), ("c.go", "function", "main", 8, 10),
        ("d.rs", "class", "Circle", 2, 7), ("d.rs", "function", "area", 3, 5), ("d.rs", "function", "top", 8, 12),
    ]
    functions = found.where("target_id = 'function'")
    calls = sorted((r.caller_id, r.callee_name) for r in ex.find_calls(code, functions).collect())
    assert calls == [
        ("a.c:13:one", "two"), ("a.c:4:add", "helper"), ("a.c:4:add", "log_it"),
        ("b.cpp:3:draw", "paint"), ("b.cpp:7:move", "draw"),
        ("c.go:5:Get", "helper"), ("c.go:8:main", "run"),
        ("d.rs:3:area", "compute"), ("d.rs:8:top", "area"),
    ]


def test_lines_table_gives_the_same_code_rows(spark):
    source = files(
        spark, ("main.py", EXAMPLE), ("x.py", CLASSES), ("a.py", PY_HARD), ("a.c", C_TEXT), ("d.rs", RS_TEXT), ("n.txt", "def no(): pass")
    )
    from_files = ex.code_lines(source)
    from_lines = ex.code_lines_of(ln.split_lines(source))
    assert spans(ex.span_ends(from_files)) == spans(ex.span_ends(from_lines))
    keep = [c for c in from_files.columns if c != "closes"]
    rows = [sorted(map(str, x.where("style = 'indent'").select(keep).collect())) for x in (from_files, from_lines)]
    assert rows[0] == rows[1] and len(rows[0]) > 30
    calls = [ex.find_calls(x, ex.span_ends(x).where("target_id = 'function'")).collect() for x in (from_files, from_lines)]
    assert sorted(map(str, calls[0])) == sorted(map(str, calls[1]))


def test_block_edges_do_not_matter(spark, monkeypatch):
    """One long file, cut into tiny blocks: the same spans as in one block."""
    rng = random.Random(11)
    out, depth = [], 0
    for i in range(400):
        depth = rng.randint(0, min(depth + 1, 5)) if out and out[-1].strip().startswith("def") is False else depth + 1
        if depth > 5:
            depth = 5
        out.append("    " * depth + (f"def f{i}():" if rng.random() < 0.3 else rng.choice(["x()", "", "y = 1"])))
    source = files(spark, ("big.py", "\n".join(out)), ("d.rs", RS_TEXT * 40))
    code = ex.code_lines(source)
    want = spans(ex.span_ends(code))
    small = {}
    for name in ("following", "following_by_size", "preceding", "running_sum"):
        whole = getattr(ordered, name)
        small[name] = lambda *a, _f=whole, **k: _f(*a, **k, block=7)
        monkeypatch.setattr(ex, name, small[name])
    assert spans(ex.span_ends(code)) == want
    assert spans(ex.span_ends(code, stored=True)) == want
    assert spans(ex.span_ends(ex.code_lines_of(ln.split_lines(source)))) == want


def test_ordered_lookups_match_brute_force(spark):
    rng = random.Random(2)
    rows = [(rng.choice("ab"), p, rng.randint(0, 9) if rng.random() < 0.2 else None) for p in rng.sample(range(300), 200)]
    df = spark.createDataFrame(rows, "k STRING, p INT, v INT")
    got = ordered.following(df, ["k"], "p", F.col("v"), "after", block=16)
    got = ordered.preceding(got, ["k"], "p", F.col("v"), "before", block=16)
    got = ordered.running_sum(got, ["k"], "p", F.coalesce("v", F.lit(0)), "total", block=16)
    for r in got.collect():
        later = sorted((p, v) for k, p, v in rows if k == r.k and p > r.p and v is not None)
        early = sorted((p, v) for k, p, v in rows if k == r.k and p < r.p and v is not None)
        assert r.after == (later[0][1] if later else None)
        assert r.before == (early[-1][1] if early else None)
        assert r.total == sum(v for k, p, v in rows if k == r.k and p <= r.p and v)


def test_names_resolve_to_the_first_file(spark):
    graph = call_graph(
        files(spark, ("b.py", "def foo():\n    pass\n"), ("a.py", "def foo():\n    foo()\n    foo()\n    gone()\n")), materialize=False
    )
    assert edges(graph) == [("a.py:1:foo", "a.py:1:foo", 2), ("a.py:1:foo", "a.py:1:foo", 3)]
    assert [(r.callee_name, r.n_calls) for r in gr.unresolved_calls(graph.calls, graph.nodes).collect()] == [("gone", 1)]
    status = {(r.callee_name, r.status) for r in gr.name_candidates(graph.calls, graph.nodes).collect()}
    assert status == {("foo", "ambiguous"), ("gone", "none")}


def test_map_fields_falls_back_to_the_path(spark):
    found = spark.createDataFrame(
        [("p.py", "f", 1, 2, None), ("p.py", "g", 3, 4, "q.py")],
        "path STRING, name STRING, start_line INT, end_line INT, file STRING",
    )
    rows = {r.name: r["loc"] for r in ex.map_fields(found, ex.as_node_fields).collect()}
    assert (rows["f"].file, rows["g"].file) == ("p.py", "q.py")


def test_short_lists_are_one_row(spark):
    """Wherever the calls lie in the file."""
    calls = spark.createDataFrame([("f", "g", 4095), ("f", "h", 4096), ("k", "g", 1)], "caller_id STRING, callee_id STRING, line_start INT")
    rows = {(r.caller_id, r.part): list(r.callees) for r in gr.adjacency(calls).collect()}
    assert rows == {("f", 0): ["g", "h"], ("k", 0): ["g"]}
    assert len(gr.adjacency(calls, 1).collect()) == 3
    found = spark.createDataFrame(
        [("p", "function", "a", 4095, 4095, "c"), ("p", "function", "b", 4097, 4098, "c")],
        "path STRING, target_id STRING, name STRING, start_line INT, end_line INT, parent_id STRING",
    )
    assert [[c.name for c in r.children] for r in ex.nested_view(found).collect()] == [["a", "b"]]


def test_dip_is_exact_at_any_depth(spark):
    rng = random.Random(5)
    lines = ["{{{{{}}}}}}}{{", "", "}{", "{" * 40 + "}" * 41, *("".join(rng.choice("{}") for _ in range(rng.randrange(30))) for _ in range(200))]
    rows = spark.createDataFrame([(x,) for x in lines], "b STRING").select("b", lang.depth_dip(F.col("b")).alias("dip")).collect()
    for r in rows:
        depth = low = 0
        for c in r.b:
            depth += 1 if c == "{" else -1
            low = min(low, depth)
        assert r.dip == low, r.b


PY_TEXT = '''def f(x):
    \"\"\"Uses ghost().

def inside(): pass
    >>> helper(1)
    \"\"\"
# at the margin: gone()
    a = r'foo(1)' + f"# {x}" + str(x)
    b = {'k(': 1, "it's(": open(x)}
    return \"\"\"one
two(1)\"\"\".strip()

def größe():
    messen()
'''
C_HARD = '''/* int fake(void) {
   other();
*/
int real(void) {
    /* } */ a("/* "); b();
    c('"'); // d(
}
static int
helper(char *s)
{
    return s[0] == '}' || e();
}
'''
CPP_HARD = '''class A {
public:
    A(int x) : v(x) {
        run<int>(1);
    }
    ~A() {}
};
A::A()
{
    auto s = R"(} fake( ")"; raw(1'000);
}
std::vector<int> A::all(int n) {
    FOREACH(n) { go(); }
}
'''
GO_HARD = '''package p
func f() string {
    s := `func no() {
x(1)
`
    return g(s)
}
func h() rune { return k('}') }
'''
RS_HARD = '''/* a /* b */ fn no() { */
impl<T: Foo<U>> Bar {
    fn pairs<'a>(x: &'a str) -> [[u8; 4]; 2] {
        b::<u8>(1); c(r#"d( " }"#); e("
}
f(");
    }
}
'''


def test_comments_and_literals_are_no_code(spark):
    texts = ("a.py", PY_TEXT), ("a.c", C_HARD), ("b.cpp", CPP_HARD), ("c.go", GO_HARD), ("d.rs", RS_HARD)
    code = ex.code_lines(files(spark, *texts))
    found = ex.span_ends(code)
    assert sorted((r.path, r.target_id, r.name, r.start_line, r.end_line) for r in found.collect()) == [
        ("a.c", "function", "helper", 9, 12), ("a.c", "function", "real", 4, 7),
        ("a.py", "function", "f", 1, 11), ("a.py", "function", "größe", 13, 14),
        ("b.cpp", "class", "A", 1, 7), ("b.cpp", "function", "A", 3, 5), ("b.cpp", "function", "A", 6, 6),
        ("b.cpp", "function", "A", 8, 11), ("b.cpp", "function", "all", 12, 14),
        ("c.go", "function", "f", 2, 7), ("c.go", "function", "h", 8, 8),
        ("d.rs", "class", "Bar", 2, 8), ("d.rs", "function", "pairs", 3, 7),
    ]
    functions = found.where("target_id = 'function'")
    calls = sorted((r.file, r.callee_name) for r in ex.find_calls(code, functions).collect())
    assert calls == [
        ("a.c", "a"), ("a.c", "b"), ("a.c", "c"), ("a.c", "e"),
        ("a.py", "messen"), ("a.py", "open"), ("a.py", "str"), ("a.py", "strip"),
        ("b.cpp", "FOREACH"), ("b.cpp", "go"), ("b.cpp", "raw"), ("b.cpp", "run"),
        ("c.go", "g"), ("c.go", "k"), ("d.rs", "b"), ("d.rs", "c"), ("d.rs", "e"),
    ]


def test_bare_text_keeps_every_line(spark):
    rng = random.Random(3)
    signs = ["'", '"', "`", "#", "//", "/*", "*/", "\\", "\n", "\r\n", "\x0c", " ", "a(", "R", "r", "8", " ", "'''", '"""', "}", "é"]
    texts = [(f"{i}.{rng.choice(list(lang.STYLES))}", "".join(rng.choices(signs, k=rng.randrange(60)))) for i in range(300)]
    texts += [("long.py", "x = '" + "ab" * 300_000 + "'\n'''" + "line\n" * 100_000 + "'''\n"), ("long.c", "/*" + "* \n" * 200_000 + "*/ f();")]
    rows = files(spark, *texts).withColumn("bare", lang.bare_text(F.col("content"), F.substring_index("path", ".", -1)))
    for r in rows.collect():
        assert [c for c in r.bare if c in "\n\r\x0c "] == [c for c in r.content if c in "\n\r\x0c "], r.path


def test_mark_by_bracket_depth(spark):
    cases = {"-> [[u8; 4]; 2] {": "{", "f((a;b)(c{d}));": ";", "x(": None, "int b) {": "{", "for (;;) a[{;": None, "": None}
    rows = spark.createDataFrame([(k,) for k in cases], "b STRING").select("b", lang.first_mark(F.col("b")).alias("m")).collect()
    assert {r.b: r.m for r in rows} == cases


def _tables(code, **known):
    found = ex.span_ends(code)
    calls = ex.find_calls(code, **known) if known else ex.find_calls(code, found.where("target_id = 'function'"))
    return spans(found), sorted(map(str, calls.collect()))


def test_whole_files_give_the_rows_of_the_look_ups(spark):
    """Blocks worked out in the file, without a shuffle, are those that look-ups per path find."""
    rng = random.Random(5)
    texts = [("main.py", EXAMPLE), ("x.py", CLASSES), ("hard.py", PY_HARD), ("d.rs", RS_TEXT), ("e.py", ""), ("n.py", None), (None, CLASSES)]
    pieces = ["def f{}(): g()", "class C{}:", "x{}(y())", ")", "  ] + z()", "", "name", "(call)(1)", "async def h{}(a=b()):"]
    for n in range(60):
        lines = [" " * rng.choice([0, 0, 1, 4, 4, 8]) + rng.choice(pieces).format(i) for i in range(rng.randint(1, 30))]
        texts.append((f"r{n}.py", "\n".join(lines)))
    source = files(spark, *texts).repartition(1)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")  # files go on in the next batch
    try:
        code = ex.code_lines(source, whole=True)
        assert _tables(code, innermost=False) == _tables(ex.code_lines(source))
        functions = ex.span_ends(ex.code_lines(source)).where("target_id = 'function'")
        inner = [ex.find_calls(code, innermost=True), ex.find_calls(ex.code_lines(source), functions, innermost=True)]
        assert sorted(map(str, inner[0].collect())) == sorted(map(str, inner[1].collect()))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_blocks_of_stored_rows_need_no_shuffle(spark):
    code = cut(ex.code_lines(files(spark, ("main.py", EXAMPLE), ("x.py", CLASSES)), whole=True))
    for df in (ex.span_ends(code, ("indent",), stored=True), ex.find_calls(code, stored=True)):
        assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString() and df.count() > 4


def test_files_that_share_a_path_see_each_other(spark):
    source = files(spark, ("main.py", EXAMPLE), ("x.py", CLASSES), ("x.py", CLASSES), ("x.py", EXAMPLE))
    assert _tables(ex.code_lines(source, whole=True), innermost=False) == _tables(ex.code_lines(source))


def test_whole_files_reach_the_batches_unsplit(spark):
    """A file is one row up to the batch function; calls, names and breaks are those of the line rules."""
    texts = [
        ("u.py", "def größe_1(x):\r\n\tf (ñ(1), 2x(3))\x0c\tif (a): e\u0301t(1)\u2028\tdefine(class_(2))\n"),
        ("v.py", "class A(B):\n  def f(self): return f(f)(1)\n  async  def\tg(): x = [h\n   (1), (lambda: not(k()))]\n"),
        ("w.py", "def f():\n  a \\\n  (1)\n  b = 'x(1)' # y(2)\n  g(\n\n  )(2)\nclass C: z()"),
        ("x.py", "\n\n \t\n"),
    ]
    source = files(spark, *texts)
    code = ex.code_lines(source, whole=True)
    for n in (1, 1 << 20):
        ex.bl.SLICE_BYTES, kept = n, ex.bl.SLICE_BYTES
        try:
            rows = list(ex.bl.block_rows(_whole_input(source)))
        finally:
            ex.bl.SLICE_BYTES = kept
        assert sum(r.num_rows for r in rows) == ex.code_lines(source).count()
    assert _tables(code, innermost=False) == _tables(ex.code_lines(source))
    plan = ex._whole_files(source)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "Generate" not in plan


def _whole_input(source):
    bare = source.select("path", lang.bare_text(F.col("content"), F.lit("py")).alias("content")).toPandas()
    texts = ["\n".join(lang_lines(t)) for t in bare["content"]]
    none = pa.array([None] * len(texts), pa.list_(pa.int32()))
    return [pa.record_batch([list(bare["path"]), texts, none], ["path", "content", "joined"])]


def lang_lines(text):
    return re.split(ex.tx.LINE_BREAK, text)
