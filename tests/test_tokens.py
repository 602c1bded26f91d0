"""Definitions and calls by tokens: statements over lines, declarators, branches; brackets against a stack."""

import random

import numpy as np
import pyarrow as pa
import pytest

from spanloom.functions import tokens as tk
from spanloom.operators import extraction as ex
from spanloom.plans.callgraph import call_graph


def graph_of(spark, path, content):
    graph = call_graph(spark.createDataFrame([(path, content)], "path STRING, content STRING"), materialize=False)
    found = sorted((r.target_id, r.name, r.start_line, r.end_line) for r in graph.found.collect())
    calls = sorted((r.caller_id.split(":", 2)[2], r.callee_name, r.line_no) for r in graph.calls.collect())
    return found, calls


C_PROBE = """static inline __attribute__((always_inline)) int fast(int a) {
    return a;
}
int (*pick(void))(int) {
    return plain
        (3);
}
int __attribute__((format(printf, 1, 2))) logged(const char *f, ...);
#define TWICE(x) ghost(x) + \\
    ghost(x)
typedef struct { int x; } anon;
struct point *moved(struct point *p)
{
    if (*next(p)) { fast(1); }
#ifdef X
    if (p->x) {
#else
    if (p->y && sub(p)) {
#endif
        fast(2);
    }
    for_each(i, 3) { fast
        (3); }
    return (int (*)(void)) p;
}
#ifdef X
int two(int a) {
#else
int two(int a, int b) {
#endif
    return plain(a);
}
#if A
int one(void) { return 1; }
#elif B
int one(void) { return 2; }
#endif
int last(void) { return two(1, 2); }
"""


def test_c_probe(spark):
    found, calls = graph_of(spark, "a.c", C_PROBE)
    assert found == [
        ("function", "fast", 1, 3), ("function", "last", 38, 38), ("function", "moved", 12, 25), ("function", "one", 34, 34),
        ("function", "one", 36, 36), ("function", "pick", 4, 7), ("function", "two", 27, 32), ("function", "two", 29, 32),
    ]
    assert calls == [
        ("last", "two", 38), ("moved", "fast", 14), ("moved", "fast", 20), ("moved", "fast", 22), ("moved", "for_each", 22),
        ("moved", "next", 14), ("moved", "sub", 18), ("pick", "plain", 5), ("two", "plain", 31), ("two", "plain", 31),
    ]


CPP_PROBE = """template <class T, int N = 3>
class Vec final : public Base<T> {
public:
    explicit Vec(int a) : x(a), y{make(a)}, z(
        other(a)) {}
    [[nodiscard]] int marked() { return 1; }
    V operator+(const V &o) const { return add(o); }
    int operator()(int x) { return apply
        <int>(x); }
    operator bool () const { return ok(); }
    bool operator == (const V &o) const noexcept(true);
    ~Vec() { release(); }
    void only_declared(int);
    struct Inner { int f() { return g(); } };
};
template <class T>
auto Vec<T>::size() const -> std::size_t
{
    auto s = [&](int a) { return deep(a); };
    return sizeof(s) + static_cast<int>(s(1)) + (a < b && call(c));
}
enum class Colour : char { red };
namespace n {
Vec make() { return Vec{one(1), Vec{}}; }
}
friend_of(x) {
"""


def test_cpp_probe(spark):
    found, calls = graph_of(spark, "b.cpp", CPP_PROBE)
    assert found == [
        ("class", "Colour", 22, 22), ("class", "Inner", 14, 14), ("class", "Vec", 2, 15), ("function", "Vec", 4, 5),
        ("function", "Vec", 12, 12), ("function", "f", 14, 14), ("function", "make", 24, 24), ("function", "marked", 6, 6),
        ("function", "operator bool", 10, 10), ("function", "operator()", 8, 9), ("function", "operator+", 7, 7), ("function", "size", 17, 21),
    ]
    assert calls == [
        ("Vec", "make", 4), ("Vec", "other", 5), ("Vec", "release", 12), ("f", "g", 14), ("make", "one", 24), ("operator bool", "ok", 10),
        ("operator()", "apply", 8), ("operator+", "add", 7), ("size", "call", 20), ("size", "deep", 19), ("size", "s", 20),
    ]


GO_PROBE = """package p
type (
    T struct {
        x int
    }
    I interface { Do(n int) }
    S = string
)
type G[K comparable] struct { k K }
func Map[K any](k K) (
    out []K,
    err error,
) {
    f := func(x int) T { return inner(x) }
    return Map[int](n), f(1)
}
func (t *T) Get(m map[string]struct{}) interface{} {
    g := handlers
    (t).Do(3)
    return g
}
func outside(x int) int
func last() { go run() }
"""


def test_go_probe(spark):
    found, calls = graph_of(spark, "c.go", GO_PROBE)
    assert found == [
        ("class", "G", 9, 9), ("class", "I", 6, 6), ("class", "T", 3, 5), ("function", "Get", 17, 21), ("function", "Map", 10, 16),
        ("function", "last", 23, 23),
    ]
    assert calls == [("Get", "Do", 19), ("Map", "Map", 15), ("Map", "f", 15), ("Map", "inner", 14), ("last", "run", 23)]


RS_PROBE = """#[derive(Debug)]
pub struct P<T: Clone + Fn(u8) -> u8, const N: usize = 4> where T: Iterator<Item = u8> { x: T }
impl<T: Fn(u8) -> u8 + 'static> fmt::Display for P<T, 3> where T: Fn(u8) -> u8 {
    fn fmt<'a>(&'a self, f: &mut F) -> Result<[u8; 2], E>
    where
        T: FnOnce(u8) -> u8,
    {
        helper
            ::<u8>(1)
            .chain (2);
        let c = |x: &dyn Fn(u8)| -> u8 { x(3) };
        println!("{}", shown(1));
    }
    fn declared(&self) -> impl Fn(u8);
}
pub trait Tr: Other { fn given(&self) { self.declared() } }
pub(crate) async unsafe extern "C" fn top() -> Box<dyn Fn() -> u8> { Some(1) }
"""


def test_rust_probe(spark):
    found, calls = graph_of(spark, "d.rs", RS_PROBE)
    assert found == [
        ("class", "P", 2, 2), ("class", "P", 3, 15), ("class", "Tr", 16, 16), ("function", "fmt", 4, 13), ("function", "given", 16, 16),
        ("function", "top", 17, 17),
    ]
    assert calls == [("fmt", "chain", 10), ("fmt", "helper", 8), ("fmt", "shown", 12), ("fmt", "x", 11), ("given", "declared", 16), ("top", "Some", 17)]


PY_PROBE = """def f(x):
    a = (plain
         (3))
    b = f"{plain(2)} {{ghost(1)}} {x:>{width(4)}}" + rf'{raw("(")}' + "no(1)" + b"no(2)"
    c = plain \\
        (4)
    x
    (y, z) = g(x)
    return [x for x in
            (1, 2)], f'''one {two(1)}
  three {four(2)}
'''

def after(): pass
"""


def test_python_probe(spark):
    found, calls = graph_of(spark, "e.py", PY_PROBE)
    assert found == [("function", "after", 14, 14), ("function", "f", 1, 12)]
    assert calls == [
        ("f", "four", 11), ("f", "g", 8), ("f", "plain", 2), ("f", "plain", 4), ("f", "plain", 5), ("f", "raw", 4), ("f", "two", 10), ("f", "width", 4),
    ]


def streams(texts, suffix="c"):
    lists = [[w for w in t] for t in texts]
    return tk.Stream(pa.array(lists, pa.list_(pa.string())), [suffix] * len(lists))


def test_brackets_match_a_stack():
    rng = random.Random(7)
    for trial in range(60):
        texts = []
        for _ in range(rng.randrange(1, 6)):
            text, held = [], []
            for _ in range(rng.randrange(80)):
                pick = rng.random()
                if pick < 0.3 and len(held) < 9:
                    held.append(rng.choice(["()", "[]", "{}"]))
                    text.append(held[-1][0])
                elif pick < 0.6 and held:
                    text.append(held.pop()[1])
                else:
                    text.append(rng.choice(["a", ";", "=", "\n", "\r\n", "b"]))
            texts.append(text + [x[1] for x in reversed(held)])
        s = streams(texts)
        at = 0
        for text in texts:
            held, line, first = [], 1, at
            for w in text:
                if w.isspace():
                    line += 1
                    continue
                assert s.word[at] == w and s.line[at] == line
                if w in ")]}":
                    opened = held.pop()
                    assert s.partner[at] == opened and s.partner[opened] == at and s.level[at] == s.level[opened]
                else:
                    assert s.level[at] == len(held) and s.scope(at) == (held[-1] if held else -1)
                    if w in "([{":
                        held.append(at)
                at += 1
            assert s.word[at] == "" and at >= first
            at += 1
        for i, w in enumerate(s.word):
            want = next((j for j in range(i, len(s.word)) if s.file[j] == s.file[i] and (
                (s.level[j] == s.level[i] and s.word[j] in ("{", ";", "=", "")) or (s.level[j] == s.level[i] - 1 and s.word[j] in ")]}" and s.word[j])
            )), -1)
            if w not in (")", "]", "}"):
                assert s.stop(i) == want, (trial, i, w)


def test_unbalanced_and_odd_texts_give_rows(spark):
    rng = random.Random(9)
    signs = ["(", ")", "{", "}", "[", "]", "<", ">", "f", "struct", "class", "fn", "impl", "func", "type", "#if X\n", "#else\n", "#endif\n", "\n", ";", ":", "::", "=", "*", "operator", "+", ",", " ", " ", " ", "int", "#", "for", "where", "__attribute__", "~", "'a"]
    texts = [(f"x{i}.{rng.choice(['c', 'cpp', 'go', 'rs'])}", "".join(rng.choice(signs) + rng.choice(["", " "]) for _ in range(rng.randrange(50)))) for i in range(1500)]
    texts += [("empty.c", ""), ("null.rs", None), ("one.go", "func"), ("deep.cpp", "{" * 30_000 + "}" * 30_000), ("open.c", "int f(int a) {\n" * 2000)]
    code = ex.code_lines(spark.createDataFrame(texts, "path STRING, content STRING"))
    rows = code.collect()
    lines = {p: len((t or "").splitlines()) for p, t in texts}
    assert all(1 <= r.line_no <= max(lines[r.path], 1) for r in rows)
    assert all(r.end_line is None or r.line_no <= r.end_line <= max(lines[r.path], 1) for r in rows)
    assert sum(r.path == "open.c" and r.kind == "function" for r in rows) == 2000


@pytest.mark.parametrize("suffix", ["c", "cpp"])
def test_depths_start_anew_in_each_file(suffix):
    texts = [["#if X\n", "{", "\n", "#else\n", "\n"], ["int", "f", "(", ")", "{", "}"], ["#endif", "\n", "{", "}"]]
    s = streams(texts, suffix)
    for f in (1, 2):
        assert s.level[np.flatnonzero(s.file == f)[0]] == 0
