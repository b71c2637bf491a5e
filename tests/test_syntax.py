"""Sources that a line-by-line reader gets wrong, with the declarations they hold: name, kind, parent, first and last line."""

from __future__ import annotations

import pytest

GO = '''package x

import (
	"fmt"
	alias "a/b"
)

/* func Commented() { */
// func AlsoNot() {

// Pair holds two.
// Both of a kind.
type Pair[K comparable, V any] struct {
	*Base
	sync.Mutex
	Key   K `json:"key{"`
	a, b  int
}

type (
	ID  int
	Op  func(a int) (int, error)
	Any interface {
		Do(x int) string
	}
)

// New makes one.
func New[K comparable, V any](
	key K,
	opts ...func(*Pair[K, V]),
) (*Pair[K, V], error) {
	s := `raw } {
func NotHere() {
`
	r := '}'
	q := "\\"}" + "{"
	defer func() { fmt.Println(s, r, q) }()
	return make[K](key), nil
}

func (p *Pair[K, V]) Get(k K) interface{} { if k == '{' { return p.m.load(k) }; return nil }

func (Pair[K, V]) value() struct{ X int } {
	return struct{ X int }{1}
}

func extern(a int) int
func last() {}
'''
TS = '''import { a } from "./a"
import type { B } from './b'
const c = require("c")

// function commented() {}
/** Runs it. */
export default class Job<T extends object = {}> extends base.Core<T> implements Runs, x.Stops<T> {
  private n: number = 1
  static #count = 0
  handler = async (e: Event): Promise<void> => {
    this.emit(`done ${e.map((x) => `${x}}`)} }`)
  }
  type: { a: string } = { a: "}" }
  constructor(private readonly x: number) { super(); init(x) }
  @Input({ a: 1 })
  get value(): { a: number } { return { a: 1 } }
  async *items<K>(k: K): AsyncGenerator<K> {
    const re = /[}/"]{2}\\/`/g, half = k / 2 / 3
    yield* all(re.test("x"), half)
  }
  abstract later(): void
  static { boot() }
}

export const add = (a: number, b: number): number => a +
  b

const typed: (x: number) => void = (x) => { log(x) }
let plain = 5, other = { run() { return 1 } }
export async function load<T>(
  url: string,
): Promise<{ data: T }> {
  function inner() { return url }
  return fetch(url).then((r) => r.json())
}
const View = ({ name }: Props) => {
  const click = () => go(name)
  return <div className="a{" onClick={() => send({ name })}>Don't {name ? <b>it's</b> : <></>} }</div>
}
var f = function named() { return 1 }
'''
JAVA = '''package a;
import java.util.List;

/** A box. */
@Ann(value = "}")
public final class Box<T extends Comparable<T>> extends Base<T> implements One, Two<T> {
  // void no() {
  private static final String S = "}{\\"";
  static { init('}'); }
  Box(int n) { super(n); }
  @Override
  public <R> List<R> map(Function<T, R> f) throws IOException {
    Runnable r = new Runnable() { public void run() { go(); } };
    return new ArrayList<>(f.apply(null));
  }
  abstract int size();
  enum Kind { A, B; int code() { return 1; } }
}
interface Shape { double area(); default int two() { return 2; } }
'''
RUST = '''use std::io;

/* outer /* nested } */ still */
#[derive(Debug)]
pub struct P<'a> { x: &'a str }
struct Unit;
pub trait Area { fn area(&self) -> f64; fn twice(&self) -> f64 { self.area() * 2.0 } }
impl<'a> Area for P<'a> {
    fn area(&self) -> f64 { let c = '}'; let r = r#"}"{"#; f(c, r) }
}
pub async fn run<T: Into<String>>(t: T) -> Result<(), io::Error>
where
    T: Clone,
{
    t.into();
    Ok(())
}
enum E { A { x: i32 }, B }
'''
CPP = '''#include <map>
namespace n {
// Not: void no() {
template <typename T>
class Tree : public Base {
 public:
  Tree(int a) : a_(a), b_{1} { build("}"); }
  ~Tree() {}
  int size() const noexcept { return a_; }
  virtual void later() = 0;
 private:
  int a_, b_;
};
int Tree::find(const std::string& s) {
  auto f = [&](int x) { return x; };
  return f(R"x(})x" ")"[0]);
}
}
static int main(int argc, char** argv) {
  if (argc > 1) { return run(argv); }
  return 0;
}
int declared(int x);
'''
RUBY = '''# def no
module Shop
  class Cart < Base
    attr_reader :x

    # Adds.
    def add(item, n = 1)
      return if n < 1
      items.each do |i|
        puts "end #{i}" unless i.nil?
      end
      while n > 0 do
        n -= 1
      end
      x = if n then 1 else 2 end
    end

    def self.build; new; end
=begin
def hidden
=end
    def empty?
      true
    end
  end
end

def top(a)
  case a
  when 1 then :end
  end
end
'''
KOTLIN = '''package a
data class P(val x: Int, val y: Int) : Base(x), Other {
    fun sum() = x + y
    override fun toString(): String { return "${x}}" }
}
object Single { fun one(): Int = 1 }
fun <T> T.also(block: (T) -> Unit): T {
    block(this)
    return this
}
'''
PHP = '''<?php
# function no() {
class Cart extends Base implements One {
    private function secret($a) { return "}"; }
    public static function make(array $x = ['}']): ?self { return new self($x); }
}
function top() { return 1; }
'''
EXPECTED = {
    "a.go": (GO, [("Pair", "struct", "", 13, 18), ("ID", "struct", "", 21, 21), ("Op", "struct", "", 22, 22), ("Any", "struct", "", 23, 25), ("New", "function", "", 29, 40), ("Get", "method", "Pair", 42, 42), ("value", "method", "Pair", 44, 46), ("extern", "function", "", 48, 48), ("last", "function", "", 49, 49)]),
    "a.tsx": (TS, [("Job", "class", "", 7, 23), ("handler", "method", "Job", 10, 12), ("constructor", "method", "Job", 14, 14), ("value", "method", "Job", 16, 16), ("items", "method", "Job", 17, 20), ("add", "function", "", 25, 26), ("typed", "function", "", 28, 28), ("load", "function", "", 30, 35), ("inner", "function", "", 33, 33), ("View", "function", "", 36, 39), ("click", "function", "", 37, 37), ("f", "function", "", 40, 40)]),
    "a.java": (JAVA, [("Box", "class", "", 6, 18), ("Box", "method", "Box", 10, 10), ("map", "method", "Box", 12, 15), ("Kind", "class", "", 17, 17), ("code", "method", "Kind", 17, 17), ("Shape", "class", "", 19, 19), ("two", "method", "Shape", 19, 19)]),
    "a.rs": (RUST, [("P", "struct", "", 5, 5), ("Unit", "struct", "", 6, 6), ("Area", "class", "", 7, 7), ("area", "method", "Area", 7, 7), ("twice", "method", "Area", 7, 7), ("area", "method", "P", 9, 9), ("run", "function", "", 11, 17), ("E", "class", "", 18, 18)]),
    "a.cpp": (CPP, [("Tree", "class", "", 4, 13), ("Tree", "method", "Tree", 7, 7), ("Tree", "method", "Tree", 8, 8), ("size", "method", "Tree", 9, 9), ("find", "method", "Tree", 14, 17), ("main", "function", "", 19, 22)]),
    "a.rb": (RUBY, [("Shop", "class", "", 2, 26), ("Cart", "class", "", 3, 25), ("add", "method", "Cart", 7, 16), ("build", "method", "Cart", 18, 18), ("empty?", "method", "Cart", 22, 24), ("top", "function", "", 28, 32)]),
    "a.kt": (KOTLIN, [("P", "class", "", 2, 5), ("sum", "method", "P", 3, 3), ("toString", "method", "P", 4, 4), ("Single", "class", "", 6, 6), ("one", "method", "Single", 6, 6), ("also", "function", "", 7, 10)]),
    "a.php": (PHP, [("Cart", "class", "", 3, 6), ("secret", "method", "Cart", 4, 4), ("make", "method", "Cart", 5, 5), ("top", "function", "", 7, 7)]),
}


@pytest.mark.parametrize("path", EXPECTED)
def test_declarations(path):
    from lodespark.sources.files import parse

    code, want = EXPECTED[path]
    assert [(r["name"], r["kind"], r["parent_class"], r["start_line"], r["end_line"]) for r in parse(path, code)] == want


def rows(path):
    from lodespark.sources.files import parse

    return {(r["parent_class"], r["name"]): r for r in parse(path, EXPECTED[path][0])}


def test_go_says():
    r = rows("a.go")
    assert r["", "Pair"]["extends"] == "Base" and r["", "Pair"]["docstring"] == "// Pair holds two.\n// Both of a kind." and r["", "Pair"]["imports"] == ["fmt", "a/b"]
    assert r["", "New"]["signature"].startswith("func New[K comparable, V any](") and r["", "New"]["signature"].endswith("(*Pair[K, V], error)")
    assert [(c["qualifier"], c["name"], c["line"]) for c in r["", "New"]["calls"]] == [("fmt", "Println", 38)]
    assert [(c["qualifier"], c["name"]) for c in r["Pair", "Get"]["calls"]] == [("p.m", "load")] and r["Pair", "Get"]["is_exported"] and not r["Pair", "value"]["is_exported"]


def test_typescript_says():
    r = rows("a.tsx")
    job = r["", "Job"]
    assert (job["extends"], job["implements"], job["docstring"], job["is_exported"], job["imports"]) == ("base.Core", ["Runs", "x.Stops"], "/** Runs it. */", True, ["./a", "./b", "c"])
    assert [c["name"] for c in r["Job", "handler"]["calls"]] == ["emit", "map"] and [c["name"] for c in r["Job", "items"]["calls"]] == ["all", "test"]
    assert [c["name"] for c in r["", "View"]["calls"]] == ["go", "send"] and [c["name"] for c in r["", "load"]["calls"]] == ["fetch", "then", "json"]
    assert r["", "add"]["content"] == "export const add = (a: number, b: number): number => a +\n  b" and not r["", "typed"]["is_exported"]


def test_others_say():
    box, tree = rows("a.java")["", "Box"], rows("a.cpp")["", "Tree"]
    assert (box["extends"], box["implements"]) == ("Base", ["One", "Two"]) and tree["extends"] == "Base"
    assert rows("a.rb")["", "Cart"]["extends"] == "Base" and rows("a.rb")["Cart", "add"]["docstring"] == "# Adds."
    assert rows("a.php")["Cart", "make"]["is_exported"] and not rows("a.php")["Cart", "secret"]["is_exported"]
    assert rows("a.kt")["", "P"]["extends"] == "Base"


@pytest.mark.parametrize("path", EXPECTED)
def test_broken_sources_give_rows(path):
    """Any prefix of a source, and one with its brackets turned round, is read without an error and within the file."""
    from lodespark.sources.files import parse

    code = EXPECTED[path][0]
    for text in [code[:k] for k in range(0, len(code), 7)] + [code.translate(str.maketrans("{}()", "}{)("))]:
        for r in parse(path, text):
            assert 1 <= r["start_line"] <= r["end_line"] <= text.count("\n") + 1


def test_reading_is_linear():
    from time import monotonic

    from lodespark.sources.files import parse

    began = monotonic()
    assert len(parse("a.go", "package x\n" + "func f() { g(\"}\") }\n" * 10_000)) == 10_000
    assert parse("a.ts", "{" * 50_000 + "`${" * 300)[0]["kind"] == "file"
    assert len(parse("a.java", "class A {" + " int f(int x) { return g(x); }\n" * 5_000 + "}")) == 5_001
    assert monotonic() - began < 30
