from stratacode.parse.brace_source import parse_braces
from stratacode.parse.python_source import parse_python

PY = '''import os
from typing import Optional, List

def add(a, b: int) -> int:
    """Adds."""
    return a + b

async def fetch(uid) -> Optional[dict]:
    r = await client(uid).get(url)
    return r.json()

def outer(x):
    def inner(y: "T") -> list[int]:
        return [y]
    return inner(x)

class Animal(base.Thing):
    """An animal."""
    def __init__(self, name):
        self.name = name
    @classmethod
    def create(cls, n):
        return cls(n)

class Dog(Animal, Pet):
    def speak(self):
        super().speak()

main()
'''


def names(items):
    return [x["name"] for x in items]


def test_python_facts():
    r = parse_python(PY)
    assert names(r["functions"]) == ["add", "fetch", "outer", "inner"]
    add = r["functions"][0]
    assert (add["signature"], add["start_line"], add["end_line"], add["docstring"], add["return_type"], add["param_types"]) == ("add(a, b)", 4, 6, "Adds.", "int", {"b": "int"})
    assert r["functions"][3]["param_types"] == {"y": "T"} and r["functions"][3]["return_type"] == "list[int]"
    assert [(c["name"], names(c["methods"])) for c in r["classes"]] == [("Animal", ["__init__", "create"]), ("Dog", ["speak"])]
    assert [(e["class"], e["parent"]) for e in r["extends"]] == [("Animal", "Thing"), ("Dog", "Animal"), ("Dog", "Pet")]
    assert [i["target"] for i in r["imports"]] == ["os", "typing.Optional", "typing.List"]
    got = {(c["source"], c["target"]) for c in r["calls"]}
    assert {("fetch", "client"), ("fetch", "get"), ("fetch", "json"), ("outer", "inner"), ("create", "cls"), ("speak", "super"), ("speak", "speak"), ("<module>", "main")} == got


def test_python_that_is_none():
    assert parse_python("def (") == {"functions": [], "classes": [], "calls": [], "imports": [], "extends": []}
    assert parse_python("# only a comment\n")["functions"] == []


def test_javascript():
    src = """import x from 'a/b';
const y = require("c");
// says hello
function hello(name) { return name; }
export default async function fetchData(url, opts = {}) {
  return await get(url, "not(a) call");
}
const foo = () => {
  return bar(42); /* not(this) */
};
const one = z => z + 1;
class Box extends Base {
  constructor(w) { super(w); this.w = w; }
  static make(w) { return new Box(w); }
  async load() { await read(this.w); }
  handler = (e) => { emit(e); }
  get size() { return this.w; }
}
if (x) { run(); }
"""
    r = parse_braces(src, "javascript")
    assert names(r["functions"]) == ["hello", "fetchData", "foo", "one"]
    by = {f["name"]: f for f in r["functions"]}
    assert (by["hello"]["signature"], by["hello"]["start_line"], by["hello"]["end_line"], by["hello"]["docstring"]) == ("hello(name)", 4, 4, "says hello")
    assert by["fetchData"]["signature"].startswith("async fetchData(url") and (by["foo"]["start_line"], by["foo"]["end_line"]) == (8, 10)
    (box,) = r["classes"]
    assert (box["name"], box["start_line"], box["end_line"], names(box["methods"])) == ("Box", 12, 18, ["constructor", "make", "load", "handler", "size"])
    assert [i["target"] for i in r["imports"]] == ["a/b", "c"]
    calls = {(c["source"], c["target"]) for c in r["calls"]}
    assert {("fetchData", "get"), ("foo", "bar"), ("load", "read"), ("handler", "emit"), ("<module>", "run")} <= calls and not {t for _, t in calls} & {"not", "if", "hello"}
    assert [(e["class"], e["parent"], e["rel_type"]) for e in r["extends"]] == [("Box", "Base", "EXTENDS")]


def test_typescript():
    src = """import type { A } from './types';
export interface Shape extends Thing, Named { area(): number; }
export abstract class Circle implements Shape, Other {
  private readonly r: number;
  public get radius(): number { return this.r; }
  protected async scale<T>(by: T, n?: number): Promise<Circle> { return grow(by); }
}
export const pick = <T>(items: T[], n: number): T => items[n];
function typed(a: string, b: Map<string, number>): boolean { return a === ""; }
"""
    r = parse_braces(src, "typescript")
    assert names(r["functions"]) == ["pick", "typed"] and r["functions"][1]["return_type"] == "boolean"
    assert r["functions"][1]["param_types"] == {"a": "string", "b": "Map<string, number>"}
    assert {c["name"]: names(c["methods"]) for c in r["classes"]}["Circle"] == ["radius", "scale"]
    assert {(e["class"], e["parent"], e["rel_type"]) for e in r["extends"]} == {("Shape", "Thing", "EXTENDS"), ("Shape", "Named", "EXTENDS"), ("Circle", "Shape", "IMPLEMENTS"), ("Circle", "Other", "IMPLEMENTS")}


def test_go():
    src = """package p
import "fmt"
import (
    "os"
    log "x/log"
)
// Adds two.
func Add(a int, b int) int { return a + b }
func (s *Stack[T]) Push(v T) { s.items = append(s.items, v) }
func Map[T any](xs []T, f func(T) T) ([]T, error) {
    return walk(xs), nil
}
type Stack[T any] struct { items []T }
"""
    r = parse_braces(src, "go")
    assert names(r["functions"]) == ["Add", "Push", "Map"] and [f["return_type"] for f in r["functions"]] == ["int", None, "([]T, error)"]
    assert r["functions"][0]["docstring"] == "Adds two." and names(r["classes"]) == ["Stack"]
    assert [i["target"] for i in r["imports"]] == ["fmt", "os", "x/log"] and r["extends"] == []


def test_java():
    src = """import java.util.List;
import static a.B.c;
public class Shop extends Base implements Open, Closed {
    private final int n;
    public Shop(int n) { this.n = n; }
    public static <T> Map<String, List<T>> group(List<T> in) throws IOException, Bad { return go(in); }
    private final void run() { if (n > 0) { step(n); } }
    abstract int size();
}
"""
    r = parse_braces(src, "java")
    (shop,) = r["classes"]
    assert names(shop["methods"]) == ["Shop", "group", "run", "size"] and shop["methods"][1]["return_type"] == "Map<String, List<T>>" and r["functions"] == []
    assert [i["target"] for i in r["imports"]] == ["java.util.List", "a.B.c"] and [e["rel_type"] for e in r["extends"]] == ["EXTENDS", "IMPLEMENTS", "IMPLEMENTS"]
    assert {(c["source"], c["target"]) for c in r["calls"]} == {("group", "go"), ("run", "step")}


def test_rust():
    src = """use std::fmt;
pub struct Point { x: i32 }
impl Point {
    pub fn new(x: i32) -> Self { Point { x } }
    pub(crate) const unsafe fn raw<'a>(p: &'a str) -> Option<&'a str> { Some(p) }
}
impl fmt::Display for Point { fn fmt(&self) -> R { write(self) } }
pub trait Draw: Shape + Named { fn draw(&self); }
pub async fn go<T: Into<String>>(t: T) -> Result<(), E> where T: Send { run(t).await }
extern "C" fn c_fn(n: i32) {}
"""
    r = parse_braces(src, "rust")
    assert names(r["functions"]) == ["go", "c_fn"] and r["functions"][0]["return_type"] == "Result<(), E>"
    assert {c["name"]: names(c["methods"]) for c in r["classes"]} == {"Point": ["new", "raw", "fmt"], "Draw": ["draw"]}
    assert {(e["class"], e["parent"]) for e in r["extends"]} == {("Point", "Display"), ("Draw", "Shape"), ("Draw", "Named")}


def test_nothing_to_find():
    for text in ("", "  \n", "// only\n/* comments */"):
        assert parse_braces(text, "javascript")["functions"] == []
    assert parse_braces("function f() {}", "cobol")["functions"] == []
