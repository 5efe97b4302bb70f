"""Functions, imports and errors of source in six languages, by hand."""

import pytest

from difforge.functions import models, syntax

JS = """// function no() {}
import React, { useState } from 'react';
import "./side.css";
const a = (x) => x + 1;
const t = `a ${b.map(y => `n${y}`)} } function no() {`;
export default class Foo extends Bar(1) {
  static async get(x) { if (x) { return /[/{]'/.test(x); } }
  'quoted name'() {}
  [Symbol.iterator]() { return 1; }
}
function outer(a, b = {}) {
  const inner = async function () { return 1 / 2 / 3; };
  return [1].map(v => {
    return v;
  });
}
async function* gen() {}
"""
TS = """import { A } from "./a";
import type { B } from "./b";
interface Shape<T> { area(): number; scale(by: T): Shape<T>; name: string }
type Fn = (x: number) => void;
abstract class Hidden { abstract draw(): void; }
export class Circle implements Shape<number> {
  private readonly r: number = 1;
  constructor(private x: number) {}
  public area(): number {
    return this.r;
  }
  cb: (e: Event) => void;
}
function over(a: string): string;
function over(a: number): { b: number };
function over<T>(a: T): { b: T } {
  const f = (q: number): string => `${q}`;
  return { b: a };
}
"""
GO = '''package main
import "fmt"
import (
	"os"
	alias "path/filepath"
)
func Add(a, b int) int {
	return a + b
}
func (s *Server) Run(ctx context.Context) (int, error) {
	go func() { fmt.Println(`}`) }()
	x := func(y int) interface{} { return '{' }
	return 0, nil
}
type T struct { f func(int) string }
func Map[K comparable, V any](m map[K]V) []K {
	return nil
}
'''
RUST = """use std::{fmt, io::Read};
pub use crate::x::Y;
/* outer /* inner } */ fn no() {} */
pub(crate) async fn go<'a, T: Into<String>>(x: &'a str) -> Result<(), E> {
    let f = |a: u8| a + 1;
    let g = move || { '{' };
    let s = r#"} " fn no() {"#;
    xs.iter().map(|x| x)
}
trait Shape { fn area(&self) -> f64; }
impl<T> Shape for Circle<T> {
    fn area(&self) -> f64 { 1.0 }
}
"""
JAVA = '''package a.b;
import java.util.List;
import static java.lang.Math.*;
@Deprecated
public class Foo<T> extends Bar implements Baz {
    private int x = compute(1);
    public Foo(int x) throws IOException { this.x = x; }
    @Override
    public <R> List<R> get(Map<String, List<R>> m) {
        String s = """
            class No { void no() {} }
            """;
        if (x > 0) { run(); }
        return new ArrayList<R>() { public int size() { return 0; } };
    }
    abstract void later(int... xs);
    interface Inner { int f(); }
}
'''
PY = """import os
from a import (b,
    c)
class K:
    @deco
    def f(self):
        async def g(): pass
"""


def names(text, language):
    return [(n[0], n[1], n[2], n[3]) for n in models.file_syntax(text, language)[0]]


def test_javascript():
    assert names(JS, "javascript") == [
        ("arrow_function", "<arrow>", 3, 3), ("arrow_function", "<arrow>", 4, 4), ("class_declaration", "Foo", 5, 9), ("method_definition", "get", 6, 6), ("method_definition", "'quoted name'", 7, 7),
        ("method_definition", "[Symbol.iterator]", 8, 8), ("function_declaration", "outer", 10, 15), ("function_expression", "<anonymous>", 11, 11), ("arrow_function", "<arrow>", 12, 14),
    ]
    assert syntax.import_lines(JS, "javascript") == ["import React, { useState } from 'react';", 'import "./side.css";']
    assert syntax.errors(JS, "javascript") == []


def test_typescript():
    assert names(TS, "typescript") == [
        ("method_signature", "area", 2, 2), ("method_signature", "scale", 2, 2), ("method_signature", "draw", 4, 4), ("class_declaration", "Circle", 5, 12), ("method_definition", "constructor", 7, 7), ("method_definition", "area", 8, 10),
        ("function_signature", "over", 13, 13), ("function_signature", "over", 14, 14), ("function_declaration", "over", 15, 18), ("arrow_function", "<arrow>", 16, 16),
    ]
    assert [n for n in names(TS, "tsx") if n[0].endswith("signature")] == []
    assert len(syntax.import_lines(TS, "typescript")) == 2 and syntax.errors(TS, "typescript") == []


def test_go():
    assert names(GO, "go") == [
        ("function_declaration", "Add", 6, 8), ("method_declaration", "Run", 9, 13), ("func_literal", "<anonymous>", 10, 10), ("func_literal", "<anonymous>", 11, 11), ("function_declaration", "Map", 15, 17),
    ]
    assert syntax.import_lines(GO, "go") == ['import "fmt"', '"fmt"', 'import (\n\t"os"\n\talias "path/filepath"\n)', '"os"', 'alias "path/filepath"']
    assert syntax.errors(GO, "go") == []


def test_rust():
    assert names(RUST, "rust") == [
        ("function_item", "go", 3, 8), ("closure_expression", "<anonymous>", 4, 4), ("closure_expression", "<anonymous>", 5, 5), ("closure_expression", "x", 7, 7), ("impl_item", "<anonymous>", 10, 12), ("function_item", "area", 11, 11),
    ]
    assert syntax.import_lines(RUST, "rust") == ["use std::{fmt, io::Read};", "pub use crate::x::Y;"]
    assert syntax.errors(RUST, "rust") == []


def test_java():
    assert names(JAVA, "java") == [
        ("class_declaration", "Foo", 3, 17), ("constructor_declaration", "Foo", 6, 6), ("method_declaration", "get", 7, 14), ("method_declaration", "size", 13, 13), ("method_declaration", "later", 15, 15),
        ("interface_declaration", "Inner", 16, 16), ("method_declaration", "f", 16, 16),
    ]
    assert syntax.import_lines(JAVA, "java") == ["import java.util.List;", "import static java.lang.Math.*;"]
    assert syntax.errors(JAVA, "java") == []


def test_python():
    assert names(PY, "python") == [("class_definition", "K", 3, 6), ("function_definition", "f", 5, 6), ("function_definition", "g", 6, 6)]
    assert models.file_syntax(PY, "python")[1] == ["import os", "from a import (b,\n    c)"]


@pytest.mark.parametrize("language", syntax.LANGUAGES)
def test_marks(language):
    assert syntax.errors("f(a, [b)]\n{", language) == [("( without partner", 0), (") without partner", 0), ("{ without partner", 1)]
    assert syntax.errors('x = "open\ny = 1', language)[:1] == [("text without end", 0)]
    assert ("comment without end", 1) in syntax.errors("x\n/* open", language)
    for text in ("", "\x00", "{" * 200_000, "}" * 1000, "func", "class", "impl", "=>", "|", "function", "'", "`${", "new", "import", "@", "fn x", "x(" * 5000, "<" * 3000):
        syntax.nodes(text, language), syntax.import_lines(text, language), syntax.errors(text, language)


@pytest.mark.parametrize("deep", ["(" * 100_000, "[" * 9000 + "]" * 9000, "-" * 100_000 + "1", "x\x00y", "a." * 20_000 + "b", "lambda:" * 5000 + "0"])
def test_suggestions_that_the_parser_gives_up_on(deep):
    valid, error, fixed = models.check_suggestion(deep, "python")
    assert (valid, fixed) in {(False, None), (True, None)} and (valid or error == "Syntax errors detected in python suggestion")
    assert models.python_nodes(deep)[:2] == ([], [])


def test_suggestions_in_brace_languages():
    assert models.check_suggestion("if (x) { y(); }", "java") == (True, None, None)
    assert models.check_suggestion("if (x) { y();", "go") == (False, "Syntax errors detected in go suggestion", None)
    assert models.check_suggestion("if (x) { y();", "cobol") == (True, None, None)


def test_files(spark):
    files = spark.createDataFrame([("a.js", JS), ("b.go", GO), ("c.rs", RUST), ("D.java", JAVA), ("e.ts", TS), ("f.py", PY), ("g.txt", "def f(): pass"), ("h.js", "f("), ("i.py", None), ("j.py", "(" * 100_000)], "file_path string, content string")
    got = models.syntax_nodes(files).groupBy("file_path").count().collect()
    assert {r.file_path: r["count"] for r in got} == {"a.js": 9, "b.go": 5, "c.rs": 6, "D.java": 7, "e.ts": 10, "f.py": 3, "i.py": 1}
    assert {(r.file_path, r.what) for r in models.syntax_errors(files).collect()} >= {("h.js", "( without partner")}
    assert {r.file_path for r in models.syntax_errors(files).collect()} == {"h.js", "j.py"}
    assert models.imports(files).where("file_path = 'f.py'").count() == 2
