import os

import pytest

from tessera.sources.scanner import scan


def names(source, language):
    symbols, calls = scan(source.encode(), language)
    own = {s.local_id: s.name for s in symbols}
    return [(s.name, s.kind, s.start_line, s.end_line, own.get(s.parent)) for s in symbols], [(own.get(c.caller), c.callee) for c in calls]


def test_rust():
    symbols, calls = names(
        "struct P { x: i32 }\nimpl<T> From<T> for P {\n    fn from(t: T) -> P { make(t) }\n}\ntrait D { fn a(&self); fn b(&self) { self.a() } }\nconst N: usize = 3;\n"
        "// fn hidden() {}\nfn main() { let s = \"fn no() {\"; add(1, 2); m::run(); println!(\"x\"); }\n",
        "rust",
    )
    assert symbols == [("P", "Struct", 1, 1, None), ("P", "Impl", 2, 4, None), ("from", "Function", 3, 3, "P"), ("D", "Trait", 5, 5, None), ("b", "Function", 5, 5, "D"), ("N", "Constant", 6, 6, None), ("main", "Function", 8, 8, None)]
    assert calls == [("from", "make"), ("b", "self.a"), ("main", "add"), ("main", "m::run")]


def test_python_offsets_are_bytes():
    source = "# é\nclass A:\n    def f(self):\n        return g(1)\n"
    symbols, calls = scan(source.encode(), "python")
    assert [(s.name, s.kind, s.parent) for s in symbols] == [("A", "Class", None), ("f", "Function", 0)]
    assert source.encode()[symbols[1].start : symbols[1].end].decode().startswith("def f")
    assert [(c.caller, c.callee) for c in calls] == [(1, "g")]


def test_python_that_its_parser_rejects():
    symbols, calls = names("def good():\n    return first('def no(')\n\nclass A:\n    def old(self):\n        print self.x, good()\n\n    def bad(:\n        pass  # call()\n\ndef last():\n    return good()\n", "python")
    assert symbols == [("good", "Function", 1, 2, None), ("A", "Class", 4, 9, None), ("old", "Function", 5, 6, "A"), ("bad", "Function", 8, 9, "A"), ("last", "Function", 11, 12, None)]
    assert calls == [("good", "first"), ("old", "good"), ("last", "good")]


def test_javascript_and_typescript():
    symbols, calls = names("class A {\n  run(x) { this.stop(x); }\n}\nasync function main() { const a = new A(); helper(`x ${1}`); }\n", "javascript")
    assert symbols == [("A", "Class", 1, 3, None), ("run", "Method", 2, 2, "A"), ("main", "Function", 4, 4, None)]
    assert calls == [("run", "this.stop"), ("main", "helper")]
    symbols, _ = names("interface P { x: number }\ntype Q = string;\n", "typescript")
    assert [s[:2] for s in symbols] == [("P", "Interface"), ("Q", "Type")]


def test_go():
    symbols, calls = names("type P struct { X int }\ntype R interface { Read() }\ntype ID int\nfunc (p *P) Dist() int { return calc(p.X) }\nfunc calc(x int) int { return x }\n", "go")
    assert [s[:2] for s in symbols] == [("P", "Struct"), ("R", "Interface"), ("ID", "Type"), ("Dist", "Method"), ("calc", "Function")]
    assert ("Dist", "calc") in calls


def test_java():
    symbols, calls = names("public class Foo {\n  private static final int X = 1;\n  int go(int a) { return help.run(a); }\n}\ninterface Z { int go(int x); }\n", "java")
    assert symbols == [("Foo", "Class", 1, 4, None), ("X", "Field", 2, 2, "Foo"), ("go", "Method", 3, 3, "Foo"), ("Z", "Interface", 5, 5, None), ("go", "Method", 5, 5, "Z")]
    assert calls == [("go", "help.run")]


def test_c_and_cpp():
    symbols, calls = names("struct S { int a; };\nint add(int a, int b) { return a + b; }\nint decl(int);\nint main(void) { struct S s; return add(1, 2); }\n", "c")
    assert [s[:2] for s in symbols] == [("S", "Struct"), ("add", "Function"), ("main", "Function")]
    assert ("main", "add") in calls
    symbols, _ = names("class K : public P { void run(); };\nenum class E { A };\nvoid K::run() { go(); }\n", "cpp")
    assert [s[:2] for s in symbols] == [("K", "Class"), ("E", "Enum"), ("run", "Function")]


@pytest.mark.parametrize("language", ["rust", "go", "java", "c", "cpp", "javascript", "typescript", "python", "html"])
def test_never_raises(language):
    for i in range(60):
        scan(os.urandom(80).decode("latin-1").encode(), language)
        scan(b"fn f( { class A { ( \"" * i, language)
    assert scan(b"\xff\xfe fn a() {}", language) == ([], [])
