import pytest

from bundlewright.operators import chunking


def files(spark, *pairs):
    return spark.createDataFrame(pairs, "file string, content string")


@pytest.mark.parametrize("lines,overlap", [(20, 5), (8, 2), (1, 0), (3, 3), (5, 9), (100, 10), (200, 0)])
def test_windows_are_those_of_the_loop(spark, lines, overlap):
    for n in (1, 7, 8, 9, 100):
        text = "\n".join(f"line {i}" for i in range(n)) + "\n"
        want, i, rows = [], 0, text.split("\n")[:-1]
        while True:
            end = min(i + lines, n)
            want.append((i + 1, end, "\n".join(rows[i:end])))
            if end >= n:
                break
            i += max(1, lines - overlap)
        got = chunking.line_windows(files(spark, ("f", text)), lines, overlap).orderBy("start_line").collect()
        assert [(r.start_line, r.end_line, r.text) for r in got] == want


def test_nothing_to_cut(spark):
    assert chunking.line_windows(files(spark, ("a", ""), ("b", None))).count() == 0
    with pytest.raises(ValueError):
        chunking.line_windows(files(spark, ("a", "x")), 0)


SOURCES = {
    "a.py": ("import os\n\n@deco(\n    1)\ndef f():\n    return '}'\n\nclass C:\n    def m(self):\n        pass\n\nasync def g(): pass\nx = 1\n", [(3, 6), (8, 10), (12, 12)]),
    "broken.py": ("def f(:\n  pass\n", []),
    "a.rs": ('use x;\n// fn no() {\nstruct A {\n    b: u8,\n}\n\nimpl A {\n    fn m(&self) -> &str {\n        "}{"\n    }\n}\nconst N: usize = 3;\npub fn f(\n    a: u8,\n) -> u8 {\n    a\n}\n', [(3, 5), (7, 11), (12, 12), (13, 17)]),
    "a.js": ("import x from 'y';\nfunction f() {\n  return `}`;\n}\nclass K {\n  m() {}\n}\nconst z = () => {\n  1;\n};\nf();\n", [(2, 4), (5, 7), (8, 10)]),
    "a.ts": ("export interface I {\n  a: string;\n}\ntype T = 'x' | 'y';\nenum E { A, B }\nabstract class Q {\n}\n", [(1, 3), (4, 4), (5, 5), (6, 7)]),
    "a.go": ("package main\n\ntype T struct {\n\tA int\n}\n\nfunc (t T) M() int {\n\treturn 1\n}\n\nconst C = 1\nvar V = 2\n", [(3, 5), (7, 9), (11, 11), (12, 12)]),
    "a.c": ("int x;\nstruct s {\n  int a;\n};\nint main(void)\n{\n  return 0; /* } */\n}\n", [(1, 1), (2, 4), (5, 8)]),
    "a.dart": ("import 'x.dart';\nclass A {\n  int b = 1;\n}\nenum E { a, b }\nint f(int x) {\n  return x;\n}\n", [(2, 4), (5, 5), (6, 8)]),
    "none.rs": ("// only a comment\n// more\n", []),
    "a.txt": ("def f(): pass\n", []),
}


@pytest.mark.parametrize("name", SOURCES)
def test_units(name):
    from bundlewright.functions.paths import LANGUAGES

    text, want = SOURCES[name]
    assert chunking.unit_spans(text, LANGUAGES.get(name.rsplit(".")[-1])) == want


def test_units_or_lines(spark):
    df = files(spark, *((n, t) for n, (t, _) in SOURCES.items()))
    got = {}
    for r in chunking.chunks(df).collect():
        got.setdefault(r.file, []).append((r.start_line, r.end_line))
    for name, (text, want) in SOURCES.items():
        assert sorted(got[name]) == (want or [(1, len(text.split("\n")) - 1)])
    again = chunking.chunks(df)
    assert {r.chunk_id for r in again.collect()} == {r.chunk_id for r in chunking.chunks(df).collect()} and again.count() == again.select("chunk_id").distinct().count()


def test_units_on_one_line_have_their_own_ids(spark):
    got = chunking.syntax_units(files(spark, ("x.py", "def a(): pass\ndef b(): pass\n"))).collect()
    assert len({r.chunk_id for r in got}) == 2
