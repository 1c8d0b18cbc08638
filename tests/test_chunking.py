import time

import pytest
from pyspark.sql import functions as F

from textquarry.functions import scan, text
from textquarry.operators import chunking, filters
from textquarry.settings import IndexLimits

PYTHON = '''# header comment
import os

# --- divider ---

@deco
def alpha(x):
    """doc"""
    return x


# about B
class B:
    y = 1

    def m(self):
        return 2

    # trailing method comment
    def n(self):
        return "ü"


# the end
'''
SCRIPT = '''import a from "b";

const Page = () => {
  return 1;
};

// helper
export function helper(a) {
  return a;
}
'''
LIMITS = [IndexLimits(), IndexLimits(max_chunk_chars=120), IndexLimits(max_chunk_chars=60, max_chunk_lines=5), IndexLimits(max_chunk_lines=1)]


def files(spark):
    rows = [("r", "a.py", PYTHON), ("r", "p.js", SCRIPT), ("r", "t.txt", "l1\nl2 ü\nl3\n\n\nl6"), ("r", "e.txt", "\n\n")]
    frame = spark.createDataFrame(rows, "repository_id string, path string, content string")
    return chunking.spans_by_pattern(filters.detect_language(frame))


@pytest.mark.parametrize("limits", LIMITS)
def test_chunks_are_exact_and_complete(spark, limits):
    source = files(spark)
    chunks = chunking.chunk_files(source, limits)
    for row in chunking.chunk_integrity(chunks, source).collect():
        assert (row.overlaps, row.wrong_content, row.wrong_lines, row.uncovered) == (0, 0, 0, 0)
    whole = chunks.where("symbol is not null and part_count = 1").select(F.max(F.length("content"))).first()[0]
    assert whole is None or whole <= limits.max_chunk_chars or limits.max_chunk_chars < 100


def test_trivia_joins_declarations(spark):
    chunks = chunking.chunk_files(files(spark), IndexLimits()).orderBy("path", "start_byte").collect()
    got = [(c.path, c.chunk_type, c.symbol, c.start_line, c.end_line) for c in chunks]
    assert got == [
        ("a.py", "module", None, 1, 3),
        ("a.py", "function", "alpha", 4, 9),
        ("a.py", "class", "B", 12, 24),
        ("p.js", "module", None, 1, 2),
        ("p.js", "function", "Page", 3, 5),
        ("p.js", "function", "helper", 7, 10),
        ("t.txt", "block", None, 1, 6),
    ]
    page = next(c for c in chunks if c.symbol == "Page")
    assert page.content.endswith("};\n")


def test_methods_of_a_large_class(spark):
    chunks = chunking.chunk_files(files(spark), IndexLimits(max_chunk_chars=60)).where("path = 'a.py'").collect()
    methods = {c.symbol: c.parent_symbol for c in chunks if c.chunk_type == "method"}
    assert methods == {"m": "B", "n": "B"}


def test_partial_overlap_counts_as_containment(spark):
    span = chunking.SPAN
    rows = spark.createDataFrame(
        [([(0, 10, "f", "f", "a", None), (5, 20, "f", "f", "b", None), (12, 15, "f", "f", "c", None), (30, 40, "f", "f", "d", None)],)],
        f"spans array<{span}>",
    )
    chains = rows.select(chunking.ancestor_chains(F.col("spans")).alias("c")).first().c
    assert chains == [[], [0], [0, 1], []]


@pytest.mark.parametrize(
    ("content", "language", "trivia"),
    [
        ("# only\n", "python", True), ("# a\nx = 1\n", "python", False), ("};\n", "javascript", True),
        ("// a\n * b\n", "tsx", True), ("# heading", "markdown", False), ("***\n", "text", True), ("", "python", True),
    ],
)
def test_trivia(spark, content, language, trivia):
    row = spark.createDataFrame([(content, language)], "c string, l string").select(text.is_trivia(F.col("c"), F.col("l")).alias("t")).first()
    assert row.t == trivia


def test_window_closes_after_the_line_that_reaches_the_limit(spark):
    rows = spark.createDataFrame([("r", "a.txt", "text", "üü\nbb\ncc\nd")], "repository_id string, path string, language string, content string")
    chunks = chunking.chunk_by_lines(rows, IndexLimits(max_chunk_chars=5, max_chunk_lines=10)).orderBy("start_byte").collect()
    assert [c.content for c in chunks] == ["üü\n", "bb\ncc\n", "d"]
    assert [(c.start_byte, c.end_byte) for c in chunks] == [(0, 5), (5, 11), (11, 12)]


FORMS = [
    (
        "a.py",
        "@deco(\n    1,\n)\ndef f(\n    a,\n    b=(1, 2),\n) -> int:\n    x = \"\"\"\nnot indented\ndef no(): pass\n\"\"\"\n    return [\n1,\n]\n\nX = 1\n",
        [("f", "function", "function_definition", None, "@deco", "]")],
    ),
    (
        "b.ts",
        "export abstract class A {\n  private x = 1;\n  async run(\n    a: number,\n  ) {\n    if (a) {\n      go();\n    }\n  }\n  get y() {\n    return 1;\n  }\n}\n"
        "export interface I {\n  a: string;\n}\nenum E {\n  P,\n}\ntype T = {\n  z: number;\n};\nfunction g(\n  a,\n) {\n  return a;\n}\nconst h = (\n  a,\n) => {\n  return a;\n};\n",
        [
            ("A", "class", "abstract_class_declaration", None, "export abstract", "}"),
            ("run", "method", "method_definition", "A", "async run", "}"),
            ("y", "method", "method_definition", "A", "get y", "}"),
            ("I", "class", "interface_declaration", None, "export interface", "}"),
            ("E", "class", "enum_declaration", None, "enum E", "}"),
            ("T", "function", "type_alias_declaration", None, "type T", "}"),
            ("g", "function", "function_declaration", None, "function g", "}"),
            ("h", "function", "arrow_function", None, "const h", "}"),
        ],
    ),
]


@pytest.mark.parametrize("path,content,expected", FORMS)
def test_forms_of_declarations(spark, path, content, expected):
    rows = spark.createDataFrame([("r", path, content)], "repository_id string, path string, content string")
    spans = chunking.spans_by_pattern(filters.detect_language(rows)).first().spans
    raw = content.encode()
    got = [(s.name, s.kind, s.node_type, s.parent) for s in spans]
    assert got == [e[:4] for e in expected]
    for s, (name, *_, begins, ends) in zip(spans, expected):
        part = raw[s.start : s.end].decode()
        assert part.lstrip().startswith(begins) and part.endswith(ends) and name in part, part


SCANNED = [
    (
        "a.jsx",
        "const a = () => 1, b = () => 2;\nconst c = x => x + 1\nlet t = `function no() { ${ m(i => { function real() { return `}`; } return real }) } }`\n"
        "/* function no() {} */\n// class no {}\n"
        "function outer({p, q} = {}, d = \"}\") {\n  const re = /[}\"']+/g;\n"
        "  return <div k=\"x\" on={() => { go(\"}\") }}>don't {a ? <b>it's</b> : <Foo bar={{x: 1}} />}</div>;\n}\n"
        "class W extends R.C {\n  static d = { a: 1 };\n  handler = async (e) => { this.x(e) }\n  state = {}\n  *gen() { yield 1 }\n"
        "  render() { if (x) { return null } return <></> }\n  get() { return 1 }\n}\n"
        "module.exports.run = function () { return 1 };\nexport default function () { return 2 }\nconst K = class { n() {} };\nasync function* stream() {}\n",
        [
            ("a", "function", "arrow_function", None, "() => 1", "1"),
            ("b", "function", "arrow_function", None, "() => 2", "2"),
            ("c", "function", "arrow_function", None, "const c", "+ 1"),
            ("real", "function", "function_declaration", None, "function real", "}"),
            ("outer", "function", "function_declaration", None, "function outer", "</div>;\n}"),
            ("W", "class", "class_declaration", None, "class W", "1 }\n}"),
            ("handler", "method", "arrow_function", "W", "handler =", "(e) }"),
            ("gen", "method", "method_definition", "W", "gen()", "1 }"),
            ("render", "method", "method_definition", "W", "render()", "</> }"),
            ("get", "method", "method_definition", "W", "get()", "1 }"),
            ("run", "function", "function_expression", None, "module.exports.run", "1 }"),
            (None, "function", "function_declaration", None, "export default function", "2 }"),
            ("K", "class", "class", None, "const K", "{} }"),
            ("n", "method", "method_definition", "K", "n()", "{}"),
            ("stream", "function", "generator_function_declaration", None, "async function*", "{}"),
        ],
    ),
    (
        "b.ts",
        "@Component({a: 1})\nexport class S<T> implements A, B {\n  @Input() name: string;\n  constructor(private x: number) { super() }\n"
        "  abstract foo(): void;\n  @Hook(\"x\")\n  run<T>(a: T): Promise<{a: string}> { return a }\n}\n"
        "declare function over(a: string): void\nfunction over(a: any): { x: number } { return a }\nexport const enum Color { Red }\n"
        "type U =\n  | \"a\"\n  | { b: string }\ninterface Z extends Y<A, B> { m(): void }\nnamespace N { export function inside() {} }\n"
        "const m: Map<string, X> = new Map();\nconst typed: (a: number) => void = (a) => { go(a) };\n",
        [
            ("S", "class", "class_declaration", None, "@Component", "}\n}"),
            ("constructor", "method", "method_definition", "S", "constructor", "() }"),
            ("run", "method", "method_definition", "S", "@Hook", "a }"),
            ("over", "function", "function_declaration", None, "function over", "a }"),
            ("Color", "class", "enum_declaration", None, "export const enum", "}"),
            ("U", "function", "type_alias_declaration", None, "type U", "string }"),
            ("Z", "class", "interface_declaration", None, "interface Z", "}"),
            ("inside", "function", "function_declaration", None, "export function", "{}"),
            ("typed", "function", "arrow_function", None, "const typed", "(a) }"),
        ],
    ),
    (
        "c.py",
        "async def f():\n    s = 'def no(): pass'\n    return (\n1)\n# def no\nclass A(B):\n    @property\n    def p(self): return 1\n    class In:\n        def q(self):\n            def z(): pass\n            return z\n",
        [
            ("f", "function", "function_definition", None, "async def", "1)"),
            ("A", "class", "class_definition", None, "class A", "return z"),
            ("p", "method", "function_definition", "A", "@property", "1"),
            ("In", "class", "class_definition", "A", "class In", "return z"),
            ("q", "method", "function_definition", "In", "def q", "return z"),
            ("z", "function", "function_definition", "q", "def z", "pass"),
        ],
    ),
]


@pytest.mark.parametrize("path,content,expected", SCANNED)
def test_strings_templates_comments_and_markup_declare_nothing(spark, path, content, expected):
    rows = spark.createDataFrame([("r", path, content)], "repository_id string, path string, content string")
    spans = chunking.spans_by_pattern(filters.detect_language(rows)).first().spans
    raw = content.encode()
    assert [(s.name, s.kind, s.node_type, s.parent) for s in spans] == [e[:4] for e in expected]
    for s, (*_, begins, ends) in zip(spans, expected):
        part = raw[s.start : s.end].decode()
        assert part.startswith(begins) and part.endswith(ends), part


def test_rules_cut_documents_into_sections_and_blocks(spark):
    markdown = "# A\ntext\n## B\n```\n# not\n```\n### C #\n# D\n"
    html = "<h1>T <b>x</b></h1><p>a</p><!-- <p>no</p> --><h2>U</h2><p>b</p><script>'<p>no</p>'</script><h1>V</h1>"
    rows = [("r", "a.md", "markdown", markdown), ("r", "b.html", "html", html), ("r", "c.md", "markdown", None), ("r", "d.md", "markdown", "")]
    files_ = spark.createDataFrame(rows, "repository_id string, path string, language string, content string")
    rules = {"markdown": scan.MARKDOWN, "html": scan.HTML}
    found = {r.path: [(s.name, s.node_type, s.parent, s.start, s.end) for s in r.spans] for r in chunking.spans_by_pattern(files_, rules).collect()}
    at = markdown.index
    assert found["a.md"] == [
        ("A", "heading", None, 0, at("# D")), ("B", "heading", "A", at("## B"), at("# D")),
        ("C", "heading", "B", at("### C"), at("# D")), ("D", "heading", None, at("# D"), len(markdown)),
    ]
    assert [s[:3] for s in found["b.html"]] == [
        ("T x", "heading", None), (None, "paragraph", "T x"), ("U", "heading", "T x"), (None, "paragraph", "U"), ("V", "heading", None),
    ]
    assert found["c.md"] == found["d.md"] == []
    assert all(not r.spans for r in chunking.spans_by_pattern(files_).collect())


def test_a_long_file_is_scanned_in_one_pass():
    def seconds(n):
        python = "".join(f"class C{i}:\n    def m(self, a):\n        return [a, 's']\n" for i in range(n))
        script = "".join(f"export class C{i} {{\n  m(a) {{\n    return `a${{a}}`;\n  }}\n}}\n" for i in range(n))
        began = time.process_time()
        assert len(scan.find_spans(python, "python", {})) == len(scan.find_spans(script, "javascript", {})) == 2 * n
        return time.process_time() - began

    short = seconds(3_000)
    assert seconds(12_000) < 8 * short + 1
