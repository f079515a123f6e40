import itertools

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.llm.helpers import with_extra
from millrace.llm.docpairs import assign, candidates, function_doc_pairs, listed_pairs, pairs_in, symbol_words, weight

DOC = "// Load reads the nearest cached records from disk.\n"


def symbols(text, **kw):
    return [p[0] for p in pairs_in(text, **kw)]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        (DOC + "func Load() {\n}\n", ["Load"]),
        (DOC + "func Load() { return }", ["Load"]),
        (DOC + "func Load() error\n", []),  # no body
        (DOC + "func Load() {\n\tx()\n", []),  # cut off
        (DOC + "\nfunc Load() {\n}\n", []),  # a blank line between
        (DOC + "func  ( s  *Store[K, V] )Load(a int) interface{ Len() int } {\n}\n", ["Store.Load"]),
        (DOC + "func (Store) Load(f func(int) bool) (out map[string]struct{}, err error) {\n}\n", ["Store.Load"]),
        (DOC + "func Load[T any](a T) struct{} {\n}\n", ["Load"]),
        ("// Load TODO the\nfunc Load() {\n}\n", []),
        ("// TODO: one two three four five six\nfunc Load() {\n}\n", []),
        ("// TODO: one two\n//\n" + DOC + "func Load() {\n}\n", ["Load"]),
        (DOC + "//go:noinline\nfunc Load() {\n}\n", ["Load"]),
        ("//go:noinline fast inlined code generated\nfunc Load() {\n}\n", []),
        ("/*\n * Load reads the\n * nearest cached records.\n */\r\nfunc Load() {\r\n}\r\n", ["Load"]),
        ("var x = 1 // one two three four five six\nfunc Load() {\n}\n", []),
        ("var s = `\n" + DOC + "func Fake() {\n}\n`\n" + DOC + "func Load() {\n}\n", ["Load"]),
        ("x := `a`\n" + DOC + "func Load() {\n}\n", ["Load"]),
        ("a raw string's end\n`\n\t_ = tmpl\n}\n\n" + DOC + "func Load() {\n}\n", ["Load"]),  # begins inside a raw string
        ("rest of a comment */\n" + DOC + "func Load() {\n}\n", ["Load"]),
        ("\t}\n\treturn\n}\n" + DOC + "func Load() {\n}\n", ["Load"]),  # begins inside a body
        ("/*\n" + DOC + "func Load() {\n}\n*/\n", []),
        ("type T interface {\n\t// Load reads the nearest cached records.\n\tLoad() error\n}\n", []),
        ("func A() {\n\t// calls the nearest cached record loader\n\tfunc() {\n\t}()\n}\n", []),
        ("// Walk_Record is walk record for the and of walk\nfunc Walk_Record() {\n}\n", []),
        ("// Liest alle Zeilen über beide Zweige.\nfunc Lies() {\n}\n", ["Lies"]),
        ("", []),
        ("func", []),
    ],
)
def test_pairs(text, want):
    assert symbols(text) == want


def test_description_and_place():
    ((symbol, description, line, _),) = pairs_in("package a\n\n// Load reads the nearest cached records.\n//\n// XXX broken.\nfunc Load() {}\n")
    assert (symbol, description, line) == ("Load", "Load reads the nearest cached records.", 6)


def test_gap_is_a_parameter():
    text = DOC + "\nfunc Load() {\n}\n"
    assert symbols(text, max_gap=1) == ["Load"]


def test_symbol_words():
    assert {"counthttpfooter", "count", "http", "footer"} <= symbol_words("CountHTTPFooter")
    assert {"set", "walk", "record"} <= symbol_words("Set.Walk_Record")


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.tuples(st.integers(0, 4), st.integers(0, 4)), st.integers(1, 50).map(float), max_size=12))
def test_assignment_is_the_best(weights):
    got = assign(weights)
    assert len(set(got.values())) == len(got) and all((a, b) in weights for a, b in got.items())
    best, lefts = 0.0, sorted({a for a, _ in weights})
    for choice in itertools.product(range(-1, 5), repeat=len(lefts)):
        used = [c for c in choice if c >= 0]
        if len(set(used)) == len(used) and all(c < 0 or (a, c) in weights for a, c in zip(lefts, choice)):
            best = max(best, sum(weights[a, c] for a, c in zip(lefts, choice) if c >= 0))
    assert sum(weights[a, b] for a, b in got.items()) == pytest.approx(best)


def test_long_and_hostile_texts_end():
    assert pairs_in("(" * 200_000) == []
    assert pairs_in("*/" * 50_000) == []
    assert len(pairs_in((DOC + "func Load() {\n}\n") * 3000)) == 3000


def test_table(spark):
    rows = [("a", "x.go", DOC + "func Load() {}\n"), ("a", "x.go", DOC + "func Load() {}\n"), ("b", "x.py", DOC + "func Load() {}\n"), (None, "x.go", DOC), ("c", None, DOC), ("d", "y.go", None), ("e", "y.go", "")]
    df = with_extra(spark.createDataFrame(rows, "id string, path string, text string"), "ID", "span_id", "symbol", "Text")
    got = function_doc_pairs(df).collect()
    assert [(r.span_id, r.symbol) for r in got] == [("a", "Load")]
    assert function_doc_pairs(df.limit(0)).count() == 0


TAGGED = 'type T struct {\n\tName string `json:"name"`\n\tsync.Mutex `json:"-" yaml:"-"`\n}\n'
SAVE = "// Save writes the changed records back.\nfunc (t *T) Save() {\n\tx := `a`\n}\n"


@pytest.mark.parametrize(
    ("text", "want"),
    [
        (DOC + "func Load() {\n}\n" + TAGGED + SAVE, ["Load", "T.Save"]),
        (TAGGED + SAVE + DOC + "func Load() {\n}\n", ["T.Save", "Load"]),
        ("\tA, B *x.Y `a:\"b\"` // c\n}\n" + SAVE, ["T.Save"]),  # begins inside a struct
        ("\tA []string `@Ident`\n}\n" + SAVE, ["T.Save"]),
        ("package a\n\nvar x = []string{\n\t`a`,\n\t`b {`,\n}\n" + SAVE, ["T.Save"]),  # a raw string on a line of its own
        ("import `fmt`\n" + SAVE, ["T.Save"]),
        ("FROM t WHERE name ` + x + `\n" + "// Fake is no function but text.\nfunc Fake() {\n}\n`\n}\n" + SAVE, ["T.Save"]),  # begins inside a raw string
        ("the end of a text`\n}\n" + SAVE + "var y = `\nand a new one", ["T.Save"]),
    ],
)
def test_struct_tags_and_raw_strings(text, want):
    assert symbols(text) == want


def _choices(text):
    """(pairs by assignment, pairs if each function took its best comment), as {symbol: first line of the comment}."""
    functions, comments, weights = candidates(text)
    first = {}
    for (f, c), w in sorted(weights.items()):
        if f not in first or w > weights[f, first[f]]:
            first[f] = c
    return tuple({functions[f].symbol: comments[c].first for f, c in x.items()} for x in (assign(weights), first))


def test_assignment_outvotes_the_best_comment_of_each():
    text = (
        "// Open and what it does to the nearest file handles.\n\n"
        "func Open(path string, mode int) {\n}\n\n"
        "// Open and Close share the path and the mode of the file.\n\n"
        "func Close(other int) {\n}\n"
    )
    assigned, alone = _choices(text)
    assert alone == {"Open": 6, "Close": 6}  # both like the second comment best
    assert assigned == {"Open": 1, "Close": 6}
    assert [(s, gap) for s, _, _, gap in pairs_in(text, max_gap=2)] == [("Open", 1)]  # a far comment must open with the name
    assert symbols(text) == []


def test_tags_and_names_outvote_nearness():
    text = (
        "// Seek moves the cursor.\n// @param offset where to\n// @param whence from where\n\n"
        "// A general remark on all that follows in this file.\n\n"
        "func Seek(offset int, whence int) {\n}\n"
    )
    assert _choices(text)[0] == {"Seek": 1}
    # But a comment on the line above that describes is the documentation, whatever others say.
    assert _choices(text.replace("file.\n\nfunc", "file.\nfunc"))[0] == {"Seek": 5}
    assert [p[3] for p in pairs_in(text.replace("cursor", "cursor of an open file to it"), max_gap=2)] == [] and len(pairs_in(text.replace("cursor", "cursor of an open file to it"), max_gap=3)) == 1


def test_comments_below_and_many_candidates():
    below = "func Load() {\n}\n// Load reads the nearest cached records.\n\nvar x = 1\n"
    assert [(s, gap) for s, _, _, gap in pairs_in(below, max_gap=1)] == [("Load", -1)] and symbols(below) == []
    many = "// Load reads the nearest cached records.\n\n" + "".join(f"// Remark {i}.\n\n" for i in range(300)) + "func Load() {\n}\n"
    assert _choices(many)[0] == {"Load": 1} and len(pairs_in(many, max_gap=1000)) == 1
    chain = "".join(f"// Note {i} on what comes next or before.\n\nfunc F{i}() {{\n}}\n\n" for i in range(1500))
    assert len(_choices(chain)[0]) == 1500
    wide = "func Load(" + ", ".join(f"p{i:02d} int" for i in range(40)) + ") {\n}\n"
    assert weight("// " + " ".join(f"p{i:02d}" for i in range(40)) + "\n\n" + wide, *[x[0] for x in candidates("// " + " ".join(f"p{i:02d}" for i in range(40)) + "\n\n" + wide)[:2]]) >= 6


def test_listed_pairs(spark):
    spans = spark.createDataFrame([("a", "r", "x.go"), ("b", "r", "y.go"), (None, "r", "z.go")], "id string, repo_id string, path string")
    pairs = spark.createDataFrame([("a", "T.Load"), ("b", "Save")], "span_id string, symbol string")
    cases = spark.createDataFrame([("r", "x.go", "(*T).Load", "Func ", "decl"), ("r", "x.go", "T.load", None, " DECL"), ("r", "y.go", "Gone", "method", None), ("r", "y.go", "Save", "type", "decl"), ("r", None, "Save", "func", "decl")], "repo_id string, path string, symbol string, kind string, doc_of string")
    assert [tuple(r) for r in listed_pairs(pairs, spans, cases).collect()] == [("r", 2, 1)]
    assert listed_pairs(pairs, spans, cases.limit(0)).count() == 0
