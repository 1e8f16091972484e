import hashlib
import sqlite3

import pytest
from pyspark.sql import functions as F

from sonde.functions import fixed, porter, text, vectors


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(column.alias("x")).first()["x"] if values else spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("tier,index,want", [(1, 0, 178194839916940299), (1, 1, 329705380987077453), (2, 0, 1064315163875379497)])
def test_stable_ids(spark, tier, index, want):
    assert one(spark, text.stable_id(F.lit("file:///test/a.txt"), F.lit(tier), F.lit(index))) == want
    assert want == int(hashlib.sha256(f"file:///test/a.txt:{tier}:{index}".encode()).hexdigest()[:15], 16)


@pytest.mark.parametrize(
    "name,tokens",
    [("C++", ["cpp"]), ("C#", ["csharp"]), ("F# parser", ["fsharp", "parser"]), ("ASP.NET core", ["asp", "dotnet", "core"]), ("TideTableReader", ["tide", "table", "reader"]), ("XMLHarbour", ["xml", "harbour"]), ("quickSounding", ["quick", "sounding"])],
)
def test_name_tokens(spark, name, tokens):
    assert one(spark, text.name_tokens(F.lit(name))) == tokens


@pytest.mark.parametrize("a,b,want", [("sounder", "sounding", True), ("navigator", "navigation", True), ("buoy", "buoy", True), ("harbour", "ledger", False), ("cat", "car", False)])
def test_token_matches(spark, a, b, want):
    assert one(spark, text.token_matches(F.lit(a), F.lit(b))) is want


def test_path_coverage(spark):
    q = lambda s: text.name_tokens(F.lit(s))
    for uri in ("C:\\x\\src\\tidal_sounder.py", "/x/src/tidal_sounder.py"):
        assert one(spark, text.path_coverage(F.lit(uri), q("tidal sounding of old harbour walls"))) == 1.0
    assert one(spark, text.path_coverage(F.lit("/a/TideTableReader.py"), q("seasonal table reader walker"))) == pytest.approx(2 / 3)
    assert one(spark, text.path_coverage(F.lit("/a/other.py"), q("seasonal table"))) == 0.0
    assert one(spark, text.path_coverage(F.lit("/a/other.py"), q(""))) == 0.0


def test_match_expression(spark):
    assert one(spark, text.match_expression(F.lit("   "))) == '""'
    assert one(spark, text.match_expression(F.lit('C++ error: "null"'))) == '"C++" OR "error:" OR "null"'
    assert one(spark, text.match_expression(F.lit("the"))) == '"the"'
    assert one(spark, text.match_expression(F.lit("the fox is quick"))) == '"fox" OR "quick"'


def test_extension_and_mime(spark):
    assert one(spark, text.matches_ext(F.lit("FILE.RS"), ".rs")) and not one(spark, text.matches_ext(F.lit("notes.md"), "rs"))
    assert one(spark, text.extension(F.lit("a/.bashrc"))) == ""
    assert one(spark, text.mime_for(F.lit("b.xlsx"))).endswith("spreadsheetml.sheet")
    for name in ("x.py", "x.ts", "x.tsx", "x.js", "x.jsx", "x.rs", "x.go"):
        assert one(spark, text.mime_for(F.lit(name))).startswith("text/")
    assert one(spark, text.method_for(F.lit("application/x-unknown"))) == "generic/v1"
    assert one(spark, text.method_for(F.lit("a"), {"a": "xlsx/v2"})) == "xlsx/v2"


@pytest.mark.parametrize(
    "content,tokens,want",
    [
        ("A perfect sentence with words.", 100, 100),
        ("A perfect sentence with words.", 5, 75),
        ("No sentence end here", 100, 75),
        ("An open (bracket here.", 100, 80),
        ("hello world foo (bar", 5, 30),
        ("", 100, 75),
        ("a" + " " * 9 + ".", 100, 85),
        ("x x x x x x x x x x.", 100, 70),
        ("xyz xyz xyz xyz xyz xyz xyz.", 100, 85),
        ("(]", 100, 55),
    ],
)
def test_structural(spark, content, tokens, want):
    assert one(spark, vectors.structural_hundredths(F.lit(1), F.lit(tokens), F.lit(content))) == want


def test_vectors(spark):
    a, b = F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(0.0), F.lit(2.0))
    assert one(spark, vectors.cosine(a, a)) == 1.0 and one(spark, vectors.cosine(a, b)) == 0.0 and one(spark, vectors.cosine(a, F.array(F.lit(0.0), F.lit(0.0)))) == 0.0
    assert one(spark, vectors.unit(b)) == [0.0, 1.0]
    assert [one(spark, vectors.cells_for(F.lit(n))) for n in (1, 100, 9000, 10**6)] == [4, 40, 376, 1024]


def test_packed_groups(spark):
    counts = F.array(*map(F.lit, [600, 600, 600, 1499, 1500, 3]))
    assert one(spark, text.packed_groups(counts, 1500)) == [0, 0, 1, 2, 3, 4]


def test_front_matter_and_links(spark):
    doc = "---\ntitle: My Doc\nauthor: Alice\n---\n\n## Body\n\nContent here.\n"
    pairs, rest = text.front_matter(F.lit(doc))
    assert one(spark, pairs) == [("title", "My Doc"), ("author", "Alice")] and one(spark, rest) == "## Body\n\nContent here.\n"
    assert one(spark, text.front_matter(F.lit("---\r\nx"))[1]) == "---\r\nx"
    assert one(spark, text.join_uri(F.lit("file:///docs/intro.md"), F.lit("./overview.md"))) == "file:///docs/./overview.md"
    assert one(spark, text.resolve_uri(F.lit("file:///docs/./a/../overview.md#x"))) == "file:///docs/overview.md"


def test_display(spark):
    assert one(spark, text.display_number(F.lit(12345))) == "12,345"
    assert one(spark, text.display_time(F.lit(1700000000.0))) == "2023-11-14 22:13"
    assert one(spark, text.display_bytes(F.lit(3 << 20))) == "3.0 MiB"
    assert one(spark, text.preview(F.lit("\n  \n  first line \nx"))) == "first line"
    assert one(spark, text.source_label(F.lit("/a/b/c.py"))) == "b/c.py"
    assert one(spark, text.with_record(F.lit('{"a":1}'), F.lit('{"tool":"x"}'))) == '{"a":1,"record":{"tool":"x"}}'
    assert one(spark, text.with_record(F.lit("nonsense"), F.lit("1"))) == '{"record":1}'


def test_walk_rules_as_expression(spark):
    kept = ["README.md", "main.rs", "data.csv", "src/lib.rs", "firebase/functions/a.py"]
    gone = ["binary.exe", "build.lock", ".env", "Cargo.lock", ".env.local", "node_modules/lib.js", "functions/a.py", "x/functions/a.py"]
    rows = spark.createDataFrame([(p,) for p in kept + gone], "p string")
    assert {r["p"] for r in rows.where(text.keeps_path(F.col("p"))).collect()} == set(kept)


def test_porter_against_sqlite(sf_dir):
    con = sqlite3.connect(":memory:")
    con.execute("CREATE VIRTUAL TABLE t USING fts5(x, tokenize='porter unicode61')")
    con.execute("CREATE VIRTUAL TABLE v USING fts5vocab(t, 'row')")
    words = (
        "running runs ran relational conditional rational valenci hesitanci digitizer conformabli radicalli differentli vileli analogousli vietnamization predication operator feudalism decisiveness hopefulness callousness "
        "formaliti sensitiviti sensibiliti triplicate formative formalize electriciti electrical hopeful goodness revival allowance inference airliner gyroscopic adjustable defensible irritant replacement adjustment dependent "
        "adoption homologou communism activate angulariti homologous effective bowdlerize probate rate cease controll roll caresses ponies ties caress cats feed agreed plastered bled motoring sing conflated troubled sized hopping "
        "tanned falling hissing fizzed failing filing happy sky naïve Ångström élan generalizations oscillators archaeology apologies crying dying by say enjoy skies analogy y yes as is us this abilities logi apology geologi"
    ).split()
    for w in words:
        con.execute("DELETE FROM t")
        con.execute("INSERT INTO t VALUES (?)", (w,))
        assert porter.term(w) == con.execute("SELECT term FROM v").fetchone()[0], w


def test_fixed_lists_have_their_sizes():
    assert len(fixed.STOP_WORDS) == len(set(fixed.STOP_WORDS)) and len(fixed.MIME_BY_EXT) == 40 and fixed.IGNORED_EXTS.count(".parquet") == 1


def test_registered_functions(spark):
    from sonde.functions.register import balanced, parser_name, register_all

    register_all(spark)
    row = spark.sql("SELECT sonde_porter('Running') AS p, sonde_fold('Ångström') AS f, sonde_count_tokens('abcdef') AS n, sonde_decode(X'EFBBBF61') AS d, sonde_balanced('([{}])') AS b, size(sonde_embed('a b')) AS e").first()
    assert tuple(row) == ("run", "angstrom", 2, "a", True, 64)
    assert not balanced("(]") and not balanced("(") and balanced("a<b")
    mimes = ["text/plain", "TEXT/Markdown; x=y", "application/pdf", "image/png", "text/x-rust", "text/x-python", "application/javascript", "text/csv", "application/vnd.ms-excel", "application/json"]
    rows = spark.createDataFrame([(m,) for m in mimes], "m string").select("m", text.parser_for(text.normal_mime(F.col("m"))).alias("p")).collect()
    assert all(parser_name(r["m"]) == r["p"] for r in rows)
    assert spark.sql("SELECT c.tier FROM VALUES (X'FF00') AS t(x), LATERAL sonde_chunks(x, 'application/vnd.ms-excel', 'n', 'u') c").collect() == []


def test_segmentation_can_be_turned_off(spark, monkeypatch):
    assert one(spark, text.name_tokens(F.lit("TideTableReader C++"), segment=False)) == ["tidetablereader", "cpp"]
    monkeypatch.setenv("SONDE_SEGMENT", "off")
    assert one(spark, text.name_tokens(F.lit("TideTable"))) == ["tidetable"]


@pytest.mark.parametrize("unit", ["plain words. ", "naïve wörds €😀 "])
def test_long_texts_are_cut_in_linear_time(spark, unit):
    import time

    def run(n):
        began = time.time()
        parts = spark.range(1).select(F.repeat(F.lit(unit), F.col("id").cast("int") + n).alias("t")).select(F.md5(F.array_join(text.budget_segments(F.col("t"), 500), "").cast("binary")), F.md5(F.col("t").cast("binary"))).first()
        assert parts[0] == parts[1]
        return time.time() - began

    run(1000)
    size = 16_000_000 // len(unit.encode())
    assert run(size) < 30


def test_groups_over_many_blocks(spark):
    counts = [1 + (7 * i) % 90 for i in range(1000)]
    want, group, used = [], 0, 0
    for i, n in enumerate(counts):
        if i and used + n > 200:
            group, used = group + 1, 0
        used += n
        want.append(group)
    assert one(spark, text.packed_groups(F.array(*map(F.lit, counts)), 200)) == want
    assert one(spark, text.packed_groups(F.array().cast("array<int>"), 200)) == []


@pytest.mark.parametrize("marks,want", [("", True), ("(" * 30 + ")" * 30, True), ("([{}])[]{()}", True), ("([)]", False), ("((((((", False), ("}{", False), ("{[(((((([])))))))]}", False), ("[((((((()))))))]", True), ("(((((([))))))]", False)])
def test_brackets(spark, marks, want):
    from sonde.functions.register import balanced as by_stack
    from sonde.functions.vectors import balanced

    noisy = "a ".join(marks) + " b"
    assert one(spark, balanced(F.lit(noisy))) is want and by_stack(noisy) is want
