import io
import json
import zipfile

import pytest

from sonde.operators.chunking import chunk_documents, chunk_edges
from sonde.operators.chunking.parsers import PARSERS, Document, headings, links, rust_declaration, script_declaration, sections
from sonde.operators.chunking.tokens import Counter, decode


def parse(kind, data, name="a.txt", mime="text/plain", uri=""):
    data = data.encode() if isinstance(data, str) else data
    return PARSERS[kind](Document(uri, name, mime, data, Counter()))


def tier(result, k):
    return [c for c in result.chunks if c[0] == k]


def workbook(rows):
    cell = lambda v: f'<c t="inlineStr"><is><t>{v}</t></is></c>' if isinstance(v, str) else f"<c><v>{v}</v></c>"
    main = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {main} xmlns:r="{rel}"><sheets><sheet name="Sheet1" sheetId="1" r:id="rId1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/worksheets/sheet1.xml", f"<worksheet {main}><sheetData>" + "".join("<row>" + "".join(map(cell, r)) + "</row>" for r in rows) + "</sheetData></worksheet>")
    return out.getvalue()


def test_xlsx():
    r = parse("xlsx", workbook([["Harbour", "Ships"], ["Lerwick", 12], ["Wick", 7], ["Stromness", 9]]), "a.xlsx")
    assert [c[2] for c in tier(r, 1)] == ["Harbour: Lerwick | Ships: 12", "Harbour: Wick | Ships: 7", "Harbour: Stromness | Ships: 9"]
    assert "Harbour: Wick" in tier(r, 2)[0][2]
    assert json.loads(tier(r, 3)[0][2]) == {"sheet": "Sheet1", "columns": ["Harbour", "Ships"], "row_count": 3}
    from sonde.sources.workbooks import workbook as write

    both = parse("xlsx", write({"A & B": [["x<y", "n"], ["1 > 0", 2.5]], "empty": []}), "b.xlsx")
    assert [c[2] for c in tier(both, 1)] == ["x<y: 1 > 0 | n: 2.5"] and [json.loads(c[4])["sheet"] for c in tier(both, 3)] == ["A & B"]


def test_csv():
    r = parse("csv", "Fish,Kg\n")
    assert [c[2] for c in tier(r, 2)] == ["Columns: Fish, Kg"] and tier(r, 2)[0][3] == 5 and not tier(r, 1)
    r = parse("csv", '\ufeffa,,c\n1,"x, y"\n4,5,6,7\n')
    assert [c[2] for c in tier(r, 1)] == ["a: 1 | col_1: x, y | c: ", "a: 4 | col_1: 5 | c: 6"]
    assert [json.loads(c[4]) for c in tier(r, 1)] == [{"row": 2}, {"row": 3}]
    many = parse("csv", "k\n" + "".join("v" * 300 + "\n" for _ in range(40)))
    assert [c[1] for c in tier(many, 2)] == [0, 1, 2] and all(c[3] <= 1500 for c in tier(many, 2)) and sum(c[2].count("k: ") for c in tier(many, 2)) == 40


def test_markdown():
    r = parse("markdown", "## Tides\n\nHigh at noon.\n\n## Winds\n\nFrom the west.\n", mime="text/markdown")
    assert [c[2].split("\n")[0] for c in tier(r, 1)] == ["## Tides", "## Winds"]
    r = parse("markdown", "---\nport: Wick\nkeeper: Ola\n---\n\n## Log\n\nAll quiet.\n", mime="text/markdown")
    assert not tier(r, 1)[0][2].startswith("---") and "port=Wick" in tier(r, 3)[0][2] and json.loads(tier(r, 1)[0][4])["keeper"] == "Ola"
    r = parse("markdown", "## Charts\n\nThe [north sheet](./north.md) is old.\n", uri="file:///sea/charts.md")
    assert [(e[1], e[2], json.loads(e[3])) for e in r.edges] == [("file:///sea/./north.md", "LINKS_TO", {"label": "north sheet"})]


def test_headings_and_sections():
    text = "pre\n\n# A\n\n```\n# no\n```\nSet\next\n---\n\n    # code\n\n#### Deep\n- x\n---\n"
    assert [(lvl, t) for _, lvl, t in headings(text)] == [(1, "A"), (2, "Set\next"), (4, "Deep")]
    assert sections("# Only\n## Both\n\ntext\n# Last") == ["# Only\n## Both\n\ntext", "# Last"]
    assert sections("  \n") == [] and sections("plain") == ["plain"]
    assert list(links("![i](a.png) [b *c*](d.md \"t\") `[x](y)` [r][k] [k] <z>\n\n[k]: e.md\n")) == [("d.md", "b c"), ("e.md", "r"), ("e.md", "k")]


def test_plaintext_budgets():
    r = parse("plaintext", "word " * 360 + "\n\n" + "word " * 360)
    assert [c[3] for c in tier(r, 1)] == [500, 99, 500, 99]
    r = parse("plaintext", "é" * 1601)
    assert "".join(c[2] for c in tier(r, 1)) == "é" * 1601 and all(len(c[2].encode()) <= 1500 for c in tier(r, 1))
    assert not tier(parse("plaintext", " \n\n "), 1) and len(tier(parse("plaintext", ""), 3)) == 1


def test_tokenizer_budget():
    import public_tokenizers

    counter, text = Counter(public_tokenizers.path("byte_bpe_50k.json")), "the quick brown fox naïve " * 40
    parts = counter.cut(text, 50)
    assert "".join(parts) == text and len(parts) > 1 and max(map(counter.count, parts)) <= 51


def test_binary():
    r = parse("binary", b"\x89PNG\r\n", "x.png", "image/png")
    assert len(r.chunks) == 1 and r.chunks[0][0] == 3 and "image/png" in r.chunks[0][2] and not r.edges


SCRIPT = "import { sea } from './sea';\n\nexport const depth = (x) => {\n  const y = sea(x);\n  return y;\n};\n\nexport function tide(hour) {\n  return depth(hour);\n}\n"


def test_script():
    r = parse("script", SCRIPT, "a.tsx")
    assert len(tier(r, 1)) == 3 and [c[2].count("const y") for c in tier(r, 1)] == [0, 1, 0]
    assert all("File: a.tsx" in c[2] and "Entity: " in c[2] for c in tier(r, 1))
    assert "Symbols: const depth, function tide" in tier(r, 3)[0][2]
    long = parse("script", "function f() {\n" + "  let abc = 12345678;\n" * 200 + "}\n")
    assert all(c[3] < 495 for c in tier(long, 1)) and "(cont.)" in tier(long, 1)[1][2]
    plain = parse("script", "\n".join(f"  call({i:05d});" for i in range(400)))
    parts = [c[2].split("Code:\n")[1].split("\n") for c in tier(plain, 1)]
    assert parts[0][-1] in parts[1] and parts[0][0] not in parts[1]


def test_rust():
    code = "use core::mem;\n\npub struct Buoy {\n    lit: bool,\n}\n\nimpl Buoy {\n    fn dark() -> Self { Buoy { lit: false } }\n}\n\nfn watch() {\n    mem::drop(Buoy::dark());\n}\n"
    r = parse("rust", code, "p.rs", "text/x-rust")
    assert len(tier(r, 1)) == 4 and "Items: struct Buoy, impl Buoy, fn watch" in tier(r, 3)[0][2]
    assert rust_declaration("impl<T: Into<U>> From<T> for X") == ("impl", "From") and rust_declaration("impl <T>") == ("impl", "block")
    assert rust_declaration("fn") is None and rust_declaration("fn <A<B>, C>go(x: D<E>)") == ("fn", "go") and rust_declaration("fn <A<B>go") is None
    assert rust_declaration("implement_foo()") is None and rust_declaration("pub(crate) async unsafe fn go<T>()") == ("fn", "go")
    assert rust_declaration("macro_rules! m {") == ("macro", "m") and rust_declaration("#[derive]") is None and rust_declaration("    fn x()") is None
    assert script_declaration("export default async function main() {") == ("function", "main") and script_declaration(" const y") is None


def filled(sizes, budget, overlap):
    """Pieces of lines, line by line: (first, end) of each."""
    out, held = [], []
    for i, n in enumerate(sizes):
        if held and sum(sizes[k] for k in held) + n > budget:
            out.append((held[0], i))
            held = [k for k in held if sum(sizes[x] for x in held if x >= k) <= overlap]
        held.append(i)
    return [*out, (held[0], len(sizes))] if held else out


@pytest.mark.parametrize("seed", range(30))
def test_overlapping_pieces_line_by_line(seed):
    import random

    rnd = random.Random(seed)
    lines = ["z" * rnd.choice([1, 30, 100, 140, 400, 1600]) for _ in range(rnd.randint(1, 60))]
    r = parse("script", "\n".join(lines), "a.js")
    want = filled([max(1, len(x) // 3) + 1 for x in lines], 500, 50)
    assert [c[2].split("Code:\n")[1].split("\n") for c in tier(r, 1)] == [lines[a:b] for a, b in want]


def test_decode():
    assert decode(b"\xef\xbb\xbfa") == "a" and decode("é".encode("utf-16")) == "é" and decode(b"a\xff") == "a\ufffd"


def test_tables(spark):
    rows = [("doc/a.md", "a.md", "text/markdown; charset=utf-8", b"# T\n\n[x](b.md)\n"), ("doc/b.xlsx", "b.xlsx", "application/vnd.ms-excel", b"broken"), ("c", "c", "text/x-python", "x = 1".encode())]
    docs = spark.createDataFrame(rows, "file_uri string, name string, mime_type string, content binary")
    chunks = chunk_documents(docs).collect()
    assert {c["file_uri"] for c in chunks} == {"doc/a.md", "c"} and {c["chunker_method"] for c in chunks} == {"markdown/v1", "plaintext/v1"}
    assert len({c["chunk_id"] for c in chunks}) == len(chunks)
    edge = chunk_edges(docs).first()
    assert edge["dst_uri"] == "doc/b.md" and edge["src_chunk"] in {c["chunk_id"] for c in chunks}


@pytest.mark.parametrize("kind", ["plaintext", "markdown", "csv", "script", "rust"])
def test_windows_join_to_the_text(kind):
    text = "para one\n\n" + "naïve words, and more\n" * 900
    r = parse(kind, text)
    if kind != "csv":
        assert "".join(c[2] for c in tier(r, 2)) == text
    assert [c[1] for c in tier(r, 1)] == list(range(len(tier(r, 1))))


def test_native_chunks_equal_the_parsers(spark, sf_dir):
    from pyspark.sql import functions as F

    from sonde.operators.chunking import plain_chunks
    from sonde.sources.tables import document_files

    docs = document_files(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("file_uri", "name", "mime_type", "content")
    more = spark.createDataFrame([("m1", "m", "text/plain", "é€😀" * 900 + "\n\n \n\n x\n"), ("m2", "m", "text/plain", " \n "), ("m3", "m", "text/plain", ""), ("m4", "m", "text/plain", "## H\r\n\r\nb")], docs.schema)
    docs = docs.unionByName(more)
    columns = ["chunk_id", "tier", "chunk_index", "content", "token_count"]
    native = plain_chunks(docs).select(*columns).withColumn("tier", F.col("tier").cast("int"))
    parsed = chunk_documents(docs).select(*columns)
    assert native.exceptAll(parsed).collect() == [] and parsed.exceptAll(native).collect() == []


def test_documents_of_one_uri_keep_their_own_chunks(spark):
    rows = [("u", "a.txt", "text/plain", "one\n\ntwo"), ("u", "b.csv", "text/csv", "h\n1\n"), ("v", "c.xlsx", "application/vnd.ms-excel", "broken"), ("w", "d.txt", "text/plain", None)]
    docs = spark.createDataFrame(rows, "file_uri string, name string, mime_type string, content string")
    got = sorted((r["name"], r["tier"], r["chunk_index"], r["content"], r["chunker_method"]) for r in chunk_documents(docs, keep=("name",)).where("tier = 1").collect())
    assert got == [("a.txt", 1, 0, "one", "plaintext/v1"), ("a.txt", 1, 1, "two", "plaintext/v1"), ("b.csv", 1, 0, "h: 1", "csv/v1")]
    assert chunk_documents(docs).where("file_uri = 'u' AND tier = 3").count() == 2
