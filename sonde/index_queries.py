"""More of the catalogue: the life of an index, the parsers over whole tables, and listings."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import fixed, text
from .operators import bm25, fusion, maintenance, metadata, quality
from .operators.chunking import chunk_documents, chunk_edges
from .plans.indexer import Indexer
from .plans.store import Store
from .queries import CATALOG, CHANNELS, CHECKS, CHUNKS, COHERENCE, FILES, HREFS, STATES, _catalog, _edges, _fused, _lines, _read, _states, _values, _vectors, query
from .sources import tables
from .sources.workbooks import as_workbooks
from .staging import staging_root
from .streaming.ingest import start_ingest

# --- chunks by the parsers


@query(f"WITH {CHUNKS} SELECT chunk_id, file_uri, tier, chunk_index, token_count, md5(content) AS content_md5, 'plaintext/v1' AS chunker_method FROM chunks")
def chunk_documents_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents through the parsers, multi-byte texts too."""
    docs = tables.document_files(_read(spark, sf_dir, "documents"))
    return chunk_documents(docs).select("chunk_id", "file_uri", "tier", "chunk_index", "token_count", F.md5(F.col("content").cast("binary")).alias("content_md5"), "chunker_method")


PAGES = r"""files AS (SELECT page_id AS file_id, url AS file_uri, list_filter(regexp_split_to_array(url, '[/\\]'), lambda x: x <> '')[-1] AS name, 'text/html' AS mime_type,
  md5(html) AS content_hash, CAST(strlen(html) AS BIGINT) AS size_bytes, 0.0 AS modified_at, html AS content FROM pages)"""


@query(f"WITH {CHUNKS.replace(FILES, PAGES)} SELECT chunk_id, file_uri, tier, chunk_index, token_count, md5(content) AS content_md5 FROM chunks")
def page_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = tables.page_files(_read(spark, sf_dir, "pages")).withColumn("name", text.last_segment(F.col("file_uri")))
    return chunk_documents(pages).select("chunk_id", "file_uri", "tier", "chunk_index", "token_count", F.md5(F.col("content").cast("binary")).alias("content_md5"))


def _documents(rows: DataFrame, mime: str, name: str, content) -> DataFrame:
    """One document for each row (id, ...): its name from ``name`` with the id in it."""
    label = F.format_string(name, F.col("id"))
    return rows.select(F.concat(F.lit("made:///"), label).alias("file_uri"), label.alias("name"), F.lit(mime).alias("mime_type"), content.alias("content"))


SUPPLIER_KV = "'s_suppkey: ' || s_suppkey || ' | s_name: ' || s_name"
SHEET_SQL = f"""WITH s AS (SELECT s_nationkey AS id, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey, s_name) - 1 AS i, {SUPPLIER_KV} AS content FROM supplier)"""


@query(
    SHEET_SQL
    + """ SELECT 'n' || id || '.xlsx' AS name, 1 AS tier, CAST(i AS BIGINT) AS chunk_index, content, CAST(greatest(1, strlen(content) // 3) AS BIGINT) AS token_count, '{"sheet": "Sheet1"}' AS meta FROM s
UNION ALL SELECT 'n' || id || '.xlsx', 3, 0, '{' || chr(10) || '  "columns": [' || chr(10) || '    "s_suppkey",' || chr(10) || '    "s_name"' || chr(10) || '  ],' || chr(10) || '  "row_count": ' || count(*) || ',' || chr(10) || '  "sheet": "Sheet1"' || chr(10) || '}', NULL,
  '{"sheet": "Sheet1", "source": "n' || id || '.xlsx"}' FROM s GROUP BY id"""
)
def xlsx_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A workbook of suppliers for each nation: its rows and its shape."""
    books = as_workbooks(_read(spark, sf_dir, "supplier"), "s_nationkey", ["s_suppkey", "s_name"]).withColumnRenamed("s_nationkey", "id")
    docs = _documents(books, f"{fixed.OOXML}.spreadsheetml.sheet", "n%d.xlsx", F.col("content"))
    chunks = chunk_documents(docs, keep=("name",)).where("tier <> 2")
    return chunks.select("name", "tier", "chunk_index", "content", F.when(F.col("tier") == 1, F.col("token_count")).alias("token_count"), "meta")


@query(
    f"""WITH s AS (SELECT s_nationkey AS id, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS i, {SUPPLIER_KV} AS content FROM supplier)
SELECT 'n' || id || '.csv' AS name, CAST(i - 1 AS BIGINT) AS chunk_index, content, CAST(greatest(1, strlen(content) // 3) AS BIGINT) AS token_count, '{{"row": ' || (i + 1) || '}}' AS meta FROM s"""
)
def csv_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A CSV file of suppliers for each nation: its rows."""
    s = _read(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("id")).agg(F.array_sort(F.collect_list(F.struct("s_suppkey", "s_name"))).alias("rows"))
    lines = F.transform("rows", lambda r: F.concat_ws(",", r["s_suppkey"].cast("string"), F.concat(F.lit('"'), r["s_name"], F.lit('"'))))
    docs = _documents(s, "text/csv", "n%d.csv", F.concat(F.lit("s_suppkey,s_name\n"), F.array_join(lines, "\n"), F.lit("\n")))
    chunks = chunk_documents(docs, keep=("name",)).where("tier = 1")
    return chunks.select("name", "chunk_index", "content", "token_count", "meta")


@query(
    """WITH d AS (SELECT doc_id AS id, source, lang, strlen(coalesce(text, '')) AS n FROM documents), b AS (SELECT *, '# Doc ' || id || chr(10) || chr(10) || 'from ' || source || ' [next](d' || (id + 1) || '.md#top)' || chr(10) || chr(10) || '## Size' || chr(10) || chr(10) || n || ' bytes' || chr(10) AS body FROM d)
SELECT 'd' || id || '.md' AS name, 1 AS tier, CAST(0 AS BIGINT) AS chunk_index, '# Doc ' || id || chr(10) || chr(10) || 'from ' || source || ' [next](d' || (id + 1) || '.md#top)' AS content, '{"source": "d' || id || '.md", "lang": "' || lang || '"}' AS meta FROM b
UNION ALL SELECT 'd' || id || '.md', 1, 1, '## Size' || chr(10) || chr(10) || n || ' bytes', '{"source": "d' || id || '.md", "lang": "' || lang || '"}' FROM b
UNION ALL SELECT 'd' || id || '.md', 2, 0, body, '{"source": "d' || id || '.md"}' FROM b
UNION ALL SELECT 'd' || id || '.md', 3, 0, 'Document: d' || id || '.md' || chr(10) || 'MIME: text/markdown' || chr(10) || 'Estimated tokens: ' || greatest(1, strlen(body) // 3) || chr(10) || 'Frontmatter: lang=' || lang || chr(10) || 'Outline:' || chr(10) || '  # Doc ' || id || chr(10) || '  ## Size',
  '{"source": "d' || id || '.md", "lang": "' || lang || '"}' FROM b"""
)
def markdown_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A Markdown file for each document, with front matter, two sections and a link."""
    docs = _markdown(spark, sf_dir)
    return chunk_documents(docs, keep=("name",)).select("name", "tier", "chunk_index", "content", "meta")


def _markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _read(spark, sf_dir, "documents").withColumn("id", F.col("doc_id"))
    body = F.concat(
        F.lit("---\nlang: "), "lang", F.lit("\n---\n# Doc "), "id", F.lit("\n\nfrom "), "source", F.lit(" [next](d"), F.col("id") + 1, F.lit(".md#top)\n\n## Size\n\n"), F.octet_length(F.coalesce("text", F.lit(""))), F.lit(" bytes\n")
    )
    return _documents(d.where(F.col("id").isNotNull()), "text/markdown", "d%d.md", body)


@query("""SELECT 'made:///d' || doc_id || '.md' AS file_uri, 'made:///d' || (doc_id + 1) || '.md#top' AS dst_uri, 'made:///d' || (doc_id + 1) || '.md' AS dst_uri_norm, 'LINKS_TO' AS edge_type, '{"label": "next"}' AS meta FROM documents""")
def markdown_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk_edges(_markdown(spark, sf_dir)).select("file_uri", "dst_uri", "dst_uri_norm", "edge_type", "meta")


def _code_sql(suffix: str, first: str, second: str, labels: tuple[str, str], listed: str, mime: str) -> str:
    """SQL for sources of two blocks of three and one lines with a preamble before them."""
    name = f"'p' || id || '{suffix}'"
    head = lambda label, lines: f"'File: ' || {name} || chr(10) || 'Entity: ' || {label} || chr(10) || 'Lines: {lines}' || chr(10) || 'Code:' || chr(10)"
    whole = f"'use all;' || chr(10) || chr(10) || {first} || chr(10) || chr(10) || {second} || chr(10)"
    rows = [
        (1, 0, f"{head(_literal('(module preamble) (preamble)'), '1-1')} || 'use all;'"),
        (1, 1, f"{head(labels[0], '3-5')} || {first}"),
        (1, 2, f"{head(labels[1], '7-7')} || {second}"),
        (2, 0, whole),
        (3, 0, f"'File: ' || {name} || chr(10) || 'MIME: {mime}' || chr(10) || 'Estimated tokens: ' || greatest(1, strlen({whole}) // 3) || chr(10) || 'Lines: 7' || chr(10) || {listed}"),
    ]
    return "WITH p AS (SELECT p_partkey AS id, p_size AS size FROM part) " + " UNION ALL ".join(f"SELECT {name} AS name, {t} AS tier, CAST({i} AS BIGINT) AS chunk_index, {c} AS content FROM p" for t, i, c in rows)


def _literal(x: str) -> str:
    return f"'{x}'"


def _code(spark: SparkSession, sf_dir: str, mime: str, name: str, first, second) -> DataFrame:
    parts = _read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), "p_size")
    parts = parts.repartition(4 * spark.sparkContext.defaultParallelism, "id")  # a small file of rows that grow to sources
    docs = _documents(parts, mime, name, F.concat(F.lit("use all;\n\n"), first, F.lit("\n\n"), second, F.lit("\n")))
    return chunk_documents(docs, keep=("name",)).select("name", "tier", "chunk_index", "content")


@query(
    _code_sql(
        ".rs", "'pub struct P' || id || '<T> {' || chr(10) || '    size: [u8; ' || size || '],' || chr(10) || '}'", "'pub(crate) async fn go' || id || '() {}'", ("'P' || id || ' (struct)'", "'go' || id || ' (fn)'"), "'Items: struct P' || id || ', fn go' || id", "text/x-rust"
    )
)
def rust_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A Rust source for each part."""
    first = F.concat(F.lit("pub struct P"), "id", F.lit("<T> {\n    size: [u8; "), "p_size", F.lit("],\n}"))
    return _code(spark, sf_dir, "text/x-rust", "p%d.rs", first, F.concat(F.lit("pub(crate) async fn go"), "id", F.lit("() {}")))


@query(
    _code_sql(
        ".ts", "'export const p' || id || ' = {' || chr(10) || '  size: ' || size || ',' || chr(10) || '};'", "'export default async function go' || id || '() {}'", ("'p' || id || ' (const)'", "'go' || id || ' (function)'"), "'Symbols: const p' || id || ', function go' || id", "text/typescript"
    )
)
def script_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A script for each part."""
    first = F.concat(F.lit("export const p"), "id", F.lit(" = {\n  size: "), "p_size", F.lit(",\n};"))
    return _code(spark, sf_dir, "text/typescript", "p%d.ts", first, F.concat(F.lit("export default async function go"), "id", F.lit("() {}")))


@query(
    r"""WITH l AS (SELECT 'doc://' || doc_id AS file_uri, unnest(string_split(text, chr(10))) AS content, unnest(range(0, len(string_split(text, chr(10))))) AS line FROM documents),
k AS (SELECT *, regexp_matches(content, '^[A-M]') AS is_decl, max(line) OVER (PARTITION BY file_uri) AS last FROM l)
SELECT file_uri, CAST(line AS INTEGER) AS start, CAST(coalesce(lead(line) OVER (PARTITION BY file_uri ORDER BY line), last + 1) AS INTEGER) AS stop FROM k WHERE is_decl"""
)
def declaration_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that begin with a letter up to M open a block."""
    files = tables.document_files(_read(spark, sf_dir, "documents"))
    lines = files.select("file_uri", F.posexplode(F.split("content", "\n")).alias("line", "content"))
    return metadata.declaration_blocks(lines.select("file_uri", "line", F.regexp_like("content", F.lit("^[A-M]")).alias("is_decl")))


# --- scores


SCORING = f"""{COHERENCE},
chunks AS (SELECT vec_id AS chunk_id, CAST(label AS BIGINT) AS file_id, CAST(vec_id % 3 + 1 AS INTEGER) AS tier, text AS content, CAST(greatest(1, strlen(text) // 3) AS BIGINT) AS token_count, doc_id IN (SELECT doc_id FROM labels) AS known FROM embeddings JOIN documents ON doc_id = vec_id)
{CHECKS[len(CHUNKS) :]}, flagged AS (SELECT chunk_id, known, structural / 100.0::DOUBLE AS s, coherence AS c, structural <= {fixed.STRUCTURAL_THRESHOLD} OR coalesce(coherence < {fixed.COHERENCE_THRESHOLD}, false) AS f FROM scored JOIN coh USING (chunk_id))"""


def _scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as chunks of their vectors; those that are labelled have a score of 0.5."""
    docs = _read(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("text").alias("content"))
    known = _read(spark, sf_dir, "labels").select(F.col("doc_id").alias("chunk_id"), F.lit(0.5).alias("structural_score")).distinct()
    rows = _vectors(spark, sf_dir).select("chunk_id", "file_id", "tier").join(docs, "chunk_id").join(known, "chunk_id", "left")
    return rows.select("chunk_id", "file_id", "tier", "content", text.count_tokens(F.col("content")).alias("token_count"), "structural_score", F.lit(None).cast("double").alias("coherence_score"), F.lit(False).alias("is_flagged"))


def _score(spark: SparkSession, sf_dir: str, rescore: bool) -> DataFrame:
    done = quality.score_all(_scoring(spark, sf_dir), _vectors(spark, sf_dir), rescore)
    return done.select("chunk_id", "structural_score", F.round("coherence_score", 6).alias("coherence_score"), "is_flagged")


@query(f"WITH {SCORING} SELECT chunk_id, CASE WHEN known THEN 0.5::DOUBLE ELSE s END AS structural_score, CASE WHEN NOT known THEN c END AS coherence_score, NOT known AND f AS is_flagged FROM flagged")
def score_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only what has no score yet is scored."""
    return _score(spark, sf_dir, False)


@query(f"WITH {SCORING} SELECT chunk_id, s AS structural_score, c AS coherence_score, f AS is_flagged FROM flagged")
def rescore_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _score(spark, sf_dir, True)


@query(f"WITH {SCORING} SELECT chunk_id, tier FROM scored WHERE NOT known")
def unscored_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.unscored(_scoring(spark, sf_dir)).select("chunk_id", "tier")


@query(
    f"""WITH {CATALOG}, f AS (SELECT DISTINCT file_uri, mime_type, chunker_method FROM made WHERE is_flagged), k(key, method) AS (VALUES {_values(list(fixed.METHODS.items()))})
SELECT count(DISTINCT file_uri) - count(DISTINCT file_uri) FILTER (chunker_method IS DISTINCT FROM coalesce(method, 'generic/v1')) AS skipped FROM f LEFT JOIN k ON mime_type = key"""
)
def drift_skipped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagged files whose method is the current one."""
    flagged = quality.flagged_files(*_catalog(spark, sf_dir))
    return quality.drift_skipped(quality.drifted_files(flagged), flagged)


# --- maintenance


@query(
    f"""WITH {STATES}, a AS (SELECT CASE WHEN s.content_hash IS NULL THEN 'PROCESS' WHEN NOT has_pending AND l.modified_at = s.modified_at THEN 'SKIP_MTIME' WHEN NOT has_pending AND l.content_hash = s.content_hash THEN 'SKIP_HASH' ELSE 'PROCESS' END AS action
FROM listed l LEFT JOIN stored s USING (file_uri)) SELECT action, count(*) AS n FROM a GROUP BY 1"""
)
def action_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maintenance.action_counts(maintenance.change_detection(*_states(spark, sf_dir)))


UPDATED = """about AS (SELECT doc_id, min(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY 1),
state AS (SELECT doc_id AS chunk_id, CASE WHEN quality = 0 THEN text || ' quite fresh words' ELSE text END AS text FROM documents LEFT JOIN about USING (doc_id) WHERE coalesce(quality, 1) = 0 OR coalesce(toxic, 0) = 0),
toks AS (SELECT chunk_id, list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda w: w <> '') AS ts FROM state), placed AS (SELECT chunk_id, unnest(ts) AS term FROM toks)"""


def _updated_index(spark: SparkSession, sf_dir: str) -> bm25.TextIndex:
    """The documents' index after the toxic ones left and those of quality 0 changed (and came back, if they are both)."""
    docs = _read(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("text").alias("content"))
    about = _read(spark, sf_dir, "labels").groupBy(F.col("doc_id").alias("chunk_id")).agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic"))
    changed = docs.join(about.where("quality = 0"), "chunk_id").select("chunk_id", F.concat("content", F.lit(" quite fresh words")).alias("content"))
    return bm25.update_index(bm25.build_index(docs, "plain"), changed, about.where("toxic = 1").select("chunk_id"))


@query(f"WITH {UPDATED} SELECT chunk_id, term, count(*) AS tf FROM placed GROUP BY 1, 2")
def update_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _updated_index(spark, sf_dir).postings.select("chunk_id", "term", "tf")


@query(f"WITH {UPDATED} SELECT chunk_id, CAST(len(ts) AS BIGINT) AS dl FROM toks")
def update_index_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _updated_index(spark, sf_dir).lengths


def _owned(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Documents with two chunks each, a link from every first chunk and a vector for every second one."""
    f = tables.document_files(_read(spark, sf_dir, "documents"))
    chunks = f.select("file_id", F.explode(F.array(F.col("file_id") * 2, F.col("file_id") * 2 + 1)).alias("chunk_id"))
    return f, chunks, chunks.where("chunk_id % 2 = 0").select(F.col("chunk_id").alias("src_chunk")), chunks.where("chunk_id % 2 = 1").select("chunk_id")


KEPT = "kept AS (SELECT doc_id FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 0))"


@query(f"WITH {KEPT} SELECT 'files' AS part, doc_id AS id FROM kept UNION ALL SELECT 'chunks', doc_id * 2 + unnest([0, 1]) FROM kept UNION ALL SELECT 'edges', doc_id * 2 FROM kept UNION ALL SELECT 'vectors', doc_id * 2 + 1 FROM kept")
def delete_files_everywhere(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All four tables without the files labelled toxic or not labelled."""
    f, chunks, edges, vectors = _owned(spark, sf_dir)
    keep = _read(spark, sf_dir, "labels").where("toxic = 0").select(F.concat(F.lit("doc://"), "doc_id").alias("file_uri"))
    left = maintenance.delete_files(f, chunks, edges, vectors, f.select("file_uri").join(keep, "file_uri", "left_anti"))
    return _parts(left)


def _parts(left: tuple[DataFrame, ...]) -> DataFrame:
    names = {"files": "file_id", "chunks": "chunk_id", "edges": "src_chunk", "vectors": "chunk_id"}
    parts = [df.select(F.lit(part).alias("part"), F.col(key).alias("id")) for df, (part, key) in zip(left, names.items(), strict=True)]
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out


@query("SELECT part, CAST(0 AS BIGINT) AS n FROM (VALUES ('files'), ('chunks'), ('edges'), ('vectors')) t(part)")
def delete_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = _parts(maintenance.delete_all(*_owned(spark, sf_dir))).groupBy("part").agg(F.count("*").alias("n"))
    names = spark.createDataFrame([(x,) for x in ("files", "chunks", "edges", "vectors")], "part string")
    return names.join(left, "part", "left").na.fill(0, ["n"])


@query("SELECT doc_id * 2 + k AS chunk_id, CASE WHEN k = 1 AND doc_id IN (SELECT vec_id FROM embeddings) THEN doc_id END AS lance_id FROM (SELECT doc_id, unnest([0, 1]) AS k FROM documents)")
def mark_embedded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Second chunks are embedded by the vector of their document's id, if there is one."""
    _, chunks, _, _ = _owned(spark, sf_dir)
    vectors = _read(spark, sf_dir, "embeddings").select((F.col("vec_id") * 2 + 1).alias("chunk_id"), F.col("vec_id").alias("id"))
    return maintenance.mark_embedded(chunks.withColumn("lance_id", F.lit(-1).cast("long")), vectors).select("chunk_id", "lance_id")


@query("SELECT vec_id AS id, label FROM embeddings WHERE vec_id NOT IN (SELECT c_custkey FROM customer) UNION ALL SELECT DISTINCT c_custkey, -1 FROM customer")
def append_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A new vector replaces the one of its id."""
    old = _read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").cast("int").alias("label"))
    new = _read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.lit(-1).alias("label"))
    return maintenance.append_vectors(old, new.unionByName(new))


# --- searches


@query(
    f"""WITH {CHANNELS}, t AS (SELECT *, max((tier < 3)::INT) OVER (PARTITION BY query_id, file_uri) AS finer FROM ranked), u AS (SELECT *, row_number() OVER (PARTITION BY query_id, file_uri ORDER BY fused_rank) AS n FROM t WHERE tier < 3 OR finer = 0),
w AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY fused_rank) AS f FROM u WHERE n <= 3) SELECT query_id, file_uri, CAST(min(f) AS INTEGER) AS first_rank FROM w WHERE f <= 10 GROUP BY 1, 2"""
)
def unique_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fusion.unique_paths(fusion.finish(_fused(spark, sf_dir), "fused_rank", fusion.SearchOptions(top_k=10), fused=True))


ENDINGS = "named AS (SELECT page_id AS chunk_id, url || CASE page_id % 5 WHEN 0 THEN '.TXT' WHEN 1 THEN '/a.b/.txt' WHEN 2 THEN '/x.tar.txt' WHEN 3 THEN '.md' ELSE '' END AS file_uri FROM pages)"


@query(rf"WITH {ENDINGS} SELECT chunk_id, file_uri FROM named WHERE lower(regexp_extract(file_uri, '[^/\\]\.([^./\\]+)$', 1)) = 'txt'")
def extension_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits of one extension, in capitals or not; a name of which it is all has none."""
    k = F.col("page_id") % 5
    ending = F.when(k == 0, ".TXT").when(k == 1, "/a.b/.txt").when(k == 2, "/x.tar.txt").when(k == 3, ".md").otherwise("")
    hits = _read(spark, sf_dir, "pages").select(F.col("page_id").alias("chunk_id"), F.concat("url", ending).alias("file_uri"), F.lit(1).alias("tier"))
    return fusion.restrict(hits, 1, "..TXT").select("chunk_id", "file_uri")


@query(
    f"""WITH {HREFS}, one AS (SELECT min(url) AS u FROM pages), c AS (SELECT page_id, url, CAST(page_id % 3 + 1 AS INTEGER) AS tier, page_id % 50 AS tokens FROM pages)
SELECT 'detail' AS part, 't' || tier AS a, CAST(CASE WHEN tier = 1 THEN tokens ELSE 0 END AS VARCHAR) AS b FROM c, one WHERE url = u UNION ALL SELECT 'summary', 'about ' || page_id, '' FROM c, one WHERE url = u AND tier = 3
UNION ALL SELECT DISTINCT 'outgoing', dst_uri, 'LINKS_TO' FROM edges, one WHERE url = u UNION ALL SELECT DISTINCT 'incoming', url, 'LINKS_TO' FROM edges, one WHERE dst_uri = u"""
)
def explain_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detail, summary and links of the first page."""
    edges, _, files = _edges(spark, sf_dir)
    pages, tier = _read(spark, sf_dir, "pages"), (F.col("page_id") % 3 + 1).cast("int")
    chunks = pages.select(F.col("page_id").alias("chunk_id"), F.col("page_id").alias("file_id"), tier.alias("tier"), F.lit(0).alias("chunk_index"), (F.col("page_id") % 50).alias("token_count"), F.concat(F.lit("about "), "page_id").alias("content"))
    found = metadata.explain_file(files, chunks, edges, pages.agg(F.min("url")).first()[0])
    detail = found["detail"].select(F.lit("detail").alias("part"), F.when(F.col("t1") > 0, "t1").when(F.col("t2") > 0, "t2").otherwise("t3").alias("a"), F.col("t1_tokens").cast("string").alias("b"))
    summary = found["summary"].select(F.lit("summary").alias("part"), F.col("summary").alias("a"), F.lit("").alias("b"))
    links = found["outgoing"].select(F.lit("outgoing").alias("part"), F.col("dst_uri").alias("a"), F.col("edge_type").alias("b")).unionByName(found["incoming"].select(F.lit("incoming").alias("part"), F.col("src_uri").alias("a"), F.col("edge_type").alias("b")))
    return detail.unionByName(summary).unionByName(links)


# --- display


@query(
    r"""WITH f AS (SELECT page_id, list_filter(regexp_split_to_array(url, '[/\\]'), lambda x: x <> '') AS ps, list_filter(string_split(html, chr(10)), lambda x: trim(x, ' ' || chr(9) || chr(13)) <> '') AS ls FROM pages),
g AS (SELECT page_id, array_to_string(ps[greatest(len(ps) - 1, 1):], '/') AS label, coalesce(trim(ls[1], ' ' || chr(9) || chr(13)), '') AS line FROM f)
SELECT page_id, CASE WHEN length(label) > 40 THEN left(label, 19) || '…' || right(label, 19) ELSE label END AS source, CASE WHEN length(line) > 60 THEN left(line, 60) || '…' ELSE line END AS preview FROM g"""
)
def result_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _read(spark, sf_dir, "pages")
    return p.select("page_id", text.source_label(F.col("url")).alias("source"), text.preview(F.col("html")).alias("preview"))


# --- streams


@query("SELECT 'conv://' || conv_id || '/' || turn AS file_uri, 'text/plain' AS mime_type, CAST(strlen(coalesce(text, '')) AS BIGINT) AS size_bytes FROM conversations WHERE role <> 'system' AND turn <> 1")
def stream_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as a stream of JSON lines into a store, to its end; the store's files."""
    folder = f"{staging_root(spark)}/stream-{uuid.uuid4().hex[:12]}"
    _lines(spark, sf_dir).coalesce(8).write.text(f"{folder}/lines")
    store = Store(spark, f"{folder}/store")
    start_ingest(spark, f"{folder}/lines", Indexer(store, analyzer="plain"), f"{folder}/checkpoint", f"{folder}/bad").awaitTermination()
    return store.table("files").select("file_uri", "mime_type", "size_bytes")
