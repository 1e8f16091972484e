"""Text for people: result tables, JSON, Markdown, and the reports of the commands."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import display_number, preview, source_label
from ..operators import metadata, quality


def thousands(n: int) -> str:
    return f"{n:,}"


def elapsed(seconds: float) -> str:
    minutes, rest = divmod(int(seconds), 60)
    return f"{minutes} m {rest:02d} s" if minutes else f"{seconds:.1f} s"


def file_link(path: str, label: str | None = None) -> str:
    """A terminal hyperlink."""
    uri = path if "://" in path else "file://" + path.replace("\\", "/").replace(" ", "%20")
    return f"\x1b]8;;{uri}\x1b\\{label or path}\x1b]8;;\x1b\\"


def result_rows(hits: DataFrame) -> DataFrame:
    """query_id, rank, score in percent, tier, source, preview; and the columns other forms need."""
    return hits.select("query_id", F.col("final_rank").alias("rank"), F.col("normalized_score").alias("score"), F.round(F.col("normalized_score") * 100).cast("int").alias("percent"), "tier", source_label(F.col("file_uri")).alias("source"), preview(F.col("content")).alias("preview"), "file_uri", "content").orderBy("query_id", "rank")


def as_table(hits: DataFrame) -> str:
    rows = result_rows(hits).collect()  # at most top_k rows a query
    lines = [f"{r['rank']:>3}  {r['percent']:>3}%  T{r['tier']}  {r['source']:<40}  {r['preview']}" for r in rows]
    paths = list(dict.fromkeys(r["file_uri"] for r in rows))
    return "\n".join([*lines, "", *paths]) if lines else "No results."


def as_json(hits: DataFrame) -> str:
    rows = result_rows(hits).collect()
    return json.dumps([{"rank": r["rank"], "score": r["score"], "tier": r["tier"], "file": r["file_uri"], "content": r["content"]} for r in rows], ensure_ascii=False, indent=2)


def as_markdown(hits: DataFrame) -> str:
    rows = result_rows(hits).collect()
    return "\n\n".join(f"## {r['rank']}. {r['file_uri']}\n\nTier {r['tier']}, score {r['score']:.4f}\n\n{r['content']}" for r in rows)


def render(hits: DataFrame, form: str) -> str:
    return {"json": as_json, "md": as_markdown, "markdown": as_markdown}.get(form, as_table)(hits)


def stats_report(files: DataFrame, chunks: DataFrame, edges: DataFrame) -> str:
    s = metadata.index_stats(files, chunks, edges).first()
    share = metadata.embedded_percent(chunks).first()["percent"]
    lines = [f"{k}: {thousands(s[k])}" for k in ("files", "chunks", "embedded", "edges", "fts_docs", "fts_docs_indexed")] + [f"coverage: {share} %"]
    kinds = metadata.mime_histogram(files).select("mime_type", display_number(F.col("n")).alias("n"), F.col("n").alias("k")).orderBy(F.desc("k"), "mime_type").collect()
    return "\n".join([*lines, *(f"  {r['mime_type']}: {r['n']}" for r in kinds)])


def explain_report(parts: dict[str, DataFrame]) -> str:
    d = parts["detail"].first()
    head = [f"{k}: {d[k]}" for k in ("file_uri", "mime_type", "size_bytes", "t1", "t2", "t3", "t1_tokens")]
    summary = parts["summary"].first()
    out = [f"-> {r['edge_type']} {r['dst_uri']}" for r in parts["outgoing"].collect()]
    into = [f"<- {r['edge_type']} {r['src_uri']}" for r in parts["incoming"].collect()]
    return "\n".join([*head, "", summary["summary"] if summary else "(no summary)", "", *out, *into])


def scores_report(chunks: DataFrame, files: DataFrame, limit: int, flagged: bool = False, tier: int | None = None) -> str:
    worst = quality.worst_first(metadata.chunk_listing(chunks, files.drop("mime_type").withColumn("mime_type", F.lit(""))), limit, flagged, tier) if "file_uri" not in chunks.columns else quality.worst_first(chunks, limit, flagged, tier)
    rows = worst.select("structural_score", "coherence_score", "is_flagged", "tier", source_label(F.col("file_uri")).alias("source"), preview(F.col("content")).alias("preview")).collect()
    show = lambda x: "  -  " if x is None else f"{x:.3f}"
    return "\n".join(f"{show(r['structural_score'])}  {show(r['coherence_score'])}  {'!' if r['is_flagged'] else ' '}  T{r['tier']}  {r['source']}  {r['preview']}" for r in rows)
