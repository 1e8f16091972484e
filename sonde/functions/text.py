"""Column expressions on names, URIs and texts; all run in the JVM."""

from __future__ import annotations

import os

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed


def _map(values: dict[str, str]) -> Column:
    return F.create_map(*(F.lit(x) for kv in values.items() for x in kv))


def stable_id(uri: Column, tier: Column, index: Column) -> Column:
    """60 bits of the SHA-256 of ``uri:tier:index``; the same for the same chunk in any run."""
    key = F.concat_ws(":", uri, tier.cast("string"), index.cast("string"))
    return F.conv(F.substring(F.sha2(key, 256), 1, 15), 16, 10).cast("long")


def strip(text: Column) -> Column:
    """Without white space at either end."""
    return F.regexp_replace(text, r"(?U)\A\s+|\s+\z", "")


def last_segment(uri: Column) -> Column:
    """The last non-empty part between slashes of either kind."""
    return F.element_at(F.filter(F.split(uri, r"[/\\]"), lambda x: x != ""), -1)


def file_stem(uri: Column) -> Column:
    name = F.coalesce(last_segment(uri), F.lit(""))
    stem = F.regexp_extract(name, r"^(.+)\.[^.]*$", 1)
    return F.when(stem == "", name).otherwise(stem)


def extension(name: Column) -> Column:
    """The lower-cased suffix with its dot; empty for none, and for names that only begin with a dot."""
    return F.lower(F.regexp_extract(name, r"[^/\\](\.[^./\\]+)$", 1))


def matches_ext(uri: Column, wanted: str) -> Column:
    plain = wanted.lstrip(".").lower()
    return extension(uri) == "." + plain


def mime_for(name: Column) -> Column:
    return F.coalesce(_map(fixed.MIME_BY_EXT)[extension(name)], F.lit(fixed.DEFAULT_MIME))


def normal_mime(mime: Column) -> Column:
    """What stands before a semicolon, trimmed, in lower case."""
    return F.lower(strip(F.substring_index(mime, ";", 1)))


def method_for(mime: Column, methods: dict[str, str] | None = None) -> Column:
    known = _map(methods if methods is not None else fixed.METHODS)
    return F.coalesce(known[mime], known[F.lit("_default")], F.lit(fixed.LAST_METHOD))


def parser_for(mime: Column) -> Column:
    """The name of the chunker of a normalised MIME type."""
    sheet, doc = f"{fixed.OOXML}.spreadsheetml.sheet", f"{fixed.OOXML}.wordprocessingml.document"
    return (
        F.when(mime.isin("application/pdf", doc, "application/msword"), "binary")
        .when(mime.isin(sheet, "application/vnd.ms-excel"), "xlsx")
        .when(mime == "text/csv", "csv")
        .when(mime == "text/markdown", "markdown")
        .when(mime == "text/x-rust", "rust")
        .when(mime.isin("text/typescript", "text/javascript", "application/javascript"), "script")
        .when(mime.startswith("text/"), "plaintext")
        .otherwise("binary")
    )


def keeps_path(path: Column, size: Column | None = None, more_dirs: tuple[str, ...] = ()) -> Column:
    """Whether the walk would list ``path`` (relative to its root, slashes of either kind)."""
    parts = F.split(path, r"[/\\]")
    dirs, name = F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), F.element_at(parts, -1)
    barred = F.arrays_overlap(dirs, F.array(*(F.lit(d) for d in [*fixed.IGNORED_DIRS, *more_dirs])))
    for only, below in fixed.ONLY_BELOW.items():
        barred |= F.exists(F.transform(dirs, lambda d, i: (d == only) & ~F.coalesce((F.get(dirs, i - 1) == below), F.lit(False))), lambda x: x)
    named = name.isin(fixed.IGNORED_NAMES)
    for prefix in fixed.IGNORED_PREFIXES:
        named |= name.startswith(prefix)
    ok = ~barred & ~named & ~extension(name).isin(fixed.IGNORED_EXTS)
    return ok if size is None else ok & (size <= fixed.MAX_FILE_SIZE)


# --- tokens


def count_tokens(text: Column) -> Column:
    """The byte estimate of a token count."""
    return F.greatest(F.lit(1), F.floor(F.octet_length(text) / fixed.BYTES_PER_TOKEN)).cast("long")


#: Items that one step of a fold takes, so that arrays grow by blocks.
BLOCK = 256


def budget_segments(text: Column, budget: int) -> Column:
    """Consecutive pieces of at most ``budget`` tokens that join to the text, never cut inside a character; blank text has none.

    In time linear in the text: pieces are slices of its bytes, which are taken out of the row once.
    """
    n = budget * fixed.BYTES_PER_TOKEN

    def pieces(whole: Column) -> Column:
        raw, size = whole["raw"], F.octet_length(whole["raw"])
        most = ((size - 1) / (n - 3)).cast("int") + 1
        inside = lambda p: F.hex(F.substring(raw, p + 1, F.lit(1))).between("80", "BF")
        back = lambda p: F.when(~inside(p), p).when(~inside(p - 1), p - 1).when(~inside(p - 2), p - 2).otherwise(p - 3)
        single = F.transform(F.sequence(F.lit(0), ((size - 1) / n).cast("int")), lambda i: F.substring(raw, i * n + 1, F.lit(n)).cast("string"))

        def further(cuts: Column, _: Column) -> Column:
            at = F.element_at(cuts, -1)
            return F.when(at >= size, cuts).otherwise(F.concat(cuts, F.array(F.when(at + n >= size, size).otherwise(back(at + n)))))

        def block(state: Column, _: Column) -> Column:
            cuts = F.aggregate(F.sequence(F.lit(1), F.least(F.lit(BLOCK), most)), F.array(state["at"]), further)
            return F.struct(F.element_at(cuts, -1).alias("at"), F.concat(state["done"], F.array(F.slice(cuts, 2, BLOCK))).alias("done"))

        start = F.struct(F.lit(0).alias("at"), F.array().cast("array<array<int>>").alias("done"))
        ends = F.aggregate(F.sequence(F.lit(0), ((size - 1) / ((n - 3) * BLOCK)).cast("int")), start, block, lambda s: F.flatten(s["done"]))
        cut = lambda ends: F.transform(ends, lambda e, i: F.substring(raw, F.coalesce(F.get(ends, i - 1), F.lit(0)) + 1, e - F.coalesce(F.get(ends, i - 1), F.lit(0))).cast("string"))
        return F.when(whole["plain"], single).otherwise(F.get(F.transform(F.array(ends), cut), 0))

    whole = F.array(F.struct(text.cast("binary").alias("raw"), (F.octet_length(text) == F.length(text)).alias("plain")))
    blank = ~F.regexp_like(text, F.lit(r"(?U)\S"))
    return F.when(blank, F.array().cast("array<string>")).when(F.octet_length(text) <= n, F.array(text)).otherwise(F.get(F.transform(whole, pieces), 0))


def name_tokens(text: Column, segment: bool | None = None) -> Column:
    """Lower-cased words of three letters or more of an identifier, a name or a query: capitals
    split words, c++ and its like are spelt out, all but ASCII letters and digits separates.

    Without ``segment`` (None: as SONDE_SEGMENT says, on unless it is 0, false or off) capitals split nothing.
    """
    if segment is None:
        segment = os.environ.get("SONDE_SEGMENT", "1").lower() not in ("0", "false", "off")
    spaced = F.regexp_replace(F.regexp_replace(text, r"(?<=[\p{Ll}0-9])(?=\p{Lu})", " "), r"(?<=\p{Lu})(?=\p{Lu}\p{Ll})", " ") if segment else text
    plain = F.lower(spaced)
    for symbol, word in fixed.SYMBOLS.items():
        plain = F.replace(plain, F.lit(symbol), F.lit(word))
    return F.filter(F.split(plain, "[^a-z0-9]+"), lambda t: F.length(t) >= 3)


def token_matches(a: Column, b: Column) -> Column:
    """Equal, or both of five letters and more and equal in the first five."""
    return (a == b) | ((F.length(a) >= 5) & (F.length(b) >= 5) & (F.left(a, F.lit(5)) == F.left(b, F.lit(5))))


def path_coverage(uri: Column, query_tokens: Column) -> Column:
    """The share of the file stem's tokens that some query token matches; 0 without any."""
    tokens = name_tokens(file_stem(uri))
    hit = F.filter(tokens, lambda t: F.exists(query_tokens, lambda q: token_matches(t, q)))
    return F.when((F.size(tokens) == 0) | (F.size(query_tokens) == 0), 0.0).otherwise(F.size(hit) / F.size(tokens))


def query_words(query: Column) -> Column:
    """The words of a full-text query: quotes taken out, stop words left out unless all are."""
    words = F.filter(F.transform(F.split(query, r"(?U)\s+"), lambda w: F.replace(w, F.lit('"'), F.lit(""))), lambda w: w != "")
    told = F.filter(words, lambda w: ~F.lower(w).isin(fixed.STOP_WORDS))
    return F.when(F.size(told) == 0, words).otherwise(told)


def match_expression(query: Column) -> Column:
    """The words as quoted phrases joined by OR; a pair of quotes if there are none."""
    words = query_words(query)
    quoted = F.array_join(F.transform(words, lambda w: F.concat(F.lit('"'), w, F.lit('"'))), " OR ")
    return F.when(F.size(words) == 0, '""').otherwise(quoted)


# --- documents


def front_matter(text: Column) -> tuple[Column, Column]:
    """(array of key/value structs in document order, the rest of the text)."""
    whole = r"(?s)\A---\n(.*?)\n---"
    found = F.regexp_like(text, F.lit(whole))
    inner = F.regexp_extract(text, whole, 1)
    pairs = F.transform(
        F.filter(F.split(inner, "\n"), lambda x: F.instr(x, ":") > 0),
        lambda x: F.struct(strip(F.substring_index(x, ":", 1)).alias("k"), strip(F.substring(x, F.instr(x, ":") + 1, F.length(x))).alias("v")),
    )
    pairs = F.filter(pairs, lambda p: p["k"] != "")
    rest = F.regexp_replace(text, whole + r"[\r\n]*", "")
    return F.when(found, pairs).otherwise(F.array().cast("array<struct<k:string,v:string>>")), F.when(found, rest).otherwise(text)


def is_heading(line: Column) -> Column:
    return F.regexp_like(line, F.lit(r"^\s*#{1,6} "))


def text_lines(text: Column) -> Column:
    """Lines, a last newline ending the last; none of an empty text."""
    body = F.regexp_replace(text, r"\n\z", "")
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.transform(F.split(body, "\n", -1), lambda x: F.regexp_replace(x, r"\r\z", "")))


def summary(name: Column, mime: Column, text: Column) -> Column:
    """The outline of a plain text."""

    def outline(lines: Column) -> Column:
        heads = F.array_join(F.slice(F.transform(F.filter(lines, is_heading), strip), 1, 12), "; ")
        return F.concat_ws(
            "\n",
            F.concat(F.lit("Document: "), name),
            F.concat(F.lit("MIME: "), mime),
            F.concat(F.lit("Estimated tokens: "), count_tokens(text).cast("string")),
            F.concat(F.lit("Lines: "), F.size(lines).cast("string")),
            F.concat(F.lit("Key headings: "), F.when(heads == "", "(none detected)").otherwise(heads)),
        )

    return F.get(F.transform(F.array(text_lines(text)), outline), 0)


def binary_note(mime: Column, name: Column, size: Column) -> Column:
    return F.format_string("Unsupported MIME type: %s. File: %s. Size: %d bytes. No text content was extracted.", mime, name, size)


def inline_links(text: Column) -> Column:
    """(label, target) structs of inline links to other documents; images, anchors and absolute URLs aside."""
    labels = F.regexp_extract_all(text, F.lit(r"(?<!!)\[([^\]\[]*)\]\(([^()\s]+)[^()]*\)"), F.lit(1))
    targets = F.regexp_extract_all(text, F.lit(r"(?<!!)\[([^\]\[]*)\]\(([^()\s]+)[^()]*\)"), F.lit(2))
    both = F.arrays_zip(labels.alias("label"), targets.alias("target"))
    return F.filter(both, lambda x: ~x["target"].contains("://") & ~x["target"].startswith("#"))


def join_uri(uri: Column, target: Column) -> Column:
    """``target`` beside ``uri``: its parent and the target as written."""
    parent = F.regexp_extract(uri, r"^(.*)/[^/]*$", 1)
    return F.when(target.startswith("/") | (parent == ""), target).otherwise(F.concat(parent, F.lit("/"), target))


def resolve_uri(uri: Column) -> Column:
    """A joined URI without ``./``, ``x/../`` and anchor."""
    plain = F.regexp_replace(F.regexp_replace(uri, r"#.*$", ""), r"/(\./)+", "/")
    for _ in range(8):
        plain = F.regexp_replace(plain, r"(?<=/)(?!\.\./)[^/]+/\.\./", "")
    return plain


def script_declaration(line: Column) -> tuple[Column, Column]:
    """(kind, name) of a declaration that begins at column 0 of a line; empty strings for none."""
    pattern = r"^(?:export )?(?:default )?(?:async )?(function|class|const|interface|type|enum|let|var) ([\p{L}\p{N}_$]+)"
    kind = F.regexp_extract(line, pattern, 1)
    return F.when(kind == "type", "type_alias").otherwise(kind), F.regexp_extract(line, pattern, 2)


def key_values(headers: Column, values: Column) -> Column:
    """``h: v`` joined by bars; missing values are empty."""
    return F.array_join(F.transform(headers, lambda h, i: F.concat(h, F.lit(": "), F.coalesce(F.get(values, i), F.lit("")))), " | ")


def packed_groups(counts: Column, budget: int) -> Column:
    """The group of each item when groups are filled in order and closed before they exceed the budget."""

    def step(state: Column, n: Column) -> Column:
        new = (state["used"] + n > budget) & state["any"]
        group = F.when(new, state["group"] + 1).otherwise(state["group"])
        used = F.when(new, n).otherwise(state["used"] + n).cast("long")
        return F.struct(F.concat(state["groups"], F.array(group)).alias("groups"), group.alias("group"), used.alias("used"), F.lit(True).alias("any"))

    def block(state: Column, i: Column) -> Column:
        start = F.struct(F.array().cast("array<int>").alias("groups"), *(state[c].alias(c) for c in ("group", "used", "any")))
        items = F.transform(F.slice(counts, i * BLOCK + 1, F.lit(BLOCK)), lambda x: x.cast("long"))
        return F.aggregate(items, start, step, lambda s: F.struct(F.concat(state["done"], F.array(s["groups"])).alias("done"), *(s[c].alias(c) for c in ("group", "used", "any"))))

    start = F.struct(F.array().cast("array<array<int>>").alias("done"), F.lit(0).alias("group"), F.lit(0).cast("long").alias("used"), F.lit(False).alias("any"))
    return F.aggregate(F.sequence(F.lit(0), (F.size(counts) / BLOCK).cast("int")), start, block, lambda s: F.flatten(s["done"]))


# --- display


def display_number(n: Column) -> Column:
    return F.format_number(n, 0)


def display_bytes(n: Column) -> Column:
    """With one place, halves to even."""
    return (
        F.when(n >= 1 << 20, F.format_string("%.1f MiB", F.bround(n / (1 << 20), 1)))
        .when(n >= 1 << 10, F.format_string("%.1f KiB", F.bround(n / (1 << 10), 1)))
        .otherwise(F.format_string("%d B", n))
    )


def display_time(seconds: Column) -> Column:
    """Epoch seconds as UTC minutes (the session's time zone must be UTC)."""
    return F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd HH:mm")


def preview(text: Column, width: int = 60) -> Column:
    """The first line that is not blank, cut."""
    first = F.coalesce(strip(F.get(F.filter(F.split(text, "\n"), lambda x: strip(x) != ""), 0)), F.lit(""))
    return F.when(F.length(first) > width, F.concat(F.left(first, F.lit(width)), F.lit("…"))).otherwise(first)


def source_label(uri: Column, width: int = 40) -> Column:
    """``parent/name``, the middle cut out if it is long."""
    parts = F.filter(F.split(uri, r"[/\\]"), lambda x: x != "")
    label = F.array_join(F.slice(parts, F.greatest(F.size(parts) - 1, F.lit(1)), 2), "/")
    half = (width - 1) // 2
    return F.when(F.length(label) > width, F.concat(F.left(label, F.lit(half)), F.lit("…"), F.right(label, F.lit(half)))).otherwise(label)


def safe_json(text: Column) -> Column:
    """The JSON text, or ``{}`` where it is null or not JSON."""
    return F.when(F.try_parse_json(text).isNotNull(), text).otherwise("{}")


def with_record(meta: Column, record: Column) -> Column:
    """A JSON object with ``record`` (JSON) under the key of that name; unchanged if that is null."""
    inner = F.regexp_extract(safe_json(meta), r"(?s)^\s*\{(.*)\}\s*$", 1)
    joined = F.concat(F.lit("{"), inner, F.when(F.trim(inner) == "", "").otherwise(","), F.lit('"record":'), record, F.lit("}"))
    return F.when(record.isNull(), meta).otherwise(joined)
