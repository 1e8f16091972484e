import hashlib
import random

import pytest

from sonde.llm import chat_format as cf
from sonde.llm import gif_media as gm

PARTS = ["<", "|", "\\", "im_end", "im_start", "|>", "<|", "<|im_end|>", "<|im_start|>", "\n", "a", "<\\|im_end|>", " ", "é"]


def test_every_turn_round_trips():
    for seed in range(20_000):
        r = random.Random(seed)
        text, role = ("".join(r.choice(PARTS) for _ in range(r.randint(0, n))) for n in (8, 3))
        segment, lo, hi = cf.render_turn(role, text)
        whole = segment + cf.render_turn("user", "x")[0]
        assert [t[:2] for t in cf.parse(whole)] == [(role, text), ("user", "x")]
        assert cf.unescape(segment[lo:hi]) == text


def test_plain_text_is_not_touched_and_bad_text_is_refused():
    assert cf.render_turn("user", "a < b | c")[0] == "<|im_start|>user\na < b | c<|im_end|>\n"
    for bad in ("x", "<|im_start|>user\nno end", "<|im_start|>u\na<|im_end|>", "<|im_start|>u\na<|im_start|>b<|im_end|>\n"):
        with pytest.raises(cf.GrammarError):
            list(cf.parse(bad))


def test_conversations_digest(spark):
    rows = [(2, 1, "assistant", "b<|im_end|>"), (2, 0, "user", "a"), (2, 0, "user", "a"), (None, 0, None, None), (3, None, "assistant", ""), (3, 5, "assistant", "é\\<|")]
    df = spark.createDataFrame([(*r, "z") for r in rows], "conv_id long, turn long, role string, text string, segment string")
    got = {r["conv_id"]: r for r in cf.digest_conversations(cf.format_conversations(df)).collect()}
    want = {2: [("user", "a"), ("user", "a"), ("assistant", "b<|im_end|>")], None: [("", "")], 3: [("assistant", ""), ("assistant", "é\\<|")]}
    assert set(got) == set(want)
    for k, turns in want.items():
        learnt = "".join(t for r, t in turns if r == "assistant")
        assert got[k]["n_turns"] == len(turns) and got[k]["loss_chars"] == len(learnt)
        assert got[k]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
        assert got[k]["loss_sha256"] == hashlib.sha256(learnt.encode()).hexdigest()
        assert got[k]["formatted_chars"] == sum(len(cf.render_turn(r, t)[0]) for r, t in turns)
    assert cf.digest_conversations(cf.format_conversations(df.limit(0))).collect() == []


def lzw_encode(samples, least, deferred=False):
    """The usual encoder, one symbol at a time."""
    clear, bits, n = 1 << least, 0, 0
    table, free, width, word = {bytes([i]): i for i in range(clear)}, clear + 2, least + 1, b""

    def put(code):
        nonlocal bits, n
        bits |= code << n
        n += width

    put(clear)
    for s in samples:
        longer = word + bytes([s])
        if longer in table:
            word = longer
            continue
        put(table[word])
        if free < 4096:
            table[longer] = free
            free += 1
            width += free - 1 == 1 << width and width < 12
        elif not deferred:
            put(clear)
            table, free, width = {bytes([i]): i for i in range(clear)}, clear + 2, least + 1
        word = bytes([s])
    if word:
        put(table[word])
        width += free < 4096 and free == 1 << width and width < 12
    put(clear + 1)
    return bits.to_bytes((n + 7) // 8, "little")


@pytest.mark.parametrize("seed", range(60))
def test_lzw_streams_with_tables(seed):
    r = random.Random(seed)
    least = r.choice([2, 3, 5, 8])
    kinds, n = r.choice([1, 2, 4, 1 << least]), r.choice([1, 6, 300, 5000, 20_000])
    samples = [r.randrange(min(kinds, 1 << least)) for _ in range(n)]
    assert gm.lzw_decode(lzw_encode(samples, least, seed % 2 == 0), least, n).tolist() == samples


@pytest.mark.parametrize("seed", range(40))
def test_own_streams_are_those_of_the_usual_encoder(seed):
    r = random.Random(seed)
    least = r.choice([2, 3, 5, 8])
    kinds, n = r.choice([1, 2, 4, 1 << least]), r.choice([1, 6, 300, 5000, 20_000])
    samples = [r.randrange(min(kinds, 1 << least)) for _ in range(n)]
    assert gm.lzw_encode(bytes(samples), least) == lzw_encode(samples, least)


@pytest.mark.parametrize("kind", ["text", "random", "periodic", "two", "mixed", "same"])
def test_stored_frames_show_the_payload(kind, monkeypatch):
    r, n = random.Random(kind), 192 * 600
    payload = {
        "text": bytes(r.choice(b"etaoin shrdlu") for _ in range(n)), "random": r.randbytes(n), "periodic": (b"Edingan.lek " * (n // 12 + 1))[:n],
        "two": r.randbytes(192 * 256) * 2, "mixed": r.randbytes(192 * 256) + bytes(192 * 256) + b"a" * (192 * 88), "same": b" " * n,
    }[kind]
    expanded = []
    monkeypatch.setattr(gm, "_expand", lambda codes, least, real=gm._expand: expanded.append((codes > (1 << least) + 1).any()) or real(codes, least))
    data, before, out = gm.encode_gif(payload), None, []
    for f in gm.decode_gif(data):
        before = gm.shown(f.samples.tobytes(), f.palette.tobytes(), f.transparent, before)
        assert before.tolist() == (f.canvas[: f.samples.shape[0]] & 255).ravel().tolist()  # as the decoder composes it
        out.append((before.tobytes(), f.transparent, f.disposal, len(f.palette)))
    assert b"".join(x[0] for x in out) == payload and any(expanded)
    assert [x[1] is not None for x in out] == ([False, True, True] if kind in ("periodic", "same") else [False, kind == "two"] + [False] * (kind != "two"))[: len(out)]
    assert [x[2] for x in out] == ([1, 1, 2] if kind in ("periodic", "same") else [1, 2] if kind == "two" else [2, 2, 2])
    assert (out[0][3] < 256) == (kind not in ("random", "two", "mixed")) and (kind in ("random", "two", "mixed") or len(data) < 0.6 * n)


def gif(frames, width=4, height=4, palette=((255, 0, 0), (0, 255, 0), (0, 0, 255), (9, 9, 9))):
    """frames: (left, top, w, h, samples, disposal, transparent or None, delay, interlaced, local palette)."""
    flat = lambda p: bytes(x for c in p for x in c)
    out = b"GIF89a" + bytes([width, 0, height, 0, 0x81, 0, 0]) + flat(palette)
    for left, top, w, h, samples, disposal, transparent, delay, interlaced, local in frames:
        out += b"\x21\xf9\x04" + bytes([disposal << 2 | (transparent is not None), delay, 0, transparent or 0, 0])
        out += b"\x2c" + bytes([left, 0, top, 0, w, 0, h, 0, (0x40 if interlaced else 0) | (0x81 if local else 0)]) + (flat(local) if local else b"")
        out += b"\x02" + gm._sub_blocks(lzw_encode(samples, 2))
    return out + b"\x3b"


def test_disposal_transparency_palettes_and_times():
    full = (0, 0, 4, 4, [0] * 16)
    spot = lambda disposal, transparent, local=None: (1, 1, 2, 2, [1, 2, 2, 1], disposal, transparent, 7, False, local)
    red, green, blue = 0xFF0000, 0x00FF00, 0x0000FF
    frames = list(gm.decode_gif(gif([(*full, 1, None, 5, False, None), spot(3, 1), spot(2, None), spot(0, 2, ((1, 1, 1), (2, 2, 2), (3, 3, 3), (4, 4, 4)))])))
    assert [f.delay_ms for f in frames] == [50, 70, 70, 70]
    assert frames[0].canvas.tolist() == [[red] * 4] * 4
    assert frames[1].canvas[1:3, 1:3].tolist() == [[red, blue], [blue, red]]  # 1 is transparent
    assert frames[2].canvas[1:3, 1:3].tolist() == [[green, blue], [blue, green]]  # on the restored canvas
    assert frames[3].canvas[1:3, 1:3].tolist() == [[0x020202, -1], [-1, 0x020202]]  # after clearing the spot
    assert gm.colour_histogram(frames[3].canvas)[64] == 2 and gm.colour_histogram(frames[0].canvas).sum() == 16


def test_interlaced_rows():
    rows = [0, 1, 2, 3, 0, 1, 2, 3]
    order = [0, 4, 2, 6, 1, 3, 5, 7]
    samples = [rows[r] for r in order for _ in range(4)]
    frame = next(gm.decode_gif(gif([(0, 0, 4, 8, samples, 0, None, 0, True, None)], height=8)))
    assert frame.samples[:, 0].tolist() == rows


def test_payload_round_trip_and_faults(spark):
    r = random.Random(1)
    payload = r.randbytes(192 * 700)
    data = gm.encode_gif(payload)
    frames = list(gm.decode_gif(data))
    assert len(frames) == 3 and b"".join(f.samples.tobytes() for f in frames) == payload
    for bad in (b"", b"GIF89a", data[:500], b"JPEG" + data):
        with pytest.raises(gm.GifError):
            list(gm.decode_gif(bad))
    df = spark.createDataFrame([(1, bytearray(data)), (2, None), (3, bytearray(data[: len(data) // 2]))], "doc_id long, gif binary")
    got = [(r["doc_id"], r["frame"], r["start_ms"], r["error"] is None) for r in gm.gif_frames(df).collect()]
    assert got == [(1, 0, 0, True), (1, 1, 100, True), (1, 2, 200, True), (2, None, None, False), (3, 0, 0, True), (3, None, None, False)]
    assert gm.gif_frames(df.limit(0)).collect() == []


def test_media_query_on_edges(spark, tmp_path):
    import zlib

    from sonde.llm.queries import op7_gif_media

    texts = [None, "", "a" * 192, "b" * 193, "ü" * 100_000, None]
    spark.createDataFrame([(i if i else None, t) for i, t in enumerate(texts)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(op7_gif_media(spark, str(tmp_path)).collect(), key=lambda r: r["doc_id"] or 0)
    for row, t in zip(got, texts, strict=True):
        raw = (t or "").encode()
        whole = raw.ljust(max(192, -(-len(raw) // 192) * 192))
        assert (row["n_bytes"], row["payload_bytes"], row["tail_crc32"]) == (len(raw), len(whole), zlib.crc32(whole[-16:]))
        assert row["payload_sha256"] == hashlib.sha256(whole).hexdigest()
        assert len(whole) < 1000 or row["media_bytes"] < len(whole) / 20
    assert (got[0]["doc_id"], got[5]["doc_id"]) == (None, 5) and got[0][1:] == got[5][1:]
