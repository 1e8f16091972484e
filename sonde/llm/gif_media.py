"""GIF as a media column: LZW code streams, palettes, disposal, transparency, timed frames.

The decoder reads any GIF87a/89a: local and global palettes, interlacing, deferred clear
codes, all disposal methods. LZW is decoded without a loop over codes. Code widths between
two clear codes follow from a code's number alone, so codes are cut from the bits in
bulk; and the entry a code adds is the text of that code plus the byte after it in the output,
so every code copies an earlier stretch of the output, resolved by pointer doubling.

The encoder stores bytes losslessly as grey pixels, as many frames as needed, by LZW with a full table.
A frame of up to 128 different bytes gets a palette of its own and shorter codes; one that repeats
at least half of the frame before leaves those pixels transparent, over a frame that is kept (disposal 1);
frames that nothing is drawn upon are cleared (disposal 2). ``shown`` reads the bytes back.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import small_batches

WIDTH, ROWS_PER_FRAME, DELAY_MS = 192, 256, 100
GREY = np.repeat(np.arange(256, dtype=np.uint8), 3)


class GifError(ValueError):
    """The bytes are not a GIF that can be decoded."""


@dataclass(frozen=True)
class Frame:
    delay_ms: int
    disposal: int
    transparent: int | None
    left: int
    top: int
    samples: np.ndarray  # height x width palette indices, rows in display order
    palette: np.ndarray  # n x 3
    canvas: np.ndarray  # canvas height x width: colour as 0xRRGGBB, -1 where transparent


# --- writing


def lzw_encode(samples: bytes, least: int) -> bytes:
    """The code stream of samples below 1 << ``least``: a clear code whenever the table is full."""
    clear, codes, table, code = 1 << least, [1 << least], {}, samples[0]
    known, put, free = table.get, codes.append, (1 << least) + 2
    for sample in samples[1:]:
        key = code << 8 | sample
        longer = known(key)
        if longer is not None:
            code = longer
            continue
        put(code)
        code = sample
        if free < 4096:
            table[key] = free
            free += 1
        else:
            put(clear)
            table.clear()
            free = clear + 2
    put(code)
    put(clear + 1)
    all_codes = np.array(codes, np.uint16)
    at = np.arange(len(codes))
    number = at - np.maximum.accumulate(np.where(all_codes == clear, at, -1)) - 1  # codes since the clear code before
    number[all_codes == clear] = np.diff(np.append(0, np.flatnonzero(all_codes == clear))) - 1
    number[0] = 0
    entries = clear + 2 + np.maximum(0, number - 1)
    width = np.minimum(12, np.maximum(least + 1, np.frexp(entries.astype(float))[1]))
    nth = np.arange(width.sum()) - np.repeat(np.cumsum(width) - width, width)
    bits = (np.repeat(all_codes, width) >> nth.astype(np.uint16)).astype(np.uint8) & 1
    return np.packbits(bits, bitorder="little").tobytes()


def _sub_blocks(data: bytes) -> bytes:
    whole = len(data) // 255
    body = np.frombuffer(data, np.uint8, whole * 255).reshape(whole, 255)
    blocks = np.hstack([np.full((whole, 1), 255, np.uint8), body]).tobytes()
    rest = data[whole * 255 :]
    return blocks + (bytes([len(rest)]) + rest if rest else b"") + b"\0"


def _kept(part: np.ndarray, before: np.ndarray | None) -> np.ndarray | None:
    """Where a frame repeats the one before, if that is at least half of it."""
    if before is None:
        return None
    same = part == before[: len(part)]
    return same if 2 * same.sum() >= len(part) else None


def encode_gif(payload: bytes, width: int = WIDTH, rows: int = ROWS_PER_FRAME, delay_ms: int = DELAY_MS) -> bytes:
    """A grey animation that shows ``payload`` (a positive multiple of ``width`` bytes), frame by frame."""
    if not payload or len(payload) % width:
        raise ValueError("the payload is not a positive multiple of the width")
    samples = np.frombuffer(payload, np.uint8)
    size = min(rows, len(payload) // width) * width
    parts = [samples[i : i + size] for i in range(0, len(samples), size)]
    kept = [_kept(x, y) for x, y in zip(parts, [None, *parts], strict=False)]
    out = [b"GIF89a", struct.pack("<HHBBB", width, size // width, 0xF7, 0, 0), GREY.tobytes()]
    for part, same, later in zip(parts, kept, [*kept[1:], None], strict=True):
        used = np.zeros(256, bool)
        used[part if same is None else part[~same]] = True
        colours, clear = np.flatnonzero(used), None
        if same is not None and len(colours) < 256:
            clear = int(np.argmin(used)) if len(colours) > 127 else len(colours)
        if len(colours) + (clear is not None) <= 128:
            least = max(2, (len(colours) + (clear is not None) - 1).bit_length())
            index = np.zeros(256, np.uint8)
            index[colours] = np.arange(len(colours))
            palette = np.zeros(1 << least, np.uint8)
            palette[: len(colours)] = colours
            local, body = 0x80 | least - 1, np.repeat(palette, 3).tobytes()
            pixels = index[part]
        else:
            least, local, body, pixels = 8, 0, b"", part
        if clear is not None:
            pixels = np.where(same, np.uint8(clear), pixels)
        disposal = 1 if later is not None else 2
        out.append(b"\x21\xf9\x04" + struct.pack("<BHBB", disposal << 2 | (clear is not None), delay_ms // 10, clear or 0, 0))
        out.append(b"\x2c" + struct.pack("<HHHHB", 0, 0, width, len(part) // width, local) + body + bytes([least]))
        out.append(_sub_blocks(lzw_encode(pixels.tobytes(), least)))
    return b"".join([*out, b"\x3b"])


def shown(samples: bytes, palette: bytes, transparent: int | None, before: np.ndarray | None) -> np.ndarray:
    """The grey pixels (red of their colours) that a frame shows over what its rectangle showed before."""
    index = np.frombuffer(samples, np.uint8)
    grey = np.frombuffer(palette, np.uint8)[::3][index]
    return grey if transparent is None else np.where(index == transparent, before[: len(index)], grey)


# --- reading


def _run_of_codes(bits: np.ndarray, at: int, least: int) -> tuple[np.ndarray, int]:
    """The codes from bit ``at`` up to the next clear or end code (included) or the end, and the bit after them."""
    clear, parts, number = 1 << least, [], 0
    while True:
        entries = clear + 2 + max(0, number - 1)
        width = min(12, max(least + 1, entries.bit_length()))
        most = (1 << width) - (clear + 2) + 1 - number if width < 12 else 1 << 16
        n = min(most, (len(bits) - at) // width)
        if n <= 0:
            return (np.concatenate(parts) if parts else np.zeros(0, np.int64)), at
        codes = bits[at : at + n * width].reshape(n, width) @ (1 << np.arange(width))
        stop = np.flatnonzero((codes == clear) | (codes == clear + 1))
        if len(stop):
            parts.append(codes[: stop[0] + 1])
            return np.concatenate(parts), at + int(stop[0] + 1) * width
        parts.append(codes)
        at, number = at + n * width, number + n


def _expand(codes: np.ndarray, least: int) -> np.ndarray:
    """The samples of codes that follow one clear code, none of them clear or end."""
    entry = codes - ((1 << least) + 2)
    if not len(codes) or entry.max() < 0:
        return codes.astype(np.uint8)
    number = np.arange(len(codes))
    literal = entry < 0
    if (entry >= np.maximum(number, 1)).any():
        raise GifError("a code that no earlier one defined")
    up, size = np.where(literal, number, entry), np.where(literal, 0, 1)
    while True:  # the length of an entry: one more than that of the code it was made from
        above = size[up]
        if not above.any():
            break
        size, up = size + above, up[up]
    size = size + 1
    start = np.cumsum(size) - size
    code = np.repeat(number, size)
    place = np.arange(len(code))
    source = np.where(literal[code], place, start[np.where(literal, 0, entry)[code]] + place - start[code])
    while not np.array_equal(further := source[source], source):
        source = further
    return codes[code[source]].astype(np.uint8)


def lzw_decode(data: bytes, least: int, wanted: int) -> np.ndarray:
    """``wanted`` samples of a GIF code stream."""
    bits = np.unpackbits(np.frombuffer(data, np.uint8), bitorder="little")
    clear = 1 << least
    # If no run between clear codes is long enough to widen, all codes have one width.
    width = least + 1
    n = len(bits) // width
    codes = bits[: n * width].reshape(n, width) @ (1 << np.arange(width, dtype=np.int32))
    end = np.flatnonzero(codes == clear + 1)
    codes = codes[: end[0]] if len(end) else codes
    clears = np.flatnonzero(codes == clear)
    gaps = np.diff(np.concatenate([[-1], clears, [len(codes)]])) - 1
    if len(end) and gaps.max(initial=0) <= clear - 1 and codes.max(initial=0) <= clear:
        out = codes[codes < clear].astype(np.uint8)
    else:
        at, parts, have = 0, [], 0
        while have < wanted:
            run, after = _run_of_codes(bits, at, least)
            stop = len(run) and run[-1] in (clear, clear + 1)
            parts.append(_expand(run[:-1] if stop else run, least))
            have += len(parts[-1])
            if after == at or (stop and run[-1] == clear + 1) or not len(run):
                break
            at = after
        out = np.concatenate(parts) if parts else np.zeros(0, np.uint8)
    if len(out) < wanted:
        raise GifError(f"{len(out)} samples, {wanted} expected")
    return out[:wanted]


def _blocks(data: bytes, at: int) -> tuple[bytes, int]:
    parts = []
    while data[at]:
        parts.append(data[at + 1 : at + 1 + data[at]])
        at += 1 + data[at]
    return b"".join(parts), at + 1


def decode_gif(data: bytes) -> Iterator[Frame]:
    """The frames in display order, each with the canvas as shown; GifError for anything malformed."""
    try:
        yield from _decode(data)
    except GifError:
        raise
    except (IndexError, ValueError, struct.error) as e:
        raise GifError("the data end too early") from e


def _decode(data: bytes) -> Iterator[Frame]:
    if data[:6] not in (b"GIF87a", b"GIF89a"):
        raise GifError("no GIF header")
    width, height, flags = struct.unpack_from("<HHB", data, 6)
    at, shared = 13, None
    if flags & 0x80:
        n = 3 << ((flags & 7) + 1)
        shared, at = np.frombuffer(data, np.uint8, n, at).reshape(-1, 3), at + n
    canvas = np.full((height, width), -1, np.int32)
    delay, disposal, transparent = 0, 0, None
    while data[at] != 0x3B:
        if data[at] == 0x21:
            body, after = _blocks(data, at + 2)
            if data[at + 1] == 0xF9:
                packed, ticks, index = struct.unpack_from("<BHB", body)
                delay, disposal, transparent = ticks * 10, packed >> 2 & 7, index if packed & 1 else None
            at = after
            continue
        if data[at] != 0x2C:
            raise GifError(f"unknown block {data[at]}")
        left, top, w, h, local = struct.unpack_from("<HHHHB", data, at + 1)
        at, palette = at + 10, shared
        if local & 0x80:
            n = 3 << ((local & 7) + 1)
            palette, at = np.frombuffer(data, np.uint8, n, at).reshape(-1, 3), at + n
        if palette is None:
            raise GifError("a frame without a palette")
        least = data[at]
        if not 1 <= least <= 8:
            raise GifError("bad code size")
        stream, at = _blocks(data, at + 1)
        samples = lzw_decode(stream, least, w * h).reshape(h, w)
        if local & 0x40:  # interlaced: rows come in four passes
            order = np.concatenate([np.arange(0, h, 8), np.arange(4, h, 8), np.arange(2, h, 4), np.arange(1, h, 2)])
            plain = np.empty_like(samples)
            plain[order] = samples
            samples = plain
        if samples.size and samples.max() >= len(palette):
            raise GifError("a sample beyond the palette")
        before = canvas.copy() if disposal == 3 else None
        rgb = palette.astype(np.int32) @ np.array([65536, 256, 1], np.int32)
        view = canvas[top : top + h, left : left + w]
        seen = samples[: view.shape[0], : view.shape[1]]
        if transparent is None:
            view[...] = rgb[seen]
        else:
            np.copyto(view, rgb[seen], where=seen != transparent)
        yield Frame(delay, disposal, transparent, left, top, samples, palette, canvas.copy())
        if disposal == 2:
            view[...] = -1
        elif disposal == 3:
            canvas = before
        delay, disposal, transparent = 0, 0, None


def colour_histogram(canvas: np.ndarray) -> np.ndarray:
    """Pixels in each of 4 x 4 x 4 colour cells, then transparent ones: 65 counts."""
    flat = canvas.ravel()
    cell = np.where(flat < 0, 64, (flat >> 22 & 3) << 4 | (flat >> 14 & 3) << 2 | (flat >> 6 & 3))
    return np.bincount(cell, minlength=65)


# --- tables


def store_gifs(rows: DataFrame, payload: str, gif: str = "gif") -> DataFrame:
    """``rows`` with the column ``payload`` replaced by ``gif``, its lossless GIF. Null payloads, or ones that are no positive multiple of the width, give null."""
    small_batches(rows.sparkSession, 256)
    keep = [c for c in rows.columns if c not in (payload, gif)]

    def one(x: bytes | None) -> bytes | None:
        return encode_gif(x) if x and not len(x) % WIDTH else None

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf[keep].assign(**{gif: [one(x) for x in pdf[payload]]})

    schema = ", ".join([*(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keep), f"`{gif}` binary"])
    return rows.select(*keep, payload).mapInPandas(run, schema)


def gif_frames(rows: DataFrame, gif: str = "gif") -> DataFrame:
    """One row per frame of each GIF, a GIF's frames together and in order: the other columns
    of ``rows``, frame (from 0), start_ms, delay_ms, disposal, transparent, left, top, width, height,
    samples, palette, histogram (65 counts of the canvas as shown), error. Columns of these names are replaced.

    A null or malformed GIF gives, after the frames before the fault, one row with frame null
    and the fault in ``error``. An empty table gives no rows.
    """
    small_batches(rows.sparkSession, 256)
    own = ["frame", "start_ms", "delay_ms", "disposal", "transparent", "left", "top", "width", "height", "samples", "palette", "histogram", "error"]
    keep = [c for c in rows.columns if c != gif and c not in own]

    def frames(data: bytes | None) -> Iterator[tuple]:
        now = 0
        try:
            for i, f in enumerate(decode_gif(data or b"")):
                h, w = f.samples.shape
                yield i, now, f.delay_ms, f.disposal, f.transparent, f.left, f.top, w, h, f.samples.tobytes(), f.palette.tobytes(), colour_histogram(f.canvas).tolist(), None
                now += f.delay_ms
        except GifError as e:
            yield (*[None] * 12, str(e))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            held, size = [], 0
            for *kept, data in pdf[[*keep, gif]].itertuples(index=False, name=None):
                for f in frames(data):
                    held.append((*kept, *f))
                    size += len(f[9] or b"")
                    if size > 4 << 20:
                        yield table(held)
                        held, size = [], 0
            if held:
                yield table(held)

    def table(held: list[tuple]) -> pd.DataFrame:
        out = pd.DataFrame(held, columns=[*keep, *own], dtype=object)
        return out.astype({c: "Int64" for c in own[:9]})

    schema = [f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keep]
    schema += [f"{c} long" for c in own[:9]] + ["samples binary", "palette binary", "histogram array<long>", "error string"]
    return rows.select(*keep, gif).mapInPandas(run, ", ".join(schema))


def padded_payload(text: F.Column) -> F.Column:
    """A text's UTF-8 bytes with blanks up to a positive multiple of the width; null is empty."""
    raw = F.coalesce(text, F.lit("")).cast("binary")
    n = F.greatest(F.lit(1), F.ceil(F.octet_length(raw) / WIDTH)) * WIDTH
    return F.rpad(raw, n.cast("int"), F.lit(b" "))
