"""Token counts and budget cuts for one text, by a tokenizer file or by bytes."""

from __future__ import annotations

import codecs
from functools import lru_cache

from ...functions.fixed import BYTES_PER_TOKEN


@lru_cache(maxsize=4)
def _tokenizer(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


class Counter:
    """Counts and cuts with a tokenizer if a path is given, else three bytes to the token."""

    def __init__(self, path: str | None = None):
        self.path = path

    def count(self, text: str) -> int:
        if self.path:
            return len(_tokenizer(self.path).encode(text, add_special_tokens=False).ids)
        return max(1, len(text.encode()) // BYTES_PER_TOKEN)

    def cut(self, text: str, budget: int) -> list[str]:
        """Consecutive pieces of at most ``budget`` tokens that join to the text; none of a blank one."""
        if not text.strip():
            return []
        if self.path:
            ends = [e for _, e in _tokenizer(self.path).encode(text, add_special_tokens=False).offsets]
            if len(ends) <= budget:
                return [text]
            marks = [0, *ends[budget - 1 :: budget], len(text)]
            return [text[a:b] for a, b in zip(marks, marks[1:], strict=False) if a < b]
        data, step, out, at = text.encode(), budget * BYTES_PER_TOKEN, [], 0
        while at < len(data):
            end = min(at + step, len(data))
            while end < len(data) and data[end] & 0xC0 == 0x80:  # not inside a character
                end -= 1
            out.append(data[at:end].decode())
            at = end
        return out


def decode(data: bytes) -> str:
    """Text by its byte order mark, else UTF-8, bad bytes as U+FFFD."""
    for mark, name in ((codecs.BOM_UTF8, "utf-8"), (codecs.BOM_UTF16_LE, "utf-16-le"), (codecs.BOM_UTF16_BE, "utf-16-be")):
        if data.startswith(mark):
            return data[len(mark) :].decode(name, "replace")
    return data.decode("utf-8", "replace")


def lines_of(text: str) -> list[str]:
    """Lines at newlines, a carriage return before one left off; a last newline ends the last line."""
    parts = text.split("\n")
    if parts[-1] == "":
        parts.pop()
    return [p.removesuffix("\r") for p in parts]
