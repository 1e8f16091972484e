import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from sonde.llm import kernels

TEXTS = st.lists(st.text(alphabet="aAbB é\n\t.1", max_size=60) | st.none(), min_size=1, max_size=6)
WORD = re.compile(r"[^\x20\x09-\x0d]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, width=5):
    w = WORD.findall((text or "").translate(LOWER))
    if len(w) >= width:
        return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)}
    return {tuple(w)} if w else set()


@settings(max_examples=150, deadline=None)
@given(TEXTS)
def test_shingle_sets_have_the_sizes_and_overlaps_of_real_shingles(texts):
    raw, offs = kernels.utf8(pa.array(texts, pa.string()))
    got = list(kernels.shingle_sets(raw, offs))
    want = [shingles(t) for t in texts]
    assert [len(g) for g in got] == [len(w) for w in want]
    for i in range(len(texts)):
        for j in range(i):
            assert len(np.intersect1d(got[i], got[j])) == len(want[i] & want[j])


def test_long_texts_are_cut_only_at_white_space(monkeypatch):
    text = " ".join(f"w{i % 17}x{i}" for i in range(3000))
    raw, offs = kernels.utf8(pa.array([text, "a b", text]))
    whole, first = kernels.word_hashes(raw, offs)
    monkeypatch.setattr(kernels, "BLOCK", 1000)
    parts, again = kernels.word_hashes(raw, offs)
    assert np.array_equal(whole, parts) and np.array_equal(first, again)


def test_blocks_with_fewer_words_than_a_shingle():
    for texts in (["1 1 1"], [""], [None, "a"], ["a b c d"]):
        raw, offs = kernels.utf8(pa.array(texts, pa.string()))
        assert [len(s) for s in kernels.shingle_sets(raw, offs)] == [len(shingles(t)) for t in texts]


def test_sliced_and_null_columns():
    column = pa.array(["drop", None, "a b c", ""]).slice(1)
    raw, offs = kernels.utf8(column)
    assert offs.tolist() == [0, 0, 5, 5] and raw.tobytes() == b"a b c"


def test_gram_buckets_depend_on_the_gram_alone():
    a = dict(kernels.gram_buckets(np.frombuffer(b"xabcy", np.uint8), (3,), 16))[3]
    b = dict(kernels.gram_buckets(np.frombuffer(b"zzabc", np.uint8), (3,), 16))[3]
    assert a[1] == b[2]
