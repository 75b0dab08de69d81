import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from quillon.llm import bytetext as B

LETTERS = st.text(alphabet="abZ09 .,\n\té Éßñ中!|", max_size=60)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), LETTERS), max_size=8))
def test_words_and_hashes(texts):
    raw, offsets, valid = B.buffers(pa.array(texts, pa.string()))
    assert list(valid) == [t is not None for t in texts]
    got = []
    for lo, hi, data, own in B.slices(raw, offsets, most=16):
        folded = B.fold(data)
        s, e, d = B.words(folded, own)
        h = B.Hasher(folded).spans(s, e)
        got += [(lo + int(x), folded[a:b].tobytes().decode(), int(y)) for a, b, x, y in zip(s, e, d, h)]
    want = [(i, w, B.hash_text(w)) for i, t in enumerate(texts) if t for w in re.findall(r"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", t.lower())]
    assert got == want


def test_sliced_array_and_long_text():
    a = pa.array(["skip", "one two", None, "x" * 3_000_000 + " end"])[1:]
    raw, offsets, _ = B.buffers(a)
    parts = list(B.slices(raw, offsets))
    assert parts[-1][1] == 3
    s, e, d = B.words(parts[-1][2], parts[-1][3])
    assert len(s) >= 2 and (e - s).max() == 3_000_000
    assert len(np.unique(B.mix(np.arange(1000, dtype=np.uint64)))) == 1000
