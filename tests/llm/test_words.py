import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from geomarket.llm.words import ALPHANUMERIC, NOT_SPACE, chunks, windows, words

TEXTS = st.lists(st.one_of(st.none(), st.text("abAB \n\té梦1.", max_size=20)), max_size=8)


@settings(max_examples=100, deadline=None)
@given(TEXTS, st.integers(1, 30))
def test_words_are_those_of_the_patterns(texts, limit):
    patterns = {r"[^\x20\x09-\x0D]+": NOT_SPACE, r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+": ALPHANUMERIC}
    for pattern, kept in patterns.items():
        found, hashes = [], {}
        for chunk in chunks(pa.array(texts, pa.string()), limit):
            part = words(chunk, kept)
            for start, end, row, hashed in zip(*part, strict=True):
                word = chunk.data[start:end].tobytes().decode().translate({c: c + 32 for c in range(65, 91)})
                found.append((chunk.first + row, word))
                assert hashes.setdefault(word, hashed) == hashed
        lower = [(t or "").translate({c: c + 32 for c in range(65, 91)}) for t in texts]
        assert found == [(k, w) for k, t in enumerate(lower) for w in re.findall(pattern, t)]
        assert len(set(hashes.values())) == len(hashes)


def test_windows_stay_in_their_text():
    chunk = next(chunks(pa.array(["a b c", "a b", "a b c"])))
    first, hashed = windows(words(chunk, NOT_SPACE), 3)
    assert first.tolist() == [0, 5]
    assert hashed[0] == hashed[1]
    assert len(windows(words(chunk, NOT_SPACE), 4)[0]) == 0


def test_slices_of_a_column():
    column = pa.array(["x", "yy", None, "zzz"]).slice(1, 3)
    parts = list(chunks(column, 1))
    assert [c.first for c in parts] == [0, 1, 2]
    assert b"".join(c.data.tobytes() for c in parts) == b"yyzzz"
    assert not list(chunks(pa.array([], pa.string())))
    assert np.array_equal(next(chunks(pa.array([None], pa.string()))).offsets, [0, 0])
