"""Shingles of whole columns against Python sets."""

import random

import numpy as np
import pyarrow as pa
import pytest

from lakesmith.functions import shingles as S


def _texts():
    r = random.Random(3)
    words = ["a", "b", "é", "中文", "x" * 7, "x" * 8, "x" * 9, "y" * 40, "y" * 39 + "z", "\U0001F600", "\x00"]
    return ["", "a", "a b", "b a", "a b c", " ".join(["a"] * 50)] + [" ".join(r.choices(words, k=r.randrange(1, 80))) for _ in range(200)]


def _set(text, k):
    w = text.split(" ")
    return {tuple(w[i:i + k]) for i in range(max(len(w) - k, 0) + 1)}


@pytest.mark.parametrize("k", [1, 2, 3, 5])
def test_shingles_equal_python_sets(k, monkeypatch):
    texts = _texts()
    for size in (S.CHUNK, 300):
        monkeypatch.setattr(S, "CHUNK", size)
        col, known, seen = pa.array(["cut off", *texts]).slice(1), {}, 0
        for i, b, off in S.text_chunks(col):
            row, h = S.distinct_in_rows(*S.hashed_shingles(b, off, k))
            for j in range(len(off) - 1):
                want, got = _set(texts[i + j], k), h[row == j].tolist()
                assert len(got) == len(want)
                for x in want:
                    seen += 1
                    known.setdefault(x, set()).update(got if len(want) == 1 else [])
            assert np.array_equal(np.unique(row), np.arange(len(off) - 1))
        assert seen and len({next(iter(v)) for v in known.values() if len(v) == 1}) == sum(len(v) == 1 for v in known.values())
        a, b = texts, texts[1:] + texts[:1]
        got = [np.concatenate(x).tolist() for x in zip(*S.common_shingles(pa.array(a), pa.array(b), k), strict=True)]
        pairs = [(_set(x, k), _set(y, k)) for x, y in zip(a, b, strict=True)]
        assert got == [[len(x & y) for x, y in pairs], [len(x) for x, _ in pairs], [len(y) for _, y in pairs]]


def test_numbers_of_prefixes_keep_long_shingles_exact():
    """More words than 64 bits hold as digits of a shingle of seven."""
    r = random.Random(8)
    texts = [" ".join(f"w{r.randrange(5000)}" for _ in range(3000)) for _ in range(3)]
    texts.append(texts[0] + " " + texts[1])
    common = next(S.common_shingles(pa.array(texts[:2]), pa.array([texts[3]] * 2), 7))[0]
    assert common.tolist() == [len(_set(t, 7) & _set(texts[3], 7)) for t in texts[:2]]
