"""Near-duplicates: words up to 16 bytes are hashed in whole columns, and
sets and signatures of many rows are made at once."""

import re

import numpy as np
import pyarrow as pa
import pytest

pytest.importorskip("lakesmith.llm")

from lakesmith.llm import common, neardup  # noqa: E402
from lakesmith.llm.common import text_bytes, word_bounds, word_keys  # noqa: E402

# lengths on both sides of 8 and 16 bytes, control characters, the last word of the buffer
WORDS = ["a", "a\x00", "\x00", "\x00\x00", "a\x01", "abcdefg", "abcdefgh", "abcdefg\x00", "abcdefg\x07", "abcdefg\x08", "abcdefghi",
         "abcdefgh\x00", "é", "éé", "日本語", "日本語日本", "abcdefghijklmno", "abcdefghijklmnop", "abcdefghijklmnop\x00", "abcdefghijklmnopq",
         "x" * 17, "x" * 18, "x" * 4000, "xy" * 512, "yx" * 512]


def rows_of(texts):
    return text_bytes(pa.array(texts, pa.string()))


def test_equal_words_and_only_those_have_equal_keys():
    b, off = rows_of([" ".join(WORDS), " ".join(reversed(WORDS)), "", WORDS[0]])
    starts, ends, _ = word_bounds(b, off)
    words = [bytes(b[i:j]) for i, j in zip(starts, ends)]
    with np.errstate(over="ignore"):
        keys = word_keys(b, starts, ends)
    assert len(set(zip(words, keys.tolist()))) == len(set(words)) == len(set(keys.tolist())) == len(WORDS)
    none = np.zeros(0, np.int64)
    assert len(word_keys(np.zeros(0, np.uint8), none, none)) == 0


def test_ordinary_words_are_not_hashed_one_by_one(monkeypatch):
    seen, real = [], common.xxhash.xxh3_64_intdigest
    monkeypatch.setattr(common.xxhash, "xxh3_64_intdigest", lambda w: seen.append(w) or real(w))
    texts = [" ".join(f"word{i * k % 997}" for i in range(300)) for k in range(1, 20)] + ["one " + "y" * 17]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], names=["id", "text"])
    assert [b.num_rows for b in neardup._full_sets([batch])] == [b.num_rows for b in neardup._set_rows([batch])] == [len(texts)]
    assert set(seen) == {b"y" * 17}


def test_sets_and_signatures_of_many_rows_equal_those_of_one():
    texts = ["", "A b", "a B", " \t", "to be or not to be or not to be or not", "one", " ".join(WORDS), "", "a b c d e", "A b c d e f\na b c d e"]
    b, off = rows_of(texts)
    with np.errstate(over="ignore"):
        flat, place = neardup.shingle_sets(b, off)
        sigs = neardup.signatures(flat, place)
        for k, t in enumerate(texts):
            w = re.findall(r"[^\x20\x09-\x0D]+", t.lower())
            want = {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
            mine = flat[place[k]:place[k + 1]]
            assert len(mine) == len(want) and (mine[1:] > mine[:-1]).all()
            alone, ends = neardup.shingle_sets(*rows_of([t]))
            assert (alone == mine).all() and neardup.signatures(alone, ends) == [sigs[k]]
            if want:
                low = (mine[:, None] * neardup._A + neardup._B).min(axis=0)
                assert sigs[k] == (low >> np.uint64(20)).astype(">u2").tobytes()
            else:
                assert sigs[k] is None
    assert (flat[place[1]:place[2]] == flat[place[2]:place[3]]).all()
    assert set(flat[place[8]:place[9]].tolist()) <= set(flat[place[9]:].tolist())
