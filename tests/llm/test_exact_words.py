"""Words are told apart by their bytes: two different words that a rolling
sum modulo 2^64 takes for one; and special tokens inside texts."""

import zlib

import numpy as np
import pytest

pytest.importorskip("lakesmith.llm")

from lakesmith.llm import decontaminate, neardup, pieces, tokens  # noqa: E402
from lakesmith.llm.common import scratch_path  # noqa: E402
from lakesmith.llm.queries import END_ID, vocabulary  # noqa: E402


def pair():
    a, b = "x", "y"
    for _ in range(11):
        a, b = a + b, b + a
    return a, b


def test_near_duplicates_tell_them_apart(spark):
    a, b = pair()
    df = spark.createDataFrame([(1, " ".join([a] * 7)), (2, " ".join([b] * 7)), (3, " ".join([a] * 7))], "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(df).collect()}
    assert got == {1: 1, 2: 2, 3: 1}


def test_token_ids_equal_the_library(spark):
    from tokenizers import Tokenizer
    a, b = pair()
    texts = [f"{a} {b} {a}", "a <|endoftext|> b<|startoftext|>c x<|endoftext|>", "<|endoftext|>", "<|EndOfText|> <|endoftext |>"]
    lib = Tokenizer.from_file(vocabulary("word_bpe_49k.json"))
    path = scratch_path(spark, "test-exact")
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    tokens.write_token_files(df, path, vocabulary("word_bpe_49k.json"), END_ID)
    got = {r["doc_id"]: r["ids_crc32"] for r in tokens.token_documents(spark, path).collect()}
    for k, t in enumerate(texts):
        ids = lib.encode(t, add_special_tokens=False).ids + [END_ID]
        assert got[k] == zlib.crc32(np.array(ids, "<u4").tobytes()), t[:40]


def test_pieces_equal_the_library(spark):
    import sentencepiece
    a, b = pair()
    path = vocabulary("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    df = spark.createDataFrame([(1, f"{a} {b}"), (2, b)], "doc_id long, text string")
    for r in pieces.encode(df, path, ["doc_id", "text"]).collect():
        assert r["ids"] == library.encode(r["text"]) and r["round_trip"]


def test_leaks_tell_them_apart(spark):
    a, b = pair()
    fill = " ".join(f"w{k}" for k in range(60))
    docs = spark.createDataFrame([(1, f"{fill} {' '.join([a] * 8)}"), (2, f"{fill} {' '.join([b] * 8)}")], "doc_id long, text string")
    items = spark.createDataFrame([(5, " ".join([a] * 8))], "item_id long, text string")
    assert [r["doc_id"] for r in decontaminate.find_leaks(docs, items).collect()] == [1]


def test_bound_on_the_intersection_rules_out_no_link(spark):
    rng = np.random.default_rng(4)
    sets = []
    for k in range(40):
        base = rng.integers(-2**63, 2**63, 300)
        sets += [(4 * k, base), (4 * k + 1, np.append(base[:270], rng.integers(-2**63, 2**63, 20))),
                 (4 * k + 2, base[:230]), (4 * k + 3, np.append(base[:150], rng.integers(-2**63, 2**63, 150)))]
    df = spark.createDataFrame([(i, np.sort(s).tolist()) for i, s in sets], "id long, members array<long>")
    pairs = spark.createDataFrame([(4 * k + i, 4 * k + j) for k in range(40) for i in range(4) for j in range(i)], "a long, b long")
    links = {tuple(r) for r in neardup.confirmed(pairs, df).collect()}
    kept = {tuple(r) for r in neardup.possible(pairs, df).collect()}
    assert links <= kept and len(links) >= 80 and len(kept) < pairs.count()
