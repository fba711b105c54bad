"""Operators 11 to 13 against SQL, the public library and awkward rows."""

import random

import duckdb
import numpy as np
import pytest

pytest.importorskip("lakesmith.llm")

from lakesmith.llm import collocations, divergence, tokencount  # noqa: E402
from lakesmith.llm.common import Scratch, distinct_slices  # noqa: E402
from lakesmith.llm.queries import QUERIES, vocabulary  # noqa: E402

SMALL = "/root/testdata/sf0.001"
SCHEMA = "doc_id int, text string, lang string, source string, value string, rank string, phrase string"


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls everywhere, ties, repeated rows, clashing names."""
    rng = random.Random(4)
    words = ["a", "B", "b\tc", "É", "x.", "y ,", " ", "\x00q", "z\n", "AB-ab", "中文", "\U0001F600", "_", "9"]
    rows = [(k, " ".join(rng.choice(words) for _ in range(rng.randint(0, 60))), rng.choice([None, "en", "und", "a b", ""]),
             rng.choice([None, "", "s1", "S1", "ß", "s2"]), "x", "y", "z") for k in range(900)]
    rows += [(None, None, None, None, None, None, None), (1, "", "fr", "lone", None, None, None), rows[0], rows[0]]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def by_sql(name, df):
    con = duckdb.connect()
    con.register("documents", df.toArrow())
    rel = con.sql(QUERIES[name][1])
    return rel.columns, sorted(rel.fetchall(), key=str)


def rows(df, columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)


def test_collocations_equal_sql(spark, odd, none):
    columns, want = by_sql("op11_setm_collocations", odd)
    assert len(want) > 50
    assert rows(collocations.collocations(odd), columns) == want
    assert rows(collocations.collocations(odd, bits=16), columns) == want       # a bitmap that lets much pass
    assert collocations.collocations(none).count() == 0


def test_collocations_registered_query(spark):
    columns, want = by_sql("op11_setm_collocations", spark.read.parquet(f"{SMALL}/documents.parquet"))
    assert rows(QUERIES["op11_setm_collocations"][0](spark, SMALL), columns) == want


def test_words_with_shared_bits_are_told_apart(spark):
    words = spark.createDataFrame([(7, "en", "p"), (7, "en", "q"), (8, "en", "r"), (9, "a b", "r")],
                                  "word long, lang string, phrase string")
    assert collocations._shared_bits(words) == {b"en p": 1, b"en q": 2}
    import pyarrow as pa
    names = collocations.Names(pa.array(["en"]), {b"en p": 1, b"en q": 2})
    bits, *_ = names.words(np.frombuffer(b"q p r", np.uint8), np.array([0, 5]), 0)
    assert sorted(bits.tolist())[:2] == [1, 2]


def test_merge_join_of_adjacent_places():
    place = np.array([1, 2, 3, 5, 6, 9])
    start, after = collocations.extended(place, np.arange(6), 1)
    assert start.tolist() == [0, 1, 3] and after.tolist() == [1, 2, 4]
    start, _ = collocations.extended(place, start, 2)
    assert start.tolist() == [0]


def test_divergence_equals_sql(spark, odd, none):
    columns, want = by_sql("op12_quadtree_divergence", odd)
    assert rows(divergence.audit(odd), columns) == want
    assert divergence.audit(none).count() == 0


def test_divergence_registered_query_and_many_tiles(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns, want = by_sql("op12_quadtree_divergence", docs)
    assert rows(QUERIES["op12_quadtree_divergence"][0](spark, SMALL), columns) == want
    cells = divergence.term_cells(docs.selectExpr("coalesce(text, '') text", "lang", "source")).cache()
    sizes = cells.selectExpr("lang", "source", "n", "cast(head as long) v").groupBy("lang", "source").sum("n", "v").toDF(
        "lang", "source", "n", "v")
    langs = sizes.groupBy("lang").agg({"*": "count", "v": "sum"}).select("lang", "count(1)", "sum(v)").toDF("lang", "groups", "v")
    got = divergence.pair_prices(cells, sizes.drop("v"), langs, rows=3, columns=60)
    pairs = [tuple(w[columns.index(c)] for c in ("lang", "source", "item", "value")) for w in want if "pair" in w]
    assert rows(got, ["lang", "source", "item", "value"]) == sorted(pairs, key=str)


def test_quadtree_walk_equals_plain_sums():
    rng = np.random.default_rng(2)
    for n, m, columns in ((1, 1, 1), (3, 5, 17), (9, 4, 64), (6, 6, 33)):
        height = max(1, int(max(n, m, columns) - 1).bit_length())
        grids = [rng.integers(0, 40, (k, columns)) * (rng.random((k, columns)) < p) for k, p in ((n, 0.2), (m, 0.05))]
        trees = [divergence.K2Tree(*(x.astype(np.int64) for x in np.nonzero(g)), g[np.nonzero(g)], height) for g in grids]
        sizes = [g.sum(axis=1) + columns for g in grids]
        p, q = (divergence.share(g, s[:, None]) for g, s in zip(grids, sizes, strict=True))
        want = divergence.price(p[:, None, :], q[None, :, :]).sum(axis=2)
        assert (divergence.joint_prices(*trees, height, columns, *sizes) == want).all()
    big = 9 * 10**15
    assert divergence.share(np.array([big - 2]), np.array([big]))[0] == 1 + 10**9 * (big - 1) // big


def texts_for_counts():
    rng = random.Random(3)
    out = ["", None, "a", " ", "  a ", "▁x▁▁y", "a" * 900, "ab" * 700, "x" * 500 + "a" * 777, "\U0001F600" * 300 + "é中" * 200,
           "\n\n a\nb" * 50, "<s></s><unk>" * 60, " " * 700, "-" * 3000, "=*=" * 500]
    for _ in range(80):
        kind = rng.choice(["ab", "abc ", "aeinrst", "abcdefghijklmnopqrstuvwxyz  ", "éèà ab", "中文\U0001F600a ", "0123456789 .,",
                           "\t \n\x00a▁", "=-_"])
        out.append("".join(rng.choice(kind) for _ in range(rng.randint(1, 1500))))
    return out


def test_token_counts_equal_the_library(spark, none):
    import sentencepiece
    path = vocabulary("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    texts = texts_for_counts()
    texts.append(texts[6])      # a row that repeats
    want = [(k, len((t or "").encode()), len(library.encode(t or ""))) for k, t in enumerate(texts)]
    df = spark.createDataFrame([(k, t, "n") for k, t in enumerate(texts)], "doc_id int, text string, n_tokens string")
    for limits in ({"huge": 100, "piece": 64, "overlap": 16}, {"huge": 100, "piece": 40, "overlap": 4}, {}):
        got = tokencount.count_tokens(df, path, ["doc_id"], **limits)
        assert rows(got, ["doc_id", "n_bytes", "n_tokens"]) == sorted(want, key=str)
    assert tokencount.count_tokens(none, path, ["doc_id"]).count() == 0
    counter = tokencount.counter(path)
    for k, t in enumerate(texts):
        raw = (" " + t.replace("▁", " ")).encode() if t else b""
        assert counter.walk(raw, 64, 16) == want[k][2]


def test_distinct_slices_compare_bytes():
    """Strings built by doubling and swapping, equal under a rolling sum modulo 2^64."""
    a, b = b"x", b"y"
    for _ in range(11):
        a, b = a + b, b + a
    buf = np.frombuffer(a + b + a, np.uint8)
    code, letters = distinct_slices(buf, np.array([0, len(a), 2 * len(a)]), np.array([1, 2, 3]) * len(a))
    assert code.tolist() == [0, 1, 0] and letters.to_pylist() == [a, b]


def test_scratch_tables_go(spark):
    scratch = Scratch(spark)
    df = scratch.table(spark.range(3), "mining-test")
    path = scratch.paths["mining-test"][0]
    assert df.count() == 3
    scratch.drop()
    with pytest.raises(Exception, match="(?i)path"):
        spark.read.parquet(path)


def test_packed_numbers_come_back():
    import pyarrow as pa
    for x in ([], [0], [3, 255], [256, 1], [70_000, 2], [1 << 33]):
        got = collocations._unpacked(pa.py_buffer(collocations._packed(np.array(x, np.int64))))
        assert got.tolist() == x and got.dtype == np.int64
    block = collocations._block(np.zeros(0, np.uint64), *[np.zeros(0, np.int64)] * 3)
    assert [len(x) for x in next(collocations._blocks(block, 1))] == [0, 0, 0, 0]


def test_no_task_holds_a_whole_relation_file(spark, monkeypatch):
    """Rows of a relation have about a MB: 40 of them are several row groups, and a reader decodes one row at a time."""
    from pyspark.sql import DataFrameWriter
    from pyarrow.parquet import ParquetFile
    import glob
    write, groups, batch = DataFrameWriter.parquet, {}, {}

    def spy(self, path, *a, **k):
        name = path.rsplit("/", 1)[1].rsplit("-", 1)[0]
        batch[name] = int(spark.conf.get("spark.sql.parquet.columnarReaderBatchSize"))
        write(self, path, *a, **k)
        files = [ParquetFile(f).metadata for f in glob.glob(path.removeprefix("file:") + "/*.parquet")]
        groups[name] = [m.row_group(g).total_byte_size for m in files for g in range(m.num_row_groups)]
    monkeypatch.setattr(DataFrameWriter, "parquet", spy)
    before = spark.conf.get("spark.sql.parquet.columnarReaderBatchSize")
    rng = np.random.default_rng(5)
    words = np.array([f"w{k}" for k in range(3000)])
    docs = spark.createDataFrame([(" ".join(rng.choice(words, 200_000)), "en") for _ in range(10)], "text string, lang string")
    docs = docs.unionByName(docs).unionByName(docs).unionByName(docs).coalesce(1)
    phrases, _ = collocations.frequent_phrases(docs, Scratch(spark), longest=3)
    assert phrases.count() >= 3000
    assert len(groups["relation-1"]) > 1 and max(groups["relation-1"]) < 12 << 20
    assert batch["phrase-2"] == batch["phrase-3"] == batch["relation-2"] == 1
    assert spark.conf.get("spark.sql.parquet.columnarReaderBatchSize") == before
