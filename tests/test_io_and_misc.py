import json
import os
import tempfile

import numpy as np
from pyspark.sql import functions as F

from lakesmith.operators import corpus as K
from lakesmith.operators import ml as M
from lakesmith.operators import relational as R
from lakesmith.operators import retrieval as X
from lakesmith.operators import rules as Q
from lakesmith.operators import series as T
from lakesmith.operators import warehouse as W
from lakesmith.sources import readers as RD
from lakesmith.sources import sinks as SK


def _write(path, text):
    with open(path, "w") as f:
        f.write(text)
    return path


def test_read_json_doc_wrappers(spark):
    d = tempfile.mkdtemp(prefix="ls-json-")
    arr = _write(os.path.join(d, "a.json"), json.dumps([{"a": 1}, {"a": 2}]))
    wrapped = _write(os.path.join(d, "b.json"), json.dumps({"meta": 1, "records": [{"a": 1}, {"a": 2}, {"a": 3}]}))
    single = _write(os.path.join(d, "c.json"), json.dumps({"a": 7, "b": "x"}))
    assert RD.read_json_doc(spark, arr).count() == 2
    assert RD.read_json_doc(spark, wrapped).count() == 3
    one = RD.read_json_doc(spark, single).collect()
    assert len(one) == 1 and one[0].a == 7


def test_csv_quality_path_keeps_empty_text(spark):
    d = tempfile.mkdtemp(prefix="ls-csv-")
    p = _write(os.path.join(d, "c.csv"), "id,name\n1,\n2,bob\n")
    rows = RD.read_csv(spark, p, infer=False).orderBy("id").collect()
    assert rows[0].name == "" and rows[0].id == "1"


def test_jdbc_option_map():
    o = RD.jdbc_options("jdbc:postgresql://h/db", "public.orders", "o_orderkey", (0, 1000), 8)
    assert o["dbtable"] == "public.orders" and o["numPartitions"] == "8" and o["lowerBound"] == "0"
    assert RD.jdbc_options("jdbc:x", "select * from t")["query"].startswith("select")


def test_bucketed_tables_join_without_exchange(spark, sf_small):
    from lakesmith.sources.tables import table
    d = tempfile.mkdtemp(prefix="ls-bucket-")
    SK.write_bucketed(table(spark, sf_small, "orders"), "b_orders", 4, ["o_orderkey"], path=f"{d}/o")
    li = table(spark, sf_small, "lineitem").withColumnRenamed("l_orderkey", "o_orderkey")
    SK.write_bucketed(li, "b_lineitem", 4, ["o_orderkey"], path=f"{d}/l")
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")     # force the sort-merge path
    try:
        j = spark.table("b_orders").join(spark.table("b_lineitem"), "o_orderkey")
        plan = j._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Exchange" not in plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_quality_report_sections(spark):
    res = Q.check_row_count(spark.range(5), 1, 10)
    score = spark.createDataFrame([(90.0,)], "overall double")
    prof = spark.createDataFrame([("id", 0.0)], "column_name string, null_pct double")
    r = {x.section for x in SK.quality_report({"rows": 5}, score, res, prof).collect()}
    assert r == {"dataset", "score", "summary", "check", "column_profile"}


def test_storage_findings(spark):
    t = spark.createDataFrame([("old_big", 5e9, "2023-01-01 00:00:00", "ds"), ("new_big", 20e9, "2024-01-20 00:00:00", None),
                               ("old_small", 1e8, "2020-01-01 00:00:00", None)],
                              "table_name string, bytes double, last_accessed string, partition_column string") \
        .withColumn("last_accessed", F.col("last_accessed").cast("timestamp_ntz"))
    f = {(r.table_name, r.finding) for r in R.storage_findings(t, "2024-02-01 00:00:00").collect()}
    assert f == {("old_big", "idle"), ("new_big", "unpartitioned")}


def test_contract_schema_and_columns(spark):
    df = spark.createDataFrame([("1", "a@b.io"), ("2", "")], "order_id string, email string")
    r = {(x.check_name, x.column_name): x.passed for x in Q.check_contract_schema(df, [
        {"name": "order_id", "type": "integer", "required": True},
        {"name": "email", "type": "email", "required": True},
        {"name": "missing", "type": "string"}]).collect()}
    assert r[("type_compatible", "order_id")] and r[("not_null", "order_id")]
    assert not r[("not_null", "email")] and not r[("column_exists", "missing")]
    assert [x.passed for x in Q.check_columns(df, ["order_id", "x"]).collect()] == [True, False]
    assert Q.check_column_set(df, ["email", "order_id"]).collect()[0].passed


def test_lineage_events(spark):
    d = tempfile.mkdtemp(prefix="ls-lineage-")
    W.with_lineage("job", ["in"], [f"{d}/out"], lambda: spark.range(7), f"{d}/lineage")
    ev = {r.event_type: r.row_count for r in spark.read.parquet(f"{d}/lineage").collect()}
    assert ev == {"START": None, "COMPLETE": 7}


def test_dbscan_blobs(spark):
    rng = np.random.default_rng(3)
    a = rng.normal(0, 0.1, (30, 2))
    b = rng.normal(5, 0.1, (30, 2))
    noise = np.array([[10.0, -10.0]])
    pts = np.vstack([a, b, noise])
    df = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(pts)], "id long, x double, y double")
    out = {r.id: r.cluster for r in M.dbscan(df, "id", "x", "y", eps=0.5, min_pts=5).collect()}
    assert len({out[i] for i in range(30)}) == 1 and len({out[i] for i in range(30, 60)}) == 1
    assert out[0] != out[30] and out[60] == -1


def test_near_duplicates_exact_jaccard(spark):
    base = " ".join(f"w{i}" for i in range(40))
    near = base.replace("w39", "zz")                  # 37 of 39 shingles shared
    df = spark.createDataFrame([(1, base), (2, near), (3, "completely different text here " * 3)],
                               "doc_id long, text string")
    reps = {r.doc_id: r.representative for r in X.near_duplicates(df, "doc_id", "text", 0.9).collect()}
    assert reps == {1: 1, 2: 1}


def test_corpus_jobs(spark):
    files = spark.createDataFrame([
        ("src/main.py", "import os\ndef run():\n    pass\nclass App:\n    pass\n", 60),
        ("src/utils/helpers.py", "def _private():\n    pass\ndef public():\n    pass\n", 50),
        ("tests/test_main.py", "def test_run():\n    pass\n", 30),
        ("node_modules/x/index.js", "function x() {}\n", 20),
        ("web/app.ts", "export function boot() {}\nexport class Shell {}\n", 40),
    ], "path string, content string, size long")
    langs = {r.language: r["count"] for r in K.language_counts(files).collect()}
    assert langs == {"Python": 3, "TypeScript": 1}
    top = K.rank_files(files).collect()
    assert top[0].path == "src/main.py"
    sym = {r.path: (r.functions, r.classes, r.is_test) for r in K.corpus_symbols(files).collect()}
    assert sym["src/main.py"] == (["run"], ["App"], False)
    assert sym["src/utils/helpers.py"][0] == ["public"] and sym["tests/test_main.py"][2]
    roles = {r.path: r.role for r in K.classify_files(files).collect()}
    assert roles["tests/test_main.py"] == "Testing" and roles["src/main.py"] == "Entry Point"


def test_unit_root_tests_classify_known_series():
    rng = np.random.default_rng(11)
    walk = np.cumsum(rng.normal(size=300))
    noise = rng.normal(size=300)
    assert not T.adf_numpy(walk)["adf_stationary"] and T.adf_numpy(noise)["adf_stationary"]
    assert not T.kpss_numpy(walk)["kpss_stationary"] and T.kpss_numpy(noise)["kpss_stationary"]
    assert abs(T.adf_pvalue(-2.86154) - 0.05) < 0.002
    p = T.pacf_numpy(np.sin(np.arange(200) / 3.0) + rng.normal(0, 0.01, 200), 5)
    assert abs(p[1]) > 0.9


def test_forecasts_follow_trend():
    y = np.arange(50, dtype=float) * 2 + 10
    params, fc = T.holt_numpy(y, 3)
    assert np.allclose(fc, [110, 112, 114], atol=1.0)
    params, fc = T.arima111_numpy(y + np.sin(np.arange(50)), 2)
    assert fc[0] > y[-1]
    info, fc, _ = T.var_numpy(np.column_stack([y, y * 0.5]), 2)
    assert fc.shape == (2, 2)


def test_cdc_and_quarantine_sinks(spark):
    from lakesmith.streaming import sinks as S
    root = tempfile.mkdtemp(prefix="ls-cdc-")
    fn = S.cdc_batch_fn(root, "k", "ts", ["k", "v"])
    fn(spark.createDataFrame([("c", 1, "a", 1), ("c", 2, "b", 1)], "op string, k int, v string, ts int"), 0)
    fn(spark.createDataFrame([("u", 1, "a2", 2), ("d", 2, None, 2)], "op string, k int, v string, ts int"), 1)
    fn(spark.createDataFrame([("d", 1, None, 3)], "op string, k int, v string, ts int"), 1)   # replay skipped
    t = S.VersionedTable(spark, root).read()
    assert [(r.k, r.v) for r in t.collect()] == [(1, "a2")]
    g, b = tempfile.mkdtemp(prefix="ls-good-"), tempfile.mkdtemp(prefix="ls-bad-")
    q = S.quarantine_batch_fn(g + "/o", b + "/o", [Q.not_null_rule("v")])
    q(spark.createDataFrame([(1, "x"), (2, None)], "k int, v string"), 0)
    assert spark.read.parquet(g + "/o").count() == 1 and spark.read.parquet(b + "/o").count() == 1


def test_cosine_join_chunks_match_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(9)
    base = rng.normal(size=(300, 8))
    queries = rng.normal(size=(20, 8))
    b = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(base)], "vec_id long, embedding array<double>")
    q = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(queries)], "query_id long, embedding array<double>")
    monkeypatch.setattr(X, "QUERY_CHUNK", 7)          # three chunks
    got = {(r.query_id, r.vec_id) for r in X.cosine_join(q, b, k=3, min_score=0.1).collect()}
    bn = base / np.linalg.norm(base, axis=1, keepdims=True)
    qn = queries / np.linalg.norm(queries, axis=1, keepdims=True)
    s = qn @ bn.T
    want = set()
    for i in range(len(queries)):
        top = [j for j in np.argsort(-s[i], kind="stable") if s[i, j] > 0.1][:3]
        want |= {(i, int(j)) for j in top}
    assert got == want


def test_exact_vector_duplicates(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0]), (2, [2.0, 4.0]), (3, [2.0, 1.0]), (4, [0.5, 1.0])],
                               "id long, v array<double>")
    reps = {r.id: r.representative for r in X.exact_vector_duplicates(df, "id", "v").collect()}
    assert reps == {1: 1, 2: 1, 4: 1}      # same direction after normalisation


def test_auc_by_model_noise_clusters_deep_files_and_row_limits(spark):
    p = spark.createDataFrame([(m, y, s if m == "good" else 1 - s) for m in ("good", "bad")
                               for y, s in ((1, 0.9), (1, 0.8), (0, 0.2), (0, 0.1))], "model string, actual int, score double")
    assert {r.model: r.auc_roc for r in M.binary_auc(p, model="model").collect()} == {"good": 1.0, "bad": 0.0}
    pts = spark.createDataFrame([(i, [float(i), 0.0], 0 if i < 5 else -1) for i in range(8)], "id int, v array<double>, label int")
    r = M.segment_metrics(pts, "id", "v", "label").first()
    assert (r.davies_bouldin, r.calinski_harabasz, r.clusters) == (9999.0, 0.0, 1)
    files = spark.createDataFrame([("a/b/c/d/e/f.py", 3), ("a/g.py", 4)], "path string, size long")
    got = {r["dir"]: (r["files"], r["bytes"]) for r in K.tree_sizes(files).collect()}
    assert got == {"a": (2, 7), "a/b": (1, 3), "a/b/c": (1, 3), "a/b/c/d": (1, 3)}
    days = spark.sql("select timestamp '2024-01-01' + make_interval(0, 0, 0, cast(id as int)) as t from range(5)")
    assert all(r.below_min_rows and not r.above_max_rows and r.total_rows == 5
               for r in Q.check_contract_volume(days, "t", 6, 10).collect())
