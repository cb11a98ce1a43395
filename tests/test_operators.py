import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from provsight.operators import graph as G
from provsight.operators import product as P
from provsight.operators import reconcile as D
from provsight.operators import rules as R
from provsight.sources import scans as S
from provsight.streaming import folds as ST


def test_cycle_members_share_the_last_wave(spark):
    edges = spark.createDataFrame([(2, 1), (3, 2), (3, 4), (4, 3), (5, 4)], "node long, dep long")
    nodes = spark.createDataFrame([(k,) for k in range(1, 6)], "node long")
    assert {r.node: r.wave for r in G.waves(nodes, edges).collect()} == {1: 1, 2: 2, 3: 3, 4: 3, 5: 3}
    assert [tuple(r) for r in G.cycles(edges).collect()] == [("3>4", 2)]


def test_substring_mode_blocks_longer_names(spark):
    rel = spark.createDataFrame([("Call_H", "Mid", "a"), ("Mid", "Call", "b")], "src string, dst string, cond string")
    paths = lambda **k: {r.path for r in G.relationship_paths(rel, **k).collect()}
    assert "Call_H>Mid>Call" in paths() and "Call_H>Mid>Call" not in paths(substring_compat=True)


def test_function_groups_reach_all_specifics(spark):
    refs = spark.createDataFrame([("a", "v", "F", "fn"), ("a", "v", "a", "gone"), ("a", "v", "zz", "x"), ("a", "v", "A", "V")], "src_db string, src_name string, ref_db string, ref_name string")
    objects = spark.createDataFrame([("A", "V", None), ("f", "fn_1", "fn"), ("f", "fn_2", "fn")], "db string, name string, base_name string")
    assert {tuple(r) for r in G.build_edges(refs, objects).collect()} == {("A.V", "F.FN_1", "internal"), ("A.V", "F.FN_2", "internal"), ("A.V", "A.GONE", "external_known_db"), ("A.V", "ZZ.X", "external")}


def test_long_loops_are_reported(spark):
    """A loop of 50 nodes, two loops of 12 and 14 through one node, a short loop, and tails that are on none."""
    ring = lambda nodes: list(zip(nodes, [*nodes[1:], nodes[0]]))
    edges = ring(list(range(100, 150))) + ring(list(range(200, 212))) + ring([200, *range(212, 225)]) + ring([1, 2, 3]) + [(3, 900), (901, 100)]
    df = spark.createDataFrame(edges, "node long, dep long")
    got = {r.cycle: r.length for r in G.cycles(df).collect()}
    assert got == {">".join(map(str, range(100, 150))): 50, ">".join(map(str, range(200, 212))): 12, "1>2>3": 3, ">".join(map(str, [200, *range(212, 225)])): 14}
    parts = {r.node: r.component for r in G.strong_components(df).collect()}
    assert parts == {k: 100 for k in range(100, 150)} | {k: 200 for k in range(200, 225)} | {k: 1 for k in (1, 2, 3)}


def test_dependants_end(spark):
    edges = spark.createDataFrame([(2, 1), (3, 2), (1, 3), (9, 8)], "node long, dep long")
    assert {r.node for r in G.dependants(edges, spark.createDataFrame([(1,)], "node long")).collect()} == {2, 3}


def test_prune_needs_one_rule(spark):
    df = spark.createDataFrame([(1, 1, None)], "k long, id long, ts date")
    with pytest.raises(ValueError):
        P.prune(df, ["k"], "ts", "id")


def test_definition_diff_only_for_drift(spark):
    a = spark.createDataFrame([(1, "x \ny"), (2, "p\nq")], "id long, t string")
    b = spark.createDataFrame([(1, "\nx\ny\n"), (2, "p\nr")], "id long, t string")
    rows = D.definition_diff(a, b, "id", "t").collect()
    assert [r.id for r in rows] == [2] and "-q" in rows[0].diff and "+r" in rows[0].diff


def test_policy_strict(spark):
    df = spark.createDataFrame([("a", "DROP x", None, None)], "path string, text string, kind string, phase string")
    with pytest.raises(ValueError):
        R.apply_policy(df, [{"mode": "deny", "pattern": "x"}], strict=True)
    assert R.apply_policy(df, [{"mode": "deny", "pattern": "x"}]).count() == 0
    scoped = [{"id": "r", "mode": "deny", "pattern": "DROP", "types": ["TABLE"]}]
    assert R.apply_policy(df, scoped).count() == 0


@pytest.mark.parametrize("body, rule, fires", [
    ("DROP TABLE A.T", "destructive_change", True), ("CREATE PROCEDURE A.P() BEGIN\nDROP TABLE A.T; END;", "destructive_change", False),
    ("ALTER TABLE A.T ADD c INTEGER NOT NULL", "data_dependent_change", True), ("ALTER TABLE A.T ADD c INTEGER NOT NULL DEFAULT 1", "data_dependent_change", False),
    ("ALTER TABLE A.T ADD c INTEGER DEFAULT 1", "expensive_change", True), ("BEGIN TRANSACTION;", "transaction_control", True), ("CREATE TABLE T (k INT)", "db_qualifier", True),
    ("CREATE VOLATILE TABLE T (k INT)", "db_qualifier", False), ("CREATE TABLE A.T (k INT)", "set_multiset", True), ("CREATE MULTISET TABLE A.T (k INT);", "set_multiset", False),
    ("GRANT SELECT ON A.T TO r;", "object_level_grant", True), ("GRANT SELECT ON A TO r;", "object_level_grant", False), ("REPLACE VIEW A.V AS SELECT 1", "view_column_list", True),
    ("REPLACE VIEW A.V (x) AS SELECT 1", "view_column_list", False), ("CREATE TABLE {{D_V}}.T (k INT)", "token_naming", True), ("CREATE TABLE {{D_T}}.T (k INT)", "hardcoded_name", False),
    ("CREATE TABLE A.T (k INT)", "ddl_terminator", True), ("CREATE TABLE A.T (k INT);", "ddl_terminator", False), ("create table a.b as (select x from y where z and q or r)", "keyword_case", True),
    ("COMMENT ON TABLE A.T IS '" + "x" * 255 + "'", "comment_length", True), ("CREATE TABLE A.X_TBL (k INT)", "type_suffix", True),
])
def test_builtin_rule(spark, body, rule, fires):
    got = {r.rule for r in R.inspect(spark.createDataFrame([(1, body)], "id long, body string"), "id").collect()}
    assert (rule in got) == fires


def test_scans(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.tbl").write_text("CREATE TABLE\nA.T")
    (tmp_path / "a" / "_y.tbl").write_text("no")
    (tmp_path / "a" / "z.txt").write_text("no")
    assert [(r.ext, r.text) for r in S.read_corpus(spark, str(tmp_path), [".TBL"]).collect()] == [("tbl", "CREATE TABLE\nA.T")]
    (tmp_path / "DEV.conf").write_text("# c\nA = 1\nB=x=y\nA=2\n")
    assert {(r.env, r.name, r.value) for r in S.read_kv(spark, [str(tmp_path / "DEV.conf")]).collect()} == {("DEV", "A", "2"), ("DEV", "B", "x=y")}
    log = {"schema_version": "1", "runs": [{"run_id": "r", "started_at": "t", "status": "ok", "stages": [{"name": "inspect", "status": "ok", "issues": [{"file": "f", "rule": "q", "severity": "error", "message": "m"}]}, {"name": "ship", "status": "ok", "issues": []}]}]}
    (tmp_path / "log.json").write_text(json.dumps(log))
    runs, stages, issues = S.read_run_log(spark, [str(tmp_path / "log.json")])
    assert (runs.count(), stages.count(), issues.count()) == (1, 2, 1)
    (tmp_path / "bad.json").write_text(json.dumps(log | {"schema_version": "99"}))
    with pytest.raises(Exception, match="unknown schema_version"):
        S.read_run_log(spark, [str(tmp_path / "bad.json")])[0].collect()
    (tmp_path / "rel.json").write_text(json.dumps({"environment": "DEV", "name": "n", "timestamp": "t", "build": 3, "packages": [{"file": "a"}, {"file": "b", "sha256": "h"}]}))
    assert S.read_release_groups(spark, [str(tmp_path / "rel.json")]).count() == 2


def test_sinks(spark, tmp_path):
    edges = spark.createDataFrame([(2, 1), (3, 1)], "node long, dep long")
    S.write_edges_csv(edges, spark.createDataFrame([(1, "TABLE"), (2, "VIEW")], "node long, kind string"), str(tmp_path / "e"))
    assert spark.read.option("header", True).csv(str(tmp_path / "e")).count() == 2
    for k in (1, 2):
        S.append_audit(spark.createDataFrame([(k,)], "n int"), str(tmp_path / "audit"))
    assert spark.read.json(str(tmp_path / "audit")).count() == 2
    assert len({json.loads(r.value)["run"]["runId"] for r in S.lineage_events(edges, "ns").collect()}) == 2
    assets = spark.createDataFrame([("a", "TABLE")], "asset string, subtype string")
    columns = spark.createDataFrame([("a", 1, "k", "INTEGER"), ("a", 2, "n", "CHAR(3)")], "asset string, pos int, name string, type string")
    none = spark.createDataFrame([], "asset string, upstream string")
    assert [S.catalog_proposals(assets, columns, none, "p", x).count() for x in ("aspects", "nested", "flat")] == [3, 1, 2]


def _events(spark):
    t = lambda m: dt.datetime(2024, 1, 1, 0, m)
    rows = [("o", 1, t(1), "PENDING", None), ("o", 2, t(2), "CREATED", None), ("o", 3, t(3), "COMPLETED", None), ("p", 4, t(1), "PENDING", None), ("p", 5, t(2), "MIGRATED", None),
            ("q", 6, t(1), "PENDING", None), ("q", 8, t(3), "FAILED", "disk"), ("q", 9, t(4), "CREATED", None), ("r", 10, t(1), "DROPPED", None), ("r", 12, t(4), "COMPLETED", None), ("r", 11, t(2), "FAILED", "late")]
    return spark.createDataFrame(rows, "object string, seq long, ts timestamp, state string, error string")


def test_fold_follows_the_declared_states(spark):
    got = {r.object: r for r in ST.fold_state(_events(spark)).collect()}
    assert (got["o"].n_illegal, got["p"].n_illegal, got["q"].n_illegal, got["r"].n_illegal) == (0, 1, 0, 0)
    assert got["q"].error == "disk" and got["q"].completed_at.minute == 3 and got["q"].state == "CREATED"  # a new attempt keeps the last error
    assert got["r"].error is None and got["r"].completed_at.minute == 4


def test_stream_fold_agrees(spark, tmp_path):
    pytest.importorskip("google.protobuf")
    events, out = _events(spark), {}
    for k, cond in enumerate(("seq in (1, 4, 6, 9, 10, 12)", "seq in (2, 3, 5, 8, 11)")):  # 8 and 11 come late
        events.where(cond).coalesce(1).write.parquet(str(tmp_path / f"in/b{k}"))
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    q = ST.fold_state_stream(stream).writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "cp")).foreachBatch(lambda df, _: out.update({r.object: tuple(r) for r in df.collect()})).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    assert out == {r.object: tuple(r) for r in ST.fold_state(events).collect()}


def test_stream_fold_forgets_ended_objects(spark, tmp_path):
    """Ten batches of objects that end: each is folded right, late events inside the watermark included, and their states go."""
    pytest.importorskip("google.protobuf")
    t = lambda d, h: dt.datetime(2024, 1, 1) + dt.timedelta(days=d, hours=h)
    schema = "object string, seq long, ts timestamp, state string, error string"
    rows, seq = [], 0
    for k in range(10):
        batch = [(f"o{k}", "PENDING", t(3 * k, 0)), (f"o{k}", "COMPLETED", t(3 * k, 5)), ("long", "FAILED" if k % 2 else "MIGRATED", t(3 * k, 1))]
        batch += [(f"o{k - 1}", "CREATED", t(3 * k - 3, 2))] if k else []  # late, but not too late
        rows.append([(o, seq := seq + 1, at, s, None) for o, s, at in batch])
        spark.createDataFrame(rows[-1], schema).coalesce(1).write.parquet(str(tmp_path / f"in/b{k}"))
    out, sizes = {}, []
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    folded = ST.fold_state_stream(stream, "4 days", 1)
    q = folded.writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "cp")).foreachBatch(lambda df, _: out.update({r.object: tuple(r) for r in df.collect()})).start()
    try:
        q.processAllAvailable()
        sizes = [p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]]
    finally:
        q.stop()
    want = {r.object: tuple(r) for r in ST.fold_state(spark.createDataFrame([r for b in rows for r in b], schema)).collect()}
    assert out == want and sizes[-1] <= max(sizes[3:6])


def test_stream_counts_agree(spark, tmp_path):
    rows = [{"ts": f"2024-01-0{1 + k % 3}T00:00:0{k}Z", "outcome": "ok" if k % 2 else "bad", "target": "t"} for k in range(9)]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text("\n".join(map(json.dumps, rows)))
    q = ST.audit_counts_stream(spark, str(tmp_path / "in")).writeStream.outputMode("complete").format("memory").queryName("audit_counts").option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    batch = ST.audit_counts(spark.read.schema("ts timestamp, outcome string, target string").json(str(tmp_path / "in")))
    assert sorted(map(tuple, spark.table("audit_counts").collect())) == sorted(map(tuple, batch.collect()))


def test_stream_pairs_agree(spark, tmp_path):
    """Runs over several batches agree with the batch twin; a start that nothing ends is abandoned, and state goes."""
    t = lambda m, d=1: dt.datetime(2024, 1, d, 0, m)
    rows = [[("a", "START", t(1), None, None), ("b", "START", t(2), None, None), ("c", "FAIL", t(2), ["x"], ["y"])],
            [("a", "COMPLETE", t(3), ["o2", "o1"], None), ("d", "START", t(4), None, None), ("d", "FAIL", t(5), ["o3"], ["f2", "f1"])], [("e", "START", t(1, 9), None, None)], [("f", "START", t(2, 9), None, None)]]
    schema = "run_id string, kind string, ts timestamp, outputs array<string>, failed array<string>"
    for k, batch in enumerate(rows):
        spark.createDataFrame(batch, schema).coalesce(1).write.parquet(str(tmp_path / f"in/b{k}"))
    last, said = {}, []

    def keep(df, _):
        for r in df.collect():
            last[r.run_id] = tuple(r)
            said.append((r.run_id, r.outcome))

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    q = ST.pair_runs_stream(stream).writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "cp")).foreachBatch(keep).start()
    try:
        q.processAllAvailable()
        kept = q.lastProgress.stateOperators[0].numRowsTotal if hasattr(q.lastProgress, "stateOperators") else q.lastProgress["stateOperators"][0]["numRowsTotal"]
    finally:
        q.stop()
    events = spark.createDataFrame([r for batch in rows for r in batch], schema)
    want = {r.run_id: tuple(r) for r in ST.pair_runs(events, F.lit(t(2, 9)), "1 day").collect()}
    assert last == want and want["b"][4] == "abandoned" and want["d"][4:] == ("failed", "o3", "f1,f2") and want["c"][4] == "orphan"
    assert said.count(("b", "abandoned")) == 1 and kept == 2  # only the runs of the last day have state


def test_equal_rows_keep_their_number(spark):
    rows = spark.createDataFrame([("ddl\\a.tbl:4", 1)] * 2 + [("b", 2)], "location string, n int")
    sources = spark.createDataFrame([("payload/ddl/a.tbl", "s")], "path string, source string")
    assert sorted(map(tuple, P.source_of(rows, sources, "location").collect()), key=str) == [("b", 2, None), ("ddl\\a.tbl:4", 1, "s"), ("ddl\\a.tbl:4", 1, "s")]


def test_conform_refuses_blocked_schemas(spark):
    old = spark.createDataFrame([("t", "a", "CHAR", 10)], "tab string, name string, type string, length int")
    new = spark.createDataFrame([("t", "a", "CHAR", 5, 0, 0)], "tab string, name string, type string, length int, not_null int, has_default int")
    changes, df = D.schema_compat(old, new), spark.createDataFrame([("x",)], "a string")
    with pytest.raises(ValueError, match="a"):
        D.conform(df, [("a", "string", None)], changes)
    assert D.conform(df, [("a", "string", None)], changes.limit(0))[0].count() == 1


def test_contract_changes_come_from_one_join(spark):
    """All changes of a column, also several of one, and the joins of base and now stand in the plan once."""
    from provsight.operators import reconcile as D

    schema = "object string, kind string, pos int, name string, type string, direction string"
    base = [("v", "VIEW", 1, "a", "I", None), ("v", "VIEW", 2, "b", "I", None), ("v", "VIEW", 3, "c", "I", None), ("p", "PROCEDURE", 1, "a", "I", "IN"), ("g", "VIEW", 1, "a", "I", None), ("k", "VIEW", 1, "a", "I", None)]
    now = [("v", "VIEW", 2, "a", "Z", None), ("v", "VIEW", 1, "b", "I", None), ("p", "PROCEDURE", 1, "a", "Z", "OUT"), ("k", "TABLE", 1, "a", "I", None)]
    got = D.contract_diff(spark.createDataFrame(base, schema), spark.createDataFrame(now, schema))
    assert sorted(((r["object"], r["name"] or "", r["change"]) for r in got.collect())) == sorted([
        ("v", "a", "type_changed"), ("v", "a", "reordered"), ("v", "b", "reordered"), ("v", "c", "column_removed"), ("p", "a", "type_changed"), ("p", "a", "direction_changed"), ("g", "", "object_removed"), ("k", "", "kind_changed")])
    assert got._jdf.queryExecution().optimizedPlan().toString().count("Join ") <= 4
