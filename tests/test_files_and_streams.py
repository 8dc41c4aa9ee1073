"""Readers, writers and streams on small files."""

import pytest
from pyspark.sql import functions as F

from lumentrace.engine import register_functions
from lumentrace.functions import scalars as S
from lumentrace.operators import series
from lumentrace.plans import bindings as B
from lumentrace.sources import files
from lumentrace.streaming import operators as ST

SF = "/root/testdata/sf0.001"


def test_rules_and_paths(spark, tmp_path):
    (tmp_path / "rules.csv").write_text("FunctionType,EventName,ActionType,ActionTarget,OutputAlarm\n\n# note\nA,e, Report Locally ,B,x\nA,e,,B,x\nC,f,Transmit Upstream,D,y\n")
    rows = [tuple(r) for r in files.read_rules(spark, str(tmp_path / "rules.csv")).collect()]
    assert rows == [(1, "A", "e", "Report Locally", "B", "x"), (3, "C", "f", "Transmit Upstream", "D", "y")]
    (tmp_path / "paths.txt").write_text("ROADM1-XCON1-SRC, ROADM1-OA2$0\n\nROADM2-RegenIn3-RELAY,ROADM2-LINE0004$0-ODUk-termination\n")
    got = [tuple(r)[1:] for r in files.read_lightpaths(spark, str(tmp_path / "paths.txt")).orderBy("path_id", "pos").collect()]
    assert got == [(1, 2, "ROADM1-XCON001$0", "ROADM1", "XCON", "SRC"), (2, 2, "ROADM1-OA002$0", "ROADM1", "OA", ""), (1, 2, "ROADM2-RegenIn00003$0", "ROADM2", "REGENIN", "RELAY"), (2, 2, "ROADM2-LINE0004$0", "ROADM2", "LINE", "TERMINATION")]


def test_failures_resolve_aliases(spark, tmp_path):
    (tmp_path / "f.csv").write_text("Node,Alarm,Start,Duration_Ms,Board_Role\nb1,Fiber_Cut,2024-01-02 03:04:05,500,source\n,x,,,\nb2,y,86400,abc,\n")
    rows = files.read_failures(spark, str(tmp_path / "f.csv")).orderBy("board").collect()
    assert [(r["board"], r["event"], str(r["time"]), r["duration_ms"], r["role"]) for r in rows] == [("b1", "Fiber_Cut", "2024-01-02 03:04:05", 500.0, "SRC"), ("b2", "y", "1970-01-02 00:00:00", None, "")]


def test_node_metrics_and_trees(spark, tmp_path):
    for n in (1, 2):
        d = tmp_path / f"Node_{n}"
        d.mkdir()
        (d / "timeseries_a.csv").write_text("t,board,BBE,BBER,ES\n0,b,1.5,0,0\n1,b,oops,0,0\n")
        (d / "results.csv").write_text("model,acc\nm,0.5\n")
    assert files.read_node_metrics(spark, str(tmp_path)).groupBy("node").count().count() == 2
    assert {r["experiment"] for r in files.read_result_tree(spark, str(tmp_path), "results.csv").collect()} == {"Node_1", "Node_2"}
    (tmp_path / "c.csv").write_text("gt,A,B\nA,3,1\nB,0,2\n")
    assert files.read_confusion_wide(spark, str(tmp_path / "c.csv")).agg(F.sum("n")).first()[0] == 6


def test_outputs_keep_malformed_lines(spark, tmp_path):
    (tmp_path / "o.jsonl").write_text('{"sample_index": 1, "model_output": "x"}\n{broken\n')
    df = files.read_outputs(spark, str(tmp_path / "o.jsonl")).cache()
    assert df.filter("_corrupt is not null").count() == 1 and df.filter("sample_index = 1").count() == 1


def test_corpus_and_pairs(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub/a.txt").write_text("hello\nworld")
    (tmp_path / "b.md").write_text("no")
    assert [r["text"] for r in files.read_corpus(spark, str(tmp_path), "txt").collect()] == ["hello\nworld"]
    (tmp_path / "p.dat").write_text("{('A', 'B'): 0.5, ('C','D'): 1}")
    assert [tuple(r) for r in files.read_pair_scores(spark, str(tmp_path / "p.dat")).collect()] == [("A", "B", 0.5), ("C", "D", 1.0)]


def test_ow_dataset_round_trip(spark, tmp_path):
    m = spark.createDataFrame([(1, 0, "b", 0, 1.0), (2, 1, "c", 0, 2.0)], "ow_id long, domain_id int, board_id string, t int, BBE double")
    a = spark.createDataFrame([(1, "b", "LOS", 0), (1, "c", "AIS", 1)], "ow_id long, board string, alarm string, hop int")
    files.write_ow_dataset(m, a, m.select("ow_id", "domain_id"), str(tmp_path / "ow"))
    back = files.read_ow_dataset(spark, str(tmp_path / "ow"))
    assert back["metrics"].count() == 2 and back["alarms"].select(F.explode("alarms")).count() == 2 and back["labels"].count() == 2


@pytest.mark.parametrize(
    ("text", "event"),
    [("Root cause: Fiber Cut at x", "Fiber_Cut"), ("Event: XCON_Port_Down or Fiber_Cut", "Fiber_Cut"), ("we think line_disconnect", "Line_Disconnect"), ("", None), (None, None), ("Fiber_Crack. Root cause: Fiber_Aging", "Fiber_Aging")],
)
def test_event_in_text(spark, text, event):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(S.event_in_text(F.col("t"))).first()[0] == event


def test_scalars(spark):
    df = spark.createDataFrame([("500ms", "ROADM1-OA2", "Port_Down"), ("3 s", "ROADM1-RegenOut7$1", "xcon fabric fault"), ("x", "?", "?")], "a string, b string, c string")
    got = [tuple(r) for r in df.select(S.parse_step_seconds(F.col("a")), S.normalize_board_id(F.col("b")), S.normalize_event(F.col("c"))).collect()]
    assert got == [(1, "ROADM1-OA002$0", "XCON_Port_Down"), (3, "ROADM1-RegenOut00007$1", "XCON_Fabric_Fault"), (1, "?", None)]


def test_table_function(spark):
    register_functions(spark)
    assert [tuple(r) for r in spark.sql("SELECT * FROM chunk_text('abcdef', 4, 1)").collect()] == [(0, "abcd"), (1, "def")]


@pytest.fixture(scope="module")
def stream(spark, tmp_path_factory):
    """Events as a file source, in order of time."""
    path = str(tmp_path_factory.mktemp("events"))
    B.events(spark, SF).orderBy("ts").coalesce(1).write.mode("overwrite").parquet(path)
    schema = spark.read.parquet(path).schema
    return lambda: spark.readStream.schema(schema).parquet(path)


def drain(spark, df, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table(name)


def test_stream_board_max(spark, stream):
    got = drain(spark, ST.stream_board_max(stream()), "peaks", "complete").collect()
    want = B.events(spark, SF).groupBy(F.window("ts", "1 day").alias("w"), "board").agg(F.max("value").alias("peak"), F.count(F.lit(1)).alias("n"))
    assert {tuple(r) for r in got} == {tuple(r) for r in want.select("board", "w.start", "peak", "n").collect()}


def test_stream_bursts(spark, stream):
    got = {tuple(r) for r in drain(spark, ST.stream_bursts(stream(), 0.0), "bursts").collect()}
    want = {tuple(r) for r in series.stream_alarms_sessions(B.events(spark, SF).filter("value > 0"), "2 hours").collect()}
    assert got and got <= want


def test_stream_dedupe_and_join(spark, stream):
    n = B.events(spark, SF).select("board", "alarm", "ts").distinct().count()
    assert drain(spark, ST.stream_flow_dedupe(stream()), "dedupe").count() == n
    got = drain(spark, ST.stream_alarms_after_failure(stream(), "6 hours"), "after").filter("event_id is not null").groupBy("failure_id").count().collect()
    want = series.alarms_after_failure(B.events(spark, SF), 6 * 3600).filter("n_after > 0").collect()
    assert {(r["failure_id"], r["count"]) for r in got} == {(r["event_id"], r["n_after"]) for r in want}


def test_stream_local_alarms(spark, tmp_path):
    """Samples in any order within the allowed lateness give what the batch form gives; later ones are dropped."""
    import random
    from datetime import datetime, timedelta

    rng, start = random.Random(3), datetime(2024, 1, 1)
    rows = [(b, b * 1000 + i, start + timedelta(minutes=i), float(rng.choice([0, 1, 2, 3, 4, 6, 9]))) for b in range(1, 5) for i in range(60)]
    schema = "board long, event_id long, ts timestamp, value double"
    # Files of twenty minutes each, shuffled inside; a sample may come a file later. The last file moves the watermark on.
    parts = [[] for _ in range(6)]
    for r in rows:
        k = int((r[2] - start).total_seconds() // 1200)
        parts[k + (rng.random() < 0.4)].append(r)
    too_late = (1, 9, start - timedelta(hours=3), 99.0)
    parts[4].append((99, 1, start + timedelta(hours=5), 0.0))
    parts[5] += [too_late, (99, 2, start + timedelta(hours=9), 0.0)]
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        (tmp_path / "in").mkdir()
        for part in parts:
            rng.shuffle(part)
            spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
            df = ST.stream_local_alarms(spark.readStream.schema(schema).parquet(str(tmp_path / "in")))
            q = df.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
            assert q.awaitTermination(180)
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    got = spark.read.parquet(str(tmp_path / "out")).filter("board < 99").select("board", "event_id", "value", "alarm").collect()
    batch = spark.createDataFrame(rows, schema).withColumns({"t": F.col("event_id"), "bbe": F.col("value")})
    want = series.local_alarms(batch).select("board", "t", "bbe", "alarm").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and len(got) > 50


def test_stream_append(spark, stream, tmp_path):
    ST.stream_ow_append(stream(), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == B.events(spark, SF).count()


def test_written_tables_can_be_cleared(spark):
    from pathlib import Path

    from lumentrace.sources import storage

    shared = Path(spark.conf.get("spark.checkpoint.dir"))
    table = storage.materialise(spark.range(5), "some")
    assert table.count() == 5 and any(p.name.startswith("some-") for p in shared.iterdir())
    storage.remove(spark, table._lt_path)
    assert not any(p.name.startswith("some-") for p in shared.iterdir())


def test_csv_table_equals_csv_rows(spark):
    from lumentrace.operators import texts as X

    register_functions(spark)
    blocks = [(1, "Board, Alarm ,Hop\nb1,LOS,0\n\n b2 , AIS,1,x\nshort,row\n"), (2, ""), (3, None), (4, "Alarm,Other\nA,1\nB,2"), (5, "a,b,c,d,e,f,g,Board\n1,2,3,4,5,6\n1,2,3,4,5\n1,2,3,4,5,6,7,z")]
    df = spark.createDataFrame(blocks, "id long, block string")
    df.createOrReplaceTempView("blocks")
    got = spark.sql("SELECT id, n, Board, Alarm, Hop FROM blocks, LATERAL csv_table(block, 'Board,Alarm,Hop')")
    assert got.columns == ["id", "n", "Board", "Alarm", "Hop"]
    long = X.csv_rows(df, "id", "block")
    seen = {(r["id"], r["n"], c): r[c] for r in got.collect() for c in ("Board", "Alarm", "Hop") if r[c] is not None}
    assert seen == {(r["id"], r["n"], r["column"]): r["value"] for r in long.filter("column in ('Board', 'Alarm', 'Hop')").collect()}
    assert len(seen) == 9
    with pytest.raises(Exception, match="constant"):
        spark.sql("SELECT * FROM blocks, LATERAL csv_table(block, block)").collect()


def test_windows_round_trip_without_exchange(spark, tmp_path):
    from lumentrace.sources import windows as WN

    root = str(tmp_path / "ow")
    make = spark.createDataFrame
    parts = {
        "metrics": make([(w, 0, f"b{i}", t, float(t), 0.0, 0.0, 0) for w in range(40) for i in range(3) for t in range(5)], WN.SCHEMAS["metrics"]),
        "alarms": make([(w, "b1", "LOS", 0) for w in range(0, 40, 2)] + [(0, "b0", "AIS", 1)], "ow_id long, board string, alarm string, hop int"),
        "labels": make([(w, 0, "b1" if w % 3 else None) for w in range(40)], "ow_id long, domain_id int, root_board string"),
        "boards": make([(0, "n1", f"b{i}", "OA", "optical") for i in range(3)], WN.SCHEMAS["boards"]),
        "edges": make([(0, "b0", "b1"), (0, "b1", "b2")], WN.SCHEMAS["edges"]),
        "lightpaths": make([(1, ["b0", "b1", "b2"], ["n1"], 0)], WN.SCHEMAS["lightpaths"]),
        "services": make([("s", 1, 2, [1, 2], ["1-2"])], WN.SCHEMAS["services"]),
    }
    counts = WN.write_windows(parts, root, "ow_test", 4)
    assert counts == {"metrics_n": 600, "metrics_last_t": 4, "alarms_n": 20, "alarms_n_alarms": 21, "labels_n": 40, "labels_unlabelled": 14}
    for part in WN.WINDOWED:
        spark.sql(f"DROP TABLE ow_test_{part}")
    back = WN.read_windows(spark, root, "ow_test")
    assert set(back) == {*WN.SCHEMAS, "domain_stats", "stats"}
    for part in (*WN.STATIC, "metrics"):
        assert back[part].schema == parts[part].schema and sorted(map(str, back[part].collect())) == sorted(map(str, parts[part].collect()))
    assert [tuple(r) for r in back["domain_stats"].collect()] == [(0, 1, 3, 2, 1, 3.0)]
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        whole = WN.windows(back)
        assert "Exchange" not in whole._jdf.queryExecution().executedPlan().toString()
        rows = {r["ow_id"]: r for r in whole.collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert len(rows) == 40 and all(r["samples"] == 15 for r in rows.values())
    assert [a["alarm"] for a in rows[0]["alarms"]] == ["AIS", "LOS"] and rows[1]["alarms"] == []
    again = WN.write_windows(parts | {"labels": parts["labels"].limit(3)}, root, "ow_test", 4)
    assert again["labels_n"] == 3 and WN.read_windows(spark, root, "ow_test")["labels"].count() == 3


def test_scores_of_a_rerun_replace_their_own(spark, tmp_path):
    from lumentrace.sources import windows as WN

    schema = "model_name string, sample_index int, gt_event string, pred_event string, event_correct int, e2e_score double"
    one = spark.createDataFrame([("m1", 1, "Fiber_Cut", "Fiber_Cut", 1, 1.0), ("m1", 2, "Fiber_Cut", "guess", 0, 0.0), ("m2", 1, "Fiber_Crack", None, 0, 0.25)], schema)
    root = str(tmp_path / "scores")
    assert WN.write_scores(one, root) == {"rows": 3}
    assert WN.write_scores(one.filter("model_name = 'm1'").limit(1), root) == {"rows": 1}
    back = WN.read_scores(spark, root)
    assert back["per_example"].groupBy("model_name").count().orderBy("model_name").collect() == [("m1", 1), ("m2", 1)]
    assert {r["model_name"]: (r["n_examples"], r["event_correct"], r["e2e_score"]) for r in back["summary"].collect()} == {"m1": (1, 1.0, 1.0), "m2": (1, 0.0, 0.25)}
    table = {(r["model_name"], r["gt"]): r for r in back["confusion"].collect()}
    assert len(table) == 2 * len(WN.LABELS) and table["m1", "Fiber_Cut"]["Fiber_Cut"] == 1 and table["m2", "Fiber_Crack"]["(none)"] == 1
    assert sum(r[label] for r in table.values() for label in WN.LABELS) == 2
