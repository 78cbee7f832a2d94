import datetime as dt
import json

import pytest
from pyspark.sql import functions as F
from wardline.sources import notes
from wardline.streaming import ingest


def test_notes(spark, tmp_path):
    good = tmp_path / "good.jsonl"
    good.write_text("\n".join(json.dumps(x) for x in [{"uid": "1", "name": "A", "raw_text": "t"}, {"uid": "2", "name": "B", "raw_text": "u", "filename": "f"}]))
    assert notes.notes_jsonl(spark, str(good)).count() == 2
    for line in ('{"uid": "1", "name": "A"}', "{broken", '{"uid": "1", "name": "A", "raw_text": "t"}'):
        bad = tmp_path / "bad.jsonl"
        bad.write_text(good.read_text() + "\n" + line)
        with pytest.raises(ValueError):
            notes.notes_jsonl(spark, str(bad)).count()
    folder = tmp_path / "raw"
    folder.mkdir()
    (folder / "ann_o'hara_0a1b2c3d.txt").write_text("one\ntwo")
    r = notes.notes_text(spark, str(folder)).first()
    assert (r.uid, r.name, r.raw_text) == ("0a1b2c3d", "Ann O'hara", "one\ntwo")
    (tmp_path / "x.rrf").write_text('C1|a "b|c|\nC2||d|\n')
    assert [tuple(x) for x in notes.rrf(spark, str(tmp_path / "x.rrf"), ["cui", "x", "y"]).collect()] == [("C1", 'a "b', "c"), ("C2", None, "d")]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, [("a", 2)])], "k int, s array<struct<x:string,y:int>>")
    notes.write_tables({"t": df}, str(tmp_path / "p"))
    notes.write_tables({"t": df}, str(tmp_path / "c"), csv=True)
    notes.write_spans(df, str(tmp_path / "j"))
    assert spark.read.parquet(str(tmp_path / "p/t")).collect() == df.collect()
    assert json.loads(spark.read.option("header", "true").option("escape", "\\").csv(str(tmp_path / "c/t")).first().s) == [{"x": "a", "y": 2}]
    assert spark.read.json(str(tmp_path / "j")).first().k == 1


def test_log(spark, tmp_path):
    raw = spark.createDataFrame([("a", "q", "2025-01-01T00:00:00+00:00Z", "ok", "{}"), ("a", "q2", "2025-01-02 00:00:00", "ok", "{}"), ("b", "q", "never", "ok", "{}"), (None, "q", None, "ok", "{}")], "request_id string, user_query string, request_timestamp string, run_status string, payload_json string")
    rows = notes.log_rows(raw)
    got = {r.request_id: r for r in rows.collect()}
    assert set(got) == {"a", "b"} and got["a"].request_timestamp == dt.datetime(2025, 1, 1) and got["a"].user_query == "q" and got["b"].request_timestamp is not None
    path = str(tmp_path / "log")
    assert notes.append_log(spark, rows, path) == 2
    assert notes.append_log(spark, rows, path) == 2


def test_stream(spark, tmp_path):
    schema = "event_id bigint, normalized_term string, value double, charted_at timestamp, loaded_at timestamp"
    t = lambda d: dt.datetime(2025, 1, d)
    a = spark.createDataFrame([(1, "x", 1.0, t(1), t(1)), (2, "x", 2.0, t(1), t(2))], schema)
    b = spark.createDataFrame([(1, "x", 9.0, t(1), t(3)), (1, "x", 5.0, t(1), t(2)), (3, "y", 3.0, t(3), t(3))], schema)
    folder, table = str(tmp_path / "in"), str(tmp_path / "table")
    a.coalesce(1).write.mode("append").parquet(folder)
    stream = ingest.event_stream(spark, folder, a.schema, 1)
    ingest.run_available(stream, ingest.upsert(spark, table), str(tmp_path / "ckpt"))
    b.coalesce(1).write.mode("append").parquet(folder)
    ingest.run_available(stream, ingest.upsert(spark, table), str(tmp_path / "ckpt"))
    now = ingest.current(spark, table)
    assert sorted((r.event_id, r.value) for r in now.collect()) == [(1, 9.0), (2, 2.0), (3, 3.0)]
    ingest.upsert(spark, table)(b, max(ingest.versions(spark, table)))  # the last batch once more
    assert sorted((r.event_id, r.value) for r in ingest.current(spark, table).collect()) == [(1, 9.0), (2, 2.0), (3, 3.0)]
    q = ingest.arrivals(stream).writeStream.format("memory").queryName("seen").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.sql("select sum(n) n from seen").first().n == 5
    d = ingest.without_repeats(ingest.event_stream(spark, folder, a.schema)).writeStream.format("memory").queryName("once").trigger(availableNow=True).start()
    d.awaitTermination()
    assert spark.table("once").select(F.count_distinct("normalized_term", "value", "charted_at").alias("n")).first().n == 5


def test_upsert_rewrites_touched_parts_only(spark, tmp_path):
    table = str(tmp_path / "t")
    rows = lambda *x: spark.createDataFrame([(i, v, dt.datetime(2025, 1, d)) for i, v, d in x], "event_id bigint, value double, loaded_at timestamp")
    put = ingest.upsert(spark, table, parts=8)
    put(rows(*[(i, float(i), 1) for i in range(40)]), 0)
    assert set(ingest.written(spark, table)) == set(range(8))
    for batch in range(1, 5):
        put(rows((7, 100.0 + batch, 1 + batch)), batch)
    put(rows(), 5)
    have = ingest.written(spark, table)
    assert sorted(map(len, have.values())) == [1] * 7 + [2] and [3, 4] in have.values()
    now = {r.event_id: r.value for r in ingest.current(spark, table).collect()}
    assert now == {i: 104.0 if i == 7 else float(i) for i in range(40)}
    put(rows((7, 204.0, 5)), 4)  # the last batch once more, with other rows
    assert {r.event_id: r.value for r in ingest.current(spark, table).collect()}[7] == 204.0
    assert ingest.current(spark, str(tmp_path / "none")) is None


def test_term_stats(spark):
    df = spark.createDataFrame([("a", "p"), ("a", "p"), ("a", "q"), (None, "p")], "normalized_term string, patient_id string")
    assert {tuple(r) for r in notes.term_stats(df).collect()} == {("a", 3, 2), (None, 1, 1)}
