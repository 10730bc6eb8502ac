"""Streams: ids as keyed state, topics, late messages."""

import json
import os

from quillspark.streaming import ingest


def _add(path, name, rows):
    os.makedirs(path, exist_ok=True)
    with open(f"{path}/{name}.json", "w") as f:
        f.writelines(json.dumps({"source_file": s, "text": t}) + "\n" for s, t in rows)


def test_a_batch_looks_up_its_own_ids_alone(spark, tmp_path):
    src, store, mark = (str(tmp_path / x) for x in ("in", "store", "mark"))
    long = lambda i: f"paragraph number {i} is long enough to be kept as an entry of its own"
    seen, totals = set(), []
    for run in range(4):
        rows = [(f"s{i}", long(i)) for i in range(run * 20, run * 20 + 40)]  # half of them came before
        _add(src, f"f{run}", rows)
        q = ingest.ingest(spark, src, store, mark)
        q.awaitTermination()
        state = [p["stateOperators"][0] for p in q.recentProgress if p["numInputRows"]]
        assert sum(s["numRowsUpdated"] for s in state) == len(set(rows) - seen)
        seen |= set(rows)
        totals.append(state[-1]["numRowsTotal"])
        assert spark.read.parquet(store).count() == len(seen) == totals[-1]
    files = [f for _, _, fs in os.walk(store) for f in fs if f.endswith(".parquet")]
    assert len(files) <= 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_only_what_is_new_is_described(spark, tmp_path, monkeypatch):
    src, store, mark = (str(tmp_path / x) for x in ("in", "store", "mark"))
    rows = [(f"s{i % 10}", f"Printer number {i % 10} is described in a paragraph of its own") for i in range(30)]
    given, plain = [], ingest.described

    def described(new):
        new = new.persist()
        given.append((new.columns, new.count()))
        return plain(new)

    monkeypatch.setattr(ingest, "described", described)
    for run in range(2):  # the same texts again in a new file
        _add(src, f"f{run}", rows)
        ingest.ingest(spark, src, store, mark).awaitTermination()
    assert given == [(["id", "source_file", "seq", "content"], 10), (["id", "source_file", "seq", "content"], 0)]
    got, want = spark.read.parquet(store), ingest.entries_of(spark.createDataFrame(rows, "source_file string, text string")).distinct()
    assert got.columns[:7] == want.columns and sorted(map(str, got.drop("batch").collect())) == sorted(map(str, want.collect()))


def test_a_store_of_another_writer(spark, tmp_path):
    src, store, mark = (str(tmp_path / x) for x in ("in", "store", "mark"))
    rows = [(f"s{i}", f"paragraph number {i} is long enough to be kept as an entry of its own") for i in range(30)]
    _add(src, "a", rows)
    old = ingest.entries_of(spark.createDataFrame(rows[:10], "source_file string, text string"))
    old.write.parquet(f"{store}-old")
    ingest.ingest(spark, src, store, mark, known=spark.read.parquet(f"{store}-old")).awaitTermination()
    assert spark.read.parquet(store).count() == 20


def test_topic_texts_and_late_messages(spark, tmp_path):
    """A topic's rows as files: values become texts, and messages behind the watermark no longer count."""
    src, out = str(tmp_path / "topic"), str(tmp_path / "out")
    os.makedirs(src)
    say = lambda name, rows: open(f"{src}/{name}.json", "w").writelines(json.dumps({"topic": "t", "value": v, "timestamp": ts}) + "\n" for v, ts in rows)
    stream = spark.readStream.schema("topic string, value string, timestamp timestamp").option("maxFilesPerTrigger", 1).json(src)
    start = lambda: ingest.recent_counts(ingest.topic_texts(stream)).writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "mark")).outputMode("append").trigger(availableNow=True).start()
    say("a", [("x", "2024-01-01T00:01:00Z"), ("y", "2024-01-01T00:02:00Z"), (None, "2024-01-01T00:03:00Z")])
    start().awaitTermination()
    say("b", [("z", "2024-01-01T05:00:00Z")])
    start().awaitTermination()
    say("c", [("late", "2024-01-01T00:04:00Z"), ("q", "2024-01-01T09:00:00Z")])
    start().awaitTermination()
    got = {(r.start.isoformat(), r.n) for r in spark.read.parquet(out).collect()}
    assert ("2024-01-01T00:00:00", 2) in got and ("2024-01-01T05:00:00", 1) in got and len(got) == 2
