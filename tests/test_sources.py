import json

from conftest import rows
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.sources import files
from millrace.streaming import logs


def write(path, text):
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_json_forms(spark, tmp_path):
    assert files.json_documents(spark, write(tmp_path / "a.json", '[{"instruction": "a"}, {"instruction": "b"}]'), files.PAIR).count() == 2
    p = write(tmp_path / "b.jsonl", '{"question": "q", "output": "o"}\n\n{"instruction": "", "question": "x", "response": "r"}\nbroken\n')
    assert rows(files.read_pairs(spark, p).select("instruction", "response")) == [("q", "o"), ("x", "r")]


def test_probe_csv(spark, tmp_path):
    p = write(tmp_path / "p.csv", 'model,question,iteration,response,timestamp\nm,"a, ""b""",1,"two\nlines",t\nm,q,2,[ERROR: x],t\n')
    assert rows(files.probe_csv(spark, p).select("prompt", "response")) == [('a, "b"', "two\nlines")]


def test_listing_and_hashes(spark, tmp_path):
    (tmp_path / "d").mkdir()
    for n in ("a.jpg", "d/b.PNG", "c.Jpg", "e.txt"):
        write(tmp_path / n, n)
    assert [r.path.rsplit("/", 1)[1] for r in files.image_listing(spark, str(tmp_path)).collect()] == ["a.jpg", "b.PNG"]
    assert files.file_hashes(spark, str(tmp_path)).count() == 4


def test_log_last_wins(spark, tmp_path):
    p = write(tmp_path / "log.jsonl", "\n".join(json.dumps(x) for x in ({"key": "a", "value": "1", "offset": 1}, {"key": "a", "value": "3", "offset": 3}, {"key": "b", "value": None, "offset": 1}, {"key": "a", "value": "2", "offset": 2})) + "\n\n")
    log = files.read_log(spark, p, "string")
    assert rows(log) == [("a", "3"), ("b", None)]
    files.compact(log, str(tmp_path / "compact"))
    assert spark.read.json(str(tmp_path / "compact")).count() == 2
    files.append_log(log, str(tmp_path / "more"), "key", "value")
    files.append_log(log, str(tmp_path / "more"), "key", "value")
    assert spark.read.json(str(tmp_path / "more")).count() == 4


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("x", "a\nb"), (None, "c")], "label string, text string")
    files.write_by_label(df, str(tmp_path / "by"), "label")
    assert sorted(p.name for p in (tmp_path / "by").glob("label=*")) == ["label=unlabeled", "label=x"]
    files.write_lines(df, str(tmp_path / "lines"), "text")
    assert spark.read.text(str(tmp_path / "lines")).count() == 2
    files.write_json(df, str(tmp_path / "json"))
    assert files.numbered(df, "My Set", "text").orderBy("text").first().export_name == "my_set_0001"


CHAT = {"uuid": "u", "name": "n", "chat_messages": [{"uuid": "m", "sender": "human", "text": ["a", "b"]}, {"uuid": "n", "sender": "bot", "text": " "}, {"text": None}]}
MAPPED = {"name": "x", "title": "t", "id": "g", "create_time": 0, "mapping": {"z": {"message": {"author": {"role": "system"}, "content": {"parts": ["y", None, "", {"k": 1}]}}}, "a": {"message": None}, "b": {"message": {"author": {"role": "tool"}, "content": {"parts": [" "]}}}}}
ITEMS = [{"role": "Human", "content": " x "}, {"role": "user"}, {"content": "y"}]


def test_formats_and_parsers(spark):
    untitled = {"uuid": None, "chat_messages": [{"sender": "human", "text": "q"}]}
    data = [json.dumps(CHAT), json.dumps([CHAT]), json.dumps(MAPPED), json.dumps(ITEMS), "{", None, "[]", json.dumps({"mapping": {}, "title": "t"}), json.dumps(CHAT) + "\n" + json.dumps(CHAT), json.dumps(untitled), json.dumps([{"x": 1}, *ITEMS]), '{"uuid": 1, "chat_messages": null}', ""]
    df = spark.createDataFrame([(i, p, f"/in/f.{i}.json") for i, p in enumerate(data)], "export_id long, payload string, file string")
    assert [r[1] for r in rows(df.select("export_id", files.detect_format("payload")))] == [r[1] for r in sorted(enumerate(["claude", "unknown", "gpt", "generic", "unknown", "unknown", "unknown", "unknown", "unknown", "claude", "unknown", "claude", "unknown"]), key=repr)]
    found = files.conversations(df, "export_id", "payload", "file")
    assert sorted((r.export_id, r.conv_id, r.name, r.format) for r in found.collect()) == [(0, "u", "n", "claude"), (2, "g", "t", "gpt"), (3, "generic_conversation", "f.3", "generic"), (9, "unknown", "Untitled", "claude"), (10, "generic_conversation", "f.10", "generic")]
    said = sorted((r.export_id, r.turn, r.role, r.text, r.message_id) for r in files.conversation_messages(found, "export_id").collect())
    assert said[:4] == [(0, 0, "user", "a\nb", "m"), (0, 1, "assistant", "", "n"), (0, 2, "assistant", "", ""), (2, 0, "system", 'y\n{"k":1}', "z")]
    assert said[4:] == [(3, 0, "Human", "x", ""), (9, 0, "user", "q", ""), (10, 0, "Human", "x", "")]
    listed = files.conversations(df.where("export_id = 1"), "export_id", "payload", kind="claude")
    assert listed.count() == 1 and files.conversations(df.limit(0), "export_id", "payload").count() == 0


def test_export_keeps_what_is_there(spark, tmp_path):
    df = spark.createDataFrame([("/a/x.jpg", "p"), ("/b/x.jpg", "p"), ("/a/y.jpg", None)], "path string, label string")
    to = str(tmp_path / "organized")
    assert files.export_by_label(df, to, "label", "path") == 2 and files.export_by_label(df, to, "label", "path") == 0
    assert files.export_by_label(df.union(spark.createDataFrame([("/a/z.jpg", "p")], df.schema)), to, "label", "path") == 1
    assert spark.read.json(to).groupBy("label").count().orderBy("label").collect()[0][1] == 2


def test_latest_and_unseen(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), (None, 1, "z")], "k string, o int, v string")
    assert rows(files.latest(df, "k", "o")) == [("a", 2, "y")]
    assert rows(files.unseen(df.where("k is not null").select("k"), spark.createDataFrame([("b",)], "k string"), "k")) == [("a",), ("a",)]


def test_stream_keeps_the_last(spark, tmp_path):
    src = tmp_path / "in"
    schema = "k string, o int, v string"
    spark.createDataFrame([("a", 1, "x"), ("b", 1, "y")], schema).write.parquet(str(src / "1"))
    rows_ = spark.readStream.schema(schema).option("recursiveFileLookup", True).parquet(str(src))
    store, log = str(tmp_path / "store"), str(tmp_path / "log")
    logs.merge_into(rows_, store, "k", "o", log).awaitTermination()
    spark.createDataFrame([("a", 2, "z"), ("b", 0, "old")], schema).write.parquet(str(src / "2"))
    logs.merge_into(rows_, store, "k", "o", log).awaitTermination()
    assert rows(logs.current(spark, store, rows_.schema)) == [("a", 2, "z"), ("b", 1, "y")]
    spark.createDataFrame([(f"k{i}", 1, "x") for i in range(300)], schema).write.parquet(str(src / "3"))
    logs.merge_into(rows_, store, "k", "o", log).awaitTermination()
    spark.createDataFrame([("a", 3, "w"), (None, 9, "n")], schema).write.parquet(str(src / "4"))
    logs.merge_into(rows_, store, "k", "o", log).awaitTermination()
    newest = max((tmp_path / "store").iterdir(), key=lambda p: int(p.name))
    assert len(list(newest.glob("bucket=*"))) == 1 and logs.current(spark, store, rows_.schema).count() == 302
    assert logs.current(spark, str(tmp_path / "nothing"), rows_.schema).count() == 0


def test_a_late_row_is_dropped(spark, tmp_path):
    schema, src = "t timestamp, k string", tmp_path / "in"
    stamp = lambda *ts: spark.createDataFrame([(t, "a") for t in ts], "t string, k string").withColumn("t", F.to_timestamp("t"))
    store, log = str(tmp_path / "store"), str(tmp_path / "log")
    for i, ts in enumerate((["2024-01-01 00:10:00", "2024-01-01 05:00:00"], ["2024-01-01 00:20:00", "2024-01-01 04:10:00"], ["2024-01-01 05:30:00"])):
        stamp(*ts).write.parquet(str(src / str(i)))
        stream = spark.readStream.schema(schema).option("recursiveFileLookup", True).parquet(str(src))
        logs.windows_into(stream, store, "t", "k", log, "1 hour", "2 hours").awaitTermination()
    got = logs.current(spark, store, T.StructType.fromDDL("key string, start timestamp, k string, n long"))
    assert [(r.start.hour, r.n) for r in got.orderBy("start").collect()] == [(0, 1), (4, 1), (5, 2)]


def test_window_counts(spark):
    df = spark.createDataFrame([("2024-01-01 00:10:00", "a"), ("2024-01-01 00:50:00", "a"), ("2024-01-01 01:00:00", "a")], "t string, k string").withColumn("t", F.to_timestamp("t"))
    assert [r.n for r in logs.window_counts(df, "t", "k").orderBy("start").collect()] == [2, 1]
