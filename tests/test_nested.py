import json

from conftest import rows

from millrace.operators.nested import export_links, export_table, find_records, flatten_list, parse_payload

CHAT = {"uuid": "c1", "name": "n", "chat_messages": [{"uuid": "m1", "sender": "human", "text": ["a", "", None, "b"]}, {"sender": "assistant", "text": "hi"}, {"uuid": None, "text": None}]}
MAP = {"title": "t", "mapping": {"k1": {"message": None}, "k2": {"message": {"author": {"role": "user"}, "content": {"parts": ["x", {"asset": 1}, ""]}}}, "k3": {}}}
GAP = {"per_image": {"/a.jpg": {"face": {"angle": "front"}, "eyes": None, "hands": {}}, "/b.jpg": None}}


def links(spark, *payloads):
    df = spark.createDataFrame([(i, p) for i, p in enumerate(payloads)], "export_id long, payload string")
    return {tuple(r) for r in export_links(df).collect()}


def test_levels_and_links(spark):
    got = links(spark, json.dumps(CHAT))
    assert got == {
        (0, "conversation", "", "c1"), (0, "message", "c1", "m1"), (0, "message", "c1", "c1/@1"), (0, "message", "c1", "c1/@2"),
        (0, "part", "m1", "0"), (0, "part", "m1", "3"), (0, "part", "c1/@1", "0"),
    }


def test_mapping_and_images(spark):
    got = links(spark, json.dumps([MAP, GAP]))
    assert got == {
        (0, "conversation", "", "@0"), (0, "message", "@0", "k2"), (0, "part", "k2", "0"), (0, "part", "k2", "1"),
        (0, "image", "", "/a.jpg"), (0, "image", "", "/b.jpg"), (0, "detector", "/a.jpg", "face"), (0, "detector", "/a.jpg", "hands"),
    }


def test_wrapped_damaged_and_empty(spark):
    wrapped = json.dumps(json.dumps({"data": [CHAT], "exported": True}))
    assert len(links(spark, "﻿ \n" + wrapped)) == 7
    bad = [None, "", "null", "[]", "{}", json.dumps(CHAT)[:-3], json.dumps(CHAT) + "\n" + json.dumps(CHAT)[:-1], "NaN", "[" * 100_000, '{"chat_messages": null}']
    assert links(spark, *bad) == {(9, "conversation", "", "@0")}


def test_line_by_line(spark):
    lines = "﻿" + json.dumps(CHAT) + "\r\n\n" + json.dumps(MAP) + "\n" + json.dumps(GAP) + "\n"
    got = links(spark, lines)
    assert (0, "conversation", "", "c1") in got and (0, "conversation", "", "@1") in got and (0, "image", "", "/b.jpg") in got and len(got) == 7 + 8
    assert links(spark, lines + "{") == set()


def test_records_beside_a_record_and_both_fields(spark):
    both = {"per_image": {"/a.jpg": {}}, "extra": {"chat_messages": [{"uuid": "m", "text": "", "content": {"parts": [None, "p"]}}]}}
    assert links(spark, json.dumps(both)) == {(0, "image", "", "/a.jpg"), (0, "conversation", "", "@1"), (0, "message", "@1", "m"), (0, "part", "m", "1")}


def test_repeats_and_an_empty_table(spark):
    df = spark.createDataFrame([(1, json.dumps(GAP), "x")] * 3, "export_id long, payload string, level_name string")
    assert export_links(df).count() == 4
    assert export_links(df.limit(0)).count() == 0
    assert export_table(df, "image").count() == 2


def test_long_payload(spark):
    big = {"uuid": "c", "chat_messages": [{"uuid": f"m{i}", "text": ["w " * 500]} for i in range(2000)]}
    assert len(links(spark, json.dumps(big))) == 4001


def test_parsing():
    assert parse_payload(" ﻿[1]") == [1] and parse_payload("[1] x") is None
    assert [sorted(r) for r in find_records({"a": [{"b": "{\"per_image\": {}}"}, {"mapping": {}}]})] == [["per_image"], ["mapping"]]


def test_flatten_list(spark):
    df = spark.createDataFrame([(1, [(5, "p"), None]), (2, None), (3, []), (4, [(6, None)])], "id long, xs array<struct<id: int, v: string>>")
    assert rows(flatten_list(df, ["id"], "xs")) == [(1, 0, 5, "p"), (1, 1, None, None), (4, 0, 6, None)]
    assert flatten_list(df, ["id"], "xs").columns == ["id", "position", "id_child", "v"]
    plain = spark.createDataFrame([(1, ["a", "b"])], "k long, ws array<string>")
    assert rows(flatten_list(plain, ["k"], "ws")) == [(1, 0, "a"), (1, 1, "b")]
