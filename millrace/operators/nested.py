"""Nested records to flat tables with parent links.

Two layers. `flatten_list` turns a list column of a DataFrame into a child table straight from
the Arrow offsets. `flatten_exports` does the same for chat exports and gap reports kept as JSON
text: a C parser reads the text, its records become one nested Arrow array, and all levels are emitted from that
array's list offsets: child arrays by flattening, parents by parent indices, keys and refs by vectorised take.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: The keys that make an object a record, and the detectors of an image.
CONVERSATION_KEYS = ("chat_messages", "mapping")
IMAGE_KEY = "per_image"
DETECTORS = ("face", "eyes", "hands")
_OWN_KEYS = (*CONVERSATION_KEYS, IMAGE_KEY)

LINKS = T.StructType(
    [
        T.StructField("export_id", T.LongType()),
        T.StructField("level_name", T.StringType()),
        T.StructField("parent_ref", T.StringType()),
        T.StructField("child_ref", T.StringType()),
        T.StructField("position", T.IntegerType()),
        T.StructField("kind", T.StringType()),
        T.StructField("value", T.StringType()),
    ]
)


def flatten_list(df: DataFrame, keys: list[str], column: str, position: str = "position", fields: list[str] | None = None) -> DataFrame:
    """A row for each element of the list column, with the parent's keys and the 0-based position.

    Elements that are structs give their fields as columns (`fields`: only these), others one column
    named as the list. Null and empty lists give no rows; a null element gives a row of nulls. Where a
    field's name is already taken by a key or the position it gets the suffix `_child`.
    """
    element = df.schema[column].dataType.elementType
    inner = [f for f in element.fields if fields is None or f.name in fields] if isinstance(element, T.StructType) else [T.StructField(column, element)]
    taken = {*keys, position}
    named = [T.StructField(f.name + "_child" if f.name in taken else f.name, f.dataType) for f in inner]
    schema = T.StructType([*(df.schema[k] for k in keys), T.StructField(position, T.IntegerType()), *named])

    def flat(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(b.schema.get_field_index(column))
            parents = pc.list_parent_indices(lists)
            child = lists.flatten()
            offsets = np.asarray(pc.fill_null(pc.list_value_length(lists), 0))
            starts = np.concatenate([[0], np.cumsum(offsets)[:-1]]) if len(offsets) else offsets
            at = (np.arange(len(child)) - np.repeat(starts, offsets)).astype("int32") if len(child) else np.array([], dtype="int32")
            cols = [b.column(b.schema.get_field_index(k)).take(parents) for k in keys]
            kids = [pc.struct_field(child, f.name) for f in inner] if isinstance(element, T.StructType) else [child]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(at), *kids], names=[f.name for f in schema.fields])

    return df.select(*keys, column).mapInArrow(flat, schema)


def _text(x) -> str | None:
    """A scalar key as text; None where there is none."""
    if x is None or x == "" or isinstance(x, (dict, list)):
        return None
    s = x if isinstance(x, str) else json.dumps(x)
    return s.encode("utf-8", "replace").decode("utf-8")


def _value(x) -> str:
    return (x if isinstance(x, str) else json.dumps(x, ensure_ascii=False)).encode("utf-8", "replace").decode("utf-8")


def _refuse(name: str):
    raise ValueError(name)


_BLANK = "\ufeff \t\r\n\f\v\xa0\u3000"


def _loaded(text: str):
    """The JSON value of the text as a list of one, an empty list where it is not one complete JSON value."""
    try:
        return [json.loads(text, parse_constant=_refuse)]
    except (ValueError, RecursionError):
        return []


def parse_payload(text: str | None):
    """The JSON value of the text, a list of values where it is JSON line by line, None where it is neither, complete.

    A byte order mark and blank space before it and blank lines are passed over. A text with one damaged line
    is damaged. Numbers that JSON does not know (NaN) are not complete.
    """
    if not text:
        return None
    text = text.lstrip(_BLANK)
    if whole := _loaded(text):
        return whole[0]
    out = []
    for line in text.split("\n"):
        if line.strip(_BLANK):
            if not (one := _loaded(line.lstrip(_BLANK))):
                return None
            out += one
    return out or None


def find_records(root) -> list[dict]:
    """The records anywhere in the value, in document order; JSON kept in a string is opened. Of a record the values beside its own lists are looked through."""
    found, todo = [], [root]
    while todo:
        x = todo.pop()
        if isinstance(x, dict):
            if IMAGE_KEY in x or any(k in x for k in CONVERSATION_KEYS):
                found.append(x)
                todo.extend(v for k, v in reversed(x.items()) if k not in _OWN_KEYS and isinstance(v, (dict, list)))
            else:
                todo.extend(reversed(x.values()))
        elif isinstance(x, list):
            todo.extend(reversed(x))
        elif isinstance(x, str) and x.lstrip(_BLANK)[:1] in ("{", "[", '"'):
            if (inner := parse_payload(x)) is not None:
                todo.append(inner)
    return found


_TEXT = pa.string()
_PART = pa.struct([("at", pa.int32()), ("kind", _TEXT), ("value", _TEXT)])
_MESSAGE = pa.struct([("ref", _TEXT), ("at", pa.int32()), ("value", _TEXT), ("parts", pa.list_(_PART))])
_IMAGE = pa.struct([("ref", _TEXT), ("detectors", pa.list_(pa.struct([("name", _TEXT), ("value", _TEXT)])))])
_RECORD = pa.struct([("at", pa.int32()), ("ref", _TEXT), ("kind", _TEXT), ("value", _TEXT), ("messages", pa.list_(_MESSAGE)), ("images", pa.list_(_IMAGE))])


def _parts(message: dict) -> list[tuple]:
    content = message.get("content")
    out = []
    for body in (message.get("text"), content.get("parts") if isinstance(content, dict) else None):
        out += [(j, "text" if isinstance(p, str) else "json", _value(p)) for j, p in enumerate(body if isinstance(body, list) else [body]) if p is not None and p != "" and p != {} and p != []]
    return out


def _message(m, key, at: int) -> tuple:
    d = m if isinstance(m, dict) else {}
    author = d.get("author")
    return _text(key) or _text(d.get("uuid")), at, _text(d.get("sender")) or (_text(author.get("role")) if isinstance(author, dict) else None), _parts(d)


def _record(at: int, rec: dict) -> tuple:
    """A record in the one shape of _RECORD, whatever the types of its values; kind is null for a gap report."""
    kind = next((k for k in CONVERSATION_KEYS if k in rec), None)
    messages = []
    if isinstance(listed := rec.get("chat_messages"), list):
        messages += [_message(m, None, i) for i, m in enumerate(listed)]
    if isinstance(nodes := rec.get("mapping"), dict):
        messages += [_message(n["message"], k, i) for i, (k, n) in enumerate(nodes.items()) if isinstance(n, dict) and n.get("message") is not None]
    images = []
    if isinstance(shots := rec.get(IMAGE_KEY), dict):
        images = [(_value(name), [(d, _value(f[d])) for d in DETECTORS if isinstance(f, dict) and f.get(d) is not None]) for name, f in shots.items()]
    return at, _text(rec.get("uuid")) or _text(rec.get("id")), kind, _text(rec.get("name")) or _text(rec.get("title")), messages, images


def _children(lists: pa.Array) -> tuple[pa.Array, pa.Array, pa.Array]:
    """The elements of a list array, each one's parent's index and its position within the parent."""
    sizes = np.asarray(pc.list_value_length(lists))
    starts = np.cumsum(sizes) - sizes
    at = np.arange(int(sizes.sum())) - np.repeat(starts, sizes)
    return lists.flatten(), pc.list_parent_indices(lists), pa.array(at.astype("int32"))


def _fallback(refs: pa.Array, *pieces) -> pa.Array:
    return pc.coalesce(refs, pc.binary_join_element_wise(*pieces, ""))


def _emit(level: str, ids: pa.Array, parent: pa.Array, child: pa.Array, at: pa.Array, kind: pa.Array, value: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([ids, pa.array([level] * len(ids), type=pa.string()), parent, child, at, kind, value], names=LINKS.names)


def _flatten(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    none = lambda n: pa.nulls(n, _TEXT)
    blank = lambda n: pa.repeat(pa.scalar("", _TEXT), n)
    for b in batches:
        ids = b.column(0).cast(pa.int64())
        nested = pa.array([[_record(at, r) for at, r in enumerate(find_records(parse_payload(t)))] for t in b.column(1).to_pylist()], type=pa.list_(_RECORD))
        rec, up, _ = _children(nested)
        rec_ids = ids.take(up)

        conv_at = pc.indices_nonzero(pc.is_valid(rec.field("kind")))
        conv, conv_ids = rec.take(conv_at), rec_ids.take(conv_at)
        at = conv.field("at")
        conv_ref = _fallback(conv.field("ref"), "@", at.cast(_TEXT))
        yield _emit("conversation", conv_ids, blank(len(at)), conv_ref, at, conv.field("kind"), conv.field("value"))

        msg, up, _ = _children(conv.field("messages"))
        at, above, msg_ids = msg.field("at"), conv_ref.take(up), conv_ids.take(up)
        msg_ref = _fallback(msg.field("ref"), above, "/@", at.cast(_TEXT))
        yield _emit("message", msg_ids, above, msg_ref, at, none(len(at)), msg.field("value"))

        part, up, _ = _children(msg.field("parts"))
        at = part.field("at")
        yield _emit("part", msg_ids.take(up), msg_ref.take(up), at.cast(_TEXT), at, part.field("kind"), part.field("value"))

        img, up, pos = _children(rec.field("images"))
        img_ids, img_ref = rec_ids.take(up), img.field("ref")
        yield _emit("image", img_ids, blank(len(pos)), img_ref, pos, none(len(pos)), none(len(pos)))

        det, up, pos = _children(img.field("detectors"))
        yield _emit("detector", img_ids.take(up), img_ref.take(up), det.field("name"), pos, none(len(pos)), det.field("value"))


def flatten_exports(df: DataFrame, key: str = "export_id", payload: str = "payload") -> DataFrame:
    """Chat exports and gap reports as one long table of links: level, parent, child, position, kind, value.

    Levels: conversation, message, part, image, detector. The value is the conversation's title, the
    message's role, the part's text (JSON for other parts) or the detector's result as JSON. A payload
    is one JSON value or JSON line by line; one that is null, empty, damaged or without a record gives nothing. Rows of a payload delivered twice
    come twice here; `export_links` makes them distinct. No shuffle.
    """
    return df.select(key, payload).mapInArrow(_flatten, LINKS)


def export_links(df: DataFrame, key: str = "export_id", payload: str = "payload") -> DataFrame:
    """The distinct (export_id, level_name, parent_ref, child_ref)."""
    return flatten_exports(df, key, payload).select("export_id", "level_name", "parent_ref", "child_ref").distinct()


def export_table(df: DataFrame, level: str, key: str = "export_id", payload: str = "payload") -> DataFrame:
    """One level as its own flat table, keyed by the export and linked to the parent."""
    return flatten_exports(df, key, payload).where(f"level_name = '{level}'").drop("level_name").distinct()
