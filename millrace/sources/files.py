"""Readers and writers of the formats that data sets come in, all with stated schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions import text as tx
from millrace.plans.ranges import placed
from millrace.plans.runtime import cut

PAIR = T.StructType([T.StructField(n, T.StringType()) for n in ("instruction", "question", "response", "output", "conversation_id")])
PROBE = T.StructType([T.StructField("model", T.StringType()), T.StructField("prompt", T.StringType()), T.StructField("question", T.StringType()), T.StructField("iteration", T.IntegerType()), T.StructField("response", T.StringType()), T.StructField("timestamp", T.StringType())])
GENERIC = "array<struct<role string, content string, timestamp string, id string>>"
IMAGE_ENDINGS = ("jpg", "jpeg", "png", "webp", "bmp")
#: Those that a face vault also takes.
VAULT_ENDINGS = (*IMAGE_ENDINGS, "heic")


def json_documents(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Whole-file JSON; a list at the root gives a row for each element."""
    return spark.read.schema(schema).json(path, multiLine=True)


def json_lines(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A row a line; blank lines are passed over, damaged ones dropped."""
    return spark.read.schema(schema).json(path, mode="DROPMALFORMED")


def read_pairs(spark: SparkSession, path: str) -> DataFrame:
    """Pairs of JSON lines, under either name of their sides."""
    rows = json_lines(spark, path, PAIR)
    pick = lambda a, b: F.coalesce(F.nullif(F.col(a), F.lit("")), F.nullif(F.col(b), F.lit("")), F.lit(""))
    return rows.select(pick("instruction", "question").alias("instruction"), pick("response", "output").alias("response"), "conversation_id")


def probe_csv(spark: SparkSession, path: str) -> DataFrame:
    """Probe answers of CSV with a header and quoted lines; the prompt's column may be called question. Error rows are dropped."""
    head = spark.read.option("header", True).csv(path).columns
    known = {f.name: f for f in PROBE.fields}
    rows = spark.read.schema(T.StructType([known.get(c, T.StructField(c, T.StringType())) for c in head])).csv(path, header=True, multiLine=True, quote='"', escape='"')
    prompt = [F.col(c) for c in ("prompt", "question") if c in head]
    return rows.select("model", F.coalesce(*prompt).alias("prompt"), "iteration", "response", "timestamp").where(~F.startswith(F.coalesce("response", F.lit("")), F.lit("[ERROR")))


def image_listing(spark: SparkSession, path: str, endings: tuple = IMAGE_ENDINGS) -> DataFrame:
    """Paths of the image files below a folder, by endings all small or all large, each once, sorted."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length", "modificationTime")
    end = F.element_at(F.split("path", r"\."), -1)
    return found.where(end.isin(*endings, *[e.upper() for e in endings])).dropDuplicates(["path"]).orderBy("path")


def file_hashes(spark: SparkSession, path: str) -> DataFrame:
    """path and MD5 of each file's bytes."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", F.md5("content").alias("md5"))


def append_log(df: DataFrame, path: str, key: str, value: str) -> None:
    """Appends key and value as JSON lines."""
    df.select(F.col(key).alias("key"), F.col(value).alias("value")).write.mode("append").json(path)


def latest(df: DataFrame, key: str, *order: str) -> DataFrame:
    """The last row of each key in `order`; null keys are dropped. Aggregated before the shuffle, so a hot key costs no more than others."""
    rest = F.struct(*df.columns)
    best = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.max_by(rest, F.struct(*order)).alias("__r"))
    return best.select("__r.*")


def read_log(spark: SparkSession, path: str, value: str, order: str = "offset") -> DataFrame:
    """A key-value log of JSON lines, the last value of each key; `order` is the field that counts the lines."""
    rows = spark.read.schema(f"key string, value {value}, {order} long").json(path)
    return latest(rows, "key", order).select("key", "value")


def compact(df: DataFrame, path: str, files: int = 1) -> None:
    """A log's last values in few files."""
    df.coalesce(files).write.mode("overwrite").json(path)


def unseen(df: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """The rows whose key isn't done yet."""
    return df.join(done.select(key).distinct(), key, "left_anti")


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_lines(df: DataFrame, path: str, c: str) -> None:
    """One text a line; line breaks within become blanks."""
    df.select(F.regexp_replace(c, r"[\r\n]+", " ").alias("value")).write.mode("overwrite").text(path)


def write_by_label(df: DataFrame, path: str, label: str) -> None:
    """A folder for each label; rows of a null label go to unlabeled."""
    df.withColumn(label, F.coalesce(F.col(label), F.lit("unlabeled"))).write.mode("overwrite").partitionBy(label).json(path)


def export_by_label(df: DataFrame, path: str, label: str, key: str) -> int:
    """Adds the rows whose key isn't yet in its label's folder, and says how many were added; what is there stays as it is.

    Of rows with the same label and file name (the key's last part) one is added.
    """
    spark = df.sparkSession
    rows = df.withColumns({label: F.coalesce(F.col(label), F.lit("unlabeled")), "file_name": F.element_at(F.split(key, "/"), -1)}).dropDuplicates([label, "file_name"])
    there = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(there):
        done = spark.read.schema(T.StructType([*[f for f in rows.schema.fields if f.name != label], T.StructField(label, T.StringType())])).json(path)
        rows = rows.join(done.select(label, "file_name").distinct(), [label, "file_name"], "left_anti")
    rows = cut(rows, "export")
    rows.write.mode("append").partitionBy(label).json(path)
    return rows.count()


def numbered(df: DataFrame, trigger: str, order: str) -> DataFrame:
    """With export_name: the trigger in small letters and a four-digit number in order."""
    name = F.format_string("%s_%04d", F.replace(F.lower(F.lit(trigger)), F.lit(" "), F.lit("_")), F.col("__n") + 1)
    return placed(df, [], [order], "__n").withColumn("export_name", name).drop("__n")


def manifest(df: DataFrame, group: str, *fields: str) -> DataFrame:
    """A row for each group with its rows as JSON, sorted."""
    return df.groupBy(group).agg(F.to_json(F.array_sort(F.collect_list(F.struct(*fields)))).alias("manifest"))


def columnar(df: DataFrame, messages: str = "messages", image: str | None = None) -> DataFrame:
    """Messages as JSON text beside the other columns; rows without their image are passed over."""
    out = df.withColumn(messages, F.to_json(messages))
    return out.where(F.col(image).isNotNull()) if image else out


def detect_format(payload):
    """claude, gpt, generic or unknown, by the keys of the object or of the list's first one.

    An object with uuid and chat_messages is claude, one with name and mapping gpt, a list whose first item has
    role and content generic; the keys' values don't matter. Null, empty, damaged and other payloads are unknown.
    """
    p = tx.col(payload)
    whole = F.coalesce(F.json_array_length(F.concat(F.lit("["), p, F.lit("]"))) == 1, F.lit(False))  # nothing may follow the value
    has = lambda doc, *keys: F.coalesce(F.array_size(F.array_intersect(F.json_object_keys(doc), F.array(*map(F.lit, keys)))) == len(keys), F.lit(False))
    first = F.get_json_object(p, "$[0]")
    listed = F.startswith(F.ltrim(p), F.lit("["))
    return F.when(~whole, "unknown").when(has(p, "uuid", "chat_messages"), "claude").when(has(p, "name", "mapping"), "gpt").when(listed & has(first, "role", "content"), "generic").otherwise("unknown")


_CLAUDE = "array<struct<uuid string, name string, created_at string, updated_at string, chat_messages array<struct<uuid string, sender string, text variant, created_at string>>>>"
_GPT = "struct<id string, title string, create_time double, mapping map<string, struct<message struct<author struct<role string>, content struct<parts string>, create_time string>>>>"
_CONVERSATIONS = "array<struct<conv_id string, name string, created_at string, updated_at string, format string, messages array<struct<role string, text string, timestamp string, message_id string>>>>"


def _said(role, text, timestamp, message_id):
    return F.struct(role.alias("role"), tx.strip(text).alias("text"), F.coalesce(timestamp, F.lit("")).alias("timestamp"), F.coalesce(message_id, F.lit("")).alias("message_id"))


def _conversation(conv_id, name, created, updated, kind: str, messages):
    return F.struct(F.coalesce(conv_id, F.lit("unknown")).alias("conv_id"), F.coalesce(name, F.lit("Untitled")).alias("name"), created.alias("created_at"), updated.alias("updated_at"), F.lit(kind).alias("format"), messages.alias("messages"))


def _plain_text(v):
    """A variant as text: strings as they are, other values as JSON; null for JSON's null."""
    return F.when(~F.is_variant_null(v), F.coalesce(F.try_variant_get(v, "$", "string"), F.to_json(v)))


def _claude(payload):
    listed = lambda t: F.startswith(F.schema_of_variant(t), F.lit("ARRAY"))
    text = lambda t: F.coalesce(F.when(listed(t), F.array_join(F.transform(F.try_variant_get(t, "$", "array<variant>"), _plain_text), "\n")).otherwise(_plain_text(t)), F.lit(""))
    said = lambda m: _said(F.when(m["sender"] == "human", "user").otherwise("assistant"), text(m["text"]), m["created_at"], m["uuid"])
    blank = F.lit("")
    return F.transform(F.from_json(payload, _CLAUDE), lambda c: _conversation(c["uuid"], c["name"], F.coalesce(c["created_at"], blank), F.coalesce(c["updated_at"], blank), "claude", F.transform(c["chat_messages"], said)))


def _gpt(payload):
    c = F.from_json(payload, _GPT)
    pieces = lambda raw: F.arrays_zip(F.from_json(raw, "array<string>").alias("t"), F.from_json(raw, "array<variant>").alias("v"))
    truthy = lambda x: x["t"].isNotNull() & F.when(F.schema_of_variant(x["v"]) == "STRING", x["t"] != "").otherwise(~x["t"].isin("false", "0", "0.0", "[]", "{}"))
    text = lambda m: F.array_join(F.transform(F.filter(pieces(m["content"]["parts"]), truthy), lambda x: x["t"]), "\n")
    said = lambda e: _said(F.coalesce(e["value"]["message"]["author"]["role"], F.lit("unknown")), text(e["value"]["message"]), e["value"]["message"]["create_time"], e["key"])
    kept = F.filter(F.transform(F.filter(F.map_entries(c["mapping"]), lambda e: e["value"]["message"].isNotNull()), said), lambda m: m["text"] != "")
    created = F.when(c["create_time"] != 0, F.date_format(F.timestamp_seconds(c["create_time"]), "yyyy-MM-dd'T'HH:mm:ss")).otherwise("")
    return F.when(c.isNotNull(), F.array(_conversation(c["id"], c["title"], F.coalesce(created, F.lit("")), F.lit(""), "gpt", kept)))


def _generic(payload, name):
    items = F.filter(F.from_json(payload, GENERIC), lambda m: m["role"].isNotNull() & m["content"].isNotNull())
    said = F.transform(items, lambda m: _said(m["role"], m["content"], m["timestamp"], m["id"]))
    return F.when(F.startswith(F.ltrim(payload), F.lit("[")), F.array(_conversation(F.lit("generic_conversation"), name, F.lit(""), F.lit(""), "generic", said)))


def conversations(exports: DataFrame, key: str, payload: str, name: str | None = None, kind: str | None = None) -> DataFrame:
    """(key, conv_id, name, created_at, updated_at, format, messages) of chat exports, each read by its detected format, unknown ones as generic.

    kind: reads all as claude, gpt or generic, undetected. messages: role, text, timestamp, message_id, in the document's
    order; times of gpt conversations are written in the session's zone; conversations without any are dropped. In claude a human's message is the user's and every other sender's the
    assistant's, texts' parts are joined by line breaks and blank texts stay; in gpt roles stay as written, parts that are null, empty
    or false are passed over and blank messages dropped; generic items need role and content and are one conversation named
    after the file (`name`: its path). Parts that aren't strings are JSON text; null texts are blank. Payloads that can't be read have no
    conversation. Key columns with clashing names are the caller's to rename.
    """
    p = F.col(payload)
    stem = F.regexp_extract(F.col(name), r"([^/]*?)(?:\.[^./]*)?$", 1) if name else F.lit(None).cast("string")
    claude, gpt, generic = (x.cast(_CONVERSATIONS) for x in (_claude(p), _gpt(p), _generic(p, stem)))
    format_ = F.lit(kind) if kind else detect_format(p)
    found = F.when(format_ == "claude", claude).when(format_ == "gpt", gpt).otherwise(generic)
    rows = exports.select(key, F.explode(found).alias("__c")).select(key, "__c.*")
    return rows.where(F.size("messages") > 0)


def conversation_messages(convs: DataFrame, key: str) -> DataFrame:
    """A row for each message of `conversations`: key, conv_id, format, turn, role, text, timestamp, message_id."""
    return convs.select(key, "conv_id", "format", F.posexplode("messages").alias("turn", "m")).select(key, "conv_id", "format", "turn", "m.*")
