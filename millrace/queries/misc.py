"""Traits, splits and presets, exports, logs and scans."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.operators import scan, splits, traits
from millrace.plans.runtime import shared_dir, table
from millrace.queries import base as b
from millrace.queries import images as im
from millrace.sources import files
from millrace.streaming import logs

#: Words that occur in the test answers.
LOOKS = ["long dark hair", "curly hair", "green eyes", "brown eyes", "freckles", "bright eyes", "round face"]
GRID = {"who": ["a painter", "a baker", "a cook", "a nurse"], "where": ["at home", "in the market", "on the roof", "by the lake", "in the studio"], "light": ["in soft light", "in hard light", "at dawn", "at dusk"]}


def gender_votes(spark, d):
    return b.probes(spark, d).groupBy(traits.vote("response").alias("vote")).agg(F.count("*").alias("n"))


def gender_votes_whole_words(spark, d):
    return b.probes(spark, d).groupBy(traits.vote("response", whole_words=True).alias("vote")).agg(F.count("*").alias("n"))


def modal_trait(spark, d):
    return traits.modal(b.probes(spark, d), "prompt", traits.vote("response", whole_words=True))


def keyword_topk(spark, d):
    return traits.keyword_counts(b.probes(spark, d), "prompt", "response", LOOKS, 5)


def vibe_topk(spark, d):
    return traits.keyword_counts(b.probes(spark, d), "prompt", "response", traits.VIBE, 3)


def numbers_mean(spark, d):
    return traits.number_means(b.probes(spark, d), "prompt", "response")


def place_votes(spark, d):
    return traits.place_votes(b.turns(spark, d).where("text is not null").withColumn("k", F.lit("all")), "k", "text", after=("in", "from", "to", "by")).select("place", "n")


def quoted_names(spark, d):
    return traits.quoted_names(b.docs(spark, d).where("text is not null").select(F.lit("all").alias("k"), F.concat(F.lit('"'), F.array_join(F.slice(F.split("text", " "), 1, 2), " "), F.lit('" '), F.col("text")).alias("text")), "k", "text").select("name", "n")


def first_answers(spark, d):
    return traits.first_answers(b.probes(spark, d), "prompt", "answer_id", "response")


def prompt_grid(spark, d):
    return traits.prompt_grid(spark, 200, GRID, "%s %s %s")


def trait_scenarios(spark, d):
    return traits.scenarios(modal_trait(spark, d).select("prompt", "value")).select("prompt", "n", "scenario")


def train_val_split(spark, d):
    return splits.split(b.docs(spark, d).select("doc_id"), "doc_id")


def merge_splits(spark, d):
    docs, prs = train_val_split(spark, d).select(F.col("doc_id").alias("id"), "split"), splits.split(b.pairs(spark, d).select("pair_id"), "pair_id").select(F.col("pair_id").alias("id"), "split")
    return splits.merge([("documents", docs), ("pairs", prs), ("absent", None)]).groupBy("dataset", "split").agg(F.count("*").alias("n"), F.min("id").alias("first"))


def resolved_paths(spark, d):
    rows = table(spark, d, "part").select("p_partkey")
    a = rows.where("p_partkey % 3 = 0").select("p_partkey", F.format_string("/a/%d", "p_partkey").alias("path"))
    c = rows.where("p_partkey % 2 = 0").select("p_partkey", F.format_string("/b/%d", "p_partkey").alias("path"))
    return splits.resolved(rows, "p_partkey", [a, c])


def training_plan(spark, d):
    sizes = im._shots(spark, d).groupBy("dataset_id").agg(F.count("*").alias("n"))
    return splits.training_plan(sizes, "n")


def memory_batches(spark, d):
    return table(spark, d, "part").select("p_partkey", splits.memory_batch(F.col("p_size") / 2, F.lit(6)).alias("batch"))


def config_documents(spark, d):
    plan = training_plan(spark, d)
    return plan.select("dataset_id", splits.config_json(epochs=F.col("epochs"), batch=F.col("batch"), name=F.concat(F.lit("run_"), F.col("dataset_id"))).alias("config"))


def newest_orders(spark, d):
    return splits.newest(table(spark, d, "orders").select("o_orderkey", "o_orderdate"), "o_orderdate", "o_orderkey").limit(50).select("o_orderkey")


def last_steps(spark, d):
    s = F.col("s_suppkey")
    return table(spark, d, "supplier").select("s_suppkey", splits.last_step({"scan": s % 2 == 0, "cluster": s % 4 == 0, "train": s % 8 == 0}).alias("step"))


def taxonomy_prompt(spark, d):
    rows = [(k, i, t) for k, ts in im.TAXONOMY.items() for i, t in enumerate(ts)]
    return splits.taxonomy_prompt(spark.createDataFrame(rows, "category string, ord int, term string"))


def numbered_export(spark, d):
    return files.numbered(table(spark, d, "supplier").select("s_name"), "My Set", "s_name")


def manifest_json(spark, d):
    return files.manifest(table(spark, d, "nation"), "n_regionkey", "n_name").select("n_regionkey", "manifest")


def columnar_messages(spark, d):
    from millrace.operators import chat

    rows = b.pairs(spark, d).select("pair_id", chat.chat_messages().alias("messages"))
    return files.columnar(rows).select("pair_id", F.get_json_object("messages", "$[1].role").alias("role"), F.get_json_object("messages", "$[0].content").alias("question"), F.get_json_object("messages", "$[1].content").alias("answer"))


def props_json(spark, d):
    return table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("int").alias("k"))


def export_formats(spark, d):
    return table(spark, d, "raw_export").dropDuplicates(["export_id"]).groupBy(files.detect_format("payload").alias("format")).agg(F.count("*").alias("n"))


def _exports(spark, d):
    return table(spark, d, "raw_export").select("export_id", "file_name", "payload").dropDuplicates(["export_id"])


def parsed_exports(spark, d):
    found = files.conversations(_exports(spark, d), "export_id", "payload", "file_name")
    return files.conversation_messages(found, "export_id").select("export_id", "conv_id", "format", "turn", "role", "text")


def parsed_conversations(spark, d):
    found = files.conversations(_exports(spark, d), "export_id", "payload", "file_name")
    return found.select("export_id", "conv_id", "name", "format", F.size("messages").alias("n_messages"))


def gpt_messages(spark, d):
    mapped = _exports(spark, d).where(F.array_contains(F.json_object_keys("payload"), "mapping") & (F.json_array_length(F.concat(F.lit("["), "payload", F.lit("]"))) == 1))
    return files.conversation_messages(files.conversations(mapped, "export_id", "payload", kind="gpt"), "export_id").select("export_id", "conv_id", "turn", "role", "text")


def generic_messages(spark, d):
    """The generic exports of the conversation table, a file each, read as such."""
    turns = table(spark, d, "conversation").where("conv_id = 'generic_conversation' and role is not null and content is not null").dropDuplicates(["msg_id"])
    item = F.to_json(F.struct("role", "content", F.col("msg_id").cast("string").alias("id")))
    payloads = turns.select("source_file", F.concat(F.lit("["), item, F.lit("]")).alias("payload"))
    found = files.conversations(payloads, "source_file", "payload", "source_file")
    return files.conversation_messages(found, "source_file").select("source_file", "conv_id", "format", "role", "text", "message_id")


#: Modules and names that the scanned pickles import, by the parts' keys and sizes.
MODULES, NAMES = ["os", "torch", "numpy", "subprocess", "collections", "plugin", "builtins", "shutil", "mylib", "datetime", "posix"], ["system", "OrderedDict", "eval", "array", "open", "Tensor", "getattr"]


def pickle_scan(spark, d):
    """Pickles that import a module's name and call it with the part's own name; those of every fifth size are cut off."""
    pick = lambda xs, c: F.element_at(F.array(*map(F.lit, xs)), (F.col(c) % len(xs) + 1).cast("int"))
    text = F.concat(F.lit("c"), pick(MODULES, "p_partkey"), F.lit("\n"), pick(NAMES, "p_size"), F.lit("\n(V"), F.regexp_replace("p_name", r"[^A-Za-z0-9 ]", ""), F.lit("\ntR"), F.when(F.col("p_size") % 5 != 0, ".").otherwise(""))
    return scan.pickle_scan(table(spark, d, "part").select("p_partkey", text.cast("binary").alias("content")), "p_partkey").select("p_partkey", F.array_join("imports", ",").alias("imports"), "risk")


def streaming_latest(spark, d):
    """The last event of each user by a stream over the table's file, merged into a store of its own."""
    import uuid

    source = f"{d}/events.parquet"
    store = f"{shared_dir(spark).rstrip('/')}/stream-{uuid.uuid4().hex}"
    rows = logs.stream(spark, d, spark.read.parquet(source).schema, names="events.parquet")
    query = logs.merge_into(rows.select("user_id", "event_id", "event_type"), f"{store}/data", "user_id", "event_id", f"{store}/log")
    query.awaitTermination()
    return logs.current(spark, f"{store}/data", rows.select("user_id", "event_id", "event_type").schema)


def streaming_windows(spark, d):
    """The counts of hourly_events, by a stream with a watermark."""
    import uuid

    store = f"{shared_dir(spark).rstrip('/')}/stream-{uuid.uuid4().hex}"
    rows = logs.stream(spark, d, spark.read.parquet(f"{d}/events.parquet").schema, names="events.parquet")
    rows = rows.select(F.col("ts").cast("timestamp").alias("ts"), "event_type")  # a watermark needs instants; the session's zone is that of the table
    logs.windows_into(rows, f"{store}/data", "ts", "event_type", f"{store}/log", "1 day", "3650 days").awaitTermination()
    found = logs.current(spark, f"{store}/data", logs.window_counts(rows, "ts", "event_type").schema)
    return found.withColumn("start", F.col("start").cast("timestamp_ntz"))


def hourly_events(spark, d):
    return logs.window_counts(table(spark, d, "events"), "ts", "event_type", "1 day")


_VOTE = "CASE " + " ".join(f"WHEN {b.contains('lower(response)', ts)} THEN '{k}'" for k, ts in traits.GENDER.items()) + " END"
_PAD = rf"(' ' || trim(regexp_replace(lower(response), '[^\p{{L}}\p{{N}}_]+', ' ', 'g')) || ' ')"
_WORDVOTE = "CASE " + " ".join("WHEN " + " OR ".join(f"contains({_PAD}, ' {t} ')" for t in ts) + f" THEN '{k}'" for k, ts in traits.GENDER.items()) + " END"
_MODAL = f"WITH {b.PROBES}, c AS (SELECT prompt, {_WORDVOTE} AS value, count(*) AS n FROM probes GROUP BY ALL), t AS (SELECT prompt, sum(n) AS total FROM c GROUP BY prompt), modal AS (SELECT prompt, value, n, round(n / total, 6) AS confidence FROM c JOIN t USING (prompt) WHERE value IS NOT NULL QUALIFY row_number() OVER (PARTITION BY prompt ORDER BY n DESC, value) = 1) "


def _top(words, k):
    return f"WITH {b.PROBES}, k(keyword) AS (VALUES {', '.join(f'({w!r})' for w in words)}), c AS (SELECT prompt, keyword, count(*) AS n FROM probes, k WHERE contains(lower(response), keyword) GROUP BY ALL) SELECT *, row_number() OVER (PARTITION BY prompt ORDER BY n DESC, keyword) AS r FROM c QUALIFY r <= {k}"


_SPLIT = "split_{1} AS (SELECT {0} AS id, CASE WHEN row_number() OVER (ORDER BY md5({0}::VARCHAR), {0}) <= trunc((SELECT count(*) FROM {1}) * 0.9::DOUBLE) THEN 'train' ELSE 'val' END AS split FROM {1})"
_PLAN = f"{im._S}, sizes AS (SELECT dataset_id, count(*) AS n FROM shots GROUP BY 1), pl AS (SELECT *, CASE WHEN n < 20 THEN 20 WHEN n < 50 THEN 15 WHEN n < 100 THEN 10 ELSE 8 END AS epochs, CASE WHEN n < 30 THEN 1 WHEN n < 100 THEN 2 ELSE 4 END AS batch FROM sizes)"
_TAX = {k: t for k, t in im.TAXONOMY.items() if k[0] != "_"}
SQL = {
    "gender_votes": f"WITH {b.PROBES} SELECT {_VOTE} AS vote, count(*) AS n FROM probes GROUP BY 1",
    "gender_votes_whole_words": f"WITH {b.PROBES} SELECT {_WORDVOTE} AS vote, count(*) AS n FROM probes GROUP BY 1",
    "modal_trait": _MODAL + "SELECT * FROM modal",
    "keyword_topk": _top(LOOKS, 5),
    "vibe_topk": _top(traits.VIBE, 3),
    "numbers_mean": rf"WITH {b.PROBES}, x AS (SELECT prompt, list_filter(list_transform(list_filter({b.words('response')}, lambda t: regexp_full_match(t, '[0-9]{{1,9}}')), lambda t: t::BIGINT), lambda v: v BETWEEN 10 AND 100) AS ns FROM probes), s AS (SELECT prompt, sum(len(ns)) AS n, sum(list_sum(ns)) AS s, count(*) AS answers FROM x GROUP BY prompt) SELECT prompt, trunc(s / n)::INT AS age, round(n / answers, 6) AS confidence FROM s WHERE n > 0",
    "place_votes": rf"WITH {b.TURNS}, w AS (SELECT regexp_split_to_array({b.strip('text')}, '[\s\p{{Z}}]+') AS w FROM turns WHERE text IS NOT NULL), p AS (SELECT unnest(list_transform(range(1, len(w)), lambda i: {{'a': w[i], 'b': w[i + 1]}})) AS p FROM w) SELECT p.b AS place, count(*) AS n FROM p WHERE lower(p.a) IN ('in', 'from', 'to', 'by') AND regexp_matches(p.b, '^\p{{Lu}}') AND length(p.b) > 3 GROUP BY 1",
    "quoted_names": rf"""WITH {b.DOCS}, q AS (SELECT unnest(regexp_extract_all('"' || array_to_string(list_slice(string_split(text, ' '), 1, 2), ' ') || '" ' || text, '"([^"]+)"', 1)) AS name FROM docs WHERE text IS NOT NULL) SELECT name, count(*) AS n FROM q WHERE len(list_filter(regexp_split_to_array(name, '[\s\p{{Z}}]+'), lambda x: x <> '')) = 2 GROUP BY 1""",
    "first_answers": f"WITH {b.PROBES} SELECT substring(prompt, 1, 50) AS prompt, row_number() OVER (PARTITION BY prompt ORDER BY answer_id) AS r, response FROM probes QUALIFY r <= 5".replace("QUALIFY r <= 5", "QUALIFY row_number() OVER (PARTITION BY probes.prompt ORDER BY answer_id) <= 5").replace("(PARTITION BY prompt ORDER", "(PARTITION BY probes.prompt ORDER"),
    "prompt_grid": "SELECT i::INT AS i, " + " || ' ' || ".join(f"{vs!r}[(i % {len(vs)} + 1)::INT]" for vs in GRID.values()) + " AS prompt FROM range(200) t(i)",
    "trait_scenarios": _MODAL + "SELECT prompt, n.i AS n, value || n.s AS scenario FROM modal, (VALUES (0, ' at home'), (1, ' at work'), (2, ' outdoors')) n(i, s)",
    "train_val_split": f"WITH {b.DOCS}, {_SPLIT.format('doc_id', 'docs')} SELECT id AS doc_id, split FROM split_docs",
    "merge_splits": f"WITH {b.DOCS}, {b.PAIRS}, {_SPLIT.format('doc_id', 'docs')}, {_SPLIT.format('pair_id', 'prs')} SELECT dataset, split, count(*) AS n, min(id) AS first FROM (SELECT 'documents' AS dataset, * FROM split_docs UNION ALL SELECT 'pairs', * FROM split_prs) GROUP BY ALL",
    "resolved_paths": "SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN '/a/' ELSE '/b/' END || p_partkey AS path FROM part WHERE p_partkey % 3 = 0 OR p_partkey % 2 = 0",
    "training_plan": f"WITH {_PLAN} SELECT *, n // batch AS steps, n // batch * epochs AS max_steps, trunc(n // batch * epochs * 0.1::DOUBLE)::BIGINT AS warmup FROM pl",
    "memory_batches": "SELECT p_partkey, least(CASE WHEN p_size / 2 > 16 THEN 8 WHEN p_size / 2 > 10 THEN 6 WHEN p_size / 2 > 6 THEN 4 WHEN p_size / 2 > 3 THEN 2 ELSE 1 END, 6) AS batch FROM part",
    "config_documents": f"WITH {_PLAN} SELECT dataset_id, printf('{{\"epochs\":%d,\"batch\":%d,\"name\":\"run_%s\"}}', epochs, batch, dataset_id) AS config FROM pl",
    "newest_orders": "SELECT o_orderkey FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 50",
    "last_steps": "SELECT s_suppkey, CASE WHEN s_suppkey % 8 = 0 THEN 'train' WHEN s_suppkey % 4 = 0 THEN 'cluster' WHEN s_suppkey % 2 = 0 THEN 'scan' ELSE 'none' END AS step FROM supplier",
    "taxonomy_prompt": "SELECT '" + "' || chr(10) || '".join(f"{k}: {', '.join(t)}" for k, t in sorted(_TAX.items())) + "' AS prompt",
    "numbered_export": "SELECT s_name, printf('my_set_%04d', row_number() OVER (ORDER BY s_name)) AS export_name FROM supplier",
    "manifest_json": "SELECT n_regionkey, '[' || string_agg('{\"n_name\":\"' || n_name || '\"}', ',' ORDER BY n_name) || ']' AS manifest FROM nation GROUP BY 1",
    "columnar_messages": f"WITH {b.PAIRS} SELECT pair_id, 'assistant' AS role, instruction AS question, response AS answer FROM prs",
    "props_json": "SELECT event_id, json_extract_string(props, '$.k')::INT AS k FROM events",
    "hourly_events": "SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL",
    "streaming_windows": "SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL",
    "streaming_latest": "SELECT user_id, event_id, event_type FROM events WHERE user_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1",
    "pickle_scan": f"""SELECT p_partkey, m || '.' || n AS imports, CASE WHEN m IN {tuple(scan.SYSTEM)} OR n IN {(*scan.RUNNERS, "open", "system", "popen")} THEN 'dangerous' WHEN p_size % 5 = 0 THEN 'damaged' WHEN m NOT IN {tuple(scan.SAFE_MODULES)} THEN 'suspicious' ELSE 'safe' END AS risk
  FROM (SELECT p_partkey, p_size, {MODULES}[(p_partkey % {len(MODULES)} + 1)::INT] AS m, {NAMES}[(p_size % {len(NAMES)} + 1)::INT] AS n FROM part)""",
}
_EXPORTS = """ex AS (SELECT DISTINCT ON (export_id) export_id, file_name, CASE WHEN json_valid(payload) THEN payload::JSON END AS j FROM raw_export),
f AS (SELECT *, CASE WHEN j IS NULL THEN 'unknown' WHEN json_type(j) = 'OBJECT' AND list_has_all(json_keys(j), ['uuid', 'chat_messages']) THEN 'claude' WHEN json_type(j) = 'OBJECT' AND list_has_all(json_keys(j), ['name', 'mapping']) THEN 'gpt'
  WHEN json_type(j) = 'ARRAY' AND json_type(j, '$[0]') = 'OBJECT' AND list_has_all(json_keys(j, '$[0]'), ['role', 'content']) THEN 'generic' ELSE 'unknown' END AS format FROM ex)"""
_CLAUDE_SQL = f"""cm AS (SELECT export_id, j, unnest(range(coalesce(json_array_length(j, '$.chat_messages'), 0)::BIGINT)) AS i FROM f WHERE format = 'claude'),
claude AS (SELECT export_id, coalesce(j ->> 'uuid', 'unknown') AS conv_id, coalesce(j ->> 'name', 'Untitled') AS name, 'claude' AS format, i AS turn, json_extract(j, '$.chat_messages[' || i || ']') AS m FROM cm),
claude_said AS (SELECT export_id, conv_id, name, format, turn, CASE WHEN m ->> 'sender' = 'human' THEN 'user' ELSE 'assistant' END AS role, {b.strip("CASE WHEN json_type(m, '$.text') = 'ARRAY' THEN array_to_string(list_filter(from_json(m -> 'text', '[\"VARCHAR\"]'), lambda x: x IS NOT NULL), chr(10)) ELSE coalesce(m ->> 'text', '') END")} AS text FROM claude)"""
_GPT_SQL = f"""gk AS (SELECT export_id, j, unnest(json_keys(j, '$.mapping')) AS k, unnest(range(len(json_keys(j, '$.mapping')))) AS pos FROM mapped WHERE json_type(j, '$.mapping') = 'OBJECT'),
gm AS (SELECT export_id, j, pos, json_extract(j, '$.mapping."' || k || '".message') AS m FROM gk),
gp AS (SELECT export_id, j, pos, m, CASE WHEN json_type(m, '$.content.parts') = 'ARRAY' THEN list_filter(list_transform(from_json(m -> 'content' -> 'parts', '["JSON"]'), lambda p: CASE WHEN json_type(p) = 'VARCHAR' THEN p ->> '$' WHEN json_type(p) <> 'NULL' THEN p::VARCHAR END), lambda t: t IS NOT NULL AND t <> '') ELSE [] END AS parts FROM gm WHERE m IS NOT NULL AND json_type(m) <> 'NULL'),
gt AS (SELECT *, {b.strip("array_to_string(parts, chr(10))")} AS text FROM gp),
gpt_said AS (SELECT export_id, coalesce(j ->> 'id', 'unknown') AS conv_id, coalesce(j ->> 'title', 'Untitled') AS name, 'gpt' AS format, row_number() OVER (PARTITION BY export_id ORDER BY pos) - 1 AS turn, coalesce(m -> 'author' ->> 'role', 'unknown') AS role, text FROM gt WHERE text <> '')"""
_SAID = f"WITH {_EXPORTS}, mapped AS (SELECT * FROM f WHERE format = 'gpt'), {_CLAUDE_SQL}, {_GPT_SQL}, said AS (SELECT * FROM claude_said UNION ALL SELECT * FROM gpt_said) "
SQL |= {
    "export_formats": f"WITH {_EXPORTS} SELECT format, count(*) AS n FROM f GROUP BY 1",
    "parsed_exports": _SAID + "SELECT export_id, conv_id, format, turn, role, text FROM said",
    "parsed_conversations": _SAID + "SELECT export_id, conv_id, name, format, count(*) AS n_messages FROM said GROUP BY ALL",
    "gpt_messages": f"WITH {_EXPORTS}, mapped AS (SELECT * FROM f WHERE json_type(j) = 'OBJECT' AND list_contains(json_keys(j), 'mapping')), {_GPT_SQL} SELECT export_id, conv_id, turn, role, text FROM gpt_said",
    "generic_messages": f"SELECT DISTINCT source_file, conv_id, 'generic' AS format, role, {b.strip('content')} AS text, msg_id::VARCHAR AS message_id FROM conversation WHERE conv_id = 'generic_conversation' AND role IS NOT NULL AND content IS NOT NULL",
}
QUERIES = {k: globals()[k] for k in SQL}
