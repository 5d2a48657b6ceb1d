"""More registered queries: sources, windows, replay, evaluation and the readers over documents made of table rows."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomfield.operators import coerce as co
from loomfield.operators import evaluate, mapping, provenance, sources, validate
from loomfield.plans import schema as s
from loomfield.sources import calendars, delimited, feeds, mail, transcripts
from loomfield.sources.rows import spread
from loomfield.streaming import windows


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


SUPPLIER = s.Schema("Supplier", "A supplier", {"name": s.string(), "nation": s.values_from("nations"), "balance": s.number().optional()})


def _turns(spark, sf_dir) -> DataFrame:
    """Conversation turns as sources: what a user says stands for an image, what others say for a document."""
    rows = table(spark, sf_dir, "conversations")
    kind = F.when(F.col("role") == "user", "image").otherwise("document")
    return rows.select(F.col("conv_id").alias("item_id"), F.col("turn").cast("int").alias("pos"), kind.alias("kind"), F.when(F.col("role") == "user", F.lit(" ")).otherwise(F.col("role")).alias("label"), "text")


def label_turns(spark, sf_dir):
    return sources.label_sources(_turns(spark, sf_dir)).select("item_id", F.col("pos").cast("long").alias("pos"), "label")


def cap_turns(spark, sf_dir):
    return sources.cap_binary(_turns(spark, sf_dir), 2, 1).groupBy("item_id").agg(F.count_if("capped").alias("n_capped"))


def _segments(spark, sf_dir) -> DataFrame:
    at = (F.hour("ts") * 3600 + F.minute("ts") * 60 + F.second("ts")).cast("double")
    return table(spark, sf_dir, "events").select("user_id", at.alias("start"), (at + 20).alias("end"), F.col("event_type").alias("speaker"), F.col("event_id").cast("string").alias("text"))


def transcript_chunks(spark, sf_dir):
    return transcripts.chunks(_segments(spark, sf_dir), "user_id", 600.0)


def transcript_speakers(spark, sf_dir):
    return transcripts.speakers(_segments(spark, sf_dir), "user_id").select("user_id", F.array_join("speakers", ",").alias("speakers"))


def transcript_turns(spark, sf_dir):
    """A fold whose state is the block's own start."""
    return transcripts.coalesce_segments(_segments(spark, sf_dir), "user_id", 3600.0)


def overlapping_events(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", F.col("ts").alias("start"), (F.col("ts") + F.expr("interval 2 hours")).alias("end"))
    span = rows.agg(F.date_trunc("day", F.min("start")).alias("a")).first()["a"]
    return windows.overlapping(rows, "start", "end", F.lit(span) + F.expr("interval 1 day"), F.lit(span) + F.expr("interval 3 days")).select("event_id")


def replay_outcomes(spark, sf_dir):
    """Requests answered by recordings, here those of one market segment, and the misses that are left."""
    rows = table(spark, sf_dir, "customer")
    text = F.concat_ws("\n", F.concat(F.lit("name: "), "c_name"), F.concat(F.lit("segment: "), "c_mktsegment"))
    shaped = rows.select(F.col("c_custkey").alias("item_id"), F.lit(0).alias("pos"), F.lit("text").alias("kind"), F.lit(None).cast("string").alias("label"), text.alias("text"), F.lit(None).cast("string").alias("media_type"), F.lit(None).cast("int").alias("max_chars"))
    asked = co.requests(shaped, SUPPLIER)
    recorded = asked.where(F.col("user_input").contains("segment: BUILDING")).select("request_key", F.lit("{}").alias("data_json"), F.lit(0).cast("timestamp").alias("recorded_at"))
    hits, misses = co.replay(asked, recorded)
    return hits.select(F.col("item_id").alias("c_custkey"), F.lit("hit").alias("outcome")).unionByName(misses.select(F.col("item_id").alias("c_custkey"), F.lit("miss").alias("outcome")))


def usage_cost(spark, sf_dir):
    used = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sum(F.length("text")).alias("p"), F.count("*").alias("c"))
    return used.select("conv_id", F.round(evaluate.cost(F.col("p"), F.col("c"), F.lit(None).cast("long"), F.lit(None).cast("long"), {"input": 3.0, "output": 15.0}), 9).alias("cost"))


def _supplier_json(spark, sf_dir) -> DataFrame:
    nations = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("s_nationkey"), "n_name")
    rows = table(spark, sf_dir, "supplier").join(nations, "s_nationkey", "left")
    return rows.select("s_suppkey", F.to_json(F.struct(F.col("s_name").alias("name"), F.col("n_name").alias("nation"), F.col("s_acctbal").alias("balance"))).alias("data_json"))


def enum_violations(spark, sf_dir):
    """Nations outside the values of a resolved source: those of the regions that sort before M."""
    near = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region").where("r_name < 'M'"), F.col("n_regionkey") == F.col("r_regionkey"))
    enums = s.resolve_enums(SUPPLIER, lambda source: near.select("n_name"))
    found = validate.validate(_supplier_json(spark, sf_dir), SUPPLIER, enums=enums)
    return found.select("s_suppkey", F.size("issues").cast("long").alias("n_issues"))


def typed_suppliers(spark, sf_dir):
    rows = validate.typed(validate.validate(_supplier_json(spark, sf_dir), SUPPLIER), SUPPLIER)
    return rows.select("s_suppkey", "data.name", "data.nation", "data.balance")


def provenance_split(spark, sf_dir):
    """Answers whose fields are wrapped with confidence and evidence, split into data and provenance."""
    rows = table(spark, sf_dir, "supplier")
    wrap = lambda value, sure: F.struct(value.alias("value"), F.lit(sure).alias("confidence"), F.lit("as listed").alias("evidence"))
    answer = F.struct(wrap(F.col("s_name"), "high").alias("name"), wrap(F.col("s_nationkey").cast("string"), "low").alias("nation"), wrap(F.col("s_acctbal"), "unsure").alias("balance"))
    split = provenance.split(rows.select("s_suppkey", F.to_json(answer).alias("data_json")), SUPPLIER)
    return split.select("s_suppkey", F.get_json_object("data_json", "$.name").alias("name"), F.col("provenance")["name"]["confidence"].alias("name_confidence"), F.col("provenance")["balance"]["confidence"].alias("balance_confidence"))


def eval_diff(spark, sf_dir):
    rows = table(spark, sf_dir, "orders")
    want = rows.select("o_orderkey", F.to_json(F.struct(F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"))).alias("data"))
    guess = rows.select("o_orderkey", F.to_json(F.struct(F.lit("O").alias("status"), F.when(F.col("o_totalprice") > 100000, F.col("o_orderpriority")).alias("priority"))).alias("data"))
    leaves = lambda x: evaluate.flatten_leaves(x, "o_orderkey", "data")
    before, after = (evaluate.field_stats(evaluate.compare_leaves(leaves(want), leaves(got))) for got in (guess, want))
    return evaluate.diff_stats(before, after).select("path", F.round("precision_change", 9).alias("precision_change"), F.round("recall_change", 9).alias("recall_change"))


def event_outlines(spark, sf_dir):
    return feeds.read_json(table(spark, sf_dir, "events").select("event_id", "props"), "event_id", "props").select("event_id", "text")


def feed_entries(spark, sf_dir):
    """Feeds of the parts of each brand, read back as entries."""
    item = F.concat(F.lit("<item><title>"), F.col("p_name"), F.lit("</title><guid>"), F.col("p_partkey").cast("string"), F.lit("</guid><category>"), F.col("p_type"), F.lit("</category></item>"))
    made = table(spark, sf_dir, "part").groupBy("p_brand").agg(F.array_join(F.array_sort(F.collect_list(item)), "").alias("items"))
    xml = F.concat(F.lit('<?xml version="1.0"?><rss version="2.0"><channel><title>parts</title>'), F.col("items"), F.lit("</channel></rss>"))
    return feeds.read_feeds(made.select("p_brand", xml.alias("xml")), "p_brand", "xml").select("p_brand", F.col("id").cast("long").alias("p_partkey"), "title", F.col("categories")[0].alias("category"))


def mailbox_messages(spark, sf_dir):
    """Conversations as mailboxes: split, parsed, and ordered as threads."""
    date = F.date_format(F.timestamp_seconds(F.col("turn") * 86400), "EEE, dd MMM yyyy HH:mm:ss '+0000'")
    raw = F.concat(F.lit("From sender\nFrom: "), F.col("role"), F.lit(" <"), F.col("role"), F.lit("@mail.example>\nSubject: Turn "), F.col("turn").cast("string"), F.lit("\nDate: "), date, F.lit("\n\nbody\n"))
    boxes = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("turn")).alias("t"), raw.alias("raw")))), lambda x: x["raw"]), "").alias("box"))
    each = boxes.select("conv_id", F.posexplode(mail.split_mbox(F.col("box"))).alias("pos", "raw")).select(F.struct("conv_id", "pos").alias("k"), "raw")
    read = mail.read_messages(each, "k", "raw").select("k.conv_id", "k.pos", "*").drop("k")
    return mail.thread_order(read, "conv_id").select("conv_id", F.col("number").cast("long").alias("number"), "label", "subject")


def delimited_rows(spark, sf_dir):
    """Customers of each nation as delimited text with quoted cells, parsed back."""
    line = F.concat(F.lit('"'), F.col("c_name"), F.lit('";"'), F.col("c_mktsegment"), F.lit('"";";'), F.col("c_custkey").cast("string"))
    made = table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.array_join(F.array_sort(F.collect_list(line)), "\r\n").alias("body"))
    cells = delimited.parse_column(made.withColumn("body", F.concat(F.lit("name;segment;key\r\n"), "body")), "c_nationkey", "body").where("row_number > 1")
    return cells.select("c_nationkey", F.col("cells")[0].alias("name"), F.col("cells")[1].alias("segment"), F.col("cells")[2].cast("long").alias("c_custkey"))


def weekly_orders(spark, sf_dir):
    """Each order's date as a calendar event that recurs four times a week apart."""
    stamp = F.date_format("o_orderdate", "yyyyMMdd'T'HHmmss'Z'")
    ics = F.concat(F.lit("BEGIN:VCALENDAR\r\nBEGIN:VEVENT\r\nUID:"), F.col("o_orderkey").cast("string"), F.lit("\r\nDTSTART:"), stamp, F.lit("\r\nDURATION:PT1H\r\nRRULE:FREQ=WEEKLY;COUNT=4\r\nEND:VEVENT\r\nEND:VCALENDAR\r\n"))
    orders = spread(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate"))  # before the texts are made
    busy = calendars.calendar_ranges(orders.select("o_orderkey", ics.alias("ics")), "o_orderkey", "ics", datetime(1970, 1, 1, tzinfo=timezone.utc), datetime(2100, 1, 1, tzinfo=timezone.utc))
    return busy.select("o_orderkey", F.col("start").alias("starts"), F.col("end").alias("ends"))


def part_table(spark, sf_dir):
    return mapping.table_text(table(spark, sf_dir, "part"), ["p_brand", "p_name"], "p_partkey")


QUERIES = {
    "label_turns": label_turns,
    "cap_turns": cap_turns,
    "transcript_chunks": transcript_chunks,
    "transcript_speakers": transcript_speakers,
    "transcript_turns": transcript_turns,
    "overlapping_events": overlapping_events,
    "replay_outcomes": replay_outcomes,
    "usage_cost": usage_cost,
    "enum_violations": enum_violations,
    "typed_suppliers": typed_suppliers,
    "provenance_split": provenance_split,
    "eval_diff": eval_diff,
    "event_outlines": event_outlines,
    "feed_entries": feed_entries,
    "mailbox_messages": mailbox_messages,
    "delimited_rows": delimited_rows,
    "weekly_orders": weekly_orders,
    "part_table": part_table,
}

_SECONDS = "CAST(hour(ts) * 3600 + minute(ts) * 60 + second(ts) AS DOUBLE)"
_RATES = "SELECT '{p}' AS path, count_if({match}) AS tp, count_if({got} AND NOT {match}) AS fp, count_if(NOT ({match})) AS fn FROM orders"

ORACLE_SQL = {
    "label_turns": """
        SELECT conv_id AS item_id, turn AS pos,
               CASE WHEN role <> 'user' THEN role WHEN count(*) OVER (PARTITION BY conv_id) > 1 THEN 'Source ' || row_number() OVER (PARTITION BY conv_id ORDER BY turn) END AS label
        FROM conversations
    """,
    "cap_turns": """
        WITH r AS (SELECT conv_id, role = 'user' AS own, row_number() OVER (PARTITION BY conv_id, role = 'user' ORDER BY turn) AS k FROM conversations)
        SELECT conv_id AS item_id, CAST(count_if(k > CASE WHEN own THEN 2 ELSE 1 END) AS BIGINT) AS n_capped FROM r GROUP BY conv_id
    """,
    "transcript_chunks": f"""
        WITH c AS (SELECT user_id, CAST(floor({_SECONDS} / 600) AS BIGINT) AS chunk, max({_SECONDS} + 20) AS spoken, count(*) AS n FROM events GROUP BY ALL)
        SELECT user_id, chunk, CAST(chunk * 600 AS DOUBLE) AS chunk_start, CASE WHEN chunk = max(chunk) OVER (PARTITION BY user_id) THEN spoken ELSE CAST((chunk + 1) * 600 AS DOUBLE) END AS chunk_end, n FROM c
    """,
    "transcript_speakers": f"""
        WITH f AS (SELECT user_id, event_type, min({_SECONDS}) AS first_at FROM events WHERE event_type IS NOT NULL GROUP BY ALL)
        SELECT user_id, string_agg(event_type, ',' ORDER BY first_at, event_type) AS speakers FROM f GROUP BY user_id
    """,
    "transcript_turns": f"""
        WITH RECURSIVE s AS (
            SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY a, b, speaker NULLS FIRST, t NULLS FIRST) AS k
            FROM (SELECT user_id, {_SECONDS} AS a, {_SECONDS} + 20 AS b, event_type AS speaker, CAST(event_id AS VARCHAR) AS t FROM events)
        ), f AS (
            SELECT user_id, k, a, b, speaker, t, a AS begun, 1 AS block FROM s WHERE k = 1
            UNION ALL SELECT s.user_id, s.k, s.a, s.b, s.speaker, s.t, CASE WHEN s.speaker IS NOT DISTINCT FROM f.speaker AND s.b - f.begun <= 3600 THEN f.begun ELSE s.a END,
                             CASE WHEN s.speaker IS NOT DISTINCT FROM f.speaker AND s.b - f.begun <= 3600 THEN f.block ELSE f.block + 1 END
            FROM f JOIN s ON s.user_id = f.user_id AND s.k = f.k + 1
        )
        SELECT user_id, min(a) AS "start", max(b) AS "end", any_value(speaker) AS speaker, string_agg(t, ' ' ORDER BY k) AS text FROM f GROUP BY user_id, block
    """,
    "overlapping_events": """
        WITH d AS (SELECT date_trunc('day', min(ts)) AS a FROM events)
        SELECT event_id FROM events, d WHERE ts < a + INTERVAL 3 DAY AND ts + INTERVAL 2 HOUR > a + INTERVAL 1 DAY
    """,
    "replay_outcomes": "SELECT c_custkey, CASE WHEN c_mktsegment = 'BUILDING' THEN 'hit' ELSE 'miss' END AS outcome FROM customer",
    "usage_cost": "SELECT conv_id, round(sum(length(text)) / 1000000 * 3.0::DOUBLE + count(*) / 1000000 * 15.0::DOUBLE, 9) AS cost FROM conversations GROUP BY conv_id",
    "enum_violations": """
        WITH near AS (SELECT n_nationkey FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name < 'M')
        SELECT s_suppkey, CAST(CASE WHEN EXISTS (SELECT 1 FROM near WHERE n_nationkey = s_nationkey) THEN 0 ELSE 1 END AS BIGINT) AS n_issues FROM supplier
    """,
    "typed_suppliers": "SELECT s_suppkey, s_name AS name, n_name AS nation, s_acctbal AS balance FROM supplier LEFT JOIN nation ON n_nationkey = s_nationkey",
    "provenance_split": "SELECT s_suppkey, s_name AS name, 'high' AS name_confidence, CAST(NULL AS VARCHAR) AS balance_confidence FROM supplier",
    "eval_diff": f"""
        WITH s AS ({_RATES.format(p="status", match="o_orderstatus = 'O'", got="TRUE")} UNION ALL {_RATES.format(p="priority", match="o_totalprice > 100000", got="o_totalprice > 100000")})
        SELECT path, round(1 - tp / nullif(tp + fp, 0), 9) AS precision_change, round(1 - tp / nullif(tp + fn, 0), 9) AS recall_change FROM s WHERE fp + fn > 0
    """,
    "event_outlines": "SELECT event_id, 'k: ' || json_extract_string(props, '$.k') AS text FROM events WHERE props IS NOT NULL",
    "feed_entries": "SELECT p_brand, p_partkey, p_name AS title, p_type AS category FROM part",
    "mailbox_messages": """
        SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS number,
               'Message ' || row_number() OVER (PARTITION BY conv_id ORDER BY turn) || ' from ' || role || ' on ' || strftime(DATE '1970-01-01' + CAST(turn AS INTEGER), '%Y-%m-%d') AS label, 'Turn ' || turn AS subject
        FROM conversations
    """,
    "delimited_rows": "SELECT c_nationkey, c_name AS name, c_mktsegment || '\";' AS segment, c_custkey FROM customer",
    "weekly_orders": """
        SELECT o_orderkey, date_trunc('second', o_orderdate) + INTERVAL 7 DAY * k AS starts, date_trunc('second', o_orderdate) + INTERVAL 7 DAY * k + INTERVAL 1 HOUR AS ends
        FROM orders, (SELECT unnest(range(4))::INTEGER AS k)
    """,
    "part_table": """
        WITH c AS (
            SELECT p_partkey, CASE WHEN length(p_brand) > 40 THEN substr(p_brand, 1, 39) || '…' ELSE p_brand END AS b, CASE WHEN length(p_name) > 40 THEN substr(p_name, 1, 39) || '…' ELSE p_name END AS n
            FROM (SELECT p_partkey, regexp_replace(coalesce(p_brand, ''), '\\s+', ' ', 'g') AS p_brand, regexp_replace(coalesce(p_name, ''), '\\s+', ' ', 'g') AS p_name FROM part)
        )
        SELECT p_partkey, rtrim(rpad(b, CAST(greatest((SELECT max(length(b)) FROM c), 7) AS INTEGER), ' ') || ' | ' || rpad(n, CAST(greatest((SELECT max(length(n)) FROM c), 6) AS INTEGER), ' '), ' ') AS line FROM c
    """,
}
