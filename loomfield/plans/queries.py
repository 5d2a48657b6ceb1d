"""Registered queries over the driver's tables, each with SQL that must give the same rows where SQL can."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomfield.functions import html, text
from loomfield.operators import coerce as co
from loomfield.operators import evaluate, mapping, sources, validate
from loomfield.plans import catalogue, readers
from loomfield.plans import schema as s
from loomfield.streaming import windows


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


CUSTOMER = s.Schema(
    "Customer",
    "A customer record",
    {
        "name": s.string("Full name").constrain(max_length=18),
        "segment": s.enum("BUILDING", "AUTOMOBILE", "MACHINERY").describe("Market segment"),
        "balance": s.number().constrain(minimum=0, maximum=5000).optional(),
        "nation": s.number(),
    },
)


def html_to_text(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", text.html_to_text(F.col("html")).alias("text"))


def page_meta(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", html.page_to_text(F.col("html"), structured=False, body=False).alias("meta"))


def page_sources(spark, sf_dir):
    found = html.html_sources(table(spark, sf_dir, "pages"))
    return found.select("page_id", F.col("pos").cast("long").alias("pos"), "label", F.length("text").cast("long").alias("n_chars"))


def tidy_documents(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(text.tidy_text(F.col("text")).cast("binary")).alias("tidy_md5"))


def truncated(policy: str):
    def query(spark, sf_dir):
        return table(spark, sf_dir, "documents").select("doc_id", text.truncate_text(F.col("text"), F.lit(400), policy).alias("cut"))

    return query


def _conversation_sources(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations")
    return rows.select(F.col("conv_id").alias("item_id"), F.col("turn").cast("int").alias("pos"), F.lit("text").alias("kind"), F.col("role").alias("label"), "text", F.lit(None).cast("string").alias("media_type"), F.lit(None).cast("int").alias("max_chars"))


def render_conversations(spark, sf_dir):
    return sources.render_sources(sources.label_sources(_conversation_sources(spark, sf_dir)))


def budget_conversations(spark, sf_dir):
    cut = sources.budget_sources(_conversation_sources(spark, sf_dir), 600)
    return cut.select("item_id", F.col("pos").cast("long").alias("pos"), F.col("original_length").cast("long").alias("original_length"), F.col("kept_length").cast("long").alias("kept_length"))


def cast_numbers(spark, sf_dir):
    rows = table(spark, sf_dir, "orders")
    typed = F.concat(F.lit("EUR "), F.format_number("o_totalprice", 2))
    return rows.select("o_orderkey", text.parse_number(typed).alias("price"), text.parse_number(F.col("o_orderpriority")).alias("priority"))


def split_lists(spark, sf_dir):
    rows = table(spark, sf_dir, "part")
    return rows.select("p_partkey", F.array_join(text.split_list(F.regexp_replace("p_type", " ", "; ")), "+").alias("items"))


def map_customers(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_name").alias("Customer  Name"), F.col("c_mktsegment").alias("Segment"), F.col("c_acctbal").cast("decimal(12,2)").cast("string").alias("Balance (EUR)"))
    mapped = mapping.apply_mapping(rows, [("customer name", "name"), ("Segment", "segment"), ("balance (eur)", "balance"), ("Absent", "nation")], CUSTOMER)
    return mapped.select("c_custkey", F.get_json_object("data_json", "$.name").alias("name"), F.get_json_object("data_json", "$.segment").alias("segment"), F.get_json_object("data_json", "$.balance").cast("double").alias("balance"))


def row_texts(spark, sf_dir):
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_name").alias("Name"), F.col("s_nationkey").cast("string").alias("Nation"))
    return rows.select("s_suppkey", mapping.row_text(["Name", "Nation"]).alias("text"))


def _customer_json(spark, sf_dir):
    rows = table(spark, sf_dir, "customer")
    return rows.select("c_custkey", F.to_json(F.struct(F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"), F.col("c_acctbal").alias("balance"), F.col("c_nationkey").alias("nation"))).alias("data_json"))


def validate_customers(spark, sf_dir):
    found = validate.validate(_customer_json(spark, sf_dir), CUSTOMER)
    return found.select("c_custkey", F.explode("issues").alias("i")).select("c_custkey", "i.path", F.lit(1).cast("long").alias("n")).groupBy("path").agg(F.sum("n").alias("issues"), F.countDistinct("c_custkey").alias("customers"))


def repair_customers(spark, sf_dir):
    found = validate.validate(_customer_json(spark, sf_dir), CUSTOMER, repair="clamp")
    return found.select("c_custkey", F.get_json_object("data_json", "$.name").alias("name"), F.get_json_object("data_json", "$.balance").cast("double").alias("balance"), F.size("resolved").cast("long").alias("n_resolved"), F.size("issues").cast("long").alias("n_left"))


def _outcomes(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").where("c_acctbal is not null")
    want = rows.select("c_custkey", F.to_json(F.struct(F.col("c_mktsegment").alias("segment"), F.struct(F.col("c_nationkey").alias("key")).alias("nation"))).alias("data"))
    got = rows.select("c_custkey", F.to_json(F.struct(F.when(F.col("c_acctbal") >= 0, F.col("c_mktsegment")).alias("segment"), F.struct(F.pmod("c_nationkey", F.lit(20)).alias("key")).alias("nation"), F.when(F.col("c_acctbal") > 9000, F.lit("vip")).alias("tier"))).alias("data"))
    return evaluate.compare_leaves(evaluate.flatten_leaves(want, "c_custkey", "data"), evaluate.flatten_leaves(got, "c_custkey", "data"))


def eval_outcomes(spark, sf_dir):
    return _outcomes(spark, sf_dir).select(F.col("item").alias("c_custkey"), "path", "outcome")


def eval_field_stats(spark, sf_dir):
    return evaluate.field_stats(_outcomes(spark, sf_dir))


def eval_latency(spark, sf_dir):
    return evaluate.latency(table(spark, sf_dir, "events"), "value")


def coerce_documents(spark, sf_dir):
    """End to end with a deterministic provider: shaping, request keys, calls, validation, repair."""
    rows = table(spark, sf_dir, "customer")
    shaped = rows.select(F.col("c_custkey").alias("item_id"), F.lit(0).alias("pos"), F.lit("text").alias("kind"), F.lit(None).cast("string").alias("label"), F.concat_ws("\n", F.concat(F.lit("name: "), "c_name"), F.concat(F.lit("segment: "), "c_mktsegment"), F.concat(F.lit("balance: "), F.col("c_acctbal").cast("decimal(12,2)").cast("string")), F.concat(F.lit("nation: "), F.col("c_nationkey").cast("string"))).alias("text"), F.lit(None).cast("string").alias("media_type"), F.lit(None).cast("int").alias("max_chars"))
    found = co.coerce(shaped, CUSTOMER, co.ScriptedProvider(tuple(CUSTOMER.fields)), repair="both")
    return found.select(F.col("item_id").alias("c_custkey"), "status", F.get_json_object("data_json", "$.balance").cast("double").alias("balance"))


def request_keys(spark, sf_dir):
    rows = co.requests(_conversation_sources(spark, sf_dir), CUSTOMER, max_chars=1_000_000)
    return rows.select(F.col("item_id").alias("conv_id"), F.md5(F.col("user_input").cast("binary")).alias("input_md5"))


def merge_windows(spark, sf_dir):
    """Busy ranges of users: overlapping and touching half-hours after events become one."""
    rows = table(spark, sf_dir, "events").select("user_id", F.col("ts").alias("start"), (F.col("ts") + F.expr("interval 30 minutes")).alias("end"))
    return windows.merge_ranges(rows, ["user_id"], "start", "end")


def event_windows(spark, sf_dir):
    return windows.tumbling_counts(table(spark, sf_dir, "events"), "ts", "1 hour", ["event_type"])


def _cut_sql(policy: str) -> str:
    marker = "'[… ' || format('{:,}', n - room) || ' characters omitted …]'"
    body = {
        "tail": f"substr(text, 1, room) || chr(10) || {marker}",
        "head": f"{marker} || chr(10) || substr(text, n - room + 1)",
        "middle": f"substr(text, 1, CAST(ceil(room / 2) AS BIGINT)) || chr(10) || {marker} || chr(10) || substr(text, n - (room - CAST(ceil(room / 2) AS BIGINT)) + 1)",
    }[policy]
    return f"""
        WITH t AS (SELECT doc_id, text, length(text) AS n, greatest(0, 400 - length('[… ' || format('{{:,}}', length(text)) || ' characters omitted …]') - 2) AS room FROM documents)
        SELECT doc_id, CASE WHEN n <= 400 THEN text ELSE {body} END AS cut FROM t
    """


_TIDY = r"""
    trim(regexp_replace(array_to_string(list_transform(string_split(regexp_replace({}, '[ \t\f\x0B\x{{00A0}}]+', ' ', 'g'), chr(10)), lambda l: trim(l, ' ' || chr(9) || chr(13) || chr(160) || chr(11) || chr(12))), chr(10)), '\n{{3,}}', chr(10) || chr(10), 'g'), ' ' || chr(9) || chr(10) || chr(13))
"""


def _html_sql(column: str) -> str:
    t = f"regexp_replace({column}, '<!--[\\s\\S]*?-->', ' ', 'g')"
    for name in text.UNREAD:
        t = f"regexp_replace({t}, '<{name}\\b[^>]*>[\\s\\S]*?</{name}\\s*>', ' ', 'gi')"
    t = f"regexp_replace({t}, '<br\\s*/?>', chr(10), 'gi')"
    t = f"regexp_replace({t}, '<li\\b[^>]*>', chr(10) || '- ', 'gi')"
    t = f"regexp_replace({t}, '</?(?:{'|'.join(text.LINE_TAGS)})\\b[^>]*>', chr(10), 'gi')"
    t = f"regexp_replace({t}, '<[^>]+>', ' ', 'g')"
    for name, value in text.ENTITIES.items():
        quoted = value.replace("'", "''")
        t = f"replace({t}, '&{name};', '{quoted}')"
    return _TIDY.format(t)


QUERIES = {
    "html_to_text": html_to_text,
    "page_meta": page_meta,
    "page_sources": page_sources,
    "tidy_documents": tidy_documents,
    "truncate_tail": truncated("tail"),
    "truncate_head": truncated("head"),
    "truncate_middle": truncated("middle"),
    "render_conversations": render_conversations,
    "budget_conversations": budget_conversations,
    "cast_numbers": cast_numbers,
    "split_lists": split_lists,
    "map_customers": map_customers,
    "row_texts": row_texts,
    "validate_customers": validate_customers,
    "repair_customers": repair_customers,
    "eval_outcomes": eval_outcomes,
    "eval_field_stats": eval_field_stats,
    "eval_latency": eval_latency,
    "coerce_customers": coerce_documents,
    "request_inputs": request_keys,
    "merge_windows": merge_windows,
    "event_windows": event_windows,
}

_EVAL = """
    WITH leaves AS (
        SELECT c_custkey, 'segment' AS path, c_mktsegment AS want, CASE WHEN c_acctbal >= 0 THEN c_mktsegment END AS got FROM customer WHERE c_acctbal IS NOT NULL
        UNION ALL SELECT c_custkey, 'nation.key', CAST(c_nationkey AS VARCHAR), CAST(c_nationkey % 20 AS VARCHAR) FROM customer WHERE c_acctbal IS NOT NULL
        UNION ALL SELECT c_custkey, 'tier', NULL, CASE WHEN c_acctbal > 9000 THEN 'vip' END FROM customer WHERE c_acctbal IS NOT NULL
    ), outcomes AS (
        SELECT c_custkey, path, CASE WHEN want IS NULL THEN 'extra' WHEN got IS NULL THEN 'missing' WHEN want = got THEN 'match' ELSE 'wrong' END AS outcome
        FROM leaves WHERE want IS NOT NULL OR got IS NOT NULL
    )
"""
_BLOCK = """'<source label="' || {label} || '">' || chr(10) || regexp_replace(text, '</(\\s*source\\b)', '<\\\\/\\1', 'gi') || chr(10) || '</source>'"""

ORACLE_SQL = {
    "html_to_text": f"SELECT page_id, {_html_sql('html')} AS text FROM pages",
    "page_sources": f"""
        WITH t AS (SELECT page_id, {_html_sql('html')} AS text, {{META}} AS meta FROM pages),
        u AS (SELECT page_id, 0 AS k, 'Page (structured data)' AS label, meta AS text FROM t WHERE meta <> '' UNION ALL SELECT page_id, 1, 'Page', text FROM t WHERE text <> '')
        SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY k) - 1 AS pos, label, CAST(length(text) AS BIGINT) AS n_chars FROM u
    """,
    "page_meta": r"""
        WITH t AS (SELECT page_id, trim(regexp_replace(replace(replace(regexp_extract(html, '<title>([\s\S]*?)</title>', 1), '&quot;', '"'), '&amp;', '&'), '\s+', ' ', 'g')) AS title FROM pages)
        SELECT page_id, CASE WHEN title <> '' THEN 'Page metadata:' || chr(10) || 'title: ' || title ELSE '' END AS meta FROM t
    """,
    "tidy_documents": f"SELECT doc_id, md5({_TIDY.format(chr(39).join(['regexp_replace(text, ', chr(92) + 'r' + chr(92) + 'n?', ', chr(10), ', 'g', ')']))}) AS tidy_md5 FROM documents",
    **{f"truncate_{p}": _cut_sql(p) for p in ("tail", "head", "middle")},
    "render_conversations": f"SELECT conv_id AS item_id, string_agg({_BLOCK.format(label='role')}, chr(10) || chr(10) ORDER BY turn) AS user_input FROM conversations GROUP BY conv_id",
    "budget_conversations": """
        WITH RECURSIVE s AS (
            SELECT conv_id, turn, length(text) AS n, row_number() OVER (PARTITION BY conv_id ORDER BY length(text), turn) AS k, count(*) OVER (PARTITION BY conv_id) AS all_, sum(length(text)) OVER (PARTITION BY conv_id) AS whole FROM conversations
        ), g AS (
            SELECT conv_id, turn, n, k, all_, whole, least(n, 600 // all_) AS given, 600 - least(n, 600 // all_) AS rest FROM s WHERE k = 1
            UNION ALL SELECT s.conv_id, s.turn, s.n, s.k, s.all_, s.whole, least(s.n, g.rest // (s.all_ - g.k)), g.rest - least(s.n, g.rest // (s.all_ - g.k)) FROM g JOIN s ON s.conv_id = g.conv_id AND s.k = g.k + 1
        ), c AS (
            SELECT conv_id, turn, n, CASE WHEN whole <= 600 THEN n ELSE given END AS given FROM g
        ), r AS (
            SELECT *, greatest(0, given - length('[… ' || format('{:,}', n) || ' characters omitted …]') - 2) AS room FROM c
        )
        SELECT conv_id AS item_id, turn AS pos, CAST(n AS BIGINT) AS original_length, CAST(CASE WHEN n <= given THEN n ELSE room + 1 + length('[… ' || format('{:,}', n - room) || ' characters omitted …]') END AS BIGINT) AS kept_length FROM r
    """,
    "cast_numbers": "SELECT o_orderkey, round(o_totalprice, 2) AS price, CAST(NULL AS DOUBLE) AS priority FROM orders",
    "split_lists": "SELECT p_partkey, replace(p_type, ' ', '+') AS items FROM part",
    "map_customers": "SELECT c_custkey, c_name AS name, c_mktsegment AS segment, CAST(CAST(c_acctbal AS DECIMAL(12,2)) AS DOUBLE) AS balance FROM customer",
    "row_texts": "SELECT s_suppkey, 'Name: ' || s_name || chr(10) || 'Nation: ' || s_nationkey AS text FROM supplier",
    "validate_customers": """
        WITH i AS (
            SELECT c_custkey, 'name' AS path FROM customer WHERE length(c_name) > 18
            UNION ALL SELECT c_custkey, 'segment' FROM customer WHERE c_mktsegment NOT IN ('BUILDING', 'AUTOMOBILE', 'MACHINERY')
            UNION ALL SELECT c_custkey, 'balance' FROM customer WHERE c_acctbal < 0 OR c_acctbal > 5000
        ) SELECT path, CAST(count(*) AS BIGINT) AS issues, count(DISTINCT c_custkey) AS customers FROM i GROUP BY path
    """,
    "repair_customers": """
        SELECT c_custkey, left(c_name, 18) AS name, least(greatest(c_acctbal, 0), 5000) AS balance,
               CAST((length(c_name) > 18)::INT + (c_acctbal < 0 OR c_acctbal > 5000)::INT AS BIGINT) AS n_resolved,
               CAST((c_mktsegment NOT IN ('BUILDING', 'AUTOMOBILE', 'MACHINERY'))::INT AS BIGINT) AS n_left
        FROM customer
    """,
    "eval_outcomes": _EVAL + "SELECT * FROM outcomes",
    "eval_field_stats": _EVAL + """
        , s AS (SELECT path, count_if(outcome = 'match') AS tp, count_if(outcome IN ('wrong', 'extra')) AS fp, count_if(outcome IN ('wrong', 'missing')) AS fn FROM outcomes GROUP BY path)
        SELECT path, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(fn AS BIGINT) AS fn, tp / nullif(tp + fp, 0) AS precision, tp / nullif(tp + fn, 0) AS recall FROM s
    """,
    "eval_latency": "SELECT quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95 FROM events",
    "coerce_customers": """
        SELECT c_custkey, CASE WHEN c_mktsegment IN ('BUILDING', 'AUTOMOBILE', 'MACHINERY') THEN 'ok' ELSE 'failed' END AS status,
               CAST(least(greatest(CAST(c_acctbal AS DECIMAL(12,2)), 0), 5000) AS DOUBLE) AS balance
        FROM customer
    """,
    "merge_windows": """
        WITH r AS (SELECT user_id, ts AS s, ts + INTERVAL 30 MINUTE AS e FROM events),
        m AS (SELECT *, max(e) OVER (PARTITION BY user_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM r),
        g AS (SELECT *, sum(CASE WHEN before IS NULL OR s > before THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS island FROM m)
        SELECT user_id, min(s) AS "start", max(e) AS "end", count(*) AS n FROM g GROUP BY user_id, island
    """,
    "event_windows": """
        SELECT event_type, date_trunc('hour', ts) AS window_start, date_trunc('hour', ts) + INTERVAL 1 HOUR AS window_end, count(*) AS n FROM events GROUP BY ALL
    """,
}
_META = ORACLE_SQL["page_meta"].replace("FROM pages)", "FROM pages WHERE page_id = p.page_id)")
ORACLE_SQL["page_sources"] = ORACLE_SQL["page_sources"].replace("{META}", f"(SELECT meta FROM ({_META}))").replace("AS meta FROM pages", "AS meta FROM pages p")
ORACLE_SQL["request_inputs"] = f"SELECT item_id AS conv_id, md5(user_input) AS input_md5 FROM ({ORACLE_SQL['render_conversations']})"

QUERIES |= catalogue.QUERIES | readers.QUERIES
ORACLE_SQL |= catalogue.ORACLE_SQL | readers.ORACLE_SQL
