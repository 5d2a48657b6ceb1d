"""The registered queries of the training-data operators: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomfield.llm import byte_bpe, html_extract, langid, near_vectors, packing, pii, quality, simhash, token_counts, warc
from loomfield.llm.common import table


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), ids=False)


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    found = byte_bpe.decode(byte_bpe.encode(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN), ranks)
    return found.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join("ids", " ").cast("binary"), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op4_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors.near_vectors(table(spark, sf_dir, "embeddings")).drop("recall")


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.assess(table(spark, sf_dir, "documents"))
    return found.select("doc_id", *quality.BASE, "base_failed", "kept")


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def page_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify_pages(table(spark, sf_dir, "pages"))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(table(spark, sf_dir, "documents"))
    counts = [F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}") for k in pii.KINDS]
    both = F.concat_ws(",", F.nullif(pii.written(F.col("base")), F.lit("")), F.nullif(pii.written(pii.by_kind(F.col("terms"))), F.lit("")))
    return found.select("doc_id", *counts, F.sha2(pii.written(F.col("base")), 256).alias("base_sha256"), both.alias("spans"))


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = html_extract.extract(table(spark, sf_dir, "pages"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.archive_round_trip(table(spark, sf_dir, "pages"))
    return found.select("page_id", F.col("payload_length").alias("payload_bytes"), "payload_digest", "record_type", "refers_to")


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    "op1_packing": op1_packing,
    "op2_token_counts": op2_token_counts,
    "op3_byte_bpe": op3_byte_bpe,
    "op4_near_vectors": op4_near_vectors,
    "op5_quality_rules": op5_quality_rules,
    "op6_language_id": op6_language_id,
    "page_languages": page_languages,
    "op7_pii": op7_pii,
    "op8_html_extraction": op8_html_extraction,
    "op9_warc": op9_warc,
    "op10_simhash": op10_simhash,
    "pipeline": pipeline,
}

_BLANK, _WORD = "[\\x20\\x09-\\x0D]", "[^\\x20\\x09-\\x0D]"

_PERSONAL = {
    "email": "[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\\.[A-Za-z0-9-]+)+",
    "ip": "[0-9]+\\.[0-9]+\\.[0-9]+\\.[0-9]+",
    "card": "[0-9](?:[\\x20-]?[0-9])+",
    "phone": "\\+[0-9][\\x20().0-9-]+[0-9]",
}


def _located(rows: str, kind: str, pattern: str) -> str:
    """Matches of a pattern with their code points, from the lengths of what lies between and before."""
    return f"""
        SELECT t, '{kind}' AS kind, m[i] AS v, CAST(list_sum(list_transform(p[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS BIGINT) AS s
        FROM (SELECT t, regexp_extract_all(t, '{pattern}') AS m, string_split_regex(t, '{pattern}') AS p FROM {rows}), unnest(range(1, len(m) + 1)) AS u(i)
    """


ORACLE_SQL: dict[str, str] = {
    "op7_pii": f"""
        WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), texts AS (SELECT t, count(*) AS c FROM d GROUP BY t),
        matched AS ({" UNION ALL ".join(_located("texts", k, x) for k, x in _PERSONAL.items())}),
        spans AS (
            SELECT *, s + length(v) AS e, regexp_replace(v, '[^0-9]', '', 'g') AS g FROM matched
        ), base AS (
            SELECT *, CASE kind WHEN 'email' THEN 1 WHEN 'ip' THEN 2 WHEN 'card' THEN 3 ELSE 4 END AS k FROM spans
            WHERE CASE kind WHEN 'email' THEN TRUE WHEN 'ip' THEN len(list_filter(string_split(v, '.'), lambda x: CAST(x AS DOUBLE) > 255)) = 0
                  WHEN 'card' THEN length(g) BETWEEN 13 AND 19 AND list_sum(list_transform(range(1, length(g) + 1), lambda i: CASE WHEN (length(g) - i) % 2 = 0 THEN CAST(g[i] AS INTEGER) WHEN CAST(g[i] AS INTEGER) > 4 THEN 2 * CAST(g[i] AS INTEGER) - 9 ELSE 2 * CAST(g[i] AS INTEGER) END)) % 10 = 0
                  ELSE length(g) BETWEEN 9 AND 15 END
        ), entities AS (
            SELECT DISTINCT t, e FROM (
                SELECT t, kind || ':' || v AS e FROM base UNION ALL
                SELECT t, kind || '~' || CASE kind WHEN 'email' THEN lower(regexp_extract(v, '@(.*)$', 1)) WHEN 'ip' THEN regexp_extract(v, '^([0-9]+\\.[0-9]+)', 1) WHEN 'card' THEN left(g, 6) ELSE left(g, 4) END FROM base
            )
        ), own AS (
            SELECT t, unnest(list_distinct(regexp_extract_all(regexp_replace(t, '\\S*@\\S*', ' ', 'g'), '\\p{{L}}+'))) AS w FROM (SELECT DISTINCT t FROM entities)
        ), n_e AS (
            SELECT e, sum(c) AS n_e FROM entities JOIN texts USING (t) GROUP BY e HAVING count(*) >= {pii.SUPPORT}
        ), n_et AS (
            SELECT e, w, sum(c) AS n_et FROM entities JOIN n_e USING (e) JOIN own USING (t) JOIN texts USING (t) GROUP BY e, w HAVING count(*) >= {pii.SUPPORT}
        ), n_t AS (
            SELECT w, sum(c) AS n_t FROM (SELECT c, unnest(list_distinct(regexp_extract_all(t, '\\p{{L}}+'))) AS w FROM texts) GROUP BY w
        ), flagged AS (
            SELECT e, w, n_t = n_et AS gone FROM n_et JOIN n_e USING (e) JOIN n_t USING (w)
            WHERE log2(n_t / n_et) <= log2((SELECT CAST(count(*) AS DOUBLE) FROM d) / n_e) * (1 - 1 / {pii.ALPHA}::DOUBLE)
        ), told AS (
            SELECT t, w, bool_or(gone) AS gone FROM entities JOIN own USING (t) JOIN flagged USING (e, w) GROUP BY t, w
        ), words AS ({_located("(SELECT DISTINCT t FROM told)", "word", "\\p{L}+")}),
        terms AS (
            SELECT words.t, CASE WHEN gone THEN 'gone' ELSE 'term' END AS kind, s, s + length(v) AS e FROM words JOIN told ON told.t = words.t AND told.w = words.v
        ), written AS (
            SELECT t, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY k, s) AS b, count_if(k = 1) AS n1, count_if(k = 2) AS n2, count_if(k = 3) AS n3, count_if(k = 4) AS n4 FROM base GROUP BY t
        ), said AS (
            SELECT t, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY kind, s) AS x FROM terms GROUP BY t
        )
        SELECT doc_id, coalesce(n1, 0) AS n_email, coalesce(n2, 0) AS n_ip, coalesce(n3, 0) AS n_card, coalesce(n4, 0) AS n_phone, sha256(coalesce(b, '')) AS base_sha256, concat_ws(',', b, x) AS spans
        FROM d LEFT JOIN written USING (t) LEFT JOIN said USING (t)
    """,
    "op5_quality_rules": f"""
        WITH d AS (
            SELECT doc_id, coalesce(text, '') AS t, row_number() OVER () AS r FROM documents
        ), w AS (
            SELECT r, list_filter(string_split_regex(t, '{_BLANK}+'), lambda x: x <> '') AS w FROM d
        ), windows AS (
            SELECT r, i, array_to_string(w[i:i + 7], ' ') AS g FROM w, unnest(range(1, len(w) - 6)) AS u(i)
        ), twice AS (
            SELECT r, g FROM windows GROUP BY r, g HAVING count(*) > 1
        ), covered AS (
            SELECT r, count(DISTINCT i + k) AS n FROM windows JOIN twice USING (r, g), unnest(range(8)) AS u(k) GROUP BY r
        ), m AS (
            SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '{_BLANK}', '', 'g')) AS BIGINT) AS word_chars, CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
                   list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{_WORD}')) AS l, CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words,
                   length(regexp_replace(t, '\\P{{Lu}}', '', 'g')) AS capitals, length(regexp_replace(t, '\\P{{L}}', '', 'g')) AS letters, len(list_filter(range(1, len(w)), lambda i: w[i] = w[i + 1])) AS stutters
            FROM d JOIN w USING (r) LEFT JOIN covered USING (r)
        ), b AS (
            SELECT *, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m
        )
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
               NOT (base_failed OR 10 * n_symbols > n_words OR 2 * n_dup_lines > len(l) OR 10 * capitals > 4 * word_chars OR 10 * stutters > 3 * n_words OR word_chars < 2 * n_words OR word_chars > 15 * n_words OR 10 * letters < 4 * word_chars) AS kept
        FROM b
    """,
    "op4_near_vectors": """
        WITH RECURSIVE v AS (
            SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
        ), pairs AS (
            SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.9
        ), reach(a, b) AS (
            SELECT vec_id, vec_id FROM v UNION SELECT r.a, p.b FROM reach r JOIN pairs p ON r.b = p.a
        ), least AS (
            SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a
        )
        SELECT vec_id, CAST((SELECT count(*) FROM pairs WHERE a = least.vec_id) AS BIGINT) AS n_links, component_id, vec_id = component_id AS kept FROM least
    """,
    "op9_warc": """
        WITH h AS (
            SELECT page_id, coalesce(html, '') AS payload, sha1(coalesce(html, '')) AS hex FROM pages
        ), f AS (
            SELECT *, min(page_id) OVER (PARTITION BY payload) AS first_id FROM h
        )
        SELECT page_id,
               CAST(octet_length(encode(payload)) AS BIGINT) AS payload_bytes,
               array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                   1 + CAST(((CAST('0x' || substr(hex, 1 + 5 * (i // 4), 5) AS BIGINT) >> CAST(15 - 5 * (i % 4) AS BIGINT)) & 31) AS INTEGER), 1)), '') AS payload_digest,
               CASE WHEN page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN page_id <> first_id THEN first_id END AS refers_to
        FROM f
    """,
}
