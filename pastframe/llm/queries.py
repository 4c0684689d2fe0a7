"""One query for each operator of this subpackage, over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pastframe.llm import bpe, conversation_trie, decontamination, lexical, line_templates, mixing, pii, quality_rules, simhash, tool_calls, toxicity, warc, weak_quality
from pastframe.llm.common import new_folder, settled


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_personal_data(_table(spark, sf_dir, "documents"))
    kinds = F.transform("base", lambda x: x["kind"])
    counts = [F.size(F.array_remove(kinds, "none")) - F.size(F.array_remove(kinds, k)) for k in pii.KINDS]
    counts = [c.cast("long").alias(f"n_{k}") for c, k in zip(counts, pii.KINDS, strict=True)]
    return found.select("doc_id", *counts, F.sha2(pii.spelled(F.col("base")), 256).alias("base_sha256"), pii.spelled(F.col("spans")).alias("spans"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weak_quality.quality(_table(spark, sf_dir, "documents"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_rules(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op6_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tool_calls.formatted(_table(spark, sf_dir, "conversations"))


def chat_tool_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 6 on calls, which the given conversations lack: every assistant's turn is told as a call, the user's turn after it as its result.

    A call's arguments are its turn and the length of its text, and it depends on the conversation's call before, or in
    conversations whose id leaves 3 by 7 on the one after. Every
    fourth conversation has no schema; every third one's schema knows no length, and those of an even id allow turns of
    one and three only. A last turn of the assistant has no result; in conversations whose id leaves 1 by 5, results name another call.
    """
    m = _table(spark, sf_dir, "conversations")
    w = Window.partitionBy("conv_id", "role").orderBy("turn")
    m = m.withColumn("before", F.when(F.col("conv_id") % 7 == 3, F.lead("turn").over(w)).otherwise(F.lag("turn").over(w))).withColumn("asked", F.lag("role").over(Window.partitionBy("conv_id").orderBy("turn")) == "assistant")
    name = lambda turn: F.concat(F.lit("call-"), turn.cast("string"))
    args = F.to_json(F.struct(F.length("text").alias("size"), F.col("turn").cast("int").alias("turn")))
    call = F.to_json(F.struct(F.array(F.struct(name(F.col("turn")).alias("id"), F.lit("reply").alias("name"), args.alias("arguments"), F.when(F.col("before").isNotNull(), F.array(name(F.col("before")))).otherwise(F.array().cast("array<string>")).alias("depends_on"))).alias("tool_calls")))
    result = F.to_json(F.struct(F.when(F.col("conv_id") % 5 == 1, F.lit("call-none")).otherwise(name(F.col("turn") - 1)).alias("tool_call_id"), F.md5("text").alias("content")))
    turn = F.when(F.col("conv_id") % 2 == 0, F.lit('{"enum":[1,3],"type":"integer"}')).otherwise('{"type":"integer"}')
    size = F.when(F.col("conv_id") % 3 == 0, "").otherwise('"size":{"type":"integer"},')
    schema = F.concat(F.lit('{"tools":[{"name":"reply","parameters":{"additionalProperties":false,"type":"object","properties":{'), size, F.lit('"turn":'), turn, F.lit("}}}]}"))
    tools = m.where("conv_id % 4 <> 3").select("conv_id").distinct().select("conv_id", F.lit(-1).cast("bigint").alias("turn"), F.lit("system").alias("role"), schema.alias("text"))
    said = F.when(F.col("role") == "assistant", call).when((F.col("role") == "user") & F.col("asked"), result).otherwise(F.col("text"))
    role = F.when((F.col("role") == "user") & F.col("asked"), "tool").otherwise(F.col("role"))
    rows = tool_calls.formatted(m.select("conv_id", "turn", role.alias("role"), said.alias("text")).unionByName(tools))
    return rows.where("turn >= 0").withColumn("json", F.when(F.col("kind") != "message", F.col("json")))


def op7_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = bpe.encode_decode(_table(spark, sf_dir, "documents").select("doc_id", "text"), vocabulary_path())
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_templates.with_kept_lines(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_dropped", F.sha2("text", 256).alias("text_sha256"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = new_folder(spark, "archives")
    warc.write_archives(_table(spark, sf_dir, "pages"), out)
    back = warc.read_archives(spark, out, payload=False)
    return back.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op10_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op11_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns, members = conversation_trie.positioned(_table(spark, sf_dir, "conversations"))
    return settled(spark, lambda: conversation_trie.trie(*conversation_trie.reopened(turns, members)), "trie")


def op12_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(_table(spark, sf_dir, "documents"))


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_simhash_near_dedup, op2_pii, op3_toxicity, op4_quality_classifier, op5_quality_rules, op6_chat_formatting, op7_bpe_round_trip, op8_line_dedup, op9_warc, op10_benchmark_decontamination, op11_conversation_trie, op12_mixing, op13_lexical_search, chat_tool_links)}


#: For conversations without tool calls, which is what the tables hold; chat_tool_links has calls.
OP6_SQL = """
SELECT conv_id, CAST(turn AS INTEGER) AS turn, CAST(turn AS INTEGER) AS order_turn, 0 AS level, 'message' AS kind, CAST(NULL AS VARCHAR) AS call_id,
  CAST(NULL AS VARCHAR) AS status, CAST(NULL AS VARCHAR) AS problem,
  CAST(to_json({'content': text, 'conv_id': conv_id, 'role': role, 'turn': CAST(turn AS INTEGER)}) AS VARCHAR) AS json
FROM conversations
"""

LINKS_SQL = """
WITH m AS (
  SELECT conv_id, CAST(turn AS INTEGER) AS turn, role, text, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) - 1 AS k,
    CASE WHEN conv_id % 7 = 3 THEN lead(turn) OVER (PARTITION BY conv_id, role ORDER BY turn) ELSE lag(turn) OVER (PARTITION BY conv_id, role ORDER BY turn) END AS before,
    count(*) OVER (PARTITION BY conv_id, role) AS n, max(turn) OVER (PARTITION BY conv_id, role) AS last_turn, coalesce(lag(role) OVER (PARTITION BY conv_id ORDER BY turn) = 'assistant', FALSE) AS asked,
    coalesce(lead(role) OVER (PARTITION BY conv_id ORDER BY turn) = 'user', FALSE) AS answered
  FROM conversations
), c AS (
  SELECT conv_id, turn, CAST(CASE WHEN conv_id % 7 = 3 THEN last_turn ELSE turn END AS INTEGER) AS order_turn, CAST(CASE WHEN conv_id % 7 = 3 THEN n - 1 - k ELSE k END AS INTEGER) AS level, 'call-' || turn AS call_id, CASE WHEN answered AND conv_id % 5 <> 1 THEN 'linked' ELSE 'orphan' END AS status,
    CASE WHEN conv_id % 4 = 3 THEN 'unknown tool' WHEN conv_id % 3 = 0 THEN '$.size: not allowed' WHEN conv_id % 2 = 0 AND turn NOT IN (1, 3) THEN '$.turn: not one of the allowed values' END AS problem,
    '{"arguments":{"size":' || length(text) || ',"turn":' || turn || '},"call_id":"call-' || turn || '","conv_id":' || conv_id || ',"depends_on":[' || coalesce('"call-' || before || '"', '') || '],"name":"reply","turn":' || turn || '}' AS json
  FROM m WHERE role = 'assistant'
)
SELECT conv_id, turn, order_turn, level, 'call' AS kind, call_id, status, problem, json FROM c
UNION ALL
SELECT conv_id, turn, turn, -1, 'message', NULL, NULL, NULL, NULL FROM c
UNION ALL
SELECT conv_id, turn, turn, 0, 'message', NULL, NULL, NULL, NULL FROM m WHERE role <> 'assistant' AND NOT (role = 'user' AND asked)
UNION ALL
SELECT m.conv_id, m.turn, greatest(m.turn, c.order_turn), coalesce(c.level, 0), 'result', CASE WHEN m.conv_id % 5 = 1 THEN 'call-none' ELSE 'call-' || (m.turn - 1) END, CASE WHEN c.level IS NULL THEN 'orphan' ELSE 'linked' END, NULL,
  '{"call_id":"' || CASE WHEN m.conv_id % 5 = 1 THEN 'call-none' ELSE 'call-' || (m.turn - 1) END || '","content":"' || md5(m.text) || '","conv_id":' || m.conv_id || ',"role":"tool","turn":' || m.turn || '}'
FROM m LEFT JOIN c ON c.conv_id = m.conv_id AND c.turn = m.turn - 1 AND m.conv_id % 5 <> 1 WHERE m.role = 'user' AND m.asked
"""

OP9_SQL = """
WITH d AS (
  SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
), f AS (
  SELECT payload_digest, min(page_id) AS first FROM d WHERE payload_bytes >= 100 GROUP BY payload_digest
)
SELECT page_id, payload_bytes, d.payload_digest AS payload_digest,
  CASE WHEN first IS NOT NULL AND page_id IS DISTINCT FROM first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id IS DISTINCT FROM first THEN first END AS refers_to
FROM d LEFT JOIN f ON d.payload_digest = f.payload_digest
"""


OP11_SQL = r"""
WITH t AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS p
  FROM conversations WHERE conv_id IS NOT NULL
), bits AS (
  SELECT conv_id, count(*) AS turns, flatten(list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda ch: list_transform(range(8), lambda i: (ascii(ch) >> CAST(i AS INTEGER)) & 1))) AS bits
  FROM t GROUP BY conv_id
), c AS (
  SELECT conv_id, turns, conv_id - conv_id % 20 AS base,
    xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(bits, lambda b: CAST(b AS BIGINT))), lambda a, b: xor(a >> 1, CASE WHEN (a & 1) <> b THEN 3988292384 ELSE 0 END))) % 4 AS h
  FROM bits
), m AS (
  SELECT c.*, least(c.h, coalesce(b.turns, 0)) AS m FROM c LEFT JOIN c AS b ON b.conv_id = c.base
), r AS (
  SELECT m.conv_id, p, role, text FROM m JOIN t ON t.conv_id = m.base AND p < h
  UNION ALL SELECT m.conv_id, p - h + m, role, text FROM m JOIN t ON t.conv_id = m.conv_id AND p >= h
), k AS (
  SELECT conv_id, p + 1 AS depth, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS words, p + 1 = count(*) OVER (PARTITION BY conv_id) AS last,
    list({'r': role, 'x': text}) OVER (PARTITION BY conv_id ORDER BY p ROWS UNBOUNDED PRECEDING) AS k
  FROM r
  UNION ALL SELECT conv_id, 0, 0, conv_id NOT IN (SELECT conv_id FROM r), [] FROM c
), n AS (
  SELECT k, any_value(depth) AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * any_value(words) AS saved,
    sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (last), '')) AS ends_sha256
  FROM k GROUP BY k
), p AS (
  SELECT n.*, o.k AS up FROM n LEFT JOIN k AS o ON o.conv_id = n.conv_id AND o.depth = n.depth - 1
), ch AS (
  SELECT up, count(*) AS n_children FROM p WHERE depth > 0 GROUP BY up
), q AS (
  SELECT p.*, coalesce(n_children, 0) AS n_children, a.conv_id AS parent_conv_id FROM p LEFT JOIN ch ON ch.up = p.k LEFT JOIN n AS a ON a.k = p.up
), s AS (
  SELECT o.k, sum(CASE WHEN q.n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum(q.saved) AS saved_tokens FROM q JOIN k AS o ON o.conv_id = q.conv_id AND o.depth <= q.depth GROUP BY o.k
)
SELECT conv_id, CAST(depth AS BIGINT) AS depth, parent_conv_id, n_convs, n_children, CAST(n_leaves AS BIGINT) AS n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens, ends_sha256
FROM q JOIN s USING (k)
"""

OP12_SQL = r"""
WITH z AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, [5, 2, 1][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS weight FROM z GROUP BY source
), r AS (
  SELECT 3 * source_size / weight AS ratio,
    (sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER w, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER w, 0)) AS level
  FROM s WINDOW w AS (ORDER BY 3 * source_size / weight, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), t AS (
  SELECT source, source_size, least((SELECT min_by(level, ratio) FROM r WHERE level <= ratio) * weight, CAST(3 * source_size AS DOUBLE)) AS target FROM s
), q AS (
  SELECT z.*, source_size, target, md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS shuffled,
    sum(size) OVER (PARTITION BY z.source ORDER BY md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '')), doc_id NULLS FIRST, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto
  FROM z JOIN t ON z.source IS NOT DISTINCT FROM t.source
), c AS (
  SELECT q.*, epoch, upto + epoch * source_size AS served FROM q, (SELECT unnest([0, 1, 2]) AS epoch) WHERE size > 0 AND 2 * (upto + epoch * source_size) - size <= 2 * target
), m AS (
  SELECT *, sum(size) OVER (ORDER BY served / target, source NULLS LAST, upto, epoch ROWS UNBOUNDED PRECEDING) - size AS place FROM c
), g AS (
  SELECT doc_id, source, count(*) AS times, min(place) AS first_at FROM m GROUP BY doc_id, source
)
SELECT q.doc_id, q.source, size, source_size, target, CAST(coalesce(times, 0) * size AS BIGINT) AS taken, CAST(first_at AS BIGINT) AS first_at
FROM q LEFT JOIN g ON q.doc_id = g.doc_id AND q.source IS NOT DISTINCT FROM g.source
"""

OP13_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents
), e AS (
  SELECT doc_id, len(terms) AS n, terms FROM d WHERE len(terms) > 0
), a AS (
  SELECT count(*) AS n_docs, CAST(sum(n) AS BIGINT) AS all_terms FROM e
), p AS (
  SELECT doc_id, n, term, count(*) AS tf FROM (SELECT doc_id, n, unnest(terms) AS term FROM e) GROUP BY ALL
), i AS (
  SELECT item_id, term, count(*) AS c FROM (SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark) GROUP BY ALL
), f AS (
  SELECT term, CAST(floor(1000 * ln((2 * n_docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM p, a WHERE term IN (SELECT term FROM i) GROUP BY term, n_docs
), s AS (
  SELECT item_id, doc_id, CAST(sum(c * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * n_docs) // all_terms)))) AS BIGINT) AS score
  FROM i JOIN f USING (term) JOIN p USING (term), a GROUP BY item_id, doc_id
)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
FROM s WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) <= 10
"""


def oracle_sql() -> dict[str, str]:
    return {"op6_chat_formatting": OP6_SQL, "op9_warc": OP9_SQL, "op11_conversation_trie": OP11_SQL, "op12_mixing": OP12_SQL, "op13_lexical_search": OP13_SQL, "chat_tool_links": LINKS_SQL}
