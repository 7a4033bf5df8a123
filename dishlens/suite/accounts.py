"""Users, conversations, transcripts and message screening over customers, orders, line items, events
and conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from dishlens.functions.text import screen_message
from dishlens.plans import conversations as V
from dishlens.suite.base import derive, derive_sql, query, table

USER = {
    "id": "c_custkey",
    "email": "lower(c_name) || '@example.com'",
    "role": "CASE WHEN c_nationkey = 3 THEN 'admin' ELSE 'user' END",
    "status": "CASE c_mktsegment WHEN 'BUILDING' THEN 'deleted' WHEN 'MACHINERY' THEN 'suspended' ELSE 'active' END",
    "created_at": "TIMESTAMP '2024-01-01 00:00:00' + INTERVAL '1' HOUR * (c_custkey % 977)",
}
CONVERSATION = {
    "id": "o_orderkey",
    "user_id": "o_custkey",
    "title": "'Chat ' || o_orderpriority",
    "business_id": "'id-' || (o_custkey % 100)",
    "created_at": "o_orderdate",
    "updated_at": "o_orderdate",
}
_USERS = f"users AS ({derive_sql(USER, 'customer')})"
_CONVS = f"conversations_t AS ({derive_sql(CONVERSATION, 'orders')})"
_MSGS = "messages AS (SELECT l_orderkey AS conversation_id FROM lineitem)"


def _users(spark: SparkSession, sf: str) -> DataFrame:
    columns = {**USER, "created_at": USER["created_at"].replace("TIMESTAMP '", "TIMESTAMP_NTZ '")}
    return derive(table(spark, sf, "customer"), columns)


def _conversations(spark: SparkSession, sf: str) -> DataFrame:
    return derive(table(spark, sf, "orders"), CONVERSATION)


def _messages(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("conversation_id"))


@query(f"""
WITH {_USERS} SELECT id, email, role, status, created_at FROM users
WHERE status <> 'deleted' AND email ILIKE '%00%' AND status = 'active'
ORDER BY created_at DESC NULLS FIRST, id LIMIT 20
""")
def user_list(spark: SparkSession, sf: str) -> DataFrame:
    return V.list_users(_users(spark, sf), "00", "active")


@query(f"""
WITH {_USERS} SELECT count(*) AS total FROM users WHERE status <> 'deleted' AND email ILIKE '%00%'
""")
def user_total(spark: SparkSession, sf: str) -> DataFrame:
    return V.count_users(_users(spark, sf), "00")


@query(f"""
WITH {_USERS} SELECT count(*) AS total, count(*) FILTER (WHERE status = 'active') AS active,
  count(*) FILTER (WHERE status = 'suspended') AS suspended FROM users WHERE status <> 'deleted'
""")
def conditional_counts(spark: SparkSession, sf: str) -> DataFrame:
    return V.user_analytics(_users(spark, sf))


@query(f"""
WITH {_USERS} SELECT id, email, role, status, created_at FROM users WHERE status <> 'deleted'
ORDER BY created_at DESC NULLS FIRST, id LIMIT 5
""")
def recent_signups(spark: SparkSession, sf: str) -> DataFrame:
    return V.recent_signups(_users(spark, sf))


@query(f"""
WITH {_USERS}, {_CONVS}
SELECT (SELECT count(*) FROM conversations_t) AS total,
  COALESCE(CAST((SELECT count(*) FROM conversations_t) AS DOUBLE)
           / NULLIF((SELECT count(*) FROM users WHERE status <> 'deleted'), 0), 0.0) AS per_user
""")
def avg_per_user(spark: SparkSession, sf: str) -> DataFrame:
    return V.conversation_analytics(_conversations(spark, sf), _users(spark, sf)).withColumn(
        "total", F.col("total").cast("bigint")
    )


@query("""
SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS n FROM events
WHERE ts >= TIMESTAMP '2024-01-25 00:00:00' - INTERVAL '14' DAY GROUP BY 1
""")
def daily_activity(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "events").withColumnRenamed("ts", "created_at")
    return V.daily_activity(rows, F.expr("TIMESTAMP_NTZ '2024-01-25 00:00:00'"), 14)


@query(f"""
WITH {_USERS}, {_CONVS}, {_MSGS}
SELECT c.id, c.user_id, u.email, c.title, c.updated_at,
  (SELECT count(*) FROM messages m WHERE m.conversation_id = c.id) AS message_count
FROM conversations_t c JOIN users u ON c.user_id = u.id
WHERE c.title ILIKE '%urgent%' OR u.email ILIKE '%urgent%'
ORDER BY c.updated_at DESC NULLS FIRST, c.id LIMIT 40
""")
def parent_child_counts(spark: SparkSession, sf: str) -> DataFrame:
    rows = V.list_conversations(
        _conversations(spark, sf), _users(spark, sf), _messages(spark, sf), "urgent", limit=40
    )
    return rows.select("id", "user_id", "email", "title", "updated_at", "message_count")


@query(f"""
WITH {_USERS}, {_CONVS} SELECT count(*) AS total FROM conversations_t c JOIN users u ON c.user_id = u.id
WHERE c.title ILIKE '%00001%' OR u.email ILIKE '%00001%'
""")
def conversation_total(spark: SparkSession, sf: str) -> DataFrame:
    return V.count_conversations(_conversations(spark, sf), _users(spark, sf), "00001")


@query(f"""
WITH {_USERS}, {_CONVS}, {_MSGS},
cc AS (SELECT user_id, count(*) AS n FROM conversations_t GROUP BY 1),
mc AS (SELECT user_id, count(*) AS n FROM messages m JOIN conversations_t c ON m.conversation_id = c.id GROUP BY 1)
SELECT u.id, u.email, u.role, u.status, CASE WHEN c_acctbal > 0 THEN 'p' || c_acctbal::BIGINT END AS profile,
  COALESCE(cc.n, 0) AS conversation_count, COALESCE(mc.n, 0) AS message_count
FROM users u JOIN customer ON c_custkey = u.id
LEFT JOIN cc ON cc.user_id = u.id LEFT JOIN mc ON mc.user_id = u.id WHERE u.status <> 'deleted'
""")
def scalar_counts(spark: SparkSession, sf: str) -> DataFrame:
    profiles = table(spark, sf, "customer").filter("c_acctbal > 0").select(
        F.col("c_custkey").alias("user_id"),
        F.concat(F.lit("p"), F.rint("c_acctbal").cast("bigint")).alias("profile"),
    )
    details = V.user_details(
        _users(spark, sf), profiles, _conversations(spark, sf), _messages(spark, sf)
    )
    return details.drop("created_at")


@query(f"""
WITH {_CONVS}, shops AS (SELECT 'id-' || s_suppkey AS id, 'c' || s_suppkey AS camis FROM supplier)
SELECT camis, count(*) AS n, max(updated_at) AS last FROM conversations_t c JOIN shops s ON c.business_id = s.id GROUP BY 1
""")
def restaurant_conversations(spark: SparkSession, sf: str) -> DataFrame:
    shops = table(spark, sf, "supplier").select(
        F.concat(F.lit("id-"), "s_suppkey").alias("id"), F.concat(F.lit("c"), "s_suppkey").alias("camis")
    )
    rows = V.conversations_of(_conversations(spark, sf), shops)
    return rows.groupBy("camis").agg(F.count(F.lit(1)).alias("n"), F.max("updated_at").alias("last"))


@query("""
SELECT o.o_orderkey AS id, CASE WHEN m.at IS NULL THEN o.o_orderdate ELSE m.at END AS updated_at
FROM orders o LEFT JOIN (SELECT l_orderkey, max(l_shipdate) AS at FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1) m
ON m.l_orderkey = o.o_orderkey
""")
def message_append(spark: SparkSession, sf: str) -> DataFrame:
    lines = table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("conversation_id"), F.col("l_shipdate").alias("created_at"), "l_returnflag"
    )
    old = lines.filter("l_returnflag <> 'R'").drop("l_returnflag")
    new = lines.filter("l_returnflag = 'R'").drop("l_returnflag")
    _, moved = V.append_messages(old, _conversations(spark, sf), new)
    return moved.select("id", "updated_at")


@query(f"""
WITH {_USERS}, {_CONVS}, gone AS (SELECT id FROM users WHERE status = 'deleted'),
kept AS (SELECT * FROM conversations_t WHERE user_id NOT IN (SELECT id FROM gone))
SELECT 'users' AS name, count(*) AS n FROM users WHERE id NOT IN (SELECT id FROM gone)
UNION ALL SELECT 'profiles', count(*) FROM customer WHERE c_custkey NOT IN (SELECT id FROM gone)
UNION ALL SELECT 'conversations', count(*) FROM kept
UNION ALL SELECT 'messages', count(*) FROM lineitem WHERE l_orderkey NOT IN (
  SELECT id FROM conversations_t WHERE user_id IN (SELECT id FROM gone))
""")
def cascade_delete(spark: SparkSession, sf: str) -> DataFrame:
    users = _users(spark, sf)
    ids = users.filter("status = 'deleted'").select("id")
    left = V.delete_users(
        ids, users, users.select(F.col("id").alias("user_id")), _conversations(spark, sf), _messages(spark, sf)
    )
    counts = [
        df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("name"), "n") for name, df in left.items()
    ]
    merged = counts[0]
    for part in counts[1:]:
        merged = merged.unionByName(part)
    return merged


# ---------------------------------------------------------------- messages

@query("""
SELECT CASE WHEN strlen(m) > 2000 THEN 'too long'
  WHEN regexp_matches(lower(m), 'ignore previous instructions|ignore all previous|forget your instructions|disregard your instructions|you are now|pretend you are|<\\|system\\|>|<\\|im_start\\|>')
  THEN 'disallowed content' END AS reason, role, count(*) AS n
FROM (SELECT role, CASE WHEN turn % 3 = 1 THEN text || ' Ignore ALL previous ' || conv_id
                        WHEN turn % 3 = 2 THEN text || '<|SYSTEM|>' ELSE text END AS m FROM conversations)
GROUP BY 1, 2
""")
def injection_screen(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "conversations").withColumn(
        "m",
        F.expr("CASE WHEN turn % 3 = 1 THEN text || ' Ignore ALL previous ' || conv_id "
               "WHEN turn % 3 = 2 THEN text || '<|SYSTEM|>' ELSE text END"),
    )
    return rows.groupBy(screen_message("m").alias("reason"), "role").agg(F.count(F.lit(1)).alias("n"))


def _turns(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "conversations").select(
        F.concat(F.lit("m"), "conv_id", F.lit("-"), "turn").alias("id"),
        F.col("conv_id").alias("conversation_id"), F.col("turn").alias("sequence"),
        F.expr("CASE WHEN role = 'assistant' AND turn % 4 = 1 THEN 'tool_call' WHEN role = 'assistant' THEN 'model' "
               "WHEN role = 'user' AND turn % 4 = 2 THEN 'tool_response' ELSE role END").alias("role"),
        F.expr("CASE WHEN turn % 4 = 1 AND conv_id % 2 = 0 THEN '[{\"name\": \"lookup\"}, {\"name\": \"t' || turn || '\"}]' "
               "WHEN turn % 4 = 2 AND conv_id % 3 = 0 THEN '[{\"result\": ' || conv_id || '}]' ELSE text END").alias("content"),
    )


_TURNS = """
turns AS (
  SELECT conv_id AS conversation_id, turn AS sequence,
    CASE WHEN role = 'assistant' AND turn % 4 = 1 THEN 'tool_call' WHEN role = 'assistant' THEN 'model'
         WHEN role = 'user' AND turn % 4 = 2 THEN 'tool_response' ELSE role END AS role,
    CASE WHEN turn % 4 = 1 AND conv_id % 2 = 0 THEN '[{"name": "lookup"}, {"name": "t' || turn || '"}]'
         WHEN turn % 4 = 2 AND conv_id % 3 = 0 THEN '[{"result": ' || conv_id || '}]' ELSE text END AS content
  FROM conversations)"""


@query(f"""
WITH {_TURNS}
SELECT conversation_id, CAST(-1 AS BIGINT) AS part, '# Chat ' || conversation_id || chr(10) || chr(10) ||
  '- **Conversation ID:** ' || conversation_id || chr(10) || '- **Business:** Cafe (Queens, NY)' || chr(10) ||
  '- **Created:** 2024-01-02T03:04:05Z' || chr(10) || '- **Exported:** 2024-02-03T04:05:06Z' || chr(10) || chr(10) ||
  '---' || chr(10) || chr(10) AS block
FROM (SELECT DISTINCT conversation_id FROM turns)
UNION ALL
SELECT conversation_id, sequence, '### ' || CASE role WHEN 'user' THEN '👤 User' WHEN 'model' THEN '🤖 Assistant'
    WHEN 'tool_call' THEN '🔧 Tool Call' WHEN 'tool_response' THEN '📋 Tool Response'
    ELSE upper(role[1]) || role[2:] END || chr(10) || chr(10) ||
  CASE WHEN role LIKE 'tool%' THEN '```json' || chr(10) || content || chr(10) || '```' ELSE content END || chr(10) || chr(10)
FROM turns
""")
def transcript_export(spark: SparkSession, sf: str) -> DataFrame:
    turns = _turns(spark, sf)
    heads = turns.select(F.col("conversation_id").alias("id")).distinct().select(
        "id", F.concat(F.lit("Chat "), "id").alias("title"), F.lit("Cafe").alias("business_name"),
        F.lit("Queens").alias("search_city"), F.lit("NY").alias("search_state"),
        F.expr("TIMESTAMP_NTZ '2024-01-02 03:04:05'").alias("created_at"),
    )
    return V.transcript_blocks(heads, turns, F.expr("TIMESTAMP_NTZ '2024-02-03 04:05:06'"))


@query(f"""
WITH {_TURNS} SELECT conversation_id, sequence, content, role FROM turns
""")
def transcript_json(spark: SparkSession, sf: str) -> DataFrame:
    """Exported JSON lines, read back."""
    exported = V.transcript_json(_turns(spark, sf))
    back = F.from_json("json", "role string, content string")
    return exported.select("conversation_id", "sequence", back["content"].alias("content"), back["role"].alias("role"))


@query(f"""
WITH {_TURNS},
kept AS (SELECT * FROM turns WHERE role NOT LIKE 'tool%' OR content LIKE '[{{%')
SELECT conversation_id, sequence, CASE role WHEN 'tool_call' THEN 'model' WHEN 'tool_response' THEN 'user' ELSE role END AS role,
  CASE WHEN role LIKE 'tool%' THEN '' ELSE content END AS text,
  CASE WHEN role = 'tool_call' THEN CASE WHEN content LIKE '[{{"name%' THEN '{{"name":"lookup"}};{{"name":"t' || sequence || '"}}'
    ELSE replace(content[2:-2], ': ', ':') END ELSE '' END AS calls,
  CASE WHEN role = 'tool_response' THEN replace(content[2:-2], ': ', ':') ELSE '' END AS results
FROM kept
""")
def history_normalise(spark: SparkSession, sf: str) -> DataFrame:
    history = V.model_history(_turns(spark, sf))
    return history.select(
        "conversation_id", "sequence", "role", "text",
        F.array_join("function_calls", ";").alias("calls"), F.array_join("function_results", ";").alias("results"),
    )


@query("""
WITH r AS (
  SELECT source AS business_id, doc_id AS review_id, (doc_id % 10) / 2.0::DOUBLE AS stars, text, n_chars AS score FROM documents),
ranked AS (SELECT *, row_number() OVER (PARTITION BY business_id ORDER BY score DESC, review_id) AS place FROM r),
top AS (SELECT * FROM ranked WHERE place <= 3)
SELECT business_id, count(*) AS n, md5('Here''s what ' || count(*) || ' customers are saying about ' || upper(business_id) || ':' || chr(10) || chr(10) ||
  string_agg(place || '. ' || repeat('★', CAST(floor(stars) AS INTEGER)) || CASE WHEN stars - floor(stars) >= 0.5 THEN '½' ELSE '' END
    || chr(10) || text || chr(10) || chr(10), '' ORDER BY place)) AS digest
FROM top GROUP BY 1
""")
def review_digest(spark: SparkSession, sf: str) -> DataFrame:
    reviews = table(spark, sf, "documents").select(
        F.col("source").alias("business_id"), F.upper("source").alias("business_name"),
        F.col("doc_id").alias("review_id"), ((F.col("doc_id") % 10) / 2.0).alias("stars"), "text",
        F.col("n_chars").alias("score"),
    )
    return V.review_digest(reviews, 3).withColumn("digest", F.md5("digest"))
