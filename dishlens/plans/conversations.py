"""Users, conversations and messages: listings, analytics, transcripts, history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from dishlens.functions.arrays import star_text
from dishlens.operators.dedup import top_per_key
from dishlens.operators.filters import contains_text, equals
from dishlens.operators.joins import join_unique
from dishlens.operators.merge import delete_keys, update_matched
from dishlens.operators.paging import paginate

_HEADINGS = {
    "user": "👤 User", "model": "🤖 Assistant", "tool_call": "🔧 Tool Call",
    "tool_response": "📋 Tool Response",
}


# ---------------------------------------------------------------- users

def present(users: DataFrame) -> DataFrame:
    return users.filter(F.col("status") != "deleted")


def list_users(users: DataFrame, email: str = "", status: str = "", offset: int = 0,
               limit: int = 20) -> DataFrame:
    rows = present(users).filter(contains_text(email, "email") & equals(status, "status"))
    return paginate(rows, [F.desc_nulls_first("created_at"), F.asc("id")], offset, limit)


def count_users(users: DataFrame, email: str = "", status: str = "") -> DataFrame:
    rows = present(users).filter(contains_text(email, "email") & equals(status, "status"))
    return rows.agg(F.count(F.lit(1)).alias("total"))


def user_analytics(users: DataFrame) -> DataFrame:
    return present(users).agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("status") == "active").alias("active"),
        F.count_if(F.col("status") == "suspended").alias("suspended"),
    )


def recent_signups(users: DataFrame, n: int = 5) -> DataFrame:
    return present(users).orderBy(F.desc_nulls_first("created_at"), F.asc("id")).limit(n)


def user_details(
    users: DataFrame, profiles: DataFrame, conversations: DataFrame, messages: DataFrame
) -> DataFrame:
    """Users with profile and their numbers of conversations and messages (0 when none).

    Messages are counted per conversation before the join, so a busy conversation is one row there.
    """
    per_conversation = messages.groupBy("conversation_id").agg(F.count(F.lit(1)).alias("n"))
    counted = conversations.select("user_id", F.col("id").alias("conversation_id")).join(
        per_conversation, "conversation_id", "left"
    )
    per_user = counted.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("conversation_count"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("message_count"),
    ).withColumnRenamed("user_id", "id")
    return (
        present(users)
        .join(profiles.select(F.col("user_id").alias("id"), "profile"), "id", "left")
        .join(per_user, "id", "left")
        .fillna(0, subset=["conversation_count", "message_count"])
    )


# ---------------------------------------------------------------- conversations

def _searched(conversations: DataFrame, users: DataFrame, search: str) -> DataFrame:
    owners = users.select(F.col("id").alias("user_id"), "email")
    owned = join_unique(conversations, owners, ["user_id"], "inner", ["id"])
    return owned.filter(contains_text(search, "title", "email"))


def list_conversations(
    conversations: DataFrame, users: DataFrame, messages: DataFrame, search: str = "",
    offset: int = 0, limit: int = 20,
) -> DataFrame:
    counts = messages.groupBy(F.col("conversation_id").alias("id")).agg(
        F.count(F.lit(1)).alias("message_count")
    )
    rows = _searched(conversations, users, search).join(counts, "id", "left").fillna(
        0, subset=["message_count"]
    )
    return paginate(rows, [F.desc_nulls_first("updated_at"), F.asc("id")], offset, limit)


def count_conversations(conversations: DataFrame, users: DataFrame, search: str = "") -> DataFrame:
    return _searched(conversations, users, search).agg(F.count(F.lit(1)).alias("total"))


def conversation_analytics(conversations: DataFrame, users: DataFrame) -> DataFrame:
    """Total and mean per present user, 0.0 when there are no users: one pass over each table."""
    facts = conversations.select(F.lit(1).alias("c"), F.lit(0).alias("u")).unionByName(
        present(users).select(F.lit(0).alias("c"), F.lit(1).alias("u"))
    )
    return facts.agg(
        F.coalesce(F.sum("c"), F.lit(0)).alias("total"),
        F.coalesce(F.try_divide(F.sum("c").cast("double"), F.sum("u")), F.lit(0.0)).alias("per_user"),
    )


def daily_activity(conversations: DataFrame, as_of: Column, days: int) -> DataFrame:
    since = as_of - F.expr(f"INTERVAL '{days}' DAY")
    return (
        conversations.filter(F.col("created_at") >= since)
        .groupBy(F.date_format("created_at", "yyyy-MM-dd").alias("day"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


def conversations_of(conversations: DataFrame, restaurants: DataFrame) -> DataFrame:
    keys = restaurants.select(F.col("id").alias("business_id"), "camis")
    return join_unique(conversations, keys, ["business_id"], "inner", ["id"])


def append_messages(
    messages: DataFrame, conversations: DataFrame, batch: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """(messages, conversations): new messages added, their conversations' change time moved on."""
    touched = batch.groupBy(F.col("conversation_id").alias("id")).agg(F.max("created_at").alias("at"))
    moved = update_matched(conversations, touched, ["id"], {"updated_at": F.col("new.at")})
    return messages.unionByName(batch), moved


def delete_users(
    ids: DataFrame, users: DataFrame, profiles: DataFrame, conversations: DataFrame, messages: DataFrame
) -> dict[str, DataFrame]:
    """Remove users and everything that belongs to them."""
    owned = ids.select(F.col("id").alias("user_id"))
    gone = conversations.join(owned, "user_id", "left_semi").select(F.col("id").alias("conversation_id"))
    return {
        "users": delete_keys(users, ids, ["id"]),
        "profiles": delete_keys(profiles, owned, ["user_id"]),
        "conversations": delete_keys(conversations, owned, ["user_id"]),
        "messages": delete_keys(messages, gone, ["conversation_id"]),
    }


# ---------------------------------------------------------------- transcripts

def message_block(role: Column, content: Column) -> Column:
    """Markdown block of one message."""
    heading = F.concat(F.upper(F.substring(role, 1, 1)), F.substr(role, F.lit(2)))
    for name, text in _HEADINGS.items():
        heading = F.when(role == name, F.lit(text)).otherwise(heading)
    is_tool = role.isin("tool_call", "tool_response")
    body = F.when(is_tool, F.concat(F.lit("```json\n"), content, F.lit("\n```"))).otherwise(content)
    return F.concat(F.lit("### "), heading, F.lit("\n\n"), body, F.lit("\n\n"))


def transcript_blocks(
    conversations: DataFrame, messages: DataFrame, exported_at: Column
) -> DataFrame:
    """(conversation_id, part, block): a transcript as blocks whose concatenation in `part` order is
    the Markdown file. Part -1 is the title block.

    Blocks stay rows, so a conversation of any length spreads over tasks. `write_transcripts` stores
    them in reading order.
    """
    def stamp(value: Column) -> Column:
        return F.date_format(value, "yyyy-MM-dd'T'HH:mm:ss'Z'")

    def text(name: str) -> Column:
        return F.coalesce(F.col(name).cast("string"), F.lit(""))

    head = F.concat(
        F.lit("# "), text("title"), F.lit("\n\n- **Conversation ID:** "), text("id"),
        F.lit("\n- **Business:** "), text("business_name"), F.lit(" ("), text("search_city"),
        F.lit(", "), text("search_state"), F.lit(")\n- **Created:** "), stamp(F.col("created_at")),
        F.lit("\n- **Exported:** "), stamp(exported_at), F.lit("\n\n---\n\n"),
    )
    titles = conversations.select(
        F.col("id").alias("conversation_id"), F.lit(-1).cast("long").alias("part"), head.alias("block")
    )
    blocks = messages.select(
        "conversation_id", F.col("sequence").cast("long").alias("part"),
        message_block(F.col("role"), F.col("content")).alias("block"),
    )
    return titles.unionByName(blocks)


def write_transcripts(blocks: DataFrame, path: str) -> None:
    """Blocks in reading order: range-partitioned, so one long conversation may span files."""
    ordered = blocks.repartitionByRange("conversation_id", "part").sortWithinPartitions(
        "conversation_id", "part"
    )
    ordered.write.mode("overwrite").parquet(path)


def transcript_json(messages: DataFrame) -> DataFrame:
    """Messages as JSON lines in export form."""
    return messages.select(
        "conversation_id", "sequence",
        F.to_json(F.struct("id", "conversation_id", "role", "content", "sequence")).alias("json"),
    )


def model_history(messages: DataFrame) -> DataFrame:
    """Messages as a model reads them: tool calls speak for the model, tool results for the user;
    tool messages that are no JSON array are dropped. Tool payloads arrive as arrays of JSON texts."""
    role = F.col("role")
    is_tool = role.isin("tool_call", "tool_response")
    value = F.try_parse_json("content")
    entries = F.transform(
        F.try_variant_get(value, "$", "array<variant>"), lambda e: F.to_json(e)
    )
    null_json = F.schema_of_variant(value) == "VOID"
    parsed = F.coalesce(entries, F.when(null_json, F.array().cast("array<string>")))
    none = F.array().cast("array<string>")
    return messages.filter(~is_tool | parsed.isNotNull()).select(
        "conversation_id", "sequence",
        F.when(role == "tool_call", F.lit("model")).when(role == "tool_response", F.lit("user"))
        .otherwise(role).alias("role"),
        F.when(is_tool, F.lit("")).otherwise(F.col("content")).alias("text"),
        F.when(role == "tool_call", parsed).otherwise(none).alias("function_calls"),
        F.when(role == "tool_response", parsed).otherwise(none).alias("function_results"),
    )


def review_digest(reviews: DataFrame, per_business: int) -> DataFrame:
    """Digest text of each business's best reviews (business_id, business_name, review_id, stars,
    text, score): at most `per_business` of them, so the collected list is bounded."""
    order = [F.desc("score"), F.asc("review_id")]
    top = top_per_key(reviews, ["business_id"], order, per_business, rank_col="place")
    line = F.concat(
        F.col("place").cast("string"), F.lit(". "), star_text("stars"), F.lit("\n"),
        F.col("text"), F.lit("\n\n"),
    )
    grouped = top.groupBy("business_id").agg(
        F.max("business_name").alias("name"), F.count(F.lit(1)).alias("n"),
        F.array_sort(F.collect_list(F.struct("place", line.alias("line")))).alias("lines"),
    )
    head = F.concat(
        F.lit("Here's what "), F.col("n").cast("string"), F.lit(" customers are saying about "),
        F.col("name"), F.lit(":\n\n"),
    )
    return grouped.select(
        "business_id", "n",
        F.concat(head, F.array_join(F.transform("lines", lambda x: x["line"]), "")).alias("digest"),
    )
