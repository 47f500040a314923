"""Conversation summaries, details, citations and persistence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def list_conversations(conversations: DataFrame, messages: DataFrame, user: Column) -> DataFrame:
    """A user's conversations, newest first, with message count and last question."""
    last = F.max_by("question", F.struct("created_at", "message_id")).alias("last_question")
    counts = messages.groupBy("conversation_id").agg(F.count("*").alias("message_count"), last)
    return conversations.where(F.col("user_id") == user).join(counts, "conversation_id", "left").fillna(0, ["message_count"]).orderBy(F.desc("created_at"), F.desc("conversation_id"))


def conversation_details(conversations: DataFrame, messages: DataFrame, asked: DataFrame) -> DataFrame:
    """Messages of each asked conversation (conversation_id, user_id) that is the user's."""
    own = conversations.join(asked.select("conversation_id", "user_id").distinct(), ["conversation_id", "user_id"], "left_semi")
    return messages.join(own.select("conversation_id"), "conversation_id", "left_semi")


def conversation_detail(conversations: DataFrame, messages: DataFrame, conversation_id: int, user: int) -> DataFrame:
    """The conversation's messages in order, if it is the user's; no row otherwise."""
    own = conversations.where((F.col("conversation_id") == conversation_id) & (F.col("user_id") == user)).select("conversation_id")
    return messages.join(own, "conversation_id", "left_semi").orderBy("created_at", "message_id")


def hydrate_sources(messages: DataFrame, sources: DataFrame) -> DataFrame:
    """conversation_id, message_id, sources: cited sources in cited order; unknown ids drop out, no citations leave an empty list."""
    cited = messages.select("conversation_id", "message_id", F.posexplode("cited_source_ids").alias("at", "source_id"))
    found = cited.join(sources.select("source_id", "url", "title"), "source_id")
    lists = found.groupBy("conversation_id", "message_id").agg(F.array_sort(F.collect_list(F.struct("at", "source_id", "url", "title"))).alias("s"))
    out = messages.select("conversation_id", "message_id").join(lists, ["conversation_id", "message_id"], "left")
    plain = F.transform("s", lambda x: F.struct(x["source_id"].alias("source_id"), x["url"].alias("url"), x["title"].alias("title")))
    return out.select("conversation_id", "message_id", F.coalesce(plain, F.array().cast("array<struct<source_id:bigint,url:string,title:string>>")).alias("sources"))


def persist_responses(conversations: DataFrame, responses: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(messages to append, rejected). Anonymous rows drop out; a given conversation must be the user's; none opens a new
    one, whose id is a hash of user and request."""
    known = responses.where("user_id is not null")
    own = conversations.select("conversation_id", "user_id")
    continued = known.where("conversation_id is not null")
    kept = continued.join(own, ["conversation_id", "user_id"], "left_semi")
    rejected = continued.join(own, ["conversation_id", "user_id"], "left_anti")
    opened = known.where("conversation_id is null").withColumn("conversation_id", F.xxhash64("user_id", "request_id"))
    columns = ["conversation_id", "user_id", "request_id", "question", "answer", "refused", "cited_source_ids"]
    return kept.select(*columns).unionByName(opened.select(*columns)), rejected.select("request_id", "conversation_id", "user_id")
