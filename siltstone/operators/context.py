"""Cited context, prompts and sessions assembled from ranked results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.functions.text import token_estimate

NO_CONTEXT = "No relevant context found."


def _ordered(rows: Column, body: str, glue: str) -> Column:
    """Join ``body`` of collected (rank, ...) structs in rank order."""
    return F.array_join(F.transform(F.sort_array(rows), lambda r: r[body]), glue)


def two_decimals(score: Column) -> Column:
    """A number, 0 for null, with two decimals, rounded from its exact binary value as C does; ``format_string`` rounds its shortest decimal form."""
    return F.call_function("format_number", F.coalesce(score, F.lit(0.0)).cast("double"), F.lit("0.00"))


def text_entry(rank: Column, source: Column, score: Column, content: Column, relevance: bool = True) -> Column:
    head = F.format_string("[%d] **Source**: %s", rank, F.coalesce(source, F.lit("Unknown")))
    if relevance:
        head = F.concat(head, F.lit(" | **Relevance**: "), two_decimals(score))
    return F.concat(head, F.lit("\n"), F.coalesce(content, F.lit("")), F.lit("\n"))


def image_entry(rank: Column, name: Column, description: Column, width: Column, height: Column, form: Column, score: Column, relevance: bool = True) -> Column:
    name = F.coalesce(name, F.lit("unknown"))
    described = F.coalesce(description, F.concat(F.lit("Image from "), name))
    head = F.format_string("[IMG-%d] **File**: %s | **Description**: %s", rank, name, described)
    if relevance:
        head = F.concat(head, F.lit(" | **Relevance**: "), two_decimals(score))
    size = F.format_string("\n*Dimensions*: %dx%d | *Format*: %s\n", F.coalesce(width, F.lit(0)), F.coalesce(height, F.lit(0)), F.coalesce(form, F.lit("unknown")))
    return F.concat(head, size)


def context(hits: DataFrame, query_id: str = "query_id", entry: str = "entry", rank: str = "rank") -> DataFrame:
    """One context text per query: its entries in rank order, one per line group."""
    rows = F.collect_list(F.struct(F.col(rank).alias("rank"), F.col(entry).alias("entry")))
    return hits.groupBy(query_id).agg(_ordered(rows, "entry", "\n").alias("context"))


def multimodal(text: Column, image: Column) -> Column:
    """Both blocks under their headings, or the fixed sentence when there is none."""
    some = lambda c: F.coalesce(c, F.lit("")) != ""
    parts = F.array_compact(
        F.array(
            F.when(some(text), F.concat(F.lit("**Text Sources:**\n\n"), text)),
            F.when(some(image), F.concat(F.lit("**Image Sources:**\n\n"), image)),
        )
    )
    return F.when(F.size(parts) == 0, NO_CONTEXT).otherwise(F.array_join(parts, "\n---\n\n"))


def numbered_sources(hits: DataFrame, query_id: str = "query_id", text: str = "document", source: str = "source", rank: str = "rank") -> DataFrame:
    """``[n] source: first 200 characters...`` lines."""
    line = F.format_string("[%d] %s: %s...", F.col(rank), F.coalesce(F.col(source), F.lit("Unknown Source")), F.substring(F.col(text), 1, 200))
    rows = F.collect_list(F.struct(F.col(rank).alias("rank"), line.alias("line")))
    return hits.groupBy(query_id).agg(_ordered(rows, "line", "\n").alias("sources"))


def preview(text: Column, size: int = 500) -> Column:
    return F.when(F.length(text) > size, F.concat(F.substring(text, 1, size), F.lit("..."))).otherwise(text)


def citation_map(hits: DataFrame, query_id: str = "query_id") -> DataFrame:
    """Map from ``[n]`` to the source and score behind it."""
    entry = F.struct(F.format_string("[%d]", "rank").alias("key"), F.struct("source", "score").alias("value"))
    return hits.groupBy(query_id).agg(F.map_from_entries(F.collect_list(entry)).alias("citations"))


ROLES = ("system", "user", "assistant")


def chat_template(turns: DataFrame, conversation: str = "conv_id", turn: str = "turn") -> DataFrame:
    """Turns in order between role markers, ending with the assistant's; unknown roles are dropped."""
    line = F.concat(F.lit("<|im_start|>"), F.col("role"), F.lit("\n"), F.coalesce("text", F.lit("")), F.lit("<|im_end|>"))
    rows = F.collect_list(F.struct(F.col(turn).alias("turn"), line.alias("line")))
    made = turns.where(F.col("role").isin(*ROLES)).groupBy(conversation).agg(_ordered(rows, "line", "\n").alias("lines"))
    return made.select(conversation, F.concat("lines", F.lit("\n<|im_start|>assistant\n")).alias("prompt"))


def last_turns(turns: DataFrame, n: int, conversation: str = "conv_id", turn: str = "turn") -> DataFrame:
    """The last ``n`` exchanges (2 n messages) of each conversation."""
    back = F.row_number().over(Window.partitionBy(conversation).orderBy(F.desc(turn)))
    return turns.withColumn("back", back).where(F.col("back") <= 2 * n).drop("back")


def session_counts(turns: DataFrame, conversation: str = "conv_id") -> DataFrame:
    return turns.groupBy(conversation).agg(
        F.count(F.lit(1)).alias("message_count"), F.count_if(F.col("role") == "user").alias("user_messages"),
        F.sum(token_estimate(F.coalesce("text", F.lit("")))).alias("tokens"),
    )


def expired(last_access: Column, now: Column, ttl_seconds: int = 1800) -> Column:
    return F.unix_timestamp(now) - F.unix_timestamp(last_access) > ttl_seconds


def system_prompt(base: Column, instructions: Column, context_text: Column) -> Column:
    """Base prompt with optional instructions and context."""
    more = lambda title, c: F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(f"\n\n{title}:\n"), c)).otherwise("")
    return F.concat(base, more("Additional Instructions", instructions), more("Context", context_text))
