"""Model calls as joins: cached replies are joined in, and only misses reach a provider.

A provider is a function of a batch of prompts; it runs in ``mapInPandas``.  Without one,
misses stay with a typed ``unresolved`` status, so a run never needs a network.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from papyrion.functions.text import json_from_reply


def prompt_key(system: Column, user: Column, model: Column) -> Column:
    return F.md5(F.concat(system, user, model))


def with_replies(prompts: DataFrame, cache: DataFrame, provider: Callable[[list[str]], list[str]] | None = None) -> DataFrame:
    """prompts (system, user, model, ...) with prompt_key, reply and status (cached, called, unresolved).

    cache (prompt_key, reply).  Equal prompts are called once.
    """
    keyed = prompts.withColumn("prompt_key", prompt_key(F.col("system"), F.col("user"), F.col("model")))
    hits = keyed.join(cache.dropDuplicates(["prompt_key"]), "prompt_key", "left")
    status = F.when(F.col("reply").isNotNull(), "cached")
    if provider is None:
        return hits.withColumn("status", status.otherwise("unresolved"))

    def call(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({"prompt_key": frame["prompt_key"], "called": provider(frame["user"].tolist())})

    missing = hits.where("reply is null").select("prompt_key", "user").dropDuplicates(["prompt_key"])
    made = missing.mapInPandas(call, "prompt_key string, called string")
    joined = hits.join(made, "prompt_key", "left")
    return joined.withColumn("status", status.when(F.col("called").isNotNull(), "called").otherwise("unresolved")).withColumn("reply", F.coalesce("reply", "called")).drop("called")


def parsed_replies(replies: DataFrame, schema: str, reply: str = "reply") -> DataFrame:
    """Replies with their JSON object as a struct column ``value``; null where none fits."""
    return replies.withColumn("value", F.from_json(json_from_reply(F.col(reply)), schema))


def usage_cube(usage: DataFrame, dimensions: list[str], tokens: str) -> DataFrame:
    """Calls and tokens for every combination of the dimensions; totals have null dimensions."""
    return usage.cube(*dimensions).agg(F.count("*").alias("calls"), F.sum(tokens).alias("tokens"), F.grouping_id().alias("level"))
