"""Model calls as tables: prompts of our own wording, reply schemas, and what replies become.

A call is a row: its prompt's key joins it with stored replies (``provider.with_replies``), and a
provider, if there is one, sees only the misses.
"""

from __future__ import annotations

import random
import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from papyrion.functions.text import json_from_reply
from papyrion.operators.bank import clean_terms
from papyrion.operators.classify import is_leaky, is_too_long
from papyrion.operators.dependencies import accepted_edges, cut_proof

#: Reply schemas by kind of call.
SCHEMAS = {
    "terms": "terms array<string>",
    "definition": "term string, definition string, aliases array<string>",
    "dependency": "has_dependency boolean, dependency_type string, justification string",
    "edges": "edges array<struct<source_id: string, target_id: string, dependency_type: string, justification: string>>",
    "proposals": "pairs array<struct<source_id: string, target_id: string>>",
    "tag": "semantic_tag string",
    "lemma": "is_trivial boolean, confidence double, category string, reason string, summary string",
    "query": "query_text string",
    "structured": "terms array<string>, expressions array<string>, domain array<string>",
}
#: Instructions by kind of call, and how the fields of a row make the message.
PROMPTS = {
    "terms": ("List the terms that a reader must know to read the statement. Answer with JSON: {\"terms\": [...]}.", "Statement:\n%s"),
    "definition": ("Give the definition of the term as the passage states it. Answer with JSON: term, definition, aliases.", "Term: %s\nPassage:\n%s"),
    "dependency": ("Does the first statement need the second one? Answer with JSON: has_dependency, dependency_type, justification.", "First:\n%s\nSecond:\n%s"),
    "edges": ("Name all dependencies among the statements. Answer with JSON: {\"edges\": [...]}.", "Statements:\n%s"),
    "proposals": ("Name the pairs of statements that may depend on each other. Answer with JSON: {\"pairs\": [...]}.", "Statements:\n%s"),
    "tag": ("Name the subject of the statement in a few words. Answer with JSON: {\"semantic_tag\": ...}.", "Statement:\n%s"),
    "lemma": ("Judge whether the lemma is trivial. Answer with JSON: is_trivial, confidence, category, reason, summary.", "Lemma:\n%s"),
    "query": ("Write one question of at most 30 words that a reader would ask to find the result. Answer with JSON: {\"query_text\": ...}.", "Style: %s\nContext:\n%s"),
    "structured": ("List the terms, expressions and domain of the query. Answer with JSON: terms, expressions, domain.", "Query:\n%s"),
}
# The models and their providers.
PROVIDERS = {
    "gpt-4o-2024-08-06": "openai",
    "gpt-4.1-mini-2025-04-14": "openai",
    "gpt-4.1-2025-04-14": "openai",
    "gpt-5-mini-2025-08-07": "openai",
    "gpt-5-nano-2025-08-07": "openai",
    "gpt-5-2025-08-07": "openai",
    "deepseek-ai/DeepSeek-R1-Distill-Qwen-14B": "together",
    "deepseek-ai/DeepSeek-R1-Distill-Llama-70B": "together",
    "deepseek-ai/DeepSeek-V3.1": "together",
    "openai/gpt-oss-120b": "together",
}
#: Longest text that is tagged, and most items of a structured list.
TAG_CHARS, MOST_ITEMS = 2000, 30


def provider_of(model: Column, models: dict[str, str] | None = None, strict: bool = True) -> Column:
    """The provider of a listed model, by its whole name; another name is an error, or null if not ``strict``."""
    listed = F.create_map(*[F.lit(x) for pair in (models or PROVIDERS).items() for x in pair])
    found = F.try_element_at(listed, model)
    return F.coalesce(found, F.raise_error(F.concat(F.lit("unknown model "), F.coalesce(model, F.lit("null"))))) if strict else found


def prompt(kind: str, *fields: Column) -> tuple[Column, Column]:
    """(system, user) of a call."""
    system, user = PROMPTS[kind]
    return F.lit(system), F.format_string(user, *[F.coalesce(f.cast("string"), F.lit("")) for f in fields])


def with_prompt(rows: DataFrame, kind: str, model: str, *fields: Column) -> DataFrame:
    """``rows`` with system, user and model, ready for ``provider.with_replies``."""
    system, user = prompt(kind, *fields)
    return rows.withColumns({"system": system, "user": user, "model": F.lit(model)})


def paper_message(nodes: DataFrame, budget: int | None = None) -> DataFrame:
    """(paper, message): a paper's statements in order with their proofs cut to the budget; nodes (paper, id, line, content, proof)."""
    text = F.concat(F.lit("["), "id", F.lit("]\n"), F.coalesce("content", F.lit("")), F.lit("\n"), cut_proof(F.col("proof"), F.lit(budget).cast("int")))
    return nodes.groupBy("paper").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "id", text.alias("t")))), lambda x: x["t"]), "\n\n").alias("message"))


def values(replies: DataFrame, kind: str, reply: str = "reply") -> DataFrame:
    """``replies`` with ``value``, the reply's object by the schema of its kind; null where there is none."""
    return replies.withColumn("value", F.from_json(json_from_reply(F.col(reply)), SCHEMAS[kind]))


def extracted_terms(replies: DataFrame, keep: list[str]) -> DataFrame:
    """(*keep, term): clean terms of replies; a failed reply has none."""
    return values(replies, "terms").select(*keep, F.explode(clean_terms(F.col("value.terms"))).alias("term"))


def pair_edges(replies: DataFrame) -> DataFrame:
    """(paper, source, target, dependency_type, justification) of the pairs that were confirmed; replies (paper, source, target, reply)."""
    return values(replies, "dependency").where("value.has_dependency").select("paper", "source", "target", F.coalesce("value.dependency_type", F.lit("generic")).alias("dependency_type"), "value.justification")


def global_edges(replies: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(paper, source, target): the edges of whole-paper replies between known nodes that are new; replies (paper, reply)."""
    each = values(replies, "edges").select("paper", F.inline("value.edges")).withColumnsRenamed({"source_id": "source", "target_id": "target"})
    return accepted_edges(each, nodes, edges)


def proposed_pairs(replies: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(paper, source, target): proposed pairs between known nodes that are new; they are confirmed one by one then."""
    each = values(replies, "proposals").select("paper", F.inline("value.pairs")).withColumnsRenamed({"source_id": "source", "target_id": "target"})
    return accepted_edges(each, nodes, edges)


def tag_text(text: Column) -> Column:
    """What is sent for a tag; null (no call, an empty tag) for a blank text."""
    return F.when(F.trim(F.coalesce(text, F.lit(""))) != "", F.substring(text, 1, TAG_CHARS))


def tags(replies: DataFrame, keep: list[str]) -> DataFrame:
    return values(replies, "tag").select(*keep, F.trim(F.coalesce("value.semantic_tag", F.lit(""))).alias("semantic_tag"))


def structured_lists(replies: DataFrame, keep: list[str]) -> DataFrame:
    """(*keep, terms, expressions, domain): trimmed distinct items in their order, at most 30 of each."""
    def cleaned(name: str) -> Column:
        items = F.filter(F.transform(F.coalesce(F.col(f"value.{name}"), F.array().cast("array<string>")), lambda x: F.trim(F.regexp_replace(x, r"\s+", " "))), lambda x: x.isNotNull() & (x != ""))
        return F.slice(F.array_distinct(items), 1, MOST_ITEMS).alias(name)

    return values(replies, "structured").select(*keep, *[cleaned(n) for n in ("terms", "expressions", "domain")])


def accepted_queries(replies: DataFrame, target: str, keep: list[str]) -> DataFrame:
    """(*keep, query_text, query_id, verdict): ok, leaky or too_long; a reply without a text is leaky."""
    rows = values(replies, "query").select(*keep, F.trim(F.coalesce("value.query_text", F.lit(""))).alias("query_text"))
    verdict = F.when(is_leaky(F.col("query_text"), F.lit(target)), "leaky").when(is_too_long(F.col("query_text")), "too_long").otherwise("ok")
    return rows.withColumns({"query_id": F.sha2("query_text", 256), "verdict": verdict})


def judged_lemmas(replies: DataFrame, keep: list[str]) -> DataFrame:
    """(*keep, is_trivial, confidence, category, reason, summary): null where the reply fails."""
    return values(replies, "lemma").select(*keep, "value.*")


def repaired(replies: DataFrame, kind: str, repairs: DataFrame) -> DataFrame:
    """Replies whose object fails get the second model's; replies (prompt_key, reply), repairs (prompt_key, repaired)."""
    rows = values(replies, kind).join(repairs.dropDuplicates(["prompt_key"]), "prompt_key", "left")
    second = F.from_json(json_from_reply(F.col("repaired")), SCHEMAS[kind])
    return rows.select(*replies.columns, F.coalesce("value", second).alias("value"), (F.col("value").isNull() & second.isNotNull()).alias("was_repaired"))


def retrying(call: Callable[[str], str], tries: int = 4, longest: float = 10.0, seed: int | None = None, sleep: Callable[[float], None] = time.sleep) -> Callable[[list[str]], list[str | None]]:
    """A provider of single calls as one of batches: waits of random length that double up to ``longest``; None after the last try."""
    rng = random.Random(seed)

    def one(message: str) -> str | None:
        for attempt in range(tries):
            try:
                return call(message)
            except Exception:  # noqa: BLE001 - whatever a provider raises is tried again
                if attempt + 1 < tries:
                    sleep(min(longest, rng.random() * 2**attempt))
        return None

    return lambda messages: [one(m) for m in messages]
