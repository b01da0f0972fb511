"""Prompt and chat-example tables for language models."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slatewright.functions.chat import TASKS, fill, message, message_tokens, words
from slatewright.functions.hashing import seeded_key
from slatewright.functions.text import numbered_list
from slatewright.operators.ranking import rank_overall

MAX_TOKENS = 4096


def named_lists(rows: DataFrame, names: DataFrame, order: str = "pos") -> DataFrame:
    """``case_id, names``: item names in order, of every case and every item.

    An item without a name keeps its place and is called by its id. Token limits apply
    to whole examples, in :func:`training_split`.
    """
    label = F.coalesce("name", F.concat(F.lit("item "), F.col("item_id").cast("string")))
    joined = rows.join(names.select("item_id", "name"), "item_id", "left").withColumn("name", label)
    packed = F.array_sort(F.collect_list(F.struct(order, "name")))
    return joined.groupBy("case_id").agg(F.transform(packed, lambda x: x["name"]).alias("names"))


def as_lines(lists: DataFrame) -> DataFrame:
    """``case_id, text``: one name per line."""
    return lists.select("case_id", F.array_join("names", "\n").alias("text"))


def grounded_slates(recs: DataFrame, truths: DataFrame, k: int | None = None) -> DataFrame:
    """``case_id, rank, item_id, was_missing``: the truth first, then the slate.

    A missing truth replaces the last entry; ``k`` cuts the result.
    """
    truth = truths.where("pos = 1") if "pos" in truths.columns else truths
    truth = truth.select("case_id", F.col("item_id").alias("truth"))
    slates = recs.groupBy("case_id").agg(F.array_sort(F.collect_list(
        F.struct("rank", "item_id"))).alias("_s"))
    slates = slates.select("case_id", F.transform("_s", lambda x: x["item_id"]).alias("items"))
    joined = slates.join(truth, "case_id")
    missing = ~F.array_contains("items", F.col("truth"))
    rest = F.when(missing, F.slice("items", F.lit(1), F.size("items") - 1)).otherwise(
        F.array_remove("items", F.col("truth")))
    grounded = F.concat(F.array("truth"), rest)
    grounded = F.slice(grounded, 1, k) if k is not None else grounded
    return joined.select("case_id", missing.alias("was_missing"), F.posexplode(grounded).alias(
        "_at", "item_id")).select("case_id", (F.col("_at") + 1).alias("rank"), "item_id",
                                  "was_missing")


def missing_share(grounded: DataFrame) -> DataFrame:
    """One row ``share``: cases whose truth was not in the slate."""
    return grounded.where("rank = 1").agg(
        F.avg(F.col("was_missing").cast("double")).alias("share"))


def fully_named(slates: DataFrame, unnamed: DataFrame) -> DataFrame:
    """Slates without any unnamed item."""
    touched = slates.join(unnamed.select("item_id"), "item_id", "left_semi")
    return slates.join(touched.select("case_id").distinct(), "case_id", "left_anti")


def shuffled_within(rows: DataFrame, seed: int) -> DataFrame:
    """Slate rows in a reproducible random order per case (rank renumbered)."""
    order = Window.partitionBy("case_id").orderBy(seeded_key(seed, "case_id", "item_id"))
    return rows.withColumn("rank", F.row_number().over(order))


def chat_examples(task: str, prompts: DataFrame, answers: DataFrame,
                  choices: DataFrame | Column | None = None) -> DataFrame:
    """``case_id, messages``: system, user and assistant message of a task.

    ``prompts`` and ``answers`` hold ``case_id, names``; ``choices`` does too, or is one
    array for all cases.
    """
    if task not in TASKS:
        raise ValueError(f"unknown task {task!r}; choose one of {sorted(TASKS)}")
    system, user, assistant = TASKS[task]
    table = prompts.select("case_id", F.array_join("names", "\n").alias("_user")).join(
        answers.select("case_id", F.col("names").alias("_answer")), "case_id")
    values = {"user_item_list": F.col("_user")}
    if choices is not None:
        table, values["choices"] = _with_choices(table, choices)
    answer = F.element_at("_answer", 1) if task == "single" else numbered_list(F.col("_answer"))
    return table.select("case_id", F.array(
        message("system", F.lit(system)), message("user", fill(user, **values)),
        message("assistant", fill(assistant, answer=answer))).alias("messages"))


def _with_choices(table, choices):
    if isinstance(choices, Column):
        return table, F.array_join(choices, "\n")
    lists = choices.select("case_id", F.array_join("names", "\n").alias("_choices"))
    return table.join(lists, "case_id"), F.col("_choices")


def test_prompts(task: str, prompts: DataFrame, choices: DataFrame | Column | None = None
                 ) -> DataFrame:
    """``case_id, messages``: system and user message only."""
    system, user, _ = TASKS[task]
    table = prompts.select("case_id", F.array_join("names", "\n").alias("_user"))
    values = {"user_item_list": F.col("_user")}
    if choices is not None:
        table, values["choices"] = _with_choices(table, choices)
    return table.select("case_id", F.array(
        message("system", F.lit(system)), message("user", fill(user, **values))).alias("messages"))


def flat_prompt(examples: DataFrame) -> DataFrame:
    """``case_id, prompt``: system and user text in one string."""
    texts = F.transform(F.slice("messages", 1, 2), lambda m: m["content"])
    return examples.select("case_id", F.array_join(texts, "\n").alias("prompt"))


def training_split(examples: DataFrame, lengths: DataFrame, share: float = 0.2, seed: int = 42,
                   min_length: int = 2, max_tokens: int | None = MAX_TOKENS, tokens=words
                   ) -> DataFrame:
    """Adds ``split`` and ``n_tokens``; drops cases that are too short or too long.

    The first ``int(share * n)`` of all shuffled cases are for validation. The cases that
    the token limit drops are those of :func:`beyond_limit`.
    """
    counted = _split_examples(examples, lengths, share, seed, min_length, tokens)
    return counted.where(F.col("n_tokens") <= max_tokens) if max_tokens is not None else counted


def beyond_limit(examples: DataFrame, lengths: DataFrame, share: float = 0.2, seed: int = 42,
                 min_length: int = 2, max_tokens: int = MAX_TOKENS, tokens=words) -> DataFrame:
    """The examples that :func:`training_split` rejects for their number of tokens."""
    return _split_examples(examples, lengths, share, seed, min_length, tokens).where(
        F.col("n_tokens") > max_tokens)


def _split_examples(examples, lengths, share, seed, min_length, tokens):
    n = lengths.count()
    keyed = lengths.withColumn("_key", seeded_key(seed, "case_id"))
    shuffled = rank_overall(keyed, [F.col("_key"), F.col("case_id")], name="_rank")
    side = F.when(F.col("_rank") <= int(share * n), "validation").otherwise("train")
    kept = shuffled.where(F.col("length") >= min_length).select("case_id", side.alias("split"))
    return examples.join(kept, "case_id").withColumn(
        "n_tokens", message_tokens(F.col("messages"), tokens))


def token_cost(examples: DataFrame, cost_per_token: float, bound: float | None = None
               ) -> DataFrame:
    """``split, n_examples, n_tokens, cost`` and whether the cost stays within a bound."""
    total = examples.groupBy("split").agg(F.count(F.lit(1)).alias("n_examples"),
                                          F.sum("n_tokens").alias("n_tokens"))
    priced = total.withColumn("cost", F.col("n_tokens") * F.lit(cost_per_token))
    return priced if bound is None else priced.withColumn(
        "within_bound", F.col("cost") <= F.lit(bound))


def to_json_lines(examples: DataFrame, keep: Sequence[str] = ("split",)) -> DataFrame:
    """``keep..., value``: one JSON object with the messages per line."""
    return examples.select(*keep, F.to_json(F.struct("messages")).alias("value"))
