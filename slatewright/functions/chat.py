"""Wording of the chat examples and prompts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# System, user and assistant texts of the four tasks.
SINGLE_SYSTEM = (
    "Provide a unique item recommendation that is complementary to the user's item list. \n"
    "Ensure the recommendation is from items included in the data you are fine-tuned with."
    " List only the item name.")
SINGLE_USER = "The user's item list:\n{user_item_list}"
LIST_SYSTEM = (
    "You are a recommender system assistant.\n"
    "Provide 20 unique item recommendations complementary to the user's item list, ordered by"
    " the confidence level of each recommendation.\n"
    "Ensure all recommendations are from items included in the data you are fine-tuned with."
    " List only the item names.\n")
LIST_USER = (
    "The user's item list are in the following lines\n"
    "delimited by BEGIN and END. Each item is in a separate line:\n"
    "BEGIN\n{user_item_list}\nEND\n")
LIST_ASSISTANT = (
    "The recommendations are in the following\n"
    "lines, in decreasing confidence order. The recommendations are delimited by\n"
    "BEGIN and END. Each recommendation is in a separate line:\n"
    "BEGIN\n{answer}\nEND\n")
CLASSIFY_SYSTEM = (
    "You are a recommender system assistant. You have access to the user's previous purchases"
    " and a list of availabe products.\n"
    "Provide 20 product recommendations for this user, only select from the available"
    " products.\n")
RANK_SYSTEM = (
    "You are a recommender system assistant.You have access to the user's previous purchases"
    " and a list of availabe products.\n"
    "Provide 20 product recommendations for this user, only select from the available"
    " products.\n")
CHOICE_USER = (
    "\nThe user's previous purchases: \n{user_item_list}\n\n"
    "Available products:\n{choices}\n\n\n"
    "Please remember to only select recommendations from the available products.\n")

TASKS = {
    "single": (SINGLE_SYSTEM, SINGLE_USER, "{answer}"),
    "list": (LIST_SYSTEM, LIST_USER, LIST_ASSISTANT),
    "classify": (CLASSIFY_SYSTEM, CHOICE_USER, "{answer}"),
    "rank": (RANK_SYSTEM, CHOICE_USER, "{answer}"),
}


def fill(template: str, **values: Column) -> Column:
    """The template with ``{name}`` replaced by column values."""
    out = F.lit(template)
    for name, value in values.items():
        out = F.replace(out, F.lit("{" + name + "}"), value)
    return out


def message(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def words(text: Column) -> Column:
    """Default length of a text: its number of words."""
    return F.size(F.filter(F.split(text, r"\s+"), lambda w: w != ""))


def message_tokens(messages: Column, tokens=words, per_message: int = 3) -> Column:
    """Token count of a conversation; ``tokens`` maps a text column to its length."""
    each = F.transform(messages, lambda m: tokens(m["content"]) + tokens(m["role"]) + per_message)
    return F.aggregate(each, F.lit(0), lambda a, b: a + b)
