"""String clean-up, list rendering and completion parsing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Entities and their replacements, applied in this order.
ENTITY_REPLACEMENTS = (
    ("&amp;", " and "),
    ("&lt;", ""),
    ("&gt;", ""),
    ("&ndash", ""),
    ("&mdash;", ""),
    ("&ensp;", ""),
    ("&nbsp;", " "),
    ("&shy;", ""),
    ("&copy;", ""),
    ("&trade;", ""),
    ("&reg;", ""),
    ("&quot;", ""),
)

# List markers and the preamble of a generated list.
LIST_BEGIN = "BEGIN"
LIST_END = "END"
LIST_PREAMBLE = (
    "The recommendations are in the following\n"
    "lines, in decreasing confidence order. The recommendations are delimited by\n"
    "BEGIN and END. Each recommendation is in a separate line:\n"
    "BEGIN")
NUMBERED_ITEM = r"\d+\.\s(.*?)\n"


def clean_entities(text: Column) -> Column:
    for entity, replacement in ENTITY_REPLACEMENTS:
        text = F.replace(text, F.lit(entity), F.lit(replacement))
    return text


def strip_quotes(text: Column) -> Column:
    """Trim blanks, then single quotes, then double quotes."""
    return F.btrim(F.btrim(F.btrim(text, F.lit(" \t\r\n")), F.lit("'")), F.lit('"'))


def between(text: Column, first: str, last: str) -> Column:
    """Shortest text between two literal markers, or an empty string."""
    return F.regexp_extract(text, f"(?:{_quoted(first)})(.*?)(?:{_quoted(last)})", 1)


def between_or(text: Column, first: str, last: str, other: str) -> Column:
    """As :func:`between`, trying a second end marker when nothing was found."""
    found = between(text, first, last)
    return F.when(found == "", between(text, first, other)).otherwise(found)


def _quoted(marker: str) -> str:
    return r"\Q" + marker + r"\E"


def sorted_label(values: Column) -> Column:
    """Sorted values joined by underscores."""
    return F.array_join(F.array_sort(values), "_")


def numbered_list(names: Column) -> Column:
    """``1. name`` lines, each ending in a newline."""
    lines = F.transform(names, lambda x, i: F.concat(
        (i + 1).cast("string"), F.lit(". "), x, F.lit("\n")))
    return F.array_join(lines, "")


def numbered_items(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(NUMBERED_ITEM), F.lit(1))


def parse_single(text: Column) -> Column:
    """A completion holding one item name."""
    return F.btrim(text, F.lit(" \t\r\n"))


def parse_numbered(text: Column, k: int) -> Column:
    """The first ``k`` numbered items."""
    return F.slice(numbered_items(text), 1, k)


def parse_delimited(text: Column, k: int) -> Column:
    """A list between the second BEGIN and the second END, with two fall-backs.

    Without both markers twice the known preamble is removed and numbered items are
    taken from the rest; without numbered items every non-empty line counts.
    """
    begins, ends = F.split(text, LIST_BEGIN), F.split(text, LIST_END)
    twice = (F.size(begins) >= 3) & (F.size(ends) >= 3)
    start = F.length(F.substring_index(text, LIST_BEGIN, 2)) + len(LIST_BEGIN)
    stop = F.length(F.substring_index(text, LIST_END, 2))
    inside = F.substring(text, start + 1, F.greatest(F.lit(0), stop - start))
    rest = F.replace(text, F.lit(LIST_PREAMBLE), F.lit(""))
    loose = numbered_items(rest)
    found = F.when(twice, numbered_items(inside)).when(F.size(loose) > 0, loose).otherwise(
        F.split(text, "\n"))
    return F.slice(F.filter(found, lambda x: x != ""), 1, k)
