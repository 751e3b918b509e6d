"""Recodes, pair labels, response parsing and other scalar expressions."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from pairbench.constants import (
    ACUITY_RANK,
    CALL_FAILED,
    DAYS_PER_YEAR,
    PAIR_LEVELS,
    PROMPT_BEFORE_A,
    PROMPT_BEFORE_B,
    PROMPT_END,
    PROMPT_INTRO,
)


def age_in_years(days: Column) -> Column:
    return days.cast("double") / F.lit(DAYS_PER_YEAR)


def timestamp_year(timestamp: Column, fmt: str | None = None) -> Column:
    """Year of a formatted timestamp; NULL where the text does not parse."""
    parsed = F.try_to_timestamp(timestamp) if fmt is None else F.try_to_timestamp(timestamp, F.lit(fmt))
    return F.year(parsed)


def recode(column: Column, mapping: Mapping) -> Column:
    """Look each value up in a dictionary; a missing key gives NULL."""
    entries = [F.lit(x) for item in mapping.items() for x in item]
    return F.try_element_at(F.create_map(*entries), column)


def relabel(column: Column, mapping: Mapping[str, str]) -> Column:
    """Replace the given values and leave all others as they are."""
    return F.coalesce(recode(column, mapping), column)


def acuity_rank(level: Column) -> Column:
    return recode(level, ACUITY_RANK)


def side_from_difference(difference: Column) -> Column:
    """'A' above zero, 'B' below, NULL at zero or NULL."""
    return F.when(difference > 0, "A").when(difference < 0, "B")


def correct_flag(label: Column, truth: Column) -> Column:
    """1 where both agree; 0 where they differ or one is NULL."""
    return F.coalesce(label == truth, F.lit(False)).cast("int")


def joined_key(left: Column, right: Column) -> Column:
    return F.concat(left, F.lit("_"), right)


def unordered_label(left: Column, right: Column) -> Column:
    """The two labels in alphabetical order, joined by a hyphen."""
    return F.array_join(F.array_sort(F.array(left, right)), "-")


def pair_class(levels: Column) -> Column:
    """Class 0..9 of a key such as 'Urgent_Immediate', the same for both orders."""
    classes = {}
    for number, (high, low) in enumerate(PAIR_LEVELS):
        classes[f"{high}_{low}"] = number
        classes[f"{low}_{high}"] = number
    return recode(levels, classes)


def pair_prompt(text_a: Column, text_b: Column) -> Column:
    """The full prompt; NULL if either text is."""
    return F.concat(
        F.lit(PROMPT_INTRO + PROMPT_BEFORE_A), text_a, F.lit(PROMPT_BEFORE_B), text_b, F.lit(PROMPT_END)
    )


def response_content(response: Column) -> Column:
    """Answer text of a response document; the sentinel if it cannot be read."""
    return F.coalesce(F.get_json_object(response, "$.choices[0].message.content"), F.lit(CALL_FAILED))


def response_usage(response: Column, counter: str) -> Column:
    """A token counter of a response document, such as 'prompt_tokens'."""
    return F.get_json_object(response, f"$.usage.{counter}").try_cast("int")


def answer_label(content: Column, detect_both: bool = False) -> Column:
    """'0', '1', 'error' or 'neither', tested in this order.

    ``detect_both`` tells answers with both digits apart, as 'both_present'.
    """
    zero, one = F.contains(content, F.lit("0")), F.contains(content, F.lit("1"))
    label = F.when(zero & one, "both_present") if detect_both else F
    return (
        label.when(zero, "0")
        .when(one, "1")
        .when(F.contains(content, F.lit(CALL_FAILED)), "error")
        .otherwise("neither")
    )
