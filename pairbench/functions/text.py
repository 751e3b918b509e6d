"""Note cleaning, section extraction and token counts as column expressions."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from pairbench.constants import NOT_EXTRACTED


def drop_newlines(text: Column) -> Column:
    """Delete line feeds, putting nothing in their place; carriage returns stay."""
    return F.replace(text, F.lit("\n"), F.lit(""))


def squeeze_spaces(text: Column) -> Column:
    """Turn each run of spaces into one; tabs stay.

    A byte search for two spaces is far cheaper than a regular expression, so
    texts without a run skip the latter.
    """
    return F.when(F.contains(text, F.lit("  ")), F.regexp_replace(text, " {2,}", " ")).otherwise(text)


def clean_note(text: Column) -> Column:
    return squeeze_spaces(drop_newlines(text))


def contains_flag(text: Column, header: str) -> Column:
    """'Y' if the header occurs in the text (case matters), else 'N', also for NULL."""
    return F.when(F.instr(text, header) > 0, "Y").otherwise("N")


def first_position(text: Column, patterns: Sequence[str]) -> Column:
    """1-based position of the earliest of several literal patterns, or NULL."""
    found = [F.nullif(F.instr(text, p), F.lit(0)) for p in patterns]
    return found[0] if len(found) == 1 else F.least(*found)


def slice_between(text: Column, start: Column, end: Column, missing: str = NOT_EXTRACTED) -> Column:
    """The text from one position up to another; empty if the end comes first."""
    cut = F.substring(text, start, F.greatest(end - start, F.lit(0)))
    return F.when(start.isNotNull() & end.isNotNull(), cut).otherwise(F.lit(missing))


def slice_to_end(text: Column, start: Column, missing: str = NOT_EXTRACTED) -> Column:
    return F.when(start.isNotNull(), F.substr(text, start)).otherwise(F.lit(missing))


def extract_between(
    text: Column, start_patterns: Sequence[str], end_patterns: Sequence[str], missing: str = NOT_EXTRACTED
) -> Column:
    """From the first start pattern to the first end pattern.

    Both are searched from the beginning of the text.
    """
    start = first_position(text, start_patterns)
    end = first_position(text, end_patterns)
    return slice_between(text, start, end, missing)


def extract_with_fallback(
    text: Column,
    start_patterns: Sequence[str],
    end_choices: Sequence[Sequence[str]],
    missing: str = NOT_EXTRACTED,
) -> Column:
    """Like ``extract_between``, ending at the first group of end patterns that occurs at all."""
    end = F.coalesce(*[first_position(text, group) for group in end_choices])
    return slice_between(text, first_position(text, start_patterns), end, missing)


def extract_to_end(text: Column, start_choices: Sequence[Sequence[str]], missing: str = NOT_EXTRACTED) -> Column:
    """From the first occurring group of start patterns to the end of the text."""
    start = F.coalesce(*[first_position(text, group) for group in start_choices])
    return slice_to_end(text, start, missing)


def token_count(text: Column) -> Column:
    """Number of tokens: each alphanumeric run and each other non-space character.

    Every run shrinks to one character and spaces go, so that the length of what
    is left is the count; no array of tokens is built.
    """
    shrunk = F.regexp_replace(text, "[A-Za-z0-9]+", "a")
    return F.char_length(F.replace(shrunk, F.lit(" "), F.lit("")))


def tokenizer_count(load: Callable[[], Callable[[str], Sequence]]) -> Callable[[Column], Column]:
    """Token count by a tokenizer of the user's.

    ``load`` is called once for each Python worker task and returns a function
    from a text to its tokens. Texts travel in Arrow batches and become Python
    strings one at a time; ``session.bound_batches`` bounds the batches.
    """

    @F.arrow_udf("int")
    def count_tokens(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encode = load()
        for texts in batches:
            yield pa.array([len(encode(t.as_py())) if t.is_valid else None for t in texts], pa.int32())

    return count_tokens
