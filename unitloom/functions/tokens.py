"""Token counts and budgets."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, functions as F


def token_count(text: Column) -> Column:
    """Number of white-space separated tokens (U1, default counter)."""
    return F.regexp_count(text, F.lit(r"\S+"))


@dataclass(frozen=True)
class TokenCounter:
    """A tokenizer of the user's.

    ``make`` builds a function text -> number of tokens; it is called once per Python
    worker task, so a vocabulary is loaded once and not per row.
    ``max_chars_per_token``, where given, is the most characters of a text that one counted
    token stands for, characters that are not counted included.  It lets a plan rule out
    texts that cannot fit a budget by their length, before they are gathered; a text that
    breaks the bound is an error.  Without it texts are gathered first and then counted.
    """

    make: Callable[[], Callable[[str], int]]
    max_chars_per_token: int | None = None

    def column(self, text: Column) -> Column:
        make = self.make

        @F.pandas_udf("int")
        def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            tokens = make()
            for batch in batches:
                yield pd.Series([None if t is None else tokens(t) for t in batch], dtype="Int32")

        return count(text)


def count_tokens(text: Column, counter: TokenCounter | None = None) -> Column:
    return token_count(text) if counter is None else counter.column(text)


def fits_budget(tokens: Column, budget: int) -> Column:
    """Strictly below the budget."""
    return tokens < budget


def choose_level(counts: list[Column], budget: int) -> Column:
    """Largest level that fits and whose smaller levels all fit, 0 if none does."""
    chain = None
    for level, tokens in enumerate(counts):
        misfit = ~fits_budget(tokens, budget)
        chain = F.when(misfit, level) if chain is None else chain.when(misfit, level)
    return chain.otherwise(len(counts))
