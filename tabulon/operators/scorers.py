"""Models as plug-ins: what takes batches of pairs or prompts and gives scores."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import token_f1, tokens


class Scorer(Protocol):
    """Scores aligned lists of texts; made once for each task."""

    def __call__(self, references: list[str], candidates: list[str]) -> list[float]: ...


def scored(pairs: DataFrame, make: Callable[[], Scorer], left: str = "left", right: str = "right", batch: int = 64) -> DataFrame:
    """pairs with `score`. Equal pairs are scored once; filter what isn't eligible before, as no predicate passes through Python."""
    distinct = pairs.select(left, right).where(F.col(left).isNotNull() & F.col(right).isNotNull()).distinct()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = make()
        for frame in frames:
            for k in range(0, len(frame), batch):
                part = frame.iloc[k : k + batch]
                yield part.assign(score=[float(x) for x in scorer(part[left].tolist(), part[right].tolist())])

    known = distinct.mapInPandas(run, f"`{left}` string, `{right}` string, score double")
    return pairs.join(known, [left, right], "left")


def overlap_score(left: Column, right: Column) -> Column:
    """The scorer without a model: F1 of the texts' token sets, as a Spark expression."""
    return token_f1(tokens(left), tokens(right))


def choose(prompt: Column, choices: Column) -> Column:
    """The judge without a model: the choice that shares most tokens with the prompt, the first of equal ones; null without any."""
    own = F.array_distinct(tokens(prompt))
    shared = F.transform(choices, lambda c: F.size(F.array_intersect(own, tokens(c))))
    return F.when(F.array_max(shared) > 0, F.array_position(shared, F.array_max(shared)) - 1).cast("int")
