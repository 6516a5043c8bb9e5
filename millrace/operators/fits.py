"""Fits as questions and answers, so that several can share one pass over a table.

A fit is a generator: it yields what it wants to know of the table as an ``Ask`` and
is sent the answer; what it returns is the fitted result. ``alone`` makes a plain
function of it. ``together`` runs several fits side by side and answers what all of
them ask at a time with one aggregate, and their quantiles with one search.
"""

from __future__ import annotations

from collections.abc import Callable, Generator
from dataclasses import dataclass, field
from functools import wraps
from typing import Any

from pyspark.sql import Column, DataFrame

from ..frame import aggregate_row
from .quantiles import quantiles

#: Aggregates that share a plan.
FUSED = 120


@dataclass
class Ask:
    """Named aggregates of a table, and quantiles by column, which the answer names ``(column, probability)``."""

    aggregates: dict[Any, Column] = field(default_factory=dict)
    quantiles: dict[str, list[float]] = field(default_factory=dict)


Fit = Generator[Ask, dict, Any]


def answers(df: DataFrame, asks: list[Ask]) -> list[dict]:
    """What each asks, from one aggregate and one search for quantiles."""
    wanted = {(i, name): e for i, ask in enumerate(asks) for name, e in ask.aggregates.items()}
    got = aggregate_row(df, wanted, FUSED) if wanted else {}
    columns = list(dict.fromkeys(c for ask in asks for c in ask.quantiles))
    probs = sorted({p for ask in asks for ps in ask.quantiles.values() for p in ps})
    found = quantiles(df, columns, probs) if columns else {}
    return [{**{name: got[i, name] for name in ask.aggregates},
             **{(c, p): found[c][probs.index(p)] for c, ps in ask.quantiles.items() for p in ps}} for i, ask in enumerate(asks)]


def together(df: DataFrame, fits: list[Fit]) -> list:
    """The result of each fit, or the exception that ended it."""
    out: list = [None] * len(fits)
    sent: dict[int, dict | None] = {i: None for i in range(len(fits))}
    while sent:
        asked: dict[int, Ask] = {}
        for i, answer in sent.items():
            try:
                asked[i] = fits[i].send(answer)
            except StopIteration as done:
                out[i] = done.value
            except Exception as error:  # of this fit alone
                out[i] = error
        sent = dict(zip(asked, answers(df, list(asked.values())))) if asked else {}
    return out


def alone(fit: Callable[..., Fit]) -> Callable:
    """The fit as a function of the table that answers its own questions."""

    @wraps(fit)
    def run(df: DataFrame, *args, **options):
        result = together(df, [fit(df, *args, **options)])[0]
        if isinstance(result, Exception):
            raise result
        return result

    run.fit = fit
    return run
