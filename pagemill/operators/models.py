"""Embedders and text models in batches: loaded once a worker, filled across rows, probed before use.

A model is an object of the caller's own, made by a function that workers can import or unpickle; nothing here
connects to a service.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


class Embedder(Protocol):
    dimension: int
    max_tokens: int

    def embed(self, texts: list[str]) -> list[list[float]]: ...


class TextModel(Protocol):
    def complete(self, prompts: list[str]) -> list[str]: ...


_LOADED: dict[str, object] = {}


def loaded(name: str, load: Callable[[], object]):
    """The worker's model of this name, made by the first task that asks for it."""
    if name not in _LOADED:
        _LOADED[name] = load()
    return _LOADED[name]


def batches_of(sizes: list[int], rows: int, tokens: int) -> Iterator[slice]:
    """Neighbouring items in batches of at most ``rows`` items and ``tokens`` tokens, or of one larger item."""
    start = held = 0
    for at, size in enumerate(sizes):
        if at > start and (at - start >= rows or held + size > tokens):
            yield slice(start, at)
            start, held = at, 0
        held += size
    if start < len(sizes):
        yield slice(start, len(sizes))


def estimated_tokens(text: str) -> int:
    return -(-len(text) // 4)


def embedded(text: Column, name: str, load: Callable[[], Embedder], rows: int = 64, tokens: int = 8192, count: Callable[[str], int] = estimated_tokens) -> Column:
    """``array<double>`` of each text; null for a null one.

    Texts are cut at the model's ``max_tokens`` (in characters, four a token) and sent in batches of ``rows`` texts
    and ``tokens`` tokens at most, whatever rows they stand in.  A vector of another length than ``dimension`` is an error.
    """

    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model: Embedder = loaded(name, load)
        for part in parts:
            known = [(i, t[: 4 * model.max_tokens]) for i, t in enumerate(part) if t is not None]
            out: list[list[float] | None] = [None] * len(part)
            for batch in batches_of([count(t) for _, t in known], rows, tokens):
                made = model.embed([t for _, t in known[batch]])
                if len(made) != len(known[batch]):
                    raise ValueError(f"{name}: {len(made)} vectors for {len(known[batch])} texts")
                for (i, _), vector in zip(known[batch], made):
                    if len(vector) != model.dimension:
                        raise ValueError(f"{name}: a vector of {len(vector)} numbers, not {model.dimension}")
                    out[i] = [float(v) for v in vector]
            yield pd.Series(out, dtype=object)

    return F.pandas_udf(run, "array<double>")(text)


REPLY = "reply string, error string"


def completed(prompt: Column, name: str, load: Callable[[], TextModel], rows: int = 16, tokens: int = 16_384, count: Callable[[str], int] = estimated_tokens) -> Column:
    """A struct (reply, error) for each prompt, both null for a null one.

    Before its first batch a task asks the model one short question; where that fails, its rows get ``ServiceUnavailable``.
    A batch that fails is asked again prompt by prompt, so that one bad prompt is one failure.
    """

    def run(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model, available = None, False
        try:
            model = loaded(name, load)
            available = bool(model.complete(["Hello"])[0])
        except Exception:
            pass
        for part in parts:
            known = [(i, t) for i, t in enumerate(part) if t is not None]
            replies: list[str | None] = [None] * len(part)
            errors: list[str | None] = [None] * len(part)
            for batch in batches_of([count(t) for _, t in known], rows, tokens):
                asked = known[batch]
                if not available:
                    for i, _ in asked:
                        errors[i] = "ServiceUnavailable"
                    continue
                try:
                    made = model.complete([t for _, t in asked])
                    if len(made) != len(asked):
                        raise ValueError("a reply is missing")
                    for (i, _), reply in zip(asked, made):
                        replies[i] = reply
                except Exception:
                    for i, t in asked:
                        try:
                            replies[i] = model.complete([t])[0]
                        except Exception as wrong:
                            errors[i] = f"{type(wrong).__name__}: {wrong}"[:500]
            yield pd.DataFrame({"reply": pd.Series(replies, dtype=object), "error": pd.Series(errors, dtype=object)})

    return F.pandas_udf(run, REPLY)(prompt)


def complete_with(name: str, load: Callable[[], TextModel], **options) -> Callable[[Column], Column]:
    """A column function from prompt to reply, as ``enrich`` takes it; failures are null replies."""
    return lambda prompt: completed(prompt, name, load, **options)["reply"]
