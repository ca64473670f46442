"""Embedding models in batches: loaded once in each Python worker, passages and queries apart, one text's failure kept to that text."""

from __future__ import annotations

import logging
import math
import sys
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Any

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

PASSAGES = "embedding array<float>, failure string"


def loaded() -> dict[str, Any]:
    """This process's models by the key of their Embedder. Functions travel by value, with globals of their own for each task, so it is kept with the interpreter."""
    return sys.__dict__.setdefault("_notelake_models", {})


@dataclass(frozen=True)
class Embedder:
    """A model with the methods passages(texts) and queries(texts), each giving one vector for each text.

    load makes the model where it is used: once in each worker process, whose tasks share it. Texts go to it in groups of ``batch`` of like length. A group that
    raises, or gives another number of vectors, is halved until the texts that fail are alone; these have a null vector and the reason. So has a text whose vector
    is null, empty or not finite. A null text counts as empty.
    """

    load: Callable[[], Any]
    batch: int = 32
    key: str = field(default_factory=lambda: uuid.uuid4().hex)

    def model(self) -> Any:
        models = loaded()
        if self.key not in models:
            models[self.key] = self.load()
        return models[self.key]

    def passages(self, text: Column) -> Column:
        """struct<embedding, failure> of a text column."""
        return self._column("passages", text)

    def queries(self, text: Column) -> Column:
        """The same by the model's side for queries."""
        return self._column("queries", text)

    def query(self, text: str) -> list[float]:
        """One query's vector in this process; raises if the model does (``safe_embed`` leaves the channel out then)."""
        (vector, failure), = vectors(self.model().queries, [text], 1)
        if failure:
            raise RuntimeError(failure)
        return vector

    def _column(self, side: str, text: Column) -> Column:
        @F.pandas_udf(PASSAGES)
        def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
            try:
                call = getattr(self.model(), side)
            except Exception as e:  # a model that can't be loaded fails every text
                reason = f"{type(e).__name__}: {e}"

                def call(texts, reason=reason):
                    raise RuntimeError(reason)

            for texts in batches:
                yield pd.DataFrame(vectors(call, texts.fillna("").tolist(), self.batch), columns=["embedding", "failure"], dtype=object)

        return run(text)


def vectors(call: Callable[[list[str]], Any], texts: list[str], batch: int) -> list[tuple[list[float] | None, str | None]]:
    """(vector, None) or (None, reason) of each text, in order."""
    out: list = [None] * len(texts)
    order = sorted(range(len(texts)), key=lambda i: len(texts[i]))
    groups = [order[i : i + batch] for i in range(0, len(order), max(1, batch))][::-1]
    while groups:
        own = groups.pop()
        try:
            found = list(call([texts[i] for i in own]))
            if len(found) != len(own):
                raise ValueError(f"{len(found)} vectors for {len(own)} texts")
        except Exception as e:  # any model may fail in its own way
            if len(own) > 1:
                half = len(own) // 2
                groups += [own[half:], own[:half]]
                continue
            logging.getLogger(__name__).warning("embedding failed for a text of %d characters", len(texts[own[0]]), exc_info=True)
            out[own[0]] = (None, f"{type(e).__name__}: {e}")
            continue
        for i, v in zip(own, found, strict=True):
            out[i] = checked(v)
    return out


def checked(vector: Any) -> tuple[list[float] | None, str | None]:
    try:
        own = [] if vector is None else [float(x) for x in vector]
    except (TypeError, ValueError) as e:
        return None, f"{type(e).__name__}: {e}"
    if not own:
        return None, "no vector"
    return (own, None) if all(map(math.isfinite, own)) else (None, "a vector that isn't finite")
