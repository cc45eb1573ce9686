"""Models as column functions, with deterministic stand-ins.

A model is whatever gives a column from columns: an expression, a pandas UDF, or
``batch_model`` around a function that loads it. It is loaded once a worker and
sees Arrow batches; where none is given, what it would add is left out."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DataType

from . import scores as S
from . import text as T


@dataclass
class Providers:
    """The models of a run. ``embed`` text to vector; ``cross`` (question, passage)
    to score; ``judge`` (question, answer) and ``check`` (answer, context) to a
    probability; ``ask`` a prompt to a question; ``answer`` (question, context) to an
    array of candidates; ``sentences`` text to sentences; ``entities`` text to entities."""

    embed: Callable[[Column], Column] | None = None
    cross: Callable[[Column, Column], Column] | None = None
    judge: Callable[[Column, Column], Column] | None = None
    check: Callable[[Column, Column], Column] | None = None
    ask: Callable[[Column], Column] | None = None
    answer: Callable[[Column, Column], Column] | None = None
    sentences: Callable[[Column], Column] = field(default=T.sentences)
    entities: Callable[[Column], Column] | None = None


def first_that_loads(loaders: list[Callable[[], object]], tries: int = 3, wait: float = 1.0) -> object:
    """What the first loader gives that works; each is tried again after growing waits."""
    errors = []
    for load in loaders:
        for n in range(tries):
            try:
                return load()
            except Exception as e:  # any failure of a model's own code: try the next
                errors.append(e)
                if n + 1 < tries:
                    time.sleep(wait * 2**n)
    raise RuntimeError(f"no model could be loaded: {errors}")


def batch_model(loaders: list[Callable[[], Callable[..., np.ndarray]]], returns: DataType, batch_size: int = 64, tries: int = 3, wait: float = 1.0) -> Callable[..., Column]:
    """A column function from functions that load a model, largest first; a worker
    loads the first that works, once."""
    return predict_batch_udf(lambda: first_that_loads(loaders, tries, wait), return_type=returns, batch_size=batch_size)


# --- deterministic stand-ins ----------------------------------------------------


def hashed_embedding(text: Column, dim: int = 64) -> Column:
    """A unit vector of hashed words, in place of a language model's."""

    def of(ws):
        at = F.transform(ws, lambda w: F.pmod(F.xxhash64(w), F.lit(dim)).cast("int"))
        v = F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.size(F.filter(at, lambda a: a == i)).cast("double"))
        return T.let(v, lambda x: T.let(F.sqrt(S.dot(x, x)), lambda n: F.transform(x, lambda y: F.coalesce(F.try_divide(y, n), F.lit(0.0)))))

    return T.let(T.words(F.lower(text)), of)


def overlap_scorer(question: Column, passage: Column) -> Column:
    """Share of the question's terms that the passage has, in place of a cross-encoder."""
    return S.relevance(question, passage).cast("double")


def extracted_answer(question: Column, context: Column) -> Column:
    """The context's first sentence with the most terms of the question, as the one
    candidate, in place of a language model's answer. An extension of ours."""
    terms = S.question_terms(question)

    def of(ss):
        marks = F.transform(ss, lambda s: T.matching_terms(terms, F.lower(s)))
        return T.let(marks, lambda m: F.get(ss, (F.array_position(m, F.array_max(m)) - 1).cast("int")))

    return F.array(F.coalesce(T.let(T.sentences(context), of), F.lit("")))
