"""Vector scores as SQL expressions; nothing here runs Python on executors."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Up to this width a score is one flat arithmetic expression, which is compiled
#: with the rest of the stage; beyond it the generated method would be too long.
FLAT_DIM = 128


def constant(value: object, kind: str) -> Column:
    """A nested constant in one expression, folded once when the plan is made."""
    return F.from_json(F.lit(json.dumps(value)), kind)


def _literal(vector: Sequence[float]) -> Column:
    return constant([float(x) for x in vector], "array<double>")


def _fold(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)


def dot(a: Column, b: Column) -> Column:
    """Inner product in double precision, components added from the left."""
    return _fold(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def l2_squared(a: Column, b: Column) -> Column:
    def square(x: Column, y: Column) -> Column:
        d = x.cast("double") - y.cast("double")
        return d * d

    return _fold(F.zip_with(a, b, square))


def l2_squared_to(name: str, query: Sequence[float]) -> Column:
    """Squared Euclidean distance of the array column ``name`` to a fixed query."""
    if len(query) > FLAT_DIM:
        return l2_squared(F.col(name), _literal(query))
    parts = (f"(CAST(get(`{name}`, {i}) AS DOUBLE) - {float(x)!r}D)" for i, x in enumerate(query))
    return F.expr("0D + " + " + ".join(f"{p} * {p}" for p in parts))


def dot_to(name: str, query: Sequence[float]) -> Column:
    if len(query) > FLAT_DIM:
        return dot(F.col(name), _literal(query))
    return F.expr("0D + " + " + ".join(f"CAST(get(`{name}`, {i}) AS DOUBLE) * {float(x)!r}D" for i, x in enumerate(query)))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; null where a norm is zero or not finite."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((norm > 0) & (norm < float("inf")), dot(a, b) / norm)


def cosine_distance(a: Column, b: Column) -> Column:
    return 1 - cosine(a, b)

