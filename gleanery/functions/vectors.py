"""Vector metrics over array columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column, guard: float = 1e-8) -> Column:
    """With a small term in the denominator, so that zero vectors give 0."""
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)) + guard)


def perplexity(nll: Column, tokens: Column) -> Column:
    """Token-weighted: exp of the summed loss over the summed tokens."""
    return F.exp(F.sum(nll * tokens) / F.greatest(F.lit(1), F.sum(tokens)))


def perplexity_of_logprobs(token: Column, logprob: Column) -> Column:
    """exp of the mean negative log probability, without image tokens (<image...>, with or without bars)."""
    return F.exp(-F.avg(F.when(~F.rlike(token, F.lit(r"^<\|?image[^>]*>$")), logprob)))
