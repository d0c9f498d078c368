"""Arithmetic on the three stance probabilities (against, favor, neutral)."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, functions as F

from . import fixed

PROBS = ("p_against", "p_favor", "p_neutral")
EPS = 1e-10


def _cols(cols: Sequence[Column | str]) -> list[Column]:
    return [F.col(c) if isinstance(c, str) else c for c in cols]


def softmax(logits: Sequence[Column | str]) -> list[Column]:
    logits = _cols(logits)
    top = F.greatest(*logits)
    parts = [F.exp(x - top) for x in logits]
    total = sum(parts[1:], parts[0])
    return [p / total for p in parts]


def stance_score(against: Column | str = "p_against", favor: Column | str = "p_favor") -> Column:
    a, f = _cols([against, favor])
    return f - a


def argmax(cols: Sequence[Column | str] = PROBS) -> Column:
    """Index of the largest value, the first one on ties."""
    cols = _cols(cols)
    return (F.array_position(F.array(*cols), F.greatest(*cols)) - 1).cast("int")


def confidence(kind: str = "score", cols: Sequence[Column | str] = PROBS) -> Column:
    cols = _cols(cols)
    if kind == "score":
        return F.abs(cols[1] - cols[0])
    if kind == "class":
        return F.greatest(*cols)
    raise ValueError(f"unknown confidence: {kind}")


def stance_label(index: Column | str, names: Sequence[str] = fixed.STANCES) -> Column:
    (i,) = _cols([index])
    return F.get(F.array(*[F.lit(n) for n in names]), i.cast("int"))


def prediction_weight(
    cols: Sequence[Column | str] = PROBS, method: str = "entropy", binary: bool = False
) -> Column:
    """How sure a prediction is: its largest probability, or one minus its scaled entropy.

    ``binary`` looks at against and favor only, scaled to sum to one.
    """
    cols = _cols(cols)
    if binary:
        pair = cols[:2]
        total = pair[0] + pair[1] + F.lit(EPS)
        cols = [p / total for p in pair]
    if method == "max_prob":
        return F.greatest(*cols)
    if method != "entropy":
        raise ValueError(f"unknown weighting method: {method}")
    terms = [p * F.ln(p + F.lit(EPS)) for p in cols]
    entropy = -sum(terms[1:], terms[0])
    return F.lit(1.0) - entropy / F.lit(math.log(len(cols)))


NEUTRAL_BAND = 0.1


def rule_stance(cols: Sequence[Column | str] = PROBS) -> Column:
    """Neutral when the score is small and neutral leads, otherwise the sign of the score."""
    against, favor, neutral = _cols(cols)
    score = favor - against
    is_neutral = (F.abs(score) < NEUTRAL_BAND) & (neutral > F.greatest(against, favor))
    stance = F.when(is_neutral, 2).when(score > 0, 1).otherwise(0)
    sure = F.when(is_neutral, neutral).when(score > 0, favor).otherwise(against)
    return F.struct(
        score.alias("score"), stance.alias("stance"), sure.alias("confidence")
    )
