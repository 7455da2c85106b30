"""Adversarial losses as aggregates over critic scores."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import relu, softplus


def loss_terms(score: Column, is_real: Column, loss_type: str = "hinge_loss") -> dict[str, Column]:
    """Aggregate expressions by metric name; ``is_real`` tells the two sides apart."""
    real = F.when(is_real, score)
    fake = F.when(~is_real, score)
    if loss_type == "hinge_loss":
        d_real, d_fake = F.avg(relu_or_null(1.0 - real)), F.avg(relu_or_null(fake + 1.0))
    elif loss_type == "kl_loss":
        d_real, d_fake = F.avg(softplus_or_null(-real)), F.avg(softplus_or_null(fake))
    else:
        raise NotImplementedError(f"unknown loss type {loss_type!r}")
    return {
        "d_loss_real": d_real,
        "d_loss_fake": d_fake,
        "d_loss": d_real + d_fake,
        "g_loss": -F.avg(fake),
        "logit_real": F.avg(real),
        "logit_fake": F.avg(fake),
    }


def relu_or_null(x: Column) -> Column:
    # greatest() skips nulls, and a null marks the other side.
    return F.when(x.isNotNull(), relu(x))


def softplus_or_null(x: Column) -> Column:
    return F.when(x.isNotNull(), softplus(x))


def losses(
    df: DataFrame, score: str, is_real: Column, loss_type: str = "hinge_loss", keys: Sequence[str] = ()
) -> DataFrame:
    """One row of losses, or one per key (for example per step), from one pass with partial aggregation."""
    terms = loss_terms(F.col(score).cast("double"), is_real, loss_type)
    return df.groupBy(*keys).agg(*[term.alias(name) for name, term in terms.items()])
