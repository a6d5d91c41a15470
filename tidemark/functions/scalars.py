"""Small column expressions: casts that never fail, clipping, entropy, flags."""

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

NULL_TOKENS = ("", "NA", "NaN")


def null_tokens(text: Column, tokens=NULL_TOKENS) -> Column:
    """Null for the given marker strings."""
    return F.when(text.isin(list(tokens)), None).otherwise(text)


def to_number(text: Column, kind: str = "double") -> Column:
    """Number of a string or number, null where the cast fails."""
    return text.try_cast(kind)


def clip_upper(value: Column, cap: float) -> Column:
    """Values above ``cap`` become ``cap``; null stays null."""
    return F.when(value > cap, F.lit(cap)).otherwise(value)


def measured(value: Column) -> Column:
    """1 where a value exists, else 0."""
    return value.isNotNull().cast("tinyint")


def any_flag(flags: list[Column]) -> Column:
    """1 where at least one 0/1 flag is set, else 0."""
    hit = reduce(lambda a, b: a | b, [f == 1 for f in flags])
    return F.when(hit, 1).otherwise(0)


def admission_label(admission_id: Column, expired: Column, disposition: Column) -> Column:
    """1 for an admission, a death flag or an EXPIRED disposition, else 0."""
    return (
        F.when(admission_id.isNotNull(), 1)
        .when(F.coalesce(expired, F.lit(0)) == 1, 1)
        .when(disposition == "EXPIRED", 1)
        .otherwise(0)
    )


def binary_entropy(p: Column, eps: float = 1e-9) -> Column:
    """Entropy in bits of a probability; ``eps`` is added to p and to 1 - p."""
    a = p + F.lit(eps)
    b = F.lit(1.0) - p + F.lit(eps)
    return -(a * F.log2(a) + b * F.log2(b))
