"""Observation quality: bit fields and admission contracts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Field -> (shift, mask); fixed by the product's format.
QA_FIELDS = {
    "day_night": (0, 1),
    "background": (1, 7),
    "mask_quality": (4, 3),
    "cloud": (6, 3),
    "shadow": (8, 1),
    "cirrus": (9, 1),
    "snow_ice": (10, 1),
}
#: Fixed values of the two contracts: mandatory quality, cloud detection, least mask quality.
CONTRACTS = {"strict": ((0,), (0, 1), 2), "broad": ((0, 1), (0, 1), 1)}


def decode_qa(df: DataFrame, qf: str = "qf") -> DataFrame:
    """Adds the seven fields; anything that isn't a whole number gives nulls."""
    value = F.expr(f"try_cast({qf} AS INT)")
    return df.select("*", *[F.shiftright(value, shift).bitwiseAND(F.lit(mask)).alias(name) for name, (shift, mask) in QA_FIELDS.items()])


def _field(qf: Column, name: str) -> Column:
    shift, mask = QA_FIELDS[name]
    return F.shiftright(qf, shift).bitwiseAND(F.lit(mask))


def accepted(mqf: Column, qf: Column, snow: Column, variant: str) -> Column:
    """Whether an observation passes the strict or the broad contract; null inputs fail."""
    if variant not in CONTRACTS:
        raise ValueError(f"undeclared quality variant {variant!r}")
    mandatory, cloud, quality = CONTRACTS[variant]
    ok = mqf.isin(*mandatory) & _field(qf, "cloud").isin(*cloud) & (_field(qf, "mask_quality") >= quality)
    for flag in ("day_night", "shadow", "cirrus", "snow_ice"):
        ok = ok & (_field(qf, flag) == 0)
    return F.coalesce(ok & (snow == 0), F.lit(False))


def mask_observations(daily: DataFrame, variant: str, value: str = "radiance") -> DataFrame:
    """Adds `accepted`, and `kept`: the value where it is accepted."""
    ok = accepted(F.col("mqf"), F.col("qf"), F.col("snow"), variant)
    return daily.withColumn("accepted", ok).withColumn("kept", F.when(F.col("accepted"), F.col(value)))


def clear_sky(df: DataFrame, least_score: float = 0.60, excluded=(1, 3, 8, 9, 10, 11), bands=("b2", "b3", "b4", "b8", "b11", "b12")) -> DataFrame:
    """Rows with score at least the threshold, an admitted scene class and all bands."""
    full = None
    for b in bands:
        full = F.col(b).isNotNull() if full is None else full & F.col(b).isNotNull()
    return df.where((F.col("cs_cdf") >= least_score) & ~F.col("scl").isin(*excluded) & full)
