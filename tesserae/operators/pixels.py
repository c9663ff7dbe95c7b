"""Per-pixel expressions: scaling, indices, water modifiers, proxies, gain."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Names of the declared variants, in their fixed order.
WATER_VARIANTS = ("no_water_prior", "persistent_only_soft", "spectral_only_soft", "combined_soft", "combined_hard_persistent_sensitivity_only", "soft_with_mapped_infrastructure_override")


def clamp(x: Column, lo: float = 0.0, hi: float = 1.0) -> Column:
    """Clamp that keeps null (greatest and least pass nulls over)."""
    return F.when(x.isNotNull(), F.least(F.lit(hi), F.greatest(F.lit(lo), x)))


def unit_scale(x: Column, lo: float, hi: float) -> Column:
    return clamp((x - lo) / (hi - lo))


def normalized_difference(a: Column, b: Column, eps: float = 1e-6) -> Column:
    return (a - b) / (a + b + eps)


def affine_floor(x: Column, floor: float) -> Column:
    """floor + (1 - floor) * x."""
    return floor + (1 - floor) * x


def indices(df: DataFrame) -> DataFrame:
    """Vegetation, built-up and water indices of bands b3, b4, b8, b11."""
    return df.withColumns({
        "ndvi": normalized_difference(F.col("b8"), F.col("b4")),
        "ndbi": normalized_difference(F.col("b11"), F.col("b8")),
        "mndwi": normalized_difference(F.col("b3"), F.col("b11")),
    })


def components(df: DataFrame) -> DataFrame:
    """Built, low-vegetation and spectral-water scores of the indices, and their base product."""
    out = df.withColumns({
        "built": unit_scale(F.col("ndbi"), -0.25, 0.35),
        "lowveg": 1 - unit_scale(F.col("ndvi"), 0.20, 0.80),
        "specwater": 1 - unit_scale(F.col("mndwi"), 0.0, 0.50),
    })
    return out.withColumn("base", F.col("built") * F.col("lowveg"))


def persistent_water(occurrence: Column, support: Column, mode: str, cutoff: float = 90.0) -> Column:
    """Weight of persistent water; without support it is neutral."""
    occ = F.coalesce(occurrence, F.lit(0.0))
    weight = {
        "soft": 1 - clamp(occ / cutoff),
        "hard": (occ < cutoff).cast("double"),
        "none": F.lit(1.0),
    }[mode]
    return F.when(~F.coalesce(support, F.lit(False)), F.lit(1.0)).otherwise(weight)


def water_modifier(variant: str, p: Column, s: Column, mask: Column, infra: Column) -> Column:
    """Modifier of a proxy by the declared variant."""
    cases = {
        "no_water_prior": F.lit(1.0),
        "persistent_only_soft": p,
        "spectral_only_soft": s,
        "combined_soft": p * s,
        "combined_hard_persistent_sensitivity_only": s * (~mask).cast("double"),
        "soft_with_mapped_infrastructure_override": F.when(infra, F.lit(1.0)).otherwise(p * s),
    }
    if variant not in cases:
        raise ValueError(f"undeclared water variant {variant!r}")
    return cases[variant]


def water_proxy(df: DataFrame, base: str, floor: float = 0.05, variants=WATER_VARIANTS) -> DataFrame:
    """A proxy column by variant; a null base stays null, a negative one fails the query."""
    b = F.when(F.col(base) < 0, F.raise_error(F.lit("proxy base is negative")).cast("double")).otherwise(F.col(base))
    p, s, m, i = (F.col(x) for x in ("persistent_w", "spectral_w", "persistent_mask", "infra"))
    return df.withColumns({f"proxy_{v}": affine_floor(b * water_modifier(v, p, s, m, i), floor) for v in variants})


def built_proxy(area: Column, cell_area: Column, road_density: Column) -> Column:
    """Building coverage and road density as one score."""
    return 0.7 * F.sqrt(clamp(F.try_divide(area, cell_area))) + 0.3 * clamp(road_density / 20000.0)


def gain(h: Column, kh: Column, valid: Column, eps: float) -> Column:
    return F.when(valid & h.isNotNull() & kh.isNotNull(), h / F.greatest(kh, F.lit(eps)))


def gain_stratum(g: Column) -> Column:
    """1: below 0.8, 2: to below 1.25, 3: from there on."""
    return F.when(g < 0.8, 1).when(g < 1.25, 2).when(g.isNotNull(), 3).cast("int")


def direct(df: DataFrame, value: str = "radiance") -> DataFrame:
    """Identity where valid: the baseline without any allocation."""
    return df.withColumn("allocation", F.col(value))


def normalize_mean_one(df: DataFrame, proxy: str, out: str = "h", divisor: float | None = None) -> DataFrame:
    """Proxy divided by its mean over support, or by `divisor`.

    The mean is one row, joined by broadcast; no support or a negative value fails the query.
    """
    if divisor is not None:
        return df.withColumn(out, F.col(proxy) / F.lit(float(divisor)))
    total = df.agg(F.avg(proxy).alias("_mean"), F.min(proxy).alias("_least"))
    mean = F.when(F.col("_mean").isNull() | (F.col("_mean") <= 0), F.raise_error(F.lit("proxy has no positive support")).cast("double")).when(F.col("_least") < 0, F.raise_error(F.lit("proxy is negative")).cast("double")).otherwise(F.col("_mean"))
    return df.join(F.broadcast(total)).withColumn(out, F.col(proxy) / mean).drop("_mean", "_least")
