"""Kernels, masked kernel means and the locally normalised allocation."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Support of a mean at which float32 noise begins.
EPS32 = 1.1920929e-07
Kernel = list[tuple[int, int, float]]


def normalised(taps: Kernel) -> Kernel:
    total = sum(w for _, _, w in taps)
    if not taps or total <= 0 or any(w < 0 for _, _, w in taps):
        raise ValueError("a kernel needs nonnegative weights with a positive sum")
    return [(dr, dc, w / total) for dr, dc, w in taps]


def plus_kernel() -> Kernel:
    return normalised([(0, 0, 1.0), (1, 0, 1.0), (-1, 0, 1.0), (0, 1, 1.0), (0, -1, 1.0)])


def circular_kernel(radius_m: float, pixel_m: float) -> Kernel:
    """Uniform disk: offsets within the radius."""
    reach = int(radius_m / pixel_m + 1e-9)
    return normalised([(i, j, 1.0) for i in range(-reach, reach + 1) for j in range(-reach, reach + 1) if math.hypot(i, j) * pixel_m <= radius_m + 1e-9])


def gaussian_kernel(fwhm_m: float, pixel_m: float, cut: float = 4.0) -> Kernel:
    """Gaussian with the given full width at half maximum, cut at `cut` standard deviations."""
    if fwhm_m <= 0:
        raise ValueError("full width at half maximum must be positive")
    sigma = fwhm_m / (2 * math.sqrt(2 * math.log(2))) / pixel_m
    reach = math.ceil(cut * sigma)
    return normalised([(i, j, math.exp(-(i * i + j * j) / (2 * sigma * sigma))) for i in range(-reach, reach + 1) for j in range(-reach, reach + 1)])


def box_kernel(width_m: float, height_m: float, pixel_m: float) -> Kernel:
    """Overlap of an axis-aligned box, centred on a pixel, with the pixels around."""

    def part(size: float) -> list[tuple[int, float]]:
        half = size / 2
        reach = math.ceil(half / pixel_m - 0.5)
        return [(i, w) for i in range(-reach, reach + 1) if (w := min(half, (i + 0.5) * pixel_m) - max(-half, (i - 0.5) * pixel_m)) > 0]

    return normalised([(i, j, a * b) for i, a in part(height_m) for j, b in part(width_m)])


def taps(kernel: Kernel) -> Column:
    """The kernel as an array column: a literal of the plan, shipped with the tasks."""
    return F.array(*[F.struct(F.lit(dr).alias("dr"), F.lit(dc).alias("dc"), F.lit(float(w)).alias("w")) for dr, dc, w in kernel])


#: Taps from which tiles and transforms are cheaper than a row a tap, and the least side of a tile.
MANY_TAPS, TILE = 64, 128


def sums(px: DataFrame, kernel: Kernel, values: list[str], keys: list[str] | None = None) -> DataFrame:
    """Sums over the pixels that each sees: scatter() for few taps, tiled() for many."""
    return (scatter if len(kernel) <= MANY_TAPS else tiled)(px, kernel, values, keys)


def tiled(px: DataFrame, kernel: Kernel, values: list[str], keys: list[str] | None = None, tile: int | None = None) -> DataFrame:
    """The same as scatter() for kernels of any number of taps: tiles with a halo, correlated by Fourier transforms.

    A tile and its halo are one group of bounded size, so the work is that of the tile's side
    times its logarithm and doesn't grow with the taps.  Pixels travel once for each tile
    whose halo holds them, with only their values outside their own.
    """
    import numpy as np
    import pyarrow as pa

    keys = keys or []
    reach = max(max(abs(dr), abs(dc)) for dr, dc, _ in kernel)
    tile = tile or max(TILE, 2 * reach)
    side = tile + 2 * reach
    place = [*keys, "r", "c"]
    kept = [c for c in px.columns if c not in place]
    weights = np.zeros((side, side))
    for dr, dc, w in kernel:
        weights[dr % side, dc % side] += w
    seen = np.conj(np.fft.rfft2(weights))

    def run(key, table):
        top, left = key[-2].as_py() * tile - reach, key[-1].as_py() * tile - reach
        r, c = table.column("r").to_numpy() - top, table.column("c").to_numpy() - left
        core = table.filter(table.column("core"))
        i, j = core.column("r").to_numpy() - top, core.column("c").to_numpy() - left

        def total(at, of) -> pa.Array:
            held = np.zeros((side, side))
            held[r[at], c[at]] = of
            return pa.array(np.fft.irfft2(np.fft.rfft2(held) * seen, s=(side, side))[i, j])

        out = core.select([*place, *kept])
        every = np.arange(len(r))
        out = out.append_column("g", total(every, 1.0))
        for v in values:
            column = table.column(v).cast(pa.float64())
            there = np.flatnonzero(column.is_valid().to_numpy(zero_copy_only=False))
            out = out.append_column(f"n_{v}", total(there, column.to_numpy(zero_copy_only=False)[there]))
            out = out.append_column(f"s_{v}", total(there, 1.0))
        return out

    held = tile_halo(px, tile, reach, everywhere=True)
    held = held.withColumns({c: F.when(F.col("core"), F.col(c)) for c in kept if c not in values})
    fields = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in px.select(*place, *kept).schema], "g double", *[f"`{k}_{v}` double" for v in values for k in ("n", "s")]])
    return held.groupBy(*keys, "tile_r", "tile_c").applyInArrow(run, fields)


def scatter(px: DataFrame, kernel: Kernel, values: list[str], keys: list[str] | None = None) -> DataFrame:
    """`px` with sums over the pixels it sees: `n_<v>` = sum(w * v), `s_<v>` = sum(w where v is there), `g` = sum(w).

    Each pixel is spread to the targets that see it and summed by target.  A pixel also meets
    itself, and that row carries its own columns, so there is no join: one shuffle, with
    partial sums before it.  Targets that aren't pixels are dropped.
    """
    keys = keys or []
    place = [*keys, "r", "c"]
    kept = [c for c in px.columns if c not in place]
    if not any((dr, dc) == (0, 0) for dr, dc, _ in kernel):
        kernel = [*kernel, (0, 0, 0.0)]
    spread = px.withColumn("_k", F.explode(taps(kernel))).withColumn("_w", F.col("_k.w")).withColumn("_own", (F.col("_k.dr") == 0) & (F.col("_k.dc") == 0))
    spread = spread.withColumn("r", F.col("r") - F.col("_k.dr")).withColumn("c", F.col("c") - F.col("_k.dc"))
    own = [F.max(F.when(F.col("_own"), F.col(c))).alias(f"_own_{c}") for c in kept]
    sums = [F.sum("_w").alias("g")]
    for v in values:
        sums += [F.sum(F.col("_w") * F.col(v)).alias(f"n_{v}"), F.sum(F.when(F.col(v).isNotNull(), F.col("_w"))).alias(f"s_{v}")]
    out = spread.groupBy(*place).agg(F.max("_own").alias("_there"), *own, *sums).where("_there").drop("_there")
    return out.withColumnsRenamed({f"_own_{c}": c for c in kept})


def kernel_mean(px: DataFrame, kernel: Kernel, values: list[str], keys: list[str] | None = None) -> DataFrame:
    """`px` with `k_<v>` (mean over valid weight), `s_<v>` (valid support) and `g` (geometric support)."""
    out = sums(px, kernel, values, keys)
    one = lambda x: F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(x, F.lit(0.0))))
    for v in values:
        out = out.withColumn(f"k_{v}", F.when(F.coalesce(F.col(f"s_{v}"), F.lit(0.0)) > EPS32, F.col(f"n_{v}") / F.col(f"s_{v}")))
        out = out.withColumn(f"s_{v}", one(F.col(f"s_{v}"))).drop(f"n_{v}")
    return out.withColumn("g", one(F.col("g")))


def allocate(px: DataFrame, kernel: Kernel, radiance: str, h: str, ref: float = 1.0, eps_rel: float = 1e-6, unstable_rel: float = 0.05, min_support: float = 1.0, tol: float = 1e-6) -> DataFrame:
    """Locally normalised allocation L = h * mean(l) / max(mean(h), eps) with its diagnostics.

    Needs r, c and the two value columns; h is already normalised to mean `ref`.  Adds kl, kh,
    s_l, s_h, g, allocation, pre_clip, reaggregated, err and the masks.
    """
    eps, unstable, full = eps_rel * ref, unstable_rel * ref, min_support - tol
    base = px.withColumn("l", F.col(radiance)).withColumn("h", F.col(h)) if h != "h" else px.withColumn("l", F.col(radiance))
    first = kernel_mean(base, kernel, ["l", "h"]).withColumnsRenamed({"k_l": "kl", "k_h": "kh"})
    first = first.withColumns({
        "is_floor": F.coalesce(F.col("kh") < eps, F.lit(False)),
        "is_unstable": F.coalesce(F.col("kh") < unstable, F.lit(False)),
        "is_boundary": F.col("g") < 1 - tol,
        "is_invalid_l": F.col("s_l") < F.col("g") - tol,
        "is_invalid_h": F.col("s_h") < F.col("g") - tol,
        "is_negative_input": F.coalesce(F.col("l") < 0, F.lit(False)),
    })
    valid = F.col("h").isNotNull() & F.col("kl").isNotNull() & F.col("kh").isNotNull() & (F.least("s_l", "s_h", "g") >= full)
    first = first.withColumn("is_valid", valid).withColumn("pre_clip", F.when(F.col("is_valid"), F.col("h") * F.col("kl") / F.greatest(F.col("kh"), F.lit(eps))))
    first = first.withColumns({"is_negative_pre": F.coalesce(F.col("pre_clip") < 0, F.lit(False)), "allocation": F.when(F.col("pre_clip").isNotNull(), F.greatest(F.col("pre_clip"), F.lit(0.0)))})
    second = kernel_mean(first.withColumn("g1", F.col("g")).drop("g"), kernel, ["allocation"])
    complete = F.col("l").isNotNull() & (F.least("s_allocation", "g") >= full)
    return second.drop("g").withColumnsRenamed({"g1": "g", "k_allocation": "reaggregated"}).withColumn("err", F.when(complete, F.col("l") - F.col("reaggregated")))


def uniform(px: DataFrame, kernel: Kernel, radiance: str, **how) -> DataFrame:
    """The same with an even proxy."""
    return allocate(px.withColumn("h", F.lit(1.0)), kernel, radiance, "h", **how)


def daily_stencil(daily: DataFrame, proxy: DataFrame, kernel: Kernel, least: float = 0.05) -> DataFrame:
    """Coarse operator by day (d, r, c, v): complete where all taps are there.

    structural = h * mean(v) / mean(h) with h at least `least`, where mean(h) > 1e-6.
    """
    held = daily.join(proxy.select("r", "c", F.greatest(F.col("h"), F.lit(least)).alias("h")), ["r", "c"], "left")
    out = sums(held, kernel, ["v", "h"], ["d"])
    n = len(kernel)
    full = lambda s: F.coalesce(F.col(s), F.lit(0.0)) > 1 - 0.5 / n
    uniform_value = F.when(full("s_v"), F.col("n_v"))
    den = F.when(full("s_h") & (F.col("n_h") > 1e-6), F.col("n_h"))
    return out.select("d", "r", "c", "v", "h", uniform_value.alias("uniform"), F.when(full("s_v"), F.col("h") * F.col("n_v") / den).alias("structural"))


def block_mean(px: DataFrame, value: str, k: int, strict: bool) -> DataFrame:
    """Means of k x k blocks; strict: null unless the whole block is there."""
    out = px.groupBy(F.floor(F.col("r") / k).cast("int").alias("br"), F.floor(F.col("c") / k).cast("int").alias("bc")).agg(F.avg(value).alias("mean"), F.count(value).alias("n"))
    return out.withColumn("mean", F.when(F.col("n") == k * k, F.col("mean"))) if strict else out


def nearest_distance(px: DataFrame, target: Column, cap: int, pixel_m: float) -> DataFrame:
    """Distance in metres to the nearest target pixel within `cap` pixels, null beyond.

    Targets are spread to the cap-sized buckets around them, so each pixel meets only
    targets of its neighbourhood: an equi-join with a residual condition, not a product.
    """
    bucket = lambda x: F.floor(F.col(x) / cap).cast("int")
    near = px.where(target).select(F.col("r").alias("tr"), F.col("c").alias("tc"), bucket("r").alias("br"), bucket("c").alias("bc"))
    for b in ("br", "bc"):
        near = near.withColumn(b, F.explode(F.sequence(F.col(b) - 1, F.col(b) + 1)))
    own = px.withColumn("br", bucket("r")).withColumn("bc", bucket("c"))
    squared = (F.col("r") - F.col("tr")) ** 2 + (F.col("c") - F.col("tc")) ** 2
    found = own.select("r", "c", "br", "bc").join(near, ["br", "bc"]).where(squared <= cap * cap).groupBy("r", "c").agg((F.sqrt(F.min(squared)) * pixel_m).alias("distance"))
    return px.join(found, ["r", "c"], "left")


def exact_distance(px: DataFrame, target: Column, pixel_m: float) -> DataFrame:
    """(r, c, distance) of all pixels: exact Euclidean distance in metres to the nearest target however far, null if there is none.

    Two passes over the raster's extent: windows give the rows to the nearest target of the
    same column, then each row takes the lower envelope of its columns' parabolas.
    """
    import numpy as np
    import pandas as pd

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        c, g = pdf["c"].to_numpy().astype(float), pdf["g"].to_numpy().astype(float)
        top: list[tuple[float, float]] = []  # column of a parabola and its height there
        start: list[float] = []  # where it becomes the lowest
        for at in np.argsort(c):
            if np.isnan(g[at]):
                continue
            k, h, left = c[at], g[at] ** 2, -np.inf
            while top:
                left = ((h + k * k) - (top[-1][1] + top[-1][0] ** 2)) / (2 * (k - top[-1][0]))
                if left > start[-1]:
                    break
                top.pop()
                start.pop()
                left = -np.inf
            top.append((k, h))
            start.append(left)
        if top:
            near = np.array(top)[np.searchsorted(start, c) - 1]
            far = np.sqrt((c - near[:, 0]) ** 2 + near[:, 1]) * pixel_m
        else:
            far = [None] * len(c)
        out = pd.DataFrame({"r": pdf["r"], "c": pdf["c"], "distance": pd.array(far, "Float64")})
        return out[pdf["there"].to_numpy()]

    marked = px.select("r", "c", F.lit(True).alias("there"), F.when(target, F.col("r")).alias("t"))
    held = lattice(px).join(marked, ["r", "c"], "left").withColumn("there", F.coalesce("there", F.lit(False)))
    column = Window.partitionBy("c")
    above, below = F.last("t", True).over(column.orderBy("r")), F.last("t", True).over(column.orderBy(F.desc("r")))
    held = held.withColumn("above", above).withColumn("below", below)
    held = held.select("r", "c", "there", F.least(F.col("r") - F.col("above"), F.col("below") - F.col("r")).cast("double").alias("g"))
    return held.groupBy("r").applyInPandas(run, "r int, c int, distance double")


def lattice(px: DataFrame) -> DataFrame:
    """Every place (r, c) of the raster's extent, whether a pixel is there or not."""
    ends = px.agg(F.min("r").alias("r0"), F.max("r").alias("r1"), F.min("c").alias("c0"), F.max("c").alias("c1"))
    rows = ends.select(F.explode(F.sequence("r0", "r1")).alias("r"), "c0", "c1").repartition("r")
    return rows.select("r", F.explode(F.sequence("c0", "c1")).alias("c"))


def tile_halo(px: DataFrame, tile: int, halo: int, everywhere: bool = False) -> DataFrame:
    """Pixels copied to every tile whose window, widened by the halo, holds them; `core`: in the tile itself.

    Tiles start at 0 unless `everywhere`.
    """
    lo = lambda x: F.floor((F.col(x) - halo) / tile).cast("int")
    hi = lambda x: F.floor((F.col(x) + halo) / tile).cast("int")
    own = lambda x: F.floor(F.col(x) / tile).cast("int")
    out = px.withColumn("tile_r", F.explode(F.sequence(lo("r"), hi("r")))).withColumn("tile_c", F.explode(F.sequence(lo("c"), hi("c"))))
    if not everywhere:
        out = out.where((F.col("tile_r") >= 0) & (F.col("tile_c") >= 0))
    return out.withColumn("core", (F.col("tile_r") == own("r")) & (F.col("tile_c") == own("c")))


def kernel_mean_tiled(px: DataFrame, kernel: Kernel, value: str, tile: int) -> DataFrame:
    """r, c, k_<value>, s_<value>: the same means by tile with a halo, whatever the number of taps."""
    out = tiled(px.select("r", "c", value), kernel, [value], tile=tile)
    mean = F.when(F.col(f"s_{value}") > EPS32, F.col(f"n_{value}") / F.col(f"s_{value}"))
    return out.select("r", "c", mean.alias(f"k_{value}"), F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col(f"s_{value}"))).alias(f"s_{value}"))
