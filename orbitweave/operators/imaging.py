"""Images as pixel tables (image_id, y, x, values) or flat arrays: crop, compare, rotate, similarity, bands."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from orbitweave.functions import radiometry as R
from orbitweave.operators.matching import best_by, in_blocks, vectors_of


def pixels(images: DataFrame, image: str, values: str, width: int) -> DataFrame:
    """A flat array as ``image, y, x, v``."""
    return images.select(image, F.posexplode(values).alias("__k", "v")).select(image, F.floor(F.col("__k") / width).cast("int").alias("y"), (F.col("__k") % width).alias("x"), "v")


def crop_border(pix: DataFrame, image: str, grey: Column, threshold: float) -> DataFrame:
    """Pixels within the bounding box of those brighter than the threshold, moved to begin at 0; an all-dark image stays whole."""
    box = pix.where(grey > threshold).groupBy(image).agg(F.min("y").alias("y0"), F.max("y").alias("y1"), F.min("x").alias("x0"), F.max("x").alias("x1"))
    joined = pix.join(box, image, "left")
    inside = F.col("y0").isNull() | (F.col("y").between(F.col("y0"), F.col("y1")) & F.col("x").between(F.col("x0"), F.col("x1")))
    shift = lambda c, o: (F.col(c) - F.coalesce(o, F.lit(0))).alias(c)
    rest = [c for c in pix.columns if c not in ("y", "x")]
    return joined.where(inside).select(*rest, shift("y", "y0"), shift("x", "x0"))


def rmse(a: Column, b: Column) -> Column:
    return F.sqrt(F.avg(F.pow(a - b, F.lit(2.0))))


def absolute_difference(a: Column, b: Column) -> Column:
    return F.abs(a.cast("int") - b.cast("int"))


def rotated(values: Column, side: int, quarter_turns: int) -> Column:
    """A flat square image turned counter-clockwise by quarter turns."""
    order = np.rot90(np.arange(side * side).reshape(side, side), quarter_turns).ravel().tolist()
    return F.array(*(F.get(values, k) for k in order))


def global_similarity(a: Column, b: Column, span: float) -> Column:
    """Structural similarity of two flat images from their global means, variances and covariance."""
    n = F.size(a).cast("double")
    total = lambda v: F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double"))
    product = lambda u, v: F.aggregate(F.zip_with(u, v, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, x: s + x)
    ma, mb = total(a) / n, total(b) / n
    va, vb, cov = product(a, a) / n - ma * ma, product(b, b) / n - mb * mb, product(a, b) / n - ma * mb
    c1, c2 = (0.01 * span) ** 2, (0.03 * span) ** 2
    return (2.0 * ma * mb + c1) * (2.0 * cov + c2) / ((ma * ma + mb * mb + c1) * (va + vb + c2))


def best_rotation(pairs: DataFrame, keys: list[str], raw: str, candidate: str, side: int, span: float) -> DataFrame:
    """The angle (0, 90, 180, 270) that makes the candidate most similar to the raw image; the first on ties."""
    turned = F.array(*(F.struct(F.lit(90 * k).alias("angle"), global_similarity(F.col(raw), rotated(F.col(candidate), side, k), span).alias("s")) for k in range(4)))
    each = pairs.select(*keys, F.explode(turned).alias("t"))
    return best_by(each.select(*keys, F.col("t.angle").alias("angle"), F.col("t.s").alias("s")), keys, F.col("s"), F.col("angle"), ["angle"])


def ssim(pairs: DataFrame, a: str, b: str, side: int, span: float = 255.0, window: int = 7) -> DataFrame:
    """Adds ``ssim``: mean over all windows of the structural similarity, sample covariances (Wang et al. 2004)."""
    n, c1, c2 = window * window, (0.01 * span) ** 2, (0.03 * span) ** 2

    def box(x: np.ndarray) -> np.ndarray:
        s = np.pad(x.cumsum(axis=1).cumsum(axis=2), ((0, 0), (1, 0), (1, 0)))
        return s[:, window:, window:] - s[:, :-window, window:] - s[:, window:, :-window] + s[:, :-window, :-window]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if not len(frame):
                yield frame.assign(ssim=pd.Series(dtype="float64"))
                continue
            x, y = (np.stack(frame[c].to_numpy()).astype(np.float64).reshape(-1, side, side) for c in (a, b))
            mx, my = box(x) / n, box(y) / n
            unbiased = n / (n - 1)
            vx, vy, cov = (unbiased * (box(p) / n - q) for p, q in ((x * x, mx * mx), (y * y, my * my), (x * y, mx * my)))
            value = (2 * mx * my + c1) * (2 * cov + c2) / ((mx * mx + my * my + c1) * (vx + vy + c2))
            yield frame.assign(ssim=value.mean(axis=(1, 2)))

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pairs.schema.fields)
    return pairs.mapInPandas(run, f"{fields}, ssim double")


def combine_bands(pix: DataFrame, bands: DataFrame, offnadir: Column, glint: Column) -> DataFrame:
    """Adds ``radiance, dn2047, dn255`` of off-nadir plus glint radiance, by the band's calibration (a few rows, broadcast)."""
    joined = pix.join(F.broadcast(bands), "band").withColumn("radiance", offnadir + glint)
    cal = [F.col(c) for c in ("gain", "offset", "eff_bw", "abs_cal")]
    return joined.withColumn("dn2047", R.radiance_to_dn2047(F.col("radiance"), *cal)).withColumn("dn255", R.dn2047_to_dn255(F.col("dn2047"))).drop("gain", "offset", "eff_bw", "abs_cal", "satellite")


def stack_bands(pix: DataFrame, image: str, value: str) -> DataFrame:
    """One row a pixel with ``rgb``."""
    one = lambda b: F.max(F.when(F.col("band") == b, F.col(value)))
    return pix.groupBy(image, "y", "x").agg(F.struct(one("red").alias("r"), one("green").alias("g"), one("blue").alias("b")).alias("rgb"))


def band_radiance(spectrum: DataFrame, response: DataFrame) -> DataFrame:
    """Radiance of each band: the spectrum interpolated at the response's wavelengths, weighted and integrated by trapezoids.

    Spectrum steps are listed by whole nm, so a wavelength finds its step by an equi-join. Both have ``wl_nm, value``."""
    from pyspark.sql import Window

    step = Window.orderBy("wl_nm")  # a spectrum is one curve of at most some thousand rows
    steps = spectrum.select("wl_nm", "value", F.lead("wl_nm").over(step).alias("next_wl"), F.lead("value").over(step).alias("next_value")).where("next_wl IS NOT NULL")
    listed = steps.withColumn("nm", F.explode(F.sequence(F.floor("wl_nm"), F.floor("next_wl"))))
    points = response.select("band", F.col("wl_nm").alias("at"), F.col("value").alias("weight"), F.floor("wl_nm").alias("nm"))
    hit = points.join(listed, "nm").where("at >= wl_nm AND at < next_wl")
    light = F.col("value") + (F.col("next_value") - F.col("value")) * (F.col("at") - F.col("wl_nm")) / (F.col("next_wl") - F.col("wl_nm"))
    curve = hit.select("band", "at", (light * F.col("weight")).alias("p"))
    along = Window.partitionBy("band").orderBy("at")
    area = (F.col("p") + F.lag("p").over(along)) / 2.0 * (F.col("at") - F.lag("at").over(along))
    return curve.withColumn("area", area).groupBy("band").agg(F.sum("area").alias("radiance"))


def summed_area(values: Column, side: int) -> Column:
    """The summed-area table of a flat square image, as an array of side + 1 rows: each row is the one before plus the row's own sums."""
    zero = F.lit(0.0)
    rows = F.transform(F.sequence(F.lit(0), F.lit(side - 1)), lambda y: F.slice(values, y * side + 1, F.lit(side)))
    along = lambda row: F.aggregate(row, F.array(zero), lambda done, v: F.concat(done, F.array(F.element_at(done, -1) + v.cast("double"))))
    first = F.array(F.array_repeat(zero, side + 1))
    return F.aggregate(rows, first, lambda done, row: F.concat(done, F.array(F.zip_with(F.element_at(done, -1), along(row), lambda p, q: p + q))))


def window_sums(values: Column, side: int, window: int) -> Column:
    """The sums of all windows of a flat square image, row by row, from its summed-area table."""
    last = side - window

    def sums(s: Column) -> Column:
        at = lambda y, x: F.get(F.get(s, y), x)
        each = F.sequence(F.lit(0), F.lit(last))
        return F.flatten(F.transform(each, lambda y: F.transform(each, lambda x: at(y + window, x + window) - at(y, x + window) - at(y + window, x) + at(y, x))))

    # One element, so that the table is made once and not for each of its cells.
    return F.flatten(F.transform(F.array(summed_area(values, side)), sums))


def window_moments(values: Column, side: int, window: int) -> Column:
    """``mean`` and ``spread`` (standard deviation, of samples) of each window."""
    n = float(window * window)
    squares = F.transform(values, lambda v: v.cast("double") * v.cast("double"))
    mean = F.transform(window_sums(values, side, window), lambda v: v / n)
    return F.zip_with(mean, window_sums(squares, side, window), lambda m, q: F.struct(m.alias("mean"), F.sqrt(F.greatest(F.lit(0.0), (q / n - m * m) * (n / (n - 1.0)))).alias("spread")))


def windowed_similarity(a: Column, b: Column, ma: Column, mb: Column, side: int, window: int, span: float) -> Column:
    """Mean structural similarity of two images with their ``window_moments``."""
    n, c1, c2 = float(window * window), (0.01 * span) ** 2, (0.03 * span) ** 2
    products = window_sums(F.zip_with(a, b, lambda p, q: p.cast("double") * q.cast("double")), side, window)

    def one(pair: Column, product: Column) -> Column:
        p, q = pair["p"], pair["q"]
        cov = (product / n - p["mean"] * q["mean"]) * (n / (n - 1.0))
        return (2.0 * p["mean"] * q["mean"] + c1) * (2.0 * cov + c2) / ((p["mean"] * p["mean"] + q["mean"] * q["mean"] + c1) * (p["spread"] * p["spread"] + q["spread"] * q["spread"] + c2))

    both = F.zip_with(ma, mb, lambda p, q: F.struct(p.alias("p"), q.alias("q")))
    return F.aggregate(F.zip_with(both, products, one), F.lit(0.0), lambda s, v: s + v) / float((side - window + 1) ** 2)


def similarity_bound(ma: Column, mb: Column, span: float) -> Column:
    """What the similarity can be at most, by means and spreads alone: a covariance is at most the product of the spreads.

    Of images whose values aren't negative, so that the means' part isn't."""
    c1, c2 = (0.01 * span) ** 2, (0.03 * span) ** 2

    def one(p: Column, q: Column) -> Column:
        light = (2.0 * p["mean"] * q["mean"] + c1) / (p["mean"] * p["mean"] + q["mean"] * q["mean"] + c1)
        return light * (2.0 * p["spread"] * q["spread"] + c2) / (p["spread"] * p["spread"] + q["spread"] * q["spread"] + c2)

    return F.aggregate(F.zip_with(ma, mb, one), F.lit(0.0), lambda s, v: s + v) / F.size(ma)


#: What rounding may take off a bound.
SLACK = 1e-9


#: Pairs that are scored at once: some arrays of them stay in a core's cache.
PAIRS_AT_ONCE = 1 << 16


def _best_of_block(kind: pa.DataType, side: int, window: int, span: float):
    """The candidate and quarter turn of a block that are most similar to each query: products of all pairs' windows are matrix products."""
    n, c1, c2, grid = window * window, (0.01 * span) ** 2, (0.03 * span) ** 2, side - window + 1
    flat = np.arange(side * side).reshape(side, side)
    turns = [np.rot90(flat, k).ravel() for k in range(4)]
    windows = [flat[y : y + window, x : x + window].ravel() for y in range(grid) for x in range(grid)]

    def moments(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        mean = v.sum(axis=1) / n
        return mean, np.maximum(0.0, ((v * v).sum(axis=1) / n - mean * mean) * (n / (n - 1.0)))

    def run(asked: pa.Table, dealt: pa.Table) -> pa.Table:
        names = ["query", "match", "angle", "score"]
        if not asked.num_rows or not dealt.num_rows:
            return pa.table([pa.array([], t) for t in (kind, kind, pa.int32(), pa.float64())], names)
        ids, keys = asked["query"].to_numpy(), dealt["match"].to_numpy()
        order = np.argsort(keys, kind="stable")
        keys, q, c = keys[order], vectors_of(asked["__v"]), vectors_of(dealt["__v"])[order]
        seen = [(q[:, w], *moments(q[:, w])) for w in windows]
        best, at, turned = np.full(len(ids), -np.inf), np.zeros(len(ids), dtype=np.int64), np.zeros(len(ids), dtype=np.int32)
        step = max(32, PAIRS_AT_ONCE // len(ids))
        for lo in range(0, len(keys), step):
            for k, turn in enumerate(turns):
                pose = c[lo : lo + step][:, turn]
                score = np.zeros((len(ids), len(pose)))
                for w, (x, mx, vx) in zip(windows, seen, strict=True):
                    y = pose[:, w]
                    my, vy = moments(y)
                    both = mx[:, None] * my[None, :]
                    part = x @ y.T
                    part /= n
                    part -= both
                    part *= 2.0 * n / (n - 1.0)
                    part += c2
                    both *= 2.0
                    both += c1
                    part *= both
                    part /= (mx * mx)[:, None] + (my * my + c1)[None, :]
                    part /= vx[:, None] + (vy + c2)[None, :]
                    score += part
                score /= len(windows)
                top = score.max(axis=1)
                # Scores are compared by nine digits; of equal ones the first stands.
                first = (score >= np.minimum(np.round(top, 9) - 0.5e-9, top)[:, None]).argmax(axis=1)
                rounded = np.round(top, 9)
                better = (rounded > best) | ((rounded == best) & (lo + first < at))
                best[better], at[better], turned[better] = rounded[better], lo + first[better], 90 * k
        return pa.table([pa.array(ids, kind), pa.array(keys[at], kind), pa.array(turned, pa.int32()), pa.array(best)], names)

    return run


def best_windowed_match(queries: DataFrame, candidates: DataFrame, key: str, values: str, side: int, window: int = 7, span: float = 255.0, block_rows: int = 8_192, block_queries: int = 2_048) -> DataFrame:
    """``query, match, angle, score``: the candidate and quarter turn that are most similar to each query; ties go to the least key, then angle.

    Each block of candidates meets each block of the queries, a stated set, in one group of bounded size, where all pairs
    are scored by matrix products; only the best of each goes on. Rows without an image, with a null in it or with
    another number of values are left out."""
    kind = candidates.schema[key].dataType
    image = lambda df, name: df.where((F.size(values) == side * side) & ~F.exists(values, lambda v: v.isNull())).select(F.col(key).cast(kind).alias(name), F.col(values).alias("__v"))
    one = kind.simpleString()
    found = in_blocks(image(queries, "query"), image(candidates, "match"), "query", "match", [], block_rows, block_queries, _best_of_block(to_arrow_type(kind), side, window, span), f"query {one}, match {one}, angle int, score double")
    return best_by(found, ["query"], F.round("score", 9), F.struct("match", "angle"), ["match", "angle"])
