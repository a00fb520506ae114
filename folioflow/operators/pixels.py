"""Image statistics on a pixel relation (page, y, x, ...): windows and aggregates, a page's pixels partitioned by page."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .pages import per_page


def to_gray(pixels: DataFrame) -> DataFrame:
    """Luminance, rounded half to even."""
    return pixels.withColumn("gray", F.rint(0.299 * F.col("r") + 0.587 * F.col("g") + 0.114 * F.col("b")).cast("int"))


def integral(pixels: DataFrame, value: str = "lum") -> DataFrame:
    """Sums of values and squares over everything above and left of each pixel."""
    along = Window.partitionBy("page", "y").orderBy("x").rowsBetween(Window.unboundedPreceding, 0)
    down = Window.partitionBy("page", "x").orderBy("y").rowsBetween(Window.unboundedPreceding, 0)
    v = F.col(value).cast("long")
    rows = pixels.withColumn("_s", F.sum(v).over(along)).withColumn("_q", F.sum(v * v).over(along))
    return rows.select("page", "y", "x", F.sum("_s").over(down).alias("total"), F.sum("_q").over(down).alias("squares"))


def histogram(pixels: DataFrame, value: str = "lum") -> DataFrame:
    return pixels.groupBy("page", F.col(value).alias("v")).agg(F.count("*").alias("n"))


def otsu(pixels: DataFrame, value: str = "lum") -> DataFrame:
    """Threshold of greatest variance between classes, the lowest of equals; 128 for a page of one shade."""
    w = Window.partitionBy("page").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy("page")
    h = histogram(pixels, value)
    h = h.select("page", "v", F.sum("n").over(w).alias("n0"), F.sum(F.col("n") * F.col("v")).over(w).alias("s0"), F.sum("n").over(whole).alias("n"), F.sum(F.col("n") * F.col("v")).over(whole).alias("s"))
    n1, gap = F.col("n") - F.col("n0"), F.col("s0") * F.col("n") - F.col("s") * F.col("n0")
    between = F.when(n1 > 0, gap.cast("double") * gap / (F.col("n0") * n1)).otherwise(F.lit(-1.0))
    best = h.withColumn("between", between).groupBy("page").agg(F.max_by("v", F.struct("between", (-F.col("v")).alias("low"))).alias("v"), F.max("between").alias("b"))
    return best.select("page", F.when(F.col("b") > 0, F.col("v")).otherwise(128).cast("int").alias("threshold"))


def adaptive_ink(pixels: DataFrame, radius: int = 2, c: float = 8.0, value: str = "lum") -> DataFrame:
    """``ink`` 1 where a pixel is darker than the mean of its (border-clipped) window minus ``c``; two separable passes."""
    along = Window.partitionBy("page", "y").orderBy("x").rowsBetween(-radius, radius)
    down = Window.partitionBy("page", "x").orderBy("y").rowsBetween(-radius, radius)
    rows = pixels.withColumn("_s", F.sum(F.col(value).cast("long")).over(along)).withColumn("_n", F.count("*").over(along))
    mean = F.sum("_s").over(down) / F.sum("_n").over(down)
    return rows.select("page", "y", "x", F.col(value), (F.col(value) < mean - c).cast("int").alias("ink"))


def dilate(mask: DataFrame, rx: int = 1, ry: int = 0) -> DataFrame:
    along = Window.partitionBy("page", "y").orderBy("x").rowsBetween(-rx, rx)
    down = Window.partitionBy("page", "x").orderBy("y").rowsBetween(-ry, ry)
    return mask.withColumn("_d", F.max("ink").over(along)).withColumn("ink", F.max("_d").over(down)).drop("_d")


def erode(mask: DataFrame, rx: int = 1, ry: int = 0) -> DataFrame:
    return dilate(mask.withColumn("ink", 1 - F.col("ink")), rx, ry).withColumn("ink", 1 - F.col("ink"))


def without_blobs(mask: DataFrame, radius: int = 1) -> DataFrame:
    """The mask minus its morphological opening: solid blocks go, strokes stay."""
    solid = dilate(erode(mask, radius, radius), radius, radius).select("page", "y", "x", F.col("ink").alias("_solid"))
    return mask.join(solid, ["page", "y", "x"]).withColumn("ink", F.greatest(F.col("ink") - F.col("_solid"), F.lit(0))).drop("_solid")


def laplacian_variance(pixels: DataFrame, value: str = "lum") -> DataFrame:
    """Population variance of the four-neighbour Laplacian over inner pixels, and the sharpness made from it."""
    along, down = Window.partitionBy("page", "y").orderBy("x"), Window.partitionBy("page", "x").orderBy("y")
    v = F.col(value)
    lap = F.lag(v).over(along) + F.lead(v).over(along) + F.lag(v).over(down) + F.lead(v).over(down) - 4 * v
    out = pixels.select("page", lap.alias("lap")).groupBy("page").agg(F.coalesce(F.var_pop("lap"), F.lit(0.0)).alias("variance"))
    return out.withColumn("sharpness", F.col("variance") / (F.col("variance") + 500))


def ink_ratio(mask: DataFrame) -> DataFrame:
    return mask.groupBy("page").agg(F.avg("ink").alias("ratio"))


def gray_stretch(pixels: DataFrame, low: float = 0.02, high: float = 0.98, gain: float = 1.6, value: str = "lum") -> DataFrame:
    """Contrast between two histogram percentiles stretched by at most ``gain``; flat pages (range under 8) stay."""
    w = Window.partitionBy("page").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    h = histogram(pixels, value).withColumn("below", F.sum("n").over(w)).withColumn("all", F.sum("n").over(Window.partitionBy("page")))
    ends = h.groupBy("page").agg(F.min(F.when(F.col("below") >= low * F.col("all"), F.col("v"))).alias("lo"), F.min(F.when(F.col("below") >= high * F.col("all"), F.col("v"))).alias("hi"))
    k = F.least(F.lit(gain), 255 / (F.col("hi") - F.col("lo")))
    out = F.when(F.col("hi") - F.col("lo") < 8, F.col(value)).otherwise(F.least(F.greatest(F.rint((F.col(value) - F.col("lo")) * k), F.lit(0.0)), F.lit(255.0)))
    return pixels.join(ends, "page").select("page", "y", "x", out.cast("int").alias("stretched"))


def runs(mask: DataFrame) -> DataFrame:
    """Horizontal runs [x0, x1) of ink: gaps and islands."""
    along = Window.partitionBy("page", "y").orderBy("x")
    ink = mask.where("ink = 1").withColumn("_g", F.col("x") - F.row_number().over(along))
    return ink.groupBy("page", "y", "_g").agg(F.min("x").alias("x0"), (F.max("x") + 1).alias("x1"), F.count("*").alias("ink")).drop("_g")


def row_bands(mask: DataFrame, least: int = 1) -> DataFrame:
    """Bands of neighbouring rows that hold at least ``least`` ink pixels."""
    rows = mask.groupBy("page", "y").agg(F.sum("ink").alias("ink")).where(F.col("ink") >= least)
    rows = rows.withColumn("_g", F.col("y") - F.row_number().over(Window.partitionBy("page").orderBy("y")))
    return rows.groupBy("page", "_g").agg(F.min("y").alias("y0"), (F.max("y") + 1).alias("y1"), F.sum("ink").alias("ink")).drop("_g")


def text_height(mask: DataFrame) -> DataFrame:
    """Lower median of a page's band heights."""
    return row_bands(mask).groupBy("page").agg(F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY y1 - y0)").alias("height"))


def joined_runs(rows: list[dict], reach: int) -> list[dict]:
    """Components of a page's runs (y, x0, x1, ink in reading order): two rows of runs are walked together and joined by union-find."""
    root = list(range(len(rows)))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    above = 0
    for i, r in enumerate(rows):
        while above < i and (rows[above]["y"] < r["y"] - 1 or (rows[above]["y"] == r["y"] - 1 and rows[above]["x1"] + reach <= r["x0"])):
            above += 1
        j = above
        while j < i and rows[j]["y"] == r["y"] - 1 and rows[j]["x0"] < r["x1"] + reach:
            a, b = find(i), find(j)
            root[max(a, b)] = min(a, b)
            j += 1
    found: dict[int, dict] = {}
    for i, r in enumerate(rows):
        c = found.setdefault(find(i), {"x": r["x0"], "y": r["y"], "x1": r["x1"], "ink": 0, "rows": 0, "last": None})
        c["x"], c["x1"], c["ink"] = min(c["x"], r["x0"]), max(c["x1"], r["x1"]), c["ink"] + r["ink"]
        c["rows"], c["last"] = c["rows"] + (c["last"] != r["y"]), r["y"]
    out = [{"x": c["x"], "y": c["y"], "w": c["x1"] - c["x"], "h": c["last"] - c["y"] + 1, "ink": c["ink"], "rows": c["rows"]} for c in found.values()]
    return [c | {"density": c["ink"] / (c["w"] * c["h"])} for c in out]


def components(mask: DataFrame, reach: int = 1) -> DataFrame:
    """Connected components of a mask: box, ink, rows and density, touching corners counted as connected with ``reach`` 1.

    Pixels become runs where they are; a page's runs, a small part of its pixels, then come to one place and are joined in one walk.
    """
    schema = "page long, x int, y int, w int, h int, ink long, rows long, density double"
    return per_page(runs(mask), ("y", "x0", "x1", "ink"), ("y", "x0"), lambda rows: joined_runs(rows, reach), schema)


def dominant_colour(pixels: DataFrame, step: int = 16) -> DataFrame:
    """Mean colour of the fullest colour bucket of a page, its coverage and the number of buckets; the first seen wins ties."""
    bucket = F.struct(*[F.floor(F.col(c) / step).alias(c) for c in "rgb"])
    per = pixels.groupBy("page", bucket.alias("k")).agg(F.count("*").alias("n"), F.min(F.col("y").cast("long") * (1 << 31) + F.col("x")).alias("first"), *[F.sum(c).alias(c) for c in "rgb"])
    best = per.groupBy("page").agg(F.max_by(F.struct("n", "r", "g", "b"), F.struct("n", (-F.col("first")).alias("f"))).alias("w"), F.sum("n").alias("all"), F.count("*").alias("unique"))
    return best.select("page", *[(F.col(f"w.{c}") / F.col("w.n")).alias(c) for c in "rgb"], (F.col("w.n") / F.col("all")).alias("coverage"), "unique")


def structure_rows(mask: DataFrame, width: int, share: float = 0.85, thick: int = 6) -> DataFrame:
    """Bands of at most ``thick`` rows that are almost all ink: rules and frames, not text."""
    full = mask.groupBy("page", "y").agg(F.sum("ink").alias("n")).where(F.col("n") >= share * width).withColumn("ink", F.lit(1))
    return row_bands(full).where(F.col("y1") - F.col("y0") <= thick).select("page", "y0", "y1")


def free_right(pixels: DataFrame, background: int, x1: int, share: float = 0.25, near: int = 38, value: str = "lum") -> DataFrame:
    """The first column from ``x1`` on where more than ``share`` of the pixels are not background (null: none)."""
    col = pixels.where(F.col("x") >= x1).groupBy("page", "x").agg(F.avg((F.abs(F.col(value) - background) > near).cast("int")).alias("busy"))
    return col.groupBy("page").agg(F.min(F.when(F.col("busy") > share, F.col("x"))).alias("blocked_at"))


def inverted(pixels: DataFrame, value: str = "lum") -> DataFrame:
    return pixels.withColumn(value, 255 - F.col(value))


def downscale(pixels: DataFrame, k: int = 2, value: str = "lum") -> DataFrame:
    """Area average of k x k pixels, rounded half to even."""
    return pixels.groupBy("page", F.floor(F.col("y") / k).cast("int").alias("y"), F.floor(F.col("x") / k).cast("int").alias("x")).agg(F.rint(F.avg(value)).cast("int").alias("lum"))


def _held(value, radius: int, along, size, at):
    """Sum over ``2 radius + 1`` neighbours, pixels beyond an edge standing in as the edge's own value."""
    whole = along.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before, after = F.greatest(radius - at, F.lit(0)), F.greatest(radius - (size - 1 - at), F.lit(0))
    return F.sum(value).over(along.rowsBetween(-radius, radius)) + before * F.first(value).over(whole) + after * F.last(value).over(whole)


def box_blur(pixels: DataFrame, radius: int = 1, passes: int = 1, value: str = "lum") -> DataFrame:
    """``blur``: the mean of a square window, edges replicated; two separable sums a pass."""
    along, down = Window.partitionBy("page", "y").orderBy("x"), Window.partitionBy("page", "x").orderBy("y")
    out = pixels.withColumn("blur", F.col(value).cast("double")).withColumn("_w", F.count("*").over(Window.partitionBy("page", "y"))).withColumn("_h", F.count("*").over(Window.partitionBy("page", "x")))
    for _ in range(passes if radius > 0 else 0):
        out = out.withColumn("_s", _held(F.col("blur"), radius, along, F.col("_w"), F.col("x")))
        out = out.withColumn("blur", _held(F.col("_s"), radius, down, F.col("_h"), F.col("y")) / (2 * radius + 1) ** 2)
    return out.drop("_w", "_h", "_s")


def unsharp(pixels: DataFrame, amount, radius: int = 2, threshold: float = 0.0, value: str = "lum") -> DataFrame:
    """``sharp``: the value pushed away from its blur by ``amount`` (a number or a column), differences under ``threshold`` left alone."""
    diff = F.col(value) - F.col("blur")
    pushed = F.least(F.greatest(F.rint(F.col(value) + amount * diff), F.lit(0.0)), F.lit(255.0)).cast("int")
    return box_blur(pixels, radius, value=value).withColumn("sharp", F.when(F.abs(diff) < threshold, F.col(value)).otherwise(pushed)).drop("blur")


def sharpening(pixels: DataFrame, value: str = "lum") -> DataFrame:
    """How strongly a page is sharpened before it is read: more, the less sharp it is."""
    s = F.col("sharpness")
    return laplacian_variance(pixels, value).select("page", F.when(s < 0.35, 0.9).when(s < 0.6, 0.6).otherwise(0.3).alias("amount"))


def detection_ink(pixels: DataFrame, fine: int = 7, coarse: int = 22, c: float = 10.0, dark: float = 0.6, value: str = "lum") -> DataFrame:
    """Ink of a fine or a coarse adaptive threshold, on pages turned to dark on light first.

    A page is turned when more than ``dark`` of every fourth pixel is at or under its global threshold.
    """
    width = F.count("*").over(Window.partitionBy("page", "y"))
    marked = pixels.select("page", "y", "x", F.col(value).alias("lum"), width.alias("_w")).join(otsu(pixels, value), "page")
    sampled = F.when((F.col("y") * F.col("_w") + F.col("x")) % 4 == 0, (F.col("lum") <= F.col("threshold")).cast("int"))
    share = F.avg(sampled).over(Window.partitionBy("page"))
    even = marked.withColumn("_d", share).select("page", "y", "x", F.when(F.col("_d") > dark, 255 - F.col("lum")).otherwise(F.col("lum")).alias("lum"))
    mean = {}
    for name, r in (("f", fine), ("g", coarse)):
        along = Window.partitionBy("page", "y").orderBy("x").rowsBetween(-r, r)
        even = even.withColumn(f"_{name}s", F.sum(F.col("lum").cast("long")).over(along)).withColumn(f"_{name}n", F.count("*").over(along))
        down = Window.partitionBy("page", "x").orderBy("y").rowsBetween(-r, r)
        mean[name] = F.sum(f"_{name}s").over(down) / F.sum(f"_{name}n").over(down)
    return even.select("page", "y", "x", ((F.col("lum") < mean["f"] - c) | (F.col("lum") < mean["g"] - c)).cast("int").alias("ink"))


def _upper_median(of):
    values = F.array_sort(F.collect_list(of))
    return F.get(values, F.floor(F.size(values) / 2).cast("int"))


def median_colour(pixels: DataFrame) -> DataFrame:
    """Upper median of each channel of a page and the mean absolute distance from it.

    Two sums over counted shades a channel, so a page's pixels never meet in one list.
    """
    long = pixels.select("page", F.explode(F.array(*[F.struct(F.lit(c).alias("c"), F.col(c).cast("int").alias("v")) for c in "rgb"])).alias("p")).select("page", "p.c", "p.v")
    shades = long.groupBy("page", "c", "v").agg(F.count("*").alias("n"))
    by = Window.partitionBy("page", "c")
    shades = shades.withColumn("_b", F.sum("n").over(by.orderBy("v"))).withColumn("_n", F.sum("n").over(by))
    shades = shades.withColumn("m", F.min(F.when(F.col("_b") > F.floor(F.col("_n") / 2), F.col("v"))).over(by))
    out = shades.groupBy("page").agg(*[F.max(F.when(F.col("c") == c, F.col("m"))).alias(c) for c in "rgb"], F.sum(F.col("n") * F.abs(F.col("v") - F.col("m"))).alias("_d"), F.sum("n").alias("_n"), F.max("_n").alias("_one"))
    return out.select("page", "r", "g", "b", F.when(F.col("_one") < 2, 0.0).otherwise(F.col("_d") / F.col("_n")).alias("spread"))


def ring(pixels: DataFrame, box: tuple[int, int, int, int], width: int = 2) -> DataFrame:
    """Pixels outside a box (x, y, w, h) and at most ``width`` from it in either direction."""
    x, y, w, h = box
    inside = F.col("x").between(x, x + w - 1) & F.col("y").between(y, y + h - 1)
    return pixels.where(F.col("x").between(x - width, x + w - 1 + width) & F.col("y").between(y - width, y + h - 1 + width) & ~inside)


def measure_ink(pixels: DataFrame, contrast: float = 38.0) -> DataFrame:
    """What is written on each page: ink box, lines and their height, density, background, alignment.

    ``pixels`` (page, y, x, r, g, b) counts its page from 0. The background is the median shade; ink differs from it by more than
    ``contrast``. A single band of 10 rows or more is taken for several lines. Pages without ink give no row.
    """
    lum = 0.299 * F.col("r") + 0.587 * F.col("g") + 0.114 * F.col("b")
    shade = F.least(F.greatest(F.floor(lum), F.lit(0)), F.lit(255)).cast("int")
    p = pixels.select("page", "y", "x", lum.alias("lum"), shade.alias("shade"))
    by = Window.partitionBy("page")
    h = histogram(p, "shade").withColumn("_b", F.sum("n").over(by.orderBy("v"))).withColumn("_n", F.sum("n").over(by))
    page = h.groupBy("page").agg(F.min(F.when(F.col("_b") >= F.col("_n") / 2, F.col("v"))).alias("background"))
    size = p.groupBy("page").agg((F.max("x") + 1).alias("box_w"), (F.max("y") + 1).alias("box_h"))
    page = page.join(size, "page").where("box_w >= 3 AND box_h >= 3")
    rows = p.join(page, "page").where(F.abs(F.col("lum") - F.col("background")) > contrast).groupBy("page", "y").agg(F.count("*").alias("ink"), F.min("x").alias("x0"), F.max("x").alias("x1"))
    rows = rows.withColumn("_g", F.col("y") - F.row_number().over(by.orderBy("y")))
    runs_ = rows.groupBy("page", "_g").agg(F.min("y").alias("y0"), (F.max("y") + 1).alias("y1"), F.min("x0").alias("x0"), F.max("x1").alias("x1"), F.sum("ink").alias("ink"))
    tall = F.col("y1") - F.col("y0") >= 2
    of = lambda v: F.when(tall, v)
    wide = lambda v: F.max(of(v)) - F.min(of(v))
    ink = runs_.groupBy("page").agg(
        F.min("x0").alias("x"), F.min("y0").alias("y"), (F.max("x1") - F.min("x0") + 1).alias("w"), (F.max("y1") - F.min("y0")).alias("h"), F.max("x1").alias("_r"), F.sum("ink").alias("_ink"),
        F.count(of(F.lit(1))).alias("bands"), _upper_median(of(F.col("y1") - F.col("y0"))).alias("_m"),
        wide(F.col("x0")).alias("_sl"), wide(F.col("x1")).alias("_sr"), wide((F.col("x0") + F.col("x1")) / 2).alias("_sc"),
    ).join(page, "page")
    lone = (F.col("bands") == 1) & (F.col("_m") >= 10)
    guess = F.greatest(F.lit(9), F.least(F.lit(28), F.floor(F.col("_m") * 0.38 + 0.5)))
    several = F.greatest(F.lit(2), F.floor(F.col("_m") / guess + 0.5))
    near, left, right = F.greatest(F.lit(3.0), F.col("w") * 0.12), F.col("x"), F.col("box_w") - 1 - F.col("_r")
    rowed = F.when((F.col("_sc") <= near) & (F.col("_sc") < F.col("_sl")) & (F.col("_sc") < F.col("_sr")), "center").when((F.col("_sr") <= near) & (F.col("_sr") < F.col("_sl")), "right").otherwise("left")
    loose = F.least(left, right) >= F.greatest(F.lit(4.0), F.col("box_w") * 0.08)
    single = F.when(loose & (F.abs(left - right) <= F.greatest(F.lit(6.0), F.col("box_w") * 0.12)), "center").when(loose & (left > right * 1.8), "right").otherwise("left")
    return ink.select(
        "page", "x", "y", "w", "h", F.when(F.col("bands") > 1, F.col("bands")).when(lone, several).otherwise(1).cast("int").alias("line_count"),
        F.when(F.col("bands") > 1, F.col("_m").cast("double")).when(lone, F.col("_m") / several).otherwise(F.col("h").cast("double")).alias("line_height"),
        F.when(F.col("bands") >= 2, rowed).otherwise(single).alias("alignment"), (F.col("_ink") / (F.col("w") * F.col("h"))).alias("density"), "background", (F.col("background") < 95).alias("dark"),
    )
