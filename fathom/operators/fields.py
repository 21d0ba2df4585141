"""Images as arrays of pixels, row by row: arithmetic, masks, statistics and geometry as Column expressions, and
operators on their long form (image, y, x, value). Nothing here leaves the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TINY = 1e-10  # an image divided by less than this is 0


def constant(a: Column, op: str, value: float) -> Column:
    """add, subtract, multiply or divide every pixel."""
    steps = {"add": lambda v: v + value, "subtract": lambda v: v - value, "multiply": lambda v: v * value, "divide": lambda v: v / value}
    return F.transform(a, steps[op])


def clipped(a: Column, low: float | None = None, high: float | None = None) -> Column:
    """Pixels below low become low, those above high become high."""

    def one(v: Column) -> Column:
        v = v if low is None else F.greatest(v, F.lit(float(low)))
        return v if high is None else F.least(v, F.lit(float(high)))

    return F.transform(a, one)


def without_nan(a: Column, value: float = 0.0) -> Column:
    return F.transform(a, lambda v: F.when(v.isNull() | F.isnan(v), F.lit(value)).otherwise(v))


def combined(a: Column, b: Column, op: str) -> Column:
    """Pixel by pixel add, subtract, multiply or divide; a division by nearly 0 gives 0."""
    steps = {
        "add": lambda x, y: x + y,
        "subtract": lambda x, y: x - y,
        "multiply": lambda x, y: x * y,
        "divide": lambda x, y: F.when(F.abs(y) < TINY, F.lit(0.0)).otherwise(F.try_divide(x, y)),
    }
    return F.zip_with(a, b, steps[op])


def best_scale(a: Column, b: Column) -> Column:
    """The factor by which b comes nearest to a, 0 where b has no power."""
    top = F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)
    low = F.aggregate(F.transform(b, lambda y: y * y), F.lit(0.0), lambda s, v: s + v)
    return F.coalesce(F.try_divide(top, low), F.lit(0.0))


def scaled_difference(a: Column, b: Column) -> Column:
    """a less b at the scale that fits best."""
    s = best_scale(a, b)
    return F.zip_with(a, b, lambda x, y: x - s * y)


def mean(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, v: s + v) / F.size(a)


def deviation(a: Column) -> Column:
    """Population standard deviation."""
    m = mean(a)
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, v: s + (v - m) * (v - m)) / F.size(a))


def median(a: Column) -> Column:
    """The middle value, or the mean of the two middle ones."""
    s, n = F.array_sort(a), F.size(a)
    return (F.get(s, F.expr("0").cast("int") + F.floor((n - 1) / 2).cast("int")) + F.get(s, F.floor(n / 2).cast("int"))) / 2


def first_max(a: Column) -> Column:
    """Index from 0 of the first largest pixel."""
    return F.array_position(a, F.array_max(a)) - 1


def first_min(a: Column) -> Column:
    return F.array_position(a, F.array_min(a)) - 1


def _moved(a: Column, n: int, place) -> Column:
    """n pixels, each from the index that place gives for its own, or null."""
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.get(a, place(i).cast("int")))


def flip_x(a: Column, ny: int, nx: int) -> Column:
    return _moved(a, ny * nx, lambda i: i - 2 * (i % nx) + (nx - 1))


def flip_y(a: Column, ny: int, nx: int) -> Column:
    return _moved(a, ny * nx, lambda i: (ny - 1 - F.floor(i / nx)) * nx + i % nx)


def transposed(a: Column, ny: int, nx: int) -> Column:
    return _moved(a, ny * nx, lambda i: (i % ny) * nx + F.floor(i / ny))


def window(a: Column, ny: int, nx: int, y0: int, x0: int, h: int, w: int, outside: float = 0.0) -> Column:
    """h x w pixels from (y0, x0) on; those beyond the edge get the value for outside."""

    def one(i: Column) -> Column:
        y, x = F.floor(i / w) + y0, i % w + x0
        return F.when((y >= 0) & (y < ny) & (x >= 0) & (x < nx), F.get(a, (y * nx + x).cast("int"))).otherwise(F.lit(outside))

    return F.transform(F.sequence(F.lit(0), F.lit(h * w - 1)), one)


def binned(a: Column, ny: int, nx: int, b: int) -> Column:
    """Means of b x b blocks; what does not fill a block at the right and lower edge goes."""
    w = nx // b

    def one(i: Column) -> Column:
        y, x = F.floor(i / w) * b, (i % w) * b
        total = sum((F.get(a, ((y + p) * nx + x + q).cast("int")) for p in range(b) for q in range(b)), F.lit(0.0))
        return total / (b * b)

    return F.transform(F.sequence(F.lit(0), F.lit((ny // b) * w - 1)), one)


def binary(a: Column, threshold: float) -> Column:
    """1 where a pixel reaches the threshold, else 0."""
    return F.transform(a, lambda v: (v >= threshold).cast("double"))


def mask_logic(a: Column, b: Column, op: str) -> Column:
    """Masks of 0 and 1 joined by and, or, and_not or or_not (not is of b)."""
    steps = {"and": lambda x, y: x * y, "or": lambda x, y: F.greatest(x, y), "and_not": lambda x, y: x * (1 - y), "or_not": lambda x, y: F.greatest(x, 1 - y)}
    return F.zip_with(a, b, steps[op])


def inverted(a: Column) -> Column:
    """A mask's complement."""
    return F.transform(a, lambda v: 1 - v)


def long_form(df: DataFrame, image: str, pixels: str, nx: int) -> DataFrame:
    """(image, y, x, v) of every pixel."""
    e = df.select(image, F.posexplode(pixels).alias("__i", "__v"))
    return e.select(image, F.floor(F.col("__i") / nx).cast("int").alias("y"), (F.col("__i") % nx).cast("int").alias("x"), F.col("__v").cast("double").alias("v"))


def average_image(df: DataFrame, pixels: str, *groups: str) -> DataFrame:
    """(i, mean, sigma) of each place over all images of a table, or of each group: partial sums meet, not images."""
    e = df.select(*groups, F.posexplode(pixels).alias("i", "__v"))
    return e.groupBy(*groups, "i").agg(F.avg("__v").alias("mean"), F.stddev_pop("__v").alias("sigma"))


def box_extrema(pixels: DataFrame, image: str, reach: int, largest: bool = True) -> DataFrame:
    """Pixels of a long table that no other in the square of the given reach exceeds, with what the square holds as "box".

    The square is judged along rows, then along columns, so that a pixel is compared 2 (2 reach + 1) times only.
    """
    best = F.max if largest else F.min
    row = Window.partitionBy(image, "y").orderBy("x").rangeBetween(-reach, reach)
    column = Window.partitionBy(image, "x").orderBy("y").rangeBetween(-reach, reach)
    return pixels.withColumn("box", best("v").over(row)).withColumn("box", best("box").over(column)).where("v = box")


def soft_mask(r: Column, radius: float, width: float) -> Column:
    """1 within the radius, 0 beyond radius + width, a raised cosine between."""
    import math

    return F.when(r < radius, 1.0).when(r > radius + width, 0.0).otherwise(0.5 - 0.5 * F.cos(math.pi * (radius + width - r) / width))


def masked(pixels: DataFrame, image: str, centre: tuple[float, float], radius: float, width: float) -> DataFrame:
    """A long table with what is outside a soft disc replaced by its own weighted mean."""
    m = soft_mask(F.sqrt(F.pow(F.col("y") - centre[0], F.lit(2.0)) + F.pow(F.col("x") - centre[1], F.lit(2.0))), radius, width)
    p = pixels.withColumn("__m", m)
    back = F.sum(F.col("v") * (1 - F.col("__m"))).over(Window.partitionBy(image)) / F.sum(1 - F.col("__m")).over(Window.partitionBy(image))
    return p.withColumn("v", F.col("__m") * F.col("v") + (1 - F.col("__m")) * back).drop("__m")


def normalised(pixels: DataFrame, image: str, centre: tuple[float, float], radius: float) -> DataFrame:
    """A long table whose background, farther than the radius from the centre, has mean 0 and deviation 1."""
    out = F.pow(F.col("y") - centre[0], F.lit(2.0)) + F.pow(F.col("x") - centre[1], F.lit(2.0)) > radius * radius
    w = Window.partitionBy(image)
    back = F.when(out, F.col("v"))
    sd = F.stddev_pop(back).over(w)
    return pixels.withColumn("v", (F.col("v") - F.avg(back).over(w)) / F.when(sd > 0, sd).otherwise(1.0))


def without_dust(pixels: DataFrame, image: str, white: float, black: float) -> DataFrame:
    """Pixels of a long table farther than so many deviations above or below the mean become the mean."""
    w = Window.partitionBy(image)
    p = pixels.withColumn("__m", F.avg("v").over(w)).withColumn("__s", F.stddev_pop("v").over(w))
    far = (F.col("v") - F.col("__m") > white * F.col("__s")) | (F.col("__m") - F.col("v") > black * F.col("__s"))
    return p.withColumn("v", F.when(far, F.col("__m")).otherwise(F.col("v"))).drop("__m", "__s")


def shells_of(coefficients: DataFrame, shell: Column, a: tuple[str, str], b: tuple[str, str], *groups: str) -> DataFrame:
    """Amplitude correlation (1 where a side is constant), phase residual in degrees weighted by amplitude, and mean cosine
    of the phase difference of two sets of complex coefficients in each shell."""
    (ar, ai), (br, bi) = a, b
    one, two = (F.sqrt(F.col(r) * F.col(r) + F.col(i) * F.col(i)) for r, i in (a, b))
    turn = F.atan2(ai, ar) - F.atan2(bi, br)
    turn = F.when(turn > F.pi(), turn - 2 * F.pi()).when(turn < -F.pi(), turn + 2 * F.pi()).otherwise(turn)
    c = coefficients.select(*groups, shell.alias("shell"), one.alias("p"), two.alias("q"), turn.alias("t"))
    flat = (F.var_pop("p") < 1e-20) | (F.var_pop("q") < 1e-20)
    return c.groupBy(*groups, "shell").agg(
        F.when(flat, 1.0).otherwise(F.corr("p", "q")).alias("amplitude"),
        F.degrees(F.sqrt(F.try_divide(F.sum(F.col("t") * F.col("t") * (F.col("p") + F.col("q"))), F.sum(F.col("p") + F.col("q"))))).alias("residual"),
        F.avg(F.cos("t")).alias("cosine"),
    )


def residual_divergence(residuals: DataFrame, value: str, bins: int = 101, reach: float = 10.0) -> DataFrame:
    """Kullback-Leibler divergence of a histogram of standardised residuals, within +-reach, from a normal distribution.

    The histogram's and the normal's weights are taken at the bins' centres and add up to 1; empty bins do not count.
    """
    step = 2 * reach / (bins - 1)
    at = F.greatest(F.lit(0), F.least(F.lit(bins - 1), F.round((F.col(value) + reach) / step).cast("int")))
    h = residuals.where(F.col(value).isNotNull()).groupBy(at.alias("bin")).agg(F.count("*").alias("n"))
    x = F.col("bin") * step - reach
    import math

    normal = [math.exp(-((k * step - reach) ** 2) / 2) for k in range(bins)]
    q = F.exp(-x * x / 2) / sum(normal)
    total = h.agg(F.sum("n").alias("total"))  # one row
    p = F.col("n") / F.col("total")
    return h.crossJoin(F.broadcast(total)).agg(F.sum(p * F.log(p / F.greatest(q, F.lit(1e-300)))).alias("divergence"))


def gain(frames: DataFrame, pixels: str, inverse: bool = True) -> DataFrame:
    """(i, gain): the sum of all frames at each place relative to its mean, or the inverse of that (1 where nothing arrived)."""
    s = frames.select(F.posexplode(pixels).alias("i", "__v")).groupBy("i").agg(F.sum("__v").alias("s"))
    m = s.agg(F.avg("s").alias("m"))  # one row
    share = F.col("s") / F.col("m")
    return s.crossJoin(F.broadcast(m)).select("i", (F.when(share == 0, 1.0).otherwise(1 / share) if inverse else share).alias("gain"))


def binary_patterns(a: Column, ny: int, nx: int) -> Column:
    """For each inner pixel, row by row, the number whose bits say which of its eight neighbours, from the upper left clockwise,
    are no smaller."""
    around = [-nx - 1, -nx, -nx + 1, 1, nx + 1, nx, nx - 1, -1]

    def one(k: Column) -> Column:
        i = (F.floor(k / (nx - 2)) + 1) * nx + k % (nx - 2) + 1
        return sum(((F.get(a, (i + d).cast("int")) >= F.get(a, i.cast("int"))).cast("int") * (1 << n) for n, d in enumerate(around)), F.lit(0))

    return F.transform(F.sequence(F.lit(0), F.lit((ny - 2) * (nx - 2) - 1)), one)


def texture(pixels: DataFrame, image: str, levels: int) -> DataFrame:
    """Contrast, energy, homogeneity and entropy of how grey levels of each image's pixels and their right neighbours go together."""
    w = Window.partitionBy(image)
    span = F.max("v").over(w) - F.min("v").over(w)
    level = F.least(F.lit(levels - 1), F.floor(F.coalesce(F.try_divide(F.col("v") - F.min("v").over(w), span), F.lit(0.0)) * levels)).cast("int")
    p = pixels.withColumn("__l", level).withColumn("__r", F.lead("__l").over(Window.partitionBy(image, "y").orderBy("x"))).where("__r is not null")
    g = p.groupBy(image, "__l", "__r").agg(F.count("*").alias("__n"))
    share = F.col("__n") / F.sum("__n").over(Window.partitionBy(image))
    g = g.withColumn("__p", share).withColumn("__d", F.col("__l") - F.col("__r"))
    return g.groupBy(image).agg(
        F.sum(F.col("__p") * F.col("__d") * F.col("__d")).alias("contrast"), F.sum(F.col("__p") * F.col("__p")).alias("energy"),
        F.sum(F.col("__p") / (1 + F.abs("__d"))).alias("homogeneity"), F.sum(-F.col("__p") * F.log("__p")).alias("entropy"),
    )


def tapered(pixels: DataFrame, ny: int, nx: int, width: int) -> DataFrame:
    """A long table of images that fall off to their edges over so many pixels by a raised cosine."""
    import math

    d = F.least(F.col("y"), F.col("x"), ny - 1 - F.col("y"), nx - 1 - F.col("x"))
    return pixels.withColumn("v", F.when(d >= width, F.col("v")).otherwise(F.col("v") * (0.5 - 0.5 * F.cos(math.pi * (d + 1) / (width + 1)))))


def ring_histogram(pixels: DataFrame, image: str, centre: tuple[float, float], low: float, width: float) -> DataFrame:
    """(image, ring, bin, n) of the values in each ring of rounded radius."""
    ring = F.round(F.sqrt(F.pow(F.col("y") - centre[0], F.lit(2.0)) + F.pow(F.col("x") - centre[1], F.lit(2.0)))).cast("int")
    return pixels.groupBy(image, ring.alias("ring"), F.floor((F.col("v") - low) / width).cast("int").alias("bin")).agg(F.count("*").alias("n"))


def wrapped_peak(a: Column, ny: int, nx: int) -> tuple[Column, Column]:
    """(dy, dx) of the first largest pixel of a correlation map, the far half of each axis counted as negative."""
    i = first_max(a)
    y, x = F.floor(i / nx).cast("int"), (i % nx).cast("int")
    return F.when(y > ny // 2, y - ny).otherwise(y), F.when(x > nx // 2, x - nx).otherwise(x)


def structure_tensor(pixels: DataFrame, image: str) -> DataFrame:
    """(image, y, x, xx, xy, yy): products of central differences at the inner pixels of a long table."""
    row, column = Window.partitionBy(image, "y").orderBy("x"), Window.partitionBy(image, "x").orderBy("y")
    p = pixels.withColumn("__gx", (F.lead("v").over(row) - F.lag("v").over(row)) / 2).withColumn("__gy", (F.lead("v").over(column) - F.lag("v").over(column)) / 2)
    gx, gy = F.col("__gx"), F.col("__gy")
    return p.where(gx.isNotNull() & gy.isNotNull()).select(image, "y", "x", (gx * gx).alias("xx"), (gx * gy).alias("xy"), (gy * gy).alias("yy"))


def window_3d(a: Column, n: int, z0: Column, y0: Column, x0: Column, size: int, outside: float = 0.0) -> Column:
    """size^3 voxels of a cube of n^3 from (z0, y0, x0) on; those beyond the edge get the value for outside."""

    def one(i: Column) -> Column:
        z, y, x = F.floor(i / (size * size)) + z0, F.floor(i / size) % size + y0, i % size + x0
        inside = (z >= 0) & (z < n) & (y >= 0) & (y < n) & (x >= 0) & (x < n)
        return F.when(inside, F.get(a, ((z * n + y) * n + x).cast("int"))).otherwise(F.lit(outside))

    return F.transform(F.sequence(F.lit(0), F.lit(size**3 - 1)), one)
