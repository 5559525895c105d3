"""Box geometry and reading order as columns. Boxes are ``x1, y1, x2, y2`` in pixels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import DetectorConfig
from ..functions.spans import bind

CONFIG = DetectorConfig()


def letterbox(w: Column, h: Column, size: int = CONFIG.size) -> Column:
    """Scale, inner size and offsets of an image fitted into a square. Halves round to even."""
    scale = F.least(F.lit(float(size)) / w, F.lit(float(size)) / h)
    side = lambda x: F.greatest(F.lit(1), F.bround(x * scale, 0).cast("int"))
    return F.struct(scale.alias("scale"), side(w).alias("w"), side(h).alias("h"), F.floor((size - side(w)) / 2).cast("int").alias("dx"), F.floor((size - side(h)) / 2).cast("int").alias("dy"))


def best_class(scores: Column, names: tuple[str, ...] = CONFIG.classes) -> Column:
    """Class and confidence of a detector row's scores; of equal scores the first."""
    conf = F.array_max(scores)
    return F.struct(F.get(F.array(*map(F.lit, names)), F.array_position(scores, conf).cast("int") - 1).alias("cls"), conf.alias("conf"))


def unletterboxed(cx: Column, cy: Column, w: Column, h: Column, box: Column) -> Column:
    """A detector row's box in the image's own pixels."""
    place = lambda c, half, d: (c + half - box[d]) / box["scale"]
    return F.struct(place(cx, -w / 2, "dx").alias("x1"), place(cy, -h / 2, "dy").alias("y1"), place(cx, w / 2, "dx").alias("x2"), place(cy, h / 2, "dy").alias("y2"))


def detected(raw: DataFrame, key: str = "image_id", config: DetectorConfig = CONFIG) -> DataFrame:
    """Detector rows ``key, w, h, cx, cy, bw, bh, scores`` as boxes with class and confidence; weak ones go first."""
    return (
        raw.withColumn("c", best_class(F.col("scores"), config.classes)).where(F.col("c.conf") >= config.confidence).withColumn("l", letterbox(F.col("w"), F.col("h"), config.size))
        .withColumn("b", unletterboxed(F.col("cx"), F.col("cy"), F.col("bw"), F.col("bh"), F.col("l"))).select(key, "c.cls", "b.x1", "b.y1", "b.x2", "b.y2", "c.conf")
    )


def overlap(a: Column, b: Column) -> Column:
    """Intersection over union of two boxes."""
    inter = F.greatest(F.lit(0.0), F.least(a["x2"], b["x2"]) - F.greatest(a["x1"], b["x1"])) * F.greatest(F.lit(0.0), F.least(a["y2"], b["y2"]) - F.greatest(a["y1"], b["y1"]))
    area = lambda x: (x["x2"] - x["x1"]) * (x["y2"] - x["y1"])
    return inter / (area(a) + area(b) - inter + 1e-9)


def suppressed(detections: DataFrame, key: str = "image_id", iou: float = CONFIG.iou) -> DataFrame:
    """Of each image and class, the boxes that overlap no surer kept one by ``iou`` or more.

    The fold is over one image's boxes of one class, which a detector bounds by its number of rows.
    """
    box = F.struct((-F.col("conf")).alias("order"), F.col("x1").cast("double").alias("x1"), F.col("y1").cast("double").alias("y1"), F.col("x2").cast("double").alias("x2"), F.col("y2").cast("double").alias("y2"))
    grouped = detections.groupBy(key, "cls").agg(F.array_sort(F.collect_list(box)).alias("boxes"))
    none = F.array().cast("array<struct<order:double,x1:double,y1:double,x2:double,y2:double>>")
    kept = F.aggregate(F.col("boxes"), none, lambda acc, b: F.when(F.exists(acc, lambda k: overlap(k, b) >= iou), acc).otherwise(F.concat(acc, F.array(b))))
    return grouped.select(key, "cls", F.explode(kept).alias("b")).select(key, "cls", "b.x1", "b.y1", "b.x2", "b.y2", (-F.col("b.order")).alias("conf"))


def around_all(boxes: DataFrame, key: str = "image_id") -> DataFrame:
    """One box around all of an image's boxes."""
    return boxes.groupBy(key).agg(F.min("x1").alias("x1"), F.min("y1").alias("y1"), F.max("x2").alias("x2"), F.max("y2").alias("y2"))


def padded_box(x1: Column, y1: Column, x2: Column, y2: Column, w: Column, h: Column, pad: float = CONFIG.pad, least: int = CONFIG.least_pad_px) -> Column:
    """A box grown by a share of its sides, at least ``least`` pixels, cut to whole pixels and then to the image."""
    px, py = F.greatest((x2 - x1) * pad, F.lit(float(least))), F.greatest((y2 - y1) * pad, F.lit(float(least)))
    return F.struct(
        F.greatest(F.lit(0), (x1 - px).cast("int")).alias("x1"), F.greatest(F.lit(0), (y1 - py).cast("int")).alias("y1"), F.least(w.cast("int"), (x2 + px).cast("int")).alias("x2"), F.least(h.cast("int"), (y2 + py).cast("int")).alias("y2"),
    )


def has_area(box: Column) -> Column:
    return (box["x2"] > box["x1"]) & (box["y2"] > box["y1"])


def crop_size(w: Column, h: Column, target: int = CONFIG.upscale_height, longest: int = CONFIG.longest_crop_side) -> Column:
    """Width and height of a crop after the cap on its longer side, the upscale of low ones, and the cap again."""

    def capped(s: Column) -> Column:
        longer = F.greatest(s["w"], s["h"])
        k = F.lit(float(longest)) / longer
        return F.when((longer > longest) & (s["h"] > 0), F.struct(F.greatest(F.lit(1), (s["w"] * k).cast("int")).alias("w"), F.greatest(F.lit(1), (s["h"] * k).cast("int")).alias("h"))).otherwise(s)

    def raised(s: Column) -> Column:
        k = F.lit(float(target)) / s["h"]
        return F.when((s["h"] >= target) | (s["h"] == 0), s).otherwise(bind(F.struct((s["w"] * k).cast("int").alias("w"), (s["h"] * k).cast("int").alias("h")), capped))

    return bind(bind(F.struct(w.cast("int").alias("w"), h.cast("int").alias("h")), capped), raised)


def shrunk_size(w: Column, h: Column, longest: int = CONFIG.full_image_side) -> Column:
    """Width and height of a whole image with its longer side cut to ``longest``; never enlarged."""
    k = F.lit(float(longest)) / F.greatest(w, h)
    side = lambda x: F.when(k < 1, F.bround(x * k, 0)).otherwise(x).cast("int")
    return F.struct(side(w).alias("w"), side(h).alias("h"))


def reading_order(items: Column, tolerance: float = CONFIG.line_tolerance) -> Column:
    """Texts of recognized items in reading order, joined by spaces.

    ``items``: ``array<struct<text, box: array<array<double>>>>`` with four corners each. From top to bottom an item joins
    the current line if its centre is within ``tolerance`` of the mean height of the line's running centre; lines read
    from the left.
    """
    placed = F.transform(items, lambda it, i: F.struct(
        ((it["box"][0][1] + it["box"][2][1]) / 2).alias("yc"), i.alias("i"), it["box"][0][0].alias("x"), F.greatest(F.lit(1.0), it["box"][2][1] - it["box"][0][1]).alias("high"), it["text"].alias("text"),
    ))
    tol = tolerance * F.aggregate(placed, F.lit(0.0), lambda acc, p: acc + p["high"]) / F.size(placed)
    start = F.struct(F.lit(0).alias("line"), F.lit(None).cast("double").alias("centre"), F.array().cast("array<struct<line:int,x:double,i:int,text:string>>").alias("out"))

    def step(acc: Column, p: Column) -> Column:
        same = acc["centre"].isNull() | (F.abs(p["yc"] - acc["centre"]) <= tol)
        line = F.when(same, acc["line"]).otherwise(acc["line"] + 1)
        centre = F.when(acc["centre"].isNotNull() & same, (acc["centre"] + p["yc"]) / 2).otherwise(p["yc"])
        return F.struct(line.alias("line"), centre.alias("centre"), F.concat(acc["out"], F.array(F.struct(line.alias("line"), p["x"].alias("x"), p["i"].alias("i"), p["text"].alias("text")))).alias("out"))

    # Items of one line and place keep the order from top to bottom, which is that of the fold.
    def numbered(done: Column) -> Column:
        return F.array_sort(F.transform(done, lambda o, n: F.struct(o["line"].alias("line"), o["x"].alias("x"), n.alias("n"), o["text"].alias("text"))))

    lines = F.aggregate(F.array_sort(placed), start, step, lambda acc: acc["out"])
    return F.when(F.size(items) > 0, F.array_join(F.transform(numbered(lines), lambda o: o["text"]), " ")).otherwise(F.lit(""))


def normalized_box(x1: Column, y1: Column, x2: Column, y2: Column, w: Column, h: Column) -> Column:
    """Centre and size as shares of the image, cut to it; null where nothing is left."""
    a, b = F.least(F.greatest(x1, F.lit(0.0)), w), F.least(F.greatest(y1, F.lit(0.0)), h)
    c, d = F.least(F.greatest(x2, F.lit(0.0)), w), F.least(F.greatest(y2, F.lit(0.0)), h)
    return F.when((c > a) & (d > b), F.struct(((a + c) / 2 / w).alias("cx"), ((b + d) / 2 / h).alias("cy"), ((c - a) / w).alias("bw"), ((d - b) / h).alias("bh")))


def detector_line(cls: Column, box: Column) -> Column:
    """A line of a detector's label file: class, centre and size with six decimals."""
    return F.when(box.isNotNull(), F.format_string("%d %.6f %.6f %.6f %.6f", cls.cast("int"), box["cx"], box["cy"], box["bw"], box["bh"]))


def hash_bits(pixels: Column) -> Column:
    """Average hash of grey values: four 64-bit words, bit ``k`` of the whole set if value ``k`` is above the mean."""
    mean = lambda p: F.aggregate(p, F.lit(0.0), lambda acc, x: acc + x) / F.size(p)
    word = lambda p, m, j: F.aggregate(F.sequence(F.lit(0), F.lit(63)), F.lit(0).cast("bigint"), lambda acc, k: acc.bitwiseOR(F.when(F.get(p, k + 64 * j) > m, F.call_function("shiftleft", F.lit(1).cast("bigint"), k)).otherwise(F.lit(0).cast("bigint"))))
    return bind(pixels, lambda p: bind(mean(p), lambda m: F.array(*[word(p, m, j) for j in range(4)])))


def hamming(a: Column, b: Column) -> Column:
    """Differing bits of two arrays of words."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda acc, n: acc + n)
