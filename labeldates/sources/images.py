"""Image folders as tables of paths and bytes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.textnorm import file_stem, padded

BATCH_SUFFIXES = ("jpg", "jpeg", "png", "bmp", "webp")
COMMAND_SUFFIXES = ("jpg", "jpeg", "png")
COLLECTION_SUFFIXES = ("jpg", "jpeg", "png", "heic", "heif", "webp", "bmp", "tif", "tiff")


def _glob(suffixes: tuple[str, ...]) -> str:
    any_case = lambda s: "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in s)
    return "*.{" + ",".join(any_case(s) for s in suffixes) + "}"


def scan(spark: SparkSession, folder: str, suffixes: tuple[str, ...] = BATCH_SUFFIXES, recursive: bool = False, content: bool = True) -> DataFrame:
    """``image_id, path, length`` and, if asked for, ``content``. The glob goes to the file listing; without ``content`` no
    file is opened. Spark's file sources pass over files of no bytes: to have rows for them, give their ids apart."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", _glob(suffixes)).option("recursiveFileLookup", str(recursive).lower()).load(folder)
    return files.select(file_stem(F.col("path")).alias("image_id"), "path", "length", "modificationTime", *(["content"] if content else []))


def scan_or_all(spark: SparkSession, folder: str, suffixes: tuple[str, ...] = BATCH_SUFFIXES, content: bool = True) -> DataFrame:
    """As ``scan``; all files with a dot in their name where none has one of the suffixes."""
    found = scan(spark, folder, suffixes, content=content)
    if not found.select("path").isEmpty():
        return found
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.*").load(folder)
    return files.select(file_stem(F.col("path")).alias("image_id"), "path", "length", "modificationTime", *(["content"] if content else []))


def scan_collection(spark: SparkSession, folder: str, output: str | None = None, suffixes: tuple[str, ...] = COLLECTION_SUFFIXES) -> DataFrame:
    """A tree of photographs: hidden files and what lies in the output folder are left out. ``src_file`` is the path below
    the folder."""
    found = scan(spark, folder, suffixes, recursive=True).where(~F.col("path").rlike(r"(^|/)\.[^/]*$"))
    if output:
        found = found.where(~F.regexp_replace("path", "^file:/+", "/").startswith(output.removeprefix("file://").rstrip("/") + "/"))
    root = folder.removeprefix("file://").rstrip("/") + "/"
    return found.withColumn("src_file", F.element_at(F.split(F.col("path"), "\\Q" + root + "\\E", 2), -1))


def in_order(images: DataFrame) -> DataFrame:
    return images.orderBy("path")


def only(images: DataFrame, ids: DataFrame) -> DataFrame:
    """Images whose name is listed, as it stands there."""
    return images.join(ids.select("image_id").distinct(), "image_id", "left_semi")


def with_padded_ids(images: DataFrame) -> DataFrame:
    return images.withColumn("image_id", padded(F.col("image_id"), 6))


def manifest(files: DataFrame) -> DataFrame:
    """Name, size and SHA-256 of every file."""
    return files.select(F.regexp_extract("path", r"([^/\\]*)$", 1).alias("name"), "length", F.sha2("content", 256).alias("sha256"))


def verified(files: DataFrame, expected: DataFrame) -> DataFrame:
    """Expected files (``name, sha256``) with ``ok``, ``mismatch`` or ``missing``."""
    own = manifest(files).withColumnRenamed("sha256", "found")
    state = F.when(F.col("found").isNull(), "missing").when(F.lower("sha256") != F.col("found"), "mismatch").otherwise("ok")
    return expected.join(own, "name", "left").select("name", "sha256", "found", state.alias("state"))


def require(files: DataFrame, expected: DataFrame) -> None:
    """Raise with the first files that are missing or differ."""
    bad = verified(files, expected).where("state <> 'ok'").orderBy("name").limit(20).collect()
    if bad:
        raise ValueError("files are not as listed: " + ", ".join(f"{r['name']} ({r['state']})" for r in bad))
