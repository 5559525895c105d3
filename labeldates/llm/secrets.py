"""Secret scans in DataFrame functions only: fixed patterns, and character Markov models for what they miss.

Fixed patterns find assignments to secret-like names, access key ids and long hexadecimal runs. Beside them, runs of 20
characters and more of the base64 and identifier alphabets, outside what an assignment covers, are scored by two
first-order Markov models of characters, one of random strings and one of ordinary identifiers and words; a run whose
log-likelihood ratio is high enough, in all and by character, is a span of kind ``random``, unless it holds an access key
id or hexadecimal run, or is a UUID, which names things and hides nothing. The models are trained from labelled samples, which are themselves rows of a DataFrame made by rule
(random: digests in several encodings; ordinary: words of a small list joined in the usual styles, paths, ruled lines,
repeated characters, times and numbers); the trained table has 67 x 67 entries whatever the input.

Positions are code points. ``split`` gives the gaps between matches and ``regexp_extract_all`` the matches, so a span
starts at the sum of the lengths before it; sums are taken in chunks of ``CHUNK`` matches, and a run is scored over its own
characters, so the time grows in proportion to the text. Nothing is shuffled.

Defined cases: null text counts as empty. Null ids and repeated rows are carried row by row. Extra columns are ignored.
Texts are read whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

KINDS = ("assign", "access", "hex", "random")
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_HEAD = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]"""
ACCESS = r"AKIA[A-Z0-9]{16,}"  # a whole run of the pattern AKIA[A-Z0-9]+ that is long enough: 20 characters with AKIA
HEX = r"[0-9a-f]{24,}"
RUN = r"[A-Za-z0-9+/_=-]{20,}"
UUID = r"^(?i)[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"
LEAST_VALUE = 6
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
SIDE = len(ALPHABET) + 1
LEAST_RATIO, LEAST_BY_CHARACTER = 14.0, 0.45
SAMPLES = 3000
CHUNK = 256
COVER = "\x01"  # stands for the characters of an assignment; no character of a run
WORDS = (
    "get set make find read write open close load store parse build create delete update insert select merge filter sort user name value index count total size length first last next previous "
    "table column row record batch partition cluster driver executor session config option default schema document token window buffer stream writer reader handler manager factory service client server "
    "request response message error exception result input output file path folder image label date year month day time number string integer float double boolean array list map struct key hash "
    "internationalization characterization responsibility understanding development government information communication organization environment administration straightforward"
).split()


HIT = "struct<a:int,b:int,s:string>"


def _prefix_sums(values: Column) -> Column:
    """Of an array of numbers, the sum before each element, in chunks so that no long array is copied for each element."""
    walk = lambda xs, start: F.aggregate(
        xs, F.struct(start.alias("at"), F.array().cast("array<int>").alias("out")),
        lambda acc, x: F.struct((acc["at"] + x).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")), lambda acc: acc["out"],
    )
    chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size(values) - 1) / CHUNK).cast("int")), lambda i: F.slice(values, i * CHUNK + 1, F.lit(CHUNK)))
    parts = lambda chunks: F.flatten(F.zip_with(chunks, walk(F.transform(chunks, lambda xs: F.aggregate(xs, F.lit(0), lambda acc, x: acc + x)), F.lit(0)), walk))
    return F.when(F.size(values) <= CHUNK, walk(values, F.lit(0))).otherwise(F.get(F.transform(F.array(chunks), parts), F.lit(0)))


def _hits(text: Column, pattern: str, head: str | None = None) -> Column:
    """Start, end and text of all matches, as an array of ``HIT``."""

    def place(pairs: Column) -> Column:
        at = _prefix_sums(F.transform(pairs, lambda p: F.length(p["gap"]) + F.length(p["hit"])))
        return F.zip_with(pairs, at, lambda p, a: F.struct((a + F.length(p["gap"])).alias("a"), (a + F.length(p["gap"]) + F.length(p["hit"])).alias("b"), p["hit"].alias("s")))

    gaps, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pairs = F.filter(F.arrays_zip(gaps.alias("gap"), found.alias("hit")), lambda p: p["hit"].isNotNull())  # the last gap has no match
    placed = F.get(F.transform(F.array(pairs), place), F.lit(0))
    return F.when(text.rlike(head or pattern), placed).otherwise(F.array().cast(f"array<{HIT}>"))


def samples(spark: SparkSession, n: int = SAMPLES) -> DataFrame:
    """Labelled strings: ``random`` true or false."""
    ids = spark.range(0, n, 1, 1)
    digest = F.sha2(F.concat(F.lit("sample "), F.col("id").cast("string")), 256)
    coded = F.base64(F.unhex(digest))
    thirty_six = F.concat(*[F.conv(F.substring(digest, k, 12), 16, 36) for k in (1, 13, 25)])
    noise = F.array(coded, F.translate(coded, "+/=", "-_"), F.translate(coded, "+/=", "xYz"), F.upper(F.substring(digest, 1, 32)), F.upper(F.substring(digest, 33, 32)), thirty_six, F.lower(thirty_six))
    words = F.array(*map(F.lit, WORDS))
    number = lambda salt, below: F.pmod(F.xxhash64(F.col("id"), F.lit(salt)), F.lit(below)).cast("int")
    word = lambda salt: F.element_at(words, number(salt, len(WORDS)) + 1)
    three = [word(i) for i in range(3)]
    joined = [F.concat_ws("_", *three), F.upper(F.concat_ws("_", *three)), F.concat(three[0], *map(F.initcap, three[1:])), F.concat_ws("-", *three), F.concat_ws("/", *three), F.concat(*map(F.initcap, three)), F.concat(*three), F.concat_ws("_", *three, number(9, 100).cast("string"))]
    repeated = F.repeat(F.substring(F.lit(ALPHABET), F.col("id").cast("int") % len(ALPHABET) + 1, F.lit(1)), F.lit(24))
    ruled = F.repeat(F.element_at(F.array(*map(F.lit, ("-", "=", "_", "/", "-=", "=-", "+-", "--+", "_-"))), number(3, 9) + 1), F.lit(30))
    when = F.concat(F.lpad(number(4, 10000).cast("string"), 4, "0"), F.lit("-"), F.lpad(number(5, 12).cast("string"), 2, "0"), F.lit("-"), F.lpad(number(6, 28).cast("string"), 2, "0"))
    digits = F.translate(F.substring(digest, 1, 24), "abcdef", "012345")
    plain = F.array(*joined, *joined, repeated, ruled, F.concat_ws("_", three[0], when), F.concat_ws("-", when, when), digits, F.concat_ws("/", three[0], digits), F.substring(F.lit(ALPHABET), number(7, len(ALPHABET) - 24) + 1, F.lit(24)))
    pick = lambda of, k: F.element_at(of, F.pmod(F.col("id"), F.lit(k)).cast("int") + 1)
    return ids.select(F.lit(True).alias("random"), pick(noise, 7).alias("text")).unionAll(ids.select(F.lit(False), pick(plain, 23)))


def _code(c: Column) -> Column:
    return F.instr(F.lit(ALPHABET), c)


def train(labelled: DataFrame) -> list[float]:
    """Log-likelihood ratios of all pairs of characters, add-one smoothed; characters outside the alphabet share code 0."""
    pairs = labelled.where("length(text) > 1").select("random", F.explode(F.transform(F.sequence(F.lit(1), F.length("text") - 1), lambda i: _code(F.substring("text", i, F.lit(1))) * SIDE + _code(F.substring("text", i + 1, F.lit(1))))).alias("pair"))
    counts = pairs.groupBy("pair").agg(F.sum(F.col("random").cast("long")).alias("r"), F.sum((~F.col("random")).cast("long")).alias("o")).collect()
    table = {row["pair"]: (row["r"], row["o"]) for row in counts}
    from math import log

    out = []
    for a in range(SIDE):
        row = [table.get(a * SIDE + b, (0, 0)) for b in range(SIDE)]
        r, o = (sum(x[k] for x in row) for k in (0, 1))
        out += [round(log((x + 1) / (r + SIDE)) - log((y + 1) / (o + SIDE)), 4) for x, y in row]
    return out


def scan(docs: DataFrame, model: list[float] | None = None) -> DataFrame:
    """One row per document; ``spans`` lists all spans by start, then kind."""
    spark = docs.sparkSession
    model = model or train(samples(spark))
    ratio = F.split(F.lit(",".join(map(str, model))), ",").cast("array<double>")
    text = F.col("text")
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    found = base.select(
        "doc_id", "text", _hits(text, ASSIGN, ASSIGN_HEAD).alias("assign_all"), F.when(text.rlike(ASSIGN_HEAD), F.regexp_extract_all(text, F.lit(ASSIGN), F.lit(2))).alias("assigned"),
        _hits(text, ACCESS).alias("access"), _hits(text, HEX).alias("hex"),
    )
    counts = lambda i: F.length(F.get(F.col("assigned"), i)) >= LEAST_VALUE
    cover = F.transform(F.col("assign_all"), lambda s, i: F.when(counts(i), F.repeat(F.lit(COVER), F.length(s["s"]))).otherwise(s["s"]))
    bare = F.when(F.size("assign_all") > 0, F.array_join(F.zip_with(F.split(text, ASSIGN, -1), cover, lambda gap, c: F.concat(gap, F.coalesce(c, F.lit("")))), "")).otherwise(text)
    kind = lambda name, column: F.transform(column, lambda s: F.struct(s["a"].alias("a"), F.lit(KINDS.index(name)).alias("k"), s["b"].alias("b")))
    marked = F.transform(F.col("assign_all"), lambda s, i: F.struct(s["a"].alias("a"), s["b"].alias("b"), counts(i).alias("counts")))
    fixed = F.array_sort(F.concat(kind("assign", F.filter(marked, lambda s: s["counts"])), kind("access", F.col("access")), kind("hex", F.col("hex"))))
    based = found.select("doc_id", fixed.alias("fixed"), bare.alias("bare")).select("doc_id", "fixed", _hits(F.col("bare"), RUN).alias("runs"))
    free = F.filter(F.col("runs"), lambda r: ~r["s"].rlike(f"{ACCESS}|{HEX}|{UUID}"))
    step = lambda acc, c: F.struct((acc["llr"] + F.when(acc["last"] >= 0, F.get(ratio, acc["last"] * SIDE + _code(c))).otherwise(0.0)).alias("llr"), _code(c).alias("last"))
    scored = F.transform(free, lambda r: F.struct(
        r["a"].alias("a"), r["b"].alias("b"),
        F.aggregate(F.split(r["s"], ""), F.struct(F.lit(0.0).alias("llr"), F.lit(-1).alias("last")), step, lambda acc: acc["llr"]).alias("llr"),
    ))
    strange = F.filter(scored, lambda s: (s["llr"] >= LEAST_RATIO) & (s["llr"] >= LEAST_BY_CHARACTER * (s["b"] - s["a"])))
    every = based.select("doc_id", "fixed", F.array_sort(F.concat("fixed", kind("random", strange))).alias("every"))
    names = F.array(*map(F.lit, KINDS))
    written = lambda column: F.array_join(F.transform(column, lambda s: F.concat_ws(":", F.get(names, s["k"]), s["a"].cast("string"), s["b"].cast("string"))), ",")
    count = lambda k: F.size(F.filter("fixed", lambda s: s["k"] == k)).cast("long")
    return every.select("doc_id", *[count(k).alias(f"n_{KINDS[k]}") for k in range(3)], F.sha2(written(F.col("fixed")), 256).alias("base_sha256"), written(F.col("every")).alias("spans"))
