"""Queries for the driver: label texts made from the tables' dates, read back, and held against closed-form SQL.

The tables' dates are moved 300 months on, into the years that labels can have.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import DEFAULT
from ..functions import dates, textnorm
from ..functions.spans import bind

from ..imaging import TextProvider, stage_texts
from ..lineage import once, spread
from ..operators import candidates, cascade, choose, evaluation, geometry, layers, quality, sampling
from ..operators.layers import read_dates
from ..sources import images as image_source
from ..sources import tables
from . import notation

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}
KEYS = ("l_orderkey", "l_linenumber")
SHIFT = 300


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(name: str, sql: str | None = None):
    def keep(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return keep


def shipped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(*KEYS, F.add_months(F.col("l_shipdate").cast("date"), SHIFT).alias("day"))


def read_texts(texts: DataFrame, **how) -> DataFrame:
    """``read_dates`` of a table with ``text``, each distinct text read once."""
    return once(texts, ("text",), lambda t: read_dates(t, **how))


def parts(df: DataFrame, *keys: str) -> DataFrame:
    return df.select(*keys, F.col("answer.y").alias("y"), F.col("answer.m").alias("m"), F.col("answer.d").alias("d"))


def read_back(template: str, crop: bool = False, other: Callable[[Column], Column] | None = None) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = shipped(spark, sf_dir)
        day = F.col("day")
        texts = rows.select(*KEYS, notation.label(template, day, other(day) if other else None, N=F.col("l_linenumber")).alias("text"))
        return parts(read_texts(texts, crop=crop), *KEYS)

    return run


DAYS = f"WITH s AS (SELECT l_orderkey, l_linenumber, CAST(l_shipdate + INTERVAL {SHIFT} MONTH AS DATE) AS day FROM lineitem), p AS (SELECT l_orderkey, l_linenumber, day, year(day)::INTEGER AS y, month(day)::INTEGER AS m, day(day)::INTEGER AS d FROM s)"
PRIOR = "prior(y, p) AS (VALUES " + ", ".join(f"({y}, {p}::DOUBLE)" for y, p in DEFAULT.year_prior) + ")"


def same(extra: str = "y, m, d") -> str:
    return f"{DAYS} SELECT l_orderkey, l_linenumber, {extra} FROM p"


# --- notations

for _name, _template in notation.FULL.items():
    query(f"q_{_name}", same())(read_back(_template))
for _name, _template in notation.CROP.items():
    query(f"q_{_name}", same())(read_back(_template, crop=True))
for _name, _template in notation.MONTH_YEAR.items():
    query(f"q_{_name}", same("y, m, NULL::INTEGER AS d"))(read_back(_template))


def two_ends(hint: str = "") -> str:
    """SQL for ``yy.MM.dd`` without its order: both readings, what the label says, the likelier year."""
    flip = {"dmy": "TRUE", "ymd": "FALSE"}.get(hint, f"coalesce(b.p, {DEFAULT.prior_floor}) >= {DEFAULT.flip_ratio} * coalesce(a.p, {DEFAULT.prior_floor})")
    both = f"(d BETWEEN 15 AND 31 AND p.y % 100 <= day(last_day(make_date(2000 + d, m, 1))) AND {flip})"
    return f"""{DAYS}, {PRIOR}
        SELECT l_orderkey, l_linenumber, CASE WHEN {both} THEN 2000 + d ELSE p.y END::INTEGER AS y, m, CASE WHEN {both} THEN p.y - 2000 ELSE d END::INTEGER AS d
        FROM p LEFT JOIN prior a ON a.y = p.y LEFT JOIN prior b ON b.y = 2000 + d"""


query("q_c3_year_prior", two_ends())(read_back("{y}.{M}.{D}"))
query("q_c4_year_prior_loose", two_ends())(read_back("{y}.{M} {D}"))
query("q_v5_hint_day_first", two_ends("dmy"))(read_back("(일.월.년) {y}.{M}.{D}"))
query("q_v5_hint_year_first", two_ends("ymd"))(read_back("(년월일 순) {y}.{M}.{D}"))
query("q_v5_hint_english", two_ends("dmy"))(read_back("(DD/MM/YY) {y}/{M}/{D}"))
query("q_l7_spaced_two_digits", two_ends())(read_back("{y} {M} {D}", crop=True))
query("q_c9_c11_tie", f"""{DAYS}, {PRIOR}, t AS (
        SELECT p.*, 2000 + d AS z, d BETWEEN 15 AND 31 AND p.y % 100 <= day(last_day(make_date(2000 + d, m, 1)))
            AND coalesce(b.p, {DEFAULT.prior_floor}) >= {DEFAULT.flip_ratio} * coalesce(a.p, {DEFAULT.prior_floor}) AND 2000 + d < p.y AS flipped
        FROM p LEFT JOIN prior a ON a.y = p.y LEFT JOIN prior b ON b.y = 2000 + d)
        SELECT l_orderkey, l_linenumber, CASE WHEN flipped THEN z ELSE y END::INTEGER AS y, m, CASE WHEN flipped THEN y - 2000 ELSE d END::INTEGER AS d FROM t""")(read_back("{D}{MON}{y}"))  # fmt: skip

# --- choice among several dates

LATER = lambda d: F.add_months(d, 7)
LATER_SQL = f"{DAYS}, q AS (SELECT l_orderkey, l_linenumber, CAST(day + INTERVAL 7 MONTH AS DATE) AS e FROM p) SELECT l_orderkey, l_linenumber, year(e)::INTEGER AS y, month(e)::INTEGER AS m, day(e)::INTEGER AS d FROM q"
query("q_k5_made_and_expiry", LATER_SQL)(read_back("제조일자: {Y}.{M}.{D} 소비기한: {Y2}.{M2}.{D2}", other=LATER))
query("q_k5_english", LATER_SQL)(read_back("Prod date: {D}/{M}/{Y} Best before: {D2}/{M2}/{Y2}", other=LATER))
query("q_k6_until", LATER_SQL)(read_back("제조일자 소비기한 {Y}.{M}.{D} {Y2}.{M2}.{D2} 까지", other=LATER))
query("q_k7_from_until", LATER_SQL)(read_back("부터 까지 표시 {Y2}.{M2}.{D2} / {Y}.{M}.{D}", other=LATER))
query("q_k8_label_before", LATER_SQL)(read_back("1AN:{D}/{M}/{Y} EXP:{D2}/{M2}/{Y2}", other=LATER))
query("q_k11_latest_unknown", LATER_SQL)(read_back("{Y2}.{M2}.{D2} , {Y}.{M}.{D}", other=LATER))
query("q_k11_made_only", same("NULL::INTEGER AS y, NULL::INTEGER AS m, NULL::INTEGER AS d"))(read_back("제조일자 {Y}.{M}.{D}"))
query("q_k9_relative_months", f"{DAYS}, q AS (SELECT l_orderkey, l_linenumber, CAST(day + to_months(l_linenumber) AS DATE) AS e FROM p) SELECT l_orderkey, l_linenumber, year(e)::INTEGER AS y, month(e)::INTEGER AS m, day(e)::INTEGER AS d FROM q")(read_back("제조일자 {Y}.{M}.{D} 제조일로부터 {N}개월"))
query("q_k9_relative_years", f"{DAYS}, q AS (SELECT l_orderkey, l_linenumber, CAST(day + to_months(12 * l_linenumber) AS DATE) AS e FROM p) SELECT l_orderkey, l_linenumber, year(e)::INTEGER AS y, month(e)::INTEGER AS m, day(e)::INTEGER AS d FROM q")(read_back("제조 {Y}.{M}.{D} 제조일로부터 {N}년까지"))
query("q_k9_relative_weeks", f"{DAYS}, q AS (SELECT l_orderkey, l_linenumber, CAST(day + to_days(7 * l_linenumber) AS DATE) AS e FROM p) SELECT l_orderkey, l_linenumber, year(e)::INTEGER AS y, month(e)::INTEGER AS m, day(e)::INTEGER AS d FROM q")(read_back("제조일자 {Y}.{M}.{D} 제조일부터 {N} 주"))
query("q_k13_month_day", same("NULL::INTEGER AS y, m, d"))(read_back("소비기한 {M}.{D}"))
query("q_l9_lone_month_day", same("NULL::INTEGER AS y, m, d"))(read_back("{M}/{D} 까지"))
query("q_l9_not_asked", same("NULL::INTEGER AS y, NULL::INTEGER AS m, NULL::INTEGER AS d"))(
    lambda spark, sf_dir: parts(read_texts(shipped(spark, sf_dir).select(*KEYS, notation.label("{M}/{D} 까지", F.col("day")).alias("text")), rescue=False), *KEYS)
)
SPLIT = same("y, CASE WHEN m >= 11 THEN 1 ELSE m END::INTEGER AS m, CASE WHEN m = 11 THEN 1 WHEN m = 12 THEN 2 END::INTEGER AS d")
query("q_c2_month_split", SPLIT)(read_back("EXP {Y}.{M}"))
query("q_l8_colon", SPLIT)(read_back("유효기간 {Y}:{M} 제품"))
query("q_l8_month_first", same("y, m, NULL::INTEGER AS d"))(read_back("유효기간 {M}/{Y}"))
query("q_v1_implausible_bare", "SELECT l_orderkey, l_linenumber, NULL::INTEGER AS y, NULL::INTEGER AS m, NULL::INTEGER AS d FROM lineitem")(
    lambda spark, sf_dir: parts(read_texts(table(spark, sf_dir, "lineitem").select(*KEYS, notation.label("{Y}.{M}.{D}", F.col("l_shipdate")).alias("text"))), *KEYS)
)
query("q_v1_implausible_labelled", "SELECT l_orderkey, l_linenumber, NULL::INTEGER AS y, month(l_shipdate)::INTEGER AS m, day(l_shipdate)::INTEGER AS d FROM lineitem")(
    lambda spark, sf_dir: parts(read_texts(table(spark, sf_dir, "lineitem").select(*KEYS, notation.label("유통기한 {Y}.{M}.{D}", F.col("l_shipdate")).alias("text"))), *KEYS)
)


def misread(day: Column) -> Column:
    return F.translate(notation.label("{Y}.{M}.{D}", day), "01", "OI")


@query("q_n5_confusions", same())
def q_confusions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parts(read_texts(shipped(spark, sf_dir).select(*KEYS, misread(F.col("day")).alias("text"))), *KEYS)


@query("q_n5_confusions_stolen", f"""{DAYS} SELECT l_orderkey, l_linenumber, CASE WHEN NOT stolen THEN y END::INTEGER AS y, CASE WHEN stolen THEN m % 10 ELSE m END::INTEGER AS m,
        CASE WHEN NOT stolen THEN d WHEN d IN (20, 21) THEN 2 WHEN d >= 30 THEN 3 ELSE d END::INTEGER AS d
        FROM (SELECT *, (m BETWEEN 2 AND 9 OR m = 12) AND d >= 20 AS stolen FROM p)""")  # fmt: skip
def q_confusions_stolen(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parts(read_texts(shipped(spark, sf_dir).select(*KEYS, F.concat(F.lit("소비기한 "), misread(F.col("day"))).alias("text"))), *KEYS)


@query("q_k14_submission", f"""{DAYS} SELECT CAST(l_orderkey AS VARCHAR) AS image_id, CASE WHEN l_linenumber % 3 = 2 THEN 'NONE' ELSE lpad(y::VARCHAR, 4, '0') END AS year, CASE WHEN l_linenumber % 3 = 1 AND m = 0 THEN 'NONE' ELSE lpad(m::VARCHAR, 2, '0') END AS month,
        CASE WHEN l_linenumber % 3 = 1 THEN 'NONE' ELSE lpad(d::VARCHAR, 2, '0') END AS day,
        concat(CASE WHEN l_linenumber % 3 = 2 THEN 'NONE' ELSE lpad(y::VARCHAR, 4, '0') END, '-', lpad(m::VARCHAR, 2, '0'), '-', CASE WHEN l_linenumber % 3 = 1 THEN 'NONE' ELSE lpad(d::VARCHAR, 2, '0') END) AS final_date FROM p""")  # fmt: skip
def q_submission(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.col("day")
    text = F.when(F.col("l_linenumber") % 3 == 0, notation.label("{Y}.{M}.{D}", day)).when(F.col("l_linenumber") % 3 == 1, notation.label("EXP {M}/{Y}", day)).otherwise(notation.label("소비기한 {M}.{D}", day))
    return layers.submission(read_texts(shipped(spark, sf_dir).select(F.col("l_orderkey").alias("image_id"), text.alias("text"))))


@query("q_k15_diagnosis", f"""{DAYS} SELECT l_orderkey, l_linenumber, 2::INTEGER AS candidates, 'MFG' AS first_kind, 'EXP' AS second_kind, TRUE AS has_relative_expr, TRUE AS has_reference_phrase, y, m, d
        FROM (SELECT l_orderkey, l_linenumber, year(e)::INTEGER AS y, month(e)::INTEGER AS m, day(e)::INTEGER AS d FROM (SELECT *, CAST(day + INTERVAL 7 MONTH AS DATE) AS e FROM p))""")  # fmt: skip
def q_diagnosis(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = notation.label("제조일자 {Y}.{M}.{D} 제조일로부터 7개월 하단 표기 참조하세요 소비기한 {Y2}.{M2}.{D2}", F.col("day"), F.add_months("day", 7))
    rows = once(shipped(spark, sf_dir).select(*KEYS, text.alias("text")), ("text",), lambda t: t.withColumn("e", choose.diagnosis(F.col("text"))))
    return rows.select(*KEYS, F.size("e.candidates").alias("candidates"), F.col("e.candidates")[0]["kind"].alias("first_kind"), F.col("e.candidates")[1]["kind"].alias("second_kind"), "e.has_relative_expr", "e.has_reference_phrase", "e.result.y", "e.result.m", "e.result.d")


@query("q_c20_spans", f"{DAYS} SELECT l_orderkey, l_linenumber, 8::INTEGER AS first_start, 18::INTEGER AS first_end, 25::INTEGER AS second_start, 35::INTEGER AS second_end FROM p")
def q_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = notation.label("😀 제조일자: {Y}.{M}.{D} 소비기한 :{D}/{M}/{Y}", F.col("day"))
    rows = once(shipped(spark, sf_dir).select(*KEYS, text.alias("text")), ("text",), lambda t: t.withColumn("c", candidates.full_dates(F.col("text"))))
    return rows.select(*KEYS, F.col("c")[0]["start"].alias("first_start"), F.col("c")[0]["end"].alias("first_end"), F.col("c")[1]["start"].alias("second_start"), F.col("c")[1]["end"].alias("second_end"))


@query("q_free_text_has_no_dates", """SELECT 'documents' AS name, count(*)::BIGINT AS n, 0::BIGINT AS full_dates FROM documents UNION ALL SELECT 'pages', count(*)::BIGINT, 0::BIGINT FROM pages""")
def q_free_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Full dates near words of expiry in free text: the tables have none."""
    one = lambda name, col: spread(table(spark, sf_dir, name).select(col)).select(F.lit(name).alias("name"), F.size(F.filter(choose.with_kinds(F.coalesce(F.col(col), F.lit("")), candidates.full_dates(textnorm.aliased(F.coalesce(F.col(col), F.lit(""))))), lambda c: c["kind"] == "EXP")).alias("k"))
    return one("documents", "text").unionByName(one("pages", "html")).groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.sum("k").alias("full_dates"))


# --- cascade

def stage_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six answers an order: what each stage says depends on the order's number."""
    day = F.add_months(F.col("o_orderdate").cast("date"), SHIFT)
    k = lambda n: F.pmod(F.col("o_orderkey") + F.col("stage") * F.lit(7), F.lit(n))
    y, m, d = F.year(day), F.month(day), F.dayofmonth(day)
    none = F.lit(None).cast("int")
    what = k(11)  # 0: sound, 1: weak by repair, 2: weak by print, 3-5: partial, else nothing
    answer = F.struct(
        F.when(what <= 3, y).otherwise(none).alias("y"), F.when(what <= 4, m).otherwise(none).alias("m"), F.when((what <= 2) | (what == 4), d).when(what == 5, d).otherwise(none).alias("d"),
        F.lit("UNKNOWN").alias("kind"), F.when(what == 2, notation.label("{Y}.{m}", day)).when(what <= 1, notation.label("{Y}.{M}.{D}", day)).alias("raw"), F.when(what == 1, "ocr_normalized").alias("via"),
    )
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("image_id"), "o_orderdate", F.explode(F.sequence(F.lit(1), F.lit(6))).alias("stage")).select("image_id", "stage", F.expr("o_orderdate").alias("o_orderdate"), F.col("image_id").alias("o_orderkey")).withColumn("answer", answer)


STAGED = f"""WITH s AS (SELECT o_orderkey AS image_id, g.stage::INTEGER AS stage, CAST(o_orderdate + INTERVAL {SHIFT} MONTH AS DATE) AS day, (o_orderkey + g.stage * 7) % 11 AS k FROM orders, range(1, 7) g(stage)),
    r AS (SELECT image_id, stage, day, k, CASE WHEN k = 0 THEN 0 WHEN k IN (1, 2) THEN 1 WHEN k <= 5 THEN 2 END AS rank, CASE WHEN k IN (3, 4) THEN -2 WHEN k = 5 THEN -1 ELSE 0 END AS less FROM s),
    b AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY rank, less, stage) AS n FROM r WHERE rank IS NOT NULL)
    SELECT image_id, stage, CASE WHEN k <= 3 THEN year(day) END::INTEGER AS y, CASE WHEN k <= 4 THEN month(day) END::INTEGER AS m, CASE WHEN k <= 2 OR k IN (4, 5) THEN day(day) END::INTEGER AS d, rank = 1 AS weak FROM b WHERE n = 1"""


@query("q_f3_best_stage", STAGED)
def q_best_stage(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = cascade.best_answers(stage_answers(spark, sf_dir))
    return best.select("image_id", "stage", "answer.y", "answer.m", "answer.d", "weak")


@query("q_f2_weak", f"""WITH s AS (SELECT o_orderkey AS image_id, g.stage::INTEGER AS stage, (o_orderkey + g.stage * 7) % 11 AS k FROM orders, range(1, 7) g(stage))
    SELECT image_id, stage, CASE WHEN k <= 2 THEN 3 WHEN k <= 4 THEN 2 WHEN k = 5 THEN 1 ELSE 0 END::INTEGER AS filled, k IN (1, 2) AS weak FROM s""")  # fmt: skip
def q_weak(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stage_answers(spark, sf_dir).select("image_id", "stage", cascade.filled(F.col("answer")).alias("filled"), cascade.is_weak(F.col("answer")).alias("weak"))


@query("q_f4_residual_stages", f"""WITH s AS (SELECT o_orderkey AS image_id, CAST(o_orderdate + INTERVAL {SHIFT} MONTH AS DATE) AS day, o_orderkey % 4 AS k FROM orders)
    SELECT image_id, CASE k WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 3 END::INTEGER AS stage, year(day)::INTEGER AS y, month(day)::INTEGER AS m, CASE WHEN k <= 2 THEN day(day) END::INTEGER AS d FROM s""")  # fmt: skip
def q_residual(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stage-by-stage run: orders of remainder 0 answer at stage 1, of 1 at stage 2, the others at stage 3, the last
    with a month and year only."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("image_id"), F.add_months(F.col("o_orderdate").cast("date"), SHIFT).alias("day"))
    k = F.pmod(F.col("image_id"), F.lit(4))
    full, part = notation.label("소비기한 {Y}.{M}.{D}", F.col("day")), notation.label("EXP {M}/{Y}", F.col("day"))

    def texts(open_: DataFrame, stage: int) -> DataFrame:
        said = {1: F.when(k == 0, full).otherwise(F.lit("?")), 2: F.when(k == 1, full).otherwise(F.lit("?")), 3: F.when(k == 2, full).otherwise(part)}[stage]
        return orders.join(open_, "image_id", "left_semi").select("image_id", said.alias("text"))

    best = cascade.run_stages(orders.select("image_id"), texts, (1, 2, 3))
    return best.select("image_id", "stage", "answer.y", "answer.m", "answer.d")


@query("q_f5_regions", """WITH b AS (SELECT l_orderkey AS image_id, CASE l_linenumber % 4 WHEN 0 THEN 'full' WHEN 1 THEN 'date' WHEN 2 THEN 'due' ELSE 'code' END AS cls, l_partkey::DOUBLE AS x1, l_suppkey::DOUBLE AS y1, l_partkey + l_quantity AS x2, l_suppkey + l_quantity AS y2, l_discount + l_extendedprice / 1e6 AS conf FROM lineitem),
    f AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY conf DESC, x1, y1, x2, y2) AS n FROM b WHERE cls = 'full'),
    u AS (SELECT image_id, min(x1) AS x1, min(y1) AS y1, max(x2) AS x2, max(y2) AS y2 FROM b WHERE cls IN ('date', 'due') AND image_id NOT IN (SELECT image_id FROM f) GROUP BY image_id)
    SELECT image_id, n::INTEGER AS n, x1, y1, x2, y2 FROM f WHERE n <= 2 UNION ALL SELECT image_id, 1::INTEGER, x1, y1, x2, y2 FROM u""")  # fmt: skip
def q_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cascade.regions(boxes(spark, sf_dir))


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("l_linenumber") % 4
    cls = F.when(k == 0, "full").when(k == 1, "date").when(k == 2, "due").otherwise("code")
    x, y, q = F.col("l_partkey").cast("double"), F.col("l_suppkey").cast("double"), F.col("l_quantity")
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("image_id"), cls.alias("cls"), x.alias("x1"), y.alias("y1"), (x + q).alias("x2"), (y + q).alias("y2"), (F.col("l_discount") + F.col("l_extendedprice") / 1e6).alias("conf"))


# Words before a date that refer to another place, and words that do not.
ELSEWHERE = ("상단 표기", "상단에 기재", "상단 별도", "하단 표기", "하단에 기재일", "하단 별도 라벨", "별도 표기", "별도기재", "뒷면 표시", "뒷면에 표기", "뒷면 기재", "표시일까지", "표기일 전", "상단 참조", "별도 포장", "뒷면 별도", "표시 까지", "기재일까지")


@query("q_k15_elsewhere", f"""SELECT o_orderkey, o_orderkey % {len(ELSEWHERE)} < 13 AS has_reference_phrase, o_orderkey % 3 = 0 AS has_relative_expr FROM orders""")
def q_elsewhere(spark: SparkSession, sf_dir: str) -> DataFrame:
    phrase = F.get(F.array(*map(F.lit, ELSEWHERE)), (F.col("o_orderkey") % len(ELSEWHERE)).cast("int"))
    period = F.get(F.array(*map(F.lit, (" 구입 후 12개월 이내", " 구입 후 사용", " 제조일자"))), (F.col("o_orderkey") % 3).cast("int"))
    texts = table(spark, sf_dir, "orders").select("o_orderkey", F.concat(F.lit("소비기한 "), phrase, period).alias("text"))
    return once(texts, ("text",), lambda t: t.withColumn("e", choose.diagnosis(F.col("text")))).select("o_orderkey", "e.has_reference_phrase", "e.has_relative_expr")


# --- geometry

@query("q_g7_padded_box", """WITH b AS (SELECT l_orderkey, l_linenumber, l_partkey::DOUBLE AS x1, l_suppkey::DOUBLE AS y1, l_partkey + l_quantity * 3 AS x2, l_suppkey + l_quantity AS y2 FROM lineitem),
    g AS (SELECT *, greatest((x2 - x1) * 0.45::DOUBLE, 12) AS px, greatest((y2 - y1) * 0.45::DOUBLE, 12) AS py FROM b)
    SELECT l_orderkey, l_linenumber, greatest(0, trunc(x1 - px))::INTEGER AS x1, greatest(0, trunc(y1 - py))::INTEGER AS y1, least(1500, trunc(x2 + px))::INTEGER AS x2, least(800, trunc(y2 + py))::INTEGER AS y2 FROM g""")  # fmt: skip
def q_padded_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, y, q = F.col("l_partkey").cast("double"), F.col("l_suppkey").cast("double"), F.col("l_quantity")
    return table(spark, sf_dir, "lineitem").select(*KEYS, geometry.padded_box(x, y, x + q * 3, y + q, F.lit(1500), F.lit(800)).alias("b")).select(*KEYS, "b.*")


@query("q_g1_letterbox", """WITH s AS (SELECT p_partkey, 100 + p_partkey % 3000 AS w, 100 + p_size * 37 AS h FROM part), k AS (SELECT *, least(960.0::DOUBLE / w, 960.0::DOUBLE / h) AS scale FROM s),
    n AS (SELECT *, greatest(1, round_even(w * scale, 0))::INTEGER AS nw, greatest(1, round_even(h * scale, 0))::INTEGER AS nh FROM k)
    SELECT p_partkey, scale, nw AS w, nh AS h, ((960 - nw) // 2)::INTEGER AS dx, ((960 - nh) // 2)::INTEGER AS dy FROM n""")  # fmt: skip
def q_letterbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    w, h = F.lit(100) + F.col("p_partkey") % 3000, F.lit(100) + F.col("p_size") * 37
    return table(spark, sf_dir, "part").select("p_partkey", geometry.letterbox(w, h).alias("l")).select("p_partkey", "l.*")


@query("q_g4_detected", """WITH r AS (SELECT l_orderkey, l_linenumber, l_partkey::DOUBLE AS cx, l_suppkey::DOUBLE AS cy, l_quantity AS bw, l_quantity / 2 AS bh, l_discount * 5 AS s0, l_tax * 5 AS s1, 0.3::DOUBLE AS s2, 0.1::DOUBLE AS s3 FROM lineitem),
    c AS (SELECT *, greatest(s0, s1, s2, s3) AS conf FROM r), k AS (SELECT *, 960.0::DOUBLE / 1920 AS scale FROM c WHERE conf >= 0.25)
    SELECT l_orderkey AS image_id, CASE WHEN s0 = conf THEN 'date' WHEN s1 = conf THEN 'due' WHEN s2 = conf THEN 'code' ELSE 'full' END AS cls, (cx - bw / 2 - 0) / scale AS x1, (cy - bh / 2 - 210) / scale AS y1, (cx + bw / 2 - 0) / scale AS x2, (cy + bh / 2 - 210) / scale AS y2, conf FROM k""")  # fmt: skip
def q_detected(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("image_id"), F.lit(1920).alias("w"), F.lit(1080).alias("h"), F.col("l_partkey").cast("double").alias("cx"), F.col("l_suppkey").cast("double").alias("cy"), F.col("l_quantity").alias("bw"), (F.col("l_quantity") / 2).alias("bh"),
        F.array(F.col("l_discount") * 5, F.col("l_tax") * 5, F.lit(0.3), F.lit(0.1)).alias("scores"),
    )
    return geometry.detected(raw)


@query("q_g5_overlap", """WITH b AS (SELECT l_orderkey, l_linenumber, l_quantity AS w, l_discount * 100 AS s FROM lineitem)
    SELECT l_orderkey, l_linenumber, (greatest(0, w - s) * greatest(0, w - s)) / (w * w + w * w - greatest(0, w - s) * greatest(0, w - s) + 1e-9) AS iou FROM b""")  # fmt: skip
def q_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    w, s = F.col("l_quantity"), F.col("l_discount") * 100
    box = lambda a: F.struct(a.alias("x1"), a.alias("y1"), (a + w).alias("x2"), (a + w).alias("y2"))
    return table(spark, sf_dir, "lineitem").select(*KEYS, geometry.overlap(box(F.lit(0.0)), box(s)).alias("iou"))


@query("q_g5_suppressed", """WITH RECURSIVE b AS (SELECT o_orderkey AS image_id, g.i, 10.0::DOUBLE * (o_orderkey % 5) + 3 * g.i AS x1, 0.0::DOUBLE AS y1, 10.0::DOUBLE * (o_orderkey % 5) + 3 * g.i + 20 AS x2, 20.0::DOUBLE AS y2, 1.0::DOUBLE - 0.1::DOUBLE * g.i AS conf FROM orders, range(6) g(i)),
    kept(image_id, i, x1, last) AS (SELECT image_id, i, x1, x1 FROM b WHERE i = 0 UNION ALL
        SELECT b.image_id, b.i, b.x1, CASE WHEN (20 - (b.x1 - k.last)) * 20 / (800 - (20 - (b.x1 - k.last)) * 20 + 1e-9) >= 0.45 THEN k.last ELSE b.x1 END FROM kept k JOIN b ON b.image_id = k.image_id AND b.i = k.i + 1)
    SELECT k.image_id, 'date' AS cls, b.x1, b.y1, b.x2, b.y2, b.conf FROM kept k JOIN b ON b.image_id = k.image_id AND b.i = k.i WHERE k.last = k.x1""")  # fmt: skip
def q_suppressed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six boxes an image, each three pixels further: one in three is kept."""
    i = F.col("i")
    left = F.lit(10.0) * (F.col("o_orderkey") % 5) + i * 3
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.explode(F.sequence(F.lit(0), F.lit(5))).alias("i"))
    return geometry.suppressed(rows.select(F.col("o_orderkey").alias("image_id"), F.lit("date").alias("cls"), left.alias("x1"), F.lit(0.0).alias("y1"), (left + 20).alias("x2"), F.lit(20.0).alias("y2"), (F.lit(1.0) - F.lit(0.1) * i).alias("conf")))


@query("q_g6_union_box", "SELECT l_orderkey AS image_id, min(l_partkey)::DOUBLE AS x1, min(l_suppkey)::DOUBLE AS y1, max(l_partkey + l_quantity) AS x2, max(l_suppkey + l_quantity) AS y2 FROM lineitem GROUP BY l_orderkey")
def q_union_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    return geometry.around_all(boxes(spark, sf_dir))


@query("q_g9_crop_size", """WITH s AS (SELECT l_orderkey, l_linenumber, l_partkey % 500 * 20 + 1 AS w, (l_quantity * 3)::INTEGER AS h FROM lineitem),
    a AS (SELECT l_orderkey, l_linenumber, CASE WHEN greatest(w, h) > 4000 THEN greatest(1, trunc(w * (4000.0::DOUBLE / greatest(w, h)))) ELSE w END AS w, CASE WHEN greatest(w, h) > 4000 THEN greatest(1, trunc(h * (4000.0::DOUBLE / greatest(w, h)))) ELSE h END AS h FROM s),
    b AS (SELECT l_orderkey, l_linenumber, h >= 100 AS done, CASE WHEN h >= 100 THEN w ELSE trunc(w * (100.0::DOUBLE / h)) END AS w, CASE WHEN h >= 100 THEN h ELSE trunc(h * (100.0::DOUBLE / h)) END AS h FROM a)
    SELECT l_orderkey, l_linenumber, CASE WHEN NOT done AND greatest(w, h) > 4000 THEN greatest(1, trunc(w * (4000.0::DOUBLE / greatest(w, h)))) ELSE w END::INTEGER AS w, CASE WHEN NOT done AND greatest(w, h) > 4000 THEN greatest(1, trunc(h * (4000.0::DOUBLE / greatest(w, h)))) ELSE h END::INTEGER AS h FROM b""")  # fmt: skip
def q_crop_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    w, h = F.col("l_partkey") % 500 * 20 + 1, (F.col("l_quantity") * 3).cast("int")
    return table(spark, sf_dir, "lineitem").select(*KEYS, geometry.crop_size(w, h).alias("s")).select(*KEYS, "s.*")


@query("q_g10_shrunk_size", """WITH s AS (SELECT p_partkey, 100 + p_partkey % 3000 AS w, 100 + p_size * 57 AS h FROM part), k AS (SELECT *, 1600.0::DOUBLE / greatest(w, h) AS k FROM s)
    SELECT p_partkey, CASE WHEN k < 1 THEN round_even(w * k, 0) ELSE w END::INTEGER AS w, CASE WHEN k < 1 THEN round_even(h * k, 0) ELSE h END::INTEGER AS h FROM k""")  # fmt: skip
def q_shrunk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", geometry.shrunk_size(F.lit(100) + F.col("p_partkey") % 3000, F.lit(100) + F.col("p_size") * 57).alias("s")).select("p_partkey", "s.*")


@query("q_g15_reading_order", "SELECT o_orderkey AS image_id, concat('2026 ', lpad((o_orderkey % 12 + 1)::VARCHAR, 2, '0'), ' EXP ', o_orderstatus) AS text FROM orders")
def q_reading_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two lines, given out of order, the upper one with a drifting centre."""
    corner = lambda x, y: F.array(F.lit(float(x)), F.lit(float(y)))
    item = lambda text, x, y: F.struct(text.alias("text"), F.array(corner(x, y), corner(x + 9, y), corner(x + 9, y + 10), corner(x, y + 10)).alias("box"))
    month = F.lpad((F.col("o_orderkey") % 12 + 1).cast("string"), 2, "0")
    items = F.array(item(F.col("o_orderstatus"), 40, 34), item(month, 30, 4), item(F.lit("EXP"), 5, 30), item(F.lit("2026"), 0, 0))
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("image_id"), geometry.reading_order(items).alias("text"))


@query("q_p4_detector_lines", """WITH b AS (SELECT l_orderkey, l_linenumber, (l_partkey - 100)::DOUBLE AS x1, l_suppkey::DOUBLE AS y1, l_partkey + l_quantity AS x2, l_suppkey + l_quantity AS y2 FROM lineitem),
    c AS (SELECT l_orderkey, l_linenumber, least(greatest(x1, 0), 1000) AS a, least(greatest(y1, 0), 60) AS b, least(greatest(x2, 0), 1000) AS c, least(greatest(y2, 0), 60) AS d FROM b)
    SELECT l_orderkey, l_linenumber, CASE WHEN c > a AND d > b THEN printf('%d %.6f %.6f %.6f %.6f', l_linenumber % 4, (a + c) / 2 / 1000, (b + d) / 2 / 60, (c - a) / 1000, (d - b) / 60) END AS line FROM c""")  # fmt: skip
def q_detector_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, y, q = F.col("l_partkey").cast("double"), F.col("l_suppkey").cast("double"), F.col("l_quantity")
    box = geometry.normalized_box(x - 100, y, x + q, y + q, F.lit(1000.0), F.lit(60.0))
    return table(spark, sf_dir, "lineitem").select(*KEYS, bind(box, lambda b: geometry.detector_line(F.col("l_linenumber") % 4, b)).alias("line"))


def signs(spark: SparkSession, sf_dir: str) -> DataFrame:
    word = F.aggregate(F.col("embedding"), F.lit(0).cast("bigint"), lambda acc, x: F.call_function("shiftleft", acc, F.lit(1)).bitwiseOR((x > 0).cast("bigint")))
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("image_id"), F.array(word).alias("h"))


def altered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same hashes under other ids, their last bits turned: as many as the id's remainder by 14."""
    turned = F.call_function("shiftleft", F.lit(1).cast("bigint"), (F.col("image_id") % 14).cast("int")) - 1
    rows = signs(spark, sf_dir).withColumn("h", F.transform("h", lambda w: w.bitwiseXOR(turned)))
    return rows.withColumn("image_id", F.col("image_id") + 1_000_000_000)


HASHES = """h AS (SELECT vec_id, array_to_string(list_transform(embedding, lambda x: CASE WHEN x > 0 THEN '1' ELSE '0' END), '') AS b FROM embeddings),
    o AS (SELECT h.vec_id + 1000000000 AS vec_id, left(h.b, (64 - h.vec_id % 14)::INT) || CASE WHEN h.vec_id % 14 > 0 THEN translate(right(h.b, (h.vec_id % 14)::INT), '01', '10') ELSE '' END AS b FROM h)"""


@query("q_g17_near_hashes", f"WITH {HASHES} SELECT h.vec_id AS left_id, o.vec_id AS right_id, hamming(h.b, o.b)::INTEGER AS distance FROM h JOIN o ON hamming(h.b, o.b) <= 10")
def q_near_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.near_pairs(signs(spark, sf_dir), altered(spark, sf_dir), most=10, bits=64)


@query("q_j8_nearest_used", f"""WITH {HASHES}, d AS (SELECT h.vec_id AS image_id, o.vec_id AS near_id, hamming(h.b, o.b)::INTEGER AS distance FROM h JOIN o ON hamming(h.b, o.b) <= 12)
    SELECT image_id, near_id, distance FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY distance, near_id) AS n FROM d) WHERE n = 1""")  # fmt: skip
def q_nearest_used(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.nearest_used(signs(spark, sf_dir), altered(spark, sf_dir), most=12, bits=64)


@query("q_g16_hash_bits", """WITH p AS (SELECT o_orderkey, list_transform(range(256), lambda i: ((o_orderkey * 31 + i * i * 7) % 256)::DOUBLE) AS x FROM orders)
    SELECT o_orderkey AS image_id, w.j::INTEGER AS word, list_sum(list_transform(list_slice(x, w.j * 64 + 1, w.j * 64 + 64), lambda v: (v > list_avg(x))::INT))::INTEGER AS above FROM p, (SELECT unnest(range(4)) AS j) w""")  # fmt: skip
def q_hash_bits(spark: SparkSession, sf_dir: str) -> DataFrame:
    pixels = F.transform(F.sequence(F.lit(0), F.lit(255)), lambda i: ((F.col("o_orderkey") * 31 + i * i * 7) % 256).cast("double"))
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("image_id"), F.posexplode(geometry.hash_bits(pixels)).alias("word", "w"))
    return rows.select("image_id", "word", F.bit_count("w").alias("above"))


@query("q_j6_far_from_used", """WITH h AS (SELECT vec_id, array_to_string(list_transform(embedding, lambda x: CASE WHEN x > 0 THEN '1' ELSE '0' END), '') AS b FROM embeddings)
    SELECT vec_id AS image_id FROM h a WHERE vec_id % 3 = 0 AND NOT EXISTS (SELECT 1 FROM h u WHERE u.vec_id % 3 <> 0 AND hamming(a.b, u.b) <= 8)""")  # fmt: skip
def q_far_from_used(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = signs(spark, sf_dir)
    return sampling.far_from(h.where("image_id % 3 = 0"), h.where("image_id % 3 <> 0"), most=8, bits=64).select("image_id")


# --- scores

def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as labels: a date from the key, a batch, a status, two tags; some blank, some held."""
    k = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(
        k.cast("string").alias("image_id"), F.when(k % 13 == 0, F.lit(None).cast("string")).otherwise((F.lit(2020) + k % 7).cast("string")).alias("year"), (k % 12 + 1).cast("string").alias("month"), F.when(k % 9 == 0, "NONE").otherwise((k % 28 + 1).cast("string")).alias("day"),
        F.get(F.array(*map(F.lit, "ABCDEFG")), (k % 7).cast("int")).alias("batch"), F.when(k % 17 == 0, "보류").otherwise("완료").alias("status"), F.when(k % 4 == 0, "TRUE").when(k % 4 == 1, "1").otherwise("").alias("tag_dot"), F.when(k % 6 == 0, "true").otherwise("FALSE").alias("tag_multidate"),
    )


def predicted(spark: SparkSession, sf_dir: str, shift: int) -> DataFrame:
    """Predictions for most of them: some fields off, some ``NONE``, some missing."""
    k = F.col("c_custkey")
    return table(spark, sf_dir, "customer").where((k + shift) % 10 != 0).select(
        F.lpad(k.cast("string"), F.greatest(F.lit(6), F.length(k.cast("string"))), F.lit("0")).alias("image_id"), F.when((k + shift) % 5 == 0, "NONE").otherwise((F.lit(2020) + k % 7).cast("string")).alias("year"), F.when((k + shift) % 8 == 0, "01").otherwise(F.lpad((k % 12 + 1).cast("string"), 2, "0")).alias("month"),
        F.when((k + shift) % 5 == 0, "NONE").otherwise(F.lpad((k % 28 + 1).cast("string"), 2, "0")).alias("day"),
    )


def scores_sql(shift: int, name: str) -> str:
    return f"""{name} AS (SELECT c_custkey AS k, CASE c_custkey % 7 WHEN 0 THEN 'A-C' WHEN 1 THEN 'A-C' WHEN 2 THEN 'A-C' WHEN 3 THEN 'D+E' WHEN 4 THEN 'D+E' ELSE 'F' END AS grp, c_custkey % 13 <> 0 AND (c_custkey + {shift}) % 5 <> 0 AS oy,
        (c_custkey + {shift}) % 8 <> 0 OR c_custkey % 12 = 0 AS om, CASE WHEN (c_custkey + {shift}) % 5 = 0 THEN c_custkey % 9 = 0 ELSE c_custkey % 9 <> 0 END AS od FROM customer WHERE c_custkey % 17 <> 0 AND (c_custkey + {shift}) % 10 <> 0)"""


MEASURES = "count(*)::BIGINT AS n, avg((oy::INT + om::INT + od::INT) / 3.0::DOUBLE) AS partial, avg((oy AND om AND od)::INT) AS exact, avg(oy::INT) AS year, avg(om::INT) AS month, avg(od::INT) AS day, 1.0::DOUBLE AS coverage, avg((oy AND om AND od)::INT) AS exact_of_answered"


def score_rows(spark: SparkSession, sf_dir: str, shift: int = 3) -> DataFrame:
    p = evaluation.normalized(predicted(spark, sf_dir, shift))
    t = evaluation.done(evaluation.normalized(labelled(spark, sf_dir), evaluation.BLANK_LABEL))
    return evaluation.scored(evaluation.restricted(t, p, always=True), p, ("batch", "tag_dot", "tag_multidate"))


@query("q_e4_summary", f"WITH {scores_sql(3, 's')} SELECT {MEASURES} FROM s")
def q_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.summary(score_rows(spark, sf_dir))


@query("q_e5_exact_of_answered", f"""WITH {scores_sql(3, 's')}, c AS (SELECT oy AND om AND od AND (k + 3) % 5 <> 0 AS exact, (k + 3) % 5 <> 0 AS covered FROM s)
    SELECT avg(covered::INT) AS coverage, avg(exact::INT) AS exact, sum((exact AND covered)::INT)::DOUBLE / sum(covered::INT) AS exact_of_answered FROM c""")  # fmt: skip
def q_exact_of_answered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With predictions that have no field at all: those count for the exact share, but not for that of the answered."""
    p = predicted(spark, sf_dir, 3).withColumn("month", F.when(F.col("year") == "NONE", "NONE").otherwise(F.col("month")))
    t = evaluation.done(evaluation.normalized(labelled(spark, sf_dir), evaluation.BLANK_LABEL))
    return evaluation.summary(evaluation.scored(t.join(p, "image_id", "left_semi"), evaluation.normalized(p))).select("coverage", "exact", "exact_of_answered")


@query("q_e3_restricted", """SELECT 'fewer' AS predictions, count(*)::BIGINT AS n FROM customer WHERE c_custkey % 17 <> 0 AND (c_custkey + 3) % 10 <> 0
    UNION ALL SELECT 'as many', count(*)::BIGINT FROM customer WHERE c_custkey % 17 <> 0 UNION ALL SELECT 'as many, always', count(*)::BIGINT FROM customer WHERE c_custkey % 17 <> 0 AND (c_custkey + 3) % 10 <> 0""")  # fmt: skip
def q_restricted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels are restricted to the predicted ids where there are fewer predictions than labels, or always on request."""
    t = evaluation.done(evaluation.normalized(labelled(spark, sf_dir), evaluation.BLANK_LABEL))
    few = evaluation.normalized(predicted(spark, sf_dir, 3))
    many = few.unionByName(few.withColumn("image_id", F.concat(F.lit("other"), "image_id")))
    n = lambda name, rows: rows.agg(F.lit(name).alias("predictions"), F.count(F.lit(1)).alias("n"))
    return n("fewer", evaluation.restricted(t, few)).unionByName(n("as many", evaluation.restricted(t, many))).unionByName(n("as many, always", evaluation.restricted(t, many, always=True)))


@query("q_e7_by_group", f"WITH {scores_sql(3, 's')} SELECT coalesce(grp, 'all') AS grp, {MEASURES} FROM s GROUP BY ROLLUP (grp) HAVING coalesce(grp, 'all') <> 'F'")
def q_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.by_group(score_rows(spark, sf_dir))


@query("q_e9_sealed_shown", f"WITH {scores_sql(3, 's')} SELECT coalesce(grp, 'all') AS grp, {MEASURES} FROM s GROUP BY ROLLUP (grp)")
def q_sealed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.by_group(score_rows(spark, sf_dir), show_sealed=True)


@query("q_e8_by_tag", f"""WITH {scores_sql(3, 's')}, t AS (SELECT unnest(['dot']) AS tag, oy AND om AND od AS exact FROM s WHERE k % 4 IN (0, 1) UNION ALL SELECT 'multidate', oy AND om AND od FROM s WHERE k % 6 = 0 UNION ALL SELECT 'plain', oy AND om AND od FROM s WHERE k % 4 NOT IN (0, 1) AND k % 6 <> 0)
    SELECT tag, count(*)::BIGINT AS n, avg(exact::INT) AS exact FROM t GROUP BY tag HAVING count(*) >= 3 OR tag = 'plain'""")  # fmt: skip
def q_by_tag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.by_tag(score_rows(spark, sf_dir), ["tag_dot", "tag_multidate"])


@query("q_e10_paired", f"""WITH {scores_sql(3, 'a')}, {scores_sql(5, 'b')}, j AS (SELECT a.grp, (a.oy::INT + a.om::INT + a.od::INT) / 3.0::DOUBLE AS x, (b.oy::INT + b.om::INT + b.od::INT) / 3.0::DOUBLE AS z FROM a LEFT JOIN b ON a.k = b.k)
    SELECT coalesce(grp, 'all') AS grp, count(*)::BIGINT AS n, count(*) FILTER (z > x)::BIGINT AS up, count(*) FILTER (z < x)::BIGINT AS down, avg(z) - avg(x) AS change, (count(*) - count(*) FILTER (z > x) - count(*) FILTER (z < x))::BIGINT AS same FROM j GROUP BY ROLLUP (grp)""")  # fmt: skip
def q_paired(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.paired_counts(evaluation.paired(score_rows(spark, sf_dir, 3), score_rows(spark, sf_dir, 5)))


@query("q_e11_sign_test", """WITH c AS (SELECT n_nationkey AS k, (n_nationkey * 3 % 11)::BIGINT AS up, (n_nationkey * 5 % 7)::BIGINT AS down FROM nation),
    t AS (SELECT k, up, down, list_sum(list_transform(range(0, least(up, down) + 1), lambda i: (factorial((up + down)::INTEGER) / (factorial(i::INTEGER) * factorial((up + down - i)::INTEGER)))::DOUBLE)) AS c FROM c)
    SELECT k, up, down, CASE WHEN up + down = 0 THEN 1.0::DOUBLE ELSE least(1.0::DOUBLE, 2 * c / pow(2.0::DOUBLE, up + down)) END AS p FROM t""")  # fmt: skip
def q_sign_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("n_nationkey")
    rows = table(spark, sf_dir, "nation").select(k.alias("k"), (k * 3 % 11).cast("long").alias("up"), (k * 5 % 7).cast("long").alias("down"))
    return rows.withColumn("p", evaluation.sign_test_column(F.col("up"), F.col("down")))


@query("q_e12_least_effect", "SELECT n_nationkey AS k, 2.8016::DOUBLE * 26.1::DOUBLE / sqrt(n_nationkey + 1) AS points FROM nation")
def q_least_effect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k"), evaluation.least_effect(F.col("n_nationkey") + 1).alias("points"))


@query("q_e_bootstrap")
def q_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.bootstrap(evaluation.paired(score_rows(spark, sf_dir, 3), score_rows(spark, sf_dir, 5)), rounds=200)


@query("q_n8_padded", "SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN lpad(c_custkey::VARCHAR, greatest(6, length(c_custkey::VARCHAR))::INTEGER, '0') WHEN c_custkey % 3 = 1 THEN 'cust_' || c_custkey ELSE (c_custkey + 12345670)::VARCHAR END AS image_id FROM customer")
def q_padded(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    raw = F.when(k % 3 == 0, F.concat(F.lit(" "), k.cast("string"))).when(k % 3 == 1, F.concat(F.lit("cust_"), k.cast("string"))).otherwise((k + 12345670).cast("string"))
    return table(spark, sf_dir, "customer").select("c_custkey", textnorm.padded(raw, 6).alias("image_id"))


# --- label quality

def flawed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as label rows with one flaw each, by the key's remainder."""
    k = F.col("c_custkey") % 14
    pick = lambda default, **at: _cases(k, default, at)
    blank = F.lit("")
    return table(spark, sf_dir, "customer").select(
        F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("image_id"), pick("2026", _0="", _3="26", _8="2036", _9="NONE", _1="").alias("year"), pick("02", _0="", _4="2", _5="13", _9="NONE", _12="NONE", _1="").alias("month"), pick("11", _0="", _6="30", _7="32", _9="NONE", _11="11", _1="").alias("day"),
        pick("2026-02-11", _0="", _1="", _3="26-02-11", _4="2026-2-11", _5="2026-13-11", _6="2026-02-30", _7="2026-02-32", _8="2036-02-11", _9="NONE", _10="2026-02-12", _12="2026-NONE-11").alias("final_date"), pick("완료", _0="", _1="보류", _2="미완료").alias("status"),
        F.when(k == 11, "TRUE").otherwise("FALSE").alias("tag_ymonly"), F.when(k == 13, "maybe").otherwise("").alias("tag_dot"), F.when(k == 13, blank).otherwise("2026.02.11").alias("notation_raw"),
    )


def _cases(k: Column, default: str, at: dict[str, str]) -> Column:
    out = F.when(F.lit(False), F.lit(""))
    for key, value in at.items():
        out = out.when(k == int(key[1:]), F.lit(value))
    return out.otherwise(F.lit(default))


RULES = {0: ["empty_row"], 2: ["status"], 3: ["year_format", "year_range"], 4: ["month_format"], 5: ["month_range"], 6: ["no_such_day"], 7: ["day_range"], 8: ["year_range"], 10: ["final_date"], 11: ["ymonly_with_day"], 12: ["day_without_month"], 13: ["tag_value", "no_notation"]}
WARN = ("empty_row", "year_range", "day_without_month", "no_notation")


@query("q_q_row_rules", "SELECT 'c' || c_custkey AS image_id, CASE WHEN r.rule IN (" + ", ".join(f"'{w}'" for w in WARN) + ") THEN 'warn' ELSE 'error' END AS severity, r.rule FROM customer JOIN (VALUES " + ", ".join(f"({k}, '{r}')" for k, rs in RULES.items() for r in rs) + ") r(k, rule) ON c_custkey % 14 = r.k")
def q_row_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.row_rules(flawed(spark, sf_dir)).drop("detail")


@query("q_q1_duplicates", "SELECT trim(c_mktsegment) AS image_id, count(*)::BIGINT AS n FROM customer GROUP BY 1 HAVING count(*) > 1")
def q_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.duplicates(table(spark, sf_dir, "customer").select(F.concat(F.lit(" "), "c_mktsegment").alias("image_id")))


@query("q_q2_missing_ghost", "SELECT doc_id::VARCHAR AS image_id, 'missing' AS rule FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) UNION ALL SELECT DISTINCT (doc_id + 1000000000)::VARCHAR, 'ghost' FROM labels WHERE doc_id % 5 = 0")
def q_missing_ghost(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels")
    rows = labels.select(F.col("doc_id").cast("string").alias("image_id")).unionByName(labels.where("doc_id % 5 = 0").select((F.col("doc_id") + 1000000000).cast("string").alias("image_id")))
    return quality.missing_and_ghosts(rows, table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("image_id")))


@query("q_q12_cases", "SELECT 'c' || c_custkey AS case_id, r.rule FROM customer JOIN (VALUES (0, 'empty_text'), (1, 'final_date')) r(k, rule) ON c_custkey % 5 = r.k")
def q_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey") % 5
    return quality.check_cases(table(spark, sf_dir, "customer").select(
        F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("case_id"), F.when(k == 0, " ").otherwise("EXP 02/2026").alias("input_text"), F.lit("2026").alias("expect_year"), F.lit("02").alias("expect_month"), F.when(k == 2, "").otherwise("NONE").alias("expect_day"), F.when(k == 1, "2026-02").otherwise("2026-02-NONE").alias("expect_final_date"),
    ))


@query("q_a2_value_counts", "SELECT 'lang' AS \"column\", lang AS value, count(*)::BIGINT AS n FROM documents GROUP BY lang UNION ALL SELECT 'source', source, count(*)::BIGINT FROM documents GROUP BY source")
def q_value_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.value_counts(table(spark, sf_dir, "documents"), ["lang", "source"])


@query("q_a3_group_count", "SELECT count(DISTINCT CASE WHEN c_custkey % 3 = 0 THEN c_name ELSE c_mktsegment END)::BIGINT AS groups FROM customer")
def q_group_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.group_count(table(spark, sf_dir, "customer").select(F.col("c_name").alias("image_id"), F.when(F.col("c_custkey") % 3 == 0, "").otherwise(F.col("c_mktsegment")).alias("group_id")))


@query("q_a5_tag_summary", "SELECT count(*) FILTER (k NOT IN (0, 1, 2))::BIGINT AS done, count(*) FILTER (k NOT IN (0, 1, 2, 11))::BIGINT AS plain, count(*) FILTER (k = 9)::BIGINT AS unreadable, count(*) FILTER (k = 11)::BIGINT AS tag_ymonly, 0::BIGINT AS tag_dot FROM (SELECT c_custkey % 14 AS k FROM customer)")
def q_tag_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.tag_summary(flawed(spark, sf_dir))


# --- selection

@query("q_p1_split_sizes", "SELECT lang, 'val' AS part, greatest(1, round_even(count(*) * 0.1::DOUBLE, 0))::BIGINT AS n FROM documents GROUP BY lang UNION ALL SELECT lang, 'train', (count(*) - greatest(1, round_even(count(*) * 0.1::DOUBLE, 0)))::BIGINT FROM documents GROUP BY lang")
def q_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.split(table(spark, sf_dir, "documents").select("doc_id", "lang"), "lang", "doc_id").groupBy("lang", "part").agg(F.count(F.lit(1)).alias("n"))


@query("q_p3_manifest", "SELECT sha256(string_agg(n_nationkey::VARCHAR, ',' ORDER BY n_nationkey)) AS manifest, count(*)::BIGINT AS n FROM nation")
def q_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.manifest_hash(table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("image_id"), F.col("n_nationkey").alias("order")))


@query("q_j5_unused", "SELECT DISTINCT lpad(doc_id::VARCHAR, greatest(6, length(doc_id::VARCHAR))::INTEGER, '0') AS image_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def q_unused(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = lambda name: table(spark, sf_dir, name).select(F.col("doc_id").cast("string").alias("image_id"))
    return sampling.unused(ids("documents"), ids("labels"))


@query("q_j5_present", "SELECT DISTINCT lpad(doc_id::VARCHAR, greatest(6, length(doc_id::VARCHAR))::INTEGER, '0') AS image_id FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")
def q_present(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = lambda name: table(spark, sf_dir, name).select(F.col("doc_id").cast("string").alias("image_id"))
    return sampling.present(ids("documents"), ids("labels"))


@query("q_a6_top_two", "SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS n FROM orders) WHERE n <= 2")
def q_top_two(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as boxes: the two surest of an image, equal ones by their place."""
    orders = table(spark, sf_dir, "orders").select("o_custkey", F.lit("full").alias("cls"), F.col("o_orderkey").alias("x1"), F.col("o_totalprice").alias("y1"), F.lit(0.0).alias("x2"), F.lit(0.0).alias("y2"), F.col("o_totalprice").alias("conf"))
    return cascade.regions(orders, "o_custkey").select("o_custkey", F.col("x1").cast("long").alias("o_orderkey"), F.col("y1").alias("o_totalprice"))


# --- sources

@query("q_s8_complete", "SELECT doc_id::VARCHAR AS image_id, CASE WHEN q IS NULL THEN 'NONE' ELSE '2026' END AS year, CASE WHEN q IS NULL THEN 'NONE' ELSE '0' || q END AS month, 'NONE' AS day, CASE WHEN q IS NULL THEN 'NONE' ELSE '2026-0' || q || '-NONE' END AS final_date FROM documents LEFT JOIN (SELECT doc_id, quality AS q FROM labels) USING (doc_id)")
def q_complete(spark: SparkSession, sf_dir: str) -> DataFrame:
    month = F.concat(F.lit("0"), F.col("quality").cast("string"))
    found = table(spark, sf_dir, "labels").select(F.col("doc_id").cast("string").alias("image_id"), F.lit("2026").alias("year"), month.alias("month"), F.lit("NONE").alias("day"), F.concat(F.lit("2026-"), month, F.lit("-NONE")).alias("final_date"))
    return tables.complete_submission(table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("image_id")), found)


@query("q_s4_listed", "SELECT doc_id::VARCHAR AS image_id, n_chars FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")
def q_listed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only the images of a list, which names some twice and some that are not there."""
    ids = table(spark, sf_dir, "labels").select(F.col("doc_id").cast("string").alias("image_id"))
    return image_source.only(table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("image_id"), "n_chars"), ids.union(ids).union(ids.select(F.concat("image_id", F.lit("x")))))


@query("q_s13_appended", "SELECT 'cust_' || lpad((c + row_number() OVER (ORDER BY src))::VARCHAR, 4, '0') AS image_id, src AS src_file FROM (SELECT 'f' || lpad(doc_id::VARCHAR, 9, '0') AS src, (SELECT count(*) FROM documents WHERE doc_id % 2 = 0) AS c FROM documents WHERE doc_id % 2 = 1)")
def q_appended(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("f"), F.lpad(F.col("doc_id").cast("string"), 9, "0")).alias("src_file"))
    number = (F.col("doc_id") / 2 + 1).cast("long").cast("string")  # four digits at least: ``lpad`` alone would cut longer ones
    have = docs.where("doc_id % 2 = 0").select("src_file", F.concat(F.lit("cust_"), F.lpad(number, F.greatest(F.lit(4), F.length(number)), F.lit("0"))).alias("image_id"))
    return tables.appended(have, docs.select("src_file"))


@query("q_s16_verified", "SELECT 'd' || doc_id AS name, CASE WHEN doc_id % 7 = 0 THEN 'mismatch' WHEN doc_id % 11 = 0 THEN 'missing' ELSE 'ok' END AS state FROM documents")
def q_verified(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("path"), F.encode("text", "UTF-8").alias("content"), F.length("text").alias("length"))
    expected = docs.select(F.col("path").alias("name"), F.when(F.col("doc_id") % 7 == 0, "0" * 64).otherwise(F.upper(F.sha2("content", 256))).alias("sha256"))
    return image_source.verified(docs.where("doc_id % 11 <> 0 or doc_id % 7 = 0"), expected).select("name", "state")


@query("q_n9_file_stem", "SELECT p_partkey, 'img.' || p_partkey AS image_id FROM part")
def q_file_stem(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", textnorm.file_stem(F.concat(F.lit("/a/b.c/img."), F.col("p_partkey").cast("string"), F.lit(".JPG"))).alias("image_id"))


@query("q_p8_error_rows", "SELECT p_partkey::VARCHAR AS image_id, 1::INTEGER AS stage, CASE WHEN p_partkey % 5 = 0 THEN '' ELSE 'EXP ' || p_size END AS text, CASE WHEN p_partkey % 5 = 0 THEN 'load_fail' END AS error FROM part")
def q_error_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The image boundary with the text provider: images that cannot be decoded are rows with an error."""
    said = F.when(F.col("p_partkey") % 5 == 0, "").otherwise(F.concat(F.lit("EXP "), F.col("p_size").cast("string")))
    images = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("image_id"), F.encode(said, "UTF-8").alias("content"))
    return stage_texts(images, TextProvider, 1, True).select("image_id", "stage", "text", "error")


@query("q_v7_month_numbers", "SELECT o_orderkey, month(o_orderdate)::INTEGER AS m FROM orders")
def q_month_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", dates.month_number(F.lower(notation.PARTS["MON"](F.col("o_orderdate")))).alias("m"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["q_k5_made_and_expiry"](spark, sf_dir)
