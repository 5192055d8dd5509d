"""Mixing sources to target weights (operator 9) by Pareto order sampling.

Sources share the words of the mix by weight; a target stops at MAX_REPEAT times its source's words and the excess goes to
the others by weight. A document's expected copies are its source's target over its source's words (times the document's
own weight, if one is given). Whole copies are certain. For the fraction left, documents are ranked by random odds over
inclusion odds, (U / (1 - U)) / (p / (1 - p)), and taken in that order while the words taken stay nearest to what the
source still lacks. Where a long document at the end leaves a gap, the one document whose words fill it best is taken (or
left) as well. U comes from a hash of the id, so reruns agree.

The order is cut by one threshold for each source. It is found from sums over buckets of the order, so no task sees more
than a bucket of a hot source, and it is applied where the rows are: texts are not shuffled. Equal places in the order
are taken or left together.

Defined cases: null text has no words; a null source is a source of its own, after all others; a null id draws by its
text; rows that repeat an id are drawn together; a source without words has target 0 and no copies; empty tables give
empty results; columns named like an added one are replaced.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import WORD_PATTERN, cut, plain_text, replacing, table

WEIGHTS = (1, 2, 3)
MAX_REPEAT = 3
SEED = "mix-1"
#: Places in the order that make a bucket, on average.
BUCKET = 2000
#: Sources up to which their plan (some 100 bytes each) is broadcast, so that texts needn't move; beyond, Spark picks the join.
BROADCAST_SOURCES = 100_000
ADDED = ("size", "source_size", "target", "copies", "taken")


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """sources(source, source_size, ...) with weight and target. One row for each source, so one task holds them all.

    A source is at its limit where the sum of all targets, with every weight's share set at that source's limit, still
    lacks words: that orders sources by limit over weight and needs no rounds.
    """
    by_name = Window.partitionBy(F.lit(0)).orderBy(F.asc_nulls_last("source"))
    all_of = Window.partitionBy(F.lit(0))
    upto = all_of.orderBy("ratio").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    kinds = F.array(*[F.lit(w) for w in weights])
    out = sources.withColumn("weight", kinds[(F.row_number().over(by_name) - 1) % len(weights)])
    limit = F.lit(max_repeat) * F.col("source_size")
    out = out.withColumn("ratio", limit.cast("double") / F.col("weight"))
    out = out.withColumn("at_ratio", F.sum(limit).over(upto) + F.col("ratio") * (F.sum("weight").over(all_of) - F.sum("weight").over(upto)))
    out = out.withColumn("limited", F.col("at_ratio") < F.sum("source_size").over(all_of))
    free_words = F.sum("source_size").over(all_of) - F.sum(F.when(F.col("limited"), limit).otherwise(0)).over(all_of)
    free_weight = F.sum(F.when(F.col("limited"), 0).otherwise(F.col("weight"))).over(all_of)
    share = F.col("weight") * (free_words.cast("double") / free_weight)
    out = out.withColumn("target", F.when(F.col("limited"), limit.cast("double")).otherwise(F.least(share, limit.cast("double"))))
    return out.drop("ratio", "at_ratio", "limited")


def _drawn(docs: DataFrame, id_col: str, text_col: str, source_col: str, weight_col: str | None) -> DataFrame:
    """docs with __source, __size, __u (52 random bits) and __w."""
    who = F.coalesce(F.col(id_col).cast("string"), F.md5(plain_text(text_col)))
    u = F.conv(F.substring(F.md5(F.concat(F.lit(SEED + "|"), who)), 1, 13), 16, 10).cast("long")
    return docs.withColumns(
        {
            "__source": F.col(source_col),
            "__size": F.regexp_count(plain_text(text_col), F.lit(WORD_PATTERN)).cast("long"),
            "__u": u,
            "__w": F.coalesce(F.col(weight_col).cast("double"), F.lit(0.0)) if weight_col else F.lit(1.0),
        }
    )


def _placed(rows: DataFrame, plan: DataFrame, max_repeat: int) -> DataFrame:
    """rows joined to their source's plan, with whole copies and place in the order."""
    rows = rows.join(plan, F.col("__source").eqNullSafe(F.col("source_")))
    expected = F.when(F.col("weighted") > 0, F.least(F.lit(float(max_repeat)), F.col("target") * F.col("__w") / F.col("weighted"))).otherwise(0.0)
    rows = rows.withColumn("__e", expected).withColumn("__whole", F.floor("__e").cast("long"))
    p, u = F.col("__e") - F.col("__whole"), (F.col("__u") + F.lit(0.5)) / F.lit(float(1 << 52))
    place = F.when(p > 0, (u / (F.lit(1.0) - u)) / (p / (F.lit(1.0) - p))).otherwise(F.lit(float("inf")))
    return rows.withColumn("__p", p).withColumn("__q", place)


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weight_col: str | None = None,
    weights: tuple[int, ...] = WEIGHTS,
    max_repeat: int = MAX_REPEAT,
) -> DataFrame:
    """docs with size, source_size, target (of its source), copies and taken (words, repeats counted)."""
    narrow = cut(_drawn(docs, id_col, text_col, source_col, weight_col).select("__source", "__size", "__u", "__w"))
    sources = narrow.groupBy(F.col("__source").alias("source")).agg(
        F.sum("__size").alias("source_size"), F.sum(F.col("__w") * F.col("__size")).alias("weighted"), F.count(F.lit(1)).alias("rows_")
    )
    plan = cut(targets(sources, weights, max_repeat).withColumnRenamed("source", "source_"))
    placed = _placed(narrow, plan, max_repeat)
    certain = placed.groupBy("source_").agg(
        F.sum(F.col("__whole") * F.col("__size")).alias("certain"), F.avg("__p").alias("mean_p")
    )
    # What a source still lacks, and its buckets: places made even by the source's mean odds, so buckets are alike.
    ordered = placed.join(F.broadcast(cut(certain)).withColumnRenamed("source_", "s2"), F.col("source_").eqNullSafe(F.col("s2")))
    even = F.col("__q") * (F.col("mean_p") / (F.lit(1.0) - F.col("mean_p")))
    buckets = F.greatest(F.lit(1), F.ceil(F.col("rows_") / BUCKET))
    bucket = F.when(F.col("__q") == F.lit(float("inf")), buckets).otherwise(F.floor(even / (even + 1) * buckets)).cast("long")
    groups = cut(
        ordered.select("source_", F.coalesce(bucket, F.lit(0)).alias("bucket"), "__q", "__u", "__size", (F.col("target") - F.col("certain")).alias("lacks"))
        .groupBy("source_", "bucket", "__q", "__u", "lacks")
        .agg(F.sum("__size").alias("words"))
    )
    sums = groups.groupBy("source_", "bucket").agg(F.sum("words").alias("in_bucket"))
    before = F.sum("in_bucket").over(Window.partitionBy("source_").orderBy("bucket")) - F.col("in_bucket")
    sums = sums.select(F.col("source_").alias("s3"), F.col("bucket").alias("b3"), before.alias("before"))
    in_order = Window.partitionBy("source_", "bucket").orderBy("__q", "__u").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    chosen = 2 * (F.col("before") + F.col("upto")) - F.col("words") <= 2 * F.col("lacks")
    groups = cut(
        groups.withColumn("upto", F.sum("words").over(in_order))
        .join(sums, F.col("source_").eqNullSafe(F.col("s3")) & (F.col("bucket") == F.col("b3")))
        .select("source_", "lacks", "words", F.struct("__q", "__u").alias("place"), chosen.alias("chosen"))
    )
    taken = groups.groupBy(F.col("source_").alias("s4")).agg(
        F.max(F.when(F.col("chosen"), F.col("place"))).alias("last"),
        (F.first("lacks") - F.sum(F.when(F.col("chosen"), F.col("words")).otherwise(0))).alias("gap"),
    )
    plan = cut(plan.join(taken, F.col("source_").eqNullSafe(F.col("s4")), "left").drop("s4"))
    # One place more (or less) where that comes nearer: a large document at the threshold leaves a gap its size.
    left = F.abs(F.abs(F.col("gap")) - F.col("words"))
    fits = (F.col("words") > 0) & (F.col("place.__q") < float("inf")) & (left < F.abs(F.col("gap")))
    fits &= F.when(F.col("gap") > 0, ~F.col("chosen")).otherwise(F.col("chosen"))
    turned = (
        groups.join(plan.select(F.col("source_").alias("s5"), "gap"), F.col("source_").eqNullSafe(F.col("s5")))
        .where(fits)
        .groupBy(F.col("source_").alias("s6"))
        .agg(F.min_by("place", F.struct(left, "place")).alias("turned"))
    )
    plan = cut(plan.join(turned, F.col("source_").eqNullSafe(F.col("s6")), "left").drop("s6", "gap"))
    if plan.count() <= BROADCAST_SOURCES:
        plan = F.broadcast(plan)
    out = replacing(docs, *ADDED)
    names = out.columns
    out = _placed(_drawn(out, id_col, text_col, source_col, weight_col), plan, max_repeat)
    place = F.struct("__q", "__u")
    extra = F.when(F.coalesce(place <= F.col("last"), F.lit(False)) != F.coalesce(place == F.col("turned"), F.lit(False)), 1).otherwise(0)
    copies = F.when((F.col("source_size") > 0) & (F.col("__p") > 0), F.col("__whole") + extra).otherwise(F.col("__whole"))
    return out.select(
        *[F.col(f"`{c}`") for c in names], F.col("__size").alias("size"), "source_size", "target", copies.alias("copies"), (copies * F.col("__size")).alias("taken")
    )


def mixed_rows(docs: DataFrame, **settings) -> DataFrame:
    """docs as the mix has them: each row as often as it has copies."""
    found = mix(docs, **settings)
    repeat = F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("__copy")
    return found.where("copies > 0").select(*[F.col(f"`{c}`") for c in docs.columns], repeat).drop("__copy")


# ---------------------------------------------------------------- query
def op9_mixing(spark, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source")).select("doc_id", "size", "source_size", "target", "taken")


OP9_SQL = f"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS size,
         ('0x' || substr(md5('{SEED}|' || coalesce(CAST(doc_id AS VARCHAR), md5(coalesce(text, '')))), 1, 13))::BIGINT AS u
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight FROM s),
r AS (SELECT *, CAST(3 * source_size AS DOUBLE) / weight AS ratio FROM w),
g AS (SELECT *, CAST(sum(3 * source_size) OVER o AS DOUBLE) + ratio * CAST(sum(weight) OVER () - sum(weight) OVER o AS DOUBLE) AS at_ratio,
             CAST(sum(source_size) OVER () AS DOUBLE) AS total
      FROM r WINDOW o AS (ORDER BY ratio RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
f AS (SELECT *, at_ratio < total AS limited FROM g),
t AS (SELECT source, source_size,
             CASE WHEN limited THEN CAST(3 * source_size AS DOUBLE)
                  ELSE least(weight * ((total - CAST(sum(CASE WHEN limited THEN 3 * source_size ELSE 0 END) OVER () AS DOUBLE))
                                       / CAST(sum(CASE WHEN limited THEN 0 ELSE weight END) OVER () AS DOUBLE)),
                             CAST(3 * source_size AS DOUBLE)) END AS target
      FROM f),
e AS (SELECT doc_id, d.source, size, u, source_size, target,
             CASE WHEN source_size > 0 THEN least(3.0::DOUBLE, target * 1.0::DOUBLE / CAST(source_size AS DOUBLE)) ELSE 0.0::DOUBLE END AS e
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
p AS (SELECT *, CAST(floor(e) AS BIGINT) AS whole, e - floor(e) AS p, (u + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE AS x FROM e),
q AS (SELECT *, CASE WHEN p > 0 THEN (x / (1.0::DOUBLE - x)) / (p / (1.0::DOUBLE - p)) ELSE 'Infinity'::DOUBLE END AS q,
             target - CAST(sum(whole * size) OVER (PARTITION BY source) AS DOUBLE) AS lacks FROM p),
k AS (SELECT source, q, u, lacks, sum(size) AS words FROM q GROUP BY source, q, u, lacks),
c AS (SELECT *, sum(words) OVER (PARTITION BY source ORDER BY q, u ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto FROM k),
h AS (SELECT *, CAST(2 * upto - words AS DOUBLE) <= 2 * lacks AS chosen FROM c),
a AS (SELECT *, lacks - CAST(sum(CASE WHEN chosen THEN words ELSE 0 END) OVER (PARTITION BY source) AS DOUBLE) AS gap FROM h),
b AS (SELECT *, abs(abs(gap) - words) AS off,
             words > 0 AND q < 'Infinity'::DOUBLE AND abs(abs(gap) - words) < abs(gap) AND CASE WHEN gap > 0 THEN NOT chosen ELSE chosen END AS fits FROM a),
n AS (SELECT *, fits AND row_number() OVER (PARTITION BY source ORDER BY fits DESC, off, q, u) = 1 AS turned FROM b)
SELECT q.doc_id, CAST(q.size AS BIGINT) AS size, q.source_size, q.target,
       CAST(q.size * (whole + CASE WHEN p > 0 AND chosen <> turned THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM q JOIN n ON q.source IS NOT DISTINCT FROM n.source AND q.q = n.q AND q.u = n.u"""
