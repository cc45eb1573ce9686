"""Operator 3: mixing sources to target weights.

Words are summed per source with map-side partial sums; the per-source table
(one row per source) gets targets by water-filling; each document is then taken
floor(rate) times plus once more if a coin seeded by its id falls under the
fraction. All native. The per-source table is written, counted and broadcast
while it has at most ``BROADCAST_SOURCES`` rows, so no text is shuffled; a larger
one is joined as the optimizer finds, which splits a hot source.

Water-filling: sources share the total by weight, a target stops at ``cap``
times the source's size, and what is over goes to the others by weight until
none is above. Sorted by cap/weight, a source is at its cap exactly if its cap
is at most its share of what the sources before it leave; so two running sums
give the fixed point with no iteration.

Null text has size 0; null source is a source of its own, the last one; the coin
of a row with a null id is seeded by its text; repeated rows are taken alike; a
source without words has target 0; an empty table gives an empty mix. Extra
columns are carried along by ``mixed``, whatever their names.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Scratch

#: Weights of the sources in code point order of their names, repeating.
WEIGHTS = (5, 2, 1)
#: A target stops at so many times its source's size.
CAP = 3
#: Rows of the per-source table that are broadcast at most.
BROADCAST_SOURCES = 100_000


def n_words(text: Column) -> Column:
    """Runs of other than white space; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def coin(doc_id: Column, text: Column, seed: str = "mix") -> Column:
    """A number in [0, 1) that depends on the id (of a null id: on the text) and the seed only."""
    key = F.concat(F.lit(seed + ":"), F.coalesce(doc_id.cast("string"), F.concat(F.lit("null:"), F.md5(F.coalesce(text, F.lit(""))))))
    return F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """(source, source_size, target) from (source, source_size), a row per source.

    The windows are over that aggregated table only: a row per source."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    pick = F.array(*[F.lit(w).cast("long") for w in weights])
    s = sizes.withColumn("weight", F.element_at(pick, ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int")))
    s = s.withColumn("most", F.col("source_size") * cap)
    order = Window.orderBy((F.col("most").cast("double") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    before, every = order.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    s = s.withColumns(
        {
            "left_size": F.sum("source_size").over(every) - F.coalesce(F.sum("most").over(before), F.lit(0)),
            "left_weight": F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0)),
        }
    ).withColumn("full", F.col("most") * F.col("left_weight") <= F.col("weight") * F.col("left_size"))
    s = s.withColumns(
        {
            "open_size": F.sum("source_size").over(every) - F.sum(F.when(F.col("full"), F.col("most")).otherwise(0)).over(every),
            "open_weight": F.sum(F.when(F.col("full"), 0).otherwise(F.col("weight"))).over(every),
        }
    )
    share = (F.col("weight") * F.col("open_size")).cast("double") / F.col("open_weight").cast("double")
    return s.select("source", "source_size", F.when(F.col("full"), F.col("most").cast("double")).otherwise(share).alias("target"))


def _per_source(sized: DataFrame, weights: tuple[int, ...], cap: int, scratch: Scratch) -> DataFrame:
    """(_source, source_size, target, _rate), broadcast if that is small enough."""
    per = targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, cap)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    per = scratch.put(per.select(F.col("source").alias("_source"), "source_size", "target", rate.alias("_rate")), "per-source")
    return F.broadcast(per) if per.count() <= BROADCAST_SOURCES else per


def _copies(rate: Column, coin_: Column) -> Column:
    return (F.floor(rate) + F.when(coin_ < rate - F.floor(rate), 1).otherwise(0)).cast("long")


def rates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """Per document: id, size, source_size, target, copies, taken.

    Texts are read once: sizes and coins are a written table."""
    scratch = Scratch(docs.sparkSession, "mix")
    sized = docs.select(F.col(id_col).alias("_id"), F.col(source_col).alias("source"), n_words(F.col(text_col)).alias("size"), coin(F.col(id_col), F.col(text_col)).alias("_coin"))
    sized = scratch.put(sized, "sized")
    per = _per_source(sized, weights, cap, scratch)
    out = sized.join(per, sized.source.eqNullSafe(per._source)).withColumn("copies", _copies(F.col("_rate"), F.col("_coin")))
    return out.select(F.col("_id").alias(id_col), "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies")


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """The mix itself: each document of ``docs`` as often as it is taken."""
    scratch = Scratch(docs.sparkSession, "mixed")
    per = _per_source(docs.select(F.col(source_col).alias("source"), n_words(F.col(text_col)).alias("size")), weights, cap, scratch)
    copies, nth = _copies(per["_rate"], coin(docs[id_col], docs[text_col])), f"_copy_{uuid.uuid4().hex}"
    out = docs.join(per, docs[source_col].eqNullSafe(per["_source"])).where(copies > 0)
    return out.select(*[docs[c] for c in docs.columns], F.explode(F.sequence(F.lit(1), copies)).alias(nth)).drop(nth)


ORACLE = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
    'mix:' || coalesce(CAST(doc_id AS VARCHAR), 'null:' || md5(coalesce(text, ''))) AS seed
  FROM documents),
per AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
weighed AS (
  SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight,
    3 * source_size AS most, sum(source_size) OVER () AS total
  FROM per),
left_over AS (
  SELECT *, sum(weight) OVER () AS all_weight,
    coalesce(sum(most) OVER w, 0) AS most_before, coalesce(sum(weight) OVER w, 0) AS weight_before
  FROM weighed
  WINDOW w AS (ORDER BY CAST(most AS DOUBLE) / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
filled AS (
  SELECT *, most * (all_weight - weight_before) <= weight * (total - most_before) AS is_full FROM left_over),
targets AS (
  SELECT source, source_size,
    CASE WHEN is_full THEN CAST(most AS DOUBLE)
      ELSE CAST(weight * (total - sum(CASE WHEN is_full THEN most ELSE 0 END) OVER ()) AS DOUBLE)
        / CAST(sum(CASE WHEN is_full THEN 0 ELSE weight END) OVER () AS DOUBLE) END AS target
  FROM filled),
rated AS (
  SELECT d.doc_id, d.size, t.source_size, t.target,
    CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0::DOUBLE END AS rate,
    CAST(('0x' || substr(md5(d.seed), 1, 8)) AS BIGINT)::DOUBLE / 4294967296.0::DOUBLE AS coin
  FROM sized d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
  CAST(size * (floor(rate) + CASE WHEN coin < rate - floor(rate) THEN 1 ELSE 0 END) AS BIGINT) AS taken,
  CAST(floor(rate) + CASE WHEN coin < rate - floor(rate) THEN 1 ELSE 0 END AS BIGINT) AS copies
FROM rated
"""
