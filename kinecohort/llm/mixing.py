"""Mixing sources to target weights by Efraimidis-Spirakis sampling; DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinecohort.llm.common import pick
from kinecohort.sources.shared import materialize

#: A source's documents are ordered in this many parts by the range of their keys.
PARTS = 1024
#: Weights of the sources, in the order of their names, repeating.
CYCLE = (1, 2, 3)
#: A source is repeated so many times at most.
CAP = 3
#: Weight of a document by its quality label; unlabelled ones weigh as good ones.
QUALITY = {0: 0.5, 1: 1.0}


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, cycle: tuple[int, ...] = CYCLE, cap: int = CAP) -> DataFrame:
    """source, source_size and target of each source.

    Sources by code point, null last, weigh as the cycle says and share the sum of all sizes; no target exceeds cap
    times its source's size, and the excess is shared by weight among the others until none is above. In the order
    of size per weight, sources are capped as long as their cap is below what the level reached so far gives them.
    There is one row per source here, so the windows over all of them hold as many rows as there are sources.
    """
    weighed = sizes.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    weighed = weighed.withColumn("weight", F.array(*[F.lit(w) for w in cycle])[(F.col("rank") - 1) % len(cycle)])
    weighed = weighed.withColumn("most", cap * F.col("source_size"))
    everything = Window.partitionBy()
    before = Window.orderBy(F.col("most") / F.col("weight"), "rank").rowsBetween(Window.unboundedPreceding, -1)
    weighed = weighed.withColumn(
        "level",
        (F.sum("source_size").over(everything) - F.coalesce(F.sum("most").over(before), F.lit(0)))
        / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0))),
    )
    free = F.col("most") / F.col("weight") > F.col("level")
    first = F.min(F.when(free, F.struct(F.col("most") / F.col("weight"), "rank", "level"))).over(everything)["level"]
    target = F.least(F.col("most").cast("double"), F.coalesce(first * F.col("weight"), F.col("most").cast("double")))
    return weighed.select("source", "source_size", target.alias("target"))


def uniform(doc_id: Column, seed: int = 0) -> Column:
    """A number between 0 and 1 that depends on the id and the seed alone."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"))
    return (F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") + 0.5) / float(1 << 48)


def mix(
    docs: DataFrame, seed: int = 0, cycle: tuple[int, ...] = CYCLE, cap: int = CAP, parts: int = PARTS
) -> DataFrame:
    """What the mix takes of each document: columns doc_id, source, size and weight give those and
    source_size, target, copies and taken (copies times size).

    A source gives as many complete epochs as its target holds; what is left of the target is filled with its documents
    in the order of -ln(u) / weight, whole, as long as the middle of the document lies within it. So a source misses
    its target by half a document at most, and a document of size 0 is in the complete epochs only. A null weight
    counts as 1, weights below 1e-6 as 1e-6, a null size as 0, a null source is a source. Repeated rows are taken one
    by one; ties of key go by id and size. u depends on id and seed, so reruns agree. An empty table gives an empty one.

    No source is ordered in one task: its documents are parted by ranges of their keys, summed up to the part before,
    and ordered within the part; equal rows are one row with a count until the end.
    """
    weight = F.greatest(F.coalesce(F.col("weight").cast("double"), F.lit(1.0)), F.lit(1e-6))
    rows = pick(docs, "doc_id", "source", "size", "weight").select(
        "doc_id", "source", F.coalesce(F.col("size"), F.lit(0)).cast("long").alias("size"), weight.alias("weight")
    )
    rows = rows.groupBy("doc_id", "source", "size", "weight").agg(F.count("*").alias("n"))
    rows = rows.withColumn("key", -F.log(uniform(F.col("doc_id"), seed)) / F.col("weight"))
    rows = rows.withColumn("part", F.floor(parts * (1 - F.exp(-F.col("key")))).cast("int"))
    sums = rows.groupBy("source", "part").agg(F.sum(F.col("n") * F.col("size")).alias("part_size"))
    earlier = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.withColumn("offset", F.coalesce(F.sum("part_size").over(earlier), F.lit(0)))
    shares = targets(sums.groupBy("source").agg(F.sum("part_size").alias("source_size")), cycle, cap)
    s, o = shares.alias("s"), offsets.alias("o")
    placed = o.join(s, F.col("o.source").eqNullSafe(F.col("s.source"))).select(
        F.col("o.source").alias("of"), F.col("o.part").alias("at"), "offset", "source_size", "target"
    )
    within = Window.partitionBy("source", "part").orderBy("key", "doc_id", "size", "weight")
    ordered = rows.withColumn("so_far", F.sum(F.col("n") * F.col("size")).over(within) - F.col("n") * F.col("size"))
    joined = ordered.join(placed, F.col("source").eqNullSafe(F.col("of")) & (F.col("part") == F.col("at")))
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    joined = joined.withColumn("epochs", epochs)
    joined = joined.withColumn("left", F.col("target") - F.col("epochs") * F.col("source_size"))
    each = joined.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("i"))
    middle = F.col("offset") + F.col("so_far") + F.col("i") * F.col("size") + F.col("size") / 2
    chosen = (F.col("size") > 0) & (middle < F.col("left"))
    each = each.withColumn("copies", F.col("epochs") + chosen.cast("long"))
    taken = (F.col("copies") * F.col("size")).alias("taken")
    return each.select("doc_id", "source", "size", "source_size", "target", "copies", taken)


def with_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs (doc_id, source, size) with a weight by their label; of several labels, the best."""
    marks = pick(labels, "doc_id", "quality").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    weight = F.create_map(*[F.lit(x) for kv in QUALITY.items() for x in kv])[F.col("quality")]
    marks = marks.select(F.col("doc_id").alias("marked"), weight.alias("weight"))
    joined = docs.join(marks, F.col("doc_id") == F.col("marked"), "left")
    return joined.select("doc_id", "source", "size", F.coalesce("weight", F.lit(1.0)).alias("weight"))


def mixed_rows(docs: DataFrame, labels: DataFrame, seed: int = 0) -> DataFrame:
    """Rows of docs (doc_id, source, text and others), each as often as the mix takes it, with all columns.

    Documents are found again by their ids, so these must differ. Documents without an id cannot be named by a decision:
    they have no part in the mix and stay once. Documents of size 0 come as often as their source has complete epochs.
    """
    named = docs.filter(docs["doc_id"].isNotNull())
    sized = pick(named, "doc_id", "source", "text").select("doc_id", "source", word_count(F.col("text")).alias("size"))
    taken = mix(with_quality(materialize(sized, "sizes"), labels), seed).filter("copies > 0")
    taken = taken.select(F.col("doc_id").alias("taken_id"), F.col("copies").alias("taken_copies"))
    joined = named.join(taken, named["doc_id"] == taken["taken_id"])
    again = F.explode(F.sequence(F.lit(1).cast("long"), taken["taken_copies"])).alias("taken_copy")
    rows = joined.select(*[named[c] for c in named.columns], again).select(*[F.col(c) for c in named.columns])
    return rows.unionByName(docs.filter(docs["doc_id"].isNull()))


SQL = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size
  FROM documents),
marks AS (SELECT doc_id, CASE WHEN max(quality) = 0 THEN 0.5 ELSE 1.0 END AS weight FROM labels GROUP BY doc_id),
keyed AS (
  SELECT s.*, -ln((CAST(CAST('0x' || substr(md5('0:' || CAST(s.doc_id AS VARCHAR)), 1, 12) AS BIGINT) AS DOUBLE) + 0.5)
    / 281474976710656.0) / coalesce(CAST(m.weight AS DOUBLE), 1.0) AS key
  FROM sized s LEFT JOIN marks m USING (doc_id)),
totals AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
ranked AS (
  SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS rank, 3 * source_size AS most FROM totals),
weighed AS (SELECT *, 1 + (rank - 1) % 3 AS weight FROM ranked),
levels AS (
  SELECT *, CAST(CAST(sum(source_size) OVER () AS BIGINT) - coalesce(CAST(sum(most) OVER before AS BIGINT), 0) AS DOUBLE)
    / CAST(CAST(sum(weight) OVER () AS BIGINT) - coalesce(CAST(sum(weight) OVER before AS BIGINT), 0) AS DOUBLE) AS level
  FROM weighed
  WINDOW before AS (ORDER BY CAST(most AS DOUBLE) / CAST(weight AS DOUBLE), rank
                    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
first_free AS (
  SELECT level AS reached FROM levels WHERE CAST(most AS DOUBLE) / CAST(weight AS DOUBLE) > level
  ORDER BY CAST(most AS DOUBLE) / CAST(weight AS DOUBLE), rank LIMIT 1),
shares AS (
  SELECT source, source_size, least(CAST(most AS DOUBLE),
    coalesce((SELECT reached FROM first_free) * weight, CAST(most AS DOUBLE))) AS target
  FROM levels),
placed AS (
  SELECT k.doc_id, k.size, s.source_size, s.target,
    CASE WHEN s.source_size > 0 THEN CAST(floor(s.target / s.source_size) AS BIGINT) ELSE 0 END AS epochs,
    CAST(sum(k.size) OVER (PARTITION BY k.source ORDER BY k.key, k.doc_id, k.size
                           ROWS UNBOUNDED PRECEDING) AS BIGINT) - k.size AS so_far
  FROM keyed k JOIN shares s ON k.source IS NOT DISTINCT FROM s.source)
SELECT doc_id, size, source_size, target,
  size * (epochs + CASE WHEN size > 0 AND so_far + CAST(size AS DOUBLE) / 2 < target - epochs * source_size
                        THEN 1 ELSE 0 END) AS taken
FROM placed
"""
