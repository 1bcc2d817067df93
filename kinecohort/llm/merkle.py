"""A dataset manifest as a content-addressed tree: digests name the records of their children, proofs descend from the root."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinecohort.llm.common import ascii_lower, pick
from kinecohort.operators.order import POSITION, positioned
from kinecohort.operators.skew import lookup_join
from kinecohort.sources.shared import materialize

#: Children of a node at most, and the bits of a rank that choose one of them.
FANOUT = 8
DIGIT = 3

#: The columns that a leaf covers, in order.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def field(value: Column) -> Column:
    """`-` for null, else the value's bytes in UTF-8, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(*values: Column) -> Column:
    return F.sha2(F.concat(*[field(v) for v in values]), 256)


@dataclass(frozen=True)
class Manifest:
    """Written tables of a tree over groups of leaves.

    leaves: group (a number, in the order of the group's key), rank (within it), leaf, and the columns that were asked for.
    groups: group, key, size (leaves), subroot. records: digest and children (digests, left to right) of every inner node.
    """

    leaves: DataFrame
    groups: DataFrame
    records: DataFrame
    root: str | None
    subroots: int


def _grow(nodes: DataFrame, largest: int, label: str) -> tuple[DataFrame, list[DataFrame]]:
    """The last node of every group (group, digest), and the records on the way. nodes: group, rank, digest, n (of its group)."""
    records = []
    done = nodes.filter("n = 1").select("group", "digest")
    while largest > 1:
        place = F.col("rank").bitwiseAND(F.lit(FANOUT - 1))
        runs = nodes.filter("n > 1").groupBy("group", F.shiftright("rank", DIGIT).alias("rank"))
        # Runs have FANOUT members, so what is gathered is bounded.
        above = runs.agg(F.first("n").alias("n"), F.sort_array(F.collect_list(F.struct(place.alias("at"), "digest"))).alias("run"))
        above = above.select("group", "rank", F.ceil(F.col("n") / FANOUT).cast("long").alias("n"), F.col("run.digest").alias("children"))
        above = materialize(above.withColumn("digest", F.sha2(F.concat_ws("", "children"), 256)), label)
        records.append(above.select("digest", "children"))
        nodes = above.select("group", "rank", "digest", "n")
        done = done.union(nodes.filter("n = 1").select("group", "digest"))
        largest = -(-largest // FANOUT)
    return done, records


def build(leaves: DataFrame, by: str, order: list[str], digest: str = "leaf") -> Manifest:
    """The tree over leaves, one subtree for each value of `by` (null first, strings by their bytes).

    Within a subtree leaves ascend by `order`, then by their digests; equal rows are leaves each. Every 8 consecutive
    nodes become one until one is left; subroots, in the order of `by`, likewise give the root. Leaves are sorted by
    ranges and get their ranks from positions in the whole table, so a group may hold any share of the rows.
    """
    spark = leaves.sparkSession
    sort = [by, *[c for c in order if c != by], *([digest] if digest not in order else [])]
    placed = positioned(leaves, sort)
    groups = placed.groupBy(by).agg(F.min(POSITION).alias("start"), F.count("*").alias("size"))
    groups = materialize(positioned(groups, [by]).withColumnRenamed(POSITION, "group"), "groups")
    table = groups.select(F.col(by), "group", "start", "size", F.col("size").alias("_weight"))
    ranked = lookup_join(placed, table, [by], "_weight", null_safe=True, written=True, spread_by=[POSITION])
    ranked = ranked.withColumn("rank", F.col(POSITION) - F.col("start")).drop(POSITION, "start")
    ranked = materialize(ranked, "leaves")
    largest, subroots = groups.agg(F.coalesce(F.max("size"), F.lit(0)), F.count("*")).first()
    nodes = ranked.select("group", "rank", F.col(digest).alias("digest"), F.col("size").alias("n"))
    tops, records = _grow(nodes, largest, "nodes")
    tops = materialize(groups.join(tops.withColumnRenamed("digest", "subroot"), "group"), "subroots")
    over = tops.select(F.lit(0).alias("group"), F.col("group").alias("rank"), F.col("subroot").alias("digest"), F.lit(subroots).alias("n"))
    root, above = _grow(over, subroots, "over")
    first = root.first()
    every = _union(spark, [*records, *above], "digest string, children array<string>").dropDuplicates(["digest"])
    return Manifest(ranked, tops, materialize(every, "records"), first["digest"] if first else None, subroots)


def _union(spark: SparkSession, frames: list[DataFrame], schema: str) -> DataFrame:
    out = spark.createDataFrame([], schema)
    for frame in frames:
        out = out.union(frame)
    return out


def _depth(n: int) -> int:
    depth = 0
    while n > 1:
        n, depth = -(-n // FANOUT), depth + 1
    return depth


def _descend(frontier: DataFrame, requests: DataFrame, records: DataFrame, left: int, depth: Column) -> DataFrame:
    """frontier (group, prefix, digest, path, and what else it has) one level down.

    Only children that requests (group, rank) ask for are kept; left is the number of levels below the children. Each
    record is looked up once by its digest, whatever the number of requests that go through it. path gets the children
    that were not selected: their digests left and right of the one that was.
    """
    here = frontier.filter(depth > left)
    waiting = frontier.filter(depth <= left)
    met = here.join(records.withColumnRenamed("digest", "_named"), F.col("digest") == F.col("_named"))
    names = [c for c in frontier.columns if c not in ("prefix", "digest", "path")]
    opened = met.select(*names, "prefix", "path", "children", F.posexplode("children").alias("_at", "_child"))
    before = F.concat_ws("", F.expr("slice(children, 1, _at)"))
    after = F.concat_ws("", F.expr("slice(children, _at + 2, size(children))"))
    segment = F.struct(before.alias("before"), after.alias("after"))
    below = opened.select(
        *names,
        (F.col("prefix") * FANOUT + F.col("_at")).alias("prefix"),
        F.col("_child").alias("digest"),
        F.concat("path", F.array(segment)).alias("path"),
    )
    asked = requests.select(F.col("group").alias("_g"), F.shiftright("rank", DIGIT * left).alias("_p")).distinct()
    kept = below.join(asked, (F.col("group") == F.col("_g")) & (F.col("prefix") == F.col("_p")), "left_semi")
    return kept.unionByName(waiting.select(*kept.columns))


_PATH = "array<struct<before:string,after:string>>"


def prove(manifest: Manifest, requests: DataFrame) -> DataFrame:
    """requests (group, rank, and other columns) with their subroot and path, from the leaf's run up to the root's.

    Requests descend from the root by the digits of their group's place among the subroots and then of their rank,
    together as long as their digits agree. A path segment holds the digests left and right of the selected child. The
    last level is not spread over a row for each leaf: requests meet their run, which has up to 8 leaves. Requests for
    places that the tree does not have are dropped.
    """
    spark = manifest.leaves.sparkSession
    extra = [c for c in requests.columns if c not in ("group", "rank")]
    asked = materialize(requests, "requests")
    wanted = asked.select(F.lit(0).alias("group"), F.col("group").alias("rank")).distinct()
    frontier = spark.createDataFrame([(0, 0, manifest.root, [])] if manifest.root else [], f"group int, prefix long, digest string, path {_PATH}")
    levels = _depth(manifest.subroots)
    for left in reversed(range(levels)):
        frontier = _descend(frontier, wanted, manifest.records, left, F.lit(levels))
    sizes = manifest.groups.select("group", "size")
    tops = frontier.select(F.col("prefix").alias("group"), F.col("digest").alias("subroot"), "path").join(sizes, "group")
    tops = tops.select("group", "subroot", F.lit(0).cast("long").alias("prefix"), F.col("subroot").alias("digest"), "path", "size")
    largest = manifest.groups.agg(F.coalesce(F.max("size"), F.lit(0))).first()[0]
    # Levels of a subtree: the least d with FANOUT ** d >= size.
    level = sum([F.when(F.col("size") > FANOUT**d, 1).otherwise(0) for d in range(_depth(largest))], F.lit(0))
    runs = tops.withColumn("levels", level)
    for left in reversed(range(1, _depth(largest))):
        narrow = asked.select("group", "rank")
        runs = materialize(_descend(runs, narrow, manifest.records, left, F.col("levels")), "frontier")
    # Runs of leaves with their children; a lone leaf is its subroot and has no run.
    named = manifest.records.withColumnRenamed("digest", "_named")
    full = runs.filter("levels > 0").join(named, F.col("digest") == F.col("_named")).drop("_named")
    lone = runs.filter("levels = 0").withColumn("children", F.array().cast("array<string>"))
    runs = full.unionByName(lone.select(*full.columns)).select(F.col("group").alias("_g"), F.col("prefix").alias("_p"), "subroot", "path", "children")
    met = asked.join(runs, (F.col("group") == F.col("_g")) & (F.shiftright("rank", DIGIT) == F.col("_p")))
    at = F.col("rank").bitwiseAND(F.lit(FANOUT - 1)).cast("int")
    met = met.withColumn("_at", at).filter("size(children) = 0 AND rank = 0 OR _at < size(children)")
    before = F.concat_ws("", F.expr("slice(children, 1, _at)"))
    after = F.concat_ws("", F.expr("slice(children, _at + 2, 8)"))
    own = F.when(F.size("children") == 0, F.array().cast(_PATH)).otherwise(F.array(F.struct(before.alias("before"), after.alias("after"))))
    # From the root downwards so far; a proof is read from the leaf upwards.
    return met.select("group", "rank", *extra, "subroot", F.concat(own, F.reverse("path")).alias("path"))


def fold(leaf: Column, path: str = "path") -> Column:
    """The root that a leaf and its path give."""
    return F.aggregate(path, leaf, lambda digest, s: F.sha2(F.concat(s["before"], digest, s["after"]), 256))


def siblings(path: str = "path") -> Column:
    """The digests of a path, level by level from the leaf, each left to right."""
    return F.concat_ws("", F.transform(path, lambda s: F.concat(s["before"], s["after"])))


def tampered(doc_id: Column) -> Column:
    """Whether 3 divides the checksum of the id; a null id is left alone."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 0, F.lit(False))


def manifest_of(docs: DataFrame, presented: Column | None = None) -> Manifest:
    """The tree over the rows of docs (doc_id, source, lang, n_chars, text), by lang and doc_id; leaves also have doc_id and
    `presented`: the leaf of the row with its text as somebody else presents it (by default as it is).

    Nulls are leaves' fields like any other; null ids come first. Rows of one id are ordered by their leaves, repeated rows
    are leaves each. An empty table gives a tree without a root.
    """
    rows = pick(docs, *FIELDS)
    leaf = leaf_digest(*[F.col(c) for c in FIELDS])
    other = leaf if presented is None else leaf_digest(*[F.col(c) for c in FIELDS[:-1]], presented)
    # Only digests are sorted and shuffled; the texts are read once.
    named = rows.select("doc_id", "lang", leaf.alias("leaf"), other.alias("presented"))
    return build(materialize(named, "digests"), "lang", ["doc_id", "leaf"])


def audit(docs: DataFrame) -> DataFrame:
    """Every row's leaf, subroot, root and proof, and whether the row, tampered with in places, still verifies.

    Tampering lower-cases A-Z of the text where `tampered` says so. proof_sha256 is the digest of the siblings (of
    nothing, in a tree of one leaf). An empty table gives no rows.
    """
    text = F.when(tampered(F.col("doc_id")), ascii_lower(F.col("text"))).otherwise(F.col("text"))
    manifest = manifest_of(docs, text)
    requests = manifest.leaves.select("group", "rank", "doc_id", "leaf", "presented")
    proved = prove(manifest, requests)
    root = F.lit(manifest.root)
    folded = proved.select(
        "doc_id", "leaf", "subroot", root.alias("root"), F.sha2(siblings(), 256).alias("proof_sha256"), fold(F.col("presented")).alias("folded_root")
    )
    return folded.withColumn("verified", F.col("folded_root") == root)


#: Bits of the id's digits, lowest first, go through the checksum one by one. Trees grow level by level, and proofs fold alike.
SQL = """
WITH RECURSIVE rows_ AS (
  SELECT row_number() OVER () AS r, doc_id, lang, source, n_chars, text,
    list_reduce(
      list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(doc_id::VARCHAR, ''),
        lambda c: list_transform(range(8), lambda b: (ord(c) >> b) & 1)))),
      lambda crc, bit: CASE WHEN xor(crc, bit) & 1 = 1 THEN xor(crc >> 1, 3988292384) ELSE crc >> 1 END) AS crc
  FROM documents
), seen AS (
  SELECT *, CASE WHEN doc_id IS NOT NULL AND xor(crc, 4294967295) % 3 = 0
    THEN translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE text END AS other FROM rows_
), heads AS (
  SELECT *, coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id::VARCHAR, '-') || coalesce(strlen(source) || ':' || source, '-')
    || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars::VARCHAR, '-') AS head FROM seen
), leaves AS (
  SELECT r, doc_id, lang, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
    sha256(head || coalesce(strlen(other) || ':' || other, '-')) AS presented FROM heads
), numbered AS (
  SELECT *, dense_rank() OVER (ORDER BY lang NULLS FIRST) AS g,
    row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS k, count(*) OVER (PARTITION BY lang) AS n
  FROM leaves
), tree AS (
  SELECT 0 AS level, g, k, n, leaf AS digest FROM numbered
  UNION ALL
  SELECT any_value(level) + 1, g, k // 8, (any_value(n) + 7) // 8, sha256(string_agg(digest, '' ORDER BY k)) FROM tree WHERE n > 1 GROUP BY g, k // 8
), subroots AS (
  SELECT g - 1 AS k, digest, count(*) OVER () AS n FROM tree WHERE n = 1
), over_ AS (
  SELECT 0 AS level, k, n, digest FROM subroots
  UNION ALL
  SELECT any_value(level) + 1, k // 8, (any_value(n) + 7) // 8, sha256(string_agg(digest, '' ORDER BY k)) FROM over_ WHERE n > 1 GROUP BY k // 8
), sides AS (
  SELECT a.level, a.g, a.k, coalesce(string_agg(b.digest, '' ORDER BY b.k) FILTER (WHERE b.k < a.k), '') AS before,
    coalesce(string_agg(b.digest, '' ORDER BY b.k) FILTER (WHERE b.k > a.k), '') AS after
  FROM tree a JOIN tree b ON a.level = b.level AND a.g = b.g AND a.k // 8 = b.k // 8 WHERE a.n > 1 GROUP BY a.level, a.g, a.k
), tops AS (
  SELECT a.level, a.k, coalesce(string_agg(b.digest, '' ORDER BY b.k) FILTER (WHERE b.k < a.k), '') AS before,
    coalesce(string_agg(b.digest, '' ORDER BY b.k) FILTER (WHERE b.k > a.k), '') AS after
  FROM over_ a JOIN over_ b ON a.level = b.level AND a.k // 8 = b.k // 8 WHERE a.n > 1 GROUP BY a.level, a.k
), inside AS (
  SELECT r, g, 0 AS level, k, n, presented AS digest, '' AS proof FROM numbered
  UNION ALL
  SELECT i.r, i.g, i.level + 1, i.k // 8, (i.n + 7) // 8, sha256(s.before || i.digest || s.after), i.proof || s.before || s.after
  FROM inside i JOIN sides s ON i.level = s.level AND i.g = s.g AND i.k = s.k
), above AS (
  SELECT i.r, 0 AS level, i.g - 1 AS k, t.n, i.digest, i.proof FROM inside i JOIN subroots t ON t.k = i.g - 1 WHERE i.n = 1
  UNION ALL
  SELECT a.r, a.level + 1, a.k // 8, (a.n + 7) // 8, sha256(t.before || a.digest || t.after), a.proof || t.before || t.after
  FROM above a JOIN tops t ON a.level = t.level AND a.k = t.k
)
SELECT l.doc_id, l.leaf, s.digest AS subroot, o.digest AS root, sha256(a.proof) AS proof_sha256, a.digest AS folded_root,
  a.digest = o.digest AS verified
FROM numbered l JOIN subroots s ON s.k = l.g - 1 JOIN above a ON a.r = l.r AND a.n = 1 CROSS JOIN (SELECT digest FROM over_ WHERE n = 1) o
"""
