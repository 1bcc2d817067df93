"""Quality rules as a ledger of failure bits and measurements; DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinecohort.llm.common import pick

#: Words of a window that is looked for again in the same text.
WINDOW = 8
MEASURES = ("n_words", "word_chars", "n_symbols", "n_digits", "n_lines", "n_dup_lines", "n_repeat_words")
#: Rules in the order of their bits; each is a condition on the measurements under which a text fails.
RULES: dict[str, str] = {
    "few_words": "n_words < 20",
    "repeated_words": "100 * n_repeat_words > 30 * n_words",
    "many_symbols": "10 * n_symbols > word_chars",
    "repeated_lines": "10 * n_dup_lines > 3 * n_lines",
    "short_words": "10 * word_chars < 15 * n_words",
    "long_words": "word_chars > 25 * n_words",
    "many_digits": "10 * n_digits > 4 * word_chars",
    "no_words": "n_words = 0",
}
#: Versions of the policy: which rules reject a text.
POLICIES: dict[int, tuple[str, ...]] = {
    1: ("few_words", "repeated_words"),
    2: tuple(RULES),
}
LATEST = 2


def bit(rule: str) -> int:
    return 1 << list(RULES).index(rule)


def mask(policy: int) -> int:
    return sum(bit(r) for r in POLICIES[policy])


def _repeated(hashes: str, n: str) -> str:
    """Words that lie in a window whose hash occurs again: from the places of such windows in order, each adds what
    lies before the next. Only texts with a repeated hash are sorted."""
    return f"""
      CASE WHEN size(array_distinct({hashes})) = size({hashes}) THEN CAST(0 AS BIGINT) ELSE
        aggregate(
          array_sort(flatten(transform(array(sort_array(transform({hashes}, (h, i) -> struct(h AS h, i AS i)))), s ->
            filter(
              transform(s, (x, k) -> CASE
                WHEN (k > 0 AND s[greatest(k - 1, 0)].h = x.h)
                  OR (k < size(s) - 1 AND s[least(k + 1, size(s) - 1)].h = x.h) THEN x.i END),
              x -> x IS NOT NULL)))),
          struct(CAST(0 AS BIGINT) AS covered, -{WINDOW} AS last),
          (a, i) -> struct(a.covered + least({WINDOW}, i - a.last) AS covered, i AS last),
          a -> a.covered) END"""


def ledger(docs: DataFrame) -> DataFrame:
    """doc_id, the measurements and `failures`, in which the bit of each rule that the whole text fails is set.

    Words are what lies between ASCII white space; lines are parted by \\n. A null text counts as empty: no words, so it
    fails for few words. Null ids and repeated rows are kept; an empty table gives an empty one. Every rule is
    evaluated once, whatever policy is applied afterwards.
    """
    rows = pick(docs, "doc_id", "text").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    read = rows.select(
        "doc_id",
        F.expr(r"regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+', 0)").alias("words"),
        F.expr(r"length(regexp_replace(text, '[\\x20\\x09-\\x0D]+', ''))").cast("long").alias("word_chars"),
        F.expr(r"length(regexp_replace(text, '[^#*$%&|<>]+', ''))").cast("long").alias("n_symbols"),
        F.expr(r"length(regexp_replace(text, '[^0-9]+', ''))").cast("long").alias("n_digits"),
        F.expr(r"filter(split(text, '\n', -1), l -> l rlike '[^\\x20\\x09-\\x0D]')").alias("lines"),
    )
    windows = F.expr(f"""
      CASE WHEN size(words) > {WINDOW} THEN
        transform(sequence(0, size(words) - {WINDOW}), i -> xxhash64(slice(words, i + 1, {WINDOW})))
      ELSE CAST(array() AS ARRAY<BIGINT>) END""")
    counted = read.select(
        "doc_id",
        F.size("words").cast("long").alias("n_words"),
        "word_chars",
        "n_symbols",
        "n_digits",
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        windows.alias("windows"),
    )
    measured = counted.withColumn("n_repeat_words", F.expr(_repeated("windows", "n_words")))
    failures = sum((F.expr(rule).cast("long") * bit(name) for name, rule in RULES.items()), F.lit(0).cast("long"))
    return measured.select("doc_id", *MEASURES, failures.alias("failures"))


def passes(policy: int = LATEST) -> Column:
    """Whether a policy keeps a row of the ledger."""
    return F.col("failures").bitwiseAND(F.lit(mask(policy))) == 0


def ablation(rows: DataFrame, policy: int = LATEST) -> DataFrame:
    """For each rule of a policy: the rows that fail it, and those that no other rule of the policy rejects.

    Rows are counted by their failure bits first, so that at most a row for each combination of bits is shuffled.
    """
    by_bits = rows.groupBy(F.col("failures").bitwiseAND(F.lit(mask(policy))).alias("bits")).agg(F.count("*").alias("n"))
    rules = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(bit(r)).cast("long").alias("bit")) for r in POLICIES[policy]]))
    each = by_bits.select("bits", "n", rules.alias("r")).select("bits", "n", "r.rule", "r.bit")
    failed = F.col("bits").bitwiseAND(F.col("bit")) != 0
    return each.groupBy("rule").agg(
        F.coalesce(F.sum(F.when(failed, F.col("n"))), F.lit(0)).alias("failed"),
        F.coalesce(F.sum(F.when(F.col("bits") == F.col("bit"), F.col("n"))), F.lit(0)).alias("failed_alone"),
    )


def _sql() -> str:
    failures = " + ".join(f"CASE WHEN {rule} THEN {bit(name)} ELSE 0 END" for name, rule in RULES.items())
    return rf"""
WITH read AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS lines
  FROM documents),
windows AS (
  SELECT r, i, array_to_string(words[i:i + {WINDOW - 1}], ' ') AS w
  FROM (SELECT r, words, unnest(range(1, len(words) - {WINDOW - 2})) AS i FROM read WHERE len(words) > {WINDOW})),
again AS (SELECT r, i, lag(i) OVER (PARTITION BY r ORDER BY i) AS last
  FROM (SELECT r, i, count(*) OVER (PARTITION BY r, w) AS n FROM windows) WHERE n > 1),
covered AS (SELECT r, sum(least({WINDOW}, i - coalesce(last, i - {WINDOW}))) AS n FROM again GROUP BY r),
measured AS (
  SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words,
    CAST(length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(length(regexp_replace(text, '[^0-9]+', '', 'g')) AS BIGINT) AS n_digits,
    CAST(len(lines) AS BIGINT) AS n_lines, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words
  FROM read LEFT JOIN covered c USING (r)),
judged AS (SELECT *, CAST({failures} AS BIGINT) AS failures FROM measured)
SELECT doc_id, {", ".join(MEASURES)}, failures, (failures & {mask(1)}) <> 0 AS base_failed,
  (failures & {mask(LATEST)}) = 0 AS kept
FROM judged
"""


SQL = _sql()
