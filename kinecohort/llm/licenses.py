"""License scan with ordered signature rules; DataFrame functions only."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinecohort.llm.common import ascii_lower, pick
from kinecohort.llm.license_rules import RULES

#: Phrases that are found wherever their words stand, whatever the rules say.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
PRIORITIES = 4
_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_WORD_ANY_CASE = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def _over_words(pattern: str) -> str:
    """A pattern over texts in which every word has a space of its own on both sides."""
    choices = [f" {p} " for p in pattern.split("|")] if "(" not in pattern else [f" {pattern} "]
    # An optional space within a word ("gpl ?v3") joins or parts two words.
    return "|".join(c.replace(" ?", "\0")[1:-1].replace(" ", "  ").replace("\0", "(?:  )?").join("  ") for c in choices)


def rules() -> list[tuple[str, int, str, str]]:
    """Label, priority, keyword and pattern of each rule, in order."""
    read = []
    for line in RULES.strip().splitlines():
        head, keyword, pattern = (part.strip() for part in line.split("|", 2))
        label, priority = head.split()
        read.append((label, int(priority), keyword, _over_words(pattern)))
    return read


def _gate() -> list[str]:
    """Strings of which every text with a match has one, in lower case."""
    keywords = {k for _, _, k, _ in rules()} | {"general", "cc", "reserved"}
    return sorted(k for k in keywords if not any(o != k and o in k for o in keywords))


def _literal(values: list[tuple]) -> str:
    quoted = lambda v: str(v) if isinstance(v, int) else "'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'"
    rows = [f"struct({i} AS rule, " + ", ".join(f"{quoted(v)} AS {n}" for v, n in zip(row, ("label", "priority", "keyword", "pattern"))) + ")" for i, row in enumerate(values)]
    return f"array({', '.join(rows)})"


def _n_words(text: str) -> str:
    return f"CAST((length({text}) - length(replace({text}, ' ', ''))) / 2 AS INT)"


def _matches(found: str, rule_table: str) -> str:
    """Matches of every rule whose keyword the text has: what lies between them, and themselves."""
    return f"""
      filter(
        transform(
          filter({rule_table}, r -> contains({found}, r.keyword)),
          r -> struct(r.rule, r.label, r.priority,
            regexp_extract_all({found}, r.pattern, 0) AS hits, split({found}, r.pattern, -1) AS parts)),
        r -> size(r.hits) > 0)"""


def _running(values: str, size: str, combine: str, finish: str = "a -> a") -> str:
    """Running totals of an array: each element is combined with the total that ends `d` places before it, for d = 1, 2, 4 ...

    combine: a lambda's body over x (an element), and a and i - d (where the other one stands, or none). An array of n takes
    log2(n) rounds over it, so time does not grow with the square of a text's matches.
    """
    rounds = f"slice(sequence(0, 30), 1, CAST(ceil(log2(greatest(1, {size}))) AS INT))"
    return f"aggregate({rounds}, {values}, (a, j) -> transform(a, (x, i) -> {combine.replace('i - d', 'i - shiftleft(1, j)')}), {finish})"


def _places(matches: str) -> str:
    """Start and end in words of every match: the words up to its end, and that without its own."""
    words = f"zip_with(slice(r.parts, 1, size(r.hits)), r.hits, (p, h) -> {_n_words('p')} + {_n_words('h')})"
    ends = _running(
        words,
        "size(r.hits)",
        "x + coalesce(get(a, i - d), 0)",
        f"""a -> transform(a, (e, k) -> struct(
          r.rule AS rule, r.label AS label, r.priority AS priority, e - {_n_words("r.hits[k]")} AS s, e AS e))""",
    )
    return f"flatten(transform({matches}, r -> {ends}))"


def _unsuppressed(places: str) -> str:
    """Matches that no match of the same or a higher priority contains; of equal ones, the first rule's stays.

    In the order of start, and longest first, what contains a match comes before it: so the farthest end so far, for
    each priority, decides.
    """
    levels = range(PRIORITIES + 1)
    ordered = f"transform({places}, d -> struct(d.s AS s, -d.e AS e, -d.priority AS p, d.rule AS rule, d.label AS label))"
    own = ", ".join(f"CASE WHEN -d.p >= {p} THEN -d.e ELSE -1 END AS r{p}" for p in levels)
    farther = ", ".join(f"greatest(x.r{p}, coalesce(get(a, i - d).r{p}, -1)) AS r{p}" for p in levels)
    before = "CASE x.d.p " + " ".join(f"WHEN {-p} THEN a[i - 1].r{p}" for p in levels) + " END"
    return _running(
        f"transform(sort_array({ordered}), d -> struct(d AS d, {own}))",
        f"size({places})",
        f"struct(x.d AS d, {farther})",
        f"""a -> transform(
          filter(a, (x, i) -> i = 0 OR {before} < -x.d.e),
          x -> struct(x.d.rule AS rule, x.d.label AS label, -x.d.p AS priority, x.d.s AS s, -x.d.e AS e))""",
    )


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, base places, and detections (rule, label, priority, first word, word after the last) of every
    whole text.

    Words are runs of letters and digits in lower case (A-Z only). base_starts are all places of the base phrases,
    base_labels their labels; detections are the matches of the rules that are left after suppression. A null or empty
    text has no words and empty lists. Null ids and repeated rows are kept; an empty table gives an empty one.

    Texts without any keyword are done after a look for those; in the others, a rule's expression is tried only where
    its own keyword stands.
    """
    rows = pick(docs, "doc_id", "text").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    lower = rows.withColumn("lower", F.lower("text"))
    candidate = F.lit(False)
    for keyword in _gate():
        candidate = candidate | F.contains("lower", F.lit(keyword))
    gated = lower.select(
        "doc_id", "text", F.regexp_count("text", F.lit(_WORD_ANY_CASE)).cast("long").alias("n_words"), candidate.alias("candidate")
    )
    spaced = F.concat(F.lit(" "), F.array_join(F.regexp_extract_all(ascii_lower(F.col("text")), F.lit(_WORD), F.lit(0)), "  "), F.lit(" "))
    normal = gated.select("doc_id", "n_words", F.when(F.col("candidate"), spaced).otherwise("").alias("found"))
    base = [(label, PRIORITIES, phrase.split()[0], _over_words(phrase)) for phrase, label in BASE.items()]
    matched = normal.select(
        "doc_id",
        "n_words",
        F.expr(_matches("found", _literal(base))).alias("base"),
        F.expr(_matches("found", _literal(rules()))).alias("matches"),
    )
    placed = matched.select("doc_id", "n_words", F.expr(_places("base")).alias("base"), F.expr(_places("matches")).alias("places"))
    return placed.select(
        "doc_id",
        "n_words",
        F.expr("transform(base, d -> d.s)").alias("base_starts"),
        F.expr("array_sort(array_distinct(transform(base, d -> d.label)))").alias("base_labels"),
        F.expr(_unsuppressed("places")).alias("detections"),
    )


def summary(scanned: DataFrame) -> DataFrame:
    """One row of figures for each row of a scan; the score is 1 - 2**-n for n detections and base places."""
    all_labels = F.expr("array_sort(array_distinct(concat(base_labels, transform(detections, d -> d.label))))")
    n_base, found = F.size("base_starts").cast("long"), F.size("detections").cast("long")
    return scanned.select(
        "doc_id",
        "n_words",
        n_base.alias("n_base"),
        F.array_min("base_starts").cast("long").alias("first_word"),
        F.array_max("base_starts").cast("long").alias("last_word"),
        F.array_join("base_labels", ",").alias("base_labels"),
        F.array_join(all_labels, ",").alias("labels"),
        found.alias("n_detections"),
        (1 - F.pow(F.lit(0.5), n_base + found)).alias("score"),
    )


def _sql() -> str:
    text = lambda s: "'" + s.replace("'", "''") + "'"
    given = [(i, label, p, pattern) for i, (label, p, _, pattern) in enumerate(rules())]
    given += [(-1 - i, label, 0, _over_words(phrase)) for i, (phrase, label) in enumerate(BASE.items())]
    values = ",\n".join(f"({i}, {text(label)}, {p}, {text(pattern)})" for i, label, p, pattern in given)
    keywords = "(" + "|".join(_gate()) + ")"
    words = "CAST((length({0}) - length(replace({0}, ' ', ''))) / 2 AS BIGINT)"
    return rf"""
WITH rules(rule, label, priority, pattern) AS (VALUES {values}),
texts AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_WORD}') AS words FROM documents),
normal AS (SELECT r, doc_id, len(words) AS n_words, ' ' || array_to_string(words, '  ') || ' ' AS found FROM texts),
matches AS (
  SELECT r, rule, label, priority, regexp_extract_all(found, pattern) AS hits, string_split_regex(found, pattern) AS parts
  FROM (SELECT * FROM normal WHERE regexp_matches(found, '{keywords}')), rules
  WHERE regexp_matches(found, pattern)),
each AS (SELECT r, rule, label, priority, k, hits[k] AS hit, parts[k] AS part
  FROM (SELECT *, unnest(range(1, len(hits) + 1)) AS k FROM matches)),
sized AS (SELECT *, {words.format("part")} AS p, {words.format("hit")} AS h FROM each),
ends AS (SELECT *, CAST(sum(p + h) OVER (PARTITION BY r, rule ORDER BY k) AS BIGINT) AS e FROM sized),
places AS (SELECT r, rule, label, priority, e - h AS s, e FROM ends),
kept AS (
  SELECT * FROM places d WHERE rule >= 0 AND NOT EXISTS (
    SELECT 1 FROM places c WHERE c.r = d.r AND c.rule >= 0 AND c.s <= d.s AND c.e >= d.e AND c.priority >= d.priority
      AND (c.s < d.s OR c.e > d.e OR c.priority > d.priority OR c.rule < d.rule))),
base AS (SELECT r, count(*) AS n, min(s) AS first_word, max(s) AS last_word,
    string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM places WHERE rule < 0 GROUP BY r),
labelled AS (SELECT r, string_agg(DISTINCT label, ',' ORDER BY label) AS labels
  FROM (SELECT r, label FROM kept UNION ALL SELECT r, label FROM places WHERE rule < 0) GROUP BY r),
counted AS (SELECT r, count(*) AS n FROM kept GROUP BY r)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, coalesce(b.n, 0) AS n_base, first_word, last_word,
  coalesce(b.labels, '') AS base_labels, coalesce(l.labels, '') AS labels, coalesce(c.n, 0) AS n_detections,
  1 - pow(0.5, coalesce(b.n, 0) + coalesce(c.n, 0)) AS score
FROM normal LEFT JOIN base b USING (r) LEFT JOIN labelled l USING (r) LEFT JOIN counted c USING (r)
"""


SQL = _sql()
