"""The stages on a small corpus, against plain decisions; and every operator on awkward tables."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from kinecohort.llm import decontamination, language, licenses, mixing, quality, shards, simhash, tokens, toxicity
from kinecohort.llm.queries import QUERIES
from tests.llm.test_methods import plain_components, plain_contamination, plain_fingerprint

SF_DIR = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def awkward(spark, tmp_path, empty=False):
    """Nulls in every column, empty and long texts, equal rows, and columns named as the operators name theirs."""
    long = " ".join(f"word{i % 977}" for i in range(60_000))
    rows = [
        (1, "The cat sat on the mat.", "en", "a", 23),
        (1, "The cat sat on the mat.", "en", "a", 23),
        (2, None, None, None, None),
        (3, "", "fr", "b", 0),
        (None, "No id has this text, but it has words.", "en", None, 5),
        (None, None, None, None, None),
        (4, long, "en", "b", len(long)),
        (5, "42 -- 17", "de", "a", 8),
        (6, "Der Hund und die Katze sind im Haus.", "de", "c", 36),
    ]
    df = spark.createDataFrame([] if empty else rows, SCHEMA)
    for c in ("fp", "score", "size", "weight", "key", "part", "slot", "n_tokens", "copies", "taken_id", "kept_id", "words", "distance", "check", "pid"):
        df = df.withColumn(c, F.lit("clash"))
    path = str(tmp_path / "docs")
    df.write.parquet(path)
    return spark.read.parquet(path)


OPERATORS = {
    "fingerprints": lambda d, s: simhash.near_duplicates(d),
    "keep_one": lambda d, s: simhash.keep_one(d),
    "languages": lambda d, s: language.identify(d, language.fit_languages(d)),
    "keep_known": lambda d, s: language.keep_known(d, language.fit_languages(d)),
    "tokens": lambda d, s: tokens.count_tokens(d),
    "licenses": lambda d, s: licenses.summary(licenses.scan(d)),
    "quality": lambda d, s: quality.ledger(d),
    "toxicity": lambda d, s: toxicity.score(d, toxicity.fit_toxicity(d, s.sql("SELECT 1L AS doc_id, 1 AS toxic UNION ALL SELECT NULL, NULL"))),
    "contamination": lambda d, s: decontamination.contamination(d, s.sql("SELECT 9 AS item_id, 'cat sat on the mat' AS text UNION ALL SELECT NULL, NULL")),
    "decontaminate": lambda d, s: decontamination.decontaminate(d, s.sql("SELECT 9 AS item_id, 'cat sat on the mat' AS text")),
    "mixed": lambda d, s: mixing.mixed_rows(d, s.sql("SELECT 1L AS doc_id, 0 AS quality UNION ALL SELECT NULL, NULL")),
    "shards": lambda d, s: shards.write_shards(d, length=512)[1],
}
COUNTS = {"fingerprints": 9, "languages": 9, "tokens": 9, "licenses": 9, "quality": 9, "toxicity": 9, "contamination": 2, "decontaminate": 7}
COUNTS |= {"keep_one": 7}


@pytest.mark.parametrize("name", OPERATORS)
def test_awkward_tables(spark, tmp_path, name):
    rows = OPERATORS[name](awkward(spark, tmp_path), spark).collect()
    assert len(rows) == COUNTS.get(name, len(rows)) and len(rows) > 0


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_tables(spark, tmp_path, name):
    assert OPERATORS[name](awkward(spark, tmp_path, empty=True), spark).collect() == []


def test_rows_without_an_id_stay(spark, tmp_path):
    docs = awkward(spark, tmp_path)
    # Null and empty texts are alike, so 2 stands for 3; both rows without an id stay.
    kept = [r.doc_id for r in simhash.keep_one(docs).collect()]
    assert sorted(i for i in kept if i is not None) == [1, 2, 4, 5, 6] and kept.count(None) == 2
    assert OPERATORS["mixed"](docs, spark).filter("doc_id IS NULL").count() == 2


def test_stages(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language_id", "near_dedup", "decontamination", "mixing", "token_shards"]
    stage = dict(corpus_pipeline.STAGES)
    rows = docs.collect()

    known = stage["language_id"](spark, docs, SF_DIR)
    assert known.columns == docs.columns and {r.doc_id for r in known.collect()} == {r.doc_id for r in rows}

    one = stage["near_dedup"](spark, docs, SF_DIR)
    fps = {r.doc_id: plain_fingerprint(r.text) for r in rows}
    signed = {d: f - 2**64 if f >= 2**63 else f for d, f in fps.items()}
    roots = plain_components(sorted(set(signed.values())))
    least = {}
    for d, f in signed.items():
        least[roots[f]] = min(d, least.get(roots[f], d))
    assert one.columns == docs.columns and sorted(r.doc_id for r in one.collect()) == sorted(least.values())

    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF_DIR}/benchmark.parquet").collect()]
    some = [(r.doc_id, r.text) for r in rows if len(r.text) < 700][:40]
    clean = stage["decontamination"](spark, docs, SF_DIR)
    dirty = {d for d, _ in plain_contamination(some, items)}
    kept = {r.doc_id for r in clean.collect()}
    assert clean.columns == docs.columns and {d for d, _ in some if d not in kept} == dirty

    mixed = stage["mixing"](spark, docs, SF_DIR)
    want = QUERIES["op10_mixing"](spark, SF_DIR).filter("size > 0")
    copies = {r.doc_id: r.taken // r.size for r in want.collect()}
    got = {r.doc_id: r["count"] for r in mixed.groupBy("doc_id").count().collect()}
    assert mixed.columns == docs.columns and got == {d: n for d, n in copies.items() if n}

    index = stage["token_shards"](spark, docs, SF_DIR)
    n = {r.doc_id: r.n_tokens for r in tokens.count_tokens(docs).collect()}  # no special strings in these
    assert {r.doc_id: r.n for r in index.groupBy("doc_id").agg(F.sum("n_tokens").alias("n")).collect()} == {d: k + 1 for d, k in n.items()}


def test_the_whole_pipeline(spark):
    out = corpus_pipeline.run(spark, SF_DIR)
    assert out.count() > 0 and "slot" in out.columns
