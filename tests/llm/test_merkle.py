"""Trees and proofs against plain ones."""

import zlib
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from kinecohort.llm import merkle
from kinecohort.llm.queries import ORACLES, QUERIES
from tests.run_checks import compare, connect

SF_DIR = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def digest(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def plain_leaf(r, text):
    parts = [r["doc_id"], r["source"], r["lang"], r["n_chars"], text]
    return digest(*["-" if p is None else f"{len(str(p).encode())}:{p}" for p in parts])


def plain_levels(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        last = levels[-1]
        levels.append([digest(*last[i : i + 8]) for i in range(0, len(last), 8)])
    return levels


def plain_path(levels, k):
    path = []
    for level in levels[:-1]:
        run = level[k // 8 * 8 : k // 8 * 8 + 8]
        path.append((run[: k % 8], run[k % 8 + 1 :]))
        k //= 8
    return path


def plain_audit(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r["lang"], []).append((r["doc_id"] is not None, r["doc_id"] or 0, plain_leaf(r, r["text"]), r))
    langs = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: plain_levels([x[2] for x in sorted(groups[g], key=lambda x: x[:3])]) for g in langs}
    top = plain_levels([trees[g][-1][0] for g in langs]) if langs else []
    out = []
    for i, g in enumerate(langs):
        for k, (_, _, leaf, r) in enumerate(sorted(groups[g], key=lambda x: x[:3])):
            text, key = r["text"], r["doc_id"]
            if text is not None and key is not None and zlib.crc32(str(key).encode()) % 3 == 0:
                text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
            path = plain_path(trees[g], k) + plain_path(top, i)
            folded = plain_leaf(r, text)
            for before, after in path:
                folded = digest(*before, folded, *after)
            proof = digest(*[d for before, after in path for d in before + after])
            out.append((key, leaf, trees[g][-1][0], top[-1][0], proof, folded, folded == top[-1][0]))
    return sorted(out, key=repr)


COLUMNS = "doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"


def test_every_document_of_the_table(spark):
    df = QUERIES["op11_merkle"](spark, SF_DIR)
    assert compare(df, connect(SF_DIR), ORACLES["op11_merkle"]) == ""
    rows = [r.asDict() for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()]
    assert sorted([tuple(r[c] for c in COLUMNS) for r in df.collect()], key=repr) == plain_audit(rows)


def test_awkward_rows_and_sizes(spark):
    rows = [
        (1, "Café A", "en", None, 6), (1, "Café A", "en", None, 6), (1, "Other", "en", "a", None), (None, None, None, None, None),
        (None, "B", None, "x", 1), (3, "", "", "", 0), (4, "LONG " * 50_000, "\U0001f600", "b", 1), (5, "Z", "￿", "b", 1),
    ]
    # Subtrees of 1, 8, 9, 64 and 65 leaves, and more than 8 subroots.
    for size in (8, 9, 64, 65):
        rows += [(i - 3, f"Text {i}", f"l{size}", "s", i) for i in range(size)]
    rows += [(i, "Alone", f"k{i}", "s", i) for i in range(5)]
    df = spark.createDataFrame(rows, SCHEMA)
    for c in ("group", "rank", "digest", "path", "leaf", "size", "start", "_pos", "prefix"):
        df = df.withColumn(c, F.lit("clash"))
    got = [tuple(r[c] for c in COLUMNS) for r in merkle.audit(df).collect()]
    want = plain_audit([dict(zip(SCHEMA.replace(" long", "").replace(" string", "").split(", "), r)) for r in rows])
    assert sorted(got, key=repr) == want
    assert merkle.audit(df.limit(0)).collect() == []
    one = merkle.audit(df.filter("doc_id = 5 AND text = 'Z'")).collect()
    assert len(one) == 1 and one[0].leaf == one[0].subroot == one[0].root and one[0].proof_sha256 == digest("")


def test_some_requests_descend_alone(spark):
    df = spark.createDataFrame([(i, f"t{i}", "abc"[i % 3], "s", i) for i in range(200)], SCHEMA)
    tree = merkle.manifest_of(df)
    asked = spark.createDataFrame([(0, 0, "p"), (0, 66, "q"), (2, 13, "r"), (2, 13, "again"), (1, 700, "nobody"), (9, 0, "nowhere")], "group long, rank long, who string")
    got = merkle.prove(tree, asked).withColumn("digest", merkle.siblings()).collect()
    assert sorted(r.who for r in got) == ["again", "p", "q", "r"]
    leaves = {(r["group"], r["rank"]): r.leaf for r in tree.leaves.collect()}
    for r in got:
        folded = leaves[r["group"], r["rank"]]
        for s in r.path:
            folded = digest(s.before, folded, s.after)
        assert folded == tree.root


@pytest.mark.parametrize("wrong", ["digest", "order"])
def test_a_wrong_record_is_noticed(spark, wrong):
    df = spark.createDataFrame([(i, f"t{i}", "a", "s", i) for i in range(20)], SCHEMA)
    tree = merkle.manifest_of(df)
    path = merkle.prove(tree, tree.leaves.select("group", "rank", "leaf")).filter("rank = 9")
    leaf = F.lit("0" * 64) if wrong == "digest" else F.col("leaf")
    turned = "path" if wrong == "digest" else "turned"
    path = path.withColumn("turned", F.transform("path", lambda s: F.struct(s["after"].alias("before"), s["before"].alias("after"))))
    assert path.select(merkle.fold(leaf, turned).alias("r")).first().r != tree.root
