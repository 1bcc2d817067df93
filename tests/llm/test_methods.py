"""Each operator against a plain version of what it computes."""

import itertools
import random
import time

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from kinecohort.llm import chat, common, decontamination, language, licenses, mixing, quality, shards, simhash, tokens, toxicity
from kinecohort.llm.queries import ORACLES, QUERIES

SF_DIR = "/root/testdata/sf0.001"


def words_from(rng, n, kinds=2000):
    return ["w" + str(x) for x in rng.integers(0, kinds, n)]


# --- tokens -----------------------------------------------------------------------------


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokens.BYTE_BPE)


@pytest.fixture(scope="module")
def whole():
    return tokens.whole_tokens()


def test_whole_tokens_encode_alone(library, whole):
    assert len(whole) > 40_000
    texts = list(whole)
    assert [e.ids for e in library.encode_batch(texts, add_special_tokens=False)] == [[whole[t]] for t in texts]


def test_counts_are_the_librarys(library, whole):
    count = tokens.Counts(tokens.BYTE_BPE, whole)
    parts = [" ", "  ", "\n", "\t", "\r", "a", "b'", "'s", "é", "1", "²", "!", "?!", "<|endoftext|>", "\xa0", "　", "日本", "\x1c"]
    parts += ["\x85", "word", " the", "​", "😀", "Z", "İ", "'", "\xad", "ª"]
    draw = random.Random(3)
    texts = ["".join(draw.choice(parts) for _ in range(draw.randint(0, 14))) for _ in range(5000)]
    for text, e in zip(texts, library.encode_batch(texts, add_special_tokens=False)):
        assert count(text) == len(e.ids), repr(text)


def test_the_pattern_splits_as_the_library(library):
    for c in range(0x3000):
        ch = chr(c)
        if not tokens._OTHER.search(ch):
            for s in (f"a{ch}b", f" {ch} 1{ch}", f"{ch}{ch}'s{ch}", f"1{ch}  {ch}\n"):
                assert tokens._SPLIT.findall(s) == [s[a:b] for _, (a, b) in library.pre_tokenizer.pre_tokenize_str(s)]


def test_a_full_memory_starts_again(whole, monkeypatch):
    monkeypatch.setattr(tokens, "REMEMBERED", 5)
    count = tokens.Counts(tokens.BYTE_BPE, whole)
    text = " ".join(f"qzx{i}kv" for i in range(50))
    assert count(text) == sum(count(f" qzx{i}kv") for i in range(1, 50)) + count("qzx0kv")


# --- near duplicates --------------------------------------------------------------------


def plain_fingerprint(text):
    w = [x for x in text.encode().lower().split()]
    grams = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_fingerprints(monkeypatch):
    texts = ["", "a", "A b", "x y z", "x  y\tz\nw", "é É a", " ".join(map(str, range(50))), "a b c a b c a b c a b c", "a\xa0b c"]
    assert simhash.fingerprint([t.encode() for t in texts]).tolist() == [plain_fingerprint(t) for t in texts]
    monkeypatch.setattr(simhash, "BLOCK", 4)
    assert simhash.fingerprint([t.encode() for t in texts]).tolist() == [plain_fingerprint(t) for t in texts]


def plain_components(fps):
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(fps, 2):
        if ((a ^ b) & (2**64 - 1)).bit_count() <= 2:
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    return {f: find(f) for f in fps}


@pytest.mark.parametrize("bucket", [128, 3])
def test_links_join_all_that_differ_in_two_bits(spark, monkeypatch, bucket):
    monkeypatch.setattr(simhash, "BUCKET", bucket)
    draw = random.Random(1)
    fps = {0, -1}
    for _ in range(6):
        now = draw.getrandbits(64)
        for _ in range(40):
            for _ in range(draw.randint(1, 4)):
                now ^= 1 << draw.randrange(64)
            fps.add(now - 2**64 if now >= 2**63 else now)
    fps = sorted(fps)
    edges = simhash.links(spark.createDataFrame([(f,) for f in fps], "fp long"))
    assert all(((r.a ^ r.b) & (2**64 - 1)).bit_count() <= 2 for r in edges.collect())
    found = {r.node: r.root for r in simhash.components(edges).collect()}
    assert {f: found.get(f, f) for f in fps} == plain_components(fps)


def test_components_of_a_long_chain_and_a_hub(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 160)] + [(5, 5)]
    found = {r.node: r.root for r in simhash.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {**{i: 0 for i in range(61)}, **{i: 100 for i in range(100, 160)}}


# --- language ---------------------------------------------------------------------------


def test_phrases_are_greedy_longest_matches():
    draw = random.Random(2)
    make = lambda n, letters: "".join(draw.choice(letters) for _ in range(n))
    model = language.Languages((("x", make(300, "ab ").encode()), ("y", make(300, "abc").encode())))
    texts = [make(draw.randint(1, 60), "abcd ") for _ in range(50)] + [""]
    data, offsets = common.utf8(pa.array(texts))
    got = language.phrases(model, data, offsets)
    for i, t in enumerate(texts):
        for k, (_, known) in enumerate(model.texts):
            n, at, raw = 0, 0, t.encode()
            while at < len(raw):
                end = at
                while end < len(raw) and raw[at : end + 1] in known:
                    end += 1
                # What the text does not have at all is a phrase that the next byte starts after.
                at, n = max(end, at + 1), n + 1
            assert got[k][i] == n


def test_held_out_languages(spark):
    found = QUERIES["op8_language"](spark, "/root/testdata/sf0.01").filter("held_out")
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang")
    assert found.join(docs, "doc_id").agg(F.avg((F.col("lang_pred") == F.col("lang")).cast("double"))).first()[0] > 0.98


def test_languages_are_learned_from_all_of_a_text(spark):
    """Texts that all begin in one language and go on in their own: the beginnings don't teach."""
    draw = random.Random(8)
    make = lambda letters, n: " ".join("".join(draw.choices(letters, k=draw.randint(3, 8))) for _ in range(n))
    rows = [(i, make("xyzw", 500) + " " + make(own, 6000), own) for i in range(60) for own in ("abcd", "efgh")]
    model = language.fit_languages(spark.createDataFrame(rows, "doc_id int, text string, lang string"))
    assert all(len(text) <= language.TRAIN_BYTES for _, text in model.texts)
    asked = spark.createDataFrame([(1, make("abcd", 50)), (2, make("efgh", 50))], "doc_id int, text string")
    assert {r.doc_id: r.lang_pred for r in language.identify(asked, model).collect()} == {1: "abcd", 2: "efgh"}
    assert all(sum(text.count(c) for c in b"xyzw") < len(text) / 4 for _, text in model.texts)


def test_texts_of_no_language(spark):
    model = language.Languages((("en", b"the cat sat on the mat and the dog sat on the log " * 40),))
    rows = spark.createDataFrame([(1, "the cat sat on the log"), (2, "12 !?"), (3, None), (4, "Ωμέγα καὶ ἄλφα"), (5, "")], "doc_id long, text string")
    got = {r.doc_id: r for r in language.identify(rows, model).collect()}
    assert [got[i].lang_pred for i in range(1, 6)] == ["en", "und", "und", "en", "und"]
    assert got[2].score == got[3].score == got[5].score == 0.0 and got[1].score == 1.0
    kept = language.keep_known(rows.withColumn("bits_per_byte", F.lit(1)), model)
    assert [r.doc_id for r in kept.collect()] == [1] and kept.columns == ["doc_id", "text", "bits_per_byte"]


# --- toxicity ---------------------------------------------------------------------------


def test_marginals_are_sums_over_all_labellings():
    rng = np.random.default_rng(0)
    scores, lengths, t = rng.normal(size=(3, 5)), np.array([5, 3, 1]), rng.normal(size=(2, 2))
    p, pairs, total = toxicity.marginals(scores, lengths, t)
    want_pairs = np.zeros((2, 2))
    for i, n in enumerate(lengths):
        weights = {}
        for y in itertools.product((0, 1), repeat=int(n)):
            weights[y] = np.exp(sum(scores[i, k] * y[k] for k in range(n)) + sum(t[a, b] for a, b in zip(y, y[1:])))
        z = sum(weights.values())
        assert total[i] == pytest.approx(np.log(z))
        assert p[i, :n] == pytest.approx([sum(w for y, w in weights.items() if y[k]) / z for k in range(n)])
        for y, w in weights.items():
            for a, b in zip(y, y[1:]):
                want_pairs[a, b] += w / z
    assert pairs == pytest.approx(want_pairs)


def test_toxic_words_are_learned_and_placed(spark):
    rng = np.random.default_rng(1)
    texts, marks = [], []
    for i in range(300):
        w = words_from(rng, 60)
        if i % 3 == 0:
            w[10] = "Vileness!"
            w[40] = "scummy"
        texts.append(" ".join(w))
        marks.append(int(i % 3 == 0))
    field = toxicity.fit_field([t.encode() for t in texts], marks, 0.1)
    rows = [(1, "é vileness"), (2, "w1 w2 w3"), (3, None), (4, ""), (4, "Scummy w5 scummy."), (None, "w1 " * 40_000 + "scummy")]
    got = toxicity.score(spark.createDataFrame(rows, "doc_id int, text string"), field).collect()
    spans = [[(s.s, s.e) for s in r.spans] for r in got]
    assert spans == [[(2, 10)], [], [], [], [(0, 6), (10, 16)], [(120_000, 120_006)]]
    assert [r.score >= 0.3 for r in got] == [True, False, False, False, True, True]
    assert toxicity.fit_field([b"a b"] * 10, [1] * 10, 0.5) is None
    assert [r.score for r in toxicity.score(spark.createDataFrame(rows, "doc_id int, text string"), None).collect()] == [0.0] * 6


def test_toxicity_is_learned_from_whole_texts(spark, monkeypatch):
    """Toxic words at the end of long texts teach; a text beyond the room of its class is passed over, the others stay."""
    draw = random.Random(6)
    plain = lambda n: " ".join(f"w{draw.randrange(300)}" for _ in range(n))
    rows = [(i, plain(draw.randint(300, 2500)) + (" vile scum" * 3 if i % 3 == 0 else "")) for i in range(240)]
    docs = spark.createDataFrame(rows, "doc_id int, text string").withColumn("draw", F.lit("clash"))
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(240)], "doc_id int, toxic int")
    asked = spark.createDataFrame([(1, plain(400) + " vile scum vile scum"), (2, plain(400))], "doc_id int, text string")
    field = toxicity.fit_toxicity(docs, labels)
    score = {r.doc_id: r.score for r in toxicity.score(asked, field).collect()}
    assert score[1] > 0.3 > score[2]
    monkeypatch.setattr(toxicity, "TRAIN_BYTES", 200_000)
    huge = docs.union(spark.createDataFrame([(1000, plain(200_000), "x")], docs.schema))
    seen = []
    monkeypatch.setattr(toxicity, "fit_field", lambda texts, toxic, share: seen.append((texts, toxic)))
    toxicity.fit_toxicity(huge, labels.union(spark.createDataFrame([(1000, 1)], labels.schema)))
    texts, marks = seen[0]
    for k in (0, 1):
        own = [len(t) for t, m in zip(texts, marks) if m == k]
        assert 180_000 < sum(own) <= 200_000
    assert {t.decode() for t in texts} <= {t for _, t in rows}


def test_held_out_toxicity(spark):
    found = QUERIES["op6_toxicity"](spark, "/root/testdata/sf0.1").filter("held_out")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet").select("doc_id", "toxic")
    both = found.join(labels, "doc_id")
    caught = F.count_if(F.expr("predicted = 1 AND toxic = 1"))
    recall, precision = both.agg(caught / F.count_if(F.expr("toxic = 1")), caught / F.count_if(F.expr("predicted = 1"))).first()
    assert recall > 0.8 and precision > 0.9
    good = both.agg(F.avg((F.col("predicted") == F.col("toxic")).cast("double"))).first()[0]
    assert good > 0.97


# --- chat -------------------------------------------------------------------------------

CONTROL = ["<turn>", "</turn>", "<text>", "<|endoftext|>", "<", "\\", "<\\turn>", "/turn>", "### Assistant: ", "a", " ", "\n", "é", "日", "turn>"]


def test_escaping_is_reversible_and_hides_marks():
    draw = random.Random(4)
    for _ in range(5000):
        turns = [("".join(draw.choices(CONTROL, k=draw.randint(0, 4))), "".join(draw.choices(CONTROL, k=draw.randint(0, 8)))) for _ in range(3)]
        text, _ = chat.render(turns, "a")
        assert chat.parse(text) == turns
        assert text.count(chat.OPEN) == text.count(chat.CLOSE) == 3 and "<|endoftext|>" not in text


def conversations(spark):
    draw = random.Random(5)
    rows = [(c, t, draw.choice(["user", "assistant"]), "".join(draw.choices(CONTROL, k=draw.randint(0, 9)))) for c in range(20) for t in range(6)]
    rows += [(30, 0, None, None), (30, 0, "assistant", "x"), (30, 0, "assistant", "x"), (None, 1, "assistant", " two "), (None, None, "user", "one")]
    return rows, spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").withColumn("n_turns", F.lit("clash"))


@pytest.mark.parametrize("segment", [1 << 20, 12])
def test_conversations_read_back(spark, library, monkeypatch, segment):
    import hashlib

    monkeypatch.setattr(chat, "SEGMENT", segment)
    rows, df = conversations(spark)
    made = chat.format_conversations(df)
    got = {r.conv_id: r for r in chat.read_back(made).collect()}
    first = lambda v: (v is not None, v if v is not None else 0)
    for conv in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == conv), key=lambda r: (first(r[1]), (r[2] is not None, r[2] or ""), (r[3] is not None, r[3] or "")))
        turns = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in own)
        loss = "".join(r[3] or "" for r in own if r[2] == "assistant")
        assert got[conv].turns_sha256 == hashlib.sha256(turns.encode()).hexdigest()
        assert (got[conv].loss_sha256, got[conv].loss_chars) == (hashlib.sha256(loss.encode()).hexdigest(), len(loss))
    tokenizer = chat._tokenizer(tokens.BYTE_BPE)
    each = {}
    for r in sorted(made.collect(), key=lambda r: r.segment):
        each.setdefault(r.conv_id, ["", []])
        each[r.conv_id][0] += r.formatted
        each[r.conv_id][1] += list(r.input_ids)
    assert all(tokenizer.encode(text, add_special_tokens=False).ids == ids for text, ids in each.values())


def test_no_conversations(spark):
    empty = spark.createDataFrame([], "conv_id long, turn int, role string, text string")
    assert chat.read_back(chat.format_conversations(empty)).collect() == []


# --- decontamination --------------------------------------------------------------------


def plain_distance(a, b):
    last = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        now = [i]
        for j, y in enumerate(b, 1):
            now.append(min(last[j] + 1, now[-1] + 1, last[j - 1] + (x != y)))
        last = now
    return last[-1]


def plain_nearest(item, words):
    """Edit distance of the item to the nearest passage of any length."""
    last = [0] * (len(words) + 1)
    for i, x in enumerate(item, 1):
        now = [i]
        for j, y in enumerate(words, 1):
            now.append(min(last[j] + 1, now[-1] + 1, last[j - 1] + (x != y)))
        last = now
    return min(last)


def test_distance():
    draw = random.Random(6)
    for _ in range(2000):
        a, b = ([draw.randint(0, 4) for _ in range(draw.randint(0, 12))] for _ in range(2))
        assert decontamination.distance(a, b) == plain_distance(a, b)


@pytest.mark.parametrize("length", [5, 13, 37, 59, 120])
def test_windows_at_the_greatest_distance_share_a_key(length):
    rng = np.random.default_rng(length)
    a = rng.integers(1, 1 << 62, (400, length)).astype(np.uint64)
    b = a.copy()
    for row in b:
        spots = rng.choice(length, decontamination.edits(length), replace=False)
        row[spots] = rng.integers(1, 1 << 62, len(spots))
    same = decontamination.signatures(a, length) == decontamination.signatures(b, length)
    assert same.any(axis=1).mean() >= 0.99


def plain_contamination(docs, items):
    split = lambda t: [bytes(w) for w in "".join(c if c.isalnum() or ord(c) > 127 else " " for c in (t or "").lower()).encode().split()]
    out = {}
    for d, text in docs:
        w = split(text)
        for i, passage in items:
            p = split(passage)
            if p and w:
                best = plain_nearest(p, w)
                if best <= decontamination.edits(len(p)):
                    out[d, i] = best
    return out


def passages(rng):
    """Items and documents with copies of them, exact and edited, near the limit on either side."""
    items = [(100 + i, " ".join(words_from(rng, int(n)))) for i, n in enumerate([5, 6, 12, 20, 20, 31, 40])]
    items += [(200, "common words common words common words common words"), (201, None), (202, ""), (203, "one two"), (100, "w1 w2 w3 w4 w5 w6")]
    docs = [(1, None), (2, ""), (3, "One, two!"), (4, "common words common words common words common"), (5, items[6][1]), (5, "x " + items[1][1])]
    for k in range(60):
        w = words_from(rng, 80)
        p = items[k % 7][1].upper().split()
        for _ in range(k % 5 * len(p) // 16):
            at = rng.integers(0, len(p))
            kind = rng.integers(0, 3)
            if kind == 0:
                p[at] = "edited"
            elif kind == 1:
                p.insert(at, "added")
            elif len(p) > 1:
                p.pop(at)
        at = int(rng.integers(0, 80))
        docs.append((10 + k, " ".join(w[:at] + p + w[at:])))
    return items, docs


@pytest.mark.parametrize("block", [20_000, 4])
def test_contamination_is_what_comparing_all_passages_finds(spark, block):
    items, docs = passages(np.random.default_rng(7))
    rows = spark.createDataFrame(docs, "doc_id int, text string").withColumn("distance", F.lit("clash"))
    bench = spark.createDataFrame(items, "item_id int, text string")
    want = {}
    for k, (d, text) in enumerate(docs):
        for i, (item, passage) in enumerate(items):
            for key, best in plain_contamination([(d, text)], [(item, passage)]).items():
                want.setdefault(key, []).append(best)
    got = {}
    for r in decontamination.contamination(rows, bench, block=block).collect():
        got.setdefault((r.doc_id, r.item_id), []).append(r.distance)
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}
    dirty = {k for k, (d, t) in enumerate(docs) if plain_contamination([(d, t)], items)}
    clean = decontamination.decontaminate(rows, bench, block=block)
    assert sorted((r.doc_id, r.text or "") for r in clean.collect()) == sorted((d, t or "") for k, (d, t) in enumerate(docs) if k not in dirty)
    assert clean.columns == rows.columns


# --- shards -----------------------------------------------------------------------------


@pytest.mark.parametrize("n", [1, 2, 3, 5, 16, 17, 1000, 4097])
def test_the_permutation_is_one(n):
    y = shards.permute(np.arange(n), n, 9)
    assert sorted(y.tolist()) == list(range(n)) and shards.invert(y, n, 9).tolist() == list(range(n))
    assert n < 1000 or (y != shards.permute(np.arange(n), n, 10)).mean() > 0.9


def shard_rows(spark, tmp_path, rows):
    path = str(tmp_path / "docs")
    spark.createDataFrame(rows, "doc_id long, text string, slot string").repartition(3).write.parquet(path)
    return spark.read.parquet(path)


@pytest.mark.parametrize("run, tasks", [(4 << 20, 20_000), (100, 2)])
def test_documents_are_read_back_from_their_records(spark, tmp_path, library, monkeypatch, run, tasks):
    monkeypatch.setattr(shards, "RUN", run)
    monkeypatch.setattr(shards, "TASKS", tasks)
    draw = random.Random(8)
    texts = [" ".join(draw.choices(["the", "cat\n", "Ωμ", "x1", "\n\n"], k=draw.randint(0, 60))) for _ in range(80)]
    rows = [(i, t, "clash") for i, t in enumerate(texts)] + [(7, texts[7], "again"), (None, "no id", None), (90, None, None), (91, "a <|endoftext|> b", "")]
    made, index = shards.write_shards(shard_rows(spark, tmp_path, rows), length=16, per_shard=8)
    library.encode_special_tokens = True  # their strings are ordinary text here
    records = {r.slot: np.frombuffer(bytes(r.ids), "<u2") for r in shards.read_records(spark, made).collect()}
    assert sorted(records) == list(range(made.sequences))
    parts = {}
    for r in index.collect():
        assert (r.shard, r.record) == divmod(r.slot, 8)
        parts.setdefault(r.doc_id, []).append((r.part, records[r.slot][r.start : r.start + r.n_tokens].tolist()))
    want = {}
    for i, t, _ in rows:
        want.setdefault(i, []).append(library.encode(t or "", add_special_tokens=False).ids + [shards.END])
    library.encode_special_tokens = False
    for i, whole in want.items():
        got = sorted(parts[i], key=lambda p: p[0])
        assert len(whole) > 1 or sum((p for _, p in got), []) == whole[0]
        assert sorted(x for _, p in got for x in p) == sorted(x for w in whole for x in w)
    # Records lie in order, so reading can go on at any of them.
    import glob

    files = glob.glob(f"{made.path}/shard=1/part-*")
    assert len(files) == 1
    with open(files[0], "rb") as f:
        f.seek(3 * made.stride)
        assert int.from_bytes(f.read(8), "little") == 8 + 3
    assert shards.read_records(spark, made, 1).count() == 8


def test_no_documents_no_shards(spark, tmp_path):
    made, index = shards.write_shards(shard_rows(spark, tmp_path, []))
    assert made.sequences == 0 and index.collect() == [] and shards.read_records(spark, made).collect() == []


# --- mixing -----------------------------------------------------------------------------


def plain_targets(sizes, cycle=(1, 2, 3), cap=3):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: cycle[i % len(cycle)] for i, s in enumerate(names)}
    target, free = {}, set(names)
    total = float(sum(sizes.values()))
    while free:
        left = total - sum(target.values())
        share = {s: left * weight[s] / sum(weight[f] for f in free) for s in free}
        over = {s for s in free if share[s] > cap * sizes[s]}
        if not over:
            return {**target, **share}
        target |= {s: float(cap * sizes[s]) for s in over}
        free -= over
    return target


@pytest.mark.parametrize("seed", range(4))
def test_targets_are_shared_until_none_is_above(spark, seed):
    draw = random.Random(seed)
    sizes = {f"s{i}": draw.choice([0, 1, 10, 500, 20_000]) for i in range(12)} | {None: 70, "é": 3, "Z": 4}
    rows = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r.source: r.target for r in mixing.targets(rows).collect()}
    assert got == pytest.approx(plain_targets(sizes))


def test_a_mix_meets_its_targets(spark):
    draw = random.Random(9)
    rows = [(i, draw.choice(["hot"] * 6 + ["a", "b", None]), draw.randint(0, 50), draw.choice([None, 0.5, 1.0, 0.0])) for i in range(3000)]
    rows += [(7, "b", 9, 1.0)] * 4 + [(None, "a", 5, 1.0), (None, "a", None, 1.0)]
    df = spark.createDataFrame(rows, "doc_id int, source string, size int, weight double").withColumn("key", F.lit("clash"))
    got = mixing.mix(df, parts=16).collect()
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, mixing.mix(df.repartition(5), parts=7).collect()), key=str)
    assert len(got) == len(rows)
    sizes = {}
    for r in rows:
        sizes[r[1]] = sizes.get(r[1], 0) + (r[2] or 0)
    want = plain_targets(sizes)
    for s in sizes:
        own = [r for r in got if r.source == s]
        assert all(r.source_size == sizes[s] and r.taken == r.copies * r.size <= 3 * r.size for r in own)
        assert abs(sum(r.taken for r in own) - want[s]) <= 50 and own[0].target == pytest.approx(want[s])
        assert len({r.copies for r in own if r.size}) <= 2
    assert mixing.mix(df.limit(0)).collect() == []


def test_heavier_documents_come_first(spark):
    rows = [(i, "big" if i % 10 else "small", 10, 1.0 if i % 2 else 0.25) for i in range(4000)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id int, source string, size int, weight double")).filter("source = 'big'").collect()
    chosen = [r.doc_id % 2 for r in got if r.copies == max(x.copies for x in got)]
    assert 0.55 < np.mean(chosen) < 0.95


# --- rules ------------------------------------------------------------------------------


def test_rules_have_their_keyword_and_priority():
    read = licenses.rules()
    assert len(read) > 200 and {p for _, p, _, _ in read} == {1, 2, 3, 4}
    import re

    def bare(pattern):
        """What every match of a pattern without a choice holds: all but its optional parts."""
        return re.sub(r"\((?:[^()]|\([^()]*\))*\)\?", "", pattern).replace("licen[cs]e", "license")

    assert [p for _, _, k, p in read for choice in (p.split("|") if "(" not in p else [p]) if k not in bare(choice)] == []


def test_detections_are_suppressed_by_what_contains_them(spark):
    text = "Licensed under the Apache License, Version 2.0; see cc-by. CC BY 4.0 and GNU General Public License v3. All rights reserved."
    rows = [(1, text), (2, None), (3, ""), (4, "KELVIN lİcense"), (None, "cc by " * 5000), (1, "plain words"), (5, "accc by cc bye")]
    df = spark.createDataFrame(rows, "doc_id int, text string").withColumn("lower", F.lit("clash"))
    got = licenses.scan(df).collect()
    labels = [sorted({d.label for d in r.detections}) for r in got]
    assert labels[0] == ["apache-2.0", "cc-by", "gpl-3.0", "reserved"] and labels[1:4] == [[], [], []]
    assert got[0].base_starts == sorted(got[0].base_starts)[:0] + [9, 11, 17, 21] or sorted(got[0].base_starts) == [9, 11, 17, 21]
    assert [r.n_words for r in got] == [24, 0, 0, 2, 10_000, 2, 4]
    assert len(got[4].base_starts) == len(got[4].detections) == 5000
    for r in got:
        for d in r.detections:
            assert not any(o.s <= d.s and o.e >= d.e and o.priority >= d.priority and o != d for o in (r.detections if len(r.detections) < 50 else []))


def test_detections_of_a_text_with_very_many_matches(spark):
    """A megabyte of matches takes seconds, since time goes with their number; places and suppression stay right."""
    n = 58_000
    rows = [(1, "cc by mit license " * n), (2, "cc by " + "gnu general public license v3 mit license " * 700)]
    start = time.time()
    got = {r.doc_id: r for r in licenses.scan(spark.createDataFrame(rows, "doc_id int, text string").coalesce(1)).collect()}
    assert time.time() - start < 60
    assert got[1].base_starts == list(range(0, 4 * n, 4))
    assert [(d.label, d.s, d.e) for d in got[1].detections] == [x for i in range(n) for x in (("cc-by", 4 * i, 4 * i + 2), ("mit", 4 * i + 2, 4 * i + 4))]
    ends = [(d.s, d.e, d.priority) for d in got[2].detections]
    assert len(ends) == 1 + 2 * 700 and ends == sorted(ends)
    assert all(b[1] > a[1] for a, b in zip(ends, ends[1:]))


def test_suppression_equals_a_comparison_of_all(spark):
    draw = random.Random(31)
    parts = ["gnu general public license v3", "general public license", "license", "mit license", "apache license version 2 0", "version 2"]
    parts += ["licensed under the apache license", "cc by 4 0", "cc by sa 4 0", "cc by", "4 0", "all rights reserved", "x", "gnu"]
    rows = [(i, " ".join(draw.choices(parts, k=draw.choice([5, 60, 200])))) for i in range(80)]
    df = spark.createDataFrame(rows, "doc_id int, text string")
    matched = df.select("doc_id", F.concat(F.lit(" "), F.regexp_replace("text", " ", "  "), F.lit(" ")).alias("found"))
    places = matched.select("doc_id", F.expr(licenses._places(licenses._matches("found", licenses._literal(licenses.rules())))).alias("p"))
    all_ = {r.doc_id: [tuple(d) for d in r.p] for r in places.collect()}

    def inside(d, o):
        same = (o[3], o[4], o[2]) == (d[3], d[4], d[2])
        return o != d and o[3] <= d[3] and o[4] >= d[4] and o[2] >= d[2] and (not same or o[0] < d[0])

    found = 0
    for r in licenses.scan(df).collect():
        want = sorted(d for d in all_[r.doc_id] if not any(inside(d, o) for o in all_[r.doc_id]))
        assert sorted(tuple(d) for d in r.detections) == want
        found += len(all_[r.doc_id]) - len(want)
    assert found > 100


def plain_quality(text):
    import re

    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    seen = {}
    for i in range(len(w) - 7):
        seen.setdefault(tuple(w[i : i + 8]), []).append(i)
    covered = {p for at in seen.values() if len(at) > 1 for i in at for p in range(i, i + 8)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered))


def test_ledger(spark):
    draw = random.Random(10)
    texts = [None, "", " \n ", "a " * 7, "a " * 8, "a " * 9, "x\ny\nx\n \nx", "日本 " * 30, "b c " * 20_000]
    texts += [" ".join(draw.choices("ab", k=draw.randint(0, 60))) + draw.choice(["", "\n", " # | 5"]) * 3 for _ in range(200)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(None, None)], "doc_id int, text string").withColumn("words", F.lit(1))
    rows = quality.ledger(df)
    for r in rows.filter("doc_id IS NOT NULL").collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == plain_quality(texts[r.doc_id]), texts[r.doc_id]
    kept = rows.select("*", quality.passes().alias("kept")).collect()
    ablated = {r.rule: r for r in quality.ablation(rows).collect()}
    for rule in quality.RULES:
        fails = [r for r in kept if r.failures & quality.bit(rule)]
        assert ablated[rule].failed == len(fails)
        assert ablated[rule].failed_alone == sum(r.failures == quality.bit(rule) for r in fails)
    assert rows.limit(0).collect() == [] and rows.count() == len(texts) + 1


def test_all_queries_are_there():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14)) and set(ORACLES) <= set(QUERIES)
