"""Near-duplicates, repeats, decontamination, components and the pipeline, against brute force."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from schemaweave.llm import decontamination, near_duplicates, substring_dedup, suffix_dedup
from schemaweave.llm.components import components

SCHEMA = "doc_id bigint, text string, start bigint, n bigint, gram string"


def made(spark, rows):
    return spark.createDataFrame([(i, t, 1, 2, "x") for i, t in rows], SCHEMA)


def classes(nodes, links):
    root = {x: x for x in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {x: find(x) for x in nodes}


def test_components(spark):
    rng = random.Random(3)
    links = [(rng.randint(0, 80), rng.randint(0, 80)) for _ in range(60)] + [(k, k + 1) for k in range(100, 140)] + [(5, 5), (None, 3)]
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    real = [(a, b) for a, b in links if a is not None and a != b]
    nodes = {x for e in real for x in e}
    assert got == classes(nodes, real)
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in text or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def near(rows, percent):
    sets = {i: shingles(t) for i, t in rows}
    ids = list(sets)
    links = [(a, b) for k, a in enumerate(ids) for b in ids[:k] if sets[a] | sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    return sets, classes(ids, links)


@pytest.mark.parametrize("short,block", [(32, 512), (2, 5)])
def test_near_duplicates_against_brute_force(spark, monkeypatch, short, block):
    monkeypatch.setattr(near_duplicates, "SHORT", short)
    monkeypatch.setattr(near_duplicates, "BLOCK", block)
    rng = random.Random(7)
    word = lambda: f"w{rng.randint(0, 400)}"
    rows, shared = [], [word() for _ in range(25)]
    for _ in range(6):
        base = [word() for _ in range(rng.randint(30, 120))] + shared
        for _ in range(9):
            copy = list(base)
            for _ in range(rng.randint(0, 4)):
                copy[rng.randrange(len(copy))] = word()
            rows.append(" ".join(copy).upper() if rng.random() < 0.2 else "\n".join(copy))
    rows += [None, "", "a b", "A  b", "a b c", " ", "x " * 3000, "x " * 3001, "É a b c d", "é a b c d"]
    rows = list(enumerate(rows))
    sets, root = near(rows, 85)
    got = {r.doc_id: r for r in near_duplicates.near_duplicates(made(spark, rows)).collect()}
    assert {i: (r.n_shingles, r.component_id, r.kept) for i, r in got.items()} == {i: (len(sets[i]), root[i], root[i] == i) for i, _ in rows}


def test_near_duplicates_with_text_appended_in_long_lists(spark, monkeypatch):
    monkeypatch.setattr(near_duplicates, "SHORT", 1)
    rows = []
    for k in range(300):
        text = [f"{k}w{i}" for i in range(1004)]
        rows += [(2 * k, " ".join(text[:805])), (2 * k + 1, " ".join(text))]
    got = {r.doc_id: r.component_id for r in near_duplicates.near_duplicates(made(spark, rows), percent=80).collect()}
    assert got == {i: i - i % 2 for i in range(600)}


def test_near_duplicates_of_nothing_and_of_repeated_ids(spark):
    assert near_duplicates.near_duplicates(made(spark, [])).count() == 0
    out = near_duplicates.near_duplicates(made(spark, [(1, "a b c d e f"), (1, "a b c d e f"), (2, "q r s t u v"), (None, "a b c d e f")])).collect()
    assert sorted((r.doc_id or 0, r.kept) for r in out) == [(0, True), (1, True), (1, True), (2, True)]


def bytes_brute(rows, window, mended=bytes):
    seen = Counter(t[k : k + window] for _, t in rows for k in range(len(t) - window + 1))
    out = []
    for i, t in rows:
        gone = bytearray(len(t))
        for k in range(len(t) - window + 1):
            if seen[t[k : k + window]] > 1:
                gone[k : k + window] = b"\1" * window
        kept = mended(bytes(x for x, g in zip(t, gone, strict=True) if not g))
        out.append((i, len(t), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("crowd", [4096, 1])
@pytest.mark.parametrize("alphabet,window", [("ab", 12), ("abcdefghé ", 10), ("a", 8)])
def test_repeated_bytes_against_brute_force(spark, alphabet, window, crowd):
    rng = random.Random(f"{alphabet}{window}")
    block = ["".join(rng.choice(alphabet) for _ in range(rng.randint(5, 40))) for _ in range(8)]
    rows = [(i, "".join(rng.choice(block) if rng.random() < 0.4 else rng.choice(alphabet) for _ in range(rng.randint(0, 40)))) for i in range(40)]
    rows += [(100, None), (101, ""), (102, block[0]), (103, rows[3][1]), (104, "z" * 3000)]
    got = suffix_dedup.remove_repeated_bytes(made(spark, rows), window=window, crowd=crowd).collect()
    assert sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got), key=repr) == bytes_brute([(i, (t or "").encode()) for i, t in rows], window)


def test_repeated_bytes_of_long_windows(spark):
    rng = random.Random(400)
    text = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    shared = text(700)
    rows = [(i, text(300) + (shared[: 399 + i % 4 * 100] if i % 3 else "") + text(200)) for i in range(12)] + [(20, "z" * 5000), (21, "xy" * 900)]
    got = suffix_dedup.remove_repeated_bytes(made(spark, rows), window=400).collect()
    assert sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got), key=repr) == bytes_brute([(i, t.encode()) for i, t in rows], 400)
    with pytest.raises(ValueError):
        suffix_dedup.remove_repeated_bytes(made(spark, rows), window=1 << 16)


@pytest.mark.parametrize("words", [False, True])
def test_rows_grow_with_documents_not_with_windows(spark, words):
    """Twice the copies of a passage make twice the rows, a few per document, and a text of one byte makes few."""
    rng = random.Random(12)
    shared = " ".join(f"s{rng.randint(0, 10**6)}" for _ in range(200))
    rows = lambda n: [(i, f"{rng.random()} {shared} {rng.random()}") for i in range(n)]
    covered = (lambda d: substring_dedup.repeated_words(d, 20)) if words else (lambda d: suffix_dedup.repeated_bytes(d, 200, crowd=1))
    found = [covered(made(spark, rows(n)).selectExpr("doc_id as key", "text")).count() for n in (60, 120)]
    assert found[1] <= 2.2 * found[0] and found[1] <= 120 * 12
    assert covered(made(spark, [(1, "a " * 20_000 if words else "a" * 40_000)]).selectExpr("doc_id as key", "text")).count() <= 10


def test_crowded_suffixes_make_rows_by_stretch_not_by_window(spark, monkeypatch):
    """A passage amid different texts, some with a part of it only: no step makes a row for each of its windows."""
    made_rows, store = [], suffix_dedup.stored

    def counted(df, name, *more):
        made_rows.append((store(df, name, *more), name))
        return made_rows[-1][0]

    monkeypatch.setattr(suffix_dedup, "stored", counted)
    monkeypatch.setattr(suffix_dedup.repeats, "stored", counted)
    rng = random.Random(13)
    text = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    shared = text(500)
    rows = [(i, text(90) + (shared[i % 7 * 10 : 460 + i % 5 * 10] if i % 2 else shared) + text(90)) for i in range(100)]
    got = suffix_dedup.remove_repeated_bytes(made(spark, rows), window=200, crowd=1).collect()
    assert sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got), key=repr) == bytes_brute([(i, t.encode()) for i, t in rows], 200)
    assert max((df.count(), name) for df, name in made_rows)[0] <= 16 * len(rows)


def test_repeated_bytes_with_repeated_and_null_ids(spark):
    rows = [(1, "0123456789 one"), (1, "0123456789 two"), (None, "0123456789"), (None, None), (2, "unique text")]
    got = suffix_dedup.remove_repeated_bytes(made(spark, rows), window=8).collect()
    assert sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got), key=repr) == bytes_brute([(i, (t or "").encode()) for i, t in rows], 8)
    cut = suffix_dedup.remove_from_texts(made(spark, rows), window=8)
    assert cut.columns == ["doc_id", "text", "start", "n", "gram"]
    assert sorted((r.text for r in cut.collect()), key=repr) == sorted(["one", "two", "", None, "unique text"], key=repr)
    assert suffix_dedup.remove_repeated_bytes(made(spark, []), window=8).count() == 0


def words_brute(rows, window):
    seen, out = set(), []
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            x = tuple(w[k : k + window])
            if x in seen:
                gone[k : k + window] = [True] * window
            seen.add(x)
        out.append((i, len(w), sum(gone), hashlib.sha256(" ".join(x for x, g in zip(w, gone, strict=True) if not g).encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("vocabulary,window", [(3, 6), (60, 5), (1, 4)])
def test_repeated_words_against_brute_force(spark, vocabulary, window):
    rng = random.Random(vocabulary)
    block = [[f"w{rng.randint(1, vocabulary)}" for _ in range(rng.randint(3, 20))] for _ in range(6)]
    rows = [(i, " ".join(" \n".join(rng.choice(block)) if rng.random() < 0.3 else f"w{rng.randint(1, vocabulary)}" for _ in range(rng.randint(0, 30)))) for i in range(-5, 40)]
    rows += [(100, None), (101, ""), (102, rows[3][1])]
    got = substring_dedup.remove_repeated_words(made(spark, rows), window=window).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got), key=repr) == words_brute(rows, window)


def test_repeated_words_with_repeated_and_null_ids(spark):
    rows = [(None, "a b c d e"), (1, "a b c d e"), (1, "b c d e f"), (2, "a b c d e f")]
    got = substring_dedup.remove_repeated_words(made(spark, rows[::-1]), window=4).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got), key=repr) == words_brute(rows, 4)
    assert substring_dedup.remove_repeated_words(made(spark, []), window=4).count() == 0


def test_common_subsequence():
    rng = random.Random(1)
    for _ in range(200):
        a, b = ([rng.randint(0, 5) for _ in range(rng.randint(0, 15))] for _ in range(2))
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        assert decontamination.common_subsequence(a, b) == table[-1][-1]


def test_leaks_verbatim_and_paraphrased(spark):
    rng = random.Random(4)
    word = lambda n=3000: f"w{rng.randint(0, n)}"
    items = [[word(10**6) if k % 2 else word(200) for k in range(rng.randint(18, 70))] for _ in range(30)]
    rows, truth = [], set()
    for i in range(200):
        text = [word() for _ in range(rng.randint(20, 300))]
        at = rng.randrange(len(text))
        if i < 30:
            text[at:at] = items[i]
            truth.add((i, i))
        elif i < 45:  # a third of the words changed, the answer kept
            q = items[i - 30][:48]
            text[at:at] = [x if k % 3 or k >= len(q) - 5 else word() for k, x in enumerate(q)]
            truth.add((i, i - 30))
        rows.append((i, " ".join(text)))
    rows += [(900, None), (901, ""), (902, "w1"), (None, " ".join(items[0]))]
    bench = spark.createDataFrame([(i, " ".join(q)) for i, q in enumerate(items)] + [(77, None), (78, "")], "item_id bigint, text string")
    got = {(r.doc_id, r.item_id) for r in decontamination.find_leaks(made(spark, rows), bench).collect()}
    assert (None, 0) in got and got - {(None, 0)} <= truth and len(got & truth) >= 0.9 * len(truth)
    assert {(i, i) for i in range(30)} <= got
    assert decontamination.find_leaks(made(spark, rows), bench.limit(0)).count() == 0
    assert decontamination.find_leaks(made(spark, []), bench).count() == 0


def test_leaks_of_an_item_in_a_third_of_the_documents(spark):
    rng = random.Random(5)
    items = [[f"q{i}x{k}" for k in range(n)] for i, n in enumerate((30, 12, 40, 25))]
    rows, truth = [], set()
    for d in range(90):
        text = [f"w{rng.randint(0, 3000)}" for _ in range(rng.randint(40, 120))]
        for i in {0: (0, 1), 1: (2,) if d == 1 else ()}.get(d % 3, ()):
            at = rng.randrange(len(text))
            text = [*text[:at], *items[i], *text[at:]] if i != 1 else [*text, *items[i]]
            truth.add((d, i))
        rows.append((d, " ".join(text)))
    truth = {(d, i) for d, i in truth if any(" ".join(items[i]) in t for x, t in rows if x == d)}
    assert len({d for d, i in truth if i == 1}) == 30
    bench = spark.createDataFrame([(i, " ".join(q)) for i, q in enumerate(items)], "item_id bigint, text string")
    got = {(r.doc_id, r.item_id) for r in decontamination.find_leaks(made(spark, rows), bench).collect()}
    assert truth <= got and all(i in (0, 1, 2) and (i == 2) == (d == 1) for d, i in got)


def test_leaks_of_items_of_mostly_common_words(spark):
    rng = random.Random(6)
    items = [[f"q{i}x{k}" if k % 4 == 3 else f"c{rng.randrange(40)}" for k in range(32)] for i in range(10)]
    rows = []
    for d in range(100):
        text = [f"c{rng.randrange(40)}" if k % 3 == 0 else f"w{rng.randint(0, 3000)}" for k in range(120)]
        rows.append((d, " ".join([*text[:50], *(items[d] if d < 10 else []), *text[50:]])))
    bench = spark.createDataFrame([(i, " ".join(q)) for i, q in enumerate(items)], "item_id bigint, text string")
    got = {(r.doc_id, r.item_id) for r in decontamination.find_leaks(made(spark, rows), bench).collect()}
    assert got == {(i, i) for i in range(10)}


def test_leaks_against_brute_force(spark):
    """Every passage against every stretch of a document, without lists or cosine; some items of words that all documents have."""
    rng = random.Random(8)
    common = [f"c{k}" for k in range(30)]
    items = [[rng.choice(common) if i % 4 == 0 or rng.random() < 0.4 else f"q{rng.randint(0, 10**5)}" for _ in range(rng.randint(12, 60))] for i in range(24)]
    rows = []
    for d in range(72):
        text = [rng.choice(common) if rng.random() < 0.6 else f"w{rng.randint(0, 2000)}" for _ in range(rng.randint(30, 260))]
        change = (d // 24) * 0.2
        at = rng.randrange(len(text))
        text[at:at] = [f"w{rng.randint(0, 2000)}" if rng.random() < change else x for x in items[d % 24]]
        rows.append((d, " ".join(text)))

    def held(text, item, reach):
        starts = [*range(0, max(len(item) - 48, 0), 24), max(len(item) - 48, 0)]
        return any(decontamination._overlap(item[s : s + 48], text[k : k + reach], 0.8, 0.55, 5) for s in starts for k in range(max(1, len(text) - reach + 1)))

    texts = [t.split() for _, t in rows]
    near, far = ({(d, i) for d, t in enumerate(texts) for i, q in enumerate(items) if held(t, q, reach)} for reach in (decontamination.REACH, decontamination.REACH + decontamination.STEP))
    bench = spark.createDataFrame([(i, " ".join(q)) for i, q in enumerate(items)], "item_id bigint, text string")
    got = {(r.doc_id, r.item_id) for r in decontamination.find_leaks(made(spark, rows), bench).collect()}
    assert {(d, d % 24) for d in range(24)} <= got <= far and len(got & near) >= 0.95 * len(near) >= 0.95 * 40


def test_the_latent_space_is_that_of_all_passages(spark, monkeypatch):
    """Against dense products of every passage of long texts."""
    rng = random.Random(9)
    texts = [" ".join(f"w{min(rng.randrange(1, 300), rng.randrange(1, 300))}" for _ in range(48 * 30 + d)) for d in range(12)] + [None, "", "unknown"]
    items = [(i, " ".join(f"w{rng.randrange(1, 300)}" for _ in range(40))) for i in range(12)]
    spaces, factorised = [], decontamination._factorised
    monkeypatch.setattr(decontamination, "RANK", 6)
    monkeypatch.setattr(decontamination, "_factorised", lambda *args: spaces.append(factorised(*args)) or spaces[0])
    decontamination.find_leaks(made(spark, list(enumerate(texts))), spark.createDataFrame(items, "item_id bigint, text string"))
    space = spaces[0]
    cuts = [" ".join(w[k : k + 48]) for w in ((t or "").split() for t in texts) for k in range(0, len(w), 48)] + [t for _, t in items]
    row, dimension, value = space.rows(*decontamination._hashed(pa.array(cuts)))
    dense = np.zeros((len(cuts), space.dimensions))
    np.add.at(dense, (row, dimension), value)
    basis = np.linalg.qr(np.random.default_rng(3).standard_normal((space.dimensions, 6)))[0]
    for _ in range(2):
        basis = np.linalg.qr(dense.T @ (dense @ basis))[0]
    assert np.abs(space.basis @ space.basis.T - basis @ basis.T).max() < 1e-3


def test_the_pipelines_stage_fits_all_passages(spark, monkeypatch, tmp_path):
    seen, factorised = [], decontamination._factorised

    def spied(numbered, *more):
        seen.extend(len(r.sizes) for r in numbered.collect())
        return factorised(numbered, *more)

    monkeypatch.setattr(decontamination, "_factorised", spied)
    spark.createDataFrame([(1, "q1 q2 q3 q4 q5 q6 q7 q8")], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = made(spark, [(1, "q1 w " * 48 * 20), (2, "q1 q2 q3 q4 q5 q6 q7 q8"), (3, None)])
    assert sorted(r.doc_id for r in corpus_pipeline.decontaminate(spark, docs, str(tmp_path)).collect()) == [1, 3]
    assert sorted(seen) == [0, 1, 40]


def test_sampled_passages_of_every_document():
    lengths = [0, 48 * 60, 20, 48 * 9 + 1, 100]
    bounds = np.append(0, np.cumsum(lengths))
    words = near_duplicates.mixed(np.arange(bounds[-1], dtype=np.uint64))
    got, cut = decontamination.sampled_passages(words, bounds)
    place = {int(x): k for k, x in enumerate(words)}
    starts = np.array([place[int(x)] for x in got[cut[:-1]]])
    text = np.searchsorted(bounds, starts, "right") - 1
    assert np.bincount(text, minlength=5).tolist() == [0, 8, 1, 8, 3]
    assert starts[text == 1].max() > 48 * 8 and np.diff(cut).max() == 48 and len(got) == cut[-1]
    assert decontamination.sampled_passages(words[:0], np.zeros(1, np.int64))[1].tolist() == [0]


def test_pipeline_stages_against_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert len(stages) == 5
    good = stages["quality classifier"](spark, docs, sf)
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    kept = {r.doc_id: r.text for r in good.collect()}
    assert good.columns == docs.columns and sum((i in kept) == bool(q) for i, q in labels.items()) >= 0.97 * len(labels)
    _, root = near(list(kept.items()), corpus_pipeline.SIMILAR_PERCENT)
    single = stages["MinHash near-dedup"](spark, spark.createDataFrame(good.toPandas(), docs.schema), sf)
    left = {r.doc_id: r.text for r in single.collect()}
    assert single.columns == docs.columns and set(left) == {i for i in kept if root[i] == i}
    cut = stages["suffix-array dedup"](spark, spark.createDataFrame(single.toPandas(), docs.schema), sf).toPandas()
    expected = {i: (n - gone, sha) for i, n, gone, _, sha in bytes_brute([(i, t.encode()) for i, t in left.items()], 200, lambda x: x.decode("utf-8", "ignore").encode())}
    whole = {i: x for i, x in zip(cut["doc_id"], cut["text"], strict=True)}
    assert set(whole) == set(left) and list(cut.columns) == docs.columns and (cut["n_chars"] == cut["text"].str.len()).all()
    assert all(hashlib.sha256(whole[i].encode()).hexdigest() == sha for i, (n, sha) in expected.items())
    clean = stages["benchmark decontamination"](spark, spark.createDataFrame(cut, docs.schema), sf)
    items = [" ".join(r.text.lower().split()) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    leaked = {i for i, t in whole.items() if any(q in " ".join(t.lower().split()) for q in items)}
    stay = {r.doc_id for r in clean.collect()}
    assert clean.columns == docs.columns and not stay & leaked and len(stay) >= len(whole) - len(leaked) - 2
    out = stages["SentencePiece sampling"](spark, clean, sf).collect()
    assert {r.doc_id for r in out} == stay and all(r.lossless for r in out)


def test_pipeline_on_empty_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, "/root/testdata/sf0.001")
        assert out.count() == 0
        docs = out if out.columns == docs.columns else docs


def test_stages_with_clashing_columns(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(60)
    names = ["quality_score", "word", "bits", "gone", "key", "spans", "span_key", "__word", "rate"]
    wide = docs.withColumns({n: F.lit(k) for k, n in enumerate(names)})
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, wide, "/root/testdata/sf0.001")
        assert out.columns == wide.columns and all(tuple(r)[-len(names) :] == tuple(range(len(names))) for r in out.collect()), name


def test_stage_keeps_null_ids(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(20)
    docs = docs.withColumn("doc_id", F.when(F.col("doc_id") > 0, F.col("doc_id")))
    out = corpus_pipeline.near_dedup(spark, docs, "")
    assert out.where("doc_id is null").count() == docs.where("doc_id is null").count()


def test_similarities_that_would_lose_links_are_refused(spark):
    with pytest.raises(ValueError, match="0.80"):
        near_duplicates.near_duplicates(spark.createDataFrame([(1, "a")], "doc_id bigint, text string"), percent=79)
