"""Vector codes, secret spans and the filter audit against brute force."""

import hashlib
import itertools
import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from schemaweave.llm import code_compression, filter_audit, secret_spans
from schemaweave.llm.shared import with_group


def nearest(points, book):
    apart = ((points[:, None, :].astype(object) - book[None].astype(object)) ** 2).sum(2)
    return np.array([min(range(len(book)), key=lambda e: (row[e], e)) for row in apart]), apart


def lloyd(cells, parts=4, entries=256, rounds=4):
    """Codes, errors and codebooks of integer vectors in order of their ids, by the definition."""
    split = np.array(cells).reshape(len(cells), parts, -1).transpose(1, 0, 2)
    books, codes, errors = [], [], 0
    for own in split:
        book = own[:entries].copy()
        for _ in range(rounds):
            code, _ = nearest(own, book)
            for e in range(len(book)):
                if (code == e).any():
                    book[e] = own[code == e].sum(0) // (code == e).sum()
        code, apart = nearest(own, book)
        books.append(book)
        codes.append(code)
        errors = errors + np.array([apart[i, c] for i, c in enumerate(code)])
    return ["".join(f"{c:02x}" for c in x) for x in zip(*codes, strict=True)], [int(x) for x in errors], np.array(books)


@settings(max_examples=40, deadline=None)
@given(st.integers(1, 300), st.integers(1, 40), st.integers(1, 5), st.sampled_from([1, 3, 50, 1 << 24]), st.integers(0, 1000))
def test_filtered_trees_assign_like_brute_force(n, entries, width, span, seed):
    rng = np.random.default_rng(seed)
    points, book = rng.integers(-span, span + 1, (n, width)), rng.integers(-span, span + 1, (entries, width))
    tree = code_compression.Tree.unpacked(code_compression.build(points).packed(), width)
    entry, apart = nearest(points, book)
    got, squares = code_compression.assigned(tree, book)
    assert (got == entry).all() and squares.tolist() == [int(a[e]) for a, e in zip(apart, entry, strict=True)]
    counts, sums = code_compression.summed(tree, book)
    for e in range(entries):
        assert counts[e] == (entry == e).sum() and (sums[e] == points[entry == e].sum(0)).all()


def test_boxes_far_from_other_entries_are_assigned_whole():
    points = np.concatenate([np.random.default_rng(1).integers(0, 50, (500, 4)), np.random.default_rng(2).integers(10_000, 10_050, (500, 4))])
    whole, single = code_compression.filtered(code_compression.build(points), np.array([[20] * 4, [10_020] * 4]))
    assert sorted(e for _, e in whole) == [0, 1] and not single


@pytest.mark.parametrize("partitions", [1, 6])
def test_codes_equal_lloyds_rounds(spark, monkeypatch, partitions):
    monkeypatch.setattr(code_compression, "CHUNK_BYTES", 4 * 8 * 100)
    rng = np.random.default_rng(4)
    vectors = [rng.normal(0, 0.01, 8).tolist() for _ in range(330)] + [[0.004, -0.003] * 4] * 200
    rows = [(i, v, None if i % 7 == 0 else i % 3, "x", 1) for i, v in enumerate(vectors)]
    odd = [(-1, None, 1, "x", 1), (-2, [None] + [0.0] * 7, 1, "x", 1), (-3, [float("nan")] * 8, 1, "x", 1), (-4, [float("inf")] + [0.0] * 7, 1, "x", 1), (1000, [0.5] * 4, 1, "x", 1), (1001, [], 1, "x", 1), (1002, [0.1] * 7, 1, "x", 1)]
    table = spark.createDataFrame(rows + odd, "vec_id bigint, embedding array<double>, label int, code string, error int").repartition(partitions)
    coded, books = code_compression.compress(table)
    got = {r.vec_id: (r.code, r.error) for r in coded.collect()}
    codes, errors, expected = lloyd([[math.floor(1024 * x) for x in v] for v in vectors])
    assert (books == expected).all()
    assert {i: got[i] for i in range(len(vectors))} == {i: x for i, x in enumerate(zip(codes, errors, strict=True))}
    assert [got[i] for i in (1000, 1001, 1002)] == [(None, None)] * 3 and len(got) == len(vectors) + 3
    assert code_compression.digest(books) == hashlib.sha256(",".join(str(x) for x in expected.ravel()).encode()).hexdigest()


def test_codes_of_null_and_equal_ids_few_rows_and_none(spark):
    schema = "vec_id bigint, embedding array<float>, label string"
    table = spark.createDataFrame([(None, [1.0] * 4, None), (5, [2.0] * 4, "a"), (5, [-2.0] * 4, "a"), (7, [1e30] * 4, "b")], schema)
    coded, books = code_compression.compress(table)
    assert books[0].ravel().tolist() == [-2048, 2048, code_compression.LIMIT, 1024]
    assert sorted((str(r.vec_id), r.code, r.error) for r in coded.collect()) == [("5", "00000000", 0), ("5", "01010101", 0), ("7", "02020202", 0), ("None", "03030303", 0)]
    none, books = code_compression.compress(table.limit(0))
    assert none.count() == 0 and books.size == 0
    assert code_compression.digest(books) == hashlib.sha256(b"").hexdigest()


def test_hot_and_rare_groups_are_joined(spark, monkeypatch):
    monkeypatch.setattr("schemaweave.llm.shared.HOT", 4)
    rows = spark.createDataFrame([(i, None if i % 2 else f"g{i % 20}", i) for i in range(400)] + [(-1, "lone", 0)], "id int, label string, found int")
    groups = rows.groupBy("label").agg(F.count("*").alias("n"), F.sum("id").alias("total")).where("label is null or label != 'lone'")
    got = {r.id: r.total for r in with_group(rows, "label", groups, "n").collect()}
    assert len(got) == 401 and got[-1] is None and got[1] == sum(range(1, 400, 2)) and got[4] == sum(range(4, 400, 20))


def brute_spans(text):
    found = []
    for k, (kind, pattern, group, least) in enumerate([("assign", r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 12), ("access", "AKIA[A-Z0-9]+", 0, 18), ("hex", "[0-9a-f]+", 0, 16)]):
        flags = re.IGNORECASE | re.ASCII if kind == "assign" else 0
        found += [(m.start(), k, m.end()) for m in re.finditer(pattern, text, flags) if len(m[group]) >= least]
    return sorted(found)


pieces = st.sampled_from(["token", "Secret", "api_key", "APIKEY", "passwd", "toKen", "ſecret", " ", "  ", "=", ":", "\"", "'", "abcdefghijkl", "abcdefghijk", "AKIA", "AKIAABCDEFGHIJKLMN", "0123456789abcdef", "0123456789abcde", "é", "\n", "=x", "-"])


@settings(max_examples=300, deadline=None)
@given(st.lists(pieces, max_size=12).map("".join))
def test_patterns_equal_their_definition(text):
    assert [s[:3] for s in secret_spans.pattern_spans(text)] == brute_spans(text)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 7), min_size=1, max_size=4), st.sampled_from([0.3, 2.0, 9.0]), st.integers(0, 1000))
def test_viterbi_equals_all_paths(lengths, spread, seed):
    rng = np.random.default_rng(seed)
    bounds = np.concatenate([[0], np.cumsum(lengths)])
    scores, moves, begin = rng.normal(0, spread, (bounds[-1], 3)), rng.normal(0, 1, (3, 3)), rng.normal(0, 1, 3)
    tags = secret_spans.viterbi(scores, bounds, moves, begin)
    value = lambda at, path: begin[path[0]] + sum(scores[at + i, t] for i, t in enumerate(path)) + sum(moves[a, b] for a, b in itertools.pairwise(path))
    for at, n in zip(bounds, lengths, strict=False):
        if n:
            best = max(value(at, p) for p in itertools.product(range(3), repeat=n))
            assert value(at, tags[at : at + n].tolist()) == pytest.approx(best)


def test_gradient_equals_differences():
    rng = np.random.default_rng(3)
    bounds = np.array([0, 4, 4, 9, 10])
    features, tags = rng.integers(0, 6, (10, 3)), rng.integers(0, 3, 10)
    weights, moves, begin = rng.normal(size=(6, 3)), rng.normal(size=(3, 3)), rng.normal(size=3)

    def likelihood():
        total = 0.0
        for a, b in itertools.pairwise(bounds.tolist()):
            if a < b:
                of = lambda path: begin[path[0]] + sum(weights[features[a + i], t].sum() for i, t in enumerate(path)) + sum(moves[x, y] for x, y in itertools.pairwise(path))  # noqa: B023, E731
                total += of(tags[a:b].tolist()) - math.log(sum(math.exp(of(p)) for p in itertools.product(range(3), repeat=b - a)))
        return total

    got = secret_spans._gradient(features, tags, bounds, np.arange(4), weights, moves, begin)
    for gradient, parameter in zip(got, (weights, moves, begin), strict=True):
        for at in np.ndindex(parameter.shape):
            parameter[at] += 1e-5
            up = likelihood()
            parameter[at] -= 2e-5
            assert gradient[at] == pytest.approx((up - likelihood()) / 2e-5, abs=1e-5)
            parameter[at] += 1e-5


def prose(rng, n):
    return " ".join("".join(rng.choice(["ka", "ti", "lo", "mu", "en", "ra", "st", "or"]) for _ in range(rng.randint(1, 4))) for _ in range(n))


def test_field_adds_held_out_secrets_and_leaves_lookalikes(spark):
    rng = random.Random(8)
    drawn = lambda k: "".join(rng.choices("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", k=k))
    corpus = [(i, prose(rng, 60) + (f' token = "{drawn(30)}" ' if i % 5 == 0 else " ") + prose(rng, 20)) for i in range(300)]
    field = secret_spans.train(spark.createDataFrame(corpus, "doc_id bigint, text string"))
    hidden, plain = {}, []
    for i in range(200):
        before, value = prose(rng, 30), drawn(36)
        link = rng.choice([" password is ", " passphrase: ", " Authorization: Bearer ", " auth "])
        hidden[i] = (f"é {before}{link}{value} {prose(rng, 9)}", len(before) + 2 + len(link), value)
        plain.append((1000 + i, f"{prose(rng, 20)} token {prose(rng, 1)} {rng.randrange(10**9)} secret {prose(rng, 1)}. https://www.{prose(rng, 1)}.com/{prose(rng, 1)} {rng.choice('#$%')*3} {prose(rng, 9)}"))
    docs = spark.createDataFrame([(i, h[0]) for i, h in hidden.items()] + plain, "doc_id bigint, text string")
    got = {r.doc_id: [(s.kind, s.start, s.end) for s in r.spans] for r in secret_spans.find(docs, field).collect()}
    caught = sum(any(k == "tagged" and s <= h[1] and e >= h[1] + 36 for k, s, e in got[i]) for i, h in hidden.items())
    false = sum(bool(got[i]) for i, _ in plain)
    assert caught >= 180 and false <= 6, (caught, false)


def test_spans_of_odd_texts(spark):
    texts = [None, "", " \n\t", "é" * 70000, "a" * 50000 + " b", 'é token = "0123456789abcdef01"', 'é token = "0123456789abcdef01"', "x" * 3000 + " AKIAABCDEFGHIJKLMN", "###$$$"]
    docs = spark.createDataFrame([(i, t, "k", 1) for i, t in enumerate(texts)] + [(None, "AKIAABCDEFGHIJKLMN", "k", 1)], "doc_id bigint, text string, kind string, spans int")
    field = secret_spans.train(docs)
    rows = secret_spans.digests(secret_spans.find(docs, field)).collect()
    by = {r.doc_id: r for r in rows}
    for i, t in enumerate(texts):
        base = ",".join(f"{secret_spans.KINDS[k]}:{s}:{e}" for s, k, e in brute_spans(t or ""))
        assert by[i].base_sha256 == hashlib.sha256(base.encode()).hexdigest()
        assert base.split(",") == [s for s in by[i].spans.split(",") if not s.startswith("tagged")]
    assert (by[5].n_assign, by[5].n_hex, by[7].n_access, by[None].n_access) == (1, 1, 1, 1) and by[5][1:] == by[6][1:]
    empty = secret_spans.train(docs.limit(0))
    assert empty.weights is None and secret_spans.find(docs, empty).count() == len(texts) + 1 and secret_spans.find(docs.limit(0), field).count() == 0


def audited(rows, labels):
    """rows: (doc_id, text, source). By the definition, one order after the other."""
    good, toxic = {i for i, g, _ in labels if g}, {i for i, _, x in labels if x}
    docs = []
    for i, t, s in rows:
        t = t or ""
        ws = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {
            "A": len(ws) < 50, "B": 100 * len(set(ws)) < 65 * len(ws), "C": 100 * len(re.findall("[A-Z]", t)) > 5 * len(t), "D": bool(re.search(r"[#$%&*|]", t)),
            "E": i is not None and any(j is not None and j < i and (u or "") == t for j, u, _ in rows),
        }
        docs.append((i, s or "", fails))
    out = {}
    for part in {d[1] for d in docs}:
        own = [d for d in docs if d[1] == part]
        shapley = dict.fromkeys("ABCDE", 0)
        for order in map("".join, itertools.permutations("ABCDE")):
            left = own
            for step, x in enumerate(order, 1):
                gone, left = [d for d in left if d[2][x]], [d for d in left if not d[2][x]]
                shapley[x] += len(gone)
                out[part, order, step] = [len(left), len(gone), sum(d[2][x] for d in own) - len(gone), sum(d[2][x] and sum(d[2].values()) == 1 for d in own), sum(d[0] in good for d in gone), sum(d[0] in toxic for d in gone)]
        for (p, order, step), row in out.items():
            if p == part:
                row.append(shapley[order[step - 1]])
    return out


def test_audit_equals_every_order(spark):
    rng = random.Random(5)
    texts = [None, "", " \n", prose(rng, 60), prose(rng, 60) + " #", "Ab " * 60, "a b " * 60, prose(rng, 80).upper(), "é" * 3000, "same", "same"]
    rows = [(i, rng.choice(texts), rng.choice(["s", "s", "t", None, ""])) for i in range(150)] + [(None, "same", "s"), (3, "same", "only"), (3, "same", "only"), (200, prose(rng, 70), "clean")]
    labels = [(i, i % 3 == 0, i % 7 == 0) for i in range(100)] + [(0, None, None), (None, True, True), (5, True, False)]
    docs = spark.createDataFrame([(*r, 1, True) for r in rows], "doc_id bigint, text string, source string, copy int, n_words boolean")
    measured = filter_audit.measure(docs, F.col("source"), spark.createDataFrame(labels, "doc_id bigint, good boolean, toxic boolean"))
    got = {(r.part, r.filter_order, r.step): list(r[3:]) for r in filter_audit.audit(measured, filter_audit.FILTERS).collect()}
    assert got == audited(rows, [(i, g, x) for i, g, x in labels if i is not None])
    assert filter_audit.audit(measured.limit(0), filter_audit.FILTERS).count() == 0


def test_states_are_shared(spark):
    rows = spark.range(64).select(F.lit("p").alias("part"), *[(F.col("id").bitwiseAND(F.lit(1 << i)) > 0).alias(f"f{i}") for i in range(3)], (F.col("id") < 8).alias("good"))
    found = filter_audit.edges(rows, {x: f"f{i}" for i, x in enumerate("xyz")}, marks=("good",)).collect()
    assert len(found) == 3 * 4 and {(r.state, r.filter): r.removed for r in found}[3, 2] == 8
    assert sum(r.good for r in found if r.state == 0) == 12
