"""Language identification, token files, quality rules, piece sampling, chat formatting, neighbour quality."""

import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from schemaweave.llm import chat_format, language_id, neighbour_quality, piece_sampling, quality_rules, token_files
from schemaweave.llm.queries import tokenizer
from schemaweave.llm.shared import remainder, shared_path

ODD = [None, "", " \n\t", "1234 !!", "é" * 70000, "a" * 50000 + " b", "same text here", "same text here"]
SCHEMA = "doc_id bigint, text string, lang string, score double, key string"


def made(spark, rows):
    return spark.createDataFrame([(i, t, g, 0.5, "x") for i, t, g in rows], SCHEMA)


def speech(lang, n, seed):
    rng = random.Random(f"{lang}{seed}")
    parts = {"aa": ["ka", "ti", "lo", "mu"], "bb": ["sch", "ung", "ein", "pf"], "cc": ["eau", "tion", "ré", "ou"]}[lang]
    return " ".join("".join(rng.choice(parts) for _ in range(rng.randint(1, 4))) for _ in range(n))


def test_language_id_learns_and_handles_odd_texts(spark):
    rows = [(i, speech(g, 12, i), g) for i, g in enumerate(["aa", "bb", "cc"] * 40)] + [(1000 + i, t, None) for i, t in enumerate(ODD)] + [(None, "ka ti", "aa")]
    docs = made(spark, rows)
    held = remainder(F.col("doc_id"), 4) == 2
    model = language_id.train(docs, ~held)
    assert model.languages == ["aa", "bb", "cc"]
    out = {(r.doc_id, i): r for i, r in enumerate(language_id.predict(docs, model).collect())}
    assert len(out) == len(rows)
    by = {r.doc_id: r for r in out.values()}
    truth = {i: g for i, _, g in rows if g and i is not None}
    test = [i for i in truth if zlib.crc32(str(i).encode()) % 4 == 2]
    assert sum(by[i].lang_pred == truth[i] for i in test) >= 0.95 * len(test)
    assert all(0 <= r.score <= 1 for r in out.values())
    assert [by[1000 + k].lang_pred for k in range(4)] == ["und"] * 4 and by[1003].score == 0
    assert by[1006].lang_pred == by[1007].lang_pred


def test_language_id_without_training_rows(spark):
    docs = made(spark, [(1, "abc", None)])
    model = language_id.train(docs, F.lit(True))
    assert [r.lang_pred for r in language_id.predict(docs, model).collect()] == ["und"]
    assert language_id.predict(docs.limit(0), model).count() == 0


def test_marks_that_are_no_letters_are_undetermined(spark):
    docs = made(spark, [(i, speech(g, 12, i), g) for i, g in enumerate(["aa", "bb"] * 20)] + [(100, "½ ² ① _ 7", None), (101, "½ ª", None), (102, "ʰ", None)])
    got = {r.doc_id: (r.lang_pred, r.score) for r in language_id.predict(docs, language_id.train(docs, F.lit(True))).collect()}
    assert got[100] == ("und", 0.0) and got[101][0] != "und" and got[102][0] != "und"


def test_no_language_is_left_out(spark):
    docs = made(spark, [(i, speech("aa", 6, i) + f" zz{i % 150}", f"x{i % 150}") for i in range(450)])
    model = language_id.train(docs, F.lit(True))
    assert len(model.languages) == 150 and model.code.shape[0] == 150
    assert language_id.predict(docs, model).where("lang_pred = 'und'").count() == 0


def test_decoding_takes_the_nearest_codeword():
    rng = np.random.default_rng(2)
    code = language_id.codewords(5)
    model = language_id.LanguageModel(list("abcde"), code, np.zeros((1, code.shape[1])), rng.uniform(0.5, 3, code.shape[1]))
    margins = rng.normal(0, 2, (50, code.shape[1]))
    brute = [[sum(t * math.log1p(math.exp(-m * c)) for m, c, t in zip(row, word, model.trust, strict=True)) / model.trust.sum() for word in code] for row in margins]
    assert np.allclose(language_id._losses(model, margins), brute)


def test_codewords_differ():
    for n in (2, 3, 4, 6, 9, 30):
        code = language_id.codewords(n)
        apart = min(int((a != b).sum()) for a, b in itertools.combinations(code, 2))
        assert code.shape[0] == n and apart >= max(1, min(2 ** (n - 2), code.shape[1] // 5))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 3), st.integers(0, 60000), st.integers(0, 2**64 - 1)), max_size=3000))
def test_simple8b_round_trip(ids):
    ids = np.array(ids, np.uint64)
    packed = token_files.pack(ids)
    assert (token_files.unpack(packed) == ids).all()
    assert (token_files.unpack(packed, 1, 2) == ids[1024:2048]).all()


def test_token_files_match_the_library(spark):
    from tokenizers import Tokenizer

    path = tokenizer("word_bpe_49k.json")
    texts = [*ODD[:4], "don't <|endoftext|> x<|startoftext|>y 'S 'TIS ÉCOLE ﬁ İx ΑΣ. 日本 3a4b < <|", "a\x0bb\x0cc\x7f \x01", "nb sp z", *ODD[4:]]
    rows = [(i * 7 % 11 if i < 9 else 5, t, None) for i, t in enumerate(texts)] + [(None, "first", None)]
    out = shared_path(spark, "t")
    token_files.write(made(spark, rows), out, path)
    tk = Tokenizer.from_file(path)
    expected, at = [], 0
    for i, t in sorted(((i, t) for i, t, _ in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "")):
        ids = [*tk.encode(t or "", add_special_tokens=False).ids, 2]
        expected.append((i, at, ids))
        at += len(ids)
    assert sorted((r.doc_id is not None, r.start, r.doc_id, list(r.ids)) for r in token_files.read(spark, out).collect()) == sorted((i is not None, s, i, ids) for i, s, ids in expected)
    got = {r.start: (r.n_tokens, r.ids_crc32) for r in token_files.read(spark, out, digests=True).collect()}
    assert got == {s: (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())) for _, s, ids in expected}
    empty = shared_path(spark, "t")
    token_files.write(made(spark, rows).limit(0), empty, path)
    assert token_files.read(spark, empty).count() == 0


def test_token_files_of_a_tokenizer_to_which_white_space_matters(spark):
    from tokenizers import Tokenizer

    path, out = tokenizer("byte_bpe_50k.json"), shared_path(spark, "t")
    texts = ["two  spaces and\ttabs\n\n end ", " lead", None, "é 日本 x", *ODD[4:]]
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    token_files.write(made(spark, [(i, t, None) for i, t in enumerate(texts)]), out, path)
    tk = Tokenizer.from_file(path)
    assert {r.doc_id: list(r.ids) for r in token_files.read(spark, out).collect()} == {i: [*tk.encode(t or "", add_special_tokens=False).ids, 2] for i, t in enumerate(texts)}
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == before


def measures(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    c = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    covered = {k for i in range(len(w) - 4) if c[tuple(w[i : i + 5])] > 1 for k in range(i, i + 5)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        dup += line in seen and bool(re.search(r"[^\x20\x09-\x0D]", line))
        seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered)


def test_measures_against_brute_force(spark):
    rng = random.Random(1)
    texts = [*ODD, *("".join(rng.choice(["a ", "b ", "é ", "\n", "# ", "a b c d e ", "\t"]) for _ in range(rng.randint(0, 60))) for _ in range(120))]
    got = quality_rules.measure(made(spark, [(i, t, None) for i, t in enumerate(texts)]), F.col("lang")).collect()
    assert {r.doc_id: tuple(r[m] for m in quality_rules.MEASURES) for r in got} == {i: measures(t) for i, t in enumerate(texts)}
    assert quality_rules.measure(made(spark, []), F.col("lang")).count() == 0


def test_binomial_tail():
    for k, n, p in [(0, 10, 0.1), (3, 50, 0.05), (7, 300, 0.0125), (5, 5, 0.3)]:
        assert quality_rules.binomial_tail(k, n, p) == pytest.approx(sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1)))


def test_binomial_tail_of_large_numbers():
    """Against the sum in logarithms, beyond that the normal law with its first correction, whose error falls with n, and ratios of neighbouring probabilities."""
    p = 0.0125
    for k in (11_830, 12_100, 12_450):
        terms = [math.lgamma(10**6 + 1) - math.lgamma(i + 1) - math.lgamma(10**6 - i + 1) + i * math.log(p) + (10**6 - i) * math.log1p(-p) for i in range(k + 1)]
        assert quality_rules.binomial_tail(k, 10**6, p) == pytest.approx(math.exp(terms[-1]) * math.fsum(math.exp(t - terms[-1]) for t in terms), rel=1e-7)
    for n, close in ((10**9, 2e-3), (10**12, 2e-5)):
        sigma = math.sqrt(n * p * (1 - p))
        for z in (-6.0, -4.0, -2.0, -0.5):
            k = math.floor(n * p + z * sigma)
            x = (k + 0.5 - n * p) / sigma
            law = 0.5 * math.erfc(-x / math.sqrt(2)) - (1 - 2 * p) / (6 * sigma) * (x * x - 1) * math.exp(-x * x / 2) / math.sqrt(2 * math.pi)
            assert quality_rules.binomial_tail(k, n, p) == pytest.approx(law, rel=close)
    a, b, c = (quality_rules.binomial_tail(k, 10**9, 0.0125) for k in (12_480_000, 12_480_001, 12_480_002))
    assert (c - b) / (b - a) == pytest.approx((10**9 - 12_480_001) * 0.0125 / (12_480_002 * 0.9875), rel=1e-6)
    assert quality_rules.binomial_tail(0, 10**12, 0.0125) == 0.0 and quality_rules.binomial_tail(600, 1000, 0.0125) == 1.0


def test_rules_reject_bad_and_keep_their_promise(spark):
    rng = random.Random(2)
    rows, labels = [], []
    for i in range(3000):
        bad = i % 4 == 0
        words = [f"w{rng.randint(0, 10**6)}" + ("***" if bad and rng.random() < 0.9 else "") for _ in range(20)]
        rows.append((i, " ".join(words), "aa" if i % 2 else None))
        labels += [(i, not bad)] * (1 + i % 2)
    rows += [(9000, "", "aa"), (9001, None, None)]  # have no words to divide by
    measured = quality_rules.measure(made(spark, rows), F.col("lang"))
    certified = quality_rules.certify(measured, spark.createDataFrame(labels, "doc_id bigint, good boolean"))
    out = {r.doc_id: r for r in quality_rules.apply_rules(measured, certified).collect()}
    assert len(out) == 3002 and out[9000].base_failed and not any(out[i].kept for i in range(0, 3000, 4))
    assert sum(not out[i].kept for i in range(3000) if i % 4) <= 0.05 * 2250
    none = quality_rules.certify(measured, spark.createDataFrame([], "doc_id bigint, good boolean"))
    assert quality_rules.apply_rules(measured, none).where("kept").count() == 3000


def test_pieces_are_lossless_reproducible_and_rightly_distributed(spark):
    model = tokenizer("piece_bpe_32k.model")
    texts = [*ODD, "a▁b  c\n\n 日本語 😀\x00", "x" * 3000, "the  ", "\x85 "]
    docs = made(spark, [(i, t, None) for i, t in enumerate(texts)] + [(None, "null key", None)])
    one = {r.doc_id: list(r.pieces) for r in piece_sampling.sample_pieces(docs, model).collect()}
    two = {r.doc_id: list(r.pieces) for r in piece_sampling.sample_pieces(docs.repartition(7), model).collect()}
    assert one == two and one[0] == [] and one[1] == []
    back = {r.doc_id: r.text for r in piece_sampling.decode_pieces(piece_sampling.sample_pieces(docs, model), model).collect()}
    assert all(back[i] == (t or "") for i, t in enumerate(texts))
    digest = piece_sampling.sample_pieces(docs, model, digests=True).collect()
    assert all(r.lossless for r in digest) and {r.doc_id: r.n_pieces for r in digest} == {i: len(p) for i, p in one.items()}
    assert piece_sampling.sample_pieces(docs.limit(0), model).count() == 0
    s = piece_sampling.Sampler(piece_sampling.vocabulary(model), 1.0, 3)

    def ways(u):
        if not u:
            yield (), 1.0
        for k in range(1, len(u) + 1):
            i, w = s.weights.get(u[:k], (-1, 0))
            if i >= 0:
                yield from (((i, *r), w * q) for r, q in ways(u[k:]))

    expected = dict(ways("▁thing"))
    ids, counts = s.sample([" thing"] * 20000, np.arange(20000, dtype=np.uint64))
    stop = np.cumsum(counts)
    seen = Counter(tuple(ids[b - n : b].tolist()) for b, n in zip(stop, counts, strict=True))
    assert set(seen) <= set(expected)
    assert all(abs(seen[k] / 20000 - w / sum(expected.values())) < 0.02 for k, w in expected.items())


def test_long_units_without_a_lattice(spark, monkeypatch):
    model = tokenizer("piece_bpe_32k.model")
    s = piece_sampling.Sampler(piece_sampling.vocabulary(model), 1.0, 3)
    keys = np.arange(6000, dtype=np.uint64)

    def drawn():
        ids, counts = s.sample([" there▁é"] * 6000, keys)
        stop = np.cumsum(counts)
        assert s.decode(ids) == " there▁é".encode() * 6000
        return Counter(tuple(ids[b - n : b].tolist()) for b, n in zip(stop, counts, strict=True))

    lattice = drawn()
    monkeypatch.setattr(piece_sampling, "LONG", 1)
    s.clear()
    alone = drawn()
    assert all(abs(lattice[k] - alone[k]) < 5 * math.sqrt(max(lattice[k], alone[k], 9)) for k in lattice | alone)
    long = ["ab" * 150_000, "日本語" * 30_000, "\x00" * 9000, "the " * 2000 + "Q" * 5000]
    docs = made(spark, [(i, t, None) for i, t in enumerate(long)])
    out = piece_sampling.sample_pieces(docs, model, digests=True).collect()
    assert all(r.lossless for r in out) and {r.doc_id: r.pieces_crc32 for r in out} == {r.doc_id: r.pieces_crc32 for r in piece_sampling.sample_pieces(docs.repartition(3), model, digests=True).collect()}


def test_chat_parts_and_round_trip(spark):
    rows = [
        (1, 0, "user", [("text", "see <|image|> \\ <|", None, None), ("image", None, "i.png", 7), ("audio", None, "a.wav", None), ("new", None, "n", None)]),
        (1, 1, "assistant", [("text", "<|end|>ok\\", None, None), ("document", None, "d.pdf", 9)]),
        (1, 1, "assistant", [("text", "<|end|>ok\\", None, None), ("document", None, "d.pdf", 9)]),
        (2, None, None, None), (None, 3, "assistant", [(None, None, None, None)]),
    ]
    made_ = chat_format.format_conversations(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, parts " + chat_format.PARTS)).withColumn("turns", chat_format.read_turns(F.col("formatted")))
    out = {r.conv_id: r for r in chat_format.with_loss_text(made_).collect()}
    a = out[1]
    assert a.n_turns == 3 and [(t.role, t.text) for t in a.turns][0] == ("user", "see <|image|> \\ <|<|image|><|audio|><|unknown|>")
    assert a.loss == "<|end|>ok\\<|document|>" * 2 and a.expanded_tokens == 7 + 128 + 0 + 9 + 9
    assert [(x.position, x.turn_index, x.type, x.uri) for x in a.attachments] == [(0, 0, "image", "i.png"), (1, 0, "audio", "a.wav"), (2, 0, "new", "n"), (3, 1, "document", "d.pdf"), (4, 2, "document", "d.pdf")]
    assert out[2].n_turns == 1 and out[2].loss == "" and out[None].turns[0].text == ""
    for by in (1, -1, 1000):  # the text comes from where the mask says
        moved = made_.withColumn("loss_mask", F.transform("loss_mask", lambda m: m.withField("start", m["start"] + by)))
        assert chat_format.with_loss_text(moved).where("conv_id = 1").first().loss != a.loss


def test_neighbour_quality_on_held_out_rows(spark):
    rng = random.Random(5)
    rows, labels = [], []
    for i in range(400):
        w = [speech("aa", 1, rng.random()) for _ in range(30)]
        bad = i % 3 == 0
        rows.append((i, " | ".join(w) if bad else " ".join(w).capitalize() + ".", None))
        labels.append((i, 0 if bad else 1))
    labels += [(5000, None), (None, 1), (2, 0)]
    rows += [(1000 + k, t, None) for k, t in enumerate(ODD)]
    docs = made(spark, rows)
    held = remainder(F.col("doc_id"), 5) == 0
    model = neighbour_quality.fit(docs, spark.createDataFrame(labels, "doc_id bigint, quality int"), ~held)
    out = neighbour_quality.score_rows(docs, model)
    assert out.columns[:5] == docs.columns and out.count() == len(rows)
    got = {r.doc_id: r[neighbour_quality.SCORE] for r in out.collect()}
    test = [i for i in range(400) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert sum((got[i] >= 0.3) == (i % 3 != 0) for i in test) >= 0.95 * len(test)
    assert all(0 <= x <= 1 for x in got.values()) and got[1000] == got[1001]
    blank = neighbour_quality.fit(docs, spark.createDataFrame([], "doc_id bigint, quality int"), F.lit(True))
    assert {r[neighbour_quality.SCORE] for r in neighbour_quality.score_rows(docs, blank).collect()} == {0.5}




def test_neighbours_vote_as_in_a_plain_loop():
    rng = np.random.default_rng(4)
    counts = rng.poisson(0.02, (12, neighbour_quality.TERMS)).astype(np.float32)
    vectors = rng.standard_normal((90, 8)).astype(np.float32)
    vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
    vectors[40:60] = vectors[:20]  # ties
    labels, weights = (np.arange(90) % 3 > 0).astype(float), rng.uniform(0.2, 1, 90)
    model = neighbour_quality.NeighbourModel(np.ones(neighbour_quality.TERMS, np.float32), rng.standard_normal((neighbour_quality.TERMS, 8)).astype(np.float32), vectors, labels, weights, 0.7)
    own = model.embed(counts)
    for x, got in zip(own, model.score(counts), strict=True):
        near = [float(np.float32(x @ v)) for v in vectors]
        best = sorted(range(90), key=lambda i: (-round(near[i] * 2**20), i))[: neighbour_quality.NEIGHBOURS]
        votes = [max(near[i], 0) ** 8 * weights[i] for i in best]
        assert got == pytest.approx((0.01 * 0.7 + sum(v * labels[i] for v, i in zip(votes, best, strict=True))) / (0.01 + sum(votes)), rel=1e-3)


def test_quality_that_only_words_tell(spark):
    """Both kinds have the same layout: lower-case words of the same lengths."""
    rng = random.Random(6)
    kinds = [["".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(60)] for _ in range(2)]
    rows = [(i, " ".join(rng.choice(kinds[i % 2]) for _ in range(40)), None) for i in range(300)]
    docs, held = made(spark, rows), remainder(F.col("doc_id"), 5) == 0
    model = neighbour_quality.fit(docs, spark.createDataFrame([(i, i % 2) for i in range(300)], "doc_id bigint, quality int"), ~held)
    got = {r.doc_id: r.s for r in neighbour_quality.score_rows(docs, model, score="s").collect()}
    test = [i for i in got if zlib.crc32(str(i).encode()) % 5 == 0]
    assert sum((got[i] >= 0.5) == bool(i % 2) for i in test) >= 0.95 * len(test)
