"""Spans of secrets in texts: fixed patterns, and a linear-chain conditional random field that adds to them.

A token is a run of letters, digits, `_` and other non-ASCII bytes, or one other character. The field tags each token
of a whole text as outside (O), beginning (B) or inside (I) a secret, from hashed features: its shape (length, kinds
of characters, changes between them, shares of digits and vowels), its word and first letters, shapes and words of
its neighbours, the words among the five before it, and features of the file (share of punctuation, of assignments,
length). Viterbi gives the best tags of the whole chain: a token whose lead for O is more than any pair of
neighbours could turn is O in every best chain, so only the stretches between such tokens are decoded, all of a batch
side by side. That is exact; a text with no such token is one stretch.

Training needs no marked secrets: windows of a bounded sample of documents (SAMPLE documents, WINDOWS windows with and
WINDOWS without pattern matches) carry the patterns' values as secrets, but for those of digits only; into copies of
them secrets of other alphabets and contexts, and look-alikes (numbers, names, addresses, paths), are put. The
likelihood of the tags is maximised on the driver, which sees nothing but these windows.

Spans of the field have kind `tagged` and are added where they overlap no span of a pattern; pattern spans always stay.

Cases: a null or empty text has no spans. Repeated rows are scanned alike. Rows with a null id or text aren't learned from;
equal windows count once. An empty table gives a field that tags nothing. Only the named columns are read;
find() returns the id and the spans.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from schemaweave.llm.arrays import U64, lowered, row_sums, span_hashes, text_bytes, text_slices

SAMPLE = 20_000
WINDOWS = 1500
#: Copies of windows that secrets or look-alikes are put into, at least (two of each window if that is more).
EXAMPLES = 3000
KINDS = ("assign", "access", "hex", "tagged")
#: Patterns of the kinds; group 1, if there is one, is the secret itself. Assignments shorter than ASSIGNED don't count.
PATTERNS = {
    "assign": re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII),
    "access": re.compile(r"AKIA[A-Z0-9]{14,}"),
    "hex": re.compile(r"[0-9a-f]{16,}"),
}
ASSIGNED = 12
#: Every text with a span matches one of these.
_ANY = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]|AKIA[A-Z0-9]{14}|[0-9a-f]{16}"""
_WEIGHTS = 1 << 15
_TAGS = 3
O, B, I = range(_TAGS)  # noqa: E741
_SPANS = "array<struct<kind:string,start:bigint,end:bigint>>"


def pattern_spans(text: str) -> list[tuple[int, int, int, int]]:
    """Start, place of the kind, end, and where the secret itself begins, of each match, in code points and in order."""
    found = []
    for k, kind in enumerate(KINDS[:3]):
        for m in PATTERNS[kind].finditer(text):
            if kind != "assign" or len(m[1]) >= ASSIGNED:
                found.append((m.start(), k, m.end(), m.start(1) if kind == "assign" else m.start()))
    return sorted(found)


def _classes() -> np.ndarray:
    c = np.full(256, 5, np.uint8)  # other characters
    c[[32, *range(9, 14)]] = 0
    c[ord("a") : ord("z") + 1], c[ord("A") : ord("Z") + 1], c[ord("0") : ord("9") + 1] = 1, 2, 3
    c[128:] = c[ord("_")] = 4
    return c


_CLASS = _classes()
_VOWEL = np.isin(np.arange(256), np.frombuffer(b"aeiouyAEIOUY", np.uint8))
_HEX = np.isin(np.arange(256), np.frombuffer(b"0123456789abcdef", np.uint8))
_ASSIGN = np.isin(np.arange(256), np.frombuffer(b"=:", np.uint8))
_LENGTHS = np.array([2, 3, 5, 8, 12, 16, 20, 28, 36, 48, 64])


class Tokens:
    """Tokens of many texts and their features: starts and ends (bytes), row of each, number before each row, code points."""

    def __init__(self, column: pa.Array) -> None:
        data, offsets = text_bytes(column)
        self.data, self.offsets = data, offsets
        kind = _CLASS[data]
        inner = (kind >= 1) & (kind <= 4)
        edge = np.zeros(len(data) + 1, bool)
        edge[offsets] = True
        follows = np.zeros(len(data), bool)  # the byte before is of the same token
        follows[1:] = inner[1:] & inner[:-1] & ~edge[1 : len(data)]
        solid = kind > 0
        self.starts = np.flatnonzero(solid & ~follows)
        last = solid.copy()
        last[:-1] &= ~follows[1:]
        self.ends = np.flatnonzero(last) + 1
        self.bounds = np.searchsorted(self.starts, offsets)
        self.row = np.repeat(np.arange(len(column)), np.diff(self.bounds))
        self.points = np.concatenate([np.zeros(1, np.int64), np.cumsum((data & 0xC0) != 0x80)])
        self._kind, self._follows = kind, follows

    def place(self, at: np.ndarray, row: np.ndarray) -> np.ndarray:
        """Bytes as code points of their texts."""
        return self.points[at] - self.points[self.offsets[row]]

    def _count(self, mask: np.ndarray) -> np.ndarray:
        total = np.concatenate([np.zeros(1, np.int32), np.cumsum(mask, dtype=np.int32)])
        return total[self.ends] - total[self.starts]

    def features(self, file: np.ndarray | None = None) -> Iterator[np.ndarray]:
        """For each template, the weight of each token. file: features of the rows' files, if the rows are only parts of them."""
        n, size = len(self.starts), self.ends - self.starts
        counts = [self._count(self._kind == c) for c in range(1, 6)]
        changes = np.zeros(len(self.data), bool)
        changes[1:] = self._follows[1:] & (self._kind[1:] != self._kind[:-1])
        length = np.digitize(size, _LENGTHS)
        sets = sum((c > 0).astype(np.int64) << i for i, c in enumerate(counts))
        changed = np.minimum(self._count(changes) * 12 // np.maximum(size, 6), 7)
        digits = counts[2] * 6 // size
        vowels = self._count(_VOWEL[self.data]) * 6 // np.maximum(counts[0] + counts[1], 1)
        hexes = (self._count(_HEX[self.data]) == size).astype(np.int64)
        shape = (((length * 32 + sets) * 8 + changed) * 2 + hexes).astype(U64) + U64(1)
        low = lowered(self.data)
        word = np.where(size <= 24, span_hashes(low, self.starts, self.ends), U64(3))
        prefix = span_hashes(self.data, self.starts, np.minimum(self.ends, self.starts + 4))
        blend = ((((sets * 7 + digits) * 7 + vowels) * 8 + changed) * 2 + hexes).astype(U64)
        file = self.file() if file is None else file
        in_file = (file[self.row] * 12 + length) * 32 + sets

        def weight(template: int, value: np.ndarray) -> np.ndarray:
            return (((value + U64(template * 0x51ED2701 + 1)) * U64(0x9E3779B97F4A7C15) ^ (value >> U64(17))) * U64(0xD6E8FEB86659FD93) >> U64(64 - 15)).astype(np.int32)

        def near(value: np.ndarray, by: int) -> np.ndarray:
            """The value `by` tokens before; 0 outside the text."""
            at = np.arange(n) - by
            inside = (at >= 0) & (at < n)
            at = np.where(inside, at, 0)
            return np.where(inside & (self.row[at] == self.row), value[at], U64(0)) if n else value

        yield weight(0, np.zeros(n, U64))
        for template, value in enumerate((shape, word, prefix, blend, in_file.astype(U64), shape + U64(1 << 40) * (near(word, 1) >> U64(44))), 1):
            yield weight(template, value)
        for by in (1, 2, -1, -2):
            yield weight(10 + by, near(shape, by))
        for by in (1, 2, 3, -1):
            yield weight(20 + by, near(word, by))
        for by in range(1, 6):  # any of the five before: one template, and with the token's length another
            earlier = near(word, by)
            yield weight(30, earlier)
            yield weight(31, earlier ^ length.astype(U64))

    def file(self) -> np.ndarray:
        size = np.maximum(np.diff(self.offsets), 1)
        signs, assigns = row_sums(self._kind == 5, self.offsets), row_sums(_ASSIGN[self.data], self.offsets)
        return (np.digitize(signs * 100 // size, [4, 15]) * 3 + np.digitize(assigns * 1000 // size, [1, 10])) * 3 + np.digitize(size, [300, 5000])


@dataclass
class Field:
    """weights: of each feature for each tag; moves: from tag to tag; begin: of the first token's tag. None: tags nothing."""

    weights: np.ndarray | None
    moves: np.ndarray
    begin: np.ndarray

    def scores(self, tokens: Tokens) -> np.ndarray:
        total = np.zeros((len(tokens.starts), _TAGS), np.float32)
        for weight in tokens.features():
            total += self.weights[weight]
        return total

    def tags(self, tokens: Tokens) -> np.ndarray:
        """Of each token, in the best chain of its text."""
        if self.weights is None:
            return np.zeros(len(tokens.starts), np.int8)
        return viterbi(self.scores(tokens), tokens.bounds, self.moves, self.begin)


def viterbi(scores: np.ndarray, bounds: np.ndarray, moves: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """The best tags of every chain; bounds: number of items before each chain. Of equal ones, the lower tag."""
    n, scores = len(scores), scores.astype(np.float64)
    tags = np.zeros(n, np.int8)
    first, last = np.zeros(n, bool), np.zeros(n, bool)
    full = bounds[:-1] < bounds[1:]
    first[bounds[:-1][full]] = True
    last[bounds[1:][full] - 1] = True
    # What a tag can gain on O by its neighbours: from any tag before (or the beginning), and to any tag after (or the end).
    before = np.maximum((moves - moves[:, [O]]).max(0), begin - begin[O])
    after = np.maximum((moves - moves[[O]]).max(1), 0)
    unsure = (scores[:, [O]] - scores <= (before + after)[None])[:, 1:].any(1)
    at = np.flatnonzero(unsure)
    if not len(at):
        return tags
    new = np.ones(len(at), bool)
    new[1:] = (at[1:] != at[:-1] + 1) | first[at[1:]]
    starts, lengths = at[new], np.diff(np.append(np.flatnonzero(new), len(at)))
    order = np.argsort(-lengths, kind="stable")
    starts, lengths = starts[order], lengths[order]
    stops = starts + lengths
    back = np.zeros((n, _TAGS), np.int8)
    best = np.where(first[starts][:, None], begin[None], moves[O][None]) + scores[starts]
    alive = len(starts)
    for step in range(1, int(lengths[0])):
        alive = int(np.searchsorted(-lengths, -step, "left"))
        paths = best[:alive, :, None] + moves[None]
        here = starts[:alive] + step
        back[here] = paths.argmax(1)
        best[:alive] = paths.max(1) + scores[here]
    best += np.where(last[stops - 1][:, None], 0.0, moves[:, O][None])
    tag = best.argmax(1).astype(np.int8)
    tags[stops - 1] = tag
    for step in range(1, int(lengths[0])):
        alive = int(np.searchsorted(-lengths, -step, "left"))
        here = stops[:alive] - step
        tag[:alive] = back[here, tag[:alive]]
        tags[here - 1] = tag[:alive]
    return tags


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """piece, secrets (first and last code point in it, one after the other), file: around pattern matches, and one elsewhere."""
    for batch in text_slices(batches):
        texts = batch.column("text")
        tokens, out = Tokens(texts), []
        file = tokens.file()
        place = tokens.place(tokens.starts, tokens.row)
        matched = pc.fill_null(pc.match_substring_regex(texts, _ANY), False).to_numpy(zero_copy_only=False)
        for i in range(batch.num_rows):
            a, b = tokens.bounds[i : i + 2].tolist()
            if a == b:
                continue
            text, own = texts[i].as_py(), place[a:b]
            found = [(first, end) for start, k, end, first in pattern_spans(text)] if matched[i] else []
            found = [(s, e) for s, e in found if not text[s:e].isdigit()]
            middles = [int(np.searchsorted(own, s)) for s, _ in found[:20]]
            other = random.Random(text[:200]).randrange(b - a)
            for middle in [*middles, other]:
                first, stop = max(0, middle - 14), min(b - a, middle + 14)
                low = int(own[first])
                high = int(own[stop]) if stop < b - a else len(text)
                inside = [(s - low, e - low) for s, e in found if s >= low and e <= high]
                if not any(s < high and e > low and (s < low or e > high) for s, e in found):
                    out.append((text[low:high], [x for pair in inside for x in pair], int(file[i])))
        yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.string()), pa.array([o[1] for o in out], pa.list_(pa.int32())), pa.array([o[2] for o in out], pa.int32())], ["piece", "secrets", "file"])


_KEYS = ("password", "passwd", "pwd", "secret", "token", "api_key", "apikey", "access_key", "auth", "credential", "private_key", "client_secret", "Authorization: Bearer", "passphrase", "AWS_SECRET", "db_password")
_LINKS = (" = \"", ": ", "=", " is ", " ", "\": \"", " = '", " := ")
_SETS = ("0123456789abcdef", "abcdefghijklmnopqrstuvwxyz0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-")


def _drawn(rng: random.Random) -> str:
    """A secret: random characters of an alphabet, sometimes behind a short prefix."""
    value = "".join(rng.choices(rng.choice(_SETS), k=rng.choice((16, 20, 24, 32, 36, 40, 48, 64))))
    value = value.strip("+/_-") or "q7Zk2m9Xw4Lt8Rv1"
    return value if rng.random() < 0.6 else "".join(rng.choices(_SETS[1][:26], k=rng.randint(2, 4))) + rng.choice("_-") + value


def _alike(rng: random.Random, words: list[str]) -> str:
    """What looks like a secret or its context and is none."""
    digits = lambda k: "".join(rng.choices("0123456789", k=k))
    word = lambda: rng.choice(words)
    return rng.choice((
        lambda: digits(rng.randint(3, 19)),
        lambda: f"+{digits(1)} ({digits(3)}) {digits(3)}-{digits(4)}",
        lambda: f"{word()}.{digits(2)}@{word()}.example.com",
        lambda: f"https://www.{word()}.com/{word()}/{word()}-{digits(4)}.html",
        lambda: "".join(word().lower() for _ in range(rng.randint(2, 6))),
        lambda: "".join(word().capitalize() for _ in range(rng.randint(2, 5))),
        lambda: "_".join(word().upper() for _ in range(rng.randint(2, 4))),
        lambda: f"{digits(4)}-{digits(2)}-{digits(2)}T{digits(2)}:{digits(2)}:{digits(2)}Z",
        lambda: f"{digits(2)}.{digits(3)}.{digits(2)}.{digits(3)}",
        lambda: f"/usr/{word()}/{word()}_{digits(2)}.{word()[:3]}",
        lambda: f"{rng.choice(_KEYS)}{rng.choice(_LINKS)}{word()}",
        lambda: f"{word()} {rng.choice(_KEYS)} {word()}",
        lambda: f"{rng.choice(_KEYS)} = {digits(rng.randint(1, 6))}",
        lambda: rng.choice("#$%&*|") * rng.randint(2, 6),
    ))()


def examples(windows: list[tuple[str, list[int], int]], seed: int = 12) -> list[tuple[str, list[int], int]]:
    """The windows, and copies of them with a secret or a look-alike put in between two words."""
    out = []
    words = [w for piece, _, _ in windows for w in re.findall(r"[^\W\d_]{2,12}", piece)] or ["word"]
    copies = max(2, EXAMPLES // max(1, len(windows)))
    for i, (piece, secrets, file) in enumerate(windows):
        out.append((piece, secrets, file))
        rng = random.Random(f"{seed} {i}")
        for _ in range(copies):
            gaps = [m.start() for m in re.finditer(" ", piece) if not any(s <= m.start() < e for s, e in zip(secrets[::2], secrets[1::2], strict=True))] or [len(piece)]
            at = rng.choice(gaps)
            if rng.random() < 0.5:
                head = " " if rng.random() < 0.25 else f" {rng.choice(_KEYS)}{rng.choice(_LINKS)}"
                value, tail, own = _drawn(rng), rng.choice(("", "\"", "'", ".", ",", ";")), True
            else:
                head, value, tail, own = " ", _alike(rng, words), "", False
            by = len(head) + len(value) + len(tail)
            moved = [x + by if x > at else x for x in secrets]
            mine = [at + len(head), at + len(head) + len(value)] if own else []
            out.append((piece[:at] + head + value + tail + piece[at:], [*moved, *mine], file))
    return out


def fit(windows: list[tuple[str, list[int], int]], epochs: int = 8, batch: int = 250, rate: float = 0.06, decay: float = 2e-6) -> Field:
    """The field under which the windows' tags are most likely, by steps along the gradient of the log-likelihood (Adam)."""
    moves, begin = np.zeros((_TAGS, _TAGS)), np.zeros(_TAGS)
    if not windows:
        return Field(None, moves, begin)
    weights = np.zeros((_WEIGHTS, _TAGS))
    rng = np.random.default_rng(5)
    made = examples(windows)
    tokens = Tokens(pa.array([m[0] for m in made]))
    features = np.stack(list(tokens.features(np.array([m[2] for m in made]))), 1)
    place, tags = tokens.place(tokens.starts, tokens.row), np.zeros(len(tokens.starts), np.int64)
    for i, (_, secrets, _) in enumerate(made):
        own = slice(*tokens.bounds[i : i + 2])
        for s, e in zip(secrets[::2], secrets[1::2], strict=True):
            inside = np.flatnonzero((place[own] >= s) & (place[own] < e)) + own.start
            tags[inside] = I
            tags[inside[:1]] = B
    parameters, steps = [weights, moves, begin], 0
    means = [(np.zeros_like(p), np.zeros_like(p)) for p in parameters]
    for _ in range(epochs):
        shuffled = rng.permutation(len(made))
        for at in range(0, len(made), batch):
            steps += 1
            gradients = _gradient(features, tags, tokens.bounds, np.sort(shuffled[at : at + batch]), weights, moves, begin)
            for p, g, (m, v) in zip(parameters, gradients, means, strict=True):
                g = g / batch - decay * p * batch
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                p += rate * (m / (1 - 0.9**steps)) / (np.sqrt(v / (1 - 0.99**steps)) + 1e-8)
    return Field(weights.astype(np.float32), moves, begin)


def _gradient(features: np.ndarray, tags: np.ndarray, bounds: np.ndarray, chains: np.ndarray, weights: np.ndarray, moves: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the log-likelihood of some chains, by forward and backward sums: observed less expected counts."""
    lengths = (bounds[1:] - bounds[:-1])[chains]
    chains, lengths = chains[lengths > 0], lengths[lengths > 0]
    order = np.argsort(-lengths, kind="stable")
    starts, lengths = bounds[:-1][chains[order]], lengths[order]
    width = int(lengths[0]) if len(lengths) else 0
    cells = np.minimum(starts[:, None] + np.arange(width)[None], len(tags) - 1)
    valid = np.arange(width)[None] < lengths[:, None]
    scores = weights[features[cells[valid]]].sum(1)
    emitted = np.full((*valid.shape, _TAGS), 0.0)
    emitted[valid] = scores
    ahead, behind = np.zeros_like(emitted), np.zeros_like(emitted)
    for k in range(width):
        m = int(valid[:, k].sum())
        ahead[:m, k] = emitted[:m, k] + (begin if k == 0 else _log_sum(ahead[:m, k - 1, :, None] + moves[None], 1))
    for k in range(width - 2, -1, -1):
        m = int(valid[:, k + 1].sum())
        behind[:m, k] = _log_sum(moves[None] + (emitted[:m, k + 1] + behind[:m, k + 1])[:, None, :], 2)
    whole = _log_sum(ahead[np.arange(len(lengths)), lengths - 1], 1)
    single = np.exp((ahead + behind - whole[:, None, None])[valid])
    observed = np.zeros_like(emitted)
    observed[valid] = np.eye(_TAGS)[tags[cells[valid]]]
    rest = observed[valid] - single
    used = features[cells[valid]]
    of_weights = np.stack([np.bincount(used.ravel(), np.repeat(rest[:, t], used.shape[1]), len(weights)) for t in range(_TAGS)], 1)
    pair = valid[:, 1:]
    joint = np.exp((ahead[:, :-1, :, None] + moves[None, None] + (emitted + behind)[:, 1:, None, :] - whole[:, None, None, None])[pair])
    seen = observed[:, :-1, :, None] * observed[:, 1:, None, :]
    of_moves = seen[pair].sum(0) - joint.sum(0)
    of_begin = observed[:, 0].sum(0) - np.exp(ahead[:, 0] + behind[:, 0] - whole[:, None]).sum(0)
    return of_weights, of_moves, of_begin


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    most = x.max(axis, keepdims=True)
    return np.log(np.exp(x - most).sum(axis)) + most.squeeze(axis)


def train(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", sample: int = SAMPLE, windows: int = WINDOWS) -> Field:
    """A field learned from about `sample` documents, chosen by a hash of id and text, and at most 2 * windows of their windows."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).where(F.col("doc_id").isNotNull() & F.col("text").isNotNull())
    rate = min(1.0, sample / max(1, rows.count()))
    chosen = rows.where(F.pmod(F.xxhash64("doc_id", F.length("text"), F.lit(12)), F.lit(1 << 24)) < rate * (1 << 24))
    found = chosen.select("text").mapInArrow(_windows, "piece string, secrets array<int>, file int").groupBy("piece", "secrets").agg(F.min("file").alias("file"))
    ordered = lambda some: some.orderBy(F.xxhash64("piece"), "piece", "secrets").limit(windows).toArrow().to_pylist()
    got = [*ordered(found.where(F.size("secrets") > 0)), *ordered(found.where(F.size("secrets") == 0))]
    return fit([(g["piece"], g["secrets"], g["file"]) for g in got])


def find(docs: DataFrame, field: Field, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and the spans of each whole text: kind, first code point, and the one after the last, by start, then kind."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(field)  # about 400 kB

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, limit=1 << 20):
            texts = batch.column("text")
            tokens = Tokens(texts)
            tags = shared.value.tags(tokens)
            matched = pc.fill_null(pc.match_substring_regex(texts, _ANY), False).to_numpy(zero_copy_only=False)
            spans: dict[int, list[tuple[int, int, int]]] = {i: [s[:3] for s in pattern_spans(texts[i].as_py())] for i in np.flatnonzero(matched).tolist()}
            for i, start, end in zip(*_tagged(tokens, tags), strict=True):
                own = spans.setdefault(i, [])
                if not any(s < end and start < e for s, k, e in own if k < 3):
                    own.append((start, 3, end))
            flat = [(i, *s) for i in sorted(spans) for s in sorted(spans[i])]
            of = [np.array([f[c] for f in flat], np.int64) for c in range(4)]
            kinds = pa.DictionaryArray.from_arrays(pa.array(of[2], pa.int32()), pa.array(KINDS)).cast(pa.string())
            offsets = np.searchsorted(of[0], np.arange(batch.num_rows + 1)).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays([kinds, pa.array(of[1]), pa.array(of[3])], ["kind", "start", "end"]))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), lists], ["doc_id", "spans"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, spans {_SPANS}")


def _tagged(tokens: Tokens, tags: np.ndarray) -> tuple[list[int], list[int], list[int]]:
    """Row, start and end of each run of B and I; a B, and an I after O or at a text's start, begins one."""
    on = np.flatnonzero(tags != O)
    joined = np.zeros(len(on), bool)
    joined[1:] = (on[1:] == on[:-1] + 1) & (tags[on[1:]] == I) & (tokens.row[on[1:]] == tokens.row[on[:-1]])
    first = np.flatnonzero(~joined)
    last = np.append(first[1:], len(on))[: len(first)] - 1
    row = tokens.row[on[first]]
    return row.tolist(), tokens.place(tokens.starts[on[first]], row).tolist(), tokens.place(tokens.ends[on[last]], row).tolist()


def digests(found: DataFrame) -> DataFrame:
    """doc_id, number of spans of each pattern, the hash of the list of these, and the list of all spans."""

    def listed(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    of = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint")
    base = F.filter("spans", lambda s: s["kind"] != KINDS[3])
    return found.select("doc_id", *[of(k).alias(f"n_{k}") for k in KINDS[:3]], F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))
