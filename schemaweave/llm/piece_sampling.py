"""SentencePiece sampling: forward filtering and backward sampling over the piece lattice.

A text is cut into units, each a run of spaces with what follows up to the next space, or
one line end; no piece of the model spans two units, so the lattice of a text is the
product of its units' lattices. For each distinct unit the forward filter sums, for every
place, the weights of all segmentations up to there, and turns them into the chances of
the last piece at that place. Sampling walks back from the end of every unit of a batch at
once. The random numbers are hashes of (seed, row key, unit, step), so a row gets the same
pieces in any partitioning.

A piece's weight is a power of its rank, rank ** -theta (the ranks of a BPE vocabulary follow
its merges); characters without a piece fall back to their UTF-8 bytes, and so does the
character that stands for a space in pieces. Decoding joins the pieces' bytes and gives
back the text exactly.

Cases: a null or empty text has no pieces; a null key counts as 0, so equal rows get
equal pieces. Units of more than LONG characters keep no lattice, only the forward weights, eight
bytes a character; their last pieces are weighed anew on the way back. Only the named columns
are read.
"""

from __future__ import annotations

import array
import hashlib
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from schemaweave.llm.arrays import U64, mixed, text_slices

SPACE = "▁"
_UNITS = re.compile(r" +[^ \n]*|\n|[^ \n]+")
#: Lattices that a task keeps, some 400 bytes each.
CACHED_UNITS = 150_000
LONG = 4096
_HIDE = str.maketrans({" ": SPACE, SPACE: "\0"})


@dataclass(frozen=True)
class Vocabulary:
    """Pieces by id, and the ids of the 256 bytes."""

    pieces: tuple[str, ...]
    byte_ids: tuple[int, ...]
    normal: tuple[int, ...]


def vocabulary(model: str) -> Vocabulary:
    """Read a SentencePiece model file with byte fallback, on the driver."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model)
    n = sp.get_piece_size()
    pieces = tuple(sp.id_to_piece(i) for i in range(n))
    byte_ids = tuple(sp.piece_to_id(f"<0x{b:02X}>") for b in range(256))
    normal = tuple(i for i in range(n) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)))
    if any(SPACE in pieces[i].lstrip(SPACE) or "\n" in pieces[i] for i in normal):
        raise ValueError("a piece of this model spans two units")
    return Vocabulary(pieces, byte_ids, normal)


class _Growing:
    """An array to which values are added."""

    def __init__(self, kind: type, n: int = 0) -> None:
        self.values, self.n = np.zeros(1 << 12, kind), n

    def add(self, new: np.ndarray) -> None:
        if self.n + len(new) > len(self.values):
            self.values = np.concatenate([self.values[: self.n], np.zeros(max(len(self.values) // 2, len(new) * 2), self.values.dtype)])
        self.values[self.n : self.n + len(new)] = new
        self.n += len(new)


class Sampler:
    """The lattices of the units seen so far."""

    def __init__(self, v: Vocabulary, theta: float, seed: int) -> None:
        self.seed, self.cached_units = seed, CACHED_UNITS
        self.weights: dict[str, tuple[int, float]] = {}  # with all prefixes of pieces, which have id -1
        for rank, i in enumerate(v.normal):
            piece = v.pieces[i]
            for k in range(1, len(piece)):
                self.weights.setdefault(piece[:k], (-1, 0.0))
            self.weights[piece] = (i, float(rank + 1) ** -theta)
        self.longest = max(map(len, self.weights))
        # The same prefixes as a trie: a node's number and the next character make a key of its child.
        number = {"": 0} | {x: i for i, x in enumerate(self.weights, 1)}
        links = sorted((number[x[:-1]] << 21 | ord(x[-1]), number[x]) for x in self.weights)
        self.keys, self.child = np.array(links, np.int64).reshape(-1, 2).T.copy()
        self.ends = np.array([-1] + [i for i, _ in self.weights.values()], np.int64)
        self.rank_weight = np.zeros(len(v.pieces))
        self.rank_weight[list(v.normal)] = np.arange(1.0, len(v.normal) + 1) ** -theta
        self.byte_ids, self.byte_weight = v.byte_ids, float(len(v.normal) + 256) ** -theta
        texts = [p.replace(SPACE, " ").encode() if i in set_ else b"" for set_ in [set(v.normal)] for i, p in enumerate(v.pieces)]
        for b, i in enumerate(v.byte_ids):
            texts[i] = bytes([b])
        self.size = np.array([len(x) for x in texts])
        self.begin = np.cumsum(self.size) - self.size
        self.bytes = np.frombuffer(b"".join(texts), np.uint8)
        self.clear()

    def clear(self) -> None:
        self.known: dict[str, int] = {}
        # Nodes are the places of all units; node 0 is the start of each. The edges into a node are its last pieces.
        self.end = _Growing(np.int32)  # last node of each unit
        self.first = _Growing(np.int32, 1)  # first edge of each node
        self.chance, self.source, self.piece = _Growing(np.float64), _Growing(np.int32), _Growing(np.int32)

    def _filter(self, unit: str, edges: tuple[list, list, list, list]) -> list[float]:
        """Weight of all ways to reach each place; appends each edge's place, weight up to it, source and piece."""
        shown, n, get = unit.translate(_HIDE), len(unit), self.weights.get
        place, upto, source, piece = (e.append for e in edges)
        reach, begun = [1.0] + [0.0] * n, len(edges[0])
        for i in range(n):
            here = reach[i]
            if not 1e-150 < here < 1e150:  # only ratios matter, so what lies ahead is scaled
                scale, here = 1.0 / here, 1.0
                for k in range(i + 1, min(n, i + self.longest) + 1):
                    reach[k] *= scale
                for k in range(max(0, len(edges[0]) - self.longest**2), len(edges[0])):
                    if edges[0][k] > i and k >= begun:
                        edges[1][k] *= scale
            single = False
            for j in range(i + 1, n + 1):
                found = get(shown[i:j])
                if found is None:
                    break
                if found[0] >= 0:
                    reach[j] += here * found[1]
                    place(j)
                    upto(reach[j])
                    source(i)
                    piece(found[0])
                    single |= j == i + 1
            if not single:
                reach[i + 1] += here * self.byte_weight ** len(unit[i].encode("utf-8", "replace"))
                place(i + 1)
                upto(reach[i + 1])
                source(i)
                piece(-1 - ord(unit[i]))
        return reach

    def _match(self, units: list[str]) -> tuple[np.ndarray, ...]:
        """All edges of these units: first and last character (numbered through), piece, weight."""
        code = np.frombuffer("".join(units).translate(_HIDE).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        length = np.fromiter(map(len, units), np.int64, len(units))
        left = np.repeat(np.cumsum(length), length) - np.arange(len(code))  # characters of the unit from here on
        at, state = np.arange(len(code)), np.zeros(len(code), np.int64)
        first, last, piece, plain = [], [], [], np.zeros(len(code), bool)
        for k in range(self.longest):
            key = state << 21 | code[at + k]
            place = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            on = self.keys[place] == key
            at, state = at[on], self.child[place[on]]
            ends = self.ends[state] >= 0
            first.append(at[ends])
            last.append(at[ends] + k)
            piece.append(self.ends[state[ends]])
            if k == 0:
                plain[at[ends]] = True
            more = left[at] > k + 1
            at, state = at[more], state[more]
        odd = np.flatnonzero(~plain)
        raw = np.frombuffer("".join(units).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)[odd]
        octets = 1 + (raw >= 0x80) + (raw >= 0x800) + (raw >= 0x10000)
        weight = [self.rank_weight[x] for x in piece] + [self.byte_weight**octets]
        return tuple(map(np.concatenate, ([*first, odd], [*last, odd], [*piece, -1 - raw], weight)))

    def _learn(self, units: list[str]) -> None:
        """Filter forward over all new units at once, place by place; the few that get too small or are long go alone."""
        short = [u for u in units if len(u) <= 64]
        length = np.fromiter(map(len, short), np.int64, len(short))
        first, last, piece, weight = self._match(short) if short else (np.zeros(0, np.int64),) * 3 + (np.zeros(0),)
        begun = np.cumsum(length) - length
        offset = np.arange(int(length.sum())) - np.repeat(begun, length)
        order = np.argsort(offset[first], kind="stable")
        first, last, piece, weight = first[order], last[order], piece[order], weight[order]
        cuts = np.searchsorted(offset[first], np.arange(65))
        reach, flow = np.zeros(len(offset)), np.zeros(len(first))
        for k in range(64):
            a, b = cuts[k], cuts[k + 1]
            flow[a:b] = weight[a:b] * (reach[first[a:b] - 1] if k else 1.0)
            np.add.at(reach, last[a:b], flow[a:b])
        order = np.argsort(last, kind="stable")
        first, last, piece, flow = first[order], last[order], piece[order], flow[order]
        low = reach[begun + length - 1] < 1e-250 if len(short) else np.zeros(0, bool)
        with np.errstate(divide="ignore", invalid="ignore"):
            share = np.cumsum(np.nan_to_num(flow / reach[last]))
        edge = np.searchsorted(last, np.arange(len(offset)))
        chance = share - np.append(0, share)[edge][last]
        chance[np.append(last[1:] != last[:-1], True)] = 1.0
        base = self.first.n
        source = np.where(offset[first] > 0, first - 1 + base, 0)
        self._add([u for u, x in zip(short, low, strict=True) if not x], (begun + length - 1)[~low], edge, chance, source, piece)
        for unit in [u for u, x in zip(short, low, strict=True) if x] + [u for u in units if len(u) > 64]:
            edges: tuple[list, list, list, list] = ([], [], [], [])
            reach = np.array(self._filter(unit, edges)[1:])
            place = np.array(edges[0]) - 1
            order = np.argsort(place, kind="stable")
            place = place[order]
            chance = np.array(edges[1])[order] / reach[place]
            chance[np.append(place[1:] != place[:-1], True)] = 1.0
            source = np.array(edges[2])[order]
            source = np.where(source > 0, source - 1 + self.first.n, 0)
            self._add([unit], np.array([len(unit) - 1]), np.searchsorted(place, np.arange(len(unit))), chance, source, np.array(edges[3])[order])

    def _long(self, unit: str, stream: np.uint64) -> list[int]:
        """Sampled pieces of a long unit, from forward weights alone."""
        shown, n, get = unit.translate(_HIDE), len(unit), self.weights.get
        reach = array.array("d", bytes(8 * (n + 1)))
        reach[0] = 1.0
        scales: list[tuple[int, float]] = []  # what lies before the place is to be multiplied to compare with what follows
        fallback = lambda k: self.byte_weight ** len(unit[k].encode("utf-8", "replace"))
        for i in range(n):
            here = reach[i]
            if not 1e-150 < here < 1e150:
                for k in range(i, min(n, i + self.longest) + 1):
                    reach[k] /= here
                scales.append((i, 1.0 / here))
                here = 1.0
            single = False
            for j in range(i + 1, min(n, i + self.longest) + 1):
                found = get(shown[i:j])
                if found is None:
                    break
                if found[0] >= 0:
                    reach[j] += here * found[1]
                    single |= j == i + 1
            if not single:
                reach[i + 1] += here * fallback(i)
        out: list[int] = []
        at = n
        while at:
            while scales and scales[-1][0] >= at:
                scales.pop()
            low = max(0, at - self.longest)
            passed = [x for x in scales[-4:] if x[0] > low]
            ways, total = [], 0.0
            for i in range(low, at):
                id_, weight = get(shown[i:at], (-1, 0.0))
                if i == at - 1 and id_ < 0:
                    id_, weight = -1 - ord(unit[i]), fallback(i)
                elif id_ < 0:
                    continue
                for place, scale in passed:
                    weight *= scale if i < place else 1.0
                total += reach[i] * weight
                ways.append((total, i, id_))
            draw = float(mixed(np.array([stream + U64(len(out))], U64))[0] >> U64(11)) * 2.0**-53 * total
            _, at, id_ = next((w for w in ways if draw < w[0]), ways[-1])
            out.append(id_)
        return out[::-1]

    def _add(self, units: list[str], ends: np.ndarray, edge: np.ndarray, chance: np.ndarray, source: np.ndarray, piece: np.ndarray) -> None:
        self.end.add(ends + self.first.n)
        self.first.add(edge + self.chance.n)
        self.chance.add(chance)
        self.source.add(source)
        self.piece.add(piece)
        for unit in units:
            self.known[unit] = len(self.known)

    def sample(self, texts: list[str], keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Piece ids of all texts end to end, and the number of each."""
        if len(self.known) > self.cached_units:
            self.clear()
        rows = [_UNITS.findall(x) for x in texts]
        new = dict.fromkeys(u for r in rows for u in r if u not in self.known and len(u) <= LONG)
        if new:
            self._learn(list(new))
        per_row = np.array([len(r) for r in rows], np.int64)
        unit = np.array([self.known.get(u, -1) for u in chain.from_iterable(rows)], np.int64)
        row = np.repeat(np.arange(len(rows)), per_row)
        ordinal = np.arange(len(unit)) - np.repeat(np.cumsum(per_row) - per_row, per_row)
        stream = mixed(mixed(keys.astype(U64) ^ U64(self.seed))[row] + ordinal.astype(U64))
        end, first, chance, source, piece = (x.values for x in (self.end, self.first, self.chance, self.source, self.piece))
        who, steps, step = np.flatnonzero(unit >= 0), [], 0
        node = end[unit[who]]
        while len(who):
            draw = (mixed(stream[who] + U64(step)) >> U64(11)).astype(np.float64) * 2.0**-53
            edge = first[node]
            over = np.flatnonzero(draw >= chance[edge])
            while len(over):  # the last edge of a node has chance 1
                edge[over] += 1
                over = over[draw[over] >= chance[edge[over]]]
            steps.append((who, piece[edge]))
            node = source[edge]
            on = np.flatnonzero(node)
            who, node, step = who[on], node[on], step + 1
        drawn = np.zeros(len(unit), np.int64)
        for who, _ in steps:
            drawn[who] += 1
        units = chain.from_iterable(rows)
        alone = {i: self._long(u, stream[i]) for i, u in enumerate(units) if unit[i] < 0}
        for i, pieces in alone.items():
            drawn[i] = len(pieces)
        stop = np.cumsum(drawn)
        out = np.zeros(int(stop[-1]) if len(stop) else 0, np.int64)
        for i, pieces in alone.items():
            out[stop[i] - len(pieces) : stop[i]] = pieces
        for k, (who, ids) in enumerate(steps):
            out[stop[who] - 1 - k] = ids
        of = row[np.repeat(np.arange(len(unit)), drawn)]
        odd = np.flatnonzero(out < 0)  # characters to spell in bytes
        if len(odd):
            spelled = [[self.byte_ids[b] for b in chr(-1 - x).encode("utf-8", "replace")] for x in out[odd].tolist()]
            size = np.ones(len(out), np.int64)
            size[odd] = [len(x) for x in spelled]
            place = np.cumsum(size) - size
            wide = np.repeat(out, size)
            for x, at in zip(spelled, place[odd].tolist(), strict=True):
                wide[at : at + len(x)] = x
            out, of = wide, np.repeat(of, size)
        return out, np.bincount(of, minlength=len(rows)) if len(rows) else np.zeros(0, np.int64)

    def decode(self, ids: np.ndarray) -> bytes:
        size = self.size[ids]
        return self.bytes[np.arange(int(size.sum())) + np.repeat(self.begin[ids] - (np.cumsum(size) - size), size)].tobytes()


@cache
def _sampler(v: Vocabulary, theta: float, seed: int) -> Sampler:
    return Sampler(v, theta, seed)


def sample_pieces(docs: DataFrame, model: str, seed: int = 17, theta: float = 1.0, doc_id: str = "doc_id", text: str = "text", digests: bool = False, cached_units: int = CACHED_UNITS) -> DataFrame:
    """doc_id and pieces (array<int>) of each text.

    With digests: doc_id, n_pieces, pieces_crc32 (of the ids as little-endian unsigned 32-bit
    integers), decoded_sha256 (of the decoded bytes) and lossless (decoded bytes equal the text's).
    """
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary(model))  # some 32,000 short strings, whatever the corpus
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.xxhash64(F.col(doc_id)), F.lit(0)).alias("key"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sampler = _sampler(shared.value, theta, seed)
        sampler.cached_units = cached_units
        sampler.clear()  # lattices last for a task: workers live on, and their memory with them
        for batch in text_slices(batches, limit=1 << 19):
            texts = [x or "" for x in batch.column("text").to_pylist()]
            ids, counts = sampler.sample(texts, batch.column("key").to_numpy().view(U64))
            stop = np.cumsum(counts)
            if not digests:
                lists = pa.ListArray.from_arrays(pa.array(np.append(0, stop).astype(np.int32)), pa.array(ids.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), lists], ["doc_id", "pieces"])
                continue
            whole, size = sampler.decode(ids), sampler.size[ids]
            ends = np.append(0, np.cumsum(size))[np.append(0, stop)].tolist()
            decoded = [whole[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]
            raw = ids.astype("<u4")
            crc = [zlib.crc32(raw[b - n : b].tobytes()) for b, n in zip(stop.tolist(), counts.tolist(), strict=True)]
            same = [d == t.encode("utf-8", "replace") for d, t in zip(decoded, texts, strict=True)]
            digest = [hashlib.sha256(d).hexdigest() for d in decoded]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(counts.astype(np.int64)), pa.array(crc, pa.int64()), pa.array(digest), pa.array(same)], ["doc_id", "n_pieces", "pieces_crc32", "decoded_sha256", "lossless"])
        sampler.clear()

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, " + ("n_pieces bigint, pieces_crc32 bigint, decoded_sha256 string, lossless boolean" if digests else "pieces array<int>"))


def decode_pieces(encoded: DataFrame, model: str) -> DataFrame:
    """doc_id and text of (doc_id, pieces)."""
    shared = encoded.sparkSession.sparkContext.broadcast(vocabulary(model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sampler = _sampler(shared.value, 1.0, 0)
        for batch in batches:
            texts = [sampler.decode(np.array(p or [], np.int64)).decode("utf-8", "replace") for p in batch.column("pieces").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "pieces").mapInArrow(run, f"doc_id {encoded.schema['doc_id'].dataType.simpleString()}, text string")
