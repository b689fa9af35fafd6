"""SentencePiece encoding and decoding with a streaming Viterbi search.

Every text is searched from left to right over the lattice of pieces that occur in it. Each boundary keeps the best sum
of scores with which it is reached, the last piece and a backpointer. A piece can only start at one of the last
``width`` boundaries (the longest piece), so whenever the backpointer paths of all of these pass through one boundary,
what lies before it cannot change any more: its ids are committed and dropped from the window.

Unigram models: the path with the best sum is the encoding. BPE models: the encoding is the one that merging the
best-scored pairs yields, and that is rarely the path with the best sum. It is the path in which any two neighbours
(u, t) agree, i.e. merging u + t alone gives (u, t) again; so a step is allowed only there, and the same search runs
over the allowed steps. ``Encoder(model, merging=False)`` gives the path with the best sum for either kind.

Where no piece crosses a blank or a line feed, all paths meet in front of each, so a text is searched in units
that start there; the ids of frequent units are remembered, in two generations of bounded size. A text is cut at such
places into slices of about SLICE characters; beyond a slice and the window only the ids that are returned are held.

Ids equal those of the public library (which adds 32-bit floats over a whole text, so that near ties of a unigram model
may fall differently there). Model files with rules that are not followed here (a normaliser, user-defined pieces, no byte
pieces) are refused. Defined cases: null and empty texts have no ids and decode to the empty text; characters without a
piece become byte pieces; a blank mark in a text is a blank; repeated rows are encoded one by one; of the other columns
only the key passes.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "▁"
DEFAULT_MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: Units and agreeing pairs that one worker remembers, in each of two generations.
REMEMBERED = 200_000
#: Longest unit that is remembered, in characters.
SHORT = 64
#: Characters of a text that are looked at together, up to the next blank.
SLICE = 1 << 16
UNIT = re.compile(f"\n|{MARK}*[^{MARK}\n]+|{MARK}+")
BORDER = re.compile("(?<=[^ ]) ")
#: Kinds of models and of pieces in model files.
UNIGRAM, BPE = 1, 2
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6
#: Fixed value: how far a character without a piece scores below the worst piece of a unigram model.
UNKNOWN_PENALTY = 10.0


def wire_fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of the fields of a protocol buffers message; fixed-size and nested values as bytes."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
            continue
        size = varint() if kind == 2 else {1: 8, 5: 4}[kind]
        yield tag >> 3, data[at : at + size]
        at += size


class Model:
    """Pieces and scores of a model file, in plain tables that travel to the executors (about 1 MB)."""

    def __init__(self, path: str = DEFAULT_MODEL):
        with open(path, "rb") as f:
            parts = list(wire_fields(f.read()))
        trainer = {n: v for k, part in parts if k == 2 for n, v in wire_fields(part)}
        rules = {n: v for k, part in parts if k == 3 for n, v in wire_fields(part)}
        self.kind = trainer.get(3, UNIGRAM)
        if self.kind not in (UNIGRAM, BPE):
            raise ValueError(f"{path}: only unigram and BPE models are supported")
        if rules.get(2) or rules.get(4, 1) or not rules.get(5, 1) or trainer.get(24):
            raise ValueError(f"{path}: models that normalise texts are not supported")
        self.prefix = MARK if rules.get(3, 1) else ""
        self.ids: dict[str, int] = {}
        self.pieces: list[str] = []
        self.scores: list[float] = []
        self.bytes_of: list[bytes] = []
        self.byte_ids = [-1] * 256
        for i, part in enumerate(part for k, part in parts if k == 1):
            fields = dict(wire_fields(part))
            piece, kind = fields[1].decode(), fields.get(3, NORMAL)
            self.pieces.append(piece)
            self.scores.append(struct.unpack("<f", fields[2])[0] if 2 in fields else 0.0)
            if kind == BYTE:
                value = int(piece[1:-1], 16)
                self.byte_ids[value] = i
                self.bytes_of.append(bytes([value]))
            elif kind in (UNKNOWN, CONTROL):
                self.bytes_of.append(b"")
            elif kind == NORMAL:
                self.ids[piece] = i
                self.bytes_of.append(piece.replace(MARK, " ").encode())
            else:
                raise ValueError(f"{path}: piece {piece!r} is of a kind that is not supported")
        if min(self.byte_ids) < 0:
            raise ValueError(f"{path}: models without byte pieces are not supported")
        self.width = max(map(len, self.ids))
        #: whether all paths meet in front of blanks and around line feeds
        self.in_units = not any(MARK in p.lstrip(MARK) or "\n" in p for p in self.ids)


class Encoder:
    """Encodes and decodes with one model; remembers units. ``merging``: neighbours have to agree, as BPE needs."""

    def __init__(self, model: Model, merging: bool | None = None):
        self.model = model
        self.merging = model.kind == BPE if merging is None else merging
        # a character without a piece comes last where merging rules; there any sum of scores is above it
        self.unknown = -1e12 if self.merging else min(model.scores[i] for i in model.ids.values()) - UNKNOWN_PENALTY
        self.young: dict[str, tuple[int, ...]] = {}
        self.old: dict[str, tuple[int, ...]] = {}
        self.pairs: dict[int, bool] = {}
        self.shift = len(model.pieces).bit_length()
        found = ahocorasick.Automaton()
        for piece, i in model.ids.items():
            found.add_word(piece, (i, len(piece), model.scores[i]))
        found.make_automaton()
        #: (end, (id, length, score)) of every piece that occurs in a string, by end, the longest first
        self.matches = found.iter

    def merged(self, text: str) -> list[str]:
        """What merging the best pair, the leftmost of equals, leaves of a short string."""
        parts, ids, scores = list(text), self.model.ids, self.model.scores
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                t = ids.get(parts[i] + parts[i + 1])
                if t is not None and (best is None or scores[t] > best):
                    best, at = scores[t], i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def agree(self, u: int, t: int) -> bool:
        """Whether two pieces may be neighbours."""
        left, right = self.model.pieces[u], self.model.pieces[t]
        known = left + right not in self.model.ids and self.merged(left + right) == [left, right]
        if len(self.pairs) >= REMEMBERED:
            self.pairs.clear()
        self.pairs[u << self.shift | t] = known
        return known

    def search(self, text: str) -> Iterator[list[int]]:
        """The ids of a string, in the stretches in which they are committed."""
        merging, pairs, shift, unknown, width = self.merging, self.pairs.get, self.shift, self.unknown, self.model.width
        # (best sum, backpointer, last piece) of boundary b of the window [base, done], at b - base
        nodes: list[tuple[float, int, int]] = [(0.0, 0, -1)]
        base, done, look = 0, 0, 2 * width
        for at, (t, size, score) in self.matches(text):
            while done < at:  # no piece ends here; the character alone leads on
                nodes.append((nodes[-1][0] + unknown, done, -1))
                done += 1
            if done > at and merging:  # no more than one of the steps to a boundary is allowed
                continue
            start = at + 1 - size
            total, _, u = nodes[start - base]
            if merging and u >= 0:
                fit = pairs(u << shift | t)
                if not fit and (fit is not None or not self.agree(u, t)):
                    continue
            total += score
            if done > at:
                if total > nodes[-1][0]:
                    nodes[-1] = (total, start, t)
                continue
            if done >= look:  # all boundaries so far are final
                keep = self.meeting(nodes, base, done, width)
                if keep > base:
                    yield self.walk(text, nodes, base, keep)
                    del nodes[: keep - base]
                    base = keep
                look = done + width
            alone = nodes[-1][0] + unknown
            nodes.append((total, start, t) if total > alone else (alone, at, -1))
            done += 1
        nodes.extend((0.0, b, -1) for b in range(done, len(text)))
        yield self.walk(text, nodes, base, len(text))

    @staticmethod
    def meeting(nodes: list[tuple[float, int, int]], base: int, done: int, width: int) -> int:
        """The boundary through which the paths of all boundaries from which a piece may still start pass, or base."""
        front = set(range(done - width + 1, done + 1))
        while len(front) > 1:
            far = max(front)
            front.remove(far)
            front.add(max(base, nodes[far - base][1]))
        return front.pop()

    def walk(self, text: str, nodes: list[tuple[float, int, int]], base: int, end: int) -> list[int]:
        """Ids of the path that leads from base to a boundary."""
        out: list[int] = []
        while end > base:
            _, before, t = nodes[end - base]
            if t < 0:
                out.extend(self.model.byte_ids[b] for b in reversed(text[before:end].encode()))
            else:
                out.append(t)
            end = before
        out.reverse()
        return out

    def unit(self, text: str) -> tuple[int, ...]:
        """Ids of one unit, from memory or by the search."""
        found = self.old.get(text)
        if found is None:
            found = tuple(chain.from_iterable(self.search(text)))
        if len(text) <= SHORT:
            if len(self.young) >= REMEMBERED:
                self.old, self.young = self.young, {}
            self.young[text] = found
        return found

    def stretches(self, text: str) -> Iterator[list[int]]:
        """The ids of a text, a slice at a time."""
        text, first = text.replace(MARK, " "), self.model.prefix
        if not self.model.in_units:
            yield from self.search(first + text.replace(" ", MARK))
            return
        at, n = 0, len(text)
        while at < n:
            border = BORDER.search(text, at + SLICE)
            end = border.start() if border else n
            part = text[at:end]
            # a later slice starts at its blank, which is the mark of its first unit
            if at:
                part, first = part[1:], MARK
            if "  " in part or part[:1] in ("", " ") or part[-1:] == " " or " \n" in part or not first:
                units = UNIT.findall(first + part.replace(" ", MARK))
            else:
                units = (first + part.replace(" ", " " + MARK).replace("\n", " \n ")).split(" ")
            found = list(map(self.young.get, units))
            if None in found:
                unit = self.unit
                found = [f if f is not None else unit(u) if u else () for f, u in zip(found, units, strict=True)]
            yield list(chain.from_iterable(found))
            at = end

    def encode(self, text: str) -> list[int]:
        return list(chain.from_iterable(self.stretches(text))) if text else []

    def decode(self, ids: list[int]) -> str:
        table = self.model.bytes_of
        out = b"".join([table[i] for i in ids])
        return (out[1:] if self.model.prefix and out[:1] == b" " else out).decode("utf-8", "replace")


#: One encoder for each model in a worker process, so that tasks share what was remembered.
ENCODERS: dict[tuple, Encoder] = {}


def encoder(model: Model) -> Encoder:
    key = (model.kind, model.prefix, hash((tuple(model.pieces), tuple(model.scores))))
    if key not in ENCODERS:
        ENCODERS.clear()
        ENCODERS[key] = Encoder(model)
    return ENCODERS[key]


def id_lists(found: list[list[int]]) -> pa.Array:
    offsets = np.zeros(len(found) + 1, np.int32)
    np.cumsum([len(x) for x in found], out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.fromiter(chain.from_iterable(found), np.int32, int(offsets[-1]))))


#: Rows that are encoded before they are passed on, so that id lists of a batch stay small.
ROWS = 500


def encoded(docs: DataFrame, key: str = "doc_id", text: str = "text", model: Model | None = None) -> DataFrame:
    """(key, ids, n_ids, decoded_same): ids of every text, and whether they decode to it."""
    model = model or Model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(model)
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                b = whole.slice(at, ROWS)
                texts = [t or "" for t in b.column(1).to_pylist()]
                found = [e.encode(t) for t in texts]
                same = [e.decode(f) == t for f, t in zip(found, texts, strict=True)]
                yield pa.RecordBatch.from_arrays([b.column(0), id_lists(found), pa.array([len(f) for f in found], pa.int64()), pa.array(same)], names=[key, "ids", "n_ids", "decoded_same"])

    rows = docs.select(F.col(key), F.col(text).cast("string"))
    return rows.mapInArrow(run, f"`{key}` {docs.schema[key].dataType.simpleString()}, ids array<int>, n_ids long, decoded_same boolean")


def decoded(rows: DataFrame, key: str = "doc_id", ids: str = "ids", model: Model | None = None) -> DataFrame:
    """(key, text) of id lists; a null list is the empty text."""
    model = model or Model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(model)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([e.decode(x or []) for x in b.column(1).to_pylist()], pa.string())], names=[key, "text"])

    return rows.select(key, ids).mapInArrow(run, f"`{key}` {rows.schema[key].dataType.simpleString()}, text string")
