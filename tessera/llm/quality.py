"""Quality rules with compression bands.

Rules on words and lines reject texts that are too short or repeat themselves in eight-word windows. Beyond them,
zstandard ratios (compressed over original bytes) of the whole text and of each of its chunks have to lie in a band
that depends on the length: far below it a text is repetitive, far above it incompressible. A short text cannot be
compressed well, so its band is wider and lies higher. Beyond 200 bytes the upper limits lie between the ratios
measured on prose and those of base64, random printable and random CJK text; hexadecimal digits compress like prose
(0.51 to 0.53 from 4 KB on), so no limit on the ratio tells them apart.

Chunks are ``chunk_bytes`` long and start at every half of it, the last one at the end of the text, so that every
byte from the first to the last is in one, and a stretch of one and a half chunks of junk fills one wherever it
starts. One chunk outside the band rejects the text, however long it is. A text under ``chunk_bytes`` is one chunk,
measured by the whole ratio. A shorter stretch of junk inside a text only shows as far as it moves these ratios.

Every rule looks at the whole text. Documents are handled in Arrow batches, each on its own, so a lost executor
costs its batches only.

Defined cases: null is the empty text, which has no words and fails the base rules; repeated rows are judged one by
one; other columns pass in ``kept_documents``; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import wordbytes as wb

SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True
RUN = 8


@dataclass(frozen=True)
class Bands:
    """Limits of the ratio by length: (bytes up to, lowest, highest); the last entry holds for all longer texts.

    Highest ratio of documents that pass the base rules (150,000 rows of check_l), and lowest of random text, by
    length: 0.86 and 0.91 to 300 bytes, 0.81 and 0.84 to 500, 0.73 and 0.81 to 700, 0.68 and 0.78 to 1000, 0.62 and 0.75
    to 2000, 0.56 and 0.72 beyond; for chunks 0.49 (sf0.1) and 0.73. To 200 bytes the two overlap (0.98 and 0.95).
    """

    whole: tuple[tuple[int, float, float], ...] = (
        (200, 0.40, 1.30),
        (300, 0.25, 0.905),
        (500, 0.25, 0.825),
        (700, 0.25, 0.77),
        (1_000, 0.25, 0.73),
        (2_000, 0.18, 0.70),
        (10_000, 0.18, 0.68),
        (1 << 62, 0.12, 0.68),
    )
    chunk_bytes: int = 4096
    chunk: tuple[float, float] = (0.20, 0.68)
    level: int = 3


def band(bands: Bands, n: int) -> tuple[float, float]:
    return next((low, high) for most, low, high in bands.whole if n <= most)


def chunk_starts(n: int, size: int) -> list[int]:
    """Where the chunks of a text of n bytes start; none for a text under one chunk."""
    return [*range(0, n - size, max(1, size // 2)), n - size] if n >= size else []


def in_bands(text: memoryview, bands: Bands, pack: zstandard.ZstdCompressor) -> tuple[float, float, bool]:
    """The whole ratio, the share of chunks outside their band, and whether the text passes."""
    n = len(text)
    if not n:
        return 1.0, 0.0, True
    ratio = len(pack.compress(text)) / n
    size = bands.chunk_bytes
    low, high = bands.chunk
    starts = chunk_starts(n, size)
    out = sum(not low <= len(pack.compress(text[i : i + size])) / size <= high for i in starts)
    low, high = band(bands, n)
    return ratio, out / len(starts) if starts else 0.0, low <= ratio <= high and not out


def base_counts(c: wb.Chunk) -> dict[str, np.ndarray]:
    """The word and line counts of a chunk's documents."""
    whole = (c.data & 0xC0) != 0x80
    words = c.word_hashes()
    docs = c.word_docs().astype(np.uint64)
    salt = wb.mixed(docs + np.uint64(1))
    # lines: ranges between line feeds and document borders
    cut = np.flatnonzero(c.data == 10)
    starts = np.union1d(c.offsets[:-1], cut + 1)
    starts = starts[starts < len(c.data)]
    ends = np.append(starts[1:], len(c.data))
    ends = ends - ((ends > starts) & (c.data[ends - 1] == 10)) if len(starts) else ends
    owner = np.searchsorted(c.offsets, starts, "right") - 1
    first = np.searchsorted(c.starts, starts)
    has_word = (first < np.searchsorted(c.starts, ends)) if len(starts) else np.zeros(0, bool)
    starts, ends, owner = starts[has_word], ends[has_word], owner[has_word]
    keys = c.span_hashes(starts, ends) ^ wb.mixed(owner.astype(np.uint64) + np.uint64(1))
    _, kept = np.unique(keys, return_index=True)
    lines = np.bincount(owner, minlength=c.n_docs) - np.bincount(owner[kept], minlength=c.n_docs)
    # words in windows found twice
    n = len(words)
    hit = np.zeros(n + 1, np.int64)
    inside = np.flatnonzero(wb.runs_inside(c.word_at, RUN, n))
    if len(inside):
        found = inside[wb.repeated(wb.runs(words, RUN)[inside] ^ salt[inside])]
        np.add.at(hit, found, 1)
        np.add.at(hit, found + RUN, -1)
    covered = np.concatenate([[0], np.cumsum(np.cumsum(hit[:n]) > 0)])
    return {
        "n_words": c.n_words,
        "word_chars": c.per_doc(whole & c.solid),
        "n_symbols": c.per_doc(SYMBOLS[c.data]),
        "n_dup_lines": lines,
        "n_repeat_words": np.diff(covered[c.word_at]),
    }


COLUMNS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
VERDICT = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, ratio double, bad_chunks double"


def judged(column: pa.Array, bands: Bands) -> list[pa.Array]:
    """VERDICT columns of a text column."""
    data, offsets = wb.text_bytes(column)
    pack = zstandard.ZstdCompressor(level=bands.level)
    out: dict[str, list] = {k: [np.zeros(0, np.int64)] for k in COLUMNS}
    for i, j in wb.chunks(offsets):
        for k, v in base_counts(wb.Chunk(data[offsets[i] : offsets[j]], offsets[i : j + 1])).items():
            out[k].append(v)
    counts = {k: np.concatenate(v) for k, v in out.items()}
    failed = (counts["n_words"] < 20) | (100 * counts["n_repeat_words"] > 30 * counts["n_words"])
    view = memoryview(data)
    ratios = [in_bands(view[a:b], bands, pack) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
    passed = np.array([r[2] for r in ratios], bool)
    return [pa.array(counts[k], pa.int64()) for k in COLUMNS] + [pa.array(failed), pa.array(~failed & passed), pa.array([r[0] for r in ratios], pa.float64()), pa.array([r[1] for r in ratios], pa.float64())]


def verdicts(docs: DataFrame, key: str = "doc_id", text: str = "text", bands: Bands = Bands()) -> DataFrame:
    """The key and the VERDICT columns of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [key, *(f.split()[0] for f in VERDICT.split(", "))]
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), *judged(b.column(1), bands)], names=names)

    rows = docs.select(F.col(key), F.col(text).cast("string"))
    return rows.mapInArrow(run, f"`{key}` {docs.schema[key].dataType.simpleString()}, {VERDICT}")


def kept_documents(docs: DataFrame, text: str = "text", bands: Bands = Bands()) -> DataFrame:
    """The rows that pass, with all their columns."""
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pc.fill_null(judged(b.column(at), bands)[6], False))

    return docs.mapInArrow(run, docs.schema)
