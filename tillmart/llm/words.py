"""Words, lines and rolling hashes of many texts at once: numpy on the bytes of an Arrow column.

A word is ``[^\\x20\\x09-\\x0D]+``. All separators are single bytes, so UTF-8 texts are cut without decoding.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from tillmart.deploy import ship

BATCH_ROWS = 1000
CHUNK_BYTES = 1 << 21

SEPARATOR = np.zeros(256, bool)
SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTE_VALUES = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64)
_powers: dict[int, np.ndarray] = {}


def small_batches(df: DataFrame) -> DataFrame:
    """Hand texts to Python tasks in batches of at most ``BATCH_ROWS`` rows, so long texts fit in a worker; also see
    that the tasks have this package."""
    ship(df.sparkSession)
    conf = df.sparkSession.conf
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(key)) <= BATCH_ROWS:
        conf.set(key, str(BATCH_ROWS))
    return df


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: every input bit reaches every output bit."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def _power(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    known = _powers.get(base)
    if known is None or len(known) < n:
        steps = np.full(max(n, 1 << 16), base, np.uint64)
        steps[0] = 1
        known = np.multiply.accumulate(steps)
        if len(known) <= 2 * CHUNK_BYTES:
            _powers[base] = known
    return known[:n]


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of values[start:end] for each span, from one running sum (a rolling hash)."""
    running = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * _power(_BASE, len(values)), out=running[1:])
    lengths = (ends - starts).astype(np.uint64)
    shift = _power(_INVERSE, len(values) + 1)
    return mix((running[ends] - running[starts]) * shift[starts] + lengths * np.uint64(0xD6E8FEB86659FD93))


@dataclass
class Chunk:
    """Some texts as one run of bytes. Document i has bytes[offsets[i]:offsets[i + 1]] and words
    first_word[i] .. first_word[i + 1] - 1, whose bytes are starts[w]:ends[w]."""

    first_row: int
    bytes: np.ndarray
    offsets: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first_word: np.ndarray

    @property
    def n_docs(self) -> int:
        return len(self.offsets) - 1

    def word_docs(self) -> np.ndarray:
        return np.repeat(np.arange(self.n_docs), np.diff(self.first_word))

    def word_hashes(self) -> np.ndarray:
        return span_hashes(_BYTE_VALUES[self.bytes], self.starts, self.ends)

    def grams(self, size: int) -> np.ndarray:
        """The words at which ``size`` consecutive words of one document start."""
        n = len(self.starts)
        if n < size:
            return np.empty(0, np.int64)
        ends_of_docs = np.repeat(self.first_word[1:], np.diff(self.first_word))
        return np.flatnonzero(np.arange(n) + size <= ends_of_docs)


def chunks(texts: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[Chunk]:
    """Cut a text column (null: empty) into runs of whole texts of about ``limit`` bytes; a longer text is one run."""
    column = pc.fill_null(texts.cast(pa.large_string()), "")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    if not n:
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + n + 1]
    data = column.buffers()[2]
    body = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    row = 0
    while row < n:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1)
        yield _chunk(row, body[offsets[row]:offsets[end]], offsets[row:end + 1] - offsets[row])
        row = end


def _chunk(row: int, body: np.ndarray, offsets: np.ndarray) -> Chunk:
    solid = ~SEPARATOR[body]
    edge = np.zeros(len(body) + 1, bool)  # a text begins here, so no word goes on
    edge[offsets] = True
    begins = solid.copy()
    begins[1:] &= ~solid[:-1] | edge[1:-1]
    stops = solid.copy()
    stops[:-1] &= ~solid[1:] | edge[1:-1]
    starts = np.flatnonzero(begins)
    return Chunk(row, body, offsets, starts, np.flatnonzero(stops) + 1, np.searchsorted(starts, offsets))


def totals(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of ``flags`` in each offsets[i]:offsets[i + 1]."""
    running = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=running[1:])
    return running[offsets[1:]] - running[offsets[:-1]]


def repeated(docs: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of items (document, hash): which occur again in their document, and which equal an earlier item of it."""
    keys = hashes ^ mix(docs.astype(np.uint64) + np.uint64(1))
    order = np.argsort(keys, kind="stable")
    ranked = keys[order]
    same = ranked[1:] == ranked[:-1]
    twice, later = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
    later[order[1:][same]] = True
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    return twice, later


def covered(starts: np.ndarray, size: int, n: int) -> np.ndarray:
    """Which of n words lie in a window of ``size`` words from one of ``starts``."""
    delta = np.zeros(n + 1, np.int64)
    np.add.at(delta, starts, 1)
    np.add.at(delta, starts + size, -1)
    return np.cumsum(delta[:n]) > 0
