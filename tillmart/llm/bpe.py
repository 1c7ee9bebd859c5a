"""Byte-level BPE encoding and decoding by merge replay over a corpus shard.

A shard's distinct words up to ``SHORT`` bytes are laid out as one run of positions and merged greedily, each on its
own: a wave takes the pair of least rank in every word, whatever ranks other words are at. There is no inverted index
from pairs to positions for them. Merges never cross words, so the ids are those of merging in rank order over all words,
and a wave is a few numpy steps over many words. Longer words use an index of their pairs by rank. Merges never cross words, so shards are independent: each task replays the merges for the words of its own
texts, and neither texts nor words are shuffled. Memory is bounded by a shard of text and a cache of encoded words.

Defined cases: a null text is an empty one, and an empty text has no ids; strings of control tokens are ordinary text;
repeated rows are encoded each on its own; an empty table gives an empty table; only the named columns are kept, so
other columns cannot clash. Decoding a null or empty list gives empty bytes.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W

SHARD_BYTES = 1 << 22
CACHED_WORDS = 500_000
#: Bytes of a word up to which all words of a shard are merged together.
SHORT = 128
NONE = 1 << 30
PLACE = (1 << 32) - 1


@lru_cache(maxsize=2)
def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as file:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}


class Replay:
    """Encodes words under one table of ranks, and remembers them."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.of_byte = np.array([ranks[bytes([b])] for b in range(256)])
        merged = sorted((ranks[t[:i]] << 32 | ranks[t[i:]], rank) for t, rank in ranks.items()
                        for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks)
        self.pair_keys, self.pair_ranks = np.array(merged or [(-1, -1)], np.int64).T.copy()
        self.forget()

    def forget(self) -> None:
        self.codes: dict[str, int] = {}
        self.ids, self.bounds = np.empty(0, np.int32), np.zeros(1, np.int64)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The tokens that pairs of tokens merge into; NONE where there is none."""
        keys = left << 32 | right
        at = np.minimum(np.searchsorted(self.pair_keys, keys), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == keys, self.pair_ranks[at], NONE)

    def merge_short(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words in a row, and how many each word has.

        Each wave applies the pair of least rank of every word, found anew over all live positions, and looks up only
        the pairs on both sides of a merge again.
        """
        sizes = np.array([len(w) for w in words])
        at = self.of_byte[np.frombuffer(b"".join(words), np.uint8)]
        alive = np.arange(len(words))  # words that may have merges left
        ends = np.cumsum(sizes)
        ranks = np.full(len(at), NONE)
        ranks[:-1] = self.rank(at[:-1], at[1:])
        ranks[ends - 1] = NONE
        done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        while len(alive):
            index = ranks << 32 | np.arange(len(at))
            first = np.minimum.reduceat(index, ends - sizes)
            busy = (first >> 32) < NONE
            if not busy.all():
                rest = np.repeat(busy, sizes)
                done.append((alive[~busy], sizes[~busy], at[~rest]))
                moved = (np.cumsum(rest) - 1)[first[busy] & PLACE]
                alive, sizes, at, ranks = alive[busy], sizes[busy], at[rest], ranks[rest]
                merged = first[busy] >> 32
            else:
                moved, merged = first & PLACE, first >> 32
            if not len(alive):
                break
            at[moved] = merged
            kept = np.ones(len(at), bool)
            kept[moved + 1] = False
            at, ranks = at[kept], ranks[kept]
            moved = moved - np.arange(len(moved))
            sizes = sizes - 1
            ends = np.cumsum(sizes)
            open_right, open_left = moved + 1 < ends, moved > ends - sizes
            ranks[moved] = NONE
            ranks[moved[open_right]] = self.rank(at[moved[open_right]], at[moved[open_right] + 1])
            ranks[moved[open_left] - 1] = self.rank(at[moved[open_left] - 1], at[moved[open_left]])
        order = np.argsort(np.concatenate([d[0] for d in done]))
        sizes = np.concatenate([d[1] for d in done])
        return _ragged(np.concatenate([d[2] for d in done]), np.cumsum(sizes) - sizes, sizes, order), sizes[order]

    def merge_long(self, word: bytes) -> list[int]:
        """The ids of one long word: the index of its pairs is a dictionary with a queue of its ranks."""
        at = self.of_byte[np.frombuffer(word, np.uint8)]
        ranks = self.rank(at[:-1], at[1:]).tolist() + [NONE]
        at, n = at.tolist(), len(at)
        after, before = [*range(1, n), -1], list(range(-1, n - 1))
        index: dict[int, list[int]] = {}
        for p, rank in enumerate(ranks):
            if rank != NONE:
                index.setdefault(rank, []).append(p)
        queue = list(index)
        heapq.heapify(queue)
        while queue:
            rank = heapq.heappop(queue)
            positions = index.pop(rank, None)
            if positions is None:
                continue
            heapq.heapify(positions)
            while positions:
                p = heapq.heappop(positions)
                if ranks[p] != rank:
                    continue
                q = after[p]
                end = after[q]
                at[p], at[q], ranks[q], after[p], ranks[p] = rank, -1, NONE, end, NONE
                if end >= 0:
                    before[end] = p
                for left, right in ((before[p], p), (p, end)):
                    if left >= 0 and right >= 0:
                        ranks[left] = found = self.ranks.get(self.tokens[at[left]] + self.tokens[at[right]], NONE)
                        if found != NONE:
                            if found not in index:
                                index[found] = []
                                heapq.heappush(queue, found)
                            index[found].append(left)
                if queue and queue[0] < rank and positions:  # a lower rank has come up: it goes first
                    index.setdefault(rank, []).extend(positions)
                    heapq.heappush(queue, rank)
                    break
        return [t for t in at if t >= 0]

    def learn(self, words: set[str]) -> None:
        """Make all these words known."""
        new = [w for w in words if w not in self.codes]
        if not new:
            return
        if len(self.codes) + len(new) > CACHED_WORDS and self.codes:
            self.forget()
            new = list(words)
        whole, short, long = [], [], []
        for word in new:
            data = word.encode()
            if data in self.ranks:
                whole.append((word, self.ranks[data]))
            elif len(data) <= SHORT:
                short.append((word, data))
            else:
                long.append((word, self.merge_long(data)))
        names = [w for group in (whole, short, long) for w, _ in group]
        ids, sizes = (self.merge_short([data for _, data in short]) if short
                      else (np.empty(0, np.int64), np.empty(0, np.int64)))
        sizes = np.concatenate([np.ones(len(whole), np.int64), sizes, np.array([len(i) for _, i in long], np.int64)])
        self.codes.update(zip(names, range(len(self.codes), len(self.codes) + len(names))))
        self.bounds = np.concatenate([self.bounds, self.bounds[-1] + np.cumsum(sizes)])
        self.ids = np.concatenate([self.ids, np.array([i for _, i in whole], np.int32), ids.astype(np.int32),
                                   np.array([i for _, some in long for i in some], np.int32)])

    def look_up(self, words: Iterable[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of known words in a row, and how many each has."""
        codes = np.fromiter(map(self.codes.__getitem__, words), np.int64)
        sizes = np.diff(self.bounds)[codes] if len(codes) else codes
        return _ragged(self.ids, self.bounds, np.diff(self.bounds), codes), sizes

    def encode(self, texts: list[str], pattern) -> tuple[np.ndarray, np.ndarray]:
        """The ids of a shard of texts in a row, and how many each text has."""
        if sum(map(len, texts)) <= 2 * SHARD_BYTES:
            split = [pattern.findall(t) for t in texts]
            self.learn(set().union(*split))
            ids, sizes = self.look_up(chain.from_iterable(split))
            return ids, W.totals(sizes, np.concatenate([[0], np.cumsum([len(s) for s in split])]).astype(np.int64))
        found, counts = [np.empty(0, np.int32)], []
        for text in texts:  # a very long text: its words by and by
            matches, count = (m.group() for m in pattern.finditer(text)), 0
            while block := list(islice(matches, 1 << 19)):
                self.learn(set(block))
                found.append(self.look_up(block)[0])
                count += len(found[-1])
            counts.append(count)
        return np.concatenate(found), np.array(counts)


def _ragged(values: np.ndarray, starts: np.ndarray, sizes: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """values[starts[r]:starts[r] + sizes[r]] for each r of rows, in a row."""
    n = sizes[rows]
    ends = np.cumsum(n)
    return values[np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts[rows] - (ends - n), n)]


@lru_cache(maxsize=2)
def _replay(path: str) -> Replay:
    return Replay(load_ranks(path))


def _shards(column: pa.Array) -> Iterator[tuple[int, int]]:
    sizes = np.asarray(pc.fill_null(pc.binary_length(column), 0), np.int64)
    row, ends = 0, np.cumsum(sizes)
    while row < len(sizes):
        start = ends[row] - sizes[row]
        stop = max(row + 1, int(np.searchsorted(ends, start + SHARD_BYTES, "right")))
        yield row, stop
        row = stop


def _encoder(path: str, pattern: str, text: str, keep: list[str], out: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        replay, split = _replay(path), regex.compile(pattern)
        for batch in batches:
            for row, stop in _shards(batch.column(text)):
                rows = batch.slice(row, stop - row)
                texts = [t or "" for t in rows.column(text).to_pylist()]
                ids, counts = replay.encode(texts, split)
                offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
                tokens = pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids))
                yield pa.RecordBatch.from_arrays([*[rows.column(k) for k in keep], tokens], names=[*keep, out])

    return run


def _fields(df: DataFrame, keep: list[str]) -> list[str]:
    return [f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keep]


def encode(docs: DataFrame, path: str, pattern: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",),
           out: str = "tokens") -> DataFrame:
    """``keep`` and the ids of each text under the ranks in the file ``path``, which every executor can read."""
    frame = W.small_batches(docs.select(*keep, text))
    return frame.mapInArrow(_encoder(path, pattern, text, list(keep), out),
                            ", ".join([*_fields(frame, list(keep)), f"`{out}` array<int>"]))


def _decoder(path: str, tokens: str, out: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _replay(path).tokens
        for batch in batches:
            column = batch.column(tokens)
            offsets, ids = column.offsets.to_pylist(), column.values.to_numpy(zero_copy_only=False)
            texts = [b"".join(map(table.__getitem__, ids[a:b].tolist())) for a, b in zip(offsets, offsets[1:])]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.binary())],
                                             names=[*batch.schema.names, out])

    return run


def decode(encoded: DataFrame, path: str, tokens: str = "tokens", out: str = "decoded") -> DataFrame:
    """All columns and the bytes that the ids stand for."""
    if out in encoded.columns:
        raise ValueError(f"column {out} is there already")
    frame = W.small_batches(encoded.withColumn(tokens, F.coalesce(tokens, F.expr("array()").cast("array<int>"))))
    return frame.mapInArrow(_decoder(path, tokens, out),
                            ", ".join([*_fields(frame, frame.columns), f"`{out}` binary"]))
