"""Quality rules by repetition coverage: the share of a text inside duplicated n-grams and duplicated lines.

Hashes of every n-gram come from one running sum per batch (numpy); no shuffle, no state beyond a batch of texts.

Defined cases: a null text is an empty one; a text without words fails (fewer than ``MIN_WORDS`` words); repeated rows
and repeated ids are judged each on its own; an empty table gives an empty table; other columns, whatever their names,
are kept by ``filter_documents`` and left out by ``assess``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import words as W

MIN_WORDS = 10
REPEAT_WINDOW = 5
MAX_REPEAT_PERCENT = 20
#: Most of a text's word characters that may lie in duplicated n-grams, by n.
MAX_COVERAGE = {5: 0.30, 6: 0.28, 8: 0.25, 10: 0.20}
MAX_LINE_COVERAGE = 0.30
#: Most symbol characters per word.
MAX_SYMBOLS = 0.3

SYMBOLS = np.zeros(256, bool)
SYMBOLS[[ord(c) for c in "#*$%&|<>"]] = True
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
SHARES = ["dup_line_share", *[f"dup_{n}gram_share" for n in MAX_COVERAGE]]
SCHEMA = ("n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
          + ", ".join(f"{s} double" for s in SHARES) + ", base_failed boolean, kept boolean")


def _lines(chunk: W.Chunk, chars: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per document: lines with a word that equal an earlier line, and the word characters in them."""
    breaks = np.flatnonzero(chunk.bytes == 0x0A)
    starts = np.sort(np.concatenate([chunk.offsets[:-1], breaks + 1]))
    docs = np.searchsorted(chunk.offsets, starts, "right") - 1
    # A break at the very end of a document opens a last empty line that begins at the next one's first byte.
    ends = np.concatenate([starts[1:], [len(chunk.bytes)]])
    is_break = np.zeros(len(chunk.bytes) + 1, bool)
    is_break[breaks] = True
    closed = (ends > starts) & is_break[np.maximum(ends - 1, 0)]
    ends = ends - closed
    running = np.concatenate([[0], np.cumsum(chars)])
    size = running[ends] - running[starts]
    solid = size > 0
    starts, ends, docs, size = starts[solid], ends[solid], docs[solid], size[solid]
    _, later = W.repeated(docs, W.span_hashes(W._BYTE_VALUES[chunk.bytes], starts, ends))
    n = chunk.n_docs
    return (np.bincount(docs, later, n).astype(np.int64), np.bincount(docs, later * size, n))


def assess_chunk(chunk: W.Chunk) -> dict[str, np.ndarray]:
    n_docs, n = chunk.n_docs, len(chunk.starts)
    chars = ((chunk.bytes & 0xC0) != 0x80) & ~W.SEPARATOR[chunk.bytes]
    running = np.concatenate([[0], np.cumsum(chars)])
    sizes = running[chunk.ends] - running[chunk.starts]
    hashes, docs = chunk.word_hashes(), chunk.word_docs()
    out = {"n_words": np.diff(chunk.first_word), "word_chars": W.totals(chars, chunk.offsets),
           "n_symbols": W.totals(SYMBOLS[chunk.bytes], chunk.offsets)}
    whole = np.maximum(out["word_chars"], 1)
    out["n_dup_lines"], in_lines = _lines(chunk, chars)
    out["dup_line_share"] = in_lines / whole
    # A duplicated n-gram begins with a duplicated shorter one, so each length looks only where the last one found some.
    candidates = np.arange(n)
    for size in sorted({REPEAT_WINDOW, *MAX_COVERAGE}):
        last = np.repeat(chunk.first_word[1:], np.diff(chunk.first_word))
        candidates = candidates[candidates + size <= last[candidates]]
        twice, _ = W.repeated(docs[candidates], W.span_hashes(hashes, candidates, candidates + size))
        candidates = candidates[twice]
        inside = W.covered(candidates, size, n)
        if size == REPEAT_WINDOW:
            out["n_repeat_words"] = W.totals(inside, chunk.first_word)
        if size in MAX_COVERAGE:
            out[f"dup_{size}gram_share"] = W.totals(inside * sizes, chunk.first_word) / whole
    out["base_failed"] = ((out["n_words"] < MIN_WORDS)
                          | (100 * out["n_repeat_words"] > MAX_REPEAT_PERCENT * out["n_words"]))
    kept = ~out["base_failed"] & (out["dup_line_share"] <= MAX_LINE_COVERAGE)
    kept &= out["n_symbols"] <= MAX_SYMBOLS * np.maximum(out["n_words"], 1)
    for size, most in MAX_COVERAGE.items():
        kept &= out[f"dup_{size}gram_share"] <= most
    out["kept"] = kept
    assert len(kept) == n_docs
    return out


def _mapped(texts: str, keep: list[str], only_kept: bool):
    names = [c.split()[0] for c in SCHEMA.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in W.chunks(batch.column(texts)):
                found = assess_chunk(chunk)
                rows = batch.slice(chunk.first_row, chunk.n_docs)
                if only_kept:
                    yield rows.filter(pa.array(found["kept"]))
                else:
                    yield pa.RecordBatch.from_arrays([rows.column(k) for k in keep]
                                                     + [pa.array(found[c]) for c in names], names=[*keep, *names])

    return run


def assess(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id`` with counts, coverage shares and the verdicts of each text."""
    kind = docs.schema[doc_id].dataType.simpleString()
    return W.small_batches(docs.select(doc_id, text)).mapInArrow(
        _mapped(text, [doc_id], False), f"{doc_id} {kind}, {SCHEMA}")


def filter_documents(docs: DataFrame, text: str = "text") -> DataFrame:
    """The documents whose text passes, with all their columns."""
    return W.small_batches(docs).mapInArrow(_mapped(text, [], True), docs.schema)


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text,
                  regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
base AS (SELECT r, doc_id, ws, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
                length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols FROM d),
lines AS (SELECT r, (sum(n) - count(*))::BIGINT AS n_dup_lines, sum((n - 1) * size) AS dup_chars
          FROM (SELECT r, line, count(*) AS n, length(regexp_replace(line, '[\x20\x09-\x0D]', '', 'g')) AS size
                FROM (SELECT r, unnest(string_split(text, chr(10))) AS line FROM d) GROUP BY r, line)
          WHERE size > 0 GROUP BY r),
grams AS (SELECT r, n, list(i) AS starts
          FROM (SELECT r, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM d, (VALUES (5), (6), (8), (10)) sizes(n))
          GROUP BY r, n, md5(array_to_string(ws[i:i + n - 1], ' ')) HAVING count(*) > 1),
inside AS (SELECT DISTINCT r, n, i + o AS j
           FROM (SELECT r, n, i, unnest(range(0, n)) AS o FROM (SELECT r, n, unnest(starts) AS i FROM grams))),
sums AS (SELECT r, count(*) FILTER (n = 5) AS n_repeat_words,
                sum(length(ws[j])) FILTER (n = 5) AS c5, sum(length(ws[j])) FILTER (n = 6) AS c6,
                sum(length(ws[j])) FILTER (n = 8) AS c8, sum(length(ws[j])) FILTER (n = 10) AS c10
         FROM inside JOIN d USING (r) GROUP BY r),
joined AS (SELECT doc_id, n_words, word_chars, n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines,
                  coalesce(n_repeat_words, 0) AS n_repeat_words, greatest(word_chars, 1)::DOUBLE AS whole,
                  coalesce(dup_chars, 0)::DOUBLE / whole AS dup_line_share, coalesce(c5, 0)::DOUBLE / whole AS dup_5gram_share,
                  coalesce(c6, 0)::DOUBLE / whole AS dup_6gram_share, coalesce(c8, 0)::DOUBLE / whole AS dup_8gram_share,
                  coalesce(c10, 0)::DOUBLE / whole AS dup_10gram_share
           FROM base LEFT JOIN lines USING (r) LEFT JOIN sums USING (r))
SELECT * EXCLUDE (whole), n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
       NOT base_failed AND dup_line_share <= 0.3 AND n_symbols <= 0.3::DOUBLE * greatest(n_words, 1)
       AND dup_5gram_share <= 0.3 AND dup_6gram_share <= 0.28 AND dup_8gram_share <= 0.25 AND dup_10gram_share <= 0.2 AS kept
FROM joined
"""
