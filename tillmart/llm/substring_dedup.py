"""Substring dedup by seed and extend, without listing pairs of documents.

A window is ``WINDOW`` consecutive words. Seeds: of the ``SEED``-word hashes in each window the least (the rightmost
one on ties) is its anchor, so equal windows have equal anchors. Extension: the windows of a document that share one
anchor occurrence form a *region*, the anchor extended both ways as far as it stays the anchor. Documents meet on
anchors:

* occurrences of one (anchor, region) have all their windows in common, so every document but the one with the least id
  loses them whole; they are counted per (anchor, region), not listed;
* where an anchor has several regions, one document of each (the least id) lists its windows there, and windows are
  matched by (anchor, window hash): the least id of each window decides, and only the region's own least document can
  still win or lose.

So a passage or a copied text in a third of all documents gives one region per context, with one row per occurrence.
Covered windows are joined to maximal repeats per document. Hashes have 64 bits and act in pairs (anchor and region,
anchor and window).

Defined cases: a null text has no words; texts under ``WINDOW`` words are kept whole; repeats inside one document are
kept; rows with equal ids count as one document's and are each judged; a null id counts as larger than any other, and
nothing is removed for another null id's sake; texts of one id are told apart by 128 bits; an empty table gives an empty one; other columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from .storage import stored

WINDOW, SEED = 50, 6
NULL_ID = (1 << 63) - 1


def regions(hashes: np.ndarray, chunk: W.Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First window and number of windows of each region of a chunk, with its anchor's hash and document."""
    starts = chunk.grams(WINDOW)
    if not len(starts):
        return (np.empty(0, np.int64),) * 4
    n = len(hashes)
    seeds = np.zeros(n, np.uint64)
    at = np.arange(n - SEED + 1)
    seeds[:len(at)] = W.span_hashes(hashes, at, at + SEED)
    # The least seed of each window, rightmost on ties; windows never leave a document.
    width = WINDOW - SEED + 1
    best, place = seeds.copy(), np.arange(n)
    reach = 1
    while reach < width:
        step = min(reach, width - reach)
        later = best[step:]
        better = np.concatenate([later <= best[:-step], np.zeros(step, bool)])
        shifted, moved = np.concatenate([later, best[-step:]]), np.concatenate([place[step:], place[-step:]])
        best, place = np.where(better, shifted, best), np.where(better, moved, place)
        reach += step
    anchors = place[starts]
    first = np.flatnonzero(np.concatenate([[True], (anchors[1:] != anchors[:-1]) | (starts[1:] != starts[:-1] + 1)]))
    counts = np.diff(np.concatenate([first, [len(starts)]]))
    docs = np.searchsorted(chunk.first_word, starts[first], "right") - 1
    return starts[first], counts, seeds[anchors[first]], docs


def _occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(anchor, region, doc, text, first, windows) of every region; first counts words of the document."""
    for batch in batches:
        for chunk in W.chunks(batch.column(2)):
            rows = batch.slice(chunk.first_row, chunk.n_docs)
            hashes = chunk.word_hashes()
            first, counts, anchors, docs = regions(hashes, chunk)
            spans = W.span_hashes(hashes, first, first + counts + (WINDOW - 1))
            take = pa.array(docs)
            yield pa.RecordBatch.from_arrays(
                [pa.array(anchors.view(np.int64)), pa.array(spans.view(np.int64)), rows.column(0).take(take),
                 rows.column(1).take(take), pa.array((first - chunk.first_word[docs]).astype(np.int32)),
                 pa.array(counts.astype(np.int32))], names=["anchor", "region", "doc", "text", "first", "windows"])


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For texts with places (anchor, region, first, windows): every window there by its hash."""
    for batch in batches:
        for chunk in W.chunks(batch.column(1)):
            hashes = chunk.word_hashes()
            rows = batch.slice(chunk.first_row, chunk.n_docs)
            mine = rows.column(2)
            inner = mine.flatten()
            docs = np.repeat(np.arange(chunk.n_docs), mine.value_lengths().to_numpy(zero_copy_only=False))
            counts = inner.field("windows").to_numpy(zero_copy_only=False)
            first = inner.field("first").to_numpy(zero_copy_only=False) + chunk.first_word[docs]
            each = np.repeat(np.arange(len(docs)), counts)
            offset = np.arange(len(each)) - np.repeat(np.cumsum(counts) - counts, counts)
            at = first[each] + offset
            take = pa.array(each)
            yield pa.RecordBatch.from_arrays(
                [inner.field("anchor").take(take), pa.array(W.span_hashes(hashes, at, at + WINDOW).view(np.int64)),
                 inner.field("region").take(take), rows.column(0).take(pa.array(docs[each])),
                 pa.array(offset.astype(np.int32))], names=["anchor", "window", "region", "doc", "offset"])


def _pruned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each text without the words of its covered stretches: spans are (first word, words)."""
    for batch in batches:
        for chunk in W.chunks(batch.column(1)):
            rows = batch.slice(chunk.first_row, chunk.n_docs)
            spans, n = rows.column(2), len(chunk.starts)
            inner = spans.flatten()
            docs = np.repeat(np.arange(chunk.n_docs), spans.value_lengths().to_numpy(zero_copy_only=False))
            delta = np.zeros(n + 1, np.int64)
            first = inner.field("first").to_numpy(zero_copy_only=False) + chunk.first_word[docs]
            np.add.at(delta, first, 1)
            np.add.at(delta, first + inner.field("words").to_numpy(zero_copy_only=False), -1)
            gone = np.cumsum(delta[:n]) > 0
            kept = ~gone
            starts, sizes = chunk.starts[kept], (chunk.ends - chunk.starts)[kept] + 1
            ends = np.cumsum(sizes)
            body = np.append(chunk.bytes, np.uint8(0x20))
            out = body[np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)]
            out[ends - 1] = 0x20  # one space after each kept word
            bounds = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(kept)])[chunk.first_word]]
            joined = out.tobytes()
            texts = [joined[a:max(a, b - 1)] for a, b in zip(bounds.tolist(), bounds[1:].tolist())]
            yield pa.RecordBatch.from_arrays(
                [rows.column(0), pa.array(np.diff(chunk.first_word)), pa.array(W.totals(gone, chunk.first_word)),
                 pa.array(texts, pa.binary()).cast(pa.string())], names=["_id", "n_words", "n_removed", "kept"])


def repeats(docs: DataFrame) -> DataFrame:
    """From (_id, _t, _text): (doc, text, first, words) of covered stretches, overlapping ones not yet joined."""
    every = stored(docs.mapInArrow(
        _occurrences, "anchor long, region long, doc long, text binary, first int, windows int"), "anchors")
    shared = every.groupBy("anchor").agg(F.min("doc").alias("lo"), F.max("doc").alias("hi")).filter("lo < hi")
    # Sides that were grouped are stored before they are joined: a hot key of the other side can then be split.
    shared = stored(shared.select("anchor"), "repeated-anchors")
    found = stored(every.join(shared, "anchor"), "shared-anchors")
    least = found.groupBy("anchor", "region").agg(
        F.min(F.struct("doc", "text", "first", "windows")).alias("least"), F.max("doc").alias("most"))
    least = stored(least.select("anchor", "region", F.col("least.doc").alias("lo"), F.col("least.text").alias("text"),
                                "least.first", "least.windows", "most"), "regions")
    several = least.groupBy("anchor").agg(F.count("*").alias("n")).filter("n > 1").select("anchor")
    several = stored(several, "forked-anchors")
    places = least.join(several, "anchor").groupBy("lo", "text").agg(
        F.collect_list(F.struct("anchor", "region", "first", "windows")).alias("places"))  # at most one text's regions
    listed = docs.join(places, (docs["_id"] == places["lo"]) & (docs["_t"] == places["text"])).select(
        "_id", "_text", "places").mapInArrow(
        _windows, "anchor long, window long, region long, doc long, offset int")
    listed = stored(listed, "windows")
    owners = listed.groupBy("anchor", "window").agg(F.min("doc").alias("lo"), F.max("doc").alias("hi")).filter("lo < hi")
    owners = stored(owners.select("anchor", "window", "lo"), "window-owners")
    lost = (listed.join(owners, ["anchor", "window"]).filter("doc > lo").groupBy("anchor", "region")
            .agg(F.collect_set("offset").alias("offsets")))  # at most WINDOW - SEED + 1 of them
    marked = least.join(lost, ["anchor", "region"], "left").filter("lo < most or offsets is not null").select(
        "anchor", "region", "lo", "offsets")
    marked = stored(marked, "marked-regions")
    hits = found.join(marked, ["anchor", "region"])
    spans = F.when(F.col("doc") > F.col("lo"), F.array(F.struct(
        "first", (F.col("windows") + (WINDOW - 1)).alias("words")))).otherwise(
        F.transform("offsets", lambda o: F.struct((F.col("first") + o).alias("first"), F.lit(WINDOW).alias("words"))))
    return hits.filter("doc > lo or offsets is not null").select("doc", "text", F.explode(spans).alias("span")).select(
        "doc", "text", "span.*")


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id``, ``n_words``, ``n_removed`` and ``kept`` (the kept words, one space between) of each document."""
    kind = docs.schema[doc_id].dataType.simpleString()
    given = W.small_batches(docs.select(
        F.coalesce(F.col(doc_id).cast("long"), F.lit(NULL_ID)).alias("_id"), F.col(text).alias("_text"),
        F.col(doc_id).alias("_given"))).withColumn("_t", F.unhex(F.md5(F.col("_text").cast("binary"))))
    # Rows that repeat id and text give equal spans; as a set they are at most one text's.
    spans = repeats(given.select("_id", "_t", "_text")).groupBy("doc", "text").agg(
        F.collect_set(F.struct("first", "words")).alias("spans"))
    spread = given.join(spans, (given["_id"] == spans["doc"]) & (given["_t"] == spans["text"]), "left").select(
        "_given", "_text", "spans")
    empty = F.expr("cast(array() as array<struct<first:int,words:int>>)")
    out = spread.withColumn("spans", F.coalesce("spans", empty)).mapInArrow(
        _pruned, f"_id {kind}, n_words long, n_removed long, kept string")
    return out.withColumnRenamed("_id", doc_id)


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(doc_id, 9223372036854775807) AS k, doc_id,
                  regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
w AS (SELECT r, k, i, md5(array_to_string(ws[i:i + 49], ' ')) AS h
      FROM (SELECT *, unnest(range(1, len(ws) - 48)) AS i FROM d)),
least_ AS (SELECT h, min(k) AS lo FROM w GROUP BY h),
gone AS (SELECT DISTINCT r, i + o AS j
         FROM (SELECT r, i, unnest(range(0, 50)) AS o FROM w JOIN least_ USING (h) WHERE k > lo)),
words AS (SELECT r, unnest(ws) AS word, generate_subscripts(ws, 1) AS j FROM d),
left_ AS (SELECT r, count(gone.j) AS n_removed, string_agg(word, ' ' ORDER BY words.j) FILTER (gone.j IS NULL) AS kept
          FROM words LEFT JOIN gone USING (r, j) GROUP BY r)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed,
       sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN left_ USING (r)
"""
