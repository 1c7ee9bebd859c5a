"""SimHash fingerprints, and near-duplicate groups by BK-trees.

Two fingerprints with at most ``RADIUS`` (3) differing bits agree in at least one of four blocks of bits, so they meet
in one of the shards (block, its value). Each shard with two fingerprints or more gets a BK-tree, whose search follows
only the edges within the radius. The tree is not broadcast: its searches come from the fingerprints of the same shard,
which lie with it already. A shard of more than ``SHARD`` fingerprints is split by four blocks of its other bits, again
and again, which loses no link; so one task holds at most ``SHARD`` fingerprints of a shard. Each shard emits a link
from every fingerprint to the first of its local component, never all pairs. Copies share one fingerprint, which is
indexed once.

Defined cases: a null text is an empty one; texts without a word have fingerprint zero and are linked with each other;
repeated rows come out each; a null id never names a group that has any other id; an empty table gives an empty one;
other columns play no part and, in ``keep_one``, are kept whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillmart.operators.shared_storage import materialize, spread

from . import words as W
from .components import components

SHINGLE, SEED, RADIUS, SHARD = 3, 42, 3, 4096
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A"):ord("Z") + 1] += 32


def fingerprint_chunk(chunk: W.Chunk) -> np.ndarray:
    n = len(chunk.starts)
    body = LOWER[chunk.bytes]
    kept = ~W.SEPARATOR[body]
    gaps = chunk.ends[(chunk.ends < len(body))]
    gaps = gaps[W.SEPARATOR[body[gaps]]]
    body[gaps], kept[gaps] = 0x20, True  # one space after each word
    moved = np.cumsum(kept) - kept
    text = body[kept].tobytes()
    sizes = chunk.ends - chunk.starts
    counts = np.diff(chunk.first_word)
    # Shingle starts: each word with SHINGLE - 1 more behind it; a shorter text is one shingle.
    last = np.repeat(chunk.first_word[1:], counts)
    at = np.arange(n)
    short = np.repeat(counts < SHINGLE, counts)
    begin = np.where(short, at == np.repeat(chunk.first_word[:-1], counts), at + SHINGLE <= last)
    first = np.flatnonzero(begin)
    final = np.where(short[first], last[first], first + SHINGLE) - 1
    begins, stops = moved[chunk.starts[first]].tolist(), (moved[chunk.starts[final]] + sizes[final]).tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(text[a:b], SEED) for a, b in zip(begins, stops)), np.uint64, len(begins))
    out = np.zeros(chunk.n_docs, np.uint64)
    bounds = np.searchsorted(first, chunk.first_word)
    some = np.flatnonzero(np.diff(bounds))
    if len(some):
        bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones = np.add.reduceat(bits, bounds[some], axis=0, dtype=np.int32)
        ones = 2 * ones > np.diff(bounds)[some][:, None]
        out[some] = np.packbits(ones, axis=1, bitorder="little").view("<u8").ravel()
    return out


def _fingerprints(text: str, keep: list[str], out: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in W.chunks(batch.column(text)):
                rows = batch.slice(chunk.first_row, chunk.n_docs)
                found = pa.array(fingerprint_chunk(chunk).view(np.int64))
                yield pa.RecordBatch.from_arrays([*[rows.column(rows.schema.get_field_index(k)) for k in keep], found],
                                                 names=[*keep, out])

    return run


def fingerprints(docs: DataFrame, keep: list[str], text: str = "text", out: str = "_fp") -> DataFrame:
    """``keep`` and the fingerprint of each text, its 64 bits as a long."""
    fields = [f"`{k}` {docs.schema[k].dataType.simpleString()}" for k in keep]
    frame = W.small_batches(docs.select(*dict.fromkeys([*keep, text])))
    return frame.mapInArrow(_fingerprints(text, keep, out), ", ".join([*fields, f"`{out}` long"]))


class BKTree:
    """Fingerprints; a child hangs at its distance from its parent."""

    def __init__(self) -> None:
        self.values: list[int] = []
        self.edges: list[dict[int, int]] = []

    def add(self, value: int) -> None:
        node, place = 0, len(self.values)
        while place:
            distance = (value ^ self.values[node]).bit_count()
            child = self.edges[node].get(distance)
            if child is None:
                self.edges[node][distance] = place
                break
            node = child
        self.values.append(value)
        self.edges.append({})

    def near(self, value: int, radius: int) -> list[int]:
        """Places of the fingerprints within the radius."""
        found, open_nodes = [], [0] if self.values else []
        while open_nodes:
            node = open_nodes.pop()
            distance = (value ^ self.values[node]).bit_count()
            if distance <= radius:
                found.append(node)
            edges = self.edges[node]
            if len(edges) <= 2 * radius + 1:
                open_nodes += [child for edge, child in edges.items() if -radius <= edge - distance <= radius]
            else:
                open_nodes += [edges[e] for e in range(distance - radius, distance + radius + 1) if e in edges]
        return found


def shard_links(values: list[int]) -> list[tuple[int, int]]:
    """For one shard: every fingerprint that is near another, with the first one of its local component."""
    tree, root = BKTree(), list(range(len(values)))

    def top(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for place, value in enumerate(values):
        for other in tree.near(value, RADIUS):
            a, b = top(place), top(other)
            root[max(a, b)] = min(a, b)
        tree.add(value)
    return [(values[i], values[top(i)]) for i in range(len(values)) if top(i) != i]


def _search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by shard; a shard may go on in the next batch."""
    mask = key = np.empty(0, np.int64)
    fp = mask
    for batch in batches:
        mask, key, fp = (np.concatenate([old, batch.column(n).to_numpy(zero_copy_only=False)])
                         for old, n in ((mask, "mask"), (key, "key"), (fp, "_fp")))
        edges = np.flatnonzero((mask[1:] != mask[:-1]) | (key[1:] != key[:-1])) + 1
        bounds = [0, *edges.tolist()]
        yield _links(fp, bounds)
        mask, key, fp = mask[bounds[-1]:], key[bounds[-1]:], fp[bounds[-1]:]
    yield _links(fp, [0, len(fp)])


def _links(fp: np.ndarray, bounds: list[int]) -> pa.RecordBatch:
    found = [pair for a, b in zip(bounds, bounds[1:])
             for pair in shard_links((fp[a:b].view(np.uint64)).tolist())]
    pairs = np.array(found, np.uint64).reshape(-1, 2).view(np.int64)
    return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy())], names=["a", "b"])


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def finer(mask: int) -> list[int]:
    """The mask with each of RADIUS + 1 blocks of its free bits added."""
    free = [b for b in range(64) if not mask >> b & 1]
    blocks = np.array_split(free, RADIUS + 1)
    return [mask | sum(1 << int(b) for b in block) for block in blocks]


def links(distinct: DataFrame) -> DataFrame:
    """Links (a, b) that connect all fingerprints (column ``_fp``, distinct) within the radius."""
    masks, out = finer(0), None
    rows = distinct.select("_fp", F.explode(F.array(*[F.lit(_signed(m)) for m in masks])).alias("mask"))
    while True:
        rows = rows.withColumn("key", F.col("_fp").bitwiseAND(F.col("mask")))
        sizes = materialize(rows.groupBy("mask", "key").agg(F.count("*").alias("n")).filter("n > 1"))
        sized = rows.join(sizes, ["mask", "key"])
        ready = spread(sized.filter(F.col("n") <= SHARD).select("mask", "key", "_fp"), "mask", "key")
        found = (ready.sortWithinPartitions("mask", "key", "_fp").mapInArrow(_search, "a long, b long").distinct())
        out = found if out is None else out.union(found)
        if (sizes.agg(F.max("n")).first()[0] or 0) <= SHARD:
            return out
        children = {m: finer(m) for m in masks}
        masks = sorted({c for some in children.values() for c in some})
        split = F.create_map(*[x for m, some in children.items() for x in (
            F.lit(_signed(m)), F.array(*[F.lit(_signed(c)) for c in some]))])
        rows = materialize(sized.filter(F.col("n") > SHARD).select("_fp", F.explode(split[F.col("mask")]).alias("mask"))
                           .distinct())


def _groups(found: DataFrame, doc_id: str) -> DataFrame:
    """``_fp`` with ``component_id`` (least id of its group) and ``_keeper``, the fingerprint of that document."""
    firsts = materialize(found.groupBy("_fp").agg(F.min(doc_id).alias("_first")))
    roots = components(links(firsts.select("_fp")))
    rooted = firsts.join(roots, firsts["_fp"] == roots["node"], "left").select(
        "_fp", "_first", F.coalesce("root", "_fp").alias("_root"))
    least = F.min(F.struct(F.col("_first").isNull().alias("none"), "_first", "_fp"))
    return rooted.join(rooted.groupBy("_root").agg(least.alias("_least")), "_root").select(
        "_fp", F.col("_least._first").alias("component_id"), F.col("_least._fp").alias("_keeper"))


def near_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id``, ``fingerprint`` (16 hexadecimal digits) and ``component_id`` of every document."""
    found = materialize(fingerprints(docs, [doc_id], text))
    groups = _groups(found, doc_id)
    return found.join(groups, "_fp").select(doc_id, F.lower(F.lpad(F.hex("_fp"), 16, "0")).alias("fingerprint"),
                                            "component_id")


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents with the least id of their groups, one row each, with all their columns.

    Of several rows with that id and fingerprint, the one whose columns hash to the least value stays, so the result does not
    depend on how rows are partitioned. Texts are fingerprinted once; the rows that stay are found again by that hash.
    """
    names = [f"_c{i}" for i in range(len(docs.columns))]  # so no column clashes with those added here
    given = docs.toDF(*names)
    its_id, its_text = names[docs.columns.index(doc_id)], names[docs.columns.index(text)]
    rest = F.to_json(F.struct(*[n for n in names if n != its_text]))
    in_text = F.md5(F.col(its_text).cast("binary"))  # 32 digits, none for a null
    hashed = given.withColumn("_key", F.md5(F.concat(F.coalesce(in_text, F.lit("-")), rest).cast("binary")))
    found = materialize(fingerprints(hashed, [its_id, "_key"], its_text))
    groups = _groups(found, its_id).filter(F.col("_fp") == F.col("_keeper")).select(
        F.col("_fp").alias("_kept_fp"), F.col("component_id").alias("_kept_id"))
    kept = (found.join(groups, (found["_fp"] == groups["_kept_fp"]) & found[its_id].eqNullSafe(groups["_kept_id"]))
            .groupBy("_kept_fp", "_kept_id").agg(F.min("_key").alias("_key")).select("_key"))
    return hashed.join(kept, "_key").dropDuplicates(["_key"]).select(*names).toDF(*docs.columns)  # equal rows only
