"""Mixing sources to target weights along a time-varying curriculum.

Each source gets a target of words: its weight's share of ``AMOUNT`` times all words, at most ``MOST`` times its own
size, the excess shared again by weight. A source's documents are taken in the order of a hash of their ids: whole
passes first, then documents up to the rest of the target, the last one if at least half of it fits; so its words differ from
the target by at most half a document. Each source also
has a schedule of its intensity over the training run (0 to 1). Integrating it gives the source's cumulative demand;
inverting that at a document's place among the words taken gives its training position, by which documents are
range-sorted.

Running sums go over (source, the hash's first three digits), then over at most 4096 digits per source, so a source
with a third of all rows is spread over as many groups. The driver sees two numbers per round of sharing.

Defined cases: a null text has size 0 and is never taken; null is a source of its own, the last one; rows that repeat
id, source and size are numbered and each is decided at its own place; an empty table gives an empty one; a total of no words gives targets of 0; columns
with other names play no part, and ``in_training_order`` keeps them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tillmart.operators.ordered import number_rows, number_rows_within
from tillmart.operators.shared_storage import materialize, spread

WEIGHTS = (3, 1, 2)
AMOUNT, MOST = 1.5, 2
WORD = r"[^\x20\x09-\x0D]+"
#: Intensity at the start and the end of the run, linear between, for the sources of each weight; the mean is 1.
SCHEDULES = ((1.5, 0.5), (1.0, 1.0), (0.5, 1.5))
DIGITS = 3
EQUAL = 1 << 16  # rows equal in id, source and size that one task lists at a time


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame) -> DataFrame:
    """``source``, ``source_size``, ``weight``, ``schedule`` and ``target`` from rows (source, size)."""
    summed = sizes.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    numbered = number_rows(summed, [F.col("source").asc_nulls_last()], "_place")
    step = ((F.col("_place") - 1) % len(WEIGHTS)).cast("int")
    weight = F.get(F.array(*[F.lit(w) for w in WEIGHTS]), step)
    sources = materialize(numbered.select("source", "source_size", weight.cast("double").alias("weight"),
                                          step.alias("schedule")))
    cap = F.col("source_size") * float(MOST)
    total, weights = sources.agg(F.sum("source_size"), F.sum("weight")).first()
    wanted, full, level = AMOUNT * (total or 0), None, 0.0
    capped = 0.0
    while weights and capped != full:  # every round fixes at least one more source at its cap
        full, level = capped, (wanted - capped) / weights
        over = cap < F.col("weight") * level
        capped, weights = sources.agg(F.coalesce(F.sum(F.when(over, cap)), F.lit(0.0)),
                                      F.coalesce(F.sum(F.when(~over, F.col("weight"))), F.lit(0.0))).first()
    return sources.withColumn("target", F.least(cap, F.col("weight") * F.lit(level)))


def _position(place: Column, schedule: Column) -> Column:
    """The time at which a linear intensity has run through the share ``place``."""
    starts = F.get(F.array(*[F.lit(a) for a, _ in SCHEDULES]), schedule)
    slope = F.get(F.array(*[F.lit(b - a) for a, b in SCHEDULES]), schedule)
    root = F.sqrt(starts * starts + 2 * slope * place)
    return F.when(slope == 0, place / starts).otherwise((root - starts) / slope)


def place(sizes: DataFrame) -> DataFrame:
    """For stored rows (doc_id, source, size, n: how many rows are such): ``source_size``, ``target``, ``schedule``, ``_whole``
    (passes over the whole source) and ``_start``, the words of the source ahead of the first of the n rows."""
    targets = materialize(source_targets(sizes))
    keyed = sizes.withColumn("_hash", F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")))
    keyed = keyed.withColumn("_digits", F.substring("_hash", 1, DIGITS)).withColumn("_words", F.col("size") * F.col("n"))
    ahead = W.partitionBy("source").orderBy("_digits").rowsBetween(W.unboundedPreceding, -1)
    before = keyed.groupBy("source", "_digits").agg(F.sum("_words").alias("_w")).select(
        F.col("source").alias("_s"), F.col("_digits").alias("_d"), F.coalesce(F.sum("_w").over(ahead), F.lit(0)).alias("_before"))
    inside = (W.partitionBy("source", "_digits").orderBy("_hash", "doc_id", "size")
              .rowsBetween(W.unboundedPreceding, -1))
    placed = keyed.withColumn("_inside", F.coalesce(F.sum("_words").over(inside), F.lit(0)))
    placed = placed.join(before, placed["source"].eqNullSafe(before["_s"]) & (placed["_digits"] == before["_d"]))
    named = targets.withColumnRenamed("source", "_s2")
    placed = placed.join(named, placed["source"].eqNullSafe(named["_s2"]))
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    return placed.select("doc_id", "source", "size", "n", "source_size", "target", "schedule", whole.alias("_whole"),
                         (F.col("_before") + F.col("_inside")).alias("_start"))


def _copies(number: Column) -> Column:
    """How often the mix takes the row that is the ``number``-th (from 0) of its equals."""
    rest = F.col("target") - F.col("_whole") * F.col("source_size")
    start = F.col("_start") + number * F.col("size")
    more = F.when(2 * start + F.col("size") <= 2 * rest, 1).otherwise(0)
    return F.when(F.col("size") > 0, F.col("_whole") + more).otherwise(0).cast("long")


def _positions(number: Column, copies: Column) -> Column:
    """The training position of each copy, at the middle of its words."""
    share = F.col("_start") + number * F.col("size") + F.col("size") / 2
    place_of = lambda copy: F.least(F.lit(1.0), (copy * F.col("source_size") + share) / F.col("target"))
    return F.when(copies > 0, F.transform(F.sequence(F.lit(0).cast("long"), copies - 1), lambda c: _position(
        place_of(c), F.col("schedule")))).otherwise(F.expr("cast(array() as array<double>)"))


def _sizes(docs: DataFrame, doc_id: str, source: str, text: str) -> DataFrame:
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), size_of(F.col(text)).alias("size"))
    return materialize(rows.groupBy("doc_id", "source", "size").agg(F.count("*").alias("n")))


def mix(docs: DataFrame, doc_id: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """One row per document, range-sorted by its first training position; documents not taken come last."""
    placed = place(_sizes(docs, doc_id, source, text))
    last = F.expr(f"least(n, (_block + 1) * {EQUAL}) - 1")
    blocks = spread(placed.withColumn("_block", F.explode(F.expr(f"sequence(0L, (n - 1) div {EQUAL})"))))
    rows = blocks.withColumn("_number", F.explode(F.sequence(F.col("_block") * EQUAL, last)))
    planned = rows.withColumn("copies", _copies(F.col("_number"))).withColumn(
        "positions", _positions(F.col("_number"), F.col("copies")))
    planned = materialize(planned.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias(
        "taken"), "source", "copies", "positions", F.get("positions", F.lit(0)).alias("first_position"),
        F.try_element_at("positions", F.lit(-1)).alias("last_position")))
    first = F.coalesce("first_position", F.lit(2.0))
    return planned.repartitionByRange(first, "doc_id").sortWithinPartitions(first, "doc_id")


def in_training_order(docs: DataFrame, doc_id: str = "doc_id", source: str = "source", text: str = "text",
                      position: str | None = None) -> DataFrame:
    """The documents taken, once per copy, range-sorted by training position and id, with all their columns.

    Rows lose their order once they are written to several files and read again; ``position`` names a column to add that
    holds each copy's training position. Of rows equal in id, source and size, the order of a hash of all their columns
    decides which are taken; they are numbered in ranges, so any number of them may be.
    """
    if position in docs.columns:
        raise ValueError(f"column {position} is there already")
    placed = materialize(place(_sizes(docs, doc_id, source, text)).filter(_copies(F.lit(0)) > 0).select(
        F.col("doc_id").alias("_id"), F.col("source").alias("_source"), "size", "n", "source_size", "target", "schedule",
        "_whole", "_start"))
    row = docs.select(F.struct("*").alias("_given"), F.col(doc_id).alias("_doc"), F.col(source).alias("_src"),
                      size_of(F.col(text)).alias("_words"))
    taken = row.join(placed, row["_doc"].eqNullSafe(placed["_id"]) & row["_src"].eqNullSafe(placed["_source"])
                     & (row["_words"] == placed["size"]))
    numbered = taken.filter("n = 1").withColumn("_number", F.lit(0).cast("long"))
    if not placed.filter("n > 1").isEmpty():
        several = materialize(taken.filter("n > 1").withColumn("_hash", F.md5(F.to_json("_given").cast("binary")))
                              .withColumn("_tie", F.monotonically_increasing_id()))  # cuts rows that are wholly equal
        placed_rows = number_rows_within(several, ["_doc", "_src", "_words"], [F.col("_hash").asc(), F.col("_tie").asc()], "_number")
        numbered = numbered.union(placed_rows.drop("_hash", "_tie").withColumn("_number", F.col("_number") - 1))
    copies = numbered.select("_given", "_doc", F.explode(_positions(F.col("_number"), _copies(F.col("_number")))).alias("_position"))
    ranged = copies.repartitionByRange("_position", "_doc").sortWithinPartitions("_position", "_doc")
    return ranged.select("_given.*", *([F.col("_position").alias(position)] if position else []))


ORACLE = """
WITH rows_ AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size
               FROM documents),
keyed AS (SELECT doc_id, source, size, count(*) AS n, md5(coalesce(doc_id::VARCHAR, '')) AS h FROM rows_
          GROUP BY doc_id, source, size),
sources AS (SELECT source, sum(size)::BIGINT AS source_size,
                   list_extract([3.0, 1.0, 2.0]::DOUBLE[], ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT)
                       AS weight,
                   (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS place_
            FROM rows_ GROUP BY source),
ranked AS (SELECT *, sum(2 * source_size) OVER by_cap AS caps, sum(weight) OVER () - sum(weight) OVER by_cap AS left_,
                  1.5 * sum(source_size) OVER () AS wanted,
                  lead(2 * source_size / weight) OVER by_cap AS next_
           FROM sources WINDOW by_cap AS (ORDER BY 2 * source_size / weight, source NULLS LAST
                                          ROWS UNBOUNDED PRECEDING)),
levels AS (SELECT (1.5 * sum(source_size))::DOUBLE / sum(weight) AS level, min(2 * source_size / weight) AS next_, 0 AS caps
           FROM sources
           UNION ALL SELECT (wanted - caps)::DOUBLE / left_, next_, caps FROM ranked WHERE left_ > 0),
level_ AS (SELECT level FROM levels WHERE level <= next_ ORDER BY caps LIMIT 1),
targets AS (SELECT s.*, least(2.0 * source_size, weight * coalesce((SELECT level FROM level_), 0)) AS target FROM sources s),
placed AS (SELECT k.*, t.source_size, t.target, t.place_,
                  coalesce(sum(k.size * k.n) OVER (PARTITION BY k.source ORDER BY h, doc_id, size
                                                   ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS first_,
                  CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS whole
           FROM keyed k JOIN targets t ON k.source IS NOT DISTINCT FROM t.source),
single AS (SELECT *, first_ + size * i AS start FROM (SELECT *, unnest(range(n)) AS i FROM placed)),
counted AS (SELECT *, (CASE WHEN size = 0 THEN 0 ELSE whole + CASE WHEN 2 * start + size
                            <= 2 * (target - whole * source_size) THEN 1 ELSE 0 END END)::BIGINT AS copies FROM single),
halves AS (SELECT *, start + size::DOUBLE / 2 AS share FROM counted),
places AS (SELECT *, CASE WHEN copies > 0 THEN least(1.0::DOUBLE, share / target) END AS first_place,
                  CASE WHEN copies > 0 THEN least(1.0::DOUBLE, ((copies - 1) * source_size + share) / target) END AS last_place
           FROM halves)
SELECT doc_id, size, source_size, target, copies * size AS taken, copies,
       {first} AS first_position,
       {last} AS last_position
FROM places
"""


def oracle() -> str:
    """The SQL of ``mix``; a source's demand is solved for the time at which it reaches a share of its words."""
    def at(share: str) -> str:
        cases = [f"WHEN {i} THEN " + (f"{share} / {a}::DOUBLE" if a == b else
                 f"(sqrt({a}::DOUBLE * {a}::DOUBLE + 2 * ({b - a})::DOUBLE * {share}) - {a}::DOUBLE) / ({b - a})::DOUBLE")
                 for i, (a, b) in enumerate(SCHEDULES)]
        return f"CASE place_ {' '.join(cases)} END"

    return ORACLE.format(first=at("first_place"), last=at("last_place"))
