"""Repair of a conversation's structure: the cheapest edits that make its roles alternate.

Rows are kept, given another role, deleted, or empty turns inserted before them. The search is iterative-deepening A*:
depth first in ASCII order of the edits (D, I, K, R) under a cost bound that rises to the least cost beyond it, with a
table of states that failed under a remaining budget. Its lower bound counts what every row costs in any case and, over
disjoint pairs of neighbours that cannot stand side by side, what a pair costs more. The first accepting path is the answer:
no cheaper one exists, and none of that cost comes before it.

A conversation may be of any length. It is searched in blocks of ``BLOCK`` rows, each from every role state to every role
state, and neighbouring blocks are joined two by two until one is left: of the paths through a joined pair the cheapest
stays, then the ASCII-least. That is the answer of the whole search, since two paths of one cost over the same rows never
begin one with the other (the longer would hold more insertions and cost more). Rows are numbered and repeated rows found
without sending a conversation to one task. Only the digest of the repaired text takes its lines one after the other, in
a stream that holds one batch.

Defined cases: a null conversation is one of its own; a null turn comes before all others; rows of one turn are ordered
by role, then by the SHA-256 of the text. ``damage`` reads nulls as one space. A row whose role is empty or begins with another
letter than s, u or a cannot be kept. A conversation without rows is repaired by nothing. An empty table gives an empty one.
Columns that are not asked for are dropped, so their names cannot clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillmart.operators.ordered import number_rows_within
from tillmart.operators.shared_storage import spread

from .checksum import crc32_sql
from .storage import stored
from .words import small_batches

WORD_BYTES = r"[^\x20\x09-\x0D]"
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: States of the roles so far: nothing, then after a system, a user and an assistant turn. Legal ends are "E" and "A".
STATES = "ESUA"
KEPT = {"E": {"s": "S", "u": "U"}, "S": {"u": "U"}, "U": {"a": "A"}, "A": {"u": "U"}}
#: The only role that may be inserted, or given to a row, in a state.
NEXT = {"E": "u", "S": "u", "U": "a", "A": "u"}
ROLES = {"u": "user", "a": "assistant"}
BLOCK = 128
SALTS = 16


class Search:
    """The cheapest edits of one block, coded as one letter a row for its initial (``-`` for others) and one for its
    fault: ``d`` must be deleted, ``t`` is truncated, ``-`` has none."""

    def __init__(self, code: str):
        self.rows = [(code[i], code[i + 1]) for i in range(0, len(code), 2)]
        self.floor = self._floors()

    def _floors(self) -> list[int]:
        """For each row on: a lower bound on the cost of all rows from it on, whatever the state."""
        n = len(self.rows)
        base, spare = [0] * (n + 1), [0] * n
        for i in range(n - 1, -1, -1):
            initial, fault = self.rows[i]
            late = TRUNCATED if fault == "t" else 0
            keep = late if initial in "sua" else DELETE
            least = DELETE if fault == "d" else min(DELETE, keep, REROLE + late)
            base[i], spare[i] = base[i + 1] + least, DELETE - least
        pairs, after = [0] * (n + 3), n  # after: the next row that need not go
        for i in range(n - 1, -1, -1):
            pairs[i] = pairs[i + 1]
            if self.rows[i][1] == "d":
                continue
            if after < n and "-" not in (x := self.rows[i][0] + self.rows[after][0]) and x not in ("su", "ua", "au"):
                pairs[i] = max(pairs[i], min(INSERT, REROLE, spare[i], spare[after]) + pairs[after + 1])
            after = i
        return [base[i] + pairs[i] for i in range(n + 1)]

    def edits(self, i: int, state: str) -> Iterator[tuple[str, int, int, str]]:
        """(edit, cost, next row, next state) in ASCII order of the edits."""
        role = NEXT[state]
        filled = KEPT[state][role]
        if i == len(self.rows):
            yield "I", INSERT, i, filled
            return
        initial, fault = self.rows[i]
        late = TRUNCATED if fault == "t" else 0
        yield "D", DELETE, i + 1, state
        yield "I", INSERT, i, filled
        if fault != "d":
            if initial in KEPT[state]:
                yield "K", late, i + 1, KEPT[state][initial]
            yield "R", REROLE + late, i + 1, filled

    def cheapest(self, start: str, goal: str) -> tuple[int, str] | None:
        """The least cost and, of that cost, the ASCII-least edits from one state to another; None where there are none."""
        if goal == "E" and start != "E" or goal == "S" and start not in "ES":
            return None
        if goal == "S" and start == "E" and not any(r == "s" and f != "d" for r, f in self.rows):
            return None
        bound = self.floor[0]
        failed: dict[tuple[int, str], int] = {}
        while True:
            path, bound = self._within(bound, start, goal, failed)
            if path is not None:
                return bound, path

    def _within(self, bound: int, start: str, goal: str, failed: dict) -> tuple[str | None, int]:
        """The first path of at most ``bound``, or the next bound to try. A state that failed keeps the least budget that
        might do, by which a later pass leaves it out."""
        n = len(self.rows)
        open_ = [(0, start, bound, self.edits(0, start), [])]
        path: list[str] = []
        if (0, start) == (n, goal):
            return "", bound
        while open_:
            i, state, budget, edits, least = open_[-1]
            for edit, cost, at, then in edits:
                need = cost + max(self.floor[at], failed.get((at, then), 0))
                if need > budget:
                    least.append(need)
                    continue
                path.append(edit)
                if at == n and then == goal:
                    return "".join(path), bound
                open_.append((at, then, budget - cost, self.edits(at, then), []))
                break
            else:
                open_.pop()
                failed[i, state] = max(failed.get((i, state), 0), min((x for x in least if x > budget), default=budget + 1))
                if path:
                    path.pop()
                if open_:
                    at, then = i, state
                    spent = open_[-1][2] - budget
                    open_[-1][4].append(spent + failed[at, then])
        return None, failed[0, start]


@lru_cache(maxsize=1 << 14)
def _solved(code: str, first: bool) -> list[tuple[str, int, str]]:
    search, out = Search(code), []
    for start in "E" if first else STATES:
        for goal in STATES:
            found = search.cheapest(start, goal)
            if found:
                out.append((start + goal, *found))
    return out


def _blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        solved = [_solved(code, block == 0) for code, block in zip(batch["code"], batch["block"])]
        paths = [[{"ends": e, "cost": c, "audit": a} for e, c, a in s] for s in solved]
        yield batch[["conv", "block"]].assign(paths=paths)


PATHS = "paths array<struct<ends:string,cost:bigint,audit:string>>"


def _joined(blocks: DataFrame) -> DataFrame:
    """Blocks 2i and 2i + 1 of a conversation as block i: the best path for every pair of end states."""
    left, right = blocks.filter("block % 2 = 0"), blocks.filter("block % 2 = 1")
    both = left.selectExpr("conv", "block div 2 AS block", "paths").join(
        right.selectExpr("conv", "block div 2 AS block", "paths AS more"), ["conv", "block"], "left")
    best = """transform(array_distinct(transform(all, p -> p.ends)), e -> array_min(transform(filter(all, p -> p.ends = e),
              p -> struct(p.cost AS cost, p.audit AS audit, p.ends AS ends))))"""
    steps = """flatten(transform(paths, p -> transform(filter(more, m -> left(m.ends, 1) = right(p.ends, 1)),
               m -> struct(concat(left(p.ends, 1), right(m.ends, 1)) AS ends, p.cost + m.cost AS cost,
                           concat(p.audit, m.audit) AS audit))))"""
    picked = both.selectExpr("conv", "block", "paths", "more IS NULL AS _alone", f"{steps} AS all")
    return picked.selectExpr("conv", "block", f"""if(_alone, paths, transform({best}, b -> struct(b.ends AS ends,
                             b.cost AS cost, b.audit AS audit))) AS paths""")


def audits(codes: DataFrame) -> DataFrame:
    """(conv, cost, audit) from (conv, block, code): blocks numbered from 0, two letters a row."""
    solved = stored(small_batches(spread(codes.select("conv", "block", "code"), "conv", "block")).mapInPandas(
        _blocks, f"conv bigint, block bigint, {PATHS}"), "repair-blocks")
    last = solved.agg(F.max("block")).first()[0] or 0
    while last:
        solved, last = stored(_joined(solved), "repair-blocks"), last // 2
    return solved.select("conv", F.array_min(F.expr(
        "transform(filter(paths, p -> p.ends IN ('EE', 'EA')), p -> struct(p.cost AS cost, p.audit AS audit))")).alias("_best")
    ).select("conv", "_best.cost", "_best.audit")


def damage(rows: DataFrame, conv: str = "conv_id", turn: str = "turn") -> DataFrame:
    """Rows of (conv_id, turn, role, text), damaged by the checksum of ``conv_id:turn``; nulls are one space."""
    def known(name: str) -> Column:
        return F.coalesce(F.col(f"`{name}`").cast("string"), F.lit(" "))

    kind = F.crc32(F.concat(known(conv), F.lit(":"), known(turn)).cast("binary")) % 20
    text = F.when(F.col("_kind") == 1, "").when(F.col("_kind") == 2, F.regexp_replace("_text", "[.!?]", "")).otherwise(F.col("_text"))
    hurt = rows.select(F.col(f"`{conv}`").alias("conv_id"), F.col(f"`{turn}`").alias("turn"), known("role").alias("_role"),
                       known("text").alias("_text"), kind.alias("_kind")).filter("_kind <> 0")
    return hurt.select("conv_id", "turn", F.when(F.col("_kind") == 4, "user").otherwise(F.col("_role")).alias("role"),
                       text.alias("text"), F.explode(F.sequence(F.lit(1), F.when(F.col("_kind") == 3, 2).otherwise(1))).alias("_time")
                       ).drop("_time")


def _faults(rows: DataFrame) -> DataFrame:
    """(conv, turn, role, _line, at, fault) of rows with ``_same`` (digest of the text) and ``_own`` (fault without regard to
    others): the place in the conversation from 0, and d blank, c copy, t truncated or - for none."""
    number = number_rows_within(rows, ["conv"], [F.asc_nulls_first("turn"), *map(F.col, ("role", "_same", "_line"))], "_number")
    placed = stored(number.withColumn("at", F.col("_number") - 1).drop("_number"), "repair-places")
    # Few rows repeat, and one of them may be a third of all: their keys are doubled by salt instead of moving to one task.
    again = (placed.groupBy("conv", "role", "_same").agg(F.min("at").alias("_first"), F.count("*").alias("_times"))
             .filter("_times > 1").drop("_times").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))))
    found = placed.withColumn("_salt", (F.col("at") % SALTS).cast("int")).join(again, ["conv", "role", "_same", "_salt"], "left")
    fault = F.when((F.col("_own") != "d") & (F.col("at") > F.col("_first")), "c").otherwise(F.col("_own"))
    return stored(found.select("conv", "turn", "role", "_line", "at", fault.alias("fault")), "repair-faults")


def _repaired(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The digest of each conversation's repaired lines, from its rows in order with their edits; one stream per task."""
    conv, state, digest, lines = None, "E", hashlib.sha256(), 0

    def add(role: str, text: str) -> None:
        nonlocal lines
        digest.update((("\n" if lines else "") + role + ":" + text).encode())
        lines += 1

    done: list[tuple[int, str]] = []
    for batch in batches:
        for this, role, text, edits in zip(batch["conv"], batch["role"], batch["text"], batch["edits"]):
            if this != conv:
                if conv is not None:
                    done.append((conv, digest.hexdigest()))
                conv, state, digest, lines = this, "E", hashlib.sha256(), 0
            for edit in edits:
                if edit in "IR":
                    given = NEXT[state]
                    add(ROLES[given], "" if edit == "I" else text)
                    state = KEPT[state][given]
                elif edit == "K":
                    add(role, text)
                    state = KEPT[state][role[0]]
        yield pd.DataFrame(done, columns=["conv", "repaired_sha256"])
        done = []
    if conv is not None:
        yield pd.DataFrame([(conv, digest.hexdigest())], columns=["conv", "repaired_sha256"])


def _ids(wanted: DataFrame) -> DataFrame:
    """(_id, conv): the distinct ids, null too, each with a number."""
    return stored(wanted.select(F.col("conv_id").alias("_id")).distinct().withColumn("conv", F.monotonically_increasing_id()),
                  "repair-ids")


def _illegal(codes: DataFrame) -> DataFrame:
    """(conv, illegal): neighbours whose initials cannot follow each other, inside the blocks and across their borders."""
    legal = "('su', 'ua', 'au')"
    inside = f"""if(length(code) <= 2, 0, size(filter(sequence(2, length(code) div 2),
                 k -> concat(substr(code, 2 * k - 3, 1), substr(code, 2 * k - 1, 1)) NOT IN {legal})))"""
    before = codes.selectExpr("conv", "block + 1 AS block", "substr(code, -2, 1) AS _tail")
    across = f"if(_tail IS NULL OR concat(_tail, left(code, 1)) IN {legal}, 0, 1)"
    return codes.join(before, ["conv", "block"], "left").groupBy("conv").agg(F.sum(F.expr(f"{inside} + {across}")).alias("illegal"))


def repair(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """For every ``conv_id`` of ``wanted`` the faults found in ``rows`` (conv_id, turn, role, text without null role and
    text), the cost and audit of the cheapest repair, and the digest of the repaired conversation."""
    ids = _ids(wanted)
    last = F.regexp_extract("text", rf"({WORD_BYTES})[\x20\x09-\x0D]*\z", 1)
    named = stored(rows.select("conv_id", "turn", "role", "text").join(ids, F.col("conv_id").eqNullSafe(F.col("_id"))).select(
        "conv", "turn", "role", "text", F.sha2(F.col("text").cast("binary"), 256).alias("_same"),
        F.when(last == "", "d").when(~last.isin(".", "!", "?"), "t").otherwise("-").alias("_own"),
        F.monotonically_increasing_id().alias("_line")), "repair-rows")
    faults = _faults(named.drop("text"))

    initial, gone = F.substring("role", 1, 1), F.col("fault").isin("d", "c")
    code = F.concat(F.when(initial.isin("s", "u", "a"), initial).otherwise("-"), F.when(gone, "d").otherwise(F.col("fault")))
    rows_of = F.array_sort(F.collect_list(F.struct("at", code.alias("code"))))  # at most BLOCK rows
    codes = stored(faults.groupBy("conv", F.expr(f"at div {BLOCK}").alias("block")).agg(rows_of.alias("_rows")).select(
        "conv", "block", F.concat_ws("", F.transform("_rows", lambda r: r["code"])).alias("code")), "repair-codes")
    best = stored(audits(codes), "repair-audits")

    # Every row takes the insertions before it; the last row those after it, too. In two steps, as audits may be long.
    pieces = best.select("conv", F.posexplode(F.expr(rf"regexp_extract_all(audit, '(?:I*[DKR]){{1,{BLOCK}}}(?:I+$)?', 0)")
                                              ).alias("_piece", "_edits"))
    edits = pieces.select("conv", "_piece", F.posexplode(F.expr("regexp_extract_all(_edits, 'I*[DKR](?:I+$)?', 0)")).alias("_at", "edits"))
    lines = faults.select("conv", "at", "role", "_line").join(
        edits.select("conv", (F.col("_piece").cast("bigint") * BLOCK + F.col("_at")).alias("at"), "edits"), ["conv", "at"])
    texts = spread(lines.join(named.select("_line", "text"), "_line"), "conv").sortWithinPartitions("conv", "at")
    digests = small_batches(texts.select("conv", "role", "text", "edits")).mapInPandas(
        _repaired, "conv bigint, repaired_sha256 string")

    def count(kind: str) -> Column:
        return F.count_if(F.col("fault") == kind)

    turns = faults.filter("turn IS NOT NULL").select("conv", "turn").distinct().groupBy("conv").agg(
        (F.max("turn") - F.min("turn") + 1 - F.count("*")).alias("gaps"))
    counted = faults.groupBy("conv").agg(count("d").alias("blank"), count("c").alias("duplicate"), count("t").alias("truncated"))
    out = ids
    for side in (turns, counted, _illegal(codes), best, digests):
        out = out.join(side, "conv", "left")
    empty = hashlib.sha256(b"").hexdigest()
    longs = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    return out.select(F.col("_id").alias("conv_id"), *[F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias(c) for c in longs],
                      F.coalesce("audit", F.lit("")).alias("audit"),
                      F.coalesce("repaired_sha256", F.lit(empty)).alias("repaired_sha256"))


def oracle() -> str:
    """The query's rows in SQL: the cheapest edits by dynamic programming over rows and states."""
    moves, ends = [], []
    for start in STATES:
        state, prefix, lines = start, "", ""
        for _ in range(3):  # a third insertion in a row leads back to where the first one led
            role = NEXT[state]
            for i, then in KEPT[state].items():
                moves.append((start, prefix + "K", "K", i, 0, lines, "", then))
            moves.append((start, prefix + "D", "D", None, DELETE, lines, "", state))
            moves.append((start, prefix + "R", "R", None, REROLE, lines, ROLES[role], KEPT[state][role]))
            if state in "EA" and len(prefix) < 3:
                ends.append((start, prefix, INSERT * len(prefix), lines))
            prefix, lines, state = prefix + "I", lines + ROLES[role] + ":\n", KEPT[state][role]

    def values(rows) -> str:
        def text(x) -> str:
            return "NULL" if x is None else str(x) if isinstance(x, int) else "'" + x.replace("\n", "' || chr(10) || '") + "'"

        return ", ".join("(" + ", ".join(text(x) for x in row) + ")" for row in rows)

    key = "coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')"
    return f"""
WITH RECURSIVE moves AS (SELECT * FROM (VALUES {values(moves)}) t(q, edits, edit, i, price, pre, given, q2)),
ends AS (SELECT * FROM (VALUES {values(ends)}) t(q, edits, price, pre)),
convs AS (SELECT row_number() OVER () AS c, conv_id FROM (SELECT DISTINCT conv_id FROM conversations)),
marked AS (SELECT c, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {crc32_sql("ck")} % 20 AS k
           FROM (SELECT *, {key} AS ck FROM conversations) r JOIN convs ON r.conv_id IS NOT DISTINCT FROM convs.conv_id),
hurt AS (SELECT c, turn, CASE WHEN k = 4 THEN 'user' ELSE role END AS role, CASE WHEN k = 1 THEN ''
                WHEN k = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
                unnest(range(CASE WHEN k = 3 THEN 2 ELSE 1 END)) FROM marked WHERE k <> 0),
placed AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, role, sha256(text)) AS pos FROM hurt),
judged AS (SELECT c, turn, role, text, pos, left(role, 1) AS i, CASE WHEN NOT regexp_matches(text, '{WORD_BYTES}') THEN 'd'
                  WHEN row_number() OVER (PARTITION BY c, role, text ORDER BY pos) > 1 THEN 'c'
                  WHEN regexp_extract(text, '({WORD_BYTES})[\x20\x09-\x0D]*$', 1) NOT IN ('.', '!', '?') THEN 't' ELSE '-' END AS fault,
                  lag(left(role, 1)) OVER (PARTITION BY c ORDER BY pos) AS earlier FROM placed),
best AS (SELECT c, 0::BIGINT AS pos, 'E' AS q, {{'cost': 0, 'audit': '', 'lines': ''}} AS way FROM convs
         UNION ALL SELECT b.c, j.pos, m.q2, min({{'cost': b.way.cost + m.price + {INSERT} * (len(m.edits) - 1)::INT
                              + CASE WHEN m.edit <> 'D' AND j.fault = 't' THEN {TRUNCATED} ELSE 0 END,
                          'audit': b.way.audit || m.edits, 'lines': b.way.lines || m.pre || CASE m.edit WHEN 'D' THEN ''
                              WHEN 'K' THEN j.role || ':' || j.text || chr(10) ELSE m.given || ':' || j.text || chr(10) END}})
         FROM best b JOIN judged j ON j.c = b.c AND j.pos = b.pos + 1 JOIN moves m ON m.q = b.q
         WHERE (m.edit = 'D' OR j.fault NOT IN ('d', 'c')) AND (m.i IS NULL OR m.i = j.i) GROUP BY ALL),
stats AS (SELECT c, max(pos) AS n, max(turn) - min(turn) + 1 - count(DISTINCT turn) AS gaps, count(*) FILTER (fault = 'd') AS blank,
                 count(*) FILTER (fault = 'c') AS duplicate, count(*) FILTER (fault = 't') AS truncated,
                 count(*) FILTER (earlier || i NOT IN ('su', 'ua', 'au')) AS illegal FROM judged GROUP BY c),
picked AS (SELECT b.c, min({{'cost': b.way.cost + e.price, 'audit': b.way.audit || e.edits, 'lines': b.way.lines || e.pre}}) AS way
           FROM best b JOIN stats s ON b.c = s.c AND b.pos = s.n JOIN ends e ON e.q = b.q GROUP BY b.c)
SELECT conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
       coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, coalesce(way.cost, 0)::BIGINT AS cost,
       coalesce(way.audit, '') AS audit, sha256(coalesce(left(way.lines, -1), '')) AS repaired_sha256
FROM convs LEFT JOIN stats USING (c) LEFT JOIN picked USING (c)
"""
