"""Conversation repair against an exhaustive search, and its query against SQL on odd rows."""

import hashlib
import heapq
import random
import time

import pytest
from pyspark.sql import functions as F

from compare import connect, difference
from tillmart.llm import conversation_repair as cr
from tillmart.llm import queries

NAME = "op13_conversation_repair"


def exhaustive(code, start, goals):
    """(cost, audit) of the cheapest edits, the ASCII-least among them: uniform-cost search over every edit sequence."""
    rows = [(code[i], code[i + 1]) for i in range(0, len(code), 2)]
    heap, seen = [(0, "", 0, start)], set()
    while heap:
        cost, audit, i, state = heapq.heappop(heap)
        if i == len(rows) and state in goals:
            return cost, audit
        if (i, state) in seen or len(audit) > 4 * len(rows) + 4:
            continue
        seen.add((i, state))
        following = {"E": "su", "S": "u", "U": "a", "A": "u"}[state]
        after = {"s": "S", "u": "U", "a": "A"}
        for role in following.replace("s", ""):
            heapq.heappush(heap, (cost + 3, audit + "I", i, after[role]))
        if i < len(rows):
            initial, fault = rows[i]
            late = 3 if fault == "t" else 0
            heapq.heappush(heap, (cost + 4, audit + "D", i + 1, state))
            if fault != "d":
                if initial in following:
                    heapq.heappush(heap, (cost + late, audit + "K", i + 1, after[initial]))
                for role in following.replace("s", ""):
                    heapq.heappush(heap, (cost + late + 3, audit + "R", i + 1, after[role]))
    return None


def random_code(rng, n):
    return "".join(rng.choice("suuuaaa-") + rng.choice("-----dt") for _ in range(n))


def test_search_equals_exhaustive_search():
    rng = random.Random(1)
    for n in [0, 1, 1, 2, 2, 3, 3, 4, 5, 6, 7, 8, 9, 12, 20] * 12:
        code = random_code(rng, n)
        for start in cr.STATES:
            for goal in cr.STATES:
                assert cr.Search(code).cheapest(start, goal) == exhaustive(code, start, goal), (code, start, goal)


def test_lower_bound_never_exceeds_the_cost():
    rng = random.Random(5)
    for _ in range(300):
        code = random_code(rng, rng.randrange(1, 9))
        floor = cr.Search(code).floor[0]
        assert all(found is None or floor <= found[0]
                   for start in cr.STATES for goal in cr.STATES for found in [exhaustive(code, start, goal)])


@pytest.mark.parametrize("code", ["u-" * 400, "a-" * 400, "s-" * 400, "--" * 400, "ut" * 400, "ud" * 400, "u-at" * 200])
def test_one_sided_blocks_take_little_time(code):
    start = time.time()
    for begin in cr.STATES:
        for goal in cr.STATES:
            cr.Search(code[:2 * cr.BLOCK]).cheapest(begin, goal)
    assert time.time() - start < 20


def test_blocks_join_to_the_whole_answer(spark):
    rng = random.Random(2)
    codes = {i: random_code(rng, rng.randrange(1, 60)) for i in range(40)}
    rows = [(i, b // 10, code[b:b + 10]) for i, code in codes.items() for b in range(0, len(code), 10)]
    found = {r["conv"]: (r["cost"], r["audit"]) for r in cr.audits(
        spark.createDataFrame(rows, "conv long, block long, code string")).collect()}
    assert found == {i: exhaustive(code, "E", "EA") for i, code in codes.items()}


def plain(rows):
    """The report of one conversation: rows (turn, role, text) as they stand."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).hexdigest()))
    seen, faults = set(), []
    for _, role, text in rows:
        solid = text.strip(" \t\n\x0b\x0c\r")
        faults.append("d" if not solid else "c" if (role, text) in seen else "t" if solid[-1] not in ".!?" else "-")
        seen.add((role, text))
    code = "".join((r[1][:1] if r[1][:1] in ("s", "u", "a") else "-") + ("d" if f in "dc" else f) for r, f in zip(rows, faults))
    cost, audit = exhaustive(code, "E", "EA")
    lines, state, i = [], "E", 0
    for edit in audit:
        given = "a" if state == "U" else "u"
        if edit in "IR":
            lines.append({"u": "user", "a": "assistant"}[given] + ":" + ("" if edit == "I" else rows[i][2]))
        if edit == "K":
            lines.append(rows[i][1] + ":" + rows[i][2])
            given = rows[i][1][0]
        if edit != "D":
            state = given.upper()
        i += edit != "I"
    turns = [r[0] for r in rows if r[0] is not None]
    legal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    return (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, faults.count("d"), faults.count("c"), faults.count("t"),
            legal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())


COLUMNS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


@pytest.mark.parametrize("block", [4, 128])
def test_repair_equals_a_plain_version(spark, monkeypatch, block):
    monkeypatch.setattr(cr, "BLOCK", block)
    rng = random.Random(block)
    texts = ["Yes.", "No", "", " \n", "Why?", "é!", "One.\n", "two. three", "x" * 3000 + "."]
    rows = [(rng.choice([None, 1, 1, 1, *range(2, 30)]), rng.choice([None, *range(12)]),
             rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", "usher"]), rng.choice(texts) + rng.choice(["", f"{i}."]))
            for i in range(600)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)
    wanted = df.select("conv_id").union(spark.createDataFrame([(77,)], "conv_id long"))
    for clash in ("conv", "at", "fault", "_line", "_same", "block"):
        df = df.withColumn(clash, F.lit("clash"))
    groups = {77: []}
    for conv, *row in rows:
        groups.setdefault(conv, []).append(tuple(row))
    found = {r["conv_id"]: tuple(r[c] for c in COLUMNS) for r in cr.repair(df, wanted).collect()}
    assert found == {conv: plain(rows) for conv, rows in groups.items()}
    assert found[77] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


def test_a_long_conversation_is_searched_in_blocks(spark):
    """A third of all rows in one conversation, another third in the one without an id."""
    rows = spark.range(9000).selectExpr(
        "CASE WHEN id % 3 = 0 THEN 5 WHEN id % 3 = 1 THEN NULL ELSE id END AS conv_id", "id AS turn",
        "CASE WHEN id % 7 = 0 THEN 'assistant' ELSE 'user' END AS role", "concat('text ', id, if(id % 5 = 0, '', '.')) AS text")
    found = {r["conv_id"]: r for r in cr.repair(rows, rows).collect()}
    assert len(found) == 3001
    given = [r for r in rows.collect() if r["conv_id"] == 5]
    assert tuple(found[5][c] for c in COLUMNS) == plain([(r["turn"], r["role"], r["text"]) for r in given])


def test_query_on_odd_rows_and_none(spark, tmp_path):
    rows = [(None, None, None, None), (None, 1, "user", "a."), (1, None, "user", None), (1, 0, None, "b!"), (1, 1, "assistant", "c"),
            (1, 1, "assistant", "c"), (2, 5, "system", "s."), (2, -3, "", "x?"), (3, 2 ** 40, "user", " ."), (4, 0, "user", "é?")]
    rows += [(i, j, ["user", "assistant"][j % 2], f"{i} {j}.") for i in range(10, 60) for j in range(i % 6)]
    schema = "conv_id long, turn long, role string, text string"
    for name, given in (("some", rows), ("none", rows[:0])):
        folder = tmp_path / name
        folder.mkdir()
        import duckdb

        con = duckdb.connect()
        con.execute("CREATE TABLE t (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
        if given:
            con.executemany("INSERT INTO t VALUES (?, ?, ?, ?)", given)
        con.execute(f"COPY t TO '{folder}/conversations.parquet' (FORMAT parquet)")
        assert spark.read.parquet(f"{folder}/conversations.parquet").schema == spark.createDataFrame([], schema).schema
        assert difference(queries.QUERIES[NAME](spark, str(folder)), connect(str(folder)), queries.ORACLES[NAME]) is None
