"""Secret scans with multipart credential linking, in built-in column functions only.

Base spans come from three patterns over the whole text. A weak candidate (a short password, a token of 40 mixed
characters, the address of a service) says little alone; it is reported only where its complement lies in the same
scope: within ``REACH`` characters of it, with no blank line between. A weak secret needs an identifier or an endpoint;
an endpoint needs an identifier and a weak secret. Parts are joined by their intervals in a sweep over each text: parts and
blank lines in order of their starts, each with the furthest end of every kind before it and the nearest start after it.
That takes one sort of a text's parts, however many lie close together; nothing is shuffled.

Positions come from the gaps between matches: ``split`` and ``regexp_extract_all`` cut a text at the same places.

Defined cases: a null text is an empty one and has no spans; repeated rows come out each; an empty table gives an empty
one; ``redact`` keeps all columns whatever their names, and sets ``n_chars`` anew where there is one. A text with very many
parts or spans takes time near linear in their number.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ASSIGN = (r"""((?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]"""
          r"""|[Aa][Pp][Ii]_?[Kk][Ee][Yy]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ASSIGN_VALUE, WEAK_VALUE = 12, 6
ACCESS = r"AKIA[A-Z0-9]{14,}"
#: Runs are maximal either way, so asking for the length in the pattern finds the same ones.
HEX = r"[0-9a-f]{16,}"
IDENTIFIER = r"""(?:[Uu]ser(?:[Nn]ame|_name)?|[Ll]ogin|[Cc]lient_?[Ii][Dd]|[Aa]ccess_?[Kk]ey_?[Ii][Dd])["']?\x20*[:=]\x20*["']?[A-Za-z0-9_.@-]{3,}"""
#: A token is a whole run of TOKEN_LENGTH of these characters, with a digit, a small and a capital letter in it.
TOKEN, TOKEN_LENGTH, TOKEN_MIX = r"[A-Za-z0-9+/]{40,}", 40, ("[0-9]", "[a-z]", "[A-Z]")
ENDPOINT = r"""(?:https?|s3|ftp|postgres(?:ql)?|mysql|mongodb|redis|amqp)://[^\x20\x09-\x0D"'<>]+"""
BLANK_LINE = r"\n[\x20\t\r]*\n"
REACH = 400
KINDS = ["assign", "access", "hex", "endpoint", "secret"]
MARK = "[SECRET]"
BLOCK = 256  # items of a running total, and characters of a text, that are handled as one
#: What the sweep meets; no part holds a line break, so parts and blank lines never overlap.
SWEPT = ["blank", "id", "endpoint", "weak"]


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def scanned(values: Column, zero: Column, plus: Callable[[Column, Column], Column]) -> Column:
    """Running totals of an array under an associative ``plus``, in blocks, so that a long array is not copied once per
    element."""
    def inside(items: Column) -> Column:
        start = F.struct(zero.alias("s"), F.slice(F.array(zero), 1, 0).alias("a"))
        return F.aggregate(items, start, lambda acc, x: let(plus(acc["s"], x), lambda s: F.struct(
            s.alias("s"), F.concat(acc["a"], F.array(s)).alias("a"))), lambda acc: acc["a"])

    def joined(blocks: Column) -> Column:
        last = F.transform(blocks, lambda block: F.get(block, F.size(block) - 1))
        return let(inside(last), lambda ends: F.flatten(F.transform(blocks, lambda block, i: let(
            F.coalesce(F.get(ends, i - 1), zero), lambda before: F.transform(block, lambda x: plus(before, x))))))

    def blocks(items: Column) -> Column:
        count = F.ceil(F.size(items) / BLOCK).cast("int")
        cut = F.transform(F.sequence(F.lit(0), count - 1), lambda b: inside(F.slice(items, b * BLOCK + 1, BLOCK)))
        return F.when(F.size(items) <= BLOCK, inside(items)).otherwise(let(cut, joined))

    return let(values, blocks)  # computed once, not once per block


def running(values: Column) -> Column:
    """Running sums of an array of ints."""
    return scanned(values, F.lit(0), lambda a, b: a + b)


def none() -> Column:
    return F.expr("cast(array() as array<struct<start:int,end:int,value:int>>)")


def find(text: Column, pattern: str, group: int = 0, measure: Callable[[Column], Column] = F.char_length) -> Column:
    """Matches as (start, end, value): code points, end exclusive; value is the ``measure`` of the group."""
    def matches(which: int) -> Column:
        return F.regexp_extract_all(text, F.lit(pattern), F.lit(which))

    def placed(sizes: Column, values: Column) -> Column:
        gaps = F.transform(F.slice(F.split(text, pattern, -1), 1, F.size(sizes)), lambda g: F.char_length(g))
        return let(F.zip_with(gaps, sizes, lambda g, m: g + m), lambda steps: let(running(steps), lambda ends: F.transform(
            F.arrays_zip(ends.alias("end"), sizes.alias("size"), values.alias("value")),
            lambda m: F.struct((m["end"] - m["size"]).alias("start"), m["end"].alias("end"), m["value"].alias("value")))))

    return let(F.transform(matches(0), lambda m: F.char_length(m)), lambda sizes: placed(sizes, sizes)
               if not group and measure is F.char_length
               else let(F.transform(matches(group), lambda m: measure(m)), lambda values: placed(sizes, values)))


def _found(text: Column, pattern: str, group: int = 0, measure: Callable[[Column], Column] = F.char_length) -> Column:
    """As ``find``, looking for positions only in texts with a match."""
    return F.when(F.rlike(text, F.lit(pattern)), find(text, pattern, group, measure)).otherwise(none())


def _mixed(token: Column) -> Column:
    """The length of a token, 0 if it is not one."""
    good = reduce(lambda a, b: a & b, [F.rlike(token, F.lit(c)) for c in TOKEN_MIX])
    return F.when((F.char_length(token) == TOKEN_LENGTH) & good, TOKEN_LENGTH).otherwise(0)


def _furthest(parts: Column, place: Callable[[Column], Column]) -> Column:
    """For each part, itself included, the furthest place of every kind so far."""
    zero = F.struct(*[F.lit(None).cast("int").alias(k) for k in SWEPT])
    each = F.transform(parts, lambda p: F.struct(*[F.when(p["kind"] == i, place(p)).alias(k) for i, k in enumerate(SWEPT)]))
    return scanned(each, zero, lambda a, b: F.struct(*[F.greatest(a[k], b[k]).alias(k) for k in SWEPT]))


def _near(part: Column, kind: str) -> Column:
    """Whether a part of ``kind`` lies within reach of the swept ``part``, with no blank line between.

    Of the parts that start earlier, the one with the furthest end decides; of the later ones, the one that starts first.
    ``after`` holds negative starts.
    """
    before, after = part["before"], part["after"]
    earlier = (before[kind] > F.coalesce(before["blank"], F.lit(-1))) & (part["start"] - before[kind] <= REACH)
    later = (after[kind] > F.coalesce(after["blank"], after[kind] - 1)) & (-after[kind] - part["end"] <= REACH)
    return F.coalesce(earlier, F.lit(False)) | F.coalesce(later, F.lit(False))


def _tagged(spans: Column, kind: str) -> Column:
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(KINDS.index(kind)).alias("kind"),
                                                 s["end"].alias("end")))


def _scanned(docs: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """``keep`` with ``_base`` and ``_spans``: arrays of (start, kind, end) in order."""
    # Every column of a step is used more than once by the next, so the optimizer keeps the steps apart.
    body = F.coalesce(F.col(text), F.lit(""))
    s0 = docs.select(*keep, body.alias("_text"))
    s1 = s0.select(*keep, "_text", _found(F.col("_text"), ASSIGN, 2).alias("_assigned"),
                   _found(F.col("_text"), ACCESS).alias("_access"), _found(F.col("_text"), HEX).alias("_hex"),
                   _found(F.col("_text"), ENDPOINT).alias("_endpoint"),
                   _found(F.col("_text"), TOKEN, measure=_mixed).alias("_token"))
    s2 = s1.withColumn("_weak", F.concat(F.filter("_assigned", lambda m: m["value"].between(WEAK_VALUE, ASSIGN_VALUE - 1)),
                                         F.filter("_token", lambda m: m["value"] == TOKEN_LENGTH)))
    some = F.size("_weak") > 0

    def parts(spans: Column, kind: str) -> Column:
        return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(SWEPT.index(kind)).alias("kind"),
                                                     s["end"].alias("end")))

    s3 = s2.withColumn("_parts", F.when(some, F.array_sort(F.concat(
        parts(find(F.col("_text"), BLANK_LINE), "blank"), parts(F.col("_access"), "id"),
        parts(_found(F.col("_text"), IDENTIFIER), "id"), parts(F.col("_endpoint"), "endpoint"),
        parts(F.col("_weak"), "weak")))))
    after = F.reverse(_furthest(F.reverse("_parts"), lambda p: -p["start"]))
    s4 = s3.withColumn("_swept", F.when(some, F.transform(
        F.arrays_zip(F.col("_parts").alias("part"), _furthest(F.col("_parts"), lambda p: p["end"]).alias("before"),
                     after.alias("after")),
        lambda z: F.struct(z["part"]["start"].alias("start"), z["part"]["end"].alias("end"), z["part"]["kind"].alias("kind"),
                           z["before"].alias("before"), z["after"].alias("after")))))

    def linked(kind: str, test: Callable[[Column], Column]) -> Column:
        return F.when(some, F.filter("_swept", lambda p: (p["kind"] == SWEPT.index(kind)) & test(p)))

    s5 = (s4.withColumn("_secret", linked("weak", lambda p: _near(p, "id") | _near(p, "endpoint")))
          .withColumn("_linked", linked("endpoint", lambda p: _near(p, "id") & _near(p, "weak"))))
    strong = F.filter("_assigned", lambda m: m["value"] >= ASSIGN_VALUE)
    base = F.array_sort(F.concat(_tagged(strong, "assign"), _tagged(F.col("_access"), "access"),
                                 _tagged(F.col("_hex"), "hex")))
    s6 = s5.select(*keep, "_text", base.alias("_base"), F.concat(
        _tagged(F.col("_linked"), "endpoint"), _tagged(F.col("_secret"), "secret")).alias("_more"))
    return s6.select(*keep, "_text", "_base", F.when(F.size("_more") > 0, F.array_sort(F.concat("_base", "_more")))
                     .otherwise(F.col("_base")).alias("_spans"))


def _listed(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(
        ":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))))


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id``, counts per base kind, ``base`` and ``spans`` (kind:start:end, joined by commas)."""
    def count(kind: str) -> Column:
        return F.size(F.filter("_base", lambda s: s["kind"] == KINDS.index(kind))).cast("long").alias(f"n_{kind}")

    return _scanned(docs, text, [doc_id]).select(
        doc_id, count("assign"), count("access"), count("hex"), _listed(F.col("_base")).alias("base"),
        _listed(F.col("_spans")).alias("spans"))


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """The documents with every span, overlapping ones together, replaced by ``MARK``."""
    def piece(blocks: Column, at: Column, end: Column) -> Column:
        """Characters at..end, taken from the blocks they lie in."""
        def part(block: Column) -> Column:
            skipped = F.greatest(at - block * BLOCK, F.lit(0))
            return F.substring(F.get(blocks, block), skipped + 1, F.least(end - block * BLOCK, F.lit(BLOCK)) - skipped)

        across = F.sequence(F.floor(at / BLOCK).cast("int"), F.floor((end - 1) / BLOCK).cast("int"))
        return F.when(end > at, F.array_join(F.transform(across, part), "")).otherwise("")

    rest = F.struct("*").alias("_row")
    rows = _scanned(docs.select(rest, F.col(text).alias("_body")), "_body", ["_row"])
    ends = scanned(F.transform("_spans", lambda s: s["end"]), F.lit(0), F.greatest)
    opened = let(ends, lambda known: F.filter(F.transform("_spans", lambda s, i: F.struct(
        F.coalesce(F.get(known, i - 1), F.lit(0)).alias("at"), s["start"].alias("end"))), lambda p: p["end"] >= p["at"]))
    hit = F.size("_spans") > 0
    last = F.struct(F.array_max(F.transform("_spans", lambda s: s["end"])).alias("at"), F.char_length("_text").alias("end"))
    left = F.concat(opened, F.array(last))
    cut = F.regexp_extract_all("_text", F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0))
    clean = let(cut, lambda blocks: F.array_join(F.transform(left, lambda p: piece(blocks, p["at"], p["end"])), MARK))
    rows = rows.withColumn("_clean", F.when(hit, clean).otherwise(F.col(f"_row.`{text}`")))
    kinds = dict(docs.dtypes)
    return rows.select(*[
        F.col("_clean").alias(text) if c == text
        else F.when(hit, F.char_length("_clean").cast(kinds[c])).otherwise(F.col(f"_row.`{c}`")).alias(c)
        if c == "n_chars" else F.col(f"_row.`{c}`").alias(c) for c in docs.columns])


def oracle() -> str:
    """The query's rows in SQL."""
    patterns = {"assign": ASSIGN, "access": ACCESS, "hex": HEX, "endpoint": ENDPOINT, "token": TOKEN, "id": IDENTIFIER,
                "blank": BLANK_LINE}

    def places(kind: str) -> str:
        pattern = patterns[kind].replace("'", "''")
        value = f"regexp_extract_all(text, '{pattern}', 2)" if kind == "assign" else "found"
        return f"""
{kind}_ AS (SELECT r, found, value, (sum(length(gap) + length(found)) OVER (PARTITION BY r ORDER BY i))::BIGINT AS e,
                   e - length(found) AS s
            FROM (SELECT r, unnest(found) AS found, unnest({value}) AS value, generate_subscripts(found, 1) AS i,
                         unnest(string_split_regex(text, '{pattern}')[:len(found)]) AS gap
                  FROM (SELECT r, text, regexp_extract_all(text, '{pattern}') AS found FROM d) WHERE len(found) > 0))"""

    def near(a: str, b: str) -> str:
        first, last = f"least({a}.e, {b}.e)", f"greatest({a}.s, {b}.s)"
        return (f"{a}.r = {b}.r AND {last} - {first} <= {REACH} AND NOT EXISTS (SELECT 1 FROM blank_ x WHERE x.r = {a}.r"
                f" AND x.s >= {first} AND x.e <= {last})")

    mix = " AND ".join(f"regexp_matches(found, '{c}')" for c in TOKEN_MIX)
    listed = "coalesce(string_agg(name || ':' || s || ':' || e, ',' ORDER BY s, k, e) {}, '')"
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
{",".join(places(k) for k in patterns)},
weak AS (SELECT r, s, e FROM assign_ WHERE length(value) BETWEEN {WEAK_VALUE} AND {ASSIGN_VALUE - 1}
         UNION ALL SELECT r, s, e FROM token_ WHERE length(found) = {TOKEN_LENGTH} AND {mix}),
ids AS (SELECT r, s, e FROM access_ UNION ALL SELECT r, s, e FROM id_),
spans AS (SELECT r, s, e, 'assign' AS name, 0 AS k FROM assign_ WHERE length(value) >= {ASSIGN_VALUE}
          UNION ALL SELECT r, s, e, 'access', 1 FROM access_ UNION ALL SELECT r, s, e, 'hex', 2 FROM hex_
          UNION ALL SELECT r, s, e, 'endpoint', 3 FROM endpoint_ p WHERE EXISTS (SELECT 1 FROM ids i WHERE {near("p", "i")})
                    AND EXISTS (SELECT 1 FROM weak w WHERE {near("p", "w")})
          UNION ALL SELECT r, s, e, 'secret', 4 FROM weak w WHERE EXISTS (SELECT 1 FROM ids i WHERE {near("w", "i")})
                    OR EXISTS (SELECT 1 FROM endpoint_ p WHERE {near("w", "p")}))
SELECT any_value(doc_id) AS doc_id, count(*) FILTER (k = 0) AS n_assign, count(*) FILTER (k = 1) AS n_access,
       count(*) FILTER (k = 2) AS n_hex, sha256({listed.format("FILTER (k < 3)")}) AS base_sha256, {listed.format("")} AS spans
FROM d LEFT JOIN spans USING (r) GROUP BY r
"""
