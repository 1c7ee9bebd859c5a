"""Personal data, and the terms that give it away, in built-in functions only.

Base spans are email addresses, IP addresses, card and phone numbers. What remains can still tell whose they were, so the
corpus is asked how much: a term that keeps standing next to one address says nearly as much as the address. Each distinct
value found is a protected entity, and its context the terms within ``REACH`` characters of it, up to the next value.
With n(t) the occurrences of a term t in all texts, n(t, s) those in contexts of the entity s, n(s) all terms in contexts of
s and N all terms:

- ``bits left`` of s once t is known: -log2(n(t, s) / n(t)), the uncertainty that remains of the information content of s;
- ``bits gained``: log2(n(t, s) N / (n(t) n(s))), the pointwise mutual information.

A term with n(t, s) of at least ``SUPPORT`` discloses s if fewer than ``LEFT`` bits are left and at least ``GAINED`` are
gained. It is generalised to its class (the first ``STEM`` characters of a word, the number of digits of a number) unless
the class discloses s too; then it is removed. Both become spans where the term stands in a context of s.

Contexts hold a bounded number of terms, so everything grows with the texts. Counts are summed before they move; counts
of terms in contexts meet the corpus counts salted by ``SALTS``, so neither a term near every value nor a value in every
text fills one task. Spans of one text, which may have many, are put in order within that text.

Defined cases: a null text is an empty one; a text without base spans has no spans. Values overlapping others are entities
of their own; characters that touch a value, or the edge of its context, belong to no term. Rows may repeat: each counts and
comes out. An empty table gives an empty one. ``sanitise`` keeps all columns whatever their names, and sets ``n_chars``
anew where there is one.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .secret_scan import let, running
from .storage import stored

# No match can begin inside a run of the first class unless the one before it ended there, which saves trying.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
BYTE = r"0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
KINDS = ["email", "ip", "card", "phone", "generalised", "removed"]
BASE, GENERAL, GONE = KINDS[:4], KINDS.index("generalised"), KINDS.index("removed")
CARD_DIGITS, PHONE_DIGITS = (13, 19), (9, 15)

TERM_CHARS = r"0-9A-Za-z\x{80}-\x{10FFFF}"
GAP = rf"[^{TERM_CHARS}]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
REACH, STEM, SUPPORT, LEFT, GAINED = 60, 2, 2, 3, 6
SALTS = 16
#: Texts are cut into pieces of this many characters, so that a place far into a text is found without reading up to it.
PIECE = 2048

SPANS = "array<struct<kind:int,start:int,end:int,value:string>>"


def _none(kind: str) -> Column:
    return F.expr(f"cast(array() as {kind})")


def _located(text: Column, pattern: str, kind: int, passes) -> Column:
    """Matches that pass, as (kind, start, end, value); code points, end exclusive."""
    def placed(found: Column) -> Column:
        before = F.transform(F.slice(F.split(text, pattern, -1), 1, F.size(found)), lambda g: F.char_length(g))
        steps = F.zip_with(before, found, lambda g, m: g + F.char_length(m))
        return let(running(steps), lambda ends: F.filter(F.transform(
            F.arrays_zip(ends.alias("end"), found.alias("value")), lambda m: F.struct(
                F.lit(kind).alias("kind"), (m["end"] - F.char_length(m["value"])).alias("start"), m["end"].alias("end"),
                m["value"].alias("value"))), lambda m: passes(m["value"])))

    return F.when(F.rlike(text, F.lit(pattern)), let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), placed)).otherwise(
        _none(SPANS))


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _as_value(span: Column) -> Column:
    """The entity that a span shows: small letters of an address, digits of a number."""
    return F.when(span["kind"] >= 2, _digits(span["value"])).otherwise(F.translate(span["value"], UPPER, LOWER))


def _base(text: Column) -> list[Column]:
    def card(value: Column) -> Column:
        digits = _digits(value)
        return F.char_length(digits).between(*CARD_DIGITS) & F.call_function("luhn_check", digits)

    return [_located(text, EMAIL, 0, lambda v: F.lit(True)),
            _located(text, IP, 1, lambda v: F.rlike(v, F.lit(rf"^{BYTE}\.{BYTE}\.{BYTE}\.{BYTE}$"))),
            _located(text, CARD, 2, card),
            _located(text, PHONE, 3, lambda v: F.char_length(_digits(v)).between(*PHONE_DIGITS))]


def _running_max(values: Column) -> Column:
    """The greatest value so far, in blocks, so that a long array is not copied once per element."""
    def fold(items: Column) -> Column:
        return F.aggregate(items, F.expr("cast(array() as array<int>)"), lambda acc, x: F.concat(
            acc, F.array(F.greatest(x, F.coalesce(F.get(acc, F.size(acc) - 1), x)))))

    block = 256
    cut = F.transform(F.sequence(F.lit(0), F.ceil(F.size(values) / block).cast("int") - 1),
                      lambda b: fold(F.slice(values, b * block + 1, block)))
    return let(cut, lambda blocks: let(fold(F.transform(blocks, lambda b: F.array_max(b))), lambda tops: F.flatten(
        F.transform(blocks, lambda b, i: F.transform(b, lambda x: F.greatest(x, F.coalesce(F.get(tops, i - 1), x)))))))


def _piece(start: Column, end: Column) -> Column:
    """``_text[start:end]`` by way of ``_pieces``."""
    first = F.floor(start / PIECE).cast("int")
    some = F.concat_ws("", F.slice("_pieces", first + 1, F.floor(end / PIECE).cast("int") - first + 1))
    return F.when(end > start, F.substring(some, start - first * PIECE + 1, end - start)).otherwise("")


def _terms(start: Column, end: Column, at_start: Column, at_end: Column) -> Column:
    """The terms wholly inside ``_text[start:end]``, as (term, start, end): one that touches an edge may go on beyond it,
    except at the ends of the text."""
    def placed(body: Column) -> Column:
        def listed(words: Column) -> Column:
            gaps = F.transform(F.regexp_extract_all(body, F.lit(GAP), F.lit(0)), lambda g: F.char_length(g))
            # words and gaps take turns, and a word comes first and last
            sizes = F.zip_with(words, gaps, lambda w, g: F.char_length(w) + F.coalesce(g, F.lit(0)))
            return let(running(sizes), lambda ends: F.filter(F.transform(words, lambda w, i: F.struct(
                F.translate(w, UPPER, LOWER).alias("term"),
                (start - at_start.cast("int") + F.coalesce(F.get(ends, i - 1), F.lit(0))).alias("start"),
                F.char_length(w).alias("size"), ((i > 0) & (i < F.size(words) - 1)).alias("whole"))),
                lambda t: t["whole"]))

        return let(F.split(body, GAP, -1), listed)

    # A blank in front of the text's first character, or behind its last, makes the word there a whole one.
    body = F.concat(F.when(at_start, " ").otherwise(""), _piece(start, end), F.when(at_end, " ").otherwise(""))
    return let(body, placed)


def _contexts() -> Column:
    """For every base span of ``_base`` (ordered by start, kind): (kind, value, terms of its context)."""
    spans = F.col("_base")

    def context(span: Column, i: Column) -> Column:
        before, following = F.coalesce(F.get("_reached", i - 1), F.lit(0)), F.get(spans, i + 1)
        last, shown = F.get("_reached", i), _as_value(span)
        earlier = F.get(spans, i - 1)

        def alike(other: Column) -> Column:
            return other.isNotNull() & (other["kind"] == span["kind"]) & (_as_value(other) == shown)

        # Between two mentions of one entity each has its half, so no term counts twice.
        low = F.greatest(F.when(alike(earlier), F.floor((before + span["start"]) / 2).cast("int")).otherwise(before), span["start"] - REACH)
        edge = F.coalesce(following["start"], F.col("_length"))
        high = F.least(F.when(alike(following), F.floor((span["end"] + edge) / 2).cast("int")).otherwise(edge), span["end"] + REACH)
        left = F.when(span["start"] > before, _terms(low, span["start"], low == 0, F.lit(False)))
        right = F.when((span["end"] == last) & (high > span["end"]),
                       _terms(span["end"], high, F.lit(False), high == F.col("_length")))
        none = _none("array<struct<term:string,start:int,size:int,whole:boolean>>")
        return F.struct(span["kind"].alias("kind"), shown.alias("value"),
                        F.concat(F.coalesce(left, none), F.coalesce(right, none)).alias("terms"))

    return F.transform(spans, context)


def _scanned(docs: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """``keep`` with ``_spans`` (kind, start, end; by kind, then start), ``_contexts`` and ``_row``, stored."""
    s0 = docs.select(*keep, F.coalesce(F.col(text), F.lit("")).alias("_text"))
    # Every column of a step is used more than once by the next, so the optimizer keeps the steps apart.
    s1 = s0.select(*keep, "_text", *[c.alias(f"_{kind}") for kind, c in zip(BASE, _base(F.col("_text")))])
    found = F.array_sort(F.transform(F.concat(*[f"_{kind}" for kind in BASE]), lambda s: F.struct(
        s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"), s["value"].alias("value"))))
    s2 = s1.select(*keep, "_text", found.alias("_base"))
    some = F.size("_base") > 0
    s3 = s2.select(*keep, "_base", F.char_length("_text").alias("_length"),
                   F.when(some, _running_max(F.transform("_base", lambda s: s["end"]))).alias("_reached"),
                   F.when(some, F.regexp_extract_all("_text", F.lit(rf"(?s).{{1,{PIECE}}}"), F.lit(0))).alias("_pieces"))
    plain = F.array_sort(F.transform("_base", lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"))))
    s4 = s3.select(*keep, plain.alias("_spans"), F.when(some, _contexts()).alias("_contexts"),
                   F.monotonically_increasing_id().alias("_row"))
    return stored(s4, "pii-spans")


def _class(term: Column) -> Column:
    """What a term is generalised to: the number of its digits, or its first characters."""
    return F.when(F.rlike(term, F.lit("^[0-9]+$")), F.concat(F.lit("#"), F.char_length(term).cast("string"))).otherwise(
        F.substring(term, 1, STEM))


def _discloses(joint: str, term: str, entity: str = "n_entity", total: str = "n_all") -> Column:
    """Fewer than LEFT bits left, at least GAINED gained; products of counts instead of logarithms, so that it is exact."""
    j, t, s, n = (F.col(c).cast("double") for c in (joint, term, entity, total))
    return (j * (1 << LEFT) > t) & (j * n >= t * s * (1 << GAINED))


def corpus_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """(term, n_term) over all texts, stored, as they are read several times."""
    words = F.split(F.translate(F.coalesce(F.col(text), F.lit("")), UPPER, LOWER), GAP, -1)
    return stored(docs.select(F.explode(words).alias("term")).filter("term <> ''").groupBy("term").agg(
        F.count("*").alias("n_term")), "pii-counts")


def disclosures(mentions: DataFrame, counts: DataFrame) -> DataFrame:
    """(kind, value, term, action, bits_left, bits_gained) of terms that disclose an entity. ``mentions`` holds one row
    (kind, value, term) per term in a context, ``counts`` the terms of the corpus."""
    joint = stored(mentions.groupBy("kind", "value", "term").agg(F.count("*").alias("n_joint")).withColumn("_class", _class(F.col("term"))),
                   "pii-joint")
    entities = joint.groupBy("kind", "value").agg(F.sum("n_joint").alias("n_entity"))
    n_all = F.lit(counts.agg(F.coalesce(F.sum("n_term"), F.lit(0))).first()[0])
    often = joint.filter(F.col("n_joint") >= SUPPORT)
    # One row per term on either side, then a copy per salt, which a term near many entities is spread by.
    salted = counts.join(often.select("term").distinct(), "term").withColumn(
        "_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    spread = often.withColumn("_salt", F.pmod(F.xxhash64("kind", "value"), F.lit(SALTS)).cast("int"))
    open_ = spread.join(salted, ["term", "_salt"]).drop("_salt").filter(F.col("n_joint") * (1 << LEFT) > F.col("n_term"))
    told = stored(open_.join(entities, ["kind", "value"]).withColumn("n_all", n_all).filter(_discloses("n_joint", "n_term")),
                  "pii-told")
    classes = told.select("_class").distinct()
    n_class = counts.groupBy(_class(F.col("term")).alias("_class")).agg(F.sum("n_term").alias("n_class")).join(classes, "_class")
    near = told.select("kind", "value", "_class").distinct()
    n_near = joint.groupBy("kind", "value", "_class").agg(F.sum("n_joint").alias("n_near")).join(near, ["kind", "value", "_class"])
    judged = told.join(n_near, ["kind", "value", "_class"]).join(n_class, "_class")
    return judged.select(
        "kind", "value", "term", F.when(_discloses("n_near", "n_class"), GONE).otherwise(GENERAL).alias("action"),
        (-F.log2(F.col("n_joint") / F.col("n_term"))).alias("bits_left"),
        F.log2(F.col("n_joint") * F.col("n_all") / F.col("n_term") / F.col("n_entity")).alias("bits_gained"))


def _with_terms(rows: DataFrame, counts: DataFrame) -> DataFrame:
    """``rows`` with the spans of disclosing terms put to ``_spans``."""
    mentions = rows.filter("_contexts IS NOT NULL").select("_row", F.explode("_contexts").alias("c")).select(
        "_row", "c.kind", "c.value", F.explode("c.terms").alias("t")).select("_row", "kind", "value", "t.term", "t.start", "t.size")
    told = disclosures(mentions, counts).select("kind", "value", "term", "action").withColumn(
        "_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    hits = mentions.withColumn("_salt", F.pmod("_row", F.lit(SALTS)).cast("int")).join(told, ["kind", "value", "term", "_salt"])
    # The spans of one text; a term near two entities that it discloses is one span, and goes if either asks for it.
    added = hits.groupBy("_row", "start", "size").agg(F.max("action").alias("kind")).groupBy("_row").agg(F.collect_list(
        F.struct("kind", "start", (F.col("start") + F.col("size")).alias("end"))).alias("_added"))
    marked = rows.filter("_contexts IS NOT NULL").join(added, "_row", "left").withColumn(
        "_spans", F.when(F.col("_added").isNull(), F.col("_spans")).otherwise(F.array_sort(F.concat("_spans", "_added")))).drop("_added")
    return marked.unionByName(rows.filter("_contexts IS NULL")).drop("_contexts")


def _listed(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(
        ":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))))


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id``, counts per base kind, ``base`` and ``spans`` (kind:start:end, joined by commas)."""
    key, body = F.col(f"`{doc_id}`").alias("_id"), F.col(f"`{text}`").alias("_body")
    rows = _with_terms(_scanned(docs.select(key, body), "_body", ["_id"]), corpus_counts(docs, f"`{text}`"))

    def count(kind: str) -> Column:
        return F.size(F.filter("_spans", lambda s: s["kind"] == KINDS.index(kind))).cast("long").alias(f"n_{kind}")

    return rows.select(F.col("_id").alias(doc_id), *[count(kind) for kind in BASE],
                       _listed(F.filter("_spans", lambda s: s["kind"] < len(BASE))).alias("base"), _listed(F.col("_spans")).alias("spans"))


def sanitise(docs: DataFrame, text: str = "text") -> DataFrame:
    """The documents with base spans, overlapping ones together, replaced by their kind in capitals, disclosing terms by
    their class, or by nothing."""
    whole = docs.select(F.struct("*").alias("_doc"), F.col(f"`{text}`").alias("_body"))
    rows = _with_terms(_scanned(whole, "_body", ["_doc"]), corpus_counts(docs, f"`{text}`"))
    kinds = dict(docs.dtypes)
    s0 = rows.withColumn("_text", F.coalesce(F.col(f"_doc.`{text}`"), F.lit(""))).withColumn("_some", F.size("_spans") > 0)
    ordered = F.array_sort(F.transform("_spans", lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"))))
    s1 = s0.select("_doc", "_text", "_some", F.when(F.col("_some"), ordered).alias("_o"), F.char_length("_text").alias("_length"),
                   F.when(F.col("_some"), F.regexp_extract_all("_text", F.lit(rf"(?s).{{1,{PIECE}}}"), F.lit(0))).alias("_pieces"))
    s2 = s1.withColumn("_reached", F.when(F.col("_some"), _running_max(F.transform("_o", lambda s: s["end"]))))
    marks = F.array(*[F.lit(f"[{k.upper()}]") for k in BASE])

    def written(span: Column, i: Column) -> Column:
        before = F.coalesce(F.get("_reached", i - 1), F.lit(0))
        shown = F.translate(_piece(span["start"], span["end"]), UPPER, LOWER)
        mark = F.when(span["kind"] == GONE, "").when(span["kind"] == GENERAL, F.concat(_class(shown), F.lit("*"))).otherwise(
            F.get(marks, span["kind"]))
        return F.when(span["start"] >= before, F.concat(_piece(before, span["start"]), mark)).otherwise("")

    tail = _piece(F.array_max("_reached"), F.col("_length"))
    s3 = s2.withColumn("_clean", F.when(F.col("_some"), F.concat(F.concat_ws("", F.transform("_o", written)), tail)).otherwise(
        F.col(f"_doc.`{text}`")))
    return s3.select(*[
        F.col("_clean").alias(c) if c == text
        else F.when(F.col("_some"), F.char_length("_clean").cast(kinds[c])).otherwise(F.col(f"_doc.`{c}`")).alias(c) if c == "n_chars"
        else F.col(f"_doc.`{c}`").alias(c) for c in docs.columns])


def oracle() -> str:
    """The query's rows in SQL."""
    # The same matches without look-behind, which only saves trying.
    patterns = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+",
                "card": r"[0-9](?:[\x20-]?[0-9])+", "phone": PHONE}
    digits = "regexp_replace(found, '[^0-9]', '', 'g')"
    luhn = f"""list_sum(list_transform(range(len({digits})), lambda i: list_sum(list_transform(string_split((substr(
        reverse({digits}), (i + 1)::INT, 1)::INT * (1 + i % 2))::VARCHAR, ''), lambda x: x::INT)))) % 10 = 0"""
    passes = {"email": "true", "ip": rf"regexp_full_match(found, '{BYTE}\.{BYTE}\.{BYTE}\.{BYTE}')",
              "card": f"len({digits}) BETWEEN {CARD_DIGITS[0]} AND {CARD_DIGITS[1]} AND {luhn}",
              "phone": f"len({digits}) BETWEEN {PHONE_DIGITS[0]} AND {PHONE_DIGITS[1]}"}

    def places(k: int, kind: str) -> str:
        pattern = patterns[kind]
        entity = digits if k >= 2 else f"translate(found, '{UPPER}', '{LOWER}')"
        return f"""
{kind}_ AS (SELECT r, {k} AS k, e - length(found) AS s, e, {entity} AS entity FROM (
    SELECT r, found, (sum(length(gap) + length(found)) OVER (PARTITION BY r ORDER BY i))::BIGINT AS e
    FROM (SELECT r, unnest(found) AS found, generate_subscripts(found, 1) AS i,
                 unnest(string_split_regex(text, '{pattern}')[:len(found)]) AS gap
          FROM (SELECT r, text, regexp_extract_all(text, '{pattern}') AS found FROM d) WHERE len(found) > 0)) WHERE {passes[kind]})"""

    term_class = f"CASE WHEN regexp_full_match(term, '[0-9]+') THEN '#' || length(term) ELSE left(term, {STEM}) END"

    def discloses(joint: str, term: str) -> str:
        return (f"{joint}::DOUBLE * {1 << LEFT} > {term}::DOUBLE AND {joint}::DOUBLE * n_all::DOUBLE >= "
                f"{term}::DOUBLE * n_entity::DOUBLE * {1 << GAINED}")

    names = "['" + "', '".join(KINDS) + "']"
    listed = f"coalesce(string_agg({names}[k + 1] || ':' || s || ':' || e, ',' ORDER BY k, s, e) {{}}, '')"
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
{",".join(places(k, kind) for k, kind in enumerate(BASE))},
base AS ({" UNION ALL ".join(f"SELECT * FROM {kind}_" for kind in BASE)}),
reached AS (SELECT *, max(e) OVER (PARTITION BY r ORDER BY s, k ROWS UNBOUNDED PRECEDING) AS reached FROM base),
ordered AS (SELECT b.*, text, coalesce(lag(reached) OVER o, 0) AS before, coalesce(lead(s) OVER o, length(text)) AS edge,
                   coalesce((lag(k) OVER o) = k AND (lag(entity) OVER o) = entity, false) AS same_before,
                   coalesce((lead(k) OVER o) = k AND (lead(entity) OVER o) = entity, false) AS same_after
            FROM reached b JOIN d USING (r) WINDOW o AS (PARTITION BY r ORDER BY s, k)),
ranges AS (SELECT *, greatest(CASE WHEN same_before THEN (before + s) // 2 ELSE before END, s - {REACH}) AS low,
                  least(CASE WHEN same_after THEN (e + edge) // 2 ELSE edge END, e + {REACH}) AS high FROM ordered),
windows AS (SELECT r, k, entity, low AS a, CASE WHEN low = 0 THEN ' ' ELSE '' END || substr(text, low + 1, s - low) AS body,
                   low = 0 AS blank FROM ranges WHERE s > before
            UNION ALL SELECT r, k, entity, e, substr(text, e + 1, high - e) || CASE WHEN high = length(text) THEN ' ' ELSE '' END,
                             false FROM ranges WHERE e = reached AND high > e),
pieces AS (SELECT *, row_number() OVER () AS w, string_split_regex(body, '{GAP}') AS words, regexp_extract_all(body, '{GAP}') AS gaps FROM windows),
flat AS (SELECT r, k, entity, w, a - blank::INT AS a, unnest(words) AS word, unnest(list_concat(gaps, [''])) AS gap,
                generate_subscripts(words, 1) AS i, len(words) AS n FROM pieces),
mentions AS (SELECT r, k, entity, translate(word, '{UPPER}', '{LOWER}') AS term, s, s + length(word) AS e FROM (
    SELECT *, (a + sum(length(word) + length(gap)) OVER (PARTITION BY w ORDER BY i))::BIGINT - length(word) - length(gap) AS s FROM flat)
    WHERE i > 1 AND i < n),
counts AS (SELECT term, count(*) AS n_term FROM (SELECT unnest(string_split_regex(translate(text, '{UPPER}', '{LOWER}'), '{GAP}')) AS term
           FROM d) WHERE term <> '' GROUP BY term),
total AS (SELECT sum(n_term) AS n_all FROM counts),
joint AS (SELECT k, entity, term, {term_class} AS class, count(*) AS n_joint FROM mentions GROUP BY ALL),
entities AS (SELECT k, entity, sum(n_joint) AS n_entity FROM joint GROUP BY ALL),
near AS (SELECT k, entity, class, sum(n_joint) AS n_near FROM joint GROUP BY ALL),
classes AS (SELECT {term_class} AS class, sum(n_term) AS n_class FROM counts GROUP BY ALL),
told AS (SELECT k, entity, term, CASE WHEN {discloses("n_near", "n_class")} THEN {GONE} ELSE {GENERAL} END AS action
         FROM joint JOIN counts USING (term) JOIN entities USING (k, entity) JOIN near USING (k, entity, class)
         JOIN classes USING (class) CROSS JOIN total WHERE n_joint >= {SUPPORT} AND {discloses("n_joint", "n_term")}),
added AS (SELECT r, max(action) AS k, s, e FROM mentions JOIN told USING (k, entity, term) GROUP BY r, s, e),
spans AS (SELECT r, k, s, e FROM base UNION ALL SELECT r, k, s, e FROM added)
SELECT any_value(doc_id) AS doc_id, {", ".join(f"count(*) FILTER (k = {k}) AS n_{kind}" for k, kind in enumerate(BASE))},
       sha256({listed.format(f"FILTER (k < {len(BASE)})")}) AS base_sha256, {listed.format("")} AS spans
FROM d LEFT JOIN spans USING (r) GROUP BY r
"""
