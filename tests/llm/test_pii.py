"""Personal data against plain patterns, disclosing terms on small corpora, and the query against SQL on odd rows."""

import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from compare import connect, difference
from tillmart.llm import pii, queries

NAME = "op11_pii_sanitise"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
CARD = "4111 1111 1111 1111"


def luhn(digits):
    return sum(sum(divmod(int(d) * (1 + i % 2), 10)) for i, d in enumerate(reversed(digits))) % 10 == 0


def plain(text):
    """Base spans (kind, start, end) by the patterns as they are stated."""
    text, out = text or "", []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append((0, *m.span()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(x) <= 255 for x in m[0].split(".")):
            out.append((1, *m.span()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[^0-9]", "", m[0])
        if 13 <= len(digits) <= 19 and luhn(digits):
            out.append((2, *m.span()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            out.append((3, *m.span()))
    return sorted(out)


def spans(text, listed):
    return sorted((pii.KINDS.index(k), int(a), int(b)) for k, a, b in (x.split(":") for x in listed.split(",") if x))


ODD = [None, "", " ", "a@b.c", "a@b.c_d@e.f", "a@b", "x@y..z", "@b.c", "a@b.c@d.e", "a.b%c+d-e@f-g.h.i.", "1.2.3.4.5", "1.2.3.4.5.6.7.8",
       "256.1.1.1", "0255.000.1.01", "1.2.3", "99999999999.1.1.1", CARD, CARD.replace(" ", "-"), CARD + "1", "4111  1111 1111 1111",
       "0" * 13, "0" * 19, "0" * 20, "+1 (555) 010-9999", "+1 23", "+12345678", "+123456789", "+1234567890123456", "+1 (((((", "++1 555 000 111 2.",
       "mail: jane@x.org, +44 20 7946 0958; 10.0.0.1 and " + CARD + ".", "é\U0001F600 jo@x.de \U0001F600", "1.1.1.1@2.2.2.2", "a" * 30000,
       "a@" * 3000, "a." * 5000 + "@x", "1." * 5000, "1 " * 5000, "+1" + "-" * 5000, "x@y" + ".z" * 5000, "jo@x.de " * 700]


def test_base_spans_equal_plain_patterns(spark):
    rng = random.Random(3)
    bits = ["a@b.c", "@", ".", "1", "12", "255", "4111111111111111", " ", "-", "+1", "(5)", "x", "é", "\n", "+49 30 1234567", "10.0.0.1"]
    texts = ODD + ["".join(rng.choice(bits) for _ in range(rng.randrange(1, 25))) for _ in range(1500)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    for clash in ("_text", "_base", "_row", "_spans", "term", "kind", "value"):
        df = df.withColumn(clash, F.lit("clash"))
    for r in pii.scan(df).collect():
        want = plain(texts[r["doc_id"]])
        assert spans(texts[r["doc_id"]], r["base"]) == want, texts[r["doc_id"]][:200]
        assert [r[f"n_{k}"] for k in pii.BASE] == [sum(s[0] == i for s in want) for i in range(4)]
        assert set(want) <= set(spans(texts[r["doc_id"]], r["spans"]))


def corpus():
    filler = " ".join(f"word{i % 97} note{i % 89}" for i in range(400))
    rows = [(i, f"{filler} item {i}") for i in range(40)]
    # "Marlowe" stands with one address only, "office" with it and all over the corpus.
    rows += [(100 + i, f"the office of Marlowe jane.m@x.org {filler}") for i in range(3)]
    rows += [(200 + i, f"the office of word5 {filler} the office of note7") for i in range(60)]
    rows += [(300, f"{filler} Marlowe once more"), (301, f"just once near ip 10.0.0.1 Quorum {filler}")]
    return rows


def test_terms_that_disclose_are_generalised_or_removed(spark):
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_chars", F.char_length("text"))
    texts = dict(rows)
    found = {r["doc_id"]: [(k, texts[r["doc_id"]][a:b]) for k, a, b in (
        (k, int(a), int(b)) for k, a, b in (x.split(":") for x in r["spans"].split(",") if x))] for r in pii.scan(df).collect()}
    assert all(found[100 + i] == [("email", "jane.m@x.org"), ("removed", "Marlowe")] for i in range(3))
    assert found[301] == [("ip", "10.0.0.1")]  # one joint occurrence is no evidence
    assert not any(found[i] for i in found if i not in (100, 101, 102, 301))
    clean = {r["doc_id"]: r for r in pii.sanitise(df).collect()}
    assert clean[100]["text"].startswith("the office of  [EMAIL] word0") and clean[100]["n_chars"] == len(clean[100]["text"])
    assert clean[300]["text"] == texts[300] and clean[301]["text"].startswith("just once near ip [IP] Quorum")
    # With many other words of its class in the corpus, the class says little.
    more = df.unionByName(df.limit(0)).unionByName(spark.createDataFrame([(900, "mast mark mall made " * 400, 0)], "doc_id long, text string, n_chars int"))
    assert {r["doc_id"]: r["text"] for r in pii.sanitise(more).collect()}[100].startswith("the office of ma* [EMAIL] word0")


def test_disclosures_state_their_bits(spark):
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    mentions = spark.createDataFrame([(0, "jane.m@x.org", t) for t in ("marlowe", "office", "of", "the") for _ in range(3)], "kind int, value string, term string")
    found = pii.disclosures(mentions, pii.corpus_counts(df)).collect()
    assert [(r["term"], round(r["bits_left"], 2)) for r in found] == [("marlowe", 0.42)]
    n_all = sum(len([w for w in re.split(r"[^0-9A-Za-z]+", t) if w]) for _, t in rows)
    assert 2 ** found[0]["bits_gained"] == pytest.approx(3 * n_all / 4 / 12)


def test_a_value_in_every_text_and_many_values_in_one(spark):
    rows = [(i, f"write to help{'' if i % 3 else i}@x.org about zebra{i % 3} line {i}") for i in range(300)]
    rows.append((999, " and ".join(f"u{i}@x.org" for i in range(3000))))
    found = {r["doc_id"]: r for r in pii.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(found) == 301 and found[999]["n_email"] == 3000
    assert all(found[i]["n_email"] == 1 for i in range(300))


def test_sanitise_keeps_other_columns_and_odd_rows(spark):
    rows = [(i, t, "en", "s", None if t is None else len(t)) for i, t in enumerate(ODD)]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("_text", F.lit("c")).withColumn("_doc", F.lit("d"))
    out = {r["doc_id"]: r for r in pii.sanitise(df).collect()}
    assert len(out) == len(ODD) and out[0]["text"] is None and out[1]["text"] == "" and out[0]["_doc"] == "d"
    assert out[3]["text"] == "[EMAIL]" and out[16]["text"] == "[CARD]"
    assert "jane" not in out[30]["text"] and "4111" not in out[30]["text"]
    assert pii.sanitise(df.limit(0)).count() == 0 and pii.scan(df.limit(0)).count() == 0


def test_query_on_odd_rows(spark, tmp_path):
    rows = [(i, t, None, None, None) for i, t in enumerate(ODD) if t is None or len(t) < 20000]
    rows += [(500 + i, t, None, "s", 1) for i, t in corpus()] + [(None, "jane.m@x.org", None, None, None), (3, "a@b.c", None, None, None)]
    con = duckdb.connect()
    con.execute("CREATE TABLE t (doc_id BIGINT, text VARCHAR, lang VARCHAR, source VARCHAR, n_chars BIGINT)")
    con.executemany("INSERT INTO t VALUES (?, ?, ?, ?, ?)", rows)
    con.execute(f"COPY t TO '{tmp_path}/documents.parquet' (FORMAT parquet)")
    assert difference(queries.QUERIES[NAME](spark, str(tmp_path)), connect(str(tmp_path)), queries.ORACLES[NAME]) is None
