"""The Merkle manifest against a plain tree, and its query against SQL on odd rows."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from compare import connect, difference
from tillmart.llm import merkle, queries

ODD = [(3, "a\nb", "en", "s1", 3), (3, "a\nb", "en", "s1", 3), (3, "other", None, "s1", None), (None, None, None, None, None),
       (None, "x", "en", None, 1), (7, "", "de", "", 0), (8, "\n\n", "de", "é", 2), (9, "w " * 40000, "fr", "s1", 80000)]


def h(*texts):
    return hashlib.sha256("".join(texts).encode()).hexdigest()


def field(x):
    return "-" if x is None else f"{len(str(x).encode())}:{x}"


def tree(digests, arity):
    """The root, and for each leaf its siblings (before, after) level by level."""
    paths, place = [[] for _ in digests], list(range(len(digests)))
    while len(digests) > 1:
        runs = [digests[i:i + arity] for i in range(0, len(digests), arity)]
        for leaf, at in enumerate(place):
            run, slot = runs[at // arity], at % arity
            paths[leaf].append(("".join(run[:slot]), "".join(run[slot + 1:])))
        place, digests = [at // arity for at in place], [h(*run) for run in runs]
    return digests[0], paths


def plain(rows, arity):
    groups = {}
    for doc_id, text, source in rows:
        groups.setdefault(source, []).append((doc_id is not None, doc_id or 0, h(field(doc_id), field(text)), text))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = [tree([leaf[2] for leaf in sorted(groups[s], key=lambda x: x[:3])], arity) for s in names]
    root, above = tree([t[0] for t in trees], arity)
    out = []
    for name, (subroot, paths), top in zip(names, trees, above):
        for (known, doc_id, leaf, _), path in zip(sorted(groups[name], key=lambda x: x[:3]), paths):
            out.append((doc_id if known else None, leaf, subroot, root, tuple(path + top)))
    return out


def found(df):
    return [(r["doc_id"], r["leaf"], r["subroot"], r["root"], tuple((s["before"], s["after"]) for s in r["path"]))
            for r in df.collect()]


def by_text(rows):
    return sorted(rows, key=repr)


@pytest.mark.parametrize("arity", [2, 3, 5])
def test_proofs_equal_a_plain_tree(spark, arity):
    rng = random.Random(arity)
    rows = [(rng.choice([None, rng.randrange(40), i]), rng.choice([None, "", "é\n", f"t{i}"]),
             rng.choice(["big", "big", "b", None, "", f"lone{i}"])) for i in range(180)]
    df = spark.createDataFrame(rows + rows[:5], "doc_id long, text string, source string").repartition(6)
    for clash in ("tree", "idx", "n", "digest", "path", "_group", "_tie", "root"):
        df = df.withColumn(clash, F.lit("clash"))
    proved = merkle.manifest(df, merkle.record(F.col("doc_id"), F.col("text")), arity=arity)
    assert by_text(found(proved)) == by_text(plain(rows + rows[:5], arity))
    folded = proved.withColumn("again", merkle.fold(F.col("leaf"), F.col("path")))
    assert folded.filter("again <> root").count() == 0


def test_one_row_and_no_rows(spark):
    one = spark.createDataFrame([(1, "t", "s")], "doc_id long, text string, source string")
    leaf = merkle.record(F.col("doc_id"), F.col("text"))
    row = merkle.manifest(one, leaf).first()
    assert row["leaf"] == row["subroot"] == row["root"] and row["path"] == []
    assert merkle.manifest(one.limit(0), leaf).count() == 0


def test_fields_cannot_run_together(spark):
    df = spark.createDataFrame([("ab", "c", None), ("a", "bc", None), (None, "abc", ""), ("abc", None, "")],
                               "a string, b string, c string")
    assert df.select(merkle.record(F.col("a"), F.col("b"), F.col("c"))).distinct().count() == 4


def test_query_on_odd_rows(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    name = "op12_merkle_manifest"
    spark.createDataFrame(ODD, schema).coalesce(1).toPandas().convert_dtypes().to_parquet(f"{tmp_path}/documents.parquet")
    got = queries.QUERIES[name](spark, str(tmp_path))
    assert difference(got, connect(str(tmp_path)), queries.ORACLES[name]) is None
    changed = {(r["doc_id"], r["verified"]) for r in got.collect()}
    assert (3, True) in changed or (3, False) in changed


def test_tampering_shows_only_where_a_text_changed(spark):
    import zlib

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in queries.QUERIES["op12_merkle_manifest"](spark, "/root/testdata/sf0.001").collect():
        hurt = zlib.crc32(str(r["doc_id"]).encode()) % 2 == 0 and "\n" in texts[r["doc_id"]]
        assert r["verified"] is not hurt
