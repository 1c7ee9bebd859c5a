"""Operators on conversations, vectors and sources, and the pipeline, against plain versions and SQL."""

import collections
import random

import pytest
import public_tokenizers
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from compare import connect, difference
from test_texts import PATH, coverage, near_groups, quality, words
from tillmart.llm import bpe, chat_format, exact_topk, quality_rules, queries, secret_scan, source_mix

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_its_sql(spark, name):
    assert difference(queries.QUERIES[name](spark, SF), connect(SF), queries.ORACLES[name]) is None


def test_chat_texts_come_back(spark):
    rng = random.Random(2)
    bits = ["<|im_start|>", "<|im_end|>", "<\\|im_end|>", "<\\\\|", "\n", "<|image|>", "<", "|", "\\", "x", "é\U0001F600",
            "assistant", "$1", "user\n", "<|line|>"]
    roles = ["user", "assistant", "system", "", None, "<|im_end|>", "us\ner", "<|line|>"]
    rows = [(i, j, rng.choice(roles), "".join(rng.choice(bits) for _ in range(rng.randrange(0, 12))))
            for i in range(120) for j in range(rng.randrange(1, 6))]
    rows += [(None, 1, "user", None), (None, None, "assistant", "q"), (None, 1, "user", "a"), (3, 0, "user", "tie"), rows[0]]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5).withColumn(
        "_conv", F.lit(1))
    read = chat_format.read_back(chat_format.format_conversations(
        df.withColumn("parts", chat_format.text_parts(F.col("text")))))
    wanted = collections.defaultdict(list)
    for conv, turn, role, text in rows:
        wanted[conv].append((turn is not None, turn or 0, role or "", text or ""))
    found = read.collect()
    assert len(found) == len(wanted)
    for r in found:
        turns = sorted(wanted[r["conv_id"]])
        assert [(t["role"], t["text"]) for t in r["turns"]] == [t[2:] for t in turns]
        assert r["loss_text"] == "".join(t[3] for t in turns if t[2] == "assistant")
        assert "".join(r["formatted"][a:b] for a, b in r["loss"]).count("<|im_") == 0
    assert chat_format.format_conversations(df.limit(0).withColumn("parts", chat_format.text_parts(F.col("text")))).count() == 0


def test_attachments_become_placeholders(spark):
    parts = [(1, 0, "user", [("text", "a<|image|>", None), ("image", "s3://x", 85), ("audio", "y", None)]),
             (1, 1, "assistant", [("text", "ok", 0), ("document", "d.pdf", 400)]), (2, 0, "user", None)]
    df = spark.createDataFrame(parts, "conv_id long, turn long, role string, parts " + chat_format.PARTS)
    one, two = chat_format.format_conversations(df).orderBy("conv_id").collect()
    assert one["formatted"] == ("<|im_start|>user\na<\\|image|><|image|><|audio|><|im_end|>\n"
                                "<|im_start|>assistant\nok<|document|><|im_end|>\n")
    assert [tuple(a) for a in one["attachments"]] == [(0, "image", "s3://x", 85), (0, "audio", "y", 0),
                                                      (1, "document", "d.pdf", 400)]
    assert one["attachment_tokens"] == 485 and two["formatted"] == "<|im_start|>user\n<|im_end|>\n"


def nearest(rows, k):
    out, good = [], [(i, v) for i, v in rows if i is not None and v is not None]
    for q, x in {(i, tuple(v)) for i, v in good if i % 3 == 0}:
        scores = sorted((-sum(a * b for a, b in zip(x, v)), i) for i, v in good if i != q and len(v) == len(x))
        out += [(q, r + 1, i, int(-s)) for r, (s, i) in enumerate(scores[:k])]
    return sorted(out)


@pytest.mark.parametrize("sizes", [(2048, 128, 8, 2048), (20, 4, 2, 10)])
def test_topk_equals_brute_force(spark, sizes, monkeypatch):
    for name, value in zip(("SHARD", "LEAF", "GROUP", "BLOCK"), sizes):
        monkeypatch.setattr(exact_topk, name, value)
    rng = random.Random(6)
    rows = [(i, [float(rng.randrange(-9, 10)) for _ in range(5)]) for i in range(200)]
    rows += [(300 + i, [1.0] * 5) for i in range(40)]  # ties
    rows += [(400, None), (402, [2.0, 3.0]), (405, [1.0, -1.0]), (None, [1.0] * 5), (600, []), (603, []),
             (606, [2.0 ** 30] * 5), (607, [2.0 ** 29] * 5), (300, [1.0] * 5)]
    df = spark.createDataFrame(rows, "vec_id long, vector array<double>").withColumn("score", F.lit("clash"))
    got = exact_topk.top_k(df.filter("vec_id % 3 = 0"), df, k=7)
    assert sorted(map(tuple, got.collect())) == nearest(rows, 7)
    assert exact_topk.top_k(df.limit(0), df.limit(0)).count() == 0


def test_vectors_with_holes_take_no_part(spark):
    rows = [([1.0, -0.01],), ([None, 1.0],), ([float("nan")],), ([float("inf")],), (None,), ([],)]
    df = spark.createDataFrame(rows, "v array<float>").select(exact_topk.quantized(F.col("v")).alias("v"))
    assert [r["v"] for r in df.collect()] == [[64.0, -1.0], None, None, None, None, []]


def test_mix_on_odd_rows(spark):
    rng = random.Random(9)
    rows = [(i, "w " * rng.randrange(0, 90), rng.choice(["a", "b", "B", "", None, "zz"])) for i in range(600)]
    rows += [(None, "x y", "a"), (5, None, None), rows[0], rows[0], (7, "one", "solo")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4).withColumn("size", F.lit("clash"))
    got = source_mix.mix(df).collect()
    assert len(got) == len(rows)
    sizes, taken, targets = collections.Counter(), collections.Counter(), {}
    for r in got:
        assert 0 <= r["taken"] <= 2 * r["size"] and len(r["positions"]) == r["copies"]
        assert all(0 <= p <= 1 for p in r["positions"])
        sizes[r["source"]] += r["size"]
        taken[r["source"]] += r["taken"]
        targets[r["source"]] = r["target"]
    assert sum(targets.values()) == pytest.approx(1.5 * sum(sizes.values()))
    for s, target in targets.items():
        assert target <= 2 * sizes[s] and abs(taken[s] - target) <= max(2 * r["size"] for r in got if r["source"] == s)
    again = source_mix.mix(df.repartition(9)).collect()
    assert sorted(map(repr, again)) == sorted(map(repr, got))
    ordered = source_mix.in_training_order(df)
    assert ordered.columns == df.columns
    assert ordered.count() == sum(r["copies"] for r in got)
    assert source_mix.mix(df.limit(0)).count() == 0 and source_mix.in_training_order(df.limit(0)).count() == 0


def test_positions_follow_the_schedules(spark):
    places = [i / 20 for i in range(21)]
    df = spark.createDataFrame([(p, s) for p in places for s in range(3)], "p double, s int")
    for r in df.select("p", "s", source_mix._position(F.col("p"), F.col("s")).alias("t")).collect():
        a, b = source_mix.SCHEDULES[r["s"]]
        assert a * r["t"] + (b - a) * r["t"] ** 2 / 2 == pytest.approx(r["p"], abs=1e-9)


def test_equal_rows_are_taken_one_by_one(spark, monkeypatch):
    rows = [(None, "w " * 50, "a", k % 3) for k in range(400)] + [(7, "v " * 50, "a", 0)] * 300 + [(1, "x " * 2000, "b", 0)] * 40
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, other int")
    monkeypatch.setattr(source_mix, "EQUAL", 64)
    got = source_mix.mix(df.repartition(5)).collect()
    assert len(got) == len(rows)
    for source, size in (("a", 50), ("b", 2000)):
        mine = [r for r in got if r["source"] == source]
        assert abs(sum(r["taken"] for r in mine) - mine[0]["target"]) <= size / 2
    results = []
    for parts in (1, 3, 9):
        out = source_mix.in_training_order(df.repartition(parts), position="at").collect()
        results.append(sorted(map(repr, out)))
        planned = [(p, r["source"]) for r in got for p in r["positions"]]
        assert sorted((r["at"], r["source"]) for r in out) == sorted(planned)
    assert results[0] == results[1] == results[2]


def test_schedules_decide_the_positions(spark, monkeypatch):
    df = spark.read.parquet(f"{SF}/documents.parquet")
    read = lambda: {r["doc_id"]: (r["taken"], r["first_position"]) for r in queries.QUERIES["op8_source_mix"](
        spark, SF).collect()}
    before = read()
    monkeypatch.setattr(source_mix, "SCHEDULES", ((0.5, 1.5), (1.2, 0.8), (1.0, 1.0)))
    after = read()
    assert len(before) == df.count() and {d: t for d, (t, _) in before.items()} == {d: t for d, (t, _) in after.items()}
    assert sum(before[d][1] != after[d][1] for d in before) > 0.9 * sum(p is not None for _, p in before.values())


def test_training_order_outlives_files(spark, tmp_path):
    rng = random.Random(12)
    rows = [(i, "w " * rng.randrange(1, 300), rng.choice(["a", "b", "c"])) for i in range(400)] + [(None, "x y", "a")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)
    folder = str(tmp_path / "mixed")
    corpus_pipeline.mixed(spark, df, SF).repartition(7).write.parquet(folder)  # several files, no order left
    out = corpus_pipeline.encoded(spark, spark.read.parquet(folder), SF).collect()
    planned = [(p, r["doc_id"]) for r in source_mix.mix(df).collect() for p in r["positions"]]
    order = lambda x: (x[0], x[1] is not None, x[1] or 0)
    assert sorted(((r["training_position"], r["doc_id"]) for r in out), key=order) == sorted(planned, key=order)
    ranged = source_mix.in_training_order(df, position="at").collect()
    assert [(r["at"], r["doc_id"]) for r in ranged] == sorted(planned, key=order)
    first, last = ([r for r in out if r["source"] == "a" and half == (r["training_position"] > 0.5)] for half in (0, 1))
    assert sum(r["n_tokens"] for r in first) > 1.3 * sum(r["n_tokens"] for r in last)  # the first source's demand falls
    with pytest.raises(ValueError):
        source_mix.in_training_order(df, position="text")


def test_pipeline_stages_equal_plain_versions(spark):
    read = lambda: spark.read.parquet(f"{SF}/documents.parquet")
    rows = {r["doc_id"]: r for r in read().collect()}
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality_rules", "simhash_near_dedup", "secret_scan", "source_mix", "byte_bpe"]
    docs, kept = read(), rows
    for name, stage in corpus_pipeline.STAGES[:3]:
        docs = stage(spark, docs, SF)
        assert docs.columns == read().columns
        if name == "quality_rules":
            kept = {d: r for d, r in kept.items() if not quality(r["text"])[-1]
                    and all(coverage(r["text"], n) <= most for n, most in quality_rules.MAX_COVERAGE.items())}
            got = {r["doc_id"] for r in docs.collect()}
            assert got <= set(kept) and len(got) > 0.9 * len(kept)  # symbols and lines decide about a few more
            kept = {d: kept[d] for d in got}
        elif name == "simhash_near_dedup":
            groups = near_groups([(d, r["text"]) for d, r in kept.items()])
            kept = {d: r for d, r in kept.items() if d in {least for _, _, least, _ in groups}}
            assert {r["doc_id"] for r in docs.collect()} == set(kept)
        else:
            got = {r["doc_id"]: r["text"] for r in docs.collect()}
            assert set(got) == set(kept)
            spans = {r["doc_id"]: r["spans"] for r in secret_scan.scan(spark.createDataFrame(list(kept.values()))).collect()}
            assert all((got[d] == kept[d]["text"]) == (spans[d] == "") for d in got)
            assert all(len(words(got[d])) > 0 for d in got)
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    out = corpus_pipeline.run(spark, SF).collect()
    encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(PATH),
                                 special_tokens={})
    assert {r["doc_id"] for r in out} <= set(texts)
    for r in out:
        assert r["tokens"] == encoding.encode_ordinary(texts[r["doc_id"]]) and r["n_tokens"] == len(r["tokens"])
    copies = collections.Counter(r["doc_id"] for r in out)
    plan = {r["doc_id"]: r["copies"] for r in source_mix.mix(docs).collect()}
    assert copies == collections.Counter({d: c for d, c in plan.items() if c})
