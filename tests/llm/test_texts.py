"""Operators on texts against plain versions, on odd inputs: nulls, empty and long texts, ties, repeated rows, clashing
columns, empty tables."""

import collections
import hashlib
import random
import re
import zlib

import duckdb
import pytest
import public_tokenizers
import regex
import tiktoken
import xxhash
from pyspark.sql import functions as F

from tillmart.llm import bpe, quality_classifier, quality_rules, queries, secret_scan, simhash, substring_dedup

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
ODD = [None, "", " \n\t", "a", "A b", " x  y", "é\U0001F600 " * 40, "w " * 3000, "x" * 5000, "a\n" * 30,
       "the cat sat\n\nthe cat sat\n", "\r\n one\rtwo \x0b three \x0c four", "<|endoftext|> 's 're 12 1234 !!"]


@pytest.fixture(scope="module")
def rows():
    """Texts of the smallest table, odd ones, near copies, and repeated rows and ids."""
    given = duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet' ORDER BY doc_id").fetchall()
    rng, out = random.Random(4), given[:60] + [(1000 + i, t) for i, t in enumerate(ODD)]
    words = given[7][1].split() * 3
    for i in range(60):
        copy = list(words[:rng.randrange(60, 200)])
        for _ in range(rng.randrange(0, 3)):
            copy[rng.randrange(len(copy))] = "changed"
        out.append((2000 + i - 4000 * (i % 2), " ".join(copy)))
    return out + [out[3], out[3], (out[4][0], out[9][1]), (None, out[5][1]), (None, None)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    """With columns named as the operators' own."""
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    for clash in ("_fp", "kept", "_text", "_row", "size", "tokens", "n_words", "label", "fold", "_id"):
        df = df.withColumn(clash, F.lit("clash"))
    return df


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")


def words(text):
    return WORD.findall(text or "")


def ordered(found):
    return sorted(found, key=lambda r: tuple((x is None, x) for x in r))


def test_bpe_equals_the_library(docs, rows):
    encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(PATH),
                                 special_tokens={})
    got = bpe.decode(bpe.encode(docs, PATH, public_tokenizers.PATTERN), PATH)
    found = ordered((r["doc_id"], tuple(r["tokens"]), bytes(r["decoded"])) for r in got.collect())
    assert found == ordered((d, tuple(encoding.encode_ordinary(t or "")), (t or "").encode()) for d, t in rows)


def test_bpe_of_long_words_and_texts(monkeypatch):
    encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(PATH),
                                 special_tokens={})
    rng = random.Random(1)
    texts = ["".join(rng.choices("theinroasdl", k=rng.randrange(1, 900))) for _ in range(150)] + ["ab" * 4000, "\n" * 300]
    split, replay = regex.compile(public_tokenizers.PATTERN), bpe.Replay(bpe.load_ranks(PATH))
    want = [t for text in texts for t in encoding.encode_ordinary(text)]
    assert replay.encode(texts, split)[0].tolist() == want
    monkeypatch.setattr(bpe, "SHORT", 0)  # every word by the queue of ranks
    replay.forget()
    assert replay.encode(texts, split)[0].tolist() == want
    monkeypatch.setattr(bpe, "SHARD_BYTES", 10)  # every text by and by
    ids, counts = replay.encode(texts, split)
    assert ids.tolist() == want and counts.tolist() == [len(encoding.encode_ordinary(t)) for t in texts]


def test_texts_without_ids_are_told_apart(spark):
    """Texts with equal 32-bit hashes, in parts of different length, and the greatest id, which comes back as it was."""
    texts = {n: " ".join(f"{n}x{i}" for i in range(1, 71)) for n in (6417, 100652, 107616, 137784)}
    given = spark.createDataFrame([(None, t) for t in texts.values()] + [((1 << 63) - 1, "w " * 60), (5, texts[6417] + " more")],
                                  "doc_id long, text string")
    alike = given.filter("doc_id IS NULL").groupBy(F.hash("text")).count()
    assert [r["count"] for r in alike.collect()] == [2, 2]
    got = substring_dedup.remove_repeats(given).collect()
    assert sorted(r["n_removed"] for r in got) == [0, 0, 0, 0, 0, 70]  # only what document 5 has, too
    assert (1 << 63) - 1 in {r["doc_id"] for r in got}


def test_substring_dedup_equals_brute_force(docs, rows):
    big, least = 1 << 70, {}
    tokens = [(d, words(t)) for d, t in rows]
    for d, w in tokens:
        for i in range(len(w) - 49):
            key = tuple(w[i:i + 50])
            least[key] = min(least.get(key, big + 1), big if d is None else d)
    want = []
    for d, w in tokens:
        gone = [False] * len(w)
        for i in range(len(w) - 49):
            if least[tuple(w[i:i + 50])] < (big if d is None else d):
                gone[i:i + 50] = [True] * 50
        want.append((d, len(w), sum(gone), " ".join(a for a, g in zip(w, gone) if not g)))
    assert sum(w[2] for w in want) > 1000
    assert ordered(map(tuple, substring_dedup.remove_repeats(docs).collect())) == ordered(want)


def test_repeated_rows_collect_each_span_once(spark, monkeypatch):
    given = " ".join(f"w{i}" for i in range(200))
    rows = [(1, given)] + [(None, given)] * 40
    pruned = substring_dedup._pruned

    def watched(batches):
        for batch in batches:
            assert max(batch.column(2).value_lengths().to_pylist()) <= 151  # windows of one text
            yield from pruned(iter([batch]))

    alone = spark.createDataFrame(rows[:2], "doc_id long, text string")
    one = [r for r in substring_dedup.remove_repeats(alone).collect() if r["doc_id"] is None]
    monkeypatch.setattr(substring_dedup, "_pruned", watched)
    got = substring_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert [r for r in got if r["doc_id"] is None] == one * 40
    assert sorted(r["n_removed"] for r in got) == [0] + [200] * 40


def fingerprint(text):
    w = words((text or "").translate({c: c + 32 for c in range(65, 91)}))
    parts = [" ".join(w[i:i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum((2 * sum(h >> b & 1 for h in hashes) > len(hashes)) << b for b in range(64))


def near_groups(rows):
    """(id, fingerprint, least id, a name of the group) of each row."""
    prints = [(d, fingerprint(t)) for d, t in rows]
    known = sorted({f for _, f in prints})
    group = {f: f for f in known}
    changed = True
    while changed:
        changed = False
        for i, a in enumerate(known):
            for b in known[:i]:
                if (a ^ b).bit_count() <= 3 and group[a] != group[b]:
                    group[a] = group[b] = min(group[a], group[b])
                    changed = True
    least = {}
    for d, f in prints:
        if d is not None:
            least[group[f]] = min(d, least.get(group[f], d))
    return [(d, f"{f:016x}", least.get(group[f]), group[f]) for d, f in prints]


@pytest.mark.parametrize("shard", [4096, 24])
def test_simhash_groups_equal_brute_force(docs, rows, shard, monkeypatch):
    monkeypatch.setattr(simhash, "SHARD", shard)  # 24: shards are split by further bits
    assert ordered(map(tuple, simhash.near_groups(docs).collect())) == ordered(r[:3] for r in near_groups(rows))


def test_keep_one_keeps_the_least_id_of_each_group(docs, rows):
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    wanted = {group: least for _, _, least, group in near_groups(rows)}
    assert ordered((r["doc_id"],) for r in kept.collect()) == ordered((least,) for least in wanted.values())


def test_keep_one_is_the_same_for_any_partitioning(spark):
    text = "one text that many rows of one id hold in full"
    rows = [(3, text, f"x{i}") for i in range(50)] + [(None, "", None), (None, None, "n"), (3, text, None), (9, text, "late")]
    df = spark.createDataFrame(rows, "doc_id long, text string, other string")
    kept = [sorted(map(repr, simhash.keep_one(df.repartition(n)).collect())) for n in (1, 4, 17)]
    assert kept[0] == kept[1] == kept[2] and len(kept[0]) == 2


def test_bk_tree_finds_what_a_scan_finds():
    rng, tree, values = random.Random(8), simhash.BKTree(), []
    for _ in range(400):
        value = rng.choice(values) ^ (1 << rng.randrange(64)) if values and rng.random() < .7 else rng.getrandbits(64)
        assert sorted(tree.near(value, 3)) == [i for i, v in enumerate(values) if (v ^ value).bit_count() <= 3]
        tree.add(value)
        values.append(value)


def quality(text):
    text = text or ""
    w, seen, dup = words(text), set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    grams = collections.Counter(tuple(w[i:i + 5]) for i in range(len(w) - 4))
    inside = {j for i in range(len(w) - 4) if grams[tuple(w[i:i + 5])] > 1 for j in range(i, i + 5)}
    return (len(w), sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"), dup, len(inside),
            len(w) < 10 or 100 * len(inside) > 20 * len(w))


def coverage(text, n):
    w = words(text)
    grams = collections.Counter(tuple(w[i:i + n]) for i in range(len(w) - n + 1))
    inside = {j for i in range(len(w) - n + 1) if grams[tuple(w[i:i + n])] > 1 for j in range(i, i + n)}
    return sum(len(w[j]) for j in inside) / max(1, sum(map(len, w)))


def test_quality_rules_equal_brute_force(docs, rows):
    found = quality_rules.assess(docs).collect()
    assert ordered((r["doc_id"], *[r[c] for c in quality_rules.COUNTS], r["base_failed"]) for r in found) == ordered(
        (d, *quality(t)) for d, t in rows)
    for n in quality_rules.MAX_COVERAGE:
        assert sorted(round(r[f"dup_{n}gram_share"], 9) for r in found) == sorted(round(coverage(t, n), 9) for _, t in rows)
    kept = quality_rules.filter_documents(docs)
    assert kept.columns == docs.columns and kept.count() == sum(r["kept"] for r in found)
    assert not any(r["kept"] and r["base_failed"] for r in found)


ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
                    re.I | re.A)


def base_spans(text):
    found = []
    for kind, pattern, good in (("assign", ASSIGN, lambda m: len(m[2]) >= 12),
                                ("access", re.compile("AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 18),
                                ("hex", re.compile("[0-9a-f]+"), lambda m: len(m[0]) >= 16)):
        found += [(m.start(), secret_scan.KINDS.index(kind), m.end()) for m in pattern.finditer(text or "") if good(m)]
    return ",".join(f"{secret_scan.KINDS[k]}:{a}:{b}" for a, k, b in sorted(found))


@pytest.fixture(scope="module")
def leaky():
    rng = random.Random(3)
    bits = ["password=", "Token : \"", "api_key=", "apikey'=", "secret: ", "passwd=token: ", "AKIA", "ABCDEF0123456789XY",
            "deadbeefdeadbeef", "é\U0001F600", "x", " ", "\n", "\n\n", "https://a.b/c", "user=bobby", "abc123", "Ab3" * 15,
            "abcdefghijklmnop12", "\"", "=", ":"]
    return ([(i, "".join(rng.choice(bits) for _ in range(rng.randrange(0, 60)))) for i in range(400)]
            + [(-1, None), (-2, ""), (-3, "deadbeefdeadbeef " * 2000), (5, "password=abcdefghijkl"), (None, "AKIA" + "Z" * 14)])


def test_secrets_equal_brute_force(spark, leaky):
    df = spark.createDataFrame(leaky, "doc_id long, text string").withColumn("_text", F.lit(1))
    found = secret_scan.scan(df).collect()
    assert ordered((r["doc_id"], r["base"]) for r in found) == ordered((d, base_spans(t)) for d, t in leaky)
    for r in found:
        assert r["n_hex"] == r["base"].count("hex:") and set(r["base"].split(",")) <= {"", *r["spans"].split(",")}


def test_weak_secrets_need_their_complement(spark):
    texts = ["password=abc123", "password=abc123 at https://host/x", "user=bob password=abc123 at https://host/x",
             "user=bob\n\npassword=abc123", "user=bob " + "y" * 500 + " password=abc123", "see https://host/x user=bob"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert [r["spans"] for r in secret_scan.scan(df).orderBy("doc_id").collect()] == [
        "", "secret:0:15", "secret:9:24,endpoint:28:42", "", "", ""]


def near_parts(text):
    """Weak secrets and endpoints by comparing every two parts."""
    def found(pattern):
        return [(m.start(), m.end()) for m in re.finditer(pattern, text)]

    mix = [re.compile(c) for c in secret_scan.TOKEN_MIX]
    weak = [(m.start(), m.end()) for m in ASSIGN.finditer(text) if 6 <= len(m[2]) < 12]
    weak += [(a, b) for a, b in found(secret_scan.TOKEN) if b - a == 40 and all(c.search(text[a:b]) for c in mix)]
    ids, ends, blanks = found(secret_scan.ACCESS) + found(secret_scan.IDENTIFIER), found(secret_scan.ENDPOINT), found(secret_scan.BLANK_LINE)

    def near(p, others):
        for o in others:
            first, last = min(p[1], o[1]), max(p[0], o[0])
            if last - first <= secret_scan.REACH and not any(x >= first and y <= last for x, y in blanks):
                return True
        return False

    return sorted([f"endpoint:{a}:{b}" for a, b in ends if near((a, b), ids) and near((a, b), weak)]
                  + [f"secret:{a}:{b}" for a, b in weak if near((a, b), ids) or near((a, b), ends)])


def test_sweep_links_as_all_pairs_do(spark, leaky):
    rng = random.Random(8)
    bits = ["password=abc123 ", "token=user=ab/cd ", "secret=login=abc/x ", "user=bob ", "client_id: xyz9 ", "https://h/p ",
            "s3://user=abc,password=abc123/", "AKIA" + "B" * 14 + " ", "aB3" * 13 + "a ", "\n\n", "\n \t\n", "\n", "é\U0001F600",
            "y" * 130 + " ", "y" * 260 + " ", "=", "passwd=AKIA" + "B" * 14]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randrange(0, 40))) for _ in range(500)]
    texts += ["".join(rng.choice(bits) for _ in range(900))] + [t or "" for _, t in leaky]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in secret_scan.scan(df).collect():
        got = sorted(s for s in r["spans"].split(",") if s.startswith(("endpoint", "secret")))
        assert got == near_parts(texts[r["doc_id"]]), texts[r["doc_id"]]


def test_many_candidates_in_one_text_are_linear(spark):
    """100,000 linked candidates within few scopes, and their removal."""
    n = 50_000  # lines
    line = "password=abc123 user=bob https://h/p\n"
    df = spark.createDataFrame([(1, line * n)], "doc_id long, text string")
    spans = secret_scan.scan(df).first()["spans"].split(",")
    assert len(spans) == 2 * n and spans[-2:] == [f"secret:{37 * n - 37}:{37 * n - 22}", f"endpoint:{37 * n - 12}:{37 * n - 1}"]
    assert secret_scan.redact(df).first()["text"] == "[SECRET] user=bob [SECRET]\n" * n


def test_redacting_leaves_the_rest(spark, leaky):
    df = spark.createDataFrame(leaky, "doc_id long, text string").select(
        "*", F.length("text").cast("long").alias("n_chars"), F.lit(1).alias("_row"))
    spans = collections.defaultdict(list)
    for r in secret_scan.scan(df).collect():
        spans[r["doc_id"]].append(r["spans"])
    out = secret_scan.redact(df)
    assert out.columns == df.columns
    by_id = {}
    for d, t in leaky:
        for listed in spans[d]:
            text, at = "", 0
            for a, b in (map(int, s.split(":")[1:]) for s in listed.split(",") if s):
                if a >= at:
                    text += (t or "")[at:a] + secret_scan.MARK
                at = max(at, b)
            by_id.setdefault(d, set()).add(text + (t or "")[at:] if listed else t)
    for r in out.collect():
        assert r["text"] in by_id[r["doc_id"]] and r["n_chars"] == (None if r["text"] is None else len(r["text"]))


def test_running_sums_of_long_arrays(spark):
    df = spark.range(1).select(F.sequence(F.lit(1), F.lit(1000)).alias("x"))
    assert df.select(secret_scan.running(F.col("x"))).first()[0] == [i * (i + 1) // 2 for i in range(1, 1001)]


def test_classifier_tells_held_out_documents_apart(spark):
    got = queries.QUERIES["op10_quality_classifier"](spark, "/root/testdata/sf0.01").collect()
    labels = dict(duckdb.sql("SELECT doc_id, quality FROM '/root/testdata/sf0.01/labels.parquet'").fetchall())
    assert len(got) == 1000 and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in got)
    held = [(r["score"], labels[r["doc_id"]]) for r in got if r["held_out"] and r["doc_id"] in labels]
    good, bad = [s for s, q in held if q], [s for s, q in held if not q]
    wins = sum((g > b) + (g == b) / 2 for g in good for b in bad)
    assert wins / (len(good) * len(bad)) >= 0.97


def test_classifier_on_odd_tables(spark, docs, rows, none):
    labels = spark.createDataFrame([(1, 1, "x"), (1, 0, "x"), (2, None, "x"), (None, 1, "x"), (3, 1, "x")],
                                   "doc_id long, quality int, label string")
    out = quality_classifier.score(docs, labels).collect()
    assert len(out) == len(rows) and all(r["score"] > 0.5 for r in out)  # one class only: its share
    assert {r["score"] for r in quality_classifier.score(docs, labels.limit(0)).collect()} == {0.5}
    assert quality_classifier.score(none, labels).count() == 0


def test_every_labelled_id_teaches_once(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(quality_classifier, "fit", lambda x, y, calibration: seen.append((x.tolist(), y.tolist())))
    ids = [i for i in range(40) if zlib.crc32(str(i).encode()) % quality_classifier.FOLDS != quality_classifier.HELD_OUT]
    df = spark.createDataFrame([(i, f"text of {i} here") for i in ids] + [(ids[0], f"other {j}") for j in range(300)],
                               "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in ids], "doc_id long, quality int")
    monkeypatch.setattr(quality_classifier, "MAX_LABELLED", len(ids))
    for n in (3, 5):
        quality_classifier.train(df.repartition(n), labels)
    assert len(seen[0][1]) == len(ids) and seen[0] == seen[1]


def test_temperature_is_set_on_other_rows():
    import numpy as np

    rng = np.random.default_rng(0)
    x = rng.normal(size=(600, quality_classifier.FEATURES)).astype(np.float32)
    y = (x[:, 0] + rng.normal(size=600) > 0).astype(int)
    net = quality_classifier.fit(x, y, np.arange(600) % 4 == 0)
    raw, truth = net.logits(x[::4].astype(float)), y[::4]
    loss = lambda t: np.mean(np.logaddexp(0, np.where(truth == 1, -raw, raw) / t))
    assert net.temperature > 1 and loss(net.temperature) <= min(loss(net.temperature * 1.3), loss(net.temperature / 1.3))


def test_empty_tables(none):
    assert bpe.decode(bpe.encode(none, PATH, public_tokenizers.PATTERN), PATH).count() == 0
    assert substring_dedup.remove_repeats(none).count() == 0
    assert simhash.near_groups(none).count() == 0 and simhash.keep_one(none).count() == 0
    assert quality_rules.assess(none).count() == 0 and quality_rules.filter_documents(none).count() == 0
    assert secret_scan.scan(none).count() == 0 and secret_scan.redact(none).count() == 0


def test_digests_of_the_queries(spark):
    encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(PATH),
                                 special_tokens={})
    texts = dict(duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet'").fetchall())
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for r in queries.QUERIES["op1_byte_bpe"](spark, SF).collect():
        ids = encoding.encode_ordinary(texts[r["doc_id"]])
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (
            len(ids), sha(",".join(map(str, ids))), sha(texts[r["doc_id"]]))
    for r in queries.QUERIES["op6_secret_scan"](spark, SF).collect():
        assert r["base_sha256"] == sha(base_spans(texts[r["doc_id"]]))
