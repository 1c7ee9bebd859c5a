"""Token rollups against a plain dictionary, batch by batch, and the query against the library's counts."""

import collections
import random

import duckdb
import pytest
import public_tokenizers
import tiktoken
from pyspark.sql import functions as F

from test_texts import PATH, SF, words
from tillmart.llm import bpe, queries, token_rollup


class Plain:
    def __init__(self):
        self.live, self.nameless = {}, collections.Counter()

    def apply(self, rows):
        best = {}
        for doc, tokenizer, kind, source, lang, n in rows:
            change = (token_rollup.KINDS.index(kind), n or 0, (source is not None, source or ""), (lang is not None, lang or ""))
            if doc is None:
                sign = {"insert": 1, "delete": -1, "revise": 0}[kind]
                self.nameless[(source, lang, tokenizer, 0)] += sign
                self.nameless[(source, lang, tokenizer, 1)] += sign * (n or 0)
            else:
                best[(doc, tokenizer)] = max(best.get((doc, tokenizer), (-1,)), (*change, source, lang))
        for key, (order, n, _, _, source, lang) in best.items():
            kind = token_rollup.KINDS[order]
            if kind == "delete":
                self.live.pop(key, None)
            elif kind == "insert" or key in self.live:
                self.live[key] = (source, lang, n)

    def totals(self):
        docs, tokens = collections.Counter(), collections.Counter()
        for (_, tokenizer), (source, lang, n) in self.live.items():
            docs[(source, lang, tokenizer)] += 1
            tokens[(source, lang, tokenizer)] += n
        for (source, lang, tokenizer, which), n in self.nameless.items():
            (tokens if which else docs)[(source, lang, tokenizer)] += n
        return {k: (docs[k], tokens[k]) for k in {*docs, *tokens} if docs[k] or tokens[k]}


def found(rollup):
    return {(r["source"], r["lang"], r["tokenizer"]): (r["n_docs"], r["n_tokens"]) for r in rollup.totals().collect()}


def test_batches_equal_a_dictionary_and_count_once(spark, tmp_path):
    rng, rollup, plain = random.Random(5), token_rollup.Rollup(spark, str(tmp_path)), Plain()
    assert found(rollup) == {}
    batches = [[(rng.choice([None, *range(60)]), rng.choice(["v1", "v2", None]), rng.choice(token_rollup.KINDS),
                 rng.choice(["a", "b", None]), rng.choice(["en", None]), rng.choice([None, *range(50)]))
                for _ in range(120)] for _ in range(3)]
    for name, rows in [*enumerate(batches), ("empty", [])]:
        df = spark.createDataFrame(rows, token_rollup.CHANGES).withColumn("seq", F.lit("clash"))
        assert rollup.apply(str(name), df)
        plain.apply(rows)
        assert found(rollup) == plain.totals()
        assert not rollup.apply(str(name), df) and found(rollup) == plain.totals()


def test_a_batch_that_broke_off_is_written_over(spark, tmp_path, monkeypatch):
    rollup = token_rollup.Rollup(spark, str(tmp_path))
    row = lambda n: spark.createDataFrame([(1, "v1", "insert", "a", "en", n)], token_rollup.CHANGES)
    rollup.apply("one", row(5))
    broken = row(9)
    with monkeypatch.context() as m:
        m.setattr(type(spark), "createDataFrame", lambda *a, **k: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError):
            rollup.apply("two", broken)  # fails at its commit mark
    assert found(rollup) == {("a", "en", "v1"): (1, 5)}
    assert rollup.apply("two", row(7)) and found(rollup) == {("a", "en", "v1"): (1, 7)}


def test_query_equals_plain_counts(spark):
    encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(PATH),
                                 special_tokens={})
    rows = duckdb.sql(f"SELECT doc_id, text, source, lang FROM '{SF}/documents.parquet' ORDER BY doc_id").fetchall()
    seen, docs, tokens = set(), collections.Counter(), collections.Counter()
    for _, text, source, lang in rows:
        if text not in seen:
            seen.add(text)
            for name, n in (("byte_bpe_multi_50k", len(encoding.encode_ordinary(text))), ("words", len(words(text)))):
                docs[(source, lang, name)] += 1
                tokens[(source, lang, name)] += n
    got = queries.QUERIES["op7_token_rollup"](spark, SF).collect()
    assert {(r["source"], r["lang"], r["tokenizer"]): (r["n_docs"], r["n_tokens"]) for r in got} == {
        k: (docs[k], tokens[k]) for k in docs}
