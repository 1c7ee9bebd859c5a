"""Token counts as delta-maintained rollups: totals by source, language and tokenizer version.

A batch of changes (inserts, deletes, revised counts) is turned into signed deltas against the ledger, the last known
count of each (document, tokenizer). Totals are the sum of the deltas of all committed batches, so they never need the
documents again. A batch writes its ledger rows, then its deltas, then one commit mark; readers see only marked batches.
Repeating a batch that is marked does nothing, and one that broke off before its mark is written over, so a batch counts
once however often it is sent. One writer at a time.

    rollup/ledger/batch=N   (doc_id, tokenizer, source, lang, n_tokens, alive) after the batch
    rollup/deltas/batch=N   (source, lang, tokenizer, n_docs, n_tokens), signed
    rollup/commits/batch=N  (batch_id, seq)

Deltas are summed within tasks before they are shuffled, so a source with a third of all documents is no hot group;
ledger joins go by document.

Defined cases: an insert of a live document counts as a revision, also where its source or language has changed; a
revision of a document that is not live, and a delete of one, do nothing; several changes of one document in a batch
count as one, the kind that comes last in ``KINDS``, then the larger count; changes without a document id cannot be looked
up: an insert adds its count, a delete takes it away, a revision does nothing; a null count is 0; null sources and
languages are groups of their own; an empty batch is committed and changes nothing; other columns play no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .storage import stored

KINDS = ("insert", "revise", "delete")
CHANGES = "doc_id long, tokenizer string, kind string, source string, lang string, n_tokens long"
LEDGER = "doc_id long, tokenizer string, source string, lang string, n_tokens long, alive boolean, seq int"
DELTAS = "source string, lang string, tokenizer string, n_docs long, n_tokens long"


def changes(rows: DataFrame, kind: str, tokenizer: str | Column, count: Column | None = None, doc_id: str = "doc_id",
            source: str = "source", lang: str = "lang") -> DataFrame:
    """Rows of a document table as changes of one kind."""
    name = F.lit(tokenizer) if isinstance(tokenizer, str) else tokenizer
    return rows.select(F.col(doc_id).cast("long").alias("doc_id"), name.alias("tokenizer"), F.lit(kind).alias("kind"),
                       F.col(source).cast("string").alias("source"), F.col(lang).cast("string").alias("lang"),
                       (F.lit(0) if count is None else count).cast("long").alias("n_tokens"))


class Rollup:
    """Totals under ``folder``, which all executors share."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def _exists(self, path: str) -> bool:
        place = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return place.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(place)

    def _commits(self) -> dict[str, int]:
        """Batch id to number: one row per batch for the driver."""
        if not self._exists(f"{self.folder}/commits"):
            return {}
        rows = self.spark.read.schema("batch_id string, seq int").parquet(f"{self.folder}/commits/*").collect()
        return {r["batch_id"]: r["seq"] for r in rows}

    def _read(self, kind: str, schema: str) -> DataFrame:
        """The rows of all committed batches."""
        paths = [f"{self.folder}/{kind}/batch={n}" for n in sorted(self._commits().values())]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def _live(self) -> DataFrame:
        """The last state of each (document, tokenizer)."""
        last = F.max(F.struct("seq", "alive", "source", "lang", "n_tokens")).alias("last")
        return self._read("ledger", LEDGER).groupBy("doc_id", "tokenizer").agg(last).filter("last.alive").select(
            F.col("doc_id").alias("_doc"), F.col("tokenizer").alias("_tokenizer"), F.col("last.source").alias("_source"),
            F.col("last.lang").alias("_lang"), F.col("last.n_tokens").alias("_n"))

    def apply(self, batch_id: str, batch: DataFrame) -> bool:
        """Commit the changes of a batch; False if it was committed before."""
        commits = self._commits()
        if batch_id in commits:
            return False
        seq = len(commits) + 1
        order = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind"))
        ranked = stored(batch.select(  # counting may be costly, and the changes are read twice
            "doc_id", "tokenizer", "kind", "source", "lang", F.coalesce("n_tokens", F.lit(0)).alias("n_tokens"),
            order.cast("int").alias("_order")), "changes")
        one = ranked.filter("doc_id is not null").groupBy("doc_id", "tokenizer").agg(
            F.max(F.struct("_order", "n_tokens", "source", "lang", "kind")).alias("new")).select(
            "doc_id", "tokenizer", "new.kind", "new.source", "new.lang", "new.n_tokens")
        live = stored(self._live(), "live-counts") if commits else self._live()
        met = one.join(live, (one["doc_id"] == live["_doc"]) & one["tokenizer"].eqNullSafe(live["_tokenizer"]), "left")
        met = stored(met.filter("_doc is not null or kind = 'insert'"), "met-changes")
        target = f"{self.folder}/{{}}/batch={seq}"
        alive = F.col("kind") != "delete"
        met.select("doc_id", "tokenizer", "source", "lang", "n_tokens", alive.alias("alive"), F.lit(seq).alias("seq")
                   ).write.mode("overwrite").parquet(target.format("ledger"))

        def signed(source: str, lang: str, docs: Column, n: Column) -> Column:
            return F.struct(F.col(source).alias("source"), F.col(lang).alias("lang"), docs.cast("long").alias("n_docs"),
                            n.cast("long").alias("n_tokens"))

        come = F.when(alive, signed("source", "lang", F.lit(1), F.col("n_tokens")))
        gone = F.when(F.col("_doc").isNotNull(), signed("_source", "_lang", F.lit(-1), -F.col("_n")))
        known = met.select("tokenizer", F.explode(F.filter(F.array(come, gone), lambda d: d.isNotNull())).alias("d"))
        sign = F.when(F.col("kind") == "insert", 1).when(F.col("kind") == "delete", -1).otherwise(0)
        nameless = ranked.filter("doc_id is null").select("tokenizer", signed("source", "lang", sign, sign * F.col("n_tokens"))
                                                          .alias("d"))
        known.union(nameless).select("d.*", "tokenizer").groupBy("source", "lang", "tokenizer").agg(
            F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens")).select(
            "source", "lang", "tokenizer", "n_docs", "n_tokens").write.mode("overwrite").parquet(target.format("deltas"))
        self.spark.createDataFrame([(batch_id, seq)], "batch_id string, seq int").coalesce(1).write.mode(
            "overwrite").parquet(target.format("commits"))
        return True

    def totals(self) -> DataFrame:
        """``source``, ``lang``, ``tokenizer``, ``n_docs``, ``n_tokens`` of what is live now."""
        return self._read("deltas", DELTAS).groupBy("source", "lang", "tokenizer").agg(
            F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens")).filter("n_docs <> 0 or n_tokens <> 0")
