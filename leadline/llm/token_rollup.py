"""Token counts kept as delta-maintained rollups.

Every batch of events (insert, delete, revise) becomes signed rows. A delete takes back what the
document last counted, a revision takes it back and adds the new count. Signed rows are written
per document (the log) and summed per (source, lang, tokenizer_version) (the totals), each under
the batch's number. Totals are additive: the rollup is the sum of all batches' totals.

A batch is computed from the batches before it and overwrites its own folders. Its marker is written
last and holds a digest of its events, so any batch may be committed again: with equal events nothing
happens, and with other events the batch and all later ones, whose events are kept, are worked out
anew. Readers see the batches up to the first one that is not done, so a commit cut off by a lost
driver is never seen in part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leadline.session import stage

KEYS = ("source", "lang", "tokenizer_version")
_COUNTS = "source string, lang string, tokenizer_version string, docs bigint, tokens bigint"
_TABLES = {
    "log": f"doc_id string, {_COUNTS}",
    "snapshot": f"doc_id string, {_COUNTS}",
    "totals": _COUNTS,
    "events": "op string, doc_id string, source string, lang string, tokenizer_version string, n_tokens bigint",
    "marker": "state string, digest string",
}
# States of a batch. Events of an open batch may not be whole; those of a stale one are.
OPEN, STALE, DONE = "open", "stale", "done"


class Rollup:
    """A rollup in a folder that all executors share, used by one writer at a time.

    Every ``snapshot_every`` batches the documents' counts are written as a whole, so that a commit
    reads the last snapshot and the log after it, not the log from its beginning.
    """

    def __init__(self, spark: SparkSession, path: str, snapshot_every: int = 16):
        self.spark, self.path, self.snapshot_every = spark, path, snapshot_every
        # An empty batch 0 makes the tables readable before the first commit.
        for name, schema in _TABLES.items():
            spark.createDataFrame([], schema).write.mode("ignore").parquet(f"{path}/{name}/batch=0")

    def _read(self, name: str) -> DataFrame:
        return self.spark.read.schema(f"{_TABLES[name]}, batch bigint").parquet(f"{self.path}/{name}")

    def _write(self, name: str, batch: int, rows: DataFrame) -> None:
        rows.write.mode("overwrite").parquet(f"{self.path}/{name}/batch={batch}")

    def _mark(self, batch: int, state: str, digest: str = "") -> None:
        row = self.spark.range(0, 1, 1, 1).select(F.lit(state).alias("state"), F.lit(digest).alias("digest"))
        self._write("marker", batch, row)

    def _markers(self) -> dict[int, tuple[str, str]]:
        """(state, digest) per batch, in order; one small row a batch."""
        return {r["batch"]: (r["state"], r["digest"]) for r in self._read("marker").orderBy("batch").collect()}

    def _done(self, before: int | None = None) -> list[int]:
        out = []
        for batch, (state, _) in self._markers().items():
            if state != DONE or (before is not None and batch >= before):
                break
            out.append(batch)
        return out

    def current(self, before: int | None = None, ids: DataFrame | None = None) -> DataFrame:
        """What each document counts after the batches before ``before``: doc_id, KEYS, docs, tokens.

        With ``ids`` (doc_id) only these documents are summed.
        """
        done = self._done(before)
        base = max((b for b in done if b % self.snapshot_every == 0), default=0)
        parts = []
        for name, batches in (("snapshot", [base]), ("log", [b for b in done if b > base])):
            rows = self._read(name).where(F.col("batch").isin(batches))  # prunes folders
            parts.append(rows.join(ids, "doc_id", "left_semi") if ids is not None else rows)
        return (
            parts[0].unionByName(parts[1])
            .groupBy("doc_id", *KEYS)
            .agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))
            .where((F.col("docs") != 0) | (F.col("tokens") != 0))
        )

    def commit(self, batch: int, events: DataFrame) -> None:
        """Commit ``events`` (op, doc_id, source, lang, tokenizer_version, n_tokens) as number ``batch``.

        Batches are numbered from 1 and count in the order of their numbers, in whatever order they
        are committed. A number may be committed again, also an earlier one; see the module's text.
        After a commit that was cut off, commit the same batch again: a later one is refused.
        ``insert`` adds a document; of a document that is there already it is a revision.
        ``delete`` and ``revise`` of an unknown document: nothing, and an insert. One event
        per document and batch counts; repeated rows count once, and of different ones the
        largest (op, keys, count) counts. Events without a doc_id or with another op are not
        counted. A null count is 0; null keys are a group of their own.
        """
        if batch < 1:
            raise ValueError("batches are numbered from 1")
        fields = ["op", *KEYS, "n_tokens"]
        one = stage(
            events.where(F.col("doc_id").isNotNull() & F.col("op").isin("insert", "delete", "revise"))
            .withColumn("n_tokens", F.coalesce(F.col("n_tokens").cast("long"), F.lit(0)))
            .groupBy(F.col("doc_id").cast("string").alias("doc_id"))
            .agg(F.max(F.struct(*fields)).alias("e"))
            .select("e.op", "doc_id", *[f"e.{c}" for c in fields[1:]])
        )
        digest = _digest(one)
        markers = self._markers()
        cut = [b for b, (state, _) in markers.items() if state == OPEN and b < batch]
        if cut:
            raise RuntimeError(f"batch {cut[0]} was cut off; commit it again first")
        if markers.get(batch) != (DONE, digest):
            self._mark(batch, OPEN, digest)
            for later, (state, old) in markers.items():
                if later > batch and state == DONE:
                    self._mark(later, STALE, old)
            self._write("events", batch, one)
            self._mark(batch, STALE, digest)
        for number, (state, known) in self._markers().items():
            if state == OPEN:
                break
            if state == STALE:
                self._work_out(number)
                self._mark(number, DONE, known)

    def _work_out(self, batch: int) -> None:
        """Log, totals and, where due, the snapshot of a batch from its events and the batches before."""
        one = self._read("events").where(F.col("batch") == batch).drop("batch")
        taken_back = self.current(batch, one.select("doc_id")).select(
            "doc_id", *KEYS, (-F.col("docs")).alias("docs"), (-F.col("tokens")).alias("tokens")
        )
        added = one.where(F.col("op") != "delete").select(
            "doc_id", *KEYS, F.lit(1).cast("long").alias("docs"), F.col("n_tokens").alias("tokens")
        )
        self._write("log", batch, taken_back.unionByName(added))
        signed = self._read("log").where(F.col("batch") == batch)
        sums = [F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens")]
        self._write("totals", batch, signed.groupBy(*KEYS).agg(*sums))
        if batch % self.snapshot_every == 0:
            state = self.current(batch).unionByName(signed.drop("batch")).groupBy("doc_id", *KEYS).agg(*sums)
            self._write("snapshot", batch, state.where((F.col("docs") != 0) | (F.col("tokens") != 0)))

    def totals(self, upto: int | None = None) -> DataFrame:
        """KEYS, docs and tokens after batch ``upto`` (default: all); groups without documents go."""
        rows = self._read("totals").where(F.col("batch").isin(self._done(None if upto is None else upto + 1)))
        return rows.groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens")).where(F.col("docs") != 0)


def _digest(events: DataFrame) -> str:
    """A digest of a set of events, whatever their order."""
    columns = [F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in events.columns]
    low, high = F.xxhash64(*columns), F.xxhash64(F.lit(1), *columns)
    row = events.agg(
        F.count(F.lit(1)).alias("n"), F.sum(low.cast("decimal(38,0)")).alias("sum"), F.bit_xor(high).alias("xor")
    ).first()
    return f"{row['n']}:{row['sum']}:{row['xor']}"


def counted(text: Column, pattern: str) -> Column:
    """Tokens of a regular expression in a text; null has none."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(pattern)).cast("long")
