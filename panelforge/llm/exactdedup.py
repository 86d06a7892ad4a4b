"""Exact dedup against a persistent index of digests, in DataFrame operations alone.

Texts are equal if they are identical once every white space character of [\\x20\\x09-\\x0D] is taken out. Of equal texts that
with the most code points stays (counted before), then that with the smallest doc_id, then the earliest row.

The index is a table bucketed and sorted by digest. Rows come in arrivals. An arrival is summed up by digest, so however
often a text occurs it is one row a task; what a sort-merge anti-join with the index leaves is new, and appended. The index's
side of that join is neither shuffled nor read whole into a task. Copies of texts that the index has are logged beside it, one
row a digest and arrival, bucketed alike, as a later copy may be the longer one. An arrival that is added again changes nothing.

A null text counts as empty; all texts without other characters are equal. Rows with a null doc_id take part and are the last
choice among equal lengths. Rows that repeat a doc_id are rows of their own: one row of each group stays. Texts of any length are read whole;
bytes that are no UTF-8 count as replacement characters. An empty table gives an empty result. Other columns are
ignored by digests(); without_copies() keeps them, whatever their names.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh_path, parallelism, valid_text, written

ENTRY = "digest binary, arrival int, row long, doc_id long, n_chars int, n_rows long"
#: The index of digests, and the log of copies that came after them.
TABLES = ("digests", "copies")


def digest_of(text: Column) -> Column:
    """SHA-256 of a text without its white space."""
    return F.unhex(F.sha2(F.regexp_replace(text, "[\\x20\\x09-\\x0D]+", ""), 256))


def digests(docs: DataFrame, arrival: Column | None = None, row: Column | None = None) -> DataFrame:
    """arrival, row, doc_id, n_chars and digest of each row, as a table; row tells rows of it apart."""
    text = F.coalesce("text", F.lit(""))
    row = F.monotonically_increasing_id() if row is None else row
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), valid_text(), (F.lit(0) if arrival is None else arrival).cast("int").alias("arrival"), row.alias("row"))
    return written(rows.select("arrival", "row", "doc_id", F.length(text).alias("n_chars"), digest_of(text).alias("digest")), "digest-rows")


def choice(*more: str) -> Column:
    """Orders equal texts: the first one stays."""
    return F.struct((-F.col("n_chars")).alias("less"), F.col("doc_id").isNull().alias("unknown"), "doc_id", "arrival", "row", *more)


class DigestIndex:
    """An index of digests in a folder that all executors reach; an index that is there already is opened."""

    def __init__(self, spark: SparkSession, path: str, buckets: int | None = None):
        self.spark, self.path = spark, path
        own = self._folder()
        self.buckets = int(own) if own else buckets or parallelism(spark)
        id_ = hashlib.sha256(path.encode()).hexdigest()[:16]
        self.names = {t: f"panelforge_{t}_{id_}" for t in TABLES}
        for t, name in self.names.items():
            spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({ENTRY.replace('row long', '`row` long')}) USING parquet CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS LOCATION '{self.path}/{self.buckets}/{t}'")

    def _folder(self) -> str | None:
        """The number of buckets of an index that is there; it names the folder."""
        at = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        files = at.getFileSystem(self.spark._jsc.hadoopConfiguration())
        return next((s.getPath().getName() for s in files.listStatus(at) if s.getPath().getName().isdigit()), None) if files.exists(at) else None

    def entries(self, table: str = "digests") -> DataFrame:
        return self.spark.table(self.names[table])

    def _append(self, rows: DataFrame, table: str) -> None:
        rows.select("digest", "arrival", "row", "doc_id", "n_chars", "n_rows").write.mode("append").format("parquet").bucketBy(self.buckets, "digest").sortBy("digest").saveAsTable(self.names[table])

    def unseen(self, rows: DataFrame) -> DataFrame:
        """Rows (one a digest, dealt by it) whose digest the index has not."""
        return rows.join(self.entries().select("digest").hint("merge"), "digest", "left_anti")

    def add(self, rows: DataFrame, arrival: int) -> None:
        """Take in the rows of an arrival (see digests()). One that is there already changes nothing, so it can be run again after a failure."""
        # summed in each task first, then dealt as the index is
        best = rows.where(F.col("arrival") == arrival).groupBy("digest").agg(F.min(choice()).alias("best"), F.count("*").alias("n_rows"))
        best = written(best.select("digest", "best.arrival", "best.row", "best.doc_id", (-F.col("best.less")).alias("n_chars"), "n_rows"), "arrival").repartition(self.buckets, "digest")
        there = {t: bool(self.entries(t).where(F.col("arrival") == arrival).limit(1).count()) for t in TABLES}
        known = self.entries().where(F.col("arrival") < arrival).select("digest").hint("merge")
        if not there["copies"]:
            self._append(best.join(known, "digest", "left_semi"), "copies")
        if not there["digests"]:
            self._append(self.unseen(best), "digests")

    def kept(self) -> DataFrame:
        """digest, keep_id, group_size and the place (arrival, row) of the row that stays, of all arrivals."""
        # both are bucketed by digest: neither is shuffled
        later = self.entries("copies").groupBy("digest").agg(F.min(choice()).alias("later"), F.sum("n_rows").alias("more"))
        both = self.entries().join(later.hint("merge"), "digest", "left")
        best = both.select("digest", F.least(choice(), "later").alias("best"), (F.col("n_rows") + F.coalesce("more", F.lit(0))).alias("group_size"))
        return best.select("digest", F.col("best.doc_id").alias("keep_id"), "group_size", F.struct("best.arrival", "best.row").alias("place"))

    def resolve(self, rows: DataFrame) -> DataFrame:
        """For each row that was added: doc_id, keep_id, group_size, kept and digest, besides arrival and row."""
        # a table on either side: Spark can split the rows of a text that very many have
        kept = written(self.kept(), "kept")
        same = F.struct("arrival", "row") == F.col("place")
        return rows.join(kept, "digest").select("doc_id", "keep_id", "group_size", same.alias("kept"), "digest", "arrival", "row")

    def drop(self) -> None:
        """Forget the tables' names; the files stay, and are found again by their path."""
        for name in self.names.values():
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")


def arrivals(docs: DataFrame) -> Column:
    """Documents in two arrivals by doc_id: those up to the middle of its range, and the later ones; null ones are early."""
    lo, hi = docs.agg(F.min(F.col("doc_id").cast("long")), F.max(F.col("doc_id").cast("long"))).first()
    return F.coalesce((F.col("doc_id") > (F.lit(lo) + F.lit(hi)) / 2).cast("int"), F.lit(0)) if lo is not None else F.lit(0)


def classify(docs: DataFrame) -> DataFrame:
    """doc_id, keep_id, group_size, kept, digest and place of every row, by an index that two arrivals build from nothing."""
    rows = digests(docs, arrivals(docs))
    index = DigestIndex(docs.sparkSession, fresh_path(docs.sparkSession, "digest-index"))
    for arrival in (0, 1):
        index.add(rows, arrival)
    found = index.resolve(rows)
    index.drop()
    return found


def without_copies(docs: DataFrame, index: DigestIndex, arrival: int) -> DataFrame:
    """The rows of an arrival whose text neither the index nor a better row of the arrival has; the index takes them in.

    An arrival that is run again gives the same rows."""
    taken = {c.lower() for c in docs.columns}
    place = "place"
    while place in taken:
        place = f"_{place}"
    marked = written(docs.withColumn(place, F.monotonically_increasing_id()), "marked")
    rows = digests(marked, F.lit(arrival), F.col(place))
    index.add(rows, arrival)
    new = index.entries().where(F.col("arrival") == arrival).select(F.col("digest").alias("d"), F.col("doc_id").alias("i"), F.col("n_chars").alias("n"))
    best = rows.join(new, (rows["digest"] == new["d"]) & (rows["n_chars"] == new["n"]) & rows["doc_id"].eqNullSafe(new["i"])).groupBy("digest").agg(F.min("row").alias("best"))
    return marked.join(best, marked[place] == best["best"], "left_semi").drop(place)
