"""Values of formulas kept as Parquet, so that each is worked out once for the same data.

What is kept is named in a manifest, of which each version is a file that appears whole or not at all. Values that a manifest
doesn't name, as those of a write that was killed, are never read. Two writers can't commit the same version: the later one
takes up what the other has committed, and tries the next. Beyond a capacity the fifth that was put first is let go.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Sequence
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.metrics import daily_metrics
from ..operators.registry import CODE, DATE
from ..plans.compiler import evaluate
from ..plans.ir import key
from ..plans.parser import parse

#: Share of the entries that goes when there are too many.
GOES = 0.2
#: Versions of a manifest that stay, for readers that have begun with an older one.
VERSIONS = 3


def data_id(panel: DataFrame, domain: str) -> str:
    """What tells a panel's data apart: its domain and a digest of its rows in any order; one aggregation, with partial sums in each task."""
    columns = sorted(panel.columns)
    row = F.xxhash64(F.lit(",".join(columns)), *(F.struct(F.col(c).isNull(), F.col(c)) for c in columns))
    other = F.xxhash64(F.lit(1), row)
    n, *sums = panel.agg(F.count("*"), F.bit_xor(row), F.sum(row.cast("decimal(20,0)")), F.bit_xor(other), F.min(DATE), F.max(DATE)).first()
    return hashlib.sha256(":".join(map(str, (domain, n, *sums))).encode()).hexdigest()[:16]


def value_key(formula: str, data: str) -> str:
    """The key of a formula's values; formulas equal up to the order of commuting arguments share one."""
    return hashlib.sha256(f"{key(parse(formula))}|{data}".encode()).hexdigest()[:16]


def reward_key(formula: str, pool: Sequence[str]) -> str:
    """The key of a formula's reward beside a pool, whatever the order of the pool."""
    return hashlib.sha256(f"{key(parse(formula))}|{'|'.join(sorted(key(parse(p)) for p in pool))}".encode()).hexdigest()[:16]


class Files:
    """The few things that a manifest needs of a file system, by Hadoop, so that any store will do."""

    def __init__(self, spark: SparkSession, path: str):
        self.jvm, self.conf, self.gateway = spark._jvm, spark._jsc.hadoopConfiguration(), spark.sparkContext._gateway
        self.path = path
        self.system = self.at("").getFileSystem(self.conf)

    def at(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def names(self, folder: str) -> list[str]:
        at = self.at(folder)
        return [s.getPath().getName() for s in self.system.listStatus(at)] if self.system.exists(at) else []

    def read(self, name: str) -> str:
        stream = self.system.open(self.at(name))
        try:
            return bytes(self.jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()

    def put_new(self, name: str, text: str) -> bool:
        """A file that appears whole; False if there is one of the name."""
        temp = f"{name}.{uuid.uuid4().hex}.tmp"
        stream = self.system.create(self.at(temp), True)
        stream.write(bytearray(text.encode()))
        stream.close()
        none = self.gateway.new_array(self.jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.at("").toUri() if "://" in self.path else self.system.getUri(), self.conf).rename(self.at(temp), self.at(name), none)
        except Py4JJavaError as e:
            self.remove(temp)
            if "FileAlreadyExists" in str(e.java_exception.getClass().getName()):
                return False
            raise
        return True

    def remove(self, name: str) -> None:
        self.system.delete(self.at(name), True)


@dataclass(frozen=True)
class Entry:
    key: str
    #: The folder of the write that holds it.
    write: str


class Manifest:
    """Keys and where they lie, the oldest first."""

    def __init__(self, spark: SparkSession, path: str, folder: str, capacity: int | None):
        self.files, self.folder, self.capacity = Files(spark, path), folder, capacity

    def _versions(self) -> list[int]:
        return sorted(int(n[1:-5]) for n in self.files.names(f"manifest/{self.folder}") if n.endswith(".json"))

    def _name(self, version: int) -> str:
        return f"manifest/{self.folder}/v{version:09d}.json"

    def read(self) -> tuple[int, list[Entry]]:
        found = self._versions()
        return (found[-1], [Entry(*e) for e in json.loads(self.files.read(self._name(found[-1])))]) if found else (0, [])

    def commit(self, new: list[Entry]) -> None:
        """Add entries, those of a key that is there already replacing it; let the oldest go beyond the capacity."""
        while True:
            version, entries = self.read()
            taken = {e.key for e in new}
            kept = [e for e in entries if e.key not in taken] + new
            over = self.capacity is not None and len(kept) > self.capacity
            # those just put stay in any case
            out = kept[: min(max(int(self.capacity * GOES), len(kept) - self.capacity), len(kept) - len(new))] if over else []
            kept = kept[len(out) :]
            if self.files.put_new(self._name(version + 1), json.dumps([(e.key, e.write) for e in kept])):
                break
        gone = [e for e in entries if e not in kept]
        for e in gone:
            self.files.remove(f"{self.folder}/write={e.write}/key={e.key}")
        for old in self._versions()[:-VERSIONS]:
            self.files.remove(self._name(old))


class Store:
    """A folder of values by formula and one of their daily metrics; with a capacity, each holds about so many formulas."""

    def __init__(self, path: str, capacity: int | None = None):
        self.path, self.capacity = path, capacity

    def _manifest(self, spark: SparkSession, folder: str) -> Manifest:
        return Manifest(spark, self.path, folder, self.capacity)

    def present(self, spark: SparkSession, folder: str) -> dict[str, str]:
        """Keys that are there, and the write that holds each."""
        return {e.key: e.write for e in self._manifest(spark, folder).read()[1]}

    def _put(self, rows: DataFrame, folder: str, keys: Sequence[str]) -> None:
        write = uuid.uuid4().hex
        rows.write.partitionBy("key").parquet(f"{self.path}/{folder}/write={write}")
        self._manifest(rows.sparkSession, folder).commit([Entry(k, write) for k in keys])

    def _get(self, spark: SparkSession, folder: str, keys: Sequence[str], schema: str) -> DataFrame:
        have = self.present(spark, folder)
        paths = [f"{self.path}/{folder}/write={have[k]}/key={k}" for k in dict.fromkeys(keys)]
        return spark.read.schema(f"{schema}, write string, key string").option("basePath", f"{self.path}/{folder}").parquet(*paths).drop("write")

    def values(self, panel: DataFrame, formulas: Sequence[str], data: str) -> DataFrame:
        """date, code, expr and value of formulas; those that aren't there yet are computed in one plan and kept."""
        spark = panel.sparkSession
        keys = {f: value_key(f, data) for f in formulas}
        have = self.present(spark, "values")
        missing = {k: f for f, k in keys.items() if k not in have}
        if missing:
            made = evaluate(panel, {f"k{k}": f for k, f in missing.items()})
            long = made.unpivot([DATE, CODE], [f"k{k}" for k in missing], "key", "value")
            self._put(long.withColumn("key", F.substring("key", 2, 16)), "values", list(missing))
        names = spark.createDataFrame([(k, f) for f, k in keys.items()], "key string, expr string")
        kept = self._get(spark, "values", list(keys.values()), f"{DATE} date, {CODE} {dict(panel.dtypes)[CODE]}, value double")
        return kept.join(F.broadcast(names), "key").select(DATE, CODE, "expr", "value")  # a row for each formula

    def daily(self, frame: DataFrame, factors: dict[str, str], target: str, data: str) -> DataFrame:
        """date, expr, ic, ric and ret of formulas by the column of frame that has their values; new ones are kept."""
        spark = frame.sparkSession
        keys = {c: value_key(f, f"{data}:{target}") for c, f in factors.items()}
        have = self.present(spark, "daily")
        missing = [c for c, k in keys.items() if k not in have]
        names = spark.createDataFrame([(c, keys[c], f) for c, f in factors.items()], "factor string, key string, expr string")
        if missing:
            made = daily_metrics(frame, missing, target).join(F.broadcast(names.select("factor", "key")), "factor").drop("factor")
            self._put(made, "daily", [keys[c] for c in missing])
        kept = self._get(spark, "daily", list(keys.values()), f"{DATE} date, ic double, ric double, ret double")
        return kept.join(F.broadcast(names.select("key", "expr")), "key").select(DATE, "expr", "ic", "ric", "ret")


class Rewards:
    """Rewards of formulas beside a pool (correlation with the target, with the pool, consistency); beyond the capacity the fifth that was put first goes."""

    def __init__(self, capacity: int = 5000):
        self.capacity, self.held, self.hits, self.misses = capacity, {}, 0, 0

    def get(self, formula: str, pool: Sequence[str]) -> tuple[float, float, float] | None:
        found = self.held.get(reward_key(formula, pool))
        self.hits, self.misses = self.hits + (found is not None), self.misses + (found is None)
        return found

    def put(self, formula: str, pool: Sequence[str], ic: float, mutual: float, consistency: float = 0.0) -> None:
        self.held[reward_key(formula, pool)] = (ic, mutual, consistency)
        if len(self.held) > self.capacity:
            for k in list(self.held)[: max(1, int(self.capacity * GOES))]:
                del self.held[k]

    @property
    def hit_rate(self) -> float:
        return self.hits / (self.hits + self.misses) if self.hits + self.misses else 0.0
