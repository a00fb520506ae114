"""Translations remembered from run to run: a versioned table of answers, keyed by all that an answer hangs on."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from .glossary import Entries, settle
from .pages import kept, tasks

SCHEMA = "key string, raw string, dst string, engine string, warn string"
#: Bits of the marks that tell most known texts from unknown ones; 8 MB, whatever the tables.
BITS = 1 << 26


@dataclass(frozen=True)
class Run:
    """What answers hang on besides their text."""

    lang: str = "zh-CN"
    engine: str = "engine"
    model: str = ""
    codes: bool = True


def entries_fingerprint(spark: SparkSession, entries: Entries) -> str:
    """The glossary's fingerprint, as ``glossary.fingerprint`` gives it for a table of the same entries."""
    if not entries:
        return "0"
    listed = "\x03".join(f"{term}\x02{to}\x02{int(keep)}" for term, to, keep in entries)
    return spark.range(1).select(T.fnv1a(F.lit(listed))).first()[0]


def cache_key(raw: Column, run: Run, fingerprint: str) -> Column:
    """A digest (128 bits of SHA-256) of language, engine, model, glossary, whether codes are masked, and the text: a change of any asks anew."""
    whole = T.cache_key(raw, F.lit(run.lang), F.lit(run.engine), F.lit(run.model), F.lit(fingerprint), F.lit(run.codes))
    return F.base64(F.unhex(F.left(F.sha2(whole.cast("binary"), 256), F.lit(32))))


class Memory:
    """Answers in Parquet under one folder, a subfolder ``version=N`` for each published run.

    A version is written beside the others under a name that no reader looks at and then renamed, so readers see all of it or nothing,
    and a job that dies leaves nothing to be read. Of two writers one gets the number and the other takes the next. A version holds
    the new answers alone; of several for one key the newest counts. ``fold`` writes what counts as one further version and
    marks it as a whole, so later reads begin there; older versions stay until ``prune``, for readers that began before. A version
    that is published during a fold under a smaller number is passed over from then on: its texts are asked for again.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _fs(self):
        root = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return root.getFileSystem(self.spark._jsc.hadoopConfiguration()), root

    def versions(self) -> list[tuple[int, bool]]:
        """Numbers of the published versions, in order, and whether each is a whole (folded) one."""
        fs, root = self._fs()
        names = [s.getPath().getName() for s in fs.listStatus(root)] if fs.exists(root) else []
        found = [n.split("=")[1].split("-") for n in names if n.startswith("version=")]
        return sorted((int(n[0]), len(n) > 1) for n in found)

    def read(self) -> DataFrame:
        """The answer that counts for each key (columns of ``SCHEMA``); empty before the first run."""
        known = self.versions()
        start = max((i for i, (_, whole) in enumerate(known) if whole), default=0)
        parts = [self.spark.read.schema(SCHEMA).parquet(self._name(n, whole)).withColumn("version", F.lit(n)) for n, whole in known[start:]]
        if not parts:
            return self.spark.createDataFrame([], SCHEMA)
        rows = parts[0]
        for p in parts[1:]:
            rows = rows.unionByName(p)
        if len(parts) == 1:
            return rows.drop("version")  # one version holds a key once
        again = rows.groupBy("key").agg(F.max("version").alias("newest"), F.count("*").alias("n")).where("n > 1").select("key", "newest")
        if again.isEmpty():
            return rows.drop("version")  # as do several, unless writers overlapped: no answer is moved
        return rows.join(again, "key", "left").where("newest IS NULL OR version = newest").drop("version", "newest")

    def _name(self, n: int, whole: bool) -> str:
        return f"{self.path}/version={n:08d}{'-whole' if whole else ''}"

    def publish(self, answers: DataFrame, whole: bool = False) -> int | None:
        """Make ``answers`` (columns of ``SCHEMA``) the next version; its number, or None where there is nothing to publish."""
        return self._publish(answers.groupBy("key").agg(F.min(F.struct("raw", "dst", "engine", "warn")).alias("r")).select("key", "r.*"), whole)

    def _publish(self, one: DataFrame, whole: bool = False) -> int | None:
        waiting = self._waiting()
        one.write.option("compression", "zstd").parquet(waiting)
        if self.spark.read.schema(SCHEMA).parquet(waiting).isEmpty():
            self._fs()[0].delete(self._at(waiting), True)
            return None
        return self._claim(waiting, whole)

    def _at(self, path: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(path)

    def _waiting(self) -> str:
        return f"{self.path}/_waiting-{uuid.uuid4().hex}"

    def _claim(self, waiting: str, whole: bool = False) -> int:
        """Give what is ``waiting`` the next number."""
        fs, _ = self._fs()
        n = max((v for v, _ in self.versions()), default=0) + 1
        while not (fs.createNewFile(self._at(f"{self.path}/_claim-{n:08d}")) and fs.rename(self._at(waiting), self._at(self._name(n, whole)))):
            n += 1  # another writer has claimed this number, whether it lives or not
        return n

    def keep(self, results: DataFrame) -> DataFrame:
        """``results`` (key as bytes, dst, engine, warn, origin; a row a key), computed and written once: what an engine answered is the next version, the rest is checkpointed."""
        fs, _ = self._fs()
        waiting = self._waiting()
        answered = (F.col("origin") == "engine") & (F.col("engine") != "failed")
        results.withColumns({"key": F.base64("key"), "answered": answered}).write.partitionBy("answered").option("compression", "zstd").parquet(waiting)
        found = [f"{waiting}/answered={x}" for x in ("true", "false")]
        new, rest = (fs.exists(self._at(f)) for f in found)
        schema = "key string, dst string, engine string, warn string, origin string"
        out = kept(self.spark.read.schema(schema).parquet(found[1])) if rest else self.spark.createDataFrame([], schema)
        if new:
            n = self._claim(found[0])
            out = out.unionByName(self.spark.read.schema(schema).parquet(self._name(n, False)))
        fs.delete(self._at(waiting), True)
        return out.withColumn("key", F.unbase64("key"))

    def fold(self) -> int | None:
        """One whole version of all that counts."""
        return self._publish(self.read(), whole=True)

    def delete(self) -> None:
        fs, root = self._fs()
        fs.delete(root, True)

    def prune(self) -> None:
        """Delete the versions before the last whole one; only when no reader is left that began before it was published."""
        fs, _ = self._fs()
        known = self.versions()
        last = max((n for n, whole in known if whole), default=0)
        for n, whole in known:
            if n < last:
                fs.delete(self._at(self._name(n, whole)), True)


def _maybe(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """``rows`` (with ``key``) without most of those whose key is not in ``keys``, and with all others.

    Hashes of the keys are marked in bitmaps of at most ``BITS`` bits together, which every task gets, so no row is moved.
    """
    place = F.pmod(F.xxhash64("key"), F.lit(BITS)) + 1
    marks = keys.select(place.alias("p")).groupBy(F.bitmap_bucket_number("p").alias("_bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("_bits"))
    at = F.bitmap_bit_position(place)
    byte = F.conv(F.hex(F.substring("_bits", (at / 8).cast("int") + 1, 1)), 16, 10).cast("int")
    met = rows.withColumn("_bucket", F.bitmap_bucket_number(place)).join(F.broadcast(marks), "_bucket")
    return met.where((byte / F.pow(F.lit(2), at % 8)).cast("int") % 2 == 1).select(*rows.columns)


def translate_remembered(texts: DataFrame, entries: Entries, engine: Callable[[list[str]], list[str | None]], memory: Memory, run: Run = Run(), column: str = "src", batch: int = 24) -> DataFrame:
    """``translate`` that asks only for what ``memory`` does not hold, and publishes the answers that it got.

    Adds ``origin``: ``memory``, ``engine`` or ``rule`` (settled without either). Keys meet the memory without their texts; only texts that may be
    unknown are moved, once. Answers that failed are not remembered, so the next run asks again. Published before the result is returned, so a
    later failure does not lose what was paid for; the result reads the versions that it met, so it is to be read before they are pruned.
    """
    spark = texts.sparkSession
    mark = entries_fingerprint(spark, entries)
    raw = F.trim(F.coalesce(F.col(column), F.lit("")))
    keyed = texts.withColumn("_key", F.unbase64(cache_key(raw, run, mark)))  # bytes are a third shorter on their way
    known = memory.read().select(F.unbase64("key").alias("key"), "dst", "engine", "warn")
    results, once = known.withColumn("origin", F.lit("memory")), keyed.select(F.col("_key").alias("key"), raw.alias("raw"))
    unknown = None
    if memory.versions():
        unknown = kept(once.select("key").distinct().join(known.select("key"), "key", "left_anti"))
        once = _maybe(once, unknown)
    if unknown is None or not unknown.isEmpty():
        once = once.repartition(tasks(spark), "key").dropDuplicates(["key"])  # stated: patterns cost more than bytes
        once = once if unknown is None else once.join(unknown, "key", "left_semi")
        results = results.unionByName(memory.keep(settle(once, entries, engine, run.engine, batch, run.codes)))
    return keyed.join(results.withColumnRenamed("key", "_key"), "_key").drop("_key")
