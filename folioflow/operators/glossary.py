"""Glossaries, protected codes and the route that a text takes to its translation."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .pages import kept, tasks

#: Term, target, and whether the term is to stay as it is.
Entries = list[tuple[str, str, bool]]
#: Separators in the order in which they are tried, and words for "leave as it is".
SEPARATORS = ("=>", "＝>", "->", "→", "::", "＝", "=")
KEEP = r"(?i)^(原样|保持原样|keep|keep as is|keep as-is|不译|不翻译|-|—)$"


def parse_glossary(lines: DataFrame, line: str = "line") -> DataFrame:
    """``term, target, keep`` of each entry; blank lines and comments are dropped."""
    s = F.trim(F.regexp_replace(F.col(line), r"^\s+|\s+$", ""))
    at, width = F.lit(None).cast("int"), F.lit(0)
    for sep in reversed(SEPARATORS):
        here = F.instr(s, F.lit(sep)) > 1
        at, width = F.when(here, F.instr(s, F.lit(sep))).otherwise(at), F.when(here, len(sep)).otherwise(width)
    term = F.trim(F.when(at.isNull(), s).otherwise(F.substring(s, F.lit(1), at - 1)))
    target = F.trim(F.when(at.isNull(), F.lit("")).otherwise(F.substring(s, at + width, F.length(s))))
    rows = lines.where((s != "") & ~s.rlike("^(#|//)")).withColumn("term", term).withColumn("target", target)
    return rows.where("term <> ''").withColumn("keep", (F.col("target") == "") | F.col("target").rlike(KEEP))


def _folded(text: str) -> str:
    """Lower case, character by character, so that places stay what they are."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


class Terms:
    """A glossary of any size as an automaton: one pass over a text finds all terms, of which the longest at each place counts.

    Case does not matter. A side of a term that ends in a word character needs a word boundary there; where the longest term has
    none, a shorter one at the same place may. Found terms are taken from left to right, none within another.
    """

    WORD = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789_")

    def __init__(self, entries: Entries):
        import ahocorasick

        self.machine = ahocorasick.Automaton()
        for term, to, keep in entries:
            if term and not keep and _folded(term) not in self.machine:  # the first of equal terms counts
                self.machine.add_word(_folded(term), (len(term), term[0] in self.WORD, term[-1] in self.WORD, to))
        if len(self.machine):
            self.machine.make_automaton()

    def found(self, text: str) -> list[tuple[int, int, str]]:
        """Start, end and replacement of each term that counts, in order."""
        if not len(self.machine):
            return []
        best: dict[int, tuple[int, str]] = {}
        word, n = self.WORD, len(text)
        for last, (size, head, tail, to) in self.machine.iter(_folded(text)):
            start, end = last - size + 1, last + 1
            if not (head and start and text[start - 1] in word) and not (tail and end < n and text[end] in word):
                best[start] = (end, to)  # ends come in order, so a later one is longer
        out, at = [], 0
        for start in sorted(best):
            if start >= at:
                out.append((start, *best[start]))
                at = best[start][0]
        return out

    def put(self, text: str) -> str:
        at, out = 0, []
        for start, end, to in self.found(text):
            out += [text[at:start], to]
            at = end
        return "".join([*out, text[at:]]) if out else text


_TERMS: dict[str, Terms] = {}


def _terms(entries: Entries, name: str) -> Terms:
    """One automaton for each glossary in a Python worker, the last used one alone."""
    if name not in _TERMS:
        _TERMS.clear()
        _TERMS[name] = Terms(entries)
    return _TERMS[name]


def apply_glossary(column: Column, entries: Entries) -> Column:
    """Replace terms in one left-to-right scan (what was put in is not scanned again); ``keep`` entries stay.

    A glossary is a list on the driver, sent with the tasks, so it is to have some hundred thousand entries at most. A single term runs
    inside the JVM; more go through an automaton in Arrow batches, whose time does not hang on how many there are.
    """
    put = [(t.strip(), to, keep) for t, to, keep in entries if t.strip() and not keep]
    if not put:
        return F.coalesce(column, F.lit(""))
    if len(put) == 1:
        (term, to, _), word = put[0], "[A-Za-z0-9_]"
        head, tail = (word if re.match(word, end) else "" for end in (term[0], term[-1]))
        pattern = (f"(?<!{head})" if head else "") + re.escape(term) + (f"(?!{tail})" if tail else "")
        return F.regexp_replace(F.coalesce(column, F.lit("")), "(?i)" + pattern, F.lit(re.sub(r"([\\$])", r"\\\1", to)))
    name = hashlib.sha256(repr(put).encode()).hexdigest()

    @F.pandas_udf("string")
    def scan(s: pd.Series) -> pd.Series:
        return s.fillna("").map(_terms(put, name).put)

    return scan(column)


def term_hits(texts: DataFrame, entries: Entries, column: str = "line") -> DataFrame:
    """``texts`` with a row for each term that counts: ``start, end`` (code points, end exclusive) and ``target``."""
    name = hashlib.sha256(repr(entries).encode()).hexdigest()

    @F.pandas_udf("array<struct<start:int,end:int,target:string>>")
    def hits(s: pd.Series) -> pd.Series:
        return s.fillna("").map(lambda t: [{"start": a, "end": b, "target": to} for a, b, to in _terms(entries, name).found(t)])

    return texts.withColumn("_hit", F.explode(hits(F.col(column)))).select(*[c for c in texts.columns], "_hit.start", "_hit.end", "_hit.target")


def glossary_prompt(entries: DataFrame, *by: str) -> DataFrame:
    """One text for each glossary (``by``): the terms to map, then the terms to keep, in order of their line."""
    pair = F.concat(F.col("term"), F.lit(" => "), F.col("target"))
    maps = F.array_sort(F.collect_list(F.when(~F.col("keep"), F.struct("no", pair.alias("t")))))
    keeps = F.array_sort(F.collect_list(F.when(F.col("keep"), F.struct("no", F.col("term").alias("t")))))
    return entries.groupBy(*by).agg(F.concat_ws("\n", F.transform(maps, lambda x: x["t"])).alias("map_block"), F.concat_ws("\n", F.transform(keeps, lambda x: x["t"])).alias("keep_block"))


def keep_list(entries: DataFrame, *by: str) -> DataFrame:
    """Terms that are to stay as they are, in order of their line."""
    return entries.where(F.col("keep") & (F.trim("term") != "")).select(*by, "no", F.trim("term").alias("term"))


def fingerprint(entries: DataFrame, *by: str) -> DataFrame:
    """One short text for each glossary (``by``) that changes with any entry: part of what a remembered translation hangs on; ``0`` without entries."""
    entry = F.concat_ws("\x02", F.coalesce("term", F.lit("")), F.coalesce("target", F.lit("")), F.when(F.col("keep"), "1").otherwise("0"))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("no", entry.alias("e")))), lambda x: x["e"])
    return entries.groupBy(*by).agg(listed.alias("l")).select(*by, F.when(F.size("l") == 0, "0").otherwise(T.fnv1a(F.array_join("l", "\x03"))).alias("fingerprint"))


def route(texts: DataFrame, entries: Entries, column: str = "src", dictionary_only: bool = False, codes: bool = True) -> DataFrame:
    """``route, dst, payload, codes``: what needs no engine is settled here, the rest gets a masked payload (bare without ``codes``).

    In order: blank, mostly Han, dictionary mode, wholly covered by the glossary, nothing left to translate once codes are masked; else send.
    """
    raw = F.coalesce(F.col(column), F.lit(""))
    masked = T.protected(raw) if codes else F.struct(F.array().cast("array<string>").alias("codes"), raw.alias("masked"))
    rows = texts.withColumn("_g", apply_glossary(raw, entries)).withColumn("_p", masked)
    rows = rows.withColumn("codes", F.col("_p.codes")).withColumn("payload", F.col("_p.masked")).drop("_p")
    covered = (F.col("_g") != raw) & ~F.col("_g").rlike("[A-Za-z]")
    way = F.when(F.trim(raw) == "", "blank").when(T.is_mostly_han(raw), "han").when(F.lit(dictionary_only), "dict").when(covered, "glossary").when(~F.col("payload").rlike("[A-Za-z]"), "codes").otherwise("send")
    rows = rows.withColumn("route", way)
    done = F.when(F.col("route") == "blank", "").when(F.col("route").isin("han", "codes"), raw).when(F.col("route").isin("dict", "glossary"), F.col("_g"))
    return rows.withColumn("dst", done).drop("_g")


def results_of(raws: DataFrame, entries: Entries, engine: Callable[[list[str]], list[str | None]], engine_name: str = "engine", batch: int = 24, cache: DataFrame | None = None, codes: bool = True) -> DataFrame:
    """``raw, dst, engine, warn, origin`` of each distinct ``raw``; ``origin`` is ``rule``, ``engine`` or ``memory`` (from ``cache``)."""
    spark = raws.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)  # stated: patterns cost more than bytes
    distinct = raws.select("raw").repartition(n, "raw").distinct()
    known = None
    if cache is not None:
        cache = cache.groupBy("raw").agg(F.min(F.struct("dst", "engine", "warn")).alias("r")).select("raw", "r.*")  # a row a text
        known = distinct.join(cache, "raw").select("raw", "dst", "engine", "warn", F.lit("memory").alias("origin"))
        distinct = distinct.join(cache.select("raw"), "raw", "left_anti")
    routed = kept(route(distinct, entries, "raw", codes=codes).select("raw", "route", "dst", "payload", "codes"))
    named = F.when(F.col("route").isin("dict", "glossary"), "glossary").otherwise("skip").alias("engine")
    settled = routed.where("route <> 'send'").select("raw", "dst", named, F.lit("").alias("warn"), F.lit("rule").alias("origin"))

    def send(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for a in range(0, len(frame), batch):
                part = frame["payload"].iloc[a : a + batch].tolist()
                reply = list(engine(part))
                reply = reply if len(reply) == len(part) else [r for p in part for r in engine([p])]
                out += reply
            yield frame.assign(reply=out)

    schema = "raw string, payload string, codes array<string>, reply string"
    answered = kept(routed.where("route = 'send'").select("raw", "payload", "codes").mapInPandas(send, schema))
    restored = answered.withColumn("_r", T.restore_codes(F.col("reply"), F.col("codes")))
    empty = F.col("reply").isNull() | (F.trim(F.coalesce(F.col("reply"), F.lit(""))) == "")
    warn = F.when(empty, "empty reply").otherwise(T.residue(F.col("_r"), F.col("codes")))
    by = F.when(warn == "empty reply", "failed").otherwise(engine_name)
    sent = restored.select("raw", T.cleanup_punct(apply_glossary(F.col("_r"), entries)).alias("dst"), by.alias("engine"), warn.alias("warn"), F.lit("engine").alias("origin"))
    results = settled.unionByName(sent)
    return results if known is None else results.unionByName(known)


def settle(distinct: DataFrame, entries: Entries, engine: Callable[[list[str]], list[str | None]], engine_name: str = "engine", batch: int = 24, codes: bool = True) -> DataFrame:
    """``key, dst, engine, warn, origin`` of each row (key as bytes, raw) in one pass: ``rule`` where no engine is needed, else ``engine``.

    Nothing is checkpointed here: who reads it twice asks twice.
    """
    routed = route(distinct, entries, "raw", codes=codes)
    sent = F.col("route") == "send"
    asked = routed.select("key", "route", "dst", F.when(sent, F.col("payload")).alias("payload"), F.when(sent, F.col("codes")).alias("codes"))

    def send(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out, mine = [None] * len(frame), np.flatnonzero(frame["route"].to_numpy() == "send").tolist()
            for a in range(0, len(mine), batch):
                part = [frame["payload"].iat[i] for i in mine[a : a + batch]]
                reply = list(engine(part))
                reply = reply if len(reply) == len(part) else [r for p in part for r in engine([p])]
                for i, r in zip(mine[a : a + batch], reply):
                    out[i] = r
            yield frame.drop(columns="payload").assign(reply=out)

    answered = asked.mapInPandas(send, "key binary, route string, dst string, codes array<string>, reply string").withColumn("_r", T.restore_codes(F.col("reply"), F.col("codes")))
    empty = F.col("reply").isNull() | (F.trim("reply") == "")
    warn = F.when(~sent, "").when(empty, "empty reply").otherwise(T.residue(F.col("_r"), F.col("codes")))
    by = F.when(F.col("route").isin("dict", "glossary"), "glossary").when(~sent, "skip").when(empty, "failed").otherwise(engine_name)
    dst = F.when(sent, T.cleanup_punct(apply_glossary(F.col("_r"), entries))).otherwise(F.col("dst"))
    return answered.select("key", dst.alias("dst"), by.alias("engine"), warn.alias("warn"), F.when(sent, "engine").otherwise("rule").alias("origin"))


def translate(texts: DataFrame, entries: Entries, engine: Callable[[list[str]], list[str | None]], column: str = "src", engine_name: str = "engine", batch: int = 24, cache: DataFrame | None = None) -> DataFrame:
    """Every row with ``dst, engine, warn``: distinct trimmed texts are routed, sent in batches of ``batch``, finished and joined back.

    ``engine`` is any function from masked texts to translations (an adapter or a fake). Its answers are checkpointed, so nothing
    downstream asks again; it runs on executors and may be called again after a lost task, so it should be idempotent. ``cache`` (``raw, dst, engine, warn``;
    of several rows a text the least counts) settles texts before any engine sees them; ``memory.translate_remembered`` keeps one from run to run.
    """
    keyed = texts.withColumn("_raw", F.trim(F.coalesce(F.col(column), F.lit(""))))
    results = results_of(keyed.select(F.col("_raw").alias("raw")), entries, engine, engine_name, batch, cache).drop("origin")
    return keyed.join(results.withColumnRenamed("raw", "_raw"), "_raw").drop("_raw")


class Incomplete(Exception):
    """Some texts were not translated; ``partial`` is the whole result with what was."""

    def __init__(self, failed: int, partial: DataFrame):
        super().__init__(f"{failed} texts were not translated")
        self.failed, self.partial = failed, partial


def complete(results: DataFrame) -> DataFrame:
    """``results`` of ``translate`` if no text failed; else an error that carries them, so that what was translated is not lost."""
    failed = results.where("engine = 'failed'").count()
    if failed:
        raise Incomplete(failed, results)
    return results


def request_batches(texts: DataFrame, size: int = 24) -> DataFrame:
    """Number of the request that each distinct text goes in, within its language and by order of the texts.

    Texts are dealt to tasks by ranges, numbered there, and moved on by what the ranges before hold, so a language is many tasks.
    """
    ordered = texts.repartitionByRange(tasks(texts.sparkSession), "lang", "raw").sortWithinPartitions("lang", "raw")
    ranges = kept(ordered.withColumns({"_range": F.spark_partition_id(), "_row": F.monotonically_increasing_id()}))
    held = ranges.groupBy("_range", "lang").agg(F.count("*").alias("_n"), F.min("_row").alias("_first"))  # no more rows than ranges and languages
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("lang").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = held.select(F.col("_range").alias("_at"), F.col("lang").alias("_lang"), (before - F.col("_first")).alias("_move"))
    placed = ranges.join(F.broadcast(starts), (F.col("_range") == F.col("_at")) & F.col("lang").eqNullSafe(F.col("_lang")))
    return placed.select(*texts.columns, F.floor((F.col("_move") + F.col("_row")) / size).alias("batch"))


def split_for_limit(text: str, limit: int) -> list[str]:
    """Pieces of at most ``limit`` characters, cut after the best mark past 40 % of it; a placeholder is never cut."""
    out = []
    while len(text) > limit:
        ends = ((text.rfind(m, 0, limit), len(m)) for m in ("\n", ". ", "! ", "? ", "; ", ", ", " "))
        cut = next((at + n for at, n in ends if at + n <= limit and at > 0.4 * limit), limit)
        open_at = text.rfind(T.OPEN, 0, cut)
        if open_at >= 0 and not 0 <= text.find(T.CLOSE, open_at) < cut:
            cut = max(1, open_at)
        out.append(text[:cut])
        text = text[cut:]
    return out + [text] if text else out


def split_pieces(column: Column, limit: int = 480) -> Column:
    @F.pandas_udf("array<string>")
    def run(s: pd.Series) -> pd.Series:
        return s.fillna("").map(lambda t: split_for_limit(t, limit))

    return run(column)
