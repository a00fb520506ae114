"""Queries of remembered translations and of glossaries with many terms."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import glossary as L
from ..operators import memory as M
from ..operators.pages import kept, shared_dir, stored
from ..sources import derive as D
from .queries import GLOSSARY, SQL, _text, fake_engine, query

_ASKED = "CASE route WHEN 'send' THEN '{}' ELSE 'rule' END AS {}"
_ORIGINS = ", ".join(_ASKED.format(origin, run) for run, origin in (("first", "engine"), ("second", "memory"), ("other_glossary", "engine"), ("after_fold", "memory")))
SQL["translation_memory_runs"] = SQL["translate_join_back"].replace("'' AS warn FROM w", f"'' AS warn, {_ORIGINS} FROM w")


@query(SQL["translation_memory_runs"])
def translation_memory_runs(spark, sf_dir):
    """All lines, four times over one memory: it fills, answers, is asked anew for another glossary, and answers once folded."""
    texts = _text(spark, sf_dir)
    memory = M.Memory(spark, f"{shared_dir(spark)}/translation-memory-{uuid.uuid4().hex}")
    more = [*GLOSSARY, ("no such words", "x", False)]
    run = M.Run(engine="engine")
    origin = lambda entries: M.translate_remembered(texts, entries, fake_engine, memory, run, "line")
    first = kept(origin(GLOSSARY).select("k", "no", F.col("origin").alias("first")))
    second = stored(origin(GLOSSARY).select("k", "no", "dst", "engine", "warn", F.col("origin").alias("second")))
    other = kept(origin(more).select("k", "no", F.col("origin").alias("other_glossary")))
    memory.fold()
    memory.prune()
    after = kept(origin(GLOSSARY).select("k", "no", F.col("origin").alias("after_fold")))
    memory.delete()
    return second.join(first, ["k", "no"]).join(other, ["k", "no"]).join(after, ["k", "no"])


def _part_terms(spark, sf_dir) -> list:
    """Terms of parts: name and brand and size, and the name alone. There are at most as many as names, brands and sizes allow, whatever the table."""
    part = D.table(spark, sf_dir, "part")
    long = part.select(F.concat_ws(" ", "p_name", F.translate("p_brand", "#", "-"), "p_size").alias("term"), F.concat(F.lit("<"), "p_name", F.lit("|"), "p_size", F.lit(">")).alias("target"))
    short = part.select(F.col("p_name").alias("term"), F.concat(F.lit("<"), F.col("p_name"), F.lit(">")).alias("target"))
    return [(r["term"], r["target"], False) for r in long.unionByName(short).distinct().orderBy("term").collect()]


@query("""WITH o AS (SELECT l_orderkey AS k, l_linenumber AS no, l_partkey, upper(p_name) || ' ' || replace(p_brand, '#', '-') || ' ' || p_size AS term, p_name, p_size, replace(p_brand, '#', '-') AS brand FROM lineitem JOIN part ON l_partkey = p_partkey)
SELECT k, no, l_partkey, 'ship <' || p_name || '|' || p_size || '>, not <' || p_name || '> ' || upper(brand) || ' ' || p_size || '00; un' || p_name || ' <' || p_name || '>' AS line FROM o
UNION ALL SELECT doc_id, CAST(line_no AS INTEGER), -1, line FROM (SELECT doc_id, unnest(range(len(string_split(regexp_replace(text, '\r\n?', chr(10), 'g'), chr(10))))) AS line_no, unnest(string_split(regexp_replace(text, '\r\n?', chr(10), 'g'), chr(10))) AS line FROM documents)""")
def glossary_many_terms(spark, sf_dir):
    """Thousands of terms of parts in all lines of orders (whole, as a longer number, within a word, on their own) and documents."""
    line = F.concat(F.lit("ship "), "term", F.lit(", not "), "term", F.lit("00; un"), "p_name", F.lit(" "), "p_name")
    part = D.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_name", F.upper(F.concat_ws(" ", "p_name", F.translate("p_brand", "#", "-"), "p_size")).alias("term"))
    orders = D.table(spark, sf_dir, "lineitem").join(part, "l_partkey").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("no"), "l_partkey", line.alias("line"))
    docs = D.text_lines(spark, sf_dir).select(F.col("doc_id").alias("k"), F.col("line_no").alias("no"), F.lit(-1).cast("long").alias("l_partkey"), "line")
    return orders.unionByName(docs).withColumn("line", L.apply_glossary(F.col("line"), _part_terms(spark, sf_dir)))
