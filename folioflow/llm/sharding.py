"""Sharding by histogram sort: exact counts below probes, refined until the splitters fit, one exchange."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import discard, text_of, without, written

#: Bits that one round of probes resolves: 256 probes per open interval.
STEP = 8
_SIGN = 1 << 63
ADDED = ("size", "text_crc32", "law", "shard", "slot", "grown_shard")


def _at_bits(key: str, other: str, bits: int) -> tuple[Column, Column, Column]:
    """The first ``bits`` of a row's 128-bit key as two longs, and the number of the next ``STEP`` bits."""
    word, used = (key, bits) if bits < 64 else (other, bits - 64)
    first = F.lit(0).cast("long") if bits == 0 else F.shiftright(key, max(0, 64 - bits)) if bits < 64 else F.col(key)
    rest = F.shiftright(other, 64 - used) if bits > 64 else F.lit(0).cast("long")
    probe = F.shiftright(word, 64 - used - STEP).bitwiseAND(F.lit((1 << STEP) - 1).cast("long"))
    return first, rest, probe if used else (F.shiftright(word, 64 - STEP) + F.lit(1 << (STEP - 1)))


def _signed(prefix: int, bits: int) -> tuple[int, int]:
    """The two longs of ``_at_bits`` for the rows whose key starts with ``prefix``."""
    if bits <= 64:
        return (prefix - (1 << (bits - 1)) if bits else 0), 0
    return (prefix >> (bits - 64)) - _SIGN, (prefix & ((1 << (bits - 64)) - 1)) - (1 << (bits - 65))


def splitters(rows: DataFrame, n: int, tolerance: float, key: str, other: str, size: str, parts: int = 1) -> list[int]:
    """The ``n * parts - 1`` 128-bit keys that cut ``rows`` into ``n`` ranges of near equal ``size``, each of them into ``parts``.

    Each round counts, over all rows, the exact size between neighbouring probes inside the still open intervals and keeps for
    each splitter the probe nearest its target: the open intervals are a table of at most a row a splitter (so it is broadcast), and so is
    what reaches the driver, whatever the input. A splitter of the ``n`` ranges is settled once it is within ``tolerance``
    of a range, an inner one within half of its part, or when the interval holds a single row.
    """
    spark = rows.sparkSession
    total, fine = rows.agg(F.sum(size)).first()[0] or 0, n * parts
    goals = {j: total * j / fine for j in range(1, fine)}
    slack, settled = {j: tolerance * total / n if j % parts == 0 else total / fine / 2 for j in goals}, {}
    where, bits = {j: (0, 0) for j in goals}, 0  # prefix, size below the interval
    while where:
        tags = {prefix: i for i, prefix in enumerate(sorted({p for p, _ in where.values()}))}
        first, rest, probe = _at_bits(key, other, bits)
        placed = rows.select(first.alias("a"), rest.alias("b"), probe.alias("probe"), F.col(size).alias("size"))
        if bits:
            spots = spark.createDataFrame([(i, *_signed(p, bits)) for p, i in tags.items()], "tag int, a long, b long")
            placed = placed.join(F.broadcast(spots), ["a", "b"])
        else:
            placed = placed.withColumn("tag", F.lit(0))
        sums = placed.groupBy("tag", "probe").agg(F.sum("size").alias("held"), F.count("*").alias("n"))
        upto = sums.withColumn("upto", F.sum("held").over(Window.partitionBy("tag").orderBy("probe")))
        wanted = spark.createDataFrame([(j, tags[p], float(goals[j] - below)) for j, (p, below) in where.items()], "j int, tag int, need double")
        reached = upto.join(F.broadcast(wanted), "tag").where("upto >= need").groupBy("j").agg(F.min(F.struct("probe", "held", "n", "upto")).alias("r"))
        found = {r["j"]: r["r"] for r in reached.collect()}
        bits += STEP
        for j, (prefix, below) in list(where.items()):
            probe_no, held, count, upto_here = found.get(j, ((1 << STEP) - 1, 0, 0, 0))
            below += upto_here - held
            low = (prefix << STEP) | probe_no
            off, cut = min((abs(below - goals[j]), low), (abs(below + held - goals[j]), low + 1))
            if off <= slack[j] or count <= 1 or bits >= 128:
                settled[j] = cut << (128 - bits)
                del where[j]
            else:
                where[j] = (low, below)
    # An inner splitter, settled more loosely, may have come out beyond its range's own: it then cuts off nothing.
    main = [0, *[settled[j] for j in sorted(settled) if j % parts == 0], 1 << 128]
    return [min(max(settled[j], main[j // parts]), main[j // parts + 1]) for j in sorted(settled)]


#: Splitters up to which a search is written out as conditions; more are searched in an array.
WRITTEN_OUT = 256


def _range_of(cuts: list[int], key: str, other: str) -> Column:
    """How many of the ascending ``cuts`` are at or below a row's key: a binary search, written as nested conditions or over an array."""
    if len(cuts) > WRITTEN_OUT:
        last = _SIGN - 1
        low_high = [((c >> 64) - _SIGN, (c & (2 * _SIGN - 1)) - _SIGN) if c < 1 << 128 else (last, last) for c in cuts]
        tops, rests = (F.array(*[F.lit(x[i]).cast("long") for x in low_high]) for i in (0, 1))
        bounds = F.struct(F.lit(0).alias("low"), F.lit(len(cuts)).alias("high"))

        def halve(acc: Column, _: Column) -> Column:
            mid = F.shiftright(acc["low"] + acc["high"], 1)
            top, rest = F.get(tops, mid), F.get(rests, mid)
            reached = (F.col(key) > top) | ((F.col(key) == top) & (F.col(other) >= rest))
            done, up = acc["low"] >= acc["high"], F.coalesce(reached, F.lit(False))
            return F.struct(F.when(~done & up, mid + 1).otherwise(acc["low"]).alias("low"), F.when(~done & ~up, mid).otherwise(acc["high"]).alias("high"))

        return F.aggregate(F.sequence(F.lit(1), F.lit(len(cuts).bit_length())), bounds, halve, lambda acc: acc["low"])

    def search(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        mid = (low + high) // 2
        top, rest = (cuts[mid] >> 64) - _SIGN, (cuts[mid] & (2 * _SIGN - 1)) - _SIGN
        if top >= _SIGN:  # above every key
            return search(low, mid)
        reached = (F.col(key) > F.lit(top)) | ((F.col(key) == F.lit(top)) & (F.col(other) >= F.lit(rest)))
        return F.when(reached, search(mid + 1, high)).otherwise(search(low, mid))

    return search(0, len(cuts))


def shard_by_bytes(rows: DataFrame, n: int = 8, key: str = "k1", other: str = "k2", size: str = "size", tolerance: float = 0.002, keys: DataFrame | None = None) -> DataFrame:
    """``rows`` with ``shard`` (0 to n - 1) and ``slot`` (gapless from 0 in each shard), sorted by key.

    ``key`` and ``other`` are long columns, compared in that order; ``keys`` is a written table of them and ``size`` alone, which is read once a
    round (without it, ``rows`` is), while ``rows`` are then read once.
    The splitters themselves deal the rows out, once: a task gets one of the ranges that they cut each shard into (as many in
    all as ``spark.sql.shuffle.partitions``), so no task holds a whole shard, and
    slots follow from each task's row counts. The joined count table has one row per task, so it is broadcast. Only DataFrame functions are used.
    """
    parts = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")) // n)
    cuts = splitters(rows if keys is None else keys, n, tolerance, key, other, size, parts)
    rest = [c for c in rows.columns if c not in (key, other)]
    sorted_rows = written(
        rows.withColumn("__range", _range_of(cuts, key, other)).repartitionById(n * parts, "__range")
        .sortWithinPartitions("__range", key, other, *[c for c in rest if rows.schema[c].dataType.typeName() in ("long", "integer", "string")])
        .withColumn("__at", F.monotonically_increasing_id()),
        "sharded",
    )
    runs = sorted_rows.groupBy("__range").agg(F.min("__at").alias("__first"), F.count("*").alias("__n"))
    runs = runs.withColumn("shard", F.floor(F.col("__range") / parts).cast("int"))
    before = Window.partitionBy("shard").orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.withColumn("__start", F.coalesce(F.sum("__n").over(before), F.lit(0))).drop("__n")
    return sorted_rows.join(F.broadcast(runs), "__range").withColumn("slot", F.col("__at") - F.col("__first") + F.col("__start")).drop("__range", "__at", "__first", "__start")


def histogram_shards(docs: DataFrame, n: int = 8, id_col: str = "doc_id", text_col: str = "text", carry: bool = True, tolerance: float = 0.002) -> DataFrame:
    """Documents in ``n`` shards of near equal bytes, sorted by hashes of the text and of the id.

    Copies of a text are neighbours, so they share a shard unless a splitter falls into the group and cuts it to
    keep the bytes equal. Rows that repeat a text and an id are told apart by 20 more bits, so that they can be dealt out
    even if a third of all rows are one. ``size`` is the UTF-8 bytes of the text plus 1; a null text has none and so size 1 and
    crc 0. Null ids are like any other.
    With ``carry`` all columns of ``docs`` pass through the exchange (those named like an added one are
    replaced), else only the id. An empty table gives an empty result.
    """
    text = text_of(text_col)
    base = without(docs, *ADDED)
    told_apart = F.xxhash64(F.monotonically_increasing_id()).bitwiseAND(F.lit((1 << 20) - 1).cast("long"))
    rows = base.select(
        # The caller's columns go as one, so that none of their names can clash.
        F.struct(*[F.col(f"`{c}`") for c in (base.columns if carry else [id_col])]).alias("__row"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(text).alias("k1"),
        F.shiftleft(F.xxhash64(F.col(f"`{id_col}`").cast("long")), 20).bitwiseOR(told_apart).alias("k2"),
    )
    keys = written(rows.select("k1", "k2", "size"), "to-shard")
    out = shard_by_bytes(rows, n, tolerance=tolerance, keys=keys)
    discard(keys)
    return out.select("__row.*", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
