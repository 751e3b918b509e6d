"""Seeded sampling that does not depend on how the data is partitioned.

The random order is that of a 60-bit number, taken from an MD5 over a seed and
the row key, and then of the key. Exact sizes come from row counts per leading
bits of that number, so no task ever ranks more than one such bucket. Keys must
identify a row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairbench.constants import SAMPLE_SEED

_HASH_DIGITS = 15
_HASH_BITS = 4 * _HASH_DIGITS
# Leading bits that make a bucket: of the whole table, and of each stratum.
CUT_BITS = 16
RANK_BITS = 12
# Tables of known length up to this are broadcast; their rows are narrow.
BROADCAST_ROWS = 100_000


def seeded_hash(seed, *parts: Column | str) -> Column:
    """MD5 of the seed and the parts, joined by hyphens."""
    columns = [F.col(p) if isinstance(p, str) else p for p in parts]
    return F.md5(F.concat_ws("-", F.lit(str(seed)), *[c.cast("string") for c in columns]).cast("binary"))


def hash_number(digest: Column) -> Column:
    """The leading 60 bits of an MD5."""
    return F.conv(F.substring(digest, 1, _HASH_DIGITS), 16, 10).cast("bigint")


def seeded_order(seed, *parts: Column | str) -> Column:
    return hash_number(seeded_hash(seed, *parts))


def _bucket(order: Column, bits: int) -> Column:
    return F.shiftright(order, _HASH_BITS - bits)


def _keys(key: str | Sequence[str]) -> list[str]:
    return [key] if isinstance(key, str) else list(key)


def broadcast_if_short(df: DataFrame, rows: int | None) -> DataFrame:
    """Broadcast a narrow table whose number of rows is known and small.

    Otherwise Spark decides from measured sizes.
    """
    return F.broadcast(df) if rows is not None and rows <= BROADCAST_ROWS else df


def mark_exact(
    df: DataFrame, k: int, key: str | Sequence[str], seed, into: str = "selected", bits: int = CUT_BITS
) -> DataFrame:
    """Add a boolean column that is true for exactly k rows (all, if there are fewer).

    The k-th row in random order is found from row counts per bucket and a
    ranking of the one bucket it falls into. The rows themselves are then only
    compared with it: they are neither shuffled nor sorted.
    """
    if k <= 0:
        return df.withColumn(into, F.lit(False))
    keys = _keys(key)
    position = F.struct(seeded_order(seed, *keys).alias("order"), *keys)
    narrow = df.select(position.alias("position")).withColumn("bucket", _bucket(F.col("position.order"), bits))
    # At most 2 ** bits rows, whatever the size of the table.
    running = F.sum("n").over(Window.orderBy("bucket"))
    boundary = (
        narrow.groupBy("bucket")
        .agg(F.count(F.lit(1)).alias("n"))
        .select("bucket", running.alias("upto"), (running - F.col("n")).alias("before"))
        .filter((F.col("before") < k) & (F.col("upto") >= k))
        .select("bucket", (F.lit(k) - F.col("before")).alias("wanted"))
    )
    ranked = narrow.join(broadcast_if_short(boundary, 1), "bucket").withColumn(
        "rank", F.row_number().over(Window.partitionBy("bucket").orderBy("position"))
    )
    cut = ranked.filter(F.col("rank") == F.col("wanted")).select("position")
    return df.withColumn(into, F.coalesce(position <= cut.scalar(), F.lit(True)))


def exact_sample(df: DataFrame, k: int, key: str | Sequence[str], seed) -> DataFrame:
    """Exactly k rows without replacement."""
    return mark_exact(df, k, key, seed, "__selected").filter("__selected").drop("__selected")


def split_exact(df: DataFrame, k: int, key: str | Sequence[str], seed) -> tuple[DataFrame, DataFrame]:
    """A sample of exactly k rows and its complement."""
    marked = mark_exact(df, k, key, seed, "__selected")
    return (
        marked.filter("__selected").drop("__selected"),
        marked.filter("NOT __selected").drop("__selected"),
    )


def stratum_ranks(
    df: DataFrame, stratum: str, key: str, seed, strata: int | None = None, bits: int = RANK_BITS
) -> tuple[DataFrame, DataFrame]:
    """A dense rank from 0 within each stratum in random order, and the stratum sizes.

    Ranks are local to (stratum, bucket) and shifted by the rows of earlier
    buckets, so that even a stratum with most of the rows is spread over
    2 ** bits groups. Only stratum and key are carried. ``strata`` is the number
    of strata, if it is known.
    """
    rows = df.select(stratum, key).withColumn("order", seeded_order(seed, key))
    rows = rows.withColumn("bucket", _bucket(F.col("order"), bits))
    counts = rows.groupBy(stratum, "bucket").agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy(stratum).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    shifts = counts.select(stratum, "bucket", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("shift"))
    local = F.row_number().over(Window.partitionBy(stratum, "bucket").orderBy("order", key))
    ranks = (
        rows.withColumn("local", local)
        .join(broadcast_if_short(shifts, strata and strata * 2**bits), [stratum, "bucket"])
        .select(stratum, key, (F.col("shift") + F.col("local") - 1).alias("rank"))
    )
    sizes = counts.groupBy(stratum).agg(F.sum("n").alias("size"))
    return ranks, broadcast_if_short(sizes, strata)


def draw(
    requests: DataFrame,
    ranks: DataFrame,
    sizes: DataFrame,
    stratum: str,
    number: Column,
    length: int | None = None,
) -> DataFrame:
    """Give each request, which names a stratum, the row at a random number in it.

    Requests for a stratum without rows have no result. ``length`` is the number
    of requests, if it is known.
    """
    picks = requests.join(sizes, stratum).withColumn("rank", number % F.col("size"))
    return broadcast_if_short(picks, length).join(ranks, [stratum, "rank"]).drop("rank", "size")


_BLOCK = 4096


def stratified_sample(
    df: DataFrame, stratum: str, key: str, n: int, seed, strata: Sequence | None = None
) -> DataFrame:
    """Exactly n rows with replacement from each stratum, with the seed recorded."""
    if strata is not None:
        df = df.filter(F.col(stratum).isin(list(strata)))
    df = df.filter(F.col(stratum).isNotNull())
    known = None if strata is None else len(strata)
    length = None if strata is None else n * len(strata)
    ranks, sizes = stratum_ranks(df, stratum, key, seed, known)
    # Slots are numbered in blocks, so that no row ever holds an array of all n. The
    # blocks, if there are several, are dealt out by number: one task would make all slots
    # of a stratum else.
    block = F.explode(F.sequence(F.lit(0), F.lit((n - 1) // _BLOCK))).alias("block")
    within = F.explode(F.sequence(F.lit(0), F.lit(_BLOCK - 1))).alias("within")
    blocks = sizes.select(stratum, block)
    if n > _BLOCK:
        spread = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        blocks = blocks.repartition(spread, stratum, "block")
    slots = (
        blocks.select(stratum, "block", within)
        .select(stratum, (F.col("block").cast("bigint") * _BLOCK + F.col("within")).alias("slot"))
        .filter(F.col("slot") < n)
    )
    drawn = draw(slots, ranks, sizes, stratum, seeded_order(seed, stratum, "slot"), length)
    picked = drawn.select(key, "slot", F.lit(seed).cast("int").alias("seed"))
    return df.join(broadcast_if_short(picked, length), key)


def sample_rows(df: DataFrame, n: int, key: str | Sequence[str], seed=SAMPLE_SEED) -> DataFrame:
    """n random rows to look at; n is small, and n rows go to one task."""
    digest = seeded_hash(seed, *_keys(key))
    return df.orderBy(digest, *_keys(key)).limit(n)


def sample_fraction(df: DataFrame, n: int, key: str | Sequence[str], seed=SAMPLE_SEED) -> DataFrame:
    """About n rows without replacement and never more than n.

    Each row is drawn by its own hash with probability n / rows. Should more than
    n be drawn, the first n in random order stay, so the cap favours no rows, and
    the sample does not depend on partitions.
    """
    total = df.agg(F.count(F.lit(1)).cast("double")).scalar()
    share = F.least(F.lit(float(n)) / F.greatest(total, F.lit(1.0)), F.lit(1.0))
    drawn = seeded_order(seed, *_keys(key)) < (share * F.lit(float(1 << _HASH_BITS))).cast("bigint")
    return exact_sample(df.filter(drawn), n, key, seed)


def shuffle_rows(df: DataFrame, key: str | Sequence[str], seed) -> DataFrame:
    """All rows in random order; the order is kept in the column ``shuffle_key``."""
    shuffled = df.withColumn("shuffle_key", seeded_hash(seed, *_keys(key)))
    return shuffled.orderBy("shuffle_key", *_keys(key))
