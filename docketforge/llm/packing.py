"""Problem 8: filling fixed-capacity containers by matching of large items.

Only how many items there are of each size is needed to decide the packing, and there are no
more sizes than the capacity. So Spark counts the items by size, the driver plans over these
counts (their number is bound by the capacities, not by the data), and Spark gives each item
the container of its rank among the items of its size.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import TOKENIZER_DIR, cut, spread, table
from .tokenize import count_column

#: Items of one size that are ranked by one task.
ITEMS = 100_000


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Segments (size, first, last, bin, per_bin): the items of this size ranked first..last-1
    go to containers bin, bin+1, ..., per_bin to each.

    Items above a third of the capacity: at most two of them share a container, so they are
    matched greedily, the largest with the largest that still fits. The rest go, largest first,
    to the container with the smallest gap that takes them. Containers of equal content are
    handled as one range.
    """
    left = {s: n for s, n in counts.items() if 0 < s <= capacity and n > 0}
    given = dict.fromkeys(left, 0)
    out: list[tuple[int, int, int, int, int]] = []
    gaps: list[int] = []  # distinct gaps, ascending
    ranges: dict[int, list[tuple[int, int]]] = {}  # gap -> ranges (bin, number of bins)
    bins = 0

    def take(size: int, n: int, at: int, per_bin: int) -> None:
        out.append((size, given[size], given[size] + n, at, per_bin))
        given[size] += n
        left[size] -= n

    def leave(gap: int, at: int, n: int) -> None:
        if n and gap > 0:
            if gap not in ranges:
                insort(gaps, gap)
                ranges[gap] = []
            ranges[gap].append((at, n))

    large = sorted(s for s in left if 3 * s > capacity)
    while large:
        big = large[-1]
        n = left[big]
        i = bisect_left(large, capacity - big + 1) - 1
        if i < 0:
            take(big, n, bins, 1)
            leave(capacity - big, bins, n)
            bins += n
        elif large[i] >= big:  # two of the largest fit together: pairs of its own
            pairs, odd = divmod(n, 2)
            if pairs:
                take(big, 2 * pairs, bins, 2)
                leave(capacity - 2 * big, bins, pairs)
                bins += pairs
            if odd:
                mate = next((s for s in reversed(large[:-1])), None)
                take(big, 1, bins, 1)
                if mate is not None:
                    take(mate, 1, bins, 1)
                leave(capacity - big - (mate or 0), bins, 1)
                bins += 1
        else:
            mate = large[i]
            n = min(n, left[mate])
            take(big, n, bins, 1)
            take(mate, n, bins, 1)
            leave(capacity - big - mate, bins, n)
            bins += n
        large = [s for s in large if left[s]]

    for size in sorted((s for s in left if 3 * s <= capacity), reverse=True):
        while left[size]:
            i = bisect_left(gaps, size)
            if i == len(gaps):
                ranges_new = -(-left[size] // (capacity // size))
                leave(capacity, bins, ranges_new)
                bins += ranges_new
                continue
            gap = gaps[i]
            at, n = ranges[gap].pop()
            if not ranges[gap]:
                del ranges[gap], gaps[i]
            each = gap // size
            full, odd = divmod(min(left[size], n * each), each)
            if full:
                take(size, full * each, at, each)
                leave(gap - each * size, at, full)
            if odd:
                take(size, odd, at + full, odd)
                leave(gap - odd * size, at + full, 1)
            rest = n - full - bool(odd)
            leave(gap, at + full + bool(odd), rest)
    return out


def _placed(segments: list[tuple[int, int, int, int, int, int]]):
    """Gives (pack_id, size, rank) its container: the segment that holds the rank is found by search.

    segments: (pack_id, size, first, last, bin, per_bin). The ranks of a pack and size follow
    those of the one before on one line, so that one sorted list serves all of them.
    """
    segments = sorted(segments)
    base: dict[tuple[int, int], int] = {}
    begins, total = [], 0
    for pack_id, size, first, last, _, _ in segments:
        at = base.setdefault((pack_id, size), total - first)
        begins.append(at + first)
        total = at + last
    line = np.array(begins, dtype=np.int64)
    bins, per_bin = (np.array([s[k] for s in segments], dtype=np.int64) for k in (4, 5))

    def run(batches):
        for batch in batches:
            pack_id, size, rank = (batch.column(i).to_numpy() for i in (0, 1, 2))
            key = pack_id.astype(np.int64) << 32 | size
            kinds, where = np.unique(key, return_inverse=True)
            at = np.array([base[int(k) >> 32, int(k) & 0xFFFFFFFF] for k in kinds], dtype=np.int64)[where] + rank if len(key) else rank
            i = np.searchsorted(line, at, side="right") - 1
            container = bins[i] + (at - line[i]) // per_bin[i] if len(key) else rank
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in (0, 3, 4, 5, 1)), pa.array(container, pa.int64())], names=["pack_id", "doc_id", "piece_no", "first_token", "n_tokens", "container_id"])

    return run


def pack(items: DataFrame, capacities: dict[int, int]) -> DataFrame:
    """Give each item its container.

    items(pack_id, doc_id, n_tokens) -> (pack_id, doc_id, piece_no, first_token, n_tokens,
    container_id). Items above the capacity are divided into pieces of the capacity and a rest;
    no other item is. Items of null or no length are left out. Equal sizes are told apart by
    (doc_id, piece_no), so the result is the same for any order of the rows; rows that repeat
    are packed each. An empty table gives an empty result. Extra columns are not looked at.

    Full pieces are ranked by document, not one by one. The items of a size are ranked in as
    many parts as their number needs. Only counts by size and the planned segments pass through
    the driver; the capacities bind both.
    """
    kind = items.schema["doc_id"].dataType.simpleString()
    caps = F.create_map(*[F.lit(x) for kv in (capacities or {0: 1}).items() for x in kv])
    whole = items.where("n_tokens > 0").select(F.col("pack_id").cast("bigint").alias("pack_id"), "doc_id", F.col("n_tokens").cast("bigint").alias("n_tokens"), caps[F.col("pack_id")].alias("cap"))
    parts = whole.select("pack_id", "doc_id", F.expr("n_tokens div cap").alias("n_full"), (F.col("n_tokens") % F.col("cap")).alias("rest"), "cap")
    # a row for the full pieces of a document, if any, and one for its rest
    entry = lambda size, n, piece: F.struct(size.cast("int").alias("size"), n.alias("n"), piece.cast("int").alias("piece_no"))
    two = F.array(F.when(F.col("n_full") > 0, entry(F.col("cap"), F.col("n_full"), F.lit(0))), F.when(F.col("rest") > 0, entry(F.col("rest"), F.lit(1).cast("bigint"), F.col("n_full"))))
    rows = cut(parts.select("pack_id", "doc_id", "cap", F.explode(F.array_compact(two)).alias("e")).select("pack_id", "doc_id", "cap", "e.*"))
    sized = rows.groupBy("pack_id", "size").agg(F.sum("n").alias("n"), F.count("*").alias("rows")).collect()  # at most the sum of the capacities
    counts: dict[int, dict[int, int]] = {}
    for r in sized:
        counts.setdefault(r.pack_id, {})[r.size] = r.n
    segments = [(p, *seg) for p, c in sorted(counts.items()) for seg in plan(c, capacities[p])]
    # of the sizes only those with more items than one task ranks have several parts; these are few: at most all items / ITEMS
    many = {(r.pack_id, r.size): -(-r.rows // ITEMS) for r in sized if r.rows > ITEMS}
    key = F.col("pack_id") * F.lit(2**32) + F.col("size")
    n_parts = F.coalesce(F.create_map(*[F.lit(x) for (p, size), n in many.items() for x in (p * 2**32 + size, n)])[key], F.lit(1)) if many else F.lit(1)
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("doc_id"), n_parts).cast("int"))
    before = Window.partitionBy("pack_id", "size", "salt").orderBy("doc_id", "piece_no").rowsBetween(Window.unboundedPreceding, -1)
    ranked = salted.withColumn("nth", F.coalesce(F.sum("n").over(before), F.lit(0)))
    if many:
        by_salt = Window.partitionBy("pack_id", "size").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
        starts = salted.groupBy("pack_id", "size", "salt").agg(F.sum("n").alias("m")).select("pack_id", "size", "salt", F.coalesce(F.sum("m").over(by_salt), F.lit(0)).alias("start"))
        ranked = ranked.join(starts, ["pack_id", "size", "salt"]).withColumn("nth", F.col("nth") + F.col("start"))
    each = ranked.select("pack_id", "size", "nth", "doc_id", "piece_no", "cap", F.explode(F.sequence(F.lit(0), (F.col("n") - 1).cast("int"))).alias("k"))
    piece = F.col("piece_no") + F.col("k")
    flat = each.select("pack_id", "size", (F.col("nth") + F.col("k")).alias("rank"), "doc_id", piece.alias("piece_no"), (piece * F.col("cap")).cast("bigint").alias("first_token"))
    return flat.mapInArrow(_placed(segments), f"pack_id bigint, doc_id {kind}, piece_no int, first_token bigint, n_tokens int, container_id bigint")


def document_items(spark: SparkSession, sf_dir: str, folder: str | None = None) -> tuple[DataFrame, dict[int, int]]:
    """Each document's length for each row of pack_specs it belongs to, and the capacities."""
    specs = table(spark, sf_dir, "pack_specs").select("pack_id", "tokenizer", "capacity_tokens", "lang").collect()  # a fixed table of a few rows
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "lang", "text").where("text <> ''"), "doc_id")
    items = None
    for tokenizer in sorted({s.tokenizer for s in specs}):
        counts = cut(count_column(docs, ["doc_id", "lang"], tokenizer=tokenizer, folder=folder or TOKENIZER_DIR))
        own = [s for s in specs if s.tokenizer == tokenizer]
        wanted = F.array(*[F.when(F.lit(s.lang is None) | (F.col("lang") == F.lit(s.lang or "")), F.lit(s.pack_id).cast("bigint")) for s in own])
        part = counts.select("doc_id", "n_tokens", F.explode(F.array_compact(wanted)).alias("pack_id"))
        items = part if items is None else items.unionByName(part)
    if items is None:
        items = docs.selectExpr("doc_id", "0 as n_tokens", "cast(null as bigint) as pack_id").where("false")
    return items, {s.pack_id: s.capacity_tokens for s in specs}


def p8_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(*document_items(spark, sf_dir))


def p8_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How well the containers of each specification are filled."""
    _, caps = items_caps = document_items(spark, sf_dir)
    by = pack(*items_caps).groupBy("pack_id").agg((F.max("container_id") + 1).alias("n_containers"), F.sum("n_tokens").alias("n_tokens"))
    cap = F.create_map(*[F.lit(x) for kv in caps.items() for x in kv])[F.col("pack_id")]
    least = F.ceil(F.col("n_tokens") / cap)
    return by.select("pack_id", "n_containers", "n_tokens", least.cast("bigint").alias("least_containers"), F.round(F.col("n_tokens") / (F.col("n_containers") * cap), 6).alias("fill"))
