"""Problem 3: near-duplicate documents by an LSH forest.

Each document gets minima of its three-word sequences under many hash functions. Every tree is
an order of all documents by a label, a run of such minima. Documents with a common prefix
are neighbours in that order; a region holds those whose common prefix is at least the region's
depth, and the depth of a region grows until it is small. All neighbours of a region are
candidates: they are compared by short sketches of their minima, and where these agree by
their three-word sequences.

A pair at the threshold shares the first DEPTH minima in some tree almost surely, but not more
of them, so what a deeper region leaves apart is found in an exact way. The three-word sequences
that crowd regions (boilerplate) are counted over all documents of such regions. Two of these
documents that reach the threshold either share a good part of their other, rarer sequences,
and then a minimum over the rarer ones alone, whose regions are small by construction; or
both consist mostly of the crowding sequences, and these are compared in a grid of salted cells.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import components, cut, forget, spread, table

#: A pair at the threshold shares the first DEPTH minima of one tree with chance 1/8, so 0.9997 of such pairs meet.
TREES = 60
#: Minima from which a common prefix makes a region, and those after which a region is not divided further.
DEPTH, DEEPEST = 3, 48
#: Documents in a region from which it is divided by more minima.
CROWD = 2048
#: One in so many documents is counted to estimate the size of a region.
ESTIMATE = 8
#: Documents of crowded regions in which a sequence occurs from which it counts as crowding them.
HEAVY = CROWD // 4
#: Crowding sequences up to which they travel with the tasks (8 MB); more of them are joined.
HEAVY_KNOWN = 1 << 20
#: A document is mostly made of crowding sequences if it has so many of them for each other one.
#: If one of a pair is not, then a threshold of 0.5 means that their other sequences have at least (1 - MOSTLY) / 2
#: in common, and one of TREES * DEPTH minima over them is equal with chance 1 - (1 - 0.1) ** 180 > 1 - 1e-8.
MOSTLY = 0.8
#: Minima in a sketch, and the bits of each. Fewer would let many more pairs below the threshold through to the exact comparison.
PARTS, BITS = TREES * DEPTH, 4
#: Bits of the key of a region: two regions with one key only make more candidates.
KEY_BITS = 40
#: Words of the sequences that find candidates and decide.
DECIDE_WORDS = 3
MIN_WORDS = 40
#: Deviations below its expected number of equal parts of the sketch, down to which a pair at the threshold is compared exactly.
DEVIATIONS = 4
SIMILARITY = 0.5
#: Documents in a region up to which its pairs leave it at once, without sketches.
FEW = 8
#: Copies of one text whose pairs are listed by one task.
COPIES = 1000

_TABLE = bytes(c if 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
_word = re.compile(r"[^\W_]+").findall
_seeds = np.random.default_rng(20260701)
_MULT = (_seeds.integers(1, 2**32, TREES * DEPTH, dtype=np.uint64).astype(np.uint32) | np.uint32(1)).astype(np.uint32)
_XOR = _seeds.integers(0, 2**32, TREES * DEPTH, dtype=np.uint64).astype(np.uint32)


class _Words(dict):
    def __missing__(self, word):
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


_words = _Words()


def words_of(text: str) -> list:
    """Maximal runs of letters or digits of the lower-cased text (bytes for ASCII text)."""
    low = text.lower()
    return low.encode().translate(_TABLE).split() if low.isascii() else [w.encode("utf-8", "surrogatepass") for w in _word(low)]


def word_hashes(text: str) -> np.ndarray:
    if len(_words) > 1_000_000:
        _words.clear()
    w = words_of(text)
    return np.fromiter(map(_words.__getitem__, w), dtype=np.uint64, count=len(w))


def shingles(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k words."""
    n = len(h) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = h[:n].copy()
    for i in range(1, k):
        out *= np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
        out += h[i : n + i]
    out *= np.uint64(0xBF58476D1CE4E5B9)
    out ^= out >> np.uint64(32)
    return out


def minima(s: np.ndarray) -> bytes:
    """The minima of sequences under all hash functions; their low halves tell them apart."""
    s = np.unique((s & np.uint64(0xFFFFFFFF)).astype(np.uint32))
    return ((s[None, :] ^ _XOR[:, None]) * _MULT[:, None]).min(axis=1).astype("<u2").tobytes()


def signature(h: np.ndarray) -> bytes:
    return minima(shingles(h, DECIDE_WORDS))


def _sign(batches):
    for batch in batches:
        ids, keys, sigs = [], [], []
        for d, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            h = word_hashes(t)
            if len(h) >= MIN_WORDS:
                ids.append(d)
                keys.append(xxhash.xxh3_128_digest(h.tobytes()))
                sigs.append(signature(h))
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(keys, pa.binary()), pa.array(sigs, pa.binary())], names=["doc_id", "copy_key", "sig"])


def _minima(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype="<u2").reshape(len(column), TREES * DEPTH)


def _mixed(x: np.ndarray, salt) -> np.ndarray:
    x = x * np.uint64(0x9E3779B97F4A7C15)
    return ((x ^ (x >> np.uint64(31)) ^ np.uint64(salt)) * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - KEY_BITS)


def _labels(batches):
    """The region of each document in each tree: the first DEPTH minima of its label."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sig = _minima(batch.column(1)).astype(np.uint64).reshape(-1, TREES, DEPTH)
        for t in range(TREES):
            prefix = sig[:, t, 0]
            for k in range(1, DEPTH):
                prefix = prefix << np.uint64(16) | sig[:, t, k]
            yield pa.RecordBatch.from_arrays([pa.array(_mixed(prefix, t).view(np.int64)), batch.column(0), pa.array(np.full(batch.num_rows, t, np.int32))], names=["region", "doc_id", "tree"])


def _deeper(start: int, stop: int):
    """Rows (doc_id, sig, regions, trees) of a document -> (region, doc_id, tree) of the prefixes of stop minima; a label goes on with the minima of the next trees."""

    def run(batches):
        n = TREES * DEPTH
        for batch in batches:
            if not batch.num_rows:
                continue
            sizes = [len(t) for t in batch.column(3).to_pylist()]
            region = batch.column(2).flatten().to_numpy().view(np.uint64)
            tree = batch.column(3).flatten().to_numpy().astype(np.int64)
            sig = np.repeat(_minima(batch.column(1)).astype(np.uint64), sizes, axis=0)
            for k in range(start, stop):
                region = _mixed(region ^ sig[np.arange(len(region)), (tree * DEPTH + k) % n], k)
            yield pa.RecordBatch.from_arrays([pa.array(region.view(np.int64)), pa.array(np.repeat(batch.column(0).to_numpy(), sizes)), pa.array(tree.astype(np.int32))], names=["region", "doc_id", "tree"])

    return run


def _sketches(batches):
    """The highest BITS bits of PARTS of the stored minima, packed into words of 64 bits."""
    per = 64 // BITS
    for batch in batches:
        if not batch.num_rows:
            continue
        top = (_minima(batch.column(1))[:, :PARTS] >> (16 - BITS)).astype(np.uint64)
        top = np.pad(top, ((0, 0), (0, -top.shape[1] % per))).reshape(batch.num_rows, -1, per)
        words = np.bitwise_or.reduce(top << (np.arange(per, dtype=np.uint64) * np.uint64(BITS)), axis=2)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([w.tobytes() for w in words], pa.binary())], names=["doc_id", "sketch"])


def _agree(x: np.ndarray, y: np.ndarray, threshold: float) -> np.ndarray:
    """Which rows of sketches have as many equal parts as a pair at the threshold has."""
    n = PARTS
    chance = threshold + (1 - threshold) / 2**BITS
    least = n * chance - DEVIATIONS * (n * chance * (1 - chance)) ** 0.5
    other = x ^ y
    for k in range(1, BITS):
        other = other | (x ^ y) >> np.uint64(k)
    ones = np.uint64(sum(1 << k for k in range(0, 64, BITS)))
    return n - np.bitwise_count(other & ones).sum(axis=1, dtype=np.int64) >= least


def _words_of_sketches(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint64).reshape(len(column), -1)


def _whole_regions(batches):
    """Tables of whole regions from batches that are sorted by region."""
    held: list = []
    for batch in batches:
        if not batch.num_rows:
            continue
        region = np.asarray(batch.column(0))
        last = batch.num_rows - int((region[::-1] != region[-1]).argmax() or batch.num_rows)
        if last:
            yield pa.Table.from_batches([*held, batch.slice(0, last)])
            held = [batch.slice(last)]
        elif held and held[-1].column(0)[0].as_py() != region[0]:
            yield pa.Table.from_batches(held)
            held = [batch]
        else:
            held.append(batch)
    if held:
        yield pa.Table.from_batches(held)


def _of_small_regions(batches):
    """Rows (region, doc_id) sorted by region -> (null, a, b) for each pair of a region of at most FEW, (region, a, null) for the rows of others."""
    for t in _whole_regions(batches):
        region, ids = t.column(0).to_numpy(), t.column(1).to_numpy()
        first = np.flatnonzero(np.concatenate(([True], region[1:] != region[:-1])))
        size = np.repeat(np.diff(np.concatenate((first, [len(region)]))), np.diff(np.concatenate((first, [len(region)]))))
        left, right = [], []
        for k in range(1, FEW):
            i = np.flatnonzero((region[:-k] == region[k:]) & (size[:-k] <= FEW)) if len(region) > k else np.empty(0, np.int64)
            left.append(ids[i])
            right.append(ids[i + k])
        x, y = np.concatenate(left), np.concatenate(right)
        big = np.flatnonzero(size > FEW)
        none = lambda n: pa.nulls(n, pa.int64())
        yield pa.RecordBatch.from_arrays([none(len(x)), pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], names=["region", "a", "b"])
        yield pa.RecordBatch.from_arrays([pa.array(region[big]), pa.array(ids[big]), none(len(big))], names=["region", "a", "b"])


def _agreeing(threshold):
    """The pairs (a, b) of rows (a, b, sketch, other) whose sketches agree."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                mask = pa.array(_agree(_words_of_sketches(batch.column(2)), _words_of_sketches(batch.column(3)), threshold))
                yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(1).filter(mask)], names=["a", "b"])

    return run


def _meet(threshold):
    """Pairs with agreeing sketches of rows (region, doc_id, sketch) sorted by region: row i with row i + k for every k."""

    def run(batches):
        for t in _whole_regions(batches):
            region, ids, sk = t.column(0).to_numpy(), t.column(1).to_numpy(), _words_of_sketches(t.column(2))
            i, k = np.arange(len(region)), 1
            while len(i):
                i = i[i + k < len(region)]
                i = i[region[i] == region[i + k]]
                hit = i[_agree(sk[i], sk[i + k], threshold)]
                if len(hit):
                    x, y = ids[hit], ids[hit + k]
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], names=["a", "b"])
                k += 1

    return run


def _meet_in_cell(threshold):
    """Pairs with agreeing sketches of the rows of one cell (lo, hi): those with salt lo against those with salt hi."""

    def run(cell: pa.Table) -> pa.Table:
        ids, salt, sk = cell.column("doc_id").to_numpy(), cell.column("salt").to_numpy(), _words_of_sketches(cell.column("sketch"))
        lo, hi = (np.nonzero(salt == cell.column(c)[0].as_py())[0] for c in ("lo", "hi"))
        left, right = [], []
        for i in lo:
            js = hi[ids[hi] > ids[i]] if cell.column("lo")[0] == cell.column("hi")[0] else hi
            js = js[_agree(sk[i][None, :], sk[js], threshold)]
            left.append(np.full(len(js), ids[i]))
            right.append(ids[js])
        x, y = (np.concatenate(v) if v else np.empty(0, np.int64) for v in (left, right))
        return pa.table({"a": np.minimum(x, y), "b": np.maximum(x, y)})

    return run


def _sequences(batches):
    """(sequence, n): in how many documents each sequence occurs, by batch."""
    for batch in batches:
        sets = [np.unique(shingles(word_hashes(t), DECIDE_WORDS)) for t in batch.column(1).to_pylist()]
        at, n = np.unique(np.concatenate(sets), return_counts=True) if sets else (np.empty(0, np.uint64), np.empty(0, np.int64))
        yield pa.RecordBatch.from_arrays([pa.array(at.view(np.int64)), pa.array(n)], names=["sequence", "n"])


def _rare_keys(rare: np.ndarray) -> np.ndarray:
    """A region for each minimum over rare sequences."""
    sig = np.frombuffer(minima(rare), "<u2").astype(np.uint64)
    return _mixed(sig ^ (np.arange(len(sig), dtype=np.uint64) << np.uint64(20)), 1 << 40).view(np.int64)


def _rare_of(heavy: np.ndarray):
    """(doc_id, text) -> the regions of a document's rare sequences, as _rare_regions gives them, and a row of region null for a document made mostly of heavy ones."""

    def run(batches):
        for batch in batches:
            regions, ids, mostly = [], [], []
            for d, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own = np.unique(shingles(word_hashes(t), DECIDE_WORDS))
                at = np.searchsorted(heavy, own)
                is_heavy = heavy[np.minimum(at, len(heavy) - 1)] == own if len(heavy) else np.zeros(len(own), bool)
                rare = own[~is_heavy]
                if len(rare):
                    regions.append(_rare_keys(rare))
                    ids.append(np.full(len(regions[-1]), d))
                if is_heavy.sum() >= MOSTLY * len(rare):
                    mostly.append(d)
            region, doc = (np.concatenate(v) if v else np.empty(0, np.int64) for v in (regions, ids))
            yield pa.RecordBatch.from_arrays([pa.concat_arrays([pa.array(region, pa.int64()), pa.nulls(len(mostly), pa.int64())]), pa.array(np.concatenate((doc, np.array(mostly, np.int64))))], names=["region", "doc_id"])

    return run


def _exploded(batches):
    """(doc_id, sequence) of every sequence of every document, a few documents at once."""
    for batch in batches:
        for i in range(0, batch.num_rows, 64):
            part = batch.slice(i, 64)
            sets = [np.unique(shingles(word_hashes(t), DECIDE_WORDS)) for t in part.column(1).to_pylist()]
            ids = np.repeat(part.column(0).to_numpy(), [len(x) for x in sets])
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(np.concatenate(sets).view(np.int64))], names=["doc_id", "sequence"])


def _rare_regions(batches):
    """(doc_id, sequences, n_heavy) -> (region, doc_id) for each minimum over the rare sequences of a document, and a row of region null if it is made mostly of heavy ones."""
    for batch in batches:
        regions, ids, mostly = [], [], []
        for d, seq, n in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist()):
            rare = seq.values.to_numpy().view(np.uint64)
            if len(rare):
                regions.append(_rare_keys(rare))
                ids.append(np.full(len(regions[-1]), d))
            if n >= MOSTLY * len(rare):
                mostly.append(d)
        region, doc = (np.concatenate(v) if v else np.empty(0, np.int64) for v in (regions, ids))
        yield pa.RecordBatch.from_arrays([pa.concat_arrays([pa.array(region, pa.int64()), pa.nulls(len(mostly), pa.int64())]), pa.array(np.concatenate((doc, np.array(mostly, np.int64))))], names=["region", "doc_id"])


def _sets(batches):
    for batch in batches:
        out = [np.unique(shingles(word_hashes(t), DECIDE_WORDS)).tobytes() for t in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["doc_id", "grams"])


def _compare(threshold):
    def run(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                small, big = sorted((len(x), len(y)))
                if small < threshold * big or not big:
                    keep.append(False)
                    continue
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(both >= threshold * (len(x) + len(y) - both))
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(1).filter(mask)], names=["a", "b"])

    return run


def verified(pairs: DataFrame, grams: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) whose sets of word sequences reach the threshold."""
    a = grams.select(F.col("doc_id").alias("a"), F.col("grams").alias("ga"))
    b = grams.select(F.col("doc_id").alias("b"), F.col("grams").alias("gb"))
    return pairs.join(b, "b").join(a, "a").select("a", "b", "ga", "gb").mapInArrow(_compare(threshold), "a bigint, b bigint")


def _neighbours(rows: DataFrame, sketches: DataFrame, threshold: float, scratch: list) -> DataFrame:
    """Pairs (a, b) with agreeing sketches among the rows (region, doc_id) of each region; no region has many more than CROWD.

    Near-duplicates meet in many trees: the pairs of the smallest regions are told apart before a sketch is looked at.
    """
    regions = rows.select("region", "doc_id").repartition("region").sortWithinPartitions("region")
    shared = cut(regions.mapInArrow(_of_small_regions, "region bigint, a bigint, b bigint"))
    scratch.append(shared)
    pairs = shared.where("b is not null").select("a", "b").distinct()
    of = lambda key, name: sketches.select(F.col("doc_id").alias(key), F.col("sketch").alias(name))
    few = pairs.join(of("a", "sketch"), "a").join(of("b", "other"), "b").select("a", "b", "sketch", "other").mapInArrow(_agreeing(threshold), "a bigint, b bigint")
    met = shared.where("b is null").select("region", F.col("a").alias("doc_id")).join(sketches, "doc_id").select("region", "doc_id", "sketch")
    return few.unionByName(met.repartition("region").sortWithinPartitions("region").mapInArrow(_meet(threshold), "a bigint, b bigint"))


def _crowded(rows: DataFrame) -> DataFrame:
    """(region, n) of the regions of more than about CROWD documents, n being their estimated number.

    The size only decides how a region is worked on, not what is found in it; so it is estimated by the
    documents of one residue of a hash, and counts are combined before they are shuffled.
    """
    part = rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(ESTIMATE)) == 0)
    return cut(part.groupBy("region").agg((F.count("*") * ESTIMATE).alias("n")).where(F.col("n") > CROWD))


def _divided(hot: DataFrame, reps: DataFrame, scratch: list) -> DataFrame:
    """Rows (region, doc_id, tree) of crowded regions in regions of so much more depth that they are small."""
    small, depth = None, DEPTH
    while depth < DEEPEST and hot.limit(1).count():
        # a document is in at most TREES regions; its signature is sent once
        own = hot.groupBy("doc_id").agg(F.collect_list(F.struct("region", "tree")).alias("r")).join(reps, "doc_id")
        rows = cut(own.select("doc_id", "sig", "r.region", "r.tree").mapInArrow(_deeper(depth, 2 * depth), "region bigint, doc_id bigint, tree int"))
        still = _crowded(rows)
        scratch += [rows, still]
        cool = rows.join(still, "region", "left_anti")
        small = cool if small is None else small.unionByName(cool)
        hot, depth = rows.join(still, "region", "left_semi"), 2 * depth
    return small


def _rest_of_crowds(hot: DataFrame, src: DataFrame, sketches: DataFrame, threshold: float, scratch: list) -> DataFrame:
    """Pairs (a, b) with agreeing sketches among the documents of crowded regions hot(region, doc_id, n).

    Pairs that share rare sequences meet by minima over these; no such region has more than HEAVY
    documents. Pairs of documents made mostly of heavy sequences meet in the grid of their region.
    """
    ids = cut(hot.select("doc_id").distinct())
    texts = src.join(ids, "doc_id", "left_semi")  # a row that repeats counts again, which only makes a sequence heavy sooner
    heavy = cut(texts.mapInArrow(_sequences, "sequence bigint, n bigint").groupBy("sequence").agg(F.sum("n").alias("n")).where(F.col("n") > HEAVY))
    schema = "region bigint, doc_id bigint"
    if heavy.count() <= HEAVY_KNOWN:
        known = np.sort(np.array([r.sequence for r in heavy.select("sequence").collect()], dtype=np.int64).view(np.uint64))
        found = cut(texts.mapInArrow(_rare_of(known), schema))
    else:
        marked = texts.mapInArrow(_exploded, "doc_id bigint, sequence bigint").join(heavy.select("sequence", F.lit(True).alias("is_heavy")), "sequence", "left")
        # a document's rare sequences are at most its own
        per = marked.groupBy("doc_id").agg(F.collect_list(F.when(F.col("is_heavy").isNull(), F.col("sequence"))).alias("rare"), F.count("is_heavy").alias("n_heavy"))
        found = cut(per.mapInArrow(_rare_regions, schema))
    scratch += [ids, heavy, found]
    near = _neighbours(found.where("region is not null"), sketches, threshold, scratch)
    mostly = hot.join(found.where("region is null").select("doc_id"), "doc_id", "left_semi")
    # the grid has as many salts as keep a cell small; each row goes to the cells of its salt
    salts = F.ceil(F.col("n") / (CROWD // 2)).cast("int")
    salted = mostly.select("region", "doc_id", salts.alias("salts"), F.pmod(F.xxhash64("doc_id"), salts).cast("int").alias("salt"))
    grid = salted.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).join(sketches, "doc_id")
    grid = grid.select("region", F.least("salt", "other").alias("lo"), F.greatest("salt", "other").alias("hi"), "salt", "doc_id", "sketch")
    far = grid.groupBy("region", "lo", "hi").applyInArrow(_meet_in_cell(threshold), "a bigint, b bigint")
    return near.unionByName(far)


def near_duplicates(docs: DataFrame, threshold: float = SIMILARITY) -> tuple[DataFrame, DataFrame]:
    """(pairs, members) of docs(doc_id, text).

    members(doc_id, rep): every document of at least MIN_WORDS words and the least id of the
    documents with the same words, itself if there is no other. pairs(a, b): representatives
    a < b of different texts whose similarity reaches the threshold. Null, empty and shorter
    texts are in neither; rows that repeat an id count once; extra columns are not looked at.
    A document's work does not grow with the size of its group of exact copies.
    """
    src = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").where("doc_id is not null and text is not null")
    signed = cut(spread(src, "doc_id").mapInArrow(_sign, "doc_id bigint, copy_key binary, sig binary"))
    first = signed.groupBy("copy_key").agg(F.min("doc_id").alias("rep"))
    members = cut(signed.select("doc_id", "copy_key").join(first, "copy_key").select("doc_id", "rep").distinct())
    reps = cut(signed.join(members.where("doc_id = rep").select("doc_id"), "doc_id", "left_semi").select("doc_id", "sig"))
    forget(signed)
    sketches = reps.select("doc_id", "sig").mapInArrow(_sketches, "doc_id bigint, sketch binary")
    rows = reps.select("doc_id", "sig").mapInArrow(_labels, "region bigint, doc_id bigint, tree int")
    crowds = _crowded(rows)
    scratch = [crowds]  # tables that only the candidates are made of
    if crowds.limit(1).count():
        hot = cut(rows.join(crowds, "region"))
        scratch.append(hot)
        regions = rows.join(crowds, "region", "left_anti").unionByName(_divided(hot.drop("n"), reps, scratch))
        met = _neighbours(regions, sketches, threshold, scratch).unionByName(_rest_of_crowds(hot, src, sketches, threshold, scratch))
    else:
        met = _neighbours(rows, sketches, threshold, scratch)
    pairs = cut(met.where("a < b").distinct())
    forget(reps, *scratch)
    ids = pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    texts = src.join(ids, "doc_id", "left_semi")
    grams = cut(texts.mapInArrow(_sets, "doc_id bigint, grams binary"))
    sure = cut(verified(pairs, grams, threshold).distinct())
    forget(pairs, grams)
    return sure, members


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs, members = near_duplicates(table(spark, sf_dir, "documents"))
    a = members.select(F.col("rep").alias("a"), F.col("doc_id").alias("x"))
    b = members.select(F.col("rep").alias("b"), F.col("doc_id").alias("y"))
    apart = pairs.join(a, "a").join(b, "b").select("x", "y")
    # the pairs of a large group of copies are listed by several tasks
    sizes = members.groupBy(F.col("rep").alias("a")).agg(F.ceil(F.count("*") / COPIES).cast("int").alias("parts"), F.count("*").alias("n")).where("n > 1").select("a", "parts")
    copies = a.join(sizes, "a")
    left = copies.select("a", "x", F.pmod(F.xxhash64("x"), F.col("parts")).cast("int").alias("part"))
    right = copies.select("a", F.col("x").alias("y"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    same = left.join(right, ["a", "part"]).where("x < y").select("x", "y")
    both = apart.unionByName(same)
    return both.select(F.least("x", "y").alias("doc_id_a"), F.greatest("x", "y").alias("doc_id_b"))


def p3_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document that has a near-duplicate, its class and its number of links to other documents."""
    pairs, members = near_duplicates(table(spark, sf_dir, "documents"))
    copies = members.groupBy("rep").agg(F.count("*").alias("n_copies"))
    ends = pairs.select(F.col("a").alias("rep"), F.col("b").alias("other")).unionByName(pairs.select(F.col("b").alias("rep"), F.col("a").alias("other")))
    links = ends.join(copies.withColumnRenamed("rep", "other"), "other").groupBy("rep").agg(F.sum("n_copies").alias("apart"))
    comp = components(pairs).withColumnRenamed("node", "rep")
    per = copies.join(links, "rep", "left").join(comp, "rep", "left")
    per = per.select("rep", F.coalesce("comp", "rep").alias("class_id"), (F.coalesce("apart", F.lit(0)) + F.col("n_copies") - 1).alias("n_links"))
    return members.join(per.where("n_links > 0"), "rep").select("doc_id", "class_id", "n_links")
