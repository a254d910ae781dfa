"""SimHash near-duplicates, compared bit-sliced.

Fingerprints within RADIUS bits of each other agree in at least two of six blocks, so each distinct
fingerprint is filed under the 15 pairs of blocks. In a bucket, 64 fingerprints stand as 64 bit
planes of one machine word each; a fingerprint is compared with all 64 lanes at once, its
differing bits added plane by plane in carry-save counters, and a block is given up as soon as
every lane is past the radius.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from fathom.llm._common import group_key, sieve, stage, table, with_key
from fathom.llm.components import components, joined

SHINGLE = 4
SEED = 42
RADIUS = 4
#: For whole near-copies: bits, words a shingle, and the similarity (in hundredths) that links texts.
WIDE, WIDE_SHINGLE, SIMILAR = 512, 5, 80
#: Share of the bits in which texts of that similarity differ on average: the angle between their sets, over pi.
APART = math.acos(2 * SIMILAR / (100 + SIMILAR)) / math.pi
#: Words of the fingerprint that a band's row carries, and the bits that candidates differ in at most, there and in all: the mean and three deviations.
CARRIED = 2
WIDE_RADIUS, FULL_RADIUS = (round(n * APART + 3 * math.sqrt(n * APART * (1 - APART))) for n in (64 * CARRIED, WIDE))
#: Pairs of that similarity that share no band, at most; and log2 of the unrelated fingerprints in a bucket, which are one block of lanes.
MISSED, LANES = 0.005, 6
#: Rows that a task compares at a time, and the share of nodes that large buckets are known by (of their sizes only the plan depends).
WIDE_ROWS, SAMPLED = 1 << 17, 16
#: (first bit, bits) of the six blocks.
BLOCKS = ((0, 11), (11, 11), (22, 11), (33, 11), (44, 10), (54, 10))
#: A larger bucket is filed again under parts of its remaining bits, and then dealt out in tiles.
BUCKET = 4096
#: Rows that a task compares at a time, and comparisons of a row with a block of 64 at a time.
ROWS, CHUNK = 1 << 18, 1 << 17


def fingerprint(text: bytes | None) -> int:
    """SimHash of the lower-cased (A-Z) text's word shingles; 0 for null or no words."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    end = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    start = np.concatenate(([0], end[:-1]))
    k = min(SHINGLE, len(words)) - 1
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(start[: len(words) - k].tolist(), (end[k:] - 1).tolist(), strict=True)], np.uint64)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        ones += np.unpackbits(hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0])


def with_fingerprint(docs: DataFrame, *keep: str) -> DataFrame:
    """The columns of keep, and fp: the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.array([fingerprint(t.as_py()) for t in batch.column("_fx_text")], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keep), pa.array(fp)], names=[*keep, "fp"])

    df = docs.select(*keep, F.col("text").cast("binary").alias("_fx_text"))
    return df.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name in keep) + ", fp long")


def _csa(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    u = a ^ b
    return u ^ c, (a & b) | (u & c)


def close_pairs(fp: np.ndarray, end: np.ndarray, radius: int = RADIUS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (i, j), i < j < end[i], of fingerprints at most `radius` bits apart, in chunks.

    fp is uint64, of one word a row or a column for each word; rows of one bucket are adjacent and end[i] is
    where the bucket of row i ends.
    """
    fp = fp.reshape(len(fp), -1)
    (n, width), full = fp.shape, np.uint64(0xFFFFFFFFFFFFFFFF)
    blocks, size = -(-n // 64), 64 * width
    padded = np.zeros((blocks * 64, width), np.uint64)
    padded[:n] = fp
    bits = np.unpackbits(padded.view(np.uint8).reshape(blocks, 64, 8 * width), axis=2, bitorder="little")
    planes = np.packbits(np.ascontiguousarray(bits.transpose(2, 0, 1)), axis=2, bitorder="little").view(np.uint64).reshape(size, blocks)
    digits = max(3, radius.bit_length())
    index = np.arange(n)
    first, last = (index + 1) // 64, (end - 1) // 64
    count = np.where(end > index + 1, last - first + 1, 0)
    stop = np.cumsum(count)
    low = lambda k: np.where(k >= 64, full, (np.uint64(1) << np.minimum(k, 63).astype(np.uint64)) - np.uint64(1))  # noqa: E731  the k lowest lanes
    at = 0
    while at < n:
        upto = max(at + 1, int(np.searchsorted(stop, (stop[at - 1] if at else 0) + CHUNK, "right")))
        part = count[at:upto]
        q = np.repeat(index[at:upto], part)
        blk = first[q] + np.arange(len(q)) - np.repeat(np.cumsum(part) - part, part)
        at = upto
        over = ~(low(np.minimum(end[q] - 64 * blk, 64)) & ~low(np.maximum(q + 1 - 64 * blk, 0)))
        live = ~over
        digit = [np.zeros(len(q), np.uint64) for _ in range(digits)]
        for b in range(0, size, 4):
            if not len(q):
                break
            d = [planes[k, blk] ^ (full * ((fp[q, k // 64] >> np.uint64(k % 64)) & np.uint64(1))) for k in range(b, b + 4)]
            digit[0], t1 = _csa(digit[0], d[0], d[1])
            digit[0], t2 = _csa(digit[0], d[2], d[3])
            digit[1], carry = _csa(digit[1], t1, t2)
            for k in range(2, digits):
                digit[k], carry = digit[k] ^ carry, digit[k] & carry
            over |= carry
            if b % 16 == 12 or b + 4 == size:
                past, tie = np.zeros(len(q), np.uint64), np.full(len(q), full)
                for k in reversed(range(digits)):
                    past, tie = (past, tie & digit[k]) if radius >> k & 1 else (past | (tie & digit[k]), tie & ~digit[k])
                live = ~(over | past)
                keep = np.flatnonzero(live)
                if len(keep) < len(q):
                    q, blk, over, live = (x[keep] for x in (q, blk, over, live))
                    digit = [x[keep] for x in digit]
        if len(q):
            hit = np.unpackbits(live.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            row, lane = np.nonzero(hit)
            yield q[row], blk[row] * 64 + lane


def join_labels(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Merge the groups of a[k] and b[k] for every k, in place; a label is the smallest index of its group."""
    while True:
        x, y = labels[a], labels[b]
        differ = x != y
        if not differ.any():
            return
        a, b, x, y = a[differ], b[differ], x[differ], y[differ]
        np.minimum.at(labels, np.maximum(x, y), np.minimum(x, y))
        while not np.array_equal(jumped := labels[labels], labels):
            labels[:] = jumped


def _shared_buckets(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which rows are in buckets (runs of equal keys) of several rows, and where among those their buckets end."""
    edge = np.flatnonzero(np.concatenate((keys[1:] != keys[:-1], [True]))) + 1
    size = np.diff(np.concatenate(([0], edge)))
    end, many = np.repeat(edge, size), np.repeat(size > 1, size)
    drop = np.cumsum(~many)
    return many, (end - np.concatenate(([0], drop))[end])[many]


def _compare(keys: np.ndarray, fp: np.ndarray, node: np.ndarray, radius: int) -> Iterator[pa.RecordBatch]:
    """Edges of a spanning forest of what is close within the buckets (runs of equal keys)."""
    many, end = _shared_buckets(keys)
    if not many.any():
        return
    fp, node = fp[many], node[many]
    labels = np.arange(len(fp))
    for i, j in close_pairs(fp, end, radius):
        join_labels(labels, i, j)
    linked = np.flatnonzero(labels != np.arange(len(fp)))
    if len(linked):
        yield pa.RecordBatch.from_arrays([pa.array(node[linked]), pa.array(node[labels[linked]])], names=["a", "b"])


def join_by_pairs(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> list[np.ndarray]:
    """join_labels(), and which pairs (positions in a and b) did it: one for each label that went."""
    used, at = [], np.arange(len(a))
    while True:
        x, y = labels[a[at]], labels[b[at]]
        differ = x != y
        at, high, low = at[differ], np.maximum(x, y)[differ], np.minimum(x, y)[differ]
        if not len(at):
            return used
        np.minimum.at(labels, high, low)
        does = np.flatnonzero(labels[high] == low)
        used.append(at[does[np.unique(high[does], return_index=True)[1]]])
        while not np.array_equal(jumped := labels[labels], labels):
            labels[:] = jumped


def _forest(keys: np.ndarray, fp: np.ndarray, node: np.ndarray, radius: int) -> Iterator[pa.RecordBatch]:
    """Close pairs that span, in each bucket, all that is linked by close pairs; tree names what one of them spans."""
    many, end = _shared_buckets(keys)
    if not many.any():
        return
    keys, fp, node = keys[many], fp[many], node[many]
    labels, left, right = np.arange(len(fp)), [], []
    for i, j in close_pairs(fp, end, radius):
        for k in join_by_pairs(labels, i, j):
            left.append(i[k])
            right.append(j[k])
    if left:
        a, b = np.concatenate(left), np.concatenate(right)
        with np.errstate(over="ignore"):
            tree = keys[a] * np.int64(0x1E3779B97F4A7C15) + node[labels[a]]
        yield pa.RecordBatch.from_arrays([pa.array(np.minimum(node[a], node[b])), pa.array(np.maximum(node[a], node[b])), pa.array(tree)], names=["a", "b", "tree"])


def _words(batch: pa.RecordBatch) -> np.ndarray:
    """Fingerprints of a batch as uint64, a column for each word."""
    names = [k for k in batch.schema.names if k.startswith("fp")]
    return np.stack([batch.column(k).to_numpy() for k in names], 1).view(np.uint64)


def _linker(radius: int, rows: int = ROWS, compare=_compare, *more: str):  # noqa: ANN001, ANN202
    """Batches of (bucket, node, fp and the longs `more`), sorted by bucket, to edges; whole buckets, about `rows` rows at a time. A wide fp is in columns fp0, fp1, ..."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for batch in batches:
            new = [batch.column("bucket").to_numpy(), _words(batch), *(batch.column(k).to_numpy() for k in ("node", *more))]
            held = [np.concatenate(x) for x in zip(held, new, strict=True)] if held else new
            if len(held[0]) >= rows:
                cut = int(np.searchsorted(held[0], held[0][-1]))
                yield from compare(*(x[:cut] for x in held), radius)
                held = [x[cut:] for x in held]
        if held and len(held[0]):
            yield from compare(*held, radius)

    return run


def _bits(fp: Column, at: int, n: int) -> Column:
    return F.shiftrightunsigned(fp, at).bitwiseAND(F.lit((1 << n) - 1))


def _compare_buckets(rows: DataFrame, radius: int = RADIUS, at_once: int = ROWS) -> DataFrame:
    """Edges of rows (bucket, fp, and node where fp is not a node's name itself)."""
    rows = rows if "node" in rows.columns else rows.withColumn("node", F.col("fp"))
    spread = rows.repartition(F.col("bucket")).sortWithinPartitions("bucket")
    return spread.mapInArrow(_linker(radius, at_once), "a long, b long")


def _tiles(rows: DataFrame, size: int = 0) -> DataFrame:
    """rows (bucket, ...) with large buckets dealt out: rows go to tiles by hash, and every two tiles are a bucket of their own."""
    sizes = rows.groupBy("bucket").agg(F.ceil(F.count(F.lit(1)) / (size or BUCKET)).alias("tiles"))
    tile = F.pmod(F.xxhash64("fp", F.lit(7)), F.col("tiles"))
    out = rows.join(sizes, "bucket").withColumn("t", tile).withColumn("o", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1)))
    return out.withColumn("bucket", F.xxhash64("bucket", F.least("t", "o"), F.greatest("t", "o"))).select(*rows.columns)


def links(fps: DataFrame) -> DataFrame:
    """Edges (a, b) that join all fingerprints linked by chains of at most RADIUS differing bits. fps: distinct fp."""
    fp = F.col("fp")
    pairs = list(combinations(range(len(BLOCKS)), 2))
    keys = F.array(*(F.lit(t << 40) + F.shiftleft(_bits(fp, *BLOCKS[i]), 20) + _bits(fp, *BLOCKS[j]) for t, (i, j) in enumerate(pairs)))
    rows = fps.select("fp", F.explode(keys).alias("bucket"))
    hot = stage(rows.groupBy("bucket").count().filter(F.col("count") > BUCKET).select("bucket"), "hot-buckets")
    if hot.isEmpty():
        return _compare_buckets(rows)
    # Outside the two blocks, 4 differing bits leave one of 5 further parts of the rest equal.
    def parts(t: int) -> list[Column]:
        rest = [b for k in range(len(BLOCKS)) if k not in pairs[t] for b in range(BLOCKS[k][0], sum(BLOCKS[k]))]
        cuts = [len(rest) * k // (RADIUS + 1) for k in range(RADIUS + 2)]
        masks = [sum(1 << b for b in rest[x:y]) for x, y in zip(cuts, cuts[1:], strict=False)]
        return [F.xxhash64("bucket", F.lit(k), fp.bitwiseAND(F.lit(m if m < 1 << 63 else m - (1 << 64)).cast("long"))) for k, m in enumerate(masks)]

    which = F.shiftright("bucket", 40)
    again = F.array(*(F.coalesce(*(F.when(which == t, parts(t)[k]) for t in range(len(pairs)))) for k in range(RADIUS + 1)))
    split = stage(rows.join(hot, "bucket", "left_semi").select("fp", F.explode(again).alias("bucket")), "hot-parts")
    return _compare_buckets(rows.join(hot, "bucket", "left_anti")).union(_compare_buckets(_tiles(split)))


def near_duplicates(docs: DataFrame, *keep: str) -> DataFrame:
    """`keep`, doc_id, fp, component_id (the smallest doc_id in the group) for every row of docs.

    A null or wordless text has fingerprint 0 and is linked like any other. Null doc_ids never are the
    smallest unless a group has no other; repeated rows are in one group. An empty table gives no rows.
    """
    rows = stage(with_fingerprint(docs, "doc_id", *keep), "fingerprints")
    fps = stage(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct-fingerprints")
    linked = components(links(fps.select("fp"))).withColumnRenamed("node", "fp")
    rooted = fps.join(linked, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    rooted = stage(rooted, "roots")
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = stage(rooted.join(least, "root").select("fp", "component_id"), "components")
    return rows.join(named, "fp").select("doc_id", *keep, "fp", "component_id")


def op4_simhash_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = near_duplicates(table(spark, sf_dir, "documents"))
    return df.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def shingles(text: bytes | None) -> np.ndarray:
    """Sorted hashes of the distinct shingles of WIDE_SHINGLE lower-cased words (all of a shorter text's words are one); none for null or no words."""
    words = (text or b"").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    end = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    start = np.concatenate(([0], end[:-1]))
    k = min(WIDE_SHINGLE, len(words)) - 1
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(joined[a:b], SEED) for a, b in zip(start[: len(words) - k].tolist(), (end[k:] - 1).tolist(), strict=True)], np.uint64))


def wide_bits(hashes: np.ndarray) -> bytes:
    """WIDE bits of SimHash of shingles(); zeros for none. Each hash is mixed with a constant for each 64 of its bits."""
    if not len(hashes):
        return bytes(WIDE // 8)
    ones, keys = np.zeros(WIDE, np.int64), np.arange(1, WIDE // 64 + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for at in range(0, len(hashes), 1 << 12):
        x = hashes[at : at + (1 << 12), None] ^ keys
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
        ones += np.unpackbits(x.view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(2 * ones > len(hashes), bitorder="little").tobytes()


def wide_fingerprint(text: bytes | None) -> bytes:
    return wide_bits(shingles(text))


def bands(nodes: int) -> np.ndarray:
    """Which bits each band takes, a row a band, for so many fingerprints.

    A band is so wide that a bucket holds about 2 ** LANES unrelated fingerprints at any size of the corpus, and there are so many that MISSED of the pairs of similarity
    SIMILAR at most share none. The bits are put in fixed random orders, each cut into bands.
    """
    width = min(30, max(8, nodes.bit_length() - LANES))
    count = math.ceil(math.log(MISSED) / math.log(1 - (1 - APART) ** width))
    orders = [np.random.RandomState(SEED + k).permutation(WIDE)[: WIDE // width * width].reshape(-1, width) for k in range(-(-count // (WIDE // width)))]
    return np.concatenate(orders)[:count]


def band_rows(nodes: DataFrame, at: np.ndarray, carried: int = CARRIED) -> DataFrame:
    """(bucket, node, fp0, ...) of each band of nodes (node, fp): the band's bits are its bucket, and the first `carried` words of the fingerprint go with it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, width = at.shape
        for whole in batches:
            for k in range(0, len(whole), 2048):
                batch = whole.slice(k, 2048)
                fp = np.frombuffer(b"".join(batch.column("fp").to_pylist()), np.uint8).reshape(len(batch), -1)
                bits = np.zeros((len(batch), count, 32), np.uint8)
                bits[:, :, :width] = np.unpackbits(fp, axis=1, bitorder="little")[:, at.ravel()].reshape(len(batch), count, width)
                bucket = np.packbits(bits, axis=2, bitorder="little").view(np.uint32)[:, :, 0].astype(np.int64) + (np.arange(count, dtype=np.int64) << 32)
                words = fp.view(np.int64)
                columns = [bucket.ravel(), *(np.repeat(x, count) for x in (batch.column("node").to_numpy(), *(words[:, w] for w in range(carried))))]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=names)

    names = ["bucket", "node", *(f"fp{w}" for w in range(carried))]
    return nodes.select("node", "fp").mapInArrow(run, ", ".join(f"{k} long" for k in names))


def _dealt_bands(nodes: DataFrame, at: np.ndarray) -> DataFrame:
    """Rows (bucket, node, fp0, fp1) of all bands, large buckets dealt out as in _tiles(): every two tiles of one are a bucket.

    Which buckets are large is known by a share of the nodes; all rows of all buckets are compared in either case.
    """
    some = band_rows(nodes.filter(F.pmod(F.xxhash64("node", F.lit(3)), F.lit(SAMPLED)) == 0), at, 0)
    large = some.groupBy("bucket").agg(F.ceil(F.count(F.lit(1)) * SAMPLED / BUCKET).alias("tiles")).filter("tiles > 1")
    large = stage(large, "large-buckets")
    rows = band_rows(nodes, at)
    if large.isEmpty():
        return rows
    tiled = rows.join(large, "bucket", "left").withColumn("tiles", F.coalesce("tiles", F.lit(1).cast("long")))
    tiled = tiled.withColumn("t", F.pmod(F.xxhash64("node", F.lit(7)), F.col("tiles"))).withColumn("o", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1)))
    dealt = F.when(F.col("tiles") == 1, F.col("bucket")).otherwise(F.xxhash64("bucket", F.least("t", "o"), F.greatest("t", "o")))
    return tiled.select(dealt.alias("bucket"), *rows.columns[1:])


def _settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (bucket, node, root, fp, z) sorted by bucket to links (a, b) between groups of a bucket: of each pair within FULL_RADIUS of all bits whose groups still differ, the sets are compared."""
    unpack = zstandard.ZstdDecompressor()

    def links_of(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        fp = np.frombuffer(b"".join(r[3] for r in rows), np.uint64).reshape(len(rows), -1)
        group = np.unique(np.array([r[2] for r in rows]), return_inverse=True)[1]
        sets: list[np.ndarray | None] = [None] * len(rows)
        out = []
        for i, j in close_pairs(fp, np.full(len(rows), len(rows)), FULL_RADIUS):
            at = np.flatnonzero(group[i] != group[j])
            for x, y in zip(i[at].tolist(), j[at].tolist(), strict=True):
                if group[x] == group[y]:
                    continue
                for k in (x, y):
                    if sets[k] is None:
                        sets[k] = shingles(unpack.decompress(rows[k][4]))
                if alike(sets[x], sets[y]):
                    group[group == group[y]] = group[x]
                    out.append((min(rows[x][1], rows[y][1]), max(rows[x][1], rows[y][1])))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out, strict=True)], names=["a", "b"])

    rows: list[tuple] = []
    for batch in batches:
        for row in zip(*(batch.column(k).to_pylist() for k in ("bucket", "node", "root", "fp", "z")), strict=True):
            if rows and row[0] != rows[-1][0]:
                yield from links_of(rows)
                rows = []
            rows.append(row)
    if rows:
        yield from links_of(rows)


def alike(x: np.ndarray, y: np.ndarray) -> bool:
    """Whether the Jaccard similarity of two sorted sets is SIMILAR hundredths or more."""
    if 100 * min(len(x), len(y)) < SIMILAR * max(len(x), len(y)):
        return False
    both = np.sort(np.concatenate((x, y)))
    same = int((both[1:] == both[:-1]).sum())
    return 100 * same >= SIMILAR * (len(x) + len(y) - same)


def _alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b, za, zb) to (a, b, alike): whether the Jaccard similarity of the texts' shingles is SIMILAR hundredths or more."""
    unpack, known = zstandard.ZstdDecompressor(), {}

    def of(node: int, z: bytes) -> np.ndarray:
        if node not in known:
            if len(known) >= 64:
                known.clear()
            known[node] = shingles(unpack.decompress(z))
        return known[node]

    for batch in batches:
        out = []
        for a, b, za, zb in zip(*(batch.column(k) for k in ("a", "b", "za", "zb")), strict=True):
            out.append(alike(of(a.as_py(), za.as_py()), of(b.as_py(), zb.as_py())))
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(out, pa.bool_())], names=["a", "b", "alike"])


def _confirmed(texts: DataFrame, nodes: DataFrame, pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """a, b, alike for every pair (a, b) of nodes, by one text of each; and these texts, as node, z. texts: _fx_nk, _fx_nh, _fx_text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            z = pa.array([pack.compress(t.as_py() or b"") for t in batch.column("_fx_text")], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("_fx_nk"), batch.column("_fx_nh"), z], names=["_fx_nk", "_fx_nh", "z"])

    ends = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    named = stage(nodes.drop("fp").join(ends, "node", "left_semi"), "candidates")
    # Only texts that a sieve of the candidates lets through move, compressed. A row that repeats wholly gives its node's text again.
    packed = sieve(texts, named, ["_fx_nk", "_fx_nh"])[0].mapInArrow(run, "_fx_nk string, _fx_nh long, z binary")
    packed = stage(packed.join(named, ["_fx_nk", "_fx_nh"]).select("node", "z").dropDuplicates(["node"]), "candidate-texts")
    both = pairs.join(packed.select(F.col("node").alias("a"), F.col("z").alias("za")), "a").join(packed.select(F.col("node").alias("b"), F.col("z").alias("zb")), "b")
    return stage(both.select("a", "b", "za", "zb").mapInArrow(_alike, "a long, b long, alike boolean"), "confirmed"), packed


def similar(docs: DataFrame, *keep: str) -> DataFrame:
    """`keep`, doc_id, root for every row of docs: texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more, and chains of them, have one root.

    A node is a set of shingles, with a fingerprint of WIDE bits. Candidates are nodes that share a band of the fingerprint, see bands(), and differ in WIDE_RADIUS of the first 128 bits
    at most, which are compared bit-sliced where the band's rows meet; of pairs at 0.8 about 1 in 150 fails one of the two. The bits only choose candidates: these are linked only if the similarity of their sets, counted exactly on the
    whole texts, is 0.8 or more. First the pairs of a spanning forest of each bucket are counted; where one is refused and
    leaves its ends apart, all pairs between different groups of that tree are that differ in FULL_RADIUS of all bits at most, where the tree's texts meet. So of a group of copies only few pairs are written. Null, empty, very long and
    repeated texts are treated as in near_duplicates(); further columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles(t.as_py()) for t in batch.column("_fx_text")]
            node = np.array([xxhash.xxh64_intdigest(s.tobytes(), SEED) for s in sets], np.uint64).view(np.int64)
            fp = pa.array([wide_bits(s) for s in sets], pa.binary())
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in names), pa.array(node), fp], names=[*names, "node", "fp"])

    names = ("doc_id", *keep, "_fx_nk", "_fx_nh")
    df = docs.select("doc_id", *keep, group_key("doc_id").alias("_fx_nk"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("_fx_nh"), F.col("text").cast("binary").alias("_fx_text"))
    rows = df.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name in names) + ", node long, fp binary")
    rows = stage(rows, "wide-fingerprints")
    one = F.min(F.struct("_fx_nk", "_fx_nh")).alias("one")
    nodes = stage(rows.groupBy("node").agg(one, F.first("fp").alias("fp")).select("node", "one.*", "fp"), "distinct-fingerprints")
    spread = _dealt_bands(nodes, bands(nodes.count())).repartition(F.col("bucket")).sortWithinPartitions("bucket", "node")
    forest = stage(spread.mapInArrow(_linker(WIDE_RADIUS, WIDE_ROWS, _forest), "a long, b long, tree long"), "forest")
    found, packed = _confirmed(df.select("_fx_nk", "_fx_nh", "_fx_text"), nodes, stage(forest.select("a", "b").distinct(), "candidate-pairs"))
    roots = components(found.filter("alike").select("a", "b"))
    of = lambda n: roots.select(F.col("node").alias(n), F.col("root").alias(f"r{n}"))
    refused = found.filter("not alike").join(of("a"), "a", "left").join(of("b"), "b", "left").filter("coalesce(ra, a) <> coalesce(rb, b)")
    trees = forest.join(stage(refused.select("a", "b"), "refused-pairs"), ["a", "b"], "left_semi").select("tree").distinct()
    several = forest.join(trees, "tree", "left_semi").groupBy("tree").count().filter("count > 1").select("tree")
    several = stage(several, "open-trees")
    if not several.isEmpty():
        members = forest.join(several, "tree", "left_semi").select(F.col("tree").alias("bucket"), F.explode(F.array("a", "b")).alias("node")).distinct()
        members = _tiles(stage(members, "open-members").withColumn("fp", F.col("node")), min(BUCKET, 512)).select("bucket", "node")
        members = members.join(nodes.select("node", "fp"), "node").join(packed, "node").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        more = members.select("bucket", "node", "root", "fp", "z").repartition(F.col("bucket")).sortWithinPartitions("bucket", "node").mapInArrow(_settle, "a long, b long")
        more = stage(more.distinct(), "further-links")
        roots = joined(roots, more)
    return rows.join(roots, "node", "left").select("doc_id", *keep, F.coalesce("root", "node").alias("root"))


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of each group of similar() texts, that of the smallest doc_id (null last), with all its columns."""
    keyed = with_key(docs)
    found = stage(similar(keyed, "_fx_k", "_fx_th"), "near-duplicates")
    order = F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "_fx_th", "_fx_k")
    stays = found.groupBy("root").agg(F.min(order).alias("s")).select("root", "s._fx_k", "s._fx_th", F.lit(True).alias("stays"))
    keys = ["_fx_k", "_fx_th"]
    gone = stage(found.join(stays, ["root", *keys], "left").filter("stays is null").select(*keys).distinct(), "gone")
    # Rows that repeat wholly have one key: of those that stay, one row does.
    many = stage(found.groupBy(*keys).count().filter("count > 1").select(*keys), "repeated-rows")
    maybe, kept = sieve(keyed, gone.union(many), keys)
    left = maybe.join(gone, keys, "left_anti")
    kept = kept.select("_fx_row")
    if many.isEmpty():
        return kept.union(left.select("_fx_row")).select("_fx_row.*")
    one = left.join(many, keys, "left_semi").groupBy(*keys).agg(F.first("_fx_row").alias("_fx_row"))
    return kept.union(left.join(many, keys, "left_anti").select("_fx_row")).union(one.select("_fx_row")).select("_fx_row.*")
