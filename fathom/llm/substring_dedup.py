"""Repeated substrings of SPAN bytes, found with run-length indexes.

1. Anchors. Of every SPAN-byte window the K-byte gram with the smallest hash is its anchor, so equal
   windows have equal anchors, wherever they stand. The windows of one anchor are one segment of text.
   Segments whose anchor's gram occurs once in the corpus hold no repeated window and are left.
2. Index. Equal segments are one with a count before any text moves. The distinct segments of a gram that has several go to one task, a block of grams at a
   time. A block's Burrows-Wheeler transform is kept as runs with the text positions sampled at
   run starts and run ends; the common prefixes computed at those samples are enough to stream the match
   length of every position with its neighbours before and after in suffix order, as within a run each is one
   less than at the position before. Windows that match SPAN bytes, and all those of segments that
   occur more than once, are repeated.
3. A gram with more distinct segments than MOST_SEGMENTS (text that borders a very common passage) is lengthened:
   of the bytes that its windows have around it, at least half lie to one side, and the gram grows by that many there.
   Each segment falls into at most two, equal ones are again one with a count, and each longer gram is indexed or
   lengthened as before. After eight times at most a gram is a whole window and has one segment.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession, functions as F

from fathom.llm._common import join_counted, stage, table

SPAN = 200
K = 64
#: Bytes that are hashed, and indexed, at a time.
CHUNK, BLOCK = 1 << 19, 1 << 20
#: Distinct segments of a gram that are indexed in one block; a gram with more is lengthened.
MOST_SEGMENTS = 1024
#: A position and a length share a long with bits that tell apart documents whose 64-bit key is the same.
POS_SHIFT, TAG_SHIFT = 9, 40
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def _byte_codes() -> np.ndarray:
    return np.random.default_rng(200).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)


def gram_hashes(buf: np.ndarray, codes: np.ndarray, k: int = K) -> np.ndarray:
    """A mixed hash of the k bytes (k a power of two) from each position on; the last k - 1 are of no use."""
    h, p, have = codes[buf], MULTIPLIER, 1
    with np.errstate(over="ignore"):
        while have < k:
            h[:-have] = h[:-have] * p + h[have:]
            p, have = p * p, have * 2
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(32)
    return h


def segments(docs: list[bytes], codes: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """(document number, anchor hash, start, length) arrays of the segments, for documents that fill a chunk at a time.

    A document beyond a chunk is cut into pieces that overlap by SPAN - 1 bytes: every window is in one.
    """
    pieces, held = [], 0
    for no, text in enumerate(docs):
        for at in range(0, max(0, len(text) - SPAN + 1), CHUNK):
            piece = text[at : at + CHUNK + SPAN - 1]
            if held + len(piece) > CHUNK and pieces:
                yield _segments(pieces, codes)
                pieces, held = [], 0
            pieces.append((no, at, piece))
            held += len(piece)
    if pieces:
        yield _segments(pieces, codes)


def _segments(pieces: list[tuple[int, int, bytes]], codes: np.ndarray) -> tuple[np.ndarray, ...]:
    buf = np.frombuffer(b"".join(p for _, _, p in pieces), np.uint8)
    n, low = len(buf), np.uint64((1 << 24) - 1)
    h = gram_hashes(buf, codes)
    least, have, width = (h & ~low) | np.arange(n, dtype=np.uint64), 1, SPAN - K + 1
    while have * 2 <= width:
        np.minimum(least[:-have], least[have:], out=least[:-have])
        have *= 2
    if width > have:
        np.minimum(least[: have - width], least[width - have :], out=least[: have - width])
    size = np.fromiter((len(p) for _, _, p in pieces), np.int64, len(pieces))
    off = np.cumsum(size) - size
    inside = np.zeros(n + 1, np.int8)
    np.add.at(inside, off, 1)
    np.add.at(inside, off + size - SPAN + 1, -1)
    at = np.flatnonzero(np.cumsum(inside[:-1], dtype=np.int8))
    anchor = (least[at] & low).astype(np.int64)
    new = np.concatenate(([True], (anchor[1:] != anchor[:-1]) | (at[1:] != at[:-1] + 1)))
    first = at[new]
    last = np.concatenate((at[np.flatnonzero(new)[1:] - 1], at[-1:]))
    piece = np.searchsorted(off, first, "right") - 1
    no, base = (np.array([p[k] for p in pieces], np.int64) for k in (0, 1))
    return no[piece], h[anchor[new]], base[piece] + first - off[piece], last - first + SPAN


def anchor_rows(docs: DataFrame) -> DataFrame:
    """g, n, h, sh, dk, pos: one row per segment. g deals them out.

    Where a batch has a gram twice, its segments are known to be live (n = -1) and are dealt out by document; one
    row with n = 2 stands for them where the gram is counted, so a very common gram meets few rows there.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, tag_bits = _byte_codes(), np.int64((1 << (63 - TAG_SHIFT)) - 1)
        for batch in batches:
            texts, keys, tags = batch.column("text").to_pylist(), batch.column("dk").to_numpy(), batch.column("tag").to_numpy().astype(np.int64) & tag_bits
            parts = list(segments(texts, codes))
            if not parts:
                continue
            no, h, start, size = (np.concatenate(x) for x in zip(*parts, strict=True))
            digest = xxhash.xxh3_64_intdigest
            sh = np.array([digest(texts[d][a:b]) for d, a, b in zip(no.tolist(), start.tolist(), (start + size).tolist(), strict=True)], np.uint64).view(np.int64)
            h = h.view(np.int64)
            dk, pos = keys[no], (tags[no] << TAG_SHIFT) | (start << POS_SHIFT) | size
            names, back, count = np.unique(h, return_inverse=True, return_counts=True)
            known = count[back] > 1
            twice = names[count > 1]
            zero = np.zeros(len(twice), np.int64)
            g = np.concatenate((np.where(known, dk ^ pos, h), twice))
            n = np.concatenate((np.where(known, -1, 1), zero + 2)).astype(np.int8)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (g, n, *(np.concatenate((x, y)) for x, y in ((h, twice), (sh, zero), (dk, zero), (pos, zero))))], names=["g", "n", "h", "sh", "dk", "pos"])

    return docs.select("text", "dk", "tag").mapInArrow(run, "g long, n byte, h long, sh long, dk long, pos long")


def _live(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by g, those whose gram occurs twice or more. Of the last gram at most a batch and one row are held."""
    names = ("n", "h", "sh", "dk", "pos")
    held = None
    for batch in batches:
        new = {k: batch.column(k).to_numpy() for k in names}
        known = new["n"] < 0
        if known.any():
            yield pa.RecordBatch.from_arrays([pa.array(new[k][known]) for k in names[1:]], names=list(names[1:]))
        rows = {k: np.concatenate((held[k], v[~known])) if held else v[~known] for k, v in new.items()}
        if len(rows["h"]):
            yield from _repeated(rows)
            last = rows["n"][rows["h"] == rows["h"][-1]]
            # Of a gram already found twice only a mark goes on; of one found once, its row.
            held = {k: v[-1:] if k != "n" or len(last) == 1 else np.array([2], v.dtype) for k, v in rows.items()}


def _repeated(rows: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
    if len(rows["h"]):
        edge = np.concatenate(([True], rows["h"][1:] != rows["h"][:-1]))
        run = np.cumsum(edge) - 1
        keep = (np.bincount(run, rows["n"])[run] > 1.5) & (rows["n"] == 1)
        if keep.any():
            yield pa.RecordBatch.from_arrays([pa.array(v[keep]) for k, v in rows.items() if k != "n"], names=[k for k in rows if k != "n"])


def match_lengths(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Longest match of each position with any other of these texts, and where each text starts in that array.

    The array has one position more per text, for its end. See the module's text for the method.
    """
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    start = np.concatenate(([0], np.cumsum(size + 1)[:-1]))
    end = start + size
    sym = np.zeros(int(end[-1]) + 1 + 7, np.int64)
    sym[:-7] = np.frombuffer(b"\0".join(texts) + b"\0", np.uint8)
    n = len(sym) - 7
    sym[:n] += 1
    sym[end] = 0
    left = np.repeat(end, size + 1) - np.arange(n)
    key = np.zeros(n, np.int64)
    for k in range(7):
        key = (key << 9) | np.where(left > k, sym[k : n + k], 0)
    packed, rank, have = key, None, 7
    longest = int(size.max()) + 1
    while True:
        order = np.argsort(key)
        value = key[order]
        new = np.concatenate(([True], value[1:] != value[:-1]))
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(new)
        if new.all() or have >= longest:
            break
        ahead = np.zeros(n, np.int64)
        ahead[: n - have] = rank[have:]
        key = rank * (n + 1) + np.where(left >= have, ahead, 0)
        have *= 2
    sa = np.argsort(rank * n + np.arange(n))
    bwt = sym[sa - 1]  # the end symbol of the last text precedes the first
    # Ends differ from each other, so a text's first position always starts and ends a run.
    border = (bwt[1:] != bwt[:-1]) | (bwt[1:] == 0)
    rows = np.flatnonzero(border)
    a, b = sa[rows], sa[rows + 1]
    common, live = np.zeros(len(rows), np.int64), np.arange(len(rows))
    limit = np.minimum(left[a], left[b])
    while len(live):
        x = packed[np.minimum(a[live] + common[live], n - 1)] ^ packed[np.minimum(b[live] + common[live], n - 1)]
        same = x == 0
        # Bits of the highest difference: the symbols before it agree.
        top = np.where(same, 0, np.log2(np.maximum(x, 1).astype(np.float64) * (1 + 1e-15)).astype(np.int64))
        wrong = (~same) & ((x >> top) == 0)
        top = top - wrong
        common[live] = np.minimum(common[live] + np.where(same, 7, 6 - top // 9), limit[live])
        live = live[same & (common[live] < limit[live])]
    out = np.zeros(n, np.int64)
    index = np.arange(n)
    for at, extra in ((b, sa[:1]), (a, sa[-1:])):
        sample = np.full(n, -1, np.int64)
        value = np.zeros(n, np.int64)
        sample[at], value[at] = at, common
        sample[extra], value[extra] = extra, 0
        sample = np.maximum.accumulate(sample)
        out = np.maximum(out, value[sample] - (index - sample))
    return out, start


def _spans(starts: np.ndarray) -> bytes:
    """Merged (from, to) byte ranges, as little int32 pairs, of windows that start at the sorted `starts`."""
    if not len(starts):
        return b""
    cut = np.flatnonzero(starts[1:] > starts[:-1] + SPAN)
    lo = starts[np.concatenate(([0], cut + 1))]
    hi = starts[np.concatenate((cut, [len(starts) - 1]))] + SPAN
    return np.stack((lo, hi), 1).astype(np.int32).tobytes()


def _index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(h, sh, n, bytes) sorted by h to (h, sh, n, spans): whole grams, a block of about BLOCK bytes at a time."""
    rows: list[tuple] = []
    held, block_end = 0, 0
    for batch in batches:
        for row in zip(*(batch.column(k).to_pylist() for k in ("h", "sh", "n", "bytes")), strict=True):
            if held >= BLOCK and row[0] != rows[-1][0]:
                yield from _index_block(rows)
                rows, held = [], 0
            rows.append(row)
            held += len(row[3])
    yield from _index_block(rows)


def _index_block(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
    if not rows:
        return
    length, start = match_lengths([r[3] for r in rows])
    out = []
    for (h, sh, n, text), at in zip(rows, start.tolist(), strict=True):
        windows = len(text) - SPAN + 1
        where = np.arange(windows) if n > 1 else np.flatnonzero(length[at : at + windows] >= SPAN)
        if len(where):
            out.append((h, sh, n, _spans(where)))
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)], names=["h", "sh", "n", "spans"])


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(h, sh, n, size) to (h, sh, n, spans) of the whole segment."""
    for batch in batches:
        size = batch.column("size").to_numpy()
        spans = [x.tobytes() for x in np.stack((np.zeros_like(size), size), 1).astype(np.int32)]
        yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in ("h", "sh", "n")), pa.array(spans, pa.binary())], names=["h", "sh", "n", "spans"])


def _lengthen(segs: DataFrame, wide: int, more: int) -> DataFrame:
    """h, sh, n, at, h2, sh2, lo2, bytes: the parts of segments under grams of wide + more bytes, each from `at` on.

    The windows of a segment hold the `wide` bytes from lo on (null: its anchor). Those with `more` bytes or
    further before them take these into the gram, the others have as many behind them and take those. Equal windows
    have the same bytes on each side, so they go the same way and meet again.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, digest, low = _byte_codes(), xxhash.xxh3_64_intdigest, np.uint64((1 << 24) - 1)
        for batch in batches:
            out: list[tuple] = []
            for h, sh, n, lo, text in zip(*(batch.column(k).to_pylist() for k in ("h", "sh", "n", "lo", "bytes")), strict=True):
                if lo is None:
                    lo = int(np.argmin(gram_hashes(np.frombuffer(text[:SPAN], np.uint8), codes)[: SPAN - K + 1] & ~low))
                windows = len(text) - SPAN + 1
                cut = min(windows, max(0, lo - more + 1))
                for side, a, b, known in ((b"l", 0, cut, lo - more), (b"r", cut, windows, lo)):
                    if a < b:
                        part = text[a : b - 1 + SPAN]
                        out.append((h, sh, n, a, digest(side + text[known : known + wide + more]), digest(part), known - a, part))
            if out:
                h, sh, n, at, h2, sh2, lo2, part = zip(*out, strict=True)
                signed = (np.array(x, np.uint64).view(np.int64) for x in (h2, sh2))
                yield pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in (h, sh, n, at)), *(pa.array(x) for x in signed), pa.array(lo2, pa.int64()), pa.array(part, pa.binary())], names=["h", "sh", "n", "at", "h2", "sh2", "lo2", "bytes"])

    return segs.select("h", "sh", "n", "lo", "bytes").mapInArrow(run, "h long, sh long, n long, at long, h2 long, sh2 long, lo2 long, bytes binary")


def with_kinds(distinct: DataFrame) -> DataFrame:
    """distinct (h, sh, ..; a written table) with kinds: how many rows its h has."""
    kinds = distinct.groupBy("h").agg(F.count(F.lit(1)).alias("kinds"))
    return join_counted(distinct, stage(kinds.withColumn("_fx_n", F.col("kinds")), "kinds"), ["h"], "_fx_n", distinct.count())


def indexed(segs: DataFrame, wide: int = K) -> DataFrame:
    """h, sh, n, at, spans of segs (h, sh, n, kinds, lo, bytes; a written table), whose spans count from `at` in the segment."""
    more = -(-(SPAN - wide) // 2)
    few = F.col("kinds") <= MOST_SEGMENTS if more else F.lit(True)
    found = segs.filter(few).select("h", "sh", "n", "bytes").repartition("h").sortWithinPartitions("h").mapInArrow(_index, "h long, sh long, n long, spans binary")
    found = found.withColumn("at", F.lit(0).cast("long"))
    if (hot := segs.filter(~few)).isEmpty():
        return found
    parts = stage(_lengthen(hot, wide, more), "parts")
    one = parts.groupBy(F.col("h2").alias("h"), F.col("sh2").alias("sh")).agg(F.sum("n").alias("n"), F.any_value("lo2").alias("lo"), F.any_value("bytes").alias("bytes"))
    one = stage(with_kinds(stage(one, "distinct-parts")), "counted-parts")
    alone = one.filter("kinds = 1 and n > 1").select("h", "sh", "n", F.length("bytes").cast("long").alias("size")).mapInArrow(_whole, "h long, sh long, n long, spans binary")
    deeper = stage(indexed(one.filter("kinds > 1"), wide + more).unionByName(alone.withColumn("at", F.lit(0).cast("long"))), "part-spans")
    total = parts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    side = deeper.select(F.col("h").alias("h2"), F.col("sh").alias("sh2"), F.col("n").alias("_fx_n"), F.col("at").alias("from"), "spans")
    back = join_counted(parts.select("h", "sh", "n", "at", "h2", "sh2"), side, ["h2", "sh2"], "_fx_n", total)
    return found.unionByName(back.select("h", "sh", "n", (F.col("at") + F.col("from")).alias("at"), "spans"))


def _cut_segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents with the segments wanted of them to (h, sh, n, kinds, bytes)."""
    unpack = zstandard.ZstdDecompressor()
    for batch in batches:
        out: list[tuple] = []
        for z, wanted in zip(batch.column("z").to_pylist(), batch.column("wanted").to_pylist(), strict=True):
            text = unpack.decompress(z)
            for s in wanted:
                at, size = (s["pos"] & ((1 << TAG_SHIFT) - 1)) >> POS_SHIFT, s["pos"] & ((1 << POS_SHIFT) - 1)
                out.append((s["h"], s["sh"], s["n"], s["kinds"], text[at : at + size]))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)], names=["h", "sh", "n", "kinds", "bytes"])


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents with their repeated ranges to the result's rows."""
    unpack = zstandard.ZstdDecompressor()
    for batch in batches:
        out: dict[str, list] = {k: [] for k in ("n_bytes", "n_removed", "n_spans", "kept_sha256", "spans")}
        for z, found in zip(batch.column("z").to_pylist(), batch.column("found").to_pylist(), strict=True):
            text = unpack.decompress(z)
            merged: list[list[int]] = []
            if found:
                ranges = np.concatenate([np.frombuffer(f["spans"], np.int32).reshape(-1, 2).astype(np.int64) + f["at"] for f in found])
                for lo, hi in ranges[np.argsort(ranges[:, 0], kind="stable")].tolist():
                    if merged and lo <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], hi)
                    else:
                        merged.append([lo, hi])
            digest, at = hashlib.sha256(), 0
            for lo, hi in merged:
                digest.update(text[at:lo])
                at = hi
            digest.update(text[at:])
            for k, v in (("n_bytes", len(text)), ("n_removed", sum(hi - lo for lo, hi in merged)), ("n_spans", len(merged)), ("kept_sha256", digest.hexdigest()), ("spans", merged)):
                out[k].append(v)
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.list_(pa.int64())))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(v, t) for v, t in zip(out.values(), kinds, strict=True))], names=["doc_id", *out])


def _compress(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    pack = zstandard.ZstdCompressor(level=1)
    for batch in batches:
        yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in ("doc_id", "dk", "tag")), pa.array([pack.compress(t) for t in batch.column("text").to_pylist()], pa.binary())], names=["doc_id", "dk", "tag", "z"])


def repeated_spans(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans ([from, to) byte ranges) for each row of docs.

    A null text is empty; texts under SPAN bytes keep all. Repeated rows repeat each other's bytes and lose
    them all. An empty table gives no rows; further columns are ignored; a null doc_id is a document too.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    tag = F.shiftrightunsigned(F.xxhash64(F.lit("tag"), text), TAG_SHIFT + 1)
    keyed = docs.select("doc_id", text.cast("binary").alias("text"), F.xxhash64("doc_id", text).alias("dk"), tag.alias("tag"))
    live = anchor_rows(keyed).repartition("g").sortWithinPartitions("g").mapInArrow(_live, "h long, sh long, dk long, pos long")
    live = stage(live, "live-segments")
    one = F.min(F.struct("dk", "pos")).alias("one")
    distinct = stage(live.groupBy("h", "sh").agg(F.count(F.lit(1)).alias("n"), one), "distinct-segments")
    distinct = with_kinds(distinct)
    # Of a gram with one segment all windows repeat if it occurs more than once, and none if not (a batch or a cut document showed it twice).
    alone = distinct.filter("kinds = 1 and n > 1").select("h", "sh", "n", F.col("one.pos").bitwiseAND(F.lit((1 << POS_SHIFT) - 1)).alias("size")).mapInArrow(_whole, "h long, sh long, n long, spans binary")
    wanted = distinct.filter("kinds > 1").select("one.dk", F.shiftrightunsigned("one.pos", TAG_SHIFT).alias("tag"), F.struct("h", "sh", "n", F.col("one.pos").alias("pos"), "kinds").alias("s"))
    wanted = wanted.groupBy("dk", "tag").agg(F.collect_list("s").alias("wanted"))
    kind = dict(docs.dtypes)["doc_id"]
    packed = keyed.mapInArrow(_compress, f"doc_id {kind}, dk long, tag long, z binary").repartition("dk", "tag")
    cut = packed.join(wanted, ["dk", "tag"]).dropDuplicates(["dk", "tag"]).select("z", "wanted").mapInArrow(_cut_segments, "h long, sh long, n long, kinds long, bytes binary")
    cut = stage(cut.withColumn("lo", F.lit(None).cast("long")), "segments")
    spans = stage(indexed(cut).unionByName(alone.withColumn("at", F.lit(0).cast("long"))), "spans")
    start = F.shiftrightunsigned(F.col("pos").bitwiseAND(F.lit((1 << TAG_SHIFT) - 1)), POS_SHIFT)
    of_spans = spans.select("h", "sh", F.col("n").alias("_fx_n"), "at", "spans")
    found = join_counted(live, of_spans, ["h", "sh"], "_fx_n", live.count()).select("dk", F.shiftrightunsigned("pos", TAG_SHIFT).alias("tag"), F.struct((start + F.col("at")).alias("at"), "spans").alias("f"))
    found = found.groupBy("dk", "tag").agg(F.collect_set("f").alias("found"))
    done = packed.join(found, ["dk", "tag"], "left").select("doc_id", "z", "found")
    return done.mapInArrow(_remove, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<array<bigint>>")


def op1_run_length_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_spans(table(spark, sf_dir, "documents")).drop("spans")
