"""Language-model scores from a log-frequency Bloom filter.

Counts of words and word pairs are quantised to level(c) = 1 + floor(log2 c), 0 for those not seen. The
filter holds the items (n-gram, 1) .. (n-gram, level); a probe asks for level 1, 2, ... until one is missing.
The probability of a word is smoothed with the word before it and with the words' shares,

    p(w | v) = (c(v, w) + m * p(w)) / (c(v) + m),   p(w) = (c(w) + 1) / (N + V + 1)

with the counts that the probes give, each the middle of its level. m is the one of STRENGTHS under which the training texts are most
probable, each without what it added to the counts itself; the held-out texts have no part in it.

The filter grows with the corpus, so it is never broadcast whole: n-grams go to slices by hash, a slice counts its n-grams and
builds its part of the filter, and probes go to the slice that would hold them, each n-gram once for
a chunk of texts. A chunk gets its answers back and scores its texts. So the texts are read a fixed number of times at any size, nothing
reaches the driver but a few sums, and a task holds one slice or one chunk.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from fathom.llm._common import stage, table

FOLDS, HELD = 7, 2
#: Pseudo-counts of the words' shares after each word that are tried.
STRENGTHS = tuple(float(4**k) for k in range(8))
#: Bits of the filter per item; an item's BITS bits stand in one 64-bit word.
ITEM_BITS, BITS = 16, 4
#: Text bytes of the corpus for each slice, about; slices are a power of two.
SLICE_BYTES = 8 << 20
MAX_LEVEL = 63
PIECE = 1 << 20
#: Text bytes of a chunk, about (a longer text is a chunk by itself), and those that are scored at a time.
CHUNK_BYTES, SCORE_BYTES = 8 << 20, 2 << 20
M = 0x9E3779B97F4A7C15
SPACES = np.isin(np.arange(256), (9, 10, 11, 12, 13, 32))


def mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
        x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
        return x ^ (x >> np.uint64(33))


END = int(mix(np.array([1], np.uint64))[0])


class Tokens:
    """64-bit hashes of the words of texts, lower-cased A-Z: a polynomial of random byte codes, mixed."""

    def __init__(self) -> None:
        self.codes = np.random.default_rng(5).integers(1, 1 << 63, 256, dtype=np.uint64)
        self.codes[65:91] = self.codes[97:123]
        self._grow(PIECE + 1)

    def _grow(self, n: int) -> None:
        with np.errstate(over="ignore"):
            self.power, self.inverse = (np.multiply.accumulate(np.concatenate((np.ones(1, np.uint64), np.full(n, m, np.uint64)))) for m in (M, pow(M, -1, 1 << 64)))

    def words(self, data: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the words and where they start."""
        buf = np.frombuffer(data, np.uint8)
        if len(buf) >= len(self.power):
            self._grow(len(buf) + 1)
        gap = np.concatenate(([True], SPACES[buf], [True]))
        start = np.flatnonzero(gap[:-1] & ~gap[1:])
        end = np.flatnonzero(~gap[:-1] & gap[1:])
        with np.errstate(over="ignore"):
            sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(self.codes[buf] * self.power[: len(buf)], dtype=np.uint64)))
            h = (sums[end] - sums[start]) * self.inverse[start]
            return mix(h ^ (end - start).astype(np.uint64) * np.uint64(M)), start

    def of(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all texts' tokens, each text closed by END, and how many tokens each has."""
        parts: list[np.ndarray] = []
        counts = np.zeros(len(texts), np.int64)
        group: list[bytes] = []
        first = held = 0

        def close() -> None:
            nonlocal group, held
            if group:
                size = np.fromiter(map(len, group), np.int64, len(group)) + 1
                h, start = self.words(b" ".join(group))
                own = np.searchsorted(np.cumsum(size), start, "right")
                n = np.bincount(own, minlength=len(group))
                counts[first : first + len(group)] = n + 1
                parts.append(np.insert(h, np.cumsum(n), np.uint64(END)))
                group, held = [], 0

        for i, text in enumerate(texts):
            if len(text) > PIECE:
                close()
                n = 0
                for piece in _pieces(text):
                    parts.append(self.words(piece)[0])
                    n += len(parts[-1])
                parts.append(np.array([END], np.uint64))
                counts[i] = n + 1
                continue
            if held + len(text) > PIECE:
                close()
            if not group:
                first = i
            group.append(text)
            held += len(text) + 1
        close()
        return (np.concatenate(parts) if parts else np.zeros(0, np.uint64)), counts


def _pieces(text: bytes) -> Iterator[bytes]:
    """A long text cut at spaces, about PIECE bytes each."""
    at = 0
    while at < len(text):
        to = min(len(text), at + PIECE)
        while to < len(text) and not SPACES[text[to]]:
            to += 1
        yield text[at:to]
        at = to


def pairs(tokens: np.ndarray) -> np.ndarray:
    """Hash of each token with the one before it; the first of a text follows END."""
    before = np.concatenate((np.array([END], np.uint64), tokens[:-1])) if len(tokens) else tokens
    with np.errstate(over="ignore"):
        return mix(before * np.uint64(0xD6E8FEB86659FD93) + tokens) & ~np.uint64(0xFFFF)


def _pack(keys: np.ndarray, counts: np.ndarray) -> bytes:
    """Sorted keys as differences, byte planes apart, compressed with their counts."""
    step = np.diff(keys, prepend=np.uint64(0))
    planes = step.view(np.uint8).reshape(-1, 8).T
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes).tobytes() + counts.astype(np.int64).view(np.uint8).reshape(-1, 8).T.tobytes())


def _unpack(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    keys, counts = raw.reshape(2, 8, -1)
    with np.errstate(over="ignore"):
        return np.cumsum(np.ascontiguousarray(keys.T).view(np.uint64).ravel(), dtype=np.uint64), np.ascontiguousarray(counts.T).view(np.int64).ravel()


def _sum_by_key(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    new = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
    return keys[new], (np.add.reduceat(counts, new) if len(new) else counts)


def chunk_rows(docs: DataFrame) -> DataFrame:
    """chunk, ids, held, texts (compressed) and size of each: the rows of docs (doc_id, text, held_out) in chunks of about CHUNK_BYTES."""
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack, no, held, size = zstandard.ZstdCompressor(level=1), TaskContext.get().partitionId() << 32, [], 0

        def close() -> pa.RecordBatch:
            rows = pa.Table.from_batches(held)
            texts = rows.column("text").to_pylist()
            lists = [pa.array([rows.column(k).to_pylist()], pa.list_(rows.column(k).type)) for k in ("doc_id", "held_out")]
            columns = [pa.array([no], pa.int64()), *lists, pa.array([pack.compress(b"".join(texts))], pa.binary()), pa.array([list(map(len, texts))], pa.list_(pa.int64()))]
            return pa.RecordBatch.from_arrays(columns, names=["chunk", "ids", "held", "z", "sizes"])

        for batch in batches:
            bytes_ = np.array([len(x.as_buffer()) for x in batch.column("text")], np.int64)
            at = 0
            while at < len(batch):
                room = np.cumsum(bytes_[at:])
                n = max(int(np.searchsorted(room, CHUNK_BYTES - size, "right")), 0 if held else 1)
                if n:
                    held.append(batch.slice(at, n))
                    size += int(room[n - 1])
                at += n
                if at < len(batch):
                    yield close()
                    no, held, size = no + 1, [], 0
        if held:
            yield close()

    return docs.select("doc_id", "text", "held_out").mapInArrow(run, f"chunk long, ids array<{kind}>, held array<boolean>, z binary, sizes array<bigint>")


def _texts(z: bytes, sizes: list[int]) -> list[bytes]:
    whole = zstandard.ZstdDecompressor().decompress(z)
    ends = np.cumsum(sizes).tolist()
    return [whole[b - n : b] for n, b in zip(sizes, ends, strict=True)]


def _grams(reader: Tokens, texts: list[bytes]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(order, distinct n-grams, their counts) of texts."""
    tokens, _ = reader.of(texts)
    for order, grams in ((1, tokens), (2, pairs(tokens))):
        yield order, *np.unique(grams, return_counts=True)


def _by_slice(keys: np.ndarray, slice_bits: int) -> Iterator[tuple[int, int, int]]:
    edge = np.searchsorted(keys >> np.uint64(64 - slice_bits), np.arange((1 << slice_bits) + 1, dtype=np.uint64))
    for s, (a, b) in enumerate(zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True)):
        if b > a:
            yield s, a, b


def count_ngrams(chunks: DataFrame, slice_bits: int) -> DataFrame:
    """slice, grams (order, packed) of the training texts, one row for each chunk, order and slice it touches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Tokens()
        for batch in batches:
            for row in batch.to_pylist():
                texts = [t for t, held in zip(_texts(row["z"], row["sizes"]), row["held"], strict=True) if not held]
                out = [(s, order, _pack(keys[a:b], n[a:b])) for order, keys, n in _grams(reader, texts) for s, a, b in _by_slice(keys, slice_bits)]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.int32(), pa.int32(), pa.binary()), strict=True)], names=["slice", "order", "grams"])

    return chunks.mapInArrow(run, "slice int, order int, grams binary")


def levels(counts: np.ndarray) -> np.ndarray:
    """1 + floor(log2 count)."""
    return np.minimum(np.frexp(counts.astype(np.float64))[1], MAX_LEVEL)


#: The count that a level stands for: none, one, and the middle of 2^(q - 1) to 2^q - 1.
VALUES = np.concatenate(([0.0, 1.0], (3 * 2.0 ** np.arange(1, MAX_LEVEL) - 1) / 2))


def _item(keys: np.ndarray, level: np.ndarray | int) -> tuple[np.ndarray, np.ndarray]:
    """A hash that chooses the word of the filter, and the bits in it."""
    with np.errstate(over="ignore"):
        a = mix(keys + np.asarray(level, np.uint64) * np.uint64(M))
    bits = np.zeros(len(a), np.uint64)
    b = mix(a ^ np.uint64(M))
    for k in range(BITS):
        bits |= np.uint64(1) << ((b >> np.uint64(6 * k)) & np.uint64(63))
    return a >> np.uint64(32), bits


def build_slice(keys: list[np.ndarray], counts: list[np.ndarray]) -> np.ndarray:
    """The filter's words for the n-grams of a slice."""
    items, at = [], []
    for k, c in zip(keys, counts, strict=True):
        q = levels(c)
        for level in range(1, int(q.max(initial=0)) + 1):
            some = k[q >= level]
            items.append(some)
            at.append(np.full(len(some), level, np.uint64))
    item, level = (np.concatenate(x) if x else np.zeros(0, np.uint64) for x in (items, at))
    words = np.zeros(max(1, -(-len(item) * ITEM_BITS // 64)), np.uint64)
    where, bits = _item(item, level)
    np.bitwise_or.at(words, (where * np.uint64(len(words)) >> np.uint64(32)).astype(np.int64), bits)
    return words


def probe(words: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """The level of each n-gram in a slice of the filter, by membership probes; 0 for those not seen."""
    out = np.zeros(len(keys), np.uint8)
    live, level = np.arange(len(keys)), 1
    while len(live) and level <= MAX_LEVEL:
        where, bits = _item(keys[live], level)
        live = live[words[(where * np.uint64(len(words)) >> np.uint64(32)).astype(np.int64)] & bits == bits]
        out[live] = level
        level += 1
    return out


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by slice to one row a slice: tokens, types, the filter's words, the exact token counts."""

    def done(no: int, grams: dict[int, list[bytes]]) -> pa.RecordBatch:
        keys, counts = [], []
        for order in (1, 2):
            parts = [_unpack(g) for g in grams.get(order, [])]
            k, c = _sum_by_key(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])) if parts else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
            keys.append(k)
            counts.append(c)
        row = {"slice": [no], "tokens": [int(counts[0].sum())], "types": [len(keys[0])], "filter": [build_slice(keys, counts).tobytes()], "exact": [_pack(keys[0], counts[0])]}
        kinds = (pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row.values(), kinds, strict=True)], names=list(row))

    now, grams = None, {}
    for batch in batches:
        for no, order, packed in zip(*(batch.column(k).to_pylist() for k in ("slice", "order", "grams")), strict=True):
            if no != now and now is not None:
                yield done(now, grams)
                grams = {}
            now = no
            grams.setdefault(order, []).append(packed)
    if now is not None:
        yield done(now, grams)


def train(chunks: DataFrame, slice_bits: int) -> DataFrame:
    """The model: slice, tokens, types, filter, exact; a row a slice, a written table."""
    grams = count_ngrams(chunks, slice_bits).repartition("slice").sortWithinPartitions("slice")
    return stage(grams.mapInArrow(_merge, "slice int, tokens long, types long, filter binary, exact binary"), "ngram-slices")


def _probes(chunks: DataFrame, slice_bits: int) -> DataFrame:
    """slice, chunk, order, at, grams: the distinct n-grams of a chunk that belong to a slice; at is where they stand among the chunk's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Tokens()
        for batch in batches:
            for row in batch.to_pylist():
                out = [(s, row["chunk"], order, a, _pack(keys[a:b], np.zeros(b - a, np.int64))) for order, keys, _ in _grams(reader, _texts(row["z"], row["sizes"])) for s, a, b in _by_slice(keys, slice_bits)]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.binary()), strict=True)], names=["slice", "chunk", "order", "at", "grams"])

    return chunks.mapInArrow(run, "slice int, chunk long, order int, at long, grams binary")


def _answers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by slice, the model's (chunk null) before the probes, to chunk, order, at, found: a level for each n-gram, and exact counts of single tokens."""
    pack, now = zstandard.ZstdCompressor(level=1), None
    words = np.zeros(1, np.uint64)
    keys, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    for batch in batches:
        out = []
        for s, chunk, order, at, grams, model, exact in zip(*(batch.column(k) for k in ("slice", "chunk", "order", "at", "grams", "filter", "exact")), strict=True):
            if not chunk.is_valid:
                now, words = s.as_py(), np.frombuffer(model.as_py(), np.uint64)
                keys, counts = _unpack(exact.as_py())
                continue
            if s.as_py() != now:  # a slice without training n-grams
                now, words, keys, counts = s.as_py(), np.zeros(1, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
            asked, _ = _unpack(grams.as_py())
            found = probe(words, asked).tobytes()
            if order.as_py() == 1:
                place = np.searchsorted(keys, asked)
                place[place == len(keys)] = 0
                exactly = np.where(keys[place] == asked, counts[place], 0) if len(keys) else np.zeros(len(asked), np.int64)
                found += np.ascontiguousarray(exactly.astype(np.int64).view(np.uint8).reshape(-1, 8).T).tobytes()
            out.append((chunk.as_py(), order.as_py(), at.as_py(), pack.compress(found)))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.int64(), pa.int32(), pa.int64(), pa.binary()), strict=True)], names=["chunk", "order", "at", "found"])


def own_counts(keys: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """How often each token's n-gram stands in its own text."""
    text = np.repeat(np.arange(len(counts), dtype=np.uint64), counts)
    with np.errstate(over="ignore"):
        _, back, n = np.unique(mix(keys ^ (text + np.uint64(1)) * np.uint64(M)), return_inverse=True, return_counts=True)
    return n[back]


def probability_sums(counts: np.ndarray, one: np.ndarray, two: np.ndarray, end_level: int, n: int, v: int, own: tuple[np.ndarray, np.ndarray] | None = None) -> np.ndarray:
    """log10 probability of each text under each of STRENGTHS (a row each), from its tokens' and pairs' levels.

    own, what own_counts() gives for both, is taken off the counts first: then a training text is scored by the others.
    """
    start = np.cumsum(counts) - counts
    before = np.concatenate(([0], one[:-1])).astype(np.int64)
    before[start] = end_level
    single, pair, context = VALUES[one], VALUES[two], VALUES[before]
    if own:
        less = np.concatenate(([0], own[0][:-1]))
        less[start] = 1  # a text has one end
        single, pair, context = (np.maximum(x - y, 0) for x, y in ((single, own[0]), (pair, own[1]), (context, less)))
        n = n - np.repeat(counts, counts)
    share = (single + 1) / (n + v + 1)
    after = np.minimum(pair, context)
    return np.array([np.add.reduceat(np.log10((after + m * share) / (context + m)), start) for m in STRENGTHS])


def _scored(chunks: DataFrame, kind: str, n: int, v: int, end_level: int) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, base, sums, others (null if held out) for each text of chunks, which come with their answers (order, at, found)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, unpack = Tokens(), zstandard.ZstdDecompressor()
        for batch in batches:
            for i in range(len(batch)):
                row = batch.slice(i, 1).to_pylist()[0]
                level, exact = {1: [], 2: []}, []
                for x in sorted(row["found"], key=lambda x: (x["order"], x["at"])):
                    raw = np.frombuffer(unpack.decompress(x["found"]), np.uint8)
                    k = len(raw) // 9 if x["order"] == 1 else len(raw)
                    level[x["order"]].append(raw[:k])
                    if x["order"] == 1:
                        exact.append(np.ascontiguousarray(raw[k:].reshape(8, k).T).view(np.int64).ravel())
                texts = _texts(row["z"], row["sizes"])
                tokens, counts = reader.of(texts)
                both = pairs(tokens)
                back = [np.unique(g, return_inverse=True)[1] for g in (tokens, both)]
                one, two = (np.concatenate(level[order])[b] for order, b in zip((1, 2), back, strict=True))
                c = np.concatenate(exact)[back[0]]
                known = np.log10(c + 1.0)
                # The texts are scored a part at a time, as the sums take a row of doubles for each strength.
                part = np.cumsum(np.array(row["sizes"]) + 1) // SCORE_BYTES
                cuts = [0, *(np.flatnonzero(part[1:] != part[:-1]) + 1).tolist(), len(counts)]
                ends = np.concatenate(([0], np.cumsum(counts)))
                for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                    x, y, own = ends[a], ends[b], counts[a:b]
                    first = np.cumsum(own) - own
                    sums = probability_sums(own, one[x:y], two[x:y], end_level, n, v)
                    others: list[np.ndarray | None] = [None] * (b - a)
                    learnt = ~np.array(row["held"][a:b])
                    if learnt.any():
                        at, size = np.repeat(learnt, own), own[learnt]
                        left = probability_sums(size, one[x:y][at], two[x:y][at], end_level, n, v, tuple(own_counts(g[x:y][at], size) for g in (tokens, both)))
                        for k, column in zip(np.flatnonzero(learnt), left.T, strict=True):
                            others[k] = column
                    columns = [pa.array(row["ids"][a:b], batch.schema.field("ids").type.value_type), pa.array(row["held"][a:b], pa.bool_()), pa.array(own), pa.array(np.add.reduceat((c[x:y] > 0).astype(np.int64), first)), pa.array(np.add.reduceat(known[x:y], first)), pa.array(list(sums.T), pa.list_(pa.float64())), pa.array(others, pa.list_(pa.float64()))]
                    yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "held_out", "n_tokens", "n_known", "base", "sums", "others"])

    return chunks.mapInArrow(run, f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, base double, sums array<double>, others array<double>")


def _end_level(model: DataFrame, slice_bits: int) -> int:
    rows = model.filter(F.col("slice") == END >> (64 - slice_bits)).select("filter").collect()  # one slice
    return int(probe(np.frombuffer(rows[0]["filter"], np.uint64), np.array([END], np.uint64))[0]) if rows else 0


def score(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score and strength (m) for each row of docs.

    A null or empty text is its end alone; a text of any length is one chunk at most. A null doc_id counts as the text ''. Repeated rows are each a text.
    Without training texts N and V are 0, every token is unknown and m is the smallest; an empty table gives no rows. Further columns are
    ignored.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    held = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % FOLDS == HELD
    chunks = stage(chunk_rows(docs.select("doc_id", text.cast("binary").alias("text"), held.alias("held_out"))), "lm-chunks")
    size = chunks.select(F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x))).first()[0] or 0
    slice_bits = max(4, min(20, math.ceil(math.log2(size / SLICE_BYTES + 1))))
    model = train(chunks, slice_bits)
    about = model.agg(F.sum("tokens").alias("n"), F.sum("types").alias("v")).first()
    n, v = about["n"] or 0, about["v"] or 0
    none = lambda *names: [F.lit(None).cast(t).alias(k) for k, t in names]
    probes = _probes(chunks, slice_bits).select("slice", "chunk", "order", "at", "grams", *none(("filter", "binary"), ("exact", "binary")))
    both = model.select("slice", *none(("chunk", "long"), ("order", "int"), ("at", "long"), ("grams", "binary")), "filter", "exact").union(probes)
    found = both.repartition("slice").sortWithinPartitions("slice", F.col("chunk").asc_nulls_first()).mapInArrow(_answers, "chunk long, order int, at long, found binary")
    found = found.groupBy("chunk").agg(F.collect_list(F.struct("order", "at", "found")).alias("found"))
    scored = stage(_scored(chunks.join(found.hint("merge"), "chunk"), dict(docs.dtypes)["doc_id"], n, v, _end_level(model, slice_bits)), "lm-scores")
    totals = scored.agg(*(F.sum(F.get("others", F.lit(k))) for k in range(len(STRENGTHS)))).first()
    best = max(range(len(STRENGTHS)), key=lambda k: totals[k]) if totals[0] is not None else 0
    return scored.select(
        "doc_id", "held_out", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), (F.col("base") - F.col("n_tokens") * math.log10(n + v + 1)).alias("base_score"),
        F.get("sums", F.lit(best)).alias("score"), F.lit(STRENGTHS[best]).alias("strength"),
    )


def op5_bloom_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"))
