"""Byte pair encoding and decoding with a public vocabulary, as its library encodes and decodes.

A word is encoded as a tree: halves are encoded each for itself, down to leaves that are merged outright, and where two encodings meet a
window of tokens around the join is merged anew from its symbols, twice as wide each time, until its first and last token are the ones that
stood there. All neighbours then are as merging leaves them, in the window and at both of its ends. As each token comes from
one merge, of parts that came before it, a sequence all of whose neighbours are such is the encoding of the whole, so the join is exact.

Long texts are dealt out: at white space, where no token crosses, and stretches without any by slices of words. The
parts of a text are encoded in as many tasks, and brought together once, where joins touch a few tokens on each side.
"""

from __future__ import annotations

import functools
import json
import struct
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession, functions as F

from fathom.llm._common import stage, table

#: Symbols of a leaf of the tree.
LEAF = 64
#: Bytes of text that one task encodes at a time; longer texts are dealt out in such parts.
PART = 1 << 16
#: Words whose encodings a task remembers.
REMEMBERED = 1 << 17
#: The lower half of a merge is the id it gives; none ranks last.
ID, NONE = (1 << 32) - 1, 1 << 62
#: Bytes of text that become one Arrow batch of results.
BATCH_BYTES = 2 << 20


def byte_letters() -> list[str]:
    """The character that stands for each byte in byte-level files: itself if it can be printed, else one from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(rest)) for b in range(256)]


class Bpe:
    """The rules of a vocabulary file: its normaliser and word splitter as the library has them, and the merges."""

    def __init__(self, rules: str) -> None:
        from tokenizers import Tokenizer

        spec, whole = json.loads(rules), Tokenizer.from_str(rules)
        model, steps = spec["model"], spec["pre_tokenizer"].get("pretokenizers", [])
        if model["type"] != "BPE" or model.get("dropout") or model.get("continuing_subword_prefix") or model.get("byte_fallback") or model.get("ignore_merges") or spec.get("decoder"):
            raise ValueError("only plain BPE without a decoder is known")
        if [x["type"] for x in steps] != ["Split", "ByteLevel"] or (steps[0]["behavior"], steps[0]["invert"]) != ("Removed", True) or steps[1]["use_regex"] or steps[1]["add_prefix_space"]:
            raise ValueError("only words matched by a pattern, as bytes, are known")
        self.vocab: dict[str, int] = model["vocab"]
        suffix = model.get("end_of_word_suffix") or ""
        self._letters = letters = byte_letters()
        #: A byte's id within a word, and as a word's last.
        self.inner, self.last = [self.vocab.get(c) for c in letters], [self.vocab.get(c + suffix) for c in letters]
        self._bytes = {c: b for b, c in enumerate(letters)}
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        #: Two ids, as one number, to the rank of their merge and the id that they become, as one number.
        self.merges = {self.vocab[a] << 32 | self.vocab[b]: rank << 32 | self.vocab[a + b] for rank, (a, b) in enumerate(pairs)}
        if len({x & ID for x in self.merges.values()}) != len(self.merges):
            raise ValueError("a token that two merges make has no unique parts")
        self.symbols: dict[int, tuple[int, ...]] = {}
        for a, b in pairs:
            left, right = self.vocab[a], self.vocab[b]
            self.symbols[self.vocab[a + b]] = self.symbols.get(left, (left,)) + self.symbols.get(right, (right,))
        added = spec["added_tokens"]
        if any(t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"] for t in added):
            raise ValueError("only added tokens that stand as they are are known")
        self.added = {t["content"]: t["id"] for t in added}
        self.tokens = {i: t for t, i in (self.vocab | self.added).items()}
        self._special = regex.compile("(" + "|".join(regex.escape(t) for t in sorted(self.added, key=len, reverse=True)) + ")") if added else None
        self._normal, self._split = whole.normalizer, whole.pre_tokenizer
        self._light = [x["type"] for x in (spec.get("normalizer") or {}).get("normalizers", [])] == ["NFC", "Replace", "Lowercase"]
        self._find = regex.compile(steps[0]["pattern"]["Regex"]).findall
        self._plain: dict[str, bool] = {}
        self._known: dict[str, bytes] = {}
        self._older: dict[str, bytes] = {}

    def _is_plain(self, c: str) -> bool:
        """Whether the library does with a character what lower() and the pattern do here; tables of other versions of Unicode may differ."""
        normal, lower = self._normal.normalize_str(f"x{c}x")[1:-1], c.lower()
        if c == "Σ" or normal != lower and not (normal == " " and not self._find(c)):
            return False
        return all([w for w, _ in self._split.pre_tokenize_str(t)] == ["".join(self._letters[b] for b in w.encode()) for w in self._find(t)] for t in (lower + lower, "!" + lower, "a" + lower))

    def words(self, text: str) -> list[str]:
        """The words of a text, normalised, added tokens among them.

        Texts of characters that are known to need no more are lowered and split here, which is fast; others by the library.
        """
        out: list[str] = []
        for k, piece in enumerate(self._special.split(text) if self._special else [text]):
            if k % 2:
                out.append(piece)
                continue
            chars = set(piece)
            for c in chars.difference(self._plain):
                self._plain[c] = self._is_plain(c)
            if self._light and all(map(self._plain.__getitem__, chars)) and unicodedata.is_normalized("NFC", piece):
                out.extend(self._find(piece.lower()))
                continue
            normal = self._normal.normalize_str(piece) if self._normal else piece
            out.extend(bytes(map(self._bytes.__getitem__, w)).decode() for w, _ in self._split.pre_tokenize_str(normal))
        return out

    def merge(self, ids: list[int]) -> list[int]:
        """ids after all merges, the lowest rank first and, of one rank, from the left."""
        if len(ids) > 4 * LEAF:
            return self._merge_long(ids)
        get, ids = self.merges.get, list(ids)
        made = [get(a << 32 | b, NONE) for a, b in zip(ids, ids[1:])]
        while made and (best := min(made)) != NONE:
            k = made.index(best)
            ids[k : k + 2] = [best & ID]
            del made[k]
            if k:
                made[k - 1] = get(ids[k - 1] << 32 | ids[k], NONE)
            if k < len(made):
                made[k] = get(ids[k] << 32 | ids[k + 1], NONE)
        return ids

    def _merge_long(self, ids: list[int]) -> list[int]:
        """The same, with all places of a rank in one pass: a merge's result takes part in later ranks only."""
        get = self.merges.get
        while len(ids) > 1:
            best = min(get(a << 32 | b, NONE) for a, b in zip(ids, ids[1:]))
            if best == NONE:
                break
            out, k, last = [], 0, len(ids) - 1
            while k <= last:
                if k < last and get(ids[k] << 32 | ids[k + 1]) == best:
                    out.append(best & ID)
                    k += 2
                else:
                    out.append(ids[k])
                    k += 1
            ids = out
        return ids

    def tree(self, ids: list[int]) -> list[int]:
        """The encoding of a word of any length from its symbols."""
        if len(ids) <= LEAF:
            return self.merge(ids)
        return self.concat(self.tree(ids[: len(ids) // 2]), self.tree(ids[len(ids) // 2 :]))

    def concat(self, a: list[int], b: list[int]) -> list[int]:
        """The encoding of two neighbours' symbols from the encodings of each. In periodic words the window may grow to the whole."""
        if not a or not b:
            return a + b
        k = 1
        while True:
            left, right = a[-k:], b[:k]
            window = self.merge([s for t in left + right for s in self.symbols.get(t, (t,))])
            if (k >= len(a) or window[0] == left[0]) and (k >= len(b) or window[-1] == right[-1]):
                return a[:-k] + window + b[k:]
            k *= 2

    def start(self, word: str, ends: bool = True) -> list[int]:
        """The ids of the word's bytes, the last of which has the suffix. A byte that the vocabulary lacks is left out."""
        data = word.encode()
        out = [self.inner[b] for b in data]
        if ends and data:
            out[-1] = self.last[data[-1]]
        return [i for i in out if i is not None] if None in out else out

    def word(self, word: str) -> bytes:
        """The packed encoding of a word or added token. Short ones are remembered, those of late longer than others."""
        got = self._older.get(word)
        if got is None:
            got = pack([self.added[word]] if word in self.added else self.tree(self.start(word)))
        if len(word) <= LEAF:
            if len(self._known) >= REMEMBERED:
                self._older, self._known = self._known, {}
            self._known[word] = got
        return got

    def encode(self, words: list[str]) -> bytes:
        """The packed ids of words."""
        out, word = [], self.word
        for w in words:
            out.append(self._known.get(w) or word(w))
        return b"".join(out)

    def decode(self, ids: list[int]) -> str:
        """Tokens with a space between; ids that stand for none are left out."""
        return " ".join(t for t in map(self.tokens.get, ids) if t is not None)


@functools.lru_cache(maxsize=2)
def load(rules: str) -> Bpe:
    """The rules, read once in each worker."""
    return Bpe(rules)


def pack(ids: list[int]) -> bytes:
    """ids as little-endian unsigned 32-bit integers."""
    return struct.pack(f"<{len(ids)}I", *ids)


def unpack(ids: bytes) -> list[int]:
    return np.frombuffer(ids, "<u4").tolist()


def _with(batch: pa.RecordBatch, begin: int, values: list, kind: pa.DataType, name: str) -> pa.RecordBatch:
    """Rows of a batch from `begin` with its last column replaced."""
    return pa.RecordBatch.from_arrays([*batch.slice(begin, len(values)).columns[:-1], pa.array(values, kind)], names=[*batch.schema.names[:-1], name])


def _each(rules, name: str, kind: pa.DataType, work):  # noqa: ANN001, ANN202
    """A function for mapInArrow that replaces the last column by work(bpe, value), in batches of bounded size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(rules.value)
        for batch in batches:
            values, begin, out, seen = batch.column(batch.num_columns - 1), 0, [], 0
            for v in values:
                v = v.as_py() or b""
                out.append(work(bpe, v))
                seen += len(v)
                if seen >= BATCH_BYTES:
                    yield _with(batch, begin, out, kind, name)
                    begin, out, seen = begin + len(out), [], 0
            if out:
                yield _with(batch, begin, out, kind, name)

    return run


def _encode_text(bpe: Bpe, text: bytes) -> bytes:
    return bpe.encode(bpe.words(text.decode("utf-8", "replace")))


def _cuts(text: bytes, size: int) -> Iterator[bytes]:
    """The text in parts of about `size` bytes, each but the first beginning with white space; a stretch without any is one part."""
    white, begin = regex.compile(rb"[ \t\n\r]"), 0
    while len(text) - begin > size:
        found = white.search(text, begin + size)
        if found is None:
            break
        yield text[begin : found.start()]
        begin = found.start()
    yield text[begin:]


#: What a part holds: text, words between spaces, or a slice of one word, the last of which ends it.
TEXT, WORDS, SLICE, END = 0, 1, 2, 3


def _pieces(bpe: Bpe, text: bytes, limit: int = PART) -> Iterator[tuple[int, bytes]]:
    for part in _cuts(text, limit):
        if len(part) <= 2 * limit:
            yield TEXT, part
            continue
        # A long stretch without white space: its words are found here, and merged elsewhere.
        some, size = [], 0
        for w in bpe.words(part.decode("utf-8", "replace")):
            if len(w) > limit or size > limit:
                if some:
                    yield WORDS, " ".join(some).encode()
                some, size = [], 0
            if len(w) <= limit:
                some.append(w)
                size += len(w)
                continue
            for k in range(0, len(w), limit):
                yield END if k + limit >= len(w) else SLICE, w[k : k + limit].encode()
        if some:
            yield WORDS, " ".join(some).encode()


def _deal(rules, limit: int):  # noqa: ANN001, ANN202
    """_text (number), text to _text, part, kind, body."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(rules.value)
        for batch in batches:
            for key, text in zip(batch.column(0), batch.column(1)):
                rows, size, at = [], 0, 0
                for kind, body in _pieces(bpe, text.as_py(), limit):
                    rows.append((at, kind, body))
                    at, size = at + 1, size + len(body)
                    if size >= BATCH_BYTES:
                        yield _dealt(key.as_py(), rows)
                        rows, size = [], 0
                if rows:
                    yield _dealt(key.as_py(), rows)

    return run


def _dealt(key: int, rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    part, kind, body = zip(*rows)
    cols = [pa.array([key] * len(rows), pa.int64()), pa.array(part, pa.int32()), pa.array(kind, pa.int32()), pa.array(body, pa.binary())]
    return pa.RecordBatch.from_arrays(cols, names=["_text", "part", "kind", "body"])


def _encode_parts(rules):  # noqa: ANN001, ANN202
    """_text, part, kind, body to _text, part, kind, ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(rules.value)
        for batch in batches:
            kinds, bodies, begin, out, seen = batch.column(2), batch.column(3), 0, [], 0
            for kind, body in zip(kinds, bodies):
                kind, body = kind.as_py(), body.as_py()
                if kind == TEXT:
                    out.append(_encode_text(bpe, body))
                elif kind == WORDS:
                    out.append(bpe.encode(body.decode().split(" ")))
                else:
                    out.append(pack(bpe.tree(bpe.start(body.decode(), kind == END))))
                seen += len(body)
                if seen >= BATCH_BYTES:
                    yield _with(batch, begin, out, pa.binary(), "ids")
                    begin, out, seen = begin + len(out), [], 0
            if out:
                yield _with(batch, begin, out, pa.binary(), "ids")

    return run


def _gather(rules):  # noqa: ANN001, ANN202
    """_text, parts (part, kind, ids, in order) to _text, ids: slices of a word joined as a tree, all else put after each other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(rules.value)
        for batch in batches:
            for k in range(batch.num_rows):
                out, word = [], []
                for part in batch.column(1)[k]:
                    ids = part["ids"].as_py()
                    if part["kind"].as_py() in (TEXT, WORDS):
                        out.append(ids)
                        continue
                    word.append(unpack(ids))
                    if part["kind"].as_py() == END:
                        while len(word) > 1:
                            word = [bpe.concat(*word[i : i + 2]) if i + 1 < len(word) else word[i] for i in range(0, len(word), 2)]
                        out.append(pack(word[0]))
                        word = []
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(k, 1), pa.array([b"".join(out)], pa.binary())], names=["_text", "ids"])

    return run


def encode(docs: DataFrame, path: str, keep: tuple[str, ...] = ("doc_id",), part: int = PART) -> DataFrame:
    """`keep` and ids: the text's token ids, packed as little-endian unsigned 32-bit integers, which unpack() reads.

    path: a tokenizer file in the library's form, read here and sent to the workers, so it need not lie on each machine; such files
    are a few MB. A null or empty text, or one of white space, has no ids. Texts of any length are encoded whole, those beyond `part` bytes
    in many tasks. Repeated rows are encoded each, ties cannot arise, and an empty table gives no rows. Null values in `keep` are kept, and further columns
    are ignored, whatever their names.
    """
    spark = docs.sparkSession
    rules = spark.sparkContext.broadcast(_read(spark, path))
    named = docs.select(*keep, F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("_fx_text"))
    long = F.octet_length("_fx_text") > part
    kinds = dict(named.dtypes)
    shape = ", ".join(f"`{c}` {kinds[c]}" for c in keep)
    short = named.filter(~long).mapInArrow(_each(rules, "ids", pa.binary(), _encode_text), f"{shape}, ids binary")
    # The long ones' numbers must not change if a task runs again, so they are written.
    rest = stage(named.filter(long).withColumn("_fx_no", F.monotonically_increasing_id()), "long-texts")
    parts = rest.select(F.col("_fx_no").alias("_text"), "_fx_text").mapInArrow(_deal(rules, part), "_text long, part int, kind int, body binary")
    coded = parts.repartition("_text", "part").mapInArrow(_encode_parts(rules), "_text long, part int, kind int, ids binary")
    whole = coded.groupBy("_text").agg(F.sort_array(F.collect_list(F.struct("part", "kind", "ids"))).alias("parts")).mapInArrow(_gather(rules), "_text long, ids binary")
    joined = rest.drop("_fx_text").join(whole, F.col("_fx_no") == F.col("_text")).select(*keep, "ids")
    return short.unionByName(joined)


def decode(coded: DataFrame, path: str) -> DataFrame:
    """coded with ids replaced by decoded: the tokens' text with a space between tokens, as the library gives for a file without a decoder.

    Null ids, and none, give an empty text; ids that the file lacks are left out. All other columns stay.
    """
    spark = coded.sparkSession
    rules = spark.sparkContext.broadcast(_read(spark, path))
    kinds = dict(coded.dtypes)
    rest = [c for c in coded.columns if c != "ids"]
    shape = "".join(f"`{c}` {kinds[c]}, " for c in rest)
    return coded.select(*rest, "ids").mapInArrow(_each(rules, "decoded", pa.string(), lambda bpe, ids: bpe.decode(unpack(ids))), f"{shape}decoded string")


def _read(spark: SparkSession, path: str) -> str:
    """The file's text, by Spark if the path names a file system, else from this machine."""
    if "://" in path:
        return spark.read.text(path, wholetext=True).first()[0]
    with open(path, encoding="utf-8") as f:
        return f.read()


def op13_bpe_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("word_bpe_49k.json")
    coded = encode(table(spark, sf_dir, "documents"), path).withColumn("packed", F.col("ids"))
    sha = lambda c: F.sha2(F.col(c).cast("binary"), 256)
    return decode(coded, path).select("doc_id", F.expr("octet_length(packed) div 4").cast("long").alias("n_tokens"), sha("packed").alias("ids_sha256"), sha("decoded").alias("decoded_sha256"))
