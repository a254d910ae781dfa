"""Lexical search, whitening and byte pair encoding against brute force and the library."""

import hashlib
import math
import random
import re
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest

from fathom.llm import bpe, lexical_search as ls, whitening as wh

from .conftest import clash, prose

# Lexical search.


def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def best(docs, items, k=20):
    bags = [(d, Counter(terms(t))) for d, t in docs]
    bags = [(d, b) for d, b in bags if b]
    big_n, big_l, df = len(bags), sum(b.total() for _, b in bags), Counter(t for _, b in bags for t in b)
    out = []
    for item, text in items:
        found = []
        for d, b in bags:
            m, s = 75 + (25 * b.total() * big_n) // big_l, 0
            for t, q in Counter(terms(text)).items():
                if t in b:
                    s += q * math.floor(1000 * math.log((2 * big_n + 2) / (2 * df[t] + 1))) * ((1000000000 * b[t]) // (1000 * b[t] + 12 * m))
            if s > 0:
                found.append((-s, (d is not None, d or 0)))
        out += [(item, r, d[1] if d[0] else None, -s) for r, (s, d) in enumerate(sorted(found)[:k], 1)]
    return sorted(out, key=repr)


ITEMS = [("a", "the River of Stone, the garden!"), ("b", None), ("c", ""), ("d", "unseen words only"), ("e", "letter letter über ciónes"), ("a", "the River of Stone, the garden!"), (None, "line one two three start x"), ("z", "the of and to in")]


def rows_of(df):
    return sorted([tuple(r) for r in df.select("item_id", "rank", "doc_id", "score").collect()], key=repr)


@pytest.mark.parametrize("k", [1, 3, 20])
def test_search(spark, docs, k):
    items = spark.createDataFrame(ITEMS, "item_id string, text string")
    got = rows_of(ls.search(docs, items, k))
    assert got == best([(r["doc_id"], r["text"]) for r in docs.collect()], ITEMS, k)
    assert rows_of(ls.search(clash(docs), clash(items), k)) == got


def test_search_leaves_frequent_words_out_and_loses_nothing(spark, monkeypatch):
    """Many documents of common words, ties among them, and few with rare ones; floors hold from the first probe."""
    rng = random.Random(5)
    common, rare = [f"c{i}" for i in range(12)], [f"r{i}" for i in range(300)]
    made = [(i, " ".join(rng.choices(common, k=rng.randint(5, 40)) + rng.choices(rare, k=rng.choice([0, 0, 1, 3])))) for i in range(1500)] + [(10_000 + i, "c1 c2 c3") for i in range(200)]
    items = [(str(i), " ".join(rng.choices(common, k=10) + rng.choices(rare, k=6))) for i in range(12)] + [("common", " ".join(common))]
    monkeypatch.setattr(ls, "PROBE", 4)
    d, b = spark.createDataFrame(made, "doc_id long, text string"), spark.createDataFrame(items, "item_id string, text string")
    assert rows_of(ls.search(d, b, 5)) == best(made, items, 5)


def test_search_empty(spark, docs, empty):
    items = spark.createDataFrame(ITEMS, "item_id string, text string")
    assert ls.search(empty, items).collect() == [] and ls.search(docs, items.limit(0)).collect() == []
    assert dict(ls.search(empty, items).dtypes) == {"item_id": "string", "rank": "int", "doc_id": "bigint", "score": "bigint"}


# Whitening.


def exact(vectors, d):
    x = [[math.floor(Fraction(float(c)) * 1024) + 100000 for c in v] for v in vectors]
    n = len(x)
    s = [sum(r[i] for r in x) for i in range(d)]
    m = [[n * sum(r[i] * r[j] for r in x) - s[i] * s[j] for j in range(d)] for i in range(d)]
    return x, n, s, m


def embeddings(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(4)


def test_whiten(spark):
    rng = np.random.default_rng(3)
    mix = rng.normal(size=(10, 10))
    good = [(i, (rng.normal(size=10) @ mix).tolist(), 0) for i in range(300)]
    good += [(300, good[0][1], 1), (300, good[0][1], 1), (None, good[1][1], 2)]
    bad = [(900, None, 0), (901, [*good[0][1][:9], None], 0), (902, [math.nan, *good[0][1][1:]], 0), (903, [math.inf, *good[0][1][1:]], 0), (904, [], 0), (905, [1.0, 2.0], 0)]
    df = embeddings(spark, good + bad)
    got = wh.whiten(df).collect()
    x, n, s, m = exact([v for _, v, _ in good], 10)
    assert len(got) == 8 * len(good) and {r["n"] for r in got} == {n}
    dev = sorted(sum((n * a - b) ** 2 for a, b in zip(r, s)) for r in x)
    assert sorted(r["deviation"] for r in got if r["component"] == 1) == dev and all(str(r["deviation"]) == r["exact_deviation"] for r in got)
    e = np.linalg.eigvalsh(np.array([[a / n**2 for a in r] for r in m]))[::-1]
    share = {r["component"]: r["explained"] for r in got}
    assert np.allclose([share[k] for k in range(1, 9)], e[:8] / e.sum(), rtol=1e-9)
    assert len({r["identity_error"] for r in got}) == 1 and got[0]["identity_error"] < 1e-9
    w = {k: sorted(r["whitened"] for r in got if r["component"] == k) for k in range(1, 9)}
    q = np.linalg.eigh(np.array([[a / n**2 for a in r] for r in m]))
    centred = np.array([[a - b / n for a, b in zip(r, s)] for r in x])
    for k in range(1, 9):
        want = np.sort(centred @ q[1][:, -k] / q[0][-k] ** 0.5)
        assert np.allclose(w[k], want, atol=1e-8) or np.allclose(w[k], np.sort(-want), atol=1e-8)
    assert len(wh.whiten(clash(df)).collect()) == len(got)


def test_scatter_of_wide_integers():
    rng = random.Random(1)
    for high in (1 << 10, 1 << 19, 1 << 35, 1 << 61):
        v = np.array([[rng.randint(-high, high) for _ in range(3)] for _ in range(50)], np.int64)
        want = [[sum(int(a[i]) * int(a[j]) for a in v) for j in range(3)] for i in range(3)]
        assert wh.scatter(v).astype(object).tolist() == want
        total = wh._Totals(3)
        total.add(v)
        total.flush()
        assert total.products.tolist() == want and total.sums.tolist() == [sum(int(a[i]) for a in v) for i in range(3)]
    for x in (0, 5, -5, 1 << 150, -(1 << 150) - 7):
        assert sum(p << wh.WIDE * k for k, p in enumerate(wh.limbs_of(x))) == x


def test_whiten_extremes(spark):
    """Entries far beyond a long's reach, no variance, one row, none."""
    wide = [(i, [1e15 * i, float(i % 3), 1e300 if i == 4 else 0.0], 0) for i in range(6)]
    got = wh.whiten(embeddings(spark, wide)).collect()
    clip = lambda c: min(max(math.floor(Fraction(c) * 1024), wh.SHIFT - wh.LARGEST), wh.LARGEST - wh.SHIFT) + wh.SHIFT
    x = [[clip(c) for c in v] for _, v, _ in wide]
    s = [sum(r[i] for r in x) for i in range(3)]
    want = {str(sum((6 * a - b) ** 2 for a, b in zip(r, s))) for r in x}
    assert {r["exact_deviation"] for r in got} == want and len(got) == 18 and any(r["deviation"] is None for r in got)
    flat = wh.whiten(embeddings(spark, [(1, [1.0, 2.0], 0), (2, [1.0, 2.0], 0)])).collect()
    assert len(flat) == 4 and all(r["whitened"] is None and r["explained"] == 0 and r["deviation"] == 0 and r["identity_error"] is None for r in flat)
    line = wh.whiten(embeddings(spark, [(i, [float(i), 2.0 * i], 0) for i in range(5)])).collect()
    assert {r["component"]: r["whitened"] is None for r in line} == {1: False, 2: True} and line[0]["identity_error"] < 1e-9
    assert wh.whiten(embeddings(spark, [(1, None, 0)])).collect() == [] and wh.whiten(embeddings(spark, wide).limit(0)).collect() == []


# Byte pair encoding.

public = pytest.importorskip("public_tokenizers")
PATH = public.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def rules():
    return bpe.Bpe(open(PATH, encoding="utf-8").read())


def hard_words(rng):
    yield from ("a" * 1000, "ab" * 700, "the" * 500, "!" * 333, "?!" * 300, "🎉" * 200, "日本語の文章" * 80, "ǆ" * 90, "é" * 120)
    letters = ["abcdefghijklmnopqrstuvwxyz", "etaoin", "ab", "あいうえおかきくけこ", "éüßñ", "!?.,-_=+*#", "🙂🎈💯❤️"]
    for n in (2, 31, 32, 33, 64, 65, 200, 999, 3000):
        for a in letters:
            yield "".join(rng.choices(a, k=n))
    names = ["the", "ing", "tion", "xx", "qu", "haha", "lol", "oo"]
    for n in (20, 200, 1500):
        yield "".join(rng.choices(names, k=n))


def test_tree_gives_what_the_library_gives(library, rules):
    rng = random.Random(11)
    for text in hard_words(rng):
        want = library.encode(text, add_special_tokens=False).ids
        assert bpe.unpack(rules.encode(rules.words(text))) == want, text[:40]
        # Slices of any length join to the same.
        for word in rules.words(text):
            if word in rules.added:
                continue
            start = rules.start(word)
            cut = sorted(rng.sample(range(1, len(start)), min(5, len(start) - 1))) if len(start) > 1 else []
            parts = [rules.tree(start[a:b]) for a, b in zip([0, *cut], [*cut, len(start)])]
            while len(parts) > 1:
                parts[:2] = [rules.concat(*parts[:2])]
            assert parts[0] == bpe.unpack(rules.word(word))


def test_all_characters_are_split_alike(library, rules):
    """Each character of the first planes, and each 23rd beyond, doubled, after a sign and before a letter, by itself so that it alone decides which way its text goes."""
    letters = bpe.byte_letters()
    for c in map(chr, (*range(1, 0x3000), *range(0x3000, 0x110000, 23))):
        if not "\ud800" <= c <= "\udfff":
            text = f"!{c}{c}a"
            want = [w for w, _ in library.pre_tokenizer.pre_tokenize_str(library.normalizer.normalize_str(text))]
            assert ["".join(letters[b] for b in w.encode()) for w in rules.words(text)] == want, hex(ord(c))


AWKWARD = [
    None, "", " \n\t ", "Hello World's 123 end", "A<|endoftext|>b <|startoftext|><|endoftext|>", "<|endoftext", "İΣ Σ́ΑΣ é", "\x1c\x85 　x", "tab\tnew\r\nline", "日本語 テスト", "🙂" * 50,
    "don't WE'LL it's'd", "՘࢏ Ᲊ", "a​b", "\x00\x01\x7f", "１２３ ⅷ ²",
]


def test_encode_and_decode(spark, docs, library):
    rng = random.Random(2)
    long = [prose(50, 4000), "x" * 9000, " ".join(["ab"] * 900) + "y" * 7000 + " end", "日本" * 3000 + "!" * 4000 + "z" + "q" * 2500, "pre " + "<|endoftext|>" * 600, "".join(rng.choices("etaoin", k=12_000))]
    texts = [*AWKWARD, *long, long[1], *[r["text"] for r in docs.collect()]]
    df = spark.createDataFrame([(i if i else None, t, "mine") for i, t in enumerate(texts)], "doc_id long, text string, part string").repartition(3)
    for part in (1 << 16, 1000):
        got = {r["doc_id"] or 0: bpe.unpack(r["ids"]) for r in bpe.encode(clash(df), PATH, part=part).collect()}
        assert len(got) == len(texts)
        for i, t in enumerate(texts):
            assert got[i] == library.encode(t or "", add_special_tokens=False).ids, (part, i)
    decoded = bpe.decode(bpe.encode(df, PATH), PATH).collect()
    for r in decoded:
        assert r["decoded"] == library.decode(got[r["doc_id"] or 0], skip_special_tokens=False)
    assert hashlib.sha256(bpe.pack([1, 258])).hexdigest() == hashlib.sha256(b"\1\0\0\0\2\1\0\0").hexdigest()


def test_parts_are_dealt_out(library, rules):
    """The steps of a long text by hand, with small parts: what _pieces gives, encoded and joined, is the library's encoding."""
    text = prose(3, 400) + "w" * 5000 + "!" * 900 + "v" * 250 + " " + "é" * 2000 + " tail"
    kinds = [k for k, _ in bpe._pieces(rules, text.encode(), 300)]
    assert {bpe.TEXT, bpe.WORDS, bpe.SLICE, bpe.END} <= set(kinds)
    coded = []
    for kind, body in bpe._pieces(rules, text.encode(), 300):
        ids = bpe.unpack(bpe._encode_text(rules, body) if kind == bpe.TEXT else rules.encode(body.decode().split(" "))) if kind in (bpe.TEXT, bpe.WORDS) else rules.tree(rules.start(body.decode(), kind == bpe.END))
        coded.append((kind, ids))
    out, word = [], []
    for kind, ids in coded:
        if kind in (bpe.TEXT, bpe.WORDS):
            out += ids
        else:
            word = rules.concat(word, ids)
            if kind == bpe.END:
                out, word = out + word, []
    assert out == library.encode(text, add_special_tokens=False).ids


def test_encode_empty(spark, empty):
    assert bpe.encode(empty, PATH).collect() == [] and bpe.decode(bpe.encode(empty, PATH), PATH).columns == ["doc_id", "decoded"]


DATA = "/root/testdata/sf0.001"


def test_query_of_tokens(spark, library):
    want = []
    for r in spark.read.parquet(f"{DATA}/documents.parquet").collect():
        ids = library.encode(r["text"] or "", add_special_tokens=False).ids
        sha = lambda x: hashlib.sha256(x).hexdigest()
        want.append((r["doc_id"], len(ids), sha(np.array(ids, "<u4").tobytes()), sha(library.decode(ids, skip_special_tokens=False).encode())))
    got = bpe.op13_bpe_tokens(spark, DATA).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_query_of_embeddings(spark):
    vectors = [r["embedding"] for r in spark.read.parquet(f"{DATA}/embeddings.parquet").collect()]
    x = np.array([[math.floor(float(c) * 1024) + 100000 for c in v] for v in vectors], object)
    n, s = len(x), x.sum(axis=0)
    got = wh.op12_embedding_whitening(spark, DATA).collect()
    assert sorted(r["deviation"] for r in got if r["component"] == 8) == sorted(((n * x - s) ** 2).sum(axis=1)) and len(got) == 8 * n
    assert all(abs(r["identity_error"]) < 1e-9 for r in got)
