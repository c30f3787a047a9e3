"""Vector codes, piece encoding and ranked search against brute force, and their defined cases."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from quillgraph.llm import pieces, treaps, vectors


def coded_by_hand(rows):
    """rows (vec_id, label, vector) -> (vec_id, code, error, label_error, codebooks), by comparing with every entry."""
    kept = [(k, lab, [math.floor(1024 * x) for x in v]) for k, lab, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept = sorted(kept, key=lambda r: (r[0] is None, r[0], r[2]))
    d = len(kept[0][2]) // 4
    part = lambda v, p: tuple(v[p * d : (p + 1) * d])
    books = [[part(v, p) for _, _, v in kept[:256]] for p in range(4)]
    away = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    near = lambda a, book: min(range(len(book)), key=lambda e: (away(a, book[e]), e))
    for _ in range(4):
        for p in range(4):
            own = {}
            for _, _, v in kept:
                own.setdefault(near(part(v, p), books[p]), []).append(part(v, p))
            for e, xs in own.items():
                books[p][e] = tuple(sum(c) // len(xs) for c in zip(*xs, strict=True))
    out, by_label = [], Counter()
    for k, lab, v in kept:
        at = [near(part(v, p), books[p]) for p in range(4)]
        error = sum(away(part(v, p), books[p][e]) for p, e in enumerate(at))
        by_label[lab] += error
        out.append((k, lab, "".join(f"{e:02x}" for e in at), error))
    flat = ",".join(str(x) for b in books for e in b for x in e)
    return sorted(((k, c, e, by_label[lab]) for k, lab, c, e in out), key=str), hashlib.sha256(flat.encode()).hexdigest()


VECTORS = "vec_id long, label int, embedding array<float>, code string, error int"


@pytest.mark.parametrize("n", [0, 1, 40, 700])
def test_vectors(spark, n):
    r = np.random.default_rng(n)
    x = r.normal(size=(n, 8)).astype(np.float32).round(2 if n == 700 else 6)
    rows = [(int(k), None if k % 5 == 0 else int(k % 3), x[k].tolist()) for k in r.permutation(n)]
    if n:
        rows += [(9000, 1, None), (9001, 1, [1.0] * 7 + [None]), (9002, 1, [1.0] * 7 + [math.inf]), (9003, 1, [math.nan] * 8), rows[0], (None, 2, [0.5] * 8), *[(8000 + k, 7, x[0].tolist()) for k in range(n)]]
    df = spark.createDataFrame([(*row, "clash", 1) for row in rows], VECTORS).repartition(3)
    coded, books = vectors.compress(df)
    got = sorted(map(tuple, vectors.with_label_errors(coded).select("vec_id", "code", "error", "label_error").collect()), key=str)
    want, sha = coded_by_hand(rows) if n else ([], hashlib.sha256(b"").hexdigest())
    assert got == want
    assert vectors.digest(books) == sha


def test_vectors_of_other_lengths(spark):
    rows = [(0, 1, [], "", 0), (1, 1, [0.1] * 8, "", 0), (2, 1, [0.2] * 8, "", 0), (3, 1, [0.1] * 12, "", 0), (4, 1, [0.1] * 3, "", 0)]
    coded, books = vectors.compress(spark.createDataFrame(rows, VECTORS))
    assert {r.vec_id: (r.code, r.error) for r in coded.collect()} == {0: (None, None), 1: ("00000000", 0), 2: ("01010101", 0), 3: (None, None), 4: (None, None)}
    assert [len(b) for b in books] == [2] * 4
    with pytest.raises(Exception, match="64 bits"):
        vectors.compress(spark.createDataFrame([(1, 1, [1e9] * 8, "", 0)], VECTORS))[0].collect()


@pytest.mark.parametrize("scale", [2, 150, 2**27])
def test_bounds_keep_the_nearest(scale):
    r = np.random.default_rng(scale)
    e, x = r.integers(-scale, scale, (256, 16)), r.integers(-scale, scale, (1500, 16))
    x[:200] = e[r.integers(0, 256, 200)]
    index, away = vectors.Cells(e).nearest(x)
    far = ((x[:, None] - e[None]) ** 2).sum(2)
    assert (index == far.argmin(1)).all() and (away == far.min(1)).all()


def library():
    P = pytest.importorskip("public_tokenizers")
    import sentencepiece

    path = P.path("piece_bpe_32k.model")
    return path, sentencepiece.SentencePieceProcessor(model_file=path)


def odd_texts(seed, n):
    r = random.Random(seed)
    bits = ["a", "the", " ", "  ", "=", "--", "1", "é", "中", "\n", "▁", "<s>", "</s>", "🙂", "\x00", "ing", "\t", "ﬁ", "​", "<0x41>", "ation", "Q"]
    return ["".join(r.choice(bits) for _ in range(r.randint(0, 80))) for _ in range(n)] + ["=" * 3000, " " * 700, "", " ", "ab" * 4000, "▁▁ a", "中" * 900]


def test_pieces(spark):
    path, sp = library()
    texts = odd_texts(3, 600)
    rows = [(k, t, 1, b"") for k, t in enumerate(texts)] + [(None, "a b", 1, b""), (7, None, 1, b""), (7, texts[7], 1, b"")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int, ids binary").repartition(3)
    got = sorted(map(tuple, pieces.decode(pieces.encode(docs, path), path).collect()), key=str)
    want = []
    for k, t, *_ in rows:
        ids = sp.encode(t or "", add_bos=True, add_eos=True)
        want.append((k, len(ids), bytearray(np.array(ids, "<u4").tobytes()), sp.decode(ids)))
    assert got == sorted(want, key=str)
    assert pieces.decode(pieces.encode(docs.where("false"), path), path).count() == 0


def test_piece_walk_is_merging():
    """The walk gives what plain merging gives, also where it has to step back."""
    path, _ = library()
    codec, r = pieces.Codec(path), random.Random(5)
    known = sorted(p for p in codec.id_of if 1 < len(p) < 5)
    for _ in range(3000):
        text = "".join(r.choice(known) for _ in range(r.randint(1, 6)))
        assert [codec.names[k] for k in codec.walk(text)] == codec.merged(text)


def test_decode_any_ids():
    path, sp = library()
    codec, r = pieces.Codec(path), random.Random(6)
    for _ in range(3000):
        ids = [r.choice([r.randint(0, 300), r.randint(0, 31999), 29871, 1, 2, 0]) for _ in range(r.randint(0, 12))]
        assert codec.decode(np.array(ids, "<u4").tobytes()) == sp.decode(ids)


def test_treaps():
    r = np.random.default_rng(1)
    for _ in range(200):
        n, t = int(r.integers(1, 60)), int(r.integers(1, 9))
        rows = [sorted(r.choice(t, int(r.integers(1, t + 1)), replace=False).tolist()) for _ in range(n)]
        term = np.array([v for x in rows for v in x], np.int64)
        impact, starts = r.integers(0, 6, len(term)), np.append(0, np.cumsum([len(x) for x in rows]))
        query = {int(v): int(r.integers(1, 4)) for v in r.choice(t, int(r.integers(1, t + 1)), replace=False)}
        made = treaps.Treaps(starts, term, impact, t)
        for node, doc in enumerate(made.doc):  # search order and heap order
            for child, side in ((made.left[node], -1), (made.right[node], 1)):
                assert child < 0 or (made.most[child] <= made.most[node] and (made.doc[child] - doc) * side > 0)
        for k in (1, 3, 20):
            score = [sum(query.get(int(v), 0) * int(i) for v, i in zip(term[a:b], impact[a:b], strict=True)) for a, b in zip(starts[:-1], starts[1:], strict=True)]
            assert made.top(query, k) == sorted(((s, d) for d, s in enumerate(score) if s > 0), key=lambda p: (-p[0], p[1]))[:k]


TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def ranked_by_hand(docs, items, k=20):
    tf = [(d, Counter(TERM.findall((t or "").translate(LOWER)))) for d, t in docs]
    tf = [(d, c) for d, c in tf if c]
    total, df = sum(c.total() for _, c in tf), Counter(w for _, c in tf for w in c)
    out = []
    for item, text in items:
        found = []
        for d, c in tf:
            m = 100 - 25 + (25 * c.total() * len(tf)) // total
            s = sum(math.floor(1000 * math.log((2 * len(tf) + 2) / (2 * df[w] + 1))) * ((10**9 * c[w]) // (1000 * c[w] + 12 * m)) for w in TERM.findall((text or "").translate(LOWER)) if c[w])
            if s > 0:
                found.append((-s, d is None, d))
        out += [(item, rank, d, -s) for rank, (s, _, d) in enumerate(sorted(found)[:k], 1)]
    return out


@pytest.mark.parametrize("small", [False, True])
def test_search(spark, small, monkeypatch):
    if small:  # many shards and many blocks of queries
        monkeypatch.setattr(treaps, "POSTINGS", 40)
        monkeypatch.setattr(treaps, "TERMS", 12)
    r = random.Random(8)
    vocab = ["".join(r.choice("aeiokmnrst") for _ in range(3)) for _ in range(60)]
    text = lambda n: " ".join(r.choice(vocab) for _ in range(n))
    docs = [(k, text(r.randint(1, 60))) for k in range(120)] + [(200, "Ünï-CODE, ünï code Ü"), (201, ""), (202, None), (203, "--- !!"), (None, text(20)), (None, "zzz"), (204, text(6000))]
    docs += [docs[3]] * 3 + [(300 + k, docs[5][1]) for k in range(40)]
    items = [(k, text(r.randint(1, 25))) for k in range(12)] + [(20, "ÜNÏ code code"), (21, "nothing_here qqqq"), (22, None), (23, ""), (None, text(4)), (24, docs[5][1]), (25, "zzz")]
    columns = "rank int, score long"
    df = spark.createDataFrame([(d, t, 1, 1) for d, t in docs], f"doc_id long, text string, {columns}").repartition(4)
    it = spark.createDataFrame([(i, t, 1, 1) for i, t in items], f"item_id long, text string, {columns}")
    got = sorted(map(tuple, treaps.search(df, it).collect()), key=str)
    assert got == sorted(ranked_by_hand(docs, items), key=str)
    assert treaps.search(df.where("false"), it).count() == treaps.search(df, it.where("false")).count() == 0
    assert treaps.search(df.where("doc_id = 203"), it).count() == 0


def test_short_texts_near_the_threshold(spark):
    """Texts of 5 to 17 words with an edit or two: every pair at the threshold shares a bucket, so classes are those of brute force."""
    from quillgraph.llm import minhash

    r, out = random.Random(31), []
    for _ in range(120):
        words = [f"w{r.randrange(10**9)}" for _ in range(r.randint(4, 17))]
        out.append(words)
        for _ in range(3):
            near = list(words)
            for _ in range(r.randint(1, 2)):
                at = r.choice([0, len(near), r.randrange(len(near) + 1)])
                near[at : at + r.randint(0, 1)] = [f"x{r.randrange(10**9)}"] * r.randint(0, 1)
            out.append(near)
    rows = [(k, " ".join(w)) for k, w in enumerate(out)]
    items = minhash.Items()
    x = [items.of(w) if w else np.zeros(0, np.uint64) for w in out]
    label = list(range(len(x)))
    links = [(a, b) for a in range(len(x)) for b in range(a) if out[a] == out[b] or len(x[a]) and len(x[b]) and minhash.aligned(x[a], x[b]) >= minhash.SIMILAR]
    for _ in range(4):
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
    assert sum(len(x[a]) != len(x[b]) for a, b in links) > 40
    got = {row.doc_id: row.class_id for row in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[k] == label[k] for k, w in enumerate(out) if w)
    for a, b in links:
        if max(len(x[a]), len(x[b])) <= minhash.SHORT:
            assert set(minhash.keys(x[a]).tolist()) & set(minhash.keys(x[b]).tolist())
