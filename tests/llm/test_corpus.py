"""The corpus operators against brute force, and their defined cases."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from quillgraph.llm import decontam, html, langid, lm, minhash, mixing, quality, sharding, suffix, tokens

SCHEMA = "doc_id long, text string, lang string, source string, row string, key long, n_words int"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
VOCAB = [a + b for a in "ba ke mi zo tu la re".split() for b in "n s rt l x m dor ven".split()]


def sentence(r, n):
    return " ".join(r.choice(VOCAB) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    """Plain, copied, nearly copied, repeated, empty, null and very long texts; ids and columns with nulls; clashing names."""
    r = random.Random(4)
    base = [sentence(r, r.randint(5, 120)) for _ in range(40)]
    long = sentence(r, 9000)
    near = base[3].split()
    near[len(near) // 2] = "changed"
    texts = [*base, base[0], base[0], " ".join(near), long, long + " tail", "", None, "\n \t", "x", "é" * 300, "a" * 3000, base[1] + "\n" + base[2], "#$% ### &&& | " * 30]
    out = [(k, t, None if k % 9 == 0 else "en", "s", "clash", k, 7) for k, t in enumerate(texts)]
    return [*out, out[5], out[5], (None, base[7], "en", None, None, None, None), (None, None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def test_quality(docs, rows, none):
    got = sorted(map(tuple, quality.quality(docs.select("doc_id", "text", "source", "row")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed").collect()), key=str)
    want = []
    for k, t, *_ in rows:
        t = t or ""
        w = WORD.findall(t)
        seen, lines, dup = {}, set(), 0
        for i in range(len(w) - 7):
            seen.setdefault(tuple(w[i : i + 8]), []).append(i)
        hit = {j for at in seen.values() if len(at) > 1 for i in at for j in range(i, i + 8)}
        for line in t.split("\n"):
            if WORD.search(line):
                dup += line in lines
                lines.add(line)
        want.append((k, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(hit), len(w) < 20 or 100 * len(hit) > 30 * len(w)))
    assert got == sorted(want, key=str)
    assert quality.quality(none).count() == 0
    assert not quality.quality(docs.where("text LIKE '#$%'")).first().kept


def test_tokens(docs, rows, none):
    P = pytest.importorskip("public_tokenizers")
    import sentencepiece

    path = P.path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    got = sorted((str(r.doc_id), r.n_bytes, r.n_tokens, r.over_limit) for r in tokens.token_counts(docs, path).collect())
    assert got == sorted((str(k), len((t or "").encode()), n := len(sp.encode(t or "")), n > 4096) for k, t, *_ in rows)
    assert tokens.token_counts(none, path).count() == 0
    r = random.Random(7)
    odd = ["".join(r.choice(["a", "the", " ", "  ", "=", "--", "1", "é", "中", "\n", "▁", "<s>", "🙂", "\x00"]) for _ in range(r.randint(0, 80))) for _ in range(400)] + ["=" * 500, " " * 70]
    assert tokens.Merger(path).count(odd) == [len(x) for x in sp.encode(odd)]


def brute_classes(pairs):
    items, out = minhash.Items(), {k: k for k, _ in pairs}
    find = lambda x: x if out[x] == x else find(out[x])
    got = [(k, items.of(w)) for k, t in pairs if (w := minhash._WORD.findall((t or "").lower()))]
    for i, (a, x) in enumerate(got):
        for b, y in got[i + 1 :]:
            if minhash.aligned(x, y) >= minhash.SIMILAR:
                p, q = sorted((find(a), find(b)))
                out[q] = p
    return {k: find(k) for k, _ in pairs}


def test_near_duplicates(docs, rows, none):
    got = {r.doc_id: r.class_id for r in minhash.near_duplicates(docs).where("doc_id IS NOT NULL").collect()}
    assert got == brute_classes(list({(k, t) for k, t, *_ in rows if k is not None}))
    assert got[42] == 3 and got[40] == got[41] == 0 and got[44] == 43 and got[45] == 45
    assert minhash.near_duplicates(docs).count() == len(rows)
    assert minhash.near_duplicates(none).count() == 0


def test_alignment_is_sensitive_to_order():
    items, r = minhash.Items(), random.Random(1)
    a = [sentence(r, 60) for _ in range(4)]
    x, y = (items.of(" ".join(p).split()) for p in (a, a[::-1]))
    assert minhash.aligned(x, x) == 1.0 and minhash.aligned(x, y) < 0.5


def test_near_duplicates_with_a_hot_group(spark):
    """A third of the rows vary one text; another share a passage only."""
    r = random.Random(2)
    hot, passage, out = sentence(r, 200).split(), sentence(r, 60), []
    for k in range(60):
        v = hot[:]
        v[r.randrange(200)] = f"edit{k}"
        out.append((k, " ".join(v)))
    out += [(100 + k, passage + " " + sentence(r, 90)) for k in range(60)]
    got = {x.doc_id: x.class_id for x in minhash.near_duplicates(spark.createDataFrame(out, "doc_id long, text string")).collect()}
    assert all(got[k] == 0 for k in range(60)) and all(got[100 + k] == 100 + k for k in range(60))


@pytest.mark.parametrize("block", [40])
def test_near_duplicates_in_a_template_family(spark, monkeypatch, block):
    """Variants of one template, most pairs just under the threshold and some just over it, without items of their own."""
    monkeypatch.setattr(minhash, "BLOCK", block)
    r = random.Random(8)
    template, out = [f"w{k}" for k in range(150)], []
    for k in range(160):
        words = list(template)
        for at in r.sample(range(150), 3):
            words[at] = f"own{k}x{at}"
        out.append((k, " ".join(words)))
    got = {x.doc_id: x.class_id for x in minhash.near_duplicates(spark.createDataFrame(out, "doc_id long, text string")).collect()}
    want = brute_classes(out)
    assert 1 < len(set(want.values())) < len(out)
    assert got == want


def test_near_duplicates_of_branching_drafts(spark):
    """Drafts that branch by edits of a passage: at least 0.99 of the brute-force links lie within a class, and none is added."""
    r = random.Random(21)
    drafts = [[sentence(r, 1) + str(k) for k in range(240)]]
    for k in range(200):
        d = list(r.choice(drafts))
        for _ in range(2):
            lo = r.randrange(200)
            d[lo : lo + 8] = [f"e{k}x{j}" for j in range(8)]
        drafts.append(d)
    out = [(k, " ".join(d)) for k, d in enumerate(drafts)]
    got = {x.doc_id: x.class_id for x in minhash.near_duplicates(spark.createDataFrame(out, "doc_id long, text string")).collect()}
    items = minhash.Items()
    x = [items.of(d) for d in drafts]
    links = [(a, b) for a in range(len(x)) for b in range(a) if minhash.aligned(x[a], x[b]) >= minhash.SIMILAR]
    assert len(links) > 100 and sum(got[a] == got[b] for a, b in links) >= 0.99 * len(links)
    want = brute_classes(out)
    assert all(want[a] == want[b] for a in got for b in got if got[a] == got[b])


def test_near_duplicates_of_repeated_and_missing_ids(spark):
    """Repeated rows meet once, texts under one id and under none are classed each for itself, unspaced scripts have words."""
    r = random.Random(22)
    a, b, c = (sentence(r, 80) for _ in range(3))
    cjk = "".join(chr(0x4E00 + r.randrange(3000)) for _ in range(120))
    near = lambda t: t + " tail"
    rows = [(1, a)] * 300 + [(2, near(a))] * 300 + [(5, b), (5, c), (6, near(b)), (7, near(c)), (None, c), (None, near(c)), (None, sentence(r, 60)), (8, cjk), (9, cjk[:60] + "\u4e00" + cjk[60:])]
    got = minhash.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == len(rows)
    of = lambda k: {x.class_id for x in got if x.doc_id == k}
    assert of(1) == of(2) == {1} and of(5) == {5} and of(6) == of(7) == {5} and of(8) == of(9) == {8} and of(None) == {5, None}
    assert len({x.keeper for x in got if x.doc_id in (5, 6, 7)}) == 2


def brute_removed(texts, span=suffix.SPAN):
    raw = [(t or "").encode() for t in texts]
    seen = Counter(x[i : i + span] for x in raw for i in range(len(x) - span + 1))
    for x in raw:
        gone = np.zeros(len(x), bool)
        for i in range(len(x) - span + 1):
            if seen[x[i : i + span]] > 1:
                gone[i : i + span] = True
        spans = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
        yield len(x), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(x, np.uint8)[~gone].tobytes()).hexdigest()


def test_repeats(docs, rows, none):
    cols = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    got = sorted((tuple(r[c] for c in cols) for r in suffix.remove_repeats(docs).collect()), key=str)
    assert got == sorted(((k, *x) for (k, *_), x in zip(rows, brute_removed([t for _, t, *_ in rows]), strict=True)), key=str)
    assert suffix.remove_repeats(none).count() == 0


def test_repeats_at_every_edge(spark):
    """Passages of 199 to 420 bytes among other text, shifted, nested and inside one text."""
    r = random.Random(9)
    fill = lambda n: "".join(r.choice("abcdefghij ") for _ in range(n))
    passages = [fill(n) for n in (199, 200, 201, 260, 330, 420)]
    texts = []
    for _ in range(60):
        t = fill(r.randint(0, 200))
        for _ in range(r.randint(1, 3)):
            p = r.choice(passages)
            lo = r.randint(0, 60)
            t += p[lo : len(p) - r.randint(0, 60)] + fill(r.randint(0, 150))
        texts.append(t)
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    got = [tuple(x)[1:] for x in suffix.remove_repeats(d).orderBy("doc_id").collect()]
    assert got == list(brute_removed(texts))


def test_repeats_across_pieces(monkeypatch):
    r = np.random.default_rng(3).integers(97, 101, 5000).astype(np.uint8)
    monkeypatch.setattr(suffix, "PIECE", 700)
    place = suffix.parse(r)[3]
    starts = [k for p in place.tolist() for k in range(p >> 16, (p >> 16) + (p & 255))]
    assert sorted(starts) == list(range(5000 - suffix.SPAN + 1))


def test_repeats_with_a_hot_passage(spark):
    """A passage in most texts, each between bytes of its own, one text many times, and drafts that differ in two places."""
    r = random.Random(19)
    fill = lambda n: "".join(r.choice("abcdefghij ") for _ in range(n))
    passage, short, draft, same = fill(700), fill(230), fill(900), fill(500)
    texts = [fill(r.randint(40, 90)) + passage[r.randint(0, 150) :] + fill(30) + short + fill(40) for _ in range(90)] + [same] * 60
    for _ in range(60):
        d = list(draft)
        for at in r.sample(range(900), 2):
            d[at] = "#"
        texts.append("".join(d))
    r.shuffle(texts)
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = [tuple(x)[1:] for x in suffix.remove_repeats(d).orderBy("doc_id").collect()]
    assert got == list(brute_removed(texts))


def test_repeats_that_others_part(spark):
    """Left and right parts around a core in any pairing, so that texts which share one part only lie between equal ones in both
    orders, some of which are neighbours and some not."""
    r = random.Random(23)
    fill = lambda n: "".join(r.choice("abcdefghij ") for _ in range(n))
    parts = [([fill(50) for _ in range(3)], fill(100), [fill(50) for _ in range(3)]) for _ in range(8)]
    texts = [fill(r.randint(20, 60)) + r.choice(left) + core + r.choice(right) + fill(r.randint(20, 60)) for left, core, right in parts for _ in range(36)]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = [tuple(x)[1:] for x in suffix.remove_repeats(d).orderBy("doc_id").collect()]
    assert got == list(brute_removed(texts))


def test_neighbours_across_partitions():
    """Streams in pieces of any size, with and without rows before and after, give each row once beside its neighbours."""
    import pyarrow as pa

    table = pa.table({"x": list(range(10))})
    for size in (1, 2, 3, 10):
        for before in (False, True):
            for after in (False, True):
                parts = table.slice(before, 10 - before - after).combine_chunks().to_batches(max_chunksize=size)
                seen = []
                for t, lo, hi in suffix._stream(iter(parts), table.slice(0, 1) if before else None, table.slice(9, 1) if after else None):
                    x = t.column("x").to_pylist()
                    seen += x[lo:hi]
                    assert all((k == 0 and x[k] == 0 or x[k - 1] == x[k] - 1) and (x[k] == 9 or x[k + 1] == x[k] + 1) for k in range(lo, hi))
                assert seen == list(range(int(before), 10 - after))


DECON_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain(t):
    return DECON_WORD.findall((t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))


def brute_hits(texts, items):
    wins = {}
    for i, t in items:
        w = plain(t)
        k = min(10, len(w))
        for s in range(len(w) - k + 1 if k else 0):
            wins.setdefault(tuple(w[s : s + k]), set()).add(i)
    for t in texts:
        w, hit, ids = plain(t), set(), set()
        for k in {len(x) for x in wins}:
            for s in range(len(w) - k + 1):
                if (x := tuple(w[s : s + k])) in wins:
                    hit |= set(range(s, s + k))
                    ids |= {str(i) for i in wins[x] if i is not None}
        yield len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit)


def test_decontamination(spark, docs, rows, none):
    texts = [t for _, t, *_ in rows]
    part = texts[43].split()
    items = [(1, " ".join(part[50:75])), (10, " ".join(part[60:80]).upper() + "!"), (2, texts[4]), (3, "zorl zorx"), (4, " ".join(part[7:9])), (5, part[3]), (6, ""), (7, None), (None, " ".join(part[200:212])), (2, texts[4]), (8, "never seen words at all")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    cols = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    got = sorted((tuple(r[c] for c in cols) for r in decontam.decontaminate(docs, bench).collect()), key=str)
    assert got == sorted(((k, *x) for (k, *_), x in zip(rows, brute_hits(texts, items), strict=True)), key=str)
    assert decontam.decontaminate(docs, bench.limit(0)).where("n_hit > 0").count() == 0
    assert decontam.decontaminate(none, bench).count() == 0


def test_html(spark):
    model = html.default_model()
    article = "<html><head><title>T</title><style>p{}</style></head><body><nav><ul><li><a href=/a>Home</a></li></ul></nav><div class='ad'>Buy now.</div><article><h1>Big &amp; news</h1><p>One  two<br>three.<p>Four &lt;five&gt;.</article><div id=comments><p>Nice post!</p></div><footer>&copy; me</footer>"
    assert html.main_text(article, model) == "Big & news\n\nOne two three.\n\nFour <five>."
    odd = [None, "", "<", "<p", "<script>x", "</p></p>", "<div>" * 3000 + "x", "&amp", "<!-- a", "<a href='>x</a>"]
    assert all(isinstance(html.main_text(x, model), str) for x in odd)
    pages = spark.createDataFrame([(1, "u", article, 0), (2, None, None, 0), (1, "u", article, 0)], "page_id long, url string, html string, text int")
    assert sorted((r.page_id, r.n_chars) for r in html.extract(pages).collect()) == [(1, 40), (1, 40), (2, 0)]


def test_html_deep_and_odd_pages(spark):
    """Scores of a deep page grow with its size only; hand-written pages of other kinds; text of any element inside the article."""
    import time

    model = html.default_model()
    deep = lambda k: "".join(f"<div class='w{j} x{j}'>" for j in range(k)) + "<p>Deep text, it is.</p>" + "</div>" * k
    began = time.time()
    assert isinstance(html.main_text(deep(20_000), model), str) and time.time() - began < 20
    for page in (deep(40), "<ul id=menu><li><a href=/>Home</a></ul><main><p>One.</p></main>"):
        by_features = [sum(model.state.get(f, 0.0) for f in fs) for _, fs in html.blocks(page)]
        assert np.allclose([e for _, e in html._Page(page, model.state).blocks], by_features)
    kept = html.main_text("<article><h1>Sum</h1><p>As <math><mi>x</mi><mo>+</mo><mn>1</mn></math> shows, it grows, and so on.</p><object><p>A figure of the growth, drawn by hand.</p></object><p>It ends here.</p></article>", model)
    assert "As x+1 shows, it grows" in kept and "drawn by hand" in kept
    assert "code" not in html.main_text("<article><p>Before it.</p><script src=x />var code = 1;</script><p>After it.</p></article>", model)
    table = "<table><tr><td><a href=/>Home</a> | <a href=/n>News</a></td></tr><tr><td><h1>Rain at last</h1><p>It rained all night, and the river rose.</p><p>Farmers were glad, they said.</p></td></tr><tr><td>&copy; 2020 The Paper</td></tr></table>"
    assert "the river rose." in html.main_text(table, model) and "The Paper" not in html.main_text(table, model)
    none = spark.createDataFrame([], "page_id long, url string, html string")
    assert html.extract(none).count() == 0


def test_html_on_written_pages():
    """Held-out pages of the same kind: nearly all are extracted without a difference."""
    import html as plain_html

    model, pages = html.default_model(), html.labelled_pages(120, seed=77)
    right = sum(html.main_text(p, model) == "\n\n".join(" ".join(plain_html.unescape(t).split()) for t in texts) for p, texts in pages)
    assert right >= 108


def test_language(spark, docs, none):
    r = random.Random(5)
    kinds = {"aa": "ka ki ku kin tak".split(), "bb": "sho sha schu lesh osh".split()}
    out = [(k, " ".join("".join(r.choices(v, k=2)) for _ in range(r.randint(8, 40))), lang) for k, (lang, v) in enumerate(list(kinds.items()) * 60)]
    out += [(900, "!!! 123", "aa"), (901, None, "bb"), (902, "", None)]
    got = {x.doc_id: x for x in langid.language_id(spark.createDataFrame(out, "doc_id long, text string, lang string")).collect()}
    held = [(k, lang) for k, t, lang in out[:120] if zlib.crc32(str(k).encode()) % 3 == 1]
    assert held and all(got[k].held_out and got[k].lang_pred == lang for k, lang in held)
    assert all(got[k].lang_pred == "und" and got[k].score == 0 for k in (900, 901, 902))
    assert all(0 <= x.score <= 1 for x in got.values())
    assert langid.language_id(docs).count() == docs.count()
    assert langid.language_id(none).count() == 0


@pytest.mark.parametrize("langs", [["aa", "bb"], ["aa"]])
def test_language_stage_rejects_what_it_has_not_learned(spark, langs):
    """Other scripts, another language and drawn letters go, however few languages are learned; known texts stay."""
    import corpus_pipeline as cp

    r = random.Random(6)
    kinds = {"aa": "ka ki ku kin tak".split(), "bb": "sho sha schu lesh osh".split(), "cc": "wyv pov zuy evyp".split()}
    kinds |= {"greek": list("αβγδεζηθικλμνξοπρστυ"), "cyrillic": list("абвгдежзиклмнопрст"), "cjk": [chr(0x4E00 + k) for k in range(400)], "noise": list("abcdefghijklmnopqrstuvwxyz")}
    draw = lambda v, n: " ".join("".join(r.choices(v, k=3)) for _ in range(n))
    good = [(k, draw(kinds[lang], r.randint(5, 90)), lang) for k, lang in enumerate(langs * 30)]
    bad = [(1000 + k, draw(v, n), None) for k, (v, n) in enumerate((v, n) for kind, v in kinds.items() if kind not in ("aa", "bb") for n in (8, 30, 300))]
    kept = {x.doc_id for x in cp.language_id(spark, spark.createDataFrame([*good, *bad], "doc_id long, text string, lang string"), "").collect()}
    assert kept == {k for k, *_ in good}


def test_hyperdimensional_bundles():
    """A text's vector is the sum of its bound n-grams, and the score is its true cosine, whatever the block."""
    b, texts = langid.Binder(), ["some plain text", "texto más", "", "a" * 50, *[sentence(random.Random(k), 30) for k in range(150)]]
    doc, code, n = langid.grams(texts)
    want = np.array([(b.bind(code[doc == k]).astype(float) * n[doc == k][:, None]).sum(0) for k in range(len(texts))])
    unit = want[:2] / np.linalg.norm(want[:2], axis=1, keepdims=True)
    scorer = langid.Scorer(unit.astype(np.float32))
    assert np.array_equal(scorer.bundles(texts), want)
    cos, known = scorer.cosines(texts)
    full = np.linalg.norm(want, axis=1) > 0
    assert np.array_equal(known, full) and np.allclose(cos[full], want[full] @ unit.T / np.linalg.norm(want[full], axis=1)[:, None], atol=1e-5)


def test_language_letters_of_every_plane(spark):
    """Letters far beyond the first plane are learned and predicted like others."""
    far = [chr(c) for c in range(0x110000) if chr(c).isalpha()]
    far = far[:: len(far) // 4] + far[-4:]
    r = random.Random(12)
    rows = [(k, " ".join("".join(r.choices(far, k=4)) for _ in range(30)) if k % 2 else sentence(r, 30), "far" if k % 2 else "near") for k in range(40)]
    rows += [(100, "abc " + chr(0x31000) * 4, None), (101, chr(0x323AF) * 3, "far")]
    got = {x.doc_id: x for x in langid.language_id(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert len(got) == len(rows) and all(got[k].lang_pred == ("far" if k % 2 else "near") for k in range(40))
    letters = [c for c in range(0x110000) if chr(c).isalpha()]
    doc, code, n = langid.grams([f"{chr(a)}{chr(b)}{chr(c)}" for a, b, c in zip(letters[-300:], letters[:300], letters[-300:])])
    assert set(doc.tolist()) == set(range(300)) and (n == 1).all() and (code < langid.base() ** 3).all()


def test_lm(docs, rows, none):
    got = {}
    for x in lm.lm_scores(docs).collect():
        got.setdefault(x.doc_id, []).append(x)
    counts = Counter()
    for k, t, *_ in rows:
        if k is None or zlib.crc32(str(k).encode()) % 7 != 2:
            counts.update(lm.tokens(t))
    n, v = sum(counts.values()), len(counts)
    for k, t, *_ in rows:
        ts = lm.tokens(t)
        base = sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in ts)
        assert any(x.n_tokens == len(ts) and x.n_known == sum(counts[w] > 0 for w in ts) and abs(x.base_score - base) < 1e-6 and x.train_tokens == n for x in got[k])
    assert lm.lm_scores(none).count() == 0


def test_lm_learns_context(spark):
    r = random.Random(6)
    a, b = [f"a{i}" for i in range(30)], [f"b{i}" for i in range(30)]
    rows = [(k, " ".join(r.choices(a if k % 2 else b, k=60))) for k in range(300)]
    got = lm.lm_scores(spark.createDataFrame(rows, "doc_id long, text string")).where("held_out").collect()
    assert got and np.mean([(x.score - x.base_score) / x.n_tokens for x in got]) > 0.15


def learned(spark, texts):
    from pyspark.sql import functions as F

    d = spark.createDataFrame([(t,) for t in texts], "text string")
    counts = d.mapInArrow(lm._count, "tok binary, n long").groupBy("tok").agg(F.sum("n").alias("n"))
    return lm.learn(d.withColumn("draw", F.shiftrightunsigned(F.xxhash64("text"), 1)), counts)


@pytest.mark.parametrize("vocabulary", [20, 1500])
def test_lm_sums_to_one(spark, vocabulary):
    """Over the words, the other known tokens and one unknown, after any context, with few and many tokens."""
    r = random.Random(7)
    got = learned(spark, [" ".join(f"w{int(r.paretovariate(0.4)) % vocabulary}" for _ in range(80)) for _ in range(60)])
    reader = lm.Reader(got.head)
    for text in ("", "w1 w2 w3", "w5 never w7"):
        r_ = reader.read([[*lm.tokens(text)[:-1], t] for t in got.head[: lm.WORDS]] + [[*lm.tokens(text)[:-1], b"never"]])
        ends = np.append(r_.first[1:], len(r_.rank)) - 1
        p = np.exp(got.model.log_prob(lm.features(r_), r_.rank)[ends])
        inside, other = p[:-1].sum(), p[-1]
        rest = (sum(got.freq[lm.WORDS :]) + len(got.freq[lm.WORDS :]) + 1) / got.others
        assert abs(inside + other * rest - 1) < 1e-4


def test_lm_against_plain_loops(spark, docs, rows):
    """Scores as a token-by-token computation of both softmaxes and the pair features gives them."""
    texts = [t for k, t, *_ in rows if k is None or zlib.crc32(str(k).encode()) % 7 != 2]
    out_of = [x for x in lm.lm_scores(docs).collect()]
    from pyspark.sql import functions as F

    d = spark.createDataFrame([(k, t) for k, t, *_ in rows if k is None or zlib.crc32(str(k).encode()) % 7 != 2], "doc_id long, text string")
    counts = d.select("text").mapInArrow(lm._count, "tok binary, n long").groupBy("tok").agg(F.sum("n").alias("n"))
    got = lm.learn(d.select("text", F.shiftrightunsigned(F.xxhash64("doc_id", "text"), 1).alias("draw")), counts)
    reader, m = lm.Reader(got.head), got.model

    def soft(z, k):
        top = max(z)
        return z[k] - top - math.log(sum(math.exp(x - top) for x in z))

    def plain_lp(r, f, i):
        rank = int(r.rank[i])
        cls, slot = (rank // lm.SLOTS + 1, rank % lm.SLOTS) if 0 <= rank < lm.WORDS else (0, 0)
        rows_ = m.rows(f[i : i + 1])[0]
        lp = soft([float(m.class_bias[c]) + sum(float(m.classes[k, c]) for k in rows_) for c in range(lm.CLASSES + 1)], cls)
        if cls:
            at = m.rows(f[i : i + 1], np.array([cls]))[0]
            return lp + soft([float(m.slot_bias[cls - 1, s]) + sum(float(m.slots[k, s]) for k in at) for s in range(lm.SLOTS)], slot)
        return lp + math.log(((got.freq[rank] if rank >= 0 else 0) + 1) / got.others)

    seen, table = {}, {}
    read = lambda t: (r := reader.read([lm.tokens(t)]), lm.features(r), lm.anchors(r))
    for t in texts:
        r, f, (at, h, pair) = read(t)
        for i, c, p in zip(at.tolist(), h.tolist(), pair.tolist()):
            n, lp = seen.get((c, p), (0, 0))
            seen[c, p] = (n + 1, plain_lp(r, f, i))
    for c in {c for c, _ in seen}:
        mine = [(p, n, math.exp(lp)) for (cc, p), (n, lp) in seen.items() if cc == c]
        w = {p: 0.0 for p, _, _ in mine if p}
        total = sum(n for _, n, _ in mine)
        for _ in range(lm.FIT_STEPS):
            z = 1 + sum(q * math.expm1(w[p]) for p, _, q in mine if p)
            for p, n, q in mine:
                if p:
                    y = q * math.exp(w[p]) / z
                    w[p] += max(-1, min(1, (n - total * y - w[p] / lm.PRIOR) / (total * y * (1 - y) + 1 / lm.PRIOR)))
        table[c] = (w, math.log(1 + sum(q * math.expm1(w[p]) for p, _, q in mine if p)))
    want = {}
    for k, t, *_ in rows:
        r, f, (at, h, pair) = read(t)
        gain = sum(table[c][0].get(p, 0.0) - table[c][1] for c, p in zip(h.tolist(), pair.tolist()) if c in table)
        want.setdefault(k, []).append((sum(plain_lp(r, f, i) for i in range(len(r.rank))) + gain) / math.log(10))
    for x in out_of:
        assert any(abs(x.score - y) < 1e-3 * max(1, abs(y)) for y in want[x.doc_id]), (x, want[x.doc_id])


def test_lm_pair_features_are_normalised():
    ctx = np.array([1, 1, 1, 2])
    n, p, known = np.array([5.0, 1, 2, 4]), np.array([0.1, 0.001, 0.2, 0.3]), np.array([True, True, False, True])
    first, total, log_z, w = lm.fit_pairs(ctx, n, p, known)
    assert first.tolist() == [0, 3] and total.tolist() == [8, 4] and w[2] == 0
    q = p * np.exp(w) / np.exp(np.repeat(log_z, [3, 1]))
    assert np.allclose(log_z, [np.log(1 + p[0] * np.expm1(w[0]) + p[1] * np.expm1(w[1])), np.log(1 + p[3] * np.expm1(w[3]))])
    assert np.abs(n - np.repeat(total, [3, 1]) * q - w / lm.PRIOR)[known].max() < 1e-3


@pytest.mark.parametrize("n", [1, 40, 3000])
def test_lm_gradient_sums(n):
    """Sums by row with runs of one, of some and of very many rows, longest run first."""
    r = np.random.default_rng(n)
    g, rows = r.random((n, 5)).astype(np.float32), np.sort((r.pareto(0.5, 4 * n) * 3).astype(np.int64) % 700)
    src, first = r.integers(0, n, 4 * n), np.flatnonzero(np.append(True, rows[1:] != rows[:-1]))
    by, count, got = lm._sums(g, src, first)
    assert sorted(by.tolist()) == list(range(len(first))) and (np.diff(count) <= 0).all() and count.sum() == 4 * n
    for k, x in zip(by, got, strict=True):
        assert np.allclose(x, g[src[rows == rows[first[k]]]].astype(float).sum(0), rtol=1e-4)


@pytest.mark.parametrize("kind", [pa.string(), pa.large_string()])
@pytest.mark.parametrize("group", [5, 300])
def test_lm_reads_whole_texts(monkeypatch, kind, group):
    """Many texts at once are read, and counted, as token by token: nulls, empty texts, all white space, words of any length and head."""
    monkeypatch.setattr(lm, "GROUP", group)
    monkeypatch.setattr(lm, "_SPAN", 40)
    monkeypatch.setattr(lm, "COUNTED", 50)
    r = random.Random(group)
    parts = ["a", "B", "É", "漢", "\x00", "\x1c", "\u0085", "zz" * 70, " the ", " ", "  ", "\n", "\v", "\r\n"]
    texts = [None, "", " \t", *("".join(r.choices(parts, k=r.choice([1, 4, 90]))) for _ in range(40)), None, "end"]
    flat = [t for x in texts for t in lm.tokens(x)]
    col = pa.array(["before", None, *texts], kind).slice(2)
    for head in ([], sorted(set(flat))[::2], sorted(set(flat) - {lm.END})):
        k = 0
        for got in lm.Reader(head).groups(col):
            mine = flat[k : k + len(got.rank)]
            k += len(mine)
            assert got.rank.tolist() == [head.index(t) if t in head else -1 for t in mine]
            assert got.hash.tolist() == [zlib.crc32(t) << 32 | zlib.crc32(t[::-1], 7) for t in mine]
            assert got.ctx.tolist() == [head.index(t) if t in head else lm.CONTEXT + zlib.crc32(t[-2:]) % lm.ENDINGS for t in mine]
            assert got.tail.to_pylist() == [t for t in mine if t not in head]
            assert [mine[f + n - 1] for f, n in zip(got.first, got.size)] == [lm.END] * len(got.size) and got.size[:-1].sum() <= group
        assert k == len(flat)
    counts = Counter()
    for b in lm._count(iter([pa.RecordBatch.from_arrays([col], names=["text"])])):
        counts.update(dict(zip(b.column(0).to_pylist(), b.column(1).to_pylist())))
    assert counts == Counter(flat)


@pytest.mark.parametrize("most", [5, 1 << 20])
def test_lm_pair_gains(spark, monkeypatch, most):
    """Equal to a plain fit whether contexts count as very frequent or not; those that don't are read and exchanged once, without a join."""
    monkeypatch.setattr(lm, "MOST_ROWS", most)
    r = random.Random(13)
    kinds = {(c, 0 if p == 0 else 1000 * c + p): -r.random() - 1 for c in range(1, 9) for p in range(4)}
    docs, want = [], {}
    for row in range(60):
        held = r.choices(list(kinds), [1 + 40 * (c == 1) for c, _ in kinds], k=row % 7)
        often = Counter(c for c, _ in held)
        docs.append((row, row % 5 > 0, [c for c, _ in held], [p for _, p in held], [kinds[x] for x in held], list(often), list(often.values())))
    seen = Counter(x for d in docs if d[1] for x in zip(d[2], d[3]))
    rows = sorted(seen)
    first, _, log_z, w = lm.fit_pairs(np.array([c for c, _ in rows]), np.array([float(seen[x]) for x in rows]), np.array([10.0 ** np.float32(kinds[x]) for x in rows]), np.array([p != 0 for _, p in rows]))
    z, weight = dict(zip([rows[k][0] for k in first], log_z)), dict(zip(rows, w))
    for row, _, cs, ps, *_ in docs:
        if any(c in z for c in cs):
            want[row] = (sum(weight.get((c, p), 0.0) - z[c] for c, p in zip(cs, ps) if c in z) / math.log(10), sum((c, p) in seen and p != 0 for c, p in zip(cs, ps)))
    scored = spark.createDataFrame(docs, "row long, learned boolean, ctx array<long>, pair array<long>, lp array<float>, often array<long>, times array<long>")
    gains = lm.pair_gains(scored)
    got = {x.row: (x.gain, x.n_pairs) for x in gains.collect()}
    assert got.keys() == want.keys() and all(abs(got[k][0] - want[k][0]) < 1e-6 and got[k][1] == want[k][1] for k in want)
    plan = gains._jdf.queryExecution().optimizedPlan().toString()
    assert ("Join" in plan) == (most == 5) and (most == 5 or plan.count("Generate") == 1)


def test_lm_does_not_depend_on_partitions(spark):
    r = random.Random(10)
    d = spark.createDataFrame([(k, sentence(r, 40)) for k in range(120)], "doc_id long, text string")
    a, b = ({x.doc_id: x.score for x in lm.lm_scores(d.repartition(k)).collect()} for k in (2, 16))
    assert all(abs(a[k] - b[k]) < 1e-5 for k in a)


def test_lm_knows_learned_texts(spark):
    """A held-out copy of a learned text scores far above others of its kind."""
    r = random.Random(11)
    rows = [(k, sentence(r, 100)) for k in range(200)]
    held = [k for k in range(200) if zlib.crc32(str(k).encode()) % 7 == 2]
    rows += [(1000 + k, rows[k][1]) for k in held[:10] if zlib.crc32(str(1000 + k).encode()) % 7 != 2]
    copied = {k - 1000 for k, _ in rows[200:]}
    got = {x.doc_id: x.score / x.n_tokens for x in lm.lm_scores(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert min(got[k] for k in copied) > max(got[k] for k in held if k not in copied)


def test_mixing(spark, docs, none):
    r = random.Random(8)
    rows, labels = [], []
    for k in range(600):
        kind = k % 10
        w = [r.choice(VOCAB) for _ in range(50)]
        if kind == 0:
            w[10] = w[20] = "vile"
        if kind == 1:
            w = [x + "###" for x in w]
        rows.append((k, " ".join(w)))
        if k % 2 < 2:
            labels.append((k, int(kind != 1), int(kind == 0)))
    lab = spark.createDataFrame([*labels, (None, 1, 0), (3, None, None)], "doc_id long, quality int, toxic int")
    got = {x.doc_id: x for x in mixing.mix(spark.createDataFrame(rows, "doc_id long, text string"), lab).collect()}
    assert all(got[k].copies == 0 for k in range(0, 600, 10)) and all(got[k].copies >= 1 for k in range(600) if k % 10 > 1)
    share = {d: sum(x.n_tokens * x[f"p_{d}"] * x.rate for x in got.values()) for d in mixing.DOMAINS}
    assert abs(share["poor"] / sum(share.values()) - 0.03) < 0.02 and share["toxic"] / sum(share.values()) < 0.01
    assert mixing.mix(docs, lab).count() == docs.count() == mixing.mix(docs, lab.limit(0)).count()
    assert mixing.mix(none, lab).count() == 0


def test_mixing_is_the_optimum(spark):
    """Rates as projected gradient steps in numpy, small and many, find them."""
    r = np.random.default_rng(3)
    n, p = r.integers(1, 400, 500), r.dirichlet([3, 0.4, 0.2], 500)
    p[:60] = [0.001, 0.001, 0.998]
    table = spark.createDataFrame([(k, int(a), *map(float, x)) for k, (a, x) in enumerate(zip(n, p))], "doc_id long, n_tokens long, p_good double, p_poor double, p_toxic double")
    held = (n[:, None] * p).sum(0)
    goal = held[0] / 0.97 * np.array([0.97, 0.03, 0.0])
    v = np.array(mixing.solve(table, goal.tolist(), held.tolist()))
    got, x = np.maximum(0, 1 - p @ v), np.ones(500)
    for _ in range(100_000):
        x = np.maximum(0, x - 0.3 * (p @ ((n * x) @ p / held - goal / held) + mixing.RIDGE * (x - 1)))
    assert np.abs(got - x).max() < 5e-3 and got[:60].max() < 0.01
    assert np.allclose([a.r for a in table.select(mixing.rate(v).alias("r"), "doc_id").orderBy("doc_id").collect()], got)


def test_mixing_table_has_a_slot_a_token():
    r = random.Random(1)
    logs = [(r.getrandbits(64) - (1 << 63), [float(k), -float(k)]) for k in range(2000)]
    slots, shift, held, odds = mixing._table(logs)
    assert all(held[h >> shift & (slots - 1)] == h and odds[0][h >> shift & (slots - 1)] == w[0] for h, w in logs)


@pytest.mark.parametrize("limit", [50, 400, 3000, 10**9])
def test_sharding(docs, none, limit):
    got = sharding.assign(docs.unionByName(docs.where("doc_id = 5")), limit).toPandas()
    by = got.groupby("shard").n_bytes.agg(["sum", "count"])
    assert len(got) == docs.count() + 3
    assert (by["sum"][by["count"] > 1] <= limit).all() or limit == 50
    leaves = sorted({s.split(".")[0] for s in got.shard})
    assert all(not b.startswith(a) for a, b in zip(leaves, leaves[1:]))
    for s in leaves:  # a bucket was only split where it had to be
        if s:
            assert got[[x.startswith(s[:-1]) for x in got.shard]].n_bytes.sum() > limit
    assert sharding.assign(none, limit).count() == 0


def test_written_shards(spark, docs, tmp_path):
    sharding.write_shards(docs, str(tmp_path / "out"), 4000)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == docs.count() and {"shard", "text", "lang"} <= set(back.columns)


def test_pipeline(spark, tmp_path, docs):
    """Each stage against its rule on a small corpus."""
    import corpus_pipeline as cp

    r = random.Random(3)
    clean = [(k, sentence(r, 80), "en", "s", 0) for k in range(80)]
    bench = sentence(r, 30)
    extra = [(100, clean[0][1], "en", "s", 0), (101, clean[1][1] + " tail", "en", "s", 0), (102, "123 !!!", "en", "s", 0), (103, sentence(r, 40) + " " + bench, "en", "s", 0), (104, None, None, None, None)]
    d = str(tmp_path)
    spark.createDataFrame([*clean, *extra], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(1, bench)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    spark.createDataFrame([(k, 1, 0) for k in range(40)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    at, seen = spark.read.parquet(f"{d}/documents.parquet"), []
    for _, stage in cp.STAGES[:4]:
        nxt = stage(spark, at, d)
        assert nxt.columns == at.columns
        seen.append({x.doc_id for x in nxt.select("doc_id").collect()})
        at = nxt
    assert 102 not in seen[0] and 104 not in seen[0] and 100 in seen[0]
    assert seen[1] == seen[0] - {100, 101} and seen[2] == seen[1] - {103} and seen[3] == seen[2]
    assert {x.doc_id for x in cp.run(spark, d).collect()} == set(range(80))


def test_pipeline_rows_without_and_with_repeated_ids(spark, tmp_path):
    """Texts under one id and rows without an id are judged by their own text; the clashing column is carried along."""
    import corpus_pipeline as cp

    r = random.Random(13)
    bench = sentence(r, 30)
    good = [sentence(r, 80) for _ in range(30)]
    rows = [(k, t, "en", 1) for k, t in enumerate(good)]
    rows += [(3, bench + " " + sentence(r, 50), "en", 2), (3, good[3], "en", 3), (None, sentence(r, 80), None, 4), (None, good[5] + " tail", None, 5), (None, "12 !", None, 6)]
    d = str(tmp_path)
    spark.createDataFrame([(1, bench)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    spark.createDataFrame([(k, 1, 0) for k in range(20)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    at = spark.createDataFrame(rows, "doc_id long, text string, lang string, row int")
    kept = []
    for _, stage in cp.STAGES[:4]:
        at = stage(spark, at, d)
        kept.append({x.row for x in at.select("row").collect()})
    everything = set(range(1, 7))
    assert kept[0] == everything - {6} and kept[1] >= {2, 4} and not kept[1] & {5, 6} and len(at.where("doc_id = 3").collect()) == 1
    assert 2 not in kept[2] and 4 in kept[3] and at.count() == 31
