"""The ten operators against brute-force versions and on odd rows: nulls, empty and repeated rows, empty tables."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [(1, None), (2, ""), (3, "a"), (3, "a"), (None, "one two three four five six"), (5, "word " * 3000), (6, "one two three four five six")]


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], DOCS)


def test_decontamination_brute_force():
    from tenderlens.llm.common import alnum_words
    from tenderlens.llm.decontam import Phrases, search_shard

    rnd = random.Random(5)
    for trial in range(120):
        w = rnd.choice([2, 3, 5])
        items = [(i, " ".join(rnd.choice("abc") for _ in range(rnd.randint(0, w + 3)))) for i in range(rnd.randint(0, 4))]
        shard = [(i, alnum_words(" ".join(rnd.choice("abcd") for _ in range(rnd.randint(0, 40))))) for i in range(5)]
        windows = {}
        for i, t in items:
            x = alnum_words(t)
            for k in range(max(1, len(x) - w + 1) if x else 0):
                windows.setdefault(tuple(x[k : k + w]), set()).add(str(i))
        for (_, words), (_, n, its, a, b) in zip(shard, search_shard(shard, Phrases(items, w))):
            hit, held = set(), set()
            for p, of in windows.items():
                for k in range(len(words) - len(p) + 1):
                    if tuple(words[k : k + len(p)]) == p:
                        hit |= set(range(k, k + len(p)))
                        held |= of
            assert (n, its) == (len(words), sorted(held))
            assert set().union(*[range(x, y) for x, y in zip(a, b)]) == hit


def test_decontamination_in_blocks_keeps_every_row(spark, monkeypatch):
    from tenderlens.llm import decontam

    bench = spark.createDataFrame([(k, f"a{k} b{k} c{k} d{k}") for k in range(6)], "item_id long, text string")
    texts = ["x a0 b0 c0 d0 y a5 b5 c5 d5", "a1 b1 c1 d1 a2 b2 c2 d2 z z", "b3 c3 d3 b4 c4 d4 z z z z", "none of them is in here at all today it"]
    ids = [1, 1, None, None]
    rows = docs(spark, ODD + list(zip(ids, texts)) * 2)
    run = lambda: sorted(map(tuple, decontam.contamination(rows, bench, 3).collect()), key=str)
    whole = run()
    assert len(whole) == rows.count() and {r[2] for r in whole} == {0, 6, 8}
    monkeypatch.setattr(decontam, "BLOCK_WORDS", 5)
    assert len(list(decontam.blocks_of(bench))) > 2 and run() == whole


def shingle_set(t, k=5):
    w = (t or "").encode().lower().split()
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def test_jaccard_components_brute_force(spark, monkeypatch):
    from tenderlens.llm import jaccard

    monkeypatch.setattr(jaccard, "BLOCK", 8)  # several blocks a region
    rnd = random.Random(2)
    rows = []
    for g in range(6):
        base = [rnd.choice("abcdefghijklmnop") + str(rnd.randint(0, 30)) for _ in range(60)]
        for _ in range(rnd.choice([1, 3, 30])):
            x = list(base)
            for _ in range(rnd.randint(0, 3)):
                x[rnd.randrange(len(x))] = "x" + str(rnd.randint(0, 99))
            rows.append((len(rows), " ".join(x)))
    rows += [(900, None), (901, ""), (902, "short text"), (903, "Short  TEXT")]
    root = {i: i for i, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    sets = {i: shingle_set(t) for i, t in rows}
    for i, a in sets.items():
        for j, b in sets.items():
            if j < i and a and b and 100 * len(a & b) >= 75 * len(a | b):
                p, q = find(i), find(j)
                root[max(p, q)] = min(p, q)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.near_documents(docs(spark, rows)).collect()}
    assert got == {i: (len(sets[i]), find(i)) for i, _ in rows}


def test_voronoi_links_equal_brute_force():
    from tenderlens.llm.jaccard import links

    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 60, rng.integers(5, 40))) for _ in range(300)]
    root = links(sets, 50)
    for i in range(0, 300, 7):
        for j in range(i):
            n = len(np.intersect1d(sets[i], sets[j]))
            if 2 * n >= len(sets[i]) + len(sets[j]) - n:
                assert root[i] == root[j]


def test_license_scan(spark):
    from tenderlens.llm.license_scan import scan

    rows = ODD + [(7, "Licensed under the Apache License, Version 2.0.\nMIT license, MIT License"), (8, "released under this MIT License thing")]
    got = {(r.doc_id, r.n_words): r for r in scan(docs(spark, rows)).collect()}
    r = got[7, 12]
    assert (r.n_base, r.first_word, r.last_word, r.base_labels, r.score) == (3, 3, 10, "apache,mit", 1.0) and "apache-2.0" in r.labels
    assert got[1, 0].first_word is None and got[8, 6].labels == "mit"


def test_katz_is_normalised_and_base_is_exact(spark):
    from tenderlens.llm import katz

    rnd = random.Random(3)
    rows = [(i, " ".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(0, 30)))) for i in range(60)]
    out = {r.doc_id: r for r in katz.katz_scores(docs(spark, rows + [(100, None)])).collect()}
    train = [t.split() + [None] for i, t in rows + [(100, "")] if zlib.crc32(str(i).encode()) % 10]
    count = {}
    for x in train:
        for w in x:
            count[w] = count.get(w, 0) + 1
    n, v = sum(count.values()), len(count)
    for i, t in rows:
        want = sum(np.log10((count.get(w, 0) + 0.1) / (n + 0.1 * (v + 1))) for w in t.split() + [None])
        assert out[i].base_score == pytest.approx(want) and out[i].train_tokens == n and out[i].score < 0
    # a history's probabilities over all words and the unknown sum to one
    f = katz.frequencies(np.array(list(count.values())))
    uni = katz.Unigrams(f)
    assert uni.p(np.array([*count.values(), 0])).sum() == pytest.approx(1)
    words = list(count)
    for seen in ({words[0]: 1, words[1]: 2, words[2]: 9}, {words[3]: 50}, {words[0]: 1}):
        c = np.array(list(seen.values()))
        counts = np.bincount(c[c <= katz.K], minlength=katz.K + 1)[None, 1:]
        mass = uni.p(np.array([count[w] for w in seen])).sum()
        d = np.array([1, 0.5, 0.7, 0.8, 0.9, 0.95])
        scale, alpha = katz.weights(np.array([c.sum()]), counts, np.array([mass]), d)
        alpha = np.abs(alpha)
        total = sum(d[0 if k > katz.K else k] * k * scale[0] for k in c) + alpha[0] * uni.p(np.array([count[w] for w in words if w not in seen] + [0])).sum()
        assert total == pytest.approx(1)


def test_katz_scores_brute_force(spark, monkeypatch):
    from collections import Counter

    from tenderlens.llm import katz

    monkeypatch.setattr(katz, "BUCKET_TOKENS", 100_000)  # several owners
    rnd = random.Random(8)
    words = [chr(97 + i) * (1 + i % 3) for i in range(20)]
    texts = [" ".join(rnd.choice(words[: rnd.choice([3, 20])]) for _ in range(rnd.randint(0, 40))) for _ in range(150)] + [None, "", "never Seen"]
    rows = list(enumerate(texts)) + [(7, "a a a"), (None, "b b c")]
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 10 == 0
    tokens = [(i, [*(t or "").lower().split(), None]) for i, t in rows]
    uni, bi = Counter(), Counter()
    for i, x in tokens:
        if not held(i):
            uni.update(x)
            bi.update(zip(["<s>", *x], x))
    freq = lambda c: np.array([len(c), sum(c.values()), *[sum(v == r for v in c.values()) for r in range(1, katz.K + 2)]])
    model, d = katz.Unigrams(freq(uni)), katz.discounts(freq(bi))
    p1 = lambda w: float(model.p(np.array([uni[w]]))[0])

    def p2(h, w):
        after = {x: c for (a, x), c in bi.items() if a == h}
        if not after:
            return p1(w)
        n = sum(after.values())
        kept = sum(c * (d[c] if c <= katz.K else 1) for c in after.values())
        more = 1 - kept / n <= 1e-12
        left = 1 / (n + 1) if more else 1 - kept / n
        c = after.get(w, 0)
        return c * (d[c] if c <= katz.K else 1) / (n + more) if c else left / (1 - sum(map(p1, after))) * p1(w)

    want = sorted((i if i is not None else -1, held(i), len(x), sum(uni[w] > 0 for w in x), sum(np.log10(p2(h, w)) for h, w in zip(["<s>", *x], x))) for i, x in tokens)
    got = katz.katz_scores(docs(spark, rows).repartition(5)).collect()
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.held_out, r.n_tokens, r.n_known, r.score) for r in got)
    assert [r[:4] for r in got] == [r[:4] for r in want]
    assert [r[4] for r in got] == pytest.approx([r[4] for r in want])


def test_sharding_is_even_and_gapless(spark):
    from tenderlens.llm.sharding import kd_shards

    rnd = random.Random(1)
    rows = [(i, "x" * rnd.randint(0, 300)) for i in range(1500)] + [(2000 + i, "copy" * 40) for i in range(700)] + ODD[:5]
    got = kd_shards(docs(spark, rows), 8).collect()
    assert len(got) == len(rows)
    size = {}
    for r in got:
        size.setdefault(r.shard, [0, set()])
        size[r.shard][0] += r["size"]
        size[r.shard][1].add(r.slot)
    mean = sum(s for s, _ in size.values()) / 8
    assert len(size) == 8 and all(abs(s - mean) < 0.02 * mean + 400 for s, _ in size.values())
    assert all(slots == set(range(len(slots))) for _, slots in size.values())


def test_toxicity_learns(spark):
    from tenderlens.llm.common import alnum_words
    from tenderlens.llm.toxicity import Features, Scorer, keep_clean, shift_of, train

    rnd = random.Random(1)
    names = ["".join(rnd.choice("aeioubcd") for _ in range(5)) for _ in range(200)]
    word = lambda: rnd.choice(names)

    def make(y):
        w = [word() for _ in range(rnd.randint(20, 60))]
        if y:
            for _ in range(6):
                w[rnd.randrange(len(w))] = "zzk" + word()[:3]
        return " ".join(w), y

    rows = [make(i % 2) for i in range(700)]
    words = sorted({w for t, _ in rows[:400] for w in alnum_words(t)})
    index = {w: i for i, w in enumerate(words, 1)}
    places = [np.array([index[w] for w in alnum_words(t)], np.int32) for t, _ in rows[:400]]
    net = train(places, np.array([y for _, y in rows[:400]]), Features([b" ", *words]), 8, decay=0.7)
    best = Scorer(net).scores([alnum_words(t) for t, _ in rows[400:550]])
    net.shift = shift_of(best, np.array([y for _, y in rows[400:550]]))
    score = Scorer(net).scores([alnum_words(t) for t, _ in rows[550:]]) + net.shift
    assert np.mean((score >= np.log(0.3 / 0.7)) == np.array([y for _, y in rows[550:]], bool)) > 0.9
    kept = keep_clean(docs(spark, ODD), net)
    assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars"] and {r.doc_id for r in kept.collect()} >= {1, 2}


def test_toxicity_calibrates_on_whole_texts(spark):
    from tenderlens.llm.toxicity import fit, toxicity

    rnd = random.Random(3)
    names = ["".join(rnd.choice("aeioubcd") for _ in range(5)) for _ in range(60)]
    ids = [r.id for r in spark.range(360).orderBy(F.xxhash64("id")).collect()]
    rows, toxic = [], {}
    for i, k in enumerate(ids):  # every fourth is for calibration: there the toxic words come after 42,000 characters
        toxic[k] = int(rnd.random() < 0.65)
        text = " ".join(rnd.choice(names) for _ in range(40))
        text = " ".join([text] * (180 if toxic[k] and i % 4 == 0 else 1))
        rows.append((k, text + " zzkaei zzkbou zzkcad zzkide" * 3 * toxic[k]))
    table = docs(spark, rows)
    net = fit(table, spark.createDataFrame(list(toxic.items()), "doc_id long, toxic int"))
    got = {r.doc_id: int(r.score >= 0.3) for r in toxicity(table, net).collect()}
    assert sum(got[k] == toxic[k] for k in ids) > 0.9 * len(ids)


def test_packing_round_trip(spark):
    P = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    from tenderlens.llm.packing import pack

    rows = ODD + [(10 + i, "L'Œuvre's I'LL 12 ½ 日本 it's x " * i) for i in range(40)]
    path = P.path("word_bpe_49k.json")
    got = pack(docs(spark, rows), path, 256).collect()
    t = Tokenizer.from_file(path)
    want = sorted(zlib.crc32(np.array(ids[s : s + 256], "<u4").tobytes()) for _, x in rows for ids in [t.encode(x or "", add_special_tokens=False).ids + [0]] for s in range(0, len(ids), 256))
    assert sorted(r.ids_crc32 for r in got) == want
    bins = {}
    for r in got:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= 256
    assert len(bins) <= sum(r.length for r in got) / 256 * 1.2 + 1


def test_html(spark):
    from tenderlens.llm.html_extract import extract, main_text

    page = "<html><head><title>t</title></head><body><nav><ul><li><a href=x>Menu</a></ul></nav><article><h1>A &amp; B</h1><p>Some  long\n paragraph <b>of text<p>Short.</article><div class='comments'><p>me too, a long reader comment here</div><footer>f</footer>"
    assert main_text(page) == "A & B\nSome long paragraph of text\nShort."
    df = spark.createDataFrame([(1, "u", page), (2, None, None), (3, "v", ""), (3, "v", "plain")], "page_id long, url string, html string")
    assert sorted((r.page_id, r.text) for r in extract(df).collect()) == [(1, main_text(page)), (2, ""), (3, ""), (3, "plain")]
    assert extract(df.limit(0)).count() == 0


def test_html_without_article_or_main():
    from tenderlens.llm.html_extract import main_text

    lead = "A lead paragraph of some length stands beside the inner body of the page."
    body = [f"Paragraph number {k} goes on for a good while so that the inner body holds nearly all of the text." for k in range(12)]
    inner = "".join(f"<p>{t}</p>" for t in body)
    menu = "<div class='menu'><ul><li><a href=x>Menu</a></ul></div>"
    page = f"<html><body>{menu}<div><h1>Title</h1><p>{lead}</p><div>{inner}</div></div><div class='sidebar'><p>{lead}</p></div></body></html>"
    assert main_text(page) == "\n".join(["Title", lead, *body])
    links = "".join(f"<p><a href=x><b><i>l{k}</i></b></a></p>" for k in range(6))
    apart = f"<html><body><div>{links}</div><div><h1><a href=x><b>Title</b></a></h1></div><div>{inner}</div><div>{links}</div></body></html>"
    assert main_text(apart) == "\n".join(["Title", *body])


def test_caps_recall_and_precision(spark):
    from tenderlens.llm.caps import near_vectors

    rng = np.random.default_rng(4)
    x = rng.standard_normal((300, 64))
    y = x[:120] + 0.3 * np.linalg.norm(x[:120], axis=1, keepdims=True) * rng.standard_normal((120, 64)) / 8
    m = np.concatenate([x, y, x[:5]]).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(m)] + [(1000, None), (1001, [0.0] * 64), (1002, [float("nan")] * 64)]
    got = {r.vec_id: r for r in near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()}
    u = m.astype(float) / np.linalg.norm(m.astype(float), axis=1, keepdims=True)
    want = (u @ u.T >= 0.95).sum(1) - 1
    found = np.array([got[i].n_links for i in range(len(m))])
    assert (found <= want).all() and found.sum() >= 0.9 * want.sum()
    assert all(got[i].n_links == 0 and got[i].kept for i in (1000, 1001, 1002))


def test_line_dedup_brute_force(spark):
    from tenderlens.llm.line_dedup import dedup_lines

    a = "the quick brown fox jumps over the lazy dog again"
    rows = [(1, f"{a}\nunique line of words number one"), (2, f"{a}\nshort"), (3, a.replace("quick", "quack") + "\nother words stand in this line"), (4, a.replace("lazy", "very idle") + "\nx"), (5, None), (6, ""), (6, "")]
    got = {(r.doc_id, r.n_lines): r for r in dedup_lines(docs(spark, rows)).collect()}
    assert got[1, 2].text == rows[0][1] and got[2, 2].text == "short" and got[3, 2].text == "other words stand in this line"
    assert got[4, 2].text == rows[3][1] and got[5, 0].text is None and got[6, 1].text == ""


def test_line_dedup_of_short_lines_and_lines_without_blanks(spark):
    from tenderlens.llm.line_dedup import dedup_lines

    han = "".join(chr(0x4E00 + 7 * k) for k in range(40))
    rows = [(1, f"Yes.\n\n{han}\nunlike"), (2, f"Yes.\n\nNo.\n{han}"), (3, f"No.\n  Yes. \n{han[:20]}{han[21:]}\nYas."), (4, "Yes.\nYes.")]
    got = {r.doc_id: (r.text, r.n_removed) for r in dedup_lines(docs(spark, rows)).collect()}
    assert got == {1: (rows[0][1], 0), 2: ("\nNo.", 2), 3: ("Yas.", 3), 4: ("", 2)}


def edits(a, b):
    p = list(range(len(b) + 1))
    for i, x in enumerate(a):
        q = [i + 1]
        for j, y in enumerate(b):
            q.append(min(p[j] + (x != y), p[j + 1] + 1, q[j] + 1))
        p = q
    return p[-1]


def test_line_dedup_equals_all_pairs_on_random_lines(spark, monkeypatch):
    from tenderlens.llm import line_dedup

    monkeypatch.setattr(line_dedup, "HOT", 5)
    rnd = random.Random(12)
    bases = ["".join(rnd.choice("abc déx") for _ in range(rnd.randint(6, 30))).strip() or "x" for _ in range(60)]
    lines = []
    for _ in range(300):
        x = list(rnd.choice(bases))
        for _ in range(rnd.randint(0, 4)):
            at = rnd.randrange(len(x) + 1)
            x[at : at + rnd.randint(0, 1)] = rnd.choice([[], ["q"], ["é"]])
        lines.append("".join(x) + rnd.choice(["", " ", "\t", "\r"]))
    rows = [(k, "\n".join(lines[k * 6 : k * 6 + 6])) for k in range(50)]
    seen, keep = [], {}
    places = [(k, at, line.strip()) for k, t in rows for at, line in enumerate(t.split("\n"))]
    distinct = list(dict.fromkeys(x for _, _, x in places if x))
    root = {x: x for x in distinct}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, x in enumerate(distinct):
        for y in distinct[:i]:
            if len(x) >= 9 and len(y) >= 9 and edits(x, y) <= 2:
                root[find(x)] = find(y)
    for k, at, x in places:
        if not x or find(x) not in seen:
            keep.setdefault(k, []).append(at)
            seen += [find(x)] if x else []
    want = {k: "\n".join(t.split("\n")[i] for i in keep.get(k, [])) for k, t in rows}
    clash = docs(spark, rows).withColumns({c: F.lit(c) for c in ("gone", "n_lines", "n_removed", "pos", "line", "_doc", "h1")})
    got = line_dedup.dedup_lines(clash).collect()
    assert {r.doc_id: r.text for r in got} == want and all(r.gone == "gone" and r.n_lines == 6 for r in got)


def test_banded_distance(spark):
    from tenderlens.llm.line_dedup import banded_distance

    rnd = random.Random(4)

    pairs = []
    while len(pairs) < 300:
        a = "".join(rnd.choice("abé") for _ in range(rnd.randint(5, 14)))
        b = "".join(rnd.choice("abé") if rnd.random() < 0.2 else c for c in a)[: rnd.randint(4, 14)]
        if 2 < len(b) <= len(a) <= len(b) + 2:
            pairs.append((a, b))
    for r in spark.createDataFrame(pairs, "a string, b string").withColumn("d", banded_distance(F.split("a", ""), F.split("b", ""), 2)).collect():
        assert min(r.d, 3) == min(edits(r.a, r.b), 3)


def test_gru_forward_and_gradient():
    """The net's logits against a word-by-word loop, and its gradients against differences."""
    from tenderlens.llm.toxicity import HIDDEN, Features, Net

    f = Features([b" ", b"one", b"two", b"three", b"fourth"])
    net = Net(5)
    rng = np.random.default_rng(0)
    net.p = {k: (v.astype(np.float64) if v.size > 5000 else rng.standard_normal(v.shape) * 0.4) for k, v in net.p.items()}
    at, y = rng.integers(0, 5, (6, 3)), np.array([1.0, 0.0, 1.0])

    def logits():
        x, p, out = net.inputs(f).astype(float), net.p, []
        sig = lambda v: 1 / (1 + np.exp(-v))
        for j in range(3):
            states = []
            for w, u, b, order in (("wf", "uf", "bf", range(6)), ("wb", "ub", "bb", range(5, -1, -1))):
                h, hs = np.zeros(HIDDEN), [None] * 6
                for i in order:
                    g = x[at[i, j]] @ p[w] + p[b]
                    zr = sig(g[: 2 * HIDDEN] + h @ p[u][:, : 2 * HIDDEN])
                    z, r = zr[:HIDDEN], zr[HIDDEN:]
                    h = (1 - z) * h + z * np.tanh(g[2 * HIDDEN :] + (r * h) @ p[u][:, 2 * HIDDEN :])
                    hs[i] = h
                states.append(np.array(hs))
            hidden = np.concatenate(states, 1)
            a = np.exp(hidden @ p["att"])
            out.append((a / a.sum()) @ (hidden @ p["out"]) + p["bias"][0])
        return np.array(out)

    loss = lambda: np.mean(np.log1p(np.exp(logits())) - y * logits())
    x = net.inputs(f)
    assert net.run((x @ net.p["wf"] + net.p["bf"])[at], (x @ net.p["wb"] + net.p["bb"])[at]) == pytest.approx(logits(), abs=1e-5)
    before = {k: v.copy() for k, v in net.p.items()}
    adam = {"t": 0}
    net.learn(f, at, y, adam, 0.0)
    for k in ("wf", "uf", "bf", "wb", "ub", "bb", "att", "out", "bias", "word", "char"):
        grad = adam[k][0] / 0.1  # the first step's mean is a tenth of the gradient
        i = np.unravel_index(np.abs(grad).argmax(), grad.shape)
        net.p[k] = before[k].copy()
        net.p[k][i] += 1e-4
        up = loss()
        net.p[k][i] -= 2e-4
        assert (up - loss()) / 2e-4 == pytest.approx(grad[i], rel=1e-2, abs=1e-6), k
        net.p[k] = before[k]


def test_word_encoder_equals_the_tokenizer_in_any_order():
    import public_tokenizers
    from tokenizers import Tokenizer

    from tenderlens.llm.packing import WordEncoder

    path = public_tokenizers.path("word_bpe_49k.json")
    full, rnd = Tokenizer.from_file(path), random.Random(6)
    bits = [")", ".", ",", "!", "-", "--", '"', "'s", "'", "word", "Word", "é", "e\u0301", "İ", "ŉ", "1", "23", "\u4e2d", "😀", "\x00", "\x1f", "\u00a0", "\u200d", "ß", "ſ", "<|", "|>", "<|endoftext|>", "<|ENDOFTEXT|>", "\t", "\n", " ", " ", " "]
    texts = [")", "--", "....", ").", "--,", "!.", "word.", "word,,", *("".join(rnd.choice(bits) for _ in range(rnd.randint(1, 12))) for _ in range(1500))]
    encoder = WordEncoder(path)
    for order in (texts, texts[::-1]):
        for t in order:
            assert np.frombuffer(encoder.encode(t), "<u4").tolist() == full.encode(t, add_special_tokens=False).ids, repr(t)


def test_items_without_an_id_hit_but_are_not_named():
    from tenderlens.llm.decontam import Phrases, search_shard

    phrases = Phrases([(None, "a b c"), (2, "b c d"), (2, "b c d"), (10, "a b c")], 3)
    (row,) = search_shard([(1, b"x a b c d".split())], phrases)
    assert row == (1, 5, ["10", "2"], [1], [5])


@pytest.mark.parametrize("dim", [1, 2, 3, 5, 20])
def test_vectors_against_all_pairs(spark, dim):
    from tenderlens.llm.caps import near_vectors

    rng = np.random.default_rng(dim)
    centres = rng.standard_normal((60, dim))
    x = centres[rng.integers(0, 60, 400)] + rng.standard_normal((400, dim)) * 0.08
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(400, x[0].tolist()), (401, None), (402, [0.0] * dim), (403, [float("nan")] * dim), (404, [])]
    unit = np.vstack([x, x[:1]])
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    hit = unit @ unit.T >= 0.95
    np.fill_diagonal(hit, False)
    label = np.arange(401)
    while True:
        new = np.minimum(label, np.where(hit, label[None, :], 401).min(1))
        if (new == label).all():
            break
        label = new
    got = {r.vec_id: r for r in near_vectors(spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, rep string")).collect()}
    links = np.array([got[i].n_links for i in range(401)])
    if dim < 16:
        assert (links == hit.sum(1)).all() and all(got[i].component_id == label[i] and got[i].kept == (label[i] == i) for i in range(401))
    else:
        assert (links <= hit.sum(1)).all() and links.sum() >= 0.9 * hit.sum()
    assert all(got[i].n_links == 0 and got[i].component_id == i for i in range(401, 405))


def test_equal_texts_share_a_shard(spark):
    from tenderlens.llm.sharding import kd_shards

    rnd = random.Random(4)
    rows = [(i, f"text number {i % 400} " * rnd.choice([3]), rnd.choice(["en", "de", None]), f"s{rnd.randint(0, 9)}", 0) for i in range(1200)]
    where = {}
    for r in kd_shards(spark.createDataFrame(rows, DOCS), 6, 0.05).collect():
        where.setdefault(rows[r.doc_id][1], set()).add(r.shard)
    assert all(len(x) == 1 for x in where.values())


def test_license_notice_over_lines_and_far_words(spark):
    from tenderlens.llm.license_scan import scan

    notice = "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided"
    far = "released " + "x " * 30 + "under " + "y " * 30 + "the mit " + "z " * 30 + "license"
    got = {r.doc_id: r for r in scan(docs(spark, [(1, "intro\n" + notice), (2, far), (3, "released under the\n mit thing")])).collect()}
    assert got[1].labels == "bsd" and got[1].score == 1.0 and got[2].labels == "" and got[2].score == 0 and (got[3].labels, got[3].score) == ("mit", 0.8)


def test_page_parts(spark):
    import time

    from tenderlens.llm.html_extract import extract, main_text

    body = "The first paragraph of the article has a good many words in it. " * 3
    page = f'<body><nav>Home</nav><article class="post related share"><h1>Title</h1><p>{body}</p><section id="comments-on-law"><p>{body}</p></section><section class="comments"><p>Nice!</p></section><footer>Posted by X</footer></article><div class="sidebar">Links</div></body>'
    one = " ".join(body.split())
    assert main_text(page) == f"Title\n{one}\n{one}"
    assert main_text(f"<div><h1>T</h1><p>Lead {body}</p><div><p>{body}</p><p>{body}</p></div></div><p>x</p>").startswith("T\nLead")
    start = time.time()
    assert main_text("<div>" * 20000 + "deep text</i></span></div>" * 20000).startswith("deep text")
    assert time.time() - start < 20
    table = spark.createDataFrame([(1, "u", None), (2, None, ""), (3, "u", page), (3, "u", page), (4, "u", "<<<>&amp")], "page_id long, url string, html string")
    assert sorted((r.page_id, len(r.text)) for r in extract(table.withColumn("text", F.lit(1))).collect())[:2] == [(1, 0), (2, 0)]


def test_extra_columns_with_clashing_names(spark):
    from tenderlens.llm import decontam, jaccard, katz, license_scan, packing, sharding, toxicity

    import public_tokenizers

    rows = docs(spark, ODD)
    clash = rows.withColumns({c: F.lit("z") for c in ("n", "h", "a", "b", "block", "bucket", "row", "size", "own", "tie", "score", "spans", "items", "region", "component_id", "labels", "length", "rank")})
    bench = spark.createDataFrame([(1, "one two three")], "item_id long, text string").withColumn("n", F.lit(1))
    net = toxicity.train([], np.zeros(0, int), None)
    path = public_tokenizers.path("word_bpe_49k.json")
    runs = {
        "op1": lambda d: decontam.contamination(d, bench), "op2": jaccard.near_documents, "op3": license_scan.scan, "op4": katz.katz_scores, "op5": lambda d: sharding.kd_shards(d, 3).drop("slot", "shard"),
        "op6": lambda d: toxicity.toxicity(d, net), "op7": lambda d: packing.pack(d, path).drop("sequence_id", "offset"),
    }
    for name, run in runs.items():
        assert sorted(map(str, run(clash).collect())) == sorted(map(str, run(rows).collect())), name


def test_empty_tables(spark):
    import public_tokenizers

    from tenderlens.llm import caps, decontam, html_extract, jaccard, katz, license_scan, line_dedup, packing, sharding, toxicity

    none = spark.createDataFrame([], DOCS)
    bench = spark.createDataFrame([], "item_id long, text string")
    assert decontam.contamination(none, bench).count() == 0
    assert jaccard.near_documents(none).count() == 0
    assert license_scan.scan(none).count() == 0
    assert line_dedup.dedup_lines(none).count() == 0
    assert sharding.kd_shards(none).count() == 0
    assert katz.katz_scores(none).count() == 0
    assert toxicity.toxicity(none, toxicity.fit(none, spark.createDataFrame([], "doc_id long, quality int, toxic int"))).count() == 0
    assert packing.pack(none, public_tokenizers.path("word_bpe_49k.json")).count() == 0
    assert html_extract.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
    assert caps.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<double>")).count() == 0


def test_components_in_rounds_and_finished_by_one_task(spark):
    import random

    from tenderlens.llm.common import Scratch, components, forest

    rng = random.Random(5)
    pairs = [(k, k + 1) for k in range(40)] + [(rng.randrange(100, 400), rng.randrange(100, 400)) for _ in range(150)] + [(7, 7), (None, 3), (-5, 2**40), (2**40, -5)]
    nodes = sorted({x for a, b in pairs if a != b and None not in (a, b) for x in (a, b)})
    at = {x: i for i, x in enumerate(nodes)}
    real = [(at[a], at[b]) for a, b in pairs if a in at and b in at and a != b]
    root = forest(len(nodes), np.array([a for a, _ in real]), np.array([b for _, b in real]))
    want = [(x, nodes[root[i]]) for i, x in enumerate(nodes)]
    edges = spark.createDataFrame(pairs, "a long, b long")
    for finish in (0, 5, 10**6):
        got = components(edges, Scratch(spark), finish)
        assert sorted(map(tuple, got.collect())) == want
        assert components(edges.limit(0), Scratch(spark), finish).collect() == []
