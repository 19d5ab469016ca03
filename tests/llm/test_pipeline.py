"""The pipeline's stages on a small folder, each against a plain version of its rule on its own input."""

import random

import numpy as np
import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def folder(spark, path, rows, labels, items):
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], DOCS).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path)


def shingles(t):
    w = (t or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) > 4 else ({tuple(w)} if w else set())


def test_stages_against_plain_versions(spark, tmp_path):
    import corpus_pipeline
    import public_tokenizers
    from tokenizers import Tokenizer

    rnd = random.Random(9)
    names = ["".join(rnd.choice("aeioubcdlmnr") for _ in range(6)) for _ in range(900)]
    line = lambda n: " ".join(rnd.choice(names) for _ in range(n))
    rows, labels = [], []
    for i in range(240):
        text = "\n".join(line(rnd.randint(8, 25)) for _ in range(4))
        toxic = int(i % 6 == 0)
        if toxic:
            text += "\n" + " ".join("zzk" + rnd.choice(names)[:4] for _ in range(25))
        rows.append((i, text))
        labels.append((i, 1, toxic))
    passage = line(40)
    for i in range(240, 250):  # near copies in one line, whose lines are too far apart for the line stage
        w = rows[1][1].split()
        w[rnd.randrange(len(w))] = "changed" + names[i]
        w[rnd.randrange(len(w))] = "altered" + names[i]
        rows.append((i, " ".join(w)))
    rows += [(300, passage + " " + line(30)), (301, None), (302, ""), (303, "Yes."), (304, "Yes."), (305, rows[2][1]), (None, line(12)), (306, line(3000))]
    labels += [(1, None, None), (999, 1, 1)]
    sf = folder(spark, tmp_path, rows, labels, [(1, passage), (None, "short"), (2, None)])
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    steps = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, sf)
        out.write.parquet(f"{sf}/stage{k}")
        steps.append((docs.collect(), spark.read.parquet(f"{sf}/stage{k}").collect()))
        docs = spark.read.parquet(f"{sf}/stage{k}")
        if k < 4:
            assert docs.columns == DOCS.replace(" long", "").replace(" string", "").split(", ")
    ids = lambda found: {r.doc_id for r in found}
    # toxicity: marked documents go, clean ones and those without words stay as they are
    before, after = steps[0]
    toxic = {i for i, _, y in labels if y == 1 and i != 999}
    assert len(toxic - ids(after)) >= 0.9 * len(toxic) and len(ids(before) - ids(after) - toxic) <= 0.03 * len(rows) and {301, 302} <= ids(after)
    # lines: the first of equal lines stays (no two lines here are near each other without being equal)
    before, after = steps[1]
    seen, want = set(), {}
    for r in sorted(before, key=lambda r: (r.doc_id is not None, r.doc_id or 0)):
        kept = []
        for x in (r.text or "").split("\n"):
            if not x.strip() or x.strip() not in seen:
                kept.append(x)
                seen.add(x.strip())
        text = None if r.text is None else "\n".join(kept)
        if text == r.text or text.strip():
            want[r.doc_id] = text
    assert {r.doc_id: r.text for r in after} == want and all(r.n_chars == len(r.text or "") for r in after)
    # near duplicates: the least id of each group stays
    before, after = steps[2]
    sets = {r.doc_id: shingles(r.text) for r in before if r.doc_id is not None}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in sets:
        for j in sets:
            if j < i and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    assert ids(after) == {i for i in sets if find(i) == i} | {None} and len(before) - len(after) >= 9
    # benchmark: documents with a twentieth of their words in windows go
    before, after = steps[3]
    assert ids(before) - ids(after) == {300}
    # packing: every document's tokens, in sequences of 2048 at most, without gaps
    before, after = steps[4]
    full = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    length, bins = {}, {}
    for r in after:
        length[r.doc_id] = length.get(r.doc_id, 0) + r.length
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert length == {r.doc_id: len(full.encode(r.text or "", add_special_tokens=False).ids) + 1 for r in before}
    for places in bins.values():
        places.sort()
        assert places[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(places, places[1:])) and sum(places[-1]) <= 2048


@pytest.mark.parametrize("some", [False, True])
def test_run_on_empty_tables_and_rows_without_text(spark, tmp_path, some):
    import corpus_pipeline

    rows = [(1, None), (2, ""), (2, ""), (None, None)] if some else []
    sf = folder(spark, tmp_path, rows, [], [])
    got = corpus_pipeline.run(spark, sf).collect()
    assert len(got) == len(rows) and np.all([r.length == 1 for r in got])


def test_dropping_documents_moves_no_texts(spark, tmp_path, monkeypatch):
    import corpus_pipeline as pipeline

    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    texts = [" ".join(f"{w}{i}" for w in "abcdefghijklmnop") for i in range(8)]
    rows = [*enumerate(texts), (8, texts[0]), (9, texts[1]), (10, None), (None, texts[2])]
    sf = folder(spark, tmp_path, rows, [(1, 1, 0)], [(1, texts[3])])
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as where the ids that go are more than that
    try:
        for most in (pipeline.GONE, 0):  # 0: the ids are joined by a shuffle
            monkeypatch.setattr(pipeline, "GONE", most)
            for stage, gone in ((pipeline.near_duplicates, {8, 9}), (pipeline.decontamination, {3})):
                out = stage(spark, docs, sf)
                assert ("hashpartitioning" in plan(out)) == (not most)
                assert sorted(map(str, out.collect())) == sorted(str(r) for r in docs.collect() if r.doc_id not in gone)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "SortMergeJoin" in plan(pipeline.line_dedup(spark, docs, sf))
