"""License scans: exact phrases, and an exact containment join of text blocks against license templates.

A block is a run of words of the text, across line breaks, a quarter longer than the template it is held against; it bears the
template's label when it holds at least ``threshold`` of the template's tokens. Tokens are ordered by the number of documents
that hold them, counted over all documents first. A template is probed through its prefix (its rarest tokens, so many that a
block without any of them cannot reach the threshold); the length filter drops texts that hold too few of its tokens at all,
and the positional filter, over the places of the template's tokens alone, leaves those within a block's length of one
another. The templates are a fixed list, so what is broadcast has a fixed size.

Edge cases: null and empty texts have no words, places or labels (null first and last word, empty strings, score 0);
repeated rows are reported each; very long texts are scanned whole; an empty table gives no rows; extra columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import alnum_words, batch_of, ship

#: Phrases and their labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
#: Notices that license texts give for use in a work, and their labels.
TEMPLATES = {
    "this work is licensed under the gnu general public license version 3": "gpl-3.0",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license": "gpl",
    "licensed under the apache license version 2 0": "apache-2.0",
    "released under the mit license": "mit",
    "permission is hereby granted free of charge to any person obtaining a copy of this software": "mit",
    "licensed under cc by nc 4 0": "cc-by-nc-4.0",
    "this work is licensed under a creative commons attribution 4 0 international license": "cc-by-4.0",
    "redistribution and use in source and binary forms with or without modification are permitted": "bsd",
    "this source code form is subject to the terms of the mozilla public license": "mpl",
    "all rights reserved": "all-rights-reserved",
}
THRESHOLD = 0.8


class Matcher:
    """The templates, with tokens in rising order of their document frequency."""

    def __init__(self, frequency: dict[bytes, int], threshold: float):
        self.templates = []
        for text, label in TEMPLATES.items():
            tokens = sorted(set(alnum_words(text)), key=lambda w: (frequency.get(w, 0), w))
            need = max(1, math.ceil(threshold * len(tokens) - 1e-9))
            self.templates.append((tokens, need, label))
        self.probe: dict[bytes, list[int]] = {}
        for i, (tokens, need, _) in enumerate(self.templates):
            for w in tokens[: len(tokens) - need + 1]:
                self.probe.setdefault(w, []).append(i)

    def blocks(self, words: list[bytes], held: set[bytes]) -> list[tuple[str, float]]:
        """(label, share) of each template that a block of the text holds enough of; the best share."""
        out = []
        for i in sorted({i for w in held & self.probe.keys() for i in self.probe[w]}):
            tokens, need, label = self.templates[i]
            if len(held.intersection(tokens)) < need:  # length filter
                continue
            code = {w: k for k, w in enumerate(tokens)}
            places = [(at, code[w]) for at, w in enumerate(words) if w in code]
            size, count, found, best, first = block_size(i), [0] * len(tokens), 0, 0, 0
            for at, k in places:
                found += not count[k]
                count[k] += 1
                while places[first][0] <= at - size:  # positional filter: too far before to share a block
                    count[places[first][1]] -= 1
                    found -= not count[places[first][1]]
                    first += 1
                best = max(best, found)
            if best >= need:
                out.append((label, best / len(tokens)))
        return out


def block_size(template: int) -> int:
    n = len(alnum_words(list(TEMPLATES)[template]))
    return n + n // 4


SEQUENCES = [(tuple(p.encode().split()), label) for p, label in PHRASES.items()]


def base_places(words: list[bytes], held: set[bytes]) -> tuple[list[int], set[str]]:
    places, labels = [], set()
    for seq, label in SEQUENCES:
        if held.issuperset(seq):
            i = -1
            try:
                while True:
                    i = words.index(seq[0], i + 1)
                    if tuple(words[i : i + len(seq)]) == seq:
                        places.append(i)
                        labels.add(label)
            except ValueError:
                pass
    return places, labels


SCAN = pa.schema(
    [("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()),
     ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64())]
)


def _scan(batches, matcher: Matcher):
    probes = matcher.probe.keys()
    for b in batches:
        out = []
        for doc_id, text in zip(b.column(0).to_pylist(), b.column(1)):
            text = text.as_py() or ""
            words = alnum_words(text)
            held = set(words)
            places, base = base_places(words, held)
            labels, score = set(base), 1.0 if base else 0.0
            if not probes.isdisjoint(held):
                for label, share in matcher.blocks(words, held):
                    labels.add(label)
                    score = max(score, share)
            out.append((doc_id, len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), score))
        if out:
            yield batch_of(SCAN, list(zip(*out)))


def _count(batches, vocabulary: frozenset):
    from collections import Counter

    n: Counter = Counter()
    for b in batches:
        for text in b.column(1):
            n.update(vocabulary.intersection(alnum_words(text.as_py())))
    if n:
        yield batch_of(pa.schema([("token", pa.binary()), ("n", pa.int64())]), [list(n), list(n.values())])


def scan(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of ``docs(doc_id, text)``: word count, exact phrase places, labels, best share of a template held."""
    ship(docs.sparkSession)
    docs = docs.select("doc_id", "text")
    vocabulary = frozenset(w for t in TEMPLATES for w in alnum_words(t))
    counts = docs.mapInArrow(lambda it: _count(it, vocabulary), "token binary, n long").groupBy("token").agg(F.sum("n").alias("n"))
    matcher = Matcher({bytes(r["token"]): r["n"] for r in counts.collect()}, threshold)  # at most the templates' tokens
    return docs.mapInArrow(
        lambda it: _scan(it, matcher), "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"
    )


def oracle() -> str:
    """The same rows in DuckDB SQL, by plain counting."""
    lower = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    words = r"regexp_extract_all({}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    phrase = " UNION ALL ".join(f"SELECT {p.split()!r} AS p, '{label}' AS label" for p, label in PHRASES.items())
    template = " UNION ALL ".join(f"SELECT {i} AS i, list_distinct({t.split()!r}) AS t, '{label}' AS label, {block_size(i)} AS size" for i, (t, label) in enumerate(TEMPLATES.items()))
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {lower} AS s FROM documents),
w AS (SELECT r, doc_id, s, {words.format('s')} AS words FROM d),
phrases AS ({phrase}), templates AS ({template}),
hits AS (SELECT r, label, unnest(list_filter(range(len(words)), lambda i: words[i + 1 : i + len(p)] = p)) AS pos FROM w, phrases),
base AS (SELECT r, count(*) AS n, min(pos) AS first_word, max(pos) AS last_word FROM hits GROUP BY r),
able AS (SELECT r, i, t, label, size, words FROM w, templates WHERE len(list_intersect(t, words)) >= ceil({THRESHOLD} * len(t) - 1e-9)),
held AS (SELECT r, i, t, label, size, words[pos + 1] AS word, pos FROM (SELECT *, unnest(list_filter(range(len(words)), lambda k: list_contains(t, words[k + 1]))) AS pos FROM able)),
blocks AS (SELECT r, label, count(DISTINCT b.word) / len(t) AS share FROM held JOIN held b USING (r, i, t, label, size) WHERE b.pos >= held.pos AND b.pos < held.pos + size GROUP BY r, i, t, label, held.pos),
method AS (SELECT r, label, share FROM blocks WHERE share >= {THRESHOLD} - 1e-9),
labels AS (SELECT r, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT r, label FROM hits UNION ALL SELECT r, label FROM method) GROUP BY r),
basel AS (SELECT r, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM hits GROUP BY r),
best AS (SELECT r, max(share) AS share FROM method GROUP BY r)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_base, CAST(first_word AS BIGINT) AS first_word,
  CAST(last_word AS BIGINT) AS last_word, coalesce(basel.labels, '') AS base_labels, coalesce(labels.labels, '') AS labels,
  CAST(CASE WHEN n > 0 THEN 1.0 ELSE coalesce(share, 0) END AS DOUBLE) AS score
FROM w LEFT JOIN base USING (r) LEFT JOIN basel USING (r) LEFT JOIN labels USING (r) LEFT JOIN best USING (r)
"""
