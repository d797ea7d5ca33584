"""Licence scan through a positional rare-token index.

The index holds, for each licence template, its rarest words by inverse
document frequency over the scanned documents, with their positions in the
template. A document's words are looked up in it; postings whose relative
positions agree vote for one start of the template in the document. A start
with enough votes is verified: the template's mandatory key phrases must stand
there, and a short phrase must stand there word by word.

Scale: one pass counts, per template word, the documents that hold it (one
row per word and task leaves a task; the vocabulary is fixed by the
templates, so the counts that reach the driver are bounded by it). A second
pass looks every word of every whole text up in the index. No shuffle of
texts, no candidate cap.

Cases: NULL or empty text has no words, no label, NULL positions and score 0.
Repeated rows and NULL ids are returned as they are. An empty table gives no
rows. Only doc_id and text are read.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The base phrases and their labels.
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

#: Label, notice, mandatory key phrases (public licence notices).
NOTICES = [
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
            "documentation files", ["permission is hereby granted free of charge"]),
    ("apache-2", "you may not use this file except in compliance with the license you may obtain a copy of the license at",
     ["except in compliance with the license"]),
    ("gpl", "licensed under the gnu general public license version", ["gnu general public license"]),
    ("gpl", "under the terms of the gnu general public license as published by the free software foundation",
     ["gnu general public license", "free software foundation"]),
    ("lgpl", "under the terms of the gnu lesser general public license as published by the free software foundation",
     ["gnu lesser general public license"]),
    ("agpl", "under the terms of the gnu affero general public license as published by the free software foundation",
     ["gnu affero general public license"]),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that "
            "the following conditions are met", ["redistribution and use in source and binary forms"]),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0", ["mozilla public license"]),
    ("cc-by", "licensed under a creative commons attribution 4 0 international license", ["creative commons attribution"]),
    ("cc-by-sa", "licensed under a creative commons attribution sharealike 4 0 international license",
     ["creative commons attribution sharealike"]),
    ("cc0", "to the extent possible under law the author has dedicated all copyright and related rights to the public domain",
     ["to the public domain"]),
    ("unlicense", "this is free and unencumbered software released into the public domain",
     ["free and unencumbered software"]),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
     ["with or without fee is hereby granted"]),
]

# Word characters after lower-casing: digits, a-z and every byte of a non-ASCII character; the rest becomes a space.
_FOLD = bytes(c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in
              (x + 32 if 0x41 <= x <= 0x5A else x for x in range(256)))


def words_of(text: str | None) -> list[bytes]:
    """The text's words, lower-cased, in UTF-8."""
    return (text or "").encode().translate(_FOLD).split()


@dataclass(frozen=True)
class Template:
    label: str
    words: tuple[bytes, ...]
    keys: tuple[tuple[bytes, ...], ...]
    exact: bool  # a base phrase: every word must stand in its place


def templates() -> list[Template]:
    split = lambda x: tuple(words_of(x))
    return [Template(v, split(k), (split(k),), True) for k, v in BASE.items()] + \
           [Template(label, split(text), tuple(map(split, keys)), False) for label, text, keys in NOTICES]


def document_frequency(docs: DataFrame, vocabulary: frozenset[bytes]) -> tuple[dict[bytes, int], int]:
    """Documents that hold each vocabulary word, and documents in all."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, n = Counter(), 0
        for b in batches:
            for t in b.column(0):
                seen.update(vocabulary.intersection(words_of(t.as_py())))
            n += b.num_rows
        yield pa.RecordBatch.from_pydict({"word": [None, *(w.decode() for w in seen)], "n": [n, *seen.values()]},
                                         pa.schema([("word", pa.string()), ("n", pa.int64())]))
    counts = {r["word"]: r["n"] for r in docs.select("text").mapInArrow(run, "word string, n long")
              .groupBy("word").agg(F.sum("n").alias("n")).collect()}
    return {w.encode(): n for w, n in counts.items() if w is not None}, counts.get(None, 0)


class Index:
    """Postings of each template's ``rare`` highest-IDF words."""

    def __init__(self, all_templates: list[Template], frequency: dict[bytes, int], n_docs: int, rare: int = 4) -> None:
        self.templates = all_templates
        idf = lambda w: math.log((n_docs + 1) / (frequency.get(w, 0) + 1))
        self.postings: dict[bytes, list[tuple[int, int]]] = defaultdict(list)
        self.votes: list[int] = []
        for k, t in enumerate(all_templates):
            chosen = sorted(set(t.words), key=lambda w: (-idf(w), w))[:rare]
            places = [(w, i) for i, w in enumerate(t.words) if w in chosen]
            for w, i in places:
                self.postings[w].append((k, i))
            self.votes.append(len(places) if t.exact else max(2, len(places) // 2))
        self.postings = dict(self.postings)

    def matches(self, words: list[bytes]) -> list[tuple[int, int, float]]:
        """(template, start, share of the template's words in place) of every verified start."""
        votes: Counter = Counter()
        postings = self.postings
        for p, w in enumerate(words):
            if w in postings:
                for k, i in postings[w]:
                    votes[k, p - i] += 1
        found = []
        for (k, start), n in votes.items():
            t = self.templates[k]
            if n < self.votes[k] or t.exact and start < 0:
                continue
            size = len(t.words)
            if t.exact:
                if tuple(words[start:start + size]) == t.words:
                    found.append((k, start, 1.0))
                continue
            here = words[max(0, start):max(0, start + size)]
            if all(any(tuple(here[i:i + len(key)]) == key for i in range(len(here) - len(key) + 1)) for key in t.keys):
                same = sum(0 <= start + i < len(words) and words[start + i] == w for i, w in enumerate(t.words))
                found.append((k, start, same / size))
        return found


COLUMNS = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"


def scan(docs: DataFrame, rare: int = 4) -> DataFrame:
    """One row per document: doc_id and COLUMNS; score is the best verified match's share of words in place."""
    known = templates()
    frequency, n_docs = document_frequency(docs, frozenset(w for t in known for w in t.words))
    index = Index(known, frequency, n_docs, rare)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for t in b.column(1):
                words = words_of(t.as_py())
                found = index.matches(words)
                base = [(k, p) for k, p, _ in found if known[k].exact]
                joined = lambda ks: ",".join(sorted({known[k].label for k in ks}))
                rows.append({"n_words": len(words), "n_base": len(base),
                             "first_word": min((p for _, p in base), default=None),
                             "last_word": max((p for _, p in base), default=None),
                             "base_labels": joined(k for k, _ in base), "labels": joined(k for k, _, _ in found),
                             "score": max((s for _, _, s in found), default=0.0)})
            kinds = {"n_words": pa.int64(), "n_base": pa.int64(), "first_word": pa.int64(), "last_word": pa.int64(),
                     "base_labels": pa.string(), "labels": pa.string(), "score": pa.float64()}
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array([r[c] for r in rows], k) for c, k in kinds.items())],
                                             ["doc_id", *kinds])
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, {COLUMNS}")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, whole texts."""
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
