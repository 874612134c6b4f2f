"""Licence scan with a positional index of rare words.

The templates are short licence notices. Their words' document frequency is counted over all documents. Of every
template the words of the highest inverse document frequency are in an index of words and places, as many as it takes
that a place where SHARE of the template's words stand has AGREE of them at least; so which words are rare sets the
work, not the labels. A file's words are looked up there, the postings of one template are intersected by relative
position (file place less template place), and an alignment that AGREE rare words share is kept if SHARE of the
template's words and its key phrases stand there word for word. The score is
the best share of a template's words that the file has in their places; a base phrase alone scores a half.

Null and empty texts have no words, no labels and score 0. Repeated rows get a row each, rows without a doc_id too.
Texts of any length are looked up whole. Every place where a notice stands counts, and equal words in it are equally
rare; of words equally rare the first by its bytes is indexed first. An empty table gives no rows. Only doc_id and text
are read, whatever other columns are called.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from veritrail.llm.common import ALNUM_WORDS, in_small_batches, low_bytes, table

#: Phrases that give a label wherever their words stand in a row.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: Label, notice, key phrases that must stand in it.
TEMPLATES = [
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software", ["permission is hereby granted free of charge", "sublicense and or sell"]),
    ("apache", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at", ["apache license version 2 0"]),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", ["gnu general public license"]),
    ("gpl", "this work is licensed under the gnu general public license version 3", ["gnu general public license version"]),
    ("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation", ["gnu lesser general public license"]),
    ("agpl", "you should have received a copy of the gnu affero general public license along with this program", ["gnu affero general public license"]),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ["redistribution and use in source and binary forms"]),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies", ["with or without fee is hereby granted"]),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0", ["mozilla public license"]),
    ("unlicense", "this is free and unencumbered software released into the public domain", ["unencumbered software released into the public domain"]),
    ("cc", "this work is licensed under a creative commons attribution 4 0 international license", ["creative commons attribution"]),
    ("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work", ["waived all copyright and related or neighboring rights"]),
    ("mit", "released under the mit license", ["the mit license"]),
    ("apache", "distributed under the apache license version 2 0", ["the apache license"]),
]
#: Rare words that must agree on a place, share of a template's words that must stand there.
AGREE, SHARE = 2, 0.7
FOUND = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"


def _places(words: list[bytes], at: dict[bytes, list[int]], phrase: list[bytes]) -> list[int]:
    return [i for i in at.get(phrase[0], ()) if words[i : i + len(phrase)] == phrase]


def indexed(text: list[bytes], rarity: dict[bytes, float], agree: int, share: float) -> set[bytes]:
    """The rarest words of a template that hold enough of its places: of any share of its places, agree are theirs."""
    need = next(n for n in range(len(text) + 1) if n / len(text) >= share)
    out: set[bytes] = set()
    held = 0
    for w in sorted(set(text), key=lambda w: (-rarity[w], w)):
        if held >= len(text) - need + agree:
            break
        out.add(w)
        held += text.count(w)
    return out


def document_frequency(docs: DataFrame, words: frozenset[bytes]) -> DataFrame:
    """(word, docs) over all documents, of the given words, which are few and fixed."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: Counter = Counter()
        for batch in batches:
            for text in batch["text"]:
                seen.update(words.intersection(ALNUM_WORDS.findall(low_bytes(text))))
        yield pd.DataFrame({"word": pd.Series([x.decode() for x in seen], dtype=object), "docs": pd.Series(list(seen.values()), dtype="int64")})

    return in_small_batches(docs).select(F.col("text").cast("string").alias("text")).mapInPandas(run, "word string, docs long").groupBy("word").agg(F.sum("docs").alias("docs"))


def scan(docs: DataFrame, templates: list = TEMPLATES, agree: int = AGREE, share: float = SHARE) -> DataFrame:
    """docs: doc_id, text. FOUND for each row."""
    notices = [(label, text.encode().split(), [k.encode().split() for k in keys]) for label, text, keys in templates]
    phrases = [(k.encode().split(), v) for k, v in PHRASES.items()]
    words = frozenset(w for _, text, _ in notices for w in text)
    seen = {x["word"].encode(): x["docs"] for x in document_frequency(docs, words).collect()}
    rarity = {w: -math.log1p(seen.get(w, 0)) for w in words}
    postings: dict[bytes, list[tuple[int, int]]] = defaultdict(list)
    for t, (_, text, _) in enumerate(notices):
        own = indexed(text, rarity, agree, share)
        for place, w in enumerate(text):
            if w in own:
                postings[w].append((t, place))
    postings = dict(postings)
    lookup = postings.keys() | {w for p, _ in phrases for w in p}

    def of(text: str | None) -> tuple:
        got = ALNUM_WORDS.findall(low_bytes(text))
        own = lookup.intersection(got)
        at: dict[bytes, list[int]] = {}
        if own:
            for i, w in enumerate(got):
                if w in own:
                    at.setdefault(w, []).append(i)
        base = [(i, label) for p, label in phrases if own.issuperset(p) for i in _places(got, at, p)]
        labels, score = {x for _, x in base}, 0.0
        if base:
            score = 0.5
        votes: Counter = Counter()
        for w in own & postings.keys():
            for t, place in postings[w]:
                for i in at[w]:
                    votes[t, i - place] += 1
        for (t, start), n in votes.items():
            label, text, keys = notices[t]
            if n >= min(agree, len(text)) and start >= 0:
                here = got[start : start + len(text)]
                held = sum(a == b for a, b in zip(here, text, strict=False)) / len(text)
                if held >= share and all(any(here[j : j + len(k)] == k for j in range(len(here) - len(k) + 1)) for k in keys):
                    labels.add(label)
                    score = max(score, held)
        starts = [i for i, _ in base]
        return len(got), len(base), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in base})), ",".join(sorted(labels)), float(score)

    names = [x.split()[0] for x in FOUND.split(", ")]
    kinds = {"doc_id": "Int64", "n_words": "int64", "n_base": "int64", "first_word": "Int64", "last_word": "Int64", "score": "float64"}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame([(None if pd.isna(d) else d, *of(x)) for d, x in zip(batch["doc_id"].tolist(), batch["text"].tolist(), strict=True)], columns=names, dtype=object).astype(kinds)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInPandas(run, FOUND)


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))
