"""Licence scans: each file's rarest licence words, looked up in a positional index of templates."""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import alnum_words

# The base phrases, and public licence notices with the phrases that each must have.
BASE_PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
NOTICES = [
    ("mit", "released under the mit license", ["mit license"]),
    ("mit-text", "permission is hereby granted free of charge to any person obtaining a copy of this software", ["permission is hereby granted free of charge"]),
    (
        "mit-text",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        ["permission is hereby granted free of charge", "to deal in the software without restriction", "this permission notice shall be included in all copies or substantial portions"],
    ),
    ("apache-2.0", "licensed under the apache license version 2 0", ["apache license version 2"]),
    (
        "apache-2.0",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
        ["apache license version 2", "except in compliance with the license", "without warranties or conditions of any kind"],
    ),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted", ["redistribution and use in source and binary forms"]),
    (
        "bsd",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        ["redistribution and use in source and binary forms", "must retain the above copyright notice", "must reproduce the above copyright notice"],
    ),
    ("gpl-3", "this work is licensed under the gnu general public license version 3", ["general public license version 3"]),
    ("gpl-2", "this work is licensed under the gnu general public license version 2", ["general public license version 2"]),
    (
        "gpl-3",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        ["gnu general public license as published by the free software foundation", "either version 3 of the license"],
    ),
    (
        "gpl-2",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
        ["gnu general public license as published by the free software foundation", "either version 2 of the license"],
    ),
    (
        "agpl-3",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        ["affero general public license", "either version 3 of the license"],
    ),
    ("lgpl", "under the terms of the gnu lesser general public license", ["lesser general public license"]),
    (
        "lgpl",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
        ["lesser general public license", "published by the free software foundation"],
    ),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", ["mozilla public license"]),
    (
        "mpl-2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
        ["mozilla public license", "a copy of the mpl was not distributed with this file"],
    ),
    (
        "isc",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        ["for any purpose with or without fee is hereby granted", "this permission notice appear in all copies"],
    ),
    (
        "unlicense",
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
        ["free and unencumbered software", "released into the public domain"],
    ),
    ("cc-by-nc-4", "licensed under cc by nc 4 0", ["cc by nc 4"]),
    ("cc-by-sa-4", "licensed under cc by sa 4 0", ["cc by sa 4"]),
    ("cc0", "to the extent possible under law the author has waived all copyright", ["waived all copyright"]),
    (
        "cc0",
        "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide. This software is distributed without any warranty.",
        ["dedicated all copyright and related and neighboring rights", "to the public domain worldwide"],
    ),
    ("proprietary", "this software is proprietary and confidential", ["proprietary and confidential"]),
]


@dataclass(frozen=True)
class Template:
    label: str
    words: tuple[str, ...]
    keys: tuple[tuple[int, tuple[str, ...]], ...]  # where each mandatory phrase stands, and its words
    base: bool


def templates() -> list[Template]:
    out = [Template(label, w := tuple(alnum_words(p)), ((0, w),), True) for p, label in BASE_PHRASES.items()]
    for label, text, phrases in NOTICES:
        words = tuple(alnum_words(text))
        keys = []
        for p in phrases:
            k = tuple(alnum_words(p))
            keys.append((next(i for i in range(len(words)) if words[i : i + len(k)] == k), k))
        out.append(Template(label, words, tuple(keys), False))
    return out


class PositionalIndex:
    """Postings (template, position) of the words that templates must have."""

    def __init__(self, all_templates: list[Template], idf: dict[str, float], rare: int = 3):
        self.templates = all_templates
        self.postings: dict[str, list[tuple[int, int]]] = defaultdict(list)
        self.must: list[frozenset[str]] = []
        self.needed: list[int] = []
        for t, x in enumerate(all_templates):
            must = {q + i: w for q, k in x.keys for i, w in enumerate(k)}
            for i, w in sorted(must.items()):
                self.postings[w].append((t, i))
            self.must.append(frozenset(must.values()))
            self.needed.append(min(rare, len(must)))
        self.idf = {w: idf.get(w, math.inf) for w in self.postings}

    def matches(self, words: list[str]) -> Iterator[tuple[int, int, float]]:
        """Template, start and matched share of every place where all key phrases stand.

        A file's licence words are looked up from the highest IDF down, until each template whose words it has is met
        by `rare` postings (by all, if it has fewer). A template's places are those that all its postings agree on, so
        none is lost; there its key phrases are compared word for word.
        """
        at: dict[str, list[int]] = defaultdict(list)
        postings = self.postings
        for p, w in enumerate(words):
            if w in postings:
                at[w].append(p)
        left = {t: n for t, n in enumerate(self.needed) if at.keys() >= self.must[t]}
        starts: dict[int, set[int]] = {}
        open_ = set(left)
        for w in sorted(at, key=lambda w: (-self.idf[w], w)):
            if not open_:
                break
            for t, i in postings[w]:
                if t in open_:
                    here = starts.get(t)
                    starts[t] = {p - i for p in at[w]} if here is None else here.intersection([p - i for p in at[w]])
                    left[t] -= 1
                    if not left[t] or not starts[t]:
                        open_.discard(t)
        for t, places in starts.items():
            x = self.templates[t]
            for s in places:
                if any(s + q < 0 or tuple(words[s + q : s + q + len(k)]) != k for q, k in x.keys):
                    continue
                yield t, s, sum(0 <= s + i < len(words) and words[s + i] == w for i, w in enumerate(x.words)) / len(x.words)


def licence_idf(docs: DataFrame, all_templates: list[Template], text: str = "text") -> dict[str, float]:
    """IDF over all documents of the words that templates have; only their counts reach the driver."""
    vocabulary = frozenset(w for t in all_templates for w in t.words)

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[str] = Counter()
        n = 0
        for b in batches:
            for x in b.column(0):
                n += 1
                seen.update(vocabulary.intersection(alnum_words(x.as_py() or "")))
        words = ["", *seen]
        yield pa.RecordBatch.from_arrays([pa.array(words), pa.array([n, *seen.values()], pa.int64())], ["word", "n"])

    rows = docs.select(F.col(text).cast("string").alias("text")).mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    n = {r["word"]: r["n"] for r in rows}
    total = n.pop("", 0)
    return {w: math.log((total + 1) / (c + 0.5)) for w, c in n.items()}


def scan_licences(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = 0.6) -> DataFrame:
    """One row per document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, matches.

    A document's licence words of highest IDF give, through their positions in the templates, the
    places where a template may stand; a place counts if all looked-up words agree on it and every
    mandatory phrase stands there word for word. Base phrases are templates that are mandatory
    as a whole. Other templates add their label when `threshold` of their words match.
    `score` is the best matched share (0: none); `matches` holds label, start and share.

    Null and empty texts have no words and no labels (empty strings, null positions, score 0).
    Every place counts, in texts of any length. Repeated rows each get their result; an empty
    table gives no rows; extra columns are not read.
    """
    known = templates()
    index = PositionalIndex(known, licence_idf(docs, known, text))
    fields = [("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()), ("matches", pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("share", pa.float64())])))]

    def one(doc_id: int | None, text: str | None) -> tuple:
        words = alnum_words(text or "")
        base, labels, best, found = [], set(), 0.0, []
        for t, at, share in index.matches(words):
            x = known[t]
            if not x.base and share < threshold:
                continue
            if x.base:
                base.append((at, x.label))
            labels.add(x.label)
            best = max(best, share)
            found.append({"label": x.label, "start": at, "share": share})
        starts = [at for at, _ in base]
        found.sort(key=lambda m: (m["start"], m["label"]))
        return doc_id, len(words), len(base), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in base})), ",".join(sorted(labels)), best, found

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, 1000):
                part = b.slice(k, 1000)
                rows = [one(i.as_py(), x.as_py()) for i, x in zip(*part.columns, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, (_, kind) in zip(zip(*rows, strict=True), fields, strict=True)], [n for n, _ in fields])

    schema = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, matches array<struct<label:string,start:long,share:double>>"
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(scan, schema)
