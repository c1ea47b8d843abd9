"""License scans: MinHash bands over overlapping windows retrieve templates, exact containment verifies them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import textkit as tk
from .shared import prepare

#: Words in a shingle, and the share of a template's shingles that a window must hold.
SHINGLE, CONTAINMENT = 3, 0.8
#: One band for each bin of a one-permutation MinHash. A window holds all of a template of t
#: shingles in at most 2 * (t + 2 + stride) words; each of the template's bands survives where
#: no other shingle of the window falls into the bin with a smaller hash, which for m others
#: fails with a chance below m / (2 * BINS). All t bands fail together below (m / 1024) ** t.
BINS = 512
#: Templates may have so many words together: they are sent to every worker.
MOST_WORDS = 200_000

#: Notices by which texts state their license.
NOTICES = {
    "MIT": "Released under the MIT License.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "MIT-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
    "BSD-text": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "Apache-2.0-text": "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    "All-rights-reserved": "All rights reserved.",
    "ISC-text": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "GPL-text": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
}


def _shingles(words: np.ndarray) -> np.ndarray:
    return tk.shingles(words, SHINGLE)


class Templates:
    """Shingle sets of templates, grouped by window size (a power of two), and their bands."""

    def __init__(self, texts: dict[str, str]):
        if sum(len(t.split()) for t in texts.values()) > MOST_WORDS:
            raise ValueError(f"templates have over {MOST_WORDS} words")
        self.names, self.sets, self.window = [], [], []
        for name, text in texts.items():
            data, offsets = tk.utf8(pa.array([text]))
            grams = np.unique(_shingles(tk.Words(data, offsets).trim().hashes()))
            if len(grams):
                self.names.append(name)
                self.sets.append(grams)
                self.window.append(1 << int(len(grams) + SHINGLE - 2).bit_length())
        bands = [(w, *band) for i, w in enumerate(self.window) for band in [(g, i) for g in _minima(self.sets[i], np.zeros(len(self.sets[i]), np.int64))[1]]]
        self.classes = sorted(set(self.window))
        self.bands = {c: [(g, i) for w, g, i in bands if w == c] for c in self.classes}
        self.keys = {c: np.array(sorted({g for g, _ in b}), np.uint64) for c, b in self.bands.items()}
        self.owners = {c: {int(k): [i for g, i in b if g == k] for k in self.keys[c]} for c, b in self.bands.items()}
        self.low = np.zeros(1 << 16, bool)
        for k in self.keys.values():
            self.low[(k & np.uint64(0xFFFF)).astype(np.int64)] = True


def _minima(grams: np.ndarray, window: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The smallest hash of each bin of each window: (window, hash)."""
    key = window * BINS + (grams >> np.uint64(55)).astype(np.int64)
    order = np.lexsort((grams, key))
    key, grams = key[order], grams[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    return key[first] // BINS, grams[first]


def matches(grams: np.ndarray, templates: Templates, containment: float = CONTAINMENT, retrieve: bool = True):
    """(template, first shingle of the best window, containment) of one text's shingles, in order. Without ``retrieve`` every window meets every template."""
    best: dict[int, tuple[float, int]] = {}
    n = len(grams)
    # a window can only share a band if it holds one of the bands' hashes
    likely = np.flatnonzero(templates.low[(grams & np.uint64(0xFFFF)).astype(np.int64)])
    for c in templates.classes:
        hits = likely[np.isin(grams[likely], templates.keys[c])] if retrieve else np.arange(n)
        if not len(hits):
            continue
        size = 2 * c  # windows of 2c shingles, c apart: any c of them in a row are in one window
        windows = np.unique(np.concatenate([np.maximum(hits // c - 1, 0), hits // c]))
        windows = windows[(windows == 0) | (windows * c + c < n)]
        for w in windows:
            part = grams[w * c : w * c + size]
            if retrieve:
                _, low = _minima(part, np.zeros(len(part), np.int64))
                found = {i for g in low[np.isin(low, templates.keys[c])].tolist() for i in templates.owners[c][g]}
            else:
                found = {i for i, x in enumerate(templates.window) if x == c}
            for i in sorted(found):
                inside = np.isin(part, templates.sets[i])
                share = len(np.unique(part[inside])) / len(templates.sets[i])
                if share >= containment and (i not in best or share > best[i][0]):
                    best[i] = (share, int(w * c + np.argmax(inside)))
    return [(i, at, share) for i, (share, at) in sorted(best.items())]


def scan(docs: DataFrame, texts: dict[str, str] | None = None, containment: float = CONTAINMENT, retrieve: bool = True) -> DataFrame:
    """doc_id, license, first_word, n_words, containment: one row for each template that a text holds.

    A text holds a template where one window of consecutive words has at least ``containment``
    of the template's distinct word shingles; first_word (from 0) and containment are of the
    best window, the first of equals. n_words is the text's length. Words are compared with
    A-Z in lower case and without punctuation at either end, so a notice may end in a full stop,
    a comma, a bracket or nothing. Null and empty texts hold nothing, and texts of any length
    are scanned whole; rows with null or repeated doc_ids are scanned each by themselves. Other
    columns are not read. An empty table gives no rows. ``texts`` are the templates by name.
    """
    spark = prepare(docs.sparkSession)
    templates = spark.sparkContext.broadcast(Templates(NOTICES if texts is None else texts))
    schema = pa.schema([("doc_id", pa.int64()), ("license", pa.string()), ("first_word", pa.int64()), ("n_words", pa.int64()), ("containment", pa.float64())])

    def run(batches):
        t = templates.value
        for batch in batches:
            data, offsets = tk.utf8(batch.column(1))
            out = []
            for a, b, piece, at in tk.chunks(data, offsets):
                words = tk.Words(piece, at).trim()
                hashes, first = words.hashes(), words.first
                for i in range(b - a):
                    h = hashes[first[i] : first[i + 1]]
                    for k, place, share in matches(_shingles(h), t, containment, retrieve) if len(h) else ():
                        out.append((batch.column(0)[a + i].as_py(), t.names[k], place, len(h), share))
            cols = zip(*out, strict=True) if out else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, license string, first_word long, n_words long, containment double")


def _oracle() -> str:
    """DuckDB SQL for the rows of ``scan(docs)``: every template against every window, by exact shingles."""
    found = Templates(NOTICES)
    rows = ", ".join("('{}', {}, '{}')".format(name, c, NOTICES[name].replace("'", "''")) for name, c in zip(found.names, found.window, strict=True))
    punctuation = r"[!-/:-@\[-`{-~]"
    split = rf"""list_transform(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'),
      lambda w: CASE WHEN regexp_replace(w, '^{punctuation}+|{punctuation}+$', '', 'g') = '' THEN w ELSE regexp_replace(w, '^{punctuation}+|{punctuation}+$', '', 'g') END)"""
    grams = "CASE WHEN len(ws) < 3 THEN array_to_string(ws, ' ') ELSE ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] END"
    return f"""
WITH t(name, c, text) AS (VALUES {rows}),
tw AS (SELECT name, c, {split} ws FROM t),
tg AS (SELECT DISTINCT name, c, {grams} g FROM tw, unnest(range(1, greatest(len(ws) - 1, 2))) u(i)),
ts AS (SELECT name, count(*) n FROM tg GROUP BY 1),
d AS (SELECT row_number() OVER () r, doc_id, text FROM documents),
dw AS (SELECT r, doc_id, {split} ws FROM d),
dg AS (SELECT r, doc_id, len(ws) n_words, greatest(len(ws) - 2, 1) n, i - 1 p, {grams} g FROM dw, unnest(range(1, greatest(len(ws) - 1, 2))) u(i) WHERE len(ws) > 0),
hit AS (SELECT r, doc_id, n_words, n, name, c, p, g FROM dg JOIN tg USING (g)),
win AS (SELECT *, p // c AS w FROM hit UNION ALL SELECT *, p // c - 1 FROM hit WHERE p // c > 0),
got AS (SELECT r, doc_id, n_words, name, w, min(p) first_word, CAST(count(DISTINCT g) AS DOUBLE) / any_value(ts.n) share FROM win JOIN ts USING (name) WHERE w = 0 OR w * c + c < win.n GROUP BY 1, 2, 3, 4, 5),
best AS (SELECT *, row_number() OVER (PARTITION BY r, name ORDER BY share DESC, w) k FROM got WHERE share >= {CONTAINMENT})
SELECT doc_id, name AS license, first_word, n_words, share AS containment FROM best WHERE k = 1
"""


ORACLE = _oracle()
