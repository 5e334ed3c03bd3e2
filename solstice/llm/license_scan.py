"""License scans: MinHash bands retrieve templates, exact shingle containment verifies.

Texts and templates are words (runs of letters, digits and non-ASCII bytes,
lower-cased) and shingles of ``GRAM`` words.  For each template length a text
is cut into overlapping windows a quarter longer than the template, an eighth
apart.  A window with fewer known shingles than ``CONTAINED`` of the shortest
template of that length can't match and is passed over; each other window gets a MinHash signature of ``BANDS * ROWS``
values.  Windows and templates that agree in a whole band are candidates.

A window that holds ``CONTAINED`` of a template's shingles and is at most a
quarter longer has a Jaccard similarity of at least 0.8 / 1.45 = 0.55, so it
meets the template in some band with a probability of
``1 - (1 - 0.55 ** ROWS) ** BANDS`` > 0.99999; overlapping windows add further
chances.  Every candidate is verified by the exact share of the template's
shingles in the window.

``scan`` gives every template that is contained that far, also the kin of a
notice (GPL-2.0 in one of GPL-3.0).  ``licenses`` tells them apart: a window
must hold all of a template's ``TELLING`` shingles, and of templates that lie on
the same words the one with the best containment stays (then the longest).

Templates are few and short and travel with the code of the tasks; documents
aren't shuffled.

Defined cases: null or blank texts match nothing; templates below ``GRAM`` words
are left out; repeated rows each give their own result; null ids are carried;
other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from solstice.llm import words as W

GRAM, BANDS, ROWS, CONTAINED = 2, 40, 2, 0.8

# The usual one-line notices of common licenses.
TEMPLATES = {
    "MIT": "Released under the MIT License",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3",
    "LGPL-3.0": "This work is licensed under the GNU Lesser General Public License, version 3",
    "AGPL-3.0": "This work is licensed under the GNU Affero General Public License, version 3",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
    "CC-BY-4.0": "Licensed under CC BY 4.0",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights",
    "MIT-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    "Proprietary": "All rights reserved. No part of this publication may be reproduced without the prior written permission of the publisher",
}
# Standard headers and openings of full texts.
_GNU = ("This program is free software; you can redistribute it and/or modify it under the terms of the GNU {} License as published by "
        "the Free Software Foundation; either version {} of the License, or (at your option) any later version")
TEMPLATES |= {f"{name}-{v}-or-later": _GNU.format(kind, v) for name, kind, v in (
    ("GPL", "General Public", "2"), ("GPL", "General Public", "3"), ("LGPL", "Lesser General Public", "2.1"),
    ("LGPL", "Lesser General Public", "3"), ("AGPL", "Affero General Public", "3"))}
TEMPLATES |= {
    "Apache-2.0-header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License',
    "Apache-2.0-text": "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION",
    "GPL-2.0-text": "GNU GENERAL PUBLIC LICENSE Version 2, June 1991 Copyright (C) 1989, 1991 Free Software Foundation, Inc.",
    "GPL-3.0-text": "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007 Copyright (C) 2007 Free Software Foundation, Inc.",
    "LGPL-3.0-text": "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007 Copyright (C) 2007 Free Software Foundation, Inc.",
    "AGPL-3.0-text": "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007 Copyright (C) 2007 Free Software Foundation, Inc.",
}
#: Shingles that tell a template from its kin.
TELLING = {
    "Apache-2.0": "Version 2", "Apache-2.0-header": "Version 2", "Apache-2.0-text": "Version 2", "MPL-2.0": "v 2",
    "CC-BY-4.0": "BY 4", "CC-BY-SA-4.0": "BY SA 4", "CC-BY-NC-4.0": "BY NC 4",
    **{f"{name}-{v}{end}": f"GNU {kind}; version {v}" for name, kind in (("GPL", "General"), ("LGPL", "Lesser"), ("AGPL", "Affero"))
       for v in ("2", "3") for end in ("", ".0", ".0-text", "-or-later")},
    "LGPL-2.1-or-later": "GNU Lesser; version 2.1",
}

_OTHER = np.ones(256, dtype=bool)
_OTHER[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False
_SEEDS = W.mix(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def _shingles(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(shingle at each word but the last of all, which of them lie in one row, first word of each row)."""
    w = W.words_of(texts, lower=True, blank=_OTHER)
    return W.window_hashes(W.word_hashes(w), GRAM), W.valid_windows(w.first, GRAM), w.first


def _bands(sets: np.ndarray) -> np.ndarray:
    """Band keys (windows x BANDS) of rows of shingles."""
    low = np.stack([W.mix(sets ^ s).min(axis=1) for s in _SEEDS], axis=1)
    out = np.zeros((len(sets), BANDS), dtype=np.uint64)
    for r in range(ROWS):
        out = W.mix(out * np.uint64(31) + low[:, r::ROWS])
    return W.mix(out ^ np.arange(BANDS, dtype=np.uint64))


class _Templates:
    def __init__(self, templates: Mapping[str, str], telling: Mapping[str, str] | None = None):
        texts = pa.array(list(templates.values()), pa.string())
        h, ok, first = _shingles(texts)
        self.names, self.sets, self.words, self.tell = [], [], [], []
        for name, a, z in zip(templates, first, first[1:]):
            if z - a >= GRAM:
                self.names.append(name)
                self.sets.append(np.unique(h[a : z - GRAM + 1]))
                self.words.append(int(z - a))
                t, fits, _ = _shingles(pa.array((telling or {}).get(name, "").split(";"), pa.string()))
                self.tell.append(t[fits])
        self.known = np.unique(np.concatenate(self.sets)) if self.sets else np.zeros(0, np.uint64)
        self.by_length: dict[int, dict[int, list[int]]] = {}  # window -> band key -> templates
        for t, (s, n) in enumerate(zip(self.sets, self.words)):
            table = self.by_length.setdefault(-(-n * 5 // 4), {})
            for key in _bands(s[None, :])[0].tolist():
                table.setdefault(key, []).append(t)
        # What a window of a length must hold to match: shingles, and how many.
        self.least = {}
        for size in self.by_length:
            sets = [s for s, n in zip(self.sets, self.words) if -(-n * 5 // 4) == size]
            self.least[size] = np.unique(np.concatenate(sets)), min(int(np.ceil(CONTAINED * len(s) - 1e-9)) for s in sets)


def _scan(index: _Templates, texts: pa.Array) -> list[tuple]:
    """(row, template, containment, start word, windows, first and last word it lies on) of the matches of each row and template."""
    h, ok, first = _shingles(texts)
    best: dict[tuple[int, int], tuple] = {}
    if not len(h) or not len(index.known):
        return []
    counts = np.diff(first)
    for size, table in index.by_length.items():
        step = max(1, size // 8)
        known, least = index.least[size]
        hit = np.concatenate(([0], np.cumsum(np.isin(h, known) & ok)))
        n_win = np.where(counts >= GRAM, np.maximum(-(-(counts - size) // step), 0) + 1, 0)
        row = np.repeat(np.arange(len(counts)), n_win)
        nth = np.arange(len(row)) - np.repeat(np.cumsum(n_win) - n_win, n_win)
        a = first[row] + nth * step
        z = np.minimum(a + size, first[row + 1]) - GRAM + 1  # end of the window's shingles
        live = np.flatnonzero(hit[z] - hit[a] >= least)
        for k in range(0, len(live), 2048):
            i = live[k : k + 2048]
            # A short last window repeats its first shingle, which changes no minimum.
            spots = a[i, None] + np.arange(size - GRAM + 1)
            sets = h[np.where(spots < z[i, None], spots, a[i, None])]
            for p, keys in enumerate(_bands(sets).tolist()):
                seen = {t for key in keys if key in table for t in table[key]}
                for t in seen:
                    share = float(np.isin(index.sets[t], sets[p]).mean())
                    if share >= CONTAINED and np.isin(index.tell[t], sets[p]).all():
                        at, old = (int(row[i[p]]), t), best.get((int(row[i[p]]), t))
                        start, n = int(a[i[p]] - first[row[i[p]]]), old[2] if old else 0
                        if not old or share > old[0]:
                            lies = start + np.flatnonzero(np.isin(h[a[i[p]] : z[i[p]]], index.sets[t]))
                            best[at] = (share, start, n + 1, int(lies[0]), int(lies[-1]) + GRAM)
                        else:
                            best[at] = (*old[:2], n + 1, *old[3:])
    return [(r, t, *x) for (r, t), x in best.items()]


def _told_apart(index: _Templates, got: list[tuple]) -> list[tuple]:
    """Of matches of a row that share most of the shorter one's words, the best (then of the longest template)."""
    kept: dict[int, list[tuple]] = {}
    for x in sorted(got, key=lambda x: (x[0], -x[2], -index.words[x[1]], x[1])):
        a, z = x[5:]
        mine = kept.setdefault(x[0], [])
        if not any(2 * (min(z, y[6]) - max(a, y[5])) > min(z - a, y[6] - y[5]) for y in mine):
            mine.append(x)
    return [x for mine in kept.values() for x in mine]


def scan(docs: DataFrame, templates: Mapping[str, str] = TEMPLATES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each document row and license: id, license, containment, start_word, n_windows.

    ``start_word``: start of the first window with the best containment; ``n_windows``: windows that hold the template.
    """
    return _rows(docs, dict(templates), None, id_col, text_col)


def licenses(docs: DataFrame, templates: Mapping[str, str] = TEMPLATES, telling: Mapping[str, str] = TELLING, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """As ``scan``, but only the licenses that the notices of a document name."""
    return _rows(docs, dict(templates), dict(telling), id_col, text_col)


def _rows(docs: DataFrame, templates: dict[str, str], telling: dict[str, str] | None, id_col: str, text_col: str) -> DataFrame:
    base = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).filter("text is not null")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = _Templates(templates, telling)
        for whole in batches:
            for b in W.slices(whole, "text"):
                got = _scan(index, b.column("text"))
                if got:
                    r, t, share, start, n, *_ = zip(*(got if telling is None else _told_apart(index, got)))
                    yield pa.record_batch({"id": b.column("id").take(pa.array(r)), "license": pa.array([index.names[x] for x in t], pa.string()),
                                           "containment": pa.array(share, pa.float64()), "start_word": pa.array(start, pa.int64()), "n_windows": pa.array(n, pa.int32())})

    return base.mapInArrow(run, "id long, license string, containment double, start_word long, n_windows int").withColumnRenamed("id", id_col)
