"""License scans: MinHash bands over overlapping windows retrieve templates, exact shingle containment verifies them.

Words are lowered and stripped of marks at their ends, words without letters or digits (comment signs) are left out.
Templates and texts become sequences of 5-word shingles.  Templates of m shingles are searched with windows of 3 blocks of
c / 2 shingles, c being the power of two not below m: wherever a run of c shingles lies, it is inside one window.  If `num` / `den`
of a template are in the window, their Jaccard similarity is at least 0.8 m / (1.5 c + 0.2 m) > 0.25, and BANDS bands of one
row collide with probability 1 - 0.75 ** 24 > 0.998 in each of the windows; templates of up to four shingles must be there
in full, so one band over windows of exactly their length always collides.  Hits are verified by the share of the template's
distinct shingles in the text around the window.

Scale: one pass without a shuffle; windows are numpy reductions over slices of many texts.  The templates travel in the
closure and are limited to MAX_SHINGLES.

Defined cases: null and empty texts and those below five words match nothing; rows with null ids are reported with a null
id; repeated rows are reported each; further columns are ignored; templates below five words are refused.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from strandlake.llm.common import LOWER, _STEP, mix, slices, span_hashes, take_column, text_bytes, trim_spans, word_spans

BANDS = 24
MAX_SHINGLES = 1_000_000
_K = 5
_WORDLIKE = np.zeros(256, bool)
_WORDLIKE[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True

# Notices of public licenses.
TEMPLATES = {
    "mit-line": "Released under the MIT License.",
    "mit-licensed": "Licensed under the MIT License.",
    "apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "cc-by-4.0": "Licensed under CC BY 4.0.",
    "cc-by-sa-4.0": "Licensed under CC BY-SA 4.0.",
    "gpl-3.0-line": "This work is licensed under the GNU General Public License, version 3.",
    "cc-by-4.0-notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "mit": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        'documentation files (the "Software"), to deal in the Software without restriction, including without limitation '
        "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to "
        "permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright "
        "notice and this permission notice shall be included in all copies or substantial portions of the Software."
    ),
    "isc": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted, provided that the above copyright notice and this permission notice appear in all copies."
    ),
    "bsd": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
        "following conditions are met: Redistributions of source code must retain the above copyright notice, this list of "
        "conditions and the following disclaimer."
    ),
    "apache-2.0": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with '
        "the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by "
        'applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, '
        "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."
    ),
    "gpl-3.0": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
        "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later "
        "version."
    ),
    "mpl-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not "
        "distributed with this file, You can obtain one at"
    ),
}


def _sequence(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Shingle hashes in order, the text of each, and the number of its first word among the text's words."""
    starts, ends, wo = word_spans(data, offs)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    a, b = trim_spans(_WORDLIKE[data], starts, ends)
    keep = b > a
    doc = np.repeat(np.arange(len(offs) - 1), np.diff(wo))[keep]
    no = (np.arange(len(starts)) - np.repeat(wo[:-1], np.diff(wo)))[keep]
    w = span_hashes(LOWER[data], a[keep], b[keep])
    if len(w) < _K:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    n = len(w) - _K + 1
    h = sum(w[j : j + n] * _STEP[j] for j in range(_K))
    ok = doc[:n] == doc[_K - 1 :]
    return mix(h[ok]), doc[:n][ok], no[:n][ok]


def _row(h: np.ndarray, band: int) -> np.ndarray:
    """One permutation of the hashes: all bits of h * odd are turned into high ones by the order of unsigned numbers."""
    return (h ^ (h >> np.uint64(17 + band))) * np.uint64((0xA24BAED4963EE407 + 0x9FB21C651E98DF26 * band) & 0xFFFFFFFFFFFFFFFF | 1)


class TemplateIndex:
    def __init__(self, templates: dict[str, str]):
        self.names = sorted(templates)
        raw = [templates[n].encode() for n in self.names]
        offs = np.r_[0, np.cumsum([len(r) for r in raw])].astype(np.int64)
        h, doc, _ = _sequence(np.frombuffer(b"".join(raw), np.uint8), offs)
        self.sets = [np.unique(h[doc == i]) for i in range(len(raw))]
        short = [n for n, s in zip(self.names, self.sets, strict=True) if not len(s)]
        if short or len(h) > MAX_SHINGLES:
            raise ValueError(f"templates of {_K} words at least, and {MAX_SHINGLES} shingles in all, are wanted: {short}")
        self.exact: dict[int, list[int]] = {}
        self.classes: dict[int, list[int]] = {}
        for t, s in enumerate(self.sets):
            (self.exact if len(s) <= 4 else self.classes).setdefault(len(s) if len(s) <= 4 else 1 << (len(s) - 1).bit_length(), []).append(t)
        self.lows = {}
        for c, ts in self.classes.items():
            for band in range(BANDS):
                pairs = sorted((int(_row(self.sets[t], band).min()), t) for t in ts)
                self.lows[c, band] = (np.array([p[0] for p in pairs], np.uint64), [p[1] for p in pairs])
        self.first = {m: sorted((int(self.sets[t].min()), t) for t in ts) for m, ts in self.exact.items()}

    def candidates(self, h: np.ndarray) -> set[tuple[int, int, int]]:
        """(template, first and last shingle of a window) whose bands collide."""
        out: set[tuple[int, int, int]] = set()
        for m, pairs in self.first.items():
            if len(h) < m:
                continue
            low = h[: len(h) - m + 1].copy()
            for j in range(1, m):
                np.minimum(low, h[j : len(h) - m + 1 + j], out=low)
            known = np.array([p[0] for p in pairs], np.uint64)
            for i in np.flatnonzero(np.isin(low, known)).tolist():
                out.update((t, i, i + m) for v, t in pairs if v == low[i])
        sizes = sorted(self.classes)
        for band in range(BANDS if sizes and len(h) else 0):
            blocks, width = _row(h, band), 1
            for c in sizes:
                while width < c // 2:  # minima of blocks, each from two of the former
                    if len(blocks) % 2:
                        blocks = np.append(blocks, ~np.uint64(0))
                    blocks, width = np.minimum(blocks[::2], blocks[1::2]), 2 * width
                wide = np.concatenate([blocks, np.full(2, ~np.uint64(0))])
                low = np.minimum(np.minimum(wide[:-2], wide[1:-1]), wide[2:])
                known, ts = self.lows[c, band]
                at = np.minimum(np.searchsorted(known, low), len(known) - 1)
                for i in np.flatnonzero(known[at] == low).tolist():
                    out.update((t, i * width, i * width + 3 * width) for v, t in zip(known.tolist(), ts, strict=True) if v == int(low[i]))
        return out


def scan_licenses(docs: DataFrame, templates: dict[str, str] | None = None, num: int = 80, den: int = 100) -> DataFrame:
    """(doc_id, license, matched, total, first_word) for each text and template of which num/den is in one place."""
    templates = TEMPLATES if templates is None else templates
    TemplateIndex(templates)

    def run(batches):
        index = TemplateIndex(templates)
        for batch in batches:
            ids = take_column(batch, "doc_id")
            data, offs = text_bytes(take_column(batch, "text"))
            best: dict[tuple[int, int], tuple[int, int]] = {}
            for i, j in slices(offs):
                h, doc, no = _sequence(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
                for t, a, b in index.candidates(h):
                    a, b = max(0, a), min(len(h), b)
                    want = index.sets[t]
                    for d in np.unique(doc[a:b]).tolist():
                        lo, hi = np.searchsorted(doc, d), np.searchsorted(doc, d, "right")
                        lo, hi = max(lo, a - len(want)), min(hi, b + len(want))
                        hit = np.isin(h[lo:hi], want)
                        matched = len(np.unique(h[lo:hi][hit]))
                        if matched * den >= len(want) * num:
                            first = int(no[lo:hi][hit].min())
                            old = best.get((i + d, t))
                            if old is None or (-matched, first) < (-old[0], old[1]):
                                best[i + d, t] = (matched, first)
            keys = sorted(best)
            yield pa.RecordBatch.from_arrays(
                [
                    ids.take(pa.array([k[0] for k in keys], pa.int64())),
                    pa.array([index.names[k[1]] for k in keys], pa.string()),
                    pa.array([best[k][0] for k in keys], pa.int64()),
                    pa.array([len(index.sets[k[1]]) for k in keys], pa.int64()),
                    pa.array([best[k][1] for k in keys], pa.int64()),
                ],
                names=["doc_id", "license", "matched", "total", "first_word"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, license string, matched long, total long, first_word long")
