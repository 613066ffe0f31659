"""License scans: MinHash bands over overlapping text windows, verified by shingle containment.

Templates are sets of word 5-grams (a shorter template is one shingle of its
own length). For every template of s shingles the texts are cut into windows of
L shingles, L the least power of two with L / 2 >= s, one every L / 2: so every
place of the template lies whole within a window. If the needed share c of its
shingles is there, window and template have a Jaccard similarity of at least
j = c * s / (L + (1 - c) * s). Bands of one MinHash each are set so that
1 - (1 - j) ** bands is at least ``sure``; a window that shares a band with a
template is verified by exact containment of the template's shingles.

Windows' MinHashes are minima of blocks of two shingles, halved level by level,
over the whole texts; memory is bounded by a MB of texts, or one longer text.

Defined results: a null text, or one shorter than a template, can't contain it;
windows of one template that overlap are one match, with the best containment;
repeated rows come out as often as they come in; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vertexloom.llm.jaccard import STEP, mix
from vertexloom.llm.shared import table

GRAM = 5
#: So many characters of texts are scanned at once.
CHUNK = 1 << 20
# What the licenses say.
TEMPLATES = {
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0"],
    "MIT": [
        "Released under the MIT License",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    ],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3"],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0"],
    "BSD-3-Clause": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"],
    "CC-BY-4.0": ["This work is licensed under a Creative Commons Attribution 4.0 International License"],
}
TRIM = ".,;:!?\"'()[]{}<>"
_words: dict[str, int] = {}


def word_hashes(text: str) -> np.ndarray:
    """64-bit hashes of the words: split at white space, lower case, without punctuation at their ends."""
    if len(_words) > 500_000:
        _words.clear()
    out = []
    for w in text.lower().split():
        h = _words.get(w)
        if h is None:
            h = 0xCBF29CE484222325
            for b in w.strip(TRIM).encode("utf-8", "replace"):
                h = ((h ^ b) * 0x100000001B3) & 0xFFFFFFFFFFFFFFFF
            _words[w] = h
        out.append(h)
    return mix(np.array(out, np.uint64))


def shingles(h: np.ndarray, gram: int) -> np.ndarray:
    if len(h) < gram:
        return np.zeros(0, np.uint64)
    out = h[: len(h) - gram + 1]
    for k in range(1, gram):
        out = out * STEP + h[k : k + len(out)]
    return mix(out)


class Scanner:
    def __init__(self, templates: dict[str, list[str]], containment: float, sure: float):
        self.need = containment
        self.plans: dict[int, dict[int, list]] = {}  # by gram and L: (name, sorted shingles, bands)
        self.bands = 1
        for name, texts in templates.items():
            for text in texts:
                h = word_hashes(text)
                if not len(h):
                    continue
                s = np.unique(shingles(h, min(GRAM, len(h))))
                size = 2
                while size < 2 * len(s):
                    size *= 2
                j = containment * len(s) / (size + (1 - containment) * len(s))
                bands = max(1, math.ceil(math.log(1 - sure) / math.log(1 - j))) if j < 1 else 1
                self.bands = max(self.bands, bands)
                self.plans.setdefault(min(GRAM, len(h)), {}).setdefault(size, []).append((name, s, bands))
        self.odd = np.random.default_rng(5).integers(1, 1 << 63, self.bands, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def scan(self, texts: list[str]) -> list[tuple[int, str, int, int, float]]:
        """(index of the text, license, first word, words, containment). The texts' shingles stand in one row: windows may span texts, matches don't."""
        out = []
        hashes = [word_hashes(t) for t in texts]
        for gram, sizes in self.plans.items():
            each = [shingles(h, gram) for h in hashes]
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in each])])
            g = np.concatenate(each) if each else np.zeros(0, np.uint64)
            if not len(g):
                continue
            found: dict[tuple[int, int], set[int]] = {}
            for k, odd in enumerate(self.odd):
                wanted = {size: [i for i, (_, _, bands) in enumerate(ts) if k < bands] for size, ts in sizes.items()}
                half, low = 1, g * odd  # minima of blocks of `half` shingles
                for size in sorted(s for s in sizes if wanted[s]):
                    while half < size // 2:
                        if len(low) % 2:
                            low = np.append(low, low[-1])
                        low = np.minimum(low[0::2], low[1::2])
                        half *= 2
                    window = np.minimum(low, np.append(low[1:], low[-1:]))
                    for i in wanted[size]:
                        hit = np.flatnonzero(window == (sizes[size][i][1] * odd).min())
                        if len(hit):
                            found.setdefault((size, i), set()).update(hit.tolist())
            for (size, i), starts in sorted(found.items()):
                name, s, _ = sizes[size][i]
                last = None
                for w in sorted(starts):
                    a = w * size // 2
                    for d in range(int(np.searchsorted(offsets, a, side="right")) - 1, int(np.searchsorted(offsets, min(a + size, len(g)) - 1, side="right"))):
                        lo, hi = max(a, int(offsets[d])), min(a + size, int(offsets[d + 1]))
                        at = np.flatnonzero(np.isin(g[lo:hi], s)) + lo
                        share = len(np.unique(g[at])) / len(s)
                        if share < self.need:
                            continue
                        lo, hi = int(at[0] - offsets[d]), int(at[-1] - offsets[d]) + gram
                        if last and d == last[0] and lo < last[3]:
                            last = (d, name, last[2], max(hi, last[3]), max(share, last[4]))
                            out[-1] = last
                        else:
                            last = (d, name, lo, hi, share)
                            out.append(last)
        return [(d, n, a, b - a, c) for d, n, a, b, c in sorted(out)]


def scan_licenses(docs: DataFrame, templates: dict[str, list[str]] | None = None, containment: float = 0.75, sure: float = 0.9999, summary: bool = False) -> DataFrame:
    """(doc_id, license, word, n_words, containment): every place of a text that holds a template.

    With summary, a row for each row of docs: (doc_id, n_matches, licenses, first_word), the licenses comma-joined.
    """
    own = templates if templates is not None else TEMPLATES
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(own, containment, sure)
        for batch in batches:
            owner, rows = [], []
            each: list[list] = [[] for _ in range(batch.num_rows)]
            texts, first, size = [], 0, 0
            for k, text in enumerate(batch.column(1)):
                texts.append(text.as_py() or "")
                size += len(texts[-1])
                if size > CHUNK or k == batch.num_rows - 1:
                    for d, *row in scanner.scan(texts):
                        owner.append(first + d)
                        rows.append(row)
                        each[first + d].append(row)
                    texts, first, size = [], k + 1, 0
            if summary:
                cols = [len(x) for x in each], [",".join(sorted({r[0] for r in x})) for x in each], [min((r[1] for r in x), default=None) for x in each]
                yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.string(), pa.int64())))], ["doc_id", "n_matches", "licenses", "first_word"])
                continue
            cols = list(zip(*rows)) if rows else [()] * 4
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(owner, pa.int64())), *(pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int64(), pa.int64(), pa.float64())))],
                ["doc_id", "license", "word", "n_words", "containment"])

    what = "n_matches long, licenses string, first_word long" if summary else "license string, word long, n_words long, containment double"
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, {what}")


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document: how many license passages it holds, which licenses, and where the first is."""
    return scan_licenses(table(spark, sf_dir, "documents"), summary=True)
