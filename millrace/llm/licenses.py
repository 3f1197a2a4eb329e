"""Operator 6, license scans: MinHash bands over overlapping windows retrieve templates; containment verifies.

A template of m word shingles is looked for in windows of its own scale L (the power of two at or over m): L + step
shingles long, a step of L / 4 apart, so every run of L shingles lies inside one. A window that contains at least
CONTAINMENT of a template then has a Jaccard similarity to it of at least ``least_jaccard``, and the number of bands
(one MinHash each) follows from the chance of a miss that is allowed. Retrieved templates are verified by exact
containment of their shingles.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SpanHash, mix64, read

SHINGLE, CONTAINMENT, MISS = 5, 0.8, 1e-4

#: Public license notices, by SPDX name; the operator takes any others.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.',
    "MIT": "Released under the MIT License.",
    "MIT-grant": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so',
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "BSD": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
}
#: ASCII letters (lower-cased) and digits and all non-ASCII bytes make words; other bytes separate them.
_WORD = bytes(c + 32 if 65 <= c <= 90 else c if chr(c).isalnum() or c >= 128 else 32 for c in range(256))


def least_jaccard(scale: int, shingles: int, containment: float = CONTAINMENT) -> float:
    """The least Jaccard similarity of a template to a window of its scale that contains that much of it."""
    common = ceil(containment * shingles - 1e-9)
    return common / (scale + max(scale // 4, 1) + shingles - common)


def bands(jaccard: float, miss: float = MISS) -> int:
    """Bands of one MinHash each that leave at most this chance of no collision."""
    return 1 if jaccard >= 1 else ceil(log(miss) / log(1 - jaccard))


class Text:
    """The words of a text and the hashes of its shingles; with fewer words, the whole sequence is the one shingle."""

    def __init__(self, text: str | None):
        words = (text or "").encode("utf-8", "replace").translate(_WORD).split()
        self.line, self.n = b" ".join(words), len(words)
        if not words:
            self.hash = np.empty(0, np.uint64)
            return
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
        self.starts = np.r_[0, ends[:-1]][: max(len(words) - SHINGLE + 1, 1)]
        self.ends = ends[min(SHINGLE, len(words)) - 1 :] - 1
        self.hash = SpanHash(np.frombuffer(self.line, np.uint8))(self.starts, self.ends)

    def shingles(self, lo: int, hi: int) -> set[bytes]:
        return {self.line[a:b] for a, b in zip(self.starts[lo:hi].tolist(), self.ends[lo:hi].tolist())}


class Scanner:
    def __init__(self, templates: dict[str, str], containment: float = CONTAINMENT, miss: float = MISS):
        self.containment = containment
        self.scales: dict[int, list[tuple[str, set[bytes], np.ndarray]]] = {}
        self.salts: dict[int, np.ndarray] = {}
        anchors: dict[int, list[np.ndarray]] = {}
        texts = {name: Text(t) for name, t in templates.items()}
        for name, t in texts.items():
            if t.n:
                m = len(set(t.hash.tolist()))
                self.scales.setdefault(1 << (m - 1).bit_length(), []).append((name, t.shingles(0, len(t.hash)), t.hash))
        for scale, own in self.scales.items():
            b = max(bands(least_jaccard(scale, len(s), containment), miss) for _, s, _ in own)
            self.salts[scale] = mix64(np.arange(1, b + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
            kept = []
            for name, shingles, h in own:
                keys = mix64(h[:, None] ^ self.salts[scale][None, :])
                kept.append((name, shingles, keys.min(0)))
                anchors.setdefault(scale, []).append(h[keys.argmin(0)])
            self.scales[scale] = kept
        self.anchors = {s: np.unique(np.concatenate(a)) for s, a in anchors.items()}

    def scan(self, text: str | None) -> list[tuple[str, float, int]]:
        """``(template, containment, first word)`` of each template found, at its best (then first) window. A window
        can collide with a template only if it holds a shingle in which that template has a minimum, so windows
        without one aren't hashed."""
        t, best = Text(text), {}
        n = len(t.hash)
        for scale, own in self.scales.items() if n else ():
            a = self.anchors[scale]
            at = np.flatnonzero(a[np.minimum(np.searchsorted(a, t.hash), len(a) - 1)] == t.hash)
            step = max(scale // 4, 1)
            width = scale + step
            starts = sorted({s for p in at.tolist() for s in range(max(0, -(-(p - width + 1) // step) * step), p + 1, step)})
            for s in starts:
                least = mix64(t.hash[s : s + width, None] ^ self.salts[scale][None, :]).min(0)
                for name, shingles, key in own:
                    if (least == key).any():
                        found = len(shingles & t.shingles(s, s + width)) / len(shingles)
                        if found >= self.containment - 1e-9 and found > best.get(name, (0.0, 0))[0]:
                            best[name] = (found, s)
        return [(name, c, s) for name, (c, s) in sorted(best.items())]


def scan(docs: DataFrame, templates: dict[str, str] | None = None, id_col: str = "doc_id", text_col: str = "text", containment: float = CONTAINMENT, miss: float = MISS) -> DataFrame:
    """``id, license, containment, first_word``: a row for each row of ``docs`` and each template of which a window
    contains at least that share of the distinct shingles; no shuffle. Null and empty texts hold none; repeated rows
    and null ids are scanned each; an empty table gives no rows; other columns are ignored. Texts are scanned whole."""
    scanner = Scanner(templates or TEMPLATES, containment, miss)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [(k, *g) for k, t in enumerate(b.column(1)) for g in scanner.scan(t.as_py())]
            if got:
                at, name, share, first = zip(*got)
                yield pa.record_batch([b.column(0).take(pa.array(at)), pa.array(name), pa.array(share, pa.float64()), pa.array(first, pa.int64())], names=["id", "license", "containment", "first_word"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, license string, containment double, first_word long")


def op6_license_scan(spark, sf_dir: str) -> DataFrame:
    return scan(read(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")
