"""License notices in text: MinHash bands of the windows at every word find templates, exact containment confirms them.

A window's signature has, per band, the least of its shingles' hashes under the band's function; a template is retrieved where a window
agrees with it in a band. Two sets agree in a band with the probability of their similarity, which for a match is at least what
``Template.similarity`` says, so the number of bands follows from ``MISSED``, the most a match may be missed.

Signatures are not written out: a window agrees in a band exactly when it holds the template's least shingle and nothing less, so
only around the few places that hold such a shingle are the band's hashes looked at, as far as windows reach.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import types as T

from touchline.llm.common import text_of

WORDS, CONTAINMENT = 5, 0.8
#: Largest probability that a match agrees with its template in no band.
MISSED = 1e-7
SEED = 42
MARKS = b"\t\n\x0b\x0c\r.,;:!?()[]{}<>\"'`*#/\\|-_=+"
SEPARATORS = bytes.maketrans(MARKS, b" " * len(MARKS))

#: Public notices of licenses, as they are commonly written into files and pages.
TEMPLATES = {
    "MIT": [
        "Released under the MIT License.", "Licensed under the MIT License.",
        "This project is licensed under the terms of the MIT license.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation "
        "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the "
        "Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED "
        "TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT."],
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "you may not use this file except in compliance with the License. You may obtain a copy of the License at",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed "
        "on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
        "SPDX-License-Identifier: Apache-2.0"],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
        "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any "
        "later version.",
        "SPDX-License-Identifier: GPL-3.0-or-later", "SPDX-License-Identifier: GPL-3.0-only"],
    "AGPL-3.0": [
        "under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 "
        "of the License, or (at your option) any later version.",
        "SPDX-License-Identifier: AGPL-3.0-or-later", "SPDX-License-Identifier: AGPL-3.0-only"],
    "GPL-2.0": [
        "under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 "
        "of the License, or (at your option) any later version."],
    "LGPL": ["under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
                "SPDX-License-Identifier: MPL-2.0"],
    "EPL-2.0": [
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0",
        "SPDX-License-Identifier: EPL-2.0"],
    "BSD": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
        "following conditions are met",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following "
        "disclaimer in the documentation and/or other materials provided with the distribution.",
        "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, "
        "BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED."],
    "BSD-3-Clause": [
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products "
        "derived from this software without specific prior written permission.",
        "SPDX-License-Identifier: BSD-3-Clause"],
    "BSD-2-Clause": ["SPDX-License-Identifier: BSD-2-Clause"],
    "ISC": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted, provided that the above copyright notice and this permission notice appear in all copies."],
    "CC-BY-4.0": [
        "Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.",
                     "licensed under the Creative Commons Attribution-ShareAlike 4.0 International License."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.",
                     "licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "Unlicense": ["This is free and unencumbered software released into the public domain."],
}


def tokens(text: str) -> list[bytes]:
    """Words in lower case; ASCII marks part words."""
    return text.lower().encode().translate(SEPARATORS).split()


def window_shape(words: int) -> tuple[int, int]:
    """Words of a window for templates of so many words, and the step from one window to the next.

    The window is twice as long as the template and begins at every word, so a notice with words put in is found
    wherever it stands, as long as it is at most twice as long as the template.
    """
    return 2 * words, 1


def shingle_hashes(word_hashes: np.ndarray, words: int) -> np.ndarray:
    """Hash of every run of ``words`` word hashes."""
    out = np.zeros(max(0, len(word_hashes) - words + 1), np.uint64)
    for i in range(words):
        out = (out ^ (out >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + word_hashes[i:i + len(out)]
    return out ^ (out >> np.uint64(31))


def band_keys(hashes: np.ndarray, band: int) -> np.ndarray:
    """The hash of each shingle under a band's own hash function."""
    mixed = (hashes ^ np.uint64((band + 1) * 0xD6E8FEB86659FD93 % 2**64)) * np.uint64((2 * band + 1) * 0xBF58476D1CE4E5B9 % 2**64)
    return mixed ^ (mixed >> np.uint64(32))


@dataclass
class Template:
    license: str
    number: int
    words: int
    shingles: frozenset[int]
    needed: int  # shingles a match holds at least

    @property
    def width(self) -> int:
        """Shingles of a window."""
        return window_shape(self.words)[0] - WORDS + 1

    @property
    def similarity(self) -> float:
        """Least similarity of the template and a window that holds a match: all other shingles of the window are its own."""
        return self.needed / (self.width + len(self.shingles) - self.needed)

    @property
    def bands(self) -> int:
        """Bands of one row each, so many that a match is missed with a probability of at most ``MISSED``."""
        return math.ceil(math.log(MISSED) / math.log1p(-self.similarity)) if self.similarity < 1 else 1


class Scanner:
    """Templates and their bands; ``scan`` returns the matches of some texts."""

    def __init__(self, templates: dict[str, list[str]], words: int = WORDS, containment: float = CONTAINMENT) -> None:
        self.words, self.containment = words, containment
        self.hash_of: dict[bytes, int] = {}
        self.templates: list[Template] = []
        for name, texts in templates.items():
            for number, text in enumerate(texts):
                parts = tokens(text)
                if len(parts) < words:
                    raise ValueError(f"template {number} of {name} has fewer than {words} words")
                shingles = frozenset(shingle_hashes(self._hashes(parts), words).tolist())
                needed = next(n for n in range(len(shingles) + 1) if n / len(shingles) >= containment)
                self.templates.append(Template(name, number, len(parts), shingles, needed))
        #: Of every shingle that is some template's least: the templates and the bands in which it is.
        self.least: dict[int, dict[int, list[int]]] = {}
        for i, t in enumerate(self.templates):
            shingles = np.array(sorted(t.shingles), np.uint64)
            for band in range(t.bands):
                least = int(shingles[band_keys(shingles, band).argmin()])
                self.least.setdefault(least, {}).setdefault(i, []).append(band)
        self.known = np.array(sorted(self.least), np.uint64)

    def _hashes(self, parts: list[bytes]) -> np.ndarray:
        known = self.hash_of
        if len(known) > 200_000:
            known.clear()
        for word in set(parts).difference(known):
            known[word] = xxhash.xxh64_intdigest(word, SEED)
        return np.fromiter(map(known.__getitem__, parts), np.uint64, len(parts))

    def _near(self, each: list[np.ndarray]) -> list[tuple[int, int]]:
        """(place of the text, place of the template) where a window of the text agrees with the template in a band."""
        hashes = np.concatenate([np.zeros(0, np.uint64), *each])
        if not len(hashes) or not len(self.known):
            return []
        place = np.minimum(np.searchsorted(self.known, hashes), len(self.known) - 1)
        at = np.flatnonzero(self.known[place] == hashes)
        upto = np.cumsum([len(h) for h in each])
        text = np.searchsorted(upto, at, side="right")
        found: set[tuple[int, int]] = set()
        for t, p in zip(text.tolist(), (at - np.append(0, upto)[text]).tolist()):
            for i, bands in self.least[int(each[t][p])].items():
                if (t, i) not in found and any(self._agrees(each[t], p, self.templates[i].width, band) for band in bands):
                    found.add((t, i))
        return sorted(found)

    @staticmethod
    def _agrees(hashes: np.ndarray, p: int, width: int, band: int) -> bool:
        """Whether some window holds the shingle at p and nothing less under the band: the stretch around p without less is wide enough."""
        start = max(0, p - width + 1)
        keys = band_keys(hashes[start:p + width], band)
        here = p - start
        less = np.flatnonzero(keys < keys[here])
        cut = np.searchsorted(less, here)
        first = less[cut - 1] + 1 if cut else 0
        last = less[cut] if cut < len(less) else len(keys)
        return last - first >= min(width, len(hashes))

    def _best(self, template: Template, hashes: np.ndarray) -> tuple[float, int, int] | None:
        """(containment, first word, windows): the first of the best windows, and how many hold enough.

        Windows begin at a shingle of the template: one that begins before it holds no more than the one that begins there.
        """
        width = window_shape(template.words)[0] - self.words + 1  # shingles of a window
        places = [(at, h) for at, h in enumerate(hashes.tolist()) if h in template.shingles]
        counts: dict[int, int] = {}
        stop, most, first, hits = 0, 0, 0, 0
        for start, gone in places:
            while stop < len(places) and places[stop][0] < start + width:
                counts[places[stop][1]] = counts.get(places[stop][1], 0) + 1
                stop += 1
            if len(counts) >= template.needed:
                hits += 1
                if len(counts) > most:
                    most, first = len(counts), start
            counts[gone] -= 1
            if not counts[gone]:
                del counts[gone]
        return (most / len(template.shingles), first, hits) if hits else None

    def scan(self, texts: list[str], bands: bool = True) -> list[tuple[int, str, int, float, int, int]]:
        """(place of the text, license, template, containment, first word, windows) per template found, in this order;
        without ``bands`` every text is compared with every template."""
        each = [shingle_hashes(self._hashes(tokens(t)), self.words) for t in texts]
        near = self._near(each) if bands else [(t, i) for t in range(len(each)) for i in range(len(self.templates))]
        found = []
        for t, i in near:
            template = self.templates[i]
            best = self._best(template, each[t])
            if best:
                found.append((t, template.license, template.number, *best))
        return sorted(found)


MATCH = "license string, template int, containment double, first_word long, windows long"


def scan_licenses(docs: DataFrame, keep: dict[str, Column], text_col: str = "text",
                  templates: dict[str, list[str]] | None = None) -> DataFrame:
    """One row per document and template found, with the columns in ``keep``.

    A template is found where a window of the text, twice as long as the template, holds at least ``CONTAINMENT`` of its shingles of
    ``WORDS`` words; containment is that of the best window, which begins at ``first_word``, and ``windows`` counts those that hold
    enough and begin at a shingle of the template. Null, empty and short
    texts have no matches; repeated rows are each scanned; an empty table gives an empty result. Rows do not move, and the
    templates, a fixed list, travel with the tasks.
    """
    templates = templates or TEMPLATES
    source = docs.select(*[c.alias(n) for n, c in keep.items()], text_of(docs, text_col).alias("_text"))
    schema = T.StructType([*source.drop("_text").schema.fields, *T.StructType.fromDDL(MATCH).fields])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates)
        for batch in batches:
            out = []
            for at in range(0, batch.num_rows, 128):
                texts = batch.column(batch.num_columns - 1).slice(at, 128).to_pylist()
                out += [(at + t, *match) for t, *match in scanner.scan(texts)]
            rows, *columns = list(zip(*out)) if out else [()] * 6
            kinds = (pa.string(), pa.int32(), pa.float64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [*[c.take(pa.array(list(rows), pa.int64())) for c in batch.columns[:-1]],
                 *[pa.array(list(c), k) for c, k in zip(columns, kinds)]],
                names=[*batch.schema.names[:-1], "license", "template", "containment", "first_word", "windows"])

    return source.mapInArrow(scan, schema)


def license_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return scan_licenses(docs, {"doc_id": docs[f"`{id_col}`"]}, text_col)
