"""License scans: Dice coefficient of word bigrams between passages of a text and licence templates.

Templates are whole licences (``templates/``) and short notices. Texts and templates are normalised alike (lower
case, words of letters and digits) and become multisets of word bigrams: with s and t bigrams, c of them in common,
the coefficient is 2 c / (s + t). The passages of a text are the whole text, each line, and every window of
the template's length, wherever it stands.

Templates are pruned before any passage is looked at. A coefficient of ``least`` needs a passage of
at least ``least`` t / (2 - ``least``) bigrams, as many of which are the template's; so the text must have that many bigrams,
and its own bigrams must hold that many of the template's. Texts are coded by the templates'
bigrams once, and all templates' shares counted in one matrix step. The best coefficient of each
template that is left counts; those of ``least`` or more are reported. A narrow pass over the texts: nothing is
shuffled, and the templates are few. The best licence is that with most bigrams in common, so a whole licence comes
before a notice in it; of equal ones that of the higher coefficient.

Defined cases: null, empty and one-word texts match nothing, and an empty table gives an empty table; of licences
equal in both the first in alphabetical order is the best; repeated rows are scanned one by one; very long texts
are scanned whole, in time proportional to their length for each template that is left; further columns, whatever
their names, are not looked at.
"""

from __future__ import annotations

import re
from collections import Counter
from itertools import pairwise
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import by_arrow

#: Notices of public licences, as their stewards word them.
TEMPLATES = {
    "Apache-2.0": ("Licensed under the Apache License, Version 2.0.", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.'),
    "BSD": ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",),  # which one, the whole text tells
    "CC-BY-4.0": ("This work is licensed under a Creative Commons Attribution 4.0 International License.", "Licensed under CC BY 4.0."),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    "GPL-3.0": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    "MIT": ("Released under the MIT License.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction"),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",),
    "Unlicense": ("This is free and unencumbered software released into the public domain.",),
    "AGPL-3.0": (
        "This work is licensed under the GNU Affero General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    "CC-BY-SA-4.0": (
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
        "Licensed under CC BY-SA 4.0.",
    ),
    "CC0-1.0": ("To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",),
    "EPL-2.0": ("This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0",),
    "GPL-2.0": (
        "This work is licensed under the GNU General Public License, version 2.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    ),
    "ISC": ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",),
    "LGPL-2.1": ("This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",),
    "LGPL-3.0": ("This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",),
}
_WORD = re.compile(r"[^\W_]+")


def templates() -> dict[str, tuple[str, ...]]:
    """The notices and the whole licences, by name."""
    out = dict(TEMPLATES)
    for file in sorted((Path(__file__).parent / "templates").glob("*.txt")):
        out[file.stem] = (*out.get(file.stem, ()), file.read_text())
    return out


def normal(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def bigrams(words: list[str]) -> list[tuple[str, str]]:
    return list(pairwise(words))


def dice(a: Counter, b: Counter) -> float:
    """Of two multisets."""
    size = a.total() + b.total()
    return 2 * (a & b).total() / size if size else 0.0


class Scanner:
    def __init__(self, forms: dict[str, tuple[str, ...]], least: float):
        self.least = least
        own = [(name, bigrams(normal(t))) for name, ts in sorted(forms.items()) for t in ts]
        self.names, self.sizes = [name for name, _ in own], np.array([len(b) for _, b in own], np.int64)
        self.codes: dict[tuple[str, str], int] = {}
        for _, b in own:
            for x in b:
                self.codes.setdefault(x, len(self.codes))
        self.counts = np.zeros((len(self.codes), len(own)), np.int32)
        for k, (_, b) in enumerate(own):
            for x, c in Counter(b).items():
                self.counts[self.codes[x], k] = c
        # the fewest bigrams of a passage that can reach the least coefficient, and of the template's in it
        self.fewest = np.maximum(1, np.ceil(least * self.sizes / (2 - least) - 1e-9)).astype(np.int64)

    def left(self, codes: np.ndarray, size: int) -> np.ndarray:
        """The templates that a text of so many bigrams can hold, by the bigrams it has of the templates'."""
        there, many = np.unique(codes, return_counts=True)
        shared = np.minimum(many[:, None], self.counts[there]).sum(axis=0)
        return np.flatnonzero((size >= self.fewest) & (shared >= self.fewest))

    def _share(self, codes: list[int], k: int) -> int:
        need = self.counts[:, k]
        return sum(min(c, int(need[x])) for x, c in Counter(codes).items())

    def _best_window(self, coded: list[int], k: int) -> int:
        """The most of the template's bigrams in a window of its length (of the whole text, if that is shorter)."""
        need, size = self.counts[:, k].tolist(), int(self.sizes[k])
        have: dict[int, int] = {}
        shared = best = 0
        for i, x in enumerate(coded):
            if x >= 0 and need[x]:
                have[x] = n = have.get(x, 0) + 1
                if n <= need[x]:
                    shared += 1
                    best = max(best, shared)
            if i >= size and (y := coded[i - size]) >= 0 and need[y]:
                have[y] = n = have[y] - 1
                if n < need[y]:
                    shared -= 1
        return best

    def scan(self, text: str | None) -> dict[str, tuple[int, float]]:
        """Licences found, with the bigrams in common and the coefficient of the best passage."""
        found: dict[str, tuple[int, float]] = {}
        words = normal(text) if text else []
        get = self.codes.get
        coded = [get(x, -1) for x in pairwise(words)]
        hits = np.array([x for x in coded if x >= 0], np.int64)
        if not len(hits):
            return found
        left = self.left(hits, len(coded))
        if not len(left):
            return found
        lines = [[get(x, -1) for x in pairwise(normal(line))] for line in text.split("\n")] if "\n" in text else []
        for k in left.tolist():
            size, fewest = int(self.sizes[k]), int(self.fewest[k])
            common = self._best_window(coded, k)
            best = 2 * common / (min(len(coded), size) + size)
            for passage in (coded, *lines):
                # a passage of this size can't reach more than all of the smaller one in common
                if len(passage) >= fewest and 2 * min(len(passage), size) >= max(self.least, best) * (len(passage) + size):
                    c = self._share([x for x in passage if x >= 0], k)
                    best, common = max((best, common), (2 * c / (len(passage) + size), c))
            if best >= self.least:
                found[self.names[k]] = max((common, best), found.get(self.names[k], (0, 0.0)))
        return found


def _rows(forms: dict, least: float):
    def run(batches):
        scanner = Scanner(forms, least)
        for batch in batches:
            best, score, all_ = [], [], []
            for text in batch.column("text").to_pylist():
                found = scanner.scan(text)
                top = max(sorted(found), key=found.get) if found else None
                best.append(top)
                score.append(found[top][1] if found else 0.0)
                all_.append(",".join(sorted(found)))
            yield pa.record_batch([batch.column("doc_id"), pa.array(best, pa.string()), pa.array(score, pa.float64()), pa.array(all_, pa.string())], ["doc_id", "license", "dice", "licenses"])

    return run


def scan_licenses(docs: DataFrame, forms: dict | None = None, least: float = 0.8) -> DataFrame:
    """Per row: doc_id, license (the best, or null), dice, licenses (all found, by name, with commas)."""
    return by_arrow(docs.select("doc_id", "text"), _rows(forms or templates(), least), "doc_id bigint, license string, dice double, licenses string")
