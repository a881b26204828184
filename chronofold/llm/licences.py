"""Licence scan: a trained paragraph classifier, confirmed by template comparison.

A paragraph is the stretch of words around runs of three words that some licence template has; text
further away than GAP words starts another. Nothing else can be confirmed later, so nothing else is
classified. Its words (lower case, letters and digits only) give sparse hashed features, the
distinct runs of one, two and three words, for a multinomial logistic regression over the licence
families and an unknown class. The regression learns from the templates, worn in several ways, from
sentences that only speak of licences, and from a bounded sample of the corpus: of the ``sample``
documents with the smallest hash of their id, ``sample`` pieces that speak of licences and four times
as many of any kind, chosen by hash from all their lines, a piece being a line or STRETCH characters
of a longer one. Pieces that hold a good part of a template are left out.

A quarter of the examples is held back: a temperature is fitted to them, and the least probability
a family needs is set so that no more than FALSE_ALARMS of the held-back unknown ones pass. A
prediction counts when a template of the family has at least ``confirm`` of its word triples in the
paragraph, and as many of those that no other family has, so that families whose notices differ in a
word are told apart. A paragraph whose every grant is denied ("is not licensed under") is no notice.
All else is unknown and not reported.

Null text and text without words: no finds, a row with zeros all the same. Rows are scanned one by
one, whole texts, repeated rows alike. No documents: no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.linalg import SparseVector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronofold.llm.flat import byte_hashes, mix, pieces, run_hashes, words

SAMPLE = 2_000
GAP = 30
MARGIN = 6
BUCKETS = 1 << 14
FALSE_ALARMS = 0.002
STRETCH = 400
PART = 0.3  # of a template's runs, from which on a piece of the corpus is no unknown example

#: Usual notices of each family.
TEMPLATES: dict[str, tuple[str, ...]] = {
    "agpl": (
        "licensed under the GNU Affero General Public License version 3",
        "you can redistribute it and/or modify it under the terms of the GNU Affero General Public "
        "License as published by the Free Software Foundation",
        "AGPLv3 licensed",
        "SPDX-License-Identifier AGPL-3.0-only",
        "SPDX-License-Identifier AGPL-3.0-or-later",
    ),
    "apache-2.0": (
        "licensed under the Apache License Version 2.0",
        "you may not use this file except in compliance with the License you may obtain a copy of "
        "the License at http www apache org licenses LICENSE-2.0",
        "released under the Apache License 2.0",
        "uses the Apache License 2.0",
        "License Apache-2.0",
        "SPDX-License-Identifier Apache-2.0",
    ),
    "bsd": (
        "released under the BSD License",
        "licensed under the 2-clause BSD License",
        "licensed under the 3-clause BSD License",
        "redistribution and use in source and binary forms with or without modification are "
        "permitted provided that the following conditions are met",
        "SPDX-License-Identifier BSD-2-Clause",
        "SPDX-License-Identifier BSD-3-Clause",
    ),
    "cc-by": (
        "licensed under CC BY 4.0",
        "this work is licensed under a Creative Commons Attribution 4.0 International License",
        "SPDX-License-Identifier CC-BY-4.0",
    ),
    "cc-by-nc": (
        "licensed under CC BY-NC 4.0",
        "this work is licensed under a Creative Commons Attribution-NonCommercial 4.0 "
        "International License",
        "SPDX-License-Identifier CC-BY-NC-4.0",
    ),
    "cc-by-nc-nd": (
        "licensed under CC BY-NC-ND 4.0",
        "this work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 "
        "International License",
        "SPDX-License-Identifier CC-BY-NC-ND-4.0",
    ),
    "cc-by-nc-sa": (
        "licensed under CC BY-NC-SA 4.0",
        "this work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 "
        "International License",
        "SPDX-License-Identifier CC-BY-NC-SA-4.0",
    ),
    "cc-by-nd": (
        "licensed under CC BY-ND 4.0",
        "this work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International "
        "License",
        "SPDX-License-Identifier CC-BY-ND-4.0",
    ),
    "cc-by-sa": (
        "licensed under CC BY-SA 4.0",
        "this work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International "
        "License",
        "SPDX-License-Identifier CC-BY-SA-4.0",
    ),
    "cc0": (
        "to the extent possible under law the author has waived all copyright and related rights",
        "released under CC0 1.0 Universal public domain dedication",
        "SPDX-License-Identifier CC0-1.0",
    ),
    "epl-2.0": (
        "this program and the accompanying materials are made available under the terms of the "
        "Eclipse Public License 2.0",
        "licensed under the Eclipse Public License version 2.0",
        "SPDX-License-Identifier EPL-2.0",
    ),
    "gpl": (
        "this work is licensed under the GNU General Public License version 3",
        "you can redistribute it and/or modify it under the terms of the GNU General Public License "
        "as published by the Free Software Foundation",
        "licensed under the GNU General Public License version 2",
        "GPLv2 licensed",
        "GPLv3 licensed",
        "SPDX-License-Identifier GPL-2.0-only",
        "SPDX-License-Identifier GPL-2.0-or-later",
        "SPDX-License-Identifier GPL-3.0-only",
        "SPDX-License-Identifier GPL-3.0-or-later",
    ),
    "isc": (
        "released under the ISC License",
        "permission to use copy modify and/or distribute this software for any purpose with or "
        "without fee is hereby granted",
        "SPDX-License-Identifier ISC",
    ),
    "lgpl": (
        "licensed under the GNU Lesser General Public License version 3",
        "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public "
        "License as published by the Free Software Foundation",
        "SPDX-License-Identifier LGPL-2.1-only",
        "SPDX-License-Identifier LGPL-2.1-or-later",
        "SPDX-License-Identifier LGPL-3.0-only",
        "SPDX-License-Identifier LGPL-3.0-or-later",
    ),
    "mit": (
        "released under the MIT License",
        "licensed under the MIT License",
        "permission is hereby granted free of charge to any person obtaining a copy of this "
        "software and associated documentation files to deal in the software without restriction",
        "License MIT",
        "SPDX-License-Identifier MIT",
    ),
    "mpl-2.0": (
        "this source code form is subject to the terms of the Mozilla Public License v 2.0",
        "licensed under the Mozilla Public License Version 2.0",
        "SPDX-License-Identifier MPL-2.0",
    ),
    "unlicense": (
        "this is free and unencumbered software released into the public domain",
        "SPDX-License-Identifier Unlicense",
    ),
}
#: Words that grant, and words before them that deny it.
GRANTS = ("licensed", "released", "distributed", "available")
DENIALS = ("not", "never", "isnt", "arent", "wasnt", "werent", "longer", "neither", "nor")
#: Sentences that speak of licences without granting one.
MENTIONS = (
    "he lost his driving license under the new law in version of the story told here",
    "the general public was asked to license under a new scheme of the city",
    "the license at the door of the pub was granted free of charge by the council",
    "licensed under the counter and sold to any person who asked for a copy",
    "this work is done and the terms of the contract are met without modification",
    "the apache people lived here long before any version was written down",
    "released under the bridge at night the prisoners walked to the public square",
    "copyright law is taught in the second year of the course at the school",
)
ABOUT = "licen[sc]|copyright|gnu|creative commons|warrant|public domain|spdx"
UNKNOWN = 0
FAMILIES = tuple(sorted(TEMPLATES))

_WORD_BYTE = np.zeros(256, dtype=bool)
_WORD_BYTE[[*range(48, 58), *range(65, 91), *range(97, 123), *range(0x80, 0x100)]] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32


def _bare(data: np.ndarray, offsets: np.ndarray):
    """Hashes of the words without signs, their owners; words of signs only are left out."""
    found = words(data, offsets)
    keep = _WORD_BYTE[data]
    before = np.concatenate([[0], np.cumsum(keep)])
    start, end = before[found.start], before[found.end]
    solid = end > start
    hashes = byte_hashes(_FOLD[data][keep], start, end)[solid]
    return hashes, found.owner()[solid], found.start[solid], found.end[solid]


def _of(text: str) -> np.ndarray:
    data = np.frombuffer(text.encode(), dtype=np.uint8)
    return _bare(data, np.array([0, len(data)]))[0]


def _runs(hashes: np.ndarray, k: int) -> np.ndarray:
    return run_hashes(hashes, np.arange(max(len(hashes) - k + 1, 0)), k)


def _columns(hashes: np.ndarray) -> np.ndarray:
    """Distinct feature columns of a paragraph."""
    every = [mix(_runs(hashes, k) + np.uint64(k)) for k in (1, 2, 3)]
    return np.unique(np.concatenate(every) % np.uint64(BUCKETS)).astype(np.int64)


@dataclass
class Scanner:
    weights: np.ndarray  # (classes, BUCKETS)
    bias: np.ndarray
    temperature: float
    least: float
    confirm: float

    def __post_init__(self) -> None:
        runs: dict[int, list] = {}  # by length, (template, distinct runs)
        self.family: list[int] = []  # of each template
        for number, name in enumerate(FAMILIES, start=1):
            for text in TEMPLATES[name]:
                whole = _of(text)
                k = min(len(whole), 3)
                runs.setdefault(k, []).append((len(self.family), np.unique(_runs(whole, k))))
                self.family.append(number)
        self.known = {k: np.unique(np.concatenate([r for _, r in rs])) for k, rs in runs.items()}
        self.first, total = {}, 0  # rows of each length's runs in the matrix
        for k, known in self.known.items():
            self.first[k], total = total, total + len(known)
        self.has = np.zeros((total, len(self.family)), dtype=bool)  # (run, template)
        for k, rs in runs.items():
            for template, own in rs:
                self.has[self.first[k] + np.searchsorted(self.known[k], own), template] = True
        self.runs_of = self.has.sum(axis=0)
        of_family = np.zeros((total, len(FAMILIES) + 1), dtype=bool)
        for template, number in enumerate(self.family):
            of_family[:, number] |= self.has[:, template]
        self.telling = self.has & (of_family.sum(axis=1) == 1)[:, None]
        self.telling_of = self.telling.sum(axis=0)
        self.grants = np.sort(np.concatenate([_of(word) for word in GRANTS]))
        self.denials = np.sort(np.concatenate([_of(word) for word in DENIALS]))

    def probabilities(self, hashes: np.ndarray) -> np.ndarray:
        columns = _columns(hashes)
        scale = self.temperature * np.sqrt(max(len(columns), 1))
        logit = (self.weights[:, columns].sum(axis=1) + self.bias * np.sqrt(len(columns))) / scale
        e = np.exp(logit - logit.max())
        return e / e.sum()

    def judge(self, hashes: np.ndarray, shares: np.ndarray) -> tuple[str, float, float] | None:
        """Family, its probability and the best template's share of runs in the stretch."""
        p = self.probabilities(hashes)
        best = int(p.argmax())
        if best == UNKNOWN or p[best] < self.least:
            return None
        share = float(shares[best])
        return (FAMILIES[best - 1], float(p[best]), share) if share >= self.confirm else None

    def denied(self, hashes: np.ndarray, lo: int, hi: int, low: int) -> bool:
        """Whether words lo to hi grant something and each grant is denied, at most two words before;
        ``low`` is the first word that may deny."""
        grants = lo + np.flatnonzero(np.isin(hashes[lo:hi], self.grants))
        denials = low + np.flatnonzero(np.isin(hashes[low:hi], self.denials))
        before = grants[:, None] - denials[None, :]
        return len(grants) > 0 and bool(((before > 0) & (before <= 2)).any(axis=1).all())

    def shares(self, place: np.ndarray) -> np.ndarray:
        """Per class, the best template's share of its runs among these; 0 for the unknown one and
        for templates with less than ``confirm`` of the runs that no other family has."""
        at = np.unique(place)
        share = self.has[at].sum(axis=0) / self.runs_of
        telling = self.telling[at].sum(axis=0) >= self.confirm * self.telling_of
        best = np.zeros(len(FAMILIES) + 1)
        np.maximum.at(best, self.family, np.where(telling, share, 0.0))
        return best

    def cuts(self, at: np.ndarray, place: np.ndarray, shares: np.ndarray) -> list[int]:
        """Words where the runs of a confirmed family change to those of another."""
        confirmed = np.flatnonzero(shares >= self.confirm)
        if len(confirmed) < 2:
            return []
        own = np.stack([self.has[place][:, np.equal(self.family, f)].any(axis=1) for f in confirmed])
        telling = np.flatnonzero(own.sum(axis=0) == 1)
        whose = own[:, telling].argmax(axis=0)
        found = []
        for i in np.flatnonzero(np.diff(whose)):
            between = at[telling[i] : telling[i + 1] + 1]
            gaps = np.diff(between)
            found.append(int(between[len(gaps) - int(gaps[::-1].argmax())]))  # the last widest
        return found

    def paragraphs(
        self, hashes: np.ndarray, owner: np.ndarray
    ) -> Iterator[tuple[list[tuple[int, int]], np.ndarray]]:
        """Stretches of words round template runs: their paragraphs and their shares."""
        every, places, ends = [], [], []
        for k, known in self.known.items():
            at = np.arange(max(len(hashes) - k + 1, 0))
            at = at[owner[at] == owner[at + k - 1]] if len(at) else at
            value = run_hashes(hashes, at, k)
            place = np.minimum(np.searchsorted(known, value), len(known) - 1)
            hit = known[place] == value
            every.append(at[hit])
            places.append(self.first[k] + place[hit])
            ends.append(at[hit] + k)
        at, place, stop = (np.concatenate(x) for x in (every, places, ends))
        if not len(at):
            return
        order = np.argsort(at, kind="stable")
        at, place, stop = at[order], place[order], stop[order]
        new = np.concatenate([[True], (np.diff(at) > GAP) | (owner[at[1:]] != owner[at[:-1]])])
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(at))
        low = np.searchsorted(owner, owner[at[first]], side="left")
        high = np.searchsorted(owner, owner[at[first]], side="right")
        begin = np.maximum(at[first] - MARGIN, low)
        for i, (f, t) in enumerate(zip(first.tolist(), last.tolist(), strict=True)):
            shares = self.shares(place[f:t])
            end = int(min(stop[f:t].max() + MARGIN, high[i]))
            marks = sorted({int(begin[i]), *self.cuts(at[f:t], place[f:t], shares), end})
            yield list(zip(marks[:-1], marks[1:], strict=True)), shares

    def part_of_template(self, text: str) -> bool:
        """Whether a text holds PART of some template's runs, and one that no other family has."""
        hashes = _of(text)
        for k, known in self.known.items():
            runs = np.unique(_runs(hashes, k))
            place = self.first[k] + np.flatnonzero(np.isin(known, runs))
            share = self.has[place].sum(axis=0) / self.runs_of
            if ((share >= PART) & self.telling[place].any(axis=0)).any():
                return True
        return False

    def found(
        self, hashes: np.ndarray, parts: list[tuple[int, int]], shares: np.ndarray
    ) -> list[tuple[int, int, tuple[str, float, float]]]:
        """Finds in the paragraphs of a stretch, or else the one of the whole stretch."""
        for spans in (parts, [(parts[0][0], parts[-1][1])]):
            judged = [
                (lo, hi, self.judge(hashes[lo:hi], shares))
                for lo, hi in spans
                if not self.denied(hashes, lo, hi, max(lo - 2, parts[0][0]))
            ]
            if any(find for _, _, find in judged) or len(parts) == 1:
                break
        return [x for x in judged if x[2]]


def _examples(negatives: list[str], seed: int = 11) -> list[tuple[int, np.ndarray]]:
    """(class, columns) of worn templates, mentions and corpus stretches."""
    rng = np.random.default_rng(seed)
    corpus = [h for h in (_of(t) for t in negatives) if len(h)]
    filler = np.concatenate([*corpus, _of(" ".join(MENTIONS))])

    def some(n: int) -> np.ndarray:
        at = int(rng.integers(0, max(len(filler) - n, 1)))
        return filler[at : at + n]

    out = []
    for number, name in enumerate(FAMILIES, start=1):
        for text in TEMPLATES[name]:
            whole = _of(text)
            for turn in range(40):
                kept = whole[rng.random(len(whole)) > (0.0 if turn % 4 == 0 else 0.12)]
                parts = [some(int(rng.integers(0, MARGIN + 1))), kept]
                parts.append(some(int(rng.integers(0, MARGIN + 1))))
                out.append((number, _columns(np.concatenate(parts))))
    for text in MENTIONS:
        whole = _of(text)
        for _ in range(40):
            kept = whole[rng.random(len(whole)) > 0.1]
            out.append((UNKNOWN, _columns(np.concatenate([some(3), kept, some(4)]))))
    for hashes in corpus:
        at = int(rng.integers(0, max(len(hashes) - 20, 1)))
        out.append((UNKNOWN, _columns(hashes[at : at + int(rng.integers(6, 30))])))
    order = rng.permutation(len(out))
    return [out[i] for i in order]


def fit(docs: DataFrame, sample: int = SAMPLE, confirm: float = 0.6) -> Scanner:
    """A scanner that learnt the corpus's own words as unknown ones."""
    spark = docs.sparkSession
    named = docs.where(F.col("text").isNotNull() & F.col("doc_id").isNotNull())
    ids = named.select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    cut = F.regexp_extract_all("text", F.lit(f"[^\\n]{{1,{STRETCH}}}"), 0)
    stretches = (
        named.select("doc_id", "text")
        .join(F.broadcast(ids.distinct()), "doc_id")  # ``sample`` ids at most
        .select("doc_id", F.posexplode(cut).alias("at", "text"))
    )
    chance = (F.xxhash64("doc_id", "at"), "doc_id", "at", "text")
    about = stretches.where(F.lower("text").rlike(ABOUT)).orderBy(*chance).limit(sample)
    others = stretches.orderBy(*chance).limit(4 * sample)
    # at most 5 * sample pieces of STRETCH characters, for training only
    chosen = about.unionByName(others).select("text").distinct().collect()
    bare = Scanner(np.zeros((0, 0)), np.zeros(0), 1.0, 0.0, confirm)
    examples = _examples(sorted(r["text"] for r in chosen if not bare.part_of_template(r["text"])))
    held = examples[::4]
    training = [e for i, e in enumerate(examples) if i % 4]
    rows = [
        (float(c), SparseVector(BUCKETS, x.tolist(), [1 / np.sqrt(len(x))] * len(x)))
        for c, x in training
    ]
    model = LogisticRegression(
        family="multinomial", regParam=1e-4, maxIter=60, standardization=False
    ).fit(spark.createDataFrame(rows, ["label", "features"]).coalesce(4))
    weights = model.coefficientMatrix.toArray()
    scanner = Scanner(weights, model.interceptVector.toArray(), 1.0, 0.0, confirm)
    logits = np.array(
        [weights[:, x].sum(axis=1) / np.sqrt(len(x)) + scanner.bias for _, x in held]
    )
    truth = np.array([c for c, _ in held])

    def chances(t: float) -> np.ndarray:
        e = np.exp((logits - logits.max(axis=1, keepdims=True)) / t)
        return e / e.sum(axis=1, keepdims=True)

    def loss(t: float) -> float:
        return float(-np.log(chances(t)[np.arange(len(truth)), truth] + 1e-12).mean())

    scanner.temperature = min(np.geomspace(0.1, 5, 40).tolist(), key=loss)
    family = chances(scanner.temperature)[truth == UNKNOWN][:, 1:].max(axis=1, initial=0.0)
    scanner.least = max(0.5, float(np.quantile(family, 1 - FALSE_ALARMS)) if len(family) else 0.5)
    return scanner


_FINDS = (
    "doc_id long, n_paragraphs long, finds array<struct<begin:long, end:long, family:string, "
    "probability:double, share:double>>"
)


def _scan(scanner: Scanner):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in pieces(batches, "text"):
            hashes, owner, start, end = _bare(data, offsets)
            finds: list[list[dict]] = [[] for _ in range(batch.num_rows)]
            tried = np.zeros(batch.num_rows, dtype=np.int64)
            for parts, shares in scanner.paragraphs(hashes, owner):
                row = int(owner[parts[0][0]])
                tried[row] += len(parts)
                for lo, hi, found in scanner.found(hashes, parts, shares):
                    place = {"begin": start[lo] - offsets[row], "end": end[hi - 1] - offsets[row]}
                    names = ("family", "probability", "share")
                    finds[row].append(place | dict(zip(names, found, strict=True)))
            kind = pa.list_(
                pa.struct(
                    [
                        ("begin", pa.int64()),
                        ("end", pa.int64()),
                        ("family", pa.string()),
                        ("probability", pa.float64()),
                        ("share", pa.float64()),
                    ]
                )
            )
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(tried), pa.array(finds, kind)],
                ["doc_id", "n_paragraphs", "finds"],
            )

    return run


def scan(docs: DataFrame, scanner: Scanner) -> DataFrame:
    """Per row: ``doc_id``, paragraphs tried, and confirmed finds with byte spans."""
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return base.mapInArrow(_scan(scanner), _FINDS)


def families(found: DataFrame) -> DataFrame:
    names = F.array_sort(F.array_distinct(F.transform("finds", lambda x: x["family"])))
    return found.select(
        "doc_id",
        "n_paragraphs",
        F.size("finds").cast("long").alias("n_licences"),
        F.array_join(names, ",").alias("families"),
    )
