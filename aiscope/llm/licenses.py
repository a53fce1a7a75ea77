"""Licence scan of text with a trained paragraph classifier.

A multinomial logistic regression over hashed word n-grams tells licence
families, ``unknown`` (licence wording of no known family) and ``none`` apart.
It is trained here, on variations of the fixed notices below and on a bounded
sample of the corpus as negatives.  Its probabilities are calibrated by a
temperature on variations that were held out.  A family is reported only when
the paragraph also contains enough of one of the family's templates, whose word
pairs weigh the less the more families share them: what only frames a licence's
name confirms none.  A paragraph may name several families; a confident licence
paragraph that confirms none is reported as unknown.

A text is read twice: by lines, and by blocks of lines up to a blank one, so
that a wrapped notice is judged as a whole; both are cut at sentence ends.  Of
findings that overlap the one that covers more of its template counts.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aiscope.llm.toxicity import bounded_sample
from aiscope.llm.words import LOWER, Block, blocks, mix, span_hashes, split_words

#: The most corpus paragraphs taken as negatives, and documents they come from.
NEGATIVE_PARAGRAPHS, NEGATIVE_DOCS = 2_000, 1_000
FEATURE_BITS = 16
#: Probability of any licence from which a paragraph is reported; share of a template's word pairs that confirms a family.
REPORT, CONFIRM = 0.6, 0.6
NONE, UNKNOWN = "none", "unknown"

# Fixed notices by family: sentences of licence texts, usual notices and identifiers.
TEMPLATES: dict[str, list[str]] = {
    "Apache-2.0": ["licensed under the apache license version 2.0", "you may not use this file except in compliance with the license", "distributed under the terms of the apache license 2.0", "spdx license identifier apache 2.0", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind", "you may obtain a copy of the license at http www.apache.org licenses license 2.0"],
    "MIT": ["released under the mit license", "licensed under the mit license", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "spdx license identifier mit", "this project is distributed under the terms of the mit license", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement"],
    "ISC": ["permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies", "licensed under the isc license", "released under the terms of the isc license", "spdx license identifier isc"],
    "BSD": ["redistribution and use in source and binary forms with or without modification are permitted", "licensed under the bsd license", "licensed under the 3 clause bsd license", "licensed under the 2 clause bsd license", "use of this source code is governed by a bsd style license", "spdx license identifier bsd 3 clause", "spdx license identifier bsd 2 clause", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"],
    "Zlib": ["this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software", "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely", "licensed under the zlib license", "spdx license identifier zlib"],
    "BSL-1.0": ["distributed under the boost software license version 1.0", "licensed under the boost software license", "spdx license identifier bsl 1.0"],
    "GPL": ["this work is licensed under the gnu general public license version 3", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", "licensed under the gnu general public license version 2", "released under the gpl version 3", "spdx license identifier gpl 3.0 only", "spdx license identifier gpl 2.0 or later", "you should have received a copy of the gnu general public license along with this program", "licensed under the gpl v2 or later"],
    "LGPL": ["licensed under the gnu lesser general public license", "under the terms of the gnu lesser general public license version 2.1", "spdx license identifier lgpl 2.1", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license", "released under the lgpl version 3"],
    "AGPL": ["licensed under the gnu affero general public license version 3", "under the terms of the gnu affero general public license", "spdx license identifier agpl 3.0", "released under the agpl version 3"],
    "MPL-2.0": ["this source code form is subject to the terms of the mozilla public license v 2.0", "licensed under the mozilla public license version 2.0", "spdx license identifier mpl 2.0", "if a copy of the mpl was not distributed with this file you can obtain one at http mozilla.org mpl 2.0"],
    "EPL-2.0": ["this program and the accompanying materials are made available under the terms of the eclipse public license 2.0", "licensed under the eclipse public license version 2.0", "licensed under the eclipse public license v1.0", "spdx license identifier epl 2.0"],
    "CDDL": ["the contents of this file are subject to the terms of the common development and distribution license", "licensed under the common development and distribution license", "spdx license identifier cddl 1.0"],
    "Artistic-2.0": ["licensed under the artistic license 2.0", "you can redistribute it and or modify it under the terms of the artistic license", "spdx license identifier artistic 2.0"],
    "OFL-1.1": ["this font software is licensed under the sil open font license version 1.1", "licensed under the sil open font license", "spdx license identifier ofl 1.1"],
    "Unlicense": ["this is free and unencumbered software released into the public domain", "anyone is free to copy modify publish use compile sell or distribute this software", "released under the unlicense", "spdx license identifier unlicense"],
    "CC-BY": ["licensed under cc by 4.0", "this work is licensed under a creative commons attribution 4.0 international license", "licensed under a creative commons attribution license"],
    "CC-BY-SA": ["licensed under cc by sa 4.0", "this work is licensed under a creative commons attribution sharealike 4.0 international license", "text is available under the creative commons attribution sharealike license"],
    "CC-BY-NC": ["licensed under cc by nc 4.0", "this work is licensed under a creative commons attribution noncommercial 4.0 international license"],
    "CC-BY-ND": ["licensed under cc by nd 4.0", "this work is licensed under a creative commons attribution noderivatives 4.0 international license"],
    "CC-BY-NC-SA": ["licensed under cc by nc sa 4.0", "this work is licensed under a creative commons attribution noncommercial sharealike 4.0 international license"],
    "CC-BY-NC-ND": ["licensed under cc by nc nd 4.0", "this work is licensed under a creative commons attribution noncommercial noderivatives 4.0 international license"],
    "CC0": ["dedicated to the public domain under cc0 1.0", "to the extent possible under law the author has waived all copyright and related rights", "released into the public domain", "licensed under cc0 1.0 universal"],
    "proprietary": ["all rights reserved no part of this publication may be reproduced", "confidential and proprietary do not distribute", "unauthorized copying of this file is strictly prohibited", "this document contains proprietary information and may not be disclosed without written permission"],
}
# Fixed identifiers by family, as they follow "licence" or a tag; the frames around them are below.
IDENTIFIERS: dict[str, list[str]] = {
    "Apache-2.0": ["apache 2.0"], "MIT": ["mit"], "ISC": ["isc"], "BSD": ["bsd 3 clause", "bsd 2 clause", "0bsd"], "Zlib": ["zlib"], "BSL-1.0": ["bsl 1.0"],
    "GPL": ["gpl 2.0", "gpl 2.0 only", "gpl 2.0 or later", "gpl 3.0", "gpl 3.0 only", "gpl 3.0 or later", "gplv2", "gplv3"], "LGPL": ["lgpl 2.1", "lgpl 2.1 only", "lgpl 2.1 or later", "lgpl 3.0", "lgpl 3.0 only", "lgpl 3.0 or later"],
    "AGPL": ["agpl 3.0", "agpl 3.0 only", "agpl 3.0 or later"], "MPL-2.0": ["mpl 2.0"], "EPL-2.0": ["epl 2.0"], "CDDL": ["cddl 1.0", "cddl 1.1"], "Artistic-2.0": ["artistic 2.0"], "OFL-1.1": ["ofl 1.1"], "Unlicense": ["unlicense"],
    "CC-BY": ["cc by 4.0"], "CC-BY-SA": ["cc by sa 4.0"], "CC-BY-NC": ["cc by nc 4.0"], "CC-BY-ND": ["cc by nd 4.0"], "CC-BY-NC-SA": ["cc by nc sa 4.0"], "CC-BY-NC-ND": ["cc by nc nd 4.0"], "CC0": ["cc0 1.0"],
}
FRAMES = ["spdx license identifier {}", "license {}", "licensed under {}", "licensed under {} and", "licensed under and {}", "licensed under {} or", "licensed under or {}", "{} license", "the {} license"]
#: The notices above, which are trained on in more variations than the many that identifiers and frames make up.
SPOKEN = frozenset(t for several in TEMPLATES.values() for t in several)
for _family, _names in IDENTIFIERS.items():
    TEMPLATES[_family] = list(dict.fromkeys([*TEMPLATES[_family], *(f.format(n) for n in _names for f in FRAMES)]))
#: Wording of licences that name no known family.
UNKNOWN_TEMPLATES = ["spdx license identifier custom", "spdx license identifier other", "license other", "licensed under the terms of the custom license", "this software is licensed under its own license agreement", "use of this work is subject to the license terms", "released under a source available license version 1", "see the license file for the terms", "distributed under the community license agreement", "licensed to you under the following terms"]

CLASSES = (NONE, UNKNOWN, *TEMPLATES)
STOPS = np.ones(256, dtype=bool)
STOPS[48:58] = STOPS[65:91] = STOPS[97:123] = STOPS[128:] = False
STOPS[46] = False  # keeps version numbers whole; a final dot is cut off below


@dataclass
class Grams:
    """Word n-grams of one, two and three words of every paragraph of a block."""

    paragraph: np.ndarray  # of each gram
    feature: np.ndarray
    pair: np.ndarray  # hash where the gram is a word pair, else 0
    row: np.ndarray  # of each paragraph
    start: np.ndarray  # of each paragraph, in bytes of the block
    end: np.ndarray


def grams(block: Block, wrapped: bool = False) -> Grams:
    """Paragraphs are lines, or ``wrapped`` blocks of lines up to a blank one; both are cut at sentence ends, so that a notice inside prose stands alone."""
    words = split_words(block, STOPS)
    end = words.end.copy()
    if not len(end):
        empty = np.zeros(0, dtype=np.int64)
        return Grams(empty, empty, empty.astype(np.uint64), empty, empty, empty)
    data = LOWER[block.data]
    dotted = data[end - 1] == 46
    end[dotted] -= 1
    kept = end > words.start
    start, end, row, dotted = words.start[kept], end[kept], words.row[kept], dotted[kept]
    if not len(end):
        empty = np.zeros(0, dtype=np.int64)
        return Grams(empty, empty, empty.astype(np.uint64), empty, empty, empty)
    hashes = span_hashes(data, start, end)
    lines = np.concatenate(([0], np.cumsum(block.data == 10)))
    new = np.ones(len(start), dtype=bool)
    apart = lines[start[1:]] - lines[end[:-1]]  # a blank line is two line ends with only comment marks between
    new[1:] = (row[1:] != row[:-1]) | (apart > (1 if wrapped else 0)) | dotted[:-1]
    paragraph = np.cumsum(new) - 1
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(start)) - 1
    parts, values, pairs = [paragraph], [hashes], [np.zeros(len(hashes), np.uint64)]
    with np.errstate(over="ignore"):
        for size in (2, 3):
            n = len(hashes) - size + 1
            if n > 0:
                value = mix(sum((hashes[i : n + i] * np.uint64(2 * i + 3) for i in range(size)), np.zeros(n, np.uint64)))
                same = paragraph[:n] == paragraph[size - 1 :]
                parts.append(paragraph[:n][same])
                values.append(value[same])
                pairs.append(value[same] if size == 2 else np.zeros(int(same.sum()), np.uint64))
    value = np.concatenate(values)
    feature = (value >> np.uint64(64 - FEATURE_BITS)).astype(np.int64)
    return Grams(np.concatenate(parts), feature, np.concatenate(pairs), row[first], start[first], end[last])


def _block_of(texts: list[str]) -> Block:
    encoded = [t.encode() for t in texts]
    offsets = np.concatenate(([0], np.cumsum([len(t) for t in encoded])))
    rows = pa.RecordBatch.from_arrays([pa.array(range(len(texts)))], names=["id"])
    return Block(rows, np.frombuffer(b"".join(encoded), dtype=np.uint8), offsets)


def _variations(rng: np.random.Generator, text: str, filler: list[str], n: int) -> list[str]:
    """The text with words dropped, and with corpus words before and after."""
    out = [text]
    words = text.split()
    for _ in range(n - 1):
        kept = [w for w in words if rng.random() > 0.08] or words
        before = [filler[i] for i in rng.integers(0, len(filler), rng.integers(0, 8))]
        after = [filler[i] for i in rng.integers(0, len(filler), rng.integers(0, 8))]
        out.append(" ".join(before + kept + after))
    return out


@dataclass
class LicenceModel:
    weights: np.ndarray  # features x classes
    bias: np.ndarray
    temperature: float
    pairs: np.ndarray  # sorted word-pair hashes of templates
    pair_of: np.ndarray  # pairs x templates, which template holds the pair
    weight: np.ndarray  # of each pair: the less, the more families have it
    sizes: np.ndarray  # weight of the pairs in each template
    family: np.ndarray  # class of each template

    def probabilities(self, sums: np.ndarray) -> np.ndarray:
        z = (sums + self.bias) / self.temperature
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def train(negatives: list[str], seed: int = 11, rounds: int = 80) -> LicenceModel:
    """Fit on variations of the fixed notices and on ``negatives``, a bounded sample of corpus paragraphs."""
    rng = np.random.default_rng(seed)
    filler = sorted({w for line in negatives for w in line.lower().split()}) or ["text"]
    texts, labels = [], []
    for name, several in [*TEMPLATES.items(), (UNKNOWN, UNKNOWN_TEMPLATES)]:
        for text in several:
            more = _variations(rng, text, filler, 10 if text in SPOKEN or name == UNKNOWN else 2)
            texts += more
            labels += [CLASSES.index(name)] * len(more)
    texts += [line.replace(".", " ") for line in negatives] + ["the version of the file", "public work under the terms", "all rights"]
    labels += [0] * (len(texts) - len(labels))
    found = grams(_block_of([t.replace("\n", " ") for t in texts]))
    text_of, feature = found.row[found.paragraph], found.feature
    # what stands in a single negative text tells nothing about others
    pairs_of = np.unique(np.stack((feature, text_of)), axis=1)
    several = np.bincount(pairs_of[0], minlength=1 << FEATURE_BITS) > 1
    several[pairs_of[0][np.array(labels)[pairs_of[1]] > 0]] = True
    text_of, feature = text_of[several[feature]], feature[several[feature]]
    keys, column = np.unique(feature, return_inverse=True)
    n, m, k = len(texts), len(keys), len(CLASSES)
    target = np.eye(k, dtype=np.float32)[labels]
    held = rng.random(n) < 0.2
    share = np.where(target.sum(0) > 0, n / (k * np.maximum(target.sum(0), 1)), 0)[labels] ** 0.5
    share[held] = 0
    length = np.sqrt(np.maximum(np.bincount(text_of, minlength=n), 1))
    scale = (1 / length[text_of]).astype(np.float32)
    share = share.astype(np.float32)
    weights, bias = np.zeros((m, k), dtype=np.float32), np.zeros(k, dtype=np.float32)
    memory_w, memory_b = np.full((m, k), 1e-8, dtype=np.float32), np.full(k, 1e-8, dtype=np.float32)
    order = np.argsort(column, kind="stable")
    edges = np.searchsorted(column[order], np.arange(m))
    by_text = np.argsort(text_of, kind="stable")
    text_edges = np.searchsorted(text_of[by_text], np.arange(n))
    has = np.bincount(text_of, minlength=n) > 0
    for _ in range(rounds):
        z = np.zeros((n, k), dtype=np.float32)
        z[has] = np.add.reduceat(weights[column[by_text]] * scale[by_text, None], text_edges[has])
        error = (_softmax(z + bias) - target) * share[:, None] / n
        gradient = np.add.reduceat(error[text_of[order]] * scale[order, None], edges) + 1e-6 * weights
        memory_w += gradient**2
        memory_b += error.sum(0) ** 2
        weights -= 0.5 * gradient / np.sqrt(memory_w)
        bias -= 0.5 * error.sum(0) / np.sqrt(memory_b)
    z = np.zeros((n, k))
    z[has] = np.add.reduceat(weights[column[by_text]] * scale[by_text, None], text_edges[has])
    z = (z + bias)[held]
    right = np.array(labels)[held]
    loss = lambda t: -np.log(_softmax(z / t)[np.arange(len(right)), right] + 1e-12).mean()
    temperature = min((0.25, 0.5, 0.75, 1.0, 1.5, 2.0, 3.0), key=loss) if len(right) else 1.0
    table = np.zeros((1 << FEATURE_BITS, k), dtype=np.float32)
    table[keys] = weights

    names = [(CLASSES.index(name), text) for name, several in [*TEMPLATES.items(), (UNKNOWN, UNKNOWN_TEMPLATES)] for text in several]
    got = grams(_block_of([text for _, text in names]))
    is_pair = got.pair != 0
    template_of, pair = got.row[got.paragraph[is_pair]], got.pair[is_pair]
    pairs = np.unique(pair)
    pair_of = np.zeros((len(pairs), len(names)), dtype=bool)
    pair_of[np.searchsorted(pairs, pair), template_of] = True
    family = np.array([c for c, _ in names])
    shared = np.array([len(set(family[row].tolist())) for row in pair_of])
    weight = 1 / shared.astype(float) ** 2
    return LicenceModel(table, bias, temperature, pairs, pair_of, weight, weight @ pair_of, family)


def _scan(block: Block, model: LicenceModel) -> list[tuple[int, int, int, tuple[str, ...], float, float]]:
    """(row, start, end, families, probability, share of a template) of what reads like a licence, in order of place; of overlapping ones the best."""
    every = sorted(_scan_paragraphs(block, model, False) + _scan_paragraphs(block, model, True), key=lambda x: (x[3] == (UNKNOWN,), -x[5], -len(x[3]), x[2] - x[1], x[0], x[1]))
    kept: list[tuple[int, int, int, tuple[str, ...], float, float]] = []
    taken: list[tuple[int, int, int]] = []  # sorted; they do not overlap
    for x in every:
        k = bisect_left(taken, (x[0], x[2], 0))
        if not (k and taken[k - 1][0] == x[0] and taken[k - 1][2] > x[1]):
            taken.insert(bisect_left(taken, x[:3]), x[:3])
            kept.append(x)
    return sorted(kept)


def _scan_paragraphs(block: Block, model: LicenceModel, wrapped: bool) -> list[tuple[int, int, int, tuple[str, ...], float, float]]:
    found = grams(block, wrapped)
    n = len(found.row)
    if not n:
        return []
    known = np.abs(model.weights).sum(axis=1) > 0
    hit = np.flatnonzero(known[found.feature])
    length = np.sqrt(np.maximum(np.bincount(found.paragraph, minlength=n), 1))
    # a paragraph whose grams give no licence class more than "none" cannot be one: look at evidence first
    lead = model.weights[:, 1:].max(axis=1) - model.weights[:, 0]
    bound = np.bincount(found.paragraph[hit], np.maximum(lead[found.feature[hit]], 0), minlength=n) / length
    floor = model.temperature * np.log(REPORT / (1 - REPORT) / (len(CLASSES) - 1))
    maybe = bound + model.bias[1:].max() - model.bias[0] >= floor
    hit = hit[maybe[found.paragraph[hit]]]
    picked, place = np.unique(found.paragraph[hit], return_inverse=True)
    if not len(picked):
        return []
    sums = np.zeros((len(picked), len(CLASSES)))
    for c in range(len(CLASSES)):
        sums[:, c] = np.bincount(place, model.weights[found.feature[hit], c], minlength=len(picked))
    p = model.probabilities(sums / length[picked, None])
    likely = np.flatnonzero(1 - p[:, 0] >= REPORT)
    out = []
    wanted = np.isin(found.paragraph, picked[likely]) & (found.pair != 0)
    of, pair = found.paragraph[wanted], found.pair[wanted]
    at = np.minimum(np.searchsorted(model.pairs, pair), len(model.pairs) - 1)
    in_table = model.pairs[at] == pair
    of, at = of[in_table], at[in_table]
    low, high = np.searchsorted(of, picked[likely]), np.searchsorted(of, picked[likely], side="right")  # pairs come in order of paragraphs
    for i, first, last in zip(likely.tolist(), low.tolist(), high.tolist()):
        own = np.unique(at[first:last])
        held = model.pair_of[own]
        cover = model.weight[own] @ held / model.sizes
        strong = (cover >= CONFIRM) & (model.family != CLASSES.index(UNKNOWN))
        parts = {c: held[:, strong & (model.family == c)].any(axis=1) for c in set(model.family[strong].tolist())}
        # a family whose evidence is all part of another's is only mentioned by it
        inside = lambda c, d: not (parts[c] & ~parts[d]).any() and (parts[d].sum(), -d) > (parts[c].sum(), -c)
        named = sorted(c for c in parts if not any(inside(c, d) for d in parts if d != c))
        if not named and len(own) < 2:  # a word or two of licence wording are no notice
            continue
        share = float(cover[strong].max()) if named else 0.0
        j = picked[i]
        out.append((int(found.row[j]), int(found.start[j]), int(found.end[j]), tuple(CLASSES[c] for c in named) or (UNKNOWN,), float(1 - p[i, 0]), share))
    return out


def _licence_batches(batches: Iterator[pa.RecordBatch], model: LicenceModel) -> Iterator[pa.RecordBatch]:
    for block in blocks(batches, "_text"):
        n = block.rows.num_rows
        points = None
        if len(block.data) and int(block.data.max()) >= 128:
            points = np.concatenate(([0], np.cumsum((block.data & 0xC0) != 0x80)))
        rows: list[list[dict]] = [[] for _ in range(n)]
        for row, start, end, families, score, _ in _scan(block, model):
            base = int(block.offsets[row])
            if points is not None:
                start, end, base = int(points[start]), int(points[end]), int(points[base])
            rows[row] += [{"family": family, "start": start - base, "end": end - base, "score": score} for family in families]
        kind = pa.list_(pa.struct([("family", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))
        yield pa.RecordBatch.from_arrays([block.column("doc_id"), pa.array(rows, kind)], names=["doc_id", "found"])


def find_licences(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``doc_id, found`` for every row: an array of (family, start, end, score), offsets in code points; a paragraph that names several families has an entry for each.

    Null and empty texts have none; an id may be null, repeated or of any type.
    Only the id and the text are read, so other columns may have any name.  The
    negatives of the classifier are at most ``NEGATIVE_PARAGRAPHS`` lines of 21
    to 600 code points from at most ``NEGATIVE_DOCS`` rows; every row is scanned
    whole.
    """
    sample = bounded_sample(docs, F.col(id_column), docs.count(), NEGATIVE_DOCS).where(F.col(text_column).isNotNull()).select(F.col(text_column).alias("t"))
    lines = sample.select(F.explode(F.split("t", "\n")).alias("line")).where(~F.col("line").rlike("(?i)licen[cs]|copyright|rights reserved"))
    lines = lines.where("length(line) between 21 and 600").orderBy(F.xxhash64("line"), "line").limit(NEGATIVE_PARAGRAPHS)
    model = docs.sparkSession.sparkContext.broadcast(train([r.line for r in lines.collect()]))
    source = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).cast("binary").alias("_text"))
    kind = source.schema["doc_id"].dataType.simpleString()
    return source.mapInArrow(lambda batches: _licence_batches(batches, model.value), f"doc_id {kind}, found array<struct<family:string,start:int,end:int,score:double>>")


def licences(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``doc_id, n_notices, families, spans`` for every row; families are distinct and sorted."""
    found = find_licences(docs, id_column, text_column)
    spans = F.array_join(F.transform("found", lambda x: F.concat_ws(":", x["family"], x["start"], x["end"])), ",")
    return found.select("doc_id", F.size("found").cast("long").alias("n_notices"), F.array_sort(F.array_distinct(F.col("found.family"))).alias("families"), spans.alias("spans"))
