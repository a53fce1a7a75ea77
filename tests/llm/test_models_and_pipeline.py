"""Trained operators on held-out rows, and the pipeline against its parts."""

import collections
import os
import sys

import numpy as np
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

from aiscope.llm import bytebpe, decontaminate, licenses, secrets, simhash, toxicity  # noqa: E402


def test_toxicity_on_held_out_rows(spark):
    folder = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    found = toxicity.toxicity(docs, labels).join(labels, "doc_id").where("held_out")
    seen = collections.Counter((r.toxic, r.predicted) for r in found.collect())
    # some labels of this table are wrong: a few toxic ones stand at clean texts
    assert seen[1, 1] / (seen[1, 1] + seen[0, 1]) > 0.97
    assert seen[1, 1] / (seen[1, 1] + seen[1, 0]) > 0.9
    assert seen[0, 1] <= 0.005 * (seen[0, 0] + seen[0, 1])


def test_label_model_finds_accuracies_and_correlations():
    rng = np.random.default_rng(2)
    truth = rng.random(40000) < 0.1
    votes = np.stack([np.where(truth, rng.random(40000) < hit, rng.random(40000) < miss) for hit, miss in ((0.9, 0.01), (0.8, 0.02), (0.7, 0.01), (0.6, 0.03))], axis=1)
    votes = np.column_stack((votes, votes[:, 3]))  # a copy of the last
    rows, counts = np.unique(votes, axis=0, return_counts=True)
    model = toxicity.fit_label_model(rows.astype(float), counts.astype(float), 0.2)
    assert np.abs(model.toxic[:3] - [0.9, 0.8, 0.7]).max() < 0.05
    assert abs(model.prior - 0.1) < 0.02 and model.weight[3] == model.weight[4] == 0.5


def test_labels_of_held_out_rows_are_not_used(spark, sf):
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    held = toxicity.remainder(F.col("doc_id"), 3) == 1
    turned = labels.withColumn("toxic", F.when(held, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    score = lambda table: {r.doc_id: round(r.score, 9) for r in toxicity.toxicity(docs, table).collect()}
    assert score(labels) == score(turned)


def test_licences(spark, sf):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    notices = {"GNU General Public": "GPL", "CC BY-NC": "CC-BY-NC", "MIT License": "MIT", "Apache License": "Apache-2.0"}
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in licenses.licences(docs).collect():
        want = {v for k, v in notices.items() if k in texts[r.doc_id]}
        assert want <= set(r.families) and set(r.families) - want <= {"unknown"}


def test_licence_spans_and_unknown_class(spark, sf):
    rows = [(1, "é prose.\nReleased under the MIT License.\nmore"), (2, "Nothing of the kind is said in this long line of text."), (3, None)]
    extra = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").limit(50)
    frame = spark.createDataFrame(rows, "doc_id long, text string").unionAll(extra.withColumn("doc_id", F.col("doc_id") + 1000))
    found = {r.doc_id: r.found for r in licenses.find_licences(frame).collect()}
    assert [(x.family, rows[0][1][x.start : x.end]) for x in found[1]] == [("MIT", "Released under the MIT License")]
    assert found[2] == [] and found[3] == []


#: Notices in other words than the templates', some wrapped, and text that is no licence.
HELD_OUT = [
    ("Apache-2.0", "Copyright 2021 Some Authors. Licensed under the Apache License,\nVersion 2.0 (the License); you may not use this\nfile except in compliance with the License."), ("Apache-2.0", "// SPDX-License-Identifier: Apache-2.0"), ("Apache-2.0", "This code is licensed under Apache License, Version 2.0 as found in the LICENSE file"),
    ("MIT", "MIT License\n\nCopyright (c) 2020 A. Author\n\nPermission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the Software), to deal in the Software without restriction"), ("MIT", "# SPDX-License-Identifier: MIT"), ("MIT", "The code in this folder is licensed under the MIT license, see the file next to it"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is hereby granted, provided that the above\ncopyright notice and this permission notice appear in all copies."), ("BSD", "Use of this source code is governed by a BSD-style\nlicense that can be found in the LICENSE file."), ("BSD", "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions are met:"),
    ("Zlib", "Permission is granted to anyone to use this software for any purpose,\nincluding commercial applications, and to alter it and redistribute it\nfreely, subject to the following restrictions:"), ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0. (See accompanying file)"),
    ("GPL", "This program is free software: you can redistribute it and/or modify\nit under the terms of the GNU General Public License as published by\nthe Free Software Foundation, either version 3 of the License"), ("GPL", "You should have received a copy of the GNU General Public License\nalong with this program. If not, see the web page"), ("LGPL", "This library is free software; you can redistribute it and/or\nmodify it under the terms of the GNU Lesser General Public\nLicense as published by the Free Software Foundation"),
    ("AGPL", "it under the terms of the GNU Affero General Public License as published"), ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0."), ("EPL-2.0", "This program and the accompanying materials are made\navailable under the terms of the Eclipse Public License 2.0"), ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("CC-BY-NC", "This work is licensed under a Creative Commons\nAttribution-NonCommercial 4.0 International License"), ("CC-BY-SA", "This work is licensed under a Creative Commons\nAttribution-ShareAlike 4.0 International License"), ("CC-BY", "This work is licensed under a Creative Commons Attribution 4.0\nInternational License"), ("CC0", "To the extent possible under law, the author has\nwaived all copyright and related rights to this work"), ("OFL-1.1", "This Font Software is licensed under the SIL Open Font License, Version 1.1."),
    ("proprietary", "CONFIDENTIAL AND PROPRIETARY - DO NOT DISTRIBUTE"), ("proprietary", "Unauthorized copying of this file, via any medium, is strictly prohibited"),
]
NO_LICENCE = [
    "The driver showed her license to the officer and drove on", "We are free to redistribute the chairs in the hall", "Permission to land was granted at noon", "The public domain of the old kings lay to the north", "Terms of the treaty were not met by either side", "The software is slow on my machine", "All copies of the book were sold in a week", "A general in the public square gave a speech",
    "Version 2.0 of the game is out now", "The MIT campus lies by the river", "He was licensed as a pilot in the spring", "The author has written three novels", "Apache helicopters flew over the field", "Attribution of the painting is not settled", "The foundation of the house is made of stone", "Under these conditions the plant will not grow",
]


def test_licences_on_notices_that_were_not_trained_on(spark):
    extra = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").limit(300)
    rows = [(-i - 1, f"Some words before it.\n\n{t}\n\nand after") for i, (_, t) in enumerate(HELD_OUT)] + [(-i - 1001, t) for i, t in enumerate(NO_LICENCE)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").unionAll(extra)
    found = {r.doc_id: set(r.families) for r in licenses.licences(frame).where("doc_id < 0").collect()}
    right = [f in found[-i - 1] for i, (f, _) in enumerate(HELD_OUT)]
    wrong = [(f, found[-i - 1]) for i, (f, _) in enumerate(HELD_OUT) if found[-i - 1] - {f, "unknown"} or f not in found[-i - 1]]
    alarms = [t for i, t in enumerate(NO_LICENCE) if found[-i - 1001]]
    named = sum(len(found[-i - 1] - {"unknown"}) for i in range(len(HELD_OUT))) + sum(len(found[-i - 1001] - {"unknown"}) for i in range(len(NO_LICENCE)))
    print("recall", sum(right), len(right), "named", named, "wrong", wrong, "alarms", alarms)
    assert sum(right) / len(right) >= 0.9 and sum(right) / named >= 0.9 and len(alarms) <= 2


def test_pipeline(spark, sf):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels, items = spark.read.parquet(f"{sf}/labels.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "near_dedup", "decontamination", "secrets", "byte_bpe"]
    texts = {r.doc_id: r.text for r in docs.collect()}
    toxic = {r.doc_id for r in toxicity.toxicity(docs, labels).where("predicted = 1").collect()}
    left = docs.where(~F.col("doc_id").isin(list(toxic))) if toxic else docs
    first = {r.component_id for r in simhash.simhash_classes(left).collect()}
    left = left.where(F.col("doc_id").isin(list(first)))
    whole = [" ".join(r.text.split()) for r in items.collect()]
    clean = {i for i in first if not any(t in " ".join(texts[i].split()) for t in whole)}
    assert clean == {r.doc_id for r in decontaminate.drop_contaminated(left, items).collect()}
    hidden = secrets.redact_secrets(left.where(F.col("doc_id").isin(list(clean))))
    import public_tokenizers

    want = {tuple(r) for r in bytebpe.encode_digests(hidden, public_tokenizers.path("byte_bpe_50k.tiktoken")).collect()}
    assert {tuple(r) for r in corpus_pipeline.run(spark, sf).collect()} == want
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, sf).columns == docs.columns


def test_licence_names_and_several_families():
    negatives = [f"the {a} of {b} was {c} in the {b} by a {a}" for a in ("river", "house", "letter") for b in ("summer", "town") for c in ("lost", "found", "seen")]
    model = licenses.train(negatives)
    found = lambda t: [f for x in licenses._scan(licenses._block_of([t]), model) for f in x[3]]
    assert found("SPDX-License-Identifier: WTFPL") == ["unknown"] and found("SPDX-License-Identifier: Unlicense") == ["Unlicense"]
    assert found("Dual licensed under MIT and Apache-2.0") == found("SPDX-License-Identifier: MIT OR Apache-2.0") == ["Apache-2.0", "MIT"]
    assert found("License: GPL-2.0-only") == ["GPL"] and found("BSD 3-Clause License") == ["BSD"]
    assert found("licensed under CC BY-NC 4.0") == ["CC-BY-NC"] and found("SPDX-License-Identifier: LGPL-2.1-or-later AND ISC") == ["ISC", "LGPL"]
    assert found("The letter was found in the town.") == [] and found("Of this") == []


def test_a_document_of_many_notices_takes_linear_time():
    import time

    model = licenses.train(["the letter was lost in the town by the river"] * 30)
    text = "Released under the MIT License.\n\nSPDX-License-Identifier: ISC\n\n" * 8000
    began = time.perf_counter()
    assert len(licenses._scan(licenses._block_of([text]), model)) == 16000
    assert time.perf_counter() - began < 60
