"""Rows, characters and layouts that an operator once left out of its work."""

import textwrap
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from canvass.llm import decontaminate, exact_dedup, license_scan, near_dedup, packing


# 7

def test_only_copies_go_where_ids_are_null_or_repeated(spark):
    docs = spark.createDataFrame([(7, "a"), (None, "a"), (None, "b"), (9, "a"), (9, "c")], "doc_id long, text string")
    assert sorted(exact_dedup.keep_first(docs).collect(), key=lambda r: r.text) == [(7, "a"), (None, "b"), (9, "c")]


def test_copies_differing_in_white_space_go_with_any_columns(spark):
    docs = spark.createDataFrame([(1, "a  b", 5), (2, "a\tb", 6), (2, None, 7), (3, "", 8)], "key long, body string, kept int")
    got = exact_dedup.keep_first(docs, "key", "body")
    assert got.columns == docs.columns and sorted(r.kept for r in got.collect()) == [5, 7]


# 2

def test_control_characters_are_tokens(spark):
    from tokenizers import Tokenizer

    docs = spark.createDataFrame([(k, f"alpha{c}beta alpha {c} beta{c}{c}. {c}") for k, c in enumerate("\x1c\x1d\x1e\x1f\x85\xa0 　")], "doc_id long, text string")
    model = Tokenizer.from_file(packing.default_tokenizer())
    got = {r.doc_id: (r.start, r.length, r.ids_crc32) for r in packing.pack(docs).collect()}
    for r in docs.collect():
        ids = model.encode(r.text, add_special_tokens=False).ids + [0]
        assert got[r.doc_id] == (0, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())), r.doc_id


# 1

BSD = [
    "Copyright (c) 2020, A. Person",
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
]
BSD_NAME = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
APACHE = [
    'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at',
    "http://www.apache.org/licenses/LICENSE-2.0",
    'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
]
GPL_3 = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
GPL_2 = "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."
KERNEL = "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation."
MIT = [
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
]
NOTICES = [
    ([*BSD, BSD_NAME], "BSD-3-Clause", "unknown,bsd_grant,bsd_source,bsd_binary,bsd_name"),
    (BSD, "BSD-2-Clause", "unknown,bsd_grant,bsd_source,bsd_binary"),
    (APACHE, "Apache-2.0", "apache_2,apache_comply,apache_copy,apache_unless,apache_limits"),
    ([GPL_3], "GPL-3.0-or-later", "gpl_3_later"),
    ([GPL_2], "GPL-2.0-or-later", "gpl_2_later"),
    ([KERNEL], "GPL-2.0-only", "gpl_2"),
    (MIT, "MIT", "mit_grant,mit_notice"),
]


def scanned(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [r for _, r in sorted((r.doc_id, r) for r in license_scan.license_scan(docs).collect())]


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_wrapped_notices_with_comment_marks(spark, end):
    texts, want = [], []
    for parts, licence, sequence in NOTICES:
        for width in (10**6, 80, 72, 41):
            for mark in ("", "# ", " * ", "// ", ";; ", "dnl ", "! "):
                lines = [x for p in parts for x in [*textwrap.wrap(p, width), ""]]
                texts.append(end.join(["int x = 1", "", *[(mark + x).rstrip() for x in lines], "and code"]))
                want.append((licence, sequence, 1))
    assert [(r.licences, r.sequence, r.n_matches) for r in scanned(spark, texts)] == want


def test_lines_are_joined_within_a_sentence_only(spark):
    texts = [
        "Title without a stop\nReleased under the\nMIT License\nmore words",
        "Released under the\n\nMIT License v",
        "Released under the. MIT\nLicense v",
        "An unknown licence\nwrapped with its licence\nover lines. Another licence.",
        "A licence of our own\nReleased under the MIT License",
        "words\n" * 50_000 + "licence\n" + "words\n" * 50_000 + "." * 100_000 + "x",
    ]
    assert [r.sequence for r in scanned(spark, texts)] == ["mit_ref", "unknown", "unknown", "unknown,unknown", "unknown,mit_ref", "unknown"]


LESSER = "GNU {} General Public License as published by the Free Software Foundation"
EVERYDAY = [
    ("// SPDX-License-Identifier: MIT", "MIT"),
    ("# SPDX-License-Identifier: GPL-2.0-or-later", "GPL-2.0-or-later"),
    ("/* SPDX-License-Identifier: BSD-3-Clause */", "BSD-3-Clause"),
    ("SPDX-License-Identifier: LGPL-2.1", "LGPL-2.1-only"),
    (f"This library is free software; you can redistribute it and/or modify it under the terms of the {LESSER.format('Lesser')}; either version 2.1 of the License, or (at your option) any later version.", "LGPL-2.1-or-later"),
    (f"Frobnicator is free software: you can redistribute it and/or modify it under the terms of the {LESSER.format('Affero')}, either version 3 of the License, or (at your option) any later version.", "AGPL-3.0-or-later"),
    (f"You can redistribute it and/or modify it under the terms of the {LESSER.format('Library')}; either version 2 of the License, or (at your option) any later version.", "LGPL-2.0-or-later"),
    ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.", "ISC"),
    ("This is free and unencumbered software released into the public domain.\n\nAnyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.", "Unlicense"),
    ("Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt)", "BSL-1.0"),
    ("Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:", "BSL-1.0"),
    ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.", "MPL-2.0"),
    ("This work is licensed under a Creative Commons Attribution 4.0 International License.", "CC-BY-4.0"),
    ("This document is licensed under the Creative Commons Attribution-ShareAlike 3.0 Unported License.", "CC-BY-SA-3.0"),
    ("This file is licensed under the MIT License.", "MIT"),
    ("The code is released under the BSD 3-Clause License.", "BSD-3-Clause"),
    ("\n".join([*BSD, "3. Neither the name of Example Widgets, Inc. nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."]), "BSD-3-Clause"),
    ("Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:", "Zlib"),
]


@pytest.mark.parametrize("width", [10**6, 72, 50])
def test_everyday_notices(spark, width):
    texts = ["\n".join("\n".join(textwrap.wrap(p, width)) for p in text.split("\n")) for text, _ in EVERYDAY]
    assert [r.licences for r in scanned(spark, texts)] == [licence for _, licence in EVERYDAY]


def test_plain_prose_names_no_licence(spark):
    texts = ["The library is free of dust.", "You need a driving license to use this software.", "Neither the name of the rose nor anything else.", "Permission is granted to leave.", "Licensed under protest.", "She is free software testing tomorrow."]
    assert [(r.licences, r.n_known) for r in scanned(spark, texts)] == [(None, 0)] * len(texts)


def test_several_licences_in_one_text(spark):
    got = scanned(spark, ["Licensed under the MIT License.\nsome words\nSPDX-License-Identifier: Apache-2.0\nReleased under the ISC License."])[0]
    assert (got.licences, got.n_matches, got.n_known) == ("Apache-2.0,MIT,ISC", 3, 3)


# 6

def test_documents_without_id_are_judged(spark):
    item = " ".join(f"w{k}" for k in range(20))
    docs = spark.createDataFrame([(None, f"before {item} after", 1), (None, f"before {item} after", 2), (None, "quite another text of several words", 3), (None, None, 4), (5, f"x {item}", 5), (6, "clean", 6)], "doc_id long, text string, id int")
    items = spark.createDataFrame([(1, item)], "item_id long, text string")
    got = sorted(decontaminate.contamination(docs, items).collect(), key=lambda r: r.doc_id or 0)
    assert [(r.doc_id, r["items"], r.overlap, r.start) for r in got] == [(None, [1], 1.0, 1), (5, [1], 1.0, 1)]
    kept = decontaminate.keep_clean(docs, items)
    assert kept.columns == docs.columns and sorted(r.id for r in kept.collect()) == [3, 4, 6]


def test_short_items_and_items_without_id_protect(spark):
    docs = spark.createDataFrame([(1, "so alpha beta gamma it is"), (2, "alpha gamma beta"), (3, "one Word, only"), (4, "p q r s t"), (5, "p q x s t"), (6, "p q r s")], "doc_id long, text string")
    items = spark.createDataFrame([(None, "Alpha, beta: gamma"), (7, "only"), (8, "p q r s t"), (8, "zz zz"), (None, "nowhere"), (9, "p q r s")], "item_id long, text string")
    got = {r.doc_id: (r["items"], r.overlap) for r in decontaminate.contamination(docs, items).collect()}
    assert got == {1: ([], 1.0), 3: ([7], 1.0), 4: ([8, 9], 1.0), 5: ([8], 0.8), 6: ([9], 1.0)}
    assert [r.doc_id for r in decontaminate.keep_clean(docs, items).collect()] == [2]


@pytest.mark.parametrize("length", range(1, 13))
def test_items_of_every_length_at_every_border(spark, length):
    words = [f"k{i}" for i in range(length)]
    rows, want = [], set()
    for bad in range(decontaminate.allowed(length) + 2):
        said = [w if k >= bad else f"x{k}" for k, w in enumerate(words)]
        for side, text in enumerate((said, ["a", "b", *said], [*said, "c"])):
            rows.append((10 * bad + side, " ".join(text)))
            if bad <= decontaminate.allowed(length):
                want.add(10 * bad + side)
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    items = spark.createDataFrame([(1, " ".join(words))], "item_id long, text string")
    assert {r.doc_id for r in decontaminate.contamination(docs, items).collect()} == want


# 4

PLAIN = " ".join(f"word{k}" for k in range(60))
NEAR = PLAIN + " more"


def test_rows_without_id_are_near_duplicates_too(spark):
    rows = [(None, PLAIN), (None, PLAIN), (None, NEAR), (None, "quite another text of several words and more"), (None, None), (None, "")]
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.class_id for r in got} == {None} and sorted((r.class_size, r.kept) for r in got).count((3, True)) in (1, 2)
    kept = [r.text for r in near_dedup.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert sum(t in (PLAIN, NEAR) for t in kept) == (2 if PLAIN in kept else 1) and len(set(kept) & {PLAIN, NEAR}) == 1
    assert "quite another text of several words and more" in kept and {None, ""} <= set(kept)
    mixed = spark.createDataFrame([*rows, (5, NEAR + " still"), (3, PLAIN)], "doc_id long, text string")
    assert {r.doc_id: (r.class_id, r.kept) for r in near_dedup.near_duplicates(mixed).collect() if r.doc_id} == {5: (3, False), 3: (3, True)}
    left = [(r.doc_id, r.text) for r in near_dedup.keep_one(mixed).collect() if r.text and "word" in r.text and "another" not in r.text]
    assert left == [(3, PLAIN)]


def test_ids_of_any_type(spark):
    docs = spark.createDataFrame([("b", PLAIN), ("a", NEAR), ("c", "x y z"), (None, "x  y z")], "name string, body string")
    assert {(r.name, r.class_id, r.kept) for r in near_dedup.near_duplicates(docs, "name", "body").collect()} == {("b", "a", False), ("a", "a", True), ("c", "c", True), (None, "c", False)}
    assert {r.name for r in near_dedup.keep_one(docs, "name", "body").collect()} == {"a", "c"}
    assert {r.name for r in exact_dedup.keep_first(docs, "name", "body").collect()} == {"a", "b", "c"}
    items = spark.createDataFrame([("q", "x y z")], "item_id string, text string")
    assert {r.name for r in decontaminate.keep_clean(docs, items, "name", "body").collect()} == {"a", "b"}


# columns of any name

CLASHING = "_sha string, _gone long, _bad string, _key long, own_id string, gone_id int, own_sha string, gone_sha string, sha string, h long, norm string, key long, bare string, class long, bucket int, item string, name string, words int"


def test_filters_keep_columns_of_any_name(spark):
    texts = [(1, PLAIN), (2, PLAIN), (3, NEAR), (4, "an item of five words here"), (None, PLAIN), (None, "an item of five words"), (None, "clean text"), (8, None)]
    width = CLASHING.count(",") + 1
    docs = spark.createDataFrame([(i, t, *[str(i) if "string" in c else 7 for c in CLASHING.split(", ")]) for i, t in texts], f"doc_id long, text string, {CLASHING}")
    items = spark.createDataFrame([(1, "item of five words")], "item_id long, text string")
    for left, want in (
        (exact_dedup.keep_first(docs), [(1, PLAIN), (3, NEAR), (4, "an item of five words here"), (8, None), (None, "an item of five words"), (None, "clean text")]),
        (near_dedup.keep_one(docs), [(1, PLAIN), (4, "an item of five words here"), (8, None), (None, "an item of five words"), (None, "clean text")]),
        (decontaminate.keep_clean(docs, items), [(1, PLAIN), (2, PLAIN), (3, NEAR), (8, None), (None, "clean text"), (None, PLAIN)]),
    ):
        assert left.columns == docs.columns and len(left.columns) == width + 2
        rows = left.collect()
        assert sorted(((r.doc_id, r.text) for r in rows), key=repr) == sorted(want, key=repr)
        assert all(r["_sha"] == str(r.doc_id) and r["_gone"] == 7 for r in rows)


# 7

def test_the_index_decides(spark, monkeypatch):
    docs = spark.createDataFrame([(k, f"text {k % 40}") for k in range(200)], "doc_id long, text string")
    marks = exact_dedup.exact_dedup(docs, capacity=4)
    assert marks.count() == 200 and marks.select("bucket").distinct().count() >= 10
    few = {(r.doc_id, r.keep_id, r.group_size, r.bucket) for r in marks.collect()}
    monkeypatch.setattr(exact_dedup, "FEW_SLOTS", 0)
    assert {(r.doc_id, r.keep_id, r.group_size, r.bucket) for r in exact_dedup.exact_dedup(docs, capacity=4).collect()} == few
    monkeypatch.setattr(exact_dedup, "build_index", lambda texts, depth, slots: marks.limit(0).select("bucket", F.lit(0).cast("long").alias("h"), F.col("text_sha256").alias("sha"), "keep_id", "group_size", "chain"))
    assert exact_dedup.exact_dedup(docs, capacity=4).count() == 0
