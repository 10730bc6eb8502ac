import gzip
import hashlib
import random
import re
import textwrap
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillspark.llm import decontam, licenses, queries, token_counts, warc
from quillspark.llm.tokens import Encoder

SF = "/root/testdata/sf0.001"


# decontamination


def edits(a, b):
    """Least edit distance of a to a stretch of b, cell by cell."""
    row = [0] * (len(b) + 1)
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j - 1] + (x != y), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


@settings(max_examples=200, deadline=None)
@given(st.text("abc", min_size=1, max_size=40), st.text("abc", max_size=80))
def test_myers_distance(a, b):
    assert decontam.myers(a, b)[0] == edits(a, b)


def test_all_items_within_their_budget_are_found(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choices("abcdefghij", k=rng.randrange(2, 8)))
    items = [(i, " ".join(word() for _ in range(25))) for i in range(6)]
    docs = []
    for d in range(60):
        t = [word() for _ in range(60)]
        x = list(items[d % 6][1])
        for _ in range(d // 6):
            x[rng.randrange(len(x))] = rng.choice("abcdefghij ")
        docs.append((d, " ".join(t[:30]) + "\n" + "".join(x).upper() + ", " + " ".join(t[30:])))
    want = set()
    for d, t in docs:
        for i, s in items:
            s, n = decontam.normal(s), decontam.normal(t)
            if (e := edits(s, n)) <= decontam.budget(len(s), 0.06):
                want.add((d, i, e))
    df, it = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id, r.distance) for r in decontam.matches(df, it).collect()}
    assert got == want and len(want) > 20
    assert {(r.doc_id, r.item_id, r.distance) for r in decontam.matches(df, it, chunk_bytes=300).collect()} == want


def test_decontamination_odd_rows(spark, odd, empty):
    items = spark.createDataFrame([(1, None), (2, ""), (3, "..."), (4, "same words here"), (5, "same words here")], "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in decontam.matches(odd, items).collect()} == {(4, 4), (4, 5), (5, 4), (5, 5)}
    assert decontam.matches(empty, items).count() == 0 and decontam.matches(odd, items.where("false")).count() == 0
    kept = decontam.clean_of(odd, items)
    assert kept.columns == odd.columns and kept.count() == odd.count() - 3


def test_rows_without_an_id_are_cleaned_and_names_may_clash(spark):
    rows = [(None, "the whole test item is here as it was", 1), (None, "a clean text", 2), (3, "the whole test item is here as it was", 3), (3, "another text of this id", 4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, row_key int").withColumn("_hit", F.col("row_key"))
    items = spark.createDataFrame([(1, "test item is here"), (2, "ean")], "item_id long, text string")
    kept = decontam.clean_of(df, items)
    assert kept.columns == df.columns and sorted(r.row_key for r in kept.collect()) == [2, 4]


def test_short_items_must_stand_as_words(spark):
    df = spark.createDataFrame([(1, "a party"), (2, "modern art"), (3, "Art."), (4, "an art party, art")], "doc_id long, text string")
    got = decontam.matches(df, spark.createDataFrame([(1, "art")], "item_id long, text string"))
    assert {(r.doc_id, r.start, r.end) for r in got.collect()} == {(2, 7, 10), (3, 0, 3), (4, 3, 6)}


# WARC


def test_warc_round_trip(spark):
    pages = [(1, "http://a", "x" * 2000), (2, "http://b", "x" * 2000), (3, None, "x" * 999), (4, "u", "x" * 999), (5, "u", None), (6, "u", ""), (7, "bad\nurl", "é😀\r\n\r\nWARC/1.1\r\n" * 500), (9, "http://c", "x" * 2000), (8, "u", "".join(map(chr, range(32, 4000))) * 400)]
    df = spark.createDataFrame([(*p, "x", 1) for p in pages], "page_id long, url string, html string, digest string, payload int")
    got = {r.page_id: r for r in warc.round_trip(df).collect()}
    assert len(got) == len(pages)
    for i, _, h in pages:
        data = (h or "").encode()
        r = got[i]
        assert (r.payload_bytes, r.payload_digest) == (len(data), hashlib.sha1(data).hexdigest())
        assert (r.record_type, r.refers_to) == (("revisit", 9) if i in (1, 2) else ("response", None))
        assert r.digest_ok
    chunks = warc.read_archives(warc.write_archives(df, block=1000), chunk=700)
    body = b"".join(bytes(r.payload) for r in sorted(chunks.where("page_id = 8").collect(), key=lambda r: r.chunk_no))
    assert body == pages[-1][2].encode() and max(len(r.payload) for r in chunks.collect()) <= 700
    assert warc.round_trip(df.where("false")).count() == 0


def test_damaged_archives_and_awkward_ids(spark):
    pages = [(None, "u", "y" * 3000), (4, "u", "y" * 3000), (4, "u", "y" * 3000), (2, "u", "y" * 3000), (None, None, None), (7, "u", "z" * 5000)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = sorted((str(r.page_id), r.record_type, r.refers_to) for r in warc.round_trip(df).collect())
    assert got == [("2", "revisit", 4), ("4", "response", None), ("4", "response", None), ("7", "response", None), ("None", "response", None), ("None", "response", None)]
    blocks = warc.write_archives(df.where("page_id = 7"))
    whole = zlib.decompress(bytes(blocks.collect()[0].data), 31)
    spoilt = spark.createDataFrame([(0, 0, 0, gzip.compress(whole.replace(b"zzz", b"zyz", 1)))], warc.BLOCKS)
    with pytest.raises(Exception, match="damaged"):
        warc.read_archives(spoilt).collect()


# licences


def test_licences(spark, odd):
    texts = {
        1: "Some words.\n# Licensed under the Apache License, Version 2.0 (the License);\n# you may not use this file except in compliance with the License.\n# You may obtain a copy of the License at http://x\nUnless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS.",
        2: "Released under the MIT License.",
        3: "This work is licensed under the GNU General Public License, version 3. Licensed under CC BY-NC 4.0.",
        4: "a license to thrill",
        5: "you may not use this file except in compliance with the License.",
        6: "Redistribution and use in source and binary forms, with or without modification, are permitted. Neither the name of X may be used to endorse or promote products.",
    }
    got = {r.doc_id: (r.n_known, r.license) for r in licenses.scan(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    assert got == {1: (4, "Apache-2.0"), 2: (1, "MIT"), 3: (2, "GPL-3.0-only AND CC-BY-NC-4.0"), 4: (0, "none"), 5: (1, "unknown"), 6: (2, "BSD-3-Clause")}
    assert {r.license for r in licenses.scan(odd).collect()} == {"none"} and licenses.scan(odd).count() == odd.count()


MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY."""
BSD = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission."""
GPL2 = """This program is free software; you can redistribute it and/or
modify it under the terms of the GNU General Public License
as published by the Free Software Foundation; either version 2
of the License, or (at your option) any later version."""
GPL3 = """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version."""
LGPL = """This library is free software; you can redistribute it and/or
modify it under the terms of the GNU Lesser General Public
License as published by the Free Software Foundation; either
version 2.1 of the License, or (at your option) any later version."""
APACHE = """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."""
MPL = """This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at http://mozilla.org/MPL/2.0/."""


def test_licences_wrapped_as_published(spark):
    texts = {"MIT": (3, MIT), "BSD-3-Clause": (2, BSD), "GPL-3.0-or-later": (2, GPL3), "LGPL-2.1-or-later": (2, LGPL), "Apache-2.0": (4, APACHE), "MPL-2.0": (1, MPL)}
    rows, want = [], []
    for licence, (n, t) in [*texts.items(), ("GPL-2.0-or-later", (2, GPL2)), ("CC0-1.0", (1, "Released to the public\ndomain by me"))]:
        marked = ["\n".join((mark + line).rstrip() for line in t.split("\n")) for mark in ("# ", " * ", "// ", "dnl ", "REM ")]
        for x in [t, t.replace("\n", "\r\n"), "Copyright (c) 2020 A. Body\n" + t, "some code\n\n" + t + "\n\nmore code", *marked]:
            rows.append((len(rows), x))
            want.append((n, licence))
    got = licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).orderBy("doc_id").collect()
    assert [(rows[r.doc_id][1], (r.n_known, r.license)) for r in got] == [(rows[i][1], w) for i, w in enumerate(want)]


#: Texts of licences, as published, with the licence and the number of sentences that the rules know.
TEXTS = [
    ("ISC", 2, "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.\n\nTHE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE."),
    ("0BSD", 2, "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.\n\nTHE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE."),
    ("Zlib", 2, "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.\n\nPermission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:"),
    ("Unlicense", 1, "This is free and unencumbered software released into the public domain.\n\nAnyone is free to copy, modify, publish, use, compile, sell, or distribute this software."),
    ("BSL-1.0", 1, "Distributed under the Boost Software License, Version 1.0. (See accompanying file or a copy at the site.)"),
    ("EPL-2.0", 1, "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at http://www.eclipse.org/legal/epl-2.0"),
    ("EPL-1.0", 1, "This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0 which accompanies this distribution."),
    ("AGPL-3.0-or-later", 2, "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-3.0-or-later", 2, GPL3.replace("\n", " ")),
    ("LGPL-2.1-or-later", 2, LGPL.replace("\n", " ")),
    ("MIT", 3, MIT.replace("\n\n", "\0").replace("\n", " ").replace("\0", "\n\n")),
    ("MPL-2.0", 1, MPL.replace("\n", " ")),
    ("Apache-2.0", 4, APACHE),
    ("GPL-2.0-only", 1, "SPDX-License-Identifier: GPL-2.0-only"),
    ("MIT", 1, "SPDX-License-Identifier: MIT"),
    ("AGPL-3.0-or-later", 1, "SPDX-License-Identifier: AGPL-3.0-or-later"),
]


def plain_match(sentences):
    """(known, licence) of whole sentences given one by one: each against every pattern, then the rules at each place in turn."""
    known = []
    for s in sentences:
        if "SPDX-License-Identifier:" in s:
            known.append(("SPDX", s.split(":")[1].strip()))
            continue
        s = re.sub(r"[\W_]+", " ", s.lower()).strip()
        for n, p in licenses.SENTENCES.items():
            if m := re.fullmatch(p.replace("(?<", "(?P<"), s):
                said = "".join(m.groupdict().get(g) or "" for g in "wv").replace(" ", ".")
                known.append((n, said and (said if "." in said else said + ".0")))
                break
    found, k = [], 0
    while k < len(known):
        took, told = 1, None
        if known[k][0] == "SPDX":
            told = known[k][1]
        elif not (known[k][0] == "AllRights" and k + 1 < len(known) and known[k + 1][0] in licenses.OWN_TEXT):
            for names, licence in licenses.RULES:
                here = known[k : k + len(names)]
                if tuple(n for n, _ in here) == names:
                    said = [v for _, v in here if v]
                    took, told = len(names), licence
                    if "{}" in licence:
                        family, rest = licence.split("-{}")
                        told = f"{family}-{said[-1]}{rest or '-only'}" if said else family
                    break
        if told and told not in found:
            found.append(told)
        k += took
    return len(known), " AND ".join(found) if found else "unknown" if known else "none"


def test_licence_texts_against_a_plain_matcher(spark):
    rows, want = [], []
    for licence, n, t in TEXTS:
        cut = [s for p in re.split(r"\n\s*\n", t) for s in re.split(r"(?<=[.!?])(?<!v\.)\s+|(?<=[a-z\)\"];)\s+(?=you may|either)|,(?= either version)|\n(?=You may)", p)]
        cut = [x for s in cut for x in ([s] if "free software; you" not in s else re.split(r"; (?=either)", s))]
        assert plain_match([re.sub(r"\s+", " ", s) for s in cut]) == (n, licence), (licence, plain_match(cut))
        for x in (t, textwrap.fill(t, 70) if "\n" not in t else "\n".join(textwrap.fill(p, 70) for p in t.split("\n"))):
            rows += [(len(rows), x), (len(rows) + 1, "Some words before it.\n\n" + x.replace("\n", "\n# ") + "\n\nint main() {}")]
            want += [(n, licence)] * 2
    got = licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).orderBy("doc_id").collect()
    assert [(rows[r.doc_id][1], (r.n_known, r.license)) for r in got] == [(rows[i][1], w) for i, w in enumerate(want)]
    assert licenses.scan(spark.createDataFrame([], "doc_id long, text string")).count() == 0


#: Headers and heads as published, with the licence each gives.
HEADERS = [
    ("BSD-3-Clause", "Copyright (c) 2019, A. Body\nAll rights reserved.\n\n" + BSD), ("BSD-2-Clause", "All rights reserved.\n\n" + BSD.split("\n\n3.")[0]),
    ("Proprietary", "Copyright (c) 2019 A. Body. All rights reserved."), ("Apache-2.0", "Copyright 2020 A. Body. All rights reserved.\n\n" + APACHE),
    ("Proprietary AND MIT", "All rights reserved.\n\nReleased under the MIT License."),
    ("GPL-2.0-or-later", GPL2), ("GPL-3.0-or-later", GPL3), ("LGPL-2.1-or-later", LGPL), ("LGPL-3.0-or-later", LGPL.replace("version 2.1", "version 3")),
    ("GPL-2.0-only", GPL2.replace("either version 2\nof the License, or (at your option) any later version.", "version 2 of the License.")),
    ("GPL-3.0-only", GPL3.replace("either version 3 of the License, or\n(at your option) any later version.", "version 3 of the License.")),
    ("GPL-2.0-only", "This program is free software; you can redistribute it and/or modify\nit under the terms of the GNU General Public License version 2 as\npublished by the Free Software Foundation."),
    ("GPL-3.0-only", "This work is licensed under the GNU General Public License, version 3."), ("GPL-2.0-only", "This program is licensed under the GNU General Public License, version 2."),
    ("GPL", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation."),
    ("LGPL-2.1-only", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License version 2.1 as published by the Free Software Foundation."),
    ("AGPL-3.0-or-later", GPL3.replace("GNU General", "GNU Affero General")), ("AGPL-3.0-only", GPL3.replace("GNU General", "GNU Affero General").replace("either version 3 of the License, or\n(at your option) any later version.", "version 3 of the License.")),
    ("Apache-2.0 OR MIT", "Licensed under either of Apache License, Version 2.0 or MIT license at your option."),
    ("Apache-2.0 OR MIT", "Licensed under either of\n * Apache License, Version 2.0 (LICENSE-APACHE)\n * MIT license (LICENSE-MIT)\nat your option."),
    ("GPL-2.0-only", "                    GNU GENERAL PUBLIC LICENSE\n                       Version 2, June 1991\n\n Copyright (C) 1989, 1991 Free Software Foundation, Inc."),
    ("GPL-3.0-only", "                    GNU GENERAL PUBLIC LICENSE\n                       Version 3, 29 June 2007\n\n Everyone is permitted to copy and distribute verbatim copies"),
    ("LGPL-2.1-only", "                  GNU LESSER GENERAL PUBLIC LICENSE\n                       Version 2.1, February 1999\n\nPreamble"), ("AGPL-3.0-only", "GNU AFFERO GENERAL PUBLIC LICENSE\nVersion 3, 19 November 2007\n\nPreamble"),
    ("Apache-2.0", "                                 Apache License\n                           Version 2.0, January 2004\n                        http://www.apache.org/licenses/\n\n   TERMS AND CONDITIONS"),
    ("MPL-2.0", "Mozilla Public License Version 2.0\n==================================\n\n1. Definitions"), ("MPL-2.0", MPL), ("MIT", "MIT License\n\nCopyright (c) 2020 A. Body\n\n" + MIT), ("MIT", "The MIT License (MIT)\n\n" + MIT), ("ISC", "ISC License\n\nCopyright (c) 2020, A. Body"),
    ("BSD-3-Clause", "BSD 3-Clause License\n\nCopyright (c) 2020, A. Body\nAll rights reserved.\n\n" + BSD), ("MIT", MIT), ("Apache-2.0", APACHE),
    ("MIT OR Apache-2.0", "// SPDX-License-Identifier: MIT OR Apache-2.0"), ("GPL-2.0-only WITH Linux-syscall-note", "/* SPDX-License-Identifier: GPL-2.0 WITH Linux-syscall-note */\n#ifndef X"),
    ("GPL-2.0-or-later", "# SPDX-License-Identifier: GPL-2.0+"), ("LGPL-2.1-or-later", "SPDX-License-Identifier: lgpl-2.1-or-later"), ("Apache-2.0+", "<!-- SPDX-License-Identifier: Apache-2.0+ -->"),
    ("(MIT OR Apache-2.0) AND BSD-3-Clause", "# SPDX-License-Identifier: (MIT OR Apache-2.0) AND BSD-3-Clause"), ("none", "# SPDX-License-Identifier: LicenseRef-Own"), ("(GPL-2.0-only OR MIT) AND Proprietary", "SPDX-License-Identifier: (GPL-2.0-only OR MIT)\n\nAll rights reserved."),
    ("CC0-1.0", "Released to the public domain."), ("CC-BY-SA-4.0", "This work is licensed under CC BY-SA 4.0."), ("none", "The General was in the public eye; version 3 of the play."), ("none", "MIT licensed him. A gnu ran by."),
]


def test_published_headers(spark, odd):
    assert len(HEADERS) >= 40
    rows = [(i, t) for i, (_, t) in enumerate(HEADERS)] + [(1000 + i, "\r\n".join("# " + x for x in t.split("\n"))) for i, (_, t) in enumerate(HEADERS) if "<!--" not in t and "/*" not in t]
    got = dict(licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "license").collect())
    assert [(HEADERS[i % 1000][1], got[i]) for i, _ in rows] == [(HEADERS[i % 1000][1], HEADERS[i % 1000][0]) for i, _ in rows]
    mixed = licenses.scan(odd.withColumnsRenamed({"h": "ids", "t": "licenses"}))
    assert {r.license for r in mixed.collect()} == {"none"} and mixed.count() == odd.count()


def test_licence_lines_of_the_corpus(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = docs.join(queries.op2_license_scan(spark, "/root/testdata/sf0.01"), "doc_id").select("text", "license").collect()
    assert all((r.license != "none") == any(x in r.text for x in ("Apache License", "MIT License", "CC BY-NC", "GNU General Public", "ll rights reserved")) for r in rows)


# token counts


def test_token_counts(spark, docs, odd, empty):
    enc = Encoder()
    for df in (docs, odd):
        want = sorted(((r.doc_id, len(enc.ids(r.text, special=False))) for r in df.collect()), key=str)
        files = token_counts.flat_files(df, block=100)
        scanned = token_counts.scan(files.where("block_no is not null"))
        names = files.where("doc_no is not null").select("file", "doc_no", "id")
        assert sorted(((r.id, r.n_tokens) for r in names.join(scanned, ["file", "doc_no"]).collect()), key=str) == want
    assert token_counts.token_counts(empty).count() == 0


def test_scan_of_files_with_open_ends_and_many_groups(spark, monkeypatch):
    import numpy as np

    monkeypatch.setattr(token_counts, "GROUP", 3)
    rng, rows, want = random.Random(4), [], []
    for f in "abc":
        ids = [rng.choice([1, 2, 50256]) if f != "c" else 1 for _ in range(200)]
        rows += [(f, k, np.array(ids[k * 7 : k * 7 + 7], "<u2").tobytes()) for k in range(29)]
        start = n = 0
        for at, x in enumerate([*ids, None]):
            if x == 50256 or x is None and at > start:
                want.append((f, n, start, at - start, x is not None))
                start, n = at + 1, n + 1
    df = spark.createDataFrame(rows, "file string, block_no long, ids binary")
    assert sorted(map(tuple, token_counts.scan(df).select("file", "doc_no", "start", "n_tokens", "closed").collect())) == want
