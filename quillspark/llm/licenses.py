"""Licence scans by sentence rules: normalised sentences become known sentence identifiers, and the sequence of identifiers of a
text is matched against ordered licence rules in one pass: at each place the first rule whose identifiers follow one another from there
is taken, and the pass goes on behind them.

A version that a sentence names is part of its identifier (GPLAnyLater:2.1) and of the licence that a rule gives. A line with an SPDX
expression is one identifier, parsed: OR, AND, WITH, + and brackets, names in their published form. "All rights reserved" right
before a licence's own text belongs to its copyright line and gives no licence.

Native DataFrame expressions throughout: no shuffle, no Python. A text is cut after sentence ends and at lines without letters
and digits; comment marks and punctuation become single spaces, letters lower case. A sentence may be wrapped, and lines without a
full stop run into it: so known sentences are looked for from each line on, over one line, over up to LINES lines and, from the
first, over the whole sentence; the shortest that is known counts.

Defined results. Null and empty texts have no sentences known and licence "none". A text with known sentences that no rule takes
is "unknown". Repeated rows each get their row; very long texts are scanned whole.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Licences and exceptions that an SPDX expression may name, and names that were replaced by others.
SPDX_IDS = [
    "Apache-2.0", "MIT", "MIT-0", "BSD-2-Clause", "BSD-3-Clause", "0BSD", "ISC", "Zlib", "Unlicense", "BSL-1.0", "MPL-2.0", "EPL-1.0", "EPL-2.0", "CC0-1.0", "CC-BY-4.0",
    "CC-BY-SA-4.0", "CC-BY-NC-4.0", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0-only", "GPL-3.0-or-later", "LGPL-2.1-only", "LGPL-2.1-or-later",
    "LGPL-3.0-only", "LGPL-3.0-or-later", "AGPL-3.0-only", "AGPL-3.0-or-later",
    "Linux-syscall-note", "Classpath-exception-2.0", "GCC-exception-3.1", "LLVM-exception",
]
SPDX_OLD = {f"{n}{plus}": f"{n}-{'or-later' if plus else 'only'}" for n in ("GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "AGPL-3.0") for plus in ("", "+")}
# Known licence sentences (normalised regular expressions, whole sentence) by identifier; a group v is the version.
SENTENCES = {
    "ApacheOrMIT": r"(this (work|project|software) is )?(dual )?licensed under (the terms of )?either (of )?(the )?apache license version 2 0.* or .*mit license.*|(this (work|project|software) is )?(dual )?licensed under (the terms of )?either of( the)? apache license version 2 0.*mit license.*",
    "GPLText": r"gnu general public license version (?<v>2|3) \d* ?(june|november|august).*",
    "LGPLText": r"gnu (lesser|library) general public license version (?<v>2 1|2|3) \d* ?(february|june).*",
    "AGPLText": r"gnu affero general public license version (?<v>3) \d* ?november.*",
    "ApacheText": r"apache license version 2 0 january 2004.*",
    "MPL2Text": r"mozilla public license version 2 0.*",
    "MITTitle": r"(the )?mit license( mit)?",
    "BSD3Title": r"(the )?(bsd 3 clause|new bsd|modified bsd) license",
    "BSD2Title": r"(the )?(bsd 2 clause|simplified bsd) license",
    "ISCTitle": r"(the )?isc license",
    "ApacheGrant": r"(this (work|file|project|software) is )?licensed under the apache license,? version 2 0( the license)?",
    "ApacheTerms": r"you may not use this file except in compliance with the license",
    "ApacheCopy": r"you may obtain a copy of the license at( http.*)?",
    "AsIsApache": r"unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis.*",
    "MITGrant": r"(this (work|software|project) is )?(released|licensed|distributed) under the (terms of the )?mit license",
    "MITPermission": r"permission is hereby granted free of charge to any person obtaining a copy of this software.*",
    "MITNotice": r"the above copyright notice and this permission notice shall be included in all copies.*",
    "AsIs": r"the software is provided as is without warranty of any kind.*",
    "ISCPermission": r"permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that .*",
    "FreePermission": r"permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
    "ISCAsIs": r"the software is provided as is and the author disclaims all warranties.*",
    "ZlibAsIs": r"this software is provided as is without any express or implied warranty.*",
    "ZlibPermission": r"permission is granted to anyone to use this software for any purpose including commercial applications.*",
    "Unencumbered": r"this is free and unencumbered software released into the public domain",
    "BoostGrant": r"(distributed under the )?boost software license version 1 0.*",
    "EPL1Grant": r"(this program and the accompanying materials|all rights reserved this program and the accompanying materials) are made available under the terms of the eclipse public license (v ?|version )?1 0.*",
    "EPL2Grant": r"this program and the accompanying materials are made available under the terms of the eclipse public license (v ?|version )?2 0.*",
    "BSDRedistribution": r"redistribution and use in source and binary forms with or without modification are permitted.*",
    "BSDNoEndorse": r"neither the name of .* may be used to endorse or promote products.*",
    "GPLGrant": r"this (work|program|software|project) is (licensed|released|distributed) under the (terms of the )?gnu general public license version (?<v>2|3)( 0)?",
    "AGPLGrant": r".*under the terms of the gnu affero general public license( version (?<v>3))?( as published.*)?",
    "GPLFree": r"(this (program|library|file|software)|.*) is free software you can redistribute it and or modify it under the terms of (version (?<w>2|3) of )?the gnu general public license( version (?<v>2|3))?( as published.*)?",
    "AnyLater": r"either version (?<v>2 1|2|3) of the license or at your option any later version.*",
    "ThisVersion": r"version (?<v>2 1|2|3) of the license( only)?",
    "LGPLGrant": r".*under the terms of the gnu (lesser|library) general public license( version (?<v>2 1|2|3))?( as published.*)?",
    "MPL2Grant": r"this source code form is subject to the terms of the mozilla public license v 2 0",
    "CCBYNC": r"(this work is )?licensed under (a )?(cc by nc|creative commons attribution noncommercial) 4 0( international)?( license)?",
    "CCBYSA": r"(this work is )?licensed under (a )?(cc by sa|creative commons attribution sharealike) 4 0( international)?( license)?",
    "CCBY": r"(this work is )?licensed under (a )?(cc by|creative commons attribution) 4 0( international)?( license)?",
    "CC0": r"(this work is )?(released|dedicated) (in)?to the public domain.*|.*cc0 1 0.*",
    "AllRights": r"(copyright .*)?all rights reserved",
}
# Licence rules in the order they are tried at a place: the identifiers that must follow each other, and the licence; {}
# is the version that the last identifier with one names.
RULES = [
    (("ApacheGrant", "ApacheTerms", "ApacheCopy", "AsIsApache"), "Apache-2.0"),
    (("MITTitle", "MITPermission", "MITNotice", "AsIs"), "MIT"),
    (("MITPermission", "MITNotice", "AsIs"), "MIT"),
    (("BSD3Title", "BSDRedistribution", "BSDNoEndorse"), "BSD-3-Clause"),
    (("BSDRedistribution", "BSDNoEndorse"), "BSD-3-Clause"),
    (("BSD2Title", "BSDRedistribution"), "BSD-2-Clause"),
    (("BSDRedistribution",), "BSD-2-Clause"),
    (("GPLFree", "AnyLater"), "GPL-{}-or-later"),
    (("AGPLGrant", "AnyLater"), "AGPL-{}-or-later"),
    (("LGPLGrant", "AnyLater"), "LGPL-{}-or-later"),
    (("GPLFree", "ThisVersion"), "GPL-{}-only"),
    (("AGPLGrant", "ThisVersion"), "AGPL-{}-only"),
    (("LGPLGrant", "ThisVersion"), "LGPL-{}-only"),
    (("ISCTitle", "ISCPermission"), "ISC"),
    (("ISCPermission",), "ISC"),
    (("FreePermission",), "0BSD"),
    (("ZlibAsIs", "ZlibPermission"), "Zlib"),
    (("ZlibPermission",), "Zlib"),
    (("Unencumbered",), "Unlicense"),
    (("BoostGrant",), "BSL-1.0"),
    (("EPL2Grant",), "EPL-2.0"),
    (("EPL1Grant",), "EPL-1.0"),
    (("ApacheOrMIT",), "Apache-2.0 OR MIT"),
    (("GPLText",), "GPL-{}-only"),
    (("LGPLText",), "LGPL-{}-only"),
    (("AGPLText",), "AGPL-{}-only"),
    (("ApacheText",), "Apache-2.0"),
    (("MPL2Text",), "MPL-2.0"),
    (("AGPLGrant",), "AGPL-{}"),
    (("GPLFree",), "GPL-{}"),
    (("GPLGrant",), "GPL-{}"),
    (("LGPLGrant",), "LGPL-{}"),
    (("MPL2Grant",), "MPL-2.0"),
    (("ApacheGrant",), "Apache-2.0"),
    (("MITPermission",), "MIT"),
    (("MITGrant",), "MIT"),
    (("MITTitle",), "MIT"),
    (("BSD3Title",), "BSD-3-Clause"),
    (("BSD2Title",), "BSD-2-Clause"),
    (("ISCTitle",), "ISC"),
    (("CCBYNC",), "CC-BY-NC-4.0"),
    (("CCBYSA",), "CC-BY-SA-4.0"),
    (("CCBY",), "CC-BY-4.0"),
    (("CC0",), "CC0-1.0"),
    (("AllRights",), "Proprietary"),
]
# Sentences that begin a licence's own text; "all rights reserved" right before one is part of its copyright line.
OWN_TEXT = ["ApacheGrant", "MITTitle", "MITPermission", "BSD3Title", "BSD2Title", "BSDRedistribution", "ISCTitle", "ISCPermission", "FreePermission", "ZlibAsIs", "ZlibPermission", "GPLFree", "LGPLGrant", "AGPLGrant", "EPL1Grant", "EPL2Grant", "MPL2Grant", "BoostGrant"]
#: Without one of these no sentence above can match; a cheap test that spares most texts the cutting.
_HINT = r"(?i)licen[sc]|permi(ssion|tted)|copyright|rights reserved|public domain|cc0|warrant|free software|later version|endorse".replace(" ", r"[^\p{L}\p{N}]+(?:(?:dnl|rem)[ \t]+)?")
#: Where a wrapped sentence may begin: the first words above, or what follows a leading ".*".
_START = r"^(?:gnu|mozilla|apache|version|this|boost|licensed|you|unless|released|distributed|permission|the|redistribution|neither|either|dedicated|copyright|all)\b|\b(?:under|cc0)\b"
LINES = 8
#: Sentence ends: not "v. 2.0", nor "free software; you can" and a blank line; a GPL text may go on with its version after a comma.
_END = r"(?i)(?<=[.;!?])(?<!\bv\.)(?<!free[^\p{L}\p{N}]{1,8}software;)\s+|,(?=[^\p{L}\p{N}]+either[^\p{L}\p{N}]+version)|(?<=foundation),(?=[^\p{L}\p{N}]+version)|\n[^\p{L}\p{N}\n]*(?=\n)"


def sentences(text: Column) -> Column:
    """The sentences of a text, in order, each as its normalised lines, empty ones left out."""
    plain = F.regexp_replace(F.regexp_replace(text, r"\r\n?", "\n"), r"(?im)^[ \t]*(?:dnl|rem)(?:[ \t]|$)", "")
    named = r"(?i)SPDX-License-Identifier:"
    kept = lambda x: F.trim(F.regexp_replace(F.regexp_replace(x, r"(?i)^.*SPDX-License-Identifier:", ""), r"[^A-Za-z0-9.+() -]+.*$", ""))  # noqa: E731  an expression as it is
    lines = lambda s: F.transform(F.split(s, "\n"), lambda x: F.when(x.rlike(named), F.concat(F.lit("spdx: "), kept(x))).otherwise(F.trim(F.regexp_replace(F.lower(x), r"[^\p{L}\p{N}]+", " "))))
    return F.filter(F.transform(F.split(plain, _END), lambda s: F.filter(lines(s), lambda x: x != "")), lambda s: F.size(s) > 0)


def _known(lines: Column) -> Column:
    """The identifiers found in the lines of a sentence, in order. What several lines give and the next line gives again is one."""

    def at(line: Column, k: Column) -> Column:
        reach = F.array(*map(F.lit, range(2, LINES + 1)), F.when(k == 0, F.size(lines)).otherwise(LINES))
        wide = F.when(line.rlike(_START), F.array_compact(F.transform(reach, lambda n: identifiers(F.array_join(F.slice(lines, k + 1, n), " ")))))
        one = identifiers(line)
        return F.struct(one.alias("one"), F.when(one.isNull() & (F.size(lines) > 1), F.get(wide, F.lit(0))).alias("wide"))

    def own(found: Column) -> Column:
        following = lambda k: F.coalesce(F.get(found, k + 1)["one"], F.get(found, k + 1)["wide"], F.lit(""))
        return F.transform(found, lambda x, k: F.coalesce(x["one"], F.when(x["wide"] != following(k), x["wide"])))

    # the array is bound once, as the element of an array of one
    return F.array_compact(F.flatten(F.transform(F.array(F.transform(lines, at)), own)))


def spdx(expression: Column) -> Column:
    """An SPDX expression with its names in their published form, blanks as _, or null if it names something else."""
    names = {i.lower(): i for i in SPDX_IDS} | {i.lower(): j for i, j in SPDX_OLD.items()} | {x: x.upper() for x in ("or", "and", "with")} | {x: x for x in "()"}
    known = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    words = F.filter(F.split(F.regexp_replace(expression, r"([()])", " $1 "), r"\s+"), lambda w: w.rlike("[A-Za-z0-9()]"))
    later = lambda w: F.when(F.endswith(w, F.lit("+")), F.concat(F.try_element_at(known, F.lower(F.regexp_replace(w, r"\+$", ""))), F.lit("+")))
    told = F.transform(words, lambda w: F.coalesce(F.try_element_at(known, F.lower(w)), later(w)))
    return F.when((F.size(told) > 0) & F.forall(told, lambda w: w.isNotNull()), F.replace(F.replace(F.array_join(told, "_"), F.lit("(_"), F.lit("(")), F.lit("_)"), F.lit(")")))


def identifiers(sentence: Column) -> Column:
    """The identifier of a normalised sentence, with the version it names behind a colon, or null."""
    out = F.when(F.startswith(sentence, F.lit("spdx: ")), F.concat(F.lit("SPDX:"), spdx(F.substring(sentence, 7, 1000))))
    for name, pattern in SENTENCES.items():
        whole = f"^(?:{pattern})$"
        own = F.lit(name)
        groups = [i for i, g in enumerate(re.findall(r"\((?!\?)|\(\?<([vw])>", whole), 1) if g]
        if groups:
            said = F.replace(F.concat(*[F.regexp_extract(sentence, whole, i) for i in groups]), F.lit(" "), F.lit("."))
            own = F.concat(own, F.when(said != "", F.concat(F.lit(":"), said)).otherwise(F.lit("")))
        out = out.when(sentence.rlike(whole), own)
    return out


def licences(ids: Column) -> Column:
    """The licences that identifiers give, in order, by one pass over them; ids is a column of its own."""
    version = lambda x: F.regexp_extract(x, r":(.*)$", 1)
    full = lambda v: F.when(F.contains(v, F.lit(".")) | (v == ""), v).otherwise(F.concat(v, F.lit(".0")))
    item = "struct<take:int,licence:string>"

    def at(x: Column, i: Column) -> Column:
        """How many identifiers the rule takes that fits from here on, and its licence."""
        ahead = F.concat(F.lit("|"), F.array_join(F.transform(F.slice(ids, i + 1, 4), lambda y: F.regexp_replace(y, ":.*$", "")), "|"), F.lit("|"))
        out = F.when(F.startswith(x, F.lit("SPDX:")), F.struct(F.lit(1).alias("take"), F.replace(F.substring(x, 6, 1000), F.lit("_"), F.lit(" ")).alias("licence")))
        out = out.when((x == "AllRights") & F.regexp_replace(F.coalesce(F.get(ids, i + 1), F.lit("")), ":.*$", "").isin(*OWN_TEXT), F.struct(F.lit(1).alias("take"), F.lit(None).cast("string").alias("licence")))
        for names, licence in RULES:
            told = F.lit(licence)
            if "{}" in licence:
                said = [full(version(F.get(ids, i + k))) for k in range(len(names) - 1, -1, -1)]
                v = F.coalesce(*[F.when(y != "", y) for y in said])
                family, rest = licence.split("-{}")
                told = F.when(v.isNull(), F.lit(family)).otherwise(F.concat(F.lit(f"{family}-"), v, F.lit(rest or "-only")))
            out = out.when(F.startswith(ahead, F.lit("|" + "|".join(names) + "|")), F.struct(F.lit(len(names)).alias("take"), told.alias("licence")))
        return out.otherwise(F.struct(F.lit(1).alias("take"), F.lit(None).cast("string").alias("licence"))).cast(item)

    start = F.struct(F.lit(0).alias("skip"), F.array().cast("array<string>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        taken = (acc["skip"] == 0) & x["licence"].isNotNull()
        out = F.when(taken & ~F.array_contains(acc["out"], x["licence"]), F.array_append(acc["out"], x["licence"])).otherwise(acc["out"])
        return F.struct(F.when(acc["skip"] > 0, acc["skip"] - 1).otherwise(x["take"] - 1).alias("skip"), out.alias("out"))

    return F.aggregate(F.transform(ids, at), start, step)["out"]


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_known, sentence_ids, licenses, license) of every whole text."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("t"))
    told = F.when(F.col("t").rlike(_HINT), F.flatten(F.transform(sentences(F.col("t")), _known))).otherwise(F.array().cast("array<string>"))
    rows = rows.select("doc_id", told.alias("ids"))
    rows = rows.withColumn("found", F.when(F.size("ids") > 0, licences(F.col("ids"))).otherwise(F.array().cast("array<string>")))
    choice = lambda x: (F.size("found") > 1) & F.contains(x, F.lit(" OR ")) & ~F.startswith(x, F.lit("("))
    whole = F.array_join(F.transform("found", lambda x: F.when(choice(x), F.concat(F.lit("("), x, F.lit(")"))).otherwise(x)), " AND ")
    licence = F.when(F.size("ids") == 0, "none").when(F.size("found") == 0, "unknown").otherwise(whole)
    return rows.select("doc_id", F.size("ids").cast("long").alias("n_known"), F.array_join("ids", " ").alias("sentence_ids"), F.array_join("found", ", ").alias("licenses"), licence.alias("license"))
