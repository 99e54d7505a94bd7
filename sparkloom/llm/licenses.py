"""Licence scan by sentences and rules.

Sentences are normalised and looked up among known licence sentences; a document
becomes the sequence of their identifiers. A licence rule is an ordered sequence
of identifiers; it holds where they follow one another in the document with no
other known sentence between them. Longer rules win over shorter ones that they
contain.

Known sentences come from three tables: the sentences of licence texts and file
headers, notices that name a licence ("this library is released under the terms
of the ..."), which are brought to one form first, and SPDX tags.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from .common import batch_map

# Texts and file headers of public licences, whole sentences in their order. A number in front of the
# licence says how many sentences from the start already tell it; 0 means that all are needed.
TEXTS = [
    ("MIT", 1, "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("ISC", 1, "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS."),
    ("ISC", 1, "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("0BSD", 1, "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted."),
    ("BSD-3-Clause", 0, "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("BSD-2-Clause", 0, "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("Apache-2.0", 1, "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("Apache-2.0", 1, "Licensed to the Apache Software Foundation (ASF) under one or more contributor license agreements."),
    ("GPL-3.0-or-later", 0, "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program."),
    ("GPL-3.0-or-later", 0, "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0-or-later", 0, "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("GPL-2.0-only", 0, "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation."),
    ("LGPL-2.1-or-later", 0, "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("LGPL-3.0-or-later", 0, "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("AGPL-3.0-or-later", 0, "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("MPL-2.0", 1, "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at"),
    ("EPL-2.0", 1, "This program and the accompanying materials are made available under the terms of the Eclipse Public License v2.0 which accompanies this distribution, and is available at"),
    ("EPL-1.0", 1, "This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0 which accompanies this distribution, and is available at"),
    ("Zlib", 0, "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:"),
    ("Unlicense", 1, "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("BSL-1.0", 1, "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:"),
    ("CC0-1.0", 1, "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("CC0-1.0", 1, "The person who associated a work with this deed has dedicated the work to the public domain by waiving all of his or her rights to the work worldwide under copyright law, including all related and neighboring rights, to the extent allowed by law."),
    ("WTFPL", 0, "Everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed as long as the name is changed."),
    ("OFL-1.1", 1, "This Font Software is licensed under the SIL Open Font License, Version 1.1. This license is copied below, and is also available with a FAQ at"),
]

# Sentences that belong to no licence of their own.
OTHERS = {"all-rights": "All rights reserved."}

# Licences by identifier and the names that notices give them.
NAMES = {
    "MIT": ["MIT License", "MIT"],
    "Apache-2.0": ["Apache License, Version 2.0", "Apache License Version 2.0", "Apache License 2.0", "Apache License v2.0", "Apache Software License 2.0", "Apache 2.0 License", "Apache 2.0", "Apache-2.0 License", "Apache-2.0"],
    "Apache-1.1": ["Apache License, Version 1.1", "Apache Software License, Version 1.1"],
    "BSD-2-Clause": ["BSD 2-Clause License", "BSD-2-Clause License", "BSD-2-Clause", "2-Clause BSD License", "Simplified BSD License", "FreeBSD License"],
    "BSD-3-Clause": ["BSD 3-Clause License", "BSD-3-Clause License", "BSD-3-Clause", "3-Clause BSD License", "New BSD License", "Modified BSD License", "Revised BSD License"],
    "0BSD": ["Zero-Clause BSD License", "0BSD License", "0BSD"],
    "ISC": ["ISC License", "ISC"],
    "Zlib": ["zlib License", "zlib/libpng License"],
    "Unlicense": ["Unlicense", "Unlicense License"],
    "BSL-1.0": ["Boost Software License, Version 1.0", "Boost Software License 1.0", "Boost Software License"],
    "CC0-1.0": ["CC0 1.0", "CC0 1.0 Universal", "CC0", "Creative Commons Zero v1.0 Universal License", "Creative Commons CC0 1.0 Universal Public Domain Dedication"],
    "MPL-1.1": ["Mozilla Public License 1.1", "Mozilla Public License, Version 1.1", "MPL 1.1"],
    "MPL-2.0": ["Mozilla Public License 2.0", "Mozilla Public License, Version 2.0", "Mozilla Public License v2.0", "MPL 2.0", "MPL-2.0"],
    "EPL-1.0": ["Eclipse Public License 1.0", "Eclipse Public License, Version 1.0", "Eclipse Public License v1.0", "EPL 1.0"],
    "EPL-2.0": ["Eclipse Public License 2.0", "Eclipse Public License, Version 2.0", "Eclipse Public License v2.0", "EPL 2.0"],
    "CDDL-1.0": ["Common Development and Distribution License 1.0", "Common Development and Distribution License", "CDDL 1.0", "CDDL"],
    "Artistic-2.0": ["Artistic License 2.0", "Artistic License, Version 2.0"],
    "PSF-2.0": ["Python Software Foundation License", "Python Software Foundation License Version 2", "PSF License"],
    "OFL-1.1": ["SIL Open Font License, Version 1.1", "SIL Open Font License 1.1", "Open Font License 1.1"],
    "EUPL-1.2": ["European Union Public License 1.2", "European Union Public Licence, Version 1.2", "EUPL 1.2", "EUPL v1.2"],
    "MS-PL": ["Microsoft Public License", "Ms-PL"],
    "WTFPL": ["WTFPL", "Do What The Fuck You Want To Public License"],
    "PostgreSQL": ["PostgreSQL License"],
    "NCSA": ["University of Illinois/NCSA Open Source License", "NCSA License"],
    "ODbL-1.0": ["Open Database License", "Open Database License v1.0", "ODbL"],
}
# Families that have versions, with their long and short names.
GNU = {"GPL": ("GNU General Public License", ["1.0", "2.0", "3.0"]), "LGPL": ("GNU Lesser General Public License", ["2.0", "2.1", "3.0"]), "AGPL": ("GNU Affero General Public License", ["1.0", "3.0"]), "GFDL": ("GNU Free Documentation License", ["1.1", "1.2", "1.3"])}
COMMONS = {"BY": "Attribution", "BY-SA": "Attribution-ShareAlike", "BY-NC": "Attribution-NonCommercial", "BY-ND": "Attribution-NoDerivatives", "BY-NC-SA": "Attribution-NonCommercial-ShareAlike", "BY-NC-ND": "Attribution-NonCommercial-NoDerivatives"}
COMMONS_VERSIONS = ["1.0", "2.0", "2.5", "3.0", "4.0"]

#: Where sentences end: marks before white space or the end, line breaks of a paragraph's end, and comment leaders.
BREAK = re.compile(r"(?<=[.;:!?])(?<!dentifier:)[\"')\]]*(?=\s|[^\w\s]*(?:\s|\Z))|\n\s*\n")
LINE = re.compile(r"\n")
_NOT_WORD = re.compile(r"[^\w.]+|(?<!\d)\.|\.(?!\d)")


def normal(sentence: str) -> str:
    """Lower case, words only, single blanks; a dot stays between digits; one spelling of licence."""
    return " ".join(_NOT_WORD.sub(" ", sentence.lower().replace("licence", "license").replace("copyright holder's", "copyright holders")).split())


def sentences(text: str):
    """(start, end) of sentences: both what lies between breaks and, where that spans lines, each line of it."""
    at = 0
    for end in [m.start() for m in BREAK.finditer(text)] + [len(text)]:
        if end > at:
            yield at, end
            if "\n" in text[at:end]:
                a = at
                for m in [*LINE.finditer(text, at, end), None]:
                    b = m.start() if m else end
                    if b > a:
                        yield a, b
                    a = b + 1
        at = end


def _names() -> dict[str, str]:
    """Licence identifiers by the normal forms of their names."""
    out: dict[str, str] = {}

    def put(key: str, *names: str) -> None:
        for name in names:
            out.setdefault(normal(name), key)

    for key, names in NAMES.items():
        put(key, *names)
    for short, (long, versions) in GNU.items():
        for v in versions:
            few = v.removesuffix(".0")
            for name in (long, long.removeprefix("GNU "), short, f"GNU {short}"):
                for number in {v, few}:
                    put(f"{short}-{v}-only", *(f"{name}{glue}{number}{tail}" for glue in (" ", " v", " version ", "v", "-") for tail in ("", " only", " License")))
                    put(f"{short}-{v}-or-later", *(f"{name}{glue}{number} or {any_}" for glue in (" ", " v", " version ", "v") for any_ in ("later", "any later version", "(at your option) any later version")))
    for short, long in COMMONS.items():
        for v in COMMONS_VERSIONS:
            put(f"CC-{short}-{v}", *(f"{name} {v}{tail}" for name in (f"CC {short}", f"CC-{short}", f"Creative Commons {long}") for tail in ("", " License", " International", " International License", " Unported", " Unported License", " International Public License")))
    return out


LICENSE_NAMES = _names()
#: A notice without its subject and the words around the licence's name.
NOTICE = re.compile(r"(?:(?:this|these|the|all|our|its|it|that|each)(?: [\w.]+){0,3}? (?:is|are|was|were) )?(?:also |hereby |made |being |both )*(?:licensed|released|distributed|available|published|provided|shared|offered|covered|dual licensed) (?:to you )?(?:under|by)(?: the)?(?: terms(?: and conditions)? of(?: the)?)?(?: an?)? (.+)")
#: Words behind a name that add nothing.
TAIL = re.compile(r" (?:see (?:the )?license(?: (?:file|txt|md))?.*|the license)\Z")
SPDX = "spdx license identifier "
_JOINT = re.compile(r" (?:or|and) (?!later|any later)")


def _tables() -> tuple[dict[str, str], list[tuple[str, list[str]]]]:
    """Identifiers of the sentences of texts, and rules in the order in which they are tried: longest first."""
    known = {normal(s): k for k, s in OTHERS.items()}
    rules: list[tuple[str, list[str]]] = []
    number: dict[str, int] = {}
    for name, enough, text in TEXTS:
        ids = []
        for a, b in sentences(text):
            s = normal(text[a:b])
            if s.replace(".", "").isdigit() or not s:
                continue  # a version behind "v."
            if s not in known:
                number[name] = number.get(name, 0) + 1
                known[s] = f"{name}/{number[name]}"
            ids.append(known[s])
        rules += [(name, ids[:n]) for n in range(len(ids), (enough or len(ids)) - 1, -1)]
    notices = sorted({f"{way}:{key}" for key in LICENSE_NAMES.values() for way in ("notice", "spdx")})
    rules += [(k.split(":", 1)[1], [k]) for k in notices]
    order = sorted(range(len(rules)), key=lambda i: (-len(rules[i][1]), i))
    return known, [rules[i] for i in order]


KNOWN, RULES = _tables()
_BY_FIRST: dict[str, list[tuple[str, list[str]]]] = {}
for _rule in RULES:
    _BY_FIRST.setdefault(_rule[1][0], []).append(_rule)
#: Every known sentence holds one of these, so a text without any needs no sentence split.
ANCHORS = re.compile(r"licen[sc]|permission|copyright|warrant|redistribut|free software|rights reserved|(?:distributed|released|available|published|provided|shared|offered|covered) (?:to you )?(?:under|by)|liable|this program|either version|verbatim|unencumbered|copy of the mpl|anyone is free|waiv|gnu general", re.IGNORECASE)
assert all(map(ANCHORS.search, KNOWN)), [k for k in KNOWN if not ANCHORS.search(k)]


#: Identifiers of SPDX tags; the older ones of versioned families have no "-only".
SPDX_IDS = {normal(k): k for k in LICENSE_NAMES.values()} | {normal(k.removesuffix("-only")): k for k in LICENSE_NAMES.values() if k.endswith("-only")}


def known(sentence: str) -> list[str]:
    """Identifiers of a sentence: that of its text, of the licence that it names as a notice, or those of an SPDX tag."""
    s = normal(sentence)
    if s in KNOWN:
        return [KNOWN[s]]
    if s.startswith(SPDX):
        s = normal(re.sub(r"\+(?!\w)", "-or-later", sentence))
        return [f"spdx:{k}" for part in _JOINT.split(s.removeprefix(SPDX)) if (k := SPDX_IDS.get(part.split(" with ")[0]))]
    m = NOTICE.fullmatch(s)
    if m:
        name = TAIL.sub("", m[1])
        key = LICENSE_NAMES.get(name) or LICENSE_NAMES.get(name.removesuffix(" license"))
        if key:
            return [f"notice:{key}"]
        # Two licences at choice.
        several = [LICENSE_NAMES.get(p.removeprefix("the ").removeprefix("either ")) for p in _JOINT.split(name)]
        if len(several) > 1 and all(several):
            return [f"notice:{k}" for k in several]
    return []


def identify(text: str) -> list[tuple[int, int, str]]:
    """Known sentences of a text: (start, end, identifier) in order."""
    if not ANCHORS.search(text):
        return []
    out: list[tuple[int, int, str]] = []
    for a, b in sentences(text):
        s = text[a:b]
        if ANCHORS.search(s) and not (out and a < out[-1][1]):
            out += [(a, b, k) for k in known(s)]
    return out


def match(found: list[tuple[int, int, str]]) -> list[tuple[str, int, int]]:
    """(licence, start, end) by the first rule that fits at each place, left to right."""
    out, i = [], 0
    ids = [k for _, _, k in found]
    while i < len(ids):
        rule = next(((name, len(seq)) for name, seq in _BY_FIRST.get(ids[i], ()) if ids[i : i + len(seq)] == seq), None)
        if rule:
            out.append((rule[0], found[i][0], found[i + rule[1] - 1][1]))
            i += rule[1]
        else:
            i += 1
    return out


def _scan(batches: Iterator[pd.DataFrame]) -> Iterator[dict]:
    for pdf in batches:
        found = [identify(t) if isinstance(t, str) else [] for t in pdf["text"]]
        hits = [match(f) for f in found]
        yield {
            "doc_id": pdf["doc_id"],
            "licenses": [sorted({h[0] for h in hs}) for hs in hits],
            "sentence_ids": [[k for _, _, k in f] for f in found],
            "matches": [[dict(zip(("license", "start", "end"), h, strict=True)) for h in hs] for hs in hits],
        }


def scan(docs: DataFrame) -> DataFrame:
    """Licences that every text (doc_id, text) names or holds.

    Null and empty texts have none; repeated rows get equal results; null doc_ids
    stay; other columns are not read; an empty table gives no rows. Returns
    doc_id, licenses (sorted, distinct), sentence_ids (in order) and matches
    (license, start, end in characters).
    """
    return batch_map(docs.select("doc_id", "text"), _scan, "doc_id long, licenses array<string>, sentence_ids array<string>, matches array<struct<license string, start int, end int>>")


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
