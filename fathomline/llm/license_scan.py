"""Licence scans by sentence rules.

A text is cut into sentences: at full stops, at empty lines, before list marks and after a colon that ends a line. For
notices that stand on lines of their own it is cut at every line end as well. Each sentence is normalised to its lower-case
letters and digits, and looked up among the known licence sentences, which the same code has cut from the licences' texts;
what is left of a document is its sequence of sentence identifiers. A rule names identifiers that have to follow one another
in this order, with at most GAP other sentences from one to the next; a document has a rule's licence where the rule matches.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator, Mapping, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame

from fathomline.llm.common import text_slices

#: Passages of licences: fixed values.
PASSAGES = {
    "mit-grant": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without
        restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the
        Software is furnished to do so, subject to the following conditions:""",
    "mit-notice": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "mit-as-is": """THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR
        PURPOSE AND NONINFRINGEMENT.""",
    "apache-use": "you may not use this file except in compliance with the License.",
    "apache-copy": ("You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0", "http://www.apache.org/licenses/LICENSE-2.0"),
    "apache-as-is": """Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY
        KIND, either express or implied.""",
    "apache-head": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
    "gpl3-free": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either
        version 3 of the License, or (at your option) any later version.""",
    "gpl2-free": """This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either
        version 2 of the License, or (at your option) any later version.""",
    "gpl-warranty": """This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR
        PURPOSE.""",
    "lgpl3-free": """This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either
        version 3 of the License, or (at your option) any later version.""",
    "lgpl21-free": """This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either
        version 2.1 of the License, or (at your option) any later version.""",
    "lgpl-warranty": """This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR
        PURPOSE.""",
    "agpl3-free": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either
        version 3 of the License, or (at your option) any later version.""",
    "mpl-head": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "mpl-copy": "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "bsd-redistribute": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "bsd-source": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "bsd-binary": """Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided
        with the distribution.""",
    "bsd-names": """Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written
        permission.""",
    "bsd-as-is": """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF
        MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.""",
    "isc-grant": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission
        notice appear in all copies.""",
    "isc-as-is": """THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.""",
    "unlicense-free": "This is free and unencumbered software released into the public domain.",
    "unlicense-anyone": """Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or
        non-commercial, and by any means.""",
    "boost-grant": """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software")
        to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to
        do so, all subject to the following:""",
    "cc0-waive": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "public-domain": "dedicated to the public domain",
    "reserved": "All rights reserved",
}
#: Licences by identifier: kind, and names that notices call them by: fixed values.
NAMES = {
    "MIT": ("permissive", ("MIT License", "MIT")),
    "Apache-2.0": ("permissive", ("Apache License, Version 2.0", "Apache License Version 2.0 (the License)", "Apache License 2.0", "Apache-2.0")),
    "GPL-3.0": ("copyleft", ("GNU General Public License version 3", "GNU General Public License v3.0", "GNU GPL v3", "GPL-3.0", "GPL-3.0-only", "GPL-3.0-or-later", "GPLv3")),
    "GPL-2.0": ("copyleft", ("GNU General Public License version 2", "GNU General Public License v2.0", "GPL-2.0", "GPL-2.0-only", "GPL-2.0-or-later", "GPLv2")),
    "LGPL-3.0": ("copyleft", ("GNU Lesser General Public License version 3", "LGPL-3.0", "LGPL-3.0-only", "LGPL-3.0-or-later")),
    "LGPL-2.1": ("copyleft", ("GNU Lesser General Public License version 2.1", "LGPL-2.1", "LGPL-2.1-only", "LGPL-2.1-or-later")),
    "AGPL-3.0": ("copyleft", ("GNU Affero General Public License version 3", "AGPL-3.0", "AGPL-3.0-only", "AGPL-3.0-or-later")),
    "MPL-2.0": ("copyleft", ("Mozilla Public License, v. 2.0", "Mozilla Public License Version 2.0", "MPL-2.0")),
    "BSD-2-Clause": ("permissive", ("BSD 2-Clause License", "BSD-2-Clause")),
    "BSD-3-Clause": ("permissive", ("BSD 3-Clause License", "BSD-3-Clause")),
    "ISC": ("permissive", ("ISC License", "ISC")),
    "BSL-1.0": ("permissive", ("Boost Software License - Version 1.0", "BSL-1.0")),
    "Unlicense": ("permissive", ("Unlicense",)),
    "CC0-1.0": ("permissive", ("CC0 1.0", "CC0-1.0", "CC0 1.0 Universal")),
    "CC-BY-4.0": ("permissive", ("CC BY 4.0", "Creative Commons Attribution 4.0 International License")),
    "CC-BY-SA-4.0": ("copyleft", ("CC BY-SA 4.0", "Creative Commons Attribution-ShareAlike 4.0 International License")),
    "CC-BY-NC-4.0": ("non-commercial", ("CC BY-NC 4.0", "Creative Commons Attribution-NonCommercial 4.0 International License")),
}
#: Sentences about a licence with its name in place of {}; one that is the name alone counts if the name is more than a sign.
NOTICES = ("SPDX-License-Identifier: {}", *(f"{start}{verb} under {the}{{}}" for start in ("", *(f"This {x} is " for x in ("project", "work", "software", "file", "program", "library", "page", "code"))) for verb in ("licensed", "released", "distributed") for the in ("", "the ", "a ", "the terms of the ")))
#: (licence, identifiers in order) beside the names: fixed values.
RULES = (
    ("MIT", ("mit-grant", "mit-notice", "mit-as-is")),
    ("Apache-2.0", ("apache-use", "apache-copy")),
    ("Apache-2.0", ("apache-head", "apache-copy")),
    ("GPL-3.0", ("gpl3-free", "gpl-warranty")),
    ("GPL-2.0", ("gpl2-free", "gpl-warranty")),
    ("LGPL-3.0", ("lgpl3-free", "lgpl-warranty")),
    ("LGPL-2.1", ("lgpl21-free", "lgpl-warranty")),
    ("AGPL-3.0", ("agpl3-free", "gpl-warranty")),
    ("MPL-2.0", ("mpl-head", "mpl-copy")),
    ("BSD-3-Clause", ("bsd-redistribute", "bsd-source", "bsd-binary", "bsd-names", "bsd-as-is")),
    ("BSD-2-Clause", ("bsd-redistribute", "bsd-source", "bsd-binary", "bsd-as-is")),
    ("ISC", ("isc-grant", "isc-as-is")),
    ("BSL-1.0", ("boost-grant",)),
    ("Unlicense", ("unlicense-free", "unlicense-anyone")),
    ("CC0-1.0", ("cc0-waive",)),
    ("CC0-1.0", ("public-domain",)),
    ("Proprietary", ("reserved",)),
)
#: A match of the second that covers the first's makes the first void.
NARROWER = {"BSD-2-Clause": "BSD-3-Clause"}
#: The kind of a document with several is the first of these that it has.
STRICTEST = ("proprietary", "non-commercial", "copyleft", "permissive")
GAP = 3
#: Ends of sentences: a full stop, an empty line (also in a comment), a colon at a line's end, or a list mark that follows.
STOP = re.compile(r"[.!?]+(?=[\s\"')\]]|$)|\n[^\w\n]*(?=\n)|:[^\S\n]*(?=\n|$)|\n(?=[^\w\n]*(?:\(?(?:[0-9]{1,2}|[a-z])[.)])\s)|(?<=[0-9a-z][.)])(?=\s)")
LINE = re.compile(r"\n|[.!?]+(?=[\s\"')\]]|$)")
OTHER = re.compile(r"[^a-z0-9]+")
LETTERS = re.compile(r"[a-z]{2}")


def cuts(lowered: str, ends: re.Pattern) -> Iterator[tuple[int, str]]:
    """(place of the first letter or digit, normalised sentence) of each sentence with a word in it."""
    start = 0
    for end, after in [*((m.start(), m.end()) for m in ends.finditer(lowered)), (len(lowered), len(lowered))]:
        piece = lowered[start:end]
        if LETTERS.search(piece):
            normal = OTHER.sub(" ", piece)
            # The first letter or digit stands behind as many other signs as the first run of them has.
            lead = OTHER.match(piece)
            yield start + (lead.end() if lead else 0), normal.strip()
        start = after


class Scanner:
    """Known sentences by normalised text, and rules of their identifiers.

    sentences: passages by identifier, each cut here; those after the first of a passage get its identifier and a number.
    rules: (licence, kind, identifiers); an identifier of a passage stands for all its sentences.
    """

    def __init__(self, sentences: Mapping[str, str | Sequence[str]], rules: Sequence[tuple[str, str, Sequence[str]]]):
        self.known: dict[str, list[str]] = {}
        parts: dict[str, list[str]] = {}
        for name, forms in sentences.items():
            for form in [forms] if isinstance(forms, str) else forms:
                found = [s for _, s in cuts(" ".join(form.lower().split()), STOP)]
                parts[name] = [name if k == 0 else f"{name}-{k + 1}" for k in range(len(found))]
                for part, sentence in zip(parts[name], found):
                    if part not in self.known.setdefault(sentence, []):
                        self.known[sentence].append(part)
        self.rules = [(licence, kind, [p for w in wanted for p in parts.get(w, [w])]) for licence, kind, wanted in rules]
        self.by_first: dict[str, list[int]] = {}
        for k, (_, _, wanted) in enumerate(self.rules):
            self.by_first.setdefault(wanted[0], []).append(k)

    def identifiers(self, text: str | None) -> list[tuple[int, str]]:
        """(sentence number, identifier) in text order, each known sentence once; numbers count the sentences with a word."""
        lowered = text.lower() if text else ""
        found: dict[tuple[int, str], int] = {}
        places = []
        for number, (at, sentence) in enumerate(cuts(lowered, STOP)):
            places.append(at)
            for name in self.known.get(sentence, ()):
                found[at, name] = number
        if "\n" in lowered:
            number = 0
            for at, sentence in cuts(lowered, LINE):
                names = self.known.get(sentence)
                if names:
                    while number + 1 < len(places) and places[number + 1] <= at:
                        number += 1
                    for name in names:
                        found.setdefault((at, name), number)
        return [(number, name) for (_, name), number in sorted(found.items())]

    def matches(self, sequence: list[tuple[int, str]]) -> list[tuple[str, str, int]]:
        """(licence, kind, sentence number of the start) of each place where a rule matches."""
        out: dict[tuple[str, str, int], int] = {}
        for k, (first, name) in enumerate(sequence):
            for rule in self.by_first.get(name, ()):
                licence, kind, wanted = self.rules[rule]
                at, step = first, 1
                for number, following in sequence[k + 1 :]:
                    if step == len(wanted) or number - at > GAP + 1:
                        break
                    if following == wanted[step]:
                        at, step = number, step + 1
                if step == len(wanted):
                    out[licence, kind, first] = max(out.get((licence, kind, first), -1), at)
        texts = [(licence, kind, first, last) for (licence, kind, first), last in out.items() if last > first]
        void = {m for m in out if any(NARROWER.get(m[0]) == t[0] and t[2] <= m[2] <= t[3] for t in texts)}
        # "All rights reserved" just before a licence's text is part of its notice.
        void |= {m for m in out if m[1] == "proprietary" and any(t[1] in ("permissive", "copyleft") and t[2] - GAP - 1 <= m[2] <= t[3] for t in texts)}
        return sorted((m for m in out if m not in void), key=lambda m: (m[2], m[0]))


def standard_scanner() -> Scanner:
    """The licences of PASSAGES, NAMES and RULES."""
    sentences: dict[str, str | list[str]] = dict(PASSAGES)
    rules = []
    for licence, (kind, names) in NAMES.items():
        forms = [n.format(name) for name in names for n in NOTICES] + [f"{the}{n}" for n in names if " " in n for the in ("", "the ")]
        sentences[f"{licence.lower()}-name"] = forms
        rules.append((licence, kind, (f"{licence.lower()}-name",)))
    rules += [(licence, NAMES[licence][0] if licence in NAMES else licence.lower(), wanted) for licence, wanted in RULES]
    return Scanner(sentences, rules)


SCHEMA = "doc_id long, n_known long, sentence_ids array<string>, licenses array<string>, kind string"


def scan_licenses(docs: DataFrame, scanner: Scanner | None = None) -> DataFrame:
    """doc_id, n_known, sentence_ids, licenses and kind for each row of documents(doc_id, text, ...).

    sentence_ids: identifiers of the known sentences in text order, n_known of them; licenses: those of the rules that match, in
    the order in which they first start, those that start together by name, each once; kind: the strictest of their kinds, or
    null. Null and empty texts have none. Repeated rows are judged alike; other columns are ignored; empty in, empty out.
    """
    scanner = scanner or standard_scanner()

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches):
            names, licenses, kinds = [], [], []
            for text in batch.column("text").to_pylist():
                sequence = scanner.identifiers(text)
                found = scanner.matches(sequence)
                names.append([n for _, n in sequence])
                licenses.append(list(dict.fromkeys(m[0] for m in found)))
                kinds.append(next((k for k in STRICTEST if any(m[1] == k for m in found)), None))
            columns = [batch.column("doc_id"), pa.array(map(len, names), pa.int64()), *(pa.array(x, pa.list_(pa.string())) for x in (names, licenses)), pa.array(kinds, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_known", "sentence_ids", "licenses", "kind"])

    return docs.select("doc_id", "text").mapInArrow(scan, SCHEMA)
