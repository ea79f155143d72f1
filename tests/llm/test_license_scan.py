"""Sentence rules on planted texts, on whole licences as they are printed, and against a plain search."""

import random
import textwrap

from pyspark.sql import functions as F

from fathomline.llm import license_scan

from .helpers import documents

P = license_scan.PASSAGES
GRANT, NOTICE, AS_IS = P["mit-grant"], P["mit-notice"], P["mit-as-is"]
CASES = [
    ("Some text. This project is licensed under the MIT License.", ["MIT"], "permissive"),
    (f"{GRANT}\n{NOTICE}\n{AS_IS}", ["MIT"], "permissive"),
    (f"{AS_IS} {NOTICE} {GRANT}", [], None),
    (f"{GRANT}\n" + "Other words. " * 9 + f"{NOTICE} {AS_IS}", [], None),
    ("All rights reserved. Licensed under CC-BY-NC 4.0.", ["Proprietary", "CC-BY-NC-4.0"], "proprietary"),
    ("The licence of poets is not a license.", [], None),
    ("MIT", [], None),
    ("x. " * 60_000 + "All rights reserved.", ["Proprietary"], "proprietary"),
    (None, [], None),
    ("", [], None),
]


def test_rules(spark):
    docs = documents(spark, [c[0] for c in CASES]).withColumn("kind", F.lit(1)).withColumn("licenses", F.lit(2)).withColumn("sentence_ids", F.lit(3))
    out = {r.doc_id: (list(r.licenses), r.kind) for r in license_scan.scan_licenses(docs).collect()}
    assert out == {k: (licenses, kind) for k, (_, licenses, kind) in enumerate(CASES, 1)}
    assert license_scan.scan_licenses(docs.limit(0)).count() == 0 and license_scan.scan_licenses(docs.union(docs)).count() == 2 * len(CASES)


def wrapped(*paragraphs, prefix="", between="\n\n"):
    return between.join(textwrap.fill(" ".join(p.split()), 72, initial_indent=prefix, subsequent_indent=prefix) for p in paragraphs)


IN_NO_EVENT = "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY."
LIABLE = "IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT DAMAGES HOWEVER CAUSED."
DETAILS = "See the GNU General Public License for more details."
COPYRIGHT = "Copyright (c) 2024, A. Holder. All rights reserved."
WHOLE = {
    "MIT": wrapped("MIT License", "Copyright (c) 2024 A. Holder", GRANT, NOTICE, f"{AS_IS} {IN_NO_EVENT}"),
    "Apache-2.0": "// Copyright 2024 A. Holder\n//\n" + wrapped(P["apache-head"] + " You may obtain a copy of the License at", "    http://www.apache.org/licenses/LICENSE-2.0", P["apache-as-is"], prefix="// ", between="\n//\n"),
    "GPL-3.0": wrapped(P["gpl3-free"], f"{P['gpl-warranty']} {DETAILS}", "You should have received a copy of the GNU General Public License along with this program.", prefix=" * ", between="\n *\n"),
    "GPL-2.0": wrapped(P["gpl2-free"], f"{P['gpl-warranty']} {DETAILS}", prefix="# ", between="\n#\n"),
    "LGPL-2.1": wrapped(P["lgpl21-free"], P["lgpl-warranty"]),
    "AGPL-3.0": wrapped(P["agpl3-free"], P["gpl-warranty"]),
    "MPL-2.0": wrapped(f"{P['mpl-head']} {P['mpl-copy']}", prefix="/* "),
    "BSD-3-Clause": wrapped(COPYRIGHT, P["bsd-redistribute"], f"1. {P['bsd-source']}", f"2. {P['bsd-binary']}", f"3. {P['bsd-names']}", f"{P['bsd-as-is']} {LIABLE}"),
    "BSD-2-Clause": wrapped(COPYRIGHT, P["bsd-redistribute"], f"1. {P['bsd-source']}", f"2. {P['bsd-binary']}", f"{P['bsd-as-is']} {LIABLE}", between="\n"),
    "ISC": wrapped("ISC License", P["isc-grant"], f"{P['isc-as-is']} {IN_NO_EVENT}"),
    "Unlicense": wrapped(P["unlicense-free"], P["unlicense-anyone"]),
    "CC0-1.0": "/* SPDX-License-Identifier: CC0-1.0 */\nint x;",
}


def test_whole_licences():
    scanner = license_scan.standard_scanner()
    for licence, text in WHOLE.items():
        for around in (text, f"Words before.\n\n{text}\n\nWords after.", text.replace("\n", "\r\n")):
            sequence = scanner.identifiers(around)
            assert [m[0] for m in scanner.matches(sequence)] in ([licence], [licence] * 2), (licence, sequence)
            assert len(sequence) == len({n for _, n in sequence}), licence
    assert scanner.matches(scanner.identifiers("SPDX-License-Identifier: MIT"))[0][:2] == ("MIT", "permissive")


def test_own_sentences_and_random_sequences():
    """Matches against a plain search over sentences; own tables need no word of the standard ones."""
    own = license_scan.Scanner({"x": "use is free for all"}, [("Own", "permissive", ("x",))])
    assert own.matches(own.identifiers("Use is FREE, for all!")) == [("Own", "permissive", 0)]
    rng = random.Random(2)
    sentences = {k: f"known sentence {k * 3}" for k in "abc"}
    rules = [("AB", "permissive", "ab"), ("ABC", "permissive", "abc"), ("CA", "copyleft", "ca")]
    scanner = license_scan.Scanner(sentences, rules)
    for _ in range(300):
        picks = [rng.choice("abc......") for _ in range(14)]
        text = " ".join(f"{sentences.get(p, f'some other words {k}')}." for k, p in enumerate(picks))
        wanted = set()
        for licence, kind, names in rules:
            for k, p in enumerate(picks):
                at = k
                for name in names[1:]:
                    at = next((j for j in range(at + 1, min(len(picks), at + license_scan.GAP + 2)) if picks[j] == name), None) if at is not None else None
                if p == names[0] and at is not None:
                    wanted.add((licence, kind, k))
        assert set(scanner.matches(scanner.identifiers(text))) == wanted, picks
