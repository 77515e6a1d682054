import re

import duckdb

from passagemill.llm.licenses import BREAK, LEAD, LIKELY, PARAGRAPH, RULES, SENTENCES, names, oracle, scan, sentences, tags


def brute(text):
    """Per sentence, at each word the longest known phrase that starts there, found by comparing words."""
    known = {tuple(n.split()): i for n, i in (tags() | sentences()).items()}
    named = {tuple(n.split()): i for n, i in names().items()}
    found = []
    for s in re.split("\x01", re.sub(PARAGRAPH, "\x01", re.sub(BREAK, "\\1\x01\\2", text or ""))):
        norm = re.sub(r"[^a-z0-9]+", " ", s.lower()).strip()
        words = norm.split()
        at = 0
        while at < len(words):
            rest = " ".join(words[at : at + 16]) + " "
            lead = re.match(LEAD, rest)
            skip = len(lead[0].split()) if lead else 0
            options = [(k, i) for k in range(min(len(words), at + 40), at, -1) if (i := known.get(tuple(words[at:k])))]
            if lead:
                options += [(k, i) for k in range(min(len(words), at + 40), at + skip, -1) if (i := named.get(tuple(words[at + skip : k])))]
            if options:
                at, i = max(options)
                found += i.split()
            else:
                at += 1
    seq = " " + " ".join(found) + " "
    for licence, rule in RULES:
        seq = re.sub(rf"(?<= ){rule} ", f"<{licence.replace('%', chr(92))}> ", seq)
    return " ".join(found), len(found), " ".join(sorted(set(re.findall("<([^>]*)>", seq)))), len(re.findall("(?<= )[A-Za-z0-9.-]+ ", seq))


MIT = "Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software. The above copyright notice and this permission notice shall be included in\nall copies or substantial portions of the Software.\n\nTHE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND."
CASES = {
    MIT: "MIT",
    "Released under the MIT License.\nReleased under the MIT License.": "MIT",
    "x Licensed under the Apache License, Version 2.0. y": "Apache-2.0",
    "either version 3 of the License, or (at your option) any later version": "",
    "you can modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version": "GPL-3.0-or-later",
    "unlicensed": "",
    "Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0",
    "Licensed under CC BY 4.0. See below! Subject to the terms of the Mozilla Public\nLicense, v. 2.0": "CC-BY-4.0 MPL-2.0",
    "SPDX-License-Identifier: LGPL-2.1-or-later": "LGPL-2.1-or-later",
    "// SPDX-License-Identifier: BSD-3-Clause": "BSD-3-Clause",
    "distributed under the terms of the GPLv2 or later": "GPL-2.0-or-later",
    "This is free and unencumbered software released into the public\ndomain.": "Unlicense",
    "redistributions under\n\nthe MIT license": "",
}


def test_sequences(spark, odd, nothing):
    docs = spark.createDataFrame(list(enumerate(CASES, 100)), "doc_id long, text string").unionByName(odd.select("doc_id", "text"))
    got = sorted((r.doc_id, r.sentences, r.n_sentences, r.licences, r.unmatched) for r in scan(docs).collect())
    assert got == sorted((r.doc_id, *brute(r.text)) for r in docs.collect())
    assert [g[3] for g in got if g[0] >= 100] == list(CASES.values())
    assert scan(nothing).count() == 0
    documents = docs.toArrow()  # noqa: F841
    assert sorted(duckdb.sql(oracle()).fetchall()) == got


def test_no_python_in_the_plan(odd):
    plan = scan(odd)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas|Exchange", plan)


def test_everything_known_is_found_however_wrapped(spark):
    known = [*sentences(), *tags(), *(f"released under the {n}" for n in names())]
    assert len(known) > 800 and len({i.split()[0] for i in names().values()}) >= 60
    assert all(re.search(LIKELY, s) for s in known)
    texts = [s.replace(" ", gap) for s in known for gap in (" ", "\n", ",\t")]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = sorted((r.doc_id, r.sentences, r.n_sentences, r.licences, r.unmatched) for r in scan(docs).collect())
    assert got == [(k, *brute(t)) for k, t in enumerate(texts)] and all(g[2] for g in got)
    assert all(set(f) <= set("abcdefghijklmnopqrstuvwxyz0123456789 ") for forms in SENTENCES.values() for f in forms)
