"""Licence scan by sentence rules, in DataFrame functions only.

A text is cut into sentences, each is normalised, and what it says about
licences becomes identifiers: sentences of licence texts by a table, and
references ("licensed under ...") by the licence's name. Ordered rules over the
text's identifier sequence name the licences; what a rule matched is used up.
Texts and sentences without any of a few words, one of which everything known
has, are passed by before the costly steps.
"""

from __future__ import annotations

import re
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values. Sentences are normalised: lower case, runs of other characters than a-z and 0-9 are one space.
SENTENCES = {
    "Apache2Copy": ["you may obtain a copy of the license at http www apache org licenses license 2 0", "you may obtain a copy of the license at https www apache org licenses license 2 0"],
    "AsIsBasis": ["distributed under the license is distributed on an as is basis"],
    "MitGrant": ["permission is hereby granted free of charge to any person obtaining a copy of this software"],
    "NoticeIncluded": ["the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"],
    "AsIsWarranty": ["the software is provided as is without warranty of any kind"],
    "IscGrant": ["permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted"],
    "IscNotice": ["provided that the above copyright notice and this permission notice appear in all copies"],
    "OrLater": ["or at your option any later version", "or any later version"],
    "BsdUse": ["redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"],
    "BsdSource": ["redistributions of source code must retain the above copyright notice"],
    "BsdBinary": ["redistributions in binary form must reproduce the above copyright notice"],
    "BsdAdvert": ["all advertising materials mentioning features or use of this software must display the following acknowledgement"],
    "BsdEndorse": ["may be used to endorse or promote products derived from this software without specific prior written permission"],
    "ZlibGrant": ["permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely"],
    "BoostGrant": ["permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license"],
    "WtfplGrant": ["you just do what the fuck you want to"],
    "UnlicenseGrant": ["this is free and unencumbered software released into the public domain"],
    "Ref-CC0-1.0": ["cc0 1 0 universal license"],
}
_GNU = {"GPL": "general public license", "LGPL": "lesser general public license; library general public license", "AGPL": "affero general public license", "GFDL": "free documentation license"}
_GNU_VERSIONS = "GPL-1.0 GPL-2.0 GPL-3.0 LGPL-2.0 LGPL-2.1 LGPL-3.0 AGPL-1.0 AGPL-3.0 GFDL-1.1 GFDL-1.2 GFDL-1.3"
# Names by licence; "a b license 1 0" stands for its usual spellings, see _spelled.
_NAMES = {
    "MIT": "mit license; mit licence; expat license; x11 license",
    "Apache-1.1": "apache software license 1 1", "Apache-2.0": "apache license 2 0; apache 2 0 license; apache software license 2 0",
    "BSD-2-Clause": "bsd 2 clause license; 2 clause bsd license; simplified bsd license; freebsd license", "BSD-3-Clause": "bsd 3 clause license; 3 clause bsd license; new bsd license; modified bsd license; revised bsd license", "BSD-4-Clause": "bsd 4 clause license; original bsd license", "0BSD": "zero clause bsd license; bsd zero clause license; 0bsd license",
    "ISC": "isc license", "Zlib": "zlib license; zlib libpng license", "BSL-1.0": "boost software license 1 0", "Unlicense": "unlicense", "WTFPL": "wtfpl; do what the fuck you want to public license", "Beerware": "beerware license; beer ware license",
    "MPL-1.0": "mozilla public license 1 0", "MPL-1.1": "mozilla public license 1 1; mpl 1 1", "MPL-2.0": "mozilla public license 2 0; mpl 2 0", "EPL-1.0": "eclipse public license 1 0", "EPL-2.0": "eclipse public license 2 0; epl 2 0", "CDDL-1.0": "common development and distribution license 1 0; cddl 1 0", "CDDL-1.1": "common development and distribution license 1 1", "CPL-1.0": "common public license 1 0",
    "EUPL-1.1": "european union public licence 1 1; eupl 1 1", "EUPL-1.2": "european union public licence 1 2; eupl 1 2", "CECILL-2.1": "cecill license 2 1; cecill 2 1", "Artistic-1.0": "artistic license 1 0", "Artistic-2.0": "artistic license 2 0", "AFL-3.0": "academic free license 3 0", "OSL-3.0": "open software license 3 0", "PSF-2.0": "python software foundation license 2; psf license 2", "PHP-3.01": "php license 3 01", "Ruby": "ruby license", "Vim": "vim license", "NCSA": "university of illinois ncsa open source license; ncsa license", "OpenSSL": "openssl license", "PostgreSQL": "postgresql license", "Sleepycat": "sleepycat license",
    "OFL-1.1": "sil open font license 1 1; open font license 1 1", "MS-PL": "microsoft public license; ms pl", "MS-RL": "microsoft reciprocal license; ms rl", "QPL-1.0": "q public license 1 0", "IPL-1.0": "ibm public license 1 0", "LPPL-1.3c": "latex project public license 1 3c", "Zend-2.0": "zend license 2 0", "ZPL-2.1": "zope public license 2 1", "MulanPSL-2.0": "mulan psl 2; mulan permissive software license 2", "UPL-1.0": "universal permissive license 1 0", "ODbL-1.0": "open database license 1 0; odbl 1 0", "ODC-By-1.0": "open data commons attribution license 1 0; odc by 1 0", "PDDL-1.0": "open data commons public domain dedication and license 1 0; pddl 1 0", "Elastic-2.0": "elastic license 2 0", "SSPL-1.0": "server side public license 1", "BUSL-1.1": "business source license 1 1",
    "CC0-1.0": "cc0 1 0 universal license; cc0 1 0 universal; cc0 1 0; cc0 license; creative commons zero 1 0",
}
_CC = {"by": "attribution", "by-sa": "attribution sharealike", "by-nd": "attribution noderivatives", "by-nc": "attribution noncommercial", "by-nc-sa": "attribution noncommercial sharealike", "by-nc-nd": "attribution noncommercial noderivatives"}
LEAD = "(?:(?:licensed|released|distributed|available|provided|published|covered|governed|modify it) (?:under|by) |subject to )(?:the )?(?:terms (?:and conditions )?of )?(?:the )?"
LIKELY = r"licen[sc]|permission|redistribut|warranty|domain|later|advertising|fuck|\b(?:cc|cc0|creative|gnu|[al]?gpl[a-z0-9]*|gfdl[a-z0-9]*|mpl|epl|cddl|eupl|cecill|wtfpl|ms|upl|odbl|odc|pddl|mulan)\b"
# Fixed values. Ordered rules: licence and its sequence of identifiers; (x )? may miss.
RULES = [
    ("BSD-4-Clause", "BsdUse BsdSource BsdBinary BsdAdvert( BsdEndorse)?"),
    ("BSD-3-Clause", "BsdUse BsdSource BsdBinary BsdEndorse"),
    ("BSD-2-Clause", "BsdUse BsdSource BsdBinary"),
    ("MIT", "MitGrant (NoticeIncluded )?AsIsWarranty"),
    ("ISC", "IscGrant (IscNotice )?AsIsWarranty"),
    ("Apache-2.0", "Ref-Apache-2[.]0 (Apache2Copy )?AsIsBasis"),
    ("Apache-2.0", "Ref-Apache-2[.]0 Apache2Copy"),
    ("Apache-2.0", "Apache2Copy( AsIsBasis)?"),
    ("MIT", "MitGrant"),
    ("ISC", "IscGrant( IscNotice)?"),
    ("Zlib", "ZlibGrant"),
    ("BSL-1.0", "BoostGrant"),
    ("WTFPL", "WtfplGrant"),
    ("Unlicense", "UnlicenseGrant"),
    ("%1-or-later", "Ref-([AL]?GPL-[0-9.]+|GFDL-[0-9.]+) OrLater"),  # %1: what the group holds
    ("%1-only", "Ref-([AL]?GPL-[0-9.]+|GFDL-[0-9.]+)"),
    ("%1", "Ref-([^ ]+)"),
]


def _norm(text: str) -> str:
    return " ".join("".join(c if c.isascii() and c.isalnum() else " " for c in text.lower()).split())


def _spelled(name: str) -> list[str]:
    """A name's spellings: the version at its end may follow a word for it."""
    words = name.split()
    k = len(words)
    while k and words[k - 1][0].isdigit() and words[k - 1] != "0bsd":
        k -= 1
    if k in (0, len(words)) or not {"license", "licence", "psl"} & set(words):
        return [name]
    head, tail = " ".join(words[:k]), " ".join(words[k:])
    return [f"{head} {v}{tail}" for v in ("", "version ", "v ", "v")]


def names() -> dict[str, str]:
    """Identifiers by normalised licence name."""
    out = {}
    for i in _GNU_VERSIONS.split():
        kind, version = i.split("-")
        v = version.removesuffix(".0").replace(".", " ")
        short = [f"{g}{kind.lower()}{x}{v}" for g, x in product(("", "gnu "), (" ", " v", "v", " version "))]
        long = [f"gnu {t} {x}{y}" for t, x, y in product(_GNU[kind].split("; "), ("version ", "v", ""), {v, _norm(version)})]
        full = [f"gnu {t} as published by the free software foundation {x}version {v}{y}" for t, x, y in product(_GNU[kind].split("; "), ("", "either "), ("", " of the license"))]
        if "library" in " ".join(long) and version != "2.0":
            long, full = ([n for n in x if "library" not in n] for x in (long, full))
        out |= {n: f"Ref-{i}" for n in (*short, *long, *full)} | {f"{n} or later": f"Ref-{i} OrLater" for n in (*short, *long)}
    for i, ns in _NAMES.items():
        out |= {s: f"Ref-{i}" for n in ns.split("; ") for s in _spelled(n)}
    for (kind, words), version in product(_CC.items(), ("2.0", "2.5", "3.0", "4.0")):
        for n, tail in product((f"cc {kind} {version}", f"creative commons {words} {version}"), ("", " license", " international license", " international", " unported license", " unported", " generic license")):
            out[_norm(n + tail)] = f"Ref-CC-{kind.upper()}-{version}"
    return out


def tags() -> dict[str, str]:
    """Identifiers by normalised SPDX tag."""
    known = dict.fromkeys(i for i in names().values() if " " not in i)
    out = {_norm(i.removeprefix("Ref-")): i for i in known}
    for i in _GNU_VERSIONS.split():
        out |= {_norm(f"{i}-only"): f"Ref-{i}", _norm(f"{i}-or-later"): f"Ref-{i} OrLater"}
    return {f"spdx license identifier {n}": i for n, i in out.items()}


def sentences() -> dict[str, str]:
    """Identifier by normalised sentence."""
    return {s: i for i, forms in SENTENCES.items() for s in forms}


def _any(found) -> str:
    return "|".join(sorted(found, key=lambda s: (-len(s), s)))


def pattern() -> str:
    """What is known, in a normalised sentence between spaces."""
    return f" ({LEAD}(?:{_any(names())})|{_any([*tags(), *sentences()])})(?= )"


MARK = "\x01"
BREAK = r"""([.!?]["')\]]*)[ \t\r\n\f\x0B]+([A-Z"'(\[*-])"""
PARAGRAPH = r"\n[ \t\r]*\n"


def sentence_ids(text: Column) -> Column:
    """Identifiers of what a text's sentences say about licences, in order, each followed by a space."""
    parts = F.split(F.regexp_replace(F.regexp_replace(text, BREAK, f"$1{MARK}$2"), PARAGRAPH, MARK), MARK)
    norm = F.transform(parts, lambda s: F.concat(F.lit(" "), F.regexp_replace(F.lower(s), "[^a-z0-9]+", " "), F.lit(" ")))
    norm = F.filter(norm, lambda s: s.rlike(LIKELY))
    table = F.create_map(*(F.lit(x) for pair in (names() | tags() | sentences()).items() for x in pair))
    found = F.flatten(F.transform(norm, lambda s: F.regexp_extract_all(s, F.lit(pattern()), F.lit(1))))
    named = F.transform(found, lambda s: F.concat(F.coalesce(table[s], table[F.regexp_replace(s, f"^{LEAD}", "")]), F.lit(" ")))
    return F.when(text.rlike(f"(?i){LIKELY}"), F.concat_ws("", named)).otherwise("")


def matched(ids: Column) -> Column:
    """The identifier sequence with what the ordered rules match replaced by <licence>."""
    seq = F.concat(F.lit(" "), ids)
    for licence, rule in RULES:
        seq = F.regexp_replace(seq, rf"(?<= ){rule} ", f"<{licence.replace('%', '$')}> ")
    return seq


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row: id, sentences, n_sentences, licences (sorted, each once, space-joined).

    ``unmatched`` counts known sentences that no rule used. Null and empty
    texts have none of either; very long texts are read whole. Repeated rows
    are scanned each; extra columns are ignored; an empty table gives no rows.
    """
    rows = docs.select(F.col(id_col).cast("long").alias(id_col), F.trim(sentence_ids(F.coalesce(F.col(text_col).cast("string"), F.lit("")))).alias("sentences"))
    seq = F.when(F.col("sentences") == "", F.lit(" ")).otherwise(matched(F.concat(F.col("sentences"), F.lit(" "))))
    rows = rows.withColumn("sequence", seq)
    found = F.array_sort(F.array_distinct(F.regexp_extract_all("sequence", F.lit("<([^>]*)>"), F.lit(1))))
    left = F.size(F.regexp_extract_all("sequence", F.lit("(?<= )([A-Za-z0-9.-]+) "), F.lit(1)))
    count = F.when(F.col("sentences") == "", 0).otherwise(F.size(F.split("sentences", " ")))
    return rows.select(id_col, "sentences", count.cast("long").alias("n_sentences"), F.concat_ws(" ", found).alias("licences"), left.cast("long").alias("unmatched"))


def oracle() -> str:
    """The same scan over ``documents`` in DuckDB SQL: every known phrase is joined with the sentences that contain it."""
    phrases = {re.sub(f"^{LEAD}|(?<= ){LEAD}", "@ ", n): i for n, i in ({f"@ {n}": i for n, i in names().items()} | tags() | sentences()).items()}
    pairs = ", ".join(f"('{s}', '{i}')" for s, i in phrases.items())
    steps, at = [], "s0"
    for k, (licence, rule) in enumerate(RULES, 1):
        steps.append(f"s{k} AS (SELECT doc_id, sentences, regexp_replace(q, ' {rule.replace('[^ ]', '[^_]').replace(' ', '  ').replace('[^_]', '[^ ]')} ', ' <{licence.replace('%', chr(92))}> ', 'g') AS q FROM {at})")
        at = f"s{k}"
    quote = BREAK.replace("'", "''")
    return f"""
WITH known(phrase, id) AS (VALUES {pairs}),
d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
l AS (SELECT * FROM d WHERE regexp_matches(t, '{LIKELY}', 'i')),
c AS (SELECT r, string_split(regexp_replace(regexp_replace(t, '{quote}', '\\1' || chr(1) || '\\2', 'g'), '{PARAGRAPH}', chr(1), 'g'), chr(1)) AS x FROM l),
e AS (SELECT r, unnest(x) AS s, unnest(range(len(x))) AS k FROM c),
n AS (SELECT r, k, regexp_replace(replace(' ' || regexp_replace(lower(s), '[^a-z0-9]+', ' ', 'g') || ' ', ' ', '  '), ' {LEAD.replace(" ", "  ")}', ' @  ', 'g') AS s FROM e),
j AS (SELECT r, k, id, phrase, s FROM n JOIN known ON contains(s, ' ' || replace(phrase, ' ', '  ') || ' ')),
p AS (SELECT r, k, id, length(phrase) AS n, unnest(list_filter(range(1, length(s) + 1), lambda i: substr(s, i, length(replace(phrase, ' ', '  ')) + 2) = ' ' || replace(phrase, ' ', '  ') || ' ')) AS pos, length(replace(phrase, ' ', '  ')) AS w FROM j),
o AS (SELECT * FROM p a WHERE NOT EXISTS (SELECT 1 FROM p b WHERE a.r = b.r AND a.k = b.k AND (b.pos < a.pos AND a.pos < b.pos + b.w OR a.pos = b.pos AND b.w > a.w))),
g AS (SELECT r, string_agg(id, ' ' ORDER BY k, pos) AS sentences FROM o GROUP BY r),
h AS (SELECT doc_id, coalesce(sentences, '') AS sentences FROM d LEFT JOIN g USING (r)),
s0 AS (SELECT doc_id, sentences, ' ' || replace(sentences, ' ', '  ') || ' ' AS q FROM h),
{", ".join(steps)},
z AS (SELECT doc_id, sentences, regexp_extract_all(q, '<([^>]*)>', 1) AS x, regexp_extract_all(q, ' ([A-Za-z0-9.-]+)', 1) AS u FROM {at})
SELECT doc_id, sentences, CASE WHEN sentences = '' THEN 0 ELSE len(string_split(sentences, ' ')) END::BIGINT AS n_sentences,
  coalesce(array_to_string(list_sort(list_distinct(x)), ' '), '') AS licences, len(u)::BIGINT AS unmatched FROM z"""
