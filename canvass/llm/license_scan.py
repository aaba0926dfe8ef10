"""Licence recognition by sentences and sequence rules.

A text is cut into sentences after final punctuation and at lines without
letters or digits, and normalised (lower case, letters, digits and inner dots,
single spaces; comment marks before a line go). Known licence sentences are
found from the start of any line of a sentence to the end of that line or a
later one, the longest first, so it does not matter where a text is wrapped.
The identifiers, in order of occurrence, form a sequence that an ordered list
of rules reads: a rule names identifiers that must follow each other, every
match yields the rule's licence and is consumed, and later rules see only what
is left. What is left of a sentence and holds a licence word without being
known gets the identifier ``unknown``, once.

Everything is one projection of the table: no shuffle, and a task holds one
document at a time. Only texts with a licence word are cut.

Names are wildcards: who must not be named in endorsements, what program is free
software, and what file a sentence says is licensed are replaced by one wording
first. SPDX identifiers, sentences that name a licence, and the notices of the
GNU and Creative Commons families follow from short tables by rule.

The SQL counterpart cuts at every line end and knows ``SENTENCES`` and
``RULES`` alone: it agrees on notices of one line. All others are tested by fixtures.

Nulls: a null text is empty and has no licence. Repeated rows are judged alike.
Very long texts are scanned whole, and a table without rows gives none. Ties
between sentences go to the longer one, between rules to the earlier one.
Columns other than id and text, whatever their names, pass unseen.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from canvass.llm.common import text_of

#: Known sentences after normalisation, by identifier.
SENTENCES = {
    "apache_2": ["licensed under the apache license version 2.0", "licensed under the apache license version 2.0 the license"],
    "apache_comply": ["you may not use this file except in compliance with the license"],
    "apache_copy": ["you may obtain a copy of the license at http www.apache.org licenses license 2.0"],
    "apache_limits": ["see the license for the specific language governing permissions and limitations under the license"],
    "mit_ref": ["released under the mit license", "licensed under the mit license", "this project is licensed under the mit license"],
    "mit_title": ["mit license", "the mit license"],
    "gpl_any": ["this work is licensed under the gnu general public license", "licensed under the gnu general public license"],
    "gpl_3": [
        "this work is licensed under the gnu general public license version 3",
        "licensed under the gnu general public license version 3",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license version 3",
    ],
    "gpl_2": ["licensed under the gnu general public license version 2", "this work is licensed under the gnu general public license version 2"],
    "or_later": ["either version 2 of the license or at your option any later version", "either version 3 of the license or at your option any later version"],
    "lgpl_3": ["licensed under the gnu lesser general public license version 3"],
    "mpl_2": ["this source code form is subject to the terms of the mozilla public license v. 2.0"],
    "cc_by": ["licensed under cc by 4.0", "this work is licensed under cc by 4.0"],
    "cc_by_sa": ["licensed under cc by sa 4.0", "this work is licensed under cc by sa 4.0"],
    "cc_by_nc": ["licensed under cc by nc 4.0", "this work is licensed under cc by nc 4.0"],
    "cc0": ["released under cc0 1.0 license"],
    "bsd_grant": ["redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"],
    "bsd_source": ["redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"],
    "bsd_binary": [
        "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation "
        "and or other materials provided with the distribution"
    ],
    "bsd_name": ["neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"],
    "all_rights": ["all rights reserved under copyright law"],
}
#: Licence and its identifier sequence; the first rule reads first.
RULES = [
    ("Apache-2.0", ["apache_2", "apache_comply", "apache_copy", "apache_limits"]),
    ("BSD-3-Clause", ["bsd_grant", "bsd_source", "bsd_binary", "bsd_name"]),
    ("BSD-2-Clause", ["bsd_grant", "bsd_source", "bsd_binary"]),
    ("GPL-3.0-or-later", ["gpl_3", "or_later"]),
    ("GPL-2.0-or-later", ["gpl_2", "or_later"]),
    ("GPL-3.0-only", ["gpl_3"]),
    ("GPL-2.0-only", ["gpl_2"]),
    ("GPL", ["gpl_any"]),
    ("LGPL-3.0-only", ["lgpl_3"]),
    ("Apache-2.0", ["apache_2"]),
    ("MIT", ["mit_title", "mit_ref"]),
    ("MIT", ["mit_ref"]),
    ("MIT", ["mit_title"]),
    ("MPL-2.0", ["mpl_2"]),
    ("CC-BY-NC-4.0", ["cc_by_nc"]),
    ("CC-BY-SA-4.0", ["cc_by_sa"]),
    ("CC-BY-4.0", ["cc_by"]),
    ("CC0-1.0", ["cc0"]),
    ("Proprietary", ["all_rights"]),
]
def normalise(sentence: str) -> str:
    """The same normalisation for the known sentences, which are ASCII."""
    return re.sub(r"[^a-z0-9.]+", " ", sentence.lower()).strip(" .")


_MODIFY = "you can redistribute it and or modify it under the terms of the"
_FSF = "as published by the free software foundation"
_LATER = "either version {0} of the license or at your option any later version"
#: The GNU licences' names, short names and versions.
GNU = {
    "gpl": ("gnu general public license", "GPL", ("2", "3")),
    "lgpl": ("gnu lesser general public license", "LGPL", ("2.1", "3")),
    "lgpl_old": ("gnu library general public license", "LGPL", ("2",)),
    "agpl": ("gnu affero general public license", "AGPL", ("3",)),
}


def _gnu(kind: str, rest: str) -> list[str]:
    return [f"{head}{_MODIFY} {GNU[kind][0]} {rest}" for head in ("", "this program is free software ", "this program is free software; ")]


def _gnu_sentences() -> dict[str, list[str]]:
    """The standard notices of the GNU licences by identifier, such as ``gpl_2_later`` and ``gpl_2``."""
    out = {}
    for kind, (_, _, versions) in GNU.items():
        for v in versions:
            out[f"{kind}_{v}_later"] = [x for gap in (" ", "; ") for x in _gnu(kind, f"{_FSF}{gap}{_LATER.format(v)}")]
            only = (f"version {v} {_FSF}", f"{_FSF} version {v}", f"{_FSF} version {v} of the license", f"{_FSF}; version {v} of the license")
            out[f"{kind}_{v}"] = [x for said in only for x in _gnu(kind, said)]
    return out


#: SPDX identifiers.
SPDX = (
    "0BSD AFL-3.0 AGPL-3.0-only AGPL-3.0-or-later Apache-1.1 Apache-2.0 Artistic-2.0 BSD-2-Clause BSD-3-Clause BSD-4-Clause BSL-1.0 CC-BY-4.0 CC-BY-NC-4.0 CC-BY-SA-4.0 "
    "CC0-1.0 CDDL-1.0 ECL-2.0 EPL-1.0 EPL-2.0 EUPL-1.2 GPL-2.0-only GPL-2.0-or-later GPL-3.0-only GPL-3.0-or-later ISC LGPL-2.0-only LGPL-2.0-or-later LGPL-2.1-only "
    "LGPL-2.1-or-later LGPL-3.0-only LGPL-3.0-or-later MIT MIT-0 MPL-1.1 MPL-2.0 MS-PL NCSA OFL-1.1 OSL-3.0 PostgreSQL Python-2.0 Unlicense Vim WTFPL X11 Zlib"
).split()
#: Older SPDX spellings.
SPDX_OLD = {"GPL-2.0": "GPL-2.0-only", "GPL-2.0+": "GPL-2.0-or-later", "GPL-3.0": "GPL-3.0-only", "GPL-3.0+": "GPL-3.0-or-later", "LGPL-2.1": "LGPL-2.1-only", "LGPL-2.1+": "LGPL-2.1-or-later", "LGPL-3.0": "LGPL-3.0-only", "AGPL-3.0": "AGPL-3.0-only"}
#: What licences are called in sentences.
CALLED = {
    "MIT": ["mit license", "mit licence", "mit"],
    "Apache-2.0": ["apache license 2.0", "apache 2.0 license", "apache 2 license", "apache license v2.0", "apache software license version 2.0"],
    "BSD-3-Clause": ["bsd 3 clause license", "3 clause bsd license", "new bsd license", "modified bsd license", "three clause bsd license"],
    "BSD-2-Clause": ["bsd 2 clause license", "2 clause bsd license", "simplified bsd license", "two clause bsd license"],
    "ISC": ["isc license"],
    "BSL-1.0": ["boost software license version 1.0", "boost software license 1.0"],
    "MPL-2.0": ["mozilla public license 2.0", "mozilla public license version 2.0", "mozilla public license v2.0"],
    "EPL-2.0": ["eclipse public license 2.0", "eclipse public license v2.0", "eclipse public license version 2.0"],
    "EPL-1.0": ["eclipse public license v1.0", "eclipse public license 1.0"],
    "Unlicense": ["unlicense"],
    "Zlib": ["zlib license"],
    "WTFPL": ["wtfpl", "do what the fuck you want to public license"],
    "Artistic-2.0": ["artistic license 2.0", "artistic license version 2.0"],
    "PostgreSQL": ["postgresql license"],
    "OFL-1.1": ["sil open font license version 1.1", "sil open font license 1.1"],
    "EUPL-1.2": ["european union public licence version 1.2", "eupl version 1.2"],
    "GPL-2.0-only": ["gpl v2", "gplv2"],
    "GPL-3.0-only": ["gpl v3", "gplv3"],
    "LGPL-2.1-only": ["gnu lesser general public license version 2.1", "lgpl v2.1"],
    "AGPL-3.0-only": ["gnu affero general public license version 3", "agpl v3"],
}
#: The Creative Commons licences in words.
COMMONS = {
    "CC-BY": "attribution", "CC-BY-SA": "attribution sharealike", "CC-BY-NC": "attribution noncommercial", "CC-BY-ND": "attribution noderivatives",
    "CC-BY-NC-SA": "attribution noncommercial sharealike", "CC-BY-NC-ND": "attribution noncommercial noderivatives",
}


def _naming() -> dict[str, list[str]]:
    """Sentences that name a licence, by its SPDX identifier."""
    out: dict[str, list[str]] = {}
    for spdx in [*SPDX, *SPDX_OLD]:
        said = [f"spdx license identifier {normalise(spdx)}"] if not spdx.endswith("+") else []
        out.setdefault(SPDX_OLD.get(spdx, spdx), []).extend(said)
    for spdx, names in CALLED.items():
        out[spdx] += [f"{how} under the {name}" for name in names for how in ("licensed", "released", "distributed")]
    for stem, words in COMMONS.items():
        for version, where in (("4.0", "international"), ("3.0", "unported")):
            names = [f"creative commons {words} {version} {where} license", f"creative commons {words} {version} license"]
            out.setdefault(f"{stem}-{version}", []).extend(f"licensed under {the} {name}" for name in names for the in ("a", "the"))
    known = {x for said in SENTENCES.values() for x in said}
    return {spdx: [x for x in said if x not in known] for spdx, said in out.items()}


#: The sentences of the standard notices, most of them longer than a line; "; " is the end of a sentence or an empty line.
STANDARD = {
    "apache_2": [
        "the asf licenses this file to you under the apache license version 2.0 the license",
    ],
    "apache_copy": [f"you may obtain a copy of the license at{gap}{scheme} www.apache.org licenses license 2.0" for gap in (" ", "; ") for scheme in ("http", "https")],
    "apache_unless": [
        "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis "
        "without warranties or conditions of any kind either express or implied"
    ],
    "mit_grant": [
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software "
        "to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense "
        "and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions"
    ],
    "mit_notice": ["the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"],
    "isc_grant": [
        f"permission to use copy modify and {both}distribute this software for any purpose with or without fee is hereby granted "
        "provided that the above copyright notice and this permission notice appear in all copies" for both in ("", "or ")
    ],
    "unlicense": ["this is free and unencumbered software released into the public domain"],
    "unlicense_grant": [
        "anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary "
        "for any purpose commercial or non commercial and by any means"
    ],
    "boost_grant": [
        "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software "
        "to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software and to permit third parties "
        "to whom the software is furnished to do so all subject to the following"
    ],
    "mpl_2": ["this source code form is subject to the terms of the mozilla public license v; 2.0"],
    "mpl_copy": [f"if a copy of the mpl was not distributed with this file you can obtain one at{gap}{scheme} mozilla.org mpl 2.0" for gap in (" ", "; ") for scheme in ("http", "https")],
    "zlib_grant": [
        "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely "
        "subject to the following restrictions"
    ],
    "bsd_advert": ["all advertising materials mentioning features or use of this software must display the following acknowledgement"],
    "epl_2": [
        f"this program and the accompanying materials are made available under the terms of the eclipse public license {v}2.0 which is available at {scheme} www.eclipse.org legal epl {w}2.0"
        for v, w in (("", ""), ("v", "v")) for scheme in ("http", "https")
    ],
    "wtfpl": ["everyone is permitted to copy and distribute verbatim or modified copies of this license document and changing it is allowed as long as the name is changed"],
    "ofl": ["this font software is licensed under the sil open font license version 1.1"],
}
STANDARD |= _gnu_sentences()
NAMING = _naming()
#: They read before ``RULES``, and yield licences that those name too.
STANDARD_RULES = [
    ("Apache-2.0", ["apache_2", "apache_comply", "apache_copy", "apache_unless", "apache_limits"]),
    ("BSD-4-Clause", ["bsd_grant", "bsd_source", "bsd_binary", "bsd_advert", "bsd_name"]),
    ("MIT", ["mit_grant", "mit_notice"]),
    ("MIT", ["mit_grant"]),
    ("Unlicense", ["unlicense", "unlicense_grant"]),
    ("Unlicense", ["unlicense"]),
    ("MPL-2.0", ["mpl_2", "mpl_copy"]),
    ("ISC", ["isc_grant"]),
    ("BSL-1.0", ["boost_grant"]),
    ("Zlib", ["zlib_grant"]),
    ("EPL-2.0", ["epl_2"]),
    ("WTFPL", ["wtfpl"]),
    ("OFL-1.1", ["ofl"]),
    *[(f"{short}-{v if '.' in v else f'{v}.0'}-{how}", [f"{kind}_{v}{end}"]) for kind, (_, short, versions) in GNU.items() for v in versions for how, end in (("or-later", "_later"), ("only", ""))],
    *[(spdx, [f"named {spdx}"]) for spdx in NAMING],
]
#: Every known sentence holds one of these words.
CUE = "licen[sc]e|under cc|redistribut|copyright|any later version|under the (?:mit|wtfpl|l?gpl|agpl)|public domain"
#: Where the SQL counterpart cuts.
SPLIT = r"[.!?;]+([ \t]+|$)|[\r\n]+"


#: From raw lower-case text to normalised lines, sentences apart by empty lines. Lookbehinds keep runs of dots linear.
LINES = [
    (r"\r\n?", "\n"),
    (r"(?m)^[ \t]*+(?:[;!]++|(?:dnl|rem)(?=[ \t\n]|\z))", " "),
    (r"(?<![.!?;])[.!?;]++(?=[ \t\n]|\z)", "\n\n"),
    (r"[^a-z0-9.\n]+", " "),
    (r"(?m)^[ .]++|(?<![ .])[ .]++$", ""),
    # names are wildcards
    (r"neither[ \n]the[ \n]names?[ \n]of(?:[ \n]{1,2}(?!nor[ \n])[a-z0-9.]++){1,20}[ \n]{1,2}nor[ \n](?:the[ \n])?names?[ \n]of[ \n](?:its|their|any|the)(?:[ \n]of[ \n]its)?[ \n]contributors", "neither the name of the copyright holder nor the names of its contributors"),
    (r"(?m)^[a-z0-9.]++(?:[ \n][a-z0-9.]++){0,4}?[ \n]is[ \n]free[ \n]software(?=[ \n])", "this program is free software"),
    (r"(?m)^(?:this|the)(?:[ \n][a-z0-9.]++){0,3}?[ \n](?:file|code|software|library|module|package|program|project|work|repository|document|content|crate|tool)[ \n]is[ \n](?:also[ \n])?(?:licensed|distributed|released|provided|made[ \n]available)[ \n]under(?=[ \n])", "licensed under"),
]


def _known() -> dict[str, str]:
    """Identifiers by sentence, the longest first."""
    own = {s: f"named {name}" for name, said in NAMING.items() for s in said}
    own |= {s: name for table in (SENTENCES, STANDARD) for name, said in table.items() for s in said}
    return dict(sorted(own.items(), key=lambda x: -len(x[0])))


def _found() -> str:
    """A known sentence from line to line, or else the rest of a sentence from a line with a licence word up to the next known one."""
    said = "|".join(s.replace(".", "[.]").replace("; ", "\n\n+").replace(" ", "[ \n]") for s in _known())
    cue = CUE.replace(" ", "[ \n]")
    return f"(?m)^(?:(?:{said})$|.*(?:{cue}).*(?:\n(?!(?:{said})$).+)*+)"


def identifiers(text: Column) -> Column:
    """Identifiers of the licence sentences of ``text``, in order."""
    plain = {s.replace(";", ""): name for s, name in _known().items()}
    known = F.create_map(*[F.lit(x) for pair in plain.items() for x in pair])
    body = F.lower(text)
    for pattern, by in LINES:
        body = F.regexp_replace(body, pattern, by)
    found = F.regexp_extract_all(body, F.lit(_found()), F.lit(0))
    return F.transform(found, lambda s: F.coalesce(F.element_at(known, F.regexp_replace(s, "\n+", " ")), F.lit("unknown")))


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, licences (distinct, by rule order, comma-joined; null if none), rule matches, known and unknown sentences, sequence."""
    low = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"))
    cue = CUE.replace(" ", "[^a-z0-9]+")  # a line may end between its words
    seq = F.when(F.lower("text").rlike(cue), identifiers(F.col("text"))).otherwise(F.array().cast("array<string>"))
    out = low.select("id", seq.alias("ids")).withColumn("left", F.concat(F.lit("|"), F.array_join("ids", "||"), F.lit("|")))
    rules = STANDARD_RULES + RULES
    # rules of several identifiers in order, then what single identifiers are left
    sequences, counts = [rule for rule in rules if len(rule[1]) > 1], []
    for k, (_, wanted) in enumerate(sequences):
        run = "".join(f"|{w}|" for w in wanted)
        out = out.withColumn(f"n{k}", F.regexp_count("left", F.lit(re.sub(r"\|", "[|]", run.replace(".", "[.]"))))).withColumn("left", F.replace("left", F.lit(run), F.lit("||")))
        counts.append(F.col(f"n{k}"))
    first = {wanted[0]: name for name, wanted in reversed(rules) if len(wanted) == 1}
    single = F.create_map(*[F.lit(x) for pair in first.items() for x in pair])
    rest = F.filter(F.split("left", "[|]+"), lambda x: x != "")
    out = out.withColumn("rest", F.array_compact(F.transform(rest, lambda x: F.element_at(single, x))))
    of = {name: [c for c, (n, _) in zip(counts, sequences) if n == name] for name, _ in RULES + STANDARD_RULES}
    found = {name: reduce(lambda a, b: a | b, [c > 0 for c in own], F.array_contains("rest", name)) for name, own in of.items()}
    joined = F.array_join(F.array_compact(F.array(*[F.when(hit, F.lit(name)) for name, hit in found.items()])), ",")
    return out.select(
        F.col("id").alias(id_col),
        F.when(joined != "", joined).alias("licences"),
        (sum(counts[1:], counts[0]) + F.size("rest")).cast("long").alias("n_matches"),
        F.size(F.filter("ids", lambda x: x != "unknown")).cast("long").alias("n_known"),
        F.size(F.filter("ids", lambda x: x == "unknown")).cast("long").alias("n_unknown"),
        F.array_join("ids", ",").alias("sequence"),
    )


def _oracle() -> str:
    known = ", ".join(f"'{s}': '{name}'" for name, said in SENTENCES.items() for s in said)
    left, cols = "'|' || array_to_string(ids, '||') || '|'", []
    steps = [f"s0 as (select *, {left} as l0 from t)"]
    for k, (_, wanted) in enumerate(RULES):
        run = "".join(f"|{w}|" for w in wanted)
        steps.append(f"s{k + 1} as (select *, replace(l{k}, '{run}', '||') as l{k + 1}, ((length(l{k}) - length(replace(l{k}, '{run}', ''))) / {len(run)})::bigint as n{k} from s{k})")
        cols.append(f"n{k}")
    seen: list[str] = []
    names = []
    for name in dict.fromkeys(n for n, _ in RULES):
        own = " + ".join(f"n{k}" for k, (n, _) in enumerate(RULES) if n == name)
        names.append(f"case when {own} > 0 then '{name}' end")
    del seen
    return f"""
with known as (select map {{{known}}} as m),
t as (
  select doc_id, list_transform(list_filter(regexp_split_to_array(lower(coalesce(text, '')), '{SPLIT}'), lambda s: regexp_matches(s, '{CUE}')),
    lambda s: coalesce(m[trim(regexp_replace(s, '[^a-z0-9.]+', ' ', 'g'), ' .')], 'unknown')) as ids
  from documents, known
), {", ".join(steps)}
select doc_id, nullif(concat_ws(',', {", ".join(names)}), '') as licences, ({" + ".join(cols)})::bigint as n_matches,
       len(list_filter(ids, lambda x: x <> 'unknown'))::bigint as n_known, len(list_filter(ids, lambda x: x = 'unknown'))::bigint as n_unknown,
       array_to_string(ids, ',') as sequence
from s{len(RULES)}
"""


ORACLE = _oracle()
