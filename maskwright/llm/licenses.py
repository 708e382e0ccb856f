"""Licence scan by sentence rules.

A text is cut into sentences at the same marks as the known sentences: at line breaks and behind
one of . ! ? ; : before white space, but a tag (``SPDX-License-Identifier:``) and its value stay one sentence. Licences are also wrapped over lines, so a text is read
twice, by lines and with line breaks as spaces but at lines without letters or digits. Normalised sentences (lower case, runs of a-z and 0-9)
that are known map to identifiers. A place is the number of words before a sentence, which is the
same in both readings, so they merge into one sequence of identifiers by place.

Rules are sequences of identifiers in order of precedence. A rule fits where its identifiers follow
each other in the sequence (unknown sentences between them do not count) and takes those places; later
rules see only what is left. So a part of a longer licence is not reported, but the same part is where
it stands alone elsewhere in the text.

Results by case: a null or empty text has no sentences and no licence; repeated rows give
repeated results; null ids are kept; an empty table gives an empty result; only the id and
text columns are read; whole texts are scanned.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskwright.llm.common import map_rows

_HOLDERS = ("the copyright holder", "the author", "the University", "the copyright holders", "the project")
_BSD_DISCLAIM = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.'
)
#: Identifiers of sentences that licences and licence notices consist of.
SENTENCES = {
    "mit-ref": ("Released under the MIT License.", "Licensed under the MIT License.", "This project is licensed under the MIT License.", "Distributed under the MIT License.", "This software is released under the MIT License.", "MIT License"),
    "apache-2.0-ref": ("Licensed under the Apache License, Version 2.0.", 'Licensed under the Apache License, Version 2.0 (the "License");', "This project is licensed under the Apache License 2.0.", "Released under the Apache License 2.0."),
    "gpl-3.0-ref": ("This work is licensed under the GNU General Public License, version 3.", "Licensed under the GNU General Public License, version 3."),
    "gpl-2.0-ref": ("This work is licensed under the GNU General Public License, version 2.", "Licensed under the GNU General Public License, version 2."),
    "lgpl-3.0-ref": ("This work is licensed under the GNU Lesser General Public License, version 3.", "Licensed under the GNU Lesser General Public License, version 3."),
    "agpl-3.0-ref": ("This work is licensed under the GNU Affero General Public License, version 3.", "Licensed under the GNU Affero General Public License, version 3."),
    "cc-by-nc-4.0-ref": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    "cc-by-4.0-ref": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    "cc-by-sa-4.0-ref": ("Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    "cc-by-nd-4.0-ref": ("Licensed under CC BY-ND 4.0.", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License."),
    "cc-by-nc-sa-4.0-ref": ("Licensed under CC BY-NC-SA 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License."),
    "cc0-1.0-ref": ("Licensed under CC0 1.0.", "CC0 1.0 Universal"),
    "mpl-2.0-ref": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",),
    "mpl-2.0-copy": ("If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.", "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    "epl-2.0-ref": ("This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",),
    "bsl-1.0-ref": ("Distributed under the Boost Software License, Version 1.0.",),
    "bsd-3-ref": ("Released under the BSD 3-Clause License.", "Licensed under the BSD 3-Clause License."),
    "bsd-2-ref": ("Released under the BSD 2-Clause License.", "Licensed under the BSD 2-Clause License."),
    "isc-ref": ("Released under the ISC License.", "Licensed under the ISC License."),
    "wtfpl-do": ("You just DO WHAT THE FUCK YOU WANT TO.",),
    "unlicense-ref": ("This is free and unencumbered software released into the public domain.",),
    "unlicense-anyone": ("Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",),
    "mit-grant": (
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:',
    ),
    "mit-notice": ("The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",),
    "mit-asis": (
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.',
    ),
    "isc-grant": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ),
    "0bsd-grant": ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.",),
    "zlib-asis": ("This software is provided 'as-is', without any express or implied warranty.",),
    "zlib-grant": ("Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",),
    "bsd-grant": ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",),
    "bsd-source": ("Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",),
    "bsd-binary": (
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    ),
    "bsd-endorse": tuple(f"Neither the name of {who} nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission." for who in _HOLDERS),
    "bsd-asis": (_BSD_DISCLAIM,),
    "apache-comply": ("you may not use this file except in compliance with the License.",),
    "apache-copy": ("You may obtain a copy of the License at",),
    "apache-asis": (
        'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.',
    ),
    "gpl-3-free": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    "gpl-2-free": (
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    ),
    "agpl-3-free": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    "lgpl-2.1-free": (
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    ),
    "gpl-hope": (
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY;",
        "This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY;",
    ),
}
#: Licence rules in order of precedence, each a sequence of sentence identifiers.
RULES = (
    ("BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse", "bsd-asis")),
    ("BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse")),
    ("BSD-2-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-asis")),
    ("BSD-2-Clause", ("bsd-grant", "bsd-source", "bsd-binary")),
    ("MIT", ("mit-ref", "mit-grant", "mit-notice", "mit-asis")),
    ("MIT", ("mit-grant", "mit-notice", "mit-asis")),
    ("MIT", ("mit-grant", "mit-notice")),
    ("ISC", ("isc-grant",)),
    ("0BSD", ("0bsd-grant",)),
    ("Zlib", ("zlib-asis", "zlib-grant")),
    ("Apache-2.0", ("apache-2.0-ref", "apache-comply", "apache-copy", "apache-asis")),
    ("Apache-2.0", ("apache-2.0-ref", "apache-comply", "apache-copy")),
    ("Apache-2.0", ("apache-2.0-ref", "apache-comply")),
    ("AGPL-3.0-or-later", ("agpl-3-free", "gpl-hope")),
    ("AGPL-3.0-or-later", ("agpl-3-free",)),
    ("GPL-3.0-or-later", ("gpl-3-free", "gpl-hope")),
    ("GPL-3.0-or-later", ("gpl-3-free",)),
    ("GPL-2.0-or-later", ("gpl-2-free", "gpl-hope")),
    ("GPL-2.0-or-later", ("gpl-2-free",)),
    ("LGPL-2.1-or-later", ("lgpl-2.1-free", "gpl-hope")),
    ("LGPL-2.1-or-later", ("lgpl-2.1-free",)),
    ("MPL-2.0", ("mpl-2.0-ref", "mpl-2.0-copy")),
    ("Unlicense", ("unlicense-ref", "unlicense-anyone")),
    ("MIT", ("mit-ref",)),
    ("Apache-2.0", ("apache-2.0-ref",)),
    ("GPL-3.0-only", ("gpl-3.0-ref",)),
    ("GPL-2.0-only", ("gpl-2.0-ref",)),
    ("LGPL-3.0-only", ("lgpl-3.0-ref",)),
    ("AGPL-3.0-only", ("agpl-3.0-ref",)),
    ("CC-BY-NC-SA-4.0", ("cc-by-nc-sa-4.0-ref",)),
    ("CC-BY-NC-4.0", ("cc-by-nc-4.0-ref",)),
    ("CC-BY-ND-4.0", ("cc-by-nd-4.0-ref",)),
    ("CC-BY-SA-4.0", ("cc-by-sa-4.0-ref",)),
    ("CC-BY-4.0", ("cc-by-4.0-ref",)),
    ("CC0-1.0", ("cc0-1.0-ref",)),
    ("MPL-2.0", ("mpl-2.0-ref",)),
    ("EPL-2.0", ("epl-2.0-ref",)),
    ("BSL-1.0", ("bsl-1.0-ref",)),
    ("BSD-3-Clause", ("bsd-3-ref",)),
    ("BSD-2-Clause", ("bsd-2-ref",)),
    ("ISC", ("isc-ref",)),
    ("WTFPL", ("wtfpl-do",)),
    ("Unlicense", ("unlicense-ref",)),
)
#: Licence names that a tag line may carry.
TAGS = (
    "0BSD", "AGPL-3.0-only", "AGPL-3.0-or-later", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "BSL-1.0", "CC-BY-4.0", "CC-BY-NC-4.0", "CC-BY-NC-SA-4.0", "CC-BY-ND-4.0", "CC-BY-SA-4.0",
    "CC0-1.0", "EPL-2.0", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0-only", "GPL-3.0-or-later", "ISC", "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0-only", "LGPL-3.0-or-later", "MIT", "MPL-2.0", "Unlicense", "WTFPL", "Zlib",
)
#: Choices between two licences that tag lines often carry.
TAG_CHOICES = ("Apache-2.0 OR MIT", "MIT OR Apache-2.0", "GPL-2.0-only OR MIT", "MIT OR GPL-2.0-only", "GPL-2.0-only OR BSD-2-Clause", "GPL-2.0-only OR BSD-3-Clause", "BSD-3-Clause OR MIT", "BSD-3-Clause AND MIT", "Apache-2.0 AND MIT")
#: Older names of tag lines.
OLD_TAGS = {"AGPL-3.0-only": "AGPL-3.0", "GPL-2.0-only": "GPL-2.0", "GPL-3.0-only": "GPL-3.0", "LGPL-2.1-only": "LGPL-2.1", "LGPL-3.0-only": "LGPL-3.0"}
#: What notices call a licence.
CALLED = {
    "mit-ref": ("MIT License", "MIT license (MIT)", "MIT"), "apache-2.0-ref": ("Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0 License", "Apache-2.0 License"),
    "gpl-3.0-ref": ("GNU General Public License v3.0", "GNU General Public License, version 3", "GNU GPL v3", "GPLv3", "GPL-3.0 License"),
    "gpl-2.0-ref": ("GNU General Public License v2.0", "GNU General Public License, version 2", "GNU GPL v2", "GPLv2", "GPL-2.0 License"),
    "lgpl-3.0-ref": ("GNU Lesser General Public License v3.0", "GNU Lesser General Public License, version 3", "GNU LGPL v3", "LGPLv3", "LGPL-3.0 License"),
    "agpl-3.0-ref": ("GNU Affero General Public License v3.0", "GNU Affero General Public License, version 3", "GNU AGPL v3", "AGPLv3", "AGPL-3.0 License"),
    "cc-by-4.0-ref": ("CC BY 4.0", "CC BY 4.0 License", "Creative Commons Attribution 4.0 International License"),
    "cc-by-sa-4.0-ref": ("CC BY-SA 4.0", "CC BY-SA 4.0 License", "Creative Commons Attribution-ShareAlike 4.0 International License"),
    "cc-by-nc-4.0-ref": ("CC BY-NC 4.0", "CC BY-NC 4.0 License", "Creative Commons Attribution-NonCommercial 4.0 International License"),
    "cc-by-nd-4.0-ref": ("CC BY-ND 4.0", "CC BY-ND 4.0 License", "Creative Commons Attribution-NoDerivatives 4.0 International License"),
    "cc-by-nc-sa-4.0-ref": ("CC BY-NC-SA 4.0", "CC BY-NC-SA 4.0 License", "Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License"),
    "cc0-1.0-ref": ("CC0 1.0", "CC0 1.0 Universal", "CC0 1.0 Universal License"), "mpl-2.0-ref": ("Mozilla Public License 2.0", "Mozilla Public License, version 2.0", "MPL 2.0", "MPL-2.0 License"),
    "epl-2.0-ref": ("Eclipse Public License 2.0", "Eclipse Public License, version 2.0", "EPL 2.0", "EPL-2.0 License"), "bsl-1.0-ref": ("Boost Software License, Version 1.0", "Boost Software License 1.0", "BSL-1.0 License"),
    "bsd-3-ref": ("BSD 3-Clause License", "3-Clause BSD License", "New BSD License", "BSD-3-Clause License"), "bsd-2-ref": ("BSD 2-Clause License", "2-Clause BSD License", "Simplified BSD License", "BSD-2-Clause License"),
    "isc-ref": ("ISC License",), "zlib-ref": ("zlib License",), "wtfpl-ref": ("WTFPL",), "unlicense-ref": ("Unlicense",),
}
#: The sentences that say it; every subject, verb and name go together.
SUBJECTS = ("", "This project is ", "This software is ", "This program is ", "This library is ", "This package is ", "This code is ", "This file is ", "This work is ", "The code is ", "The source code is ")
SAID = ("Licensed under the {}.", "Released under the {}.", "Distributed under the {}.", "Licensed under the terms of the {}.", "Released under the terms of the {}.", "Distributed under the terms of the {}.", "Made available under the terms of the {}.", "Available under the {}.", "Licensed under {}.", "Released under {}.")
#: Headings of licence texts, their first line and their second.
TITLES = {
    "GPL-3.0-only": ("GNU GENERAL PUBLIC LICENSE", "Version 3, 29 June 2007"), "GPL-2.0-only": ("GNU GENERAL PUBLIC LICENSE", "Version 2, June 1991"),
    "LGPL-3.0-only": ("GNU LESSER GENERAL PUBLIC LICENSE", "Version 3, 29 June 2007"), "LGPL-2.1-only": ("GNU LESSER GENERAL PUBLIC LICENSE", "Version 2.1, February 1999"),
    "AGPL-3.0-only": ("GNU AFFERO GENERAL PUBLIC LICENSE", "Version 3, 19 November 2007"), "Apache-2.0": ("Apache License", "Version 2.0, January 2004"),
}
for _name, _called in CALLED.items():
    SENTENCES[_name] = tuple(dict.fromkeys((*SENTENCES.get(_name, ()), *(who + (said[:1].lower() + said[1:] if who else said).format(c) for who in SUBJECTS for said in SAID for c in _called))))
for _line in dict.fromkeys(line for pair in TITLES.values() for line in pair):
    SENTENCES["title-" + re.sub("[^a-z0-9]+", "-", _line.lower())] = (_line,)
RULES += tuple((name, tuple("title-" + re.sub("[^a-z0-9]+", "-", line.lower()) for line in pair)) for name, pair in TITLES.items())
RULES += (("Zlib", ("zlib-ref",)), ("WTFPL", ("wtfpl-ref",)))
SENTENCES |= {f"tag-{x.replace(' ', '-')}": (f"SPDX-License-Identifier: {x}", f"SPDX-License-Identifier: ({x})") for x in TAG_CHOICES}
RULES += tuple((x, (f"tag-{x.replace(' ', '-')}",)) for x in TAG_CHOICES)
SENTENCES |= {f"tag-{name}": (f"SPDX-License-Identifier: {name}", *(f"SPDX-License-Identifier: {old}" for old in (OLD_TAGS.get(name),) if old)) for name in TAGS}
RULES += tuple((name, (f"tag-{name}",)) for name in TAGS)

_TAG = "spdx-license-identifier:"
#: Every byte but a-z, 0-9 and the line break becomes a space.
_PLAIN = bytes(b if chr(b) in "abcdefghijklmnopqrstuvwxyz0123456789\n" else 32 for b in range(256))


def marked(text: str) -> bytes:
    """A text in lower case with a line break behind every sentence end, and spaces for all but a-z and 0-9."""
    raw = text.lower().encode("utf-8", "surrogatepass").replace(_TAG.encode(), _TAG[:-1].encode() + b" ")
    for space in b" \t\r\f\v":
        if space in raw:
            for end in b".!?;:":
                raw = raw.replace(bytes((end, space)), bytes((end, 10)))
    return raw.translate(_PLAIN)


def cut(raw: bytes) -> list[str]:
    """The normalised sentences of a marked text, in order; empty ones (marks alone) are left out."""
    return [s.decode() for line in raw.split(b"\n") if (s := b" ".join(line.split()))]


def _unwrapped(text: str) -> bytes:
    """The other reading: line breaks as spaces, but for lines without letters or digits. Lines are joined
    before sentences are marked, so that a mark at a line's end counts as one before white space."""
    lines = text.split("\n")
    empty = [not re.search(r"[A-Za-z0-9]", line) for line in lines]
    out = []
    for i, line in enumerate(lines):
        out.append(line)
        if i + 1 < len(lines):
            out.append("\n" if empty[i + 1] or empty[i] else " ")
    return marked("".join(out))


class Rulebook:
    """Known sentences by identifier, and the rules as sequences of identifiers.

    A known sentence that the marks cut into several has an identifier for each of them.
    """

    def __init__(self, sentences: dict[str, tuple[str, ...]] = SENTENCES, rules: tuple = RULES):
        self.known: dict[str, str] = {}
        forms: dict[str, list[tuple[str, ...]]] = {}
        for name, texts in sentences.items():
            for text in texts:
                parts = cut(marked(text))
                for i, part in enumerate(parts):
                    self.known.setdefault(part, name if len(parts) == 1 else f"{name}.{i + 1}")
                forms.setdefault(name, []).append(tuple(self.known[p] for p in parts))
        self.rules: list[tuple[str, tuple[str, ...]]] = []
        for licence, names in rules:
            for choice in itertools.product(*(dict.fromkeys(forms[n]) for n in names)):
                rule = (licence, tuple(itertools.chain(*choice)))
                if rule not in self.rules:
                    self.rules.append(rule)
        for (_, a), (_, b) in itertools.combinations(self.rules, 2):
            if len(a) < len(b) and any(b[i : i + len(a)] == a for i in range(len(b) - len(a) + 1)):
                raise ValueError(f"the rule {b} comes after a part of it, {a}, and can never fit")
        self.names = list(dict.fromkeys(licence for licence, _ in self.rules))

    def sequence(self, text: str) -> list[str]:
        """The identifiers of a text by place, of both readings."""
        found: set[tuple[int, str]] = set()
        readings = [marked(text), _unwrapped(text)] if "\n" in text else [marked(text)]
        for sentences in map(cut, readings):
            if not self.known.keys().isdisjoint(sentences):
                place = 0
                for sentence in sentences:
                    if sentence in self.known:
                        found.add((place, self.known[sentence]))
                    place += sentence.count(" ") + 1
        return [name for _, name in sorted(found)]

    def licences(self, sequence: Iterable[str]) -> list[str]:
        """Names of the rules that fit, in the order of the rules."""
        left, found = "".join(f"<{name}>" for name in sequence), set()
        for licence, rule in self.rules:
            want = "".join(f"<{name}>" for name in rule)
            if want in left:
                found.add(licence)
                left = left.replace(want, "|")
        return [name for name in self.names if name in found]


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sentences: dict[str, tuple[str, ...]] = SENTENCES, rules: tuple = RULES) -> DataFrame:
    """One row per input row: doc_id, sentence_ids (by place, comma-joined), licenses (comma-joined, in the
    order of the rules), n_licenses."""
    book = Rulebook(sentences, rules)

    def fn(batch: pa.RecordBatch):
        sequences = [book.sequence(t) if t else [] for t in batch.column(1).to_pylist()]
        names = [book.licences(s) if s else [] for s in sequences]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array([",".join(s) for s in sequences], pa.string()), pa.array([",".join(n) for n in names], pa.string()), pa.array(list(map(len, names)), pa.int64())],
            ["doc_id", "sentence_ids", "licenses", "n_licenses"],
        )

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return map_rows(rows, "doc_id long, sentence_ids string, licenses string, n_licenses long", fn)


def oracle_sql(sentences: dict[str, tuple[str, ...]] = SENTENCES, rules: tuple = RULES) -> str:
    """The same in SQL: sentences unnested with a running sum of words, rules as replacements one after the other."""
    book = Rulebook(sentences, rules)
    q = lambda s: "'" + s.replace("'", "''") + "'"
    unwrapped = "translate(regexp_replace(text, '\\n(?:[^A-Za-z0-9\\n]*\\n)+', chr(1), 'g'), chr(10) || chr(1), ' ' || chr(10))"
    known = ", ".join(f"({q(k)}, {q(v)})" for k, v in book.known.items())
    read = lambda c: f"""select rid, s, coalesce(sum(len(string_split(s, ' '))) over (partition by rid order by i rows between unbounded preceding and 1 preceding), 0) as place from
      (select rid, i, trim(regexp_replace(lower(x), '[^a-z0-9]+', ' ', 'g')) as s from
        (select rid, unnest(l) as x, generate_subscripts(l, 1) as i from (select rid, string_split(regexp_replace(replace(lower({c}), '{_TAG}', '{_TAG[:-1]} '), '([.!?;:])[ \\t\\r\\f\\x0B]+', '\\1' || chr(10), 'g'), chr(10)) as l from d)))
      where s <> ''"""  # noqa: E731
    steps, at = [], "seq"
    wants = ["".join(f"<{name}>" for name in rule) for _, rule in book.rules]
    for i, want in enumerate(wants):
        steps.append(f"replace({at}, {q(want)}, '|') as s{i}")
        at = f"s{i}"
    hits = {name: " or ".join(f"contains({'seq' if i == 0 else f's{i - 1}'}, {q(wants[i])})" for i, (licence, _) in enumerate(book.rules) if licence == name) for name in book.names}
    names = ", ".join(f"case when {test} then {q(name)} end" for name, test in hits.items())
    return f"""
with d as (select row_number() over () as rid, doc_id, coalesce(text, '') as text from documents),
known(k, name) as (values {known}),
p as (select distinct rid, place, name from (({read("text")}) union all ({read(unwrapped)})) x join known on x.s = known.k),
a as (select rid, string_agg(name, ',' order by place, name) as ids, string_agg('<' || name || '>', '' order by place, name) as seq from p group by rid),
s as (select rid, ids, seq, {", ".join(steps)} from a),
l as (select rid, ids, list_filter([{names}], lambda x: x is not null) as names from s)
select doc_id, coalesce(ids, '') as sentence_ids, coalesce(array_to_string(names, ','), '') as licenses, coalesce(len(names), 0) as n_licenses
from d left join l using (rid)"""
