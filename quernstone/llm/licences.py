"""Licence recognition by sentence identifiers and ordered rules.

A text is cut into sentences, each sentence is normalised (case, white space and punctuation
don't matter) and looked up in a table of known licence sentences. What is left of a
document is a short sequence of (position, sentence identifier). Rules are sequences of
identifiers; they are tried in their order at every place, longer notices before the
short phrases that they contain, and a matched place isn't matched again.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernstone.plans import map_arrow

#: Pieces end at a line feed, or at . ! ? ; before white space or the end of the text.
_PIECE = re.compile(r"[^\n.!?;]*(?:[.!?;](?!\s|\Z)[^\n.!?;]*)*(?:[.!?;]+|\n|\Z)")
_JUNK = re.compile(r"[^a-z0-9]+")

# Sentences of licence notices and texts, by identifier. Several wordings may share one.
SENTENCES = {
    "spdx-mit": ["SPDX-License-Identifier: MIT"],
    "spdx-apache-2": ["SPDX-License-Identifier: Apache-2.0"],
    "spdx-gpl-2": ["SPDX-License-Identifier: GPL-2.0-only", "SPDX-License-Identifier: GPL-2.0-or-later", "SPDX-License-Identifier: GPL-2.0"],
    "spdx-gpl-3": ["SPDX-License-Identifier: GPL-3.0-only", "SPDX-License-Identifier: GPL-3.0-or-later", "SPDX-License-Identifier: GPL-3.0"],
    "spdx-bsd-3": ["SPDX-License-Identifier: BSD-3-Clause"],
    "spdx-mpl-2": ["SPDX-License-Identifier: MPL-2.0"],
    "mit-name": ["Released under the MIT License", "Licensed under the MIT License", "This project is licensed under the MIT License", "The MIT License (MIT)", "The MIT License", "MIT License", "Distributed under the MIT License"],
    "mit-grant": ["Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions"],
    "mit-notice": ["The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software"],
    "as-is-software": ["THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT"],
    "apache-2-name": ["Licensed under the Apache License, Version 2.0", "Released under the Apache License, Version 2.0", "This project is licensed under the Apache License, Version 2.0", "Apache License, Version 2.0", "Licensed under the Apache License, Version 2.0 (the \"License\")"],
    "apache-2-may-not": ["you may not use this file except in compliance with the License"],
    "apache-2-copy": ["You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0", "You may obtain a copy of the License at"],
    "apache-2-as-is": ["Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied"],
    "gpl-3-name": ["This work is licensed under the GNU General Public License, version 3", "Licensed under the GNU General Public License, version 3", "Released under the GNU General Public License, version 3", "Licensed under the GPL, version 3", "Licensed under the GPLv3"],
    "gpl-2-name": ["This work is licensed under the GNU General Public License, version 2", "Licensed under the GNU General Public License, version 2", "Released under the GNU General Public License, version 2", "Licensed under the GPLv2"],
    "gpl-free": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"],
    "gpl-free-2": ["This program is free software", "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"],
    "gpl-2-later": ["either version 2 of the License, or (at your option) any later version"],
    "gpl-hope": ["This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY"],
    "lgpl-name": ["Licensed under the GNU Lesser General Public License", "This work is licensed under the GNU Lesser General Public License, version 3"],
    "agpl-3-name": ["Licensed under the GNU Affero General Public License, version 3", "This work is licensed under the GNU Affero General Public License, version 3"],
    "bsd-grant": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"],
    "bsd-source": ["Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer"],
    "bsd-binary": ["Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution"],
    "bsd-names": ["Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"],
    "bsd-3-name": ["Licensed under the BSD 3-Clause License", "Released under the BSD 3-Clause License", "BSD 3-Clause License"],
    "bsd-2-name": ["Licensed under the BSD 2-Clause License", "Released under the BSD 2-Clause License", "BSD 2-Clause License"],
    "mpl-2-name": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", "Licensed under the Mozilla Public License, version 2.0", "Licensed under the Mozilla Public License 2.0"],
    "cc-by-4": ["Licensed under CC BY 4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"],
    "cc-by-sa-4": ["Licensed under CC BY-SA 4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"],
    "cc-by-nc-4": ["Licensed under CC BY-NC 4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"],
    "cc-by-nd-4": ["Licensed under CC BY-ND 4.0", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License"],
    "cc0-1": ["Licensed under CC0 1.0", "Released under CC0 1.0", "This work is dedicated to the public domain"],
    "unlicense": ["This is free and unencumbered software released into the public domain"],
    "reserved": ["All rights reserved"],
}


@dataclass(frozen=True)
class LicenceRule:
    """``sentences`` in this order, with at most ``gap`` other sentences between two of them."""

    licence: str
    sentences: tuple[str, ...]
    gap: int = 2


# The rules in the order in which they are tried, whole notices first.
RULES = (
    LicenceRule("MIT", ("mit-name", "mit-grant", "mit-notice", "as-is-software"), 3),
    LicenceRule("MIT", ("mit-grant", "mit-notice", "as-is-software")),
    LicenceRule("MIT", ("mit-grant", "as-is-software")),
    LicenceRule("BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-names"), 4),
    LicenceRule("BSD-2-Clause", ("bsd-grant", "bsd-source", "bsd-binary"), 4),
    LicenceRule("Apache-2.0", ("apache-2-name", "apache-2-may-not", "apache-2-copy", "apache-2-as-is"), 3),
    LicenceRule("Apache-2.0", ("apache-2-name", "apache-2-may-not")),
    LicenceRule("GPL-3.0-or-later", ("gpl-free", "gpl-hope")),
    LicenceRule("GPL-2.0-or-later", ("gpl-free-2", "gpl-free-2", "gpl-2-later", "gpl-hope")),
    LicenceRule("GPL-2.0-or-later", ("gpl-free-2", "gpl-2-later")),
    LicenceRule("GPL-3.0-or-later", ("gpl-free",)),
    LicenceRule("MIT", ("spdx-mit",)),
    LicenceRule("Apache-2.0", ("spdx-apache-2",)),
    LicenceRule("GPL-2.0", ("spdx-gpl-2",)),
    LicenceRule("GPL-3.0", ("spdx-gpl-3",)),
    LicenceRule("BSD-3-Clause", ("spdx-bsd-3",)),
    LicenceRule("MPL-2.0", ("spdx-mpl-2",)),
    LicenceRule("MIT", ("mit-name",)),
    LicenceRule("MIT", ("mit-grant",)),
    LicenceRule("Apache-2.0", ("apache-2-name",)),
    LicenceRule("AGPL-3.0", ("agpl-3-name",)),
    LicenceRule("LGPL-3.0", ("lgpl-name",)),
    LicenceRule("GPL-3.0", ("gpl-3-name",)),
    LicenceRule("GPL-2.0", ("gpl-2-name",)),
    LicenceRule("BSD-3-Clause", ("bsd-3-name",)),
    LicenceRule("BSD-2-Clause", ("bsd-2-name",)),
    LicenceRule("MPL-2.0", ("mpl-2-name",)),
    LicenceRule("CC-BY-NC-4.0", ("cc-by-nc-4",)),
    LicenceRule("CC-BY-SA-4.0", ("cc-by-sa-4",)),
    LicenceRule("CC-BY-ND-4.0", ("cc-by-nd-4",)),
    LicenceRule("CC-BY-4.0", ("cc-by-4",)),
    LicenceRule("CC0-1.0", ("cc0-1",)),
    LicenceRule("Unlicense", ("unlicense",)),
)


def normal(sentence: str) -> str:
    """Lower-cased letters and digits of a sentence, everything else as single spaces."""
    return _JUNK.sub(" ", sentence.lower()).strip()


def _tail(key: str) -> str:
    return " ".join(key.rsplit(" ", 2)[-2:])


class Recogniser:
    """Looks sentences up by their last two words, then whole.

    A sentence may be wrapped over lines, and some known wordings hold more than one sentence
    mark, so a known sentence has to equal some run of whole pieces that ends here.
    """

    def __init__(self, sentences: dict[str, list[str]] = SENTENCES, rules: tuple[LicenceRule, ...] = RULES):
        self.tails: dict[str, list[tuple[str, str]]] = {}
        for name, wordings in sentences.items():
            for key in sorted({normal(w) for w in wordings}, key=len, reverse=True):
                self.tails.setdefault(_tail(key), []).append((key, name))
        for known in self.tails.values():
            known.sort(key=lambda x: -len(x[0]))
        self.longest = max(len(k) for known in self.tails.values() for k, _ in known)
        self.rules = rules

    def sentences(self, text: str) -> list[tuple[int, int, int, int, str]]:
        """(first piece, last piece, start, end, identifier) of each known sentence, in text order."""
        found = []
        recent: list[tuple[str, int]] = []  # pieces so far: key and start
        for m in _PIECE.finditer(text):
            said = m[0]
            if not said or said.isspace():
                continue
            key = normal(said)
            if not key:
                continue
            recent.append((key, m.start() + len(said) - len(said.lstrip())))
            for full, name in self.tails.get(_tail(key), ()):
                k, size = len(recent) - 1, len(key)
                while size < len(full) and k:
                    k -= 1
                    size += 1 + len(recent[k][0])
                if size == len(full) and " ".join(r[0] for r in recent[k:]) == full:
                    while found and found[-1][0] >= k:
                        found.pop()  # a part of this sentence
                    found.append((k, len(recent) - 1, recent[k][1], m.start() + len(said.rstrip()), name))
                    break
        return found

    def licences(self, known: list[tuple[int, int, int, int, str]]) -> list[tuple[str, int, int]]:
        """(licence, start, end) in code points, in text order; a sentence is used once."""
        used = [False] * len(known)
        out = []
        for rule in self.rules:
            for k in range(len(known)):
                hit = self._match(rule, known, used, k)
                if hit:
                    for j in hit:
                        used[j] = True
                    out.append((rule.licence, known[hit[0]][2], known[hit[-1]][3]))
        return sorted(out, key=lambda x: (x[1], x[2], x[0]))

    def _match(self, rule: LicenceRule, known: list, used: list[bool], k: int) -> list[int]:
        """Places of the rule's sentences from ``k`` on, none if it doesn't match there."""
        if used[k] or known[k][4] != rule.sentences[0]:
            return []
        hit = [k]
        for name in rule.sentences[1:]:
            j = hit[-1] + 1
            while j < len(known) and known[j][0] - known[hit[-1]][1] <= rule.gap + 1 and (used[j] or known[j][4] != name):
                j += 1
            if j == len(known) or known[j][0] - known[hit[-1]][1] > rule.gap + 1:
                return []
            hit.append(j)
        return hit


def scan_licences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_sentences, licences, spans) for each input row.

    ``n_sentences`` counts known licence sentences, ``licences`` are the distinct licences in
    order of the alphabet, joined by commas, ``spans`` the matches as licence:start:end (code
    points, end exclusive) in text order. Null texts count as empty and have none. Repeated
    rows are scanned as often as they occur; an empty table gives an empty result; other
    columns are ignored.
    """
    src = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        recogniser = Recogniser()
        for batch in batches:
            for k in range(0, batch.num_rows, 512):
                part = batch.slice(k, 512)
                counts, names, spans = [], [], []
                for text in part.column(1).to_pylist():
                    known = recogniser.sentences(text)
                    found = recogniser.licences(known) if known else []
                    counts.append(len(known))
                    names.append(",".join(sorted({x[0] for x in found})))
                    spans.append(",".join(f"{n}:{s}:{e}" for n, s, e in found))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(counts, pa.int64()), pa.array(names, pa.string()), pa.array(spans, pa.string())], names=["id", "n_sentences", "licences", "spans"])

    return map_arrow(src, run, f"id {src.schema['id'].dataType.simpleString()}, n_sentences bigint, licences string, spans string").withColumnRenamed("id", id_col)
