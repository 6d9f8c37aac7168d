"""Licence recognition by sentence rules: normalised sentences become identifiers, sequences of identifiers become licences.

A text is cut at line ends, blank lines and sentence ends; comment marks, case and punctuation fall away. Every sentence
that a rule of ``SENTENCES`` matches as a whole becomes its identifier, with the version it names. ``LICENCES`` lists, per licence, the
identifiers that must follow each other; any others may stand between them, but not the first identifier of the same
sequence, which begins the next notice. A warranty sentence (``WARRANTIES``), which several licences share, belongs to the notice that began
last before it. Rules are tried in their order from each identifier on; the first that fits takes the identifiers it used. Licence
sentences that no rule takes are each reported as ``unknown``; so is a copyright line, unless only copyright lines stand between
it and the beginning of a licence or it stands inside the span of one, and is part of that notice. Sentences wrapped over lines are also read joined, up to a blank line.

Defined cases: null or empty text has no licence; a licence stated several times is listed once for the document but every finding has its
span; rows that repeat are each reported; null ids are kept; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import bisect
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quayside.llm.words import pieces

# Normalised licence sentences. ``V`` stands for a version, ``...`` for any words.
SENTENCES = (
    ("spdx", r"spdx license identifier (?P<v>[a-z0-9. +()]+)"),
    ("mit-ref", r"(?:this (?:software|work|project|file|code|package|program) is )?(?:released|licensed|distributed|available) under (?:the )?(?:terms of the )?(?:mit|expat) licen[sc]e"),
    ("mit-title", r"(?:the )?mit licen[sc]e(?: mit)?"),
    ("mit-grant", r"permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files .* to permit persons to whom the software is furnished to do so subject to the following conditions"),
    ("mit-notice", r"the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("as-is", r"(?:the|this) software is provided (?:as is|by the .* as is).*"),
    ("apache-ref", r"(?:this (?:software|work|project|file|code) is )?(?:licensed|released|distributed) under the apache licen[sc]e(?: version)? (?P<v>[0-9.]+)(?: the license)?"),
    ("apache-use", r"you may not use this file except in compliance with the license"),
    ("apache-copy", r"you may obtain a copy of the license at.*"),
    ("apache-warranty", r"unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis.*"),
    ("gpl-ref", r"(?:this (?:work|software|program|project|file|code) is )?(?:licensed|released|distributed) under (?:the )?(?:terms of the )?(?:gnu (?:general public licen[sc]e|gpl)|gpl)(?: as published by the free software foundation)?(?: either)?(?: version)? (?P<v>[0-9.]+)(?P<later> .*or.* any later version)?"),
    ("gpl-free", r"this program is free software you can redistribute it and or modify it under the terms of the gnu general public licen[sc]e as published by the free software foundation either version (?P<v>[0-9.]+) of the license or at your option any later version"),
    ("gpl-hope", r"this program is distributed in the hope that it will be useful but without any warranty.*"),
    ("lgpl-ref", r"(?:this .* is )?(?:licensed|released|distributed) under (?:the )?(?:terms of the )?(?:gnu lesser general public licen[sc]e|lgpl)(?: version)? (?P<v>[0-9.]+).*"),
    ("agpl-ref", r"(?:this .* is )?(?:licensed|released|distributed) under (?:the )?(?:terms of the )?(?:gnu affero general public licen[sc]e|agpl)(?: version)? (?P<v>[0-9.]+).*"),
    ("bsd-grant", r"redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("bsd-source", r"(?:[0-9] )?redistributions of source code must retain the above copyright notice.*"),
    ("bsd-binary", r"(?:[0-9] )?redistributions in binary form must reproduce the above copyright notice.*"),
    ("bsd-endorse", r"(?:[0-9] )?neither the name of .* may be used to endorse or promote products.*"),
    ("bsd-ref", r"(?:this .* is )?(?:licensed|released|distributed) under the (?:(?P<v>[23]) clause )?bsd licen[sc]e"),
    ("mpl-ref", r"(?:this .* is )?(?:subject to|licensed under) the (?:terms of the )?mozilla public licen[sc]e(?: v\.?| version)? ?(?P<v>[0-9.]+).*"),
    ("cc-ref", r"(?:this .* is )?(?:licensed|released|distributed) under (?:a |the )?(?:cc|creative commons) (?P<v>by(?: nc| sa| nd)* [0-9.]+|0(?: [0-9.]+)?)(?: .*licen[sc]e.*)?"),
    ("isc-grant", r"permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("unlicense", r"this is free and unencumbered software released into the public domain"),
    ("copyright", r"(?:\(c\) |c )?copyright (?:\(c\) |c )?[0-9]{4}.*"),
    ("other-licence", r"(?:this .* is )?(?:licensed|released|distributed) under .*licen[sc]e.*"),
)
# Licences as ordered sequences of identifiers; ``{v}`` is the version found in the first of them.
LICENCES = (
    ("{v}", ("spdx",)),
    ("MIT", ("mit-grant", "mit-notice", "as-is")),
    ("MIT", ("mit-grant", "mit-notice")),
    ("MIT", ("mit-ref",)),
    ("MIT", ("mit-title",)),
    ("Apache-{v}", ("apache-ref", "apache-use", "apache-copy", "apache-warranty")),
    ("Apache-{v}", ("apache-ref",)),
    ("GPL-{v}-or-later", ("gpl-free", "gpl-hope")),
    ("GPL-{v}-or-later", ("gpl-free",)),
    ("GPL-{v}", ("gpl-ref",)),
    ("LGPL-{v}", ("lgpl-ref",)),
    ("AGPL-{v}", ("agpl-ref",)),
    ("BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse", "as-is")),
    ("BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse")),
    ("BSD-2-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "as-is")),
    ("BSD-2-Clause", ("bsd-grant", "bsd-source", "bsd-binary")),
    ("BSD-{v}-Clause", ("bsd-ref",)),
    ("MPL-{v}", ("mpl-ref",)),
    ("CC-{v}", ("cc-ref",)),
    ("ISC", ("isc-grant", "as-is")),
    ("ISC", ("isc-grant",)),
    ("Unlicense", ("unlicense", "as-is")),
    ("Unlicense", ("unlicense",)),
    ("unknown", ("other-licence",)),
)
# warranty sentences that several licences share, and the beginnings of the notices that may end in one
WARRANTIES = frozenset(["as-is"])
_NOTICES = frozenset(sequence[0] for _, sequence in LICENCES if WARRANTIES & {*sequence})
# a sentence without any of these words is no licence sentence
HINTS = ("licens", "licenc", "copyright", "permission", "redistribut", "warrant", "as is", "public domain", "spdx", "gpl")


def hinted(text: str) -> bool:
    low = text.lower()
    return any(x in low for x in HINTS)


_RULES = [(name, re.compile(pattern)) for name, pattern in SENTENCES]
# up to a line end or a mark with white space behind it; a dot inside a number or name does not end a sentence
_SENTENCE = re.compile(r"[^\n]*?(?:[.!?;](?=\s)|:(?=[ \t]*(?:[\n\x0b]|\Z))|\n|\Z)")
_PARAGRAPH = re.compile(r"\n[ \t]*(?:\n[ \t]*)+")
_LEADER = re.compile(r"^[ \t]*(?:/\*+|\*+/?|//+|#+|--+|;+|%+|\"+|<!--)[ \t]?", re.M)


def normalise(sentence: str) -> str:
    """Lower case, words and numbers only, one space between them."""
    return " ".join(re.findall(r"[a-z0-9]+(?:\.[0-9a-z]+)*|\(c\)", sentence.lower().replace("©", "(c)")))


def identify(sentence: str) -> tuple[str, str] | None:
    """(identifier, version) of a licence sentence."""
    if not hinted(sentence):
        return None
    plain = normalise(sentence)
    for name, rule in _RULES:
        if m := rule.fullmatch(plain):
            found = m.groupdict()
            if name == "spdx":  # the expression as it stands
                return name, re.sub(r"[\s*/>-]+$", "", sentence.partition(":")[2]).strip()
            return name, (found.get("v") or "").strip(".") + ("-or-later" if found.get("later") else "")
    return None


def sentences(text: str) -> list[tuple[int, int, str, str]]:
    """(start, end, identifier, version) of the licence sentences in order, as lines and as sentences wrapped over lines."""
    if not hinted(text):
        return []
    found: dict[str, list[tuple[int, int, str, str]]] = {}  # by identifier, in order and without overlaps
    text = _LEADER.sub(lambda m: " " * len(m[0]), text)  # the same length, so places stay
    edges = [0, *(m.end() for m in _PARAGRAPH.finditer(text)), len(text)]
    for low, high in zip(edges, edges[1:]):
        own = text[low:high]
        if not hinted(own):
            continue
        for form in (own, own.replace("\n", "\x0b")):
            at = 0
            while at < len(form):
                m = _SENTENCE.match(form, at)
                end = max(m.end(), at + 1)
                if hit := identify(form[at:end]):
                    start = low + at + len(form[at:end]) - len(form[at:end].lstrip())
                    stop = low + at + len(form[at:end].rstrip())
                    own_kind = found.setdefault(hit[0], [])
                    i = bisect.bisect_left(own_kind, (start,))
                    if not (i and own_kind[i - 1][1] > start) and not (i < len(own_kind) and own_kind[i][0] < stop):
                        own_kind.insert(i, (start, stop, *hit))
                at = end
    return sorted(x for kind in found.values() for x in kind)


def _sequence(seen: list[tuple[int, int, str, str]], used: set[int], first: int, sequence: tuple[str, ...]) -> list[int] | None:
    """Places of the identifiers of a sequence from ``first`` on, each the next free one."""
    took, want = [first], 1
    for j in range(first + 1, len(seen)):
        if want == len(sequence):
            break
        name = seen[j][2]
        if name == sequence[0] or (sequence[want] in WARRANTIES and name in _NOTICES):
            return None
        if name == sequence[want] and j not in used:
            took.append(j)
            want += 1
    return took if want == len(sequence) else None


def licences(text: str | None) -> list[tuple[int, int, str]]:
    """(start, end, licence) of every finding in a text."""
    seen, out, used = sentences(text or ""), [], set()
    begins = {}
    for i, (start, _, name, version) in enumerate(seen):
        if i in used:
            continue
        for licence, sequence in LICENCES:
            if sequence[0] == name and (took := _sequence(seen, used, i, sequence)):
                used.update(took)
                label = licence.replace("{v}", version.replace(" ", "-").upper() if name == "cc-ref" else version).replace("BSD--Clause", "BSD")
                out.append((start, max(seen[j][1] for j in took), label))
                begins[i] = took[-1]
                break
    # copyright lines right before a licence or inside it are part of it
    inside, lead = -1, []
    for i, (start, end, name, _) in enumerate(seen):
        if i in begins:
            inside = max(inside, begins[i])
            used.update(lead)
        if name == "copyright":
            lead.append(i)
            if i < inside:
                used.add(i)
        else:
            lead = []
    out += [(start, end, "unknown") for i, (start, end, _, _) in enumerate(seen) if i not in used]
    return sorted(out)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, findings): per row an array of (start, end, licence), positions in code points."""
    kind = docs.schema[id_col].dataType.simpleString()
    shape = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("licence", pa.string())]))

    def run(batches):
        for batch, texts in pieces(batches, "text"):
            found = [[dict(zip(("start", "end", "licence"), x)) for x in licences(t)] for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(found, shape)], ["key", "findings"])

    plain = docs.select(F.col(id_col).alias("key"), F.col(text_col).alias("text"))
    return plain.mapInArrow(run, f"key {kind}, findings array<struct<start:bigint,end:bigint,licence:string>>").withColumnRenamed("key", id_col)
