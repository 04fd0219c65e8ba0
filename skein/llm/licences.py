"""Licence scan by sentence rules.

A text is cut into sentences; a normalised sentence that is a known licence sentence becomes its identifier:
by its hash, for the sentences of whole licence texts (licence_sentences), or by a pattern, for those that
bear a holder, a version or a name. The sequence of identifiers is then matched against licence rules in order
of their length, each match using up its sentences. What no rule takes is reported as unmatched evidence.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

from skein.llm.licence_sentences import IDS, TEXTS
from skein.llm.worker import lean, small_batches

#: Parts of single words (a phrase may be wrapped) without one of which no known sentence can match: a cheap look before sentences are cut.
HINTS = ("licens", "licenc", "copyright", "spdx", "permission", "redistribut", "warrant", "reserved", "domain", "commons", "cc0", "(c)", "©", "liable", "endorse", "advertising", "regents", "author")
VERSION = r"(?:v(?:ersion)?\.? ?)?"

#: (identifier, pattern of the whole normalised sentence or of a part of it). Groups named v give the identifier a version.
SENTENCES = [
    ("SPDX", r"spdx-license-identifier ?: ?(?P<v>[a-z0-9.+-]+(?: (?:or|and|with) [a-z0-9.+-]+)*)"),
    ("ApacheRef", rf"\blicensed under (?:the )?(?:terms of )?(?:the )?apache(?: software)? licen[cs]e,? ?{VERSION}(?P<v>[0-9.]*[0-9])?"),
    ("ApacheNotUse", r"you may not use this file except in compliance with the license"),
    ("ApacheCopy", r"you may obtain a copy of the license at"),
    ("ApacheAsIs", r"unless required by applicable law or agreed to in writing,? software distributed under the license is distributed on an as is basis"),
    ("ApacheLimits", r"see the license for the specific language governing permissions and limitations under the license"),
    ("MITRef", r"\b(?:released|licensed|distributed|available|provided|published)(?: \w+)? under (?:the )?(?:terms of )?(?:the )?mit(?:/x11)? licen[cs]e"),
    ("MITPerm", r"permission is hereby granted,? free of charge,? to any person obtaining a copy of this software"),
    ("MITNotice", r"the above copyright notice and this permission notice shall be included in all copies"),
    ("AsIsUpper", r"the software is provided as is,? without warranty of any kind"),
    ("NoLiability", r"in no event shall the (?:authors|copyright)(?: or copyright holders| holders?)?[^.]* be liable for any claim,? damages"),
    ("ISCPerm", r"permission to use,? copy,? modify,? and(?:[ /]or)? distribute this software for any purpose with or without fee is hereby granted"),
    ("BSDRef", r"\blicensed under (?:the )?(?:terms of )?(?:the )?(?P<v>[234])?-?(?:clause)? ?bsd(?:[ -](?P<w>[234])-clause)?(?: licen[cs]e)?"),
    ("BSDPre", r"redistribution and use in source and binary forms,? with or without modification,? are permitted"),
    ("BSDSource", r"redistributions of source code must retain the above copyright notice"),
    ("BSDBinary", r"redistributions in binary form must reproduce the above copyright notice"),
    ("BSDEndorse", r"neither the names? of .{0,200}? may be used to endorse or promote products"),
    ("BSDAdvert", r"all advertising materials mentioning features or use of this software must display"),
    ("BSDAsIs", r"this software is provided by the (?:copyright holders|regents|authors?)[^.]* as is"),
    ("GPLRef", rf"\blicensed under (?:the )?(?:terms of )?(?:the )?(?:gnu )?(?:general public licen[cs]e|gpl),? ?{VERSION}(?P<v>[0-9.]*[0-9])?(?P<w> or (?:\(at your option\) )?(?:any )?later)?"),
    ("LGPLRef", rf"\blicensed under (?:the )?(?:terms of )?(?:the )?(?:gnu )?(?:(?:lesser|library) general public licen[cs]e|lgpl),? ?{VERSION}(?P<v>[0-9.]*[0-9])?"),
    ("AGPLRef", rf"\blicensed under (?:the )?(?:terms of )?(?:the )?(?:gnu )?(?:affero general public licen[cs]e|agpl),? ?{VERSION}(?P<v>[0-9.]*[0-9])?"),
    ("GPLFree", rf"you can redistribute it and(?:[ /]or)? modify it under the terms of the gnu (?P<w>lesser |library |affero )?general public license as published by the free software foundation[,;:]? either {VERSION}(?P<v>[0-9.]*[0-9])"),
    ("GPLHope", r"distributed in the hope that it will be useful,? but without any warranty"),
    ("GPLCopy", r"you should have received a copy of the gnu (?:lesser |library |affero )?general public license"),
    ("MPLRef", rf"subject to the terms of the mozilla public licen[cs]e,? ?{VERSION}(?P<v>[0-9.]*[0-9])|\blicensed under (?:the )?(?:mozilla public licen[cs]e|mpl),? ?{VERSION}(?P<w>[0-9.]*[0-9])?"),
    ("EPLRef", rf"\blicensed under (?:the )?(?:terms of )?(?:the )?eclipse public licen[cs]e,? ?{VERSION}(?P<v>[0-9.]*[0-9])?"),
    ("CCRef", r"\blicensed under (?:an? |the )?(?:terms of )?(?:the )?(?:creative commons |cc[ -])(?P<v>(?:by|attribution)(?:[ -](?:nc|noncommercial|non-commercial))?(?:[ -](?:sa|nd|sharealike|share-alike|noderivatives|noderivs))?)(?:[a-z -]*licen[cs]e,?)?(?: ?(?:v|version )?(?P<w>[0-9.]*[0-9]))?"),
    ("CC0Ref", r"\b(?:cc0|public domain dedication|creative commons zero)\b"),
    ("Unlicense", r"this is free and unencumbered software released into the public domain"),
    ("PublicDomain", r"\b(?:released|placed|dedicated)(?: \w+){0,2} (?:into|in|to) the public domain\b"),
    ("RightsReserved", r"\ball rights reserved\b"),
    # A licence's name in a sentence that says so; NAMES has the names.
    ("NameRef", rf"(?:(?<![a-z])(?P<n>mit(?:/x11)?|isc|zlib|boost software|postgresql|artistic|python software foundation|eclipse public|mozilla public|apache(?: software)?|gnu (?:affero |lesser |library )?general public|[0234][- ]clause bsd|bsd[- ][0234][- ]clause) licen[cs]e,? ?{VERSION}(?P<v>[0-9]+(?:\.[0-9]+)*)?)"),
    ("IdRef", r"\blicen[cs]e ?[:=] ?(?P<v>[a-z0-9.+-]*[a-z0-9+])"),
    ("Copyright", r"(?:\bcopyright\b|\(c\)|©) ?(?:\(c\)|©)? ?[0-9]{4}"),
]
KNOWN = [(name, re.compile(pattern)) for name, pattern in SENTENCES]

#: (licence, identifiers in order); a rule's sentences must follow each other, sentences between them being none of another licence. Longer rules first.
RULES = [
    ("Apache-{v}", ("ApacheRef", "ApacheNotUse", "ApacheCopy", "ApacheAsIs", "ApacheLimits")),
    ("BSD-4-Clause", ("BSDPre", "BSDSource", "BSDBinary", "BSDAdvert", "BSDEndorse", "BSDAsIs")),
    ("BSD-3-Clause", ("BSDPre", "BSDSource", "BSDBinary", "BSDEndorse", "BSDAsIs")),
    ("BSD-2-Clause", ("BSDPre", "BSDSource", "BSDBinary", "BSDAsIs")),
    ("MIT", ("MITPerm", "MITNotice", "AsIsUpper", "NoLiability")),
    ("{w}GPL-{v}", ("GPLFree", "GPLHope", "GPLCopy")),
    ("MIT", ("MITPerm", "MITNotice", "AsIsUpper")),
    ("ISC", ("ISCPerm", "AsIsUpper")),
    ("MIT", ("MITPerm",)),
    ("ISC", ("ISCPerm",)),
    ("{w}GPL-{v}", ("GPLFree",)),
    ("BSD", ("BSDPre",)),
    ("{v}", ("SPDX",)),
    ("Apache-{v}", ("ApacheRef",)),
    ("MIT", ("MITRef",)),
    ("BSD{v}", ("BSDRef",)),
    ("AGPL-{v}", ("AGPLRef",)),
    ("LGPL-{v}", ("LGPLRef",)),
    ("GPL-{v}", ("GPLRef",)),
    ("MPL-{v}", ("MPLRef",)),
    ("EPL-{v}", ("EPLRef",)),
    ("CC-{v}", ("CCRef",)),
    ("CC0-1.0", ("CC0Ref",)),
    ("Unlicense", ("Unlicense",)),
    ("{n}", ("NameRef",)),
    ("{v}", ("IdRef",)),
    ("LicenseRef-public-domain", ("PublicDomain",)),
    ("LicenseRef-all-rights-reserved", ("RightsReserved",)),
]
#: Words of a sentence that licenses something; without one a name is only mentioned.
LICENSING = re.compile(r"\b(?:(?:re)?licen[cs]ed|released|distributed|available|provided|published|covered|governed|uses?|under|terms|dual)\b|licen[cs]e ?[:=]")
NAMES = {"mit": "MIT", "mit/x11": "MIT", "isc": "ISC", "zlib": "Zlib", "boost software": "BSL-{v}", "postgresql": "PostgreSQL", "artistic": "Artistic-{v}", "python software foundation": "PSF-2.0", "eclipse public": "EPL-{v}", "mozilla public": "MPL-{v}", "apache": "Apache-{v}", "apache software": "Apache-{v}", "gnu general public": "GPL-{v}", "gnu affero general public": "AGPL-{v}", "gnu lesser general public": "LGPL-{v}", "gnu library general public": "LGPL-{v}"}
#: Share of a licence text's known sentences that must follow each other.
ENOUGH = 0.8
#: Identifiers that say nothing of the licence by themselves and may stand between the sentences of a rule.
NEUTRAL = frozenset(("Copyright", "RightsReserved"))
CC_PARTS = {"attribution": "BY", "noncommercial": "NC", "non-commercial": "NC", "sharealike": "SA", "share-alike": "SA", "noderivatives": "ND", "noderivs": "ND"}
SPACE = re.compile(r"[\s*#/\"'“”‘’`>|]+")
MARK = re.compile(r"^[ \t]*(?:\*|//|#|;|--)(?=[ \t]|$)", re.M)
CUT = re.compile(r"\n[ \t\r]*\n|\n(?=[ \t]*(?:[-*•]|\(?[0-9a-z][.)]) )|(?<=[.!?;:])\s+(?=\S)|\n(?=[A-Z©(])")


def sentences(text: str) -> Iterator[tuple[int, str]]:
    """(start, normalised sentence): lower case, white space and comment marks one space."""
    at = 0
    for cut in [*(m.span() for m in CUT.finditer(text)), (len(text), len(text))]:
        plain = SPACE.sub(" ", text[at : cut[0]]).strip().lower().replace(" ,", ",")
        if plain:
            yield at, plain
        at = cut[1]


def _uncomment(text: str) -> str:
    """A comment's marks at the starts of its lines as spaces, so that places stay; a text of other lines as it is."""
    if len(MARK.findall(text)) * 2 > text.count("\n") + 1:
        return MARK.sub(lambda m: " " * len(m[0]), text)
    return text


def _join(text: str) -> list[tuple[int, str]]:
    """Sentences, a cut before "version" or a colon's clause being undone for the known sentences that run over it."""
    out: list[tuple[int, list[str]]] = []
    text = _uncomment(text)
    for at, s in sentences(text):
        if out and (out[-1][1][-1].endswith((" v.", "version:", "identifier:", "inc.", "ltd.", ";", ":")) or (out[-1][1][-1][-1] not in ".!?;:" and not re.match(r"[A-Z©]", text[at : at + 1]))):
            out[-1][1].append(s)
        else:
            out.append((at, [s]))
    return [(at, " ".join(parts)) for at, parts in out]


def identity(sentence: str) -> int:
    """The number under which a normalised sentence is known."""
    return xxhash.xxh64_intdigest(sentence.rstrip(" .;:,"))


def identify(sentence: str) -> list[tuple[int, str, dict[str, str]]]:
    """(place, identifier, versions) of every occurrence of the known sentences in a normalised sentence, the first place first."""
    found, spans = [], []
    known = KNOWN_TEXTS.get(identity(sentence))
    if known:
        found.append((0, known, {}))
    licensing = LICENSING.search(sentence)
    for name, pattern in KNOWN:
        if name == "NameRef" and not licensing:
            continue
        for m in pattern.finditer(sentence):
            groups = {k: v for k, v in m.groupdict().items() if v}
            if name in ("NameRef", "IdRef") and any(a < m.end() and m.start() < b for a, b in spans):
                continue  # part of a sentence that tells more
            if name == "IdRef" and groups["v"] not in IDS:
                continue
            found.append((m.start(), name, groups))
            if name != "Copyright":
                spans.append(m.span())
    return sorted(found, key=lambda x: x[0])


#: Sentence identity -> identifier (licence and number) of the sentences of whole licence texts.
KNOWN_TEXTS = {h: f"{licence}#{i}" for licence, hashes in TEXTS.items() for i, h in enumerate(hashes)}


def _texts(found: list[tuple[int, str, dict[str, str]]], free: list[bool]) -> Iterator[tuple[int, str]]:
    """(number of its first sentence in found, licence) of each licence whose known sentences are there in order, but for a few; they are used up."""
    held: dict[str, list[tuple[int, int]]] = {}
    for i, (_, name, _) in enumerate(found):
        if "#" in name:
            licence, _, number = name.partition("#")
            held.setdefault(licence, []).append((int(number), i))
    for licence, seen in held.items():
        best: list[tuple[int, list[int]]] = []  # longest ascending runs by their last number; at most a few dozen sentences
        for number, i in seen:
            run = max((r for last, r in best if last < number), key=len, default=[])
            best = [(last, r) for last, r in best if last != number or len(r) > len(run)]
            if not any(last == number for last, _ in best):
                best.append((number, [*run, i]))
        run = max((r for _, r in best), key=len)
        if len(run) >= ENOUGH * len(TEXTS[licence]):
            first, last = found[run[0]][0], found[run[-1]][0]
            for i, (at, name, _) in enumerate(found):  # what else the text says is part of it
                if first <= at <= last and name != "SPDX":
                    free[i] = False
            yield run[0], licence


def _name(licence: str, groups: dict[str, str]) -> str:
    v, w = groups.get("v", "").strip(" .,"), groups.get("w", "").strip(" .,")
    if licence == "CC-{v}":
        parts = [CC_PARTS.get(p, p.upper()) for p in re.split(r"[ -](?!derivatives|commercial|alike)", v)]
        return "-".join(["CC", *parts, *([w] if w else [])])
    if licence == "BSD{v}":
        return f"BSD-{v or w}-Clause" if v or w else "BSD"
    if licence == "{v}":
        return " ".join(IDS.get(x, x.upper() if x in ("or", "and", "with") else x) for x in v.split(" "))
    if licence == "{n}":
        n = groups["n"]
        clause = re.search("[0234]", n)
        licence = f"BSD-{clause[0]}-Clause" if clause else NAMES[n]
    if licence == "{w}GPL-{v}":
        return {"": "", "lesser": "L", "library": "L", "affero": "A"}[w] + f"GPL-{v}.0" * v.isdigit() + f"GPL-{v}" * (not v.isdigit())
    if licence.startswith("MPL") and not v:
        v = w
    v = f"{v}.0" if v.isdigit() and not licence.startswith("CC") else v
    later = "-or-later" if licence == "GPL-{v}" and w else ""
    return licence.replace("-{v}", f"-{v}" if v else "") + later


def _may_match(low: str) -> bool:
    return any(h in low for h in HINTS)


def scan(text: str | None) -> tuple[list[str], list[str], list[int], list[str]]:
    """(licences, identifiers, their places in the text, identifiers that no rule took) of a whole text."""
    if not text or not _may_match(text.lower()):
        return [], [], [], []
    found = [(at, name, groups) for at, s in _join(text) for _, name, groups in identify(s)]
    free = [True] * len(found)
    licences = list(_texts(found, free))
    for licence, rule in RULES:
        start = 0
        while start < len(found):
            if not (free[start] and found[start][1] == rule[0]):
                start += 1
                continue
            taken, at = [start], start + 1
            for want in rule[1:]:
                while at < len(found) and found[at][1] != want and (found[at][1] in NEUTRAL or found[at][1] in rule):
                    at += 1
                if at < len(found) and found[at][1] == want and free[at]:
                    taken.append(at)
                    at += 1
                else:
                    break
            if len(taken) == len(rule):
                groups: dict[str, str] = {}
                for i in taken:
                    free[i] = False
                    groups |= {k: v for k, v in found[i][2].items() if k not in groups}
                licences.append((start, _name(licence, groups)))
            start += 1
    names = list(dict.fromkeys(name for _, name in sorted(licences)))
    names = [n for n in names if not any(other.startswith(n + "-") for other in names)]  # beside a version a bare name says no more
    return names, [n for _, n, _ in found], [at for at, _, _ in found], [n for (_, n, _), f in zip(found, free) if f]


def scan_licences(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, licences, sentence_ids, places, unmatched), one for each row of docs (doc_id, text).

    licences are in order of their first sentence, each once, by their SPDX names where they have one. A null, empty or licence-free text has four
    empty lists. Null and repeated doc_ids pass through; other columns aren't read; an empty table gives no rows.
    """

    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [scan(t) for t in batch.column("text").to_pylist()]
            columns = [pa.array([r[i] for r in rows], pa.list_(pa.int64() if i == 2 else pa.string())) for i in range(4)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], ["doc_id", "licences", "sentence_ids", "places", "unmatched"])

    return docs.selectExpr("cast(doc_id AS long) AS doc_id", "text").mapInArrow(lean(run), "doc_id long, licences array<string>, sentence_ids array<string>, places array<long>, unmatched array<string>")
