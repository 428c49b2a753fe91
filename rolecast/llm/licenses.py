"""Licence scans by sentence rules.

A text is cut into sentences, which are normalised and looked up among known licence
sentences; the identifiers found, in order, are matched against ordered licence rules.
A rule consumes the identifiers it matches, so that a full licence text is not also
reported by its parts. Sentences with a licence cue that no table knows make a text
"unknown" rather than silently clean.

A sentence is looked up as it is; by any three words of it, which lead to the known sentences
with gaps that hold them; and, where something is "licensed under" a name, by that name.
"""

import re
from collections.abc import Iterator
from itertools import product

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rolecast.llm.common import prepare

#: A text without any of these, and without "under" and one of VERBS, has no licence sentence. Each is within a word, so that no line's end can part it.
CUES = ("licens", "licenc", "copyright", "(c)", "permission", "warrant", "redistribut", "reserved", "public", "liab", "contributors")
VERBS = ("licensed", "released", "distributed", "available", "published", "provided", "offered", "governed", "covered")
#: A sentence with any of these that no table knows is an unknown licence statement.
STRONG = re.compile(r"\blicensed? (?:under|to|by)\b|\blicense(?: agreement)?$|^spdx |\ball rights reserved\b|\bpermission is (?:hereby )?granted\b|\bredistribution\b")

# The wording of public licences, normalised. [a|b] stands for one of these, <name> for words that are told
# (a version), and ... for any words, at least one.
SENTENCES: tuple[tuple[str, str], ...] = (
    ("rights-reserved", "all rights reserved"),
    ("rights-reserved", "copyright ... all rights reserved"),
    ("apache-2-comply", "you may not use this file except in compliance with the license"),
    ("apache-2-copy", "you may obtain a copy of the license at[| http www apache org licenses license 2 0| https www apache org licenses license 2 0]"),
    ("apache-2-copy", "you may obtain a copy of the license at [http|https] www apache org licenses license 2 0 [txt|html]"),
    ("apache-2-asis", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied"),
    ("apache-2-see", "see the license for the specific language governing permissions and limitations under the license"),
    ("mit-grant", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions"),
    ("mit-notice", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("mit-asis", "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement"),
    ("mit-liable", "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software"),
    ("gpl-grant", "... is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version <grant> of the license or at your option any later version"),
    ("gpl-hope", "... is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose"),
    ("gpl-see", "see the gnu general public license for more details"),
    ("gpl-copy", "you should have received a copy of the gnu general public license along with ..."),
    ("bsd-grant", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("bsd-source", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"),
    ("bsd-binary", "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"),
    ("bsd-names", "neither the name of ... nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("bsd-asis", "this software is provided by ... as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed"),
    ("isc-grant", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("public-domain", "... [is|are|has been|have been] [released|placed|put] [into|in] the public domain"),
    ("public-domain", "... [is|are] in the public domain"),
)
# How a short statement names a licence, without the words of FILLER, and what the name tells.
NAMES: tuple[tuple[str, str], ...] = (
    ("apache-2-short", "apache [2|2 0]"),
    ("mit-short", "[mit|expat|mit expat|expat mit]"),
    ("gpl-short", "[gpl|general public] <gpl>"),
    ("lgpl-short", "[lgpl|lesser general public|library general public] <lgpl>"),
    ("agpl-short", "[agpl|affero general public] <agpl>"),
    ("bsd-short", "[bsd|new bsd|modified bsd|simplified bsd] <bsd> clause"),
    ("bsd-short", "<bsd> clause [bsd|new bsd|modified bsd|simplified bsd]"),
    ("isc-short", "isc"),
    ("mpl-2", "[mpl|mozilla public] [2|2 0]"),
    ("cc-short", "[cc|creative commons] <cc>"),
    ("cc-short", "[cc|creative commons] <cc> <ccv>"),
    ("cc0", "[cc0|cc zero|creative commons zero|creative commons cc0][| 1 0]"),
    ("unlicense", "unlicense"),
)
#: What the told words of NAMES and SENTENCES may be, as text and as written in a licence's name.
TOLD: dict[str, dict[str, str]] = {
    "grant": {"2": "2.0", "3": "3.0"},
    "gpl": {"1": "1.0", "1 0": "1.0", "2": "2.0", "2 0": "2.0", "3": "3.0", "3 0": "3.0"},
    "lgpl": {"2": "2.0", "2 0": "2.0", "2 1": "2.1", "3": "3.0", "3 0": "3.0"},
    "agpl": {"3": "3.0", "3 0": "3.0"},
    "bsd": {"2": "2", "3": "3", "two": "2", "three": "3"},
    "cc": {"by": "BY", "by sa": "BY-SA", "by nc": "BY-NC", "by nd": "BY-ND", "by nc sa": "BY-NC-SA", "by nc nd": "BY-NC-ND", "attribution": "BY", "attribution sharealike": "BY-SA", "attribution share alike": "BY-SA", "attribution noncommercial": "BY-NC"},
    "ccv": {"1 0": "1.0", "2 0": "2.0", "2 5": "2.5", "3 0": "3.0", "4 0": "4.0"},
}
#: Words of a short statement that do not change what it names, and words that may stand after a name.
FILLER = frozenset("a an the of and its terms conditions license licenses version v gnu international unported universal".split())
AFTER = frozenset("or to by unless see with for at in as which that except only you it we this these from on since is are all http https www copyright".split())
#: Ordered: the first rule whose sentences all follow one another wins and consumes them. $name is what the sentence told.
RULES: tuple[tuple[str, tuple[str, ...]], ...] = (
    ("MIT", ("mit-grant", "mit-notice", "mit-asis", "mit-liable")),
    ("MIT", ("mit-grant", "mit-notice", "mit-asis")),
    ("MIT", ("mit-grant", "mit-notice")),
    ("Apache-2.0", ("apache-2-short", "apache-2-comply", "apache-2-copy", "apache-2-asis", "apache-2-see")),
    ("Apache-2.0", ("apache-2-short", "apache-2-comply", "apache-2-copy")),
    ("BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-names")),
    ("BSD-2-Clause", ("bsd-grant", "bsd-source", "bsd-binary")),
    ("GPL-$grant-or-later", ("gpl-grant", "gpl-hope", "gpl-see", "gpl-copy")),
    ("GPL-$grant-or-later", ("gpl-grant", "gpl-hope", "gpl-see")),
    ("GPL-$grant-or-later", ("gpl-grant",)),
    ("ISC", ("isc-grant",)),
    ("Apache-2.0", ("apache-2-short",)),
    ("MIT", ("mit-short",)),
    ("LGPL-$lgpl-$later", ("lgpl-short",)),
    ("AGPL-$agpl-$later", ("agpl-short",)),
    ("GPL-$gpl-$later", ("gpl-short",)),
    ("BSD-$bsd-Clause", ("bsd-short",)),
    ("ISC", ("isc-short",)),
    ("MPL-2.0", ("mpl-2",)),
    ("CC-$cc-$ccv", ("cc-short",)),
    ("CC0-1.0", ("cc0",)),
    ("Unlicense", ("unlicense",)),
    ("Public-Domain", ("public-domain",)),
    ("$spdx", ("spdx",)),
    ("All-Rights-Reserved", ("rights-reserved",)),
)
ENDS = re.compile(r"(?<=[.!?;])[\"')\]]*\s+|(?<=conditions:)\s+|(?<=met:)\s+|\n\s*\n|\n(?=\s*(?:[#*/-]+\s*)?(?:[A-Z(]|\d+\.))")
SPDX = re.compile(r"SPDX-License-Identifier:[ \t]*([A-Za-z0-9][A-Za-z0-9.+-]*(?:[ \t]+(?:AND|OR|WITH)[ \t]+[A-Za-z0-9][A-Za-z0-9.+-]*)*)", re.I)
UNDER = re.compile(rf"\b(?:{'|'.join(VERBS)}) under ")


def _choices(pattern: str) -> list[str]:
    """A pattern's texts, each [a|b] replaced by one of its words."""
    parts = re.split(r"\[([^\]]*)\]", pattern)
    return ["".join(x) for x in product(*(p.split("|") if i % 2 else [p] for i, p in enumerate(parts)))]


def _told(pattern: str) -> list[tuple[str, dict[str, str]]]:
    """A text's forms with each <name> replaced by one of its words, and what each form tells."""
    names = re.findall(r"<(\w+)>", pattern)
    out = []
    for words in product(*(TOLD[n] for n in names)):
        text = pattern
        for name, word in zip(names, words):
            text = text.replace(f"<{name}>", word)
        out.append((text, {n: TOLD[n][w] for n, w in zip(names, words)}))
    return out


Known = tuple[str, dict[str, str]]
#: Sentences without a gap, by their text; those with gaps, as the texts between them, by the first three words of the longest.
WHOLE: dict[str, Known] = {}
GAPPED: dict[str, list[tuple[Known, list[str]]]] = {}
for _name, _pattern in SENTENCES:
    for _text, _what in (x for c in _choices(_pattern) for x in _told(c)):
        if "..." in _text:
            _parts = [p.strip() for p in _text.split("...")]
            GAPPED.setdefault(" ".join(max(_parts, key=len).split()[:3]), []).append(((_name, _what), _parts))
        else:
            WHOLE[_text] = (_name, _what)
#: Names of short statements by their words, and the most words of one.
SHORT: dict[str, Known] = {" ".join(t.split()): (n, w) for n, p in NAMES for c in _choices(p) for t, w in _told(c)}
MOST_WORDS = max(len(x.split()) for x in SHORT)
#: Licence names as written, by their lower-case form.
WRITTEN = {name.lower(): name for licence, _ in RULES for name in [re.sub(r"-\$later$", "", licence)] if "$" not in name}
WRITTEN |= {f"{kind.lower()}-{v}{end}": f"{kind}-{v}{end}" for kind, key in (("GPL", "gpl"), ("LGPL", "lgpl"), ("AGPL", "agpl")) for v in TOLD[key].values() for end in ("", "+", "-only", "-or-later")}
WRITTEN |= {f"cc-{k}-{v}".lower(): f"CC-{k}-{v}" for k in TOLD["cc"].values() for v in TOLD["ccv"].values()} | {f"bsd-{n}-clause": f"BSD-{n}-Clause" for n in "23"}


def normalise(sentence: str) -> str:
    """Lower case, comment marks gone, "license" for "licence", one space between words; points, dashes and quotes are spaces."""
    return " ".join(re.sub(r"[^a-z0-9+]+", " ", sentence.lower()).split()).replace("licence", "license")


def cued(text: str) -> bool:
    """Whether a text may hold a licence sentence."""
    low = text.lower()
    return any(c in low for c in CUES) or "under" in low and any(v in low for v in VERBS)


def sentences(text: str | None) -> list[tuple[str, bool, str]]:
    """The normalised sentences of a text that holds a cue, in order, whether each holds one, and as they were. Wrapped lines are joined where a sentence goes on."""
    if not text or not cued(text):
        return []
    found, start = [], 0
    for end in [*(m for m in ENDS.finditer(text)), None]:
        raw = text[start : end.start() if end else len(text)]
        start = end.end() if end else start
        if now := normalise(raw):
            found.append((now, cued(raw), raw))
    return found


def _fits(sentence: str, parts: list[str]) -> bool:
    """Whether a sentence is these texts in order, with at least a word in each gap."""
    padded, at = f" {sentence} ", 0
    if parts[0] and not padded.startswith(f" {parts[0]} "):
        return False
    if parts[-1] and not padded.endswith(f" {parts[-1]} "):
        return False
    end = len(padded) - (len(parts[-1]) + 1 if parts[-1] else 0)
    at = len(parts[0]) + 1 if parts[0] else 0
    for part in parts[1:-1]:
        at = padded.find(f" {part} ", at + 2)
        if at < 0:
            return False
        at += len(part) + 1
    return end - at > 2


def _short(sentence: str) -> Known | None:
    """What a statement that something is licensed under a name tells."""
    for m in UNDER.finditer(sentence):
        # v3, gplv3 and lgpl2+ are a name and a number
        words = re.sub(r"\b((?:[al]?gpl|mpl|bsd)?)v? ?(\d)(?=[ +]|$)", r"\1 \2", sentence[m.end() :]).replace("+", " +").split()
        places = [i for i, w in enumerate(words) if w not in FILLER][: MOST_WORDS + 4]
        for n in range(min(MOST_WORDS, len(places)), 0, -1):
            known = SHORT.get(" ".join(words[i] for i in places[:n]))
            if known is None:
                continue
            left = words[places[n - 1] + 1 :]
            while left and left[0] in FILLER:
                left = left[1:]
            later = bool(left) and (left[0] == "+" or " ".join(left[:2]) == "or later" or " ".join(left[:3]) == "or any later")
            if not left or later or left[0] in AFTER:
                return known[0], known[1] | {"later": "or-later" if later else "only"}
    return None


def identify(sentence: str) -> Known | None:
    """The identifier of a known sentence, and what it tells (a version, say)."""
    words = sentence.split()
    for bare in (sentence, " ".join(words[1:]) if words and words[0].isdigit() else sentence):  # a list's number may stand before it
        if known := WHOLE.get(bare):
            return known
    for key in map(" ".join, zip(words, words[1:], words[2:])):
        for known, parts in GAPPED.get(key, ()):
            if _fits(" ".join(words[1:]) if words[0].isdigit() else sentence, parts):
                return known
    if known := _short(sentence):
        return known
    if words and (words[0] == "copyright" or words[0] == "c" and len(words) > 1 and (words[1] == "copyright" or words[1].isdigit())):
        return "copyright", {}
    return None


def _named(licence: str, told: dict[str, str]) -> str:
    """A rule's licence with what its sentences told filled in."""
    return re.sub(r"\$(\w+)", lambda m: told.get(m[1], ""), licence).rstrip("-")


def scan(text: str | None) -> tuple[list[str], list[str], int]:
    """Identifiers in order, licences in the order of their first sentences, and cue sentences that no table knows."""
    ids: list[Known] = []
    unknown = 0
    for sentence, cue, raw in sentences(text):
        if not cue and not ids:
            continue
        named = SPDX.findall(raw) if sentence.find("spdx") >= 0 else ()
        ids += [("spdx", {"spdx": " ".join(WRITTEN.get(w.lower(), w.upper() if w.upper() in ("AND", "OR", "WITH") else w) for w in x.split())}) for x in named]
        if named:
            continue
        if (one := identify(sentence)) is not None:
            ids.append(one)
        elif STRONG.search(sentence):
            unknown += 1
    left = [(i, *x) for i, x in enumerate(ids)]
    found: list[tuple[int, str]] = []
    for licence, needed in RULES:
        i = 0
        while i + len(needed) <= len(left):
            part = left[i : i + len(needed)]
            if tuple(x[1] for x in part) == needed:
                told = {k: v for x in part for k, v in x[2].items()}
                found.append((part[0][0], _named(licence, told)))
                del left[i : i + len(needed)]
            else:
                i += 1
    return [x[0] for x in ids], [x for _, x in sorted(found)], unknown


def license_scan(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, sentence_ids, licences, n_unknown, status) for every row of docs.

    status: "known" if a rule matched, "unknown" if only unknown licence statements were
    found, else "none". Lists keep repeats, in order. Null and empty texts are "none";
    whole texts are read, however long; other columns are not read.
    """
    prepare(docs.sparkSession)
    names = ("sentence_ids", "licences", "n_unknown", "status")
    kinds = (pa.list_(pa.string()), pa.list_(pa.string()), pa.int64(), pa.string())
    fields = T.StructType([docs.schema[key], T.StructField("sentence_ids", T.ArrayType(T.StringType())), T.StructField("licences", T.ArrayType(T.StringType())), T.StructField("n_unknown", T.LongType()), T.StructField("status", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for t in batch.column(1).to_pylist():
                ids, licences, unknown = scan(t)
                rows.append((ids, licences, unknown, "known" if licences else "unknown" if unknown else "none"))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds))], names=[key, *names])

    return docs.select(F.col(key), F.col(text)).mapInArrow(run, fields)
