"""License scan: ordered signature rules behind a keyword gate, with suppression of contained matches."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The phrases every document is searched for, and their labels.
BASE = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

# ASCII letters in lower case, digits and all other bytes stay; ASCII separators become blanks.
_BYTES = bytes(
    c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256)
)

# A license family: label, the ways its name is written (as regular expressions over words that
# are joined by one blank), its versions, and a word without which no rule of it can match.
FAMILIES = [
    ("gpl", r"(?:gnu )?(?:general public license|gpl)", ["1", "2", "3"], ("general public", "gpl")),
    ("lgpl", r"(?:gnu )?(?:(?:lesser|library) general public license|lgpl)", ["2", "2 1", "3"], ("general public", "lgpl")),
    ("agpl", r"(?:gnu )?(?:affero general public license|agpl)", ["1", "3"], ("affero", "agpl")),
    ("gfdl", r"(?:gnu )?(?:free documentation license|gfdl)", ["1 1", "1 2", "1 3"], ("free documentation", "gfdl")),
    ("apache", r"apache(?: software)? license", ["1", "1 1", "2"], ("apache",)),
    ("mpl", r"(?:mozilla public license|mpl)", ["1", "1 1", "2"], ("mozilla", "mpl")),
    ("epl", r"(?:eclipse public license|epl)", ["1", "2"], ("eclipse", "epl")),
    ("cddl", r"(?:common development and distribution license|cddl)", ["1", "1 1"], ("common development", "cddl")),
    ("eupl", r"(?:european union public licen[cs]e|eupl)", ["1 1", "1 2"], ("european union", "eupl")),
    ("artistic", r"artistic license", ["1", "2"], ("artistic",)),
    ("bsl", r"(?:boost software license|bsl)", ["1"], ("boost", "bsl")),
    ("afl", r"academic free license", ["1 2", "2 1", "3"], ("academic free",)),
    ("osl", r"open software license", ["1", "2", "3"], ("open software",)),
    ("ms-pl", r"microsoft public license", [], ("microsoft public",)),
    ("mit", r"(?:mit|expat|x11) license", [], ("mit ", "expat", "x11")),
    ("bsd", r"(?:(?:2|two|3|three|4|four) clause )?bsd(?: (?:2|3|4) clause)? license", [], ("bsd",)),
    ("isc", r"isc license", [], ("isc",)),
    ("zlib", r"zlib(?: libpng)? license", [], ("zlib",)),
    ("unlicense", r"(?:the unlicense|unlicense)", [], ("unlicense",)),
    ("wtfpl", r"(?:do what the fuck you want to public license|wtfpl)", ["2"], ("what the fuck", "wtfpl")),
    ("cc0", r"(?:cc0|creative commons zero)", ["1"], ("cc0", "commons zero")),
    ("cc-by", r"(?:cc by|creative commons attribution)", ["1", "2", "2 5", "3", "4"], ("cc by", "creative commons")),
    ("cc-by-sa", r"(?:cc by sa|creative commons attribution share ?alike)", ["1", "2", "2 5", "3", "4"], ("cc by sa", "share")),
    ("cc-by-nd", r"(?:cc by nd|creative commons attribution no ?deriv\w*)", ["1", "2", "2 5", "3", "4"], ("cc by nd", "deriv")),
    ("cc-by-nc", r"(?:cc by nc|creative commons attribution non ?commercial)", ["1", "2", "2 5", "3", "4"], ("cc by nc", "commercial")),
    ("cc-by-nc-sa", r"(?:cc by nc sa|creative commons attribution non ?commercial share ?alike)", ["2", "2 5", "3", "4"], ("nc sa", "commercial share")),
    ("cc-by-nc-nd", r"(?:cc by nc nd|creative commons attribution non ?commercial no ?deriv\w*)", ["2", "2 5", "3", "4"], ("nc nd", "commercial no")),
]

# How a family is referred to: priority (lower is stronger), strength of the evidence, pattern.
FORMS = [
    (10, 1.0, r"(?:licensed|released|distributed|available|published|provided) under (?:the )?(?:terms of (?:the )?)?{name}{version}"),
    (20, 0.9, r"(?:under|by) (?:the )?(?:terms (?:and conditions )?of (?:the )?)?{name}{version}"),
    (30, 0.8, r"spdx license identifier {name}{version}"),
    (40, 0.7, r"{name}{version}"),
]

# Sentences of license texts that do not name the license: label, priority, strength, keyword, pattern.
TEXTS = [
    ("mit", 15, 0.9, "permission is hereby granted", r"permission is hereby granted free of charge to any person obtaining a copy"),
    ("isc", 15, 0.9, "permission to use copy modify", r"permission to use copy modify and or distribute this software for any purpose"),
    ("bsd", 15, 0.9, "redistribution and use", r"redistribution and use in source and binary forms with or without modification"),
    ("gpl", 15, 0.9, "free software foundation", r"under the terms of the gnu general public license as published by the free software foundation"),
    ("apache", 15, 0.9, "apache org licenses", r"www apache org licenses license 2 0"),
    ("zlib", 15, 0.8, "without any express or implied", r"this software is provided as is without any express or implied warranty"),
    ("unlicense", 15, 0.9, "public domain", r"free and unencumbered software released into the public domain"),
    ("public-domain", 50, 0.6, "public domain", r"(?:in|into|to) the public domain"),
    ("all-rights-reserved", 60, 0.5, "all rights reserved", r"all rights reserved"),
    ("proprietary", 55, 0.6, "proprietary", r"proprietary and confidential"),
]


# SPDX identifiers, with the labels of their families.
SPDX = [
    ("0BSD", "bsd"), ("AFL-3.0", "afl-3"), ("AGPL-3.0", "agpl-3"), ("Apache-1.1", "apache-1.1"), ("Apache-2.0", "apache-2"),
    ("Artistic-2.0", "artistic-2"), ("BSD-2-Clause", "bsd"), ("BSD-3-Clause", "bsd"), ("BSD-4-Clause", "bsd"), ("BSL-1.0", "bsl-1"),
    ("CC0-1.0", "cc0-1"), ("CC-BY-3.0", "cc-by-3"), ("CC-BY-4.0", "cc-by-4"), ("CC-BY-SA-3.0", "cc-by-sa-3"), ("CC-BY-SA-4.0", "cc-by-sa-4"),
    ("CC-BY-NC-4.0", "cc-by-nc-4"), ("CC-BY-ND-4.0", "cc-by-nd-4"), ("CC-BY-NC-SA-4.0", "cc-by-nc-sa-4"), ("CC-BY-NC-ND-4.0", "cc-by-nc-nd-4"),
    ("CDDL-1.0", "cddl-1"), ("CDDL-1.1", "cddl-1.1"), ("EPL-1.0", "epl-1"), ("EPL-2.0", "epl-2"), ("EUPL-1.2", "eupl-1.2"), ("GFDL-1.3", "gfdl-1.3"),
    ("GPL-1.0", "gpl-1"), ("GPL-2.0", "gpl-2"), ("GPL-3.0", "gpl-3"), ("ISC", "isc"), ("LGPL-2.0", "lgpl-2"), ("LGPL-2.1", "lgpl-2.1"),
    ("LGPL-3.0", "lgpl-3"), ("MIT", "mit"), ("MIT-0", "mit"), ("MPL-1.1", "mpl-1.1"), ("MPL-2.0", "mpl-2"), ("MS-PL", "ms-pl"), ("OFL-1.1", "ofl"),
    ("OSL-3.0", "osl-3"), ("PostgreSQL", "postgresql"), ("Python-2.0", "python"), ("Unlicense", "unlicense"), ("WTFPL", "wtfpl"), ("X11", "mit"), ("Zlib", "zlib"),
]

# Short names as people write them: label, priority, strength, keyword, pattern.
SHORT = [
    ("apache-2", 35, 0.7, "apache", r"apache (?:license )?(?:version |v)?2(?: 0)?"),
    ("bsd", 35, 0.7, "bsd", r"bsd [234] clause"),
    ("bsd", 35, 0.7, "bsd", r"(?:two|three|four|new|simplified|modified|revised) (?:clause )?bsd"),
    ("gpl-2", 35, 0.7, "gplv2", r"gplv2"),
    ("gpl-3", 35, 0.7, "gplv3", r"gplv3"),
    ("lgpl-2.1", 35, 0.7, "lgplv2", r"lgplv2 1"),
    ("lgpl-3", 35, 0.7, "lgplv3", r"lgplv3"),
    ("agpl-3", 35, 0.7, "agplv3", r"agplv3"),
    ("cc0", 35, 0.7, "commons", r"creative commons public domain dedication"),
    ("ofl", 35, 0.8, "sil open", r"sil open font license"),
    ("mit", 35, 0.7, "mit", r"(?:dual|triple) licensed under (?:the )?mit"),
    ("python", 35, 0.8, "python software", r"python software foundation license"),
    ("php", 35, 0.8, "php", r"php license"),
    ("w3c", 35, 0.8, "w3c", r"w3c (?:software|document) (?:notice and )?license"),
    ("openssl", 35, 0.8, "openssl", r"openssl license"),
    ("beerware", 35, 0.8, "beer", r"(?:beerware|the beer ware license)"),
    ("json", 35, 0.8, "good not evil", r"shall be used for good not evil"),
]

# Words in front of a name that take it back; such a match covers what is in it and has no label.
NEGATION = r"(?:not|never|no longer|neither) (?:\w+ )?(?:licensed|released|distributed|available|published|provided|covered) (?:under|by) (?:the )?(?:terms of (?:the )?)?{name}{version}"


@dataclass(frozen=True)
class Rule:
    label: str
    priority: int
    strength: float
    keywords: tuple[bytes, ...]
    pattern: re.Pattern


@lru_cache(maxsize=1)
def rules() -> list[Rule]:
    """All rules in order of priority: every family in every version and form, then sentences."""
    made = []
    for label, name, versions, keywords in FAMILIES:
        keys = tuple(k.encode() for k in keywords)
        # The version-free rule comes after the versions of its form.
        for step, version in enumerate([*versions, ""]):
            tail = rf" (?:version |v|versions )?{version}(?: 0)?" if version else ""
            full = f"{label}-{version.replace(' ', '.')}" if version else label
            for priority, strength, form in [*FORMS, (0, 0.0, NEGATION)]:
                text = form.format(name=name, version=tail)
                said = full if strength else ""
                made.append(Rule(said, priority + (0 if version else 5), strength, keys, re.compile(rf"(?<= ){text}(?= )".encode())))
    for name, label in SPDX:
        words = normalise(name).decode().strip()
        for text in (rf"spdx license identifier {words}", rf"(?:(?<= or )|(?<= and )){words}"):  # alone, or as a further operand
            made.append(Rule(label, 30, 0.9, (b"spdx",), re.compile(rf"(?<= ){text}(?: only| or later)?(?= )".encode())))
    for label, priority, strength, keyword, text in [*TEXTS, *SHORT]:
        made.append(Rule(label, priority, strength, (keyword.encode(),), re.compile(rf"(?<= ){text}(?= )".encode())))
    return sorted(made, key=lambda r: (r.priority, r.label))


@lru_cache(maxsize=1)
def _by_keyword() -> list[tuple[bytes, list[int]]]:
    """Keyword to the numbers of the rules it opens."""
    found: dict[bytes, list[int]] = {}
    for i, rule in enumerate(rules()):
        for k in rule.keywords:
            found.setdefault(k, []).append(i)
    return list(found.items())


# No rule and no base phrase matches a text that has none of these.
GATE = [b"licen", b"spdx", b"bsd", b"beerware", b"good not evil", b"cc", b"gpl", b"creative commons", b"public", b"rights reserved", b"permission", b"redistribution",
        b"proprietary", b"apache", b"warranty", b"gfdl", b"mpl", b"epl", b"cddl", b"eupl", b"bsl", b"wtfpl"]


def normalise(text: str | None) -> bytes:
    """The words of a text, A-Z in lower case, each between single blanks."""
    return b" " + b" ".join((text or "").encode().translate(_BYTES).split()) + b" "


def detections(words: bytes) -> list[tuple[int, int, Rule]]:
    """Matches (from, to, rule) left after suppression, in order of place.

    Matches are accepted in order of priority, within one priority the longest first.  A match
    that lies inside an accepted one is dropped; a longer match of a weaker rule leaves the
    accepted ones in it, and partly overlapping matches stay.
    """
    # Accepted matches that lie in no other one: ascending starts, and so ascending ends.
    starts: list[int] = []
    ends: list[int] = []
    opened = sorted({i for k, numbers in _by_keyword() if k in words for i in numbers})
    found = [(m.start(), m.end(), rules()[i]) for i in opened for m in rules()[i].pattern.finditer(words)]
    kept: list[tuple[int, int, Rule]] = []
    for start, end, rule in sorted(found, key=lambda d: (d[2].priority, d[0] - d[1])):
        at = bisect_right(starts, start)
        if at and ends[at - 1] >= end:
            continue
        kept.append((start, end, rule))
        first = at - 1 if at and starts[at - 1] == start else at
        last = bisect_right(ends, end, first)
        starts[first:last], ends[first:last] = [start], [end]
    return sorted(kept, key=lambda d: (d[0], d[1], d[2].label))


def scan(text: str | None) -> tuple:
    """n_words, n_base, first_word, last_word, base_labels, labels, score of one text."""
    words = normalise(text)
    n_words = words.count(b" ") - 1 if len(words) > 2 else 0
    if not any(k in words for k in GATE):
        return n_words, 0, None, None, "", "", 0.0
    places, base = [], set()
    for phrase, label in BASE.items():
        target = f" {phrase} ".encode()
        at = words.find(target)
        while at >= 0:
            places.append(at)
            base.add(label)
            at = words.find(target, at + 1)
    starts, number, before = [], 0, 0
    for at in sorted(places):  # blanks are counted once on the way through the text
        number, before = number + words.count(b" ", before, at), at
        starts.append(number)
    found = detections(words)
    labels = base | {rule.label for _, _, rule in found if rule.label}
    missed = 1.0
    for _, _, rule in found:
        missed *= 1 - 0.95 * rule.strength
    score = max(1 - missed, 0.7 if base else 0.0)
    return (n_words, len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)),
            ",".join(sorted(labels)), score)


SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"


def scan_licenses(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Licenses named in every whole text.

    `n_base`, `first_word`, `last_word` and `base_labels` are about the base phrases, `labels`
    adds those of the signature rules (with the version where one is named), `score` is the
    combined strength of all matches (0 without any).  No shuffle; one output row per row.
    Null and empty texts have no words, no labels and score 0.  Null ids and repeated rows are
    kept, other columns ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]
        for batch in batches:
            if batch.num_rows:
                columns = zip(*map(scan, batch.column(1).to_pylist()), strict=True)
                arrays = [pa.array(list(c), t) for c, t in zip(columns, types, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], names=[p.split()[0] for p in SCHEMA.split(", ")])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, SCHEMA)
