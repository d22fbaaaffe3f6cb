"""License scans: ordered signature rules behind a keyword gate, with overlaps settled by priority and containment."""

from __future__ import annotations

import bisect
import functools
import itertools
import re
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from erario.llm.common import raw_texts, rows

WORDS = re.compile(rb"[0-9a-z\x80-\xff]+")

# The phrases every scan reports wherever their words stand, with their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

# Licenses as (label, wording of the name, word that must occur).  Wordings match
# words that are lower-cased and parted by single blanks.
NAMED = [
    ("apache-2.0", r"apache (?:software )?license (?:version )?(?:v )?2(?: 0)?", "apache"),
    ("apache-1.1", r"apache (?:software )?license (?:version )?1 1", "apache"),
    ("apache", r"apache (?:software )?license", "apache"),
    ("mit", r"mit (?:x11 )?license", "mit"),
    ("mit", r"(?:x11|expat) license", "license"),
    ("bsd-2-clause", r"(?:simplified|freebsd) bsd license|bsd 2 clause(?: license)?|2 clause bsd(?: license)?", "bsd"),
    ("bsd-3-clause", r"(?:new|modified|revised) bsd license|bsd 3 clause(?: license)?|3 clause bsd(?: license)?", "bsd"),
    ("bsd-4-clause", r"original bsd license|bsd 4 clause(?: license)?|4 clause bsd(?: license)?", "bsd"),
    ("bsd", r"bsd (?:style )?license", "bsd"),
    ("gpl-1.0", r"(?:gnu )?general public license (?:version |v )?1(?: 0)?", "public"),
    ("gpl-2.0", r"(?:gnu )?general public license (?:version |v )?2(?: 0)?", "public"),
    ("gpl-3.0", r"(?:gnu )?general public license (?:version |v )?3(?: 0)?", "public"),
    ("gpl", r"gnu general public license", "gnu"),
    ("lgpl-2.0", r"(?:gnu )?(?:lesser|library) general public license (?:version |v )?2(?: 0)?", "public"),
    ("lgpl-2.1", r"(?:gnu )?(?:lesser|library) general public license (?:version |v )?2 1", "public"),
    ("lgpl-3.0", r"(?:gnu )?lesser general public license (?:version |v )?3(?: 0)?", "public"),
    ("lgpl", r"(?:gnu )?(?:lesser|library) general public license", "public"),
    ("agpl-3.0", r"(?:gnu )?affero general public license (?:version |v )?3(?: 0)?", "affero"),
    ("agpl", r"(?:gnu )?affero general public license", "affero"),
    ("gfdl", r"gnu free documentation license", "gnu"),
    ("mpl-1.1", r"mozilla public license (?:version )?(?:v )?1 1", "mozilla"),
    ("mpl-2.0", r"mozilla public license (?:version )?(?:v )?2(?: 0)?", "mozilla"),
    ("mpl", r"mozilla public license", "mozilla"),
    ("epl-1.0", r"eclipse public license (?:version )?(?:v )?1(?: 0)?", "eclipse"),
    ("epl-2.0", r"eclipse public license (?:version )?(?:v )?2(?: 0)?", "eclipse"),
    ("epl", r"eclipse public license", "eclipse"),
    ("cddl-1.0", r"common development and distribution license", "distribution"),
    ("cpl-1.0", r"common public license", "public"),
    ("eupl", r"european union public license", "european"),
    ("artistic-1.0", r"(?:perl )?artistic license (?:version )?1(?: 0)?", "artistic"),
    ("artistic-2.0", r"artistic license (?:version )?2(?: 0)?", "artistic"),
    ("artistic", r"artistic license", "artistic"),
    ("bsl-1.0", r"boost software license", "boost"),
    ("zlib", r"zlib (?:libpng )?license", "zlib"),
    ("isc", r"isc license", "isc"),
    ("unlicense", r"(?:the )?unlicense", "unlicense"),
    ("wtfpl", r"do what the fuck you want to public license", "want"),
    ("psf-2.0", r"python software foundation license", "python"),
    ("ofl-1.1", r"sil open font license", "sil"),
    ("ms-pl", r"microsoft public license", "microsoft"),
    ("ms-rl", r"microsoft reciprocal license", "microsoft"),
    ("odbl", r"open (?:data commons open )?database license", "database"),
    ("pddl", r"public domain dedication and license", "dedication"),
    ("cc0-1.0", r"cc0(?: 1 0)?(?: universal)?", "cc0"),
    ("cc-by-nc-nd", r"creative commons attribution non ?commercial no ?deriv(?:s|atives)", "creative"),
    ("cc-by-nc-sa", r"creative commons attribution non ?commercial share ?alike", "creative"),
    ("cc-by-nc", r"creative commons attribution non ?commercial", "creative"),
    ("cc-by-nd", r"creative commons attribution no ?deriv(?:s|atives)", "creative"),
    ("cc-by-sa", r"creative commons attribution share ?alike", "creative"),
    ("cc-by", r"creative commons attribution", "creative"),
    ("cc", r"creative commons (?:public )?licen[cs]e", "creative"),
    ("cc-by-nc-nd", r"cc by nc nd(?: [1-4] [05])?", "cc"),
    ("cc-by-nc-sa", r"cc by nc sa(?: [1-4] [05])?", "cc"),
    ("cc-by-nc", r"cc by nc(?: [1-4] [05])?", "cc"),
    ("cc-by-nd", r"cc by nd(?: [1-4] [05])?", "cc"),
    ("cc-by-sa", r"cc by sa(?: [1-4] [05])?", "cc"),
    ("cc-by", r"cc by [1-4] [05]", "cc"),
]
# Identifiers of the SPDX list and short names as (label, wording, word that must occur).  They are
# words of many other texts too, so they count only after a form that says that a license holds.
ENDING = r"(?: (?:only|or later))?"
SHORT = [
    ("apache-2.0", r"apache (?:v ?|version )?2(?: 0)?", "apache"),
    ("apache-1.1", r"apache (?:v )?1 1", "apache"),
    ("apache", r"apache", "apache"),
    ("mit", r"mit(?: 0)?", "mit"),
    ("mit", r"x11", "x11"),
    ("mit", r"expat", "expat"),
    ("bsd-2-clause", r"bsd 2(?: clause)?", "bsd"),
    ("bsd-3-clause", r"bsd 3(?: clause)?", "bsd"),
    ("bsd-4-clause", r"bsd 4(?: clause)?", "bsd"),
    ("bsd", r"bsd", "bsd"),
    *[(f"{name}-{major}.{minor}", rf"(?:gnu )?{name} ?(?:version |v ?)?{major}{' ' + minor if minor != '0' else '(?: 0)?'}{ENDING}", f"{name}*")
      for name, versions in (("gpl", ("2.0", "3.0", "1.0")), ("lgpl", ("2.1", "2.0", "3.0")), ("agpl", ("3.0",))) for major, minor in (v.split(".") for v in versions)],
    ("gpl", r"(?:gnu )?gpl", "gpl"),
    ("lgpl", r"(?:gnu )?lgpl", "lgpl"),
    ("agpl", r"(?:gnu )?agpl", "agpl"),
    ("gfdl", rf"(?:gnu )?gfdl(?: 1 [1-3])?{ENDING}", "gfdl"),
    *[(f"{name}-{major}.{minor}", rf"{name} ?(?:version |v ?)?{major}{' ' + minor if minor != '0' else '(?: 0)?'}", f"{name}*")
      for name, versions in (("mpl", ("1.1", "2.0")), ("epl", ("1.0", "2.0")), ("cddl", ("1.0",)), ("cpl", ("1.0",)), ("artistic", ("1.0", "2.0")), ("bsl", ("1.0",)), ("psf", ("2.0",)), ("ofl", ("1.1",))) for major, minor in (v.split(".") for v in versions)],
    ("mpl", r"mpl", "mpl"),
    ("epl", r"epl", "epl"),
    ("eupl", r"eupl(?: 1 [0-2])?", "eupl"),
    ("artistic", r"artistic", "artistic"),
    ("zlib", r"zlib", "zlib"),
    ("isc", r"isc", "isc"),
    ("wtfpl", r"wtfpl", "wtfpl"),
    ("psf-2.0", r"python 2 0", "python"),
    ("ofl-1.1", r"ofl", "ofl"),
    ("ms-pl", r"ms pl", "ms"),
    ("ms-rl", r"ms rl", "ms"),
    ("odbl", r"odbl(?: 1 0)?", "odbl"),
    ("pddl", r"pddl(?: 1 0)?", "pddl"),
]
# Short names that tell a license wherever they stand, as they come with a version.
VERSIONED = [name for name in SHORT if re.match(r"(?:a|l)?gpl-|mpl-|epl-|cddl-|apache-", name[0])]
# Single sentences that tell a license or a claim by themselves: (label, wording, word, priority).
SENTENCES = [
    ("mit", r"permission is hereby granted free of charge to any person obtaining a copy", "hereby", 70),
    ("isc", r"permission to use copy modify and or distribute this software for any purpose", "permission", 70),
    ("bsd", r"redistribution and use in source and binary forms with or without modification", "redistribution", 70),
    ("bsd-3-clause", r"neither the name of (?:\S+ ){1,12}?may be used to endorse or promote products", "endorse", 72),
    ("unlicense", r"this is free and unencumbered software released into the public domain", "unencumbered", 70),
    ("wtfpl", r"you just do what the fuck you want to", "want", 70),
    ("warranty", r"(?:software|work|program) is provided as is without warranty", "warranty", 40),
    ("warranty", r"without warranties or conditions of any kind", "warranties", 40),
    ("warranty", r"without any warranty", "warranty", 35),
    ("gpl", r"you can redistribute it and or modify it under the terms of", "redistribute", 60),
    ("public-domain", r"(?:released|dedicated|placed) (?:in|in ?to|to) the public domain", "domain", 50),
    ("public-domain", r"public domain", "domain", 30),
    ("proprietary", r"(?:strictly )?(?:confidential and proprietary|proprietary and confidential)", "proprietary", 60),
    ("proprietary", r"unauthori[sz]ed (?:copying|use|distribution|reproduction)(?: \S+){0,8}? (?:is )?(?:strictly )?prohibited", "prohibited", 60),
    ("proprietary", r"no part of this (?:\S+ ){1,4}?may be reproduced", "reproduced", 60),
    ("copyright", r"copyright (?:c )?(?:19|20)[0-9]{2}(?: (?:19|20)[0-9]{2})?", "copyright", 25),
    ("copyright", r"\xc2\xa9 ?(?:19|20)[0-9]{2}", "\xa9*", 25),
    ("commercial", r"not for (?:commercial use|resale|redistribution)", "not", 45),
    ("commercial", r"for (?:personal|non ?commercial|educational) use only", "only", 45),
    ("terms", r"subject to the terms (?:and conditions )?of", "terms", 20),
]
# How a document says that a license holds; {} is the license's own wording.
FORMS = [
    (r"spdx licen[cs]e identifier {}(?: (?:only|or later))?", 9, 0.98, "spdx"),
    (r"licen[cs]ed under (?:the )?(?:terms of )?(?:the )?{}", 8, 0.95, "under"),
    (r"(?:released|distributed|published|available|provided|used) under (?:the )?(?:terms of )?(?:the )?{}", 7, 0.9, "under"),
    (r"under the terms (?:and conditions )?of (?:the )?{}", 6, 0.9, "terms"),
    (r"{}", 0, 0.7, ""),
]


@dataclass(frozen=True)
class Rule:
    """A signature: it is tried only where all ``gate`` words, or words that begin so, occur.  A higher priority wins."""

    label: str
    pattern: re.Pattern
    gate: tuple[bytes, ...]
    priority: int
    confidence: float
    base: bool = False


def _rule(label: str, wording: str, gate: list[str], priority: int, confidence: float, base: bool = False) -> Rule:
    pattern = re.compile(b"(?<= )(?:" + wording.encode("latin-1") + b")(?= )")
    return Rule(label, pattern, tuple(f" {word} ".encode() if word[-1] != "*" else f" {word[:-1]}".encode() for word in gate if word), priority, confidence, base)


def rules() -> list[Rule]:
    """Every form of every named license, the sentences and the base phrases, in the order they are tried.

    Among names the more special stands first in ``NAMED`` and gets the higher priority.
    """
    made = [_rule(label, phrase, phrase.split()[:1], 100, 0.8, True) for phrase, label in BASE.items()]
    for place, (label, name, word) in enumerate(NAMED):
        special = 1 + (len(NAMED) - place) / len(NAMED)
        made += [_rule(label, form.format(f"(?:{name})"), [word, more], round(10 * (gain + special)), sure) for form, gain, sure, more in FORMS]
    for place, (label, name, word) in enumerate(SHORT):
        special = (len(SHORT) - place) / len(SHORT)  # below each spelled-out name
        made += [_rule(label, form.format(f"(?:{name})"), [word, more], round(10 * (gain + special)), sure) for form, gain, sure, more in FORMS[:-1]]
    made += [_rule(label, wording, [word], 9, 0.6) for label, wording, word in VERSIONED]
    made += [_rule(label, wording, [word], priority, 0.6) for label, wording, word, priority in SENTENCES]
    return sorted(made, key=lambda rule: -rule.priority)


class Scanner:
    def __init__(self, signatures: list[Rule]):
        self.rules = signatures
        self.gates = sorted({word for rule in signatures for word in rule.gate})

    def spans(self, text: bytes) -> tuple[int, list[dict]]:
        """Number of words, and the detections that stand: rule number, label, first word, word after the last."""
        words = WORDS.findall(text.lower())  # bytes.lower changes A-Z alone
        line = b" " + b" ".join(words) + b" "
        there = {word for word in self.gates if word in line}
        kept: list[tuple[int, int, int]] = []
        if there:
            standing = Standing()
            for number, rule in enumerate(self.rules):
                if there.issuperset(rule.gate):
                    for found in rule.pattern.finditer(line):
                        start, end = found.span()
                        if rule.base:
                            kept.append((start, end, number))
                        elif not standing.holds(start, end):
                            standing.add(start, end)
                            kept.append((start, end, number))
        firsts = list(itertools.accumulate((len(word) + 1 for word in words), initial=1)) if kept else []  # where each word starts in the line
        out = []
        for start, end, number in kept:
            rule = self.rules[number]
            first = bisect.bisect_left(firsts, start)
            out.append({"rule": number, "label": rule.label, "base": rule.base, "confidence": rule.confidence, "start": first, "end": bisect.bisect_left(firsts, end, first)})
        return len(words), sorted(out, key=lambda x: (x["start"], x["end"], x["rule"]))


class Standing:
    """Detections that stand, base places left out: rules come by priority, so a place inside one of these gives way.

    Only places that lie in no other one matter; sorted by start they are sorted by end too,
    so the last one that starts no later is the only one to ask.
    """

    def __init__(self):
        self.starts: list[int] = []
        self.ends: list[int] = []

    def holds(self, start: int, end: int) -> bool:
        at = bisect.bisect_right(self.starts, start) - 1
        return at >= 0 and end <= self.ends[at]

    def add(self, start: int, end: int) -> None:
        """Take in a place that no other one holds; those that it holds are no longer needed."""
        lo = bisect.bisect_left(self.starts, start)
        hi = bisect.bisect_right(self.ends, end, lo)
        self.starts[lo:hi], self.ends[lo:hi] = [start], [end]


@functools.cache
def scanner() -> Scanner:
    return Scanner(rules())


SPAN = pa.struct([("rule", pa.int64()), ("label", pa.string()), ("base", pa.bool_()), ("confidence", pa.float64()), ("start", pa.int64()), ("end", pa.int64())])
SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("spans", pa.list_(SPAN))])


def scan_licenses(docs: DataFrame) -> DataFrame:
    """``doc_id, n_words, spans`` of every whole text; a span holds rule, label, base, confidence, first word, word after the last.

    Words are runs of digits, letters a-z (A-Z lower-cased) and characters beyond ASCII.  A rule
    is tried only if its gate words occur.  Detections inside one of a rule of higher priority
    fall; base phrases always stay, at every place.  One map without a shuffle.

    Null and empty texts have no words and no spans.  Repeated rows give one row each; other
    columns are not read.
    """

    def scan(batches):
        found = scanner()
        for batch in batches:
            results = [found.spans(text) for text in raw_texts(batch)]
            yield rows(SCHEMA, doc_id=batch.column("doc_id"), n_words=[n for n, _ in results], spans=[spans for _, spans in results])

    schema = "doc_id long, n_words long, spans array<struct<rule: long, label: string, base: boolean, confidence: double, start: long, end: long>>"
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(scan, schema)


def license_digest(found: DataFrame) -> DataFrame:
    """Counts, first and last base place, labels and a score: the chance that at least one detection is right."""
    base = F.filter("spans", lambda x: x["base"])
    starts = F.transform(base, lambda x: x["start"])

    def labels(spans):
        return F.array_join(F.array_sort(F.array_distinct(F.transform(spans, lambda x: x["label"]))), ",")

    doubt = F.aggregate("spans", F.lit(1.0), lambda left, x: left * (1 - x["confidence"]))
    return found.select(
        "doc_id", "n_words", F.size(base).cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        labels(base).alias("base_labels"), labels(F.col("spans")).alias("labels"), (1 - doubt).alias("score"),
    )
