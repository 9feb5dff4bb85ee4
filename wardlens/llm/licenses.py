"""License scan: ordered signature rules behind a keyword gate.

A rule is a regular expression over the normalised words of a text (A-Z
lower-cased, one space between words), a license label and a priority.
:data:`FAMILIES` states the licenses by hand; :func:`rules` writes out the
ordered rules for each: full grant sentences first, then SPDX tags, names with
a version, names and short mentions.  A text without any gate word runs no
rule; a rule runs only if its own keyword is among the words of the text.

Detections that overlap are resolved by priority (lower first), then length,
then place: a detection whose interval lies in that of a better one is
suppressed.  What remains gives the labels, with the base phrases' labels,
which stay in any case.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardlens.llm.common import ASCII_LOWER, WORD, map_batches

WORDS = re.compile(WORD)

# The base phrases and their labels.
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

#: label -> (SPDX names as words, names as a pattern over words, own keyword).  Versions are written as words: "2 0" is 2.0.
FAMILIES: dict[str, tuple[str, str, str]] = {
    "mit": ("mit", r"mit|expat", "mit|expat"),
    "mit-0": ("mit 0", r"mit no attribution", "mit"),
    "x11": ("x11", r"x11|x consortium", "x11|consortium"),
    "isc": ("isc", r"isc|internet systems consortium", "isc|consortium"),
    "apache-1.1": ("apache 1 1", r"apache(?: software)?(?: license)?(?: version| v)? 1 1", "apache"),
    "apache-2": ("apache 2 0", r"apache(?: software)?(?: license)?(?: version| v)? 2(?: 0)?", "apache"),
    "bsd-2-clause": ("bsd 2 clause", r"(?:2|two) clause bsd|simplified bsd|freebsd", "bsd|freebsd"),
    "bsd-3-clause": ("bsd 3 clause", r"(?:3|three) clause bsd|(?:new|modified|revised) bsd", "bsd"),
    "bsd-4-clause": ("bsd 4 clause", r"(?:4|four) clause bsd|original bsd", "bsd"),
    "0bsd": ("0bsd", r"zero clause bsd|bsd zero clause", "bsd|0bsd"),
    "gpl-1": ("gpl 1 0(?: only| or later)?", r"(?:gnu )?(?:general public license|gpl)(?: version| v)? 1(?: 0)?", "gpl|general"),
    "gpl-2": ("gpl 2 0(?: only| or later)?", r"(?:gnu )?(?:general public license|gpl)(?: version| v)? 2(?: 0)?|gplv2", "gpl|general|gplv2"),
    "gpl-3": ("gpl 3 0(?: only| or later)?", r"(?:gnu )?(?:general public license|gpl)(?: version| v)? 3(?: 0)?|gplv3", "gpl|general|gplv3"),
    "lgpl-2": ("lgpl 2 0(?: only| or later)?", r"(?:gnu )?(?:library|lesser) general public license(?: version| v)? 2(?: 0)?|lgplv2", "lgpl|general|lgplv2"),
    "lgpl-2.1": ("lgpl 2 1(?: only| or later)?", r"(?:gnu )?lesser general public license(?: version| v)? 2 1|lgplv2 1", "lgpl|general|lgplv2"),
    "lgpl-3": ("lgpl 3 0(?: only| or later)?", r"(?:gnu )?lesser general public license(?: version| v)? 3(?: 0)?|lgplv3", "lgpl|general|lgplv3"),
    "agpl-3": ("agpl 3 0(?: only| or later)?", r"(?:gnu )?affero general public license(?: version| v)? 3(?: 0)?|agplv3", "agpl|affero|agplv3"),
    "mpl-1.1": ("mpl 1 1", r"mozilla public license(?: version| v)? 1 1", "mpl|mozilla"),
    "mpl-2": ("mpl 2 0", r"mozilla public license(?: version| v)? 2(?: 0)?", "mpl|mozilla"),
    "epl-1": ("epl 1 0", r"eclipse public license(?: version| v)? 1(?: 0)?", "epl|eclipse"),
    "epl-2": ("epl 2 0", r"eclipse public license(?: version| v)? 2(?: 0)?", "epl|eclipse"),
    "cddl-1": ("cddl 1 0", r"common development and distribution license(?: version| v)? 1(?: 0)?", "cddl|distribution"),
    "cpl-1": ("cpl 1 0", r"common public license(?: version| v)? 1(?: 0)?", "cpl|common"),
    "eupl-1.2": ("eupl 1 2", r"european union public licen[cs]e(?: version| v)? 1 2", "eupl|european"),
    "artistic-1": ("artistic 1 0", r"artistic license(?: version| v)? 1(?: 0)?", "artistic"),
    "artistic-2": ("artistic 2 0", r"artistic license(?: version| v)? 2(?: 0)?", "artistic"),
    "boost-1": ("bsl 1 0", r"boost software license(?: version| v)? 1(?: 0)?", "bsl|boost"),
    "zlib": ("zlib", r"zlib(?: libpng)?", "zlib"),
    "openssl": ("openssl", r"openssl", "openssl"),
    "python-2": ("python 2 0|psf 2 0", r"python software foundation", "python|psf"),
    "php-3": ("php 3 01", r"php license(?: version| v)? 3 0[01]?", "php"),
    "ruby": ("ruby", r"ruby", "ruby"),
    "wtfpl": ("wtfpl", r"do what the fuck you want to public", "wtfpl|fuck"),
    "unlicense": ("unlicense", r"the unlicense", "unlicense"),
    "beerware": ("beerware", r"beer ?ware", "beerware|beer"),
    "ofl-1.1": ("ofl 1 1", r"sil open font license(?: version| v)? 1 1", "ofl|sil"),
    "ms-pl": ("ms pl", r"microsoft public license", "microsoft|pl"),
    "ms-rl": ("ms rl", r"microsoft reciprocal license", "microsoft|rl"),
    "cecill-2.1": ("cecill 2 1", r"cecill(?: version| v)? 2 1", "cecill"),
    "upl-1": ("upl 1 0", r"universal permissive license(?: version| v)? 1(?: 0)?", "upl|universal"),
    "odbl-1": ("odbl 1 0", r"open database license(?: version| v)? 1(?: 0)?|open database license", "odbl|database"),
    "odc-by": ("odc by 1 0", r"open data commons attribution(?: license)?", "odc|commons"),
    "pddl": ("pddl 1 0", r"public domain dedication and license", "pddl|dedication"),
    "gfdl-1.3": ("gfdl 1 3(?: only| or later)?", r"(?:gnu )?free documentation license(?: version| v)? 1 3", "gfdl|documentation"),
    "cc0": ("cc0 1 0", r"cc0|creative commons zero", "cc0|zero"),
    "cc-by": ("cc by [1-4] 0", r"(?:creative commons|cc)(?: attribution| by)(?: [1-4] [05])?", "cc|commons"),
    "cc-by-sa": ("cc by sa [1-4] 0", r"(?:creative commons|cc)(?: attribution| by) (?:share ?alike|sa)(?: [1-4] [05])?", "cc|commons"),
    "cc-by-nd": ("cc by nd [1-4] 0", r"(?:creative commons|cc)(?: attribution| by) (?:no ?derivatives|nd)(?: [1-4] [05])?", "cc|commons"),
    "cc-by-nc": ("cc by nc [1-4] 0", r"(?:creative commons|cc)(?: attribution| by) (?:non ?commercial|nc)(?: [1-4] [05])?", "cc|commons"),
    "cc-by-nc-sa": ("cc by nc sa [1-4] 0", r"(?:creative commons|cc)(?: attribution| by) (?:non ?commercial|nc) (?:share ?alike|sa)(?: [1-4] [05])?", "cc|commons"),
    "cc-by-nc-nd": ("cc by nc nd [1-4] 0", r"(?:creative commons|cc)(?: attribution| by) (?:non ?commercial|nc) (?:no ?derivatives|nd)(?: [1-4] [05])?", "cc|commons"),
    "all-rights-reserved": ("", r"all rights reserved", "reserved"),
    "public-domain": ("", r"(?:released into|placed in|dedicated to) the public domain", "domain"),
    "proprietary": ("", r"proprietary and confidential|confidential and proprietary", "proprietary"),
}
#: Families named without a version or clause number, ranked after all others: label -> (names as a pattern, own keyword).
VERSIONLESS: dict[str, tuple[str, str]] = {
    "gpl": (r"(?:gnu )?(?:general public license|gpl)", "gpl|general"),
    "lgpl": (r"(?:gnu )?(?:(?:library|lesser) general public license|lgpl)", "lgpl|general"),
    "agpl": (r"(?:gnu )?(?:affero general public license|agpl)", "agpl|affero"),
    "mpl": (r"mozilla public license|mpl", "mpl|mozilla"),
    "apache": (r"apache(?: software)?", "apache"),
    "bsd": (r"bsd", "bsd"),
}
#: The forms in which a license is named, in order of priority: (confidence, pattern with {spdx} or {name}).
FORMS: tuple[tuple[float, str], ...] = (
    (1.0, r"(?:licensed|released|distributed|available|published|provided|covered|made available) (?:to you )?under (?:the terms of )?(?:the |a |an )?(?:{name})(?: license| licence)?(?: (?:international|unported|generic))?"),
    (1.0, r"spdx license identifier (?:{spdx})"),
    (0.95, r"subject to (?:the terms of )?(?:the )?(?:{name})(?: license| licence)?"),
    (0.9, r"under (?:the )?(?:terms of )?(?:the )?(?:{name})(?: license| licence)"),
    (0.85, r"licen[cs]e (?:{spdx}|{name})"),
    (0.8, r"(?:{name})(?: license| licence)(?: (?:international|unported|generic))?"),
    (0.5, r"(?:{name})"),
)
#: Before the first form, in which a license is denied; these rules come before all others.
DENIAL = r"(?:not|never|no longer|nor|neither|cannot be|isn t|aren t|wasn t) (?:yet |been |being |be |currently |itself )?"
#: Without one of these in a text, no rule can match (each rule's own keyword is one of them).
SHORT = {"mit", "x11", "isc", "ruby", "zlib", "openssl", "bsd-2-clause", "apache", "bsd"}  # a bare name of these says nothing of a license
BARE_TAG = {"mit-0", "python-2", "php-3"}  # nor does a bare SPDX name of these
VERSION = "(?: version| v)? "


@dataclass(frozen=True)
class Rule:
    label: str
    priority: int
    confidence: float
    keywords: frozenset[str]
    pattern: str
    denied: bool = False  # says that the license does not hold: it hides what lies in it and is not reported


def names(spdx: str, name: str) -> tuple[str, str]:
    """The names of a family as a pattern, and its SPDX names as they stand in prose: "v2" as one word too, "2" for "2 0"."""
    tags = re.sub(r"^([a-z]+) (\d)", r"(?:gnu )?\1(?: version | v ?| )\2", spdx)
    tags = re.sub(r"( \)\d) 0(?=$|\(\?: only)", r"\1(?: 0)?", tags)
    return name.replace(VERSION, "(?: version | v ?| )"), tags


@cache
def rules() -> tuple[Rule, ...]:
    """The ordered rules, written out from :data:`FAMILIES`, :data:`VERSIONLESS` and :data:`FORMS`; 300 and more."""
    out, last = [], len(FORMS) - 1
    for label, (spdx, name, keywords) in FAMILIES.items():
        name, tags = names(spdx, name)
        for k, (confidence, form) in enumerate(FORMS):
            if ("{spdx}" in form and not spdx) or (k == last and label in SHORT) or (not spdx and k < last):
                continue
            every = f"{tags}|{name}" if spdx and not (k == last and label in BARE_TAG) else name
            pattern = form.replace("{spdx}", spdx).replace("{name}", every)
            out.append(Rule(label, k, confidence if spdx else 0.6, frozenset(keywords.split("|")), pattern))
            if k == 0:
                out.append(Rule(label, -1, 1.0, frozenset(keywords.split("|")), DENIAL + pattern, denied=True))
    for label, (name, keywords) in VERSIONLESS.items():
        for k, (confidence, form) in enumerate(FORMS):
            if (k == last and label in SHORT) or "identifier" in form:
                continue
            pattern = form.replace("{spdx}|", "").replace("{name}", name)
            out.append(Rule(label, len(FORMS) + k, round(0.8 * confidence, 2), frozenset(keywords.split("|")), pattern))
            if k == 0:
                out.append(Rule(label, -1, 1.0, frozenset(keywords.split("|")), DENIAL + pattern, denied=True))
    return tuple(out)


def compiled() -> list[tuple[Rule, re.Pattern]]:
    return [(r, re.compile(rf"(?<= )(?:{r.pattern})(?= )")) for r in rules()]


def resolve(found: list[tuple[int, int, Rule]]) -> list[tuple[int, int, Rule]]:
    """What is left of overlapping detections (first word, end word, rule), by place.

    Of two of which one lies in the other, the one of better priority stays,
    at one priority the longer.  Only a detection at least twice as long, of
    another label, takes the place of better-ranked ones inside it: they are
    parts of its name.  A denial hides all in it and is left out at the end.
    """
    kept: list[tuple[int, int, Rule]] = []
    for a, b, r in sorted(found, key=lambda x: (x[2].priority, x[0] - x[1], x[0], x[2].label)):
        if any(x <= a and b <= y for x, y, _ in kept):
            continue
        inside = [k for k in kept if a <= k[0] and k[1] <= b]
        if all(k[2].label != r.label and not k[2].denied and b - a >= 2 * (k[1] - k[0]) for k in inside):
            kept = [k for k in kept if k not in inside] + [(a, b, r)]
    return sorted((k for k in kept if not k[2].denied), key=lambda x: (x[0], x[1]))


def scanner():
    """A function from text to (number of words, base places, detections)."""
    ordered = compiled()
    gate = frozenset(k for r, _ in ordered for k in r.keywords)
    base = [(p, re.compile(rf"(?<= ){p}(?= )"), label) for p, label in BASE.items()]

    def scan(text: str | None) -> tuple[int, list[tuple[int, str]], list[tuple[int, int, Rule]]]:
        tokens = WORDS.findall((text or "").translate(ASCII_LOWER))
        held = gate.intersection(tokens)
        if not held:
            return len(tokens), [], []
        line = f" {' '.join(tokens)} "
        starts = None

        def word_at(char: int) -> int:
            nonlocal starts
            if starts is None:
                starts, at = {}, 1
                for i, w in enumerate(tokens):
                    starts[at] = i
                    at += len(w) + 1
            return starts[char]

        places = [(word_at(m.start()), label) for p, x, label in base if p in line for m in x.finditer(line)]
        found = []
        for rule, x in ordered:
            if not held.isdisjoint(rule.keywords):
                for m in x.finditer(line):
                    a = word_at(m.start())
                    found.append((a, a + m[0].count(" ") + 1, rule))
        return len(tokens), sorted(places), resolve(found)

    return scan


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Licenses named in every whole text.

    One row per input row: ``id_col, n_words, n_base`` (places of base
    phrases), ``first_word, last_word`` (smallest and largest start of a base
    phrase, null without any), ``base_labels, labels`` (distinct, sorted,
    comma-joined; ``labels`` holds the rules' too), ``score`` (the best
    confidence, 0 without a detection) and ``detections`` (first word, end
    word, label, confidence of what overlap resolution left).  A null text
    counts as empty: no words, no labels, score 0.  Repeated rows and null
    ids give a row each; other columns of ``docs`` are not read.
    """

    def work(batches: Iterator[dict]) -> Iterator[dict]:
        scan = scanner()
        for b in batches:
            out: dict[str, list] = {k: [] for k in ("_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "detections")}
            out["_id"] = b["_id"]
            for text in b["_text"]:
                n, places, found = scan(text)
                base = {label for _, label in places}
                row = (n, len(places), places[0][0] if places else None, places[-1][0] if places else None, ",".join(sorted(base)), ",".join(sorted(base | {r.label for _, _, r in found})), max([1.0] * bool(places) + [r.confidence for _, _, r in found] + [0.0]), [{"first_word": a, "end_word": e, "label": r.label, "confidence": r.confidence} for a, e, r in found])
                for k, v in zip(list(out)[1:], row, strict=True):
                    out[k].append(v)
            yield out

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    out = map_batches(rows, work, f"_id {kind}, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double, detections array<struct<first_word:bigint,end_word:bigint,label:string,confidence:double>>")
    return out.withColumnRenamed("_id", id_col)
