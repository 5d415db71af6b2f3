"""License scan by ordered signature rules.

A text is folded to words: ASCII letters in lower case, digits and everything beyond ASCII; all else separates. Rules are
regexes over the words joined by single spaces. Each has keywords, words that stand in every text its regex can match, so most
texts meet no regex at all. Sentences come before notices ("licensed under the ..."), these before tags ("SPDX-License-Identifier: ...",
"license: ..."; every name of an expression with OR, AND and brackets is a tag), these before identifiers (Apache-2.0, GPLv3, LGPL-2.1-only,
GPL-2.0-or-later, GPL-2.0+) and bare names. Where detections overlap, one whose words lie within those of another of higher or equal priority goes. Base
phrases are found apart from the rules and always stay.

Cases: a null text counts as empty, has no words and score 0; rows that repeat get equal results; null identifiers are kept;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import _base as B
from tessera.llm import tokens

#: Phrases and labels of the base.
BASE = [(b"gnu general public license", "gpl"), (b"apache license", "apache"), (b"cc by", "cc-by"), (b"mit license", "mit")]

#: label | name, as it follows "licensed under the" or stands before "license". Written over folded words.
NAMES = r"""
gpl-1.0 | gnu general public licen[sc]e (version|v) ?1( 0)?
gpl-2.0 | gnu general public licen[sc]e (version|v) ?2( 0)?
gpl-3.0 | gnu general public licen[sc]e (version|v) ?3( 0)?
gpl-2.0 | gnu gpl (version |v ?)2( 0)?
gpl-3.0 | gnu gpl (version |v ?)3( 0)?
gpl-2.0 | gpl ?v ?2( 0)?
gpl-3.0 | gpl ?v ?3( 0)?
gpl | gnu gpl
lgpl-2.0 | gnu library general public licen[sc]e( (version|v) ?2( 0)?)?
lgpl-2.1 | gnu lesser general public licen[sc]e (version|v) ?2 1
lgpl-3.0 | gnu lesser general public licen[sc]e (version|v) ?3( 0)?
lgpl-2.1 | lgpl ?v ?2 1
lgpl-3.0 | lgpl ?v ?3( 0)?
lgpl | gnu lesser general public licen[sc]e
lgpl | gnu lgpl
agpl-3.0 | gnu affero general public licen[sc]e( (version|v) ?3( 0)?)?
agpl-3.0 | agpl ?v ?3( 0)?
agpl | gnu agpl
agpl-1.0 | affero general public licen[sc]e (version|v) ?1( 0)?
gfdl-1.1 | gnu free documentation licen[sc]e (version|v) ?1 1
gfdl-1.2 | gnu free documentation licen[sc]e (version|v) ?1 2
gfdl-1.3 | gnu free documentation licen[sc]e (version|v) ?1 3
gfdl | gnu free documentation licen[sc]e
apache-1.0 | apache (software )?licen[sc]e (version |v ?)?1 0
apache-1.1 | apache (software )?licen[sc]e (version |v ?)?1 1
apache-2.0 | apache (software )?licen[sc]e (version |v ?)?2( 0)?
apache-2.0 | asl ?v? ?2( 0)?
mit | (the )?mit x11 licen[sc]e
mit | expat licen[sc]e
mit-0 | mit no attribution( licen[sc]e)?
mit-modern | mit modern variant
x11 | x11 licen[sc]e
bsd-1-clause | (1|one) clause bsd( licen[sc]e)?
bsd-2-clause | (2|two) clause bsd( licen[sc]e)?
bsd-2-clause | simplified bsd licen[sc]e
bsd-2-clause | freebsd licen[sc]e
bsd-3-clause | (3|three) clause bsd( licen[sc]e)?
bsd-3-clause | (new|revised|modified) bsd licen[sc]e
bsd-4-clause | (4|four) clause bsd( licen[sc]e)?
bsd-4-clause | original bsd licen[sc]e
bsd-2-clause | bsd 2 clause( licen[sc]e)?
bsd-3-clause | bsd 3 clause( licen[sc]e)?
bsd-4-clause | bsd 4 clause( licen[sc]e)?
0bsd | (zero clause bsd|bsd zero clause|0bsd)( licen[sc]e)?
bsd | bsd style licen[sc]e
bsd-3-clause-clear | (clear bsd|bsd 3 clause clear) licen[sc]e
bsd-protection | bsd protection licen[sc]e
mpl-1.0 | mozilla public licen[sc]e (version |v ?)?1 0
mpl-1.1 | mozilla public licen[sc]e (version |v ?)?1 1
mpl-2.0 | mozilla public licen[sc]e (version |v ?)?2( 0)?
mpl | mozilla public licen[sc]e
mpl-2.0 | mpl ?v? ?2 0
npl-1.0 | netscape public licen[sc]e( (version|v) ?1 0)?
npl-1.1 | netscape public licen[sc]e (version|v) ?1 1
epl-1.0 | eclipse public licen[sc]e (version |v ?)?1( 0)?
epl-2.0 | eclipse public licen[sc]e (version |v ?)?2( 0)?
epl | eclipse public licen[sc]e
edl-1.0 | eclipse distribution licen[sc]e( (version|v) ?1 0)?
cpl-1.0 | common public licen[sc]e( (version|v) ?1( 0)?)?
cddl-1.0 | common development and distribution licen[sc]e( (version|v) ?1( 0)?)?
cddl-1.1 | common development and distribution licen[sc]e (version|v) ?1 1
cpal-1.0 | common public attribution licen[sc]e( (version|v) ?1 0)?
eupl-1.1 | european union public licen[sc]e (version|v) ?1 1
eupl-1.2 | european union public licen[sc]e (version|v) ?1 2
eupl | european union public licen[sc]e
cecill-2.1 | cecill (licen[sc]e )?(version |v ?)2 1
cecill-b | cecill b( licen[sc]e)?
cecill-c | cecill c( licen[sc]e)?
cecill | cecill licen[sc]e
isc | (the )?isc licen[sc]e
artistic-1.0 | artistic licen[sc]e (version |v ?)?1 0
artistic-2.0 | artistic licen[sc]e (version |v ?)?2( 0)?
artistic | artistic licen[sc]e
perl | same terms as perl( itself)?
zlib | zlib libpng licen[sc]e
zlib | zlib licen[sc]e
libpng | libpng licen[sc]e
bsl-1.0 | boost software licen[sc]e( (version|v) ?1 0)?
unlicense | the unlicen[sc]e
wtfpl | do what the f\w* you want to public licen[sc]e
wtfpl | wtfpl
beerware | beer ?ware licen[sc]e
postgresql | postgresql licen[sc]e
python-2.0 | python software foundation licen[sc]e( (version|v) ?2)?
psf | psf licen[sc]e
cnri-python | cnri (open source )?(python )?licen[sc]e
ruby | ruby licen[sc]e
php-3.0 | php licen[sc]e (version |v ?)?3 0
php-3.01 | php licen[sc]e (version |v ?)?3 01
php | php licen[sc]e
ofl-1.0 | sil open font licen[sc]e (version |v ?)?1 0
ofl-1.1 | sil open font licen[sc]e( (version |v ?)?1 1)?
ubuntu-font | ubuntu font licen[sc]e
bitstream-vera | bitstream vera licen[sc]e
ms-pl | microsoft public licen[sc]e
ms-rl | microsoft reciprocal licen[sc]e
ms-lpl | microsoft limited public licen[sc]e
apsl-1.0 | apple public source licen[sc]e (version |v ?)?1( 0)?
apsl-2.0 | apple public source licen[sc]e (version |v ?)?2( 0)?
apsl | apple public source licen[sc]e
ibm-pl-1.0 | ibm public licen[sc]e( (version|v) ?1 0)?
lpl-1.02 | lucent public licen[sc]e( (version|v) ?1 02)?
sunpl-1.0 | sun public licen[sc]e( (version|v) ?1 0)?
sissl | sun industry standards source licen[sc]e
bcl | (sun|oracle) binary code licen[sc]e
upl-1.0 | universal permissive licen[sc]e( (version|v) ?1 0)?
intel-acpi | intel acpi licen[sc]e
nposl-3.0 | non profit open software licen[sc]e( (version )?3 0)?
osl-1.0 | open software licen[sc]e (version |v ?)?1 0
osl-2.0 | open software licen[sc]e (version |v ?)?2 0
osl-2.1 | open software licen[sc]e (version |v ?)?2 1
osl-3.0 | open software licen[sc]e (version |v ?)?3 0
afl-2.1 | academic free licen[sc]e (version |v ?)?2 1
afl-3.0 | academic free licen[sc]e (version |v ?)?3 0
afl | academic free licen[sc]e
ecl-1.0 | educational community licen[sc]e (version |v ?)?1 0
ecl-2.0 | educational community licen[sc]e (version |v ?)?2 0
efl-2.0 | eiffel forum licen[sc]e( (version |v ?)?2)?
fair | fair licen[sc]e
entessa | entessa public licen[sc]e
frameworx-1.0 | frameworx (open )?licen[sc]e
hpnd | historical permission notice and disclaimer
icu | icu licen[sc]e
ijg | independent jpeg group( s)? licen[sc]e
imagemagick | imagemagick licen[sc]e
jasper | jasper licen[sc]e
json | the json licen[sc]e
ldap | openldap public licen[sc]e( (version |v ?)?2 8)?
lppl-1.3c | latex project public licen[sc]e( (version |v ?)?1 3c?)?
miros | miros licen[sc]e
motosoto | motosoto open source licen[sc]e
multics | multics licen[sc]e
nasa-1.3 | nasa open source agreement( (version )?1 3)?
naumen | naumen public licen[sc]e
ncsa | (university of illinois )?ncsa open source licen[sc]e
ngpl | nethack general public licen[sc]e
nokia | nokia open source licen[sc]e
ntp | ntp licen[sc]e
oclc-2.0 | oclc research public licen[sc]e
ogtsl | open group test suite licen[sc]e
openssl | openssl licen[sc]e
ssleay | ssleay licen[sc]e
osldap | open ldap licen[sc]e
qpl-1.0 | q public licen[sc]e( (version )?1 0)?
rpl-1.1 | reciprocal public licen[sc]e (version )?1 1
rpl-1.5 | reciprocal public licen[sc]e (version )?1 5
rpsl-1.0 | realnetworks public source licen[sc]e
rscpl | ricoh source code public licen[sc]e
simpl-2.0 | simple public licen[sc]e( (version )?2 0)?
sleepycat | sleepycat licen[sc]e
sgi-b-2.0 | sgi free software licen[sc]e b( (version )?2 0)?
spl | scilab licen[sc]e
tcl | tcl tk licen[sc]e
tcp-wrappers | tcp wrappers licen[sc]e
unicode | unicode licen[sc]e( agreement)?
vim | vim licen[sc]e
vsl-1.0 | vovida software licen[sc]e( (version )?1 0)?
w3c | w3c (software )?(notice and )?licen[sc]e
watcom | sybase open watcom public licen[sc]e
xnet | x net licen[sc]e
zpl-2.0 | zope public licen[sc]e (version |v ?)?2 0
zpl-2.1 | zope public licen[sc]e (version |v ?)?2 1
zpl | zope public licen[sc]e
mulan-1.0 | mulan psl ?v?1
mulan-2.0 | mulan (permissive software licen[sc]e|psl) ?v?2
blueoak-1.0 | blue oak model licen[sc]e( 1 0( 0)?)?
parity-7.0 | parity public licen[sc]e
polyform-nc | polyform noncommercial licen[sc]e
polyform-sb | polyform small business licen[sc]e
sspl-1.0 | server side public licen[sc]e
elastic-2.0 | elastic licen[sc]e( (version |v ?)?2( 0)?)?
busl-1.1 | business source licen[sc]e( (version )?1 1)?
commons-clause | commons clause( licen[sc]e condition)?
confluent | confluent community licen[sc]e
rail-m | (bigscience )?(open )?rail m? ?licen[sc]e
llama | llama ?[23]? community licen[sc]e( agreement)?
odbl-1.0 | open (data commons open )?database licen[sc]e( (version |v ?)?1 0)?
odc-by-1.0 | open data commons attribution licen[sc]e
pddl-1.0 | public domain dedication and licen[sc]e
ogl-uk-3.0 | open government licen[sc]e( (version |v ?)?3 0)?
etalab-2.0 | licence ouverte( open licen[sc]e)?( (version )?2 0)?
cdla-permissive | community data licen[sc]e agreement permissive
cdla-sharing | community data licen[sc]e agreement sharing
cc0-1.0 | cc0( 1 0)?( universal)?
cc-by-nc-nd | creative commons attribution non ?commercial no ?deriv(ative)?s( works)?
cc-by-nc-sa | creative commons attribution non ?commercial share ?alike
cc-by-nc | creative commons attribution non ?commercial
cc-by-nd | creative commons attribution no ?deriv(ative)?s( works)?
cc-by-sa | creative commons attribution share ?alike
cc-by | creative commons attribution
cc-by-nc-nd | cc by nc nd( [1-4] [05])?
cc-by-nc-sa | cc by nc sa( [1-4] [05])?
cc-by-nc | cc by nc( [1-4] [05])?
cc-by-nd | cc by nd( [1-4] [05])?
cc-by-sa | cc by sa( [1-4] [05])?
public-domain | (released|placed|dedicated) (into|to) the public domain
public-domain | this (work|file|software|code) is in the public domain
"""

#: label | keywords | sentence of a license text or notice.
SENTENCES = r"""
mit | permission granted charge | permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files
mit | permission notice included | the above copyright notice and this permission notice shall be included in all copies or substantial portions
isc | permission modify distribute | permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted
0bsd | permission modify distribute | permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted (?!provided)
bsd | redistribution source binary | redistribution and use in source and binary forms with or without modification are permitted
bsd-2-clause | redistributions reproduce | redistributions in binary form must reproduce the above copyright notice this list of conditions
bsd-3-clause | endorse promote products | neither the name of .{1,80}? nor the names of its contributors may be used to endorse or promote products
bsd-4-clause | advertising materials acknowledgement | all advertising materials mentioning features or use of this software must display the following acknowledgement
apache-2.0 | licensed apache compliance | licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license
apache-2.0 | asis distributed warranties | unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis
gpl | redistribute modify gnu | free software you can redistribute it and or modify it under the terms of the gnu general public license
gpl-2.0-or-later | either version 2 | either version 2 of the license or at your option any later version
gpl-3.0-or-later | either version 3 | either version 3 of the license or at your option any later version
gpl | merchantability gnu details | without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details
gpl-2.0 | terms conditions copying | terms and conditions for copying distribution and modification
lgpl | redistribute lesser gnu | free software you can redistribute it and or modify it under the terms of the gnu lesser general public license
agpl | redistribute affero gnu | free software you can redistribute it and or modify it under the terms of the gnu affero general public license
mpl-2.0 | source form subject mozilla | this source code form is subject to the terms of the mozilla public license
epl | accompanying materials eclipse | this program and the accompanying materials are made available under the terms of the eclipse public license
unlicense | unencumbered domain | this is free and unencumbered software released into the public domain
zlib | acknowledgment appreciated product | an acknowledgment in the product documentation would be appreciated but is not required
zlib | altered source plainly | altered source versions must be plainly marked as such
bsl-1.0 | boost permission obtaining | permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license
wtfpl | everyone permitted verbatim | everyone is permitted to copy and distribute verbatim or modified copies of this license document
beerware | buy beer return | you can buy me a beer in return
json | software used good evil | the software shall be used for good not evil
cc-by-sa | licensed creative share | this work is licensed under a creative commons attribution share ?alike .{0,20}?license
cc-by | licensed creative attribution | this work is licensed under a creative commons attribution .{0,20}?license
cc0-1.0 | waived copyright related | has waived all copyright and related or neighboring rights
proprietary | rights reserved | all rights reserved
proprietary | confidential proprietary | (proprietary and confidential|confidential and proprietary)
proprietary | unauthorized copying prohibited | unauthorized copying of this file via any medium is strictly prohibited
"""


#: Licenses that say "or any later version": each has a label of its own for that.
LATER = {x: f"{x}-or-later" for x in ("gpl-1.0", "gpl-2.0", "gpl-3.0", "lgpl-2.0", "lgpl-2.1", "lgpl-3.0", "agpl-1.0", "agpl-3.0", "gfdl-1.1", "gfdl-1.2", "gfdl-1.3")}
#: Labels without version that are licenses' tags only where a text speaks of a license.
CONTEXT = r"(?:spdx licen[sc]e identifier|licen[sc]es?(?: expression| type| id| is)?|licen[sc]ed under(?: the)?)"
_SPOKEN = frozenset(x.encode() for x in ("spdx", "license", "licence", "licenses", "licences", "licensed", "licenced"))

#: Stands for whatever a pattern leaves open.
WILD = "\0"


class Rule:
    """priority: the higher wins; gate: words that must all be there; some: words of which one must be there, unless empty."""

    __slots__ = ("label", "priority", "weight", "gate", "some", "pattern")

    def __init__(self, label: str, priority: int, weight: float, gate: frozenset, some: frozenset, pattern: str):
        self.label, self.priority, self.weight, self.gate, self.some = label, priority, weight, gate, some
        self.pattern = re.compile(rb"(?<= )(?:" + pattern.encode() + rb")(?= )")


def variants(pattern: str) -> list[str]:
    r"""All texts that the pattern matches, with WILD where it leaves open what stands there. Groups, alternatives, classes, '?', '\w*' and '.{a,b}?'."""

    def either(at: int) -> tuple[list[str], int]:
        found: list[str] = []
        while True:
            some, at = row(at)
            found += some
            if at == len(pattern) or pattern[at] == ")":
                return found, at + 1
            at += 1

    def row(at: int) -> tuple[list[str], int]:
        out = [""]
        while at < len(pattern) and pattern[at] not in "|)":
            if wild := re.compile(r"\\w\*|\.\{\d+,\d+\}\?").match(pattern, at):
                item, at = [WILD], wild.end()
            elif pattern.startswith("(?!", at):
                item, at = [""], pattern.index(")", at) + 1
            elif pattern[at] == "(":
                item, at = either(at + 1)
            elif pattern[at] == "[":
                end = pattern.index("]", at)
                item, at = [chr(c) for c in range(128) if re.match(pattern[at : end + 1], chr(c))], end + 1
            else:
                item, at = [pattern[at]], at + 1
            if at < len(pattern) and pattern[at] == "?":
                item, at = [*item, ""], at + 1
            out = [x + y for x in out for y in item]
        return out, at

    return either(0)[0]


def _gate(pattern: str) -> tuple[frozenset, frozenset]:
    """Words that every match of the pattern holds, and, where there are none, words of which every match holds one."""
    held = [frozenset(w.encode() for w in v.split() if WILD not in w) for v in variants(pattern)]
    every = frozenset.intersection(*held)
    return every, frozenset() if every else frozenset(max(h, key=lambda w: (len(w), w)) for h in held)


def identifier(label: str) -> str | None:
    """How a versioned label is written in short, over folded words: apache 2 0, apache v2, apachev2; None for other labels."""
    if not (m := re.fullmatch(r"(.+)-(\d+)(?:\.(\d+[a-z]?))?", label)):
        return None
    name, major, minor = re.sub(r"[^a-z0-9]+", " ", m[1]), m[2], m[3]
    rest = "" if minor is None else "( 0)?" if minor == "0" else f" {minor}"
    return f"{name} {major}" + (f" {minor}" if minor else "") + f"|{name} ?v ?{major}{rest}"


def rules() -> list[Rule]:
    """In order: sentences of texts and notices, notices that name a license, identifiers, bare names. Tags are found apart, see TAG."""
    out = []
    for line in filter(None, SENTENCES.strip().split("\n")):
        label, words, pattern = line.split(" | ")
        gate = frozenset(w.encode() for w in words.split()) & _gate(pattern)[0]
        out.append(Rule(label, 40, 1.0, gate, frozenset(), pattern))
    named = [(*line.split(" | "), *_gate(line.split(" | ")[1])) for line in filter(None, NAMES.strip().split("\n"))]
    notice = "(licen[sc]ed|released|distributed|available|provided|published) under (the )?(terms of the )?"
    for label, pattern, gate, some in named:
        out.append(Rule(label, 30, 0.9, gate | {b"under"}, some, rf"{notice}({pattern})"))
    short = {label: identifier(label) for label in dict.fromkeys(x[0] for x in named)}
    for label, pattern in short.items():
        if pattern:
            if label in LATER:
                whole = "|".join(p for x, p, *_ in named if x == label) + "|" + pattern
                later = rf"({whole}) or (at your option )?(any )?later( version)?"
                out.append(Rule(LATER[label], 32, 0.9, *_gate(later), later))
            out.append(Rule(label, 15, 0.8, *_gate(pattern), rf"({pattern})( only)?"))
    for label, pattern, gate, some in named:
        out.append(Rule(label, 10, 0.7, gate, some, pattern))
    return out


def tags() -> tuple[list[str], str]:
    """Labels, and a pattern of all tags whose k-th group is the k-th label's: the longer first."""
    labels = dict.fromkeys(line.split(" | ")[0] for line in NAMES.strip().split("\n"))
    forms = [(LATER[x], f"(?:{identifier(x)}) or later") for x in LATER]
    forms += sorted(((x, f"(?:{p})(?: only)?" if (p := identifier(x)) else re.sub(r"[^a-z0-9]+", " ", x)) for x in labels), key=lambda f: -len(f[1]))
    forms = [(x, f + r"(?! licen[sc]e )" if x == "mit" else f) for x, f in forms]  # a base phrase, which is found apart
    return [x for x, _ in forms], "|".join(f"({p.replace('( 0)?', '(?: 0)?')})" for _, p in forms)


RULES = rules()
TAGGED, _TAG = tags()
TAG = re.compile(rb" (?:" + _TAG.encode() + rb")(?= )")
#: Where a text speaks of a license, before tags.
SPOKEN = re.compile(rb"(?<= )" + CONTEXT.encode() + rb"(?= )")
TAG_PRIORITY, TAG_WEIGHT = 20, 0.95


def tagged(joined: bytes) -> list[tuple[int, int, str]]:
    """(start, end, label) of every tag that follows words for a license, or a tag that does and a joining word."""
    found = []
    for m in SPOKEN.finditer(joined):
        at = m.end()
        while t := TAG.match(joined, at):
            found.append((t.start() + 1, t.end(), TAGGED[t.lastindex - 1]))
            at = t.end()
            if join := _JOIN.match(joined, at):
                at = join.end()
    return found


_JOIN = re.compile(rb" (?:or|and|with)(?= )")
_FOLD = bytes(32 if c < 48 or 57 < c < 65 or 90 < c < 97 or 122 < c < 128 else c + 32 if 65 <= c <= 90 else c for c in range(256))
_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
_ANY = _SPOKEN.union(*(r.gate | r.some for r in RULES))


def fold(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_FOLD).split()


def spaces_of(joined: bytes) -> np.ndarray:
    """Where the spaces of joined are: word k stands after space k. joined: words between single spaces, and one at both ends."""
    return np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)


def base_places(joined: bytes, spaces: np.ndarray) -> list[tuple[int, str]]:
    """(word, label) of each place where a base phrase's words stand one after another."""
    found = []
    for phrase, label in BASE:
        needle, at = b" " + phrase + b" ", -1
        while (at := joined.find(needle, at + 1)) >= 0:
            found.append((int(np.searchsorted(spaces, at)), label))
    return found


def outermost(found: list[tuple]) -> list[tuple]:
    """found (first word, word after the last, label, priority, weight, rule) without those whose words lie within those of one of higher
    priority, or of equal priority and longer or, if as long, of an earlier rule. One sweep by first word for each priority."""
    kept: list[tuple] = []
    for priority in sorted({d[3] for d in found}, reverse=True):
        kept.sort(key=lambda d: d[0])
        starts, reach, far, new = [d[0] for d in kept], list(accumulate((d[1] for d in kept), max)), -1, []
        for d in sorted((d for d in found if d[3] == priority), key=lambda d: (d[0], -d[1], d[5])):
            k = bisect_right(starts, d[0])
            if d[1] > max(far, reach[k - 1] if k else -1):
                far = d[1]
                new.append(d)
        kept += new
    return kept


def plus_words(text: str) -> set[int]:
    """Which words a + follows at once, as in GPL-2.0+."""
    raw = text.encode("utf-8", "surrogatepass")
    return {k for k, m in enumerate(_WORD.finditer(raw)) if raw[m.end() : m.end() + 1] == b"+"}


def detections(words: list[bytes], joined: bytes, spaces: np.ndarray, text: str = "") -> list[tuple[int, int, str, int, float]]:
    """(first word, word after the last, label, priority, weight) of the rules, without those that lie within one of higher or equal priority."""
    there = _ANY.intersection(words)
    found = []
    if there:
        for k, r in enumerate(RULES):
            if r.gate <= there and (not r.some or not r.some.isdisjoint(there)):
                for m in r.pattern.finditer(joined):
                    a, b = np.searchsorted(spaces, m.span()).tolist()
                    found.append((a - 1, b, r.label, r.priority, r.weight, k))
        if not _SPOKEN.isdisjoint(there):
            for start, end, label in tagged(joined):
                a, b = np.searchsorted(spaces, (start, end)).tolist()
                found.append((a - 1, b, label, TAG_PRIORITY, TAG_WEIGHT, len(RULES)))
    found = [d[:5] for d in outermost(found)]
    if "+" in text and any(d[2] in LATER for d in found):
        plus = plus_words(text)
        found = [(*d[:2], LATER.get(d[2], d[2]) if d[1] - 1 in plus else d[2], *d[3:]) for d in found]
    return sorted(found)


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document, without a shuffle: id_col, n_words, n_base, first_word, last_word, base_labels, labels, score and findings,
    array<struct<first_word, end_word, label, priority>> of the rules. score: the greatest weight among detections, 0.6 for a base phrase alone."""
    inner = pa.struct([("first_word", pa.int64()), ("end_word", pa.int64()), ("label", pa.string()), ("priority", pa.int32())])

    def run(batches):
        for batch in batches:
            for a, b in tokens.slices(batch.column("text")):
                out = []
                for text in batch.column("text").slice(a, b - a).to_pylist():
                    words = fold(text)
                    joined = b" " + b" ".join(words) + b" "
                    spaces = spaces_of(joined)
                    base, found = base_places(joined, spaces), detections(words, joined, spaces, text)
                    own = {label for _, label in base}
                    at = [w for w, _ in base]
                    out.append(
                        (
                            len(words), len(base), min(at, default=None), max(at, default=None), ",".join(sorted(own)), ",".join(sorted(own | {d[2] for d in found})),
                            max([0.6 * bool(base), *(d[4] for d in found)]), [dict(zip(("first_word", "end_word", "label", "priority"), d)) for d in found],
                        )
                    )
                c = list(zip(*out))
                kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), pa.list_(inner)]
                yield pa.RecordBatch.from_arrays([batch.column("id").slice(a, b - a), *(pa.array(x, k) for x, k in zip(c, kinds))], ["id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "findings"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), B.text_of(text_col).alias("text"))
    return rows.mapInArrow(
        run, "id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, findings array<struct<first_word:long,end_word:long,label:string,priority:int>>"
    ).withColumnRenamed("id", id_col)
