"""Operator 6: license scans by an Aho-Corasick automaton and a shunting-yard parser of licence expressions."""

from __future__ import annotations

import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from tieline.llm.common import doc_texts, per_row

#: Phrases (in words) and labels that the base counts; fixed values.
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
#: Notices that the scan knows besides, with the weight of a hit.
NOTICES = {
    "the mit license": ("mit", 0.9),
    "permission is hereby granted free of charge": ("mit", 0.9),
    "licensed under the apache license": ("apache-2", 0.9),
    "cc by": ("cc-by", 0.6),
    "cc by sa": ("cc-by-sa", 0.9),
    "cc by nd": ("cc-by-nd", 0.9),
    "cc0 1 0": ("cc0", 0.9),
    "gnu general public license": ("gpl", 0.8),
    "gnu general public license version 2": ("gpl-2", 0.9),
    "gnu general public license version 3": ("gpl-3", 0.9),
    "gnu lesser general public license": ("lgpl", 0.9),
    "gnu affero general public license": ("agpl", 0.9),
    "mozilla public license": ("mpl", 0.8),
    "mozilla public license version 2": ("mpl-2", 0.9),
    "eclipse public license": ("epl", 0.8),
    "redistribution and use in source and binary forms": ("bsd", 0.9),
    "3 clause bsd license": ("bsd-3-clause", 0.9),
    "2 clause bsd license": ("bsd-2-clause", 0.9),
    "isc license": ("isc", 0.8),
    "this is free and unencumbered software released into the public domain": ("unlicense", 0.9),
    "all rights reserved": ("proprietary", 0.5),
}
TAG = "spdx license identifier"
PERMISSIVE = frozenset("mit apache-2 bsd bsd-2-clause bsd-3-clause isc unlicense cc0 cc-by 0bsd zlib".split())

#: Identifiers of the SPDX list that expressions may name, without version suffixes (-only, -or-later), and its exceptions; fixed values.
KNOWN = frozenset(
    """0BSD AAL AFL-1.1 AFL-1.2 AFL-2.0 AFL-2.1 AFL-3.0 AGPL-1.0 AGPL-3.0 Apache-1.0 Apache-1.1 Apache-2.0 APSL-1.0 APSL-2.0 Artistic-1.0 Artistic-2.0
    BlueOak-1.0.0 BSD-1-Clause BSD-2-Clause BSD-2-Clause-Patent BSD-3-Clause BSD-3-Clause-Clear BSD-4-Clause BSL-1.0 BUSL-1.1 CC-BY-1.0 CC-BY-2.0 CC-BY-2.5 CC-BY-3.0 CC-BY-4.0
    CC-BY-NC-1.0 CC-BY-NC-2.0 CC-BY-NC-2.5 CC-BY-NC-3.0 CC-BY-NC-4.0 CC-BY-NC-ND-1.0 CC-BY-NC-ND-2.0 CC-BY-NC-ND-2.5 CC-BY-NC-ND-3.0 CC-BY-NC-ND-4.0
    CC-BY-NC-SA-1.0 CC-BY-NC-SA-2.0 CC-BY-NC-SA-2.5 CC-BY-NC-SA-3.0 CC-BY-NC-SA-4.0 CC-BY-ND-1.0 CC-BY-ND-2.0 CC-BY-ND-2.5 CC-BY-ND-3.0 CC-BY-ND-4.0
    CC-BY-SA-1.0 CC-BY-SA-2.0 CC-BY-SA-2.5 CC-BY-SA-3.0 CC-BY-SA-4.0 CC0-1.0 CDDL-1.0 CDDL-1.1 CECILL-2.1 CECILL-B CECILL-C CPL-1.0 ECL-2.0 EFL-2.0 EPL-1.0 EPL-2.0
    EUPL-1.1 EUPL-1.2 GFDL-1.1 GFDL-1.2 GFDL-1.3 GPL-1.0 GPL-2.0 GPL-3.0 HPND ICU IJG IPL-1.0 ISC JSON LGPL-2.0 LGPL-2.1 LGPL-3.0 LPL-1.02 LPPL-1.3c MIT MIT-0 MPL-1.0 MPL-1.1
    MPL-2.0 MPL-2.0-no-copyleft-exception MS-PL MS-RL MulanPSL-2.0 NCSA ODbL-1.0 OFL-1.1 OpenSSL OSL-2.1 OSL-3.0 PHP-3.01 PostgreSQL PSF-2.0 Python-2.0 QPL-1.0 Ruby SSPL-1.0
    Unicode-3.0 Unicode-DFS-2016 Unlicense UPL-1.0 Vim W3C WTFPL X11 Zlib ZPL-2.1""".lower().split()
)
EXCEPTIONS = frozenset(
    """389-exception Autoconf-exception-2.0 Autoconf-exception-3.0 Bison-exception-2.2 Bootloader-exception Classpath-exception-2.0 eCos-exception-2.0 Font-exception-2.0
    GCC-exception-2.0 GCC-exception-3.1 GPL-3.0-linking-exception GPL-CC-1.0 LGPL-3.0-linking-exception Libtool-exception Linux-syscall-note LLVM-exception
    OCaml-LGPL-linking-exception OpenJDK-assembly-exception-1.0 Qt-GPL-exception-1.0 Qt-LGPL-exception-1.1 u-boot-exception-2.0 Universal-FOSS-exception-1.0 WxWindows-exception-3.1""".lower().split()
)
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
_TOKEN = re.compile(r"\(|\)|[A-Za-z0-9][A-Za-z0-9.+\-]*(?::[A-Za-z0-9.+\-]+)?")
_AFTER_TAG = re.compile(r"spdx[^0-9a-z]*license[^0-9a-z]*identifier[^\S\n]*:?([^\n]*)", re.IGNORECASE)
_STRENGTH = {"or": 1, "and": 2, "with": 3}


def licence_id(name: str) -> str:
    """Identifier in the scan's spelling: lower case, no ``-only``/``-or-later``/``+``, trailing zero versions dropped."""
    name = re.sub(r"(-only|-or-later|\+)$", "", name.lower())
    name = re.sub(r"(?<=\d)(\.0)+$", "", name)
    return re.sub(r"^(cc-by(?:-nc)?(?:-sa|-nd)?)-\d.*$", r"\1", name)


def is_known(name: str, exception: bool = False) -> bool:
    """Whether ``name`` is an identifier that an expression may hold: one of the list, or a reference of the document's own."""
    name = name.lower()
    if exception:
        return name in EXCEPTIONS
    return re.sub(r"(-only|-or-later|\+)$", "", name) in KNOWN or re.fullmatch(r"(documentref-[^:]+:)?licenseref-.+", name) is not None


def parse_expression(text: str) -> list[str] | None:
    """Postfix form of the licence expression that ``text`` starts with, or None if none is well formed.

    An operand that is no known identifier, or behind ``with`` no known exception, makes the expression ill formed.  ``with`` binds closer than ``and``, that closer than ``or``.  Words after a complete expression are prose and end it.
    """
    out: list[str] = []
    held: list[str] = []
    operand_next = True
    for token in _TOKEN.findall(text):
        word = token.lower()
        if token == "(":
            if not operand_next:
                break
            held.append(token)
        elif token == ")":
            if operand_next or "(" not in held:
                break
            while held[-1] != "(":
                out.append(held.pop())
            held.pop()
        elif word in _STRENGTH:
            if operand_next:
                return None
            while held and held[-1] != "(" and _STRENGTH[held[-1]] >= _STRENGTH[word]:
                out.append(held.pop())
            held.append(word)
            operand_next = True
        else:
            if not operand_next:
                break
            if not is_known(token, exception=bool(held) and held[-1] == "with"):
                return None
            out.append("=" + token)
            operand_next = False
    if operand_next or "(" in held:
        return None
    return out + held[::-1]


def evaluate(postfix: list[str]) -> tuple[set[str], bool]:
    """Licences named, and whether the expression can be met by permissive ones alone."""
    stack: list[tuple[set[str], bool]] = []
    for item in postfix:
        if item[0] == "=":
            one = licence_id(item[1:])
            stack.append(({one}, one in PERMISSIVE))
            continue
        right, left = stack.pop(), stack.pop()
        if item == "with":  # the exception is no licence
            stack.append(left)
        else:
            stack.append((left[0] | right[0], left[1] or right[1] if item == "or" else left[1] and right[1]))
    return stack[0]


@lru_cache(maxsize=1)
def _automaton():
    import ahocorasick

    a = ahocorasick.Automaton()
    entries: dict[str, list] = {p: [label, None, 0.9] for p, label in BASE.items()}
    for phrase, (label, weight) in NOTICES.items():
        entries.setdefault(phrase, [None, label, weight])
    entries[TAG] = ["", None, 0.0]
    for phrase, (base, own, weight) in entries.items():
        a.add_word(f" {phrase} ", (phrase, base, own, weight))
    a.make_automaton()
    return a


def scan(text: str) -> dict:
    """Hits of one text; ``places`` are the word positions of base phrases."""
    words = text.encode().translate(_FOLD).split()
    line = f" {b' '.join(words).decode()} "
    places, base, hits, score, tagged = [], set(), [], 0.0, False
    blanks, counted = 0, 0
    for end, (phrase, base_label, own, weight) in _automaton().iter(line):
        if base_label:
            blanks += line.count(" ", counted, end + 1)  # hits come in order of their ends
            counted = end + 1
            places.append(blanks - 1 - len(phrase.split()))
            base.add(base_label)
            hits.append((end - len(phrase) - 1, -end, None, weight))
        elif phrase == TAG:
            tagged = True
        else:
            hits.append((end - len(phrase) - 1, -end, own, weight))
    labels, reach = set(), -1
    for _, end, own, weight in sorted(hits, key=lambda h: h[:2]):
        if -end <= reach:  # inside a longer hit
            continue
        reach = -end
        if own:
            labels.add(own)
        score = max(score, weight)
    permissive = base | labels <= PERMISSIVE
    if tagged:
        for m in _AFTER_TAG.finditer(text):
            postfix = parse_expression(m[1])
            if postfix:
                named, free = evaluate(postfix)
                labels |= named
                permissive = permissive and free
                score = 1.0
            else:
                score = max(score, 0.4)  # a tag without an expression
    found = base | labels
    return {
        "n_words": len(words),
        "n_base": len(places),
        "first_word": min(places, default=None),
        "last_word": max(places, default=None),
        "base_labels": ",".join(sorted(base)),
        "labels": ",".join(sorted(found)),
        "score": score,
        "permissive": bool(found) and permissive,
    }


SCHEMA = "doc_id bigint, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double, permissive boolean"


def scan_licenses(docs: DataFrame) -> DataFrame:
    """One row a document: base hits, all labels, a confidence and whether permissive licences suffice.

    The score is 1 for a well-formed tagged expression of known identifiers, 0.5 to 0.9 for notices, 0.4 for a tag alone, 0
    for nothing.  A notice inside a longer one gives no label; base hits all count.  Null texts count as empty, texts of any
    length are scanned whole, repeated rows are alike, further columns go no further, an empty table gives no rows.
    """
    names = [c.strip().split()[0] for c in SCHEMA.split(",")]
    kinds = [pa.int64()] * 5 + [pa.string()] * 2 + [pa.float64(), pa.bool_()]

    def start():
        def work(ids, texts):
            hits = [scan(t) for t in texts]
            return [pa.array(ids, pa.int64()), *(pa.array([h[n] for h in hits], k) for n, k in zip(names[1:], kinds[1:], strict=True))]

        return work

    return per_row(doc_texts(docs), start, SCHEMA, names)
