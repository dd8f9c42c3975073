"""Licence scan: Aho-Corasick over words, and a shunting-yard parser of licence expressions.

A text is lower-cased (A-Z) and cut into words; one automaton finds every notice phrase and
identifier tag on word boundaries in a single pass. After a tag, the rest of its line is parsed as an
expression of licence identifiers with `or`, `and`, `with` (weakest to strongest) and brackets, and
evaluated: `and` takes the least permissive side, `or` the most permissive, `with` eases a
licence by its exception. An identifier of no known family is a licence of which nothing is known:
it gets no label (after an SPDX tag: its own) and counts as restrictive (0.2). What a text states in
several places holds together, as `and` does.

A tag is a phrase of TAGS, written with blanks or hyphens, that a colon or an equals sign follows on the
same line; the hit of the automaton is where its expression starts. Reading a text takes time in
proportion to its length: words are counted once, and notices within longer ones are found by a sweep.

Defined results: a null text is empty: no words, no labels, score 0; a broken expression still
yields its known identifiers; an expression without any known identifier says nothing unless an SPDX tag
stands before it; repeated rows and ties get equal results; very long texts are read whole; an empty table
gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from . import common, textkit

#: fixed values: the base phrases and their labels
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
#: phrases of the method: notices in words
NOTICES = {
    "mit license": "mit", "apache license": "apache", "gnu general public license": "gpl", "gnu general public license version 2": "gpl-2",
    "gnu general public license version 3": "gpl-3", "gnu lesser general public license": "lgpl", "gnu affero general public license": "agpl",
    "mozilla public license": "mpl", "bsd license": "bsd", "bsd 2 clause": "bsd", "bsd 3 clause": "bsd", "isc license": "isc",
    "boost software license": "bsl-1", "creative commons attribution": "cc-by", "cc by sa": "cc-by-sa", "cc by nd": "cc-by-nd", "cc0": "cc0",
    "dedicated to the public domain": "public-domain", "the unlicense": "unlicense", "all rights reserved": "reserved",
}
TAGS = {"spdx license identifier": True, "license identifier": False, "license": False, "licence": False}
#: how free a user is under a licence, by the family its identifier starts with
FREEDOM = {
    "cc-by-nc": 0.1, "cc-by-nd": 0.2, "cc-by-sa": 0.5, "cc-by": 0.9, "cc0": 1.0, "public-domain": 1.0, "unlicense": 1.0, "wtfpl": 1.0, "0bsd": 1.0, "mit": 1.0, "mit-0": 1.0, "x11": 1.0, "isc": 1.0,
    "bsd": 1.0, "bsl": 1.0, "zlib": 1.0, "libpng": 1.0, "ncsa": 1.0, "postgresql": 1.0, "psf": 0.95, "python": 0.95, "apache": 0.95, "afl": 0.95, "artistic": 0.8, "ms-pl": 0.8, "unicode": 0.95, "ofl": 0.8, "odc-by": 0.9,
    "pddl": 1.0, "mpl": 0.6, "epl": 0.6, "cddl": 0.6, "cpl": 0.6, "eupl": 0.4, "lgpl": 0.5, "gfdl": 0.4, "odbl": 0.5, "osl": 0.3, "ms-rl": 0.4, "agpl": 0.2, "gpl": 0.3, "sspl": 0.1, "busl": 0.1, "reserved": 0.0,
}
UNKNOWN = 0.2
#: what follows a family in an identifier: a version, clauses, a region or port
_SUFFIX = re.compile(r"(-(v?\d[\d.]*\+?|clause|only|or-later|[a-z]{2}|igo|patent|clear|attribution|generic|international|unported|modification|no|nuclear|license|warranty|advertising|acknowledgement|views|source-code|perl|cl\d+|rfn|tlt))*")
_BINDS = {"or": 1, "and": 2, "with": 3}
_TOKEN = re.compile(rb"[()]|[A-Za-z0-9][A-Za-z0-9.+-]*")
_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


@lru_cache(4096)
def family(identifier: str) -> str | None:
    """The longest known family that the identifier is of: the family itself, or with what may follow one."""
    for end in sorted((i for i, c in enumerate(identifier + "-") if c == "-"), reverse=True):
        if identifier[:end] in FREEDOM and _SUFFIX.fullmatch(identifier, end):
            return identifier[:end]
    return None


def freedom(label: str) -> float:
    return FREEDOM.get(family(label), UNKNOWN)


def normal(identifier: str) -> str:
    """One spelling for a licence: apache-2.0 and apache-2.0-only are apache-2."""
    x = re.sub(r"-(only|or-later)$|\+$", "", identifier.lower().rstrip(".-"))
    return re.sub(r"\.0$", "", x)


def parse(text: str, spdx: bool = False) -> tuple[list[str], float | None]:
    """(identifiers, freedom) of an expression; freedom is None where it is none. Reading stops at
    the first thing that cannot go on an expression. An identifier of no known family has no label
    and UNKNOWN freedom; with `spdx` (after an SPDX tag) it has its own label, and without it an expression
    of unknown identifiers alone is none. NONE and NOASSERTION say nothing."""
    data = text.encode()
    return _parse(data, 0, len(data), spdx)[:2]


def _parse(data: bytes, at: int, end: int, spdx: bool) -> tuple[list[str], float | None, int]:
    """parse() of data[at:end], and where reading stopped."""
    out: list[tuple[float | None, list[str]]] = []
    ops: list[str] = []
    operand, any_known, stop = True, False, end  # what may come next; whether some identifier is known

    def apply() -> None:
        op, (y, b), (x, a) = ops.pop(), out.pop(), out.pop()
        if op == "with":
            out.append((x if x is None else min(1.0, x + 0.1), a))
        elif x is None or y is None:
            out.append((y, b) if x is None else (x, a))
        else:
            out.append((min(x, y) if op == "and" else max(x, y), a + b))

    for m in _TOKEN.finditer(data, at, end):
        t, stop = m[0].decode(), m.start()
        low = t.lower()
        if low in _BINDS:
            if operand:
                break
            while ops and ops[-1] != "(" and _BINDS[ops[-1]] >= _BINDS[low]:
                apply()
            ops.append(low)
            operand = True
        elif t == "(":
            if not operand:
                break
            ops.append(t)
        elif t == ")":
            if operand or "(" not in ops:
                break
            while ops[-1] != "(":
                apply()
            ops.pop()
        else:
            x = normal(t)
            if not operand:
                break
            if x in ("none", "noassertion"):
                out.append((None, []))
            else:
                known = family(x) is not None
                any_known |= (known or spdx) and not (ops and ops[-1] == "with")
                out.append((freedom(x), [x] if known or spdx else []))
            operand = False
    else:
        stop = end
    if operand and ops:  # an operator without a right side
        while ops and ops[-1] != "(" and len(out) < 2:
            ops.pop()
        if ops and ops[-1] in _BINDS and len(out) < 1 + sum(o in _BINDS for o in ops):
            ops.pop()
    while ops:
        if ops[-1] == "(" or len(out) < 2:
            ops.pop()
        else:
            apply()
    out = [o for o in out if o[0] is not None]
    return ([], None, stop) if not out or not any_known else (sorted({i for _, ids in out for i in ids}), min(x for x, _ in out), stop)


@lru_cache(1)
def automaton():
    import ahocorasick

    a = ahocorasick.Automaton()
    for phrase in {*BASE, *NOTICES, *TAGS}:
        a.add_word(f" {phrase} ", phrase)
    a.make_automaton()
    return a


def _longest(found: list[tuple[int, int, str]]) -> set[str]:
    """The labels of the notices (start, end, label) that lie within no longer one; by start, then longest first."""
    labels, reach = set(), -1
    for _, end, label in sorted(found, key=lambda x: (x[0], -x[1])):
        if end > reach:
            labels.add(label)
            reach = end
    return labels


_GAP = b" \t-"
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")


def _expressions(text: bytes, low: bytes, tags: list[tuple[int, int, bool]]) -> Iterator[tuple[list[str], float]]:
    """(identifiers, freedom) after each tag (first word, word after it, SPDX) with only blanks or hyphens between
    its words and then a colon or an equals sign: of the rest of its line. A tag inside the expression of an
    earlier one is part of that; of tags that end together the longest counts."""
    spans = [m.span() for m in _WORD.finditer(low)]
    done, line_end = -1, -1
    for first, after, spdx in sorted(tags, key=lambda x: (x[1], x[0])):
        words = spans[first:after]
        at = words[-1][1]
        if words[0][0] < done or any(text[a:b].strip(_GAP) for (_, a), (b, _) in zip(words, words[1:])):
            continue
        while text[at : at + 1] in (b" ", b"\t"):
            at += 1
        if text[at : at + 1] not in (b":", b"="):
            continue
        if line_end < at:
            line_end = min((e for e in (text.find(b"\n", at), text.find(b"\r", at)) if e >= 0), default=len(text))
        ids, free, done = _parse(text, at + 1, line_end, spdx)
        if free is not None:
            yield ids, free


def scan(text: bytes) -> tuple:
    """(n_words, n_base, first_word, last_word, base_labels, labels, score) of one text."""
    low = text.translate(_WORDS)
    words = low.split()
    line = f" {b' '.join(words).decode('utf-8', 'replace')} "
    hits = list(automaton().iter(line))
    if not hits:
        return len(words), 0, None, None, "", "", 0.0
    # the number of blanks before a hit is the number of its first word; counted once over the text
    places, base, found, tags = [], set(), [], []
    before, at = 0, 0
    for end, phrase in hits:  # ends come in order
        before += line.count(" ", at, end)
        at = end
        first = before - len(phrase.split())
        if phrase in BASE:
            places.append(first)
            base.add(BASE[phrase])
        if phrase in NOTICES:
            found.append((first, before, NOTICES[phrase]))
        if phrase in TAGS:
            tags.append((first, before, TAGS[phrase]))
    labels, scores = set(base), [freedom(x) for x in base]
    for label in _longest(found):  # a notice within a longer one says nothing of its own
        if not any(x == label or x.startswith(f"{label}-") for x in base):
            labels.add(label)
            scores.append(freedom(label))
    for ids, free in _expressions(text, low, tags) if tags else ():
        labels |= set(ids)
        scores.append(free)
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), min(scores, default=0.0)


_RESULT = [("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64())]


def scan_licenses(df: DataFrame) -> DataFrame:
    """(doc_id long, text) -> doc_id and the columns of scan()."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in common.slices(batch):
                rows = list(zip(*map(scan, textkit.strings(part.column(1)))))
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(x, t) for x, (_, t) in zip(rows, _RESULT))], names=["doc_id", *(n for n, _ in _RESULT)])

    return df.select("doc_id", "text").mapInArrow(run, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")


def query(spark, sf_dir: str) -> DataFrame:
    return scan_licenses(common.texts(common.table(spark, sf_dir, "documents")))
