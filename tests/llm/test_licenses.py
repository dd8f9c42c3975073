import random
import re
import time

import pytest

from quarry.llm import licenses

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


class Plain:
    """A recursive-descent parser of whole, right expressions."""

    def __init__(self, text, spdx):
        self.tokens, self.at, self.spdx, self.any = re.findall(r"[()]|[A-Za-z0-9][A-Za-z0-9.+-]*", text), 0, spdx, False

    def peek(self):
        return self.tokens[self.at].lower() if self.at < len(self.tokens) else None

    def either(self, op, part, join):
        free, ids = part()
        while self.peek() == op:
            self.at += 1
            f, i = part()
            free, ids = join(free, f), ids | i
        return free, ids

    def or_(self):
        return self.either("or", self.and_, max)

    def and_(self):
        return self.either("and", self.with_, min)

    def with_(self):
        free, ids = self.one()
        while self.peek() == "with":
            self.at += 2
            free = min(1.0, free + 0.1)
        return free, ids

    def one(self):
        t = self.tokens[self.at]
        self.at += 1
        if t == "(":
            out = self.or_()
            self.at += 1
            return out
        x = licenses.normal(t)
        known = licenses.family(x) is not None
        self.any |= known or self.spdx
        return licenses.freedom(x), {x} if known or self.spdx else set()


def plain_labels(text):
    """Labels and score by looking at every place of every phrase and every line."""
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
    w = re.findall(WORD, low)
    places = lambda p: [i for i in range(len(w) - len(p) + 1) if w[i : i + len(p)] == p]
    base = {label for phrase, label in licenses.BASE.items() if places(phrase.split())}
    labels, scores = set(base), [licenses.freedom(x) for x in base]
    found = [(i, i + len(p.split()), label) for p, label in licenses.NOTICES.items() for i in places(p.split())]
    for a, b, label in found:
        if not any(c <= a and b <= d and (c, d) != (a, b) for c, d, _ in found) and not any(x == label or x.startswith(f"{label}-") for x in base):
            labels.add(label)
            scores.append(licenses.freedom(label))
    for line in re.split(r"[\r\n]", text):
        m = re.search(r"(?i)(?<![0-9a-z])(spdx[ \t-]+license[ \t-]+identifier|license[ \t-]+identifier|licen[cs]e)[ \t]*[:=](.*)", line, re.A)
        if m:
            p = Plain(m[2], m[1].lower().startswith("spdx"))
            free, ids = p.or_()
            if p.any:
                labels |= ids
                scores.append(free)
    return ",".join(sorted(labels)), min(scores, default=0.0)


@pytest.mark.parametrize("seed", range(40))
def test_labels_and_score_against_brute_force(seed):
    r = random.Random(seed)
    names = ["MIT", "GPL-2.0-only", "Apache-2.0", "BSD-3-Clause", "EPL-2.0", "CC-BY-NC-4.0", "FOO-1.0", "MPL-2.0", "mit-approved", "LGPL-2.1-or-later"]

    def expression(depth):
        k = r.random()
        if depth == 0 or k < 0.3:
            return r.choice(names) + (" WITH Classpath-exception-2.0" if r.random() < 0.2 else "")
        x, y = expression(depth - 1), expression(depth - 1)
        return f"({x} {r.choice(['OR', 'AND', 'or', 'And'])} {y})" if k < 0.6 else f"{x} {r.choice(['OR', 'AND'])} {y}"

    lines = []
    for _ in range(r.randint(0, 8)):
        k = r.random()
        if k < 0.4:
            lines.append(r.choice(["SPDX-License-Identifier: ", "// License: ", "licence = ", "license-identifier:", "see license ", "spdx license  identifier:"]) + expression(3))
        elif k < 0.8:
            lines.append(" ".join(r.choice([*licenses.NOTICES, *licenses.BASE, "some words", "größe"]) for _ in range(3)))
        else:
            lines.append(r.choice(["", "plain words of prose", "version 2", "Under the MIT License, Apache License, Version 2.0"]))
    text = r.choice(["\n", "\r\n"]).join(lines)
    found = licenses.scan(text.encode())[5:]
    plain = plain_labels(text)
    assert found[0] == plain[0] and abs(found[1] - plain[1]) < 1e-9, text


@pytest.mark.parametrize(
    "unit", ["gnu general public license version 2\n", "under the mit license ", "SPDX-License-Identifier: MIT OR (Apache-2.0 AND FOO)\n", "license: license and ", "license: (", "apache license version 2 license: mit "]
)
def test_long_texts_take_time_in_proportion(unit):
    """A text of 4 MB full of notices, tags or base phrases."""
    text = (unit * (4_000_000 // len(unit))).encode()
    began = time.perf_counter()
    out = licenses.scan(text)
    assert time.perf_counter() - began < 30 and out[0] >= len(text) // 25
