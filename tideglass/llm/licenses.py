"""Licence scan: Dice coefficient over word bigrams against templates, in DataFrame functions only.

A text is normalised (lower case; everything but a-z, 0-9 and line ends becomes a blank)
and compared as a whole and line by line: a unit matches a template when
2 * |A & B| / (|A| + |B|) >= THRESHOLD for their sets of word bigrams.

Pruning, all of it exact.  A unit can match a template of b bigrams only if its own number lies
between b * t / (2 - t) and b * (2 - t) / t (size bounds; a unit of w words has at most w - 1 bigrams and
at least one less than it has distinct words), and only if it shares at least b * t / (2 - t) bigrams with
it, hence one of any b - that + 1 of them: the rarer word of each of these must be
in the unit.  Units that hold none of those words are dropped before any bigram is formed.

Everything happens inside a row, so no row meets another and no key can be hot.

Cases: null and empty texts match nothing; units of fewer than two words have no bigram and match
nothing; ties of the best match go to the earlier unit, then to the template's name; repeated rows are scanned one by one; further
columns stay as they are.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

THRESHOLD = 0.8

# Notices as licensors publish them.
TEMPLATES: list[tuple[str, str]] = [
    ("all-rights-reserved", "All rights reserved."),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."),
    ("bsd-2-clause", "This work is licensed under the BSD 2-Clause License."),
    ("bsd-3-clause", "This work is licensed under the BSD 3-Clause License."),
    ("cc-by-4.0", "Licensed under CC BY 4.0."),
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0."),
    ("cc-by-nc-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("cc-by-sa-4.0", "Licensed under CC BY-SA 4.0."),
    ("cc-by-sa-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("gpl-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("lgpl-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("mit", "Released under the MIT License."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction."),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
]

_BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
"""
_BSD_3 = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.
"""
_BSD_END = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
"""
_MIT_END = """The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_APACHE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""
_GPL = """This program is free software{}you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation{}either version {} of the License, or (at your option) any later version.
This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."""

#: Complete texts and file headers, looked for besides TEMPLATES by whole().
TEXTS: list[tuple[str, str]] = [
    ("apache-2.0", _APACHE),
    ("bsd-2-clause", _BSD + _BSD_END),
    ("bsd-3-clause", _BSD + _BSD_3 + _BSD_END),
    ("gpl-2.0", _GPL.format("; ", "; ", "2")),
    ("gpl-3.0", _GPL.format(": ", ", ", "3")),
    ("mit", _MIT),
    ("mit", _MIT + _MIT_END),
]

#: Words that the prefix of a template avoids if it can: the commonest ones.
_COMMON = ("the", "a", "of", "to", "is", "in", "this", "under", "by", "and", "any", "all", "for", "use", "you", "may", "not", "with", "0", "2", "3", "4", "v")


def bigrams(text: str) -> list[str]:
    """Distinct word bigrams of a normalised text, in order."""
    ws = "".join(c if c.isascii() and c.isalnum() else " " for c in text.lower()).split()
    return list(dict.fromkeys(f"{a} {b}" for a, b in zip(ws, ws[1:])))


def _least_shared(b: int, t: float) -> int:
    return math.ceil(round(b * t / (2 - t), 9))


def keywords(templates: list[tuple[str, str]], t: float = THRESHOLD) -> list[str]:
    """Words of which every unit that matches some template holds at least one."""
    out = set()
    rank = lambda w: (w in _COMMON, -len(w), w)
    for _, text in templates:
        rare = sorted((min(g.split(), key=rank) for g in bigrams(text)), key=rank)
        out.update(rare[: len(rare) - _least_shared(len(rare), t) + 1])
    return sorted(out)


def _grams(words: Column) -> Column:
    pairs = F.zip_with(F.slice(words, F.lit(1), F.size(words) - 1), F.slice(words, F.lit(2), F.size(words) - 1), lambda a, b: F.concat(a, F.lit(" "), b))
    return F.array_distinct(pairs)


def matches(text: Column, templates: list[tuple[str, str]] = TEMPLATES, t: float = THRESHOLD) -> Column:
    """array<struct<unit:int, license:string, dice:double>>: unit 0 is the whole text, k the k-th line."""
    sizes = [len(bigrams(x)) for _, x in templates]
    least = min(_least_shared(b, t) for b in sizes)
    most = max(math.floor(round(b * (2 - t) / t, 9)) for b in sizes)
    plain = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^a-z0-9\n]+", " ")
    units = F.concat(F.array(F.replace(plain, F.lit("\n"), F.lit(" "))), F.split(plain, "\n"))
    split = F.transform(units, lambda u, k: F.struct(k.alias("unit"), F.filter(F.split(u, " "), lambda w: w != "").alias("words")))
    words = F.array(*[F.lit(w) for w in keywords(templates, t)])
    some = F.filter(split, lambda u: (F.size(u.words) > least) & F.arrays_overlap(u.words, words))
    some = F.filter(some, lambda u: F.size(F.array_distinct(u.words)) - 1 <= most)
    grams = F.transform(some, lambda u: F.struct(u.unit.alias("unit"), _grams(u.words).alias("g")))
    known = F.array(*[F.struct(F.lit(name).alias("license"), F.array(*[F.lit(g) for g in bigrams(x)]).alias("g"), F.lit(len(bigrams(x))).alias("b")) for name, x in templates])

    def against(u: Column) -> Column:
        a = F.size(u.g)
        near = F.filter(known, lambda k: (a * (2 - t) >= k.b * t - 1e-9) & (a * t <= k.b * (2 - t) + 1e-9))
        scored = F.transform(near, lambda k: F.struct(u.unit.alias("unit"), k.license.alias("license"), (2.0 * F.size(F.array_intersect(u.g, k.g)) / (a + k.b)).alias("dice")))
        return F.filter(scored, lambda m: m.dice >= t)

    return F.flatten(F.transform(grams, against))


def scan(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, t: float = THRESHOLD) -> DataFrame:
    """docs with `matches`, `licenses` (distinct names, sorted), and the best match's `license`, `dice` and `unit`."""
    out = docs.withColumn("matches", matches(F.col("text"), templates, t))
    best = F.array_min(F.transform("matches", lambda m: F.struct((-m.dice).alias("d"), m.unit.alias("unit"), m.license.alias("license"))))
    out = out.withColumn("licenses", F.array_sort(F.array_distinct(F.transform("matches", lambda m: m.license)))).withColumn("_best", best)
    return out.withColumn("license", F.col("_best.license")).withColumn("dice", -F.col("_best.d")).withColumn("unit", F.col("_best.unit")).drop("_best")


def passages(text: Column, templates: list[tuple[str, str]] = TEMPLATES + TEXTS, t: float = THRESHOLD) -> Column:
    """array<struct<at:int,n:int,license:string,dice:double>>: runs of n words, from word at on, that match a template.

    A template is compared with every window of its own number of words, line ends ignored, that begins with one of its
    bigrams (another one gains by beginning later); of overlapping matches of a template the best, then first, is kept.
    A text without enough bigrams of a template in all has no such window, nor has a start whose block of n words and the
    next hold too few.  Windows that begin in one block overlap, so only each block's best can stay, and it is held against the
    2n - 1 starts around it: the work is the text's length times that of a template, however often it is met.
    """
    plain = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^a-z0-9]+", " ")
    words = F.array(*[F.lit(w) for w in keywords(templates, t)])
    every = F.array(*[F.lit(g) for g in dict.fromkeys(g for _, x in templates for g in bigrams(x))])
    known = F.array(*[_known(name, x, t) for name, x in templates])
    texts = F.filter(F.transform(F.array(plain), lambda u: F.filter(F.split(u, " "), lambda w: w != "")), lambda ws: (F.size(ws) > 1) & F.arrays_overlap(ws, words))
    pairs = lambda ws: F.zip_with(F.slice(ws, F.lit(1), F.size(ws) - 1), F.slice(ws, F.lit(2), F.size(ws) - 1), lambda a, b: F.concat(a, F.lit(" "), b))
    grams = F.transform(F.transform(texts, pairs), lambda g: F.struct(g.alias("g"), F.array_intersect(g, every).alias("some")))

    def windows(g: Column, k: Column) -> Column:
        """The kept windows of one template: (dice, -at), so that the best, then first, is the largest."""
        hit = F.transform(g, lambda x: F.array_contains(k.g, x))
        block = lambda xs, b: F.slice(xs, b * k.n + 1, k.n)
        blocks = F.sequence(F.lit(0), F.floor((F.size(g) - 1) / k.n).cast("int"))
        counts = _once(hit, lambda h: F.struct(h.alias("h"), F.transform(blocks, lambda b: F.size(F.filter(block(h, b), lambda x: x))).alias("c")))

        def dice(i: Column) -> Column:
            w = F.slice(g, i + 1, k.n - 1)
            return 2.0 * F.size(F.array_intersect(w, k.g)) / (F.size(F.array_distinct(w)) + F.size(k.g))

        def rated(s: Column) -> Column:
            enough = lambda i: F.get(s.c, F.floor(i / k.n).cast("int")) + F.coalesce(F.get(s.c, F.floor(i / k.n).cast("int") + 1), F.lit(0)) >= k.least
            return F.transform(s.h, lambda h, i: F.when(h & enough(i), F.struct(dice(i).alias("dice"), (-i).alias("back"))))

        def kept(every: Column) -> Column:
            tops = F.filter(F.transform(blocks, lambda b: F.array_max(block(every, b))), lambda m: m.dice >= t)
            around = lambda m: F.slice(every, F.greatest(-m.back - k.n + 2, F.lit(1)), F.least(-m.back, k.n - 1) + k.n)
            return F.filter(tops, lambda m: F.array_max(around(m)) == m)

        found = _once(_once(counts, rated), kept)
        return F.transform(found, lambda m: F.struct((-m.back).alias("at"), k.n.alias("n"), k.license.alias("license"), m.dice.alias("dice")))

    def against(u: Column) -> Column:
        near = F.filter(known, lambda k: F.size(F.array_intersect(k.g, u.some)) >= k.least)
        return F.flatten(F.transform(near, lambda k: windows(u.g, k)))

    return F.flatten(F.transform(grams, against))


def _once(x: Column, f) -> Column:
    """f(x), with x worked out once however often f names it."""
    return F.element_at(F.transform(F.array(x), f), 1)


def _known(name: str, text: str, t: float) -> Column:
    own = bigrams(text)
    n = len("".join(c if c.isascii() and c.isalnum() else " " for c in text).split())
    return F.struct(F.lit(name).alias("license"), F.array(*[F.lit(g) for g in own]).alias("g"), F.lit(n).alias("n"), F.lit(_least_shared(len(own), t)).alias("least"))


def whole(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES + TEXTS, t: float = THRESHOLD) -> DataFrame:
    """docs with `matches` (whole text and lines), `passages` (windows) and `licenses` (distinct names of both, sorted)."""
    out = docs.withColumn("matches", matches(F.col("text"), templates, t)).withColumn("passages", passages(F.col("text"), templates, t))
    names = F.concat(F.transform("matches", lambda m: m.license), F.transform("passages", lambda m: m.license))
    return out.withColumn("licenses", F.array_sort(F.array_distinct(names)))
