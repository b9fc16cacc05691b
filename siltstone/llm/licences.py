"""Licence scans with DataFrame functions only: Dice coefficient over word bigrams against licence templates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import documents

# The wording of public licences.
_MIT_GRANT = (
    'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, '
    "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
    "subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
)
_MIT_REST = (
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. '
    "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, "
    "ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_BSD_3 = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
    "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. "
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. '
    "IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; "
    "LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) "
    "ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
#: Notices by licence id; a caller may pass its own.
TEMPLATES: dict[str, list[str]] = {
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.',
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 '
        'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. '
        "See the License for the specific language governing permissions and limitations under the License.",
    ],
    "MIT": [
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction.",
        _MIT_GRANT,
        _MIT_GRANT + " " + _MIT_REST,
    ],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. "
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. "
        "You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.",
    ],
    "LGPL-3.0": ["This library is licensed under the GNU Lesser General Public License, version 3."],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."],
    "BSD-3-Clause": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.", _BSD_3],
    "CC-BY-4.0": ["Licensed under CC BY 4.0."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0."],
    "CC0-1.0": ["Released into the public domain under CC0 1.0."],
}
MIN_DICE = 0.8
#: Lines that a notice may be wrapped over, blank ones included.
MOST_LINES = 40
#: Lines of a text that are searched together, besides the neighbours that they need.
CHUNK_LINES = 64
#: Templates are literals of the plan; more than this are refused.
MOST_TEMPLATES = 1000
#: What separates words once text is lower-cased.
NORMAL = "[^a-z0-9]+"


def normal_words(text: str) -> list[str]:
    import re

    return [w for w in re.split(NORMAL, text.lower()) if w]


def bigrams(text: str) -> list[str]:
    w = normal_words(text)
    return sorted({f"{a} {b}" for a, b in zip(w, w[1:])})


def line_words(line: Column) -> Column:
    return F.array_remove(F.split(F.trim(F.regexp_replace(F.lower(line), NORMAL, " ")), " "), "")


def word_bigrams(w: Column) -> Column:
    """Distinct word bigrams of a list of words."""
    most = F.greatest(F.size(w) - 1, F.lit(0))
    return F.array_distinct(F.zip_with(F.slice(w, 1, most), F.slice(w, 2, most), lambda a, b: F.concat_ws(" ", a, b)))


def _once(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, however often ``use`` names it."""
    return F.transform(F.array(value), use)[0]


def _prefilter(rows: list[tuple[str, int, list[str]]], share: float, shortest: int = 5) -> str:
    """A pattern of a few words, of which every matching window has one.

    A match holds at least ``share`` of a template's n bigrams, so it has one of any n - ceil(share * n) + 1 of them. Words
    of some length are chosen greedily until they touch as many of each template; where such words do not do, whole
    bigrams follow.
    """
    left = [(len(b) - max(1, -int(-(len(b) * share - 1e-9) // 1)) + 1, set(b)) for *_, b in rows]
    words, pairs = [], []
    choice = sorted({w for _, b in left for g in b for w in g.split() if len(w) >= shortest})
    while left:
        gain = {w: sum(min(n, sum(w in g for g in b)) for n, b in left) * (len(w) - shortest + 1) for w in choice}
        best = max(choice, key=gain.get, default=None)
        if best is not None and gain[best]:
            words.append(best)
            left = [(n - sum(best in g for g in b), {g for g in b if best not in g}) for n, b in left]
        else:
            more = {g for n, b in left for g in sorted(b)[:n]}
            pairs += sorted(more)
            left = [(n - len(b & more), b - more) for n, b in left]
        left = [(n, b) for n, b in left if n > 0]
    return "(?i)" + "|".join([w for w in words if not any(v != w and v in w for v in words)] + [NORMAL.join(g.split()) for g in pairs])


def admitted(n: int, min_dice: float) -> tuple[int, int]:
    """Bigram counts that a window may have to reach ``min_dice`` with a template of n bigrams."""
    least = min_dice / (2 - min_dice)
    return int(-(-(n * least - 1e-9) // 1)), int((n / least + 1e-9) // 1)


def scan_licences(
    docs: DataFrame, templates: dict[str, list[str]] | None = None, min_dice: float = MIN_DICE, key: str = "doc_id", text: str = "text", most_lines: int = MOST_LINES
) -> DataFrame:
    """Places of texts that match a licence notice: (key, line_no, last_line, licence, template_no, dice), lines from 0.

    Windows of one to ``most_lines`` consecutive lines are joined to one list of words, so a wrapped notice is found. A
    window and a template match when twice their common distinct bigrams over the sum of both counts is at least
    ``min_dice``. That is possible only if the window has from d/(2-d) to (2-d)/d times the template's bigrams; other
    templates are not compared. A window yields to one within it that matches the same template as well or better; of those
    left, to any that shares a line with it and has more common bigrams (ties: the higher Dice, fewer lines, the earlier,
    the first licence by name, then the first template). So a window need begin and end in lines that hold part of a
    template's bigram, which spares most of them without a change in the result.

    Null and empty texts have no lines; a text of any length is scanned whole, in chunks of lines with the neighbours that
    decide between windows; a repeated row gives its matches again; other columns are not read. There is no shuffle.
    """
    rows = [(name, i, bigrams(t)) for name, ts in sorted((TEMPLATES if templates is None else templates).items()) for i, t in enumerate(ts)]
    rows = [r for r in rows if r[2]]
    if len(rows) > MOST_TEMPLATES:
        raise ValueError(f"at most {MOST_TEMPLATES} templates")
    if not rows:
        return docs.select(F.col(key), *(F.lit(None).cast(t).alias(c) for c, t in (("line_no", "long"), ("last_line", "long"), ("licence", "string"), ("template_no", "long"), ("dice", "double")))).where(F.lit(False))
    strings = lambda xs: F.array(*(F.lit(x) for x in xs))
    notices = F.array(*(F.struct(F.lit(n).alias("licence"), F.lit(i).alias("template_no"), *(F.lit(x).alias(c) for c, x in zip(("lo", "hi"), admitted(len(b), min_dice))), strings(b).alias("tb")) for n, i, b in rows))
    grams = sorted({g for *_, b in rows for g in b})
    known, known_words = strings(grams), strings(sorted({w for g in grams for w in g.split()}))
    hint = _prefilter(rows, min_dice / (2 - min_dice))
    size, k = CHUNK_LINES, most_lines

    lines = F.split("_text", "\n", -1)
    first = lambda c: F.greatest(c * size - k, F.lit(0))
    chunk = lambda all_: F.transform(
        F.sequence(F.lit(0), F.floor((F.size(all_) - 1) / size).cast("int")),
        lambda c: F.struct((c * size).alias("core"), first(c).alias("first"), F.slice(all_, first(c) + 1, (c + 1) * size + 2 * k - first(c)).alias("lines")),
    )
    # known and other bigrams of a line, and whether its last or first word may be part of a known one with its neighbour
    touched = lambda w: _once(word_bigrams(w), lambda b: _once(F.size(F.array_intersect(b, known)), lambda n: F.struct(
        n.alias("known"), (F.size(b) - n).alias("other"), F.array_contains(known_words, F.try_element_at(w, F.lit(-1))).alias("goes_on"), F.array_contains(known_words, F.try_element_at(w, F.lit(1))).alias("went_on"),
    )))
    places = lambda flag: F.filter(F.transform("_touched", lambda x, i: F.when((x["known"] > 0) | x[flag], i)), lambda i: i.isNotNull())

    def compared(s: Column, e: Column):
        def with_grams(b: Column) -> Column:
            near = F.filter(notices, lambda t: F.size(b).between(t["lo"], t["hi"]))
            counted = F.transform(near, lambda t: F.struct(F.size(F.array_intersect(b, t["tb"])).alias("c"), (F.size(t["tb"]) + F.size(b)).alias("n"), t["licence"].alias("licence"), t["template_no"].alias("template_no")))
            scored = F.transform(counted, lambda r: F.struct((-r["c"]).alias("c"), (-2.0 * r["c"] / r["n"]).alias("d"), (e - s).alias("lines"), s.alias("s"), r["licence"].alias("licence"), r["template_no"].alias("template_no"), e.alias("e")))
            return F.filter(scored, lambda r: r["d"] <= -min_dice)

        return _once(word_bigrams(F.flatten(F.slice("_words", s + 1, e - s + 1))), with_grams)

    # a window has at most so many common bigrams as its lines have known ones and ends; its other bigrams are bounded by them
    def hopeful(s: Column, e: Column) -> Column:
        part = F.slice("_touched", s + 1, e - s + 1)
        return F.array_max(F.transform(part, lambda x: x["other"])) <= F.aggregate(part, F.lit(0), lambda n, x: n + x["known"] + 1) * (2 * (1 - min_dice) / min_dice) + 1e-9

    windows = F.flatten(F.flatten(F.transform("_from", lambda s: F.transform(F.filter("_to", lambda e: (e >= s) & (e < s + k) & hopeful(s, e)), lambda e: compared(s, e)))))
    same = lambda a, b: (a["licence"] == b["licence"]) & (a["template_no"] == b["template_no"])
    inside = lambda a, b: (b["s"] >= a["s"]) & (b["e"] <= a["e"]) & (b["lines"] < a["lines"])
    tight = F.filter("_m", lambda a: ~F.exists("_m", lambda b: inside(a, b) & same(a, b) & (b["d"] <= a["d"])))
    best = F.filter("_m", lambda a: ~F.exists("_m", lambda b: (b["s"] <= a["e"]) & (b["e"] >= a["s"]) & (b < a)))

    step = lambda df, name, value: df.select("*", F.explode(F.array(value)).alias(name))  # noqa: E731  computed once, unlike a projected column
    df = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text")).where(F.col("_text").rlike(hint))
    df = step(df, "_lines", lines).select("_key", F.explode(chunk(F.col("_lines"))).alias("_c")).where(F.array_join("_c.lines", "\n").rlike(hint))
    df = step(df, "_words", F.transform("_c.lines", line_words)).select("_key", "_c.core", "_c.first", "_words")
    df = step(df, "_touched", F.transform("_words", touched))
    df = step(step(df, "_from", places("goes_on")), "_to", places("went_on")).select("_key", "core", "first", "_words", "_touched", "_from", "_to")
    df = step(df, "_m", windows).where(F.size("_m") > 0).select("_key", "core", "first", "_m")
    df = step(df, "_t", tight).select("_key", "core", "first", F.col("_t").alias("_m"))
    df = df.select("_key", "core", "first", F.explode(best).alias("_b")).where((F.col("first") + F.col("_b.s")).between(F.col("core"), F.col("core") + size - 1))
    line = lambda c: (F.col("first") + F.col(c)).cast("long")
    return df.select(F.col("_key").alias(key), line("_b.s").alias("line_no"), line("_b.e").alias("last_line"), F.col("_b.licence").alias("licence"), F.col("_b.template_no").cast("long").alias("template_no"), (-F.col("_b.d")).alias("dice"))


def op9_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licences(documents(spark, sf_dir))


def _template_values() -> str:
    q = lambda x: "'" + x.replace("'", "''") + "'"
    rows = [(n, i, bigrams(t)) for n, ts in sorted(TEMPLATES.items()) for i, t in enumerate(ts)]
    return ", ".join(f"({q(n)}, {i}, {lo}, {hi}, [{', '.join(map(q, b))}])" for n, i, b in rows for lo, hi in [admitted(len(b), MIN_DICE)])


OP9_SQL = f"""
WITH t(licence, template_no, lo, hi, tb) AS (VALUES {_template_values()}),
k AS (SELECT list(DISTINCT g) AS grams, (SELECT list(DISTINCT x) FROM (SELECT unnest(flatten(list_transform(tb, lambda g: string_split(g, ' ')))) AS x FROM t)) AS words FROM (SELECT unnest(tb) AS g FROM t)),
l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS n FROM documents),
w AS (SELECT doc_id, n, list_filter(string_split(trim(regexp_replace(lower(line), '[^a-z0-9]+', ' ', 'g')), ' '), lambda x: x <> '') AS w FROM l),
d AS (SELECT doc_id, list(w ORDER BY n) AS ws FROM w GROUP BY doc_id),
b AS (SELECT doc_id, n, w, list_has_any(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]), grams) AS inner_, words FROM w, k WHERE len(w) > 0),
s AS (SELECT doc_id, n FROM b WHERE inner_ OR list_contains(words, w[-1])),
e AS (SELECT doc_id, n FROM b WHERE inner_ OR list_contains(words, w[1])),
v AS (SELECT s.doc_id, s.n AS s, e.n AS e, flatten(ws[s.n + 1 : e.n + 1]) AS x FROM s JOIN e ON s.doc_id = e.doc_id AND e.n BETWEEN s.n AND s.n + {MOST_LINES - 1} JOIN d ON s.doc_id = d.doc_id),
g AS (SELECT doc_id, s, e, list_distinct(list_transform(range(1, len(x)), lambda i: x[i] || ' ' || x[i + 1])) AS lb FROM v),
m AS (SELECT doc_id, s, e, licence, template_no, len(list_intersect(lb, tb)) AS c, 2.0 * len(list_intersect(lb, tb)) / (len(lb) + len(tb)) AS dice FROM g, t WHERE len(lb) BETWEEN lo AND hi),
p AS (SELECT * FROM m WHERE dice >= {MIN_DICE}),
q AS (SELECT * FROM p a WHERE NOT EXISTS (SELECT 1 FROM p b WHERE b.doc_id = a.doc_id AND b.licence = a.licence AND b.template_no = a.template_no
      AND b.s >= a.s AND b.e <= a.e AND b.e - b.s < a.e - a.s AND b.dice >= a.dice))
SELECT doc_id, CAST(s AS BIGINT) AS line_no, CAST(e AS BIGINT) AS last_line, licence, CAST(template_no AS BIGINT) AS template_no, CAST(dice AS DOUBLE) AS dice FROM q a
WHERE NOT EXISTS (SELECT 1 FROM q b WHERE b.doc_id = a.doc_id AND b.s <= a.e AND b.e >= a.s AND (b.c > a.c OR (b.c = a.c AND (b.dice > a.dice OR (b.dice = a.dice AND (b.e - b.s < a.e - a.s
      OR (b.e - b.s = a.e - a.s AND (b.s < a.s OR (b.s = a.s AND (b.licence < a.licence OR (b.licence = a.licence AND b.template_no < a.template_no)))))))))))
"""
