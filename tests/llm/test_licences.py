import random
import textwrap

from helpers import edge_rows, frame
from pyspark.sql import functions as F

from siltstone.llm import licences as L


def brute(rows, templates=L.TEMPLATES, most=L.MOST_LINES):
    """All windows of lines against all templates; then the rules of choice, word for word."""
    out, notices = set(), [(n, i, set(L.bigrams(t))) for n, ts in templates.items() for i, t in enumerate(ts)]
    for doc, text, *_ in rows:
        lines, found = (text or "").split("\n"), []
        for s in range(len(lines)):
            for e in range(s, min(len(lines), s + most)):
                a = set(L.bigrams("\n".join(lines[s : e + 1])))
                found += [(-len(a & b), -2.0 * len(a & b) / (len(a) + len(b)), e - s, s, n, i) for n, i, b in notices if a and 2.0 * len(a & b) / (len(a) + len(b)) >= L.MIN_DICE]
        left = [a for a in found if not any(b[4:] == a[4:] and b[2] < a[2] and b[3] >= a[3] and b[3] + b[2] <= a[3] + a[2] and b[1] <= a[1] for b in found)]
        out |= {(doc, a[3], a[3] + a[2], *a[4:], -a[1]) for a in left if not any(b[3] <= a[3] + a[2] and b[3] + b[2] >= a[3] and b < a for b in left)}
    return out


def test_equals_brute_force(spark):
    rng, rows = random.Random(2), edge_rows()
    notices = [t for ts in L.TEMPLATES.values() for t in ts]
    for i in range(120):
        words = rng.choice(notices).split()
        for _ in range(rng.randrange(4)):
            words[rng.randrange(len(words))] = rng.choice(["Foo", "license", "the", "version"])
        rows.append((i, "intro line\n" + " ".join(words).upper() + "\nrest", "en", "s", 1))
    docs = frame(spark, rows).withColumn("licence", F.lit("clash")).withColumn("_m", F.lit(1))
    got = [tuple(r) for r in L.scan_licences(docs).collect()]
    assert set(got) == brute(rows) and len(set(got)) > 40


def test_no_shuffle_no_python(spark):
    plan = L.scan_licences(frame(spark, [(1, "a")]))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "hashpartitioning" not in plan and "NestedLoop" not in plan


def test_repeats_and_empty(spark):
    line = "Released under the MIT License."
    assert L.scan_licences(frame(spark, [(1, line), (1, line)])).count() == 2
    assert L.scan_licences(frame(spark, [])).count() == 0
    assert L.scan_licences(frame(spark, [(1, line)]), templates={}).count() == 0


def test_wrapped_notices_equal_brute_force(spark):
    rng, rows = random.Random(5), []
    notices = [t for ts in L.TEMPLATES.values() for t in ts]
    for i in range(70):
        lines = []
        for _ in range(rng.randrange(1, 4)):
            words = rng.choice(notices).split()
            for _ in range(rng.randrange(3)):
                words[rng.randrange(len(words))] = rng.choice(["Foo", "license", "the"])
            lines += [rng.choice(["# ", " * ", ""]) + x for x in textwrap.wrap(" ".join(words), rng.choice([40, 72, 80]))]
            lines += rng.choice([[], [""], ["Copyright 2020 the authors", ""], ["and the License"]])
        rows.append((i, "\n".join(lines), "en", "s", 1))
    got = [tuple(r) for r in L.scan_licences(frame(spark, rows)).collect()]
    assert set(got) == brute(rows) and len(got) == len(set(got)) and sum(r[2] > r[1] for r in got) > 50


def test_whole_wrapped_licences(spark):
    want = {"MIT": 4, "BSD-3-Clause": 1, "Apache-2.0": 2, "GPL-3.0": 2}
    rows = [(i, "code\n" + "\n".join("// " + x for x in textwrap.wrap(L.TEMPLATES[n][k], 72)) + "\nmore code") for i, (n, k) in enumerate(want.items())]
    got = {r.doc_id: (r.licence, r.template_no, r.dice, r.line_no) for r in L.scan_licences(frame(spark, rows)).collect()}
    assert got == {i: (n, k, 1.0, 1) for i, (n, k) in enumerate(want.items())}


def test_chunks_change_nothing(spark, monkeypatch):
    rng, lines = random.Random(8), []
    short = {n: [t for t in ts if len(t) < 120] for n, ts in L.TEMPLATES.items()}
    for _ in range(60):
        lines += textwrap.wrap(rng.choice(rng.choice([t for t in short.values() if t])), rng.choice([18, 30, 60])) + [""] * rng.randrange(3)
    rows = [(1, "\n".join(lines), "en", "s", 1)]
    want = brute(rows, short, 6)
    assert len(want) > 40
    for size in (3, 64):
        monkeypatch.setattr(L, "CHUNK_LINES", size)
        got = [tuple(r) for r in L.scan_licences(frame(spark, rows), short, most_lines=6).collect()]
        assert len(got) == len(set(got)) and set(got) == want
