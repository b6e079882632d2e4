"""Spans of fuzzy notices against the edit distance of every run of words."""

import random
import re

from apronflow.llm import licenses


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def expected(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), text))
    out = set()
    for phrase, label, edits in licenses.NOTICES:
        runs = []
        for i in range(len(w)):
            for j in range(i + 1, min(len(w), i + 7) + 1):
                d = distance(" ".join(w[i:j]), phrase)
                if d <= edits:
                    runs.append((d, i, j))
        taken = []
        for d, i, j in sorted(runs):
            if all(j <= a or b <= i for _, a, b in taken):
                taken.append((d, i, j))
        out |= {(label, i, j, d) for d, i, j in taken}
    return out


def test_spans_are_those_of_the_edit_distance(spark):
    draw = random.Random(3)
    pool = "apache license licelnse licende licence apace gnu general public publick genral mit mitt cc by the a x lic license" .split()
    texts = ["pache licelnse x the a apache licende  apache license x the a", "apache licens see apache license", "a apache license", ""]
    for _ in range(300):
        words = [draw.choice(pool) for _ in range(draw.randrange(1, 14))]
        if draw.random() < 0.5:
            k = draw.randrange(len(words))
            at = draw.randrange(len(words[k]) + 1)
            words[k] = words[k][:at] + draw.choice(["é", "q", " ", ""]) + words[k][at + draw.randrange(2) :]
        texts.append(" ".join(words))
    table = spark.createDataFrame([(t,) for t in texts], "text STRING")
    for r in licenses.scan(table).collect():
        got = {(s.label, s.first_word, s.end_word, s.edits) for s in r.spans}
        assert got == expected(r.text), r.text
