"""URL scores and verdicts of the model against a plain character model."""

import math
import statistics

from apronflow.llm import urls


def plain(rows):
    """Scores and verdicts by the docstring: order 2, each order's estimate the prior of the next."""
    coded = {u: [urls.LETTERS.find(c) + 1 or urls.OTHER for c in u.lower()] for u, _ in rows}

    def counts(side):
        found = [{}, {}, {}]
        total = 0
        for u, verdict in rows:
            if verdict == side:
                for i, c in enumerate(coded[u]):
                    context = [*([0, 0] + coded[u])[i : i + 2], c]
                    for order in range(3):
                        key = tuple(context[2 - order :])
                        found[order][key] = found[order].get(key, 0) + 1
                    total += 1
        heads = [{}, {}, {}]
        for order in (1, 2):
            for key, n in found[order].items():
                heads[order][key[:-1]] = heads[order].get(key[:-1], 0) + n
        return found, heads, total

    def probability(model, a, b, c):
        found, heads, total = model
        p = (found[0].get((c,), 0) + urls.PRIOR / urls.SYMBOLS) / (total + urls.PRIOR)
        p = (found[1].get((b, c), 0) + urls.PRIOR * p) / (heads[1].get((b,), 0) + urls.PRIOR)
        return (found[2].get((a, b, c), 0) + urls.PRIOR * p) / (heads[2].get((a, b), 0) + urls.PRIOR)

    good, bad = counts("allow"), counts("block")
    scores = {}
    for u in coded:
        padded = [0, 0] + coded[u]
        logs = [math.log(probability(good, *padded[i : i + 3]) / probability(bad, *padded[i : i + 3])) for i in range(len(coded[u]))]
        scores[u] = sum(logs) / len(logs) if logs else 0.0
    sides = {s: [scores[u] for u, v in rows if v == s] for s in ("allow", "block")}
    (ma, sa), (mb, sb) = ((statistics.mean(x), statistics.pstdev(x)) for x in (sides["allow"], sides["block"]))
    return scores, (ma * sb + mb * sa) / (sa + sb)


def test_scores_and_verdicts_are_those_of_a_plain_model(spark):
    ruled = [(f"http://site{i % 9}.org/page/{i}", "allow") for i in range(40)] + [(f"http://casino{i % 7}.com/de/win?{i}", "block") for i in range(30)]
    free = [(u, None) for u in ("http://site3.net/page/7", "http://casino.net/de/win", "ftp://X.Y/é~", "no scheme", "http://casino5.biz/win?5", "http://site.edu/page")]
    rows = ruled + free + ruled[:5]
    scores, threshold = plain(rows)
    table = spark.createDataFrame([(i, u) for i, (u, _) in enumerate(rows)], "page_id LONG, url STRING")
    got = urls.url_filter(table).collect()
    assert len(got) == len(rows)
    for r in got:
        verdict = dict(rows)[r.url]
        assert abs(r.score - scores[r.url]) < 3e-6
        assert r.verdict == (verdict or ("allow" if scores[r.url] >= threshold else "block"))
    assert len({r.verdict for r in got if not r.rule}) == 2
