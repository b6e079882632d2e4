"""No operator that passes columns through may crash on, lose or change one, whatever its name."""

import re
from pathlib import Path

import pytest

from apronflow.llm import mixing, rules, simhash, urls

FOLDER = Path(mixing.__file__).parent
TEXT = "the quick brown fox jumps over the lazy dog while geese watch from far hills " * 6


def inner_names(*modules):
    """Every quoted or aliased name in the modules' source that could be a column."""
    found = set()
    for module in modules:
        found |= set(re.findall(r"\b_?[a-z][a-z_]{1,20}\b", (FOLDER / f"{module}.py").read_text()))
    return sorted(found)


def table(spark, used, names):
    rows = [{**{c: f"{c} {i}" for c in names}, **row} for i, row in enumerate(used)]
    columns = [*used[0], *names]
    return spark.createDataFrame([tuple(r[c] for c in columns) for r in rows], ", ".join(f"`{c}` {'BIGINT' if c.endswith('_id') and c in used[0] else 'STRING'}" for c in columns))


CASES = {
    "mixing": (["mixing", "hidden"], lambda spark, df: mixing.poisson_mix(df, size=3.0), ["copy", "rate"]),
    "copies": (["mixing", "hidden"], lambda spark, df: mixing.with_copies(df, mixing.source_rates(df)), ["copies", "rate"]),
    "rules": (["rules", "hidden"], lambda spark, df: rules.quality_rules(df, spark.createDataFrame([(1, 1)], "doc_id LONG, quality INT")), rules.RESULTS),
    "simhash": (["simhash", "components", "hidden"], lambda spark, df: simhash.keep_one(df), []),
    "urls": (["urls", "hidden"], lambda spark, df: urls.url_filter(df), urls.RESULTS),
}


@pytest.mark.parametrize("name", CASES)
def test_columns_of_any_name_pass_through(spark, name):
    modules, operator, results = CASES[name]
    if name == "urls":
        used = [{"page_id": i, "url": f"https://a.org/{i}" if i % 2 else f"http://b.de/x{i}"} for i in range(4)]
    else:
        used = [{"doc_id": i, "text": TEXT + "abcdefg"[i] * 40 if i else None, "source": f"s{i % 2}"} for i in range(4)]
    key = next(iter(used[0]))
    names = [c for c in [*inner_names(*modules), "a b", "x.y"] if c not in used[0]]
    df = table(spark, used, names)
    given = {r[key]: r for r in df.collect()}
    out = operator(spark, df)
    passed = [c for c in df.columns if c not in results]
    assert out.columns == [*passed, *results] or sorted(out.columns) == sorted([*passed, *results])
    rows = out.collect()
    assert rows
    for r in rows:
        assert all(r[c] == given[r[key]][c] for c in passed)
