"""Registered queries as Python: what their functions read when they run."""

import ast
from collections import Counter
from pathlib import Path

import pytest

from tallymart.plans import catalogue

PLANS = sorted(Path(catalogue.__file__).parent.glob("q_*.py"))


def bound(node):
    return [n.id for n in ast.walk(node) if isinstance(n, ast.Name) and isinstance(n.ctx, ast.Store)]


@pytest.mark.parametrize("path", PLANS, ids=lambda p: p.stem)
def test_no_query_reads_a_name_that_is_bound_again(path):
    """A lambda reads a module's names when it runs, so the last value counts, not the one at its registration."""
    tree = ast.parse(path.read_text())
    times = Counter(x for s in tree.body if isinstance(s, ast.Assign | ast.For) for t in (s.targets if isinstance(s, ast.Assign) else [s.target]) for x in bound(t))
    times += Counter(x for s in tree.body if isinstance(s, ast.For) for x in {*bound(s.target)})
    again = {x for x, n in times.items() if n > 1}
    for made in (n for s in tree.body for n in ast.walk(s) if isinstance(n, ast.Lambda) and not isinstance(s, ast.FunctionDef)):
        own = {a.arg for a in made.args.args} | {*bound(made.body)}
        late = {n.id for n in ast.walk(made.body) if isinstance(n, ast.Name) and n.id in again} - own
        # lambdas that only write SQL run at once; queries take a session and a folder, or the tables of a model
        if [a.arg for a in made.args.args][:2] == ["s", "d"]:
            assert not late, f"line {made.lineno}: {late}"


def test_top_values_of_texts(spark, sf):
    got = {r.column: r.frequency for r in catalogue.QUERIES["top_value_per_column"](spark, sf).collect()}
    assert set(got) == {"review_comment_title", "review_comment_message"} and min(got.values()) > 0
