"""Plans of registered queries, those of tables written on the way among them: what their windows and joins run over."""

import re

import pytest
from framesift import storage
from framesift.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"
#: Keys that bound a window: a stretch of time, of a run or of places, or a range of rows.
BOUNDS = {"stretch", "sub", "_part", "_stretch", "part"}
#: Queries that add totals of one row.
TOTALS = {"export_report", "phase_shares", "photo_page_name", "photo_page_rating"}


def keys_of(line):
    """Names of the partition keys of a window, from its line of the plan: the second list from its end."""
    lists, depth, end = [], 0, len(line)
    for i in range(len(line) - 1, -1, -1):
        if line[i] == "]":
            if depth == 0:
                end = i
            depth += 1
        elif line[i] == "[":
            depth -= 1
            if depth == 0:
                lists.append(line[i + 1 : end])
    parts = [x for x in lists if "windowspecdefinition" not in x]
    order = next((k for k, x in enumerate(parts) if re.search(r" (ASC|DESC) NULLS", x)), -1)
    keys = parts[order + 1] if order + 1 < len(parts) else ""
    return set(re.findall(r"(\w+)#\d+", keys))


def rows_below(lines, i):
    """The first operator below a window that says what its rows are: neither a projection, a filter, nor another window."""
    for line in lines[i + 1 :]:
        name = re.sub(r"^[\s:+|-]*", "", line)
        if not re.match(r"(Project|Filter|Window|Sort|Repartition\w*) ", name):
            return name
    return ""


@pytest.fixture
def plans(monkeypatch):
    """The plans of all tables that are written while a query is made."""
    seen, write = [], storage.written

    def spy(df, *by):
        seen.append(df._jdf.queryExecution().optimizedPlan().toString())
        return write(df, *by)

    monkeypatch.setattr(storage, "written", spy)
    return seen


def test_keys_of():
    line = "Window [lag(a#1, -1, null) windowspecdefinition(p#2, stretch#3L, t#4 ASC NULLS FIRST, specifiedwindowframe(RowFrame, -1, -1)) AS x#5], [p#2, stretch#3L], [t#4 ASC NULLS FIRST]"
    assert keys_of(line) == {"p", "stretch"}
    assert keys_of("Window [sum(n#1L) windowspecdefinition(p#2, k#3 ASC NULLS FIRST, specifiedwindowframe(RowFrame, unboundedpreceding$(), -1)) AS b#4L], [p#2], [k#3 ASC NULLS FIRST]") == {"p"}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_windows_and_joins(spark, plans, name):
    """Windows run over a stretch or a range of rows, or over rows that were summed before; joins are by keys."""
    last = QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    for plan in (*plans, last):
        lines = plan.split("\n")
        for i, line in enumerate(lines):
            if re.search(r"\bWindow \[", line):
                assert BOUNDS & keys_of(line) or rows_below(lines, i).startswith("Aggregate"), (keys_of(line), rows_below(lines, i)[:100], line[:300])
    assert ("Join Cross" in last) == (name in TOTALS)
