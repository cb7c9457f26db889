"""Season files with drifting columns, and fixtures by the votes of their rows."""

from __future__ import annotations

import json
from pathlib import Path

import pytest

from tallyforge.shared import shared_folder
from tallyforge.sources.seasons import read_seasons, voted

COLUMNS = {"element": "int", "minutes": "int", "team": "string", "when": "timestamp_ntz"}


def read(spark, files, **names):
    folder = shared_folder(spark, "csv").removeprefix("file://")
    for name, text in files.items():
        path = Path(folder, name)
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text)
    rows = read_seasons(spark, f"file://{folder}", COLUMNS, "element", names or None).collect()
    return sorted(((r.file, r.element, r.minutes, r.team, r.when and r.when.isoformat(), r.rescued and json.loads(r.rescued)) for r in rows), key=str)


def test_each_file_by_its_own_header(spark):
    files = {
        "season=2018/a.csv": "element,minutes\n1,90\n2,n/a\n3,45.0\n",
        "season=2019/a.csv": " minutes ,xg,element,team\n10,0.5,4,\"Club, \"\"A\"\"\"\n,,5,\n",
        "season=2020/a.csv": "element,mins,when,element,\n6,33,2020-01-02T03:04:05,x,y\n7,44\n8,55,never,9,,z,w\n",
        "b.csv": "element\n9\n\n",
        "no_header.csv": "1,2,3\n",
    }
    assert read(spark, files, minutes=["mins"]) == sorted(
        [
            ("2018", 1, 90, None, None, None), ("2018", 2, None, None, None, {"minutes": "n/a"}), ("2018", 3, 45, None, None, None),
            ("2019", 4, 10, 'Club, "A"', None, {"xg": "0.5"}), ("2019", 5, None, None, None, None),
            ("2020", 6, 33, None, "2020-01-02T03:04:05", {"+1": "y"}), ("2020", 7, 44, None, None, None), ("2020", 8, 55, None, None, {"when": "never", "+2": "z", "+3": "w"}),
            ("b.csv", 9, None, None, None, None),
        ],
        key=str,
    )


def test_a_file_that_is_too_wide_is_an_error(spark):
    with pytest.raises(Exception, match="more columns"):
        read(spark, {"wide.csv": ",".join(["element", *(f"c{i}" for i in range(130))]) + "\n1\n"})


def test_votes(spark):
    rows = [(1, "2", 3.5), (1, "2", None), (1, "9", 3.5), (2, "b", 1.0), (2, "a", 1.0), (3, None, None), (None, "x", 2.0)]
    got = {r.k: (r.s, r.v, r.n_rows, r.agreement and round(r.agreement, 3)) for r in voted(spark.createDataFrame(rows, "k int, s string, v double"), ["k"], ["s", "v"]).collect() if r.k is not None}
    assert got == {1: ("2", 3.5, 3, 0.667), 2: ("a", 1.0, 2, 0.5), 3: (None, None, 1, None)}
    assert voted(spark.createDataFrame([], "k int, s string, v double"), ["k"], ["s"]).count() == 0


def test_only_as_many_cells_are_read_as_lines_have(spark):
    folder = shared_folder(spark, "csv").removeprefix("file://")
    Path(folder).mkdir(parents=True)
    Path(folder, "a.csv").write_text('element,minutes\n1,90,"x,y"\n')
    rows = read_seasons(spark, f"file://{folder}", COLUMNS, "element")
    assert [(r.element, r.minutes, json.loads(r.rescued)) for r in rows.collect()] == [(1, 90, {"+1": "x,y"})]
    assert "_c4" not in rows._jdf.queryExecution().optimizedPlan().toString()
