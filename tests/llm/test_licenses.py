"""Statements, and inheritance against walking up the path."""

import math

import pytest

from llm import licenses

SCHEMA = "path string, text string, license string"
ROWS = [
    ("a/LICENSE", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction."),
    ("a/x/one.txt", "plain words here"),
    ("a/x/y/two.txt", "more words\nLicensed under the Apache License, Version 2.0.\n" + "tail " * 300),
    ("a/x/y/three.txt", None),
    ("a/x/y/z/NOTICE.md", "Licensed under CC BY-NC 4.0."),
    ("a/x/y/z/four.txt", ""),
    ("b/five.txt", "the licence of the driver was lost on the way to the house by the sea near the old mill"),
    ("b/c/six.txt", "short\nReleased under the MIT License."),
    ("b/c/seven.txt", "nothing"),
    ("b/c/aa.txt", "GPL\nThis work is licensed under the GNU General Public License, version 3."),
    ("top.txt", "x"),
    (None, "Released under the MIT License."),
    (None, "no statement"),
    ("b/c/seven.txt", "nothing"),
    ("long.txt", "word " * 200000),
]


def by_path(spark):
    rows = spark.createDataFrame([(*r, "clash") for r in ROWS], SCHEMA)
    return licenses.license_files(rows, []).collect()


def test_statements_and_inheritance(spark):
    got = by_path(spark)
    assert len(got) == len(ROWS)
    rows = {r["path"]: r for r in got if r["path"]}
    assert rows["a/LICENSE"]["own_license"] == "MIT" and rows["a/LICENSE"]["license_file"]
    assert (rows["a/x/one.txt"]["license"], rows["a/x/one.txt"]["license_from"]) == ("MIT", "a")
    assert rows["a/x/y/two.txt"]["license"] == "Apache-2.0" and not rows["a/x/y/two.txt"]["license_file"]
    assert (rows["a/x/y/three.txt"]["license"], rows["a/x/y/three.txt"]["license_from"]) == ("MIT", "a")
    assert (rows["a/x/y/z/four.txt"]["license"], rows["a/x/y/z/four.txt"]["license_from"]) == ("CC-BY-NC-4.0", "a/x/y/z")
    assert rows["b/five.txt"]["license"] is None and rows["top.txt"]["license"] is None and rows["long.txt"]["license"] is None
    best = min((r for r in got if r["path"] in ("b/c/six.txt", "b/c/aa.txt")), key=lambda r: (-r["own_score"], r["path"]))
    assert rows["b/c/seven.txt"]["license"] == best["own_license"]
    assert sorted(str(r["license"]) for r in got if r["path"] is None) == ["MIT", "None"]


def test_cosine_by_hand():
    matcher = licenses.Matcher(9, {b"mit": 1, b"the": 9}, {"MIT": ["the mit"]})
    idf = {"the": math.log(10 / 10) + 1, "mit": math.log(10 / 2) + 1, "z": math.log(10) + 1}
    dot = 2 * idf["the"] * idf["the"] + idf["mit"] * idf["mit"]
    want = dot / math.hypot(idf["the"], idf["mit"]) / math.sqrt(4 * idf["the"] ** 2 + idf["mit"] ** 2 + idf["z"] ** 2)
    assert matcher.best([b"the", b"the", b"mit", b"z"])[0] == pytest.approx(want)


def test_empty_table(spark):
    assert licenses.license_files(spark.createDataFrame([], SCHEMA), []).count() == 0
