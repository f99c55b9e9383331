"""Layouts of committee sections: shapes of grids, chosen parsers, members."""

import pytest
from pyspark.sql import functions as F

from scholion.operators import grid

NAMES = [("Moss", "Ada"), ("Brook", "Ben"), ("Field", "Cleo"), ("Stone", "Dan")]
three = [f"      {f'{a}, {b}':<22}{f'{b}er, {a}':<22}{f'{a}son, X'}".rstrip() for a, b in NAMES]
CASES = {
    "none": ([], "ZeroParser", 0),
    "name and affiliation": (["", "   Ada Moss            University of Hill, Land", "   Ben Brook           College of Dale, Land", "", ""], "Two_Name_Affiliation", 2),
    "single line": (["      Ada B. Moss        Nile University, Egypt "], "Two_Name_Affiliation", 1),
    "three columns of names, ragged": (three[:3] + [three[3][:44].rstrip()], "ThreeLastNameFirstNameParser", 11),
    "two columns of names": ([x[:44] for x in three], "TwoLastNameFirstNameParser", 8),
    "last, first, affiliation": (["Moss       Ada       Hill University", "Brook      Ben       Dale College", "Field      Cleo      Some Universit"], "ThreeLastFirstAffParser", 3),
    "names and affiliations in turn": (["Ada Moss", "Hill, Land & Sea, President", "      ", "Ben Brook   ", "Dale College, Land  ", "   "], "OneColumnOddNameEvenAffiliation", 2),
    "one column": (["Ada Moss, University of Hill, Land", "Ben Brook, Dale, Land"], "OneColumnNameAffiliation", 2),
    "roles": (["   Honorary Chairs     Ada Moss (Hill Academy,", "                           Land)", "                       Ben Brook (Dale)", "", "   General Chairs      Cleo Field (Sea)", "                       Dan Stone (University of", "                          Air)"], "Two_Role_NameAff", 4),
    "four columns": (["a      b       c       d"], None, 0),
}


@pytest.fixture(scope="module")
def found(spark):
    d = spark.createDataFrame([(k, "Committee", v[0]) for k, v in CASES.items()], "case string, title string, content array<string>")
    return {r["case"]: r for r in grid.parsed(d).collect()}


@pytest.mark.parametrize("case", CASES)
def test_parser_and_members(found, case):
    r, (_, parser, n) = found[case], CASES[case]
    assert (r["parser"], r["n_members"]) == (parser, n)
    assert r["status"] == ("SUCCEEDED" if parser else "FAILED") and (parser or r["message"])


def test_members_fields(found):
    roles = found["roles"]["members"]
    assert [(m["role"], m["name"], m["affiliation"]) for m in roles] == [("Honorary Chairs", "Ada Moss", "Hill Academy, Land"), ("Honorary Chairs", "Ben Brook", "Dale"), ("General Chairs", "Cleo Field", "Sea"), ("General Chairs", "Dan Stone", "University of Air")]
    m = found["last, first, affiliation"]["members"][0]
    assert (m["firstname"], m["lastname"], m["affiliation"], m["role"]) == ("Ada", "Moss", "Hill University", "Committee")
    assert found["names and affiliations in turn"]["members"][0]["affiliation"] == "Hill, Land & Sea, President"
    assert found["one column"]["members"][0]["affiliation"] == "University of Hill, Land" and found["one column"]["members"][0]["name"] == "Ada Moss"
    assert found["two columns of names"]["members"][0]["lastname"] == "Moss"


@pytest.mark.parametrize(
    ("content", "shape", "cell"),
    [
        (["Moss      Ada      Hill University"], (1, 3), None),
        (["Moss      Ada      Hill University", "       ", "   ", "Brook           Ben            Dale"], (2, 3), None),
        (["  Moss      Ada       National University of   ", "                         Hill"], (1, 3), (0, 2, "National University of Hill")),
        (["  Moss      Ada       National University of   ", "     a         b         c"], (1, 3), (0, 0, "Moss a")),
        (three[:3] + [three[3][:44].rstrip()], (4, 3), None),
        (["Ada Moss", "Hill", "   ", "Ben Brook  ", "Dale", "  "], (4, 1), None),
    ],
)
def test_shapes(spark, content, shape, cell):
    r = grid.grids(spark.createDataFrame([(content,)], "content array<string>")).select("rows", "n_merged", grid.n_columns(F.col("rows")).alias("n")).first()
    assert (len(r["rows"]), r["n"]) == shape
    if cell:
        assert r["rows"][cell[0]][cell[1]] == cell[2] and r["n_merged"] == 1


def test_failures_keep_their_row(spark):
    d = spark.createDataFrame([(["a    b", "a    b    c"],), (["            a", "   b"],), (None,), ([None, "  "],)], "content array<string>")
    got = grid.grids(d).collect()
    assert [r["status"] for r in got] == ["FAILED", "FAILED", "SUCCEEDED", "SUCCEEDED"] and all(r["message"] for r in got[:2])


def test_navigation_and_statistics(spark):
    rows = [["1", "2", "3"], ["4", None, "6"], ["7", "8"]]
    d = spark.createDataFrame([("k", rows)], "k string, rows array<array<string>>")
    c = F.col("rows")
    r = d.select(grid.at(c, 1, 2), grid.at(c, 2, 2), grid.above(c, 0, 0), grid.below(c, 0, 1), grid.above(c, 2, 1), grid.column_of(c, 2), grid.row_of(c, 1)).first()
    assert tuple(r)[:5] == ("6", None, None, None, None) and r[5] == ["3", "6", None] and r[6] == ["4", None, "6"]
    s = {(x["column_number"], x["rows_of"], x["ratio_of"]): x["ratio"] for x in grid.column_statistics(spark.createDataFrame([("k", [["a,", "College"], ["b"], ["c,", "d"]])], "k string, rows array<array<string>>")).collect()}
    assert s[0, "ALL", "comma"] == pytest.approx(2 / 3) and s[0, "EVEN", "comma"] == 0 and s[1, "ODD", "affiliation"] == 1 and s[1, "EVEN", "affiliation"] == 0 and (2, "ALL", "comma") not in s


def test_glyphs_to_lines(spark):
    from scholion.operators import glyphs

    def line(page, y, text, x=40.0, scale=10.0, bold=False, width=5.0):
        return [("d", page, x + width * k, y, width, 8.0, c, scale, bold) for k, c in enumerate(text) if c != "_"]

    rows = [*line(1, 100.0, "Title", scale=14.0, bold=True), *line(1, 102.0, "Ada", x=200.0), *line(1, 112.0, "ab_cd"), *line(1, 150.0, "last"), *line(2, 20.0, "next")]
    d = spark.createDataFrame(rows, "doc string, page int, x double, y double, width double, height double, text string, scale double, bold boolean")
    got = {r["line_no"]: r for r in glyphs.lines(d).collect()}
    pad = " " * 10
    assert [got[k]["text"] for k in sorted(got)] == [f"{pad}Title{' ' * 35}Ada", f"{pad}ab cd", "", "", f"{pad}last", f"{pad}next"]
    assert got[0]["n_chars"] == 8 and got[0]["scale"] == 10.0 and got[2]["scale"] == 0 and [got[k]["page"] for k in sorted(got)] == [1, 1, 1, 1, 1, 2]
    assert glyphs.lines(d.limit(0)).count() == 0
