"""Committee sections: lines of laid-out text to a ragged grid, to column statistics, to members.

A section is one row with its lines as an array, so sections are spread over all tasks and nothing is grouped twice. Grids are built by
one vectorised Python function; everything after that (ratios, choice of parser, members) is made of DataFrame expressions
on the array of cells. A section that can't be read keeps its row, with a status and a message.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import first_group

# Words by which columns are recognised, in lower case; "instut" is spelt as the thresholds were tuned.
COMMA, AFFILIATION, CHAIR = [","], ["universi", "instut", "college"], ["chair"]
# Names of the parsers.
PARSERS = ["ZeroParser", "OneColumnNameAffiliation", "OneColumnOddNameEvenAffiliation", "Two_Name_Affiliation", "Two_Role_NameAff", "TwoLastNameFirstNameParser", "ThreeLastFirstAffParser", "ThreeLastNameFirstNameParser"]
GRID = "status string, message string, rows array<array<string>>, n_lines int, n_merged int"


def build(lines: list[str]) -> tuple[list[list[str | None]], int]:
    """(rows of cells, merged lines) of a section's lines.

    The first line after a blank one tells where columns start. A line whose parts all stand there is a row; otherwise each part
    belongs to the last column that starts at or before it, give or take one place: at the column's start it is a
    cell, further right it continues the cell above.
    """
    rows: list[list[str | None]] = []
    starts: list[int] = []
    learn, merged = True, 0
    for line in lines:
        if not line.strip():
            learn = True
            continue
        found = list(re.finditer(r"\S+(?:\s\S+)*", line))
        parts, at = [m[0] for m in found], [m.start() for m in found]
        if learn:
            starts, learn = at, False
        if len(parts) > len(starts):
            raise ValueError("more cells than columns")
        if at == starts:
            rows.append(list(parts))
            continue
        row: list[str | None] = []
        joined = False
        for text, x in zip(parts, at, strict=True):
            column = max((k for k, s in enumerate(starts) if s <= x + 1), default=None)
            if column is None:
                raise ValueError("a cell left of all columns")
            if abs(x - starts[column]) <= 1:
                row += [None] * (column + 1 - len(row))
                row[column] = text
                continue
            above = rows[-1] if rows else []
            if column >= len(above) or above[column] is None:
                raise ValueError("nothing above to continue")
            above[column] += " " + text
            joined = True
        merged += joined
        if row:
            rows.append(row)
    return rows, merged


def grids(sections: DataFrame, lines: str = "content") -> DataFrame:
    """Sections with status, message, rows (arrays of cells, null where a row has none), n_lines and n_merged.

    n_lines counts lines that aren't blank. Null contents are empty. A section whose layout has no reading has status FAILED,
    the reason as message, and no rows.
    """
    fields = [f for f in sections.schema.fields if f.name not in ("status", "message", "rows", "n_lines", "n_merged")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for content in b[lines]:
                content = [] if content is None else ["" if x is None else x for x in content]
                n = sum(bool(x.strip()) for x in content)
                try:
                    rows, merged = build(content)
                    out.append(("SUCCEEDED", None, rows, n, merged))
                except ValueError as e:
                    out.append(("FAILED", str(e), [], n, 0))
            yield b.assign(**dict(zip(("status", "message", "rows", "n_lines", "n_merged"), map(list, zip(*out, strict=True)), strict=True))) if out else b.assign(status=[], message=[], rows=[], n_lines=[], n_merged=[])

    kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
    return sections.select(*[f.name for f in fields]).mapInPandas(run, f"{kind}, {GRID}")


def n_columns(rows: Column) -> Column:
    return F.coalesce(F.array_max(F.transform(rows, F.size)), F.lit(0))


def cell_ratio(rows: Column, column: int, words: list[str], parity: str = "ALL") -> Column:
    """Share of a column's cells that hold one of the words; null if there is no cell to look at.

    Odd and even count the rows long enough to have the column, from 1; cells that are null are left out.
    """
    having = F.filter(rows, lambda r: F.size(r) > column)
    if parity != "ALL":
        having = F.filter(having, lambda r, i: (i % 2) == (0 if parity == "ODD" else 1))
    cells = F.filter(F.transform(having, lambda r: F.get(r, F.lit(column))), lambda c: c.isNotNull())

    def fits(c: Column) -> Column:
        out = F.lit(False)
        for w in words:
            out = out | F.lower(c).contains(w)
        return out

    return F.when(F.size(cells) > 0, F.size(F.filter(cells, fits)) / F.size(cells))


def column_statistics(grid: DataFrame, columns: int = 3) -> DataFrame:
    """Three ratios by column and parity, one row each, only where there is something to count."""
    out = []
    for k in range(columns):
        for parity in ("ALL", "ODD", "EVEN"):
            for name, words in (("comma", COMMA), ("affiliation", AFFILIATION), ("chair", CHAIR)):
                out.append(F.struct(F.lit(k).alias("column_number"), F.lit(parity).alias("rows_of"), F.lit(name).alias("ratio_of"), cell_ratio(F.col("rows"), k, words, parity).alias("ratio")))
    keys = [c for c in grid.columns if c not in ("content", "rows", "status", "message", "n_lines", "n_merged")]
    return grid.select(*keys, F.inline(F.array(*out))).where("ratio IS NOT NULL")


def chosen_parser(rows: Column) -> Column:
    """P10: which parser reads a grid; null if none does."""
    r = lambda k, words, parity="ALL": F.coalesce(cell_ratio(rows, k, words, parity), F.lit(0.0))
    n = n_columns(rows)
    one = (
        F.when((r(0, AFFILIATION, "ODD") == 0) & (cell_ratio(rows, 0, AFFILIATION, "EVEN") > 0), "OneColumnOddNameEvenAffiliation")
        .when(r(0, COMMA) >= 1, "OneColumnNameAffiliation")
    )
    two = (
        F.when(r(0, CHAIR) > 0.5, "Two_Role_NameAff")
        .when((r(0, COMMA) < 0.4) & (r(1, COMMA) > 0.4), "Two_Name_Affiliation")
        .otherwise("TwoLastNameFirstNameParser")
    )
    three = F.when((r(0, AFFILIATION) <= 0) & (r(1, AFFILIATION) <= 0) & (r(2, AFFILIATION) > 0), "ThreeLastFirstAffParser").otherwise("ThreeLastNameFirstNameParser")
    return F.when(n == 0, "ZeroParser").when(n == 1, one).when(n == 2, two).when(n == 3, three)


MEMBER = "struct<role: string, name: string, firstname: string, lastname: string, affiliation: string>"


def _member(role=None, name=None, first=None, last=None, affiliation=None) -> Column:
    text = lambda c: F.lit(None).cast("string") if c is None else F.trim(c)
    return F.struct(*[text(c).alias(n) for n, c in (("role", role), ("name", name), ("firstname", first), ("lastname", last), ("affiliation", affiliation))])


def members_of(rows: Column, parser: Column) -> Column:
    """The members that a parser finds in a grid, as an array."""
    cell = lambda r, k: F.get(r, F.lit(k))
    flat = F.filter(F.flatten(rows), lambda c: c.isNotNull())

    def last_first(c: Column) -> Column:
        parts = F.filter(F.split(c, ","), lambda p: p != "")
        two = F.size(parts) >= 2
        return _member(name=c, first=F.when(two, F.get(parts, F.lit(1))), last=F.when(two, F.get(parts, F.lit(0))))

    def name_then_affiliation(c: Column) -> Column:
        at = F.instr(c, ",")
        return _member(name=F.when(at > 0, F.substring(c, F.lit(1), at - 1)).otherwise(c), affiliation=F.when(at > 0, F.substr(c, at + 1)))

    pairs = F.filter(F.transform(rows, lambda r, i: F.struct(i.alias("i"), cell(r, 0).alias("name"), cell(F.get(rows, i + 1), 0).alias("aff"))), lambda p: (p["i"] % 2 == 0) & (p["i"] + 1 < F.size(rows)))

    def carry(acc: Column, r: Column) -> Column:
        role = F.coalesce(cell(r, 0), acc["role"])
        here = _member(role=role, name=F.split_part(cell(r, 1), F.lit("("), F.lit(1)), affiliation=first_group(cell(r, 1), r"\((.*?)\)"))
        found = F.when(cell(r, 1).isNotNull(), F.concat(acc["found"], F.array(here))).otherwise(acc["found"])
        return F.struct(role.alias("role"), found.alias("found"))

    carried = F.aggregate(rows, F.struct(F.lit(None).cast("string").alias("role"), F.array().cast(f"array<{MEMBER}>").alias("found")), carry)["found"]
    filled = F.filter(rows, lambda r: cell(r, 0).isNotNull())
    return (
        F.when(parser == "OneColumnNameAffiliation", F.transform(flat, name_then_affiliation))
        .when(parser == "OneColumnOddNameEvenAffiliation", F.transform(pairs, lambda p: _member(name=p["name"], affiliation=p["aff"])))
        .when(parser == "Two_Name_Affiliation", F.transform(filled, lambda r: _member(name=cell(r, 0), affiliation=cell(r, 1))))
        .when(parser == "Two_Role_NameAff", carried)
        .when(parser.isin("TwoLastNameFirstNameParser", "ThreeLastNameFirstNameParser"), F.transform(flat, last_first))
        .when(parser == "ThreeLastFirstAffParser", F.transform(filled, lambda r: _member(name=F.concat_ws(", ", F.trim(cell(r, 0)), F.trim(cell(r, 1))), first=cell(r, 1), last=cell(r, 0), affiliation=cell(r, 2))))
        .otherwise(F.array().cast(f"array<{MEMBER}>"))
    )


def parsed(sections: DataFrame, lines: str = "content", title: str = "title") -> DataFrame:
    """Sections with grid, parser and members; a member without a role of its own has the section's title."""
    g = grids(sections, lines).withColumn("parser", F.when(F.col("status") == "SUCCEEDED", chosen_parser(F.col("rows"))))
    unread = (F.col("status") == "SUCCEEDED") & F.col("parser").isNull()
    g = g.withColumns({"message": F.when(unread, "no parser for this layout").otherwise(F.col("message")), "status": F.when(unread, "FAILED").otherwise(F.col("status"))})
    m = F.transform(members_of(F.col("rows"), F.col("parser")), lambda x: x.withField("role", F.coalesce(x["role"], F.col(title))))
    return g.withColumns({"n_columns": n_columns(F.col("rows")), "members": m}).withColumn("n_members", F.size("members"))


def members(found: DataFrame, *keys: str) -> DataFrame:
    """One row a member: keys, member_no, role, name, firstname, lastname, affiliation."""
    return found.select(*keys, F.posexplode("members").alias("member_no", "m")).select(*keys, "member_no", "m.*")


# Navigation of a grid, rows and columns from 0; null outside it.
def at(rows: Column, row: int | Column, column: int | Column) -> Column:
    lit = lambda x: F.lit(x) if isinstance(x, int) else x
    return F.get(F.get(rows, lit(row)), lit(column))


def row_of(rows: Column, row: int) -> Column:
    return F.get(rows, F.lit(row))


def column_of(rows: Column, column: int) -> Column:
    """The cells of a column, null where a row is too short."""
    return F.transform(rows, lambda r: F.get(r, F.lit(column)))


def above(rows: Column, row: int, column: int) -> Column:
    return at(rows, row - 1, column) if row > 0 else F.lit(None).cast("string")


def below(rows: Column, row: int, column: int) -> Column:
    return at(rows, row + 1, column)
