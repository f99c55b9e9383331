"""Runs of the committee reader: expected against found members, what is kept of a run, and its funnel of figures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.classify import role_class
from ..functions.text import concat_skipping_nulls

# Members that a parser should find in a number of lines; of those marked, at least so many.
PER_LINE = {"Two_Name_Affiliation": 1, "Two_Role_NameAff": 1, "OneColumnNameAffiliation": 1, "ThreeLastFirstAffParser": 1}
AT_LEAST = {"TwoLastNameFirstNameParser": 2, "ThreeLastNameFirstNameParser": 3}
HALF = "OneColumnOddNameEvenAffiliation"


def verdict(parser: Column, lines: Column, n: Column) -> Column:
    """PASS or FAIL by the members that so many lines should give, UNKNOWN for other parsers; no count fails."""
    out = F.when(parser == "ZeroParser", n.isNull())
    for name, k in PER_LINE.items():
        out = out.when(parser == name, F.coalesce(k * lines == n, F.lit(False)))
    for name, k in AT_LEAST.items():
        out = out.when(parser == name, F.coalesce(k * lines <= n, F.lit(False)))
    out = out.when(parser == HALF, F.coalesce(F.floor(lines / 2) == n, F.lit(False)))
    return F.when(out.isNull(), "UNKNOWN").when(out, "PASS").otherwise("FAIL")


def validation(files: DataFrame, sections: DataFrame, members: DataFrame) -> DataFrame:
    """One row for each file, section and kind of role.

    files (run_id, id, filename, status, message), sections (run_id, id, file_id, parser, num_section_lines_non_empty,
    num_merged_lines), members (run_id, id, section_id, role, ...). A file passes unless it failed or has no section; sections of
    files that don't pass are left out by the join's condition, so such files keep a row.
    """
    per_section = members.groupBy("run_id", "section_id").agg(F.count("*").alias("n"))
    s = sections.alias("s").join(per_section.alias("m"), (F.col("s.id") == F.col("m.section_id")) & (F.col("s.run_id") == F.col("m.run_id")), "left")
    lines = F.col("s.num_section_lines_non_empty") - F.col("s.num_merged_lines")
    judged = s.select(F.col("s.run_id").alias("run_id"), F.col("s.id").alias("id"), F.col("s.file_id").alias("file_id"), verdict(F.col("s.parser"), lines, F.col("m.n")).alias("section_pass"))

    roles = members.select("run_id", "section_id", F.col("id").alias("member_id"), role_class("role").alias("clean_role"))
    by_role = sections.alias("s").join(roles.alias("r"), (F.col("s.id") == F.col("r.section_id")) & (F.col("s.run_id") == F.col("r.run_id")), "left")
    by_role = by_role.groupBy(F.col("s.run_id").alias("run_id"), F.col("s.id").alias("section_id"), "clean_role").agg(F.count("member_id").alias("num_members"))
    wanted = by_role.groupBy("run_id", "section_id").agg(F.max(F.when(F.col("clean_role") == "program committee", 1).otherwise(0)).alias("section_interested"))
    by_role = by_role.join(wanted, ["run_id", "section_id"])

    counts = sections.groupBy("run_id", "file_id").agg(F.count("*").alias("num_sections"))
    f = files.alias("f").join(counts.alias("c"), (F.col("f.id") == F.col("c.file_id")) & (F.col("f.run_id") == F.col("c.run_id")), "left")
    none = F.coalesce(F.col("num_sections"), F.lit(0)) == 0
    f = f.select(
        F.col("f.run_id").alias("run_id"), F.col("f.id").alias("file_id"),
        F.when(none | (F.col("status") == "FAILED"), 0).otherwise(1).alias("file_pass"),
        F.when(none & F.col("message").isNull(), "No sections").otherwise(F.col("message")).alias("message"),
    )
    out = f.alias("f").join(judged.alias("j"), (F.col("f.file_id") == F.col("j.file_id")) & (F.col("f.file_pass") == 1) & (F.col("f.run_id") == F.col("j.run_id")), "left")
    out = out.join(by_role.alias("b"), (F.col("j.id") == F.col("b.section_id")) & (F.col("j.run_id") == F.col("b.run_id")), "left")
    return out.select("f.run_id", "f.file_id", "f.file_pass", "b.section_interested", "j.section_pass", "f.message", "b.section_id", "b.clean_role", "b.num_members")


def clean_members(files: DataFrame, sections: DataFrame, members: DataFrame, valid: DataFrame) -> DataFrame:
    """Members (filename, role, name) of the latest run whose file and section pass and are of interest.

    A section counts once however many kinds of role it has, so members aren't multiplied.
    """
    latest = files.agg(F.max("run_id").alias("latest"))
    f = files.join(F.broadcast(latest), F.col("run_id") == F.col("latest"))
    ok = valid.where("section_interested = 1 AND section_pass = 'PASS' AND file_pass = 1").select(F.col("file_id").alias("ok_file"), F.col("section_id").alias("ok_section")).distinct()
    d = f.select(F.col("id").alias("f_id"), "filename").join(sections.select(F.col("id").alias("s_id"), "file_id"), F.col("f_id") == F.col("file_id"))
    d = d.join(ok, (F.col("f_id") == F.col("ok_file")) & (F.col("s_id") == F.col("ok_section"))).join(members.drop("run_id"), F.col("s_id") == F.col("section_id"))
    named = (F.col("firstname") != "null") & (F.col("lastname") != "null")
    bare = F.when(F.trim("name").like("%,"), F.trim(F.replace(F.col("name"), F.lit(","), F.lit("")))).otherwise(F.col("name"))
    name = F.when(named, concat_skipping_nulls(F.trim("firstname"), F.lit(" "), F.trim("lastname"))).otherwise(F.trim(F.split_part(bare, F.lit("("), F.lit(1))))
    return d.select("filename", role_class("role").alias("role"), name.alias("name"))


def run_metrics(files: DataFrame, valid: DataFrame) -> DataFrame:
    """Rows (run_id, metrics, count): the funnel from files to members that can be used.

    The validated rows are read once: the five figures that need them are counted from one grouping by file.
    """
    count = lambda d, name: d.groupBy("run_id", name.alias("metrics")).agg(F.count("*").alias("count"))
    total = count(files, F.lit("# files total"))
    why = (
        F.when(F.col("status") == "SUCCEEDED", "OK").when(F.col("message").isin("null", ""), "Unknown")
        .when(F.col("message").like("%organisation%"), F.col("message")).otherwise("Internal error")
    )
    by_status = count(files, F.lower(concat_skipping_nulls(F.lit("# files "), F.col("status"), F.lit(" ("), why, F.lit(")"))))
    passed = valid.where("file_pass = 1")
    wanted, good = F.col("section_interested") == 1, F.col("section_pass") == "PASS"
    per_file = passed.groupBy("run_id", "file_id").agg(F.max("section_interested").alias("any_wanted"), F.count_if(wanted).alias("n_wanted"), F.count_if(wanted & good).alias("n_good"))
    files_wanted = count(per_file, F.when(F.col("any_wanted") == 1, "# files with interesting sections").otherwise("# files without interesting sections"))
    sections_wanted = count(passed, F.when(wanted, "# sections of interest").otherwise("# sections not of interest"))
    files_good = count(per_file.where("n_wanted > 0"), F.when(F.col("n_good") > 0, "# files with interesting parseable sections").otherwise("# files with interesting non-parseable sections"))
    sections_good = count(passed.where(wanted), F.when(good, "# interesting parseable sections").otherwise("# interesting non-parseable sections"))
    usable = passed.where(wanted & good & (F.col("clean_role") != "-"))
    people = usable.groupBy("run_id", concat_skipping_nulls(F.lit("# members of interest extractable ("), F.col("clean_role"), F.lit(")")).alias("metrics")).agg(F.sum("num_members").alias("count"))
    out = total
    for more in (by_status, files_wanted, sections_wanted, files_good, sections_good, people):
        out = out.unionByName(more)
    return out
