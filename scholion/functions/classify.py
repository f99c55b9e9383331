"""Classification by patterns: roles of committee members, kinds of links, DOIs in links."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col

# Labels of links and the patterns that they are known by, the first that fits counting.
LINK_KINDS = [
    ("doi_doi.org", "https://doi.org/%"),
    ("doi_ieee", "http://doi.ieeecomputersociety.org/%"),
    ("doi_acm", "https://dl.acm.org/doi/%"),
    ("wikidata", "https://www.wikidata.org/%"),
    ("openreview", "https://openreview.net/%"),
    ("tandfonline", "https://www.tandfonline.com/doi/abs/%"),
    ("arxiv", "%arxiv%"),
    ("ieee_explore", "%ieeexplore.ieee.org%"),
]
#: What is taken out of a link of each kind to leave the DOI.
DOI_PREFIXES = {
    "doi_doi.org": ["https://doi.org/"],
    "doi_ieee": ["http://doi.ieeecomputersociety.org/"],
    "doi_acm": ["https://dl.acm.org/doi/", "abs/"],
    "tandfonline": ["https://www.tandfonline.com/doi/abs/"],
}
# Roles with the words that must occur (any group of them) and those that must not.
ROLES = [
    ("program chair", [["program", "chair"]], ["co-"]),
    ("program committee", [["program", "committee"]], []),
    ("reviewer", [["review"], ["referee"]], []),
    ("steering committee", [["steering committee"]], []),
    ("program committee", [["member"]], []),
]


def first_match(cases: list[tuple[str, Column]], otherwise: str) -> Column:
    """the label of the first condition that holds."""
    (label, condition), *rest = cases
    out = F.when(condition, label)
    for label, condition in rest:
        out = out.when(condition, label)
    return out.otherwise(otherwise)


def role_class(role: Column | str) -> Column:
    """the kind of role a free text names; "-" for none and for null."""
    text = F.lower(col(role))
    cases = []
    for label, groups, never in ROLES:
        hit = F.lit(False)
        for words in groups:
            here = F.lit(True)
            for w in words:
                here = here & text.contains(w)
            hit = hit | here
        for w in never:
            hit = hit & ~text.contains(w)
        cases.append((label, hit))
    return first_match(cases, "-")


def link_class(link: Column | str, kinds: list[tuple[str, str]] = LINK_KINDS) -> Column:
    """The kind of a link, "unknown" if no pattern fits."""
    return first_match([(label, col(link).like(pattern)) for label, pattern in kinds], "unknown")


def doi_in_link(link: Column | str, kind: Column | str) -> Column:
    """The DOI in a link of a kind that holds one, null for other kinds."""
    out = F.lit(None).cast("string")
    for label, takes in DOI_PREFIXES.items():
        doi = col(link)
        for t in takes:
            doi = F.replace(doi, F.lit(t), F.lit(""))
        out = F.when(col(kind) == label, doi).otherwise(out)
    return out
