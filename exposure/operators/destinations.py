"""Grade how a kind of personal data fits the site it was headed for.

Grades are context only: they never change a score and never drop a finding.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from exposure import dims
from exposure.functions.basics import first, lit_map, pick

PLACES = {
    host: (kind, name) for kind, sites in dims.DESTINATIONS.items() for host, name in sites.items()
}


def origin_host(origin: Column) -> Column:
    """Scheme, path, query, credentials and port removed; dots trimmed."""
    v = F.lower(F.trim(origin))
    v = F.regexp_replace(v, r"^(?s)(?:(?!//).)*//", "")
    v = F.substring_index(F.substring_index(v, "/", 1), "?", 1)
    v = F.substring_index(F.regexp_replace(v, r"^.*@", ""), ":", 1)
    return F.btrim(v, F.lit("."))


def destination(host: Column) -> Column:
    """``struct<kind, name>`` of the most specific known suffix, cut at label borders."""
    labels = F.split(host, r"\.")
    n = F.size(labels)
    kinds = lit_map({h: kind for h, (kind, _) in PLACES.items()})
    names = lit_map({h: name for h, (_, name) in PLACES.items()})
    suffixes = F.transform(
        F.sequence(F.lit(1), F.greatest(F.lit(1), n - 1)),
        lambda i: F.array_join(F.slice(labels, i, n), "."),
    )
    known = first(F.filter(suffixes, lambda s: s.isin(*PLACES)))
    return F.struct(
        F.coalesce(F.try_element_at(kinds, known), F.lit("unknown")).alias("kind"),
        F.coalesce(
            F.try_element_at(names, known), F.nullif(host, F.lit("")), F.lit("this page")
        ).alias("name"),
    )


def family(pii_type: Column) -> Column:
    return pick(dims.PII_FAMILIES, pii_type)


def fit(pii_type: Column, kind: Column) -> Column:
    """never / rarely / expected, or unknown for a strange place or a strange type."""
    table = {}
    for name, row in dims.FIT_MATRIX.items():
        for place, grade in row.items():
            table[f"{name}|{place}"] = grade
    return F.coalesce(
        F.try_element_at(lit_map(table), F.concat(family(pii_type), F.lit("|"), kind)),
        F.lit("unknown"),
    )


def phrase(pii_type: Column, label: Column) -> Column:
    """What was found, for use in a sentence: stored per type, else the label in quotes."""
    named = F.concat(F.lit("data of the kind \u201c"), F.trim(label), F.lit("\u201d"))
    return F.coalesce(pick(dims.PII_PHRASES, pii_type), F.when(F.trim(label) != "", named), F.lit("such data"))


def _capital(text: Column) -> Column:
    return F.concat(F.upper(F.substring(text, 1, 1)), F.substr(text, F.lit(2)))


def note(grade: Column, thing: Column, kind: Column, name: Column) -> Column:
    return (
        F.when(grade == "never", F.concat(_capital(thing), F.lit(" does not belong on "), name, F.lit(".")))
        .when(grade == "rarely", F.concat(name, F.lit(" seldom needs "), thing, F.lit(".")))
        .when(grade == "expected", F.concat(name, F.lit(" normally takes "), thing, F.lit(".")))
        .when(
            kind != "unknown",
            F.concat(F.lit("Whether "), thing, F.lit(" belongs on "), name, F.lit(" is not known.")),
        )
        .otherwise(
            F.concat(name, F.lit(" is not a known site; nothing says "), thing, F.lit(" is safe there."))
        )
    )


def grade_destinations(findings: DataFrame, origin_col: str = "site_origin") -> DataFrame:
    """Add destination class, name, fit and note to findings.  A map: no join, no shuffle."""
    place = F.col("_place")
    return (
        findings.withColumn("_place", destination(origin_host(F.col(origin_col))))
        .withColumn("destination_kind", place["kind"])
        .withColumn("destination_label", pick(dims.CLASS_LABELS, place["kind"]))
        .withColumn("destination_name", place["name"])
        .withColumn("destination_fit", fit(F.col("pii_type"), place["kind"]))
        .withColumn(
            "destination_note",
            note(
                F.col("destination_fit"), phrase(F.col("pii_type"), F.col("label")),
                place["kind"], place["name"],
            ),
        )
        .drop("_place")
    )


def exposure_crosstab(graded: DataFrame) -> DataFrame:
    """Findings counted by family, destination class and fit."""
    return graded.groupBy(
        F.coalesce(family(F.col("pii_type")), F.lit("other")).alias("family"),
        F.col("destination_kind"),
        F.col("destination_fit"),
    ).agg(F.count("*").alias("findings"))
