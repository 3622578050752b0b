"""Hosts, registrable domains and brand impersonation, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from exposure import dims
from exposure.functions.basics import first, lit_array, lit_map

BRAND = "struct<kind:string,brand:string>"


def url_scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.\-]*):", 1))


def url_netloc(url: Column) -> Column:
    return F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//([^/?#]*)", 1)


def url_path(url: Column) -> Column:
    return F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//[^/?#]*([^?#]*)", 1)


def url_host(url: Column) -> Column:
    """Lower-case host without credentials and port; empty if there is none."""
    bare = F.regexp_replace(F.lower(url_netloc(url)), r"^.*@", "")
    return F.when(
        bare.rlike(r"^\["), F.regexp_extract(bare, r"^\[([^\]]*)\]", 1)
    ).otherwise(F.substring_index(bare, ":", 1))


def with_scheme(url: Column) -> Column:
    return F.when(F.contains(url, F.lit("//")), url).otherwise(F.concat(F.lit("https://"), url))


def site_origin(url: Column) -> Column:
    """``scheme://host`` of anything URL-shaped; other text is kept whole."""
    parts = F.split(F.trim(url), "/")
    shaped = (F.size(parts) >= 3) & (F.get(parts, F.lit(1)) == "")
    return F.when(
        shaped, F.concat(F.get(parts, F.lit(0)), F.lit("//"), F.get(parts, F.lit(2)))
    ).otherwise(F.trim(url))


def is_checkable(url: Column) -> Column:
    return url.rlike("(?i)^https?://")


def registrable(host: Column) -> Column:
    """The part of a host someone registered: two labels, three under a multi-label suffix."""
    clean = F.substring_index(F.regexp_replace(F.lower(F.trim(host)), r"\.+$", ""), ":", 1)
    labels = F.filter(F.split(clean, r"\."), lambda p: p != "")
    two = F.array_join(F.slice(labels, -2, 2), ".")
    three = F.array_join(F.slice(labels, -3, 3), ".")
    return (
        F.when(F.size(labels) <= 2, F.array_join(labels, "."))
        .when(two.isin(dims.MULTI_LABEL_SUFFIXES), three)
        .otherwise(two)
    )


def host_tokens(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda t: t != "")


def fold_glyphs(token: Column) -> Column:
    """Lookalike spelling folded to what it imitates: ``paypa1`` gives ``paypal``."""
    out = F.translate(token, dims.GLYPH_FROM, dims.GLYPH_TO)
    for pair, letter in dims.GLYPH_PAIRS:
        out = F.replace(out, F.lit(pair), F.lit(letter))
    return out


def lures_in(host: Column) -> Column:
    return F.array_sort(F.array_intersect(F.array_distinct(host_tokens(host)), lit_array(dims.LURE_TOKENS)))


def owns(brand: Column, domain: Column) -> Column:
    return F.array_contains(F.try_element_at(lit_map(dims.BRAND_DOMAINS), brand), domain)


def is_brand(token: Column) -> Column:
    return token.isin(*dims.BRAND_DOMAINS)


def check_brand(host: Column) -> Column:
    """``struct<kind, brand>`` of the first decisive token, NULL if none is.

    ``own``: a brand on its own domain, which ends the search.  ``named``: a brand's
    name on somebody else's domain.  ``lookalike``: the same in disguised spelling.
    An ambiguous brand without a lure decides nothing.
    """
    clean = F.substring_index(F.lower(F.trim(host)), ":", 1)
    domain = registrable(clean)
    lured = F.size(lures_in(clean)) > 0

    def decide(token: Column) -> Column:
        folded = fold_glyphs(token)

        def say(kind: str, brand: Column) -> Column:
            return F.struct(F.lit(kind).alias("kind"), brand.alias("brand"))

        return (
            F.when(is_brand(token) & owns(token, domain), say("own", token))
            .when(is_brand(token) & token.isin(dims.AMBIGUOUS_BRANDS) & ~lured, F.lit(None))
            .when(is_brand(token), say("named", token))
            .when(is_brand(folded) & ~owns(folded, domain), say("lookalike", folded))
        )

    decided = F.filter(F.transform(host_tokens(clean), decide), lambda d: d.isNotNull())
    return first(decided).cast(BRAND)


def brand_suspected(host: Column) -> Column:
    """Cheap necessary test for :func:`check_brand` to give ``named`` or ``lookalike``."""
    return fold_glyphs(F.lower(host)).rlike("|".join(_folded_brands()))


def _folded_brands() -> list[str]:
    table = str.maketrans(dims.GLYPH_FROM, dims.GLYPH_TO)
    out = []
    for brand in dims.BRAND_DOMAINS:
        name = brand.translate(table)
        for pair, letter in dims.GLYPH_PAIRS:
            name = name.replace(pair, letter)
        out.append(name)
    return out


def mismatch(brand: Column) -> Column:
    return F.coalesce(brand["kind"].isin("named", "lookalike"), F.lit(False))


_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"


def is_raw_ip(host: Column) -> Column:
    return host.rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$") | host.rlike(
        r"^(?=(?:[^:]*:){2})[0-9a-fA-F:.]+$"
    )
