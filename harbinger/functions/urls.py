"""URL columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from harbinger.functions.columns import as_col, strip

# Query keys that only track a visit, and country by top-level domain.
TRACKING_PREFIX = "utm_"
TRACKING_KEYS = ["fbclid", "gclid", "mc_cid", "mc_eid"]
TLD_COUNTRY = {
    "fr": "France",
    "ca": "Canada",
    "be": "Belgium",
    "ch": "Switzerland",
    "ma": "Morocco",
    "dz": "Algeria",
    "tn": "Tunisia",
    "sn": "Senegal",
    "cm": "Cameroon",
    "ci": "Ivory Coast",
    "lu": "Luxembourg",
    "ht": "Haiti",
}


def _decoded(piece: Column) -> Column:
    """Form decoding; a percent sign that starts no escape stands for itself."""
    piece = F.regexp_replace(piece, "%(?![0-9A-Fa-f]{2})", "%25")
    return F.coalesce(F.try_url_decode(piece), F.replace(piece, F.lit("+"), F.lit(" ")))


def _encoded(piece: Column) -> Column:
    """Form encoding that keeps ``~`` and escapes ``*``."""
    out = F.url_encode(piece)
    return F.replace(F.replace(out, F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def normalise_url(c: Column | str) -> Column:
    """Publisher URL without tracking parameters and fragment.

    The order of the other parameters and blank values stay; they are decoded and
    encoded again, so equal addresses become equal text.  Null becomes empty.
    """
    url = strip(F.coalesce(as_col(c), F.lit("")))
    base = F.regexp_extract(url, r"^[^?#]*", 0)
    scheme = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.\-]*:)", 1)
    base = F.concat(F.lower(scheme), F.substr(base, F.length(scheme) + 1))
    query = F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)
    pairs = F.transform(
        F.filter(F.split(query, "&"), lambda p: p != ""),
        lambda p: F.struct(
            _decoded(F.regexp_extract(p, r"^([^=]*)", 1)).alias("k"),
            _decoded(F.regexp_extract(p, r"^[^=]*=(.*)$", 1)).alias("v"),
        ),
    )
    wanted = F.filter(
        pairs,
        lambda p: ~(
            F.lower(p.getField("k")).startswith(TRACKING_PREFIX)
            | F.lower(p.getField("k")).isin(TRACKING_KEYS)
        ),
    )
    text = F.array_join(
        F.transform(wanted, lambda p: F.concat(_encoded(p.getField("k")), F.lit("="), _encoded(p.getField("v")))),
        "&",
    )
    return F.when(text == "", base).otherwise(F.concat(base, F.lit("?"), text))


def article_key(url: Column | str, title: Column | str) -> Column:
    """First 16 hex digits of the SHA-1 of the normalised URL, or of the title without one."""
    source = F.coalesce(F.nullif(normalise_url(url), F.lit("")), as_col(title), F.lit(""))
    return F.substring(F.sha1(F.encode(source, "UTF-8")), 1, 16)


def domain(url: Column | str) -> Column:
    """Authority with its port, every ``www.`` taken out, in lower case."""
    authority = F.regexp_extract(
        F.coalesce(as_col(url), F.lit("")), r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//([^/?#]*)", 1
    )
    return F.lower(F.replace(authority, F.lit("www."), F.lit("")))


def country(url: Column | str) -> Column:
    tld = F.substring_index(domain(url), ".", -1)
    table = F.create_map(*[F.lit(x) for pair in TLD_COUNTRY.items() for x in pair])
    return F.coalesce(F.try_element_at(table, tld), F.lit("Unknown"))
