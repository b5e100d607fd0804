"""Canonical URLs and URL checks as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Query parameters that only track.
TRACKING = (
    "utm_source utm_medium utm_campaign utm_term utm_content utm_id utm_name utm_brand utm_social utm_social-type utm_referrer "
    "gclid gbraid wbraid fbclid msclkid yclid twclid ttclid mc_cid mc_eid igshid _ga _gl ref ref_src ref_url "
    "campaign campaign_id campaign_name trk trkInfo"
).split()
_SPLIT = r"(?s)^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?"


def _decoded(text: Column) -> Column:
    return F.try_url_decode(F.regexp_replace(text, "%(?![0-9A-Fa-f]{2})", "%25"))


def _encoded(text: Column) -> Column:
    return F.replace(F.replace(F.url_encode(text), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def _path(path: Column) -> Column:
    plain = F.coalesce(_decoded(F.replace(path, F.lit("+"), F.lit("%2B"))), path)
    out = F.replace(F.replace(F.url_encode(plain), F.lit("+"), F.lit("%20")), F.lit("%7E"), F.lit("~"))
    for char in "/:@!$&'()+,;=":
        out = F.replace(out, F.lit(f"%{ord(char):02X}"), F.lit(char))
    out = F.replace(out, F.lit("%25"), F.lit("%"))
    return F.when(out == "/", out).otherwise(F.regexp_replace(out, "/+$", ""))


def canonical_url(url: Column) -> Column:
    """One form for all spellings of an address: lower-case scheme and host, no default port,
    normalised path, tracking and blank parameters dropped, the others sorted, no fragment.
    Null and blank give an empty string."""
    raw = F.trim(F.coalesce(url, F.lit("")))
    part = lambda i: F.regexp_extract(raw, _SPLIT, i)
    scheme, netloc = F.lower(part(1)), part(2)
    user = F.regexp_extract(netloc, "^([^@]*@)", 1)
    host = F.lower(F.regexp_replace(netloc, "^[^@]*@", ""))
    host = F.when(scheme == "http", F.regexp_replace(host, ":0*80$", "")).when(scheme == "https", F.regexp_replace(host, ":0*443$", "")).otherwise(host)
    host = F.regexp_replace(host, ":$", "")
    pairs = F.transform(F.split(part(4), "&", -1), lambda p: F.split(p, "=", 2))
    pairs = F.filter(pairs, lambda p: (F.size(p) == 2) & (F.get(p, F.lit(1)) != ""))
    pairs = F.transform(pairs, lambda p: F.struct(F.coalesce(_decoded(p[0]), p[0]).alias("k"), F.coalesce(_decoded(p[1]), p[1]).alias("v")))
    kept = F.array_sort(F.filter(pairs, lambda p: ~p["k"].isin(*TRACKING)))
    query = F.array_join(F.transform(kept, lambda p: F.concat(_encoded(p["k"]), F.lit("="), _encoded(p["v"]))), "&")
    return F.concat(
        F.when(scheme != "", F.concat(scheme, F.lit(":"))).otherwise(""),
        F.when(netloc != "", F.concat(F.lit("//"), user, host)).otherwise(""),
        _path(part(3)),
        F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""),
    )


def is_valid_url(url: Column) -> Column:
    return F.coalesce(url.rlike("^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+"), F.lit(False))
