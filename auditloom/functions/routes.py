"""Locators: absolute URLs, project-relative paths and document references."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from auditloom import fixed
from auditloom.functions.text import iso_date, let, punctuation_only, strip, text, unusable

_V4 = r"(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])(?:\.(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])){3}"
_HEXTETS = r"[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4})*"


def _ip_literal(host: Column) -> Column:
    """Whether the text between brackets is an IPv6 address or a future-version literal."""
    zone_free = F.regexp_replace(host, r"%[^%]+$", "")
    flat = F.regexp_replace(zone_free, rf":{_V4}$", ":0:0")
    count = F.size(F.split(F.regexp_replace(flat, "^:+|:+$", ""), ":+"))
    full = flat.rlike(rf"^{_HEXTETS}$") & (count == 8)
    short = flat.rlike(rf"^(?:{_HEXTETS})?::(?:{_HEXTETS})?$") & ((flat == "::") | (count <= 7))
    return full | short | host.rlike(r"^v[0-9A-Fa-f]+\..+$")


def usable_url(value: Column) -> Column:
    """An absolute http(s) address in URI characters that names a host and, if any, a real port."""
    def judged(address: Column) -> Column:
        authority = F.regexp_extract(address, fixed.URL_AUTHORITY, 1)
        return (address.rlike(fixed.URL_CHARS) & ~address.rlike(fixed.BROKEN_PERCENT)
                & let(authority, _place_ok))

    return let(strip(value), judged)


def _place_ok(authority: Column) -> Column:
    """Whether the part between // and the path names a host; '' where there is no such part."""
    user = F.regexp_extract(authority, r"^(.*)@", 1)
    place = F.substring_index(authority, "@", -1)
    literal = r"^[^\[]*\[([^\]]*)\][^:]*(?::(.*))?$"
    bracketed = place.contains("[") | place.contains("]")
    address_literal = place.rlike(literal) & let(
        F.regexp_extract(place, literal, 1), lambda h: ~punctuation_only(h) & _ip_literal(h))
    host = F.substring_index(place, ":", 1)
    port = F.when(bracketed, F.regexp_extract(place, literal, 2)).otherwise(
        F.regexp_extract(place, r"^[^:]*:(.*)$", 1))
    return (~user.rlike(r"[\[\]]")
            & F.when(bracketed, address_literal).otherwise(~punctuation_only(host))
            & let(port, lambda p: (p == "") | (p.rlike(r"^0*[1-9][0-9]{0,4}$") & (
                F.regexp_replace(p, "^0+", "").try_cast("int") <= 65535))))


def path_unsafe(value: Column) -> Column:
    """Absolute, or stepping up: refused before any lookup. An empty path is not unsafe."""
    path = strip(value)
    return path.startswith("/") | F.array_contains(F.split(path, "/"), "..")


def held_path(value: Column) -> Column:
    """The normalised project-relative path, or null when empty or unsafe."""
    path = strip(value)
    parts = F.filter(F.split(path, "/"), lambda p: (p != "") & (p != "."))
    return F.when(~path_unsafe(value) & (F.size(parts) > 0), F.array_join(parts, "/"))


def usable_route(token: Column) -> Column:
    """A whitespace-free token somebody could follow: a usable URL, or a named document."""
    extension = rf"(?iu)\.(?:{'|'.join(fixed.DOCUMENT_EXTENSIONS)})$"

    def judged(cleaned: Column) -> Column:
        named = F.exists(F.split(cleaned, "/"), lambda part: ~punctuation_only(part))
        return F.when(cleaned.rlike(r"(?i)^https?://"), usable_url(cleaned)).otherwise(
            cleaned.rlike(extension) & named)

    return let(F.rtrim(strip(token), F.lit(fixed.ROUTE_TAIL)), judged)


def reference_defect(value: Column) -> Column:
    """First reason a reference cannot be traced, or null: no_reference, no_date, no_route."""
    def defect(body: Column) -> Column:
        dates = F.regexp_extract_all(body, F.lit(fixed.ISO_DATE_IN_TEXT), F.lit(0))
        tokens = F.split(body, fixed.WS + "+")
        return (F.when(unusable(body), "no_reference")
                .when(~F.exists(dates, lambda d: iso_date(d).isNotNull()), "no_date")
                .when(~F.exists(tokens, usable_route), "no_route"))

    return let(strip(value), defect)


def file_extension(name: Column) -> Column:
    """Lower-case extension of the last path component with its dot; '' for none or a dot-file."""
    return F.lower(F.regexp_extract(text(name), r"(?s)[^/.][^/]*(\.[^./]*)$", 1))
