"""URL expressions. All are Column expressions inside whole-stage code generation; only hosts beyond
ASCII need Python (`plans.page_features` has that form)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

INVALID = "invalid_url"
CLICK_IDS = ("dclid", "fbclid", "gclid", "msclkid")
_SHAPE = r"(?s)^\s*([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)(\?[^#]*)?(#.*)?$"
#: What Java's encoder escapes and a path keeps, the per cent sign last.
_KEPT_IN_PATH = "/:@!$&'()+,;=~%"


def scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, _SHAPE, 1))


def authority(url: Column) -> Column:
    return F.regexp_extract(url, _SHAPE, 2)


def raw_path(url: Column) -> Column:
    return F.regexp_extract(F.rtrim(url), _SHAPE, 3)


def raw_query(url: Column) -> Column:
    return F.substring(F.regexp_extract(F.rtrim(url), _SHAPE, 4), 2, 1 << 30)


def _host_port(url: Column) -> Column:
    return F.regexp_replace(authority(url), r"^.*@", "")


def hostname(url: Column) -> Column:
    """Lower case, without brackets and trailing dots; empty without an authority."""
    place = _host_port(url)
    name = F.when(F.startswith(place, F.lit("[")), F.regexp_extract(place, r"^\[([^\]]*)\]", 1)).otherwise(F.substring_index(place, ":", 1))
    return F.regexp_replace(F.lower(name), r"\.+$", "")


def port(url: Column) -> Column:
    """The text after the host's colon; empty without one."""
    return F.regexp_extract(_host_port(url), r"^(?:\[[^\]]*\]|[^:]*):(.*)$", 1)


def host_key(url: Column) -> Column:
    """The host without one leading www., which decides whether two URLs are of one site."""
    return F.regexp_replace(hostname(url), r"^www\.", "")


def same_host(a: Column, b: Column) -> Column:
    return host_key(a) == host_key(b)


def encoded_path(path: Column) -> Column:
    """The path with spaces and characters beyond ASCII escaped; escapes and delimiters stay."""
    out = F.replace(F.url_encode(F.when(path == "", "/").otherwise(path)), F.lit("+"), F.lit("%20"))
    for sign in _KEPT_IN_PATH:
        out = F.replace(out, F.lit(f"%{ord(sign):02X}"), F.lit(sign))
    return out


def _requoted(text: Column) -> Column:
    decoded = F.coalesce(F.try_url_decode(text), text)
    return F.replace(F.replace(F.url_encode(decoded), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def stripped_query(query: Column) -> Column:
    """name=value pairs in order, requoted, without click ids and utm_ names; `a` becomes `a=`."""
    pairs = F.filter(F.split(query, "&"), lambda p: p != "")
    pairs = F.transform(pairs, lambda p: F.struct(F.substring_index(p, "=", 1).alias("k"), F.when(F.contains(p, F.lit("=")), F.regexp_replace(p, r"(?s)^[^=]*=", "")).otherwise("").alias("v")))
    name = lambda p: F.lower(F.coalesce(F.try_url_decode(p["k"]), p["k"]))
    kept = F.filter(pairs, lambda p: ~F.startswith(name(p), F.lit("utm_")) & ~name(p).isin(*CLICK_IDS))
    return F.array_join(F.transform(kept, lambda p: F.concat(_requoted(p["k"]), F.lit("="), _requoted(p["v"]))), "&")


def normalize_url(url: Column) -> Column:
    """The canonical form of an http(s) URL, or `invalid_url`.

    Credentials, ports other than 80 and 443 and hosts that are empty or beyond ASCII make it invalid;
    a scheme's own port goes, as do fragments and tracking parameters. Null gives `invalid_url`.
    """
    host, p, s = hostname(url), port(url), scheme(url)
    user = F.regexp_extract(authority(url), r"^(.*)@", 1)
    good = s.isin("http", "https") & (host != "") & ~host.rlike(r"[^\x21-\x7e]") & user.isin("", ":") & p.isin("", "80", "443")
    shown = F.when(F.contains(host, F.lit(":")), F.concat(F.lit("["), host, F.lit("]"))).otherwise(host)
    own = (p == "") | ((s == "http") & (p == "80")) | ((s == "https") & (p == "443"))
    query = stripped_query(raw_query(url))
    whole = F.concat(s, F.lit("://"), shown, F.when(own, "").otherwise(F.concat(F.lit(":"), p)), encoded_path(raw_path(url)), F.when(query == "", "").otherwise(F.concat(F.lit("?"), query)))
    return F.coalesce(F.when(good, whole), F.lit(INVALID))


def site_key(url: Column) -> Column:
    """host without www., explicit port and path (slashes merged, escapes upper case, parameters and the
    slash at the end cut), joined by blanks; scheme, query and fragment do not matter."""
    path = F.regexp_replace(raw_path(url), r";[^/]*$", "")
    path = F.regexp_replace(path, "//+", "/")
    pieces = F.transform(F.split(path, "%", -1), lambda x, i: F.when((i > 0) & x.rlike("^[0-9A-Fa-f]{2}"), F.concat(F.upper(F.substring(x, 1, 2)), F.substring(x, 3, 1 << 30))).otherwise(x))
    path = F.regexp_replace(F.array_join(pieces, "%"), "/$", "")
    return F.concat_ws(" ", host_key(url), port(url), F.when(path == "", "/").otherwise(path))


def redacted(text: Column) -> Column:
    """Provider tokens masked, unprintable characters as spaces."""
    return F.regexp_replace(F.regexp_replace(text, r"apify_api_[A-Za-z0-9_-]+", "[redacted]"), r"[^\x20-\x7e -￿]", " ")


def source_location(url: Column) -> Column:
    """scheme://host/path, masked, of 500 characters at most."""
    return F.substring(redacted(F.concat(scheme(url), F.lit("://"), _host_port(url), raw_path(url))), 1, 500)


def query_value(url: Column, name: str) -> Column:
    """The first value of a query parameter, decoded; null without it."""
    found = F.regexp_extract(F.concat(F.lit("&"), raw_query(url)), rf"&{name}=([^&]*)", 1)
    return F.when(F.concat(F.lit("&"), raw_query(url)).rlike(rf"&{name}="), F.coalesce(F.try_url_decode(found), found))


def next_offset(link: Column, start: Column) -> Column:
    """The `start` of a next-page link if it lies beyond this page's, else null."""
    value = F.regexp_extract(F.coalesce(query_value(link, "start"), F.lit("")), r"^\d{1,9}$", 0)
    number = F.when(value != "", value).cast("int")
    return F.when(number > start, number)


def has_error_parameter(url: Column) -> Column:
    """Whether a query parameter `error` (any case) has a value."""
    return F.exists(F.split(raw_query(url), "&"), lambda p: (F.lower(F.substring_index(p, "=", 1)) == "error") & p.rlike("=."))


def is_locale_root(path: Column) -> Column:
    return path.rlike(r"(?i)^/(?:[a-z][a-z](?:-[a-z][a-z])?/?)?$")


def is_editorial_path(path: Column) -> Column:
    words = ("articles?", "blog", "compare", "news", "not[ií]cias", "press", "reviews?")
    return path.rlike(rf"(?iu)/(?:{'|'.join(words)})(?:/|$)")


def host_suffixes(host: Column) -> Column:
    """The host and every parent domain, for an equality join with listed domains."""
    labels = F.split(host, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
