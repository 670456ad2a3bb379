"""Names, titles, notices and labels as Column expressions (Java regular expressions, (?iu) where case
folding must reach beyond ASCII)."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

LEGAL = ("aps", "as", "ab", "ag", "corp", "corporation", "gmbh", "inc", "incorporated", "limited", "llc", "ltd", "plc", "srl", r"s\.l", r"s\.a")
SEPARATOR = r"\s*[|]\s*|\s+(?:–|—|-)\s+"
_NOUN = r"(?:product|service|solution)s?|produtos|serviços|soluções"
OFFER_LABEL = rf"(?iu)^(?:platforms?|shop|buy (?:our |the )?[\w -]{{2,60}}|{_NOUN})(?:\s+(?:&|e|and)\s+(?:{_NOUN}))?$"
OFFER_PHRASE = (
    r"(?iu)(?<!\w)(our (?:platform|solution|service|product)s?|products? (?:&|and) services?|nossos (?:soluções|serviços|produtos)"
    r"|request (?:a )?(?:demo|quote)|book (?:a )?demo|(?:shop|buy) now|subscription plans|solicite (?:uma )?(?:demonstração|cotação))(?!\w)"
)
INSTITUTION = r"(?iu)(?<!\w)(trade union|editorial standards|news publisher|(?:grant|funding) agency|research institute|academic resource|université|universidade|university)(?!\w)"
INTERSTITIAL = (
    r"(?iu)^\s*(?:403 forbidden|page not found|service unavailable|(?:log|sign) in to continue|verify you(?: are|'re) human"
    r"|attention required|access denied|just a moment|cookies? (?:are )?(?:required|not supported))"
)
ABOUT_LABEL = r"(?iu)^(?:quem somos|sobre(?: nós)?|contact(?: us)?|company|about(?: [ \w-]{1,60}){0,1})$"
NEWS = r"(?iu)independent news (?:publisher|site)|editorial standards"
PORTAL = r"(?iu)(?:^|[|])\s*(?:publication repository|research (?:communities|portal))(?!\w)"
HEADLINES = r"(?iu)latest breaking news|today['’]s headlines"
_YEAR = "[0-9]{4}"
NOTICE = rf"(?iu)^(?:copyright\s*[:-]?\s*[©ⓒ]?\s*|[©ⓒ]\s*(?:copyright\s*)?)(?:{_YEAR}(?:\s*[–-]\s*{_YEAR})?\s*)?(?:by\s+|)((?!_)\w.*)$"
NOTICE_END = r"(?iu)\btodos os direitos\b|\ball\s+rights\b|[©|]"


def squeezed(text: Column) -> Column:
    """White space runs as one space, none at the ends."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def _plain_forms() -> tuple[str, str, dict[str, str]]:
    """Compatibility decompositions without marks of all characters of the basic plane: those of one
    character as two strings for translate(), the longer ones as a table."""
    single, longer = {}, {}
    for c in map(chr, (*range(0x80, 0xAC00), *range(0xF900, 0x10000))):
        plain = "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x))
        if plain != c and plain:
            (single if len(plain) == 1 else longer)[c] = plain
    return "".join(single), "".join(single.values()), longer


_FROM, _TO, _LONGER = _plain_forms()


def plain(text: Column) -> Column:
    """Letters without accents, compatibility forms spelled out; single marks stay (they are no letters)."""
    table = F.create_map(*(F.lit(x) for pair in _LONGER.items() for x in pair))
    some = text.rlike("[" + re.sub(r"([\\\[\]^&-])", r"\\\1", "".join(_LONGER)) + "]")
    spelled = F.array_join(F.transform(F.split(text, ""), lambda c: F.coalesce(F.try_element_at(table, c), c)), "")
    return F.translate(F.when(some, spelled).otherwise(text), _FROM, _TO)


def name_key(name: Column) -> Column:
    """The comparison key of a name: lower case without accents, one .com/.org/.net and one legal form at the
    end removed, letters and digits only."""
    text = F.regexp_replace(F.replace(F.lower(plain(name)), F.lit("ß"), F.lit("ss")), r"^[ ,.-]+|[ ,.-]+$", "")
    text = F.regexp_replace(text, r"\.(?:com|org|net)$", "")
    text = F.regexp_replace(text, rf"[\s,.]+(?:(?:pte|pty)\.?\s+)?(?:{'|'.join(LEGAL)})\.?$", "")
    return F.regexp_replace(text, r"[^\p{L}\p{N}]", "")


def slug(name: Column) -> Column:
    """Directory name of a name: what is ASCII without accents; empty if nothing is left."""
    kept = F.regexp_replace(F.regexp_replace(plain(name), r"[^\x00-\x7f]", ""), r"[^._A-Za-z0-9-]+", "-")
    return F.lower(F.regexp_replace(kept, r"^[._-]+|[._-]+$", ""))


def title_parts(title: Column) -> Column:
    """array<struct(pos, name)>: the first three parts that do not just say home, of 2 to 90 characters."""
    parts = F.filter(F.transform(F.split(title, SEPARATOR), lambda p: F.trim(p)), lambda p: ~F.lower(p).isin("home", "homepage"))
    placed = F.transform(F.slice(parts, 1, 3), lambda p, i: F.struct(i.alias("pos"), p.alias("name")))
    return F.filter(placed, lambda p: F.length(p["name"]).between(2, 90))


def caption_prefix(text: Column, comma: bool = False) -> Column:
    """The part before the first separator, and before the first comma if asked for."""
    first = F.element_at(F.split(text, SEPARATOR), 1)
    return F.trim(F.substring_index(first, ",", 1) if comma else first)


def notice_owner(text: Column) -> Column:
    """The owner that a copyright notice names, or null."""
    said = F.regexp_extract(F.trim(text), NOTICE, 1)
    owner = F.regexp_replace(F.element_at(F.split(said, NOTICE_END), 1), r"^[ .-]+|[ .-]+$", "")
    bad = r"(?iu)^(?:terms|statuses|is|holder|permission|policy|notice)(?!\w)|(?:powered|designed|website) by"
    return F.when((F.length(text) <= 250) & owner.rlike(r"\p{L}") & ~owner.rlike(bad) & F.length(owner).between(2, 90), owner)


def case_id(reason: Column, url: Column) -> Column:
    return F.concat(F.lit("case-"), F.substring(F.sha2(F.concat(reason, F.char(F.lit(0)), url), 256), 1, 16))


def language_tag(language: Column, country: Column) -> Column:
    """`pt` needs its country; other codes stay."""
    return F.when(F.lower(language) == "pt", F.when(F.lower(country) == "pt", "pt-PT").otherwise("pt-BR")).otherwise(language)


def json_strings(values: Column) -> Column:
    return F.to_json(F.array_sort(F.array_distinct(values)))


def is_identifier(text: Column) -> Column:
    return text.rlike("^[A-Za-z0-9]+$")


def api_error(kind: Column, message: Column) -> Column:
    """type: message of a provider's error, masked, white space squeezed, 500 characters each at most."""
    from .urls import redacted

    one = lambda c: F.substring(squeezed(redacted(F.coalesce(c, F.lit("")))), 1, 500)
    return F.concat_ws(": ", F.nullif(one(kind), F.lit("")), F.nullif(one(message), F.lit("")))


def type_names(types: Column) -> Column:
    """The last path segments of JSON-LD types, each once, ascending."""
    return F.array_sort(F.array_distinct(F.transform(types, lambda t: F.substring_index(t, "/", -1))))


def page_gate(kind: Column, status: Column, content_type: Column, title: Column) -> Column:
    """Why a fetched page is no evidence, in order of precedence, or null."""
    plain = F.trim(F.lower(F.substring_index(content_type, ";", 1)))
    return (
        F.when(kind.isNotNull(), "non_institutional_source")
        .when(status != 200, F.concat(F.lit("site_http_"), status.cast("string")))
        .when(~plain.isin("text/html", "application/xhtml+xml"), "site_not_html")
        .when(title.rlike(INTERSTITIAL), "site_interstitial")
        .when(title.rlike(PORTAL) | title.rlike(HEADLINES), "non_institutional_source")
    )


def home_order(declared: Column, links: Column, root: Column) -> Column:
    """Home candidates: a declared locale root, links by length then spelling, the root; each once."""
    by_length = F.transform(F.array_sort(F.transform(links, lambda u: F.struct(F.length(u).alias("n"), u.alias("u")))), lambda x: x["u"])
    return F.array_distinct(F.filter(F.concat(F.array(declared), by_length, F.array(root)), lambda u: u.isNotNull()))
