"""What one page says: signals, offers, links and gates, as a plain record (the body of the page UDF).

The same patterns as in functions.text, for Python.
"""

from __future__ import annotations

import html as entities
import json
import re
import unicodedata
from typing import NamedTuple
from urllib.parse import parse_qsl, quote, urlencode, urljoin, urlsplit

from ..dims import DOMAINS, EDITORIAL_TYPES, ORGANISATIONS
from ..functions import text as T
from ..functions.urls import CLICK_IDS
from .dom import Node, parse


def _compiled(pattern: str) -> re.Pattern:
    return re.compile(pattern.replace("(?iu)", ""), re.I)


OFFER_LABEL, OFFER_PHRASE, INSTITUTION, INTERSTITIAL, ABOUT, NEWS, PORTAL, HEADLINES, NOTICE, NOTICE_END = (
    _compiled(p) for p in (T.OFFER_LABEL, T.OFFER_PHRASE, T.INSTITUTION, T.INTERSTITIAL, T.ABOUT_LABEL, T.NEWS, T.PORTAL, T.HEADLINES, T.NOTICE, T.NOTICE_END)
)
SEPARATOR = re.compile(T.SEPARATOR)
LEGAL = re.compile(rf"[\s,.]+(?:(?:pte|pty)\.?\s+)?(?:{'|'.join(T.LEGAL)})\.?$")
LOGO = re.compile(r"\blogo\b", re.I)
CONSENT = re.compile(r"cookie-(?:banner|consent)|onetrust|didomi|cmplz", re.I)
UNSEEN = frozenset(["script", "style", "noscript", "template"])
HOME_LABELS = frozenset(["home", "homepage", "inicio", "início", "página inicial"])


def normalize(url: str) -> str | None:
    """The canonical form, or None where the URL is not a public http(s) page's."""
    try:
        parts = urlsplit(url.strip())
        kind, port = parts.scheme.lower(), parts.port
        name = (parts.hostname or "").encode("idna").decode("ascii").lower().rstrip(".")
        if kind not in ("http", "https") or not name or parts.username or parts.password or port not in (None, 80, 443):
            return None
        place = f"[{name}]" if ":" in name else name
        if port is not None and port != {"http": 80, "https": 443}[kind]:
            place = f"{place}:{port}"
        kept = [p for p in parse_qsl(parts.query, keep_blank_values=True) if p[0].lower() not in CLICK_IDS and not p[0].lower().startswith("utm_")]
        path = quote(parts.path or "/", safe="%/-._~!$&'()*+,;=:@")
    except (UnicodeError, ValueError):
        return None
    return f"{kind}://{place}{path}" + (f"?{urlencode(kept)}" if kept else "")


def host(url: str) -> str:
    try:
        place = urlsplit(url).hostname
    except ValueError:
        return ""
    return re.sub(r"^www\.", "", place.lower()) if place else ""


def listed_kind(url: str) -> str | None:
    """The kind of the listed domain that the host is or lies under."""
    try:
        labels = (urlsplit(url).hostname or "").split(".")
    except ValueError:
        return None
    return next((k for i in range(len(labels)) if (k := DOMAINS.get(".".join(labels[i:])))), None)


def _joined(base: str, href: str) -> str | None:
    try:
        return normalize(urljoin(base, href))
    except ValueError:
        return None


def name_key(name: str) -> str:
    plain = unicodedata.normalize("NFKD", entities.unescape(name))
    text = re.sub("^[-,. ]+|[-,. ]+$", "", plain.casefold())
    text = LEGAL.sub("", re.sub(r"\.(?:com|org|net)$", "", text))
    return "".join(c for c in text if c.isalnum() and not unicodedata.combining(c))


class Signal(NamedTuple):
    context: str
    name: str
    aliases: tuple[str, ...] = ()


STRUCTURED = frozenset(["organization", "website", "site_name"])


def _keys(signal: Signal, anchors: set[str]) -> set[str]:
    """The keys a signal answers to; captions of looser contexts also to their first part, if that is
    a name that is anchored elsewhere."""
    keys = {name_key(x) for x in (signal.name, *signal.aliases)}
    if signal.context in ("website", "site_name", "copyright"):
        first = SEPARATOR.split(signal.name)[0]
        if signal.context == "copyright":
            first = first.split(",")[0]
        keys |= {name_key(first)} & anchors
    return keys - {""}


def linked_data(root: Node) -> list[dict]:
    """Top-level objects of JSON-LD scripts and the members of their @graph."""
    found: list[dict] = []
    for script in root.all("script"):
        if script.get("type") != "application/ld+json":
            continue
        try:
            data = json.loads("".join(script.strings()))
        except ValueError:
            continue
        for item in data if isinstance(data, list) else [data]:
            if isinstance(item, dict):
                graph = item.get("@graph")
                found += [item, *(x for x in (graph if isinstance(graph, list) else []) if isinstance(x, dict))]
    return found


def node_types(node: dict) -> set[str]:
    said = node["@type"] if "@type" in node else []
    listed = said if isinstance(said, list) else [said]
    return {str(x).split("/")[-1] for x in listed}


def visible(root: Node, *without: str) -> str:
    hidden = UNSEEN | set(without)
    kept = []
    for s in root.strings(comments=True):
        chain = list(s.parent.up())
        if s.parent.name != "title" and not any(p.name in hidden or CONSENT.search(p.marks) for p in chain):
            kept.append(str(s).strip())
    return " ".join(kept)


def owners(root: Node) -> list[str]:
    """Owners named by copyright notices in footers."""
    out = []
    for s in root.strings(comments=True):
        chain = list(s.parent.up())
        if any(p.name in UNSEEN or p.name in ("svg", "title", "a") for p in chain):
            continue
        if not any("footer" == p.name or "contentinfo" == p.get("role") or re.search("copyright|footer", p.marks, re.I) for p in chain):
            continue
        said = str(s).strip()
        match = NOTICE.match(said) if len(said) <= 250 else None
        if match is None:
            continue
        owner = NOTICE_END.split(match[1])[0].strip(" .-")
        policy = re.match(r"(?:terms|statuses|is|holder|permission|policy|notice)\b", owner, re.I) or re.search("(?:powered|designed|website) by", owner, re.I)
        if any(c.isalpha() for c in owner) and not policy and 2 <= len(owner) <= 90:
            out.append(owner)
    return out


def title_of(root: Node) -> str | None:
    return next((t.text() for t in root.all("title")), None)


def _structured(root: Node, base: str, nodes: list[dict]) -> list[Signal]:
    out = []
    for node in nodes:
        kinds = node_types(node)
        context = "organization" if kinds & ORGANISATIONS else "website" if "WebSite" in kinds else ""
        name, url = (node.get(k) for k in ("name", "url"))
        if not context or not isinstance(name, str) or not name.strip() or not isinstance(url, str):
            continue
        target = _joined(base, url)
        if target is None or host(target) != host(base):
            continue
        other = node.get("alternateName", [])
        out.append(Signal(context, " ".join(name.split()), tuple(a for a in (other if isinstance(other, list) else [other]) if isinstance(a, str) and a.strip())))
    for meta in root.all("meta"):
        if meta.get("property") == "og:site_name" and meta.get("content").strip():
            out.append(Signal("site_name", meta.get("content").strip()))
    return out


def _weak(root: Node) -> list[Signal]:
    out = []
    title = title_of(root)
    if title is not None:
        parts = [p for p in map(str.strip, SEPARATOR.split(title)) if p.lower() not in ("homepage", "home")]
        out += [Signal("title", p) for p in parts[:3] if 2 <= len(p) <= 90]
    for image in root.all("img"):
        if "alt" in image.attributes and "logo" in f"{image.get('id')} {image.get('src')} {image.get('alt')}".lower():
            brand = LOGO.sub("", image.get("alt")).strip("|- ")
            if 90 >= len(brand) >= 2:
                out.append(Signal("logo", brand))
    out += [Signal("copyright", x) for x in owners(root)]
    seen = visible(root)
    for s in [x for x in out if x.context == "title"]:
        brand = re.escape(s.name)
        if re.search(rf"{brand}\s+(?:oferece|é|offers|provides|are|is)\b|\bat\s+{brand},?\s+we\b", seen, re.I):
            out.append(Signal("self_description", s.name))
    return out


def identity(root: Node, base: str, nodes: list[dict]) -> tuple[str | None, list[Signal], bool]:
    """(name, signals, conflict): what the page says it is, by the agreement of its signals."""
    strong = _structured(root, base, nodes)
    anchors = {name_key(x) for s in strong for x in (s.name, *s.aliases)}
    keys = [_keys(s, anchors) for s in strong]
    shared = set.intersection(*keys) if keys else set()
    if strong and not shared:
        return None, strong, True
    signals = strong + _weak(root)
    notices = [s for s in signals if s.context == "copyright"]
    if strong:
        allowed = set().union(*keys)
        if any(not _keys(s, allowed) & allowed for s in notices):
            return None, signals, True
        for ranked in ([s for s in strong if s.context == "organization"], [s for s in strong if name_key(s.name) in shared], strong):
            if ranked:
                return ranked[0].name, signals, False
    groups: dict[str, list[Signal]] = {}
    for s in signals:
        groups.setdefault(name_key(s.name), []).append(s)
    good = [(k, g) for k, g in groups.items() if k and len({s.context for s in g}) > 1 and any(s.context != "title" for s in g)]
    if len(good) != 1:
        return None, signals, len(good) > 1
    key, group = good[0]
    if any(key not in _keys(s, {key}) for s in notices):
        return None, signals, True
    return group[0].name, signals, False


def offer(root: Node, base: str) -> str | None:
    """The words with which the page offers something of its own."""
    found = OFFER_PHRASE.search(visible(root, "footer", "aside", "blockquote"))
    if found:
        return found[0]
    for a in root.all("a"):
        if "href" in a.attributes and OFFER_LABEL.fullmatch(a.text()):
            target = _joined(base, a.get("href"))
            if target is not None and host(target) == host(base):
                return a.text()
    return None


def error_parameter(url: str) -> bool:
    try:
        return any(k.lower() == "error" and v for k, v in parse_qsl(urlsplit(url).query))
    except ValueError:
        return False


def page_error(url: str, status: int, content_type: str, root: Node) -> str | None:
    """Why a fetched page is no evidence, or None."""
    if listed_kind(url):
        return "non_institutional_source"
    if status != 200:
        return f"site_http_{status}"
    if content_type not in ("text/html", "application/xhtml+xml"):
        return "site_not_html"
    if error_parameter(url):
        return "site_error_page"
    heads = [h for h in root.all("h1", "h2") if h.name == "h1" or (h.parent is not None and h.parent.name == "body") or any(p.name == "main" for p in h.up())]
    challenge = any(n.get("id") in ("cf-challenge-running", "challenge-form") or (n.name == "form" and "/challenge/" in n.get("action")) for n in root.walk() if isinstance(n, Node))
    if challenge or any(INTERSTITIAL.search(t) for t in [title_of(root) or "", *(h.text() for h in heads[:5])]):
        return "site_interstitial"
    names = [m.get("content") for m in root.all("meta") if m.get("property") == "og:site_name"] + [title_of(root) or ""]
    if any(PORTAL.search(n) or HEADLINES.search(n) for n in names):
        return "non_institutional_source"
    return None


class Page(NamedTuple):
    """All that a decision needs of a page; error is None where it is evidence."""

    url: str
    error: str | None
    name: str | None = None
    signals: tuple[Signal, ...] = ()
    conflict: bool = False
    candidates: tuple[tuple[str, str], ...] = ()
    homes: tuple[str, ...] = ()
    abouts: tuple[str, ...] = ()
    kinds: frozenset[str] = frozenset()
    offer: str | None = None
    editorial: bool = False
    news: bool = False


#: Before a link of `abouts` that is no web address.
NO_ADDRESS = "invalid:"
EDITORIAL_PATH = re.compile(r"/(?:articles?|blog|compare|news|not[ií]cias|press|reviews?)(?:/|$)", re.I)


def read_page(url: str, status: int, content_type: str, html: str) -> Page:
    """The record of a page at its final, normalized url."""
    root = parse(html)
    problem = page_error(url, status, content_type, root)
    return Page(url, problem) if problem else evidence(url, root)


def evidence(url: str, root: Node) -> Page:
    nodes = linked_data(root)
    name, signals, conflict = identity(root, url, nodes)
    candidates = set()
    for node in nodes:
        who, where = (node.get(k) for k in ("name", "url"))
        if node_types(node) & ORGANISATIONS and isinstance(who, str) and who.strip() and isinstance(where, str):
            target = _joined(url, where)
            if target is not None and host(target) == host(url):
                candidates.add((" ".join(who.split()), target))
    homes, abouts = set(), []
    for a in root.all("a"):
        if "href" not in a.attributes:
            continue
        target = _joined(url, a.get("href"))
        if target is None and ABOUT.match(a.text()):
            abouts.append(NO_ADDRESS + a.get("href"))
        if target is None or host(target) != host(url):
            continue
        if f"{a.get('aria-label')} {a.text()}".strip().lower() in HOME_LABELS or any("logo" in i.get("alt").lower() for i in a.all("img")):
            homes.add(target)
        if ABOUT.match(a.text()):
            abouts.append(target)
    kinds = frozenset(k for n in nodes for k in node_types(n))
    editorial = bool(EDITORIAL_PATH.search(urlsplit(url).path)) or bool(kinds & EDITORIAL_TYPES)
    return Page(url, None, name, tuple(signals), conflict, tuple(sorted(candidates)), tuple(sorted(homes, key=lambda x: (len(x), x))), tuple(abouts), kinds, offer(root, url), editorial, bool(NEWS.search(visible(root))))


def blank(url: str) -> Page:
    """A page that could not be read but whose site may still be known by its home."""
    return evidence(url, parse(""))
