"""The decision about one search result, from the pages it leads to."""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from typing import NamedTuple
from urllib.parse import urlsplit

from ..dims import INSTITUTIONS, NOT_INSTITUTIONAL, RECOVERABLE
from . import pages as P

POLICY_VERSION = 3
MOST_INSPECTED = 5
_LOCALE = re.compile("/(?:[a-z][a-z](?:-[a-z][a-z])?/?)?", re.I)


class Decision(NamedTuple):
    status: str
    name: str
    url: str
    reason: str
    evidence: str


class _Stop(Exception):  # noqa: N818
    """A final status and reason."""


class _Lost(Exception):  # noqa: N818
    """A page that cannot be read, with the reason."""


def _shown(signals: tuple[P.Signal, ...]) -> list[dict]:
    return [{"context": s.context, "name": s.name, "aliases": list(s.aliases)} for s in signals]


class _Case:
    def __init__(self, url: str, fetch: Callable[[str], P.Page | None]) -> None:
        self.fetch = fetch
        self.inspected: list[str] = []
        self.notes: dict = {"policy_version": POLICY_VERSION, "source_url": url, "inspected": self.inspected}
        self.failures: dict[str, str] = {}

    def inspect(self, url: str) -> P.Page:
        if url not in self.inspected:
            if len(self.inspected) >= MOST_INSPECTED:
                raise _Lost("site_inspection_limit")
            self.inspected.append(url)
        page = self.fetch(url)
        if page is None:
            raise _Lost("not_available_in_fixture")
        if page.error:
            raise _Lost(page.error)
        return page

    def failed(self, url: str, reason: str) -> None:
        self.failures[url] = reason
        self.notes["access_failures"] = self.failures

    def source(self, url: str) -> tuple[P.Page, str | None]:
        """The result's own page, or an empty one where its site may still be reached."""
        try:
            page = self.inspect(url)
        except _Lost as lost:
            reason = str(lost)
            if reason not in RECOVERABLE:
                raise _Stop("skipped" if reason in NOT_INSTITUTIONAL else "pending", reason) from None
            self.notes["source_access_error"] = reason
            return P.blank(url), reason
        self.notes["source_final_url"] = page.url
        return page, None

    def about(self, home: P.Page) -> P.Page | None:
        """The first About or contact page of the home's site that has not been read yet."""
        for url in home.abouts:
            if url in self.inspected:
                continue
            if url.startswith(P.NO_ADDRESS):
                self.failed(url.removeprefix(P.NO_ADDRESS), "invalid_url")
                return None
            try:
                page = self.inspect(url)
            except _Lost as lost:
                self.failed(url, str(lost))
                return None
            return page if P.host(page.url) == P.host(home.url) else None
        return None


def _run(case: _Case, original: str) -> Decision:
    source, access_error = case.source(original)
    structured = any(s.context in P.STRUCTURED for s in source.signals)
    if source.conflict and structured:
        case.notes["identity_signals"] = _shown(source.signals)
        raise _Stop("pending", "conflicting_company_identity")
    expected, declared = source.candidates[0] if source.candidates else (None, None)
    if structured:
        expected = source.name
        case.notes["source_identity_signals"] = _shown(source.signals)
    case.notes["source_page_kind"] = "editorial" if source.editorial else "other"
    place = urlsplit(source.url)
    homes = [declared] if declared and _LOCALE.fullmatch(urlsplit(declared).path) else []
    homes += [*source.homes, f"{place.scheme}://{place.netloc}/"]
    mismatch = unoffered = False
    for url in dict.fromkeys(homes):
        if P.host(url) != P.host(source.url):
            continue
        try:
            home = case.inspect(url)
        except _Lost as lost:
            case.failed(url, str(lost))
            if str(lost) in NOT_INSTITUTIONAL:
                raise _Stop("skipped", str(lost)) from None
            continue
        if P.host(home.url) != P.host(source.url):
            mismatch = True
            continue
        case.notes["identity_signals"] = _shown(home.signals)
        if home.conflict:
            raise _Stop("pending", "conflicting_company_identity")
        if home.news or "NewsMediaOrganization" in home.kinds:
            raise _Stop("skipped", "non_institutional_source")
        offered, offered_at = home.offer, home.url
        if not offered:
            offered, offered_at = (source.offer if expected or not source.editorial else None), source.url
        name = home.name
        if not offered and (home.kinds & INSTITUTIONS or (name and P.INSTITUTION.search(name))):
            raise _Stop("skipped", "non_provider_institution")
        if not name and (about := case.about(home)) is not None:
            if about.conflict:
                raise _Stop("pending", "conflicting_company_identity")
            if about.name and P.name_key(about.name) in {P.name_key(s.name) for s in home.signals}:
                name = about.name
                case.notes["identity_signals"] = _shown(home.signals + about.signals)
                case.notes["identity_support_url"] = about.url
                if about.offer:
                    offered, offered_at = about.offer, about.url
        if not name:
            continue
        if expected:
            wanted = {P.name_key(expected)} | {P.name_key(a) for s in source.signals if s.context in P.STRUCTURED for a in s.aliases}
            if not wanted & ({P.name_key(name)} | {P.name_key(a) for s in home.signals for a in s.aliases}):
                mismatch = True
                continue
        if not offered:
            unoffered = True
            continue
        case.notes |= {"name": name, "entrypoint": home.url, "declared_url": declared, "source_kind": "own_provider_site", "offer_evidence": offered, "offer_source_url": offered_at}
        return Decision("confirmed", name, home.url, "homepage_identity_verified", json.dumps(case.notes, ensure_ascii=False))
    if mismatch:
        raise _Stop("pending", "entrypoint_identity_mismatch")
    if access_error or case.failures:
        raise _Stop("pending", access_error or next(iter(case.failures.values())))
    if source.editorial and not source.offer and not unoffered:
        raise _Stop("skipped", "editorial_or_listing_page")
    raise _Stop("pending", "provider_offer_unverified" if unoffered else "missing_or_ambiguous_company_identity")


def decide(url: str, fetch: Callable[[str], P.Page | None]) -> Decision:
    """The decision for a result's url; fetch gives the record of a stored page or None."""
    case = _Case(url, fetch)
    try:
        original = P.normalize(url)
        if original is None:
            raise _Stop("pending", "invalid_url")
        if P.error_parameter(original):
            raise _Stop("pending", "site_error_page")
        kind = P.listed_kind(original)
        if kind:
            case.notes["source_kind"] = kind
            raise _Stop("skipped", "non_institutional_source")
        return _run(case, original)
    except _Stop as stop:
        status, reason = stop.args
        return Decision(status, "", "", reason, json.dumps(case.notes, ensure_ascii=False))
