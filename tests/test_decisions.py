"""The decision table of FIXTURES.md, on synthetic pages."""

import json

import pytest

from entityflow.plans import pages as P
from entityflow.plans.decide import decide

ROOT = "https://firm.example.org/"
OFFER = '<ul><a class="x" href="/services">Services</a></ul>'


def ld(*nodes):
    return f'<script type="application/ld+json">{json.dumps(list(nodes))}</script>'


def org(name="Blue Lantern", kind="Organization", url=ROOT, **more):
    return {"name": name, "@type": kind} | {"url": url} | more


ORG, WEB = ld(org()), ld(org(kind="WebSite"))


def run(pages, source=ROOT):
    """pages: url -> html, (status, html) or reason of failure."""

    def fetch(url):
        page = pages.get(url)
        if page is None:
            return None
        if isinstance(page, tuple):
            return P.read_page(page[2] if len(page) > 2 else url, page[0], "text/html", page[1])
        return P.read_page(url, 200, "text/html", page)

    return decide(source, fetch)


def footer(text):
    return f"<footer>{text}</footer>"


TITLE = "<title>Blue Lantern</title>"
SITE = '<meta property="og:site_name" content="{}">'.format
CASES = [
    ({ROOT + "product": ORG + ld({"@type": "Article"}), ROOT: ORG + OFFER}, ROOT + "product", "confirmed", None),
    ({ROOT + "news/product": ORG + ld({"@type": "Article"}), ROOT: ORG + OFFER}, ROOT + "news/product", "confirmed", None),
    ({ROOT: ORG + footer("© 2026 Blue Lantern. All Rights<br>Reserved") + OFFER}, ROOT, "confirmed", None),
    ({}, "https://eurekalert.org/paper", "skipped", "non_institutional_source"),
    ({}, "https://www.linkedin.com/company/x", "skipped", "non_institutional_source"),
    ({}, "https://eurekalert.org.example.org/", "pending", "not_available_in_fixture"),
    ({ROOT: ld(org("Synthetic University", "EducationalOrganization"), org("Synthetic University"))}, ROOT, "skipped", "non_provider_institution"),
    ({ROOT: ORG}, ROOT, "pending", "provider_offer_unverified"),
    ({ROOT: ld(org(), {"@type": "NewsMediaOrganization"}) + OFFER}, ROOT, "skipped", "non_institutional_source"),
    ({ROOT: ld(org("Synthetic Web Agency LLC"), org(kind="WebSite")) + OFFER}, ROOT, "pending", "conflicting_company_identity"),
    ({ROOT: ld(org("Synthetic Holdings Ltd", alternateName="Blue Lantern"), org(kind="WebSite")) + OFFER}, ROOT, "confirmed", None),
    ({ROOT: ld(org("Blue Lantern S.L."), org("bluelantern.com", "WebSite")) + OFFER}, ROOT, "confirmed", None),
    ({ROOT: TITLE + footer("© Blue Lantern Pte Ltd") + OFFER}, ROOT, "confirmed", None),
    ({ROOT: TITLE + "<p>At Blue Lantern, we build.</p>" + OFFER}, ROOT, "confirmed", None),
    ({ROOT: '<img alt="Blue Lantern logo">' + footer("© Blue Lantern Pte Ltd") + OFFER}, ROOT, "confirmed", None),
    ({ROOT: TITLE + OFFER}, ROOT, "pending", "missing_or_ambiguous_company_identity"),
    ({ROOT: TITLE + footer("Website by Blue Lantern") + OFFER}, ROOT, "pending", None),
    ({ROOT: TITLE + '<img alt="Other logo">' + OFFER}, ROOT, "pending", None),
    ({ROOT: TITLE + '<a href="/about">About</a>' + OFFER, ROOT + "about": ORG}, ROOT, "confirmed", None),
    ({ROOT: TITLE + '<a href="https://other.example/about">About</a>' + OFFER}, ROOT, "pending", None),
    ({ROOT: TITLE + '<a href="mailto:a@b.example">Contact us</a><a href="/about">About</a>' + OFFER, ROOT + "about": ORG}, ROOT, "pending", "invalid_url"),
    ({ROOT + "product": (403, ""), ROOT: ORG + OFFER}, ROOT + "product", "confirmed", None),
    ({ROOT + "product": (403, ""), ROOT: TITLE}, ROOT + "product", "pending", "site_http_403"),
    ({ROOT + "news/product": ld({"@type": "Article"}), ROOT: (403, "")}, ROOT + "news/product", "pending", "site_http_403"),
    ({ROOT + "product": ld(org("Synthetic Alpha", "WebSite")), ROOT: ld(org("Synthetic Beta", "WebSite")) + OFFER}, ROOT + "product", "pending", "entrypoint_identity_mismatch"),
    ({ROOT: "<title>Just a moment…</title>"}, ROOT, "pending", "site_interstitial"),
    ({ROOT: "<h1>Verify you are human</h1>"}, ROOT, "pending", "site_interstitial"),
    ({ROOT: "<title>Sign in to continue</title>"}, ROOT, "pending", "site_interstitial"),
    ({}, ROOT + "?error=cookies_not_supported", "pending", "site_error_page"),
    ({ROOT: ORG + OFFER + footer("© 2026 Different Owner GmbH")}, ROOT, "pending", "conflicting_company_identity"),
    ({ROOT: ORG + OFFER + footer("© 3Synthetic AG")}, ROOT, "pending", "conflicting_company_identity"),
    ({ROOT: ld(org("Blue Lantern - Advanced Cell Interfaces", "WebSite"), org()) + OFFER}, ROOT, "confirmed", None),
    ({ROOT: ld(org("Blue Lantern - Different Owner"), org(kind="WebSite")) + OFFER}, ROOT, "pending", "conflicting_company_identity"),
    ({ROOT: ld(org("A &amp; B"), org("A & B", "WebSite")) + OFFER}, ROOT, "confirmed", None),
    ({ROOT: ORG + footer("our service")}, ROOT, "pending", "provider_offer_unverified"),
    ({ROOT: ORG + "<blockquote>our service</blockquote>"}, ROOT, "pending", "provider_offer_unverified"),
    ({ROOT: ORG + '<div id="onetrust-x">our service</div>'}, ROOT, "pending", "provider_offer_unverified"),
    ({ROOT: ORG + "<p>our services</p>"}, ROOT, "confirmed", None),
    ({ROOT: SITE("Research portal") + ORG + OFFER}, ROOT, "skipped", "non_institutional_source"),
    ({ROOT + "blog/x": ld({"@type": "Article", "publisher": org()})}, ROOT + "blog/x", "pending", "not_available_in_fixture"),
    ({ROOT + "blog/x": ld({"@type": "Article", "publisher": org()}), ROOT: "<p>hello</p>"}, ROOT + "blog/x", "skipped", "editorial_or_listing_page"),
    ({ROOT: (200, ORG, "https://www.linkedin.com/x")}, ROOT, "skipped", "non_institutional_source"),
    ({ROOT: (203, "")}, ROOT, "pending", "site_http_203"),
    ({}, "https://example.org:8000", "pending", "invalid_url"),
    ({}, "https://me:pw@firm.example", "pending", "invalid_url"),
    ({}, "file:///etc/passwd", "pending", "invalid_url"),
]


@pytest.mark.parametrize("case", range(len(CASES)))
def test_decision_table(case):
    pages, source, status, reason = CASES[case]
    got = run(pages, source)
    assert got.status == status and (reason is None or got.reason == reason), got
    assert (got.name == "" or status == "confirmed") and json.loads(got.evidence)["policy_version"] == 3


@pytest.mark.parametrize("form", "ApS;AS;AG;AB;PLC;SRL;GmbH;Pty Ltd".split(";"))
def test_legal_forms_in_owner_notice(form):
    got = run({ROOT: TITLE + footer(f"© 2026 Blue Lantern {form}") + OFFER})
    assert got.name == "Blue Lantern" and got.status == "confirmed"


@pytest.mark.parametrize("text", ["Copyright policy applies", "© is a sign", "Copyright notice", "Terms of use", "© 2026"])
def test_notices_that_name_no_owner(text):
    assert run({ROOT: ORG + OFFER + footer(text)}).status == "confirmed"


def test_at_most_five_pages_are_inspected():
    links = " ".join(f"<a class=h href='/{i}x'>home</a>" for i in range(10))
    got = run({ROOT + "start": links} | {f"{ROOT}{i}x": "<p>x</p>" for i in range(10)}, ROOT + "start")
    assert got.status == "pending" and len(json.loads(got.evidence)["inspected"]) == 5


def test_offer_and_support_pages_are_recorded():
    got = run({ROOT: TITLE + '<a class="k" href="/about">About us</a> ' + OFFER} | {ROOT + "about": ORG})
    notes = json.loads(got.evidence)
    assert notes["identity_support_url"] == ROOT + "about" and notes["offer_evidence"] == "Services"


def test_spark_resolution_agrees(spark):
    """All cases that are one corpus each, on their own hosts, through the distributed plan."""
    from entityflow.plans.resolve import resolve

    corpus, results, expected = [], [], {}
    for i, (pages, source, status, _) in enumerate(CASES):
        move = lambda text, i=i: text.replace("firm.example.org", f"s{i}.firm.example.org")
        for url, page in pages.items():
            code, html, final = page if isinstance(page, tuple) and len(page) > 2 else (*page, url) if isinstance(page, tuple) else (200, page, url)
            corpus.append((move(url), move(final), code, "text/html; charset=utf-8", move(html)))
        results.append(("q", move(source)))
        expected[move(source)] = status
    frame = spark.createDataFrame(corpus, "url string, final_url string, status int, content_type string, html string")
    got = resolve(spark.createDataFrame(results, "query string, url string"), frame).collect()
    assert {r["discovered_url"]: r["status"] for r in got} == expected
