"""Listed domains, types and vocabularies: small fixed dimensions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_DOMAINS = {
    "intermediary": "amazon.com capterra.com crunchbase.com facebook.com g2.com getapp.com github.com instagram.com linkedin.com medium.com mementodatabase.com pinterest.com play.google.com reddit.com scribd.com slideshare.net softwareadvice.com sourceforge.net wikipedia.org x.com youtube.com",
    "community_source": "open-neuromorphic.org",
    "documentation_source": "developers.google.com",
    "editorial_source": "artecult.com asiaresearchnews.com azolifesciences.com azom.com azonano.com energiainteligenteufjf.com.br eurekalert.org frontiersin.org globo.com independent.co.uk innovationorigins.com ioplus.nl nature.com news-medical.net sciencedirect.com springer.com springernature.com theconversation.com unite.ai uscnucleus.org wiley.com",
    "funding_source": "anr.fr arpa-h.gov",
    "listing_source": "findaphd.com",
    "research_source": "arxiv.org biorxiv.org edspace.american.edu medrxiv.org pmc.ncbi.nlm.nih.gov pubmed.ncbi.nlm.nih.gov pure.johnshopkins.edu research.monash.edu scholar.google.com",
}
#: domain -> kind
DOMAINS = {domain: kind for kind, domains in _DOMAINS.items() for domain in domains.split()}
ORGANISATIONS = frozenset("Corporation LocalBusiness MedicalBusiness OnlineBusiness Organization ProfessionalService Store".split())
EDITORIAL_TYPES = frozenset("Article BlogPosting ItemList NewsArticle Review".split())
INSTITUTIONS = frozenset("CollegeOrUniversity EducationalOrganization GovernmentOrganization".split())
#: Failures of a source page after which its home page is still tried.
RECOVERABLE = frozenset([*(f"site_http_{n}" for n in (202, 203, 403, 429, 503)), "network_failure", "response_too_large", "site_not_html"])
#: Reasons of decisions that are final without evidence against the site.
NOT_INSTITUTIONAL = frozenset(["non_institutional_source", "editorial_or_listing_page"])
AUDIT_STRATA = tuple("missing_or_ambiguous_company_identity site_http_403 editorial_or_listing_page site_http_203 non_institutional_source".split())


def domains(spark: SparkSession) -> DataFrame:
    """domain, kind: one row per listed domain (56)."""
    return spark.createDataFrame(sorted(DOMAINS.items()), "domain string, kind string")
