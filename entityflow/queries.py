"""Queries over the test tables, one or more per operator, each beside the SQL that must agree with it.

The tables stand in for the engine's own (pages of a crawl, decisions, batches): every query adapts
columns and then calls the operator itself.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import text as T
from .functions import urls as U
from .operators import audit, coverage, frontier, planner, selection
from .sources import payloads, query_list

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):  # noqa: ANN201
    def add(run: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[run.__name__] = run
        if sql is not None:
            SQL[run.__name__] = sql
        return run

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_SHAPE = "(?s)^\\s*([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)(\\?[^#]*)?(#.*)?$"
_HOST = f"rtrim(lower(string_split(regexp_replace(regexp_extract(url, '{_SHAPE}', 2), '^.*@', ''), ':')[1]), '.')"
_KEY = f"regexp_replace({_HOST}, '^www\\.', '')"
_PATH = f"regexp_extract(rtrim(url), '{_SHAPE}', 3)"
_QUERY = f"substr(regexp_extract(rtrim(url), '{_SHAPE}', 4), 2)"
_PORT = f"regexp_extract(regexp_replace(regexp_extract(url, '{_SHAPE}', 2), '^.*@', ''), '^[^:]*:(.*)$', 1)"
_SCHEME = f"lower(regexp_extract(url, '{_SHAPE}', 1))"


def _encoded_path() -> str:
    out = f"url_encode(CASE WHEN {_PATH} = '' THEN '/' ELSE {_PATH} END)"
    for sign in "/:@!$&()+*,;=~%":
        out = f"replace({out}, '%{ord(sign):02X}', '{sign}')"
    return f"replace({out}, '%27', '''')"


_Q = (
    f"array_to_string([replace(url_encode(url_decode(replace(p[1], '+', ' '))), '%20', '+') || '=' || replace(url_encode(url_decode(replace(p[2], '+', ' '))), '%20', '+') FOR p IN "
    f"list_filter([[string_split(x, '=')[1], CASE WHEN contains(x, '=') THEN regexp_replace(x, '^[^=]*=', '') ELSE '' END] FOR x IN string_split({_QUERY}, '&') IF x <> ''], "
    "lambda p: NOT starts_with(lower(p[1]), 'utm_') AND lower(p[1]) NOT IN ('gclid', 'fbclid', 'msclkid', 'dclid'))], '&')"
)
_NORMAL = f"""CASE WHEN {_SCHEME} IN ('http', 'https') AND {_HOST} <> '' AND {_PORT} IN ('', '80', '443') AND regexp_extract(regexp_extract(url, '{_SHAPE}', 2), '^(.*)@', 1) IN ('', ':')
    THEN {_SCHEME} || '://' || {_HOST} || CASE WHEN {_PORT} = '' OR ({_SCHEME} = 'http' AND {_PORT} = '80') OR ({_SCHEME} = 'https' AND {_PORT} = '443') THEN '' ELSE ':' || {_PORT} END || {_encoded_path()} || CASE WHEN {_Q} = '' THEN '' ELSE '?' || {_Q} END
    ELSE 'invalid_url' END"""


# URLs


@query(f"SELECT page_id, {_NORMAL} AS normalized FROM pages")
def url_normalize(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", U.normalize_url(F.col("url")).alias("normalized"))


@query(f"SELECT page_id, {_HOST} AS host, {_KEY} AS host_key FROM pages")
def url_host_key(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", U.hostname(F.col("url")).alias("host"), U.host_key(F.col("url")).alias("host_key"))


@query(f"SELECT page_id, {_Q} AS kept FROM pages")
def url_tracker_strip(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", U.stripped_query(U.raw_query(F.col("url"))).alias("kept"))


@query(f"SELECT page_id, concat_ws(' ', {_KEY}, {_PORT}, CASE WHEN p = '' THEN '/' ELSE p END) AS site_key FROM (SELECT *, regexp_replace(regexp_replace(regexp_replace({_PATH}, ';[^/]*$', ''), '//+', '/', 'g'), '/$', '') AS p FROM pages)")
def url_site_key(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", U.site_key(F.col("url")).alias("site_key"))


@query(f"SELECT page_id, left({_SCHEME} || '://' || {_HOST} || {_PATH}, 500) AS location FROM pages")
def url_redacted_location(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", U.source_location(F.col("url")).alias("location"))


@query(f"SELECT page_id, {_PATH} SIMILAR TO '/([a-z][a-z](-[a-z][a-z])?)?/?' AS locale_root, regexp_matches({_PATH}, '(?i)/(?:articles?|blog|compare|news|noticias|notícias|press|reviews?)(?:/|$)') AS editorial, regexp_matches('&' || {_QUERY}, '(?i)&error=.') AS error_parameter, TRY_CAST(regexp_extract('&' || {_QUERY}, '&page=([^&]*)', 1) AS INT) AS page FROM pages")
def url_predicates(spark: SparkSession, d: str) -> DataFrame:
    url = F.col("url")
    return table(spark, d, "pages").select("page_id", U.is_locale_root(U.raw_path(url)).alias("locale_root"), U.is_editorial_path(U.raw_path(url)).alias("editorial"), U.has_error_parameter(url).alias("error_parameter"), U.query_value(url, "page").try_cast("int").alias("page"))


@query("SELECT p_partkey, CASE WHEN o > p_size THEN o END AS next_start FROM (SELECT *, (p_partkey % 60)::INT AS o FROM part)")
def legacy_next_offset(spark: SparkSession, d: str) -> DataFrame:
    link = F.concat(F.lit("https://search.example/?q=x&start="), (F.col("p_partkey") % 60).cast("string"))
    return table(spark, d, "part").select("p_partkey", U.next_offset(link, F.col("p_size")).alias("next_start"))


@query(f"""WITH l(domain, kind) AS (VALUES ('example.org', 'listing_source'), ('blog.ththan.example.net', 'editorial_source'), ('spam-farm.example.com', 'intermediary'))
    SELECT page_id, l.kind FROM (SELECT *, {_HOST} AS host FROM pages) p LEFT JOIN l ON p.host = l.domain OR ends_with(p.host, '.' || l.domain)""")
def source_gate_join(spark: SparkSession, d: str) -> DataFrame:
    listed = spark.createDataFrame([("example.org", "listing_source"), ("blog.ththan.example.net", "editorial_source"), ("spam-farm.example.com", "intermediary")], "domain string, kind string")
    return frontier.gated(table(spark, d, "pages").select("page_id", U.hostname(F.col("url")).alias("host")), listed).select("page_id", "kind")


@query("""WITH RECURSIVE n AS (SELECT n_nationkey AS k, CASE WHEN n_nationkey % 4 <> 3 THEN (n_nationkey * 7 + 1) % 25 END AS nxt FROM nation),
    c(k, cur, hops) AS (SELECT k, k, 1 FROM n UNION ALL SELECT c.k, n.nxt, c.hops + 1 FROM c JOIN n ON n.k = c.cur WHERE n.nxt IS NOT NULL AND c.hops <= 6)
    SELECT k::INT AS n_nationkey, CASE WHEN hops <= 6 THEN cur::INT END AS final, hops::INT AS hops, CASE WHEN hops > 6 THEN 'redirect_limit' END AS error FROM c QUALIFY row_number() OVER (PARTITION BY k ORDER BY hops DESC) = 1""")
def redirect_chain(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nation")
    hops = n.filter("n_nationkey % 4 <> 3").select(F.col("n_nationkey").alias("url"), ((F.col("n_nationkey") * 7 + 1) % 25).alias("location"))
    found = frontier.redirect_targets(hops, n.select(F.col("n_nationkey").alias("url")))
    return found.select(F.col("url").alias("n_nationkey"), "final", "hops", "error")


# names, titles, notices

_TITLE = "trim(regexp_extract(html, '<title>([^<]*)</title>', 1))"
_SEP = "\\s+[|–—-]\\s+|\\s*\\|\\s*"


@query(f"""SELECT page_id, (i - 1)::INT AS pos, p AS name FROM (SELECT page_id, unnest(l) AS p, generate_subscripts(l, 1) AS i FROM
    (SELECT page_id, list_filter([trim(x) FOR x IN regexp_split_to_array({_TITLE}, '{_SEP}')], lambda x: lower(x) NOT IN ('home', 'homepage'))[1:3] AS l FROM pages)) WHERE length(p) BETWEEN 2 AND 90""")
def title_parts(spark: SparkSession, d: str) -> DataFrame:
    title = F.trim(F.regexp_extract("html", "<title>([^<]*)</title>", 1))
    return table(spark, d, "pages").select("page_id", F.explode(T.title_parts(title)).alias("x")).select("page_id", "x.pos", "x.name")


@query(f"SELECT page_id, trim(regexp_split_to_array({_TITLE}, '{_SEP}')[1]) AS prefix, trim(regexp_replace({_TITLE}, '\\s+', ' ', 'g')) AS squeezed FROM pages")
def caption_prefix(spark: SparkSession, d: str) -> DataFrame:
    title = F.trim(F.regexp_extract("html", "<title>([^<]*)</title>", 1))
    return table(spark, d, "pages").select("page_id", T.caption_prefix(title).alias("prefix"), T.squeezed(title).alias("squeezed"))


_ANCHOR = "<a href=\"([^\"]*)\">([^<]*)</a>"


@query(f"SELECT page_id, (i - 1)::INT AS pos, regexp_extract(a, '{_ANCHOR}', 1) AS href, regexp_extract(a, '{_ANCHOR}', 2) AS label FROM (SELECT page_id, unnest(l) AS a, generate_subscripts(l, 1) AS i FROM (SELECT page_id, regexp_extract_all(html, '{_ANCHOR}') AS l FROM pages))")
def anchor_explode(spark: SparkSession, d: str) -> DataFrame:
    found = table(spark, d, "pages").select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit(_ANCHOR), F.lit(0))).alias("pos", "a"))
    return found.select("page_id", "pos", F.regexp_extract("a", _ANCHOR, 1).alias("href"), F.regexp_extract("a", _ANCHOR, 2).alias("label"))


@query(f"SELECT page_id, regexp_extract(list_filter(regexp_extract_all(html, '{_ANCHOR}'), lambda a: regexp_matches(a, '>(the|le|der|la)</a>'))[1], '{_ANCHOR}', 2) AS label FROM pages")
def label_anchors(spark: SparkSession, d: str) -> DataFrame:
    labels = F.transform(F.regexp_extract_all("html", F.lit(_ANCHOR), F.lit(0)), lambda a: F.regexp_extract(a, _ANCHOR, 2))
    return table(spark, d, "pages").select("page_id", F.get(F.filter(labels, lambda x: x.rlike("^(?:the|le|der|la)$")), F.lit(0)).alias("label"))


@query("""SELECT page_id, CASE WHEN o <> '' THEN o END AS owner FROM (SELECT page_id, regexp_replace(trim(regexp_extract(replace(regexp_extract(html, '(?s)<footer>(.*?)</footer>', 1), '&copy;', '©'), '^\\s*©\\s*([^<|©&]*)', 1)), '^[ .-]+|[ .-]+$', '', 'g') AS o FROM pages)""")
def footer_owner(spark: SparkSession, d: str) -> DataFrame:
    notice = F.replace(F.regexp_extract("html", "(?s)<footer>(.*?)</footer>", 1), F.lit("&copy;"), F.lit("©"))
    notice = F.trim(F.substring_index(F.regexp_extract(notice, "^[^<]*", 0), "&middot;", 1))
    return table(spark, d, "pages").select("page_id", T.notice_owner(notice).alias("owner"))


_NAME = "regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(n), '^[ ,.-]+|[ ,.-]+$', '', 'g'), '\\.(com|org|net)$', ''), '[\\s,.]+((pte|pty)\\.?\\s+)?(aps|as|ab|ag|corp|corporation|gmbh|inc|incorporated|limited|llc|ltd|plc|srl|s\\.l\\.|s\\.a\\.)\\.?$', ''), '[^a-z0-9]', '', 'g')"


@query(f"SELECT s_suppkey, {_NAME} AS name_key FROM (SELECT s_suppkey, s_name || CASE s_suppkey % 4 WHEN 0 THEN ' Pte. Ltd.' WHEN 1 THEN ', Inc' WHEN 2 THEN '.com' ELSE ' GmbH' END AS n FROM supplier)")
def name_key_ascii(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("s_suppkey") % 4
    name = F.concat("s_name", F.when(k == 0, " Pte. Ltd.").when(k == 1, ", Inc").when(k == 2, ".com").otherwise(" GmbH"))
    return table(spark, d, "supplier").select("s_suppkey", T.name_key(name).alias("name_key"))


_SLUG = "lower(regexp_replace(regexp_replace(p_name, '[^A-Za-z0-9._-]+', '-', 'g'), '^[._-]+|[._-]+$', '', 'g'))"


@query(f"SELECT p_partkey, {_SLUG} AS slug FROM part")
def slug_ascii(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", T.slug(F.col("p_name")).alias("slug"))


@query("SELECT slug, count(*)::BIGINT AS n FROM (SELECT DISTINCT s, lower(replace(s, '#', '-')) AS slug FROM (SELECT CASE WHEN p_partkey % 2 = 0 THEN p_brand ELSE replace(p_brand, '#', '-') END AS s FROM part)) GROUP BY slug HAVING count(*) > 1 OR slug = ''")
def slug_collisions(spark: SparkSession, d: str) -> DataFrame:
    names = table(spark, d, "part").select(F.when(F.col("p_partkey") % 2 == 0, F.col("p_brand")).otherwise(F.replace("p_brand", F.lit("#"), F.lit("-"))).alias("site_name"))
    return selection.collisions(names)


@query("SELECT page_id, 'case-' || substr(sha256('r' || (page_id % 5)::VARCHAR || chr(0) || url), 1, 16) AS case_id FROM pages")
def case_id(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", T.case_id(F.concat(F.lit("r"), (F.col("page_id") % 5).cast("string")), F.col("url")).alias("case_id"))


@query("SELECT doc_id, CASE WHEN lang = 'pt' THEN 'x' WHEN lang = 'es' AND doc_id % 2 = 0 THEN 'pt-PT' WHEN lang = 'es' THEN 'pt-BR' ELSE lang END AS tag FROM documents")
def language_tags(spark: SparkSession, d: str) -> DataFrame:
    code = F.when(F.col("lang") == "es", "pt").otherwise(F.col("lang"))
    return table(spark, d, "documents").select("doc_id", T.language_tag(code, F.when(F.col("doc_id") % 2 == 0, "pt").otherwise("br")).alias("tag"))


# counts, order, scheduling


@query(f"SELECT {_KEY} AS host, count(*)::BIGINT AS n FROM pages GROUP BY 1")
def host_page_counts(spark: SparkSession, d: str) -> DataFrame:
    return audit.tallies(table(spark, d, "pages").select(U.host_key(F.col("url")).alias("host")), "host")


@query("SELECT o_orderpriority, count(*) FILTER (o_orderstatus = 'F')::BIGINT AS f, count(*) FILTER (o_orderstatus = 'O')::BIGINT AS o, count(*) FILTER (o_orderstatus = 'P')::BIGINT AS p FROM orders GROUP BY 1")
def status_counts_pivot(spark: SparkSession, d: str) -> DataFrame:
    pivot = table(spark, d, "orders").groupBy("o_orderpriority").pivot("o_orderstatus", ["F", "O", "P"]).count().fillna(0)
    return pivot.select("o_orderpriority", F.col("F").alias("f"), F.col("O").alias("o"), F.col("P").alias("p"))


@query(f"SELECT page_id, row_number() OVER (PARTITION BY h ORDER BY page_id)::BIGINT AS turn, min(page_id) OVER (PARTITION BY h)::BIGINT AS lead FROM (SELECT page_id, {_KEY} AS h FROM pages)")
def host_interleave(spark: SparkSession, d: str) -> DataFrame:
    return frontier.interleaved(table(spark, d, "pages").select("page_id", U.host_key(F.col("url")).alias("host")), position="page_id").select("page_id", "turn", "lead")


@query(f"SELECT h AS host, min(page_id)::BIGINT AS id FROM (SELECT page_id, {_KEY} AS h FROM pages) WHERE h NOT IN (SELECT {_KEY} FROM pages WHERE page_id % 50 = 0) GROUP BY h")
def ready_heads(spark: SparkSession, d: str) -> DataFrame:
    jobs = table(spark, d, "pages").select(F.col("page_id").alias("id"), U.host_key(F.col("url")).alias("host"))
    return frontier.ready_heads(jobs, jobs.filter("id % 50 = 0"))


@query("SELECT conv_id, turn, row_number() OVER (PARTITION BY turn ORDER BY conv_id)::BIGINT AS place FROM conversations")
def query_round_robin(spark: SparkSession, d: str) -> DataFrame:
    jobs = table(spark, d, "conversations").select("conv_id", F.col("turn").alias("round"))
    return frontier.interleaved(jobs, host="round", position="conv_id").select("conv_id", F.col("round").alias("turn"), F.col("turn").alias("place"))


_EV = "SELECT user_id AS q, date_trunc('day', ts) AS day, event_type || ((event_id % 3)::VARCHAR) AS url FROM events"


def _event_pages(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    e = table(spark, d, "events").select(F.col("user_id").alias("query"), F.date_trunc("day", "ts").alias("day"), F.concat("event_type", (F.col("event_id") % 3).cast("string")).alias("url"))
    results = e.withColumn("idx", F.dense_rank().over(frontier.Window.partitionBy("query").orderBy("day")))
    last = F.max("idx").over(frontier.Window.partitionBy("query"))
    pages = results.select("query", "idx").distinct().withColumn("has_next", F.col("idx") < last)
    return pages.select("query", "idx", "has_next", F.lit("complete").alias("end_status"), F.lit("").alias("end_reason"), F.lit(False).alias("search_error")), results


@query(f"""WITH r AS (SELECT q, url, dense_rank() OVER (PARTITION BY q ORDER BY day) AS idx FROM ({_EV})),
    f AS (SELECT q, url, min(idx) AS idx FROM r GROUP BY q, url), n AS (SELECT q, idx, count(*) AS k FROM f GROUP BY q, idx),
    p AS (SELECT q, idx, max(idx) OVER (PARTITION BY q) AS last FROM (SELECT DISTINCT q, idx FROM r)),
    s AS (SELECT p.q, p.idx, CASE WHEN coalesce(n.k, 0) = 0 THEN 'incomplete/repeated_results' WHEN p.idx = p.last THEN 'complete/' WHEN p.idx >= 6 THEN 'limited/max_pages' END AS e FROM p LEFT JOIN n ON n.q = p.q AND n.idx = p.idx)
    SELECT q AS query, idx::INT AS idx, string_split(e, '/')[1] AS status, string_split(e, '/')[2] AS reason FROM s WHERE e IS NOT NULL QUALIFY row_number() OVER (PARTITION BY q ORDER BY idx) = 1""")
def repeated_results_stop(spark: SparkSession, d: str) -> DataFrame:
    pages, results = _event_pages(spark, d)
    return frontier.stop_pages(pages, results, 6)


@query(f"WITH r AS (SELECT q, url, dense_rank() OVER (PARTITION BY q ORDER BY day) AS idx FROM ({_EV})) SELECT q AS query, url, idx::INT AS idx FROM r QUALIFY min(idx) OVER (PARTITION BY q, url) = idx")
def seen_filter(spark: SparkSession, d: str) -> DataFrame:
    return frontier.unseen(_event_pages(spark, d)[1]).select("query", "url", "idx")


# coverage


def _positions(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("query"), F.col("l_linenumber").alias("page"))


@query("SELECT l_orderkey AS query, count(*)::BIGINT AS pages, max(l_linenumber) AS last_page, min(l_linenumber) = 1 AND max(l_linenumber) = count(DISTINCT l_linenumber) AND count(*) = count(DISTINCT l_linenumber) AS contiguous FROM lineitem GROUP BY 1")
def page_contiguity(spark: SparkSession, d: str) -> DataFrame:
    return coverage.page_coverage(_positions(spark, d)).select("query", "pages", "last_page", "contiguous")


@query("SELECT l_orderkey AS query, l_linenumber AS page, count(*)::BIGINT AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def duplicate_positions(spark: SparkSession, d: str) -> DataFrame:
    return coverage.duplicate_positions(_positions(spark, d), "query", "page")


@query("SELECT o_orderkey AS query FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_linenumber = 1)")
def missing_first_page(spark: SparkSession, d: str) -> DataFrame:
    return coverage.without_first_page(table(spark, d, "orders").select(F.col("o_orderkey").alias("query")), _positions(spark, d))


@query("SELECT query, page, coalesce(lead(page) OVER (PARTITION BY query ORDER BY page) = page + 1, false) AS has_next FROM (SELECT DISTINCT l_orderkey AS query, l_linenumber AS page FROM lineitem)")
def has_next(spark: SparkSession, d: str) -> DataFrame:
    return coverage.with_next(_positions(spark, d))


@query("""SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' OR (o_orderstatus <> 'O' AND o_totalprice > 300000) THEN 'incomplete' WHEN o_orderkey % 7 >= 5 THEN 'limited' ELSE 'complete' END AS status,
    CASE WHEN o_orderstatus = 'F' THEN 'apify_search_page_failed' WHEN o_orderstatus <> 'O' AND o_totalprice > 300000 THEN 'apify_cost_limit' WHEN o_orderkey % 7 >= 5 THEN 'max_pages' ELSE '' END AS reason FROM orders""")
def coverage_status(spark: SparkSession, d: str) -> DataFrame:
    run = F.when((F.col("o_orderstatus") != "O") & (F.col("o_totalprice") > 300000), "apify_cost_limit").otherwise("")
    status = coverage.coverage_status(F.when(F.col("o_orderstatus") == "F", 1).otherwise(0), run, F.col("o_orderkey") % 7, F.lit(5))
    return table(spark, d, "orders").select("o_orderkey", status.alias("s")).select("o_orderkey", "s.status", "s.reason")


@query("SELECT o_orderkey, CASE WHEN o_totalprice >= 250000 THEN 'apify_cost_limit' WHEN o_orderstatus = 'F' AND o_orderkey % 3 = 0 THEN '' ELSE 'apify_completion_unverified' END AS reason FROM orders")
def completion_reason(spark: SparkSession, d: str) -> DataFrame:
    state = F.when(F.col("o_orderstatus") == "F", "SUCCEEDED").otherwise("FAILED")
    why = coverage.completion_reason(F.col("o_totalprice"), F.lit(250000.0), state, F.lit(0), F.lit(0), F.col("o_orderkey") % 3, F.lit(0))
    return table(spark, d, "orders").select("o_orderkey", why.alias("reason"))


@query("""SELECT query, page, CASE WHEN g AND b THEN 'both' WHEN g THEN 'success' ELSE 'marker' END AS outcome FROM (SELECT query, page, bool_or(g) AS g, bool_or(NOT g) AS b FROM
    (SELECT l_orderkey AS query, l_linenumber AS page, true AS g FROM lineitem WHERE l_returnflag <> 'R' UNION ALL SELECT l_orderkey, l_linenumber, false FROM lineitem WHERE l_linestatus = 'F') GROUP BY 1, 2)""")
def success_failure_merge(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("query"), F.col("l_linenumber").alias("page"), "l_returnflag", "l_linestatus")
    return coverage.merged_positions(rows.filter("l_returnflag <> 'R'"), rows.filter("l_linestatus = 'F'"))


@query("SELECT o_custkey AS query FROM orders GROUP BY 1 HAVING bool_and(o_orderstatus <> 'O')")
def completed_queries(spark: SparkSession, d: str) -> DataFrame:
    jobs = table(spark, d, "orders").select(F.col("o_custkey").alias("query"), F.col("o_orderkey").alias("id"), "o_orderstatus")
    return coverage.finished_queries(jobs.select("query", "id"), jobs.filter("o_orderstatus <> 'O'").select("id"))


# planning and resume


@query("SELECT query, rn, (rn - 1) // 20 AS batch, 10::BIGINT AS reserve FROM (SELECT c_custkey AS query, row_number() OVER (ORDER BY c_custkey)::BIGINT AS rn FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderkey % 11 = 0)) WHERE rn <= (5000 - 300) // 10")
def batch_plan(spark: SparkSession, d: str) -> DataFrame:
    queries = table(spark, d, "customer").select(F.col("c_custkey").alias("query"), F.col("c_custkey").alias("pos"))
    cached = table(spark, d, "orders").filter("o_orderkey % 11 = 0").select(F.col("o_custkey").alias("query"))
    return planner.batch_plan(queries, cached, 300, 5000, 10, 20)


@query("SELECT c_nationkey, c_custkey, sum(c_custkey % 7) OVER (PARTITION BY c_nationkey ORDER BY c_custkey)::BIGINT AS reserved, sum(c_custkey % 7) OVER (PARTITION BY c_nationkey ORDER BY c_custkey) > 100 AS exceeded FROM customer")
def reservation_running_sum(spark: SparkSession, d: str) -> DataFrame:
    batches = table(spark, d, "customer").select("c_nationkey", F.col("c_custkey").alias("id"), (F.col("c_custkey") % 7).alias("reserved_pages"))
    return planner.running_reservations(batches, 100, "c_nationkey").select("c_nationkey", F.col("id").alias("c_custkey"), "reserved", "exceeded")


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1)")
def resume_anti_join(spark: SparkSession, d: str) -> DataFrame:
    results = table(spark, d, "documents").select("doc_id", F.lit("q").alias("query"), F.col("doc_id").cast("string").alias("url"))
    stored = table(spark, d, "labels").select(F.lit("q").alias("query"), F.col("doc_id").cast("string").alias("discovered_url"), F.when(F.col("quality") == 1, "confirmed").otherwise("pending").alias("status"))
    return frontier.work_left(results, stored, retry_pending=True).select("doc_id")


@query("SELECT doc_id, source FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")
def saved_queries_semi(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", "source").join(table(spark, d, "labels").select("doc_id").distinct(), "doc_id", "left_semi")


@query("SELECT c_custkey, CASE WHEN c_acctbal < 0 AND c_custkey NOT IN (SELECT o_custkey FROM orders) THEN 'not_started' WHEN c_acctbal < 0 THEN 'incomplete' ELSE 'complete' END AS status FROM customer")
def repair_not_exists(spark: SparkSession, d: str) -> DataFrame:
    progress = table(spark, d, "customer").select(F.col("c_custkey"), F.when(F.col("c_acctbal") < 0, "incomplete").otherwise("complete").alias("status"))
    pages = table(spark, d, "orders").select(F.col("o_custkey").alias("query"))
    return frontier.repaired(progress.withColumnRenamed("c_custkey", "query"), pages).withColumnRenamed("query", "c_custkey")


# selection and audit


def _decisions(spark: SparkSession, d: str) -> DataFrame:
    """Pages as decisions: the name is the title's first word, the query the page's language."""
    p = table(spark, d, "pages")
    name = F.regexp_extract("html", "<title>([A-Za-zÀ-ÿ]+)", 1)
    return p.select("page_id", F.regexp_extract("html", '<html lang="([^"]*)"', 1).alias("query"), F.col("url").alias("discovered_url"), name.alias("name"), F.concat(U.scheme(F.col("url")), F.lit("://"), U.hostname(F.col("url")), F.lit("/")).alias("url"), F.when(F.col("page_id") % 5 == 4, "pending").when(F.col("page_id") % 5 == 3, "skipped").otherwise("confirmed").alias("status"))


_DEC = f"""SELECT page_id, regexp_extract(html, '<html lang="([^"]*)"', 1) AS query, url AS discovered_url, regexp_extract(html, '<title>([A-Za-zÀ-ÿ]+)', 1) AS name, {_SCHEME} || '://' || {_HOST} || '/' AS url,
    {_KEY} || '  /' AS key, CASE page_id % 5 WHEN 4 THEN 'pending' WHEN 3 THEN 'skipped' ELSE 'confirmed' END AS status FROM pages"""
_SITES = f"""WITH a AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY query, discovered_url) AS rn FROM ({_DEC}) WHERE status = 'confirmed'),
    f AS (SELECT name, first_value(name) OVER w AS site_name, first_value(url) OVER w AS site_url FROM a WHERE rn = 1 WINDOW w AS (PARTITION BY key ORDER BY query, discovered_url)),
    s AS (SELECT a.query, a.discovered_url, a.name, a.url, f.site_name, f.site_url FROM a JOIN f ON f.name = a.name)"""


@query(f"{_SITES} SELECT * FROM s")
def handoff_select(spark: SparkSession, d: str) -> DataFrame:
    return selection.sites(_decisions(spark, d)).drop("site_query", "site_source")


@query(f"{_SITES} SELECT site_name, row_number() OVER (PARTITION BY site_name ORDER BY q, u)::BIGINT AS pos, name, url FROM (SELECT site_name, name, url, min((query, discovered_url)) AS m, m[1] AS q, m[2] AS u FROM s WHERE name <> site_name OR url <> site_url GROUP BY site_name, name, url)")
def handoff_alternatives(spark: SparkSession, d: str) -> DataFrame:
    return selection.alternatives(selection.sites(_decisions(spark, d)))


@query(f"{_SITES} SELECT site_name, string_agg(query || ' ' || discovered_url, ',' ORDER BY query, discovered_url) AS sources FROM s GROUP BY 1")
def handoff_sources(spark: SparkSession, d: str) -> DataFrame:
    found = selection.provenance(selection.sites(_decisions(spark, d)))
    return found.select("site_name", F.array_join(F.transform("sources", lambda x: F.concat_ws(" ", x["query"], x["discovered_url"])), ",").alias("sources"))


@query(f"{_SITES}, n AS (SELECT count(DISTINCT site_name)::BIGINT AS sites FROM s) SELECT n.sites, c.confirmed, c.confirmed - n.sites AS duplicates, c.pending, c.skipped FROM n, (SELECT count(*) FILTER (status = 'confirmed')::BIGINT AS confirmed, count(*) FILTER (status = 'pending')::BIGINT AS pending, count(*) FILTER (status = 'skipped')::BIGINT AS skipped FROM ({_DEC})) c")
def handoff_counts(spark: SparkSession, d: str) -> DataFrame:
    rows = _decisions(spark, d)
    return selection.counts(rows, selection.sites(rows).select("site_name").distinct().count())


@query("SELECT count(*) > 0 AND bool_and(o_orderstatus = 'F') AS search_complete, NOT (count(*) > 0 AND bool_and(o_orderstatus = 'F')) AS partial FROM orders")
def coverage_flags(spark: SparkSession, d: str) -> DataFrame:
    progress = table(spark, d, "orders").select(F.when(F.col("o_orderstatus") == "F", "complete").otherwise("incomplete").alias("status"))
    return selection.completeness(progress, 0)


@query(f"SELECT name AS \"CompanyName\", url AS \"URL\", query AS \"SearchQuery\", discovered_url FROM ({_DEC}) WHERE status = 'confirmed' QUALIFY row_number() OVER (PARTITION BY url, query ORDER BY query, discovered_url) = 1")
def csv_first_wins(spark: SparkSession, d: str) -> DataFrame:
    return selection.companies(_decisions(spark, d))


def _pending(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select(F.lit("pending").alias("status"), F.concat(F.lit("r"), (F.col("page_id") % 5).cast("string")).alias("reason"), F.col("url").alias("discovered_url"), (F.col("page_id") % 3).cast("string").alias("query"))


_CASES = f"SELECT 'r' || (page_id % 5)::VARCHAR AS reason, url, string_agg(DISTINCT (page_id % 3)::VARCHAR, ',' ORDER BY (page_id % 3)::VARCHAR) AS queries, {_KEY} AS host FROM pages GROUP BY reason, url"
_STRATA = ("r0", "r1", "r2", "r3", "r4")


@query(_CASES)
def audit_cases(spark: SparkSession, d: str) -> DataFrame:
    return audit.cases(_pending(spark, d), _STRATA).select("reason", "url", F.array_join("queries", ",").alias("queries"), "host")


@query(f"""WITH c AS (SELECT *, sha256('42' || chr(0) || reason || chr(0) || url) AS h FROM ({_CASES})), t AS (SELECT *, row_number() OVER (PARTITION BY reason, host ORDER BY h, url) AS k FROM c)
    SELECT reason, url, row_number() OVER (PARTITION BY reason ORDER BY k > 1, h, url)::BIGINT AS place FROM t QUALIFY place <= 20""")
def audit_sample_hash(spark: SparkSession, d: str) -> DataFrame:
    return audit.sampled(audit.cases(_pending(spark, d), _STRATA), 20).select("reason", "url", "place")


@query("""SELECT regexp_extract(html, '<html lang="([^"]*)"', 1) AS query, url, string_agg(DISTINCT t, '|' ORDER BY t) AS titles FROM (SELECT *, regexp_extract(html, '<title>([^<]*)', 1) AS t FROM pages) GROUP BY 1, 2""")
def search_details(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "pages").select(F.regexp_extract("html", '<html lang="([^"]*)"', 1).alias("query"), "url", F.regexp_extract("html", "<title>([^<]*)", 1).alias("title"), F.lit("").alias("snippet"))
    return audit.search_details(rows).select("query", "url", F.array_join("titles", "|").alias("titles"))


@query("SELECT l.doc_id, l.quality AS status, d.q AS before_status FROM labels l LEFT JOIN (SELECT doc_id, (doc_id % 9 <> 0)::INT AS q FROM documents WHERE doc_id % 10 <> 0) d ON d.doc_id = l.doc_id WHERE d.doc_id IS NULL OR d.q IS DISTINCT FROM l.quality")
def recheck_diff(spark: SparkSession, d: str) -> DataFrame:
    before = table(spark, d, "documents").filter("doc_id % 10 <> 0").select("doc_id", (F.col("doc_id") % 9 != 0).cast("int").alias("status"))
    return audit.changes(before, table(spark, d, "labels").select("doc_id", F.col("quality").alias("status")), ("doc_id",), ("status",))


@query("SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' AND o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'skipped' WHEN o_orderstatus = 'P' THEN 'pending' ELSE 'confirmed' END AS status FROM orders")
def reclassify(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders").select("o_orderkey", F.when(F.col("o_orderstatus") == "P", "pending").otherwise("confirmed").alias("status"), F.col("o_orderpriority").alias("reason"))
    return audit.reclassified(rows, ("1-URGENT", "2-HIGH")).select("o_orderkey", "status")


# JSON and lists


@query("SELECT event_type, count(*) FILTER (TRY_CAST(json_extract_string(props, '$.k') AS INT) >= 50)::BIGINT AS n, count(json_extract_string(props, '$.missing'))::BIGINT AS missing FROM events GROUP BY 1")
def json_filter_count(spark: SparkSession, d: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").try_cast("int")
    return table(spark, d, "events").groupBy("event_type").agg(F.count_if(k >= 50).alias("n"), F.count(F.get_json_object("props", "$.missing")).alias("missing"))


@query("SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS INT) AS k, CASE WHEN TRY_CAST(json_extract_string(props, '$.k') AS INT) >= 50 THEN 'skipped' ELSE event_type END AS status FROM events")
def json_update(spark: SparkSession, d: str) -> DataFrame:
    parsed = table(spark, d, "events").select("event_id", F.struct(F.from_json("props", "k int")["k"].alias("k"), F.col("event_type").alias("status")).alias("payload"))
    updated = F.when(F.col("payload.k") >= 50, F.col("payload").withField("status", F.lit("skipped"))).otherwise(F.col("payload"))
    return parsed.select("event_id", updated.alias("p")).select("event_id", "p.k", "p.status")


@query("""SELECT doc_id, line, min(i)::BIGINT AS pos FROM (SELECT doc_id, trim(unnest(l)) AS line, generate_subscripts(l, 1) - 1 AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)) WHERE line <> '' GROUP BY 1, 2""")
def query_list_lines(spark: SparkSession, d: str) -> DataFrame:
    return query_list.lines(table(spark, d, "documents"), "text", "doc_id")


@query("""SELECT page_id, k::INT AS page, (page_id % 7 > k) AS has_next, CASE WHEN page_id % 7 > k THEN 'running' ELSE 'complete' END AS end_status, (1 + page_id % 3)::INT AS n FROM pages, range(1, 4) r(k)""")
def payload_parse(spark: SparkSession, d: str) -> DataFrame:
    base = table(spark, d, "pages").select("page_id", "url", F.explode(F.sequence(F.lit(1), F.lit(3))).alias("page"))
    results = F.transform(F.sequence(F.lit(1), (F.col("page_id") % 3 + 1).cast("int")), lambda i: F.struct(F.lit("t").alias("title"), F.col("url").alias("url"), F.lit("").alias("description")))
    more = F.col("page_id") % 7 > F.col("page")
    payload = F.to_json(F.struct(F.lit("apify-google").alias("provider"), results.alias("organicResults"), more.alias("has_next"), F.when(more, "running").otherwise("complete").alias("end_status"), F.lit("").alias("end_reason"), F.struct(F.lit("q").alias("term"), F.col("page").alias("page")).alias("searchQuery")))
    parsed = payloads.parsed(base.select("page_id", "page", F.lit("q").alias("query"), ((F.col("page") - 1) * 10).alias("start"), payload.alias("payload")))
    return parsed.select("page_id", "page", (F.col("next_start").isNotNull()).alias("has_next"), "end_status", F.size("results").alias("n"))


@query("""WITH s AS (SELECT page_id AS page, 'title' AS context, regexp_extract(html, '<title>([A-Za-zÀ-ÿ]+)', 1) AS name, 0 AS pos FROM pages UNION ALL
    SELECT page_id, 'copyright', CASE WHEN page_id % 3 = 0 THEN regexp_extract(html, '<title>([A-Za-zÀ-ÿ]+)', 1) ELSE 'Other' END, 1 FROM pages UNION ALL SELECT page_id, 'logo', 'Other', 2 FROM pages WHERE page_id % 6 = 1),
    g AS (SELECT page, lower(name) AS key, count(DISTINCT context) AS c, bool_or(context <> 'title') AS o, arg_min(name, pos) AS name FROM s WHERE name <> '' GROUP BY 1, 2),
    m AS (SELECT page, count(*) AS n, min(key) AS key, min(name) AS name FROM g WHERE c >= 2 AND o GROUP BY page),
    bad AS (SELECT m.page FROM m JOIN s ON s.page = m.page WHERE s.context = 'copyright' AND lower(s.name) <> m.key)
    SELECT p.page_id AS page, CASE WHEN m.n = 1 AND p.page_id NOT IN (SELECT page FROM bad) THEN m.name END AS name, coalesce(m.n > 1 OR (m.n = 1 AND p.page_id IN (SELECT page FROM bad)), false) AS conflict FROM pages p LEFT JOIN m ON m.page = p.page_id""")
def identity_agreement(spark: SparkSession, d: str) -> DataFrame:
    from .plans.identity import weak_agreement

    p = table(spark, d, "pages")
    name = F.regexp_extract("html", "<title>([A-Za-zÀ-ÿ]+)", 1)
    signal = lambda pos, context, n: F.struct(F.lit(pos).alias("pos"), F.lit(context).alias("context"), n.alias("name"))
    signals = p.select(F.col("page_id").alias("page"), F.explode(F.filter(F.array(signal(0, "title", name), signal(1, "copyright", F.when(F.col("page_id") % 3 == 0, name).otherwise("Other")), F.when(F.col("page_id") % 6 == 1, signal(2, "logo", F.lit("Other")))), lambda x: x.isNotNull())).alias("s")).select("page", "s.*")
    return weak_agreement(p.select(F.col("page_id").alias("page")), signals.withColumn("key", F.lower("name")))


# decisions (no SQL: HTML trees and a decision tree; FIXTURES.md cases are in tests)


@query()
def resolve_pages(spark: SparkSession, d: str) -> DataFrame:
    from .plans.resolve import resolve

    pages = table(spark, d, "pages")
    corpus = pages.select("url", F.col("url").alias("final_url"), F.lit(200).alias("status"), F.lit("text/html").alias("content_type"), "html")
    results = pages.select(F.regexp_extract("html", '<html lang="([^"]*)"', 1).alias("query"), "url")
    return resolve(results, corpus).select("query", "discovered_url", "status", "name", F.col("url").alias("entrypoint"), "reason")


# stored state: lookups, scans, counters


@query("SELECT c.conv_id, c.turn, c.text FROM conversations c WHERE EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = c.conv_id AND l.toxic = c.turn)")
def page_lookup(spark: SparkSession, d: str) -> DataFrame:
    wanted = table(spark, d, "labels").select(F.col("doc_id").alias("query"), F.col("toxic").alias("start"))
    stored = table(spark, d, "conversations").select(F.col("conv_id").alias("query"), F.col("turn").alias("start"), "text")
    return frontier.looked_up(stored, wanted).toDF("conv_id", "turn", "text")


@query("SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn)::BIGINT AS place FROM conversations")
def saved_pages(spark: SparkSession, d: str) -> DataFrame:
    stored = table(spark, d, "conversations").select(F.col("conv_id").alias("query"), F.col("turn").alias("start"), "role")
    return frontier.saved(stored).toDF("conv_id", "turn", "role", "place")


@query("SELECT o_custkey AS query, o_orderkey AS discovered_url FROM orders ORDER BY o_custkey, o_orderkey")
def ordered_resolutions(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select(F.col("o_custkey").alias("query"), F.col("o_orderkey").alias("discovered_url")).orderBy("query", "discovered_url")


@query("SELECT c.c_custkey AS query, o.n AS pages FROM customer c LEFT JOIN (SELECT o_custkey, count(*)::BIGINT AS n FROM orders GROUP BY 1) o ON o.o_custkey = c.c_custkey")
def coverage_lookup(spark: SparkSession, d: str) -> DataFrame:
    stored = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("query")).agg(F.count(F.lit(1)).alias("pages"))
    return table(spark, d, "customer").select(F.col("c_custkey").alias("query")).join(stored, "query", "left")


def _batches(spark: SparkSession, d: str) -> DataFrame:
    state = F.when(F.col("o_orderstatus") == "F", "done").when(F.col("o_orderstatus") == "O", "abandoned").when(F.col("o_orderkey") % 2 == 0, "running").otherwise("planned")
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("reserved_pages"), state.alias("status"))


@query("SELECT min(o_orderkey) AS id FROM orders WHERE o_orderstatus = 'P'")
def open_batch(spark: SparkSession, d: str) -> DataFrame:
    return planner.open_batch(_batches(spark, d)).select("id")


@query("SELECT coalesce(sum(o_custkey), 0)::BIGINT AS reserved, count(*) FILTER (o_orderstatus = 'F')::BIGINT AS done FROM orders")
def reserved_sum(spark: SparkSession, d: str) -> DataFrame:
    rows = _batches(spark, d)
    return rows.agg(F.count_if(F.col("status") == "done").alias("done")).withColumn("reserved", F.lit(planner.reserved_pages(rows)).cast("long"))


@query("SELECT o_orderkey AS id, CASE WHEN o_orderstatus = 'P' AND o_orderkey % 2 = 0 THEN 'done' WHEN o_orderstatus = 'F' THEN 'done' WHEN o_orderstatus = 'O' THEN 'abandoned' ELSE 'planned' END AS status FROM orders")
def batch_transitions(spark: SparkSession, d: str) -> DataFrame:
    return planner.moved(_batches(spark, d), F.col("status") == "running", "done").select("id", "status")


@query("""WITH p AS (SELECT c_custkey, k, c_custkey % 5 = 0 AND k = c_custkey % 4 + 1 AS failed, c_custkey % 4 + 1 AS last FROM customer, range(1, 5) r(k) WHERE k <= c_custkey % 4 + 1)
    SELECT 'q' || c_custkey::VARCHAR AS query, count(*) FILTER (NOT failed OR c_custkey % 7 = 0)::INT AS pages, max(last)::INT AS last_page, coalesce(string_agg(k::VARCHAR, ',') FILTER (failed), '') AS failed_pages,
    CASE WHEN bool_or(failed) THEN 'incomplete' WHEN max(last) = 4 THEN 'limited' ELSE 'complete' END AS status, CASE WHEN bool_or(failed) THEN 'apify_search_page_failed' WHEN max(last) = 4 THEN 'max_pages' ELSE '' END AS reason FROM p GROUP BY c_custkey""")
def batch_import(spark: SparkSession, d: str) -> DataFrame:
    """One batch with every customer as a query, 1 to 4 pages each, some last pages failed, some of those there too."""
    from .plans.batch_import import coverage_of, judged

    queries = table(spark, d, "customer").select("c_custkey", F.concat(F.lit("q"), F.col("c_custkey").cast("string")).alias("query"))
    pages = queries.withColumn("page", F.explode(F.sequence(F.lit(1), (F.col("c_custkey") % 4 + 1).cast("int"))))
    failed = (F.col("c_custkey") % 5 == 0) & (F.col("page") == F.col("c_custkey") % 4 + 1)
    good = F.to_json(F.struct(F.struct(F.col("query").alias("term"), "page").alias("searchQuery"), F.array(F.struct(F.concat(F.lit("https://x.example/"), "query").alias("url"))).alias("organicResults")))
    address = F.concat(F.lit("https://www.google.com/search?q="), "query", F.lit("&start="), ((F.col("page") - 1) * 10).cast("string"))
    bad = F.to_json(F.struct(F.lit(True).alias("#error"), F.struct(F.lit("GET").alias("method"), address.alias("url"), F.lit(3).alias("retryCount")).alias("#debug")))
    items = pages.withColumn("payload", F.explode(F.when(failed & (F.col("c_custkey") % 7 == 0), F.array(good, bad)).when(failed, F.array(bad)).otherwise(F.array(good))))
    items = items.select(F.xxhash64("query", "page", "payload").alias("record"), "payload")
    found = coverage_of(judged(items, queries, 4), F.lit(""), 4)
    return found.select("query", "pages", "last_page", F.array_join(F.col("failed_pages").cast("array<string>"), ",").alias("failed_pages"), "status", "reason")


@query("SELECT string_agg(n_name || '=' || n_regionkey::VARCHAR, ';' ORDER BY n_name) AS metadata FROM nation")
def export_metadata(spark: SparkSession, d: str) -> DataFrame:
    entries = F.array_sort(F.map_entries(F.map_from_entries(F.collect_list(F.struct("n_name", F.col("n_regionkey").cast("string"))))))
    return table(spark, d, "nation").agg(F.array_join(F.transform(entries, lambda e: F.concat_ws("=", e["key"], e["value"])), ";").alias("metadata"))


@query("SELECT CASE WHEN count(*) FILTER (o_orderstatus <> 'F') > 0 THEN 2 ELSE 0 END AS code FROM orders")
def exit_code(spark: SparkSession, d: str) -> DataFrame:
    progress = table(spark, d, "orders").select(F.when(F.col("o_orderstatus") == "F", "complete").otherwise("incomplete").alias("status"))
    return spark.createDataFrame([(coverage.exit_code(False, progress, progress.limit(0)),)], "code int")


# text and JSON scalars


@query("""SELECT doc_id, regexp_extract(coalesce(text, ''), '(?i)(?:^|[^a-z0-9])(of the|in the|de la|und der)(?:[^a-z0-9]|$)', 1) AS phrase, string_agg(DISTINCT x, ',' ORDER BY x) AS types FROM (SELECT doc_id, text, unnest([lang, source, 'schema/' || lang]) AS y, string_split(y, '/')[-1] AS x FROM documents) GROUP BY doc_id, text""")
def phrase_and_types(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    types = F.array(F.col("lang"), F.col("source"), F.concat(F.lit("schema/"), F.col("lang")))
    return docs.select("doc_id", F.regexp_extract(F.coalesce("text", F.lit("")), r"(?i)(?:^|[^a-z0-9])(of the|in the|de la|und der)(?:[^a-z0-9]|$)", 1).alias("phrase"), F.array_join(T.type_names(types), ",").alias("types"))


@query(f"""SELECT page_id, CASE WHEN ends_with({_HOST}, 'example.org') THEN 'non_institutional_source' WHEN page_id % 7 = 0 THEN 'site_http_403' WHEN page_id % 5 = 0 THEN 'site_not_html' WHEN page_id % 3 = 0 THEN 'site_interstitial' END AS error FROM pages""")
def page_gate(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "pages")
    kind = frontier.gate_kind(U.hostname(F.col("url")), {"example.org": "listing_source"})
    status = F.when(F.col("page_id") % 7 == 0, 403).otherwise(200)
    content = F.when(F.col("page_id") % 5 == 0, "application/pdf").otherwise("text/html; charset=utf-8")
    title = F.when(F.col("page_id") % 3 == 0, "Access denied").otherwise("A page")
    return p.select("page_id", T.page_gate(kind, status, content, title).alias("error"))


@query("SELECT event_id, left(event_type, 500) || ': ' || trim(regexp_replace(props, '\\s+', ' ', 'g')) AS error FROM events")
def api_error_text(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", T.api_error(F.col("event_type"), F.col("props")).alias("error"))


@query("""SELECT n_nationkey, string_agg(u, ' ' ORDER BY k) AS homes FROM (SELECT n_nationkey, u, min(k) AS k FROM (SELECT n_nationkey, unnest([n_name, 'https://x/']) AS u, unnest([1, 3]) AS k FROM nation
    UNION ALL SELECT n_nationkey, 'https://x/' || repeat('a', (n_nationkey * i) % 7), 2 + ((n_nationkey * i) % 7) / 10.0 FROM nation, range(1, 4) r(i)) GROUP BY 1, 2) GROUP BY 1""")
def home_candidates(spark: SparkSession, d: str) -> DataFrame:
    links = F.transform(F.array(F.lit(1), F.lit(2), F.lit(3)), lambda i: F.concat(F.lit("https://x/"), F.repeat(F.lit("a"), (F.col("n_nationkey") * i % 7).cast("int"))))
    return table(spark, d, "nation").select("n_nationkey", F.array_join(T.home_order(F.col("n_name"), links, F.lit("https://x/")), " ").alias("homes"))


@query("SELECT page_id, CASE WHEN page_id % 4 < 2 THEN 'q' END AS term, CASE WHEN page_id % 4 < 2 THEN (page_id % 5 + 1)::INT END AS page FROM pages")
def failed_requests(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("page_id") % 4
    address = F.concat(F.when(k == 0, "https://www.google.com").when(k == 1, "http://google.com.br:80").when(k == 2, "https://google.evil.example").otherwise("https://u:p@google.com"), F.lit("/search?q=q&start="), (F.col("page_id") % 5 * 10).cast("string"))
    got = payloads.mapped_failure(address, F.array(F.lit("q")), 5)
    return table(spark, d, "pages").select("page_id", got["term"].alias("term"), got["page"].alias("page"))


@query("""WITH RECURSIVE s AS (SELECT c_nationkey AS query, c_custkey AS start, CASE WHEN c_custkey % 5 <> 0 THEN c_custkey + 1 + c_custkey % 3 END AS nxt FROM customer),
    walk(query, start, nxt, idx) AS (SELECT * , 1 FROM s QUALIFY row_number() OVER (PARTITION BY query ORDER BY start) = 1 UNION ALL SELECT s.query, s.start, s.nxt, w.idx + 1 FROM walk w JOIN s ON s.query = w.query AND s.start = w.nxt)
    SELECT query, start::INT AS start, idx::INT AS idx FROM walk""")
def page_chain(spark: SparkSession, d: str) -> DataFrame:
    from .plans.runs import chain

    k = F.col("c_custkey").cast("int")
    rows = table(spark, d, "customer").select(F.col("c_nationkey").alias("query"), k.alias("start"), F.when(k % 5 != 0, k + 1 + k % 3).alias("next_start"))
    return chain(rows).select("query", "start", "idx")
