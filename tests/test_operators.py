"""Small cases of FIXTURES.md: URLs, coverage, planning, selection, diff, state, sinks, streaming."""

import json
import math
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from entityflow.functions import text as T
from entityflow.functions import urls as U
from entityflow.operators import audit, coverage, frontier, planner, selection
from entityflow.plans import pages as P
from entityflow.plans import runs
from entityflow.sinks import OutputError, export
from entityflow.sources import payloads, query_list
from entityflow.state import SCHEMAS, State, StateError

URLS = {
    "HTTPS://FIRM.example.net/de/shop/?lang=2&utm_medium=x#end": "https://firm.example.net/de/shop/?lang=2",
    "file:///etc/passwd": "invalid_url",
    "https://me:pw@firm.example": "invalid_url",
    "javascript:alert(1)": "invalid_url",
    "https://example.org:8000": "invalid_url",
    "https://firm.example/übung/straße": "https://firm.example/%C3%BCbung/stra%C3%9Fe",
    "https://example.org/quem somos": "https://example.org/quem%20somos",
    "https://firm.example/x%2Fy/%C3%A9": "https://firm.example/x%2Fy/%C3%A9",
    "https://firm.example/k:=+*)('&$!@,;z": "https://firm.example/k:=+*)('&$!@,;z",
    "http://example.org:443/?a&b=1+2&c=%20x": "http://example.org:443/?a=&b=1+2&c=+x",
    "https://[2001:db8::1]:443": "https://[2001:db8::1]/",
    "http://Example.org.:80": "http://example.org/",
    "": "invalid_url",
}


def test_normalize_url(spark):
    rows = spark.createDataFrame([(u,) for u in URLS] + [(None,)], "u string").select("u", U.normalize_url(F.col("u")).alias("n")).collect()
    assert {r["u"]: r["n"] for r in rows} == URLS | {None: "invalid_url"}
    assert {u: P.normalize(u) or "invalid_url" for u in URLS} == URLS


def test_site_keys_agree(spark):
    same = [f"https://{x}" for x in "firm.example firm.example/ firm.example/// firm.example/;s=2 firm.example/?a=1#z".split()] + ["http://www.firm.example"]
    rows = spark.createDataFrame([(u,) for u in same], "u string").select(U.site_key(F.col("u")).alias("k")).distinct().collect()
    assert len(rows) == 1
    row = spark.createDataFrame([("https://a.example/x%c3%a7//y/",)], "u string").select(U.site_key(F.col("u")).alias("k")).first()
    assert row["k"] == "a.example  /x%C3%A7/y"


def test_text_functions(spark):
    row = spark.range(1).select(
        T.notice_owner(F.lit("© 2020–2024 by Acme GmbH. All rights reserved")).alias("a"), T.notice_owner(F.lit("Copyright policy")).alias("b"),
        T.name_key(F.lit("Acme Pte. Ltd.")).alias("c"), F.lit("PRODUTOS E SERVIÇOS").rlike(T.OFFER_LABEL).alias("d"), F.lit("see our solutions now").rlike(T.OFFER_PHRASE).alias("e"),
        F.lit("Just a moment…").rlike(T.INTERSTITIAL).alias("f"), F.lit("About our team").rlike(T.ABOUT_LABEL).alias("g"), F.lit("Trade Union of X").rlike(T.INSTITUTION).alias("h"),
        T.json_strings(F.array(F.lit("b"), F.lit("a"), F.lit("b"))).alias("i"), T.is_identifier(F.lit("aB3")).alias("j"), T.is_identifier(F.lit("a-b")).alias("k"), U.redacted(F.lit("x apify_api_A1-b\ty")).alias("l"),
    ).first()
    assert row.asDict() == {"a": "Acme GmbH", "b": None, "c": "acme", "d": True, "e": True, "f": True, "g": True, "h": True, "i": '["a","b"]', "j": True, "k": False, "l": "x [redacted] y"}


def test_query_list(spark, tmp_path):
    (tmp_path / "q.txt").write_bytes("﻿ one \r\n\ntwo one\x85three\n".encode())
    rows = query_list.read_queries(spark, str(tmp_path / "q.txt")).orderBy("pos").collect()
    assert [r["query"] for r in rows] == ["one", "two", "three"]


def current(term="q", page=1, urls=("https://a.example/",), more=False, **extra):
    return json.dumps({"organicResults": [dict(description="", title="t", url=u) for u in urls], "has_next": more, "end_status": "complete", "end_reason": ""} | {"provider": "apify-google", "searchQuery": dict(page=page, term=term)} | extra)


def test_payloads(spark):
    legacy = json.dumps(dict(serpapi_pagination=dict(next="https://s.example/?q=x&start=17"), organic_results=[dict(link="https://b.example/", title="t")], search_metadata=dict(status="Success")))
    rows = [("a", 0, current(more=True)), ("b", 0, legacy), ("c", 0, current(has_next="true")), ("d", 0, current(search_error=True)), ("e", 0, "{"), ("f", 0, json.dumps({"search_metadata": {"status": "Error"}})), ("g", 0, current(urls=(), search_error=True, more=True)), ("h", 0, current(urls=("",)))]
    got = {r["query"]: r for r in payloads.parsed(spark.createDataFrame(rows, SCHEMAS["pages"])).collect()}
    assert {k: r["problem"] for k, r in got.items()} == {"a": None, "b": None, "c": "has_next", "d": "search_error", "e": "not_json", "f": "search_status", "g": None, "h": "organic_result"}
    assert (got["a"]["next_start"], got["b"]["next_start"], got["b"]["results"][0]["url"], got["g"]["search_error"]) == (10, 17, "https://b.example/", True)


def test_record_problems(spark):
    rows = [(0, current()), (1, current()), (2, current(page=2)), (3, json.dumps(dict(organicResults=[], searchQuery=dict(page=True, term="q")))), (4, current(term="z")), (5, current(page=9)), (6, json.dumps(dict(organicResults=[dict(title="x")], searchQuery=dict(page=3, term="q"))))]
    got = payloads.record_problems(spark.createDataFrame(rows, "record int, payload string"), spark.createDataFrame([("q",)], "query string"), 5).collect()
    assert {r["record"]: r["problem"] for r in got} == {0: None, 1: "duplicate", 2: None, 3: "unexpected", 4: "unexpected", 5: "unexpected", 6: "organic_result"}


def test_mapped_failures(spark):
    urls = {"https://www.google.com/search?q=a&start=20": ("a", 3), "https://google.com.br/search?q=a": ("a", 1), "https://google.com/search?q=z": None, "https://google.com/search?q=a&start=15": None, "https://u@google.com/search?q=a": None, "https://google.com:8080/search?q=a": None, "https://google.evil.example/search?q=a": None, "https://google.com/search?q=a&q=a": None, "https://google.com/search?q=a&start=990": None, "https://google.com/maps?q=a": None}
    frame = spark.createDataFrame([(u,) for u in urls], "u string").select("u", payloads.mapped_failure(F.col("u"), F.array(F.lit("a")), 10).alias("m"))
    assert {r["u"]: r["m"] and tuple(r["m"]) for r in frame.collect()} == urls


def test_stop_pages(spark):
    pages = [("r", 1, True), ("r", 2, True), ("e", 1, True), ("c", 1, False), ("m", 1, True), ("m", 2, True), ("m", 3, True), ("o", 1, True)]
    frame = spark.createDataFrame([(*p, "complete", "", False) for p in pages], "query string, idx int, has_next boolean, end_status string, end_reason string, search_error boolean")
    results = spark.createDataFrame([("r", 1, "u"), ("r", 2, "u"), ("c", 1, "u"), ("m", 1, "a"), ("m", 2, "b"), ("m", 3, "c"), ("o", 1, "x")], "query string, idx int, url string")
    got = {r["query"]: (r["idx"], r["status"], r["reason"]) for r in frontier.stop_pages(frame, results, 3).collect()}
    assert got == {"r": (2, "incomplete", "repeated_results"), "e": (1, "incomplete", "empty_page_with_next"), "c": (1, "complete", ""), "m": (3, "limited", "max_pages"), "o": (1, None, None)}


def test_interleave(spark):
    frame = spark.createDataFrame([(i, h) for i, h in enumerate(["a1", "www.a1", "a1", "b1", "c1"])], "pos int, raw string").withColumn("host", F.regexp_replace("raw", "^www\\.", ""))
    assert [r["pos"] for r in frontier.interleaved(frame).orderBy("turn", "lead").collect()] == [0, 3, 4, 1, 2]


def test_gates_agree(spark):
    from entityflow import dims

    hosts = ["arxiv.org", "a.b.globo.com", "xarxiv.org", "play.google.com", "google.com", ""]
    frame = spark.createDataFrame([(h,) for h in hosts], "host string")
    joined = {r["host"]: r["kind"] for r in frontier.gated(frame, dims.domains(spark)).collect()}
    assert joined == {r["host"]: r["k"] for r in frame.select("host", frontier.gate_kind(F.col("host"), dims.DOMAINS).alias("k")).collect()}
    assert joined["arxiv.org"] == "research_source" and joined["a.b.globo.com"] == "editorial_source" and joined["xarxiv.org"] is None


@pytest.mark.parametrize(
    ("values", "reason"),
    [((0.5, 1.0, "SUCCEEDED", 0, 0, 2, 2), ""), ((1.0, 1.0, "SUCCEEDED", 0, 0, 2, 2), "apify_cost_limit"), ((None, 1.0, "SUCCEEDED", 0, 0, 2, 2), "apify_completion_unverified"), ((math.nan, 1.0, "SUCCEEDED", 0, 0, 2, 2), "apify_completion_unverified"), ((0.5, None, "SUCCEEDED", 0, 0, 2, 2), "apify_completion_unverified"), ((0.5, 1.0, "SUCCEEDED", 0, 2, 2, 2), "apify_completion_unverified"), ((0.5, 1.0, "SUCCEEDED", 0, 0, 1, 2), "apify_completion_unverified"), ((0.5, 1.0, "SUCCEEDED", 1, 0, 2, 2), "apify_completion_unverified"), ((0.5, 1.0, "FAILED", 0, 0, 2, 2), "apify_completion_unverified")],
)
def test_completion_reason(spark, values, reason):
    frame = spark.createDataFrame([values], "a double, b double, c string, d int, e int, f int, g int")
    assert frame.select(coverage.completion_reason(*map(F.col, "abcdefg"))).first()[0] == reason


def test_coverage_of_337_records(spark):
    pages = spark.createDataFrame([(f"q{q}", p) for q in range(20) for p in range(1, 18) if (q, p) != (7, 17)][:336], "query string, page int")
    failures = spark.createDataFrame([("q7", 17)], "query string, page int")
    found = coverage.page_coverage(pages, failures).select("query", coverage.coverage_status(F.size(F.coalesce("failed_pages", F.array().cast("array<int>"))), F.lit(""), F.col("last_page"), F.lit(99))["status"].alias("s"))
    assert sorted(r["n"] for r in audit.tallies(found, "s").collect()) == [1, 19]
    merged = coverage.merged_positions(pages, failures.unionByName(spark.createDataFrame([("q1", 1)], "query string, page int")))
    assert {r["outcome"]: r["n"] for r in audit.tallies(merged, "outcome").collect()} == {"success": 335 if pages.count() == 336 else pages.count() - 1, "both": 1, "marker": 1}


def test_budget(spark):
    queries = spark.createDataFrame([(f"q{i:02}", i) for i in range(26)], "query string, pos int")
    none = spark.createDataFrame([], "query string")
    assert planner.batch_plan(queries, none, 0, 100, 10, 20).count() == 10
    rest = planner.batch_plan(queries, queries.filter("pos < 10").select("query"), 100, 260, 10, 20).collect()
    assert len(rest) == 16 and {r["batch"] for r in rest} == {0}
    batches = spark.createDataFrame([(1, ["a"], 95, None, "abandoned"), (2, ["b"], 95, None, "planned")], SCHEMAS["batches"])
    assert planner.reserved_pages(batches) == 190 and planner.reserve(batches, 10, 200) == 200
    with pytest.raises(planner.BudgetExceeded):
        planner.reserve(batches, 11, 200)
    assert planner.open_batch(batches).first()["id"] == 2
    assert {r["id"]: (r["status"], r["run_id"]) for r in planner.moved(batches, 2, "running", "R").collect()}[2] == ("running", "R")
    with pytest.raises(Exception, match="batch_transition"):
        planner.moved(batches, 1, "done").collect()


def decisions(spark, *rows):
    return spark.createDataFrame([(q, d, s, n, u, r, "{}") for q, d, s, n, u, r in rows], SCHEMAS["resolutions"])


def test_selection(spark):
    same = decisions(spark, *[(q, f"https://x.example/{i}", "confirmed", "Acme", "https://acme.example/", "") for i, q in enumerate("aab")], ("c", "u", "pending", "", "", "site_http_403"), ("d", "u", "skipped", "", "", ""))
    chosen = selection.sites(same)
    assert chosen.select("site_name").distinct().count() == 1
    assert [s["query"] for s in selection.provenance(chosen).first()["sources"]] == list("aab")
    assert tuple(selection.counts(same, 1).first()) == (1, 3, 2, 1, 1)
    many = decisions(spark, ("a", "1", "confirmed", "Acme", "https://acme.example/", ""), ("a", "2", "confirmed", "Acme", "https://acme.example/br", ""), ("a", "3", "confirmed", "Brand", "https://acme.example/br", ""), ("a", "4", "confirmed", "Sub", "https://sub.acme.example/", ""), ("a", "5", "confirmed", "Acme Two", "https://www.acme.example", ""))
    got = {(r["name"], r["url"]): r["site_name"] for r in selection.sites(many).collect()}
    assert got[("Acme", "https://acme.example/br")] == "Acme" and got[("Brand", "https://acme.example/br")] == "Brand" and got[("Acme Two", "https://www.acme.example")] == "Acme"


@pytest.mark.parametrize("names", [("One Two", "One-Two"), ("Firm", "FIRM"), ("!!!", "x")])
def test_collisions_are_refused_before_anything_is_written(spark, tmp_path, names):
    rows = decisions(spark, *[("a", str(i), "confirmed", n, f"https://h{i}.example/", "") for i, n in enumerate(names)])
    with pytest.raises(OutputError):
        export(rows, spark.createDataFrame([("a", "complete", "")], SCHEMAS["progress"]), str(tmp_path / "out"))
    assert not list((tmp_path / "out").glob("*"))


def test_audit_and_diff(spark):
    rows = decisions(spark, *[("a", f"https://one.example/{i}", "pending", "", "", "site_http_403") for i in range(10)], ("a", "https://two.example/", "pending", "", "", "site_http_403"), ("b", "https://two.example/", "pending", "", "", "site_http_403"))
    picked = audit.sampled(audit.cases(rows), 2).collect()
    assert {r["host"] for r in picked} == {"one.example", "two.example"}
    assert next(r for r in picked if r["host"] == "two.example")["queries"] == ["a", "b"]
    again = audit.sampled(audit.cases(rows.orderBy(F.desc("discovered_url")).repartition(3)), 2).collect()
    assert sorted(picked) == sorted(again)
    after = audit.reclassified(rows.withColumn("reason", F.when(F.col("query") == "b", "editorial_or_listing_page").otherwise(F.col("reason"))))
    assert audit.changes(rows, after).count() == 1 and audit.changes(after, audit.reclassified(after)).count() == 0


def test_run_resume_export_audit_recheck(spark, tmp_path):
    state = State(spark, str(tmp_path / "state"))
    config = {"queries": ["q"], "country": "br", "language": "pt", "max_pages": 3, "provider": "x"}
    state.create(config)
    state.create(config | {"provider": "y"})
    with pytest.raises(StateError, match="config_mismatch"):
        state.create(config | {"country": "us"})
    payload = current(urls=("https://s.example/", "https://arxiv.org/abs/1", "https://gone.example/"))
    state.upsert(pages=spark.createDataFrame([("q", 0, payload)], SCHEMAS["pages"]))
    html = "<script type='application/ld+json'>" + json.dumps(dict(url="https://s.example/", name="S") | {"@type": "Organization"}) + "</script><a class=x href='/services'>Services</a>"
    corpus = spark.createDataFrame([("https://s.example/", "https://s.example/", 200, "text/html", html)], "url string, final_url string, status int, content_type string, html string")
    made = {r["discovered_url"]: r["status"] for r in runs.discover(state, corpus).collect()}
    assert made == {"https://s.example/": "confirmed", "https://arxiv.org/abs/1": "skipped", "https://gone.example/": "pending"}
    assert runs.discover(state, corpus).count() == 0
    assert runs.discover(state, corpus, retry_pending=True).count() == 1
    report = runs.export_state(state, str(tmp_path / "out"))
    assert report["exported_rows"] == 1 and report["search_complete"] and report["partial"]
    assert (tmp_path / "out/companies.csv").read_bytes() == b"\xef\xbb\xbfCompanyName;URL;SearchQuery\r\nS;https://s.example/;q\r\n"
    summary = runs.audit_state(state, str(tmp_path / "audit"), reclassify=True)
    assert summary["cases"] == 0 and (tmp_path / "audit/audit_bundle.zip").exists()
    with pytest.raises(OutputError, match="output_exists"):
        runs.audit_state(state, str(tmp_path / "audit"))
    changed = runs.recheck(state, corpus.limit(0), str(tmp_path / "recheck"))
    assert changed["changed"] == 1 and changed["after"] == {"pending": 2, "skipped": 1}
    with pytest.raises(StateError, match="state_readonly"):
        State(spark, str(tmp_path / "state"), readonly=True).upsert(progress=spark.createDataFrame([], SCHEMAS["progress"]))


def test_streaming_feed(spark, tmp_path):
    from entityflow.streaming.feed import follow

    state = State(spark, str(tmp_path / "state"))
    state.create({"queries": ["q"]})
    (tmp_path / "in").mkdir()
    corpus = spark.createDataFrame([], "url string, final_url string, status int, content_type string, html string")
    for i in range(2):
        (tmp_path / f"in/{i}.json").write_text(json.dumps({"query": f"q{i}", "start": 0, "payload": current(urls=(f"https://h{i}.example/",))}))
        follow(spark, str(tmp_path / "in"), state, corpus, str(tmp_path / "checkpoint")).awaitTermination()
    assert state.table("resolutions").count() == 2 and state.table("pages").count() == 2


def test_migration(spark, tmp_path):
    state = State(spark, str(tmp_path / "state"))
    with pytest.raises(StateError, match="state_missing"):
        state.meta()
    old = {k: spark.createDataFrame([], SCHEMAS[k]) for k in ("pages", "resolutions", "progress")}
    state.migrate(old, {"queries": []})
    assert state.meta()["schema_version"] == "2" and set(state.snapshot()) == set(SCHEMAS)


def test_a_crash_between_versions_leaves_the_old_one(spark, tmp_path, monkeypatch):
    state = State(spark, str(tmp_path / "state"))
    state.create({"queries": ["q"]})
    row = spark.createDataFrame([("q", "complete", "")], SCHEMAS["progress"])
    monkeypatch.setattr(State, "_point", lambda *a: (_ for _ in ()).throw(RuntimeError("crash")))
    with pytest.raises(RuntimeError):
        state.upsert(progress=row)
    monkeypatch.undo()
    (tmp_path / "state/pointer.left-over").write_text("{")
    assert state.table("progress").count() == 0
    state.upsert(progress=row)
    state.upsert(progress=row)
    assert state.table("progress").count() == 1 and len(list((tmp_path / "state").glob("current-*.json"))) == 2
    with pytest.raises(StateError, match="state_changed_meanwhile"):
        state._point({}, state.meta()["number"])
    assert [state.reserve_request(2) for _ in range(2)] == [1, 2]
    with pytest.raises(StateError, match="search_request_limit"):
        state.reserve_request(2)


def failure(term, page, **change):
    debug = {"method": "GET", "url": f"http://www.google.com/search?q={term}&start={(page - 1) * 10}", "retryCount": 3, "requestId": "j6Yf", "errorMessages": ["apify_api_private"]}
    return {"#error": True, "#debug": debug} | change


def success(term, page):
    return {"searchQuery": {"term": term, "page": page}, "organicResults": [{"url": f"https://{term}{page}.example/"}]}


def started(spark, folder, queries):
    state = State(spark, str(folder))
    state.create({"queries": queries})
    state.upsert(batches=spark.createDataFrame([(1, queries, 10, "run", "running")], SCHEMAS["batches"]))
    return state


def test_batch_import(spark, tmp_path):
    from entityflow.plans.batch_import import import_batch

    state = started(spark, tmp_path / "s", ["q", "r", "t"])
    items = [success("q", 1), failure("q", 2), success("q", 3), failure("r", 1), success("t", 1), failure("t", 1), success("t", 2)]
    frame = spark.createDataFrame([(i, json.dumps(x)) for i, x in enumerate(items)], "record int, payload string")
    evidence = dict(cost_usd=1.0, cost_limit_usd=4.0, status="SUCCEEDED", exit_code=0, pending_requests=0, handled_requests=7, run_id="run")
    got = import_batch(state, 1, frame, evidence, 5)
    assert got["dataset_records"] == 7 and got["completion_reason"] == "" and got["search_errors"][0] == {"query": "q", "page": 2, "reason": "apify_search_page_failed", "retry_count": 3, "request_id": "j6Yf"}
    covered = {r["query"]: (r["pages"], r["last_page"], r["failed_pages"], r["status"], r["reason"]) for r in state.table("coverage").collect()}
    bad = ("incomplete", "apify_search_page_failed")
    assert covered == {"q": (2, 3, [2], *bad), "r": (0, 1, [1], *bad), "t": (2, 2, [1], *bad)}
    parsed = {(r["query"], r["start"]): r for r in payloads.parsed(state.table("pages")).collect()}
    assert len(parsed) == 6 and all(r["problem"] is None for r in parsed.values())
    assert parsed["q", 10]["search_error"] and parsed["q", 10]["next_start"] == 20 and parsed["q", 20]["next_start"] is None and parsed["t", 0]["results"][0]["url"] == "https://t1.example/" and not parsed["t", 0]["search_error"]
    assert "apify_api_private" not in str([r["payload"] for r in state.table("pages").collect()])
    assert [r["status"] for r in state.table("batches").collect()] == ["done"]


@pytest.mark.parametrize(
    ("items", "problem"),
    [
        ([success("q", 1), failure("q", 2, **{"#debug": None})], "apify_unmapped_search_error"),
        ([success("q", 1), failure("q", 2, searchQuery={"term": "q", "page": 3})], "apify_unmapped_search_error"),
        ([success("q", 1), failure("q", 2, organicResults=[{"url": "https://x.example/"}])], "apify_unmapped_search_error"),
        ([success("q", 1), failure("other", 2)], "apify_unmapped_search_error"),
        ([success("q", 1), failure("q", 3)], "apify_missing_intermediate_page"),
        ([success("q", 2)], "apify_omitted_queries"),
        ([success("q", 1), success("q", 1)], "apify_duplicate_query_page"),
        ([success("q", 9)], "apify_unexpected_query_or_page"),
        ([{"organicResults": []}], "apify_missing_search_query"),
        ([{"searchQuery": {"term": "q", "page": 1}}], "apify_missing_organic_results"),
        ([], "apify_empty_dataset"),
    ],
)
def test_batch_import_is_refused_whole(spark, tmp_path, items, problem):
    from entityflow.plans.batch_import import import_batch

    state = started(spark, tmp_path / "s", ["q"])
    frame = spark.createDataFrame([(i, json.dumps(x)) for i, x in enumerate(items)], "record int, payload string")
    with pytest.raises(StateError, match=problem):
        import_batch(state, 1, frame, {}, 5)
    assert state.table("pages").count() == 0 and state.table("coverage").count() == 0 and planner.open_batch(state.table("batches")).count() == 1


def test_names_beyond_ascii(spark):
    names = ["São Tomé", "Ærø ﬁn ™", "Ｗｉｄｅ①", "Łódź", "Straße GmbH", "株式会社", "Ελλάς Inc."]
    frame = spark.createDataFrame([(x,) for x in names], "n string").select("n", T.slug(F.col("n")).alias("s"), T.name_key(F.col("n")).alias("k"))
    got = {r["n"]: r for r in frame.collect()}
    for x in names:
        ascii_name = unicodedata.normalize("NFKD", x).encode("ascii", "ignore").decode()
        assert got[x]["s"] == re.sub(r"[^A-Za-z0-9._-]+", "-", ascii_name).strip(".-_").lower(), x
        assert got[x]["k"].replace("ς", "σ") == P.name_key(x), x


def test_worker_error(tmp_path):
    from entityflow.sinks import worker_error

    try:
        raise KeyError("apify_api_secret")
    except KeyError as error:
        worker_error(error, str(tmp_path), "q apify_api_x1", "https://u:p@h.example/a?b=c#d", "resolve")
    got = json.loads((tmp_path / "worker_error.json").read_text())
    assert got["query"] == "q [redacted]" and got["source_location"] == "https://h.example/a" and got["exception_type"] == "KeyError" and got["frames"][-1]["function"] == "test_worker_error" and "secret" not in str(got)
