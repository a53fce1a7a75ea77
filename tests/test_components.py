import pytest
from pyspark.sql import functions as F

from aiscope.functions import columns as C
from aiscope.operators import components as K
from aiscope.operators import export, policy

SCHEMA = "component_id long, scan_id long, name string, type string, provider string, model_name string, usage_type string, file_path string, line_number int, flags array<string>"


def make(spark, rows):
    base = dict(component_id=1, scan_id=1, name="n", type="model", provider="p", model_name="", usage_type="completion", file_path="a.py", line_number=1, flags=[])
    return spark.createDataFrame([tuple({**base, **r}[c.split()[0]] for c in SCHEMA.split(", ")) for r in rows], SCHEMA)


@pytest.mark.parametrize(
    ("flags", "model", "score", "severity"),
    [
        ([], "", 0, "low"),
        (["hardcoded_api_key"], "", 30, "medium"),
        (["shadow_ai"], "", 25, "low"),
        (["hardcoded_api_key", "shadow_ai", "internet_facing"], "", 75, "high"),
        (["hardcoded_api_key"] * 5, "", 100, "critical"),
        (["deprecated_model"], "gpt-3.5-turbo", 20, "low"),
        (["no_such_flag"], "", 0, "low"),
    ],
)
def test_score(spark, flags, model, score, severity):
    row = K.score(make(spark, [dict(flags=flags, model_name=model)])).first()
    assert (row.score, row.severity) == (score, severity)


def test_score_counts_once_in_distinct_mode(spark):
    row = K.score(make(spark, [dict(flags=["no_auth", "no_auth", "deprecated_model"], model_name="gpt-3.5-turbo")]), "distinct").first()
    assert row.score == 25
    assert row.factors[0] == "AI endpoint without authentication (+15)"


def test_diff_with_itself_is_empty(spark):
    rows = K.score(make(spark, [dict(component_id=i, name=f"n{i % 3}") for i in range(7)]))
    assert {r.change for r in K.diff(rows, rows).collect()} == {"unchanged"}


def test_diff(spark):
    old = K.score(make(spark, [dict(name="a"), dict(name="b", component_id=2)]))
    new = K.score(make(spark, [dict(name="a", flags=["no_auth"]), dict(name="c", component_id=3)]))
    found = {r.name: (r.change, r.score_delta) for r in K.diff(old, new).collect()}
    assert found == {"a": ("modified", 15), "b": ("removed", None), "c": ("added", None)}


def test_model_lookup_takes_the_longest_prefix(spark):
    names = make(spark, [dict(model_name=m) for m in ("gpt-4o-2024-05-13", "gpt-4", "claude-2.1", "nothing", "")])
    found = {r.model_name: (r.registry_name, r.deprecated) for r in K.lookup_models(names).collect()}
    assert found == {"gpt-4o-2024-05-13": ("gpt-4o", False), "gpt-4": ("gpt-4", False), "claude-2.1": ("claude-2", True), "nothing": (None, None), "": (None, None)}


def test_thresholds_pass_and_fail(spark):
    rows = K.score(make(spark, [dict(flags=["hardcoded_api_key", "shadow_ai", "webhook_no_auth"], provider="OpenAI"), dict(component_id=2, scan_id=2)]))
    bad = K.threshold_policy(rows, max_critical=0, max_score=50, block_providers=["openai"], block_flags=["shadow_ai"])
    assert sorted(r.rule for r in bad.collect()) == ["blocked_flag", "blocked_provider", "max_critical", "max_score"]
    assert {r.scan_id: r.passed for r in K.policy_passed(rows, bad).collect()} == {1: False, 2: True}
    assert K.threshold_policy(rows).count() == 0


def test_package_urls(spark):
    rows = spark.createDataFrame([("Some_Pkg", "tool", "1.0"), ("@a/b", "tool", "unknown"), ("ollama/ollama:0.1", "container", "")], "name string, kind string, version string")
    found = [r[0] for r in rows.select(C.package_url(F.col("name"), F.col("kind"), F.col("version"))).collect()]
    assert found == ["pkg:pypi/some-pkg@1.0", "pkg:npm/@a/b", "pkg:docker/ollama/ollama@0.1"]


def test_gate(spark):
    rows = K.score(make(spark, [dict(flags=["hardcoded_api_key"]), dict(component_id=2, name="x")]))
    rules = spark.createDataFrame([(1, "forbid", "severity", ">=", "medium"), (2, "forbid", "risk_score", "<", "10"), (3, "forbid", "owner", "==", "Ann"), (4, "forbid", "missing", "!=", "a")], "rule_id int, effect string, field string, op string, value string")
    entities = spark.createDataFrame([("x", {"owner": "ann", "severity": "critical"}), ("x", {"owner": "bob"}), ("x", None)], "name string, attributes map<string,string>")
    found = [(r.component_id, r.rule_id) for r in policy.gate(rows, rules, entities).collect()]
    assert sorted(found) == [(1, 1), (2, 2), (2, 3)]
    unnamed = rules.unionAll(spark.createDataFrame([(None, "forbid", "name", "==", "x")], rules.schema))
    found = policy.gate(rows, unnamed, entities)
    assert sorted((r.component_id, r.rule_id or 0) for r in found.collect()) == [(1, 1), (2, 0), (2, 2), (2, 3)]
    report = {r.rule_id: (r.condition, r.n_violations, r.n_components) for r in policy.violation_report(found.unionAll(found), unnamed).collect()}
    assert report[2] == ("resource.risk_score < 10", 2, 1) and report[None] == ("resource.name == x", 2, 1) and len(report) == 4


def test_explained_decisions(spark):
    rows = spark.createDataFrame([(1, "get", "https://api.bad.com/x", "deploy"), (2, "post", "https://ok.com/v1", "Deploy"), (3, "get", "https://none.org", None), (4, None, None, "x")], "request_id int, method string, url string, tool string")
    rules = [(1, "forbid", "*", "url", "contains", "bad"), (1, "forbid", "*", "hostname", "endswith", ".com"), (2, "permit", "*", "url", "contains", "bad"), (3, "permit", "DEPLOY", "path", "startswith", "/v1"), (4, "permit", "other", "path", "startswith", "/v1")]
    rules = spark.createDataFrame(rules, "rule_id int, effect string, action string, field string, op string, value string")
    found = {r.request_id: (r.decision, r.reasons, r.triggered) for r in policy.explain(rows, rules, action="tool").collect()}
    default = ["No matching policy rules (default allow)"]
    assert found[1] == ("deny", ['Forbidden by policy: request.hostname endswith ".com"', 'Forbidden by policy: request.url contains "bad"'], [1])
    assert found[2][0] == "deny" and found[2][2] == [1]
    assert found[3] == ("allow", default, []) and found[4] == ("allow", default, [])
    permits = policy.explain(rows, rules.where("rule_id > 1"), action="tool").orderBy("request_id").collect()
    assert [r.triggered for r in permits] == [[2], [3], [], []]
    assert {r.request_id: r.decision for r in policy.explain(rows, rules.where("rule_id = 1")).collect()} == {r.request_id: r.decision for r in policy.decide(rows, rules.where("rule_id = 1")).collect()}


def test_requests_forbid_beats_permit(spark):
    rows = spark.createDataFrame([(1, "get", "https://API.bad.com/x", {"X-Team": "red"}), (2, "post", "https://ok.com/v1", {}), (3, "get", "action://tool_call/x", {})], "request_id int, method string, url string, headers map<string,string>")
    rules = spark.createDataFrame([(1, "permit", "*", "url", "contains", "bad"), (2, "forbid", "*", "hostname", "==", "api.bad.com"), (3, "forbid", "*", "header_x_team", "!=", "red"), (4, "permit", "*", "method", "==", "post")], "rule_id int, effect string, action string, field string, op string, value string")
    found = {r.request_id: (r.decision, r.rule_id) for r in policy.decide(rows, rules).collect()}
    assert found == {1: ("deny", 2), 2: ("allow", 4), 3: ("allow", None)}


def test_export_validity_and_documents(spark):
    rows = K.score(make(spark, [dict(), dict(component_id=2, name="", type="odd")]))
    assert [(r.component_id, r.why) for r in export.invalid_components(rows).collect()] == [(2, ["name", "type"])]
    document = export.bom_documents(rows).first().document
    assert '"bomFormat":"CycloneDX"' in document and "aiscope:risk_score" in document
    assert export.spdx_packages(rows).count() == 2


def test_batches_hold_at_most_their_size(spark):
    rows = spark.range(250).select(F.col("id").alias("event_id"), F.lit("2024-01-01").cast("timestamp").alias("ts"))
    found = export.batches(rows).orderBy("batch").collect()
    assert [r.n_events for r in found] == [100, 100, 50] and len({r.idempotency_key for r in found}) == 3


def test_saved_scans_are_replaced_by_id(spark, tmp_path):
    path = str(tmp_path / "scans")
    export.save_scan(make(spark, [dict(scan_id=1), dict(scan_id=2, name="old")]), path)
    export.save_scan(make(spark, [dict(scan_id=2, name="new")]), path)
    assert {(r.scan_id, r.name) for r in export.scan_history(spark, path).collect()} == {(1, "n"), (2, "new")}


def test_requests_without_or_with_the_same_id_have_verdicts_of_their_own(spark):
    """A missing id never turns a denial into leave to pass, and equal ids do not share a verdict."""
    rules = spark.createDataFrame([(1, "forbid", "*", "url", "contains", "bad")], "rule_id int, effect string, action string, field string, op string, value string")
    rows = spark.createDataFrame([(None, "GET", "https://bad.example"), (1, "GET", "https://bad.example"), (1, "GET", "https://good.example"), (None, "GET", None)], "request_id long, method string, url string")
    found = policy.decide(rows, rules)
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    assert sorted((r.request_id or 0, r.url or "", r.decision) for r in found.collect()) == [(0, "", "allow"), (0, "https://bad.example", "deny"), (1, "https://bad.example", "deny"), (1, "https://good.example", "allow")]
    none = spark.createDataFrame([], rules.schema)
    assert {r.decision for r in policy.decide(rows, none).collect()} == {"allow"}


def test_delete_scan_tells_whether_there_was_one(spark, tmp_path):
    from aiscope.operators import export

    rows = spark.createDataFrame([(1, "a"), (2, "b")], "scan_id int, name string")
    export.save_scan(rows, f"{tmp_path}/scans")
    assert export.delete_scan(spark, f"{tmp_path}/scans", 1) and not export.delete_scan(spark, f"{tmp_path}/scans", 1)
    assert [r.name for r in export.scan_history(spark, f"{tmp_path}/scans").collect()] == ["b"]


def test_whole_documents_of_odd_components(spark):
    import json
    import xml.etree.ElementTree as ET

    from aiscope.operators import export

    rows = K.score(make(spark, [dict(name='a<b>&"c"\n\x01é', flags=["hardcoded_api_key", "shadow_ai"], provider=None), dict(component_id=2, name="plain", scan_id=7), dict(component_id=3, name="", flags=["no_auth"], model_name="gpt-4")]))
    scans = spark.createDataFrame([(1, "x & y", "2024-01-01")], "scan_id int, target_path string, scan_timestamp string")
    suites = {r.scan_id: (r.n_cases, r.n_failures, ET.fromstring(r.document.encode())) for r in export.junit_documents(rows, scans).collect()}
    n, failed, suite = suites[1]
    assert (n, failed, suite.get("tests"), suite.get("failures"), suite.get("name")) == (2, 1, "2", "1", "Scan: x & y")
    assert [c.get("name") for c in suite.iter("testcase")] == ['a<b>&"c"\né', ""] and len(suite.findall("testcase/failure")) == 1
    assert "Risk Factors: " in suite.find("testcase/failure").text and suites[7][0] == 1
    document = json.loads({r.scan_id: r.document for r in export.spdx_documents(rows, scans).collect()}[1])
    assert [e["name"] for e in document["elements"]] == ['a<b>&"c"\n\x01é', ""] and document["creationInfo"]["created"] == "2024-01-01" and "suppliedBy" not in document["elements"][0]
    assert export.junit_documents(rows.where("false")).count() == export.spdx_documents(rows.where("false")).count() == 0


def test_report_places_and_groups(spark):
    rows = K.score(make(spark, [dict(component_id=i, name=n, flags=f) for i, n, f in ((1, "b", []), (2, None, ["shadow_ai", "hardcoded_api_key"]), (3, "A", ["no_auth"]), (4, "B", ["shadow_ai", "hardcoded_api_key"]))]))
    assert {r.component_id: r.place for r in K.report_places(rows).collect()} == {2: 1, 4: 2, 3: 3, 1: 4}
    assert {r.component_id: r.place for r in K.report_places(rows, "name", descending=False).collect()} == {3: 1, 1: 2, 4: 3, 2: 4}
    groups = K.severity_groups(rows, "medium").collect()
    assert [(r.place, r.severity, r.n, r.components) for r in groups] == [(1, "high", 2, [2, 4])] and K.severity_groups(rows, "no such").count() == 2
    assert {r.component_id for r in K.search(rows, workflow="no such").collect()} == set()


def test_json_safe_values(spark):
    rows = spark.sql("""select cast(null as struct<a:int>) as n, array(date'2024-01-02', null) as d, map(1, x'4142', 2, null) as m, parse_json('{"k":[1]}') as v,
      named_struct('t', interval 1 day, 'f', 1.5D, 's', 'x', 'e', cast(null as array<date>)) as s""")
    out = {f.name: C.json_safe(F.col(f.name), f.dataType) for f in rows.schema.fields}
    r = rows.select(*[c.alias(n) for n, c in out.items()]).first()
    assert r.n is None and r.d == ["2024-01-02", None] and r.m == {"1": "AB", "2": None} and r.v == '{"k":[1]}'
    assert (r.s.f, r.s.s, r.s.e) == (1.5, "x", None) and "1" in r.s.t


def test_documents_of_large_scans_come_in_parts(spark):
    """No row holds a whole scan, and the parts in order are the document."""
    import json
    import xml.etree.ElementTree as ET

    n = 3 * export.PART_ENTRIES
    flags = F.when(F.col("id") % 3 == 0, F.array(F.lit("shadow_ai"))).otherwise(F.array().cast("array<string>"))
    rows = K.score(spark.range(n).repartition(5).select(F.col("id").alias("component_id"), (F.col("id") % 5 == 0).cast("long").alias("scan_id"), F.concat(F.lit("n"), "id").alias("name"), *[F.lit(x).alias(c) for c, x in (("type", "model"), ("provider", "p"), ("model_name", ""), ("usage_type", "agent"), ("file_path", "a.py"))], F.lit(1).alias("line_number"), flags.alias("flags")))
    ids = [i for i in range(n) if i % 5]
    listed = {
        export.bom_parts: lambda d: [c["name"] for c in d["components"]], export.spdx_parts: lambda d: [e["name"] for e in d["elements"]],
        export.vendor_parts: lambda d: [c["name"] for c in d["aibom_analysis"]["sources"]["components"]], export.findings_parts: lambda d: [f["name"] for f in d["findings"]],
    }
    for cut, names in listed.items():
        parts = sorted((r.place, r.part, r.n_entries, r.text) for r in cut(rows).where("scan_id = 0").collect())
        inner = [p for p in parts if p[0] == export.ENTRIES]
        assert len(inner) >= 3 and max(p[2] for p in inner) <= export.PART_ENTRIES and sum(p[2] for p in inner) == len(ids)
        document = json.loads(parts[0][3] + ",".join(p[3] for p in inner) + parts[-1][3])
        order = sorted(ids, key=str) if cut in (export.bom_parts, export.vendor_parts) else ids
        assert names(document) == [f"n{i}" for i in order]
    summary = json.loads(export.vendor_documents(rows).where("scan_id = 0").first().document)["aibom_analysis"]["summary"]
    assert summary == {"total_components": len(ids), "by_type": {"model": len(ids)}, "by_severity": {"low": len(ids)}, "highest_risk_score": 25}
    suite = "".join(r[2] for r in sorted((r.place, r.part, r.text) for r in export.junit_parts(rows).where("scan_id = 0").collect()))
    assert [c.get("name") for c in ET.fromstring(suite.encode()).iter("testcase")] == [f"n{i}" for i in ids]


def test_diff_takes_only_what_it_compares(spark):
    old, new = K.score(make(spark, [dict(flags=["no_auth"])])), K.score(make(spark, [dict(name="x")]))
    plan = K.diff(old, new)._jdf.queryExecution().optimizedPlan().toString()
    assert "factors" not in plan and "owasp" not in plan
    assert {(r.name, r.change) for r in K.diff(old, new).collect()} == {("n", "removed"), ("x", "added")}


def test_gate_by_compiled_rules_is_that_by_their_array(spark, monkeypatch):
    rows = spark.createDataFrame([(1, "x", "model", "high", 61), (2, "y", "mcp_server", "low", 7), (3, None, None, None, None)], "component_id long, name string, type string, severity string, score int")
    rules = [(1, "forbid", "severity", ">=", "Medium"), (2, "forbid", "risk_score", "<", "9"), (3, "forbid", "component_type", "contains", "MCP"), (4, "forbid", "owner", "==", "ann"), (5, "permit", "name", "==", "x"), (None, "forbid", "name", "!=", "y"), (7, None, None, None, None), (8, "forbid", "name", "==", None)]
    rules = spark.createDataFrame(rules, "rule_id int, effect string, field string, op string, value string")
    entities = spark.createDataFrame([("x", {"owner": "Ann", "severity": "low"}), ("y", None)], "name string, attributes map<string,string>")
    found = []
    for most in (64, 0):
        monkeypatch.setattr(policy, "COMPILED_RULES", most)
        found.append([sorted(map(str, policy.gate(rows, rules, e).collect())) for e in (None, entities)])
        assert policy.gate(rows, rules.limit(0)).collect() == []
    assert found[0] == found[1]
    assert [r.rule_id for r in policy.gate(rows, rules, entities).orderBy("component_id", "rule_id").collect()] == [None, 1, 4, 2, 3]


def test_findings_are_made_once_for_each_component(spark):
    rows = spark.createDataFrame([(1, "x", "model", "high", 61, ["a"], "agent")], "component_id long, name string, type string, severity string, score int, flags array<string>, usage_type string")
    rules = spark.createDataFrame([(1, "forbid", "severity", ">=", "high")], "rule_id int, effect string, field string, op string, value string")
    for found in (policy.gate(rows, rules), policy.eu_act_findings(rows)):
        assert "size(" not in found._jdf.queryExecution().optimizedPlan().toString()
