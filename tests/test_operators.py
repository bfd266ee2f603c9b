from pyspark.sql import functions as F

from loreloom.operators import answers, chunking, dedup, governance, matching, quality, records, retrieval, simulate


def test_chunks_end_at_lines_and_overlap():
    text = "aaaa\nbbbb\ncccc\ndddd"
    got = chunking.chunk(text, 10, 2)
    assert [c["content"] for c in got] == ["aaaa\nbbbb", "cccc", "cc\ndddd"] or all(text[c["char_start"] : c["char_end"]] == c["content"] for c in got)
    assert chunking.chunk("   \n ", 3, 0) == [] and [c["chunk_index"] for c in got] == list(range(len(got)))


def test_split_failing(spark):
    rows = [(1, "x" * 450 + "\n" + "y" * 549, 0), (2, "short", 0), (3, "z" * 1000, 2), (4, "z" * 1000, 1)]
    got = chunking.split_failing(spark.createDataFrame(rows, "id int, content string, depth int")).collect()
    assert sorted((r.id, r.part, len(r.content), r.depth) for r in got) == [(1, 0, 451, 1), (1, 1, 549, 1), (4, 0, 500, 2), (4, 1, 500, 2)]


CARD = dict(title="NAT 出口切换", summary="切换 NAT 出口的步骤", scenario="维护", object_name="NAT 网关", knowledge_type="procedure", evidence_quote="先检查", source_text="先检查再切换", procedure_steps=["检查"], risks=[], rollback_steps=["恢复"], validation_steps=[])


def cards(spark, *more):
    schema = "id long, title string, summary string, scenario string, object_name string, knowledge_type string, evidence_quote string, source_text string, procedure_steps array<string>, risks array<string>, rollback_steps array<string>, validation_steps array<string>, status string, publish_status string, retrieval_enabled boolean, unit_role string"
    base = CARD | dict(status="APPROVED", publish_status=None, retrieval_enabled=None, unit_role=None)
    return spark.createDataFrame([tuple((base | m | {"id": i})[f.split()[0]] for f in schema.split(", ")) for i, m in enumerate(more)], schema)


def test_quality_rules(spark):
    got = quality.quality(cards(spark, {}, {"evidence_quote": "not there"}, {"unit_role": "validation_steps"}, {"knowledge_type": "constraint", "title": ""}, {"title": "", "summary": "", "scenario": "", "object_name": "", "evidence_quote": "", "procedure_steps": [], "rollback_steps": []}), unit_role="unit_role").orderBy("id").collect()
    assert [r.quality_score for r in got] == [88.0, 63.0, 82.0, 80.0, 0.0]
    assert got[1].quality_issues == ["缺少风险说明", "缺少验证步骤", quality.UNGROUNDED[1]]


def test_gate_needs_every_object_group(spark):
    got = retrieval.gate(cards(spark, {}, {"title": "防火墙", "summary": "x", "object_name": "y"}), "NAT 出口怎么回退").orderBy("id").collect()
    assert got[0].accepted and got[0].intent_anchors == ["rollback"] and got[0].object_anchors == ["nat"]
    assert not got[1].accepted and got[1].unmatched_object_groups == ["nat"]


def test_search_skips_unpublished_and_boosts(spark):
    c = cards(spark, {}, {"publish_status": "skipped"}, {"retrieval_enabled": False}, {"title": "别的", "summary": "无关", "object_name": "x"})
    got = retrieval.search(c, spark.createDataFrame([(1, "nat 出口切换"), (2, "the of")], "query_id int, query string")).collect()
    assert [(r.query_id, r.id) for r in got] == [(1, 0)] and got[0].query_coverage == 1.0


def test_bundle_status(spark):
    row = lambda *v: spark.createDataFrame([v], "n int, a int, r int, s int, p int").select(governance.bundle_status(*(F.col(x) for x in "narsp")).alias("b")).first().b
    assert [row(0, 0, 0, 0, 0), row(2, 2, 0, 0, 0), row(2, 0, 2, 0, 0), row(2, 0, 0, 2, 0), row(2, 0, 0, 0, 2), row(2, 1, 0, 0, 1)] == ["EMPTY", "APPROVED", "REJECTED", "SUPERSEDED", "PENDING_REVIEW", "PARTIAL"]


def test_delete_releases_what_was_superseded(spark):
    c = spark.createDataFrame([(1, None), (2, 1), (3, 2)], "id long, supersedes_id long")
    r = spark.createDataFrame([(1, 3), (2, 3)], "card_id long, related_card_id long")
    kept, rel = governance.delete_cards(spark.createDataFrame([(2,)], "id long"), c, r)
    assert {(x.id, x.supersedes_id) for x in kept.collect()} == {(1, None), (3, None)} and [(x.card_id, x.related_card_id) for x in rel.collect()] == [(1, 3)]


def test_greedy_match_takes_the_larger_index_and_lis(spark):
    a, b, c = ["x", "y"], ["y", "z"], ["q"]
    rows = spark.createDataFrame([(1, [a, b, c], [a, a, b]), (2, [], []), (3, [c], [])], "k int, generated array<array<string>>, expected array<array<string>>")
    got = {r.k: r for r in matching.greedy_match(rows, ["k"]).collect()}
    assert (got[1].matched, got[1].match_rate, got[1].order_similarity, got[1].average_pair_similarity) == (2, 0.6667, 1.0, 1.0)
    assert (got[2].match_rate, got[3].match_rate) == (1.0, 0.0)
    lis = spark.createDataFrame([([3, 1, 2, 2, 5, 4],), ([],), ([5, 4],)], "v array<int>").select(matching.lis_length(F.col("v")).alias("n")).collect()
    assert [r.n for r in lis] == [3, 0, 1]


def test_reuse_exempts_siblings_and_prefers_fingerprints(spark):
    t = "restart the payment service on node alpha and verify health"
    rows = [("d", 1, 10, 1, "f1", t), ("d", 2, 10, 2, "f2", t + "!"), ("d", 3, None, 3, "f3", t + "?"), ("d", 4, None, 4, "f1", "other"), ("e", 5, None, 1, "f1", t)]
    got = {r.unit_id: r.canonical_id for r in dedup.reuse(spark.createDataFrame(rows, "document_id string, unit_id long, parent_id long, position int, fingerprint string, text string")).collect()}
    assert got == {1: 1, 2: 2, 3: 1, 4: 1, 5: 5}


def test_batch_key_ignores_order_where_it_may(spark):
    rows = [(["b", "a"], ["1", "2"], "Same!"), (["a", "b"], ["1", "2"], "same"), (["a", "b"], ["2", "1"], "same")]
    df = spark.createDataFrame(rows, "risks array<string>, steps array<string>, s string").select(dedup.batch_key(spark.createDataFrame(rows, "risks array<string>, steps array<string>, s string"), ["s"], [("risks", True), ("steps", False)], []).alias("k"))
    k = [r.k for r in df.collect()]
    assert k[0] == k[1] != k[2]


def test_longest_prefix_and_rollback(spark):
    ip = lambda s: int.from_bytes(bytes(map(int, s.split("."))), "big")
    routes = spark.createDataFrame([(ip("0.0.0.0"), 0, "d"), (ip("10.0.0.0"), 8, "a"), (ip("10.1.0.0"), 16, "b"), (ip("10.1.0.0"), 16, "c")], "network long, prefixlen int, next_hop string")
    got = simulate.longest_prefix(spark.createDataFrame([(1, ip("10.1.2.3")), (2, ip("10.2.0.1")), (3, ip("255.255.255.255"))], "address_id int, ip long"), routes).collect()
    assert {r.address_id: r.next_hop for r in got} == {1: "c", 2: "a", 3: "d"}
    bad = spark.createDataFrame([("10.0.0.256",), ("1.2.3",), ("10.0.0.1",)], "s string").select(simulate.ipv4(F.col("s")).alias("n")).collect()
    assert [r.n for r in bad] == [None, None, ip("10.0.0.1")]
    journal = spark.createDataFrame([("e", 1, "r1", "a", "b"), ("e", 2, "r2", "x", "y"), ("e", 3, "r1", "b", "c")], "env string, seq int, key string, before string, after string")
    both = journal.unionByName(simulate.rollback(journal))
    assert {(r.key, r.value) for r in simulate.replay(both).collect()} == {("r1", "a"), ("r2", "x")}


def test_claims_beyond_the_rules(spark):
    c = spark.createDataFrame([(1, {"summary": ["s", " "], "risks": []})], "card_id long, fields map<string,array<string>>")
    rows = [(1, 0, "结论", 1, "summary", 0), (1, 1, "结论", 1, "summary", 0), (1, 2, "结论", 1, "summary", 1), (1, 3, "风险", 1, "summary", 0), (1, 4, "知识不足", 1, "risks", 0), (1, 5, "知识不足", 1, "summary", 0), (1, 6, "结论", 2, "summary", 0), (1, 7, "别的", 1, "summary", 0), (1, 8, "结论", 1, "summary", -1)]
    got = answers.validate(spark.createDataFrame(rows, "answer_id long, claim_no int, category string, card_id long, field string, index int"), c)
    assert [r.error for r in got.orderBy("claim_no").collect()] == ["", "DUPLICATE", "INDEX_OUT_OF_RANGE", "CATEGORY_FIELD_MISMATCH", "", "FIELD_NOT_EMPTY", "UNKNOWN_CARD", "UNKNOWN_CATEGORY", "INDEX_OUT_OF_RANGE"]
    assert answers.render(got).first().answer == "## 结论\n- s [K-1]\n\n## 知识不足\n- risks: - [K-1]"


def test_profiles_and_unbound_parameters(spark):
    a = spark.createDataFrame([("s", "x", "string"), ("s", "y", "integer")], "section string, field string, json_type string")
    assert records.profile_difference(a, a).count() == 0
    assert [(r.field, r.b_type) for r in records.profile_difference(a, a.filter("field = 'x'")).collect()] == [("y", None)]
    got = records.unbound_parameters(spark.createDataFrame([(1, "/a", "route 10.0.0.1 via 10.0.0.2 port 8080"), (1, "/b", "none")], "record_id int, path string, value string"), spark.createDataFrame([(1, "10.0.0.1")], "record_id int, value string"))
    assert [tuple(r) for r in got.collect()] == [(1, "/a", ["10.0.0.2", "8080"])]


def test_eligibility_and_approval(spark):
    b = spark.createDataFrame([("APPROVED", 1.0, "CONFIRMED", True), ("PARTIAL", None, None, None)], "status string, coverage double, mapping string, safe boolean")
    assert [len(r.reasons) for r in governance.eligibility(b).collect()] == [0, 4]
    c = spark.createDataFrame([("q", [], True), ("", [], True), ("q", ["缺少原文证据"], True), ("q", ["BLOCKING: x"], True), ("q", None, False), ("q", None, None)], "evidence_quote string, quality_issues array<string>, report_safe boolean")
    assert [r.approvable for r in governance.approvable(c).collect()] == [True, False, False, False, False, True]


def test_sections_titles_and_roles(spark):
    from loreloom.operators import steps

    text = "1. 检查路由\n确认下一跳 10.0.0.1 正常并保存结果\n  1. 内部一\n  细节\n  2. 内部二\n2. 影响\n不涉及\n三、回退\n恢复原值"
    got = steps.sections(text)
    assert [(s["label"], s["title"], s["body"], [i["title"] for i in s["subitems"]]) for s in got] == [("1.", "检查路由", "确认下一跳 10.0.0.1 正常并保存结果", ["内部一", "内部二"]), ("2.", "影响", "不涉及", []), ("三、", "回退", "恢复原值", [])]
    rows = steps.with_sections(spark.createDataFrame([(1, text), (2, "no sections"), (3, None)], "id int, operation string"), least_chars=10).orderBy("section_no").collect()
    assert [(r.id, r.is_noop, r.is_actionable, r.is_self_contained) for r in rows] == [(1, False, True, True), (1, True, False, False), (1, False, True, False)]
    t = spark.createDataFrame([("ROLLBACK", "修改超时", "恢复旧值"), ("ROLLBACK", "删除路由", "还原"), ("IMPLEMENTATION", "修改超时", "x"), ("", " ", "x")], "p string, n string, o string")
    assert [r.t for r in t.select(steps.phase_title(F.col("p"), F.col("n"), F.col("o")).alias("t")).collect()] == ["回退：恢复超时原值", "回退：恢复已删除的路由", "实施：修改超时", "步骤：未命名步骤"]
    split = steps.should_split(spark.createDataFrame([(1, "x" * 6000, True)] * 5 + [(2, "x", True)] * 5, "id int, operation string, is_self_contained boolean"), ["id"]).collect()
    assert {r.id: r.split for r in split} == {1: True, 2: False}


def test_containing_meets_parts_of_every_length(spark):
    from loreloom.operators import joins, matching

    texts = ["", "a", "ab", "abc", "the cat sat on the mat", "concatenate"]
    parts = ["a", "at", "cat", "e cat s", "zz", "mat"]
    got = joins.containing(spark.createDataFrame([(t,) for t in texts], "t string"), spark.createDataFrame([(p,) for p in parts], "p string"), "t", "p").collect()
    assert sorted(map(tuple, got)) == sorted((t, p) for t in texts for p in parts if p in t)
    docs = spark.createDataFrame([(1, "x one two three four five six y"), (2, "one  two three four five six"), (3, "short bit here"), (4, None)], "doc_id long, text string")
    items = spark.createDataFrame([(1, "one two three four five six"), (2, "ne two three four five si"), (3, "bit")], "item_id long, quote string")
    assert sorted(map(tuple, matching.contained(docs, items).collect())) == [(1, 1, 2), (1, 2, 3), (3, 3, 6)]


def test_chain_carries_its_tip_over_batches(spark):
    from loreloom.operators import audit

    rows = spark.range(5000).selectExpr("id % 2 AS k", "id AS n", "CASE WHEN id % 7 <> 0 THEN concat('b', id) END AS body", "'t' AS tip")
    got = audit.chain(rows, "k", "n", "body", tip="tip")
    assert audit.verify(got, "k", "n", "body").filter("NOT valid").select("n").orderBy("n").collect() == [(0,), (1,)]  # they follow the tip
    assert audit.verify(audit.chain(rows, "k", "n", "body"), "k", "n", "body").filter("NOT valid").count() == 0


def test_equal_sets_are_pairs_with_their_first(spark):
    from loreloom.operators import matching

    words = [f"w{i}" for i in range(20)]
    items = spark.createDataFrame([(1, words), (2, words), (3, words[::-1]), (4, [*words, "x"]), (5, ["y"]), (6, [])], "id long, terms array<string>")
    assert sorted(map(tuple, matching.near_duplicate_pairs(items).collect())) == [(1, 2, 1.0), (1, 3, 1.0), (1, 4, 20 / 21)]


def test_context_groups_and_units(spark):
    from loreloom.operators import adapter

    text = '{"a": 1, "b": {"c": 2, "steps": [{"x": 1}, {"x": 2}], "d": "' + "long " * 12 + '", "e": 3}, "f": 4}'
    docs = spark.createDataFrame([(1, text), (2, "[1, 2]"), (3, "{bad"), (4, None)], "doc_id long, text string")
    roots = spark.createDataFrame([(1, "/b/steps/0"), (1, "/b/steps/1")], "doc_id long, pointer string")
    groups = {(r.doc_id, r.parent, r.pointer): r.group for r in adapter.context_groups(adapter.nodes(docs), roots).collect()}
    assert groups == {(1, "", "/a"): 0, (1, "", "/f"): 1, (1, "/b", "/b/c"): 0, (1, "/b", "/b/d"): 1, (1, "/b", "/b/e"): 1, (2, None, ""): 0}
    got = adapter.plan(docs, roots, 40).orderBy("doc_id", "unit_index").collect()
    assert [(r.doc_id, r.role[:4], r.pointers) for r in got] == [(1, "CONT", ["/a"]), (1, "CONT", ["/b/c"]), (1, "PROC", ["/b/steps/0"]), (1, "PROC", ["/b/steps/1"]), (1, "CONT", ["/b/d"]), (1, "CONT", ["/b/d"]), (1, "CONT", ["/b/e"]), (1, "CONT", ["/f"]), (2, "CONT", [""])]
    assert all(r.role == "PROCEDURE_STEP" or r.end - r.start <= 40 for r in got) and text[got[2].start : got[2].end] == '{"x": 1}'
    report = {r.doc_id: (r.steps, r.context_units, r.safe) for r in adapter.plan_report(adapter.plan(docs, roots, 40), docs).collect()}
    assert report == {1: (2, 6, True), 2: (0, 1, False), 3: (0, 0, False), 4: (0, 0, False)}


def test_step_cards_edges(spark):
    """Nulls, a missing phase, CJK texts that differ, and an empty table."""
    from loreloom.operators import cards

    rows = [(1, 0, None, None, "检查一"), (1, 1, "VALIDATION", "看", "检查二"), (1, 2, "VALIDATION", None, None), (None, 0, "ROLLBACK", "n", "")]
    source = spark.createDataFrame(rows, "case_id int, position int, phase string, name string, operation string")
    got = cards.canonical_cards(cards.step_cards(source).filter("case_id IS NOT NULL"))
    assert sorted((r.position, r.title, r.canonical_id == r.unit_id) for r in got.collect()) == [(0, "步骤：步骤 1", True), (1, "验证：看", True)]
    assert cards.step_cards(source.filter("false")).count() == 0
    assert cards.step_cards(source).filter("case_id IS NULL").count() == 1
