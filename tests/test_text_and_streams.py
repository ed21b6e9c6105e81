"""Text functions, literal evidence, validation, annotation, inventory and streams."""

import datetime as dt
import json
import random
import re

import pytest
from pyspark.sql import functions as F

from wayfold.functions import text
from wayfold.operators import annotate, catalog, inventory, ledger, rules, splits, validation
from wayfold.plans.evidence_queries import replay_conflicts
from wayfold.sources import artifacts
from wayfold.streaming import calls


def one(spark, value, expression):
    return spark.createDataFrame([(value,)], "t string").select(expression.alias("x")).first()["x"]


def test_text_functions(spark):
    assert one(spark, "  a\t b\n\xa0c ", text.squeeze("t")) == "a b c"
    assert one(spark, "abcdefghij", text.excerpt("t", 4)) == "ab\n[EXCERPT OMISSION]\nij"
    assert one(spark, "abcd", text.excerpt("t", 4)) == "abcd"
    long = "x" * 6000 + "y" * 50000
    assert one(spark, long, text.visible_window("t")) == "x" * 6000 + "\n[OLDER PREFIX CONTENT OMITTED]\n" + "y" * 42000
    assert [one(spark, v, text.epoch("t")) for v in ("12.5", "1970-01-01T00:00:10Z", "1970-01-01T01:00:00+01:00", "soon", None)] == [12.5, 10.0, 0.0, None, None]
    assert one(spark, "Tables and BOSS tables, raw x1y", text.term_set("t")) == ["table", "and", "bo", "x1y"]
    assert sorted(one(spark, 'SELECT 1 FROM "Sales".`Orders` join items', text.relation_refs("t"))) == ["items", "sales.orders"]


def brute_lines(messages):
    """Matches with their margins, by the plain rules."""
    alias, schema = re.compile(ledger.ALIAS_PATTERN.replace("(?iU)", ""), re.I), re.compile(ledger.SCHEMA_PATTERN.replace("(?iU)", ""), re.I)
    order = sorted(enumerate(messages), key=lambda m: (m[1][0] not in ("user", "tool"), -m[0]))
    seen, found = set(), []
    for i, (role, content) in order:
        kind = "task_requirement" if i == 0 else "terminal_transcript" if role in ("user", "tool") else "learner_command_or_assertion"
        for name, pattern in (("explicit_sql_alias", alias), ("schema_or_qualified_name", schema)):
            for m in pattern.finditer(content):
                key = (kind, " ".join(m.group(0).split()).lower())
                if key not in seen:
                    seen.add(key)
                    low, high = max(0, m.start() - 60), min(len(content), m.end() + 120)
                    found.append((i, kind, name, m.group(0), content[low:high], low > 0 or high < len(content)))
    found.sort(key=lambda f: (f[1] != "terminal_transcript", f[2] != "explicit_sql_alias", -f[0]))
    return found[:10]


def message_frame(spark, messages):
    rows = [("h", i, role, content) for i, (role, content) in enumerate(messages)]
    return spark.createDataFrame(rows, "history_id string, message_index long, role string, content string").repartition(3)


def test_literal_evidence(spark):
    filler = "plain words " * 20
    messages = [
        ("user", "Task Description:\nCreate model in daily_analytics.x1\nCurrent terminal state:\nready"),
        ("assistant", "The model is now in daily_analytics.y2 AS done; key AS k1"),
        ("user", filler + "domain.x main.x SELECT * FROM main.daily_order_summary;\nsale_key AS  sales_id\nquery returned main.X" + filler),
        ("assistant", "schema: sales, Sale_Key as Sales_ID; " + ", ".join(f"c{i} AS d{i}" for i in range(12))),
        ("tool", "Previous response had parsing errors; sale_key AS sales_id; bé AS cé"),
    ]
    rows = sorted(ledger.mapping_lines(message_frame(spark, messages)).collect(), key=lambda r: r["line"])
    names = ("message_index", "source_kind", "pattern", "matched_text", "text", "clipped")
    assert [tuple(r[n] for n in names) for r in rows] == brute_lines(messages)
    whole = ledger.ledger(message_frame(spark, messages), budget=400).collect()
    need = [r for r in whole if r["section"] == 0][0]
    assert need["text"] == "Create model in daily_analytics.x1"
    assert {r["source_kind"] for r in whole if r["section"] == 1} == {"terminal_transcript", "parser_feedback"}
    kept = [r["line"] for r in whole if r["section"] == 2]
    assert len(kept) < 10 and sorted(kept) == list(range(1, len(kept) + 1))


def summary(**changes):
    base = {**{k: "x" for k in validation.SUMMARY_TEXTS}, **{k: [] for k in validation.SUMMARY_LISTS}}
    return json.dumps({**base, **changes})


def test_salvage_and_summaries(spark):
    responses = [
        (1, "```json\n" + summary() + "\n```"), (2, "so: [bad {" + '{"a": [1, 2]} tail'), (3, "nothing {"), (4, summary(decision=" ")),
        (5, summary(extra=1)), (6, summary(objects=["a", 1])),
    ]
    df = spark.createDataFrame(responses, "id int, response string")
    good, bad = validation.salvage(df, "id", "response")
    found = {r["id"]: (r["found"], json.loads(r["json"])) for r in good.collect()}
    assert found[2] == ("embedded", {"a": [1, 2]}) and found[1][0] == "whole" and [r["id"] for r in bad.collect()] == [3]
    accepted, violations = validation.summaries(good.withColumnRenamed("json", "response"), "id", "response")
    assert [r["id"] for r in accepted.collect()] == [1] and accepted.first()["known_facts"] == []
    broken = {(r["row_id"], r["rule"]) for r in violations.collect()}
    assert {("4", "text:decision"), ("5", "fields"), ("6", "list:objects")} <= broken


def test_codebooks(spark):
    book = lambda *states: json.dumps(list(states))
    state = {"id": "S1", "description": "d", "roles": ["r"]}
    rows = [
        (1, book(state)), (2, book(state, state)), (3, book({**state, "reward": 1})), (4, "{}"), (5, book(*[{**state, "id": f"S{i}"} for i in range(33)])),
        (6, book({**state, "description": "x" * 32000})),
    ]
    df = spark.createDataFrame([(i, b, "route") for i, b in rows], "id int, codebook string, router_instructions string")
    accepted, violations = validation.codebooks(df, "id")
    assert [(r["id"], r["state_ids"]) for r in accepted.collect()] == [(1, ["S1"])]
    assert {(r["row_id"], r["rule"]) for r in violations.collect()} == {
        ("2", "duplicate_ids"), ("3", "state_fields"), ("4", "not_a_state_list"), ("5", "state_count"), ("6", "too_long"),
    }


def test_unsafe_paths(spark):
    paths = ["/etc/x.sql", "../x.sql", "a//b.sql", "a\\b.sql", "models/x.py", "models/ok.sql"]
    df = spark.createDataFrame([(i, p, "select 1") for i, p in enumerate(paths)], "project_id int, path string, content string")
    assert {r["row_id"] for r in validation.project_files(df).collect()} == {"0", "1", "2", "3", "4"}
    named = df.select("project_id").unionByName(df.limit(1).select(F.lit(99).cast(df.schema["project_id"].dataType).alias("project_id")))
    found = {(r["row_id"], r["rule"], r["detail"]) for r in validation.project_files(df, projects=named).collect()}
    assert ("99", "file_count", "0") in found


def test_history_records_refuse_outcomes(spark):
    record = {"history_id": "h", "task_id": "t", "rollout_id": "r", "step": 0, "prefix": "p"}
    rows = [(1, json.dumps(record)), (2, json.dumps({**record, "terminal_reward": 1}))]
    good, bad = validation.history_records(spark.createDataFrame(rows, "id int, raw string"), "id", "raw")
    assert good.count() == 1 and bad.first()["detail"] == "terminal_reward"
    assert validation.classifier_view(good).select("payload.*").columns == ["prefix", "cutoff_step"]


def test_integrity_of_transitions(spark):
    histories = spark.createDataFrame([("a", "T", "r", 0), ("b", "T", "r", 1), ("c", "T", "q", 2)], "history_id string, task_id string, rollout_id string, step int")
    moves = spark.createDataFrame(
        [("a", "b", "go", "w"), ("b", "a", "go", "w"), ("a", "c", "", None), ("x", "b", "go", "w")], "source_id string, target_id string, operation string, witness_ref string"
    )
    found = sorted((r["row_id"], r["rule"]) for r in rules.transition_integrity(moves, histories).collect())
    assert found == [("a", "cross_rollout"), ("a", "empty_operation"), ("a", "empty_witness"), ("b", "step_not_increasing"), ("x", "absent_source")]


def test_replay_conflict_ids(spark):
    row = spark.createDataFrame([("p", 0, "supported", "supported", "contradicted")], "probe_id string, record_index int, decision string, local_transfer string, full_segment_transfer string")
    assert [r["conflict_id"] for r in replay_conflicts(row).collect()] == ["replay_0_full_segment_transfer"]
    with pytest.raises(Exception, match="lacks a valid label"):
        replay_conflicts(row.withColumn("decision", F.lit("maybe"))).collect()


def test_annotation_cache_and_errors(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], "id int, t string")
    cache = spark.createDataFrame([], "request_key string, response string")
    upper = lambda rows: [t.upper() for t in rows["t"]]
    first, fresh = annotate.batch(df, ["t"], upper, model="m", cache=cache)
    assert sorted((r["id"], r["response"], r["cache_hit"]) for r in first.collect()) == [(1, "A", False), (2, "A", False), (3, "B", False)]
    assert fresh.count() == 2

    def broken(rows):
        raise TimeoutError("endpoint is unavailable")

    for _ in range(2):
        annotate.store(fresh, str(tmp_path / "cache"))
    saved = annotate.load(spark, str(tmp_path / "cache"))
    assert saved.count() == 2
    again, more = annotate.batch(df, ["t"], broken, model="m", cache=saved)
    assert more.count() == 0 and all(r["cache_hit"] for r in again.collect())
    with pytest.raises(Exception, match="endpoint is unavailable"):
        annotate.batch(df, ["t"], broken, model="other", cache=fresh)


def test_answers_outlive_a_run(spark, tmp_path):
    """A second run asks nothing, also after retries and for both stages of the judge; stored answers aren't shuffled."""
    asked = spark.sparkContext.accumulator(0)

    def answer(rows):
        asked.add(len(rows))
        return ["{}" if not f else '{"label": "unknown"}' for f in rows["feedback"]]

    def check(responses):
        return rules.check(responses, "id", {"label": (F.get_json_object("response", "$.label").isNull(), "missing")})

    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, "b")], "id int, t string")
    for run in range(2):
        cache = annotate.AnswerCache(spark, f"file://{tmp_path}/answers", buckets=4)
        accepted, attempts, _ = annotate.with_retry(df, "id", ["t"], answer, check, model="m", cache=cache)
        assert sorted(r["id"] for r in accepted.collect()) == [1, 2, 3]
        log = attempts.collect()
        assert {r["cache_hit"] for r in log} == {bool(run)} and len(log) == 6
    assert asked.value == 4  # two distinct requests, two attempts, one run
    cache.add(cache.entries().limit(1))  # a second writer with the same request
    spark.sql(f"DROP TABLE {cache.name}")
    again = annotate.AnswerCache(spark, f"file://{tmp_path}/answers", buckets=4)
    assert again.entries().count() == 4
    wanted = df.withColumn("request_key", annotate.request_key(["t"], "m"))
    plan = wanted.hint("shuffle_merge").join(again.entries(), "request_key")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(request_key") == 1  # the requests only

    def judge(label):
        def run(rows):
            asked.add(len(rows))
            return [label] * len(rows)

        return run

    pairs = spark.createDataFrame([("p", "A", "B", ["x", "y"])], "probe_id string, prefix_a string, prefix_b string, episodes array<string>")
    before = asked.value
    for _ in range(2):
        final, _ = annotate.judge_pairs(
            pairs, judge('{"decision": "supported"}'), judge('{"local_transfer": "supported", "full_segment_transfer": "unknown"}'),
            model="m", decision_cache=again, transfer_cache=again,
        )
        assert final.first()["decision_label"] == "supported" and final.first()["local_transfer_label"] == "supported"
    assert asked.value == before + 2
    log = annotate.receipts(df, "id", "t", attempts, "read this").collect()
    assert {(r["id"], r["attempts"], r["answered"], len(r["request_keys"]), r["input_clipped"]) for r in log} == {(k, 2, True, 2, False) for k in (1, 2, 3)}


def test_ledger_budget_counts_its_json(spark):
    """The budget is compared with the length of the whole ledger as JSON, notes included."""
    odd = 'say "x" \\ \t \x01 é\nselect a.b AS c1 from main.orders, a.b AS c2 from main.parts'
    messages = [("h", 0, "user", "Task Description:\nfind it"), ("h", 1, "assistant", odd), ("h", 2, "tool", odd + "\nAS schema: big"), ("g", 1, "tool", odd)]
    frame = spark.createDataFrame(messages, "history_id string, message_index long, role string, content string")
    policy = "p" * (ledger.ENVELOPE - len(json.dumps({"task": None, "seen": [], "lines": [], "note": ""})) + 4)
    whole = ledger.ledger(frame, budget=100_000).collect()
    for budget in (700, 1_000, 1_200, 1_500, 2_000, 3_000):
        for history in ("h", "g"):
            rows = sorted((r for r in whole if r["history_id"] == history), key=lambda r: (r["section"], r["line"]))
            matched = {r["line"]: r["matched_text"] for r in ledger.mapping_lines(frame).collect() if r["history_id"] == history}
            entry = lambda r: {"message_index": r["message_index"], "source_kind": r["source_kind"], "text": r["text"], "clipped": r["clipped"]}
            lines = [{**entry(r), "pattern": r["pattern"], "matched_text": matched[r["line"]]} for r in rows if r["section"] == 2]
            body = {"task": next((entry(r) for r in rows if r["section"] == 0), None), "seen": [entry(r) for r in rows if r["section"] == 1], "lines": lines, "note": policy}
            while len(json.dumps(body, ensure_ascii=False)) > budget and lines:
                lines.pop()
            got = ledger.ledger(frame, budget=budget).filter((F.col("history_id") == history) & (F.col("section") == 2)).count()
            assert got == len(lines), (budget, history)


def test_retry_keeps_both_attempts(spark):
    df = spark.createDataFrame([(1, "good"), (2, "second"), (3, "never")], "id int, t string")

    def answer(rows):
        return ["{}" if t == "never" or (t == "second" and not f) else '{"label": "unknown"}' for t, f in zip(rows["t"], rows["feedback"], strict=True)]

    def check(responses):
        label = F.get_json_object("response", "$.label")
        return rules.check(responses, "id", {"label": (label.isNull(), "missing")})

    accepted, attempts, exhausted = annotate.with_retry(df, "id", ["t"], answer, check, model="m")
    assert sorted(r["id"] for r in accepted.collect()) == [1, 2]
    log = sorted((r["id"], r["attempt"], r["status"]) for r in attempts.collect())
    assert log == [(1, 0, "accepted"), (2, 0, "rejected"), (2, 1, "accepted"), (3, 0, "rejected"), (3, 1, "rejected")]
    row = annotate.technical_unknowns(exhausted, ["decision"]).first()
    assert row["id"] == 3 and row["decision_label"] == "unknown" and row["technical_unknown"]


def test_first_stage_of_the_judge_sees_prefixes_only(spark):
    pairs = spark.createDataFrame([("p", "A", "B", ["FUTURE " + "x" * 20000, "later"])], "probe_id string, prefix_a string, prefix_b string, episodes array<string>")

    def decide(rows):
        if list(rows.columns) != ["prefix_a", "prefix_b"]:
            raise ValueError("leak")
        return ['{"decision": "supported"}'] * len(rows)

    def transfer(rows):
        return ['{"local_transfer": "supported", "full_segment_transfer": "supported"}'] * len(rows)

    final, overrides = annotate.judge_pairs(pairs, decide, transfer, model="m")
    row = final.first()
    assert row["local_clipped"] and not row["full_clipped"]
    assert (row["decision_label"], row["local_transfer_label"], row["full_segment_transfer_label"]) == ("supported", "unknown", "supported")
    assert [tuple(r) for r in overrides.collect()] == [("p", "local_transfer", "supported")]


TASKS = "task_id string, difficulty string, category string, tags array<string>"


def test_task_selection(spark):
    rows = [("timezone-a", "easy"), ("shipping-a", "easy"), ("refund-a", "medium"), ("late-arriving-a", "easy"), ("fix-a", "medium"), ("fix-b", "medium"), ("fix-c", "medium"),
            ("x1", "medium"), ("x2", "medium"), ("e1", "easy"), ("h1", "hard")]
    tasks = inventory.labelled(spark.createDataFrame([(t, d, "", []) for t, d in rows], TASKS))
    priority = spark.createDataFrame([("fix-c", 0), ("shipping-a", 1), ("h1", 2)], "task_id string, priority_rank int")
    assert sorted(r["task_id"] for r in inventory.pilot(tasks, priority).collect()) == ["e1", "fix-a", "fix-c", "x1", "x2"]
    picked = {r["task_id"]: r["origin"] for r in inventory.source_tasks(tasks, priority, 6).collect()}
    assert picked == {"fix-c": "priority", "h1": "priority", "e1": "pilot", "fix-a": "pilot", "x1": "pilot", "x2": "pilot"}
    with pytest.raises(ValueError, match="too few"):
        inventory.source_tasks(tasks, priority, 50)
    roles = inventory.exposure(tasks, priority, 6)
    flags = splits.hygiene(roles.filter("exposed"), roles.filter("held_out OR excluded")).first()
    assert flags["task_disjoint"] and not flags["validated_family_disjoint"]


def test_split_is_by_group_and_needs_four(spark):
    df = spark.createDataFrame([(f"t{i % 10}",) for i in range(100)], "task_id string")
    sides = {r["task_id"]: r["split"] for r in splits.by_group(df, 3).collect()}
    assert sum(s == "validation" for s in sides.values()) == 2 and len(sides) == 10
    assert sides == {r["task_id"]: r["split"] for r in splits.by_group(df.repartition(7), 3).collect()}
    with pytest.raises(Exception, match="at least four"):
        splits.by_group(df.filter("task_id < 't3'"), 3).collect()


def test_catalog_ranking(spark):
    rows = [("SALES", "ORDERS", "BASE TABLE"), ("main", "orders", "VIEW"), ("main", "customers", "VIEW"), ("x", "orders_backup", "BASE TABLE")]
    shape = "table_schema string, table_name string, table_type string"
    tables = spark.createDataFrame(rows, shape)
    texts = spark.createDataFrame([("t", "select * from sales.orders join invented.thing"), ("none", "zzz")], "text_id string, text string")
    ranked = {(r["text_id"], r["qualified_name"]): r["score"] for r in catalog.rank(texts, tables).collect()}
    assert ranked["t", "SALES.ORDERS"] == 1000 + 400 + 16 + 25 and ("t", "main.orders") not in ranked
    assert ranked["t", "x.orders_backup"] == 8 + 25 - 10
    assert ranked["none", "main.customers"] == 0 and sum(k[0] == "none" for k in ranked) == 4
    assert [r["ref"] for r in catalog.unresolved(texts, tables).collect()] == ["invented.thing"]
    wide = tables.unionByName(spark.createDataFrame([("w", f"other{i}", "VIEW") for i in range(60)], shape))
    assert {r["text_id"] for r in catalog.rank(texts, wide).collect()} == {"t"}


def plain_ranking(text_value, tables, top):
    """Every relation of a catalog scored against one text."""
    stop = set(text.STOP_TERMS)
    words = lambda t: {w.rstrip("s") for w in re.findall("[a-z][a-z0-9]*", t.lower()) if len(w) > 2 and w not in stop}
    normal = re.sub("[\"`]", "", text_value).lower()
    refs = {m[0] for m in re.findall(r"(?<![^\W])(?:from|join)\s+(([a-z_][a-z0-9_]*)(\.[a-z_][a-z0-9_]*)?)", normal)}
    said = lambda n: re.search(r"(?<![a-z0-9_])" + re.escape(n) + r"(?![a-z0-9_])", normal)
    found = []
    for schema, table, kind in tables:
        name, full = table.lower(), f"{schema}.{table}"
        key, main = full.lower(), schema.lower() == "main"
        sql = 1000 if key in refs else 800 if name in refs else 0
        if main and not sql and any(r.endswith("." + name) for r in refs):
            continue
        points = sql + (400 if said(key) else 150 if said(name) else 0) + 8 * len(words(text_value) & words(full))
        if points:
            old = re.search(r"(?:^|_)(?:hist|backup|tmp|stg|v[0-9]+)(?:_|$)", name)
            found.append((points + (20 if kind == "BASE TABLE" else 0) + (0 if main else 5) - (10 if old else 0), full))
    return sorted(found, key=lambda f: (-f[0], f[1]))[:top]


@pytest.mark.parametrize("few", [0, 3])
def test_catalog_ranking_equals_scoring_every_relation(spark, monkeypatch, few):
    """Crowded terms, namesakes in main, names with other characters; with the limits of sets lowered too."""
    if few:
        monkeypatch.setattr(catalog, "MOST_TERMS", few)
        monkeypatch.setattr(catalog, "MOST_TEXT_TERMS", few)
    rng = random.Random(21)
    stems = ["harvest", "apple", "pear", "tree", "count", "daily", "order-item", "cold store", "price$", "v2", "backup", "x", "\u00e4pfel"]
    schemas = ["main", "farm", "Farm-2", "north"]
    tables = sorted({
        (rng.choice(schemas), "_".join(rng.sample(stems, rng.randint(1, 3))), rng.choice(["BASE TABLE", "VIEW"])) for _ in range(260)
    })
    tables = [t for i, t in enumerate(tables) if i == 0 or tables[i - 1][:2] != t[:2]]
    pieces = [f"{s}.{t}" for s, t, _ in tables[::9]] + [t.upper() for _, t, _ in tables[::11]] + ["from", "join", "FROM", "ghost.apple", "\u00e9from pear", "trees", "and", ","]
    texts = [(k, " ".join(rng.choice(pieces) for _ in range(rng.randint(0, 14)))) for k in range(70)]
    made = catalog.rank(
        spark.createDataFrame(texts, "text_id int, text string"), spark.createDataFrame(tables, "table_schema string, table_name string, table_type string"), top=4
    )
    got = {k: [] for k, _ in texts}
    for r in made.collect():
        got[r["text_id"]].append((r["score"], r["qualified_name"]))
    for k, value in texts:
        assert sorted(got[k], key=lambda f: (-f[0], f[1])) == plain_ranking(value, tables, 4), value


def test_mentions_of_names_with_other_characters(spark):
    shape = "table_schema string, table_name string, table_type string"
    tables = spark.createDataFrame([("sales", "Order-Items", "BASE TABLE"), ("sales", "net$", "VIEW"), ("sales", "a b", "VIEW")], shape)
    texts = spark.createDataFrame(
        [("key", "see sales.Order-Items"), ("name", "the order-items, net$ and `a b`"), ("part", "preorder-items net$x a bc")], "text_id string, text string"
    )
    ranked = {(r["text_id"], r["qualified_name"]): r["score"] for r in catalog.rank(texts, tables, small_catalog=0).collect()}
    assert ranked["key", "sales.Order-Items"] == 400 + 2 * 8 + 25  # "order" is no term
    assert ranked["name", "sales.Order-Items"] == 150 + 8 + 25 and ranked["name", "sales.net$"] == 150 + 8 + 5 and ranked["name", "sales.a b"] == 150 + 5
    assert ("part", "sales.a b") not in ranked and ranked["part", "sales.Order-Items"] == 8 + 25
    known = catalog.relations(tables)
    blocks = catalog.odd_mentions(texts, known, block=1).select("text_id", "word").collect()
    assert sorted(map(tuple, blocks)) == sorted(map(tuple, catalog.odd_mentions(texts, known).select("text_id", "word").collect()))
    assert len(blocks) == 4


def test_review_rows_are_redacted(spark):
    rows = [("a", "task", "validated", "/root/me/x/y.md"), ("a", "task", "rejected", "/root/me/x"), ("b", "report", None, "see /root/me/z"), ("c", "report", None, "no")]
    df = spark.createDataFrame(rows, "name string, kind string, status string, note string")
    out = artifacts.review_rows(df, ["a", "b"], "/root/me", ["note"])
    assert sorted(r["note"] for r in out.collect()) == ["see z", "x/y.md"]


STREAM = "rollout_id string, prefix_sha256 string, ts timestamp"


def test_stream_drops_repeats_and_late_rows(spark, tmp_path):
    source = str(tmp_path / "in")

    def add(*rows):
        df = spark.createDataFrame(rows, "rollout_id string, prefix_sha256 string, ts string")
        df.withColumn("ts", F.to_timestamp("ts")).coalesce(1).write.mode("append").parquet(source)

    def run():
        stream = calls.call_stream(spark, source, spark.createDataFrame([], STREAM).schema)
        calls.append_to(calls.without_repeats(stream, delay="1 hour"), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()

    add(("a", "p", "2024-01-01 00:00:00"), ("a", "p", "2024-01-01 00:10:00"), ("b", "p", "2024-01-01 00:05:00"))
    run()
    add(("a", "p", "2024-01-01 00:20:00"), ("a", "q", "2024-01-02 00:00:00"))
    run()
    add(("c", "late", "2024-01-01 00:00:00"), ("c", "fresh", "2024-01-02 00:30:00"))
    run()
    found = sorted((r["rollout_id"], r["prefix_sha256"]) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert found == [("a", "p"), ("a", "q"), ("b", "p"), ("c", "fresh")]


def test_monitor_updates_open_windows(spark, tmp_path):
    source, base = str(tmp_path / "in"), str(tmp_path / "mon")
    results = spark.createDataFrame([("a",)], "rollout_id string")
    for rows in ([("a", "2024-01-01 01:00:00"), ("b", "2024-01-01 02:00:00")], [("b", "2024-01-01 03:00:00")]):
        df = spark.createDataFrame([(r, "x", t) for r, t in rows], "rollout_id string, prefix_sha256 string, ts string")
        df.withColumn("ts", F.to_timestamp("ts")).write.mode("append").parquet(source)
        stream = calls.call_stream(spark, source, spark.createDataFrame([], STREAM).schema)
        calls.upsert_to(calls.activity(stream, delay="2 days"), f"{base}/out", f"{base}/state").awaitTermination()
    newest = calls.newest(spark, f"{base}/out", ["rollout_id", "window_start"])
    rows = {r["rollout_id"]: (r["calls"], r["active"]) for r in calls.with_status(newest, results).collect()}
    assert rows == {"a": (1, False), "b": (2, True)}


def test_results_in_later_files_turn_calls_done(spark, tmp_path):
    """A call is given out as done in the batch that brings its result, as active once its time has passed; a late result is dropped."""
    shape, result = "rollout_id string, call_id int, ts timestamp", "rollout_id string, finished_at timestamp"
    at = lambda text: dt.datetime.fromisoformat(f"2024-01-{text}")
    files = [
        ([("a", 1, at("01 10:00")), ("b", 2, at("01 11:00")), ("d", 5, at("01 11:30"))], [("z", at("01 09:00"))]),
        ([("c", 3, at("02 10:00"))], [("a", at("01 12:00"))]),
        ([("c", 4, at("04 10:00"))], [("c", at("04 11:00"))]),
        ([("e", 6, at("09 10:00"))], [("d", at("01 12:00")), ("y", at("09 10:00"))]),
    ]
    done = []
    for k, (calls_of, results_of) in enumerate(files):
        for name, rows, kind in (("calls", calls_of, shape), ("results", results_of, result)):
            spark.createDataFrame(rows, kind).coalesce(1).write.mode("append").parquet(f"{tmp_path}/{name}")
        left = calls.call_stream(spark, f"{tmp_path}/calls", spark.createDataFrame([], shape).schema)
        right = calls.call_stream(spark, f"{tmp_path}/results", spark.createDataFrame([], result).schema)
        joined = calls.with_results(left, right, within="1 DAY", delay="12 hours")
        calls.append_to(joined, f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination()
        done.append({(r["call_id"], r["active"]) for r in spark.read.parquet(f"{tmp_path}/out").collect()})
    assert (1, False) not in done[0] and (1, False) in done[1]
    assert done[2] >= {(2, True), (5, True), (4, False)}
    assert done[3] == {(1, False), (2, True), (5, True), (3, True), (4, False)}  # the last result of d came too late, e is still open


def test_salvaged_json_reads_the_whole_text(spark):
    """JSON that stands in a document is met, against a scan of the whole response by the json module."""
    import json

    from wayfold.plans.text_queries import salvaged_json

    texts = {3: "plain", 4: 'see {"n": 7} there', 5: "a list [1, 2] here", 7: "open { and [ only", 8: "nothing {", 10: "plain", 11: "plain"}
    docs = spark.createDataFrame([(k, t, len(t)) for k, t in texts.items()], "doc_id long, text string, n_chars long")
    want = {}
    for k, t in texts.items():
        body = json.dumps({"n": len(t)})
        response = [body, f"{t} [oops {{{t}{body} done", f"{t} {{never closed"][k % 3]
        for at in [i for i, c in enumerate(response) if c in "[{"]:
            try:
                value = json.JSONDecoder().raw_decode(response[at:])[0]
            except ValueError:
                continue
            want[k] = ("whole" if k % 3 == 0 else "embedded", str(value["n"]) if isinstance(value, dict) else None)
            break
    assert {r.doc_id: (r.found, r.n) for r in salvaged_json({"documents": docs}).collect()} == want
    assert want[4] == ("embedded", "7") and 5 in want
