"""Readers over recorded files, the alignment rules and segments."""

import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F

from wayfold.functions import json_values
from wayfold.operators import anchors, coverage, segments
from wayfold.sources import artifacts, inventory, logs

def wants(query):
    return json.dumps({"plan": "look further", "commands": [query]})


COUNT_ROWS, LIST_ROWS, DROP_VIEW = wants("select count(*) from harvest"), wants("from harvest limit 3"), wants("drop view ripe")


def write_trial(root, name, calls, steps=None, result=None):
    agent = root / name / "agent"
    agent.mkdir(parents=True)
    text = "\n\n".join(json.dumps(c) for c in calls) + "\n"
    (agent / "policy_calls.jsonl").write_text(text)
    if steps is not None:
        (agent / "trajectory.json").write_text(json.dumps({"steps": steps}, indent=1))
    if result is not None:
        (agent.parent / "result.json").write_text(json.dumps(result, indent=1))


def talk(*turns):
    """Messages in turn from the user and the assistant."""
    return [{"role": "assistant" if i % 2 else "user", "content": t} for i, t in enumerate(turns)]


def recorded(number, message, seen=None, **more):
    observation = {} if seen is None else {"observation": {"results": [{"content": seen}]}}
    return {"step_id": number, "source": "agent", "message": message, **observation, **more}


@pytest.fixture()
def corpus(tmp_path):
    """Four trials: three executed steps, two of them recorded; all recorded; unfinished; broken verifier with a repeated prefix."""
    whole = talk("How many trees are ripe?", COUNT_ROWS, "412 rows", LIST_ROWS, "oak ash elm", DROP_VIEW, "no such view")
    write_trial(
        tmp_path, "field/ripe__7", [{"call_index": 3, "messages": whole}, {"call_index": 1, "messages": whole[:3]}, {"call_index": 0, "messages": whole[:1]}],
        [recorded(4, COUNT_ROWS, "412 rows"), recorded(6, DROP_VIEW, "no such view")],
        {"config": {"task": {"path": "/sets/ripe/"}}, "verifier_result": {"rewards": {"note": "n", "passed": True}}},
    )
    write_trial(
        tmp_path, "field/sown__2", [{"call_index": 0, "messages": whole[:1]}, {"call_index": 2, "messages": whole[:5]}],
        [recorded(1, COUNT_ROWS, "412   rows"), recorded(2, LIST_ROWS, "oak ash elm")],
        {"task_name": "sown", "verifier_result": {"rewards": {"speed": 0.25, "reward": 1.0}}},
    )
    write_trial(tmp_path, "field/idle__1", [{"call_index": 0, "messages": whole[:1]}])
    write_trial(
        tmp_path, "field/late__9", [{"call_index": k, "messages": whole[: 1 + 2 * k], "prefix_sha256": "same"} for k in range(3)],
        None, {"verifier_result": {"rewards": {"reward": 1}}, "exception_info": {"exception_type": "VerifierTimeout"}},
    )
    return str(tmp_path)


def test_results_rewards_and_tasks(spark, corpus):
    rows = {r["rollout_id"]: r for r in logs.trial_results(spark, corpus).collect()}
    assert {k: (r["task_id"], r["reward"]) for k, r in rows.items()} == {
        "field/ripe__7": ("ripe", 1.0),
        "field/sown__2": ("sown", 1.0),
        "field/late__9": ("late", None),
    }


def test_calls_ledgers_and_prefix_repeats(spark, corpus):
    calls, results = logs.policy_calls(spark, corpus), logs.trial_results(spark, corpus)
    assert calls.count() == 9
    listed = spark.createDataFrame([("sown", "other world")], "task_id string, reason string")
    kept, skipped, excluded = logs.split_completed(calls, results, listed)
    assert [r["rollout_id"] for r in skipped.collect()] == ["field/idle__1"]
    assert excluded.first()["raw_rollout_retained"] and excluded.count() == 1
    named = kept.join(results.select("rollout_id", "task_id"), "rollout_id")
    ids = sorted(r["history_id"] for r in anchors.prefix_records(named).collect())
    # Later calls of the last trial repeat its prefix hash and add no record.
    assert ids == ["field/late__9/h000", "field/ripe__7/h000", "field/ripe__7/h001", "field/ripe__7/h003"]


def test_segments_with_a_lost_step_stay_provisional(spark, corpus):
    calls, results = logs.policy_calls(spark, corpus), logs.trial_results(spark, corpus)
    events = logs.trajectory_events(logs.trajectories(spark, corpus))
    named = calls.join(results.select("rollout_id", "task_id"), "rollout_id")
    found = segments.adjacent(segments.align(anchors.prefix_records(named), events)).collect()
    rows = {(r["rollout_id"], r["start_step"]): r for r in found}
    assert set(rows) == {("field/ripe__7", 0), ("field/ripe__7", 1), ("field/sown__2", 0)}
    assert rows["field/ripe__7", 0]["confirmed"] and rows["field/ripe__7", 0]["common_messages"] == 1
    lost = rows["field/ripe__7", 1]
    assert not lost["confirmed"] and [e["prefix_message_index"] for e in lost["unresolved"]] == [3]
    assert [e["step_id"] for e in lost["execution_witnesses"]] == [6]
    both = rows["field/sown__2", 0]
    assert both["confirmed"] and both["operation"] == json.dumps([COUNT_ROWS, LIST_ROWS], separators=(",", ":"))


EVENTS = (
    "rollout_id string, steps array<struct<step_id:bigint,source:string,message:string,observations:array<string>,"
    "has_commands:boolean,timestamp:string>>"
)
PREFIXES = "history_id string, rollout_id string, messages array<struct<role:string,content:string>>, observed_at_epoch double"


def plain_alignment(messages, steps, cutoff):
    """(message, step) pairs by reading on from the last step taken; None for a message without a step."""
    squeeze = lambda t: " ".join((t or "").split())
    agent = [s for s in steps if s[1] == "agent" and s[2] is not None]
    found, here = [], 0
    for i, (role, text) in enumerate(messages):
        if role != "assistant":
            continue
        answers = []
        for later, answer in messages[i + 1 :]:
            if later == "assistant":
                break
            if later in ("user", "tool"):
                answers.append(answer or "")
        heard, place = squeeze("\n".join(answers)), here
        while place < len(agent):
            number, _, said, seen, _, stamp = agent[place]
            late = cutoff is not None and stamp is not None and float(stamp) > cutoff
            if answers and not late and squeeze(said) == squeeze(text) and all(squeeze(o) in heard for o in seen):
                break
            place += 1
        if place < len(agent):
            found.append((i, agent[place][0], place))
            here = place + 1
        else:
            found.append((i, None, None))
    return found


def test_alignment_equals_reading_on_in_random_logs(spark):
    """Few texts, so that they repeat; blanks, empty and missing texts, lost steps, late steps and steps of others."""
    rng = random.Random(12)
    said, heard = ["dig", "dig  deep", " dig deep", "", None], ["loam", "loam and clay", "", "clay", None]
    steps, prefixes = [], []
    for trial in range(60):
        log = [
            (k, rng.choice(["agent", "agent", "agent", "user"]), rng.choice(said), [o or "" for o in rng.sample(heard, rng.randint(0, 2))], True,
             rng.choice([None, str(10 * k)]))
            for k in range(rng.randint(0, 12))
        ]
        steps.append((str(trial), log))
        for n in range(3):
            messages = [(rng.choice(["assistant", "assistant", "user", "tool", "system"]), rng.choice(said + heard)) for _ in range(rng.randint(0, 14))]
            prefixes.append((f"{trial}/{n}", str(trial), messages, rng.choice([None, 45.0])))
    prefixes.append(("alone", "no such trial", [("assistant", "dig"), ("user", "loam")], None))
    events = logs.trajectory_events(spark.createDataFrame(steps[1:], EVENTS))
    rows = segments.align(spark.createDataFrame(prefixes, PREFIXES), events).collect()
    by_trial, taken = dict(steps[1:]), 0
    for row in rows:
        _, trial, messages, cutoff = next(p for p in prefixes if p[0] == row["history_id"])
        want = plain_alignment(messages, by_trial.get(trial, []), cutoff)
        assert [(e["prefix_message_index"], e["step_id"], e["occurrence"]) for e in row["aligned"]] == want, row
        assert all((e["status"] == segments.UNMATCHED) == (e["step_id"] is None) for e in row["aligned"])
        taken += sum(step is not None for _, step, _ in want)
    assert len(rows) == len(prefixes) and taken > 30


def test_message_forms(spark, tmp_path):
    """Commands inside a fence or behind words count; messages that are objects are no events."""
    body = wants("select 1")
    forms = [body, f"```json\n{body}\n```", f"I look at [it] first: {body} and go on", '{"commands": []}', "no {json", {"commands": ["x"]}, '{"commands": 0}', None]
    steps = [recorded(k, m, "ok") for k, m in enumerate(forms)] + [recorded(90, "words", "ok", tool_calls=[{"name": "t"}]), recorded(91, body)]
    write_trial(tmp_path, "a/b__1", [], steps, {})
    events = logs.trajectory_events(logs.trajectories(spark, str(tmp_path))).first()["events"]
    done, noop = "execution_episode", "recorded_noop_or_completion"
    assert [(e["step_id"], e["status"]) for e in events] == [
        (0, done), (1, done), (2, done), (3, noop), (4, noop), (6, noop), (90, done), (91, "unconfirmed_no_observation"),
    ]


def plain_value(text):
    """The first list or object that the json module reads from any bracket on."""
    for at, char in enumerate(text):
        if char in "[{":
            try:
                return json.JSONDecoder().raw_decode(text[at:])[0]
            except ValueError:
                continue
    return None


def test_json_scan_equals_trying_every_bracket():
    rng = random.Random(6)
    parts = ["[", "]", "{", "}", '"', '"a"', '"a":', ",", ":", "1", "-0.5e3", "true", "nul", "null", " ", "\\", '\\"', "x", "\n", "[]", "{}", '{"k":[1,"]"]}']
    for _ in range(30_000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 16)))
        span, want = json_values.first_value(text), plain_value(text)
        assert (span is None) == (want is None), text
        assert want is None or json.loads(span) == want, text


@pytest.mark.parametrize("unit", ["[", '["', '{"a":[', '["[",', '[ "\\"[', '{"a', '["[1,"'])
def test_json_scan_is_linear(unit):
    import time

    start = time.process_time()
    assert json_values.first_value(unit * (1_000_000 // len(unit))) is None
    assert time.process_time() - start < 20


def test_alignment_needs_visible_feedback(spark):
    events = logs.trajectory_events(spark.createDataFrame([("r", [(1, "agent", "go", [], False, None)])], EVENTS))
    prefixes = spark.createDataFrame([("a", "r", [("assistant", "go")], None), ("b", "r", [("assistant", "go"), ("tool", "")], None)], PREFIXES)
    found = {r["history_id"]: r["aligned"][0]["status"] for r in segments.align(prefixes, events).collect()}
    assert found == {"a": "unmatched_assistant_occurrence", "b": "unconfirmed_no_observation"}


def test_coverage_states(spark):
    message = [("user", "x"), ("assistant", "go"), ("user", "ok")]
    calls = spark.createDataFrame([(None, "timed", message, 15.0), (None, "ordered", message, None), (None, "missing", message, None)], PREFIXES)
    calls = calls.drop("history_id").withColumn("call_index", F.lit(4).cast("long"))
    step = lambda i, t: (i, "agent", "go", ["ok"], True, t)
    events = logs.trajectory_events(
        spark.createDataFrame([("timed", [step(1, "10"), step(2, "20")]), ("ordered", [step(1, None)])], EVENTS)
    )
    rows = {r["rollout_id"]: r for r in coverage.report(calls, events).collect()}
    assert rows["timed"]["terminal_tail_step_ids"] == "2" and rows["timed"]["terminal_response_omitted"]
    assert rows["ordered"]["terminal_response_omitted"] is False
    assert rows["missing"]["terminal_response_omitted"] is None
    assert rows["missing"]["coverage_label"] == "terminal tail unknown"


def test_file_receipts_and_tasks(spark, tmp_path):
    base = tmp_path / "vendor"
    task = base / "tasks" / "fix-shipping"
    task.mkdir(parents=True)
    (task / "instruction.md").write_text("Fix it")
    (task / "task.toml").write_text("x")
    (base / "a.duckdb").write_bytes(b"\0" * 8 + b"DUCK" + b"rest")
    (base / "b.duckdb").write_text("version https://git-lfs.github.com/spec/v1\noid sha256:abc\nsize 100000\n")
    found = inventory.files(spark, str(base))
    expected = spark.createDataFrame([("a.duckdb",), ("b.duckdb",), ("c.duckdb",)], "path string")
    rows = {r["path"]: r for r in inventory.database_receipts(found, expected).collect()}
    assert rows["a.duckdb"]["status"] == "duckdb_file" and rows["a.duckdb"]["materialized"]
    assert rows["b.duckdb"]["status"] == "git_lfs_pointer" and rows["b.duckdb"]["expected_bytes"] == 100000
    assert rows["b.duckdb"]["lfs_oid"] == "sha256:abc" and rows["c.duckdb"]["status"] == "missing"
    metadata = spark.createDataFrame([("fix-shipping", "easy", "secret")], "task_id string, difficulty string, author string")
    row = inventory.tasks(metadata, found).first()
    assert row["family"] == "fulfillment" and row["bucket"] == "debugging" and row["file_count"] == 2
    assert "author" not in row.asDict()
    assert row["files"][0]["sha256"] == hashlib.sha256(b"Fix it").hexdigest()
    lost = spark.createDataFrame([("other", "easy")], "task_id string, difficulty string")
    (base / "tasks" / "other").mkdir()
    (base / "tasks" / "other" / "task.toml").write_text("x")
    with pytest.raises(Exception, match="lacks an instruction"):
        inventory.tasks(lost, inventory.files(spark, str(base))).collect()


def test_large_files_are_streamed(spark, tmp_path):
    """A sparse file of 3 GB, which no cell could hold, next to small ones; files written by chunks come back whole."""
    big = tmp_path / "in" / "big.bin"
    big.parent.mkdir()
    with open(big, "wb") as out:
        out.write(b"\0" * 8 + b"DUCK")
        out.truncate(3 * 2**30)
    (tmp_path / "in" / "small name+.bin").write_bytes(b"abc")
    rows = {r["path"]: r for r in inventory.database_receipts(inventory.hashed_files(spark, str(tmp_path / "in"))).collect()}
    digest = hashlib.sha256()
    with open(big, "rb") as data:
        while block := data.read(2**24):
            digest.update(block)
    assert (rows["big.bin"]["bytes"], rows["big.bin"]["sha256"], rows["big.bin"]["status"]) == (3 * 2**30, digest.hexdigest(), "duckdb_file")
    assert rows["small name+.bin"]["sha256"] == hashlib.sha256(b"abc").hexdigest()
    chunks = [(f"d{k % 3}/f.bin", k, bytes([k]) * k) for k in range(30)]
    made = artifacts.write_files(spark.createDataFrame(chunks, "path string, place long, content binary").repartition(7), str(tmp_path / "out"))
    want = {p: b"".join(c for q, _, c in chunks if q == p) for p, _, _ in chunks}
    assert {r["path"]: r["bytes"] for r in made.collect()} == {p: len(c) for p, c in want.items()}
    got = inventory.hashed_files(spark, str(tmp_path / "out"), whole=140, block=16).collect()
    assert {r["path"]: (r["sha256"], bytes(r["head"])) for r in got} == {p: (hashlib.sha256(c).hexdigest(), c[:512]) for p, c in want.items()}
    with pytest.raises(ValueError, match="no task found"):
        inventory.tasks(spark.createDataFrame([], "task_id string"), inventory.files(spark, str(tmp_path / "out")))


def test_parts_of_a_file_are_written_by_several_tasks(spark, tmp_path, monkeypatch):
    """a task takes a stretch of the bytes, however they are spread over files; files come back whole and no part is left."""
    rng = random.Random(3)
    chunks = [(f"d/{name}.bin", k, rng.randbytes(rng.randrange(200))) for name, n in (("large", 400), ("a", 5), ("b", 1)) for k in range(n)]
    chunks.append(("d/empty.bin", 0, b""))
    rows = spark.createDataFrame(rng.sample(chunks, len(chunks)), "path string, place long, content binary").repartition(7)
    taken = []
    kept = artifacts.cut_lineage
    monkeypatch.setattr(artifacts, "cut_lineage", lambda df: taken.append(kept(df)) or taken[-1])
    made = artifacts.write_files(rows, str(tmp_path / "out"), stretch=2_000)
    want = {p: b"".join(c for q, _, c in sorted(chunks) if q == p) for p, _, _ in chunks}
    assert {r["path"]: r["bytes"] for r in made.collect()} == {p: len(c) for p, c in want.items()}
    assert {str(f.relative_to(tmp_path / "out")): f.read_bytes() for f in (tmp_path / "out").rglob("*.*") if not f.name.endswith(".crc")} == want
    parts = taken[0].collect()
    assert max(r["bytes"] for r in parts) < 10_000 < len(want["d/large.bin"]) and len(parts) > 10


def test_concurrent_writers_leave_complete_versions(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    root = str(tmp_path / "out")

    def write(i):
        return artifacts.publish(spark.range(50).withColumn("writer", F.lit(i)), root, "shared")

    with ThreadPoolExecutor(max_workers=4) as pool:
        runs = list(pool.map(write, range(8)))
    rows = artifacts.read_latest(spark, root, "shared")
    assert rows.count() == 50 and rows.select("writer").distinct().count() == 1
    assert artifacts.latest_run(spark, root, "shared") in runs
