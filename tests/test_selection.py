"""Selections against plain sequential versions on small data."""

import hashlib
import itertools
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from wayfold.operators import matching, ordering, pairs, paths, probes


def test_positions_of_a_cut_group(spark):
    rows = [("hot", i * 3) for i in range(200)] + [("cold", i) for i in (5, 1, 9)]
    df = spark.createDataFrame(rows, "k string, n long").repartition(5)
    for slices in (1, 13):
        found = {(r["k"], r["n"]): (r["pos"], r["group_rows"]) for r in ordering.positions(df, ["k"], "n", slices=slices).collect()}
        assert all(found["hot", i * 3] == (i, 200) for i in range(200))
        assert [found["cold", n][0] for n in (1, 5, 9)] == [0, 1, 2]
    whole = {r["n"]: r["pos"] for r in ordering.positions(df.filter("k = 'hot'"), [], "n", slices=29).collect()}
    assert whole == {i * 3: i for i in range(200)}


@pytest.mark.parametrize("slices", [1, 17])
def test_positions_with_nulls_texts_and_an_outlier(spark, slices):
    rows = [(None, f"x{i:03d}", float(i)) for i in range(60)] + [("a", None, None), ("a", "z", 1e300), ("a", "b", 1.0)]
    df = spark.createDataFrame(rows, "k string, t string, v double").repartition(4)
    for order in ("t", "v"):
        found = ordering.positions(df, ["k"], order, slices=slices).collect()
        assert len(found) == 63
        assert {r["t"]: (r["pos"], r["group_rows"]) for r in found if r["k"] is None} == {f"x{i:03d}": (i, 60) for i in range(60)}
        assert {r["t"]: r["pos"] for r in found if r["k"] == "a"} == {None: 0, "b": 1, "z": 2}
    assert ordering.positions(df.limit(0), ["k"], "t", slices=slices).count() == 0


def sequential(rows, cap, limit):
    used, out = {}, []
    for rank, a, b in sorted(rows):
        if used.get(a, 0) < cap and used.get(b, 0) < cap and (limit is None or len(out) < limit):
            out.append((rank, a, b))
            used[a] = used.get(a, 0) + 1
            used[b] = used.get(b, 0) + 1
    return out


@pytest.mark.parametrize(("cap", "limit", "hub"), [(3, None, False), (3, 6, True), (1, 5, False)])
def test_greedy_equals_a_sequential_pass(spark, monkeypatch, cap, limit, hub):
    rng = random.Random(cap)
    edges = [tuple(sorted(rng.sample(range(12), 2))) for _ in range(60)]
    if hub:
        edges = [(0, b) for _, b in edges if b] + edges
    rows = [(i, a, b) for i, (a, b) in enumerate(dict.fromkeys(edges))]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "rank long, a long, b long")
    found = matching.greedy(df, "a", "b", ["rank"], cap=cap, limit=limit)
    monkeypatch.setattr(matching, "LEAST_HEAD", 1)
    monkeypatch.setattr(matching, "HEAD_PER_PAIR", 1)
    rounds = matching.greedy(df, "a", "b", ["rank"], cap=cap, limit=limit)
    assert sorted(r["rank"] for r in rounds.collect()) == sorted(r["rank"] for r in found.collect())
    assert sorted(map(tuple, found.collect())) == sequential(rows, cap, limit)


def sequential_diverse(ranked, limit):
    chosen, ids, targets, combos, seen_pairs = [], set(), set(), set(), set()
    tests = (
        lambda t, p: t not in targets and p not in seen_pairs,
        lambda t, p: t not in targets,
        lambda t, p: p not in seen_pairs,
        lambda t, p: (t, p) not in combos,
        lambda t, p: True,
    )
    for test in tests:
        for key, t, p in ranked:
            if len(chosen) < limit and key not in ids and test(t, p):
                chosen.append(key)
                ids.add(key)
                targets.add(t)
                seen_pairs.add(p)
                combos.add((t, p))
    return chosen


@pytest.mark.parametrize("limit", [3, 9, 40])
def test_diverse_passes(spark, limit):
    rng = random.Random(limit)
    rows = [(i, f"S{rng.randrange(4)}", f"P{rng.randrange(5)}") for i in range(45)]
    df = spark.createDataFrame(rows, "rank long, t string, p string")
    found = [r["rank"] for r in matching.diverse(df, "t", "p", ["rank"], limit).collect()]
    assert found == sequential_diverse(rows, limit)


def test_diverse_covers_targets_and_pairs_first(spark):
    rows = [(i, "S1", "A|B") for i in range(6)] + [(6, "S1", "A|C"), (7, "S2", "C|D")]
    df = spark.createDataFrame(rows, "rank long, t string, p string")
    found = matching.diverse(df, "t", "p", ["rank"], 3).collect()
    assert len({r["t"] for r in found}) == 2 and len({r["p"] for r in found}) == 3


def brute_pairs(rows, count, cap=3):
    words = {h: set(re.findall(r"[a-z]{4,}", text.lower())) for h, _, _, text in rows}
    scored = []
    for (a, ta, sa, _), (b, tb, sb, _) in itertools.combinations(sorted(rows), 2):
        if ta == tb or not (sa or sb):
            continue
        left, right = (b, a) if sa and not sb else (a, b)
        union = max(1, len(words[a] | words[b]))
        scored.append((-len(words[a] & words[b]) / union, left, right))
    used, out = {}, []
    for down, left, right in sorted(scored):
        if used.get(left, 0) < cap and used.get(right, 0) < cap and len(out) < math.ceil(count * 0.75):
            out.append((left, right, -down))
            used[left] = used.get(left, 0) + 1
            used[right] = used.get(right, 0) + 1
    return out, {(a, b) for _, a, b in scored}


HISTORIES = "history_id long, task_id string, has_segment boolean, prefix string"


def mixed_histories(seed):
    rng = random.Random(seed)
    pool = ["alpha", "beta", "gamma", "delta", "omega", "sigma", "kappa", "theta", "lambda", "zeta"]
    rows = []
    for i in range(60):
        if i % 3 == 0:  # a third are copies, told apart by one own word
            text = "alpha beta gamma delta shared story " + "own" + "abcdefgh"[i % 8] * (i // 8 + 1)
        else:
            text = " ".join(rng.sample(pool, rng.randrange(1, 6)))
        task = "hot" if i % 4 == 0 else f"t{rng.randrange(4)}"
        rows.append((i, task, rng.random() < 0.6, text))
    return rows


@pytest.mark.parametrize(("seed", "count"), [(1, 12), (2, 60)])
def test_pair_selection_equals_brute_force(spark, seed, count):
    rows = mixed_histories(seed)
    wanted, usable = brute_pairs(rows, count)
    df = spark.createDataFrame(rows, HISTORIES).repartition(3)
    found = pairs.select(df, count, seed=seed).collect()
    similar = [(r["left_id"], r["right_id"], r["similarity"]) for r in found if r["picked_by"] == "similar"]
    assert sorted(similar) == sorted(wanted)
    listed = [(r["left_id"], r["right_id"]) for r in found]
    assert len(set(listed)) == len(listed) == min(count, len(usable)) and set(listed) <= usable


def test_falling_floors_give_every_pair_once(spark, monkeypatch):
    """Each floor holds exactly the class pairs of at least that similarity, also with words dealt over several tasks."""
    monkeypatch.setattr(pairs, "HOT", 3)
    rows = mixed_histories(9)
    df = spark.createDataFrame(rows, HISTORIES)
    members, found = pairs.classes(df)
    members, found = pairs.cut_lineage(members), pairs.cut_lineage(found)
    words = {h: set(re.findall(r"[a-z]{4,}", t.lower())) for h, _, _, t in rows}
    class_of = {r["history_id"]: r["class_id"] for r in members.collect()}
    exact = {}
    for a, b in itertools.combinations(sorted(words), 2):
        shared, union = words[a] & words[b], words[a] | words[b]
        if shared:
            exact[tuple(sorted((class_of[a], class_of[b])))] = len(shared) / len(union)
    floors = []
    for floor, similar in pairs.falling(found):
        listed = [(r["left_class"], r["right_class"], r["similarity"]) for r in similar.collect()]
        got = {(a, b): s for a, b, s in listed if a != b}
        assert len(set(listed)) == len(listed)
        assert got == {k: s for k, s in exact.items() if k[0] != k[1] and s >= floor}
        floors.append(floor)
    assert floors[-1] == 0 and sorted(floors, reverse=True) == floors


def test_long_histories_are_searched_in_parts(spark, monkeypatch):
    """F1 to F3: no pair is lost between parts and sizes, and long texts that only share rare words are no candidates."""
    rng = random.Random(11)
    vocabulary = ["".join(rng.choices("abcdefghij", k=6)) for _ in range(900)]
    rows = []
    for i in range(12):
        base = rng.sample(vocabulary, rng.choice((30, 60, 200, 300)))
        for k, kept in enumerate((1.0, 0.95, 0.8, 0.62)):
            text = base[: int(len(base) * kept)] + ["own" + "abcdefghijkl"[i] * 3 + "xyzw"[k] * j for j in range(i % 3 * 4)]
            rows.append((4 * i + k, f"t{i % 3}", True, " ".join(text)))
    words = {h: set(re.findall(r"[a-z]{4,}", t)) for h, _, _, t in rows}
    monkeypatch.setattr(pairs, "PART_WORDS", 16)
    for hot in (4096, 4):
        monkeypatch.setattr(pairs, "HOT", hot)
        members, found = pairs.classes(spark.createDataFrame(rows, HISTORIES))
        class_of = {r["history_id"]: r["class_id"] for r in members.collect()}
        for floor in (0.5, 0.6, 0.9):
            exact = {
                tuple(sorted((class_of[a], class_of[b])))
                for a, b in itertools.combinations(sorted(words), 2)
                if len(words[a] & words[b]) / len(words[a] | words[b]) >= floor
            }
            similar = pairs.similar_classes(found, floor).filter("left_class <> right_class").collect()
            assert {(r["left_class"], r["right_class"]) for r in similar} == {p for p in exact if p[0] != p[1]} and len(similar) > 5
    monkeypatch.undo()
    # All texts meet at rare words; their words are so many that one bitmap would be full.
    apart = [(i, f"t{i}", True, " ".join(rng.sample(vocabulary, 800) + ["".join(rng.choices("klmnop", k=5)) for _ in range(2000)])) for i in range(30)]
    _, found = pairs.classes(spark.createDataFrame(apart, HISTORIES))
    assert pairs.candidates(found, 0.6).count() == 0


def test_draws_reach_all_pairs_alike(spark):
    """Every number gives another usable pair; draws spread over all histories; few pairs are all returned."""
    rows = [(r[0], None if r[0] == 7 else r[1], r[2]) for r in mixed_histories(4)]
    members = spark.createDataFrame(rows, "history_id long, task_id string, has_segment boolean").repartition(5)
    usable = {
        (a[0], b[0]) if a[2] == b[2] or b[2] else (b[0], a[0])
        for a in rows for b in rows
        if a[0] < b[0] and a[1] and b[1] and a[1] != b[1] and (a[2] or b[2])
    }
    places, tasks, number = pairs.usable_pairs(members)
    every = spark.range(number).selectExpr("id AS k", "id AS u")
    listed = [tuple(r) for r in pairs.pairs_at(places, tasks, number, every).select("left_id", "right_id").collect()]
    assert len(listed) == number == len(usable) and set(listed) == usable
    none = spark.createDataFrame([], "left_id long, right_id long")
    drawn = [tuple(r) for r in pairs.draw_pairs(members, none, 300, 1).collect()]
    assert len(set(drawn)) == 300 and set(drawn) <= usable and len({i for p in drawn for i in p}) > 50
    taken = spark.createDataFrame(sorted(usable)[:-4], "left_id long, right_id long")
    assert {tuple(r) for r in pairs.draw_pairs(members, taken, 9, 1).collect()} == set(sorted(usable)[-4:])
    assert pairs.draw_pairs(members.limit(0), none, 9, 1).count() == 0


def test_pair_selection_goes_on_with_unlike_pairs(spark):
    rows = [(i, f"t{i % 3}", True, f"word{'abcdefgh'[i % 8] * 4}{'xyz'[i // 8]}") for i in range(9)]
    wanted, _ = brute_pairs(rows, 8)
    found = pairs.select(spark.createDataFrame(rows, HISTORIES), 8, seed=3)
    similar = found.filter("picked_by = 'similar'")
    assert sorted((r["left_id"], r["right_id"], r["similarity"]) for r in similar.collect()) == sorted(wanted)


def test_expansion_brings_only_new_pairs(spark):
    df = spark.createDataFrame(mixed_histories(5), HISTORIES)
    first = pairs.select(df, 8, seed=1)
    old = {(r["left_id"], r["right_id"]) for r in first.collect()}
    more = pairs.expand(df, first, 0, 8, cap=5, seed=2).collect()
    assert len(more) == 5 and not old & {(r["left_id"], r["right_id"]) for r in more}
    assert pairs.expand(df, first, 1, 8, cap=5, seed=2).count() == 0


def evidence(label, method="llm", independent=True, audited=False):
    return None if label is None else (label, method, "ref", independent, audited, "")


EVIDENCE = "struct<label:string,method:string,source_ref:string,independent:boolean,audited:boolean,rationale:string>"
PROBES = f"probe_id string, left_id string, right_id string, decision {EVIDENCE}, splice {EVIDENCE}, full_segment {EVIDENCE}, operation_scope string"


def bank(spark, *rows):
    return spark.createDataFrame([(*r[:3], *map(evidence, r[3:6]), r[6]) for r in rows], PROBES)


def test_junction_evidence_is_directional(spark):
    whole, first = "full_observed_segment", "first_witnessed_execution_episode"
    cases = {
        "replay": ("supported", "contradicted", None, whole, "contradicted", "unassessed"),
        "mismatch": ("contradicted", "contradicted", None, whole, "contradicted", "blocked_decision_mismatch"),
        "open": ("supported", "unknown", None, whole, "unknown", "unassessed"),
        "full": ("supported", "supported", "contradicted", first, "contradicted", "unassessed"),
        "local": ("supported", "supported", None, first, "unknown", "unassessed"),
        "good": ("supported", "contradicted", "supported", first, "supported", "unassessed"),
    }
    rows = [(k, f"{k}-a", f"{k}-b", d, s, f, scope) for k, (d, s, f, scope, _, _) in cases.items()]
    found = {(r["left_history_id"], r["right_history_id"]): r for r in paths.junctions(bank(spark, *rows)).collect()}
    for k, (*_, status, compilation) in cases.items():
        row = found[f"{k}-a", f"{k}-b"]
        assert (row["junction_status"], row["compilation_status"]) == (status, compilation), k
    # The reversed pair gets the decision but never the continuation.
    assert found["good-b", "good-a"]["junction_status"] == "unknown"
    assert found["good-b", "good-a"]["decision_status"] == "supported"
    assert found["mismatch-b", "mismatch-a"]["compilation_status"] == "blocked_decision_mismatch"


MOVES = "source_id string, target_id string, task_id string, operation string, source_state string, target_state string"


def digest(move):
    return hashlib.md5(f"{move[0]}|{move[1]}".encode()).hexdigest()


def brute_paths(moves, status, stats, limit):
    ranked, blocked = [], set()
    for a, b in itertools.product(moves, moves):
        if a[5] != b[4] or a[2] == b[2]:
            continue
        label, compilation = status.get((a[1], b[0]), ("unknown", "unassessed"))
        ids = (a[0], a[1], b[0], b[1])
        if compilation == "blocked_decision_mismatch":
            blocked.add(ids)
            continue
        variance, rollouts = stats[a[5]]
        key = (label != "supported", -variance, -rollouts, digest(a), digest(b), ids)
        ranked.append((key, a[5], "|".join(sorted((a[2], b[2])))))
    ranked.sort()
    return [k[-1] for k in sequential_diverse(ranked, limit)], blocked


@pytest.mark.parametrize(("seed", "limit"), [(1, 6), (2, 25)])
def test_path_selection_equals_brute_force(spark, seed, limit):
    rng = random.Random(seed)
    moves = []
    for i in range(70):
        task = "hot" if rng.random() < 0.5 else f"t{rng.randrange(5)}"
        states = [f"S{rng.randrange(4)}" for _ in range(2)]
        moves.append((f"h{i:03d}a", f"h{i:03d}b", task, "go", *states))
    stats = {f"S{i}": (v, n) for i, (v, n) in enumerate([(0.25, 3), (0.0, 9), (0.25, 3), (0.1, 1)])}
    joined = [(a[1], b[0]) for a, b in itertools.product(moves, moves) if a[5] == b[4] and a[2] != b[2]]
    # The best paths of a state are judged away, so that others have to follow.
    picked = joined[:12] + rng.sample(joined, 20)
    labels = ["contradicted", "supported", "unknown"]
    rows = [(f"p{i}", x, y, labels[i % 3 if i > 8 else 0], labels[(i // 3) % 3], None, "full_observed_segment") for i, (x, y) in enumerate(dict.fromkeys(picked))]
    junction_rows = paths.junctions(bank(spark, *rows))
    status = {
        (r["left_history_id"], r["right_history_id"]): (r["junction_status"], r["compilation_status"]) for r in junction_rows.collect()
    }
    outcome = spark.createDataFrame([(s, v, n) for s, (v, n) in stats.items()], "state_id string, pooled_binary_variance double, distinct_rollouts long")
    chosen, ledger = paths.cross_task(spark.createDataFrame(moves, MOVES), junction_rows, outcome, limit)
    ids = ["left_source_id", "left_target_id", "right_source_id", "right_target_id"]
    wanted, blocked = brute_paths(moves, status, stats, limit)
    assert [tuple(r[c] for c in ids) for r in chosen.collect()] == wanted
    assert {tuple(r[c] for c in ids) for r in ledger.collect()} == blocked


def test_a_hub_of_judged_partners_reads_its_own_partners_only(spark):
    """500 judged partners of the first history; the same choice as brute force, from a few rows per side."""
    moves = [(f"l{i}a", f"l{i}b", f"t{i % 3}", "go", "X", "M") for i in range(40)]
    moves += [(f"r{i}a", f"r{i}b", f"t{i % 7}", "go", "M", "Y") for i in range(700)]
    hub = min(moves[:40], key=digest)
    ranked = sorted((m for m in moves[40:] if m[2] != hub[2]), key=digest)[:500]
    rows = [(f"p{i}", hub[1], m[0], "contradicted", "supported", None, "full_observed_segment") for i, m in enumerate(ranked)]
    junction_rows = paths.junctions(bank(spark, *rows))
    status = {(hub[1], m[0]): ("contradicted", "blocked_decision_mismatch") for m in ranked}
    outcome = spark.createDataFrame([("M", 0.2, 4)], "state_id string, pooled_binary_variance double, distinct_rollouts long")
    frame = spark.createDataFrame(moves, MOVES)
    chosen, _ = paths.cross_task(frame, junction_rows, outcome, 8)
    ids = ["left_source_id", "left_target_id", "right_source_id", "right_target_id"]
    assert [tuple(r[c] for c in ids) for r in chosen.collect()] == brute_paths(moves, status, {"M": (0.2, 4)}, 8)[0]
    assert paths.reachable(frame, junction_rows, 18).count() <= 2 * 18


def test_best_path_of_every_task_pair(spark):
    rng = random.Random(5)
    moves = [(f"h{i:03d}a", f"h{i:03d}b", f"t{i % 60:02d}", "go", *rng.sample(["S0", "S1"], 2)) for i in range(240)]
    stats = {"S0": (0.25, 3), "S1": (0.0, 9)}
    joined = [(a[1], b[0]) for a, b in itertools.product(moves, moves) if a[5] == b[4] and a[2] != b[2]]
    rows = [
        (f"p{i}", x, y, "contradicted" if i % 3 else "supported", "supported", None, "full_observed_segment")
        for i, (x, y) in enumerate(rng.sample(joined, 300))
    ]
    junction_rows = paths.junctions(bank(spark, *rows))
    status = {
        (r["left_history_id"], r["right_history_id"]): (r["junction_status"], r["compilation_status"]) for r in junction_rows.collect()
    }
    best = {}
    for a, b in itertools.product(moves, moves):
        if a[5] == b[4] and a[2] != b[2]:
            label, compilation = status.get((a[1], b[0]), ("unknown", "unassessed"))
            if compilation != "blocked_decision_mismatch":
                key = (a[5], "|".join(sorted((a[2], b[2]))))
                rank = (label != "supported", digest(a), digest(b), (a[0], b[0]))
                best[key] = min(best.get(key, rank), rank)
    outcome = spark.createDataFrame([(s, v, n) for s, (v, n) in stats.items()], "state_id string, pooled_binary_variance double, distinct_rollouts long")
    found = paths.best_per_task_pair(spark.createDataFrame(moves, MOVES), junction_rows, outcome).collect()
    assert len(best) > 1_500
    assert {(r["target_state"], r["task_pair"]): (r["left_source_id"], r["right_source_id"]) for r in found} == {k: v[-1] for k, v in best.items()}


def test_path_totals(spark):
    moves = [("a", "b", "t1", "x", "S", "M"), ("c", "d", "t2", "x", "M", "E"), ("e", "f", "t1", "x", "M", "E"), ("a", "b", "t1", "x", "S", "M")]
    row = paths.totals(spark.createDataFrame(moves, MOVES)).first()
    assert (row["state_id"], row["incoming_witnesses"], row["outgoing_witnesses"], row["cross_task_paths"]) == ("M", 1, 2, 1)


def test_unjudged_shortlist_is_distinct(spark):
    moves = [(f"{t}{i}a", f"{t}{i}b", t, "x", s, e) for t, s, e in (("t1", "S", "M"), ("t2", "M", "E")) for i in range(3)]
    junction_rows = paths.junctions(bank(spark, ("p", "t10b", "t20a", "supported", "supported", None, "full_observed_segment")))
    outcome = spark.createDataFrame([("M", 0.2, 4)], "state_id string, pooled_binary_variance double, distinct_rollouts long")
    rows = paths.unjudged_shortlist(spark.createDataFrame(moves, MOVES), junction_rows, outcome).collect()
    found = [(r["left_target_id"], r["right_source_id"]) for r in rows]
    assert len(set(found)) == 3 and ("t10b", "t20a") not in found


def test_probe_scores_and_tiers(spark):
    rows = bank(
        spark,
        ("valid", "a", "b", "supported", "supported", None, "x"),
        ("invalid", "a", "b", "supported", "contradicted", None, "x"),
        ("unknown", "a", "b", "unknown", "supported", None, "x"),
    )
    same = spark.createDataFrame([("a", "S"), ("b", "S")], "history_id string, state_id string")
    total = probes.summarize(probes.score(rows, same)).first()
    assert (total["valid"], total["invalid"], total["unknown"], total["denominator"], total["mean_score"]) == (1, 1, 1, 3, -1.0)
    apart = same.withColumn("state_id", F.lit(None).cast("string"))
    total = probes.summarize(probes.score(rows, apart)).first()
    assert total["not_connected"] == 3 and total["mean_score"] == 0.0
    assert probes.summarize(probes.score(rows, same, "grounded")).first()["unknown"] == 3
    with pytest.raises(Exception, match="empty set"):
        probes.summarize(probes.score(rows.limit(0), same)).collect()
    label = spark.createDataFrame(
        [(evidence("supported", "llm", audited=True),), (evidence("supported", "execution"),), (evidence("supported", "execution", audited=True),)],
        f"e {EVIDENCE}",
    )
    assert [r[0] for r in label.select(probes.tier_of("e")).collect()] == ["proxy", "unknown", "grounded"]
