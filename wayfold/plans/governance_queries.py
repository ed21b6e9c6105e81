"""Queries: reports, inventory, catalog ranking, artifacts and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfold.operators import anchors, catalog, inventory, probes, reports, rules, splits
from wayfold.plans.evidence_queries import BOARD, LABELLED, SCORED, bank, board, effective_sql
from wayfold.plans.fixtures import Views, check_sql
from wayfold.plans.registry import query
from wayfold.session import fresh_dir
from wayfold.sources import artifacts, logs
from wayfold.sources import inventory as task_files
from wayfold.streaming import calls as streams


@query(
    "trial_summary",
    check_sql(
        """SELECT coalesce(c.rollout_id, r.rollout_id) AS rollout_id, coalesce(n, 0) AS policy_calls, r.rollout_id IS NOT NULL AS completed, r.reward, r.task_id
        FROM (SELECT rollout_id, count(*) AS n FROM trial_calls GROUP BY 1) c FULL JOIN trial_results r ON r.rollout_id = c.rollout_id""",
        "trial_calls", "trial_results",
    ),
)
def trial_summary(v: Views):
    return reports.trial_summary(v["trial_calls"], v["trial_results"]).select(
        "rollout_id", "policy_calls", "completed", "reward", "task_id"
    )


@query(
    "trial_totals",
    check_sql(
        """SELECT count(*) FILTER (done) AS completed_trials, count(*) FILTER (NOT done) AS active_trials,
        CAST(sum(n) FILTER (done) AS BIGINT) AS completed_calls, CAST(sum(n) FILTER (NOT done) AS BIGINT) AS active_calls FROM (
        SELECT rollout_id, count(*) AS n, rollout_id IN (SELECT rollout_id FROM trial_results) AS done FROM trial_calls GROUP BY 1) x""",
        "trial_calls", "trial_results",
    ),
)
def trial_totals(v: Views):
    return reports.trial_totals(reports.trial_summary(v["trial_calls"], v["trial_results"]))


@query(
    "usage_ledger",
    check_sql(
        """SELECT model, role, count(*) FILTER (NOT cache_hit) AS calls, count(*) FILTER (cache_hit) AS cache_hits,
        CAST(sum(input_tokens) FILTER (NOT cache_hit) AS BIGINT) AS input_tokens, CAST(sum(output_tokens) FILTER (NOT cache_hit) AS BIGINT) AS output_tokens
        FROM usage_calls GROUP BY 1, 2""",
        "usage_calls",
    ),
)
def usage_ledger(v: Views):
    return reports.usage(v["usage_calls"])


@query(
    "corpus_summary",
    check_sql(
        f"""SELECT (SELECT count(*) FROM anchor_rows WHERE rollout_id IN (SELECT rollout_id FROM trial_results)) AS histories,
        (SELECT count(DISTINCT rollout_id) FROM anchor_rows WHERE rollout_id IN (SELECT rollout_id FROM trial_results)) AS rollouts,
        (SELECT count(DISTINCT task_id) FROM anchor_rows WHERE rollout_id IN (SELECT rollout_id FROM trial_results)) AS tasks,
        (SELECT count(DISTINCT rollout_id) FROM trial_calls WHERE rollout_id NOT IN (SELECT rollout_id FROM trial_results)) AS skipped_trials,
        0 AS excluded_trials, s_train AS supported_train, s_val AS supported_validation,
        (SELECT count(*) FROM board) AS candidates, (SELECT count(*) FROM board WHERE scored_probes > 0) AS evaluated,
        CASE WHEN s_train > 0 AND s_val > 0 THEN 'complete: support in both splits' ELSE 'complete: support missing in a split' END AS status
        FROM (SELECT count(*) FILTER (split = 'train') AS s_train, count(*) FILTER (split = 'validation') AS s_val FROM (
          SELECT split_part(probe_id, '-', 1) AS split, {effective_sql('decision_label', 'proxy')} AS d, {effective_sql('splice_label', 'proxy')} AS s FROM probes_cross) x
          WHERE d = 'supported' AND s = 'supported') y""",
        "anchor_rows", "trial_calls", "trial_results", "probes_cross", "candidate_assignments",
        labelled=LABELLED, scored=SCORED, board=BOARD,
    ),
)
def corpus_summary(v: Views):
    kept, skipped, _ = logs.split_completed(v["trial_calls"], v["trial_results"])
    rows = bank(v["probes_cross"]).withColumn("split", F.substring_index("probe_id", "-", 1))
    return reports.corpus_summary(
        anchors.select(kept), skipped, skipped.limit(0), probes.joint_counts(rows, "split"), board(v)
    )


RUNS = """SELECT 'run-' || (o_custkey % 50) AS run, 'path-' || o_orderkey AS path_id,
 CASE o_orderstatus WHEN 'F' THEN 'validated' WHEN 'P' THEN 'construction_failed' ELSE 'error' END AS status,
 CASE WHEN o_orderstatus = 'F' THEN '' ELSE repeat(o_orderpriority, 150) END AS reason FROM orders UNION ALL
 SELECT 'run-' || (o_custkey % 50), 'retry-' || o_orderkey, 'error', 'timeout' FROM orders"""


def construction_runs(v: Views) -> DataFrame:
    status = F.col("o_orderstatus")
    outcome = F.when(status == "F", "validated").when(status == "P", "construction_failed").otherwise("error")
    none = F.lit(None).cast("string")
    long_text = F.repeat("o_orderpriority", F.lit(150))

    def attempt(name, state, reason, error):
        return F.struct(name.alias("path_id"), state.alias("status"), reason.alias("reason"), error.alias("error"))

    key = F.col("o_orderkey").cast("string")
    return v["orders"].select(
        F.concat(F.lit("run-"), (F.col("o_custkey") % 50).cast("string")).alias("run"),
        F.array(
            attempt(F.concat(F.lit("path-"), key), outcome, F.when(status == "P", long_text), F.when(status == "O", long_text)),
            attempt(F.concat(F.lit("retry-"), key), F.lit("error"), none, F.lit("timeout")),
        ).alias("attempted"),
    )


@query("construction_attempts", check_sql("SELECT run, path_id, status, left(reason, 1000) AS reason FROM runs", runs=RUNS))
def construction_attempts(v: Views):
    return reports.attempt_ledger(construction_runs(v))


@query(
    "construction_attempt_counts",
    check_sql("SELECT run, status, count(*) AS attempts FROM runs GROUP BY 1, 2", runs=RUNS),
)
def construction_attempt_counts(v: Views):
    return reports.attempt_counts(reports.attempt_ledger(construction_runs(v)))


# Tasks made from parts: a name word by key, difficulty, category and tags by key.
NAMES = (
    "timezone-shift", "late-arriving-rows", "shipping-delay", "refund-rate", "campaign-lift", "churn-report",
    "stock-levels", "loyalty-score", "revenue-gap", "basket-mix", "graph-walk", "fix-sessions", "channel-cohort",
)
TASKS = f"""SELECT p_partkey, names[1 + p_partkey % {len(NAMES)}] || '-' || p_partkey AS task_id,
 CASE WHEN p_partkey % 17 = 0 THEN 'easy' WHEN p_partkey % 3 = 0 THEN 'medium' WHEN p_partkey % 3 = 1 THEN 'hard' END AS difficulty,
 CASE WHEN p_partkey % 5 = 0 THEN 'dbt-models' WHEN p_partkey % 19 = 0 THEN 'debugging' ELSE 'sql' END AS category,
 p_partkey % 7 = 0 AS snapshot FROM part, (SELECT [{', '.join("'" + n + "'" for n in NAMES)}] AS names) n"""
FAMILY = "CASE " + " ".join(
    f"WHEN regexp_matches(task_id, '{'|'.join(words)}') THEN '{label}'" for label, words in inventory.FAMILY_WORDS
) + " ELSE 'other' END"
LABELLED_TASKS = f"""SELECT *, family NOT IN ('timezone', 'fulfillment', 'late_arrivals', 'returns') AS eligible FROM (
 SELECT *, {FAMILY} AS family, CASE WHEN contains(task_id, 'fix-') OR category = 'debugging' THEN 'debugging'
 WHEN snapshot OR category = 'dbt-models' THEN 'modeling' ELSE 'analytics' END AS bucket FROM tasks) t"""
PRIORITY = "SELECT task_id, p_partkey AS priority_rank FROM tasks WHERE p_partkey % 29 = 4"
PILOT = """SELECT task_id, 0 AS part, 0 AS late FROM labelled_tasks WHERE eligible AND difficulty = 'easy' UNION ALL
 SELECT task_id, part, late FROM (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY late, task_id) AS k FROM (
 SELECT task_id, bucket, CASE bucket WHEN 'debugging' THEN 1 WHEN 'modeling' THEN 2 ELSE 3 END AS part,
 CASE WHEN task_id IN (SELECT task_id FROM priority) THEN 0 ELSE 1 END AS late FROM labelled_tasks WHERE eligible AND difficulty = 'medium') m) r WHERE k <= 2"""
SOURCE = """SELECT task_id, CASE c WHEN 0 THEN 'priority' WHEN 1 THEN 'pilot' ELSE 'backfill' END AS origin FROM (
 SELECT task_id, c, p, l, row_number() OVER (PARTITION BY task_id ORDER BY c, p, l) AS k FROM (
 SELECT task_id, 0 AS c, priority_rank AS p, 0 AS l FROM priority WHERE task_id IN (SELECT task_id FROM labelled_tasks WHERE eligible) UNION ALL
 SELECT task_id, 1, part, late FROM pilot UNION ALL SELECT task_id, 2, 0, 0 FROM labelled_tasks WHERE eligible) x) y WHERE k = 1
 ORDER BY c, p, l, task_id LIMIT 60"""
TASK_CTES = {"tasks": TASKS, "labelled_tasks": LABELLED_TASKS, "priority": PRIORITY, "pilot": PILOT, "source": SOURCE}
SOURCE_SIZE = 60


def task_rows(v: Views) -> DataFrame:
    key = F.col("p_partkey")
    name = F.element_at(F.array(*[F.lit(n) for n in NAMES]), (1 + key % len(NAMES)).cast("int"))
    rows = v["part"].select(
        F.concat_ws("-", name, key.cast("string")).alias("task_id"),
        "p_partkey",
        F.when(key % 17 == 0, "easy").when(key % 3 == 0, "medium").when(key % 3 == 1, "hard").alias("difficulty"),
        F.when(key % 5 == 0, "dbt-models").when(key % 19 == 0, "debugging").otherwise("sql").alias("category"),
        F.when(key % 7 == 0, F.array(F.lit("snapshot"))).otherwise(F.array(F.lit("etl"))).alias("tags"),
        F.concat(F.lit("build "), "p_name").alias("instruction"),
    )
    return inventory.labelled(rows)


def priority_rows(v: Views) -> DataFrame:
    return task_rows(v).filter("p_partkey % 29 = 4").select("task_id", F.col("p_partkey").alias("priority_rank"))


@query(
    "task_labels",
    check_sql("SELECT task_id, family, bucket, eligible FROM labelled_tasks", tasks=TASKS, labelled_tasks=LABELLED_TASKS),
)
def task_labels(v: Views):
    return task_rows(v).select("task_id", "family", "bucket", "eligible")


@query("pilot_tasks", check_sql("SELECT task_id, part FROM pilot", **{k: TASK_CTES[k] for k in ("tasks", "labelled_tasks", "priority", "pilot")}))
def pilot_tasks(v: Views):
    return inventory.pilot(task_rows(v), priority_rows(v)).select("task_id", "part")


@query("source_tasks", check_sql("SELECT * FROM source", **TASK_CTES))
def source_tasks(v: Views):
    return inventory.source_tasks(task_rows(v), priority_rows(v), SOURCE_SIZE)


EXPOSURE = """SELECT *, in_pilot OR in_source AS exposed, in_source AND NOT in_priority AS replacement, in_priority AND NOT in_source AS removed FROM (
 SELECT task_id, family, bucket, task_id IN (SELECT task_id FROM pilot) AS in_pilot, task_id IN (SELECT task_id FROM source) AS in_source,
 task_id IN (SELECT task_id FROM priority) AS in_priority, family IN ('fulfillment', 'late_arrivals', 'returns') AS held_out, family = 'timezone' AS excluded FROM labelled_tasks) z"""


def roles(v: Views) -> DataFrame:
    return inventory.exposure(task_rows(v), priority_rows(v), SOURCE_SIZE)


@query("task_exposure", check_sql(EXPOSURE, **TASK_CTES))
def task_exposure(v: Views):
    return roles(v)


@query(
    "split_hygiene",
    check_sql(
        """SELECT t AS shared_tasks, f AS shared_families, t = 0 AS task_disjoint, f = 0 AS family_disjoint,
        false AS validated_family_disjoint, true AS family_audit_required FROM (SELECT
        (SELECT count(*) FROM (SELECT task_id FROM exposure WHERE exposed INTERSECT SELECT task_id FROM exposure WHERE held_out OR excluded) a) AS t,
        (SELECT count(*) FROM (SELECT family FROM exposure WHERE exposed INTERSECT SELECT family FROM exposure WHERE held_out OR excluded) b) AS f) x""",
        **TASK_CTES, exposure=EXPOSURE,
    ),
)
def split_hygiene(v: Views):
    rows = roles(v)
    return splits.hygiene(rows.filter("exposed"), rows.filter("held_out OR excluded"))


@query(
    "agent_payloads",
    check_sql(
        """SELECT task_id, CASE WHEN open THEN 'build ' || p_name END AS instruction, CASE WHEN open THEN sha256('build ' || p_name) END AS instruction_sha256,
        CASE WHEN open THEN 'duckdb' END AS db_type FROM (SELECT t.*, p_name, family NOT IN ('fulfillment', 'late_arrivals', 'returns') AS open
        FROM labelled_tasks t JOIN part p ON p.p_partkey = t.p_partkey) x""",
        tasks=TASKS, labelled_tasks=LABELLED_TASKS,
    ),
)
def agent_payloads(v: Views):
    rows = inventory.agent_payload(task_rows(v))
    return rows.select("task_id", *[F.col(f"agent_payload.{f}").alias(f) for f in ("instruction", "instruction_sha256", "db_type")])


@query(
    "inventory_summary",
    check_sql(
        """SELECT coalesce(difficulty, 'unknown') AS difficulty, count(*) AS tasks, (SELECT count(*) FROM exposure WHERE in_pilot) AS pilot_count,
        (SELECT count(*) FROM exposure WHERE in_source) AS source_count, (SELECT count(*) FROM exposure WHERE held_out) AS heldout_count,
        (SELECT count(*) FROM exposure WHERE excluded) AS excluded_count, 'no pinned revision' AS launch_blockers FROM labelled_tasks GROUP BY 1""",
        **TASK_CTES, exposure=EXPOSURE,
    ),
)
def inventory_summary(v: Views):
    revision, materialized = F.lit(None).cast("string"), F.lit(True)
    blockers = F.array_join(
        F.array_compact(F.array(F.when(revision.isNull(), "no pinned revision"), F.when(~materialized, "database not materialized"))), "; "
    )
    return inventory.summary(task_rows(v), roles(v), blockers)


@query(
    "priority_integrity",
    check_sql(
        """SELECT 'ghost-' || p_partkey AS row_id, 'missing_task' AS rule, '' AS detail FROM part WHERE p_partkey % 31 = 5 UNION ALL
        SELECT task_id, 'duplicate_priority', '2' FROM tasks WHERE p_partkey % 29 = 4 AND p_partkey % 2 = 0""",
        tasks=TASKS,
    ),
)
def priority_integrity(v: Views):
    listed = priority_rows(v)
    again = listed.filter("priority_rank % 2 = 0")
    ghosts = v["part"].filter("p_partkey % 31 = 5").select(
        F.concat(F.lit("ghost-"), F.col("p_partkey").cast("string")).alias("task_id"), F.col("p_partkey").alias("priority_rank")
    )
    return rules.priority_integrity(listed.unionByName(again).unionByName(ghosts), task_rows(v))


CATALOG = """SELECT DISTINCT CASE WHEN p_size % 9 = 0 THEN 'main' ELSE lower(replace(p_brand, '#', '')) END AS table_schema,
 replace(p_name, ' ', '_') || CASE WHEN p_size % 8 = 3 THEN '_v2' ELSE '' END AS table_name, CASE WHEN p_size % 9 = 0 THEN 'VIEW' ELSE 'BASE TABLE' END AS table_type FROM part"""
TEXTS = """SELECT doc_id AS text_id, d.text || ' select * FROM "' || CASE WHEN doc_id % 5 = 0 THEN 'ghost' ELSE lower(replace(p_brand, '#', '')) END || '".' || replace(p_name, ' ', '_')
 || CASE WHEN doc_id % 3 = 0 THEN ' join ' || replace(p_name, ' ', '_') ELSE '' END || ' -- see ' || replace(p_name, ' ', '_') || '_v2' AS text
 FROM (SELECT *, doc_id % (SELECT count(*) FROM part) + 1 AS part_key FROM documents) d LEFT JOIN part ON p_partkey = part_key"""
# Brute force: every text against every relation.
CATALOG_CTES = dict(
    catalog=CATALOG,
    texts=TEXTS,
    norm=r"""SELECT text_id, list_distinct(regexp_extract_all(t, '(?:^|[^\p{L}\p{M}\p{N}_])(?:from|join)[ \t\n\x0b\f\r]+([a-z_][a-z0-9_]*(?:\.[a-z_][a-z0-9_]*)?)', 1)) AS refs,
    list_distinct(regexp_extract_all(t, '[a-z0-9_]+')) AS words, ' ' || array_to_string(regexp_extract_all(t, '[a-z0-9_]+(?:\.[a-z0-9_]+)*'), ' ') || ' ' AS chains,
    list_distinct(list_transform(list_filter(regexp_extract_all(lower(text), '[a-zA-Z][a-zA-Z0-9]*'), lambda w: length(w) > 2 AND NOT list_contains(
      ['select','from','where','group','order','table','schema','source','history','transition','task','stage','selecting','main','raw','data'], w)), lambda w: rtrim(w, 's'))) AS terms
    FROM (SELECT text_id, text, lower(regexp_replace(text, '["`]', '', 'g')) AS t FROM texts) x""",
    rel=r"""SELECT *, table_schema || '.' || table_name AS qualified_name, list_distinct(list_transform(list_filter(
      regexp_extract_all(table_schema || '.' || table_name, '[a-zA-Z][a-zA-Z0-9]*'), lambda w: length(w) > 2 AND NOT list_contains(
      ['select','from','where','group','order','table','schema','source','history','transition','task','stage','selecting','main','raw','data'], w)), lambda w: rtrim(w, 's'))) AS rterms FROM catalog""",
    scored=r"""SELECT text_id, qualified_name, table_schema, table_name, table_type, refs,
      CASE WHEN list_contains(refs, qualified_name) THEN 1000 WHEN list_contains(refs, table_name) THEN 800 ELSE 0 END AS sql,
      CASE WHEN (contains(chains, ' ' || qualified_name || ' ')
        OR contains(chains, '.' || qualified_name || ' ') OR contains(chains, ' ' || qualified_name || '.') OR contains(chains, '.' || qualified_name || '.')) THEN 400
           WHEN list_contains(words, table_name) THEN 150 ELSE 0 END AS mention,
      8 * len(list_intersect(terms, rterms)) AS shared FROM norm, rel""",
)


@query(
    "catalog_relevance",
    check_sql(
        r"""SELECT text_id, qualified_name, score FROM (SELECT *, row_number() OVER (PARTITION BY text_id ORDER BY score DESC, qualified_name) AS k FROM (
        SELECT text_id, qualified_name, sql + mention + shared + CASE WHEN table_type = 'BASE TABLE' THEN 20 ELSE 0 END + CASE WHEN table_schema <> 'main' THEN 5 ELSE 0 END
        - CASE WHEN regexp_matches(table_name, '(?:^|_)(?:hist|backup|tmp|stg|v[0-9]+)(?:_|$)') THEN 10 ELSE 0 END AS score FROM scored
        WHERE sql + mention + shared > 0 AND NOT (table_schema = 'main' AND sql = 0 AND len(list_filter(refs, lambda r: ends_with(r, '.' || table_name))) > 0)) a) b WHERE k <= 5""",
        **CATALOG_CTES,
    ),
)
def catalog_relevance(v: Views):
    return catalog.rank(evidence_texts(v), relation_rows(v), top=5)


@query(
    "unresolved_references",
    check_sql(
        """SELECT text_id, ref FROM (SELECT text_id, unnest(refs) AS ref FROM norm) x
        WHERE ref NOT IN (SELECT table_schema || '.' || table_name FROM catalog) AND ref NOT IN (SELECT table_name FROM catalog)""",
        **{k: CATALOG_CTES[k] for k in ("catalog", "texts", "norm")},
    ),
)
def unresolved_references(v: Views):
    return catalog.unresolved(evidence_texts(v), relation_rows(v))


def relation_rows(v: Views) -> DataFrame:
    main = F.col("p_size") % 9 == 0
    return v["part"].select(
        F.when(main, "main").otherwise(F.lower(F.replace("p_brand", F.lit("#"), F.lit("")))).alias("table_schema"),
        F.concat(F.replace("p_name", F.lit(" "), F.lit("_")), F.when(F.col("p_size") % 8 == 3, "_v2").otherwise("")).alias("table_name"),
        F.when(main, "VIEW").otherwise("BASE TABLE").alias("table_type"),
    ).distinct()


def evidence_texts(v: Views) -> DataFrame:
    table = F.replace("p_name", F.lit(" "), F.lit("_"))
    schema = F.when(F.col("doc_id") % 5 == 0, "ghost").otherwise(F.lower(F.replace("p_brand", F.lit("#"), F.lit(""))))
    numbered = v["documents"].withColumn("_part", F.col("doc_id") % v["part"].agg(F.count(F.lit(1))).scalar() + 1)
    joined = numbered.join(v["part"], F.col("p_partkey") == F.col("_part"), "left")
    return joined.select(
        F.col("doc_id").alias("text_id"),
        F.concat(
            "text", F.lit(' select * FROM "'), schema, F.lit('".'), table,
            F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit(" join "), table)).otherwise(""),
            F.lit(" -- see "), table, F.lit("_v2"),
        ).alias("text"),
    )


@query(
    "task_inventory",
    check_sql(
        """SELECT 'fix-' || source || '-' || doc_id AS task_id, 'easy' AS difficulty, 'other' AS family, 'debugging' AS bucket, 2 AS file_count,
        octet_length(encode(text)) + 3 AS file_bytes, sha256(text) AS instruction_sha256 FROM documents""",
    ),
)
def task_inventory(v: Views):
    """Tasks whose instruction files are the documents; each also has a settings file."""
    name = F.concat_ws("-", F.lit("fix"), "source", F.col("doc_id").cast("string"))
    file = lambda leaf, content: F.struct(
        F.concat(F.lit("repo/tasks/"), name, F.lit("/" + leaf)).alias("path"), content.cast("binary").alias("content")
    )
    found = v["documents"].select(
        F.inline(F.array(file("instruction.md", F.col("text")), file("task.toml", F.lit("x=1"))))
    ).withColumn("bytes", F.octet_length("content").cast("long"))
    metadata = v["documents"].select(name.alias("task_id"), F.lit("easy").alias("difficulty"), F.lit("secret").alias("author"))
    rows = task_files.tasks(metadata, found)
    return rows.select(
        "task_id", "difficulty", "family", "bucket", "file_count", "file_bytes", F.sha2("instruction", 256).alias("instruction_sha256")
    )


@query(
    "file_receipts",
    """SELECT kind || '/' || source || '.bin' AS path, strlen(body) AS bytes, sha256(body) AS sha256,
    CASE kind WHEN 'pointer' THEN 'git_lfs_pointer' WHEN 'data' THEN 'duckdb_file' ELSE 'unrecognized_binary' END AS status, kind = 'data' AS materialized,
    CASE WHEN kind = 'pointer' THEN 'sha256:' || source END AS lfs_oid, CASE WHEN kind = 'pointer' THEN CAST(characters AS BIGINT) END AS expected_bytes
    FROM (SELECT *, CASE kind WHEN 'pointer' THEN 'version https://git-lfs.github.com/spec/v1' || chr(10) || 'oid sha256:' || source || chr(10) || 'size ' || characters || chr(10)
        WHEN 'data' THEN 'checksumDUCK' || texts ELSE texts END AS body
      FROM (SELECT source, CASE WHEN source LIKE '%3' THEN 'pointer' WHEN source LIKE '%1' THEN 'data' ELSE 'plain' END AS kind,
        sum(n_chars) AS characters, string_agg(text, '' ORDER BY doc_id) AS texts FROM documents GROUP BY source) d) e""",
)
def file_receipts(v: Views):
    """Receipts of files written from the documents, one per source; those over 20,000 bytes are streamed."""
    root = fresh_dir(v.spark, "receipts")
    docs = v["documents"].withColumn(
        "kind", F.when(F.col("source").endswith("3"), "pointer").when(F.col("source").endswith("1"), "data").otherwise("plain")
    ).withColumn("path", F.concat("kind", F.lit("/"), "source", F.lit(".bin")))
    texts = docs.filter("kind <> 'pointer'").select("path", F.col("doc_id").alias("place"), F.col("text").cast("binary").alias("content"))
    starts = docs.filter("kind = 'data'").select("path", F.lit(-1).cast("long").alias("place"), F.lit("checksumDUCK").cast("binary").alias("content")).distinct()
    size = docs.filter("kind = 'pointer'").groupBy("path", "source").agg(F.sum("n_chars").cast("string").alias("size"))
    pointer = F.concat(F.lit("version https://git-lfs.github.com/spec/v1\noid sha256:"), "source", F.lit("\nsize "), "size", F.lit("\n"))
    pointers = size.select("path", F.lit(0).cast("long").alias("place"), pointer.cast("binary").alias("content"))
    artifacts.write_files(texts.unionByName(starts).unionByName(pointers), root)
    return task_files.database_receipts(task_files.hashed_files(v.spark, root, "*.bin", whole=20_000, block=8_000))


@query(
    "committed_artifact",
    """SELECT event_type, count(*) AS n, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS cents FROM events GROUP BY 1""",
)
def committed_artifact(v: Views):
    """Two versions are published; readers see the newest committed one."""
    root = fresh_dir(v.spark, "artifacts")
    rows = v["events"].groupBy("event_type").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.round(F.col("value") * 100).cast("long")).alias("cents")
    )
    artifacts.publish(rows.limit(1), root, "usage")
    artifacts.publish(rows, root, "usage")
    return artifacts.read_latest(v.spark, root, "usage")


@query(
    "review_export",
    """SELECT doc_id, 'artifact-' || (doc_id % 6) AS name, CASE WHEN doc_id % 2 = 0 THEN 'task' ELSE 'report' END AS kind,
    'see tasks/' || source || '/note.md' AS note FROM documents WHERE doc_id % 6 IN (1, 2, 4) AND (doc_id % 2 = 1 OR doc_id % 4 = 0)""",
)
def review_export(v: Views):
    doc = F.col("doc_id")
    rows = v["documents"].select(
        "doc_id",
        F.concat(F.lit("artifact-"), (doc % 6).cast("string")).alias("name"),
        F.when(doc % 2 == 0, "task").otherwise("report").alias("kind"),
        F.when(doc % 4 == 0, "validated").otherwise("rejected").alias("status"),
        F.concat(F.lit("see /home/me/project/tasks/"), "source", F.lit("/note.md")).alias("note"),
        F.col("text").alias("secret"),
    )
    allowed = ["artifact-1", "artifact-2", "artifact-4"]
    return artifacts.review_rows(rows, allowed, "/home/me/project", ["doc_id", "note"])


def event_stream(v: Views) -> DataFrame:
    events = streams.call_stream(v.spark, v.sf_dir, v["events"].schema, glob="events.parquet")
    return events.select(
        F.col("user_id").alias("rollout_id"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.sha2("event_type", 256).alias("prefix_sha256"),
    )


@query(
    "streamed_calls_without_repeats",
    "SELECT DISTINCT user_id AS rollout_id, sha256(event_type) AS prefix_sha256 FROM events",
)
def streamed_calls_without_repeats(v: Views):
    """File stream read to its end; the watermark spans the whole table."""
    base = fresh_dir(v.spark, "stream")
    unique = streams.without_repeats(event_stream(v), delay="60 days").select("rollout_id", "prefix_sha256")
    streams.append_to(unique, f"{base}/out", f"{base}/state").awaitTermination()
    return v.spark.read.schema("rollout_id long, prefix_sha256 string").parquet(f"{base}/out")


@query(
    "streamed_trial_monitor",
    check_sql(
        """SELECT user_id AS rollout_id, strftime(date_trunc('day', ts), '%Y-%m-%d') AS window_day, count(*) AS calls,
        strftime(max(ts), '%Y-%m-%d %H:%M:%S.%f') AS last_activity, user_id NOT IN (SELECT rollout_id FROM trial_results) AS active
        FROM events GROUP BY 1, date_trunc('day', ts)""",
        "trial_results",
    ),
)
def streamed_trial_monitor(v: Views):
    base = fresh_dir(v.spark, "stream")
    rows = streams.activity(event_stream(v), window="1 day")
    streams.upsert_to(rows, f"{base}/out", f"{base}/state").awaitTermination()
    newest = streams.newest(v.spark, f"{base}/out", ["rollout_id", "window_start"])
    return streams.with_status(newest, v["trial_results"]).select(
        "rollout_id",
        F.date_format("window_start", "yyyy-MM-dd").alias("window_day"),
        "calls",
        F.date_format("last_activity", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("last_activity"),
        "active",
    )


@query(
    "streamed_calls_with_results",
    """SELECT e.event_id AS call_id, e.user_id AS rollout_id, r.finished_at IS NULL AS active,
    strftime(r.finished_at, '%Y-%m-%d %H:%M:%S.%f') AS finished_at
    FROM events e LEFT JOIN (SELECT user_id, max(ts) + INTERVAL 5 MINUTE AS finished_at FROM events WHERE user_id % 3 <> 0 GROUP BY 1) r
    ON r.user_id = e.user_id AND r.finished_at <= e.ts + INTERVAL 12 HOUR""",
)
def streamed_calls_with_results(v: Views):
    """Calls and results as two streams of files, a few files of each per batch; many results come in later batches than their calls."""
    base = fresh_dir(v.spark, "stream")
    calls = v["events"].select(F.col("event_id").alias("call_id"), F.col("user_id").alias("rollout_id"), F.col("ts").cast("timestamp").alias("ts"))
    last = calls.filter("rollout_id % 3 <> 0").groupBy("rollout_id").agg(F.max("ts").alias("_last"))
    results = last.select("rollout_id", (F.col("_last") + F.expr("INTERVAL 5 MINUTES")).alias("finished_at"))
    end = calls.agg(F.max("ts") + F.expr("INTERVAL 200 DAYS")).first()[0]
    both = (("calls", calls, "ts"), ("results", results, "finished_at"))
    for name, rows, time in both:
        rows.repartitionByRange(6, time).write.parquet(f"{base}/{name}")
    # Rows far behind the last day move both watermarks past all calls; the batch after that gives out the open ones.
    for _ in range(2):
        for name, rows, _ in both:
            beyond = tuple(end if f.name in ("ts", "finished_at") else -1 for f in rows.schema.fields)
            v.spark.createDataFrame([beyond], rows.schema).coalesce(1).write.mode("append").parquet(f"{base}/{name}")
        streamed = {name: streams.call_stream(v.spark, f"{base}/{name}", rows.schema, files_per_batch=2) for name, rows, _ in both}
        joined = streams.with_results(streamed["calls"], streamed["results"], within="12 HOURS", delay="60 days")
        shown = joined.select("call_id", "rollout_id", "active", F.date_format("finished_at", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("finished_at"))
        streams.append_to(shown, f"{base}/out", f"{base}/state").awaitTermination()
    # Not in the stream: the filter would be moved below the watermark, which these rows have to move.
    return v.spark.read.schema(shown.schema).parquet(f"{base}/out").filter("call_id >= 0")
