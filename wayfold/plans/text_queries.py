"""Queries: text functions, literal evidence, validation jobs and annotation."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfold.functions import text
from wayfold.operators import annotate, exemplars, ledger, rules, validation
from wayfold.plans.fixtures import Views, check_sql
from wayfold.plans.registry import query
from wayfold.session import fresh_dir

SQUEEZED = r"trim(regexp_replace(text, '\s+', ' ', 'g'))"


@query(
    "text_forms",
    rf"""SELECT doc_id, md5({SQUEEZED}) AS squeezed, length({SQUEEZED}) AS squeezed_length,
    md5(CASE WHEN length(text) > 500 THEN left(text, 250) || chr(10) || '[EXCERPT OMISSION]' || chr(10) || right(text, 250) ELSE text END) AS excerpt,
    length(text) > 500 AS excerpt_clipped,
    md5(CASE WHEN length(text) > 48000 THEN left(text, 6000) || chr(10) || '[OLDER PREFIX CONTENT OMITTED]' || chr(10) || right(text, 42000) ELSE text END) AS visible_window,
    md5(left(text, 300)) AS bounded, length(text) > 300 AS bounded_clipped, length(text) AS original_length, sha256(text) AS original_sha256
    FROM documents""",
)
def text_forms(v: Views):
    rows = v["documents"].withColumn("_b", text.bounded_evidence("text", 300))
    return rows.select(
        "doc_id",
        F.md5(text.squeeze("text")).alias("squeezed"),
        F.length(text.squeeze("text")).alias("squeezed_length"),
        F.md5(text.excerpt("text", 500)).alias("excerpt"),
        text.clipped("text", 500).alias("excerpt_clipped"),
        F.md5(text.visible_window("text")).alias("visible_window"),
        F.md5("_b.data").alias("bounded"),
        F.col("_b.clipped").alias("bounded_clipped"),
        F.col("_b.original_length").alias("original_length"),
        F.col("_b.original_sha256").alias("original_sha256"),
    )


@query(
    "epoch_values",
    """SELECT event_id, CASE event_id % 4 WHEN 0 THEN value WHEN 3 THEN NULL ELSE epoch_us(date_trunc('second', ts)) / 1000000.0E0 END AS epoch
    FROM events""",
)
def epoch_values(v: Views):
    iso = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    kind = F.col("event_id") % 4
    written = (
        F.when(kind == 0, F.col("value").cast("string"))
        .when(kind == 1, F.concat(iso, F.lit("Z")))
        .when(kind == 2, F.concat(iso, F.lit("+00:00")))
        .otherwise(F.lit("yesterday"))
    )
    return v["events"].select("event_id", text.epoch(written).alias("epoch"))


@query(
    "fingerprints",
    """SELECT event_id, sha256('{"event_type":"' || event_type || '","user_id":' || user_id || '}') AS fingerprint,
    sha256('["' || event_type || '","' || user_id || '"]') AS list_fingerprint FROM events""",
)
def fingerprints(v: Views):
    return v["events"].select(
        "event_id",
        text.fingerprint(F.struct("event_type", "user_id")).alias("fingerprint"),
        text.fingerprint_strings("event_type", F.col("user_id").cast("string")).alias("list_fingerprint"),
    )


STOPS = ", ".join(f"'{w}'" for w in text.STOP_TERMS)
RELATION = text.RELATION_PATTERN


@query(
    "terms_and_references",
    check_sql(
        f"""SELECT doc_id, md5(array_to_string(list_sort(list_distinct(list_transform(list_filter(
          regexp_extract_all(lower(text), '[a-zA-Z][a-zA-Z0-9]*'),
          lambda w: length(w) > 2 AND NOT list_contains([{STOPS}], w)), lambda w: rtrim(w, 's')))), ' ')) AS terms,
        array_to_string(list_sort(list_distinct(regexp_extract_all(lower(regexp_replace(text, '["`]', '', 'g')), '{RELATION}', 1))), ',') AS refs FROM quoting""",
        quoting="""SELECT doc_id, source, text || chr(10) || 'select 1 FROM "' || source || '".Orders'
        || CASE WHEN doc_id % 2 = 0 THEN ' join `items`' ELSE '' END AS text FROM documents""",
    ),
)
def terms_and_references(v: Views):
    sql = F.concat(F.lit('\nselect 1 FROM "'), "source", F.lit('".Orders'))
    tail = F.when(F.col("doc_id") % 2 == 0, F.concat(sql, F.lit(" join `items`"))).otherwise(sql)
    rows = v["documents"].select("doc_id", F.concat("text", tail).alias("text"))
    return rows.select(
        "doc_id",
        F.md5(F.array_join(F.array_sort(text.term_set("text")), " ")).alias("terms"),
        F.array_join(F.array_sort(text.relation_refs("text")), ",").alias("refs"),
    )


def conversation_messages(v: Views, plain: Column) -> DataFrame:
    """Conversations as message rows, texts with markers and SQL lines."""
    content = F.when(
        F.col("turn") == 0,
        F.concat(F.lit("Task Description:\nuse schema: sales_"), F.col("task_id"), F.lit(" "), plain, F.lit("\nCurrent terminal state:\nready")),
    ).otherwise(F.concat(plain, F.lit("\nselect a.key AS k"), (F.col("turn") % 3).cast("string"), F.lit(" from main.orders")))
    return v["conv_turns"].select(
        F.col("rollout_id").alias("history_id"), F.col("turn").alias("message_index"), "role", content.alias("content")
    )


MESSAGES = """SELECT rollout_id AS history_id, turn AS message_index, role, CASE WHEN turn = 0
 THEN 'Task Description:' || chr(10) || 'use schema: sales_' || task_id || ' ' || plain || chr(10) || 'Current terminal state:' || chr(10) || 'ready'
 ELSE plain || chr(10) || 'select a.key AS k' || (turn % 3) || ' from main.orders' END AS content
 FROM (SELECT *, text AS plain FROM conv_turns) p"""
# Letters, marks and digits of any language and their blanks, written out for the check's regex engine.
W, S = r"[\p{L}\p{M}\p{N}_]", r"[\s\x0b\x85\p{Z}]"


@query(
    "explicit_mapping_lines",
    check_sql(
        """SELECT history_id, line, message_index, source_kind, pattern, matched_text FROM (
        SELECT *, row_number() OVER (PARTITION BY history_id ORDER BY source_kind <> 'terminal_transcript', pattern <> 'explicit_sql_alias',
          message_index DESC, nt, place) AS line FROM (
          SELECT *, row_number() OVER (PARTITION BY history_id, source_kind, lower(trim(regexp_replace(matched_text, '\\s+', ' ', 'g')))
            ORDER BY nt, message_index DESC, place) AS seen FROM hits) a WHERE seen = 1) b WHERE line <= 10""",
        "conv_turns",
        messages=MESSAGES,
        hits=rf"""SELECT history_id, message_index, role NOT IN ('user', 'tool') AS nt,
        CASE WHEN message_index = 0 THEN 'task_requirement' WHEN role IN ('user', 'tool') THEN 'terminal_transcript' ELSE 'learner_command_or_assertion' END AS source_kind,
        CASE WHEN place <= size_a THEN 'explicit_sql_alias' ELSE 'schema_or_qualified_name' END AS pattern, place, found[place] AS matched_text
        FROM (SELECT *, len(a) AS size_a, list_concat(a, b) AS found, unnest(range(1, len(a) + len(b) + 1)) AS place FROM (
          SELECT *, regexp_extract_all(content, '(?i)(?:^|[^\p{{L}}\p{{M}}\p{{N}}_])([A-Za-z_](?:{W}|\.)*{S}+AS{S}+[A-Za-z_]{W}*)', 1) AS a,
          regexp_extract_all(content, '(?i)(?:^|[^\p{{L}}\p{{M}}\p{{N}}_])(schema{S}*[:=]{S}*[^\n,}}]+|(?:main|daily_analytics)\.[A-Za-z_]{W}*)', 1) AS b FROM messages) x) y""",
    ),
)
def explicit_mapping_lines(v: Views):
    return ledger.mapping_lines(conversation_messages(v, F.col("text"))).select(
        "history_id", "line", "message_index", "source_kind", "pattern", "matched_text"
    )


@query(
    "task_requirements_and_observations",
    check_sql(
        r"""SELECT history_id, 'task_requirement' AS source_kind, message_index, md5(CASE WHEN length(t) > 2000 THEN left(t, 1000) || chr(10) || '[EXCERPT OMISSION]' || chr(10) || right(t, 1000) ELSE t END) AS text, length(t) > 2000 AS clipped
        FROM (SELECT history_id, message_index, trim(replace(replace(content, 'Task Description:' || chr(10), ''), chr(10) || 'Current terminal state:' || chr(10) || 'ready', ''), ' ' || chr(10)) AS t FROM messages WHERE message_index = 0) x UNION ALL
        SELECT history_id, 'terminal_transcript', message_index, md5(CASE WHEN length(content) > 1200 THEN left(content, 600) || chr(10) || '[EXCERPT OMISSION]' || chr(10) || right(content, 600) ELSE content END), length(content) > 1200
        FROM (SELECT *, row_number() OVER (PARTITION BY history_id ORDER BY message_index DESC) AS k FROM messages WHERE message_index > 0 AND role IN ('user', 'tool')) y WHERE k <= 2""",
        "conv_turns",
        messages=MESSAGES,
    ),
)
def task_requirements_and_observations(v: Views):
    rows = conversation_messages(v, F.col("text"))
    both = ledger.requirement(rows).unionByName(ledger.recent_observations(rows))
    return both.select("history_id", "source_kind", "message_index", F.md5("text").alias("text"), "clipped")


@query(
    "literal_evidence_ledger",
    check_sql(
        """SELECT history_id, section, line, message_index, source_kind, pattern, md5(text) AS text, clipped FROM (
        SELECT *, sum(size + CASE WHEN section > 0 AND first THEN 0 WHEN section > 0 THEN 2 ELSE 0 END)
            OVER (PARTITION BY history_id ORDER BY section, line) AS so_far, count(*) FILTER (section = 0) OVER (PARTITION BY history_id) AS needs FROM (
          SELECT *, row_number() OVER (PARTITION BY history_id, section ORDER BY line) = 1 AS first,
          length(CAST(to_json(text) AS VARCHAR)) + length(CAST(to_json(source_kind) AS VARCHAR)) + length(CAST(message_index AS VARCHAR)) + CASE WHEN clipped THEN 4 ELSE 5 END + CASE section WHEN 2
            THEN length('{"message_index": , "source_kind": , "pattern": , "matched_text": , "text": , "clipped": }') + length(CAST(to_json(pattern) AS VARCHAR)) + length(CAST(to_json(matched_text) AS VARCHAR))
            ELSE length('{"message_index": , "source_kind": , "text": , "clipped": }') END AS size FROM entries) s) t
        WHERE section < 2 OR ENVELOPE + CASE WHEN needs = 0 THEN 4 ELSE 0 END + so_far <= 4000""".replace("ENVELOPE", str(ledger.ENVELOPE)),
        "conv_turns",
        messages=MESSAGES,
        hits=rf"""SELECT history_id, message_index, role NOT IN ('user', 'tool') AS nt, content,
        CASE WHEN message_index = 0 THEN 'task_requirement' WHEN role IN ('user', 'tool') THEN 'terminal_transcript' ELSE 'learner_command_or_assertion' END AS source_kind,
        pattern, base + k AS place, found[k] AS matched_text,
        CAST(list_sum(list_transform(parts[1:k], lambda x: length(x))) + coalesce(list_sum(list_transform(whole[1:k - 1], lambda x: length(x))), 0) + length(whole[k]) - length(found[k]) AS BIGINT) AS begin
        FROM (SELECT *, unnest(range(1, len(found) + 1)) AS k FROM (SELECT *, regexp_extract_all(content, re, 1) AS found, regexp_extract_all(content, re, 0) AS whole,
            regexp_split_to_array(content, re) AS parts FROM messages, (VALUES
            ('explicit_sql_alias', 0, '(?i)(?:^|[^\p{{L}}\p{{M}}\p{{N}}_])([A-Za-z_](?:{W}|\.)*{S}+AS{S}+[A-Za-z_]{W}*)'),
            ('schema_or_qualified_name', 100000, '(?i)(?:^|[^\p{{L}}\p{{M}}\p{{N}}_])(schema{S}*[:=]{S}*[^\n,}}]+|(?:main|daily_analytics)\.[A-Za-z_]{W}*)')) p(pattern, base, re)) x) y""",
        lines=r"""SELECT history_id, 2 AS section, line, message_index, source_kind, pattern, matched_text,
        substring(content, greatest(begin - 60, 0) + 1, least(begin + length(matched_text) + 120, length(content)) - greatest(begin - 60, 0)) AS text,
        begin > 60 OR begin + length(matched_text) + 120 < length(content) AS clipped FROM (
        SELECT *, row_number() OVER (PARTITION BY history_id ORDER BY source_kind <> 'terminal_transcript', pattern <> 'explicit_sql_alias', message_index DESC, nt, place) AS line FROM (
          SELECT *, row_number() OVER (PARTITION BY history_id, source_kind, lower(trim(regexp_replace(matched_text, '\s+', ' ', 'g'))) ORDER BY nt, message_index DESC, place) AS seen FROM hits) a
          WHERE seen = 1) b WHERE line <= 10""",
        entries="""SELECT history_id, 0 AS section, 1 AS line, message_index, 'task_requirement' AS source_kind, NULL AS pattern, NULL AS matched_text,
        CASE WHEN length(t) > 2000 THEN left(t, 1000) || chr(10) || '[EXCERPT OMISSION]' || chr(10) || right(t, 1000) ELSE t END AS text, length(t) > 2000 AS clipped
        FROM (SELECT history_id, message_index, trim(replace(replace(content, 'Task Description:' || chr(10), ''), chr(10) || 'Current terminal state:' || chr(10) || 'ready', ''), ' ' || chr(10)) AS t FROM messages WHERE message_index = 0) x
        UNION ALL SELECT history_id, 1, message_index, message_index, 'terminal_transcript', NULL, NULL,
        CASE WHEN length(content) > 1200 THEN left(content, 600) || chr(10) || '[EXCERPT OMISSION]' || chr(10) || right(content, 600) ELSE content END, length(content) > 1200
        FROM (SELECT *, row_number() OVER (PARTITION BY history_id ORDER BY message_index DESC) AS k FROM messages WHERE message_index > 0 AND role IN ('user', 'tool')) y WHERE k <= 2
        UNION ALL SELECT * FROM lines""",
    ),
)
def literal_evidence_ledger(v: Views):
    """Whole ledger within its size budget."""
    rows = ledger.ledger(conversation_messages(v, F.col("text")), budget=4000)
    return rows.withColumn("text", F.md5("text")).withColumn("line", F.col("line").cast("long")).withColumn("section", F.col("section").cast("int"))


def _json_object(**fields: Column | str) -> Column:
    """JSON text from already encoded values, in the given order."""
    parts = [F.concat(F.lit(f'"{k}": '), F.lit(x) if isinstance(x, str) else x) for k, x in fields.items()]
    return F.concat(F.lit("{"), F.concat_ws(", ", *parts), F.lit("}"))


def _quoted(value: Column) -> Column:
    return F.concat(F.lit('"'), value, F.lit('"'))


def _case(v: Views, modulus: int) -> tuple[DataFrame, Column]:
    return v["documents"].select("doc_id", "source", "n_chars"), F.col("doc_id") % modulus


@query(
    "summary_violations",
    """SELECT CAST(doc_id AS VARCHAR) AS row_id, rule, detail FROM (
    SELECT doc_id, 'fields' AS rule, 'exact fields required' AS detail FROM documents WHERE doc_id % 7 = 1 UNION ALL
    SELECT doc_id, 'list:objects', 'objects' FROM documents WHERE doc_id % 7 = 1 UNION ALL
    SELECT doc_id, 'text:decision', 'decision' FROM documents WHERE doc_id % 7 = 2 UNION ALL
    SELECT doc_id, 'list:known_facts', 'known_facts' FROM documents WHERE doc_id % 7 = 3 UNION ALL
    SELECT doc_id, 'not_json', '' FROM documents WHERE doc_id % 7 = 4) x""",
)
def summary_violations(v: Views):
    rows, kind = _case(v, 7)
    fields: dict = {
        "decision": F.when(kind == 2, '" "').otherwise(_quoted(F.col("source"))),
        "remaining_goal": '"report"',
    }
    for name in validation.SUMMARY_LISTS:
        fields[name] = '["a", "b"]' if name != "known_facts" else F.when(kind == 3, '"a"').otherwise(F.lit("[]"))
    whole = _json_object(**fields)
    short = _json_object(**{k: x for k, x in fields.items() if k != "objects"})
    response = F.when(kind == 1, short).when(kind == 4, F.lit("{broken")).otherwise(whole)
    return validation.summaries(rows.withColumn("response", response), "doc_id", "response")[1]


@query(
    "assignment_validation",
    """SELECT doc_id, CASE WHEN doc_id % 11 = 0 THEN NULL ELSE 'S' || (n_chars % 8) END AS state_id, 1 AS bindings, 'p' AS evidence
    FROM documents WHERE doc_id % 9 NOT IN (1, 2, 3)""",
)
def assignment_validation(v: Views):
    rows, kind = _case(v, 9)
    state = F.when(kind == 1, '"S99"').when(F.col("doc_id") % 11 == 0, "null").otherwise(
        F.concat(F.lit('"S'), (F.col("n_chars") % 8).cast("string"), F.lit('"'))
    )
    body = _json_object(
        state_id=state,
        role_bindings=F.when(kind == 2, '{"a": 1}').otherwise(F.lit('{"a": "b"}')),
        evidence=F.when(kind == 3, '"p"').otherwise(F.lit('["p"]')),
    )
    fenced = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).otherwise(body)
    responses = rows.select("doc_id", F.when(F.col("doc_id") % 2 == 0, "c8").otherwise("c9").alias("candidate_id"), fenced.alias("response"))
    states = v.spark.createDataFrame([(c, [f"S{i}" for i in range(8)]) for c in ("c8", "c9")], "candidate_id string, state_ids array<string>")
    accepted, _ = validation.assignments(responses, "doc_id", "response", states)
    return accepted.select(
        "doc_id", "state_id", F.size("role_bindings").alias("bindings"), F.array_join("evidence", ",").alias("evidence")
    )


@query(
    "judgment_violations",
    """SELECT CAST(doc_id AS VARCHAR) AS row_id, rule, detail FROM (
    SELECT doc_id, 'label:decision' AS rule, 'decision' AS detail FROM documents WHERE doc_id % 8 IN (1, 2) UNION ALL
    SELECT doc_id, 'bindings', '' FROM documents WHERE doc_id % 8 = 3 UNION ALL
    SELECT doc_id, 'persona', '' FROM documents WHERE doc_id % 8 = 4 UNION ALL
    SELECT doc_id, 'fields', 'exact fields required' FROM documents WHERE doc_id % 8 = 5) x""",
)
def judgment_violations(v: Views):
    rows, kind = _case(v, 8)
    label = F.when(kind == 1, '"maybe"').otherwise(F.lit('"supported"'))
    reason = F.when(kind == 2, '"  "').otherwise(_quoted(F.col("source")))
    binding = _json_object(**{
        n: F.when(kind == 4, '" Agent "').otherwise(F.lit('"table"')) if n == "role" else '"x"' for n in validation.BINDING_FIELDS
    })
    bindings = F.when(kind == 3, '[{"role": "table"}]').otherwise(F.concat(F.lit("["), binding, F.lit("]")))
    fields = {"decision": _json_object(label=label, rationale=reason), "typed_role_bindings": bindings, "material_differences": "[]"}
    body = F.when(kind == 5, _json_object(**fields, extra="1")).otherwise(_json_object(**fields))
    found = validation.judgments(
        rows.withColumn("response", body), "doc_id", "response", ["decision"], lists=["material_differences"]
    )[1]
    return found


@query(
    "codebook_violations",
    """SELECT CAST(doc_id AS VARCHAR) AS row_id, rule, detail FROM (
    SELECT doc_id, 'duplicate_ids' AS rule, '' AS detail FROM documents WHERE doc_id % 6 = 1 UNION ALL
    SELECT doc_id, 'state_fields', '' FROM documents WHERE doc_id % 6 = 2 UNION ALL
    SELECT doc_id, 'state_count', '0' FROM documents WHERE doc_id % 6 = 3 UNION ALL
    SELECT doc_id, 'state_names', '' FROM documents WHERE doc_id % 6 = 4 UNION ALL
    SELECT doc_id, 'state_lists', '' FROM documents WHERE doc_id % 6 = 5) x""",
)
def codebook_violations(v: Views):
    rows, kind = _case(v, 6)
    first = _json_object(id='"S1"', description=_quoted(F.col("source")))
    second = (
        F.when(kind == 1, '{"id": "S1", "description": "again"}')
        .when(kind == 2, '{"id": "S2", "description": "b", "reward": "1"}')
        .when(kind == 4, '{"id": "S2", "description": " "}')
        .when(kind == 5, '{"id": "S2", "description": "b", "roles": [1]}')
        .otherwise(F.lit('{"id": "S2", "description": "b", "roles": ["r"], "requirements": []}'))
    )
    book = F.when(kind == 3, "[]").otherwise(F.concat(F.lit("["), first, F.lit(", "), second, F.lit("]")))
    candidates = rows.select("doc_id", book.alias("codebook"), F.lit("route by need").alias("router_instructions"))
    return validation.codebooks(candidates, "doc_id")[1]


@query(
    "project_file_violations",
    """SELECT CAST(doc_id AS VARCHAR) AS row_id, rule, detail FROM (
    SELECT doc_id, 'unsafe_path' AS rule, '/models/' || source || '.sql' AS detail FROM documents WHERE doc_id % 7 = 1 UNION ALL
    SELECT doc_id, 'unsafe_path', 'models/../' || source || '.sql' FROM documents WHERE doc_id % 7 = 2 UNION ALL
    SELECT doc_id, 'suffix', 'models/' || source || '.py' FROM documents WHERE doc_id % 7 = 3 UNION ALL
    SELECT doc_id, 'hook', 'models/' || source || '.sql' FROM documents WHERE doc_id % 7 = 4 UNION ALL
    SELECT doc_id, 'too_long', CASE doc_id % 7 WHEN 1 THEN '/models/' || source || '.sql' WHEN 2 THEN 'models/../' || source || '.sql'
      WHEN 3 THEN 'models/' || source || '.py' ELSE 'models/' || source || '.sql' END FROM documents WHERE length(text) + CASE WHEN doc_id % 7 = 4 THEN 13 ELSE 0 END > 30000) x""",
)
def project_file_violations(v: Views):
    kind = F.col("doc_id") % 7
    path = (
        F.when(kind == 1, F.concat(F.lit("/models/"), "source", F.lit(".sql")))
        .when(kind == 2, F.concat(F.lit("models/../"), "source", F.lit(".sql")))
        .when(kind == 3, F.concat(F.lit("models/"), "source", F.lit(".py")))
        .otherwise(F.concat(F.lit("models/"), "source", F.lit(".sql")))
    )
    content = F.when(kind == 4, F.concat("text", F.lit("\npost-hook: x"))).otherwise(F.col("text"))
    files = v["documents"].select(F.col("doc_id").alias("project_id"), path.alias("path"), content.alias("content"))
    return validation.project_files(files)


@query(
    "history_record_violations",
    """SELECT CAST(doc_id AS VARCHAR) AS row_id, rule, detail FROM (
    SELECT doc_id, 'fields' AS rule, 'terminal_reward' AS detail FROM documents WHERE doc_id % 6 = 0 UNION ALL
    SELECT doc_id, 'negative_step', '' FROM documents WHERE doc_id % 5 = 1 UNION ALL
    SELECT doc_id, 'empty_field', '' FROM documents WHERE doc_id % 7 = 2) x""",
)
def history_record_violations(v: Views):
    doc = F.col("doc_id")
    fields = dict(
        history_id=_quoted(F.concat(F.lit("h"), doc.cast("string"))),
        task_id=F.when(doc % 7 == 2, '""').otherwise(_quoted(F.col("source"))),
        rollout_id=_quoted(doc.cast("string")),
        step=F.when(doc % 5 == 1, "-1").otherwise(F.lit("3")),
        prefix='"seen so far"',
    )
    record = F.when(doc % 6 == 0, _json_object(**fields, terminal_reward="1")).otherwise(_json_object(**fields))
    return validation.history_records(v["documents"].select("doc_id", record.alias("record")), "doc_id", "record")[1]


@query(
    "rejection_counts",
    """SELECT rule, count(*) AS violations FROM (SELECT 'negative_total' AS rule FROM customer WHERE c_acctbal < 0 UNION ALL
    SELECT 'odd_nation' FROM customer WHERE c_nationkey % 2 = 1) x GROUP BY 1""",
)
def rejection_counts(v: Views):
    checks = {
        "negative_total": (F.col("c_acctbal") < 0, F.col("c_acctbal")),
        "odd_nation": (F.col("c_nationkey") % 2 == 1, F.col("c_nationkey")),
    }
    return rules.counts(rules.violations(v["customer"], "c_custkey", checks))


@query(
    "salvaged_json",
    """SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'whole' ELSE 'embedded' END AS found, CAST(n_chars AS VARCHAR) AS n FROM documents WHERE doc_id % 3 <> 2""",
)
def salvaged_json(v: Views):
    doc, body = F.col("doc_id"), _json_object(n=F.col("n_chars").cast("string"))
    prose = F.col("text")
    response = (
        F.when(doc % 3 == 0, F.concat(F.lit("```json\n"), body, F.lit("\n```")))
        .when(doc % 3 == 1, F.concat(prose, F.lit(" [oops {"), prose, body, F.lit(" done")))
        .otherwise(F.concat(prose, F.lit(" {never closed")))
    )
    good, _ = validation.salvage(v["documents"].select("doc_id", response.alias("response")), "doc_id", "response")
    return good.select("doc_id", "found", F.get_json_object("json", "$.n").alias("n"))


@query(
    "spec_reference_violations",
    """SELECT doc_id AS spec_id, rule, detail, severity FROM (
    SELECT doc_id, 'binding_without_transition' AS rule, 'edge_9' AS detail, 'violation' AS severity FROM documents WHERE doc_id % 9 = 1 UNION ALL
    SELECT doc_id, 'bound_tasks', '1', 'violation' FROM documents WHERE doc_id % 9 IN (1, 2) UNION ALL
    SELECT doc_id, 'source_tasks', '1', 'violation' FROM documents WHERE doc_id % 9 = 2 UNION ALL
    SELECT doc_id, 'obligation_missing', 'B', 'violation' FROM documents WHERE doc_id % 9 = 3 UNION ALL
    SELECT doc_id, 'stage_without_transition', 'edge_7', 'violation' FROM documents WHERE doc_id % 9 = 4 UNION ALL
    SELECT doc_id, 'known_fact_not_delivered', 'schema', 'violation' FROM documents WHERE doc_id % 9 = 5 UNION ALL
    SELECT doc_id, 'alternatives', '1', 'violation' FROM documents WHERE doc_id % 9 = 6 UNION ALL
    SELECT doc_id, rule, '0', 'violation' FROM documents, (VALUES ('bound_tasks'), ('transitions'), ('source_tasks'), ('alternatives')) r(rule) WHERE doc_id % 9 = 8 UNION ALL
    SELECT doc_id, 'unknown_fact_wording', 'backend', 'warning' FROM documents WHERE doc_id % 9 = 7) x""",
)
def spec_reference_violations(v: Views):
    """Specs made from documents, each with at most one kind of broken reference; one kind has no rows at all but its name."""
    specs, kind = v["documents"].select(F.col("doc_id").alias("spec_id")), F.col("spec_id") % 9

    def listed(names: str, *rows: Column) -> DataFrame:
        fields = names.split()
        exploded = specs.filter(kind != 8).select("spec_id", F.explode(F.array(*rows)).alias("r"))
        return exploded.select("spec_id", *[F.col("r")[f].alias(f) for f in fields])

    def row(**cells) -> Column:
        return F.struct(*[(F.lit(c) if isinstance(c, str) else c).alias(n) for n, c in cells.items()])

    second = F.when(kind == 2, "A").otherwise("B")
    transitions = listed(
        "transition_id source_task_id", row(transition_id="edge_0", source_task_id="A"), row(transition_id="edge_1", source_task_id=second)
    )
    bindings = listed(
        "transition_id source_task_id",
        row(transition_id="edge_0", source_task_id="A"),
        row(transition_id=F.when(kind == 1, "edge_9").otherwise("edge_1"), source_task_id=second),
    )
    obligations = listed("source_task_id", row(source_task_id="A"), row(source_task_id=F.when(kind == 3, "C").otherwise("B")))
    stages = listed("stage transition_id", row(stage="sg_a", transition_id="edge_0"), row(stage="sg_b", transition_id=F.when(kind == 4, "edge_7").otherwise("edge_1")))
    facts = listed(
        "role fact",
        row(role="known", fact="schema"),
        row(role="delivered", fact=F.when(kind == 5, "other").otherwise("schema")),
        row(role="unknown", fact="backend"),
        row(role="withheld", fact=F.when(kind == 7, "the backend type").otherwise("backend")),
    )
    alternatives = listed("text", row(text="duckdb"), row(text=F.when(kind == 6, "duckdb").otherwise("other")))
    return validation.spec_references(transitions, bindings, obligations, stages, facts, alternatives, specs)


def count_words(rows: pd.DataFrame) -> list[str]:
    return [json.dumps({"words": len(t.split())}) for t in rows["text"]]


WORDS_SQL = rf"len(string_split({SQUEEZED}, ' '))"


@query(
    "batch_annotation",
    f"""SELECT doc_id, '{{"words": ' || {WORDS_SQL} || '}}' AS response, text IN (SELECT text FROM documents WHERE doc_id % 4 = 0) AS cache_hit FROM documents""",
)
def batch_annotation(v: Views):
    docs = v["documents"].select("doc_id", "text")
    known = docs.filter("doc_id % 4 = 0").select(
        annotate.request_key(["text"], "counter").alias("request_key"),
        F.concat(F.lit('{"words": '), F.size(F.split(text.squeeze("text"), " ")).cast("string"), F.lit("}")).alias("response"),
    ).dropDuplicates(["request_key"])
    answered, _ = annotate.batch(docs, ["text"], count_words, model="counter", cache=known, partitions=8)
    return answered.select("doc_id", "response", "cache_hit")


def stubborn(rows: pd.DataFrame) -> list[str]:
    """Fails the form for one third of the rows; a ninth never gets it right."""
    out = []
    for n, feedback in zip(rows["n_chars"], rows["feedback"], strict=True):
        bad = n % 9 == 0 or (n % 3 == 0 and not feedback)
        out.append('{"analysis": "on and on"}' if bad else json.dumps({"label": "supported"}))
    return out


def _label_rules(responses: DataFrame) -> tuple[DataFrame, DataFrame]:
    label = F.get_json_object("response", "$.label")
    return rules.check(responses, "doc_id", {"label": (~F.coalesce(label, F.lit("")).isin("supported"), "missing label")})


def retried(v: Views):
    docs = v["documents"].select("doc_id", "n_chars")
    return annotate.with_retry(docs, "doc_id", ["doc_id", "n_chars"], stubborn, _label_rules, model="stub")


@query(
    "annotation_attempts",
    """SELECT doc_id, 0 AS attempt, CASE WHEN n_chars % 3 = 0 THEN 'rejected' ELSE 'accepted' END AS status,
    CASE WHEN n_chars % 3 = 0 THEN 'label: missing label' END AS error FROM documents UNION ALL
    SELECT doc_id, 1, CASE WHEN n_chars % 9 = 0 THEN 'rejected' ELSE 'accepted' END, CASE WHEN n_chars % 9 = 0 THEN 'label: missing label' END
    FROM documents WHERE n_chars % 3 = 0""",
)
def annotation_attempts(v: Views):
    return retried(v)[1].select("doc_id", "attempt", "status", "error")


def unasked(rows: pd.DataFrame) -> list[str]:
    raise RuntimeError(f"asked again for {len(rows)} rows")


@query(
    "answers_of_a_second_run",
    """SELECT doc_id, 0 AS attempt, CASE WHEN n_chars % 3 = 0 THEN 'rejected' ELSE 'accepted' END AS status, true AS cache_hit FROM documents UNION ALL
    SELECT doc_id, 1, CASE WHEN n_chars % 9 = 0 THEN 'rejected' ELSE 'accepted' END, true FROM documents WHERE n_chars % 3 = 0""",
)
def answers_of_a_second_run(v: Views):
    """Both attempts of a second run come from the answers that the first run kept; its function would stop the job."""
    cache = annotate.AnswerCache(v.spark, fresh_dir(v.spark, "answers"), buckets=8)
    docs, payload = v["documents"].select("doc_id", "n_chars"), ["doc_id", "n_chars"]
    annotate.with_retry(docs, "doc_id", payload, stubborn, _label_rules, model="stub", cache=cache)
    again = annotate.AnswerCache(v.spark, cache.root, cache.buckets)
    return annotate.with_retry(docs, "doc_id", payload, unasked, _label_rules, model="stub", cache=again)[1].select(
        "doc_id", "attempt", "status", "cache_hit"
    )


@query(
    "annotation_receipts",
    """SELECT doc_id, sha256(text) AS prefix_sha256, length(text) AS input_characters, length(text) > 48000 AS input_clipped, sha256('count') AS instructions_sha256,
    CASE WHEN n_chars % 3 = 0 THEN 2 ELSE 1 END AS attempts, n_chars % 9 <> 0 AS answered FROM documents""",
)
def annotation_receipts(v: Views):
    return annotate.receipts(v["documents"].select("doc_id", "text"), "doc_id", "text", retried(v)[1], "count").drop("request_keys")


@query(
    "technical_unknowns",
    """SELECT doc_id, 'unknown' AS decision_label, 'technical unknown: attempts exhausted, no judgment was obtained' AS decision_rationale,
    true AS technical_unknown FROM documents WHERE n_chars % 9 = 0""",
)
def technical_unknowns(v: Views):
    return annotate.technical_unknowns(retried(v)[2], ["decision"])


def decide_by_length(rows: pd.DataFrame) -> list[str]:
    labels = ("supported", "contradicted", "unknown")
    return [json.dumps({"decision": labels[(len(a) + len(b)) % 3]}) for a, b in zip(rows["prefix_a"], rows["prefix_b"], strict=True)]


def transfer_by_length(rows: pd.DataFrame) -> list[str]:
    labels = ("supported", "contradicted")
    return [
        json.dumps({"local_transfer": labels[len(e) % 2], "full_segment_transfer": labels[len(d) % 2]})
        for e, d in zip(rows["first_episode"], rows["decision_label"], strict=True)
    ]


JUDGED_PAIRS = """SELECT probe_id, CASE (length(a.text) + length(b.text)) % 3 WHEN 0 THEN 'supported' WHEN 1 THEN 'contradicted' ELSE 'unknown' END AS decision_label,
 length(b.text) > 18000 AS local_clipped, 2 * length(b.text) + 1 > 36000 AS full_clipped, least(length(b.text), 18000) AS shown
 FROM probes JOIN documents a ON a.doc_id = left_id JOIN documents b ON b.doc_id = right_id"""


def judged_documents(v: Views):
    left = v["documents"].select(F.col("doc_id").alias("left_id"), F.col("text").alias("prefix_a"))
    right = v["documents"].select(F.col("doc_id").alias("right_id"), F.col("text").alias("prefix_b"))
    pairs = v["probes"].select("probe_id", "left_id", "right_id").join(left, "left_id").join(right, "right_id").select(
        "probe_id", "prefix_a", "prefix_b", F.array("prefix_b", "prefix_b").alias("episodes")
    )
    return annotate.judge_pairs(pairs, decide_by_length, transfer_by_length, model="length")


@query(
    "judged_pairs",
    check_sql(
        """SELECT probe_id, decision_label, local_clipped, full_clipped, l AS local_transfer_label, l AS splice_label,
        CASE WHEN full_clipped AND f = 'supported' THEN 'unknown' ELSE f END AS full_segment_transfer_label FROM (
        SELECT *, CASE WHEN shown % 2 = 0 THEN CASE WHEN local_clipped THEN 'unknown' ELSE 'supported' END ELSE 'contradicted' END AS l,
        CASE WHEN length(decision_label) % 2 = 0 THEN 'supported' ELSE 'contradicted' END AS f FROM j) x""",
        "probes",
        j=JUDGED_PAIRS,
    ),
)
def judged_pairs(v: Views):
    return judged_documents(v)[0]


@query(
    "judgment_overrides",
    check_sql(
        """SELECT probe_id, 'local_transfer' AS claim, 'supported' AS original_label FROM j WHERE local_clipped AND shown % 2 = 0 UNION ALL
        SELECT probe_id, 'full_segment_transfer', 'supported' FROM j WHERE full_clipped AND length(decision_label) % 2 = 0""",
        "probes",
        j=JUDGED_PAIRS,
    ),
)
def judgment_overrides(v: Views):
    return judged_documents(v)[1]


def classify_by_length(rows: pd.DataFrame) -> list[str]:
    return [json.dumps({"state_id": f"S{len(p) % int(c[1:])}"}) for c, p in zip(rows["candidate_id"], rows["prefix"], strict=True)]


@query(
    "classified_histories",
    """SELECT 'c' || k AS candidate_id, doc_id AS history_id, '{"state_id": "S' || (length(text) % k) || '"}' AS response,
    text IN (SELECT text FROM documents WHERE doc_id % 4 = 0) AS cache_hit FROM documents, (SELECT unnest([2, 4, 8]) AS k) c""",
)
def classified_histories(v: Views):
    ids = ["c2", "c4", "c8"]
    histories = v["histories"].select("history_id", "prefix", "step")
    seen, _ = annotate.classify(histories.filter("history_id % 4 = 0"), ids, classify_by_length, model="length")
    payload = histories.select("history_id", "prefix", F.col("step").alias("cutoff_step"))
    cache = seen.join(payload, "history_id").select(
        annotate.request_key(["candidate_id", "prefix", "cutoff_step"], "length").alias("request_key"), "response"
    ).dropDuplicates(["request_key"])
    return annotate.classify(histories, ids, classify_by_length, model="length", cache=cache)[0]


@query(
    "exemplar_sample",
    check_sql(
        """SELECT doc_id, pos, projected FROM (SELECT *, sum(length(projected)) OVER (ORDER BY pos) AS s, row_number() OVER (ORDER BY pos) AS k FROM (
        SELECT doc_id, pos, left(text, 400) AS projected FROM (SELECT *, row_number() OVER (ORDER BY doc_id) - 1 AS pos, count(*) OVER () AS n FROM documents) a
        WHERE n <= 16 OR list_contains(list_transform(range(0, 16), lambda i: CAST(round_even(i * (n - 1) / 15.0E0, 0) AS BIGINT)), pos)) b) c
        WHERE s <= 4000 OR k <= 2""",
    ),
)
def exemplar_sample(v: Views):
    return exemplars.sample(v["documents"], "doc_id", F.substring("text", 1, 400), budget=4000)
