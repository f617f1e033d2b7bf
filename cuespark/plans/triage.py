"""Queries over responses and enrichment."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as texts
from ..functions import voices
from ..operators import enrich, responses
from ..operators.segments import coerce_segments
from ..session import stage
from .carriers import DEPENDS, VIEWS, oracle, table, v_segments
from .registry import gate
from .scalars import PROSODY_SQL, squeeze_sql, tone_sql

# One expression text for both engines: plain, fenced, broken and wrapped records, empty and failed answers.
PLAIN = "translate(text, chr(34) || chr(92) || chr(10) || chr(13), '    ')"
REC1 = "'{\"id\": 1, \"start_time\": \"0:01\", \"end_time\": \"0:04.5\", \"text\": \"' || p || '\"}'"
REC2 = "'{\"id\": 2, \"start_time\": \"0:05\", \"text\": \"again ' || p || '\"}'"
TEXT = f"""CASE kind
    WHEN 0 THEN 'Here it is:' || chr(10) || '```json' || chr(10) || '[' || {REC1} || ', ' || {REC2} || ']' || chr(10) || '```' || chr(10) || 'Done.'
    WHEN 1 THEN 'Note [draft]: [' || {REC1} || ', ' || {REC2} || ']'
    WHEN 2 THEN CASE WHEN conv_id % 2 = 0 THEN '```json' || chr(10) ELSE '' END || '[' || {REC1} || ', ' || {REC2} || ', {{"id": 3, "te'
    WHEN 3 THEN '[{{“id”: 1, “text”: “' || p || '”}},]'
    WHEN 4 THEN '{{"ok": true, "segments": [' || {REC1} || ']}}'
    WHEN 5 THEN ''
    WHEN 6 THEN 'Something went wrong. ' || p
    WHEN 7 THEN p
    WHEN 8 THEN '<div _ngcontent-abc><span>' || p || '</span></div>'
    WHEN 9 THEN 'Please sign in to see this ' || p
    WHEN 10 THEN 'You have reached your limit ' || p
    WHEN 11 THEN 'I cannot fulfill this request. ' || p
    WHEN 12 THEN 'Network error, check your connection ' || p
    WHEN 13 THEN '[' || {REC1} || ', ' || {REC2} || ']'
    END"""
CONV_COLUMNS = (
    "concat('c', conv_id, '-', turn) AS resp_id", "conv_id AS request_id", "turn + 1 AS attempt", "kind", f"{TEXT} AS text", "CAST(NULL AS STRING) AS page_url",
    "kind <> 12 OR turn % 2 = 0 AS online", "kind IN (5, 7) AND conv_id % 2 = 1 AS timed_out", "CASE WHEN kind = 5 THEN turn % 2 ELSE 1 END AS response_count")
PAGE_COLUMNS = (
    "concat('p', page_id) AS resp_id", "1000000 + page_id AS request_id", "CAST(1 AS BIGINT) AS attempt", "CAST(100 AS BIGINT) AS kind", "html AS text",
    "CASE WHEN page_id % 9 = 0 THEN 'https://accounts.google.com/x' ELSE url END AS page_url", "true AS online", "false AS timed_out", "CAST(1 AS BIGINT) AS response_count")
CONV_BASE = ("conv_id", "turn", "(conv_id * 3 + turn * 5) % 14 AS kind", f"{PLAIN} AS p")
VIEWS["answers"] = (f"SELECT {', '.join(CONV_COLUMNS)} FROM (SELECT {', '.join(CONV_BASE)} FROM conversations) UNION ALL SELECT {', '.join(PAGE_COLUMNS)} FROM pages")


def answers(spark, d):
    talk = table(spark, d, "conversations").selectExpr(*CONV_BASE).selectExpr(*CONV_COLUMNS)
    return talk.unionByName(table(spark, d, "pages").selectExpr(*PAGE_COLUMNS))


# what the built texts must yield
VIEWS["expected"] = f"""SELECT resp_id, kind, n AS record_no, CASE WHEN kind = 0 THEN 'fence' WHEN kind = 2 THEN 'salvaged' WHEN kind = 3 THEN 'raw+repaired' ELSE 'raw' END AS method, kind = 2 AS partial,
    CAST(n + 1 AS VARCHAR) AS id, CASE WHEN n = 0 THEN p ELSE 'again ' || p END AS text
    FROM (SELECT *, CAST(unnest(range(CASE WHEN kind IN (3, 4) THEN 1 ELSE 2 END)) AS INTEGER) AS n FROM (SELECT concat('c', conv_id, '-', turn) AS resp_id, (conv_id * 3 + turn * 5) % 14 AS kind, {PLAIN} AS p FROM conversations) WHERE kind IN (0, 1, 2, 3, 4, 13))"""
TAGS_SQL = r"list_transform(regexp_extract_all({t}, '</?([a-zA-Z][\p{{L}}\p{{N}}_:-]*)(?:\s[^<>]*)?/?>', 1), lambda x: lower(x))"


def found_sql(low: str, markers) -> str:
    listed = ", ".join("'" + m.replace("'", "''") + "'" for m in markers)
    return f"list_filter([{listed}], lambda m: contains({low}, m))"


VIEWS["ev"] = f"""SELECT *, is_document OR tag_count >= 4 OR (len(dom) > 0 AND tag_count >= 1) OR (tag_count >= 1 AND regexp_full_match(text, '\\s*<(?s:.*)>\\s*')) AS is_html FROM (
    SELECT *, len(tags) AS tag_count, {found_sql('lower(text)', responses.DOM_MARKERS)} AS dom, {found_sql('lower(text)', responses.ERROR_MARKERS)} AS err,
      regexp_matches(substr(ltrim(lower(text), chr(32) || chr(10) || chr(13) || chr(9)), 1, 200), '^(<!doctype html|<html|<\\?xml)') OR (contains(substr(lower(text), 1, 2000), '<html') AND contains(lower(text), '</html>')) AS is_document
    FROM (SELECT *, {TAGS_SQL.format(t='text')} AS tags FROM answers))"""
PHRASE_ARMS = " ".join(f"WHEN length(text) < 1200 AND len({found_sql('lower(text)', p)}) > 0 THEN '{k}'" for k, p in responses.PHRASES)
VIEWS["kinds"] = f"""SELECT resp_id, request_id, attempt, text, page_url, CASE kind WHEN 3 THEN 1 WHEN 4 THEN 1 WHEN 0 THEN 2 WHEN 1 THEN 2 WHEN 2 THEN 2 WHEN 13 THEN 2 ELSE 0 END AS n_records, dom, err, tags,
    CASE WHEN kind IN (0, 1, 3, 4, 13) THEN 'json_ok' WHEN contains(coalesce(page_url, ''), 'accounts.google.com') OR contains(coalesce(page_url, ''), '/signin') THEN 'login_required' WHEN NOT online THEN 'network'
      WHEN trim(text) = '' THEN CASE WHEN response_count = 0 THEN 'no_response_element' WHEN timed_out THEN 'network' ELSE 'empty' END
      WHEN is_html AND len(err) > 0 THEN 'html_error_page' WHEN is_html AND len(dom) > 0 THEN 'html_dom_markup' WHEN is_html AND is_document THEN 'html_page' WHEN is_html THEN 'html_dom_markup'
      {PHRASE_ARMS} WHEN kind = 2 THEN 'truncated_json' WHEN timed_out THEN 'network' ELSE 'prose' END AS kind FROM ev"""
VIEWS["top_tags"] = """SELECT resp_id, string_agg(tag, ' ' ORDER BY r) AS top FROM (SELECT *, row_number() OVER (PARTITION BY resp_id ORDER BY n DESC, tag) AS r FROM (
    SELECT resp_id, tag, count(*) AS n FROM (SELECT resp_id, unnest(tags) AS tag FROM ev) GROUP BY ALL)) WHERE r <= 6 GROUP BY resp_id"""
DEPENDS.update({"ev": ["answers"], "kinds": ["ev"], "top_tags": ["ev"]})
RETRY_SQL = "kind IN ('network', 'empty', 'html_error_page', 'server_error', 'refused', 'truncated_json', 'prose')"


ADVICE_SQL = """(VALUES ('json_ok', 'The answer holds its records.', ''), ('login_required', 'The page asks for a sign-in.', 'Sign in, then send the request again.'),
    ('network', 'The connection failed or timed out.', 'Check the connection; the request is sent again.'), ('no_response_element', 'The page shows no answer.', 'The page may have changed; look at it.'),
    ('empty', 'The answer is empty.', 'The request is sent again.'), ('html_error_page', 'An error page came instead of an answer.', 'The request is sent again later.'),
    ('html_dom_markup', 'The answer is markup of the page itself.', 'Read the text of the answer, not its markup.'), ('html_page', 'A whole page came instead of an answer.', 'Check the address that is asked.'),
    ('blocked', 'The service refuses more requests for now.', 'Wait, or lower the rate of requests.'), ('server_error', 'The service reports an error.', 'The request is sent again.'),
    ('refused', 'The model refuses the request.', 'Change the request.'), ('truncated_json', 'The answer breaks off; its first records are usable.', 'Ask for fewer records at a time.'),
    ('prose', 'The answer is text without records.', 'Ask again for records only.')) AS advice(kind, message, hint)"""


def extracted(spark, d):
    return responses.extract_payloads(answers(spark, d).drop("kind"))


def field(name):
    return F.get_json_object("record", f"$.{name}").alias(name)


@gate("payload_extract", oracle("expected", "SELECT resp_id, record_no, method, partial, id, text FROM expected WHERE NOT partial"))
def payload_extract(spark, d):
    rows = responses.payload_rows(extracted(spark, d)).filter(~F.col("partial"))
    return rows.select("resp_id", "record_no", "method", "partial", field("id"), field("text"))


@gate("payload_salvage", oracle("expected", "SELECT resp_id, record_no, method, partial, id, text FROM expected WHERE partial"))
def payload_salvage(spark, d):
    rows = responses.payload_rows(extracted(spark, d)).filter("partial")
    return rows.select("resp_id", "record_no", "method", "partial", field("id"), field("text"))


@gate("html_evidence", oracle("ev top_tags", """
SELECT resp_id, is_html, is_document, CAST(tag_count AS INTEGER) AS tag_count, array_to_string(dom, ' ') AS dom_markers, array_to_string(err, ' ') AS error_markers, coalesce(top, '') AS top_tags FROM ev LEFT JOIN top_tags USING (resp_id)"""))
def html_evidence(spark, d):
    e = responses.html_evidence(answers(spark, d))
    return e.select("resp_id", "is_html", "is_document", "tag_count", *[F.array_join(c, " ").alias(c) for c in ("dom_markers", "error_markers", "top_tags")])


@gate("response_classify", oracle("kinds top_tags", f"""
SELECT resp_id, kind, {RETRY_SQL} AS retryable, CASE WHEN kind = 'json_ok' THEN NULL WHEN kind = 'login_required' THEN 'auth' WHEN kind = 'blocked' THEN 'blocked'
    WHEN kind IN ('html_dom_markup', 'html_page', 'no_response_element') THEN 'dom' WHEN kind IN ('html_error_page', 'network', 'server_error') THEN 'network' ELSE 'format' END AS error_class,
    CASE WHEN kind = 'json_ok' THEN '' WHEN kind IN ('empty', 'no_response_element') OR (kind = 'network' AND trim(text) = '') THEN 'length: ' || length(text) WHEN kind = 'login_required' AND page_url IS NOT NULL THEN substr(page_url, 1, 120) WHEN kind = 'html_error_page' THEN array_to_string(list_append(err[1:5], 'tags: ' || len(tags) || ' ' || coalesce(top, '')), '; ')
      WHEN kind IN ('html_dom_markup', 'html_page') THEN array_to_string(list_append(dom[1:5], 'tags: ' || len(tags) || ' ' || coalesce(top, '')), '; ') WHEN kind = 'truncated_json' THEN substr({squeeze_sql('right(text, 120)')}, 1, 160)
      ELSE substr({squeeze_sql('text')}, 1, 160) END AS evidence, message, hint FROM kinds LEFT JOIN top_tags USING (resp_id) JOIN {ADVICE_SQL} USING (kind)"""))
def response_classify(spark, d):
    c = responses.classify(extracted(spark, d))
    return c.select("resp_id", "kind", "retryable", "error_class", F.array_join("evidence", "; ").alias("evidence"), "message", "hint")


@gate("response_kinds", oracle("kinds", "SELECT kind, count(*) AS responses FROM kinds GROUP BY kind"))
def response_kinds(spark, d):
    return responses.classify(extracted(spark, d)).groupBy("kind").agg(F.count("*").alias("responses"))


def attempts(spark, d):
    c = responses.classify(extracted(spark, d))
    return c.select("request_id", "attempt", "kind", "retryable", F.coalesce(F.size("records"), F.lit(0)).alias("n_records"))


def resolve_sql(mode: str) -> str:
    stop = f"kind = 'json_ok' OR NOT ({RETRY_SQL})" if mode == "web" else "kind = 'json_ok'"
    best = "n_records DESC, attempt" if mode == "web" else "attempt DESC"
    return f"""SELECT request_id, CASE WHEN kind = 'json_ok' AND stopped THEN 'success' WHEN stopped THEN 'error' WHEN kind = 'truncated_json' THEN 'partial' ELSE 'error' END AS outcome, attempt, kind, n_records FROM (
      SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY grade, CASE WHEN grade = 0 THEN attempt END, {', '.join('CASE WHEN grade = 1 THEN ' + b.replace(' DESC', '') + ' END' + (' DESC' if 'DESC' in b else '') for b in best.split(', '))}, attempt DESC) AS r FROM (
        SELECT *, {stop} AS stopped, CASE WHEN {stop} THEN 0 WHEN kind = 'truncated_json' THEN 1 ELSE 2 END AS grade FROM kinds WHERE attempt <= 4)) WHERE r = 1"""


@gate("attempt_resolve", oracle("kinds", resolve_sql("web")))
def attempt_resolve(spark, d):
    return responses.resolve_attempts(attempts(spark, d), cap=4, mode="web")


@gate("attempt_resolve_api", oracle("kinds", resolve_sql("api")))
def attempt_resolve_api(spark, d):
    return responses.resolve_attempts(attempts(spark, d), cap=4, mode="api")


@gate("quarantine_split", oracle("expected kinds", f"""
SELECT resp_id, record_no, CASE WHEN kind = 3 OR record_no = 1 THEN 'bad time' WHEN {squeeze_sql("regexp_replace(text, '[*_`#>~]+', '', 'g')")} = '' THEN 'empty text' END AS reason FROM expected
UNION ALL SELECT resp_id, NULL, kind FROM kinds WHERE kind NOT IN ('json_ok', 'truncated_json')"""))
def quarantine_split(spark, d):
    """Accepted records have no reason; rejected records and unusable responses carry theirs."""
    c = stage(responses.classify(extracted(spark, d)))
    rows = responses.payload_rows(c.filter(F.col("kind").isin("json_ok", "truncated_json"))).withColumnRenamed("record", "raw")
    records = coerce_segments(rows).select("resp_id", "record_no", "reason")
    unusable = c.filter(~F.col("kind").isin("json_ok", "truncated_json")).select("resp_id", F.lit(None).cast("int").alias("record_no"), F.col("kind").alias("reason"))
    return records.unionByName(unusable)


@gate("payload_udtf", oracle("expected", "SELECT resp_id, record_no, method, partial, id, text FROM expected"))
def payload_udtf(spark, d):
    enrich.register_payload(spark)
    rows = spark.sql("SELECT a.resp_id, p.* FROM {a} a, LATERAL payload(a.text) p", a=answers(spark, d))
    return rows.select("resp_id", "record_no", "method", "partial", field("id"), field("text"))


SPOKEN_SQL = squeeze_sql("regexp_replace(text, '[*_`#<>~]+', '', 'g')")


@gate("enrich_with_engine", oracle("v_segments", f"""
SELECT content_key, (280 * greatest(1, len(string_split(any_value(spoken), ' '))) + 270) / 1000::DOUBLE AS duration_sec, 'ok' AS status, CAST(NULL AS VARCHAR) AS error FROM (
  SELECT {SPOKEN_SQL} AS spoken, md5(concat_ws('|', {SPOKEN_SQL}, 'vi-VN-HoaiMyNeural', 'offline_speech', rate || pitch || volume)) AS content_key, certainty
  FROM (SELECT *, {tone_sql('tone')} AS tone_name FROM v_segments) JOIN {PROSODY_SQL} USING (tone_name)) GROUP BY content_key HAVING NOT bool_or(certainty = 'observed_fact')"""))
def enrich_with_engine(spark, d):
    """Lines that state observed facts are in the cache already; the rest is sent, each distinct request once."""
    rate, pitch, volume = voices.prosody(F.col("tone_name"))
    spoken = texts.clean_speech_text(F.col("text"))
    key = texts.content_key(spoken, F.lit("vi-VN-HoaiMyNeural"), F.lit("offline_speech"), F.concat(rate, pitch, volume))
    asked = v_segments(spark, d).withColumn("tone_name", texts.normalize_tone(F.col("tone"))).select("certainty", key.alias("content_key"), spoken.alias("spoken"))
    cache = asked.filter(F.col("certainty") == "observed_fact").select("content_key", F.lit("ok").alias("status"))
    return enrich.enrich_with_engine(asked, "offline_speech", cache)
