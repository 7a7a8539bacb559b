"""Expected results over documents, retrieval and diagnosis texts."""

from __future__ import annotations

from checks.oracles import SQL, q
from checks.oracles_telemetry import FLAT, LOCATED, PREDICTIONS, TELEMETRY, evidence_part
from wellspring.constants import NOMINAL_BOUNDS, QUERY_PHRASE, STOP_WORDS, TOKEN_PATTERN
from wellspring.operators import diagnosis as d
from wellspring.sources.testtables import SECTION_HEADINGS

NL = "chr(10)"
BLANKS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


def text(value: str) -> str:
    """SQL literal of a text with line breaks."""
    return " || chr(10) || ".join("'" + part.replace("'", "''") + "'" for part in value.split("\n"))


HEADS = "[" + ", ".join(f"'{h}'" for h in SECTION_HEADINGS) + "]"
CHUNKS = f"""
md AS (
  SELECT 'event_' || regexp_extract(source, '([0-9]+)', 1) || '_' || lpad(CAST(doc_id AS VARCHAR), 9, '0') AS stem,
    CAST(regexp_extract(source, '([0-9]+)', 1) AS INTEGER) AS event_id, 'Dossier ' || doc_id AS doc_title,
    '# Dossier ' || doc_id || {NL} || array_to_string(list_transform(string_split(text, {NL}), lambda line, i:
      {NL} || '## ' || ({HEADS})[(i - 1) % 4 + 1] || {NL} ||
      array_to_string(list_transform(string_split(line, '. '), lambda s, n: n || '. ' || s), {NL})), {NL}) AS text
  FROM documents),
parts AS (
  SELECT stem, event_id, doc_title, unnest(p) AS body, generate_subscripts(p, 1) AS n
  FROM (SELECT *, string_split(replace(text, {NL} || '## ', chr(1) || '## '), chr(1)) AS p FROM md)),
chunk AS MATERIALIZED (
  SELECT stem || '_' || n AS chunk_id, stem || '.md' AS doc_name, doc_title, CAST(n AS INTEGER) AS section_no,
    CASE WHEN n = 1 THEN 'Overview' ELSE ({HEADS})[(n - 2) % 4 + 1] END AS section_title, event_id,
    'Document: ' || doc_title || {NL} || 'Section: ' || CASE WHEN n = 1 THEN 'Overview' ELSE ({HEADS})[(n - 2) % 4 + 1] END
      || {NL} || 'Event ID: ' || event_id || {NL} || {NL} || trim(body, {BLANKS}) AS content
  FROM parts)"""
STOP = "(" + ", ".join(f"'{w}'" for w in STOP_WORDS) + ")"


def tokens(source: str) -> str:
    return f"list_filter(regexp_extract_all(lower({source}), '{TOKEN_PATTERN}'), lambda t: t NOT IN {STOP})"


def grams(name: str, key: str, source: str, table: str) -> str:
    """CTE ``name``: occurrences of every gram."""
    return f"""
{name}_t AS (SELECT {key}, {tokens(source)} AS w FROM {table}),
{name} AS MATERIALIZED (
  SELECT {key}, term, count(*) AS tf FROM (
    SELECT {key}, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS term FROM {name}_t)
  GROUP BY ALL)"""


INDEX = CHUNKS + "," + grams("tf", "chunk_id", "content", "chunk") + """,
idf AS MATERIALIZED (
  SELECT term, ln((1 + (SELECT count(*) FROM chunk)) / (1 + count(*))) + 1 AS idf FROM tf GROUP BY term),
post AS MATERIALIZED (
  SELECT chunk_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY chunk_id)) AS weight
  FROM (SELECT chunk_id, term, (1 + ln(tf)) * idf AS w FROM tf JOIN idf USING (term)))"""


def ranked(queries: str, k: int, boost: bool) -> str:
    """CTEs from ``queries`` (query_id, query[, event]) to ``found`` with the best k chunks."""
    score = "coalesce(s.score, 0)"
    if boost:
        score = f"CASE WHEN c.event_id = a.event THEN {score} * 1.5::DOUBLE + 0.3::DOUBLE ELSE {score} END"
    return grams("qtf", "query_id", "query", queries) + f""",
qw AS (SELECT query_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY query_id)) AS weight
       FROM (SELECT query_id, term, (1 + ln(tf)) * idf AS w FROM qtf JOIN idf USING (term))),
dots AS (SELECT query_id, chunk_id, sum(qw.weight * post.weight) AS score FROM qw JOIN post USING (term) GROUP BY ALL),
found AS (
  SELECT a.query_id, c.chunk_id, round({score}, 10) AS score,
    row_number() OVER (PARTITION BY a.query_id ORDER BY round({score}, 10) DESC, c.doc_name, c.section_no) AS rank
  FROM {queries} a CROSS JOIN chunk c LEFT JOIN dots s ON s.query_id = a.query_id AND s.chunk_id = c.chunk_id
  QUALIFY rank <= {k})"""


SQL["document_event_ids"] = f"""WITH {CHUNKS}, n AS (SELECT stem || '.md' AS doc_name, event_id FROM md)
  SELECT * FROM n UNION ALL SELECT replace(doc_name, 'event_', 'note '), -1 FROM n"""
SQL["chunk_sections"] = f"""WITH {CHUNKS} SELECT chunk_id, doc_name, doc_title, section_no, section_title, event_id,
  md5(content) AS content FROM chunk"""
SQL["tfidf_vocabulary"] = f"WITH {INDEX} SELECT term, round(idf, 8) AS idf FROM idf"
SQL["tfidf_vectors"] = f"WITH {INDEX} SELECT chunk_id, term, round(weight, 8) AS weight FROM post"
SQL["extended_index"] = SQL["tfidf_vectors"]
SQL["free_query"] = f"""WITH {INDEX}, asked AS (SELECT item_id AS query_id, text AS query FROM benchmark),
{ranked('asked', 3, False)} SELECT query_id, CAST(rank AS INTEGER) AS rank, chunk_id, round(score, 6) AS score FROM found"""
SQL["boosted_search"] = f"""WITH {INDEX}, asked AS (SELECT item_id AS query_id, text AS query, item_id % 10 AS event FROM benchmark),
{ranked('asked', 4, True)} SELECT query_id, CAST(rank AS INTEGER) AS rank, chunk_id, round(score, 6) AS score FROM found"""

EVIDENCE = " UNION ALL ".join(
    f"SELECT {i} AS n, * FROM ({evidence_part(*bound)})" for i, bound in enumerate(NOMINAL_BOUNDS))
REPORT_LINE = (f"'- Sensor: ' || sensor || {NL} || '  Observed Value: ' || observed_value || {NL} || '  Expected Behavior: ' || "
               f"expected_behavior || {NL} || '  Significance: ' || significance")
PROMPT_LINE = ("'- Sensor: ' || sensor || ' | Observed: ' || observed_value || ' | Expected: ' || expected_behavior "
               "|| ' | Significance: ' || significance")
INCIDENTS = TELEMETRY + f""",
evi AS ({EVIDENCE}),
shown AS MATERIALIZED (
  SELECT id, string_agg(sensor || ' ' || status || ' ' || significance, ' ' ORDER BY n) AS symptoms,
    string_agg({REPORT_LINE}, {NL} ORDER BY n) AS report, string_agg({PROMPT_LINE}, {NL} ORDER BY n) AS prompt
  FROM evi GROUP BY id),
inc AS MATERIALIZED (
  SELECT tel.id, device_id AS well_id, CASE fault WHEN 'Severe Slugging' THEN 3 ELSE 4 END AS event, fault,
    round_even("T-JUS-CKGL" / 100, 4) AS confidence, symptoms,
    coalesce(report, {text(d.NO_EVIDENCE_REPORT)}) AS report, coalesce(prompt, {text(d.NO_EVIDENCE_PROMPT)}) AS prompt
  FROM tel LEFT JOIN shown USING (id) WHERE fault IS NOT NULL),
inq AS MATERIALIZED (
  SELECT id, event, 'Event ' || event || ': ' || fault || ' {QUERY_PHRASE}' || coalesce(' ' || symptoms, '') AS query FROM inc)"""
SQL["retrieval_queries"] = f"WITH {INCIDENTS} SELECT id, query FROM inq"
GROUPED = f"""{INDEX}, {INCIDENTS}, {grams('itf', 'id', 'query', 'inq')},
bags AS MATERIALIZED (
  SELECT inq.id, any_value(event) || ' ' || coalesce(string_agg(term || '=' || tf, '|' ORDER BY term) FILTER (idf.term IS NOT NULL), '') AS bag
  FROM inq LEFT JOIN itf USING (id) LEFT JOIN idf USING (term) GROUP BY inq.id),
asked AS MATERIALIZED (
  SELECT min(id) AS query_id, arg_min(query, id) AS query, arg_min(event, id) AS event, bag
  FROM inq JOIN bags USING (id) GROUP BY bag),
{ranked('asked', 3, True)},
hit AS MATERIALIZED (
  SELECT bags.id, found.rank, found.chunk_id, found.score
  FROM bags JOIN asked USING (bag) JOIN found ON found.query_id = asked.query_id)"""
SQL["retrieve_fault_knowledge"] = f"""WITH {GROUPED}
  SELECT id, CAST(rank AS INTEGER) AS rank, chunk_id, round(score, 6) AS score FROM hit"""

LINES = f"list_transform(string_split(content, {NL}), lambda x: trim(x, {BLANKS}))"
SECTIONS = f"""
lined AS (SELECT chunk_id, content, {LINES} AS s FROM chunk),
sections AS MATERIALIZED (
  SELECT chunk_id,
    CASE WHEN contains(content, 'Root Causes') THEN list_filter(s, lambda x: regexp_matches(x, '^[123]\\.'))[1:3] END AS causes,
    CASE WHEN contains(content, 'Operator Actions') THEN
      list_transform(list_filter(s, lambda x: regexp_matches(x, '^([123]\\.|-)'))[1:3], lambda x: ltrim(x, '- ')) END AS checks,
    CASE WHEN contains(content, 'Safety Considerations') THEN
      list_transform(list_filter(string_split(content, {NL}), lambda x: length(trim(x, {BLANKS})) > 30 AND NOT starts_with(x, '#'))[1:2],
                     lambda x: trim(x, {BLANKS})) END AS safe
  FROM lined),
offer AS MATERIALIZED (
  SELECT chunk_id, CASE WHEN len(causes) > 0 THEN causes END AS causes, CASE WHEN len(checks) > 0 THEN checks END AS checks,
    CASE WHEN len(safe) > 0 THEN array_to_string(safe, ' ') END AS safety FROM sections)"""
SQL["knowledge_sections"] = f"""WITH {CHUNKS}, {SECTIONS} SELECT chunk_id, md5(array_to_string(causes, '|')) AS causes,
  md5(array_to_string(checks, '|')) AS checks, md5(safety) AS safety FROM offer"""


def three(name: str, defaults: list[str], missing: list[str]) -> str:
    default = "[" + ", ".join(text(x) for x in defaults) + "]"
    return f" || {NL} || ".join(
        f"'{i}. ' || coalesce((coalesce({name}, {default}))[{i}], {text(missing[i - 1])})" for i in (1, 2, 3))


PERCENT = "printf('%.1f', round_even(confidence * 100, 1)) || '%'"
BAND = "CASE WHEN confidence >= 0.8 THEN 'High' WHEN confidence >= 0.65 THEN 'Moderate' ELSE 'Low / Uncertain' END"


def heading(title: str) -> str:
    return text(f"{title}\n{d.RULER}\n")


GAP = f" || {NL} || {NL} || "
REPORT = GAP.join([
    f"{heading('FAULT DETECTION')} || {text('Status: ANOMALY' + chr(10) + 'Detected Event: ')} || fault || {text(chr(10) + 'Confidence: ')} || {PERCENT} || ' (' || {BAND} || ')'",
    f"{heading('SENSOR EVIDENCE')} || report",
    f"{heading('POSSIBLE CAUSES')} || {three('causes', d.DEFAULT_CAUSES, d.MISSING_CAUSES)}",
    f"{heading('RECOMMENDED CHECKS')} || {three('checks', d.DEFAULT_CHECKS, d.MISSING_CHECKS)}",
    f"{heading('SAFETY NOTE')} || coalesce(safety, {text(d.DEFAULT_SAFETY)})",
    f"{heading('KNOWLEDGE SOURCES')} || unique_sources || {NL}",
])
PROMPT = GAP.join([
    "'Generate a structured fault diagnosis report for offshore well ' || well_id || ' based on the following telemetry analysis and technical documentation:'",
    f"""{text('=== ML MODEL PREDICTION ===' + chr(10) + 'Primary Status: ANOMALY (FAULT)' + chr(10) + 'Detected Event: ')} || fault ||
      {text(chr(10) + 'Confidence: ')} || {PERCENT} || ' (' || printf('%.4f', round_even(confidence, 4)) || ')' ||
      CASE WHEN confidence < 0.65 THEN {text(d.LOW_CONFIDENCE_WARNING)} ELSE '' END""",
    f"{text('=== SENSOR TELEMETRY EVIDENCE (60-SECOND WINDOW) ===' + chr(10))} || prompt",
    f"{text('=== RETRIEVED DOMAIN KNOWLEDGE (RAG) ===' + chr(10))} || excerpts",
    text("=== INSTRUCTIONS ===\nProduce the response adhering EXACTLY to the following structure and section headings:"),
    f"{heading('FAULT DETECTION')} || {text('Status: ANOMALY' + chr(10) + 'Detected Event: ')} || fault || {text(chr(10) + 'Confidence: ')} || {PERCENT} || ' (' || {BAND} || ')'",
    *[f"{heading(title)} || {text(body)}" for title, body in d.SECTION_PLACEHOLDERS],
    f"{heading('KNOWLEDGE SOURCES')} || cited || {NL}",
])
SQL["diagnosis_reports"] = f"""WITH {GROUPED}, {SECTIONS},
know AS (
  SELECT id, arg_max(causes, rank) FILTER (causes IS NOT NULL) AS causes, arg_max(checks, rank) FILTER (checks IS NOT NULL) AS checks,
    arg_max(safety, rank) FILTER (safety IS NOT NULL) AS safety, string_agg(doc_title, ', ' ORDER BY rank) AS sources,
    array_to_string(list_sort(list_distinct(list(doc_title))), ', ') AS unique_sources,
    array_to_string(list_sort(list_distinct(list(doc_title || ' (' || section_title || ')'))), ', ') AS cited,
    string_agg('--- KNOWLEDGE EXCERPT ' || rank || ' [' || doc_title || ' / ' || section_title || '] ---' || {NL}
      || trim(content, {BLANKS}) || {NL}, {NL} ORDER BY rank) AS excerpts
  FROM hit JOIN chunk USING (chunk_id) JOIN offer USING (chunk_id) GROUP BY id)
SELECT id, md5({REPORT}) AS raw_diagnosis, md5({PROMPT}) AS prompt, sources FROM inc JOIN know USING (id)"""
SQL["confidence_bands"] = f"""WITH {PREDICTIONS}, c AS (SELECT event_id, multi_confidence AS confidence FROM pred)
  SELECT event_id, {BAND} AS band, {PERCENT} AS shown FROM c"""
SQL["evidence_texts"] = f"""WITH {INCIDENTS} SELECT tel.id, coalesce(report, {text(d.NO_EVIDENCE_REPORT)}) AS report,
  coalesce(prompt, {text(d.NO_EVIDENCE_PROMPT)}) AS prompt FROM tel LEFT JOIN shown USING (id)"""


def long_heading(title: str) -> str:
    return text(f"{title}\n{d.LONG_RULER}\n")


def numbered(title: str) -> str:
    return f"'{title} (ID #' || id || ')' || {NL} || '{d.LONG_RULER}' || {NL}"


ACTIONS = "\n".join(f"{i}. {a}" for i, a in enumerate(d.DOSSIER_ACTIONS, 1))
MITIGATIONS = "\n".join(f"{i}. {a}" for i, a in enumerate(d.SNAPSHOT_ACTIONS, 1))
FALLBACK = GAP.join([
    f"""{numbered('FAULT ANALYSIS & ENGINEERING SUMMARY')} || 'Asset: ' || device_id || ' | Detected Event: '
      || fault || ' | Status: FAULT CONFIRMED' || {NL} || 'Confidence: ' || printf('%.1f', round_even(confidence_pct, 1)) || '%'""",
    f"""{long_heading('SENSOR EVIDENCE & LOCALIZATION')} || '- Abnormal Telemetry Channels: ' || coalesce(nullif(sensors, ''), '{d.DRIFT_CHANNELS}')
      || {NL} || '- Associated Measurement Region: ' || location""",
    long_heading("RECOMMENDED OPERATOR ACTIONS (SOP VERIFIED)") + " || " + text(ACTIONS),
    long_heading("SAFETY NOTICE") + " || " + text(d.DOSSIER_SAFETY),
])
SQL["fallback_dossiers"] = f"""WITH {LOCATED} SELECT id, coalesce(diagnosis, {FALLBACK}) AS dossier
  FROM located JOIN flat USING (id)"""
SNAPSHOT = f" || {NL} || ".join(
    f"'- {s}: ' || coalesce(CAST(round_even({q(s)}{' / 1000' if s == 'P-ANULAR' else ''}, 2) AS VARCHAR), 'nan') || {text(' ' + unit)}" for s, unit in d.SNAPSHOT_LINES)
SQL["snapshot_dossiers"] = f"""WITH {FLAT} SELECT id, coalesce(diagnosis, """ + GAP.join([
    f"{numbered('FAULT DETECTION & LOCALIZATION REPORT')} || 'Asset: ' || device_id || {NL} || 'Detected Event: ' || fault",
    f"{long_heading('OBSERVED SENSOR TELEMETRY SNAPSHOT')} || {SNAPSHOT}",
    f"{long_heading('ENGINEERING MITIGATION ACTIONS (RAG DOMAIN KNOWLEDGE)')} || {text(MITIGATIONS)}",
]) + ") AS dossier FROM flat WHERE fault IS NOT NULL"
SQL["dense_topk"] = """WITH e AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings),
m AS (SELECT label, i, avg(x) AS q FROM e GROUP BY ALL),
qn AS (SELECT label, sqrt(sum(q * q)) AS n FROM m GROUP BY label), vn AS (SELECT vec_id, sqrt(sum(x * x)) AS n FROM e GROUP BY vec_id),
dots AS (SELECT m.label AS query_id, e.vec_id, any_value(e.label) AS label, sum(m.q * e.x) AS dot FROM m JOIN e USING (i) GROUP BY ALL),
s AS (SELECT query_id, dots.vec_id, dot / qn.n / vn.n AS c, dots.label FROM dots JOIN qn ON qn.label = query_id JOIN vn USING (vec_id)),
b AS (SELECT query_id, vec_id, round(CASE WHEN label = query_id THEN c * 1.5::DOUBLE + 0.3::DOUBLE ELSE c END, 8) AS score FROM s)
SELECT query_id, vec_id, round(score, 4) AS score,
  CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM b QUALIFY rank <= 4"""
