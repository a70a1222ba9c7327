"""The SQL twin of every registered query, for an independent engine over the same tables.

The texts are written for clarity, not speed: nested loops, correlated
subqueries and recursion where the operators use joins on derived keys.
"""

from __future__ import annotations

from . import fixture as fx

AT = "2024-01-15 10:30:00"
AT_SECONDS = 1705314600
AUTHOR = "A. Writer <writer@example.com>"

NL = "chr(10)"
WS = " || ".join(
    f"chr({n})"
    for n in [9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
)
LIST_ORDER = (
    "CASE state WHEN 'IN_PROGRESS' THEN 0 WHEN 'NEW' THEN 1 ELSE 2 END, "
    "CASE priority WHEN 'high' THEN 0 WHEN 'medium' THEN 1 WHEN 'low' THEN 2 END NULLS FIRST, created DESC, id"
)
NEWEST = "created DESC, id"
CHILD_ORDER = "priority DESC NULLS LAST, created, id"


def stamp(name: str) -> str:
    return f"strftime({name}, '%Y-%m-%d %H:%M:%S')"


SHOWN = (
    f"id, parent, priority, state, kind, title, description, author, {stamp('created')} AS created, "
    f"{stamp('updated')} AS updated, source, blocked_by, tags"
)


def with_tables(body: str, recursive: bool = False, **texts: str) -> str:
    """The query with `tasks` and any other derived table put in front."""
    tables = {"tasks": fx.TASKS, **texts}
    parts = ", ".join(f"{name} AS ({fx.plain(text)})" for name, text in tables.items())
    return f"WITH {'RECURSIVE ' if recursive else ''}{parts} {body}"


def listed(where: str, order: str = LIST_ORDER, limit: int | None = None) -> str:
    cut = f"WHERE rank <= {limit}" if limit else ""
    return with_tables(
        f"SELECT {SHOWN}, rank FROM (SELECT *, row_number() OVER (ORDER BY {order}) AS rank FROM tasks WHERE {where}) {cut}"
    )


ICON = (
    "CASE state WHEN 'INBOX' THEN '?' WHEN 'NEW' THEN '◆' WHEN 'IN_PROGRESS' THEN '▶' WHEN 'DONE' THEN '✓' "
    "WHEN 'CANCELLED' THEN '✗' WHEN 'INVALID' THEN '⊘' ELSE '·' END"
)
EXPORT_ICON = (
    "CASE state WHEN 'NEW' THEN '◆' WHEN 'IN_PROGRESS' THEN '▶' WHEN 'DONE' THEN '✓' WHEN 'CANCELLED' THEN '✗' ELSE '?' END"
)
MARK = "CASE priority WHEN 'high' THEN '!' WHEN 'medium' THEN '=' WHEN 'low' THEN '-' ELSE '.' END"
KIND_LABEL = "CASE kind WHEN 'BUG' THEN 'Bug' WHEN 'FEATURE' THEN 'Feature' WHEN 'REGRESSION' THEN 'Regression' ELSE kind END"
MAIL_DATE = "strftime(created, '%a, %d %b %Y %H:%M:%S') || ' +0000'"
HEADLINE = "lower(kind) || '(' || priority || '): ' || title"
ONELINE = (
    f"substr(id, 1, 7) || ' ' || {ICON} || ' ' || {HEADLINE} || CASE WHEN blocked_by IS NOT NULL THEN ' [BLOCKED]' ELSE '' END"
)
TAG_ARRAY = f"list_filter(list_transform(string_split(tags, ','), lambda x: trim(x, {WS})), lambda x: x <> '')"
TAG_MARKS = (
    f"CASE WHEN tags = '' THEN '' ELSE array_to_string(list_transform(string_split(tags, ','), lambda x: '#' || trim(x, {WS})), ' ') END"
)
COMPACT = (
    f"substr(id, 1, 7) || ' ' || {EXPORT_ICON} || ' ' || {HEADLINE} || CASE WHEN tags <> '' THEN ' ' || {TAG_MARKS} ELSE '' END "
    "|| CASE WHEN blocked_by IS NOT NULL THEN ' ⊘' ELSE '' END"
)


def logstyle(done: str = "done", total: str = "total") -> str:
    return (
        f"'task ' || id || {NL} || 'Author: ' || author || {NL} || 'Date:   ' || {MAIL_DATE} || {NL} "
        f"|| CASE WHEN parent IS NOT NULL THEN 'Parent: ' || parent || {NL} ELSE '' END || {NL} || '  ' || {ICON} || ' ' || {HEADLINE} "
        f"|| CASE WHEN {total} > 0 THEN ' [' || {done} || '/' || {total} || ']' ELSE '' END || {NL} "
        f"|| CASE WHEN description <> '' THEN '    ' || replace(description, {NL}, {NL} || '    ') || {NL} ELSE '' END "
        f"|| CASE WHEN source <> '' OR blocked_by IS NOT NULL OR tags <> '' THEN {NL} ELSE '' END "
        f"|| CASE WHEN source <> '' THEN '    Source: ' || source || {NL} ELSE '' END "
        f"|| CASE WHEN blocked_by IS NOT NULL THEN '    Blocked-by: ' || substr(blocked_by, 1, 7) || {NL} ELSE '' END "
        f"|| CASE WHEN tags <> '' THEN '    Tags: ' || tags || {NL} ELSE '' END"
    )


SUB_LEFT = f"substr(id, 1, 7) || ' ' || {ICON} || ' - ' || title"
SUB_RIGHT = "lower(kind) || ', ' || priority || CASE WHEN blocked_by IS NOT NULL THEN ', blocked' ELSE '' END"
SUBTASK_LINE = (
    f"{SUB_LEFT} || repeat(' ', greatest(2, 80 - strlen({SUB_LEFT}) - strlen({SUB_RIGHT}) - 3)::INTEGER) || '| ' || {SUB_RIGHT}"
)
MARKDOWN_CELLS = (
    "'| ' || no || ' | ' || kind || ' | ' || state || ' | ' || priority || ' | ' || title || ' | ' "
    "|| CASE WHEN tags <> '' THEN tags ELSE '-' END || ' | ' || CASE WHEN source <> '' THEN source ELSE '-' END || ' | ' "
    "|| coalesce('#' || substr(parent, 1, 7), '-') || ' | ' || coalesce('#' || substr(blocked_by, 1, 7), '-') || ' |'"
)
MARKDOWN_SECTION = (
    f"'### #' || id || ': ' || title || {NL} || {NL} || CASE WHEN description <> '' THEN description || {NL} || {NL} ELSE '' END "
    f"|| '- **Type:** ' || {KIND_LABEL} || {NL} || '- **State:** ' || state || ' ' || {EXPORT_ICON} || {NL} "
    f"|| '- **Priority:** ' || priority || ' ' || {MARK} || {NL} "
    f"|| CASE WHEN tags <> '' THEN '- **Tags:** ' || tags || {NL} ELSE '' END "
    f"|| CASE WHEN source <> '' THEN '- **Source:** ' || source || {NL} ELSE '' END "
    f"|| coalesce('- **Parent:** #' || parent || {NL}, '') || coalesce('- **Blocked by:** #' || blocked_by || {NL}, '') "
    f"|| '- **Created:** ' || {stamp('created')} || {NL} || '- **Updated:** ' || {stamp('updated')} || {NL}"
)

# Per parent: what holds it open, and its counts.
HOLDERS = (
    "SELECT parent AS id, count(*) AS open_children, "
    f"first(id ORDER BY {CHILD_ORDER}) AS open_child, first(state ORDER BY {CHILD_ORDER}) AS open_child_state "
    "FROM tasks WHERE parent IS NOT NULL AND state NOT IN ('DONE', 'CANCELLED') GROUP BY parent"
)
PROGRESS = (
    "SELECT parent, count(*) AS subtasks_total, count(*) FILTER (WHERE state = 'DONE') AS subtasks_done "
    "FROM tasks WHERE parent IS NOT NULL GROUP BY parent"
)
BREAKDOWN = (
    "SELECT *, 'Total: ' || total || ' subtasks (' || concat_ws(', ', CASE WHEN n_done > 0 THEN n_done || ' done' END, "
    "CASE WHEN n_in_progress > 0 THEN n_in_progress || ' in progress' END, CASE WHEN n_new > 0 THEN n_new || ' new' END, "
    "CASE WHEN n_cancelled > 0 THEN n_cancelled || ' cancelled' END) || ')' AS summary FROM ("
    "SELECT parent, count(*) AS total, count(*) FILTER (WHERE state = 'DONE') AS n_done, "
    "count(*) FILTER (WHERE state = 'IN_PROGRESS') AS n_in_progress, count(*) FILTER (WHERE state = 'NEW') AS n_new, "
    "count(*) FILTER (WHERE state = 'CANCELLED') AS n_cancelled FROM tasks WHERE parent IS NOT NULL GROUP BY parent)"
)


def resolved(refs: str = "refs", column: str = "ref") -> str:
    return f"""
  SELECT w.ref, coalesce(e.id, CASE WHEN h.n = 1 THEN h.id END) AS id,
    CASE WHEN e.id IS NOT NULL OR h.n = 1 THEN 'OK' WHEN h.n > 1 THEN 'AMBIGUOUS' ELSE 'NOT_FOUND' END AS status
  FROM (SELECT DISTINCT {column} AS ref FROM {refs} WHERE {column} IS NOT NULL) w
  LEFT JOIN tasks e ON e.id = w.ref
  LEFT JOIN (SELECT r.ref, count(*) AS n, min(t.id) AS id FROM (SELECT DISTINCT {column} AS ref FROM {refs}) r
    JOIN tasks t ON substr(t.id, 1, 4) = substr(lower(r.ref), 1, 4) AND starts_with(t.id, lower(r.ref))
    WHERE length(r.ref) >= 4 AND length(r.ref) < 40 GROUP BY r.ref) h ON h.ref = w.ref"""


CANDIDATES = (
    f"SELECT id, title, row_number() OVER (ORDER BY {LIST_ORDER}) AS place FROM tasks WHERE state NOT IN ('DONE', 'CANCELLED')"
)

SUGGEST = with_tables(
    f""", resolved AS ({resolved()}), cand AS ({CANDIDATES}),
hits AS (
  SELECT r.ref, c.*, v.class FROM (SELECT ref, lower(ref) AS q FROM resolved WHERE status <> 'OK') r JOIN cand c
    ON contains(c.id, r.q) OR contains(lower(c.title), r.q)
  JOIN (VALUES (0), (1), (2)) v(class)
    ON CASE v.class WHEN 0 THEN starts_with(c.id, r.q) WHEN 1 THEN contains(c.id, r.q) ELSE contains(lower(c.title), r.q) END
),
kept AS (SELECT *, min(class) OVER (PARTITION BY ref) AS best FROM hits),
placed AS (SELECT *, row_number() OVER (PARTITION BY ref ORDER BY class, place) AS pos FROM kept WHERE best > 0 OR class = 0)
SELECT ref, pos, CASE class WHEN 0 THEN 'prefix' WHEN 1 THEN 'id' ELSE 'title' END AS hit, id,
  substr(id, 1, 7) || ' (' || title || ')' AS suggestion FROM placed WHERE pos <= 3""",
    refs=fx.NEAR_REFS,
)

FUZZY_TEXT = f""", cand AS ({CANDIDATES}),
q AS (SELECT DISTINCT ref, lower(ref) AS q FROM refs WHERE ref <> ''),
hits AS (
  SELECT q.ref, c.id, c.place, levenshtein(q.q, substr(c.id, 1, length(q.q))) AS d,
    CASE WHEN starts_with(c.id, q.q) THEN 0 WHEN contains(c.id, q.q) THEN 1 ELSE 2 END AS class
  FROM q JOIN cand c ON contains(c.id, q.q) OR levenshtein(q.q, substr(c.id, 1, length(q.q))) <= 2
),
kept AS (SELECT *, min(class) OVER (PARTITION BY ref) AS best FROM hits),
placed AS (SELECT *, row_number() OVER (PARTITION BY ref ORDER BY place) AS pos FROM kept WHERE class = best)
SELECT ref, pos, CASE class WHEN 0 THEN 'prefix' WHEN 1 THEN 'substring' ELSE 'distance' END AS hit, id,
  CAST(CASE class WHEN 0 THEN 0 WHEN 2 THEN d END AS INTEGER) AS distance FROM placed WHERE pos <= 3"""
FUZZY = with_tables(FUZZY_TEXT, refs=fx.TYPO_REFS)
FUZZY_SHORT = with_tables(FUZZY_TEXT, refs=fx.SHORT_REFS)

FUZZY_TITLES = f"""WITH tasks AS ({fx.plain(fx.TITLED)}), refs AS ({fx.plain(fx.TYPO_TITLES)}),
cand AS (SELECT id, title, lower(title) AS low, row_number() OVER (ORDER BY {LIST_ORDER}) AS place FROM tasks WHERE state NOT IN ('DONE', 'CANCELLED')),
near AS (SELECT q.ref, c.id, c.title, c.place, levenshtein(lower(q.ref), c.low) AS d FROM (SELECT DISTINCT ref FROM refs WHERE ref <> '') q
  JOIN cand c ON abs(length(c.low) - length(lower(q.ref))) <= 2 WHERE levenshtein(lower(q.ref), c.low) <= 2)
SELECT ref, pos, id, title, CAST(d AS INTEGER) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY ref ORDER BY d, place) AS pos FROM near) WHERE pos <= 3"""

SEARCH_DOCUMENTS = f"""SELECT s.q, d.doc_id FROM (SELECT DISTINCT q FROM ({fx.plain(fx.TEXT_SEARCHES)}) WHERE q IS NOT NULL) s
JOIN documents d ON lower(d.text) LIKE '%' || lower(s.q) || '%'"""

CARDS = with_tables(
    f""", shown AS (SELECT DISTINCT id FROM ({resolved()}) WHERE id IS NOT NULL), breakdown AS ({BREAKDOWN})
SELECT id, 1 AS part, 1::BIGINT AS no, {logstyle('n_done', 'total')} AS line
  FROM tasks LEFT JOIN (SELECT parent AS family, total, n_done FROM breakdown) ON family = id WHERE id IN (FROM shown)
UNION ALL SELECT t.id, 2, 1, 'Parent: ' || substr(p.id, 1, 7) || ' - ' || p.title
  FROM tasks t JOIN tasks p ON p.id = t.parent WHERE t.id IN (FROM shown)
UNION ALL SELECT parent, 3, row_number() OVER (PARTITION BY parent ORDER BY {CHILD_ORDER}),
  '  ' || {SUBTASK_LINE} || CASE WHEN description <> '' THEN {NL} || '      ' || split_part(description, {NL}, 1) ELSE '' END
  FROM tasks WHERE parent IN (FROM shown)
UNION ALL SELECT parent, 4, 1, summary FROM breakdown WHERE parent IN (FROM shown)""",
    refs=fx.REFS,
)


def parsed(source: str) -> str:
    """The source with title, description and parse_error."""
    return f"""
  SELECT *, CASE WHEN title = '' THEN 'no title line' END AS parse_error FROM (
    SELECT * EXCLUDE (lines), trim(split_part(lines, {NL}, 1), {WS}) AS title,
      CASE WHEN strpos(lines, {NL}) > 0 THEN trim(substr(lines, strpos(lines, {NL}) + 1), {WS}) ELSE '' END AS description
    FROM (SELECT *, replace(text, chr(13) || chr(10), chr(10)) AS lines FROM {source}))"""


VALID_ERROR = f"""CASE WHEN trim(coalesce(title, ''), {WS}) = '' THEN 'title is blank'
    WHEN trim(coalesce(description, ''), {WS}) = '' THEN 'description is blank'
    WHEN coalesce(kind, '') NOT IN ('BUG', 'FEATURE', 'REGRESSION') THEN 'kind not allowed: ' || coalesce(kind, '')
    WHEN coalesce(priority, '') NOT IN ('high', 'medium', 'low') THEN 'priority not allowed: ' || coalesce(priority, '')
    WHEN coalesce(state, '') NOT IN ('INBOX', 'NEW', 'IN_PROGRESS', 'DONE', 'CANCELLED', 'INVALID') THEN 'state not allowed: ' || coalesce(state, '') END"""

NEW_ID = f"sha1(concat(kind, title, description, '{AT_SECONDS}', CAST(doc_id AS VARCHAR)))"
DRAFTS = (
    "SELECT * REPLACE (upper(kind) AS kind, coalesce(priority, 'medium') AS priority), 'INBOX' AS state "
    f"FROM ({parsed('messages')})"
)
MADE = (
    f"{NEW_ID} AS id, CAST(NULL AS VARCHAR) AS parent, priority, state, kind, title, description, '{AUTHOR}' AS author, "
    f"'{AT}' AS created, '{AT}' AS updated, source, CAST(NULL AS VARCHAR) AS blocked_by, tags"
)
CAPTURE = with_tables(
    f"SELECT doc_id, {MADE}, coalesce(parse_error, {VALID_ERROR}) AS error FROM ({DRAFTS})", messages=fx.MESSAGES
)

CAPTURE_LATE = with_tables(
    f""", deliveries AS (SELECT delivery, max(at_second) - {fx.REDELIVERY} AS mark FROM feed GROUP BY delivery),
marked AS (SELECT f.*, coalesce((SELECT max(mark) FROM deliveries d WHERE d.delivery < f.delivery), 0) AS watermark FROM feed f),
told AS (SELECT *, coalesce(at_second < watermark, true) AS late FROM marked),
messages AS (SELECT *, row_number() OVER (PARTITION BY doc_id, late ORDER BY delivery) AS arrival FROM told)
SELECT doc_id, kind, priority, title, description, strftime(make_timestamp(at_second * 1000000), '%Y-%m-%d %H:%M:%S') AS created, source, tags,
  coalesce(CASE WHEN late THEN 'came later than the watermark' END, parse_error, {VALID_ERROR}) AS error
FROM ({DRAFTS}) WHERE late OR arrival = 1""",
    feed=fx.FEED,
)

CAPTURE_SUBTASKS = with_tables(
    f""", resolved AS ({resolved('messages', 'parent_ref')}),
drafts AS (SELECT p.* REPLACE (CASE WHEN kind IN ('bug', 'feature', 'regression') THEN upper(kind) ELSE kind END AS kind,
    coalesce(priority, 'medium') AS priority), 'INBOX' AS state, r.id AS parent
  FROM ({parsed('messages')}) p LEFT JOIN resolved r ON r.ref = p.parent_ref)
SELECT doc_id, {NEW_ID} AS id, parent, priority, state, kind, '' AS source, '' AS tags,
  coalesce(CASE WHEN kind NOT IN ('BUG', 'FEATURE', 'REGRESSION') THEN 'kind not allowed: ' || kind END,
    CASE WHEN parent IS NULL THEN 'parent_ref fits no single task' END, parse_error, {VALID_ERROR}) AS error
FROM drafts""",
    messages=fx.SUBTASK_MESSAGES,
)

CAPTURE_FAMILY = with_tables(
    f""", resolved AS ({resolved('messages', 'parent_ref')}),
drafts AS (SELECT p.* REPLACE (CASE WHEN parent_key IS NULL AND parent_ref IS NULL OR kind IN ('bug', 'feature', 'regression') THEN upper(kind) ELSE kind END AS kind,
    coalesce(priority, 'medium') AS priority), 'INBOX' AS state, r.id AS parent
  FROM ({parsed('messages')}) p LEFT JOIN resolved r ON r.ref = p.parent_ref),
own AS (SELECT *, {NEW_ID} AS id,
  coalesce(CASE WHEN (parent_key IS NOT NULL OR parent_ref IS NOT NULL) AND kind NOT IN ('BUG', 'FEATURE', 'REGRESSION') THEN 'kind not allowed: ' || kind END,
    CASE WHEN parent_ref IS NOT NULL AND parent IS NULL THEN 'parent_ref fits no single task' END, parse_error, {VALID_ERROR}) AS error FROM drafts),
up(doc_id, above) AS (SELECT doc_id, parent_key FROM own WHERE parent_key IS NOT NULL
  UNION SELECT u.doc_id, o.parent_key FROM up u JOIN own o ON o.doc_id = u.above WHERE o.parent_key IS NOT NULL),
cause AS (SELECT doc_id, error IS NOT NULL OR (parent_key IS NOT NULL AND parent_key NOT IN (SELECT doc_id FROM own))
  OR doc_id IN (SELECT doc_id FROM up WHERE above = doc_id) AS bad FROM own)
SELECT o.doc_id, o.id, coalesce(o.parent, p.id) AS parent, o.priority, o.state, o.kind,
  coalesce(o.error, CASE WHEN o.parent_key IS NOT NULL AND p.doc_id IS NULL THEN 'parent_key names no row' END,
    CASE WHEN o.doc_id IN (SELECT doc_id FROM up WHERE above = doc_id) THEN 'its parents form a cycle' END,
    CASE WHEN o.doc_id IN (SELECT u.doc_id FROM up u JOIN cause c ON c.doc_id = u.above WHERE c.bad) THEN 'the parent was refused' END) AS error
FROM own o LEFT JOIN own p ON p.doc_id = o.parent_key""",
    recursive=True,
    messages=fx.FAMILY_MESSAGES,
)


def cycle_links(link: str) -> str:
    """The links of one kind, and every pair of a start and what it comes to."""
    return f"""{link}_links AS (SELECT id, min({link}) AS target FROM t WHERE id IS NOT NULL AND {link} IS NOT NULL GROUP BY id),
{link}_walk(origin, place) AS (SELECT id, target FROM {link}_links UNION SELECT w.origin, l.target FROM {link}_walk w JOIN {link}_links l ON l.id = w.place)"""


def audit(text: str) -> str:
    cycles = " ".join(
        f"UNION ALL SELECT id, '{link} forms a cycle', target FROM {link}_links WHERE id IN (SELECT origin FROM {link}_walk WHERE place = origin)"
        for link in ("parent", "blocked_by")
    )
    return f"""WITH RECURSIVE t AS ({fx.plain(text)}), {cycle_links('parent')}, {cycle_links('blocked_by')}
SELECT id, 'kind is missing' AS rule, '' AS value FROM t WHERE kind IS NULL
UNION ALL SELECT id, 'title is missing', '' FROM t WHERE title IS NULL
UNION ALL SELECT id, 'author is missing', '' FROM t WHERE author IS NULL
UNION ALL SELECT id, 'priority is unknown', priority FROM t WHERE priority NOT IN ('high', 'medium', 'low')
UNION ALL SELECT id, 'state is unknown', state FROM t WHERE state NOT IN ('INBOX', 'NEW', 'IN_PROGRESS', 'DONE', 'CANCELLED', 'INVALID')
UNION ALL SELECT id, 'kind is unknown', kind FROM t WHERE kind NOT IN ('BUG', 'FEATURE', 'REGRESSION')
UNION ALL SELECT id, 'id is repeated', CAST(count(*) AS VARCHAR) FROM t GROUP BY id HAVING count(*) > 1
UNION ALL SELECT id, 'parent does not exist', parent FROM t WHERE parent IS NOT NULL AND parent NOT IN (SELECT id FROM t)
UNION ALL SELECT id, 'blocked_by does not exist', blocked_by FROM t WHERE blocked_by IS NOT NULL AND blocked_by NOT IN (SELECT id FROM t) {cycles}"""


UPGRADE = f"""SELECT id, parent, priority, state, kind, title, coalesce(description, '') AS description,
  'Unknown <unknown@example.com>' AS author, {stamp('created')} AS created, {stamp('updated')} AS updated, '' AS source,
  CAST(NULL AS VARCHAR) AS blocked_by, '' AS tags FROM ({fx.plain(fx.OLD_TASKS)})"""


def judged_rows(source: str) -> str:
    return f"""SELECT *, coalesce({VALID_ERROR},
    CASE WHEN parent IS NOT NULL AND parent NOT IN (SELECT id FROM tasks) THEN 'parent does not exist' END,
    CASE WHEN blocked_by IS NOT NULL AND blocked_by NOT IN (SELECT id FROM tasks) THEN 'blocked_by does not exist' END) AS problem
  FROM {source}"""


APPEND_JUDGED = f""", j AS ({judged_rows('fresh')}),
judged AS (SELECT *, coalesce(problem, CASE WHEN id IN (SELECT id FROM tasks)
    OR n > (SELECT min(k.n) FROM j k WHERE k.id = j.id AND k.problem IS NULL) THEN 'id exists already' END) AS reason FROM j)"""
APPEND = with_tables(
    f"{APPEND_JUDGED} SELECT {SHOWN} FROM tasks UNION ALL SELECT {SHOWN} FROM judged WHERE reason IS NULL", fresh=fx.NEW_ROWS
)
APPEND_REFUSED = with_tables(
    f"{APPEND_JUDGED} SELECT id, n, reason FROM judged WHERE reason IS NOT NULL", fresh=fx.NEW_ROWS
)
# Links go up three steps at most, seven if an id is repeated, so eight rounds settle who is accepted.
FAMILY_ROUND = """,
r{i} AS (SELECT id, min(n) AS n FROM valid v WHERE parent IS NULL OR parent IN (SELECT id FROM tasks)
    OR EXISTS (SELECT 1 FROM r{before} r WHERE r.id = v.parent AND r.n < v.n) GROUP BY id)"""
APPEND_FAMILY = with_tables(
    f""", checked AS (SELECT *, CASE WHEN id IS NULL THEN 'id is missing' ELSE {VALID_ERROR} END AS error FROM family),
valid AS (SELECT * FROM checked WHERE error IS NULL AND id NOT IN (SELECT id FROM tasks)),
r0 AS (SELECT id, n FROM valid WHERE false)"""
    + "".join(FAMILY_ROUND.format(i=i, before=i - 1) for i in range(1, 9))
    + """,
judged AS (SELECT *, coalesce(error,
    CASE WHEN parent IS NOT NULL AND parent NOT IN (SELECT id FROM tasks)
      AND NOT EXISTS (SELECT 1 FROM r8 r WHERE r.id = c.parent AND r.n < c.n) THEN 'parent does not exist' END,
    CASE WHEN NOT EXISTS (SELECT 1 FROM r8 r WHERE r.id = c.id AND r.n = c.n) THEN 'id exists already' END) AS reason FROM checked c)
SELECT id, CASE WHEN reason IS NOT NULL THEN n END AS n, coalesce(reason, 'added') AS outcome FROM judged""",
    family=fx.FAMILY_ROWS,
)
AUDIT_UPGRADED = audit(f"SELECT *, 'Unknown <unknown@example.com>' AS author, CAST(NULL AS STRING) AS blocked_by FROM ({fx.OLD_TASKS})")
UPSERT = with_tables(
    f""", changes AS ({judged_rows('edits')}),
last AS (SELECT * FROM changes c WHERE problem IS NULL AND n = (SELECT max(d.n) FROM changes d WHERE d.id = c.id AND d.problem IS NULL)),
merged AS (SELECT id, parent, priority, state, kind, title, description, author,
    (SELECT created FROM tasks t WHERE t.id = last.id) AS created, TIMESTAMP '{AT}' AS updated, source, blocked_by, tags FROM last
    WHERE id IN (SELECT id FROM tasks)
  UNION ALL SELECT id, parent, priority, state, kind, title, description, author, created, updated, source, blocked_by, tags
    FROM tasks WHERE id NOT IN (SELECT id FROM last))
SELECT {SHOWN} FROM merged""",
    edits=fx.FIELD_CHANGES,
)
KEPT = """, doomed AS (SELECT DISTINCT id FROM asked WHERE id IN (SELECT id FROM tasks)),
kept(id) AS (
  SELECT id FROM tasks WHERE id NOT IN (SELECT id FROM doomed)
  UNION SELECT x.id FROM kept JOIN tasks t ON t.id = kept.id JOIN tasks x ON x.id = t.parent OR x.id = t.blocked_by)"""
DELETE = with_tables(
    f"{KEPT} SELECT id, 'kept' AS outcome FROM kept UNION ALL SELECT id, 'refused' FROM kept WHERE id IN (SELECT id FROM doomed)",
    recursive=True,
    asked=fx.DELETIONS,
)
DELETED_TABLE = with_tables(f"{KEPT} SELECT {SHOWN} FROM tasks WHERE id IN (FROM kept)", recursive=True, asked=fx.DELETIONS)

RULES = """(VALUES ('accept', 'INBOX', 'NEW'), ('reject', 'INBOX', 'INVALID'), ('in-progress', 'NEW', 'IN_PROGRESS'),
  ('in-progress', 'DONE', 'IN_PROGRESS'), ('in-progress', 'CANCELLED', 'IN_PROGRESS'), ('done', 'NEW', 'DONE'),
  ('done', 'IN_PROGRESS', 'DONE'), ('cancel', 'NEW', 'CANCELLED'), ('cancel', 'IN_PROGRESS', 'CANCELLED'),
  ('reopen', 'CANCELLED', 'NEW'))"""
ALLOWED = """CASE state WHEN 'INBOX' THEN 'NEW (accept), INVALID (reject)'
  WHEN 'NEW' THEN 'IN_PROGRESS (in-progress), DONE (done), CANCELLED (cancel)'
  WHEN 'IN_PROGRESS' THEN 'DONE (done), CANCELLED (cancel)' WHEN 'DONE' THEN 'IN_PROGRESS (in-progress)'
  WHEN 'CANCELLED' THEN 'IN_PROGRESS (in-progress), NEW (reopen)' ELSE '' END"""

JUDGED = f""", resolved AS ({resolved('requests')}), holders AS ({HOLDERS}),
targeted AS (
  SELECT q.seq, q.ref, q.command, r.id, r.status, t.state, u.target, h.open_child, h.open_child_state,
    q.command IN ('accept', 'reject', 'in-progress', 'done', 'cancel', 'reopen') AS known
  FROM requests q JOIN resolved r ON r.ref = q.ref LEFT JOIN tasks t ON t.id = r.id LEFT JOIN holders h ON h.id = r.id
  LEFT JOIN {RULES} u(command, source, target) ON u.command = q.command AND u.source = t.state),
alone AS (SELECT *, CASE WHEN status <> 'OK' THEN status WHEN NOT known THEN 'UNKNOWN_COMMAND'
    WHEN command = 'done' AND open_child IS NOT NULL THEN 'OPEN_CHILDREN' WHEN target IS NULL THEN 'REFUSED' ELSE 'ACCEPTED' END AS own
  FROM targeted),
judged AS (SELECT *, CASE WHEN own IN ('ACCEPTED', 'REFUSED', 'OPEN_CHILDREN')
    AND seq > min(seq) FILTER (WHERE own = 'ACCEPTED') OVER (PARTITION BY id) THEN 'CONFLICT' ELSE own END AS verdict FROM alone)"""
VERDICTS = with_tables(
    f"""{JUDGED} SELECT seq, ref, command, id, state AS from_state, CASE WHEN verdict = 'ACCEPTED' THEN target END AS to_state, verdict,
  CASE verdict WHEN 'ACCEPTED' THEN 'Task ' || substr(id, 1, 7) || ' marked as ' || CASE target WHEN 'IN_PROGRESS' THEN 'in progress'
      WHEN 'DONE' THEN 'done' WHEN 'CANCELLED' THEN 'cancelled' ELSE target END
    WHEN 'OPEN_CHILDREN' THEN substr(id, 1, 7) || ': child ' || open_child || ' is still ' || open_child_state
    WHEN 'CONFLICT' THEN 'more than one request for this task; replay the log instead'
    WHEN 'UNKNOWN_COMMAND' THEN 'no such command: ' || command
    WHEN 'AMBIGUOUS' THEN 'several tasks fit: ' || ref WHEN 'NOT_FOUND' THEN 'no task fits: ' || ref
    ELSE substr(id, 1, 7) || ': ' || command || ' does not apply to ' || state || '; open moves: ' || coalesce(nullif({ALLOWED}, ''), 'none') END AS message
FROM judged""",
    requests=fx.TRANSITIONS,
)
APPLIED = with_tables(
    f"""{JUDGED}, moved AS (SELECT id, target FROM judged WHERE verdict = 'ACCEPTED'),
after AS (SELECT t.* REPLACE (coalesce(m.target, t.state) AS state,
  CASE WHEN m.id IS NOT NULL THEN TIMESTAMP '{AT}' ELSE t.updated END AS updated) FROM tasks t LEFT JOIN moved m ON m.id = t.id)
SELECT {SHOWN} FROM after""",
    requests=fx.TRANSITIONS,
)

BLOCK_JUDGED = f""", wanted AS (SELECT ref FROM requests UNION ALL SELECT by_ref FROM requests), resolved AS ({resolved('wanted')}),
judged AS (SELECT q.seq, q.ref, q.by_ref, a.id, b.id AS by_id, CASE WHEN a.id IS NULL THEN a.status
    WHEN b.id IS NULL THEN 'BLOCKER_' || b.status WHEN a.id = b.id THEN 'SELF' ELSE 'BLOCKED' END AS verdict
  FROM requests q JOIN resolved a ON a.ref = q.ref JOIN resolved b ON b.ref = q.by_ref)"""
BLOCK_VERDICTS = with_tables(f"{BLOCK_JUDGED} SELECT * FROM judged", requests=fx.BLOCKS)
BLOCKED = with_tables(
    f"""{BLOCK_JUDGED}, last AS (SELECT id, arg_max(by_id, seq) AS by_id FROM judged WHERE verdict = 'BLOCKED' GROUP BY id),
after AS (SELECT t.id, coalesce(l.by_id, t.blocked_by) AS blocked_by, CASE WHEN l.id IS NOT NULL THEN TIMESTAMP '{AT}' ELSE t.updated END AS updated
  FROM tasks t LEFT JOIN last l ON l.id = t.id)
SELECT id, blocked_by, {stamp('updated')} AS updated FROM after""",
    requests=fx.BLOCKS,
)
UNBLOCK_JUDGED = f""", resolved AS ({resolved('requests')}),
judged AS (SELECT q.seq, q.ref, r.id, CASE WHEN r.id IS NULL THEN r.status
    WHEN t.blocked_by IS NOT NULL AND row_number() OVER (PARTITION BY r.id ORDER BY q.seq) = 1 THEN 'UNBLOCKED' ELSE 'WAS_NOT_BLOCKED' END AS verdict
  FROM requests q JOIN resolved r ON r.ref = q.ref LEFT JOIN tasks t ON t.id = r.id)"""
UNBLOCK_VERDICTS = with_tables(f"{UNBLOCK_JUDGED} SELECT * FROM judged", requests=fx.UNBLOCKS)
UNBLOCKED = with_tables(
    f"""{UNBLOCK_JUDGED}, touched AS (SELECT DISTINCT id FROM judged WHERE id IS NOT NULL),
after AS (SELECT id, CASE WHEN id NOT IN (FROM touched) THEN blocked_by END AS blocked_by,
  CASE WHEN id IN (FROM touched) THEN TIMESTAMP '{AT}' ELSE updated END AS updated FROM tasks)
SELECT id, blocked_by, {stamp('updated')} AS updated FROM after""",
    requests=fx.UNBLOCKS,
)


def replay_level(depth: int, deepest: bool) -> str:
    """One depth of the task tree, command by command; deeper levels are done already."""
    allowed = (
        "true"
        if deepest
        else f"(SELECT count(*) FROM tasks kid WHERE kid.parent = l.id) + coalesce((SELECT sum(f.delta) FROM flips{depth + 1} f "
        "WHERE f.parent = l.id AND f.seq < l.seq), 0) = 0"
    )
    return f""",
cmds{depth} AS (SELECT l.seq, l.id, l.command, {allowed} AS ok, row_number() OVER (PARTITION BY l.id ORDER BY l.seq) AS k
  FROM log l JOIN depths d ON d.id = l.id WHERE d.depth = {depth}),
run{depth} AS (
  SELECT DISTINCT id, 0::BIGINT AS k, 0::BIGINT AS seq, '' AS command, true AS ok, '' AS was, 'INBOX' AS now FROM cmds{depth}
  UNION ALL SELECT c.id, c.k, c.seq, c.command, c.ok, r.now,
    CASE WHEN u.target IS NOT NULL AND (c.command <> 'done' OR c.ok) THEN u.target ELSE r.now END
  FROM run{depth} r JOIN cmds{depth} c ON c.id = r.id AND c.k = r.k + 1
  LEFT JOIN {RULES} u(command, source, target) ON u.command = c.command AND u.source = r.now),
flips{depth} AS (SELECT t.parent, r.seq, CAST(r.now NOT IN ('DONE', 'CANCELLED') AS INTEGER) - CAST(r.was NOT IN ('DONE', 'CANCELLED') AS INTEGER) AS delta
  FROM run{depth} r JOIN tasks t ON t.id = r.id WHERE k > 0)"""


REPLAYED = (
    """, depths AS (SELECT id, 0 AS depth FROM tasks WHERE parent IS NULL
  UNION ALL SELECT t.id, d.depth + 1 FROM tasks t JOIN depths d ON d.id = t.parent)"""
    + replay_level(2, True)
    + replay_level(1, False)
    + replay_level(0, False)
    + """,
history AS (SELECT seq, id, command, was AS from_state,
    CASE WHEN command = 'done' AND NOT ok THEN 'OPEN_CHILDREN' WHEN now <> was THEN 'ACCEPTED' ELSE 'REFUSED' END AS verdict, now
  FROM (SELECT * FROM run0 UNION ALL SELECT * FROM run1 UNION ALL SELECT * FROM run2) WHERE k > 0)"""
)
REPLAY = with_tables(
    f"{REPLAYED} SELECT seq, id, command, from_state, CASE WHEN verdict = 'ACCEPTED' THEN now END AS to_state, verdict FROM history",
    recursive=True,
    log=fx.LOG,
)
REPLAY_HOT = with_tables(
    f"""{REPLAYED} SELECT seq, id, command, from_state, CASE WHEN verdict = 'ACCEPTED' THEN now END AS to_state, verdict FROM history
UNION ALL SELECT seq, id, command, NULL, NULL, 'NO_SEQ' FROM gaps WHERE seq IS NULL""",
    recursive=True,
    gaps=fx.LOG_WITH_GAPS,
    log="SELECT * FROM gaps WHERE seq IS NOT NULL",
)
REPLAY_FINAL = with_tables(
    f"""{REPLAYED}, last AS (SELECT h.id, arg_max(h.now, h.seq) AS state, max(l.at) AS at
  FROM history h JOIN log l ON l.seq = h.seq WHERE verdict = 'ACCEPTED' GROUP BY h.id)
SELECT t.id, coalesce(last.state, 'INBOX') AS state, strftime(coalesce(last.at, t.updated), '%Y-%m-%d %H:%M:%S') AS updated
FROM tasks t LEFT JOIN last ON last.id = t.id""",
    recursive=True,
    log=fx.LOG,
)


def counts(where: str) -> str:
    values = {
        "state": ("INBOX", "NEW", "IN_PROGRESS", "DONE", "CANCELLED", "INVALID"),
        "kind": ("BUG", "FEATURE", "REGRESSION"),
        "priority": ("high", "medium", "low"),
    }
    return with_tables(
        " UNION ALL ".join(
            f"SELECT '{name}' AS dimension, '{value}' AS value, count(*) FILTER (WHERE {name} = '{value}') AS n FROM tasks WHERE {where}"
            for name, domain in values.items()
            for value in domain
        )
    )


def totals(where: str) -> str:
    return with_tables(
        "SELECT count(*) AS total, count(*) FILTER (WHERE state IN ('NEW', 'IN_PROGRESS')) AS active, count(blocked_by) AS blocked, "
        "count(*) FILTER (WHERE id IN (SELECT parent FROM tasks WHERE parent IS NOT NULL)) AS parents, count(parent) AS subtasks "
        f"FROM tasks WHERE {where}"
    )


def with_progress(where: str, select: str, limit: int | None = None) -> str:
    cut = f"WHERE rank <= {limit}" if limit else ""
    return with_tables(
        f""", progress AS (SELECT parent AS family, subtasks_total, subtasks_done FROM ({PROGRESS})),
listed AS (SELECT *, row_number() OVER (ORDER BY {LIST_ORDER}) AS rank FROM tasks WHERE {where})
SELECT {select} FROM (SELECT l.*, coalesce(p.subtasks_total, 0) AS subtasks_total, coalesce(p.subtasks_done, 0) AS subtasks_done
  FROM listed l LEFT JOIN progress p ON p.family = l.id AND l.parent IS NULL) {cut}"""
    )


OPEN = "state NOT IN ('DONE', 'CANCELLED')"
DEFAULT = "state NOT IN ('INBOX', 'INVALID', 'DONE', 'CANCELLED')"
CSV_COLUMNS = (
    "id AS ID, kind AS Type, state AS State, priority AS Priority, title AS Title, tags AS Tags, source AS Source, "
    f"coalesce(parent, '') AS Parent, coalesce(blocked_by, '') AS BlockedBy, {stamp('created')} AS Created, {stamp('updated')} AS Updated"
)
EXPORTED = "kind = 'BUG' AND state = 'IN_PROGRESS'"
FOUND = "lower(title) LIKE '%order 1_%customer 2%' OR lower(description) LIKE '%order 1_%customer 2%'"


def file_lines(texts: str) -> str:
    """Numbered lines of (part, no, line) texts written one after another."""
    return (
        f"SELECT row_number() OVER (ORDER BY part, no, k) AS no, value FROM (SELECT part, no, unnest(string_split(line, {NL})) AS value, "
        f"generate_subscripts(string_split(line, {NL}), 1) AS k FROM ({texts}))"
    )


def text_export(line: str, where: str, order: str = LIST_ORDER) -> str:
    return with_tables(file_lines(f"SELECT 0 AS part, row_number() OVER (ORDER BY {order}) AS no, {line} AS line FROM tasks WHERE {where}"))


def markdown_export(where: str, order: str = LIST_ORDER) -> str:
    return with_tables(
        f""", numbered AS (SELECT *, row_number() OVER (ORDER BY {order}) AS no FROM tasks WHERE {where}),
texts AS (
  SELECT 1 AS part, 0 AS no, '# Tasks Export' || {NL} || {NL} || 'Total tasks: ' || count(*) || {NL} || {NL}
    || '| ID | Type | State | Priority | Title | Tags | Source | Parent | Blocked By |' || {NL} || '|---|---|---|---|---|---|---|---|---|' AS line FROM numbered
  UNION ALL SELECT 2, no, {MARKDOWN_CELLS} FROM numbered
  UNION ALL SELECT 3, 0, {NL} || '## Task Details' || {NL}
  UNION ALL SELECT 4, no, {MARKDOWN_SECTION} FROM numbered)
{file_lines("FROM texts")}"""
    )


HEREDOC_BODY = (
    "CASE " + " ".join(f"WHEN ends_with(description, '{w} < /dev/null') THEN trim(left(description, length(description) - {len(w) + 12}), {WS})" for w in ("EOF", "EOL", "END", "DONE"))
    + " ELSE description END"
)

FILTER_SPELLINGS = with_tables(
    """, said(filter, spelling, value, error) AS (VALUES
  ('state', 'in-progress', 'IN_PROGRESS', NULL), ('state', 'IN_PROGRESS', 'IN_PROGRESS', NULL), ('state', 'In-Progress', 'IN_PROGRESS', NULL),
  ('state', 'done', 'DONE', NULL), ('state', 'Cancelled', 'CANCELLED', NULL),
  ('state', 'inbox', NULL, 'invalid state: inbox (must be one of NEW, IN_PROGRESS, DONE, CANCELLED)'),
  ('state', 'open', NULL, 'invalid state: open (must be one of NEW, IN_PROGRESS, DONE, CANCELLED)'),
  ('priority', 'HIGH', 'high', NULL), ('priority', 'Low', 'low', NULL),
  ('priority', 'urgent', NULL, 'invalid priority: urgent (must be one of high, medium, low)'),
  ('kind', 'bug', 'BUG', NULL), ('kind', 'Regression', 'REGRESSION', NULL),
  ('kind', 'chore', NULL, 'invalid kind: chore (must be one of BUG, FEATURE, REGRESSION)'))
SELECT s.filter, s.spelling, coalesce(s.error, '') AS error, count(t.id) AS n
FROM said s LEFT JOIN tasks t ON CASE s.filter WHEN 'state' THEN t.state WHEN 'priority' THEN t.priority ELSE t.kind END = s.value GROUP BY ALL"""
)

SQL: dict[str, str] = {
    "filter_spellings": FILTER_SPELLINGS,
    "list_default": listed(DEFAULT, limit=20),
    "list_all": listed("true"),
    "list_open": listed(OPEN),
    "list_by_state": listed("state = 'IN_PROGRESS'", limit=50),
    "list_by_priority": listed(f"{DEFAULT} AND priority = 'high'", limit=50),
    "list_by_kind": listed("state NOT IN ('INBOX', 'INVALID', 'CANCELLED') AND kind = 'BUG'", limit=50),
    "list_by_tag": listed(f"{DEFAULT} AND contains(lower(tags), 'ui')", limit=100),
    "list_by_exact_tag": listed(f"{DEFAULT} AND list_contains({TAG_ARRAY}, 'ui')", limit=100),
    "list_blocked": listed(f"{DEFAULT} AND blocked_by IS NOT NULL"),
    "list_done": listed("state = 'DONE'"),
    "list_cancelled": listed("state = 'CANCELLED'"),
    "list_with_progress": with_progress(DEFAULT, f"{SHOWN}, subtasks_total, subtasks_done, rank", 20),
    "list_all_with_progress": with_progress("true", "id, state, subtasks_total, subtasks_done"),
    "inbox": listed("state = 'INBOX'", NEWEST),
    "active_count": with_tables(f"SELECT count(*) AS n FROM tasks WHERE {DEFAULT}"),
    "search_title_body": listed(FOUND, NEWEST),
    "search_literal": listed(
        "contains(lower(title), 'priority 2-high') OR contains(lower(description), 'priority 2-high')", NEWEST
    ),
    "search_many": with_tables(
        "SELECT s.q, t.id FROM (SELECT DISTINCT q FROM searches) s JOIN tasks t "
        "ON lower(t.title) LIKE '%' || lower(s.q) || '%' OR lower(t.description) LIKE '%' || lower(s.q) || '%'",
        searches=fx.SEARCHES,
    ),
    "summary_counts": counts("true"),
    "summary_counts_active": counts(OPEN),
    "summary_totals": totals("true"),
    "summary_totals_active": totals(OPEN),
    "tag_counts": with_tables(
        f"SELECT tag, count(*) AS n FROM (SELECT unnest({TAG_ARRAY}) AS tag FROM tasks) GROUP BY tag"
    ),
    "tag_list": with_tables(
        f"SELECT id, CAST(pos - 1 AS INTEGER) AS pos, list[pos] AS tag FROM (SELECT id, list, unnest(range(1, len(list) + 1)) AS pos "
        f"FROM (SELECT id, {TAG_ARRAY} AS list FROM tasks))"
    ),
    "progress": with_tables(PROGRESS),
    "child_breakdown": with_tables(BREAKDOWN),
    "children": with_tables(
        f"SELECT parent, row_number() OVER (PARTITION BY parent ORDER BY {CHILD_ORDER}) AS child_no, id, priority, state, title "
        "FROM tasks WHERE parent IN (SELECT id FROM tasks)"
    ),
    "with_parent": with_tables(
        "SELECT t.id, t.parent, substr(p.id, 1, 7) AS parent_short, p.title AS parent_title FROM tasks t LEFT JOIN tasks p ON p.id = t.parent"
    ),
    "with_blocker": with_tables(
        "SELECT t.id, t.blocked_by, substr(b.id, 1, 7) AS blocker_short, b.title AS blocker_title FROM tasks t LEFT JOIN tasks b ON b.id = t.blocked_by"
    ),
    "completable": with_tables(
        f"SELECT t.id, h.id IS NULL AS completable, coalesce(h.open_children, 0) AS open_children, h.open_child, h.open_child_state "
        f"FROM tasks t LEFT JOIN ({HOLDERS}) h ON h.id = t.id"
    ),
    "resolve_refs": with_tables(resolved(), refs=fx.REFS),
    "suggest": SUGGEST,
    "fuzzy_match": FUZZY,
    "fuzzy_short": FUZZY_SHORT,
    "fuzzy_titles": FUZZY_TITLES,
    "search_documents": SEARCH_DOCUMENTS,
    "cards": CARDS,
    "columns": with_tables(
        f"SELECT id, substr(id, 1, 7) AS short, blocked_by IS NOT NULL AS blocked, {KIND_LABEL} AS kind_label, {ICON} AS icon, "
        f"{EXPORT_ICON} AS export_icon, {MARK} AS mark, CASE state WHEN 'IN_PROGRESS' THEN 'in progress' WHEN 'DONE' THEN 'done' "
        f"WHEN 'CANCELLED' THEN 'cancelled' ELSE state END AS verb, {TAG_MARKS} AS tag_marks, array_to_string({TAG_ARRAY}, ',') AS tags_clean, "
        f"split_part(description, {NL}, 1) AS teaser, {stamp('created')} AS stamp, {MAIL_DATE} AS mail_date, "
        f"'Created ' || lower(kind) || ' task ' || id AS message, len({TAG_ARRAY}) || CASE len({TAG_ARRAY}) WHEN 1 THEN ' tag' ELSE ' tags' END AS tag_count, "
        f"{COMPACT} AS compact FROM tasks"
    ),
    "oneline": with_tables(f"SELECT id, {ONELINE} AS line FROM tasks"),
    "logstyle": with_tables(
        f"SELECT id, {logstyle('subtasks_done', 'subtasks_total')} AS line FROM tasks "
        f"LEFT JOIN (SELECT parent AS family, subtasks_total, subtasks_done FROM ({PROGRESS})) ON family = id"
    ),
    "subtask_line": with_tables(f"SELECT id, {SUBTASK_LINE} AS line FROM tasks"),
    "markdown_rows": with_tables(
        f"SELECT no, id, {MARKDOWN_CELLS} AS line FROM (SELECT *, row_number() OVER (ORDER BY {LIST_ORDER}) AS no FROM tasks)"
    ),
    "markdown_detail": with_tables(f"SELECT id, {MARKDOWN_SECTION} AS line FROM tasks"),
    "next_states": with_tables(f"SELECT id, state, {ALLOWED} AS allowed FROM tasks"),
    "parse_messages": f"SELECT doc_id, title, description, parse_error FROM ({parsed('documents')})",
    "new_tasks": with_tables(f"SELECT doc_id, {MADE} FROM ({DRAFTS})", messages=fx.MESSAGES),
    "validate_tasks": with_tables(f"SELECT doc_id, {VALID_ERROR} AS error FROM ({DRAFTS})", messages=fx.MESSAGES),
    "capture": CAPTURE,
    "capture_subtasks": CAPTURE_SUBTASKS,
    "capture_family": CAPTURE_FAMILY,
    "audit": audit(fx.DIRTY_TASKS),
    "audit_cycles": audit(fx.CYCLIC_TASKS),
    "upgrade_snapshot": UPGRADE,
    "append_tasks": APPEND,
    "append_refused": APPEND_REFUSED,
    "append_family": APPEND_FAMILY,
    "audit_upgraded": AUDIT_UPGRADED,
    "upsert_fields": UPSERT,
    "stored_changes": UPSERT,
    "stored_deletions": DELETED_TABLE,
    "delete_tasks": DELETE,
    "transition_verdicts": VERDICTS,
    "apply_transitions": APPLIED,
    "apply_blocks": BLOCKED,
    "block_verdicts": BLOCK_VERDICTS,
    "apply_unblocks": UNBLOCKED,
    "unblock_verdicts": UNBLOCK_VERDICTS,
    "replay": REPLAY,
    "replay_hot": REPLAY_HOT,
    "replay_final": REPLAY_FINAL,
    "export_json": with_tables(
        f"SELECT id, kind, state, priority, title, description, tags, source, parent, blocked_by, {stamp('created')} AS created_at, "
        f"{stamp('updated')} AS updated_at FROM tasks"
    ),
    "export_csv": with_tables(f"SELECT {CSV_COLUMNS} FROM tasks WHERE {DEFAULT} AND contains(lower(tags), 'ui')"),
    "export_markdown": markdown_export(EXPORTED),
    "export_standard": text_export(logstyle("0", "0"), "priority = 'low' AND state = 'IN_PROGRESS'"),
    "export_inbox": markdown_export("state = 'INBOX'", NEWEST),
    "export_search": text_export(ONELINE, FOUND, NEWEST),
    "list_text": with_progress("true", f"id, {logstyle('subtasks_done', 'subtasks_total')} AS line"),
    "stored_tasks": with_tables(f"SELECT {SHOWN} FROM tasks"),
    "parse_heredocs": with_tables(
        f"SELECT doc_id, title, {HEREDOC_BODY} AS description, parse_error FROM ({parsed('heredocs')})", heredocs=fx.HEREDOCS
    ),
    "export_oneline": with_tables(f"SELECT {ONELINE} AS value FROM tasks WHERE priority = 'high'"),
    "stream_capture": CAPTURE,
    "stream_replay": REPLAY,
    "stream_capture_late": CAPTURE_LATE,
    "stream_replay_keyed": REPLAY,
}
