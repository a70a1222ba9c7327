"""Task tables, logs and requests derived from the test tables.

Each is one SQL text that Spark and the SQL check both run, over whole tables.
Table names stand in braces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TASKS = """
SELECT sha1(concat('task-', CAST(k AS STRING))) AS id,
  CASE WHEN m IN (1,2,3) THEN sha1(concat('task-', CAST(k - m AS STRING)))
       WHEN m IN (4,5)   THEN sha1(concat('task-', CAST(k - m + 1 AS STRING))) END AS parent,
  CASE WHEN o_orderpriority IN ('1-URGENT','2-HIGH') THEN 'high'
       WHEN o_orderpriority = '5-LOW' THEN 'low' ELSE 'medium' END AS priority,
  CASE WHEN o_orderstatus = 'O' THEN CASE WHEN k % 3 = 0 THEN 'INBOX' ELSE 'NEW' END
       WHEN o_orderstatus = 'P' THEN CASE WHEN k % 7 = 0 THEN 'CANCELLED'
            WHEN k % 11 = 0 THEN 'INVALID' ELSE 'IN_PROGRESS' END
       ELSE 'DONE' END AS state,
  CASE o_custkey % 3 WHEN 0 THEN 'BUG' WHEN 1 THEN 'FEATURE' ELSE 'REGRESSION' END AS kind,
  concat('Order ', CAST(k AS STRING), ' for customer ', CAST(o_custkey AS STRING)) AS title,
  concat('Total ', CAST(CAST(round(o_totalprice) AS BIGINT) AS STRING), '. Priority ', o_orderpriority) AS description,
  concat('Customer ', CAST(o_custkey AS STRING), ' <c', CAST(o_custkey AS STRING), '@example.com>') AS author,
  o_orderdate AS created, o_orderdate AS updated,
  CASE WHEN k % 4 = 0 THEN concat('order:', CAST(k AS STRING)) ELSE '' END AS source,
  CASE WHEN m IN (6,7) THEN sha1(concat('task-', CAST(k + 1 AS STRING))) END AS blocked_by,
  CASE k % 6 WHEN 0 THEN 'backend,urgent' WHEN 1 THEN 'ui' WHEN 2 THEN 'build, ui' WHEN 3 THEN 'guide,,docs' ELSE '' END AS tags
FROM (SELECT *, o_orderkey AS k, o_orderkey % 10 AS m FROM {orders}) o
"""

# A table with every kind of broken row.
DIRTY_TASKS = """
SELECT CASE WHEN k % 13 = 0 THEN sha1(concat('task-', CAST(k + 1 AS STRING)))
            ELSE sha1(concat('task-', CAST(k AS STRING))) END AS id,
  CASE WHEN k % 17 = 0 THEN sha1(concat('gone-', CAST(k AS STRING)))
       WHEN k % 10 IN (1,2) THEN sha1(concat('task-', CAST(k - k % 10 AS STRING))) END AS parent,
  CASE k % 19 WHEN 0 THEN 'urgent' WHEN 1 THEN NULL ELSE 'high' END AS priority,
  CASE k % 23 WHEN 0 THEN 'OPEN' WHEN 1 THEN NULL ELSE 'NEW' END AS state,
  CASE k % 29 WHEN 0 THEN 'CHORE' WHEN 1 THEN NULL ELSE 'BUG' END AS kind,
  CASE WHEN k % 31 <> 0 THEN concat('Order ', CAST(k AS STRING)) END AS title,
  CASE WHEN k % 37 <> 0 THEN 'A customer' END AS author,
  CASE WHEN k % 41 = 0 THEN 'nobody' WHEN k % 10 = 6 THEN sha1(concat('task-', CAST(k + 1 AS STRING))) END AS blocked_by
FROM (SELECT *, o_orderkey AS k FROM {orders}) o
"""

# Per thousand tasks: a ring of 500 parents, a task that is its own parent, two that are each
# other's, a chain of a hundred that leads to them, and one that ends. Blockers: rings of three.
CYCLIC_TASKS = """
SELECT sha1(concat('task-', CAST(k AS STRING))) AS id,
  CASE WHEN m < 500 THEN sha1(concat('task-', CAST(k - m + (m + 1) % 500 AS STRING)))
       WHEN m = 500 THEN sha1(concat('task-', CAST(k AS STRING)))
       WHEN m = 501 THEN sha1(concat('task-', CAST(k + 1 AS STRING)))
       WHEN m <> 700 THEN sha1(concat('task-', CAST(k - 1 AS STRING))) END AS parent,
  'high' AS priority, 'NEW' AS state, 'BUG' AS kind, 'A title' AS title, 'A customer' AS author,
  CASE m % 5 WHEN 0 THEN sha1(concat('task-', CAST(k + 1 AS STRING))) WHEN 1 THEN sha1(concat('task-', CAST(k + 1 AS STRING)))
       WHEN 2 THEN sha1(concat('task-', CAST(k - 2 AS STRING))) WHEN 3 THEN sha1(concat('task-', CAST(k - 1 AS STRING))) END AS blocked_by
FROM (SELECT o_orderkey AS k, o_orderkey % 1000 AS m FROM {orders}) o
"""

# A table of an older layout: four states, no author, source, blocked_by or tags.
OLD_TASKS = """
SELECT sha1(concat('task-', CAST(k AS STRING))) AS id,
  CASE WHEN k % 10 IN (1,2,3) THEN sha1(concat('task-', CAST(k - k % 10 AS STRING))) END AS parent,
  CASE o_orderpriority WHEN '1-URGENT' THEN 'high' WHEN '5-LOW' THEN 'low' ELSE 'medium' END AS priority,
  CASE o_orderstatus WHEN 'O' THEN 'NEW' WHEN 'P' THEN 'IN_PROGRESS' ELSE CASE WHEN k % 5 = 0 THEN 'CANCELLED' ELSE 'DONE' END END AS state,
  'BUG' AS kind,
  concat('Order ', CAST(k AS STRING)) AS title,
  CASE WHEN k % 4 <> 0 THEN concat('Priority ', o_orderpriority) END AS description,
  o_orderdate AS created, o_orderdate AS updated
FROM (SELECT *, o_orderkey AS k FROM {orders}) o
"""

LOG = """
SELECT event_id AS seq, ts AS at,
  sha1(concat('task-', CAST(user_id * 10 + event_id % 6 AS STRING))) AS id,
  CASE event_type WHEN 'signup' THEN 'accept' WHEN 'view' THEN 'in-progress' WHEN 'click' THEN 'done'
       WHEN 'purchase' THEN CASE WHEN event_id % 2 = 0 THEN 'done' ELSE 'accept' END
       ELSE CASE event_id % 4 WHEN 0 THEN 'cancel' WHEN 1 THEN 'reopen' WHEN 2 THEN 'reject' ELSE 'in-progress' END
  END AS command
FROM {events}
"""

# The log in six deliveries.
LOG_DELIVERIES = 6
LOG_FEED = f"""
SELECT l.*, CAST(floor(seq * {LOG_DELIVERIES}.0 / n) AS INT) AS delivery
FROM ({LOG}) l, (SELECT max(event_id) + 1 AS n FROM {{events}}) s
"""

# The same log with some commands that have lost their place.
LOG_WITH_GAPS = LOG.replace("SELECT event_id AS seq", "SELECT CASE WHEN event_id % 11 <> 0 THEN event_id END AS seq")

# Full ids, prefixes of several lengths in either case, too short and unknown ones.
REFS = """
SELECT CASE k % 8 WHEN 0 THEN h WHEN 1 THEN substr(h, 1, 3) WHEN 2 THEN substr(h, 1, 4) WHEN 3 THEN substr(h, 1, 5)
    WHEN 4 THEN upper(substr(h, 1, 7)) WHEN 5 THEN substr(h, 1, 12) WHEN 6 THEN upper(h)
    ELSE concat('zz', substr(h, 1, 4)) END AS ref
FROM (SELECT c_custkey AS k, sha1(concat('task-', CAST(c_custkey * 7 + 3 AS STRING))) AS h FROM {customer}) c
"""

# Refs that mostly miss: short prefixes, inner parts of ids, words of titles.
NEAR_REFS = """
SELECT CASE k % 6 WHEN 0 THEN substr(h, 1, 4) WHEN 1 THEN upper(substr(h, 1, 3)) WHEN 2 THEN substr(h, 10, 6)
    WHEN 3 THEN concat('Customer ', CAST(k AS STRING)) WHEN 4 THEN concat('order ', CAST(k AS STRING))
    ELSE concat('zz', substr(h, 1, 4)) END AS ref
FROM (SELECT c_custkey AS k, sha1(concat('task-', CAST(c_custkey * 7 + 3 AS STRING))) AS h FROM {customer}) c
"""

# Refs with typing errors: replaced, dropped and added characters, near the start and in long ids.
TYPO_REFS = """
SELECT CASE k % 6 WHEN 0 THEN concat(substr(h, 1, 2), 'z', substr(h, 4, 5))
    WHEN 1 THEN concat(substr(h, 1, 3), substr(h, 5, 6), 'x')
    WHEN 2 THEN concat(substr(h, 1, 10), 'zz', substr(h, 13, 28))
    WHEN 3 THEN upper(substr(h, 1, 9)) WHEN 4 THEN substr(h, 8, 7)
    ELSE concat('x', substr(h, 1, 4), substr(h, 6, 16)) END AS ref
FROM (SELECT c_custkey AS k, sha1(concat('task-', CAST(c_custkey * 7 + 3 AS STRING))) AS h FROM {customer}) c
"""

# Tasks with titles of 6 to some 80 letters, many of them equal.
TITLED = f"""
SELECT * FROM (SELECT id, state, priority, created, CASE length(title) % 5 WHEN 0 THEN concat(title, '. ', description) WHEN 1 THEN substr(title, 1, 8 + length(description) % 9)
    WHEN 2 THEN concat('Review of ', author) WHEN 3 THEN concat('Fix', substr(title, 6, 6)) ELSE title END AS title
  FROM ({TASKS}) t) named
"""

# Titles with typing errors: none, one, two and more; in short and long ones.
TYPO_TITLES = f"""
SELECT CASE k % 8 WHEN 0 THEN upper(title) WHEN 1 THEN concat(substr(title, 1, 4), substr(title, 6)) WHEN 2 THEN concat(substr(title, 1, 2), 'xy', substr(title, 5))
    WHEN 3 THEN concat('z', title, '!') WHEN 4 THEN concat(substr(title, 2, 4), substr(title, 7)) WHEN 5 THEN concat(substr(title, 1, 3), 'ab', substr(title, 4), 'c')
    WHEN 6 THEN concat(substr(title, 1, 5), 'w', substr(title, 7)) ELSE concat(substr(title, 1, length(title) - 2), 'q') END AS ref
FROM (SELECT c_custkey AS k, title FROM ({TITLED}) t JOIN {{customer}} c ON t.id = sha1(concat('task-', CAST(c_custkey * 7 + 3 AS STRING)))) c
"""

# Stretches of the documents themselves, one per document: plain ones, with wildcards, in upper case, of nothing but short pieces.
TEXT_SEARCHES = """
SELECT CASE k % 6 WHEN 0 THEN substr(text, 20, 12) WHEN 1 THEN concat(substr(text, 5, 6), '%', substr(text, 60, 5)) WHEN 2 THEN upper(substr(text, 30, 9))
    WHEN 3 THEN concat(substr(text, 11, 4), '_', substr(text, 16, 4)) WHEN 4 THEN concat(substr(text, 40, 2), '%', substr(text, 80, 2), '_', substr(text, 90, 1), CAST(k AS STRING))
    ELSE concat(substr(text, 8, 20), CASE WHEN k % 12 = 5 THEN 'none' ELSE '' END) END AS q
FROM (SELECT doc_id AS k, text FROM {documents}) d
"""

# Refs of one to five characters, and some longer than any id.
SHORT_REFS = """
SELECT CASE k % 8 WHEN 0 THEN substr(h, 1, 1 + k % 5) WHEN 1 THEN concat('z', substr(h, 2, 1)) WHEN 2 THEN concat(substr(h, 1, 2), 'z')
    WHEN 3 THEN concat('Z', substr(h, 1, 3)) WHEN 4 THEN concat(substr(h, 1, 3), 'zz') WHEN 5 THEN concat(h, 'x')
    WHEN 6 THEN concat(substr(h, 1, 20), 'xy', substr(h, 21, 20)) ELSE concat(h, 'xyz') END AS ref
FROM (SELECT c_custkey AS k, sha1(concat('task-', CAST(c_custkey * 7 + 3 AS STRING))) AS h FROM {customer}) c
"""

# Search queries with wildcards, backslashes and upper case.
SEARCHES = """
SELECT CASE k % 6 WHEN 0 THEN concat('customer ', CAST(k AS STRING)) WHEN 1 THEN concat('ORDER ', CAST(k AS STRING))
    WHEN 2 THEN concat('total ', CAST(k AS STRING), '%. priority 1') WHEN 3 THEN concat('order _', CAST(k AS STRING), ' for')
    WHEN 4 THEN concat('1-urgent', chr(92), CAST(k AS STRING)) ELSE concat('customer%', CAST(k AS STRING), '_') END AS q
FROM (SELECT s_suppkey AS k FROM {supplier}) s
"""

MESSAGES = """
SELECT doc_id, text,
  CASE doc_id % 5 WHEN 0 THEN 'bug' WHEN 1 THEN 'FEATURE' WHEN 2 THEN 'regression' WHEN 3 THEN 'BUG' ELSE CASE WHEN doc_id % 3 = 0 THEN 'chore' ELSE 'feature' END END AS kind,
  CASE doc_id % 7 WHEN 0 THEN 'high' WHEN 1 THEN 'low' WHEN 2 THEN CASE WHEN doc_id % 2 = 0 THEN 'urgent' ELSE 'medium' END END AS priority,
  concat('doc:', CAST(doc_id AS STRING)) AS source,
  lang AS tags
FROM {documents}
"""

# Texts with here-document endings, one or two, at their end or inside.
HEREDOCS = """
SELECT doc_id, concat(coalesce(text, ''), CASE doc_id % 7 WHEN 0 THEN concat(chr(10), 'EOF < /dev/null') WHEN 1 THEN concat(chr(10), 'END < /dev/null', chr(10), ' ')
    WHEN 2 THEN concat(chr(10), 'EOL < /dev/null', chr(10), 'DONE < /dev/null') WHEN 3 THEN concat(chr(10), 'EOF < /dev/null', chr(10), 'the end')
    WHEN 4 THEN ' EOL < /dev/null' ELSE '' END) AS text
FROM {documents}
"""

# A feed of messages in deliveries, an hour of messages each. Some come again in the same
# delivery or the next one, some come three deliveries late, a few have lost their time.
DELIVERIES = 9
FEED = f"""
SELECT doc_id, text, kind, priority, source, tags, CASE WHEN doc_id % 53 <> 17 THEN at_second END AS at_second,
  hour + CASE WHEN doc_id % 11 = 3 THEN 3 ELSE 0 END + CASE WHEN copy = 1 THEN 1 ELSE 0 END AS delivery
FROM (
  SELECT m.*, 1705312800 + CAST(floor(doc_id * 21600.0 / n) AS BIGINT) AS at_second, CAST(floor(doc_id * 5.0 / n) AS INT) AS hour
  FROM ({MESSAGES}) m, (SELECT max(doc_id) + 1 AS n FROM {{documents}}) s
) d JOIN (SELECT 0 AS copy UNION ALL SELECT 1 UNION ALL SELECT 2) c
  ON copy = 0 OR copy = 1 AND doc_id % 7 = 2 OR copy = 2 AND doc_id % 7 = 4
"""
REDELIVERY = 3600

SUBTASK_MESSAGES = """
SELECT doc_id, text,
  CASE doc_id % 4 WHEN 0 THEN 'bug' WHEN 1 THEN 'FEATURE' WHEN 2 THEN 'Regression' ELSE 'regression' END AS kind,
  CASE doc_id % 3 WHEN 0 THEN 'high' WHEN 1 THEN 'low' END AS priority,
  CASE doc_id % 5 WHEN 0 THEN h WHEN 1 THEN substr(h, 1, 8) WHEN 2 THEN upper(substr(h, 1, 9)) WHEN 3 THEN substr(h, 1, 4)
    ELSE concat('none', CAST(doc_id AS STRING)) END AS parent_ref
FROM (SELECT *, sha1(concat('task-', CAST(doc_id * 10 AS STRING))) AS h FROM {documents}) d
"""

# Messages of families: chains six deep, a parent that comes later, rings of four, keys of no row, existing parents.
FAMILY_MESSAGES = """
SELECT doc_id, text, CASE WHEN doc_id % 31 = 4 THEN 'chore' ELSE CASE doc_id % 3 WHEN 0 THEN 'bug' WHEN 1 THEN 'FEATURE' ELSE 'Regression' END END AS kind,
  CASE doc_id % 4 WHEN 0 THEN 'high' WHEN 1 THEN 'low' END AS priority,
  CASE WHEN doc_id % 10 BETWEEN 1 AND 6 THEN doc_id - 1 WHEN doc_id % 10 = 7 THEN doc_id + 1 WHEN doc_id % 20 = 9 THEN -1 - doc_id
    WHEN doc_id % 50 = 20 THEN doc_id + 3 END AS parent_key,
  CASE WHEN doc_id % 20 = 19 THEN CASE WHEN doc_id % 60 = 19 THEN 'none' ELSE substr(sha1(concat('task-', CAST(doc_id * 10 AS STRING))), 1, 12) END END AS parent_ref
FROM {documents}
"""

# New rows: existing ids, repeated ids, broken links and invalid fields among good ones.
NEW_ROWS = """
SELECT k AS n,
  CASE k % 5 WHEN 0 THEN sha1(concat('task-', CAST(k AS STRING))) WHEN 3 THEN sha1(concat('new-', CAST(k - 1 AS STRING)))
    ELSE sha1(concat('new-', CAST(k AS STRING))) END AS id,
  CASE k % 7 WHEN 0 THEN sha1(concat('gone-', CAST(k AS STRING))) WHEN 1 THEN sha1(concat('task-', CAST(k AS STRING))) END AS parent,
  'low' AS priority, 'INBOX' AS state,
  CASE WHEN k % 13 = 0 THEN 'CHORE' ELSE 'FEATURE' END AS kind,
  CASE WHEN k % 11 = 0 THEN '  ' ELSE c_name END AS title,
  c_mktsegment AS description,
  'A customer <a@example.com>' AS author,
  CAST('2024-01-15 10:30:00' AS TIMESTAMP) AS created, CAST('2024-01-15 10:30:00' AS TIMESTAMP) AS updated,
  '' AS source,
  CASE k % 6 WHEN 0 THEN sha1(concat('task-', CAST(k + 1 AS STRING))) WHEN 1 THEN CASE WHEN k % 4 = 0 THEN 'nobody' END END AS blocked_by,
  'imported' AS tags
FROM (SELECT *, c_custkey AS k FROM {customer}) c
"""

# New families: each customer's row hangs below the one before, up to three deep. Some come
# before their parent, some repeat an id, have none or hang below a refused row.
FAMILY_ROWS = """
SELECT CASE WHEN k % 37 = 5 THEN k + 1000000000 ELSE k END AS n,
  CASE WHEN k % 41 = 7 THEN NULL WHEN k % 29 = 3 THEN sha1(concat('new-', CAST(k - 1 AS STRING))) ELSE sha1(concat('new-', CAST(k AS STRING))) END AS id,
  CASE k % 4 WHEN 0 THEN CASE WHEN k % 3 = 0 THEN sha1(concat('task-', CAST(k AS STRING))) END
    ELSE sha1(concat('new-', CAST(k - 1 AS STRING))) END AS parent,
  'low' AS priority, 'INBOX' AS state,
  CASE WHEN k % 23 = 0 THEN 'CHORE' ELSE 'FEATURE' END AS kind,
  c_name AS title, c_mktsegment AS description,
  'A customer <a@example.com>' AS author,
  CAST('2024-01-15 10:30:00' AS TIMESTAMP) AS created, CAST('2024-01-15 10:30:00' AS TIMESTAMP) AS updated,
  '' AS source, CAST(NULL AS STRING) AS blocked_by, 'imported' AS tags
FROM (SELECT *, c_custkey AS k FROM {customer}) c
"""

# Changes to existing and unknown rows, two to most, some invalid.
FIELD_CHANGES = """
SELECT k AS n,
  CASE WHEN k % 9 = 0 THEN sha1(concat('gone-', CAST(k AS STRING))) ELSE sha1(concat('task-', CAST(k - k % 2 AS STRING))) END AS id,
  CASE k % 8 WHEN 0 THEN sha1(concat('gone-', CAST(k AS STRING))) WHEN 1 THEN sha1(concat('task-', CAST(k * 2 + 1 AS STRING))) END AS parent,
  CASE WHEN k % 12 = 5 THEN 'urgent' ELSE 'high' END AS priority,
  'IN_PROGRESS' AS state, 'BUG' AS kind,
  concat('Changed by ', c_name) AS title, c_mktsegment AS description,
  'A customer <a@example.com>' AS author, concat('crm:', CAST(k AS STRING)) AS source,
  CAST(NULL AS STRING) AS blocked_by, 'changed' AS tags
FROM (SELECT *, c_custkey AS k FROM {customer}) c
"""

DELETIONS = """
SELECT CASE c_custkey % 10 WHEN 4 THEN concat('none', CAST(c_custkey AS STRING))
    ELSE sha1(concat('task-', CAST(c_custkey AS STRING))) END AS id
FROM {customer}
"""

TRANSITIONS = """
SELECT k AS seq,
  CASE WHEN k % 17 = 3 THEN sha1(concat('task-', CAST(k - 1 AS STRING)))
    ELSE CASE k % 9 WHEN 1 THEN substr(h, 1, 10) WHEN 2 THEN upper(substr(h, 1, 12)) WHEN 3 THEN substr(h, 1, 4)
      WHEN 8 THEN concat('none', CAST(k AS STRING)) ELSE h END END AS ref,
  CASE k % 7 WHEN 0 THEN 'accept' WHEN 1 THEN 'reject' WHEN 2 THEN 'in-progress' WHEN 3 THEN 'done' WHEN 4 THEN 'cancel'
    WHEN 5 THEN 'reopen' ELSE CASE WHEN k % 2 = 0 THEN 'done' ELSE 'close' END END AS command
FROM (SELECT o_orderkey AS k, sha1(concat('task-', CAST(o_orderkey AS STRING))) AS h FROM {orders}) o
"""

BLOCKS = """
SELECT k AS seq,
  CASE WHEN k % 11 = 4 THEN concat('none', CAST(k AS STRING)) WHEN k % 6 = 5 THEN sha1(concat('task-', CAST(k - 1 AS STRING)))
    ELSE substr(h, 1, 10) END AS ref,
  CASE WHEN k % 5 = 0 THEN h WHEN k % 7 = 0 THEN concat('none', CAST(k AS STRING)) WHEN k % 8 = 1 THEN substr(h, 1, 4)
    ELSE upper(substr(sha1(concat('task-', CAST(k - k % 10 AS STRING))), 1, 11)) END AS by_ref
FROM (SELECT o_orderkey AS k, sha1(concat('task-', CAST(o_orderkey AS STRING))) AS h FROM {orders}) o
"""

UNBLOCKS = """
SELECT k AS seq,
  CASE WHEN k % 13 = 4 THEN concat('none', CAST(k AS STRING)) WHEN k % 10 = 8 THEN sha1(concat('task-', CAST(k - 1 AS STRING)))
    ELSE substr(h, 1, 10) END AS ref
FROM (SELECT o_orderkey AS k, sha1(concat('task-', CAST(o_orderkey AS STRING))) AS h FROM {orders}) o
"""

# Tables each text reads.
TABLES = ("orders", "events", "customer", "supplier", "documents")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def feed(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the test tables as a stream; a table is one file or a folder of them.

    A stream refuses the plain path of a file, but takes a pattern that fits the file or the folder.
    """
    return spark.readStream.schema(table(spark, sf_dir, name).schema).parquet(f"{sf_dir}/{name}.parque[t]")


def spread(df: DataFrame) -> DataFrame:
    """Hand a table of few files to all cores; one of many files is left as it is.

    For operators that do much work per row. A large table is read in more parts than
    the cluster has cores and is not shuffled.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def derive(spark: SparkSession, sf_dir: str, text: str, busy: bool = False) -> DataFrame:
    """One of the texts above as a DataFrame, spread over the cores if much is done per row."""
    used = {name: table(spark, sf_dir, name) for name in TABLES if "{" + name + "}" in text}
    if busy:
        used = {name: spread(df) for name, df in used.items()}
    return spark.sql(text, **used)


def plain(text: str) -> str:
    """One of the texts above over tables known by their bare names."""
    return text.format(**{name: name for name in TABLES})
