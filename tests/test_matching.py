"""Lookups against brute force in plain Python."""

import random
import re

import pytest
from conftest import sha, task
from pyspark.sql import functions as F

from tasklattice.operators import matching, textindex


def ref_table(spark, refs):
    return spark.createDataFrame([(r,) for r in refs], "ref string")


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(7)
    words = ["Order", "customer", "leak", "crash", "menu", "50%", "a_b", "x\\y"]
    made = []
    for i in range(240):
        title = f"{rng.choice(words)} {rng.choice(words)} {i}"
        row = task(
            i, title=title, description=" ".join(rng.choices(words, k=4)), state=rng.choice(["NEW", "DONE", "IN_PROGRESS", "INBOX"]),
            priority=rng.choice(["high", "medium", "low", None]), created=rng.randrange(5),
        )
        if i < 80:  # ids that share most of their text
            row["id"] = f"task-{i:035d}"
        made.append(row)
    return made


@pytest.fixture(scope="module")
def tasks(make_tasks, rows):
    return make_tasks(*rows)


def list_key(row):
    state = {"IN_PROGRESS": 0, "NEW": 1}.get(row["state"], 2)
    priority = {"high": 0, "medium": 1, "low": 2}.get(row["priority"], -1)
    return (state, priority, -row["created"].timestamp(), row["id"])


def open_in_order(rows):
    return sorted((r for r in rows if r["state"] != "DONE"), key=list_key)


def resolve_one(ref, rows):
    ids = [r["id"] for r in rows]
    if ref in ids:
        return ref, "OK"
    hits = [i for i in ids if i.startswith(ref.lower())] if 4 <= len(ref) < 40 else []
    if len(hits) == 1:
        return hits[0], "OK"
    return None, "AMBIGUOUS" if hits else "NOT_FOUND"


REFS = [
    *(sha(i)[:n] for i in range(100, 130) for n in (3, 4, 6, 39, 40)),
    *(sha(i)[:9].upper() for i in range(130, 140)),
    sha(150).upper(), "task", "task-0000", "task-" + "0" * 34 + "7", "zzzz", "", "abc", "Ä" * 5,
]


def test_resolve(spark, tasks, rows):
    got = {r.ref: (r.id, r.status) for r in matching.resolve(ref_table(spark, REFS * 2), tasks).collect()}
    assert got == {ref: resolve_one(ref, rows) for ref in set(REFS)}
    assert got["task"][1] == "AMBIGUOUS"


def test_suggest(spark, tasks, rows):
    refs = REFS + ["order", "CRASH", "leak 1", "00007", "a_b", "50%", "x\\y", sha(200)[5:11], sha(201)[20:23]]
    expected = set()
    for ref in set(refs):
        if resolve_one(ref, rows)[1] == "OK" or ref == "":
            continue
        low, pool = ref.lower(), open_in_order(rows)
        hits = [("prefix", r) for r in pool if r["id"].startswith(low)]
        if not hits:
            hits = [("id", r) for r in pool if low in r["id"]] + [("title", r) for r in pool if low in r["title"].lower()]
        for pos, (hit, r) in enumerate(hits[:3], 1):
            expected.add((ref, pos, hit, r["id"], f"{r['id'][:7]} ({r['title']})"))
    got = {tuple(r) for r in matching.suggest(ref_table(spark, refs), tasks).select("ref", "pos", "hit", "id", "suggestion").collect()}
    assert got == expected
    assert {h for _, _, h, _, _ in got} == {"prefix", "id", "title"}


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_fuzzy(spark, tasks, rows):
    rng = random.Random(3)
    refs = []
    for i in range(90):
        text = rng.choice(rows)["id"][: rng.choice([1, 2, 3, 4, 5, 6, 7, 9, 12, 13, 20, 40])]
        for _ in range(rng.randrange(4)):
            at, op = rng.randrange(len(text) or 1), rng.randrange(3)
            text = text[:at] + ["", "z", text[at : at + 1] + "q"][op] + text[at + 1 :]
        refs.append(text)
    refs += ["short", sha(220)[8:15], "task-" + "0" * 36, sha(220) + "xy", sha(220) + "xyz", "é", ""]
    expected = set()
    for ref in set(refs) - {""}:
        pool = open_in_order(rows)
        classes = (
            ("prefix", [(r, 0) for r in pool if r["id"].startswith(ref)]),
            ("substring", [(r, None) for r in pool if ref in r["id"]]),
            ("distance", [(r, d) for r in pool if (d := distance(ref, r["id"][: len(ref)])) <= 2]),
        )
        name, hits = next(((n, h) for n, h in classes if h), (None, []))
        for pos, (r, d) in enumerate(hits[:3], 1):
            expected.add((ref, pos, name, r["id"], d))
    got = {tuple(r) for r in matching.fuzzy_match(ref_table(spark, refs), tasks).select("ref", "pos", "hit", "id", "distance").collect()}
    assert got == expected
    assert {h for _, _, h, _, _ in got} == {"prefix", "substring", "distance"}


def test_short_refs_meet_the_first_ids_only(spark, make_tasks, monkeypatch):
    """Refs that are near to very many ids: the first three of them, found without writing all pairs; and long refs among them."""
    written, plain = [], matching.materialise
    monkeypatch.setattr(matching, "materialise", lambda df: (table := plain(df), written.append((table.columns, table.count())))[0])
    monkeypatch.setattr(matching, "FEW_IDS", 100, raising=False)
    rng = random.Random(4)
    rows = [task(f"id {n}", created=rng.randrange(900), priority=rng.choice(["high", "low"])) for n in range(2000)]
    refs = ["z" + "".join(rng.choice("0123456789abcdef") for _ in range(2)) for _ in range(80)]
    for n in range(40):
        text = rng.choice(rows)["id"][: 14 + n % 27]
        for _ in range(2):
            at = rng.randrange(len(text))
            text = text[:at] + rng.choice(["", "z", "7"]) + text[at + rng.randrange(2) :]
        refs.append(text)
    refs += [rows[0]["id"] + "xy", "xy" + rows[1]["id"], "xy" + rows[2]["id"][:30], rows[3]["id"] + "xyz"]
    pool, expected, pairs = open_in_order(rows), set(), 0
    for ref in set(refs):
        if not any(ref in r["id"] for r in pool):
            near = [(r["id"], d) for r in pool if (d := distance(ref, r["id"][: len(ref)])) <= 2]
            expected |= {(ref, pos, "distance", *hit) for pos, hit in enumerate(near[:3], 1)}
            pairs += len(near)
    got = {tuple(r) for r in matching.fuzzy_match(ref_table(spark, refs), make_tasks(*rows)).where("hit = 'distance'").select("ref", "pos", "hit", "id", "distance").collect()}
    assert got == expected
    near = [n for columns, n in written if columns == ["low_ref", "place", "distance"]]
    assert max(near) < pairs / 4


def test_stretches_of_lookups_are_not_broadcast(spark, monkeypatch):
    plans, plain = [], matching.materialise
    monkeypatch.setattr(matching, "materialise", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or plain(df))
    lookups = plain(spark.createDataFrame([(sha(n)[:30],) for n in range(20)], "low_ref string"))
    assert matching._anchored(lookups, "low_ref", F.array("low_ref")).count() == 20
    assert "SortMergeJoin [anchor" in plans[0]


def test_what_is_shuffled_for_near_ids(spark):
    """Refs of many lengths: all near ids, and few keys of the ids outlive the filter."""
    rng = random.Random(11)
    ids = [sha(f"id {n}") for n in range(400)]
    refs = []
    for n, text in enumerate(rng.sample(ids, 60)):
        text = text[: 6 + n % 35]
        for _ in range(2):
            at = rng.randrange(len(text))
            text = text[:at] + rng.choice(["", "z", "7"]) + text[at + rng.randrange(2) :]
        refs.append(text)
    low = lambda texts: spark.createDataFrame([(t,) for t in sorted(set(texts))], "low_ref string")
    table = spark.createDataFrame(list(enumerate(ids)), "place long, low_id string")
    got = {tuple(r) for r in matching._near_ids(low(refs), table, len(ids)).select("low_ref", "place", "distance").collect()}
    assert got == {(r, n, d) for r in set(refs) for n, text in enumerate(ids) if (d := distance(r, text[: len(r)])) <= 2}

    test = matching._wanted(low(refs))
    assert low(refs).where(test(F.col("low_ref"))).count() == len(set(refs))
    assert low(ids).where(test(F.col("low_ref"))).count() < len(ids) / 4
    assert {r.low_ref for r in matching._possible(low(["abz", "z", ids[0], ids[0] + "x"]), table, "low_id").collect()} == {ids[0]}


def test_search_many(spark, tasks, rows):
    queries = ["order", "ORDER c", "leak%1", "_", "%", "", "50%", "50\\%", "a_b", "x\\y", "\\", "crash menu 1", "%%", "r_1", "none such", "menu%crash", "o"]
    expected = set()
    for q in queries:
        shape = "".join(".*" if c == "%" else "." if c == "_" else re.escape(c) for c in q.lower())
        for r in rows:
            if any(re.search(shape, r[f].lower(), re.S) for f in ("title", "description")):
                expected.add((q, r["id"]))
    got = matching.search_many(tasks, spark.createDataFrame([(q,) for q in queries * 2], "q string")).collect()
    assert {tuple(r) for r in got} == expected
    assert len(got) == len(expected)


def test_search_many_writes_no_postings(spark, tasks, monkeypatch):
    """What is written grows with the queries, not with the texts or with what they share."""
    written = []
    for module in (matching, textindex):
        plain = module.materialise
        monkeypatch.setattr(module, "materialise", lambda df, plain=plain: (table := plain(df), written.append(table.count()))[0])
    queries = spark.createDataFrame([("order%1",), ("menu 1",), ("k m",)], "q string")
    assert matching.search_many(tasks, queries).count() > 0
    assert max(written) <= 3


def test_fuzzy_titles(spark, make_tasks):
    """Titles of 1 to 80 letters, equal ones, and refs with up to three typing errors."""
    rng = random.Random(5)
    letters = "abcd éß"
    rows = []
    for i in range(160):
        title = "".join(rng.choice(letters) for _ in range(rng.choice([1, 2, 3, 5, 8, 9, 10, 11, 15, 40, 80])))
        if i % 5 == 0 and rows:
            title = rng.choice(rows)["title"]
        rows.append(task(i, title=title, state=rng.choice(["NEW", "DONE", "INBOX"]), created=rng.randrange(5)))
    rows += [task(f"same {i}", title="The same Title", created=i) for i in range(30)]
    refs = ["the same titel", "", "a", "zz", "q" * 90]
    for _ in range(150):
        text = rng.choice(rows)["title"]
        for _ in range(rng.randrange(4)):
            at, op = rng.randrange(len(text) + 1), rng.randrange(3)
            text = text[:at] + ["", "z", text[at : at + 1] + "q"][op] + text[at + 1 :]
        refs.append(text.upper() if rng.random() < 0.2 else text)
    expected = set()
    for ref in set(refs) - {""}:
        near = [(d, list_key(r), r) for r in open_in_order(rows) if abs(len(r["title"]) - len(ref)) <= 3 and (d := distance(ref.lower(), r["title"].lower())) <= 2]
        for pos, (d, _, r) in enumerate(sorted(near, key=lambda hit: hit[:2])[:3], 1):
            expected.add((ref, pos, r["id"], r["title"], d))
    got = [tuple(r) for r in matching.fuzzy_titles(ref_table(spark, refs * 2), make_tasks(*rows)).collect()]
    assert set(got) == expected and len(got) == len(expected)


def test_many_titles_alike_are_not_all_paired(spark, make_tasks, monkeypatch):
    """Of titles that are all near each other, what is written grows with the refs and not with their pairs."""
    written, plain = [], matching.materialise
    monkeypatch.setattr(matching, "materialise", lambda df: (table := plain(df), written.append(table.count()))[0])
    rows = [task(i, title=title, created=i % 7) for i in range(400) for title in [f"Fix {i:04d}" if i % 2 else f"Invoice reminder {i:04d}"]]
    refs = [rows[i]["title"][:2] + "x" + rows[i]["title"][2 + i % 3 % 2 :] for i in range(400)] + [r["title"] for r in rows]
    expected = set()
    for ref in set(refs):
        near = [(d, list_key(r), r) for r in rows if abs(len(r["title"]) - len(ref)) <= 2 and (d := distance(ref.lower(), r["title"].lower())) <= 2]
        expected |= {(ref, pos, r["id"], r["title"], d) for pos, (d, _, r) in enumerate(sorted(near, key=lambda hit: hit[:2])[:3], 1)}
    exact = [r["title"] for r in rows]
    got = {tuple(r) for r in matching.fuzzy_titles(ref_table(spark, refs), make_tasks(*rows)).collect()}
    assert got == expected
    written.clear()
    assert matching.fuzzy_titles(ref_table(spark, exact), make_tasks(*rows)).count() == 3 * len(exact)
    assert max(written) < 80 * len(exact)


def test_long_titles_alike_in_most_parts_meet_few(spark):
    """Titles of the same words and other numbers: all near pairs, and few beside them."""
    rng = random.Random(9)
    titles = [f"order {rng.randrange(10**6)} for customer {rng.randrange(10**5)}" for _ in range(300)]
    titles += [f"review of customer {n} <c{n}@example.com>" for n in rng.sample(range(10**5), 100)]
    refs = []
    for text in rng.sample(titles, 60):
        for _ in range(rng.randrange(3)):
            at = rng.randrange(len(text) + 1)
            text = text[:at] + rng.choice(["", "z", "7"]) + text[at + rng.randrange(2) :]
        refs.append(text)
    low = lambda texts, name: spark.createDataFrame([(t,) for t in sorted(set(texts))], f"{name} string")
    pairs = {tuple(r) for r in matching._long_pairs(low(refs, "low_ref"), low(titles, "low_title")).collect()}
    near = {(r, t) for r in set(refs) for t in set(titles) if abs(len(r) - len(t)) <= 2 and distance(r, t) <= 2}
    assert not near - pairs
    assert len(pairs) < 20 * len(refs)


def test_stored_index(spark, tmp_path):
    """Long texts, null ones, repeated rows; queries that cross lines, hold quotes of patterns, or are nearly empty."""
    rng = random.Random(8)
    words = ["alpha", "Beta\n", "x\\Ey", "50%", "é", "ab", "."]
    texts = [(i, " ".join(rng.choices(words, k=rng.choice([1, 3, 40])))) for i in range(60)] + [(60, None), (61, ""), (62, "ab " * 40_000 + "end")]
    rows = spark.createDataFrame(texts, "n int, body string")
    textindex.write_index(rows, f"{tmp_path}/index", "n", ["body"])
    index = textindex.read_index(spark, f"{tmp_path}/index", rows, "n", ["body"])
    queries = ["alpha beta", "beta\n", "x\\e_", "x\\Ey", "a%a", "b_ta%é", "é", "_", "%", "", "lpha%50", "none", "b end", "a_ end", ".", "%.%ab", "ab ab ab%end", "___________"]
    expected = set()
    for q in queries:
        shape = "".join(".*" if c == "%" else "." if c == "_" else re.escape(c) for c in q.lower())
        expected |= {(q, n) for n, text in texts if text is not None and re.search(shape, text.lower(), re.S)}
    got = [tuple(r) for r in textindex.search_index(index, spark.createDataFrame([(q,) for q in [*queries, None, "é"]], "q string")).collect()]
    assert set(got) == expected and len(got) == len(expected)
    # Files hold ranges of grams, so a lookup reads few of them.
    plan = index.postings.where("gram = 'alp'")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(gram), EqualTo(gram,alp)]" in plan


def test_queries_of_common_grams_meet_few_texts(spark, tmp_path, monkeypatch):
    """All grams stand in nearly all texts: candidates are near the hits, and pieces with wildcards are still looked for."""
    written, plain = [], textindex.materialise
    monkeypatch.setattr(textindex, "materialise", lambda df: (table := plain(df), written.append((table.columns[-1], table.count())))[0])
    rng = random.Random(6)
    words = ["alpha", "beta", "gamma", "delta", "omega", "sigma"]
    texts = [(n, " ".join(rng.choices(words, k=40)), None if n % 9 else "Beta gamma") for n in range(150)]
    rows = spark.createDataFrame(texts, "n int, body string, note string")
    textindex.write_index(rows, f"{tmp_path}/index", "n", ["body", "note"])
    index = textindex.read_index(spark, f"{tmp_path}/index", rows, "n", ["body", "note"])
    queries = [" ".join(rng.choices(words, k=3)).upper() for _ in range(60)] + ["alpha be%ma sig", "ega_si_ma", "mega_", "a_b%g", "eta", "none such", "beta alpha none"]
    expected = set()
    for q in queries:
        shape = "".join(".*" if c == "%" else "." if c == "_" else re.escape(c) for c in q.lower())
        expected |= {(q, n) for n, *both in texts if any(text and re.search(shape, text.lower()) for text in both)}
    written.clear()
    got = [tuple(r) for r in textindex.search_index(index, spark.createDataFrame([(q,) for q in queries], "q string")).collect()]
    assert set(got) == expected and len(got) == len(expected)
    assert max(n for column, n in written if column == "id") < 3 * len(got)


def test_no_nested_loops(spark, tasks):
    """Every lookup joins by equality and stays in the JVM."""
    refs = ref_table(spark, ["abcd", "order 1"])
    for result in (
        matching.resolve(refs, tasks),
        matching.suggest(refs, tasks),
        matching.fuzzy_match(refs, tasks),
        matching.fuzzy_titles(refs, tasks),
        matching.search_many(tasks, refs.select(F.col("ref").alias("q"))),
    ):
        plan = result._jdf.queryExecution().executedPlan().toString()
        for operator in ("NestedLoop", "CartesianProduct", "Python"):
            assert operator not in plan
