"""Small cases and brute-force comparisons for the training-data operators."""

from __future__ import annotations

import random
import tracemalloc
import zlib
from collections import Counter

import corpus_pipeline
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tasklattice.llm import embedding_join, html_text, jaccard_join, language_id, line_dedup, maxent_lm, packing, secret_scan, token_counts
from tasklattice.llm.common import LOWER, components, shingle_sets, steps
from tasklattice.llm.decontaminate import clean_documents, contaminated, tile

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def rows_of(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


@pytest.fixture(scope="module")
def words():
    rng = random.Random(5)
    return ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(400)]


@pytest.fixture(scope="module")
def texts(words):
    """Copies, near copies, a shared passage, ties, repeats, and the empty cases."""
    rng = random.Random(9)
    base = [" ".join(rng.choices(words, k=rng.randint(3, 90))) for _ in range(40)]
    passage = " ".join(rng.choices(words, k=60))
    out = [*base, *base[:6]]
    for text in base[:12]:
        tokens = text.split()
        tokens[len(tokens) // 2] = "changed"
        out.append(" ".join(tokens))
    out += [f"{t}\n{passage}" for t in base[20:34]]
    return [*out, None, "", " \n\t", "one", "ONE", "two words here now", "x" * 50_000 + " y " * 3000]


@pytest.fixture(scope="module")
def docs(spark, texts):
    return spark.createDataFrame([(k, t, "en", "s", 0) for k, t in enumerate(texts)] + [(None, None, None, None, None)], SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def brute_groups(texts):
    sets = []
    for text in texts:
        w = (text or "").encode().translate(LOWER).split()
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    label = list(range(len(sets)))
    for _ in sets:
        for i, a in enumerate(sets):
            for j, b in enumerate(sets):
                if a and b and 100 * len(a & b) >= 80 * len(a | b):
                    label[i] = label[j] = min(label[i], label[j])
    return [(k, len(s), label[k]) for k, s in enumerate(sets)]


def test_jaccard_join_equals_brute_force(docs, texts, empty):
    found = jaccard_join.near_duplicates(docs)
    assert rows_of(found.where("doc_id is not null"), "doc_id", "n_shingles", "component_id") == sorted(brute_groups(texts), key=repr)
    assert jaccard_join.near_duplicates(empty).count() == 0
    kept = jaccard_join.keep_one(docs)
    assert kept.columns == docs.columns
    groups = brute_groups(texts)
    assert {r.doc_id for r in kept.collect()} - {None} == {k for k, _, c in groups if k == c}


def test_hot_runs_and_tiles_are_dealt_in_blocks(spark, docs, texts, monkeypatch):
    rng = random.Random(31)
    common = [f"c{k}" for k in range(40)]
    # All share runs, but only some pairs overlap by four fifths.
    group = [" ".join(common + [f"o{k % 5}x{j}" for j in range(rng.randint(1, 25))] + [f"z{k}"]) for k in range(40)]
    expected = sorted(brute_groups([*texts, *group]), key=repr)
    more = spark.createDataFrame(list(enumerate([*texts, *group])), "doc_id long, text string").repartition(3)
    monkeypatch.setattr(jaccard_join, "HOT_RUN", 8)
    monkeypatch.setattr(jaccard_join, "BLOCK_SETS", 6)
    assert rows_of(jaccard_join.near_duplicates(more), "doc_id", "n_shingles", "component_id") == expected
    # One tile of 40 sets, none linked yet: blocks give all its pairs, two blocks at a time.
    rows = [(1, k, 30 + k // 4, bytes(8), k // 3) for k in range(40)]
    marked = spark.createDataFrame(rows, "tile long, sid long, n int, bits binary, label long")
    found = rows_of(jaccard_join._blocked(marked, 80, 6), "a", "b")
    assert found == sorted({(a, b) for _, a, n, _, x in rows for _, b, m, _, y in rows if a < b and x != y and 80 * m <= 100 * n}, key=repr)
    column = pa.table({"tile": [1] * 30, "n": range(30)}).to_batches(max_chunksize=3)
    assert max(c["tile"].size for c in jaccard_join._groups(iter(column), "tile", 6)) == 6


def test_keep_one_keeps_one_of_repeated_rows(spark):
    text = "a b c d e f g"
    docs = spark.createDataFrame([(1, text), (1, text), (2, text), (3, "")] * 2, "doc_id long, text string")
    assert rows_of(jaccard_join.keep_one(docs), "doc_id") == [(1,), (3,), (3,)]


def test_bitmap_bound_never_cuts_a_link():
    rng = np.random.default_rng(3)
    for _ in range(200):
        a = np.unique(rng.integers(0, 2**63, rng.integers(20, 300), dtype=np.uint64))
        b = np.unique(np.concatenate([a[: int(len(a) * 0.93)], rng.integers(0, 2**63, 3, dtype=np.uint64)]))
        batch = pa.RecordBatch.from_pydict({"a": [1], "b": [2], "n_a": [len(a)], "n_b": [len(b)], "bits_a": [jaccard_join.parity_bits(a)], "bits_b": [jaccard_join.parity_bits(b)]})
        both = len(np.intersect1d(a, b))
        if 100 * both >= 80 * (len(a) + len(b) - both):
            assert next(jaccard_join._may_link(80)([batch])).num_rows == 1


def test_components_of_a_chain_and_a_star(spark):
    chain = [(k, k + 1) for k in range(0, 60)]
    star = [(100, k) for k in range(101, 160)]
    found = dict(rows_of(components(spark.createDataFrame(chain + star + [(7, 7)], "a long, b long")), "node", "component"))
    assert {found[k] for k in range(61)} == {0} and {found[k] for k in range(100, 160)} == {100}


def test_line_dedup(spark, empty):
    data = [(k, f"Common  \nown {k}\n\ncommon") for k in range(10)] + [(10, None), (11, ""), (11, ""), (12, "common"), (None, "COMMON\nx")]
    docs = spark.createDataFrame(data, "doc_id long, text string").selectExpr("*", "1 as keep_bitmap", "2 as row")
    bitmaps = line_dedup.keep_bitmaps(docs)
    left = line_dedup.drop_lines(docs, bitmaps)
    expected = [(k, f"own {k}\n") for k in range(10)] + [(10, None), (11, ""), (11, ""), (12, ""), (None, "x")]
    assert rows_of(left, "doc_id", "text") == sorted(expected, key=repr)
    assert left.columns == docs.columns
    first = line_dedup.drop_lines(docs, line_dedup.keep_bitmaps(docs, keep="first"))
    assert sum((r.text or "").lower().count("common") for r in first.collect()) == 1
    assert line_dedup.keep_bitmaps(empty).count() == 0


def test_line_dedup_counts_rows_of_a_null_id_as_one_document(spark):
    large = 1 << 60
    data = [(None, "\n".join(["again"] * 12)), (None, "again"), *((large + k, "near ids") for k in range(10))]
    docs = spark.createDataFrame(data, "doc_id long, text string").coalesce(1)
    left = line_dedup.drop_lines(docs, line_dedup.keep_bitmaps(docs))
    assert rows_of(left, "doc_id", "text") == sorted([*data[:2], *((large + k, "") for k in range(10))], key=repr)


def test_line_dedup_of_a_line_over_many_partitions(spark):
    docs = spark.range(3000).selectExpr("id as doc_id", "concat('every document', chr(10), id) as text").repartition(12)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = line_dedup.drop_lines(docs, line_dedup.keep_bitmaps(docs))
        assert found.where("text <> cast(doc_id as string)").count() == 0
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_language_id(spark, docs, empty):
    data = [(k, "the quick brown fox and the dog " * 3, "en") for k in range(8)] + [(k, "der schnelle braune fuchs und ein hund " * 3, "de") for k in range(8, 16)]
    train = spark.createDataFrame([*data, (99, "ignored", None)], "doc_id long, text string, lang string")
    profiles = language_id.learn_profiles(train)
    tests = spark.createDataFrame([(1, "the dog and the fox"), (2, "der hund und der fuchs"), (3, None), (4, "12 34 !"), (5, ""), (6, "a\0b the")], "doc_id long, text string")
    found = {r.doc_id: r for r in language_id.predict(tests, profiles, [tests["doc_id"]]).collect()}
    assert [found[k].lang_pred for k in range(1, 6)] == ["en", "de", "und", "und", "und"]
    assert all(0 <= r.score <= 1 for r in found.values()) and found[3].score == 0
    nothing = language_id.learn_profiles(empty)
    assert {r.lang_pred for r in language_id.predict(docs, nothing, [docs["doc_id"]]).collect()} == {"und"}


def test_bundles_equal_the_sum_of_bound_letters():
    text = "ab ba"
    letters = [0, *map(ord, "ab"), 0, *map(ord, "ba"), 0]
    total = np.zeros(language_id.DIMENSIONS)
    for k in range(len(letters) - 2):
        if letters[k + 1]:
            a, b, c = (language_id.letter_vector(p) for p in letters[k : k + 3])
            total += np.roll(a, 2).astype(int) * np.roll(b, 1) * c
    assert (language_id.bundles([text.encode()])[0] == total).all()


def test_many_short_texts_are_judged_in_little_memory():
    """A text takes a row of a wide matrix, however short it is; so a step has a bound on texts too."""
    rng = random.Random(3)
    short = ["".join(chr(rng.randrange(0x4E00, 0x9000)) for _ in range(4)).encode() for _ in range(20_000)]
    batch = pa.RecordBatch.from_arrays([pa.array(short, pa.binary())], names=["_text"])
    tracemalloc.start()
    rows = 0
    for some in steps([batch], "_text", language_id._JUDGED_BYTES, language_id._LEAST_BYTES):
        rows += len(language_id.bundles(some.column("_text").to_pylist()))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert rows == len(short) and peak < 250e6


def test_profiles_do_not_depend_on_when_counts_are_merged(words, monkeypatch):
    rng = random.Random(4)
    texts = [" ".join(rng.choices(words, k=40)).encode() for _ in range(300)]
    batches = [pa.RecordBatch.from_arrays([pa.array([rng.choice("ab") for _ in range(30)]), pa.array(texts[at : at + 30], pa.binary())], names=["lang", "text"]) for at in range(0, 300, 30)]
    found = []
    for most in (10, 300, 10**9):
        monkeypatch.setattr(language_id, "_MOST_GRAMS", most)
        [sums] = language_id._sum_languages(iter(batches))
        found.append(dict(zip(sums.column("lang").to_pylist(), sums.column("bundle").to_pylist())))
    assert found[0] == found[1] == found[2] and set(found[0]) == {"a", "b"}
    total = sum(language_id.bundles(texts).astype(float))
    assert (np.array(found[0]["a"]) + np.array(found[0]["b"]) == total).all()


def test_a_text_is_sent_once_when_its_language_is_told(spark, words):
    rows = [(k, t, lang, "web", k) for k, (t, lang) in enumerate([(words[0] * 9, "x"), (None, "x"), ("", None), ("1 2", "x"), ("\0é\n" + words[1], None)])]
    docs = spark.createDataFrame(rows, SCHEMA)
    judged = corpus_pipeline.language_id(spark, docs, "")
    assert judged.schema == docs.schema and rows_of(judged, *docs.columns) == rows_of(docs.where("doc_id in (0, 4)"), *docs.columns)
    assert ", text, text#" not in judged._jdf.queryExecution().executedPlan().toString()


def test_tiles_are_longest_first_and_catch_reordering():
    item = np.arange(1, 41, dtype=np.uint64)
    document = np.concatenate([item[25:], np.array([99], np.uint64), item[:25], item[:25]])
    assert tile(document, item) == [(16, 0, 25), (0, 25, 15)]
    assert tile(item[:4], item) == [] and tile(item[:0], item) == []


def test_decontamination(spark, words, empty):
    rng = random.Random(2)
    items = [" ".join(rng.choices(words, k=30)) for _ in range(3)]
    benchmark = spark.createDataFrame([*enumerate(items), (7, None), (8, ""), (9, "short one")], "item_id long, text string")
    parts = items[0].split()
    filler = " ".join(rng.choices(words, k=50))
    data = [(1, f"{filler} {items[1].upper()}, {filler}"), (2, " ".join(parts[15:]) + " || " + " ".join(parts[:15])), (3, filler), (4, " ".join(parts[:10])), (5, None), (6, "short one"), (7, "")]
    docs = spark.createDataFrame(data, "doc_id long, text string").selectExpr("*", "1 as item_id", "doc_id as coverage")
    assert rows_of(contaminated(docs, benchmark), "doc_id", "item_id") == [(1, 1), (2, 0), (6, 9)]
    left = clean_documents(docs, benchmark)
    assert left.columns == docs.columns and rows_of(left, "doc_id") == [(3,), (4,), (5,), (7,)]
    assert contaminated(empty, benchmark).count() == 0
    assert contaminated(docs, benchmark.limit(0)).count() == 0 and clean_documents(docs, benchmark.limit(0)).count() == 7


def test_packing_round_trip(docs, texts, empty):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.default_tokenizer())
    found = packing.pack(packing.cut_pieces(docs)).collect()
    ids = {k: [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2] for k, t in enumerate(texts)} | {None: [2]}
    held = Counter()
    ends = {}
    for r in sorted(found, key=lambda r: (r.sequence_id, r.offset)):
        piece = np.array(ids[r.doc_id][r.start : r.start + r.length], "<u4")
        assert len(piece) == r.length and zlib.crc32(piece.tobytes()) == r.ids_crc32 and r.doc_tokens == len(ids[r.doc_id])
        assert r.offset == ends.get(r.sequence_id, 0)
        ends[r.sequence_id] = r.offset + r.length
        held[r.doc_id] += r.length
    assert held == {k: len(v) for k, v in ids.items()}
    assert max(ends.values()) <= packing.LENGTH and set(ends) == set(range(len(ends)))
    assert packing.pack(packing.cut_pieces(empty)).count() == 0


def test_words_encoded_together_keep_their_own_ids():
    from tokenizers import Tokenizer

    path = packing.default_tokenizer()
    whole = Tokenizer.from_file(path)
    for text in ("It's a1b2, Ñandú ñ <|endoftext|>x y<|endof z|> < <|startoftext|>", "İSTANBUL \u212a h\u0331 H\u0331 a\u0085b\u00a0c \u3000d", " ".join(f"w{k}x" for k in range(300)), ""):
        packing._young.clear()
        packing._old.clear()
        ids = np.frombuffer(packing.encode(text.encode(), path), "<u4")
        assert ids.tolist() == whole.encode(text, add_special_tokens=False).ids


def test_a_word_is_encoded_once_whatever_its_case_and_the_marks_behind(monkeypatch):
    from tokenizers import Tokenizer

    path, sent, joined = packing.default_tokenizer(), [], packing._joined_ids
    whole = Tokenizer.from_file(path)
    monkeypatch.setattr(packing, "_joined_ids", lambda tokenizer, words, between: sent.extend(words) or joined(tokenizer, words, between))
    text = "thouwh Thouwh. THOUWH### thouwh, \u00c9l\u00e9e \u00e9l\u00e9e... ### \u01c5u. \u0130n. e\u0301. don't. x1. ,a \ufb01n. \u03a3\u03c2. K\u212a."
    packing._tokenizers.clear()
    rows = [text, "", "  ", f" {text}  {text} "]
    ids, edges = packing.encode_all(pa.array([t.encode() for t in rows], pa.binary()), path)
    assert [ids[a:b].tolist() for a, b in zip(edges, edges[1:])] == [whole.encode(t, add_special_tokens=False).ids for t in rows]
    assert (sent.count("thouwh"), sent.count("\u00e9l\u00e9e"), sent.count("###"), sent.count("don't.")) == (1, 1, 1, 1)
    assert len(sent) == len(set(sent)) and not [w for w in sent if w.lower().startswith("thouwh") and w != "thouwh"]


def test_patterns_cover_the_counts_and_are_near_the_bound():
    rng = np.random.default_rng(1)
    counts = np.zeros(64, np.int64)
    counts[:40] = rng.integers(0, 500, 40)
    patterns = packing.solve_patterns(counts, 64)
    assert (sum(p * t for p, t in patterns) == counts).all()
    assert all((p * np.arange(1, 65)).sum() <= 64 for p, _ in patterns)
    least = (counts * np.arange(1, 65)).sum() / 64
    assert sum(t for _, t in patterns) <= 1.02 * least + 2


def test_token_files(spark, docs, texts, empty, tmp_path):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.default_tokenizer())
    folder = str(tmp_path / "tokens")
    token_counts.write_token_files(docs, folder, file_documents=7)
    expected = sorted(len(tokenizer.encode(t or "", add_special_tokens=False).ids) for t in [*texts, None])
    for block in (3, 1000, 1 << 20):
        found = token_counts.scan_token_files(spark, folder, block_tokens=block).collect()
        assert sorted(r.n_tokens for r in found) == expected and all(r.closed for r in found)
    token_counts.write_token_files(empty, str(tmp_path / "none"))


def test_token_counts_of_each_document(spark, texts, tmp_path):
    """Also of a text that says the vocabulary's own separator."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.default_tokenizer())
    rows = [*enumerate([*texts, "hello <|endoftext|> world", None, ""]), (None, "no id")]
    stored = spark.createDataFrame([(k, t, "en", "s", 0) for k, t in rows], SCHEMA).withColumns({n: F.lit("x") for n in ("file", "document", "path", "value", "at")})
    stored.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    found = token_counts.op2_token_counts(spark, str(tmp_path)).collect()
    assert sorted(((r.doc_id, r.n_tokens) for r in found), key=repr) == sorted(((k, len(tokenizer.encode(t or "", add_special_tokens=False).ids)) for k, t in rows), key=repr)
    places = token_counts.document_places(spark.read.parquet(f"{tmp_path}/documents.parquet"), file_documents=7)
    assert places.groupBy("file").count().agg(F.max("count")).first()[0] == 7
    with pytest.raises(Exception, match="separator"):
        token_counts.write_token_files(stored, f"{tmp_path}/tokens", separator=100)


def test_open_document_at_the_end_of_a_file(spark, tmp_path):
    (tmp_path / "a.bin").write_bytes(np.array([5, 6, 9, 9, 7], "<u4").tobytes())
    for block in (1, 2, 100):
        found = token_counts.scan_token_files(spark, str(tmp_path), separator=9, width=4, block_tokens=block)
        assert rows_of(found, "document", "start", "n_tokens", "closed") == [(0, 0, 2, True), (1, 3, 0, True), (2, 4, 1, False)]


def test_token_file_that_spark_refuses_to_read_whole(spark, tmp_path):
    (tmp_path / "a b.bin").write_bytes(np.array([*range(100, 200), 9, 5, 9], "<u2").tobytes())
    (tmp_path / "c.bin").write_bytes(np.array([9, 9], "<u2").tobytes())
    spark.conf.set("spark.sql.sources.binaryFile.maxLength", "50")
    try:
        assert token_counts._blocks(spark, str(tmp_path), 9, 2, 10).groupBy(F.spark_partition_id()).count().count() > 1
        for block in (7, 1000):
            found = token_counts.scan_token_files(spark, str(tmp_path), separator=9, block_tokens=block)
            assert rows_of(found, "document", "start", "n_tokens", "closed") == sorted([(0, 0, 100, True), (1, 101, 1, True), (0, 0, 0, True), (1, 1, 0, True)], key=repr)
    finally:
        spark.conf.unset("spark.sql.sources.binaryFile.maxLength")


def test_embedding_join(spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(30, 12))
    data = np.concatenate([centres + rng.normal(size=(30, 12)) * s for s in (0, 0.1, 0.25, 0.3)] + [centres[:5]] * 3)
    rows = [(k, [float(x) for x in v]) for k, v in enumerate(data)]
    bad = [(900, None), (901, [0.0] * 12), (902, [float("nan")] * 12), (903, [1.0, None] * 6), (904, []), (905, [1.0, 2.0])]
    found = {r.vec_id: r for r in embedding_join.near_vectors(spark.createDataFrame(rows + bad, "vec_id long, embedding array<double>")).collect()}
    units = data / np.linalg.norm(data, axis=1, keepdims=True)
    hits = units @ units.T >= 0.95
    np.fill_diagonal(hits, False)
    label = np.arange(len(data))
    for _ in data:
        label = np.minimum(label, np.where(hits, label[None, :], len(data)).min(axis=1))
    assert [found[k].n_links for k in range(len(data))] == hits.sum(axis=1).tolist()
    assert [found[k].component_id for k in range(len(data))] == label.tolist()
    assert all(found[k].n_links == 0 and found[k].kept for k, _ in bad)
    assert embedding_join.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_blocks_with_leaves_count_every_link_once():
    rng = np.random.default_rng(8)
    data = np.repeat(rng.normal(size=(9, 6)), 100, axis=0) + rng.normal(size=(900, 6)) * 0.05
    nodes, copies = np.arange(900), np.ones(900, np.int64)
    block = embedding_join._Block(nodes.tobytes(), copies.tobytes(), data.tobytes(), 6, np.eye(6)[:, :3])
    embedding_join.join_blocks(block, block, True, np.sqrt(0.1) + 1e-6, 0.95)
    hits = block.units @ block.units.T >= 0.95
    assert (block.links == hits.sum(axis=1) - 1).all()


def test_language_model(spark, docs, texts, empty):
    training = docs.where("doc_id % 3 <> 0")
    model, counts = maxent_lm.train(training)
    known = Counter()
    for k, t in enumerate(texts):
        if k % 3:
            known.update([*(t or "").encode().translate(LOWER).split(), None])
    total, size = sum(known.values()), len(known)
    found = {r.doc_id: r for r in maxent_lm.score(docs, model, counts, [docs["doc_id"]]).collect()}
    for k, t in enumerate(texts):
        tokens = [*(t or "").encode().translate(LOWER).split(), None]
        assert found[k].n_tokens == len(tokens) and found[k].n_known == sum(known[w] > 0 for w in tokens) and found[k].train_tokens == total
        assert found[k].base_score == pytest.approx(sum(np.log10((known[w] + 1) / (total + size + 1)) for w in tokens))
        assert found[k].score < 0
    model, counts = maxent_lm.train(empty)
    assert maxent_lm.score(empty, model, counts, [empty["doc_id"]]).count() == 0


def test_chances_of_all_words_add_up_to_one():
    words = np.arange(10, 3010, dtype=np.uint64)
    model = maxent_lm.Model(np.append(words, maxent_lm.END), np.append(np.arange(3000, 0, -1), 50), 4501550, 3001)
    rng = np.random.default_rng(0)
    model.class_weights += rng.normal(size=model.class_weights.shape).astype(np.float32)
    model.member_weights += rng.normal(size=model.member_weights.shape).astype(np.float32)
    pairs = np.stack([np.full(3002, 77, np.uint64), np.concatenate([words, [maxent_lm.END, np.uint64(5)]]).astype(np.uint64)], axis=1)
    flat, begins = pairs.ravel(), np.arange(0, 2 * 3002 + 1, 2)
    slots = model.slots(flat)
    logs = maxent_lm.log_chances(model, flat, begins, slots)
    counts = np.maximum(model.counts(flat), 0)
    logs += np.where(slots < 0, np.log((counts + 1) / model.rest_total), 0)
    assert np.exp(logs[1::2]).sum() == pytest.approx(1, rel=1e-3)


def test_rare_words_have_a_context_too(spark):
    """Of words outside the classes, those that followed a word are likelier behind it; all chances add up to one."""
    rng = random.Random(3)
    common = [f"c{n}" for n in range(maxent_lm.CLASSES * maxent_lm.MEMBERS)]
    rare = [f"r{n}" for n in range(600)]
    cell = maxent_lm.cells_of(maxent_lm.tokens([" ".join(rare).encode()])[0][:-1])
    after = {c: [w for w, k in zip(rare, cell) if k == c] for c in (1, 2)}
    lines = [" ".join(common * 4)] + [f"see c{c} {rng.choice(after[c])}" for c in (1, 2) for _ in range(150)] * 2 + rare
    training = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    model, counts = maxent_lm.train(training)
    pairs = spark.createDataFrame([(10 * c + k, f"c{c} {after[k][0]}") for c in (1, 2) for k in (1, 2)], "doc_id long, text string")
    score = {r.doc_id: r.score for r in maxent_lm.score(pairs, model, counts, [pairs["doc_id"]]).collect()}
    assert score[11] - score[12] > 0.1 + score[21] - score[22]

    words = np.append(model.known, np.arange(maxent_lm.CELLS, dtype=np.uint64) << np.uint64(maxent_lm.CELL_SHIFT))
    pairs = np.stack([np.full(len(words), maxent_lm.tokens([b"c1"])[0][0]), words], axis=1)
    flat, begins = pairs.ravel(), np.arange(0, 2 * len(words) + 1, 2)
    slots = model.slots(flat)
    logs = maxent_lm.log_chances(model, flat, begins, slots)
    logs += np.where(slots < 0, np.log((np.maximum(model.counts(flat), 0) + 1) / model.rest_total), 0)
    assert np.exp(logs[1::2]).sum() == pytest.approx(1, rel=1e-3)


def test_every_row_teaches_in_every_round(spark, words):
    """The weights are those of plain gradient steps, each over all rows."""
    rng = random.Random(12)
    lines = [" ".join(rng.choices(words, weights=range(1, len(words) + 1), k=30)) for _ in range(60)] + ["rare%d rare%d" % (n, n + 1) for n in range(2500)]
    training = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string").repartition(3)
    model, _ = maxent_lm.train(training)
    flat, begins = maxent_lm.tokens([line.encode() for line in lines])
    slots = model.slots(flat)
    classes = np.where(slots >= 0, slots // maxent_lm.MEMBERS, maxent_lm.CLASSES)
    ranks = {int(w): int(s) for w, s in zip(model.head, model.head_slot)}
    assert slots.tolist() == [ranks.get(int(w), -1) for w in flat] and (slots < 0).sum() > 100
    features = maxent_lm.contexts(flat, begins)
    answers = [classes, slots % maxent_lm.MEMBERS, maxent_lm.cells_of(flat)]
    buckets = [[maxent_lm._bucket(f) for f in features]] + [[maxent_lm._bucket(f, classes) for f in features]] * 2
    parts = [np.arange(len(flat)), np.flatnonzero(slots >= 0), np.flatnonzero(slots < 0)]
    for table, some in enumerate(parts):
        bias = [model.class_bias[None].repeat(len(flat), 0), model.member_bias[np.minimum(classes, maxent_lm.CLASSES - 1)], model.cell_bias[None].repeat(len(flat), 0)][table][some].astype(float)
        weights = np.zeros(model.tables()[table].shape)
        for _ in range(maxent_lm.ROUNDS):
            logits = bias + sum(weights[bucket[some]] for bucket in buckets[table])
            chances = np.exp(logits - logits.max(axis=1, keepdims=True))
            chances /= chances.sum(axis=1, keepdims=True)
            seen, expected = np.zeros_like(weights), np.zeros_like(weights)
            for bucket in buckets[table]:
                np.add.at(seen, (bucket[some], answers[table][some]), 1)
                np.add.at(expected, bucket[some], chances)
            weights += maxent_lm.RATE * (seen - expected) / (seen + expected + maxent_lm.DAMPING)
        assert np.allclose(model.tables()[table], weights, atol=1e-3)


def test_secret_scan(spark, empty):
    rng = random.Random(11)
    key = "".join(rng.choices("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", k=64))
    prose = "the thinnest andesitheareon formations weretheremostlikely " * 30
    data = [(1, f"é Password = 'abcdef' token:abc {prose}"), (2, f"{prose} {key} {prose}"), (3, "AKIA" + "A" * 16 + " AKIAB " + "0a" * 12 + " " + "0a" * 11), (4, None), (5, "")]
    found = {r.doc_id: r for r in secret_scan.scan(spark.createDataFrame(data, "doc_id long, text string")).collect()}
    assert found[1].spans == "assign:2:20" and found[1].n_assign == 1
    assert found[2].spans == f"random:{len(prose) + 1}:{len(prose) + 65}" and found[2].n_random == 1
    assert found[3].spans == "access:0:20,hex:27:51" and (found[3].n_access, found[3].n_hex) == (1, 1)
    assert found[4].spans == found[5].spans == "" and found[4].base_sha256 == found[5].base_sha256
    assert secret_scan.scan(empty).count() == 0


def test_html(spark):
    page = """<!doctype html><head><title>no</title><style>no</style><h1>Head</h1><p>One <b>two</b>
three<br>four<p hidden>no<ul><li>a<li>b<ol start=3><li>c<li>d</ol></ul><table><tr><th>Name<th>Qty<tr><td>apple pie<td>3</table>
<div style="color:red; display: none">no<div>no</div></div><pre>
 k  l
m</pre>x &amp; y<!-- no --><script>no("</p>")</script>"""
    assert html_text.render(page).split("\n") == [
        "Head", "", "One two three", "four", "", "- a", "- b", "  3. c", "  4. d", "", "Name      | Qty", "apple pie | 3", "", "", " k  l", "m", "", "x & y",
    ]
    assert [html_text.render(p) for p in (None, "", "<p", "</p></td></table>", "a < b", "<td>1<td>2")][:5] == ["", "", "<p", "", "a < b"]
    assert html_text.render("<div>" * 5000 + "deep").strip() == "deep"
    pages = spark.createDataFrame([(1, "u", "<p>a"), (2, None, None)], "page_id long, url string, html string").selectExpr("*", "1 as text")
    assert rows_of(html_text.extract(pages), "page_id", "text") == [(1, "a"), (2, "")]


def test_shingles_of_short_and_empty_texts():
    sizes = [len(s) for s in shingle_sets([b"", b"a", b"A b c d", b"a b c d e", b"a b c d e f", b"a a a a a a a"])]
    assert sizes == [0, 1, 1, 1, 2, 1]


def test_pipeline_stages_by_brute_force(spark, docs, texts, tmp_path):
    path = str(tmp_path)
    benchmark = texts[15]
    spark.createDataFrame([(0, benchmark)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    docs.withColumn("lang_pred", docs["lang"]).write.parquet(f"{path}/documents.parquet")
    current = spark.read.parquet(f"{path}/documents.parquet")
    columns = current.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        current = stage(spark, current, path)
        assert current.columns == columns, name
    languages = [(k, t) for k, t in enumerate(texts) if t and any(c.isalpha() for c in t)]
    common = Counter(key for _, t in languages for key in {line.strip().lower() for line in t.split("\n")} if key)
    lines, seen = [], set()
    for k, t in languages:
        left = []
        for line in t.split("\n"):
            key = line.strip().lower()
            if not key or common[key] < 10 or key not in seen:
                left.append(line)
            seen.add(key)
        if "".join(left).strip():
            lines.append((k, "\n".join(left)))
    groups = brute_groups([t for _, t in lines])
    kept = [lines[k] for k, _, c in groups if k == c]
    kept = [(k, t) for k, t in kept if benchmark not in t]
    assert rows_of(current, "doc_id", "text") == sorted(kept, key=repr)
    assert corpus_pipeline.run(spark, path).select("doc_id").distinct().count() == len(kept)


def test_pipeline_keeps_one_of_many_copies(spark, words):
    """Of lines that many documents share the first stays, so no text is lost; copies left without a word go."""
    rng = random.Random(21)
    text = "\n".join(" ".join(rng.choices(words, k=8)) for _ in range(6))
    own = [" ".join(rng.choices(words, k=12)) for _ in range(12)]
    near = [f"{line}\n{text.upper()}" for line in own]
    rows = [*((k, text) for k in range(1, 13)), *enumerate(near, 100), (200, ""), (201, None)]
    docs = spark.createDataFrame([(k, t, "en", "s", len(t or "")) for k, t in rows], SCHEMA)
    left = corpus_pipeline.line_dedup(spark, docs, "")
    expected = [(1, text, len(text)), *((k, line, len(line)) for k, line in enumerate(own, 100)), (200, "", 0), (201, None, None)]
    assert rows_of(left, "doc_id", "text", "n_chars") == sorted(expected, key=repr)


def test_clashing_names_in_stages(spark, words):
    rng = random.Random(4)
    texts = ["\n".join(" ".join(rng.choices(words, k=9)) for _ in range(3)) + "\ncommon line" for _ in range(12)]
    docs = spark.createDataFrame([(k, t, "en", "s", 0) for k, t in enumerate([*texts, texts[0]])], SCHEMA)
    extra = {name: F.lit(f"my {name}") for name in ("row", "_row", "bitmap", "_bitmap", "lowered", "_lowered", "keep_bitmap", "id", "node", "label")}
    clash = docs.withColumns(extra)
    found = line_dedup.drop_lines(clash, line_dedup.keep_bitmaps(clash))
    kept = jaccard_join.keep_one(found)
    clean = clean_documents(kept, spark.createDataFrame([(1, texts[3])], "item_id long, text string"))
    assert clean.columns == clash.columns
    rows = clean.collect()
    assert sorted(r.doc_id for r in rows) == [k for k in range(12) if k != 3]
    assert all(r[name] == f"my {name}" for r in rows for name in extra)
    assert all("common line" not in r.text for r in rows)
