"""Finding tasks by id prefix, by text and by near match, for whole tables of lookups.

No operator here compares every lookup with every task. Each turns the test
into an equality on a piece of text and joins on that; what the piece alone
does not decide is checked afterwards. Lookups that took joins to find are
written out first: Catalyst then knows their real size, and broadcasts them only
if that is below the session's threshold.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..schema import ID_LENGTH, MIN_PREFIX_LENGTH
from ..session import materialise, release
from . import ordering as O
from .listing import ListOptions, matching
from .textindex import holds, low_texts

MAX_SUGGESTIONS = 3
# Starts of ids up to this length are few, so only the first ids of each are compared.
SHORT_LENGTH = 5
MAX_EDITS = 2
# Long lookups are met by three pieces of at most so many characters.
LONGEST_PIECE = 8
# Of more ids than these, short lookups are held against these shares of all first.
FEW_IDS, SHARES = 1 << 18, (64, 8, 1)
# A filter of wanted keys has eight bits a key, and no more than 32 MB; its words come in pages.
KEY_BITS, MOST_BITS, PAGE = 8, 28, 12
# A text is looked up by one piece of it, an anchor, of one of these lengths.
ANCHOR_LENGTHS = (6, 3, 1)
# Texts of tasks share most of their words, so searches in them have longer anchors and more lengths to choose from.
SEARCH_LENGTHS = (12, 8, 6, 5, 4, 3, 1)


def _with_lengths(rows: DataFrame, texts: DataFrame, text: str) -> DataFrame:
    """Pair each row with every distinct length among the texts: at most 40 for ids."""
    lengths = texts.select(F.collect_set(F.length(text)).alias("lengths")).scalar()
    return rows.withColumn("_lengths", lengths).select("*", F.explode("_lengths").alias("_length")).drop("_lengths")


def _wanted(keys: DataFrame) -> Callable[[Column], Column]:
    """A test for texts before they are shuffled: true of every key (one column), false of most other texts.

    One bit per hash, in pages of words that each task gets with its plan. Of more keys than there is
    room for, more of the other texts pass; the join behind it decides.
    """
    table = materialise(keys.select(F.xxhash64(*keys.columns).alias("hash")))
    size = 1 << min(MOST_BITS, max(PAGE + 6, (KEY_BITS * table.count()).bit_length()))
    slot = lambda hashed: F.pmod(hashed, F.lit(size).cast("long"))
    part = lambda at, low, high: F.shiftright(at, low).bitwiseAND(F.lit((1 << high) - 1)).cast("int")
    words = (
        table.select(slot(F.col("hash")).alias("at"))
        .groupBy(F.shiftright("at", 6).alias("id"))
        .agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), part(F.col("at"), 0, 6))).alias("bits"))
    )
    every = keys.sparkSession.range(size >> 6).join(words, "id", "left").select("id", F.coalesce("bits", F.lit(0).cast("long")).alias("bits"))
    in_order = lambda name, value: F.transform(F.sort_array(F.collect_list(F.struct(name, value))), lambda x: x[value])
    pages = every.groupBy(F.shiftright("id", PAGE).alias("page")).agg(in_order("id", "bits").alias("words"))
    stored = materialise(pages.agg(in_order("page", "words").alias("pages")))
    release(table)

    def test(text: Column) -> Column:
        at = slot(F.xxhash64(text))
        word = F.get(F.get(stored.scalar(), part(at, PAGE + 6, MOST_BITS)), part(at, 6, PAGE))
        return F.getbit(word, part(at, 0, 6)) == 1

    return test


def _heads(ids: DataFrame, prefixes: DataFrame, name: str) -> DataFrame:
    """The starts of the ids, in lower case, that may be among the prefixes."""
    return (
        _with_lengths(ids, prefixes, name)
        .where(F.length("id") >= F.col("_length"))
        .withColumn(name, F.substring(F.lower("id"), F.lit(1), F.col("_length")))
        .drop("_length")
        .where(_wanted(prefixes.select(name))(F.col(name)))
    )


def _first_two(prefixes: DataFrame, ids: DataFrame) -> DataFrame:
    """(_prefix, hits, prefix_id): how many ids start with each prefix, 2 meaning more than one, and the first.

    The ids that start with a prefix follow it in byte order without a gap. So both
    sides are sorted together, last first, by ranges; inside a range the two ids met last
    are the ones next to a prefix. Where a range has not met two yet, those of the
    ranges before go on: one row per range, which the driver passes along.
    """
    # Of equal keys the ids come first, as a prefix may be a whole id.
    order = [F.desc("key"), F.desc_nulls_last("met")]
    rows = ids.select(F.lower("id").alias("key"), F.col("id").alias("met")).unionByName(
        prefixes.select(F.col("_prefix").alias("key"), F.lit(None).cast("string").alias("met"))
    )
    ranges = materialise(rows.repartitionByRange(*order).withColumn("part", F.spark_partition_id()))
    place = Window.partitionBy("part").orderBy(*order)
    before = place.rowsBetween(Window.unboundedPreceding, -1)
    until = place.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    pair = F.when(F.col("met").isNotNull(), F.struct(F.col("met").alias("one"), F.col("other").alias("two")))
    walked = ranges.withColumn("other", F.last("met", True).over(before)).withColumns(
        {"near": F.last(pair, True).over(until), "ends": F.lead("key").over(place).isNull()}
    )
    found = materialise(walked.where(F.col("met").isNull() | F.col("ends")).select("part", "key", "met", "near", "ends"))
    release(ranges)

    carried, held = [], [None, None]
    for part, near in found.where("ends").orderBy("part").select("part", "near").collect():
        carried.append((part, *held))
        if near:
            held = [near.one, near.two or held[0]]
    passed = ids.sparkSession.createDataFrame(carried, "part int, one string, two string")
    one = F.coalesce("near.one", "one")
    two = F.when(F.col("near").isNull(), F.col("two")).otherwise(F.coalesce("near.two", "one"))
    fits = lambda hit: F.coalesce(F.startswith(F.lower(hit), F.col("key")), F.lit(False)).cast("int")
    return (
        found.where("met IS NULL")
        .join(F.broadcast(passed), "part")
        .select(F.col("key").alias("_prefix"), (fits(one) + fits(two)).alias("hits"), one.alias("prefix_id"))
    )


def resolve(refs: DataFrame, tasks: DataFrame) -> DataFrame:
    """Each distinct ref with the task it names: (ref, id, status).

    A full id wins. Otherwise 4 to 39 characters count as a prefix, in any
    letter case, and must fit one task only. Ids and prefixes are merged by
    ranges, so the work is two sorts of ids whatever lengths the prefixes have, and a
    prefix shared by a third of all ids costs no more than others.
    """
    wanted = refs.select("ref").where(F.col("ref").isNotNull()).distinct()
    ids = tasks.select("id").where(F.col("id").isNotNull())
    exact = wanted.join(ids.withColumn("ref", F.col("id")), "ref").groupBy("ref").agg(
        F.min("id").alias("exact_id")
    )
    width = F.octet_length("ref")
    prefixes = wanted.where((width >= MIN_PREFIX_LENGTH) & (width < ID_LENGTH)).select(F.lower("ref").alias("_prefix")).distinct()
    hits = _first_two(prefixes, ids)
    found = F.coalesce("exact_id", F.when(F.col("hits") == 1, F.col("prefix_id")))
    return (
        wanted.join(exact, "ref", "left")
        .join(hits, F.lower("ref") == F.col("_prefix"), "left")
        .select(
            "ref",
            found.alias("id"),
            F.when(found.isNotNull(), "OK")
            .when(F.col("hits") > 1, "AMBIGUOUS")
            .otherwise("NOT_FOUND")
            .alias("status"),
        )
    )


def _candidates(tasks: DataFrame) -> DataFrame:
    """The tasks that suggestions draw on, with their list order as one sortable value."""
    order = F.struct(
        O.state_rank().alias("state_rank"),
        O.priority_rank().alias("priority_rank"),
        (-F.unix_micros(F.col("created").cast("timestamp_ntz").cast("timestamp"))).alias("age"),
        F.col("id").alias("tie"),
    )
    return matching(tasks, ListOptions(all=True)).select(
        "id", "title", F.lower("id").alias("low_id"), F.lower("title").alias("low_title"),
        order.alias("place"),
    )


def _anchored(queries: DataFrame, text: str, pieces: Column, lengths: tuple[int, ...] = ANCHOR_LENGTHS) -> DataFrame:
    """Add ``anchor``: a stretch of one of the pieces, of one of the fixed lengths.

    Long stretches that few queries have are the best: a stretch of some task's
    text then leads to few queries, however many share their common words. A
    further letter counts as much as being shared by a third of the queries. The
    choice only steers the work, every hit is checked. A query without any piece has
    the empty anchor.
    """
    size = C.cases(((F.length("_piece") >= n, n) for n in lengths), 0)
    options = (
        queries.select(text, F.explode(F.array_distinct(pieces)).alias("_piece"))
        .withColumn("_size", size)
        .withColumn("_at", F.explode(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length("_piece") - F.col("_size") + 1))))
        .select(text, F.substring("_piece", F.col("_at"), F.col("_size")).alias("anchor"))
    )
    shared = options.groupBy("anchor").agg(F.count(F.lit(1)).alias("_shared"))
    score = F.col("_shared") / F.pow(F.lit(3.0), F.length("anchor"))
    best = (
        # Catalyst takes the stretches of a lookup for one row and would broadcast them.
        options.join(shared.hint("merge"), "anchor")
        .groupBy(text)
        .agg(F.min(F.struct(score.alias("score"), F.col("anchor"))).alias("_best"))
        .select(text, F.col("_best.anchor").alias("anchor"))
    )
    return materialise(queries.join(best, text))


def _stretches(rows: DataFrame, texts: list[str], anchors: DataFrame, lengths: tuple[int, ...] = ANCHOR_LENGTHS) -> DataFrame:
    """One row per distinct stretch of the texts, in those of the lengths that the anchors have."""
    sizes = anchors.select(F.collect_set(F.length("anchor"))).scalar()
    empty = F.array().cast("array<string>")

    def cut(text: str, size: int) -> Column:
        # Found in one pass, as cutting by position is costly.
        found = F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{size}}}))"), F.lit(1)) if size else F.array(F.lit(""))
        return F.when(F.array_contains("_sizes", size) & F.col(text).isNotNull(), found).otherwise(empty)

    every = F.array_distinct(F.concat(*(cut(text, size) for text in texts for size in (*lengths, 0))))
    return rows.withColumn("_sizes", sizes).select(*rows.columns, F.explode(every).alias("anchor"))


def _possible(lookups: DataFrame, rows: DataFrame, text: str) -> DataFrame:
    """The lookups (low_ref) without those that hold a stretch of three letters, or a letter, that no text has."""
    size = F.when(F.length("low_ref") < 3, 1).otherwise(3)
    places = F.sequence(F.lit(1), F.length("low_ref") - size + 1)
    asked = lookups.select("low_ref", F.explode(F.transform(places, lambda at: F.substring("low_ref", at, size))).alias("anchor"))
    every = [F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{n}}}))"), F.lit(1)) for n in (1, 3)]
    found = materialise(rows.where(F.col(text).isNotNull()).select(F.explode(F.concat(*every)).alias("anchor")).distinct())
    vain = asked.distinct().join(found, "anchor", "left_anti").select("low_ref").distinct()
    return materialise(lookups.join(vain, "low_ref", "left_anti"))


def _containing(rows: DataFrame, text: str, lookups: DataFrame) -> DataFrame:
    """Join rows with the lookups (low_ref) that their text contains. The text should be short."""
    anchored = _anchored(_possible(lookups, rows, text), "low_ref", F.array("low_ref"))
    return (
        _stretches(rows, [text], anchored)
        .where(_wanted(anchored.select("anchor"))(F.col("anchor")))
        .join(anchored, "anchor")
        .where(F.contains(text, "low_ref"))
        .drop("anchor")
    )


def _first_hits(hits: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first few hits per lookup, numbered. Spark cuts each map output first."""
    place = Window.partitionBy(*keys).orderBy(*order)
    numbered = hits.withColumn("pos", F.row_number().over(place))
    return numbered.where(F.col("pos") <= MAX_SUGGESTIONS).withColumn("pos", F.col("pos").cast("long"))


def _lower_refs(refs: DataFrame) -> DataFrame:
    return refs.select(F.lower("ref").alias("low_ref")).where("low_ref != ''").distinct()


def _prefix_hits(lookups: DataFrame, candidates: DataFrame) -> DataFrame:
    """The first few tasks whose id starts with the lookup (low_ref)."""
    heads = _heads(candidates, lookups, "low_ref")
    return _first_hits(heads.join(lookups.hint("merge"), "low_ref"), ["low_ref"], [F.col("place")])


def _with_refs(hits: DataFrame, refs: DataFrame) -> DataFrame:
    """Put the refs as they were written back in place of their lower-case form."""
    written = refs.select("ref", F.lower("ref").alias("low_ref")).distinct()
    return written.join(hits, "low_ref").drop("low_ref")


def suggest(refs: DataFrame, tasks: DataFrame) -> DataFrame:
    """Up to three near matches per ref that does not resolve: (ref, pos, hit, id, suggestion).

    Id prefixes come first and alone if there are any; then ids, then titles
    that hold the ref. Closed tasks are not suggested.
    """
    unresolved = materialise(resolve(refs, tasks).where("status != 'OK'").select("ref"))
    lookups = materialise(_lower_refs(unresolved))
    candidates = _candidates(tasks)

    by_prefix = materialise(_prefix_hits(lookups, candidates.select("id", "title", "place")).withColumn("hit", F.lit("prefix")))
    rest = lookups.join(by_prefix.select("low_ref").distinct(), "low_ref", "left_anti")
    in_id = _containing(candidates.select("low_id", "id", "title", "place"), "low_id", rest)
    in_title = _containing(candidates.select("low_title", "id", "title", "place"), "low_title", rest)
    columns = ["low_ref", "id", "title", "place"]
    inside = (
        in_id.select(*columns, F.lit(1).alias("class")).unionByName(in_title.select(*columns, F.lit(2).alias("class")))
    )
    by_content = _first_hits(inside, ["low_ref"], [F.col("class"), F.col("place")]).withColumn(
        "hit", F.when(F.col("class") == 1, "id").otherwise("title")
    )
    columns = ["low_ref", "pos", "hit", "id", "title"]
    hits = by_prefix.select(columns).unionByName(by_content.select(columns))
    text = F.concat(C.short_id(), F.lit(" ("), F.col("title"), F.lit(")"))
    return _with_refs(hits.withColumn("suggestion", text).drop("title"), unresolved)


def _without_two(text: Column) -> Column:
    """All texts left when two characters are dropped."""
    last = F.length(text)
    drop = lambda i, j: F.concat(
        F.substring(text, F.lit(1), i - 1),
        F.substring(text, i + 1, j - i - 1),
        F.substring(text, j + 1, last),
    )
    firsts = F.sequence(F.lit(1), last - 1)
    pairs = F.transform(
        firsts, lambda i: F.transform(F.sequence(i + 1, last), lambda j: drop(i, j))
    )
    return F.array_distinct(F.flatten(pairs))


def _without_one(text: Column) -> Column:
    """All texts left when one character is dropped."""
    last = F.length(text)
    return F.transform(
        F.sequence(F.lit(1), last),
        lambda i: F.concat(F.substring(text, F.lit(1), i - 1), F.substring(text, i + 1, last)),
    )


def _fuzzy_keys(text: Column, length: Column) -> Column:
    """Texts that the start of a lookup, ``length`` characters, shares with that of any id at most two edits away.

    ``text`` is the start of the lookup or of the id, which may be up to two characters shorter. Whatever follows
    it, two edits leave a text in common that lacks two characters of ``length``. Lookups of one
    or two characters are within two edits of everything.
    """
    missing = length - F.length(text)
    dropped = F.when(missing == 0, _without_two(text)).when(missing == 1, _without_one(text)).otherwise(F.array(text))
    return F.when(length <= MAX_EDITS, F.array(F.lit(""))).otherwise(dropped)


def _starts(ids: DataFrame, keyed_refs: DataFrame) -> DataFrame:
    """(place, head, _length): the starts of the ids (place, low_id) in every length that keys were made from.

    All ids with one short start are as near to a lookup, so the first few will do.
    """
    starts = (
        _with_lengths(ids, keyed_refs, "_start")
        .withColumn("head", F.substring("low_id", F.lit(1), F.col("_length")))
        .where(F.col("_length") - F.length("head") <= MAX_EDITS)
        .select("place", "head", "_length")
    )
    short = starts.where(F.col("_length") <= SHORT_LENGTH)
    alike = F.when(F.col("_length") > MAX_EDITS, F.col("head")).otherwise("")
    first = _first_hits(short.withColumn("_alike", alike), ["_length", "_alike"], [F.col("place")])
    return first.select(starts.columns).unionByName(starts.where(F.col("_length") > SHORT_LENGTH))


def _near_by_start(lookups: DataFrame, ids: DataFrame, enough: int) -> DataFrame:
    """(low_ref, place, distance): ids within two edits, met by what their starts of up to ``enough`` characters are without two."""
    size = F.length("low_ref")
    start = F.substring("low_ref", 1, enough)
    keys = F.transform(_fuzzy_keys(start, F.length(start)), lambda key: F.xxhash64(F.length(start), key))
    keyed_refs = materialise(lookups.select("low_ref", start.alias("_start"), F.explode(keys).alias("key")))
    keys = F.transform(_fuzzy_keys(F.col("head"), F.col("_length")), lambda key: F.xxhash64("_length", key))
    keyed_ids = _starts(ids, keyed_refs).select("place", "head", F.explode(keys).alias("key"))
    keyed_ids = keyed_ids.where(_wanted(keyed_refs.select("key").distinct())(F.col("key")))
    met = keyed_ids.join(keyed_refs.hint("merge"), "key")
    distance = F.when(size <= enough, F.levenshtein("low_ref", "head", MAX_EDITS))
    pairs = met.withColumn("distance", distance).where((size > enough) | (F.col("distance") >= 0))
    pairs = materialise(pairs.groupBy("low_ref", "place").agg(F.first("distance").alias("distance")))
    short = pairs.where(F.col("distance").isNotNull())
    head = F.substring("low_id", F.lit(1), size)
    long = pairs.where(F.col("distance").isNull()).drop("distance").join(ids, "place").withColumn("distance", F.levenshtein("low_ref", head, MAX_EDITS))
    return short.unionByName(long.where(F.col("distance") >= 0).drop("low_id"))


def _near_by_pieces(lookups: DataFrame, ids: DataFrame) -> DataFrame:
    """(low_ref, place, distance): ids within two edits of lookups of at least five characters.

    Two edits leave one of the first three pieces of an id as it is. In the lookup it stands up to one place
    before its own or two behind it, as the id is cut to the lookup's length, or up to two characters shorter.
    """
    size, wide = F.length("low_ref"), F.col("_wide")
    at = [(number, shift) for number in range(3) for shift in range(-1, MAX_EDITS + 1)]
    cut = lambda text, number, place: F.xxhash64(F.lit(number), F.substring(text, place + 1, wide))
    pieces = [F.when((number * wide + shift >= 0) & ((number + 1) * wide + shift <= size), cut(F.col("low_ref"), number, number * wide + shift)) for number, shift in at]
    least = F.least(F.lit(LONGEST_PIECE), F.floor((size - MAX_EDITS) / 3).cast("int"))
    asked = lookups.select("low_ref", least.alias("_wide"))
    ref_keys = materialise(asked.select("low_ref", "_wide", F.explode(F.array_distinct(F.array_compact(F.array(*pieces)))).alias("key")))
    own = [F.when(F.length("low_id") >= (number + 1) * wide, cut(F.col("low_id"), number, number * wide)) for number in range(3)]
    wides = ref_keys.select(F.collect_set("_wide")).scalar()
    by_width = ids.withColumn("_wides", wides).select("place", "low_id", F.explode("_wides").alias("_wide"))
    id_keys = by_width.select("place", "low_id", F.explode(F.array_compact(F.array(*own))).alias("key"))
    id_keys = id_keys.where(_wanted(ref_keys.select("key").distinct())(F.col("key")))
    head = F.substring("low_id", F.lit(1), size)
    met = id_keys.join(ref_keys.drop("_wide").hint("merge"), "key").select("low_ref", "place", F.levenshtein("low_ref", head, MAX_EDITS).alias("distance"))
    return met.where(F.col("distance") >= 0).distinct()


def _digits(count: int) -> float:
    """How many hexadecimal digits tell so many ids apart."""
    return math.log(max(count, 2), 16)


def _near_ids(lookups: DataFrame, ids: DataFrame, count: int) -> DataFrame:
    """(low_ref, place, distance): the ids (place, low_id), so many in all, within two edits of a lookup.

    Long lookups are keyed by three pieces, if these are long enough to be rare among ids of hexadecimal
    digits, others by their start alone: as many characters as make a key rare. So an id
    has as many keys however many lengths they have.
    """
    by_pieces = F.length("low_ref") >= 3 * max(3, math.ceil(_digits(count) - 0.5)) + MAX_EDITS
    by_start = _near_by_start(lookups.where(~by_pieces), ids, max(SHORT_LENGTH, math.ceil(_digits(count))) + 3)
    return by_start.unionByName(_near_by_pieces(lookups.where(by_pieces), ids))


def _first_near(lookups: DataFrame, ids: DataFrame, count: int) -> DataFrame:
    """(low_ref, pos, place, distance): the first few ids (place from 1 to ``count``, low_id) within two edits of each lookup.

    Lookups so short that they are near to many ids are held against the first ids in list order, and
    only those that have found too few there against the next ones.
    """
    first = lambda some, among: materialise(_first_hits(_near_ids(some, among, count), ["low_ref"], [F.col("place")]).drop("pos"))
    if count <= FEW_IDS:
        found = [first(lookups, ids)]
    else:
        common = F.length("low_ref") <= max(SHORT_LENGTH, math.ceil(_digits(count)) + 1)
        found, left, start = [first(lookups.where(~common), ids)], materialise(lookups.where(common)), 0
        for end in (count // share for share in SHARES):
            found.append(first(left, ids.where((F.col("place") > start) & (F.col("place") <= end))))
            served = reduce(DataFrame.unionByName, found[1:]).groupBy("low_ref").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= MAX_SUGGESTIONS)
            left, start = materialise(left.join(served, "low_ref", "left_anti")), end
    return _first_hits(reduce(DataFrame.unionByName, found), ["low_ref"], [F.col("place")])


def fuzzy_match(refs: DataFrame, tasks: DataFrame) -> DataFrame:
    """Up to three tasks per ref: id prefixes, else ids holding it, else ids within two edits.

    Refs may have any length. The edit distance is taken against the id cut to
    the length of the ref: (ref, pos, hit, id, distance). A ref three characters
    longer than an id can be has no match. Ids are numbered in list order first: what
    is matched and shuffled has numbers in place of ids and of what orders them.
    """
    lookups = materialise(_lower_refs(refs).where(F.length("low_ref") <= ID_LENGTH + MAX_EDITS))
    # The id, which ends the list order, is what the rows are grouped by.
    order = F.struct("place.state_rank", "place.priority_rank", "place.age")
    open_ids = _candidates(tasks).where(F.col("id").isNotNull()).groupBy("id").agg(F.min(order).alias("order"))
    named = materialise(O.numbered(open_ids, [F.col("order"), F.col("id")], "place").select("place", "id"))
    ids = named.select("place", F.lower("id").alias("low_id"))
    columns = ["low_ref", "pos", "hit", "place", "distance"]

    by_prefix = materialise(
        _prefix_hits(lookups, named).withColumns({"hit": F.lit("prefix"), "distance": F.lit(0)}).select(columns)
    )
    rest = lookups.join(by_prefix.select("low_ref").distinct(), "low_ref", "left_anti")

    by_content = _first_hits(_containing(ids, "low_id", rest), ["low_ref"], [F.col("place")])
    by_content = materialise(
        by_content.withColumns(
            {"hit": F.lit("substring"), "distance": F.lit(None).cast("int")}
        ).select(columns)
    )
    rest = materialise(rest.join(by_content.select("low_ref").distinct(), "low_ref", "left_anti"))

    by_distance = _first_near(rest, ids, named.count()).withColumn("hit", F.lit("distance"))
    hits = by_prefix.unionByName(by_content).unionByName(by_distance.select(columns))
    found = hits.join(named, "place").select("low_ref", "pos", "hit", "id", "distance")
    return _with_refs(found, refs)


# Up to this length a title is matched by what is left of it without two characters.
SHORT_TITLE = 14
# Longer ones are cut behind so many characters: the shortest length of a class of titles, and its cut.
CUTS = ((97, 48), (69, 34), (46, 23), (31, 15), (21, 10), (0, 7))


def _left_over(text: Column) -> Column:
    """All texts left when up to two characters are dropped."""
    size = F.length(text)
    one = F.when(size >= 1, _without_one(text)).otherwise(F.array().cast("array<string>"))
    two = F.when(size >= 2, _without_two(text)).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(F.array(text), one, two))


def _cut(length: Column) -> Column:
    return C.cases(((length >= least, at) for least, at in CUTS), CUTS[-1][1])


def _cut_keys(text: Column, at: Column, side: int, slack: int) -> Column:
    """Hashes of the start of a text without one character each, and of the rest, cut up to ``slack`` places away."""
    start = F.transform(_without_one(F.substring(text, F.lit(1), at)), lambda left: F.xxhash64(F.lit(side), at, left))
    rest = [F.xxhash64(F.lit(side + 1), at, F.substring(text, at + 1 + shift, F.length(text))) for shift in range(-slack, slack + 1)]
    return F.array_distinct(F.concat(start, F.array(*rest)))


def _long_pairs(lookups: DataFrame, titles: DataFrame) -> DataFrame:
    """(low_ref, low_title): all pairs within two edits, and others, of texts too long to leave out two characters.

    Cut a ref in two: of two edits one at most is before the cut, or none behind it. So its start and
    the title's are alike without one character each, or the rest is the same. The same holds of both
    read backwards, and a ref takes the way that leads to fewer titles.
    """
    size, backwards = F.length("low_title"), 2
    places = F.array_distinct(F.array(_cut(size - MAX_EDITS), _cut(size + MAX_EDITS)))
    keys_of = lambda at: F.concat(_cut_keys(F.col("low_title"), at, 0, MAX_EDITS), _cut_keys(F.reverse("low_title"), at, backwards, MAX_EDITS))
    every = F.flatten(F.transform(places, keys_of))
    at = _cut(F.length("low_ref"))
    way = lambda side, text: F.struct(F.lit(side).alias("side"), _cut_keys(text, at, side, 0).alias("keys"))
    ways = F.array(way(0, F.col("low_ref")), way(backwards, F.reverse("low_ref")))
    by_way = lookups.select(F.xxhash64("low_ref").alias("ref"), F.explode(ways).alias("way"))
    ref_keys = materialise(by_way.select("ref", "way.side", F.explode("way.keys").alias("key")))

    title_keys = titles.select(F.xxhash64("low_title").alias("title"), F.explode(every).alias("key"))
    title_keys = title_keys.where(_wanted(ref_keys.select("key"))(F.col("key")))
    met = materialise(title_keys.join(ref_keys.select("key").distinct(), "key", "left_semi"))
    counts = met.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    costs = ref_keys.join(counts, "key", "left").groupBy("ref", "side").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
    taken = materialise(costs.groupBy("ref").agg(F.min_by("side", F.struct("n", "side")).alias("side")))
    pairs = materialise(ref_keys.join(taken, ["ref", "side"])).join(met, "key").select("ref", "title").distinct()
    named = materialise(pairs).join(lookups.withColumn("ref", F.xxhash64("low_ref")), "ref")
    return named.join(titles.withColumn("title", F.xxhash64("low_title")), "title").select("low_ref", "low_title")


def _whole(text: Column) -> Column:
    return F.xxhash64(F.lit(0), text)


def _gap(before: Column, behind: Column) -> Column:
    """A hash of any text that has one character between these two."""
    return F.xxhash64(F.lit(1), before, behind)


def _gaps(text: Column) -> Column:
    """The text with a gap in place of each character."""
    last = F.length(text)
    gaps = F.transform(F.sequence(F.lit(1), last), lambda i: _gap(F.substring(text, F.lit(1), i - 1), F.substring(text, i + 1, last)))
    return F.when(last >= 1, gaps).otherwise(F.array().cast("array<bigint>"))


def _one_edit(text: Column) -> Column:
    """What titles one edit away from a text, which is not empty, are or have a gap in: it without a character, or with a gap in place of or between its own."""
    last = F.length(text)
    between = F.transform(F.sequence(F.lit(0), last), lambda i: _gap(F.substring(text, F.lit(1), i), F.substring(text, i + 1, last)))
    return F.array_distinct(F.concat(F.transform(_without_one(text), _whole), _gaps(text), between))


def _nearest(lookups: DataFrame, named: DataFrame) -> DataFrame:
    """(ref, task, distance): the first few of the tasks (task, low_title) within one edit of each lookup, nearest first.

    A lookup and a title have a key in common only if they are as near as the key says. So of the tasks
    with one key the first few are enough, however many titles are alike.
    """
    keys = F.concat(F.array(F.struct(F.lit(0).alias("distance"), _whole(F.col("low_ref")).alias("key"))), F.transform(_one_edit(F.col("low_ref")), lambda key: F.struct(F.lit(1).alias("distance"), key.alias("key"))))
    ref_keys = materialise(lookups.select(F.xxhash64("low_ref").alias("ref"), F.explode(keys).alias("at")).select("ref", "at.*"))
    every = F.concat(F.array(_whole(F.col("low_title"))), _gaps(F.col("low_title")))
    title_keys = named.where(F.col("low_title").isNotNull()).select("task", F.explode(every).alias("key")).where(_wanted(ref_keys.select("key"))(F.col("key")))
    first = _first_hits(title_keys, ["key"], [F.col("task")]).drop("pos")
    met = ref_keys.join(materialise(first), "key").groupBy("ref", "task").agg(F.min("distance").alias("distance"))
    return materialise(_first_hits(met, ["ref"], [F.col("distance"), F.col("task")]).drop("pos"))


def fuzzy_titles(refs: DataFrame, tasks: DataFrame) -> DataFrame:
    """Up to three tasks per ref whose titles are within two edits of it: (ref, pos, id, title, distance).

    Nearest first, then in list order; closed tasks are left out, letter case does not count. Most refs
    have their tasks within one edit (see ``_nearest``); only the others are compared with all titles two edits away. Equal
    titles are compared once. Short titles meet by what is left of them without two characters, longer
    ones by the parts before and behind a cut (see ``_long_pairs``).
    """
    size = F.length("low_ref")
    lookups = materialise(_lower_refs(refs))
    first = materialise(_first_hits(_candidates(tasks).select("id", "title", "low_title", "place"), ["low_title"], [F.col("place")]).drop("pos"))
    named = materialise(O.numbered(first, [F.col("place")], "task").select("task", "id", "title", "low_title"))
    release(first)
    nearest = _nearest(lookups, named)
    served = nearest.groupBy("ref").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == MAX_SUGGESTIONS).select("ref")
    hashed = lookups.withColumn("ref", F.xxhash64("low_ref"))
    rest = materialise(hashed.join(served, "ref", "left_anti").select("low_ref"))

    titles = materialise(named.select("low_title").distinct())
    long_title, long_ref = F.length("low_title") > SHORT_TITLE, size > SHORT_TITLE
    pairs = _long_pairs(rest.where(long_ref), titles.where(long_title))

    # One of a pair is short, the other at most two characters longer.
    left_ref = materialise(rest.where(size <= SHORT_TITLE + MAX_EDITS).select("low_ref", F.explode(_left_over(F.col("low_ref"))).alias("left")))
    left_title = titles.where(F.length("low_title") <= SHORT_TITLE + MAX_EDITS).select("low_title", F.explode(_left_over(F.col("low_title"))).alias("left"))
    left_title = materialise(left_title.where(_wanted(left_ref.select("left"))(F.col("left"))))
    distance = F.levenshtein("low_ref", "low_title", MAX_EDITS)
    judge = lambda met: met.select("low_ref", "low_title", distance.alias("distance")).where(F.col("distance") >= 0)
    short = judge(left_ref.join(left_title, "left").where(~(long_title & long_ref))).distinct()
    judged = materialise(judge(pairs).unionByName(short)).join(named, "low_title").select("low_ref", "task", "distance")
    near = hashed.join(nearest.join(served, "ref"), "ref").select("low_ref", "task", "distance").unionByName(judged)
    first = _first_hits(near, ["low_ref"], [F.col("distance"), F.col("task")])
    return _with_refs(first.join(named, "task").select("low_ref", "pos", "id", "title", "distance"), refs)


def search_many(tasks: DataFrame, queries: DataFrame) -> DataFrame:
    """Every (q, id) where the task's title or description holds the query, wildcards included.

    Each query has one anchor, so a task meets a query once, with its texts in the same row: only
    stretches that are anchors outlive the join, and no table of postings or of pairs is written. The
    texts should be short; ``textindex`` is for long ones.
    """
    wanted = queries.select("q", F.lower("q").alias("low_q")).where(F.col("q").isNotNull()).distinct()
    pieces = F.filter(F.split("low_q", "[%_]"), lambda piece: piece != "")
    anchored = _anchored(wanted, "low_q", F.when(F.size(pieces) > 0, pieces).otherwise(F.array(F.lit(""))), SEARCH_LENGTHS)
    texts = low_texts(tasks, "id", ["title", "description"])
    names = [c for c in texts.columns if c != "id"]
    hit = reduce(lambda a, b: a | b, (F.coalesce(holds(F.col(c), F.col("low_q")), F.lit(False)) for c in names))
    return _stretches(texts, names, anchored, SEARCH_LENGTHS).join(anchored, "anchor").where(hit).select("q", "id")
