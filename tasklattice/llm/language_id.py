"""Language ID by hyperdimensional profiles.

Every letter has a random vector of +1 and -1. An n-gram's vector binds its letters:
the vector of the k-th letter, rolled by its distance from the last, multiplied
together. A document or a language bundles (adds up) the vectors of its n-grams. A
document gets the language whose prototype it has the largest cosine with.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tasklattice.llm.common import crc_rest, steps, text_column
from tasklattice.session import materialise

DIMENSIONS = 2048
GRAM = 3
SEED = 7
UNKNOWN = "und"
# n-grams whose vectors are held at once.
_CHUNK = 4096
# Bytes of text that are judged at once, where a text counts as so many at least: each takes a row of the matrix of _CHUNK n-grams.
_JUDGED_BYTES = 1 << 20
_LEAST_BYTES = 512
# n-grams of one language that are counted before they are merged, or bundled.
_MOST_GRAMS = 200_000
_LETTER_BITS = np.uint64(21)


@cache
def _alphabet() -> np.ndarray:
    """For every code point the lower-case letter it stands for, 0 if it is no letter."""
    table = np.zeros(0x110000, np.uint32)
    for point in range(0x110000):
        if 0xD800 <= point < 0xE000:
            continue
        letter = chr(point)
        if unicodedata.category(letter)[0] == "L":
            low = letter.lower()
            table[point] = ord(low) if len(low) == 1 else point
    return table


_letters: dict[int, np.ndarray] = {}
_MOST_LETTERS = 20_000


def letter_vector(point: int) -> np.ndarray:
    """The random vector of a letter; 0 is the gap between words, also a letter here."""
    if point not in _letters:
        if len(_letters) >= _MOST_LETTERS:
            _letters.clear()  # they can be made again
        bits = np.random.default_rng([SEED, point]).integers(0, 2, DIMENSIONS, dtype=np.int8)
        _letters[point] = bits * 2 - 1
    return _letters[point]


def gram_counts(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (text, n-gram) of the texts with their counts: (text index, n-gram code, count).

    Everything but letters is a gap; gaps in a row are one. Texts without letters have no rows.
    """
    points = np.frombuffer("\0".join(t.decode("utf-8", "replace") for t in texts).encode("utf-32-le"), np.uint32)
    owner = np.cumsum(points == 0) if b"\0" not in b"".join(texts) else _owners(texts)
    letters = _alphabet()[points]
    # One gap before the first letter of each text and one after its last.
    gap = letters == 0
    keep = ~gap | np.concatenate([[True], ~gap[:-1]])[: len(gap)]
    letters, owner = letters[keep].astype(np.uint64), owner[keep]
    letters, owner = np.concatenate([[0], letters, [0]]).astype(np.uint64), np.concatenate([owner[:1], owner, owner[-1:]])
    size = max(0, len(letters) - GRAM + 1)
    codes = np.zeros(size, np.uint64)
    for k in range(GRAM):
        codes = (codes << _LETTER_BITS) | letters[k : k + size]
    # An n-gram belongs to the text of its middle; across a border the middle is the gap.
    middle = GRAM // 2
    owner = owner[middle : middle + size]
    real = letters[middle : middle + size] != 0
    codes, owner = codes[real], owner[real]
    order = np.lexsort((codes, owner))
    codes, owner = codes[order], owner[order]
    new = np.ones(len(codes), bool)
    new[1:] = (codes[1:] != codes[:-1]) | (owner[1:] != owner[:-1])
    starts = np.flatnonzero(new)
    return owner[starts], codes[starts], np.diff(np.append(starts, len(codes)))


def _owners(texts: list[bytes]) -> np.ndarray:
    lengths = [len(t.decode("utf-8", "replace")) + 1 for t in texts]
    return np.repeat(np.arange(len(texts)), lengths)[:-1] if texts else np.zeros(0, np.int64)


def gram_vectors(codes: np.ndarray) -> np.ndarray:
    """The bound vectors of n-gram codes, one row each."""
    mask = np.uint64((1 << 21) - 1)
    out = np.ones((len(codes), DIMENSIONS), np.int8)
    for k in range(GRAM):
        points = ((codes >> (_LETTER_BITS * np.uint64(GRAM - 1 - k))) & mask).astype(np.int64)
        distinct, place = np.unique(points, return_inverse=True)
        table = np.stack([np.roll(letter_vector(p), GRAM - 1 - k) for p in distinct.tolist()]) if len(distinct) else out[:0]
        out *= table[place]
    return out


def bundles(texts: list[bytes]) -> np.ndarray:
    """One vector per text: the sum of its n-grams' vectors."""
    owner, codes, counts = gram_counts(texts)
    out = np.zeros((len(texts), DIMENSIONS), np.float32)
    distinct, place = np.unique(codes, return_inverse=True)
    for start in range(0, len(distinct), _CHUNK):
        inside = (place >= start) & (place < start + _CHUNK)
        some = distinct[start : start + _CHUNK]
        weights = np.zeros((len(texts), len(some)), np.float32)
        weights[owner[inside], place[inside] - start] = counts[inside]
        out += weights @ gram_vectors(some).astype(np.float32)
    return out


def _sum_languages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per task and language the counts of n-grams, bundled at the end of the task."""
    sums: dict[str, np.ndarray] = {}
    # Per language pieces (codes, counts); the first one is what was merged, the number is of n-grams in the others.
    counts: dict[str, list] = {}
    loose: dict[str, int] = {}

    def merge(lang: str) -> int:
        codes, place = np.unique(np.concatenate([c for c, _ in counts[lang]]), return_inverse=True)
        counts[lang] = [(codes, np.bincount(place, np.concatenate([n for _, n in counts[lang]])))]
        loose[lang] = 0
        return len(codes)

    def bundle(lang: str) -> None:
        merge(lang)
        [(codes, numbers)] = counts.pop(lang)
        total = sums.setdefault(lang, np.zeros(DIMENSIONS))
        for start in range(0, len(codes), _CHUNK):
            total += numbers[start : start + _CHUNK] @ gram_vectors(codes[start : start + _CHUNK]).astype(np.float64)

    for batch in steps(batches):
        langs = np.array(batch.column("lang").to_pylist(), object)
        owner, codes, numbers = gram_counts(batch.column("text").to_pylist())
        for lang in set(langs.tolist()):
            mine = (langs == lang)[owner]
            distinct, place = np.unique(codes[mine], return_inverse=True)
            counts.setdefault(lang, []).append((distinct, np.bincount(place, numbers[mine])))
            loose[lang] = loose.get(lang, 0) + len(distinct)
            if loose[lang] > _MOST_GRAMS and merge(lang) > _MOST_GRAMS:
                bundle(lang)
    for lang in list(counts):
        bundle(lang)
    if sums:
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(sums), pa.string()), pa.array([v.tolist() for v in sums.values()], pa.list_(pa.float64()))],
            names=["lang", "bundle"],
        )


def learn_profiles(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One prototype per language: (lang, profile array<double>), learnt from all rows with a language.

    The sums are exact whole numbers, so their order does not matter.
    """
    rows = labelled.where(F.col(lang_col).isNotNull()).select(F.col(lang_col).cast("string").alias("lang"), text_column(labelled, text_col).alias("text"))
    parts = rows.mapInArrow(_sum_languages, "lang string, bundle array<double>")
    summed = parts.select("lang", F.posexplode("bundle").alias("place", "value")).groupBy("lang", "place").agg(F.sum("value").alias("value"))
    ordered = summed.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("place", "value"))).alias("cells"))
    return ordered.select("lang", F.col("cells.value").alias("profile"))


def predict(docs: DataFrame, profiles: DataFrame, id_cols: list[Column], text_col: str = "text", keep_text: bool = False) -> DataFrame:
    """``id_cols`` with lang_pred and score (the cosine, below 0 shown as 0); with the text's bytes as ``_text`` before them if asked.

    A text that is null or has no letter gets ``und`` and score 0, and so do all texts
    if nothing was learnt. Equal cosines go to the first language by name. The
    prototypes are as many as languages, and are sent to all tasks.
    """
    known = sorted((r.lang, r.profile) for r in profiles.collect())
    names = [lang for lang, _ in known]
    matrix = np.array([p for _, p in known], np.float64).reshape(len(known), DIMENSIONS)
    units = matrix / np.maximum(np.linalg.norm(matrix, axis=1, keepdims=True), 1e-300)
    units = units.astype(np.float32)
    rows = docs.select(*id_cols, text_column(docs, text_col).alias("_text"))
    kept = rows.columns if keep_text else rows.columns[:-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, "_text", _JUDGED_BYTES, _LEAST_BYTES):
            vectors = bundles(batch.column("_text").to_pylist())
            norms = np.linalg.norm(vectors, axis=1)
            filled = (norms > 0) & bool(names)
            cosines = vectors @ units.T / np.maximum(norms, 1e-30)[:, None] if names else np.zeros((len(vectors), 1))
            best = cosines.argmax(axis=1)
            scores = np.where(filled, np.clip(cosines[np.arange(len(best)), best], 0, 1), 0.0)
            langs = [names[k] if ok else UNKNOWN for k, ok in zip(best.tolist(), filled.tolist())]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in kept), pa.array(langs, pa.string()), pa.array(scores.astype(np.float64))],
                names=[*kept, "lang_pred", "score"],
            )

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[: len(kept)])
    return rows.mapInArrow(run, f"{schema}, lang_pred string, score double")


def op7_language_id(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held_out = crc_rest(docs["doc_id"], 4) == 2
    profiles = materialise(learn_profiles(docs.where(~held_out)))
    return predict(docs, profiles, [docs["doc_id"], held_out.alias("held_out")])
