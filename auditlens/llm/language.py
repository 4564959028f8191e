"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1. The vector of three letters binds (multiplies)
the letters' vectors, each permuted by its place; a text's vector bundles (sums) those of its
letter triples, a language's prototype those of its texts. The prototype with the largest
cosine to a text's vector names its language.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditlens.llm.common import each_text, held_out

DIMENSIONS = 512
#: Letters share this many vectors: a-z have their own, others one by code point; 0 is a gap.
SLOTS = 64
#: Characters that are worked on at a time.
BATCH = 400_000
#: Texts of one table of counts, which has a row for each and a column for each triple.
MOST_TEXTS = 256
UNKNOWN = "und"


@cache
def _slots() -> np.ndarray:
    """The slot of every code point; 0 for what is no letter."""
    slot = np.zeros(sys.maxunicode + 1, np.int32)
    letters = [c for c in range(sys.maxunicode + 1) if chr(c).isalpha()]
    slot[letters] = 27 + np.array(letters) % (SLOTS - 27)
    slot[np.arange(26) + ord("a")] = np.arange(1, 27)
    return slot


@cache
def _letters() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The letters' vectors as first, second and third of a triple: permuted by place."""
    rng = np.random.default_rng(9)
    third = rng.choice(np.array([-1, 1], np.float32), (SLOTS, DIMENSIONS))
    order = rng.permutation(DIMENSIONS)
    return third[:, order[order]], third[:, order], third


def triples(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(counts of each triple in each text, vectors of the triples).

    Everything between letters counts as one gap; a triple has a letter in the middle.
    """
    lowered = [t.lower() for t in texts]
    whole = "\0" + "".join(t + "\0" for t in lowered)
    points = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), "<u4")
    slot = _slots()[points]
    owner = np.repeat(np.arange(len(texts) + 1), [1, *(len(t) + 1 for t in lowered)]) - 1
    keep = slot > 0
    keep[0] = True
    keep[1:] |= slot[:-1] > 0
    slot, owner = slot[keep], owner[keep]
    middle = np.flatnonzero(slot[1:-1]) + 1 if len(slot) > 2 else np.zeros(0, np.int64)
    first, second, third = slot[middle - 1], slot[middle], slot[middle + 1]
    code = (first * SLOTS + second) * SLOTS + third
    present = np.zeros(SLOTS**3, bool)
    present[code] = True
    known = np.flatnonzero(present)
    place = np.zeros(SLOTS**3, np.int64)
    place[known] = np.arange(len(known))
    counts = np.bincount(
        owner[middle] * len(known) + place[code], minlength=len(texts) * len(known)
    ).reshape(len(texts), len(known))
    one, two, three = _letters()
    vectors = one[known // SLOTS**2] * two[known // SLOTS % SLOTS] * three[known % SLOTS]
    return counts.astype(np.float32), vectors


def _segments(text: str) -> Iterator[str]:
    """A text in pieces of about BATCH characters, cut where no letter is next to the cut.

    Such a cut changes no triple: what stands between letters is one gap, however long.
    """
    start = 0
    while len(text) - start > BATCH:
        end = start + BATCH
        while end < len(text) and text[end].isalpha():
            end += 1
        yield text[start:end]
        start = end
    yield text[start:]


def bundles(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(places of texts, letters, bundled vectors), some texts or parts of one at a time."""
    held, owners, size = [], [], 0

    def bundled() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        counts, vectors = triples(held)
        return np.array(owners), counts.sum(axis=1), counts @ vectors

    for n, text in enumerate(texts):
        for segment in _segments(text):
            held.append(segment)
            owners.append(n)
            size += len(segment)
            if size >= BATCH or len(held) == MOST_TEXTS:
                yield bundled()
                held, owners, size = [], [], 0
    if held:
        yield bundled()


@dataclass(frozen=True)
class Prototypes:
    languages: list[str]
    vectors: np.ndarray  # of length one each


def learn(docs: DataFrame, usable: Column, text: str = "text", lang: str = "lang") -> Prototypes:
    """Prototypes of all languages of the usable rows; rows without a language are left out.

    Every usable row counts. A task sums what it has by language, so what is shuffled and
    collected is one vector a language and task, then one a language.
    """

    def bundle(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[str, np.ndarray] = {}
        for frame in frames:
            langs = frame["l"].to_numpy().astype(str)
            for owners, _, vectors in bundles(frame["t"].tolist()):
                for name in np.unique(langs[owners]):
                    own = vectors[langs[owners] == name].sum(axis=0, dtype=np.float64)
                    total[name] = total.get(name, 0.0) + own
        if total:
            yield pd.DataFrame({"lang": list(total), "v": [v.tolist() for v in total.values()]})

    rows = (
        docs.filter(usable & F.col(lang).isNotNull() & F.col(text).isNotNull())
        .select(F.col(lang).alias("l"), F.col(text).alias("t"))
        .mapInPandas(bundle, "lang string, v array<double>")
        .select("lang", F.posexplode("v").alias("i", "x"))
        .groupBy("lang", "i")
        .agg(F.sum("x").alias("x"))
        .groupBy("lang")
        .agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("v"))
        .orderBy("lang")
        .collect()
    )
    vectors = np.array([[x["x"] for x in r["v"]] for r in rows]).reshape(-1, DIMENSIONS)
    norms = np.linalg.norm(vectors, axis=1, keepdims=True)
    return Prototypes([r["lang"] for r in rows], vectors / np.where(norms > 0, norms, 1))


def _predictor(known: Prototypes) -> Callable:
    def make():
        targets = known.vectors.T

        def work(texts: list[str]) -> Iterator[tuple]:
            total, letters = np.zeros((len(texts), DIMENSIONS)), np.zeros(len(texts))
            for owners, count, vectors in bundles(texts):
                np.add.at(total, owners, vectors)
                np.add.at(letters, owners, count)
            norms = np.linalg.norm(total, axis=1)
            cosines = total @ targets / np.where(norms > 0, norms, 1)[:, None]
            for row, found in zip(cosines, letters > 0, strict=True):
                if found and len(row):
                    best = int(row.argmax())
                    yield known.languages[best], float(min(max(row[best], 0.0), 1.0))
                else:
                    yield UNKNOWN, 0.0

        return work

    return each_text(make, "language string; score double")


def identify(docs: DataFrame, known: Prototypes, text: str = "text") -> DataFrame:
    """Adds `found`: struct<language, score> to every row, and keeps the rest.

    The score is the cosine, 0 where it is negative. Texts that are null or have no letter,
    and all texts where no language is known, are `und` with score 0. On a tie the language
    first by name wins. Texts are read whole; rows are independent of each other. A column
    `found` of the input is replaced.
    """
    return docs.withColumn("found", _predictor(known)(F.col(text)))


def language_report(docs: DataFrame) -> DataFrame:
    """Learns from the rows that are not held out, and predicts every row."""
    known = learn(docs, ~held_out("doc_id"))
    return identify(docs.select("doc_id", "text"), known).select(
        "doc_id",
        held_out("doc_id").alias("held_out"),
        F.col("found.language").alias("lang_pred"),
        F.col("found.score").alias("score"),
    )
