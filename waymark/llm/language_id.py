"""Language identification by rank-order profiles.

A profile is the list of the most frequent n-grams (lengths one to three, words padded with spaces), most frequent
first. A language's profile comes from the summed counts of all its training documents; a document's profile from its
whole text. The distance of a document to a language adds, over the document's n-grams, how many places each is out of
its place in the language's profile; one that is not in it counts as a full profile. The nearest language wins.

Profiles travel in the task closure: languages x profile entries, independent of the number of documents.

Defined cases: null texts and texts without a letter give `und` and score 0; so does every text when nothing was
learned. Equal n-gram counts rank by code point, equal distances go to the language first in the alphabet. Null
languages are not learned from. Repeated rows are judged one by one. The score is 1 - nearest / second nearest
distance, with the largest possible distance as second where there is one language only. Very long texts are counted
whole; an empty table gives no rows; other columns, whatever their names, are not read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import ship_code
from .ngrams import gram_counts, grams


def learn_profiles(df: DataFrame, size: int = 400) -> dict[str, np.ndarray]:
    """Language to its n-grams by falling frequency, from a table (label, text)."""
    counts = gram_counts(df.filter("label is not null and text is not null"))
    place = F.row_number().over(Window.partitionBy("label").orderBy(F.desc("n"), "gram"))
    rows = counts.withColumn("place", place).filter(F.col("place") <= size).select("label", "place", "gram").collect()
    out: dict[str, list] = {}
    for label, _, gram in sorted(rows):
        out.setdefault(label, []).append(gram)
    return {k: np.array(v, np.int64) for k, v in out.items()}


def rank_table(profiles: dict[str, np.ndarray], size: int) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(languages, sorted n-grams, place of each n-gram by language; size where it is missing)."""
    names = sorted(profiles)
    known = np.unique(np.concatenate([profiles[k] for k in names])) if names else np.zeros(0, np.int64)
    places = np.full((len(known) + 1, len(names)), size, np.int32)
    for j, k in enumerate(names):
        places[np.searchsorted(known, profiles[k]), j] = np.arange(len(profiles[k]))
    return names, known, places


def nearest(text: str | None, names: list[str], known: np.ndarray, places: np.ndarray, size: int) -> tuple[str, float]:
    found, has_letter = grams(text) if text else (None, False)
    if not has_letter or not names:
        return "und", 0.0
    keys, counts = np.unique(found, return_counts=True)
    top = keys[np.lexsort((keys, -counts))[:size]]
    at = np.searchsorted(known, top)
    at[(at == len(known)) | (known[np.minimum(at, len(known) - 1)] != top)] = len(known)
    rows = places[at]
    distance = np.where(rows < size, np.abs(rows - np.arange(len(top))[:, None]), size).sum(axis=0)
    best = int(distance.argmin())
    second = np.partition(distance, 1)[1] if len(names) > 1 else len(top) * size
    return names[best], float(1 - distance[best] / second) if second else 0.0


def _predict(batches: Iterable[pa.RecordBatch], model: tuple, size: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        told = [nearest(x.as_py(), *model, size) for x in batch.column(1)]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array([x for x, _ in told], pa.string()), pa.array([s for _, s in told], pa.float64())], ["id", "lang_pred", "score"]
        )


def predict_language(df: DataFrame, profiles: dict[str, np.ndarray], id_col: str = "doc_id", text_col: str = "text", size: int = 400) -> DataFrame:
    """One row for each row of df: id, lang_pred, score."""
    ship_code(df.sparkSession)
    kind = df.schema[id_col].dataType.simpleString()
    out = df.select(df[id_col].alias("id"), df[text_col].alias("text")).mapInArrow(
        partial(_predict, model=rank_table(profiles, size), size=size), f"id {kind}, lang_pred string, score double"
    )
    return out.withColumnRenamed("id", id_col)
