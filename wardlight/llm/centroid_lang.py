"""Language identification by nearest centroid.

A text is the vector of its byte n-grams (letters only, lower case, hashed to a fixed width), weighted by TF-IDF and normalised. Every language has several centroids,
the means of clusters of its labelled texts (spherical k-means); a text gets the language of the centroid with the greatest cosine, and is rejected if it is further from that centroid than
the language's own texts are.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardlight.llm.common import slices

#: Hashed n-grams.
WIDTH = 1 << 13
#: Bytes other than letters (of ASCII or of a longer UTF-8 sequence) become blanks, and runs of blanks one.
LETTERS = bytes(b if b >= 0x80 or 0x61 <= b <= 0x7A else 0x20 for b in range(256))
UNKNOWN = "und"


def counts_of(text: str) -> np.ndarray:
    """Counts of the hashed byte bigrams and trigrams of a text's letters."""
    flat = b" " + b" ".join(text.lower().encode("utf-8", "replace").translate(LETTERS).split()) + b" "
    b = np.frombuffer(flat, np.uint8).astype(np.uint32)
    if len(b) < 3:
        return np.zeros(WIDTH, np.float32)
    pair = b[:-1] << np.uint32(8) | b[1:]
    triple = pair[:-1] << np.uint32(8) | b[2:]
    codes = np.concatenate([pair, triple | np.uint32(1 << 24)]) * np.uint32(2_654_435_761)
    return np.bincount(codes >> np.uint32(32 - 13), minlength=WIDTH).astype(np.float32)


def unit_vectors(texts: list[str], idf: np.ndarray) -> np.ndarray:
    """Normalised TF-IDF vectors, a row each; the term frequency is damped by its root."""
    found = np.array([counts_of(t) for t in texts], np.float32).reshape(len(texts), WIDTH)
    found = np.sqrt(found) * idf
    return found / np.maximum(np.linalg.norm(found, axis=1, keepdims=True), 1e-12)


@dataclass
class Model:
    """Languages of the centroids, the centroids, the n-grams' IDF and each centroid's least cosine."""

    langs: list[str]
    centroids: np.ndarray
    idf: np.ndarray
    floor: np.ndarray


def clusters(vectors: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Up to k unit centroids by spherical k-means; starts from spread-out vectors (each next one is the least covered)."""
    chosen = [vectors.mean(0)]
    while len(chosen) < min(k, len(vectors)) + 1:
        chosen.append(vectors[(vectors @ np.array(chosen).T).max(1).argmin()])
    centres = np.array(chosen[1:])
    for _ in range(rounds):
        nearest = (vectors @ centres.T).argmax(1)
        centres = np.array([vectors[nearest == j].mean(0) for j in range(len(centres)) if (nearest == j).any()])
        centres /= np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-12)
    return centres


def has_letter(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


def fit(labelled: DataFrame, per_language: int = 300, max_languages: int = 200, k: int = 4, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", reject_quantile: float = 0.005) -> Model | None:
    """A model from at most per_language texts of each of the max_languages most frequent languages, the texts with the smallest hashed ids; None without any.

    Texts without a letter and rows without a language are not used. Only this bounded sample reaches the driver.
    """
    usable = labelled.where(F.col(lang_col).isNotNull() & has_letter(F.col(text_col)))
    hashed = usable.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), F.pmod(F.xxhash64(F.lit(17), F.col(id_col).cast("string")), F.lit(1 << 40)).alias("h"))
    sizes = hashed.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(max_languages).collect()
    if not sizes:
        return None
    # about 1.3 times as many as wanted pass the hash threshold of their language; the rest is cut below
    threshold = F.create_map(*[x for r in sizes for x in (F.lit(r["lang"]), F.lit(int(min(1.0, (1.3 * per_language + 20) / r["count"]) * (1 << 40))))])
    few = hashed.where(F.col("h") < F.coalesce(F.try_element_at(threshold, F.col("lang")), F.lit(0)))
    rows = few.select("lang", "h", F.col("text")).toLocalIterator()
    by_lang: dict[str, list[tuple[int, np.ndarray, np.ndarray]]] = {}
    for r in rows:
        found = counts_of(r["text"])
        at = np.flatnonzero(found)
        by_lang.setdefault(r["lang"], []).append((r["h"], at.astype(np.int16), found[at]))
    by_lang = {lang: sorted(own, key=lambda x: x[0])[:per_language] for lang, own in sorted(by_lang.items())}
    texts = sum(map(len, by_lang.values()))
    seen = np.zeros(WIDTH)
    for own in by_lang.values():
        for _, at, _ in own:
            seen[at] += 1
    idf = np.log((1 + texts) / (1 + seen)).astype(np.float32) + 1
    langs, centroids, floor = [], [], []
    for lang, own in by_lang.items():
        vectors = np.zeros((len(own), WIDTH), np.float32)
        for v, (_, at, found) in zip(vectors, own, strict=True):
            v[at] = np.sqrt(found)
        vectors *= idf
        vectors /= np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-12)
        centres = clusters(vectors, k)
        cosines = (vectors @ centres.T).max(1)
        langs += [lang] * len(centres)
        centroids.append(centres)
        floor += [float(np.quantile(cosines, reject_quantile))] * len(centres)
    return Model(langs, np.concatenate(centroids).astype(np.float32), idf, np.array(floor))


def predict(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, columns keep, lang_pred, score, rejected) for every row of docs, from its text alone.

    A text that is null or has no letter is 'und' with score 0, as is every text without a model; score is the cosine with the nearest centroid. A text nearer to no centroid than the
    language's reject_quantile has its nearest language all the same, and rejected true.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most max_languages * k centroids of WIDTH numbers
    cols = [id_col, *keep]
    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in cols)

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in slices(batches, 200):
            texts, letters = batch.column("_text").to_pylist(), batch.column("_letters").to_pylist()
            n = len(texts)
            lang, score, out = np.full(n, UNKNOWN, object), np.zeros(n), np.zeros(n, bool)
            use = [k for k in range(n) if letters[k]] if m else []
            if use:
                cosines = unit_vectors([texts[k] for k in use], m.idf) @ m.centroids.T
                best = cosines.argmax(1)
                top = cosines[np.arange(len(use)), best]
                lang[use] = [m.langs[j] for j in best]
                score[use] = np.clip(top.astype(float), 0, 1)
                out[use] = top < m.floor[best]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in cols), pa.array(lang, pa.string()), pa.array(score), pa.array(out)], [*cols, "lang_pred", "score", "rejected"]
            )

    given = docs.select(*cols, F.col(text_col).alias("_text"), has_letter(F.col(text_col)).alias("_letters"))
    return given.mapInArrow(nearest, f"{kinds}, lang_pred string, score double, rejected boolean")


def identify(docs: DataFrame, folds: int = 5, **settings) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, rejected): learn from the documents whose crc32 of the id is not divisible by folds, predict all.

    held_out marks the rest. A null id is hashed as an empty string. Repeated rows get repeated predictions; an empty table gives no rows.
    """
    held_out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % folds == 0
    model = fit(docs.where(~held_out), **settings)
    return predict(docs.withColumn("held_out", held_out), model, keep=("held_out",))
