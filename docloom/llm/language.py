"""Language identification by nearest centroids.

A text is a vector of hashed character n-grams (one to three lower-cased characters; characters that aren't letters,
combining marks among them, count as one separator), as 1 + log counts times inverse document frequency, at unit length. Each language has several centroids,
found by spherical k-means on a bounded sample of labelled rows (SAMPLE documents a language at most, by hash of the id, and
SAMPLE_ALL in all; with more than LANGUAGES labels, those with most rows). A
text belongs to the language of the centroid with the largest cosine. It is rejected where 1 - cosine is more than the
language's limit, which is set by the sample: REJECT_SHARE times the distance that its own members keep within. A text without
a letter is `und` and rejected.

Null and empty texts are `und` with score 0. Without labelled rows every text is `und`. Repeated rows are scored each, and an
empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import column_slices, text_buffers, trimmed

DIMENSIONS = 2048
CENTROIDS = 4
#: Labelled rows of each language that are learned from, about.
SAMPLE = 3000
#: Labelled rows of all languages together, about: at 4 KB each, 49 MB come to the driver. Labels that are learned, at most.
SAMPLE_ALL, LANGUAGES = 12_000, 400
#: A text is rejected below this share of the cosine that 99 % of its language's sample reach at its length.
REJECT_SHARE = 0.5
UNKNOWN = "und"


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    table = np.fromiter((chr(i).isalpha() for i in range(0x110000)), dtype=bool, count=0x110000)
    table[0xD800:0xE000] = False
    return table


def ngram_counts(data: np.ndarray, offsets: np.ndarray, dimensions: int = DIMENSIONS) -> tuple[np.ndarray, np.ndarray]:
    """Counts of hashed n-grams of each row (rows x dimensions, float32), and its number of letters. Rows must be lower case."""
    part = data[offsets[0] : offsets[-1]]
    heads = np.concatenate(([0], np.cumsum((part & 0xC0) != 0x80)))
    at = heads[offsets - offsets[0]]
    codes = np.frombuffer(part.tobytes().decode("utf-8").encode("utf-32-le"), dtype=np.uint32)
    letter = _letters()[codes]
    c = np.where(letter, codes, np.uint32(0))
    n = len(at) - 1
    row = np.repeat(np.arange(n, dtype=np.int64), np.diff(at))
    shift = np.uint32(32 - int(dimensions).bit_length() + 1)
    hashed = c * np.uint32(0x9E3779B1)
    counts = np.bincount(row * dimensions + (hashed >> shift), minlength=n * dimensions)
    for k in (1, 2):
        if len(c) <= k:
            break
        hashed = (hashed[:-1] ^ (hashed[:-1] >> np.uint32(15))) * np.uint32(0x85EBCA77) + c[k:] * np.uint32(0xC2B2AE3D)
        same = (row[k:] == row[:-k]) & (letter[k:] | letter[:-k])
        counts += np.bincount((row[:-k] * dimensions + (hashed >> shift))[same], minlength=n * dimensions)
    letters = np.concatenate(([0], np.cumsum(letter)))[at]
    return counts.reshape(n, dimensions).astype(np.float32), np.diff(letters)


def _slices(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Row ranges with their counts and letters, of texts in lower case: a quarter of a megabyte and 512 rows at most, and a long row in parts."""
    for i, j in column_slices(column, 1 << 18, 512):
        data, offsets = text_buffers(pc.utf8_lower(pc.fill_null(column.slice(i, j - i), "")))
        if len(offsets) > 2 or offsets[-1] - offsets[0] <= 1 << 20:
            counts, letters = ngram_counts(data, offsets)
        else:  # a very long text, cut where characters begin
            counts, letters, at = 0, 0, int(offsets[0])
            while at < offsets[-1]:
                end = min(int(offsets[-1]), at + (1 << 20))
                while end < offsets[-1] and data[end] & 0xC0 == 0x80:
                    end += 1
                c, n = ngram_counts(data, np.array([at, end]))
                counts, letters, at = counts + c, letters + n, end
        yield i, j, counts, letters


@dataclass
class Centroids:
    languages: list[str]
    idf: np.ndarray
    centroids: np.ndarray  # (languages * k, dimensions)
    owner: np.ndarray
    limits: np.ndarray  # (languages, length classes): the least cosine that is accepted

    def score(self, counts: np.ndarray, letters: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Number of the language, cosine and whether it is rejected."""
        cosine = _unit(counts, self.idf) @ self.centroids.T
        best = cosine.argmax(axis=1)
        language, score = self.owner[best], np.clip(cosine[np.arange(len(best)), best].astype(np.float64), 0, 1)
        return language, score, score < self.limits[language, _length_class(letters)]


def _length_class(letters: np.ndarray) -> np.ndarray:
    return np.clip(np.log2(np.maximum(letters, 1)).astype(np.int64), 0, 11)


def _unit(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    v = np.maximum(counts, 1).astype(np.float32)
    np.log(v, out=v)
    v += 1
    v *= counts > 0
    v *= idf
    v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
    return v


def fit(vectors: np.ndarray, letters: np.ndarray, labels: list[str], k: int = CENTROIDS, reject_share: float = REJECT_SHARE, seed: int = 0) -> Centroids:
    languages, y = sorted(set(labels)), None
    y = np.array([languages.index(x) for x in labels])
    held = sum((vectors[lo : lo + 1024] > 0).sum(axis=0) for lo in range(0, len(vectors), 1024))
    idf = (np.log((1 + len(vectors)) / (1 + held)) + 1).astype(np.float32)
    unit, rng = vectors, np.random.default_rng(seed)
    for lo in range(0, len(vectors), 1024):  # in place: one array of the sample is enough
        unit[lo : lo + 1024] = _unit(vectors[lo : lo + 1024], idf)
    centroids, owner, limits = [], [], np.zeros((len(languages), 12))
    for i in range(len(languages)):
        own = unit[y == i]
        means = own[rng.choice(len(own), size=min(k, len(own)), replace=False)]
        for _ in range(15):
            near = (own @ means.T).argmax(axis=1)
            means = np.stack([own[near == j].mean(axis=0) if (near == j).any() else means[j] for j in range(len(means))])
            means /= np.maximum(np.linalg.norm(means, axis=1, keepdims=True), 1e-12)
        centroids.append(means)
        owner += [i] * len(means)
        score, classes = (own @ means.T).max(axis=1), _length_class(letters[y == i])
        level = 0.0
        for c in range(11, -1, -1):  # a class without rows of its own takes the next longer one's limit
            if (classes == c).sum() >= 5:
                level = float(np.quantile(score[classes == c], 0.01)) * reject_share
            limits[i, c] = level
        limits[i, :4] = np.minimum(limits[i, :4], 0.01)  # under 16 letters nearly nothing is said about a language
    return Centroids(languages, idf, np.concatenate(centroids).astype(np.float32), np.array(owner), limits)


def train(docs: DataFrame, sample: int = SAMPLE, text_col: str = "text", lang_col: str = "lang", order_col: str = "doc_id", sample_all: int = SAMPLE_ALL) -> Centroids | None:
    """Centroids learned from about `sample` rows of docs a language, `sample_all` in all; None without labelled rows."""
    rows = docs.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), F.xxhash64(order_col).alias("h"))
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(LANGUAGES).collect()}
    if not sizes:
        return None
    sample = min(sample, -(-sample_all // len(sizes)))
    share = F.create_map(*(x for lang, n in sizes.items() for x in (F.lit(lang), F.lit(min(1_000_000, -(-1_000_000 * sample // n))))))
    chosen = rows.filter(F.coalesce(F.pmod("h", F.lit(1_000_000)) < share[F.col("lang")], F.lit(False))).select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, counts, letters in _slices(batch.column(1)):
                blobs = [np.minimum(c, 65535).astype(np.uint16).tobytes() for c in counts]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(blobs, pa.binary()), pa.array(letters.astype(np.int64))], names=["lang", "counts", "letters"])

    found = [(r["lang"], bytes(r["counts"]), r["letters"]) for r in chosen.mapInArrow(trimmed(count), "lang string, counts binary, letters long").toLocalIterator() if r["letters"] > 0]
    if not found:
        return None
    found.sort()
    labels, letters = [r[0] for r in found], np.array([r[2] for r in found])
    vectors = np.empty((len(found), DIMENSIONS), dtype=np.float32)
    for i in range(len(found)):
        vectors[i] = np.frombuffer(found[i][1], dtype=np.uint16)
        found[i] = None
    return fit(vectors, letters, labels)


def identify(docs: DataFrame, model: Centroids | None, text_col: str = "text", prefix: str = "") -> DataFrame:
    """docs with lang_pred, score and rejected (their names led by prefix), which replace columns of these names."""
    docs = docs.drop(*(prefix + x for x in ("lang_pred", "score", "rejected")))
    names = [*docs.columns]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    at = names.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, counts, letters in _slices(batch.column(at)):
                if model is None:
                    language, score, rejected = np.zeros(hi - lo, dtype=int), np.zeros(hi - lo), np.ones(hi - lo, dtype=bool)
                else:
                    language, score, rejected = model.score(counts, letters)
                none = (letters == 0) | (model is None)
                preds = [UNKNOWN if no else model.languages[i] for i, no in zip(language, none, strict=True)]
                columns = [pa.array(preds, pa.string()), pa.array(np.where(none, 0.0, score)), pa.array(rejected | none)]
                yield pa.RecordBatch.from_arrays([*(c.slice(lo, hi - lo) for c in batch.columns), *columns], names=[*names, *(prefix + x for x in ("lang_pred", "score", "rejected"))])

    return docs.mapInArrow(trimmed(run), f"{schema}, `{prefix}lang_pred` string, `{prefix}score` double, `{prefix}rejected` boolean")


def is_held_out(id_col: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 == 0, F.lit(False))


def learnable(id_col: str = "doc_id"):
    """Whether a row may be learned from: it has an id, and the fold of the id isn't the held-out one."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 != 0, F.lit(False))
