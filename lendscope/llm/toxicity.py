"""Toxicity by compression distance.

Two zstandard dictionaries are trained, one on ordinary text and one on toxic
text, and every window of a document is compressed with both. What the toxic
dictionary saves in a window tells how much of it is phrased as toxic text is.
The toxic dictionary is laid behind the ordinary one, so that two lengths
differ only by what is particular to toxic text. Counts of windows over
several savings, calibrated by a logistic curve on labelled documents that the
dictionaries have not seen, give the score.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lendscope.llm.common import byte_slices, small_batches

#: The fit sees at most so many labelled documents of each class, in the order of
#: a hash of doc_id, as whole texts until a class has FIT_CHARS characters (the text
#: that passes the bound is the last). Scoring has no bounds.
FIT_ROWS = 4000
FIT_CHARS = 40_000_000
#: A dictionary is trained on so many windows of them at most, drawn at random.
FIT_WINDOWS = 200_000
WINDOW_WORDS, WINDOW_BYTES = 16, 400
ORDINARY_BYTES, TOXIC_BYTES = 65_536, 4_096
LEVEL = 12
#: A window counts at each of these savings in bytes.
SAVINGS = (1, 2, 3, 4, 5)
#: A word marks toxic text when its share of the toxic documents is so many times
#: its share of the ordinary ones, each smoothed by a prior of so many documents of
#: the mean share. Toxic text's dictionary learns the windows of toxic text that
#: reach so many words to both sides of a marking word. ``fit`` tries these (ratio,
#: prior, reach) and keeps the one that does best inside its own labelled rows.
SETTINGS = [(ratio, prior, reach) for reach in (1, 0) for ratio in (3.0, 6.0) for prior in (2.0, 8.0)]
#: At least so many words mark if that many are commoner in toxic text.
LEAST_WORDS = 8
#: Documents in which the words this far before and after are the same count once.
AROUND = 8
SLICE_CHARS = 4_000_000
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def windows(text: str, words: int = WINDOW_WORDS) -> list[bytes]:
    """Lower-cased runs of ``words`` words, cut further where they are very long."""
    found = _WORD.findall(text.lower().encode())
    out = []
    for i in range(0, len(found), words):
        w = b" " + b" ".join(found[i:i + words]) + b" "
        out += [w[j:j + WINDOW_BYTES] for j in range(0, len(w), WINDOW_BYTES)] if len(w) > WINDOW_BYTES else [w]
    return out


def _trained(samples: list[bytes], size: int, k: int, d: int) -> bytes:
    """Content of a trained dictionary; too little text to train on is its own dictionary."""
    try:
        return zstandard.train_dictionary(size, samples, k=k, d=d).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-size:]


@dataclass
class ToxicityModel:
    ordinary: bytes = b""
    toxic: bytes = b""
    weights: list[float] = field(default_factory=list)

    def compressors(self) -> tuple:
        def make(content: bytes):
            d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=LEVEL)
            return zstandard.ZstdCompressor(dict_data=d, level=LEVEL, write_content_size=False,
                                            write_checksum=False, write_dict_id=False).compress
        return make(self.ordinary), make(self.toxic + self.ordinary)

    def features(self, text: str, compressors: tuple) -> list[float]:
        plain, toxic = compressors
        found = windows(text)
        saved = np.array([len(plain(w)) - len(toxic(w)) for w in found], dtype=np.int64)
        counts = [float((saved >= s).sum()) for s in SAVINGS]
        return [1.0, *np.log1p(counts), *(c / max(1, len(found)) for c in counts), float(np.log1p(len(found)))]

    def score(self, texts: list[str], pair: tuple | None = None) -> np.ndarray:
        """Scores of ``texts``; ``pair`` is ``compressors()`` of this model, made anew if not given."""
        if not self.weights:
            return np.zeros(len(texts))
        pair = pair or self.compressors()
        x = np.array([self.features(t, pair) for t in texts]).reshape(len(texts), -1)
        return 1 / (1 + np.exp(-np.clip(x @ np.array(self.weights), -30, 30)))


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Weighted ridge logistic regression by Newton's method."""
    w, pull = np.zeros(x.shape[1]), np.full(x.shape[1], ridge)
    pull[0] = 1e-6
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (weight * (p - y)) + pull * w
        step = np.linalg.solve((x.T * (weight * np.maximum(p * (1 - p), 1e-6))) @ x + np.diag(pull), grad)
        w -= step * min(1.0, 4 / max(1e-9, np.abs(step).max()))
        if np.abs(step).max() < 1e-7:
            break
    return w


def _bare(text: bytes) -> list[bytes]:
    return [w.strip(b".,;:!?") for w in _WORD.findall(text)]


class MarkingWords:
    """In how many toxic and ordinary texts each word occurs.

    A smoothed ratio of document frequencies decides, so a word that some
    ordinary texts quote, or that wrong labels put there, still counts. A copied
    passage is no evidence for its words: toxic texts that have a word in the
    same surroundings are one text.
    """

    def __init__(self, toxic: list[str], ordinary: list[str]):
        around, self.plain = defaultdict(set), Counter()
        for t in toxic:
            words = _bare(t.lower().encode())
            for w, i in {w: i for i, w in reversed(list(enumerate(words)))}.items():
                around[w].add(hash((words[max(0, i - AROUND)], words[min(len(words) - 1, i + AROUND)])))
        for t in ordinary:
            self.plain.update(set(_bare(t.lower().encode())))
        self.marked = {w: len(s) for w, s in around.items() if w}
        self.toxic, self.ordinary = len(toxic), len(ordinary)

    def above(self, ratio: float, prior: float) -> set[bytes]:
        smooth = prior / (self.toxic + self.ordinary)
        found = {w: (n / self.toxic + smooth) / (self.plain[w] / self.ordinary + smooth) for w, n in self.marked.items()}
        ranked = sorted((r for r in found.values() if r > 1), reverse=True)
        least = min(ratio, ranked[:LEAST_WORDS][-1]) if ranked else ratio
        return {w for w, r in found.items() if r >= least}


def marking_words(toxic: list[str], ordinary: list[str], ratio: float = 5.0, prior: float = 8.0) -> dict[bytes, int]:
    """Words that mark toxic texts, with the number of toxic texts (by surroundings) that hold them."""
    words = MarkingWords(toxic, ordinary)
    return {w: words.marked[w] for w in words.above(ratio, prior)}


def toxic_windows(texts: list[str], marks: set[bytes], reach: int) -> list[bytes]:
    """Windows of ``reach`` words to both sides of each marking word, once a surroundings."""
    out = set()
    for t in texts:
        words = _bare(t.lower().encode())
        for i, w in enumerate(words):
            if w in marks:
                near = (words[max(0, i - AROUND)], words[min(len(words) - 1, i + AROUND)])
                out.add((b" " + b" ".join(words[max(0, i - reach):i + reach + 1]) + b" ", near))
    return [w for w, _ in sorted(out)]


def _loss(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> float:
    """Weighted log loss of each half of the rows under the curve of the other half."""
    total, half = 0.0, np.arange(len(y)) % 2 == 0
    for learn, held in ((half, ~half), (~half, half)):
        p = 1 / (1 + np.exp(-np.clip(x[held] @ _logistic(x[learn], y[learn], weight[learn]), -30, 30)))
        total -= float((weight[held] * np.where(y[held] == 1, np.log(p), np.log1p(-p))).sum())
    return total


def fit(toxic: list[str], ordinary: list[str], ordinary_weight: float = 1.0,
        settings: list[tuple[float, float, int]] | None = None) -> ToxicityModel:
    """Two of three texts of each class train the dictionaries, the third
    calibrates. Without labelled texts of both classes nothing is toxic.

    Toxic text's dictionary is trained on the windows of toxic text around the
    words that mark toxic documents, the ordinary one on windows without those
    words: what both hold saves nothing. Each of ``settings`` (SETTINGS by default)
    is tried on the same third, by the log loss of each half under the curve of the
    other; among equals the first stays. The class weights are those of the curve.
    """
    if not toxic or not ordinary:
        return ToxicityModel()
    part = lambda texts, k: [t for i, t in enumerate(texts) if (i % 3 == 2) == k]
    learn_t, learn_o = part(toxic, False) or toxic, part(ordinary, False) or ordinary
    check_t, check_o = part(toxic, True) or toxic, part(ordinary, True) or ordinary
    words = MarkingWords(learn_t, learn_o)
    short = [w for t in learn_o for w in windows(t, 8)]
    y = np.array([1.0] * len(check_t) + [0.0] * len(check_o))
    weight = np.where(y == 1, 1.0, ordinary_weight)
    best, tried = None, set()
    for ratio, prior, reach in SETTINGS if settings is None else settings:
        marks = words.above(ratio, prior)
        key = (frozenset(marks), reach)
        if key in tried:
            continue
        tried.add(key)
        rng = np.random.default_rng(7)
        shuffled = lambda x: [x[i] for i in rng.permutation(len(x))[:FIT_WINDOWS]]
        model = ToxicityModel(_trained(shuffled([w for w in short if marks.isdisjoint(_bare(w))]), ORDINARY_BYTES, 64, 8),
                              _trained(shuffled(toxic_windows(learn_t, marks, reach)), TOXIC_BYTES, 16, 6))
        pair = model.compressors()
        x = np.array([model.features(t, pair) for t in check_t + check_o])
        loss = _loss(x, y, weight)
        if best is None or loss < best[0]:
            best = (loss, model, x)
    _, model, x = best
    model.weights = _logistic(x, y, weight).tolist()
    return model


def held_out(doc_id: Column) -> Column:
    """Rows that no fit may use: crc32 of the doc_id as text, modulo 3, is 1."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 3 == 1


def fit_labels(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> ToxicityModel:
    """Fit on labelled documents that are not held out: of each class the first
    ``rows`` by a hash of doc_id, whole texts of any length, up to FIT_CHARS characters.

    Labels that are NULL or neither 0 nor 1 count for nothing, one of several for a
    doc_id is the largest, and without labelled texts of both classes nothing is toxic.
    """
    known = (labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
             .where(~held_out(F.col("doc_id")) & F.col("toxic").isin(0, 1)).groupBy("doc_id").agg(F.max("toxic").alias("toxic")))
    total = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    chosen = [known.where(F.col("toxic") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows) for k in (1, 0)]
    ids = F.broadcast(chosen[0].unionByName(chosen[1]))  # 2 * rows ids at most
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).join(ids, "doc_id")
    lengths = texts.select("doc_id", "toxic", F.length("text").alias("n")).groupBy("doc_id", "toxic").agg(F.sum("n").alias("n"))
    before = Window.partitionBy("toxic").orderBy(F.xxhash64("doc_id"), "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    fits = lengths.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).where(F.col("before") < FIT_CHARS)
    texts = texts.join(F.broadcast(fits.select("doc_id")), "doc_id")  # 2 * rows ids at most
    population = total.get(0, 0)

    def learn(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = sorted(zip((pdf["doc_id"].astype(object) * 2654435761) % (1 << 32), pdf["doc_id"], pdf["toxic"], pdf["text"]))
        toxic, ordinary = ([t for *_, k, t in rows if k == want] for want in (1, 0))
        model = fit(toxic, ordinary, max(1.0, population / max(1, len(ordinary))))
        return pd.DataFrame({"ordinary": [model.ordinary], "toxic": [model.toxic], "weights": [model.weights]})

    # The bounded sample goes to one task, and only the model (about 70 kB) to the driver.
    fitted = texts.withColumn("sample", F.lit(True)).groupBy("sample").applyInPandas(learn, "ordinary binary, toxic binary, weights array<double>").collect()
    return ToxicityModel(bytes(fitted[0].ordinary), bytes(fitted[0].toxic), list(fitted[0].weights)) if fitted else ToxicityModel()


def toxicity_score(text: Column, model: ToxicityModel) -> Column:
    """Score of a text column; no other column goes through Python."""
    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        pair = model.compressors() if model.weights else None
        for texts in batches:
            parts = byte_slices(texts.to_frame("text"), "text", SLICE_CHARS)
            found = [model.score(p["text"].tolist(), pair) for p in parts]
            yield pd.Series(np.concatenate(found) if found else np.zeros(0))
    return score(F.coalesce(text, F.lit("")))


def score_toxicity(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """doc_id, score (0 to 1) for every row of ``docs`` (doc_id, text).

    NULL and empty texts get the score of a text without windows. Rows are
    independent, so copies score alike; NULL ids and an empty table need
    nothing special. Other columns are not looked at. The model is about 70 kB.
    """
    small_batches(docs.sparkSession)
    return docs.select("doc_id", toxicity_score(F.col("text"), model).alias("score"))


def drop_toxic(docs: DataFrame, model: ToxicityModel, threshold: float = 0.7) -> DataFrame:
    """``docs`` without the rows that score ``threshold`` or more; all columns stay."""
    small_batches(docs.sparkSession)
    return docs.where(toxicity_score(F.col("text"), model) < threshold)
