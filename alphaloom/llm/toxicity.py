"""Toxicity by a classifier chain.

Categories are predicted one after another by linear (logistic) models; each model sees the
text's words and the probabilities that the earlier models gave. For training, those
probabilities are out-of-fold, for every row: they come from models that did not see it, as
they will be for new documents.

Fitting looks at a bounded sample of labelled documents (``max_train``, half of them toxic
where there are so many): the only bound there is. Counts of words by label are a Spark aggregation
over the whole texts of the sample; what comes to the driver is the terms (words, and beginnings of words,
since abuse is inflected) that are bound to the label more surely than chance would make some ``chance`` of
all terms seem, however many these are, and for each sampled document the few of them that it holds.
Scoring is one pass over the documents, without a shuffle.

Labels say toxic or not; the categories of a toxic document are labelled by a short list of plainly
abusive words, whose words are also shown to the model as documents of one word each, so that a table with few
labels has a model too.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD, discard, map_batches, written

# Plainly abusive words by category, which label a toxic document's categories.
LEXICON = {
    "insult": ["idiot", "idiots", "moron", "morons", "stupid", "clown", "loser", "losers", "imbecile", "dumbass", "jackass", "dimwit"],
    "contempt": ["pathetic", "worthless", "disgusting", "despicable", "contemptible", "useless"],
    "dehumanising": ["scum", "trash", "vermin", "garbage", "filth", "subhuman", "parasite"],
}
#: The categories in the chain's order; other: toxic without a word of the lexicon.
CATEGORIES = [*LEXICON, "other", "toxic"]
#: Lengths of the word beginnings that are features, so that a stem is known in all its inflections.
STEMS = range(4, 8)


def terms(words: set[str]) -> set[str]:
    """The words, and as ``stem*`` each beginning of a longer word."""
    return words | {f"{w[:k]}*" for w in words for k in STEMS if len(w) > k}


@dataclass
class ChainModel:
    """Terms (feature places 0..), then the chain's earlier probabilities."""

    words: list[str]
    weights: list[np.ndarray]
    threshold: float

    def __post_init__(self) -> None:
        self.place = {w: i for i, w in enumerate(self.words)}
        self.starts = {w[: STEMS.start] for w in self.words if w.endswith("*")}

    def features(self, held: list[list[int]]) -> np.ndarray:
        x = np.zeros((len(held), len(self.words)))
        for row, places in zip(x, held, strict=True):
            row[places] = 1
        return x

    def held(self, text: str | None) -> list[int]:
        words = set(WORD.findall((text or "").lower()))
        near = {w for w in words if w[: STEMS.start] in self.starts}
        return sorted(self.place[w] for w in self.place.keys() & (words | terms(near)))

    def predict(self, texts: list[str | None]) -> np.ndarray:
        """A row of probabilities a text, one a category."""
        x = self.features([self.held(t) for t in texts])
        for w in self.weights:
            x = np.column_stack([x, _probability(x, w)])
        return x[:, -len(self.weights) :]


def _probability(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x @ w[1:] + w[0], -30, 30)))


def fit_logistic(x: np.ndarray, y: np.ndarray, l2: float = 0.5, rounds: int = 30, start: np.ndarray | None = None) -> np.ndarray:
    """Ridge logistic regression by Newton's method, from the weights ``start`` if given; the intercept comes first and is not shrunk."""
    a = np.column_stack([np.ones(len(x)), x])
    ridge = np.full(a.shape[1], l2)
    ridge[0] = 1e-3
    w = np.zeros(a.shape[1]) if start is None else start
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a.T * np.maximum(p * (1 - p), 1e-6)) @ a + np.diag(ridge), a.T @ (y - p) - ridge * w)
        w = w + step
        if np.abs(step).max() < 1e-4:
            break
    return w


def fit_chain_on(x: np.ndarray, labels: np.ndarray, fold: np.ndarray, folds: int) -> tuple[list[np.ndarray], np.ndarray]:
    """(the chain's models, out-of-fold probabilities of every row); labels has a column a category."""
    weights, out = [], []
    for y in labels.T:
        p = np.zeros(len(x))
        whole = fit_logistic(x, y)
        for k in range(folds):
            if (fold == k).any():
                # the optimum does not depend on where the search begins
                p[fold == k] = _probability(x[fold == k], fit_logistic(x[fold != k], y[fold != k], start=whole))
        weights.append(whole)
        out.append(p)
        x = np.column_stack([x, p])
    return weights, np.column_stack(out)


def best_threshold(p: np.ndarray, y: np.ndarray) -> float:
    """The probability with the highest F1; of several in a gap the one nearest to one half."""
    if not y.any():
        return 0.5
    order = np.argsort(-p, kind="stable")
    hits = np.cumsum(y[order])
    f1 = 2 * hits / (np.arange(1, len(p) + 1) + y.sum())
    f1[:-1][p[order][:-1] == p[order][1:]] = -1
    at = int(np.argmax(f1))
    high, low = p[order][at], p[order][at + 1] if at + 1 < len(p) else 0.0
    return float(min(max(0.5, low + (high - low) / 10), high - (high - low) / 10))


def labelled_sample(docs: DataFrame, labels: DataFrame, max_train: int) -> DataFrame:
    """(doc_id, text, toxic) of at most max_train labelled documents, half of them toxic if so many are."""
    known = labels.where("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    half = lambda y: known.where(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_train // 2)
    chosen = half(1).unionByName(half(0))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    # At most max_train pairs of integers are sent to all executors; one text is kept of rows with equal ids,
    # and one row of equal texts, which are no two observations.
    each = texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))
    return each.groupBy("text").agg(F.min("doc_id").alias("doc_id"), F.max("toxic").alias("toxic"))


def telling_terms(sample: DataFrame, chance: float, min_docs: int = 3) -> list[str]:
    """The terms whose presence is bound to toxic documents, by the G statistic of their two-by-two table.

    The bound on G is where, of all terms that occur in ``min_docs`` documents, ``chance`` would pass by chance; it
    rises with the number of terms, and no number of terms is fixed. Of a term and one that begins
    it, the longer is kept only where it tells more surely.
    """
    totals = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    a, b = totals.get(1, 0), totals.get(0, 0)
    if not a or not b:
        return []
    words = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"([\p{L}\p{N}_]+)"), 1))
    stems = lambda w: [F.when(F.length(w) > k, F.concat(F.substring(w, 1, k), F.lit("*"))) for k in STEMS]
    found = F.array_compact(F.array_distinct(F.flatten(F.transform(words, lambda w: F.array(w, *stems(w))))))
    n = sample.select("toxic", F.explode(found).alias("term")).groupBy("term").agg(F.sum("toxic").alias("n1"), F.sum(1 - F.col("toxic")).alias("n0"))
    part = lambda o, e: F.when(o > 0, o * F.log(o / e)).otherwise(F.lit(0.0))
    n1, n0, t = F.col("n1").cast("double"), F.col("n0").cast("double"), float(a + b)
    g = 2 * (part(n1, (n1 + n0) * a / t) + part(n0, (n1 + n0) * b / t) + part(a - n1, (t - n1 - n0) * a / t) + part(b - n0, (t - n1 - n0) * b / t))
    usual = written(n.where(F.col("n1") + F.col("n0") >= min_docs).select("term", "n1", "n0", g.alias("g")), "terms")
    # the chance to exceed G is at most exp(-G / 2)
    least = max(10.83, 2 * math.log(max(usual.count(), 1) / chance))
    chosen: dict[str, float] = {}
    for r in usual.where((F.col("g") > least) & (n1 / a > n0 / b)).orderBy(F.desc("g"), F.length("term"), "term").collect():
        word, sure = r["term"].rstrip("*"), r["n1"] / (r["n1"] + r["n0"])
        if not any(chosen.get(f"{word[:k]}*", -1.0) >= sure for k in STEMS if k <= len(word)):
            chosen[r["term"]] = sure
    discard(usual)
    return list(chosen)


def training_rows(docs: DataFrame, labels: DataFrame, max_train: int, chance: float, folds: int) -> tuple[ChainModel, list[tuple[list[int], int, int]]]:
    """(a model without weights yet, the places of the terms held, toxic and the fold of each training row)."""
    sample = written(labelled_sample(docs, labels, max_train), "labelled")
    lexicon = [w for ws in LEXICON.values() for w in ws]
    model = ChainModel(list(dict.fromkeys(lexicon + telling_terms(sample, chance))), [], 0.5)

    def held(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = pa.array([model.held(t) for t in batch.column(2).to_pylist()], pa.list_(pa.int32()))
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), found], names=["doc_id", "toxic", "held"])

    rows = map_batches(sample.select("doc_id", "toxic", "text"), held, "doc_id long, toxic int, held array<int>").orderBy("doc_id").collect()
    discard(sample)
    own = [(list(r["held"]), r["toxic"], i % folds) for i, r in enumerate(rows)]
    # every word of the list once in each fold: out of a fold, each is known from the others
    own += [([model.place[w]], 1, k) for w in lexicon for k in range(folds)] + [([], 0, k) for _ in lexicon for k in range(folds)]
    return model, own


def fit_chain(docs: DataFrame, labels: DataFrame, *, max_train: int = 6000, chance: float = 50.0, folds: int = 5) -> ChainModel:
    """Fits the chain on at most ``max_train`` labelled documents.

    A toxic document is of a category if it holds one of its words, and of ``other`` if it holds none. To these come documents of one
    lexicon word each, labelled as toxic, and as many empty ones, each once in every fold: with few or no labels the chain
    still knows the lexicon. Labels that are null or belong to no document are passed over; a document labelled twice is
    toxic if one label says so; of texts with equal ids the least counts. Whole texts are read, of any length.
    """
    model, own = training_rows(docs, labels, max_train, chance, folds)
    x, y, fold = model.features([h for h, _, _ in own]), np.array([t for _, t, _ in own], float), np.array([k for _, _, k in own])
    of = [np.array([any(model.place[w] in h for w in ws) for h, _, _ in own]) for ws in LEXICON.values()]
    categories = [c * y for c in of] + [~np.any(of, axis=0) * y, y]
    model.weights, p = fit_chain_on(x, np.column_stack(categories), fold, folds)
    seen = len(own) - 2 * folds * sum(map(len, LEXICON.values()))
    model.threshold = best_threshold(p[:seen, -1], y[:seen]) if seen else 0.5
    return model


def score(docs: DataFrame, model: ChainModel) -> DataFrame:
    """doc_id, a probability p_<category> for each category, and toxic (1 or 0), one row a document.

    A null or empty text holds no words; a text of any length is read whole. Repeated rows give repeated rows, a null doc_id
    stays null, other columns are ignored, an empty table gives no rows.
    """
    names = [f"p_{c}" for c in CATEGORIES]

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        p = model.predict(batch.column(1).to_pylist())
        toxic = (p[:, -1] >= model.threshold).astype(np.int32)
        columns = [batch.column(0), *(pa.array(np.round(c, 6)) for c in p.T), pa.array(toxic)]
        return pa.RecordBatch.from_arrays(columns, names=["doc_id", *names, "toxic"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return map_batches(rows, run, "doc_id long, " + ", ".join(f"{n} double" for n in names) + ", toxic int")


def without_toxic(docs: DataFrame, model: ChainModel) -> DataFrame:
    """The rows of docs, with all their columns, that the chain does not find toxic."""
    at = docs.columns.index("text")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        p = model.predict(batch.column(at).to_pylist())
        return batch.filter(pa.array(p[:, -1] < model.threshold))

    return map_batches(docs, run, docs.schema)
