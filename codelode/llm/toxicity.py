"""Counterfactual-regularised toxicity classifier.

A logistic model over the presence of words and of word beginnings (4 to 6 characters). It is trained on labelled
texts and on counterfactual versions of them: in a text that names a group, every identity term is swapped for another
of its kind; of texts that name none, one in ``INSERTED`` gets a mention inserted, the terms taking turns by the
text's digest. The loss adds the squared change of the score between a text and its counterfactual version, so a
mere mention of a group cannot carry weight, whether or not the corpus names it.

Fitting reads a bounded sample: at most ``MOST_TOXIC`` toxic and ``MOST_CLEAN`` other labelled texts, chosen by a hash
of the id, reweighted to the classes' shares. Features are counted by tasks and summed by Spark. Those that speak most
clearly for toxicity are kept, as many as there are sampled texts and ``FEATURES`` at most, and the squared weights
count less the more texts there are, so nothing in the model is tied to one size of the table. What comes to the
driver is bounded: features and, for each sampled text, the list of those it has. Scoring is one pass over all texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, staged, steps, texts_of
from .decontaminate import normal
from .words import coded_words

MOST_TOXIC, MOST_CLEAN, FEATURES = 6_000, 12_000, 4_096
PREFIXES = (4, 5, 6)
THRESHOLD = 0.3
#: Weights of the counterfactual penalty and, per sampled text, of the squared weights.
COUNTERFACTUAL, RIDGE = 1.0, 0.1
#: One text in so many that name no group gets a mention inserted.
INSERTED = 4
#: Identity terms by kind; a term is swapped for the next of its kind.
IDENTITY_TERMS = (
    ("women", "men"),
    ("woman", "man"),
    ("female", "male"),
    ("girls", "boys"),
    ("girl", "boy"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("black", "white", "asian", "latino", "african", "european"),
    ("gay", "straight", "lesbian", "bisexual"),
    ("transgender", "cisgender"),
    ("immigrants", "refugees", "natives"),
    ("immigrant", "refugee", "native"),
    ("deaf", "blind", "disabled"),
    ("old", "young"),
    ("mexican", "american", "chinese", "indian", "russian", "german", "french", "spanish"),
    ("femmes", "hommes"),
    ("musulmans", "chrétiens", "juifs"),
    ("frauen", "männer"),
    ("muslime", "christen", "juden"),
    ("mujeres", "hombres"),
    ("musulmanes", "cristianos", "judíos"),
)
SWAPS = {t: kind[(k + 1) % len(kind)] for kind in IDENTITY_TERMS for k, t in enumerate(kind)}
MENTIONS = list(SWAPS)


def features_of(word: str) -> list[int]:
    """Hashes of a normalised word's features. An identity term has no beginnings: it shares none with other words."""
    out = [xxhash.xxh3_64_intdigest(f"w {word}")]
    out += [xxhash.xxh3_64_intdigest(f"{n} {word[:n]}") for n in PREFIXES if len(word) >= n and word not in SWAPS]
    return [x - (1 << 64) if x >= 1 << 63 else x for x in out]


def _documents(texts: pa.Array) -> tuple[list[str], list[np.ndarray]]:
    """Normalised distinct words of a batch, and of each text the distinct ones as numbers."""
    raw, codes, bounds = coded_words(texts)
    names: dict[str, int] = {}
    to = np.array([names.setdefault(normal(w), len(names)) for w in raw], dtype=np.int64)
    codes = to[codes] if len(codes) else codes
    return list(names), [np.unique(codes[a:b]) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts with each feature, by label, within a step."""
    for batch in steps(batches):
        names, docs = _documents(batch.column("text"))
        lists = [np.array(features_of(w) if w else [], dtype=np.int64) for w in names]
        for label in (0, 1):
            own = [np.unique(np.concatenate([lists[k] for k in d])) for d, y in zip(docs, batch.column("label").to_pylist()) if y == label and len(d)]
            if own:
                found, n = np.unique(np.concatenate(own), return_counts=True)
                zero = np.zeros(len(found), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(n if label else zero), pa.array(zero if label else n)], names=["feature", "toxic", "clean"])


def _lookup(index: dict[int, int], names: list[str]) -> list[list[int]]:
    return [[index[f] for f in features_of(w) if f in index] if w else [] for w in names]


def _vectors(index: dict[int, int]):
    """Per sampled text the numbers of its features, and those of its counterfactual version if it has one."""
    mentions = _lookup(index, MENTIONS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches):
            names, docs = _documents(batch.column("text"))
            own = _lookup(index, names)
            swapped = {k: _lookup(index, [SWAPS[w]])[0] for k, w in enumerate(names) if w in SWAPS}
            has, other = [], []
            for d, text in zip(docs, batch.column("text")):
                words = d.tolist()
                has.append(sorted({f for k in words for f in own[k]}))
                lot = xxhash.xxh3_64_intdigest(text.as_buffer())
                if any(k in swapped for k in words):
                    other.append(sorted({f for k in words for f in swapped.get(k, own[k])}))
                else:
                    other.append(sorted({*has[-1], *mentions[lot // INSERTED % len(MENTIONS)]}) if lot % INSERTED == 0 else None)
            kind = pa.list_(pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column("label"), pa.array(has, kind), pa.array(other, kind)], names=["label", "has", "swapped"])

    return run


class Model:
    """Weights by feature hash and the intercept."""

    def __init__(self, weights: dict[int, float], bias: float):
        self.weights, self.bias = weights, bias

    def scores(self, texts: pa.Array) -> np.ndarray:
        names, docs = _documents(texts)
        index = self.weights
        lists = [[f for f in features_of(w) if f in index] if w else [] for w in names]
        useful = np.array([bool(x) for x in lists], dtype=bool)
        out = np.full(len(docs), self.bias)
        for k, d in enumerate(docs):
            if len(d) and len(d := d[useful[d]]):
                out[k] += sum(index[f] for f in {f for w in d.tolist() for f in lists[w]})
        return 1 / (1 + np.exp(-np.clip(out, -30, 30)))


def _flat(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Row and value of every element of a list array."""
    return np.repeat(np.arange(len(lists)), pc.list_value_length(lists).fill_null(0).to_numpy(zero_copy_only=False)), lists.flatten().to_numpy().astype(np.int64)


def train(labels: np.ndarray, has: pa.Array, swapped: pa.Array, weights: np.ndarray, n_features: int, counterfactual: float = COUNTERFACTUAL, ridge: float = RIDGE, turns: int = 400) -> tuple[np.ndarray, float]:
    """Weights and intercept with the least weighted log loss + penalties, by full-batch Adam steps.

    has, swapped: lists of the features of each text and of its counterfactual version, null without one.
    """
    ridge = ridge / len(labels)
    rows, cols = _flat(has)
    pairs = np.flatnonzero(swapped.is_valid().to_numpy(zero_copy_only=False))
    rows2, cols2 = _flat(swapped.drop_null())
    n, total = len(labels), weights.sum()
    share = min(max((weights * labels).sum() / total, 1e-3), 1 - 1e-3)
    w, b = np.zeros(n_features), float(np.log(share / (1 - share)))
    m, v = np.zeros(n_features + 1), np.zeros(n_features + 1)
    for t in range(1, turns + 1):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(rows, w[cols], n) + b, -30, 30)))
        g = weights * (p - labels) / total
        gw, gb = np.bincount(cols, g[rows], n_features) + 2 * ridge * w, g.sum()
        if len(pairs):
            q = 1 / (1 + np.exp(-np.clip(np.bincount(rows2, w[cols2], len(pairs)) + b, -30, 30)))
            own = p[pairs]
            d = 2 * counterfactual * weights[pairs] * (own - q) / weights[pairs].sum()
            up = np.zeros(n)
            up[pairs] = d * own * (1 - own)
            down = d * q * (1 - q)
            gw += np.bincount(cols, up[rows], n_features) - np.bincount(cols2, down[rows2], n_features)
            gb += up.sum() - down.sum()
        g = np.append(gw, gb)
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        step = 0.1 * (1 - t / turns) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
        w, b = w - step[:-1], b - step[-1]
    return w, b


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """Train on the labelled texts of ``docs`` (labels: id_col, label_col of 0 or 1).

    Labels that differ for an id count as 1; null ids and other labels are left out. Rows that repeat a labelled id
    are a text each; null and empty texts count as texts without words. Without texts of both labels the model has
    no weights and scores every text alike.
    """
    known = labels.select(labels[id_col].cast("long").alias("doc_id"), labels[label_col].cast("int").alias("label")).filter("doc_id IS NOT NULL AND label IN (0, 1)").groupBy("doc_id").agg(F.max("label").alias("label"))
    known = staged(known, "known")
    totals = {r[0]: r[1] for r in known.groupBy("label").count().collect()}
    parts = [known.filter(F.col("label") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most) for y, most in ((1, MOST_TOXIC), (0, MOST_CLEAN))]
    chosen = staged(parts[0].unionByName(parts[1]), "chosen")  # 18,000 rows at most, so it may be broadcast
    texts = staged(texts_of(docs, id_col, text_col).join(F.broadcast(chosen), "doc_id").select("text", "label"), "labelled_texts")
    counts = texts.mapInArrow(lean(_count), "feature long, toxic long, clean long").groupBy("feature").agg(F.sum("toxic").alias("t"), F.sum("clean").alias("c"))
    seen = {r[0]: r[1] for r in texts.groupBy("label").count().collect()}
    n1, n0 = seen.get(1, 0), seen.get(0, 0)
    if not n1 or not n0:
        share = (n1 + 0.5) / (n1 + n0 + 1)
        return Model({}, float(np.log(share / (1 - share))))
    expected = (F.col("t") + F.col("c")) * n1 / (n1 + n0)
    clear = F.col("t") * F.log(F.col("t") / expected)
    top = counts.filter(clear > 0).orderBy(clear.desc(), "feature").limit(min(FEATURES, n1 + n0)).collect()
    named = {f for term in SWAPS for f in features_of(term)[:1]}
    index = {f: k for k, f in enumerate(dict.fromkeys([r["feature"] for r in top] + sorted(named)))}
    rows = texts.mapInArrow(lean(_vectors(index)), "label int, has array<int>, swapped array<int>").toArrow()
    y = rows.column("label").to_numpy().astype(float)
    weight = np.where(y == 1, totals.get(1, 0) / n1, totals.get(0, 0) / n0)
    w, b = train(y, rows.column("has").combine_chunks(), rows.column("swapped").combine_chunks(), weight, len(index))
    return Model({f: float(w[k]) for f, k in index.items() if w[k]}, float(b))


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score and predicted of every row; null texts count as empty, whose score is the intercept's. Extra columns are ignored."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches):
            s = sent.value.scores(batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(s), pa.array((s >= threshold).astype(np.int32))], names=["doc_id", "score", "predicted"])

    return texts_of(docs, id_col, text_col).mapInArrow(lean(run), "doc_id long, score double, predicted int")


def without_toxic(docs: DataFrame, model: Model, threshold: float = THRESHOLD, text_col: str = "text") -> DataFrame:
    """``docs`` without the rows whose score reaches the threshold, filtered where they are, with all their columns.

    Null and empty texts have the intercept's score. Null and repeated ids are rows like others.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, text_col):
            yield batch.filter(pa.array(sent.value.scores(batch.column(text_col).fill_null("")) < threshold))

    return docs.mapInArrow(lean(run), docs.schema)


def fold(id_col: str = "doc_id"):
    """crc32 of the id as text, modulo 4; 2 is held out."""
    return F.crc32(F.col(id_col).cast("string")) % 4
