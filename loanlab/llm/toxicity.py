"""Toxicity: a convolutional text classifier over hashed word embeddings, trained here.

A text's words (lower-cased runs of word characters) are hashed as they are and by their
first letters (``STEMS``), and a word's embedding is the sum of these rows of one table. Filters of
several widths slide over the whole text, each keeps its maximum, and a logistic unit reads
the maxima. Because of the maximum, the length of a text does not dilute a finding.

The fit takes a bounded sample of labelled rows (``FIT_ROWS`` of each class at most, chosen by
a hash of the id, as long as their texts, short or long, have ``FIT_CHARS`` characters in sum) and
runs in numpy with Adam on the driver. A fifth of the sample is kept back: on it and on all labelled rows
beyond the sample, scored by Spark and counted by logit (rounded to ``1 / STEPS``), the logit is scaled so that
the score is a probability at the classes' true shares, and a threshold is chosen for every
language that has enough rows of both classes (others share one threshold over all). Scoring
covers whole texts on the executors, a stretch at a time with the overlap that the widest
filter needs, so a very long text takes bounded memory and gives the same maxima.

The score sees the text only. The language is used for the decision threshold alone.

Defined results: null texts count as empty and get the score of no words; without labels of
both classes every score is the share of class 1 (0 without labels); labels that are null or
whose document is missing are not learned from; an id labelled twice is learned from once,
with its larger label; repeated rows come out as they came in; an empty table gives no rows;
other columns are ignored unless kept.
"""

from __future__ import annotations

import re
from zlib import crc32

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loanlab.llm.common import Shared, col, fresh, kept, map_texts, ship, text_of, worker_slot
from loanlab.llm.pretokens import Memo

ship(__name__)

FIT_ROWS = 2_000      # labelled rows of each class that are learned from
FIT_CHARS = 32_000_000  # characters that are learned from, over all rows
BUCKETS = 1 << 15     # rows of the embedding table, a power of two
DIMS, FILTERS, WIDTHS = 12, 12, (1, 2, 3)
STEMS = (4, 5, 6)     # letters of the further hashes
EPOCHS, BATCH, RATE, DECAY = 8, 32, 0.01, 1e-5
STRETCH = 1 << 14     # words scored at a time
STEPS, MOST = 128, 40  # logits are counted in steps of 1 / STEPS up to this size: bounds what the driver gets
LEAST_OF_CLASS = 20   # rows of each class that a language needs for a threshold of its own
_WORDS = re.compile(r"\w+").findall


def _codes(word: str) -> int:
    """All bucket numbers of a word in one int, 15 bits each."""
    code = crc32(word.encode()) % BUCKETS
    for letters in STEMS:
        code = code << 15 | crc32(b"%d^" % letters + word[:letters].encode()) % BUCKETS
    return code


class Classifier:
    """Weights, scaling and thresholds. A few megabytes, whatever the corpus."""

    def __init__(self, share: float, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.share, self.fitted = share, False
        self.scale, self.shift = 1.0, 0.0
        self.thresholds, self.threshold = {}, 0.5
        f32 = np.float32
        self.weights = {"table": rng.normal(0, 0.1, (BUCKETS, DIMS)).astype(f32),
                        "out": rng.normal(0, 0.1, FILTERS * len(WIDTHS)).astype(f32), "bias": np.zeros(1, f32)}
        for w in WIDTHS:
            self.weights[f"conv{w}"] = rng.normal(0, (w * DIMS) ** -0.5, (w * DIMS, FILTERS)).astype(f32)
            self.weights[f"conv{w}_bias"] = np.zeros(FILTERS, f32)

    # ------------------------------------------------------------ forward

    def encode(self, text: str, memo) -> np.ndarray:
        words = _WORDS(text.lower())
        packed = np.fromiter(map(memo.__getitem__, words), np.int64, len(words))
        return np.stack([packed >> 15 * k & BUCKETS - 1 for k in range(len(STEMS) + 1)], axis=1)

    def _embed(self, ids: np.ndarray) -> np.ndarray:
        table = self.weights["table"]
        return sum((table[ids[:, k]] for k in range(1, ids.shape[1])), start=table[ids[:, 0]])

    def _maxima(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Largest response of every filter, and where it starts. A short text is padded with silence."""
        tops, places = [], []
        x = self._embed(ids)
        if len(x) < max(WIDTHS):
            x = np.concatenate((x, np.zeros((max(WIDTHS) - len(x), DIMS), np.float32)))
        for w in WIDTHS:
            kernel, n = self.weights[f"conv{w}"], len(x) - w + 1
            y = x[:n] @ kernel[:DIMS]
            for k in range(1, w):
                y += x[k:k + n] @ kernel[k * DIMS:(k + 1) * DIMS]
            at = y.argmax(axis=0)
            tops.append(y[at, np.arange(FILTERS)] + self.weights[f"conv{w}_bias"])
            places.append(at)
        return np.concatenate(tops), np.concatenate(places)

    def _tops(self, ids: np.ndarray) -> np.ndarray:
        """The maxima alone, by one product for all filters."""
        x = self._embed(ids)
        if len(x) < max(WIDTHS):
            x = np.concatenate((x, np.zeros((max(WIDTHS) - len(x), DIMS), np.float32)))
        slices = [self.weights[f"conv{w}"][k * DIMS:(k + 1) * DIMS] for w in WIDTHS for k in range(w)]
        y, at, tops = np.concatenate(slices, axis=1).T @ x.T, 0, []
        for w in WIDTHS:
            n = len(x) - w + 1
            z = y[at:at + FILTERS, :n]
            for k in range(1, w):
                z = z + y[at + k * FILTERS:at + (k + 1) * FILTERS, k:k + n]
            tops.append(z.max(axis=1) + self.weights[f"conv{w}_bias"])
            at += w * FILTERS
        return np.concatenate(tops)

    def logit(self, ids: np.ndarray) -> float:
        step = STRETCH - max(WIDTHS) + 1
        tops = np.max([self._tops(ids[a:a + STRETCH])
                       for a in range(0, max(1, len(ids) - max(WIDTHS) + 1), step)], axis=0)
        return float(np.maximum(tops, 0) @ self.weights["out"] + self.weights["bias"][0])

    def score(self, ids: np.ndarray) -> float:
        if not self.fitted:
            return self.share
        z = self.scale * self.logit(ids) + self.shift
        return float(1 / (1 + np.exp(-np.clip(z, -40, 40))))

    # ------------------------------------------------------------ fit

    def _gradients(self, batch: list[np.ndarray], labels: np.ndarray) -> dict[str, np.ndarray]:
        grads = {k: np.zeros_like(v) for k, v in self.weights.items()}
        out = self.weights["out"]
        for ids, label in zip(batch, labels):
            tops, places = self._maxima(ids)
            live = np.maximum(tops, 0)
            p = 1 / (1 + np.exp(-np.clip(float(live @ out + self.weights["bias"][0]), -40, 40)))
            err = np.float32((p - label) / len(batch))
            grads["bias"] += err
            grads["out"] += err * live
            back = err * out * (tops > 0)
            for j, w in enumerate(WIDTHS):
                mine = slice(j * FILTERS, (j + 1) * FILTERS)
                g, at = back[mine], places[mine]
                grads[f"conv{w}_bias"] += g
                kernel = self.weights[f"conv{w}"]
                for k in range(w):
                    where = at + k
                    real = where < len(ids)
                    rows = ids[where[real]]
                    part = slice(k * DIMS, (k + 1) * DIMS)
                    grads[f"conv{w}"][part][:, real] += (self._embed(rows) * g[real, None]).T
                    push = kernel[part][:, real].T * g[real, None]
                    for column in range(rows.shape[1]):
                        np.add.at(grads["table"], rows[:, column], push)
        return grads

    def fit(self, ids: list[np.ndarray], labels: np.ndarray, seed: int = 11) -> np.ndarray:
        """Learns the weights from four fifths of the rows; returns the places of the others."""
        rng = np.random.default_rng(seed)
        order = rng.permutation(len(ids))
        held, train = order[:len(ids) // 5], order[len(ids) // 5:]
        first = {k: np.zeros_like(v) for k, v in self.weights.items()}
        second = {k: np.zeros_like(v) for k, v in self.weights.items()}
        step = 0
        for _ in range(EPOCHS):
            rng.shuffle(train)
            for a in range(0, len(train), BATCH):
                pick, step = train[a:a + BATCH], step + 1
                grads = self._gradients([ids[i] for i in pick], labels[pick])
                rate = RATE * (1 - 0.999 ** step) ** 0.5 / (1 - 0.9 ** step)
                for k, g in grads.items():
                    first[k] += 0.1 * (g - first[k])
                    second[k] += 0.001 * (g * g - second[k])
                    self.weights[k] -= rate * (first[k] / (np.sqrt(second[k]) + 1e-8) + DECAY * self.weights[k])
        self.fitted = True
        return held

    def calibrate(self, z: np.ndarray, y: np.ndarray, langs: list, n: np.ndarray) -> None:
        """Scale and shift by weighted logistic regression at the true shares, then the thresholds.

        ``n``: rows of that logit, label and language.
        """
        if not len(z):
            return
        total, ones = n.sum(), max(1, (n * y).sum())
        weight = n * np.where(y == 1, self.share / ones, (1 - self.share) / max(1, total - ones)) * total
        goal = np.where(y == 1, (ones + 1) / (ones + 2), 1 / (total - ones + 2))  # smoothed: never sure
        a = b = 0.0
        for _ in range(50):  # Newton steps, damped
            p = 1 / (1 + np.exp(-np.clip(a * z + b, -40, 40)))
            r, h = weight * (p - goal), weight * p * (1 - p) + 1e-6
            grad = np.array([(r * z).sum() + 1e-3 * a, r.sum()])
            hess = np.array([[(h * z * z).sum() + 1e-3, (h * z).sum()], [(h * z).sum(), h.sum()]])
            move = np.linalg.solve(hess, grad)
            move *= min(1.0, 2.0 / max(1e-9, np.abs(move).max()))
            a, b = a - move[0], b - move[1]
        self.scale, self.shift = float(a), float(b)
        scores = 1 / (1 + np.exp(-np.clip(a * z + b, -40, 40)))
        self.threshold = _best_cut(scores, y, weight)
        for lang in sorted({x for x in langs if x is not None}):
            own = np.array([x == lang for x in langs])
            if min((n * y)[own].sum(), (n * (1 - y))[own].sum()) >= LEAST_OF_CLASS:
                self.thresholds[lang] = _best_cut(scores[own], y[own], weight[own])


def _best_cut(scores: np.ndarray, y: np.ndarray, weight: np.ndarray) -> float:
    """The middle of the widest range of cuts with the best weighted F1."""
    edges = np.unique(np.concatenate(([0.0], scores, [1.0])))
    cuts = (edges[1:] + edges[:-1]) / 2
    best, at = -1.0, 0.5
    for low, high, cut in zip(edges[:-1], edges[1:], cuts):
        said = scores >= cut
        hit = (weight * said * y).sum()
        f1 = 2 * hit / max(1e-12, (weight * said).sum() + (weight * y).sum())
        key = round(float(f1), 9) + 1e-6 * (high - low)
        if key > best:
            best, at = key, float(cut)
    return min(0.95, max(0.05, at))


# ---------------------------------------------------------------- Spark

def held_out(id_col: str = "doc_id") -> Column:
    """Rows that no label may be learned from."""
    return F.coalesce(F.crc32(col(id_col).cast("string")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", lang: str = "lang",
        label: str = "toxic", fit_rows: int = FIT_ROWS, fit_chars: int = FIT_CHARS) -> Classifier:
    """Weights from a bounded sample of the labelled rows that are not held out, scale and thresholds from all the others."""
    known = (labels.where(col(label).isin(0, 1) & col(id_col).isNotNull() & ~held_out(id_col))
             .groupBy(col(id_col).alias("i")).agg(F.max(col(label)).cast("int").alias("y")))
    shares = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}  # two rows
    total = sum(shares.values())
    model = Classifier(shares.get(1, 0) / total if total else 0.0)
    if len(shares) < 2:
        return model
    spoken = col(lang).cast("string") if lang in docs.columns else F.lit(None).cast("string")
    pool = None  # twice the rows, as some have no usable text; their number is bounded
    for y in (0, 1):
        some = known.where(F.col("y") == y).orderBy(F.xxhash64("i"), "i").limit(2 * fit_rows)
        pool = some if pool is None else pool.unionByName(some)
    texts = docs.select(col(id_col).alias("i"), text_of(text).alias("t"), spoken.alias("l"))
    rows, in_order = [], W.orderBy(F.xxhash64("i"), "i")
    found = texts.join(F.broadcast(pool), "i").groupBy("i", "y").agg(F.min(F.struct("t", "l")).alias("r"))
    for y in (0, 1):
        some = found.where(F.col("y") == y).orderBy(F.xxhash64("i"), "i").limit(fit_rows)
        upto = F.sum(F.length("r.t")).over(in_order)  # over at most fit_rows rows
        rows += some.withColumn("upto", upto).where(F.col("upto") <= fit_chars // 2).collect()
    y = np.array([r["y"] for r in rows], np.float32)
    if len(rows) < 10 or y.min() == y.max():
        return model
    memo = Memo(_codes)
    ids = [model.encode(r["r"]["t"], memo) for r in rows]
    held = model.fit(ids, y)
    z, labelled, langs, n = _counted(texts, known, model, [r["i"] for r in rows], docs.sparkSession)
    model.calibrate(np.concatenate(([model.logit(ids[i]) for i in held], z)), np.concatenate((y[held], labelled)),
                    [rows[i]["r"]["l"] for i in held] + langs, np.concatenate((np.ones(len(held)), n)))
    return model


def _counted(texts: DataFrame, known: DataFrame, model: Classifier, sample: list, spark) -> tuple:
    """Logit, label, language and rows, of all labelled rows beyond the sample."""
    sent = Shared(spark, model)

    def start():
        net, memo = sent.value, worker_slot(("toxicity",), lambda: Memo(_codes, 100_000))
        return lambda texts: [[net.logit(net.encode(t, memo)) for t in texts]]
    seen = spark.createDataFrame([(i,) for i in sample], known.select("i").schema)
    if texts.schema["i"].dataType == known.schema["i"].dataType:  # else the ids' texts may differ
        texts = texts.where(~held_out("i"))
    # the texts are scored where they lie, labelled or not: only ids and logits are moved to the labels
    rows = map_texts(texts.withColumn("h", F.xxhash64("t")), "t", ("i", "h", "l"), "z double", start)
    step = F.round(F.greatest(F.least("z", F.lit(float(MOST))), F.lit(-float(MOST))) * STEPS).cast("int")
    one = (rows.select("i", F.struct("h", "l", step.alias("step")).alias("r"))
           .join(known.join(F.broadcast(seen), "i", "left_anti"), "i").groupBy("i", "y").agg(F.min("r").alias("r")))
    bins = one.groupBy("y", "r.l", "r.step").agg(F.count(F.lit(1)).alias("n")).orderBy("y", "l", "step").collect()
    return (np.array([b["step"] for b in bins], float) / STEPS, np.array([b["y"] for b in bins], np.float32),
            [b["l"] for b in bins], np.array([b["n"] for b in bins], float))


def score(docs: DataFrame, model: Classifier, text: str = "text", keep: tuple = ("doc_id",)) -> DataFrame:
    """Kept columns and ``score``: the probability of class 1, from the whole text."""
    sent = Shared(docs.sparkSession, model)

    def start():
        known, memo = sent.value, worker_slot(("toxicity",), lambda: Memo(_codes, 100_000))
        return lambda texts: [[known.score(known.encode(t, memo)) for t in texts]]
    return map_texts(docs, text, kept(keep, ("score",)), "score double", start)


def threshold_of(model: Classifier, lang: str = "lang") -> Column:
    """The language's own threshold, else the one over all."""
    out = F.lit(model.threshold)
    for name, cut in sorted(model.thresholds.items()):
        out = F.when(col(lang) == name, F.lit(cut)).otherwise(out)
    return out


def keep_clean(docs: DataFrame, model: Classifier, text: str = "text", lang: str = "lang") -> DataFrame:
    """The documents, with all columns, whose score stays under their language's threshold."""
    whole, mark = fresh(docs, "_whole", "_score")
    cut = threshold_of(model, lang) if lang in docs.columns else F.lit(model.threshold)
    if not model.fitted:
        return docs  # nothing was learned: nothing is rejected
    sent = Shared(docs.sparkSession, model)

    def start():
        known, memo = sent.value, worker_slot(("toxicity",), lambda: Memo(_codes, 100_000))
        return lambda texts: [[known.score(known.encode(t, memo)) for t in texts]]
    scored = map_texts(docs.withColumn(whole, col(text)), whole, docs.columns, f"`{mark}` double", start)
    return scored.where(col(mark) < cut).select(*[col(c) for c in docs.columns])
