"""Toxicity by weak supervision.

Many voters look at a text: a seed lexicon, lexicons of words and word beginnings mined from labelled
training rows, and patterns. A generative label model, a log-linear model of the label and all voters
with factors for voters that depend on each other, estimates their accuracies and correlations; a
linear classifier is then trained on the posterior labels. Rows are scored by it alone.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizerModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leakloom.session import discard, materialize, ship_package

#: Features of the classifier at most (those that tell the labels apart best), and training rows that have to hold a feature.
MAX_FEATURES, SUPPORT = 8_000, 4
#: Share of toxic rows (at even classes) from which on a mined feature belongs to a lexicon.
PURITY = 0.8
#: How far from chance a feature of a lexicon has to be, as a negative logarithm.
SURPRISE = math.log(20 * MAX_FEATURES)
#: Characters of the word beginnings that are mined.
PREFIXES = (3, 4, 5, 6, 7)
#: Words whose features a worker remembers, and the longest of them.
REMEMBERED, LONG = 200_000, 64
# Common English insults.
SEEDS = frozenset("idiot idiots moron morons stupid dumb trash garbage pathetic worthless disgusting clown scum loser losers imbecile fool jerk bastard creep freak ugly filthy vermin dimwit lowlife scumbag".split())
_WORD = re.compile(r"[^\W\d_]+")
_AIMED = re.compile(r"\b(?:you|your|youre|they|he|she)\W+(?:\w+\W+){0,3}?(?:%s)\b" % "|".join(sorted(SEEDS)), re.IGNORECASE)
_LOUD = re.compile(r"!{2,}|\b[A-Z]{4,}\b(?:\W+\b[A-Z]{4,}\b)+")
VOTERS = ("seed", "seeds", "words", "begin3", "begin4", "begin5", "begin6", "begin7", "hits2", "hits3", "hits5", "dense", "aimed", "loud", "clean")
#: How often a gold label is taken to be right, as a vote among others, and pairs of voters whose correlation the label
#: model estimates at most: defaults, and what train() chooses among by rows whose gold label the fit does not see.
GOLD, EDGES = 0.999, 80
CHOICES = ((0.9, 80), (0.98, 80), (0.999, 80), (0.999, 40))
#: How strong a correlation has to be, and parts of the rows that take turns at a choice.
CORRELATED, FOLDS = 0.05, 2
#: L2 penalty of the classifier, its steps at most, and the relative gain at which it stops.
PENALTY, STEPS, GAIN = 1e-4, 100, 1e-6
#: Voters that look at words; share of a text's distinct words that have to be in a lexicon for the vote `dense`.
BY_WORDS, DENSE = 12, 0.02


def features_of(word: str) -> list[str]:
    return [word, *(f"{word[:n]}-" for n in PREFIXES if len(word) > n)]


def words_in(text: str | None) -> set[str]:
    return set(_WORD.findall(text.lower())) if text else set()


@dataclass
class Model:
    """What scoring needs: a place and a weight for each feature, and the lexicons."""

    places: dict[str, int] = field(default_factory=dict)
    lexicon: list[int] = field(default_factory=list)  # per feature its voter, or -1
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    voter_weights: np.ndarray = field(default_factory=lambda: np.zeros(len(VOTERS)))
    bias: float = 0.0

    def hits(self, text: str | None) -> tuple[set[int], np.ndarray]:
        """The features in a text, and which voters fire."""
        known = self.__dict__.setdefault("_memo", {})
        found: set[int] = set()
        words, in_lexicon = words_in(text), 0
        for w in words:
            at = known.get(w)
            if at is None:
                at = tuple(self.places[f] for f in features_of(w) if f in self.places)
                if len(w) <= LONG:
                    if len(known) > REMEMBERED:
                        known.clear()
                    known[w] = at
            if at:
                found.update(at)
                in_lexicon += any(self.lexicon[i] >= 0 for i in at)
        fires = np.zeros(len(VOTERS))
        seeds = len(words & SEEDS)
        fires[0], fires[1] = seeds > 0, seeds > 1
        for i in found:
            if self.lexicon[i] >= 0:
                fires[self.lexicon[i]] = 1
        fires[8:11] = in_lexicon >= 2, in_lexicon >= 3, in_lexicon >= 5
        fires[11] = in_lexicon > DENSE * len(words)
        fires[12] = bool(seeds) and bool(_AIMED.search(text))
        fires[13] = bool(text) and bool(_LOUD.search(text))
        fires[14] = not fires[:BY_WORDS].any()
        return found, fires

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "_memo"}

    def score(self, text: str | None) -> float:
        found, fires = self.hits(text)
        z = self.bias + float(fires @ self.voter_weights) + sum(self.weights[i] for i in found)
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def training_rows(docs: DataFrame, labels: DataFrame, usable) -> tuple[DataFrame, int, int]:
    """doc_id, text and toxic of all usable labelled rows, written, and how many of each label there are.

    An id with both labels is toxic: what someone has marked is not learned as clean.
    """
    known = labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1)).filter(usable(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(known, "doc_id")
    # Rows that repeat an id are one row with one of their texts.
    rows = materialize(texts.groupBy("doc_id").agg(F.min("text").alias("text"), F.first("toxic").alias("toxic")), "labelled")
    n = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    return rows, n.get(1, 0), n.get(0, 0)


def _half(doc_id: int) -> int:
    return (doc_id * 2654435761 >> 7) & 1


def _fold(doc_id: int) -> int:
    return (doc_id * 2654435761 >> 9) % FOLDS


def _count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of each label that hold a feature, over the mining half of the training rows."""
    pos, neg = Counter(), Counter()
    for batch in batches:
        for doc_id, text, toxic in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            if not _half(doc_id):
                (pos if toxic else neg).update({f for w in words_in(text) for f in features_of(w)})
        if len(pos) + len(neg) > 400_000:
            yield _counts(pos, neg)
            pos, neg = Counter(), Counter()
    yield _counts(pos, neg)


def _counts(pos: Counter, neg: Counter) -> pa.RecordBatch:
    names = list(pos.keys() | neg.keys())
    return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([pos[f] for f in names], pa.int64()), pa.array([neg[f] for f in names], pa.int64())], ["feature", "pos", "neg"])


def mine(rows: DataFrame) -> Model:
    """The features that tell the labels apart most, and of them the lexicons; at most MAX_FEATURES rows are gathered."""
    counts = rows.select("doc_id", "text", "toxic").mapInArrow(_count_batches, "feature string, pos long, neg long").groupBy("feature").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    totals = rows.filter("(shiftright((doc_id & 255) * 2654435761, 7) & 1) = 0").groupBy().agg(F.sum("toxic").alias("p"), F.sum(1 - F.col("toxic")).alias("n")).first()
    p, n = (totals["p"] or 0) + 1, (totals["n"] or 0) + 1
    odds = F.log(((F.col("pos") + 0.5) / p) / ((F.col("neg") + 0.5) / n))
    found = counts.filter(F.col("pos") + F.col("neg") >= SUPPORT).withColumn("odds", odds)
    weight = F.abs("odds") * F.sqrt(F.col("pos") + F.col("neg"))
    best = found.orderBy(weight.desc(), "feature").limit(MAX_FEATURES).collect()
    model = Model()
    for r in best:
        model.places[r["feature"]] = len(model.lexicon)
        pure = (r["pos"] / p) / (r["pos"] / p + (r["neg"] + 0.5) / n) >= PURITY and surprise(r["pos"], r["neg"], p / (p + n)) > SURPRISE
        begins = r["feature"].endswith("-")
        model.lexicon.append((len(r["feature"]) - 1 if begins else 2) if pure else -1)
    model.weights = np.zeros(len(model.lexicon))
    return model


def surprise(pos: int, neg: int, share: float) -> float:
    """How unlikely chance alone gives a feature these labels, as a negative logarithm (Chernoff's bound)."""
    k = pos + neg
    of = pos / k
    return k * sum(q * math.log(q / base) for q, base in ((of, share), (1 - of, 1 - share)) if q > 0) if of > share else 0.0


@dataclass
class LabelModel:
    """A log-linear model of a label y and voters v, all 0 or 1: p(y, v) is proportional to

    exp(bias y + sum of (rate[j] + accuracy[j] y) v[j] + sum over edges (j, k) of correlation v[j] v[k]).

    It is small enough to be summed over all states, so its expectations are exact.
    """

    rate: np.ndarray
    accuracy: np.ndarray
    edges: list[tuple[int, int]]
    correlation: np.ndarray
    share: float

    def __post_init__(self) -> None:
        m = len(self.rate)
        self.states = ((np.arange(1 << m)[:, None] >> np.arange(m)) & 1).astype(np.float32)
        self.parts = np.concatenate([self.states, *[self.states[:, j : j + 1] * self.states[:, k : k + 1] for j, k in self.edges]], 1)

    def _levels(self) -> np.ndarray:
        """The exponents without the bias (y x state)."""
        plain = self.parts @ np.concatenate([self.rate, self.correlation]).astype(np.float32)
        return np.stack([plain, plain + self.states @ self.accuracy.astype(np.float32)]).astype(float)

    def summed(self) -> tuple[np.ndarray, float]:
        """p(y, v) of all states (y x state), and the bias, which is such that y has its share."""
        levels = self._levels()
        top = levels.max(1, keepdims=True)
        p = np.exp(levels - top)
        total = p.sum(1, keepdims=True)
        log_total = (top + np.log(total))[:, 0]
        return p / total * np.array([[1 - self.share], [self.share]]), math.log(self.share / (1 - self.share)) + log_total[0] - log_total[1]

    def joint(self) -> np.ndarray:
        return self.summed()[0]

    def bias(self) -> float:
        return self.summed()[1]

    def posterior(self, fires: np.ndarray, known: np.ndarray | float = 0.0, bias: float | None = None) -> np.ndarray:
        """p(y = 1) of rows of votes; known are log odds from elsewhere."""
        return 1 / (1 + np.exp(-np.clip((self.bias() if bias is None else bias) + fires @ self.accuracy + known, -30, 30)))


def _independent(fires: np.ndarray, post: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How often each voter fires on rows of label 0 and of label 1."""
    return tuple((q @ fires + 0.5) / (q.sum() + 1.0) for q in ((1 - post) * weight, post * weight))


def dependencies(fires: np.ndarray, post: np.ndarray, weight: np.ndarray, most: int = EDGES) -> list[tuple[int, int]]:
    """The pairs of voters that agree, or disagree, most beyond what the label explains."""
    r0, r1 = _independent(fires, post, weight)
    residual = fires - (post[:, None] * r1 + (1 - post)[:, None] * r0)
    scale = np.sqrt((weight[:, None] * residual**2).sum(0)) + 1e-9
    corr = np.abs((residual * weight[:, None]).T @ residual / np.outer(scale, scale))
    pairs = [(j, k) for j in range(len(corr)) for k in range(j) if corr[j, k] > CORRELATED]
    return sorted(sorted(pairs, key=lambda e: -corr[e])[:most])


def _known(gold: np.ndarray, right: float = GOLD) -> np.ndarray:
    """The log odds that gold labels (1, 0 or -1 for none) give."""
    return np.where(gold < 0, 0.0, np.where(gold == 1, 1.0, -1.0) * math.log(right / (1 - right)))


def fit_label_model(fires: np.ndarray, gold: np.ndarray, weight: np.ndarray, share: float, rounds: int = 150, right: float = GOLD, most: int = EDGES) -> LabelModel:
    """Maximise the likelihood of the votes, and of the gold labels (1, 0 or -1 for none) as votes that are right with probability right."""
    known = _known(gold, right)
    # Equal rows count once, with their weights.
    kinds, of = np.unique(np.column_stack([fires, known]), axis=0, return_inverse=True)
    weight = np.bincount(of.reshape(-1), weight, len(kinds)) / weight.sum()
    fires, known = kinds[:, :-1], kinds[:, -1]
    # Without a start, nothing tells the two labels apart: a row is toxic if any voter of a lexicon fires.
    start = np.clip(0.05 + 0.9 * fires[:, :BY_WORDS].max(1), 0.02, 0.98)
    post = np.where(known == 0, start, 1 / (1 + np.exp(-known)))
    for _ in range(10):
        r0, r1 = _independent(fires, post, weight * 1e4)
        odds = math.log(share / (1 - share)) + fires @ np.log(r1 / r0) + (1 - fires) @ np.log((1 - r1) / (1 - r0))
        post = 1 / (1 + np.exp(-np.clip(odds + known, -30, 30)))
    edges = dependencies(fires, post, weight, most)
    logit = lambda p: np.log(p / (1 - p))
    model = LabelModel(logit(r0), np.clip(logit(r1) - logit(r0), -6, 6), edges, np.zeros(len(edges)), share)
    together = np.stack([fires[:, j] * fires[:, k] for j, k in edges], 1) if edges else np.zeros((len(fires), 0))
    theta = [model.rate, model.accuracy, model.correlation]
    first, second = [np.zeros_like(x) for x in theta], [np.zeros_like(x) for x in theta]
    for i in range(1, rounds + 1):
        p, bias = model.summed()
        post = model.posterior(fires, known, bias)
        # The label's share is held, so what is seen of each label is weighed to it.
        q1, q0 = post * weight, (1 - post) * weight
        q1, q0 = q1 * share / max(q1.sum(), 1e-12), q0 * (1 - share) / max(q0.sum(), 1e-12)
        both = p.sum(0).astype(np.float32) @ model.parts
        slopes = [(q0 + q1) @ fires - both[: len(model.rate)], q1 @ fires - p[1].astype(np.float32) @ model.states, (q0 + q1) @ together - both[len(model.rate) :]]
        for x, g, u, v, penalty in zip(theta, slopes, first, second, (1e-4, 1e-4, 1e-3), strict=True):
            g = g - penalty * x
            u += 0.1 * (g - u)
            v += 0.01 * (g * g - v)
            x += 0.05 * (u / (1 - 0.9**i)) / (np.sqrt(v / (1 - 0.99**i)) + 1e-8)
    return model


def label_model(fires: np.ndarray, gold: np.ndarray, weight: np.ndarray, share: float, fold: np.ndarray | None = None) -> np.ndarray:
    """The posterior of toxicity of each row from its voters (0/1); gold labels (1, 0 or -1 for none) help to fit the model only.

    A row may stand for as many equal ones as its weight; fold says at which turn its gold label is hidden.
    """
    right, most = choice(fires, gold, weight, share, fold) if (gold >= 0).any() else (GOLD, EDGES)
    return fit_label_model(fires, gold, weight, share, right=right, most=most).posterior(fires)


def choice(fires: np.ndarray, gold: np.ndarray, weight: np.ndarray, share: float, fold: np.ndarray | None = None) -> tuple[float, int]:
    """The trust in gold labels and the number of edges under which votes alone tell best the gold labels of rows that were fitted without these."""
    of, loss = np.cumsum(gold >= 0) % FOLDS if fold is None else fold, []
    for right, most in CHOICES:
        total = 0.0
        for turn in range(FOLDS):
            hidden = (gold >= 0) & (of == turn)
            post = np.clip(fit_label_model(fires, np.where(hidden, -1, gold), weight, share, right=right, most=most).posterior(fires[hidden]), 1e-3, 1 - 1e-3)
            total -= float(weight[hidden] @ np.log(np.where(gold[hidden] == 1, post, 1 - post)))
        loss.append(total)
    return CHOICES[int(np.argmin(loss))]


#: Of a training row: its votes (a bit each), its gold label if it is judged (-1: none), its fold, and the features in it.
HITS = "votes int, gold int, fold int, found array<int>"


def _hit_batches(model) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, bits = model.value, 1 << np.arange(len(VOTERS))
        for batch in batches:
            ids, hits = batch.column(0).to_pylist(), [m.hits(t) for t in batch.column(1).to_pylist()]
            # Labels of the mining half made the lexicons; voters are judged on the other half's, which the posterior does not see.
            gold = [toxic if _half(i) else -1 for i, toxic in zip(ids, batch.column(2).to_pylist(), strict=True)]
            columns = [[int(h[1] @ bits) for h in hits], gold, [_fold(i) for i in ids]]
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int32()) for c in columns), pa.array([sorted(h[0]) for h in hits], pa.list_(pa.int32()))], ["votes", "gold", "fold", "found"])

    return run


def posteriors(hits: DataFrame, share: float) -> dict[int, float]:
    """What the label model, fitted to all rows, says to each combination of votes; rows that are equal to it reach the driver as one, with their count."""
    kinds = sorted(hits.groupBy("votes", "gold", "fold").agg(F.count("*").alias("n")).collect())
    votes, gold, fold, n = (np.array(c) for c in zip(*kinds, strict=True))
    fires = ((votes[:, None] >> np.arange(len(VOTERS))) & 1).astype(float)
    return dict(zip(votes.tolist(), label_model(fires, gold, n.astype(float), share, fold).tolist(), strict=True))


def fit_linear(hits: DataFrame, post: dict[int, float], n_features: int) -> tuple[np.ndarray, np.ndarray, float]:
    """Logistic regression on soft labels with an L2 penalty, over all rows where they are.

    A row with posterior p is a toxic one of weight p and a clean one of weight 1 - p.
    """
    soft = F.broadcast(hits.sparkSession.createDataFrame(list(post.items()), "votes int, p double"))
    voters = F.filter(F.array(*(F.when(F.col("votes").bitwiseAND(1 << j) > 0, F.lit(n_features + j)) for j in range(len(VOTERS)))), lambda i: i.isNotNull())
    sides = F.explode(F.array(F.struct(F.lit(1.0).alias("label"), F.col("p").alias("weight")), F.struct(F.lit(0.0).alias("label"), (1 - F.col("p")).alias("weight"))))
    rows = hits.join(soft, "votes").select(F.concat("found", voters).cast("array<string>").alias("names"), sides.alias("side")).select("names", "side.*")
    vectors = CountVectorizerModel.from_vocabulary([str(i) for i in range(n_features + len(VOTERS))], "names", "features").transform(rows)
    fitted = LogisticRegression(weightCol="weight", regParam=PENALTY, standardization=False, maxIter=STEPS, tol=GAIN).fit(vectors.select("features", "label", "weight"))
    weights = fitted.coefficients.toArray()
    return weights[:n_features], weights[n_features:], float(fitted.intercept)


def train(docs: DataFrame, labels: DataFrame, usable) -> Model:
    """Train on all labelled rows whose id usable() accepts; without both labels the seed lexicon alone speaks.

    Labels of one half of these rows make the lexicons, those of the other half fit the label model;
    the classifier learns what the voters' posterior says, on all of them.
    """
    rows, n_pos, n_neg = training_rows(docs, labels, usable)
    if not n_pos or not n_neg:
        return Model(voter_weights=np.array([3.0, 1.0] + [0.0] * 10 + [1.0, 0.0, -1.0]), bias=-2.0)
    model = mine(rows)
    hits = materialize(rows.mapInArrow(_hit_batches(docs.sparkSession.sparkContext.broadcast(model)), HITS), "hits")
    discard(rows)
    model.weights, model.voter_weights, model.bias = fit_linear(hits, posteriors(hits, n_pos / (n_pos + n_neg)), len(model.weights))
    discard(hits)
    return model


def _score_batches(model) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([m.score(t) for t in batch.column(0).to_pylist()], pa.float64())] + batch.columns[1:], ["toxicity_score", *batch.schema.names[1:]])

    return run


def held_out(doc_id):
    """Rows that are never learned from; a null id is not among them."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def scores(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of docs with column toxicity_score before their own; only the text is looked at.

    A null text is scored as an empty one; every row is scored by itself; an empty table gives none.
    A column of docs that has that name already is left out.
    """
    ship_package(docs.sparkSession)
    given = docs.sparkSession.sparkContext.broadcast(model)
    own = [c for c in docs.columns if c != "toxicity_score"]
    rows = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("_scored"), *[F.col(f"`{c}`") for c in own])
    schema = T.StructType([T.StructField("toxicity_score", T.DoubleType()), *rows.schema.fields[1:]])
    return rows.mapInArrow(_score_batches(given), schema)


def without_toxic(docs: DataFrame, model: Model, threshold: float, text_col: str = "text") -> DataFrame:
    """The rows of docs, with their columns, whose score is below the threshold; nothing is shuffled."""
    ship_package(docs.sparkSession)
    given, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = given.value
        for batch in batches:
            yield batch.filter(pa.array([m.score(t) < threshold for t in batch.column(at).to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op8_weak_toxicity(spark, sf_dir: str, threshold: float = 0.3) -> DataFrame:
    """Toxicity of every document; labels come from rows that are not held out."""
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    ship_package(spark)
    model = train(docs, labels, lambda c: ~held_out(c))
    out = scores(docs.select("doc_id", "text"), model).select("doc_id", "toxicity_score")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("toxicity_score").alias("score"), (F.col("toxicity_score") >= threshold).cast("int").alias("predicted"))
