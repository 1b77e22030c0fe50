"""Mixing to target weights with soft membership.

A classifier fitted on a table of labelled documents gives each document its posterior over the domains. Then every
document gets a rate, not below zero, such that the expected tokens of the domains, each document's tokens shared out by
its posterior and times its rate, come to the target weights. The rates are a least-squares problem with as many unknowns
as documents and as many equations as domains; projected gradient steps with momentum solve it, and all that a step needs of the
other documents is one small vector of residuals, so each step is one aggregation over the table.
"""
from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .quality_model import FEATURES, split, statistics
from .shared import cut, extended, slices, with_columns, without

#: The classifier is fitted on at most this many labelled documents, those whose keys have the smallest hashes.
TRAIN_ROWS = 20_000
#: Words per domain whose presence is a feature, and in how many of the labelled documents such a word is at least.
WORDS, LEAST_DOCUMENTS = 32, 5
_PLAIN = bytes(32 if chr(b) in ".,;:!?\"'()[]{}*#$%&|<>" else b for b in range(256))
#: Weight of keeping the rates near one, against matching the targets.
KEEP = 1e-4
#: Steps end when the residuals change by less than this, relative to the targets, or after so many steps.
TOLERANCE, STEPS = 1e-6, 100


def word_set(words: Iterable[bytes]) -> set[bytes]:
    """The distinct words in lower case (A-Z only), where punctuation separates words too; ``words`` are the distinct ones by space."""
    return set(b" ".join(words).lower().translate(_PLAIN).split())


@dataclass
class DomainModel:
    """A softmax over standardised text statistics and the presence of chosen words."""

    domains: list[str]
    words: list[bytes]
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray  # (features + 1) x domains

    def features(self, texts: list[str]) -> np.ndarray:
        """One row for each text, not yet standardised."""
        rows = np.zeros((len(texts), len(FEATURES) + len(self.words)))
        for row, text in zip(rows, texts):
            parts = split(text)  # once for both
            row[:len(FEATURES)] = statistics(text, parts)
            present = word_set(parts[2]) if self.words else ()
            row[len(FEATURES):] = [w in present for w in self.words]
        return rows

    def posteriors(self, x: np.ndarray) -> np.ndarray:
        """The probability of each domain for rows of features."""
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        scores = np.hstack([z, np.ones((len(x), 1))]) @ self.weights
        scores = np.exp(scores - scores.max(axis=1, keepdims=True))
        return scores / scores.sum(axis=1, keepdims=True)


def _softmax_fit(x: np.ndarray, y: np.ndarray, k: int, rounds: int = 400, l2: float = 1e-3) -> np.ndarray:
    """Weights of a softmax regression by gradient descent with momentum; x has a last column of ones."""
    w, speed = np.zeros((x.shape[1], k)), np.zeros((x.shape[1], k))
    hot = np.eye(k)[y]
    rate = 4 / (np.linalg.norm(x, 2) ** 2 / len(x) + l2)
    for _ in range(rounds):
        s = x @ w
        p = np.exp(s - s.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        speed = 0.9 * speed - 0.3 * rate * (x.T @ (p - hot) / len(x) + l2 * w)
        w = w + speed
    return w


def train(docs: DataFrame, labelled: DataFrame, domains: list[str], key: str = "doc_id", text: str = "text", domain: str = "domain", rows: int = TRAIN_ROWS) -> DomainModel:
    """Fit the classifier on documents that ``labelled`` (``key``, ``domain``) puts into one of ``domains``, at most ``rows``.

    Rows without a key, and domains that aren't listed, count for nothing. Without any usable row all domains are equally
    likely for every text. The words are those whose presence in a document goes most with one domain, by chi-square.
    """
    usable = labelled.where(F.col(domain).isin(domains) & F.col(key).isNotNull()).select(F.col(key).alias("_key"), F.col(domain).alias("_domain"))
    chosen = usable.orderBy(F.xxhash64("_key"), "_key", "_domain").limit(rows)  # few by this bound, so they go to the documents
    sample = cut(docs.select(F.col(key).alias("_key"), F.col(text).alias("_text")).join(F.broadcast(chosen), "_key").select("_domain", "_text"))

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in slices(batches, "_text"):
            for d, t in zip(part.column(0).to_pylist(), texts):
                found = sorted(word_set(set(t.encode("utf-8", "surrogatepass").split())))
                yield pa.RecordBatch.from_arrays([pa.array([d] * len(found), pa.string()), pa.array(found, pa.binary())], names=["domain", "word"])

    sizes = {r[0]: r[1] for r in sample.groupBy("_domain").count().collect()}
    total = sum(sizes.values())
    empty = DomainModel(domains, [], np.zeros(len(FEATURES)), np.ones(len(FEATURES)), np.zeros((len(FEATURES) + 1, len(domains))))
    if not total:
        return empty
    seen = sample.mapInArrow(words, "domain string, word binary").groupBy("word")
    counts = cut(seen.agg(F.count("*").alias("n"), *[F.count_if(F.col("domain") == d).alias(f"d{i}") for i, d in enumerate(domains)]).where(F.col("n") >= LEAST_DOCUMENTS))
    listed: set[bytes] = set()
    for i, d in enumerate(domains):
        size = sizes.get(d, 0)
        if not 0 < size < total:
            continue
        a, n = F.col(f"d{i}").cast("double"), F.col("n").cast("double")
        chi = F.pow(a * total - n * size, 2) / (n * (total - n + 0.5) * size * (total - size))
        listed |= {bytes(r.word) for r in counts.where(a * total > n * size).orderBy(chi.desc(), "word").limit(WORDS).collect()}
    model = DomainModel(domains, sorted(listed), empty.mean, empty.scale, empty.weights)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in slices(batches, "_text"):
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(model.features(texts).tolist(), pa.list_(pa.float64()))], names=["domain", "x"])

    got = sample.mapInArrow(measure, "domain string, x array<double>").toArrow()  # at most `rows` rows of numbers
    x = np.array(got.column("x").to_pylist(), dtype=float)
    y = np.array([domains.index(d) for d in got.column("domain").to_pylist()])
    order = np.lexsort((*x.T[::-1], y))  # the same order whatever the partitions
    x, y = x[order], y[order]
    model.mean, model.scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-3)
    z = np.clip((x - model.mean) / model.scale, -8, 8)
    model.weights = _softmax_fit(np.hstack([z, np.ones((len(z), 1))]), y, len(domains))
    return model


def memberships(docs: DataFrame, model: DomainModel, text: str = "text") -> DataFrame:
    """``docs`` with n_tokens (words) and posterior (an array in the order of the model's domains), replacing columns of these
    names. A null text counts as empty: no tokens, and the posterior of a text whose statistics are all zero."""
    source = without(docs, "n_tokens", "posterior")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in slices(batches, text):
            p = model.posteriors(model.features(texts))
            yield with_columns(part, n_tokens=pa.array([len(t.encode("utf-8", "surrogatepass").split()) for t in texts], pa.int64()),
                               posterior=pa.array(p.tolist(), pa.list_(pa.float64())))

    return source.mapInArrow(run, extended(source, T.StructField("n_tokens", T.LongType(), False), T.StructField("posterior", T.ArrayType(T.DoubleType(), False), False)))


def advance(posterior: np.ndarray, history: list[tuple[np.ndarray, float]], shrink: float) -> tuple[np.ndarray, np.ndarray]:
    """(rate, ahead) of documents after the steps taken: from the point ahead, down by the step for the posterior and towards
    one, not below zero; then ahead again by a share of the way just made (Nesterov's momentum)."""
    rate = ahead = np.ones(len(posterior))
    for step, momentum in history:
        new = np.maximum(0, ahead - posterior @ step - shrink * (ahead - 1))
        ahead, rate = new + momentum * (new - rate), new
    return rate, ahead


def _matrix(column: pa.ListArray, width: int) -> np.ndarray:
    return column.flatten().to_numpy().reshape(-1, width)


def fit_rates(members: DataFrame, targets: list[float], total: float = 1.0, keep: float = KEEP) -> DataFrame:
    """``members`` (see :func:`memberships`) with a column rate, replacing one of that name.

    Expected domain tokens should be ``total`` times all tokens now, shared by ``targets``. Residuals are weighed by one over
    what a domain has now, so rare domains count as much as common ones and the steps converge at once for clear
    posteriors. ``keep`` is the weight of staying near one: where domains can hardly be told apart, a small one takes a few
    documents many times and leaves the others out, a larger one comes less near the targets. A domain that no document belongs to can't be matched and is left out. Without tokens every rate is one.

    A rate follows from the document's posterior and the steps so far, so nothing of a document is kept between steps. The
    steps read blocks of tokens and posteriors; of each they send one sum for each domain.
    """
    members = cut(without(members, "rate"))
    k = len(targets)
    goal = np.array(targets, dtype=float) / sum(targets) * total

    def blocked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            block = np.hstack([batch.column(0).to_numpy()[:, None].astype(float), _matrix(batch.column(1), k)])
            yield pa.RecordBatch.from_arrays([pa.array([block.ravel()], pa.list_(pa.float64()))], names=["block"])

    blocks = cut(members.select("n_tokens", "posterior").mapInArrow(blocked, "block array<double>"))

    def totals(of) -> np.ndarray:
        """The sum over all blocks of what ``of`` makes of tokens and posteriors."""
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for block in batch.column(0):
                    values = block.values.to_numpy().reshape(-1, k + 1)
                    out = np.asarray(of(values[:, 0], values[:, 1:])).ravel()
                    yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(out))), pa.array(out)], names=["i", "x"])

        rows = blocks.mapInArrow(run, "i long, x double").groupBy("i").agg(F.sum("x").alias("x")).collect()  # one row for each sum
        return np.array([r.x for r in sorted(rows, key=lambda r: r.i)])

    first = totals(lambda n, p: np.append((p * n[:, None]).T @ p, n.sum()))
    if not len(first) or not first[-1]:
        return members.withColumn("rate", F.lit(1.0))
    tokens, gram = first[-1], first[:-1].reshape(k, k) / first[-1]
    mass = gram.sum(axis=1)
    weight = np.where(mass > 1e-12, 1 / np.maximum(mass, 1e-12), 0)
    step = 1 / (np.linalg.eigvalsh(np.sqrt(weight)[:, None] * gram * np.sqrt(weight)).max() + keep)
    shrink = step * keep
    history: list[tuple[np.ndarray, float]] = []
    before, still, age = None, 0, 0
    for _ in range(STEPS):
        residual = totals(lambda n, p, h=tuple(history): (n * advance(p, h, shrink)[1]) @ p) / tokens - goal
        if before is not None:
            still = still + 1 if np.abs((residual - before) * (weight > 0)).max() < TOLERANCE else 0
            if still == 3:
                break
            if weight @ residual**2 > weight @ before**2:
                age = 0  # the momentum went too far: start it again
        before, age = residual, age + 1
        history.append((step * weight * residual, (age - 1) / (age + 2)))

    def rated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = _matrix(batch.column(batch.schema.get_field_index("posterior")), k)
            yield with_columns(batch, rate=pa.array(advance(p, history, shrink)[0]))

    return members.mapInArrow(rated, extended(members, T.StructField("rate", T.DoubleType(), False)))


def copies(rated: DataFrame, columns: list[str], key: str = "doc_id", rate: str = "rate", most: int | None = None) -> DataFrame:
    """The mixture itself: ``columns`` of each row as often as its rate says.

    A rate's fraction is a further copy if it exceeds a hash of the key in [0, 1), so the expected number is the rate, and
    the same in every run. ``most`` bounds the copies of a row.
    """
    share = F.pmod(F.xxhash64(F.lit("copies"), F.col(key)), F.lit(1 << 30)) / float(1 << 30)
    number = F.floor(F.col(rate) + share).cast("int")
    if most is not None:
        number = F.least(number, F.lit(most))
    often = rated.withColumn("__copies", number).where("__copies > 0")
    own = [F.col(f"`{c}`") for c in columns]
    if most == 1:
        return often.select(*own)
    return often.select(*own, F.explode(F.array_repeat(F.lit(0), F.col("__copies"))).alias("__copy")).drop("__copy")
