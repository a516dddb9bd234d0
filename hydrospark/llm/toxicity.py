"""Operator 11, toxicity: numpy classifiers trained from confirmed toxic and unlabelled texts by non-negative positive-unlabelled learning."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Kept, cols, python_workers, q, scratch, text_of
from .text_bytes import TERMS


#: Bytes of a word's beginnings that count beside the word itself, so that an inflection never seen is known by its stem.
_STEMS = (4, 5, 6, 7)
#: Words that a scoring worker keeps, and features that a counting one holds.
_CACHE_MAX, _HELD = 200_000, 150_000


def distinct_words(text: str) -> set[bytes]:
    return set(text.encode().translate(TERMS).split())


def features(word: bytes) -> list[bytes]:
    """The word, and its beginnings with a `-` behind (which no word holds)."""
    return [word, *(word[:k] + b"-" for k in _STEMS if len(word) > k)]


@dataclass(frozen=True)
class Settings:
    """What bounds and steers training. The samples are the rows of least hash, so reruns agree."""

    positives: int = 4096  #: confirmed toxic documents at most
    unlabelled: int = 16_384  #: unlabelled documents at most, dealt out to the members
    members: int = 4  #: classifiers, each with all positives and its share of the unlabelled documents; scores are means
    words: int = 1024  #: words and beginnings a classifier weighs at most
    longest: int = 64  #: bytes of such a word at most
    surprise: float = 4.0  #: standard errors by which a word's share among positives differs from that among unlabelled texts
    rounds: int = 400
    rate: float = 0.05
    penalty: float = 2e-4
    default_prior: float = 0.1  #: share of toxic documents where no label tells it


def _sigmoid(g: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(g, -40, 40)))


def fit_nnpu(p: np.ndarray, u: np.ndarray, prior: float, s: Settings) -> tuple[np.ndarray, float]:
    """Weights and bias of a logistic classifier, from rows of positives `p` and unlabelled `u` (both 0/1).

    The risk is prior * E_p[l(g)] + max(0, E_u[l(-g)] - prior * E_p[l(-g)]), l the logistic loss. Where the second part, the risk of the hidden negatives, is below zero the
    classifier fits the positives among the unlabelled as negatives, and the step goes the other way on that part only. Steps are Adam's.
    """
    n = p.shape[1]
    w, b = np.zeros(n, np.float32), float(np.log(prior / (1 - prior)))
    first, second = np.zeros(n + 1), np.zeros(n + 1)
    down = lambda x, e: np.append(e.astype(np.float32) @ x, e.sum()) / len(x)
    for t in range(1, s.rounds + 1):
        gp, gu = (p @ w + b).astype(np.float64), (u @ w + b).astype(np.float64)
        hidden = np.logaddexp(0, gu).mean() - prior * np.logaddexp(0, gp).mean()
        step = down(u, _sigmoid(gu)) - prior * down(p, _sigmoid(gp))
        step = step - prior * down(p, _sigmoid(-gp)) if hidden >= 0 else -step
        step[:n] += s.penalty * w
        first, second = 0.9 * first + 0.1 * step, 0.999 * second + 0.001 * step * step
        move = s.rate * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.999**t)) + 1e-9)
        w, b = w - move[:n].astype(np.float32), b - float(move[n])
    return w, b


def _counted(longest: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """In how many positives and unlabelled texts each feature occurs, summed as far as `_HELD` features reach."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[Counter, Counter] = (Counter(), Counter())

        def out() -> pa.RecordBatch:
            each = list(held[0].keys() | held[1].keys())
            return pa.RecordBatch.from_arrays([pa.array(each, pa.binary()), *(pa.array([c[f] for f in each], pa.int64()) for c in held)], ["word", "in_u", "in_p"])

        for b in batches:
            for positive, text in zip(b.column("positive").to_pylist(), b.column("text").to_pylist()):
                held[positive].update({f for w in distinct_words(text) for f in features(w) if len(f) <= longest})
                if len(held[0]) + len(held[1]) > _HELD:
                    yield out()
                    held = (Counter(), Counter())
        yield out()

    return count


def chosen_words(sample: DataFrame, s: Settings) -> list[bytes]:
    """The at most `words` features whose share among positives differs most, in standard errors, from that among unlabelled texts."""
    n, m = sample.agg(F.count_if("positive"), F.count_if(~F.col("positive"))).first()
    if not n or not m:
        return []
    each = sample.select("positive", "text").mapInArrow(_counted(s.longest), "word binary, in_u long, in_p long").groupBy("word").agg(F.sum("in_u").alias("in_u"), F.sum("in_p").alias("in_p"))
    rate = (F.col("in_u") + 1) / (m + 2)
    z = F.abs(F.col("in_p") / n - rate) / F.sqrt(F.greatest(rate * (1 - rate), F.lit(1e-9)) / n)
    found = each.filter("in_p >= 3").withColumn("z", z).filter(F.col("z") >= s.surprise).orderBy(F.desc("z"), "word").limit(s.words)
    return sorted(bytes(r.word) for r in found.select("word").collect())


def _marked(words: list[bytes]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The places, among the chosen ones, of a text's features."""

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = {w: i for i, w in enumerate(words)}
        for b in batches:
            own = [sorted({at[f] for w in distinct_words(t) for f in features(w) if f in at}) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("positive"), b.column("h"), pa.array(own, pa.list_(pa.int32()))], ["positive", "h", "held"])

    return mark


def _train(words: list[bytes], prior: float, s: Settings) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """One member: weights of all chosen words; the row of no word holds the bias. Rows are ordered, so that sums don't depend on how they came."""

    def train(rows: pd.DataFrame) -> pd.DataFrame:
        sides = []
        for wanted in (True, False):
            own = rows[rows.positive == wanted].sort_values("h").held
            x = np.zeros((len(own), len(words)), np.float32)
            for row, held in zip(x, own):
                row[held] = 1
            sides.append(x)
        if not all(map(len, sides)):
            return pd.DataFrame({"member": [], "word": [], "weight": []})
        weights, bias = fit_nnpu(*sides, prior, s)
        return pd.DataFrame({"member": int(rows.member.iloc[0]), "word": [*words, b""], "weight": [*map(float, weights), bias]})

    return train


def _least(rows: DataFrame, limit: int) -> DataFrame:
    """The `limit` rows of least hash (id, text): the cut is found on hashes alone, so no text goes through one task to be ordered."""
    rows = rows.withColumn("h", F.xxhash64("id", "text"))
    cut = rows.select("h").orderBy("h").limit(limit).agg(F.max("h")).first()[0]
    return rows.filter(F.col("h") <= cut).dropDuplicates(["h"]) if cut is not None else rows.limit(0)


def train_nnpu(docs: DataFrame, positives: DataFrame, prior: float, id_col: str = "doc_id", text_col: str = "text", settings: Settings = Settings()) -> DataFrame:
    """(member, word, weight): the members' weights, at most `members` * (`words` + 1) rows.

    `positives` holds the ids (column id) of confirmed toxic documents; unlabelled texts are drawn from all of `docs`. The two samples are written once; their features are
    counted where they lie, and what moves to the members' tasks is which chosen features each text has.
    """
    python_workers(docs.sparkSession)
    s = settings
    known = docs.select(F.col(q(id_col)).alias("id"), text_of(text_col).alias("text"))
    ids = positives.select("id").distinct().orderBy(F.xxhash64("id")).limit(s.positives)  # bounded, so that it may be broadcast
    toxic, free = _least(known.join(F.broadcast(ids), "id", "left_semi"), s.positives), _least(known, s.unlabelled)
    sample = scratch(toxic.select(F.lit(True).alias("positive"), "h", "text").unionByName(free.select(F.lit(False).alias("positive"), "h", "text")), "tx-sample")
    words = chosen_words(sample, s)
    rows = sample.select("positive", "h", "text").mapInArrow(_marked(words), "positive boolean, h long, held array<int>")
    member = F.when(F.col("positive"), F.sequence(F.lit(0), F.lit(s.members - 1))).otherwise(F.array(F.pmod("h", F.lit(s.members)).cast("int")))
    return rows.withColumn("member", F.explode(member)).groupBy("member").applyInPandas(_train(words, prior, s), "member int, word binary, weight double")


class Scorer:
    """Members' weights by word; the weights of one text's words are summed per member, and the members' probabilities averaged."""

    def __init__(self, weights: list[tuple[int, bytes, float]], prior: float):
        members = {m: i for i, m in enumerate(sorted({m for m, _, _ in weights}))}
        self.prior, self.bias, self.weight = prior, np.zeros(len(members)), {}
        for m, word, x in weights:
            at = self.weight.setdefault(bytes(word), np.zeros(len(members))) if word else self.bias
            at[members[m]] += x
        self.of_word = Kept(lambda w: tuple(f for f in features(w) if f in self.weight))

    def __call__(self, text: str) -> float:
        if not len(self.bias):
            return self.prior
        if len(self.of_word) > _CACHE_MAX:
            self.of_word.clear()
        g = self.bias.copy()
        for f in sorted({f for x in map(self.of_word.__getitem__, distinct_words(text)) if x for f in x}):
            g += self.weight[f]
        return float(_sigmoid(g).mean())


def score_column(text: Column, weights: list[tuple[int, bytes, float]], prior: float) -> Column:
    """Of a text (null counts as empty) its score in 0 to 1."""

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        of = Scorer(weights, prior)
        for texts in batches:
            yield pd.Series([of(t or "") for t in texts], dtype="float64")

    return score(text)


def class_prior(labels: DataFrame, settings: Settings = Settings()) -> float:
    """The share of toxic documents among those that bear a label; where none bears a label of both kinds, `default_prior`."""
    n, toxic = labels.filter("toxic IN (0, 1)").agg(F.count(F.lit(1)), F.sum("toxic")).first()
    return min(max(toxic / n, 0.001), 0.5) if n and 0 < toxic < n else settings.default_prior


def held_out(ident: Column) -> Column:
    """Whether crc32 of the id as text leaves 1 when divided by 3; a null id is not held out."""
    return F.coalesce(F.crc32(ident.cast("string")) % 3 == 1, F.lit(False))


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.7, settings: Settings = Settings()) -> DataFrame:
    """Adds held_out, score and predicted to every row of `docs`.

    `labels` has the id column and toxic (1: confirmed). Held-out rows neither give labels nor unlabelled texts. Of the other rows, those labelled 1 are positives (an id with two labels counts as confirmed),
    and all, whatever their label, are the unlabelled population; labels of 0 only tell the class prior. Words are bytes between ASCII other than letters, lower-cased
    in A-Z; nothing but a text's words and their beginnings enters its score, whole texts are read, and texts that share no word with a classifier get its bias.

    The samples are bounded by `settings`, the weights too, so these may go to every worker; scoring moves no row.
    Null text counts as empty; with no positives or no texts to learn from, every score is the prior. Columns that bear an output's name are replaced; an empty table stays empty.
    """
    spark: SparkSession = docs.sparkSession
    python_workers(spark)
    ident = labels.select(F.col(q(id_col)).alias("id"), F.col("toxic")).filter(~held_out(F.col("id")))
    prior = class_prior(ident, settings)
    free = docs.filter(~held_out(F.col(q(id_col))))
    trained = train_nnpu(free, ident.filter("toxic = 1"), prior, id_col, text_col, settings)
    weights = [(r.member, bytes(r.word), r.weight) for r in trained.orderBy("member", "word").collect()]
    out = docs.withColumn("__tx", score_column(text_of(text_col), weights, prior))
    own = ("held_out", "score", "predicted")
    return out.select(*cols(docs, *own), held_out(F.col(q(id_col))).alias("held_out"), F.col("__tx").alias("score"), (F.col("__tx") >= threshold).cast("int").alias("predicted"))
