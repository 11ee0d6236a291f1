"""Toxicity by a weighted lexicon, matched with Aho-Corasick over folded text.

Texts are folded first: lower case, look-alike letters of other scripts and digit
substitutions become plain letters, punctuation becomes a space. The lexicon holds starts of
words (so that inflected forms match), learned from labelled rows by how much more often
they occur in toxic documents. Exception phrases, learned from clean documents that hold a
lexicon term, take their match back. A document's hits are summed by weight, normalised by
its length, and turned into a score by a logistic curve.

Only a bounded sample of labelled rows is learned from (``per_class`` rows of each label, by
the order of a hash of the id); the curve is moved from the shares of the sample to those of all
rows that may be learned from. Every document is scored over its whole text.

Defined results: null and empty texts have no hits and get the score of a text without hits;
null labels are not learned from; of repeated labels for one id the highest counts; with no
toxic or no clean row to learn from there is no lexicon and all scores are the share of
toxic rows (0 without any); extra columns are ignored.
"""

from __future__ import annotations

import math
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import accumulate

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_of_id, id_and_text, slices, stored

PER_CLASS = 6_000
SHORTEST, LONGEST = 4, 12
LEAST_G = 27.0  # log-likelihood ratio; 27 is about one in five million by chance
LEAST_ODDS = math.log(20)
MOST_TERMS = 5_000
EXCEPTION_DOCS = 3

# Letters of other scripts that look like Latin ones, and digits or signs used for letters.
LOOK_ALIKES = dict(zip("аеорсухіјѕԁһԛԝαεοριτυνκ", "aeopcyxijsdhqwaeopituvk"))
SUBSTITUTES = dict(zip("0134578@$", "oieastbas"))
_DROPPED = "­​‌‍⁠﻿"


def _folding() -> dict[int, str]:
    table = {c: " " for c in range(0x80) if not chr(c).isalnum()}
    table |= {c: chr(c).lower() for c in range(0x41, 0x5B)}
    table |= {0xFF01 + k: table.get(0x21 + k, chr(0x21 + k)) for k in range(94)}
    table |= {ord(a): b for a, b in (LOOK_ALIKES | SUBSTITUTES).items()}
    table |= {ord(c): "" for c in _DROPPED}
    return table


_FOLD = _folding()


def fold(text: str) -> str:
    """Folded text with one space before every word."""
    return " " + " ".join(text.lower().translate(_FOLD).split())


def word_starts(folded: str) -> set[str]:
    """Starts of the distinct words, and whole words with a closing space."""
    out = set()
    for word in set(folded.split(" ")):
        if len(word) >= SHORTEST:
            out.update(" " + word[:n] for n in range(SHORTEST, min(len(word), LONGEST) + 1))
        elif word:
            out.add(f" {word} ")
    return out


@dataclass
class Model:
    weights: dict[str, float] = field(default_factory=dict)
    exceptions: list[str] = field(default_factory=list)
    curve: tuple[float, float, float] = (0.0, 0.0, 0.0)
    prior: float = 0.0

    def matcher(self) -> ahocorasick.Automaton:
        out = ahocorasick.Automaton()
        for term, weight in self.weights.items():
            out.add_word(term, (len(term), weight, False))
        for phrase in self.exceptions:
            out.add_word(phrase, (len(phrase), 0.0, True))
        if len(out):
            out.make_automaton()
        return out

    def score(self, total: float, n_words: int) -> float:
        if not self.weights:
            return self.prior
        z = float(np.dot(self.curve, features(total, n_words)))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def features(total: float, n_words: int) -> tuple[float, float, float]:
    """One, the weight of all hits, the weight per thousand words; both damped."""
    return 1.0, math.log1p(total), math.log1p(1000 * total / max(n_words, 20))


def weigh(matcher: ahocorasick.Automaton, folded: str) -> tuple[float, list[tuple[int, int]]]:
    """Summed weight of the terms outside exception phrases, and where they are. Of terms
    that start at the same word only the heaviest counts."""
    if not len(matcher):
        return 0.0, []
    best: dict[int, tuple[float, int]] = {}
    excused: list[tuple[int, int]] = []
    for end, (length, weight, exception) in matcher.iter(folded + " "):
        start = end - length + 1
        if exception:
            excused.append((start, end))
        elif weight > best.get(start, (0.0, 0))[0]:
            best[start] = (weight, end)
    excused.sort()
    begins, reach = [a for a, _ in excused], list(accumulate((b for _, b in excused), max))

    def inside(start: int, end: int) -> bool:  # of the phrases that begin in time, does the longest reach go far enough?
        before = bisect_right(begins, start)
        return before > 0 and reach[before - 1] >= end

    places = [(s, e) for s, (_, e) in best.items() if not inside(s, e)]
    return sum(best[s][0] for s, _ in places), places


def learnable(labels: DataFrame, label: str, keep) -> DataFrame:
    """doc_id, y of the labelled rows that ``keep`` says may be learned from."""
    return labels.where(keep & F.col(label).isin(0, 1)).groupBy("doc_id").agg(F.max(label).alias("y"))


def class_counts(rows: DataFrame) -> tuple[int, int]:
    """Number of rows of class 1 and of class 0."""
    n = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    return n.get(1, 0), n.get(0, 0)


def sample(docs: DataFrame, labels: DataFrame, label: str, keep, per_class: int) -> DataFrame:
    """Whole texts of at most ``per_class`` labelled rows of each class, chosen by a hash of
    the id; ``keep`` says which labelled rows may be learned from."""
    known = learnable(labels, label, keep)
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    chosen = known.where("y = 1").orderBy(*order).limit(per_class).unionByName(known.where("y = 0").orderBy(*order).limit(per_class))
    return stored(id_and_text(docs).join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "y"))


def _counted(rows: DataFrame, per_text) -> DataFrame:
    """(term, toxic, clean): number of documents of each class that hold the term."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = (Counter(), Counter())
        for batch in slices(batches):
            for text, y in zip(batch.column("text").to_pylist(), batch.column("y").to_pylist()):
                counts[y].update(per_text(text))
        terms = list(counts[0].keys() | counts[1].keys())
        yield pa.RecordBatch.from_arrays(
            [pa.array(terms, pa.string()), *(pa.array([counts[y][t] for t in terms], pa.int64()) for y in (1, 0))],
            names=["term", "toxic", "clean"],
        )

    return rows.mapInArrow(work, "term string, toxic bigint, clean bigint").groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def _lexicon(rows: DataFrame, n_toxic: int, n_clean: int) -> dict[str, float]:
    counted = _counted(rows, lambda text: word_starts(fold(text)))
    a, b = F.col("toxic"), F.col("clean")
    odds = F.log((a + 0.5) / (n_toxic + 1.0)) - F.log((b + 0.5) / (n_clean + 1.0))
    n, share = a + b, n_toxic / (n_toxic + n_clean)
    g = 2 * (a * F.log(a / (n * share)) + F.when(b > 0, b * F.log(b / (n * (1 - share)))).otherwise(0.0))
    good = counted.where((a >= 3) & (odds >= LEAST_ODDS)).select("term", "toxic", "clean", odds.alias("odds"), g.alias("g")).where(F.col("g") >= LEAST_G)
    found = {r["term"]: r for r in good.orderBy(F.desc("g"), "term").limit(MOST_TERMS).toLocalIterator()}
    # Of nested starts with the same documents only the longest stays; a longer start with fewer
    # documents is left out, since the shorter one matches wherever it does.
    kept: dict[str, float] = {}
    for term in sorted(found, key=len, reverse=True):
        longer = [t for t in found if len(t) > len(term) and t.startswith(term)]
        if not any(found[t]["toxic"] >= 0.98 * found[term]["toxic"] for t in longer):
            kept[term] = float(found[term]["odds"])
    return {t: w for t, w in kept.items() if not any(t != u and t.startswith(u) for u in kept)}


def _phrases(matcher: ahocorasick.Automaton, folded: str) -> set[str]:
    """Hits with the word before, with the word after, and as whole words."""
    out = set()
    for start, _ in weigh(matcher, folded)[1]:
        end = folded.find(" ", start + 1)
        end = len(folded) if end < 0 else end
        before, after = folded.rfind(" ", 0, start), folded.find(" ", end + 1)
        out.add(folded[start:end] + " ")
        if start > 0 and before >= 0:
            out.add(folded[before:end] + " ")
        if end < len(folded):
            out.add(folded[start : len(folded) if after < 0 else after] + " ")
    return out


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Model:
    """Learn lexicon, exceptions and curve from labelled rows whose crc32 of the id is not 0 mod 5."""
    keep = F.pmod(crc_of_id(), F.lit(5)) != 0
    rows = sample(docs, labels, "toxic", keep, per_class)
    n_toxic, n_clean = class_counts(rows)
    all_toxic, all_clean = class_counts(docs.select("doc_id").join(learnable(labels, "toxic", keep), "doc_id"))
    prior = all_toxic / max(1, all_toxic + all_clean)
    if not n_toxic or not n_clean:
        return Model(prior=prior)
    model = Model(weights=_lexicon(rows, n_toxic, n_clean), prior=prior)
    if not model.weights:
        return model
    plain = model.matcher()
    excused = _counted(rows, lambda text: _phrases(plain, fold(text))).where((F.col("clean") >= EXCEPTION_DOCS) & (F.col("toxic") == 0))
    model.exceptions = sorted(r["term"] for r in excused.orderBy(F.desc("clean"), "term").limit(MOST_TERMS).toLocalIterator())
    points = _totals(rows, model, "y").toPandas()
    x = np.array([features(t, n) for t, n in zip(points["total"], points["n_words"])])
    level, *slopes = logistic(x, points["y"].to_numpy(float)).tolist()
    # The sample may be balanced; the scores are for the shares among all rows that may be learned from.
    model.curve = (level + math.log(all_toxic / all_clean) - math.log(n_toxic / n_clean), *slopes)
    return model


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 50) -> np.ndarray:
    """Ridge logistic regression by Newton's method; the first column is not shrunk."""
    w, shrink = np.zeros(x.shape[1]), ridge * np.eye(x.shape[1])
    shrink[0, 0] = 1e-3
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + shrink, x.T @ (y - p) - shrink @ w)
        w += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return w


def _totals(rows: DataFrame, model: Model, *keep: str) -> DataFrame:
    weights = Model(model.weights, model.exceptions)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = weights.matcher()
        for batch in slices(batches):
            found = []
            for text in batch.column("text").to_pylist():
                folded = fold(text)
                found.append((weigh(matcher, folded)[0], folded.count(" ") if len(folded) > 1 else 0))
            total, n_words = list(zip(*found)) or ((), ())
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in keep), pa.array(total, pa.float64()), pa.array(n_words, pa.int64())],
                names=[*keep, "total", "n_words"],
            )

    kept = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in keep)
    return rows.select(*keep, "text").mapInArrow(work, f"{kept}, total double, n_words bigint")


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, the weight of hits, words, the score between 0 and 1, and the verdict."""
    found = _totals(id_and_text(docs), model, "doc_id")
    if not model.weights:
        value = F.lit(float(model.prior))
    else:
        a, b, c = (float(v) for v in model.curve)
        per = F.log1p(F.lit(1000.0) * F.col("total") / F.greatest("n_words", F.lit(20)))
        value = 1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), F.lit(a) + b * F.log1p("total") + c * per))))
    return found.withColumn("score", value).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def keep_clean(docs: DataFrame, model: Model) -> DataFrame:
    """The documents, with all their columns, that are not predicted toxic. Judged row by row."""
    matcher_of = Model(model.weights, model.exceptions, model.curve, model.prior)

    @F.arrow_udf("boolean")
    def clean(texts: pa.Array) -> pa.Array:
        matcher, out = matcher_of.matcher(), []
        for at in range(0, len(texts), 256):
            for text in texts.slice(at, 256).to_pylist():
                folded = fold(text or "")
                out.append(matcher_of.score(weigh(matcher, folded)[0], folded.count(" ")) < 0.5)
        return pa.array(out, pa.bool_())

    return docs.where(clean(F.col("text")))
