"""Toxicity by multiple-instance learning: labels of documents, probabilities of sentences.

A document is toxic if any of its sentences is: P(document) = 1 - prod(1 - p(sentence)), a noisy-or. A sentence's
probability is logistic in the words and word beginnings that it holds. Weights are trained through the noisy-or from
document labels alone, so the sentences that carry a label are found without being labelled.

Two kinds of terms have weights, of either sign: signs, which sentences of toxic documents hold beyond chance, and
contexts, which tell apart the sentences that hold a sign. A sentence without any sign has probability 0.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import about, documents, flat, fold_of, pieces

#: Keys of each label to train on, at most, and the longest text among them, in characters. Scores cover all texts.
SAMPLE, LONGEST = 2500, 8_000
STEM = 5
PIECE_BYTES = 2 << 20
#: Lower case; marks that end a sentence become line ends, other ASCII marks become spaces.
_PLAIN = bytes(c + 32 if 65 <= c <= 90 else 10 if c in b".!?\r\n" else 32 if c < 48 or 58 <= c <= 64 or 91 <= c <= 96 or 123 <= c <= 127 else c for c in range(256))


@dataclass
class Model:
    """Weights of whole words and of beginnings of words, the log odds of a sentence, and which terms are signs."""

    words: dict[bytes, float]
    stems: dict[bytes, float]
    bias: float
    sign_words: frozenset[bytes] = frozenset()
    sign_stems: frozenset[bytes] = frozenset()

    def sentences(self, raw: bytes) -> list[tuple[int, int, float]]:
        """(start, end, probability) in bytes of the sentences that hold a sign."""
        plain = raw.translate(_PLAIN)
        distinct = set(plain.split())
        if self.sign_words.isdisjoint(distinct) and self.sign_stems.isdisjoint({w[:STEM] for w in distinct}):
            return []
        out, at = [], 0
        for s in plain.split(b"\n"):
            held = set(s.split())
            stems = {w[:STEM] for w in held}
            if not (self.sign_words.isdisjoint(held) and self.sign_stems.isdisjoint(stems)):
                z = [self.words[w] for w in held if w in self.words] + [self.stems[k] for k in stems if k in self.stems]
                out.append((at, at + len(s), 1 / (1 + float(np.exp(-max(-60.0, min(60.0, self.bias + sum(z))))))))
            at += len(s) + 1
        return out

    def score(self, raw: bytes) -> tuple[float, list[tuple[int, int, float]]]:
        found = self.sentences(raw)
        clear = 1.0
        for _, _, p in found:
            clear *= 1 - p
        return 1 - clear, found


def _surprise(bad: int, seen: int, base: float, less: bool = False) -> float:
    """Minus the log of a bound on the chance that so many (with less: so few) of `seen` sentences are toxic by accident."""
    q = bad / seen
    if (q >= base) if less else (q <= base):
        return 0.0
    part = lambda x, y: x * np.log(x / y) if x else 0.0
    return seen * (part(q, base) + part(1 - q, 1 - base))


def _terms(words: set[bytes]) -> set[tuple[int, bytes]]:
    return {(0, w) for w in words} | {(1, w[:STEM]) for w in words}


def _different(rows: list[tuple[bytes, int]]) -> Iterator[tuple[set[bytes], int]]:
    """The words of each different sentence, and whether its document is toxic; one that a clean document holds is clean.

    So copies of a document make no evidence. Sentences are remembered by hash and gone through twice, not kept.
    """
    known: set[int] = set()
    for raw, label in sorted(rows, key=lambda r: r[1]):
        for s in raw.translate(_PLAIN).split(b"\n"):
            words = set(s.split())
            if words and (mark := hash(frozenset(words))) not in known:
                known.add(mark)
                yield words, label


def _tell(sentences: Iterator[tuple[set, int]], least: int, both: bool) -> list[tuple[int, bytes]]:
    """Terms whose share of toxic sentences is above chance (with both: or below it), for the number of terms tested."""
    seen, bad, total, toxic = Counter(), Counter(), 0, 0
    for terms, label in sentences:
        seen.update(terms)
        total, toxic = total + 1, toxic + label
        if label:
            bad.update(terms)
    if not toxic or toxic == total:
        return []
    base, bar = toxic / total, np.log(max(1, sum(k >= least for k in seen.values()))) + 2
    return sorted(t for t, k in seen.items() if k >= least and (_surprise(bad[t], k, base) > bar or (both and _surprise(bad[t], k, base, less=True) > bar)))


def fit(rows: list[tuple[bytes, int]], scale: dict[int, float] | None = None, rounds: int = 250, least: int = 3, shrink: float = 2e-4) -> Model:
    """rows: (text in UTF-8, label); scale: for how many documents a row of a label stands.

    Terms count that are seen in `least` different sentences, if chance does not explain their share of toxic ones, given
    how many terms are tested. Every weight that training leaves is kept, whatever its sign. Without both labels, or
    without any sign, nothing is learned and all texts score 0.
    """
    n, positive = len(rows), sum(label for _, label in rows)
    if not positive or positive == n:
        return Model({}, {}, 0.0)
    signs = _tell(((_terms(words), label) for words, label in _different(rows)), least, both=False)
    if not signs:
        return Model({}, {}, 0.0)
    marked = set(signs)
    near = ((terms - marked, label) for terms, label in ((_terms(words), label) for words, label in _different(rows)) if not marked.isdisjoint(terms))
    contexts = _tell(near, least, both=True)
    index = {t: i for i, t in enumerate([*signs, *contexts])}
    term, sent_of, doc_of = [], [], []
    for d, (raw, _) in enumerate(rows):
        for s in raw.translate(_PLAIN).split(b"\n"):
            terms = _terms(set(s.split()))
            if not marked.isdisjoint(terms):
                ids = [index[t] for t in terms if t in index]
                term += ids
                sent_of += [len(doc_of)] * len(ids)
                doc_of.append(d)
    term, sent_of, doc_of = np.array(term), np.array(sent_of), np.array(doc_of)
    y = np.array([label for _, label in rows], float)
    w, b = np.zeros(len(index)), -3.0
    m, v = np.zeros(len(index) + 1), np.zeros(len(index) + 1)
    weigh = np.where(y > 0, *((scale or {}).get(k, 1.0) for k in (1, 0)))
    weigh = weigh / weigh.sum()
    for step in range(1, rounds + 1):
        z = np.clip(b + np.bincount(sent_of, w[term], len(doc_of)), -30, 30)
        p = 1 / (1 + np.exp(-z))
        clear = np.bincount(doc_of, np.log1p(-np.minimum(p, 1 - 1e-9)), n)
        prob = np.clip(1 - np.exp(clear), 1e-6, 1 - 1e-6)
        # d loss / d z of a sentence: (prob - y) / prob * p, through log(1 - prob) = sum log(1 - p)
        g = (weigh * (prob - y) / prob)[doc_of] * p
        grad = np.append(np.bincount(term, g[sent_of], len(w)), g.sum())
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        move = 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        w, b = w - move[:-1], b - move[-1]
        w = np.sign(w) * np.maximum(0, np.abs(w) - 0.1 * shrink / (np.sqrt(v[:-1] / (1 - 0.99**step)) + 1e-4) * 0.1)
    held = {t: float(w[i]) for t, i in index.items() if w[i]}
    pick = lambda kind, some: {t: x for (k, t), x in some.items() if k == kind}
    both = {t: held.get(t, 0.0) for t in signs}
    return Model(pick(0, held), pick(1, held), float(b), frozenset(pick(0, both)), frozenset(pick(1, both)))


def sample(docs: DataFrame, labels: DataFrame, key: str, text: str, label: str, most: int = SAMPLE, longest: int = LONGEST) -> tuple[list[tuple[bytes, int]], dict[int, float]]:
    """The texts of `most` keys of each label, the least by a 64-bit hash; of these, texts of over `longest` characters stay out.

    labels has a row a key; a null label does not count. Also for how many labelled keys of its label a row stands. The
    chosen keys are broadcast, at most `most` of a label; texts are not shuffled. Where keys repeat in docs, the least
    texts of a label are taken, 2 * most at the utmost.
    """
    known = labels.select(F.col(key).alias("_k"), F.col(label).cast("int").alias("y")).filter("y IS NOT NULL")
    out: list[tuple[bytes, int]] = []
    scale: dict[int, float] = {}
    for y, n in sorted((r.y, r["count"]) for r in known.groupBy((F.col("y") > 0).alias("y")).count().collect()):  # two rows
        chosen = known.filter(((F.col("y") > 0) == y) & about(F.xxhash64("_k"), most, n)).select("_k").orderBy(F.xxhash64("_k"), "_k").limit(most)
        short = F.when(F.length("t") <= longest, F.col("t"))
        texts = docs.select(F.col(key).alias("_k"), F.col(text).alias("t")).filter("t IS NOT NULL").join(F.broadcast(chosen), "_k")
        got = texts.select(F.xxhash64("_k").alias("h"), short.alias("t")).orderBy("h", "t").limit(2 * most).collect()
        out += [(r.t.encode(), int(y)) for r in got if r.t is not None]
        scale[int(y)] = n / max(1, len(got))  # long texts are left out in proportion
    return sorted(out), scale


_FOUND = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("p", pa.float64())]))


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """id, score, sentences (start and end in bytes of the text, p) that hold a sign, for each row of docs.

    Texts that are null, empty or without a sign score 0 and have no sentences. Repeated rows stay repeated.
    An empty table gives an empty result. Keys are integers.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)  # bounded by SAMPLE * LONGEST

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        for batch in pieces(batches, "text", PIECE_BYTES):
            data, off = flat(batch.column("text"))
            raw, at = data.tobytes(), off.tolist()
            got = [m.score(raw[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)]
            found = [[{"start": a, "end": b, "p": p} for a, b, p in s] for _, s in got]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([x for x, _ in got], pa.float64()), pa.array(found, _FOUND)], names=["id", "score", "sentences"])

    rows = docs.select(F.col(f"`{key}`").cast("long").alias("id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    return rows.mapInArrow(run, "id long, score double, sentences array<struct<start:bigint,end:bigint,p:double>>")


def keep_clean(docs: DataFrame, model: Model, text: str = "text", at: float = 0.5) -> DataFrame:
    """The rows of docs, with all their columns, that score under `at`.

    Null and empty texts score 0 and stay. Rows are decided one by one, so repeated rows stay or go together, and keys
    are not read. An empty table stays empty.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, text, PIECE_BYTES):
            data, off = flat(batch.column(text))
            raw, cut = data.tobytes(), off.tolist()
            yield batch.filter(pa.array([held.value.score(raw[a:b])[0] < at for a, b in zip(cut[:-1], cut[1:], strict=True)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """A model from the labelled documents that are not held out.

    Of several labels of a key the largest counts; null labels, null keys and labels of keys that docs lacks do not.
    Null texts are not learned from. Without documents of both labels nothing is learned.
    """
    known = labels.filter((fold_of(F.col("doc_id"), 5) != 0) & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    return fit(*sample(docs, known, "doc_id", "text", "toxic"))


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all whole documents, the model trained on labelled ones that are not held out; with the offending sentences.

    A row for each row of documents, repeated ones too; null and empty texts score 0; a null doc_id has a null held_out.
    """
    docs = documents(spark, sf_dir)
    scored = score(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    bad = F.filter("sentences", lambda s: s["p"] >= 0.5)
    return scored.select(
        F.col("id").alias("doc_id"), (fold_of(F.col("id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"),
        F.size(bad).alias("n_offending"), F.transform(bad, lambda s: s["start"]).alias("offending_starts"),
    )
