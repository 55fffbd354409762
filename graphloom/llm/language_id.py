"""Language identification by a convolutional network over bytes, trained and run in numpy.

A text is cut into windows of WINDOW bytes, the last one padded. Filters of several widths slide over the byte
embeddings of a window; each keeps its largest response; a softmax over these gives the window's languages. A text's
logits are the mean of its windows'. Inference sums rows of tables, one for each pair of bytes, since an embedding
times a filter depends on the bytes alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import about, documents, flat, fold_of, pieces, softmax

WINDOW, WIDTHS, FILTERS, EMBED = 128, (2, 3, 4, 5), 8, 8
#: Documents to train on, and windows from each, at places chosen by hash.
SAMPLE, PLACES = 5000, 3
PIECE_BYTES = 256 << 10
#: Windows that are looked at together.
WINDOWS = 2048
UNKNOWN = "und"


@dataclass
class Model:
    langs: list[str]
    byte_class: np.ndarray  # of 256: 0 for padding and bytes not seen
    first: np.ndarray  # classes**2 x features: offsets 0 and 1 of all filters
    second: np.ndarray  # offsets 2 and 3
    third: np.ndarray  # classes x features: offset 4
    bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray

    def logits(self, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Mean logits of each text; texts without bytes get zeros."""
        lengths = np.diff(off)
        counts = -(-lengths // WINDOW)
        total = int(counts.sum())
        result = np.zeros((len(lengths), len(self.langs)), np.float32)
        if not total:
            return result
        first_window = np.concatenate([[0], np.cumsum(counts)])
        owner = np.repeat(np.arange(len(counts)), counts)
        begin = off[:-1][owner] + (np.arange(total) - first_window[:-1][owner]) * WINDOW
        end = np.minimum(begin + WINDOW, off[1:][owner])
        k, wide, z = len(self.third), self.third.shape[1], np.empty((total, len(self.langs)), np.float32)
        for w in range(0, total, WINDOWS):  # so a text of any length takes the memory of so many windows, and of their logits
            at = begin[w : w + WINDOWS, None] + np.arange(WINDOW + 4)
            codes = np.where(at < end[w : w + WINDOWS, None], self.byte_class[data[np.minimum(at, len(data) - 1)]], 0)
            pairs = codes[:, :-1] * k + codes[:, 1:]
            r = self.first.take(pairs[:, :WINDOW], axis=0)
            r += self.second.take(pairs[:, 2 : WINDOW + 2], axis=0)
            r[:, :, -wide:] += self.third.take(codes[:, 4:], axis=0)
            z[w : w + WINDOWS] = np.maximum(r.max(axis=1) + self.bias, 0) @ self.out + self.out_bias
        some = counts > 0
        result[some] = np.add.reduceat(z, first_window[:-1][some], axis=0) / counts[some, None]
        return result


def fit(texts: list[bytes], langs: list[str], steps: int = 700, batch: int = 128, seed: int = 7) -> Model | None:
    """Trains on windows of WINDOW bytes at most; some are cut shorter, as short texts are."""
    names = sorted(set(langs))
    if not names:
        return None
    rng = np.random.default_rng(seed)
    used = sorted(set(b"".join(texts)) - {0})
    byte_class = np.zeros(256, np.int32)
    byte_class[used] = np.arange(1, len(used) + 1)
    k = len(used) + 1
    x = np.zeros((len(texts), WINDOW + 4), np.int32)
    for i, t in enumerate(texts):
        cut = t[:WINDOW] if rng.random() < 0.8 else t[: int(rng.integers(12, WINDOW))]
        x[i, : len(cut)] = byte_class[np.frombuffer(cut, np.uint8)]
    index = {name: i for i, name in enumerate(names)}
    y = np.array([index[v] for v in langs])
    p = {"e": rng.normal(0, 0.3, (k, EMBED)), "o": rng.normal(0, 0.2, (len(WIDTHS) * FILTERS, len(names))), "c": np.zeros(len(names)), "b": np.zeros(len(WIDTHS) * FILTERS)}
    for w in WIDTHS:
        p[f"f{w}"] = rng.normal(0, 1 / np.sqrt(w * EMBED), (w * EMBED, FILTERS))
    p = {name: v.astype(np.float32) for name, v in p.items()}
    m = {name: np.zeros_like(v) for name, v in p.items()}
    v2 = {name: np.zeros_like(v) for name, v in p.items()}
    for step in range(1, steps + 1):
        rows = rng.integers(0, len(x), batch)
        ids = x[rows]
        emb = p["e"][ids]
        parts, kept = [], []
        for w in WIDTHS:
            cols = np.concatenate([emb[:, o : o + WINDOW] for o in range(w)], axis=2)
            r = cols @ p[f"f{w}"]
            arg = r.argmax(axis=1)
            parts.append(np.take_along_axis(r, arg[:, None], axis=1)[:, 0])
            kept.append((cols, arg))
        raw = np.concatenate(parts, axis=1) + p["b"]
        h = np.maximum(raw, 0)
        prob = softmax(h @ p["o"] + p["c"])
        prob[np.arange(batch), y[rows]] -= 1
        prob /= batch
        g = {"o": h.T @ prob, "c": prob.sum(0), "e": np.zeros_like(p["e"])}
        dh = (prob @ p["o"].T) * (raw > 0)
        g["b"] = dh.sum(0)
        for i, w in enumerate(WIDTHS):
            cols, arg = kept[i]
            d = dh[:, i * FILTERS : (i + 1) * FILTERS]
            at = cols[np.arange(batch)[:, None], arg]  # batch x filters x (w * EMBED)
            g[f"f{w}"] = np.einsum("bfk,bf->kf", at, d)
            back = (d[:, :, None] * p[f"f{w}"].T[None]).reshape(batch, FILTERS, w, EMBED)
            where = ids[np.arange(batch)[:, None, None], arg[:, :, None] + np.arange(w)]
            np.add.at(g["e"], where.reshape(-1), back.reshape(-1, EMBED))
        for name in p:
            m[name] = 0.9 * m[name] + 0.1 * g[name]
            v2[name] = 0.999 * v2[name] + 0.001 * g[name] ** 2
            p[name] -= 0.01 * (m[name] / (1 - 0.9**step)) / (np.sqrt(v2[name] / (1 - 0.999**step)) + 1e-8)
    n = len(WIDTHS) * FILTERS
    by_offset = np.zeros((max(WIDTHS), k, n), np.float32)
    for i, w in enumerate(WIDTHS):
        f = p[f"f{w}"].reshape(w, EMBED, FILTERS)
        for o in range(w):
            by_offset[o, :, i * FILTERS : (i + 1) * FILTERS] = p["e"] @ f[o]
    pair = lambda a, b: (by_offset[a][:, None] + by_offset[b][None]).reshape(k * k, n).astype(np.float32)
    return Model(names, byte_class, pair(0, 1), pair(2, 3), by_offset[4][:, -FILTERS:].copy(), p["b"], p["o"], p["c"])


def sample(docs: DataFrame, key: str, text: str, lang: str, most: int = SAMPLE) -> tuple[list[bytes], list[str]]:
    """Windows of `most` rows that have a language and a text, the least by a 64-bit hash of key and text: as many of them
    whatever the size of the table. Rows with a language are counted first, so that partitions send few rows more."""
    h = F.xxhash64(F.col(key), F.col(text))
    places = F.array(*[F.substring(F.col(text), (F.pmod(F.xxhash64(F.col(key), F.lit(i)), F.greatest(F.length(text) - WINDOW + 1, F.lit(1))) + 1).cast("int"), F.lit(WINDOW)) for i in range(PLACES)])
    rows = docs.filter(F.col(lang).isNotNull() & (F.length(F.trim(F.col(text))) > 0))
    rows = rows.filter(about(h, most, docs.filter(F.col(lang).isNotNull()).count()))
    got = rows.select(places.alias("w"), F.col(lang).alias("lang"), h.alias("h")).orderBy("h", "lang").limit(most).collect()
    pairs = sorted({(w, r.lang) for r in got for w in r.w})
    return [w.encode() for w, _ in pairs], [v for _, v in pairs]


def predict(docs: DataFrame, model: Model | None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """id, lang, score for each row of docs.

    Very long texts are read whole, WINDOWS windows at a time. Texts that are null or have no letter get `und` and score 0, as all do when nothing was learned. Repeated rows stay
    repeated; an empty table gives an empty result. Keys are integers.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        for batch in pieces(batches, "text", PIECE_BYTES):
            letters = batch.column("letters").to_numpy(zero_copy_only=False)
            if m is None:
                lang, score = [UNKNOWN] * batch.num_rows, np.zeros(batch.num_rows)
            else:
                prob = softmax(m.logits(*flat(batch.column("text"))))
                best = prob.argmax(axis=1)
                lang = [m.langs[i] if ok else UNKNOWN for i, ok in zip(best, letters, strict=True)]
                score = np.where(letters, prob[np.arange(len(best)), best], 0.0)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=["id", "lang", "score"])

    t = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    rows = docs.select(F.col(f"`{key}`").cast("long").alias("id"), t.alias("text"), t.rlike(r"\p{L}").alias("letters"))
    return rows.mapInArrow(run, "id long, lang string, score double")


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of all whole documents, learned from those that are not held out. A text without a letter is `und` and scores 0."""
    docs = documents(spark, sf_dir)
    model = fit(*sample(docs.filter(fold_of(F.col("doc_id"), 4) != 2), "doc_id", "text", "lang"))
    found = predict(docs, model)
    return found.select(F.col("id").alias("doc_id"), (fold_of(F.col("id"), 4) == 2).alias("held_out"), F.col("lang").alias("lang_pred"), "score")
