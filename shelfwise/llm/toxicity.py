"""Toxicity: a factorization machine over hashed terms.

A document is the set of its terms (lower-case words without outer punctuation), each hashed to one of ``SPACE``
slots. The score is the logistic of w0 + sum(w_i) + sum over pairs <v_i, v_j>: the factors v let a pair of terms, such as
an insult beside the mention of a group, count for more than the two alone. Terms that fewer than ``RARE`` or more than
``COMMON`` of the training documents hold, or whose chi-square against the label is below ``TELLING``, get no weight. Training runs on at most ``MOST`` labelled documents (those
with the lowest hash of doc_id; a documented bound), never on rows whose crc32 of doc_id leaves remainder 0 mod 5.

Defined cases: null or empty text is scored by w0 alone; a very long text is scored whole; a null doc_id is no training
row and counts as not held out; of rows that share a labelled doc_id one is learnt from, the one whose text has the lowest
hash; repeated rows, and texts that tie, get equal scores; without labels of both kinds every score is 0; an empty table gives an empty result.
Only doc_id and text are read, so other columns may have any name, and neither labels nor language or source can enter a score.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfwise.llm.common import hashes, label_rows, lower_words, read, settle, staged

SPACE = 1 << 20
FACTORS = 4
MOST = 20_000
RARE, COMMON = 4, 0.3
#: A term's first so many bytes are terms too, for insults that come in many inflected forms.
STEMS = (4, 5, 6)
#: Terms whose chi-square against the label is lower say nothing.
TELLING = 15.0
OUTER = b".,;:!?\"'`()[]{}<>|*#$%&@/\\-_=+~^"


def terms(text: str | None) -> np.ndarray:
    """Sorted distinct slots of a text's terms."""
    found = {w.strip(OUTER) for w in lower_words(text)}
    found.discard(b"")
    found |= {b"%d %s" % (k, w[:k]) for w in found for k in STEMS if len(w) > k}
    return np.unique(hashes(list(found)) % np.uint64(SPACE)).astype(np.int32)


@dataclass
class Machine:
    """Weights of the slots in ``slots`` (sorted); any other slot weighs nothing."""

    slots: np.ndarray
    w0: float
    w: np.ndarray
    v: np.ndarray

    def score(self, rows: list[np.ndarray]) -> np.ndarray:
        out = np.empty(len(rows))
        for i, r in enumerate(rows):
            at = np.searchsorted(self.slots, r)
            at = at[(at < len(self.slots)) & (self.slots[np.minimum(at, len(self.slots) - 1)] == r)]
            v = self.v[at]
            s = v.sum(axis=0)
            out[i] = self.w0 + self.w[at].sum() + 0.5 * float((s * s - (v * v).sum(axis=0)).sum())
        return 1 / (1 + np.exp(-np.clip(out, -40, 40)))


def fit(rows: list[np.ndarray], y: np.ndarray, epochs: int = 30, batch: int = 256, rate: float = 0.3, decay: float = 2e-3, seed: int = 7) -> Machine:
    """Adagrad on the logistic loss with L2 decay; ``rows`` hold the slots that are to get weights."""
    rng = np.random.default_rng(seed)
    slots = np.unique(np.concatenate(rows))
    if not len(slots):
        slots = np.array([-1], np.int32)
    known = [np.searchsorted(slots, r) for r in rows]
    n = len(slots)
    w, v = np.zeros(n), rng.normal(0, 0.01, (n, FACTORS))
    w0 = float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
    seen_w, seen_v, seen_0 = np.full(n, 1e-2), np.full((n, FACTORS), 1e-2), 1.0
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for at in range(0, len(order), batch):
            part = order[at : at + batch]
            idx = np.concatenate([known[i] for i in part])
            row = np.repeat(np.arange(len(part)), [len(known[i]) for i in part])
            vi = v[idx]
            s = np.stack([np.bincount(row, vi[:, k], len(part)) for k in range(FACTORS)], axis=1)
            q = np.bincount(row, (vi * vi).sum(axis=1), len(part))
            z = w0 + np.bincount(row, w[idx], len(part)) + 0.5 * ((s * s).sum(axis=1) - q)
            g = (1 / (1 + np.exp(-np.clip(z, -40, 40))) - y[part]) / len(part)
            hit, back = np.unique(idx, return_inverse=True)
            gw = np.bincount(back, g[row], len(hit)) + decay / len(part) * w[hit]
            pull = g[row, None] * (s[row] - vi)
            gv = np.stack([np.bincount(back, pull[:, k], len(hit)) for k in range(FACTORS)], axis=1) + 4 * decay / len(part) * v[hit]
            seen_w[hit] += gw * gw
            seen_v[hit] += gv * gv
            seen_0 += g.sum() ** 2
            w[hit] -= rate * gw / np.sqrt(seen_w[hit])
            v[hit] -= rate * 0.3 * gv / np.sqrt(seen_v[hit])
            w0 -= rate * g.sum() / np.sqrt(seen_0)
    return Machine(slots, w0, w, v)


def _held_out() -> F.Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))


def _slots(batches):
    for b in batches:
        rows = [terms(t) for t in b.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column("label"), pa.array(rows, pa.list_(pa.int32()))], names=["label", "slots"])


def telling_slots(sample: DataFrame, total: int, toxic: int) -> np.ndarray:
    """The slots that get weights, by document counts over ``sample`` (label, slots)."""
    counts = (
        sample.select("label", F.explode("slots").alias("slot"))
        .groupBy("slot")
        .agg(F.count(F.lit(1)).cast("double").alias("often"), F.sum("label").cast("double").alias("both"))
        .where((F.col("often") >= RARE) & (F.col("often") <= max(COMMON * total, RARE)))
    )
    lift = F.col("both") * total - F.col("often") * toxic
    chi = lift * lift * total / (F.col("often") * (total - F.col("often")) * float(toxic) * float(total - toxic))
    return np.sort(counts.where(chi >= TELLING).select("slot").toArrow().column(0).to_numpy().astype(np.int32))


def train(docs: DataFrame, labels: DataFrame, most: int = MOST) -> Machine | None:
    """``docs`` has doc_id and text."""
    # The bound is found on ids alone; only the chosen rows' texts move
    chosen = label_rows(labels, "toxic").where(F.crc32(F.col("label_id").cast("string").cast("binary")) % 5 != 0)
    chosen = chosen.orderBy(F.xxhash64("label_id"), "label_id").limit(most)
    rows = docs.join(F.broadcast(chosen), F.col("doc_id") == F.col("label_id"))
    rows = rows.groupBy("label_id", "label").agg(F.min(F.struct(F.xxhash64("text"), "text")).alias("one")).select("label", "one.text")
    sample = staged(rows.mapInArrow(_slots, "label int, slots array<int>"), "op5-sample")
    size = sample.agg(F.count(F.lit(1)), F.coalesce(F.sum("label"), F.lit(0))).first()
    total, toxic = size[0], size[1]
    if toxic in (0, total):
        return None
    telling = sample.sparkSession.sparkContext.broadcast(telling_slots(sample, total, toxic))

    def keep(batches):
        for b in batches:
            few = [np.intersect1d(np.asarray(r, np.int32), telling.value, assume_unique=True) for r in b.column("slots").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("label"), pa.array(few, pa.list_(pa.int32()))], names=["label", "slots"])

    found = sample.mapInArrow(keep, "label int, slots array<int>").toArrow()
    y = found.column("label").to_numpy().astype(float)
    slots = [np.asarray(x, np.int32) for x in found.column("slots").to_pylist()]
    # A fixed order, whatever the order of partitions
    order = sorted(range(len(slots)), key=lambda i: (slots[i].tobytes(), y[i]))
    return fit([slots[i] for i in order], y[order])


def scored(docs: DataFrame, machine: Machine | None) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of ``docs`` (doc_id, text)."""
    shared = docs.sparkSession.sparkContext.broadcast(machine)

    def run(batches):
        for b in batches:
            texts = b.column("text").to_pylist()
            s = shared.value.score([terms(t) for t in texts]) if shared.value else np.zeros(len(texts))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return docs.select("doc_id", _held_out().alias("held_out"), "text").mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    settle(spark)
    docs = read(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return scored(docs, train(docs, read(spark, sf_dir, "labels")))
