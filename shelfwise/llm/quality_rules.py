"""Quality rules: an isolation forest over rule statistics.

``counts`` takes from each text what usual quality rules look at; ``features`` makes plain rates of it. ``fit`` grows an
isolation forest: each tree splits a small random subsample at random values of random rates, and a document that is
parted from the others after few splits is unusual. Which rate a split looks at is drawn in proportion to how well the
rate alone tells labelled junk from labelled good rows (any rate alike where labels of both kinds are missing), so rates
in which good documents differ widely do not drown the others.

``train`` learns from all labelled rows, as Spark jobs: ranks over all of them give the weights of the rates (``telling``
is the same for rows at hand), all of them are counted into the leaves, whose depths follow from these counts, and the
threshold is the best among the scores of all (``calibrate`` for rows at hand). Only where a tree splits comes from its
own subsample, drawn from all of them, as isolation forests are defined: grown on all rows, junk that is many and alike
hides itself. A fifth of the labelled rows, by a hash of doc_id, takes no part in this; ``Forest.measured`` says what the
verdicts are worth on them.

Defined cases: null or empty text has no words and fails the base rule; a very long text is counted whole; a null doc_id
stays null; repeated rows, and rows that tie in all statistics, are scored alike and all returned; of rows that share a
labelled doc_id the one with the smallest statistics is learnt from; an empty table gives an empty result; without
labelled rows no document is anomalous and only the base rule decides. Only doc_id and text are read, so other columns
may have any name.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

from shelfwise.llm.common import hashes, label_rows, read, settle, spare_name, staged, windows, words

SYMBOLS = b"#*$%&|<>"
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
EXTRA = ["n_lines", "n_upper", "n_letters", "n_marks", "n_digits", "n_distinct"]
COUNT_SCHEMA = StructType([StructField(c, LongType()) for c in COUNTS + EXTRA])
#: A small sample keeps junk that is many and alike from hiding itself.
TREES, SAMPLE = 200, 32
RATES = 10
#: Share of the clean rows that a threshold may lose.
LOST = 0.002
#: Parts of an octave in which values are ranked among themselves.
CELLS = 256
#: Labelled rows with this remainder of a hash of doc_id by FOLDS are kept for measuring.
FOLDS, MEASURED = 5, 0

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(SYMBOLS)] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_LETTER = _UPPER.copy()
_LETTER[97:123] = True
_LETTER[128:] = True
_MARK = np.zeros(256, bool)
_MARK[list(b"!?.,;:-_=+/\\()[]{}\"'")] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_HEAD = np.ones(256, bool)
_HEAD[128:192] = False  # continuation bytes: what is left is one a code point


def counts(text: str | None) -> list[int]:
    """The statistics of one text, in the order of COUNTS + EXTRA."""
    tokens = words(text)
    raw = (text or "").encode("utf-8", "surrogatepass")
    joined = np.frombuffer(b"".join(tokens), np.uint8)
    h = hashes(tokens)
    repeat = 0
    if len(h) >= 3:
        w = windows(h, 3)
        _, back, often = np.unique(w, return_inverse=True, return_counts=True)
        twice = often[back] > 1
        hit = np.zeros(len(h), bool)
        for i in range(3):
            hit[i : i + len(w)] |= twice
        repeat = int(hit.sum())
    lines = [x for x in raw.split(b"\n") if x.split()]
    return [
        len(tokens),
        int(_HEAD[joined].sum()),
        int(_SYMBOL[joined].sum()),
        len(lines) - len(set(lines)),
        repeat,
        len(lines),
        int(_UPPER[joined].sum()),
        int((_LETTER[joined] & _HEAD[joined]).sum()),
        int(_MARK[joined].sum()),
        int(_DIGIT[joined].sum()),
        len(np.unique(h)),
    ]


@F.arrow_udf(COUNT_SCHEMA)
def counted(texts: pa.Array) -> pa.Array:
    """The statistics of each text."""
    table = np.array([counts(t) for t in texts.to_pylist()], np.int64).reshape(-1, len(COUNTS + EXTRA))
    return pa.StructArray.from_arrays([pa.array(table[:, i]) for i in range(table.shape[1])], COUNTS + EXTRA)


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id, stats (COUNTS + EXTRA) for each row of docs."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), counted(F.col("text").cast("string")).alias("stats"))


def features(table: dict[str, np.ndarray]) -> np.ndarray:
    """Rates from counts; one row a document."""
    f = {k: v.astype(float) for k, v in table.items()}
    n, chars = np.maximum(f["n_words"], 1), np.maximum(f["word_chars"], 1)
    return np.stack(
        [
            f["word_chars"] / n,
            f["n_symbols"] / chars,
            f["n_symbols"] / n,
            f["n_letters"] / chars,
            f["n_distinct"] / n,
            f["n_dup_lines"] / np.maximum(f["n_lines"], 1),
            f["n_repeat_words"] / n,
            f["n_upper"] / np.maximum(f["n_letters"], 1),
            f["n_marks"] / chars,
            f["n_digits"] / chars,
        ],
        axis=1,
    )


def base_failed(table: dict[str, np.ndarray]) -> np.ndarray:
    return (table["n_words"] < 50) | (100 * table["n_repeat_words"] > 50 * table["n_words"])


def _usual_depth(n: int) -> float:
    """Mean depth of a failed search in a binary tree of n rows."""
    return 0.0 if n < 2 else 1.0 if n == 2 else 2 * (math.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n


def telling(x: np.ndarray, good: np.ndarray) -> np.ndarray:
    """How well each rate alone parts junk from good rows: the fourth power of 2 * AUC - 1; 1 for all without rows of
    both."""
    if not good.any() or good.all():
        return np.ones(x.shape[1])
    out = []
    for column in x.T:
        clean, junk = np.sort(column[good]), column[~good]
        auc = (np.searchsorted(clean, junk, "left") + np.searchsorted(clean, junk, "right")).mean() / 2 / len(clean)
        out.append((2 * auc - 1) ** 4)
    return np.array(out) if max(out) > 0 else np.ones(x.shape[1])


@dataclass
class Forest:
    """Trees as flat arrays: column (-1 at a leaf), cut, left child (the right one follows), depth at leaves."""

    column: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    depth: np.ndarray
    scale: float
    threshold: float = math.inf
    measured: dict[str, float] = field(default_factory=dict)

    def leaves(self, x: np.ndarray):
        """For each tree the leaf of every row."""
        rows = np.arange(len(x))
        for t in range(len(self.column)):
            at = np.zeros(len(x), np.int64)
            while True:
                c = self.column[t][at]
                inner = c >= 0
                if not inner.any():
                    break
                right = x[rows, np.maximum(c, 0)] >= self.cut[t][at]
                at = np.where(inner, self.left[t][at] + right, at)
            yield at

    def score(self, x: np.ndarray) -> np.ndarray:
        """0 to 1; near 1 for rows that few splits isolate."""
        total = np.zeros(len(x))
        for depth, at in zip(self.depth, self.leaves(x), strict=True):
            total += depth[at]
        return np.exp2(-total / len(self.column) / max(self.scale, 1e-9)) if len(x) else total

    def recount(self, held: np.ndarray, sample: int = SAMPLE) -> None:
        """Sets the depth of each leaf from ``held``, the number of all rows in it (tree by node): so many as a sample of
        ``sample`` would have there on average."""
        steps = np.arange(sample + 1)
        usual = np.array([_usual_depth(n) for n in steps])
        for t, column in enumerate(self.column):
            level = np.zeros(len(column))
            for at in np.flatnonzero(column >= 0):  # a node's number is below those of its children
                level[self.left[t][at] : self.left[t][at] + 2] = level[at] + 1
            mean = sample * held[t] / max(1, held[t].sum())
            self.depth[t] = np.where(column < 0, level + np.interp(mean, steps, usual), 0)


def fit(x: np.ndarray, weight: np.ndarray, trees: int = TREES, sample: int = SAMPLE, seed: int = 7) -> Forest:
    """Grows the trees, each on ``sample`` rows drawn without replacement, and no row in two trees if there are enough;
    ``weight`` is that of each column."""
    rng = np.random.default_rng(seed)
    size = min(sample, len(x))
    limit = max(1, math.ceil(math.log2(max(size, 2))))
    room = 2 ** (limit + 1)
    column, cut, left, depth = np.full((trees, room), -1), np.zeros((trees, room)), np.zeros((trees, room), int), np.zeros((trees, room))
    dealt = rng.permutation(len(x))
    for t in range(trees):
        own = dealt[t * size : (t + 1) * size] if len(x) >= trees * size else rng.choice(len(x), size, replace=False)
        todo, free = [(0, x[own], 0)], 1
        while todo:
            at, part, level = todo.pop()
            low, high = part.min(axis=0), part.max(axis=0)
            open_columns = np.flatnonzero((high > low) & (weight > 0))
            if level >= limit or len(part) <= 1 or not len(open_columns):
                depth[t, at] = level + _usual_depth(len(part))
                continue
            c = rng.choice(open_columns, p=weight[open_columns] / weight[open_columns].sum())
            v = rng.uniform(low[c], high[c])
            v = v if v > low[c] else high[c]
            side = part[:, c] >= v
            column[t, at], cut[t, at], left[t, at] = c, v, free
            todo += [(free, part[~side], level + 1), (free + 1, part[side], level + 1)]
            free += 2
    return Forest(column, cut, left, depth, _usual_depth(size))


def calibrate(scores: np.ndarray, good: np.ndarray, lost: float = LOST) -> float:
    """The threshold with the highest (junk caught - clean lost) among those that lose at most ``lost`` of the clean
    rows; infinity if either kind is missing."""
    if not good.any() or good.all():
        return math.inf
    best, found = 0.0, math.inf
    clean, junk = np.sort(scores[good]), np.sort(scores[~good])
    for t in np.unique(scores):
        away = 1 - np.searchsorted(clean, t, "left") / len(clean)
        caught = 1 - np.searchsorted(junk, t, "left") / len(junk)
        if away <= lost and caught - away > best:
            best, found = caught - away, t
    below = scores[scores < found]
    return float((found + below.max()) / 2) if len(below) and math.isfinite(found) else found


@F.arrow_udf(ArrayType(DoubleType()))
def rated(stats: pa.Array) -> pa.Array:
    """The rates of each row of statistics."""
    x = features({c: stats.field(c).to_numpy(zero_copy_only=False) for c in COUNTS + EXTRA})
    return pa.ListArray.from_arrays(np.arange(0, x.size + 1, RATES, dtype=np.int32), x.ravel())


def _matrix(rates: pa.Array) -> np.ndarray:
    return rates.flatten().to_numpy(zero_copy_only=False).reshape(-1, RATES)


def ranked(rows: DataFrame) -> DataFrame:
    """From rows (part, value, good) one row for each distinct value of a part: part, value, n_good, n_junk, good_below and
    junk_below, the numbers of that value and below it. Values from 0 on are ranked within cells, and the cells of a part,
    whose number is bounded, among each other."""
    one = F.col("good").cast("long")
    each = rows.groupBy("part", "value").agg(F.sum(one).alias("n_good"), F.sum(1 - one).alias("n_junk"))
    each = each.withColumn("cell", F.floor(F.log2(F.greatest("value", F.lit(2.0**-20))) * CELLS))

    def below(kind: str, window) -> F.Column:
        return F.coalesce(F.sum(f"n_{kind}").over(window), F.lit(0))

    among = Window.partitionBy("of_part").orderBy("of_cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = each.groupBy(F.col("part").alias("of_part"), F.col("cell").alias("of_cell")).agg(F.sum("n_good").alias("n_good"), F.sum("n_junk").alias("n_junk"))
    cells = cells.select("of_part", "of_cell", below("good", among).alias("good_cells"), below("junk", among).alias("junk_cells"))
    within = Window.partitionBy("part", "cell").orderBy("value").rowsBetween(Window.unboundedPreceding, -1)
    each = each.withColumns({"good_in": below("good", within), "junk_in": below("junk", within)})
    return each.join(cells, (F.col("part") == F.col("of_part")) & (F.col("cell") == F.col("of_cell"))).select(
        "part", "value", "n_good", "n_junk", (F.col("good_in") + F.col("good_cells")).alias("good_below"), (F.col("junk_in") + F.col("junk_cells")).alias("junk_below")
    )


def _weights(own: DataFrame, clean: int, junk: int) -> np.ndarray:
    """``telling`` over all rows (rates, good)."""
    if not clean or not junk:
        return np.ones(RATES)
    wins = F.sum(F.col("n_junk") * (F.col("good_below") + F.col("n_good") / 2))
    found = ranked(own.select(F.posexplode("rates").alias("part", "value"), "good")).groupBy("part").agg(wins.alias("wins")).collect()
    out = np.zeros(RATES)
    for r in found:
        out[r.part] = (2 * r.wins / clean / junk - 1) ** 4
    return out if out.max() > 0 else np.ones(RATES)


def _leaf_rows(own: DataFrame, forest: Forest) -> np.ndarray:
    """How many of all rows (rates) lie in each leaf: tree by node."""
    shape = forest.column.shape

    def count(batches):
        held = np.zeros(shape, np.int64)
        for b in batches:
            for t, at in enumerate(forest.leaves(_matrix(b.column("rates")))):
                held[t] += np.bincount(at, minlength=shape[1])
        there = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(there, pa.int64()), pa.array(held.ravel()[there], pa.int64())], names=["leaf", "n"])

    out = np.zeros(shape, np.int64)
    for r in own.select("rates").mapInArrow(count, "leaf long, n long").groupBy("leaf").agg(F.sum("n").alias("n")).collect():
        out.ravel()[r.leaf] = r.n
    return out


def _threshold(scores: DataFrame, clean: int, junk: int, lost: float = LOST) -> float:
    """``calibrate`` over all rows (score, good)."""
    if not clean or not junk:
        return math.inf
    away, caught = 1 - F.col("good_below") / clean, 1 - F.col("junk_below") / junk
    some = ranked(scores.select(F.lit(0).alias("part"), F.col("score").alias("value"), "good"))
    best = some.select("value", away.alias("away"), (caught - away).alias("gain")).where((F.col("away") <= lost) & (F.col("gain") > 0)).orderBy(F.desc("gain"), "value").first()
    if best is None:
        return math.inf
    below = scores.where(F.col("score") < best.value).agg(F.max("score")).first()[0]
    return best.value if below is None else (best.value + below) / 2


def train(stats: DataFrame, labels: DataFrame) -> Forest | None:
    """Forest and threshold from all labelled rows that pass the base rule; ``stats`` has doc_id and stats."""
    known = (
        stats.where("stats.n_words >= 50 and 100 * stats.n_repeat_words <= 50 * stats.n_words")
        .join(label_rows(labels, "quality"), F.col("doc_id") == F.col("label_id"))
        .groupBy("doc_id")
        .agg(F.min("stats").alias("stats"), F.max("label").alias("label"))
    )
    fold = (F.pmod(F.xxhash64("doc_id", F.lit("fold")), F.lit(FOLDS)) == MEASURED).alias("apart")
    rows = staged(known.select("doc_id", rated("stats").alias("rates"), (F.col("label") > 0).alias("good"), fold), "op8-rates")
    own = rows.where("not apart")
    clean, junk = own.agg(F.count_if("good"), F.count_if(~F.col("good"))).first()
    if not clean + junk:
        return None
    drawn = _matrix(own.orderBy(F.xxhash64("doc_id", F.lit("tree")), "doc_id").limit(TREES * SAMPLE).select("rates").toArrow().column("rates").combine_chunks())
    forest = fit(drawn, _weights(own, clean, junk))
    forest.recount(_leaf_rows(own, forest), min(SAMPLE, len(drawn)))

    @F.arrow_udf(DoubleType())
    def score(rates: pa.Array) -> pa.Array:
        return pa.array(forest.score(_matrix(rates)))

    scores = staged(rows.select("good", "apart", score("rates").alias("score")), "op8-scores")
    forest.threshold = _threshold(scores.where("not apart"), clean, junk)
    good, out = F.col("good"), F.col("score") >= forest.threshold
    measured = {"junk": ~good, "junk_caught": out & ~good, "clean": good, "clean_lost": out & good}
    forest.measured = scores.where("apart").agg(*(F.count_if(c).alias(k) for k, c in measured.items())).first().asDict()
    return forest


def verdicts(spark: SparkSession, forest: Forest | None):
    """A function of the column of statistics: base_failed, anomaly, kept."""
    shared = spark.sparkContext.broadcast(forest)

    @F.arrow_udf("base_failed boolean, anomaly double, kept boolean")
    def judge(stats: pa.Array) -> pa.Array:
        model = shared.value
        t = {c: stats.field(c).to_numpy(zero_copy_only=False) for c in COUNTS + EXTRA}
        base = base_failed(t)
        s = model.score(features(t)) if model else np.zeros(len(base))
        keep = ~base & (s < (model.threshold if model else math.inf))
        return pa.StructArray.from_arrays([pa.array(base), pa.array(s), pa.array(keep)], ["base_failed", "anomaly", "kept"])

    return judge


def judged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, COUNTS, base_failed, anomaly, kept for each row of docs; the statistics are staged, since training reads
    them before scoring does."""
    stats = staged(statistics(docs), "op8-stats")
    judge = verdicts(docs.sparkSession, train(stats, labels))
    return stats.withColumn("v", judge("stats")).select("doc_id", *(f"stats.{c}" for c in COUNTS), "v.*")


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    settle(spark)
    return judged(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the documents that the rules keep. Each text is counted once; its statistics stay beside the row, so
    no join is needed and repeated or null doc_ids cannot be mixed up."""
    settle(spark)
    beside, verdict = spare_name(docs, "stats"), spare_name(docs, "verdict")
    counts_beside = staged(docs.withColumn(beside, counted(F.col("text").cast("string"))), "op8-counted")
    slim = counts_beside.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(beside).alias("stats"))
    judge = verdicts(spark, train(slim, read(spark, sf_dir, "labels")))
    return counts_beside.withColumn(verdict, judge(beside)).where(F.col(verdict)["kept"]).select(*docs.columns)
