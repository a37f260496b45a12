from collections import Counter
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfwise.llm import near_dedup as D
from shelfwise.llm import quality_rules as Q
from tests.llm.helpers import SCHEMA, empty, rows, table, words_of


def brute(pairs, n=4):
    sets = []
    for _, t in pairs:
        w = words_of(t)
        sets.append({tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set()))
    root = list(range(len(pairs)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(range(len(pairs)), 2):
        if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
            root[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(pairs):
        if i is not None:
            least[find(k)] = min(i, least.get(find(k), i))
    return sorted(((i, len(s), least.get(find(k)), i == least.get(find(k))) for k, ((i, _), s) in enumerate(zip(pairs, sets, strict=True))), key=str)


def test_near_duplicates_equal_brute_force(spark):
    got = sorted(map(tuple, D.near_duplicates(table(spark, rows()), 4).collect()), key=str)
    assert got == brute(rows())


def test_a_large_group_of_near_copies_is_one_component(spark):
    base = [f"b{i}" for i in range(150)]
    pairs = [(k, " ".join(base[:j] + [f"q{k}"] + base[j + 1 :])) for k in range(90) for j in [k % 140]]
    got = sorted(map(tuple, D.near_duplicates(table(spark, pairs), 4).collect()), key=str)
    assert got == brute(pairs) and {r[2] for r in got} == {0}


@pytest.mark.parametrize("large", [D.LARGE, 100])
def test_links_inside_a_group_that_shares_boilerplate(spark, monkeypatch, large):
    monkeypatch.setattr(D, "LARGE", large)  # the smaller one makes nodes branch
    # 700 texts of similarity 0.74 to each other, and 100 pairs of 0.82 among them
    common = [f"c{i}" for i in range(37)]
    own = lambda k, n: [f"t{k}x{i}" for i in range(n)]
    texts = [common + own(k, 6) for k in range(700)]
    for k in range(200):
        texts[k] = common + own(f"p{k // 2}", 2) + own(k, 4)
    pairs = [(k, " ".join(t)) for k, t in enumerate(texts)]
    got = sorted(map(tuple, D.near_duplicates(table(spark, pairs), 4).collect()), key=str)
    assert got == brute(pairs) and sum(r[2] != r[0] for r in got) == 100


def test_links_pass_through_null_ids_and_repeated_ids(spark):
    rng = np.random.default_rng(3)
    a = [f"n{k}" for k in range(60)]
    b, c = a[:30] + ["b"] + a[31:], a[:8] + ["c"] + a[9:30] + ["b"] + a[31:]
    c = c[:]
    far = [f"f{k}" for k in rng.integers(0, 999, 60)]
    pairs = [(10, " ".join(a)), (None, " ".join(b)), (12, " ".join(c)), (1, " ".join(far)), (1, " ".join(far[::-1])), (3, " ".join([*far, "y"])), (None, "x y"), (None, "x y")]
    got = sorted(map(tuple, D.near_duplicates(table(spark, pairs), 4).collect()), key=str)
    assert got == brute(pairs) and {r[2] for r in got if r[0] in (10, 12)} == {10}
    assert {r[2] for r in got if r[0] == 3} == {1}
    kept = [(r.doc_id, r.text) for r in D.drop_near_duplicates(spark, table(spark, pairs), "").collect()]
    # Both unlike texts of doc_id 1 stay
    assert sorted(kept, key=str) == sorted([pairs[0], pairs[3], pairs[4], pairs[6], *([pairs[2]] if len(brute(pairs, 5)) and (12, 57, 12, True) in brute(pairs, 5) else [])], key=str)


def test_near_duplicates_of_nothing(spark):
    assert D.near_duplicates(empty(spark), 4).count() == 0


def test_dedup_stage_keeps_one_of_each_group(spark):
    kept = D.drop_near_duplicates(spark, table(spark, rows()), "")
    ids = [r.doc_id for r in kept.collect()]
    want = {c for i, _, c, k in brute(rows(), 5) if k and i is not None}
    assert Counter(i for i in ids if i is not None) == Counter(want) and kept.columns == empty(spark).columns
    assert sum(i is None for i in ids) == 2


def test_components_of_a_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "a long, z long")
    got = {r.node: r.root for r in D.components(links, "chain").collect()}
    assert all(got[i] == 0 for i in range(1, 41)) and got[101] == 100


def test_counts():
    got = dict(zip(Q.COUNTS + Q.EXTRA, Q.counts("a b c a b c\nx #*\na b c a b c\n\n é日"), strict=True))
    assert (got["n_words"], got["word_chars"], got["n_symbols"], got["n_dup_lines"], got["n_repeat_words"]) == (15, 17, 2, 1, 12)
    assert Q.counts(None)[:5] == Q.counts("")[:5] == [0] * 5


def test_path_lengths_are_those_of_one_walk_a_row():
    rng = np.random.default_rng(11)
    x = rng.normal(size=(500, 10)).round(1)  # ties in every column
    forest = Q.fit(x, np.linspace(0, 1, 10), trees=20)

    def depth(t, row):
        at, steps = 0, 0
        while forest.column[t][at] >= 0:
            at = int(forest.left[t][at]) + bool(row[forest.column[t][at]] >= forest.cut[t][at])
            steps += 1
        return steps, at

    want = []
    for row in x:
        total = 0.0
        for t in range(20):
            steps, leaf = depth(t, row)
            assert forest.depth[t][leaf] >= steps  # the leaf adds the usual depth of what it still holds
            total += forest.depth[t][leaf]
        want.append(2 ** (-total / 20 / Q._usual_depth(Q.SAMPLE)))
    assert np.allclose(forest.score(x), want)
    for t in range(20):  # the sampled rows reach every leaf, and a leaf at the limit holds what its depth says
        leaves = {leaf: steps for steps, leaf in (depth(t, r) for r in x)}
        assert all(abs(forest.depth[t][leaf] - steps) < 12 for leaf, steps in leaves.items())
    assert not (forest.column == 0).any()  # a weight of 0 is never split on
    lone = np.vstack([x, np.full((1, 10), 40.0)])
    scores = Q.fit(lone, np.ones(10)).score(lone)
    assert scores[-1] > scores[:-1].max()


def test_threshold_is_measured_on_rows_apart(spark):
    data = labelled(600)
    labels = spark.createDataFrame([(i, q, 0) for i, _, q in data], "doc_id long, quality int, toxic int")
    got = Q.train(Q.statistics(table(spark, [(i, t) for i, t, _ in data])), labels).measured
    assert got["junk_caught"] >= 0.7 * got["junk"] > 0 and got["clean"] > 50 and got["clean_lost"] <= 2
    telling = Q.telling(np.array([[0.0, 1], [1, 0], [2, 1], [3, 0]]), np.array([True, True, False, False]))
    assert telling.tolist() == [1, 0]


def test_training_takes_every_labelled_row(spark):
    rng = np.random.default_rng(3)
    n = 26_000
    ids = np.array([r.h for r in spark.range(n).select(F.xxhash64("id").alias("h")).collect()])
    late = np.argsort(np.argsort(ids)) >= 21_000  # junk lies behind the 20,000 lowest hashes of doc_id only
    made = []
    for i in range(n):
        junk = bool(late[i] and i % 4 == 0)
        row = dict.fromkeys(Q.COUNTS + Q.EXTRA, 0) | {"n_words": 100 + int(rng.integers(0, 9)), "word_chars": 500 + int(rng.integers(0, 90)), "n_lines": 1, "n_letters": 450, "n_distinct": 80}
        made.append((i, *(row | {"n_symbols": int(rng.integers(60, 90)) if junk else int(rng.integers(0, 4))}).values(), 0 if junk else 1))
    frame = spark.createDataFrame(made, ["doc_id", *Q.COUNTS, *Q.EXTRA, "quality"])
    stats = frame.select("doc_id", F.struct(*Q.COUNTS, *Q.EXTRA).alias("stats"))
    forest = Q.train(stats, frame.select("doc_id", "quality"))
    data = np.array([r[1:-1] for r in made])
    x, good = Q.features({c: data[:, i] for i, c in enumerate(Q.COUNTS + Q.EXTRA)}), np.array([r[-1] == 1 for r in made])
    own = np.array([not r.a for r in spark.range(n).select((F.pmod(F.xxhash64("id", F.lit("fold")), F.lit(Q.FOLDS)) == Q.MEASURED).alias("a")).collect()])
    assert forest.threshold == pytest.approx(Q.calibrate(forest.score(x[own]), good[own])) and forest.threshold < 1
    assert forest.measured == {"junk": int((~good & ~own).sum()), "junk_caught": int((~good & ~own).sum()), "clean": int((good & ~own).sum()), "clean_lost": 0}
    rows = frame.select(Q.rated(F.struct(*Q.COUNTS, *Q.EXTRA)).alias("rates"), (F.col("quality") == 1).alias("good"))
    assert np.allclose(Q._weights(rows, int(good.sum()), int((~good).sum())), Q.telling(x, good))
    held = Q._leaf_rows(rows, forest)
    assert (held.sum(axis=1) == n).all() and all((np.bincount(at, minlength=held.shape[1]) == h).all() for at, h in zip(forest.leaves(x), held, strict=True))


def labelled(n=300):
    rng = np.random.default_rng(5)
    out = []
    for i in range(n):
        words = [f"w{rng.integers(0, 3000)}ab" for _ in range(120)]
        junk = i % 10 == 0
        out.append((i, " ".join(w + "***" for w in words) if junk else " ".join(words), 0 if junk else 1))
    return out


def test_forest_parts_junk_from_clean(spark):
    data = labelled()
    labels = spark.createDataFrame([(i, q, 0) for i, _, q in data if i % 3] + [(None, 1, 0), (1, None, 0)], "doc_id long, quality int, toxic int")
    out = {r.doc_id: r for r in Q.judged(table(spark, [(i, t) for i, t, _ in data]), labels).collect()}
    assert all(out[i].kept == bool(q) for i, _, q in data)


@pytest.mark.parametrize("pairs", [rows(), []])
def test_rules_without_labels(spark, pairs):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    out = Q.judged(table(spark, pairs) if pairs else empty(spark), labels).collect()
    assert len(out) == len(pairs)
    assert all(r.kept is not r.base_failed for r in out)


def test_quality_stage(spark, tmp_path):
    data = labelled()
    spark.createDataFrame([(i, q, 0) for i, _, q in data], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    kept = Q.keep_good(spark, table(spark, [(i, t) for i, t, _ in data] + [(None, None)]), str(tmp_path))
    assert sorted(r.doc_id for r in kept.collect()) == [i for i, _, q in data if q] and kept.schema == spark.createDataFrame([], SCHEMA).schema
