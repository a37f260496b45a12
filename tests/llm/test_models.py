import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pytest

from shelfwise.llm import katz as L
from shelfwise.llm import secret_scan as S
from shelfwise.llm import toxicity as X
from shelfwise.llm.common import hashes
from tests.llm.helpers import empty, rows, table, words_of


def brute_katz(pairs, order):
    held = [i is not None and zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in pairs]
    tokens = [words_of(t) + [None] for _, t in pairs]
    grams = [Counter() for _ in range(order)]  # by length less one; histories are padded with end marks
    after = lambda t, i, k: tuple(([None] * k + t)[i : i + k + 1])
    for h, t in zip(held, tokens, strict=True):
        if not h:
            for k in range(order):
                grams[k].update(after(t, i, k) for i in range(len(t)))
    n, v = sum(grams[0].values()), len(grams[0])

    def discount(counts):
        often = Counter(counts.values())
        d = L.discounts({f"n{k}": often[k] for k in range(1, L.K + 2)})
        return lambda c: d[c] * c if c <= L.K else c - 0.5

    ds = [discount(g) for g in grams]
    followers = defaultdict(set)
    for k in range(1, order):
        for g in grams[k]:
            followers[g[:-1]].add(g[-1])
    of = lambda h: sum(grams[len(h)][(*h, w)] for w in followers[h])
    unknown = 1 - sum(ds[0](c) / n for c in grams[0].values())

    @lru_cache(None)
    def weight(h):
        seen = [(*h, w) for w in followers[h]]
        return (1 - sum(ds[len(h)](grams[len(h)][g]) for g in seen) / of(h)) / (1 - sum(p(g[1:]) for g in seen))

    @lru_cache(None)
    def p(g):
        k = len(g) - 1
        if grams[k][g]:
            return ds[k](grams[k][g]) / (of(g[:-1]) if k else n)
        if not k:
            return unknown
        return (weight(g[:-1]) if followers[g[:-1]] else 1) * p(g[1:])

    out = []
    for (i, _), h, t in zip(pairs, held, tokens, strict=True):
        score = sum(math.log10(p(after(t, i, order - 1))) for i in range(len(t)))
        base = sum(math.log10((grams[0][w,] + 1) / (n + v + 1)) for w in t)
        out.append((i, h, len(t), sum(grams[0][w,] > 0 for w in t), n, round(base, 6), round(score, 6)))
    some = [h for h in followers if len(h) == order - 1][:20]
    total = [sum(p((*h, w)) for (w,) in grams[0]) + p((*h, b"\0never")) for h in some]
    return sorted(out, key=str), total


@pytest.mark.parametrize("order, group", [(3, 8 << 20), (3, 600), (2, 600), (4, 2000)])
def test_katz_equals_brute_force_and_sums_to_one(spark, monkeypatch, order, group):
    monkeypatch.setattr(L, "GROUP_BYTES", group)
    few = [r for r in rows() if len(r[1] or "") < 100_000]
    got = sorted(((*r[:5], round(r[5], 6), round(r[6], 6)) for r in map(tuple, L.scored(table(spark, few), order).collect())), key=str)
    want, total = brute_katz(few, order)
    assert got == want and np.allclose(total, 1)


def test_states_hold_the_words_of_texts():
    texts = [None, "", " \t\n", " A\x0bb\x0c\r a ", "\x00É\x1c\x85\u3000x \u2028 z", "one", "B a\n\nb"] + [t for _, t in rows()]
    words, stream, sizes = L._words_of(pa.array(texts))
    want = [np.append(hashes(words_of(t)), L.END) for t in texts]
    assert (words[stream] == np.concatenate(want)).all() and sizes.tolist() == list(map(len, want))
    assert (np.diff(words.astype(object)) > 0).all()


@pytest.mark.parametrize("buckets", [1, 2, 8])
def test_a_turn_counts_its_own_n_grams_alone(monkeypatch, buckets):
    words, stream, sizes = L._words_of(pa.array([t for _, t in rows(40)]))
    row = {"g": 1, "docs": [0] * len(sizes), "held": [i % 3 == 0 for i in range(len(sizes))], "sizes": sizes.tolist(), "words": L._pack_keys(words), "stream": L._planes(stream.astype(np.uint32))}
    group, train, sorted_keys = L.Group(row, 3), np.repeat(~np.array(row["held"]), sizes), []
    sort = L._ranked
    monkeypatch.setattr(L, "_ranked", lambda keys: (sorted_keys.append(len(keys)), sort(keys))[1])
    got = [{}, {}, {}]
    for turn in range(min(L.PASSES, buckets)):
        for k, keys, counts in L._own_counts(row, 3, buckets, turn):
            for _, s in L._slices(keys, buckets, turn):
                got[k] |= dict(zip(keys[s].tolist(), counts[s].tolist(), strict=True))
    for k in range(3):
        assert got[k] == dict(zip(group.keys[k].tolist(), np.bincount(group.at[k][train], minlength=len(group.keys[k])).tolist(), strict=True))
    assert sum(sorted_keys) == 2 * len(stream)  # each n-gram in its own turn only
    short = L.Group(row, 3, whole=False)
    assert short.at[-1] is None and all((a == b).all() for x, y in zip((short.keys, short.history[1:], short.lower[1:]), (group.keys, group.history[1:], group.lower[1:])) for a, b in zip(x, y))


def test_distinct_hashes_are_those_of_unique():
    rng = np.random.default_rng(4)
    wide = rng.integers(0, 2**64, 3000, np.uint64)[rng.integers(0, 3000, 9000)]
    alike = rng.permutation(np.arange(500, dtype=np.uint64).repeat(3))  # no upper bits at all
    for keys in (wide, alike, np.sort(alike), wide[:1], wide[:0]):
        every, some, back = L._distinct(keys)
        want, at = np.unique(keys, return_inverse=True)
        assert (every == want).all() and (back == at).all() and (keys[some] == every).all()
    top = np.sort(wide)
    assert all((a == b).all() for a, b in zip(L._by_key(np.append(top[1:], top[0]), np.append(top[1:], top[0])), (top, top), strict=True))


def test_count_tables_can_be_looked_up(spark, tmp_path):
    one, two = [i for i in range(50) if zlib.crc32(str(i).encode()) % 7 != 2][:2]
    docs = table(spark, [(one, "a b a b c"), (two, "a b"), (None, "B a")])
    L.scored(docs, 3, str(tmp_path / "counts")).count()
    grams = [["a"], ["a", "b"], ["b", "a", "b"], [None], [None, "a"], ["c", None], ["x"], ["b", "c", "a"]]
    df = spark.createDataFrame([(g,) for g in grams], "gram array<string>")
    got = {tuple(r.gram): r["count"] for r in L.look_up(spark.read.parquet(str(tmp_path / "counts")), df).collect()}
    assert [got[tuple(g)] for g in grams] == [4, 3, 1, 3, 2, 1, 0, 0]


def test_katz_of_nothing(spark):
    assert L.scored(empty(spark)).count() == 0


def test_katz_without_training(spark):
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2)
    (r,) = L.scored(table(spark, [(held, "a b")])).collect()
    assert (r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) == (3, 0, 0, 0.0, 0.0)


def toxic_rows(n=600):
    rng = random.Random(4)
    out = []
    for i in range(n):
        words = [f"w{rng.randint(0, 500)}" for _ in range(60)]
        bad = i % 4 == 0
        if bad:
            words[rng.randint(0, 59)] = rng.choice(["Scum,", "IDIOT", "trash."])
            words[rng.randint(0, 59)] = rng.choice(["moron", "clown"])
        out.append((i, " ".join(words), int(bad)))
    return out


def test_toxicity_on_held_out_rows(spark):
    data = toxic_rows()
    docs = table(spark, [(i, t) for i, t, _ in data] + [(None, None), (9999, "")])
    labels = spark.createDataFrame([(i, None, y) for i, _, y in data] + [(None, None, 1), (5, None, None)], "doc_id long, quality int, toxic int")
    slim = docs.select("doc_id", "text")
    out = {r.doc_id: r for r in X.scored(slim, X.train(slim, labels)).collect()}
    held = [(i, y) for i, _, y in data if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(out[i].held_out for i, _ in held) and not out[None].held_out
    right = sum(out[i].predicted == y for i, y in held)
    assert right >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in out.values()) and out[9999].predicted == 0


def test_machine_learns_a_pair_that_neither_term_tells():
    rng = np.random.default_rng(2)
    flags = rng.integers(0, 2, (3000, 2))
    data = [np.array(sorted({10 + a, 20 + b}), np.int32) for a, b in flags]
    y = (flags[:, 0] == flags[:, 1]).astype(float)
    m = X.fit(data, y, epochs=120)
    assert ((m.score(data) >= 0.5) == (y > 0)).mean() > 0.95


@pytest.mark.parametrize("make", [empty, lambda spark: table(spark, rows())])
def test_toxicity_without_labels(spark, make):
    docs = make(spark).select("doc_id", "text")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert all(r.score == 0 for r in X.scored(docs, X.train(docs, labels)).collect())


def secret_rows():
    rng = random.Random(8)
    hexes = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n))
    out = []
    for i in range(80):
        out.append((i, f'some text token = "{hexes(40)}" and password={hexes(18)}### more'))
        out.append((100 + i, f"mail that.{i}@mail{i % 9}.example.com or call {rng.randint(10**15, 10**16)} and AKIA{hexes(16).upper()} end"))
        out.append((200 + i, f"see file-name-{i}-version-2 and http://host{i}.example.com/a/b?x=1 there"))
    return out + [(None, f'token = "{"ab12" * 10}"'), (500, None), (501, ""), (502, "x1" * 40_000), (0, out[0][1])]


def test_secrets(spark):
    docs = table(spark, secret_rows())
    found = S.verdicts(docs, S.findings(docs)).collect()
    kind = lambda v: len(v) == 40 or len(v) == 18 or v.startswith("AKIA")
    assert sum(kind(r.value) for r in found) == 80 * 3 + 3
    wrong = [r for r in found if bool(r.is_secret) != kind(r.value) and len(r.value) < 1000]
    assert len(wrong) <= 0.02 * len(found)
    apart = [r for r in found if r.fold == 0 and r.label is not None]  # no part in training
    assert len(apart) > 30 and sum(r.is_secret == (r.label == 1) for r in apart) >= 0.98 * len(apart)


FORMS = [
    ('password=correcthorsebatterystaple', "correcthorsebatterystaple"), ('password="P@ss!w0rd$2024#xyz"', "P@ss!w0rd$2024#xyz"), ("password: hunter2x9.", "hunter2x9"),
    ('{"pwd": "Xy7k9Qab"}', "Xy7k9Qab"), ("Authorization: Bearer abc.def-123", "abc.def-123"), ("passphrase = 'two words and more'", "two words and more"),
    ("-----BEGIN RSA PRIVATE KEY-----\nMIIEow\nIBAAK=\n-----END RSA PRIVATE KEY-----", None), ("my_token=ab12cd34ef56###", "ab12cd34ef56"), ("see Zk9fQ2mLx7Rt4, so", "Zk9fQ2mLx7Rt4"),
    ("none here", ""),
]


def test_forms_of_candidates(spark):
    texts = [(i, f"some words {t} and others") for i, (t, _) in enumerate(FORMS)]
    got = {}
    for r in S.findings(table(spark, texts)).collect():
        got.setdefault(r.doc_id, []).append(r.value)
    for i, (t, v) in enumerate(FORMS):
        assert got.get(i, [""]) == [t if v is None else v], t


def test_features_equal_plain_ones(spark):
    docs = table(spark, secret_rows())
    found = S.findings(docs)
    got = {r.value: r for r in S.verdicts(docs, found).collect()}
    texts = [t.lower() for _, t in secret_rows() if t]
    often = Counter(w for t in texts for w in set(re.findall(r"(?<![^\W_])[^\W\d_]{3,16}(?![^\W_])", t)))
    words = {w: n for w, n in often.items() if n >= 5}
    two, one = Counter(), Counter()
    for w, n in words.items():
        for a, b in zip(w, w[1:], strict=False):
            if a.isascii() and b.isascii():
                two[a + b] += n
                one[a] += n
    for v, r in got.items():
        if len(v) > 1000:
            continue
        low, n = v.lower(), len(v)
        pairs = [low[i : i + 2] for i in range(n - 1) if re.fullmatch("[a-z]{2}", low[i : i + 2])]
        usual = [math.log(two[p] / one[p[0]]) if two[p] else -9.0 for p in pairs] or [-9.0]
        covered = {k for i in range(n) for j in range(i + 4, min(i + 12, n) + 1) if low[i:j] in words for k in range(i, j)}
        kinds = sum((a.isdigit() and b.isalpha()) or (a.isalpha() and b.isdigit()) for a, b in zip(v, v[1:], strict=False))
        want = [math.log(n), sum(c.isdigit() for c in v) / n, sum(c.isupper() for c in v) / n, kinds / n, len(set(v)) / n, sum(usual) / len(usual), len(covered) / n]
        assert np.allclose([r.f_length, r.f_digits, r.f_upper, r.f_kind_changes, r.f_distinct, r.f_transitions, r.f_dictionary], want), v


def test_labels_of_one_s_own(spark):
    docs = table(spark, secret_rows())
    found = S.findings(docs)
    mails = [r.value for r in found.collect() if "@" in r.value]
    given = [(hashlib.sha256(v.encode()).hexdigest(), 1) for v in mails[:60]] + [(hashlib.sha256(r.value.encode()).hexdigest(), 0) for r in found.collect() if "@" not in r.value]
    out = S.verdicts(docs, found, spark.createDataFrame(given, "value_sha256 string, label int")).collect()
    assert all(r.is_secret for r in out if r.value in mails) and sum(r.is_secret for r in out if r.value not in mails) <= 5


def test_redaction_takes_longer_secrets_first(spark):
    long = "ab12cd34ef56ab789900ffee1122"
    rows_ = [(i, f'password="{long[:12]}aaaa" and token = "{long[:12]}aaaa{i:04d}bb22" end') for i in range(40)] + [(None, f'token = "{long}"'), (None, "x"), (7, f'token = "{long}"')]
    docs = table(spark, rows_ + [r for r in secret_rows() if r[0] is not None and r[0] >= 100])
    out = [r.text or "" for r in S.redact(spark, docs, "").collect()]
    assert len(out) == docs.count() and sum('token = "[REDACTED]" end' in t for t in out) == 40 and not any("ab12cd34" in t for t in out)


def test_redact(spark):
    docs = table(spark, secret_rows())
    out = {(r.doc_id, r.text) for r in S.redact(spark, docs, "").collect()}
    texts = dict(x for x in out if x[0] is not None)
    assert len(texts) == 243 and 'token = "[REDACTED]" and password=[REDACTED]###' in texts[3]
    assert texts[205] == dict(secret_rows())[205] and texts[500] is None and (None, 'token = "[REDACTED]"') in out


def test_no_findings(spark):
    for docs in (empty(spark), table(spark, [(1, None), (2, "plain words")])):
        assert S.verdicts(docs, S.findings(docs)).count() == 0


def test_long_runs_and_values(spark):
    """A million equal signs, letters, digits or blanks, short runs in turn, and values of 200,000 characters."""
    n = 1_000_000
    texts = [f"see chapter 1{c * n} 27" for c in ".!#*-=_/ \ta7,"] + ["x" + ".#" * (n // 2), "x1" + "!!##" * (n // 4), "password=" + "a-b_" * 50_000 + "c"]
    texts += ['token = "' + "qT9" * 50_000 + '"', "src=data:image/png;base64," + "iVBORw0KGgoAAAANSUhEUgAA" * 8_000, "secret " * 100_000, "-----BEGIN PRIVATE KEY-----" + "A" * n]
    docs = table(spark, [*enumerate(texts), *(r for r in secret_rows() if r[0] is not None and r[0] >= 100)])
    found = S.findings(docs).cache()
    out = S.verdicts(docs, found)
    assert out.count() == found.count() and S.redact(spark, docs, "").count() == docs.count()
    longest = out.where("doc_id < 50").selectExpr("max(length(value)) n", "min(f_dictionary) d").first()
    assert longest.n >= 190_000 and longest.d >= 0
    found.unpersist()
