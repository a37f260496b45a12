import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from shelfwise.llm import fill_middle as M
from shelfwise.llm import prefix_trie as P
from shelfwise.llm import repeated_windows as W
from tests.llm.helpers import empty, prose, rows, table

# ── repeated windows ──


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**64 - 1), max_size=200), st.integers(1, 25))
def test_rolling_is_the_polynomial(words, width):
    h, base = np.array(words, np.uint64), W.BASES[0]
    want = [sum(w * pow(base, j, 1 << 64) for j, w in enumerate(words[i : i + width])) % (1 << 64) for i in range(len(words) - width + 1)]
    assert (W.rolling(h, base, width) == W.stir(np.array(want, np.uint64))).all()


def test_rolling_goes_on_over_chunks():
    h = W.word_hashes(b" ".join(b"w%d" % (i % 997) for i in range(150_000)))[:, 0]
    got = W.rolling(h, W.BASES[0])
    assert len(got) == len(h) - 19 and (got[997:] == got[:-997]).all() and len(np.unique(got)) == 997


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**64 - 1), max_size=300), st.integers(0, 9))
def test_sorted_hashes_come_back(values, bits):
    keys = np.unique(np.array(values, np.uint64))
    assert (W.unpack_sorted(W.pack_sorted(keys)) == keys).all()
    runs = list(W._buckets(keys, bits))
    assert sum(z - a for _, a, z in runs) == len(keys) and [b for b, _, _ in runs] == sorted({int(k) >> (64 - bits) for k in keys.tolist()})


@settings(max_examples=60, deadline=None)
@given(st.text("ab \t\n", max_size=80), st.integers(1, 9))
def test_slices_cut_no_word(text, size):
    parts = list(W._slices(text.encode(), size))
    assert b"".join(parts) == text.encode() and [w for p in parts for w in p.split()] == text.encode().split()


def _removed(docs, width):
    """[(doc_id, n_words, spans, kept)] one by one, docs in order."""
    seen, out = set(), []
    for doc, text in docs:
        words = (text or "").encode().split()
        gone = [False] * len(words)
        for i in range(len(words) - width + 1):
            w = tuple(words[i : i + width])
            if w in seen:
                gone[i : i + width] = [True] * width
            seen.add(w)
        edges = [i for i in range(len(words) + 1) if (i > 0 and gone[i - 1]) != (i < len(words) and gone[i])]
        out.append((doc, len(words), sum(gone), tuple(zip(edges[::2], edges[1::2], strict=True)), b" ".join(w for w, g in zip(words, gone, strict=True) if not g).decode()))
    return out


def _passages(n=90, seed=5):
    """Documents with passages of 5 to 60 words in common, repeated lines, copies, and the awkward rows."""
    rng = random.Random(seed)
    shared = [prose(rng, k) for k in (5, 19, 20, 21, 33, 60)]
    out = []
    for i in range(n):
        parts = [prose(rng, rng.randint(0, 50)) for _ in range(3)]
        for _ in range(rng.randint(0, 3)):
            parts.insert(rng.randint(0, len(parts)), rng.choice(shared))
        out.append((1000 - i, "\n ".join(parts)))
    return out + [(2000 + i, t) for i, t in [*enumerate(t for _, t in out[:9]), (50, "line of words " * 30), (51, "abc " * 100_000)]] + rows()


@pytest.mark.parametrize("width, block", [(20, 1 << 20), (20, 3000), (3, 2000)])
def test_repeats_are_removed(spark, width, block):
    docs = table(spark, _passages()).repartition(7)
    got = Counter((r.doc_id, r.n_words, r.n_removed, tuple((s.begin, s.end) for s in r.spans), r.kept) for r in W.remove_repeats(docs, width, block).collect())
    order = docs.select("doc_id", "text").orderBy(F.col("doc_id").asc_nulls_last(), F.xxhash64("text")).collect()
    assert got == Counter(_removed([tuple(r) for r in order], width))


def test_no_text_no_windows(spark):
    assert W.remove_repeats(empty(spark)).count() == 0
    got = {r.doc_id: r for r in W.remove_repeats(table(spark, [(1, None), (2, ""), (3, "a b"), (None, "a b")])).collect()}
    assert [got[i].kept for i in (1, 2, 3, None)] == ["", "", "a b", "a b"] and not any(r.n_removed for r in got.values())


def test_colliding_hashes_part():
    """Keys with the same first hash and another second one are not the same window."""
    first, second = np.array([5, 5, 9], np.uint64), np.array([1, 2, 3], np.uint64)
    batch = W._binary([(0, b, W.pack_sorted(first[s]), second[s].tobytes()) for b, s in ((1, slice(0, 1)), (2, slice(1, 3)), (3, slice(0, 3)))], W._SENT_NAMES, W._SENT_TYPES)
    (out,) = W._count("earlier")([batch])
    bits = {r["block"]: np.unpackbits(np.frombuffer(r["bits"], np.uint8)).tolist()[:3] for r in out.to_pylist()}
    assert bits == {3: [1, 1, 1]}


# ── prefix trie ──

TALK = "conv_id long, turn long, role string, text string, n_convs long, digest string, owner int, turns int"


def _talk(seed=3, n=260):
    rng = random.Random(seed)
    out = []
    for c in [*range(n), 1000, 1003, 1099, 10**12, -7, -100]:
        turns = [(rng.choice(["user", "bot", None]), rng.choice(["hi", "ok", "", None, "längere Zeile", f"t{rng.randint(0, 4)}"])) for _ in range(rng.choice([1, 1, 2, 3, 6, 9]))]
        out += [(c, t if rng.random() < 0.95 else None, *x) for t, x in enumerate(turns)]
    out += [(7, 0, "user", "hi"), (7, 0, "user", "hi"), (None, 0, "user", "lost"), (None, None, None, None), (8, None, None, None), (301, 5, "user", "only me")]
    out += [(400, t, "user", f"turn {t % 3}" * 50) for t in range(700)]
    return out


def _nodes(conversations):
    """The contract one by one, over {conv_id: [(role, text)]} after rebuilding."""
    members, ends = {}, {}
    for c, turns in sorted(conversations.items()):
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
        ends.setdefault(tuple(turns), []).append(c)
    children = Counter(p[:-1] for p in members if p)
    saved, leaves = Counter(), Counter()
    for p, m in members.items():
        for d in range(len(p) + 1):
            saved[p[:d]] += (len(m) - 1) * len(p[-1][1]) if p else 0
            leaves[p[:d]] += not children[p]
    sha = lambda p: hashlib.sha256(",".join(map(str, ends.get(p, []))).encode()).hexdigest()
    return Counter((m[0], len(p), members[p[:-1]][0] if p else None, len(m), children[p], leaves[p], saved[p], sha(p)) for p, m in members.items())


def _rebuilt(talk):
    own = {}
    for c, t, role, text in talk:
        if c is not None:
            own.setdefault(c, []).append((t is not None, t or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(v)] for c, v in own.items()}
    out = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        out[c] = own.get(c - int(np.fmod(c, 100)), [])[:h] + v[h:]
    return out


COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


@pytest.mark.parametrize("parts", [1, 6])
def test_prefix_trie(spark, parts):
    talk = _talk()
    df = spark.createDataFrame([(*r, 1, "d", 2, 3) for r in talk], TALK).repartition(parts)
    got = P.prefix_trie(P.rebuilt(P.turn_lists(df)), 10**7 if parts > 1 else 0).select(*COLUMNS).collect()
    assert Counter(map(tuple, got)) == _nodes(_rebuilt(talk))


def test_trie_of_copies_and_of_nothing(spark):
    talk = [(100 * c, t, "user", f"same {t}") for c in range(9000) for t in range(2)]
    df = spark.createDataFrame([(*r, 1, "d", 2, 3) for r in talk], TALK)
    got = P.prefix_trie(P.rebuilt(P.turn_lists(df))).select(*COLUMNS).collect()
    assert Counter(map(tuple, got)) == _nodes(_rebuilt(talk))
    assert P.prefix_trie(P.rebuilt(P.turn_lists(df.where("conv_id is null")))).count() == 0


@settings(max_examples=40, deadline=None)
@given(st.sets(st.tuples(st.integers(0, 2**64 - 1), st.integers(0, 3)), max_size=400))
def test_slots_are_minimal_and_verified(keys):
    keys = np.array(sorted(keys), np.uint64).reshape(-1, 2)
    table_ = P.SlotTable(keys)
    assert sorted(table_.slots(keys).tolist()) == list(range(len(keys)))
    with pytest.raises(ValueError, match="no slot"):
        table_.slots(np.array([[1, 99]], np.uint64))


# ── fill in the middle ──


@settings(max_examples=80, deadline=None)
@given(st.text("aé日\U0001f600 \n", max_size=90), st.sampled_from([None, r"\S+\s*", r"(?s)..", r"\n"]), st.sampled_from([1, 3, 8, 64]))
def test_cuts_lie_where_units_end(text, unit, block):
    pattern = re.compile(unit) if unit else None
    index = M.CutIndex(text, pattern, block)
    ends = [0, *(m.end() for m in (pattern or re.compile("(?s).")).finditer(text))]
    assert index.n == len(ends) - 1
    for k, chars in enumerate(ends):
        assert index.after(k) == (len(text[:chars].encode()), chars)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 4), max_size=70))
def test_fenwick(counts):
    tree = M.Fenwick(np.array(counts, np.int64))
    assert [tree.before(i) for i in range(len(counts) + 1)] == [sum(counts[:i]) for i in range(len(counts) + 1)]
    for k in range(1, sum(counts) + 1):
        block, passed = tree.descend(k)
        assert passed == sum(counts[:block]) < k <= passed + counts[block]


def _filled(doc, text):
    h = [int(hashlib.sha256(f"1:{'' if doc is None else doc}".encode()).hexdigest()[i : i + 8], 16) for i in (0, 8, 16, 24)]
    a, z = sorted((h[0] % (len(text) + 1), h[1] % (len(text) + 1)))
    if not text or re.search("<[PSM]>", text) or h[2] % 100 >= 90:
        return len(text), "plain", None, None, text
    p, m, s = text[:a], text[a:z], text[z:]
    form = "spm" if h[3] % 100 < 20 else "psm"
    return len(text), form, a, z - a, f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}"


def test_fill_middle(spark):
    extra = [(900 + i, t) for i, t in enumerate(["<P>", "x<S", "<<S><M>", "a<M>b", "<P <S <M", "<", ">", "S>x<P", "é" * 3000, "日本\n" * 100_000])]
    extra += [(2000 + i, "<P<S<M>"[: i % 7] + "x" * (i % 5)) for i in range(60)]
    docs = rows() + extra
    cut = M.fill_middle(table(spark, docs))
    got = cut.withColumn("back", M.restored(F.col("form"), F.col("output"))).collect()
    assert Counter(map(tuple, got)) == Counter((i, *_filled(i, t or ""), t or "") for i, t in docs)
    assert {r.form for r in got} == {"plain", "psm", "spm"} and M.fill_middle(empty(spark)).count() == 0


def test_fill_middle_by_words(spark):
    """Word by word, no piece begins or ends inside a word."""
    docs = rows()
    texts = {t or "" for _, t in docs}
    for r in M.fill_middle(table(spark, docs), unit=r"\S+\s*").where("form <> 'plain'").collect():
        p, s, m = re.fullmatch(r"(?s)<P>(.*)<S>(.*)<M>(.*)", r.output).groups() if r.form == "psm" else [re.fullmatch(r"(?s)<S>(.*)<P>(.*)<M>(.*)", r.output)[i] for i in (2, 1, 3)]
        text = p + m + s
        assert text in texts and len(p) == r.prefix_chars and len(m) == r.middle_chars and r.n == len(re.findall(r"\S+", text))
        assert all(not x or not y or x[-1].isspace() or y[0].isspace() for x, y in ((p, m), (p + m, s), (p, m + s)))
