"""LM scoring: a Katz back-off model of n-grams (``ORDER``, trigrams) with Good-Turing discounts, counted and looked up in
tables that are partitioned by hash.

P(w | h) is discount(c(h,w)) * c(h,w) / c(h) for n-grams seen in training, else weight(h) * P(w | h without its first
word), down to P(w), which falls back to the mass of unknown words; a history never seen has weight 1. The back-off weight
of a history is (1 - discounted mass of its followers) / (1 - their mass in the order below), summed over all of its
followers, so every distribution sums to one exactly. Counts up to ``K`` get Good-Turing discounts (from smoothed counts of
counts where the plain ones give none in (0, 1), as copied texts cause); counts above K lose half a count, so that no
history is left without back-off mass. Each document starts after end marks.

How it runs, so that neither a frequent word nor the number of distinct n-grams burdens one task:

1. Each task deals the rows it reads, as they come, to groups of about ``GROUP_BYTES`` of text. A group's words are hashed
   once; its state (distinct word hashes, the tokens as numbers, ids and sizes of documents) is staged.
2. A group sends each of its distinct n-grams once, with its own training count, as sorted 64-bit hashes in one block for
   each bucket of the hash range that they touch. There are as many buckets as groups, so a bucket gets about what a group
   sends. Blocks never outnumber the n-grams in them: what moves is linear in the input at any size. It moves in
   ``PASSES`` turns.
3. A bucket adds up, and answers each group in the group's own order of keys (staged); where ``tables`` names a folder, it
   also writes its part of the count table: keys and totals, for ``look_up`` to read later. For each n-gram one group is
   named that speaks for it.
4. Groups sum, over the n-grams they speak for, mass and mass below by history, and ask for the weights of the histories
   that they must back off from; buckets add up and answer (staged).
5. Groups evaluate the recursion for their distinct n-grams, order by order, and add up over tokens.

Defined cases: null or empty text is the end mark alone; a very long text is a group of its own; a null doc_id is a
training document (remainder unknown); repeated rows, and rows that tie, count as often as they are there; without
training documents all scores are those of one unknown class (0); an empty table gives an empty result. Only doc_id and
text are read, so other columns may have any name.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfwise.llm.common import hashes, partitions_for, read, scratch, settle, staged, stir

ORDER = 3
K = 5
GROUP_BYTES = 5 << 20
#: Bytes of text whose states one bucket of the table of states holds about.
STATE_BYTES = 256 << 20
#: Parts of the hash range that go through one after the other, so that less lies on disk at a time.
PASSES = 2
END = np.uint64(0x5B1D9F3A7C6E2481)
TOTALS = ["n_tokens", "n_types", *(f"n{c}" for c in range(1, K + 2))]

_BLOCK = "kind int, bucket long, g long, keys binary, counts binary"
_STATE = "g long, docs array<long>, held array<boolean>, sizes array<long>, words binary, stream binary"


def _planes(x: np.ndarray) -> bytes:
    """Bytes by place value: the high ones are mostly zero and compress away."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T).tobytes()


def _from_planes(raw: bytes, dtype) -> np.ndarray:
    width = np.dtype(dtype).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(width, -1).T).view(dtype).ravel()


def _pack_keys(keys: np.ndarray) -> bytes:
    return _planes(np.diff(keys, prepend=np.uint64(0)))


def _unpack_keys(raw: bytes) -> np.ndarray:
    return np.cumsum(_from_planes(raw, np.uint64), dtype=np.uint64)


def _mix(history: np.ndarray, word: np.ndarray) -> np.ndarray:
    return stir(stir(history) + np.uint64(0x9E3779B97F4A7C15) + word)


def pads(order: int) -> list[np.ndarray]:
    """Keys of the histories of 1, 2, ... end marks."""
    out = [np.array([END])]
    while len(out) < order:
        out.append(_mix(out[-1], np.array([END])))
    return out


def _words_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct word hashes of the texts, the end mark's among them, the tokens as numbers of these, and the number of
    each text's tokens. Arrow's ASCII white space is that of ``common.words``, and its ``ascii_lower`` touches A-Z alone."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts.cast(pa.large_string()).fill_null("")))
    flat, ends = lists.flatten(), np.cumsum(pc.list_value_length(lists).to_numpy())
    there = pc.greater(pc.binary_length(flat), 0)
    n = np.diff(np.append(0, np.cumsum(there.to_numpy(zero_copy_only=False)))[ends], prepend=0)  # white space at either end gives empty words
    coded = flat.filter(there).dictionary_encode()
    distinct = coded.dictionary.cast(pa.large_binary()).to_numpy(zero_copy_only=False).tolist()
    words, _, number = _distinct(np.append(hashes(distinct), END))
    stream = np.full(int(n.sum()) + len(n), number[-1])
    stream[np.arange(int(n.sum())) + np.repeat(np.arange(len(n)), n)] = number[coded.indices.to_numpy()]
    return words, stream, n + 1


def _deal(group_bytes: int):
    """Rows (doc_id, text, held_out) to the states of groups."""

    def run(batches):
        part, no, parts, size = TaskContext.get().partitionId(), 0, [], 0

        def flush():
            t = pa.Table.from_batches(parts)
            words, stream, sizes = _words_of(pa.concat_arrays([c.cast(pa.large_string()) for c in t.column("text").chunks]))
            row = [part << 32 | no, t.column("doc_id").to_pylist(), t.column("held_out").to_pylist(), sizes.tolist(), _pack_keys(words), _planes(stream.astype(np.uint32))]
            types = (pa.int64(), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.list_(pa.int64()), pa.binary(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types, strict=True)], names=["g", "docs", "held", "sizes", "words", "stream"])

        for b in batches:
            ends = np.cumsum(pc.fill_null(pc.utf8_length(b.column("text")), 0).to_numpy().astype(np.int64) + 1)
            a = before = 0
            while a < len(b):
                z = int(np.searchsorted(ends, before + group_bytes - size)) + 1  # the row that fills the group
                parts.append(b.slice(a, z - a))
                if z > len(b):
                    size += int(ends[-1]) - before
                    break
                yield flush()
                no, parts, size, a, before = no + 1, [], 0, z, int(ends[z - 1])
        if parts:
            yield flush()

    return run


def _ranked(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of hashes in ascending order, the hashes in that order, and where a new one begins. Sorting numbers is far cheaper than sorting places by number, so the upper bits of a hash and its
    place are sorted as one number; where hashes differ in lower bits alone, places are sorted after all."""
    low = np.uint64((1 << len(keys).bit_length()) - 1)
    order = (np.sort((keys & ~low) | np.arange(len(keys), dtype=np.uint64)) & low).astype(np.int64)
    ranked = keys[order]
    if (ranked[1:] < ranked[:-1]).any():
        order = np.argsort(keys)
        ranked = keys[order]
    new = np.ones(len(keys), bool)
    np.not_equal(ranked[1:], ranked[:-1], out=new[1:])
    return order, ranked, new


def _distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct hashes, a place where each stands (any one), and the number of each place's hash: ``np.unique`` with
    index and inverse."""
    order, ranked, new = _ranked(keys)
    back = np.empty(len(keys), np.int64)
    back[order] = np.cumsum(new) - 1
    return ranked[new], order[new], back


def _begin(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A state's distinct words, its tokens as numbers of these, and where its documents begin and their sizes."""
    sizes = np.array(row["sizes"], np.int64)
    return _unpack_keys(row["words"]), _from_planes(row["stream"], np.uint32).astype(np.int64), np.cumsum(sizes) - sizes, sizes


def _grams(stream: np.ndarray, starts: np.ndarray, order: int):
    """Keys of the n-grams that end in each token, from two words on."""
    gram, pad = stream, pads(order)
    for k in range(1, order):
        before = np.concatenate([pad[k - 1], gram[:-1]])
        before[starts] = pad[k - 1]
        gram = _mix(before, stream)
        yield k, gram


class Group:
    """A group's tokens and, for each order, its sorted distinct n-grams: ``keys``, the number of each token's n-gram (``at``;
    that of the longest only where ``whole``), of its history one order below (``history``; -1: end marks alone) and of what is left of it
    without the first word (``lower``)."""

    def __init__(self, row: dict, order: int, whole: bool = True):
        self.g, self.docs, self.held = row["g"], row["docs"], np.array(row["held"], bool)
        words, word, self.starts, self.sizes = _begin(row)
        stream = words[word]
        self.keys, self.at, self.history, self.lower = [words], [word], [None], [None]
        begins = np.zeros(len(stream), bool)
        begins[self.starts] = True
        for k, gram in _grams(stream, self.starts, order):
            if whole or k < order - 1:
                keys, some, at = _distinct(gram)
            else:
                places, ranked, new = _ranked(gram)
                keys, some, at = ranked[new], places[new], None
            history = np.where(begins[some], -1, self.at[-1][some - 1])  # an n-gram has the same history wherever it stands
            self.lower.append(self.at[-1][some])
            self.keys.append(keys), self.at.append(at), self.history.append(history)


def _of_turn(keys: np.ndarray, buckets: int, turn: int) -> np.ndarray:
    """Which keys lie in the buckets of this turn."""
    if buckets == 1:
        return np.full(len(keys), turn == 0)
    at = keys >> np.uint64(64 - (buckets.bit_length() - 1))
    first, end = (-(-t * buckets // PASSES) for t in (turn, turn + 1))
    return (at >= first) & (at < end)


def _own_counts(row: dict, order: int, buckets: int, turn: int):
    """For each order the group's sorted distinct n-grams of this turn, and how often each stands in training documents."""
    words, word, starts, sizes = _begin(row)
    train = np.repeat(~np.array(row["held"], bool), sizes)
    yield 0, words, np.bincount(word[train], minlength=len(words)).astype(np.uint32)
    for k, gram in _grams(words[word], starts, order):
        mine = _of_turn(gram, buckets, turn)
        places, ranked, new = _ranked(gram[mine])
        counts = np.add.reduceat(train[mine][places], np.flatnonzero(new), dtype=np.int64) if len(places) else np.empty(0, np.int64)
        yield k, ranked[new], counts.astype(np.uint32)


def _slices(keys: np.ndarray, buckets: int, turn: int):
    """(bucket, slice) for each bucket of this turn that sorted keys touch; buckets are equal parts of the hash range."""
    bits = np.uint64(64 - (buckets.bit_length() - 1))
    at = (keys >> bits).astype(np.int64) if buckets > 1 else np.zeros(len(keys), np.int64)
    if len(at):
        edges = [0, *(np.flatnonzero(np.diff(at)) + 1).tolist(), len(at)]
        for a, z in zip(edges, edges[1:], strict=False):
            if at[a] * PASSES // buckets == turn:
                yield int(at[a]), slice(a, z)


def _blocks(rows: list[tuple]) -> pa.RecordBatch:
    types = (pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 5, types, strict=True)], names=["kind", "bucket", "g", "keys", "counts"])


def _send(buckets: int, order: int, turn: int):
    def run(batches):
        for b in batches:
            for row in b.to_pylist():
                yield _blocks([(k, at, row["g"], _pack_keys(keys[s]), _planes(counts[s])) for k, keys, counts in _own_counts(row, order, buckets, turn) for at, s in _slices(keys, buckets, turn)])

    return run


_COUNTED = "kind int, bucket long, g long, keys binary, counts binary, speaks binary, " + ", ".join(f"{c} long" for c in TOTALS)


def _count(keep: bool):
    """All blocks of one bucket: a row of its own (g is null) with counts of counts and, if they are to be kept, its keys and
    totals; and for each group the total counts of the group's keys and whether it speaks for the key."""
    return lambda table: _counted(table, keep)


def _counted(table: pa.Table, keep: bool) -> pa.Table:
    kind, bucket = table.column("kind")[0].as_py(), table.column("bucket")[0].as_py()
    rows = sorted(zip(*(table.column(c).to_pylist() for c in ("g", "keys", "counts")), strict=True))
    keys = [_unpack_keys(k) for _, k, _ in rows]
    every, some, back = _distinct(np.concatenate(keys))
    total = np.bincount(back, np.concatenate([_from_planes(c, np.uint32) for *_, c in rows]), len(every)).astype(np.uint32)
    speaks = np.zeros(len(back), bool)
    speaks[some] = True
    seen = total[total > 0]
    stats = [int(seen.sum(dtype=np.int64)), len(seen), *(int((seen == c).sum()) for c in range(1, K + 2))]
    out, at = [[kind, bucket, None, _pack_keys(every[total > 0]) if keep else None, _planes(seen) if keep else None, None, *stats]], 0
    for (g, *_), k in zip(rows, keys, strict=True):
        part = slice(at, at := at + len(k))
        out.append([kind, bucket, g, None, _planes(total[back[part]]), np.packbits(speaks[part]).tobytes(), *[0] * len(TOTALS)])
    types = [pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()] + [pa.int64()] * len(TOTALS)
    return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=["kind", "bucket", "g", "keys", "counts", "speaks", *TOTALS])


def _good_turing(n: np.ndarray) -> np.ndarray | None:
    """Katz's discounts of counts 1..K from the numbers n[1..K+1] of types with each count; None unless all lie in (0, 1)."""
    c = np.arange(1, K + 1)
    if not (n[1:] > 0).all():
        return None
    a = (K + 1) * n[K + 1] / n[1]
    d = ((c + 1) * n[c + 1] / (c * n[c]) - a) / (1 - a) if a < 1 else np.zeros(K)
    return d if ((d > 0) & (d < 1)).all() else None


def discounts(totals: dict[str, int]) -> np.ndarray:
    """What is left of counts 0..K, as a share: Good-Turing from the counts of counts as they are, else from those
    smoothed log-linearly, else an absolute discount."""
    n = np.array([0.0, *(totals[f"n{c}"] for c in range(1, K + 2))])
    c = np.arange(1, K + 2)
    d = _good_turing(n)
    if d is None and (n[1:] > 0).sum() > 1:
        there = c[n[1:] > 0]
        slope, level = np.polyfit(np.log(there), np.log(n[there]), 1)
        d = _good_turing(np.concatenate([[0], np.exp(level + slope * np.log(c))]))
    if d is None:
        d = 1 - 0.5 / c[:K]
    return np.concatenate([[0], d])


def discounted(counts: np.ndarray, d: np.ndarray) -> np.ndarray:
    c = counts.astype(float)
    return np.where(counts <= K, d[np.minimum(counts, K)] * c, c - 0.5)


class Model:
    """What a group knows once its counts are back: for each order total counts, counts of histories, and the probability
    of the n-grams seen in training."""

    def __init__(self, group: Group, answers: list[tuple], totals: list[dict], unknown: float):
        self.group, self.n, self.v = group, totals[0]["n_tokens"], totals[0]["n_types"]
        self.total, self.speaks, self.of_history, self.seen = [], [], [], []
        for k in range(len(group.keys)):
            rows = sorted(r[1:] for r in answers if r[0] == k)
            total = np.concatenate([_from_planes(c, np.uint32) for _, c, _ in rows])
            self.total.append(total)
            self.speaks.append(np.concatenate([np.unpackbits(np.frombuffer(s, np.uint8), count=len(c) // 4).astype(bool) for _, c, s in rows]))
            # One end mark a training document stands before its first token
            of = np.full(len(total), self.n) if not k else np.where(group.history[k] < 0, totals[0]["n_docs"], self.total[k - 1][group.history[k]])
            self.of_history.append(of)
            left = discounted(total, discounts(totals[k])) / np.maximum(of, 1)
            self.seen.append(np.where(total > 0, left, 0.0 if k else unknown))

    def backed_off(self, k: int) -> np.ndarray:
        """Which n-grams of an order were not seen in training though their history was."""
        return (self.total[k] == 0) & (self.of_history[k] > 0)

    def history_keys(self, k: int, numbers: np.ndarray) -> np.ndarray:
        """Keys of histories by their numbers; -1 is the end marks'."""
        return np.where(numbers < 0, pads(k)[k - 1], self.group.keys[k - 1][numbers])


def _by_key(keys: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    order = np.argsort(keys, kind="stable")  # quick, as keys of histories in the order of their numbers are nearly sorted
    return tuple(x[order] for x in (keys, *values))


def _numbers(history: np.ndarray) -> np.ndarray:
    """Distinct numbers of histories, from -1 on."""
    return np.flatnonzero(np.bincount(history + 1)) - 1


def _model(state: pa.Table, answers: pa.Table, totals: list[dict], unknown: float, whole: bool) -> Model:
    rows = list(zip(*(answers.column(c).to_pylist() for c in ("kind", "bucket", "counts", "speaks")), strict=True))
    return Model(Group(state.to_pylist()[0], len(totals), whole), [r for r in rows if r[2] is not None], totals, unknown)


def _sum_histories(totals: list[dict], unknown: float, buckets: int, turn: int):
    """For each order above the first, kind is 2 * order where histories come with mass and mass below, and 2 * order + 1
    where the weights of histories are asked for."""

    def run(state: pa.Table, answers: pa.Table) -> pa.Table:
        m = _model(state, answers, totals, unknown, False)
        out = []
        for k in range(1, len(totals)):
            turns = _of_turn(m.history_keys(k, np.arange(-1, len(m.group.keys[k - 1]))), buckets, turn)[m.group.history[k] + 1]
            mine = np.flatnonzero(m.speaks[k] & (m.total[k] > 0) & turns)
            of = m.group.history[k][mine] + 1
            there = np.flatnonzero(np.bincount(of))
            mass = np.bincount(of, m.seen[k][mine])[there]
            below = np.bincount(of, m.seen[k - 1][m.group.lower[k][mine]])[there]
            keys, mass, below = _by_key(m.history_keys(k, there - 1), mass, below)
            asked = np.sort(m.history_keys(k, _numbers(m.group.history[k][m.backed_off(k) & turns])))
            out += [(2 * k, b, m.group.g, _pack_keys(keys[s]), _planes(mass[s]) + _planes(below[s])) for b, s in _slices(keys, buckets, turn)]
            out += [(2 * k + 1, b, m.group.g, _pack_keys(asked[s]), b"") for b, s in _slices(asked, buckets, turn)]
        return pa.Table.from_batches([_blocks(out)])

    return run


def _answer_histories(table: pa.Table) -> pa.Table:
    """All blocks of one order and bucket: for each group the weights of the histories it asked for."""
    order, bucket = table.column("kind")[0].as_py() // 2, table.column("bucket")[0].as_py()
    rows = sorted(zip(*(table.column(c).to_pylist() for c in ("kind", "g", "keys", "counts")), strict=True))
    told = [(_unpack_keys(k), c) for kind, _, k, c in rows if kind % 2 == 0]
    every, _, back = _distinct(np.concatenate([k for k, _ in told] or [np.empty(0, np.uint64)]))
    sums = [np.zeros(len(every))] * 2
    if told:
        sums = [np.bincount(back, np.concatenate([_from_planes(c[i * len(c) // 2 : (i + 1) * len(c) // 2], np.float64) for _, c in told]), len(every)) for i in (0, 1)]
    weight = (1 - sums[0]) / np.maximum(1 - sums[1], 1e-12)
    out = []
    for kind, g, k, _ in rows:
        if kind % 2:
            # A history that was seen in training has followers there, so it is in the table
            out.append((order, bucket, g, _planes(weight[np.searchsorted(every, _unpack_keys(k))])))
    types = (pa.int32(), pa.int64(), pa.int64(), pa.binary())
    return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [[]] * 4, types, strict=True)], names=["kind", "bucket", "g", "weights"])


def _score(totals: list[dict], unknown: float):
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])

    def run(state: pa.Table, answers: pa.Table) -> pa.Table:
        m = _model(state, answers, totals, unknown, True)
        rows = list(zip(*(answers.column(c).to_pylist() for c in ("kind", "bucket", "weights")), strict=True))
        p = m.seen[0]
        for k in range(1, len(totals)):
            off = m.backed_off(k)
            numbers = _numbers(m.group.history[k][off])
            # Answers come in the order of keys
            order = np.argsort(m.history_keys(k, numbers), kind="stable")
            found = np.concatenate([_from_planes(w, np.float64) for _, w in sorted(r[1:] for r in rows if r[0] == k and r[2] is not None)] or [np.empty(0)])
            weight = np.empty(len(numbers))
            weight[order] = found
            of = np.ones(len(off))
            place = np.zeros(len(m.group.keys[k - 1]) + 1, np.int64)
            place[numbers + 1] = np.arange(len(numbers))
            of[off] = weight[place[m.group.history[k][off] + 1]]
            p = np.where(m.total[k] > 0, m.seen[k], of * p[m.group.lower[k]])
        group = m.group
        add = lambda x: np.add.reduceat(x, group.starts)
        score = add(np.log10(np.maximum(p, 1e-300))[group.at[-1]])
        base = add(np.log10((m.total[0] + 1.0) / (m.n + m.v + 1.0))[group.at[0]])
        known = add((m.total[0] > 0).astype(np.int64)[group.at[0]])
        n = len(group.docs)
        return pa.Table.from_arrays(
            [pa.array(group.docs, pa.int64()), pa.array(group.held), pa.array(group.sizes), pa.array(known), pa.array(np.full(n, m.n, np.int64)), pa.array(base), pa.array(score)],
            schema=schema,
        )

    return run


def look_up(tables: DataFrame, grams: DataFrame) -> DataFrame:
    """gram, count for the n-grams (arrays of lower-case words, null for the end mark) of ``grams``, by the count tables that
    ``scored`` wrote."""

    def entries(batches):
        for b in batches:
            for kind, keys, counts in zip(*(b.column(c).to_pylist() for c in ("kind", "keys", "counts")), strict=True):
                k = _unpack_keys(keys)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(k), kind, np.int32)), pa.array(k.view(np.int64)), pa.array(_from_planes(counts, np.uint32).astype(np.int64))], names=["kind", "key", "count"])

    def keyed(batches):
        for b in batches:
            found = []
            for gram in b.column("gram").to_pylist():
                hs = [np.array([END]) if w is None else hashes([w.encode()]) for w in gram]
                key = hs[0]
                for h in hs[1:]:
                    key = _mix(key, h)
                found.append((len(gram) - 1, int(key.view(np.int64)[0])))
            yield pa.RecordBatch.from_arrays([b.column("gram"), *(pa.array(c, t) for c, t in zip(zip(*found, strict=True) if found else [[], []], (pa.int32(), pa.int64()), strict=True))], names=["gram", "of_kind", "of_key"])

    asked = grams.select("gram").mapInArrow(keyed, "gram array<string>, of_kind int, of_key long")
    there = tables.mapInArrow(entries, "kind int, key long, count long")
    return asked.join(there, (F.col("kind") == F.col("of_kind")) & (F.col("key") == F.col("of_key")), "left").select("gram", F.coalesce("count", F.lit(0)).alias("count"))


def scored(docs: DataFrame, order: int = ORDER, tables: str | None = None) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for each row of docs. The count tables are
    written below ``tables`` if it is given, partitioned by order."""
    slim = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("text").cast("string").alias("text"),
        F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2, F.lit(False)).alias("held_out"),
    )
    spark = docs.sparkSession
    size = slim.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    buckets = 1 << (size // GROUP_BYTES).bit_length()
    # Bucketed by group, so that states stay where they are and only answers move to them
    name = f"states_{uuid.uuid4().hex}"
    n = partitions_for(spark, size // STATE_BYTES)
    dealt = slim.mapInArrow(_deal(GROUP_BYTES), _STATE)
    dealt.write.bucketBy(n, "g").option("path", scratch(spark, name)).option("compression", "zstd").saveAsTable(name)
    try:
        return _scored(spark.table(name), buckets, order, tables)
    finally:
        spark.sql(f"DROP TABLE {name}")


def _scored(state: DataFrame, buckets: int, order: int, tables: str | None) -> DataFrame:
    def in_turns(step):
        """The staged results of all turns."""
        parts = [step(turn) for turn in range(min(PASSES, buckets))]
        out = parts[0]
        for part in parts[1:]:
            out = out.unionByName(part)
        return out

    counts = in_turns(lambda turn: staged(state.mapInArrow(_send(buckets, order, turn), _BLOCK).groupBy("kind", "bucket").applyInArrow(_count(tables is not None), _COUNTED), "op7-counts"))
    if tables is not None:
        counts.where("g is null").select("kind", "bucket", "keys", "counts").write.partitionBy("kind").parquet(tables)
    sums = {r["kind"]: r.asDict() for r in counts.where("g is null").groupBy("kind").agg(*(F.sum(c).alias(c) for c in TOTALS)).collect()}
    totals = [{c: int(sums.get(k, {}).get(c) or 0) for c in TOTALS} for k in range(order)]
    one = totals[0]
    one["n_docs"] = int(state.select(F.explode("held").alias("h")).where("not h").count())
    # What the discounts leave to unknown words: counts up to K by their numbers, each type above gives half a count
    d = discounts(one)
    low = sum(one[f"n{c}"] for c in range(1, K + 1))
    taken = sum((1 - d[c]) * c * one[f"n{c}"] for c in range(1, K + 1)) + 0.5 * (one["n_types"] - low)
    unknown = taken / one["n_tokens"] if one["n_tokens"] else 1.0
    answers = counts.where("g is not null").select("kind", "bucket", "g", "counts", "speaks")
    by_g = state.groupBy("g")
    by_answers = answers.groupBy("g")

    def weigh(turn: int) -> DataFrame:
        asked = by_g.cogroup(by_answers).applyInArrow(_sum_histories(totals, unknown, buckets, turn), _BLOCK)
        return staged(asked.groupBy(F.floor(F.col("kind") / 2), "bucket").applyInArrow(_answer_histories, "kind int, bucket long, g long, weights binary"), "op7-weights")

    weights = in_turns(weigh)
    none = F.lit(None).cast("binary")
    both = answers.withColumn("weights", none).unionByName(weights.select("kind", "bucket", "g", none.alias("counts"), none.alias("speaks"), "weights"))
    scores = by_g.cogroup(both.groupBy("g")).applyInArrow(
        _score(totals, unknown), "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    )
    return staged(scores, "op7-scores")


def op7_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    settle(spark)
    return scored(read(spark, sf_dir, "documents"))
