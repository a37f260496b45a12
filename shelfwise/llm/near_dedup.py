"""Near-duplicates by a chosen-path set similarity join over minwise tokens.

1. A document's set is its distinct n-word shingles. Documents with equal sets form a class; classes are what is joined.
2. A class is summarised by ``WIDTH`` minwise tokens. Each of ``ROOTS`` independent trees hangs a class under the node that
   its token at one position names; two classes of similarity s share such a node with probability s.
3. Nodes of up to ``SMALL`` classes are compared exhaustively. In larger ones every class is compared with a few leaders of
   the node and paired with those most like it: that gathers groups of near copies at linear cost. Comparing estimates the
   similarity from the tokens and drops pairs so far below the limit that a true link would be a one-in-a-million event;
   links are then confirmed on the full sets, each class's best pair first, then pairs that still lie between components.
4. Every node above SMALL is then searched for what lies between components. A node of more than ``LARGE`` classes branches:
   its own hash chooses ``BRANCH`` positions, and each token found there names a child. What two sets share they share in
   the children too, so similar classes stay together while unlike ones part. Nodes of up to LARGE classes, and those that
   branching no longer makes smaller, are compared exhaustively: classes outside the node's largest component with all of
   its classes, in a grid of salted blocks. A group of near copies is one component by then and costs nothing more. Who
   stands in a likely pair comes again with its whole set, and the block confirms as many links as it takes to join what
   is linked; so rows grow with blocks and classes, never with pairs.
5. Components come from alternating large-star and small-star steps on tables of links.

A link of similarity 0.8 is missed by all trees with probability 0.2^12 (4e-9), and by all children of a node that branches
with 0.2^8 (3e-6); what step 3 does not find of it, step 4 does. tests/llm holds the result against brute force.

Defined cases: null or empty text has an empty set, is linked with nothing and is its own component. A class is known by
its set and never by a doc_id: documents with null doc_id pass on links like any other, and rows that share a doc_id but
not a text are classes of their own. A null doc_id never wins the smallest id; a component without any other has a null
component_id. Repeated rows are all returned, and of rows that tie in the smallest doc_id all count as kept. A very long
text is taken whole. An empty table gives an empty result. Only doc_id and text are read, so other columns may have any
name.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shelfwise.llm.common import WORD, read, settle, shingles, spare_name, staged, stir

WIDTH = 128
ROOTS = 12
SMALL = 24
LEADERS = 24
#: Leaders of a node that a class is paired with: the most similar ones.
NEAREST = 3
#: Larger nodes branch into children by so many positions, as long as children have less than SHRINK of their parent's
#: classes: otherwise comparing the children (the square of each, BRANCH times) costs more than comparing the parent.
LARGE = 8192
BRANCH, SHRINK = 8, 0.35
#: Classes of a large node that one side of a block has, about.
BLOCK = 1024
#: Of WIDTH positions, how many may differ from what the limit lets expect before a pair is dropped (5 deviations).
SIGMAS = 5.0
#: Rows of a large node that are compared with its leaders in one group.
LED = 2048

_A = stir(np.arange(1, WIDTH + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
_B = stir(np.arange(1, WIDTH + 1, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03))


def minwise(shingle_hashes: np.ndarray) -> np.ndarray:
    """The smallest value of each of WIDTH hash functions over a set that is not empty."""
    low = np.full(WIDTH, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingle_hashes), 2048):
        h = shingle_hashes[at : at + 2048, None] * _A + _B
        low = np.minimum(low, (h ^ (h >> np.uint64(32))).min(axis=0))
    return low


def _sign(n: int):
    schema = pa.schema([("doc_id", pa.int64()), ("text_key", pa.binary()), ("n_shingles", pa.int64()), ("set_key", pa.binary()), ("tokens", pa.binary()), ("roots", pa.list_(pa.int64()))])
    tree = stir(np.arange(1, ROOTS + 1, dtype=np.uint64))

    def run(batches):
        for b in batches:
            sizes, keys, tokens, roots = [], [], [], []
            for text in b.column("text").to_pylist():
                s = shingles(text, n)
                sizes.append(len(s))
                if not len(s):
                    keys.append(None), tokens.append(None), roots.append(None)
                    continue
                low = minwise(s)
                keys.append(xxhash.xxh3_128_digest(s.tobytes()))
                tokens.append((stir(low) >> np.uint64(56)).astype(np.uint8).tobytes())
                roots.append(stir(low[:ROOTS] ^ tree).view(np.int64).tolist())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("text_key"), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), pa.array(tokens, pa.binary()), pa.array(roots, pa.list_(pa.int64()))], schema=schema)

    return run, "doc_id long, text_key binary, n_shingles long, set_key binary, tokens binary, roots array<long>"


def _least_equal(limit: float) -> int:
    """How many of WIDTH one-byte tokens a linked pair has in common at least, but for one in a million."""
    p = limit + (1 - limit) / 256
    return int(WIDTH * p - SIGMAS * np.sqrt(WIDTH * p * (1 - p)))


def _compare_nodes(limit: float):
    """Exhaustive comparison of small nodes: rows (ids, tokens) of one node each give pairs."""
    least = _least_equal(limit)

    def run(batches):
        for b in batches:
            left, right, equal = [], [], []
            for ids, tokens in zip(b.column("ids").to_pylist(), b.column("tokens").to_pylist(), strict=True):
                m = np.frombuffer(b"".join(tokens), np.uint8).reshape(len(ids), WIDTH)
                i, j = np.triu_indices(len(ids), 1)
                same = (m[i] == m[j]).sum(axis=1)
                ids = np.array(ids, np.int64)
                a, z = np.minimum(ids[i], ids[j]), np.maximum(ids[i], ids[j])
                fit = (same >= least) & (a != z)
                left.append(a[fit]), right.append(z[fit]), equal.append(same[fit])
            cat = lambda x, t: pa.array(np.concatenate(x) if x else np.empty(0, t), t)
            yield pa.RecordBatch.from_arrays([cat(left, pa.int64()), cat(right, pa.int64()), cat([e.astype(np.int64) for e in equal], pa.int64())], names=["a", "z", "equal"])

    return run


def _compare_leaders(limit: float):
    """Rows (id, tokens, lead_ids, lead_tokens): a class against its node's leaders."""
    least = _least_equal(limit)

    def run(batches):
        for b in batches:
            left, right, equal = [], [], []
            for one, t, ids, tokens in zip(*(b.column(c).to_pylist() for c in ("id", "tokens", "lead_ids", "lead_tokens")), strict=True):
                m = np.frombuffer(b"".join(tokens), np.uint8).reshape(len(ids), WIDTH)
                same = (m == np.frombuffer(t, np.uint8)).sum(axis=1)
                near = sorted(((e, other) for other, e in zip(ids, same.tolist(), strict=True) if e >= least and other != one), reverse=True)
                for e, other in near[:NEAREST]:
                    left.append(min(one, other)), right.append(max(one, other)), equal.append(e)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (left, right, equal)], names=["a", "z", "equal"])

    return run


def _branch(branch: int):
    """Rows (node, id, n, tokens) of large nodes to the rows of their children, with the size of the parent."""
    places = stir(np.arange(1, WIDTH + 1, dtype=np.uint64))

    def run(batches):
        for b in batches:
            node = b.column("node").to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            m = np.frombuffer(b"".join(b.column("tokens").to_pylist()), np.uint8).reshape(len(node), WIDTH)
            draw = stir(node[:, None] ^ places)
            place = np.argpartition(draw, branch, axis=1)[:, :branch]
            row = np.repeat(np.arange(len(node)), branch)
            child = stir(draw[row, place.ravel()] + m[row, place.ravel()].astype(np.uint64)).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(child), *(b.column(c).take(pa.array(row)) for c in ("id", "n"))], names=["node", "id", "parent"])

    return run


def _likely(rows: pa.Table, limit: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row numbers (i, j) and equal tokens of the pairs of a block (is_left, is_minor, id, root, tokens) that may be linked:
    left against right, in different components. One bit of each token rules most pairs out before whole tokens are
    compared."""
    least = _least_equal(limit)
    p = limit + (1 - limit) / 2
    apart = WIDTH - int(WIDTH * p - SIGMAS * np.sqrt(WIDTH * p * (1 - p)))
    ids, roots = (rows.column(c).to_numpy() for c in ("id", "root"))
    is_left, is_minor = (rows.column(c).to_numpy(zero_copy_only=False) for c in ("is_left", "is_minor"))
    tokens = np.frombuffer(b"".join(rows.column("tokens").to_pylist()), np.uint8).reshape(len(ids), WIDTH)
    bits = np.packbits(tokens & 1, axis=1).view(np.uint64)
    x, y = np.nonzero(is_left)[0], np.nonzero(~is_left)[0]
    found = [(np.empty(0, np.int64),) * 3]
    for at in range(0, len(x), 256):
        part = x[at : at + 256]
        far = sum(np.bitwise_count(bits[part, k][:, None] ^ bits[y, k][None, :]) for k in range(bits.shape[1]))
        i, j = np.nonzero(far <= apart)
        i, j = part[i], y[j]
        # Two classes outside the largest component meet on either side
        fit = (roots[i] != roots[j]) & (~is_minor[j] | (ids[i] < ids[j]))
        i, j = i[fit], j[fit]
        e = np.concatenate([(tokens[i[k : k + 4096]] == tokens[j[k : k + 4096]]).sum(axis=1) for k in range(0, len(i), 4096)] or [np.empty(0, np.int64)])
        found.append((i[e >= least], j[e >= least], e[e >= least]))
    return tuple(np.concatenate(c) for c in zip(*found, strict=True))


def _involved(limit: float):
    """Rows of a block (node, x, y) that stand in a likely pair, and only in the first root that the pair shares."""
    schema = pa.schema([("node", pa.int64()), ("x", pa.int64()), ("y", pa.int64()), ("id", pa.int64()), ("is_left", pa.bool_()), ("is_minor", pa.bool_())])

    def run(rows: pa.Table) -> pa.Table:
        i, j, _ = _likely(rows, limit)
        node = rows.column("node")[0].as_py()
        nodes = np.array(rows.column("roots").to_pylist(), np.int64)
        if (nodes == node).any():  # else a child, whose pairs are not ordered by roots
            mine = nodes[i, (nodes[i] == nodes[j]).argmax(axis=1)] == node
            i, j = i[mine], j[mine]
        return rows.take(pa.array(np.unique(np.concatenate([i, j])))).select(schema.names).cast(schema)

    return run


def _verify(limit: float, percent: int):
    """Links (a, z) of a block's rows with their whole sets, likeliest first. A pair that the block's own links have already
    brought together is not looked at again, so there are fewer links than rows."""

    def run(rows: pa.Table) -> pa.Table:
        i, j, e = _likely(rows, limit)
        ids, roots, sets = rows.column("id").to_pylist(), rows.column("root").to_pylist(), [np.frombuffer(x, np.uint64) for x in rows.column("items").to_pylist()]
        up: dict[int, int] = {}

        def top(r: int) -> int:
            while r in up:
                r = up[r]
            return r

        links = []
        for k in np.argsort(-e, kind="stable").tolist():
            p, q = int(i[k]), int(j[k])
            a, z = top(roots[p]), top(roots[q])
            if a == z:
                continue
            n, m = len(sets[p]), len(sets[q])
            if 100 * min(n, m) < percent * max(n, m):
                continue
            both = len(np.intersect1d(sets[p], sets[q], assume_unique=True))
            if 100 * both >= percent * (n + m - both):
                up[max(a, z)] = min(a, z)
                links.append((ids[p], ids[q]))
        return pa.Table.from_arrays([pa.array(c, pa.int64()) for c in (zip(*links, strict=True) if links else ([], []))], names=["a", "z"])

    return run


def involved_in_blocks(rows: DataFrame, limit: float) -> DataFrame:
    """(node, x, y, id, is_left, is_minor): who stands in a likely pair between components, by block of the nodes of ``rows``
    (node, id, root, tokens, roots)."""
    counted = rows.groupBy(F.col("node").alias("at"), "root").agg(F.count(F.lit(1)).alias("c"))
    tops = (
        counted.groupBy("at")
        .agg(F.max(F.struct("c", "root")).alias("top"), F.sum("c").alias("n"))
        .where("top.c < n")
        .select("at", F.col("top.root").alias("top_root"), *(F.ceil(c / F.lit(BLOCK)).cast("long").alias(x) for c, x in ((F.col("n") - F.col("top.c"), "rows_of"), (F.col("n"), "columns_of"))))
    )
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    salt = lambda seed, n: F.pmod(F.xxhash64("id", F.lit(seed)), F.col(n))
    rows = staged(rows.hint("merge").join(staged(tops, "op3-tops"), F.col("node") == F.col("at")).drop("at").withColumn("is_minor", F.col("root") != F.col("top_root")), "op3-apart")
    left = rows.where("is_minor").withColumns({"is_left": F.lit(True), "x": salt(1, "rows_of")}).withColumn("y", every("columns_of"))
    right = rows.withColumns({"is_left": F.lit(False), "y": salt(2, "columns_of")}).withColumn("x", every("rows_of"))
    sides = [df.select("node", "x", "y", "is_left", "is_minor", "id", "root", "tokens", "roots") for df in (left, right)]
    return sides[0].unionByName(sides[1]).groupBy("node", "x", "y").applyInArrow(_involved(limit), "node long, x long, y long, id long, is_left boolean, is_minor boolean")


def _sets(n: int):
    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array([shingles(t, n).tobytes() for t in b.column("text").to_pylist()], pa.binary())], names=["id", "items"])

    return run


def links_apart(large: DataFrame, classes: DataFrame, rooted: DataFrame, texts_of, n: int, percent: int) -> DataFrame:
    """Links (a, z) between different components in the large nodes (node, id, n), enough to join all components that are
    linked there; ``rooted`` has node, root, and ``texts_of`` gives the texts of ids."""
    limit = percent / 100
    of = classes.select("id", "tokens", "roots").join(rooted.select(F.col("node").alias("rooted_id"), "root"), F.col("id") == F.col("rooted_id"), "left")
    of = staged(of.select("id", "tokens", "roots", F.coalesce("root", "id").alias("root")), "op3-rooted")
    rows, parts, level = large.join(of, "id").withColumn("parent", F.lit(None).cast("long")), [], 0
    while True:
        ends = (F.col("n") <= LARGE) | F.coalesce(F.col("n") > SHRINK * F.col("parent"), F.lit(False))
        parts.append(involved_in_blocks(rows.where(ends), limit))
        rows = rows.where(~ends)
        if large.where(F.col("n") > LARGE).isEmpty() if not level else rows.isEmpty():
            break
        # Children of one class alone say nothing
        children = staged(rows.select("node", "id", "n", "tokens").mapInArrow(_branch(BRANCH), "node long, id long, parent long"), f"op3-branch{level}")
        sizes = children.groupBy(F.col("node").alias("sized_node")).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        rows = staged(children.join(staged(sizes, "op3-sizes"), F.col("node") == F.col("sized_node")).drop("sized_node").join(of, "id"), f"op3-children{level}")
        level += 1
    found = parts[0]
    for p in parts[1:]:
        found = found.unionByName(p)
    found = staged(found, "op3-involved")
    sets = staged(texts_of(found.select("id").distinct(), "op3-texts3").mapInArrow(_sets(n), "id long, items binary"), "op3-sets")
    whole = found.join(of.select("id", "root", "tokens"), "id").hint("merge").join(sets, "id")
    return whole.groupBy("node", "x", "y").applyInArrow(_verify(limit, percent), "a long, z long")


def candidate_pairs(classes: DataFrame, limit: float) -> tuple[DataFrame, DataFrame | None]:
    """``classes`` has id, tokens, roots. Staged pairs (a, z, equal) with a < z; no pair twice. And the rows (node, id, n) of
    the large nodes, of which these are not all pairs."""
    tokens = classes.select("id", "tokens")
    rows = classes.select(F.explode("roots").alias("node"), "id")
    # Nodes of one class end here; most do
    sizes = rows.groupBy(F.col("node").alias("sized_node")).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    shared = staged(rows.hint("merge").join(staged(sizes, "op3-sizes"), F.col("node") == F.col("sized_node")).drop("sized_node").join(tokens, "id"), "op3-roots")
    small = (
        shared.where(F.col("n") <= SMALL)
        .groupBy("node")
        .agg(F.collect_list(F.struct("id", "tokens")).alias("rows"))
        .select(F.col("rows.id").alias("ids"), F.col("rows.tokens").alias("tokens"))
    )
    found = small.mapInArrow(_compare_nodes(limit), "a long, z long, equal long")
    large = shared.where(F.col("n") > SMALL)
    some = not large.isEmpty()
    if some:
        # A leader is the class with the smallest hash in one of LEADERS slices of its node. A large node's rows meet them in
        # groups of about LED rows
        groups = F.ceil(F.col("n") / F.lit(LED)).cast("long")
        leaders = (
            large.groupBy(F.col("node").alias("lead_node"), F.pmod(F.xxhash64("id"), F.lit(LEADERS)).alias("slice"))
            .agg(F.min(F.struct(F.xxhash64("id", "node").alias("h"), "id", "tokens")).alias("l"), F.max(groups).alias("groups"))
            .groupBy("lead_node")
            .agg(F.collect_list("l.id").alias("lead_ids"), F.collect_list("l.tokens").alias("lead_tokens"), F.max("groups").alias("groups"))
            .withColumn("lead_group", F.explode(F.sequence(F.lit(0).cast("long"), F.col("groups") - 1)))
        )
        group = F.pmod(F.xxhash64("id", F.lit("group")), groups)
        led = large.withColumn("in_group", group).join(leaders, (F.col("node") == F.col("lead_node")) & (F.col("in_group") == F.col("lead_group"))).select("id", "tokens", "lead_ids", "lead_tokens")
        found = found.unionByName(led.mapInArrow(_compare_leaders(limit), "a long, z long, equal long"))
    pairs = staged(found.groupBy("a", "z").agg(F.max("equal").alias("equal")), "op3-candidates")
    return pairs, large.select("node", "id", "n") if some else None


def _confirm(n: int, percent: int):
    def run(batches):
        for b in batches:
            links = []
            last, last_set = None, None
            for x, y in zip(b.column("text_a").to_pylist(), b.column("text_z").to_pylist(), strict=True):
                if x != last or last_set is None:
                    last, last_set = x, shingles(x, n)
                t = shingles(y, n)
                both = len(np.intersect1d(last_set, t, assume_unique=True))
                links.append(100 * both >= percent * (len(last_set) + len(t) - both))
            keep = pa.array(links, pa.bool_())
            yield pa.RecordBatch.from_arrays([pc.filter(b.column(c), keep) for c in ("a", "z")], names=["a", "z"])

    return run


def confirmed(pairs: DataFrame, texts: DataFrame, n: int, percent: int) -> DataFrame:
    """The pairs (a, z) whose full sets are similar enough; ``texts`` has id, text."""
    # Texts are wide and pairs are many: neither side is one to broadcast, whatever their sizes are estimated at
    left = pairs.select("a", "z").hint("merge").join(texts.select(F.col("id").alias("a"), F.col("text").alias("text_a")), "a")
    both = left.hint("merge").join(texts.select(F.col("id").alias("z"), F.col("text").alias("text_z")), "z").select("a", "z", "text_a", "text_z")
    return both.mapInArrow(_confirm(n, percent), "a long, z long")


def components(links: DataFrame, name: str, rounds: int = 30) -> DataFrame:
    """(node, root) for every node that ``links`` (a, z) names; root is the smallest node reachable."""
    edges = staged(links.select(F.greatest("a", "z").alias("u"), F.least("a", "z").alias("v")).where("u <> v").distinct(), f"{name}-edges")
    before = None
    for i in range(rounds):
        # Large star: every neighbour above a node moves to the node's smallest neighbour
        both = edges.select(F.col("u").alias("x"), F.col("v").alias("y")).unionByName(edges.select(F.col("v").alias("x"), F.col("u").alias("y")))
        least = both.groupBy(F.col("x").alias("c")).agg(F.min("y").alias("y_min")).select("c", F.least("c", "y_min").alias("m"))
        large = both.where("y > x").join(least, F.col("x") == F.col("c")).select(F.col("y").alias("u"), F.col("m").alias("v")).distinct()
        large = staged(large, f"{name}-large{i}")
        # Small star: a node and its smaller neighbours move to the smallest of them
        low = large.groupBy(F.col("u").alias("c")).agg(F.min("v").alias("m"))
        small = (
            large.join(low, F.col("u") == F.col("c"))
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .where("u <> v")
            .unionByName(low.select(F.col("c").alias("u"), F.col("m").alias("v")))
            .distinct()
        )
        edges = staged(small, f"{name}-small{i}")
        # Stars do not change any more: the number of edges, the sum of their ends and the number of hubs stay
        now = edges.agg(F.count(F.lit(1)), F.sum(F.col("u").cast("decimal(38,0)")), F.sum(F.col("v").cast("decimal(38,0)")), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return edges.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("root"))


def text_key(text: Column) -> Column:
    return F.unhex(F.md5(F.coalesce(text.cast("string"), F.lit("")).cast("binary")))


def grouped(docs: DataFrame, n: int, percent: int = 80) -> DataFrame:
    """doc_id, text_key (MD5 of the text), n_shingles, root: one row for each row of docs. Rows of one component have one
    root; it is null where the set is empty."""
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("text_key", text_key(F.col("text")))
    run, schema = _sign(n)
    signed = staged(slim.mapInArrow(run, schema), "op3-signed")
    by_set = signed.where("set_key is not null").groupBy("set_key").agg(
        F.min(F.struct("doc_id", "text_key")).alias("one"), F.min("tokens").alias("tokens"), F.min("roots").alias("roots")
    )
    # Ids are fixed once they are written
    classes = staged(by_set.withColumn("id", F.monotonically_increasing_id()), "op3-classes")
    pairs, large = candidate_pairs(classes.select("id", "tokens", "roots"), percent / 100)

    def texts_of(wanted: DataFrame, name: str) -> DataFrame:
        # Texts of classes, one each: the class's first row
        rows = classes.select("id", F.col("one.doc_id").alias("one_id"), F.col("one.text_key").alias("one_key")).join(wanted, "id")
        same = F.col("doc_id").eqNullSafe(F.col("one_id")) & (F.col("text_key") == F.col("one_key"))
        return staged(slim.join(rows.hint("merge"), same).groupBy("doc_id", "text_key", "id").agg(F.first("text").alias("text")).select("id", "text"), name)

    texts = texts_of(pairs.select(F.explode(F.array("a", "z")).alias("id")).distinct(), "op3-texts")
    best = pairs.groupBy(F.col("z").alias("best_z")).agg(F.max(F.struct("equal", F.col("a"))).alias("b")).select(F.col("b.a").alias("a"), F.col("best_z").alias("z"))
    first = staged(confirmed(best, texts, n, percent), "op3-first")
    rooted = components(first, "op3-c1")
    of = lambda side: rooted.select(F.col("node").alias(side), F.col("root").alias(f"root_{side}"))
    apart = pairs.join(best, ["a", "z"], "left_anti").join(of("a"), "a", "left").join(of("z"), "z", "left").where("coalesce(root_a, a) <> coalesce(root_z, z)")
    second = staged(confirmed(apart, texts, n, percent), "op3-second")
    links = first.unionByName(second)
    if not second.isEmpty():
        rooted = components(links, "op3-c2")
    if large is not None:
        third = staged(links_apart(large, classes, rooted, texts_of, n, percent), "op3-third")
        if not third.isEmpty():
            rooted = components(links.unionByName(third), "op3-c3")
    named = classes.select(F.col("set_key").alias("k"), "id").join(rooted, F.col("id") == F.col("node"), "left").select("k", F.coalesce("root", "id").alias("root"))
    named = staged(named, "op3-named")
    return signed.select("doc_id", "text_key", "n_shingles", "set_key").hint("merge").join(named, F.col("set_key") == F.col("k"), "left").select("doc_id", "text_key", "n_shingles", "root")


def near_duplicates(docs: DataFrame, n: int, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row for each row of docs."""
    rows = staged(grouped(docs, n, percent), "op3-rows")
    least = staged(rows.where("root is not null").groupBy(F.col("root").alias("r")).agg(F.min("doc_id").alias("component_id")), "op3-least")
    out = rows.hint("merge").join(least, F.col("root") == F.col("r"), "left")
    component = F.when(F.col("root").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    settle(spark)
    return near_duplicates(read(spark, sf_dir, "documents"), 4)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage, on five-word shingles: one document of each group stays, the one with the smallest doc_id (null
    last); of rows that tie in it, the one with the smallest MD5 of its text, then the smallest other columns. Unlike texts
    under one doc_id are groups of their own, and documents without words all stay."""
    settle(spark)
    rows = grouped(docs, 5)
    first = rows.where("root is not null").groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "text_key")).alias("w"))
    winners = staged(first.select(F.col("w.doc_id").alias("won_id"), F.col("w.text_key").alias("won_key")), "dedup-winners")
    key, place = spare_name(docs, "text_key"), spare_name(docs, "place")
    keyed = docs.withColumn(key, text_key(F.col("text")))
    mine = F.col("doc_id").cast("long").eqNullSafe(F.col("won_id")) & (F.col(key) == F.col("won_key"))
    # Only rows that are equal in doc_id and text are left to choose from
    others = [F.col(f"`{c}`").cast("string") for c in docs.columns if c not in ("doc_id", "text")]
    again = Window.partitionBy("won_id", "won_key").orderBy(*others, F.lit(0))
    kept = keyed.hint("merge").join(winners, mine).withColumn(place, F.row_number().over(again)).where(F.col(place) == 1)
    wordless = docs.where(~F.coalesce(F.col("text").cast("string").rlike(WORD), F.lit(False)))
    return kept.select(*docs.columns).unionByName(wordless)
