"""Fill-in-middle: documents are cut in three and put in another order, so that a model learns to write what stands between.

A text is a row of units (code points, or what a pattern matches left to right). Its UTF-8 bytes lie in fixed blocks, and
two Fenwick trees hold how many units end, and how many code points start, in each. A cut after k units is found by a
binary-lifting descent of the unit tree to its block, then by a look into that block alone; the code points before the cut
are a prefix sum of the other tree and a count inside the block.

``fill_middle`` draws both cuts and the form from SHA-256 of seed and doc_id, so a lost task repeats the same result:

- plain: the text as it is; for an empty text, one that holds a mark already, and a tenth of the others,
- spm: ``<S>`` suffix ``<P>`` prefix ``<M>`` middle; for a fifth of the rest,
- psm: ``<P>`` prefix ``<S>`` suffix ``<M>`` middle; for the others.

As no cut text holds a mark, and no end of a piece and start of a mark can make one, ``restored`` finds the pieces again.

Defined cases: null text counts as empty and stays plain; a null doc_id is drawn as an empty one; a very long text is a
larger tree; repeated rows and rows that tie in doc_id are each cut by themselves; an empty table gives an empty result.
Only the id and text columns are read, so other columns may have any name. Nothing is shuffled.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfwise.llm.common import read, settle

PREFIX, SUFFIX, MIDDLE = MARKS = ("<P>", "<S>", "<M>")
#: Bytes of a block.
BLOCK = 1024
#: Percent of documents that are cut, and of those the percent that come suffix first.
CUT, SUFFIX_FIRST = 90, 20
#: Bytes of text after which an output batch is handed over.
BATCH = 8 << 20


class Fenwick:
    """Prefix sums over counts that are not negative."""

    def __init__(self, counts: np.ndarray):
        self.size = len(counts)
        self.top = 1 << max(0, self.size.bit_length() - 1)
        # Node i sums the counts of the low(i) blocks up to and with i, which is a difference of plain prefix sums
        upto = np.concatenate(([0], np.cumsum(counts, dtype=np.int64)))
        i = np.arange(1, self.size + 1)
        self.node = np.concatenate(([0], upto[i] - upto[i - (i & -i)])).tolist()

    def before(self, block: int) -> int:
        """The sum of all blocks before ``block``."""
        total = 0
        while block:
            total += self.node[block]
            block &= block - 1
        return total

    def descend(self, k: int) -> tuple[int, int]:
        """The block in which the k-th (from 1) counted thing lies, and how many lie before that block."""
        at, passed, step = 0, 0, self.top
        while step:
            if at + step <= self.size and passed + self.node[at + step] < k:
                at += step
                passed += self.node[at]
            step >>= 1
        return at, passed


class CutIndex:
    """The units of a text: ``n`` of them, and where the first k end. ``unit``: a compiled pattern; None for code points."""

    def __init__(self, text: str, unit: re.Pattern | None = None, block: int = BLOCK):
        self.data = text.encode("utf-8", "surrogatepass")
        self.block = block
        raw = np.frombuffer(self.data, np.uint8)
        self.starts = (raw & 0xC0) != 0x80
        if unit is None:
            self.ends = np.append(self.starts[1:], True) if len(raw) else self.starts
        else:
            ends = np.array([m.end() for m in unit.finditer(text) if m.end() > m.start()], np.int64)
            first = np.append(np.flatnonzero(self.starts), len(raw))  # byte at which a code point starts
            self.ends = np.zeros(len(raw), bool)
            self.ends[first[ends] - 1] = True
        edges = np.arange(0, len(raw), block)
        self.units = Fenwick(np.add.reduceat(self.ends, edges, dtype=np.int64) if len(raw) else np.empty(0, np.int64))
        self.points = Fenwick(np.add.reduceat(self.starts, edges, dtype=np.int64) if len(raw) else np.empty(0, np.int64))
        self.n = self.units.before(self.units.size)

    def after(self, k: int) -> tuple[int, int]:
        """Bytes and code points before the end of the k-th unit; (0, 0) for k = 0."""
        if not k:
            return 0, 0
        block, passed = self.units.descend(k)
        begin = block * self.block
        cut = begin + int(np.flatnonzero(self.ends[begin : begin + self.block])[k - passed - 1]) + 1
        return cut, self.points.before(block) + int(np.count_nonzero(self.starts[begin:cut]))


def draws(doc_id: int | None, seed: int) -> list[int]:
    """Four numbers below 2^32."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return [int.from_bytes(digest[i : i + 4], "big") for i in range(0, 16, 4)]


def rearranged(doc_id: int | None, text: str, seed: int = 1, unit: re.Pattern | None = None) -> tuple[int, str, int | None, int | None, bytes]:
    """n, form, code points of prefix and middle (None if plain), and the output in UTF-8."""
    index = CutIndex(text, unit)
    h1, h2, h3, h4 = draws(doc_id, seed)
    if not text or any(m in text for m in MARKS) or h3 % 100 >= CUT:
        return index.n, "plain", None, None, index.data
    low, high = sorted((h1 % (index.n + 1), h2 % (index.n + 1)))
    (a, chars), (z, upto) = index.after(low), index.after(high)
    prefix, middle, suffix = index.data[:a], index.data[a:z], index.data[z:]
    if spm := h4 % 100 < SUFFIX_FIRST:
        parts = (SUFFIX, suffix, PREFIX, prefix, MIDDLE, middle)
    else:
        parts = (PREFIX, prefix, SUFFIX, suffix, MIDDLE, middle)
    return index.n, "spm" if spm else "psm", chars, upto - chars, b"".join(p.encode() if isinstance(p, str) else p for p in parts)


def fill_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 1, unit: str | None = None) -> DataFrame:
    """doc_id, n (units), form, prefix_chars, middle_chars, output. ``unit``: a pattern of units, for example ``\\S+\\s*``."""
    pattern = re.compile(unit) if unit else None
    names = ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]
    types = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary())

    def cut(batches):
        pack = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 6, types, strict=True)], names=names)
        for b in batches:
            out, held = [], 0
            for doc, text in zip(b.column("doc_id"), b.column("text"), strict=True):
                doc = doc.as_py()
                row = rearranged(doc, text.as_py() or "", seed, pattern)
                out.append((doc, *row))
                held += len(row[-1])
                if held > BATCH:
                    yield pack(out)
                    out, held = [], 0
            yield pack(out)

    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows = slim.mapInArrow(cut, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output binary")
    return rows.withColumn("output", F.col("output").cast("string"))


def restored(form: Column, output: Column) -> Column:
    """The text from output and form alone."""

    def pieces(marks: tuple[str, str, str]) -> list[Column]:
        found, rest = [], F.substr(output, F.lit(len(marks[0]) + 1))
        for m in marks[1:]:
            piece = F.substring_index(rest, m, 1)
            found.append(piece)
            rest = F.substr(rest, F.length(piece) + len(m) + 1)
        return [*found, rest]

    p, s, m = pieces((PREFIX, SUFFIX, MIDDLE))
    psm = F.concat(p, m, s)
    s, p, m = pieces((SUFFIX, PREFIX, MIDDLE))
    return F.when(form == "psm", psm).when(form == "spm", F.concat(p, m, s)).otherwise(output)


def op13_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    settle(spark)
    cut = fill_middle(read(spark, sf_dir, "documents"))
    back = restored(F.col("form"), F.col("output"))
    return cut.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(back, 256).alias("restored_sha256")
    )


OP13_SQL = """
WITH drawn AS (
  SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS s FROM documents
), numbers AS (
  SELECT doc_id, t, n, CAST('0x' || s[1:8] AS BIGINT) AS h1, CAST('0x' || s[9:16] AS BIGINT) AS h2, CAST('0x' || s[17:24] AS BIGINT) AS h3,
    CAST('0x' || s[25:32] AS BIGINT) AS h4 FROM drawn
), cut AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS z,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain'
      WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM numbers
), pieces AS (
  SELECT *, substr(t, 1, a) AS p, substr(t, a + 1, z - a) AS m, substr(t, z + 1) AS s FROM cut
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN z - a END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'spm' THEN '<S>' || s || '<P>' || p || '<M>' || m ELSE '<P>' || p || '<S>' || s || '<M>' || m END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM pieces
"""
