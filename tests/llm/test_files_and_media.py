import hashlib
import zlib
from functools import lru_cache
from itertools import groupby

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from shelfwise.llm import media_chunks as C
from shelfwise.llm import range_coder as R
from shelfwise.llm import token_files as K
from shelfwise.llm.tokens import TextIds
from tests.llm.helpers import empty, rows, table

WORD, BYTE = (public_tokenizers.path(f) for f in ("word_bpe_49k.json", "byte_bpe_50k.json"))


_plain = lru_cache(Tokenizer.from_file)
_cached = lru_cache(TextIds)


@settings(max_examples=15, deadline=None)
@given(st.lists(st.integers(0, 65535), max_size=2600), st.integers(1, 40))
def test_coder_gives_back_any_ids(ids, repeat):
    ids = np.array((ids[:50] * repeat + ids)[:2600], np.uint32)
    assert (R.decode(R.encode(ids)) == ids).all()


def test_coder_on_regular_runs_is_small_and_damage_is_noticed():
    ids = np.tile(np.arange(300, dtype=np.uint32), 30)
    data = R.encode(ids)
    assert (R.decode(data) == ids).all() and len(data) < len(ids)
    bad = bytearray(data)
    bad[-5] ^= 1
    with pytest.raises(ValueError, match="checksum"):
        R.decode(bytes(bad))


def test_coder_learns_a_segment_once_for_all_of_its_blocks():
    rng = np.random.default_rng(7)
    n, chance = 64 * R.BLOCK, 1 / np.arange(3, 2003)
    ids = rng.choice(2000, n, p=chance / chance.sum()).astype(np.uint32) * 20
    ids[1::3] = (ids[::3] * 7 + 1)[: len(ids[1::3])] % 40_000  # what follows is known
    p = np.bincount(ids[ids % 20 == 0]) / n
    bound = -(p[p > 0] * np.log2(p[p > 0])).sum()
    data = R.encode(ids)
    # Blocks that each begin from nothing take 2.0 times the bound
    assert (R.decode(data) == ids).all() and 8 * len(data) / n < 1.3 * bound


def test_coder_gives_back_blocks_of_many_lanes(monkeypatch):
    monkeypatch.setattr(R, "LANES", 3)
    rng = np.random.default_rng(8)
    for n in (1, 2, R.BLOCK, R.BLOCK + 1, 7 * R.BLOCK - 5, 40 * R.BLOCK):
        for ids in (rng.integers(0, 65536, n), rng.integers(0, 3, n), np.full(n, 65535), np.arange(n)):
            assert (R.decode(R.encode(ids.astype(np.uint32))) == ids).all()
    bad = bytearray(R.encode(np.arange(5000, dtype=np.uint32) % 50))
    bad[24] ^= 1  # in the model
    with pytest.raises(ValueError, match="checksum"):
        R.decode(bytes(bad))


@pytest.mark.parametrize("path, lead", [(WORD, False), (BYTE, True)])
def test_cached_ids_are_the_tokenizer_s(path, lead):
    texts = ["a  b", " a", "a ", "x<|endoftext|>y <|endoftext|>", "a\n\nb  c\t d", "don't 123 4", "ΑΣ. İstanbul é́", "a\x1cb \x1c", "日本語 テ", "", None, "tab\tx\r\nz", "a \0b", "\0a \0", "x\ny|\n>", "\n a\nb\n\nc", "x" * 300_000, "y " * 100_000]
    texts += [t for _, t in rows()]
    plain = Tokenizer.from_file(path)
    want = [np.array(plain.encode(t or "", add_special_tokens=False).ids, np.uint32).tobytes() for t in texts]
    ids = TextIds(path, lead, most=5000)
    assert [ids.encode([t])[0] for t in texts] == want and ids.encode(texts) == want


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.sampled_from([*"ab \0\n\tZé'1.,-\x1c\u3000日\u2028", "  ", " The", "\nthe", "don't", "<|endoftext|>", " \0b", "\r\n"]), max_size=14), max_size=20))
@pytest.mark.parametrize("path, lead", [(WORD, False), (BYTE, True)])
def test_ids_of_any_characters(path, lead, parts):
    texts = ["".join(p) for p in parts]
    plain = _plain(path)
    assert _cached(path, lead).encode(texts) == [np.array(plain.encode(t, add_special_tokens=False).ids, np.uint32).tobytes() for t in texts]


def _coded(plain, text):
    ids = np.array(plain.encode(text or "", add_special_tokens=False).ids + [1], "<u4")
    return len(ids), zlib.crc32(ids.tobytes())


def test_token_files(spark, tmp_path):
    docs, plain = table(spark, rows()), Tokenizer.from_file(WORD)
    K.write_tokens(docs, str(tmp_path / "t"), WORD)
    got = sorted(map(tuple, K.read_tokens(spark, str(tmp_path / "t")).collect()), key=lambda r: r[1])
    assert [r[0] for r in got] == sorted((i for i, _ in rows()), key=lambda i: (i is not None, i or 0))
    want, start, left = [], 0, list(rows())
    for r in got:  # rows that tie in doc_id take any order
        i, text = next(x for x in left if x[0] == r[0] and r[2:] == _coded(plain, x[1]))
        left.remove((i, text))
        want.append((i, start, *r[2:]))
        start += r[2]
    assert got == want and not left


def test_token_files_of_nothing(spark, tmp_path):
    K.write_tokens(empty(spark), str(tmp_path / "t"), WORD)
    assert K.read_tokens(spark, str(tmp_path / "t")).count() == 0


def test_cuts_move_only_beside_an_edit():
    rng = np.random.default_rng(3)
    data = rng.integers(0, 256, 200_000, dtype=np.uint8).tobytes()
    edited = data[:90_000] + b"an edit" + data[90_000:]
    a, b = C.chunks_of(data), C.chunks_of(edited)
    assert b"".join(a) == data and b"".join(b) == edited
    assert all(len(c) <= C.LONGEST for c in a) and all(len(c) >= C.SHORTEST for c in a[:-1])
    assert len(set(a) - set(b)) <= 3


@pytest.mark.parametrize("some", [True, False])
def test_media(spark, tmp_path, some):
    docs = table(spark, rows()) if some else empty(spark)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = C.op2_media_chunks(spark, str(tmp_path)).collect()
    want = []
    for i, t in rows() if some else []:
        raw = (t or "").encode()
        p = raw.ljust(max(64, -(-len(raw) // 64) * 64), b"\0")
        want.append((i, len(raw), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]), C.feature(p)))
    key = lambda r: tuple(map(str, r))
    assert sorted(((r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32, r.feature) for r in got), key=key) == sorted(want, key=key)
    for _, same in groupby(sorted(got, key=lambda r: r.payload_sha256), key=lambda r: r.payload_sha256):
        assert len({(r.media_bytes, r.media_sha256) for r in same}) == 1


def test_larger_ids_are_refused():
    with pytest.raises(ValueError, match="16 bits"):
        R.encode(np.array([5, 70_000], np.uint32))


def test_chunks_that_many_payloads_name(spark):
    """A long opening that all texts share is copied, and every payload is still whole; nothing stays in the catalogue."""
    opening = " ".join(f"w{i % 501} {i}" for i in range(3000))
    docs = table(spark, [(i, f"{opening} and the end of number {i} " + "x" * i) for i in range(40)] + rows())
    slim = docs.select("doc_id", "text")
    lists = slim.mapInArrow(C._list, "doc_id long, n_bytes long, payload binary, digests array<binary>, sizes array<int>")
    before = {t.name for t in spark.catalog.listTables()}
    chunks, name = C.store_chunks(slim, 4)
    got = {r.payload: tuple(r) for hot in (3, 10**6) for r in C.read_media(lists, chunks, 4, hot).collect()}
    assert {hashlib.sha256(C.payload_of(r.text)).digest() for r in docs.collect()} == {bytes(k) for k in got}
    a, b = (sorted(tuple(r) for r in C.read_media(lists, chunks, 4, hot).collect()) for hot in (3, 10**6))
    assert a == b
    damaged = chunks.where("digest <> (select max(digest) from " + name + ")")
    with pytest.raises(Exception, match="(?s)NoneType|differs|decompress"):
        C.read_media(lists, damaged, 4, 3).collect()
    spark.sql(f"DROP TABLE {name}")
    assert {t.name for t in spark.catalog.listTables()} == before
