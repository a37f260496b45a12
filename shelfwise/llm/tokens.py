"""Token ids of whole texts by a public tokenizer, with a bounded cache of the words that a worker has met.

A text is cut at spaces where the tokenizer itself always cuts, so that joining the ids of the parts gives exactly the
ids of the text: either white space is dropped by the tokenizer (``lead`` false), or a single space between two other
characters begins the next word (``lead`` true). Texts with other runs of spaces are encoded whole. Arrow cuts a batch
and finds its distinct words; only those are looked up, and numpy lays their ids out.

Defined cases: null and empty texts have no ids; a text of any length is taken whole (``RUN`` bounds how many texts go
through at once, not how long one may be); any characters, NUL and the tokenizer's own marks among them, are encoded as
the tokenizer does.
"""

from __future__ import annotations

import os
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: A Latin-1 word, led by a line end or not, and what stands after it, without apostrophes: the tokenizers' patterns cut it
#: between these parts and nowhere else, so their BPE model can be asked directly, which skips most of the cost of a call.
_SIMPLE = r"\A(?P<stem>\n?[A-Za-zÀ-ÖØ-öø-ÿ]+)(?P<tail>[!-&(-/:-@\[-`{-~]*)\z"
#: Bytes of text that go through at once, about.
RUN = 8 << 20
#: Longer words are not worth keeping.
LONG = 48


def _byte_letters() -> dict[int, str]:
    """Byte-level BPE spells bytes as letters: those that print stand for themselves, the others follow from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


_LETTERS = _byte_letters()


def _spell(text: str) -> str:
    return text if text.isascii() and text.isalnum() else text.encode().decode("latin-1").translate(_LETTERS)


_BLANK = r"[\x09-\x0D\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
#: A space beside other white space, or white space at either end.
_ODD_SPACE = f"{_BLANK} | {_BLANK}|\\A{_BLANK}|{_BLANK}\\z"
#: A line end beside other white space, or at either end.
_ODD_LINE = f"{_BLANK}\n|\n{_BLANK}|\\A\n|\n\\z"


def _gather(pool: np.ndarray, sizes: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs of ``pool`` that ``codes`` name, one after the other, and the length of each."""
    n = sizes[codes]
    ends = np.cumsum(n)
    starts = np.cumsum(sizes) - sizes
    return pool[np.repeat(starts[codes] - ends + n, n) + np.arange(ends[-1] if len(ends) else 0)], n


def _strings(words: pa.Array) -> list[str]:
    """``to_pylist`` without an Arrow scalar for each."""
    return words.to_numpy(zero_copy_only=False).tolist()


def _lay(parts: list[bytes], codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.fromiter(map(len, parts), np.int64, len(parts)) >> 2
    return _gather(np.frombuffer(b"".join(parts), np.uint32), sizes, codes)


class Known:
    """Ids of words in two generations of at most ``most`` bytes each: once the new one is full the old one goes, so words
    in use stay."""

    def __init__(self, most: int):
        self.most, self.held = most, 0
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def put(self, words: list[str], parts: list[bytes], run: int = 5000) -> None:
        for at in range(0, len(words), run):
            some = {w: ids for w, ids in zip(words[at : at + run], parts[at : at + run], strict=True) if len(w) <= LONG}
            size = 200 * len(some) + sum(map(len, some)) + sum(map(len, some.values()))
            if self.held and self.held + size > self.most:
                self.new, self.old, self.held = {}, self.new, 0
            self.held += size
            self.new |= some


class TextIds:
    def __init__(self, path: str, lead: bool, most: int = 48 << 20):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.lead = lead
        #: Words after a space, and words after nothing or a line end; the same where white space is dropped
        self.spaced = Known(most)
        self.bare = Known(most) if lead else self.spaced
        # An added token always parts what stands before and after it, so words around it are encoded each for itself
        self.mark_id, mark = next(iter(self.tokenizer.get_added_tokens_decoder().items()))
        self.mark = mark.content
        self.model, self.tails = self.tokenizer.model, {"": b""}
        self.line_end = self._piece("\n") if lead else b""

    def _raw(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, np.uint32).tobytes() for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]

    def _words(self, new: list[str], run: int = 2000) -> list[bytes]:
        """Ids of single words, many to a call: far cheaper than a call, or a result object, for each."""
        whole = [i for i, w in enumerate(new) if self.mark in w]
        if whole:
            plain = self._words([w for w in new if self.mark not in w], run)
            odd = dict(zip(whole, self._raw([new[i] for i in whole]), strict=True))
            rest = iter(plain)
            return [odd[i] if i in odd else next(rest) for i in range(len(new))]
        out: list[bytes] = []
        for at in range(0, len(new), run):
            part = new[at : at + run]
            ids = np.array(self.tokenizer.encode(self.mark.join(part), add_special_tokens=False).ids, np.uint32)
            cuts = np.flatnonzero(ids == self.mark_id).tolist()
            raw = ids.tobytes()
            out += [raw[4 * a : 4 * z] for a, z in zip([0, *(c + 1 for c in cuts)], [*cuts, len(ids)], strict=True)]
        return out

    def _piece(self, text: str) -> bytes:
        return array("I", [t.id for t in self.model.tokenize(_spell(text))]).tobytes()

    def _stems(self, stems: list[str], spaced: bool) -> list[bytes]:
        if self.lead:
            return [self._stem(x, spaced) for x in stems]
        cut = self.model.tokenize
        return [array("I", [t.id for t in cut(x if x.isascii() else _spell(x))]).tobytes() for x in stems]

    def _stem(self, stem: str, spaced: bool) -> bytes:
        if stem[0] == "\n":  # a single line end is a piece of its own, and no space leads the word after it
            return self.line_end + self._piece(stem[1:])
        return self._piece(" " + stem if spaced else stem)

    def _ids_of(self, words: pa.Array, spaced: bool) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct words, one word after the other, and the number of each one's ids."""
        known = self.spaced if spaced else self.bare
        cut = pc.extract_regex(words, _SIMPLE)
        simple = cut.is_valid().to_numpy(zero_copy_only=False)
        cut = cut.filter(pa.array(simple))
        # Where white space is dropped, so is case: that of Latin-1 letters is the same in Arrow
        stems, tails = cut.field(0) if self.lead else pc.utf8_lower(cut.field(0)), cut.field(1)
        stems, tails = stems.dictionary_encode(), tails.dictionary_encode()
        parts = [b""]

        def codes(of: list[str], make) -> int:
            """Places of the ids of ``of`` begin at this number."""
            first = len(parts)
            found = list(map(known.new.get, of))
            missed = [i for i, ids in enumerate(found) if ids is None]
            words = [of[i] for i in missed]
            ids = list(map(known.old.get, words))
            new = [k for k, x in enumerate(ids) if x is None]
            for k, x in zip(new, make([words[k] for k in new]), strict=True):
                ids[k] = x
            for i, x in zip(missed, ids, strict=True):
                found[i] = x
            known.put(words, ids)
            parts.extend(found)
            return first

        two = np.zeros((len(words), 2), np.int64)
        at = codes(_strings(stems.dictionary), lambda new: self._stems(new, spaced))
        two[simple, 0] = at + stems.indices.to_numpy()
        two[simple, 1] = len(parts) + tails.indices.to_numpy()
        for tail in tails.dictionary.to_pylist():
            if tail not in self.tails:
                if len(self.tails) > 10_000:
                    self.tails = {"": b""}
                self.tails[tail] = self._piece(tail)
            parts.append(self.tails[tail])
        odd = _strings(words.filter(pa.array(~simple)))
        lead = " " if spaced and self.lead else ""
        at = codes(odd, lambda new: self._words([x if x[:1] == "\n" else lead + x for x in new]))
        two[~simple, 0] = at + np.arange(len(odd))
        ids, sizes = _lay(parts, two.ravel())
        return ids, sizes.reshape(-1, 2).sum(axis=1)

    def _run(self, texts: pa.Array) -> list[bytes]:
        odd = np.empty(0, np.int64)
        plain = texts
        if self.lead:
            is_odd = pc.match_substring_regex(texts, _ODD_SPACE)
            odd = np.flatnonzero(is_odd.to_numpy(zero_copy_only=False))
            plain = pc.if_else(is_odd, "", texts)
            plain = pc.if_else(pc.match_substring_regex(plain, _ODD_LINE), plain, pc.replace_substring(plain, "\n", " \n"))
        else:
            plain = pc.replace_substring(plain, "\n", " ")
        lists = pc.split_pattern(plain, " ")
        at = lists.offsets.to_numpy().astype(np.int64)
        at -= at[0]
        words = lists.flatten()
        coded = words.dictionary_encode()
        codes = coded.indices.to_numpy().astype(np.int64)
        pools, sizes = ([x] for x in self._ids_of(coded.dictionary, True))
        if self.lead:  # what stands first has no space before it
            first = words.take(pa.array(at[:-1])).dictionary_encode()
            codes[at[:-1]] = len(sizes[0]) + first.indices.to_numpy()
            for kept, x in zip((pools, sizes), self._ids_of(first.dictionary, False), strict=True):
                kept.append(x)
        codes[at[odd]] = sum(map(len, sizes)) + np.arange(len(odd))
        raw = self._raw(texts.take(pa.array(odd)).to_pylist())
        pools.append(np.frombuffer(b"".join(raw), np.uint32))
        sizes.append(np.array([len(r) >> 2 for r in raw], np.int64))
        ids, n = _gather(np.concatenate(pools), np.concatenate(sizes), codes)
        edges = (4 * np.concatenate([[0], np.cumsum(n)])[at]).tolist()
        flat = ids.tobytes()
        return [flat[a:z] for a, z in zip(edges, edges[1:], strict=False)]

    def encode(self, texts: pa.Array | list[str | None]) -> list[bytes]:
        """Little-endian 32-bit ids of each text; none for null."""
        if not isinstance(texts, pa.Array):
            texts = pa.array(texts, pa.large_string())
        texts = texts.cast(pa.large_string()).fill_null("")
        sizes = pc.binary_length(texts).to_numpy()
        run = np.cumsum(sizes) // RUN
        edges = [0, *(np.flatnonzero(np.diff(run)) + 1).tolist(), len(texts)]
        out: list[bytes] = []
        for a, z in zip(edges, edges[1:], strict=False):
            if z > a:
                out += self._run(texts.slice(a, z - a))
        return out


_made: dict[tuple[str, bool], TextIds] = {}


def text_ids(path: str, lead: bool) -> TextIds:
    """One for each worker process, kept from task to task; what it holds is bounded in bytes."""
    if (path, lead) not in _made:
        _made.clear()
        _made[path, lead] = TextIds(path, lead)
    return _made[path, lead]
