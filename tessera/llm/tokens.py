"""Byte-level BPE ids through the tokenizers library, with a bounded cache of text segments.

The vocabulary's splitting rule never joins characters over a boundary between a non-space character and a space that follows
it, so a text's ids are those of its segments cut there. Segments repeat; each is encoded by the library once and looked up
afterwards. Special tokens are found by the library in whole texts, so texts that hold one go to it whole.
"""

from __future__ import annotations

import ctypes
import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

VOCABULARY = "byte_bpe_50k.json"
#: Segments that a worker remembers; when there are more, the half that it met most often stays.
CACHE = 400_000
#: New segments that are encoded as one text.
JOINED = 100
#: A lone surrogate, which no decoded text holds.
FIRST = "\ud800"
_BOUNDARY = re.compile(r"(?<=\S) ")
#: A space after another character that any definition takes for white space.
_ODD = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}] "


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class _Index(dict):
    """Segment to number; an unknown one gets the next number and is noted in new."""

    def __init__(self):
        self.new: list[str] = []

    def __missing__(self, piece: str) -> int:
        n = self[piece] = len(self)
        self.new.append(piece)
        return n


class Encoder:
    def __init__(self, path: str | None = None, cache: int = CACHE):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path or vocabulary_path())
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.spaced = np.zeros(self.tokenizer.get_vocab_size(), bool)
        for token, k in self.tokenizer.get_vocab().items():
            self.spaced[k] = token.startswith("\u0120")  # a space, as byte-level vocabularies write it
        self.cache = cache
        self._clear()

    def _clear(self) -> None:
        self.index = _Index()
        self.store = np.zeros(1 << 16, np.uint32)
        self.starts, self.sizes, self.hits = (np.zeros(1 << 14, np.int32) for _ in range(3))
        self.used = self.n = 0

    def _trim(self) -> None:
        """Forget segments met once, and of the others those met least, down to half the bound. Older meetings count half."""
        keep = np.argsort(-self.hits[: self.n], kind="stable")[: self.cache // 2]
        keep = np.sort(keep[self.hits[keep] > 1])
        pieces = np.array(list(self.index), object)[keep].tolist()
        sizes, hits, old = self.sizes[keep], self.hits[keep] // 2, self.starts[keep]
        ends = np.cumsum(sizes)
        ids = self.store[np.repeat(old - (ends - sizes), sizes) + np.arange(int(ends[-1]) if len(ends) else 0)]
        self._clear()
        self.index.update(zip(pieces, range(len(pieces))))
        self._append(ids, ends - sizes, sizes)
        self.hits[: self.n] = hits

    def _append(self, ids: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> None:
        while self.used + len(ids) > len(self.store):
            self.store = np.concatenate([self.store, np.zeros_like(self.store)])
        while self.n + len(sizes) > len(self.starts):
            self.starts, self.sizes, self.hits = (np.concatenate([x, np.zeros_like(x)]) for x in (self.starts, self.sizes, self.hits))
        self.store[self.used : self.used + len(ids)] = ids
        self.starts[self.n : self.n + len(sizes)] = self.used + starts
        self.sizes[self.n : self.n + len(sizes)] = sizes
        self.used += len(ids)
        self.n += len(sizes)

    def _learn(self) -> None:
        """Encode the new segments, kept without the space before them (those that have none begin with FIRST).

        Segments whose characters are no spaces are joined to longer texts, which have the same ids one after another; a
        segment begins where a token begins with a space. Others are encoded one by one."""
        new, self.index.new = self.index.new, []
        plain = np.array([bool(p) and p[0] != FIRST and " " not in p and not p[-1].isspace() for p in new])
        some = [p for p, ok in zip(new, plain) if ok]
        rest = [p[1:] if p[:1] == FIRST else " " + p for p, ok in zip(new, plain) if not ok]
        sizes = np.zeros(len(new), np.int64)
        ids = [np.zeros(0, np.uint32)] * 2
        if some:
            parts = []
            for a in range(0, len(some), 100 * JOINED):  # the library's own results are large: a few at a time
                joined = [" " + " ".join(some[k : min(k + JOINED, a + 100 * JOINED)]) for k in range(a, min(len(some), a + 100 * JOINED), JOINED)]
                parts += [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(joined, add_special_tokens=False)]
            ids[0] = np.concatenate(parts)
            sizes[plain] = np.diff(np.append(np.flatnonzero(self.spaced[ids[0]]), len(ids[0])))
        if rest:
            got = [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(rest, add_special_tokens=False)]
            ids[1] = np.concatenate(got)
            sizes[~plain] = [len(g) for g in got]
        starts = np.zeros(len(new), np.int64)
        starts[plain] = np.cumsum(sizes[plain]) - sizes[plain]
        starts[~plain] = len(ids[0]) + np.cumsum(sizes[~plain]) - sizes[~plain]
        self._append(np.concatenate(ids), starts, sizes)

    def encode(self, texts) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after another and the number of ids of each text. texts: strings without nulls, a list or an Arrow array."""
        texts = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
        parts = [self._encode(texts.slice(a, b - a)) for a, b in slices(texts, 8_000_000)]
        if not parts:
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])

    def _ids(self, at: np.ndarray, per: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the segments numbered at, of which each text has per."""
        if self.index.new:
            self._learn()
        sizes = self.sizes[at]
        ends = np.cumsum(sizes, dtype=np.int32)
        place = np.repeat(self.starts[at] - ends + sizes, sizes)
        place += np.arange(len(place), dtype=np.int32)
        ids = self.store[place]
        sums, edge = np.concatenate([[0], ends]), np.concatenate([[0], np.cumsum(per)])
        return ids, (sums[edge[1:]] - sums[edge[:-1]]).astype(np.int64)

    def _encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        if self.n > self.cache:
            self._trim()
        number = self.index.__getitem__
        odd = pc.match_substring_regex(texts, _ODD)
        whole = np.zeros(len(texts), bool)
        for s in self.special:
            whole |= pc.match_substring(texts, s).to_numpy(zero_copy_only=False)
        odd = odd.to_numpy(zero_copy_only=False) & ~whole
        easy = ~odd & ~whole
        lists = pc.split_pattern(texts if easy.all() else texts.filter(pa.array(easy)), " ")
        edge = lists.offsets.to_numpy()
        if len(edge) > 1:
            words = lists.values.dictionary_encode()
            own, places = np.fromiter(map(number, words.dictionary.to_pylist()), np.int32, len(words.dictionary)), words.indices.to_numpy()
            at = own[places]
            firsts = lists.values.take(pa.array(edge[:-1])).to_pylist()
            at[edge[:-1]] = np.fromiter((number(FIRST + p) for p in firsts), np.int64, len(firsts))
            ids, counts = self._ids(at, np.diff(edge))
            self.hits[own] += np.bincount(places, minlength=len(own)).astype(np.int32)
        else:
            ids, counts = np.zeros(0, np.uint32), np.zeros(0, np.int64)
        if easy.all():
            return ids, counts
        parts: list[np.ndarray] = [np.zeros(0, np.uint32)] * len(texts)
        for k, own in zip(np.flatnonzero(easy), np.split(ids, np.cumsum(counts)[:-1])):
            parts[k] = own
        for k in np.flatnonzero(odd):
            cut = _BOUNDARY.split(texts[int(k)].as_py())
            cut[0] = FIRST + cut[0]
            parts[k] = self._ids(np.fromiter(map(number, cut), np.int64, len(cut)), np.array([len(cut)]))[0]
        for k in np.flatnonzero(whole):
            parts[k] = np.array(self.tokenizer.encode(texts[int(k)].as_py(), add_special_tokens=False).ids, np.uint32)
        return np.concatenate(parts), np.array([len(p) for p in parts], np.int64)


_encoders: dict[str, Encoder] = {}


def encoder(path: str | None = None, cache: int = CACHE) -> Encoder:
    """The worker's encoder for a vocabulary file: Python workers live on between tasks."""
    key = path or vocabulary_path()
    if key not in _encoders:
        _encoders[key] = Encoder(key)
    _encoders[key].cache = cache
    return _encoders[key]


def forget() -> None:
    """Let the worker's encoders go, for what runs in it next; the next task that needs one reads the vocabulary again."""
    _encoders.clear()


def give_back() -> None:
    """Return freed memory to the system; called between batches and when a task ends, since Python workers live on."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def with_end(ids: np.ndarray, counts: np.ndarray, end: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """The same with one more id after each text."""
    return np.insert(ids, np.cumsum(counts), end).astype(np.uint32, copy=False), counts + 1


def slices(texts: pa.Array, limit: int = 4_000_000, rows: int = 1 << 30):
    """Ranges of rows of about limit bytes, at most so many rows, so that what a worker holds does not grow with the batch."""
    sizes = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False)) if len(texts) else np.zeros(0)
    start = 0
    while start < len(texts):
        end = min(int(np.searchsorted(sizes, (sizes[start - 1] if start else 0) + limit)) + 1, start + rows, len(texts))
        yield start, end
        start = end
