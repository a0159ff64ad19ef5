"""Token ids of whole texts, with the pieces of text that repeat encoded once.

A byte-level BPE with the usual split pattern (`` ?letters| ?digits| ?marks|spaces``)
always starts a new pre-token at a space that follows a non-space character, and at a mark
that follows a letter. So a text is the join of its parts between such places, and its ids
are the join of the parts' ids. Arrow numbers the different parts of a block of texts, the
tokenizers library encodes those that the worker has not met, and numpy takes each text's
ids from the parts'. Each worker keeps parts and ids (bounded by ``CACHE_BYTES``; past that
those that came most often stay) while its tasks encode, and lets go of them, and of the
tokenizer, ``IDLE_SECONDS`` after the last text: Spark uses workers again for other stages.
New parts of a space and a word are encoded many to a text; the bytes that each id stands
for say which ids are whose, and where they do not, parts are encoded one by one. A text that
holds the literal of an added token (``<|endoftext|>``) has that token's id there, and no
pre-token crosses it: such a text is encoded as a whole. Every id comes from the library as
it is loaded, and ``tests/llm`` compares with the library's ids of whole texts.
"""

from __future__ import annotations

import os
import re
import threading
import time
import zlib
from itertools import repeat

import numpy as np
import pyarrow as pa

from colscope.llm.blocks import give_back

CACHE_BYTES = 96 << 20       # parts of a worker: about 500,000
PART_BYTES = 190             # of one part beside its text: its ids, numbers and place in the dictionary
LONG_BYTES = 64              # longer parts are not kept past the bound
IDLE_SECONDS = 2.0
_MARKS = ".,;:!?)]}>\"%$#&*|"     # neither letters, digits, white space nor an apostrophe
_AT_ONCE = 500               # parts in one text for the library

_SPACES = [c for c in map(chr, range(0x3001)) if c.isspace()]
_IS_SPACE = np.zeros(256, bool)                 # ASCII
_IS_SPACE[[ord(c) for c in _SPACES if c < "\x80"]] = True
_WIDE_SPACES = np.array([int.from_bytes(c.encode(), "big") for c in _SPACES if c >= "\x80"])     # two or three bytes
_IS_MARK = np.zeros(256, bool)
_IS_MARK[[ord(c) for c in _MARKS]] = True
_IS_LETTER = np.array([chr(c).isalpha() for c in range(1 << 11)])      # of one or two bytes


def _ends_in_space(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether the character before byte ``at`` (not the first) is white space."""
    last = data[at - 1]
    out = _IS_SPACE[last]
    wide = np.flatnonzero(last >= 0x80)
    if len(wide):
        end = at[wide]
        two = data[end - 2].astype(np.int64) << 8 | data[end - 1]
        three = data[np.maximum(end - 3, 0)].astype(np.int64) << 16 | two
        out[wide] = np.isin(two, _WIDE_SPACES) | np.isin(three, _WIDE_SPACES)
    return out


def _ends_in_letter(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether the character before byte ``at`` (not the first) is a letter of one or two bytes."""
    last = data[at - 1]
    out = _IS_LETTER[last & 0x7F] & (last < 0x80)
    wide = np.flatnonzero(last >= 0x80)
    if len(wide):
        lead = data[at[wide] - 2]
        out[wide] = (lead >= 0xC2) & (lead < 0xE0) & _IS_LETTER[(lead & 0x1F).astype(np.int64) << 6 | last[wide] & 0x3F]
    return out


def part_starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where the parts of texts (bytes one after another, ``offsets``) begin: at each text, at a
    space after a non-space, at a mark after a letter."""
    first = np.zeros(len(data), bool)
    space = np.flatnonzero(data[1:] == 0x20) + 1
    first[space[~_ends_in_space(data, space)]] = True
    mark = np.flatnonzero(_IS_MARK[data[1:]]) + 1
    first[mark[_ends_in_letter(data, mark)]] = True
    first[offsets[offsets < len(data)]] = True
    return np.flatnonzero(first)


def _gather(ids: np.ndarray, first: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs ``ids[first:first + n]`` one after another, and their bounds."""
    bounds = np.zeros(len(n) + 1, np.int64)
    np.cumsum(n, out=bounds[1:])
    at = np.repeat(first - bounds[:-1], n)
    at += np.arange(len(at))
    return ids[at], bounds


class Encoder:
    """Text to ids as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str, cache_bytes: int | None = None):
        self.cache_bytes = cache_bytes or CACHE_BYTES
        os.environ["TOKENIZERS_PARALLELISM"] = "false"      # Spark's tasks are the parallelism
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.added = re.compile("|".join(map(re.escape, added))) if added else None
        size = {i: len(t) for t, i in self.tokenizer.get_vocab(with_added_tokens=False).items()}
        self.size = np.zeros(max(size, default=0) + 1, np.int64)       # bytes of an id: a byte is a character of its name
        self.size[list(size)] = list(size.values())
        self.parts: dict[str, int] = {}       # part -> its number
        self.ids = np.zeros(0, "<u4")           # of all parts; those of a part are first:first + n
        self.first = np.zeros(0, np.int64)
        self.n = np.zeros(0, np.int64)
        self.met = np.zeros(0, np.int64)        # how often a part came, halved whenever room is made
        self.held = 0

    def _encode(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, "<u4") for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _make_room(self) -> None:
        """Past the bound, keep the parts that came most often, up to half of it."""
        if self.held > self.cache_bytes:
            parts = list(self.parts)
            size = np.fromiter((len(p.encode()) for p in parts), np.int64, len(parts))
            short = np.flatnonzero(size <= LONG_BYTES)
            most = short[np.argsort(-self.met[short], kind="stable")]
            kept = np.sort(most[np.cumsum(size[most] + PART_BYTES) <= self.cache_bytes // 2])
            self.parts = {parts[k]: i for i, k in enumerate(kept.tolist())}
            self.held = int(size[kept].sum()) + PART_BYTES * len(kept)
            self.ids, bounds = _gather(self.ids, self.first[kept], self.n[kept])
            self.first, self.n, self.met = bounds[:-1], self.n[kept], self.met[kept] >> 1

    def _words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of parts that begin with a space before a non-space and end in a non-space, and how many
        each has: such parts join to a text whose parts they are."""
        end = np.cumsum([len(w.encode()) for w in words])
        (ids,) = self._encode(["".join(words)])
        at = np.cumsum(self.size[ids]) if len(ids) and ids.max() < len(self.size) else np.zeros(1, np.int64)
        bounds = np.searchsorted(at, end)
        if at[-1] == end[-1] and np.array_equal(at[bounds], end):
            return ids, np.diff(bounds, prepend=-1)
        each = self._encode(words)
        return np.concatenate(each), np.array([len(x) for x in each])

    def _learn(self, new: list[str]) -> None:
        """Numbers and ids for parts not met before."""
        words = [p for p in new if len(p) > 1 and p == " " + p.strip()]
        found = [self._words(words[k:k + _AT_ONCE]) for k in range(0, len(words), _AT_ONCE)]
        if len(words) < len(new):
            have = set(words)
            alone = [p for p in new if p not in have]
            words += alone
            each = self._encode(alone)
            found.append((np.concatenate(each), np.array([len(x) for x in each])))
        held, known = len(self.ids), len(self.parts)
        self.parts.update(zip(words, range(known, known + len(words))))
        self.held += sum(map(len, words)) + PART_BYTES * len(words)
        self.ids = np.concatenate([self.ids, *[ids for ids, _ in found]])
        self.n = np.concatenate([self.n, *[n for _, n in found]])
        self.first = np.concatenate([self.first, held + np.cumsum(self.n[known:]) - self.n[known:]])
        self.met = np.concatenate([self.met, np.zeros(len(words), np.int64)])

    def __call__(self, texts: list[str]) -> list[bytes]:
        whole = [i for i, t in enumerate(texts) if self.added and self.added.search(t)]
        if not whole:
            return self._joined(texts)
        ids = dict(zip(whole, [x.tobytes() for x in self._encode([texts[i] for i in whole])]))
        rest = iter(self._joined([t for i, t in enumerate(texts) if i not in ids]))
        return [ids[i] if i in ids else next(rest) for i in range(len(texts))]

    def _joined(self, texts: list[str]) -> list[bytes]:
        """Ids of texts without an added token's literal, so that none of their parts has one."""
        raw = [t.encode() for t in texts]
        offsets = np.zeros(len(raw) + 1, np.int64)
        np.cumsum([len(r) for r in raw], out=offsets[1:])
        data = np.frombuffer(b"".join(raw), np.uint8)
        if not len(data):
            return [b""] * len(texts)
        start = part_starts(data, offsets)
        here = pa.Array.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(np.append(start, len(data))), pa.py_buffer(data)])
        here = here.dictionary_encode()
        parts, here = here.dictionary.cast(pa.large_string()).to_pylist(), here.indices.to_numpy()
        number = np.fromiter(map(self.parts.get, parts, repeat(-1)), np.int64, len(parts))
        new = np.flatnonzero(number < 0).tolist()
        if new:
            self._learn([parts[i] for i in new])
            number[new] = [self.parts[parts[i]] for i in new]
        self.met[number] += np.bincount(here, minlength=len(parts))
        number = number[here]
        ids, bounds = _gather(self.ids, self.first[number], self.n[number])
        ids, at = ids.tobytes(), (4 * bounds[np.searchsorted(start, offsets)]).tolist()
        self._make_room()
        return [ids[a:b] for a, b in zip(at, at[1:])]


class _Shared:
    """The encoders of a worker process. A thread lets go of one that was idle for ``IDLE_SECONDS``;
    the next text makes a new one."""

    def __init__(self):
        self.lock = threading.Lock()
        self.encoders: dict[tuple, tuple[Encoder, float]] = {}
        self.watched = False

    def __call__(self, path: str, texts: list[str], cache_bytes: int | None) -> list[bytes]:
        key = (path, cache_bytes)
        with self.lock:
            enc = self.encoders[key][0] if key in self.encoders else Encoder(path, cache_bytes)
            try:
                return enc(texts)
            finally:
                self.encoders[key] = (enc, time.monotonic())
                if not self.watched:
                    self.watched = True
                    threading.Thread(target=self._watch, daemon=True).start()

    def _watch(self) -> None:
        while True:
            time.sleep(IDLE_SECONDS / 2)
            with self.lock:
                now = time.monotonic()
                held = len(self.encoders)
                self.encoders = {k: (e, t) for k, (e, t) in self.encoders.items() if now - t < IDLE_SECONDS}
                over = not self.encoders
                if over:
                    self.watched = False
                if len(self.encoders) < held:
                    give_back()     # the last task's own ``lean`` came while the parts were still held
                if over:
                    return


_SHARED = _Shared()


def encode_ids(path: str, texts: list[str], cache_bytes: int | None = None) -> list[bytes]:
    """Ids of ``texts`` with this process's encoder for ``path``."""
    return _SHARED(path, texts, cache_bytes)


def crc(ids: bytes) -> int:
    return zlib.crc32(ids)
