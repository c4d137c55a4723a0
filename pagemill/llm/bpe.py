"""Ids of a byte-level BPE, over a whole batch at once: pieces are found on an array of code points, and each distinct piece is merged once."""

from __future__ import annotations

import json
import unicodedata
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from tokenizers import Tokenizer

from pagemill.llm import arrays as A

#: The pieces of byte-level BPE of this kind; a fixed value.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SPACES = [*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
SPACE, LETTER, NUMBER, OTHER = range(4)
#: Distinct pieces that a worker remembers.
CACHE = 150_000
#: Bytes of text encoded at once; code points and piece hashes take some twenty times as much.
SLICE_BYTES = 1 << 20

_kinds: np.ndarray | None = None
_loaded: dict[str, tuple] = {}  # of this worker, by path
_library: dict[str, Tokenizer] = {}


def _kind() -> np.ndarray:
    global _kinds
    if _kinds is None:
        names = {"L": LETTER, "N": NUMBER}
        _kinds = np.fromiter((names.get(unicodedata.category(chr(c))[0], OTHER) for c in range(0x110000)), dtype=np.uint8, count=0x110000)
        _kinds[SPACES] = SPACE
    return _kinds


def piece_starts(points: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where PATTERN's matches start in texts laid end to end."""
    n = len(points)
    if not n:
        return np.zeros(0, np.int64)
    kind = _kind()[points]
    edge = np.zeros(n + 1, dtype=bool)
    edge[offsets] = True
    run = np.flatnonzero(edge[:n] | np.append(True, kind[1:] != kind[:-1])[:n])
    after = np.append(run[1:], n)
    start = np.zeros(n + 1, dtype=bool)
    start[run] = True
    joined = ~edge[after]  # with the next run, which is of another kind
    gap = (kind[run] == SPACE) & joined
    start[after[gap] - 1] = True
    plain = gap & (points[after - 1] == 32)
    start[after[plain]] = False
    quote = np.flatnonzero((points[run] == 39) & (after - run == 1) & start[run] & joined)
    quote = quote[kind[after[quote]] == LETTER]
    if len(quote):
        word, room = after[quote], after[quote + 1] - after[quote]
        first, second = points[word], np.where(room > 1, points[np.minimum(word + 1, n - 1)], 0)
        one = np.isin(first, [ord(c) for c in "stmd"])
        two = (np.isin(first, [ord("r"), ord("v")]) & (second == ord("e"))) | ((first == ord("l")) & (second == ord("l")))
        size = np.where(one, 1, np.where(two, 2, 0))
        word, size = word[size > 0], size[size > 0]
        start[word] = False
        start[word + size] = True
    return np.flatnonzero(start[:n])


class ByteBpe:
    """Reads a tokenizer file of byte-level BPE without normaliser, whose ids follow the order of its merges."""

    def __init__(self, path: str):
        self.path = path
        spec = json.load(open(path, encoding="utf-8"))
        self.special = [x["content"] for x in spec["added_tokens"]]
        self.dtype = np.dtype("<u2" if len(spec["model"]["vocab"]) <= 1 << 16 else "<u4")

    def _load(self) -> tuple:
        """What merges pieces, and pieces seen; a worker reads the file once, whichever task it runs."""
        if self.path not in _loaded:
            plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
            letters = dict(zip(map(chr, plain), plain, strict=True))
            letters |= {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(plain))}
            vocab = json.load(open(self.path, encoding="utf-8"))["model"]["vocab"]
            ranks = {bytes(letters[c] for c in k): v for k, v in vocab.items() if k not in self.special}
            _loaded[self.path] = tiktoken.Encoding("byte-bpe", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}), {}
        return _loaded[self.path]

    def _whole(self, text: str) -> np.ndarray:
        """Of a text with special tokens, as the library has it, which only such texts load."""
        if self.path not in _library:
            _library[self.path] = Tokenizer.from_file(self.path)
        return np.array(_library[self.path].encode(text, add_special_tokens=False).ids, dtype=self.dtype)

    def encode(self, batch: pa.RecordBatch, text: str, end: int | None = None) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
        """Slices of the batch, their ids laid end to end (each row's closed by `end`), and each row's first id (with a last entry)."""
        merge, cache = self._load()
        for part in A.slices(batch, text, SLICE_BYTES):
            texts = [x or "" for x in part.column(text).to_pylist()]
            odd = {i for i, x in enumerate(texts) if any(s in x for s in self.special)}
            plain = ["" if i in odd else x for i, x in enumerate(texts)]
            offsets = np.append(0, np.cumsum([len(x) for x in plain]))
            joined = "".join(plain)
            points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
            start = piece_starts(points, offsets)
            stop = np.append(start[1:], len(points))
            hashes, where, inverse = np.unique(A.Rolling(points).ranges(start, stop), return_index=True, return_inverse=True)
            ids, code = [], "H" if self.dtype.itemsize == 2 else "I"
            for h, a, b in zip(hashes.tolist(), start[where].tolist(), stop[where].tolist(), strict=True):
                own = cache.get(h)
                if own is None:
                    own = array(code, merge.encode_ordinary(joined[a:b])).tobytes()
                    if len(cache) < CACHE:
                        cache[h] = own
                ids.append(own)
            sizes = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids)) // self.dtype.itemsize
            flat = np.frombuffer(b"".join(ids), dtype=self.dtype)
            begin = np.cumsum(sizes) - sizes
            count = sizes[inverse]
            flat = flat[A.spread(begin[inverse], count)]
            first = np.append(0, np.cumsum(count))[np.searchsorted(start, offsets)]
            rows = np.diff(first)
            special = {i: self._whole(texts[i]) for i in odd}
            if special or end is not None:
                close = [] if end is None else [np.array([end], dtype=self.dtype)]
                flat = np.concatenate([x for i in range(len(texts)) for x in (special.get(i, flat[first[i] : first[i + 1]]), *close)])
                rows = np.array([len(special[i]) if i in special else r for i, r in enumerate(rows)]) + len(close)
            yield part, flat, np.append(0, np.cumsum(rows))
