"""Encoders of whole texts: a tiktoken one and a memoising one on the tokenizers library.

Both keep one encoder in each Python worker, as building one reads a vocabulary file.
"""

from __future__ import annotations

import base64
import os
import re
from array import array
from functools import lru_cache

import numpy as np
import regex

from siltstone.llm.common import held

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark already runs a worker on each core

#: Characters after which a long text may be cut.
CUT_CHARS = 1 << 16
#: A match of the split pattern always ends between a letter or digit and one of these, and never looks back over it.
_CUT = regex.compile(r"(?<=[\p{L}\p{N}])(?=[ \n])")


def split_safely(text: str, size: int = CUT_CHARS) -> list[str]:
    """Cut a long text in parts that encode to the same ids as the whole.

    A cut lies between a letter or digit and a space or newline: no alternative of the split pattern spans that
    place, and no look-ahead of a match before it reaches over it. A text without such a place stays whole.
    """
    if len(text) <= size:
        return [text]
    parts, start = [], 0
    while len(text) - start > size:
        m = _CUT.search(text, start + size)
        if m is None:
            break
        parts.append(text[start : m.start()])
        start = m.start()
    parts.append(text[start:])
    return parts


@lru_cache(4)
def rank_encoder(path: str, pattern: str):
    """A tiktoken encoder from a local rank file, without special tokens."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def encode_ranks(encoder, text: str) -> np.ndarray:
    """All ids of a text, uint32."""
    parts = [encoder.encode_to_numpy(p, disallowed_special=()) for p in split_safely(text)]
    return parts[0] if len(parts) == 1 else np.concatenate(parts)


#: White space beyond blank, tab and line ends: texts with it, or with runs the chunks cannot cut, are encoded whole.
_ODD_SPACE = re.compile("[\\x0b\\x0c\\x1c-\\x1f\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]")
#: Chunks that end where every match of a byte-level split pattern ends: Latin letters before a blank, a full stop,
#: a comma or a newline, and anything else up to white space.
_CHUNK = re.compile(r"[ \n]?[A-Za-zÀ-ÖØ-öø-ÿ]+(?=[ .,\n])|[ \t\n\r]*[^ \t\n\r]+|[ \t\n\r]+")


#: Unseen chunks encoded by one call.
_JOIN = 500


class MemoEncoder:
    """Byte-level BPE by the tokenizers library, with the ids of chunks remembered.

    A text is cut in chunks at places where the split pattern always ends a match; only chunks not seen before go
    through the library. Two generations of about ``keep`` chunks bound the memory. The strings of special tokens that
    a text holds become those tokens, as the library does it; such texts are encoded whole.
    """

    def __init__(self, path: str, keep: int = 450_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(map(re.escape, added)) or "(?!)")
        self.code = "H" if self.tokenizer.get_vocab_size() <= 1 << 16 else "I"
        self.keep, self.young, self.old = keep, {}, {}
        # in a byte-level vocabulary each character of a token's name stands for one byte
        vocabulary = self.tokenizer.get_vocab()
        self.lengths = np.zeros(max(vocabulary.values()) + 1, np.int64)
        self.lengths[list(vocabulary.values())] = [len(name) for name in vocabulary]

    def _lookup(self, chunks: list[str]) -> list[bytes]:
        """The ids of each chunk, as bytes."""
        young, old, code = self.young, self.old, self.code
        out = list(map(young.get, chunks))
        unseen = []
        for i, v in enumerate(out):
            if v is None:
                v = old.get(chunks[i])
                if v is None:
                    unseen.append(i)
                else:
                    out[i] = young[chunks[i]] = v
        alone, joined = [], []
        for i in unseen:
            c = chunks[i]
            (joined if c[0] == " " and c[1:].isalpha() else alone).append(i)
        for k in range(0, len(joined), _JOIN):
            part = joined[k : k + _JOIN]
            got = self._joined([chunks[i] for i in part])
            if got is None:
                alone += part
            else:
                for i, raw in zip(part, got):
                    out[i] = young[chunks[i]] = raw
        for i, e in zip(alone, self.tokenizer.encode_batch_fast([chunks[i] for i in alone], add_special_tokens=False)):
            out[i] = young[chunks[i]] = array(code, e.ids).tobytes()
        if len(young) > self.keep:
            self.old, self.young = young, {}
        return out

    def _joined(self, chunks: list[str]) -> list[bytes] | None:
        """The ids of chunks that are a blank and letters, from one call: each is one match, also side by side.

        Byte lengths of the ids say where a chunk ends; None if an id should span an end.
        """
        ids = np.array(self.tokenizer.encode_batch_fast(["".join(chunks)], add_special_tokens=False)[0].ids)
        ends = np.cumsum([len(c.encode()) for c in chunks])
        reached = np.cumsum(self.lengths[ids])
        at = np.searchsorted(reached, ends)
        if at[-1] != len(ids) - 1 or (reached[at] != ends).any():
            return None
        raw, size = ids.astype(self.code).tobytes(), array(self.code).itemsize
        cuts = [0, *((at + 1) * size).tolist()]
        return [raw[i:j] for i, j in zip(cuts, cuts[1:])]

    def _whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text, uint32."""
        import pyarrow as pa

        done: dict[int, np.ndarray] = {}
        flat: list[str] = []
        ends, rows = [0], []
        for i, t in enumerate(texts):
            if _ODD_SPACE.search(t) or self.special.search(t):
                done[i] = self._whole(t)
            else:
                flat += _CHUNK.findall(t)
                ends.append(len(flat))
                rows.append(i)
        if flat:
            coded = pa.array(flat, pa.large_string()).dictionary_encode()
            values = self._lookup(coded.dictionary.to_pylist())
            pool = np.frombuffer(b"".join(values), self.code)
            sizes = np.fromiter(map(len, values), np.int64, len(values)) // pool.itemsize
            starts = np.cumsum(sizes) - sizes
            of = coded.indices.to_numpy()
            n = sizes[of]
            stops = np.cumsum(n)
            ids = pool[np.repeat(starts[of] - (stops - n), n) + np.arange(stops[-1])].astype(np.uint32)
            bounds = np.concatenate([[0], stops])[ends]
        else:
            ids, bounds = np.zeros(0, np.uint32), np.zeros(len(ends), np.int64)
        for k, i in enumerate(rows):
            done[i] = ids[bounds[k] : bounds[k + 1]]
        return [done[i] for i in range(len(texts))]


def memo_encoder(path: str) -> MemoEncoder:
    return held(("encoder", path), lambda: MemoEncoder(path))


#: Bytes of text encoded together at most, one text at least.
GROUP_BYTES = 4 << 20


def small_batches(batches, column: int, most: int = GROUP_BYTES):
    """The rows of Arrow batches in slices of about ``most`` bytes of a column, one row at least: however long values
    are, what Python holds of them at once is bounded."""
    for b in batches:
        if not b.num_rows:
            continue
        step = max(1, b.num_rows * most // max(1, b.column(column).nbytes))
        for k in range(0, b.num_rows, step):
            yield b.slice(k, step)


def grouped(batches, column: str = "text", most: int = GROUP_BYTES):
    """Arrow batches as lists of (table of rows, texts) of about ``most`` bytes; a null text is empty."""
    import pyarrow as pa

    held, size = [], 0
    for b in batches:
        at = b.schema.get_field_index(column)
        step = max(1, b.num_rows * most // max(1, b.column(at).nbytes))
        for k in range(0, b.num_rows, step):
            part = b.slice(k, step)
            held.append(part)
            size += part.column(at).nbytes
            if size >= most:
                yield (t := pa.Table.from_batches(held)), [x or "" for x in t.column(column).to_pylist()]
                held, size = [], 0
    if held:
        yield (t := pa.Table.from_batches(held)), [x or "" for x in t.column(column).to_pylist()]
