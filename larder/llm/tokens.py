"""Whole-text token ids from a public tokenizer file, batch by batch.

A space before a non-space character always starts a new pre-token of the
byte-level pattern, so a text can be cut there without changing its ids.  Cut
pieces repeat a lot: each distinct piece of a batch is encoded once, and the
ids of recent pieces are kept in the worker (at most ``CACHE`` of them).
"""

from __future__ import annotations

import json
import os
import re
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CACHE = 600_000
BATCH_CHARS = 8_000_000
# A space before white space, before the end or beside a NUL: such a text is cut in Python.
CUT = re.compile(r"(?= [A-Za-z0-9])")
START = re.compile(r" [^\s\x1c-\x1f\x85]")     # a space and no white space: a token begins here
JOINED = 200                 # pieces that are encoded as one text
ODD = r" ([\s\x0b\x1c-\x1f\x{85}\p{Z}]|$)|\x00"


def default_path() -> str:
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json")


class PieceEncoder:
    """Ids of texts by one tokenizer file."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"   # one core per Spark task
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        parts = json.loads(self.tokenizer.to_str())
        first, last = parts.get("pre_tokenizer") or {}, parts.get("decoder") or {}
        if parts.get("normalizer") or first.get("type") != "ByteLevel" or last.get("type") != "ByteLevel" \
                or first.get("add_prefix_space") or not first.get("use_regex", True):
            raise ValueError(f"{path} is no plain byte-level tokenizer: texts could not be cut at spaces without changing its ids")
        self.tokenizer.encode_special_tokens = True      # their strings are ordinary text here
        self.known: dict[str, bytes] = {}                # little-endian ids of a piece
        self.old: dict[str, bytes] = {}
        self.sizes: np.ndarray | None = None

    def token_bytes(self) -> np.ndarray:
        """Bytes of each id (a byte-level token has one character per byte)."""
        if self.sizes is None:
            n = self.tokenizer.get_vocab_size()
            self.sizes = np.array([len(self.tokenizer.id_to_token(i) or "") for i in range(n)], dtype=np.int64)
        return self.sizes

    def _encoded(self, pieces: list[str]) -> list[bytes]:
        """Ids of pieces that no cache knows.

        Pieces that begin with a space and no other white space are encoded many at a time as
        one text, which cannot change their ids, and its ids are parted again by their bytes.
        """
        texts, first, held = [], [], 0
        starts = START.match
        for i, p in enumerate(pieces):
            if held == JOINED or not texts or not starts(p):
                texts.append([])
                first.append(i)
                held = 0
            texts[-1].append(p)
            held += 1
        out: list = [None] * len(pieces)
        sizes = self.token_bytes()
        for at in range(0, len(texts), 512):
            group = texts[at:at + 512]
            found = self.tokenizer.encode_batch_fast(["".join(t) for t in group], add_special_tokens=False)
            for t, start, e in zip(group, first[at:at + 512], found):
                ids = np.array(e.ids, "<u4")
                ends = np.cumsum([len(p) if p.isascii() else len(p.encode("utf-8", "replace")) for p in t])
                upto = np.cumsum(sizes[ids])
                cut = np.searchsorted(upto, ends, side="left") + 1
                if len(t) > 1 and not (cut[-1] <= len(upto) and np.array_equal(upto[cut - 1], ends)):
                    parts = [np.array(x.ids, "<u4") for x in self.tokenizer.encode_batch_fast(t, add_special_tokens=False)]
                    out[start:start + len(t)] = [x.tobytes() for x in parts]
                    continue
                raw = ids.tobytes()
                if len(t) == 1:
                    out[start] = raw
                    continue
                stops = (4 * cut).tolist()
                out[start:start + len(t)] = [raw[a:b] for a, b in zip([0, *stops], stops)]
        return out

    def _ids(self, pieces: list[str]) -> list[bytes]:
        if len(self.known) > CACHE // 2:                 # two generations: what is still in use moves on
            self.old, self.known = self.known, {}
        known, old = self.known, self.old
        out = list(map(known.get, pieces))
        missing = []
        for i, x in enumerate(out):
            if x is None:
                p = pieces[i]
                x = old.get(p)
                if x is None:
                    missing.append(i)
                else:
                    out[i] = known[p] = x
        new = [pieces[i] for i in missing]
        for i, p, x in zip(missing, new, self._encoded(new)):
            out[i] = x
            if len(p) <= 64:
                known[p] = x
        return out

    def _lookup(self, flat: pa.Array, offsets: np.ndarray) -> list[np.ndarray]:
        coded = flat.dictionary_encode()
        which = np.asarray(coded.indices)
        ids = self._ids(coded.dictionary.to_pylist())
        ends = np.concatenate([[0], np.cumsum(np.fromiter(map(len, ids), np.int64, len(ids))[which] // 4)])[offsets]
        pool = np.frombuffer(b"".join(map(ids.__getitem__, which.tolist())), dtype="<u4")
        return [pool[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        if not texts:
            return []
        column = pa.array(texts, pa.large_string())
        odd = np.asarray(pc.match_substring_regex(column, ODD))
        plain = column.filter(pa.array(~odd))
        out: list = [None] * len(texts)
        if len(plain):
            lists = pc.split_pattern(pc.replace_substring(plain, " ", "\x00 "), "\x00")
            offsets = np.asarray(lists.offsets)
            for i, ids in zip(np.flatnonzero(~odd).tolist(), self._lookup(lists.flatten(), offsets - offsets[0])):
                out[i] = ids
        if odd.any():
            where = np.flatnonzero(odd).tolist()
            cut = [CUT.split(texts[i]) for i in where]
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in cut])])
            flat = pa.array(list(chain.from_iterable(cut)), pa.large_string())
            for i, ids in zip(where, self._lookup(flat, offsets)):
                out[i] = ids
        return out

    def each(self, texts: list[str]):
        """Ids of each text in turn, encoded in groups of about ``BATCH_CHARS`` characters."""
        group: list[str] = []
        chars = 0
        for t in texts:
            group.append(t)
            chars += len(t)
            if chars >= BATCH_CHARS:
                yield from self.encode(group)
                group, chars = [], 0
        yield from self.encode(group)

@cache
def encoder(path: str) -> PieceEncoder:
    """One encoder per worker process and file."""
    return PieceEncoder(path)
