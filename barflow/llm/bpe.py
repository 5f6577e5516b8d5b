"""Byte-level BPE over Arrow text buffers, one pre-token at a time.

A text is cut before every single space that certainly starts a pre-token of the
public byte-level pattern; what lies between two cuts ("chunk") encodes the same
wherever it stands, so its ids can be looked up by a 64-bit hash of its bytes.
Unknown chunks are encoded in one go and kept in a bounded worker cache.  Texts
with a special string, and tokenizers of other kinds, go to the library whole.
"""

from __future__ import annotations

import base64
import json
import os

import numpy as np
import pyarrow as pa

from barflow.llm.common import give_back, spans_hash, text_buffers

#: Chunks longer than this are encoded each time, never looked up: a cache entry stays small, and no long text can be made to share a hash.
LONGEST_CACHED = 64
#: Chunks longer than this go to the tokenizer's own library: the second one overflows its stack on a run of some million spaces.
LONGEST_NEAR = 1 << 16
#: The other byte sequences of Unicode white space: C2 85, C2 A0, E1 9A 80, E2 80 .., E2 81 9F, E3 80 80.
_LEADS = (0xC2, 0xE1, 0xE2, 0xE3)
_SURE = np.ones(256, bool)
_SURE[[9, 10, 11, 12, 13, 28, 29, 30, 31, 32]] = False
_MAYBE = _SURE.copy()
_MAYBE[0x80:] = False


def resolve(name: str) -> str:
    """A path as it is, else the file of that name among the public tokenizers."""
    if os.sep in name or os.path.exists(name):
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


class Table:
    """Sorted 64-bit keys with a length, and with ids if wanted; at most ``most`` keys, then it starts anew."""

    def __init__(self, ids: bool, most: int) -> None:
        self.with_ids, self.most = ids, most
        self.clear()

    def clear(self) -> None:
        self.keys, self.lens, self.starts = np.zeros(0, np.uint64), np.zeros(0, np.int32), np.zeros(0, np.int64)
        self.flat, self.used = np.zeros(1 << 16, np.uint32), 0

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(self.keys):
            return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return at, self.keys[at] == keys

    def put(self, ids: np.ndarray) -> int:
        if self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros(max(len(self.flat), len(ids)), np.uint32)])
        self.flat[self.used : self.used + len(ids)] = ids
        self.used += len(ids)
        return self.used - len(ids)

    def add(self, keys: np.ndarray, lens: np.ndarray, ids: np.ndarray) -> None:
        """keys: new ones, sorted."""
        if len(self.keys) + len(keys) > self.most:
            self.clear()
        starts = np.zeros(len(keys), np.int64)
        if self.with_ids and len(keys):
            starts = self.put(ids) + np.cumsum(lens, dtype=np.int64) - lens
        keys = np.concatenate([self.keys, keys])
        order = np.argsort(keys, kind="stable")
        self.keys, self.lens, self.starts = keys[order], np.concatenate([self.lens, lens])[order], np.concatenate([self.starts, starts])[order]


class Encoder:
    """Ids of whole texts for one tokenizer file."""

    def __init__(self, name: str, cache: int = 1 << 18) -> None:
        self.path = resolve(name)
        self.byte_level, self.special, self.near, self._library = False, [], None, None
        if self.path.endswith(".model"):
            import sentencepiece

            piece = sentencepiece.SentencePieceProcessor(model_file=self.path)
            self._library = lambda texts: piece.encode(texts, num_threads=1)
        else:
            said = json.loads(open(self.path, encoding="utf-8").read())
            pre = said.get("pre_tokenizer") or {}
            self.byte_level = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and not said.get("normalizer") and not said.get("truncation") and not said.get("padding")
            self.special = [x["content"].encode() for x in said.get("added_tokens", [])]
            ranks = self.path.removesuffix(".json") + ".tiktoken"
            size = sum(k.encode() not in self.special for k in said["model"]["vocab"]) if self.byte_level and os.path.exists(ranks) else 0
            del said  # before the next library reads its file
            if size:
                self._alike(ranks, size)
        self.caches = {ids: Table(ids, cache) for ids in (False, True)}

    def library(self, texts: list[str]) -> list[list[int]]:
        """Ids by the tokenizer's own library, which is opened when a text first needs it."""
        if self._library is None:
            os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
            from tokenizers import Tokenizer

            whole = Tokenizer.from_file(self.path)
            self._library = lambda texts: [e.ids for e in whole.encode_batch(texts, add_special_tokens=False)]
        return self._library(texts)

    def _alike(self, ranks: str, size: int) -> None:
        """The same vocabulary in a second library; used for texts of Latin letters only, where both read the pattern alike."""
        import public_tokenizers
        import tiktoken

        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(ranks, "rb"))}
        if len(table) == size:
            self.near = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})
            self.width = np.zeros(max(table.values()) + 1, np.int64)
            self.width[list(table.values())] = [len(k) for k in table]

    def cuts(self, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Where chunks begin; every non-empty text begins one."""
        n = len(raw)
        high = raw >= 0xC2
        odd = bool(high.any()) and any(_has_white(raw, lead) for lead in _LEADS)
        solid = (_MAYBE if odd else _SURE)[raw]
        ok = np.zeros(n, bool)
        ok[1:] = solid[:-1]
        ok[:-1] |= solid[1:]
        edge = offsets[(offsets > 0) & (offsets < n)]
        ok[edge - 1] = solid[edge - 2] & (edge >= 2)  # the last byte of a text: only what stands before it counts
        ok &= raw == 32
        if n:
            ok[offsets[:-1][offsets[:-1] < offsets[1:]]] = True
        return np.flatnonzero(ok)

    def encode_chunks(self, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(lengths, ids one after another) of chunks."""
        data = raw.tobytes()
        parts = [data[s:e] for s, e in zip(starts.tolist(), ends.tolist(), strict=True)]
        lens, out = np.zeros(len(parts), np.int32), [None] * len(parts)
        joined, alone, far = [], [], []
        for k, p in enumerate(parts):
            if self.near is None or len(p) > LONGEST_NEAR or max(p) >= 0xCA:
                far.append(k)
            elif len(p) > 1 and p[0] == 32 and p[1] != 32 and _SURE[p[1]] and not (p[1] == 0xC2 and p[2] in (0x85, 0xA0)):
                joined.append(k)
            else:
                alone.append(k)
        if joined:
            ids = np.array(self.near.encode_ordinary(b"".join(parts[k] for k in joined).decode()), np.uint32)
            ends_at = np.searchsorted(np.cumsum(self.width[ids]), np.cumsum([len(parts[k]) for k in joined])) + 1
            for k, a, b in zip(joined, [0, *ends_at[:-1].tolist()], ends_at.tolist(), strict=True):
                lens[k], out[k] = b - a, ids[a:b]
        for k in alone:
            out[k] = np.array(self.near.encode_ordinary(parts[k].decode()), np.uint32)
            lens[k] = len(out[k])
        if far:
            for k, ids in zip(far, self.library([parts[k].decode() for k in far]), strict=True):
                out[k] = np.array(ids, np.uint32)
                lens[k] = len(ids)
        return lens, np.concatenate(out) if out else np.zeros(0, np.uint32)

    def whole(self, column: pa.Array, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Which texts must go to the library as they are."""
        if not self.byte_level:
            return np.ones(len(column), bool)
        out = np.zeros(len(column), bool)
        if self.special:
            data = raw.tobytes()
            for s in self.special:
                at = data.find(s)
                while at >= 0:
                    out[np.searchsorted(offsets, at, "right") - 1] = True
                    at = data.find(s, at + 1)
        return out

    def look(self, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, ids: bool, hot: tuple[np.ndarray, np.ndarray] | None):
        """(length of each chunk, its place in ``flat``, flat); hot: sorted keys and lengths of the broadcast tier."""
        long = ends - starts > LONGEST_CACHED
        if not long.any():
            return self._look_short(raw, starts, ends, ids, hot)
        lens, place = np.zeros(len(starts), np.int32), np.zeros(len(starts), np.int64)
        lens[~long], place[~long], flat = self._look_short(raw, starts[~long], ends[~long], ids, hot)
        n, got = self.encode_chunks(raw, starts[long], ends[long])
        lens[long] = n
        if ids:
            used = self.caches[ids].used
            place[long] = used + np.cumsum(n, dtype=np.int64) - n
            flat = np.concatenate([flat[:used], got])
        return lens, place, flat

    def _look_short(self, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, ids: bool, hot: tuple[np.ndarray, np.ndarray] | None):
        keys = spans_hash(raw, starts, ends)
        distinct, first, back = np.unique(keys, return_index=True, return_inverse=True)
        lens, place = np.zeros(len(distinct), np.int32), np.zeros(len(distinct), np.int64)
        open_ = np.ones(len(distinct), bool)
        if hot is not None and not ids and len(hot[0]):
            at = np.minimum(np.searchsorted(hot[0], distinct), len(hot[0]) - 1)
            hit = hot[0][at] == distinct
            lens[hit], open_ = hot[1][at[hit]], ~hit
        cache = self.caches[ids]
        todo = np.flatnonzero(open_)
        new = todo[~cache.find(distinct[todo])[1]]
        if len(cache.keys) + len(new) > cache.most:  # it starts anew, and what was found in it is wanted still
            cache.clear()
            new = todo
        if len(new):
            n, got = self.encode_chunks(raw, starts[first[new]], ends[first[new]])
            cache.add(distinct[new], n, got)
        at, _ = cache.find(distinct[todo])
        if len(todo):
            lens[todo], place[todo] = cache.lens[at], cache.starts[at]
        return lens[back], place[back], cache.flat

    def count(self, column: pa.Array, hot: tuple[np.ndarray, np.ndarray] | None = None) -> np.ndarray:
        """Tokens of each text; a null text has none."""
        raw, offsets = text_buffers(column)
        total, whole = np.zeros(len(column), np.int64), self.whole(column, raw, offsets)
        if not whole.all():
            starts = self.cuts(raw, offsets)
            if len(starts):
                ends, of = np.append(starts[1:], len(raw)), np.searchsorted(offsets, starts, "right") - 1
                keep = ~whole[of]
                starts, ends, of = starts[keep], ends[keep], of[keep]
            if len(starts):
                lens, _, _ = self.look(raw, starts, ends, False, hot)
                total = np.bincount(of, lens, len(column)).astype(np.int64)
        if whole.any():
            at = np.flatnonzero(whole)
            total[at] = [len(x) for x in self.library([x or "" for x in column.take(pa.array(at)).to_pylist()])]
        return total

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(number of ids of each text, all ids one after another)."""
        raw, offsets = text_buffers(column)
        whole = self.whole(column, raw, offsets)
        total, ids = np.zeros(len(column), np.int64), np.zeros(0, np.uint32)
        starts = self.cuts(raw, offsets) if not whole.all() else np.zeros(0, np.int64)
        if len(starts):
            ends, of = np.append(starts[1:], len(raw)), np.searchsorted(offsets, starts, "right") - 1
            keep = ~whole[of]
            starts, ends, of = starts[keep], ends[keep], of[keep]
        if len(starts):
            lens, place, flat = self.look(raw, starts, ends, True, None)
            total = np.bincount(of, lens, len(column)).astype(np.int64)
            done = np.cumsum(lens, dtype=np.int64)
            ids = flat[np.repeat(place - (done - lens), lens) + np.arange(done[-1])]
        if whole.any():
            at = np.flatnonzero(whole)
            parts = np.split(ids, np.cumsum(total)[:-1])
            for k, x in zip(at.tolist(), self.library([x or "" for x in column.take(pa.array(at)).to_pylist()]), strict=True):
                parts[k], total[k] = np.array(x, np.uint32), len(x)
            ids = np.concatenate(parts) if parts else ids
        return total, ids


def _has_white(raw: np.ndarray, lead: int) -> bool:
    at = np.flatnonzero(raw[:-1] == lead) if lead != 0xC2 else np.zeros(0, np.int64)
    if lead == 0xC2:
        return bool(((raw[:-1] == 0xC2) & ((raw[1:] == 0x85) | (raw[1:] == 0xA0))).any())
    if not len(at):
        return False
    second, third = raw[at + 1], raw[np.minimum(at + 2, len(raw) - 1)]
    if lead == 0xE1:
        return bool(((second == 0x9A) & (third == 0x80)).any())
    if lead == 0xE3:
        return bool(((second == 0x80) & (third == 0x80)).any())
    return bool((((second == 0x80) & ((third <= 0x8A) | np.isin(third, (0xA8, 0xA9, 0xAF)))) | ((second == 0x81) & (third == 0x9F))).any())


_OPEN: dict[str, Encoder] = {}


def encoder(name: str) -> Encoder:
    """One encoder a worker process and tokenizer."""
    if name not in _OPEN:
        _OPEN[name] = Encoder(name)
        give_back()  # of the file's text and its parsed form
    return _OPEN[name]
