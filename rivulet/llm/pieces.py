"""SentencePiece-style encoding and decoding with a unigram Viterbi search.

Pieces and scores come from a model file.  A double-array trie over their UTF-8
bytes lists the pieces that start at a position; the search keeps the best sum
of log scores per position.  A character that no piece covers falls back to byte
pieces, at ten below the worst piece.  A text is encoded after one leading blank;
blanks are the pieces' marker, and decoding drops the leading one again, so
every valid text comes back exactly.  A literal marker character in a text is
no blank and is written in bytes.

No piece has a blank after another character, so texts are cut before
each run of blanks and every distinct unit of a slice is searched once: short
ones side by side in arrays, long ones one by one.

Model files of the pair-merging kind hold ranks instead of log scores; their
pieces get the log of a Zipf law over the rank.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

MARKER = "▁"
SHORT = 48
CACHE_UNITS = 100_000
FALLBACK_PENALTY = 10.0


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class DoubleArrayTrie:
    """``next = base[state] + byte`` is a child of ``state`` iff ``check[next] == state``; ``value`` is a key's number or -1."""

    def __init__(self, keys: dict[bytes, int]):
        tree: dict[int, dict[int, int]] = {0: {}}
        ends: dict[int, int] = {}
        for key, value in sorted(keys.items()):
            at = 0
            for b in key:
                nxt = tree[at].get(b)
                if nxt is None:
                    nxt = tree[at][b] = len(tree)
                    tree[nxt] = {}
                at = nxt
            ends[at] = value
        size = 2 * len(tree) + 1024
        self.base, self.check, self.value = (np.full(size, k, np.int32) for k in (0, -1, -1))
        free = np.ones(size, bool)
        free[0] = False
        place, low = {0: 0}, 1
        for node, kids_of in tree.items():
            here = place[node]
            self.value[here] = ends.get(node, -1)
            if not kids_of:
                continue
            kids = np.fromiter(kids_of, np.int64, len(kids_of))
            least, span = int(kids.min()), int(kids.max() - kids.min())
            at, first = max(low, least + 1), None
            while first is None:
                if at + 4096 + span >= size:
                    self.base, self.check, self.value = (np.concatenate([x, np.full(size, k, np.int32)]) for x, k in ((self.base, 0), (self.check, -1), (self.value, -1)))
                    free = np.concatenate([free, np.ones(size, bool)])
                    size *= 2
                # free slots that the least child could take
                slots = at + np.flatnonzero(free[at : at + 4096])
                fit = free[slots[:, None] + (kids - least)].all(axis=1) if len(slots) else np.zeros(0, bool)
                if fit.any():
                    first = int(slots[fit.argmax()]) - least
                at += 4096
            self.base[here] = first
            self.check[first + kids] = here
            free[first + kids] = False
            for b, child in kids_of.items():
                place[child] = first + b
            while not free[low : low + 16].any():
                low += 16
        # room for any byte behind the last state
        self.base, self.check, self.value = (np.concatenate([x, np.full(256, k, np.int32)]) for x, k in ((self.base, 0), (self.check, -1), (self.value, -1)))

    def step(self, state: np.ndarray, byte: np.ndarray) -> np.ndarray:
        """Child states, -1 where there is none."""
        nxt = self.base[state] + byte
        return np.where(self.check[nxt] == state, nxt, -1)


class Pieces:
    """The encoder: pieces as bytes with blanks for markers, log scores, byte pieces and the trie."""

    def __init__(self, texts: list[bytes], scores: np.ndarray, byte_ids: np.ndarray):
        normal = {t: i for i, t in enumerate(texts) if t and np.isfinite(scores[i])}
        self.texts, self.scores, self.byte_ids = texts, scores, byte_ids
        self.fallback = float(scores[list(normal.values())].min(initial=0.0)) - FALLBACK_PENALTY
        self.trie = DoubleArrayTrie(normal)
        self.longest = max(map(len, normal), default=1)
        # a piece with a blank after another character would cross units
        self.cut = not any(b" " in t.lstrip(b" ") for t in normal)
        size = np.array([len(t) for t in texts])
        self.offs, self.bytes = np.concatenate([[0], np.cumsum(size)]), np.frombuffer(b"".join(texts), np.uint8)

    @classmethod
    def load(cls, path: str) -> Pieces:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        special = [sp.is_unknown(i) or sp.is_control(i) or sp.is_unused(i) for i in range(n)]
        raw, byte_ids = [], np.full(256, -1, np.int64)
        for i in range(n):
            p = sp.id_to_piece(i)
            if sp.is_byte(i):
                byte_ids[int(p[3:5], 16)] = i
                raw.append(bytes([int(p[3:5], 16)]))
            else:
                raw.append(b"" if special[i] else p.replace(MARKER, " ").encode())
        scores = np.array([-np.inf if special[i] or sp.is_byte(i) else sp.get_score(i) for i in range(n)])
        usable = np.isfinite(scores)
        if (scores[usable] == np.round(scores[usable])).all():
            rank = np.empty(n)
            rank[np.argsort(-scores, kind="stable")] = np.arange(n)
            scores = np.where(usable, -np.log(rank + 2) - np.log(np.log(n + 2)), -np.inf)
        return cls(raw, scores, byte_ids)

    # -- search ---------------------------------------------------------------
    def _short(self, mat: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Back pointers (start, piece or -1) at each end of the units in ``mat`` (unit x byte, 0-padded)."""
        n, width = mat.shape
        best = np.full((width + 1, n), -np.inf)
        best[0] = 0
        back, piece = np.zeros((width + 1, n), np.int16), np.full((width + 1, n), -1, np.int32)
        value, scores = self.trie.value, self.scores
        lead = _CHAR_BYTES[mat]
        for i in range(width):
            live = np.flatnonzero((size > i) & np.isfinite(best[i]))
            if not len(live):
                continue
            chars = lead[live, i].astype(np.int64)
            covered = np.zeros(len(live), bool)
            who, state = np.arange(len(live)), np.zeros(len(live), np.int32)
            for j in range(i, min(i + self.longest, width)):
                state = self.trie.step(state, mat[live[who], j])
                ok = (state >= 0) & (size[live[who]] > j)
                who, state = who[ok], state[ok]
                if not len(who):
                    break
                v = value[state]
                hit = v >= 0
                if hit.any():
                    w, v = who[hit], v[hit]
                    self._offer(best, back, piece, live[w], i, j + 1, best[i, live[w]] + scores[v], v)
                    covered[w[chars[w] == j + 1 - i]] = True
            bare = np.flatnonzero(~covered)
            for c in np.unique(chars[bare]):
                w = live[bare[chars[bare] == c]]
                end = min(i + int(c), width)
                self._offer(best, back, piece, w, i, end, best[i, w] + self.fallback, np.full(len(w), -1, np.int32))
        return back, piece

    @staticmethod
    def _offer(best, back, piece, unit, start, end, score, which):
        better = score > best[end, unit]
        u = unit[better]
        best[end, u], back[end, u], piece[end, u] = score[better], start, which[better]

    def _trace(self, mat: np.ndarray, size: np.ndarray, back: np.ndarray, piece: np.ndarray) -> list[np.ndarray]:
        """Ids of each unit, from the back pointers."""
        at, who = size.copy(), np.arange(len(size))
        steps = []
        while len(who):
            p, s = piece[at[who], who], back[at[who], who].astype(np.int64)
            plain = p >= 0
            steps.append((who[plain], p[plain], at[who][plain] * 4))
            if not plain.all():
                w, a, b = who[~plain], s[~plain], at[who][~plain]
                for k in range(4):
                    have = a + k < b
                    steps.append((w[have], self.byte_ids[mat[w[have], a[have] + k]], b[have] * 4 - 3 + k))
            at[who] = s
            who = who[s > 0]
        unit = np.concatenate([x[0] for x in steps])
        order = np.lexsort((np.concatenate([x[2] for x in steps]), unit))
        ids = np.concatenate([x[1] for x in steps])[order].astype(np.int32)
        return np.split(ids, np.searchsorted(unit[order], np.arange(1, len(size))))

    def long_unit(self, raw: bytes) -> np.ndarray:
        """The same search over one text of any length."""
        base, check, value, scores = self._lists
        n, low = len(raw), -np.inf
        best, back, piece = [low] * (n + 1), [0] * (n + 1), [-1] * (n + 1)
        best[0] = 0.0
        for i in range(n):
            here = best[i]
            if here == low:
                continue
            size, state, covered = _CHARS[raw[i]], 0, False
            for j in range(i, n):
                nxt = base[state] + raw[j]
                if check[nxt] != state:
                    break
                state = nxt
                v = value[state]
                if v >= 0:
                    if here + scores[v] > best[j + 1]:
                        best[j + 1], back[j + 1], piece[j + 1] = here + scores[v], i, v
                    covered |= j + 1 - i == size
            end = min(n, i + size)
            if not covered and here + self.fallback > best[end]:
                best[end], back[end], piece[end] = here + self.fallback, i, -1
        out = []
        while n:
            i = back[n]
            out.extend([piece[n]] if piece[n] >= 0 else [int(self.byte_ids[b]) for b in raw[i:n][::-1]])
            n = i
        return np.array(out[::-1], np.int32)

    @functools.cached_property
    def _lists(self):
        return self.trie.base.tolist(), self.trie.check.tolist(), self.trie.value.tolist(), self.scores.tolist()

    def units(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> list[np.ndarray]:
        """Ids of each unit ``data[start:end]``."""
        size = end - start
        out: list[np.ndarray] = [np.zeros(0, np.int32)] * len(size)
        edge = 0
        for width in (6, 9, 12, 16, 24, 32, SHORT):
            at = np.flatnonzero((size > edge) & (size <= width))
            edge = width
            if len(at):
                cols = np.arange(width)
                inside = cols < size[at, None]
                mat = np.where(inside, data[np.minimum(start[at, None] + cols, len(data) - 1)], 0).astype(np.int64)
                for i, ids in zip(at, self._trace(mat, size[at], *self._short(mat, size[at])), strict=True):
                    out[i] = ids
        for i in np.flatnonzero(size > SHORT):
            out[i] = self.long_unit(data[start[i] : end[i]].tobytes())
        return out

    # -- texts ----------------------------------------------------------------
    def encode(self, texts: pa.Array, cache: dict) -> pa.Array:
        """list<int32> of each text; null stays null.  ``cache`` keeps units between calls."""
        col = texts.cast(pa.large_binary())
        some = pc.greater(pc.binary_length(col), 0)
        col = pc.if_else(pc.fill_null(some, False), pc.binary_join_element_wise(pa.scalar(b" ", pa.large_binary()), pc.fill_null(col, b""), pa.scalar(b"", pa.large_binary())), pa.scalar(b"", pa.large_binary()))
        data, offs = common.flat(col)
        n = len(data)
        if not n:
            return pa.ListArray.from_arrays(pa.array(np.zeros(len(texts) + 1, np.int32)), pa.array([], pa.int32()), mask=pc.is_null(texts))
        first = np.zeros(n, bool)
        if self.cut:
            first[1:] = (data[1:] == 32) & (data[:-1] != 32)
        first[offs[:-1][np.diff(offs) > 0]] = True
        start = np.flatnonzero(first)
        end = np.append(start[1:], n)
        raw, number = data.tobytes(), {}
        which = np.fromiter((number.setdefault(raw[a:b], len(number)) for a, b in zip(start.tolist(), end.tolist(), strict=True)), np.int64, len(start))
        keys, one = list(number), np.empty(len(number), np.int64)
        one[which] = np.arange(len(which))
        new = [k for k, key in enumerate(keys) if key not in cache]
        if new:
            if len(cache) > CACHE_UNITS:
                cache.clear()
                new = list(range(len(keys)))
            at = one[new]
            for k, ids in zip(new, self.units(data, start[at], end[at]), strict=True):
                cache[keys[k]] = ids
        got = [cache[k] for k in keys]
        size = np.fromiter(map(len, got), np.int64, len(got))
        flat_ids, lo = np.concatenate(got), np.concatenate([[0], np.cumsum(size)])
        n_ids = size[which]
        at = np.concatenate([[0], np.cumsum(n_ids)])
        ids = flat_ids[np.repeat(lo[which] - at[:-1], n_ids) + np.arange(at[-1])]
        rows = at[np.searchsorted(start, offs)]
        return pa.ListArray.from_arrays(pa.array(rows.astype(np.int32)), pa.array(ids), mask=pc.is_null(texts))

    def decode(self, ids: pa.Array) -> pa.Array:
        """Text of each list of ids; ids outside the table add nothing."""
        ids = ids.cast(pa.large_list(pa.int32()))
        offs = np.asarray(ids.offsets)
        x = np.asarray(ids.values.fill_null(-1)).astype(np.int64)[offs[0] : offs[-1]]
        offs = offs - offs[0]
        ok = (x >= 0) & (x < len(self.texts))
        x = np.where(ok, x, 0)
        size = np.where(ok, np.diff(self.offs)[x], 0)
        at = np.concatenate([[0], np.cumsum(size)])
        data = self.bytes[np.repeat(self.offs[x] - at[:-1], size) + np.arange(at[-1])]
        ends = at[offs]
        lead = (np.diff(ends) > 0) & (np.append(data, 0)[np.minimum(ends[:-1], len(data))] == 32)
        keep = np.ones(len(data), bool)
        keep[ends[:-1][lead]] = False
        ends = np.concatenate([[0], np.cumsum(np.diff(ends) - lead)])
        raw = data[keep].tobytes()
        null = ids.is_null().to_pylist()
        return pa.array([None if m else raw[a:b].decode("utf-8", "replace") for a, b, m in zip(ends[:-1].tolist(), ends[1:].tolist(), null, strict=True)], pa.string())


#: Bytes of a character by its first byte; a stray continuation byte counts as one.
_CHAR_BYTES = np.ones(256, np.int64)
_CHAR_BYTES[0xC0:0xE0], _CHAR_BYTES[0xE0:0xF0], _CHAR_BYTES[0xF0:] = 2, 3, 4
_CHARS = _CHAR_BYTES.tolist()


def encode(docs: DataFrame, pieces: Pieces, text: str = "text", ids: str = "ids") -> DataFrame:
    """``docs`` with ``ids`` array<int>.

    A null text has null ids, an empty one none.  All other columns, repeated rows and
    their values stay; a column named like the new one gives way to it.
    """
    keep = [c for c in docs.columns if c != ids]
    shared = docs.sparkSession.sparkContext.broadcast(pieces)
    schema = docs.select(*keep, F.lit(None).cast("array<int>").alias(ids)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict = {}
        for batch in batches:
            for part in common.slices(batch):
                yield pa.record_batch([*[part.column(c) for c in keep], shared.value.encode(part.column(text), cache)], names=[*keep, ids])

    common.small_batches(docs.sparkSession)
    return docs.select(*keep).mapInArrow(run, schema)


def decode(rows: DataFrame, pieces: Pieces, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """``rows`` with the text of ``ids``; null ids give null."""
    keep = [c for c in rows.columns if c != text]
    shared = rows.sparkSession.sparkContext.broadcast(pieces)
    schema = rows.select(*keep, F.lit(None).cast("string").alias(text)).schema

    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        return pa.record_batch([*[part.column(c) for c in keep], shared.value.decode(part.column(ids))], names=[*keep, text])

    return common.map_arrow(rows.select(*keep), run, schema)


def encoded_and_checked(docs: DataFrame, model: str | None = None) -> DataFrame:
    """(doc_id, ids, n_pieces, round_trip): every text encoded, decoded and compared with itself in one pass."""
    pieces = Pieces.load(model or default_model())
    shared = docs.sparkSession.sparkContext.broadcast(pieces)
    src = docs.select("doc_id", "text")
    schema = src.select("doc_id", F.lit(None).cast("array<int>").alias("ids"), F.lit(0).cast("long").alias("n_pieces"), F.lit(True).alias("round_trip")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict = {}
        for batch in batches:
            for part in common.slices(batch):
                text = part.column(1)
                ids = shared.value.encode(text, cache)
                back = shared.value.decode(ids)
                same = pc.or_kleene(pc.fill_null(pc.equal(back, text.cast(pa.string())), False), pc.and_(pc.is_null(back), pc.is_null(text)))
                yield pa.record_batch([part.column(0), ids, pc.fill_null(pc.list_value_length(ids), 0).cast(pa.int64()), same], names=["doc_id", "ids", "n_pieces", "round_trip"])

    common.small_batches(docs.sparkSession)
    return src.mapInArrow(run, schema)


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of ``documents`` encoded, with the check that decoding gives the text back."""
    return encoded_and_checked(common.table(spark, sf_dir, "documents"))
