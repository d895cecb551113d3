"""SentencePiece encoding and decoding by suffix arrays.

A block of text is cut into stretches: one or more blanks (as ``▁``) with
what follows up to the next blank or line end. No piece of the vocabulary
reaches across, so every different stretch is encoded once. The different
stretches of a block are concatenated and indexed by a suffix array (order 16,
the longest piece); every piece of the vocabulary is looked up in it by
bisection and so yields all places where it stands. These edges, sorted by
where they end, are relaxed from left to right.

The vocabulary is a byte-pair one: its encoding is fixed by the order of
merges, not by a sum of scores. For each end of a prefix exactly one edge
continues the encoding of the prefix before it: the one whose piece and the
piece before it would not merge differently across their border. So the
relaxation keeps, per position, the one edge that passes this test. The test
undoes merges along the border and is run for all new pairs at once.

Characters without a piece fall back to byte pieces. A stretch with several
blanks, or longer than ``LONG`` characters, is encoded by the merges
themselves, with a heap.

Cases: null and empty texts have no pieces; a text's own ``▁`` is a blank, as
in the library; repeated rows get one result each; whole texts are read.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from roadsky.llm.common import bounds, chunks, fresh, ranges, table

#: Where the public vocabulary file lies; only the driver opens it.
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: Longest piece in characters, and so the order of the suffix array.
ORDER = 16
LONG = 64
#: Different stretches that a task remembers, at most.
REMEMBERED = 200_000
_STRETCH = re.compile("▁+[^▁\n]*|[^▁\n]+|\n")
_ALIEN = 0xFFFF
_SLOTS = 1 << 20


@dataclass
class Vocabulary:
    """Pieces by rank of their merge (0 first): texts, ids, the last merge of each, and which pairs merge to what."""

    texts: list[str]
    ids: np.ndarray
    byte_ids: np.ndarray
    left: np.ndarray
    right: np.ndarray
    pairs: np.ndarray
    merged: np.ndarray
    rank: dict[str, int]
    decoded: list[bytes]

    @classmethod
    def load(cls, path: str = MODEL) -> Vocabulary:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        special = [model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i) for i in range(n)]
        piece = [model.id_to_piece(i) for i in range(n)]
        plain = sorted((i for i in range(n) if not special[i]), key=lambda i: (-model.get_score(i), i))
        bytes_of = np.zeros(256, np.int64)
        decoded = [b""] * n
        for i in range(n):
            if model.is_byte(i):
                bytes_of[int(piece[i][3:5], 16)] = i
                decoded[i] = bytes([int(piece[i][3:5], 16)])
            elif not special[i]:
                decoded[i] = piece[i].replace("▁", " ").encode()
        return cls.of([piece[i] for i in plain], np.array(plain), bytes_of, decoded)

    @classmethod
    def of(cls, texts: list[str], ids: np.ndarray, byte_ids: np.ndarray, decoded: list[bytes]) -> Vocabulary:
        rank = {t: r for r, t in enumerate(texts)}
        left = np.arange(len(texts))
        right = left.copy()
        pairs, merged = [], []
        for r, text in enumerate(texts):
            for cut in range(1, len(text)):
                a, b = rank.get(text[:cut]), rank.get(text[cut:])
                if a is not None and b is not None:
                    pairs.append(a << 16 | b)
                    merged.append(r)
            if len(text) > 1 and set(text) != {"▁"}:
                parts = merge(text, rank, r)
                if len(parts) == 2:
                    left[r], right[r] = rank[parts[0]], rank[parts[1]]
                else:
                    left[r] = -1  # merges never lead to this piece
        order = np.argsort(pairs) if pairs else np.zeros(0, np.int64)
        return cls(
            texts, ids, byte_ids, left, right,
            np.array(pairs, np.int64)[order], np.array(merged, np.int64)[order], rank, decoded,
        )

    def fits(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """Whether two pieces stay apart when their texts stand together, for each pair."""
        out = np.ones(len(first), bool)
        live = np.flatnonzero((first != _ALIEN) & (second != _ALIEN))
        a, b = first[live].copy(), second[live].copy()
        limit = np.full(len(live), 1 << 40)
        while len(live):
            code = a << 16 | b
            at = np.minimum(np.searchsorted(self.pairs, code), len(self.pairs) - 1)
            wrong = (self.pairs[at] == code) & (self.merged[at] < limit)
            out[live[wrong]] = False
            # undo the later merge of the two; where one cannot be undone, the other
            undo_a = a > b
            whole_a, whole_b = self.left[a] == a, self.left[b] == b
            use_a = (undo_a & ~whole_a) | (~undo_a & whole_b & ~whole_a)
            use_b = (~undo_a & ~whole_b) | (undo_a & whole_a & ~whole_b)
            limit = np.where(use_a, a, np.where(use_b, b + 1, limit))
            a, b = np.where(use_a, self.right[a], a), np.where(use_b, self.left[b], b)
            more = ~wrong & (use_a | use_b)
            live, a, b, limit = live[more], a[more], b[more], limit[more]
        return out


def merge(text: str, rank: dict[str, int], below: int | None = None) -> list[str]:
    """Pieces of ``text`` by the merges themselves: the first-ranked pair, the leftmost of equals, until none is left.

    With ``below`` only merges of a smaller rank are made.
    """
    parts: list = list(text)
    after, before = list(range(1, len(parts) + 1)), list(range(-1, len(parts) - 1))
    heap: list = []

    def offer(i: int) -> None:
        j = after[i] if i >= 0 else len(parts)
        if i >= 0 and j < len(parts):
            r = rank.get(parts[i] + parts[j])
            if r is not None and (below is None or r < below):
                heapq.heappush(heap, (r, i, parts[i] + parts[j]))

    for i in range(len(parts)):
        offer(i)
    while heap:
        _, i, whole = heapq.heappop(heap)
        j = after[i]
        if parts[i] is None or j >= len(parts) or parts[i] + parts[j] != whole:
            continue
        parts[i], parts[j] = whole, None
        after[i] = after[j]
        if after[j] < len(parts):
            before[after[j]] = i
        offer(before[i])
        offer(i)
    return [p for p in parts if p is not None]


class Index:
    """The suffix array of concatenated stretches: all suffixes sorted by their first ``ORDER`` characters."""

    def __init__(self, codes: np.ndarray):
        padded = np.concatenate([codes, np.zeros(ORDER, np.uint64)])
        n = len(codes)
        four = (padded[: n + 12] << np.uint64(48)) | (padded[1 : n + 13] << np.uint64(32)) | (padded[2 : n + 14] << np.uint64(16)) | padded[3 : n + 15]
        self.keys = [four[4 * i : n + 4 * i] for i in range(4)]
        ranks = self._ranks(four)
        for step in (4, 8):
            joined = np.concatenate([ranks, np.zeros(step, np.uint64)])
            ranks = self._ranks((joined[:-step] << np.uint64(32)) | joined[step:])
        self.suffixes = np.argsort(ranks[:n])

    @staticmethod
    def _ranks(keys: np.ndarray) -> np.ndarray:
        order = np.argsort(keys)
        ordered = keys[order]
        out = np.empty(len(keys), np.uint64)
        out[order] = np.cumsum(np.concatenate([[0], ordered[1:] != ordered[:-1]]))
        return out

    def bisect(self, wanted: np.ndarray, right: bool) -> np.ndarray:
        """For each row of four keys the first place whose suffix is not below it (or, right, is above it)."""
        low, high = np.zeros(len(wanted), np.int64), np.full(len(wanted), len(self.suffixes))
        while (low < high).any():
            middle = (low + high) // 2
            suffix = self.suffixes[np.minimum(middle, len(self.suffixes) - 1)]
            less, equal = np.zeros(len(wanted), bool), np.ones(len(wanted), bool)
            for i, key in enumerate(self.keys):
                mine = key[suffix]
                less |= equal & (mine < wanted[:, i])
                equal &= mine == wanted[:, i]
            go = (less | equal if right else less) & (low < high)
            low, high = np.where(go, middle + 1, low), np.where(go | (low >= high), high, middle)
        return low


class Encoder:
    """Encodes blocks of texts; holds the pieces' keys and what it has learnt about stretches and pairs."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.letters = np.array(sorted({ord(c) for t in vocabulary.texts for c in t}), np.uint32)
        usable = [r for r, t in enumerate(vocabulary.texts) if vocabulary.left[r] >= 0]
        if any(len(vocabulary.texts[r]) > ORDER for r in usable):
            raise ValueError(f"the vocabulary has pieces of more than {ORDER} characters: a suffix array of that order cannot find them")
        self.pieces = np.array(usable, np.int64)
        self.lengths = np.array([len(vocabulary.texts[r]) for r in usable], np.int64)
        flat = self._codes("".join(vocabulary.texts[r].ljust(ORDER, "\n") for r in usable)).reshape(-1, ORDER)
        inside = np.arange(ORDER) < self.lengths[:, None]
        self.low = self._pack(np.where(inside, flat, 0))
        self.high = self._pack(np.where(inside, flat, _ALIEN))
        self.slots = np.full(_SLOTS, -1, np.int64)
        self.known = np.zeros(_SLOTS, bool)
        self.by_piece = np.append(vocabulary.ids, 0)
        self.forget()

    def forget(self) -> None:
        self.index: dict[str, int] = {"\n": 0}
        self.flat = [np.array([self.v.byte_ids[10]])]
        self.sizes = [np.array([1])]

    def _codes(self, text: str) -> np.ndarray:
        """Per character its place among the vocabulary's letters from 1, or 0."""
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        at = np.minimum(np.searchsorted(self.letters, points), len(self.letters) - 1)
        return np.where(self.letters[at] == points, at + 1, 0).astype(np.uint64)

    @staticmethod
    def _pack(rows: np.ndarray) -> np.ndarray:
        r = rows.astype(np.uint64).reshape(len(rows), ORDER // 4, 4)
        return (r[:, :, 0] << np.uint64(48)) | (r[:, :, 1] << np.uint64(32)) | (r[:, :, 2] << np.uint64(16)) | r[:, :, 3]

    def fits(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """``Vocabulary.fits`` behind a table of pairs seen before."""
        code = first << 16 | second
        slot = ((code.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(44)).astype(np.int64)
        out = self.known[slot]
        new = np.flatnonzero(self.slots[slot] != code)
        if len(new):
            fresh, back = np.unique(code[new], return_inverse=True)
            value = self.v.fits(fresh >> 16, fresh & 0xFFFF)
            out[new] = value[back]
            self.slots[slot[new]], self.known[slot[new]] = code[new], out[new]
        return out

    def edges(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, piece, length) of every place of every piece, from ranges of the suffix array."""
        index = Index(codes)
        low = index.bisect(self.low, False)
        count = index.bisect(self.high, True) - low
        start = index.suffixes[ranges(low, count)]
        alien = np.flatnonzero(codes == 0)
        return (
            np.concatenate([start, alien]),
            np.concatenate([np.repeat(self.pieces, count), np.full(len(alien), _ALIEN)]),
            np.concatenate([np.repeat(self.lengths, count), np.ones(len(alien), np.int64)]),
        )

    def relax(self, codes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Per position the last piece of the encoding of the stretch up to there, and where that piece starts."""
        start, piece, length = self.edges(codes)
        stretch = np.repeat(np.arange(len(first) - 1), np.diff(first))
        end = start + length
        inside = end <= first[stretch[start] + 1]
        start, piece, end = start[inside], piece[inside], end[inside]
        offset = end - first[stretch[start]]
        order = np.argsort(offset, kind="stable")
        start, piece, end = start[order], piece[order], end[order]
        stops = bounds(np.bincount(offset))
        last, origin = np.full(len(codes) + 1, -1, np.int64), np.full(len(codes) + 1, -1, np.int64)
        begins = np.zeros(len(codes) + 1, bool)
        begins[first[:-1]] = True
        for a, b in zip(stops[:-1].tolist(), stops[1:].tolist(), strict=True):
            s, p, e = start[a:b], piece[a:b], end[a:b]
            head = begins[s]
            good = head.copy()
            rest = np.flatnonzero(~head)
            rest = rest[last[s[rest]] >= 0]
            good[rest] = self.fits(last[s[rest]], p[rest])
            last[e[good]], origin[e[good]] = p[good], s[good]
            # the end of a stretch is the start of the next one: remember it by its own
        return last, origin

    def learn(self, stretches: list[str]) -> None:
        """Encode stretches not met before."""
        fresh = [s for s in stretches if len(s) <= LONG and not s.startswith("▁▁")]
        odd = [s for s in stretches if len(s) > LONG or s.startswith("▁▁")]
        if fresh:
            # a character that no piece holds keeps stretches apart
            text = "\n".join(fresh) + "\n"
            codes = self._codes(text)
            sizes = np.fromiter(map(len, fresh), np.int64, len(fresh)) + 1
            first = bounds(sizes)
            last, origin = self.relax(codes, first)
            at = first[1:] - 1  # where each stretch ends; its line end is not encoded
            owner, step, found = np.arange(len(fresh)), 0, []
            while len(at):
                found.append((owner, np.full(len(at), step), last[at], origin[at]))
                at, owner, step = origin[at], owner, step + 1
                more = at > first[owner]
                at, owner = at[more], owner[more]
            owner, step, piece, begin = (np.concatenate(x) for x in zip(*found, strict=True))
            order = np.lexsort((-step, owner))
            self._keep(fresh, owner[order], piece[order], begin[order], text)
        for s in odd:
            ids = [i for p in merge(s, self.v.rank) for i in self._ids_of(p)]
            self.index[s] = len(self.index)
            self.flat.append(np.array(ids, np.int64))
            self.sizes.append(np.array([len(ids)]))

    def _ids_of(self, part: str) -> list[int]:
        if part in self.v.rank:
            return [int(self.v.ids[self.v.rank[part]])]
        return [int(self.v.byte_ids[b]) for b in part.encode("utf-8", "surrogatepass")]

    def _keep(self, fresh: list[str], owner: np.ndarray, piece: np.ndarray, begin: np.ndarray, text: str) -> None:
        ids = np.where(piece == _ALIEN, -1, self.by_piece[np.minimum(piece, len(self.by_piece) - 1)])
        alien = np.flatnonzero(piece == _ALIEN)
        if len(alien):
            raw = [self.v.byte_ids[list(text[i].encode("utf-8", "surrogatepass"))] for i in begin[alien].tolist()]
            counts = np.ones(len(ids), np.int64)
            counts[alien] = [len(r) for r in raw]
            ids, owner = np.repeat(ids, counts), np.repeat(owner, counts)
            ids[np.repeat(piece == _ALIEN, counts)] = np.concatenate(raw)
        self.flat.append(ids)
        self.sizes.append(np.bincount(owner, minlength=len(fresh)))
        at = len(self.index)
        self.index.update(zip(fresh, range(at, at + len(fresh)), strict=True))

    def encode(self, texts: list) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, and where each text's ids start."""
        if len(self.index) > REMEMBERED:
            self.forget()
        cut = [stretches_of(t) for t in texts]
        self.learn([s for s in dict.fromkeys(s for c in cut for s in c) if s not in self.index])
        self.flat, self.sizes = [np.concatenate(self.flat)], [np.concatenate(self.sizes)]
        at = bounds(self.sizes[0])
        get = self.index.__getitem__
        used = np.fromiter((get(s) for c in cut for s in c), np.int64, sum(map(len, cut)))
        counts = self.sizes[0][used]
        ids = self.flat[0][ranges(at[used], counts)]
        per_text = bounds(counts)[bounds(np.fromiter(map(len, cut), np.int64, len(cut)))]
        return ids, per_text


def stretches_of(text: str | None) -> list[str]:
    if not text:
        return []
    whole = "▁" + text.replace(" ", "▁")
    if "▁▁" in whole or "\0" in whole:
        return _STRETCH.findall(whole)
    return [s for s in whole.replace("▁", "\0▁").replace("\n", "\0\n\0").split("\0") if s]


class Decoder:
    """Bytes of ids: pieces one after the other, the blank in front dropped."""

    def __init__(self, decoded: list[bytes]):
        self.data = np.frombuffer(b"".join(decoded), np.uint8)
        self.at = bounds(np.array([len(d) for d in decoded], np.int64))

    def decode(self, ids: np.ndarray, at: np.ndarray) -> list[str]:
        counts = self.at[ids + 1] - self.at[ids]
        data = self.data[ranges(self.at[ids], counts)].tobytes()
        ends = bounds(counts)[at].tolist()
        out = []
        for a, b in zip(ends[:-1], ends[1:], strict=True):
            out.append(data[a + 1 if data[a : a + 1] == b" " and b > a else a : b].decode("utf-8", "replace"))
        return out


def encode_documents(docs: DataFrame, text: str = "text", keep: list[str] | None = None, model: str = MODEL) -> DataFrame:
    """``keep`` of every row with ``ids`` (null for a null text), ``n_pieces`` and ``round_trip``: whether decoding gives the text back."""
    vocabulary = Vocabulary.load(model)
    names = [c for c in (keep if keep is not None else ["doc_id"]) if c not in ("ids", "n_pieces", "round_trip")]
    schema = docs.select(*names).schema.add("ids", T.ArrayType(T.IntegerType())).add("n_pieces", "long").add("round_trip", "boolean")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, decoder = Encoder(vocabulary), Decoder(vocabulary.decoded)
        for batch in batches:
            texts = batch.column(batch.num_columns - 1).to_pylist()
            for part in chunks(texts, 1_000_000):
                mine = texts[part]
                ids, at = encoder.encode(mine)
                back = decoder.decode(ids, at)
                same = [b == (t or "").replace("▁", " ") for b, t in zip(back, mine, strict=True)]
                listed = pa.ListArray.from_arrays(
                    pa.array(at.astype(np.int32)), pa.array(ids.astype(np.int32)), mask=pa.array([t is None for t in mine])
                )
                rows = batch.slice(part.start, len(mine))
                columns = [*(rows.column(i) for i in range(len(names))), listed, pa.array(np.diff(at)), pa.array(same)]
                yield pa.RecordBatch.from_arrays(columns, [*names, "ids", "n_pieces", "round_trip"])

    return docs.select(*names, docs[text].alias(fresh(names, "_text"))).mapInArrow(run, schema)


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(table(spark, sf_dir, "documents"))
