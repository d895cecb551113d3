"""Repeated passages of ``LENGTH`` bytes and more, by run-length compressed Burrows-Wheeler indexes.

Every byte that a string of ``LENGTH`` bytes covers which also starts earlier
(in a document of a smaller id, or before in the same one) is marked.

An index of all text at once does not fit a task, and most text occurs once.
So the windows of ``LENGTH`` bytes are dealt out first by their least
``GRAM``-byte string (under a hash): equal windows have the same one at the
same place. A *span* is the stretch of text whose windows share such an anchor.

1. Each task emits its spans as hashes. Of equal spans only the earliest can
   hold a first occurrence; the others are marked whole. Equal spans of one
   block of text are folded before the shuffle, so a hot passage is one row a
   block.
2. Anchors that have one span only, wherever they occur, are done. The others
   have spans that agree in part: near copies, and the rims of passages.
3. Their earliest spans are fetched as text and dealt to shards by anchor. A
   shard concatenates them in document order and builds the run-length index:
   the runs of the transform, where each run's characters lead (the last-to-first
   mapping is a shift within a run), and text positions sampled at the runs'
   ends. All spans are streamed through it backwards together; each step gives
   the rank of one more suffix, and the rank gives the matching statistic that
   matters: the class of suffixes that agree on ``LENGTH`` bytes. A window that
   is not the first of its class is marked.
4. An anchor with more than ``HOT_SPANS`` different spans would not fit a
   shard. Its windows are hashed one by one and the first of each found by an
   aggregate: the same answer without an index.

Marks are then joined to the documents, which travel compressed.

Spans and windows are told apart by a 64-bit hash together with a 32-bit
anchor; shards compare the bytes themselves. Rows are told apart by their id
and a 62-bit hash of their text.

Cases: null and empty texts keep nothing and lose nothing; rows of equal id
and text are one document listed twice, with one result each; rows of equal id
and different texts are ordered by a hash of the text; a null id comes after
all others, among themselves by that hash. Columns beside id and text are not
looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roadsky.llm.common import bounds, chunks, ranges, spread_lookup, stored, table

LENGTH = 100
GRAM = 32
#: Spans of one anchor that may go to one shard.
HOT_SPANS = 20_000
#: Spans in a shard, about.
SHARD_SPANS = 8_000
#: Bytes of spans in a shard, about.
SHARD_BYTES = 1_200_000
_LAST_ID = (1 << 63) - 1
_BASE = 0x9E3779B97F4A7C15
_VALUE = np.random.default_rng(5).integers(1, 1 << 63, 256).astype(np.uint64) | np.uint64(1)
_MARK, _SPAN, _PART, _HOT = 1, 0, 2, 3
#: Characters of 9 bits that fit a number: what suffixes are sorted by first.
_PACKED = 7
#: Tags of rows without an id are above this, those of others below.
_NO_ID = 1 << 62
_ROW = "kind int, key int, span long, doc long, tag long, at long, n int"
_ROW_TYPES = {"kind": "int32", "key": "int32", "span": "int64", "doc": "int64", "tag": "int64", "at": "int64", "n": "int32"}


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(32))
    x *= np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def rolled(data: np.ndarray, length: int) -> np.ndarray:
    """Hash of the string of ``length`` (a power of two) bytes from every position on, by doubling."""
    h, base, size = _VALUE[data], _BASE, 1
    while size < length:
        h = h[:-size] * np.uint64(base) + h[size:]
        base, size = base * base % (1 << 64), size * 2
    return _mixed(h)


class Prefix:
    """Hash of any stretch of bytes, from running sums."""

    def __init__(self, data: np.ndarray):
        step = np.full(len(data) + 1, _BASE, np.uint64)
        step[0] = 1
        back = np.full(len(data), pow(_BASE, -1, 1 << 64), np.uint64)
        back[:1] = 1
        self.power = np.cumprod(step)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_VALUE[data] * np.cumprod(back), out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _mixed((self.sums[end] - self.sums[start]) * self.power[start] + (end - start).astype(np.uint64))


def text_tag(raw: bytes, no_id: bool) -> int:
    """Tells rows of equal id apart, and rows without an id from others."""
    return int.from_bytes(hashlib.blake2b(raw, digest_size=8).digest(), "little") >> 2 | (_NO_ID if no_id else 0)


def spans_of(docs: list[int], tags: list[int], raws: list[bytes], length: int = LENGTH, gram: int = GRAM) -> pd.DataFrame:
    """Spans (kind 0) of the texts; those that repeat an earlier one of the same block are marks (kind 1)."""
    # in document order, so that what is found is sorted by document and place
    keep = sorted((i for i, r in enumerate(raws) if len(r) >= length), key=lambda i: (docs[i], tags[i]))
    if not keep:
        return pd.DataFrame({name: np.zeros(0, kind) for name, kind in _ROW_TYPES.items()})
    data = np.frombuffer(b"".join(raws[i] for i in keep), np.uint8)
    sizes = np.array([len(raws[i]) for i in keep], np.int64)
    first = bounds(sizes)
    h = rolled(data, gram)
    least = (h >> np.uint64(32) << np.uint64(32)) | np.arange(len(h), dtype=np.uint64)
    width, size = length - gram + 1, 1
    while size * 2 <= width:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    if size < width:
        least = np.minimum(least[: len(least) - (width - size)], least[width - size :])
    window = ranges(first[:-1], sizes - length + 1)
    anchor = (least[window] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    new = np.ones(len(window), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (window[1:] != window[:-1] + 1)
    begin = np.flatnonzero(new)
    n = np.diff(np.append(begin, len(window)))
    start, at_anchor = window[begin], anchor[begin]
    end = start + n + length - 1
    span = Prefix(data).of(start, end)
    owner = np.searchsorted(first, start, "right") - 1
    key = (h[at_anchor] & np.uint64(0xFFFFFFFF)).astype(np.uint32).view(np.int32)
    order = np.lexsort((span, key))
    ids, own_tags = np.array([docs[i] for i in keep], np.int64), np.array([tags[i] for i in keep], np.int64)
    owner, at = owner[order], (start - first[owner])[order]
    rows = pd.DataFrame(
        {
            "kind": np.full(len(order), _SPAN, np.int32),
            "key": key[order],
            "span": span[order].view(np.int64),
            "doc": ids[owner],
            "tag": own_tags[owner],
            "at": at,
            "n": n[order].astype(np.int32),
        }
    )
    first_of, later = _leaders(rows, None)
    marks = merged_marks(rows[later])
    return pd.concat([rows[first_of], marks], ignore_index=True) if len(marks) else rows[first_of]


def _leaders(rows: pd.DataFrame, before: tuple | None) -> tuple[np.ndarray, np.ndarray]:
    """Of sorted rows: which are the first of their span, and which stand later; a row listed twice is neither.

    ``before``: (key, span, doc, tag, at) of the first row of the span that was open when these rows began.
    """
    key, span, doc, tag, at = (rows[c].to_numpy() for c in ("key", "span", "doc", "tag", "at"))
    new = np.ones(len(rows), bool)
    new[1:] = (key[1:] != key[:-1]) | (span[1:] != span[:-1])
    new[0] = before is None or (key[0], span[0]) != before[:2]
    leader = np.maximum.accumulate(np.where(new, np.arange(len(rows)), -1))
    later = (doc != doc[leader]) | (tag != tag[leader]) | (at != at[leader])
    if before is not None:
        going_on = leader < 0
        later[going_on] = (doc[going_on] != before[2]) | (tag[going_on] != before[3]) | (at[going_on] != before[4])
    return new, later & ~new


def merged_marks(rows: pd.DataFrame) -> pd.DataFrame:
    """Marks with neighbours joined; dealt to tasks by where they stand, not by what they say."""
    doc, tag, at, n = (rows[c].to_numpy() for c in ("doc", "tag", "at", "n"))
    order = np.lexsort((at, tag, doc))
    doc, tag, at, n = doc[order], tag[order], at[order], n[order].astype(np.int64)
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (tag[1:] != tag[:-1]) | (at[1:] != at[:-1] + n[:-1])
    begin = np.flatnonzero(new)
    n = np.add.reduceat(n, begin) if len(begin) else n
    doc, tag, at = doc[begin], tag[begin], at[begin]
    where = _mixed((doc ^ tag).astype(np.uint64) * np.uint64(_BASE) + at.astype(np.uint64))
    return pd.DataFrame(
        {
            "kind": np.full(len(doc), _MARK, np.int32),
            "key": (where & np.uint64(0xFFFFFFFF)).astype(np.uint32).view(np.int32),
            "span": np.zeros(len(doc), np.int64),
            "doc": doc,
            "tag": tag,
            "at": at,
            "n": n.astype(np.int32),
        }
    )


def judge(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Over rows sorted by (kind, key, span, doc, tag, at): later equal spans become marks, first ones of anchors with
    several spans stay as parts, first ones of an anchor with one span go.

    Rows are judged as they come. Of the anchor that is still open at the end of a frame, only first ones are held, and
    no more than ``HOT_SPANS``: beyond that they are handed on as hot.
    """
    open_key, before, held, hot = None, None, [], False

    def closed() -> Iterator[pd.DataFrame]:
        if sum(map(len, held)) > 1 and not hot:
            yield pd.concat(held, ignore_index=True).assign(kind=np.int32(_PART))

    for frame in frames:
        spans = frame[frame["kind"] == _SPAN]
        if len(spans) < len(frame):
            yield frame[frame["kind"] == _MARK]
        if not len(spans):
            continue
        new, later = _leaders(spans, before)
        if later.any():
            yield spans[later].assign(kind=np.int32(_MARK))
        last = spans[new].tail(1)
        if len(last):
            before = tuple(last[c].iloc[0] for c in ("key", "span", "doc", "tag", "at"))
        leaders = spans[new]
        if not len(leaders):
            continue
        keys = leaders["key"].to_numpy()
        edge = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
        counts = np.diff(np.append(edge, len(keys)))
        if open_key is not None and keys[0] != open_key:
            yield from closed()
            held, hot = [], False
        # the frame's first anchor goes on from the last frame, its last one goes on in the next
        first_end, last_start = int(counts[0]), int(edge[-1])
        if len(edge) > 1:
            held.append(leaders.iloc[:first_end])
            if hot or sum(map(len, held)) > HOT_SPANS:
                yield pd.concat(held, ignore_index=True).assign(kind=np.int32(_HOT))
            else:
                yield from closed()
            held, hot = [], False
            size = np.repeat(counts, counts)
            whole = np.arange(len(keys))
            whole = (whole >= first_end) & (whole < last_start) & (size > 1)
            if whole.any():
                kind = np.where(size[whole] > HOT_SPANS, _HOT, _PART).astype(np.int32)
                yield leaders[whole].assign(kind=kind)
        held.append(leaders.iloc[last_start:])
        open_key = keys[-1]
        if hot or sum(map(len, held)) > HOT_SPANS:
            yield pd.concat(held, ignore_index=True).assign(kind=np.int32(_HOT))
            held, hot = [], True
    yield from closed()


class Marks:
    """Marked places among ``size`` as bits, 64 to a word, with the number of marks before each word."""

    def __init__(self, places: np.ndarray, size: int):
        bits = np.zeros(-(-size // 64) * 64, np.uint8)
        bits[places] = 1
        self.words = np.packbits(bits, bitorder="little").view("<u8")
        self.before = bounds(np.bitwise_count(self.words).astype(np.int64))[:-1]

    def up_to(self, place: np.ndarray) -> np.ndarray:
        """How many marks stand at or before each place."""
        word = place >> 6
        low = np.uint64(0xFFFFFFFFFFFFFFFF) >> (63 - (place & 63)).astype(np.uint64)
        return self.before[word] + np.bitwise_count(self.words[word] & low)


class RunLengthIndex:
    """The run-compressed transform of texts, each closed by a sign of its own (ranked by order, before all bytes)."""

    def __init__(self, texts: list[bytes], length: int):
        sizes = np.array([len(t) + 1 for t in texts], np.int64)
        self.ends = bounds(sizes)[1:] - 1
        joined = np.frombuffer(b"\0".join([*texts, b""]), np.uint8).astype(np.int64) + len(texts)
        joined[self.ends] = np.arange(len(texts))
        n = len(joined)
        order, ranks, open_places, size = self._begun(joined, len(texts), min(_PACKED, length))
        half, at_half = None, None
        while True:
            if half is None and size * 2 > length:
                # two strings of this size, overlapping, make one of ``length``
                half, at_half = size, ranks.copy()
            if not len(open_places):
                break
            open_places = self._doubled(order, ranks, open_places, size)
            size *= 2
        if half is None:
            half, at_half = length, ranks
        shifted = np.concatenate([at_half[length - half :], np.full(length - half, -1)])
        same = (at_half[order][1:] == at_half[order][:-1]) & (shifted[order][1:] == shifted[order][:-1])
        last = joined[order - 1]
        starts = np.flatnonzero(np.concatenate([[True], last[1:] != last[:-1]]))
        self.starts = starts
        run_length = np.diff(np.append(starts, n))
        by = np.argsort(last[starts], kind="stable")
        self.leads = np.empty(len(starts), np.int64)
        self.leads[by] = bounds(run_length[by])[:-1]
        self.samples = order[starts], order[starts + run_length - 1]
        self.run_ends = starts + run_length - 1
        # ranks at which a class of suffixes that agree on ``length`` bytes begins
        classes = np.flatnonzero(np.concatenate([[True], ~same]))
        self.size, self.class_count = n, len(classes)
        # runs and classes are looked up at scattered ranks: by counting bits, not by bisection
        self.run_marks, self.class_marks = Marks(starts, n), Marks(classes, n)

    @staticmethod
    def _begun(joined: np.ndarray, signs: int, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """(order, ranks, open places, size): suffixes by their first ``size`` characters, up to a closing sign.

        A rank is the first place of its group in the order; open places are those of groups of several.
        """
        n = len(joined)
        code = np.where(joined < signs, 0, joined - signs + 1).astype(np.uint64)
        packed, ended = np.zeros(n, np.uint64), np.zeros(n, bool)
        for i in range(size):
            own = np.zeros(n, np.uint64)
            own[: n - i] = code[i:]
            ended |= own == 0
            packed = (packed << np.uint64(9)) | np.where(ended, np.uint64(0), own)
        # closing signs are ranked by their order, which a stable sort keeps
        order = np.argsort(packed, kind="stable")
        ordered = packed[order]
        new = np.ones(n, bool)
        new[1:] = (ordered[1:] != ordered[:-1]) | ended[order[1:]]
        ranks, open_places = RunLengthIndex._ranked(order, new, np.arange(n))
        out = np.empty(n, np.int64)
        out[order] = ranks
        return order, out, open_places, size

    @staticmethod
    def _ranked(order: np.ndarray, new: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank per place, and the places whose group has several."""
        ranks = np.maximum.accumulate(np.where(new, places, 0))
        alone = new & np.append(new[1:], True)
        return ranks, places[~alone]

    @staticmethod
    def _doubled(order: np.ndarray, ranks: np.ndarray, places: np.ndarray, size: int) -> np.ndarray:
        """Sorts the open places by twice as many characters, in place; what is open still."""
        suffix = order[places]
        group = ranks[suffix]
        after = suffix + size
        behind = np.where(after < len(ranks), ranks[np.minimum(after, len(ranks) - 1)] + 1, 0)
        keys = (group.astype(np.uint64) << np.uint64(32)) | behind.astype(np.uint64)
        by = np.argsort(keys)
        suffix, keys = suffix[by], keys[by]
        order[places] = suffix
        new = np.ones(len(places), bool)
        new[1:] = keys[1:] != keys[:-1]
        rank, open_places = RunLengthIndex._ranked(order, new, places)
        ranks[suffix] = rank
        return open_places

    def stream(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(text, position, class of the suffix there), all texts a character further back each time."""
        begins = np.concatenate([[0], self.ends[:-1] + 1])
        text, place, rank = np.arange(len(self.ends)), self.ends.copy(), np.arange(len(self.ends))
        while len(text):
            run = self.run_marks.up_to(rank) - 1
            head, tail = rank == self.starts[run], rank == self.run_ends[run]
            if (place[head] != self.samples[0][run[head]]).any() or (place[tail] != self.samples[1][run[tail]]).any():
                raise AssertionError("the index does not lead back through its own text")
            yield text, place, self.class_marks.up_to(rank) - 1
            more = place > begins[text]
            text, place = text[more], place[more] - 1
            rank = self.leads[run[more]] + rank[more] - self.starts[run[more]]

    def repeats(self) -> np.ndarray:
        """Per position whether its string of ``length`` bytes stands earlier in the texts."""
        first = np.full(self.class_count, self.size)
        found = np.zeros(self.size, np.int64)
        for _, place, group in self.stream():
            np.minimum.at(first, group, place)
            found[place] = group
        return first[found] < np.arange(self.size)


def shard_marks(frame: pd.DataFrame, length: int = LENGTH) -> pd.DataFrame:
    """Marks of the windows of a shard's spans that are not the first of their text."""
    # a document listed twice has sent its spans twice
    frame = frame.drop_duplicates(["doc", "tag", "at"]).sort_values(["doc", "tag", "at"], kind="stable")
    texts = [bytes(t) for t in frame["bytes"]]
    index = RunLengthIndex(texts, length)
    again = np.flatnonzero(index.repeats())
    text = np.searchsorted(index.ends, again)
    begins = np.concatenate([[0], index.ends[:-1] + 1])
    doc, tag, at = (frame[c].to_numpy()[text] for c in ("doc", "tag", "at"))
    return merged_marks(pd.DataFrame({"doc": doc, "tag": tag, "at": at + again - begins[text], "n": np.ones(len(doc), np.int64)}))


def named(frame: pd.DataFrame) -> tuple[list[int], list[int], list[bytes]]:
    """(doc, tag, text as bytes) of rows: ``doc`` stands for the id, behind all others if null."""
    raws = [(t or "").encode() for t in frame["text"]]
    none = frame["doc_id"].isna().tolist()
    docs = [_LAST_ID if gone else int(i) for i, gone in zip(frame["id_text"], none, strict=True)]
    return docs, [text_tag(raw, gone) for raw, gone in zip(raws, none, strict=True)], raws


def _rows(docs: DataFrame) -> DataFrame:
    # pandas holds whole numbers beside nulls as doubles, which lose digits: the id travels as text as well
    return docs.select("doc_id", F.col("doc_id").cast("long").cast("string").alias("id_text"), "text")


def packed_texts(docs: DataFrame) -> DataFrame:
    """(doc, tag, packed): texts compressed for the shuffle."""

    def pack(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        packer = zstandard.ZstdCompressor(level=3)
        for frame in frames:
            ids, tags, raws = named(frame)
            yield pd.DataFrame({"doc": ids, "tag": tags, "packed": [packer.compress(raw) for raw in raws]})

    return _rows(docs).mapInPandas(pack, "doc long, tag long, packed binary")


def _unpacked(packed: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(packed) if len(packed) else b""


def decisions(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """Marks, and the spans that need a closer look, of all documents."""

    def spans(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            ids, tags, raws = named(frame)
            for part in chunks(raws):
                yield spans_of(ids[part], tags[part], raws[part], length, gram)

    found = _rows(docs).mapInPandas(spans, _ROW)
    ordered = found.repartition("key").sortWithinPartitions("kind", "key", "span", "doc", "tag", "at")
    return stored(ordered.mapInPandas(judge, _ROW), "spans")


def span_texts(texts: DataFrame, parts: DataFrame, length: int = LENGTH) -> DataFrame:
    """(kind, key, doc, tag, at, bytes) of the spans in ``parts``."""

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for doc, tag, packed, wanted in zip(frame["doc"], frame["tag"], frame["packed"], frame["wanted"], strict=True):
                raw = _unpacked(packed)
                out += [(w["kind"], w["key"], doc, tag, w["at"], raw[w["at"] : w["at"] + w["n"] + length - 1]) for w in wanted]
            yield pd.DataFrame(out, columns=["kind", "key", "doc", "tag", "at", "bytes"])

    # a set: of a document listed many times, each span once
    wanted = parts.groupBy("doc", "tag").agg(F.collect_set(F.struct("kind", "key", "at", "n")).alias("wanted"))
    return texts.join(wanted, ["doc", "tag"]).mapInPandas(cut, "kind int, key int, doc long, tag long, at long, bytes binary")


def hot_marks(spans: DataFrame, length: int = LENGTH) -> DataFrame:
    """Marks of single windows: the first place of every window by an aggregate."""

    def windows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for key, doc, tag, at, data in zip(*(frame[c] for c in ("key", "doc", "tag", "at", "bytes")), strict=True):
                start = np.arange(len(data) - length + 1)
                h = Prefix(np.frombuffer(data, np.uint8)).of(start, start + length)
                yield pd.DataFrame({"key": key, "h": h.view(np.int64), "doc": doc, "tag": tag, "at": at + start})

    every = spans.mapInPandas(windows, "key int, h long, doc long, tag long, at long")
    place = F.struct("doc", "tag", "at")
    first = every.groupBy("key", "h").agg(F.min(place).alias("first"))
    later = spread_lookup(every, first, ["key", "h"], [F.col("doc"), F.col("tag"), F.col("at")]).filter(place != F.col("first"))
    return later.select("doc", "tag", "at", F.lit(1).alias("n"))


def repeated_passages(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """(doc, tag, at, n): windows at ``at`` and the n - 1 after it stand earlier."""
    found = decisions(docs, length, gram)
    parts = found.filter(F.col("kind").isin(_PART, _HOT))
    told = parts.groupBy("kind").agg(F.count("*").alias("n"), F.sum(F.col("n") + length).alias("bytes")).collect()
    sizes = {r["kind"]: (r["n"], r["bytes"]) for r in told}
    marks = found.filter(F.col("kind") == _MARK).select("doc", "tag", "at", "n")
    if not sizes:
        return marks
    texts = span_texts(packed_texts(docs), parts, length)
    spans, size = sizes.get(_PART, (0, 0))
    shards = max(1, -(-spans // SHARD_SPANS), -(-size // SHARD_BYTES))
    shard = F.pmod(F.xxhash64("key"), F.lit(shards)).alias("shard")
    small = texts.filter(F.col("kind") == _PART).select(shard, "doc", "tag", "at", "bytes").groupBy("shard")
    more = small.applyInPandas(lambda frame: shard_marks(frame, length), _ROW).select("doc", "tag", "at", "n")
    if _HOT in sizes:
        more = more.unionByName(hot_marks(texts.filter(F.col("kind") == _HOT), length))
    return marks.unionByName(more)


def cover(raw: bytes, at: np.ndarray, n: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs [start, end) of bytes that the windows cover."""
    order = np.argsort(at, kind="stable")
    begin, end = at[order], (at + n + length - 1)[order]
    reach = np.maximum.accumulate(end)
    new = np.concatenate([[True], begin[1:] > reach[:-1]])
    return begin[new], reach[np.append(np.flatnonzero(new)[1:] - 1, len(reach) - 1)]


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """(doc_id, kept binary, n_bytes, n_removed, n_spans) of every row."""
    marks = repeated_passages(docs, length, gram).groupBy("doc", "tag").agg(F.collect_set(F.struct("at", "n")).alias("marks"))

    def strip(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for packed, found in zip(frame["packed"], frame["marks"], strict=True):
                raw, removed, spans = _unpacked(packed), 0, 0
                kept = raw
                if found is not None and len(found):
                    at, n = np.array([m["at"] for m in found]), np.array([m["n"] for m in found])
                    begin, end = cover(raw, at, n, length)
                    removed, spans = int((end - begin).sum()), len(begin)
                    edges = [0, *np.column_stack([begin, end]).ravel().tolist(), len(raw)]
                    kept = b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
                out.append((kept, len(raw), removed, spans))
            made = pd.DataFrame(out, columns=["kept", "n_bytes", "n_removed", "n_spans"])
            yield made.assign(doc=frame["doc"].to_numpy(), tag=frame["tag"].to_numpy())

    joined = packed_texts(docs).join(marks, ["doc", "tag"], "left")
    found = joined.mapInPandas(strip, "doc long, tag long, kept binary, n_bytes long, n_removed long, n_spans long")
    doc_id = F.when(F.col("tag") < _NO_ID, F.col("doc")).alias("doc_id")
    return found.select(doc_id, "kept", "n_bytes", "n_removed", "n_spans")


def op5_runlength(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = remove_repeats(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
