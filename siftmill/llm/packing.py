"""Best-fit packing of documents into sequences by the sum-of-squares rule.

A document's tokens are its text's ids and a closing id 0. Only documents longer than a sequence
are cut, into full pieces and a rest. Pieces go into sequences ("bins") of at most ``LENGTH``
tokens: each is placed where the sum over all residual gaps of the squared number of open bins
with that gap becomes smallest (Csirik et al., On the Sum-of-Squares Algorithm for Bin Packing,
2006). As all pieces of a group are known, they go in by falling length. With ``early`` a new bin is a
candidate like any other, which is the rule of the paper; without, as by default, it is opened only for
a piece that fits nowhere, which takes fewer bins. Full pieces are sequences by themselves.

Texts are read once, by the tasks that scan them; they give a few numbers per piece, which are
written. Pieces are dealt by hash into groups of about ``GROUP`` and each group is packed by itself,
long pieces first, so no task grows with the corpus and the loss is a fraction of a bin per group.

Tokens of a text are those of its units: runs of letters, single digits and runs of marks, which the
vocabulary's pattern keeps apart. Units of ASCII and Latin-1 are found in a batch of texts at once and
looked up in a bounded table of units already seen. A run between white space with any other
character, an apostrophe or the begin of a special token is one unit, which the library cuts.

Defined cases. Null or empty text, or one without tokens: one piece, id 0 alone. Null doc_id and
repeated rows: packed like any others. Very long texts: many full pieces. Equal lengths: by doc_id,
piece, checksum. An empty table: an empty result. Columns of the input other than doc_id and text
aren't used, whatever their names.
"""

from __future__ import annotations

import functools
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftmill.llm.common import table, written

LENGTH = 2048
GROUP = 8192
#: Units in the table before it is emptied; some 200 MB.
_MOST_UNITS = 1_000_000
#: Bytes of text taken together.
_RUN = 8 << 20
#: Kinds of bytes: white space, letters, digits, other marks; runs that only the library can cut; and
#: bytes that make a run such a one, which are those beyond Latin-1 and the apostrophe (contractions).
_GAP, _LETTER, _DIGIT, _MARK, _WHOLE, _ODD = range(6)
_KIND = np.full(256, _ODD, np.uint8)
_KIND[:128] = _MARK
_KIND[[9, 10, 11, 12, 13, 32]] = _GAP
_KIND[48:58] = _DIGIT
_KIND[65:91] = _KIND[97:123] = _LETTER
_KIND[39] = _ODD
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: A unit between others when runs are encoded together.
_BETWEEN = "\u2603"


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def units(data: np.ndarray, texts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes (of texts that begin at ``texts``) with A-Z and Latin-1 letters of units in lower
    case, where units begin, and each one's kind. Runs with an odd byte are one unit, as they are."""
    kind, low = _KIND[data], _LOWER[data]
    lead = np.flatnonzero(data[:-1] == 0xC3)  # of U+00C0 to U+00FF: letters but for two signs
    lead = lead[~np.isin(data[lead + 1], (0x97, 0xB7))]
    kind[lead] = kind[lead + 1] = _LETTER
    upper = lead[data[lead + 1] < 0x9F] + 1
    low[upper] += 0x20
    special = np.flatnonzero((data[:-1] == 60) & (data[1:] == 124))  # "<|" may begin a special token
    kind[special] = _ODD
    first = np.zeros(len(data), bool)
    first[texts[texts < len(data)]] = True
    odd = np.flatnonzero(kind == _ODD)
    if len(odd):
        gap = kind == _GAP
        begins = np.flatnonzero(~gap & (first | np.concatenate(([True], gap[:-1]))))
        ends = np.flatnonzero(~gap & np.concatenate((first[1:] | gap[1:], [True]))) + 1
        own = np.unique(np.searchsorted(begins, odd, "right") - 1)
        size = ends[own] - begins[own]
        at = np.repeat(begins[own] - np.cumsum(size) + size, size) + np.arange(size.sum())
        kind[at], low[at] = _WHOLE, data[at]
    first |= kind == _DIGIT
    first[1:] |= kind[1:] != kind[:-1]
    begins = np.flatnonzero(first)
    return low, begins, kind[begins]


class Encoder:
    """Ids of texts."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        # Units in lower case, one a line, need no more than their bytes' own symbols.
        self.of_units = Tokenizer.from_file(path)
        self.of_units.normalizer = normalizers.Sequence([])
        self.of_units.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split("\n", "removed"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.ends = np.zeros(self.tokenizer.get_vocab_size(), bool)
        for token, i in self.tokenizer.get_vocab().items():
            self.ends[i] = token.endswith("</w>")
        between = self._encode(self.tokenizer, _BETWEEN)
        self.between = int(between[0]) if len(between) == 1 else -1
        self.clear()

    def clear(self) -> None:
        """An empty table: a unit's number, and where its ids begin and end."""
        self.numbers: dict[bytes, int] = {}
        self.ids, self.bounds, self.used = np.empty(1 << 16, np.uint32), np.zeros(1 << 16, np.int64), 0

    def _encode(self, tokenizer, text: str) -> np.ndarray:
        return np.array(tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)

    def _add(self, new: list[bytes], ids: np.ndarray, ends: np.ndarray) -> None:
        n = len(self.numbers)
        while self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate((self.ids, np.empty_like(self.ids)))
        while n + len(new) >= len(self.bounds):
            self.bounds = np.concatenate((self.bounds, np.zeros_like(self.bounds)))
        self.ids[self.used : self.used + len(ids)] = ids
        self.bounds[n + 1 : n + 1 + len(new)] = self.used + ends
        self.used += len(ids)
        self.numbers.update(zip(new, range(n, n + len(new))))

    def _learn(self, new: list[bytes]) -> None:
        """Units of one kind each; every unit's last id is that of a word's end, and no other."""
        ids = self._encode(self.of_units, b"\n".join(new).decode())
        ends = np.flatnonzero(self.ends[ids]) + 1
        if len(ends) == len(new):
            self._add(new, ids, ends)
        else:
            self._learn_whole(new)

    def _learn_whole(self, new: list[bytes]) -> None:
        """Runs that only the library can cut: encoded together with a unit between, if that is found
        as often as it was put there."""
        if len(new) > 1 and self.between >= 0:
            ids = self._encode(self.tokenizer, f" {_BETWEEN} ".join(x.decode() for x in new))
            cuts = np.flatnonzero(ids == self.between)
            if len(cuts) == len(new) - 1:
                ends = np.append(cuts, len(ids)) - np.arange(len(new))
                self._add(new, np.delete(ids, cuts), ends)
                return
        if len(new) > 1:
            half = len(new) // 2
            self._learn_whole(new[:half])
            self._learn_whole(new[half:])
        else:
            ids = self._encode(self.tokenizer, new[0].decode())
            self._add(new, ids, np.array([len(ids)]))

    def __call__(self, data: np.ndarray, texts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts that lie one after another in ``data`` and begin at ``texts``, and where each
        text's ids begin."""
        if not len(data):
            return np.empty(0, np.uint32), np.zeros(len(texts), np.int64)
        low, begins, kinds = units(data, texts)
        bounds = np.append(begins, len(data)).astype(np.int64)
        held = pa.Array.from_buffers(pa.large_binary(), len(begins), [None, pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(low))])
        coded = held.dictionary_encode()
        code = coded.indices.to_numpy()
        found = coded.dictionary.to_pylist()
        kind = np.empty(len(found), np.uint8)
        kind[code] = kinds
        if len(self.numbers) + len(found) > _MOST_UNITS:
            self.clear()
        get = self.numbers.get
        number = [get(x, -1) for x in found]
        new = [k for k, x in enumerate(number) if x < 0]
        if new:
            whole = [found[k] for k in new if kind[k] == _WHOLE]
            alone = [found[k] for k in new if kind[k] not in (_WHOLE, _GAP)]
            for learn, these in ((self._learn, alone), (self._learn_whole, whole)):
                if these:
                    learn(these)
            self._add([found[k] for k in new if kind[k] == _GAP], np.empty(0, np.uint32), np.zeros(1, np.int64))
            for k in new:
                number[k] = get(found[k])
        number = np.array(number)
        start, size = self.bounds[number], self.bounds[number + 1] - self.bounds[number]
        size = size[code]
        total = np.concatenate(([0], np.cumsum(size)))
        at = np.repeat(start[code] - total[:-1], size) + np.arange(total[-1])
        return self.ids[at], total[np.searchsorted(begins, texts)]


@functools.cache
def encoder(path: str) -> Encoder:
    return Encoder(path)


def _runs(data: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
    """Runs of about ``_RUN`` bytes of texts: the first text, how many end in the run, and where it
    begins and ends. A longer text takes several, cut before white space."""
    first, n = 0, len(bounds) - 1
    while first < n:
        last = int(np.searchsorted(bounds, bounds[first] + _RUN, "right")) - 1
        if last > first:
            yield first, last - first, int(bounds[first]), int(bounds[last])
            first = last
            continue
        at, end = int(bounds[first]), int(bounds[first + 1])
        while at < end:
            stop = min(end, at + _RUN)
            while stop < end and _KIND[data[stop]] != _GAP:
                ahead = np.flatnonzero(_KIND[data[stop : min(end, stop + _RUN)]] == _GAP)
                stop = stop + int(ahead[0]) if len(ahead) else min(end, stop + _RUN)
            yield first, int(stop == end), at, stop
            at = stop
        first += 1


def ids_of(texts: pa.Array, encode: Encoder) -> Iterator[np.ndarray]:
    """Ids of each text in order, the closing 0 among them."""
    texts = texts.cast(pa.large_string())
    _, bounds, data = texts.buffers()
    bounds = np.frombuffer(bounds, np.int64)[texts.offset : texts.offset + len(texts) + 1] if bounds else np.zeros(len(texts) + 1, np.int64)
    data = np.frombuffer(data, np.uint8) if data else np.empty(0, np.uint8)
    held, close = [], np.zeros(1, np.uint32)
    for first, n, a, z in _runs(data, bounds):
        ids, begins = encode(data[a:z], np.maximum(bounds[first : first + max(n, 1)], a) - a)
        if not n:
            held.append(ids)
        for x, y in zip(begins[:n].tolist(), [*begins[1:n].tolist(), len(ids)]):
            yield np.concatenate((*held, ids[x:y], close))
            held = []


def pieces(docs: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece of every document."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def cut(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary)
        for part in parts:
            at, piece, start, length, crc = [], [], [], [], []
            for row, ids in enumerate(ids_of(part.column("text"), encode)):
                raw = memoryview(np.ascontiguousarray(ids, "<u4")).cast("B")
                for k, a in enumerate(range(0, len(ids), LENGTH)):
                    own = raw[4 * a : 4 * (a + LENGTH)]
                    at.append(row)
                    piece.append(k)
                    start.append(a)
                    length.append(len(own) // 4)
                    crc.append(zlib.crc32(own))
            columns = [part.column("doc_id").take(pa.array(at, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select("doc_id", "text").mapInArrow(cut, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


def sum_of_squares(lengths: np.ndarray, size: int = LENGTH, early: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each length, placed in the given order. Of equal sums the smallest gap is
    taken, and an open bin before a new one."""
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    count = np.zeros(size + 1, np.int64)  # open bins by gap; full ones and unopened ones count as 0
    waiting: list[list[int]] = [[] for _ in range(size + 1)]
    opened, never = 0, np.iinfo(np.int64).max
    for k, n in enumerate(lengths.tolist()):
        # Moving a bin from gap g to g - n changes the sum by 2 (count[g - n] - count[g]) + 2.
        now = count[n:size]
        change = np.where(now > 0, 2 * (count[: size - n] - now) + 2, never)
        if len(change) and now[0]:
            change[0] = 1 - 2 * now[0]  # the bin gets full
        at = int(change.argmin()) if len(change) else 0
        gap = n + at
        if not len(change) or not now[at] or (early and 2 * count[size - n] + 1 < change[at]):
            gap, which, opened = size, opened, opened + 1
        else:
            which = waiting[gap].pop()
            count[gap] -= 1
        bins[k], offsets[k] = which, size - gap
        if gap > n:
            count[gap - n] += 1
            waiting[gap - n].append(which)
    return bins, offsets


def _pack(part: pd.DataFrame) -> pd.DataFrame:
    part = part.sort_values(["length", "doc_key", "piece", "ids_crc32", "start"], ascending=[False, True, True, True, True], ignore_index=True)
    bins, offsets = sum_of_squares(part["length"].to_numpy())
    return part.assign(sequence_id=(part["deal"].to_numpy() << 32) + bins, offset=offsets).drop(columns="deal")


def pack(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece of ``docs``."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    cut = written(pieces(docs, vocabulary or default_vocabulary()), "pieces")
    groups = max(1, -(-cut.count() // GROUP))
    deal = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(groups)).cast("long")
    dealt = cut.withColumns({"deal": deal, "doc_key": F.col("doc_id").cast("string")}).drop("doc_id")
    packed = dealt.groupBy("deal").applyInPandas(_pack, "piece int, start long, length long, ids_crc32 long, doc_key string, sequence_id long, offset long")
    return packed.select(F.col("doc_key").cast(kind).alias("doc_id"), "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents").select("doc_id", "text"))


QUERY = ("op7_packing", op7_packing)
SQL = None
