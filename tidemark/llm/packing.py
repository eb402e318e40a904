"""Operator 5: best-fit packing of token sequences after a dominance reduction.

Pieces are placed by their length alone, so the plan is made on the histogram of lengths: at
most `capacity` counters, however many documents there are. First the reduction fixes sets
that provably dominate every other set holding the same longest piece (alone; with a
perfect partner; with the longest partner where no two fit beside it; with the best pair
where no three fit); what is left is packed by best fit in decreasing length. The plan is a list
of runs (length, from rank, bins, ...) whose number depends on the capacity only, never on
the input; it is the only thing broadcast.

A piece finds its run by its rank among the pieces of its length: its number within its
input partition plus the counts of that length in the partitions before.

Words are known by 64-bit hashes: two words of one hash would share their ids (about one chance in
10**7 for a million words in memory at a time).

Defined results: null and empty texts hold the end token only; repeated rows are separate
documents; an empty table packs into nothing; other columns are ignored.
"""

from __future__ import annotations

import functools
import json
import os
import re
import zlib
from collections.abc import Iterator
from struct import pack as pack_ids

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, lean
from .fingerprints import hash_words, sub_batches

CAPACITY = 4096
END = 1
_RANKS = 1 << 44  # pieces of one length at most
#: Bytes of text whose words are held at a time.
BATCH = 2 << 20


#: Words whose normal form is their lower case, whatever stands beside them: visible ASCII and Latin-1.
_PLAIN = re.compile("[!-~\u00a1-\u00ff]+")


class WordTokens:
    """Token ids of texts under a tokenizer that drops white space between words, so that every
    run of other characters is encoded on its own. Words are known by their 64-bit hashes, in
    arrays; beyond SIZE words, only those of the batch at hand stay known.

    New plain words are lower-cased and split by the tokenizer's own pattern, and its model is asked
    once for each piece (PIECES are remembered). All others go through the whole tokenizer together,
    with a special token between them."""

    SIZE, PIECES, BLOCK = 1_000_000, 300_000, 1024

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.between_id = self.tokenizer.token_to_id(self.special[0])
        self.split, self.pieces = self._splitter(path), {"\n": b""}
        self._know(np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int32), np.zeros(0, dtype=np.int32), np.zeros(0, dtype="<u4"))

    def _splitter(self, path: str):
        """Pieces and line breaks of lower-cased plain words joined by line breaks; None if the tokenizer does
        more than normal form, blanks, lower case, its pattern and bytes."""
        import regex
        from tokenizers import pre_tokenizers

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        kinds = [x.get("type") for part, name in (("normalizer", "normalizers"), ("pre_tokenizer", "pretokenizers")) for x in (spec.get(part) or {}).get(name, [])]
        if kinds != ["NFC", "Replace", "Lowercase", "Split", "ByteLevel"]:
            return None
        as_bytes = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.shown = {i: as_bytes.pre_tokenize_str(chr(i))[0][0] for i in range(33, 256)}
        return regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"] + "|\n")

    def _know(self, words: np.ndarray, at: np.ndarray, size: np.ndarray, pool: np.ndarray) -> None:
        """words, ascending; the ids of each are pool[at : at + size]."""
        self.words, self.at, self.size, self.pool = words, at, size, pool

    def _encode(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words, one after the other, and their number by word; a block of words at a time."""
        plain = np.array([self.split is not None and "<" not in w and _PLAIN.fullmatch(w) is not None for w in words])
        ids, sizes = [], np.zeros(len(words), dtype=np.int64)
        for at, encode in ((np.flatnonzero(plain), self._encode_plain), (np.flatnonzero(~plain), self._encode_block)):
            for block in np.split(at, range(self.BLOCK, len(at), self.BLOCK)) if len(at) else []:
                found, sizes[block] = encode([words[k] for k in block.tolist()])
                ids.append((block, found))
        ends = np.cumsum(sizes)
        out = np.zeros(int(ends[-1]), dtype="<u4")
        for block, found in ids:
            n = sizes[block]
            out[np.repeat((ends - sizes)[block] - (np.cumsum(n) - n), n) + np.arange(len(found))] = found
        return out, sizes

    def _encode_plain(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = self.split.findall("\n".join(words).lower() + "\n")
        new = [x for x in dict.fromkeys(found) if x not in self.pieces]
        if len(self.pieces) + len(new) > self.PIECES:
            self.pieces, new = {"\n": b""}, [x for x in dict.fromkeys(found) if x != "\n"]
        tokenize, shown = self.tokenizer.model.tokenize, self.shown
        for x in new:
            self.pieces[x] = pack_ids("<%dI" % len(tokens := tokenize(x if x.isascii() else x.translate(shown))), *[t.id for t in tokens])
        got = list(map(self.pieces.__getitem__, found))
        ends = np.cumsum(np.fromiter(map(len, got), np.int64, len(got)))[np.fromiter((x == "\n" for x in found), bool, len(found))] // 4
        return np.frombuffer(b"".join(got), "<u4"), np.diff(ends, prepend=0)

    def _encode_block(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        plain = [k for k, w in enumerate(words) if "<" not in w]  # others may hold a special token
        encode = lambda text: np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4")
        joined = encode(self.special[0].join([words[k] for k in plain])) if plain else np.zeros(0, dtype="<u4")
        ends = np.append(np.flatnonzero(joined == self.between_id), len(joined)) if plain else np.zeros(0, dtype=np.int64)
        each = dict(zip(plain, np.split(joined, ends[:-1]) if plain else [], strict=True)) if len(plain) < len(words) else None
        if each is None:
            return joined[joined != self.between_id], np.diff(ends, prepend=-1) - 1
        ids = [each[k][each[k] != self.between_id] if k in each else encode(w) for k, w in enumerate(words)]
        return np.concatenate(ids), np.array([len(x) for x in ids])

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after the other, and where each text ends."""
        w = hash_words(texts)
        distinct, first, which = np.unique(w.hashes, return_index=True, return_inverse=True)
        slot = np.searchsorted(self.words, distinct)
        known = np.zeros(len(distinct), dtype=bool)
        inside = slot < len(self.words)
        known[inside] = self.words[slot[inside]] == distinct[inside]
        new = np.flatnonzero(~known)
        if len(new):
            raw = memoryview(w.data)
            words = [str(raw[a:b], "utf-8") for a, b in zip(w.starts[first[new]].tolist(), w.stops[first[new]].tolist(), strict=True)]
            ids, sizes = self._encode(words)
            at = len(self.pool) + np.cumsum(sizes) - sizes
            put = slot[new]
            self._know(np.insert(self.words, put, distinct[new]), np.insert(self.at, put, at.astype(np.int32)), np.insert(self.size, put, sizes.astype(np.int32)), np.concatenate([self.pool, ids]))
            slot = np.searchsorted(self.words, distinct)
        size, at = self.size[slot].astype(np.int64), self.at[slot].astype(np.int64)
        each = size[which]
        total = np.cumsum(each)
        flat = self.pool[np.repeat(at[which] - (total - each), each) + np.arange(int(total[-1]) if len(total) else 0)]
        if len(self.words) > self.SIZE:
            kept = np.cumsum(size)
            pool = self.pool[np.repeat(at - (kept - size), size) + np.arange(int(kept[-1]))]
            self._know(distinct, (kept - size).astype(np.int32), size.astype(np.int32), pool)
        return flat, np.concatenate([[0], total])[w.ends]


@functools.cache
def word_tokens(path: str) -> WordTokens:
    """One for each worker process, which outlives its tasks."""
    return WordTokens(path)


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, part and rank (number among the pieces of this
    length in part, an input partition)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        words, part = word_tokens(tokenizer_path), TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, dtype=np.int64)
        tail = np.array([end], dtype="<u4").tobytes()
        for batch in sub_batches(batches, "text", BATCH):
            out: list[tuple] = []
            flat, ends = words.ids(batch.column(1))
            begin = 0
            for doc, stop in zip(batch.column(0).to_pylist(), ends.tolist(), strict=True):
                ids, begin = flat[begin:stop].tobytes() + tail, stop
                for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                    cut_ids = ids[at : at + 4 * capacity]
                    n = len(cut_ids) // 4
                    out.append((doc, piece, at // 4, n, zlib.crc32(cut_ids), part, int(seen[n])))
                    seen[n] += 1
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), _PIECE_TYPES, strict=True)], names=_PIECE_NAMES)

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, part int, rank bigint")


_PIECE_NAMES = ["doc_id", "piece", "start", "length", "ids_crc32", "part", "rank"]
_PIECE_TYPES = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]


class _Lengths:
    """A histogram of lengths that finds the next shorter or longer length at hand."""

    def __init__(self, counts: dict[int, int]):
        self.n = {k: v for k, v in counts.items() if v > 0}
        self.mask = sum(1 << k for k in self.n)

    def take(self, length: int, n: int) -> None:
        self.n[length] -= n
        if not self.n[length]:
            del self.n[length]
            self.mask ^= 1 << length

    def at_most(self, limit: int, without: dict[int, int]) -> int:
        """The longest length up to limit that is left beside `without`; 0 if none."""
        mask = self.mask & ((1 << (limit + 1)) - 1) if limit > 0 else 0
        while mask:
            k = mask.bit_length() - 1
            if self.n[k] > without.get(k, 0):
                return k
            mask ^= 1 << k
        return 0

    def shortest(self, how_many: int, without: dict[int, int], over: int = 0) -> list[int]:
        """The shortest lengths over a length, as often as they are left, how_many at most."""
        out, mask = [], self.mask >> (over + 1) << (over + 1)
        while mask and len(out) < how_many:
            k = (mask & -mask).bit_length() - 1
            out += [k] * min(how_many - len(out), self.n[k] - without.get(k, 0))
            mask &= mask - 1
        return out


def dominating(left: _Lengths, j: int, capacity: int) -> list[int] | None:
    """Partners of a piece of length j in a set that dominates every feasible set with such a
    piece, or None if the tests find no such set."""
    room, own = capacity - j, {j: 1}
    low = left.shortest(3, own)
    if not low or low[0] > room:
        return []
    best = left.at_most(room, own)
    if best == room or len(low) < 2 or low[0] + low[1] > room:
        return [best]
    if len(low) == 3 and sum(low) <= room:
        return None
    # at most two partners: the best pair a >= b
    pair, mask = (0, 0, 0), left.mask & ((1 << (room + 1)) - 1)
    while mask:
        a = mask.bit_length() - 1
        mask ^= 1 << a
        if 2 * a < pair[0]:
            break
        if left.n[a] > own.get(a, 0) and (b := left.at_most(min(a, room - a), {j: 1, a: 1 + (a == j)})):
            pair = max(pair, (a + b, a, b))
    total, a, b = pair
    if best >= total:
        return [best]
    if a != best:
        return None
    longer = left.shortest(2, own, over=b) if b < room else []
    return [a, b] if len(longer) < 2 or sum(longer) > room else None


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, list[tuple[int, int]]]]:
    """Patterns (number of bins, [(length, how many in each bin), ...]) that hold all pieces."""
    left, patterns = _Lengths(counts), []
    for j in sorted(left.n, reverse=True):  # the reduction
        while left.n.get(j):
            partners = dominating(left, j, capacity)
            if partners is None:
                break
            need: dict[int, int] = {}
            for k in (j, *partners):
                need[k] = need.get(k, 0) + 1
            bins = min(left.n[k] // v for k, v in need.items())
            patterns.append((bins, sorted(need.items(), reverse=True)))
            for k, v in need.items():
                left.take(k, bins * v)
    rooms: dict[int, list[tuple[int, list[tuple[int, int]]]]] = {}
    mask = 0

    def put(room: int, bins: int, held: list[tuple[int, int]]) -> None:
        nonlocal mask
        if bins:
            rooms.setdefault(room, []).append((bins, held))
            mask |= 1 << room

    for length in sorted(left.n, reverse=True):  # best fit, decreasing
        n = left.n[length]
        while n:
            above = mask >> length << length
            if above:
                room = (above & -above).bit_length() - 1
                bins, held = rooms[room].pop()
                if not rooms[room]:
                    mask ^= 1 << room
            else:
                room, held = capacity, []
                bins = -(-n // (capacity // length))
            each = room // length
            full = min(bins, n // each)
            put(room - each * length, full, [*held, (length, each)])
            n -= full * each
            if full < bins:
                if n:
                    put(room - n * length, 1, [*held, (length, n)])
                    full, n = full + 1, 0
                put(room, bins - full, held)
    return patterns + [x for group in rooms.values() for x in group if x[1]]


def runs(patterns: list[tuple[int, list[tuple[int, int]]]]) -> np.ndarray:
    """Rows (key, first sequence, pieces of this length in a bin, offset, length), by key: length * _RANKS + rank."""
    used: dict[int, int] = {}
    out, base = [], 0
    for bins, held in patterns:
        offset = 0
        for length, each in held:
            at = used.get(length, 0)
            out.append((length * _RANKS + at, base, each, offset, length))
            used[length] = at + bins * each
            offset += length * each
        base += bins
    return np.array(sorted(out), dtype=np.int64).reshape(-1, 5)


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """The pieces with sequence_id and offset. pieces must be a written table: it is read three times."""
    spark = pieces.sparkSession
    counts = pieces.groupBy("part", "length").count()
    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select(F.col("part").alias("b_part"), F.col("length").alias("b_length"), F.coalesce(F.sum("count").over(earlier), F.lit(0)).alias("before"))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("count").alias("n")).collect()}  # capacity rows at most
    table = spark.sparkContext.broadcast(runs(plan(histogram, capacity)))  # bounded by the capacity

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = table.value
        for batch in lean(batches):
            length, rank = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("length", "rank"))
            run = rows[np.searchsorted(rows[:, 0], length * _RANKS + rank, side="right") - 1]
            nth = length * _RANKS + rank - run[:, 0]
            columns = [batch.column(batch.schema.get_field_index(c)) for c in _PIECE_NAMES[:5]]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(run[:, 1] + nth // run[:, 2]), pa.array(run[:, 3] + nth % run[:, 2] * length)], names=[*_PIECE_NAMES[:5], "sequence_id", "offset"])

    ranked = pieces.join(before, (F.col("part") == F.col("b_part")) & (F.col("length") == F.col("b_length"))).select(*_PIECE_NAMES[:5], (F.col("rank") + F.col("before")).alias("rank"))
    return ranked.mapInArrow(place, "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint")


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY) -> DataFrame:
    return pack(cut(pieces(docs, tokenizer_path, capacity)), capacity)
