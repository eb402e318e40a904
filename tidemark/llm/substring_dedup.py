"""Operator 3: removal of repeated passages with a log-structured fingerprint index.

A window is WINDOW consecutive words. Its fingerprint is the least hash of the ANCHOR-word windows
in it, so equal windows have equal fingerprints, and neighbours mostly share one: a text has
far fewer fingerprints than windows.

1. Batches of documents enter the index one after the other. The index is a set of immutable
   runs, each sorted by fingerprint within parts of the hash space. A new batch is
   merge-joined with the runs, part by part, and written as a run of its own, which says for each
   fingerprint whether it has been seen before; runs of one level are compacted into one of the next.
2. Windows with a repeated fingerprint are verified: the hashes of the whole windows are
   dealt by hash and counted; a hash that repeats within a chunk of texts is sent once.
3. Words in repeated windows are removed from their documents.

Windows are judged on the input; copies of a whole text are known by the hashes of text and word
sequence, and one of them stands for all in the count. Window hashes have 64 bits.

Defined results: a null or empty text has no words; documents of fewer than WINDOW words lose
none; repeated rows are copies and lose all words if they have a window; an empty table gives an empty
result; a null doc_id is kept; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, shuffle_partitions
from .fingerprints import Words, deal, hash_words, sub_batches

WINDOW, ANCHOR = 35, 12
_NONE = np.uint64((1 << 64) - 1)


def _bytes(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x).tobytes()


# ---- fingerprints


def _least_ahead(x: np.ndarray, n: int) -> np.ndarray:
    """The least of x[i : i + n] at i, over shorter stretches at the end."""
    out, have = x.copy(), 1
    while have < n:
        step = min(have, n - have)
        if step < len(out):
            out[:-step] = np.minimum(out[:-step], out[step:])
        have += step
    return out


def anchors(words: Words, window: int, anchor: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each word: the hash of the anchor window that starts there (_NONE beyond a text's last);
    the fingerprint of the window that starts there; and whether one starts there at all."""
    n = len(words.hashes)
    hashes, starts = words.windows(anchor)
    at = np.full(n, _NONE, dtype=np.uint64)
    at[starts] = np.minimum(hashes, _NONE - np.uint64(1))
    begins = np.zeros(n, dtype=bool)
    per_text = words.window_counts(window)
    begins[np.arange(int(per_text.sum())) + np.repeat(words.ends - words.counts - (np.cumsum(per_text) - per_text), per_text)] = True
    return at, _least_ahead(at, window - anchor + 1), begins


def chosen(at: np.ndarray, least: np.ndarray, begins: np.ndarray, span: int) -> np.ndarray:
    """Indexes of the anchor windows that are the fingerprint of some window: the greatest fingerprint
    of the windows around an anchor can't be over its hash, and equals it if it is one."""
    of_windows = np.where(begins, least, np.uint64(0))
    greatest = _NONE - _least_ahead((_NONE - of_windows)[::-1], span)[::-1]
    return np.flatnonzero((greatest == at) & (at != _NONE))


def _text_of(words: Words) -> np.ndarray:
    return np.repeat(np.arange(len(words.ends)), words.counts)


# ---- the index


@dataclass
class FingerprintIndex:
    """Immutable runs (p, hashes ascending, many: seen more than once), each with a level. A run
    is a written table; two runs of one level are compacted into one of the next."""

    runs: list[tuple[int, DataFrame]] = field(default_factory=list)

    SCHEMA = "p int, hashes binary, many binary"

    def add(self, batch: DataFrame) -> DataFrame:
        """Merge-join a batch (p, hashes) with the runs and keep it as a run, which is returned: many
        tells which of its fingerprints were there before, or are twice in it."""
        if self.runs:
            history = self.runs[0][1]
            for _, run in self.runs[1:]:
                history = history.unionByName(run)
            new = batch.select("p", "hashes").groupBy("p").cogroup(history.groupBy("p")).applyInArrow(_merge_batch, self.SCHEMA)
        else:
            new = batch.select("p", "hashes").groupBy("p").applyInArrow(_first_run, self.SCHEMA)
        run = cut(new)
        self.runs.append((0, run))
        while len(self.runs) > 1 and self.runs[-1][0] == self.runs[-2][0]:
            self._compact(2)
        return run

    def _compact(self, n: int) -> None:
        """The last n runs become one."""
        level, merged = self.runs[-n][0] + 1, self.runs[-n][1]
        for _, run in self.runs[-n + 1 :]:
            merged = merged.unionByName(run)
        self.runs[-n:] = [(level, cut(merged.groupBy("p").applyInArrow(_merge_runs, self.SCHEMA)))]

    def compacted(self) -> DataFrame:
        """One run of all."""
        if len(self.runs) > 1:
            self._compact(len(self.runs))
        return self.runs[0][1]


def _run_row(p: int, hashes: np.ndarray, many: np.ndarray) -> pa.Table:
    return pa.table({"p": pa.array([p], pa.int32()), "hashes": pa.array([_bytes(hashes)], pa.binary()), "many": pa.array([_bytes(many)], pa.binary())})


def _all(column: pa.ChunkedArray, kind: str) -> np.ndarray:
    found = [np.frombuffer(x.as_py(), kind) for x in column if x.is_valid]
    return np.concatenate(found) if found else np.zeros(0, dtype=kind)


def _first_run(batch: pa.Table) -> pa.Table:
    hashes, counts = np.unique(_all(batch.column("hashes"), "<u8"), return_counts=True)
    return _run_row(batch.column("p")[0].as_py(), hashes, counts > 1)


def _merge_batch(batch: pa.Table, history: pa.Table) -> pa.Table:
    if not batch.num_rows:
        return pa.table({"p": pa.array([], pa.int32()), "hashes": pa.array([], pa.binary()), "many": pa.array([], pa.binary())})
    hashes, counts = np.unique(_all(batch.column("hashes"), "<u8"), return_counts=True)
    many = counts > 1
    for run in history.column("hashes"):  # each is sorted: one merge a run
        many |= contains(np.frombuffer(run.as_py(), "<u8"), hashes)
    return _run_row(batch.column("p")[0].as_py(), hashes, many)


def _merge_runs(runs: pa.Table) -> pa.Table:
    hashes, many = _all(runs.column("hashes"), "<u8"), _all(runs.column("many"), "?")
    order = np.argsort(hashes, kind="stable")
    hashes, many = hashes[order], many[order]
    first = np.flatnonzero(np.append(True, hashes[1:] != hashes[:-1])) if len(hashes) else np.zeros(0, dtype=np.int64)
    counts = np.diff(np.append(first, len(hashes)))
    return _run_row(runs.column("p")[0].as_py(), hashes[first], (np.logical_or.reduceat(many, first) if len(first) else many) | (counts > 1))


def contains(ordered: np.ndarray, x: np.ndarray) -> np.ndarray:
    if not len(ordered):
        return np.zeros(len(x), dtype=bool)
    at = np.minimum(np.searchsorted(ordered, x), len(ordered) - 1)
    return ordered[at] == x


# ---- 1. which windows may be repeated

_MESSAGE = "p int, chunk bigint, texts binary, places binary, hashes binary, twice binary, doc_ids binary, known binary, words binary, h binary, whole binary, digests binary"
_NAMES = [c.split()[0] for c in _MESSAGE.split(", ")]
_TYPES = [pa.int32(), pa.int64(), *[pa.binary()] * 10]


def digest(words: list[bytes]) -> bytes:
    return hashlib.sha256(b" ".join(words)).digest()


def fingerprint_messages(docs: DataFrame, parts: int, window: int, anchor: int) -> DataFrame:
    """For each chunk of texts, a row for each part of the hash space with the fingerprints, the texts
    and places they are at; and a row (p < 0) about the texts. A fingerprint that is twice or more in the
    chunk is known to be repeated: it goes once, in twice, and its places stay with the chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        chunk = TaskContext.get().partitionId() << 16
        for batch in sub_batches(batches, "text"):
            words = hash_words(batch.column(1))
            at, least, begins = anchors(words, window, anchor)
            where = chosen(at, least, begins, window - anchor + 1)
            text = _text_of(words)[where]
            place = where - (words.ends - words.counts)[text]
            distinct, which, counts = np.unique(at[where], return_inverse=True, return_counts=True)
            one, twice = counts[which] == 1, distinct[counts > 1]
            here = (_bytes(text[~one].astype("<u2")), _bytes(place[~one].astype("<u4")))
            order, bounds = deal(at[where][one], parts)
            text, place, hashes = text[one][order], place[one][order], at[where][one][order]
            twice_order, twice_bounds = deal(twice, parts)
            twice = twice[twice_order]
            ids = batch.column(0)
            digests = b"".join(digest((t.as_py() or "").encode().split()) for t in batch.column(1))
            about = (_bytes(np.asarray(pc.fill_null(ids, 0), dtype="<i8")), _bytes(np.asarray(ids.is_valid())), _bytes(words.counts.astype("<i8")), _bytes(np.asarray(batch.column(2), dtype="<i8")), _bytes(words.whole(np.arange(len(words.ends)))), digests)
            rows = [(-1 - chunk % parts, chunk, *here, None, None, *about)]
            for p, (lo, hi, a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), twice_bounds[:-1].tolist(), twice_bounds[1:].tolist(), strict=True)):
                if hi > lo or b > a:
                    rows.append((p, chunk, _bytes(text[lo:hi].astype("<u2")), _bytes(place[lo:hi].astype("<u4")), _bytes(hashes[lo:hi]), _bytes(twice[a:b]), *[None] * 6))
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), _TYPES, strict=True)], names=_NAMES)
            chunk += 1

    return docs.select("doc_id", "text", F.xxhash64("text").alias("h")).mapInArrow(run, _MESSAGE)


_BACK = [n for n in _NAMES if n not in ("p", "hashes", "twice")]


def _repeated_in_part(messages: pa.Table, run: pa.Table) -> pa.Table:
    """The texts and places whose fingerprints are in many places."""
    if not messages.num_rows or messages.column("p")[0].as_py() < 0:
        return messages.select(_BACK)
    repeated = _all(run.column("hashes"), "<u8")[_all(run.column("many"), "?")]
    texts, places = [], []
    for t, w, h in zip(*(messages.column(c) for c in ("texts", "places", "hashes")), strict=True):
        hit = contains(repeated, np.frombuffer(h.as_py(), "<u8"))
        texts.append(_bytes(np.frombuffer(t.as_py(), "<u2")[hit]))
        places.append(_bytes(np.frombuffer(w.as_py(), "<u4")[hit]))
    none = pa.nulls(messages.num_rows, pa.binary())
    return pa.table([messages.column("chunk"), pa.array(texts, pa.binary()), pa.array(places, pa.binary()), *[none] * 6], names=_BACK)


def _by_text(table: pa.Table, n: int) -> list[bytes | None]:
    """The places of each of n texts, ascending, from all rows of its chunk."""
    text, place = _all(table.column("texts"), "<u2"), _all(table.column("places"), "<u4")
    order = np.lexsort((place, text))
    text, place = text[order], place[order]
    bounds = np.searchsorted(text, np.arange(n + 1))
    return [_bytes(place[lo:hi]) if hi > lo else None for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]


def _documents_of_chunk(table: pa.Table) -> pa.Table:
    about = table.filter(pc.is_valid(table.column("words")))
    ids, words, h, whole = (np.frombuffer(about.column(c)[0].as_py(), "<i8") for c in ("doc_ids", "words", "h", "whole"))
    known = np.frombuffer(about.column("known")[0].as_py(), bool)
    digests = about.column("digests")[0].as_py()
    uid = (table.column("chunk")[0].as_py() << 16) + np.arange(len(ids))
    columns = [pa.array(uid), pa.array(ids, mask=~known), pa.array(h), pa.array(whole), pa.array(words), pa.array([digests[i : i + 32] for i in range(0, len(digests), 32)], pa.binary()), pa.array(_by_text(table, len(ids)), pa.binary())]
    return pa.table(columns, names=["uid", "doc_id", "h", "whole", "n_words", "digest", "places"])


def suspects(docs: DataFrame, window: int, anchor: int, batches: int) -> DataFrame:
    """uid, doc_id, h, whole, n_words, digest (of all words) and places (of repeated fingerprints), one row for each
    document, as a written table. The documents enter the index in `batches` batches."""
    parts = 4 * shuffle_partitions(docs.sparkSession)
    messages = cut(fingerprint_messages(docs, parts, window, anchor))
    index = FingerprintIndex()
    for b in range(batches):
        index.add(messages.filter((F.col("p") >= 0) & (F.col("chunk") % batches == b)).select("p", F.concat("hashes", "twice", "twice").alias("hashes")))
    back = messages.drop("twice").groupBy("p").cogroup(index.compacted().groupBy("p")).applyInArrow(_repeated_in_part, ", ".join(f"{n} {'bigint' if n == 'chunk' else 'binary'}" for n in _BACK))
    return cut(back.groupBy("chunk").applyInArrow(_documents_of_chunk, "uid bigint, doc_id bigint, h bigint, whole bigint, n_words bigint, digest binary, places binary"))


# ---- 2. verification of whole windows

_WINDOWS = "p int, chunk bigint, texts binary, places binary, singles binary, many binary, uids binary"
_WINDOW_NAMES = [c.split()[0] for c in _WINDOWS.split(", ")]
_WINDOW_TYPES = [pa.int32(), pa.int64(), *[pa.binary()] * 5]


def window_messages(texts: DataFrame, parts: int, window: int, anchor: int) -> DataFrame:
    """From uid, text, places, copies: the hashes of the windows with repeated fingerprints. A hash
    with one place in a chunk goes with that place; others go once, their places stay with the chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        chunk = TaskContext.get().partitionId() << 16
        for batch in sub_batches(batches, "text"):
            words = hash_words(batch.column(1))
            at, least, begins = anchors(words, window, anchor)
            first = words.ends - words.counts
            repeated = np.full(len(at), _NONE, dtype=np.uint64)
            for i, places in enumerate(batch.column(2)):
                where = first[i] + np.frombuffer(places.as_py(), "<u4").astype(np.int64)
                repeated[where] = at[where]
            flagged = np.flatnonzero(begins & (least != _NONE) & (_least_ahead(repeated, window - anchor + 1) == least))
            hashes, starts = words.windows(window)
            number = np.zeros(len(at), dtype=np.int64)
            number[starts] = np.arange(len(starts))
            h, text = hashes[number[flagged]], _text_of(words)[flagged]
            place = flagged - first[text]
            copies = np.asarray(batch.column(3))[text]
            _, which, counts = np.unique(h, return_inverse=True, return_counts=True)
            one = (counts[which] == 1) & ~copies
            here = ~one & ~copies
            rows = [(-1 - chunk % parts, chunk, _bytes(text[here].astype("<u2")), _bytes(place[here].astype("<u4")), None, None, _bytes(np.asarray(batch.column(0), dtype="<i8")))]
            many = np.unique(h[~one])
            order, bounds = deal(h[one], parts)
            many_order, many_bounds = deal(many, parts)
            for p in range(parts):
                lo, hi, a, b = int(bounds[p]), int(bounds[p + 1]), int(many_bounds[p]), int(many_bounds[p + 1])
                if hi > lo or b > a:
                    o = order[lo:hi]
                    rows.append((p, chunk, _bytes(text[one][o].astype("<u2")), _bytes(place[one][o].astype("<u4")), _bytes(h[one][o]), _bytes(many[many_order[a:b]]), None))
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), _WINDOW_TYPES, strict=True)], names=_WINDOW_NAMES)
            chunk += 1

    return texts.select("uid", "text", "places", "copies").mapInArrow(run, _WINDOWS)


def _verified_in_part(messages: pa.Table) -> pa.Table:
    names = ["chunk", "texts", "places", "uids"]
    if messages.column("p")[0].as_py() < 0:
        return messages.select(names)
    ordered = np.sort(_all(messages.column("singles"), "<u8"))
    repeated = np.union1d(ordered[1:][ordered[1:] == ordered[:-1]], _all(messages.column("many"), "<u8"))
    texts, places = [], []
    for t, w, h in zip(*(messages.column(c) for c in ("texts", "places", "singles")), strict=True):
        hit = contains(repeated, np.frombuffer(h.as_py(), "<u8"))
        texts.append(_bytes(np.frombuffer(t.as_py(), "<u2")[hit]))
        places.append(_bytes(np.frombuffer(w.as_py(), "<u4")[hit]))
    return pa.table([messages.column("chunk"), pa.array(texts, pa.binary()), pa.array(places, pa.binary()), pa.nulls(len(texts), pa.binary())], names=names)


def _windows_of_chunk(table: pa.Table) -> pa.Table:
    uids = np.frombuffer(table.filter(pc.is_valid(table.column("uids"))).column("uids")[0].as_py(), "<i8")
    places = _by_text(table, len(uids))
    some = np.array([x is not None for x in places], dtype=bool)
    return pa.table({"uid": pa.array(uids[some]), "windows": pa.array([x for x in places if x is not None], pa.binary())})


# ---- 3. removal


def removed_words(n: int, starts: np.ndarray, window: int) -> np.ndarray:
    """Whether each of n words is in a window that starts at one of these places."""
    change = np.zeros(n + 1, dtype=np.int64)
    change[starts] += 1
    np.subtract.at(change, starts + window, 1)
    return np.cumsum(change)[:n] > 0


def dedup(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR, batches: int = 3) -> DataFrame:
    """uid, doc_id, n_words, n_removed, kept_sha256, one row for each document."""
    spark = docs.sparkSession
    parts = 4 * shuffle_partitions(spark)
    found = suspects(docs, window, anchor, batches)
    # copies of a text: one, with the least uid, stands for all in the count of windows; a chunk of texts asks once for all its copies
    asked = found.filter(F.col("n_words") >= window).select("uid", F.shiftright("uid", 16).alias("chunk"), "h", "whole")
    by_chunk = cut(asked.groupBy("chunk", "h", "whole").agg(F.min("uid").alias("first"), F.count("*").alias("n")))
    classes = by_chunk.groupBy("h", "whole").agg(F.min("first").alias("first"), F.sum("n").alias("n")).filter("n > 1").drop("n")
    answers = by_chunk.select("chunk", "h", "whole").join(classes, ["h", "whole"])
    copied = cut(asked.join(answers, ["chunk", "h", "whole"]).select("uid", (F.col("uid") == F.col("first")).alias("is_first")))
    needed = found.filter(F.col("places").isNotNull()).join(copied, "uid", "left").filter(F.col("is_first").isNull() | F.col("is_first"))
    needed = needed.select("uid", F.col("doc_id").alias("n_doc"), F.col("h").alias("n_h"), "places", F.coalesce("is_first", F.lit(False)).alias("copies"))
    keyed = docs.select("doc_id", "text", F.xxhash64("text").alias("h"))
    texts = cut(keyed.join(needed, F.col("doc_id").eqNullSafe(F.col("n_doc")) & (F.col("h") == F.col("n_h"))).select("uid", "text", "places", "copies"))
    back = window_messages(texts, parts, window, anchor).groupBy("p").applyInArrow(_verified_in_part, "chunk bigint, texts binary, places binary, uids binary")
    repeated = cut(back.groupBy("chunk").applyInArrow(_windows_of_chunk, "uid bigint, windows binary"))

    def remove(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sub_batches(rows, "text"):
            gone, digests = [], []
            for text, starts in zip(batch.column(1), batch.column(2), strict=True):
                words = text.as_py().encode().split()
                out = removed_words(len(words), np.frombuffer(starts.as_py(), "<u4").astype(np.int64), window)
                gone.append(int(out.sum()))
                digests.append(digest([words[i] for i in np.flatnonzero(~out).tolist()]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(gone, pa.int64()), pa.array(digests, pa.binary())], names=["uid", "gone", "left"])

    cleaned = texts.filter("NOT copies").select("uid", "text").join(repeated, "uid").mapInArrow(remove, "uid bigint, gone bigint, left binary")
    result = found.join(copied, "uid", "left").join(cleaned, "uid", "left")
    is_copy = F.col("is_first").isNotNull()
    return result.select(
        "uid", "doc_id", "n_words",
        F.when(is_copy, F.col("n_words")).otherwise(F.coalesce("gone", F.lit(0))).cast("long").alias("n_removed"),
        F.lower(F.hex(F.when(is_copy, F.unhex(F.lit(hashlib.sha256(b"").hexdigest()))).otherwise(F.coalesce("left", "digest")))).alias("kept_sha256"),
    )
