"""Operator 6: n-gram Jaccard self-join by vertical partitioning.

Two texts link when their sets of shingles overlap by `percent` of their union.

1. Texts become sets of 64-bit shingle hashes; equal sets form one class. A set is linked
   only if enough of its first shingles (in the order of the hashes) are in other sets: the tasks
   exchange 32-bit fingerprints of these, packed and dealt by hash, and count. Most texts end here.
2. The shingles that two or more of the remaining classes hold get a global order, rare ones first.
3. The order is cut at quantiles into `fragments`. The overlap of a candidate pair is counted in
   each fragment on its own, from the two segments that fall in it, and summed per pair.
4. Candidates share one of the rare first shingles of both (prefix, length and position
   bounds lose no link). Each group of classes around such a shingle first proposes stars only:
   pairs with one class of the group. Their links make components. Then the groups that
   still hold several components are compared in blocks, by parity sketches of their sets (a
   sketch bounds the overlap from above, so no link is lost): each class that may link with one
   of another component proposes one such pair. What these don't join is compared once more by whole
   sets, and each block proposes a forest of its links. Groups of several blocks that
   are not one component by then meet block by block in the same way. So a comparison never emits more
   rows than classes entered it, however many pairs link, and every component is exact.

Nothing but counts, quantiles and sizes reaches the driver; nothing that grows is broadcast.

Defined results: null texts and texts without words have no shingles and stand alone; a null
doc_id takes no part and has a null component; repeated rows are in one class; rows that
share a doc_id but not a text are told apart; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, cut_in_buckets, lean, shuffle_partitions
from .components import components
from .fingerprints import deal, shingle_sets, signatures, sub_batches


@dataclass(frozen=True)
class Links:
    """k: words in a shingle. percent: the least overlap of a link. fragments of the global order.
    star_rounds propose before the exact comparison. block, block_shingles: classes of a group in one
    comparison and their shingles in all, about."""

    k: int = 5
    percent: int = 80
    fragments: int = 8
    star_rounds: int = 2
    block: int = 1024
    block_shingles: int = 1 << 19


def least_overlap(n, p: Links = Links()):
    """The least number of shared shingles of a linked set of n."""
    return -(-p.percent * n // 100)


def _margin(n):
    """Shingles beyond the plain prefix that are looked at: so many of them must be shared."""
    return 1 + n // 10


# ---- 1. sets, classes, and the sets that may be linked


def _binary(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x).tobytes()


_MESSAGE = "p int, chunk bigint, texts binary, prints binary, ids binary, known binary, sizes binary, a binary, b binary, h binary"
_NAMES = [c.split()[0] for c in _MESSAGE.split(", ")]
_TYPES = [pa.int32(), pa.int64(), *[pa.binary()] * 8]


def _messages(docs: DataFrame, parts: int, p: Links) -> DataFrame:
    """For each chunk of texts: a row for each part of the hash space, with the fingerprints of the
    first shingles and the text that each is of; and a row (p < 0) about the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        chunk = TaskContext.get().partitionId() << 16
        for batch in sub_batches(batches, "text"):
            hashes, sizes = shingle_sets(batch.column(1), p.k)
            first = np.minimum(sizes, sizes - least_overlap(sizes, p) + _margin(sizes))
            begin = np.cumsum(sizes) - sizes
            text = np.repeat(np.arange(len(sizes)), first)
            at = np.arange(len(text)) - np.repeat(np.cumsum(first) - first, first) + np.repeat(begin, first)
            looked = hashes[at]
            order, bounds = deal(looked, parts)
            text, prints = text[order], (looked[order] & np.uint64(0xFFFFFFFF)).astype("<u4")
            a, b = signatures(hashes, sizes)
            known = np.asarray(batch.column(0).is_valid())
            about = (_binary(np.asarray(pc.fill_null(batch.column(0), 0), dtype="<i8")), _binary(known), _binary(sizes.astype("<i8")), _binary(a), _binary(b), _binary(np.asarray(batch.column(2), dtype="<i8")))
            rows = [(-1 - chunk % parts, chunk, None, None, *about)]
            for part, (lo, hi) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)):
                if hi > lo:  # a text's number as the step from the one before
                    rows.append((part, chunk, _binary(np.diff(text[lo:hi], prepend=0).astype("<u2")), _binary(prints[lo:hi]), *[None] * 6))
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), _TYPES, strict=True)], names=_NAMES)
            chunk += 1

    return docs.select("doc_id", "text", F.xxhash64("text").alias("h")).mapInArrow(run, _MESSAGE)


def _shared_in_part(table: pa.Table) -> pa.Table:
    """The texts whose fingerprints occur more than once, one entry for each of them."""
    if table.column("p")[0].as_py() < 0:
        return table.drop_columns(["p", "prints"])
    chunks = table.column("chunk").to_pylist()
    prints = [np.frombuffer(x.as_py(), "<u4") for x in table.column("prints")]
    ordered = np.sort(np.concatenate(prints))
    repeated = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    shared = []
    for x, t in zip(prints, table.column("texts"), strict=True):
        if len(repeated):
            at = np.minimum(np.searchsorted(repeated, x), len(repeated) - 1)
            shared.append(_binary(np.cumsum(np.frombuffer(t.as_py(), "<u2").astype(np.int64))[repeated[at] == x].astype("<u2")))
        else:
            shared.append(b"")
    none = pa.nulls(len(chunks), pa.binary())
    return pa.table([pa.array(chunks, pa.int64()), pa.array(shared, pa.binary()), *[none] * 6], names=[n for n in _NAMES if n not in ("p", "prints")])


def _texts_of_chunk(table: pa.Table) -> pa.Table:
    about = table.filter(pc.is_valid(table.column("sizes")))
    sizes = np.frombuffer(about.column("sizes")[0].as_py(), "<i8")
    shared = np.zeros(len(sizes), dtype=np.int64)
    for t in table.column("texts"):
        if t.is_valid:
            shared += np.bincount(np.frombuffer(t.as_py(), "<u2"), minlength=len(sizes))
    ids, a, b, h = (np.frombuffer(about.column(c)[0].as_py(), "<i8") for c in ("ids", "a", "b", "h"))
    known = np.frombuffer(about.column("known")[0].as_py(), bool)
    chunk = table.column("chunk")[0].as_py()
    uid = (chunk << 16) + np.arange(len(sizes))
    return pa.table([pa.array(uid), pa.array(ids, mask=~known), pa.array(h), pa.array(sizes), pa.array(a), pa.array(b), pa.array(shared)], names=["uid", "doc_id", "h", "n", "a", "b", "shared"])


def sets(docs: DataFrame, p: Links = Links()) -> DataFrame:
    """uid, doc_id, h (hash of the text), n (shingles), a and b (hash of the set), shared (how many of the
    first shingles other texts have among theirs), one row for each document, as a written table."""
    parts = 4 * shuffle_partitions(docs.sparkSession)
    schema = ", ".join(f"{n} {'bigint' if n == 'chunk' else 'binary'}" for n in _NAMES if n not in ("p", "prints"))
    shared = _messages(docs, parts, p).groupBy("p").applyInArrow(_shared_in_part, schema)
    return cut(shared.groupBy("chunk").applyInArrow(_texts_of_chunk, "uid bigint, doc_id bigint, h bigint, n bigint, a bigint, b bigint, shared bigint"))


def classes_of(found: DataFrame) -> DataFrame:
    """cls (the smallest uid), a, b, n, shared, doc_id and h of a member, for each set of shingles."""
    some = found.filter("n > 0 AND doc_id IS NOT NULL")
    one = some.groupBy("a", "b").agg(F.min(F.struct("uid", "doc_id", "h", "n", "shared")).alias("r"), F.min("doc_id").alias("least_id"))
    return one.select(F.col("r.uid").alias("cls"), "a", "b", F.col("r.n").alias("n"), F.col("r.shared").alias("shared"), F.col("r.doc_id").alias("doc_id"), F.col("r.h").alias("h"), "least_id")


# ---- 2. the global order


def ordered_classes(docs: DataFrame, classes: DataFrame, p: Links) -> DataFrame:
    """cls, n, tokens: the shingles that other classes hold too, as (df, hash) in the global order. Classes
    that can't be linked are left out. A written table."""
    smallest = F.ceil(F.col("n") * p.percent / 100)  # the smallest set that a link may lead to
    may = classes.filter(F.col("shared") >= F.least(F.lit(1) + F.floor(smallest / 10), F.col("n"))).select("cls", "n", F.col("doc_id").alias("c_doc"), F.col("h").alias("c_h"))
    keyed = docs.select("doc_id", "text", F.xxhash64("text").alias("h"))
    joined = keyed.join(may, (F.col("doc_id") == F.col("c_doc")) & (F.col("h") == F.col("c_h")))
    # repeated rows of one document would count twice; the join has dealt and sorted them
    texts = joined.groupBy("doc_id", "h").agg(F.first("cls").alias("cls"), F.first("n").alias("n"), F.first("text").alias("text")).select("cls", "n", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sub_batches(batches, "text"):
            hashes, sizes = shingle_sets(batch.column(2), p.k)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(hashes.view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), lists], names=["cls", "n", "hashes"])

    held = cut(texts.mapInArrow(run, "cls bigint, n bigint, hashes array<bigint>"))
    each = held.select("cls", "n", F.explode("hashes").alias("hash"))
    frequency = each.groupBy("hash").agg(F.count("*").alias("df")).filter("df > 1")
    tokens = each.join(frequency, "hash").groupBy("cls", "n").agg(F.sort_array(F.collect_list(F.struct("df", "hash"))).alias("tokens"))
    return cut(tokens.filter(F.size("tokens") * 100 >= F.col("n") * p.percent))


# ---- 3. overlaps by fragment


def _place(token: Column) -> Column:
    """A token's place in the global order as a number: whole part df, then the hash."""
    return token["df"].cast("double") + (F.shiftrightunsigned(token["hash"], 11).cast("double") / float(1 << 53))


def segments(ordered: DataFrame, p: Links) -> DataFrame:
    """cls, parts: each class's tokens, cut where the global order is cut, as one list of hashes for each fragment; in
    buckets by class."""
    places = ordered.select(F.explode(F.transform("tokens", _place)).alias("x"))
    cuts = places.agg(F.percentile_approx("x", [k / p.fragments for k in range(1, p.fragments)], 1000)).first()[0] or []
    bounds = np.array(sorted(set(cuts)), dtype=np.float64)
    n = len(bounds) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in lean(batches):
            places, hashes = batch.column(1), batch.column(2)
            ends = places.offsets.to_numpy()
            row = np.repeat(np.arange(batch.num_rows), np.diff(ends))
            key = row * n + np.searchsorted(bounds, places.values.to_numpy()[ends[0] : ends[-1]])
            order = np.argsort(key, kind="stable")
            lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(key[order], np.arange(batch.num_rows * n + 1)).astype(np.int32)), pa.array(hashes.values.to_numpy()[ends[0] : ends[-1]][order]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * n), lists)], names=["cls", "parts"])

    rows = ordered.select("cls", F.transform("tokens", _place).alias("places"), F.transform("tokens", lambda t: t["hash"]).alias("hashes"))
    return cut_in_buckets(rows.mapInArrow(run, "cls bigint, parts array<array<bigint>>"), "cls")


def verified(pairs: DataFrame, parts: DataFrame, p: Links) -> DataFrame:
    """The pairs (a, b, n_a, n_b) that link: overlaps of each fragment, summed per pair. Only the lists of a move."""
    of_a = parts.select(F.col("cls").alias("a"), F.col("parts").alias("x"))
    of_b = parts.select(F.col("cls").alias("b"), F.col("parts").alias("y"))
    partial = pairs.join(of_a, "a").join(of_b, "b").select("a", "b", "n_a", "n_b", F.zip_with("x", "y", lambda x, y: F.size(F.array_intersect(x, y))).alias("overlaps"))
    summed = partial.select("a", "b", "n_a", "n_b", F.aggregate("overlaps", F.lit(0), lambda o, k: o + k).alias("o"))
    return summed.filter(100 * F.col("o") >= p.percent * (F.col("n_a") + F.col("n_b") - F.col("o"))).select("a", "b")


# ---- 4. candidates


def postings(ordered: DataFrame, p: Links) -> DataFrame:
    """token, cls, n, pos, before: the prefix of each class; pos counts the tokens of one class only, which come
    first; before is the token before this one in the class's order (null for the first)."""
    n, kept = F.col("n"), F.size("tokens")
    lone = n - kept
    prefix = n - F.ceil(n * p.percent / 100) + 1 - lone
    first = F.slice("tokens", F.lit(1), F.greatest(F.lit(0), prefix).cast("int"))
    rows = ordered.select("cls", "n", lone.alias("lone"), first.alias("first")).select("cls", "n", "lone", "first", F.posexplode("first").alias("i", "t"))
    return rows.select(F.col("t.hash").alias("token"), "cls", "n", (F.col("lone") + F.col("i")).cast("int").alias("pos"), F.get("first", F.col("i") - 1)["hash"].alias("before"))


def _may_link(n_a, n_b, pos_a, pos_b, p: Links):
    """The length bound, and the position bound at the first shared token."""
    lengths = (F.least(n_a, n_b) * 100 >= F.greatest(n_a, n_b) * p.percent)
    most = 1 + F.least(n_a - pos_a, n_b - pos_b) - 1
    return lengths & (most * (100 + p.percent) >= (n_a + n_b) * p.percent)


def stars(posts: DataFrame, seed: int, p: Links) -> DataFrame:
    """Pairs of the classes around each token with one of them, chosen by a hash of the class."""
    order = F.struct(F.xxhash64(F.lit(seed), F.col("cls")).alias("o"), F.col("cls").alias("c"), F.col("n").alias("n_c"), F.col("pos").alias("pos_c"))
    centre = posts.groupBy("token").agg(F.min(order).alias("m"), F.count("*").alias("size")).filter("size > 1").select("token", "m.*")
    pairs = posts.join(centre, "token").filter((F.col("cls") != F.col("c")) & _may_link(F.col("n"), F.col("n_c"), F.col("pos"), F.col("pos_c"), p))
    a_first = F.col("cls") < F.col("c")
    return pairs.select(
        F.least("cls", "c").alias("a"), F.greatest("cls", "c").alias("b"),
        F.when(a_first, F.col("n")).otherwise(F.col("n_c")).alias("n_a"), F.when(a_first, F.col("n_c")).otherwise(F.col("n")).alias("n_b"),
    ).distinct()


def _with_roots(posts: DataFrame, roots: DataFrame | None, *group: str) -> DataFrame:
    """Each posting with its component, in groups that hold several; size and weight are the group's classes and shingles."""
    group = group or ("token",)
    if roots is None:
        rooted = posts.withColumn("root", F.col("cls"))
    else:
        rooted = posts.join(roots, F.col("cls") == F.col("node"), "left").withColumn("root", F.coalesce("root", "cls")).drop("node")
    mixed = rooted.groupBy(*group).agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("*").alias("size"), F.sum("n").alias("weight")).filter("lo < hi")
    return rooted.join(mixed.select(*group, "size", "weight"), [*group])


def _blocks(p: Links) -> Column:
    """The number of blocks of a group."""
    return F.greatest(F.ceil(F.col("size") / p.block), F.ceil(F.col("weight") / p.block_shingles)).cast("int")


def sketches(ordered: DataFrame) -> DataFrame:
    """cls, bits: the parity of the number of a class's tokens on each of 2**k >= 4 n bits. The number of
    bits in which two sketches differ is at most that of the tokens which one of the sets has alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in lean(batches):
            bits = [_sketch(n, np.asarray(hashes.values)) for n, hashes in zip(batch.column(1).to_pylist(), batch.column(2), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(bits, pa.binary())], names=["cls", "bits"])

    return ordered.select("cls", "n", F.transform("tokens", lambda t: t["hash"]).alias("hashes")).mapInArrow(run, "cls bigint, bits binary")


def _sketch(n: int, hashes: np.ndarray) -> bytes:
    size = max(64, 1 << (4 * n - 1).bit_length())
    on = hashes.view(np.uint64) >> np.uint64(7)
    counts = np.bincount((on & np.uint64(size - 1)).astype(np.int64), minlength=size)
    return np.packbits((counts & 1).astype(np.uint8), bitorder="little").tobytes()


def compare_block(rows: dict[str, np.ndarray], bits: list[bytes], left: np.ndarray, right: np.ndarray, p: Links) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Indexes (i, j) of rows of one group, i from left and j from right, that may link and are of different components;
    each pair once if left is right."""
    n, pos, root, lone, before, some = (rows[c] for c in ("n", "pos", "root", "lone", "before", "some"))
    levels = np.array([len(x) for x in bits])
    step = max(1, (1 << 22) // max(1, len(right)))
    for lo in range(0, len(left), step):
        l, r = left[lo : lo + step, None], right[None, :]
        ok = (root[l] != root[r]) & (rows["cls"][l] != rows["cls"][r])
        if left is right:
            ok &= l < r
        ok &= np.minimum(n[l], n[r]) * 100 >= np.maximum(n[l], n[r]) * p.percent
        ok &= np.minimum(n[l] - pos[l], n[r] - pos[r]) * (100 + p.percent) >= (n[l] + n[r]) * p.percent
        # pairs that share the token before meet in its group
        ok &= ~(some[l] & some[r] & (before[l] == before[r]))
        i, j = np.nonzero(ok)
        i, j = left[lo + i], right[j]
        # what one has alone: at most the union less the least overlap, and tokens of one class count apart
        apart = (n[i] + n[j]) * (100 - p.percent) // (100 + p.percent) - lone[i] - lone[j]
        for level in np.unique(np.minimum(levels[i], levels[j])):
            here = np.flatnonzero(np.minimum(levels[i], levels[j]) == level)
            used, place = np.unique(np.concatenate([i[here], j[here]]), return_inverse=True)
            words = np.stack([_folded(bits[k], int(level)) for k in used])
            x, y = place[: len(here)], place[len(here) :]
            for at in range(0, len(here), 1 << 14):
                part = slice(at, at + (1 << 14))
                differ = np.bitwise_count(words[x[part]] ^ words[y[part]]).sum(axis=1, dtype=np.int64)
                keep = here[part][differ <= apart[here[part]]]
                if len(keep):
                    yield i[keep], j[keep]


def _folded(bits: bytes, size: int) -> np.ndarray:
    """The sketch on a smaller number of bits: parities add up where bits fall together."""
    words = np.frombuffer(bits, "<u8")
    return np.bitwise_xor.reduce(words.reshape(-1, size // 8), axis=0)


def _columns(rows: pa.Table, *names: str) -> dict[str, np.ndarray]:
    """What compare_block() reads, and more columns without nulls."""
    before = rows.column("before").combine_chunks()
    return {c: rows.column(c).to_numpy() for c in ("cls", "n", "pos", "root", *names)} | {"some": np.asarray(before.is_valid()), "before": np.asarray(pc.fill_null(before, 0))}


def near(rooted: DataFrame, ordered: DataFrame, p: Links, across: bool = False) -> DataFrame:
    """The classes around a token that may link with one of another component in their block: token, x, y, side, cls, n,
    pos, before, and such a class with its n as other, n_other. A block is about p.block classes of a group and stands in
    x and y. across: every two blocks x < y of a group meet instead, and side tells in which a class is."""
    rooted = rooted.withColumn("blocks", _blocks(p))
    rooted = rooted.filter("blocks > 1") if across else rooted
    bits = sketches(ordered.join(rooted.select("cls").distinct(), "cls", "left_semi"))
    lone = ordered.select("cls", (F.col("n") - F.size("tokens")).alias("lone"))
    member = F.struct("cls", "n", "pos", "before", "root", "lone", "bits")
    # by token too: the classes that one group parts meet in another
    packed = rooted.join(bits, "cls").join(lone, "cls").withColumn("mine", F.pmod(F.xxhash64("token", "cls"), "blocks").cast("int"))
    packed = packed.groupBy("token", "mine", "blocks").agg(F.collect_list(member).alias("held"))
    if across:
        many = cut(packed)
        left = many.filter("mine < blocks - 1").select("token", F.col("mine").alias("x"), F.explode(F.sequence(F.col("mine") + 1, F.col("blocks") - 1)).alias("y"), F.col("held").alias("l"))
        right = many.filter("mine > 0").select("token", F.explode(F.sequence(F.lit(0), F.col("mine") - 1)).alias("x"), F.col("mine").alias("y"), F.col("held").alias("r"))
        met = left.join(right, ["token", "x", "y"])
    else:
        met = packed.select("token", F.col("mine").alias("x"), F.col("mine").alias("y"), F.col("held").alias("l"), F.lit(None).cast(packed.schema["held"].dataType).alias("r"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in lean(batches):
            for k in range(batch.num_rows):
                sides = [c[k].values for c in batch.columns[3:] if c[k].is_valid]
                rows = pa.Table.from_batches([pa.RecordBatch.from_struct_array(x) for x in sides])
                known = _columns(rows, "lone")
                first = np.arange(len(sides[0]))
                second = np.arange(len(sides[0]), rows.num_rows) if len(sides) > 1 else first
                # the next one in the block's order, or the one before: no class is chosen by all
                above, below = np.full(rows.num_rows, -1), np.full(rows.num_rows, -1)
                for i, j in compare_block(known, rows.column("bits").to_pylist(), first, second, p):
                    for some, mine, other in ((above, i, j), (below, j, i)):
                        who, at = np.unique(mine, return_index=True)
                        some[who] = np.where(some[who] < 0, other[at], some[who])
                other = np.where(above < 0, below, above)
                who = np.flatnonzero(other >= 0)
                if len(who):
                    where = [pa.repeat(c[k], len(who)) for c in batch.columns[:3]]
                    held = rows.select(["cls", "n", "pos", "before"]).combine_chunks().take(pa.array(who))
                    found = [*where, pa.array((who >= len(sides[0])).astype(np.int32)), *[c.combine_chunks() for c in held.columns], pa.array(known["cls"][other[who]]), pa.array(known["n"][other[who]])]
                    yield pa.RecordBatch.from_arrays(found, names=["token", "x", "y", "side", "cls", "n", "pos", "before", "other", "n_other"])

    return met.select("token", "x", "y", "l", "r").mapInArrow(run, "token bigint, x int, y int, side int, cls bigint, n bigint, pos int, before bigint, other bigint, n_other bigint")


def proposed(found: DataFrame) -> DataFrame:
    """The pairs (a, b, n_a, n_b) of classes with the other that near() names."""
    a_first = F.col("cls") < F.col("other")
    return found.select(
        F.least("cls", "other").alias("a"), F.greatest("cls", "other").alias("b"),
        F.when(a_first, F.col("n")).otherwise(F.col("n_other")).alias("n_a"), F.when(a_first, F.col("n_other")).otherwise(F.col("n")).alias("n_b"),
    ).distinct()


def forest(pairs: Iterator[tuple[np.ndarray, np.ndarray]], rows: dict[str, np.ndarray], hashes: list[np.ndarray], p: Links) -> list[tuple[int, int]]:
    """Of these pairs (i, j) of rows, linked ones that join all components which any linked ones join. Every pair is
    compared by its whole sets, unless others have joined it already."""
    n, ends = rows["n"], np.cumsum([0, *map(len, hashes)])
    tokens = np.unique(np.concatenate(hashes), return_inverse=True)[1]
    own = [tokens[lo:hi] for lo, hi in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
    held, label, joined = np.zeros(len(tokens), dtype=bool), np.unique(rows["root"], return_inverse=True)[1], []
    for i, j in pairs:
        take = 1
        while len(i := i[apart := label[i] != label[j]]):
            j = j[apart]
            # some pairs of each component at a time, twice as many each time
            order = np.lexsort((i, label[i]))
            of = label[i][order]
            tested = np.arange(len(of)) - np.searchsorted(of, of) < take
            last = -1
            for x, y in zip(i[order[tested]].tolist(), j[order[tested]].tolist(), strict=True):
                if label[x] == label[y]:
                    continue
                if x != last:
                    if last >= 0:
                        held[own[last]] = False
                    held[own[x]], last = True, x
                shared = np.count_nonzero(held[own[y]])
                if 100 * shared >= p.percent * (n[x] + n[y] - shared):
                    joined.append((x, y))
                    label[label == label[y]] = label[x]
            if last >= 0:
                held[own[last]] = False
            rest = order[~tested]
            i, j, take = i[rest], j[rest], 2 * take
    return joined


def forests(rooted: DataFrame, parts: DataFrame, p: Links) -> DataFrame:
    """Pairs (a, b, n_a, n_b) that link and join all that links between the components of each block of near()."""
    member = F.struct("cls", "n", "pos", "before", "root", "side", "hashes")
    held = rooted.join(parts.select("cls", F.flatten("parts").alias("hashes")), "cls").groupBy("token", "x", "y").agg(F.collect_list(member).alias("held"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in lean(batches):
            for block in batch.column(0):
                rows = pa.Table.from_batches([pa.RecordBatch.from_struct_array(block.values)])
                known = _columns(rows, "side")
                hashes = [np.asarray(x.values) for x in rows.column("hashes")]
                known["lone"] = known["n"] - np.array([len(x) for x in hashes])
                first, second = np.flatnonzero(known["side"] == 0), np.flatnonzero(known["side"] == 1)
                pairs = compare_block(known, [_sketch(n, x) for n, x in zip(known["n"].tolist(), hashes, strict=True)], first, second if len(second) else first, p)
                if joined := forest(pairs, known, hashes, p):
                    a, b = np.array(joined).T
                    swap = known["cls"][a] > known["cls"][b]
                    a, b = np.where(swap, b, a), np.where(swap, a, b)
                    yield pa.RecordBatch.from_arrays([pa.array(v) for v in (known["cls"][a], known["cls"][b], known["n"][a], known["n"][b])], names=["a", "b", "n_a", "n_b"])

    return held.select("held").mapInArrow(run, "a bigint, b bigint, n_a bigint, n_b bigint").distinct()


def linked_classes(docs: DataFrame, classes: DataFrame, p: Links = Links()) -> DataFrame:
    """node, root of the classes that have links."""
    ordered = ordered_classes(docs, classes, p)
    parts = segments(ordered, p)
    posts = cut(postings(ordered, p))
    roots = None
    for seed in range(p.star_rounds):
        mixed = _with_roots(posts, roots)
        roots = _tied(roots, cut(verified(stars(mixed.select(*posts.columns), seed, p), parts, p)))
    for across in (False, True):
        rooted = cut(_with_roots(posts, roots))
        found = cut(near(rooted, ordered, p, across))
        roots = _tied(roots, cut(verified(proposed(found), parts, p)))
        roots = _tied(roots, cut(verified(forests(_with_roots(found, roots, "token", "x", "y"), parts, p), parts, p)))
        posts = rooted.filter(_blocks(p) > 1).select(*posts.columns)
        if posts.isEmpty():
            break
    return roots


def _tied(roots: DataFrame | None, new: DataFrame) -> DataFrame:
    """The components after new links; those known already go in as stars, and stay if nothing is new."""
    if roots is None:
        return cut(components(new))
    if new.isEmpty():
        return roots
    return cut(components(roots.select(F.col("root").alias("a"), F.col("node").alias("b")).union(new)))


def join(docs: DataFrame, p: Links = Links()) -> DataFrame:
    """uid, doc_id, h, n_shingles, component_id (the smallest doc_id that links reach), one row for each document."""
    found = sets(docs, p)
    classes = cut(classes_of(found))
    roots = linked_classes(docs, classes, p)
    rooted = classes.join(roots, F.col("cls") == F.col("node"), "left").select("a", "b", "least_id", F.coalesce("root", "cls").alias("root"))
    least = rooted.groupBy("root").agg(F.min("least_id").alias("component_id"))
    named = rooted.join(least, "root").select(F.col("a").alias("c_a"), F.col("b").alias("c_b"), "component_id", "root")
    joined = found.join(named, (F.col("a") == F.col("c_a")) & (F.col("b") == F.col("c_b")) & (F.col("n") > 0), "left")
    own = F.when(F.col("n") > 0, F.when(F.col("doc_id").isNotNull(), F.col("component_id"))).otherwise(F.col("doc_id"))
    return joined.select("uid", "doc_id", "h", F.col("n").alias("n_shingles"), own.alias("component_id"), F.when(F.col("n") > 0, F.col("root")).alias("root"))


def keep_one(docs: DataFrame, p: Links = Links()) -> DataFrame:
    """One document of each component (the least doc_id), and all that take no part, with their columns."""
    joined = cut(join(docs.select("doc_id", "text"), p))
    has_root = F.col("root").isNotNull() & F.col("doc_id").isNotNull()
    best = joined.filter(has_root).groupBy("root").agg(F.min(F.struct("doc_id", "h")).alias("k")).select("k.*")
    keys = best.union(joined.filter(~has_root).select("doc_id", "h")).distinct().select(F.col("doc_id").alias("k_doc"), F.col("h").alias("k_h"))
    row_hash = F.xxhash64("text")
    kept = docs.join(keys, F.col("doc_id").eqNullSafe(F.col("k_doc")) & (row_hash == F.col("k_h")), "left_semi")
    repeated = joined.filter(has_root).groupBy("doc_id", "h").count().filter("count > 1").select(F.col("doc_id").alias("k_doc"), F.col("h").alias("k_h"))
    if repeated.isEmpty():
        return kept
    # rows alike in doc_id and text: one of them stays
    twice = kept.join(repeated, (F.col("doc_id") == F.col("k_doc")) & (row_hash == F.col("k_h")), "left_semi").dropDuplicates(["doc_id", "text"])
    return kept.join(repeated, (F.col("doc_id") == F.col("k_doc")) & (row_hash == F.col("k_h")), "left_anti").unionByName(twice)
