r"""Operator 4: token counts by a compiled finite-state transducer.

The tokenizer's splitting pattern

    's|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+

is compiled into a deterministic transducer over character classes: each transition either
keeps the open piece or closes pieces, and a closed piece emits its number of tokens. The vocabulary's
merges never cross a piece; how many tokens a piece merges into is asked of the library's model once and
remembered, as are whole symbols (a word with the white space before it), so that a transition on a symbol is
one lookup.

A long text is cut into chunks at fixed places. Each chunk is turned, on its own, into a map from every
state that it may be entered in to what it does then: where the pieces that were open before end, how many tokens
the pieces within it emit, where the piece that stays open begins, and the state it is left in. Ways through
a chunk that come to one state at one place go on alike and are walked once, so a map needs no white space. Maps
compose associatively: pairs, then pairs of pairs. Rows are spread over the tasks; the maps of one text
are made and composed in the task of its row.

Special strings are found first, as the library does, and count one token each.

Defined results: a null text is empty (0 bytes, 0 tokens); repeated rows are counted each;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import functools
import json
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Recent

#: Characters in a chunk. Not a limit: longer texts have more chunks.
CHUNK = 1 << 16
#: The characters of the Unicode property White_Space, as the pattern's \s reads it.
SPACES = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_SPACE = re.compile(f"[{SPACES}]")
_MEET = re.compile(f"(?<=[^{SPACES}])(?=[{SPACES}])")
_SYMBOL = re.compile(f"[{SPACES}]+[^{SPACES}]*")

# States: nothing open; one space; white space that ends with a space, or with another
# character; letters; numbers; others; an apostrophe alone; an apostrophe and r, v or l.
START, SPACE, BLANKS, BREAKS, LETTERS, NUMBERS, OTHERS, QUOTE, QUOTE_R, QUOTE_V, QUOTE_L = range(11)
# Actions on the open piece, before the character joins or opens one.
KEEP, CLOSE, CLOSE_AFTER, LAST_JOINS, LAST_ALONE, QUOTE_ALONE = range(6)

#: Classes: letter, number, space, other white space, other, apostrophe, and the letters that
#: may follow an apostrophe.
_CONTRACTION = "stmdrvle"
#: Characters whose UTF-8 forms hold every byte that UTF-8 has.
_EVERY_BYTE = [*map(chr, range(0x800)), *(chr(i << 12) for i in range(1, 16)), "\u0fff", "\U00010000", *(chr(i << 18) for i in range(1, 5))]


def compile_pattern() -> dict[tuple[int, str], tuple[int, int]]:
    """(state, class) to (action, next state)."""
    letters = ["L", *_CONTRACTION]
    opened = {"N": NUMBERS, " ": SPACE, "W": BREAKS, "O": OTHERS, "'": QUOTE} | dict.fromkeys(letters, LETTERS)
    after_space = opened | {"'": OTHERS}
    delta = {(START, c): (KEEP, to) for c, to in opened.items()}
    for c, to in opened.items():
        blank = c in " W"
        delta[SPACE, c] = (KEEP, {" ": BLANKS, "W": BREAKS}.get(c, after_space[c]))
        delta[BLANKS, c] = (KEEP, BLANKS if c == " " else BREAKS) if blank else (LAST_JOINS, after_space[c])
        delta[BREAKS, c] = (KEEP, BLANKS if c == " " else BREAKS) if blank else (LAST_ALONE, to)
        for state, joins in ((LETTERS, letters), (NUMBERS, ["N"]), (OTHERS, ["O", "'"])):
            delta[state, c] = (KEEP, state) if c in joins else (CLOSE, to)
        delta[QUOTE, c] = (KEEP, OTHERS) if c in "O'" else (CLOSE, to)
        for state, last in ((QUOTE_R, "e"), (QUOTE_V, "e"), (QUOTE_L, "l")):
            # "'" alone, then the letter opens a piece that goes on with letters
            delta[state, c] = (CLOSE_AFTER, START) if c == last else (QUOTE_ALONE, LETTERS) if c in letters else (QUOTE_ALONE, to)
    delta |= {(QUOTE, c): (CLOSE_AFTER, START) for c in "stmd"}
    return delta | {(QUOTE, "r"): (KEEP, QUOTE_R), (QUOTE, "v"): (KEEP, QUOTE_V), (QUOTE, "l"): (KEEP, QUOTE_L)}


@dataclass(frozen=True)
class Path:
    """A way through a chunk, with places in the text: the bounds of pieces up to the first that lies in the chunk (those before
    it end or cut the piece that was open), the tokens of the pieces from there to tail, the last bound (None:
    no piece ends), and the state at the end."""

    bounds: tuple[int, ...]
    count: int
    tail: int | None
    state: int


@dataclass(frozen=True)
class ChunkMap:
    """Entry state to path, for the text from start to the next chunk."""

    start: int
    paths: dict[int, Path]


class Transducer:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            special = [t["content"] for t in json.load(f)["added_tokens"]]
        self.special = re.compile("|".join(re.escape(x) for x in sorted(special, key=len, reverse=True))) if special else None
        as_bytes = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.shown = {b: shown for c in _EVERY_BYTE for b, shown in zip(c.encode(), as_bytes.pre_tokenize_str(c)[0][0], strict=True)}
        self.merge = self.tokenizer.model.tokenize
        self.delta = compile_pattern()
        self.classes = {chr(i): self._class(chr(i)) for i in range(128)}
        self.symbol = Recent(self.run).__getitem__
        self.emitted = Recent(self.tokens_of).__getitem__

    def _class(self, c: str) -> str:
        """The class of a character, as the library's own splitting shows it."""
        if c in _CONTRACTION or c in "' ":
            return c
        split = self.tokenizer.pre_tokenizer.pre_tokenize_str
        for around, name in (("a", "L"), ("1", "N"), ("!", "O")):
            if len(split(around + c + around)) == 1:
                return name
        return "W"

    def tokens_of(self, piece: str) -> int:
        """The tokens that the merges leave of a closed piece."""
        return len(self.merge(piece.encode().decode("latin-1").translate(self.shown))) if piece else 0

    def walk(self, text: str, lo: int, hi: int, state: int, beside: list[int] | None = None, seen: list[int] | None = None) -> tuple[list[int], int, int]:
        """The bounds of the pieces that the characters from lo to hi close, the place and the state reached. It stops where it
        comes to the state that another way through, beside, has there. seen takes the states."""
        classes, delta, bounds = self.classes, self.delta, []
        for i in range(lo, hi):
            kind = classes.get(text[i])
            if kind is None:
                if len(classes) > 100_000:
                    classes = self.classes = {chr(k): self._class(chr(k)) for k in range(128)}
                kind = classes[text[i]] = self._class(text[i])
            action, state = delta[state, kind]
            if action != KEEP:
                if action == CLOSE:
                    bounds.append(i)
                elif action == CLOSE_AFTER:
                    bounds.append(i + 1)
                elif action == LAST_JOINS:
                    bounds.append(i - 1)
                elif action == LAST_ALONE:
                    bounds += (i - 1, i)
                else:  # the apostrophe closes; its letter stays open if letters follow
                    bounds.append(i - 1)
                    if kind != "L" and kind not in _CONTRACTION:
                        bounds.append(i)
            if seen is not None:
                seen.append(state)
            if beside is not None and beside[i - lo] == state:
                return bounds, i + 1, state
        return bounds, hi, state

    def _sum(self, text: str, bounds: list[int]) -> int:
        """The tokens of the pieces between bounds."""
        return sum(self.emitted(text[a:b]) for a, b in zip(bounds, bounds[1:], strict=False))

    def _last(self, text: str, state: int) -> int:
        """The tokens of the open piece where the text ends."""
        return self.emitted(text[:1]) + self.emitted(text[1:]) if state in (QUOTE_R, QUOTE_V, QUOTE_L) else self.emitted(text)

    def run(self, text: str) -> int:
        """The tokens of a text that begins and ends where the states meet, one character at a time."""
        bounds, _, state = self.walk(text, 0, len(text), START)
        bounds = [0, *bounds]
        return self._sum(text, bounds) + self._last(text[bounds[-1] :], state)

    def chunk_map(self, text: str, lo: int, hi: int) -> ChunkMap:
        meet = _MEET.search(text, lo + 1, hi)
        if meet:  # a piece ends there in every state; what follows is one for all
            at = meet.start()
            symbols = _SYMBOL.findall(text, at, hi)
            begin = hi - len(symbols.pop())
            bounds, _, state = self.walk(text, begin, hi, START)
            after = sum(map(self.symbol, symbols)) + self._sum(text, [begin, *bounds])
            tail, paths = bounds[-1] if bounds else begin, {}
            for entry in range(QUOTE_L + 1):
                own = [x for x in self.walk(text, lo, at + 1, entry)[0] if x < at] + [at]
                paths[entry] = self._path(text, lo, own, after, tail, state)
            return ChunkMap(lo, paths)
        states: list[int] = []
        bounds, _, state = self.walk(text, lo, hi, START, seen=states)
        behind = [0, *accumulate(self.emitted(text[a:b]) for a, b in zip(bounds, bounds[1:], strict=False))]
        paths = {START: self._path(text, lo, bounds, 0, bounds[-1] if bounds else None, state)}
        for entry in range(1, QUOTE_L + 1):
            own, met, end = self.walk(text, lo, hi, entry, beside=states)
            rest = bounds[len(self.walk(text, lo, met, START)[0]) :]  # from here on as from START
            if rest:
                paths[entry] = self._path(text, lo, [*own, rest[0]], behind[-1] - behind[-len(rest)], rest[-1], state)
            else:
                paths[entry] = self._path(text, lo, own, 0, own[-1] if own else None, state if met < hi else end)
        return ChunkMap(lo, paths)

    def _path(self, text: str, lo: int, bounds: list[int], after: int, tail: int | None, state: int) -> Path:
        """The path with these first bounds; `after` tokens lie from the last of them to tail."""
        inside = next((k for k, x in enumerate(bounds) if x >= lo), len(bounds))
        return Path(tuple(bounds[: inside + 1]), self._sum(text, bounds[inside:]) + after, tail, state)

    def compose(self, text: str, a: ChunkMap, b: ChunkMap) -> ChunkMap:
        """The map of the chunk a followed by the chunk b."""
        paths = {}
        for entry, p in a.paths.items():
            q = b.paths[p.state]
            bounds, count, last = list(p.bounds), p.count, p.tail
            for x in q.bounds:
                if last is None or last < a.start:
                    bounds.append(x)
                else:
                    count += self.emitted(text[last:x])
                last = x
            paths[entry] = Path(tuple(bounds), count + q.count, q.tail if q.tail is not None else last, q.state)
        return ChunkMap(a.start, paths)

    def scan(self, text: str, maps: list[ChunkMap]) -> ChunkMap:
        while len(maps) > 1:
            maps = [self.compose(text, *maps[i : i + 2]) if i + 1 < len(maps) else maps[i] for i in range(0, len(maps), 2)]
        return maps[0]

    def part(self, text: str, chunk: int) -> int:
        """The tokens of a text without special strings."""
        if len(text) <= chunk:
            first = _MEET.search(text)
            return self.symbol(text[: first.start()]) + sum(map(self.symbol, _SYMBOL.findall(text, first.start()))) if first else self.symbol(text)
        whole = self.scan(text, [self.chunk_map(text, i, min(i + chunk, len(text))) for i in range(0, len(text), chunk)]).paths[START]
        return self._sum(text, [0, *whole.bounds]) + whole.count + self._last(text[whole.tail or 0 :], whole.state)

    def count(self, text: str, chunk: int = CHUNK) -> int:
        total = 0
        parts = self.special.split(text) if self.special else [text]
        for part in parts:
            if part:
                total += self.part(part, chunk)
        return total + len(parts) - 1


@functools.cache
def transducer(path: str) -> Transducer:
    """One for each worker process, which outlives its tasks."""
    return Transducer(path)


def token_counts(docs: DataFrame, tokenizer_path: str, limit: int = 1024) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit, one row for each document; nothing is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = transducer(tokenizer_path).count
        for batch in batches:
            counts = [count(t.as_py() or "") for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(counts, pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])

    sized = docs.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), "text")
    return sized.mapInArrow(run, "doc_id bigint, n_bytes bigint, n_tokens bigint").withColumn("over_limit", F.col("n_tokens") > limit)
