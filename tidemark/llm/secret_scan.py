"""Operator 10: secret scans by patterns and by dictionary-primed compression novelty.

Three fixed patterns find the base spans. Then every other string of 12 or more secret-like
characters that stands near a sensitive word is a candidate, and so is every one that follows
or precedes a candidate with only a line break, blanks and quoting between them, so that a key
of many lines is taken whole. zstandard, primed with a dictionary of code and identifiers,
compresses the surrounding text without and with the candidate; a candidate whose marginal
compressed bytes per character are high is in neither, and is reported as a span of kind
"novel". That cost alone decides.

Texts are scanned whole, row by row; nothing is shuffled. Positions are code points, ends
exclusive.

Defined results: a null text is empty and has no spans; repeated rows are scanned each; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame

from .fingerprints import sub_batches

KINDS = ("assign", "access", "hex", "novel")
# Fixed patterns.
ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+))""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # runs of 24 or more; shorter runs would be dropped
MIN_VALUE, MIN_ACCESS = 6, 20

_KEYWORD = re.compile(r"(?ai:pass(?:word|wd)|secret|token|api_?key)")
_SENSITIVE = re.compile(r"(?ai:passw|passphrase|secret|token|api_?key|credential|private|bearer|auth|signature|access_?key|client_?id)")
_CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{12,}")
#: What may stand between two lines of a block: a line break, written out or escaped, blanks and quoting.
_BETWEEN_LINES = re.compile(r"""[\x20\t"'`,;+>#*|()/]*+[\n\r\\][\s"'`,;+>#*|()/\\]*+""")

#: What code and configuration near secrets commonly say; a candidate made of these is no novelty.
DICTIONARY = " ".join(
    """
    password passwd secret token api_key apikey api-key access_key access-key client_id client_secret
    private_key public_key credential credentials authorization authentication bearer basic signature
    session cookie username user_name account default example placeholder changeme undefined null none
    true false import export return function class const static public private protected void string
    integer boolean float double object array list dict map set get put post delete update insert select
    from where config configuration settings environment variable development production staging test
    localhost http https www com org net example.com server client host port path file directory name
    value key index count size length width height color number address email phone message request
    response header content type application json xml html text plain utf encode decode base64 hash
    encrypt decrypt digest abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ 0123456789
    your_password_here your_token_here your_secret_here insert_key_here xxxxxxxxxxxxxxxx
    """.split()
).encode()


@dataclass(frozen=True)
class Novelty:
    """reach: characters around a candidate searched for a sensitive word, and taken as its
    surroundings. min_bytes_per_char: the least marginal cost of a secret."""

    reach: int = 80
    level: int = 3
    min_bytes_per_char: float = 0.62


class Scanner:
    def __init__(self, novelty: Novelty = Novelty()):
        import zstandard

        self.novelty = novelty
        primed = zstandard.ZstdCompressionDict(DICTIONARY, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        self._compress = zstandard.ZstdCompressor(level=novelty.level, dict_data=primed, write_content_size=False, write_checksum=False, write_dict_id=False).compress

    def cost(self, before: str, candidate: str, after: str) -> float:
        """Compressed bytes that the candidate adds to its surroundings, for each character."""
        around = len(self._compress((before + after).encode("utf-8", "replace")))
        return (len(self._compress((before + candidate + after).encode("utf-8", "replace"))) - around) / len(candidate)

    def base_spans(self, text: str) -> list[tuple[int, int, str]]:
        spans = []
        if _KEYWORD.search(text):
            spans += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= MIN_VALUE]
        if "AKIA" in text:
            spans += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if len(m[0]) >= MIN_ACCESS]
        spans += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
        return sorted(spans, key=_in_order)

    def candidates(self, text: str) -> list[tuple[int, int]]:
        """Strings of secret-like characters near a sensitive word, and those on lines next to a candidate."""
        words = [m.span() for m in _SENSITIVE.finditer(text)]
        if not words:
            return []
        reach, runs, w = self.novelty.reach, [m.span() for m in _CANDIDATE.finditer(text)], 0
        near = []
        for start, end in runs:
            while w < len(words) and words[w][1] + reach <= start:
                w += 1
            near.append(w < len(words) and words[w][0] - reach < end)
        tied = [_BETWEEN_LINES.fullmatch(text, a[1], b[0]) is not None for a, b in zip(runs, runs[1:], strict=False)]
        for k in range(1, len(runs)):
            near[k] = near[k] or (near[k - 1] and tied[k - 1])
        for k in range(len(runs) - 1, 0, -1):
            near[k - 1] = near[k - 1] or (near[k] and tied[k - 1])
        return [run for run, is_near in zip(runs, near, strict=True) if is_near]

    def novel_spans(self, text: str, base: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
        reach, spans = self.novelty.reach, []
        starts, furthest = [s for s, _, _ in base], list(accumulate((e for _, e, _ in base), max))
        for start, end in self.candidates(text):
            before = bisect_left(starts, end)
            if before and furthest[before - 1] > start:  # it meets a base span
                continue
            if self.cost(text[max(0, start - reach) : start], text[start:end], text[end : end + reach]) >= self.novelty.min_bytes_per_char:
                spans.append((start, end, "novel"))
        return spans


def _in_order(span: tuple[int, int, str]) -> tuple[int, int, int]:
    return span[0], KINDS.index(span[2]), span[1]


def _joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in spans)


def scan(docs: DataFrame, novelty: Novelty = Novelty()) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, n_novel, base_sha256 and spans, one row for each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(novelty)
        for batch in sub_batches(batches, "text"):
            counts, digests, joined = [], [], []
            for t in batch.column(1):
                text = t.as_py() or ""
                base = scanner.base_spans(text)
                novel = scanner.novel_spans(text, base)
                counts.append([sum(kind == k for _, _, kind in base + novel) for k in KINDS])
                digests.append(hashlib.sha256(_joined(base).encode()).hexdigest())
                joined.append(_joined(sorted(base + novel, key=_in_order)))
            by_kind = [pa.array(x, pa.int64()) for x in zip(*counts, strict=True)] or [pa.array([], pa.int64())] * 4
            yield pa.RecordBatch.from_arrays([batch.column(0), *by_kind, pa.array(digests, pa.string()), pa.array(joined, pa.string())], names=_NAMES)

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, n_novel bigint, base_sha256 string, spans string")


_NAMES = ["doc_id", "n_assign", "n_access", "n_hex", "n_novel", "base_sha256", "spans"]


def redact(docs: DataFrame, novelty: Novelty = Novelty(), mark: str = "[SECRET]") -> DataFrame:
    """The documents with every span replaced by mark, and n_chars (if there) counted anew where a text
    changed; all rows and columns stay."""
    counted = "n_chars" in docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(novelty)
        for batch in sub_batches(batches, "text"):
            at = batch.schema.get_field_index("text")
            sizes = batch.column(batch.schema.get_field_index("n_chars")).to_pylist() if counted else [None] * batch.num_rows
            texts = []
            for i, t in enumerate(batch.column(at)):
                text = t.as_py()
                if text:
                    base = scanner.base_spans(text)
                    parts, done = [], 0
                    for start, end, _ in sorted(base + scanner.novel_spans(text, base)):
                        if start >= done:
                            parts += [text[done:start], mark]
                        done = max(done, end)
                    if parts:
                        text = "".join([*parts, text[done:]])
                        sizes[i] = len(text)
                texts.append(text)
            columns = list(batch.columns)
            columns[at] = pa.array(texts, pa.string())
            if counted:
                columns[batch.schema.get_field_index("n_chars")] = pa.array(sizes, batch.schema.field("n_chars").type)
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return docs.mapInArrow(run, docs.schema)
