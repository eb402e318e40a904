"""The pipeline, stage by stage, against plain Python; and the registered queries against their SQL."""

import re
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.test_operators import EDGE, WORDS, documents, library, linked
from tidemark.llm import packing, queries, toxicity
from tidemark.llm.common import DOCUMENT_COLUMNS, cut, lean, table

DATA = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = table(spark, DATA, "documents")
    for name, stage in corpus_pipeline.STAGES:
        before = docs.collect()
        docs = cut(stage(spark, docs, DATA))
        after = docs.collect()
        if name == "toxicity":
            lexicon = toxicity.learn_from(table(spark, DATA, "documents"), table(spark, DATA, "labels"))
            m = toxicity.Matcher(lexicon)
            assert Counter(after) == Counter(r for r in before if m.score(r["text"] or "") < 0.7)
        elif name == "near_copies":
            want = linked([(r["doc_id"], r["text"], "") for r in before])
            assert sorted(r["doc_id"] for r in after) == sorted({c for _, c in want.values()})
        elif name == "secrets":
            assert len(after) == len(before) and not any(re.search("AKIA[A-Z0-9]{16}|[0-9a-f]{24}", r["text"] or "") for r in after)
        elif name == "mixing":
            assert sum(len((r["text"] or "").split()) for r in after) == pytest.approx(sum(len((r["text"] or "").split()) for r in before), abs=20)
            assert max(Counter(r["doc_id"] for r in after).values()) <= 3
            mixed = after
        if name != "packing":
            assert tuple(docs.columns) == DOCUMENT_COLUMNS
    single = {r["doc_id"]: r["text"] for r in mixed if Counter(x["doc_id"] for x in mixed)[r["doc_id"]] == 1}
    rows = [r for r in after if r["doc_id"] in single]
    assert rows and len({(r["sequence_id"], r["offset"]) for r in after}) == len(after)
    tok = library("word_bpe_49k.json")
    for r in rows:
        assert r["start"] + r["length"] <= len(tok.encode(single[r["doc_id"]] or "", add_special_tokens=False).ids) + 1


def test_packing_holds_the_mix(spark):
    """Every piece of every mixed row, documents drawn again or in part included, in sequences that neither overlap nor leave gaps."""
    docs = table(spark, DATA, "documents")
    for name, stage in corpus_pipeline.STAGES:
        docs = cut(stage(spark, docs, DATA))
        if name == "mixing":
            mixed = docs.collect()
    after, tok, want = docs.collect(), library("word_bpe_49k.json"), Counter()
    for r in mixed:
        ids = np.array([*tok.encode(r["text"] or "", add_special_tokens=False).ids, packing.END], dtype="<u4")
        want.update((r["doc_id"], k, at, len(ids[at : at + packing.CAPACITY]), zlib.crc32(ids[at : at + packing.CAPACITY].tobytes())) for k, at in enumerate(range(0, len(ids), packing.CAPACITY)))
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in after) == want
    assert max(Counter(r["doc_id"] for r in mixed).values()) > 1
    bins = defaultdict(list)
    for r in after:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    assert sorted(bins) == list(range(len(bins)))
    for held in bins.values():
        end = 0
        for offset, length in sorted(held):
            assert offset == end
            end += length
        assert end <= packing.CAPACITY


HARD = [*EDGE, (None, None, None), (None, "", "a"), (7, "password=hunter22 and more words follow here", "a"), (7, "password=hunter22 and more words follow here", "a"), (8, "same id as", "a"), (8, "same id but another text", "a"), (9, "<|endoftext|> <p>", "b")]


def plain(rows):
    return Counter(tuple(r[c] for c in DOCUMENT_COLUMNS) for r in rows)


def test_stages_on_hard_rows(spark):
    """Nulls in any column, empty and long texts, repeated rows, shared ids, clashing columns: each stage by itself."""
    given = documents(spark, HARD, extra=True).withColumn("lang", F.when(F.col("doc_id") > 5, F.col("lang"))).withColumn("n_chars", F.when(F.col("doc_id") != 6, F.col("n_chars")))
    rows, stages = given.collect(), dict(corpus_pipeline.STAGES)
    assert plain(stages["toxicity"](spark, given, DATA).collect()) == plain(rows)  # no labels of theirs are toxic words
    kept = stages["near_copies"](spark, given, DATA).collect()
    linked_rows = [r for r in rows if r["doc_id"] is not None and WORDS.search(r["text"] or "")]
    assert plain(kept) == plain([r for r in rows if r not in linked_rows] + list(dict.fromkeys(linked_rows)))
    clean = stages["secrets"](spark, given, DATA).collect()
    assert len(clean) == len(rows) and [(r["text"], r["n_chars"]) for r in clean if r["doc_id"] == 7] == [("[SECRET] and more words follow here", 35)] * 2
    assert plain([r for r in clean if r["doc_id"] != 7]) == plain([r for r in rows if r["doc_id"] != 7])
    mixed = stages["mixing"](spark, given, DATA).collect()
    n = lambda t: len(WORDS.findall(t or ""))
    assert abs(sum(n(r["text"]) for r in mixed) - sum(n(r["text"]) for r in rows)) <= 3 and all(n(r["text"]) for r in mixed)
    assert {(r["doc_id"], r["source"]) for r in mixed} <= {(r["doc_id"], r["source"]) for r in rows}
    packed, tok = stages["packing"](spark, given, DATA).collect(), library("word_bpe_49k.json")
    assert Counter(r["doc_id"] for r in packed if r["piece"] == 0) == Counter(r["doc_id"] for r in rows)
    assert sum(r["length"] for r in packed) == sum(len(tok.encode(r["text"] or "", add_special_tokens=False).ids) + 1 for r in rows)


def test_stages_on_an_empty_table(spark):
    for name, stage in corpus_pipeline.STAGES:
        found = stage(spark, documents(spark, [], extra=True), DATA)
        assert found.count() == 0 and (name == "packing" or tuple(found.columns) == DOCUMENT_COLUMNS)


def test_run_is_the_stages(spark):
    assert set(corpus_pipeline.run(spark, DATA).columns) == {"doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"}


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_oracle(spark, name):
    c = duckdb.connect()
    for t in ("documents", "embeddings", "conversations"):
        path = Path(DATA) / f"{t}.parquet"
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}{'/*.parquet' if path.is_dir() else ''}')")
    ours = queries.QUERIES[name](spark, DATA)
    rows = c.execute(queries.ORACLES[name])
    names = [d[0] for d in rows.description]
    assert sorted(names) == sorted(ours.columns)
    assert Counter(tuple(r[n] for n in names) for r in ours.collect()) == Counter(rows.fetchall())


@pytest.mark.parametrize("name", ["toxicity", "secrets"])
def test_text_stages_write_in_small_batches(spark, name):
    """Whoever writes the result of a stage that sends whole texts to Python, the texts went there in small batches."""
    done = dict(corpus_pipeline.STAGES)[name](spark, table(spark, DATA, "documents"), DATA)
    assert "MapInArrow" not in done._jdf.queryExecution().executedPlan().toString() and name in corpus_pipeline.WRITTEN


def test_workers_give_memory_back():
    def resident():
        return int(Path("/proc/self/statm").read_text().split()[1]) * 4096

    def batches():
        held = [np.ones(12_000) for _ in range(2000)]  # 192 MB in blocks that the allocator keeps under the last one
        yield held[-1:]
        last = held[-1]
        del held
        yield last

    sizes = [resident() for _ in lean(batches())]
    assert resident() < sizes[0] - 100e6
