"""The pipeline against its plain version, stage by stage decisions included."""

from __future__ import annotations

import public_tokenizers
import re
import tiktoken

import corpus_pipeline
import plain
from conftest import SMALL
from loanstrata.llm import bpe


def test_pipeline_matches_plain_version(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").select("item_id", "text").collect()]
    rows = [(d, t) for d, t in rows if t and re.search(r"[^\W\d_]", t)]
    lead = plain.jaccard(rows, 5, 8, 10)
    rows = [(d, t) for d, t in rows if lead[d][1] == d]
    out, texts = [], dict(rows)
    for d, (w, gone) in plain.removed(rows, 20).items():
        kept = [x for i, x in enumerate(w) if i not in gone]
        if not gone or kept:
            out.append((d, " ".join(kept) if gone else texts[d]))
    leaks = {d for d, _ in plain.contaminated(out, items)}
    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    coder = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = {d: coder.encode_ordinary(t) for d, t in out if d not in leaks}
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, SMALL).collect()}
    assert {d: r.ids for d, r in got.items()} == want
    assert all(got[d].decoded_sha256 == plain.sha(t) for d, t in out if d in got)


def test_stages_take_odd_and_empty_documents(spark):
    for docs in (plain.with_clashes(plain.documents(spark, plain.odd_rows())), plain.documents(spark, [])):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, SMALL)
            assert out.columns == docs.columns
            assert out.count() <= docs.count()
        assert corpus_pipeline.STAGES[-1][1](spark, docs, SMALL).count() == docs.count()
