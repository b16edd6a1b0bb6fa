"""The last two stages of the pipeline keep the curriculum's order and whole documents."""

import random
import zlib

import numpy as np
from test_operators import odd_docs
from tokenizers import Tokenizer

import corpus_pipeline
from mediacat.llm import curriculum, token_files
from mediacat.llm.common import stored


def plain(docs):
    """(position, doc_id, text) of every pass over every document."""
    out = []
    for r in curriculum.mix(docs).collect():
        m = r["__mix"]
        for k in range(m.passes + (m.part > 0) if m.taken else 0):
            share = (k * m.source_size + m["at"]) / m.target
            out.append((2 * share / ((1 + m.slope) + ((1 + m.slope) ** 2 - 4 * m.slope * share) ** 0.5), r.doc_id, r.text))
    return sorted(out)


def test_token_files_hold_the_training_order(spark):
    own = Tokenizer.from_file(token_files.vocabulary_path())
    rng = random.Random(9)
    rows = [(i, "  ".join(rng.choice("abcdefgh") * rng.randrange(1, 9) for _ in range(rng.randrange(3, 60))) + "\n", f"s{i % 4 % 3}") for i in range(150)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    want = plain(docs)
    mixed = stored(corpus_pipeline.mix_sources(spark, docs, None), "mixed")
    got = sorted(corpus_pipeline.write_tokens(spark, mixed, None).collect(), key=lambda r: r.start)
    ids = [np.array([*own.encode(t, add_special_tokens=False).ids, 0], "<u4") for _, _, t in want]
    assert [(r.doc_id, r.n_tokens, r.ids_crc32) for r in got] == [(d, len(x), zlib.crc32(x.tobytes())) for (_, d, _), x in zip(want, ids, strict=True)]
    assert [r.doc_id for r in got] != sorted(r.doc_id for r in got)
    assert [r.start for r in got] == [sum(map(len, ids[:i])) for i in range(len(ids))]


def test_no_document_is_cut(spark):
    texts = {r.text for r in odd_docs(spark).collect()}
    copies = corpus_pipeline.mix_sources(spark, odd_docs(spark), None).collect()
    assert copies and {r.text for r in copies} <= texts
