from __future__ import annotations

import random

import corpus_pipeline
from threadloom.llm import decontamination
from threadloom.llm.sentencepiece_bpe import encoder, model_path


def _plain(rows, items):
    """The stages in plain Python, on documents of known language."""
    from tests.llm.test_dedup import _components, _plain_lines

    rows = [(i, t) for i, t in rows if t and any(c.isalpha() for c in t)]
    rows = [(i, t) for i, _, _, t in _plain_lines(rows)]
    groups = _components(rows, 5, 80)
    rows = [(i, t) for i, t in rows if groups[i][1] == i]
    items = [decontamination.tokens(t.encode()) for _, t in items]
    clean = []
    for i, t in rows:
        w = decontamination.tokens(t.encode())
        if not any(decontamination.agreement(x, w, s) is not None for x in items for s in range(-len(x), len(w))):
            clean.append(i)
    model = encoder(model_path())[0].model
    return {(i, len(model.encode(t))) for i, t in rows if i in clean}


def test_pipeline_matches_plain_version(spark, tmp_path):
    rng = random.Random(4)
    words = {"en": "the and of this with that from under over house river stone green".split(), "de": "der die und das nicht mit von haus fluss stein gruen ueber unter".split()}
    items = [(k, " ".join(rng.choice(words["en"]) + str(rng.randint(0, 99)) for _ in range(25))) for k in range(3)]
    docs, n = [], 0
    for _ in range(40):
        lang = rng.choice(["en", "de"])
        line = lambda: " ".join(rng.choice(words[lang]) for _ in range(rng.randint(5, 15)))  # noqa: B023, E731
        lines = [line() for _ in range(rng.randint(1, 6))]
        if n % 7 == 0:
            lines.append("This work is licensed under some license, version 3.")
        if n % 9 == 0:
            lines.append(rng.choice(items)[1])
        docs.append((n, "\n".join(lines), lang, f"src{n % 3}", 0))
        n += 1
        if n % 4 == 0:  # a near copy whose line differs, so that lines stay
            copy = " ".join(rng.choice(words[lang]) for _ in range(80))
            docs += [(n, copy, lang, "src0", 0), (n + 1, copy + " more", lang, "src1", 0)]
            n += 2
    docs += [(n, None, "en", "src0", 0), (n + 1, "", None, None, None), (n + 2, "12 345 !!", "en", "src1", 9)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {(r["doc_id"], r["n_tokens"]) for r in got} == _plain([(i, t) for i, t, *_ in docs], items)


def test_stages_on_odd_and_empty_tables(spark, odd_docs, no_docs, tmp_path):
    spark.createDataFrame([(None, None), (1, "")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for docs in (odd_docs, no_docs):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, str(tmp_path))
            if name != corpus_pipeline.STAGES[-1][0]:
                assert out.columns == docs.columns, name
            rows = out.collect()
            if docs is no_docs:
                assert not rows
            elif name == "near-dedup":
                assert sorted(r["doc_id"] for r in rows if r["doc_id"] is not None) == [1, 4, 5, 6, 7, 8, 9, 10, 11]
