"""Every stage of the pipeline against a plain version of it, on the rows that the stage before kept."""

from collections import Counter, defaultdict

import duckdb
import pytest
from test_operators import WORD, brute_classes, words

import corpus_pipeline
from casewell.llm import op4_toxicity, op5_line_dedup, op7_mixing
from casewell.llm.common import saved


@pytest.fixture(scope="module")
def kept(spark, sf):
    """What each stage got, by name, and what the last one gave."""
    docs, out = spark.read.parquet(f"{sf}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        out[name] = docs
        docs = saved(stage(spark, docs, sf), f"test-{name}")
    return out | {"end": docs}


def test_stages_are_in_order_and_keep_the_columns(spark, sf, kept):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "near_duplicates", "mixing", "packing"]
    columns = spark.read.parquet(f"{sf}/documents.parquet").columns
    assert all(kept[n].columns == columns and kept[n].count() for n, _ in corpus_pipeline.STAGES)


def test_toxicity_stage(spark, sf, kept):
    scored = op4_toxicity.score(kept["toxicity"], spark.read.parquet(f"{sf}/labels.parquet"))
    want = sorted(r.doc_id for r in scored.where("predicted = 0").collect())
    assert sorted(r.doc_id for r in kept["line_dedup"].collect()) == want and len(want) < scored.count()


def test_line_stage(kept):
    before = kept["line_dedup"].orderBy("doc_id").toPandas()
    con = duckdb.connect()
    con.register("documents", before[["doc_id", "text"]])
    removed = {i: {int(x) for x in lines.split(",") if x} for i, lines in con.sql(f"SELECT doc_id, removed_lines FROM ({op5_line_dedup.ORACLE_SQL})").fetchall()}
    want, seen = {}, set()
    for i, text in zip(before.doc_id, before.text):
        whole = text or ""
        if removed[i]:
            left = "\n".join(x for k, x in enumerate(whole.split("\n")) if k not in removed[i])
            if whole not in seen and WORD.search(left):
                want[i] = left
        else:
            want[i] = text
        seen.add(whole)
    got = {r.doc_id: (r.text, r.n_chars) for r in kept["near_duplicates"].collect()}
    assert {i: t for i, (t, _) in got.items()} == want and any(removed.values())
    assert all(n == len(t) for i, (t, n) in got.items() if removed[i])


def test_near_duplicate_stage(kept):
    texts = {r.doc_id: r.text or "" for r in kept["near_duplicates"].collect()}
    classes = brute_classes(texts)
    want = {i for i in texts if classes.get(i, (i, 0))[0] == i}
    assert {r.doc_id for r in kept["mixing"].collect()} == want


def test_mixing_stage(kept):
    before = kept["mixing"].collect()
    size, text = Counter(), {}
    for r in before:
        size[r.source] += len(words(r.text or ""))
        text[r.doc_id] = words(r.text or "")
    order = sorted(size, key=lambda s: (s is None, s or ""))
    target = dict(zip(order, op7_mixing.fill_targets([size[s] for s in order])))
    taken, per_doc = Counter(), defaultdict(Counter)
    for r in kept["packing"].collect():
        taken[r.source] += len(words(r.text))
        per_doc[r.doc_id].update(words(r.text))
        assert r.n_chars == len(r.text)
    assert all(abs(taken[s] - target[s]) <= 0.5 for s in order)
    assert all(n <= 3 * Counter(text[i])[w] for i, held in per_doc.items() for w, n in held.items())


def test_packing_stage(kept):
    import public_tokenizers
    from sentencepiece import SentencePieceProcessor

    library = SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    want = Counter()
    source = {}
    for r in kept["packing"].collect():
        want[r.doc_id] += len(library.encode(r.text or ""))
        source[r.doc_id] = r.source
    rows = kept["end"].toPandas()
    assert rows.groupby("doc_id").n_tokens.sum().to_dict() == {i: n for i, n in want.items()}
    for _, part in rows.groupby("bin"):
        part = part.sort_values(["offset", "n_tokens"])
        assert part.n_tokens.sum() <= 2048 and (part.n_tokens.cumsum() - part.n_tokens == part.offset).all()
        assert part.doc_id.is_unique
        held = [source[i] for i in part.doc_id if source[i] is not None]
        assert len(held) == len(set(held))
