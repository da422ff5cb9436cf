"""The training-data operators against brute force, and on awkward tables."""

import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from compare import engine, same

from casewell.llm import (
    components, op1_sharding, op2_token_tables, op3_packing, op4_toxicity, op5_line_dedup, op6_quality_rules, op7_mixing, op8_multiprobe, op9_jaccard_join, op10_token_counts,
)

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LONG = " ".join(f"w{i}" for i in range(9000))
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, key string, shard int, node long, pack long, score double, words long, lines string, label int, file_no int, row_no string, h long"
MESSY = [
    (0, None, "en", "a"), (1, "", "en", "a"), (2, "   \n\t ", None, None), (3, LONG, "en", "b"), (4, LONG, "en", "b"), (5, LONG + " end", "de", "b"),
    (6, "one two three", "en", "a"), (7, "one  two\tthree", "en", "c"), (8, "You are an idiot and a moron, worthless scum", "en", "c"),
    (9, "Ünïcode 😀 text\nwith lines of enough words here\nwith lines of enough words here\r\nlast", "fr", "c"),
    (9, "Ünïcode 😀 text\nwith lines of enough words here\nwith lines of enough words here\r\nlast", "fr", "c"),
    (10, "<|endoftext|> </s> ▁ x", "en", "a"), (None, "no identifier here at all, still text", "en", "a"), (None, None, None, None), (-7, "negative id text", "en", "a"),
]


@pytest.fixture(scope="module")
def messy(spark):
    return spark.createDataFrame([(i, t, la, s, 1, 2, "k", 3, 4, 5, 0.5, 6, "z", 1, 7, "r", 8) for i, t, la, s in MESSY], SCHEMA)


@pytest.fixture(scope="module")
def none(messy):
    return messy.where("false")


@pytest.fixture(scope="module")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return {r.doc_id: r.text or "" for r in docs.select("doc_id", "text").collect()}


def words(text):
    return WORD.findall(text)


# ---- 1
def test_shards_are_balanced_and_whole(docs, texts):
    rows = op1_sharding.shard(docs).toPandas()
    assert len(rows) == len(texts)
    size = {i: len(t.encode()) + 16 for i, t in texts.items()}
    assert all(size[i] == s for i, s in zip(rows.doc_id, rows["size"]))
    assert all(zlib.crc32(texts[i].encode()) == c for i, c in zip(rows.doc_id, rows.text_crc32))
    for _, part in rows.groupby("shard"):
        assert sorted(part.slot) == list(range(len(part)))
    rows["tokens"] = [len(words(texts[i])) for i in rows.doc_id]
    groups = rows.groupby("text_crc32").agg(b=("size", "sum"), t=("tokens", "sum"), n=("size", "size"), shards=("shard", "nunique"))
    fits = (groups.b <= groups.b.sum() / 40) & (groups.t <= groups.t.sum() / 40) & (groups.n <= len(rows) / 40)
    assert fits.mean() > 0.8 and groups[fits].shards.max() == 1


def test_shards_split_only_what_no_shard_can_hold(spark):
    rows = [(i, "same text again" if i % 3 == 0 else f"text number {i} " * (i % 5 + 1)) for i in range(3000)]
    got = op1_sharding.shard(spark.createDataFrame(rows, "doc_id long, text string")).toPandas()
    by = got.groupby("shard")["size"].sum()
    assert len(by) == 40 and by.max() / by.min() < 1.2
    assert got[got.doc_id % 3 != 0].groupby("text_crc32").shard.nunique().max() == 1


def test_shards_of_a_real_table_have_near_equal_bytes(spark):
    rows = op1_sharding.query(spark, "/root/testdata/sf0.1").groupBy("shard").agg({"size": "sum", "doc_id": "count"}).toPandas()
    assert len(rows) == 40 and rows["sum(size)"].max() / rows["sum(size)"].min() < 1.05


def test_shards_split_a_repeated_row(spark):
    got = op1_sharding.shard(spark.createDataFrame([(7, "one and the same row")] * 2000 + [(8, "another")], "doc_id long, text string")).toPandas()
    by = got.groupby("shard")["size"].sum()
    assert len(got) == 2001 and len(by) == 40 and by.max() / by.mean() < 1.6
    assert all(sorted(p.slot) == list(range(len(p))) for _, p in got.groupby("shard"))


def test_shards_of_messy_and_empty(messy, none):
    rows = op1_sharding.shard(messy).toPandas()
    assert len(rows) == len(MESSY) and set(rows.law) == {"bytes"} and rows[rows.doc_id == 0]["size"].item() == 16
    assert op1_sharding.shard(none).count() == 0


# ---- 2
@pytest.fixture(scope="module")
def word_vocabulary():
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def test_token_tables_round_trip(messy, word_vocabulary):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(word_vocabulary)
    manifest = op2_token_tables.write_tables(messy, word_vocabulary)
    rows = op2_token_tables.read_tables(manifest).toPandas()
    want = Counter((i, tuple(library.encode(t or "", add_special_tokens=False).ids + [1])) for i, t, *_ in MESSY)
    got = Counter((None if i != i else int(i), tuple(ids)) for i, ids in zip(rows.doc_id, rows.ids))
    assert got == want
    rows = rows.sort_values("start")
    assert (rows.n_tokens.cumsum() - rows.n_tokens == rows.start).all()
    known = rows.doc_id.dropna()
    assert known.is_monotonic_increasing


def test_token_tables_lookup(spark, docs, word_vocabulary):
    manifest = op2_token_tables.write_tables(docs, word_vocabulary)
    wanted = spark.createDataFrame([(3,), (77,), (10**9,)], "doc_id long")
    got = {r.doc_id: r.ids for r in op2_token_tables.lookup(manifest, wanted).collect()}
    whole = {r.doc_id: r.ids for r in op2_token_tables.read_tables(manifest).where("doc_id in (3, 77)").collect()}
    assert got == whole


def test_token_tables_lookup_of_null_and_repeated_ids(spark, word_vocabulary, monkeypatch):
    monkeypatch.setattr(op2_token_tables, "LEAST_DOCS", 8)
    monkeypatch.setattr(op2_token_tables, "MOST_DOCS", 8)
    ids = [None] * 20 + [5] * 40 + [-3, 0, 7, 8, 10**12]
    manifest = op2_token_tables.write_tables(spark.createDataFrame([(i, f"text {n}") for n, i in enumerate(ids)], "doc_id long, text string"), word_vocabulary)
    assert manifest.count() > 4
    wanted = spark.createDataFrame([(None,), (5,), (7,), (10**12,), (6,), (-(10**9),)], "doc_id long")
    got = Counter(r.doc_id for r in op2_token_tables.lookup(manifest, wanted).collect())
    assert got == {None: 20, 5: 40, 7: 1, 10**12: 1}


def test_token_tables_lookup_with_an_outlying_id(spark, word_vocabulary, monkeypatch):
    monkeypatch.setattr(op2_token_tables, "LEAST_DOCS", 8)
    monkeypatch.setattr(op2_token_tables, "MOST_DOCS", 8)
    rows = [(i, f"text {i}") for i in range(300)] + [(10**15, "far out")]
    manifest = op2_token_tables.write_tables(spark.createDataFrame(rows, "doc_id long, text string"), word_vocabulary)
    assert manifest.count() > 20
    wanted = spark.createDataFrame([(i,) for i in range(0, 300, 3)] + [(10**15,), (10**14,)], "doc_id long")
    found = op2_token_tables.lookup(manifest, wanted)
    assert Counter(r.doc_id for r in found.collect()) == Counter([*range(0, 300, 3), 10**15])
    # every wanted identifier meets one file, not all of them
    files = manifest.select("first_id", "last_id").collect()
    assert max(sum(f.first_id <= i <= f.last_id for f in files) for i in range(0, 300, 3)) == 1


def test_token_tables_of_nothing(none, word_vocabulary):
    assert op2_token_tables.read_tables(op2_token_tables.write_tables(none, word_vocabulary)).count() == 0


def test_word_encoder_equals_the_library(word_vocabulary):
    from casewell.llm.word_encoder import WordEncoder

    rng, encoder = np.random.default_rng(0), WordEncoder(word_vocabulary)
    letters = list("aAbZ'sS t.,!?_-1²½é ßñ\n\t\xa0ªµ«»’“…Ǆΐ#ΩſİΣ\x1c\x85́")
    many = ["".join(rng.choice(letters, rng.integers(0, 15))) for _ in range(4000)] + ["", "a<|endoftext|>b"]
    for text, ids in zip(many, encoder.encode_many(many)):
        assert ids.tolist() == encoder.library.encode(text, add_special_tokens=False).ids


# ---- 3
def check_packing(rows, sources, clusters, capacity):
    for _, part in rows.groupby("bin"):
        part = part.sort_values(["offset", "n_words"])
        assert part.n_words.sum() <= capacity
        assert (part.n_words.cumsum() - part.n_words == part.offset).all()
        for kind in (sources, clusters):
            held = [kind[i] for i in part.doc_id if kind.get(i) is not None]
            assert len(held) == len(set(held))


def test_packing_keeps_conflicts_apart(docs, texts):
    rows = op3_packing.pack(docs).toPandas()
    source = {r.doc_id: r.source for r in docs.collect()}
    check_packing(rows, source, {i: t for i, t in texts.items() if t}, op3_packing.CAPACITY)
    n = rows.groupby("doc_id").n_words.sum()
    assert all(n[i] == len(words(t)) for i, t in texts.items())


def test_packing_takes_the_tightest_compatible_bin():
    rng = np.random.default_rng(3)
    size, source = rng.integers(0, 60, 300), rng.integers(-1, 4, 300)
    cluster = np.where(rng.random(300) < 0.3, rng.integers(0, 9, 300), -1)
    got = {r: (b, o) for r, _, _, b, o in op3_packing.pack_rows(size, source, cluster, 60)}
    bins = []
    for row in np.argsort(-size, kind="stable"):
        fits = [(b["left"], k) for k, b in enumerate(bins) if b["left"] >= size[row] and (source[row] < 0 or source[row] not in b["s"]) and (cluster[row] < 0 or cluster[row] not in b["c"])]
        left = min(fits)[0] if fits else 60
        chosen, offset = got[int(row)]
        assert offset == 60 - left
        if chosen == len(bins):
            assert not fits
            bins.append({"left": 60, "s": set(), "c": set()})
        assert bins[chosen]["left"] == left
        bins[chosen]["left"] -= size[row]
        bins[chosen]["s"].add(source[row])
        bins[chosen]["c"].add(cluster[row])


def test_packing_of_messy_and_empty(messy, none):
    rows = op3_packing.pack(messy).toPandas()
    assert rows.n_words.sum() == sum(len(words(t or "")) for _, t, *_ in MESSY) and (rows.piece == 0).sum() == len(MESSY)
    assert op3_packing.pack(none).count() == 0


def test_packing_stage_of_messy_and_empty(spark, messy, none):
    import public_tokenizers
    from sentencepiece import SentencePieceProcessor

    library = SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    rows = op3_packing.stage(spark, messy, "").toPandas()
    assert rows.n_tokens.sum() == sum(len(library.encode(t or "")) for _, t, *_ in MESSY) and rows.groupby("bin").n_tokens.sum().max() <= op3_packing.CAPACITY
    nine = rows[rows.doc_id == 9]
    assert len(nine) == 2 and nine.bin.nunique() == 2  # rows of one document share no bin
    assert op3_packing.stage(spark, none, "").count() == 0


# ---- 4
def test_toxicity_on_held_out_rows(spark):
    folder = "/root/testdata/sf0.1"
    rows = op4_toxicity.query(spark, folder).join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").where("held_out").toPandas()
    assert all((zlib.crc32(str(i).encode()) % 4 == 2) for i in rows.doc_id)
    hit = ((rows.predicted == 1) & (rows.toxic == 1)).sum()
    assert hit / (rows.toxic == 1).sum() > 0.85 and hit / (rows.predicted == 1).sum() > 0.85


def test_toxicity_never_reads_held_out_labels(spark, messy):
    labels = spark.createDataFrame([(i, 1, int(zlib.crc32(str(i).encode()) % 4 == 2)) for i in range(11)], "doc_id long, quality int, toxic int")
    flipped = labels.selectExpr("doc_id", "quality", "if(pmod(crc32(cast(cast(doc_id as string) as binary)), 4) = 2, 1 - toxic, toxic) as toxic")
    key = lambda df: sorted((str(r.doc_id), round(r.score, 9)) for r in df.collect())
    assert key(op4_toxicity.score(messy, labels)) == key(op4_toxicity.score(messy, flipped))


def test_toxicity_of_messy_and_empty(spark, messy, none):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    rows = op4_toxicity.score(messy, labels).toPandas()
    assert len(rows) == len(MESSY) and rows.score.between(0, 1).all()
    assert rows[rows.predicted == 1].doc_id.tolist() == [8]
    assert op4_toxicity.score(none, labels).count() == 0


def labels_of(spark, toxic):
    return spark.createDataFrame(list(toxic.items()), "doc_id long, toxic int")


@pytest.mark.parametrize("n, toxic", [(1, lambda i: 1), (8, lambda i: int(i < 3)), (400, lambda i: 1), (400, lambda i: 0), (400, lambda i: int(i % 2))])
def test_toxicity_survives_few_and_senseless_labels(spark, n, toxic):
    rows = [(i, f"a calm report number {i} on the harbour and its {i % 7} boats") for i in range(600)] + [(1000, "what a pathetic idiot, you are worthless scum")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.predicted for r in op4_toxicity.score(docs, labels_of(spark, {i: toxic(i) for i in range(n)})).collect()}
    assert got.pop(1000) == 1 and sum(got.values()) == 0


def test_toxicity_bounds_the_rows_of_a_repeated_document(spark, monkeypatch):
    monkeypatch.setattr(op4_toxicity, "SAMPLE", 100)
    bad = "you idiot, pathetic scum, worthless moron "
    rows = [(0, f"{bad * (i % 9 + 1)} {i}") for i in range(2000)] + [(i, f"{bad} {i}" if i % 2 else f"a calm report {i}") for i in range(1, 300)]
    seen = []
    fit = op4_toxicity.fit_label_model
    monkeypatch.setattr(op4_toxicity, "fit_label_model", lambda votes, *a: seen.append(len(votes)) or fit(votes, *a))
    got = {r.doc_id: r.predicted for r in op4_toxicity.score(spark.createDataFrame(rows, "doc_id long, text string"), labels_of(spark, {i: int(i % 2 or i == 0) for i in range(300)})).collect()}
    assert seen and max(seen) <= 100 and got[1] == 1 and got[2] == 0


def test_toxicity_stage_of_messy_and_empty(spark, sf, messy, none):
    kept = op4_toxicity.stage(spark, messy, sf)
    assert kept.columns == messy.columns and sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(m[0]) for m in MESSY if m[0] != 8)
    assert op4_toxicity.stage(spark, none, sf).count() == 0


def test_label_model_tells_good_voters_from_noise():
    rng = np.random.default_rng(1)
    y = rng.random(4000) < 0.2
    good = (rng.random((4000, 6)) < np.where(y[:, None], 0.4, 0.01)).astype(float)
    noise = (rng.random((4000, 2)) < 0.2).astype(float)
    votes = np.hstack([good, good[:, :1], noise])
    model = op4_toxicity.fit_label_model(votes, votes[:, :7].any(axis=1), 0.2)
    ratio = np.log(model.toxic / model.clean)
    assert ratio[:6].min() > 1 > abs(ratio[7:]).max()
    assert model.parent[6] == 0 or model.parent[0] == 6  # a voter's copy hangs on it and adds nothing where it fires
    one, copy = np.zeros((2, 9)), np.array([[1.0, 0, 0, 0, 0, 0, 1, 0, 0]])
    one[0, 0] = one[1, 1] = 1
    alone, echoed = model.posterior(one[1:], np.array([True]))[0], model.posterior(copy, np.array([True]))[0]
    assert np.log(echoed / (1 - echoed)) < 1.5 * np.log(alone / (1 - alone)) + 1
    q = model.posterior(votes, votes[:, :7].any(axis=1))
    assert ((q > 0.5) == y).mean() > 0.9


# ---- 5
def test_lines_same_as_sql(spark, sf):
    same(op5_line_dedup.query(spark, sf), engine(sf).sql(op5_line_dedup.ORACLE_SQL).df())


def edit(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_lines_within_two_edits_are_found(spark):
    rng = np.random.default_rng(5)
    base = ["".join(rng.choice(list("abcdeé "), 40)).strip() + " one two three four five" for _ in range(25)]
    lines = list(base)
    for s in base:
        for n in (1, 2, 3):
            t = list(s)
            for _ in range(n):
                k, kind = rng.integers(0, len(t)), rng.integers(0, 3)
                t[k : k + (kind != 0)] = [] if kind == 1 else ["z"]
            lines.append("".join(t))
    rows = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    removed = {r.doc_id for r in _removed(rows).collect() if r.removed}
    want = {i for i, a in enumerate(lines) for b in lines[:i] if abs(len(a) - len(b)) <= 2 and edit(a, b) <= 2 and len(words(a)) >= 5 and len(words(b)) >= 5}
    assert removed == want and len(want) > 25


def _removed(rows):
    lines = op5_line_dedup.Lines(rows)
    return lines.docs.join(lines.removed(), ["file_no", "row_no"], "left").select("doc_id", "removed")


def test_lines_in_large_groups_are_cut_in_blocks(spark):
    stem = "the quick brown fox jumps over the lazy dog and then it sleeps near number "
    rows = spark.createDataFrame([(i, f"{stem}{i:04d}") for i in range(400)], "doc_id long, text string")
    want = {i for i in range(400) if any(sum(a != b for a, b in zip(f"{i:04d}", f"{j:04d}")) <= 2 for j in range(i))}
    assert {r.doc_id for r in _removed(rows).collect() if r.removed} == want


def test_lines_of_messy_and_empty(spark, messy, none):
    got = {(r.doc_id, tuple(r.removed or ())) for r in _removed(messy).collect()}
    assert {(9, (2,)), (9, (1, 2)), (4, (0,))} <= got and (0, ()) in got
    stage = op5_line_dedup.stage(spark, messy, "").collect()
    assert {r.doc_id for r in stage} >= {0, 1, 2, 3, 9, 10} and sum(r.doc_id == 9 for r in stage) == 1
    assert _removed(none).count() == 0


@pytest.mark.parametrize("stage", [op5_line_dedup.stage, op7_mixing.stage, op9_jaccard_join.stage])
def test_stages_of_nothing_and_of_one_long_text(spark, none, stage):
    out = stage(spark, none, "")
    assert out.columns == none.columns and out.count() == 0
    long = " ".join(f"w{i % 70_001}x{i}" for i in range(200_000))
    one = spark.createDataFrame([(1, long, "a", len(long))], "doc_id long, text string, source string, n_chars long")
    got = stage(spark, one, "").collect()
    assert sorted(w for r in got for w in words(r.text)) == sorted(words(long))


def test_line_stage_keeps_short_lines(spark):
    passage = "a passage of words that other documents hold as well"
    rows = [(0, passage), (1, f"{passage}\nown short line\n他说的话没有空格"), (2, f"{passage}\n \t\n{passage}"), (3, f"{passage}\nown short line\n他说的话没有空格"), (4, f"short\n{passage}\n\nend")]
    table = spark.createDataFrame([(i, t, len(t)) for i, t in rows], "doc_id long, text string, n_chars long")
    got = {r.doc_id: (r.text, r.n_chars) for r in op5_line_dedup.stage(spark, table, "").collect()}
    want = {0: passage, 1: "own short line\n他说的话没有空格", 4: "short\n\nend"}  # 2 has no word left, 3 is 1 again
    assert got == {i: (t, len(t)) for i, t in want.items()}


# ---- 6
def test_rules_same_as_sql(spark, sf):
    same(op6_quality_rules.query(spark, sf), engine(sf).sql(op6_quality_rules.ORACLE_SQL).df())


def repeat_words(w):
    n = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    return len({j for i in range(len(w) - 7) if n[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)})


def test_rules_on_repeats(spark):
    rng = np.random.default_rng(2)
    rows = [(i, " ".join(rng.choice(list("ab"), rng.integers(0, 60)))) for i in range(60)]
    got = {r.doc_id: r for r in op6_quality_rules.judge(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, text in rows:
        w = words(text)
        assert (got[i].n_words, got[i].n_repeat_words) == (len(w), repeat_words(w))
        assert got[i].base_failed == (len(w) < 20 or 100 * repeat_words(w) > 30 * len(w))


def test_rules_of_messy_and_empty(messy, none):
    rows = op6_quality_rules.judge(messy).toPandas()
    assert len(rows) == len(MESSY) and not rows[rows.n_words == 0].kept.any()
    nine = rows[rows.doc_id == 9].iloc[0]
    assert nine.n_dup_lines == 0 and nine.n_words == 16  # the second copy ends in a carriage return
    assert op6_quality_rules.judge(none).count() == 0


# ---- 7
def test_targets():
    assert op7_mixing.fill_targets([100, 100, 100]) == [187.5, 75.0, 37.5]
    got = op7_mixing.fill_targets([10, 1000, 1000])
    assert got[0] == 30 and abs(sum(got) - 2010) < 1e-9 and abs(got[1] / got[2] - 2) < 1e-9
    assert op7_mixing.fill_targets([]) == [] and op7_mixing.fill_targets([0, 5]) == [0, 5]


def test_permutations_are_permutations():
    for n in (1, 2, 3, 7, 64, 1000):
        k = np.arange(n)
        assert sorted(op7_mixing.permuted(k, np.full(n, n), np.full(n, 9))) == list(range(n))
    a, b = (op7_mixing.permuted(np.arange(500), np.full(500, 500), np.full(500, s)) for s in (1, 2))
    assert (a != b).mean() > 0.9


def test_mix_meets_its_targets(spark):
    folder = "/root/testdata/sf0.01"
    rows, again = (op7_mixing.query(spark, folder).toPandas().sort_values("doc_id") for _ in range(2))
    assert rows.taken.tolist() == again.taken.tolist() and (rows.taken <= 3 * rows["size"]).all()
    source = {r.doc_id: r.source for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    by = rows.assign(source=rows.doc_id.map(source)).groupby("source").agg(taken=("taken", "sum"), target=("target", "first"), size=("source_size", "first"))
    assert (abs(by.taken / by.target - 1) < 0.03).all() and abs(by.target.sum() - rows["size"].sum()) < 1


def test_mix_taken_equals_its_drawn_parts(docs):
    mix = op7_mixing.Mix(docs)
    drawn = mix.drawn().groupBy("file_no", "row_no").agg({"words": "sum"}).toPandas().set_index(["file_no", "row_no"])["sum(words)"]
    taken = mix.taken().toPandas().set_index(["file_no", "row_no"]).taken
    assert drawn.sort_index().tolist() == taken.sort_index().tolist()


def test_mix_meets_small_targets_to_the_word(spark):
    for n in (1, 2, 3, 7, 100):
        image = op7_mixing.permuted(np.arange(n), np.full(n, n), np.full(n, 9))
        assert [op7_mixing.place_of(int(b), n, 9) for b in image] == list(range(n))
    sizes = [50] * 60 + [130] * 9 + [1, 127, 128, 129, 900]
    rows = [(10 * s + j, " ".join(f"w{i}" for i in range(j, n, 3)), f"s{s:03d}") for s, n in enumerate(sizes) for j in range(3)]
    mix = op7_mixing.Mix(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    taken = mix.rows.join(mix.taken(), ["file_no", "row_no"]).groupBy("source_no").agg({"taken": "sum"}).toPandas().set_index("source_no")["sum(taken)"]
    assert {r.source_no: round(r.target) for r in mix.sources.collect() if round(r.target)} == taken.to_dict()


def test_mix_draws_every_slot_once(spark, monkeypatch):
    monkeypatch.setattr(op7_mixing, "SHARD_SLOTS", 16)
    monkeypatch.setattr(op7_mixing, "SHARDS_A_TASK", 3)
    slots = [500, 0, 1, 37, 9]
    rows = op7_mixing.draw_counts(spark, slots).collect()
    assert sorted((r.source_no, k) for r in rows for k in range(r["first"], r["first"] + r.n)) == [(s, k) for s, n in enumerate(slots) for k in range(n)]
    size = Counter()
    for r in rows:
        size[r.shard] += r.n
    assert set(size) <= set(range(35)) and max(size.values()) < 40
    which, n = op7_mixing.draw(3, 1000, np.array([1, 0, 3]))
    assert which.tolist() == [0, 2] and n.sum() == 1000 and abs(n[0] - 250) < 60


def test_mix_of_many_sources(spark):
    rows = [(i, f"one two three {i} five", f"s{i % 2500}") for i in range(5000)]
    mix = op7_mixing.Mix(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    taken = {r.source_no: r.n for r in mix.rows.join(mix.taken(), ["file_no", "row_no"]).groupBy("source_no").agg({"taken": "sum"}).withColumnRenamed("sum(taken)", "n").collect()}
    assert all(abs(taken.get(r.source_no, 0) - r.target) <= 0.5 for r in mix.sources.collect())


def test_mixed_blocks_hold_what_was_drawn(spark, docs, texts):
    rows = op7_mixing.mixed_blocks(docs).collect()
    mix = op7_mixing.Mix(docs)
    assert sum(len(words(r.text)) for r in rows) == mix.taken().agg({"taken": "sum"}).first()[0]
    blocks = defaultdict(list)
    for r in rows:
        assert r.text in " ".join(words(texts[r.doc_id]))
        blocks[r.source_no, r.slot].append((r.at, len(words(r.text)), r.shard))
    for parts in blocks.values():
        parts.sort()
        assert [a for a, _, _ in parts] == [sum(n for _, n, _ in parts[:i]) for i in range(len(parts))] and len({s for *_, s in parts}) == 1
        assert sum(n for _, n, _ in parts) <= op7_mixing.BLOCK


def test_mix_of_messy_and_empty(spark, messy, none):
    mix = op7_mixing.Mix(messy)
    assert mix.rows.count() == len(MESSY)
    assert {r.source for r in mix.sources.collect()} == {"a", "b", "c", None}
    out = op7_mixing.stage(spark, messy, "").collect()
    assert out and all(r.n_chars == len(r.text) for r in out)
    assert op7_mixing.Mix(none).taken().count() == 0


# ---- 8
def nearest_by_force(m, ids, k=5, every=50):
    m = m / np.linalg.norm(m, axis=1, keepdims=True)
    out = {}
    for q in ids[ids % every == 0]:
        s = (m @ m[ids == q][0]).round(12)
        others = ids != q
        out[int(q)] = [(int(v), float(x)) for v, x in sorted(zip(ids[others], s[others]), key=lambda r: (-r[1], r[0]))[:k]]
    return out


def found_by(rows):
    out = defaultdict(list)
    for r in sorted(rows, key=lambda r: (r.query_id, r["rank"])):
        out[r.query_id].append((r.vec_id, round(r.score, 12)))
    return out


def test_neighbours_recall(spark):
    folder = "/root/testdata/sf0.1"
    got = found_by(op8_multiprobe.query(spark, folder).collect())
    e = spark.read.parquet(f"{folder}/embeddings.parquet").toPandas()
    want = nearest_by_force(np.array(e.embedding.tolist(), float), e.vec_id.to_numpy())
    assert set(got) == set(want) and all(len(v) == 5 for v in got.values())
    assert sum(len({v for v, _ in got[q]} & {v for v, _ in want[q]}) for q in want) >= 0.9 * 5 * len(want)


def test_neighbours_of_clusters_without_scoring_all_rows(spark):
    rng = np.random.default_rng(0)
    m = np.repeat(rng.standard_normal((320, 32)), 25, axis=0) + 0.3 * rng.standard_normal((8000, 32))
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], "vec_id long, embedding array<double>")
    search = op8_multiprobe.Search(table, 5, 50, "vec_id", "embedding")
    got, want = found_by(search.nearest().collect()), nearest_by_force(m, np.arange(8000))
    assert sum(len({v for v, _ in got[q]} & {v for v, _ in want[q]}) for q in want) >= 0.95 * 5 * len(want)
    assert search.scored().agg({"scored": "avg"}).first()[0] < 0.25 * 8000


def test_neighbours_ties_go_to_the_least_ids(spark):
    rng = np.random.default_rng(1)
    base = rng.standard_normal(8)
    multiples = np.array([base * (i + 1) for i in range(200)])
    hot = np.array([[1.0 if j == i % 7 else 0.0 for j in range(12)] for i in range(400)])
    for m in (multiples, hot, 1e200 * multiples):
        table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], "vec_id long, embedding array<double>")
        got, want = found_by(op8_multiprobe.nearest(table).collect()), nearest_by_force(m / np.abs(m).max(), np.arange(len(m)))
        assert {q: [v for v, _ in x] for q, x in got.items()} == {q: [v for v, _ in x] for q, x in want.items()}


def test_neighbours_of_messy_and_empty(spark):
    v = lambda *x: [float(y) if y is not None else None for y in x]
    rows = [(0, v(1, 0)), (1, v(1, 0)), (2, v(1, 0)), (3, v(2, 0)), (4, v(0, 0)), (5, None), (6, v(None, 1)), (7, v(float("nan"), 1)), (8, v(float("inf"), 1)), (9, v(1, 2, 3)), (50, v(0, 1)), (None, v(1, 1)), (1, v(1, 0))]
    table = spark.createDataFrame([(i, x, 1, 2) for i, x in rows], "vec_id long, embedding array<float>, code int, part int")
    got = defaultdict(list)
    for r in op8_multiprobe.nearest(table).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, round(r.score, 9)))
    assert got[0] == [(1, 1.0), (2, 1.0), (3, 1.0), (50, 0.0)]
    assert [x for x, _ in got[50]] == [0, 1, 2, 3] and set(got) == {0, 50}
    assert op8_multiprobe.nearest(table.where("false")).count() == 0


# ---- 9
def brute_classes(texts):
    sets = {}
    for i, t in texts.items():
        w = words(t)
        if w:
            sets[i] = frozenset(tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4)))
    same_set = defaultdict(list)
    for i, s in sets.items():
        same_set[s].append(i)
    nodes, parent, links = list(same_set), {}, Counter()
    parent = {s: s for s in nodes}

    def find(s):
        while parent[s] != s:
            s = parent[s]
        return s

    by = defaultdict(set)
    for k, s in enumerate(nodes):
        for g in s:
            by[g].add(k)
    for a, b in {p for held in by.values() for p in itertools.combinations(sorted(held), 2)}:
        both = len(nodes[a] & nodes[b])
        if 5 * both >= 4 * (len(nodes[a]) + len(nodes[b]) - both):
            links[a] += 1
            links[b] += 1
            parent[find(nodes[a])] = find(nodes[b])
    classes = defaultdict(list)
    for s in nodes:
        classes[find(s)] += same_set[s]
    out = {i: (min(c), 0) for c in classes.values() for i in c}
    for k, s in enumerate(nodes):
        for i in same_set[s]:
            out[i] = (out[i][0], links[k])
    return out


def test_jaccard_classes_same_as_brute_force(spark):
    folder = "/root/testdata/sf0.01"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    got = {r.doc_id: (r.class_id, r.n_links) for r in op9_jaccard_join.query(spark, folder).collect()}
    assert got == brute_classes(texts)


@pytest.mark.parametrize("nodes, shingles", [(20, 1 << 20), (384, 1000)])
def test_jaccard_large_groups_are_cut_in_blocks(spark, monkeypatch, nodes, shingles):
    monkeypatch.setattr(op9_jaccard_join, "BLOCK", nodes)
    monkeypatch.setattr(op9_jaccard_join, "ROOM", shingles)
    base = [f"t{i}" for i in range(120)]
    rng, texts = np.random.default_rng(4), {}
    for i in range(90):
        w = list(base)
        w[int(rng.integers(0, 120))] = f"x{i}"
        texts[i] = " ".join(w)
    rows = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: (r.class_id, r.n_links) for r in op9_jaccard_join.Join(rows).rows().collect()}
    assert got == brute_classes(texts)


@pytest.mark.parametrize("least", [2, 256])
def test_components_of_hubs_chains_and_circles(spark, monkeypatch, least):
    monkeypatch.setattr(components, "LEAST", least)
    star = [(1000, k) for k in range(1001, 1080)] + [(1040, 900)]
    chain = [(k + 1, k) for k in range(1, 12)] + [(12, 11), (7, 7)]
    circle = [(2000 + k, 2000 + (k + 1) % 9) for k in range(9)]
    edges = spark.createDataFrame(star + chain + circle + star[:20], "a long, b long")
    got = {r.node: r.root for r in components.components(edges, "test-edges").collect()}
    assert got == {900: 900} | {k: 900 for k in range(1000, 1080)} | {k: 1 for k in range(1, 13)} | {2000 + k: 2000 for k in range(9)}
    assert components.components(edges.limit(0), "test-edges").count() == 0


def test_prefixes_are_shortened_until_the_recall_suffices():
    forest = op9_jaccard_join
    low = forest.shortest()
    assert forest.recall_at(0.8, low) >= forest.RECALL > forest.recall_at(0.8, low + 1)


@pytest.mark.parametrize("near", [0, 2000])
def test_pairs_at_the_threshold_are_found_at_any_mix(spark, near):
    """400 pairs at exactly 4 / 5, alone or among 2,000 pairs that are nearly equal."""
    draw = random.Random(near)
    word = lambda: "".join(draw.choice("abcdefghij") for _ in range(8))
    rows = []
    for k in range(400):  # 40 shingles each, of which the last words change 36 / 45
        base = [word() for _ in range(44)]
        rows += [(2 * k, " ".join(base)), (2 * k + 1, " ".join([*base[:40], *(word() for _ in range(4))]))]
    for k in range(near):
        base = [word() for _ in range(80)]
        rows += [(100_000 + 2 * k, " ".join(base)), (100_001 + 2 * k, " ".join([*base[:-1], word()]))]
    sets = op9_jaccard_join.shingle_sets([rows[0][1], rows[1][1]])
    both = len(np.intersect1d(*sets))
    assert both / (len(sets[0]) + len(sets[1]) - both) >= 0.8
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    got = {r.doc_id: (r.class_id, r.n_links) for r in op9_jaccard_join.Join(docs).rows().collect()}
    assert sum(got[2 * k] == got[2 * k + 1] == (2 * k, 1) for k in range(400)) == 400
    assert all(got[100_001 + 2 * k] == (100_000 + 2 * k, 1) for k in range(near))


def test_runs_go_on_over_the_borders_of_tasks(spark, monkeypatch):
    """One run over many tasks is one class; a third of all rows are near copies."""
    base = [f"w{i}" for i in range(300)]
    rows = [(i, " ".join([*base[:297], f"own{i}", *base[298:]])) for i in range(300)] + [(1000 + i, " ".join(f"z{i}x{j}" for j in range(30))) for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    got = {r.doc_id: (r.class_id, r.n_links) for r in op9_jaccard_join.Join(docs).rows().collect()}
    assert all(got[i] == (0, 299) for i in range(300)) and all(got[1000 + i] == (1000 + i, 0) for i in range(600))


def test_runs_of_a_sorted_forest():
    import pyarrow as pa

    rng, forest = np.random.default_rng(7), op9_jaccard_join
    rows = sorted((int(t), int(h), int(lo), n) for n, (t, h, lo) in enumerate(zip(rng.integers(0, 2, 300), rng.integers(-2, 2, 300), rng.integers(0, 5, 300) << 47)))
    batch = pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], ["tree", "high", "low", "node"])
    for prefix in (4, 5, 8):
        runs = defaultdict(list)
        for t, h, lo, n in rows:
            runs[t, h, lo >> 16 * (8 - prefix)].append(n)
        want = {(t, n, r[0]) for (t, *_), r in runs.items() if len(r) > 1 for n in r}
        for size in (1, 7, 300):
            got = [x for b in forest._joined((batch.slice(i, size) for i in range(0, 300, size)), prefix) for x in zip(*(c.to_pylist() for c in b.columns))]
            assert {x[:3] for x in got if x[4] is None} == want
            first, last = sorted((x for x in got if x[4] is not None), key=lambda x: x[4])
            assert first[2] == rows[0][3] and last[2] == next(r[0] for (t, h, lo), r in runs.items() if rows[-1][3] in r)


def test_jaccard_chains_are_not_compared_in_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(op9_jaccard_join, "BLOCK", 8)
    texts = {i: " ".join(f"t{j}" for j in range(2 * i, 2 * i + 60)) for i in range(300)}
    pairs = []
    verified = op9_jaccard_join.saved
    monkeypatch.setattr(op9_jaccard_join, "saved", lambda df, name: (lambda out: (name == "jaccard-block-pairs" and pairs.append(out.count())) and out or out)(verified(df, name)))
    rows = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: (r.class_id, r.n_links) for r in op9_jaccard_join.Join(rows).rows().collect()}
    assert got == brute_classes(texts) and got[299][0] == 0
    assert pairs[0] < 0.8 * 38 * 37 / 2


def test_jaccard_of_messy_and_empty(spark, messy, none):
    rows = op9_jaccard_join.Join(messy).rows().toPandas()
    assert len(rows) == len(MESSY)
    by = rows.dropna(subset=["doc_id"]).drop_duplicates("doc_id").set_index("doc_id")
    assert by.class_id[3] == by.class_id[4] == by.class_id[5] == 3 and by.class_id[6] == by.class_id[7] == 6
    assert by.n_links[0] == by.n_copies[0] == 0 and by.n_copies[9] == 1
    kept = op9_jaccard_join.stage(spark, messy, "").toPandas()
    assert len(kept) == len(MESSY) - 4 and (kept.doc_id == 9).sum() == 1
    assert op9_jaccard_join.Join(none).rows().count() == 0


# ---- 10
def test_token_counts_equal_the_library(spark, docs, texts, messy, none):
    import public_tokenizers
    from sentencepiece import SentencePieceProcessor

    path = public_tokenizers.path("piece_bpe_32k.model")
    library = SentencePieceProcessor(model_file=path)
    for r in op10_token_counts.count_tokens(docs, path).collect():
        n = len(library.encode(texts[r.doc_id]))
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(texts[r.doc_id].encode()), n, n > 4096)
    got = Counter((r.doc_id, r.n_tokens) for r in op10_token_counts.count_tokens(messy, path).collect())
    assert got == Counter((i, len(library.encode(t or ""))) for i, t, *_ in MESSY)
    assert op10_token_counts.count_tokens(none, path).count() == 0


def test_piece_counts_on_odd_strings():
    import public_tokenizers

    counter = op10_token_counts.PieceCounter(public_tokenizers.path("piece_bpe_32k.model"))
    assert counter.by_chunk and len(counter.whole) > 10_000
    rng = np.random.default_rng(6)
    bits = ["a", "the", "The", " ", " ", "  ", "\n", "\n\n", ".", ", ", "é", "▁", "<s>", "\t", "\xa0", "日", "😀", "ing", "1", "\r\n", "<0x0A>", "\x00"]
    many = ["".join(rng.choice(bits, rng.integers(0, 9))) for _ in range(5000)]
    assert counter.count(many).tolist() == [len(x) for x in counter.library.encode(many)]


# ---- 4, few labels
@pytest.mark.parametrize("n", [22, 50, 200])
def test_few_labels_flag_no_clean_documents(spark, n):
    from pyspark.sql import functions as F

    d = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{d}/labels.parquet")
    docs = spark.read.parquet(f"{d}/documents.parquet").join(labels.select("doc_id"), "doc_id", "left_semi")
    some = [labels.where((F.col("toxic") == t) & ~op4_toxicity.held_out()).orderBy(F.xxhash64("doc_id", F.lit(0))).limit(n) for t in (0, 1)]
    got = op4_toxicity.score(docs, some[0].unionByName(some[1])).join(labels, "doc_id").toPandas()
    assert got[got.toxic == 0].predicted.mean() < 0.02 and got[got.toxic == 1].predicted.mean() > 0.5


def test_words_must_surely_exceed_their_share(spark):
    counts = spark.createDataFrame([("few", 3, 9), ("many", 60, 0), ("both", 20, 400), ("rare", 12, 1)], "key string, toxic long, clean long")
    assert {r.key for r in op4_toxicity.strong_keys(counts.where("key <> 'many'"), 22, 22).collect()} == set()
    assert {r.key for r in op4_toxicity.strong_keys(counts, 200, 4000).collect()} == {"many", "rare"}


def test_posterior_equals_a_plain_product_of_odds():
    draw = np.random.default_rng(4)
    toxic = draw.random(800) < 0.2
    votes = (draw.random((800, 6)) < np.where(toxic[:, None], 0.6, 0.01)).astype(np.float32)
    votes[:, 5] = votes[:, 4]  # an echo
    lexical = votes.any(axis=1)
    model = op4_toxicity.fit_label_model(votes, lexical, 0.2)
    for row, lex, got in zip(votes[:50], lexical, model.posterior(votes, lexical)):
        z = model.prior + (0 if lex else model.silence)
        for j, fires in enumerate(row):
            if fires:
                z += model.odds[j][int(row[model.parent[j]]) if model.parent[j] != j else 1]
        assert got == pytest.approx(1 / (1 + np.exp(-np.clip(z, -30, 30))), abs=1e-5)
    assert ((model.posterior(votes, lexical) > 0.5) == toxic).mean() > 0.93


# ---- 8, several blocks of queries
def test_blocks_of_queries_change_no_neighbours(spark, monkeypatch):
    draw = np.random.default_rng(8)
    centres = draw.standard_normal((40, 16))
    m = centres[draw.integers(0, 40, 2400)] + 0.1 * draw.standard_normal((2400, 16))
    rows = spark.createDataFrame([(i, v.astype(np.float32).tolist()) for i, v in enumerate(m)], "vec_id long, embedding array<float>")
    found = []
    for block in (op8_multiprobe.QUERY_BLOCK, 20):
        monkeypatch.setattr(op8_multiprobe, "QUERY_BLOCK", block)
        found.append(sorted((r.query_id, r["rank"], r.vec_id) for r in op8_multiprobe.nearest(rows).collect()))
    assert found[0] == found[1] and len(found[0]) == 48 * 5
