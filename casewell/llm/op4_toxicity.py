"""Operator 4, toxicity by weak supervision.

Voters are lexicon entries (written-down insults of four languages, and words or word beginnings that
training rows show far more often when they are labelled toxic, either at all or densely: by a ratio that
is ``LEAST_RATIO`` or more even ``ERRORS`` standard errors below its estimate) and surface patterns. A voter fires or abstains. A generative label model (two latent classes, fitted by expectation
maximisation on the votes) estimates how accurate each voter is and how voters go together: inside a class
a voter depends on at most one other, the one it is most correlated with, so a voter that only echoes
another adds little. A logistic regression is trained on the model's posteriors and scores every text.
Words are chosen on one half of the labelled documents; the other half sets the cut and must show that the
model finds more than the written-down lexicon alone by over one standard error, else the lexicon decides.

``SAMPLE`` bounds the labelled documents and the rows used for fitting (by order of hashes); scoring covers
every row. Rows with crc32(doc_id as text) % 4 == 2 are held out: their labels are never read.
Labels, lang, source and doc_id are no inputs of a score.

Defined results: null and empty texts fire nothing and get the score of silence, which is below the
threshold; a document labelled more than once counts as toxic if any label says so; null labels are ignored;
with fewer than ``LEAST_LABELS`` labelled documents of either class, or none of them told apart by a voter,
or no gain over it, only the written-down lexicon votes; repeated rows repeat (for fitting, rows with equal votes of a document
count once); an empty table gives no rows; other columns are ignored.
No text is shuffled: the sample of labels is joined by broadcast (its size is bounded by ``SAMPLE``).
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ship, slices, table, text_of

SAMPLE, MAX_INDUCED, LEAST_RATIO, STEMS, THRESHOLD = 20_000, 400, 8.0, (4, 5, 6, 7, 8), 0.3
#: Standard errors that a word's log ratio is lowered by.
ERRORS = 1.645
#: Labelled documents that either class must have for a fit.
LEAST_LABELS = 20
#: A dense voter fires if its key makes up this share of a text's words.
DENSE = 0.005

#: Common insults.
INSULTS = (
    "idiot moron stupid loser scum trash pathetic worthless disgusting clown dumb imbecile jerk filthy vermin garbage bastard "
    "idiote imbécile crétin débile abruti connard ordure minable pathétique stupide "
    "dummkopf trottel abschaum versager arschloch widerlich erbärmlich wertlos dumm "
    "idiota imbécil estúpido basura inútil payaso asqueroso patético perdedor"
).split()

#: name and RE2 pattern: fires if at least this many matches per 100 characters.
PATTERNS = [
    ("shouting", r"\p{Lu}", 30.0),
    ("exclaiming", r"!", 1.0),
    ("masked", r"\pL[*#@$]{2,}\pL*", 0.1),
    ("addressed", r"(?i)\b(you|you're|tu es|du bist|eres)\b", 0.2),
]
EDGES = ".,;:!?\"'()[]{}<>*_-–—«»“”‘’…#%$&|"


def keys_of(word: str) -> list[str]:
    """What a word may match: itself, and its beginnings (marked by a star)."""
    return [word, *(f"{word[:n]}*" for n in STEMS if len(word) >= n)]


def words_by_text(texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Distinct stripped lower-case words, the number of each word in turn, and where each text's words end."""
    lists = pc.utf8_split_whitespace(pc.utf8_lower(texts.cast(pa.large_string())))
    flat = lists.flatten().dictionary_encode()
    ends = np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False)).astype(np.int64)
    return [w.strip(EDGES) for w in flat.dictionary.to_pylist()], flat.indices.to_numpy(), ends


def _count_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts of either label that hold a key, one partial count per task."""
    toxic, clean = Counter(), Counter()
    for batch in (part for whole in batches for part in slices(whole, 2)):
        words, which, ends = words_by_text(batch.column(2))
        at = 0
        for label, end in zip(batch.column(1).to_pylist(), ends):
            n = Counter()
            for i, c in zip(*np.unique(which[at:end], return_counts=True)):
                if len(words[i]) > 2:
                    for k in keys_of(words[i]):
                        n[k] += int(c)
            found = [*n, *(f"{k}#" for k, c in n.items() if c >= DENSE * (end - at))]
            (toxic if label else clean).update(found)
            at = end
    keys = list(toxic)  # a key seen in no toxic text anywhere is of no use; its clean counts must still meet it
    keys += [k for k in clean if k not in toxic]
    if keys:
        yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array([toxic[k] for k in keys], pa.int64()), pa.array([clean[k] for k in keys], pa.int64())], ["key", "toxic", "clean"])


class Voters:
    """Keys (a ``#`` ends those that must be dense) and patterns in a fixed order; votes of a batch of texts."""

    def __init__(self, keys: list[str]):
        self.keys = keys
        self.plain = {k: i for i, k in enumerate(keys) if k[-1] != "#"}
        self.dense = {k[:-1]: i for i, k in enumerate(keys) if k[-1] == "#"}
        self.n = len(keys) + len(PATTERNS)

    def fired(self, texts: pa.Array) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
        """Per text: voters that fire; words that hit a key; words."""
        words, which, ends = words_by_text(texts)
        hits = [[k for k in keys_of(w) if k in self.plain or k in self.dense] for w in words]
        hot = np.fromiter(map(bool, hits), bool, len(hits))
        at = np.flatnonzero(hot[which]) if len(which) else np.zeros(0, np.int64)
        text = np.searchsorted(ends, at, "right")
        n_words = np.diff(np.concatenate([[0], ends]))
        counts: dict[int, Counter] = {}
        for t, w in zip(text.tolist(), which[at].tolist()):
            counts.setdefault(t, Counter()).update(hits[w])
        votes = [set() for _ in range(len(texts))]
        for t, found in counts.items():
            votes[t].update(self.plain[k] for k in found if k in self.plain)
            votes[t].update(self.dense[k] for k, c in found.items() if k in self.dense and c >= DENSE * n_words[t])
        size = np.maximum(1, pc.utf8_length(texts).to_numpy(zero_copy_only=False))
        for j, (_, pattern, least) in enumerate(PATTERNS):
            seen = pc.count_substring_regex(texts, pattern).to_numpy(zero_copy_only=False)
            for t in np.flatnonzero((seen * 100 >= least * size) & (seen > 0)):
                votes[t].add(len(self.keys) + j)
        n_hits = np.bincount(text, minlength=len(texts))
        return [np.array(sorted(v), np.int64) for v in votes], n_hits, n_words


def _votes(batches: Iterator[pa.RecordBatch], voters: Voters) -> Iterator[pa.RecordBatch]:
    for batch in (part for whole in batches for part in slices(whole, 2)):
        fired, hits, words = voters.fired(batch.column(2))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([f.tolist() for f in fired], pa.list_(pa.int64())), pa.array(hits.astype(np.int64)), pa.array(words.astype(np.int64))], ["doc_id", "toxic", "fired", "hits", "words"])


@dataclass
class LabelModel:
    """Firing rates in the toxic and the clean class; per voter the one it depends on (itself: none) and its log odds
    of the classes by whether it and that one fire; log odds of the prior and of a text where no lexicon voter fires."""

    toxic: np.ndarray
    clean: np.ndarray
    parent: np.ndarray
    odds: np.ndarray
    prior: float
    silence: float

    def posterior(self, votes: np.ndarray, lexical: np.ndarray, both: np.ndarray | None = None) -> np.ndarray:
        """Chance of the toxic class; ``both`` may hold the votes that a voter and its parent share."""
        both = votes * votes[:, self.parent] if both is None else both
        odds = self.odds.astype(votes.dtype)
        z = votes @ odds[:, 0] + both @ (odds[:, 1] - odds[:, 0])
        return 1 / (1 + np.exp(-np.clip(self.prior + z.astype(float) + np.where(lexical, 0, self.silence), -30, 30)))


def correlations(votes: np.ndarray, q: np.ndarray, toxic: np.ndarray, clean: np.ndarray) -> np.ndarray:
    """Of what the classes leave unexplained, from sums of products, so that no second matrix of votes is made."""
    n, more = len(votes), toxic - clean
    held, fired = (q.astype(votes.dtype) @ votes).astype(float), votes.sum(axis=0, dtype=float)
    cross = np.outer(held, more) + np.outer(fired, clean)
    model = (q @ q) * np.outer(more, more) + q.sum() * (np.outer(more, clean) + np.outer(clean, more)) + n * np.outer(clean, clean)
    mean = (fired - q.sum() * more) / n - clean
    cov = ((votes.T @ votes).astype(float) - cross - cross.T + model) / n - np.outer(mean, mean)
    spread = np.sqrt(np.maximum(np.diag(cov), 0)) + 1e-9
    return cov / np.outer(spread, spread)


def dependencies(corr: np.ndarray, least: float = 0.2) -> np.ndarray:
    """A forest over the voters: the strongest correlations first, none that closes a circle; each voter's parent, or itself."""
    n = len(corr)
    root, edges = np.arange(n), [[] for _ in range(n)]
    pairs = np.argwhere(np.triu(corr > least, 1))
    for i, j in pairs[np.argsort(-corr[tuple(pairs.T)], kind="stable")]:
        if root[i] != root[j]:
            root[root == root[j]] = root[i]
            edges[i].append(int(j))
            edges[j].append(int(i))
    parent, seen = np.arange(n), np.zeros(n, bool)
    for start in range(n):
        todo = [] if seen[start] else [start]
        while todo:
            i = todo.pop()
            seen[i] = True
            for j in edges[i]:
                if not seen[j]:
                    parent[j] = i
                    todo.append(j)
    return parent


def fit_label_model(votes: np.ndarray, lexical: np.ndarray, prior: float, rounds: int = 30) -> LabelModel:
    """votes: rows by voters, 0 or 1; lexical: rows where a lexicon voter fires."""
    q, alone, both = np.where(lexical, 0.9, 0.02), np.arange(votes.shape[1]), votes
    prior_odds, parent, model = float(np.log(prior / (1 - prior))), alone, None
    total, kind = votes.sum(axis=0, dtype=float), votes.dtype
    joint = total
    for step in range(rounds):
        n1, n0 = q.sum() + 1, (1 - q).sum() + 1
        fired = (q.astype(kind) @ votes).astype(float)
        toxic, clean = (fired + 0.05) / n1, (total - fired + 0.05) / n0
        silent1, silent0 = (q @ ~lexical + 0.5) / n1, ((1 - q) @ ~lexical + 0.5) / n0
        if step in (1, 5, 15, 25):
            parent = dependencies(correlations(votes, q, toxic, clean))
            both = votes * votes[:, parent]
            joint = both.sum(axis=0, dtype=float)
        together = (q.astype(kind) @ both).astype(float)
        rates = []  # of either class: given that the parent does not fire, given that it fires; drawn to the marginal
        for mass, rate, one, two in ((q.sum(), toxic, fired, together), (len(q) - q.sum(), clean, total - fired, joint - together)):
            above = one[parent]
            rates.append(((one - two + 0.5 * rate) / (mass - above + 0.5), (two + 0.5 * rate) / (above + 0.5)))
        marginal = np.log(toxic / clean)
        odds = np.column_stack([np.where(parent == alone, marginal, np.log(np.maximum(rates[0][k], 1e-9) / np.maximum(rates[1][k], 1e-9))) for k in (0, 1)])
        model = LabelModel(toxic, clean, parent, np.clip(odds, -6, 6), prior_odds, float(np.log(silent1 / silent0)))
        q = model.posterior(votes, lexical, both)
    return model


def features(votes: np.ndarray, hits: np.ndarray, words: np.ndarray) -> np.ndarray:
    share = 100 * hits / np.maximum(words, 1)
    return np.column_stack([np.ones(len(hits)), hits > 0, np.log1p(hits), np.log1p(share), votes])


def fit_logistic(x: np.ndarray, q: np.ndarray, penalty: float = 0.3, rounds: int = 25) -> np.ndarray:
    """Weights on soft labels, by Newton's method."""
    w, ridge = np.zeros(x.shape[1]), np.full(x.shape[1], penalty)
    ridge[0] = 1e-4
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x.T * (p * (1 - p) + 1e-9)) @ x + np.diag(ridge), x.T @ (q - p) - ridge * w)
        w += np.clip(step, -4, 4)
        if np.abs(step).max() < 1e-6:
            break
    return w


def cut(z: np.ndarray, toxic: np.ndarray, silent: float) -> float | None:
    """The log odds that parts training rows best (largest F1; the middle of the gap below), above those of a text
    where no voter fires; None if there are none."""
    order = np.argsort(-z, kind="stable")
    z, hit = z[order], np.cumsum(toxic[order])
    f1 = 2 * hit / (np.arange(1, len(z) + 1) + toxic.sum())
    f1[:-1][z[:-1] == z[1:]] = -1
    f1[z <= silent] = -1
    if not (f1 > 0).any():
        return None
    k = int(f1.argmax())
    return float((z[k] + max(silent, z[k + 1] if k + 1 < len(z) else silent)) / 2)


def _scores(batches: Iterator[pa.RecordBatch], voters: Voters, weights: np.ndarray, text: int, keep_text: bool, name: str = "score") -> Iterator[pa.RecordBatch]:
    """The batch with a score of that name; ``text`` is the number of its text column."""
    per_vote = weights[4:]
    for whole in batches:
        for batch in slices(whole, text):
            fired, hits, words = voters.fired(pc.fill_null(batch.column(text), ""))
            z = features(np.zeros((len(hits), 0)), hits, words) @ weights[:4] + np.array([per_vote[f].sum() for f in fired])
            score = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
            kept = [i for i in range(batch.num_columns) if keep_text or i != text]
            yield pa.RecordBatch.from_arrays([*map(batch.column, kept), pa.array(score)], [*(batch.schema.names[i] for i in kept), name])


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def lexicon(keys: list[str]) -> np.ndarray:
    """Weights where nothing can be fitted: any word of the lexicon marks a text."""
    weights = np.zeros(4 + len(keys) + len(PATTERNS))
    weights[:2] = -3, 5
    return weights


def strong_keys(counts: DataFrame, n1: int, n0: int) -> DataFrame:
    """Keys whose share in ``n1`` toxic texts surely exceeds that in ``n0`` clean ones, by the lowered log ratio."""
    t, c = F.col("toxic") + 0.5, F.col("clean") + 0.5
    lowered = F.log(t / (n1 + 1)) - F.log(c / (n0 + 1)) - ERRORS * F.sqrt(1 / t + 1 / c)
    return counts.withColumn("lowered", lowered).where((F.col("toxic") >= max(3, n1 // 500)) & (F.col("lowered") >= float(np.log(LEAST_RATIO))))


def f1(flagged: np.ndarray, toxic: np.ndarray) -> float:
    return 2 * float((flagged & toxic).sum()) / max(1, flagged.sum() + toxic.sum())


def gains(found: float, plain: float, n_toxic: int) -> bool:
    """Whether an F1 exceeds the lexicon's by over one standard error of a share among so many toxic texts."""
    return found > plain + float(np.sqrt(max(found * (1 - found), 0.25 / (n_toxic + 1)) / (n_toxic + 1)))


def fit(docs: DataFrame, labels: DataFrame) -> tuple[Voters, np.ndarray]:
    """Voters and classifier weights, from training rows only."""
    spark = ship(docs.sparkSession)
    usable = labels.where(~held_out() & F.col("toxic").isNotNull() & F.col("doc_id").isNotNull())
    sample = usable.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE)
    known = sample.withColumn("half", F.pmod(F.xxhash64("doc_id", F.lit("half")), F.lit(2))).toPandas()
    plain = list(dict.fromkeys(INSULTS))
    alone = Voters(plain), lexicon(plain)
    own = known[known.half == 0].toxic > 0
    if min((known.toxic > 0).sum(), (known.toxic <= 0).sum()) < LEAST_LABELS or own.all() or not own.any():
        return alone
    # the label of a row carries its half: 0 and 1 choose words, 2 and 3 set the cut
    marked = spark.createDataFrame([(int(i), int(t > 0) + 2 * int(h)) for i, t, h in zip(known.doc_id, known.toxic, known.half)], "doc_id long, toxic int")
    rows = docs.select("doc_id", text_of().alias("text")).join(F.broadcast(marked), "doc_id").select("doc_id", "toxic", "text")
    counts = rows.where("toxic < 2").mapInArrow(_count_keys, "key string, toxic long, clean long").groupBy("key").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    found = strong_keys(counts, int(own.sum()), int((~own).sum())).orderBy(F.desc(F.col("toxic") * F.col("lowered")), "key").limit(MAX_INDUCED).toPandas()
    keys = list(dict.fromkeys([*plain, *found.key]))
    voters = Voters(keys)
    voted = rows.mapInArrow(partial(_votes, voters=voters), "doc_id long, toxic int, fired array<long>, hits long, words long").distinct()
    got = voted.orderBy(F.xxhash64("doc_id", "fired", "hits", "words"), "doc_id").limit(SAMPLE).toPandas()  # SAMPLE bounds rows, not only documents
    votes = np.zeros((len(got), voters.n), np.float32)
    for i, f in enumerate(got.fired):
        votes[i, np.asarray(f, np.int64)] = 1
    code, lexical = got.toxic.to_numpy(), votes[:, : len(keys)].any(axis=1)
    toxic, judges = code % 2 > 0, code >= 2
    if min(toxic.sum(), (~toxic).sum()) < LEAST_LABELS or not toxic[judges].any() or toxic[judges].all():
        return alone
    model = fit_label_model(votes, lexical, min(0.5, max(0.01, float(toxic.mean()))))
    x = features(votes, got.hits.to_numpy(float), got.words.to_numpy(float))
    weights = fit_logistic(x, model.posterior(votes, lexical))
    z = x @ weights
    at = cut(z[judges], toxic[judges], float(weights[0]))
    by_lexicon = votes[:, : len(plain)].any(axis=1)
    if at is None or not gains(f1(z[judges] >= at, toxic[judges]), f1(by_lexicon[judges], toxic[judges]), int(toxic[judges].sum())):
        return alone
    weights[0] -= at - np.log(THRESHOLD / (1 - THRESHOLD))
    return voters, weights


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""
    voters, weights = fit(docs, labels)
    rows = docs.select("doc_id", held_out().alias("held_out"), "text")
    scored = rows.mapInArrow(partial(_scores, voters=voters, weights=weights, text=2, keep_text=False), "doc_id long, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``docs`` without the documents that are predicted toxic."""
    voters, weights = fit(docs, table(spark, sf_dir, "labels"))
    columns, name = docs.columns, "score"
    while name.lower() in (c.lower() for c in columns):
        name += "_"
    schema = ", ".join(f"`{c}` {t}" for c, t in docs.dtypes)
    scores = partial(_scores, voters=voters, weights=weights, text=columns.index("text"), keep_text=True, name=name)
    return docs.mapInArrow(scores, f"{schema}, `{name}` double").where(F.col(name) < THRESHOLD).select(*(F.col(f"`{c}`") for c in columns))
