"""Toxicity by weak supervision: lexicon and pattern voters, a generative label model, and a linear classifier on its posteriors.

1. A bounded sample of labelled training rows (``max_rows``) gives the lexicon: a seed list, and words and word beginnings that stand
   in toxic documents and hardly elsewhere, picked greedily so that each explains toxic documents that those before it don't.
2. Voters look at a document: one for each lexicon entry, and patterns (several hits, dense hits, repeated hits, no hit at all).
3. The label model estimates each voter's rates under both classes by EM, and the correlations of voters within a class.  Correlations have no
   term in its likelihood: a voter's weight is divided by its correlations of more than 0.3 with the others, so that voters that repeat each other count once.
4. A logistic regression on the voters' counts is trained on the posterior labels and set to the labelled rows' scale.

Scoring is one pass without a shuffle; the model is a small table of lexicon entries and weights.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from arcline.llm.common import DOUBLE, FOLD, INT, carried, read, stage, struct, text_slices

#: Insults that need no labels.
SEEDS = ("idiot", "idiots", "moron", "morons", "stupid", "loser", "losers", "clown", "scum", "trash", "worthless", "pathetic", "disgusting", "dumb", "retard", "imbecile", "garbage", "vermin", "freak", "bastard")
#: Lexicon entries: whole words (marked =) and word beginnings of so many bytes (marked ^).
BEGINNINGS = (4, 5, 6)
MAX_ROWS, MAX_ENTRIES = 20_000, 256
PATTERNS = ("no hit", "two entries", "three hits", "dense", "very dense")
NEW = struct(score=DOUBLE, predicted=INT)


@dataclass
class Model:
    entries: dict[bytes, int] = field(default_factory=dict)
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    bias: float = 0.0
    voters: list[dict] = field(default_factory=list)


def _words(data: bytes) -> list[bytes]:
    return data.translate(FOLD.tobytes()).split()


def _forms(word: bytes) -> list[bytes]:
    return [b"=" + word, *(b"^" + word[:n] for n in BEGINNINGS if len(word) >= n)]


def _hits(words: list[bytes], entries: dict[bytes, int]) -> Counter:
    """Lexicon hits; a word counts for each entry that it matches."""
    whole = {e[1:]: k for e, k in entries.items() if e[:1] == b"="}
    begins = {n: {e[1:]: k for e, k in entries.items() if e[:1] == b"^" and len(e) == n + 1} for n in BEGINNINGS}
    return _count(words, whole, begins)


def _count(words: list[bytes], whole: dict[bytes, int], begins: dict[int, dict[bytes, int]]) -> Counter:
    found = Counter(whole[w] for w in words if w in whole)
    for n, known in begins.items():
        if known:
            found.update(known[w[:n]] for w in words if w[:n] in known)
    return found


def _votes(hits: Counter, n_words: int, size: int) -> np.ndarray:
    """Whether each voter fires: entries, then patterns."""
    x = np.zeros(size + len(PATTERNS))
    for k in hits:
        x[k] = 1
    total = sum(hits.values())
    x[size:] = (total == 0, len(hits) >= 2, total >= 3, total >= 1 and total * 50 >= n_words, total >= 2 and total * 20 >= n_words)
    return x


def _inputs(hits: Counter, n_words: int, size: int) -> np.ndarray:
    """The classifier's inputs: dampened counts, then patterns."""
    x = _votes(hits, n_words, size)
    for k, n in hits.items():
        x[k] = 1 + math.log(n)
    return x


def sample(docs: DataFrame, labels: DataFrame, train: Column, max_rows: int = MAX_ROWS) -> DataFrame:
    """At most ``max_rows`` labelled training rows (text, toxic), one for each doc_id, chosen by a hash of doc_id.

    Where a doc_id has several labels any 1 wins; of rows that share a doc_id the smallest text counts.  Null texts are empty ones, null ids and null labels
    take no part, and empty tables give no rows.
    """
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).where(train).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    chosen = known.orderBy(F.xxhash64(F.lit(7), "doc_id"), "doc_id").limit(max_rows)
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")
    return rows.repartition(64, "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic")).select("text", "toxic")


def _per_row(rows: DataFrame, made, schema: T.StructType) -> DataFrame:
    """Apply ``made(list of words, toxic) -> list of tuples`` to each sampled row."""
    names = schema.fieldNames()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = pa.schema([(f.name, {"LongType()": pa.int64(), "IntegerType()": pa.int32(), "BinaryType()": pa.binary()}.get(repr(f.dataType), pa.list_(pa.int32()))) for f in schema])
        for batch in batches:
            for lo in range(0, batch.num_rows, 128):  # a text can give very many
                few = batch.slice(lo, 128)
                out = [x for text, toxic in zip(few.column(0), few.column(1), strict=True) for x in made(_words(text.as_py().encode("utf-8", "surrogatepass")), toxic.as_py())]
                yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], kinds.field(n).type) for i, n in enumerate(names)], schema=kinds)

    return rows.select("text", "toxic").mapInArrow(run, schema)


def _lexicon(rows: DataFrame, n_positive: int, n_negative: int, max_entries: int) -> list[bytes]:
    """Seeds, then the words and beginnings that the labels point to."""
    seeds = [b"=" + w.encode() for w in SEEDS]
    if not n_positive or not n_negative:
        return seeds
    least = max(4, math.ceil(0.004 * n_positive))
    form = T.StructType([T.StructField("form", T.BinaryType())])
    in_toxic = _per_row(rows.where("toxic = 1"), lambda words, _: [(f,) for f in {f for w in set(words) for f in _forms(w)}], form)
    often = {bytes(r["form"]): r["n"] for r in in_toxic.groupBy("form").agg(F.count("*").alias("n")).where(F.col("n") >= least).collect()}
    elsewhere = _per_row(rows.where("toxic = 0"), lambda words, _: [(f,) for f in {f for w in set(words) for f in _forms(w)} if f in often], form)
    clean = {bytes(r["form"]): r["n"] for r in elsewhere.groupBy("form").agg(F.count("*").alias("n")).collect()}
    odds = {f: (n / n_positive) / ((clean.get(f, 0) + 0.5) / n_negative) for f, n in often.items()}
    strong = {f: k for k, f in enumerate(sorted(f for f, x in odds.items() if x >= 20 and clean.get(f, 0) <= 0.1 * often[f]))}
    order = list(strong)
    held = _per_row(rows.where("toxic = 1"), lambda words, _: [(sorted({strong[f] for w in set(words) for f in _forms(w) if f in strong}),)], T.StructType([T.StructField("forms", T.ArrayType(T.IntegerType()))]))
    documents = [set(r["forms"]) for r in held.collect()]
    seed_keys = {strong[f] for f in seeds if f in strong}
    left = [d for d in documents if not d & seed_keys]
    picked: list[bytes] = []
    while left and len(picked) < max_entries - len(seeds):
        cover = Counter(k for d in left for k in d)
        k, n = max(cover.items(), key=lambda x: (x[1] - 2 * clean.get(order[x[0]], 0), order[x[0]][:1] == b"^", -len(order[x[0]]), order[x[0]]), default=(0, 0))
        if n < least:
            break
        picked.append(order[k])
        left = [d for d in left if k not in d]
    return seeds + [f for f in picked if f not in seeds]


def label_model(votes: np.ndarray, counts: np.ndarray, start: np.ndarray, rounds: int = 25) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, float]:
    """Rates of each voter under the classes by EM over distinct vote rows, and correlation-corrected weights.

    Returns rates (toxic), rates (clean), weights of a vote, each voter's correlation mass, and the share of toxic rows.
    """
    posterior, damp = start.astype(float), np.ones(votes.shape[1])
    for _ in range(rounds):
        up, down = counts * posterior, counts * (1 - posterior)
        share = float(np.clip(up.sum() / counts.sum(), 1e-4, 1 - 1e-4))
        a = (up @ votes + 0.5 * share) / (up.sum() + 1)
        b = (down @ votes + 0.05) / (down.sum() + 1)
        mass = np.ones(votes.shape[1])
        for w, rate in ((up, a), (down, b)):  # correlations within the class
            centred = votes - rate
            cov = (centred * w[:, None]).T @ centred / max(w.sum(), 1e-9)
            sd = np.sqrt(np.clip(np.diag(cov), 1e-9, None))
            corr = np.abs(cov / sd[:, None] / sd[None, :])
            np.fill_diagonal(corr, 0)
            mass += 0.5 * np.where(corr > 0.3, corr, 0).sum(axis=1)
        damp = 1 / mass
        fire, quiet = np.log(a / b), np.log((1 - a).clip(1e-9) / (1 - b).clip(1e-9))
        logit = math.log(share / (1 - share)) + (votes * (fire * damp) + (1 - votes) * (quiet * damp)).sum(axis=1)
        posterior = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
    return posterior, a, b, mass, share


def _logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray, ridge: float = 1.0, rounds: int = 40) -> tuple[np.ndarray, float]:
    """Weighted ridge logistic regression by Newton's method."""
    z = np.hstack([x, np.ones((len(x), 1))])
    penalty = np.full(z.shape[1], ridge)
    penalty[-1] = 1e-6
    beta = np.zeros(z.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ beta, -30, 30)))
        gradient = z.T @ (w * (p - y)) + penalty * beta
        hessian = (z * (w * np.clip(p * (1 - p), 1e-6, None))[:, None]).T @ z + np.diag(penalty)
        step = np.linalg.solve(hessian, gradient)
        beta -= step * min(1.0, 5 / max(1e-9, np.abs(step).max()))
        if np.abs(step).max() < 1e-6:
            break
    return beta[:-1], float(beta[-1])


def fit(rows: DataFrame, max_entries: int = MAX_ENTRIES) -> Model:
    """Fit on sampled ``rows`` (text, toxic): the at most ``max_rows`` of ``sample`` reach the driver, as counts of hits only.

    Without labelled rows the seeds vote alone.  Repeated rows count as often as they come; empty texts have no hits.
    """
    rows = stage(rows, "labelled")
    n = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    lexicon = _lexicon(rows, n.get(1, 0), n.get(0, 0), max_entries)
    entries = {f: k for k, f in enumerate(lexicon)}
    size = len(entries)
    schema = T.StructType([T.StructField("toxic", T.IntegerType()), T.StructField("words", T.LongType()), T.StructField("entries", T.ArrayType(T.IntegerType())), T.StructField("times", T.ArrayType(T.IntegerType()))])

    def counted(words: list[bytes], toxic: int) -> list[tuple]:
        hits = _hits(words, entries)
        return [(toxic, len(words), list(hits.keys()), list(hits.values()))]

    got = [(r["toxic"], r["words"], Counter(dict(zip(r["entries"], r["times"], strict=True)))) for r in _per_row(rows, counted, schema).collect()]
    if not got:
        got = [(1, 20, Counter({k: 1})) for k in range(size)] + [(0, 20, Counter())] * (9 * size)
    x = np.array([_inputs(h, w, size) for _, w, h in got])
    votes = np.array([_votes(h, w, size) for _, w, h in got])
    label = np.array([t for t, _, _ in got], float)
    distinct, back, counts = np.unique(votes, axis=0, return_inverse=True, return_counts=True)
    start = np.where(distinct[:, :size].sum(axis=1) > 0, 0.9, 0.02)
    posterior, a, b, mass, _ = label_model(distinct, counts.astype(float), start)
    soft = posterior[back.ravel()]
    weights, bias = _logistic(x, soft, np.ones(len(x)))
    if 0 < label.sum() < len(label):  # set the scale by the labels: two numbers
        slope, shift = _logistic((x @ weights + bias)[:, None], label, np.ones(len(x)), ridge=1e-3)
        if slope[0] > 0:
            weights, bias = weights * slope[0], bias * float(slope[0]) + shift
    names = [*(f.decode("utf-8", "replace") for f in lexicon), *PATTERNS]
    voters = [{"voter": v, "rate_toxic": float(p), "rate_clean": float(q), "correlation": float(m - 1), "weight": float(w)} for v, p, q, m, w in zip(names, a, b, mass, weights, strict=True)]
    return Model(entries, weights, bias, voters)


def score(docs: DataFrame, model: Model, *, text: str = "text", columns: list[str] | None = None, threshold: float = 0.7) -> DataFrame:
    """Add score (0 to 1) and predicted (1 from ``threshold``) to ``docs``; keeps ``columns`` (None: all, but those named like them).

    Null and empty texts have no hits and get the score of that; very long ones are taken whole.  Rows are scored one by one, so repeated rows score alike.
    An empty table gives no rows.
    """
    names, _ = carried(docs, NEW, columns)
    held = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def scored(texts: pa.Array) -> pa.Array:
        m = held.value
        size = len(m.entries)
        whole = {e[1:]: k for e, k in m.entries.items() if e[:1] == b"="}
        begins = {n: {e[1:]: k for e, k in m.entries.items() if e[:1] == b"^" and len(e) == n + 1} for n in BEGINNINGS}
        table = FOLD.tobytes()
        scores = []
        for lo, hi, data, offsets in text_slices(texts):
            for i in range(hi - lo):
                words = data[offsets[i] : offsets[i + 1]].tobytes().translate(table).split()
                x = _inputs(_count(words, whole, begins), len(words), size)
                scores.append(1 / (1 + math.exp(-min(30.0, max(-30.0, float(x @ m.weights) + m.bias)))))
        return pa.array(scores, pa.float64())

    out = docs.select(*[F.col(f"`{c}`") for c in names], scored(F.col(text)).alias("score"))  # only texts go to Python, only numbers come back
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def remainder(doc_id: str | Column, n: int) -> Column:
    """crc32 of doc_id as text, modulo n; a null doc_id counts as empty text."""
    return F.crc32(F.coalesce((F.col(doc_id) if isinstance(doc_id, str) else doc_id).cast("string"), F.lit(""))) % n


def op7(spark, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = fit(sample(docs, read(spark, sf_dir, "labels"), remainder("doc_id", 3) != 1))
    scored = score(docs, model, columns=["doc_id"])
    return scored.select("doc_id", (remainder("doc_id", 3) == 1).alias("held_out"), "score", "predicted")
