"""Quality classifier by attention-based multiple-instance learning.

A document is a bag of passages of about PASSAGE_BYTES bytes; only the bag has a label. Every passage is encoded (byte and byte-pair
frequencies, a few ratios, and how much its document repeats; then a hidden layer); gated attention weights, learnt from the
document labels, say how much each passage counts; the score is a logistic function of the weighted passage representation.

Training is a bounded sample: of the labelled rows that aren't held out, those whose doc_id hashes least (so the choice is one and the same on every
run), at most MAX_TRAINING of them and MAX_PASSAGES passages together; a row whose passages no longer fit is passed over. Every passage of a
chosen text teaches. It runs on the driver with numpy, on at most MAX_PASSAGES * PASSAGE_BYTES bytes (38 MB) and their features (100 MB).

Scoring reads every passage of every whole text in Arrow batches, PASSAGES_HELD at a time: attention sums are accumulated over the
parts of a long document, and of the word triples that tell how much it repeats the TRIPLES least hashes are kept, which
counts them exactly up to that number and within a few percent beyond.

Defined cases: null and empty texts are one empty passage and get a score like any other; a row without a label, or with a label
other than 0 and 1, teaches nothing; repeated labels of one doc_id count by their mean, rounded down; null doc_ids are
never held out and never learnt from; rows of one doc_id with different texts each teach, equal ones once; without labelled rows, or with one
class only, the score is that share for all.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tagloom.llm.common import free_name, positional, releasing

#: Most labelled rows that training sees, and passages of all of them.
MAX_TRAINING, MAX_PASSAGES = 4000, 64_000
PASSAGE_BYTES = 600
THRESHOLD = 0.3
FOLDS = 5
PAIR_BUCKETS = 256
HIDDEN, GATE = 24, 12
EPOCHS, BATCH, RATE, DECAY = 12, 64, 0.01, 1e-4
#: Passages whose features are held at once, and hashes of word triples of one document.
PASSAGES_HELD, TRIPLES = 1024, 1 << 14
#: Documents under so many bytes have too few words to tell how much they repeat.
LEAST_BYTES = 64
N_RATIOS = 8
N_FEATURES = 128 + PAIR_BUCKETS + N_RATIOS
_pick = np.random.default_rng(3)
#: Factors of a word's bytes, by place, and of a triple's words.
BYTE_FACTORS, WORD_FACTORS = (_pick.integers(0, 1 << 63, n, np.uint64) * np.uint64(2) + np.uint64(1) for n in (64, 3))
BLANK = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])


def passages(n_bytes: int) -> np.ndarray:
    """Borders of the passages of a text: equal parts of about PASSAGE_BYTES."""
    n = max(1, round(n_bytes / PASSAGE_BYTES))
    return np.linspace(0, n_bytes, n + 1).astype(np.int64)


def triples(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of three words of texts that stand one after the other, and the text of each."""
    where = np.flatnonzero(~BLANK[data])
    if not len(where):
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    of = np.searchsorted(starts, where, "right") - 1
    first = np.flatnonzero(np.concatenate(([True], (where[1:] != where[:-1] + 1) | (of[1:] != of[:-1]))))
    place = np.arange(len(where)) - np.repeat(first, np.diff(np.append(first, len(where))))
    word = np.add.reduceat((data[where].astype(np.uint64) + np.uint64(1)) * BYTE_FACTORS[place % 64], first)
    text, n = of[first], max(0, len(first) - 2)
    x = word[:n] * WORD_FACTORS[0] + word[1 : n + 1] * WORD_FACTORS[1] + word[2:] * WORD_FACTORS[2]
    x ^= x >> np.uint64(32)
    x *= np.uint64(0x9FB21C651E98DF25)
    x ^= x >> np.uint64(29)
    same = text[:n] == text[2:]
    return x[same], text[:n][same]


def repeat_share(data: np.ndarray) -> float:
    """How many of a document's word triples are repeats, from the TRIPLES least different hashes."""
    if len(data) < LEAST_BYTES:
        return 0.0
    least, total, at = np.empty(0, np.uint64), 0, 0
    while at < len(data):
        end = min(len(data), at + PASSAGES_HELD * PASSAGE_BYTES)
        x, _ = triples(data[at:end], np.zeros(1, np.int64))
        total += len(x)
        least = np.unique(np.concatenate([least, x]))[: TRIPLES + 1]
        at = end
    # beyond TRIPLES, their number follows from how close together the least ones lie
    different = len(least) if len(least) <= TRIPLES else TRIPLES * 2.0**64 / float(least[TRIPLES])
    return 1 - min(different, total) / max(1, total)


def repeat_shares(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """repeat_share of documents of few words that stand one after the other."""
    x, of = triples(data, starts)
    order = np.lexsort((x, of))
    x, of = x[order], of[order]
    new = np.concatenate(([True], (x[1:] != x[:-1]) | (of[1:] != of[:-1]))) if len(x) else np.empty(0, bool)
    different, total = np.bincount(of[new], minlength=len(starts)), np.bincount(of, minlength=len(starts))
    return np.where(sizes < LEAST_BYTES, 0.0, 1 - different / np.maximum(total, 1))


def features(data: np.ndarray, size: np.ndarray, repeat: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Features of passages of `size` bytes each, one after the other in data; of each one's document, its repeat_share and
    number of passages."""
    n, total = len(size), len(data)
    where = np.repeat(np.arange(n), size)
    low = np.minimum(data, 127)  # all bytes beyond ASCII are one
    single = np.bincount(where * 128 + low, minlength=n * 128).reshape(n, 128).astype(np.float32)
    pair = (low[:-1].astype(np.int64) * 31 + low[1:] * 7) % PAIR_BUCKETS if total > 1 else np.empty(0, np.int64)
    inside = where[:-1] == where[1:] if total > 1 else np.empty(0, bool)
    double = np.bincount((where[:-1] * PAIR_BUCKETS + pair)[inside], minlength=n * PAIR_BUCKETS).reshape(n, PAIR_BUCKETS).astype(np.float32) if total > 1 else np.zeros((n, PAIR_BUCKETS), np.float32)
    per = 1 / np.maximum(size, 1).astype(np.float32)[:, None]
    blank = single[:, [9, 10, 11, 12, 13, 32]].sum(1, keepdims=True)
    upper, lower = single[:, 65:91].sum(1, keepdims=True), single[:, 97:123].sum(1, keepdims=True) + single[:, 127:]
    digit, mark = single[:, 48:58].sum(1, keepdims=True), single[:, 33:48].sum(1, keepdims=True) + single[:, 58:65].sum(1, keepdims=True)
    ratios = np.concatenate([upper / (upper + lower + 1), digit * per, mark * per * 4, blank * per * 2, np.log1p(size)[:, None] / 8, repeat[:, None], np.log1p(count)[:, None] / 4, (size == 0)[:, None]], 1)
    return np.concatenate([np.sqrt(single * per) * 2, np.sqrt(double * per) * 2, ratios.astype(np.float32)], 1).astype(np.float32)


def features_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Features of all passages of documents of few words, and the document of each passage."""
    data, sizes = np.frombuffer(b"".join(texts), np.uint8), np.array([len(t) for t in texts], np.int64)
    borders = [passages(n) for n in sizes.tolist()]
    count = np.array([len(b) - 1 for b in borders])
    of = np.repeat(np.arange(len(texts)), count)
    repeat = repeat_shares(data, np.cumsum(sizes) - sizes, sizes)
    return features(data, np.concatenate([np.diff(b) for b in borders]), repeat[of], count[of]), of


def parts_of(text: bytes, repeat: float) -> Iterator[np.ndarray]:
    """Features of the passages of one document, PASSAGES_HELD of them at a time."""
    data, borders = np.frombuffer(text, np.uint8), passages(len(text))
    n = len(borders) - 1
    for lo in range(0, n, PASSAGES_HELD):
        own = borders[lo : min(n, lo + PASSAGES_HELD) + 1]
        yield features(data[own[0] : own[-1]], np.diff(own), np.full(len(own) - 1, repeat), np.full(len(own) - 1, n))


class Model:
    """Hidden layer, gated attention and a logistic output."""

    def __init__(self, n: int = N_FEATURES, seed: int = 7):
        pick = np.random.default_rng(seed)
        init = lambda a, b: (pick.standard_normal((a, b)) / np.sqrt(a)).astype(np.float32)
        self.mean, self.scale = np.zeros(n, np.float32), np.ones(n, np.float32)
        self.p = {"E": init(n, HIDDEN), "e": np.zeros(HIDDEN, np.float32), "V": init(HIDDEN, GATE), "U": init(HIDDEN, GATE), "w": init(GATE, 1), "o": init(HIDDEN, 1), "b": np.zeros(1, np.float32)}
        self.constant: float | None = None

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, ...]:
        p = self.p
        h = np.tanh((x - self.mean) / self.scale @ p["E"] + p["e"])
        t, s = np.tanh(h @ p["V"]), 1 / (1 + np.exp(-(h @ p["U"])))
        return h, t, s, (t * s @ p["w"])[:, 0]

    def sums(self, x: np.ndarray, of: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Attention weights and weighted codes, summed over the passages x of each of n documents. Logits of attention are
        bounded by the gate, so the sums need no shift, and those of a document's parts add up."""
        h, _, _, a = self.encode(x)
        weight = np.exp(a)
        return np.bincount(of, weight, n), np.stack([np.bincount(of, weight * h[:, k], n) for k in range(HIDDEN)], 1)

    def outcome(self, total: np.ndarray, z: np.ndarray) -> np.ndarray:
        """Scores from such sums."""
        return 1 / (1 + np.exp(-(z / total[:, None] @ self.p["o"] + self.p["b"])[:, 0].astype(np.float64)))

    def score(self, x: np.ndarray, of: np.ndarray, n: int) -> np.ndarray:
        """Scores of n documents whose passages are x."""
        return np.full(n, self.constant) if self.constant is not None else self.outcome(*self.sums(x, of, n))

    def score_long(self, text: bytes) -> float:
        """Score of one document, of any length."""
        if self.constant is not None:
            return self.constant
        total, z = np.zeros(1), np.zeros((1, HIDDEN))
        for x in parts_of(text, repeat_share(np.frombuffer(text, np.uint8))):
            t, w = self.sums(x, np.zeros(len(x), np.int64), 1)
            total, z = total + t, z + w
        return float(self.outcome(total, z)[0])

    def gradients(self, x: np.ndarray, of: np.ndarray, n: int, y: np.ndarray, weight_of: np.ndarray) -> dict[str, np.ndarray]:
        p = self.p
        h, t, s, a = self.encode(x)
        e = np.exp(a)
        share = (e / np.bincount(of, e, n)[of])[:, None].astype(np.float32)
        z = np.zeros((n, HIDDEN), np.float32)
        np.add.at(z, of, share * h)
        out = 1 / (1 + np.exp(-(z @ p["o"] + p["b"])))
        d_out = ((out[:, 0] - y) * weight_of / n).astype(np.float32)[:, None]
        d_z = (d_out @ p["o"].T)[of]
        # through the softmax: the weight of a passage moves with how its code differs from the document's
        d_a = (share * ((h - z[of]) * d_z).sum(1, keepdims=True)).astype(np.float32)
        d_ts = d_a @ p["w"].T
        d_t, d_s = d_ts * s * (1 - t * t), d_ts * t * s * (1 - s)
        d_h = (share * d_z + d_t @ p["V"].T + d_s @ p["U"].T) * (1 - h * h)
        return {"E": ((x - self.mean) / self.scale).T @ d_h, "e": d_h.sum(0), "V": h.T @ d_t, "U": h.T @ d_s, "w": (t * s).T @ d_a, "o": z.T @ d_out, "b": d_out.sum(0)}

    def fit(self, x: np.ndarray, of: np.ndarray, labels: np.ndarray, seed: int = 7) -> Model:
        """Learn from documents with labels, whose passages are x."""
        n = len(labels)
        if n == 0 or labels.min() == labels.max():
            self.constant = float(labels.mean()) if n else 0.5
            return self
        self.mean, self.scale = x.mean(0), x.std(0) + 0.02
        first = np.searchsorted(of, np.arange(n + 1))
        share = labels.mean()
        # the rarer class counts for as much as a quarter of the other: good documents are to be kept
        weight = np.where(labels == 0, max(1.0, 0.25 * share / (1 - share)), max(1.0, 0.25 * (1 - share) / share))
        pick = np.random.default_rng(seed)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v = {k: np.zeros_like(a) for k, a in self.p.items()}
        step = 0
        for epoch in range(EPOCHS):
            order = pick.permutation(n)
            for lo in range(0, len(order), BATCH):
                docs = order[lo : lo + BATCH]
                rows = np.concatenate([np.arange(first[d], first[d + 1]) for d in docs])
                bag = np.repeat(np.arange(len(docs)), first[docs + 1] - first[docs])
                g = self.gradients(x[rows], bag, len(docs), labels[docs], weight[docs])
                step += 1
                rate = RATE * (1 - epoch / EPOCHS)
                for k, a in self.p.items():
                    d = g[k] + DECAY * a
                    m[k] = 0.9 * m[k] + 0.1 * d
                    v[k] = 0.999 * v[k] + 0.001 * d * d
                    a -= rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
        return self


def bucket(doc_id: Column) -> Column:
    """The fold of a document: crc32 of its id as text."""
    return F.crc32(doc_id.cast("string").cast("binary")) % FOLDS


BAGS = "doc_id long, tie long, label int, repeat double, passages binary"


def bags(batches):
    """For mapInArrow: (doc_id, tie, label, text) -> BAGS, equal rows of a task once."""
    seen = set()
    for batch in batches:
        keys = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
        new = [k for k, key in enumerate(keys) if not (key in seen or seen.add(key))]
        some = batch.take(pa.array(new, pa.int64()))
        texts = [(t or "").encode() for t in some.column(3).to_pylist()]
        repeat = [repeat_share(np.frombuffer(t, np.uint8)) for t in texts]
        yield pa.RecordBatch.from_arrays([*some.columns[:3], pa.array(repeat, pa.float64()), pa.array(texts, pa.binary())], names=[x.split(" ")[0] for x in BAGS.split(", ")])


def training_rows(docs: DataFrame, labels: DataFrame, most: int = MAX_TRAINING, most_passages: int = MAX_PASSAGES) -> DataFrame:
    """BAGS of the labelled rows outside the held-out fold that are chosen."""
    label = labels.where("doc_id is not null and quality in (0, 1)").groupBy("doc_id").agg(F.floor(F.avg("quality")).cast("int").alias("label"))
    some = label.where(bucket(F.col("doc_id")) != 0).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    # at most MAX_TRAINING ids of 12 bytes are broadcast
    texts = docs.select("doc_id", "text").join(F.broadcast(some), "doc_id").select("doc_id", F.xxhash64("text").alias("tie"), "label", "text")
    n = F.greatest(F.lit(1), F.bround(F.coalesce(F.octet_length("text"), F.lit(0)) / PASSAGE_BYTES)).cast("long")
    first = texts.select("doc_id", "tie", n.alias("n")).distinct().orderBy(F.xxhash64("doc_id"), "doc_id", "tie").limit(most).collect()
    chosen, left = [], most_passages
    for r in first:
        if r.n <= left:
            chosen.append((r.doc_id, r.tie))
            left -= r.n
    keys = docs.sparkSession.createDataFrame(chosen, "doc_id long, tie long")  # at most MAX_TRAINING
    met = texts.join(F.broadcast(keys), ["doc_id", "tie"], "left_semi").select("doc_id", "tie", "label", "text")
    return met.mapInArrow(releasing(bags), BAGS).dropDuplicates(["doc_id", "tie"])


def train(docs: DataFrame, labels: DataFrame, most: int = MAX_TRAINING) -> Model:
    rows = training_rows(docs, labels, most).toArrow().sort_by([("doc_id", "ascending"), ("tie", "ascending")]).to_pylist()
    parts = [list(parts_of(r["passages"], r["repeat"])) for r in rows]
    of = np.repeat(np.arange(len(rows)), [sum(map(len, p)) for p in parts])
    x = np.concatenate([x for p in parts for x in p]) if rows else np.empty((0, N_FEATURES), np.float32)
    return Model().fit(x, of, np.array([r["label"] for r in rows], np.float64))


def scores_of(model: Model, texts: list[bytes]) -> np.ndarray:
    """Scores of texts, a bounded number of passages at a time."""
    out = np.empty(len(texts))
    held, n = [], 0

    def score() -> None:
        if held:
            out[held] = model.score(*features_of([texts[k] for k in held]), len(held))

    for k, text in enumerate(texts):
        size = max(1, round(len(text) / PASSAGE_BYTES))
        if size > PASSAGES_HELD // 4:
            out[k] = model.score_long(text)
            continue
        if n + size > PASSAGES_HELD:
            score()
            held, n = [], 0
        held.append(k)
        n += size
    score()
    return out


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """docs with a further last column, score."""
    name = free_name(docs, "score")
    at = docs.columns.index("text")
    schema = T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())])

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                part = batch.slice(lo, 500)
                texts = [(t or "").encode() for t in part.column(at).to_pylist()]
                columns = [*part.columns, pa.array(scores_of(model, texts), pa.float64())]
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return positional(docs).mapInArrow(releasing(run), schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    held_out = F.coalesce(bucket(F.col("doc_id")) == 0, F.lit(False))
    return scored(docs, model).select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def drop_low_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs whose score reaches the threshold, with the columns of docs."""
    out = scored(docs, train(docs, labels))
    return out.where(F.col(out.columns[-1]) >= THRESHOLD).drop(out.columns[-1])
