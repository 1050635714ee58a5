"""Document log-likelihood under a gated recurrent language model, written in numpy.

* **Counts.**  Words of all training documents are counted in Spark, combined per
  task before the shuffle; they are kept under 64-bit hashes.
* **Output.**  Class-factored softmax: P(word) = P(class | state) P(word | class).  The
  ``HEAD`` most frequent words form classes of ``MEMBERS``, whose inner softmax also
  depends on the state.  All other words belong to ``FORMS`` classes by their last
  three bytes; inside one, a word has its smoothed share (c + 1) / (N + V + 1), the
  last share being that of unknown words.  So every text has a proper probability.
* **State.**  One gated recurrent layer.  Documents are packed end to end into lanes
  that advance together; the state runs on from window to window through a whole
  document and is cleared only where the next one starts.
* **Training.**  Backpropagation truncated to windows of ``STEPS`` words, Adagrad.  A
  pilot on at most ``PILOT`` documents gives the start; then each task trains on all
  its training documents and the models are averaged by words (summed in Spark,
  in groups).  Every training document takes part, whatever the size of the input.
* **Scores.**  Words among the ``TABLE`` most frequent get their count from a table of
  that fixed size, sent to the tasks; the others are joined to the full counts.

Defined results: a null or empty text is its end token; repeated rows are scored
alike and trained on each; a null doc_id is not held out; without training documents
every word is unknown.
"""

from __future__ import annotations

import heapq
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from .common import numbered, read, saved

HEAD, MEMBERS, FORMS = 2048, 64, 64
TABLE = 1 << 19
HIDDEN, STEPS, LANES = 24, 32, 128
RATE = 0.08
#: words packed together
FULL = 4_000_000
PILOT = 2000
END = 0
LN10 = math.log(10)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 7 == 2, F.lit(False))


def parts(texts: list[bytes | None], volume: int = 8 << 20) -> Iterator[tuple[list[bytes], np.ndarray, list[int]]]:
    """(distinct words, word numbers in text order, end of each text) for a few MB of texts at a time."""
    at = 0
    while at < len(texts):
        words, ends, size = [], [], 0
        while at < len(texts) and size < volume:
            t = texts[at] or b""
            words += t.lower().split()  # bytes: A-Z only, and exactly the six white-space characters
            ends.append(len(words))
            size += len(t) + 1
            at += 1
        number = numbered(words)
        codes = np.fromiter(map(number.__getitem__, words), np.int64, len(words))
        yield list(number), codes, ends


def word_keys(words: list[bytes]) -> np.ndarray:
    from xxhash import xxh3_64_intdigest

    return np.fromiter(map(xxh3_64_intdigest, words), np.uint64, len(words)).view(np.int64)


def word_forms(words: list[bytes]) -> np.ndarray:
    return np.fromiter((zlib.crc32(w[-3:]) % FORMS for w in words), np.int32, len(words))


def word_counts(train: DataFrame) -> DataFrame:
    """(key, form, c) of all words and of the end token (key 0) in ``text`` of the training documents."""

    def run(batches):
        held, size, texts_seen = [], 0, 0

        def out():
            keys, forms, n = (np.concatenate([h[k] for h in held]) for k in range(3))
            keys, first, at = np.unique(keys, return_index=True, return_inverse=True)
            return pa.RecordBatch.from_arrays([pa.array(keys), pa.array(forms[first]), pa.array(np.bincount(at, weights=n).astype(np.int64))], ["key", "form", "c"])

        for b in batches:
            texts = b.column(0).to_pylist()
            texts_seen += len(texts)
            for words, codes, _ in parts(texts):
                held.append((word_keys(words), word_forms(words), np.bincount(codes, minlength=len(words))))
                size += len(words)
                if size > 2_000_000:
                    yield out()
                    held, size = [], 0
        held.append((np.array([END]), np.array([-1], np.int32), np.array([texts_seen])))
        yield out()

    got = train.select("text").mapInArrow(run, "key long, form int, c long")
    return saved(got.groupBy("key", "form").agg(F.sum("c").alias("c")).where("c > 0"))


class Vocabulary:
    """Counts of frequent words, head words with their classes, and totals of the form classes."""

    def __init__(self, counts: DataFrame):
        sizes = sorted(map(tuple, counts.groupBy("c").count().collect()), reverse=True)  # one row per different count
        least, room = None, TABLE
        for c, n in sizes:
            if n > room:
                break
            least, room = c, room - n
        top = counts.where(F.col("c") >= (sizes[0][0] + 1 if sizes and least is None else least or 0)).toArrow().to_pandas()  # TABLE rows at most
        head = top[top["key"] != END].sort_values(["c", "key"], ascending=[False, True]).head(HEAD - 1)
        self.order = np.argsort(top["key"].to_numpy())
        self.keys, self.c = top["key"].to_numpy()[self.order], top["c"].to_numpy()[self.order]
        total = counts.agg(F.sum("c").alias("n"), F.count("*").alias("v"), F.sum(F.when(F.col("key") == END, F.col("c"))).alias("e")).first()
        self.tokens, self.distinct, ends = total["n"] or 0, total["v"] or 0, total["e"] or 0
        hk = np.r_[np.int64(END), head["key"].to_numpy(np.int64)]
        self.head_order = np.argsort(hk)
        self.head_keys = hk[self.head_order]
        self.head_counts = np.r_[ends, head["c"].to_numpy(np.int64)]
        rows = counts.where("form >= 0").groupBy("form").agg(F.sum("c").alias("n"), F.count("*").alias("v")).collect()
        n, v = np.zeros(FORMS), np.zeros(FORMS)
        for r in rows:
            n[r["form"]], v[r["form"]] = r["n"], r["v"]
        np.subtract.at(n, head["form"].to_numpy(np.int64), head["c"].to_numpy(np.int64))
        np.subtract.at(v, head["form"].to_numpy(np.int64), 1)
        self.form_n, self.form_share = n, np.log10(n + v + 1)

    def count(self, keys: np.ndarray) -> np.ndarray:
        """Count of each key, 0 outside the table."""
        if not len(self.keys):
            return np.zeros(len(keys), np.int64)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.c[at], 0)

    def ids(self, keys: np.ndarray, forms: np.ndarray) -> np.ndarray:
        """Head words 0..HEAD-1 (0: end), form classes from HEAD on."""
        at = np.minimum(np.searchsorted(self.head_keys, keys), len(self.head_keys) - 1)
        return np.where(self.head_keys[at] == keys, self.head_order[at], HEAD + forms).astype(np.int32)


#: input ids: head words, forms, start of text
START = HEAD + FORMS
CLASSES = HEAD // MEMBERS
NAMES = ("table", "u", "wc", "bc", "ww", "bw")


def start_model(vocab: Vocabulary, seed: int = 7) -> dict[str, np.ndarray]:
    """Random recurrent weights; the output starts at the word frequencies."""
    rng = np.random.default_rng(seed)
    f = np.zeros(HEAD)
    f[: len(vocab.head_counts)] = vocab.head_counts
    mass = np.r_[f.reshape(CLASSES, MEMBERS).sum(1), vocab.form_n] + 1.0
    return {
        "table": rng.normal(0, 0.3, (START + 1, 3 * HIDDEN)).astype(np.float32), "u": rng.normal(0, 0.2, (HIDDEN, 3 * HIDDEN)).astype(np.float32),
        "wc": np.zeros((HIDDEN, CLASSES + FORMS), np.float32), "bc": np.log(mass / mass.sum()).astype(np.float32),
        "ww": np.zeros((CLASSES, HIDDEN, MEMBERS), np.float32), "bw": np.log((f + 0.1) / (f.reshape(CLASSES, MEMBERS).sum(1) + 0.1 * MEMBERS).repeat(MEMBERS)).reshape(CLASSES, MEMBERS).astype(np.float32),
    }


def pack(docs: list[np.ndarray], lanes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Targets, inputs and document numbers as (step, lane), lanes by falling length; -1 where a lane has ended."""
    lanes = max(1, min(lanes, len(docs)))
    heap, rows = [(0, k) for k in range(lanes)], [[] for _ in range(lanes)]
    for d in sorted(range(len(docs)), key=lambda d: -len(docs[d])):
        size, k = heapq.heappop(heap)
        rows[k].append(d)
        heapq.heappush(heap, (size + len(docs[d]), k))
    lengths = {k: size for size, k in heap}
    order = sorted(range(lanes), key=lambda k: -lengths[k])
    y = np.full((max(lengths.values()), lanes), -1, np.int32)
    x, who = np.full_like(y, START), np.full_like(y, -1)
    for col, k in enumerate(order):
        at = 0
        for d in rows[k]:
            n = len(docs[d])
            y[at : at + n, col], who[at : at + n, col] = docs[d], d
            x[at + 1 : at + n, col] = docs[d][:-1]
            at += n
    return y, x, who


def _sigmoid(a: np.ndarray) -> np.ndarray:
    """Of an array that is given up for it."""
    a *= np.float32(0.5)
    np.tanh(a, out=a)
    a *= np.float32(0.5)
    a += np.float32(0.5)
    return a


def forward(m: dict, x: np.ndarray, h: np.ndarray, keep: list | None = None) -> tuple[np.ndarray, np.ndarray]:
    """States of a window (step, lane, unit) and the last one; ``keep`` collects what the backward pass needs."""
    fed, out = m["table"][x], np.empty((*x.shape, HIDDEN), np.float32)
    fresh, k = x == START, HIDDEN
    starts = fresh.any(1)
    for t in range(len(x)):
        if starts[t]:
            h = np.where(fresh[t][:, None], np.float32(0), h)
        g = h @ m["u"]
        zr = _sigmoid(fed[t, :, : 2 * k] + g[:, : 2 * k])
        z, r, gn = zr[:, :k], zr[:, k:], g[:, 2 * k :]
        n = np.tanh(fed[t, :, 2 * k :] + r * gn)
        new = n + z * (h - n)
        if keep is not None:
            keep.append((h, z, r, gn, n))
        out[t] = h = new
    return out, h


def _exp(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """exp(a) in place and its row sums; rows are shifted only if values are large."""
    shift = a.max(1, keepdims=True) if a.size and a.max() > 60 else None
    if shift is not None:
        a -= shift
    np.exp(a, out=a)
    total = a @ np.ones(a.shape[1], a.dtype)
    return total, np.log(total) if shift is None else np.log(total) + shift[:, 0]


def output(m: dict, h: np.ndarray, y: np.ndarray, grads: dict | None = None) -> tuple[np.ndarray, np.ndarray | None]:
    """Natural log probability of class and head word for each state; with ``grads`` also the gradient by state."""
    cls = np.where(y < HEAD, y // MEMBERS, y - HEAD + CLASSES)
    p = h @ m["wc"]
    p += m["bc"]
    row = np.arange(len(y))
    lp, dh = p[row, cls], None
    total, logs = _exp(p)
    lp -= logs
    if grads is not None:
        p /= total[:, None]
        p[row, cls] -= 1
        grads["wc"], grads["bc"], dh = h.T @ p, p.sum(0), p @ m["wc"].T
        grads["ww"], grads["bw"] = np.zeros_like(m["ww"]), np.zeros_like(m["bw"])
    order = np.argsort(cls, kind="stable")
    bounds = np.searchsorted(cls[order], np.arange(CLASSES + 1))
    for c in range(CLASSES):
        at = order[bounds[c] : bounds[c + 1]]
        if len(at):
            hc, w, k = h[at], y[at] % MEMBERS, row[: len(at)]
            q = hc @ m["ww"][c]
            q += m["bw"][c]
            lq = q[k, w]
            total, logs = _exp(q)
            lp[at] += lq - logs
            if grads is not None:
                q /= total[:, None]
                q[k, w] -= 1
                grads["ww"][c], grads["bw"][c] = hc.T @ q, q.sum(0)
                dh[at] += q @ m["ww"][c].T
    return lp, dh


def train_on(m: dict, square: dict, docs: list[np.ndarray], rate: float = RATE) -> None:
    """One pass over the documents, in place."""
    y_all, x_all, _ = pack(docs, LANES)
    h = np.zeros((y_all.shape[1], HIDDEN), np.float32)
    for t0 in range(0, len(y_all), STEPS):
        lanes = int((y_all[t0] >= 0).sum())
        y, x, h = y_all[t0 : t0 + STEPS, :lanes], x_all[t0 : t0 + STEPS, :lanes], h[:lanes]
        kept: list = []
        states, h = forward(m, x, h, kept)
        live = y.ravel() >= 0
        grads: dict = {}
        _, dh_live = output(m, states.reshape(-1, HIDDEN)[live], y.ravel()[live], grads)
        dhs = np.zeros((y.size, HIDDEN), np.float32)
        dhs[live] = dh_live
        dhs = dhs.reshape(*y.shape, HIDDEN)
        before, z, r, gn, n = (np.stack(k) for k in zip(*kept, strict=True))
        # all factors of a state's gradient at once; only what runs back from step to step is left to the loop
        by_fed, by_g = np.empty((*y.shape, 3, HIDDEN), np.float32), np.empty((*y.shape, 3, HIDDEN), np.float32)
        by_n = (1 - z) * (1 - n * n)
        by_fed[:, :, 0], by_fed[:, :, 1], by_fed[:, :, 2] = (before - n) * z * (1 - z), by_n * gn * r * (1 - r), by_n
        by_g[:, :, :2], by_g[:, :, 2] = by_fed[:, :, :2], by_n * r
        dg, u, fresh, back = by_g.reshape(*y.shape, 3 * HIDDEN), np.ascontiguousarray(m["u"].T), x == START, np.float32(0)
        starts = fresh.any(1)
        for t in range(len(y) - 1, -1, -1):
            d = dhs[t]
            d += back
            by_g[t] *= d[:, None]
            back = dg[t] @ u
            back += d * z[t]
            if starts[t]:
                back[fresh[t]] = 0
        by_fed *= dhs[:, :, None]
        grads["u"] = before.reshape(-1, HIDDEN).T @ dg.reshape(-1, 3 * HIDDEN)
        ids = x.ravel()
        order = np.argsort(ids, kind="stable")
        cut = np.flatnonzero(np.r_[True, np.diff(ids[order]) > 0])
        rows, by_row = ids[order][cut], np.add.reduceat(by_fed.reshape(-1, 3 * HIDDEN)[order], cut, axis=0)
        scale = np.float32(1 / math.sqrt(max(1, int(live.sum()))))
        for name, g in grads.items():
            g = np.clip(g * scale, -5, 5).astype(np.float32)
            square[name] += g * g
            m[name] -= np.float32(rate) * g / np.sqrt(square[name])
        g = np.clip(by_row * scale, -5, 5)
        square["table"][rows] += g * g
        m["table"][rows] -= np.float32(rate) * g / np.sqrt(square["table"][rows])


def _fresh_squares(m: dict) -> dict:
    return {k: np.full_like(v, 0.1) for k, v in m.items()}


def _docs(texts: list[bytes | None], vocab: Vocabulary) -> Iterator[list[np.ndarray]]:
    """Model ids of the texts, each closed by the end token."""
    for words, codes, ends in parts(texts):
        ids = vocab.ids(word_keys(words), word_forms(words))[codes] if words else np.zeros(0, np.int32)
        yield [np.r_[ids[a:b], np.int32(END)] for a, b in zip([0, *ends[:-1]], ends)]


def _trainer(shared, size: int):
    """Train from the shared model on all texts of a task; rows (chunk, words, weights)."""

    def run(batches):
        vocab, start = shared.value
        m, n = {k: v.copy() for k, v in start.items()}, 0
        square, held, size_held = _fresh_squares(m), [], 0
        for b in batches:
            for docs in _docs(b.column(0).to_pylist(), vocab):
                held, size_held = held + docs, size_held + sum(map(len, docs))
                if size_held >= FULL:  # enough to keep the lanes busy beside a very long text
                    train_on(m, square, held)
                    n, held, size_held = n + size_held, [], 0
        if held:
            train_on(m, square, held)
            n += size_held
        flat = np.concatenate([m[k].ravel() for k in NAMES])
        pieces = np.array_split(flat, size) if n else []
        yield pa.RecordBatch.from_arrays([pa.array(range(len(pieces)), pa.int32()), pa.array([n] * len(pieces), pa.int64()), pa.array([p.tobytes() for p in pieces], pa.binary())], ["chunk", "n", "w"])

    return run


def average(rows: DataFrame, like: dict) -> dict | None:
    """Mean of the models in (chunk, n, w) rows by words, in groups of at most about 256."""

    def add(table: pa.Table) -> pa.Table:
        n = table["n"].to_pylist()
        total = sum(np.frombuffer(w, np.float32).astype(np.float64) * k for w, k in zip(table["w"].to_pylist(), n)) / sum(n)
        return pa.table({"chunk": table["chunk"][:1], "n": pa.array([sum(n)], pa.int64()), "w": pa.array([total.astype(np.float32).tobytes()], pa.binary())})

    rows = rows.withColumn("salt", F.pmod(F.xxhash64("w"), F.lit(256)))
    for _ in range(2):
        rows = rows.groupBy("chunk", "salt").applyInArrow(add, "chunk int, n long, w binary").withColumn("salt", F.lit(0))
    got = {r["chunk"]: np.frombuffer(r["w"], np.float32) for r in rows.collect()}  # one model
    if not got:
        return None
    flat, out, at = np.concatenate([got[k] for k in sorted(got)]), {}, 0
    for k in NAMES:
        out[k] = flat[at : at + like[k].size].reshape(like[k].shape).copy()
        at += like[k].size
    return out


def fit(train: DataFrame, vocab: Vocabulary, pilot: int = PILOT, chunks: int = 16) -> dict[str, np.ndarray]:
    """Model trained on ``doc_id, text`` of the training documents."""
    sc, m = train.sparkSession.sparkContext, start_model(vocab)
    key = F.xxhash64(F.col("doc_id").cast("string"))
    first = saved(train.where("doc_id is not null").select(key.alias("k")).distinct().orderBy("k").limit(pilot))
    few = train.where("doc_id is not null").withColumn("k", key).join(F.broadcast(first), "k")  # at most `pilot` ids
    few = few.orderBy("k").select(F.col("text").cast("string").cast("binary").alias("text")).coalesce(1)
    m = average(few.mapInArrow(_trainer(sc.broadcast((vocab, m)), chunks), "chunk int, n long, w binary"), m) or m
    all_of = train.select(F.col("text").cast("string").cast("binary").alias("text"))
    return average(all_of.mapInArrow(_trainer(sc.broadcast((vocab, m)), chunks), "chunk int, n long, w binary"), m) or m


def log_probabilities(m: dict, docs: list[np.ndarray], lanes: int = 256, steps: int = 64) -> np.ndarray:
    """Natural log of class and head-word probabilities, summed per document."""
    y_all, x_all, who = pack(docs, lanes)
    h, total = np.zeros((y_all.shape[1], HIDDEN), np.float32), np.zeros(len(docs))
    for t0 in range(0, len(y_all), steps):
        lanes = int((y_all[t0] >= 0).sum())
        y, h = y_all[t0 : t0 + steps, :lanes].ravel(), h[:lanes]
        states, h = forward(m, x_all[t0 : t0 + steps, :lanes], h)
        live = y >= 0
        lp, _ = output(m, states.reshape(-1, HIDDEN)[live], y[live])
        total += np.bincount(who[t0 : t0 + steps, :lanes].ravel()[live], weights=lp, minlength=len(docs))
    return total


def score_texts(docs: DataFrame, counts: DataFrame, vocab: Vocabulary, model: dict) -> DataFrame:
    """doc_id, n_tokens, n_known, base_score, score of ``doc_id, text`` rows."""
    shared = docs.sparkSession.sparkContext.broadcast((vocab, model))
    out = T.StructType([docs.schema["doc_id"], *T.StructType.fromDDL("row_key long, n_tokens long, known long, shares double, lm double, keys array<long>, times array<long>").fields])

    def run(batches):
        v, m = shared.value
        at = TaskContext.get().partitionId() << 33
        end_count = int(v.head_counts[0])
        for b in batches:
            cols: list[list] = [[] for _ in range(6)]
            packed: list[np.ndarray] = []
            for words, codes, ends in parts(b.column(1).to_pylist()):
                keys, forms = word_keys(words), word_forms(words)
                c, ids = v.count(keys), v.ids(keys, forms)
                tail = ids >= HEAD
                gain = np.where(c > 0, np.log10(c + 1.0), 0.0)
                within = np.where(tail, gain - v.form_share[forms], 0.0)
                rows = [np.r_[ids[codes[a:e]], np.int32(END)] for a, e in zip([0, *ends[:-1]], ends)]
                packed += rows
                for a, e in zip([0, *ends[:-1]], ends):
                    own = codes[a:e]
                    far, times = np.unique(own[c[own] == 0], return_counts=True)
                    cols[0].append(len(own) + 1)
                    cols[1].append(int((c[own] > 0).sum()) + (end_count > 0))
                    cols[2].append(float(gain[own].sum()) + math.log10(end_count + 1))
                    cols[3].append(float(within[own].sum()))
                    cols[4].append(keys[far])
                    cols[5].append(times)
            n = len(cols[0])
            lm = log_probabilities(m, packed) / LN10 if n else np.zeros(0)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.arange(at, at + n)), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.float64()), pa.array(np.array(cols[3], np.float64) + lm), pa.array(cols[4], pa.list_(pa.int64())), pa.array(cols[5], pa.list_(pa.int64()))], out.names)
            at += n

    rows = saved(docs.select("doc_id", F.col("text").cast("string").cast("binary").alias("text")).mapInArrow(run, out))
    far = rows.select("row_key", F.explode(F.arrays_zip("keys", "times")).alias("w")).select("row_key", F.col("w.keys").alias("key"), F.col("w.times").alias("times"))
    more = far.join(counts.select("key", "c"), "key").groupBy("row_key").agg(F.sum(F.col("times") * F.log10(F.col("c") + 1)).alias("gain"), F.sum("times").alias("found"))
    gain = F.coalesce("gain", F.lit(0.0))
    base = F.col("shares") + gain - F.col("n_tokens") * F.lit(math.log10(vocab.tokens + vocab.distinct + 1))
    return rows.join(more, "row_key", "left").select("doc_id", "n_tokens", (F.col("known") + F.coalesce("found", F.lit(0))).alias("n_known"), base.alias("base_score"), (F.col("lm") + gain).alias("score"))


def score_documents(docs: DataFrame) -> tuple[DataFrame, Vocabulary]:
    """Counts and model from the training documents, scores of all (``doc_id, text``)."""
    docs = docs.select("doc_id", "text")
    train = docs.where(~held_out(F.col("doc_id")))
    counts = word_counts(train.select(F.col("text").cast("string").cast("binary").alias("text")))
    vocab = Vocabulary(counts)
    return score_texts(docs, counts, vocab, fit(train, vocab)), vocab


def op9_neural_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    out, vocab = score_documents(read(spark, sf_dir, "documents"))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "n_tokens", "n_known", F.lit(vocab.tokens).cast("long").alias("train_tokens"), "base_score", "score")
