"""Toxicity: a bidirectional gated recurrent network with attention pooling, trained in numpy.

A word's input is a hashed word embedding plus the sum of the embeddings of its 3- and 4-character
grams (bytes of the lower-cased word, edges included). Forward and backward gated recurrent units run
over windows of WINDOW words that overlap by WINDOW - STRIDE, so that a passage of up to WINDOW - STRIDE
+ 1 words lies whole in one wherever it stands; attention pools the states of a window,
a linear unit scores it, and a document's score is that of its worst window, shifted so that 0.5 parts
the classes of the sample best. A fifth of the sample never enters the gradient; the epoch is that with the
fewest errors on this part and on the rest together.

Training takes at most POSITIVES and NEGATIVES labelled documents of at most SAMPLE_BYTES each (the
first in order of a hash of doc_id). As labels are of documents, each epoch learns from the window that
now scores highest in each document and from a random one in each clean document.

Defined results: texts without a word (null, empty, digits only) score 0; with no labels of both
kinds every score is 0; contradictory labels of one document count as toxic, null labels not at all; of
rows that repeat a doc_id the smallest text is learned; ties of the worst window don't matter; very long
texts are scored whole; repeated rows score alike; an empty table gives an empty result; other columns are
ignored, or kept by drop_toxic, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.llm.base import LOWER, NO_LETTER, batched, fold, joined_bytes, spans, summed, trimmed, word_hashes, words

POSITIVES, NEGATIVES, SAMPLE_BYTES = 1200, 1800, 6000
WINDOW, STRIDE, INPUT, HIDDEN, BITS, SEED = 32, 16, 16, 8, 15, 11


def vocabulary(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts of the words, their numbers among the distinct ones, and of these: word bucket, gram buckets, gram counts.

    data: lower-cased bytes that end with a byte between words.
    """
    starts, ends = words(data, NO_LETTER)
    hashes, first, number = np.unique(word_hashes(data, starts, ends), return_index=True, return_inverse=True)
    s, n = starts[first], (ends - starts)[first]
    pad = np.concatenate([np.full(1, 32, np.uint8), np.where(NO_LETTER[data], np.uint8(32), data), np.full(3, 32, np.uint8)]).astype(np.uint32)
    shift = np.uint32(32 - BITS)

    def code(at: np.ndarray, size: int) -> np.ndarray:
        x = np.zeros(len(at), np.uint32)
        for k in range(size):
            x |= pad[at + k] << np.uint32(8 * k)
        with np.errstate(over="ignore"):
            x = (x + np.uint32(size * 0x27D4EB2F)) * np.uint32(0x9E3779B1)
            return (x ^ (x >> np.uint32(15))) * np.uint32(0x85EBCA6B) >> shift

    # Of a word at s..s+n, padded: n grams of three and n - 1 of four, laid out one word after the other.
    count = 2 * n - 1
    three, four = code(spans(s, n), 3), code(spans(s, n - 1), 4)
    grams = np.empty(int(count.sum()), np.int64)
    at = np.cumsum(count) - count
    grams[spans(at, n)] = three
    grams[spans(at + n, n - 1)] = four
    return starts, number, (hashes >> np.uint64(64 - BITS)).astype(np.int64), grams, count


def windows(per_doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First word, words, and windows per document, for documents of so many consecutive words each."""
    n = np.where(per_doc > WINDOW, -(-(per_doc - WINDOW) // STRIDE) + 1, (per_doc > 0).astype(np.int64))
    base = np.repeat(np.cumsum(per_doc) - per_doc, n)
    step = spans(np.zeros(len(n), np.int64), n) * STRIDE
    return base + step, np.minimum(WINDOW, np.repeat(per_doc, n) - step), n


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


@dataclass
class Net:
    """Parameters by name, and the shift of a document's logit."""

    p: dict[str, np.ndarray] = field(default_factory=dict)
    shift: float = 0.0

    @staticmethod
    def fresh(seed: int = SEED) -> Net:
        rng = np.random.default_rng(seed)
        n = lambda *shape, s: rng.normal(0, s, shape).astype(np.float32)
        return Net({"word": n(1 << BITS, INPUT, s=0.05), "gram": n(1 << BITS, INPUT, s=0.05), "wx": n(2, INPUT, 3 * HIDDEN, s=0.3), "wh": n(2, HIDDEN, 3 * HIDDEN, s=0.3), "b": np.zeros((2, 3 * HIDDEN), np.float32), "v": n(2 * HIDDEN, s=0.3), "u": n(2 * HIDDEN, s=0.3), "c": np.zeros(1, np.float32)})

    def inputs(self, bucket: np.ndarray, grams: np.ndarray, count: np.ndarray) -> np.ndarray:
        """The input vectors of distinct words, and a zero row after them for places without a word."""
        out = np.zeros((len(bucket) + 1, INPUT), np.float32)
        for at in range(0, len(bucket), 50_000):  # a bound on the gathered rows
            part = slice(at, at + 50_000)
            first = int(count[:at].sum()) if at else 0
            own = grams[first : first + int(count[part].sum())]
            out[at : at + len(bucket[part])] = self.p["word"][bucket[part]] + summed(self.p["gram"][own], count[part])
        return out

    def states(self, x: list[np.ndarray], index: np.ndarray, real: np.ndarray, keep: list | None = None) -> np.ndarray:
        """(windows, WINDOW, 2 * HIDDEN): both directions' states. x: projected inputs by direction."""
        n, steps, h2 = len(index), index.shape[1], HIDDEN
        out = np.empty((steps, n, 2 * h2), np.float32)
        for d in (0, 1):
            h, wh = np.zeros((n, h2), np.float32), self.p["wh"][d]
            for t in range(steps) if d == 0 else range(steps - 1, -1, -1):
                xt, rec, m = x[d][index[:, t]], h @ wh, real[:, t, None]
                gates = sigmoid(xt[:, : 2 * h2] + rec[:, : 2 * h2])
                r, z = gates[:, :h2], gates[:, h2:]
                cand = np.tanh(xt[:, 2 * h2 :] + r * rec[:, 2 * h2 :])
                new = h + m * (1 - z) * (cand - h)
                if keep is not None:
                    keep.append((d, t, h, r, z, cand, rec[:, 2 * h2 :]))
                h = out[t, :, d * h2 : (d + 1) * h2] = new
        return out.transpose(1, 0, 2)

    def pooled(self, s: np.ndarray, real: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Logits, attention weights, pooled states."""
        a = np.where(real, s @ self.p["v"], -1e9)
        a = np.exp(a - a.max(axis=1, keepdims=True))
        a /= a.sum(axis=1, keepdims=True)
        pool = np.einsum("nt,nth->nh", a, s)
        return pool @ self.p["u"] + self.p["c"][0], a, pool

    def project(self, x: np.ndarray) -> list[np.ndarray]:
        return [x @ self.p["wx"][d] + self.p["b"][d] for d in (0, 1)]

    def logits(self, x: np.ndarray, number: np.ndarray, first: np.ndarray, size: np.ndarray, chunk: int = 1024) -> np.ndarray:
        """Of windows over `number`, the places of consecutive words in x."""
        xs, out = self.project(x), np.empty(len(first), np.float32)
        order = np.argsort(size, kind="stable")  # windows of like size together, so that short ones cost little
        padded = np.concatenate([number, np.zeros(WINDOW, number.dtype)])
        for at in range(0, len(order), chunk):
            own = order[at : at + chunk]
            steps = np.arange(int(size[own].max()))
            real = steps < size[own, None]
            index = np.where(real, padded[first[own, None] + steps], len(x) - 1)
            out[own] = self.pooled(self.states(xs, index, real), real)[0]
        return out

    def documents(self, data: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """The logits of documents' worst windows; minus infinity without words."""
        data = LOWER[data]
        word, number, bucket, grams, count = vocabulary(data)
        per_doc = np.diff(np.searchsorted(word, starts))
        first, size, n = windows(per_doc)
        out = np.full(len(per_doc), -np.inf)
        if len(first):
            one = self.logits(self.inputs(bucket, grams, count), number, first, size)
            out[n > 0] = np.maximum.reduceat(one, (np.cumsum(n) - n)[n > 0])
        return out

    def scores(self, data: np.ndarray, starts: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return sigmoid(self.documents(data, starts) - self.shift)


def gathered(rows: np.ndarray, to: np.ndarray, n: int) -> np.ndarray:
    """(n, width): the sums of the rows that go to each place."""
    order = np.argsort(to, kind="stable")
    return summed(rows[order], np.bincount(to, minlength=n))


def gradients(net: Net, x: np.ndarray, index: np.ndarray, real: np.ndarray, y: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """Of the mean cross-entropy of windows, for the dense parameters and for x."""
    p, h2, kept = net.p, HIDDEN, []
    s = net.states(net.project(x), index, real, kept)
    logit, a, pool = net.pooled(s, real)
    g = {k: np.zeros_like(p[k]) for k in ("wx", "wh", "b", "v", "u", "c")}
    dl = ((sigmoid(logit) - y) / len(y)).astype(np.float32)
    g["u"], g["c"][0] = pool.T @ dl, dl.sum()
    dpool = dl[:, None] * p["u"]
    da = np.einsum("nth,nh->nt", s, dpool)
    da = a * (da - (a * da).sum(axis=1, keepdims=True))
    g["v"] = np.einsum("nt,nth->h", da, s)
    ds = a[:, :, None] * dpool[:, None, :] + da[:, :, None] * p["v"]
    back = np.zeros((2, *real.shape, 3 * h2), np.float32)
    carry = {0: np.zeros((len(y), h2), np.float32), 1: np.zeros((len(y), h2), np.float32)}
    for d, t, h, r, z, cand, recn in reversed(kept):
        m, wh = real[:, t, None], p["wh"][d]
        dh = carry[d] + ds[:, t, d * h2 : (d + 1) * h2]
        dcand = dh * m * (1 - z) * (1 - cand**2)
        dz = dh * m * (h - cand) * z * (1 - z)
        dr = dcand * recn * r * (1 - r)
        back[d, :, t] = np.concatenate([dr, dz, dcand], axis=1)
        drec = np.concatenate([dr, dz, dcand * r], axis=1)
        carry[d] = dh * (1 - m * (1 - z)) + drec @ wh.T
        g["wh"][d] += h.T @ drec
    flat, dx = x[index.ravel()], np.zeros((index.size, INPUT), np.float32)
    for d in (0, 1):
        own = back[d].reshape(-1, 3 * h2)
        g["wx"][d], g["b"][d] = flat.T @ own, own.sum(axis=0)
        dx += own @ p["wx"][d].T
    return g, gathered(dx, index.ravel(), len(x))


def errors(logit: np.ndarray, y: np.ndarray) -> tuple[int, float]:
    """The fewest errors that a cut between the classes can have, and the cut: the middle of the widest best gap."""
    order = np.argsort(logit, kind="stable")
    value, toxic = logit[order], y[order] == 1
    # Cut k: the first k are clean.
    wrong = np.concatenate([[0], np.cumsum(toxic)]) + np.concatenate([np.cumsum(~toxic[::-1])[::-1], [0]])
    edge = np.concatenate([[value[0] - 2], value, [value[-1] + 2]])
    gap = np.diff(edge)
    gap[wrong > wrong.min()] = -1
    k = int(np.argmax(gap))
    return int(wrong.min()), float((edge[k] + edge[k + 1]) / 2)


def train(texts: list[str], toxic: list[int], epochs: int = 24, batch: int = 64, patience: int = 6, seed: int = SEED) -> Net | None:
    """Of texts in a fixed order; every fifth is set apart, for picking the epoch.

    Ends after `epochs`, or when no text is on the wrong side, or after `patience` epochs without gain.
    """
    import pyarrow as pa

    y = np.array(toxic, dtype=np.float32)
    if not len(y) or y.min() == y.max():
        return None
    rng, net = np.random.default_rng(seed), Net.fresh(seed)
    data, starts = joined_bytes(pa.array(texts, pa.string()))
    data = LOWER[data]
    word, number, bucket, grams, count = vocabulary(data)
    first, size, n = windows(np.diff(np.searchsorted(word, starts)))
    if not len(first):
        return None
    owner = np.repeat(np.arange(len(n)), n)
    full = np.flatnonzero(n)
    apart = np.arange(len(texts)) % 5 == 4
    if len(set(y[apart & (n > 0)])) < 2 or len(set(y[~apart & (n > 0)])) < 2:
        apart[:] = False
    past = {k: np.full_like(v, 1e-3) for k, v in net.p.items()}
    padded = np.concatenate([number, np.zeros(WINDOW, number.dtype)])
    at = np.cumsum(count) - count
    best_yet, kept, since = None, net.p, 0
    for epoch in range(epochs + 1):
        now = net.logits(net.inputs(bucket, grams, count), number, first, size)
        logit = np.maximum.reduceat(now, (np.cumsum(n) - n)[full])
        mine = ~apart[full]
        fit_wrong, cut = errors(logit[mine], y[full][mine])
        rest_wrong = int(((logit >= cut) != (y[full] == 1))[~mine].sum())
        found = (rest_wrong + fit_wrong, -abs(float(logit[y[full] == 1].mean() - logit[y[full] == 0].mean())))
        if epoch and (best_yet is None or found < best_yet):
            since = 0 if best_yet is None or found[0] < best_yet[0] else since + 1
            best_yet, kept = found, {k: v.copy() for k, v in net.p.items()}
        else:
            since += epoch > 0
        if epoch == epochs or since >= patience or (epoch >= 4 and not found[0]):
            break
        noisy = now + rng.normal(0, 1e-3, len(now))
        best = np.lexsort((-noisy, owner))
        best = best[np.concatenate([[True], np.diff(owner[best]) > 0])]
        some = rng.permutation(len(first))[: len(best)]
        bad = best[(y[owner[best]] == 1) & ~apart[owner[best]]]
        good = np.concatenate([best[y[owner[best]] == 0], some[y[owner[some]] == 0]])
        good = good[~apart[owner[good]]]
        early = some[(y[owner[some]] == 1) & ~apart[owner[some]]] if epoch < 2 else some[:0]
        # Rare toxic texts are seen more often, up to half as many as clean ones.
        rows = rng.permutation(np.concatenate([good, early, np.repeat(bad, max(1, len(good) // max(1, 2 * len(bad))))]))
        lr = 0.1 * (1 - epoch / epochs) + 0.01
        for k in range(0, len(rows), batch):
            own = rows[k : k + batch]
            steps = np.arange(int(size[own].max()))
            real = steps < size[own, None]
            seen, index = np.unique(padded[first[own, None] + steps][real], return_inverse=True)
            where = np.full(real.shape, len(seen))
            where[real] = index
            own_grams, own_count = grams[spans(at[seen], count[seen])], count[seen]
            x = net.inputs(bucket[seen], own_grams, own_count)
            g, dx = gradients(net, x, where, real.astype(np.float32), y[owner[own]])
            for name, grad in g.items():
                past[name] += grad**2
                net.p[name] -= lr * grad / np.sqrt(past[name])
            for name, rows_, grad in (("word", bucket[seen], dx[:-1]), ("gram", own_grams, np.repeat(dx[:-1], own_count, axis=0))):
                touched, inverse = np.unique(rows_, return_inverse=True)
                total = gathered(grad, inverse, len(touched))
                past[name][touched] += total**2
                net.p[name][touched] -= lr * total / np.sqrt(past[name][touched])
    net.p = kept
    logit = net.documents(data, starts)
    known = np.isfinite(logit)
    net.shift = errors(logit[known], y[known])[1]
    return net


def sample(docs: DataFrame, labels: DataFrame) -> tuple[list[str], list[int]]:
    """At most POSITIVES + NEGATIVES texts and labels: rows outside the held-out fold, in order of a hash of doc_id."""
    marked = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & (fold(F.col("doc_id")) % 5 != 0))
    marked = marked.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic")).withColumn("_tm_h", F.xxhash64("doc_id"))
    chosen = None
    for value, most in ((1, POSITIVES), (0, NEGATIVES)):
        part = marked.where((F.col("toxic") != 0) == F.lit(bool(value))).orderBy("_tm_h", "doc_id").limit(most)
        chosen = part if chosen is None else chosen.unionByName(part)
    rows = docs.where((F.octet_length("text") <= SAMPLE_BYTES) & F.col("text").isNotNull()).select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    # Of rows that repeat a doc_id one counts, so that no more than was chosen is collected.
    rows = rows.groupBy("doc_id").agg(F.min("text"), F.max("toxic"), F.max("_tm_h")).select("min(text)", "max(toxic)", "max(_tm_h)", "doc_id").collect()
    rows.sort(key=lambda r: (r[2], r[3], r[0]))
    return [r[0] for r in rows], [int(r[1] != 0) for r in rows]


def fitted(docs: DataFrame, labels: DataFrame) -> Net | None:
    net = train(*sample(docs, labels))
    trimmed(docs.sparkSession)
    return net


def scored(docs: DataFrame, net: Net | None):
    """A function from Arrow batches with a `text` column to tables and the scores of their rows."""
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches):
        for t in batched(batches, 2_000_000):
            net = shared.value
            yield t, np.zeros(t.num_rows) if net is None else net.scores(*joined_bytes(t.column("text")))

    return run


def toxicity(docs: DataFrame, labels: DataFrame, net: Net | None = None) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""
    score = scored(docs, net or fitted(docs, labels))

    def run(batches):
        import pyarrow as pa

        for t, s in score(batches):
            yield pa.RecordBatch.from_arrays([t.column("doc_id").combine_chunks(), t.column("held_out").combine_chunks(), pa.array(s, pa.float64()), pa.array((s >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    wanted = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (fold(F.col("doc_id")) % 5 == 0).alias("held_out"), "text")
    return wanted.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def drop_toxic(docs: DataFrame, labels: DataFrame, net: Net | None = None) -> DataFrame:
    """The documents that score below 0.5, with their own columns."""
    score = scored(docs, net or fitted(docs, labels))

    def run(batches):
        import pyarrow as pa

        for t, s in score(batches):
            yield from t.filter(pa.array(s < 0.5)).to_batches()

    return docs.mapInArrow(run, docs.schema)
