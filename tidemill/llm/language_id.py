"""Language identification: averaged hashed subword embeddings and a linear softmax, trained by SGD in numpy.

Features are the 3- and 4-byte grams of the words of the text (ASCII lower-cased), a gram's first or
last byte standing for the word's edge. Each gram has one of BUCKETS embeddings; their mean over the
whole text goes through a linear softmax. Training takes SAMPLE labelled documents in even shares of the
languages, or EACH of a language if that is more (the first in order of a hash of doc_id; of texts over
SAMPLE_BYTES the start), and of each up to 8 segments of 30 to 600 bytes, so that short texts are learned
too. A temperature is fitted on a fifth of them that the gradient never sees, and so is the
confidence below which a prediction is marked `rejected`.

Defined results: null text, and text without a letter, give `und` with score 0; so does every text
if there is nothing to learn from; ties go to the language first in code-point order; very long texts
are scored whole; repeated rows are scored alike; an empty table gives an empty result; other columns are
ignored, whatever their names.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemill.llm.base import LOWER, WHITE, batched, fold, joined_bytes, spans, summed

SAMPLE, EACH, SAMPLE_BYTES = 2000, 500, 20_000
BUCKETS_LOG2, SIZE, SEED = 16, 16, 7


def grams(data: np.ndarray, bits: int = BUCKETS_LOG2) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of the 3-grams and of the 4-grams that start at each byte, and bits that say which exist (1 and 2).

    A gram exists if only its first or last byte may be white. data starts and ends with white.
    """
    n = len(data)
    white = np.concatenate([WHITE[data], np.ones(4, bool)])
    d = np.concatenate([np.where(white[:n], np.uint8(32), LOWER[data]), np.full(4, 32, np.uint8)]).astype(np.uint32)
    three = d[:n] | (d[1 : n + 1] << 8) | (d[2 : n + 2] << 16)
    four = three | (d[3 : n + 3] << 24)
    inner = ~white[1 : n + 1]
    has3 = inner & ~(white[:n] & white[2 : n + 2] & white[1 : n + 1])
    has4 = inner & ~white[2 : n + 2]
    shift = np.uint32(32 - bits)
    with np.errstate(over="ignore"):
        a = ((three + np.uint32(0x51ED270B)) * np.uint32(0x9E3779B1)) >> shift
        b = ((four ^ (four >> np.uint32(15))) * np.uint32(0x85EBCA6B)) >> shift
    return a, b, has3.astype(np.uint8) + 2 * has4.astype(np.uint8)


@dataclass
class Model:
    """Of each bucket its contribution to each language's logit, the biases, temperature and threshold."""

    languages: list[str]
    table: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0
    reject_below: float = 0.0

    def logits(self, data: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Of the rows data[starts[i]:starts[i + 1]], each ending with white."""
        a, b, has = grams(np.concatenate([np.full(1, 10, np.uint8), data]))
        a, b, has = a[:-1], b[:-1], has[:-1]  # a gram belongs to the row of its second byte
        none = np.uint32(len(self.table) - 1)  # the last row is all zero
        a = np.where(has & 1, a, none)
        b = np.where(has & 2, b, none)
        lengths = np.diff(starts)
        total = summed(self.table[a] + self.table[b], lengths)
        count = summed((has & 1).astype(np.float32) + (has >> 1), lengths)
        return total / np.maximum(count, 1)[:, None] + self.bias

    def predict(self, data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        p = softmax(self.logits(data, starts) / self.temperature)
        best = p.argmax(axis=1)
        return best, p[np.arange(len(p)), best]


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def train(texts: list[str], langs: list[str], epochs: int = 4, rate: float = 0.6, batch: int = 64, seed: int = SEED) -> Model | None:
    """Of texts in a fixed order; the last fifth sets temperature and threshold."""
    import pyarrow as pa

    languages = sorted(set(langs))
    if not languages:
        return None
    rng = np.random.default_rng(seed)
    label = np.array([languages.index(x) for x in langs])
    data, starts = joined_bytes(pa.array(texts, pa.string()))
    a, b, has = grams(np.concatenate([np.full(1, 10, np.uint8), data]))
    # Segments of 30 to 600 bytes, so that short texts count as much as long ones.
    cuts, owner = [], []
    for i in range(len(texts)):
        at, end = int(starts[i]), int(starts[i + 1])
        for _ in range(8):
            if at >= end - 1:
                break
            step = int(30 * 20 ** rng.random())
            cuts.append((at, min(end, at + step)))
            owner.append(i)
            at += step * (1 + (end - at) // (8 * step))
    cuts, owner = np.array(cuts).reshape(-1, 2), np.array(owner, dtype=np.int64)
    size = 1 << BUCKETS_LOG2
    table = rng.normal(0, 0.1, (size, SIZE)).astype(np.float32)
    weight = rng.normal(0, 0.1, (SIZE, len(languages))).astype(np.float32)
    bias = np.zeros(len(languages), np.float32)

    def features(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        where = spans(cuts[rows, 0], cuts[rows, 1] - cuts[rows, 0])
        index = np.stack([a[where], b[where]], axis=1).ravel()
        real = np.stack([has[where] & 1, has[where] >> 1], axis=1).ravel().astype(bool)
        count = summed(real.astype(np.int64), 2 * (cuts[rows, 1] - cuts[rows, 0]))
        return index[real], count

    fit = owner < max(1, len(texts) * 4 // 5)
    rows = np.flatnonzero(fit)
    # Segments of rare languages are seen more often, up to half as many as the most frequent one has.
    per = np.bincount(label[owner[rows]], minlength=len(languages))
    rows = np.repeat(rows, np.maximum(1, per.max(initial=0) // (2 * np.maximum(1, per)))[label[owner[rows]]])
    steps, done = max(1, epochs * ((len(rows) + batch - 1) // batch)), 0
    for _ in range(epochs):
        rng.shuffle(rows)
        for k in range(0, len(rows), batch):
            own = rows[k : k + batch]
            index, count = features(own)
            mean = summed(table[index], count) / np.maximum(count, 1)[:, None]
            p = softmax(mean @ weight + bias)
            p[np.arange(len(own)), label[owner[own]]] -= 1
            lr = rate * (1 - done / steps)
            back = (p @ weight.T) / np.maximum(count, 1)[:, None]
            weight -= lr * mean.T @ p / len(own)
            bias -= lr * p.mean(axis=0)
            # A gram's own gradient is tiny in a mean over many, so embeddings get the sum over the batch.
            np.add.at(table, index, -lr * np.repeat(back, count, axis=0).astype(np.float32))
            done += 1
    scores = np.concatenate([table @ weight, np.zeros((1, len(languages)), np.float32)]).astype(np.float32)
    model = Model(languages, scores, bias)
    rest = np.flatnonzero(~fit)
    if len(rest):
        index, count = features(rest)
        logits = summed(scores[index], count) / np.maximum(count, 1)[:, None] + bias
        truth = label[owner[rest]]
        loss = {t: -np.log(softmax(logits / t)[np.arange(len(rest)), truth] + 1e-9).mean() for t in np.geomspace(0.2, 5, 33)}
        model.temperature = float(min(loss, key=loss.get))
        p = softmax(logits / model.temperature)
        order = np.argsort(-p.max(axis=1), kind="stable")
        right = np.cumsum((p.argmax(axis=1) == truth)[order]) / np.arange(1, len(rest) + 1)
        good = np.flatnonzero(right >= min(0.99, right[-1]))
        model.reject_below = float(p.max(axis=1)[order][good[-1]]) if len(good) else 0.0
    return model


def sample(docs: DataFrame, most: int | None = None) -> tuple[list[str], list[str]]:
    """At most `most` texts of each language (by default an even share of SAMPLE, EACH at least), and their languages: documents outside the held-out fold, those with the lowest hashes of doc_id.

    Only hashes below a bound of each language, which about 1.25 * most of its documents pass, are sorted,
    so that what tasks send to the driver doesn't grow with the input; where repeated doc_ids leave too
    few, the bound rises. Rows of a language that repeat a doc_id count once, with the smallest text. Of
    texts over SAMPLE_BYTES the first SAMPLE_BYTES / 4 characters are taken. Languages are spread evenly
    over the order, so that each one is in the part that is learned.
    """
    usable = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (fold(F.col("doc_id")) % 3 != 1))
    text = F.when(F.octet_length("text") <= SAMPLE_BYTES, F.col("text")).otherwise(F.substring("text", 1, SAMPLE_BYTES // 4))
    usable = usable.select("doc_id", "lang", text.alias("text"), F.xxhash64("doc_id").alias("_tm_h"))
    total = {r[0]: r[1] for r in usable.groupBy("lang").count().collect()}
    most = most or max(EACH, SAMPLE // max(1, len(total)))
    share = {x: 1.25 * most / n for x, n in total.items()}
    found = []
    while share:
        bounds = docs.sparkSession.createDataFrame([(x, 2**63 - 1 if s >= 1 else int(2**64 * s) - 2**63) for x, s in share.items()], "_tm_lang string, _tm_most long")
        below = usable.join(F.broadcast(bounds), (F.col("lang") == F.col("_tm_lang")) & (F.col("_tm_h") <= F.col("_tm_most")))
        once = below.groupBy("lang", "_tm_h", "doc_id").agg(F.min("text").alias("text"))
        place = F.row_number().over(Window.partitionBy("lang").orderBy("_tm_h", "doc_id"))
        rows = once.withColumn("_tm_k", place).where(F.col("_tm_k") <= most).select("lang", "_tm_k", "_tm_h", "text").collect()
        count = Counter(r[0] for r in rows)
        full = {x for x, s in share.items() if s >= 1 or count[x] == most}
        found += [((r[1] - 0.5) / count[r[0]], r[2], r[0], r[3]) for r in rows if r[0] in full]
        share = {x: 4 * s for x, s in share.items() if x not in full}
    found.sort()
    return [r[3] for r in found], [r[2] for r in found]


def identify(docs: DataFrame, model: Model | None = None, reject: bool = False) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score, rejected. With `reject`, rejected texts become `und`."""
    model = model or train(*sample(docs))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        model = shared.value
        for t in batched(batches):
            text = t.column("text").combine_chunks() if t.num_rows else t.column("text")
            letter = np.asarray(pc.fill_null(pc.match_substring_regex(text, r"\p{L}"), False))
            if model is None:
                letter[:] = False
                best, score = np.zeros(t.num_rows, int), np.zeros(t.num_rows)
            else:
                best, score = model.predict(*joined_bytes(text))
            low = score < (model.reject_below if model else 0)
            names = np.array([*(model.languages if model else []), "und"], dtype=object)
            named = letter & ~(low & reject)
            score = np.where(letter, np.clip(score, 0, 1), 0).astype(float)
            yield pa.RecordBatch.from_arrays([t.column("doc_id").combine_chunks(), t.column("held_out").combine_chunks(), pa.array(names[np.where(named, best, len(names) - 1)], pa.string()), pa.array(score), pa.array(low | ~letter)], ["doc_id", "held_out", "lang_pred", "score", "rejected"])

    wanted = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (fold(F.col("doc_id")) % 3 == 1).alias("held_out"), "text")
    return wanted.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double, rejected boolean")
