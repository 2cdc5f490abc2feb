"""Personal data: base patterns, and information-theoretic sanitisation of what reveals them.

Base spans are e-mail addresses, IP addresses, card numbers and phone numbers. Each distinct value (its
digits, or the lower-cased address) is a protected entity. Over the whole corpus, a term t discloses an
entity c if the pointwise mutual information of t and c reaches DISCLOSURE of what there is to know
about c: log p(t, c) / (p(t) p(c)) >= DISCLOSURE * -log p(c), probabilities counted in distinct texts;
that is p(c | t) >= p(c) ** (1 - DISCLOSURE). Entities and pairs are judged at every count. As few texts
prove less, p(c | t) is smoothed: of t's texts there are PRIOR more than seen, without c. A term of the
very texts that hold c always discloses it, also where the smoothing leaves less than that bound. In the
documents that hold c, such terms are spans of kind `term` beside the base ones.

`sanitise` replaces every span by its kind, the generalisation of the value, or removes it.

Terms are runs of letters of at least TERM characters, lower-cased; offsets are code points.

Defined results: null and empty texts have no span; very long texts are scanned whole, in time
proportional to their length; spans that start together (ties) come in the order of kinds; equal texts count once in all statistics (a null one
as empty), and all their copies get the same spans; matches that fail a check (parts above 255, digits
out of range, Luhn) are dropped and not tried again; an empty table gives an empty result; other columns
are ignored, or kept by sanitise, whatever their names (but those that begin with _tm_).
"""

from __future__ import annotations

import re
from hashlib import blake2b, sha256

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.llm.base import batched, placed, saved, with_numbers

PRIOR, DISCLOSURE, TERM = 1, 0.9, 3
#: Candidate terms up to which they are broadcast to the counting pass (8 bytes each).
BROADCAST_TERMS = 1 << 20
KINDS = ("email", "ip", "card", "phone", "term")

#: Fixed patterns, each written so that a text is scanned once however long its runs are.
LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
DOTTED = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++)++")
CARD = re.compile(r"[0-9]++(?:[\x20-][0-9]++)*+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]++")
DIGIT = re.compile(r"[0-9]")
WORD = re.compile(r"[^\W\d_]+")


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        if k % 2:
            n = 2 * n - 9 if n > 4 else 2 * n
        total += n
    return total % 10 == 0


def only_digits(text: str) -> str:
    return "".join(DIGIT.findall(text))


def base_spans(text: str) -> list[tuple[int, int, int, str]]:
    """(start, end, kind number, normalised value), by start, then kind."""
    found = []
    at, done = text.find("@"), 0
    while at >= 0:
        # Before the sign as much as may stand there: not what the last address took, nor an earlier sign.
        lo = at
        while lo > done and LOCAL.match(text[lo - 1]):
            lo -= 1
        m = DOMAIN.match(text, at + 1) if lo < at else None
        if m:
            found.append((lo, m.end(), 0, text[lo : m.end()].lower()))
        done = m.end() if m else at + 1
        at = text.find("@", done)
    if DIGIT.search(text):
        for m in DOTTED.finditer(text):
            # Of a chain of numbers four by four, from the left.
            own, at = m[0].split("."), m.start()
            for k in range(0, len(own) - 3, 4):
                value = ".".join(own[k : k + 4])
                if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in own[k : k + 4]):
                    found.append((at, at + len(value), 1, value))
                at += len(value) + 1
        for m in CARD.finditer(text):
            if m.end() - m.start() >= 12:
                digits = only_digits(m[0])
                if 12 <= len(digits) <= 19 and luhn(digits):
                    found.append((m.start(), m.end(), 2, digits))
        for m in PHONE.finditer(text):
            value = m[0].rstrip(" ().-")
            if len(value) > 3:
                digits = only_digits(value)
                if 9 <= len(digits) <= 15:
                    found.append((m.start(), m.start() + len(value), 3, digits))
    found.sort(key=lambda s: (s[0], s[2]))
    return found


def terms(text: str, taken: list[tuple[int, int, int, str]]) -> list[tuple[str, int, int]]:
    """(term, start, end) of the words outside the base spans."""
    out, k = [], 0
    spans = sorted((a, b) for a, b, *_ in taken)
    for m in WORD.finditer(text):
        if m.end() - m.start() < TERM:
            continue
        while k < len(spans) and spans[k][1] <= m.start():
            k += 1
        if k < len(spans) and any(a < m.end() and m.start() < b for a, b in spans[k : k + 4]):
            continue
        out.append((m[0].lower(), m.start(), m.end()))
    return out


def hashed(text: str) -> int:
    return int.from_bytes(blake2b(text.encode("utf-8", "replace"), digest_size=8).digest(), "big", signed=True)


FOUND = "doc_id long, copy long, spans array<struct<start:int,end:int,kind:int>>, entities array<long>, words array<struct<term:long,start:int,end:int>>"


def found(docs: DataFrame) -> DataFrame:
    """Base spans of every document; for those that have any, also the entities and the words."""

    def run(batches):
        import pyarrow as pa

        kinds = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.int32())]))
        word = pa.list_(pa.struct([("term", pa.int64()), ("start", pa.int32()), ("end", pa.int32())]))
        for t in batched(batches):
            copies, spans, entities, words = [], [], [], []
            for text in t.column("text").to_pylist():
                own = base_spans(text) if text else []
                spans.append([{"start": a, "end": b, "kind": k} for a, b, k, _ in own])
                copies.append(hashed(text) if own else None)
                entities.append(sorted({hashed(f"{KINDS[k]}:{v}") for _, _, k, v in own}) if own else None)
                known: dict[str, int] = {}
                row = []
                for w, a, b in terms(text, own) if own else []:
                    if w not in known:
                        known[w] = hashed(w)
                    row.append({"term": known[w], "start": a, "end": b})
                words.append(row if own else None)
            yield pa.RecordBatch.from_arrays([t.column("doc_id").combine_chunks(), pa.array(copies, pa.int64()), pa.array(spans, kinds), pa.array(entities, pa.list_(pa.int64())), pa.array(words, word)], ["doc_id", "copy", "spans", "entities", "words"])

    return saved(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, FOUND), "found")


def distinct_texts(docs: DataFrame) -> DataFrame:
    """One row of each text of placed docs (null as empty). Digests are shuffled, texts are not."""
    digest = F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256)).alias("digest")
    one = docs.groupBy(digest).agg(F.min(F.struct("_tm_file", "_tm_row")).alias("at")).select("at.*", F.lit(1).alias("n"))
    return with_numbers(docs, one, "_tm_one").where("_tm_one = 1").select(F.coalesce("text", F.lit("")).alias("text"))


def spread(docs: DataFrame, wanted: np.ndarray | None) -> DataFrame:
    """(term, texts): of terms the number of distinct texts of placed docs that hold them; of term 0 that of all texts. wanted: only these, sorted."""
    shared = docs.sparkSession.sparkContext.broadcast(wanted)

    def counts(term, texts):
        import pyarrow as pa

        return pa.RecordBatch.from_arrays([pa.array(term, pa.int64()), pa.array(texts, pa.int64())], ["term", "texts"])

    def run(batches):
        wanted = shared.value
        n, total = (0 if wanted is None else len(wanted)), 0
        held = np.zeros(n, np.int64)
        cache: dict[str, int] = {}
        for t in batched(batches):
            rest: dict[int, int] = {}
            total += t.num_rows
            for text in t.column("text").to_pylist():
                own = set()
                for w in set(WORD.findall(text)):
                    if len(w) < TERM:
                        continue
                    h = cache.get(w)
                    if h is None:
                        h = hashed(w.lower())
                        if wanted is not None:
                            k = int(np.searchsorted(wanted, h))
                            h = k if k < n and wanted[k] == h else -1
                        if len(cache) >= 300_000:
                            cache.clear()
                        cache[w] = h
                    own.add(h)
                if wanted is None:
                    for h in own:
                        rest[h] = rest.get(h, 0) + 1
                else:
                    own.discard(-1)
                    held[list(own)] += 1
            if rest:
                yield counts(list(rest), list(rest.values()))
        some = np.flatnonzero(held)
        yield counts(np.concatenate([[0], wanted[some] if len(some) else []]).astype(np.int64), np.concatenate([[total], held[some]]))

    return distinct_texts(docs).mapInArrow(run, "term long, texts long").groupBy("term").agg(F.sum("texts").alias("texts"))


def disclosures(docs: DataFrame, own: DataFrame) -> DataFrame:
    """(copy, told): of each text with entities the terms in it that disclose one of them."""
    texts = saved(own.where("entities is not null").groupBy("copy").agg(F.first("entities").alias("entities"), F.first(F.array_distinct("words.term")).alias("terms")), "texts")
    entity = texts.select("copy", F.explode("entities").alias("entity"))
    # Entities of the very same texts have the same counts with every term, and are judged as one class.
    alike = entity.groupBy("entity").agg(F.count(F.lit(1)).alias("n_entity"), F.bit_xor("copy").alias("x"), F.bit_xor(F.xxhash64("copy")).alias("y"))
    alike = alike.select("entity", F.struct(F.xxhash64("n_entity", "x", "y").alias("class"), "n_entity").alias("c"))
    held = saved(entity.join(alike, "entity").groupBy("copy").agg(F.collect_set("c").alias("classes")), "entities")
    one = texts.select("copy", "terms").join(held, "copy").select("copy", "terms", F.explode("classes").alias("c"))
    one = one.select("copy", "c.class", "c.n_entity", F.explode("terms").alias("term"))
    pairs = saved(one.groupBy("class", "n_entity", "term").agg(F.count(F.lit(1)).alias("both")), "together")
    candidates = saved(pairs.select("term").distinct(), "candidates")
    n = candidates.count()
    wanted = np.sort(candidates.toArrow().column("term").to_numpy()) if n <= BROADCAST_TERMS else None
    counted = saved(spread(docs, wanted), "spread")
    total = counted.where("term = 0").agg(F.sum("texts")).first()[0] or 0
    both, entity_n, term_n = (F.col(c).cast("double") for c in ("both", "n_entity", "texts"))
    enough = F.least(F.pow(entity_n / F.lit(float(total)), F.lit(1 - DISCLOSURE)), entity_n / (entity_n + PRIOR))
    told = saved(pairs.join(counted, "term").where(both / (F.greatest(term_n, both) + PRIOR) >= enough).select("class", "term"), "disclosures")
    return one.join(told, ["class", "term"]).groupBy("copy").agg(F.collect_set("term").alias("told"))


def marked(docs: DataFrame) -> DataFrame:
    """(doc_id, spans): all spans (start, end, kind number) by start, then kind; base spans and the terms that disclose them."""
    docs = placed(docs.select("doc_id", "text"))
    own = found(docs)
    # Of each text with entities the terms to mark; copies share them.
    mine = disclosures(docs, own).withColumnRenamed("copy", "_tm_copy")
    some = own.where("copy is not null")
    joined = some.join(mine, some["copy"] == mine["_tm_copy"], "left").select("doc_id", "spans", "words", "told")

    def run(batches):
        import pyarrow as pa

        kinds = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())]))
        for batch in batches:
            words, told, out = batch.column("words"), batch.column("told"), []
            for k, base in enumerate(batch.column("spans").to_pylist()):
                all_ = [(s["start"], s["kind"], s["end"]) for s in base]
                if told[k].is_valid:
                    w = words[k].values
                    hit = np.flatnonzero(np.isin(w.field("term").to_numpy(), told[k].values.to_numpy()))
                    all_ += zip(w.field("start").to_numpy()[hit].tolist(), [KINDS.index("term")] * len(hit), w.field("end").to_numpy()[hit].tolist(), strict=True)
                out.append([{"start": a, "kind": kind, "end": b} for a, kind, b in sorted(all_)])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, kinds)], ["doc_id", "spans"])

    # Documents without entities have no span at all.
    none = own.where("copy is null").select("doc_id", F.expr("cast(array() as array<struct<start:int,kind:int,end:int>>)").alias("spans"))
    return joined.mapInArrow(run, "doc_id long, spans array<struct<start:int,kind:int,end:int>>").unionByName(none)


def personal_data(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_term."""
    kinds = F.array(*[F.lit(k) for k in KINDS])
    line = lambda s: F.concat_ws(":", F.element_at(kinds, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))
    of = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    base = F.array_join(F.transform(F.filter("spans", lambda s: s["kind"] < 4), line), ",")
    return marked(docs).select("doc_id", of(0).alias("n_email"), of(1).alias("n_ip"), of(2).alias("n_card"), of(3).alias("n_phone"), F.sha2(base, 256).alias("base_sha256"), F.array_join(F.transform("spans", line), ",").alias("spans"), of(4).alias("n_term"))


def replaced(text: str, spans: list[tuple[int, int, int]], remove: bool = False) -> str:
    """The text with every span replaced by its kind in brackets, or removed; of overlapping spans the union is one."""
    out, at = [], 0
    for a, k, b in spans:
        if a >= at:
            out += [text[at:a], "" if remove else f"[{KINDS[k]}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def sanitise(docs: DataFrame, remove: bool = False) -> DataFrame:
    """docs with `text` sanitised; doc_id must be unique."""
    spans = marked(docs).select(F.col("doc_id").alias("_tm_id"), F.col("spans").alias("_tm_spans"))
    joined = docs.join(spans, docs["doc_id"].eqNullSafe(spans["_tm_id"]), "left").drop("_tm_id")
    names = docs.columns

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            text = [x if x is None else replaced(x, [(s["start"], s["kind"], s["end"]) for s in own or []], remove) for x, own in zip(batch.column("text").to_pylist(), batch.column("_tm_spans").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(text, pa.string()) if c == "text" else batch.column(c) for c in names], names)

    return joined.mapInArrow(run, docs.schema)


def digest(spans: list[tuple[int, int, int, str]]) -> str:
    """base_sha256 of base_spans()."""
    return sha256(",".join(f"{KINDS[k]}:{a}:{b}" for a, b, k, _ in spans).encode()).hexdigest()
