"""The corpus pipeline against a brute-force version of its five stages."""

import ctypes
import os
import platform
import random
import re
from collections import Counter
from pathlib import Path

import pytest

TABLE = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_pipeline_against_brute_force(spark, tmp_path):
    import duckdb
    import pyarrow as pa
    import sentencepiece

    import corpus_pipeline
    from tidemill.llm.base import joined_bytes
    from tidemill.llm.catalog import OP3_SQL
    from tidemill.llm.pieces import MODEL
    from tidemill.llm.toxicity import fitted

    rng = random.Random(9)
    clean = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(40)]
    rows, labels = [], []
    for k in range(240):
        w = rng.choices(clean, k=rng.randint(20, 60))
        if k % 4 == 0:
            w[3:3] = ["idiot", "scum", "vequair"]
        labels.append((k, int(k % 4 == 0)))
        rows.append((k, " ".join(w), ["s", "t", None][k % 3]))
    for k in range(1, 60, 2):
        rows.append((300 + k, rows[k][1].upper() if k % 3 else rows[k][1] + " end", rows[k][2]))
    rows += [(500, None, "s"), (501, "", "t"), (502, "one two", None)]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")

    net = fitted(docs, spark.read.parquet(f"{tmp_path}/labels.parquet"))
    score = net.scores(*joined_bytes(pa.array([r[1] for r in rows], pa.string())))
    left = [r for r, s in zip(rows, score, strict=True) if s < 0.5]
    assert 180 < len(left) < len(rows)
    kept = {}
    for r in sorted(left):
        kept[(r[1] or "").translate(TABLE)] = r
    left = sorted(kept.values())

    def shingles(text):
        w = WORD.findall((text or "").translate(TABLE))
        return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()

    sets, top = {r[0]: shingles(r[1]) for r in left}, {r[0]: r[0] for r in left}
    for a in sets:
        for b in sets:
            x, y = sets[a], sets[b]
            if a < b and x and y and 100 * len(x & y) >= 80 * len(x | y):
                lo, hi = sorted((top[a], top[b]))
                top = {k: lo if t == hi else t for k, t in top.items()}
    near = [r for r in left if top[r[0]] == r[0]]
    assert len(near) < len(left) < len(rows)
    db = duckdb.connect()
    documents = pa.table({"doc_id": [r[0] for r in near], "text": pa.array([r[1] for r in near], pa.string()), "source": pa.array([r[2] for r in near], pa.string())})
    db.register("documents", documents)
    copies = {i: taken // size for i, size, _, _, taken in db.execute(OP3_SQL).fetchall() if size}
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    want = Counter({(r[0], r[2], tuple(library.encode(r[1]))): copies[r[0]] for r in near if copies.get(r[0])})
    got = Counter((r.doc_id, r.source, tuple(r.ids)) for r in corpus_pipeline.run(spark, str(tmp_path)).collect() if r.n_tokens)
    assert got == want and max(want.values()) > 1


def test_pipeline_with_odd_tables(spark, tmp_path):
    import corpus_pipeline

    schema = "doc_id long, text string, source string, digest int, n long, cls string, rank double, best string, copies string"
    rest = (1, 2, "c", 0.5, "b", "x")
    rows = [(None, None, None, *rest), (None, "no id " * 9, "s", *rest), (1, "", "s", *rest), (1, "a b c d e f", "s", *rest), (1, "a b c d e f", "s", *rest), (2, "A b c d e f", None, *rest), (3, "w " * 30_000, "s", *rest)]
    labels = spark.createDataFrame([(1, 0), (None, 1), (2, None)], "doc_id long, toxic int")
    for name, some in (("odd", rows), ("empty", [])):
        spark.createDataFrame(some, schema).write.parquet(f"{tmp_path}/{name}/documents.parquet")
        labels.write.parquet(f"{tmp_path}/{name}/labels.parquet")
        got = corpus_pipeline.run(spark, f"{tmp_path}/{name}")
        assert got.columns == ["doc_id", "source", "digest", "n", "cls", "rank", "best", "copies", "ids", "n_tokens", "whole"]
        found = got.collect()
        assert len(found) <= 2 * len(some) and all(r.whole and tuple(r)[2:8] == rest for r in found)


def anonymous(pid):
    return int(re.search(r"RssAnon:\s+(\d+)", Path(f"/proc/{pid}/status").read_text())[1]) / 1024


def test_the_driver_gives_freed_memory_back(spark):
    from tidemill.llm import base, toxicity

    if platform.libc_ver()[0] != "glibc":
        pytest.skip("other C libraries keep less, and have no command for it")
    jvm, libc = spark.sparkContext._jvm, ctypes.CDLL(None)
    libc.malloc.restype, libc.malloc.argtypes, libc.free.argtypes = ctypes.c_void_p, [ctypes.c_size_t], [ctypes.c_void_p]
    pids = os.getpid(), jvm.java.lang.ProcessHandle.current().pid()
    docs = base.saved(spark.createDataFrame([(k, "a b") for k in range(9)], "doc_id long, text string"), "docs")
    labels = spark.createDataFrame([(1, 1)], "doc_id long, toxic int")

    def held_and_freed():
        """Fill memory outside the heap, in Python and the JVM, and free all but the last of it, which keeps the C library from giving it back."""
        deflaters, blocks = [jvm.java.util.zip.Deflater() for _ in range(600)], [libc.malloc(1000) for _ in range(100_000)]
        for x in blocks:
            ctypes.memset(x, 1, 1000)
        for x in deflaters[:-3]:
            x.end()
        for x in blocks[:-3]:
            libc.free(x)
        return [anonymous(pid) for pid in pids]

    for work in (lambda: base.saved(docs, "again"), lambda: toxicity.fitted(docs, labels)):
        before, _ = held_and_freed()
        work()
        assert before - anonymous(pids[0]) > 50
    _, before = held_and_freed()
    assert base.trimmed(spark) and before - anonymous(pids[1]) > 20
    # A JVM without the command.
    args = spark.sparkContext._tm_trim[2]
    args[1] = "noSuchCommand"
    try:
        assert not base.trimmed(spark)
    finally:
        args[1] = "systemTrimNativeHeap"
