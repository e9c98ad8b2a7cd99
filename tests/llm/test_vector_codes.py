"""Vector codes next to codebooks fitted by comparing everything with everything."""

import hashlib
import math
import random

import numpy as np
import pytest

from liftengine.llm import queries as Q
from liftengine.llm import vector_codes as V

DDL = "vec_id bigint, embedding array<float>, label int"


def plain(rows, parts=8, entries=16, rounds=6):
    kept = [(i, v, label) for i, v, label in rows if v is not None and all(
        x is not None and math.isfinite(x) for x in v)]
    width = -(-max((len(v) for _, v, _ in kept), default=0) // parts)

    def whole(v):
        out = [max(-V.LARGEST, min(V.LARGEST, math.floor(4096 * float(np.float32(x))))) for x in v]
        out += [0] * (parts * width - len(out))
        return [tuple(out[p * width:(p + 1) * width]) for p in range(parts)]

    vectors = [whole(v) for _, v, _ in kept]
    first = sorted(range(len(kept)), key=lambda k: (
        kept[k][0] is None, kept[k][0] or 0, [float(np.float32(x)) for x in kept[k][1]]))[:entries]
    books = [[vectors[k][p] for k in first] for p in range(parts)]

    def nearest(part, book):
        return min((sum((a - b) ** 2 for a, b in zip(part, entry)), j)
                   for j, entry in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            went = {}
            for v in vectors:
                went.setdefault(nearest(v[p], books[p])[1], []).append(v[p])
            books[p] = [tuple(sum(c) // len(went[j]) for c in zip(*went[j])) if j in went else e
                        for j, e in enumerate(books[p])]
    digest = hashlib.sha256(",".join(
        str(x) for book in books for entry in book for x in entry).encode()).hexdigest()
    found = [[nearest(v[p], books[p]) for p in range(parts)] for v in vectors]
    by_label, errors = {}, [sum(d for d, _ in f) for f in found]
    for (_, _, label), error in zip(kept, errors):
        by_label[label] = by_label.get(label, 0) + error
    return sorted(((i, "".join(f"{j:02x}" for _, j in f), error, by_label[label], digest)
                   for (i, _, label), f, error in zip(kept, found, errors)), key=str)


def run(spark, rows, tmp_path):
    path = f"{tmp_path}/in"
    spark.createDataFrame(rows, DDL).selectExpr(
        "*", "'x' as v", "1 as code", "2 as of", "3 as error").write.parquet(f"{path}/embeddings.parquet")
    out = Q.op13_vector_codes(spark, path)
    assert out.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    return sorted((tuple(r) for r in out.collect()), key=str)


def test_whole_table(spark, medium):
    rows = [tuple(r) for r in spark.read.parquet(f"{medium}/embeddings.parquet").select(
        "vec_id", "embedding", "label").collect()]
    got = sorted((tuple(r) for r in Q.op13_vector_codes(spark, medium).collect()), key=str)
    assert got == plain(rows)


def test_invented_vectors(spark, tmp_path):
    rng = random.Random(3)
    rows = [(i, [rng.choice([0.0, 0.25, -0.5, 1.0, -1e-9]) for _ in range(16)], rng.choice([None, 1, 2]))
            for i in range(200)]
    rows += [(300 + i, [0.25] * 16, 7) for i in range(50)]  # one very common vector
    rows += [(400, None, 1), (401, [float("nan")] * 16, 1), (402, [float("inf")] + [0.0] * 15, 1),
             (403, [None] + [0.0] * 15, 1), (404, [0.5] * 11, 1), (405, [], 1), (406, [1e30] * 16, 1),
             (None, [0.5] * 16, 1), (5, [0.5] * 16, 1), (5, [0.5] * 16, 1)]
    assert run(spark, rows, tmp_path) == plain(rows)


@pytest.mark.parametrize("rows", [
    [], [(1, None, None)], [(1, [], 3)], [(2, [1.0] * 20, None), (1, [2.0] * 20, None)]])
def test_small_tables(spark, tmp_path, rows):
    assert run(spark, rows, tmp_path) == plain(rows)


@pytest.mark.parametrize("entries, spread", [(1, 5), (4, 3), (16, 2), (16, 4000), (200, 50), (30, 1)])
def test_tree_finds_the_nearest_and_rules_out_the_rest(entries, spread):
    rng = np.random.default_rng(entries)
    book = rng.integers(-spread, spread + 1, (entries, 3))
    queries = np.concatenate([rng.integers(-spread, spread + 1, (500, 3)), book])
    best = np.full(len(queries), np.iinfo(np.int64).max >> 2)
    index = np.full(len(queries), entries)
    looked = V.Gnat(book).search(queries, best, index)
    away = ((queries[:, None] - book[None]) ** 2).sum(axis=2)
    assert (best == away.min(axis=1)).all() and (index == away.argmin(axis=1)).all()
    if entries == 200:
        assert looked < len(queries) * entries / 2
