import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import types as T

from stratalog.llm import simhash
from stratalog.llm.common import connected_components

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("fp", T.StringType())])


def brute_fingerprint(text):
    words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").replace("\x0b", " ").replace("\x0c", " ").replace("\r", " ").split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(values):
    label = {v: v for v in values}

    def find(v):
        while label[v] != v:
            v = label[v]
        return v

    for a in values:
        for b in values:
            if a < b and (a ^ b).bit_count() <= 3:
                label[max(find(a), find(b))] = min(find(a), find(b))
    return {v: find(v) for v in values}


def test_documents_against_brute_force(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 4)))
    base = [[word() for _ in range(rng.choice([0, 1, 2, 5, 80, 200]))] for _ in range(60)]
    texts = [" ".join(w) for w in base]
    for w in base[:30]:
        for _ in range(4):
            near = list(w)
            if near:
                near[rng.randrange(len(near))] = word().upper()
            texts.append("\n".join(near))
    texts += ["", None, "  \t ", "A B", "a\x0bb", "x y z", "long " * 150_000]
    rows = [(i, t, "clash") for i, t in enumerate(texts)] + [(None, texts[0], None), (3, texts[3], None), (None, "nowhere else", "x")]
    got = simhash.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()
    prints = [(d, brute_fingerprint(t)) for d, t, _ in rows]
    roots = brute_components({f for _, f in prints})
    ids = {}
    for d, f in prints:
        if d is not None:
            ids[roots[f]] = min(ids.get(roots[f], d), d)
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    assert sorted(map(tuple, got), key=key) == sorted(((d, f"{f:016x}", ids.get(roots[f])) for d, f in prints), key=key)


@pytest.mark.parametrize("block", [simhash.BLOCK, 100])
def test_links_of_dense_and_sparse_fingerprints(spark, block):
    rng = random.Random(5)
    values = {rng.getrandbits(64) for _ in range(300)}
    for center in list(values)[:4]:
        for _ in range(150):
            v = center
            for _ in range(rng.randint(1, 5)):
                v ^= 1 << rng.randrange(64)
            values.add(v)
    signed = [int(np.uint64(v).astype(np.int64)) for v in values]
    edges = simhash.links(spark.createDataFrame([(v,) for v in signed], "fp long"), block)
    got = {r.node: r.component for r in connected_components(edges).collect()}
    roots = brute_components(values)
    groups = {}
    for v, s in zip(values, signed, strict=True):
        groups.setdefault(roots[v], set()).add(s)
    for members in groups.values():
        assert {got.get(m, m) for m in members} == {min(members)}
    for a, b in edges.limit(500).collect():
        assert ((a ^ b) & (2**64 - 1)).bit_count() <= 3


def test_empty(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(7, 7), (None, 3), (200, 201), (201, 200)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {got[i] for i in range(41)} == {0} and {got[i] for i in range(100, 160)} == {100} and got[201] == 200
