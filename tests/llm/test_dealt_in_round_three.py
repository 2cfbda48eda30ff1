"""SimHash components, the Merkle manifest and vector codes against brute force and odd rows."""

from __future__ import annotations

import hashlib
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from sitelens.llm import code_bounds, deletion_signatures, merkle

SMALL = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, leaf string, root string, fp int"
ODD = [
    (1, None, "en", None, 0, "x", "y", 1),
    (2, "", "en", "a", None, "x", "y", 1),
    (3, " \n\t", None, "a", 8, "x", "y", 1),
    (4, "The CAT sat on the mat", "en", "b", 9, "x", "y", 1),
    (4, "the cat  sat\non the mat", "en", "b", 9, "x", "y", 1),
    (4, "the cat  sat\non the mat", "en", "b", 9, "x", "y", 1),
    (None, "the cat sat on the mat", "fr", "b", 9, "x", "y", 1),
    (6, "É one", "fr", "c", 9, "x", "y", 1),
    (7, "word " * 200_000, "en", "c", 9, "x", "y", 1),
    (-9_007_199_254_740_993, "é one", "", "", 2**62, "x", "y", 1),
]


def brute_fingerprint(text: str | None) -> int:
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))
    grams = [" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(rows: list[tuple]) -> list[int | None]:
    """(doc_id, fingerprint) rows -> smallest reachable doc_id of each."""
    root = list(range(len(rows)))

    def find(x: int) -> int:
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if (rows[i][1] ^ rows[j][1]).bit_count() <= 2:
                root[find(i)] = find(j)
    ends = [find(i) for i in range(len(rows))]
    return [min((rows[j][0] for j in range(len(rows)) if ends[j] == e and rows[j][0] is not None), default=None) for e in ends]


def test_simhash_classes_equal_brute_force(spark):
    odd = spark.createDataFrame(ODD, DOCS)
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text")
    every = docs.unionByName(odd.select("doc_id", "text"))
    want = [(r["doc_id"], brute_fingerprint(r["text"])) for r in every.collect()]
    want = [(d, f"{f:016x}", c) for (d, f), c in zip(want, brute_components(want), strict=True)]
    assert sorted(map(repr, map(tuple, deletion_signatures.classes(every).collect()))) == sorted(map(repr, want))
    assert deletion_signatures.classes(odd.where("false")).count() == 0


@pytest.mark.parametrize("most", [4, 128])
def test_links_lose_no_pair_in_large_groups(spark, most):
    rng = np.random.default_rng(11)
    centres = [0, -1, -(2**63), *map(int, rng.integers(-(2**62), 2**62, 6))]
    found = set(map(int, rng.integers(-(2**62), 2**62, 200)))
    mask = (1 << 64) - 1
    for c in centres:  # crowded neighbourhoods: one half in common, then bits flipped anywhere
        for _ in range(60):
            x = c & mask
            for bit in rng.integers(0, 64, rng.integers(0, 4)):
                x ^= 1 << int(bit)
            found.add(x - (1 << 64) if x >> 63 else x)
        found |= {(c & ~0xFF) | k for k in range(40)}
    values = sorted(found)
    got = deletion_signatures.links(spark.createDataFrame([(v,) for v in values], "fp long"), most).collect()
    want = {(a, b) for k, a in enumerate(values) for b in values[k + 1 :] if ((a ^ b) & mask).bit_count() <= 2}
    assert {(r["a"], r["b"]) for r in got} == want and len(got) == len(want)


@pytest.fixture
def small_broadcasts(spark):
    """Broadcasting a table of 3 MB or more in memory fails, however small Spark takes it to be."""
    conf = {"spark.sql.autoBroadcastJoinThreshold": "10m", "spark.sql.maxBroadcastTableSize": "3m"}
    before = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_links_broadcast_no_exploded_entries(spark, small_broadcasts):
    values = list(map(int, np.random.default_rng(5).integers(-(2**62), 2**62, 2000)))
    values += [v ^ 5 for v in values[:100]]
    got = deletion_signatures.links(spark.createDataFrame([(v,) for v in values], "fp long")).collect()
    mask = (1 << 64) - 1
    assert {(r["a"], r["b"]) for r in got} == {(a, b) for a in values for b in values if a < b and ((a ^ b) & mask).bit_count() <= 2}


def test_links_broadcast_no_crowded_entries(spark, small_broadcasts):
    # 10 half fingerprints with 100 others each: 33 entries of each fingerprint are shared, in few distinct values.
    rng = np.random.default_rng(6)
    values = [(int(c) << 32) + int(k) ^ x for c in rng.integers(0, 2**30, 10) for k in set(rng.integers(0, 2**30, 50)) for x in (0, 5 << 30)]
    got = deletion_signatures.links(spark.createDataFrame([(v,) for v in values], "fp long")).collect()
    assert {(r["a"], r["b"]) for r in got} == {(a, b) for a in values for b in values if a < b and (a ^ b).bit_count() <= 2}


def test_simhash_broadcasts_no_equal_rows(spark, small_broadcasts):
    docs = spark.range(150_000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("one text for all").alias("text"))
    docs = docs.unionByName(spark.createDataFrame([(7, "one text for all"), (8, "another one")], "doc_id long, text string"))
    want = {(None, f"{brute_fingerprint('one text for all'):016x}", 7): 150_000, (7, f"{brute_fingerprint('one text for all'):016x}", 7): 1}
    want[8, f"{brute_fingerprint('another one'):016x}", 8] = 1
    got = deletion_signatures.classes(docs).groupBy("doc_id", "fingerprint", "component_id").count().collect()
    assert {tuple(r)[:3]: r["count"] for r in got} == want


def brute_manifest(rows: list[dict]) -> list[tuple]:
    def h(*parts: str) -> str:
        return hashlib.sha256("".join(parts).encode()).hexdigest()

    def leaf(r: dict, more: int = 0) -> str:
        n = None if r["n_chars"] is None else r["n_chars"] + more
        fields = (r["doc_id"], r["source"], r["lang"], n, r["text"])
        return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in fields))

    def tree(nodes: list[str]) -> list[list[str]]:
        levels = [nodes]
        while len(levels[-1]) > 1:
            levels.append([h(*levels[-1][k : k + 2]) for k in range(0, len(levels[-1]), 2)])
        return levels

    def path(levels: list[list[str]], at: int) -> list[tuple]:
        out = []
        for level in levels[:-1]:
            out.append((at % 2, level[at ^ 1] if at ^ 1 < len(level) else None))
            at //= 2
        return out

    langs = sorted({r["lang"] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    members = {x: sorted((r for r in rows if r["lang"] == x), key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r))) for x in langs}
    trees = {x: tree([leaf(r) for r in members[x]]) for x in langs}
    top, out = tree([trees[x][-1][0] for x in langs]), []
    for k, x in enumerate(langs):
        for at, r in enumerate(members[x]):
            steps = path(trees[x], at) + path(top, k)
            own = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 7 == 0
            now = leaf(r, int(own))
            for side, other in steps:
                now = h(now) if other is None else h(other, now) if side else h(now, other)
            proof = h(*(other for _, other in steps if other))
            out.append((r["doc_id"], leaf(r), trees[x][-1][0], top[-1][0], proof, now, now == top[-1][0]))
    return out


@pytest.mark.parametrize("climb", [1, 3, 12])
def test_manifest_equals_brute_force(spark, climb):
    odd = spark.createDataFrame(ODD, DOCS)
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    every = docs.unionByName(odd.select(*docs.columns))
    got = merkle.manifest(every.withColumn("tree", F.lit("clash")).withColumn("place", F.lit(1)), climb)
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    want = brute_manifest([r.asDict() for r in every.collect()])
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want))
    assert any(not w[-1] for w in want) and any(w[-1] for w in want)


def test_manifest_of_one_row_and_of_none(spark):
    odd = spark.createDataFrame(ODD[:1], DOCS)
    row = merkle.manifest(odd).first()
    assert row["leaf"] == row["subroot"] == row["root"] and row["proof_sha256"] == hashlib.sha256(b"").hexdigest()
    assert merkle.manifest(odd.where("false")).count() == 0


def brute_codes(rows: list[tuple], width: int, entries: int = 64) -> tuple[list[tuple], str]:
    """(vec_id, label, integers) rows in the order of the first entries -> codes and errors."""
    x = [np.array([*q, *[0] * (16 * width - len(q))], dtype=object).reshape(16, width) for _, _, q in rows]
    books = [[[int(z) for z in v[p]] for v in x[:entries]] for p in range(16)]

    def nearest(v: np.ndarray, p: int) -> tuple[int, int]:
        return min((sum((int(a) - b) ** 2 for a, b in zip(v[p], e, strict=True)), k) for k, e in enumerate(books[p]))

    for _ in range(2):
        for p in range(16):
            own: dict[int, list] = {}
            for v in x:
                own.setdefault(nearest(v, p)[1], []).append([int(z) for z in v[p]])
            books[p] = [[sum(c) // len(own[k]) for c in zip(*own[k], strict=True)] if k in own else e for k, e in enumerate(books[p])]
    coded = [[nearest(v, p) for p in range(16)] for v in x]
    errors = [sum(d for d, _ in c) for c in coded]
    by_label: dict = {}
    for (_, label, _), e in zip(rows, errors, strict=True):
        by_label[label] = by_label.get(label, 0) + e
    out = [(r[0], "".join(f"{k:02x}" for _, k in c), e, by_label[r[1]]) for r, c, e in zip(rows, coded, errors, strict=True)]
    return out, hashlib.sha256(",".join(str(z) for b in books for e in b for z in e).encode()).hexdigest()


def test_codes_equal_brute_force(spark):
    rng = np.random.default_rng(4)
    vectors = [(k, k % 3 if k % 5 else None, [float(np.float32(z)) for z in rng.normal(size=32) / 8]) for k in range(150)]
    vectors += vectors[3:6] + [(k + 1000, 1, [0.0] * 32) for k in range(20)] + [(None, 2, vectors[7][2]), (2**60 + 1, 2, [1.0] * 5), (77_777, 0, [])]
    bad = [(5000, 1, None), (5001, 1, [None] * 32), (5002, 1, [float("nan")] * 32), (5003, 1, [float("inf")] * 32)]
    df = spark.createDataFrame([(*r, "x", 7) for r in vectors + bad], "vec_id long, label int, embedding array<float>, code string, q int")
    rows = [(i, label, [int(np.floor(z * 256)) for z in v]) for i, label, v in vectors]
    rows.sort(key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    want, sha = brute_codes(rows, 2)
    got = code_bounds.encode(df.select("vec_id", "label", "embedding", "code", "q"))
    assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(repr((*w, sha)) for w in want)
    assert code_bounds.encode(df.where("false")).count() == 0
    few = df.where("vec_id < 2")
    assert {r["code"] for r in code_bounds.encode(few).collect()} == {"00" * 16, "01" * 16}


def test_bounds_save_scans_and_change_nothing():
    rng = np.random.default_rng(9)
    x = np.concatenate([rng.integers(-300, 300, (400, 64)), np.repeat(rng.integers(-4, 4, (5, 64)), 30, axis=0)])
    books = [np.ascontiguousarray(x[:64].reshape(64, 16, 4).transpose(1, 0, 2))]
    held = np.zeros((len(x), 16), np.uint8), np.full((len(x), 16, 8), -np.inf, np.float32), np.zeros((len(x), 16, 8), np.uint8)
    scans = []
    for _ in range(8):
        error, n = code_bounds.assign(x, books, *held)
        scans.append(n / held[1].size)
        codes = held[0].astype(int)
        for p in range(16):
            d = code_bounds.distances(x[:, 4 * p : 4 * p + 4], books[-1][p])
            assert (codes[:, p] == d.argmin(axis=1)).all() and (error[:, p] == d.min(axis=1)).all()
        parts = x.reshape(-1, 16, 4)
        book = books[-1].copy()
        for p, e in {(p, e) for p in range(16) for e in codes[:, p]}:
            book[p, e] = parts[codes[:, p] == e, p].sum(axis=0) // (codes[:, p] == e).sum()
        books.append(book)
    assert scans[0] == 1 and scans[-1] < 0.6
    drift = sum(code_bounds.net_displacement(books[k : k + 2], 0)[0] for k in range(8))
    assert (code_bounds.net_displacement(books, 0)[0] <= drift + 1e-9).all()


def test_base_score_equals_brute_force(spark):
    """The counted part of op9: log10 of smoothed shares, learned from four folds of five."""
    import math
    from collections import Counter

    from sitelens.llm import recurrent_lm

    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text")
    tokens = {r["doc_id"]: [*re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]+", lambda m: m[0].lower(), r["text"] or "")), None] for r in docs.collect()}
    held = {k: zlib.crc32(str(k).encode()) % 5 == 1 for k in tokens}
    counts = Counter(t for k, own in tokens.items() if not held[k] for t in own)
    n, v = sum(counts.values()), len(counts)
    rows = recurrent_lm.query(spark, SMALL).collect()
    assert {r["doc_id"]: (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) for r in rows} == {
        k: (held[k], len(own), sum(t in counts for t in own), n) for k, own in tokens.items()
    }
    for r in rows:
        want = sum(math.log10((counts[t] + 0.5) / (n + 0.5 * (v + 1))) for t in tokens[r["doc_id"]])
        assert r["base_score"] == pytest.approx(want, rel=1e-9)
