"""Filter audit, piecewise hashing and centroid clustering against plain Python, SQL and planted cases."""

import hashlib
import itertools
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import clustering, entry, filter_audit, piece_hashing
from tests.compare import same_rows
from tests.conftest import SF

BLANK = " \t\n\v\f\r"


def words_of(text):
    for c in BLANK:
        text = text.replace(c, " ")
    return [w for w in text.split(" ") if w]


# --- filter audit ---


def test_audit_equals_sql(spark, duck):
    same_rows(entry.op11_filter_audit(spark, SF), duck, entry.ORACLE_SQL["op11_filter_audit"])


def plain_audit(rows, labels):
    """The audit document by document and order by order."""
    least = {}
    for i, _, text in rows:
        if i is not None:
            least[text or ""] = min(i, least.get(text or "", i))
    docs = []
    for i, lang, text in rows:
        t = text or ""
        w = words_of(t)
        failed = set()
        failed |= {"A"} if len(w) < 200 else set()
        failed |= {"B"} if 100 * len(set(w)) < 50 * len(w) else set()
        failed |= {"C"} if 100 * sum("A" <= c <= "Z" for c in t) > 3 * len(t) else set()
        failed |= {"D"} if set(t) & set("#$%&*|") else set()
        failed |= {"E"} if i is not None and least[t] < i else set()
        marks = [x for x in labels if x[0] == i and i is not None]
        docs.append((lang or "", failed, any(x[1] == 1 for x in marks), any(x[2] == 1 for x in marks)))
    out = {}
    for part in {d[0] for d in docs}:
        shapley = dict.fromkeys("ABCDE", 0)
        for order in itertools.permutations("ABCDE"):
            left = [d for d in docs if d[0] == part]
            gone = []
            for step, x in enumerate(order, 1):
                removed = [d for d in left if x in d[1]]
                redundant = sum(x in d[1] for d in gone)
                left, gone = [d for d in left if x not in d[1]], gone + removed
                alone = sum(d[0] == part and d[1] == {x} for d in docs)
                out[part, "".join(order), step] = [len(left), len(removed), redundant, alone, sum(d[2] for d in removed), sum(d[3] for d in removed)]
                shapley[x] += len(removed)
        for order in itertools.permutations("ABCDE"):
            for step, x in enumerate(order, 1):
                out[part, "".join(order), step].append(shapley[x])
    return out


def audited(docs, labels):
    masks, letters = filter_audit.failure_masks(docs)
    return filter_audit.audit_orders(filter_audit.mask_cells(masks, labels), letters)


def test_audit_of_odd_rows_by_plain_python(spark):
    many = " ".join(f"w{i}" for i in range(200))
    rows = [
        (1, "en", many), (2, "en", many), (2, "en", many), (3, None, many), (None, "en", many), (None, None, None),
        (4, "", ""), (5, "de", None), (6, "de", " \t\n"), (7, "de", "A " * 300), (7, "de", "other # text"), (8, "de", f"{many}\x0bX* {many}"),
        (9, "en", "é\xa0è " * 150), (10, "en", " ".join(f"w{i}" for i in range(70_000))), (11, "en", "ABC" + "d" * 97), (12, "en", "ABCD" + "d" * 96),
    ]
    labels = [(1, 1, 0), (2, 1, 1), (2, 0, None), (3, None, 1), (None, 1, 1), (7, 1, 1), (99, 1, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    docs = docs.withColumns({c: F.lit("x") for c in ("id", "part", "mask", "_text", "digest", "own", "first", "n", "step")})
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumn("id", F.lit(1))
    want = plain_audit(rows, labels)
    got = {(r.part, r.filter_order, r.step): list(r)[3:] for r in audited(docs, known).select(
        "part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley").collect()}
    assert got == want and len(got) == 600 * 3
    assert audited(docs.limit(0), known).count() == 0
    assert audited(docs, known.limit(0)).agg(F.sum("good_lost"), F.sum("toxic_lost")).first()[:] == (0, 0)


def test_audit_keeps_the_session_as_it_was(spark):
    before = spark.conf.get("spark.sql.cteRecursionRowLimit")
    cells = spark.range(4000).select(F.col("id").cast("string").alias("part"), F.lit(1).alias("mask"), *[F.lit(1).cast("long").alias(c) for c in ("n", "good", "toxic")])
    out = filter_audit.audit_orders(cells, ["A", "B"])  # 20,000 recursive rows
    assert out.count() == 4000 * 4
    assert spark.conf.get("spark.sql.cteRecursionRowLimit") == before


# --- piecewise hashing ---


def plain_fingerprint(text):
    """Byte by byte."""
    data = text.encode()
    level = []
    for i in range(len(data)):
        h = 0
        for back in range(7):
            if i - back >= 0:
                h += data[i - back] * 0x01000193**back
        h %= 2**32
        h ^= h >> 15
        h = h * 0x2C1B3C6D % 2**32
        h ^= h >> 12
        ones = 0
        while ones < 32 and h >> ones & 1:
            ones += 1
        level.append(ones)
    k = 2
    while sum(x >= k for x in level[:-1]) > 63:
        k += 1
    signs = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/"
    out = [str(k)]
    for size in (k, k + 1):
        signature, piece = "", b""
        for i, x in enumerate(level):
            piece += data[i : i + 1]
            if x >= size or i == len(data) - 1:
                signature += signs[(zlib.crc32(piece) * 0x9E3779B1 >> 26) & 63]
                piece = b""
        out.append(signature)
    return ":".join(out)


def plain_likeness(one, two):
    if one == two:
        return 1.0
    best = 0.0
    (k, *a), (m, *b) = one.split(":"), two.split(":")
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            if int(k) + i != int(m) + j or not x or not y:
                continue
            run = min(len(x), len(y), max(2, min(4, min(len(x), len(y)) // 2)))
            if not any(x[p : p + run] == y[q : q + run] for p in range(len(x) - run + 1) for q in range(len(y) - run + 1)):
                continue
            row = list(range(len(y) + 1))  # insertions and deletions
            for p in range(len(x)):
                above, row = row, [p + 1]
                for q in range(len(y)):
                    row.append(above[q] if x[p] == y[q] else 1 + min(above[q + 1], row[q]))
            best = max(best, 1 - row[-1] / (len(x) + len(y)))
    return best


def compared_plainly(rows):
    """{(id, text): results in order} by whole-table order, as compare_with_next states it."""
    texts = [t or "" for _, t in rows]
    out = []
    for at, (i, _) in enumerate(rows):
        one, two = texts[at], texts[(at + 1) % len(texts)]
        half = len(one) // 2
        edited = one[: len(one) - half] + two[:half]
        f, e = plain_fingerprint(one), plain_fingerprint(edited)
        out.append((i, len(one), hashlib.sha256(edited.encode()).hexdigest(), f, e, plain_likeness(f, e), plain_likeness(f, plain_fingerprint(two))))
    return out


def test_piece_hashing_by_plain_python(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("length(text) < 4000")
    rows = sorted((r.doc_id, r.text) for r in docs.collect())
    got = sorted(map(tuple, piece_hashing.compare_with_next(docs.repartition(5)).collect()))
    want = sorted(compared_plainly(rows))
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert np.allclose([g[5:] for g in got], [w[5:] for w in want])
    assert np.mean([g[5] for g in got]) > 0.5 > 0.05 > np.mean([g[6] for g in got])


def test_pieces_over_blocks_and_repetitions(monkeypatch):
    rng = random.Random(3)
    texts = ["", "a", "ab" * 700, "x" * 5000, "é" * 999, "\0" * 50, "".join(map(chr, rng.choices(range(32, 900), k=3000)))]
    want = [plain_fingerprint(t) for t in texts]
    assert piece_hashing.fingerprints(texts) == want
    assert piece_hashing.fingerprints([]) == []
    monkeypatch.setattr(piece_hashing, "_BLOCK", 256)  # a text of many blocks, joined texts of several groups
    assert piece_hashing.fingerprints(texts) == want


def test_a_long_text_keeps_its_likeness():
    rng = random.Random(5)
    words = ["".join(rng.choices("abcdefghij", k=7)) for _ in range(5000)]
    text = " ".join(rng.choices(words, k=400_000))
    changed = text[:1_000_000] + "a few words more" + text[1_000_000:]
    one, two = piece_hashing.fingerprints([text, changed])
    assert piece_hashing.likeness(one, two) > 0.9
    assert piece_hashing.likeness(one, piece_hashing.fingerprints([" ".join(rng.choices(words, k=400_000))])[0]) < 0.2


def test_piece_hashing_of_odd_rows(spark):
    rows = [(None, "no id here, but some words"), (1, None), (2, ""), (3, "one two three four"), (3, "one two three four"), (4, "last of all, with more words"), (9, "x" * 30_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("x") for c in ("id", "h", "part", "side", "fingerprint")})
    got = piece_hashing.compare_with_next(docs.repartition(3)).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, compared_plainly(rows)))
    assert piece_hashing.compare_with_next(docs.limit(0)).count() == 0
    only = piece_hashing.compare_with_next(docs.where("doc_id = 4")).collect()
    assert [(r.doc_id, r.near_next) for r in only] == [(4, 1.0)]
    marks = {r.key: r.fingerprint for r in piece_hashing.fingerprint_texts(docs).collect()}
    assert marks[1] is None and marks[2] == "2::" and len(marks) == 6
    assert piece_hashing.fingerprint_texts(docs.limit(0)).count() == 0


# --- clustering ---


def test_clusters_equal_sql(spark, duck):
    same_rows(entry.op13_clustering(spark, SF), duck, entry.ORACLE_SQL["op13_clustering"])


def plain_clusters(rows, k, rounds, seed=2):
    """Lloyd's rounds in Python integers."""
    kept = [(i, tuple(int(np.floor(256 * float(x))) for x in v)) for i, v in rows]
    first = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1]))
    centroids = [v for _, v in first[:k]]
    for step in range(rounds + 1):
        best = [min((sum((x - y) ** 2 for x, y in zip(v, c)), j) for j, c in enumerate(centroids)) for _, v in kept]
        if step < rounds:
            for j in range(len(centroids)):
                own = [v for (_, v), (_, b) in zip(kept, best) if b == j]
                if own:
                    centroids[j] = tuple(sum(x) // len(own) for x in zip(*own))
    inertia = {j: sum(d for d, b in best if b == j) for j in range(len(centroids))}
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return [(i, b, d, inertia[b], sum(inertia.values()), digest[b]) for (i, _), (d, b) in zip(kept, best)]


@pytest.mark.parametrize("spread", [0.02, 0.3])
def test_clusters_by_plain_python(spark, spread):
    """Ties, equal, repeated, null and far vectors; at small spread most vectors are decided by their bounds alone."""
    rng = np.random.default_rng(7)
    centres = rng.normal(size=(6, 8))
    rows = [(i, [float(np.float32(x)) for x in centres[i % 6] + spread * rng.normal(size=8)]) for i in range(600)]
    rows += [(3, rows[3][1]), (3, rows[4][1]), (None, rows[5][1]), (None, rows[6][1]), (9000, [0.0] * 8), (9001, [-0.001] * 8)]
    odd = [(700, None), (701, [1.0] * 7), (702, [1.0] * 7 + [None]), (703, [float("nan")] + [1.0] * 7), (704, [float("-inf")] * 8), (705, [1e30] * 8), (706, [])]
    data = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>").withColumns({c: F.lit("x") for c in ("id", "v", "cluster", "distance", "own", "label")})
    report = []
    got = clustering.cluster_vectors(data.repartition(4), k=7, rounds=5, dims=8, report=report).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, plain_clusters(rows, 7, 5)))
    assert [n for n, _ in report] == [len(rows)] * 6 and report[0][1] == len(rows)
    if spread < 0.1:
        assert all(scanned < 0.5 * n for n, scanned in report[3:])
    assert clustering.cluster_vectors(data.limit(0), dims=8).count() == 0
    few = clustering.cluster_vectors(data.where("vec_id in (1, 2)"), k=7, dims=8).collect()
    assert {r.cluster for r in few} == {0, 1} and {r.inertia for r in few} == {0}
    one = clustering.cluster_vectors(data.where("vec_id between 10 and 40"), k=1, dims=8).collect()
    assert {r.cluster for r in one} == {0}


def test_large_components_stay_exact():
    table = np.array([[2**27, -(2**27)] * 32, [2**27 - 1, 5] * 32], np.int64)
    want = [[sum((int(x) - int(y)) ** 2 for x, y in zip(a, b)) for b in table] for a in table]
    assert clustering.squared_distances(table, table).tolist() == want
    assert clustering.own_distances(table, table[::-1], np.array([0, 1])).tolist() == [want[0][1], want[1][0]]


@pytest.mark.parametrize("dims", [2, 3, 24])
def test_loosening_holds_for_all_points_of_a_sphere_and_is_below_the_drift(dims):
    rng = np.random.default_rng(dims)
    below = 0
    for _ in range(60):
        before = rng.normal(size=(5, dims)) * 10
        after = before + rng.normal(size=(5, dims)) * rng.choice([0.1, 1, 8], size=(5, 1))
        radius = rng.choice([0.0, 0.5, 3.0, 9.0], size=5)
        bound = clustering.loosening(before, after, radius)
        drift = np.linalg.norm(after - before, axis=1)
        for a in range(5):
            way = rng.normal(size=(400, dims))
            way /= np.linalg.norm(way, axis=1, keepdims=True)
            points = before[a] + radius[a] * way * rng.choice([1.0, 1.0, 0.7], size=(400, 1))
            for j in set(range(5)) - {a}:
                nearer = np.linalg.norm(points - before[j], axis=1) - np.linalg.norm(points - after[j], axis=1)
                assert nearer.max() <= bound[a] * (1 + 1e-9) + 1e-9
            most = max(drift[j] for j in range(5) if j != a)
            assert bound[a] <= most + 1e-12
            below += bound[a] < 0.99 * most
    assert below > 100
