"""Operators over a whole small table against plain Python, the public libraries, or held-out labels."""

import hashlib
import re
import zlib

import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from millrace.llm import entry
from millrace.llm.packing import Packing
from millrace.llm.text_dedup import prob_minhash
from tests.compare import same_rows
from tests.conftest import SF


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


@pytest.fixture(scope="module")
def word_ids(texts):
    library = Tokenizer.from_file(entry.WORD_BPE)
    return {i: library.encode(t, add_special_tokens=False).ids for i, t in texts.items()}


def test_language_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang", "n_chars")
    rows = entry.op1_language_id(spark, "/root/testdata/sf0.01").join(docs, "doc_id").where("held_out AND n_chars > 200").collect()
    assert np.mean([r.lang == r.lang_pred for r in rows]) > 0.97
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)


def test_languages_by_plain_bundling(spark, texts):
    """Letter vectors permuted, bound and bundled one by one, and cosines, in plain Python."""
    from millrace.llm import language_id

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = docs.select("doc_id", "lang").collect()
    rng = {}

    def letter(c):
        if c not in rng:
            rng[c] = np.random.default_rng([11, ord(c)]).integers(0, 2, 1024, np.int8) * 2 - 1
        return rng[c].astype(float)

    known = {}

    def bundled(text):
        total = np.zeros(1024)
        spaced = "".join(c if c.isalpha() else " " for c in (text or "").lower())
        letters = " " + " ".join(spaced.split()) + " "
        for i in range(len(letters) - 2 if letters.strip() else 0):
            three = letters[i : i + 3]
            if three not in known:
                known[three] = np.roll(letter(three[0]), 2) * np.roll(letter(three[1]), 1) * letter(three[2])
            total += known[three]
        return total

    vectors = {i: bundled(t) for i, t in texts.items()}
    names = sorted({r.lang for r in rows if r.lang})
    learned = {n: sum(vectors[r.doc_id] for r in rows if r.lang == n and zlib.crc32(str(r.doc_id).encode()) % 3 != 1) for n in names}
    for r in language_id.identify_languages(docs, language_id.fit_languages(docs)).collect():
        v = vectors[r.doc_id]
        cosines = {n: float(v @ p / max(np.linalg.norm(v) * np.linalg.norm(p), 1e-12)) for n, p in learned.items()}
        if not v.any():
            assert r.lang_pred == "und"
            continue
        assert abs(r.score - max(0.0, max(cosines.values()))) < 1e-5
        assert cosines[r.lang_pred] > max(cosines.values()) - 1e-6


def test_token_files(spark, word_ids):
    rows = {r.doc_id: r for r in entry.op2_token_files(spark, SF).collect()}
    start = 0
    for i in sorted(word_ids):
        ids = np.array([*word_ids[i], 2], "<u4")
        assert (rows[i].start, rows[i].n_tokens, rows[i].ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


def test_token_files_of_many_ranges(spark, word_ids):
    """Bases over several files, ids that a third of the rows repeat or lack, 32-bit files, and what the manifest says."""
    from millrace.llm import token_files

    docs = spark.read.parquet(f"{SF}/documents.parquet").select(
        F.when(F.col("doc_id") % 3 == 0, 50).when(F.col("doc_id") % 3 == 1, F.col("doc_id")).alias("doc_id"), "text"
    )
    manifest = token_files.write_token_files(docs, entry.WORD_BPE, files=7)
    assert len(manifest) == 7 and all(m["kind"] == "<u2" for m in manifest)
    assert max(m["docs"] for m in manifest) < docs.count() / 3  # a repeated id is not one file's
    assert [m["base"] for m in manifest] == np.cumsum([0, *(m["ids"] for m in manifest)])[:-1].tolist()
    rows = sorted(token_files.read_token_files(spark, manifest).collect(), key=lambda r: r.start)
    keys = [-1 if r.doc_id is None else r.doc_id for r in rows]
    assert keys == sorted(keys) and [r.start for r in rows] == np.cumsum([0, *(r.n_tokens for r in rows)])[:-1].tolist()
    want = sorted(np.array([*word_ids[r.doc_id], 2], "<u4").tobytes() for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id").collect())
    assert sorted(bytes(r.ids) for r in rows) == want
    wide = token_files.read_token_files(spark, token_files.write_token_files(docs, entry.WORD_BPE, end_id=70_000, files=3))
    assert {np.frombuffer(r.ids, "<u4")[-1] for r in wide.collect()} == {70_000}


def test_toxicity_held_out(spark):
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    rows = entry.op3_toxicity(spark, "/root/testdata/sf0.1").join(labels, "doc_id").where("held_out").collect()
    hits = sum(r.predicted and r.toxic for r in rows)
    assert hits / sum(r.toxic for r in rows) > 0.8 and hits / sum(r.predicted for r in rows) > 0.8
    assert all(r.offending for r in rows if r.score > 0.9)


def plain_counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows, covered = {}, set()
    for i in range(len(words) - 7):
        windows.setdefault(tuple(words[i : i + 8]), []).append(i)
    for starts in windows.values():
        if len(starts) > 1:
            covered.update(j for i in starts for j in range(i, i + 8))
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    repeats = sum(x in lines[:i] for i, x in enumerate(lines))
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), repeats, len(covered)


def test_quality_counts(spark, texts):
    for r in entry.op4_quality(spark, SF).collect():
        n = plain_counts(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == n
        assert r.base_failed == (n[0] < 20 or 100 * n[4] > 30 * n[0]) and not (r.base_failed and r.kept)


def test_quality_verdict_follows_labels(spark):
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    rows = entry.op4_quality(spark, "/root/testdata/sf0.01").join(labels, "doc_id").where("NOT base_failed").collect()
    assert np.mean([r.kept for r in rows if r.quality == 1]) > 0.99
    assert np.mean([r.kept for r in rows if r.quality == 0]) < 0.1


def test_quality_verdict_by_plain_log_ratios(spark, texts):
    """Multinomials of hashed tokens and pairs, ratios, means and the threshold, in plain Python."""
    import xxhash

    from millrace.llm import quality

    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    model = quality.fit_quality(docs, labels)
    odd = [int(x) for x in quality._ODD]
    mask = 2**64 - 1

    def buckets(text):
        tokens = [xxhash.xxh64_intdigest(t) for w in re.split(r"[\x20\x09-\x0D]+", text) for t in re.findall(r"\w+|[^\w\s]+", w.lower())]
        pairs = [(a * odd[0] + b * odd[1]) * odd[2] & mask for a, b in zip(tokens, tokens[1:])]
        return [h >> 48 for h in [*(t * odd[3] & mask for t in tokens), *pairs]]

    found = {i: buckets(t or "") for i, t in texts.items()}
    fifths = {r.doc_id: r.fifth for r in quality.trusted_sample(labels, 20_000).selectExpr("doc_id", "pmod(xxhash64(doc_id, 5), 5) fifth").collect()}
    raw, target = np.ones(1 << 16), np.ones(1 << 16)
    for i, own in found.items():
        for b in own:
            raw[b] += 1
            target[b] += fifths.get(i, 0) > 0
    ratio = np.log(target / target.sum()) - np.log(raw / raw.sum())
    score = {i: sum(ratio[b] for b in own) / (len(own) + 20) for i, own in found.items()}
    rows = {r.doc_id: r for r in quality.score_quality(docs, model).collect()}
    assert all(abs(rows[i].score - score[i]) < 1e-9 for i in score)
    apart = sorted(score[i] for i, fifth in fifths.items() if fifth == 0 and i in rows and not rows[i].base_failed)
    assert abs(model.threshold - (np.quantile(apart, 0.002) - 0.03)) < 1e-9
    assert all(r.kept == (not r.base_failed and r.score >= model.threshold) for r in rows.values())


def test_quality_threshold_keeps_ties(spark):
    from millrace.llm import quality

    docs = spark.createDataFrame([(i, " ".join(f"w{k}" for k in range(30))) for i in range(5)], "doc_id long, text string")
    model = quality.QualityModel(np.zeros(1 << 16), 16, 20.0, threshold=0.0)
    assert all(r.kept for r in quality.score_quality(docs, model).collect())


def test_token_counts(spark, texts):
    library = Tokenizer.from_file(entry.BYTE_BPE)
    for r in entry.op5_token_counts(spark, SF).collect():
        text = texts[r.doc_id]
        assert (r.n_bytes, r.n_tokens) == (len(text.encode()), len(library.encode(text, add_special_tokens=False).ids))


def test_pieces(spark, texts):
    library = sentencepiece.SentencePieceProcessor(model_file=entry.PIECE_BPE)
    for r in entry.op6_piece_codec(spark, SF).collect():
        ids = library.encode(texts[r.doc_id])
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest()


def test_odd_strings_encode_as_the_libraries_do():
    from millrace.llm.piece_codec import ChunkTable
    from millrace.llm.token_counts import MergeCounter
    from millrace.llm.word_ids import WordIds

    parts = ["a", "B", "é", " ", "  ", "\n", "\t", "▁", "\xa0", "1", "'s", "<|endoftext|>", "!", "\x1c", "　", "😀", "́", "H̱", "\x00", "\x85", "İ", "Σ", "<s>", "the.", "it's", "&&,"]
    rng = np.random.default_rng(3)
    texts = ["".join(rng.choice(parts, rng.integers(0, 14))) for _ in range(1500)]
    byte, word = Tokenizer.from_file(entry.BYTE_BPE), Tokenizer.from_file(entry.WORD_BPE)
    counter, table, words = MergeCounter(entry.BYTE_BPE), ChunkTable(entry.PIECE_BPE), WordIds(entry.WORD_BPE)
    assert table.splits and words.by_word
    ids, decoded = table.convert(texts, True)
    coded = words.encode(texts)
    for text, i, d, w in zip(texts, ids, decoded, coded, strict=True):
        assert counter.count(text) == len(byte.encode(text, add_special_tokens=False).ids)
        assert np.frombuffer(w, "<u4").tolist() == word.encode(text, add_special_tokens=False).ids
        want = table.model.encode(text)
        assert np.frombuffer(i, "<i4").tolist() == want and d == table.model.decode(want)


def test_vectors_equal_sql(spark, duck):
    same_rows(entry.op7_embedding_dedup(spark, SF), duck, entry.ORACLE_SQL["op7_embedding_dedup"])


def test_vectors_drifting_group(spark):
    from millrace.llm.embedding_dedup import near_duplicate_vectors

    rng = np.random.default_rng(5)
    rows, x = [], rng.normal(size=32)
    for i in range(400):  # a walk whose ends are far apart, and strangers
        x = x + rng.normal(size=32) * 0.12
        rows.append((i, x.astype(float).tolist(), i % 2))
    rows += [(1000 + i, rng.normal(size=32).tolist(), i % 2) for i in range(200)]
    got = {r.vec_id: r for r in near_duplicate_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), block=64).collect()}
    ids, labels = [r[0] for r in rows], np.array([r[2] for r in rows])
    table = np.array([r[1] for r in rows])
    table /= np.linalg.norm(table, axis=1, keepdims=True)
    linked = (table @ table.T >= 0.98) & (labels[:, None] == labels[None, :])
    np.fill_diagonal(linked, False)
    assert linked.sum() > 1000
    assert [got[i].n_links for i in ids] == linked.sum(axis=1).tolist()


@pytest.mark.parametrize("codes", [16, 90, 396, 1250, 3953, 32_000])
def test_filters_of_a_vector_do_not_grow_with_the_codebooks(codes):
    from millrace.llm.embedding_dedup import CapFilters

    caps, rng = CapFilters(64, codes), np.random.default_rng(codes)
    unit = rng.normal(size=(400, 64))
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    found = caps.decode(unit)
    assert 14 <= np.mean([len(f) for f in found]) <= 26
    for r in (0, 1):  # all caps above the height, by a full table of sums
        want = []
        for t in range(caps.tables) if codes < 4000 else []:
            first, second = caps._products(unit[r : r + 1], t)
            sums = first[0][:, None] + second[0][None, :]
            height = min(caps.height, np.sort(sums, axis=None)[-caps.least]) - 1e-12
            want += [(t * codes + i) * codes + j for i, j in np.argwhere(sums >= height)]
        assert not want or found[r].tolist() == sorted(want)


@pytest.mark.parametrize("codes", [90, 396, 1250, 3953])
def test_vector_pairs_at_the_threshold_are_found(spark, codes):
    """Recall of single pairs, which no third vector helps, with as many codes as large tables have."""
    from millrace.llm.embedding_dedup import near_duplicate_vectors

    rng, rows, n = np.random.default_rng(codes), [], 200
    for i in range(n):
        a, b = rng.normal(size=(2, 64))
        a /= np.linalg.norm(a)
        b -= (b @ a) * a
        b /= np.linalg.norm(b)
        rows += [(2 * i, a.tolist(), 1), (2 * i + 1, (0.9801 * a + (1 - 0.9801**2) ** 0.5 * b).tolist(), 1)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = near_duplicate_vectors(table, codes=codes).where("n_links = 1").count() / (2 * n)
    assert got >= 0.95


def test_texts_equal_brute_force(spark, duck):
    same_rows(entry.op8_text_dedup(spark, SF), duck, entry.ORACLE_SQL["op8_text_dedup"])


def test_texts_in_one_large_drifting_group(spark):
    from millrace.llm.text_dedup import near_duplicate_texts

    rng = np.random.default_rng(7)
    base = [f"w{i}" for i in range(150)]
    rows = []
    for i in range(500):
        words = list(base)
        for at in rng.integers(0, len(words), rng.integers(0, 12)):
            words[at] = f"x{rng.integers(1000)}"
        rows.append((i, " ".join(words)))
    got = {r.doc_id: r.component_id for r in near_duplicate_texts(spark.createDataFrame(rows, "doc_id long, text string"), block=100).collect()}
    sets = [{tuple(t.split()[k : k + 5]) for k in range(146)} for _, t in rows]
    parent = list(range(len(rows)))

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for i in range(len(rows)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    assert [got[i] for i in range(len(rows))] == [find(i) for i in range(len(rows))]


def test_texts_with_repeated_passages(spark):
    from millrace.llm.text_dedup import near_duplicate_texts

    rows = []
    for i in range(60):  # pairs that differ in a passage, which both repeat
        shared = " ".join(f"c{i}x{k}" for k in range(404))
        for side in (0, 1):
            passage = " ".join(f"p{i}x{side}x{k}" for k in range(44))
            rows.append((2 * i + side, " ".join([shared, *[passage] * 50])))
    sets = []
    for _, text in rows:
        words = text.split()
        sets.append({tuple(words[k : k + 5]) for k in range(len(words) - 4)})
    want = {}
    for i, one in enumerate(sets):
        close = [j for j in range(i) if len(one & sets[j]) >= 0.8 * len(one | sets[j])]
        want[i] = want[close[0]] if close else i
    assert sum(i != c for i, c in want.items()) == 60
    got = near_duplicate_texts(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.component_id for r in got} == want


def test_signatures_estimate_probability_jaccard():
    rng = np.random.default_rng(1)
    shared, left, right = (rng.integers(0, 2**63, n).astype(np.uint64) for n in (60, 30, 20))
    a = {int(e): float(w) for e, w in zip(np.concatenate([shared, left]), rng.integers(1, 4, 90), strict=True)}
    b = {int(e): float(w) for e, w in zip(np.concatenate([shared, right]), rng.integers(1, 4, 80), strict=True)}
    exact = sum(1 / sum(max(a.get(o, 0) / a[d], b.get(o, 0) / b[d]) for o in {*a, *b}) for d in a.keys() & b.keys())
    elements = np.array([*a, *b], np.uint64)
    weights, owner = np.array([*a.values(), *b.values()]), np.repeat([0, 1], [len(a), len(b)])
    one, two = prob_minhash(elements, weights, owner, 2, 4096)
    assert abs((one == two).mean() - exact) < 0.03


PATTERNS = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def plain_spans(text):
    counts, found = [], []
    for kind, pattern in PATTERNS.items():
        n = 0
        for m in pattern.finditer(text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(p) > 255 for p in m[0].split(".")) or kind == "phone" and not 9 <= len(digits) <= 15:
                continue
            doubled = [int(c) * (1 + i % 2) for i, c in enumerate(digits[::-1])]
            if kind == "card" and (not 13 <= len(digits) <= 19 or sum(d - 9 * (d > 9) for d in doubled) % 10):
                continue
            n += 1
            found.append(f"{kind}:{m.start()}:{m.end()}")
        counts.append(n)
    return (*counts, hashlib.sha256(",".join(found).encode()).hexdigest())


def test_personal_data(spark, texts):
    from millrace.llm.pii import find_personal_data, with_digests

    for r in entry.op9_pii(spark, SF).collect():
        assert tuple(r)[1:6] == plain_spans(texts[r.doc_id])
    parts = ["a", "b.c", "@", "a@b.c", "@x.com", ".", "%", "1", "255", "256", "1.2.3.4", "4111 1111 1111 1111", " ", "-", "+1", "(", "555", "😀", "007.1.1.1", "12 34", "é"]
    rng = np.random.default_rng(9)
    odd = [(i, "".join(rng.choice(parts, rng.integers(0, 12)))) for i in range(3000)]
    odd += [(9001, "a.a." * 20_000 + "@" + "b.c" * 20_000), (9002, "1 " * 50_000), (9003, "+1" + "5" * 100_000), (9004, None)]
    got = with_digests(find_personal_data(spark.createDataFrame(odd, "doc_id long, text string"))).collect()
    want = dict(odd)
    assert all(tuple(r)[1:6] == plain_spans(want[r.doc_id]) for r in got)


def test_added_kinds_and_scores(spark):
    from millrace.llm.pii import find_personal_data

    def account(text):
        moved = "".join(str(int(c, 36)) for c in text.replace(" ", "")[4:] + text.replace(" ", "")[:4])
        return int(moved) % 97 == 1

    good, bad = "GB82 WEST 1234 5698 7654 32", "GB82 WEST 1234 5698 7654 33"
    assert account(good) and not account(bad)
    rows = {
        1: f"bank {good}.",
        2: f"bank {bad}.",
        3: "social 123-45-6789",
        4: "number 123-45-6789",
        5: "visa 4111 1111 1111 1111",
        6: "x" * 60 + " 4111111111111111",
        7: f"mail a@b.co {'y' * 50} 10.0.0.1",
        8: "social " + "z" * 41 + " 123-45-6789",
    }
    got = find_personal_data(spark.createDataFrame([*rows.items()], "doc_id long, text string")).collect()
    found = {r.doc_id: [(s.kind, r.text[s.start : s.end], s.score) for s in r.spans] for r in got}
    assert found == {
        1: [("iban", good, 0.9)],
        2: [],
        3: [("ssn", "123-45-6789", 0.7)],
        4: [],
        5: [("card", "4111 1111 1111 1111", 0.9)],
        6: [("card", "4111111111111111", 0.7)],
        7: [("email", "a@b.co", 0.9), ("ip", "10.0.0.1", 0.6)],
        8: [],
    }


def test_packing(spark, word_ids):
    rows = entry.op10_packing(spark, SF).collect()
    by, bins = {}, {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
        bins.setdefault(r.sequence_id, []).append(r)
    for i, ids in word_ids.items():
        whole = np.array([*ids, 1], "<u4")
        for n, r in enumerate(sorted(by[i], key=lambda r: r.piece)):
            part = whole[n * 4096 : (n + 1) * 4096]
            assert (r.piece, r.start, r.length, r.ids_crc32) == (n, n * 4096, len(part), zlib.crc32(part.tobytes()))
    for members in bins.values():
        place = 0
        for r in sorted(members, key=lambda r: r.offset):
            assert r.offset == place
            place += r.length
        assert place <= 4096
    assert len(bins) <= 1.01 * sum(r.length for r in rows) / 4096 + 1


def test_search_packs_what_order_leaves(word_ids):
    """The exchanges do the packing: from the order of the input to within 1 % of the least number of bins."""
    whole = [len(ids) + 1 for ids in word_ids.values()]
    lengths = [piece for n in whole for piece in [4096] * (n // 4096) + [n % 4096] if 0 < piece < 4096] * 40
    packing = Packing(lengths, 4096).in_order()
    begun, squares = len(packing.bins), sum(f * f for f in packing.fill)
    packing.local_search()
    assert len(packing.bins) <= 1.01 * packing.least and begun - len(packing.bins) > 0.05 * begun
    assert sum(f * f for f in packing.fill) > squares
    assert sorted(i for b in packing.bins for i in b) == list(range(len(lengths)))
    assert all(sum(lengths[i] for i in b) == f <= 4096 for b, f in zip(packing.bins, packing.fill, strict=True))


@pytest.mark.parametrize("low,high", [(1, 4096), (1000, 1900), (1, 300), (2049, 4097), (4096, 4097)])
def test_never_more_bins_than_best_fit(low, high):
    from millrace.llm.packing import fewest_bins

    sizes = np.random.default_rng(low).integers(low, high, 1500).tolist()
    packing, plain = fewest_bins(sizes, 4096), Packing(sizes, 4096).best_fit()
    assert packing.least <= len(packing.bins) <= len(plain.bins)
    for p in (packing, plain):
        assert sorted(i for b in p.bins for i in b) == list(range(len(sizes)))
        assert all(sum(sizes[i] for i in b) == f <= 4096 for b, f in zip(p.bins, p.fill, strict=True))


def test_search_on_mid_lengths_beats_best_fit():
    lengths = np.random.default_rng(0).integers(1000, 1901, 600).tolist()
    rooms = []
    for size in sorted(lengths, reverse=True):
        fitting = [i for i, room in enumerate(rooms) if room >= size]
        if fitting:
            rooms[min(fitting, key=rooms.__getitem__)] -= size
        else:
            rooms.append(4096 - size)
    assert len(Packing(lengths, 4096).in_order().local_search().bins) < len(rooms)


@pytest.mark.parametrize("sizes", [[], [1], [4096], [5] * 900, [4095, 4095, 1, 1], [2049, 2049, 2047, 2047]])
def test_search_on_few_and_equal_sizes(sizes):
    packing = Packing(sizes, 4096).in_order().local_search()
    assert len(packing.bins) == packing.least and sorted(i for b in packing.bins for i in b) == [*range(len(sizes))]


def test_local_search_empties_bins():
    packing = Packing([6, 5, 5, 4, 4, 3, 3], 10)
    packing.bins, packing.fill = [[0], [1, 3], [2, 4], [5, 6]], [6, 9, 9, 6]
    before = sum(f * f for f in packing.fill)
    packing.local_search()
    assert len(packing.bins) == 3 and sorted(i for b in packing.bins for i in b) == list(range(7))
    assert all(sum(packing.sizes[i] for i in b) == f <= 10 for b, f in zip(packing.bins, packing.fill, strict=True))
    assert sum(f * f for f in packing.fill) > before
