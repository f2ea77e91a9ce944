"""The operators on small tables with nulls, empty and long texts, repeated rows and clashing columns, against brute force."""

import math
import random
import zlib
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from bitlake.llm import ann, common, id_coder, lm_scoring, mixing, packing, quality_model, quality_rules, queries, simhash, suffix_dedup, token_counts
from bitlake.llm.tokens import ChunkStore, load, slices, vocabulary_path

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, start int, n int, stratum string"


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 6))) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    shared, long = words(rng, 60), words(rng, 3000)
    texts = [None, "", " \n\t ", "one", words(rng, 80), words(rng, 55) + " " + shared, shared + "\n" + words(rng, 90), long, long, long + " tail", "x y é ß <|endoftext|> don't", "a " * 120, shared]
    out = [(i, t, "en" if i % 2 else None, None if i == 4 else f"s{i % 3}", None, 7, 1, 2, "q") for i, t in enumerate(texts)]
    return [*out, out[8], (None, words(rng, 30), "en", "s1", None, 7, 1, 2, "q"), (None, None, None, None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, i % 2, 0) for i in range(12)] + [(3, None, 1), (99, 1, 0)], "doc_id long, quality int, toxic int")


def test_suffix_dedup(docs, none, rows):
    found = suffix_dedup.repeats(docs).collect()
    texts = [(r[0], (r[1] or "").encode().split()) for r in rows]
    seen = Counter(tuple(w[s : s + 50]) for _, w in texts for s in range(len(w) - 49))
    want = sorted(((i is None, i, {s + d for s in range(len(w) - 49) if seen[tuple(w[s : s + 50])] > 1 for d in range(50)}) for i, w in texts), key=str)
    got = sorted(((r.doc_id is None, r.doc_id, {p for a, e in r.repeated for p in range(a, e)}) for r in found), key=str)
    assert got == [x for x in want if x[2]]
    spread = suffix_dedup.repeats(docs, hot=1).collect()
    assert sorted(map(str, spread)) == sorted(map(str, found))
    # Removed are all repeated windows but the first of each, by doc_id, then by place; sources are the ids of those firsts.
    whole = {}
    for i, w in sorted(((i, w) for i, w in texts if i is not None and len(w) >= 50), key=lambda x: x[0]):
        whole.setdefault(tuple(w), i)
    first = {}
    for w, i in whole.items():
        for s in range(len(w) - 49):
            first.setdefault(w[s : s + 50], (i, s))
    once = Counter(w[s : s + 50] for w in whole for s in range(len(w) - 49))
    for r in (r for r in found if r.doc_id is not None):
        w = next(tuple(w) for i, w in texts if i == r.doc_id)
        at = {p for a, e in r.removed for p in range(a, e)}
        if whole[w] != r.doc_id:
            assert at == set(range(len(w))) and r.sources == [whole[w]]
        elif sum(i == r.doc_id for i, _ in texts) == 1:
            again = [s for s in range(len(w) - 49) if once[w[s : s + 50]] > 1]
            assert at == {s + d for s in again if first[w[s : s + 50]] != (r.doc_id, s) for d in range(50)}
            assert set(r.sources) == ({first[w[s : s + 50]][0] for s in again} or {r.doc_id})
    left = {r.doc_id: r.text for r in suffix_dedup.without_repeats(docs).where("doc_id is not null").collect()}
    again = Counter(tuple(w[s : s + 50]) for t in left.values() for w in [(t or "").split()] for s in range(len(w) - 49))
    assert max(again.values()) == 1 or all(k == ("a",) * 50 for k, n in again.items() if n > 1)
    assert left[9].split() == ["tail"] or left[9].split()[-1] == "tail"
    assert 8 not in left and left[0] is None and left[3] == "one"
    assert suffix_dedup.repeats(none).count() == 0 and suffix_dedup.without_repeats(none).count() == 0


def test_quality_rules(docs, none, labels, rows):
    out = quality_rules.apply_rules(docs, labels).collect()
    assert len(out) == len(rows)
    by = {r.doc_id: r for r in out if r.doc_id is not None}
    for i, t, *_ in rows:
        if i is None:
            continue
        w = (t or "").split() if i != 10 else t.replace(" ", "_").split()
        n, cover = len(w), set()
        grams = Counter(tuple(w[s : s + 8]) for s in range(n - 7))
        for s in range(n - 7):
            if grams[tuple(w[s : s + 8])] > 1:
                cover |= set(range(s, s + 8))
        assert (by[i].n_words, by[i].n_repeat_words, by[i].word_chars) == (n, len(cover), sum(map(len, w)))
        assert by[i].base_failed == (n < 20 or 100 * len(cover) > 30 * n)
    assert quality_rules.apply_rules(none, labels).count() == 0
    kept = quality_rules.kept_documents(docs, labels)
    assert kept.columns == docs.columns and kept.count() == sum(r.kept for r in out)


def test_quality_rules_certify_planted_labels(spark):
    """Bad texts shout; so does one good text in fifty. A stratum with few labels applies no rule."""
    rng, rows, labelled = random.Random(6), [], []
    for i in range(2200):
        lang, good = ("aa" if i < 1400 else "bb" if i < 2150 else "cc"), i % 5 > 0
        text = words(rng, 30)
        rows.append((i, text.upper() if not good or rng.random() < 0.02 else text, lang))
        labelled.append((i, int(good), 0))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    out = {r.doc_id: r for r in quality_rules.apply_rules(docs, spark.createDataFrame(labelled, "doc_id long, quality int, toxic int")).collect()}
    for lang, rejects in (("aa", True), ("bb", True), ("cc", False)):
        kept = {good: [out[i].kept for i, _, l in rows if l == lang and (i % 5 > 0) == good and not out[i].base_failed] for good in (True, False)}
        lost, caught = (1 - sum(k) / len(k) for k in (kept[True], kept[False]))
        assert lost < quality_rules.ALPHA and caught == (1 if rejects else 0) and (lost > 0) == rejects


def test_columns_may_have_the_names_of_helpers(spark, rows, labels):
    names = ["__k", "__q", "__size", "__taken", "__n", "__i", "__id", "__many", "__c", "__stratum", "__row", "__first", "__root", "__component", "__again", "__tkey", "__fp", "__removed"]
    docs = spark.createDataFrame([(*r[:5], *[f"{r[0]}:{n}" for n in names]) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{n} string" for n in names))
    for made in (quality_rules.kept_documents(docs, labels), simhash.one_of_each(docs), suffix_dedup.without_repeats(docs), mixing.mixed_documents(docs)):
        out = made.collect()
        assert made.columns == docs.columns and out and all(r[n] == f"{r.doc_id}:{n}" for r in out for n in names)


def test_binomial_tail(spark):
    cases = spark.createDataFrame([(200, 0), (200, 3), (1000, 20), (5000, 60)], "n long, k long")
    for r in cases.withColumn("p", quality_rules.binomial_tail(F.col("n"), F.col("k"), 0.02)).collect():
        assert math.isclose(r.p, sum(math.comb(r.n, i) * 0.02**i * 0.98 ** (r.n - i) for i in range(r.k + 1)), rel_tol=1e-9)


def test_mixing(docs, none, rows):
    out = mixing.mix(docs, rows_per_range=2).collect()
    assert len(out) == len(rows) and sum(r.taken for r in out) == pytest.approx(sum(r["size"] for r in out), abs=4)
    assert all(0 <= r.taken <= 3 * r["size"] for r in out)
    assert sorted(map(str, out)) == sorted(map(str, mixing.mix(docs).collect()))
    text = mixing.mixed_documents(docs)
    assert text.columns == docs.columns
    assert sum(len((r.text or "").replace(" ", "_").split()) for r in text.collect()) == pytest.approx(sum(r.taken for r in out), abs=4)
    assert mixing.mix(none).count() == 0 and mixing.mixed_documents(none).count() == 0


def test_mixed_documents_keep_what_each_row_was_given(spark):
    rows = [(None, f"a{i} b c d e f g", "s0") for i in range(30)] + [(None, f"z{i} b c d e f g", "s1") for i in range(5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    want, got = Counter(), Counter()
    for r in mixing.mix(df).collect():
        want[r.source_size] += r.taken
    out = mixing.mixed_documents(df).collect()
    for r in out:
        got[210 if r.source == "s0" else 35] += len(r.text.split())
    assert got == want and sum(len(r.text.split()) < 7 for r in out) <= 2


def test_ann(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(600, 12))
    x[300:360] = x[0]
    rows = [(i, [float(v) for v in x[i]], "c") for i in range(600)]
    odd = [(1000, None, ""), (1001, [0.0] * 12, ""), (1002, [float("nan")] * 12, ""), (1003, [None] + [1.0] * 11, ""), (1004, [1.0], ""), (None, [1.0] * 12, ""), rows[7]]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>, list string")
    found = ann.search(df, part=50).collect()
    hits = 0
    for q in range(0, 600, 100):
        d = np.sqrt(((x - x[q]) ** 2).sum(1))
        d[q] = np.inf
        want = np.lexsort((np.arange(600), d))[:10]
        got = sorted((r for r in found if r.query_id == q), key=lambda r: r.rank)
        assert [r.rank for r in got] == list(range(1, 11)) and all(r.score == pytest.approx(d[r.vec_id], rel=1e-12) for r in got)
        hits += len({r.vec_id for r in got} & set(want.tolist()))
    assert hits >= 54 and {r.query_id for r in found} == set(range(0, 600, 100))
    assert ann.search(df.limit(0)).count() == 0


def test_quality_model(docs, none, labels, rows):
    out = quality_model.classify(docs, labels).collect()
    assert len(out) == len(rows)
    for r in out:
        assert r.held_out == (zlib.crc32(str("" if r.doc_id is None else r.doc_id).encode()) % 4 == 2)
        assert 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7)
    assert quality_model.classify(none, labels).count() == 0
    assert {r.score for r in quality_model.classify(docs, labels.limit(0)).collect()} == {0.5}


def test_context_sums_against_plain_loops(spark):
    texts = ["Ab ab 12 x", None, "", "x y", "ab"]
    got = quality_model.context_sums(spark.createDataFrame([(t,) for t in texts], "text string"))
    place, sign = quality_model.index_vectors()
    want = np.zeros_like(got)
    shapes = {"Ab": "Aa", "ab": "a", "12": "0", "x": "a", "y": "a"}
    for t in texts:
        kinds = [(zlib.crc32(b"w" + w.lower().encode()) % quality_model.BUCKETS, zlib.crc32(b"s" + shapes[w].encode()) % quality_model.BUCKETS) for w in (t or "").split()]
        for i, me in enumerate(kinds):
            for j, other in enumerate(kinds):
                if 0 < abs(i - j) <= quality_model.REACH:
                    for a in me:
                        for b in other:
                            np.add.at(want[a], place[b], sign[b])
    assert np.allclose(got, want)


def test_quality_model_ranks_held_out_texts(spark):
    """Texts of two vocabularies; labels repeat, and one text is very long. Held-out ones must be told apart."""
    rng = random.Random(9)
    good = [words(rng, 1) for _ in range(300)]
    bad = [w[::-1].upper() + "#" for w in good]
    rows = [(i, " ".join(rng.choice(good if i % 2 else bad) for _ in range(60_000 if i == 6 else 40))) for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    given = spark.createDataFrame([(i % 600, i % 2, 0) for i in range(900)], "doc_id long, quality int, toxic int")
    held = [r for r in quality_model.classify(df, given).collect() if r.held_out]
    ones, zeros = ([r.score for r in held if r.doc_id % 2 == q] for q in (1, 0))
    assert len(held) > 100 and sum((a > b) + (a == b) / 2 for a in ones for b in zeros) / (len(ones) * len(zeros)) > 0.97
    assert len(quality_model.classify(df, given, max_rows=50).collect()) == 600


@pytest.fixture(scope="module")
def byte_bpe():
    return load(vocabulary_path("byte_bpe_50k.json"))


PARTS = ["a", "the", "ing", " ", "  ", "\n", "'", "'ll", "'re", "<|endoftext|>", "<|endof", "é", "中", "!!", "12", "\t", " ", "　", "x" * 70, "\x1c", "don't", "I'v"]


def test_prefix_counts(byte_bpe):
    rng, counter = random.Random(1), token_counts.PrefixCounter(vocabulary_path("byte_bpe_50k.json"))
    count = lambda t: len(byte_bpe.encode(t, add_special_tokens=False).ids)
    for _ in range(300):
        t = "".join(rng.choice(PARTS) for _ in range(rng.randint(0, 12)))
        assert counter.count(t) == count(t)
        assert counter.table(t) == [count(t[:j]) for j in range(len(t) + 1)]
        budget = rng.randint(0, 8)
        assert counter.fitting(t, budget) == next((j - 1 for j in range(len(t) + 1) if count(t[:j]) > budget), len(t))


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_chunk_store(name):
    rng, tokenizer, store = random.Random(2), load(vocabulary_path(name)), ChunkStore(vocabulary_path(name), limit=40)
    texts = ["".join(rng.choice([*PARTS, "É", "́", "Σ"]) for _ in range(rng.randint(0, 12))) for _ in range(200)]
    texts += [words(rng, 40) + ", and. So on\nnew line" for _ in range(20)]
    for t in texts:
        assert store.encode(store.numbers([t])[0]).tolist() == tokenizer.encode(t, add_special_tokens=False).ids


def test_workers_give_memory_back_after_their_last_batch(monkeypatch):
    said = []
    library = type("Library", (), {"malloc_trim": staticmethod(lambda pad: said.append("trim"))})
    monkeypatch.setattr(common.ctypes, "CDLL", lambda name: library)
    for batch in common.released(iter([1, 2])):
        said.append(batch)
    assert said == [1, 2, "trim"]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_chunk_store_over_batches(name):
    rng, tokenizer, store = random.Random(3), load(vocabulary_path(name)), ChunkStore(vocabulary_path(name), limit=60)
    parts = ["a", "Word", " ", "  ", "\n", "\t ", ".", ",", "..", "a.b", "e\u0301.", "\u00e9,", "\u00a0", "\u0085", "\u2003", "\u205f", "\u3000", "\u1680", "\u200b", "\u6f22", "\U0001f600", "'s", "3.14", "<|endoftext|>"]
    for n in (0, 1, 40):
        texts = [None if rng.random() < 0.1 else "".join(rng.choices(parts, k=rng.randrange(12))) for _ in range(n)]
        for kind in (pa.string(), pa.large_string()):
            batch = pa.RecordBatch.from_arrays([pa.array(["left out", *texts], kind).slice(1)], names=["text"])
            got = []
            for part in slices(batch, 0, 50):
                ids, ends = store.encoded(part.column(0), 7)
                got += [x.tolist() for x in np.split(ids, ends)[:-1]]
            assert got == [tokenizer.encode(t or "", add_special_tokens=False).ids + [7] for t in texts]


def test_chunk_store_keeps_what_is_used_and_no_more():
    store, asked = ChunkStore(vocabulary_path("byte_bpe_50k.json"), limit=40), []
    add = store._add
    store._add = lambda keys: (asked.extend(keys), add(keys))
    for i in range(30):
        store.numbers([" ".join([f"x rare{i}x{j}" for j in range(15)]) + (" late late. late," if i > 2 else "")])
        assert len(store.number) <= 40 + 20
    assert asked.count(" late") == 1 and " late." not in asked


def test_token_counts(docs, none, byte_bpe, rows):
    got = sorted(map(str, ((r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts.count_tokens(docs).collect())))
    want = [(len((t or "").encode()), len(byte_bpe.encode(t or "", add_special_tokens=False).ids)) for _, t, *_ in rows]
    assert got == sorted(str((b, n, n > 1024)) for b, n in want)
    assert token_counts.count_tokens(none).count() == 0


def test_packing(docs, none, rows):
    tokenizer = load(vocabulary_path("word_bpe_49k.json"))
    got = packing.pack_documents(docs).collect()
    want = Counter()
    for i, t, *_ in rows:
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1]
        want.update((i, p, s, len(ids[s : s + 4096]), zlib.crc32(np.array(ids[s : s + 4096], "<u4").tobytes())) for p, s in enumerate(range(0, len(ids), 4096)))
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    for s in {r.sequence_id for r in got}:
        at = 0
        for r in sorted((r for r in got if r.sequence_id == s), key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 4096
    assert packing.pack_documents(none).count() == 0
    counts = np.zeros(101, np.int64)
    np.add.at(counts, np.random.default_rng(0).integers(1, 101, 500), 1)
    used = np.zeros(101, np.int64)
    for lengths, times in packing.pack_histogram(counts, 100):
        assert sum(lengths) <= 100
        np.add.at(used, list(lengths), times)
    assert (used == counts).all()


def test_id_blocks(spark):
    rng = np.random.default_rng(0)
    some = [rng.integers(0, 1 << bits, n, np.uint32) for bits in (1, 8, 16, 17, 24, 31, 32) for n in (1, 1000, 5000)]
    some += [np.zeros(0, np.uint32), np.full(9000, 50256, np.uint32), np.tile(rng.integers(0, 50257, 300, np.uint32), 40), rng.zipf(1.3, 3_000_000).clip(0, 50256).astype(np.uint32)]
    df = spark.createDataFrame([(i, x.astype("<u4").tobytes()) for i, x in enumerate(some)], "i int, ids binary")
    for block in (1, 700, id_coder.BLOCK):
        part = df if block > 1 else df.where("i % 3 = 0")
        body = part.where("i < 24").select("i", "ids", id_coder.encoded(F.col("ids"), spark, block).alias("body")) if block < 1000 else df.select("i", "ids", id_coder.encoded(F.col("ids"), spark).alias("body"))
        for r in body.select("*", id_coder.decoded(F.col("body"), spark).alias("back")).collect():
            assert r.back == r.ids
            heads, at = 0, 0
            while at < len(r.body):
                n, crc, bits, size = np.frombuffer(r.body[at : at + 16], "<u4").tolist()
                part_ids = r.ids[4 * heads : 4 * (heads + n)]
                assert n <= block and crc == zlib.crc32(part_ids) and bits == max(1, int(np.frombuffer(part_ids, "<u4").max()).bit_length())
                # Every block can be read by itself.
                heads, at = heads + n, at + 16 + size
            assert 4 * heads == len(r.ids)
    body = bytearray(df.where("i = 20").select(id_coder.encoded(F.col("ids"), spark)).first()[0])
    body[60] ^= 1
    for broken in (bytes(body), bytes(body[:-1])):
        with pytest.raises(Exception, match="checksum|not a block"):
            spark.createDataFrame([(broken,)], "b binary").select(id_coder.decoded(F.col("b"), spark)).collect()
    assert len(spark.createDataFrame([(some[-2].astype("<u4").tobytes(),)], "b binary").select(id_coder.encoded(F.col("b"), spark)).first()[0]) < len(some[-2]) / 2


def test_id_blocks_rank_ids_of_any_size(spark):
    rng = np.random.default_rng(5)
    ids = rng.integers(1 << 16, 1 << 32, 300, np.uint32)[rng.integers(0, 300, 40_000)].astype("<u4").tobytes()
    # Some that come once, between them: more ids than ranks that are coded as such, in a block.
    many = rng.permutation(np.concatenate([np.arange(50_000, dtype=np.uint32) * 70_001, np.full(9_000, 7, np.uint32)])).astype("<u4").tobytes()
    df = spark.createDataFrame([(0, ids), (1, many), (2, ids)], "i int, ids binary").coalesce(1)
    got = df.select("i", "ids", id_coder.encoded(F.col("ids"), spark).alias("body")).select("*", id_coder.decoded(F.col("body"), spark).alias("back")).collect()
    assert all(r.back == r.ids for r in got)
    # log2(300) = 8.2 bits an id, and the 300 themselves.
    assert all(len(r.body) < 40_000 * 9.5 / 8 for r in got if r.i != 1)


def test_id_files_are_read_without_python(docs, tmp_path):
    spark, path = docs.sparkSession, str(tmp_path / "ids")
    id_coder.write_ids(docs, path, segment=500)
    plan = id_coder.read_ids(spark, path, docs.schema["doc_id"].dataType)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    segments = spark.read.parquet(path)
    segments.withColumn("documents", F.expr("slice(documents, 1, size(documents) - 1)")).where("size(documents) > 0").write.parquet(path + "-short")
    with pytest.raises(Exception, match="differ in number"):
        id_coder.read_ids(spark, path + "-short", docs.schema["doc_id"].dataType).collect()


def test_id_files(docs, none, byte_bpe, rows, tmp_path):
    got = sorted(id_coder.round_trip(docs).collect(), key=lambda r: r.start)
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    start = 0
    for r, (i, t, *_) in zip(got, order, strict=True):
        ids = [*byte_bpe.encode(t or "", add_special_tokens=False).ids, 2]
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert id_coder.round_trip(none).count() == 0
    path = str(tmp_path / "ids")
    id_coder.write_ids(docs, path, segment=500)
    for r in id_coder.read_ids(docs.sparkSession, path, docs.schema["doc_id"].dataType, ids=True).collect():
        assert len(r.ids) == 4 * r.n_tokens and zlib.crc32(r.ids) == r.ids_crc32 and (r.start, r.n_tokens, r.ids_crc32) in {(g.start, g.n_tokens, g.ids_crc32) for g in got}


def plain_fingerprint(text):
    import re

    import xxhash

    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    h = [xxhash.xxh64(" ".join(s).encode(), 42).intdigest() for s in ([w[i : i + 3] for i in range(len(w) - 2)] or ([w] if w else []))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash(docs, none, rows):
    got = simhash.components(docs).collect()
    prints = [(r[0], plain_fingerprint(r[1] or "")) for r in rows]
    group = list(range(len(prints)))
    for a in range(len(prints)):
        for b in range(a):
            if bin(prints[a][1] ^ prints[b][1]).count("1") <= 3:
                old, new = group[a], group[b]
                group = [new if g == old else g for g in group]
    least = {g: min((i for (i, _), h in zip(prints, group) if h == g and i is not None), default=None) for g in group}
    assert Counter((r.doc_id, r.fingerprint, r.component_id) for r in got) == Counter((i, f"{p:016x}", least[g]) for (i, p), g in zip(prints, group))
    assert simhash.components(none).count() == 0
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns and kept.count() == len(set(group))


def test_simhash_tree():
    rng = np.random.default_rng(0)
    x = rng.integers(0, 2**63, 1500, dtype=np.uint64)
    x = np.unique(np.concatenate([x, x[:600] ^ (np.uint64(1) << rng.integers(0, 64, 600, dtype=np.uint64)), x[0] ^ (np.uint64(1) << rng.integers(0, 64, 400, dtype=np.uint64))]))
    whole = simhash.Forest(len(x))
    whole.join(*np.nonzero(np.bitwise_count(x[:, None] ^ x[None]) <= 3))
    assert (simhash.link(x, np.ones(len(x), bool), small=64) == whole.root).all()
    leaf, at, home = simhash.route(x, simhash.plant(x[:600], 8))
    parts = simhash.Forest(len(x))
    for s in np.unique(leaf):
        mine = at[leaf == s]
        parts.join(mine, mine[simhash.link(x[mine], home[leaf == s], small=64)])
    assert home.sum() == len(x) and (parts.root == whole.root).all()


def test_contract(spark):
    chain = [(i, i + 1) for i in range(50)] + [(100, i) for i in range(101, 140)] + [(200, 201)]
    found = {r.node: r.root for r in simhash.contract(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert {found[i] for i in range(51)} == {0} and {found[i] for i in range(100, 140)} == {100} and found[201] == 200


def test_ann_search_goes_on_until_it_holds_enough(spark):
    rng = np.random.default_rng(3)
    far = rng.normal(size=8) * 100
    x = np.concatenate([far[None], rng.normal(size=(400, 8)), rng.normal(size=(400, 8)) + 30])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    found = Counter(r.query_id for r in ann.search(df, probes=1).collect())
    assert found[0] == 10 and set(found.values()) == {10}


def test_lm_scoring(docs, none, rows):
    out = lm_scoring.score(docs, max_words=3).collect()
    tokens = [(r[0], (r[1] or "").encode().lower().split()) for r in rows]
    train = [w for i, w in tokens if zlib.crc32(str("" if i is None else i).encode()) % 5 != 1]
    c = Counter(x for w in train for x in w)
    total, distinct, ends = sum(c.values()) + len(train), len(c) + 1, len(train)
    below = total + 0.5 * (distinct + 1)
    want = sorted((len(w) + 1, sum(x in c for x in w) + 1, round(sum(math.log10((c[x] + 0.5) / below) for x in w) + math.log10((ends + 0.5) / below), 6)) for _, w in tokens)
    assert sorted((r.n_tokens, r.n_known, round(r.base_score, 6)) for r in out) == want
    assert all(r.train_tokens == total and r.score < 0 for r in out)
    assert lm_scoring.score(none).count() == 0


def test_lm_scoring_holds_no_long_lists_of_rows_in_the_driver(docs, monkeypatch):
    kind, most = type(docs), []
    for name in ("collect", "toPandas"):
        monkeypatch.setattr(kind, name, lambda df, plain=getattr(kind, name): most.append(len(rows := plain(df))) or rows)
    out = lm_scoring.score(docs).toArrow()
    assert out.num_rows > 0 and max(most) < 200


def test_context_tree_is_a_distribution():
    texts = [b"abracadabra", b"abba", b"cadabra abra"]
    code, _ = lm_scoring.strings(texts, 3)
    u, n = np.unique(code, return_counts=True)
    d, s, m = [], [], []
    for level in range(4):
        t = Counter()
        for a, b in zip(u.tolist(), n.tolist()):
            t[a & ((1 << 8 * level + 8) - 1)] += b
        d += [level] * len(t)
        s += t.keys()
        m += t.values()
    tree = lm_scoring.ContextTree(np.array(d), np.array(s, np.uint64), np.array(m), 3)
    for context in (b"abr", b"zzz", b"a b"):
        codes = np.array([int.from_bytes(context + bytes([x])) for x in range(256)], np.uint64)
        assert (10 ** tree.log10(tree.shorten(codes))).sum() == pytest.approx(1)


def plain_ctw(train, text, depth):
    """Code length of a text, decision by decision, from counts of the training texts in plain dictionaries."""
    counts = {}
    for t in train:
        raw = b"\n" * depth + t + b"\n"
        for i in range(depth, len(raw)):
            for bit in range(8):
                node = 1 << bit | raw[i] >> 8 - bit
                for d in range(depth + 1):
                    counts.setdefault((raw[i - d : i], node), [0, 0])[raw[i] >> 7 - bit & 1] += 1
    kt = lambda a, b: math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)
    below = {}
    for c, node in counts:
        if c:
            below.setdefault((c[1:], node), []).append((c, node))
    weighted, longer = {}, {}
    for key in sorted(counts, key=lambda k: -len(k[0])):
        own = kt(*counts[key])
        if len(key[0]) == depth:
            weighted[key] = own
            continue
        longer[key] = sum(weighted[k] for k in below[key])
        high = max(own, longer[key])
        weighted[key] = high + math.log(math.exp(own - high) + math.exp(longer[key] - high)) - math.log(2)

    def one(raw, i, node, d):
        key = raw[i - d : i], node
        if key not in counts:
            return 0.5
        a, b = counts[key]
        mine = (b + 0.5) / (a + b + 1)
        if d == depth:
            return mine
        stop = 1 / (1 + math.exp(min(700, longer[key] - kt(a, b))))
        return stop * mine + (1 - stop) * one(raw, i, node, d + 1)

    raw, total = b"\n" * depth + text + b"\n", 0.0
    for i in range(depth, len(raw)):
        for bit in range(8):
            p = one(raw, i, 1 << bit | raw[i] >> 8 - bit, 0)
            total += math.log10(p if raw[i] >> 7 - bit & 1 else 1 - p)
    return total


def test_lm_scoring_against_plain_context_tree_weighting(spark):
    rng = random.Random(8)
    rows = [(i, None if i == 7 else words(rng, rng.randint(0, 25))) for i in range(40)]
    got = {r.doc_id: r.score for r in lm_scoring.score(spark.createDataFrame(rows, "doc_id long, text string"), max_strings=30).collect()}
    texts = {i: (t or "").encode() for i, t in rows}
    train = [t for i, t in texts.items() if zlib.crc32(str(i).encode()) % 5 != 1]
    assert all(got[i] == pytest.approx(plain_ctw(train, t, lm_scoring.DEPTH), rel=1e-6) for i, t in list(texts.items())[:12])


def test_lm_scoring_keeps_every_context(docs, rows):
    texts = [(i, b" ".join((t or "").encode().lower().split())) for i, t, *_ in rows]
    train = [t for i, t in texts if zlib.crc32(str("" if i is None else i).encode()) % 5 != 1]
    u, n = np.unique(lm_scoring.strings(train, 5)[0], return_counts=True)
    d, s, m = [], [], []
    for level in range(6):
        some, at = np.unique(u & np.uint64((1 << 8 * level + 8) - 1), return_inverse=True)
        d, s, m = d + [level] * len(some), s + some.tolist(), m + np.bincount(at, n).astype(int).tolist()
    tree = lm_scoring.ContextTree(np.array(d), np.array(s, np.uint64), np.array(m), 5)
    want = sorted(float(tree.log10(tree.shorten(lm_scoring.strings([t], 5)[0])).sum()) for _, t in texts)
    for most in (0, 20, 1 << 19):
        got = sorted(r.score for r in lm_scoring.score(docs, max_strings=most).collect())
        assert got == pytest.approx(want, rel=1e-4)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_sql(spark, name):
    con = duckdb.connect()
    sf = SF.replace("0.001", "0.01")  # so much that quality rules are certified for a stratum
    for t in ("documents", "labels", "embeddings"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    mine, want = queries.QUERIES[name](spark, sf), con.sql(queries.ORACLES[name])
    columns = sorted(mine.columns)
    rows = [dict(zip(want.columns, r, strict=True)) for r in want.fetchall()]
    assert sorted(str(tuple(r[c] for c in columns)) for r in mine.collect()) == sorted(str(tuple(r[c] for c in columns)) for r in rows)


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = corpus_pipeline.run(spark, SF).toPandas()
    assert len(out) and (out.groupby("sequence_id").length.sum() <= 4096).all()
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs.limit(0), SF).columns == docs.columns
