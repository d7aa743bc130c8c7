"""Each operator against a brute-force version on a small table of awkward rows, and on an empty one."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from lanternfish.llm import bpe, components, fingerprints, mixing, ngram_join, quality, sharding, substring_dedup, textops, token_store, topk, toxicity
from lanternfish.llm.common import work_path

from .conftest import ROWS

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def counted(rows, *names):
    return Counter(tuple(r[n] for n in names) for r in rows)


def test_words_and_sequences():
    import pyarrow as pa

    texts = ["a  bc\td", None, "", " ", "é\x0bx", "end"]
    data, offsets = textops.bytes_of(pa.array(texts))
    starts, ends, firsts = textops.word_spans(data, offsets)
    raw = data.tobytes()
    got = [[raw[starts[i] : ends[i]].decode() for i in range(firsts[d], firsts[d + 1])] for d in range(len(texts))]
    assert got == [WORD.findall(t or "") for t in texts]
    h = textops.word_hashes(data, starts, ends)
    assert len(h) == len(starts) and len(textops.sequence_hashes(h, 99)) == 0
    x = np.array([5, 3, 8, 1, 9, 2], np.uint64)
    assert textops.sliding_least(x, 3).tolist() == [3, 1, 1, 1]
    y = np.array([1, 2, 3, 1, 2, 3, 4], np.uint64)
    assert textops.sequence_hashes(y, 3)[0] == textops.sequence_hashes(y, 3)[3] != textops.sequence_hashes(y, 3)[1]


def test_bpe_is_the_library(docs, none, tokenizer):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer)
    want = Counter()
    for i, text in ROWS:
        ids = t.encode(text or "", add_special_tokens=False).ids
        want[i, len(ids), sha(",".join(map(str, ids))), sha(t.decode(ids, skip_special_tokens=False))] += 1
    got = bpe.encode(docs, tokenizer, ("n_tokens", "ids_sha256", "decoded_sha256", "ids", "decoded"))
    assert counted(got.collect(), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == want
    back = bpe.decode(got.select("doc_id", "ids"), tokenizer)
    assert counted(back.collect(), "doc_id", "text") == Counter((i, x or "") for i, x in ROWS)
    assert bpe.encode(none, tokenizer).count() == 0


def test_fingerprints(docs, none):
    order = sorted(ROWS, key=lambda r: (r[0] is None, -(r[0] or 0), r[1] or ""))
    want = Counter()
    for k, (i, text) in enumerate(order):
        text, after = text or "", order[(k + 1) % len(order)][1] or ""
        half = len(text) // 2
        want[i, len(text), sha(text[: len(text) - half] + after[:half])] += 1
    got = fingerprints.with_edits(docs).collect()
    assert counted(got, "doc_id", "n_chars", "edited_sha256") == want
    by_text = defaultdict(set)
    plain = {(r.doc_id, r.fingerprint) for r in fingerprints.fingerprints(docs).collect()}
    for r in got:
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 and (r.doc_id, r.fingerprint) in plain
        by_text[dict(ROWS).get(r.doc_id)].add(r.fingerprint)
    assert all(len(x) == 1 for x in by_text.values())
    one = {r.doc_id: r for r in got}
    assert one[2].near_next == 1.0 and one[16].near_next < 0.2 and 0.3 < one[16].near_edited <= 1
    assert fingerprints.with_edits(none).count() == 0


def test_chunk_borders_shift_with_the_text():
    import pyarrow as pa

    body = "".join(random.Random(7).choices("abcdefgh ijklmno", k=5000))
    a, b = fingerprints.chunk_sets(*textops.bytes_of(pa.array([body, "shift " + body])))
    assert fingerprints.likeness(a, b) > 0.95 and fingerprints.likeness(fingerprints.parsed(fingerprints.shown(a)), a) == 1.0


def brute_groups(k, num, den):
    sets = []
    for _, text in ROWS:
        w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
        sets.append({tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set())
    group = list(range(len(sets)))
    for a in range(len(sets)):
        for b in range(a):
            common = len(sets[a] & sets[b])
            if common and den * common >= num * len(sets[a] | sets[b]):
                old, new = group[a], group[b]
                group = [new if g == old else g for g in group]
    out = Counter()
    for k_, (i, _) in enumerate(ROWS):
        ids = [ROWS[j][0] for j in range(len(ROWS)) if group[j] == group[k_] and ROWS[j][0] is not None]
        out[i, len(sets[k_]), min(ids) if sets[k_] and ids else i] += 1
    return out


@pytest.mark.parametrize(("k", "num", "den"), [(4, 85, 100), (5, 4, 5)])
def test_similar_groups(docs, none, k, num, den):
    assert counted(ngram_join.similar_groups(docs, k, num, den).collect(), "doc_id", "n_shingles", "component_id") == brute_groups(k, num, den)
    assert ngram_join.similar_groups(none, k, num, den).count() == 0


def test_tiles_lose_no_pair():
    """Random pairs at and around the threshold share a tile."""
    rng = np.random.default_rng(8)
    bands = ngram_join.Bands(85, 100)
    for _ in range(1500):
        n = int(rng.integers(1, 120))
        a = np.unique(rng.integers(0, 1 << 63, n, dtype=np.int64).view(np.uint64))
        drop = int(rng.integers(0, max(1, n // 5) + 1))
        b = np.unique(np.concatenate([a[rng.permutation(len(a))[drop:]], rng.integers(0, 1 << 63, int(rng.integers(0, max(1, n // 5) + 1)), dtype=np.int64).view(np.uint64)]))
        if len(b) and ngram_join.links_with(a, b, 85, 100):
            assert np.intersect1d(ngram_join.tile_keys(a, bands), ngram_join.tile_keys(b, bands)).size
            assert ngram_join.bound(ngram_join.bitmap(a), ngram_join.bitmap(b), len(a), len(b)) >= len(np.intersect1d(a, b))


def test_squares_join_what_a_pivot_misses(spark):
    """Classes alike to each other but not to the pivot are linked by the squares."""
    words = [f"w{k}" for k in range(400)]
    rows, rng = [], random.Random(9)
    for k in range(12):
        own = list(words)
        for j in rng.sample(range(400), 4 * k):
            own[j] = f"x{k}_{j}"
        rows.append((k, " ".join(own)))
    got = {r.doc_id: r.component_id for r in ngram_join.similar_groups(spark.createDataFrame(rows, "doc_id long, text string"), 4, 85, 100).collect()}
    sets = {i: {tuple(t.split()[j : j + 4]) for j in range(397)} for i, t in rows}
    group = {i: i for i in sets}
    for a in sets:
        for b in range(a):
            if 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                old, new = group[a], group[b]
                group = {i: new if g == old else g for i, g in group.items()}
    assert got == {i: min(j for j in group if group[j] == group[i]) for i in group}


def test_components_of_paths_and_stars(spark):
    links = [(k, k + 1) for k in range(60)] + [(100, k) for k in range(101, 140)] + [(7, 7), (200, 201), (201, 200)]
    got = {r.node: r.root for r in components.connected(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {k: 0 for k in range(61)} | {k: 100 for k in range(100, 140)} | {200: 200, 201: 200}


def test_substring_removal(docs, none):
    for window, gram in ((35, 12), (6, 3)):
        words = [WORD.findall(t or "") for _, t in ROWS]
        seen = Counter(tuple(w[j : j + window]) for w in words for j in range(len(w) - window + 1))
        want = Counter()
        for (i, _), w in zip(ROWS, words, strict=True):
            gone = [any(seen[tuple(w[j : j + window])] > 1 for j in range(max(0, x - window + 1), min(x, len(w) - window) + 1)) for x in range(len(w))]
            want[i, len(w), sum(gone), " ".join(x for x, g in zip(w, gone, strict=True) if not g)] += 1
        got = substring_dedup.remove_repeats(docs, window, gram).collect()
        assert counted(got, "doc_id", "n_words", "n_removed", "text") == want
        assert all(sum(s.end - s.start for s in r.spans) == r.n_removed for r in got)
    assert substring_dedup.remove_repeats(none).count() == 0
    kept = substring_dedup.remove_repeats(docs, keep=True)
    assert {"source", "size", "shard", "score"} <= set(kept.columns)
    assert {(r.doc_id, r.text) for r in kept.where("n_removed = 0").collect()} <= {(i, t) for i, t in ROWS}


def test_mixing(spark, docs, none):
    got = mixing.take(docs).collect()
    size = Counter()
    for k, (_, t) in enumerate(ROWS):
        size[None if k % 5 == 0 else f"s{k % 3}"] += len(WORD.findall(t or ""))
    assert len(got) == len(ROWS) and all(r.taken <= 2 * r.size and r.target <= 2 * r.source_size for r in got)
    assert {r.source_size for r in got} <= set(size.values())
    goals = {r.source_size: r.target for r in got}
    assert abs(sum(goals[s] for s in size.values()) - min(1.5 * sum(size.values()), 2 * sum(size.values()))) < 1e-6
    assert counted(got, "doc_id", "taken") == counted(mixing.take(docs.repartition(5)).collect(), "doc_id", "taken")
    assert mixing.mixed_documents(docs).columns == docs.columns and mixing.take(none).count() == 0 and mixing.mixed_documents(none).count() == 0
    many = spark.range(5000).selectExpr("id doc_id", "repeat('w ', 1 + cast(id * 7919 % 97 as int)) text", "concat('s', id % 4) source")
    per = mixing.take(many).join(many.select("doc_id", "source"), "doc_id").groupBy("source").agg({"taken": "sum", "target": "first"}).collect()
    assert all(abs(r["sum(taken)"] / r["first(target)"] - 1) < 0.01 for r in per)


def test_search(spark):
    rng = np.random.default_rng(10)
    rows = [(int(k), [float(v) for v in rng.normal(size=12) / 4]) for k in range(300)]
    rows += [(k + 1000, rows[k][1]) for k in range(50)] + [(7, rows[7][1]), (2000, None), (2050, [float("nan")] * 12), (2100, [None] * 12), (None, rows[1][1]), (3000, [0.0] * 12), (3050, [1.0])]
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<float>, score string")
    vectors = {}
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v):
            vectors[i] = np.floor(256 * np.array(v, np.float32).astype(float)).astype(int)
    want = Counter()
    for q in (i for i in vectors if i % 50 == 0):
        best = sorted(((-int(vectors[q][: len(w)] @ w[: len(vectors[q])]), i) for i, w in vectors.items() if i != q))[:5]
        want.update((q, k + 1, i, -s) for k, (s, i) in enumerate(best))
    for block in (16, 16384):
        assert counted(topk.search(df, rows=block).collect(), "query_id", "rank", "vec_id", "score") == want
    assert topk.search(df.limit(0)).count() == 0


def labelled(spark, label, make, n=1200):
    rng = random.Random(11)
    rows, marks = [], []
    for i in range(n):
        y = int(rng.random() < 0.4)
        rows.append((i, make(rng, y)))
        if rng.random() < 0.9:
            marks.append((i, y))
    return spark.createDataFrame(rows + [(None, None), (n, ""), (n, "")], "doc_id long, text string"), spark.createDataFrame(marks + [(None, 1), (n + 5, None)], f"doc_id long, {label} int"), dict(marks)


SYLLABLES = [a + b for a in "bdfgklmnprst" for b in "aeiou"]


def words(rng, n):
    return ["".join(rng.choices(SYLLABLES, k=rng.randint(1, 3))) for _ in range(n)]


def test_quality_on_held_out_rows(spark):
    docs, marks, truth = labelled(spark, "quality", lambda r, y: " ".join(w if y or r.random() < 0.5 else w.upper() + "!!" for w in words(r, r.randint(20, 80))))
    rows = quality.score(docs, marks).collect()
    assert len(rows) == 1203 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows if r.doc_id is not None)
    held = [r for r in rows if r.held_out and r.doc_id in truth]
    assert sum(r.predicted == truth[r.doc_id] for r in held) > 0.97 * len(held)
    assert quality.good_documents(docs, marks).columns == docs.columns
    assert quality.score(docs, marks.limit(0)).where("score = 0.5").count() == 1203 and quality.score(docs.limit(0), marks).count() == 0


def test_trees_are_walked_as_built():
    rng = np.random.default_rng(12)
    x = rng.normal(size=(500, 3))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0)).astype(float)
    m = quality.train(x, y, trees=20, depth=3)
    assert ((m.probability(x) > 0.5) == y).mean() > 0.95
    one = x[0]
    total = m.base
    for f, t, leaf in zip(m.feature, m.threshold, m.leaf, strict=True):
        node = 0
        for _ in range(m.depth):
            node = 2 * node + 1 + int(one[f[node]] > t[node])
        total += leaf[node - len(f)]
    assert np.isclose(total, m.margin(x[:1])[0])


def test_toxicity_on_held_out_rows(spark):
    bad = ["zxqvile", "wretchk", "foulqz"]

    def make(r, y):
        w = words(r, r.randint(30, 90))
        for k in range(0, len(w), 12):
            if y:
                w[k] = r.choice(bad)
        return " ".join(w)

    docs, marks, truth = labelled(spark, "toxic", make)
    rows = toxicity.score(docs, marks).collect()
    assert len(rows) == 1203 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    held = [r for r in rows if r.held_out and r.doc_id in truth]
    right = sum(r.predicted == truth[r.doc_id] for r in held)
    assert right > 0.95 * len(held)
    assert toxicity.score(docs, marks.limit(0)).where("score < 0.5").count() == 1203 and toxicity.score(docs.limit(0), marks).count() == 0


def test_linked_sets_share_a_tile_at_low_thresholds():
    rng = np.random.default_rng(5)
    for num, den in ((1, 2), (1, 3), (3, 5), (2, 3), (5, 7), (85, 100)):
        bands = ngram_join.Bands(num, den)
        for n in (1, 2, 3, 4, 7, 12, 33, 40, 150):
            large = np.sort(rng.choice(1 << 62, n * den // num, replace=False).astype(np.uint64))
            small = np.sort(rng.choice(large, n, replace=False))  # as unequal in size as linked sets can be
            assert set(ngram_join.tile_keys(small, bands).tolist()) & set(ngram_join.tile_keys(large, bands).tolist()), (num, den, n)


def test_toxic_wording_in_few_documents_of_a_small_sample():
    import pyarrow as pa

    r, bad = random.Random(4), [f"{a}x{b}qv" for a in ("zor", "wub", "kif", "jal", "pov") for b in ("an", "ek", "il", "ot")]

    def make(k, y):
        w = words(r, 40)
        if y:  # each word is in one toxic document of twenty
            w[5::12] = [bad[k % 20]] * len(w[5::12])
        return " ".join(w)

    # Shuffled, so that the third that sets the thresholds has all of the words.
    known = [(make(k, y), y) for k in range(240) for y in (0, 1)]
    r.shuffle(known)
    model = toxicity.fit([t for t, _ in known], [y for _, y in known])
    assert len(model.toxic) > len(model.ordinary)
    fresh = [(make(k, y), y) for k in range(100) for y in (0, 1)]
    said = model.scores(model.sums(*model.gains(pa.array([t for t, _ in fresh])))) >= 0.5
    truth = np.array([y for _, y in fresh], bool)
    assert (said & truth).sum() >= 95 and (said & ~truth).sum() <= 5


def test_all_words_of_the_sample_train_the_dictionaries(monkeypatch):
    """No document's words are left out, however many there are; each counts once a document."""
    seen = []
    train = toxicity.zstandard.train_dictionary
    monkeypatch.setattr(toxicity.zstandard, "train_dictionary", lambda size, samples, **how: seen.append(len(samples)) or train(size, samples, **how))
    r = random.Random(6)
    texts = [" ".join(words(r, 50) * 300) for _ in range(60)]
    toxicity.fit(texts, [k % 4 == 1 for k in range(60)])
    assert seen[0] == sum(len(set(t.split())) for k, t in enumerate(texts) if k % 4 != 1)
    assert max(seen[1:]) == sum(len(set(t.split())) for k, t in enumerate(texts) if k % 4 == 1)


def test_scores_are_those_of_plain_compression():
    """Window by window, document by document, without any vectorised step."""
    import pyarrow as pa

    r = random.Random(15)
    texts = [" ".join(words(r, 40) + ["zxqvile", "wretchk"] * (k % 2)) for k in range(80)]
    model = toxicity.fit(texts, [k % 2 for k in range(80)])
    texts = texts[:6] + ["", "Zxqvile, WRETCHK! 12 é zxqvile", "!!", "one"]
    got = model.scores(model.sums(*model.gains(pa.array(texts))))
    small, large = toxicity.compressor(model.ordinary), toxicity.compressor(model.toxic)
    for text, score in zip(texts, got, strict=True):
        own = re.findall(rb"[a-z\x80-\xff]+", "".join(c.lower() if c.isascii() else c for c in text).encode())
        total = 0.0
        cut = [own[k : k + toxicity.WORDS] for k in range(0, len(own), toxicity.WORDS)]
        for window in cut:
            twice = b"".join(bytes([b, b]) for b in b" " + b" ".join(window) + b" ") + model.ordinary[-toxicity.PRIMER :]
            total += model.weights[min(max(len(small(twice)) - len(large(twice)), 0), toxicity.MOST)]
        s = np.log1p(total)
        assert np.isclose(score, 1 / (1 + np.exp(-np.clip(model.curve @ [1, s, np.log1p(len(cut)), s * s], -30, 30))))


def test_token_store(spark, docs, none, tokenizer):
    from tokenizers import Tokenizer

    t, want, start = Tokenizer.from_file(tokenizer), Counter(), 0
    for i, text in sorted(ROWS, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = t.encode(text or "", add_special_tokens=False).ids + [2]
        want[i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())] += 1
        start += len(ids)
    path = work_path(spark, "store-test")
    token_store.write_store(docs, path, tokenizer)
    got = token_store.checksums(token_store.read_store(spark, path, token_store.numbered(docs)))
    assert counted(got.collect(), "doc_id", "start", "n_tokens", "ids_crc32") == want
    unknown = spark.createDataFrame([(k, 0) for k in range(10**6, 10**6 + 500)] + [(11, 2)], "doc_id long, number long")
    assert token_store.read_store(spark, path, unknown).count() == 0
    empty = work_path(spark, "store-test")
    token_store.write_store(none, empty, tokenizer)
    assert token_store.read_store(spark, empty, unknown).count() == 0


def test_perfect_hash():
    h = np.unique(np.random.default_rng(13).integers(0, 1 << 63, 5000, dtype=np.int64)).view(np.uint64)
    places = token_store.Places.of(h)
    assert places.n == len(h) and sorted(places.find(h).tolist()) == list(range(len(h)))
    assert token_store.Places.of(h[:0]).find(h[:3]).tolist() == [-1, -1, -1]


def test_sharding(spark, docs, none, tmp_path):
    rows = sharding.assign(docs).collect()
    want = Counter((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in ROWS)
    assert counted(rows, "doc_id", "size", "text_crc32") == want
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
        assert r.law == "rows" and r.grown_shard is None and 0 <= r.shard < 24
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    counts = [len(slots[k]) for k in range(24)]
    assert max(counts) - min(counts) <= 1
    assert counted(sharding.assign(docs.repartition(2)).collect(), "doc_id", "shard", "slot") == counted(rows, "doc_id", "shard", "slot")
    many = spark.range(500).selectExpr("id % 3 doc_id", "'same' text")
    got = sharding.assign(many, bucket_rows=50).groupBy("shard").count().collect()
    assert sorted(r["count"] for r in got) == sorted(500 // 24 + (k < 500 % 24) for k in range(24))
    assert sharding.assign(none).count() == 0
    sharding.write_shards(docs, f"file://{tmp_path}/out", 4)
    back = spark.read.parquet(f"file://{tmp_path}/out")
    assert back.count() == len(ROWS) and counted(back.collect(), "doc_id", "text") == Counter(ROWS)


def test_pipeline_stages_chain(spark, sf, tmp_path):
    import corpus_pipeline as C

    docs = first = spark.read.parquet(f"{sf}/documents.parquet")
    counts = []
    for name, stage in C.STAGES:
        stage(spark, docs, sf).write.parquet(f"file://{tmp_path}/{name}")
        docs = spark.read.parquet(f"file://{tmp_path}/{name}")
        counts.append(docs.count())
        if name != C.STAGES[-1][0]:
            assert docs.columns == first.columns
    assert counts[0] < first.count() and counts[1] < counts[0] and counts[2] == counts[1] and counts[4] == counts[3]
    kept = {r.doc_id for r in spark.read.parquet(f"file://{tmp_path}/near_copies").collect()}
    good = spark.read.parquet(f"file://{tmp_path}/quality")
    groups = ngram_join.similar_groups(good, 5, 4, 5).collect()
    assert kept == {r.component_id for r in groups}
    for name, stage in C.STAGES:
        assert stage(spark, first.limit(0), sf).count() == 0, name


def test_nulls_in_any_column_go_through_all_stages(spark, sf):
    import corpus_pipeline as C

    docs = spark.createDataFrame([(i, t, None, None if k % 2 else "s", None) for k, (i, t) in enumerate(ROWS)], "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in C.STAGES:
        assert stage(spark, docs, sf).count() >= 0, name


def test_search_and_mixing_agree_with_their_sql(spark, sf):
    import duckdb

    from lanternfish.llm.queries import ORACLE, QUERIES

    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    for name, sql in ORACLE.items():
        got, want = QUERIES[name](spark, sf).toPandas(), con.sql(sql).df()
        columns = sorted(got.columns)
        assert columns == sorted(want.columns)
        assert sorted(map(tuple, got[columns].round(6).values.tolist())) == sorted(map(tuple, want[columns].round(6).values.tolist()))


def test_factors_cover_each_repeated_phrase():
    """Random texts of few words, stretches with copies: the factors cover what a count of phrases covers, and are equal to another place."""
    rng = np.random.default_rng(16)
    for _ in range(300):
        window = int(rng.integers(1, 6))
        sizes = rng.integers(window, 30, int(rng.integers(1, 8)))
        h = rng.integers(0, int(rng.integers(1, 5)) + 1, sizes.sum()).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        firsts = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        copied = rng.random(len(sizes)) < 0.1
        seqs = [tuple(h[a:b].tolist()) for a, b in zip(firsts[:-1], firsts[1:], strict=True)]
        seen = Counter(s[j : j + window] for s, c in zip(seqs, copied, strict=True) for j in range(len(s) - window + 1) for _ in range(1 + c))
        got = [np.zeros(len(s), bool) for s in seqs]
        for d, at, n in zip(*(x.tolist() for x in substring_dedup.factors(h, firsts, copied, window)), strict=True):
            assert n >= window and at + n <= len(seqs[d])
            assert copied[d] or sum(s[j : j + n] == seqs[d][at : at + n] for s in seqs for j in range(len(s))) > 1
            got[d][at : at + n] = True
        for s, g in zip(seqs, got, strict=True):
            assert g.tolist() == [any(seen[s[j : j + window]] > 1 for j in range(max(0, x - window + 1), min(x, len(s) - window) + 1)) for x in range(len(s))]


def test_substring_removal_of_a_whole_table(spark, sf):
    """All documents of the smallest tables and a text longer than a block, against a count of all windows."""
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    rows.append((10**6, " ".join(f"w{k % 90_000}" for k in range(400_000))))
    words = [WORD.findall(t or "") for _, t in rows]
    seen = Counter(hash(tuple(w[j : j + 35])) for w in words for j in range(len(w) - 34))
    want = {}
    for (i, _), w in zip(rows, words, strict=True):
        edge = [0] * (len(w) + 36)
        for j in range(len(w) - 34):
            if seen[hash(tuple(w[j : j + 35]))] > 1:
                edge[j] += 1
                edge[j + 35] -= 1
        depth, kept = 0, []
        for x, e in zip(w, edge, strict=False):
            depth += e
            if not depth:
                kept.append(x)
        want[i] = (len(w), len(w) - len(kept), sha(" ".join(kept)))
    got = substring_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(7)).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, sha(r.text)) for r in got} == want


def test_one_row_of_each_group_of_near_copies_stays(spark):
    import corpus_pipeline as C

    body = [f"w{k}" for k in range(60)]
    near = " ".join(body[:59] + ["other"])
    rows = [(5, " ".join(body), "a"), (5, " ".join(body), "b"), (5, near, "c"), (None, " ".join(body), "d"), (7, near, "e"), (None, "alone in the world it stands here", "f"), (None, "alone in the world it stands here", "g"), (8, "", "h"), (8, "", "i"), (9, None, "j"), (10, "no copy of anything else at all", "k")]
    kept = C.drop_near_copies(spark, spark.createDataFrame(rows, "doc_id long, text string, source string"), "").collect()
    groups = Counter("one" if (r.text or "").startswith("w0") else "alone" if (r.text or "").startswith("alone") else r.source for r in kept)
    assert groups == {"one": 1, "alone": 1, "h": 1, "i": 1, "j": 1, "k": 1}
    assert {r.doc_id for r in kept if (r.text or "").startswith("w0")} == {5}


def brute_pipeline(docs, good):
    """Stages 2 and 3 by sets and counts of all windows: rows (doc_id, text, n_chars, removed) in order of doc_id."""
    sets = [{tuple(w[j : j + 5]) for j in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set() for w in (WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")) for _, t, _ in good)]
    group = list(range(len(good)))
    where = defaultdict(set)
    for a, s in enumerate(sets):
        for b in {b for x in s for b in where[x]}:
            if group[a] != group[b] and 5 * len(s & sets[b]) >= 4 * len(s | sets[b]):
                old, new = group[a], group[b]
                group = [new if g == old else g for g in group]
        for x in s:
            where[x].add(a)
    least = {}
    for g, row in zip(group, good, strict=True):
        least[g] = min(least.get(g, row), row)
    left = sorted(least.values())
    words = [WORD.findall(t or "") for _, t, _ in left]
    seen = Counter(hash(tuple(w[j : j + 35])) for w in words for j in range(len(w) - 34))
    out = []
    for (i, t, n), w in zip(left, words, strict=True):
        gone = [False] * len(w)
        for j in range(len(w) - 34):
            if seen[hash(tuple(w[j : j + 35]))] > 1:
                gone[j : j + 35] = [True] * 35
        text = " ".join(x for x, g in zip(w, gone, strict=True) if not g) if any(gone) else t
        out.append((i, text, len(text) if any(gone) else n))
    return out


def test_pipeline_rows_are_those_of_plain_versions(spark, sf, tokenizer):
    """Stage by stage on the smallest tables: what quality keeps, then copies and passages by brute force, the mix by its operator's law, ids by the library."""
    from tokenizers import Tokenizer

    import corpus_pipeline as C
    from lanternfish.llm.common import stored

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    good = stored(C.keep_good(spark, docs, sf), "t")
    scores = {r.doc_id for r in quality.score(docs, spark.read.parquet(f"{sf}/labels.parquet")).where("predicted = 1").collect()}
    rows = [(r.doc_id, r.text, r.n_chars) for r in good.collect()]
    assert {i for i, _, _ in rows} == scores
    cut = stored(C.cut_repeats(spark, stored(C.drop_near_copies(spark, good, sf), "t"), sf), "t")
    assert sorted((r.doc_id, r.text, r.n_chars) for r in cut.collect()) == brute_pipeline(docs, rows)
    mixed = stored(C.mix_sources(spark, cut, sf), "t")
    taken = {r.doc_id: r.taken // r.size if r.size else None for r in mixing.take(cut).collect()}
    copies = Counter(r.doc_id for r in mixed.collect())
    assert all(copies[i] == n for i, n in taken.items() if n is not None)
    t, texts = Tokenizer.from_file(tokenizer), {r.doc_id: r.text or "" for r in cut.collect()}
    for r in C.tokenize(spark, mixed, sf).collect():
        assert list(r.ids) == t.encode(texts[r.doc_id], add_special_tokens=False).ids and r.n_tokens == len(r.ids)


def test_steps_are_bounded_by_bytes_and_rows():
    import pyarrow as pa

    from lanternfish.llm.common import steps

    batches = [pa.RecordBatch.from_pydict({"text": ["x"] * n}) for n in (10, 0, 7000, 3, 9000)] + [pa.RecordBatch.from_pydict({"text": ["y" * 5000] * 40})]
    made = list(steps(batches, 1 << 16, 4096))
    assert all(t.num_rows <= 4096 and t.nbytes < 3 << 16 for t in made)
    assert sum((t["text"].to_pylist() for t in made), []) == ["x"] * 16_013 + ["y" * 5000] * 40


def test_search_counts_large_components_and_repeated_rows(spark):
    rng = np.random.default_rng(17)
    rows = [(int(k), [float(v) for v in rng.normal(size=4)]) for k in range(120)]
    rows += [(3, rows[3][1]), (3, rows[4][1]), (50, rows[50][1]), (200, [3e6, 1.0, -2e6, 0.5]), (250, [-3e6, 2.0, 1e6, 1e6]), (301, [1e6, 1e6, 0.0, -1e6]), (302, [float("inf"), 0.0, 0.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    kept = [(i, [int(np.floor(256 * x)) for x in v]) for i, v in rows if np.isfinite(v).all()]
    want = Counter()
    for i, q in kept:
        if i % 50 == 0:
            best = sorted((-sum(a * b for a, b in zip(q, w, strict=True)), j) for j, w in kept if j != i)[:5]
            want.update((i, k + 1, j, -s) for k, (s, j) in enumerate(best))
    for block in (16, 16384):
        assert counted(topk.search(df, rows=block).collect(), "query_id", "rank", "vec_id", "score") == want
    huge = spark.createDataFrame([(0, [1e30]), (1, [1.0])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="too large"):
        topk.search(huge).collect()


def test_a_file_of_an_earlier_attempt_is_replaced(tmp_path):
    for attempt, data in ((1, b"first"), (2, b"again")):
        token_store.put(f"file://{tmp_path}/index/block-000000.mph", data, attempt)
    assert [(f.name, f.read_bytes()) for f in (tmp_path / "index").iterdir()] == [("block-000000.mph", b"again")]


def test_cuts_encode_like_the_library_on_random_text(tokenizer):
    """All code points below the bound of the quick encoder, in random order with spaces and signs."""
    import pyarrow as pa
    from tokenizers import Tokenizer

    from lanternfish.llm.tokens import Cut, vocabulary

    t, r = Tokenizer.from_file(tokenizer), random.Random(18)
    signs = [" ", " ", "\n", "'", "'s", ".", ",", "  ", "\t", "1"]
    texts = ["".join(r.choice(signs) if r.random() < 0.3 else chr(r.randrange(1, 0x530)) for _ in range(60)) for _ in range(400)]
    texts += ["".join(chr(c) for c in range(a, min(a + 40, 0x530))) for a in range(1, 0x530, 40)]
    vocab = vocabulary(bpe.read_tokenizer(tokenizer))
    cut = Cut(pa.chunked_array([texts]))
    flat, ends = cut.joined(vocab.encode(cut.distinct), vocab.dtype)
    for text, a, b in zip(texts, ends[:-1], ends[1:], strict=True):
        assert flat[a:b].tolist() == t.encode(text, add_special_tokens=False).ids


def test_anchors_of_a_text_of_many_words(monkeypatch):
    """Runs of any length give the anchors of one run, and a text of more words than a place has bits for goes through."""
    rng = random.Random(5)
    texts = pa.chunked_array([pa.array([" ".join(rng.choice("abc") for _ in range(n)) for n in (900, 3, 0, 40, 1200)])])
    whole_run = substring_dedup.Words(texts).anchored(35, 12)
    for run in (1, 7, 64, 2143, 2144):
        monkeypatch.setattr(substring_dedup, "RUN", run)
        for a, b in zip(substring_dedup.Words(texts).anchored(35, 12), whole_run, strict=True):
            assert np.array_equal(a, b)
    monkeypatch.undo()
    n = (1 << 24) + 1000
    words = substring_dedup.Words(pa.chunked_array([pa.array(["x " * (n - 40) + " ".join(map(str, range(40)))])]))
    at, place, anchor = words.anchored(35, 12)
    assert len(at) == n - 34 and (at <= place).all() and (place <= at + 23).all()
    assert (np.diff(place) >= 0).all() and len(np.unique(anchor[: n - 80])) == 1


def test_distinct_cuts_are_encoded_together(tokenizer):
    """Few calls whatever the number of cuts, and each cut's ids as if it were alone, at edges of every kind."""
    from tokenizers import Tokenizer

    from lanternfish.llm.tokens import Vocabulary

    vocab, t = Vocabulary(bpe.read_tokenizer(tokenizer)), Tokenizer.from_file(tokenizer)
    t.no_truncation()
    t.no_padding()
    edges = ["", " ", "\n", "\r\n", "\t", "\x1c", "\x85", "\xa0", "a", "é", "ж", "̀", "中", "😀", "'s", "'", "--", "1", *vocab.special]
    cuts = [f"{a}{b}{c}" for a in edges for b in ("", " ", "word", "Ça", "\n", "7x") for c in edges] + [f" w{k}" for k in range(20_000)]
    cuts = [c.encode() for c in dict.fromkeys(cuts) if c]
    library, plain = vocab.encoder()
    assert plain
    calls = []
    vocab.encoders = library, lambda text: calls.append(text) or plain(text)
    vocab.AT_ONCE = 1000
    got = vocab.encode(cuts)
    assert len(calls) < len(cuts) / 5 and max(map(len, calls)) < 20_000
    for cut, ids in zip(cuts, got, strict=True):
        assert np.frombuffer(ids, vocab.dtype).tolist() == t.encode(cut.decode(), add_special_tokens=False).ids, cut
    assert vocab.encode([]) == []


def test_words_travel_without_offsets():
    """Values of any length come back, in little more than their own bytes and one for each length."""
    rng = random.Random(3)
    for values in ([], [b""], [b"a", b"", b"bc"], [b"x" * 255, b"y"], [b"x" * 256, b"", b"z"], [b"x" * 70_000, b"q"]):
        assert bpe.blob_values(bpe.values_blob(values)).to_pylist() == values
    words = [rng.randbytes(rng.randrange(1, 9)) for _ in range(5000)]
    assert bpe.blob_values(bpe.values_blob(words)).to_pylist() == words
    assert len(bpe.values_blob(words)) < sum(map(len, words)) + len(words) + 1000
