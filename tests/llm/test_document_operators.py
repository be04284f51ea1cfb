import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from factorweave.llm import ctw, decontaminate, jaccard, media, mixing, sharding, toxicity

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def split(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))


def shingles(text):
    w = split(text)
    return set(zip(*(w[i:] for i in range(5)), strict=False)) if len(w) >= 5 else {tuple(w)} if w else set()


def components(rows):
    sets = [(i, shingles(t)) for i, t, *_ in rows]
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            s, t = sets[a][1], sets[b][1]
            if s and t and 100 * len(s & t) >= 75 * len(s | t):
                root[find(a)] = find(b)
    least = defaultdict(list)
    for k, (i, _) in enumerate(sets):
        if i is not None:
            least[find(k)].append(i)
    return Counter((i, len(s), min(least[find(k)], default=None) if s else i) for k, (i, s) in enumerate(sets))


def test_jaccard_equals_brute_force(docs, rows, no_docs):
    got = Counter(tuple(r) for r in jaccard.jaccard_components(docs).select("doc_id", "n_shingles", "component_id").collect())
    assert got == components(rows)
    assert jaccard.jaccard_components(no_docs).count() == 0


def test_jaccard_does_not_depend_on_the_common_list(docs, rows, monkeypatch):
    monkeypatch.setattr(jaccard, "COMMON_FROM", 2)
    monkeypatch.setattr(jaccard, "REPORTED_FROM", 1)
    monkeypatch.setattr(jaccard, "BLOCK", 4)
    assert Counter(tuple(r) for r in jaccard.jaccard_components(docs).collect()) == components(rows)


def test_jaccard_does_not_depend_on_hot_keys(docs, rows, monkeypatch):
    monkeypatch.setattr(jaccard, "HOT_LEAST", 2)
    assert Counter(tuple(r) for r in jaccard.jaccard_components(docs).collect()) == components(rows)


def test_jaccard_keys_meet_at_every_size():
    # least similar sets that still link, sizes 1 to 400 and each band's border, with several common lists
    import numpy as np

    rng = np.random.default_rng(5)
    borders = [jaccard.SMALL * jaccard.BAND**k + d for k in range(6) for d in (-1, 0, 1)]
    for a in sorted({*range(1, 401), *borders}):
        for b in sorted({a, a + 1, 4 * a // 3, int(rng.integers(a, 4 * a // 3 + 1)), *(x for x in borders if a <= x <= 4 * a // 3)}):
            shared = -(-75 * (a + b) // 175)
            if shared > a:
                continue
            pool = rng.integers(0, 1 << 63, a + b - shared, dtype=np.int64).astype(np.uint64) * np.uint64(2)
            one, two = np.sort(pool[:a]), np.sort(pool[a - shared :])
            for listed in (0.0, 0.5, 1.0):
                common = np.sort(pool[rng.random(len(pool)) < listed])
                assert len(np.intersect1d(jaccard.cell_keys(one, common), jaccard.cell_keys(two, common))), (a, b, listed)


def test_jaccard_links_small_sets_of_every_size(spark):
    # a text of n shingles and longer, shorter and changed ones, each pair with words of its own
    rows = []
    for n in range(10, 26):
        for more in range(-n // 3, n // 3 + 2):
            for changed in (None, 0, n // 2):
                own = [f"p{len(rows)}w{i}" for i in range(n + 4 + max(0, more))]
                other = own[: n + 4 + more]
                if changed is not None:
                    other[changed] = "changed"
                rows += [(len(rows), " ".join(own[: n + 4])), (len(rows) + 1, " ".join(other))]
    expected = components(rows)
    sizes = {i: len(shingles(t)) for i, t in rows}
    assert {(sizes[i], sizes[c]) for i, _, c in expected if i != c} >= {(16, 15), (15, 16), (16, 12), (20, 15), (15, 20), (22, 17)}
    table = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    assert Counter(tuple(r) for r in jaccard.jaccard_components(table).select("doc_id", "n_shingles", "component_id").collect()) == expected


def test_one_of_each_group_stays(docs, rows):
    kept = jaccard.keep_one_of_each(docs)
    assert kept.columns == docs.columns
    expected = {c for i, n, c in components(rows) if i is not None}
    assert sorted(r.doc_id for r in kept.where("doc_id is not null").collect()) == sorted(expected)
    assert kept.where("doc_id is null").count() == 3


def test_one_of_each_goes_by_row(spark):
    # repeated ids with different texts
    a, b, c, d = (" ".join(f"{k}{i}" for i in range(40)) for k in "abcd")
    rows = [(1, a), (2, a + " more"), (2, b), (3, c), (3, d), (3, d), (4, c + " more"), (5, ""), (5, ""), (5, "one")]
    kept = jaccard.keep_one_of_each(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3))
    assert Counter(map(tuple, kept.collect())) == Counter([(1, a), (2, b), (3, c), (3, d), (5, ""), (5, "one")])


def test_mixing(docs, rows, no_docs):
    out = mixing.with_copies(docs).collect()
    sizes = [len(split(t)) for _, t, *_ in rows]
    assert len(out) == len(rows) and sum(r["size"] for r in out) == sum(sizes)
    by = defaultdict(list)
    for r in out:
        by[r.source].append(r)
        assert 0 <= r.copies <= 2
    assert math.isclose(sum(v[0].target for v in by.values()), 1.5 * sum(sizes))
    for v in by.values():
        total = sum(r["size"] for r in v)
        assert v[0].source_size == total and v[0].target <= 2 * total
        assert abs(sum(r["size"] * r.copies for r in v) - v[0].target) <= max((r["size"] for r in v), default=0)
    assert Counter(map(str, out)) == Counter(map(str, mixing.with_copies(docs.repartition(7)).collect()))
    twins = docs.sparkSession.createDataFrame([(7, "a b c", f"l{i}", "s") for i in range(40)] + [(i, "d " * i, "x", "t") for i in range(40)], "doc_id bigint, text string, lang string, source string")
    assert Counter(map(str, mixing.with_copies(twins).collect())) == Counter(map(str, mixing.with_copies(twins.orderBy(F.rand(1)).repartition(5)).collect()))
    assert mixing.mixed(docs).count() == sum(r.copies for r in out) and mixing.mixed(docs).columns == docs.columns
    assert mixing.with_copies(no_docs).count() == 0


def test_sharding(docs, rows, no_docs):
    out = sharding.sharded(docs, bucket_bytes=4096).collect()
    assert len(out) == len(rows)
    by = defaultdict(list)
    for r in out:
        by[r.shard].append(r.slot)
        assert r["size"] == len((r.text or "").encode()) + 8
        assert r.text_crc32 == (None if r.text is None else zlib.crc32(r.text.encode()))
        assert r.grown_shard in (r.shard, 24)
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    assert len({(r.doc_id, r.shard) for r in out}) == len({r.doc_id for r in out})
    again = sharding.sharded(docs, bucket_bytes=4096).collect()
    assert Counter((r.doc_id, r.shard, r.slot) for r in out) == Counter((r.doc_id, r.shard, r.slot) for r in again)
    assert sharding.sharded(no_docs).count() == 0


def test_sharding_does_not_depend_on_partitions(spark, docs, rows, tmp_path):
    slots = lambda df: Counter((r.doc_id, r.text_crc32, r.shard, r.slot) for r in sharding.sharded(df, shards=3, bucket_bytes=4096, bucket_rows=10).collect())
    assert slots(docs) == slots(docs.repartition(7)) == slots(docs.orderBy("text").coalesce(1))
    sharding.write_shards(docs, str(tmp_path / "shards"), 3)
    found = 0
    for name in (tmp_path / "shards").rglob("*.parquet"):
        run = [r.slot for r in spark.read.parquet(str(name)).collect()]
        assert run == list(range(run[0], run[0] + len(run)))
        found += len(run)
    assert found == len(rows)


def test_sharding_draws_are_fisher_yates(spark):
    # the exchanges, one by one, with the draws that the same hashes give
    draws = spark.range(1, 40).select(F.pmod(F.xxhash64(F.lit(7), F.lit(3), F.col("id").cast("int")), F.col("id") + 1).alias("j")).orderBy("id").collect()
    expected = list(range(40))
    for i in range(39, 0, -1):
        j = draws[i - 1].j
        expected[i], expected[j] = expected[j], expected[i]
    assert spark.range(1).select(sharding._permutation(F.lit(40), 7, F.lit(3)).alias("p")).first().p == expected
    assert spark.range(1).select(sharding._permutation(F.lit(1), 7, F.lit(3)).alias("p")).first().p == [0]


def brute_hits(text, items):
    w = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").translate(LOWER))
    hit, found = [False] * len(w), set()
    for item, t in items:
        q = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (t or "").translate(LOWER))
        k = min(13, len(q))
        for a in range(len(q) - k + 1 if q else 0):
            for b in range(len(w) - k + 1):
                if w[b : b + k] == q[a : a + k]:
                    hit[b : b + k] = [True] * k
                    found.add(str(item))
    n = sum(hit)
    return len(w), n, len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), n > 0 and 20 * n >= len(w)


def test_decontamination_equals_brute_force(spark, docs, rows, no_docs, monkeypatch):
    items = [(1, " ".join(split(rows[0][1])[10:30])), (2, "same row twice"), (3, None), (4, ""), (5, "One"), (6, " ".join(split(rows[1][1])[:13])), (7, rows[0][1]), (7, "漢字 \U0001f600")]
    bench = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id bigint, text string, spans string")
    expected = Counter((r[0], *brute_hits(r[1], items)) for r in rows)
    assert Counter(tuple(r) for r in decontaminate.contamination(docs, bench).collect()) == expected
    monkeypatch.setattr(decontaminate, "WINDOWS_PER_BLOCK", 10)
    monkeypatch.setattr(decontaminate, "ROUND_WORDS", 30)
    assert Counter(tuple(r) for r in decontaminate.contamination(docs, bench).collect()) == expected
    assert Counter(tuple(r) for r in decontaminate.benchmark_hits(docs.select("doc_id", "text"), bench, 10).select("doc_id", "n_words").collect()) == Counter((r[0], e[1]) for r in rows for e in [(0, len(re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (r[1] or "").translate(LOWER))))])
    kept = decontaminate.decontaminated(docs, bench)
    assert kept.columns == docs.columns and kept.count() == sum(n for k, n in expected.items() if not k[-1])
    assert decontaminate.contamination(docs, bench.limit(0)).where("n_hit > 0").count() == 0
    assert decontaminate.contamination(no_docs, bench).count() == 0


def test_media_round_trip(spark, docs, rows, no_docs):
    out = media.media_digests(docs).collect()
    expected = Counter((r[0], *media.expected_digest(r[1])) for r in rows)
    assert Counter((r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in out) == expected
    assert media.media_digests(no_docs).count() == 0
    broken = spark.createDataFrame([(1, None), (2, bytearray(b"RIFF")), (3, bytearray(media.wav_file(b"ab", 0x1234)))], "doc_id bigint, media binary")
    assert all(r.error and r.pcm is None for r in media.read_media(broken).collect())


def test_media_reads_every_codec_and_survives_bad_files(spark, docs, tmp_path):
    out = media.read_media(media.store_payloads(docs)).collect()
    assert {r.codec for r in out} == {media.MU_LAW, media.A_LAW, media.IMA_ADPCM} and not any(r.error for r in out)
    for r in out:
        tag, rate, block, data = media.read_wav(bytes(r.media))
        assert bytes(r.pcm) == media.resample(media.decode(tag, data, block), rate).astype("<i2").tobytes()
    media.write_pcm(media.store_payloads(docs), str(tmp_path / "pcm"))
    again = spark.read.parquet(str(tmp_path / "pcm"))
    assert "media" not in again.columns and Counter((r.doc_id, bytes(r.pcm)) for r in again.collect()) == Counter((r.doc_id, bytes(r.pcm)) for r in out)
    wav = media.wav_file
    bad = [wav(b"ab", rate=0), wav(b"ab", rate=1), wav(b"ab", channels=2), wav(b"abc", media.PCM, block=3, bits=24), wav(b"ab", media.IMA_ADPCM, block=0, bits=4), wav(b"ab")[:-3], b"", None, wav(b"ab", 0x55)]
    good = [wav(b"abcd", media.PCM, block=2, bits=16), wav(b"ab", media.PCM), wav(b"", media.A_LAW), wav(b"", media.IMA_ADPCM, block=36, bits=4), wav(b"abcdefg", media.IMA_ADPCM, block=5, bits=4)]
    table = spark.createDataFrame([(i, None if m is None else bytearray(m), 1) for i, m in enumerate(bad + good)], "doc_id bigint, media binary, pcm int")
    rows = {r.doc_id: r for r in media.read_media(table).collect()}
    assert all(rows[i].error and rows[i].pcm is None for i in range(len(bad)))
    assert not any(rows[len(bad) + i].error for i in range(len(good)))


def test_telephony_codecs():
    assert list(media.MU_TABLE[[0x00, 0x7F, 0x80, 0xFF]]) == [-32124, 0, 32124, 0]
    assert list(media.A_TABLE[[0x55, 0xD5, 0x2A, 0xAA]]) == [-8, 8, -32256, 32256]
    block = bytes([0x10, 0x00, 0, 0, 0x70, 0x07])
    assert list(media.decode_adpcm(block, 6)) == list(media.decode_adpcm(block * 2, 6))[:5]
    assert list(media.decode_adpcm(block, 6)) == [16, 16, 27, 57, 61]  # 7 * 11 / 8, 16 * 15 / 8 and 34 / 8, in whole steps
    assert list(media.resample(media.MU_TABLE[[0x80, 0xFF]], 8000)) == [32124, 16062, 0, 0]


def test_toxicity(spark, docs, rows, no_docs):
    # texts of their own: those that share most trigrams count as copies, of which one is learned from
    rng = random.Random(5)
    plain = lambda: " ".join(f"w{rng.randrange(300)}" for _ in range(20))
    texts = [(i, f"{plain()} {rng.choice(['Idiot!', 'fool ###']) if i % 5 == 0 else 'friend'} {plain()}", i % 5 == 0) for i in range(300)]
    known = spark.createDataFrame([(i, t) for i, t, _ in texts], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, int(x), 1) for i, _, x in texts] + [(None, 1, 0), (3, None, 0)], "doc_id bigint, toxic int, quality int")
    model = toxicity.trained(known, labels)
    score = {r.doc_id: r.score for r in toxicity.scored(known, model).collect()}
    assert all((score[i] >= toxicity.THRESHOLD) == x for i, _, x in texts)
    out = toxicity.scored(docs, model).collect()
    assert len(out) == len(rows) and all(0 <= r.score <= 1 for r in out)
    assert toxicity.without_toxic(docs, model).columns == docs.columns
    assert toxicity.scored(no_docs, model).count() == 0
    untrained = toxicity.trained(known, labels.limit(0))
    assert {r.score for r in toxicity.scored(known, untrained).collect()} == {toxicity.scored(no_docs.unionByName(docs), untrained).first().score}


def test_toxicity_scores_equal_a_plain_computation(spark, docs, rows):
    # windows, lengths and the logistic model, word by word
    import numpy as np

    from factorweave.llm import text as tx

    rng = random.Random(9)
    plain = lambda: " ".join(f"w{rng.randrange(300)}" for _ in range(20))
    texts = [(i, f"{plain()} {rng.choice(['Idiot!', 'fool ###']) if i % 4 == 0 else 'friend'} {plain()}") for i in range(300)]
    known = spark.createDataFrame(texts, "doc_id bigint, text string")
    model = toxicity.trained(known, spark.createDataFrame([(i, int(i % 4 == 0)) for i, _ in texts], "doc_id bigint, toxic int"))
    toxic, ordinary = model.dictionaries.pair()

    def code(word):
        data = np.frombuffer(word, np.uint8)
        hashed = lambda d: tx.word_hashes(d, np.array([0]), np.array([len(d)]))
        return tx.mix(hashed(data[: toxicity.STEM_BYTES])).tobytes() + hashed(data).tobytes()

    def score(text):
        folded = re.sub("[A-ZÀ-ÖØ-Þ]", lambda m: m[0].lower(), text or "")
        codes = [code(w.encode()) for w in re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", folded)]
        windows = [b"".join(codes[i : i + toxicity.WINDOW]) for i in range(0, len(codes), toxicity.WINDOW)]
        saved = [len(ordinary(w)) - len(toxic(w)) for w in windows]
        x = [0.0] * 5
        if saved:
            hits = [d >= toxicity.SAVED for d in saved]
            x = [math.log1p(max(0, *saved, 0)), math.log1p(sum(hits)), sum(hits) / len(hits), math.log1p(sum(max(0, d) for d in saved)), math.log1p(len(saved))]
        z = sum(a * b for a, b in zip(x, model.weights, strict=False)) + model.weights[-1]
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))

    got = sorted((str(r.doc_id), round(r.score, 9)) for r in toxicity.scored(docs, model).collect())
    assert got == sorted((str(r[0]), round(score(r[1]), 9)) for r in rows)


def brute_ctw(train, text):
    """Context-tree weighting with plain recursion: ln probability of a text and its end."""
    counts = defaultdict(lambda: [0, 0])
    kids = defaultdict(set)

    def walk(t):
        data = [255] * ctw.DEPTH + list(t.translate(LOWER).encode()) + [255]
        for k in range(ctw.DEPTH, len(data)):
            node = 1
            for bit in range(7, -1, -1):
                yield tuple(data[k - 1 - d] for d in range(ctw.DEPTH)), node, data[k] >> bit & 1
                node = node << 1 | data[k] >> bit & 1

    for t in train:
        for context, node, bit in walk(t):
            for d in range(ctw.DEPTH + 1):
                counts[context[:d], node][bit] += 1
                if d < ctw.DEPTH:
                    kids[context[:d], node].add(context[: d + 1])
    pe = lambda z, o: math.lgamma(z + 0.5) + math.lgamma(o + 0.5) - math.lgamma(z + o + 1) - math.log(math.pi)
    memo = {}

    def pw(context, node):
        if (context, node) not in memo:
            own = pe(*counts[context, node])
            if len(context) == ctw.DEPTH:
                memo[context, node] = own
            else:
                below = sum(pw(c, node) for c in kids[context, node])
                memo[context, node] = max(own, below) + math.log1p(math.exp(-abs(own - below))) - math.log(2)
        return memo[context, node]

    total = 0.0
    for context, node, bit in walk(text):
        q = None
        for d in range(ctw.DEPTH, -1, -1):
            z, o = counts.get((context[:d], node), (0, 0))
            if z + o == 0:
                continue
            here = ((o if bit else z) + 0.5) / (z + o + 1)
            if q is None:
                q = here
            else:
                ratio = math.exp(min(700, max(-700, pe(z, o) - sum(pw(c, node) for c in kids[context[:d], node]))))
                q = (ratio * here + q) / (ratio + 1)
        total += math.log(0.5 if q is None else q)
    return total / math.log(10)


def test_ctw_equals_brute_force(spark, docs, rows, no_docs, monkeypatch):
    monkeypatch.setattr(ctw, "BLOCK_BYTES", 600)
    texts = [(1, "abab abba", False), (2, "Abba baab aab", False), (3, "abba abc", True), (4, None, True), (5, "aab é", False), (5, "aab é", False)]
    out = {r.doc_id: r for r in ctw.score_documents(spark.createDataFrame(texts, "doc_id bigint, text string, held_out boolean")).collect()}
    train = [t or "" for _, t, h in texts if not h]
    tokens = Counter(w for t in train for w in [*split(t), None])
    n, v = sum(tokens.values()), len(tokens)
    for i, t, h in texts:
        own = [*split(t), None]
        assert math.isclose(out[i].score, brute_ctw(train, t or ""), rel_tol=1e-9)
        assert math.isclose(out[i].base_score, sum(math.log10((tokens[w] + 0.5) / (n + 0.5 * (v + 1))) for w in own), rel_tol=1e-9)
        assert (out[i].n_tokens, out[i].n_known, out[i].train_tokens, out[i].held_out) == (len(own), sum(tokens[w] > 0 for w in own), n, h)
    assert ctw.score_documents(docs.withColumn("held_out", F.col("doc_id") % 5 == 1)).count() == len(rows)
    assert ctw.score_documents(no_docs.withColumn("held_out", F.lit(True))).count() == 0


def test_long_texts_take_several_rounds(monkeypatch):
    import numpy as np

    from factorweave.llm import text as tx

    data = np.frombuffer(" ".join(f"wörd{i} {'x' * (i % 90)}" for i in range(500)).encode(), np.uint8)
    off = np.array([0, 700, 700, len(data)])
    starts, ends, _ = tx.words(data, off, tx.SPACES)
    hashes, grams = tx.word_hashes(data, starts, ends), np.concatenate(list(ctw.byte_grams(data, off)))
    assert len(grams) == len(data) + 3
    # each gram by itself: the bytes before it within its text, nearest first, then its own or the end mark
    plain = []
    for a, b in zip(off[:-1], off[1:], strict=True):
        padded = [ctw.END] * ctw.DEPTH + data[a:b].tolist() + [ctw.END]
        plain += [int.from_bytes(bytes([*padded[k - 1 : k - 1 - ctw.DEPTH if k > ctw.DEPTH else None : -1], padded[k]]), "big") for k in range(ctw.DEPTH, len(padded))]
    assert grams.tolist() == plain
    monkeypatch.setattr(tx, "SPAN_BYTES", 64)
    monkeypatch.setattr(ctw, "SPAN_GRAMS", 100)
    assert (tx.word_hashes(data, starts, ends) == hashes).all() and (np.concatenate(list(ctw.byte_grams(data, off))) == grams).all()


def test_ctw_does_not_depend_on_hot_contexts(spark, docs, monkeypatch):
    marked = docs.withColumn("held_out", F.col("doc_id") % 5 == 1)
    monkeypatch.setattr(ctw, "HOT_GRAMS", 1 << 60)
    plain = sorted((r.doc_id or -1, r.score) for r in ctw.score_documents(marked).collect())
    monkeypatch.setattr(ctw, "HOT_GRAMS", 1)
    monkeypatch.setattr(ctw, "HOT_SHARE", 1e-4)
    split = sorted((r.doc_id or -1, r.score) for r in ctw.score_documents(marked).collect())
    assert all(a == b and math.isclose(x, y, rel_tol=1e-9) for (a, x), (b, y) in zip(plain, split, strict=True))


def test_ctw_is_a_distribution():
    # the probabilities of all last bytes after one context add up to one
    import numpy as np
    import pyarrow as pa

    seen = np.array([0x6161616161_61 + b for b in (0, 1, 1, 7)], np.uint64)
    keys = np.unique(np.concatenate((seen & ~np.uint64(255) | np.arange(256, dtype=np.uint64)[:, None]).astype(np.uint64), axis=None))
    n = np.array([int((seen == k).sum()) for k in keys])
    batch = pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(n)], ["key", "n"])
    nodes = [row for b in ctw.subtree_weights(np.zeros(0, np.int64))(iter([batch])) for row in zip(*(c.to_pylist() for c in b.columns), strict=True)]
    (out,) = ctw.gram_values(ctw.Top(nodes))(iter([batch]))
    assert math.isclose(np.exp(out.column(1).to_numpy()).sum(), 1.0, rel_tol=1e-9)


def test_ctw_looks_keys_up_without_binary_search():
    # scoring a text of many n-grams takes less time than binary searches of these alone
    import time

    import numpy as np
    import pyarrow as pa

    data = np.frombuffer(b"abcdefghijklmnopqrstuvwxyz ", np.uint8)[np.random.default_rng(5).integers(0, 27, 3_000_000)]
    docs = pa.table({"text": [p.tobytes().decode() for p in np.split(data, 10)], "doc_id": range(10), "held_out": [True] * 10, "block": pa.array([0] * 10, pa.int32())})
    keys = ctw.block_counts(docs).column("key").to_numpy()
    grams = keys[keys >= 0]
    value = np.where(keys >= 0, -1.0 - keys % 7, keys % 3)
    table = pa.table({"key": keys[::-1], "value": value[::-1]})
    found = np.concatenate(list(ctw.byte_grams(data, np.arange(0, 3_000_001, 300_000))))
    start = time.process_time()
    where = np.searchsorted(grams, found.view(np.int64))
    middle = time.process_time()
    out = ctw._scores(100, 10)(docs, table)
    assert time.process_time() - middle < middle - start
    sums = (value[keys >= 0][where]).reshape(10, -1).sum(1) / math.log(10)
    assert np.allclose(out.column("score").to_numpy(), sums, rtol=1e-12)


def test_ctw_table_equals_dict():
    import numpy as np
    import pytest

    for n in (0, 1, 2, 3, 1000):
        keys = np.random.default_rng(n).permutation(np.arange(n, dtype=np.uint64) * np.uint64(1 << 40))
        table = ctw.Table(keys, np.arange(n) + 0.5)
        assert (table.values[table.places(keys)] == np.arange(n) + 0.5).all()
        # a key without a value is an error, not another key's value
        with pytest.raises(KeyError):
            table.places(np.append(keys, np.uint64(12345)))
