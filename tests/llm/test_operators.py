"""The training-data operators against brute force on small tables, with their odd cases."""

import hashlib
import itertools
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from docloom.llm import common, decontaminate, language, licenses, lines, packing, quality, sharding, simhash, substrings, vptree

TOKENIZER = str(public_tokenizers.path("word_bpe_49k.json"))
DOCS = "doc_id long, text string, block string, shard int, size string, id string, node string, words string, n int, c int, at string"


def docs(spark, texts, start=0):
    """Rows with extra columns whose names the operators use themselves."""
    return spark.createDataFrame([(start + i, t, "b", 1, "s", "i", "n", "w", 1, 2, "a") for i, t in enumerate(texts)], DOCS)


def sentence(seed, n):
    r = np.random.default_rng(seed)
    return " ".join("".join(chr(97 + c) for c in r.integers(0, 26, 5)) for _ in range(n))


ODD = [None, "", "   \n\t ", "one", "a b c d", "x" * 50_000, "the same words here again", "the same words here again", " ".join(["word"] * 3000)]


# Words and ranks


@settings(deadline=None)
@given(st.lists(st.text(st.sampled_from("ab é中\t\n\x0b\x0c\r\xa0\x1c"), max_size=30), max_size=8), st.integers(1, 9))
def test_words(texts, chunk):
    import pyarrow as pa

    data, offsets = common.text_buffers(pa.array(texts, pa.string()))
    hashes, first, last, rows = common.words(data, offsets, chunk)
    want = [[w for w in re.split("[\x20\x09-\x0d]+", t) if w] for t in texts]
    assert list(np.diff(rows)) == [len(w) for w in want]
    raw = data.tobytes()
    assert [raw[a:b].decode() for a, b in zip(first, last)] == [w for ws in want for w in ws]
    by_word = {}
    for w, h in zip((w for ws in want for w in ws), hashes):
        assert by_word.setdefault(w, h) == h
    assert len(set(by_word.values())) == len(by_word)


def test_scratch_tables_go_with_their_scope(spark):
    import os

    with common.scratch_scope():
        table = common.materialize(spark.range(5), "t")
        path = table.inputFiles()[0].removeprefix("file://")
        assert table.count() == 5 and os.path.exists(path)
    assert not os.path.exists(path)


def test_gapless_rank(spark):
    frame = spark.createDataFrame([(i % 7 != 0, i // 2) for i in range(500)], "k boolean, v int")
    found = common.with_gapless_rank(frame, ["k"], ["v"], "r", 500, per_bucket=40).collect()
    for k in (True, False):
        ranks = sorted(r["r"] for r in found if r["k"] == k)
        assert ranks == list(range(len(ranks)))


# 1. Sharding


@settings(deadline=None, max_examples=40)
@given(st.lists(st.integers(0, 6), min_size=1, max_size=3), st.lists(st.integers(0, 6), min_size=1, max_size=3), st.randoms())
def test_flow_is_cheapest(supply, capacity, rnd):
    capacity = [*capacity, max(0, sum(supply) - sum(capacity))]
    cost = [[rnd.randint(0, 5) for _ in capacity] for _ in supply]
    flow = sharding.min_cost_flow(supply, capacity, cost)
    assert [sum(r) for r in flow] == supply
    assert all(sum(r[j] for r in flow) <= c for j, c in enumerate(capacity))
    # By brute force: units one after the other, over all room left.
    best = {tuple(capacity): 0}
    for i, n in enumerate(supply):
        for _ in range(n):
            step = {}
            for room, spent in best.items():
                for j, x in enumerate(room):
                    if x:
                        to = (*room[:j], x - 1, *room[j + 1 :])
                        step[to] = min(step.get(to, 10**9), spent + cost[i][j])
            best = step
    assert sum(f * c for fs, cs in zip(flow, cost) for f, c in zip(fs, cs)) == min(best.values())


def test_flow_refuses_too_much():
    with pytest.raises(ValueError, match="fit"):
        sharding.min_cost_flow([5], [4], [[0]])


def test_balanced_shards(spark):
    texts = [sentence(i, 1 + i % 40) for i in range(400)] + ODD[:5]
    found = sharding.balanced_shards(docs(spark, texts), block_rows=20).toPandas()
    assert sorted(found["doc_id"]) == list(range(len(texts)))
    sizes = {i: len((t or "").encode()) + 1 for i, t in enumerate(texts)}
    crcs = {i: zlib.crc32((t or "").encode()) for i, t in enumerate(texts)}
    assert dict(zip(found["doc_id"], found["size"])) == sizes and dict(zip(found["doc_id"], found["text_crc32"])) == crcs
    for _, g in found.groupby("shard"):
        assert sorted(g["slot"]) == list(range(len(g)))
    total = found.groupby("shard")["size"].sum()
    assert len(total) == 16 and total.max() - total.min() < 400
    kept = found[found["shard"] == found["old_shard"]]["size"].sum()
    old = found.groupby("old_shard")["size"].sum()
    least = sum(max(0, x - sum(sizes.values()) / 16) for x in old)
    assert sum(sizes.values()) - kept <= least * 1.05 + 200
    assert sharding.balanced_shards(docs(spark, [])).count() == 0


def test_files_are_rewritten_where_needed(spark, tmp_path):
    rows = spark.createDataFrame([(i, i % 3, i % 2, "x" * (i % 17)) for i in range(300)], "doc_id long, s int, b int, text string")
    root = str(tmp_path)
    sharding.write_sharded(rows, root, "s", "b")
    after = sharding.rewrite_affected(spark, root, 4, "length(text) + 1")
    assert set(after["shards"]) == {0, 1, 2, 3} and len(after["rewritten"]) < 6
    seen, totals = [], []
    for shard in range(4):
        part = sharding.read_shard(spark, root, shard).toPandas()
        seen += list(part["doc_id"])
        totals.append(sum(len(t) + 1 for t in part["text"]))
    assert sorted(seen) == list(range(300)) and max(totals) - min(totals) <= 40


# 2. Decontamination


def test_masks_stand_two_substitutions():
    for bad in itertools.combinations(range(decontaminate.WORDS), 2):
        places = range(decontaminate.WORDS - decontaminate.SPAN + 1)
        assert any(not {i + k for k in mask} & set(bad) for mask in decontaminate.MASKS for i in places), bad


@pytest.mark.parametrize("n", range(1, decontaminate.WORDS + 1))
def test_masks_of_each_length_stand_the_allowed_substitutions(n):
    masks = decontaminate.MASKS if n == decontaminate.WORDS else decontaminate.short_masks(n)
    for bad in itertools.combinations(range(n), n - -(-4 * n // 5)):
        assert any(not {i + k for k in mask} & set(bad) for mask in masks for i in range(n - mask[-1])), bad


def test_short_leaks_with_substitutions(spark):
    items = {n: sentence(700 + n, n).split() for n in range(1, 13)}
    texts, want = [], set()
    for n, item in items.items():
        allowed = n - -(-4 * n // 5)
        for k in range(allowed + 2):
            for bad in itertools.combinations(range(n), k):
                changed = " ".join("zzz" if i in bad else w for i, w in enumerate(item))
                want |= {(len(texts), n)} if k <= allowed else set()
                texts.append(f"{sentence(800, 3)} {changed} {sentence(801, 3)}")
        # At a text's edges, where the words left out aren't there at all.
        for cut in (item[allowed:], item[: n - allowed]):
            want.add((len(texts), n))
            texts.append(" ".join(cut))
    benchmark = spark.createDataFrame([(n, " ".join(w)) for n, w in items.items()], "item_id long, text string")
    found = {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(docs(spark, texts), benchmark).collect()}
    assert found == want


def test_leaks_agree_with_sql_for_items_of_any_length(spark):
    import duckdb

    items = [sentence(700 + n, n).split() for n in (1, 3, 5, 7, 9, 11, 12, 13, 20)]
    texts = [None, "", *(" ".join("zzz" if i in bad else w for i, w in enumerate(item)) for item in items for bad in itertools.combinations(range(len(item)), min(2, len(item) // 4)))]
    documents, benchmark = docs(spark, [f"x {t} y" if t else t for t in texts]).select("doc_id", "text").toPandas(), spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)], "item_id long, text string")  # noqa: F841
    connection, bench = duckdb.connect(), benchmark.toPandas()
    connection.register("documents", documents)
    connection.register("benchmark", bench)
    want = sorted(map(tuple, connection.execute(decontaminate.SQL).fetchall()))
    found = sorted((r["doc_id"], r["item_id"], r["matched"], r["window"]) for r in decontaminate.contaminated(docs(spark, [f"x {t} y" if t else t for t in texts]), benchmark).collect())
    assert found == want and {x[1] for x in found} == set(range(9)) - {4}  # of nine words eight must agree


def test_items_with_one_id(spark):
    a, b = sentence(1, 20), sentence(2, 9)
    benchmark = spark.createDataFrame([(1, a), (1, b)], "item_id long, text string")
    found = {r["doc_id"]: (r["matched"], r["window"]) for r in decontaminate.contaminated(docs(spark, [a, b, f"{a} {b}", f"{a} {b}"]), benchmark).collect()}
    assert found == {0: (13, 13), 1: (9, 9), 2: (13, 13), 3: (13, 13)}
    same = spark.createDataFrame([(1, a), (1, a)], "doc_id long, text string")
    assert [tuple(r) for r in decontaminate.contaminated(same, benchmark).collect()] == [(1, 1, 13, 13)]


def test_leaks_with_substitutions(spark):
    item, other = sentence(1, 30).split(), sentence(2, 20).split()
    changed = [w if i not in (3, 11, 19, 27) else "zzz" for i, w in enumerate(item)]
    far = [w if i % 3 else "zzz" for i, w in enumerate(item)]
    texts = [sentence(3, 200), f"{sentence(4, 50)} {' '.join(item)} {sentence(5, 50)}", f"x, {' '.join(changed).upper()}!", " ".join(far), " ".join(item[4:17]), " ".join(item[4:14]), "tiny item"]
    benchmark = spark.createDataFrame([(1, " ".join(item)), (2, " ".join(other)), (3, "Tiny, item."), (4, None), (5, ""), (1, " ".join(item))], "item_id long, text string")
    found = {(r["doc_id"], r["item_id"]): r["matched"] for r in decontaminate.contaminated(docs(spark, [*texts, *ODD]), benchmark).collect()}
    assert found == {(1, 1): 13, (2, 1): 12, (4, 1): 13, (6, 3): 2}
    left = {r["doc_id"] for r in decontaminate.drop_contaminated(docs(spark, [*texts, *ODD]), benchmark).collect()}
    assert left == set(range(len(texts) + len(ODD))) - {1, 2, 4, 6}
    assert decontaminate.contaminated(docs(spark, []), benchmark).count() == 0
    assert decontaminate.contaminated(docs(spark, texts), benchmark.limit(0)).count() == 0


# 3. Quality, 6. language: accuracy on held-out rows


def auc(y, s):
    good, bad = s[y == 1], s[y == 0]
    return (good[:, None] > bad[None]).mean() + 0.5 * (good[:, None] == bad[None]).mean()


def test_quality(spark):
    from docloom.llm import queries

    found = queries.op3_quality(spark, "/root/testdata/sf0.01").toPandas()
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").toPandas()
    held = found[found["held_out"]].merge(labels, on="doc_id")
    assert len(found) == 1000 and found["score"].between(0, 1).all()
    assert (found["held_out"] == found["doc_id"].map(lambda i: zlib.crc32(str(i).encode()) % 5 == 0)).all()
    assert auc(held["quality"].to_numpy(), held["score"].to_numpy()) > 0.95
    assert ((found["score"] >= 0.3).astype(int) == found["predicted"]).all()


def test_quality_odd_cases(spark):
    labels = spark.createDataFrame([(i, int(i % 2)) for i in range(6)] + [(None, 1), (0, 0)], "doc_id long, quality int")
    model = quality.train(docs(spark, [*[sentence(i, 40) for i in range(6)], *ODD]), labels, epochs=2)
    found = quality.score(docs(spark, ODD), model).toPandas()
    assert len(found) == len(ODD) and found["score"].between(0, 1).all()
    assert quality.train(docs(spark, ODD), labels.limit(0)) is None
    assert set(quality.score(docs(spark, ODD), None).toPandas()["score"]) == {0.5}
    assert quality.score(docs(spark, []), model).count() == 0


def test_a_long_token_leaves_scores_whole(spark):
    texts = [sentence(i, 40) for i in range(20)] + ["x" * 40_000 + " word"]
    frame = docs(spark, texts).selectExpr("*", "n as score")
    model = quality.train(frame, spark.createDataFrame([(i, i % 2) for i in range(21)], "doc_id long, quality int"), epochs=3)
    found = quality.score(frame, model).toPandas()
    assert len(found) == 21 and found["score"].between(0, 1).all() and all(np.isfinite(p).all() for p in model.p.values())


def test_scores_by_plain_loops(spark):
    """The network's own course over one document after the other, passage by passage."""
    import math

    import pyarrow as pa

    texts = [sentence(i, 20 + 90 * i) for i in range(8)] + ["", " \n\n ", "\n\n word " * 700, " "]
    model = quality.train(docs(spark, texts), spark.createDataFrame([(i, i % 2) for i in range(8)], "doc_id long, quality int"), epochs=4)
    found = {r["doc_id"]: r["score"] for r in quality.score(docs(spark, texts), model).collect()}
    p = {k: v.astype(float) for k, v in model.p.items()}
    sigmoid = lambda x: 1 / (1 + math.exp(-x))
    for i, t in enumerate(texts):
        x, at = quality.passages(*common.text_buffers(pa.array([t])))
        assert len(x) == max(1, -(-len(t.split()) // quality.PASSAGE)) == at[-1]
        hidden, weights = [], []
        for row in x.astype(float):
            scaled = [(v - m) * s for v, m, s in zip(row, model.mean, model.scale)]
            h = [math.tanh(sum(v * p["W"][k][j] for k, v in enumerate(scaled)) + p["b"][j]) for j in range(quality.HIDDEN)]
            gate = [math.tanh(sum(h[k] * p["V"][k][j] for k in range(len(h)))) * sigmoid(sum(h[k] * p["U"][k][j] for k in range(len(h)))) for j in range(len(h))]
            hidden.append(h)
            weights.append(math.exp(sum(g * w for g, w in zip(gate, p["w"]))))
        z = [sum(w * h[j] for w, h in zip(weights, hidden)) / sum(weights) for j in range(quality.HIDDEN)]
        assert abs(found[i] - sigmoid(sum(a * b for a, b in zip(z, p["c"])) + p["d"][0])) < 1e-4, i


def test_attention_gradient():
    r = np.random.default_rng(0)
    net = quality.GatedAttention(5, 3)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    x, at, y = r.normal(size=(9, 5)), np.array([0, 2, 3, 9]), np.array([1.0, 0.0, 1.0])

    def loss():
        p, _ = net.forward(x, at)
        return -(y * np.log(p) + (1 - y) * np.log(1 - p)).mean()

    p, kept = net.forward(x, at)
    for name, g in net.gradient(p, y, kept).items():
        for i in np.ndindex(g.shape):
            net.p[name][i] += 1e-6
            up = loss()
            net.p[name][i] -= 2e-6
            assert abs((up - loss()) / 2e-6 - g[i]) < 1e-5
            net.p[name][i] += 1e-6


def test_language(spark):
    from docloom.llm import queries

    found = queries.op6_language(spark, "/root/testdata/sf0.01").toPandas()
    truth = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang").toPandas()
    held = found[found["held_out"]].merge(truth, on="doc_id")
    assert len(found) == 1000 and (held["lang_pred"] == held["lang"]).mean() > 0.98


def test_language_odd_cases(spark):
    rows = docs(spark, [sentence(i, 30) for i in range(20)]).selectExpr("doc_id", "text", "'aa' as lang")
    greek = rows.selectExpr("doc_id + 100", "translate(text, 'abcdefghijklmnopqrstuvwxyz', 'αβγδεζηθικλμνξοπρστυφχψωϑϕ')", "'el' as lang")
    model = language.train(rows.union(greek))
    found = language.identify(docs(spark, [*ODD, "123 456!", "Ελληνικά κείμενα εδώ", "日本語の文章です。" * 20]), model).toPandas()
    by = dict(zip(found["doc_id"], zip(found["lang_pred"], found["rejected"], found["score"])))
    assert [by[i][0] for i in (0, 1, 2, len(ODD))] == ["und"] * 4 and all(by[i][1] and by[i][2] == 0 for i in (0, 1, 2, len(ODD)))
    assert by[len(ODD) + 1][0] == "el" and by[len(ODD) + 2][1]
    clashing = docs(spark, ["Ελληνικά κείμενα εδώ"]).selectExpr("*", "1 as score", "2 as lang_pred", "3 as rejected")
    assert language.identify(clashing, model).first()["lang_pred"] == "el"
    assert language.train(rows.limit(0)) is None
    assert set(language.identify(docs(spark, ODD), None).toPandas()["lang_pred"]) == {"und"}
    assert language.identify(docs(spark, []), model).count() == 0


def test_languages_by_plain_loops(spark):
    """Every n-gram counted by itself, and the cosine with every centroid, for whole texts."""
    import math

    rows = docs(spark, [sentence(i, 30) for i in range(30)]).selectExpr("doc_id", "text", "'aa' as lang")
    rows = rows.union(docs(spark, [sentence(50 + i, 30).translate(str.maketrans("abcdefgh", "éàüößñçî")) for i in range(30)], 100).selectExpr("doc_id", "text", "'bb' as lang"))
    model = language.train(rows)
    texts = ["Sie Éàü abc", sentence(3, 200), "été " * 40, "x", "  1a2b  c", "éàü ößñ " * 9]
    found = {r["doc_id"]: r for r in language.identify(docs(spark, texts), model).collect()}
    shift, m32 = 32 - language.DIMENSIONS.bit_length() + 1, 0xFFFFFFFF
    for i, t in enumerate(texts):
        codes, counts = [ord(c) if c.isalpha() else 0 for c in t.lower()], Counter()
        for at in range(len(codes)):
            h = codes[at] * 0x9E3779B1 & m32
            counts[h >> shift] += 1
            for k in (1, 2):
                if at + k >= len(codes):
                    break
                h = ((h ^ h >> 15) * 0x85EBCA77 + codes[at + k] * 0xC2B2AE3D) & m32
                if codes[at + k] or codes[at]:
                    counts[h >> shift] += 1
        v = {d: (1 + math.log(n)) * float(model.idf[d]) for d, n in counts.items()}
        norm = math.sqrt(sum(x * x for x in v.values()))
        cosines = [sum(x * float(c[d]) for d, x in v.items()) / norm for c in model.centroids]
        best = max(range(len(cosines)), key=cosines.__getitem__)
        assert found[i]["lang_pred"] == model.languages[model.owner[best]] and abs(found[i]["score"] - max(0, cosines[best])) < 1e-4


@settings(deadline=None)
@given(st.lists(st.text(st.sampled_from("aé中 .1"), max_size=12), min_size=1, max_size=5))
def test_ngram_counts_of_a_row_are_its_own(texts):
    import pyarrow as pa

    data, offsets = common.text_buffers(pa.array(texts, pa.string()))
    together, letters = language.ngram_counts(data, offsets, 256)
    for i, t in enumerate(texts):
        alone, n = language.ngram_counts(*common.text_buffers(pa.array([t], pa.string())), 256)
        assert (alone[0] == together[i]).all() and n[0] == letters[i] == sum(c.isalpha() for c in t)


# 4. Near-duplicates


def shingles(text):
    words = [w.lower() for w in re.split("[\x20\x09-\x0d]+", text or "") if w]
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def classes_of(texts, similarity=0.8):
    sets, parent = [shingles(t) for t in texts], list(range(len(texts)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            same = texts[i] is not None and texts[i] == texts[j]
            near = sets[i] and sets[j] and len(sets[i] & sets[j]) >= similarity * len(sets[i] | sets[j])
            if same or near:
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return [root(i) for i in range(len(texts))]


def edited(text, seed, n):
    r, words = np.random.default_rng(seed), text.split()
    for i in r.choice(len(words), n, replace=False):
        words[i] = f"q{seed}x{i}"
    return " ".join(words)


def near_texts():
    base = [sentence(i, 60 + 20 * i) for i in range(6)]
    out = list(base)
    for i, b in enumerate(base):
        out += [b, b.upper()] + [edited(b, 100 * i + k, 1 + k % 4) for k in range(12)]
    return out + ODD


@pytest.mark.parametrize("cap", [16_384, 6])
def test_near_duplicates(spark, cap):
    texts = near_texts()
    found = simhash.near_duplicates(docs(spark, texts), bucket=4, cap=cap).toPandas().sort_values("doc_id")
    assert list(found["class_id"]) == classes_of(texts)
    assert list(found["class_size"]) == [Counter(classes_of(texts))[c] for c in classes_of(texts)]


def test_links_within_a_family_just_under_the_threshold(spark):
    shared = sentence(1, 794)
    texts = [f"{shared} {sentence(1000 + i // 2, 25)} {sentence(2000 + i, 80)}" for i in range(240)]
    sets = [shingles(t) for t in texts]
    near = lambda i, j: len(sets[i] & sets[j]) / len(sets[i] | sets[j])
    assert 0.78 < near(0, 2) < 0.8 < near(0, 1) < 0.84
    # A recall at which no pair should miss all tables: what is lost is lost within a bucket.
    found = simhash.near_duplicates(docs(spark, texts), recall=0.99999).toPandas().sort_values("doc_id")
    classes = list(found["class_id"])
    assert classes == [i // 2 * 2 for i in range(240)], sum(c != i // 2 * 2 for i, c in enumerate(classes))


def test_all_pairs_within_the_limit_are_compared():
    r = np.random.default_rng(2)
    prints = r.integers(0, 1 << 63, (40, 4), dtype=np.uint64)[r.integers(0, 40, 1500)]
    for word in range(4):  # some bits apart, under and over the limit
        prints[:, word] ^= r.integers(0, 1 << 13, 1500, dtype=np.uint64)
    apart = np.bitwise_count(prints[:, None] ^ prints[None]).sum(axis=2)
    limit = simhash.max_distance(0.8)
    near = (apart <= limit) & (np.bitwise_count(prints[:, None, 0] ^ prints[None, :, 0]) <= simhash.max_distance(0.8, 64))
    for half in (np.zeros(1500, dtype=int), r.integers(0, 2, 1500)):
        found = [(i, j) for a, b in simhash._near(prints, half, 0.8) for i, j in zip(a.tolist(), b.tolist())]
        want = {(i, j) for i, j in np.argwhere(near).tolist() if i < j and (half[i] != half[j] or not half.any())}
        assert len(found) == len(set(found)) and set(found) == want


@settings(deadline=None)
@given(st.sets(st.integers(0, 400), min_size=1, max_size=60), st.sets(st.integers(0, 400), min_size=1, max_size=60))
def test_parity_bitmaps_never_say_too_much(a, b):
    grams = common.mix(np.array([*a, *b], dtype=np.uint64))
    x, y = simhash.parities(grams, np.array([0, len(a), len(a) + len(b)]))
    assert np.bitwise_count(x ^ y).sum() <= len(a ^ b)
    if len(a & b) >= 0.8 * len(a | b):
        assert len(a ^ b) <= simhash.max_difference(np.array([len(a)]), np.array([len(b)]), 0.8)[0]


def test_verified_classes():
    r = np.random.default_rng(4)
    base = [r.integers(0, 1 << 40, 50) for _ in range(6)]
    sets = [np.unique(np.concatenate((base[k % 6][r.random(50) < 0.97], r.integers(0, 1 << 40, k % 4)))).astype(np.uint64) for k in range(70)]
    for half in (np.zeros(70, dtype=int), r.integers(0, 2, 70)):
        parent = list(range(70))
        for i in range(70):
            for j in range(i):
                both = len(set(sets[i].tolist()) & set(sets[j].tolist()))
                if both >= 0.8 * (len(sets[i]) + len(sets[j]) - both) and (half[i] != half[j] or not half.any()):
                    a, b = sorted((parent[i], parent[j]))
                    parent = [a if x == b else x for x in parent]
        assert list(simhash.verified_classes(sets, half, 0.8)) == parent and len(set(parent)) < 40


@pytest.mark.parametrize(("n", "options"), [(60, {}), (200, {}), (600, {}), (200, {"bucket": 4, "cap": 20, "block_mass": 15_000})])
def test_dense_families(spark, n, options):
    """Texts that each have 4 of 300 words of one base changed: few of their pairs are links, and most texts of a large family are joined."""
    base = sentence(77, 300)
    texts = [edited(base, 500 + i, 4) for i in range(n)]
    found = simhash.near_duplicates(docs(spark, texts), **options).toPandas().sort_values("doc_id")
    want = classes_of(texts)
    assert list(found["class_id"]) == want and len(set(want)) < n


def test_ids_that_repeat_with_other_texts(spark):
    a, b = sentence(1, 60), sentence(2, 60)
    rows = [(5, a), (5, b), (7, edited(b, 3, 1)), (None, a), (None, sentence(3, 60)), (None, sentence(4, 60)), (9, sentence(5, 60)), (9, sentence(5, 60))]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    kept = sorted((r["doc_id"] or 0, r["text"]) for r in simhash.keep_one(frame).collect())
    assert kept == sorted([(5, a), (5, b), (0, sentence(3, 60)), (0, sentence(4, 60)), (9, sentence(5, 60))])


def test_large_sides_are_joined_by_shuffles(spark, monkeypatch):
    texts = near_texts()
    monkeypatch.setattr(common, "MAX_BROADCAST_BYTES", 0)
    found = simhash.near_duplicates(docs(spark, texts), bucket=4, cap=6).toPandas().sort_values("doc_id")
    assert list(found["class_id"]) == classes_of(texts)
    texts = ["\n".join([sentence(50 + i, 5), sentence(1, 6), sentence(2, 6), sentence(3, 6), sentence(90 + i, 5)]) for i in range(8)]
    found = {r["doc_id"]: r["text"] for r in lines.dedup_lines(docs(spark, texts)).collect()}
    assert found == deduped(list(enumerate(texts)))
    benchmark = spark.createDataFrame([(1, sentence(1, 30))], "item_id long, text string")
    texts = [sentence(9, 50), f"{sentence(4, 50)} {sentence(1, 30)} {sentence(5, 50)}"]
    assert [r["doc_id"] for r in decontaminate.contaminated(docs(spark, texts), benchmark).collect()] == [1]


def test_keep_one(spark):
    texts = near_texts()
    twice = docs(spark, texts).union(docs(spark, texts))
    kept = [r["doc_id"] for r in simhash.keep_one(twice).collect()]
    nulls = [i for i, t in enumerate(texts) if t is None]
    assert sorted(kept) == sorted([*{*classes_of(texts)}, *nulls])
    assert simhash.near_duplicates(docs(spark, [])).count() == 0


def test_components(spark):
    r = np.random.default_rng(5)
    edges = [(f"{a:03d}", f"{b:03d}") for a, b in r.integers(0, 150, (120, 2))] + [(f"{i:03d}", f"{i + 1:03d}") for i in range(200, 260)]
    parent = {x: x for e in edges for x in e}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    found = {x["node"]: x["root"] for x in simhash.components(spark.createDataFrame(edges, "a string, b string")).collect()}
    assert {x: found.get(x, x) for x in parent} == {x: root(x) for x in parent}


# 5. Nearest neighbours


def nearest_by_brute_force(rows, k):
    fine = [(i, np.array(v, dtype=float)) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = {}
    for q, v in fine:
        if q % 50 == 0:
            scored = sorted((-(v @ w) / (np.linalg.norm(v) * np.linalg.norm(w)), i) for i, w in fine if i != q)
            out[q] = scored[:k]
    return out


def vectors(n):
    r = np.random.default_rng(3)
    rows = [(i, [float(x) for x in r.normal(size=8) + 3 * (i % 5 == np.arange(8))]) for i in range(n)]
    rows[7] = (7, rows[11][1])
    rows += [(1000, None), (1050, [0.0] * 8), (1001, [float("nan")] * 8), (1002, [float("inf")] + [1.0] * 7), (None, [1.0] * 8), (1003, [None] + [1.0] * 7)]
    return rows


def test_exact_search(spark):
    rows = vectors(400)
    frame = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, embedding array<double>, shard int, rank int")
    found = vptree.nearest(frame, frame.filter("vec_id % 50 = 0"), shard_rows=90, block_rows=3).toPandas()
    want = nearest_by_brute_force(rows, 5)
    assert set(found["query_id"]) == set(want)
    for q, g in found.sort_values("rank").groupby("query_id"):
        assert list(g["vec_id"]) == [i for _, i in want[q]] and np.allclose(g["score"], [-s for s, _ in want[q]])
    few = frame.filter("vec_id < 3")
    assert vptree.nearest(few, few.filter("vec_id = 0")).count() == 2
    assert vptree.nearest(frame.limit(0), frame.limit(0)).count() == 0


def test_nearest_orders_by_exact_cosines(spark):
    near = [1.0, 1e-5, 0.0]
    rows = [(0, [1.0, 0.0, 0.0]), (7, [1.0, 1.5e-5, 0.0]), (9, near), (12, near), (3, [0.0, 1.0, 0.0])]
    rows += [(50, [1e200, 1e200, 0.0]), (51, [1.0, 1.0, 0.0]), (52, [1e-200, 2e-200, 0.0]), (100, [1.0, 2.0]), (101, [2.0, 1.0]), (102, []), (150, [1.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = {}
    for r in vptree.nearest(frame, frame.filter("vec_id % 50 = 0"), k=2).collect():
        found.setdefault(r["query_id"], {})[r["rank"]] = (r["vec_id"], round(r["score"], 11))
    assert found == {0: {1: (9, 0.99999999995), 2: (12, 0.99999999995)}, 50: {1: (51, 1.0), 2: (52, round(3 / 10**0.5, 11))}, 100: {1: (101, 0.8)}}
    one = {r["query_id"]: r["vec_id"] for r in vptree.nearest(frame, frame.filter("vec_id = 0"), k=1).collect()}
    assert one == {0: 9}


def test_relaxed_search_finds_most():
    r = np.random.default_rng(0)
    centres = r.normal(size=(40, 16)) * 4
    v = centres[r.integers(0, 40, 4000)] + r.normal(size=(4000, 16))
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    ids, asked = np.arange(4000), np.arange(0, 4000, 50)
    tree = vptree.build(unit, leaf=32)
    exact, _ = vptree.search(tree, v, unit, ids, v[asked], asked, 5)
    brute = np.argsort(-(unit[asked] @ unit.T) + 9 * (asked[:, None] == ids), axis=1, kind="stable")[:, :5]
    assert [set(a) for a in exact] == [set(b) for b in brute]
    loose, _ = vptree.search(tree, v, unit, ids, v[asked], asked, 5, factor=1.5)
    assert np.mean([len(set(a) & set(b)) / 5 for a, b in zip(loose, brute)]) >= 0.9


# 7. Line dedup


def deduped(rows):
    """Brute force: chunks of lines in all chunkings, and the first place of each that repeats."""
    digest = lambda s: hashlib.md5(s.encode()).hexdigest()
    seen = {}
    for i, t in rows:
        ls = t.split("\n")
        rolled = [digest("".join(digest(x) for x in ls[max(0, k - lines.WINDOW + 1) : k + 1])) for k in range(len(ls))]
        spans = set()
        for c in range(lines.CHUNKINGS):
            v, first = [x[lines.DIGITS * c : lines.DIGITS * (c + 1)] for x in rolled], 0
            for k in range(len(ls)):
                if k == len(ls) - 1 or (1 <= k <= len(ls) - 3 and v[k] < v[k - 1] and v[k] <= v[k + 1]):
                    spans.add((first, k + 1))
                    first = k + 1
        for a, b in spans:
            if b - a >= lines.MIN_LINES and "".join(ls[a:b]).strip():
                seen.setdefault("\n".join(ls[a:b]), []).append((i, a, b))
    gone = {(i, k) for places in seen.values() for i, a, b in sorted(places)[1:] for k in range(a, b)}
    return {i: "\n".join(x for k, x in enumerate(t.split("\n")) if (i, k) not in gone) for i, t in rows}


def test_line_dedup(spark):
    block = [sentence(i, 6) for i in range(12)]
    texts = ["\n".join([sentence(50 + i, 5), *block[i % 3 :], sentence(90 + i, 5)]) for i in range(8)] + ["\n\n\n\n", "\n\n\n\n", "a\n" * 400, "", None, "one line", "one line"]
    found = {r["doc_id"]: r for r in lines.dedup_lines(docs(spark, texts)).collect()}
    want = deduped([(i, t) for i, t in enumerate(texts) if t is not None])
    assert {i: r["text"] for i, r in found.items() if r["text"] is not None} == want
    assert found[texts.index(None)]["text"] is None and found[0]["block"] == "b" and sum(r["__dl_removed"] for r in found.values()) > 30
    assert all(r["__dl_lines"] - r["__dl_removed"] == (0 if r["text"] is None or (r["__dl_removed"] and not r["text"]) else r["text"].count("\n") + 1) for r in found.values())
    assert lines.dedup_lines(docs(spark, [])).count() == 0


def test_line_dedup_of_repeated_rows_and_ids(spark):
    a, b = "\n".join(sentence(i, 5) for i in range(4)), "\n".join(sentence(i, 5) for i in range(10, 14))
    rows = [(1, a), (1, a), (1, b), (2, a), (None, b), (None, None)]
    found = sorted(((r["doc_id"], r["text"]) for r in lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)
    assert found == sorted([(1, a), (1, a), (1, ""), (2, ""), (None, b), (None, None)], key=str)


def test_line_dedup_where_hashes_collide(spark, monkeypatch):
    from pyspark.sql import functions as F

    whole = lines.chunks
    monkeypatch.setattr(lines, "chunks", lambda *a: F.transform(whole(*a), lambda x: F.struct(x["first"], x["lines"], F.lit(1).cast("long").alias("h"))))
    texts = ["\n".join(sentence(i % 4 * 10 + k, 5) for k in range(4)) for i in range(9)]
    found = {r["doc_id"]: r["text"] for r in lines.dedup_lines(docs(spark, texts)).collect()}
    assert found == deduped(list(enumerate(texts)))


def test_most_repeated_passages_of_lines_go(spark):
    """Passages of 2 to 6 lines, each in two documents among lines of their own; no line is lost altogether."""
    texts, planted = [], 0
    for i in range(120):
        passage = [sentence(5000 + i // 2 * 10 + k, 5) for k in range(2 + i // 2 % 5)]
        planted += len(passage) if i % 2 else 0
        texts.append("\n".join([*(sentence(10_000 + 20 * i + k, 5) for k in range(5)), *passage, *(sentence(20_000 + 20 * i + k, 5) for k in range(5))]))
    found = {r["doc_id"]: r["text"] for r in lines.dedup_lines(docs(spark, texts)).collect()}
    assert found == deduped(list(enumerate(texts)))
    removed = sum(t.count("\n") - found[i].count("\n") for i, t in enumerate(texts))
    assert 0.6 * planted < removed <= planted
    assert {x for t in texts for x in t.split("\n")} == {x for t in found.values() for x in t.split("\n")}


# 8. Packing


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from("aA'sStre ve.,!é É0 12ßÑ́Å İIſK中😀\t\n\xa0　ǅﬁ<|>_Σ\x1c"), max_size=24))
def test_tokens_are_the_tokenizers(text):
    tokens = packing._tokens(TOKENIZER)
    assert np.frombuffer(tokens.encode(text), dtype="<u4").tolist() == tokens.tokenizer.encode(text, add_special_tokens=False).ids


def test_tokens_of_characters_that_tables_disagree_on():
    tokens = packing._tokens(TOKENIZER)
    for text in ("\u0558", "a\u0558b c", "x \u0378\u0379, \u0530z", "plain \u0558"):
        assert np.frombuffer(tokens.encode(text), dtype="<u4").tolist() == tokens.tokenizer.encode(text, add_special_tokens=False).ids


@settings(deadline=None, max_examples=60)
@given(st.lists(st.integers(1, 24), max_size=60))
def test_plan_places_all(lengths):
    counts = np.bincount(np.array(lengths, dtype=int), minlength=25)
    plan, n = packing.plan_packing(counts, 24)
    held, numbers = Counter(), {x: set() for x in range(25)}
    spans = {}
    for x, first, sequences, each, sequence, offset in zip(*(plan[k] for k in ("length", "first", "sequences", "each", "sequence", "offset"))):
        for i in range(sequences * each):
            numbers[x].add(first + i)
            s = sequence + i // each
            held[s] += x
            spans.setdefault(s, []).append((offset + (i % each) * x, x))
    assert all(numbers[x] == set(range(counts[x])) for x in range(25))
    assert set(held) == set(range(n)) and all(v <= 24 for v in held.values())
    for own in spans.values():
        end = 0
        for at, x in sorted(own):
            assert at == end
            end += x
    assert n <= sum(lengths) / 12 + 1


def test_exact_complements_fill_sequences():
    counts = np.zeros(101, dtype=int)
    for x in (70, 30, 60, 25, 15, 50, 20, 20, 10):
        counts[x] += 1
    assert packing.plan_packing(counts, 100)[1] == 3


def test_packing(spark):
    texts = [sentence(i, 1 + 7 * i) for i in range(30)] + ODD
    found = packing.pack_documents(docs(spark, texts), TOKENIZER, 256).toPandas()
    tokenizer = packing._tokens(TOKENIZER).tokenizer
    for i, t in enumerate(texts):
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1]
        own = found[found["doc_id"] == i].sort_values("piece")
        assert list(own["start"]) == list(range(0, len(ids), 256))
        for p in own.itertuples():
            part = np.array(ids[p.start : p.start + 256], dtype="<u4")
            assert p.length == len(part) and p.ids_crc32 == zlib.crc32(part.tobytes())
    for _, g in found.sort_values("offset").groupby("sequence_id"):
        assert list(g["offset"]) == [0, *g["length"].cumsum()[:-1]] and g["length"].sum() <= 256
    assert found["sequence_id"].nunique() <= found["length"].sum() / 256 + 2
    assert packing.pack_documents(docs(spark, []), TOKENIZER).count() == 0


# 9. Licences


def test_licenses(spark):
    texts = ["Intro\nReleased under the MIT License!\nend", "Licensed under the Apache License, version 2.0", "released under the mit licence", None, "", "\n\n", "All rights reserved.", "All rights reserved."]
    found = sorted((r["doc_id"], r["line"], r["license"], round(r["dice"], 3)) for r in licenses.scan_licenses(docs(spark, texts)).collect())
    assert found == [(0, -1, "mit", 0.8), (0, 1, "mit", 1.0), (1, 0, "apache-2.0", 1.0), (6, 0, "all-rights-reserved", 1.0), (7, 0, "all-rights-reserved", 1.0)]
    assert licenses.scan_licenses(docs(spark, [])).count() == 0
    assert licenses.scan_licenses(docs(spark, texts), {"none": ""}).count() == 0


def test_licenses_of_rows_that_share_an_id_and_of_wrapped_notices(spark):
    notice = licenses.TEMPLATES["mit-grant"].split()
    wrapped = "\n".join(["# code", "", *(" * " + " ".join(notice[i : i + 9]) for i in range(0, len(notice), 9)), "", sentence(1, 80), sentence(2, 80)])
    rows = [(1, "Released under the MIT License."), (1, "All rights reserved."), (1, "All rights reserved."), (None, "Licensed under CC BY 4.0."), (None, "Licensed under CC BY-NC 4.0."), (2, wrapped), (3, "x " * 100_000)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    found = [(r["doc_id"], r["line"], r["lines"], r["license"]) for r in licenses.scan_licenses(frame).collect()]
    want = [(1, 0, 1, "mit"), (1, 0, 1, "all-rights-reserved"), (1, 0, 1, "all-rights-reserved"), (None, 0, 1, "cc-by-4.0"), (None, 0, 1, "cc-by-nc-4.0"), (2, 2, -(-len(notice) // 9), "mit-grant")]
    assert sorted(found, key=str) == sorted(want, key=str)


@settings(deadline=None)
@given(st.integers(1, 300), st.integers(1, 300), st.integers(0, 300))
def test_size_bounds_lose_nothing(a, b, both):
    both = min(both, a, b)
    lo, hi = licenses.size_bounds(b, licenses.THRESHOLD)
    assert 2 * both / (a + b) < licenses.THRESHOLD or lo <= a <= hi


# 10. Substrings


def kept_by_brute_force(texts, window):
    own = [[w for w in re.split("[\x20\x09-\x0d]+", t or "") if w] for t in texts]
    seen = Counter(tuple(w[i : i + window]) for w in own for i in range(len(w) - window + 1))
    out = []
    for w in own:
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                gone[i : i + window] = [True] * window
        out.append((len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g)))
    return out


def repeat_texts():
    a, b = sentence(1, 60), sentence(2, 50)
    loop = " ".join(["x", "y", "z"] * 20)
    return [f"{sentence(3, 20)} {a} {sentence(4, 9)}", f"{a}\n{b}", f"p  q {b}\t{sentence(5, 70)} ", a[: len(a) // 2], f"{b} {b}", loop, sentence(6, 40), sentence(6, 40), *ODD]


@pytest.mark.parametrize(("window", "hot"), [(35, 20_000), (8, 20_000), (5, 1)])
def test_repeats(spark, window, hot):
    texts = repeat_texts()
    found = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_text"]) for r in substrings.remove_repeats(docs(spark, texts), window, hot_contexts=hot).collect()}
    assert [found[i] for i in range(len(texts))] == kept_by_brute_force(texts, window)


def test_repeats_in_many_edge_cases(spark):
    r = np.random.default_rng(9)
    texts = [" ".join(r.choice(list("abc"), r.integers(0, 60))) for _ in range(60)]
    found = substrings.remove_repeats(docs(spark, texts), 9).collect()
    want = kept_by_brute_force(texts, 9)
    assert all((x["n_words"], x["n_removed"], x["kept_text"]) == want[x["doc_id"]] and x["kept_sha256"] == hashlib.sha256(x["kept_text"].encode()).hexdigest() for x in found)
    same = spark.createDataFrame([(1, sentence(1, 40))] * 2, "doc_id long, text string")
    assert [x["n_removed"] for x in substrings.remove_repeats(same).collect()] == [40, 40]
    assert substrings.remove_repeats(docs(spark, [])).count() == 0


@settings(deadline=None)
@given(st.lists(st.lists(st.sampled_from("abc"), max_size=12), min_size=1, max_size=4), st.lists(st.sampled_from("abcd"), max_size=20))
def test_matching_statistics(reference, sequence):
    automaton = substrings.SuffixAutomaton()
    for text in reference:
        automaton.add(text)
    known = {tuple(t[i:j]) for t in reference for i in range(len(t)) for j in range(i, len(t) + 1)} | {()}
    assert automaton.matching_statistics(sequence) == [max(n for n in range(e + 2) if tuple(sequence[e + 1 - n : e + 1]) in known) for e in range(len(sequence))]


def test_reference_spans(spark):
    a = sentence(1, 60)
    reference = spark.createDataFrame([(a,), (None,), (sentence(8, 50),)], "text string")
    found = {r["doc_id"]: (r["n_removed"], r["kept_text"]) for r in substrings.remove_reference_spans(docs(spark, [f"u {a} v", sentence(2, 90), None]), reference).collect()}
    assert found == {0: (60, "u v"), 1: (0, sentence(2, 90)), 2: (0, "")}
    with pytest.raises(ValueError, match="words"):
        substrings.remove_reference_spans(docs(spark, [a]), reference, max_words=20)
