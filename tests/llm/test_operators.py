"""Each operator against a brute-force version, an exact round trip or held-out accuracy."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from quillgraph.llm import decontamination, language, linededup, packing, passages, pii, sharding, simhash, spotsigs, toxicity
from quillgraph.functions.components import connected_components


def components(nodes, links):
    parent = {n: n for n in nodes}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def brute_fingerprint(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode()))
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [b" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s, seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_components_of_a_long_chain(spark):
    edges = spark.range(300).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    got = connected_components(edges, "a", "b").collect()
    assert len(got) == 301 and {r.label for r in got} == {0}


def test_simhash_groups(spark, docs):
    rows = {r.doc_id: r.text for r in docs.collect()}
    prints = {i: brute_fingerprint(t) for i, t in rows.items()}
    ids = sorted(prints)
    want = components(ids, [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if (prints[a] ^ prints[b]).bit_count() <= 2])
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_duplicate_groups(docs).collect()}
    assert got == {i: (f"{prints[i]:016x}", want[i]) for i in ids}


@pytest.mark.parametrize("hot", [0, 5, 1000])
def test_simhash_pairs_of_crowded_fingerprints(spark, monkeypatch, hot):
    monkeypatch.setattr(simhash, "HOT_BUCKET", hot)
    rng = random.Random(3)
    prints = set()
    for _ in range(6):
        centre = rng.getrandbits(64)
        for _ in range(40):
            f = centre
            for _ in range(rng.randint(0, 4)):
                f ^= 1 << rng.randrange(64)
            prints.add(f)
    signed = sorted(f - (1 << 64) if f >> 63 else f for f in prints)
    want = components(signed, [(a, b) for k, a in enumerate(signed) for b in signed[k + 1 :] if ((a ^ b) % (1 << 64)).bit_count() <= 2])
    pairs = simhash.near_pairs(spark.createDataFrame([(f,) for f in signed], "fp long")).collect()
    assert all(((r.a ^ r.b) % (1 << 64)).bit_count() <= 2 for r in pairs)
    assert components(signed, [(r.a, r.b) for r in pairs]) == want


def test_one_row_of_each_simhash_group_stays(spark):
    long = "one two three four five six seven eight nine ten eleven twelve"
    rows = [(5, long, "a"), (3, long, "b"), (3, long, "a"), (3, "another text of its own words here", "c"), (4, "", "d"), (7, None, "e"), (None, long, "f"), (9, long + " x", "g")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, label string")
    got = sorted(simhash.keep_first_of_group(docs).collect(), key=str)
    assert {(r.doc_id, r.text) for r in got} == {(3, long), (3, rows[3][1]), (4, ""), (None, long), (9, long + " x")} and len(got) == 5
    assert sorted(simhash.keep_first_of_group(docs.orderBy("label").repartition(3)).collect(), key=str) == got
    assert simhash.simhash(long, 5) == simhash.simhash(long.upper(), 5) != simhash.simhash(long, 3)


def test_shards_by_key(spark, docs):
    got = sharding.shard_documents(docs).toPandas()
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    assert len(got) == len(texts) and set(got["law"]) == {"key"}
    for r in got.itertuples():
        raw = texts[r.doc_id].encode()
        assert (r.size, r.text_crc32) == (len(raw) + 16, zlib.crc32(raw))
    assert (got[got["grown_shard"] != got["shard"]]["grown_shard"] == 40).all() and got["shard"].between(0, 39).all()
    for _, part in got.groupby("shard"):
        assert sorted(part["slot"]) == list(range(len(part)))


def test_shards_equal_the_highest_hash(spark, docs):
    def h(key, shard):
        v = xxhash.xxh64_intdigest(int(shard).to_bytes(4, "little", signed=True), xxhash.xxh64_intdigest(int(key).to_bytes(8, "little", signed=True), 42))
        return v - (1 << 64) if v >> 63 else v

    for r in sharding.shard_documents(docs).collect():
        assert r.shard == max(range(40), key=lambda s: (h(r.doc_id, s), -s)) and r.grown_shard == max(range(41), key=lambda s: (h(r.doc_id, s), -s))
    weights = [1.0, 3.0, 0.5]
    score = lambda key, s, w: -w / np.log(((h(key, s) % (1 << 64) >> 12) + 0.5) / 2**52)
    for r in sharding.weighted_shards(docs, weights).collect():
        assert r.shard == max(range(3), key=lambda s: score(r.doc_id, s, weights[s]))
        assert r.grown_shard in (r.shard, 3)
    narrow = docs.withColumn("doc_id", F.col("doc_id").cast("int"))
    assert {tuple(r) for r in sharding.shard_documents(narrow).collect()} == {tuple(r) for r in sharding.shard_documents(docs).collect()}


def test_many_copies_of_a_row_get_slots(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(sharding, "_SPREAD", 7)
    rows = spark.range(100).select(F.lit(1).alias("s"), (F.col("id") % 2).alias("x"))
    got = sharding.assign_slots(rows, "s", ["x"]).collect()
    assert sorted(r.slot for r in got) == list(range(100))
    docs = spark.createDataFrame([(1, "a", 9), (None, None, 9), (1, "a", 9)], "doc_id long, text string, shard int")
    sharding.write_shards(docs, sharding.rendezvous_shard(F.col("doc_id"), 3), str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert sorted((r.doc_id or 0, r.text or "") for r in back.collect()) == [(0, ""), (1, "a"), (1, "a")]


def test_weighted_shards_follow_their_weights(spark):
    n = spark.range(20_000).select(sharding.rendezvous_shard(F.col("id"), 3, [1.0, 2.0, 1.0]).alias("s")).groupBy("s").count().collect()
    share = {r.s: r["count"] / 20_000 for r in n}
    assert share[1] == pytest.approx(0.5, abs=0.02) and share[0] == pytest.approx(0.25, abs=0.02)


def test_decontamination_finds_passages_with_few_edits(spark):
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8))) for _ in range(400)]
    item = " ".join(rng.choice(words) for _ in range(60))
    filler = lambda n: " ".join("".join(rng.choice("klmnopqrst") for _ in range(5)) for _ in range(n))
    edited = list(item)
    for k in range(10, len(edited), 40):
        edited[k] = "Z"
    texts = [filler(50) + " " + item.upper() + "!! " + filler(30), filler(80), filler(5) + "".join(edited) + filler(5), item[:40], " | ".join(item.split()), None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame([(7, item), (8, "tiny"), (None, item), (9, None)], "item_id long, text string")
    got = decontamination.find_contamination(docs, bench).collect()
    assert {(r.doc_id, r.item_id) for r in got} == {(0, 7), (2, 7), (4, 7)}
    first = next(r for r in got if r.doc_id == 0)
    assert texts[0][first.start : first.end] == item.upper() and first.edits == 0
    assert {r.doc_id for r in decontamination.drop_contaminated(docs, bench).collect()} == {1, 3, 5, 6}


def test_decontamination_blocks_equal_one_index(spark, docs, sf, monkeypatch):
    bench = spark.read.parquet(f"{sf}/benchmark.parquet")
    want = {tuple(r) for r in decontamination.find_contamination(docs, bench).collect()}
    monkeypatch.setattr(decontamination, "BLOCK_LETTERS", 3000)
    assert want and {tuple(r) for r in decontamination.find_contamination(docs, bench).collect()} == want


def least_edits_anywhere(p, t):
    row = [0] * (len(t) + 1)
    for i, x in enumerate(p, 1):
        new = [i]
        for j, y in enumerate(t, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return min(row)


@pytest.mark.parametrize("letters", ["ab", "abcdefgh"])
def test_decontamination_equals_aligning_every_window(letters):
    rng = random.Random(len(letters))
    some = lambda n: "".join(rng.choice(letters) for _ in range(n))
    items = {k: some(n) for k, n in enumerate((12, 30, 80, 95, 130, 70))}
    items[9] = "0" * 60
    rows = [(k, decontamination.letters(t)[0]) for k, t in items.items()]
    index = decontamination.build_index(rows)
    windows = {(k, a): t[a : a + decontamination.WINDOW] for k, t in items.items() for a in decontamination.window_starts(len(t))}
    for n in range(30):
        parts = [some(rng.randint(0, 40))]
        for _ in range(2):
            t = items[rng.choice(list(items))]
            cut = rng.randint(0, len(t) // 3)
            t = list(t[cut : cut + rng.randint(len(t) // 2, len(t))])
            for _ in range(rng.randint(0, 8)):
                at = rng.randrange(len(t))
                t[at : at + rng.randint(0, 1)] = rng.choice(["", "z", "q"])
            parts += ["".join(t), some(rng.randint(0, 30))]
        text = ("0" * 300 if n == 3 else "") + " ".join(parts)
        folded = text.replace(" ", "")
        want = {}
        for (k, a), w in windows.items():
            d = least_edits_anywhere(w, folded)
            if d <= decontamination.edit_budget(len(w)):
                want.setdefault(k, []).append(d)
        got = {m[0]: (m[3], m[4]) for m in decontamination.matches(text, index)}
        assert got == {k: (min(v), len(v)) for k, v in want.items()}


def test_every_fragment_of_an_item_is_found():
    rng = random.Random(8)
    item = "".join(rng.choice("abcdefghij") for _ in range(326))
    index = decontamination.build_index([(1, decontamination.letters(item)[0])])
    for a in range(len(item) - decontamination.FRAGMENT + 1):
        assert decontamination.matches("x y " + item[a : a + decontamination.FRAGMENT] + " z", index)


def test_repeated_letters_take_bounded_memory():
    import tracemalloc

    index = decontamination.build_index([(1, decontamination.letters("0" * 300)[0])])
    tracemalloc.start()
    assert decontamination.matches("0" * 80_000, index)
    assert tracemalloc.get_traced_memory()[1] < 400e6
    tracemalloc.stop()


def test_banded_alignment_equals_full_table():
    rng = random.Random(1)
    for _ in range(300):
        p = np.array([rng.randrange(3) for _ in range(rng.randint(3, 14))])
        t = np.array([rng.randrange(3) for _ in range(rng.randint(0, 20))])
        row = [0] * (len(t) + 1)
        for i, x in enumerate(p, 1):
            new = [i]
            for j, y in enumerate(t, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
            row = new
        got = decontamination.banded_alignment(p, t, -len(p), len(t), 3)
        assert (got[0] if got else None) == (min(row) if min(row) <= 3 else None)


def test_toxicity_held_out_and_blind_to_held_out_labels(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    got = toxicity.score_documents(docs, labels).toPandas().set_index("doc_id")
    truth = labels.toPandas().set_index("doc_id")["toxic"]
    held = {i for i in got.index if zlib.crc32(str(i).encode()) % 3 == 1}
    assert set(got.index[got["held_out"]]) == held and got["score"].between(0, 1).all()
    assert ((got["score"] >= 0.7).astype(int) == got["predicted"]).all()
    known = got.join(truth, how="inner")
    known = known[known["held_out"]]
    hits = known[(known["predicted"] == 1) & (known["toxic"] == 1)]
    assert len(hits) >= 0.7 * (known["toxic"] == 1).sum() and len(hits) >= 0.9 * (known["predicted"] == 1).sum()
    flipped = labels.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    again = toxicity.score_documents(docs, flipped).toPandas().set_index("doc_id")
    assert (again["score"] - got["score"]).abs().max() < 1e-12


def test_label_model_trusts_the_better_voters():
    rng = np.random.default_rng(0)
    y = rng.random(4000) < 0.3
    right = [0.95, 0.9, 0.6, 0.55]
    vote = np.column_stack([np.where(rng.random(4000) < p, y, ~y) * 2 - 1 for p in right])
    vote = np.column_stack([vote, vote[:, 3], vote[:, 3]])
    model = toxicity.fit_label_model(vote, np.where(vote[:, :2].sum(1) > 0, 0.8, 0.2))
    assert model.weight[3] < 0.6 < model.weight[0]
    assert ((model.posterior(vote) > 0.5) == y).mean() > 0.93


def test_label_model_ends_with_its_own_weights():
    rng = np.random.default_rng(5)
    y = rng.random(500) < 0.4
    vote = np.column_stack([np.where(rng.random(500) < p, y, ~y) * 2 - 1 for p in (0.9, 0.8, 0.8)])
    vote = np.column_stack([vote, vote[:, 2]])
    model = toxicity.fit_label_model(vote, np.where(vote[:, 0] > 0, 0.8, 0.2), rounds=200, alone=(0,))
    assert model.weight[0] == 1 and model.weight[2] < 0.7
    post = []
    for row in vote:
        odds = model.prior / (1 - model.prior)
        for j, v in enumerate(row):
            odds *= (model.chance[1, j, v + 1] / model.chance[0, j, v + 1]) ** model.weight[j]
        post.append(odds / (1 + odds))
    assert np.allclose(post, model.posterior(vote))
    # One more M step with these posteriors gives the same chances: the weights are those of the last round.
    post = np.array(post)
    for c, own in ((0, 1 - post), (1, post)):
        for j in range(4):
            want = np.array([own[vote[:, j] == v].sum() for v in (-1, 0, 1)]) + 1
            assert np.allclose(want / want.sum(), model.chance[c, j], atol=1e-3)


def test_classifier_reaches_the_least_loss():
    rng = np.random.default_rng(6)
    x, target = rng.normal(size=(300, 3)), rng.random(300)
    w, mean, scale = toxicity.fit_classifier(x, target, ridge=1.0)
    z = np.column_stack([np.ones(300), (x - mean) / scale])

    def loss(w):
        p = 1 / (1 + np.exp(-z @ w))
        return -(target * np.log(p) + (1 - target) * np.log(1 - p)).sum() + 0.5 * (w[1:] ** 2).sum()

    assert all(loss(w) <= loss(w + 0.01 * d) for d in rng.normal(size=(50, 4)))


def test_packing_round_trip(spark, docs):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(packing.default_vocabulary())
    got = packing.pack_documents(docs, shard_docs=60).toPandas()
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    assert set(got["doc_id"]) == set(texts)
    for i, part in got.groupby("doc_id"):
        ids, at = [*tok.encode(texts[i], add_special_tokens=False).ids, 1], 0
        for r in part.sort_values("start").itertuples():
            assert (r.start, r.doc_tokens) == (at, len(ids))
            assert r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], dtype="<u4").tobytes())
            at += r.length
        assert at == len(ids)
    padding = 0
    for _, part in got.groupby("sequence_id"):
        part = part.sort_values("offset")
        assert list(part["offset"]) == [0, *part["length"].cumsum()[:-1]]
        total = part["length"].sum()
        assert total <= 2048
        padding += 0 if total & (total - 1) == 0 else 2048 - total
    assert padding == 0


def test_packing_is_the_same_for_any_partitioning(spark, docs):
    schema = "doc_id long, text string"
    odd = [(None, "a b c"), (None, "c b a"), (7, "one two"), (7, "two one"), (7, "one two"), (8, None), (8, None), *[(n, "same text here") for n in range(900, 930)]]
    rows = docs.select("doc_id", "text").unionByName(spark.createDataFrame(odd, schema))
    got = []
    for parts in (1, 3, 7):
        order = F.xxhash64("text", "doc_id", F.lit(parts))
        packed = packing.pack_documents(rows.repartition(parts, order).sortWithinPartitions(order), shard_docs=40)
        got.append(Counter(map(tuple, packed.collect())))
    assert got[0] == got[1] == got[2] and got[0]


def test_greedy_fill_equals_the_rule_by_hand():
    """Longest seed first, then unused documents by falling BM25 score that fit; the first too long one is cut to fill up and its rest seeds the next."""
    rng = np.random.default_rng(11)
    tails = [rng.integers(2, 40, size=rng.integers(1, 60)).astype("<u2") for _ in range(80)]
    tails += [tails[0], tails[1], tails[1]]
    window, n = 100, len(tails)
    counts, mean = [Counter(t.tolist()) for t in tails], np.mean([len(t) for t in tails])
    df = Counter(t for c in counts for t in c)

    def score(a, b):
        norm = packing.K1 * (1 - packing.B_LENGTH + packing.B_LENGTH * len(tails[b]) / mean)
        return sum(np.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * counts[b][t] * (packing.K1 + 1) / (counts[b][t] + norm) for t in counts[a] if t in counts[b])

    free, want, rest = set(range(n)), [], None
    while free or rest:
        seed, at = rest or (min(free, key=lambda i: (-len(tails[i]), i)), 0)
        free.discard(seed)
        pieces, room, rest = [(seed, at, len(tails[seed]) - at)], window - len(tails[seed]) + at, None
        over = None
        # Scores are rounded, as sums in another order differ in their last bits; what ties then goes by number.
        for i in sorted(free, key=lambda i: (-round(score(seed, i), 4), i)):
            if not room:
                break
            if len(tails[i]) <= room:
                pieces.append((i, 0, len(tails[i])))
                free.discard(i)
                room -= len(tails[i])
            elif over is None:
                over = i
        if room and over is not None:
            pieces.append((over, 0, room))
            free.discard(over)
            rest = (over, room)
        want.append(pieces)
    got = packing.pack_tails(tails, window=window)
    full = [w for w in want if sum(p[2] for p in w) == window]
    assert got[: len(full)] == full and len(full) >= len(want) - 1


def test_bm25_scores_equal_the_formula():
    rng = np.random.default_rng(3)
    tails = [rng.integers(0, 60, rng.integers(0, 40)).astype("<u2") for _ in range(30)]
    index, mean = packing.Bm25Index(tails), np.mean([len(t) for t in tails])
    for seed in range(30):
        want = np.zeros(30)
        for term in set(tails[seed].tolist()):
            df = sum(term in t for t in tails)
            for d, t in enumerate(tails):
                tf = (t == term).sum()
                want[d] += np.log(1 + (30 - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(t) / mean))
        assert np.allclose(index.scores(seed), want, atol=1e-4)


def test_content_keys_of_a_batch_equal_those_of_each():
    rng = np.random.default_rng(4)
    tails = [rng.integers(0, 500, n).astype("<u2").tobytes() for n in (0, 1, 3, 4, 5, 90, 0, 2000)]
    keys, topics = packing.content_keys(tails)
    for i, t in enumerate(tails):
        assert packing.content_keys([t]) == ([keys[i]], [topics[i]]) and len(keys[i]) == (packing.KEYS if t else 0)


def test_packing_shards_hold_the_close_neighbours(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = packing.pack_documents(docs, shard_docs=100)
    got = got.where("start + length = doc_tokens").select("doc_id", F.shiftright("sequence_id", 32).alias("shard"))
    shard = {r.doc_id: r.shard for r in got.collect()}
    rows = sorted((r.doc_id, r.text) for r in docs.collect())
    raw = packing.token_bytes(pa.array([t for _, t in rows]), packing.default_vocabulary())
    tails = [np.frombuffer(ids[len(ids) // 4096 * 4096 :], "<u2") for ids in raw]
    sizes = np.bincount(list(shard.values()))
    assert sizes.max() == 100 and (sizes == 100).sum() >= len(sizes) - 1
    runs = [{t[k : k + 4].tobytes() for k in range(max(1, len(t) - 3))} for t in tails]
    holders = defaultdict(set)
    for i, own in enumerate(runs):
        for run in own:
            holders[run].add(i)
    close = same = 0
    for i, own in enumerate(runs):
        for k in set().union(*(holders[run] for run in own)) - {i}:
            if 2 * len(own & runs[k]) >= len(own | runs[k]) and len(tails[k]) > 1:
                close += 1
                same += shard[rows[i][0]] == shard[rows[k][0]]
    assert close > 50 and same >= 0.9 * close, (same, close)


def test_other_vocabularies_are_encoded_whole():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    tok = Tokenizer.from_file(path)
    texts = ["Ab cd  ef.", "", None]
    for t, raw in zip(texts, packing.token_bytes(pa.array(texts, pa.string()), path)):
        assert np.frombuffer(raw, "<u2").tolist() == [*tok.encode(t or "", add_special_tokens=False).ids, 1]


def test_packing_takes_lexical_neighbours():
    a, b = np.arange(100, 400, dtype="<u2"), np.arange(5000, 5300, dtype="<u2")
    tails = [a, b, a[10:], b[5:], a[20:], b[9:]]
    windows = packing.pack_tails(tails, window=900)
    assert {d for d, _, _ in windows[0][:3]} == {0, 2, 4}


def test_words_have_the_ids_of_the_whole_text():
    from tokenizers import Tokenizer

    path = packing.default_vocabulary()
    tok = Tokenizer.from_file(path)
    texts = ["É. Straße, İx, Σας. don't, it's. a.b, x!., 'S. ñ. ª. µ <|endoftext|> <|EndOfText|>", "é. Å, \x1cz a\x1cb", "", None, "， 日本。 ab cd, x.", " lead\n\ntail 　x\x85y "]
    for t, raw in zip(texts, packing.token_bytes(pa.array(texts), path)):
        assert np.frombuffer(raw, "<u2").tolist() == [*tok.encode(t or "", add_special_tokens=False).ids, 1]


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def varied(rng, n, least, most, letters="abc"):
    out = set()
    for _ in range(n):
        a = [rng.choice(letters) for _ in range(rng.randint(least, most))]
        for _ in range(rng.randint(0, 3)):
            out.add("".join(a))
            k = rng.randrange(len(a))
            a[k : k + 1] = rng.choice([[], [rng.choice(letters)], [a[k], rng.choice("xyz")]])
            a = a or ["a"]
    return sorted(out)


@pytest.mark.parametrize("edits", [1, 2, 3])
def test_near_lines_equal_all_pairs(spark, edits):
    lines = [w for w in varied(random.Random(edits), 160, 6, 14) if len(w) > edits]
    want = {(a, b): d for i, a in enumerate(lines) for b in lines[i + 1 :] if abs(len(a) - len(b)) <= edits and (d := edit_distance(a, b)) <= edits}
    got = {(r.a, r.b): r.distance for r in linededup.near_lines(spark.createDataFrame([(w,) for w in lines], "line string"), edits).collect()}
    assert got == want


def test_line_dedup_equals_brute_force(spark):
    rng = random.Random(9)
    pool = [w for n, m in ((8, 14), (16, 24), (26, 34), (38, 46)) for w in varied(rng, 12, n, m, "abcdefg 12") if w == w.strip()] + ["short"]
    texts = ["\n".join(rng.choice(pool) for _ in range(rng.randint(1, 6))) for _ in range(40)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    first = {}
    for i, t in enumerate(texts):
        for k, line in enumerate(t.split("\n")):
            if line.strip():
                first.setdefault(line, (i, k))
    numbers = lambda a: re.sub("[^0-9]", "", a)
    late = {a for a in first for b in first if first[b] < first[a] and numbers(a) == numbers(b) and edit_distance(a, b) <= min(2, min(len(a), len(b)) // 20)}
    assert len(late) > 5
    gone = {i: [k for k, line in enumerate(t.split("\n")) if line.strip() and (first[line] != (i, k) or line in late)] for i, t in enumerate(texts)}
    got = {r.doc_id: r.removed_lines for r in linededup.line_duplicates(docs).collect()}
    assert got == gone
    kept = {r.doc_id: (r.text, r.n_chars) for r in linededup.remove_duplicate_lines(docs).collect()}
    for i, t in enumerate(texts):
        want = "\n".join(line for k, line in enumerate(t.split("\n")) if k not in gone[i])
        assert kept[i] == (want, len(want))


def test_lines_that_differ_in_a_number_stay(spark):
    lines = ["Chapter 11", "Chapter 12", "Invoice 2020-01-01", "Invoice 2020-02-03", "+44 1234567", "+44 1234589", "The total of invoice 2020-01-01 is due on receipt", "The total of invoice 2020-01-02 is due on receipt", "The total of invoice 2020-01-01 is due on reciept."]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(lines)], "doc_id long, text string, lang string, source string, n_chars long")
    assert {r.doc_id for r in linededup.line_duplicates(docs).collect() if r.removed_lines} == set()
    near = docs.unionByName(spark.createDataFrame([(20, "The total of invoice 2020-01-01 is due on reciept", "en", "s", 1)], docs.schema))
    assert {r.doc_id for r in linededup.line_duplicates(near).collect() if r.removed_lines} == {20}


def test_short_foreign_texts_are_rejected_too(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language.train(docs.where("doc_id % 4 <> 2"))
    foreign = ["Ωραία μέρα", "Съешь же ещё", "これは日本語の文章", "שלום עולם", "안녕하세요 여러분"]
    assert all(language.classify(t, model)[2] for t in foreign)
    texts = [r.text for r in docs.where("text is not null and length(text) > 300 and lang is not null").limit(200).collect()]
    kept = [not language.classify(t[at : at + n], model)[2] for t in texts for at in (0, 100) for n in (12, 20, 40, 80, 200) if any(c.isalpha() for c in t[at : at + n])]
    assert sum(kept) > 0.98 * len(kept)


def test_language_held_out_accuracy_and_rejection(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = language.predict_languages(docs).toPandas().set_index("doc_id")
    truth = docs.select("doc_id", "lang").toPandas().set_index("doc_id")["lang"]
    held = got[got["held_out"]].join(truth)
    assert set(held.index) == {i for i in got.index if zlib.crc32(str(i).encode()) % 4 == 2}
    assert (held["lang_pred"] == held["lang"]).mean() > 0.97 and got["rejected"].mean() < 0.01
    model = language.train(docs)
    assert language.classify("привет как дела " * 5, model)[2] and language.classify("123", model) == ("und", 0.0, True)


def test_language_equals_cosines_by_hand(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = language.train(docs)
    for r in docs.limit(60).collect():
        grams = defaultdict(int)
        letters = [c.lower() if len(c.lower()) == 1 else c for c in r.text]
        padded = re.sub(r"\0+", "\0", "\0" + "".join(c if c.isalpha() else "\0" for c in letters) + "\0")
        for order in language.ORDERS:
            for k in range(len(padded) - order + 1):
                code = 0
                for c in padded[k : k + order]:
                    code = (code * 0x110001 + ord(c) + 1) % (1 << 64)
                grams[(code * 0x9E3779B97F4A7C15) % (1 << 64) >> 52] += 1
        v = np.zeros(language.DIMS)
        for slot, n in grams.items():
            v[slot] = np.log1p(n) * model.idf[slot]
        v /= np.linalg.norm(v) or 1
        near = model.centroids @ v
        got = language.classify(r.text, model)
        if any(c.isalpha() for c in r.text):
            assert got[0] == model.langs[int(near.argmax())]
            tops = {lang: max(n for n, x in zip(near, model.langs) if x == lang) for lang in set(model.langs)}
            assert got[1] == pytest.approx(1 / sum(np.exp((t - near.max()) / language.TEMPERATURE) for t in tops.values()), rel=1e-3)


def brute_signatures(text):
    words = [w for w in re.split(r"[^\w]|_", text.lower()) if w]
    anchors = {w for ws in spotsigs.ANCHORS.values() for w in ws}
    content = [(i, w) for i, w in enumerate(words) if w not in anchors]
    spots = []
    for i, w in enumerate(words):
        if w in anchors:
            chain = [c for k, c in content if k > i][:2]
            if len(chain) == 2:
                spots.append(tuple(chain))
    return set(spots), words


def test_spot_signatures(spark):
    text = "The quick fox is in the old house of a big red dog and the"
    spots, words = brute_signatures(text)
    h = lambda pair: (lambda v: (v >> 32) - (1 << 31))(xxhash.xxh64_intdigest(pair[1].encode(), xxhash.xxh64_intdigest(pair[0].encode(), 42)))
    want = sorted({h(s) for s in spots})
    listed = "alpha beta gamma delta"
    rows = spark.createDataFrame([(text,), (listed,), ("the", ), ("alone",), (" - ",), (None,)], "t string")
    got = [r.s for r in rows.select(spotsigs.signature_set(F.col("t")).alias("s")).collect()]
    assert got[:2] == [want, sorted(h(p) for p in zip(listed.split(), listed.split()[1:]))]
    assert [len(s) for s in got[2:]] == [1, 1, 0, 0]
    # A long stretch without an anchor has its runs, next to the spots before it.
    many = [f"w{i}" for i in range(spotsigs.STRETCH + 3)]
    got = spark.createDataFrame([("the " + " ".join(many),)], "t string").select(spotsigs.signature_set(F.col("t")).alias("s")).collect()[0].s
    assert got == sorted(h(p) for p in zip(many, many[1:]))


def test_spotsigs_documents(spark, docs):
    rows = sorted(((r.doc_id, r.text or "") for r in docs.collect()), reverse=True)
    got = {r.doc_id: r for r in spotsigs.fingerprint_documents(docs).collect()}
    assert len(got) == len(rows)
    parts = lambda f: {f[i : i + 8] for i in range(0, len(f), 8)}
    for k, (i, text) in enumerate(rows):
        j, after = rows[(k + 1) % len(rows)]
        m = len(text) // 3
        edited = text[: len(text) - m] + after[:m]
        r = got[i]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        a, b, c = parts(r.fingerprint), parts(r.edited_fingerprint), parts(got[j].fingerprint)
        assert r.near_edited == pytest.approx(len(a & b) / len(a | b) if a | b else 1.0)
        assert r.near_next == pytest.approx(len(a & c) / len(a | c) if a | c else 1.0)


def test_spotsigs_near_duplicates_equal_all_pairs(spark, docs):
    sets = {r.doc_id: frozenset(r.s) for r in docs.select("doc_id", spotsigs.signature_set(F.col("text")).alias("s")).collect() if r.s}
    least = {}
    for i in sorted(sets):
        least.setdefault(sets[i], i)
    ids = sorted(least.values())
    want = {(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.6}
    assert {(r.a, r.b) for r in spotsigs.near_duplicates(docs, 0.6).collect()} == want


def brute_pii(text):
    found = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        found.append((m.start(), 0, m.end(), "email"))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m.group().split(".")):
            found.append((m.start(), 1, m.end(), "ip"))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[^0-9]", "", m.group())
        if 14 <= len(digits) <= 19 and pii.luhn(digits):
            found.append((m.start(), 2, m.end(), "card"))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 10 <= len(re.sub("[^0-9]", "", m.group())) <= 15:
            found.append((m.start(), 3, m.end(), "phone"))
    return ",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(found))


def test_pii_base_equals_the_patterns(spark, docs):
    rng = random.Random(0)
    for _ in range(5000):
        text = "".join(rng.choice("a1@.. +-5_b(0") for _ in range(30))
        assert pii.written(pii.base_spans(text)) == brute_pii(text)
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    for r in pii.find_documents_pii(docs).collect():
        base = brute_pii(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(base.encode()).hexdigest()
        assert set(filter(None, base.split(","))) <= set(r.spans.split(",")) if base else True


def test_pii_adds_and_masks(spark):
    text = 'mail a@b.com or joe (at) site.org, token = "0123456789abcdef0123456789abcdef", iban GB82 WEST 1234 5698 7654 32'
    rows = spark.createDataFrame([(i, text, "x") for i in range(30)], "doc_id long, text string, more string")
    kinds = {s.split(":")[0] for s in pii.find_documents_pii(rows).collect()[0].spans.split(",")}
    assert {"email", "secret"} <= kinds
    masked = pii.mask_pii(rows).collect()[0]
    assert "<EMAIL>" in masked.text and "a@b.com" not in masked.text and masked.more == "x"


def test_pii_candidates_equal_comparing_all_pairs():
    rng = random.Random(1)
    words = ["555-123-4567", "a@b.com", "joe (at) x.org", "4111 1111 1111 1111", "123-45-6789", "Dr. Anna Weber", "sk_" + "a1" * 12, "f" * 31 + "0", "GB82 WEST 1234 5698 7654 32", "+1 555 123 4567", "eyJhbGciOiJI.eyJzdWIiOiIx.SflKxwRJSMeK", "word"]
    for _ in range(300):
        text = rng.choice([" ", ",", ""]).join(rng.choice(words) for _ in range(6))
        base = pii.base_spans(text)
        taken, want = [(a, b) for _, a, b in base], []
        for kind, pattern, _ in pii._WIDE:
            for m in pattern.finditer(text):
                a, b = m.span()
                if all(b <= x or a >= y for x, y in taken):
                    want.append((kind, a, b))
                    taken.append((a, b))
        assert pii.candidates(text, base) == want


def test_pii_reliabilities_equal_a_loop():
    rng = np.random.default_rng(2)
    k = len(pii.LABELERS)
    vote = np.unique(rng.integers(-1, 2, (40, k)), axis=0)
    n = rng.integers(1, 50, len(vote)).astype(float)
    post, right = pii.expectation_maximisation(vote, n, rounds=6)
    rel, prior = [pii.KNOWN.get(name, pii.START) for name in pii.LABELERS], 0.5
    for _ in range(6):
        p = []
        for row in vote:
            yes, no = prior, 1 - prior
            for v, r in zip(row, rel):
                yes *= r if v > 0 else 1 - r if v < 0 else 1
                no *= 1 - r if v > 0 else r if v < 0 else 1
            p.append(yes / (yes + no))
        rel = []
        for j, name in enumerate(pii.LABELERS):
            agree = sum(c * (q if row[j] > 0 else 1 - q) for row, q, c in zip(vote, p, n) if row[j])
            spoke = sum(c for row, c in zip(vote, n) if row[j])
            rel.append(pii.KNOWN.get(name) or min(0.99, max(0.55, (agree + pii.START * 10) / (spoke + 10))))
        prior = min(0.9, max(0.1, (sum(q * c for q, c in zip(p, n)) + 1) / (n.sum() + 2)))
    assert np.allclose(post, p) and np.allclose(right, rel)


def test_passages_inside_lines(spark):
    rng = random.Random(2)
    words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(3, 8))) for _ in range(3000)]
    some = lambda n: " ".join(rng.choice(words) for _ in range(n))
    passage, line = some(60), some(20)
    texts = [some(30) + " " + passage + " " + some(30), some(100), some(11) + " " + passage.upper() + "\n" + some(9), some(80), "of of of " * 8, f"{some(5)}\n{line}\n{some(4)}", f"{line.title()} \n{some(19)}", passage + "\nx y\n" + passage]
    docs = spark.createDataFrame([(i, t, "mine") for i, t in enumerate(texts)], "doc_id long, text string, removed string")
    got = passages.repeated_passages(docs).collect()
    assert {(r.doc_id, r.kept_doc_id) for r in got} == {(2, 0), (6, 5), (7, 0)}
    assert sum(r.words for r in got if r.doc_id == 2) >= 40
    # Of the two copies in document 7 both go, the earlier one is in document 0.
    assert sum(r.end - r.start for r in got if r.doc_id == 7) > 1.5 * len(passage)
    cut = {r.doc_id: r for r in passages.remove_passages(docs).collect()}
    for i, text in enumerate(texts):
        left = text
        for s in reversed(cut[i].removed):
            left = left[: s.start] + left[s.end :]
        assert cut[i].text == left
    assert not cut[0].removed and cut[6].text.strip() == texts[6].split("\n")[1]


def test_passages_repeated_within_a_document(spark):
    rng = random.Random(6)
    para = " ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(60))
    docs = spark.createDataFrame([(1, "\n".join([para] * 500))], "doc_id long, text string")
    got = passages.repeated_passages(docs).collect()
    assert [(r.kept_doc_id, r.start) for r in got] == [(1, len(para) + 1)]
    assert passages.remove_passages(docs).collect()[0].text.strip() == para


def test_passage_pieces_do_not_depend_on_place():
    rng = random.Random(4)
    words = ["".join(rng.choice("abcdef") for _ in range(6)) for _ in range(500)]
    for n in range(40):
        body = " ".join(rng.choice(words) for _ in range(50))
        a, b = passages.units("x y z " + body + " u v"), passages.units(" ".join(rng.choice(words) for _ in range(n)) + " " + body + " w" * n)
        own = set(a[1][~a[0]].tolist())
        assert sum(w for d, w, line in zip(b[1].tolist(), b[6].tolist(), b[0].tolist()) if not line and d in own) >= 30


def test_passages_of_a_hot_repeated_row(spark):
    """A row that comes thousands of times loses what it would lose once, and no step sees its copies together."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    body = " ".join(word() for _ in range(60))
    rows = [(1, body), (2, "x y " + body + " z " + body), (None, "q " + body)]
    one = spark.createDataFrame(rows, "doc_id long, text string")
    many = one.where("doc_id = 1").unionByName(one.where("doc_id = 2 or doc_id is null").crossJoin(spark.range(3000).select()))
    want = sorted(map(tuple, passages.repeated_passages(one).collect()), key=str)
    assert {r[0] for r in want} == {2, None}
    assert sorted(map(tuple, passages.repeated_passages(many).collect()), key=str) == want


def test_passages_equal_grouping_by_hand(spark, docs):
    holders = defaultdict(set)
    mine = {}
    for r in docs.collect():
        rows = list(zip(*[c.tolist() for c in passages.units(r.text)]))
        mine[r.doc_id] = rows
        for row in rows:
            holders[row[1], row[2]].add(r.doc_id)
    want = set()
    for i, rows in mine.items():
        spans, run, before = [], [], set()
        for row in [*rows, None]:
            gone = row and (min(holders[row[1], row[2]]) < i or (row[1], row[2]) in before)
            if row:
                before.add((row[1], row[2]))
            if gone and row[0]:
                spans.append((row[4], row[5]))
            if gone and not row[0]:
                run.append(row)
            else:
                if sum(r[6] for r in run) >= passages.MIN_WORDS:
                    spans.append((run[0][4], run[-1][5]))
                run = []
        merged = []
        for a, b in sorted(spans):
            if merged and a < merged[-1][1]:
                merged[-1][1] = max(b, merged[-1][1])
            else:
                merged.append([a, b])
        want |= {(i, a, b) for a, b in merged}
    assert want == {(r.doc_id, r.start, r.end) for r in passages.repeated_passages(docs).collect()}
