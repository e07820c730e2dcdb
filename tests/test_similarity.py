"""The similarity join by pivots and greedy clustering in rounds, against brute force."""

import random
from difflib import SequenceMatcher

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillgraph import config
from quillgraph.functions import vectors
from quillgraph.functions.components import connected_components
from quillgraph.operators import canonical, clustering
from quillgraph.plans import more_queries


def unit_rows(kind, n=700):
    rng = np.random.default_rng(4)
    if kind == "clustered":
        base = rng.normal(size=(25, 24))
        a = np.vstack([base[rng.integers(0, 25, n)] + rng.normal(size=(n, 24)) * 0.2, np.tile(base[:1], (60, 1)), np.zeros((3, 24))])
    else:
        a = rng.normal(size=(n, 64))
    norm = np.linalg.norm(a, axis=1, keepdims=True)
    return np.divide(a, norm, out=np.zeros_like(a), where=norm > 0)


@pytest.mark.parametrize("kind", ["clustered", "isotropic"])
@pytest.mark.parametrize("threshold", [-0.1, 0.2, 0.77, 0.88])
def test_join_equals_all_pairs(spark, monkeypatch, kind, threshold):
    monkeypatch.setattr(vectors, "CHUNK", 50)
    monkeypatch.setattr(vectors, "QUERY_CHUNK", 40)
    a = unit_rows(kind)
    rows = spark.createDataFrame([(i * 7, v.tolist()) for i, v in enumerate(a)], "id long, vector array<double>")
    asked = rows.where("id % 3 = 0").withColumnRenamed("id", "query_id")
    got = vectors.similarity_join(asked, rows, threshold).collect()
    s = np.round(a[::3] @ a.T, 6)
    want = {(int(i) * 21, int(j) * 7, float(s[i, j])) for i, j in np.argwhere(s >= threshold)}
    assert len(got) == len(want) and {(r.query_id, r.id, r.score) for r in got} == want


def test_few_pairs_are_compared(spark):
    for kind in ("clustered", "isotropic"):
        a = unit_rows(kind)
        rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(a)], "id long, vector array<double>")
        counts = vectors.compared_pairs(rows.withColumnRenamed("id", "query_id"), rows, 0.88).first()
        assert counts.compared < 0.1 * len(a) ** 2 and counts.found == (np.round(a @ a.T, 6) >= 0.88).sum()
        if kind == "clustered":
            assert counts.met < 0.4 * len(a) ** 2


def test_best_k_and_empty_tables(spark):
    a = unit_rows("clustered", 100)
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(a)], "id long, vector array<double>")
    asked = rows.withColumnRenamed("id", "query_id")
    s = np.round(a @ a.T, 6)
    want = {(i, j, k + 1) for i in range(len(a)) for k, j in enumerate(sorted((j for j in range(len(a)) if s[i, j] >= 0.5), key=lambda j: (-s[i, j], j))[:3])}
    assert {(r.query_id, r.id, r.k) for r in vectors.similarity_join(asked, rows, 0.5, 3).collect()} == want
    for q, c in ((asked.where("false"), rows), (asked, rows.where("false"))):
        assert vectors.similarity_join(q, c, 0.5).count() == vectors.similarity_join(q, c, 0.5, 2).count() == 0


@pytest.mark.parametrize("kind", ["clustered", "isotropic", "low"])
@pytest.mark.parametrize("threshold", [-0.1, 0.3, 0.45, 0.77, 0.95])
def test_links_have_the_components_of_all_pairs(spark, monkeypatch, kind, threshold):
    monkeypatch.setattr(vectors, "REGION", 90)
    monkeypatch.setattr(vectors, "QUERY_CHUNK", 60)
    if kind == "low":
        a = np.random.default_rng(9).normal(size=(500, 4))
        a = np.vstack([a / np.linalg.norm(a, axis=1, keepdims=True), np.zeros((3, 4))])
    else:
        a = unit_rows(kind, 300)
    rows = spark.createDataFrame([(i * 7, v.tolist()) for i, v in enumerate(a)], "id long, vector array<double>")
    links = vectors.near_links(rows, threshold).collect()

    def parts(pairs):
        label = list(range(len(a)))
        for x, y in pairs:
            if label[x] != label[y]:
                old, new = max(label[x], label[y]), min(label[x], label[y])
                label = [new if v == old else v for v in label]
        return label

    s = np.round(a @ a.T, 6) >= threshold
    assert parts((r.a // 7, r.b // 7) for r in links) == parts(np.argwhere(np.triu(s, 1)))


def test_links_are_few_where_pairs_are_many(spark):
    a = np.random.default_rng(9).normal(size=(2000, 4))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(a)], "id long, vector array<double>")
    assert vectors.near_links(rows, 0.77).count() < 5 * len(a) < (a @ a.T >= 0.77).sum() / 10


def test_regions_stay_few(spark, monkeypatch):
    seen, send = [], vectors._send_regions
    monkeypatch.setattr(vectors, "REGION", 20)
    monkeypatch.setattr(vectors, "_send_regions", lambda *a: seen.append(a[-1].shape[1]) or send(*a))
    a = unit_rows("isotropic", 600)
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(a)], "id long, vector array<double>")
    links = vectors.near_links(rows, 0.3)
    assert 1 < seen[0] <= 2 * vectors.REGIONS
    got = {r.node: r.label for r in connected_components(links, "a", "b").collect()}
    near = [np.flatnonzero(row) for row in np.round(a @ a.T, 6) >= 0.3]
    assert set(got) == {i for i, js in enumerate(near) if len(js) > 1} and all(got[i] == got[int(j)] for i, js in enumerate(near) for j in js if len(js) > 1)


def sequential(entities):
    """The greedy pass over everything, with every cluster's members looked at one by one."""
    clusters, owner = [], {}
    for c in sorted(entities, key=lambda c: (-c["times_seen"], c["normalised"], c["name"])):
        v = np.array(c["vector"])
        scored = []
        for j, members in enumerate(clusters):
            total = np.zeros_like(v)
            for m in members:
                total = total + np.array(m["vector"])
            scored.append((round(float(total / (np.linalg.norm(total) or 1) @ v), 9), -j))
        home = None
        for score, j in sorted(scored, reverse=True):
            members = clusters[-j]
            alike = max(SequenceMatcher(None, c["normalised"], m["normalised"]).ratio() for m in members)
            same = any(m["normalised"] == c["normalised"] for m in members)
            shared = any(set(c["tokens"]) & set(m["tokens"]) for m in members)
            bridge = any(c["initials"] and c["initials"] == m["letters"] or m["initials"] and m["initials"] == c["letters"] for m in members)
            if not same and (len(c["tokens"]) > config.NAME_MAX_TOKENS or len(c["name"]) > config.NAME_MAX_CHARS or c["sentence_like"] or alike < config.LEXICAL_MIN and not shared and not bridge):
                continue
            sections = {}
            for m in members:
                for k, n in m["sections"].items():
                    sections[k] = sections.get(k, 0) + n
            share = lambda d: {k: n / sum(d.values()) for k, n in d.items()}
            top = lambda d: set(sorted(d, key=lambda k: (-d[k], k))[:2])
            if c["blocked"] or any(m["blocked"] for m in members):
                a, b = share(c["sections"]), share(sections)
                fits = score >= config.MERGE_BLOCKED and all(abs(a.get(k, 0) - b.get(k, 0)) <= config.SECTION_SHARE for k in a.keys() | b.keys())
            elif c["polysemous"] or len(sections) >= config.POLYSEMY_SECTIONS:
                a, b = top(c["sections"]), top(sections)
                fits = score >= config.MERGE_POLYSEMOUS and len(a & b) / len(a | b) >= config.SECTION_JACCARD
            else:
                bar = config.MERGE_BASE + (config.MERGE_SAME_TYPE if any(m["type"] == c["type"] for m in members) else config.MERGE_CROSS_TYPE)
                fits = score >= max(config.MERGE_BASE, bar + (config.MERGE_LEXICAL if alike >= config.LEXICAL_HIGH else 0))
            if fits:
                home = members
                break
        if home is None:
            home = []
            clusters.append(home)
        home.append(c)
        owner[c["name"]] = home[0]["name"]
    return owner


@pytest.mark.parametrize("most", [110, 1000])
def test_rounds_equal_the_sequential_pass(spark, most):
    rng = random.Random(11)
    gen = np.random.default_rng(11)
    words = ["net", "nets", "graph", "map", "loss", "data", "model", "IBM", "it", *config.BLOCKED_NAMES[:2]]
    rows = {}
    for i in range(260):
        name = " ".join(rng.choices(words, k=rng.randint(1, 3))) + rng.choice(["", "", f" {i % 40}", "."])
        v = gen.normal(size=3)
        rows[name] = (name, rng.choice(["T", "U"]), rng.randint(1, 9), {s: rng.randint(1, 3) for s in rng.sample("RMDI", rng.randint(1, 3))}, (v / np.linalg.norm(v)).tolist())
    table = spark.createDataFrame(list(rows.values()), "name string, type string, times_seen int, sections map<string,int>, vector array<double>")
    got = {r.name: r.cluster for r in canonical.resolve_entities(table, most).collect()}
    want = sequential([r.asDict() for r in canonical.name_features(table).collect()])
    assert got == want
    assert 20 < len(set(want.values())) < len(rows)


def _counted(monkeypatch):
    """One item for each time that a round looks for components."""
    calls = []

    def counted(edges, a, b):
        calls.append(1)
        return connected_components(edges, a, b)

    monkeypatch.setattr(clustering, "connected_components", counted)
    return calls


_ENTITY = "name string, type string, times_seen int, sections map<string,int>, vector array<double>"


def test_rounds_of_a_dense_block_look_for_components_a_few_times_only(spark, monkeypatch):
    gen = np.random.default_rng(3)
    a = gen.normal(size=(160, 3))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    table = spark.createDataFrame([(f"graph {i}", "T", i % 5 + 1, {"R": 1}, v.tolist()) for i, v in enumerate(a)], _ENTITY)
    calls = _counted(monkeypatch)
    got = {r.name: r.cluster for r in canonical.resolve_entities(table, 10).collect()}
    assert got == sequential([r.asDict() for r in canonical.name_features(table).collect()])
    # Sixteen rounds of ten.
    assert 1 <= len(calls) <= 5


def test_rounds_reach_farther_where_components_are_small(spark, monkeypatch):
    # Groups of four in right angles to each other, joined into one block by two late steps of 30 degrees each.
    rows, eye = [], np.eye(30)
    for i in range(30):
        rows += [(f"group {i} {j}", "T", 5, {"R": 1}, eye[i].tolist()) for j in range(4)]
        for k, turn in ((0, np.pi / 6), (1, np.pi / 3)):
            if i < 29:
                rows.append((f"step {i} {k}", "T", 1, {"R": 1}, (np.cos(turn) * eye[i] + np.sin(turn) * eye[i + 1]).tolist()))
    table = spark.createDataFrame(rows, _ENTITY)
    assert canonical.giant_blocks(canonical.merge_blocks(table), 20).first().members == len(rows) == 178
    calls = _counted(monkeypatch)
    got = {r.name: r.cluster for r in canonical.resolve_entities(table, 20).collect()}
    assert got == sequential([r.asDict() for r in canonical.name_features(table).collect()])
    # The first round takes 80, and no trial is vain until the steps come.
    assert 1 <= len(calls) <= 4


def test_query_equals_the_sequential_pass(spark, sf):
    entities = more_queries._entities(spark, sf)
    got = {r.name: r.cluster for r in more_queries.cluster_entities(spark, sf).collect()}
    assert got == sequential([r.asDict() for r in canonical.name_features(entities).collect()])
    assert canonical.giant_blocks(canonical.merge_blocks(entities), 200).count() == 1


def test_rounds_of_a_dense_block_make_no_table_of_pairs_and_few_jobs(spark, monkeypatch):
    gen = np.random.default_rng(4)
    a = gen.normal(size=(160, 3))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    table = spark.createDataFrame([(f"graph {i}", "TU"[i % 2], i % 5 + 1, {"R": 1}, v.tolist()) for i, v in enumerate(a)], _ENTITY)
    asked = []

    def counted(queries, corpus, threshold, k=None):
        asked.append(queries.count())
        return vectors.similarity_join(queries, corpus, threshold, k)

    monkeypatch.setattr(clustering, "similarity_join", counted)
    numbered = clustering.checkpointed(clustering.sequence_number(canonical.name_features(table)))
    spark.sparkContext.setJobGroup("rounds", "rounds")
    try:
        owners = clustering._giant_blocks(numbered, 5).collect()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    place = {r.no: r.name for r in numbered.collect()}
    assert {place[r.no]: place[r.founder] for r in owners} == sequential([r.asDict() for r in canonical.name_features(table).collect()])
    # Only the first trial asks, with 20 entities; 32 rounds are decided in three jobs, each of which is one stage after another.
    assert max(asked, default=0) <= 20
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("rounds")) < 160


def _mixed(spark, n, dims, seed):
    rng, gen = random.Random(seed), np.random.default_rng(seed)
    words = ["net", "nets", "graph", "map", "loss", "data", "model", "IBM", "it", *config.BLOCKED_NAMES[:2]]
    rows = {}
    for i in range(n):
        name = " ".join(rng.choices(words, k=rng.randint(1, 3))) + rng.choice(["", "", f" {i % 40}", "."])
        v = gen.normal(size=dims)
        rows[name] = (name, rng.choice(["T", "U", None]), rng.randint(1, 9), {s: rng.randint(1, 3) for s in rng.sample("RMDI", rng.randint(1, 3))}, (v / np.linalg.norm(v)).tolist())
    return spark.createDataFrame(list(rows.values()), _ENTITY)


@pytest.mark.parametrize("held, turns, most", [(30, 16, 25), (0, 16, 60), (1000, 2, 12)])
def test_rounds_equal_the_sequential_pass_whichever_clusters_come_along(spark, monkeypatch, held, turns, most):
    monkeypatch.setattr(clustering, "HELD_CLUSTERS", held)
    monkeypatch.setattr(clustering, "TURNS", turns)
    table = _mixed(spark, 220, 3, 12)
    got = {r.name: r.cluster for r in canonical.resolve_entities(table, most).collect()}
    want = sequential([r.asDict() for r in canonical.name_features(table).collect()])
    assert got == want and 20 < len(set(want.values())) < len(want)


def test_names_are_compared_only_where_that_decides(monkeypatch):
    calls = []
    monkeypatch.setattr(clustering, "lexical", lambda a, b: calls.append(1) or SequenceMatcher(None, a, b).ratio())
    rng = random.Random(5)

    def entity(name, type_):
        return {"name": name, "normalised": name, "type": type_, "times_seen": 1, "sections": {"R": 1}, "tokens": name.split(), "letters": "".join(filter(str.isalpha, name)), "initials": None, "sentence_like": False, "blocked": False, "polysemous": False, "vector": np.array([1.0, 0.0])}

    code = lambda: "".join(rng.choices("0123456789abcdef", k=32))
    members = [entity(f"entity {code()}", "T") for _ in range(300)]
    cluster = clustering.Cluster(0, members[0]["vector"])
    for i, m in enumerate(members):
        cluster.take(m, first=i == 0)
    assert clustering.may_merge(entity(f"entity {code()}", "T"), cluster, 0.9) and not clustering.may_merge(entity(f"entity {code()}", "U"), cluster, 0.89)
    assert not calls
    # Between the two bars of another type the names decide, but few have letters that are alike enough.
    assert not clustering.may_merge(entity(f"entity {code()}", "U"), cluster, 0.92) and clustering.may_merge(entity(members[7]["name"][:-1] + "x", "U"), cluster, 0.92)
    assert len(calls) < 30


def test_names_alike_equal_a_comparison_with_all(spark):
    rng = random.Random(6)
    words = ["graph net", "graph nets", "loss map", "", "a", "\u00e9t\u00e9 \u4e2d\u6587", "x" * 250, "xy" * 120]
    listed = [w + rng.choice(["", "s", " 1", "q" * rng.randint(0, 9)]) for w in words for _ in range(6)]
    for split in (0, 20, len(listed)):
        held, new = list(dict.fromkeys(listed[:split])), [n for n in dict.fromkeys(listed) if n not in listed[:split]]
        structs = [pa.array([{"name": n, "tokens": n.split(), "letters": n, "initials": None, "blocked": False} for n in held], clustering._NAME)] if held else []
        names = clustering.Names(structs, len(held))
        for n in new:
            names.add({"normalised": n, "tokens": n.split(), "letters": n, "initials": None, "blocked": False})
        for asked in [*words, "graph", "loss maps", "zzz"]:
            for least in (0.55, 0.9):
                assert names.alike(asked, least) == any(SequenceMatcher(None, asked, n).ratio() >= least for n in {*held, *new})
            assert (asked in names) == (asked in {*held, *new})
        assert [x["name"] for p in names.rows(True) for x in p.to_pylist()] == [*held, *new]
        assert [x["name"] for p in names.rows(False) for x in p.to_pylist()] == new


def test_no_entities_no_clusters(spark):
    table = spark.createDataFrame([], "name string, type string, times_seen int, sections map<string,int>, vector array<double>")
    assert canonical.resolve_entities(table, 5).count() == 0


def test_gate(spark):
    def entity(name, type_="T", **more):
        return {"name": name, "normalised": name, "type": type_, "times_seen": 1, "sections": {"R": 1}, "tokens": name.split(), "letters": name.replace(" ", ""), "initials": None, "sentence_like": False, "blocked": False, "polysemous": False, "vector": np.array([1.0, 0.0]), **more}

    def cluster(*members):
        c = clustering.Cluster(0, members[0]["vector"])
        for i, m in enumerate(members):
            c.take(m, first=i == 0)
        return c

    net = cluster(entity("graph net"))
    assert clustering.may_merge(entity("graph nets"), net, 0.88)
    assert not clustering.may_merge(entity("graph nets"), net, 0.87)
    assert not clustering.may_merge(entity("graph map", "U"), net, 0.93) and clustering.may_merge(entity("graph map", "U"), net, 0.94)
    assert not clustering.may_merge(entity("zzz"), net, 0.99)
    assert clustering.may_merge(entity("gn", initials=None), cluster(entity("graph net", initials="gn")), 0.9)
    assert not clustering.may_merge(entity("graph nets", sentence_like=True), net, 1.0) and clustering.may_merge(entity("graph net", sentence_like=True), net, 0.9)
    assert not clustering.may_merge(entity("graph net", blocked=True), net, 0.93) and clustering.may_merge(entity("graph net", blocked=True), net, 0.94)
    assert not clustering.may_merge(entity("graph net", blocked=True, sections={"M": 1}), net, 0.99)
    assert not clustering.may_merge(entity("graph net", polysemous=True, sections={"M": 3, "D": 2, "R": 1}), net, 0.99)
    assert clustering.may_merge(entity("graph net", polysemous=True, sections={"R": 3, "D": 2, "M": 1}), net, 0.92)
