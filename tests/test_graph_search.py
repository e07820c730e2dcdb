"""Names by rarest gram, long trails from both ends, alias chains, the inventory's rules."""

import random

from pyspark.sql import functions as F

from quillgraph.operators import canonical, graph, qa, routing
from quillgraph.sources import tables


def test_terms_meet_few_names_beyond_their_matches(spark, sf):
    names = tables.read(spark, sf, "customer").select(F.lower("c_name").alias("low"))
    terms = names.select(F.col("low").alias("term")).unionByName(names.select(F.substring("low", -6, 6).alias("term")))
    pairs = qa.term_candidates(terms, names)
    met, found = pairs.count(), pairs.where(F.contains("low", "term")).count()
    assert found >= names.count() * 2 and met <= 3 * found


def test_every_term_finds_every_name_that_contains_it(spark):
    rng = random.Random(1)
    names = {"".join(rng.choices("abc ", k=rng.randint(0, 9))) for _ in range(300)}
    terms = {"".join(rng.choices("abc ", k=rng.randint(0, 6))) for _ in range(100)} | {"é", "zzz"}
    pairs = qa.term_candidates(spark.createDataFrame([(t,) for t in terms], "term string"), spark.createDataFrame([(n,) for n in names], "low string"))
    got = {(r.term, r.low) for r in pairs.where(F.contains("low", "term")).collect()}
    assert got == {(t, n) for t in terms for n in names if t and t in n}


def test_trails_of_any_length_equal_a_walk(spark):
    rng = random.Random(6)
    edges = [(str(i), rng.choice("abcdefg"), rng.choice("abcdefg"), "uses", rng.choice([0.6, 0.9]), "t", False) for i in range(14)]
    pairs = [(a, b) for a in "abx" for b in "acg"]
    table = spark.createDataFrame(edges, "edge_id string, src string, dst string, relation string, confidence double, created_at string, conflicting boolean")
    asked = spark.createDataFrame(pairs + pairs[:2], "start string, goal string")

    def walk(here, goal, used, left):
        if used and here == goal:
            yield used
        if left:
            for e, s, d, _, c, _, _ in edges:
                if c >= 0.7 and e not in used:
                    for a, b in {(s, d), (d, s)}:
                        if a == here:
                            yield from walk(b, goal, (*used, e), left - 1)

    for most in (1, 2, 3, 4, 5):
        got = [(r.start, r.goal, tuple(h.edge_id for h in r.hops)) for r in qa.find_paths(asked, table, most, 0.7).collect()]
        want = [(a, b, t) for a, b in pairs for t in walk(a, b, (), most)]
        assert sorted(got) == sorted(want), most
    hops = [r.hops for r in qa.find_paths(asked, table, 5, 0.7).collect()]
    assert all(h[i].to == h[i + 1]["from"] for h in hops for i in range(len(h) - 1))


def test_alias_chains_and_rings_end_at_one_node(spark):
    rows = [(f"n{i:03d}", f"n{i + 1:03d}") for i in range(70)] + [("r3", "r1"), ("r1", "r2"), ("r2", "r3"), ("q", "r2"), ("x", "y"), ("x", "z"), ("w", "w")]
    ends = graph.resolve_chains(spark.createDataFrame([(a, b, f"name of {b}") for a, b in rows], "node_id string, target_id string, target_name string")).collect()
    got = {r.node_id: (r.target_id, r.target_name) for r in ends}
    assert len(ends) == len(got)
    assert got == {f"n{i:03d}": ("n070", "name of n070") for i in range(70)} | {k: ("r1", "name of r1") for k in ("r2", "r3", "q")} | {"x": ("y", "name of y")}
    none = spark.createDataFrame([], "node_id string, target_id string, target_name string")
    assert graph.resolve_chains(none).count() == 0


def test_three_resolutions_in_a_row_remap_the_merge_map(spark):
    node = "node_id string, name string, aliases array<string>"
    existing = spark.createDataFrame([("e1", "BERT", ["bert base"])], node)
    staged = spark.createDataFrame([("s1", "Bert Base", ["tiny"]), ("s2", "other", [])], node)
    nodes, mapped = graph.resolve_staged(existing, staged, spark.createDataFrame([("tiny", "s1"), ("Bert Base", "s1"), ("other", "s2")], "alias string, node_id string"))
    assert {(r.node_id, r.name, tuple(r.aliases)) for r in nodes.collect()} == {("e1", "BERT", ("Bert Base", "tiny")), ("s2", "other", ())}
    assert {(r.alias, r.node_id) for r in mapped.collect()} == {("tiny", "e1"), ("Bert Base", "e1"), ("other", "s2")}


def test_normal_forms_fall_together(spark):
    names = spark.createDataFrame([("ﬁne",), ("fine",), ("ｆｉｎｅ",), ("fín",), ("fín",), (None,), ("",)], "name string")
    got = [r.normalised for r in names.select(canonical.normalised(F.col("name")).alias("normalised")).collect()]
    assert got == ["fine", "fine", "fine", "fín", "fín", None, ""]
    assert names.select(F.to_json(canonical.hash_embedding(F.col("name"))).alias("v")).limit(3).distinct().count() == 1


def test_abbreviations_of_all_shapes(spark):
    text = "We saw Interleukin-6 (IL-6) and human epidermal growth factor receptor 2 of a very long name indeed (HER2), tumour protein 53(p53), a (b) and (see) x."
    rows = spark.createDataFrame([("e", text), ("f", None), ("g", "")], "element_id string, content string")
    got = [(r.long_form, r.abbreviation) for r in routing.abbreviation_pairs(rows).collect()]
    assert got == [("We saw Interleukin-6", "IL-6"), ("and human epidermal growth factor receptor 2 of a very long name indeed", "HER2"), ("tumour protein 53", "p53"), ("and", "see")]
