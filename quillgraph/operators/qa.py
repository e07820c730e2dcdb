"""Graph queries and answers, for a whole table of questions at once.

Edges: `src, dst, relation, confidence, created_at, doc_id, section, conflicting`, each with a unique `edge_id`.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillgraph import config
from quillgraph.functions.checkpoints import FEW, broadcast_if_few, checkpointed, scratch, shuffles_freed
from quillgraph.operators import graph


def node_names(nodes: DataFrame) -> DataFrame:
    low = F.array_distinct(F.transform(F.concat(F.array("name"), F.col("aliases")), lambda x: F.lower(x)))
    return nodes.select("node_id", "name", "times_seen", F.explode(low).alias("low"))


def match_exact(mentions: DataFrame, nodes: DataFrame, k: int = 5) -> DataFrame:
    """`mention, node_id, name, times_seen, k`: nodes with that name or alias, most seen first."""
    met = mentions.select("mention").distinct().join(node_names(nodes), F.lower("mention") == F.col("low")).select("mention", "node_id", "name", "times_seen").distinct()
    order = Window.partitionBy("mention").orderBy(F.desc("times_seen"), "name", "node_id")
    return met.withColumn("k", F.row_number().over(order)).where(F.col("k") <= k)


#: Characters of the longest gram.
GRAM = 16


def _grams(text: Column, n: Column) -> Column:
    """The distinct grams of n characters, none for shorter texts."""
    starts = F.when(F.length(text) >= n, F.sequence(F.lit(1), F.greatest(F.length(text) - n + 1, F.lit(1)))).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(starts, lambda i: F.substring(text, i, n)))


def term_candidates(terms: DataFrame, names: DataFrame) -> DataFrame:
    """`term, low`: distinct terms with distinct names (`low`); those that contain the term are among them.

    A term of up to GRAM characters meets the names that have it as a gram of its own length, which are its matches. Names are
    listed under grams of those lengths only that some term has. A longer term is joined by the rarest of its
    grams of GRAM characters; what it meets beyond its matches are names that share so long a gram.
    """
    names = names.select("low").distinct()
    terms = terms.select("term").where("term <> ''").distinct()
    # One row: GRAM lengths at most.
    lengths = terms.agg(F.collect_set(F.least(F.length("term"), F.lit(GRAM))).alias("lengths"))
    grams = F.flatten(F.transform("lengths", lambda n: _grams(F.col("low"), n)))
    listed = names.crossJoin(F.broadcast(lengths)).select("low", F.explode(grams).alias("gram"))
    long = F.length("term") > GRAM
    asked = terms.where(long).select("term", F.explode(_grams(F.col("term"), F.lit(GRAM))).alias("gram"))
    often = listed.where(F.length("gram") == GRAM).join(asked.select("gram").distinct(), "gram", "left_semi").groupBy("gram").agg(F.count("*").alias("names"))
    counted = asked.join(often, "gram", "left")
    rarest = counted.groupBy("term").agg(F.min_by("gram", F.struct(F.coalesce("names", F.lit(0)).alias("n"), "gram")).alias("gram"))
    return terms.where(~long).select("term", F.col("term").alias("gram")).unionByName(rarest).join(listed, "gram").select("term", "low")


def match_contains(mentions: DataFrame, nodes: DataFrame, k: int = 5) -> DataFrame:
    """Nodes of which a name or alias contains the mention or one of its words (over two characters); exact names first.

    Terms meet names by their grams (`term_candidates`) and are then compared. The k best nodes of each term are taken before
    the term meets its mentions: any other node has k better ones with each mention, unless its name is the mention itself, and
    these are found by name.
    """
    low = F.lower("mention")
    words = F.filter(F.regexp_extract_all(low, F.lit("[a-z0-9]+"), F.lit(0)), lambda w: F.length(w) > 2)
    asked = mentions.select("mention").distinct()
    terms = asked.select("mention", F.explode(F.array_distinct(F.concat(F.array(low), words))).alias("term"))
    names = node_names(nodes)
    pairs = term_candidates(terms, names).where(F.contains(F.col("low"), F.col("term")))
    best = ["node_id", "name", "times_seen"]

    def first(rows: DataFrame, of: str) -> DataFrame:
        order = Window.partitionBy(of).orderBy(F.desc("times_seen"), "name", "node_id")
        return rows.select(of, *best).distinct().withColumn("k", F.row_number().over(order)).where(F.col("k") <= k).drop("k")

    met = terms.join(first(pairs.join(names, "low"), "term"), "term").select("mention", *best, F.lit(0).alias("exact"))
    same = asked.where(low != "").join(names, low == F.col("low"))
    exact = first(same, "mention").select("mention", *best, F.lit(1).alias("exact"))
    joined = exact.unionByName(met).groupBy("mention", *best).agg(F.max("exact").alias("exact"))
    order = Window.partitionBy("mention").orderBy(F.desc("exact"), F.desc("times_seen"), "name", "node_id")
    return joined.withColumn("k", F.row_number().over(order)).where(F.col("k") <= k)


def top_nodes(nodes: DataFrame, k: int) -> DataFrame:
    return nodes.select("node_id", "name", "times_seen").orderBy(F.desc("times_seen"), "name", "node_id").limit(k)


def both_directions(edges: DataFrame) -> DataFrame:
    """Every edge as a step from each of its ends; a self-loop once."""
    forth, back = F.struct(F.col("src").alias("at"), F.col("dst").alias("to")), F.struct(F.col("dst").alias("at"), F.col("src").alias("to"))
    # One pass over the edges, which may be dear to make.
    ways = F.when(F.col("src") != F.col("dst"), F.array(forth, back)).otherwise(F.array(forth))
    return edges.select("*", F.explode(ways).alias("__way")).select(*edges.columns, "__way.at", "__way.to")


def edges_at(edges: DataFrame, ends: DataFrame, documents: DataFrame | None = None) -> DataFrame:
    """Edges with an end among `ends` (`node_id`) or of one of the `documents` (`doc_id`, whatever its case).

    The reverse of an edge has the same ends, so the conflicts of edges at the ends are all among these.
    """
    ends = broadcast_if_few(ends.select("node_id").distinct())
    held = F.lit(False)
    for end in ("src", "dst"):
        edges = edges.join(ends.select(F.col("node_id").alias(f"__{end}")), F.col(end) == F.col(f"__{end}"), "left")
        held = held | F.col(f"__{end}").isNotNull()
    if documents is not None:
        named = broadcast_if_few(documents.select(F.lower("doc_id").alias("__doc")).distinct())
        edges = edges.join(named, F.lower("doc_id") == F.col("__doc"), "left")
        held = held | F.col("__doc").isNotNull()
    return edges.where(held).drop("__src", "__dst", "__doc")


def section_weight(sections: Column) -> Column:
    """Mean weight of the weighted sections that are present, else 1."""
    weights = F.filter(F.array(*[F.when(F.array_contains(sections, s), F.lit(w)) for s, w in config.SECTION_WEIGHTS]), lambda x: x.isNotNull())
    return F.when(F.size(weights) > 0, F.aggregate(weights, F.lit(0.0), lambda a, x: a + x) / F.size(weights)).otherwise(F.lit(1.0))


def _distances(ends: DataFrame, links: DataFrame, most: int) -> DataFrame:
    """`node, far`: nodes within `most` steps of any of `ends` (`node`), and how many steps the nearest one is away."""
    known = checkpointed(ends.select("node").distinct().withColumn("far", F.lit(0)))
    front = known.select("node")
    for step in range(1, most + 1):
        reached = front.withColumnRenamed("node", "at").join(links, "at").select(F.col("to").alias("node")).distinct()
        front = checkpointed(reached.join(known, "node", "left_anti"))
        known = known.unionByName(front.withColumn("far", F.lit(step)))
    return known


def find_paths(pairs: DataFrame, edges: DataFrame, max_hops: int = 2, confidence: float = config.PATH_CONFIDENCE, relations: Sequence[str] = ()) -> DataFrame:
    """Undirected trails of 1 to max_hops edges between the `start` and `goal` of each pair.

    No edge is used twice; nodes may repeat. `hops` lists the steps (edge_id, from, to, relation,
    confidence, created_at, conflicting) in walking order. Half of a trail is walked from its start, half back from its
    goal, and the halves meet in the middle. At every hop a walk goes on only to nodes from which
    the other ends can still be reached with the hops that are left; of at most two hops one is
    walked on either side, over the steps at the ends alone, and the halves' meeting is all that prunes them.
    """
    usable = edges.where(F.col("confidence") >= confidence)
    if relations:
        usable = usable.where(F.col("relation").isin(*relations))
    pairs = broadcast_if_few(pairs.select("start", "goal").distinct())
    starts, goals = (broadcast_if_few(pairs.select(F.col(end).alias("node")).distinct()) for end in ("start", "goal"))
    short = max_hops <= 2
    steps = both_directions(usable).select("at", "to", "edge_id", "relation", "confidence", "created_at", "conflicting")
    if short:
        # Every step of a trail this short leaves a start or reaches a goal.
        first, last = starts.select(F.col("node").alias("at"), F.lit(True).alias("__first")), goals.select(F.col("node").alias("to"), F.lit(True).alias("__last"))
        steps = steps.join(first, "at", "left").join(last, "to", "left").where("__first or __last").drop("__first", "__last")
    # Made once: each hop of either side reads it.
    steps = checkpointed(steps).select("at", "to", F.struct("edge_id", F.col("at").alias("from"), "to", "relation", "confidence", "created_at", "conflicting").alias("hop"))
    links = steps.select("at", "to")
    forth_hops, back_hops = -(-max_hops // 2), max_hops // 2

    def walk(ends: DataFrame, toward: DataFrame, hops: int, near: str, far: str, add, last_once: bool) -> list[DataFrame]:
        """Trails of 1 to `hops` steps from the ends: `end, here, hops`; what is read once only isn't written."""
        reach = None if short else _distances(toward, links, max_hops - 1)
        out, here = [], None
        for i in range(1, hops + 1):
            if here is None:
                here = ends.join(steps, F.col("node") == F.col(near)).select(F.col("node").alias("end"), F.col(far).alias("here"), F.array("hop").alias("hops"))
            else:
                met = here.join(steps, F.col("here") == F.col(near)).where(~F.exists("hops", lambda h: h["edge_id"] == F.col("hop.edge_id")))
                here = met.select("end", F.col(far).alias("here"), add(F.col("hops"), F.array("hop")).alias("hops"))
            if reach is not None:
                held = reach.where(F.col("far") <= max_hops - i).select(F.col("node").alias("here"))
                here = here.join(held, "here", "left_semi")
                here = here if i == hops and last_once else checkpointed(here)
            out.append(here)
        return out

    forth = walk(starts, goals, forth_hops, "at", "to", lambda hops, hop: F.concat(hops, hop), max_hops % 2 == 1)
    back = walk(goals, starts, back_hops, "to", "at", lambda hops, hop: F.concat(hop, hops), max_hops % 2 == 0)
    out = pairs.join(forth[0], (F.col("start") == F.col("end")) & (F.col("goal") == F.col("here"))).select("start", "goal", "hops")
    for hops in range(2, max_hops + 1):
        first = forth[-(-hops // 2) - 1].select(F.col("end").alias("start"), "here", F.col("hops").alias("first"))
        rest = back[hops // 2 - 1].select(F.col("end").alias("goal"), "here", F.col("hops").alias("rest"))
        if short:
            # Where the halves meet is found in few columns first, so only steps to and from there are dealt out in full.
            meet = pairs.join(first.select("start", "here").distinct(), "start").join(rest.select("goal", "here").distinct(), ["goal", "here"])
            meet = broadcast_if_few(meet.select("start", "goal", "here"))
            first, rest = first.join(meet, ["start", "here"], "left_semi"), rest.join(meet, ["goal", "here"], "left_semi")
        met = pairs.join(first, "start").join(rest, ["goal", "here"]).where(~F.exists("first", lambda h: F.exists("rest", lambda r: r["edge_id"] == h["edge_id"])))
        out = out.unionByName(met.select("start", "goal", F.concat("first", "rest").alias("hops")))
    return out


def path_conflicts(paths: DataFrame, edges: DataFrame) -> DataFrame:
    """`edge_id` of conflicting edges at the steps of the paths; only edges between the same two ends are compared.

    `edges` hold all edges between the ends of a step.
    """
    low, high = F.least("hop.from", "hop.to").alias("__low"), F.greatest("hop.from", "hop.to").alias("__high")
    ends = broadcast_if_few(paths.select(F.explode("hops").alias("hop")).select(low, high).distinct())
    between = edges.join(ends, (F.least("src", "dst") == F.col("__low")) & (F.greatest("src", "dst") == F.col("__high")), "left_semi")
    return broadcast_if_few(graph.flag_conflicts(checkpointed(between)).where("conflicting").select("edge_id"))


def rank_paths(paths: DataFrame, nodes: DataFrame, k: int = config.PATH_TOP, conflicts: DataFrame | None = None) -> DataFrame:
    """Paths of each (start, goal) by score: product of confidences and of the section weights of every hop's ends.

    One path for each set of edges in order; ties go to the latest edge, then to the edges' ids. Edges among `conflicts`
    (`edge_id`) are conflicting too.
    """
    weights = nodes.select("node_id", section_weight(F.map_keys("sections")).alias("weight"))
    placed = paths.select("start", "goal", "hops", F.concat_ws(",", F.transform("hops", lambda h: h["edge_id"])).alias("signature"))
    hops = placed.select("start", "goal", "signature", F.posexplode("hops").alias("i", "hop")).select("start", "goal", "signature", "i", "hop.*").dropDuplicates(["start", "goal", "signature", "i"])
    if conflicts is not None:
        hops = hops.join(conflicts.select("edge_id", F.lit(True).alias("__met")), "edge_id", "left").withColumn("conflicting", F.col("conflicting") | F.coalesce("__met", F.lit(False))).drop("__met")
    w1, w2 = weights.select(F.col("node_id").alias("from"), F.col("weight").alias("w1")), weights.select(F.col("node_id").alias("to"), F.col("weight").alias("w2"))
    scored = hops.join(w1, "from", "left").join(w2, "to", "left")
    factor = F.struct("i", (F.col("confidence") * F.coalesce("w1", F.lit(1.0)) * F.coalesce("w2", F.lit(1.0))).alias("f"))
    total = scored.groupBy("start", "goal", "signature").agg(
        F.aggregate(F.array_sort(F.collect_list(factor)), F.lit(1.0), lambda a, x: a * x["f"]).alias("score"),
        F.max("created_at").alias("latest"),
        F.max("conflicting").alias("conflicting"),
        F.count("*").alias("n_hops"),
    ).withColumn("score", F.round("score", 9))
    order = Window.partitionBy("start", "goal").orderBy(F.desc("score"), F.desc("latest"), "signature")
    return total.withColumn("k", F.row_number().over(order)).where(F.col("k") <= k)


def _within_best(met: DataFrame, k: int) -> DataFrame:
    """Steps that can be among the k best at their node (`at`): those of the classes of confidence and year that hold the k best."""
    # Both passes read the same columns of the edges, so Spark makes their shuffles once; the bars are one row a node.
    ranked = met.withColumn("__class", F.struct("confidence", F.coalesce(F.year("created_at"), F.lit(-(1 << 31)))))
    before = Window.partitionBy("at").orderBy(F.desc("__class")).rowsBetween(Window.unboundedPreceding, -1)
    classes = ranked.groupBy("at", "__class").agg(F.count("*").alias("n")).withColumn("better", F.coalesce(F.sum("n").over(before), F.lit(0)))
    bars = classes.where(F.col("better") < k).groupBy("at").agg(F.min("__class").alias("__bar"))
    return ranked.join(F.broadcast(bars), "at").where("__class >= __bar").select(met.columns)


def neighbours(asked: DataFrame, edges: DataFrame, confidence: float, k: int) -> DataFrame:
    """The k best edges at each asked node: confidence, then newest, then id.

    Up to FEW asked nodes have their edges counted by confidence and year first, and only those that can be among the k best are dealt out.
    """
    at = checkpointed(asked.select(F.col("node_id").alias("at")).distinct())
    few = at.count() <= FEW
    met = both_directions(edges.where(F.col("confidence") >= confidence)).join(F.broadcast(at) if few else at, "at")
    if few:
        met = _within_best(met, k)
    order = Window.partitionBy("at").orderBy(F.desc("confidence"), F.desc("created_at"), "edge_id")
    return met.withColumn("k", F.row_number().over(order)).where(F.col("k") <= k).select(F.col("at").alias("node_id"), F.col("to").alias("other"), "edge_id", "src", "dst", "relation", "confidence", "created_at", "doc_id", "k")


def document_edges(documents: DataFrame, edges: DataFrame, confidence: float, k: int) -> DataFrame:
    """Edges of each document (ids compared in lower case), each in both directions, the k best."""
    low = documents.select(F.lower("doc_id").alias("low")).distinct()
    met = both_directions(edges.where(F.col("confidence") >= confidence).withColumn("low", F.lower("doc_id")).join(low, "low", "left_semi"))
    order = Window.partitionBy("low").orderBy(F.desc("confidence"), F.desc("created_at"), "edge_id", "at")
    return met.withColumn("k", F.row_number().over(order)).where(F.col("k") <= k).select("doc_id", F.col("at").alias("node_id"), F.col("to").alias("other"), "edge_id", "relation", "confidence", "created_at", "k")


def _share(text: Column, words: Sequence[str]) -> Column:
    hits = F.lit(0)
    for w in words:
        hits = hits + F.contains(text, F.lit(w)).cast("int")
    return hits / F.lit(float(len(words)))


def question_documents(text: Column, prefixes: Sequence[str] = config.DOCUMENT_PREFIXES) -> Column:
    """Document ids that a question names, in order of prefixes, without repeats."""
    found = []
    for p in prefixes:
        found.append(F.regexp_extract_all(text, F.lit(rf"(?i){p}(?:[\s:=]+['\"]?)([A-Za-z0-9][A-Za-z0-9_.-]*)"), F.lit(1)))
        found.append(F.regexp_extract_all(text, F.lit(rf"(?i)({p}[-_][A-Za-z0-9][A-Za-z0-9_.-]*)"), F.lit(1)))
    words = F.regexp_extract_all(text, F.lit(r"([A-Za-z0-9][A-Za-z0-9_.-]{2,})"), F.lit(1))
    begins = F.filter(words, lambda w: F.lower(w).rlike("^(" + "|".join(prefixes) + ")"))

    def tidy(ids: Column) -> Column:
        return F.array_distinct(F.filter(F.transform(ids, lambda x: F.trim(x, F.lit(" '\".,;"))), lambda x: x != ""))

    named = tidy(F.concat(*found))
    return F.when(F.size(named) > 0, named).otherwise(tidy(begins))


def classify_intent(questions: DataFrame) -> DataFrame:
    """`question_id, intent, documents`: paper summary (only with a document named), cluster, entity, else factoid.

    Documents are what stands behind a prefix and blanks, `:` or `=`, and words of a prefix joined by `-`
    or `_`, prefix by prefix; where there are none, the words of three characters and more that begin
    with a prefix. Only paper summaries carry them.
    """
    low = F.lower("text")
    documents = question_documents(F.col("text"))
    share = {k: _share(low, words) for k, words in config.INTENT_KEYWORDS.items()}
    t = config.INTENT_THRESHOLDS
    intent = (
        F.when((share["paper"] >= t["paper"]) & (F.size(documents) > 0), "paper_summary")
        .when(share["cluster"] >= t["cluster"], "cluster_summary")
        .when(share["entity"] >= t["entity"], "entity_summary")
        .otherwise("factoid")
    )
    named = F.when(intent == "paper_summary", documents).otherwise(F.array().cast("array<string>"))
    return questions.select("question_id", intent.alias("intent"), named.alias("documents"))


def question_mentions(questions: DataFrame) -> DataFrame:
    """`question_id, mention, pos`: capitalised words that are no question words, once each case-insensitively, in order."""
    words = F.filter(F.regexp_extract_all("text", F.lit("[A-Z][A-Za-z0-9]+"), F.lit(0)), lambda w: ~F.lower(w).isin(*config.WH_WORDS))
    rows = questions.select("question_id", F.posexplode(words).alias("pos", "mention"))
    return rows.groupBy("question_id", F.lower("mention").alias("low")).agg(F.min(F.struct("pos", "mention")).alias("m")).select("question_id", F.col("m.mention").alias("mention"), F.col("m.pos").alias("pos"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, x: acc + x)


TOP_NODES = 500


def resolve_mentions(mentions: DataFrame, nodes: DataFrame, vectors: DataFrame, k: int = config.MENTION_TOP, least: float = config.MENTION_SIMILARITY) -> DataFrame:
    """`mention, node_id, similarity, k`: exact matches (similarity 1), else the nodes nearest by vector.

    Compared are the nodes whose name contains the mention or a word of it, or where there are none the
    TOP_NODES most seen nodes, a bounded table.
    `vectors` holds unit vectors of mentions and of lower-case names and aliases: `text, vector`.
    """
    exact = match_exact(mentions, nodes, k).select("mention", "node_id", "name", "times_seen", F.lit(1.0).alias("similarity"))
    left = mentions.select("mention").distinct().join(exact.select("mention").distinct(), "mention", "left_anti")
    candidates = match_contains(left, nodes, TOP_NODES).select("mention", "node_id")
    unmet = left.join(candidates.select("mention").distinct(), "mention", "left_anti")
    candidates = candidates.unionAll(unmet.crossJoin(F.broadcast(top_nodes(nodes, TOP_NODES).select("node_id"))))
    names = node_names(nodes).join(candidates, "node_id")
    v, w = vectors.select(F.col("text").alias("mention"), F.col("vector").alias("v")), vectors.select(F.col("text").alias("low"), F.col("vector").alias("w"))
    near = names.join(v, "mention").join(w, "low").groupBy("mention", "node_id", "name", "times_seen").agg(F.max(dot(F.col("v"), F.col("w"))).alias("similarity")).where(F.col("similarity") >= least)
    order = Window.partitionBy("mention").orderBy(F.desc("similarity"), F.desc("times_seen"), "name", "node_id")
    return exact.unionByName(near).withColumn("k", F.row_number().over(order)).where(F.col("k") <= k)


#: Nodes, pairs of nodes or documents that are sent to every task where the edges would be dealt out for each of them otherwise.
MOST_SENT = 1_000_000


def fallback_neighbours(questions: DataFrame, edges: DataFrame, k: int = config.PATH_TOP) -> DataFrame:
    """Edges at the nodes of each question (`question_id, node_id`): those of confidence 0.7 and more, else of 0.45 and more.

    One scan at the lower bar; the higher one is applied where a question has such an edge. The first
    edge of each (src, dst, relation) stays.
    """
    asked = broadcast_if_few(questions.select("question_id", F.col("node_id").alias("at")).distinct(), MOST_SENT)
    met = both_directions(edges.where(F.col("confidence") >= config.FALLBACK_CONFIDENCE)).join(asked, "at")
    strong = F.max((F.col("confidence") >= config.PATH_CONFIDENCE).cast("int")).over(Window.partitionBy("question_id"))
    kept = met.withColumn("strong", strong).where((F.col("strong") == 0) | (F.col("confidence") >= config.PATH_CONFIDENCE))
    first = kept.groupBy("question_id", "src", "dst", "relation").agg(F.min(F.struct((-F.col("confidence")).alias("c"), (-F.unix_micros("created_at")).alias("t"), "edge_id")).alias("b"))
    order = Window.partitionBy("question_id").orderBy("b")
    return first.withColumn("k", F.row_number().over(order)).where(F.col("k") <= k).select("question_id", "src", "dst", "relation", F.col("b.edge_id").alias("edge_id"), (-F.col("b.c")).alias("confidence"), "k")


def summary_neighbours(questions: DataFrame, edges: DataFrame, limit: int = config.SUMMARY_LIMIT, confidence: float = config.FALLBACK_CONFIDENCE) -> DataFrame:
    """Edges around a question's nodes: ceil(limit / nodes) for each node, then one for each (src, dst, relation, document), then `limit`."""
    asked = questions.select("question_id", "node_id").distinct()
    share = Window.partitionBy("question_id")
    asked = asked.withColumn("cap", F.ceil(F.lit(limit) / F.count("*").over(share)))
    near = neighbours(asked, edges, confidence, limit)
    met = asked.join(near, "node_id").where(F.col("k") <= F.col("cap"))
    first = met.groupBy("question_id", "src", "dst", "relation", "doc_id").agg(F.min(F.struct((-F.col("confidence")).alias("c"), (-F.unix_micros("created_at")).alias("t"), "edge_id")).alias("b"))
    return first.withColumn("n", F.row_number().over(share.orderBy("b"))).where(F.col("n") <= limit).select("question_id", "src", "dst", "relation", "doc_id", F.col("b.edge_id").alias("edge_id"), "n")


def summary_documents(questions: DataFrame, edges: DataFrame, limit: int = config.SUMMARY_LIMIT, confidence: float = config.FALLBACK_CONFIDENCE) -> DataFrame:
    """Edges of a question's documents (`question_id, doc_id`), one for each (src, dst, relation), `limit` of them."""
    near = document_edges(questions, edges, confidence, 2 * limit)
    met = questions.select("question_id", F.lower("doc_id").alias("low")).join(near.withColumn("low", F.lower("doc_id")), "low")
    first = met.groupBy("question_id", "edge_id", "relation").agg(F.max("confidence").alias("confidence"), F.max("created_at").alias("created_at"))
    order = Window.partitionBy("question_id").orderBy(F.desc("confidence"), F.desc("created_at"), "edge_id")
    return first.withColumn("n", F.row_number().over(order)).where(F.col("n") <= limit).select("question_id", "edge_id", "relation", "confidence", "n")


def answer_table(questions: DataFrame, ranked: DataFrame, fallback: DataFrame) -> DataFrame:
    """`question_id, mode, summary`: conflicting if a top path conflicts, direct with paths, insufficient without."""
    paths = ranked.groupBy("question_id").agg(F.count("*").alias("n_paths"), F.max("conflicting").alias("conflict"), F.min_by("signature", "k").alias("best"))
    near = fallback.groupBy("question_id").agg(F.count("*").alias("n_near"))
    joined = questions.select("question_id").join(paths, "question_id", "left").join(near, "question_id", "left")
    mode = F.when(F.col("n_paths").isNull(), "insufficient").when(F.col("conflict"), "conflicting").otherwise("direct")
    text = F.when(F.col("n_paths").isNotNull(), F.format_string("%d paths, best by edges %s", "n_paths", "best")).when(F.col("n_near").isNotNull(), F.format_string("no path; %d related findings", "n_near")).otherwise("no evidence")
    return joined.select("question_id", mode.alias("mode"), text.alias("summary"))


# Texts of summaries.
NO_ENTITY = "Unable to resolve any entities for the question."
NO_DOCUMENT = "Unable to identify which document to summarize."
NO_EVIDENCE = "Insufficient evidence to answer the question."
FINDING = "%s %s %s (doc %s, conf=%.2f)"
RELATED = "Insufficient evidence to answer. Related findings: %s"
PROFILE = "%s (similarity %.2f, seen %dx, sections: %s)"
PROFILES = "Insufficient evidence from graph relations. Known entity profiles: %s."
OF_ENTITY = "Summary for %s derived from %d graph findings."
OF_CLUSTER = "Cluster summary for %s derived from %d graph findings."
OF_DOCUMENTS = "Summary for documents %s derived from %d graph findings."
NOTHING_IN_DOCUMENTS = "No extracted findings available for documents: %s."


def _joined(rows: Column, separator: str = "; ") -> Column:
    """Texts of (place, text) pairs in order of place."""
    return F.array_join(F.transform(F.array_sort(rows), lambda r: r["text"]), separator)


def entity_profiles(candidates: DataFrame) -> DataFrame:
    """`question_id, primary, leading, profiles` from `question_id, pos, k, node_id, name, similarity, times_seen, sections`.

    primary is the candidate of the greatest similarity, leading the first three different nodes, profiles
    a line for the most similar candidate of each mention. Ties go to the earlier mention, then the smaller k.
    """
    sections = F.coalesce(F.nullif(F.array_join(F.array_sort("sections"), ", "), F.lit("")), F.lit("unknown sections"))
    line = F.format_string(PROFILE, "name", "similarity", "times_seen", sections)
    best = candidates.groupBy("question_id", "pos").agg(F.min(F.struct((-F.col("similarity")).alias("s"), "k", "name", line.alias("text"))).alias("b"))
    lines = best.groupBy("question_id").agg(
        F.min_by("b.name", F.struct("b.s", "pos")).alias("primary"),
        _joined(F.collect_list(F.struct("pos", F.col("b.text").alias("text")))).alias("profiles"),
    )
    nodes = candidates.groupBy("question_id", "node_id").agg(F.min(F.struct("pos", "k", "name")).alias("b"))
    order = Window.partitionBy("question_id").orderBy("b", "node_id")
    first = nodes.withColumn("place", F.row_number().over(order)).where("place <= 3")
    leading = first.groupBy("question_id").agg(_joined(F.collect_list(F.struct("place", F.col("b.name").alias("text"))), ", ").alias("leading"))
    return lines.join(leading, "question_id")


def answers(questions: DataFrame, candidates: DataFrame, paths: DataFrame, fallback: DataFrame, findings: DataFrame, k: int = config.PATH_TOP) -> DataFrame:
    """`question_id, mode, summary` by each question's `intent` and `documents`.

    `candidates` are those of entity_profiles; `paths` and `fallback` are edges (`question_id, k, src_name,
    relation, dst_name, doc_id, confidence`, paths also with their step `i` and `conflicting`); `findings`
    are the edges that a summary is made of. A summary without findings tells the profiles; entity and
    cluster questions without a candidate are answered as factoids.
    """
    text = F.format_string(FINDING, "src_name", "relation", "dst_name", "doc_id", "confidence").alias("text")
    best = paths.where(F.col("k") <= k).groupBy("question_id").agg(
        _joined(F.collect_list(F.when(F.col("k") == 1, F.struct("i", text)))).alias("path"), F.max(F.coalesce("conflicting", F.lit(False))).alias("conflict")
    )
    near = fallback.where(F.col("k") <= k).groupBy("question_id").agg(_joined(F.collect_list(F.struct("k", text))).alias("near"))
    counted = findings.groupBy("question_id").agg(F.count("*").alias("n"))
    rows = questions.select("question_id", "intent", F.array_join(F.coalesce("documents", F.array().cast("array<string>")), ", ").alias("named"))
    for part in (entity_profiles(candidates), best, near, counted):
        rows = rows.join(part, "question_id", "left")
    known, found = F.col("primary").isNotNull(), F.col("n").isNotNull()
    told = F.coalesce(F.format_string(PROFILES, F.nullif(F.col("profiles"), F.lit(""))), F.lit(NO_EVIDENCE))
    told = F.when(known, told).otherwise(NO_EVIDENCE)
    factoid = F.when(~known, NO_ENTITY).when(F.col("path").isNotNull(), F.col("path")).when(F.col("near").isNotNull(), F.format_string(RELATED, "near")).otherwise(told)
    paper = F.when(F.col("named") == "", NO_DOCUMENT).when(found, F.format_string(OF_DOCUMENTS, "named", "n")).otherwise(F.format_string(NOTHING_IN_DOCUMENTS, "named"))
    is_paper = F.col("intent") == "paper_summary"
    is_summary = F.col("intent").isin("entity_summary", "cluster_summary") & known
    of_nodes = F.when(~found, told).when(F.col("intent") == "entity_summary", F.format_string(OF_ENTITY, "primary", "n")).otherwise(F.format_string(OF_CLUSTER, "leading", "n"))
    direct = F.when(is_paper, found & (F.col("named") != "")).when(is_summary, found).otherwise(known & F.col("path").isNotNull())
    mode = F.when(~direct, "insufficient").when(~is_paper & ~is_summary & F.col("conflict"), "conflicting").otherwise("direct")
    return rows.select("question_id", mode.alias("mode"), F.when(is_paper, paper).when(is_summary, of_nodes).otherwise(factoid).alias("summary"))


def answer_context(evidence: DataFrame) -> DataFrame:
    """`question_id, documents, prompt` from `question_id, n, src, dst, relation, doc_id`: numbered lines in order, each with its document."""
    line = F.struct("n", F.concat_ws("", F.col("n").cast("string"), F.lit(". "), "src", F.lit(" "), "relation", F.lit(" "), "dst", F.lit(" ["), "doc_id", F.lit("]")).alias("text"))
    grouped = evidence.groupBy("question_id").agg(F.array_sort(F.collect_set("doc_id")).alias("documents"), F.array_sort(F.collect_list(line)).alias("lines"))
    return grouped.select("question_id", "documents", F.array_join(F.transform("lines", lambda x: x["text"]), "\n").alias("prompt"))


def evidence_prompt(questions: DataFrame, paths: DataFrame, near: DataFrame) -> DataFrame:
    """`question_id, documents, prompt`: what a model is shown for each question (`question_id, text`).

    Edges of `paths` are numbered by path and step (`k, i`), those of `near` by `k`; both have src_name, relation, dst_name,
    doc_id, citation, confidence and sentence (null: none). documents are those of all edges shown, in order. A question
    without evidence says so.
    """

    def line(number: Column) -> Column:
        said = F.coalesce(F.concat(F.lit(": "), "sentence"), F.lit(""))
        return F.concat(number, F.lit(" "), F.concat_ws(" ", "src_name", "relation", "dst_name"), F.format_string(" [%s] (%.2f)", "citation", "confidence"), said)

    steps = paths.select("question_id", "doc_id", F.struct(F.lit(0).alias("part"), "k", "i", line(F.concat(F.lit("path "), F.col("k").cast("string"), F.lit("."), (F.col("i") + 1).cast("string"))).alias("text")).alias("line"))
    others = near.select("question_id", "doc_id", F.struct(F.lit(1).alias("part"), "k", F.lit(0).alias("i"), line(F.concat(F.lit("near "), F.col("k").cast("string"))).alias("text")).alias("line"))
    shown = steps.unionByName(others).groupBy("question_id").agg(F.array_sort(F.collect_set("doc_id")).alias("documents"), F.array_sort(F.collect_list("line")).alias("lines"))
    rows = questions.select("question_id", "text").join(shown, "question_id", "left")
    body = F.coalesce(F.array_join(F.transform("lines", lambda x: x["text"]), "\n"), F.lit("no evidence"))
    prompt = F.concat(F.lit("Question: "), F.coalesce("text", F.lit("")), F.lit("\n"), body)
    return rows.select("question_id", F.coalesce("documents", F.array().cast("array<string>")).alias("documents"), prompt.alias("prompt"))


def ask(questions: DataFrame, nodes: DataFrame, edges: DataFrame, vectors: DataFrame, max_hops: int = 2, k: int = config.PATH_TOP, flag: bool = False) -> DataFrame:
    """`question_id, intent, mode, summary, documents, prompt` for a whole table of questions `question_id, text`.

    Mentions are resolved to nodes; each two mentions' candidates are joined by ranked paths, the best k of a question
    count; a question without a path falls back on edges at its nodes. Summaries take the edges around the best candidate
    (entity), all candidates (cluster) or of the documents named (paper). Edges have `edge_id, src, dst, relation, confidence,
    created_at, doc_id, conflicting, citation, sentence`; nodes `node_id, name, aliases, times_seen, sections`; vectors as
    in `resolve_mentions`. The edges that can count, candidates and the chosen evidence are each made once and read by what follows.
    With `flag` the conflicts of the trails' edges are looked up here, so `edges` need not come with all conflicts flagged.
    """
    intents = checkpointed(classify_intent(questions))
    mentions = question_mentions(questions)
    resolved = resolve_mentions(mentions.select("mention").distinct(), nodes, vectors)
    held = nodes.select("node_id", F.map_keys("sections").alias("sections"))
    candidates = mentions.join(resolved, "mention").join(held, "node_id").select("question_id", "pos", "k", "node_id", "name", "similarity", "times_seen", "sections")
    candidates = checkpointed(candidates)
    of_papers = intents.where("intent = 'paper_summary'").select("question_id", F.explode("documents").alias("doc_id"))
    one, two = candidates.select("question_id", "pos", F.col("node_id").alias("start")), candidates.select("question_id", F.col("pos").alias("later"), F.col("node_id").alias("goal"))
    pairs = checkpointed(one.join(two, "question_id").where("pos < later and start <> goal").select("question_id", "start", "goal").distinct())
    first = Window.partitionBy("question_id").orderBy(F.desc("similarity"), "pos", "k")
    best = candidates.withColumn("__first", F.row_number().over(first)).join(intents.select("question_id", "intent"), "question_id")
    around = best.where("intent = 'cluster_summary' or intent = 'entity_summary' and __first = 1").select("question_id", "node_id")
    edges = edges.select("edge_id", "src", "dst", "relation", "confidence", "created_at", "doc_id", "conflicting", "citation", "sentence")
    if max_hops <= 2:
        edges = edges_that_count(edges, candidates, pairs, around, of_papers, k)
    kept = scratch(edges.sparkSession)
    with shuffles_freed(edges.sparkSession):
        edges.select("*").write.parquet(kept)
    edges = edges.sparkSession.read.schema(edges.schema).parquet(kept)
    found = checkpointed(find_paths(pairs.select("start", "goal"), edges, max_hops))
    conflicts = path_conflicts(found, edges) if flag else None
    ranked = pairs.join(rank_paths(found, nodes, k, conflicts), ["start", "goal"]).dropDuplicates(["question_id", "signature"])
    order = Window.partitionBy("question_id").orderBy(F.desc("score"), F.desc("latest"), "signature")
    ranked = ranked.withColumn("k", F.row_number().over(order)).where(F.col("k") <= k)
    named = nodes.select("node_id", "name")
    src, dst = named.select(F.col("node_id").alias("src"), F.col("name").alias("src_name")), named.select(F.col("node_id").alias("dst"), F.col("name").alias("dst_name"))
    details = edges.select("edge_id", "src", "dst", "relation", "doc_id", "confidence", F.coalesce("conflicting", F.lit(False)).alias("conflicting"), "citation", "sentence")

    def told(rows: DataFrame) -> DataFrame:
        """Rows with an `edge_id` and all that is said of the edge."""
        full = rows.join(details, "edge_id").join(src, "src", "left").join(dst, "dst", "left")
        return full.withColumns({"src_name": F.coalesce("src_name", "src"), "dst_name": F.coalesce("dst_name", "dst")}).drop("src", "dst")

    steps = ranked.select("question_id", "k", F.posexplode(F.split("signature", ",")).alias("i", "edge_id"))
    steps = told(broadcast_if_few(steps))
    if conflicts is not None:
        steps = steps.join(conflicts.select("edge_id", F.lit(True).alias("__met")), "edge_id", "left").withColumn("conflicting", F.col("conflicting") | F.coalesce("__met", F.lit(False))).drop("__met")
    steps = checkpointed(steps)
    without = candidates.join(steps.select("question_id").distinct(), "question_id", "left_anti")
    near = checkpointed(told(fallback_neighbours(without, edges, k).select("question_id", "k", "edge_id")))
    findings = summary_neighbours(around, edges).select("question_id", "edge_id").unionByName(summary_documents(of_papers, edges).select("question_id", "edge_id"))
    mode = answers(intents, candidates, steps, near, findings, k)
    shown = evidence_prompt(questions, steps, near)
    return intents.select("question_id", "intent").join(mode, "question_id").join(shown, "question_id")


def _rank_class() -> Column:
    """Confidence and year; an edge of a greater class comes first wherever edges are ranked, but for those without a date."""
    return F.struct("confidence", F.coalesce(F.year("created_at"), F.lit(-(1 << 31))).alias("year"))


def edges_that_count(edges: DataFrame, asked: DataFrame, pairs: DataFrame, around: DataFrame, documents: DataFrame, k: int, limit: int = config.SUMMARY_LIMIT) -> DataFrame:
    """The edges that answers can depend on, and a few more: what is ranked, joined or counted in `ask` is the same with all edges.

    These are the edges at asked nodes (`node_id`) that can be among the best k of different (src, dst, relation), or at nodes
    `around` among the best `limit`; all edges between the ends of a step of a trail of two hops at most for a pair
    (`start, goal`); and those of the documents. The edges, which may be dear to make and to keep, are read
    twice: nodes' classes of confidence and year and what both ends of a pair reach are found first, in one shuffle.
    """
    step = ["src", "dst", "relation", "confidence", "created_at"]
    pairs = checkpointed(pairs.select("start", "goal").distinct()).withColumn("__pair", F.monotonically_increasing_id())
    uses = asked.select(F.col("node_id").alias("at"), F.lit(None).cast("long").alias("__pair"), F.lit(0).alias("__side")).distinct()
    for end, side in (("start", 1), ("goal", 2)):
        uses = uses.unionByName(pairs.select(F.col(end).alias("at"), "__pair", F.lit(side).alias("__side")))
    uses = broadcast_if_few(uses.groupBy("at").agg(F.collect_list(F.struct("__pair", "__side")).alias("__uses")), MOST_SENT)
    # A bit for each of 128 kinds of edges: as many bits as are set, so many different ones there are at least.
    kind = F.pmod(F.xxhash64("src", "dst", "relation"), F.lit(128)).cast("int")
    low, high = (F.when(kind.between(at, at + 63), F.call_function("shiftleft", F.lit(1).cast("long"), kind - at)).otherwise(0) for at in (0, 64))
    met = both_directions(edges.select(*step).where(F.col("confidence") >= min(config.FALLBACK_CONFIDENCE, config.PATH_CONFIDENCE))).join(uses, "at")
    met = met.select("*", F.explode("__uses").alias("__use")).select("*", "__use.*")
    is_end = F.col("__side") > 0
    met = met.where(F.when(is_end, F.col("confidence") >= config.PATH_CONFIDENCE).otherwise(F.col("confidence") >= config.FALLBACK_CONFIDENCE))
    met = met.select(F.when(is_end, F.col("to")).otherwise(F.col("at")).alias("node"), "__pair", F.when(~is_end, _rank_class()).alias("class"), F.when(is_end, F.col("__side").cast("long")).otherwise(low).alias("low"), F.when(is_end, 0).otherwise(high).alias("high"))
    counted = met.groupBy("node", "__pair", "class").agg(F.count("*").alias("n"), F.bit_or("low").alias("low"), F.bit_or("high").alias("high")).where("__pair is null or low = 3")
    before = Window.partitionBy("node", "__pair").orderBy(F.desc("class")).rowsBetween(Window.unboundedPreceding, -1)
    kinds = [F.bit_count(F.coalesce(F.bit_or(bits).over(before), F.lit(0))) for bits in ("low", "high")]
    counted = counted.withColumns({"better": F.coalesce(F.sum("n").over(before), F.lit(0)), "kinds": kinds[0] + kinds[1]})
    far = around.select(F.col("node_id").alias("node"), F.lit(limit).alias("most")).distinct()
    counted = counted.join(broadcast_if_few(far, MOST_SENT), "node", "left")
    with shuffles_freed(edges.sparkSession):
        found = checkpointed(counted.where((F.col("kinds") < k) | (F.col("better") < F.coalesce("most", F.lit(0)))).groupBy("node", "__pair").agg(F.min("class").alias("bar")))
    bars = broadcast_if_few(found.where("__pair is null").select("node", "bar"), MOST_SENT)
    reached = found.where("__pair is not null").join(pairs, "__pair")
    between = pairs.select(F.col("start").alias("a"), F.col("goal").alias("b")).unionByName(reached.select(F.col("start").alias("a"), F.col("node").alias("b"))).unionByName(reached.select(F.col("goal").alias("a"), F.col("node").alias("b")))
    between = broadcast_if_few(between.select(F.least("a", "b").alias("__low"), F.greatest("a", "b").alias("__high")).distinct(), MOST_SENT)
    named = broadcast_if_few(documents.select(F.lower("doc_id").alias("__doc")).distinct(), MOST_SENT)
    out, held = edges, F.lit(False)
    for end in ("src", "dst"):
        out = out.join(bars.select(F.col("node").alias(f"__{end}"), F.col("bar").alias(f"__bar_{end}")), F.col(end) == F.col(f"__{end}"), "left")
        # Of edges without a date some rankings take the first, others the last.
        held = held | (_rank_class() >= F.col(f"__bar_{end}")) | F.col("created_at").isNull() & (F.col("confidence") >= F.col(f"__bar_{end}.confidence"))
    out = out.join(between, (F.least("src", "dst") == F.col("__low")) & (F.greatest("src", "dst") == F.col("__high")), "left")
    out = out.join(named, F.lower("doc_id") == F.col("__doc"), "left")
    return out.where(held | F.col("__low").isNotNull() | F.col("__doc").isNotNull()).select(*edges.columns)


def citation_check(answers: DataFrame, evidence: DataFrame) -> DataFrame:
    """`question_id, cited, valid`: [doc:element] tokens of an answer, and how many of them are in its evidence (`question_id, citation`)."""
    rows = answers.select("question_id", F.explode_outer(F.regexp_extract_all("answer", F.lit(r"\[([^\]\[]+:[^\]\[]+)\]"), F.lit(1))).alias("citation"))
    known = evidence.select("question_id", "citation").distinct().withColumn("ok", F.lit(1))
    return rows.join(known, ["question_id", "citation"], "left").groupBy("question_id").agg(F.count("citation").alias("cited"), F.coalesce(F.sum("ok"), F.lit(0)).alias("valid"))
