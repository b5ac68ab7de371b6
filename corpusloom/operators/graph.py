"""Network operators: projections, centrality, structural holes, components. Edges: src, dst, weight."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.storage import cut as checkpointed


def project(memberships: DataFrame, max_group_size: int = 50) -> DataFrame:
    """(a, b, weight, groups): members that share groups, groups over a size being left out by contract."""
    rows = memberships.select("member", "grp").distinct()
    small = rows.groupBy("grp").agg(F.count("*").alias("n")).filter(F.col("n") <= max_group_size).select("grp")
    rows = rows.join(small, "grp", "left_semi")
    a, b = rows.alias("a"), rows.alias("b")
    pairs = a.join(b, (F.col("a.grp") == F.col("b.grp")) & (F.col("a.member") < F.col("b.member")))
    return pairs.groupBy(F.col("a.member").alias("a"), F.col("b.member").alias("b")).agg(F.count("*").alias("weight"), F.array_sort(F.collect_list(F.col("a.grp"))).alias("groups"))


def citation_graph(references: DataFrame, min_citations: int = 2) -> DataFrame:
    """(src, dst, kind): internal citations once each, and external works that enough documents cite."""
    internal = references.filter("cited is not null").select(F.col("doc").alias("src"), F.col("cited").cast("string").alias("dst"), F.lit("internal").alias("kind")).distinct()
    outside = references.filter("cited is null and key is not null").select(F.col("doc").alias("src"), F.col("key").alias("dst")).distinct()
    known = outside.groupBy("dst").agg(F.count("*").alias("n")).filter(F.col("n") >= min_citations).select("dst")
    return internal.unionByName(outside.join(known, "dst", "left_semi").select("src", "dst", F.lit("external").alias("kind")))


def undirected(edges: DataFrame) -> DataFrame:
    """Simple undirected edges; of both directions the weight that comes first by (src, dst) counts; loops go."""
    rows = edges.filter("src <> dst").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"), F.struct("src", "dst").alias("o"), "weight")
    return rows.groupBy("a", "b").agg(F.min_by("weight", "o").alias("weight"))


def degrees(und: DataFrame) -> DataFrame:
    both = und.select("a", "weight").unionByName(und.select(F.col("b").alias("a"), "weight"))
    return both.groupBy(F.col("a").alias("node")).agg(F.count("*").alias("degree"), F.sum("weight").alias("strength"))


def pagerank(edges: DataFrame, alpha: float = 0.85, rounds: int = 200, tol: float = 1e-9) -> DataFrame:
    """(node, rank): weighted, dangling mass spread evenly; stops when the ranks move less than tol each on average."""
    nodes = checkpointed(edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct())
    n = nodes.count()
    out = edges.groupBy("src").agg(F.sum("weight").alias("total"))
    share = checkpointed(edges.join(out, "src").select("src", "dst", (F.col("weight") / F.col("total")).alias("share")))
    lost = checkpointed(nodes.join(out.select(F.col("src").alias("node")), "node", "left_anti"))
    ranks = nodes.withColumn("rank", F.lit(1.0 / n))
    for _ in range(rounds):
        dangling = ranks.join(lost, "node", "left_semi").agg(F.sum("rank")).first()[0] or 0.0
        got = share.join(ranks.withColumnRenamed("node", "src"), "src").groupBy(F.col("dst").alias("node")).agg(F.sum(F.col("share") * F.col("rank")).alias("got"))
        base = (1 - alpha) / n + alpha * dangling / n
        new = checkpointed(ranks.join(got, "node", "left").select("node", F.col("rank").alias("old"), (base + alpha * F.coalesce("got", F.lit(0.0))).alias("rank")))
        moved = new.agg(F.sum(F.abs(F.col("rank") - F.col("old")))).first()[0]
        ranks = new.select("node", "rank")
        if moved < tol * n:
            break
    return ranks


def components(und: DataFrame) -> DataFrame:
    """(node, component) by label propagation with pointer jumping; a round doubles how far the smallest label travels."""
    links = checkpointed(und.select("a", "b").union(und.select("b", "a")).toDF("a", "b").distinct())
    labels = links.groupBy(F.col("a").alias("node")).agg(F.least(F.min("a"), F.min("b")).alias("component"))
    while True:
        near = links.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near"))
        step = labels.join(near, "node").select("node", F.least("component", "near").alias("component"), F.col("component").alias("old"))
        jump = step.select(F.col("node").alias("component"), F.col("component").alias("root"))
        new = checkpointed(step.join(jump, "component", "left").select("node", F.coalesce("root", "component").alias("component"), "old"))
        labels = new.select("node", "component")
        if new.filter("component <> old").isEmpty():
            return labels


def structural_holes(und: DataFrame) -> DataFrame:
    """(node, constraint, effective_size): Burt's measures on the weighted graph, by joins over two-step paths."""
    e = und.select("a", "b", "weight").unionByName(und.select(F.col("b").alias("a"), F.col("a").alias("b"), "weight"))
    total = e.groupBy("a").agg(F.sum("weight").alias("t"))
    p = checkpointed(e.join(total, "a").select("a", "b", (F.col("weight") / F.col("t")).alias("p")))
    x, y = p.alias("x"), p.alias("y")
    two = x.join(y, F.col("x.b") == F.col("y.a")).filter(F.col("x.a") != F.col("y.b")).groupBy(F.col("x.a").alias("a"), F.col("y.b").alias("b")).agg(F.sum(F.col("x.p") * F.col("y.p")).alias("via"), F.count("*").alias("paths"))
    near = p.join(two, ["a", "b"], "left")
    out = near.groupBy(F.col("a").alias("node")).agg(F.sum(F.pow(F.col("p") + F.coalesce("via", F.lit(0.0)), 2)).alias("constraint"), (F.count("*") - F.sum(F.coalesce("paths", F.lit(0))) / F.count("*")).alias("effective_size"))
    return out.select("node", F.round("constraint", 9).alias("constraint"), F.round("effective_size", 9).alias("effective_size"))


def betweenness(und: DataFrame, sources: int = 200, seed: int = 42) -> DataFrame:
    """(node, betweenness): Brandes' hop counts from up to `sources` start nodes, chosen by a seeded hash and scaled up.

    The adjacency goes to every task, so this is for graphs of a bounded size (the caller's top nodes)."""
    import pandas as pd

    adjacency: dict[int, list[int]] = {}
    for r in und.select("a", "b").collect():
        adjacency.setdefault(r.a, []).append(r.b)
        adjacency.setdefault(r.b, []).append(r.a)
    spark, n = und.sparkSession, len(adjacency)
    shared = spark.sparkContext.broadcast(adjacency)
    starts = spark.createDataFrame([(k,) for k in sorted(adjacency)], "node long").orderBy(F.xxhash64(F.lit(seed), "node"), "node").limit(sources if n > 500 else n)

    def accumulate(batches):
        adj = shared.value
        for pdf in batches:
            total: dict[int, float] = {}
            for s in pdf["node"]:
                order, parents, paths, depth, queue = [], {s: []}, {s: 1.0}, {s: 0}, [s]
                for v in queue:
                    order.append(v)
                    for w in adj[v]:
                        if w not in depth:
                            depth[w] = depth[v] + 1
                            queue.append(w)
                        if depth[w] == depth[v] + 1:
                            paths[w] = paths.get(w, 0.0) + paths[v]
                            parents.setdefault(w, []).append(v)
                back = dict.fromkeys(order, 0.0)
                for w in reversed(order):
                    for v in parents[w]:
                        back[v] += paths[v] / paths[w] * (1 + back[w])
                    if w != s:
                        total[w] = total.get(w, 0.0) + back[w]
            yield pd.DataFrame({"node": list(total), "part": list(total.values())})

    scale = n / max(1, min(n, sources if n > 500 else n)) / max(1, (n - 1) * (n - 2))
    found = starts.mapInPandas(accumulate, "node long, part double").groupBy("node").agg(F.sum("part").alias("s"))
    return starts.sparkSession.createDataFrame([(k,) for k in sorted(adjacency)], "node long").join(found, "node", "left").select("node", F.round(F.coalesce("s", F.lit(0.0)) * scale, 9).alias("betweenness"))


def communities(und: DataFrame, rounds: int = 10) -> DataFrame:
    """(node, community) by weighted label propagation, ties to the smallest label; deterministic."""
    e = checkpointed(und.select("a", "b", "weight").unionByName(und.select(F.col("b").alias("a"), F.col("a").alias("b"), "weight")))
    labels = e.select(F.col("a").alias("node")).distinct().withColumn("community", F.col("node"))
    for k in range(rounds):
        votes = e.join(labels.withColumnRenamed("node", "b"), "b").groupBy("a", "community").agg(F.sum("weight").alias("w"))
        best = votes.groupBy(F.col("a").alias("node")).agg(F.min_by("community", F.struct((-F.col("w")).alias("w"), "community")).alias("best"))
        # Half of the nodes move in a round, so that two neighbours do not swap labels for ever.
        moves = F.pmod(F.xxhash64("node", F.lit(k)), F.lit(2)) == 0
        new = checkpointed(labels.join(best, "node").select("node", F.when(moves, F.col("best")).otherwise(F.col("community")).alias("community"), (F.col("best") != F.col("community")).alias("moved")))
        labels = new.select("node", "community")
        if new.filter("moved").isEmpty():
            break
    return labels


def modularity(und: DataFrame, labels: DataFrame) -> DataFrame:
    la, lb = labels.select(F.col("node").alias("a"), F.col("community").alias("ca")), labels.select(F.col("node").alias("b"), F.col("community").alias("cb"))
    rows = und.join(la, "a").join(lb, "b")
    m = und.agg(F.sum("weight").alias("m")).first().m
    inside = rows.filter("ca = cb").groupBy(F.col("ca").alias("c")).agg(F.sum("weight").alias("inside"))
    degree = degrees(und).join(labels, "node").groupBy(F.col("community").alias("c")).agg(F.sum("strength").alias("d"))
    return degree.join(inside, "c", "left").agg(F.round(F.sum(F.coalesce("inside", F.lit(0)) / m - F.pow(F.col("d") / (2 * m), 2)), 9).alias("modularity"))


def distinctive_terms(node_terms: DataFrame, labels: DataFrame, k: int = 3) -> DataFrame:
    """The k terms of each community with the largest share inside less the share outside."""
    rows = node_terms.select("node", "term").distinct().join(labels, "node")
    inside = rows.groupBy("community", "term").agg(F.count("*").alias("i"))
    total = rows.groupBy("term").agg(F.count("*").alias("t"))
    size = labels.groupBy("community").agg(F.count("*").alias("n"))
    n = labels.count()
    s = inside.join(total, "term").join(size, "community").withColumn("score", F.round(F.col("i") / F.col("n") - (F.col("t") - F.col("i")) / F.greatest(F.lit(1), n - F.col("n")), 6))
    return s.withColumn("k", F.row_number().over(Window.partitionBy("community").orderBy(F.desc("score"), "term"))).filter(F.col("k") <= k).select("community", "term", "score")


def eigenvector(und: DataFrame, rounds: int = 2000, tol: float = 1e-8) -> DataFrame:
    """(node, centrality): power iteration within each component, scaled by the component's share of the nodes.

    Stops when in every component the values move less than tol each on average."""
    comp = components(und)
    n = comp.count()
    size = checkpointed(comp.groupBy("component").agg(F.count("*").alias("size")))
    share = size.select("component", (F.col("size") / n).alias("share"))
    e = checkpointed(und.select("a", "b", "weight").unionByName(und.select(F.col("b").alias("a"), F.col("a").alias("b"), "weight")))
    x = comp.select("node", "component", F.lit(1.0).alias("x")).join(size, "component").withColumn("x", 1 / F.sqrt("size")).drop("size")
    for _ in range(rounds):
        got = e.join(x.select(F.col("node").alias("b"), "x"), "b").groupBy(F.col("a").alias("node")).agg(F.sum(F.col("weight") * F.col("x")).alias("y"))
        y = x.join(got, "node").select("node", "component", F.col("x").alias("old"), (F.col("x") + F.col("y")).alias("y"))  # A + I: also converges on bipartite parts
        norm = y.groupBy("component").agg(F.sqrt(F.sum(F.col("y") * F.col("y"))).alias("norm"))
        new = checkpointed(y.join(norm, "component").select("node", "component", "old", (F.col("y") / F.col("norm")).alias("x")))
        x = new.select("node", "component", "x")
        moved = new.groupBy("component").agg(F.sum(F.abs(F.col("x") - F.col("old"))).alias("moved"))
        if moved.join(size, "component").filter(F.col("moved") >= tol * F.col("size")).isEmpty():
            break
    return x.join(share, "component").select("node", (F.col("x") * F.col("share")).alias("centrality"))
