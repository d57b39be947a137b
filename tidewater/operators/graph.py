"""Connected components and cluster operators on edge tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir; where it is unset, a temporary one in local mode, else an error."""
    sc = spark.sparkContext
    where = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not where:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        where = f"file://{tempfile.mkdtemp(prefix='tidewater-')}"
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(where)
    return where.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """Write to the checkpoint folder, so the loop's plan stays short and survives lost executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame, what: str = "rows") -> DataFrame:
    """Write the rows to the shared folder once, as Parquet, and go on from the copy: cheaper than ``cut`` where later plans read some columns."""
    path = f"{shared_dir(df.sparkSession)}/{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def parts_for(rows: DataFrame, each: int) -> int:
    """As many partitions as let a task hold about ``each`` of the rows, and no fewer than the session's."""
    return max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // each))


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(id, component) for every vertex with an edge; the component is its smallest vertex.

    Each round a vertex points to the smallest among itself and its neighbours, pointers are
    followed to their ends, and what points to one end becomes one vertex.  Only edges
    between different ends go on to the next round.  Two rounds at least halve the vertices.
    Null ends are ignored.  An empty edge table gives no rows.
    """
    pairs = edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).filter("a IS NOT NULL AND b IS NOT NULL")
    left = cut(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    found = None
    while True:
        ends = left.select(F.col("a").alias("id"), F.col("a").alias("label")).unionByName(left.select(F.col("b").alias("id"), F.col("a").alias("label")))
        labels = cut(ends.groupBy("id").agg(F.min("label").alias("label")))
        while True:
            over = labels.select(F.col("id").alias("label"), F.col("label").alias("over"))
            step = cut(labels.join(over, "label").select("id", "label", "over"))
            if not step.filter("over <> label").limit(1).count():
                break
            labels = step.select("id", F.col("over").alias("label"))
        if found is None:
            found = labels
        else:
            later = labels.select(F.col("id").alias("label"), F.col("label").alias("over"))
            found = cut(found.join(later, "label", "left").select("id", F.coalesce("over", "label").alias("label")))
        own = left.join(labels.select(F.col("id").alias("a"), F.col("label").alias("la")), "a").join(labels.select(F.col("id").alias("b"), F.col("label").alias("lb")), "b")
        left = cut(own.filter("la <> lb").select(F.least("la", "lb").alias("a"), F.greatest("la", "lb").alias("b")).distinct())
        if not left.limit(1).count():
            return found.withColumnRenamed("label", "component")


def merge_count(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """How many merges the edges make: vertices less components."""
    return connected_components(edges, src, dst).agg((F.count("*") - F.countDistinct("component")).alias("merges"))


def component_sizes(vertices: DataFrame, edges: DataFrame, vertex: str = "id") -> DataFrame:
    """(component, size), vertices without an edge included."""
    found = connected_components(edges)
    rows = vertices.select(F.col(vertex).alias("id")).join(found, "id", "left")
    return rows.groupBy(F.coalesce("component", "id").alias("component")).agg(F.count("*").alias("size"))


def shared_key_edges(rows: DataFrame, window: str, item: str, key: str) -> DataFrame:
    """Edges (window, a, b, weight 0) between items of a window that share a key."""
    a = rows.select(window, key, F.col(item).alias("a"))
    b = rows.select(window, key, F.col(item).alias("b"))
    return a.join(b, [window, key]).filter("a < b").select(window, "a", "b", F.lit(0.0).alias("weight")).distinct()


def key_stars(rows: DataFrame, window: str, item: str, key: str, cap: int = 8) -> DataFrame:
    """G01 on G06: add ``cluster``, what seed_star gives over shared_key_edges where each item stands in one row.

    Items of a window with one key are then all neighbours, equally strong, and of nobody
    else: the rule takes them newest first, ``cap`` at a time.  No edge is made.
    """
    place = F.floor((F.row_number().over(Window.partitionBy(window, key).orderBy(F.desc(item))) - 1) / cap)
    placed = rows.withColumn("_chunk", place)
    return placed.withColumn("cluster", F.when(F.col(key).isNull(), F.col(item)).otherwise(F.max(item).over(Window.partitionBy(window, key, "_chunk")))).drop("_chunk")


#: Edge rows of a component (or of several small ones) that one task clusters by itself.
MOST_EDGE_ROWS = 200_000


def _sequential(edges: DataFrame, bucket: Column, window: str, cap: int, transitive: bool) -> DataFrame:
    """The rule as it is told, item by item, over whole components: rows of edges (window, a, b, weight) both ways."""
    import pandas as pd

    kind = edges.schema[window].dataType.simpleString()

    def cluster(group: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple] = []
        for name, own in group.groupby(window, dropna=False, sort=False):
            near: dict[int, list[tuple[float, int]]] = {}
            for a, b, w in zip(own["a"].tolist(), own["b"].tolist(), own["weight"].tolist()):
                near.setdefault(a, []).append((-w, -b))
            of: dict[int, int] = {}
            for seed in sorted(near, reverse=True):
                if seed in of:
                    continue
                of[seed], size, waiting = seed, 1, [seed]
                for node in waiting:
                    for _, other in sorted(near[node]):
                        if size < cap and -other not in of:
                            of[-other], size = seed, size + 1
                            if transitive:
                                waiting.append(-other)
                    if size >= cap:
                        break
            out += [(name, a, c) for a, c in of.items()]
        return pd.DataFrame(out, columns=[window, "item", "cluster"])

    return edges.select(bucket.alias("_bucket"), window, "a", "b", "weight").groupBy("_bucket").applyInPandas(lambda g: cluster(g), f"`{window}` {kind}, item long, cluster long")


def _ready_seeds(edges: DataFrame, window: str, hops: int) -> DataFrame:
    """(window, seed): items newer than all others within so many hops; what they take doesn't depend on the rest."""
    best = edges.select(window, "a").distinct().withColumn("m", F.col("a"))
    for _ in range(hops):
        near = edges.join(best.select(window, F.col("a").alias("b"), "m"), [window, "b"]).groupBy(window, "a").agg(F.max("m").alias("_n"))
        best = cut(best.join(near, [window, "a"], "left").select(window, "a", F.greatest("m", F.coalesce("_n", "m")).alias("m")))
    return best.filter("a = m").select(window, F.col("a").alias("seed"))


def _taken_by(seeds: DataFrame, edges: DataFrame, window: str, cap: int, levels: int) -> DataFrame:
    """(window, item, seed): what each seed takes, level by level, in the rule's order; no two seeds reach one item."""
    taken = cut(seeds.select(window, F.col("seed").alias("item"), "seed", F.lit(0).alias("place")))
    front = taken
    for _ in range(levels):
        met = front.withColumnRenamed("item", "a").join(edges, [window, "a"]).groupBy(window, "seed", F.col("b").alias("item")).agg(F.min(F.struct("place", -F.col("weight"), -F.col("b"))).alias("_o"))
        met = met.join(taken.select(window, "seed", "item"), [window, "seed", "item"], "left_anti")
        sizes = taken.groupBy(window, "seed").agg(F.count("*").alias("_size"), F.max("place").alias("_last"))
        rank = F.row_number().over(Window.partitionBy(window, "seed").orderBy("_o"))
        new = met.withColumn("_r", rank).filter(F.col("_r") < cap).join(sizes, [window, "seed"]).filter(F.col("_size") + F.col("_r") <= cap)
        front = cut(new.select(window, "item", "seed", (F.col("_last") + F.col("_r")).cast("int").alias("place")))
        if front.isEmpty():
            break
        taken = cut(taken.unionByName(front))
    return taken.select(window, "item", F.col("seed").alias("cluster"))


def _greedy(edges: DataFrame, items: DataFrame, window: str, cap: int, transitive: bool, most: int) -> DataFrame:
    """Clusters never leave a component, so components are clustered apart from each other.

    Small ones go to tasks by themselves.  Of those with over ``most`` edge rows, a round lets
    every item decide that is newer than all within twice a cluster's reach: the sequential
    rule would have given it the same.  Rounds go on until what is left is small.
    """
    spark = items.sparkSession
    own = edges.select(window, F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"), F.col("weight").cast("double").alias("weight")).filter("a <> b")
    both = cut(own.unionByName(own.select(window, F.col("b").alias("a"), F.col("a").alias("b"), "weight")).groupBy(window, "a", "b").agg(F.max("weight").alias("weight")))
    vertex = lambda c: F.struct(F.col(window).alias("w"), F.col(c).alias("i"))
    found = connected_components(both.select(vertex("a").alias("src"), vertex("b").alias("dst")))
    placed = both.join(found.select(F.col("id.w").alias(window), F.col("id.i").alias("a"), F.col("component.i").alias("component")), [window, "a"])
    sizes = placed.groupBy(window, "component").agg(F.count("*").alias("_n"))
    large = cut(sizes.filter(F.col("_n") > most).select(window, "component"))
    small = placed.join(large, [window, "component"], "left_anti")
    rows = sizes.agg(F.sum("_n")).first()[0] or 0
    buckets = max(2 * int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // most))
    done = [_sequential(small, F.pmod(F.xxhash64(window, "component"), F.lit(buckets)), window, cap, transitive)]
    left = cut(placed.join(large, [window, "component"], "left_semi").select(window, "a", "b", "weight"))
    levels = cap - 1 if transitive else 1
    while left.count() > most:
        took = cut(_taken_by(_ready_seeds(left, window, 2 * levels), left, window, cap, levels))
        done.append(took)
        gone = took.select(window, F.col("item").alias("a"))
        left = cut(left.join(gone, [window, "a"], "left_anti").join(gone.withColumnRenamed("a", "b"), [window, "b"], "left_anti"))
    done.append(_sequential(left, F.lit(0), window, cap, transitive))
    clustered = done[0]
    for more in done[1:]:
        clustered = clustered.unionByName(more)
    clustered = cut(clustered)
    alone = items.select(window, F.col("item").cast("long").alias("item")).distinct().join(clustered.select(window, "item"), [window, "item"], "left_anti")
    return clustered.unionByName(alone.withColumn("cluster", F.col("item")))


def seed_star(items: DataFrame, edges: DataFrame, window: str = "window", cap: int = 8, most: int = MOST_EDGE_ROWS) -> DataFrame:
    """(window, item, cluster): the newest free item takes its free direct neighbours, strongest first, up to the cap.

    ``edges`` (window, a, b, weight) join items of a window; of several for a pair the
    strongest counts, of equally strong ones the newest item comes first.
    """
    return _greedy(edges, items, window, cap, False, most)


def capped_bfs(items: DataFrame, edges: DataFrame, window: str = "window", cap: int = 8, most: int = MOST_EDGE_ROWS) -> DataFrame:
    """Like seed_star, but neighbours of neighbours follow, breadth first."""
    return _greedy(edges, items, window, cap, True, most)


def visible(pairs: DataFrame, placed: DataFrame, window: str, request: str, same_request: bool) -> DataFrame:
    """Add ``visible``: the two items of (a, b) lie in different windows, or in the same (batch) or another (real time) request."""
    return visible_both(pairs, placed, window, request).select("a", "b", F.col("batch" if same_request else "real_time").alias("visible"))


def visible_both(pairs: DataFrame, placed: DataFrame, window: str, request: str) -> DataFrame:
    """G07, G08 in one pass: add ``batch`` and ``real_time``, ``visible`` of either kind."""
    a = placed.select(F.col("item").alias("a"), F.col(window).alias("wa"), F.col(request).alias("ra"))
    b = placed.select(F.col("item").alias("b"), F.col(window).alias("wb"), F.col(request).alias("rb"))
    apart, same = F.col("wa") != F.col("wb"), F.col("ra") == F.col("rb")
    return pairs.join(a, "a").join(b, "b").select("a", "b", (apart | same).alias("batch"), (apart | ~same).alias("real_time"))


def prior_hits(hits: DataFrame, births: DataFrame, start: str, entity: str = "entity") -> DataFrame:
    """Hits on entities born before the row's window."""
    return hits.join(births, entity).filter(F.col("born") < F.col(start)).drop("born")


def truth_groups(labels: DataFrame, item: str = "item", group: str = "group_id") -> DataFrame:
    """(group, items, outlets): a null group is a group of one; unsure rows are left out."""
    sure = labels.filter(~F.coalesce(F.col("unsure"), F.lit(False)))
    name = F.coalesce(F.concat(F.lit("g"), F.col(group).cast("string")), F.concat(F.lit("s"), F.col(item).cast("string")))
    return sure.groupBy(name.alias("group")).agg(F.array_sort(F.collect_set(item)).alias("items"), F.countDistinct("outlet").alias("outlets"))
