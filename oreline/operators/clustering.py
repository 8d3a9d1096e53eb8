"""Clusters, components and anomalies."""

from __future__ import annotations

import math
from itertools import combinations, product

import numpy as np
from pyspark.ml.clustering import BisectingKMeans, GaussianMixture, KMeans
from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, functions as F

from oreline.functions.core import as_list, numeric_names, single
from oreline.functions.ordered import positions
from oreline.operators.aggregates import order_statistic
from oreline.operators.neighbours import BLOCK, cell_join, cluster_distances, crowded_cells, knn_join, squared_distance, vector_of
from oreline.operators.windows import cumulative_share
from oreline.session import stage


def vectors(df: DataFrame, columns=None, scale: bool = True, name: str = "features") -> DataFrame:
    """Add one ML vector of the columns, scaled to zero mean and unit deviation."""
    columns = as_list(columns) or numeric_names(df)
    # A vector is only made of rows that have all numbers; one made first and filtered later fails on the others.
    whole = F.forall(vector_of(df, columns), lambda x: x.isNotNull() & ~F.isnan(x))
    raw = df.withColumn("_raw", F.when(whole, array_to_vector(F.when(whole, F.transform(vector_of(df, columns), lambda x: F.coalesce(x, F.lit(0.0))))))).filter(whole)
    if not scale:
        return raw.withColumnRenamed("_raw", name)
    scaler = StandardScaler(inputCol="_raw", outputCol=name, withMean=True, withStd=True).fit(raw)
    return scaler.transform(raw).drop("_raw")


def kmeans(df: DataFrame, k: int = 3, columns=None, scale: bool = True, seed: int = 42, iterations: int = 20):
    """The rows with their ``cluster``, and the fitted model."""
    ready = vectors(df, columns, scale)
    model = KMeans(k=k, maxIter=iterations, seed=seed, predictionCol="cluster").fit(ready)
    return model.transform(ready), model


def kmeans_summary(df: DataFrame, k: int = 3, columns=None, scale: bool = True) -> DataFrame:
    """Sizes, inertia and silhouette (of squared distances, exact over all rows)."""
    labelled, model = kmeans(df, k, columns, scale)
    sizes = labelled.groupBy("cluster").agg(F.count(F.lit(1)).alias("size"))
    score = silhouette_squared(labelled, "features", "cluster").scalar()
    return sizes.withColumns({"inertia": F.lit(round(model.summary.trainingCost, 4)), "silhouette": F.round(score, 4)})


def hierarchical(df: DataFrame, k: int = 3, columns=None, scale: bool = True, seed: int = 42) -> DataFrame:
    ready = vectors(df, columns, scale)
    return BisectingKMeans(k=k, seed=seed, predictionCol="cluster").fit(ready).transform(ready)


def gaussian_mixture(df: DataFrame, k: int = 3, columns=None, scale: bool = True, seed: int = 42) -> DataFrame:
    ready = vectors(df, columns, scale)
    return GaussianMixture(k=k, seed=seed, predictionCol="cluster").fit(ready).transform(ready)


# --- indices --------------------------------------------------------------------------------------


def silhouette(df: DataFrame, key: str, columns, cluster: str) -> DataFrame:
    """Per row ``(b - a) / max(a, b)`` by Euclidean distance, exact over all rows; a lone row has 0."""
    d = cluster_distances(df, key, columns, cluster)
    own = F.col("cluster") == F.col("own")
    w = d.groupBy("id").agg(
        F.max(F.when(own & (F.col("n") > 1), F.col("total") / (F.col("n") - 1))).alias("a"),
        F.min(F.when(~own, F.col("total") / F.col("n"))).alias("b"),
    )
    s = F.coalesce(F.try_divide(F.col("b") - F.col("a"), F.greatest("a", "b")), F.lit(0.0))
    return w.select("id", F.col("a"), F.col("b"), s.alias("silhouette"))


def _centres(df: DataFrame, vector: str, cluster: str):
    """Per cluster its size, centre and mean squared length; k rows."""
    ready = df.withColumn("_sq", F.aggregate(vector_to_array(vector), F.lit(0.0), lambda s, x: s + x * x))
    return ready.groupBy(cluster).agg(
        F.count(F.lit(1)).alias("n"), Summarizer.mean(F.col(vector)).alias("c"), F.avg("_sq").alias("sq")
    ).orderBy(cluster).collect()


def silhouette_squared(df: DataFrame, vector: str, cluster: str) -> DataFrame:
    """Mean silhouette of squared distances over all rows, in linear time.

    The mean squared distance of x to a cluster is |x|² + mean|c|² - 2 x·mean(c).
    """
    stats = _centres(df, vector, cluster)
    x = vector_to_array(vector)
    length = F.aggregate(x, F.lit(0.0), lambda s, v: s + v * v)
    far = []
    for r in stats:
        dot = F.aggregate(F.zip_with(x, F.array(*[F.lit(float(v)) for v in r.c]), lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
        far.append((r[cluster], r.n, F.col("_len") + r.sq - 2 * dot))
    ready = df.withColumn("_len", length)
    a = F.coalesce(*[F.when(F.col(cluster) == c, d * n / (n - 1) if n > 1 else F.lit(None)) for c, n, d in far])
    b = F.least(*[F.when(F.col(cluster) != c, d) for c, _, d in far])
    s = ready.select(a.alias("a"), b.alias("b"))
    return s.agg(F.avg(F.coalesce(F.try_divide(F.col("b") - F.col("a"), F.greatest("a", "b")), F.lit(0.0))).alias("silhouette"))


def cluster_indices(df: DataFrame, vector: str, cluster: str) -> dict[str, float]:
    """Davies-Bouldin and Calinski-Harabasz from the centres and one pass over the rows."""
    stats = _centres(df, vector, cluster)
    centre = {r[cluster]: np.array(r.c.toArray()) for r in stats}
    x = vector_to_array(vector)
    d2 = F.coalesce(*[F.when(F.col(cluster) == c, squared_distance(x, F.array(*[F.lit(float(v)) for v in m]))) for c, m in centre.items()])
    inside = {r[cluster]: r for r in df.groupBy(cluster).agg(F.avg(F.sqrt(d2)).alias("s"), F.sum(d2).alias("w")).collect()}
    n, k = sum(r.n for r in stats), len(stats)
    grand = sum(r.n * centre[r[cluster]] for r in stats) / n
    between = sum(r.n * float(((centre[r[cluster]] - grand) ** 2).sum()) for r in stats)
    within = sum(r.w for r in inside.values())
    worst = {c: 0.0 for c in centre}
    for p, q in combinations(centre, 2):
        gap = math.sqrt(float(((centre[p] - centre[q]) ** 2).sum()))
        ratio = (inside[p].s + inside[q].s) / gap if gap else 0.0
        worst[p], worst[q] = max(worst[p], ratio), max(worst[q], ratio)
    return {
        "davies_bouldin": sum(worst.values()) / k,
        "calinski_harabasz": (between / (k - 1)) / (within / (n - k)) if k > 1 and n > k and within else 0.0,
    }


def k_scan(df: DataFrame, columns=None, ks=range(2, 8), scale: bool = True) -> DataFrame:
    """KMeans for several k with three indices; the best silhouette is marked."""
    ready = stage(vectors(df, columns, scale).select("features"), "k-scan")
    rows = []
    for k in ks:
        labelled = KMeans(k=k, maxIter=20, seed=42, predictionCol="cluster").fit(ready).transform(ready)
        index = cluster_indices(labelled, "features", "cluster")
        rows.append((k, silhouette_squared(labelled, "features", "cluster").first()[0], index["davies_bouldin"], index["calinski_harabasz"]))
    best = max(rows, key=lambda r: (r[1], -r[0]))[0]
    return df.sparkSession.createDataFrame(
        [(k, round(s, 4), round(d, 4), round(c, 2), k == best) for k, s, d, c in rows],
        "k int, silhouette double, davies_bouldin double, calinski_harabasz double, optimal boolean",
    )


def cluster_profile(df: DataFrame, cluster: str, columns: list[str]) -> DataFrame:
    total = df.agg(F.count(F.lit(1))).scalar()
    return df.groupBy(cluster).agg(
        F.count(F.lit(1)).alias("size"), F.round(100.0 * F.count(F.lit(1)) / F.max(total), 2).alias("pct"),
        *[F.round(F.avg(c), 4).alias(f"mean_{c}") for c in columns],
    )


# --- components -----------------------------------------------------------------------------------


def pca(df: DataFrame, columns=None, n: int = 3, spread: float = 5.0):
    """Scores ``pc1 … pcn`` moved to [-5, 5] per component, and the fitted model."""
    ready = vectors(df, columns, True)
    model = PCA(k=n, inputCol="features", outputCol="_pc").fit(ready)
    rows = model.transform(ready).withColumn("_a", vector_to_array("_pc")).drop("_pc", "features")
    names = [f"pc{i + 1}" for i in range(n)]
    wide = rows.withColumns({c: F.col("_a")[i] for i, c in enumerate(names)}).drop("_a")
    edge = single(wide.agg(*[f(c).alias(f"{p}_{c}") for c in names for p, f in (("lo", F.min), ("hi", F.max))]))
    scaled = {
        c: spread * (2 * F.coalesce(F.try_divide(F.col(c) - edge[f"lo_{c}"], edge[f"hi_{c}"] - edge[f"lo_{c}"]), F.lit(0.5)) - 1) for c in names
    }
    return wide.withColumns(scaled), model


def pca_variance_curve(df: DataFrame, columns=None, n: int = 10, reach: float = 0.9) -> DataFrame:
    """Variance shares of the components, absolute and relative to those kept, running total, first to reach 90 %."""
    columns = as_list(columns) or numeric_names(df)
    ready = vectors(df, columns, True)
    width = ready.select(F.size(vector_to_array("features"))).first()[0]
    shares = PCA(k=min(n, width), inputCol="features", outputCol="_pc").fit(ready).explainedVariance.toArray().tolist()
    rows = [(i + 1, v, v / sum(shares)) for i, v in enumerate(shares)]
    curve = df.sparkSession.createDataFrame(rows, "component int, variance_absolute double, variance_explained double")
    return cumulative_share(curve, "variance_explained", "component", reach)


# --- anomalies ------------------------------------------------------------------------------------


def anomaly_scores(df: DataFrame, key: str, columns, method: str = "zscore", share: float = 0.05, k: int = 5) -> DataFrame:
    """Score per row by ``zscore``, ``iqr``, ``centre`` (own KMeans centre) or ``knn`` (mean distance to k rows);
    the highest ``share`` is flagged."""
    columns = as_list(columns)
    if method == "knn":
        ready = vectors(df, columns).select(key, "features")
        near = knn_join(ready, ready, key, "features", k, skip_same_key=True)
        scored = near.groupBy(F.col("query_id").alias(key)).agg(F.avg(F.sqrt("squared_distance")).alias("score"))
    elif method == "centre":
        labelled, model = kmeans(df, 3, columns)
        centres = F.array(*[F.array(*[F.lit(float(v)) for v in c]) for c in model.clusterCenters()])
        own = F.element_at(centres, F.col("cluster") + 1)
        scored = labelled.select(key, F.sqrt(squared_distance(vector_to_array("features"), own)).alias("score"))
    elif method == "iqr":
        from oreline.operators.quality import long_numbers, quantiles

        q = {r["name"]: r for r in quantiles(long_numbers(df, columns), "value", {"q1": 0.25, "q3": 0.75}, "name").collect()}
        out = []
        for c in columns:
            width = (q[c].q3 - q[c].q1) or 1.0
            out.append(F.greatest((F.lit(q[c].q1) - F.col(c)) / width, (F.col(c) - F.lit(q[c].q3)) / width, F.lit(0.0)))
        scored = df.select(key, (F.greatest(*out) if len(out) > 1 else out[0]).alias("score"))
    else:
        one = single(df.agg(*[f(c).alias(f"{n}{i}") for i, c in enumerate(columns) for n, f in (("m", F.avg), ("s", F.stddev_pop))]))
        z = [F.abs(F.col(c) - one[f"m{i}"]) / F.when(one[f"s{i}"] == 0, 1.0).otherwise(one[f"s{i}"]) for i, c in enumerate(columns)]
        scored = df.select(key, (F.greatest(*z) if len(z) > 1 else z[0]).alias("score"))
    cut = order_statistic(scored, "score", {"t": 1 - share}).scalar()
    return scored.select(key, "score", cut.alias("threshold"), (F.col("score") >= cut).alias("anomaly"))


def anomaly_summary(scored: DataFrame) -> DataFrame:
    return scored.agg(
        F.count(F.lit(1)).alias("rows"), F.count_if("anomaly").alias("anomalies"),
        F.round(100.0 * F.avg(F.col("anomaly").cast("double")), 2).alias("pct"), F.round(F.max("threshold"), 4).alias("threshold"),
    )


# --- DBSCAN ---------------------------------------------------------------------------------------


def connected(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """``(node, root)``: the smallest node reachable from each node. ``edges(a, b)`` are directed both ways.

    Each round takes the smallest label among the neighbours and then jumps to that label's own label, so
    the rounds grow with the logarithm of the longest path; every round is written to the shared folder.
    """
    labels = stage(nodes.select("node", F.col("node").alias("root")), "labels")
    edges = stage(edges, "edges")
    while True:
        seen = edges.join(labels, edges["b"] == labels["node"]).groupBy("a").agg(F.min("root").alias("_near"))
        nearer = labels.join(seen, labels["node"] == seen["a"], "left").select(
            "node", F.col("root").alias("_old"), F.least("root", F.coalesce("_near", "root")).alias("_to")
        )
        jump = nearer.select(F.col("node").alias("_n"), F.col("_to").alias("_next"))
        new = stage(
            nearer.join(jump, F.col("_to") == F.col("_n"), "left").select("node", F.coalesce("_next", "_to").alias("root"), "_old"), "labels"
        )
        if new.filter("root <> _old").limit(1).count() == 0:
            return new.select("node", "root")
        labels = new.select("node", "root")


def dbscan(df: DataFrame, key: str, columns: list[str], eps: float, min_points: int = 5, block: int = BLOCK) -> DataFrame:
    """``(id, cluster)``; -1 is noise. A core row has at least ``min_points`` others within ``eps``;
    a border row joins the smallest cluster it touches. Meant for two or three dimensions.

    Rows fall into grid cells whose diagonal is ``eps``, so a cell with enough rows is all core and all one
    cluster without looking at any pair in it. Only rows of thin cells are compared with neighbouring rows,
    which keeps the work linear however crowded a cell is. Two cells are linked when boxes around their
    core rows (one box per sub-cell) are surely within ``eps``; only pairs the boxes leave open compare rows.
    """
    dims = len(columns)
    side = eps / math.sqrt(dims) * (1 - 1e-9)
    reach = math.ceil(math.sqrt(dims)) + 1
    offsets = [o for o in product(range(-reach, reach + 1), repeat=dims)
               if sum(max(abs(x) - 1, 0) ** 2 for x in o) * side * side <= eps * eps]
    around = F.array(*[F.array(*[F.lit(x).cast("bigint") for x in o]) for o in offsets])
    p = df.select(F.col(key).alias("id"), vector_of(df, columns).alias("v"))
    p = stage(p.withColumn("cell", F.transform("v", lambda x: F.floor(x / side))), "dbscan")
    sizes = p.groupBy("cell").agg(F.count(F.lit(1)).alias("_n"))
    p = stage(p.join(sizes, "cell"), "dbscan-cells")
    dense = F.col("_n") > min_points

    def visiting(rows: DataFrame, held: DataFrame, label: str) -> DataFrame:
        """Rows of thin cells beside the rows of the cells around them; crowded cells are cut by their counts."""
        visits = rows.select(F.col("id").alias("tid"), F.col("v").alias("tv"), F.col("cell").alias("_home"), F.explode(around).alias("_o"))
        visits = visits.select("tid", "tv", F.zip_with("_home", "_o", lambda a, b: a + b).alias("cell"))
        return cell_join(visits, held, stage(crowded_cells(rows, held, around, block), label), "tid", "id")

    near = squared_distance(F.col("tv"), F.col("v")) <= eps * eps
    thin = p.filter(~dense)
    counts = visiting(thin, p.select("id", "v", "cell"), "dbscan-crowded").filter(near & (F.col("tid") != F.col("id")))
    strong = counts.groupBy("tid").agg(F.count(F.lit(1)).alias("_k")).filter(F.col("_k") >= min_points).select(F.col("tid").alias("id"))
    core = stage(
        p.filter(dense).select("id", "v", "cell").unionByName(thin.join(strong, "id", "left_semi").select("id", "v", "cell")), "dbscan-core"
    )

    # boxes of core rows per sub-cell
    fine = side / 8
    box = core.withColumn("_sub", F.transform("v", lambda x: F.floor(x / fine))).groupBy("cell", "_sub").agg(
        *[f(F.col("v")[i]).alias(f"{n}{i}") for i in range(dims) for n, f in (("lo", F.min), ("hi", F.max))]
    )
    far_sq = sum(((F.greatest(F.abs(F.col(f"ahi{i}") - F.col(f"lo{i}")), F.abs(F.col(f"hi{i}") - F.col(f"alo{i}")))) ** 2 for i in range(dims)), F.lit(0.0))
    gap_sq = sum(((F.greatest(F.lit(0.0), F.col(f"lo{i}") - F.col(f"ahi{i}"), F.col(f"alo{i}") - F.col(f"hi{i}"))) ** 2 for i in range(dims)), F.lit(0.0))
    half = [o for o in offsets if o > tuple([0] * dims)]
    forward = F.array(*[F.array(*[F.lit(x).cast("bigint") for x in o]) for o in half])
    asked = box.select(
        F.col("cell").alias("a"), F.col("_sub").alias("asub"),
        *[F.col(f"{n}{i}").alias(f"a{n}{i}") for i in range(dims) for n in ("lo", "hi")], F.explode(forward).alias("_o"),
    ).withColumn("cell", F.zip_with("a", "_o", lambda x, y: x + y))
    met = asked.join(box, "cell").withColumns({"sure": far_sq <= eps * eps, "open": gap_sq <= eps * eps})
    pairs = stage(met.filter("open").select("a", F.col("cell").alias("b"), "asub", F.col("_sub").alias("bsub"), "sure"), "dbscan-pairs")
    verdict = pairs.groupBy("a", "b").agg(F.max("sure").alias("sure"))
    undecided = pairs.join(verdict.filter("NOT sure").select("a", "b"), ["a", "b"])
    # distinct places of a sub-cell in blocks by their number; an open pair of sub-cells meets block by block
    places = core.withColumn("_sub", F.transform("v", lambda x: F.floor(x / fine))).select("cell", "_sub", "v").distinct()
    cut = places.groupBy("cell", "_sub").agg(F.ceil(F.count(F.lit(1)) / block).alias("_parts")).filter("_parts > 1")
    places = places.join(stage(cut, "dbscan-cut"), ["cell", "_sub"], "left").withColumn("_parts", F.coalesce("_parts", F.lit(1).cast("bigint")))
    places = stage(places.withColumn("_part", F.pmod(F.xxhash64("v"), F.col("_parts"))), "dbscan-places")
    dealt = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_parts") - 1))
    spots = places.select("cell", "_sub", "_parts").distinct().select("cell", "_sub", dealt.alias("_part"))
    meetings = undecided.join(spots.toDF("a", "asub", "apart"), ["a", "asub"]).join(spots.toDF("b", "bsub", "bpart"), ["b", "bsub"])
    left = places.select(F.col("cell").alias("a"), F.col("_sub").alias("asub"), F.col("_part").alias("apart"), F.col("v").alias("tv"))
    right = places.select(F.col("cell").alias("b"), F.col("_sub").alias("bsub"), F.col("_part").alias("bpart"), "v")
    checked = meetings.join(left, ["a", "asub", "apart"]).join(right, ["b", "bsub", "bpart"]).filter(near).select("a", "b").distinct()
    links = verdict.filter("sure").select("a", "b").unionByName(checked)

    named = positions(stage(core.select("cell").distinct(), "dbscan-core"), "cell", None, "node")
    named = stage(named, "dbscan-nodes")
    a, b = named.select(F.col("cell").alias("a"), F.col("node").alias("na")), named.select(F.col("cell").alias("b"), F.col("node").alias("nb"))
    e = links.join(a, "a").join(b, "b")
    edges = e.select(F.col("na").alias("a"), F.col("nb").alias("b")).unionByName(e.select(F.col("nb").alias("a"), F.col("na").alias("b")))
    roots = named.join(connected(edges, named.select("node")), "node").select("cell", "root")
    rooted = core.join(roots, "cell")
    # clusters are numbered by their smallest id
    first = rooted.groupBy("root").agg(F.min("id").alias("_first"))
    numbers = positions(stage(first, "dbscan-first"), "_first", None, "cluster").select("root", "cluster")
    inner = stage(rooted.join(numbers, "root").select("id", "v", "cell", "cluster"), "dbscan-inner")
    rest = thin.join(inner.select("id"), "id", "left_anti")
    touch = visiting(rest, inner, "dbscan-met").filter(near)
    border = touch.groupBy(F.col("tid").alias("id")).agg(F.min("cluster").alias("cluster"))
    outer = rest.select("id").join(border, "id", "left").select("id", F.coalesce("cluster", F.lit(-1)).alias("cluster"))
    return inner.select("id", "cluster").unionByName(outer)


def cluster_centroids(points: DataFrame, cluster: str, columns: list[str]) -> DataFrame:
    return points.filter(F.col(cluster) >= 0).groupBy(cluster).agg(
        F.count(F.lit(1)).alias("size"), *[F.avg(c).alias(c) for c in columns]
    )
