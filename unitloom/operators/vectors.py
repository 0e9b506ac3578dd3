"""Vector analytics: exact neighbours, mixtures, geometry and clusters.

``knn`` is exact without comparing everything with everything: the table is cut into
cells around pivots, the triangle inequality rules out cells that cannot hold a
neighbour of a cell's queries, and what remains is matched block by block with NumPy inside
bounded groups, each returning at most its own best ``k`` per query.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import bits_per_byte, byte_levenshtein, hash01, id_hash, log_sum_exp
from ..session import durable
from .ordered import one_row, prefix_scan, ranked, smallest, top_per_group

EPS = 1e-9
#: Rows of a table, or queries, that meet in one task (32 MB of 64 dimensions together).
TOGETHER = 32_768
#: Pairs compared and pairs scored at a time, and neighbouring scores of which the best is taken first.
PAIRS, SCORED, GROUP = 1 << 21, 1 << 16, 32


def dot(a, b) -> Column:
    a, b = (F.col(c) if isinstance(c, str) else c for c in (a, b))
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a) -> Column:
    return F.sqrt(dot(a, a))


def unit_vector(a) -> Column:
    a = F.col(a) if isinstance(a, str) else a
    size = F.greatest(norm(a), F.lit(1e-12))
    return F.transform(a, lambda x: x / size)


def _matrix(series: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(v, dtype=np.float64) for v in series])


def _best(queries: np.ndarray, table: np.ndarray, ids: np.ndarray, own: np.ndarray, k: int, cosine: bool) -> Iterator[tuple]:
    """(query rows, table ids, scores) of the ``k`` best per query, some queries at a time; larger score is nearer."""
    squares = (table * table).sum(1)
    # What rounding can do grows with the squared norms.
    slack = 1e-7 + 1e-12 * float(squares.max(initial=0.0) + (queries * queries).sum(1).max(initial=0.0))
    rows = max(1, min(256, PAIRS // max(len(table), 1)))
    for i in range(0, len(queries), rows):
        q = queries[i : i + rows]
        approx = q @ table.T
        if not cosine:
            approx *= 2
            approx -= squares
            approx -= (q * q).sum(1)[:, None]
            np.minimum(approx, 0, out=approx)
        approx[own[i : i + rows][:, None] == ids[None]] = -np.inf
        approx[np.isnan(approx)] = -np.inf
        # Everything that rounding could lift into the best k is scored exactly.
        at, near = np.nonzero((approx >= _edge(approx, k)[:, None] - slack) & (approx > -np.inf))
        score = np.empty(len(at))
        for low in range(0, len(at), SCORED):
            some = slice(low, low + SCORED)
            x, y = table[near[some]], q[at[some]]
            score[some] = (x * y).sum(1) if cosine else -np.sqrt(((x - y) ** 2).sum(1))
        score = np.round(score, 9)
        order = np.lexsort((ids[near], -score, at))
        at, near, score = at[order], near[order], score[order]
        first = np.arange(len(at)) - np.searchsorted(at, at) < k
        yield i + at[first], ids[near[first]], score[first]


def _edge(scores: np.ndarray, k: int) -> np.ndarray:
    """A score that ``k`` entries of each row reach, near the k-th best: the k-th best of the bests of GROUP neighbouring entries."""
    n = scores.shape[1]
    if n <= k:
        return np.full(len(scores), -np.inf)
    if n >= 4 * k * GROUP:
        scores = scores[:, : n // GROUP * GROUP].reshape(len(scores), -1, GROUP).max(2)
        n = scores.shape[1]
    return np.partition(scores, n - k, axis=1)[:, n - k]


def knn(
    queries: DataFrame,
    table: DataFrame,
    k: int,
    metric: str = "cosine",
    exclude_self: bool = True,
    pivots: int | None = None,
    block: int = 4096,
) -> DataFrame:
    """Exact ``k`` nearest table vectors per query: (query_id, id, score, place).

    Inputs have (id BIGINT, vec ARRAY).  ``score`` is the cosine, or the negative
    Euclidean distance.  Ties go to the smaller id.  A task gets the rows of one block and one crowd
    (``routed_blocks``) and compares a bounded number of pairs at a time.
    """
    cosine = metric == "cosine"
    routed, spread = routed_blocks(queries, table, k, metric, exclude_self, pivots, block)

    def match(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(left) and len(right):
            q, own = _matrix(left["vec"]), left["id"].to_numpy()
            ids = right["id"].to_numpy()
            hide = own if exclude_self else np.full(len(own), -1, dtype=np.int64) - np.abs(ids).max()
            for r, near, score in _best(q, _matrix(right["vec"]), ids, hide, k, cosine):
                found.append(pd.DataFrame({"query_id": own[r], "id": near, "score": score}))
        return pd.concat(found) if found else pd.DataFrame({"query_id": [], "id": [], "score": []}).astype({"query_id": "int64", "id": "int64"})

    keys = ["block", "crowd"]
    partial = routed.groupBy(*keys).cogroup(spread.groupBy(*keys)).applyInPandas(match, "query_id bigint, id bigint, score double")
    return top_per_group(partial, ["query_id"], [F.col("score").desc(), F.col("id")], k, "place")


def routed_blocks(
    queries: DataFrame, table: DataFrame, k: int, metric: str, exclude_self: bool = True, pivots: int | None = None, block: int = 4096
) -> tuple[DataFrame, DataFrame]:
    """Queries and table rows by (block, crowd): what has to meet for exact neighbours.

    Rows are placed in the cell of their nearest pivot.  Cells that the queries of the same cells ask for share blocks, cells whose
    queries ask for the same cells share crowds; both are as large as ``block``, an eighth of the table or TOGETHER allows, so
    that a row is copied once for each crowd or block of that size that it has to meet, and a table row that no query asks for not at all.
    """
    cosine = metric == "cosine"
    shape = (lambda d: d.select("id", unit_vector(F.col("vec").cast("array<double>")).alias("vec"))) if cosine else (
        lambda d: d.select("id", F.col("vec").cast("array<double>").alias("vec"))
    )
    table, queries = shape(table), shape(queries)
    n_table = table.count()
    m = pivots or int(min(1024, max(1, round((n_table / block) ** 0.5 * 4))))
    chosen = smallest(table.withColumn("_h", id_hash(F.lit("pivot"), "id")), ["_h", "id"], m).select("vec").collect()
    centre = np.array([np.asarray(r.vec) for r in chosen])  # at most 1024 vectors
    together = max(block, min(TOGETHER, n_table // 8))

    def distances(x: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum((x * x).sum(1)[:, None] + (centre * centre).sum(1)[None] - 2 * x @ centre.T, 0))

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                d = distances(_matrix(pdf["vec"]))
                yield pdf.assign(cell=d.argmin(1), reach=d.min(1))

    cells = "id bigint, vec array<double>, cell bigint, reach double"
    placed, homes = durable(table.mapInPandas(assign, cells)), durable(queries.mapInPandas(assign, cells))
    size, radius = np.zeros(len(centre), dtype=np.int64), np.full(len(centre), -np.inf)
    for s in placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("reach").alias("r")).collect():  # one row per pivot
        size[s.cell], radius[s.cell] = s.n, s.r
    asking = np.zeros(len(centre), dtype=np.int64)
    for s in homes.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect():
        asking[s.cell] = s.n
    need = k + int(exclude_self)

    def route(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """The cells that may hold a neighbour of one of the queries, by the queries' cell."""
        wanted = np.zeros((len(centre), len(centre)), dtype=bool)
        for pdf in batches:
            if not len(pdf):
                continue
            d = distances(_matrix(pdf["vec"]))
            far = np.where(size > 0, d + radius, np.inf)
            order = np.argsort(far, axis=1)
            reached = np.cumsum(size[order], axis=1) >= need
            at = np.where(reached.any(1), reached.argmax(1), len(centre) - 1)
            bound = np.take_along_axis(far, order, 1)[np.arange(len(d)), at]
            bound = np.where(reached.any(1), bound, np.inf)
            rows, asked = np.nonzero((d - radius <= bound[:, None] + 1e-6 + 1e-9 * np.where(np.isfinite(bound), bound, 0)[:, None]) & (size > 0)[None])
            wanted[pdf["cell"].to_numpy()[rows], asked] = True
        home, asked = np.nonzero(wanted)
        yield pd.DataFrame({"home": home, "asked": asked})

    wanted = np.zeros((len(centre), len(centre)), dtype=bool)
    for r in homes.mapInPandas(route, "home bigint, asked bigint").distinct().collect():  # at most one row for two pivots
        wanted[r.home, r.asked] = True
    crowd, crowds = _shared(wanted, asking, together)
    first, blocks = _shared(wanted.T, size, together)
    session = table.sparkSession
    met = lambda mine, other, parts: sorted({int(b) for c in np.flatnonzero(mine) for b in range(other[c], other[c] + parts[c])})
    sides = []
    for rows, mine, own, parts, other, others, name, seen in (
        (homes, wanted, crowd, crowds, first, blocks, "crowd", "block"),
        (placed, wanted.T, first, blocks, crowd, crowds, "block", "crowd"),
    ):
        plan = [(c, int(own[c]), int(parts[c]), met(mine[c], other, others)) for c in range(len(centre)) if mine[c].any()]
        plan = session.createDataFrame(plan, f"cell bigint, first bigint, parts bigint, {seen}s array<bigint>")
        place = F.col("first") + F.pmod(F.xxhash64("id", "vec"), "parts")
        sides.append(rows.join(F.broadcast(plan), "cell").select("id", "vec", place.alias(name), F.explode(f"{seen}s").alias(seen)))
    return sides[0], sides[1]


def _shared(wanted: np.ndarray, rows: np.ndarray, together: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each row of ``wanted`` the first number and the count of parts that it shares with all equal rows."""
    if not len(wanted):
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    kind = np.unique(wanted, axis=0, return_inverse=True)[1].ravel()
    parts = np.maximum(-(-np.bincount(kind, weights=rows).astype(np.int64) // together), 1)
    return (np.cumsum(parts) - parts)[kind], parts[kind]


def snap_to_table(positions: DataFrame, table: DataFrame, metric: str = "cosine") -> DataFrame:
    """Nearest table entry of every position."""
    return knn(positions, table, 1, metric, exclude_self=False).select("query_id", "id", "score")


# --- mixtures ------------------------------------------------------------------


def group_mixture(vectors: DataFrame, label: str, floor: float = 0.05) -> DataFrame:
    """One row holding one diagonal component per label: weight, mean and deviation.

    The number of components is the number of labels, small by definition of a mixture.
    """
    dims = vectors.select(label, F.posexplode("vec").alias("d", "x"))
    per = dims.groupBy(label, "d").agg(F.avg("x").alias("m"), F.greatest(F.stddev_pop("x"), F.lit(floor)).alias("s"), F.count(F.lit(1)).alias("n"))
    comp = per.groupBy(label).agg(
        F.max("n").cast("double").alias("n"), F.sort_array(F.collect_list(F.struct("d", "m", "s"))).alias("p")
    )
    entry = F.struct(
        F.col(label).cast("bigint").alias("label"),
        F.log("n").alias("logit"),
        F.transform("p", lambda x: x["m"]).alias("mu"),
        F.transform("p", lambda x: x["s"]).alias("sigma"),
    )
    return comp.agg(F.sort_array(F.collect_list(entry)).alias("mixture"))


def component_scores(vectors: DataFrame, mixture: DataFrame) -> DataFrame:
    """Per vector the joint log density of every component: log softmax(logit) + log N."""
    rows = vectors.transform(one_row, mixture)
    total = log_sum_exp(F.transform("mixture", lambda c: c["logit"]))

    def density(c: Column) -> Column:
        z2 = F.aggregate(
            F.zip_with(F.zip_with("vec", c["mu"], lambda x, m: x - m), c["sigma"], lambda e, s: (e / s) * (e / s) + 2 * F.log(s)),
            F.lit(0.0),
            lambda a, b: a + b,
        )
        return -0.5 * z2 - 0.5 * F.size("vec") * F.log(F.lit(2 * np.pi))

    rows = rows.withColumn("_total", total)
    scores = F.transform("mixture", lambda c: c["logit"] - F.col("_total") + density(c))
    labels = F.transform("mixture", lambda c: c["label"])
    return rows.select(*vectors.columns, labels.alias("labels"), scores.alias("scores"))


def mixture_log_density(scored: DataFrame) -> DataFrame:
    return scored.withColumn("log_density", log_sum_exp("scores"))


def mixture_stats(scored: DataFrame, scores: str = "scores") -> DataFrame:
    """Entropy, effective components and top share of softmax(scores) per row."""
    rows = scored.withColumn("_lse", log_sum_exp(scores)).withColumn("_p", F.transform(scores, lambda s: F.exp(s - F.col("_lse"))))
    add = lambda f: F.aggregate(F.transform("_p", f), F.lit(0.0), lambda a, x: a + x)
    return rows.select(
        *scored.columns,
        (-add(lambda p: p * F.log(F.greatest(p, F.lit(1e-12))))).alias("entropy"),
        (1 / add(lambda p: p * p)).alias("effective"),
        F.array_max("_p").alias("top_share"),
    )


def calibrate_temperature(positions: DataFrame, taus: Sequence[float], n_table: Column) -> DataFrame:
    """Per temperature: perplexity and bits per byte on the test half, best one marked.

    ``positions`` has scores (array), true_score (NULL when the true entry is missing
    from the table), n_bytes and calib (first half or not).  Missing entries cost the
    uniform log of the table size.
    """
    per = positions.select(
        "true_score", "n_bytes", "calib", "scores", n_table.alias("_n"), F.explode(F.lit(list(taus)).cast("array<double>")).alias("tau")
    )
    per = per.select(
        "tau", "n_bytes", "calib", "_n", F.col("true_score").isNotNull().alias("covered"),
        (log_sum_exp(F.transform("scores", lambda s: s / F.col("tau"))) - F.col("true_score") / F.col("tau")).alias("nll"),
    )
    on = lambda cond, value: F.sum(F.when(cond, value).otherwise(F.lit(0)))
    covered, calib = F.col("covered"), F.col("calib")
    out = per.groupBy("tau").agg(
        on(calib & covered, F.col("nll")).alias("_cal"),
        on(calib & covered, F.lit(1)).alias("_n_cal"),
        on(~calib & covered, F.col("nll")).alias("_tst"),
        on(~calib & covered, F.lit(1)).alias("_n_in"),
        on(~calib, F.lit(1)).alias("n_test"),
        on(~calib & covered, F.col("n_bytes")).alias("_b_in"),
        on(~calib, F.col("n_bytes")).alias("_b_all"),
        F.max("_n").alias("_n"),
    )
    out = out.withColumn("n_missing", F.col("n_test") - F.col("_n_in")).withColumn("_all", F.col("_tst") + F.col("n_missing") * F.log("_n"))
    out = out.select(
        "tau",
        (F.col("_cal") / F.greatest(F.col("_n_cal"), F.lit(1))).alias("nll_calib"),
        "n_test",
        "n_missing",
        F.exp(F.col("_all") / F.greatest(F.col("n_test"), F.lit(1))).alias("ppl"),
        bits_per_byte("_all", "_b_all").alias("bpb"),
        F.exp(F.col("_tst") / F.greatest(F.col("_n_in"), F.lit(1))).alias("ppl_covered"),
        bits_per_byte("_tst", "_b_in").alias("bpb_covered"),
    )
    best = out.agg(F.min_by("tau", F.struct("nll_calib", "tau")).alias("_best"))
    return out.transform(one_row, best).withColumn("best", F.col("tau") == F.col("_best")).drop("_best")


# --- geometry ------------------------------------------------------------------


def anisotropy(vectors: DataFrame) -> DataFrame:
    """Mean cosine over all pairs in one linear pass: (|sum of unit vectors|^2 - n) / (n(n-1))."""
    dims = vectors.select(F.posexplode(unit_vector(F.col("vec").cast("array<double>"))).alias("d", "x"))
    per = dims.groupBy("d").agg(F.sum("x").alias("s"), F.count(F.lit(1)).alias("n"))
    n = F.max("n")
    return per.agg(n.alias("n"), ((F.sum(F.col("s") * F.col("s")) - n) / (n * (n - 1))).alias("mean_cos"))


def sampled_anisotropy(vectors: DataFrame, n_pairs: int, seed: int) -> DataFrame:
    """Mean, mean absolute and deviation of the cosine over hash-drawn index pairs."""
    placed = durable(ranked(vectors.select("id"), [], ["id"], "_p").withColumn("_p", F.col("_p") - 1))
    total = placed.agg(F.count(F.lit(1)).alias("_n"))
    unit = vectors.select("id", unit_vector(F.col("vec").cast("array<double>")).alias("u")).join(placed, "id").drop("id")
    draws = (
        vectors.sparkSession.range(n_pairs)
        .transform(one_row, total)
        .select(
            F.pmod(id_hash(F.lit(f"{seed}i"), "id"), F.col("_n")).alias("i"), F.pmod(id_hash(F.lit(f"{seed}j"), "id"), F.col("_n")).alias("j")
        )
    )
    pairs = draws.join(unit.select(F.col("_p").alias("i"), F.col("u").alias("a")), "i").join(unit.select(F.col("_p").alias("j"), F.col("u").alias("b")), "j")
    cos = pairs.select(dot("a", "b").alias("c"))
    return cos.agg(F.count(F.lit(1)).alias("n_pairs"), F.avg("c").alias("mean_cos"), F.avg(F.abs("c")).alias("mean_abs"), F.stddev_pop("c").alias("std"))


def covariance(vectors: DataFrame) -> DataFrame:
    """Covariance cells (i, j, c): d x d rows, from one partial product per input batch."""

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = None
        for pdf in batches:
            if len(pdf):
                x = _matrix(pdf["vec"])
                x = np.hstack([x, np.ones((len(x), 1))])
                total = x.T @ x if total is None else total + x.T @ x
        if total is not None:
            i, j = np.indices(total.shape)
            yield pd.DataFrame({"i": i.ravel(), "j": j.ravel(), "s": total.ravel()})

    d = F.max("i").over(Window.partitionBy(F.lit(0)))
    sums = vectors.select("vec").mapInPandas(partial, "i bigint, j bigint, s double").groupBy("i", "j").agg(F.sum("s").alias("s"))
    cells = durable(sums.withColumn("d", d))  # (d + 1)^2 rows
    mean = cells.filter("j = d AND i < d").select("i", F.col("s").alias("m"))
    count = cells.filter("i = d AND j = d").select(F.col("s").alias("n"))
    body = cells.filter("i < d AND j < d").transform(one_row, count)
    body = body.join(F.broadcast(mean), "i").join(F.broadcast(mean.select(F.col("i").alias("j"), F.col("m").alias("m2"))), "j")
    return body.select("i", "j", (F.col("s") / F.col("n") - F.col("m") * F.col("m2") / (F.col("n") * F.col("n"))).alias("c"), "n")


def participation_by_variance(cov: DataFrame) -> DataFrame:
    """(sum of eigenvalues)^2 / sum of squared eigenvalues, from trace and Frobenius norm."""
    return cov.agg(
        (F.pow(F.sum(F.when(F.col("i") == F.col("j"), F.col("c")).otherwise(0.0)), 2) / F.sum(F.col("c") * F.col("c"))).alias("participation_variance")
    )


def spectrum(cov: DataFrame) -> DataFrame:
    """Both participation ratios and the top-1/top-10 variance shares; input is d x d cells."""

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        d = int(pdf["i"].max()) + 1
        c = np.zeros((d, d))
        c[pdf["i"], pdf["j"]] = pdf["c"]
        lam = np.maximum(np.linalg.eigvalsh(c)[::-1], 0)
        s = np.sqrt(lam)
        return pd.DataFrame(
            {
                "d": [d],
                "participation_singular": [s.sum() ** 2 / lam.sum()],
                "participation_variance": [lam.sum() ** 2 / (lam**2).sum()],
                "top1": [lam[0] / lam.sum()],
                "top10": [lam[:10].sum() / lam.sum()],
            }
        )

    one = cov.withColumn("_one", F.lit(0))
    return one.groupBy("_one").applyInPandas(solve, "d bigint, participation_singular double, participation_variance double, top1 double, top10 double")


def dim_health(vectors: DataFrame) -> DataFrame:
    """Dead dimensions, median/max variance and vector norm spread."""
    per = vectors.select(F.posexplode(F.col("vec").cast("array<double>")).alias("d", "x")).groupBy("d").agg(F.var_pop("x").alias("v"))
    top = per.agg(F.max("v").alias("_m"))
    dims = per.transform(one_row, top).agg(
        F.count(F.lit(1)).alias("d"), F.sum((F.col("v") < 1e-4 * F.col("_m")).cast("bigint")).alias("dead"), (F.percentile("v", F.lit(0.5)) / F.max("_m")).alias("median_ratio")
    )
    size = vectors.select(norm(F.col("vec").cast("array<double>")).alias("l")).agg(
        F.avg("l").alias("norm_mean"), F.stddev_pop("l").alias("norm_std"), F.min("l").alias("norm_min"), F.max("l").alias("norm_max")
    )
    return dims.transform(one_row, size)


def clustering_coefficient(neighbours: DataFrame) -> DataFrame:
    """Mean local clustering coefficient of the symmetrised neighbour graph (degree >= 2).

    Triangles are found once each, over edges pointed from the lower to the higher
    degree, which keeps the fan-out small even at hubs.
    """
    edges = durable(
        neighbours.select(F.least("query_id", "id").alias("a"), F.greatest("query_id", "id").alias("b")).filter("a <> b").distinct()
    )
    degree = edges.select(F.explode(F.array("a", "b")).alias("v")).groupBy("v").agg(F.count(F.lit(1)).alias("deg"))
    da, db = degree.select(F.col("v").alias("a"), F.col("deg").alias("da")), degree.select(F.col("v").alias("b"), F.col("deg").alias("db"))
    low = (F.col("da") < F.col("db")) | ((F.col("da") == F.col("db")) & (F.col("a") < F.col("b")))
    arcs = durable(
        edges.join(da, "a").join(db, "b").select(F.when(low, F.col("a")).otherwise(F.col("b")).alias("u"), F.when(low, F.col("b")).otherwise(F.col("a")).alias("w"))
    )
    wedge = arcs.select("u", F.col("w").alias("x")).join(arcs.select("u", F.col("w").alias("y")), "u").filter("x < y")
    triangles = wedge.join(edges.select(F.col("a").alias("x"), F.col("b").alias("y")), ["x", "y"])
    corner = triangles.select(F.explode(F.array("u", "x", "y")).alias("v")).groupBy("v").agg(F.count(F.lit(1)).alias("t"))
    rows = degree.filter("deg >= 2").join(corner, "v", "left")
    local = 2 * F.coalesce("t", F.lit(0)) / (F.col("deg") * (F.col("deg") - 1))
    return rows.agg(F.count(F.lit(1)).alias("n"), F.avg(local).alias("clustering"))


def cluster_quality(vectors: DataFrame, ks: Sequence[int] = (5, 10, 15, 20, 25), seed: int = 0) -> DataFrame:
    """Cosine silhouette of k-means for every k."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.evaluation import ClusteringEvaluator
    from pyspark.ml.functions import array_to_vector

    data = durable(vectors.select("id", array_to_vector(unit_vector(F.col("vec").cast("array<double>"))).alias("features")))
    evaluator = ClusteringEvaluator(distanceMeasure="cosine")
    rows = []
    for k in ks:
        model = KMeans(k=k, seed=seed).fit(data)
        rows.append((k, float(evaluator.evaluate(model.transform(data)))))
    return vectors.sparkSession.createDataFrame(rows, "k bigint, silhouette double")


def nmi(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """Normalised mutual information (arithmetic mean of the entropies) from the contingency table."""
    cells = durable(pairs.groupBy(a, b).agg(F.count(F.lit(1)).alias("n")))

    def entropy(col: str, name: str) -> DataFrame:
        per = cells.groupBy(col).agg(F.sum("n").alias("m"))
        return per.agg((F.log(F.sum("m")) - F.sum(F.col("m") * F.log("m")) / F.sum("m")).alias(name))

    joint = cells.agg((F.log(F.sum("n")) - F.sum(F.col("n") * F.log("n")) / F.sum("n")).alias("h_ab"), F.sum("n").alias("n"))
    out = joint.transform(one_row, entropy(a, "h_a")).transform(one_row, entropy(b, "h_b"))
    mutual = F.col("h_a") + F.col("h_b") - F.col("h_ab")
    mean = (F.col("h_a") + F.col("h_b")) / 2
    return out.select("n", mutual.alias("mutual"), F.when(mean > 0, mutual / mean).otherwise(1.0).alias("nmi"))


def purity(pairs: DataFrame, cluster: str, label: str) -> DataFrame:
    """Majority label and its share per cluster."""
    cells = pairs.groupBy(cluster, label).agg(F.count(F.lit(1)).alias("n"))
    top = F.max(F.struct(F.col("n").alias("n"), (-F.col(label)).alias("l")))
    return cells.groupBy(cluster).agg(F.sum("n").alias("n"), top.alias("_t")).select(
        cluster, "n", (-F.col("_t.l")).alias("majority"), (F.col("_t.n") / F.col("n")).alias("share")
    )


def cluster_listing(pairs: DataFrame, cluster: str, member: str, n: int, seed: int) -> DataFrame:
    """Clusters in order of size with up to ``n`` hash-drawn members each."""
    sizes = ranked(pairs.groupBy(cluster).agg(F.count(F.lit(1)).alias("n")), [], [F.col("n").desc(), F.col(cluster)], "place")
    drawn = top_per_group(pairs.select(cluster, member).withColumn("_h", id_hash(F.lit(str(seed)), member)), [cluster], ["_h", member], n, "_p")
    samples = drawn.groupBy(cluster).agg(F.sort_array(F.collect_list(F.struct("_p", member))).alias("_m"))
    return sizes.join(samples, cluster).select(cluster, "n", "place", F.transform("_m", lambda x: x[member]).alias("members"))


def intra_cluster_edit(units: DataFrame, cluster: str, n_pairs: int, seed: int) -> DataFrame:
    """Mean normalised edit distance of up to ``n_pairs`` hash-drawn pairs, in every cluster of four members or more."""
    hashed = units.select(cluster, "unit").withColumn("_h", id_hash(F.lit(str(seed)), "unit"))
    drawn = durable(top_per_group(hashed, [cluster], ["_h", "unit"], 2 * n_pairs, "_p"))
    half = drawn.groupBy(cluster).agg(F.floor(F.count(F.lit(1)) / 2).alias("_half")).filter("_half >= 2")
    halved = drawn.join(half, cluster)
    right = halved.select(cluster, (F.col("_p") - F.col("_half")).alias("_p"), F.col("unit").alias("other"))
    pairs = halved.filter("_p <= _half").join(right, [cluster, "_p"])
    size = F.greatest(F.octet_length("unit"), F.octet_length("other"), F.lit(1))
    return pairs.groupBy(cluster).agg(F.count(F.lit(1)).alias("n_pairs"), F.avg(byte_levenshtein("unit", "other") / size).alias("mean_ned"))


def ngram_vector(unit, dims: int = 32) -> Column:
    """Hashed character-bigram counts: a stand-in where no learned encoder is at hand."""
    unit = F.col(unit) if isinstance(unit, str) else unit
    padded = F.concat(F.lit("^"), unit, F.lit("$"))
    grams = F.transform(F.sequence(F.lit(1), F.length(padded) - 1), lambda i: F.pmod(id_hash(F.substring(padded, i, F.lit(2))), F.lit(dims)))
    return F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda d: F.size(F.filter(grams, lambda g: g == d)).cast("double"))


def variant_spacing(neighbours: DataFrame, strings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Distance percentiles by edit distance of neighbours, and of each anchor's nearest variant."""
    left = strings.select(F.col("id").alias("query_id"), F.col("unit").alias("a"))
    right = strings.select("id", F.col("unit").alias("b"))
    rows = neighbours.join(left, "query_id").join(right, "id").select(
        "query_id", (-F.col("score")).alias("dist"), F.least(byte_levenshtein("a", "b"), F.lit(4)).alias("edits")
    )
    rows = durable(rows)
    cuts = lambda c: [F.percentile(c, F.lit(p / 100)).alias(f"p{p}") for p in (10, 25, 50, 75)]
    spacing = rows.groupBy("edits").agg(F.count(F.lit(1)).alias("n"), *cuts("dist"))
    nearest = rows.filter("edits <= 2").groupBy("query_id").agg(F.min("dist").alias("dist"))
    return spacing, nearest.agg(F.count(F.lit(1)).alias("n"), *cuts("dist"), F.percentile("dist", F.lit(0.9)).alias("p90"))


def cloud_margin(sources: DataFrame, variants: DataFrame) -> DataFrame:
    """Distance to the nearest other source minus the variant's distance, and collisions.

    ``variants`` has one vector per source id.
    """
    other = knn(sources, sources, 1).select(F.col("query_id").alias("id"), (1 - F.col("score")).alias("d_other"))
    stray = knn(variants, sources, 1).select(F.col("query_id").alias("id"), F.col("score").alias("cos_other"))
    u = lambda d, name: d.select("id", unit_vector(F.col("vec").cast("array<double>")).alias(name))
    own = u(sources, "a").join(u(variants, "b"), "id").select("id", dot("a", "b").alias("cos_own"))
    rows = own.join(other, "id").join(stray, "id")
    return rows.select(
        "id", (F.col("d_other") - (1 - F.col("cos_own"))).alias("margin"), (F.col("cos_other") > F.col("cos_own")).alias("collides")
    )


def margin_report(margins: DataFrame) -> DataFrame:
    return margins.agg(
        F.count(F.lit(1)).alias("n"), F.avg("margin").alias("margin_mean"), F.avg((F.col("margin") < 0).cast("double")).alias("negative"), F.avg(F.col("collides").cast("double")).alias("collision_rate")
    )


# --- weighted and ranked scores --------------------------------------------------


def weighted_quantiles(df: DataFrame, x: str, w: str, ps: Sequence[float]) -> DataFrame:
    """Smallest x whose share of the total weight reaches p; equal values are merged first."""
    levels = df.groupBy(x).agg(F.sum(w).alias("_w"))
    run = durable(prefix_scan(levels, [], [x], {"_cum": ("sum", F.col("_w"))}))
    total = run.agg(F.max("_cum").alias("_all"))
    marks = run.transform(one_row, total).withColumn("p", F.explode(F.lit(list(ps)).cast("array<double>")))
    return marks.filter(F.col("_cum") >= F.col("p") * F.col("_all") * (1 - 1e-12)).groupBy("p").agg(F.min(x).alias("quantile"))


def floor_share(df: DataFrame, x: str, w: str, floor: float, slack: float = 1e-3) -> DataFrame:
    """Plain and weighted share of values at the floor."""
    low = F.col(x) <= floor + slack
    return df.agg(F.avg(low.cast("double")).alias("share"), (F.sum(F.when(low, F.col(w)).otherwise(0)) / F.sum(w)).alias("weighted_share"))


def top_p(cands: DataFrame, p: float, item: str = "item_id", choice: str = "choice_idx", score: str = "score") -> DataFrame:
    """Most probable candidates while their cumulative softmax stays within ``p``; at least one, renormalised."""
    top = cands.groupBy(item).agg(F.max(score).alias("_m"))
    weights = cands.select(item, choice, score).join(top, item).withColumn("_e", F.exp(F.col(score) - F.col("_m")))
    total = weights.groupBy(item).agg(F.sum("_e").alias("_z"))
    probs = weights.join(total, item).select(item, choice, (F.col("_e") / F.col("_z")).alias("prob"))
    run = prefix_scan(probs, [item], [F.col("prob").desc(), F.col(choice)], {"cum": ("sum", F.col("prob")), "rank": ("count", F.lit(1))})
    kept = durable(run.filter((F.col("cum") <= p) | (F.col("rank") == 1)))
    mass = kept.groupBy(item).agg(F.sum("prob").alias("_k"))
    return kept.join(mass, item).select(item, choice, "rank", "prob", (F.col("prob") / F.col("_k")).alias("renormalised"))


def topk_candidates(cands: DataFrame, k: int, item: str = "item_id", choice: str = "choice_idx", score: str = "score", sigma: str = "sigma", conf: str = "conf") -> DataFrame:
    """Among the ``k`` best-scored candidates: best score, smallest sigma, highest confidence."""
    top = top_per_group(cands, [item], [F.col(score).desc(), F.col(choice)], k, "_r")
    pick = lambda col, sign: (F.max(F.struct((F.col(col) * sign).alias("v"), (-F.col("_r")).alias("r"), F.col(choice).alias("c")))["c"])
    return top.groupBy(item).agg(
        F.count(F.lit(1)).alias("n"), pick(score, 1).alias("argmax_score"), pick(sigma, -1).alias("min_sigma"), pick(conf, 1).alias("max_conf")
    )


def displacement_axis(pairs: DataFrame, kind: str = "kind") -> DataFrame:
    """Per kind: length of source-to-variant differences, agreement with their mean direction,
    and the variance that direction explains.  The mean direction has d rows per kind."""
    diff = pairs.select(kind, F.zip_with(F.col("b").cast("array<double>"), F.col("a").cast("array<double>"), lambda y, x: y - x).alias("v"))
    mean = diff.select(kind, F.posexplode("v").alias("d", "x")).groupBy(kind, "d").agg(F.avg("x").alias("m"))
    axis = mean.groupBy(kind).agg(F.transform(F.sort_array(F.collect_list(F.struct("d", "m"))), lambda t: t["m"]).alias("axis"))
    rows = diff.join(axis.select(kind, unit_vector("axis").alias("axis")), kind).select(kind, norm("v").alias("len"), dot("v", "axis").alias("along"))
    return rows.groupBy(kind).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg("len").alias("len_mean"),
        F.stddev_pop("len").alias("len_std"),
        F.avg(F.when(F.col("len") > 1e-12, F.col("along") / F.col("len"))).alias("mean_cos"),
        (F.sum(F.col("along") * F.col("along")) / F.sum(F.col("len") * F.col("len"))).alias("explained"),
    )
