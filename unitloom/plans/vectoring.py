"""Registered queries: vector analytics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import stats, vectors as vx
from ..operators.ordered import one_row, smallest
from ..functions import id_hash
from ..session import durable
from .common_sql import CHOICES, FREQ, hash60
from .corpus import word_freq
from .evaluation import choices
from .registry import query, table
from .statistics import rounded

TAUS = [1.0, 3.0, 10.0, 30.0, 100.0]


def vectors(spark, sf):
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vec"), "label")


def shifted(df):
    """Every vector moved by a fixed alternating step."""
    step = F.transform("vec", lambda x, i: x + F.when(i % 2 == 0, 0.05).otherwise(-0.05))
    return df.withColumn("vec", step)


_V = "v AS (SELECT vec_id AS id, embedding::DOUBLE[] AS vec, label FROM embeddings)"
_SHIFT = "sv AS (SELECT id, list_transform(vec, lambda x, i: x + CASE WHEN i % 2 = 1 THEN 0.05 ELSE -0.05 END) AS vec FROM v)"


@query(
    "G1_knn_cosine",
    f"""WITH {_V}, p AS (SELECT a.id AS query_id, b.id, round(list_cosine_similarity(a.vec, b.vec), 9) AS score FROM v a JOIN v b ON a.id <> b.id)
    SELECT query_id, id, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS place FROM p QUALIFY place <= 8""",
)
def knn_cosine(spark, sf):
    v = vectors(spark, sf).select("id", "vec")
    return rounded(vx.knn(v, v, 8), "score")


@query(
    "G1_knn_l2",
    f"""WITH {_V}, p AS (SELECT a.id AS query_id, b.id, round(-list_distance(a.vec, b.vec), 9) AS score FROM v a JOIN v b ON a.id <> b.id)
    SELECT query_id, id, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS place FROM p QUALIFY place <= 5""",
)
def knn_l2(spark, sf):
    v = vectors(spark, sf).select("id", "vec")
    return rounded(vx.knn(v, v, 5, "l2", pivots=16, block=128), "score")


@query(
    "G2_snap_to_table",
    f"""WITH {_V}, {_SHIFT}, p AS (SELECT a.id AS query_id, b.id, round(list_cosine_similarity(a.vec, b.vec), 9) AS score FROM sv a, v b)
    SELECT query_id, id, round(score, 6) AS score FROM p QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) = 1""",
)
def snap_to_table(spark, sf):
    v = vectors(spark, sf).select("id", "vec")
    return rounded(vx.snap_to_table(shifted(v), v), "score")


_MIX = f"""{_V}, vd AS (SELECT label, generate_subscripts(vec, 1) AS d, unnest(vec) AS x FROM v),
    pd AS (SELECT label, d, avg(x) AS m, greatest(stddev_pop(x), 0.05) AS s, count(*) AS n FROM vd GROUP BY ALL),
    mx AS (SELECT label, max(n) AS n, list(m ORDER BY d) AS mu, list(s ORDER BY d) AS sigma FROM pd GROUP BY label),
    jt AS (SELECT v.id, v.label AS own, mx.label, ln(mx.n / (SELECT sum(n) FROM mx)) - 0.5 * list_sum(list_transform(range(1, 65),
      lambda i: ((vec[i] - mu[i]) / sigma[i]) ** 2 + 2 * ln(sigma[i]))) - 32 * ln(2 * pi()) AS sc FROM v, mx),
    ld AS (SELECT id, max(sc) AS m, any_value(own) AS own FROM jt GROUP BY id),
    dn AS (SELECT jt.id, any_value(m) + ln(sum(exp(sc - m))) AS lse FROM jt JOIN ld USING (id) GROUP BY jt.id)"""


def scored(spark, sf):
    v = vectors(spark, sf)
    return vx.component_scores(v, durable(vx.group_mixture(v, "label")))


@query("G3_mixture_log_density", f"WITH {_MIX} SELECT id, round(lse, 6) AS log_density FROM dn")
def mixture_log_density(spark, sf):
    return rounded(vx.mixture_log_density(scored(spark, sf)).select("id", "log_density"), "log_density")


@query(
    "G4_mixture_stats",
    f"""WITH {_MIX}, r AS (SELECT id, exp(sc - lse) AS p FROM jt JOIN dn USING (id))
    SELECT id, round(-sum(p * ln(greatest(p, 1e-12))), 6) AS entropy, round(1 / sum(p * p), 6) AS effective, round(max(p), 6) AS top_share FROM r GROUP BY id""",
)
def mixture_stats(spark, sf):
    return rounded(vx.mixture_stats(scored(spark, sf)).select("id", "entropy", "effective", "top_share"), "entropy", "effective", "top_share")


@query(
    "G5_calibrate_temperature",
    f"""WITH {_MIX}, tb AS (SELECT * FROM jt WHERE label <> 9), ps AS (SELECT id, own, id * 2 < (SELECT max(id) + 1 FROM v) AS calib, strlen(id::VARCHAR) AS nb FROM ld),
    tt AS (SELECT unnest({TAUS})::DOUBLE AS tau), mm AS (SELECT id, max(sc) AS m FROM tb GROUP BY id),
    ls AS (SELECT tb.id, tau, any_value(m / tau) + ln(sum(exp(sc / tau - m / tau))) AS lse, max(sc) FILTER (label = own) AS t FROM tb JOIN mm USING (id), tt GROUP BY tb.id, tau),
    pn AS (SELECT ls.*, calib, nb, lse - t / tau AS nll FROM ls JOIN ps USING (id)),
    ag AS (SELECT tau, coalesce(sum(nll) FILTER (calib), 0) / greatest(count(nll) FILTER (calib), 1) AS nll_calib, count(*) FILTER (NOT calib) AS n_test,
      count(*) FILTER (NOT calib AND t IS NULL) AS n_missing, coalesce(sum(nll) FILTER (NOT calib), 0) AS tst, greatest(count(nll) FILTER (NOT calib), 1) AS n_in,
      sum(nb) FILTER (NOT calib) AS b_all, sum(nb) FILTER (NOT calib AND t IS NOT NULL) AS b_in FROM pn GROUP BY tau)
    SELECT tau, round(nll_calib, 6) AS nll_calib, n_test, n_missing, round(exp((tst + n_missing * ln(9)) / n_test), 6) AS ppl, round((tst + n_missing * ln(9)) * log2(exp(1)) / b_all, 6) AS bpb,
      round(exp(tst / n_in), 6) AS ppl_covered, round(tst * log2(exp(1)) / b_in, 6) AS bpb_covered, row_number() OVER (ORDER BY nll_calib, tau) = 1 AS best FROM ag""",
)
def calibrate_temperature(spark, sf):
    """Components as table entries; label 9 plays the string missing from the table."""
    s = scored(spark, sf).select("id", "label", F.arrays_zip("labels", "scores").alias("z"))
    s = s.withColumn("z", F.filter("z", lambda c: c["labels"] != 9))
    own = F.get(F.filter("z", lambda c: c["labels"] == F.col("label")), F.lit(0))["scores"]
    last = s.agg(F.max("id").alias("_last"))
    rows = s.transform(one_row, last).select(
        F.transform("z", lambda c: c["scores"]).alias("scores"),
        own.alias("true_score"),
        F.octet_length(F.col("id").cast("string")).alias("n_bytes"),
        (F.col("id") * 2 < F.col("_last") + 1).alias("calib"),
    )
    return rounded(vx.calibrate_temperature(rows, TAUS, F.size("scores")), "nll_calib", "ppl", "bpb", "ppl_covered", "bpb_covered")


@query(
    "G6_anisotropy",
    f"""WITH {_V}, p AS (SELECT list_cosine_similarity(a.vec, b.vec) AS c FROM v a JOIN v b ON a.id <> b.id) SELECT (SELECT count(*) FROM v) AS n, round(avg(c), 6) AS mean_cos FROM p""",
)
def anisotropy(spark, sf):
    return rounded(vx.anisotropy(vectors(spark, sf)), "mean_cos")


@query(
    "G6_sampled_anisotropy",
    f"""WITH {_V}, o AS (SELECT row_number() OVER (ORDER BY id) - 1 AS p, vec FROM v), d AS (SELECT {hash60("'3i'", "k")} % (SELECT count(*) FROM v) AS i, {hash60("'3j'", "k")} % (SELECT count(*) FROM v) AS j FROM range(20000) t(k)),
    c AS (SELECT list_cosine_similarity(a.vec, b.vec) AS c FROM d JOIN o a ON a.p = d.i JOIN o b ON b.p = d.j)
    SELECT count(*) AS n_pairs, round(avg(c), 6) AS mean_cos, round(avg(abs(c)), 6) AS mean_abs, round(stddev_pop(c), 6) AS std FROM c""",
)
def sampled_anisotropy(spark, sf):
    return rounded(vx.sampled_anisotropy(vectors(spark, sf), 20000, 3), "mean_cos", "mean_abs", "std")


@query(
    "G7_participation_variance",
    f"""WITH {_V}, e AS (SELECT id, generate_subscripts(vec, 1) AS d, unnest(vec) AS x FROM v), m AS (SELECT d, avg(x) AS m FROM e GROUP BY d), c AS (SELECT id, d, x - m AS x FROM e JOIN m USING (d)),
    cov AS (SELECT a.d AS i, b.d AS j, sum(a.x * b.x) / (SELECT count(*) FROM v) AS c FROM c a JOIN c b USING (id) GROUP BY ALL)
    SELECT round(sum(CASE WHEN i = j THEN c ELSE 0 END) ** 2 / sum(c * c), 6) AS participation_variance FROM cov""",
)
def participation_variance(spark, sf):
    return rounded(vx.participation_by_variance(vx.covariance(vectors(spark, sf))), "participation_variance")


@query("G7_spectrum")
def spectrum(spark, sf):
    return vx.spectrum(vx.covariance(vectors(spark, sf)))


@query(
    "G8_dim_health",
    f"""WITH {_V}, e AS (SELECT generate_subscripts(vec, 1) AS d, unnest(vec) AS x FROM v), p AS (SELECT d, var_pop(x) AS v FROM e GROUP BY d), l AS (SELECT sqrt(list_sum(list_transform(vec, lambda x: x * x))) AS l FROM v)
    SELECT * FROM (SELECT count(*) AS d, sum((v < 1e-4 * (SELECT max(v) FROM p))::INT)::BIGINT AS dead, round(quantile_cont(v, 0.5) / max(v), 6) AS median_ratio FROM p),
      (SELECT round(avg(l), 6) AS norm_mean, round(stddev_pop(l), 6) AS norm_std, round(min(l), 6) AS norm_min, round(max(l), 6) AS norm_max FROM l)""",
)
def dim_health(spark, sf):
    return rounded(vx.dim_health(vectors(spark, sf)), "median_ratio", "norm_mean", "norm_std", "norm_min", "norm_max")


_KNN5 = f"""{_V}, p AS (SELECT a.id AS q, b.id, round(list_cosine_similarity(a.vec, b.vec), 9) AS score FROM v a JOIN v b ON a.id <> b.id),
    nn AS (SELECT q, id FROM p QUALIFY row_number() OVER (PARTITION BY q ORDER BY score DESC, id) <= 5)"""


@query(
    "G9_knn_clustering_coeff",
    f"""WITH {_KNN5}, s AS (SELECT q AS a, id AS b FROM nn UNION SELECT id, q FROM nn), dg AS (SELECT a, count(*) AS deg FROM s GROUP BY a),
    t AS (SELECT x.a, count(*) AS links FROM s x JOIN s y ON x.a = y.a AND x.b < y.b JOIN s z ON z.a = x.b AND z.b = y.b GROUP BY x.a)
    SELECT count(*) AS n, round(avg(2 * coalesce(links, 0) / (deg * (deg - 1))), 6) AS clustering FROM dg LEFT JOIN t USING (a) WHERE deg >= 2""",
)
def clustering_coefficient(spark, sf):
    v = vectors(spark, sf).select("id", "vec")
    return rounded(vx.clustering_coefficient(vx.knn(v, v, 5)), "clustering")


@query("G10_cluster_quality")
def cluster_quality(spark, sf):
    return vx.cluster_quality(vectors(spark, sf))


_BUCKET = f"{_V}, b AS (SELECT label, list_position(vec, list_max(vec))::BIGINT AS bucket FROM v)"


def bucketed(spark, sf):
    return vectors(spark, sf).select("label", F.array_position("vec", F.array_max("vec")).alias("bucket"))


@query(
    "G11_nmi",
    f"""WITH {_BUCKET}, c AS (SELECT label, bucket, count(*) AS n FROM b GROUP BY ALL), t AS (SELECT sum(n) AS t FROM c),
    ha AS (SELECT ln(any_value(t)) - sum(m * ln(m)) / any_value(t) AS h FROM (SELECT label, sum(n) AS m FROM c GROUP BY label), t),
    hb AS (SELECT ln(any_value(t)) - sum(m * ln(m)) / any_value(t) AS h FROM (SELECT bucket, sum(n) AS m FROM c GROUP BY bucket), t),
    hab AS (SELECT ln(any_value(t)) - sum(n * ln(n)) / any_value(t) AS h FROM c, t)
    SELECT t::BIGINT AS n, round(ha.h + hb.h - hab.h, 6) AS mutual, round((ha.h + hb.h - hab.h) / ((ha.h + hb.h) / 2), 6) AS nmi FROM t, ha, hb, hab""",
)
def nmi(spark, sf):
    return rounded(vx.nmi(bucketed(spark, sf), "label", "bucket"), "mutual", "nmi")


@query(
    "G11_purity",
    f"""WITH {_BUCKET}, c AS (SELECT bucket, label, count(*) AS n FROM b GROUP BY ALL)
    SELECT bucket, sum(n)::BIGINT AS n, first(label ORDER BY n DESC, label) AS majority, round(max(n) / sum(n), 6) AS share FROM c GROUP BY bucket""",
)
def purity(spark, sf):
    return rounded(vx.purity(bucketed(spark, sf), "bucket", "label"), "share")


@query(
    "G11_cluster_listing",
    f"""WITH {_BUCKET}, m AS (SELECT list_position(vec, list_max(vec))::BIGINT AS bucket, id FROM v), s AS (SELECT bucket, count(*) AS n FROM m GROUP BY bucket),
    d AS (SELECT bucket, id, row_number() OVER (PARTITION BY bucket ORDER BY {hash60("'19'", "id")}, id) AS p FROM m QUALIFY p <= 5)
    SELECT s.bucket, n, row_number() OVER (ORDER BY n DESC, s.bucket) AS place, (SELECT string_agg(id::VARCHAR, ',' ORDER BY p) FROM d WHERE d.bucket = s.bucket) AS members FROM s""",
)
def cluster_listing(spark, sf):
    members = vectors(spark, sf).select("id", F.array_position("vec", F.array_max("vec")).alias("bucket"))
    listed = vx.cluster_listing(members, "bucket", "id", 5, 19)
    return listed.withColumn("members", F.array_join(F.col("members").cast("array<string>"), ","))


@query(
    "G12_intra_cluster_edit",
    f"""WITH {FREQ}, d AS (SELECT strlen(unit) AS cluster, unit, row_number() OVER (PARTITION BY strlen(unit) ORDER BY {hash60("'13'", "unit")}, unit) AS p FROM freq QUALIFY p <= 100),
    h AS (SELECT cluster, count(*) // 2 AS half FROM d GROUP BY cluster HAVING count(*) >= 4),
    j AS (SELECT a.cluster, levenshtein(a.unit, b.unit) / greatest(strlen(a.unit), strlen(b.unit), 1) AS ned
      FROM d a JOIN h USING (cluster) JOIN d b ON a.cluster = b.cluster AND b.p = a.p + half WHERE a.p <= half)
    SELECT cluster, count(*) AS n_pairs, round(avg(ned), 6) AS mean_ned FROM j GROUP BY cluster""",
)
def intra_cluster_edit(spark, sf):
    units = word_freq(spark, sf).select(F.octet_length("unit").cast("bigint").alias("cluster"), "unit")
    return rounded(vx.intra_cluster_edit(units, "cluster", 50, 13), "mean_ned")


#: Anchors whose surroundings are measured, and neighbours looked at: the sizes of the report.
ANCHORS, ANCHOR_NEIGHBOURS = 100, 10


_CUTS = ", ".join(f"round(quantile_cont(dist, {p / 100}), 6) AS p{p}" for p in (10, 25, 50, 75))


@query(
    "G13_variant_spacing",
    f"""WITH {FREQ}, u AS MATERIALIZED (SELECT unit, row_number() OVER (ORDER BY cnt DESC, unit) AS id, '^' || unit || '$' AS p FROM freq),
    g AS (SELECT id, unit, list_transform(range(1, length(p)), lambda i: {hash60("substr(p, i, 2)")} % 32) AS grams FROM u),
    v AS MATERIALIZED (SELECT id, unit, list_transform(range(0, 32), lambda d: len(list_filter(grams, lambda x: x = d))::DOUBLE) AS vec FROM g),
    a AS MATERIALIZED (SELECT * FROM v ORDER BY {hash60("'anchor'", "unit")}, id LIMIT {ANCHORS}),
    n AS (SELECT a.id AS anchor, a.unit AS x, v.unit AS y, round(list_distance(a.vec, v.vec), 9) AS dist FROM a JOIN v ON a.id <> v.id
      QUALIFY row_number() OVER (PARTITION BY a.id ORDER BY round(list_distance(a.vec, v.vec), 9), v.id) <= {ANCHOR_NEIGHBOURS}),
    e AS MATERIALIZED (SELECT anchor, dist, least(levenshtein(x, y), 4) AS edits FROM n),
    near AS (SELECT min(dist) AS dist FROM e WHERE edits <= 2 GROUP BY anchor)
    SELECT edits::BIGINT AS edits, count(*) AS n, {_CUTS}, NULL::DOUBLE AS p90 FROM e GROUP BY edits
    UNION ALL SELECT -1, count(*), {_CUTS}, round(quantile_cont(dist, 0.9), 6) FROM near""",
)
def variant_spacing(spark, sf):
    """Spacing of the neighbours of hash-drawn anchors among all units."""
    ranked = stats.unit_freq(word_freq(spark, sf))
    strings = durable(ranked.select(F.col("rnk").alias("id"), "unit", vx.ngram_vector("unit").alias("vec")))
    anchors = smallest(strings.withColumn("_h", id_hash(F.lit("anchor"), "unit")), ["_h", "id"], ANCHORS).select("id", "vec")
    spacing, nearest = vx.variant_spacing(vx.knn(anchors, strings.select("id", "vec"), ANCHOR_NEIGHBOURS, "l2"), strings)
    both = spacing.withColumn("p90", F.lit(None).cast("double")).unionByName(nearest.withColumn("edits", F.lit(-1).cast("bigint")))
    return rounded(both.withColumn("edits", F.col("edits").cast("bigint")), "p10", "p25", "p50", "p75", "p90")


@query(
    "G14_cloud_margin",
    f"""WITH {_V}, {_SHIFT}, o AS (SELECT a.id, max(round(list_cosine_similarity(a.vec, b.vec), 9)) AS co FROM v a JOIN v b ON a.id <> b.id GROUP BY a.id),
    s AS (SELECT a.id, max(round(list_cosine_similarity(a.vec, b.vec), 9)) AS cs FROM sv a JOIN v b ON a.id <> b.id GROUP BY a.id),
    w AS (SELECT v.id, list_cosine_similarity(v.vec, sv.vec) AS own FROM v JOIN sv USING (id)),
    m AS (SELECT (1 - co) - (1 - own) AS margin, cs > own AS collides FROM o JOIN s USING (id) JOIN w USING (id))
    SELECT count(*) AS n, round(avg(margin), 6) AS margin_mean, round(avg((margin < 0)::INT), 6) AS negative, round(avg(collides::INT), 6) AS collision_rate FROM m""",
)
def cloud_margin(spark, sf):
    v = vectors(spark, sf).select("id", "vec")
    return rounded(vx.margin_report(vx.cloud_margin(v, shifted(v))), "margin_mean", "negative", "collision_rate")


@query(
    "G15_weighted_quantiles",
    """WITH l AS (SELECT l_extendedprice AS x, sum(l_quantity) AS w FROM lineitem GROUP BY 1), c AS (SELECT x, sum(w) OVER (ORDER BY x) AS cum FROM l), p AS (SELECT unnest([0.05, 0.25, 0.5, 0.75, 0.95])::DOUBLE AS p)
    SELECT p, min(x) AS quantile FROM c, p WHERE cum >= p * (SELECT sum(w) FROM l) * (1 - 1e-12) GROUP BY p""",
)
def weighted_quantiles(spark, sf):
    return vx.weighted_quantiles(table(spark, sf, "lineitem"), "l_extendedprice", "l_quantity", [0.05, 0.25, 0.5, 0.75, 0.95])


@query(
    "G15_floor_share",
    "SELECT round(avg((l_discount <= 0.01 + 1e-3)::INT), 6) AS share, round(sum(CASE WHEN l_discount <= 0.01 + 1e-3 THEN l_quantity ELSE 0 END) / sum(l_quantity), 6) AS weighted_share FROM lineitem",
)
def floor_share(spark, sf):
    return rounded(vx.floor_share(table(spark, sf, "lineitem"), "l_discount", "l_quantity", 0.01), "share", "weighted_share")


@query(
    "G16_top_p",
    f"""WITH {CHOICES}, s AS (SELECT item_id, choice_idx, raw / 20000 AS s FROM choices), e AS (SELECT *, exp(s - max(s) OVER (PARTITION BY item_id)) AS e FROM s),
    p AS (SELECT item_id, choice_idx, e / sum(e) OVER (PARTITION BY item_id) AS prob FROM e),
    c AS (SELECT *, sum(prob) OVER w AS cum, row_number() OVER w AS rank FROM p WINDOW w AS (PARTITION BY item_id ORDER BY prob DESC, choice_idx ROWS UNBOUNDED PRECEDING)),
    k AS (SELECT * FROM c WHERE cum <= 0.95 OR rank = 1)
    SELECT item_id, choice_idx, rank, round(prob, 6) AS prob, round(prob / sum(prob) OVER (PARTITION BY item_id), 6) AS renormalised FROM k""",
)
def top_p(spark, sf):
    cands = choices(spark, sf).select("item_id", "choice_idx", (F.col("raw") / 20000).alias("score"))
    return rounded(vx.top_p(cands, 0.95), "prob", "renormalised")


@query(
    "G17_topk_candidates",
    f"""WITH {CHOICES}, r AS (SELECT item_id, choice_idx, raw, n_units, n_chars, row_number() OVER (PARTITION BY item_id ORDER BY raw DESC, choice_idx) AS r FROM choices QUALIFY r <= 4)
    SELECT item_id, count(*) AS n, first(choice_idx ORDER BY raw DESC, r) AS argmax_score, first(choice_idx ORDER BY n_units, r) AS min_sigma, first(choice_idx ORDER BY n_chars DESC, r) AS max_conf FROM r GROUP BY item_id""",
)
def topk_candidates(spark, sf):
    c = choices(spark, sf).select("item_id", "choice_idx", F.col("raw").alias("score"), F.col("n_units").alias("sigma"), F.col("n_chars").alias("conf"))
    return vx.topk_candidates(c, 4)


@query(
    "G18_displacement_axis",
    f"""WITH {_V}, s AS (SELECT label, arg_min(vec, id) AS a, min(id) AS first FROM v GROUP BY label), d AS (SELECT label AS kind, id, list_transform(range(1, 65), lambda i: vec[i] - a[i]) AS v FROM v JOIN s USING (label) WHERE id <> first),
    e AS (SELECT kind, id, generate_subscripts(v, 1) AS d, unnest(v) AS x FROM d), m AS (SELECT kind, d, avg(x) AS m FROM e GROUP BY ALL), ml AS (SELECT kind, sqrt(sum(m * m)) AS l FROM m GROUP BY kind),
    r AS (SELECT kind, id, sqrt(sum(x * x)) AS len, sum(x * m / l) AS along FROM e JOIN m USING (kind, d) JOIN ml USING (kind) GROUP BY ALL)
    SELECT kind, count(*) AS n, round(avg(len), 6) AS len_mean, round(stddev_pop(len), 6) AS len_std, round(avg(along / len), 6) AS mean_cos, round(sum(along * along) / sum(len * len), 6) AS explained FROM r GROUP BY kind""",
)
def displacement_axis(spark, sf):
    """Each label's first vector as the source, the others as its variants."""
    v = vectors(spark, sf)
    first = v.groupBy("label").agg(F.min_by("vec", "id").alias("a"), F.min("id").alias("_first"))
    pairs = v.join(first, "label").filter("id <> _first").select(F.col("label").alias("kind"), "a", F.col("vec").alias("b"))
    return rounded(vx.displacement_axis(pairs), "len_mean", "len_std", "mean_cos", "explained")
