"""URL verdicts: rules by host and path, and trust carried along host links where no rule fits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import durable, ship

# The rules (verdict, host, path).
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
#: A host is a seed if the rules give more than this share of its pages one verdict.
SEED_SHARE = 0.6
DAMPING = 0.85
#: Rounds end when both sums together move by less.  They move by 2 * DAMPING ** rounds at most, so 104 rounds do; what then is still to come is under 6e-7.
TOLERANCE = 1e-7
#: Share of the two scores that must be distrust for a block.
BLOCK_SHARE = 0.5

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(_rest(url), F.lit("")), r"^[^/?#]*", 0), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(_rest(url), F.lit("")), r"^[^/?#]*([^?#]*)", 1)


def rule_for(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule that fits, as (rule, verdict), or null."""
    found = [F.lit(None).cast("struct<rule:string,verdict:string>")]
    for verdict, rule_host, rule_path in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        made = F.struct(F.lit(rule_host + rule_path).alias("rule"), F.lit(verdict).alias("verdict"))
        found.insert(0, F.when(fits, made))
    return F.coalesce(*found)


def host_edges(pages: DataFrame) -> DataFrame:
    """(src, dst, n) of ``pages`` (host, html): links to other hosts, with a scheme or beginning with //, counted once per page."""
    links = F.regexp_extract_all("html", F.lit(r"""(?i)href\s*=\s*["']?(?:[a-z][a-z0-9+.-]*:)?//([^/?#"'>\s]+)"""), 1)
    named = pages.filter("host <> ''")
    direct = named.select(F.col("host").alias("src"), F.explode(F.array_distinct(F.transform(links, lambda h: F.translate(h, _UPPER, _LOWER)))).alias("dst"))
    return direct.filter("src <> dst").groupBy("src", "dst").agg(F.count("*").alias("n"))


def family_edges(pages: DataFrame) -> DataFrame:
    """(parent, child): each host and the nearest parent domain that has pages too, whose owner answers for it."""
    hosts = pages.filter("host <> ''").select("host").distinct()
    labels = F.split("host", r"\.")
    ups = hosts.select(
        F.col("host").alias("child"),
        F.posexplode(F.transform(F.sequence(F.lit(2), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, 255), "."))).alias("up", "parent"),
    ).filter("child like '%.%'")
    return ups.join(hosts.withColumnRenamed("host", "parent"), "parent").groupBy("child").agg(F.min_by("parent", "up").alias("parent"))


def propagate(edges: DataFrame, seeds: DataFrame, family: DataFrame | None = None) -> DataFrame:
    """(host, trust, distrust): two personalised PageRanks, trust along the links and distrust against them.

    Both go from a parent domain to its children in ``family``.
    ``seeds`` has (host, good, bad), each column a distribution.  A host without links out gives its rank back to the seeds.
    Rounds end when both sums together move by less than TOLERANCE.
    """
    sides = edges.select(F.lit(True).alias("good"), F.col("src").alias("giver"), F.col("dst").alias("taker"), "n").unionByName(
        edges.select(F.lit(False).alias("good"), F.col("dst").alias("giver"), F.col("src").alias("taker"), "n")
    )
    if family is not None:
        down = family.select(F.col("parent").alias("giver"), F.col("child").alias("taker"), F.lit(1).cast("long").alias("n"))
        for good in (True, False):
            sides = sides.unionByName(down.select(F.lit(good).alias("good"), "giver", "taker", "n"))
        sides = sides.groupBy("good", "giver", "taker").agg(F.sum("n").alias("n"))
    # A third of all links may leave one host: totals are partial sums, and the join's other side is one row a host.
    total = sides.groupBy("good", "giver").agg(F.sum("n").alias("total"))
    moves = durable(sides.join(total, ["good", "giver"]).select("good", "giver", "taker", (F.col("n") / F.col("total")).alias("share")))
    seeded = seeds.select("host", F.explode(F.array(F.struct(F.lit(True).alias("good"), F.col("good").alias("seed")), F.struct(F.lit(False).alias("good"), F.col("bad").alias("seed")))).alias("s"))
    nothing = F.lit(0.0).alias("seed")
    nodes = seeded.select("host", "s.good", "s.seed")
    for end in ("giver", "taker"):
        nodes = nodes.unionByName(moves.select(F.col(end).alias("host"), "good", nothing))
    # What hosts without links hold, and what damping takes, goes back to the seeds in proportion.  The ranks then are the sums of
    # seed * (DAMPING * step) ** k over all k, scaled to 1, so that rounds carry no total and end early where links form no circle.
    start = nodes.groupBy("host", "good").agg(F.sum("seed").alias("seed"))
    rank = durable(start.select("host", "good", "seed", F.col("seed").alias("rank"), F.lit(0.0).alias("moved")))
    moved = 1.0 if moves.limit(1).count() else 0.0
    while moved >= TOLERANCE:
        sent = moves.join(rank.select(F.col("host").alias("giver"), "good", "rank").filter("rank > 0"), ["good", "giver"])
        got = sent.groupBy("good", F.col("taker").alias("host")).agg(F.sum(F.col("rank") * F.col("share")).alias("got"))
        settled = rank.withColumnRenamed("rank", "before").drop("moved").join(got, ["host", "good"], "left")
        settled = settled.withColumn("rank", F.col("seed") + DAMPING * F.coalesce("got", F.lit(0.0)))
        rank = durable(settled.select("host", "good", "seed", "rank", F.abs(F.col("rank") - F.col("before")).alias("moved")))
        moved = rank.agg(F.sum("moved")).first()[0]
    total = F.broadcast(rank.groupBy("good").agg(F.sum("rank").alias("total")))
    scaled = F.when(F.col("total") > 0, F.col("rank") / F.col("total")).otherwise(0.0)
    rank = rank.join(total, "good").select("host", "good", scaled.alias("rank"))
    pick = lambda good: F.sum(F.when(F.col("good") == good, F.col("rank")).otherwise(0.0))
    return rank.groupBy("host").agg(pick(True).alias("trust"), pick(False).alias("distrust"))


def judge(pages: DataFrame, rules=RULES, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """One row per page row: page_id, host, path, rule, verdict.

    Where no rule fits, the page's host decides: it is blocked if distrust is more than BLOCK_SHARE of its two ranks.
    Hosts that no seed reaches, pages without a host and null urls are allowed.  Null html has no links.
    Repeated rows are each answered; other columns are ignored.
    """
    ship(pages.sparkSession)
    rows = pages.select(
        F.col(page_id).alias("page_id"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"), F.col(html).cast("string").alias("html")
    )
    ruled = rows.select("page_id", "host", "path", rule_for(F.col("host"), F.col("path"), rules).alias("r")).select(
        "page_id", "host", "path", F.col("r.rule").alias("rule"), F.col("r.verdict").alias("verdict")
    )
    per_host = ruled.filter("host <> ''").groupBy("host").agg(
        F.count("*").alias("n"), F.sum((F.col("verdict") == "allow").cast("int")).alias("allowed"), F.sum((F.col("verdict") == "block").cast("int")).alias("blocked")
    )
    marked = durable(
        per_host.select(
            "host",
            (F.coalesce("allowed", F.lit(0)) > SEED_SHARE * F.col("n")).cast("double").alias("good"),
            (F.coalesce("blocked", F.lit(0)) > SEED_SHARE * F.col("n")).cast("double").alias("bad"),
        )
    )
    sums = marked.agg(F.sum("good").alias("good"), F.sum("bad").alias("bad")).first()
    seeds = marked.select("host", (F.col("good") / max(sums["good"] or 0, 1)).alias("good"), (F.col("bad") / max(sums["bad"] or 0, 1)).alias("bad"))
    ranks = propagate(host_edges(rows), seeds, family_edges(rows))
    bad = ranks.select("host", (F.col("distrust") > BLOCK_SHARE * (F.col("trust") + F.col("distrust"))).alias("bad"))
    told = F.when(F.col("bad"), "block").otherwise("allow")
    return ruled.join(bad, "host", "left").select("page_id", "host", "path", "rule", F.coalesce("verdict", told).alias("verdict"))
