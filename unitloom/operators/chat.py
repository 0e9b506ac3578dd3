"""Conversations: rendering with role markers, target spans and unit targets.

A conversation is never assembled in one place.  Every marker opens with ``<|``
followed by letters, and between a symbol and a letter the word splitter always cuts.
So the text is handled in pieces that run from one marker's letters to the next
marker's ``<|``; splitting the pieces gives exactly the units of the whole rendering,
and a target test needs only the byte range of the piece's own turn.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions import WORD_PREV, ratio, start_offsets
from .ordered import one_row, prefix_scan
from .segment import unit_array

# Role markers, the end marker and the spellings of the roles.
MARKERS = {"system": "<|system|>", "user": "<|user|>", "assistant": "<|assistant|>"}
END = "<|end|>"
ROLE_NAMES = {"user": "user", "human": "user", "assistant": "assistant", "gpt": "assistant", "bot": "assistant", "system": "system"}
MARKER_WORDS = ("user", "assistant", "system", "end")
SEPARATORS = {"newline": "\n", "space": " ", "none": ""}
OPEN = "<|"


def normalize_turns(df: DataFrame, key: str = "conv_id") -> DataFrame:
    """Flat (key, turn, role, text) from either nested conversation layout, chosen by schema."""
    columns = df.columns
    nested = next((c for c in ("messages", "conversations", "conversation") if c in columns), None)
    if nested is None:
        raise ValueError(f"no conversation column in {columns}")
    fields = df.schema[nested].dataType.elementType
    role = next(n for n in ("from", "role") if n in fields.names) if nested != "messages" else "role"
    content = next(n for n in ("value", "content") if n in fields.names) if nested != "messages" else "content"
    rows = df.select(key, F.posexplode(nested).alias("turn", "_m"))
    text: Column = F.col(f"_m.{content}")
    if isinstance(fields[content].dataType, T.ArrayType):
        text = F.array_join(F.transform(text, lambda part: F.coalesce(part["text"].cast("string"), F.lit(""))), " ")
    return rows.select(
        key, F.col("turn").cast("bigint").alias("turn"), F.coalesce(F.col(f"_m.{role}"), F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text")
    )


def canonical_role(role: Column) -> Column:
    names = F.create_map(*[F.lit(x) for pair in ROLE_NAMES.items() for x in pair])
    return F.coalesce(names[F.lower(role)], F.lit("other"))


def render_turns(turns: DataFrame, sep: Column | None = None, system: bool = True, keys: Sequence[str] = ("conv_id",)) -> DataFrame:
    """Every turn rendered, with its place in the rendering of its conversation.

    ``start``/``end`` are byte offsets; ``target_from``/``target_to`` cover an assistant
    turn's content and end marker and are NULL for other roles.
    """
    sep = F.lit("") if sep is None else sep
    role = canonical_role(F.col("role"))
    marked = ["user", "assistant"] + (["system"] if system else [])
    marker = F.coalesce(
        F.create_map(*[F.lit(x) for r in marked for x in (r, MARKERS[r])])[role], F.lit("")
    )
    end = F.when(role == "assistant", END).otherwise("")
    rows = turns.select(
        *keys, "turn", role.alias("role"), marker.alias("_marker"), F.concat(F.col("text"), end).alias("_body"), sep.alias("_sep")
    )
    rows = rows.withColumn("text", F.concat("_marker", "_body", "_sep"))
    size = F.octet_length("text").cast("bigint")
    marked_turn = F.col("_marker") != ""
    placed = prefix_scan(
        rows.select(*keys, "turn", size.alias("size"), marked_turn.alias("marked")),
        list(keys),
        ["turn"],
        {"end": ("sum", F.col("size")), "piece": ("sum", F.col("marked").cast("bigint")), "_nth": ("count", F.lit(1))},
    )
    last = placed.groupBy(*keys).agg(F.max("_nth").alias("_turns"))
    out = rows.join(placed.join(last, list(keys)), [*keys, "turn"])
    start = F.col("end") - F.col("size")
    target_from = start + F.octet_length("_marker")
    is_target = F.col("role") == "assistant"
    return out.select(
        *keys,
        "turn",
        "role",
        "text",
        start.alias("start"),
        "end",
        F.when(is_target, target_from).alias("target_from"),
        F.when(is_target, target_from + F.octet_length("_body")).alias("target_to"),
        "piece",
        (F.col("_nth") == 1).alias("first_turn"),
        (F.col("_nth") == F.col("_turns")).alias("last_turn"),
    )


def target_spans(rendered: DataFrame, keys: Sequence[str] = ("conv_id",)) -> DataFrame:
    return rendered.filter("target_from IS NOT NULL").select(*keys, "turn", F.col("target_from").alias("s"), F.col("target_to").alias("e"))


def chat_units(rendered: DataFrame, keys: Sequence[str] = ("conv_id",), l_max: int | None = 32) -> DataFrame:
    """Units of the rendered conversations with byte offset and target flag.

    Turns without a marker are glued to the marked turn before them, because there the
    splitter may join across the border.
    """
    glued = F.sort_array(F.collect_list(F.struct("turn", "text")))
    pieces = rendered.groupBy(*keys, "piece").agg(
        F.array_join(F.transform(glued, lambda t: t["text"]), "").alias("text"),
        F.min("start").alias("start"),
        F.min("target_from").alias("target_from"),
        F.min("target_to").alias("target_to"),
        F.max("first_turn").alias("first_turn"),
        F.max("last_turn").alias("last_turn"),
    )
    opened = F.when(F.col("first_turn"), F.col("text")).otherwise(F.substring("text", len(OPEN) + 1, 2147483647))
    cut = pieces.withColumn("_text", F.concat(opened, F.when(F.col("last_turn"), "").otherwise(OPEN))).withColumn(
        "_start", F.when(F.col("first_turn"), F.col("start")).otherwise(F.col("start") + len(OPEN))
    )
    rows = cut.withColumn("_units", unit_array("_text", WORD_PREV, l_max))
    at = start_offsets(F.transform("_units", lambda u: F.octet_length(u)))
    out = rows.select(
        *keys, "_start", "target_from", "target_to", F.explode(F.arrays_zip(F.col("_units").alias("unit"), at.alias("at"))).alias("_u")
    )
    off = F.col("_start") + F.col("_u.at")
    inside = (off >= F.col("target_from")) & (off < F.col("target_to"))
    return out.select(
        *keys,
        off.alias("byte_off"),
        F.col("_u.unit").alias("unit"),
        F.octet_length("_u.unit").cast("bigint").alias("n_bytes"),
        F.coalesce(inside, F.lit(False)).alias("is_target"),
    )


def conversation_sizes(units: DataFrame, turns: DataFrame) -> DataFrame:
    per_conv = units.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n_units"), F.sum(F.col("is_target").cast("bigint")).alias("n_target"))
    per_turn = turns.groupBy("conv_id").agg(F.sum(F.length("text").cast("bigint")).alias("n_chars"), F.count(F.lit(1)).alias("n_turns"))
    return per_conv.join(per_turn, "conv_id")


def sft_profile(sizes: DataFrame, size: int) -> DataFrame:
    """Length percentiles, target share and the share of conversations over ``size`` units."""
    return sizes.agg(
        F.count(F.lit(1)).alias("n_convs"),
        *[
            f.alias(f"{c}_{name}")
            for c in ("n_units", "n_chars")
            for name, f in (
                ("mean", F.avg(c)),
                ("p50", F.percentile(c, F.lit(0.5))),
                ("p90", F.percentile(c, F.lit(0.9))),
                ("p99", F.percentile(c, F.lit(0.99))),
                ("max", F.max(c)),
            )
        ],
        (F.sum("n_target") / F.sum("n_units")).alias("target_share"),
        F.avg((F.col("n_units") > size).cast("double")).alias("truncated"),
    )


def turn_histogram(sizes: DataFrame) -> DataFrame:
    return sizes.groupBy("n_turns").agg(F.count(F.lit(1)).alias("n_convs"))


def epoch_estimate(profile: DataFrame, total_rows: int, units_per_step: int, seconds_per_step: float) -> DataFrame:
    """Units, steps and hours of one pass over ``total_rows`` conversations of this profile."""
    units = F.col("n_units_mean") * F.lit(total_rows)
    steps = units / F.lit(units_per_step)
    return profile.select(
        units.alias("units"), steps.alias("steps"), (steps * F.lit(seconds_per_step) / 3600).alias("hours")
    )


def is_markerish(unit: Column) -> Column:
    return unit.contains("<|") | unit.contains("|>") | unit.isin(*MARKER_WORDS)


def is_cross_turn(unit: Column) -> Column:
    return unit.contains("|>") & unit.contains("<|")


def marker_forms(units: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Counts of marker-like units; counting comes first, so hot forms are combined early."""
    return (
        units.filter(is_markerish(F.col("unit")))
        .groupBy(*by, "unit")
        .agg(F.count(F.lit(1)).alias("cnt"))
        .withColumn("cross_turn", is_cross_turn(F.col("unit")))
    )


def compare_separators(turns: DataFrame, scorer=None, thresh: float = 0.2) -> DataFrame:
    """Target share, cross-turn merges and (with a scorer) flagged share for every separator.

    The recommended separator has the smallest (merge share, flag share).
    """
    keys = ["sep_name", "conv_id"]
    variants = F.array(*[F.struct(F.lit(n).alias("sep_name"), F.lit(s).alias("sep")) for n, s in SEPARATORS.items()])
    triple = turns.select("*", F.inline(variants))
    units = chat_units(render_turns(triple, F.col("sep"), keys=keys), keys)
    counts = units.groupBy("sep_name", "unit").agg(
        F.count(F.lit(1)).alias("cnt"), F.sum(F.col("is_target").cast("bigint")).alias("n_target")
    )
    if scorer is not None:
        scored = scorer(counts.select("unit").distinct())
        bad = scored.select("unit", (~F.col("ok") | (F.col("entropy") > thresh)).alias("bad"))
        counts = counts.join(bad, "unit", "left")
    else:
        counts = counts.withColumn("bad", F.lit(False))
    mark, cross = is_markerish(F.col("unit")), is_cross_turn(F.col("unit"))
    total = lambda cond: F.sum(F.when(cond, F.col("cnt")).otherwise(0))
    table = counts.groupBy("sep_name").agg(
        F.sum("cnt").alias("n_units"),
        F.sum("n_target").alias("n_target"),
        total(cross).alias("n_cross"),
        total(mark).alias("n_marker"),
        total(F.col("bad")).alias("n_flag"),
        total(F.col("bad") & mark).alias("n_flag_marker"),
    )
    table = table.select(
        "*", ratio("n_target", "n_units").alias("target_share"), ratio("n_cross", "n_units").alias("cross_share"), ratio("n_flag", "n_units").alias("flag_share")
    )
    best = table.agg(F.min_by("sep_name", F.struct("cross_share", "flag_share", "sep_name")).alias("_best"))
    return table.transform(one_row, best).withColumn("recommended", F.col("sep_name") == F.col("_best")).drop("_best")


def truncate_context(pairs: DataFrame, max_len: int, ctx: str = "ctx_units", cont: str = "cont_units") -> DataFrame:
    """Keep the continuation (cut right if too long by itself) and the nearest context units."""
    keep = F.greatest(F.lit(max_len) - F.size(cont), F.lit(0))
    new_ctx = F.when(keep == 0, F.array().cast("array<string>")).when(F.size(ctx) <= keep, F.col(ctx)).otherwise(
        F.slice(F.col(ctx), F.greatest(F.size(ctx) - keep + 1, F.lit(1)), F.greatest(keep, F.lit(1)))
    )
    return pairs.select(
        *[c for c in pairs.columns if c not in (ctx, cont)], new_ctx.alias(ctx), F.slice(F.col(cont), 1, max_len).alias(cont)
    )


def split_by_byte_boundary(pairs: DataFrame, ctx: str = "ctx", cont: str = "cont", l_max: int | None = 32) -> DataFrame:
    """Units of (context, continuation) cut jointly and assigned by their first byte.

    Trailing blanks of the context move to the continuation.  If the joint cut gives the
    continuation a different number of units than cutting it alone, both are cut
    separately (``fallback``).
    """
    head = F.regexp_replace(F.col(ctx), r"(?U)\s+$", "")
    rows = pairs.withColumn("_ctx", head).withColumn(
        "_cont", F.concat(F.substring(F.col(ctx), F.length(head) + 1, F.lit(2147483647)), F.col(cont))
    )
    rows = rows.withColumn("_full", unit_array(F.concat("_ctx", "_cont"), WORD_PREV, l_max))
    rows = rows.withColumn("_own", unit_array(F.regexp_replace("_cont", r"(?U)^\s+", ""), WORD_PREV, l_max))
    rows = rows.withColumn("_at", start_offsets(F.transform("_full", lambda u: F.octet_length(u))))
    rows = rows.withColumn("_n_ctx", F.size(F.filter("_at", lambda at: at < F.octet_length("_ctx"))))
    n_joint = F.size("_full") - F.col("_n_ctx")
    rows = rows.withColumn("fallback", (n_joint == 0) | (n_joint != F.size("_own")))
    part = lambda start, n: F.slice(F.col("_full"), start, F.greatest(n, F.lit(0)))
    return rows.select(
        *pairs.columns,
        F.when(F.col("fallback"), unit_array("_ctx", WORD_PREV, l_max)).otherwise(part(F.lit(1), F.col("_n_ctx"))).alias("ctx_units"),
        F.when(F.col("fallback"), F.col("_own")).otherwise(part(F.col("_n_ctx") + 1, n_joint)).alias("cont_units"),
        "fallback",
    )
