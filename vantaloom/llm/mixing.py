"""Mixing sources to target weights by Pfair scheduling."""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import global_rank, partitions

#: Slots of one period of the schedule: the resolution of the weights.
SLOTS = 1000


def whole_weights(weights: dict[str, float], slots: int = SLOTS) -> dict[str, int]:
    """Weights as integers of about `slots` in all, each at least 1: largest remainders."""
    total = sum(Fraction(w) for w in weights.values())
    exact = {s: Fraction(w) * slots / total for s, w in weights.items()}
    out = {s: max(1, int(x)) for s, x in exact.items()}
    short = slots - sum(out.values())
    for s in sorted(exact, key=lambda s: (int(exact[s]) - exact[s], s))[: max(0, short)]:
        out[s] += 1
    return out


def pfair_period(weights: dict[str, int]) -> list[str]:
    """The source of each slot of one period, by earliest deadline first.

    Block i (from 1) of a source with w of W slots is released at floor((i-1)W/w) and due at
    ceil(iW/w). The weights fill the processor, so every deadline is met; with the releases, a
    source is less than one block from its share after every slot. Ties go by source."""
    period = sum(weights.values())
    done = dict.fromkeys(weights, 0)
    out = []
    for slot in range(period):
        ready = [(-(-(done[s] + 1) * period // w), s) for s, w in weights.items() if done[s] < w and done[s] * period // w <= slot]
        source = min(ready)[1]
        done[source] += 1
        out.append(source)
    return out


def plan(blocks: dict[str, int], weights: dict[str, int]) -> tuple[list[tuple], list[tuple]]:
    """Phases and slots of the schedule that emits every block once.

    When a source has run out, the rest go on by their own weights in a new phase; so there are as
    many phases as sources at most. Returns (source, phase, first block, last block + 1, weight,
    period, first slot) and (phase, source, place in the period, slot in the period). Both are
    bounded by sources * SLOTS, whatever the number of rows."""
    left = {s: n for s, n in blocks.items() if n}
    done = dict.fromkeys(left, 0)
    phases, slots, slot, phase = [], [], 0, 0
    while left:
        own = {s: weights[s] for s in left}
        period = pfair_period(own)
        place: dict[str, int] = dict.fromkeys(own, 0)
        at: dict[str, list[int]] = {s: [] for s in own}
        for i, s in enumerate(period):
            slots.append((phase, s, place[s], i))
            at[s].append(i)
            place[s] += 1
        rounds = min(n // own[s] for s, n in left.items())
        rest = {s: n - rounds * own[s] for s, n in left.items()}
        end = min(at[s][n] for s, n in rest.items() if n < own[s])
        for s, w in own.items():
            n = rounds * w + sum(i < end for i in at[s])
            phases.append((s, phase, done[s], done[s] + n, w, len(period), slot))
            done[s] += n
            left[s] -= n
        slot += rounds * len(period) + end
        left = {s: n for s, n in left.items() if n}
        phase += 1
    return phases, slots


def tempered(counts: dict[str, int], power: float = 0.7) -> dict[str, float]:
    """Target weights that favour small sources: shares of count ** power."""
    return {s: float(n) ** power for s, n in counts.items()}


def _values(spark, rows: list[tuple], schema: str) -> DataFrame:
    """A driver-made table as SQL literals, so that no Python runs for it."""
    fields = [x.strip().rpartition(" ") for x in schema.split(",")]

    def literal(v):
        return "'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'" if isinstance(v, str) else f"{v}L"

    if not rows:
        return spark.sql("SELECT " + ", ".join(f"CAST(NULL AS {t}) AS {n}" for n, _, t in fields) + " WHERE false")
    body = ", ".join("(" + ", ".join(map(literal, r)) + ")" for r in rows)
    return spark.sql(f"SELECT * FROM VALUES {body} AS t({', '.join(n for n, _, _ in fields)})")


def mix(df: DataFrame, weights: dict[str, float] | None = None, block: int = 16, id_col: str = "doc_id", source_col: str = "source", seed: int = 17, power: float = 0.7) -> DataFrame:
    """One row per row of df: doc_id, source, block, slot, place, phase; (slot, place) is the mix's order.

    Each source's rows are shuffled by a seeded hash and cut into blocks of `block` rows. Release
    times and deadlines follow from the target weights (default: counts ** power) and earliest
    deadline first gives each block its slot, so that in every phase a source is less than one
    block from its target after any slot. No row is dropped or repeated: where a source ends, the
    others share its slots by their weights. A null source is a source of its own (shown as null); sources
    missing from `weights` get the smallest given weight. Null ids and repeated rows are mixed like
    any row; ties in the hash go by id. An empty table gives no rows. Only ids and sources are
    shuffled, and a source's rows are numbered through range partitions, so one source may hold
    any share of the rows. The driver sees one count per source and makes a table of up to SLOTS slots for
    each phase, so this is for mixes of up to some hundred sources, as data mixes have."""
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(source_col).cast("string").alias("real"), F.lit(0).alias("tie"))
    out = _scheduled(rows, weights, block, seed, power)
    return out.select(F.col("id").alias("doc_id"), F.col("real").alias("source"), "block", "slot", "place", "phase")


def _scheduled(rows: DataFrame, weights: dict[str, float] | None, block: int, seed: int, power: float) -> DataFrame:
    """The columns of rows (id, real, tie and any others) and block, slot, place, phase."""
    spark = rows.sparkSession
    rows = rows.withColumn("source", F.coalesce(F.concat(F.lit("="), "real"), F.lit("-")))
    counts = {r["source"]: r["n"] for r in rows.groupBy("source").agg(F.count("*").alias("n")).collect()}
    if weights is None:
        target = tempered(counts, power)
    else:
        target = {s: weights.get(s[1:] if s != "-" else None, min(weights.values())) for s in counts}
    whole = whole_weights(target, max(SLOTS, 10 * len(target))) if target else {}
    phases, slots = plan({s: -(-n // block) for s, n in counts.items()}, whole)

    firsts, total = [], 0
    for s in sorted(counts, key=lambda s: s.encode()):
        firsts.append((s, total))
        total += counts[s]
    # rows that share an id, or have none, are told apart by `tie` and their place, so they spread over partitions
    rows = rows.withColumn("key", F.xxhash64("id", F.lit(seed))).withColumn("nth", F.monotonically_increasing_id())
    ranked = global_rank(rows, [F.col("source"), F.col("key"), F.col("id"), F.col("tie"), F.col("nth")], "mix-order").drop("nth")
    # bounded by the number of sources, its square, and that times SLOTS
    first = F.broadcast(_values(spark, firsts, "source string, first bigint"))
    spans = F.broadcast(_values(spark, phases, "source string, phase bigint, from_block bigint, to_block bigint, w bigint, period bigint, slot0 bigint"))
    table = F.broadcast(_values(spark, slots, "phase bigint, source string, turn bigint, within bigint"))
    out = ranked.join(first, "source").withColumn("block", F.floor((F.col("rank") - F.col("first")) / block)).withColumn("place", (F.col("rank") - F.col("first")) % block)
    out = out.join(spans, (out["source"] == spans["source"]) & (out["block"] >= spans["from_block"]) & (out["block"] < spans["to_block"])).drop(spans["source"])
    out = out.withColumn("nth", F.col("block") - F.col("from_block")).withColumn("turn", F.col("nth") % F.col("w"))
    out = out.join(table, ["phase", "source", "turn"])
    return out.withColumn("slot", F.col("slot0") + F.floor(F.col("nth") / F.col("w")) * F.col("period") + F.col("within"))


def mixed_rows(df: DataFrame, id_col: str = "doc_id", source_col: str = "source", weights: dict[str, float] | None = None, block: int = 16, seed: int = 17, power: float = 0.7) -> DataFrame:
    """The rows of df, all columns, stored in the order of their mix: partitions follow each other by slot.

    Every row has a place of its own, also those that repeat an id or have none. Columns may have any names."""
    own = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    tie = F.xxhash64(*[F.col(f"`{c}`") for c, t in df.dtypes if "map<" not in t])
    rows = df.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{source_col}`").cast("string").alias("real"), tie.alias("tie"), own.alias("row"))
    out = _scheduled(rows, weights, block, seed, power).select("slot", "place", "row")
    out = out.repartitionByRange(partitions(df.sparkSession), "slot", "place").sortWithinPartitions("slot", "place")
    return out.select("row.*")


def op4_mix_sources(spark, sf_dir):
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))
