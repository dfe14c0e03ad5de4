"""Document fingerprints: one-permutation MinHash with optimal densification and packed low-order bits."""

from __future__ import annotations

from math import ceil, isqrt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, text_or_empty

#: Words of a shingle, bins, and low-order bits kept of each bin's least hash.
WORDS, BINS, BITS = 5, 256, 4
#: Probes of an empty bin before its donor is chosen by least priority over all filled bins.
PROBES = 8
_REST = (1 << 56) - 1  # a hash without its bin, which is its highest byte
#: Documents of a range of ids, which one window sorts; more only where there are over MOST_RANGES ranges.
RANGE, MOST_RANGES = 2048, 250_000


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _empty(x: Column) -> Column:
    return x.bitwiseAND(F.lit(_REST)) == F.lit(_REST)


def _bin(x: Column) -> Column:
    return F.shiftrightunsigned(x, 56)


def with_fingerprint(df: DataFrame, text: str, out: str) -> DataFrame:
    """Add the fingerprint of the column `text` as `out`: BINS digits of BITS bits, in hexadecimal.

    Each word shingle is hashed once; the hash's highest byte is its bin and the least hash of a bin
    stands for it. One marker per bin, greater than any hash of the bin, is sorted in with the
    hashes, so the first entry of each bin is its least hash, or the marker if the bin is empty. An
    empty bin takes the value of the first filled bin among its own random probes (Shrivastava's
    optimal densification). A text of fewer words than a shingle is one shingle; a text without words
    has an empty fingerprint.

    Each stage is a projection of its own: a column that a lambda refers to more than once is not
    inlined, so arrays are not computed anew for each element."""
    w, s, f = f"_{out}_words", f"_{out}_sorted", f"_{out}_firsts"
    kept = df.columns
    words = F.array_remove(F.split(F.col(text), r"[\x20\x09-\x0D]+"), "")
    df = df.withColumn(w, F.transform(words, lambda x: F.xxhash64(x)))
    hashed = F.col(w)
    shingles = F.transform(F.slice(hashed, F.lit(1), F.greatest(F.size(hashed) - (WORDS - 1), F.lit(0))), lambda x, i: F.xxhash64(x, *[F.get(hashed, i + k) for k in range(1, WORDS)]))
    hashes = F.when(F.size(hashed) >= WORDS, shingles).when(F.size(hashed) > 0, F.array(F.xxhash64(hashed)))
    markers = F.array(*[F.lit(_signed(b << 56 | _REST)) for b in range(BINS)])
    df = df.withColumn(s, F.sort_array(F.concat(hashes, markers)))
    ordered = F.col(s)
    df = df.withColumn(f, F.filter(ordered, lambda x, i: (i == 0) | (_bin(x) != _bin(F.get(ordered, i - 1)))))
    firsts = F.col(f)

    def dense(x: Column, i: Column) -> Column:
        probes = [F.get(firsts, F.pmod(F.xxhash64(i, F.lit(a)), F.lit(BINS)).cast("int")) for a in range(PROBES)]
        filled = F.filter(firsts, lambda y: ~_empty(y))
        least = F.array_min(F.transform(filled, lambda y: F.struct(F.xxhash64(i, F.lit(-1), _bin(y)).alias("priority"), y.alias("value"))))["value"]
        return F.when(~_empty(x), x).otherwise(F.coalesce(*[F.when(~_empty(p), p) for p in probes], least))

    digits = F.transform(F.transform(firsts, dense), lambda x: F.hex(x.bitwiseAND(F.lit((1 << BITS) - 1))))
    return df.select(*kept, F.coalesce(F.lower(F.array_join(digits, "")), F.lit("")).alias(out))


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard similarity of two fingerprints, 0 to 1.

    Digits agree by chance once in 2**BITS, which is taken off. Two empty fingerprints are alike (1);
    an empty one is unlike any other (0)."""
    same = F.size(F.filter(F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: (x == y) & (x != "")), lambda x: x))
    chance = 1 / 2**BITS
    corrected = (same / F.lit(float(BINS)) - chance) / (1 - chance)
    return F.when((a == "") | (b == ""), F.when(a == b, 1.0).otherwise(0.0)).otherwise(F.least(F.greatest(corrected, F.lit(0.0)), F.lit(1.0)))


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and fingerprint of each row, without a shuffle. Null texts count as empty, null ids stay null;
    rows that repeat come out as often; other columns are ignored; an empty table gives no rows."""
    return with_fingerprint(df.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text")), "text", "fingerprint").drop("text")


def with_next(df: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, Window]:
    """Rows (key, text, range, extra) in falling order of id, cut into ranges; and the window that orders a range.

    A key is (not null, id, hash of the text), so rows that share an id, or have none, spread over ranges too; rows that repeat both
    stay together. Sampled range partitions of the keys alone give the ranges; the greatest key of each is its head. A head's row also goes
    to the end of the range before (the very first to the last range) as an `extra` row, so that
    within a range every row's successor is at hand. Null ids come last.

    A row's range is found in two levels: the plan holds the first head of each group of ranges, and a broadcast
    table the heads in each group: three numbers a range."""
    fields = "struct<some:boolean,id:bigint,tie:bigint>"
    key = F.struct(F.col(id_col).isNotNull().alias("some"), F.coalesce(F.col(id_col).cast("long"), F.lit(0)).alias("id"), F.xxhash64(text_or_empty(text_col)).alias("tie")).cast(fields)
    rows = df.select(key.alias("key"), text_or_empty(text_col).alias("text"))
    n = rows.count()
    ranges = max(1, min(MOST_RANGES, ceil(n / RANGE)))
    heads = rows.select("key").repartitionByRange(ranges, F.desc("key")).groupBy(F.spark_partition_id().alias("part")).agg(F.max("key").alias("head"))
    heads = materialise(heads.withColumn("range", F.row_number().over(Window.orderBy(F.desc("head"))) - 1), "range-heads")
    found = heads.count()
    step = isqrt(max(found, 1)) + 1
    groups = heads.groupBy(F.floor(F.col("range") / step).cast("int").alias("group")).agg(F.sort_array(F.collect_list("head"), asc=False).alias("heads"))
    tops = [r["top"] for r in groups.orderBy("group").select(F.col("heads")[0].alias("top")).collect()]
    coarse = F.array(*[F.struct(F.lit(t["some"]).alias("some"), F.lit(t["id"]).cast("long").alias("id"), F.lit(t["tie"]).cast("long").alias("tie")).cast(fields) for t in tops]).cast(f"array<{fields}>")
    rows = rows.withColumn("group", F.size(F.filter(coarse, lambda h: h >= F.col("key"))) - 1).join(F.broadcast(groups), "group")
    at = F.col("group") * step + F.size(F.filter("heads", lambda h: h >= F.col("key"))) - 1
    rows = rows.select("key", "text", at.alias("at"), F.array_contains("heads", F.col("key")).alias("head"))
    before = F.pmod(F.col("at") - 1, F.lit(max(found, 1)))
    none = F.struct(F.col("at").alias("range"), F.lit(False).alias("extra"))
    places = F.when(F.col("head"), F.array(none, F.struct(before.alias("range"), F.lit(True).alias("extra")))).otherwise(F.array(none))
    rows = rows.select("key", "text", F.explode(places).alias("place")).select("key", "text", "place.range", "place.extra")
    return rows, Window.partitionBy("range").orderBy("extra", F.desc("key"))


def op3_fingerprints(spark, sf_dir):
    rows, order = with_next(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id", "text")
    half = F.floor(F.length("text") / 2).cast("int")
    rows = rows.withColumn("next_text", F.coalesce(F.lead("text").over(order), F.lit("")))
    edited = F.concat(F.substr("text", F.lit(1), F.length("text") - half), F.substr("next_text", F.lit(1), half))
    rows = rows.select("range", "extra", "key", "text", edited.alias("edited"))
    rows = with_fingerprint(with_fingerprint(rows, "text", "fingerprint"), "edited", "edited_fingerprint")
    rows = rows.select("range", "extra", "key", F.length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint")
    rows = rows.withColumn("next_fingerprint", F.lead("fingerprint").over(order)).filter(~F.col("extra"))
    return rows.select(
        F.when(F.col("key.some"), F.col("key.id")).alias("doc_id"),
        "n_chars",
        "edited_sha256",
        "fingerprint",
        "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"),
    )
