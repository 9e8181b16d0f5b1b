"""Column functions over numbers and vectors: products, hashes, hashed embeddings, cell values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioforge.functions.text import NUMBER

#: Fixed values of the 32-bit FNV-1a hash.
FNV_OFFSET, FNV_PRIME = 2166136261, 16777619
DIMENSIONS = 256


def dot(a: Column, b: Column) -> Column:
    """Inner product in double precision; 0 for vectors of different dimensions."""
    product = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda total, x: total + x)
    return F.when(F.size(a) == F.size(b), product).otherwise(F.lit(0.0))


def fnv1a(text: Column) -> Column:
    """32-bit FNV-1a over the UTF-16 units of a text."""
    points = F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.ascii(c).cast("long"))
    high, low = (lambda p: F.floor((p - 0x10000) / 1024) + 0xD800), (lambda p: (p - 0x10000) % 1024 + 0xDC00)
    units = F.flatten(F.transform(points, lambda p: F.when(p > 0xFFFF, F.array(high(p), low(p))).otherwise(F.array(p))))
    return F.aggregate(units, F.lit(FNV_OFFSET).cast("long"), lambda h, c: h.bitwiseXOR(c) * FNV_PRIME % (1 << 32))


def stable_id(kind: Column, *parts: Column) -> Column:
    """kind-hash, the hash in base 36, over the parts with blanks squeezed."""
    joined = F.concat_ws("|", *[F.regexp_replace(p, r"\s+", " ") for p in parts])
    return F.concat(kind, F.lit("-"), F.lower(F.conv(fnv1a(joined).cast("string"), 10, 36)))


def hashed_embeddings(rows: DataFrame, key: str, tokens: str) -> DataFrame:
    """key, bucket, weight: a sparse unit vector of DIMENSIONS for each row that has tokens.

    A token's hash names its bucket, the parity of another hash its sign. Only tokens are shuffled, once, by key.
    """
    counts = rows.select(key, F.explode(tokens).alias("token")).groupBy(key, "token").agg(F.count("*").alias("n"))
    sign = F.when(fnv1a(F.concat("token", F.lit("#"))) % 2 == 0, 1).otherwise(-1)
    buckets = counts.groupBy(key, (fnv1a(F.col("token")) % DIMENSIONS).alias("bucket")).agg(F.sum(F.col("n") * sign).cast("double").alias("value"))
    norms = buckets.groupBy(key).agg(F.sqrt(F.sum(F.col("value") * F.col("value"))).alias("norm"))
    return buckets.join(norms, key).where("norm > 0 and value <> 0").select(key, "bucket", (F.col("value") / F.col("norm")).alias("weight"))


def cell_value(raw: Column, header: Column | None = None) -> Column:
    """kind, min, max, value and unit of a table cell.

    Blank cells and dashes are absent; two numbers with a range sign are a range (the second keeps its sign); a
    comparator bounds one side; the unit comes from the cell, else from the header.
    """
    text = F.trim(raw)
    numbers = F.transform(F.regexp_extract_all(text, F.lit(NUMBER), F.lit(0)), lambda x: x.cast("double"))
    first, second = F.try_element_at(numbers, F.lit(1)), F.try_element_at(numbers, F.lit(2))
    unit = F.nullif(F.regexp_extract(text, r"[0-9]\s*(%|[a-zA-Z]+|平方米|公顷|米|人|万人)\s*$", 1), F.lit(""))
    if header is not None:
        unit = F.coalesce(unit, F.nullif(F.regexp_extract(header, r"[(（]([^()（）]+)[)）]\s*$", 1), F.lit("")))
    kind = (
        F.when(text.isNull() | text.isin("", "-", "—", "/"), "absent")
        .when((F.size(numbers) >= 2) & text.rlike("[-~～—至]"), "range")
        .when((F.size(numbers) >= 1) & text.rlike("≥|>=|不小于|不低于|以上"), "at_least")
        .when((F.size(numbers) >= 1) & text.rlike("≤|<=|不大于|不超过|以下"), "at_most")
        .when(F.size(numbers) >= 1, "number")
        .otherwise("text")
    )
    return F.struct(
        kind.alias("kind"),
        F.when(kind.isin("range", "at_least"), first).alias("min"),
        F.when(kind == "range", second).when(kind == "at_most", first).alias("max"),
        F.when(kind == "number", first).alias("value"),
        unit.alias("unit"),
    )


#: What a version's status is worth.
STATUS_WORTH = {"current": 1.0, "reference": 0.7, "unknown": 0.55, "possibly_superseded": 0.35, "internal": 0.45, "draft": 0.35, "superseded": 0.05}


def recency(status: Column, date: Column) -> Column:
    """Version priority: the status, and up to 0.2 for a later date, 1 at most; 0.35 without version information."""
    base = F.lit(0.55)
    for name, worth in STATUS_WORTH.items():
        base = F.when(status == name, worth).otherwise(base)
    bonus = F.least(F.greatest(F.datediff(date, F.lit("2000-01-01").cast("date")) / 36500, F.lit(0.0)), F.lit(0.2))
    return F.when(status.isNull() & date.isNull(), 0.35).otherwise(F.least(base + F.coalesce(bonus, F.lit(0.0)), F.lit(1.0)))
