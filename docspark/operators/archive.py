"""Archive safety: bombs and unsafe entry names, from entry metadata alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

MAX_ENTRIES = 10_000
MAX_RATIO = 100.0
MAX_BYTES = 500 * 1024 * 1024


def inside(name: str) -> bool:
    """Whether a name stays in its folder at every point: the same rule as ``unsafe_name``."""
    depth = 0
    for part in name.split("/"):
        depth += -1 if part == ".." else 0 if part in ("", ".") else 1
        if depth < 0:
            return False
    return "\\" not in name and not name.startswith("/")


def wrong(entries: list[tuple[str, int, int]], max_entries: int = MAX_ENTRIES, max_ratio: float = MAX_RATIO, max_bytes: int = MAX_BYTES) -> str | None:
    """The verdict of ``check`` on one directory of ``(name, file_size, compress_size)``, in words; None if it is fit to unpack."""
    if len(entries) > max_entries:
        return f"too many entries: {len(entries)}"
    bomb = next((name for name, size, packed in entries if packed > 0 and size / packed > max_ratio), None)
    if bomb is not None:
        return f"compression ratio: {bomb}"
    if sum(size for _, size, _ in entries) > max_bytes:
        return "too large unpacked"
    odd = next((name for name, *_ in entries if not inside(name)), None)
    return f"unsafe name: {odd}" if odd is not None else None


def unsafe_name(name: Column) -> Column:
    """Backslash, absolute, or a path that climbs out of its folder at any point."""
    walk = F.aggregate(
        F.split(name, "/"),
        F.struct(F.lit(0).alias("depth"), F.lit(0).alias("least")),
        lambda a, p: F.struct(
            (a["depth"] + F.when(p == "..", -1).when(p.isin("", "."), 0).otherwise(1)).alias("depth"),
            F.least(a["least"], a["depth"] + F.when(p == "..", -1).when(p.isin("", "."), 0).otherwise(1)).alias("least"),
        ),
        lambda a: a["least"],
    )
    return F.contains(name, F.lit("\\")) | F.startswith(name, F.lit("/")) | (walk < 0)


def check(entries: DataFrame, max_entries: int = MAX_ENTRIES, max_ratio: float = MAX_RATIO, max_bytes: int = MAX_BYTES) -> DataFrame:
    """``(path, n_entries, total_size, verdict, offender)``: count comes before ratio, total and names."""
    ratio = (F.col("compress_size") > 0) & (F.col("file_size") / F.col("compress_size") > max_ratio)
    first = lambda when: F.min_by("name", F.when(when, F.col("entry_index")))
    found = entries.groupBy("path").agg(
        F.count("*").alias("n_entries"), F.sum("file_size").alias("total_size"), first(ratio).alias("bomb"), F.max(ratio.cast("int")).alias("bombs"),
        first(unsafe_name(F.col("name"))).alias("odd"), F.max(unsafe_name(F.col("name")).cast("int")).alias("odds"),
    )
    verdict = F.when(F.col("n_entries") > max_entries, "entries").when(F.col("bombs") == 1, "ratio").when(F.col("total_size") > max_bytes, "total").when(F.col("odds") == 1, "name").otherwise("ok")
    return found.select("path", "n_entries", "total_size", verdict.alias("verdict"), F.when(verdict == "ratio", F.col("bomb")).when(verdict == "name", F.col("odd")).alias("offender"))
