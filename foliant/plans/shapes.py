"""Plan shapes that the optimizer does not find by itself."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def hash_uniform(*cols: Column, seed: int = 0) -> Column:
    """A number in (0, 1) from a SHA-256 of the values: the same in every engine and at every partitioning."""
    digest = F.sha2(F.concat_ws("|", F.lit(str(seed)), *[c.cast("string") for c in cols]), 256)
    return (F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") + 1.0) / float(2**48 + 1)


def islands(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Runs of consecutive whole numbers: keys, first, last and size. Repeated values count once; nulls are left out."""
    w = Window.partitionBy(*keys).orderBy(value)
    runs = df.select(*keys, value).where(F.col(value).isNotNull()).distinct().withColumn("__run", F.col(value) - F.row_number().over(w))
    return runs.groupBy(*keys, "__run").agg(F.min(value).alias("first"), F.max(value).alias("last"), F.count("*").alias("size")).drop("__run")


def merged_ranges(df: DataFrame, keys: list[str], first: str, last: str) -> DataFrame:
    """Overlapping or adjacent ranges of whole numbers made one: keys, first and last."""
    w = Window.partitionBy(*keys).orderBy(first, last)
    before = F.max(last).over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = df.select(*keys, first, last).where(F.col(first) <= F.col(last)).withColumn("__new", F.coalesce((F.col(first) > before + 1).cast("int"), F.lit(1)))
    grouped = marked.withColumn("__group", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return grouped.groupBy(*keys, "__group").agg(F.min(first).alias("first"), F.max(last).alias("last")).drop("__group")


def top_k(df: DataFrame, keys: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    """First k rows of every group in a total order."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(rank) <= k)


def split_row_number(df: DataFrame, keys: list[str], bucket: Column, order: list[Column], name: str) -> DataFrame:
    """row_number() over keys in an order whose first part is a bucket number, without bringing the rows of one key into one task.

    bucket must not fall along the order. Rows are numbered within (keys, bucket), and the sizes of a key's buckets, one small row each, give every bucket its
    offset. Rows of a null bucket come first, as nulls do in the order.
    """
    b = df.withColumn("__bucket", F.coalesce(bucket.cast("long"), F.lit(-(1 << 62))))
    sizes = b.groupBy(*keys, "__bucket").agg(F.count("*").alias("__n"))
    before = Window.partitionBy(*keys).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0)))
    offsets = offsets.select("__before", *[F.col(k).alias(f"__of{i}") for i, k in enumerate([*keys, "__bucket"])])
    within = b.withColumn("__within", F.row_number().over(Window.partitionBy(*keys, "__bucket").orderBy(*order)))
    joined = within.join(offsets, [F.col(k).eqNullSafe(F.col(f"__of{i}")) for i, k in enumerate([*keys, "__bucket"])])
    return joined.select(*df.columns, (F.col("__within") + F.col("__before")).cast("int").alias(name))


#: Base of the rolling hash (odd), its inverse modulo 2**64, and the factor that brings all bits of a hash into its highest.
_BASE, _SPREAD = 0xD6E8FEB86659FD93, 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def _rolling_sums(joined: str, powers: list):
    """Sums of a text from which stretch_hashes() takes the hash of any stretch; powers is kept from call to call and grows."""
    import numpy as np

    n = len(joined)
    if not powers or len(powers[0]) < n + 1:
        powers[:] = [np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(max(n, 1 << 18), x, np.uint64)])) for x in (_BASE, _INVERSE)]
    chars = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.concatenate([np.zeros(1, np.uint64), np.cumsum(chars * powers[0][:n])])


def _in_parts(texts: list[str], most: int = 1 << 18):
    """First and last place of runs of texts with about so many characters together."""
    first = held = 0
    for i, text in enumerate(texts):
        held += len(text)
        if held >= most:
            yield first, i + 1
            first, held = i + 1, 0
    if first < len(texts):
        yield first, len(texts)


def hashed_pairs(texts: DataFrame, text_id: str, text_key: str, probes: DataFrame, probe_id: str, probe_key: str, size: int = 12, group: str | None = None) -> DataFrame:
    """contained_pairs() for any number of probes: neither texts nor their stretches are shuffled.

    Of every probe only three numbers go to the tasks: its length, the hash of the whole and that of its first characters, size times the largest power of two that
    fits, and so more than half of it. Rolling hashes find the places of a text where both fit; these stretches, and no others, meet the probes by an
    equi-join on their characters, so that hashes that happen to be equal give no pair.
    """
    import numpy as np
    import pyarrow as pa

    of = [group] if group else []
    mark = F.xxhash64(group) if group else F.lit(0).cast("long")
    p = probes.where(F.char_length(probe_key) >= size)
    t = texts.where(F.char_length(text_key) >= size).select(text_id, text_key, *of, mark.alias("__mark"))
    numbers = T.StructType([T.StructField(n, T.LongType()) for n in ("head", "length", "first", "whole")])

    def number(batches):
        powers: list = []
        for batch in batches:
            keys, marks = batch.column(0).to_pylist(), batch.column(1).to_numpy().view(np.uint64)
            for a, b in _in_parts(keys):
                sums = _rolling_sums("".join(keys[a:b]), powers)
                length = np.array([len(k) for k in keys[a:b]])
                at = np.cumsum(length) - length
                head = size << np.floor(np.log2(length // size)).astype(np.int64)
                first, whole = (((sums[at + n] - sums[at]) * powers[1][at] ^ marks[a:b]) * np.uint64(_SPREAD) for n in (head, length))
                yield pa.RecordBatch.from_arrays([pa.array(head), pa.array(length), pa.array(first.view(np.int64)), pa.array(whole.view(np.int64))], names=numbers.names)

    rows = p.select(probe_key, mark.alias("__mark")).mapInArrow(number, numbers).distinct().toArrow()
    head, length, first, whole = (rows.column(n).to_numpy() for n in numbers.names)
    wanted = {}
    for n in np.unique(head).tolist():
        here = np.flatnonzero(head == n)
        here = here[np.argsort(first[here].view(np.uint64), kind="stable")]
        wanted[n] = first[here].view(np.uint64), length[here], whole[here].view(np.uint64)
    shared = t.sparkSession.sparkContext.broadcast(wanted)
    schema = T.StructType([t.schema[text_id], *[t.schema[c] for c in of], T.StructField("__stretch", T.StringType())])
    kept = [0, *([2] if of else [])]

    def search(batches):
        powers: list = []
        filters = {}
        for n, (firsts, _, _) in shared.value.items():
            bits = min(24, max(10, len(firsts).bit_length() + 5))
            filters[n] = np.uint64(64 - bits), np.zeros(1 << bits, bool)
            filters[n][1][firsts >> filters[n][0]] = True
        for batch in batches:
            keys, marks = batch.column(1).to_pylist(), batch.column(len(kept) + 1).to_numpy().view(np.uint64)
            found: list[tuple[int, str]] = []
            for a, b in _in_parts(keys):
                joined = "".join(keys[a:b])
                sums = _rolling_sums(joined, powers)
                lengths = np.array([len(k) for k in keys[a:b]])
                ends, owner = np.cumsum(lengths), np.repeat(np.arange(b - a), lengths)
                mine = marks[a:b][owner]
                stretches = set()
                for n, (firsts, sizes, wholes) in shared.value.items():
                    if len(joined) < n:
                        continue
                    shift, filled = filters[n]
                    seen = (((sums[n:] - sums[:-n]) * powers[1][: len(joined) - n + 1]) ^ mine[: len(joined) - n + 1]) * np.uint64(_SPREAD)
                    at = np.flatnonzero(filled[seen >> shift])
                    low, high = (np.searchsorted(firsts, seen[at], side) for side in ("left", "right"))
                    for some in np.array_split(np.flatnonzero(high > low), 1 + int((high - low).sum()) // 4_000_000):
                        many = high[some] - low[some]
                        place = np.repeat(at[some], many)
                        which = np.repeat(low[some] - (np.cumsum(many) - many), many) + np.arange(len(place))
                        fits = place + sizes[which] <= ends[owner[place]]
                        place, which = place[fits], which[fits]
                        same = (((sums[place + sizes[which]] - sums[place]) * powers[1][place]) ^ mine[place]) * np.uint64(_SPREAD) == wholes[which]
                        stretches |= {(a + o, joined[i : i + m]) for o, i, m in zip(owner[place[same]].tolist(), place[same].tolist(), sizes[which[same]].tolist())}
                found += stretches
            rows = pa.array([i for i, _ in found], pa.int64())
            yield pa.RecordBatch.from_arrays([*[batch.column(i).take(rows) for i in kept], pa.array([x for _, x in found], pa.string())], names=schema.names)

    found = t.mapInArrow(search, schema)
    named = p.select(probe_id, F.col(probe_key).alias("__probe"), *[F.col(c).alias("__group") for c in of])
    same = F.col("__stretch") == F.col("__probe")
    return found.join(named, same & F.col(group).eqNullSafe(F.col("__group")) if of else same).select(text_id, probe_id, *of)


#: Probes up to which one automaton in every task holds them all.
AUTOMATON_PROBES = 50_000


def contained_pairs(texts: DataFrame, text_id: str, text_key: str, probes: DataFrame, probe_id: str, probe_key: str, size: int = 12, group: str | None = None) -> DataFrame:
    """All pairs in which the text's key holds the probe's key, for probes of at least `size` characters; with a group column only pairs of one group, which is a third column.

    Up to AUTOMATON_PROBES probes, which are counted first, every task runs one Aho-Corasick automaton of them over its texts; more of them are found by rolling
    hashes. Neither way shuffles the texts, and both give the same pairs.
    """
    of = [group] if group else []
    p = probes.where(F.char_length(probe_key) >= size).select(probe_id, probe_key, *of)
    patterns = [tuple(r) for r in p.limit(AUTOMATON_PROBES + 1).collect()]
    t = texts.where(F.char_length(text_key) >= size).select(text_id, text_key, *of)
    if len(patterns) > AUTOMATON_PROBES:
        return hashed_pairs(t, text_id, text_key, p, probe_id, probe_key, size, group)
    shared = t.sparkSession.sparkContext.broadcast(patterns)
    schema = T.StructType([t.schema[text_id], p.schema[probe_id], *[t.schema[c] for c in of]])

    def search(batches):
        import ahocorasick
        import pandas as pd

        ids: dict[str, dict] = {}
        for i, key, *g in shared.value:
            ids.setdefault(key, {}).setdefault(g[0] if g else None, []).append(i)
        automaton = ahocorasick.Automaton()
        for key in ids:
            automaton.add_word(key, key)
        automaton.make_automaton()
        for pdf in batches:
            rows = []
            if ids:
                groups = pdf.iloc[:, 2] if of else [None] * len(pdf)
                for owner, text, g in zip(pdf.iloc[:, 0], pdf.iloc[:, 1], groups):
                    rows += [(owner, i, *([g] if of else [])) for key in {k for _, k in automaton.iter(text)} for i in ids[key].get(g, ())]
            yield pd.DataFrame(rows, columns=[text_id, probe_id, *of])

    return t.mapInPandas(search, schema)


def range_join(points: DataFrame, ranges: DataFrame, keys: list[str], point: str, first: str, last: str) -> DataFrame:
    """Points with the ranges of their key that hold them (both ends included), by an equi-join on buckets of values.

    A range is entered in every bucket it touches, so that no key meets all its ranges in one task.
    """
    width = 16
    spread = ranges.withColumn("__bucket", F.explode(F.sequence(F.floor(F.col(first) / width), F.floor(F.col(last) / width))))
    with_bucket = points.withColumn("__bucket", F.floor(F.col(point) / width))
    joined = with_bucket.join(spread, [*keys, "__bucket"])
    return joined.where((F.col(point) >= F.col(first)) & (F.col(point) <= F.col(last))).drop("__bucket")
