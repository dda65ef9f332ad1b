"""Exact deduplication with static binary-fuse filters.

An immutable snapshot is written once: its distinct digests in *buckets* (by a hash of the digest; a folder, or
shelf, holds ``SHELF`` of them) and one static 3-wise binary-fuse filter of 8-bit fingerprints for each bucket. It is opened again by its path for any
number of batches. An incoming batch is first grouped within itself, so that its own duplicates cost one probe; the
distinct digests are then screened by the filters. A negative is certainly new. A positive (true, or one of the
1/256 false ones) joins the exact buckets: shelves without a positive are not read for that, buckets without one not
shuffled. Texts behind
equal digests are compared byte by byte with the text of the row that stays.

Scale: mostly digests are shuffled (a third of all rows may share one: groups are pre-aggregated, and joins of rows
with large groups use salted keys); the number of buckets follows the number of digests, so a filter stays below a
few hundred KB; texts are compared only for rows that share a digest with another row.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm.common import U64, discard, discard_path, free_names, mix, scratch, stored

#: Distinct digests that one filter holds on average.
BUCKET_KEYS = 1 << 17
#: Buckets of a folder, and of those that a task writes together; buckets (a number each) whose list is broadcast.
SHELF, TOGETHER, HIT_BUCKETS = 64, 8, 1_000_000
#: ASCII white space that normalisation folds.
WHITE = r"[\x20\x09-\x0D]+"


def normalised(text: Column) -> Column:
    """Each run of ASCII white space as one space; null is empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), WHITE, " ")


def fuse_build(keys: np.ndarray) -> tuple[int, int, np.ndarray]:
    """(seed, segment length, fingerprints) of a 3-wise binary-fuse filter over distinct uint64 keys."""
    n = len(keys)
    seg = 1 << max(2, min(18, int(math.log(max(n, 2)) / math.log(3.33) + 2.25)))
    slots = int(n * max(1.125, 0.875 + 0.25 * math.log(1e6) / math.log(max(n, 2)))) + 3
    size = (max(1, math.ceil(slots / seg) - 2) + 2) * seg
    for seed in range(1, 200):
        where, print_ = _slots(keys, seed, seg, size)
        order, slot = _peel(where, size)
        if len(order) == n:
            table = np.zeros(size, np.uint8)
            for lo, hi in _levels(order):
                k, s = order[lo:hi], slot[lo:hi]
                table[s] = print_[k] ^ table[where[k, 0]] ^ table[where[k, 1]] ^ table[where[k, 2]] ^ table[s]
            return seed, seg, table
        if seed % 10 == 0:
            size += seg
    raise ValueError("keys are not distinct")


def _slots(keys: np.ndarray, seed: int, seg: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The three slots, in consecutive segments, and the fingerprint of each key."""
    h = mix(keys ^ mix(np.full(1, seed, U64)))
    starts = size // seg - 2
    first = ((h >> U64(32)) * U64(starts)) >> U64(32)
    where = np.empty((len(keys), 3), np.int64)
    for j, shift in enumerate((0, 18, 36)):
        where[:, j] = (first + U64(j)).astype(np.int64) * seg + ((mix(h + U64(shift + 1))) & U64(seg - 1)).astype(np.int64)
    return where, (mix(h + U64(99)) & U64(255)).astype(np.uint8)


class _Levels(np.ndarray):
    """Peeled keys, with the bounds of the rounds in ``bounds``."""


def _peel(where: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys in order of assignment (last peeled first) and the slot that each owns; shorter than the keys on failure."""
    n = len(where)
    count = np.bincount(where.ravel(), minlength=size)
    ids = np.zeros(size, np.int64)
    np.bitwise_xor.at(ids, where.ravel(), np.repeat(np.arange(n), 3))
    rounds: list[tuple[np.ndarray, np.ndarray]] = []
    single = np.flatnonzero(count == 1)
    while len(single):
        key, pick = np.unique(ids[single], return_index=True)
        slot = single[pick]
        rounds.append((key, slot))
        touched = where[key].ravel()
        np.subtract.at(count, touched, 1)
        np.bitwise_xor.at(ids, touched, np.repeat(key, 3))
        touched = np.unique(touched)
        single = touched[count[touched] == 1]
    rounds.reverse()
    order = np.concatenate([k for k, _ in rounds] or [np.zeros(0, np.int64)]).view(_Levels)
    order.bounds = np.cumsum([0, *(len(k) for k, _ in rounds)])
    return order, np.concatenate([s for _, s in rounds] or [np.zeros(0, np.int64)])


def _levels(order: np.ndarray):
    return zip(order.bounds[:-1], order.bounds[1:])


def fuse_contains(keys: np.ndarray, seed: int, seg: int, table: np.ndarray) -> np.ndarray:
    """Whether each key may be in the filter; never False for a key that is."""
    where, print_ = _slots(keys, seed, seg, len(table))
    return (table[where[:, 0]] ^ table[where[:, 1]] ^ table[where[:, 2]]) == print_


def _key(digest: pd.Series) -> np.ndarray:
    """The first eight bytes of each digest."""
    return np.frombuffer(b"".join(x[:8] for x in digest), ">u8").astype(U64)


def snapshot_filters(groups: DataFrame, buckets: int) -> DataFrame:
    """One filter row (bucket, seed, seg, prints) for each bucket of a snapshot's distinct digests."""

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        seed, seg, prints = fuse_build(np.unique(_key(pdf["digest"])))
        return pd.DataFrame({"bucket": [int(pdf["bucket"].iloc[0])], "seed": [seed], "seg": [seg], "prints": [prints.tobytes()]})

    return bucketed(groups, buckets).select("bucket", "digest").groupBy("bucket").applyInPandas(build, "bucket int, seed int, seg int, prints binary")


def bucketed(groups: DataFrame, buckets: int) -> DataFrame:
    return groups.withColumn("bucket", F.pmod(F.xxhash64("digest"), F.lit(buckets)).cast("int"))


def _shelf(bucket: str = "bucket") -> Column:
    """The folder of a bucket."""
    return F.floor(F.col(bucket) / SHELF).cast("int")


def screen(incoming: DataFrame, filters: DataFrame, buckets: int) -> DataFrame:
    """``incoming`` distinct digests with ``maybe``: False only if the snapshot surely lacks the digest."""
    schema = incoming.schema
    cols = schema.names

    def probe(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        left = left[cols].copy()
        if len(right):
            r = right.iloc[0]
            left["maybe"] = fuse_contains(_key(left["digest"]), int(r["seed"]), int(r["seg"]), np.frombuffer(r["prints"], np.uint8))
        else:
            left["maybe"] = False
        return left

    out = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in schema.fields), "maybe boolean"])
    return bucketed(incoming, buckets).groupBy("bucket").cogroup(filters.groupBy("bucket")).applyInPandas(probe, out)


def digest_groups(digests: DataFrame) -> DataFrame:
    """Rows of one batch with equal digests as one row: (digest, first_id, size)."""
    return digests.groupBy("digest").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("size"))


@dataclass(frozen=True)
class Snapshot:
    """Digest groups that no longer change: files of exact buckets and of filters under ``path``."""

    path: str
    buckets: int
    groups: DataFrame
    filters: DataFrame

    @staticmethod
    def write(groups: DataFrame, path: str, bucket_keys: int = BUCKET_KEYS) -> Snapshot:
        """Keep :func:`digest_groups` as a snapshot under a new ``path``."""
        groups = stored(groups)
        buckets = max(1, math.ceil(groups.count() / bucket_keys))
        placed = bucketed(groups, buckets).withColumn("shelf", _shelf())
        placed.repartition(F.floor(F.col("bucket") / TOGETHER)).sortWithinPartitions("shelf", "bucket").write.partitionBy("shelf").parquet(f"{path}/groups")
        snapshot_filters(groups, buckets).write.parquet(f"{path}/filters")
        groups.sparkSession.createDataFrame([(buckets, groups.schema["first_id"].dataType.simpleString())], "buckets int, kind string").write.parquet(f"{path}/about")
        discard(groups)
        return Snapshot.open(groups.sparkSession, path)

    @staticmethod
    def open(spark: SparkSession, path: str) -> Snapshot:
        about = spark.read.parquet(f"{path}/about").first()
        groups = spark.read.schema(f"digest binary, first_id {about['kind']}, size long, bucket int, shelf int").parquet(f"{path}/groups")
        return Snapshot(path, about["buckets"], groups, spark.read.schema("bucket int, seed int, seg int, prints binary").parquet(f"{path}/filters"))

    def merged(self, incoming: DataFrame) -> DataFrame:
        """Digest groups of the snapshot and a batch together (``incoming``: :func:`digest_groups` of the batch).

        Only positives meet the exact buckets; what lies in buckets without a positive passes through without a
        shuffle. The buckets with positives (one row each) stay a table and join the snapshot by shelf and bucket."""
        screened = stored(screen(incoming, self.filters, self.buckets))
        new = screened.filter(~F.col("maybe")).select("digest", "first_id", "size")
        maybe = bucketed(screened.filter("maybe"), self.buckets).select("bucket", "digest", F.col("first_id").alias("in_id"), F.col("size").alias("in_size"))
        hit = maybe.select("bucket").distinct().withColumn("shelf", _shelf())
        if self.buckets <= HIT_BUCKETS:
            hit = F.broadcast(hit)
        on = ["shelf", "bucket"]
        rest = self.groups.join(hit, on, "left_anti")
        known = self.groups.join(hit, on, "left_semi").join(maybe, ["bucket", "digest"], "full").select(
            "digest", F.least("first_id", "in_id").alias("first_id"), (F.coalesce("size", F.lit(0)) + F.coalesce("in_size", F.lit(0))).alias("size")
        )
        return rest.select("digest", "first_id", "size").unionByName(known).unionByName(new)


#: Parts into which the rows of a large group are dealt where they meet their group, rows from which on it is large,
#: and large groups that are known to all tasks (40 bytes each; others are joined unsalted).
SALTS, LARGE, HOT_GROUPS = 64, 1000, 100_000


def _with_groups(rows: DataFrame, groups: DataFrame, how: str) -> DataFrame:
    """``rows`` (digest, …) joined with one row of ``groups`` (digest, n, …); rows of large groups are dealt into
    ``SALTS`` parts, so that no task takes a whole one."""
    large = F.col("n") >= LARGE
    many = groups.filter(large).withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    hot = F.broadcast(groups.filter(large).select("digest", F.lit(True).alias("_hot")).orderBy("digest").limit(HOT_GROUPS))
    salt = F.when(F.col("_hot"), F.pmod(F.xxhash64("_row"), F.lit(SALTS))).otherwise(-1).cast("int")
    return rows.join(hot, "digest", "left").withColumn("_salt", salt).drop("_hot").join(many.unionByName(groups.withColumn("_salt", F.lit(-1))), ["digest", "_salt"], how).drop("_salt")


def exact_groups(docs: DataFrame, snapshot_share: int = 2) -> DataFrame:
    """Exact groups of ``docs`` (doc_id, text): doc_id, keep_id, group_size, kept, text_sha256, one row per input row.

    The rows with ``pmod(xxhash64(doc_id), snapshot_share) = 0`` form the immutable snapshot, the others the
    incoming batch. Null text is empty text; a null doc_id sorts after all others and is kept only if its group
    has no other id; rows repeated with the same doc_id and text count each in ``group_size`` and are all kept or
    all dropped together. Very long texts are texts like others; other columns are ignored. An empty table gives an
    empty result.
    """
    norm = normalised(F.col("text"))
    digests = stored(
        docs.select("doc_id", norm.alias("_n")).select(
            "doc_id",
            F.unhex(F.sha2("_n", 256)).alias("digest"),
            (F.coalesce(F.pmod(F.xxhash64("doc_id"), F.lit(snapshot_share)), F.lit(0)) == 0).alias("old"),
            F.monotonically_increasing_id().alias("_row"),
        )
    )
    snapshot = Snapshot.write(digest_groups(digests.filter("old")), scratch(docs.sparkSession))
    groups = stored(snapshot.merged(digest_groups(digests.filter("not old"))))
    discard_path(docs.sparkSession, snapshot.path)
    shared = groups.filter("size > 1").select("digest", "first_id", F.col("size").alias("n"))
    named = stored(_with_groups(digests.drop("old"), shared, "left"))
    discard(digests, groups)
    members, checked = _byte_check(docs, named.filter("n is not null"))
    bad = checked.filter("not same")
    keep_id = F.when(F.col("n").isNull(), F.col("doc_id")).otherwise(F.col("first_id"))
    out = named.select("doc_id", keep_id.alias("keep_id"), F.coalesce("n", F.lit(1)).cast("long").alias("group_size"), F.lower(F.hex("digest")).alias("text_sha256"))
    if bad.head(1):
        out = _split_collisions(docs, out, bad)
    else:
        discard(members)
    kept = F.coalesce(F.col("doc_id") == F.col("keep_id"), F.col("keep_id").isNull())
    return out.select("doc_id", "keep_id", "group_size", kept.alias("kept"), "text_sha256")


def _byte_check(docs: DataFrame, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The texts of ``rows`` (doc_id, digest, first_id, n, _row), and (doc_id, digest, same): whether their normalised
    bytes equal those of ``first_id``'s row."""
    text = docs.select("doc_id", normalised(F.col("text")).alias("norm")).withColumn("digest", F.unhex(F.sha2("norm", 256)))
    rows = rows.groupBy(F.col("doc_id").alias("_id"), F.col("digest").alias("_digest"), "first_id", "n").agg(F.min("_row").alias("_row"))
    members = stored(text.join(rows, text["doc_id"].eqNullSafe(rows["_id"]) & (text["digest"] == rows["_digest"])).select("doc_id", "digest", "norm", "first_id", "n", "_row"))
    first = members.filter("doc_id <=> first_id").groupBy("digest").agg(F.min("norm").alias("first_norm"), F.max("n").alias("n"))
    both = _with_groups(members.drop("n"), first, "inner")
    return members, both.select("doc_id", "digest", (F.col("norm") == F.col("first_norm")).alias("same"))


def _split_collisions(docs: DataFrame, out: DataFrame, bad: DataFrame) -> DataFrame:
    """Regroup by the text itself where different texts share a digest."""
    digests = bad.select(F.lower(F.hex("digest")).alias("text_sha256")).distinct()
    text = docs.select("doc_id", normalised(F.col("text")).alias("norm")).withColumn("text_sha256", F.sha2("norm", 256)).join(digests, "text_sha256")
    groups = text.groupBy("text_sha256", "norm").agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    again = text.join(groups, ["text_sha256", "norm"]).select("doc_id", "keep_id", "group_size", "text_sha256")
    return out.join(digests, "text_sha256", "left_anti").select("doc_id", "keep_id", "group_size", "text_sha256").unionByName(again)


def keep_first(docs: DataFrame) -> DataFrame:
    """One row of ``docs`` for each distinct normalised text: the one with the smallest doc_id; all columns stay.

    Null text is empty text; a null doc_id stays only where its text has no other; of rows repeated with the same
    doc_id and text one stays. Very long texts are texts like others, an empty table gives an empty result, and other
    columns stay, whatever their names.
    """
    id_, sha, sha_ = free_names(docs, "_id", "_sha", "_sha_of")
    groups = stored(exact_groups(docs.select("doc_id", "text")))
    drop = groups.filter("not kept").select("doc_id", "text_sha256")
    twice = groups.filter("kept").groupBy("doc_id", "text_sha256").count().filter("count > 1").drop("count")
    cols = docs.columns
    marked = docs.withColumn(sha, F.sha2(normalised(F.col("text")), 256))
    rename = lambda df: df.select(F.col("doc_id").alias(id_), F.col("text_sha256").alias(sha_))
    on = lambda other: marked["doc_id"].eqNullSafe(other[id_]) & (marked[sha] == other[sha_])
    gone, again = rename(drop.unionByName(twice)), rename(twice)
    out = marked.join(gone, on(gone), "left_anti").select(*cols)
    if twice.head(1):
        pick = marked.join(again, on(again), "left_semi")
        out = out.unionByName(pick.dropDuplicates(["doc_id", sha]).select(*cols))
    return out
