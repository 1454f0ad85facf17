"""Groups of items with nearly the same text: MinHash, banding, signature verification, connected components.

One pass reads the texts and writes each set's band keys and sketch, about a kilobyte an item; shingles are worked out again for
the sets that meet another one in a bucket. In each bucket the members are first compared with the bucket's least set (a star, not all
pairs). A member alike to that needs no comparison with others that are: they are in one group already. Only members
unlike the star's centre are compared with the whole bucket, so no link between groups is lost and a bucket full of copies costs as
many comparisons as it has members.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestack.operators.components import components
from lodestack.runtime import broadcast_if_small, cut

WORDS, LIKE = 3, 0.5
#: At a likeness of 0.5 a pair misses all bands with a chance of (1 - 1/16)^128 = 0.0003; at 0.6, 0.00000002.
BANDS, ROWS = 128, 4
#: Standard deviations of the one-bit estimate that verification allows below the threshold.
SLACK = 5.0
_WORD = re.compile(r"[^\W_]+")
_U, _H = np.uint64, np.uint32
_rng = np.random.default_rng(20_240)
_A = _rng.integers(1, 1 << 32, BANDS * ROWS, dtype=_H) | _H(1)
_B = _rng.integers(0, 1 << 32, BANDS * ROWS, dtype=_H)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


class _Hashes(dict):
    def __missing__(self, word: str) -> int:
        self[word] = out = xxhash.xxh3_64_intdigest(word)
        return out


class _Shingler:
    """Sets of runs of n consecutive words, as sorted 64-bit hashes; remembers word hashes within one batch."""

    def __init__(self, words: int) -> None:
        self.n, self.known = words, _Hashes()

    def __call__(self, text: str) -> np.ndarray:
        words = _WORD.findall(text.lower())
        if len(words) < self.n:
            return np.zeros(0, _U)
        h = np.fromiter(map(self.known.__getitem__, words), _U, len(words))
        out = np.zeros(len(h) - self.n + 1, _U)
        for i in range(self.n):
            out = _mix(out * _U(0x9E3779B97F4A7C15) + h[i : i + len(out)])
        return np.unique(out)


def signature(shingles: np.ndarray) -> np.ndarray:
    """The least value of each universal hash function (a*x + b mod 2^32, x the upper half of a shingle) over the set."""
    x = (shingles >> _U(32)).astype(_H)
    out = np.full(BANDS * ROWS, 0xFFFFFFFF, _H)
    for i in range(0, len(x), 64):  # so much stays in the cache
        np.minimum(out, (x[i : i + 64, None] * _A + _B).min(axis=0), out=out)
    return out


def _lists(x: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32)), pa.array(x.reshape(-1).view(np.int64)))


def _signed(words: int):  # noqa: ANN202
    """Per item its set's number, band keys, and one bit of every minimum as the sketch for verification. Texts without a shingle are left out."""

    def run(batches):  # noqa: ANN001, ANN202
        for batch in batches:
            shingle = _Shingler(words)
            ids, items, signatures = [], [], []
            for i, text in enumerate(batch.column("text").to_pylist()):
                s = shingle(text)
                if len(s):
                    items.append(i)
                    ids.append(xxhash.xxh3_64_intdigest(s.tobytes()))
                    signatures.append(signature(s))
            sig = np.array(signatures, _H).reshape(len(items), BANDS, ROWS).astype(_U)
            keys = np.broadcast_to(np.arange(BANDS, dtype=_U), (len(items), BANDS))
            for row in range(ROWS):
                keys = _mix(keys * _U(0x9E3779B97F4A7C15) + sig[:, :, row])
            bits = (_mix(sig) & _U(1)).astype(np.uint8).reshape(len(items), BANDS * ROWS)
            sketches = np.packbits(bits, axis=1).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("item").take(pa.array(items, pa.int64())), pa.array(np.array(ids, _U).view(np.int64)), _lists(keys), _lists(sketches)], ["item", "set_id", "band_keys", "sketch"])

    return run


def _shingled(words: int):  # noqa: ANN202
    """set_id and shingles of texts."""

    def run(batches):  # noqa: ANN001, ANN202
        for batch in batches:
            shingle = _Shingler(words)
            sets = [s for text in batch.column("text").to_pylist() if len(s := shingle(text))]
            offsets = np.cumsum([0, *map(len, sets)], dtype=np.int32)
            values = np.concatenate(sets) if sets else np.zeros(0, _U)
            yield pa.RecordBatch.from_arrays([pa.array(np.array([xxhash.xxh3_64_intdigest(s.tobytes()) for s in sets], _U).view(np.int64)), pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.view(np.int64)))], ["set_id", "shingles"])

    return run


def _agreeing(a: Column, b: Column) -> Column:
    """Share of equal bits of two sketches."""
    words = BANDS * ROWS // 64
    off = sum((F.bit_count(F.get(a, F.lit(i)).bitwiseXOR(F.get(b, F.lit(i)))) for i in range(1, words)), F.bit_count(F.get(a, F.lit(0)).bitwiseXOR(F.get(b, F.lit(0)))))
    return 1 - off / (BANDS * ROWS)


def _side(df: DataFrame, x: str) -> DataFrame:
    return df.select(F.col("set_id").alias(x), *[F.col(c).alias(f"{x}_{c}") for c in df.columns if c != "set_id"])


def _verified(pairs: DataFrame, signed: DataFrame, texts: DataFrame, words: int, like: float) -> DataFrame:
    """The pairs (a, b) of sets that are alike: by their sketches first, then by the shingles of those that pass. signed: item, set_id, sketch. texts: item, text."""
    floor = (1 + like) / 2 - SLACK * float(np.sqrt((1 + like) * (1 - like) / 4 / (BANDS * ROWS)))
    ends = lambda p: p.select(F.col("a").alias("set_id")).union(p.select("b")).distinct()
    known = signed.join(ends(pairs), "set_id", "left_semi").groupBy("set_id").agg(F.min(F.struct("item", "sketch")).alias("x")).select("set_id", "x.item", "x.sketch")
    sketches = cut(known)
    near = cut(pairs.join(_side(sketches, "a"), "a").join(_side(sketches, "b"), "b").where(_agreeing(F.col("a_sketch"), F.col("b_sketch")) >= floor).select("a", "b"))
    chosen = sketches.join(ends(near), "set_id", "left_semi").select("item").distinct()
    sets = cut(texts.join(chosen, "item", "left_semi").mapInArrow(_shingled(words), "set_id long, shingles array<long>").groupBy("set_id").agg(F.first("shingles").alias("shingles")))
    both = near.join(_side(sets, "a"), "a").join(_side(sets, "b"), "b")
    common = F.size(F.array_intersect("a_shingles", "b_shingles"))
    return both.withColumn("common", common).where(F.col("common") >= like * (F.size("a_shingles") + F.size("b_shingles") - F.col("common"))).select("a", "b")


def near_duplicate_groups(items: DataFrame, item: str = "artifact_dir", words: int = WORDS, like: float = LIKE) -> DataFrame:
    """item and group_id (the group's least item) of every item that is in a group of two or more.

    Words are the maximal runs of letters and digits of the lower-cased text, sets those of `words` consecutive words; sets with
    a Jaccard likeness of at least `like` are linked and groups are closed under links. NULL texts, NULL items and texts of fewer words are in no
    group; repeated rows count once; an item with two texts joins their groups; no items give no rows. Sets are known by 64 bits.
    """
    texts = items.where(F.col(item).isNotNull() & F.col("text").isNotNull()).select(F.col(item).alias("item"), "text")
    item_type = dict(texts.dtypes)["item"]
    signed = cut(texts.mapInArrow(_signed(words), f"item {item_type}, set_id long, band_keys array<long>, sketch array<long>"))
    bands = signed.select(F.explode("band_keys").alias("key"), "set_id")
    shared = cut(bands.groupBy("key").agg(F.min("set_id").alias("centre"), F.max("set_id").alias("most"), F.count("*").alias("n")).where("centre != most").drop("most"))
    met = bands.join(broadcast_if_small(shared, shared.count(), 40), "key").select("key", "set_id", "centre", "n")
    members = cut(met.where("set_id != centre").distinct())
    star = members.select(F.col("centre").alias("a"), F.col("set_id").alias("b")).distinct()
    found = signed.select("item", "set_id")
    links = cut(_verified(star, signed, texts, words, like))
    # Members unlike the centre of a bucket of three or more are compared with all others there.
    ours = members.where("n > 2").select("key", "set_id", "centre")
    unlike = ours.join(links, (F.col("centre") == F.col("a")) & (F.col("set_id") == F.col("b")), "left_anti").select("key", F.col("set_id").alias("x"))
    rest = unlike.join(ours.select("key", F.col("set_id").alias("y")), "key").where("x != y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
    more = _verified(rest.join(links, ["a", "b"], "left_anti"), signed, texts, words, like)
    # An item of two sets ties them.
    tied = found.groupBy("item").agg(F.min("set_id").alias("a"), F.max("set_id").alias("b")).where("a != b")
    both = found.join(tied.select("item", "a"), "item").where("set_id != a").select("a", F.col("set_id").alias("b"))
    group = components(links.unionByName(more).unionByName(both))
    placed = found.select("item", "set_id").distinct().join(group.withColumnRenamed("node", "set_id"), "set_id", "left").select("item", F.coalesce("component", "set_id").alias("component"))
    named = placed.groupBy("component").agg(F.min("item").alias("group_id"), F.max("item").alias("most")).where("group_id != most")
    return placed.join(named, "component").select("item", "group_id").distinct().withColumnRenamed("item", item)


def group_pairs(groups: DataFrame, item: str = "artifact_dir") -> DataFrame:
    """All pairs within the groups, the smaller item first."""
    a = groups.select("group_id", F.col(item).alias(f"{item}_a"))
    b = groups.select("group_id", F.col(item).alias(f"{item}_b"))
    return a.join(b, "group_id").where(F.col(f"{item}_a") < F.col(f"{item}_b")).select(f"{item}_a", f"{item}_b")
