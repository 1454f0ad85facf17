"""Changes between consecutive full snapshots, by subtracting invertible Bloom lookup tables.

Plan: one shuffle brings the hashes of a root's rows together by (root, hash bucket); 28 bytes a row travel, never the
texts. In each bucket every snapshot becomes a table of cells (count, xor of key hash, xor of value hash, xor of
check hash). Subtracting the tables of neighbouring snapshots leaves only differing elements, which are peeled off cell by
cell. Buckets that don't peel get a larger table. The recovered hashes, as few as there are changes, then select their
rows in a second scan behind a Bloom filter of bounded size.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestack.runtime import broadcast_if_small, cut

#: Rows of a root per hash bucket; a larger root has more buckets, so no task holds more.
BUCKET_ROWS = 40_000
#: 64-bit words of the filter on recovered keys at most (4 MB); a fuller filter lets more rows through to the join, which decides.
BLOOM_WORDS = 1 << 19
OLDEST = -(1 << 63)

_U = np.uint64
_SEEDS = (_U(0x9E3779B97F4A7C15), _U(0xC2B2AE3D27D4EB4F), _U(0x165667B19E3779F9), _U(0xD6E8FEB86659FD93))


def _mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _element(key: np.ndarray, value: np.ndarray) -> np.ndarray:
    return _mix(_mix(key + _SEEDS[0]) ^ (value * _SEEDS[1]))


class Iblt:
    """Cells of one set of (key hash, value hash) pairs; three hash functions, each with a third of the cells."""

    def __init__(self, cells: int, seed: int) -> None:
        self.third, self.seed = max(8, -(-cells // 3)), _U(seed)
        n = 3 * self.third
        self.count, self.key, self.value, self.check = np.zeros(n, np.int64), np.zeros(n, _U), np.zeros(n, _U), np.zeros(n, _U)

    def add(self, key: np.ndarray, value: np.ndarray, sign: np.ndarray | int = 1) -> None:
        element = _element(key, value)
        check = _mix(element ^ _SEEDS[3])
        for i in range(3):
            at = (_mix(element + _SEEDS[i] * np.array([self.seed + _U(1)])) % _U(self.third)).astype(np.int64) + i * self.third
            np.add.at(self.count, at, sign)
            np.bitwise_xor.at(self.key, at, key)
            np.bitwise_xor.at(self.value, at, value)
            np.bitwise_xor.at(self.check, at, check)

    def minus(self, other: Iblt) -> Iblt:
        out = Iblt(0, int(self.seed))
        out.third = self.third
        out.count, out.key, out.value, out.check = self.count - other.count, self.key ^ other.key, self.value ^ other.value, self.check ^ other.check
        return out

    def peel(self) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
        """Keys, values and signs of all elements; None when cells remain, i.e. the table was too small."""
        keys, values, signs = [], [], []
        while True:
            at = np.flatnonzero(np.abs(self.count) == 1)
            at = at[_mix(_element(self.key[at], self.value[at]) ^ _SEEDS[3]) == self.check[at]]
            if not len(at):
                break
            at = at[np.unique(self.check[at], return_index=True)[1]]
            key, value, sign = self.key[at].copy(), self.value[at].copy(), self.count[at].copy()
            self.add(key, value, -sign)
            keys.append(key), values.append(value), signs.append(sign)
        if self.count.any() or self.key.any() or self.value.any() or self.check.any():
            return None
        empty = np.zeros(0, _U)
        return np.concatenate([empty, *keys]), np.concatenate([empty, *values]), np.concatenate([np.zeros(0, np.int64), *signs])


def set_difference(new: tuple[np.ndarray, np.ndarray], old: tuple[np.ndarray, np.ndarray], cells: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, value, sign) of the elements in one set only; +1: in `new`. The table is enlarged until it peels and both sides' digests agree."""
    digest = [np.bitwise_xor.reduce(_mix(_element(*side)), initial=_U(0)) for side in (new, old)]
    for seed in range(64):
        tables = []
        for side in (new, old):
            tables.append(Iblt(cells, seed))
            tables[-1].add(*side)
        if (found := tables[0].minus(tables[1]).peel()) is not None:
            key, value, sign = found
            if digest[0] ^ digest[1] == np.bitwise_xor.reduce(_mix(_element(key, value)), initial=_U(0)) and sign.sum() == len(new[0]) - len(old[0]):
                return found
        cells = min(max(24, 2 * cells), 8 * (len(new[0]) + len(old[0])) + 64)  # beyond that only another seed helps
    raise ValueError("no table of any size could be peeled")  # two different elements with the same 128 bits


def _newest(root: np.ndarray, seq: np.ndarray, key: np.ndarray, value: np.ndarray, ts: np.ndarray) -> np.ndarray:
    """Positions of the latest row of each (root, seq, key); among equal times the largest value hash."""
    order = np.lexsort((value, ts, key, seq, root))
    r, s, k = root[order], seq[order], key[order]
    last = np.ones(len(order), bool)
    last[:-1] = (r[1:] != r[:-1]) | (s[1:] != s[:-1]) | (k[1:] != k[:-1])
    return order[last]


def _combine(batches):  # noqa: ANN001, ANN202
    """Before the shuffle: of the rows of a key in a batch only the latest, so that a hot key sends few rows."""
    for batch in batches:
        cols = {c: batch.column(c).to_numpy() for c in ("root", "seq", "kh", "vh", "ts")}
        keep = _newest(*cols.values())
        yield batch if len(keep) == batch.num_rows else batch.take(pa.array(np.sort(keep)))


_CHANGES = "root long, seq long, lookup_seq long, kh long, change_kind string"


def _bucket_changes(tab: pa.Table) -> pa.Table:
    """All changes between neighbouring snapshots in one (root, bucket). seq is twice the snapshot's place, plus one for the last."""
    root, seq, key, value, ts = (tab.column(c).to_numpy() for c in ("root", "seq", "kh", "vh", "ts"))
    keep = _newest(root, seq, key, value, ts)
    seq, key, value = seq[keep], key[keep].view(_U), value[keep].view(_U)
    place, last = seq >> 1, (seq[(seq & 1) == 1][:1] >> 1)
    sets = {int(p): (key[a:b], value[a:b]) for p, a, b in zip(*_runs(place), strict=True)}
    none = (np.zeros(0, _U), np.zeros(0, _U))
    out: dict[str, list] = {"seq": [], "lookup_seq": [], "kh": [], "change_kind": []}
    for p in sorted({*sets, *(q + 1 for q in sets)}):
        if p == 0 or (len(last) and p > last[0]):
            continue
        new, old = sets.get(p, none), sets.get(p - 1, none)
        k, _, sign = set_difference(new, old, 96 + max(len(new[0]), len(old[0])) // 4)
        plus, minus = k[sign > 0], k[sign < 0]
        both = np.intersect1d(plus, minus)
        for kind, found, at in (("added", np.setdiff1d(plus, both), p), ("removed", np.setdiff1d(minus, both), p - 1), ("changed", both, p)):
            out["seq"].append(np.full(len(found), p, np.int64))
            out["lookup_seq"].append(np.full(len(found), at, np.int64))
            out["kh"].append(found.view(np.int64))
            out["change_kind"].append(np.full(len(found), kind, object))
    cols = {c: np.concatenate(v) if v else np.zeros(0, object if c == "change_kind" else np.int64) for c, v in out.items()}
    return pa.table({"root": pa.array(np.full(len(cols["kh"]), root[0], np.int64)), **{c: pa.array(v, pa.string() if c == "change_kind" else pa.int64()) for c, v in cols.items()}})


def _runs(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Values, starts and ends of the runs of equal values."""
    start = np.flatnonzero(np.r_[True, x[1:] != x[:-1]]) if len(x) else np.zeros(0, np.int64)
    return x[start], start, np.r_[start[1:], len(x)] if len(x) else start


def _hash(*cols: Column) -> Column:
    """64 bits of the columns in which NULL, '' and the columns' borders count."""
    return F.xxhash64(*[x for c in cols for x in (c.isNull(), c)])


def _bloom(keys: DataFrame, rows: int) -> tuple[DataFrame, int]:
    """One row with the words of a Bloom filter over (run_id, kh), 16 bits a key up to BLOOM_WORDS."""
    words = 1 << min(BLOOM_WORDS.bit_length() - 1, max(6, (rows // 4).bit_length()))
    at = keys.select(F.explode(F.array(*_bits("run_id", "kh", words))).alias("at"))
    by_word = at.groupBy((F.col("at") / 64).cast("long").alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("at") % 64).cast("int"))).alias("bits"))
    full = keys.sparkSession.range(words).withColumnRenamed("id", "word").join(by_word, "word", "left").select(F.struct("word", F.coalesce("bits", F.lit(0).cast("long")).alias("bits")).alias("x"))
    return full.agg(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["bits"]).alias("bits")), words


def _bits(run: str, kh: str, words: int) -> list[Column]:
    return [F.pmod(F.xxhash64(F.col(run), F.col(kh), F.lit(i)), F.lit(words * 64)) for i in range(2)]


def snapshot_changes(rows: DataFrame, runs: DataFrame, keys: dict[str, Column], values: list[str], *, run: str = "run_id", seen: str = "last_seen_at", bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """run_id, the keys and change_kind ('added', 'removed', 'changed') of every key that differs from the run before.

    rows: full snapshots, one row per record and run. runs: id, root, started_at, completed_at; runs with NULL
    completed_at are ignored (their rows too), a repeated id counts once with its latest started_at, NULL started_at is
    the earliest and equal times go by id. A root's first completed run has no changes; a run without rows is an empty
    snapshot. Rows of runs that aren't listed are ignored. keys: output name -> canonical form. Of several rows of a key in a
    run the latest by `seen` counts, NULL being the oldest, and among equal times the one with the largest value hash.
    NULL equals NULL in keys and values. Empty input gives no rows. Other columns are not read. Keys are compared by 64-bit hashes
    within one root; a coincidence there has a chance of n^2/2^65 for n keys of a root.
    """
    one = runs.where(F.col("completed_at").isNotNull() & F.col("id").isNotNull()).groupBy("id").agg(F.max(F.struct("started_at", "root")).alias("x")).select("id", "x.*")
    of_root = Window.partitionBy("root")
    placed = one.select("id", F.min("id").over(of_root).alias("root_id"), (F.row_number().over(of_root.orderBy(F.col("started_at").asc_nulls_first(), "id")) - 1).alias("place"), F.count("*").over(of_root).alias("n"))
    counted = rows.groupBy(F.col(run).alias("id")).agg(F.count("*").alias("rows"))
    by_root = Window.partitionBy("root_id")
    info = cut(placed.join(counted, "id", "left").select(
        F.col("id").alias("info_run"), F.col("root_id").alias("root"), "place",
        (F.col("place") * 2 + (F.col("place") == F.col("n") - 1).cast("long")).cast("long").alias("seq"),
        F.greatest(F.lit(1), F.ceil(F.sum(F.coalesce("rows", F.lit(0))).over(by_root) / bucket_rows)).cast("long").alias("buckets"),
    ))
    n_runs = info.count()
    small = broadcast_if_small(info.select("info_run", "root", "seq", "buckets"), n_runs, 64)

    key = _hash(*keys.values())
    hashed = rows.select(F.col(run).alias("info_run"), key.alias("kh"), _hash(*[F.col(c) for c in values]).alias("vh"), F.coalesce(F.unix_micros(F.col(seen).cast("timestamp")), F.lit(OLDEST)).alias("ts"))
    here = hashed.join(small, "info_run").select("root", F.pmod(F.xxhash64("kh", F.lit(7)), F.col("buckets")).alias("bucket"), "seq", "kh", "vh", "ts")
    changes = here.mapInArrow(_combine, here.schema).groupBy("root", "bucket").applyInArrow(_bucket_changes, _CHANGES)
    at = info.select("root", F.col("place").alias("seq"), F.col("info_run").alias("run_id"))
    found = changes.join(broadcast_if_small(at, n_runs, 64), ["root", "seq"])
    looked = at.select("root", F.col("seq").alias("lookup_seq"), F.col("run_id").alias("lookup_run"))
    found = cut(found.join(broadcast_if_small(looked, n_runs, 64), ["root", "lookup_seq"]).select(F.col("lookup_run"), "kh", F.col("run_id").alias("change_run"), "change_kind"))

    bits, words = _bloom(found.select(F.col("lookup_run").alias("run_id"), "kh"), found.count())
    named = rows.select(F.col(run).alias("lookup_run"), *[c.alias(k) for k, c in keys.items()], key.alias("kh"))
    spots = _bits("lookup_run", "kh", words)
    # The row number, always true, keeps the optimizer from inlining the hash into the filter, where it would be worked out for each bit.
    named = named.withColumn("row", F.monotonically_increasing_id()).where(_set_in(bits, spots) & (F.col("row") >= 0))
    return named.join(found, ["lookup_run", "kh"]).select(F.col("change_run").alias("run_id"), *keys, "change_kind").distinct()


def _set_in(bits: DataFrame, spots: list[Column]) -> Column:
    word = bits.scalar()
    test = [F.call_function("shiftright", F.get(word, (s / 64).cast("int")), (s % 64).cast("int")).bitwiseAND(F.lit(1)) == 1 for s in spots]
    return test[0] & test[1]
