"""Subject areas of documents: bisecting k-means over normalised document vectors, leaves labelled by their discriminative terms, and mixtures of leaves.

Documents are clustered as wholes; a leaf's terms, weighed against all sentences outside its area, then say into which leaf each
sentence falls, and the sentences fallen there give the leaf its next weights. A document's mixture is the leaves of its sentences, and
its areas are those of the leaves. Labelled examples do nothing but name leaves: without leaves there are no areas.

Every pass covers all documents. The driver holds the model, of bounded size: the leaves' centres, and at most TERMS terms for each leaf and area.
Terms travel as 32-bit hashes.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.ml.clustering import BisectingKMeans
from pyspark.ml.feature import IDF, HashingTF, Normalizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestack.llm.small import control_rows
from lodestack.runtime import cut

#: Leaves for each area of the taxonomy, hashed dimensions of document vectors, and rounds of k-means.
LEAVES_PER_AREA, DIMENSIONS, ITERATIONS = 4, 4096, 6
#: Terms by which a leaf is labelled, and terms the model keeps for a leaf (and for an area's examples).
LEAF_TERMS, TERMS = 150, 5_000
#: A leaf is an area's when so much of the fit of its terms to all areas is to that one. A leaf whose terms fit the areas less than NO_AREA, beside their weight, holds texts of none.
LEAF_FIT, NO_AREA = 0.6, 0.3
#: A term counts for a leaf when it was in so many sentences there and is so much likelier in its area than outside (nats).
LEAST_COUNT, LEAST_WEIGHT = 3, 0.7
#: A sentence falls into its best leaf when its terms' weights, each at most TOP_WEIGHT, sum to so much.
DEALS, TOP_WEIGHT = 3.6, 3.0
ROUNDS, SHARE = 1, 0.2

_FENCE = re.compile(r"^\s*(```|~~~)")
_BULLET = re.compile(r"^\s*(?:[-*•‣◦]|\d{1,3}[.)])\s+")
_HEADING = re.compile(r"^\s*(?:#{1,6}\s|=+\s*$|-{3,}\s*$)")
_SETTING = re.compile(r"^\s*[A-Za-z_][\w.-]*\s*[:=]\s*\S.*$")
_NUMBERED = re.compile(r"^\s*\d+(?:\.\d+)*[.)]?\s+\S")
_ENDS = re.compile(r"[.!?…][\"'”’»)\]]*$")
_CUT = re.compile(r"(?<=[.!?…])[\"'”’»)\]]*\s+(?=[\"'“„«(\[]*[^\W_])")
_BROKEN = re.compile(r"(?<=[^\W\d_])[-‐¬–=­]\n\s*(?=[^\W\d_])")
_RUN = re.compile(r"\S{41,}")
_LETTERS = re.compile(r"[^\W\d_]+")
_WORD = re.compile(r"[^\W\d_]+(?:[-'’][^\W\d_]+)*")
#: Longer words are unreadable runs (the same length stands in the pattern of runs).
LONGEST_WORD, FEWEST_WORDS = 40, 3


#: Lines of plain words: no heading, table, list or setting.
_PLAIN = re.compile(r"(?=[^\W\d_])(?:[^\W_]{1,40}(?:[-'’][^\W_]{1,40}){0,2}[,;.!?)]{0,2} )*[^\W_]{1,40}[,;.!?)]{0,2}")


def _is_text(line: str) -> bool:
    """A line of running text: mostly readable."""
    return 2 * sum(map(len, _LETTERS.findall(line))) > len(line) - line.count(" ")


def sentences(text: str) -> list[str]:
    return [s for s, _ in _sentences(text)]


def _sentences(text: str) -> list[tuple[str, list[str]]]:
    """The sentences, and their words in lower case, of running text and lists; not titles, headings, tables and settings blocks. Unreadable runs are left out of their lines."""
    blocks: list[str] = []
    now: list[str] = []
    fenced = False

    def flush() -> None:
        if now:
            blocks.append(" ".join(now))
            now.clear()

    first = True
    for line in _BROKEN.sub("", text).split("\n"):
        line = line.strip()
        plain = _PLAIN.fullmatch(line)
        if not plain and _RUN.search(line):
            line = " ".join(_RUN.sub("", line).split())
        if plain and now and not fenced:
            now.append(line)
            continue
        if _FENCE.match(line):
            fenced = not fenced
            flush()
            continue
        if fenced:
            continue
        if not line or _HEADING.match(line) or line.startswith("|") or line.count("|") > 1 or line.count("\t") > 1 or not (plain or _is_text(line)):
            flush()
        elif _BULLET.match(line):
            flush()
            item = _BULLET.sub("", line)
            if len(item.split()) > 3 or _ENDS.search(item):
                now.append(item)
        elif first and not _ENDS.search(line) and len(line.split()) <= 8 and not now:
            flush()
        elif _SETTING.match(line) and len(line.split()) <= 4 and not _ENDS.search(line) and not now:
            flush()
        else:
            now.append(line)
        first = first and not line
    flush()
    out = []
    for block in blocks:
        for s in _CUT.split(block):
            words = _WORD.findall(s.lower())
            if len(words) >= FEWEST_WORDS and (_ENDS.search(s) or len(words) > 5):
                out.append((s, words))
    return out


class _Terms(dict):
    """Numbers of terms: 32 bits of their hash, kept within one task; None for what is no term."""

    def __missing__(self, word: str) -> int | None:
        self[word] = out = (xxhash.xxh32_intdigest(word) - (1 << 31)) if 1 < len(word) <= LONGEST_WORD else None
        return out

    def of(self, words: list[str]) -> set[int]:
        out = set(map(self.__getitem__, words))
        out.discard(None)
        return out


def _read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Per row the terms of all its sentences end to end, and how many each sentence has. Other columns are kept."""
    terms = _Terms()
    for frame in frames:
        ids, lens = [], []
        for text in frame.pop("text"):
            sets = [terms.of(words) for _, words in _sentences(text)]
            ids.append(np.fromiter(chain.from_iterable(sets), np.int32))
            lens.append(np.fromiter(map(len, sets), np.int32))
        yield frame.assign(ids=ids, lens=lens)


def _flat(lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """The lists end to end, and their lengths. NULL is an empty list."""
    return lists.flatten().to_numpy(zero_copy_only=False), pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)


class Model:
    """Weights of terms (sorted hashes) for leaves (columns)."""

    def __init__(self, terms: np.ndarray, leaves: list[int], weights: np.ndarray) -> None:
        self.terms, self.leaves, self.weights = terms, np.array(leaves, np.int64), weights.astype(np.float32)

    def leaf_of(self, ids: np.ndarray, lens: np.ndarray) -> np.ndarray:
        """The leaf each sentence falls into, -1 for none. Of leaves that fit as well the first counts."""
        out = np.full(len(lens), -1, np.int64)
        if not len(self.terms) or not len(self.leaves):
            return out
        at = np.minimum(np.searchsorted(self.terms, ids), len(self.terms) - 1)
        known = np.flatnonzero(self.terms[at] == ids)
        if len(known):
            sentence = np.repeat(np.arange(len(lens)), lens)[known]
            start = np.flatnonzero(np.r_[True, sentence[1:] != sentence[:-1]])
            total = np.add.reduceat(self.weights[at[known]], start, axis=0)
            best = total.argmax(axis=1)
            deals = total[np.arange(len(best)), best] >= DEALS
            out[sentence[start][deals]] = self.leaves[best[deals]]
        return out


def _log_ratio(c: np.ndarray, inside: np.ndarray, outside_c: np.ndarray, outside: np.ndarray, n: float, everywhere: np.ndarray) -> np.ndarray:
    """How much likelier (nats) a term is in some sentences than in those outside."""
    p = everywhere / max(n, 1.0)
    return np.log((c + 20 * p) / (inside + 20)) - np.log((np.maximum(outside_c, 0) + 0.5) / (np.maximum(outside, 0) + 1))


def _weighed(counts: DataFrame, label: dict[int, str | None]) -> Model:
    """The model of the leaves that have an area or none: the terms of each, weighed by how much likelier they are in its area than outside. From counts (leaf, term, c) of sentences; term NULL counts the sentences themselves."""
    if not any(label.values()):
        return Model(np.zeros(0, np.int32), [], np.zeros((0, 0)))
    # A leaf of no area stands for itself.
    label = {k: f"area {a}" if a else f"leaf {k}" for k, a in label.items()}
    area = F.create_map(*[F.lit(x) for kv in label.items() for x in kv])[F.col("leaf")]
    sizes = {r.leaf: float(r.c) for r in counts.where("term IS NULL").collect()}
    n = sum(sizes.values())
    by = counts.where("term IS NOT NULL").withColumn("area", area)
    by = by.withColumns({"everywhere": F.sum("c").over(Window.partitionBy("term")), "at_home": F.sum("c").over(Window.partitionBy("term", "area"))})
    ranked = by.where(F.col("area").isNotNull() & (F.col("c") >= LEAST_COUNT)).withColumn("r", F.row_number().over(Window.partitionBy("leaf").orderBy(F.desc("c"), "term")))
    rows = ranked.where(F.col("r") <= TERMS).select("leaf", "term", "c", "everywhere", "at_home").toArrow()
    leaf, term, c, everywhere, at_home = (x.to_numpy() for x in rows.columns)
    areas: Counter = Counter()
    for k, a in label.items():
        areas[a] += sizes.get(k, 0.0)
    home = np.array([float(areas[label[k]]) for k in leaf.tolist()])
    w = _log_ratio(at_home, home, everywhere - at_home, n - home, n, everywhere)
    keep = w >= LEAST_WEIGHT
    terms, row = np.unique(term[keep], return_inverse=True)
    leaves = sorted(label)
    weights = np.zeros((len(terms), len(leaves)), np.float32)
    weights[row, np.searchsorted(leaves, leaf[keep])] = np.minimum(w[keep], TOP_WEIGHT)
    return Model(terms, leaves, weights)


def _counting(model: Model | None):  # noqa: ANN202
    """Sentences with each term by leaf (of the document where there is no model yet), and the sentences themselves (term NULL), combined per batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lens, per_row = _flat(batch.column("lens"))
            ids, _ = _flat(batch.column("ids"))
            leaf = np.repeat(batch.column("leaf").to_numpy(zero_copy_only=False).astype(np.int64), per_row) if model is None else model.leaf_of(ids, lens)
            k, n = np.unique(leaf, return_counts=True)
            pairs, c = np.unique((np.repeat(leaf, lens) << 32) + (ids.astype(np.int64) + (1 << 31)), return_counts=True)
            none = np.r_[np.zeros(len(pairs), bool), np.ones(len(k), bool)]
            term = pa.array(np.r_[(pairs & 0xFFFFFFFF) - (1 << 31), np.zeros(len(k), np.int64)].astype(np.int32), mask=none)
            yield pa.RecordBatch.from_arrays([pa.array(np.r_[pairs >> 32, k]), term, pa.array(np.r_[c, n])], ["leaf", "term", "c"])

    return run


def _counts(docs: DataFrame, model: Model | None) -> DataFrame:
    columns = ["ids", "lens"] + ["leaf"] * (model is None)
    return cut(docs.select(*columns).mapInArrow(_counting(model), "leaf long, term int, c long").groupBy("leaf", "term").agg(F.sum("c").alias("c")))


def _labels(counts: DataFrame, examples: DataFrame) -> dict[int, str | None]:
    """The area of each leaf whose discriminative terms are mostly one area's, None for leaves of no area; mixed ones are left out. examples: area, ids, lens."""
    told = examples.select("area", F.explode("ids").alias("term")).groupBy("area", "term").agg(F.count("*").alias("c"))
    spoken = told.withColumns({"everywhere": F.sum("c").over(Window.partitionBy("term")), "r": F.row_number().over(Window.partitionBy("area").orderBy(F.desc("c"), "term"))})
    known = spoken.where((F.col("r") <= TERMS) & (F.col("c") >= LEAST_COUNT)).toPandas()
    sizes = {r.area: float(r.n) for r in examples.groupBy("area").agg(F.sum(F.size("lens")).alias("n")).collect()}
    n = sum(sizes.values())
    inside = known["area"].map(sizes).to_numpy(float)
    known["w"] = _log_ratio(known["c"].to_numpy(float), inside, (known["everywhere"] - known["c"]).to_numpy(float), n - inside, n, known["everywhere"].to_numpy(float))
    known["w"] = known["w"].clip(upper=TOP_WEIGHT)
    leaf_n = {r.leaf: float(r.c) for r in counts.where("term IS NULL").collect()}
    total = sum(leaf_n.values())
    size = F.create_map(*[F.lit(x) for kv in leaf_n.items() for x in kv])[F.col("leaf")]
    by = counts.where("term IS NOT NULL").withColumn("everywhere", F.sum("c").over(Window.partitionBy("term")))
    told_by = F.greatest(F.lit(0.0), (F.log(F.col("c") / size) - F.log(F.col("everywhere") / total)) * F.sqrt("c"))
    top = by.where(F.col("c") >= LEAST_COUNT).select("leaf", "term", told_by.alias("x")).withColumn("r", F.row_number().over(Window.partitionBy("leaf").orderBy(F.desc("x"), "term"))).where(F.col("r") <= LEAF_TERMS).toPandas()
    fit = top.merge(known[known["w"] >= LEAST_WEIGHT][["area", "term", "w"]], on="term")
    fit = fit.assign(fit=fit["x"] * fit["w"]).groupby(["leaf", "area"])["fit"].sum()
    out: dict[int, str | None] = {}
    for leaf, weight in top.groupby("leaf")["x"].sum().items():
        f = fit.loc[leaf].sort_index() if leaf in fit.index.get_level_values(0) else pd.Series([0.0])
        if f.sum() < NO_AREA * weight:
            out[int(leaf)] = None
        elif f.max() >= LEAF_FIT * f.sum():
            out[int(leaf)] = f.idxmax()
    return out


def subject_model(docs: DataFrame, examples: DataFrame, areas: int) -> tuple[Model, dict[int, str | None]]:
    """Weights of the leaves, and their areas. docs: ids, lens (cut). examples: area, ids, lens."""
    hashed = HashingTF(inputCol="ids", outputCol="tf", numFeatures=DIMENSIONS, binary=True)
    tf = hashed.transform(docs.where(F.size("ids") > 0))
    idf = IDF(inputCol="tf", outputCol="tfidf", minDocFreq=2).fit(tf)
    vectors = Normalizer(inputCol="tfidf", outputCol="features").transform(idf.transform(tf)).select("ids", "lens", "features")
    fitted = BisectingKMeans(k=LEAVES_PER_AREA * areas, maxIter=ITERATIONS, seed=11, featuresCol="features", predictionCol="leaf", minDivisibleClusterSize=4.0).fit(vectors.select("features"))
    counts = _counts(fitted.transform(vectors), None)
    label = _labels(counts, examples)
    model = _weighed(counts, label)
    for _ in range(ROUNDS):
        model = _weighed(_counts(docs, model), label)
    return model, label


def _mixing(model: Model, label: dict[int, str | None]):  # noqa: ANN202
    named = np.array([k for k, a in label.items() if a], np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lens, per_row = _flat(batch.column("lens"))
            ids, _ = _flat(batch.column("ids"))
            leaf = model.leaf_of(ids, lens)
            ours = np.isin(leaf, named)
            pairs, n = np.unique((np.repeat(np.arange(len(per_row)), per_row)[ours] << 32) + leaf[ours], return_counts=True)
            row, leaf = pairs >> 32, pairs & 0xFFFFFFFF
            domain = pa.array([label[k] for k in leaf.tolist()], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("item").take(pa.array(row)), pa.array(leaf), domain, pa.array(n), pa.array(per_row[row])], ["item", "leaf", "domain", "n", "sents"])

    return run


def leaf_mixtures(items: DataFrame, taxonomy: DataFrame, examples: DataFrame, item: str = "artifact_dir") -> DataFrame:
    """item, leaf, domain, n, sents: the labelled leaves that the item's sentences fall into, and how many do of how many."""
    areas = sorted({r.domain for r in control_rows(taxonomy.select("domain")) if r.domain})
    texts = items.where(F.col("text").isNotNull() & F.col(item).isNotNull()).select(F.col(item).alias("item"), "text")
    kind = dict(texts.dtypes)["item"]
    docs = cut(texts.mapInPandas(_read, f"item {kind}, ids array<int>, lens array<int>"))
    out = f"item {kind}, leaf long, domain string, n long, sents long"
    if not areas or docs.isEmpty():
        return items.sparkSession.createDataFrame([], out)
    told = examples.where(F.col("domain").isin(areas) & F.col("text").isNotNull()).select(F.col("domain").alias("area"), "text").distinct()
    model, label = subject_model(docs, cut(told.mapInPandas(_read, "area string, ids array<int>, lens array<int>")), len(areas))
    return docs.mapInArrow(_mixing(model, label), out).distinct()


def subjects(items: DataFrame, taxonomy: DataFrame, examples: DataFrame, item: str = "artifact_dir") -> DataFrame:
    """item, domain, sentences, share: every area some sentence of the item deals with and its share of the item's sentences.

    NULL texts and texts without a sentence have no rows; a repeated row counts once; examples whose area is NULL or not in the taxonomy are passed over;
    an empty taxonomy or no examples give no rows. Of leaves of equal weight a sentence takes the first.
    """
    by = leaf_mixtures(items, taxonomy, examples, item).groupBy("item", "domain", "sents").agg(F.sum("n").alias("n"))
    return by.select(F.col("item").alias(item), "domain", F.col("n").alias("sentences"), (F.col("n") / F.col("sents")).alias("share"))


def assigned(mixtures: DataFrame, item: str = "artifact_dir", share: float = SHARE) -> DataFrame:
    """item and domain where the area has at least the given share."""
    return mixtures.where(F.col("share") >= share).select(item, "domain").distinct()


def composition(mixtures: DataFrame) -> DataFrame:
    """Per area: items that have it, their sentences, and the area's share of all assigned sentences."""
    by = mixtures.groupBy("domain").agg(F.count_if(F.col("share") >= SHARE).alias("items"), F.sum("sentences").alias("sentences"))
    return by.withColumn("sentence_share", F.round(F.col("sentences") / F.sum("sentences").over(Window.partitionBy()), 6))
