"""Repairing text read from scanned pages.

One pass counts the words of all texts. A second gathers, for the words that matter, their neighbours by place (two words before and
after), the lines that may be running headers, and what each text will ask about. Skip-gram vectors come from the neighbours: the basis
words' positive pointwise mutual information with their neighbours is reduced to its leading singular vectors, which is what
skip-gram training with negative samples approaches (Levy and Goldberg 2014), and every other word is laid into that space by its own neighbours.
A rare word is linked to a frequent one when a few glyph edits lead there, and the link holds when the vectors are near enough for how
rare the one is beside the other. A line in the form of a header is furniture when its form repeats in other surroundings.

The most frequent words go to the tasks as a dictionary; whatever else a text asks about comes to it by a join, so the dictionary's size
changes no result. What the driver fetches is bounded: LEXICON words and at most BASIS * 4 * CONTEXTS counts of 12 bytes (50 MB).
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from itertools import count

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestack.llm.scan_text import SEEN, WINDOW, Reader, Reading, asked, edits, header_forms, outline, repair, tokens_of, word_of
from lodestack.runtime import cut

#: Words sent to the tasks at most (the others are joined); words the basis is made of, words that count as neighbours, length of the vectors.
LEXICON, BASIS, CONTEXTS, DIMENSIONS = 200_000, 2_048, 512, 48
#: A right word was seen so often at least; a word never seen inside a line is a misreading of any such word, one with symbols of a word seen twice.
FREQUENT = 20
#: A misreading scores log10(sightings of the right word / own) + PULL * cosine, and CLEAR more when only symbols stand in the way; it needs SCORE.
SCORE, PULL, CLEAR = 3.0, 4.0, 1.5
#: The cosine it needs besides, approached as more neighbours are known; HALF of them give half of it.
SUITS, HALF = 0.3, 10.0
#: A header's form stands in so many surroundings at least.
SURROUNDINGS = 2

_PLACES = tuple(d for d in range(-WINDOW, WINDOW + 1) if d)
def _hash(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass")) - (1 << 63)


def _numbered(texts: Iterable[list[str]]) -> tuple[np.ndarray, np.ndarray, list[str | None]]:
    """The tokens of all texts by number, which of them stand inside a line (line ends may have broken the first and last), and the words by number."""
    flat = ["\n"]
    for tokens in texts:
        flat += tokens
        flat.append("\n")
    numbers: dict[str, int] = defaultdict(count().__next__)
    ids = np.fromiter(map(numbers.__getitem__, flat), np.int64, len(flat))
    words: dict[str | None, int] = defaultdict(count().__next__)
    x = np.array([words[word_of(t)] for t in numbers])[ids]
    ends = x == words["\n"]
    inside = ~ends
    inside[1:] &= ~ends[:-1]
    inside[:-1] &= ~ends[1:]
    return x, inside, list(words)


def _counted(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Sightings of words inside lines: what stands first or last on a line may be half a word. Whatever stands between blanks is taken apart once a batch."""
    for frame in frames:
        chunks: Counter = Counter()
        for text in frame["text"]:
            for line in text.split("\n"):
                chunks.update(line.split()[1:-1])
        words: Counter = Counter()
        for chunk, n in chunks.items():
            for token in tokens_of(chunk):
                words[word_of(token)] += n
        words.pop(None, None)
        yield pd.DataFrame(list(words.items()), columns=["word", "n"])


_GATHERED = "kind byte, key long, word string, code int, n long"
_NEIGHBOURS, _FORM, _ASKED = 1, 2, 3


def _gather(lexicon: dict[str, int], tracked: set[str], contexts: dict[str, int]):  # noqa: ANN202
    """Neighbours by place of the tracked words and of those outside the lexicon; header forms with their surroundings; what texts ask about.

    Combined per batch. code: place * CONTEXTS + number of the neighbour.
    """
    width = len(_PLACES) * CONTEXTS

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            tokens = [tokens_of(t) for t in frame["text"]]
            x, inside, words = _numbered(tokens)
            context = np.array([contexts.get(w, -1) for w in words])[x]
            context[~inside] = -1
            ours = np.array([w is not None and w != "\n" and (w in tracked or w not in lexicon) for w in words])[x] & inside
            codes = []
            for place, d in enumerate(_PLACES):
                a, b = (x[:-d], context[d:]) if d > 0 else (x[-d:], context[:d])
                ok = (ours[:-d] if d > 0 else ours[-d:]) & (b >= 0)
                codes.append((a[ok] * len(_PLACES) + place) * CONTEXTS + b[ok])
            code, n = np.unique(np.concatenate(codes), return_counts=True)
            yield pd.DataFrame({"kind": np.int8(_NEIGHBOURS), "key": np.int64(0), "word": np.array(words, object)[code // width], "code": (code % width).astype(np.int32), "n": n})
            rest = []
            for key, text, own in zip(frame["key"].tolist(), frame["text"], tokens, strict=True):
                kinds, lines = outline(text) if "\n" in text else ([], [])
                forms = header_forms(kinds, lines)
                rest += [(_ASKED, key, w) for w in asked(set(own), kinds, lines, lexicon) | {"\n" + form for form, _ in forms}]
                rest += [(_FORM, _hash(around), "\n" + form) for form, around in forms]
            out = pd.DataFrame(rest, columns=["kind", "key", "word"]).astype({"kind": np.int8, "key": np.int64, "word": object})
            yield out.assign(code=np.int32(0), n=np.int64(1))

    return run


def skipgram_basis(counts: np.ndarray, dimensions: int) -> tuple[np.ndarray, np.ndarray]:
    """Vectors of neighbours from counts (basis word, neighbour by place), and each neighbour's smoothed share of all.

    The positive PMI's leading right singular vectors, by a randomised SVD with a fixed seed.
    """
    total = counts.sum() or 1.0
    share = counts.sum(axis=0) ** 0.75
    share = share / (share.sum() or 1.0)
    with np.errstate(divide="ignore", invalid="ignore"):
        pmi = np.log(counts / total) - np.log(counts.sum(axis=1, keepdims=True) / total) - np.log(share)[None, :]
    pmi = np.where(np.isfinite(pmi), np.maximum(pmi, 0), 0).astype(np.float32)
    d = min(dimensions, *pmi.shape)
    q = np.linalg.qr(pmi @ np.random.default_rng(3).standard_normal((pmi.shape[1], min(*pmi.shape, d + 16)), np.float32))[0]
    for _ in range(3):
        q = np.linalg.qr(pmi @ (pmi.T @ q))[0]
    _, _, vt = np.linalg.svd(q.T @ pmi, full_matrices=False)
    return vt[:d].T.copy(), share


def _vectors(basis: np.ndarray, share: np.ndarray):  # noqa: ANN202
    """Per word with its list of (code, n): where its neighbours put it (near), its own vector (PMI-weighted), neighbours known, and own sightings.

    Copies of a passage repeat a word's neighbours. Own sightings are those besides the commonest neighbour, at the place where most are left, and one.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            near, vector, known, own = [], [], [], []
            for at, n in zip(frame["codes"], frame["ns"], strict=True):
                at, n = np.asarray(at, np.int64), np.asarray(n, np.float64)
                near.append((n @ basis[at]).astype(np.float32))
                usual = share[at]
                pmi = np.where(usual > 0, np.maximum(np.log(n / n.sum()) - np.log(np.where(usual > 0, usual, 1.0)), 0), 0)
                vector.append((pmi @ basis[at]).astype(np.float32))
                known.append(int(n.sum()))
                place = at // CONTEXTS
                own.append(1 + max(int(n[place == p].sum() - n[place == p].max()) for p in np.unique(place)))
            yield pd.DataFrame({"word": frame["word"], "near": near, "vector": vector, "known": known, "own": own})

    return run


def _spelled(lexicon: dict[str, int], whole: bool):  # noqa: ANN202
    """The frequent words that a word's glyph edits lead to: word, n, right, m (NULL: outside the lexicon), clear."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for w, n in zip(frame["word"], frame["n"].tolist(), strict=True):
                for to, clear in edits(w).items():
                    m = lexicon.get(to)
                    if m is not None or not whole:
                        out.append((w, n, to, m, clear))
            yield pd.DataFrame(out, columns=["word", "n", "right", "m", "clear"]).astype({"n": np.int64, "m": "Int64", "clear": bool})

    return run


def _candidates(words: DataFrame, counted: DataFrame, lexicon: dict[str, int], whole: bool) -> DataFrame:
    """word, n, right, m, clear: glyph edits of the words that are words seen often enough. whole: the lexicon holds all words."""
    found = words.mapInPandas(_spelled(lexicon, whole), "word string, n long, right string, m long, clear boolean")
    if not whole:
        outside = found.where("m IS NULL").drop("m").join(counted.select(F.col("word").alias("right"), F.col("n").alias("m")), "right")
        found = found.where("m IS NOT NULL").unionByName(outside)
    enough = (F.col("m") >= FREQUENT) | (F.col("clear") & (F.col("m") >= SEEN))
    return found.where(enough)


def _cosine(a: str, b: str) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q), F.lit(0.0), lambda s, v: s + v)
    return F.coalesce(F.try_divide(dot(a, b), F.sqrt(dot(a, a) * dot(b, b))), F.lit(0.0))


def _held(spelled: DataFrame, vectors: DataFrame) -> DataFrame:
    """word, right, vector: the candidates whose vectors bear them out. spelled: of words that were seen inside lines."""
    here = vectors.select("word", "near", "known", "own")
    there = vectors.select(F.col("word").alias("right"), "vector", F.col("own").alias("right_own"))
    both = spelled.join(here, "word", "left").join(there, "right", "left")
    cosine, known = _cosine("near", "vector"), F.coalesce("known", F.lit(0))
    both = both.withColumns({"cosine": cosine, "known": known, "own": F.least("n", F.coalesce("own", F.lit(1)))})
    long_clear = F.col("clear") & (F.length("word") >= 4)
    score = F.log10(F.col("m") / F.greatest(F.lit(1), "own")) + PULL * F.col("cosine") + F.when(long_clear, CLEAR).otherwise(0.0)
    suits = F.col("cosine") >= SUITS * F.col("known") / (F.col("known") + HALF)
    few = long_clear & (F.col("own") <= SEEN)
    # The right word is the better seen one, copies left out; of those as well seen it is the more frequent.
    order = F.struct(F.least("m", F.coalesce("right_own", F.lit(1))), "m") >= F.struct("own", "n")
    return both.where(order & (few | ((score >= SCORE) & (long_clear | suits)))).select("word", "right", "vector")


def learn(texts: DataFrame, lexicon_size: int = LEXICON) -> tuple[Reader, DataFrame] | None:
    """What repairing the texts needs: a reader that knows the lexicon, and for each key the facts it has to be set to. texts: key
    (the record's), text; no NULLs. None where they have no words.
    """
    spark = texts.sparkSession
    counted = cut(texts.select("text").mapInPandas(_counted, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")))
    top = counted.orderBy(F.desc("n"), "word").limit(max(lexicon_size + 1, BASIS)).collect()
    if not top:
        return None
    lexicon, whole = {r.word: r.n for r in top[:lexicon_size]}, len(top) <= lexicon_size
    basis = {r.word: i for i, r in enumerate(top[:BASIS])}
    contexts = {r.word: i for i, r in enumerate(top[:CONTEXTS])}
    spelled = cut(_candidates(counted, counted, lexicon, whole))
    linked = {r.word for r in spelled.where(F.col("n") >= min(lexicon.values())).select("word").distinct().collect()} & lexicon.keys()
    listed = spark.createDataFrame([(w,) for w in lexicon], "right string")
    rights = {r.right for r in listed.join(spelled, "right", "left_semi").collect()}
    gathered = texts.mapInPandas(_gather(lexicon, basis.keys() | linked | rights, contexts), _GATHERED)
    gathered = cut(gathered.groupBy("kind", "key", "word", "code").agg(F.sum("n").alias("n")))

    neighbours = gathered.where(F.col("kind") == _NEIGHBOURS).select("word", "code", "n")
    index = spark.createDataFrame(list(basis.items()), "word string, i int")
    cells = neighbours.join(F.broadcast(index), "word").select("i", "code", F.col("n").cast("int").alias("n")).toArrow()
    matrix = np.zeros((len(basis), len(_PLACES) * CONTEXTS), np.float32)
    matrix[cells["i"].to_numpy(), cells["code"].to_numpy()] = cells["n"].to_numpy()
    projection, share = skipgram_basis(matrix, DIMENSIONS)
    needed = spelled.select("word").union(spelled.select("right")).distinct()
    # A word has at most as many codes as there are places and neighbours.
    by_word = neighbours.join(needed, "word", "left_semi").groupBy("word").agg(F.collect_list("code").alias("codes"), F.collect_list(F.col("n").cast("double")).alias("ns"))
    held = _held(spelled, cut(by_word.mapInPandas(_vectors(projection, share), "word string, near array<float>, vector array<float>, known long, own long")))

    asks = gathered.where((F.col("kind") == _ASKED) & (F.col("word") != "\n")).select("key", "word")
    # Of words never seen inside a line the spelling decides.
    unseen = asks.where(~F.col("word").startswith("\n")).select("word").distinct().join(counted, "word", "left_anti").withColumn("n", F.lit(0).cast("long"))
    guessed = _candidates(unseen, counted, lexicon, whole).select("word", "right", F.lit(None).cast("array<float>").alias("vector"))
    readings = held.unionByName(guessed).groupBy("word").agg(F.array_sort(F.collect_set(F.struct("right", "vector"))).alias("readings"))
    readings = cut(readings.withColumn("readings", F.transform("readings", lambda r: F.struct(r["right"].alias("right"), F.when(F.size("readings") > 1, r["vector"]).alias("vector")))))
    listed = spark.createDataFrame([(w,) for w in lexicon], "word string")
    told = {r.word: [Reading(x.right, None if x.vector is None else np.asarray(x.vector, np.float32)) for x in r.readings] for r in readings.join(listed, "word", "left_semi").collect()}
    forms = gathered.where(F.col("kind") == _FORM).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= SURROUNDINGS)
    none = F.lit(None).cast(readings.schema["readings"].dataType).alias("readings")
    seen = asks.join(counted.select("word", "n", none).unionByName(forms.select("word", "n", none)), "word").unionByName(asks.join(readings, "word").select("key", "word", F.lit(0).cast("long").alias("n"), "readings"))
    lined = gathered.where((F.col("kind") == _ASKED) & (F.col("word") == "\n")).select("key", "word", F.lit(0).cast("long").alias("n"), none)
    one = seen.unionByName(lined).groupBy("key", "word").agg(F.max("n").alias("n"), F.max("readings").alias("readings"))
    facts = one.groupBy("key").agg(F.collect_list(F.struct("word", "n", "readings")).alias("facts"))
    places = {(d, w): projection[k * CONTEXTS + i] for k, d in enumerate(_PLACES) for w, i in contexts.items()}
    return Reader(lexicon, told, places), facts


def records(work_items: DataFrame, evidence: DataFrame) -> DataFrame:
    """rec_table, rec_key, text of the texts that may come from scanned pages; NULL texts and keys are left out."""
    a = work_items.select(F.lit("work_items").alias("rec_table"), F.col("artifact_dir").alias("rec_key"), "text")
    b = evidence.select(F.lit("compliance_assessment_evidence").alias("rec_table"), F.col("id").cast("string").alias("rec_key"), F.col("quote").alias("text"))
    return a.unionByName(b).where(F.col("text").isNotNull() & F.col("rec_key").isNotNull())


def repaired(recs: DataFrame, lexicon_size: int = LEXICON) -> DataFrame:
    """rec_table, rec_key, noise (sorted array of hyphen, glyph, header, page_no) and the repaired text of each record.

    The collection itself is what the model is learned from. Texts without noise come back unchanged with an empty array, blank ones
    too. Repeated rows give repeated rows. Empty input gives no rows. Runs of more than 40 characters are no words and stay as they are.
    """
    out = "rec_table string, rec_key string, noise array<string>, text string"
    keyed = recs.withColumn("key", F.xxhash64("rec_table", "rec_key", "text"))
    learned = learn(keyed.select("key", "text"), lexicon_size)
    if learned is None:
        return recs.select("rec_table", "rec_key", F.array().cast("array<string>").alias("noise"), "text")
    reader, facts = learned

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            done = [repair(x, reader.of(() if f is None else f)) for x, f in zip(frame["text"], frame["facts"], strict=True)]
            yield pd.DataFrame({"rec_table": frame["rec_table"], "rec_key": frame["rec_key"], "noise": [sorted(n) for n, _ in done], "text": [x for _, x in done]})

    # Facts are a small part of the texts: they are hashed, so that the texts needn't be sorted.
    return keyed.join(facts.hint("shuffle_hash"), "key", "left").select("rec_table", "rec_key", "text", "facts").mapInPandas(run, out)


def found_noise(recs: DataFrame) -> DataFrame:
    """rec_table, rec_key, noise: one row per record and kind of noise."""
    return repaired(recs).select("rec_table", "rec_key", F.explode("noise").alias("noise")).distinct()
