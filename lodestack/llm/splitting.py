"""Cutting long texts at natural boundaries by dynamic programming."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestack.llm.small import control_rows
from lodestack.runtime import broadcast_if_small, cut

DEFAULT_LIMIT, DEFAULT_OVERLAP = 12_000, 500
#: Boundary kinds, strongest first: what must stand before the cut, and the penalty. A cut inside a word costs HARD.
STRONG = ((re.compile(r"\n[ \t]*\n\s*"), 0.0), (re.compile(r"\n"), 1.0), (re.compile(r"[.!?…。！？][\"'”’»)\]]*\s+"), 2.0))
WEAK = ((re.compile(r"[;:,–—][\"'”’»)\]]*\s+"), 5.0), (re.compile(r"\s+"), 8.0))
HARD = 1e6
#: What a piece costs whose length differs from the mean by a whole limit.
IMBALANCE = 40.0
_OUT = "artifact_dir string, config_id int, piece int, piece_start int, piece_end int, piece_text string"


def _ends(kinds, text: str) -> dict[int, float]:  # noqa: ANN001
    out: dict[int, float] = {}
    for pattern, penalty in kinds:
        for m in pattern.finditer(text):
            out.setdefault(m.end(), penalty)
    return out


def _candidates(text: str, step: int) -> tuple[np.ndarray, np.ndarray]:
    """Cut positions and penalties: every strong boundary; in stretches longer than step the weak ones; in those still longer, cuts inside words."""
    found = _ends(STRONG, text)
    weak, keys = {}, np.zeros(0, np.int64)
    for fill in ("weak", "hard"):
        at = sorted({0, len(text), *found})
        for a, b in zip(at, at[1:], strict=False):
            if b - a > step:
                if fill == "weak":
                    if not weak:
                        weak = _ends(WEAK, text)
                        keys = np.array(sorted(weak), np.int64)
                    for p in keys[np.searchsorted(keys, a, "right") : np.searchsorted(keys, b)].tolist():
                        found.setdefault(p, weak[p])
                else:
                    found.update({p: HARD for p in range(a + step, b, step)})
    found.pop(0, None)
    found[len(text)] = 0.0
    at = np.array(sorted(found))
    return at, np.array([found[p] for p in at.tolist()])


def cut_points(text: str, limit: int, overlap: int) -> list[int]:
    """Ends of the pieces. Each piece but the first begins `overlap` characters before the end of the one before and none is longer than limit."""
    n = len(text)
    overlap = min(max(overlap, 0), limit - 1)
    room = limit - overlap
    at, penalty = _candidates(text, max(1, room // 16))
    pieces = max(2, -(-(n - overlap) // room))
    mean = (n - overlap) / pieces + overlap
    cost, back = np.full(len(at), np.inf), np.full(len(at), -1)
    low = np.searchsorted(at, at - room)  # the first cut from which this one is in reach
    for i, p in enumerate(at.tolist()):
        if overlap < p <= limit:
            cost[i] = penalty[i] + IMBALANCE * ((p - mean) / limit) ** 2
        if (a := low[i]) < i:
            total = cost[a:i] + IMBALANCE * ((p - at[a:i] + overlap - mean) / limit) ** 2
            j = int(total.argmin())
            if total[j] + penalty[i] < cost[i]:
                cost[i], back[i] = total[j] + penalty[i], a + j
    out, i = [], len(at) - 1
    while i >= 0:
        out.append(int(at[i]))
        i = int(back[i])
    return out[::-1]


def split(items: DataFrame, profiles: DataFrame) -> DataFrame:
    """The pieces of every text longer than a profile's limit: artifact_dir, config_id, piece, piece_start, piece_end, piece_text.

    Lengths count code points. NULL in max_input_chars and chunk_overlap takes the default, 0 or less in max_input_chars
    means never cut; an overlap below 0 is 0 and one not below the limit is the limit less 1. Texts within the limit, empty and NULL texts have no rows. A row that
    occurs twice is cut once; NULL artifact_dir is a key like any other. Piece ends cost by the kind of boundary, plus
    the squared difference from the mean length; the sum is least. Inside a word is cut only where no boundary is in reach.
    """
    todo = []
    for r in control_rows(profiles.select("config_id", "max_input_chars", "chunk_overlap")):
        limit = DEFAULT_LIMIT if r.max_input_chars is None else r.max_input_chars
        if limit > 0:
            todo.append((r.config_id, limit, DEFAULT_OVERLAP if r.chunk_overlap is None else r.chunk_overlap))
    if not todo:
        return items.sparkSession.createDataFrame([], _OUT)

    def cut_all(frames):  # noqa: ANN001, ANN202
        for frame in frames:
            out = []
            for name, text in zip(frame.artifact_dir, frame.text, strict=True):
                for config, limit, overlap in todo:
                    if len(text) > limit:
                        start = 0
                        for k, end in enumerate(cut_points(text, limit, overlap)):
                            out.append((name, config, k, start, end, text[start:end]))
                            start = end - min(max(overlap, 0), limit - 1)
            yield pd.DataFrame(out, columns=["artifact_dir", "config_id", "piece", "piece_start", "piece_end", "piece_text"])

    long = items.select("artifact_dir", "text").where(F.length("text") > min(limit for _, limit, _ in todo))
    # Only rows whose hash occurs again are shuffled to find out which are the same.
    keyed = long.withColumn("hash", F.xxhash64("artifact_dir", "text"))
    again = cut(keyed.groupBy("hash").agg(F.count("*").alias("n")).where("n > 1").select("hash"))
    again = broadcast_if_small(again, again.count(), 16)
    once = keyed.join(again, "hash", "left_anti").drop("hash")
    return once.unionByName(keyed.join(again, "hash", "left_semi").drop("hash").distinct()).mapInPandas(cut_all, _OUT)


def cut_items(pieces: DataFrame) -> DataFrame:
    """artifact_dir and config_id of the texts that were cut."""
    return pieces.where(F.col("piece") == 1).select("artifact_dir", "config_id").distinct()
