"""Reading one scanned text: glyph edits, broken words, page furniture and reflow.

What a text needs to know about the collection (how often a word was seen, what a misread word should say, which lines are running
headers) comes through a Reader; `asked` lists everything that `repair` may ask it about a text.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping
from typing import NamedTuple

import numpy as np

#: Glyph edits tried in a word; longer runs than LONGEST characters are no words.
EDITS, LONGEST = 2, 40
#: Words on each side that tell the readings of a word apart.
WINDOW = 2
#: A word seen so often inside lines is one.
SEEN = 2

# What is printed -> what scanners read. Symbols first: they never stand inside a word otherwise.
SYMBOLS = {"0": "o", "1": "li", "5": "s", "6": "b", "9": "g", "@": "a", "†": "t", "!": "il", "|": "li", "$": "s"}
GLYPHS = {
    "é": ("e",), "c": ("e",), "e": ("c",), "f": ("t",), "t": ("f",), "b": ("h",), "h": ("b", "li"), "v": ("y",), "i": ("l",), "l": ("i",), "n": ("ri",), "m": ("rn", "in"), "d": ("cl",),
    "cl": ("d",), "ii": ("u",), "rn": ("m",), "vv": ("w",), "li": ("h",), "ri": ("n",), "in": ("m",),
}
# Marks that scanners leave where a word was broken.
MARKS = "-‐–¬=­"

_TOKEN = re.compile(r"[\w@†!|$]+(?:[-'’][\w@†!|$]+)*")
_WORD = re.compile(r"\w+(?:[-'’]\w+)*")
_LINE_OR_TOKEN = re.compile(r"\n|[\w@†!|$]+(?:[-'’][\w@†!|$]+)*")
_SYMBOL = re.compile(r"[@†!|$]")
_LETTER = re.compile(r"[^\W\d_]")
_ENDS = re.compile(r"[.!?…:;][\"'”’»)\]]*$")
_NUM = r"(?:[0-9OoIl|!]{1,4}|[ivxlcIVXLC]{1,8})"
_PAGE = re.compile(rf"^(?:[-–—]\s*{_NUM}\s*[-–—]|\[\s*{_NUM}\s*\]|p[.,]\s*{_NUM}|[PpF][a@o][g9q][eécE]\s+\S{{1,5}}(?:\s+\S{{2}}\s+\S{{1,5}})?|[0-9]{{1,4}}|[ivxl]{{1,8}}|[IVXL]{{1,8}})$")
_BARE = re.compile(r"^(?:[0-9]{1,4}|[ivxl]{1,8}|[IVXL]{1,8})$")
_PARTS = re.compile(r"\s*(?:\||\t+|\.{3,}|\s{3,})\s*")
_OTHER = re.compile(r"^\s*(?:#|[*•‣]\s|-\s+\S|\||```|~~~|\d{1,3}(?:\.\d+)*[.)]\s+[^\W\d_]+(?:\s+\w+)?\s*$)")
_LEFT = re.compile(rf"([\w@†!|$]+(?:[-'’][\w@†!|$]+)*)([{MARKS}]?)$")
_SETTING = re.compile(r"^\w+:\s*\S+(?:\s\S+){0,2}$")


class Reading(NamedTuple):
    """What a misread word should say; vector: the right word's, where there are several readings to choose from."""

    word: str
    vector: np.ndarray | None = None


def edits(word: str, depth: int = EDITS) -> dict[str, bool]:
    """Strings a few glyph edits away; True: only symbols had to be replaced, of which none may be left."""
    out: dict[str, bool] = {}
    if len(word) < 2 or len(word) > LONGEST or not _LETTER.search(word):
        return out
    front = {word: True}
    for _ in range(depth):
        new: dict[str, bool] = {}
        for w, clean in front.items():
            symbols = [i for i, c in enumerate(w) if c in SYMBOLS]
            for i in symbols[:1] or range(len(w)):
                for n in (1, 2):
                    part = w[i : i + n]
                    for to in SYMBOLS.get(part, ()) if symbols else GLYPHS.get(part, ()):
                        new.setdefault(w[:i] + to + w[i + n :], clean and bool(symbols))
        for w, clean in new.items():
            if w != word:
                out[w] = out.get(w, False) or clean
        front = new
        if len(word) < 6 and not any(c in SYMBOLS for w in front for c in w):
            break
    return out


class Reader:
    """What the collection says about the words of a text.

    common, told: sightings inside lines, and readings of misread words, among the words known to all texts; counts, readings: of this text's other words.
    running: whether a line in the form of a header is one. places: vectors of (offset, neighbour). fine: common tokens found to be no misreadings, kept between texts. lined: whether some lines may be furniture or end within a word.
    """

    def __init__(self, common: Mapping[str, int], told: Mapping[str, list[Reading]], places: Mapping[tuple[int, str], np.ndarray] | None = None) -> None:
        self.common, self.told, self.places, self.fine = common, told, places or {}, set()
        self.of(())

    def of(self, facts: Iterable[Mapping]) -> Reader:
        """Set to a text's facts: word, n, readings (right, vector); before a header's form stands a line feed. A line feed alone: lines matter."""
        self.counts, self.readings, self.running, self.lined = {}, {}, {}, False
        for f in facts:
            word, readings = f["word"], f["readings"]
            if word == "\n":
                self.lined = True
            elif word[0] == "\n":
                self.running[word[1:]] = True
            else:
                self.counts[word] = f["n"]
                if readings is not None and len(readings):
                    self.readings[word] = [Reading(r["right"], None if r["vector"] is None else np.asarray(r["vector"], np.float32)) for r in readings]
        return self

    def seen(self, word: str) -> int:
        return self.common.get(word) or self.counts.get(word, 0)

    def suits(self, vector: np.ndarray, near: list[tuple[int, str]]) -> float:
        """How much likelier than by chance the neighbours are beside the word of that vector (nats)."""
        return float(sum(vector @ self.places[x] for x in near if x in self.places))

    def meant(self, token: str, near: list[tuple[int, str]]) -> str | None:
        """What a misread token should say, in lower case; None when it isn't a misreading. near: offset and word of its neighbours."""
        low = token.lower()
        found = self.told.get(low) or self.readings.get(low)
        if not found:
            if "-" not in low or self.seen(low) >= SEEN:
                return None
            parts = low.split("-")
            told = [self.meant(p, []) if p and self.seen(p) < SEEN else None for p in parts]
            return "-".join(t or p for t, p in zip(told, parts, strict=True)) if any(told) else None
        if len(found) == 1:
            return found[0].word
        return max(found, key=lambda r: (self.suits(r.vector, near) if r.vector is not None else 0.0, self.seen(r.word), r.word)).word

    def could(self, token: str) -> bool:
        plain = token.rstrip("!|")
        return bool(self.meant(token, []) or (plain != token and self.meant(plain, [])))

    def suspects(self, text: str) -> bool:
        """Whether any token of the text could be a misreading at all."""
        for chunk in set(text.split()) - self.fine:
            tokens = tokens_of(chunk)
            if any(self.could(t) for t in tokens if len(t) <= LONGEST and not t.isdigit()):
                return True
            if len(self.fine) < 400_000 and all(t in self.common or t.isdigit() for t in tokens):
                self.fine.add(chunk)
        return False

    def joined(self, left: str, mark: str, right: str) -> str | None:
        """The word that was broken into left and right, or None when they are two words or a compound with its own hyphen."""
        whole = (left + right).lower()
        count = self.seen(whole)
        compound = self.seen(f"{left}-{right}".lower())
        if mark:
            if compound >= SEEN and compound >= count:
                return None
            if count >= SEEN or self.meant(whole, []):
                return whole
            if mark in "-‐":
                return None if compound or (self._word(left) and self._word(right)) or self.meant(f"{left}-{right}".lower(), []) else whole
            return whole
        if self._word(left) and self._word(right):
            return None
        if count >= SEEN and count > 2 * min(self.seen(left.lower()), self.seen(right.lower())):
            return whole
        if min(len(left), len(right)) >= 2 and not self._word(left) and not self._word(right) and not self.meant(left, []) and not self.meant(right, []) and self.meant(whole, []):
            return whole
        return None

    def _word(self, w: str) -> bool:
        return self.seen(w.lower()) >= SEEN or w.isdigit()


# Letters that are read for one another become one, then pairs of them that are read for one letter.
_FOLDS = str.maketrans({"é": "e", "c": "e", "t": "f", "†": "f", "b": "h", "6": "h", "v": "y", "l": "i", "1": "i", "!": "i", "|": "i", "#": "?", "0": "o", "5": "s", "$": "s", "9": "g", "@": "a"})
_PAIRS = {"rn": "m", "in": "m", "ri": "n", "ei": "d", "yy": "w", "ii": "u"}
_PAIR = re.compile("|".join(_PAIRS))
_SPLIT = re.compile(r"\s+[/–—|-]\s+|\s{2,}|\t|\s(?=\?\d)|(?<=\?\d)\s")


def form_of(line: str) -> str:
    """A header line's form: numbers are one, letters are folded by how they are misread."""
    words = ["?0" if w.isdigit() else _PAIR.sub(lambda m: _PAIRS[m[0]], w.translate(_FOLDS)) for w in re.split(r"(\s+)", line.strip().lower())]
    return "".join(words)


def parts_of(form: str) -> list[str]:
    """The parts of a form that are set off by a stroke, a gap or a number."""
    return [p for p in (x.strip() for x in _SPLIT.split(form)) if p and p != "?0"]


def _cased(like: str, word: str) -> str:
    letters = [c for c in like if c.isalpha()]
    if len(letters) > 1 and all(c.isupper() for c in letters):
        return word.upper()
    return word[:1].upper() + word[1:] if like[:1].isupper() else word


def _titled(line: str) -> bool:
    """A line in the form of a running header: upper case, capitalised words, or parts set off by a slash or dash."""
    words = line.split()
    if not words or len(words) > 9 or len(line) > 70 or line[-1] in ".,;:?" or not _LETTER.search(line):
        return False
    letters = [c for c in line if c.isalpha()]
    real = [w for w in words if _LETTER.search(w)]
    if sum(c.isupper() for c in letters) >= 0.85 * len(letters) and len(words) > 1:
        return True
    big = lambda w: not w[:1].islower()
    if re.search(r"\S\s+[/–—]\s+\S", line) and big(words[0]) and big(re.split(r"\s[/–—]\s", line)[-1].strip()):
        return True
    return len(words) > 1 and all(big(w) for w in words) and len(real) >= 1 and (len(real) > 1 or any(w.isdigit() for w in words))


def outline(text: str) -> tuple[list[str], list[str]]:
    """(kinds, lines) by form alone: blank, text, other (headings, lists, tables, settings), page, page?, header? or both."""
    lines = text.split("\n")
    kinds = []
    fenced = False
    for line in lines:
        s = line.strip()
        # Most lines: too long for furniture, or going on in lower case.
        if not fenced and (len(s) > 70 or (len(s) > 20 and s[0].islower())) and s[0].isalpha() and ":" not in s and "|" not in s and "\t" not in s and "   " not in s and "...." not in s:
            kinds.append("text")
            continue
        if s.startswith(("```", "~~~")):
            fenced = not fenced
            kinds.append("other")
            continue
        parts = [p for p in _PARTS.split(s) if p] if len(s) <= 100 and ("|" in s or "\t" in s or "   " in s or "..." in s) else [s]
        if not s:
            kinds.append("blank")
        elif fenced:
            kinds.append("other")
        elif _PAGE.match(s):
            kinds.append("page?" if _BARE.match(s) else "page")
        elif len(parts) == 2 and sum(bool(_PAGE.match(p)) for p in parts) == 1 and _titled(next(p for p in parts if not _PAGE.match(p))):
            kinds.append("both")
        elif _OTHER.match(s):
            kinds.append("other")
        elif _titled(s):
            kinds.append("header?")
        elif len(s.split()) == 1 and not _ENDS.search(s) and s[:1].isupper() and s[-1] not in MARKS:
            kinds.append("other")
        elif _SETTING.match(s) and not _ENDS.search(s) and s.islower():
            kinds.append("other")
        else:
            kinds.append("text")
    return kinds, lines


_MAYBE = frozenset(("page?", "header?", "page", "both"))


def _groups(kinds: list[str]) -> list[tuple[list[int], bool]]:
    """Runs of lines in the form of furniture, blank lines apart, and whether they stand where furniture does: behind text and before
    text or the end, with one bare number at most; more are a column's."""
    solid = [i for i, k in enumerate(kinds) if k != "blank"]
    out = []
    n = 0
    while n < len(solid):
        end = n
        while end < len(solid) and kinds[solid[end]] in _MAYBE:
            end += 1
        group = [solid[m] for m in range(n, end)]
        if group:
            ours = n > 0 and kinds[solid[n - 1]] == "text" and (end == len(solid) or kinds[solid[end]] in ("text", "other")) and sum(kinds[i] == "page?" for i in group) < 2
            out.append((group, ours))
        n = max(end, n + 1)
    return out


def _runs(form: str, running: Mapping[str, bool]) -> bool:
    """Whether a form repeats as a whole, or half of it is in parts that do."""
    if running.get(form):
        return True
    parts = parts_of(form)
    return parts != [form] and 2 * sum(len(p) for p in parts if running.get(p)) >= sum(map(len, parts)) > 0


def classify(text: str, running: Mapping[str, bool]) -> list[tuple[str, str]]:
    """(kind, line) for each line: blank, text, other, page, header or both. A line in the form of a header is one where its form
    repeats between other lines of the collection, or where it stands beside a page number."""
    kinds, lines = outline(text)
    for group, ours in _groups(kinds) if not _MAYBE.isdisjoint(kinds) else ():
        paged = any(kinds[i] in ("page", "both") for i in group)
        for i in group:
            if kinds[i] == "page?":
                kinds[i] = "page" if ours else "other"
            elif kinds[i] == "header?":
                if ours and (paged or _runs(form_of(lines[i]), running)):
                    kinds[i] = "header"
                else:
                    kinds[i] = "text" if lines[i].strip()[-1:] in MARKS or kinds[i + 1 : i + 2] == ["text"] else "other"
    return list(zip(kinds, lines, strict=True))


def header_forms(kinds: list[str], lines: list[str]) -> list[tuple[str, str]]:
    """(form, surroundings) of the lines that may be running headers, and of their parts. Lines with the same neighbours are copies."""
    out = []
    for group, ours in _groups(kinds) if not _MAYBE.isdisjoint(kinds) else ():
        if ours:
            after = next((lines[i] for i in range(group[-1] + 1, len(lines)) if kinds[i] != "blank"), "")
            before = next(lines[i] for i in range(group[0] - 1, -1, -1) if kinds[i] != "blank")
            around = " ".join(before.split()[-2:] + after.split()[:2]).lower()
            for i in group:
                if kinds[i] in ("header?", "both"):
                    line = lines[i].strip() if kinds[i] == "header?" else next(p for p in _PARTS.split(lines[i].strip()) if p and not _PAGE.match(p))
                    form = form_of(line)
                    parts = parts_of(form)
                    out += [(f, around) for f in {form, *parts}]
    return out


def _breaks(here: str, there: str) -> tuple[re.Match, re.Match] | None:
    """What may be the halves of a word broken between two lines: (left, mark) at the end of one and the token at the start of the next."""
    last, first = here[here.rfind(" ") + 1 :], there.split(" ", 1)[0]
    if not last or last[-1] in ".,;:?!)" or not first:
        return None
    left, right = _LEFT.search(here), _TOKEN.match(there)
    if left and right and _LETTER.search(left[1]) and (left[2] or there[:1].islower() or there[:1] in SYMBOLS):
        return left, right
    return None


def tokens_of(text: str) -> list[str]:
    """Tokens in lower case, with line feeds between those of different lines."""
    return _LINE_OR_TOKEN.findall(text.lower())


def word_of(token: str) -> str | None:
    """The word that a token is, symbols around it left out; None when symbols stand inside it or it is too long for a word."""
    if not _SYMBOL.search(token):
        return token if len(token) <= LONGEST else None
    token = token.strip("@†!|$-'’")
    return token if token and len(token) <= LONGEST and not _SYMBOL.search(token) else None


def asked(tokens: set[str], kinds: list[str], lines: list[str], lexicon: Mapping[str, int]) -> set[str]:
    """Words outside the lexicon whose sightings and readings `repair` may ask for. tokens: the text's; kinds, lines: its outline.

    A line feed among them says that some lines may be furniture or end within a word.
    """
    out = {t for t in tokens if t not in lexicon} - {"\n"}
    lined = not _MAYBE.isdisjoint(kinds)
    for i, kind in enumerate(kinds[:-1]):
        if kind in ("text", "header?"):
            # Furniture and blank lines may fall out between the halves.
            for j in range(i + 1, len(kinds)):
                if kinds[j] in ("text", "header?"):
                    here, there = lines[i].rstrip(), lines[j].lstrip()
                    # Two words, as for most line ends.
                    if lexicon.get(here[here.rfind(" ") + 1 :].lower(), 0) >= SEEN and lexicon.get(there.split(" ", 1)[0].rstrip(".,;:?!)").lower(), 0) >= SEEN:
                        pass
                    elif halves := _breaks(here, there):
                        lined = True
                        left, right = halves[0][1].lower(), halves[1][0].lower()
                        out |= {left, right, left + right, f"{left}-{right}"}
                        if rest := re.match(r"\S*", there[halves[1].end() :])[0]:
                            out |= {t.lower() for t in _TOKEN.findall(left + right + rest)}
                        if "-" in left or "-" in right:
                            head, tail = right.split("-")[0], left.rsplit("-", 1)[-1]
                            out |= {left + head, f"{left}-{head}", tail + right, f"{tail}-{right}", head, tail}
                if kinds[j] != "blank" and kinds[j] not in _MAYBE:
                    break
    for t in list(out):
        if t[-1:] in "!|":
            out.add(t.rstrip("!|"))
        if "-" in t:
            out.update(t.split("-"))
    return {t for t in out if t and t not in lexicon and len(t) <= 2 * LONGEST and not t.isdigit()} | ({"\n"} if lined else set())


def repair(text: str, reader: Reader) -> tuple[set[str], str]:
    """The kinds of noise found, and the text repaired and reflowed; a text without noise comes back as it is."""
    noise: set[str] = set()
    if not reader.lined and not reader.suspects(text):
        return noise, text
    rows = classify(text, reader.running)
    kept: list[tuple[str, str]] = []
    for kind, line in rows:
        if kind in ("page", "header", "both"):
            noise |= {"page_no"} if kind == "page" else {"header"} if kind == "header" else {"page_no", "header"}
            kept.append(("gone", ""))
        else:
            kept.append((kind, line))
    # Blank lines around furniture go with it when the text runs on across them.
    lines: list[tuple[str, str]] = [] if noise else kept
    n = 0 if noise else len(kept)
    while n < len(kept):
        end = n
        while end < len(kept) and kept[end][0] in ("gone", "blank"):
            end += 1
        if end == n:
            lines.append(kept[n])
            n += 1
            continue
        if any(k == "gone" for k, _ in kept[n:end]):
            runs_on = lines and lines[-1][0] == "text" and end < len(kept) and kept[end][0] == "text" and (not _ENDS.search(lines[-1][1].strip()) or not any(k == "blank" for k, _ in kept[n:end]))
            if not runs_on and any(k == "blank" for k, _ in kept[n:end]):
                lines.append(("blank", ""))
        else:
            lines += kept[n:end]
        n = end
    # Words broken over a line end.
    for n in range(len(lines) - 1):
        if lines[n][0] == "text" == lines[n + 1][0]:
            here, there = lines[n][1].rstrip(), lines[n + 1][1].lstrip()
            last, first = here[here.rfind(" ") + 1 :], there.split(" ", 1)[0]
            if reader._word(last) and reader._word(first.rstrip(".,;:?!)")):
                continue
            if halves := _breaks(here, there):
                left, right = halves
                whole = reader.joined(left[1], left[2], right[0])
                known = reader.seen(f"{left[1]}-{right[0]}".lower()) >= SEEN
                if whole is None and not known and right[0].count("-") and (head := right[0].split("-")[0]) and reader.joined(left[1], left[2], head):
                    whole = (left[1] + right[0]).lower()
                if whole is None and not known and left[1].count("-") and reader.joined(left[1].rsplit("-", 1)[1], left[2], right[0]):
                    whole = (left[1] + right[0]).lower()
                if whole:
                    noise.add("hyphen")
                    lines[n] = ("text", here[: left.start()] + left[1] + right[0] + re.match(r"\S*", there[right.end() :])[0])
                    lines[n + 1] = ("text", there[right.end() :][len(re.match(r"\S*", there[right.end() :])[0]) :].lstrip())
    # Misread words.
    fixed: list[tuple[str, str]] = []
    suspect = reader.suspects("\n".join(line for _, line in lines))
    if not noise and not suspect:
        return noise, text
    for n, (kind, line) in enumerate(lines):
        if not suspect:
            fixed = lines
            break
        if kind == "other" and not re.match(r"^\s*(?:[*•‣-]|#|\d+[.)])\s", line):
            fixed.append((kind, line))
            continue
        found = list(_TOKEN.finditer(line))
        words = [m[0].lower() for m in found]
        out, at = [], 0
        for k, m in enumerate(found):
            token = m[0].rstrip("!|") if reader.seen(m[0].rstrip("!|").lower()) else m[0]
            if len(token) > LONGEST or token.isdigit():
                continue
            # Parts of a compound on two lines are no words by themselves.
            if (k == len(found) - 1 and line[m.end() : m.end() + 1] in tuple(MARKS)) or (k == 0 and n and re.search(rf"\w[{MARKS}]$", lines[n - 1][1].rstrip())):
                continue
            meant = reader.meant(token, [(j - k, words[j]) for j in range(max(0, k - WINDOW), min(len(words), k + 1 + WINDOW)) if j != k])
            if meant and meant != token.lower():
                noise.add("glyph")
                out += [line[at : m.start()], _cased(token, meant)]
                at = m.start() + len(token)
        fixed.append((kind, "".join(out) + line[at:]))
    if not noise:
        return noise, text
    blocks: list[str] = []
    before = ""
    for kind, line in fixed:
        if kind == "text" and before == "text":
            if line.strip():
                blocks[-1] = (blocks[-1].rstrip() + " " + line.strip()).strip()
        else:
            blocks.append(line)
        before = kind
    return noise, "\n".join(blocks).strip("\n")


