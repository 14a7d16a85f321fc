"""Text decoded with the wrong character encoding: find it and restore it (problem 1).

A smoothed character n-gram model is trained on all clean records; records with rare
letters that a recoding turns into far commoner ones are judged without their own kind
first, and leave the counts if they turn out damaged. Every chain
"encode again as the wrongly assumed codec, decode as the true one" that applies to a
text, or to a passage of it, gives a candidate; the likeliest candidate is accepted if
it beats the text as it stands by a margin, which is validated for chains through UTF-8
and for single-byte recodings apart, on all clean records, damaged on purpose in either way. What can't be encoded back (replacement characters, bare control codes)
is reported without a restored text.
"""

from __future__ import annotations

import functools
import math
import re
import unicodedata
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.words import mix
from lectern.session import spread, written

#: Single-byte codecs that texts are wrongly read or were written in.
CODECS = ("cp1252", "latin-1", "cp1254", "iso8859-9", "cp1250", "iso8859-2", "cp1251", "koi8_r", "cp437", "cp850", "cp857", "mac_roman", "iso8859-15")
#: Slots of each count table; bounds the model's size whatever the text.
SLOTS = 1 << 22
ORDER = 4
MU = 3.0
#: A character outside ASCII is worth a look if it is improbable with what follows it, or rare and not expected here.
SUSPICIOUS, RARE, EXPECTED = -11.0, -7.5, -2.5
#: What a chain must gain for each character that it changes, and what each further step of a chain costs.
GAIN, STEP = 1.5, 1.0
#: Margins are never smaller than this, through UTF-8 and for single-byte recodings.
LEAST_MARGIN, LEAST_RECODING = 3.0, 5.0
#: A suspect value must gain so much to leave the counts.
LEAVES = 5.0
#: A recoding makes a rare letter suspect if what it becomes is so many times as frequent. A suspect value is damaged
#: unless its spelling recurs while its restoration does not: then the first model loses more than this a letter.
FAR, AGAINST = 8.0, -10.0
#: Rounds until the damaged values left out of the counts stay the same, at most.
ROUNDS = 4

_RUN = re.compile(r"([^\x00-\x7f]{2,})")
_PASSAGE = re.compile(r"[^.!?\n]*(?:[.!?\n]+|$)")
_LOST = re.compile("[�\x80-\x84\x86-\x9f]")


@functools.cache
def _tables() -> tuple[dict[str, dict[str, int]], dict[str, list[str]]]:
    """Byte of each character above ASCII, and character of each byte, by codec; undefined bytes are control codes."""
    chars = {}
    for codec in CODECS:
        row = []
        for b in range(256):
            try:
                row.append(bytes([b]).decode(codec))
            except UnicodeDecodeError:
                row.append(chr(b))
        chars[codec] = row
    return {c: {ch: b for b, ch in enumerate(row) if b > 127} for c, row in chars.items()}, chars


def plausible(c: str) -> bool:
    """Whether a character alone may come out of a restoration: letters and signs that occur among Latin text."""
    o = ord(c)
    return 0xA0 <= o <= 0x24F or 0x370 <= o <= 0x52F or 0x1E00 <= o <= 0x1EFF or 0x2010 <= o <= 0x2122


def _foreign(a: str, b: str) -> bool:
    """Whether two characters may be neighbours in a word of another script."""
    if not (a.isalpha() and b.isalpha()):
        return False
    wide = unicodedata.east_asian_width(a) in "WF" and unicodedata.east_asian_width(b) in "WF"
    return wide or unicodedata.name(a, "a").split(" ")[0] == unicodedata.name(b, "b").split(" ")[0]


def _need(lead: int) -> int:
    return 2 if 0xC2 <= lead <= 0xDF else 3 if 0xE0 <= lead <= 0xEF else 0


def _undo_run(s: str, to_byte: dict[str, int], only: Callable[[str], bool]) -> str:
    """s with its sequences decoded, where only lets the character pass or it neighbours another one of its own script."""
    out: list[tuple[str, str]] = []  # what stands there, and what it encodes
    i = 0
    while i < len(s):
        lead = to_byte.get(s[i], 0)
        n = _need(lead)
        step, c = 1, s[i]
        if n and i + n <= len(s):
            rest = [to_byte.get(x, 0) for x in s[i + 1 : i + n]]
            if all(0x80 <= b <= 0xBF for b in rest):
                try:
                    step, c = n, bytes([lead, *rest]).decode()
                except UnicodeDecodeError:
                    pass
        if step > 1 and not only(c) and not c.isalpha():
            step, c = 1, s[i]
        out.append((s[i : i + step], c))
        i += step
    got = []
    for k, (old, new) in enumerate(out):
        if old == new or only(new):
            got.append(new)
        else:
            near = [out[j] for j in (k - 1, k + 1) if 0 <= j < len(out) and out[j][0] != out[j][1]]
            got.append(new if any(_foreign(new, x) for _, x in near) else old)
    return "".join(got)


class Undo:
    """Turns sequences of characters that are UTF-8 in a codec's bytes into what they encode; the rest stays.

    only tells whether a character may come out alone, so that what merely looks like UTF-8
    stays as it is; letters of any other script come out as words of two or more. Runs of characters outside ASCII recur, so their results are kept.
    """

    def __init__(self, only: Callable[[str], bool]) -> None:
        self.only, self.memo, self.some = only, {c: {} for c in CODECS}, {}

    def _run(self, s: str, codec: str) -> str:
        memo = self.memo[codec]
        got = memo.get(s)
        if got is None:
            if len(memo) > 200_000:
                memo.clear()
            got = memo[s] = _undo_run(s, _tables()[0][codec], self.only)
        return got

    def all(self, text: str) -> dict[str, str]:
        """What each codec makes of text, where it changes it; shorter runs than two characters hold no sequence."""
        parts = _RUN.split(text)  # every second one is a run
        runs = set(parts[1::2])
        out = {}
        for codec in CODECS if runs else ():
            new = {r: x for r in runs if (x := self._run(r, codec)) != r}
            if new:
                parts_ = list(parts)
                parts_[1::2] = [new.get(r, r) for r in parts[1::2]]
                out[codec] = "".join(parts_)
        return out

    def applies(self, text: str) -> bool:
        """Whether any codec's bytes of text hold such a sequence."""
        for m in _RUN.findall(text):
            got = self.some.get(m)
            if got is None:
                if len(self.some) > 500_000:
                    self.some.clear()
                got = self.some[m] = any(self._run(m, codec) != m for codec in CODECS)
            if got:
                return True
        return False


@functools.cache
def _recoding(read_as: str, written_in: str) -> dict[int, str]:
    """str.translate table that re-reads codec read_as' characters in codec written_in."""
    to_byte, chars = _tables()
    return {ord(c): chars[written_in][b] for c, b in to_byte[read_as].items() if chars[written_in][b] != c}


#: Bytes that some codecs don't define; readers drop them, which leaves the lead of a sequence alone.
_DROPPED = (0x81, 0x8D, 0x8F, 0x90, 0x9D)
_ALONE = re.compile("â€(?![\\x80-\\x9f‚-™Ž-žŒœŸƒˆ˜])|[ÃÄÅ](?=[^\\x80-\U0010ffff]|$)")


def refilled(text: str) -> dict[str, tuple]:
    """Texts in which leads of sequences that stand alone get one of the dropped bytes back."""
    out: dict[str, tuple] = {}
    if _ALONE.search(text):
        for b in _DROPPED:
            c = _ALONE.sub(lambda m, b=b: bytes([*(_tables()[0]["cp1252"][x] for x in m.group()), b]).decode("utf-8", "replace"), text)
            if c != text and "\ufffd" not in c:
                out.setdefault(c, (f"cp1252 without {b:02x}",))
    return out


def utf8_candidates(text: str, undo: Undo, may: Callable[[str], bool]) -> dict[str, tuple]:
    """Restored text by chain, for all chains of one to three steps through UTF-8.

    Between the steps stand characters of the wrongly read kind, which undo lets pass;
    may tells whether a character may stand in the end.
    """
    out: dict[str, tuple] = {}
    todo = [(text, ())]
    for c, chain in refilled(text).items():
        out[c] = chain
        todo.append((c, chain))
    for _ in range(3):
        nxt = []
        for t, chain in todo:
            for codec, c in undo.all(t).items():
                if c not in out:
                    out[c] = (*chain, codec)
                    nxt.append((c, out[c]))
        todo = nxt
    return {c: chain for c, chain in out.items() if c != text and _all_known(text, c, may)}


@functools.cache
def _between() -> frozenset[str]:
    return frozenset(c for codec in CODECS for c in _tables()[0][codec])


def _all_known(before: str, after: str, known: Callable[[str], bool]) -> bool:
    return all(known(c) for c in set(after) - set(before))


def recodings(high: frozenset[str], known: Callable[[str], bool]) -> list[tuple[dict, list[tuple]]]:
    """What single-byte recodings make of a set of characters outside ASCII: translation tables, each with its chains."""
    out: dict[tuple, list[tuple]] = {}
    order = sorted(high)
    for a in CODECS:
        if not high.issubset(_tables()[0][a]):  # a text read as a has no other characters
            continue
        for b in CODECS:
            if a != b:
                table = _recoding(a, b)
                image = tuple(table.get(ord(c), c) for c in order)
                if any(x != c for x, c in zip(image, order, strict=True)) and not any(_LOST.search(x) for x in image) and all(x in high or known(x) for x in image):
                    out.setdefault(image, []).append((a, b))
    return [({ord(c): x for c, x in zip(order, image, strict=True)}, chains) for image, chains in out.items()]


def is_clean(text: str, undo: Undo) -> bool:
    """Whether no trace of damage can be read off a text without a model."""
    return text.isascii() or not (_LOST.search(text) or undo.applies(text))


_MULT = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5], np.uint64)


def _slots_of(cp: np.ndarray) -> np.ndarray:
    """Table slots of single characters."""
    return (mix((cp + np.uint64(1)) * _MULT[0]) >> np.uint64(64 - SLOTS.bit_length() + 1)).astype(np.int64)


def _points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts, with padding before each, and each text's first character."""
    joined = "".join("\x02\x02\x02" + t for t in texts)
    cp = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    lens = np.array([len(t) for t in texts])
    return cp, np.concatenate(([0], np.cumsum(lens + 3)))[:-1] + 3


def _slots_at(cp: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
    """Table slots of the n-grams ending at the given places (orders 1 to ORDER)."""
    acc = np.zeros(len(at), np.uint64)
    out = []
    for k in range(ORDER):
        i = at - k
        acc = acc + (np.where(i >= 0, cp[np.maximum(i, 0)], np.uint64(2)) + np.uint64(k + 1)) * _MULT[k]
        out.append((mix(acc) >> np.uint64(64 - SLOTS.bit_length() + 1)).astype(np.int64))
    return out


def _slots(texts: list[str]) -> tuple[list[np.ndarray], np.ndarray]:
    """Table slots of the n-grams ending at each character, and code points."""
    cp, _ = _points(texts)
    return _slots_at(cp, np.arange(len(cp))), cp


class CharModel:
    """Interpolated character n-gram model with hashed counts."""

    def __init__(self, counts: list[np.ndarray]) -> None:
        self.counts = counts
        self.total = float(counts[0].sum(dtype=np.float64))
        self.seen: dict[str, bool] = {}
        self.doubt: dict[str, bool] = {}
        self.undo = Undo(lambda c: c in _between() or plausible(c) or self.known(c))
        self.tables: dict[frozenset, list] = {}
        self.suspects: dict[frozenset, bool] = {}

    def logs(self, texts: list[str], near_high: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """log P of each character in its context, with code points and starts (see _slots); near_high: only of characters outside ASCII and those they give context to, 0 elsewhere."""
        cp, starts = _points(texts)
        if not near_high:
            slots = _slots_at(cp, np.arange(len(cp)))
            return self._logs_of(slots, [np.concatenate(([s[0]], s[:-1])) for s in slots]), cp, starts
        wanted = np.zeros(len(cp) + ORDER, bool)
        high = np.flatnonzero(cp > 127)
        for k in range(-1, ORDER + 1):
            wanted[np.minimum(high + k, len(cp))] = True
        at = np.flatnonzero(wanted[: len(cp)])
        lp = np.zeros(len(cp))
        if len(at):
            # The place before each one, if wanted, comes before it; else nobody asks for its context.
            slots = _slots_at(cp, at)
            lp[at] = self._logs_of(slots, [np.concatenate((s[:1], s[:-1])) for s in slots])
            lp[at[np.diff(at, prepend=-9) != 1]] = 0.0
        return lp, cp, starts

    def _logs_of(self, here: list[np.ndarray], before: list[np.ndarray]) -> np.ndarray:
        """log P from the slots of the n-grams that end at characters, and of those that end before them."""
        p = (self.counts[0][here[0]] + 1e-6) / (self.total + 1.0)
        for k in range(1, ORDER):
            p = (self.counts[k][here[k]] + MU * p) / (self.counts[k - 1][before[k - 1]] + MU)
        return np.log(p)

    def known(self, c: str) -> bool:
        """Whether a character stands in clean records."""
        got = self.seen.get(c)
        if got is None:
            got = self.seen[c] = bool(self.counts[0][_slots_of(np.array([ord(c)], np.uint64))[0]] > 0)
        return got

    def may(self, c: str) -> bool:
        """Whether a character may come out of a restoration through UTF-8."""
        return plausible(c) or c.isalpha() or self.known(c)

    def recodings(self, high: frozenset[str]) -> list[tuple[dict, list[tuple]]]:
        """recodings of a set of characters, kept."""
        got = self.tables.get(high)
        if got is None:
            if len(self.tables) > 50_000:
                self.tables.clear()
            got = self.tables[high] = recodings(high, self.known)
        return got

    def doubtful(self, c: str) -> bool:
        """Whether another codec reads a character's byte as one that is several times as frequent."""
        got = self.doubt.get(c)
        if got is None:
            images = {_recoding(a, b).get(ord(c)) for a in CODECS for b in CODECS if a != b} - {None}
            n = [float(self.counts[0][_slots_of(np.array([ord(x)], np.uint64))[0]]) for x in (c, *images)]
            got = self.doubt[c] = max(n[1:], default=0.0) > 4 * n[0]
        return got

    def count(self, c: str) -> float:
        """Occurrences of a character."""
        return float(self.counts[0][_slots_of(np.array([ord(c)], np.uint64))[0]])

    def _rarer(self, c: str, x: str) -> bool:
        n = self.count(c)
        return c.isalpha() and x.isalpha() and c.isupper() == x.isupper() and np.log((n + 1e-6) / (self.total + 1.0)) < RARE and self.count(x) > FAR * n

    def suspect(self, text: str) -> bool:
        """Whether a recoding of a passage turns all letters that it changes, rare ones, into far commoner ones."""
        for part in _PASSAGE.findall(text):
            high = frozenset(c for c in part if c > "\x7f")
            got = self.suspects.get(high)
            if got is None:
                if len(self.suspects) > 50_000:
                    self.suspects.clear()
                changes = ([(chr(c), x) for c, x in t.items() if chr(c) != x] for t, _ in self.recodings(high)) if high else ()
                got = self.suspects[high] = any(d and all(self._rarer(c, x) for c, x in d) for d in changes)
            if got:
                return True
        return False

    def totals(self, texts: list[str], near_high: bool = False) -> np.ndarray:
        """log P of each text, or of its parts near characters outside ASCII; the rest is alike in texts that differ there only."""
        lp, cp, starts = self.logs(texts, near_high)
        lp = np.where(cp == 2, 0.0, lp)
        cum = np.concatenate(([0.0], np.cumsum(lp)))
        ends = np.append(starts[1:] - 3, len(lp))
        return cum[ends] - cum[starts]


def _packed(counts: np.ndarray) -> tuple[np.ndarray | None, np.ndarray]:
    """Count tables for a broadcast: the slots in use, or all of them (None) where that is smaller."""
    at = np.flatnonzero(counts)
    return (at.astype(np.int32), counts.ravel()[at]) if 2 * len(at) < counts.size else (None, counts)


def _model(packed: tuple[np.ndarray | None, np.ndarray]) -> CharModel:
    """The model of packed count tables."""
    at, values = packed
    if at is None:
        return CharModel(list(values))
    counts = np.zeros(ORDER * SLOTS, np.float32)
    counts[at] = values
    return CharModel(list(counts.reshape(ORDER, SLOTS)))


def _counted(rows: DataFrame) -> np.ndarray:
    """Counts over all clean records of rows.text; partial in every task, then summed by slot."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, seen = np.zeros((ORDER, SLOTS), np.uint32), Undo(plausible)
        for b in batches:
            texts = [t for t in b.column(0).to_pylist() if t and is_clean(t, seen)]
            for k in range(0, len(texts), 500):
                slots, cp = _slots(texts[k : k + 500])
                real = cp != 2
                for n in range(ORDER):
                    # Contexts that reach into the padding count too, so that first letters have one.
                    counts[n] += np.bincount(slots[n] if n else slots[n][real], minlength=SLOTS).astype(np.uint32)
        o, s = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(o.astype(np.int32)), pa.array(s.astype(np.int32)), pa.array(counts[o, s].astype(np.float64))], ["o", "s", "n"])

    got = rows.select("text").mapInArrow(run, "o int, s int, n double").groupBy("o", "s").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros((ORDER, SLOTS), np.float32)
    counts[got.column("o").to_numpy(), got.column("s").to_numpy()] = got.column("n").to_numpy()
    return counts


def train(rows: DataFrame) -> CharModel:
    """A model of all clean records of rows.text, without those that it shows to be damaged by a single-byte recoding.

    Damage that recurs makes itself likely. So suspect values are judged by what is left
    without all of them; those found damaged stay out, the others come back, and the
    suspect values are judged again until the same ones are out.
    """
    counts = _counted(rows)
    sc = rows.sparkSession.sparkContext
    base = sc.broadcast(_packed(counts))

    def suspects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, seen = _model(base.value), Undo(plausible)
        for b in batches:
            yield b.filter(pa.array([bool(t) and not t.isascii() and m.suspect(t) and is_clean(t, seen) for t in b.column(0).to_pylist()], pa.bool_()))

    doubted = written(rows.select("text").mapInArrow(suspects, "text string"), "suspect-texts")
    out, before = doubted, None
    for _ in range(ROUNDS):
        now = out.agg(F.count("*"), F.bit_xor(F.xxhash64("text"))).first()
        if now == before or not now[0]:
            break
        before = now
        left = sc.broadcast(_packed(np.maximum(counts - _counted(out), 0)))

        def judge(batches: Iterator[pa.RecordBatch], left=left) -> Iterator[pa.RecordBatch]:
            m, all_ = _model(left.value), _model(base.value)
            for b in batches:
                yield b.filter(pa.array([recoded(all_, m, t) for t in b.column(0).to_pylist()], pa.bool_()))

        out = written(doubted.mapInArrow(judge, "text string"), "recoded-texts")
        left.destroy()
    base.destroy()
    return CharModel(list(np.maximum(counts - _counted(out), 0)))


def _best(model: CharModel, text: str, candidates: dict[str, tuple]) -> tuple[float, str, tuple] | None:
    """Gain, text and chain of the likeliest candidate."""
    if not candidates:
        return None
    names = list(candidates)
    # Sequences become characters outside ASCII again, so texts differ near such characters only.
    t = model.totals([text, *names], True)
    gain = t[1:] - t[0] - STEP * np.array([len(candidates[n]) for n in names])
    k = int(np.argmax(gain))
    return float(gain[k]), names[k], candidates[names[k]]


def _best_recoding(model: CharModel, parts: list[str]) -> tuple[float, dict[int, str], tuple] | None:
    """Gain, restored passages and chain of the single-byte chain that gains most over all passages together."""
    total: dict[tuple, float] = {}
    new: dict[tuple, dict[int, str]] = {}
    for i, part in enumerate(parts):
        tables = model.recodings(frozenset(c for c in part if c > "\x7f"))
        if not tables:
            continue
        texts = [part.translate(t) for t, _ in tables]
        t = model.totals([part, *texts], True)
        for (_, chains), c, gain in zip(tables, texts, (t[1:] - t[0]).tolist(), strict=True):
            if gain > GAIN * sum(x != y for x, y in zip(part, c, strict=True)):
                for chain in chains:
                    total[chain] = total.get(chain, -STEP) + gain
                    new.setdefault(chain, {})[i] = c
    if not total:
        return None
    chain = max(total, key=lambda x: total[x])
    return total[chain], new[chain], chain


def recoded(first: CharModel, left: CharModel, text: str) -> bool:
    """Whether a suspect text is damaged by left, a model without such texts, and first, the model with them, isn't wholly against it."""
    parts = [p for p in _PASSAGE.findall(text) if not p.isascii()]
    got = _best_recoding(left, parts)
    if not got or got[0] <= LEAVES:
        return False
    old, new = "".join(parts[i] for i in got[1]), "".join(got[1].values())
    t = first.totals([x for i, c in got[1].items() for x in (parts[i], c)], True)
    return float((t[1::2] - t[::2]).sum()) > AGAINST * sum(x != y for x, y in zip(old, new, strict=True))


@dataclass(frozen=True)
class Margins:
    """What a candidate must gain, by kind of chain, the error rates on the validation records (clean ones changed, damaged ones missed), and their number."""

    utf8: float
    recoding: float
    rates: tuple[tuple[float, float], tuple[float, float]] = ((0.0, 0.0), (0.0, 0.0))
    records: int = 0


def scored(model: CharModel, text: str, suspicious: np.ndarray) -> tuple[tuple, tuple]:
    """(gain, restored text or None where something stays lost, chain) of the best chain through UTF-8, and of the best recoding; suspicious are the text's positions worth a look."""
    utf8 = recoding = (0.0, None, None)
    whole = lambda t: None if _LOST.search(t) else t
    if _ALONE.search(text) or model.undo.applies(text):
        got = _best(model, text, utf8_candidates(text, model.undo, model.may))
        if got:
            utf8 = max(0.0, got[0]), whole(got[1]), "utf-8 read as " + ", ".join(got[2])
    if len(suspicious):
        spans = [m.span() for m in _PASSAGE.finditer(text) if m.end() > m.start()]
        odd = [k for k, (a, b) in enumerate(spans) if ((suspicious >= a) & (suspicious < b)).any()]
        got = _best_recoding(model, [text[spans[k][0] : spans[k][1]] for k in odd])
        if got:
            fixed = {odd[i]: c for i, c in got[1].items()}
            recoding = max(0.0, got[0]), whole("".join(fixed.get(k, text[a:b]) for k, (a, b) in enumerate(spans))), f"{got[2][1]} read as {got[2][0]}"
    return utf8, recoding


def _look(model: CharModel, texts: list[str]) -> list[np.ndarray]:
    """Positions of improbable characters outside ASCII in each text.

    A recoding can gain no more than what the odd characters and those that they give
    context to now cost; texts in which that can't reach the least gain are left out.
    """
    lp, cp, starts = model.logs(texts, True)
    after = np.concatenate((lp[1:], [0.0]))
    high = np.flatnonzero(cp > 127)
    alone = np.full(len(cp), 0.0)
    alone[high] = np.log((model.counts[0][_slots_of(cp[high])] + 1e-6) / (model.total + 1.0))
    both = lp + after
    kinds, which = np.unique(cp[high], return_inverse=True)
    doubtful = np.zeros(len(cp), bool)
    doubtful[high] = np.array([model.doubtful(chr(c)) for c in kinds.tolist()], bool)[which] if len(kinds) else False
    odd = np.flatnonzero((cp > 127) & ((both < SUSPICIOUS) | (((alone < RARE) | doubtful) & (both < EXPECTED))))
    which = np.searchsorted(starts, odd, side="right") - 1
    cum = np.concatenate(([0.0], np.cumsum(np.where(cp == 2, 0.0, lp))))
    cost = cum[odd] - cum[np.minimum(odd + ORDER, len(lp))]
    enough = np.bincount(which, cost, minlength=len(texts)) > LEAST_RECODING
    keep = enough[which] if len(which) else np.zeros(0, bool)
    odd, which = odd[keep], which[keep]
    cuts = np.searchsorted(which, np.arange(len(texts) + 1))
    return [odd[cuts[i] : cuts[i + 1]] - starts[i] for i in range(len(texts))]


class _Misread(dict):
    """str.translate table that turns what is outside ASCII into its UTF-8 bytes, read in a codec."""

    def __init__(self, codec: str) -> None:
        self.chars = _tables()[1][codec]

    def __missing__(self, o: int) -> int | str:
        got = self[o] = o if o < 128 else "".join(self.chars[b] for b in chr(o).encode())
        return got


@functools.cache
def _misread(codec: str) -> _Misread:
    return _Misread(codec)


#: Single-byte recodings to damage records with: what they were written in, and what they are read as.
_PAIRS = [(b, a) for a in CODECS for b in CODECS if a != b]


def _applicable(high: frozenset[str], memo: dict[frozenset, list[int]]) -> list[int]:
    """The recodings of _PAIRS that change a set of characters without loss, kept."""
    got = memo.get(high)
    if got is None:
        if len(memo) > 50_000:
            memo.clear()
        got = memo[high] = []
        for k, (written_in, read_as) in enumerate(_PAIRS):
            if high.issubset(_tables()[0][written_in]):
                table = _recoding(written_in, read_as)
                image = [table.get(ord(c), c) for c in high]
                if any(x not in high for x in image) and not any(_LOST.search(x) for x in image):
                    got.append(k)
    return got


def _restoring(model: CharModel, texts: list[str], hashes: list[int], memo: dict[frozenset, list[int]]) -> list[tuple[float, float | None]]:
    """What restoring a copy of each clean text gains: one damaged by UTF-8 read as a single-byte codec, and one by a recoding (None where each loses something); its hash decides on the codecs."""
    bad = [t.translate(_misread(CODECS[h % len(CODECS)])) for t, h in zip(texts, hashes, strict=True)]
    for t, h in zip(texts, hashes, strict=True):
        fits = _applicable(frozenset(c for c in t if c > "\x7f"), memo)
        written_in, read_as = _PAIRS[fits[h // len(CODECS) % len(fits)]] if fits else (None, None)
        bad.append(t.translate(_recoding(written_in, read_as)) if fits else t)
    # The copies differ from the texts near characters outside ASCII only.
    good, utf8, single = np.split(model.totals([*texts, *bad], True), 3) if texts else [np.zeros(0)] * 3
    return [(g - u - STEP, g - s - STEP if b != t else None) for g, u, s, t, b in zip(good.tolist(), utf8.tolist(), single.tolist(), texts, bad[len(texts) :], strict=True)]


def _quantile(values: np.ndarray, counts: np.ndarray, q: float) -> float:
    """The quantile of all values, in order and each as often as counted, as np.quantile has it."""
    at = (counts.sum() - 1) * q
    low, high = (float(values[np.searchsorted(np.cumsum(counts), k, side="right")]) for k in (math.floor(at), math.ceil(at)))
    return low + (high - low) * (at - math.floor(at))


def _margin(kept: tuple[np.ndarray, np.ndarray], broken: tuple[np.ndarray, np.ndarray], least: float) -> tuple[float, tuple[float, float]]:
    """A margin between what clean records gain and what restoring damaged copies of them gains, and both error rates, from values with their numbers.

    A few percent of the records may be damaged in ways that only the model can tell.
    """
    if not len(broken[0]):
        return max(least, LEAVES), (0.0, 0.0)
    low, high = _quantile(*kept, 0.97), _quantile(*broken, 0.02)
    margin = max(least, min(low + 1.0, (low + high) / 2) if high > low else low + 1.0)
    return margin, (float(kept[1][kept[0] > margin].sum() / kept[1].sum()), float(broken[1][broken[0] <= margin].sum() / broken[1].sum()))


def validated_margins(scores: DataFrame) -> Margins:
    """Margins for both kinds of chains, and the error rates of each, from all clean records of scores.

    Gains count to the hundredth, so what is collected grows with their range only.
    """
    kinds = ("utf8_gain", "recoding_gain", "utf8_back", "recoding_back")
    cells = F.array(*[F.struct(F.lit(i).alias("kind"), F.round(c, 2).alias("value")) for i, c in enumerate(kinds)])
    got = scores.filter("clean").select(F.inline(cells)).filter("value is not null").groupBy("kind", "value").agg(F.count("*").alias("n")).orderBy("kind", "value").toArrow()
    kind, value, n = (got.column(c).to_numpy() for c in ("kind", "value", "n"))
    kept, single, *broken = [(value[kind == i], n[kind == i]) for i in range(len(kinds))]
    (u, ru), (r, rr) = _margin(kept, broken[0], LEAST_MARGIN), _margin(single, broken[1], LEAST_RECODING)
    return Margins(u, r, (ru, rr), int(kept[1].sum()))


def field_texts(books: DataFrame, key: str = "work_key", fields: tuple[str, ...] = ("title", "description")) -> DataFrame:
    """key, field_name, text of all distinct non-empty values."""
    cells = F.array(*[F.struct(F.lit(f).alias("field_name"), F.col(f).alias("text")) for f in fields])
    return books.filter(F.col(key).isNotNull()).select(key, F.inline(cells)).filter(F.length("text") > 0).distinct()


def scores_of(rows: DataFrame, model: CharModel, key: str) -> DataFrame:
    """Of all values outside ASCII: whether they are clean, the best chain of each kind with its gain, and for clean ones what restoring damaged copies gains.

    key, field_name and text stand only where a gain may pass a margin or something is lost.
    """
    shared = rows.sparkSession.sparkContext.broadcast(_packed(np.stack(model.counts)))
    named = [(key, pa.string()), ("field_name", pa.string()), ("text", pa.string()), ("lost", pa.bool_()), ("clean", pa.bool_())]
    for kind in ("utf8", "recoding"):
        named += [(f"{kind}_gain", pa.float64()), (f"{kind}_text", pa.string()), (f"{kind}_chain", pa.string()), (f"{kind}_back", pa.float64())]
    schema = pa.schema(named)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, undo, memo = _model(shared.value), Undo(plausible), {}
        for whole in batches:
            # What is ASCII throughout holds no wrongly decoded characters.
            whole = whole.filter(pa.array([not t.isascii() for t in whole.column(2).to_pylist()], pa.bool_()))
            for at in range(0, whole.num_rows, 500):
                keys, fields, texts, hashes = (c.to_pylist() for c in whole.slice(at, 500).columns)
                clean = [is_clean(t, undo) for t in texts]
                back = iter(_restoring(m, [t for t, c in zip(texts, clean, strict=True) if c], [h for h, c in zip(hashes, clean, strict=True) if c], memo))
                out = []
                for k, f, t, c, look in zip(keys, fields, texts, clean, _look(m, texts), strict=True):
                    lost, (utf8, recoding) = bool(_LOST.search(t)), scored(m, t, look)
                    u, r = next(back) if c else (None, None)
                    may_u, may_r = utf8[0] > LEAST_MARGIN, recoding[0] > LEAST_RECODING
                    named_ = (k, f, t) if lost or may_u or may_r else (None, None, None)
                    none = (None, None)
                    out.append((*named_, lost, c, utf8[0], *(utf8[1:] if may_u else none), u, recoding[0], *(recoding[1:] if may_r else none), r))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    types = {pa.string(): "string", pa.bool_(): "boolean", pa.float64(): "double"}
    return rows.select(key, "field_name", "text", F.expr(f"pmod(xxhash64(text), {len(CODECS) * len(_PAIRS) * 1000})").alias("h")).mapInArrow(run, ", ".join(f"{f.name} {types[f.type]}" for f in schema))


def damaged(books: DataFrame, key: str = "work_key", fields: tuple[str, ...] = ("title", "description")) -> DataFrame:
    """key, field_name, text, restored (null where the original can't be known), chain of all damaged values.

    Nulls and empty strings are no cases; repeated values count once; whole texts are
    read; an empty table gives an empty result; other columns are ignored.
    """
    rows = spread(written(field_texts(books, key, fields), "field-texts"))
    scores = written(scores_of(rows, train(rows), key), "text-scores")
    margins = validated_margins(scores)
    utf8, recoding = F.col("utf8_gain") > margins.utf8, F.col("recoding_gain") > margins.recoding
    pick = lambda what: F.when(utf8, F.col(f"utf8_{what}")).when(recoding, F.col(f"recoding_{what}"))
    return scores.filter(utf8 | recoding | F.col("lost")).select(key, "field_name", "text", pick("text").alias("restored"), pick("chain").alias("chain"))
