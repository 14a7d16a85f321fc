"""Personal information in free text: find it, and replace it by typed placeholders (problem 9).

Regular expressions propose spans, checksums and nearby context words raise or lower
the score of each, and overlapping spans are settled by score. Names are scored by
given names and contexts that are learned from all texts beforehand (namemodel). Every
text is then processed whole and alone.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.namemodel import CLOSINGS, LOWER_WORD, NAME_WORD, TITLES, UP, NameModel, contexts, folded, learned
from lectern.session import spread

ACCEPT = 0.6
#: Characters before a span in which context words count, and after it.
BEFORE, AFTER = 48, 30

_LABEL = r"[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?"
_LOCAL = r"(?<![\w.+-])\w(?:[\w.+-]*\w)?"
_DOT = r"(?:\.|\s?[(\[{]\s?(?:dot|punkt|nokta|point)\s?[)\]}]\s?|\s(?:dot)\s)"
_AT_SIGN = r"(?:[@＠]|[(\[{]\s?at\s?[)\]}])"
_AT = rf"\s?{_AT_SIGN}\s?"
_EMAILS = [
    re.compile(rf"{_LOCAL}{_AT}{_LABEL}(?:{_DOT}{_LABEL})+"),
    re.compile(rf"{_LOCAL}\sat\s{_LABEL}(?:(?:\sdot\s|\s?\(dot\)\s?){_LABEL})+", re.I),
]

#: Part of every address of each kind, so that texts without it can be left out.
_EMAIL_HINTS = [re.compile(_AT_SIGN), re.compile(r"\sat\s", re.I)]

_NOT_BEFORE, _NOT_AFTER = r"(?<![\w+/.,:-])(?<!\d )(?<!\()", r"(?![\w/]|[-.,:]\d)"
_PHONES = [
    r"(?<!\w)\+\d{1,3}(?:[ .-]?\(0\))?(?:[ .-]?\d{1,5}){2,6}",
    r"(?<!\w)\+\d{1,3}[ .-]?\(\d{1,4}\)(?:[ .-]?\d{2,5}){2,4}",
    r"(?<![\w+/.,:-])00\d{2}(?:[ .-]?\(0\))?(?:[ .-]?\d{2,5}){2,5}",
    r"(?<!\w)\(\d{2,5}\)(?:[ .-]?\d{2,4}){2,4}",
    rf"{_NOT_BEFORE}\d-\d{{3}}-\d{{3}}-\d{{4}}",
    rf"{_NOT_BEFORE}\d{{3}}[.-]\d{{3}}[.-]\d{{4}}",
    rf"{_NOT_BEFORE}0\d(?:[ .]\d\d){{4}}",
    rf"{_NOT_BEFORE}0\d{{2}} \d{{4}} \d{{4}}",
    rf"{_NOT_BEFORE}0\d{{2,3}} \d{{5}} ?\d{{2,3}}",
    rf"{_NOT_BEFORE}0\d{{3}} \d{{3}} \d\d \d\d",
    rf"{_NOT_BEFORE}0 \d{{3}}[- ]\d{{3}}[- ]\d\d[- ]\d\d",
]
_PHONE = [re.compile(p + _NOT_AFTER) for p in _PHONES]
_PHONE_WEAK = re.compile(rf"{_NOT_BEFORE}\d(?:[ .-]?\d){{6,13}}{_NOT_AFTER}")
#: Context before a number ends at the number before it.
_LAST_PART = re.compile(r"[^\d\n]*$")
#: Phone and id numbers have five digits at least.
_DIGITS = re.compile(r"\d(?:\D*\d){4}")
_PHONE_CUE = re.compile(r"(?i)\b(?:tel|tél|téléphone|telefon\w*|phone|mobile?|cep|fax|call|text|appelez|joindre|rufen|anrufen|ruf|akşam|arayın|numarasından|unter|whatsapp|sms)\b")

_SEP = r"[ .-]?"
_IDS = [
    rf"(?<!\w)[A-Z]{{2}}{_SEP}\d\d{_SEP}\d\d{_SEP}\d\d{_SEP}[A-D](?!\w)",
    rf"(?<![\w.,/-])[12]{_SEP}\d\d{_SEP}\d\d{_SEP}\d[\dAB]{_SEP}\d{{3}}{_SEP}\d{{3}}(?:{_SEP}\d\d)?(?![\w/])",
    rf"(?<![\w.,/-])\d{{3}}{_SEP}\d{{3}}{_SEP}\d{{3}}{_SEP}\d\d(?![\w/])",
    rf"(?<![\w.,/-])\d{{3}}{_SEP}\d\d{_SEP}\d{{4}}(?![\w/])",
    r"(?<!\w)[A-Z]\d\d[A-Z]\d\d[A-Z]\d\d\d?(?!\w)",
    r"(?<!\w)[CFGHJKLMNPRTVWXYZ][CFGHJKLMNPRTVWXYZ0-9]{8}\d?(?!\w)",
    r"(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?!\w)",
    r"(?<![\w.,/-])\d{4}(?:[ -]?\d{4}){3}(?![\w/])",
]
_ID = [re.compile(p) for p in _IDS]
_ID_CUE = re.compile(
    r"(?i)(?:identity (?:number|card)|insurance number|national id|social security|\bssn\b|\bnino?\b|passport (?:no|number)|tckn|t\.?c\.? ?kimlik|kimlik (?:no|numara)"
    r"|ausweis|sozialversicherung|steuer-?id|sécurité sociale|d[’']identité|numéro de sécu|\biban\b|card number)"
)
_NO_CUE = re.compile(r"(?i)\b(?:isbn|issn|ref|record no|order|batch|printed|shelf|price|preis|prix|fiyat|pp|vol|series no|bulletin|note)\b[^\n]{0,14}$")

_PLACE = rf"(?:\d{{4,5}} )?{NAME_WORD}"
_POST = r"(?: [A-Z]{1,2}\d{1,2}[A-Z]? \d[A-Z]{2})"
_UNIT = r"(?:, (?:Flat|Apt|Apartment|Suite|Unit)\.? ?\w+)"
_STREET = r"(?:Street|St\.?|Road|Rd\.?|Lane|Ln\.?|Avenue|Ave\.?|Boulevard|Blvd\.?|Drive|Court|Square|Terrace|Way|Close|Crescent)(?!\w)"
_BOX = r"(?:P\.? ?O\.? ?Box|Postfach|Posta Kutusu|P\.?K\.?|B\.?P\.?|Boîte postale) ?\d"
_RUE = r" (?:rue|avenue|boulevard|place|chemin|impasse|allée|quai|cours|route)"
_STRASSE = r"(?:straße|strasse|str\.|weg|platz|allee|gasse|ring|damm|ufer) \d"
_SOKAK = r" (?:Caddesi|Cad\.|Cd\.|Sokağı|Sokak|Sok\.|Sk\.|Bulvarı|Blv\.)(?: No ?:?)? ?:? ?\d"
_ADDRESSES = [
    rf"(?<![\w/.-])\d{{1,5}}[A-Za-z]? (?:[NSEW]\. )?{NAME_WORD} {_STREET}{_UNIT}?(?:, {_PLACE}(?:{_POST}|, {NAME_WORD}| \d{{5}})?)?",
    rf"(?<!\w){_BOX}\d*(?:, {_PLACE})?",
    rf"(?<![\w/.-])\d{{1,4}}(?: ?(?:bis|ter|quater))?,?{_RUE}(?: (?:de la|de|du|des))? (?:[dl][’'])?{NAME_WORD}(?:, {_PLACE})?",
    rf"(?<!\w)(?:(?:Am|An der|An den|Auf der|Im|In der|Zum|Zur) )?{UP}\w*{_STRASSE}\d{{0,3}} ?[a-z]?(?!\w)(?:, {_PLACE})?",
    rf"(?<!\w)(?:{NAME_WORD} Mah(?:allesi|\.),? )?{NAME_WORD}{_SOKAK}[\d/]*(?:\.? (?:Kat|Blok|Daire|D|K):? ?\w+(?:[:/]\w+)?)*,?(?: {_PLACE})?",
]
_ADDRESS = [re.compile(p) for p in _ADDRESSES]
#: Of each pattern a part that it can't do without.
_ADDRESS_HINTS = [re.compile(p) for p in (rf" {_STREET}", _BOX, rf"{_RUE} ", _STRASSE, _SOKAK)]
_ADDRESS_CUE = re.compile(r"(?i)\b(?:live at|send it to|ship to|my home|address|adres\w*|adresse|anschrift|envoyez|bitte an|evim|yollayın|habite|wohne)\b")
_NO_ADDRESS = re.compile(r"(?i)\b(?:published by|publishers?|printed (?:at|by)|verlag|yayınevi|éditions|éditeur|imprimé par)[:,]? [^\n]{0,14}$")

_NOT_SURNAME = frozenset(map(folded, TITLES | CLOSINGS)) | frozenset("dear lieber liebe cher chère".split())
_SURNAME_AFTER = re.compile(rf"\s{{1,2}}(?:{UP}\.?\s{{1,2}})?({NAME_WORD})")
_CAPITAL = re.compile(rf"(?<![\w’'-]){UP}[^\W\d_]*(?:[’'-][^\W\d_]+)*")
_LOWER_AFTER = re.compile(r"\s{1,2}([^\W\d_]{4,})")
_SURNAME_BEFORE = re.compile(rf"(?<![\w’'-])({NAME_WORD}),\s{{1,2}}$")


def luhn(digits: str) -> bool:
    """Whether a digit string passes the Luhn check."""
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def mod97(value: str) -> bool:
    """Whether an account number passes the mod-97 check (first four characters moved to the end)."""
    v = value[4:] + value[:4]
    return v.isalnum() and v.isascii() and int("".join(str(int(c, 36)) for c in v)) % 97 == 1


def _checked(value: str) -> bool:
    """Checksums that a number of its shape can pass."""
    v = re.sub(r"[\s.-]", "", value)
    if v.isdigit():
        if len(v) == 11 and v[0] != "0":
            d = [int(c) for c in v]
            return (sum(d[0:9:2]) * 7 - sum(d[1:8:2])) % 10 == d[9] and sum(d[:10]) % 10 == d[10]
        if len(v) == 15:
            return 97 - int(v[:13]) % 97 == int(v[13:])
        return len(v) == 16 and luhn(v)
    return bool(re.match(r"[A-Z]{2}\d{2}[A-Z0-9]{11,}$", v)) and mod97(v)


def _spans(text: str, model: NameModel) -> list[tuple[float, int, int, str]]:
    """Accepted spans before overlaps are settled: score, start, end, kind."""
    out = []

    def near(m_start: int, m_end: int) -> tuple[str, str]:
        return text[max(0, m_start - BEFORE) : m_start], text[m_end : m_end + AFTER]

    for score, p, hint in zip((1.0, 0.95), _EMAILS, _EMAIL_HINTS, strict=True):
        if hint.search(text):
            out += [(score, m.start(), m.end(), "email") for m in p.finditer(text)]
    if _DIGITS.search(text):
        for strength, pats in ((0.75, _PHONE), (0.35, [_PHONE_WEAK])):
            for p in pats:
                for m in p.finditer(text):
                    n = sum(c.isdigit() for c in m.group())
                    if not 7 <= n <= 15:
                        continue
                    pre, post = near(m.start(), m.end())
                    pre = _LAST_PART.search(pre).group()
                    score = strength + 0.3 * bool(_PHONE_CUE.search(pre[-26:]) or _PHONE_CUE.match(post.lstrip())) - 0.7 * bool(_NO_CUE.search(pre)) - 0.5 * bool(_ID_CUE.search(pre[-26:]))
                    if score >= ACCEPT:
                        out.append((score, m.start(), m.end(), "phone"))
        for p in _ID:
            for m in p.finditer(text):
                if sum(c.isdigit() for c in m.group()) < 5:
                    continue
                pre = _LAST_PART.search(near(m.start(), m.end())[0]).group()
                score = 0.3 + 0.55 * bool(_ID_CUE.search(pre[-34:])) + 0.3 * _checked(m.group()) - 0.7 * bool(_NO_CUE.search(pre))
                if score >= ACCEPT:
                    out.append((score + 0.001 * len(m.group()), m.start(), m.end(), "id_number"))
    for p, hint in zip(_ADDRESS, _ADDRESS_HINTS, strict=True):
        if hint.search(text):
            for m in p.finditer(text):
                pre, _ = near(m.start(), m.end())
                out.append((0.8 + 0.2 * bool(_ADDRESS_CUE.search(pre[-30:])) - 0.3 * bool(_NO_ADDRESS.search(pre)) + 0.001 * len(m.group()), m.start(), m.end(), "address"))
    out += _names(text, model)
    return out


def _names(text: str, model: NameModel) -> Iterator[tuple[float, int, int, str]]:
    """Name spans by the strength of the given name and of the contexts around."""
    if model.hopeless(text):
        return
    if not model.names.isdisjoint(map(folded, LOWER_WORD.findall(text))):
        for m in LOWER_WORD.finditer(text):
            # Small letters may be an ordinary word: only a given name right after a cue.
            nxt = _LOWER_AFTER.match(text, m.end()) if folded(m.group()) in model.names else None
            if nxt and model.before(*contexts(text, m.start(), nxt.end())[:2]) >= 0.5:
                yield 0.9, m.start(), nxt.end(), "name"
    for m in _CAPITAL.finditer(text):
        s, e = m.span()
        first = folded(m.group())
        strength = model.strength(first)
        if first in _NOT_SURNAME:
            continue
        inv = _SURNAME_BEFORE.search(text[max(0, s - BEFORE) : s]) if strength else None
        nxt = _SURNAME_AFTER.match(text, e)
        if inv and folded(inv.group(1)) not in _NOT_SURNAME:
            at = s - (len(inv.group(0)))
            l1, l2, r1, r2 = contexts(text, at, e)
            cue = max(model.before(l1, l2), model.after(r1, r2))
            if cue >= 0.5 or not nxt or folded(nxt.group(1)) in model.ordinary:
                yield 0.7 + 0.2 * cue, at, e, "name"
                continue
        if nxt and strength and model.strength(folded(nxt.group(1))):  # a second given name
            nxt = _SURNAME_AFTER.match(text, nxt.end()) or nxt
        if nxt and len(nxt.group(1)) > 1:
            l1, l2, r1, r2 = contexts(text, s, nxt.end())
            before, after = model.before(l1, l2), model.after(r1, r2)
            last = folded(nxt.group(1))
            if last in _NOT_SURNAME or (last in model.ordinary and before < 0.5):
                continue
            if strength:
                # A name of the general list alone needs a surname that is no ordinary word.
                yield 0.6 + 0.2 * strength + 0.15 * before + 0.1 * after, s, nxt.end(), "name"
            elif first not in model.ordinary and (before >= 0.8 or before + after >= 1.2):
                yield 0.6 + 0.05 * (before + after), s, nxt.end(), "name"
        elif strength and (low := _LOWER_AFTER.match(text, e)):
            l1, l2, r1, r2 = contexts(text, s, low.end())
            if model.before(l1, l2) >= 0.5 and model.after(r1, r2) >= 0.5:
                yield 0.8, s, low.end(), "name"


def find(text: str | None, model: NameModel) -> list[tuple[int, int, str]]:
    """start, end, kind of all personal information in text, in order and without overlaps."""
    if not text:
        return []
    taken: list[tuple[int, int, str]] = []
    for score, s, e, kind in sorted(_spans(text, model), key=lambda x: (-x[0], x[1])):
        if score >= ACCEPT and all(e <= a or s >= b for a, b, _ in taken):
            taken.append((s, e, kind))
    return sorted(taken)


def _shared_model(docs: DataFrame):
    return docs.sparkSession.sparkContext.broadcast(learned(docs))


def found(docs: DataFrame) -> DataFrame:
    """doc_id, pii_kind, start_pos, end_pos of every case; null and empty texts hold none; other columns are ignored."""
    slim = spread(docs.filter(F.col("text").isNotNull()).select(F.col("doc_id").cast("bigint"), "text"))
    shared = _shared_model(slim)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(d, k, s, e) for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for s, e, k in find(t, shared.value)]
            cols = list(zip(*rows, strict=True)) or [[], [], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.int64())], ["doc_id", "pii_kind", "start_pos", "end_pos"])

    return slim.mapInArrow(run, "doc_id bigint, pii_kind string, start_pos bigint, end_pos bigint")


def redact(text: str | None, model: NameModel) -> str | None:
    """text with a placeholder such as [EMAIL] for each case, the rest unchanged; null stays null."""
    if text is None:
        return None
    out, at = [], 0
    for s, e, kind in find(text, model):
        out += [text[at:s], f"[{kind.upper()}]"]
        at = e
    return "".join(out) + text[at:]


def redacted(docs: DataFrame) -> DataFrame:
    """doc_id and the redacted text of every document, null and empty texts included."""
    slim = spread(docs.select(F.col("doc_id").cast("bigint"), "text"))
    shared = _shared_model(slim.filter(F.col("text").isNotNull()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([redact(t, shared.value) for t in b.column(1).to_pylist()], pa.string())], ["doc_id", "text"])

    return slim.mapInArrow(run, "doc_id bigint, text string")
