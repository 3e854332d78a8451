"""Sentence units of texts in any script.

Unicode sentence-break properties give the terminators of every script; abbreviation
suppression, quotation closing and layout (headings, list lines, wrapped lines) are
tailorings on top, and languages that write no stop (Thai) are split at the blanks
between statements.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T


def _property_class(expression: str) -> str:
    """All characters with a Unicode property, as the inside of a character class."""
    points = [ord(c) for c in regex.findall(expression, "".join(map(chr, [*range(0xD800), *range(0xE000, sys.maxunicode + 1)])))]
    runs: list[list[int]] = []
    for p in points:
        if runs and p == runs[-1][1] + 1:
            runs[-1][1] = p
        else:
            runs.append([p, p])
    return "".join(re.escape(chr(a)) + ("-" + re.escape(chr(b)) if b > a else "") for a, b in runs)


STERM = _property_class(r"\p{Sentence_Break=STerm}")
ATERM = _property_class(r"\p{Sentence_Break=ATerm}")
CLOSE = "\"'”’」』）)\\]】》»›〕}"
# Abbreviations that a capital or a number may follow without ending the sentence. Fixed values.
SUPPRESSED = frozenset(
    "dr mr mrs ms prof st no nos fig figs sec vs ca approx appl mk e.g i.e cf viz ed eds vol pp p art eq ref refs gen col capt sgt lt rev hon gov sen rep mt ft est dept incl resp max min temp "
    "ts ths bs gs pgs blg no tn ir hj hjh en pn tgk dg bpk sdr drs dra gng engr atty "
    "ดร ศ รศ ผศ นพ พญ นส กก ซม มม กม มล ลบ.ม ตร.ม พ.ศ ค.ศ น โทร "
    "डॉ प्रो श्री सं क्र कि.ग्रा रु पृ सु.श्री".split()
)
# Abbreviations that may end a sentence: they end one where a new one visibly begins. Fixed values.
FINAL = frozenset("etc al yr yrs hr hrs ltd co inc corp bhd sdn a.m p.m u.s u.k u.n e.u ph.d m.sc b.sc dll dsb dst v.v tbk s.a i.d d.c jr sr cm mm km kg lb oz in".split())
_ENDS = re.compile(f"[{STERM}{ATERM}…]+[{CLOSE}]*")
_WORD_BEFORE = re.compile(r"(?:[^\W\d_][̀-ͯऀ-ःऺ-ॏัิ-๎]*\.?)+$")
_BLANKS = re.compile(r"\s*")
_MARK = re.compile(r"[ \t]*(?:[-*+•‣▪●·–—][ \t]+|\(?(\d{1,2})[.)][ \t]+)")
_QUOTES = re.compile(r"“[^“”\n]+”|„[^“”\n]+[“”]|「[^「」]+」|『[^『』]+』|«[^«»\n]+»|(?:(?<=\s)|(?<=^)|(?<=[(（:：,，]))\"[^\"]+\"|（[^（）]+）|\([^()]+\)")
_THAI_GAP = re.compile(r"(?<=[ก-๛])[  ]+(?=[ก-๛A-Z぀-ヿ一-鿿가-힯ऀ-ॿ])")
_THAI_TITLE = re.compile(r"(?:ดร|ศ|รศ|ผศ|นพ|พญ)\.[  ]+\S+$|(?:นาย|นาง|นางสาว)[  ]?\S+$")
_CAPITAL_INSIDE = re.compile(r"[a-z][A-Z]")
_LINE = re.compile(r"[^\r\n  \x85]+")

def _is_spaceless(c: str) -> bool:
    return "฀" <= c <= "໿" or "぀" <= c <= "ヿ" or "㐀" <= c <= "鿿"


def _starts_sentence(text: str, at: int) -> bool:
    """Whether a new sentence visibly begins here: a capital, a caseless letter, an opening mark, or a lower-case word with a capital inside."""
    c = text[at : at + 1]
    if not c:
        return True
    if c in "\"“‘「『«„¿¡(":
        return _starts_sentence(text, at + 1)
    if c.isalpha():
        return not c.islower() or bool(_CAPITAL_INSIDE.match(text, at))
    return False


def _blocks(text: str) -> Iterator[tuple[int, int]]:
    """Stretches that no sentence crosses: headings, list lines, paragraphs; wrapped lines stay together."""
    lines = [(m.start(), m.end()) for m in _LINE.finditer(text)]
    if len(lines) < 2:
        yield from lines
        return
    shown = [text[a:b].rstrip() for a, b in lines]
    longest = max(map(len, shown))
    marks = []
    for s in shown:
        m = _MARK.match(s)
        marks.append((int(m.group(1)) if m.group(1) else 0) if m else None)
    numbers = {n for n in marks if n}
    begin, last_mark = lines[0][0], 0
    # wrapped text has many lines about as long as the longest; long lines are seldom wrapped, so they need more
    wide = sum(len(s) >= longest - 16 for s in shown) >= max(2, len(shown) // 4, longest // 60)
    in_list = marks[0] is not None
    for i in range(1, len(lines)):
        before, here = shown[i - 1], shown[i]
        gap = text[lines[i - 1][1] : lines[i][0]]
        head = here.lstrip()
        mark = marks[i]
        is_mark = mark is not None and (mark == 0 or (mark == 1 and 2 in numbers) or (mark > 1 and last_mark == mark - 1))
        if gap.count("\n") + gap.count(" ") > 1 or (gap.count("\r") > 1 and "\n" not in gap) or not head or not before.strip():
            joined = False
        elif is_mark:
            joined = False
        elif head[0].islower() and not _CAPITAL_INSIDE.match(head) and (before[-1] not in ":;" or wide):
            joined = True
        elif in_list and len(before) < longest - 16:
            joined = False
        else:
            first = 1 if _is_spaceless(head[0]) else len(head.split(None, 1)[0])
            joined = wide and len(before) + 1 + first > longest - (2 if first > 1 else 0) and before[-1] != ":"
            joined = joined or (wide and head[0].isdigit() and mark is None and before[-1] not in ".:;!?。！？।")
            joined = joined or (wide and len(before) >= longest - 14 and before[-1] not in ".:;!?。！？।" and not _is_spaceless(head[0]))
        if is_mark and mark:
            last_mark = mark
        if not joined:
            yield begin, lines[i - 1][1]
            begin, in_list = lines[i][0], is_mark
    yield begin, lines[-1][1]


def _cuts(text: str, a: int, b: int) -> list[int]:
    """Where sentences end inside one block."""
    body = text[a:b]
    cuts: list[int] = []
    quoted: list[tuple[int, int]] | None = None
    mark = _MARK.match(body)
    skip = mark.end() if mark else 0
    for m in _ENDS.finditer(body, skip):
        end = m.end()
        after = _BLANKS.match(body, end).end()
        if after >= len(body):
            break
        term = m.group().rstrip(CLOSE)
        closed = len(term) < len(m.group())
        nxt = body[after]
        spaced = after > end
        dotted = term[-1] in ".．…‥" or term.endswith("...")
        if quoted is None:
            quoted = [q.span() for q in _QUOTES.finditer(body)]
        if quoted and any(s < m.start() < e - 1 and (end < e or body[e - 1] in ")）") for s, e in quoted):
            continue
        if closed and nxt in ",;:،、，；" or nxt in ",;，；、":
            continue
        if closed and spaced and nxt.islower() and not _CAPITAL_INSIDE.match(body, after):
            continue
        if closed and not spaced and nxt.isalpha():
            # a quotation goes on into its sentence: particles after Japanese or Korean quotes
            if "぀" <= nxt <= "ゟ" or "가" <= nxt <= "힣" or nxt.islower():
                continue
        elif dotted:
            if term.endswith(("...", "…", "‥")):
                if spaced and not _starts_sentence(body, after) or (not spaced and term[-1] == "." and not nxt.isupper()):
                    continue
            elif m.start() == 0:
                continue
            elif not spaced:
                before = body[m.start() - 1 : m.start()]
                if not before or not nxt.isalpha() or not _starts_sentence(body, after):
                    continue
                w = _WORD_BEFORE.search(body, max(0, m.start() - 24), m.start())
                word = w.group().lower() if w else ""
                if "." in word or len(word) < 2 and before.isalpha() or word in SUPPRESSED or body[after : after + 2].isupper() and len(word) < 3 or body[after + 1 : after + 2] == ".":
                    continue
                if before.isdigit() and not nxt.isupper():
                    continue
            elif "ก" <= body[m.start() - 1] <= "๛" and not nxt.isupper():
                continue  # Thai writes no stop; a full stop after Thai letters abbreviates
            else:
                w = _WORD_BEFORE.search(body, max(0, m.start() - 24), m.start())
                word = w.group() if w else ""
                low = word.lower().rstrip(".")
                if low:
                    if low in SUPPRESSED:
                        continue
                    if low in FINAL or "." in low:
                        if not _starts_sentence(body, after):
                            continue
                        if low in ("co", "ph.d", "sdn") :
                            continue
                    elif len(low) == 1 and word.isupper() and nxt.isalpha():
                        continue
                if not closed and nxt in ")]）":
                    continue
        cuts.append(end)
    if re.search(r"[ก-๛]", body):
        for m in _THAI_GAP.finditer(body, skip):
            if quoted is None:
                quoted = [q.span() for q in _QUOTES.finditer(body)]
            if any(s < m.start() < e for s, e in quoted):
                continue
            if _THAI_TITLE.search(body, max(0, m.start() - 40), m.start()):
                continue
            cuts.append(m.start())
        cuts.sort()
    return cuts


def sentence_spans(text: str | None) -> list[tuple[int, int]]:
    """Sentence units as (start, end) code-point offsets, outer white space excluded.

    Every character that is not white space lies in exactly one unit. Null, empty and
    blank texts have none.
    """
    if not text:
        return []
    spans: list[tuple[int, int]] = []
    for a, b in _blocks(text):
        at = a
        for cut in [*(a + c for c in _cuts(text, a, b)), b]:
            s, e = at, cut
            while s < e and text[s].isspace():
                s += 1
            while e > s and text[e - 1].isspace():
                e -= 1
            if e > s:
                spans.append((s, e))
            at = cut
    return spans


UNIT = T.StructType([T.StructField("start_char", T.IntegerType()), T.StructField("end_char", T.IntegerType())])


def sentence_units(df: DataFrame, key: str, text: str) -> DataFrame:
    """One row (key, start_char, end_char) per sentence unit of every row.

    Runs on Arrow batches in one narrow stage: no shuffle, so a hot source costs nothing,
    and memory is one batch whatever the length of a text. Null, empty and blank texts
    give no rows; repeated rows give their units each. Other columns are dropped, so
    clashing names cannot arise.
    """
    kind = df.schema[key].dataType

    def units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, starts, ends = [], [], []
            for i, t in enumerate(batch.column(1).to_pylist()):
                for s, e in sentence_spans(t):
                    rows.append(i)
                    starts.append(s)
                    ends.append(e)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(rows, pa.int64())), pa.array(starts, pa.int32()), pa.array(ends, pa.int32())], ["k", "start_char", "end_char"]
            )

    out = T.StructType([T.StructField("k", kind), *UNIT.fields])
    return df.select(key, text).mapInArrow(units, out).withColumnRenamed("k", key)
