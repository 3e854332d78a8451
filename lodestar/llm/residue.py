"""Template residue, filler and error-page text in place of content."""

from __future__ import annotations

import re
import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.storage import written

_NAME = r"[A-Za-z][\w. ]*"
#: Slot notations of template languages, mail merges and forms. Fixed values.
SLOTS = [
    r"\{\{\{?[^{}]{1,80}\}?\}\}", r"\{%[^%{}]{1,60}%\}", r"[$#%]\{[^{}]{1,60}\}", r"\$![A-Za-z_.]{2,40}", r"\$[a-z]+[_.][a-z_.]+", r"<%=?[^%<>]{1,60}%>",
    rf"<<\s*{_NAME}>>", rf"<!--\s*{_NAME}-->", rf"&lt;\s*{_NAME}&gt;", r"<[a-z]+(?:[ _][a-z]+)+>", rf"@@{_NAME}@@", rf"%%{_NAME}%%", r"%[A-Z][A-Z_]{2,}%", r"\b__[A-Za-z][\w. ]{0,40}?__(?!\w)",
    r"\bXX[a-z][a-z_. ]+XX\b", rf"\[\[\s*{_NAME}\]\]", r"\[(?:TBD|TODO|your|insert|describe|list|enter|add|name of|placeholder|to be)\b[^\]\[]{0,60}\]", r"\((?:add|insert|enter|your) [a-z]+(?:[._][a-z]+)*\)",
    r"\*{3}[^*]{1,60}\*{3}", r"\b[A-Z]+_PLACEHOLDER\b", r"\bPLACEHOLDER_[A-Z]+\b", r"\[object\s+Object\]", r"#NAME\?", r"#(?:REF|VALUE|DIV/0|NULL|NUM)!", r"(?<![\w%])%[sd](?![\w%])", r"\{[A-Za-z][\w. ]{1,40}\}",
]
SLOT = "(?i:" + "|".join(SLOTS) + ")"
#: Prose about a mark, which then is text and no slot. Fixed value.
MENTION = r"(?:such as|like|called|named|the tag|tags)\s+\{\w+\}|(?i:\b(?:marks|tags|placeholders)\s+(?:such as|like|called|named|written|spelled)(?:\s+as)?)\s+" + SLOT
#: How any slot notation begins; a cheap guard before the slot pattern. Fixed value.
SLOT_SIGN = r"[{}\[$#@*_]|<[A-Za-z!%<]|%[%A-Za-z{]|\((?:add|insert|enter|your|ADD|INSERT|ENTER|YOUR|Add|Insert|Enter|Your) |&lt;|&LT;|XX"
#: How messages of a site, form prompts and filler begin, by language. Fixed values.
MESSAGES = [
    # en
    r"we use cookies", r"error \d", r"\d{3}\W{0,3}(?:forbidden|not found|unauthori[sz]ed|bad gateway|bad request|service unavailable|internal server|gone\b|the page|gateway time)", r"(?:internal server|server|application|database) (?:error|fault)", r"too many requests",
    r"(?:please |you (?:need|have) to |you must )?(?:enable|turn on|allow|activate|accept) (?:javascript|java script|cookies|scripts?|scripting)", r"javascript (?:is|must|has)", r"this (?:page|site|website|content) (?:needs|requires|is not available|is unavailable|has moved|cannot|could not)",
    r"your (?:browser|session|request|connection)", r"(?:the site is |site |we are )?(?:under|down for) (?:maintenance|construction)", r"thanks for visiting", r"(?:please )?(?:sign|log) ?in\b", r"session (?:has )?(?:expired|timed out)", r"checking (?:your|if)",
    r"(?:content |page |description |details? )?coming soon", r"sorry,? (?:this|the|we|you|but|an?)\b", r"(?:the )?page (?:you|not found|cannot|could not|does not)", r"access (?:denied|to this)", r"permission denied", r"just a moment", r"(?:please )?(?:wait|loading)\b(?:\.|…|$)", r"untitled", r"new (?:page|document|post|item)$", r"powered by \w+", r"return to search",
    r"n/?a\b\W+to be", r"to be (?:filled|completed|added|announced|confirmed)", r"(?:write|enter|type|add|insert|provide|give) (?:a|an|your|the)\b.{0,60}(?:here|description|technology|title|name|summary|text)", r"description of the technology:", r"(?:warning|notice|fatal error|parse error): \w+", r"traceback\b", r"(?:uncaught )?exception\b", r"stack trace",
    r"sample (?:text|title|page)", r"(?:this is )?(?:a )?(?:dummy|placeholder) (?:text|title|page)", r"lorem\b", r"title (?:goes )?here", r"captcha", r"are you (?:a )?(?:human|robot)", r"connection (?:refused|reset|timed out)", r"request timed? ?out", r"no (?:description|summary|title|data|content|results?)(?: is| are)? ?(?:available|found|provided|given)?\W*$", r"back to (?:the )?home",
    # ms, id, tl
    r"halaman (?:tidak|ini|yang|sedang)", r"sila (?:dayakan|aktifkan|log masuk|cuba)", r"(?:silakan|mohon|harap) (?:aktifkan|masuk|coba|login)", r"aktifkan javascript", r"(?:laman|situs|data) (?:ini )?(?:tidak|sedang) (?:dijumpai|ditemukan|tersedia|dalam)", r"terjadi kesalahan", r"ralat \w+", r"hindi (?:makita|mahanap|available|nakita)", r"paki(?:-| )?(?:enable|on|buksan)", r"(?:mangyaring )?i-(?:enable|on)\b",
    # vi
    r"trang (?:bạn|này|web|không)", r"không tìm thấy", r"(?:vui lòng|xin hãy|hãy) (?:bật|đăng nhập|thử)", r"đã xảy ra lỗi", r"lỗi (?:máy chủ|hệ thống|\d)",
    # th
    r"ไม่พบ(?:หน้า|ข้อมูล|เพจ)", r"(?:กรุณา|โปรด)(?:เปิด|เข้าสู่|ลอง|รอ)", r"เกิดข้อผิดพลาด", r"หน้านี้ไม่", r"รหัสข้อผิดพลาด",
    # ja, zh, ko
    r"(?:お探しの|この|ご指定の)?ページ(?:が|は|を)", r"このページ", r"サーバー ?エラー", r"javascript ?を", r"エラーが", r"ログインして", r"請?请?(?:启用|开启|打开|登录|啟用)", r"(?:您|你)(?:访问|请求|要找|查找)的", r"(?:页面|网页|該頁|頁面)(?:不存在|未找到|无法|不可用)", r"服务器(?:错误|内部)", r"未找到", r"요청하신", r"페이지를", r"자바스크립트", r"(?:서버|시스템) ?오류", r"로그인",
    # hi
    r"यह पृष्ठ", r"(?:पृष्ठ|पेज) (?:नहीं|उपलब्ध)", r"कृपया (?:जावास्क्रिप्ट|लॉग|पुनः|स्क्रिप्ट)", r"सर्वर (?:त्रुटि|में)", r"त्रुटि",
]
#: Words that some systems put before a message. Fixed values.
_LEAD = r"^(?:\W*(?:notice|attention|message|info|information|system|status|warning|alert|oops|note)\b\s*[:.!,\-–—]+\s*|(?:[^\w\[\](){}<>#%$*@&])+)+"
_BLANKISH = r"^(?:\W*\b(?:null|undefined|nan|none|n/?a|tbd|tba|todo|test|testing|asdf\w*|qwert\w*|x{3,}|foo|bar|baz|blah|dummy|title|summary|description|try again)\b\W*)+(?:(?:go|return|back|home|powered|contact|please)\b.{0,80})?$"
# Words of common filler text. Fixed values.
_LATIN = ("lorem", "ipsum", "dolor", "amet", "consectetur", "adipiscing", "elit", "tempor", "incididunt", "labore", "magna", "aliqua", "nunc", "velit", "quis", "nostrud")
_TAG = re.compile(r"</?(?:p|div|br|span|b|i|u|h\d|li|ul|ol|em|strong|a|td|tr|table|sup|sub|font|center)\b[^<>]*>", re.I)
_REFERENCE = re.compile(r"\(ref\. \w+\)")
_NUMBERED = re.compile(r"\s*\(\d+\)$")
_CUE = re.compile("|".join(MESSAGES))
_BLANK = re.compile(_BLANKISH)
_LEADING = re.compile(_LEAD)
_SLOTTED = re.compile(SLOT)
_SIGNED = re.compile(SLOT_SIGN)
_MENTIONED = re.compile(MENTION)
_LATIN_WORD = re.compile(r"\b(?:" + "|".join(_LATIN) + r")\b")
_WORD = re.compile(r"\w+")
_SITE_BEFORE, _SITE_AFTER = re.compile(r"^[^|]+? - (?=\S)"), re.compile(r" \| [^|]+$")
_BREAK = re.compile(r"[.!?।。！？|:]+(?=\s|$|[^\x00-\x7f])|\s[-–—|/>]+\s|[\r\n]+|(?<=[ก-๛])\s+(?=[ก-๛])|\([^()]*\)")
_C = "฀-๿぀-ヿ㐀-鿿가-힣"
_UNIT = re.compile(rf"[{_C}]|(?:[^\W\d_{_C}]|[̀-ͯऀ-ःऺ-ॏ'])+")
_PARTED = re.compile(rf"{_UNIT.pattern}|(?:{_BREAK.pattern})")
_UNSPACED = 1 << 63
_SAME = dict.fromkeys(map(ord, string.digits + string.punctuation + "๐๑๒๓๔๕๖๗๘๙०१२३४५६७८९０１２３４５６７８９"), " ")
#: A mark of any notation: signs, a name, signs. Ordinary punctuation is none.
_ANY_MARK = re.compile(r"(?<![\w&])([^\w\s.,;'\"“”‘’()…、。，！।-][^\w\s.,;'\"“”‘’()…、。，！।]{0,3})(?=\S|\s\w)\s?([^\W\d_][\w. ]*?)\s?([^\w\s.,;'\"“”‘’()…、。，！।]{0,3}[^\w\s.,;'\"“”‘’()…、。，！।-])(?!\w)")
#: Marks in plain round brackets, and between low lines.
_PLAIN_MARK = re.compile(r"(\()([^\W\d_][\w. ]*?)(\))|(?<!\w)(__)([^\W\d_][\w. ]*?)(__)(?!\w)")
_STRONG = re.compile(r"[{}\[\]<>%$#@*~^|`§«»=:]")
_WRITTEN_ABOUT = re.compile(r"(?:such as|like|called|named|tags?|marks?|placeholders?|written|spelled)(?:\s+as)?\s+$", re.I)
#: A statement may be part of a template if so many records of so many sources hold it.
REPEATS, SOURCES = 12, 3
#: A word pair is fixed if this share of the records that hold it hold it in one and the same statement ...
OWN = 0.5
#: ... and a statement belongs to a template if this share of its word pairs is fixed.
FIXED = 0.85
#: A notation is one of slots if this share of its marks hold names of variables.
NAMED = 0.5
#: Bits of the filters that tell candidates apart while texts are scanned; fixed in size, and only a filter: exact joins follow.
FILTER_BITS = 1 << 23


def _hash(x: str) -> int:
    return xxhash.xxh3_64_intdigest(x) - (1 << 63)


def _plain(value: str) -> str:
    return (_TAG.sub(" ", value) if "<" in value else value).lower()


def statements(value: str) -> Iterator[str]:
    """The statements of a field without mark-up, digits and signs, in lower case."""
    low, at = _plain(value), 0
    for m in _BREAK.finditer(low):
        words = low[at : m.start()].translate(_SAME).split()
        if words:
            yield " ".join(words)
        at = m.end()
    words = low[at:].translate(_SAME).split()
    if words:
        yield " ".join(words)


class _Words(dict):
    """Ids of units: 0 for what parts statements, else a hash whose sign bit tells unspaced script."""

    def __missing__(self, u: str) -> int:
        i = 0 if not _UNIT.fullmatch(u) else xxhash.xxh3_64_intdigest(u) & ~_UNSPACED | 1 | (_UNSPACED if len(u) == 1 and u > "ऀ" else 0)
        if len(self) > 500_000:
            self.clear()
        self[u] = i
        return i


def fixed_grams(texts: list[str], words: _Words, wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(text, key) of the pairs of words of texts, next to each other or one apart (runs of three characters where words are not spaced).

    Pairs do not cross the end of a statement; a statement of one word has the word for a
    pair. Each key comes once a text; only keys of the filter ``wanted`` come, where one is given.
    """
    ids = [[0, *(words[u] for u in _PARTED.findall(_plain(t))), 0, 0] for t in texts]
    owner = np.repeat(np.arange(len(texts)), np.fromiter(map(len, ids), np.int64, len(ids)))
    u = np.fromiter((i for x in ids for i in x), np.uint64, len(owner))
    if not len(u):
        return owner, u.view(np.int64)
    one, two, three = u[:-2], u[1:-1], u[2:]
    close = (one >= _UNSPACED) & (two >= _UNSPACED)
    with np.errstate(over="ignore"):
        step = np.uint64(0x9E3779B97F4A7C15)
        pair = (one * step ^ two) * step
        apart = (one * step ^ np.uint64(5) ^ three * np.uint64(3)) * step
        run = (pair ^ three) * step
    real = (one > 0) & (two > 0)
    before = np.append(np.uint64(0), u[:-3])
    found = [(pair, real & ~close), (apart, real & ~close & (three > 0)), (run, real & close & ((three > 0) | (before == 0))), (two * step, (one == 0) & (two > 0) & (three == 0))]
    at = np.concatenate([owner[:-2][ok] for _, ok in found])
    keys = np.concatenate([k[ok] for k, ok in found])
    keys = (keys ^ (keys >> np.uint64(31))).view(np.int64)
    if wanted is not None:
        bit = keys & (FILTER_BITS - 1)
        some = (wanted[bit >> 6] >> (bit & 63)) & 1 == 1
        at, keys = at[some], keys[some]
    order = np.lexsort((keys, at))
    at, keys = at[order], keys[order]
    fresh = np.append(True, (at[1:] != at[:-1]) | (keys[1:] != keys[:-1]))[: len(at)]
    return at[fresh], keys[fresh]


def _bare(value: str) -> str:
    """A field without mark-up and reference codes, in lower case."""
    x = _TAG.sub(" ", value) if "<" in value else value
    x = _REFERENCE.sub("", x) if "(ref. " in x else x
    x = " ".join(x.lower().split())
    return _NUMBERED.sub("", x) if x.endswith(")") else x


def is_message(value: str | None) -> bool:
    """Whether a field is a known message of a site, a form prompt or filler instead of content.

    The statement it opens with decides; of a field of many statements at least half
    have to be known. Filler is common pseudo-Latin.
    """
    if not value or not value.strip():
        return False
    bare = _bare(value)
    forms = {bare, _LEADING.sub("", bare)}
    if " - " in bare or " | " in bare:
        forms.add(_LEADING.sub("", _SITE_AFTER.sub("", _SITE_BEFORE.sub("", bare))))
    for x in forms:
        if _CUE.match(x) or _BLANK.match(x):
            parts = [p for p in _BREAK.split(bare) if p.strip()]
            return len(parts) <= 6 or sum(bool(_CUE.match(p.strip())) for p in parts) * 2 >= len(parts)
    low = value.lower()
    if "lorem" in low or "ipsum" in low or "amet" in low:
        n = len(_LATIN_WORD.findall(low))
        if n >= 2 and n * 8 >= len(_WORD.findall(low)):
            return True
    return False


def any_marks(value: str) -> list[tuple[str, str, bool]]:
    """(frame, name, inside) of marks in any notation; inside: text goes on after it. Marks that the words before them write about are left out."""
    out = []
    text = _TAG.sub(" ", value.replace("&lt;", "<").replace("&gt;", ">"))
    for m in _ANY_MARK.finditer(text):
        before, name, after = m.groups()
        if (_STRONG.search(before) or _STRONG.search(after)) and not _WRITTEN_ABOUT.search(text, 0, m.start()):
            out.append((f"{before}\x1f{after}", " ".join(name.lower().split()), bool(text[m.end() :].strip())))
    for m in _PLAIN_MARK.finditer(text):
        before, name, after = [g for g in m.groups() if g]
        out.append((f"{before}\x1f{after}", " ".join(name.lower().split()), bool(text[m.end() :].strip())))
    return out


FACTS = "id string, source_id string, field string, told boolean, text_key long, statements array<long>, marks array<struct<frame: string, name: string, inside: boolean>>"


def field_facts(fields: DataFrame, known: bool) -> DataFrame:
    """One compact row per field: known message or slot or not, keys of its statements, marks in any notation. Texts are read once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            told, texts, keys, marks = [], [], [], []
            for v in batch.column(3).to_pylist():
                hit = False
                if known:
                    hit = is_message(v)
                    if not hit and _SIGNED.search(v) and _SLOTTED.search(v):
                        hit = sum(1 for _ in _SLOTTED.finditer(v)) > sum(1 for _ in _MENTIONED.finditer(v))
                told.append(hit)
                texts.append(_hash(v))
                keys.append([_hash(s) for s in statements(v)])
                marks.append([dict(zip(("frame", "name", "inside"), x)) for x in any_marks(v)] if _STRONG.search(v) or "&lt;" in v or "(" in v or "__" in v else [])
            kind = pa.list_(pa.struct([("frame", pa.string()), ("name", pa.string()), ("inside", pa.bool_())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(told, pa.bool_()), pa.array(texts, pa.int64()), pa.array(keys, pa.list_(pa.int64())), pa.array(marks, kind)], ["id", "source_id", "field", "told", "text_key", "statements", "marks"])

    return fields.mapInArrow(run, FACTS)


def _filter_of(keys: DataFrame, column: str) -> Broadcast:
    """A bit set of the keys, of fixed size whatever their number."""
    words = keys.select(F.expr(f"cast(({column} & {FILTER_BITS - 1}) >> 6 AS INT)").alias("w"), F.expr(f"shiftleft(1L, cast({column} & 63 AS INT))").alias("b")).groupBy("w").agg(F.bit_or("b").alias("b"))
    bits = np.zeros(FILTER_BITS // 64, np.int64)
    for r in words.toLocalIterator():  # at most FILTER_BITS / 64 rows
        bits[r[0]] = r[1]
    return keys.sparkSession.sparkContext.broadcast(bits)


def _passes(bits: np.ndarray, key: int) -> bool:
    at = key & (FILTER_BITS - 1)
    return bool(int(bits[at >> 6]) >> (at & 63) & 1)


def page_templates(fields: DataFrame, facts: DataFrame) -> DataFrame:
    """(id, field) of fields that consist of statements of page templates.

    Records are aligned by the statements they share. A statement that many records of
    several sources hold is fixed text of a template, or a phrase of real content. Words of
    real content also occur in other company: their pairs stand in many different
    statements, because the slots around them are filled in many ways. The pairs of a page
    template stand in that one statement only. So a statement is a template's where nearly
    all its pairs are its own; pairs shared by several such statements (a second round)
    count as their own. All tests are shares, so ten copies of a table give the same.
    """
    per = facts.select(F.explode("statements").alias("s"), "source_id").groupBy("s", "source_id").agg(F.count(F.lit(1)).alias("n"))
    repeated = per.groupBy("s").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("sources")).where((F.col("n") >= REPEATS) & (F.col("sources") >= SOURCES)).select("s", "n")
    repeated = written(repeated, "repeated")
    seen = _filter_of(repeated, "s")

    def of_repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.diff(batch.column(1).offsets.to_numpy())
            s = batch.column(1).flatten().to_numpy()
            at = s & (FILTER_BITS - 1)
            owner = np.repeat(np.arange(len(sizes)), sizes)
            missed = np.bincount(owner[(seen.value[at >> 6] >> (at & 63)) & 1 == 0], minlength=len(sizes))
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array((missed == 0) & (sizes > 0)))], ["k"])

    asked = _filter_of(facts.select("text_key", "statements").mapInArrow(of_repeated, "k long").distinct(), "k")

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _Words()
        for batch in batches:
            met = {_hash(s): s for v in batch.column(1).to_pylist() if _passes(asked.value, _hash(v)) for s in statements(v)}
            at, grams = fixed_grams(list(met.values()), words)
            yield pa.RecordBatch.from_arrays([pa.array(np.array(list(met), np.int64)[at]), pa.array(grams)], ["s", "g"])

    texts = fields.select("field", "value")
    pairs = written(texts.mapInArrow(candidates, "s long, g long").distinct().join(repeated, "s"), "asked")
    wanted = _filter_of(pairs.select("g"), "g")

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _Words()
        for batch in batches:
            keys, n = np.unique(fixed_grams(batch.column(1).to_pylist(), words, wanted.value)[1], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(n.astype(np.int64))], ["g", "all"])

    held = texts.mapInArrow(counted, "g long, all long").groupBy("g").agg(F.sum("all").alias("all"))
    pairs = written(pairs.join(held, "g").select("s", "n", "g", "all"), "pairs")
    own = F.col("n") >= OWN * F.col("all")
    first = pairs.groupBy("s", "n").agg(F.avg(own.cast("double")).alias("share")).where(F.col("share") >= FIXED).select("s")
    inside = pairs.join(first, "s", "left_semi").groupBy("g").agg(F.sum("n").alias("inside"))
    shared = F.coalesce(F.col("inside"), F.lit(0)) >= OWN * F.col("all")
    fixed = pairs.join(inside, "g", "left").groupBy("s").agg(F.avg((own | shared).cast("double")).alias("share")).where(F.col("share") >= FIXED).select("s")
    each = facts.where(F.size("statements") > 0).select("id", "field", F.xxhash64("statements").alias("whole"), "statements")
    wholes = each.groupBy("whole").agg(F.first("statements").alias("statements"), F.count(F.lit(1)).alias("records")).select("whole", "records", F.size("statements").alias("most"), F.explode("statements").alias("s"))
    parts = wholes.join(fixed, "s", "left_semi")
    parts = parts.join(parts.groupBy("whole", "most").agg(F.count(F.lit(1)).alias("k")).where(F.col("k") == F.col("most")).select("whole"), "whole", "left_semi")
    parts = written(parts, "parts")
    alone = parts.groupBy("s").agg(F.sum("records").alias("alone")).join(repeated, "s").where(F.col("alone") >= OWN * F.col("n")).select("s", F.lit(1).alias("page"))
    stamped = parts.join(alone, "s", "left").groupBy("whole", "most").agg(F.sum(F.coalesce("page", F.lit(0))).alias("k")).where(F.col("k") * 2 >= F.col("most")).select("whole")
    return each.join(stamped, "whole", "left_semi").select("id", "field")


def unfilled_slots(facts: DataFrame, columns: list[str]) -> DataFrame:
    """(id, field) of fields with a mark in a notation induced from the marks of all records.

    The marks are aligned by their signs (the notation) and by what stands in them. A name
    of a variable is a field name of the table, has the shape of one (a dot or a low line
    inside), stands in several notations, or fills a good part of a notation's marks in
    many records with text after it. A notation of slots holds mostly such names; real
    brackets hold ever different words. In plain brackets only such a name, or fixed
    words around it (``insert _ here``, whose place varies), make a slot.
    """
    marks = facts.where(F.size("marks") > 0).select("id", "field", "source_id", F.explode("marks").alias("m")).select("id", "field", "source_id", "m.*")
    marks = written(marks.distinct(), "marks")
    plain = F.col("frame").isin("[\x1f]", "(\x1f)", "<\x1f>")
    per = marks.groupBy("frame", "name", "source_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("inside").cast("long")).alias("n_inside"))
    per = written(per.groupBy("frame", "name").agg(F.sum("n").alias("n"), F.sum("n_inside").alias("n_inside"), F.count(F.lit(1)).alias("sources")), "names")
    totals = per.groupBy("frame").agg(F.sum("n").alias("all"))
    frames = per.groupBy("name").agg(F.count(F.lit(1)).alias("frames"))
    ident = F.col("name").rlike(r"^[^\W\d_]+(?:[._][^\W_]+)+$") | F.col("name").isin(*[c.lower() for c in columns])
    often = (F.col("n_inside") >= REPEATS) & (F.col("sources") >= SOURCES) & (F.col("n") * 10 >= F.col("all")) & ~plain
    judged = written(per.join(totals, "frame").join(frames, "name").withColumn("ident", ident).withColumn("variable", F.col("ident") | (F.col("frames") >= 2) | often), "judged")
    single = F.when(F.col("variable"), F.col("n")).otherwise(0)
    notations = judged.where(~plain).groupBy("frame").agg(F.sum("n").alias("n"), F.max("sources").alias("s"), F.sum(single).alias("v"), F.sum(F.when(F.col("ident"), F.col("n")).otherwise(0)).alias("i"))
    notations = notations.where((F.col("v") >= NAMED * F.col("n")) & ((F.col("n") >= REPEATS) | (F.col("i") > 0))).select("frame")
    names = judged.where(F.col("variable") & ((F.col("frames") >= 2) | F.col("ident"))).select("name").distinct()
    bracketed = judged.where(plain).join(names, "name", "left_semi").select("frame", "name")
    # fixed words around a name: the words of a mark with each in turn taken out
    words = F.split("name", " ")
    holed = judged.where(F.size(words) >= 2).select("frame", F.col("name").alias("whole"), "n", F.posexplode(words).alias("at", "word"))
    holed = holed.select("frame", "whole", "n", F.col("word").alias("name"), F.concat_ws("\x1f", F.slice(F.split("whole", " "), F.lit(1), F.col("at")), F.array(F.lit("_")), F.slice(F.split("whole", " "), F.col("at") + 2, F.size(F.split("whole", " ")))).alias("around"))
    around = holed.join(names.withColumn("is_name", F.lit(True)), "name", "left").groupBy("frame", "around").agg(F.sum("n").alias("n"), F.count_distinct("name").alias("fillers"), F.sum(F.when(F.col("is_name"), F.col("n")).otherwise(0)).alias("named"))
    around = around.where((F.col("fillers") >= SOURCES) & (F.col("named") >= NAMED * F.col("n"))).select("frame", "around")
    prompts = holed.join(around, ["frame", "around"], "left_semi").select("frame", F.col("whole").alias("name")).distinct()
    in_notation = marks.join(notations, "frame", "left_semi").select("id", "field")
    in_brackets = marks.join(bracketed.unionByName(prompts).distinct(), ["frame", "name"], "left_semi").select("id", "field")
    return in_notation.unionByName(in_brackets)


def template_residue(df: DataFrame, id_col: str, fields: list[str], source_id: str, known: bool = True) -> DataFrame:
    """One row (id, field) per field that holds template residue, filler or a message.

    Page templates and slot notations are induced from the records (``page_templates``,
    ``unfilled_slots``); ``known`` adds the notations and messages written down above, for
    those that occur too seldom to be induced. Empty and null fields are no cases;
    repeated rows of an id count once; ids that are null are left out; the source may be
    null. Fields of any length are read whole.
    """
    each = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("value")) for f in fields]))
    long = df.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.coalesce(F.col(source_id), F.lit("")).alias("source_id"), each.alias("x")).select("id", "source_id", "x.field", "x.value")
    long = long.where(F.length(F.trim("value")) > 0)
    facts = written(field_facts(long, known), "facts")
    told = facts.where("told").select("id", "field")
    return told.unionByName(unfilled_slots(facts, df.columns)).unionByName(page_templates(long, facts)).distinct()
