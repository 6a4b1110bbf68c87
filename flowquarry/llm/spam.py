"""Pages of keywords, links or tags instead of sentences.

Texts are cut into blocks of ``BLOCK`` characters at line or word ends. Each block gets its compression ratio, divided by the usual ratio
of blocks of that language and length in the corpus, and its sentence ends a word. A text becomes a candidate if a block is far more
redundant than usual, or has hardly any sentence end: lists of ever new products, tags or places compress like prose, so redundancy
alone would miss them. The verdict counts words: a candidate is such a page if more than half of its words stand in repeated phrases, links with their labels, tags or
runs that neither end like sentences nor hold the short words that sentences do. No language's words are listed. Records of figures (tab-separated lines) are no lists in that sense.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from itertools import accumulate

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowquarry.session import cut

BLOCK = 600
#: A language's own usual ratio weighs as many blocks as it has, that of all languages as many as this.
PRIOR_BLOCKS = 500
#: No usual ratio counts as more, as a corpus may consist of such pages; sentences stay below it at this block size.
MOST_USUAL = 2.4
#: Words on either side of a word among which sentences have words of at most SHORT letters, whatever their language.
REACH, SHORT = 8, 3
#: Texts of more characters are read twice rather than held as words; the result is the same.
HELD = 1 << 22

URL = re.compile(r"(?:https?://|www\.)[^\s<>\"')\]|]+|(?<![\w@.])[\w-]+\.[a-z]{3,}(?:/[^\s<>\"')\]|]*)?(?![\w.])", re.I)
HASHTAG = re.compile(r"(?<![\w&])#[\w-]+")
MARKED = re.compile(r"#|://|\w\.[a-z]{3}", re.I)
ANCHOR = re.compile(r"<a\s[^<>]*href\s*=\s*[\"']?([^\"'\s<>]*)[^<>]*>([^<>]*)</a>", re.I)
TAG = re.compile(r"</?[a-z][^<>]*>", re.I)
#: Letters or digits; an at sign within is one of them, as pages write it for an a.
WORD = re.compile(r"[^\W_]+(?:@[^\W_]+)*")
CLOSERS = "\"”’»)]"
SENTENCE = re.compile(r"(?<=[.!?])[\"”’»)\]]*\s+|(?<=[。！？।])")
STOPS = ".!?。！？।"
LISTED = re.compile(r"[;|•]|::")
SEPARATOR = re.compile(r"[|•]|::")
ENDS = re.compile(r"[.!?][\"”’»)\]]*(?=\s|$)|[。！？।]")

Units = list[str | None]


def _units(segment: str) -> Units:
    """The words of a segment as they stand; a link or a hashtag is one unit, None."""
    out: Units = []
    at = 0
    for a, b in sorted([m.span() for m in URL.finditer(segment)] + [m.span() for m in HASHTAG.finditer(segment)]):
        if a >= at:
            out += WORD.findall(segment, at, a)
            out.append(None)
            at = b
    out += WORD.findall(segment, at)
    return out


def _segments(text: str) -> Iterator[tuple[bool, str, Units]]:
    """(is a record of figures, segment, units) of each sentence or line."""
    if "<" in text:
        text = TAG.sub(" ", ANCHOR.sub(r" [\2](\1) ", text))
    units_of = _units if MARKED.search(text) else WORD.findall
    for line in text.replace("&nbsp;", " ").splitlines():
        if line.count("\t") >= 2:
            yield True, line, WORD.findall(line)
        else:
            for s in SENTENCE.split(line):
                if units := units_of(s):
                    yield False, s.strip(), units


def _short(segment: str, units: Units) -> list[bool]:
    """Which units are short words. Names and product codes have capitals or digits, so only words in lower case count, or all where a segment has no lower case."""
    if segment.isupper():
        return [u is not None and len(u) <= SHORT and u.isalpha() for u in units]
    return [u is not None and len(u) <= SHORT and u.isalpha() and not u[0].isupper() for u in units]


def _loose(segment: str, units: Units) -> list[bool] | None:
    """For each unit, whether it stands outside of anything like a sentence; None if none does.

    Sentences end in a stop, or hold short words all along, as the words that link others are in languages written in letters.
    What bars, bullets or double colons cut every twelve words is a list.
    """
    n = len(units)
    caseless = n == 1 and units[0] and units[0].isalpha() and units[0].lower() == units[0].upper()  # scripts without blanks
    closed = n <= 60 and (n >= 2 or caseless) and segment.rstrip(CLOSERS)[-1:] in STOPS and not segment[0].islower() and None not in units and not LISTED.search(segment)
    if closed and n <= 12:
        return None
    short = _short(segment, units)
    if closed and sum(short) >= 2:
        return None
    if len(SEPARATOR.findall(segment)) >= max(4, n / 12):
        return [True] * n
    upto = [0, *accumulate(short)]
    need = 2 if n > REACH else 1
    return [u is None or upto[min(n, i + REACH + 1)] - upto[max(0, i - REACH)] < need for i, u in enumerate(units)]


def _content(w: str | None) -> bool:
    return w is not None and len(w) > SHORT and not w.isdigit()


def _lower(units: Units) -> Units:
    return [u and u.lower() for u in units] if None in units else " ".join(units).lower().split(" ")


def _key_phrases(parts: Callable[[], Iterable[tuple[bool, str, Units]]]) -> tuple[set, set, set]:
    """(dense pairs, other repeated pairs, words) that repeat as key phrases do. A phrase of two to five words is as many pairs.

    Dense pairs are one in 22 words, single words one in 12. Other pairs of longer words repeat five times, or half the root of the text's words, at least:
    many key phrases may share a page, however long it is. Prose repeats them too, so they count only where no short word links them.
    """
    single: Counter = Counter()
    for _, _, units in parts():
        single.update(_lower(units))
    n = single.total()
    many, some = max(5, n / 22), max(5, math.sqrt(n) / 2)
    alone = {w for w, k in single.items() if k >= max(6, n / 12) and _content(w)}
    often = [w for w, k in single.items() if k >= some and w is not None]
    if len([w for w in often if single[w] >= many]) < 2 and len([w for w in often if _content(w)]) < 2:
        return set(), set(), alone  # no pair can be frequent if its words aren't
    pairs: Counter = Counter()
    last = None
    for _, _, units in parts():
        low = _lower(units)
        pairs.update(zip([last, *low[:-1]], low, strict=True))
        last = low[-1]
    kept = {p: k for p, k in pairs.items() if k >= some and None not in p}
    dense = {p for p, k in kept.items() if k >= many}
    return dense, {p for p in kept if p not in dense and _content(p[0]) and _content(p[1])}, alone


def list_words(text: str) -> tuple[int, int]:
    """(words, words outside of sentences or in repeated phrases) of a text of any length, judged as a whole."""
    held = list(_segments(text)) if len(text) <= HELD else None
    parts = (lambda: held) if held is not None else (lambda: _segments(text))
    dense, other, alone = _key_phrases(parts)
    n = bad = 0
    for figures, segment, units in parts():
        k = len(units)
        n += k
        if figures:
            continue
        loose = _loose(segment, units)
        if dense or alone or (other and not any(_short(segment, units))):
            low = _lower(units)
            sparse = other and not any(_short(segment, units))
            again = [w in alone for w in low]
            for i, p in enumerate(zip(low, low[1:], strict=False)):
                if p in dense or (sparse and p in other):
                    again[i] = again[i + 1] = True
            if sum(again) >= 0.3 * k:
                bad += k
            else:
                bad += sum(again) if loose is None else sum(a or b for a, b in zip(again, loose, strict=True))
        elif loose is not None:
            bad += sum(loose)
    return n, bad


def blocks(text: str) -> list[str]:
    out, at = [], 0
    while len(text) - at > BLOCK * 3 // 2:
        end = max(text.rfind(" ", at + BLOCK // 2, at + BLOCK), text.rfind("\n", at + BLOCK // 2, at + BLOCK))
        end = at + BLOCK if end < 0 else end
        out.append(text[at:end])
        at = end
    return [*out, text[at:]]


def _packed(raw: bytes) -> int:
    # A window that fits the block: the default one costs more to set up than the block to compress.
    c = zlib.compressobj(6, zlib.DEFLATED, -11, 5)
    return len(c.compress(raw)) + len(c.flush())


def block_measures(text: str) -> list[tuple[int, float, float]]:
    """(length bin, compression ratio, sentence ends a word) of each block."""
    out = []
    for b in blocks(text):
        raw = b.encode("utf-8", "replace")
        out.append((min(len(raw) // 100, 9), len(raw) / max(1, _packed(raw)), len(ENDS.findall(b)) / max(1, len(b.split()))))
    return out


MEASURED = "n_words int, n_loose int, blocks array<struct<bin: int, ratio: double, ends: double>>"


def measure(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """(doc_id, lang, n_words, n_loose, blocks): all that a text alone can tell. Null and empty texts are left out."""
    schema = T.StructType([docs.schema[doc_id], T.StructField("lang", T.StringType()), *T.StructType.fromDDL(MEASURED).fields])

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for d, t, code in zip(pdf["__id"], pdf["__text"], pdf["__lang"], strict=True):
                n, bad = list_words(t)
                rows.append((d, code, n, bad, [{"bin": a, "ratio": r, "ends": e} for a, r, e in block_measures(t)]))
            yield pd.DataFrame(rows, columns=schema.names)

    # Two letters at most, so there are under 700 languages whatever the labels.
    code = F.coalesce(F.nullif(F.regexp_extract(F.lower(F.trim(lang)), r"^([a-z]{2})", 1), F.lit("")), F.lit("??"))
    rows = docs.select(F.col(doc_id).alias("__id"), F.col(text).alias("__text"), code.alias("__lang")).filter(F.length("__text") > 0)
    return rows.mapInPandas(scan, schema)


def usual_ratios(measured: DataFrame) -> DataFrame:
    """(lang, bin, usual): the median ratio of the blocks of a language and length, drawn towards that of all languages as if ``PRIOR_BLOCKS`` more blocks had it; at most 7,000 rows."""
    each = measured.select("lang", F.explode("blocks").alias("b")).select(F.explode(F.array("lang", F.lit("*"))).alias("lang"), "b.bin", "b.ratio")
    per = each.groupBy("lang", "bin").agg(F.percentile_approx("ratio", 0.5, 1000).alias("own"), F.count(F.lit(1)).alias("n"))
    every = per.filter("lang = '*'").select("bin", F.col("own").alias("every"))
    blend = (F.col("own") * F.col("n") + F.col("every") * PRIOR_BLOCKS) / (F.col("n") + PRIOR_BLOCKS)
    return per.filter("lang <> '*'").join(every, "bin").select("lang", "bin", F.least(blend, F.lit(MOST_USUAL)).alias("usual"))


def judged(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", excess: float = 1.6, few_ends: float = 0.025, share: float = 0.5) -> DataFrame:
    """(doc_id, n_words, list_share, redundancy, least_ends, is_candidate, is_spam) for every text with a word.

    redundancy is the greatest of the blocks' compression ratios, each divided by the usual one of its language and length over the corpus;
    least_ends the least sentence ends a word of its blocks. A candidate has redundancy above ``excess`` or ends below ``few_ends``;
    it is such a page if list_share is above ``share``. The usual ratios reach each text as one map; no text is shuffled.
    """
    m = cut(measure(docs, doc_id, text, lang), "measured")
    usual = usual_ratios(m).agg(F.map_from_entries(F.collect_list(F.struct(F.struct("lang", "bin"), "usual")))).scalar()
    out = m.filter("n_words > 0").withColumn("__usual", usual)
    ratio = lambda b: b["ratio"] / F.col("__usual")[F.struct(F.col("lang"), b["bin"].alias("bin"))]
    out = out.withColumns({"redundancy": F.array_max(F.transform("blocks", ratio)), "least_ends": F.array_min(F.transform("blocks", lambda b: b["ends"])), "list_share": F.col("n_loose") / F.col("n_words")})
    out = out.withColumn("is_candidate", (F.col("redundancy") > excess) | (F.col("least_ends") < few_ends))
    return out.withColumn("is_spam", F.col("is_candidate") & (F.col("list_share") > share)).select(doc_id, "n_words", "list_share", "redundancy", "least_ends", "is_candidate", "is_spam")
