"""Keyword-stuffed pages, link lists and tag lists instead of sentences.

One pass over the whole texts measures each page; what is usual is then taken from all pages.

1. Redundancy. The text is cut into blocks of ``BLOCK`` bytes, each is compressed, and the ratio compressed/raw
   is averaged over the blocks by length. Short texts compress badly and languages differ, so the ratio is held
   against the pages of the same language and size (in half octaves up to a block): a page is flagged if it lies
   ``FLAG_AT`` deviations or more below their median. The deviation is taken from the upper quartile, which
   redundant pages can't widen.
2. Confirmation. Sentence ends count only where something new ends: within a block, a sentence is fed to one
   compressor after the other, and what it adds to the output is its cost. One that repeats what came before
   costs little more than a back reference, so "Buy X. Best X?" has no sentences. A flagged page is confirmed if
   sentences of that kind hold at most half of its text.
3. Exact check. Logs, tables, settings, code, change lists and chats are redundant and without sentences too. Their
   lines are told by form; the page is a case if what is left (neither sentences nor such lines) is most of it.

No list of words decides anything: without the compressor no page would be flagged and every stuffed sentence would
count as one. The usual values are a row per language and size class (bounded: 3 languages, 2 * log2(BLOCK) + 1 sizes).

Defined cases: rows without id are skipped; a null or empty text, and one of fewer than ``LEAST_WORDS`` words, is no
case; a null or unknown language is "other"; every copy of a case is a case, since the
result depends on the text, its language and corpus values alone; an empty
table gives no rows; columns other than id, text and language are never read.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ..plans.runtime import materialize

BLOCK = 4096
LEAST_WORDS = 12
#: A page is flagged at so many deviations below the median of its language and size.
FLAG_AT = 1.25
#: Fewer pages than these in a class: the nearest classes of any language join it.
CLASS_LEAST = 50
#: A sentence is new if it adds at least so many bytes, and such a part of its length, to the compressed block.
NEW_BYTES = 12
NEW_PART = 0.2
SENTENCE_WORDS = 4
#: Least part of the text that must be neither sentences nor machine text.
SPAM_PART = 0.5

_INVISIBLE = re.compile("[\u200b-\u200f\u2060\ufeff\u00ad]")
_LINK = re.compile(
    r"https?://\S+|www\s?(?:\.|\[\.\]|\(dot\)| dot )\s?\S+"
    r"|(?:[a-z0-9-]+\s?(?:\.|\[\.\]|\(\.\)|\s?\(dot\)\s?|\sdot\s|\s?\[dot\]\s?))+\s?(?:test|example|invalid|com|net|org|info|io|vn|biz|co|shop|site|online|xyz|top)\b(?:/\S*)?",
)
_MACHINE = re.compile(
    r"""^\s*(?:
      \[?\d{4}-\d\d-\d\d[T\s,]\s*\d\d:\d\d            # dated log line
    | \[?\d\d:\d\d(?::\d\d)?(?:[.,]\d+)?\]?\s          # clock log line or chat
    | file\s"|traceback|at\s[\w.$]+\(|\w*(?:error|exception)\b:  # traceback
    | --|```|\$\s|>>>|//                               # comment, fence, prompt
    | create\s|select\s|insert\s|update\s\w+\sset|alter\s|drop\s|from\s\w+\s(?:where|join)|\)\s?;
    | [\w.]+\s(?:text|bigint|int|integer|timestamp|date|boolean|numeric\(.*|varchar.*|decimal.*)(?:\s.*)?,?\s*$
    | [\w.-]+\s?[:=]\s?[\w."'/-]*\s*$                  # setting
    | [|+][-=|+\s]                                     # table rule
    | \|.*\|\s*$                                       # table row
    | [a-z_]+(?:,[a-z_]+){2,}$                         # table head
    | [-*+]\s(?:fix|add|change|remove|deprecate|security)\w*:
    | [-+]{3}\s|@@|diff\s
    | [{}\[\]"].*[{}\[\],"]\s*$                        # json
    )""",
    re.X,
)
#: An article of a price list, which looks like a table row.
_ARTICLE = re.compile(r"^\W*(?:no\.|item|ref|sku|art|mã|code|product|sp)\.?\s?#?\w*\d")
_FIELD = re.compile(r"[,;\t]")
_NUMBER = re.compile(r"^[\d\s.:/+-]*\d[\d\s.:/+-]*$")
_SENTENCE_GAP = re.compile(r"(?<=[.!?…])\s+(?=[^\W\d_]|\d)")
_ENDS = frozenset(".!?…")


def _is_row(line: str) -> bool:
    """A row of a table: three or more fields without a space after the mark, two fifths of them numbers."""
    fields = _FIELD.split(line)
    if len(fields) < 3 or ", " in line:
        return False
    return sum(bool(_NUMBER.match(f)) for f in fields) >= 0.4 * len(fields)


def _is_machine(s: str) -> bool:
    return bool((_MACHINE.match(s) or _is_row(s)) and not _ARTICLE.match(s) and not _LINK.search(s))


def normal(text: str) -> str:
    """Lower case, without invisible characters."""
    return _INVISIBLE.sub("", text).replace("\xa0", " ").replace("&amp;", "&").replace("&nbsp;", " ").lower()


def block_ratio(raw: bytes, block: int = BLOCK) -> float:
    """Compressed to raw size, over blocks of equal weight per byte."""
    return sum(len(zlib.compress(raw[i : i + block], 1)) for i in range(0, len(raw), block)) / len(raw) if raw else 1.0


def sentence_costs(text: str, block: int = BLOCK) -> Iterator[tuple[str, int, int]]:
    """Sentences of all lines with their bytes and what each adds to the compressed block it lies in."""
    packer, filled = zlib.compressobj(1, zlib.DEFLATED, -15), 0
    for line in text.split("\n"):
        for s in _SENTENCE_GAP.split(line):
            if s and not s.isspace():
                if filled >= block:
                    packer, filled = zlib.compressobj(1, zlib.DEFLATED, -15), 0
                raw = s.encode("utf-8", "replace")
                filled += len(raw)
                # less the mark of five bytes that ends each piece
                yield s, len(raw), len(packer.compress(raw)) + len(packer.flush(zlib.Z_SYNC_FLUSH)) - 5


def measures(text: object) -> tuple[int, int, float, float, float, float]:
    """Words, size class, block ratio, parts of the text in new sentences and in machine lines, new sentence ends a word."""
    t = normal(text) if isinstance(text, str) else ""
    words = len(t.split())
    raw = t.encode("utf-8", "replace")
    size_class = round(2 * math.log2(min(max(len(raw), 1), BLOCK)))
    if words < LEAST_WORDS:
        return words, size_class, 1.0, 0.0, 0.0, 0.0
    total = sound = machine = ends = 0
    for s, n, cost in sentence_costs(t):
        size = len(s) - s.count(" ")
        total += size
        if s.rstrip()[-1] in _ENDS and cost >= NEW_BYTES + NEW_PART * n and len(s.split()) >= SENTENCE_WORDS:
            sound += size
            ends += 1
        elif _is_machine(s):
            machine += size
    return words, size_class, block_ratio(raw), sound / max(total, 1), machine / max(total, 1), ends / words


_MEASURED = "doc_id bigint, lang string, n_words bigint, size_class int, ratio double, sentence_part double, machine_part double, ends_per_word double"


def language(c: Column, known: tuple[str, ...] = ("en", "vi")) -> Column:
    x = F.lower(F.trim(c))
    return F.when(x.isin(*known), x).otherwise("other")


def measured(docs: DataFrame) -> DataFrame:
    """A narrow row of measures per document, from the only pass over the texts."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            m = pd.DataFrame([measures(x) for x in b["text"]], columns=["n_words", "size_class", "ratio", "sentence_part", "machine_part", "ends_per_word"])
            yield pd.concat([b[["doc_id", "lang"]].reset_index(drop=True), m], axis=1)

    src = docs.where("doc_id is not null").select(F.col("doc_id").cast("bigint").alias("doc_id"), language(F.col("lang")).alias("lang"), "text")
    return src.mapInPandas(rows, _MEASURED)


def usual_ratios(m: DataFrame) -> DataFrame:
    """lang, size_class, median, deviation: what is usual for a language and size.

    The classes are collected: at most languages times sizes, whatever the corpus.
    """
    q = F.percentile_approx("ratio", F.array(F.lit(0.5), F.lit(0.75)), 10_000)
    rows = m.where(F.col("n_words") >= LEAST_WORDS).groupBy("lang", "size_class").agg(F.count(F.lit(1)).alias("n"), q.alias("q")).collect()
    out = []
    for r in rows:
        near, reach = [r], 0
        while sum(x["n"] for x in near) < CLASS_LEAST and len(near) < len(rows):
            reach += 1
            near = [x for x in rows if x is r or abs(x["size_class"] - r["size_class"]) < reach]
        n = sum(x["n"] for x in near)
        median = sum(x["n"] * x["q"][0] for x in near) / n
        out.append((r["lang"], r["size_class"], median, 1.4826 * sum(x["n"] * (x["q"][1] - x["q"][0]) for x in near) / n + 1e-3))
    return m.sparkSession.createDataFrame(out, "lang string, size_class int, median double, deviation double")


def judged_pages(docs: DataFrame) -> DataFrame:
    """doc_id, deviations (below the usual ratio, positive is redundant), flagged, confirmed, spam_part, is_spam: a row per document."""
    m = materialize(measured(docs), "measures")
    j = m.join(F.broadcast(usual_ratios(m)), ["lang", "size_class"], "left")
    below = F.coalesce((F.col("median") - F.col("ratio")) / F.col("deviation"), F.lit(0.0))
    flagged = (F.col("n_words") >= LEAST_WORDS) & (below >= FLAG_AT)
    confirmed = flagged & (F.col("sentence_part") <= 1 - SPAM_PART)
    spam = 1 - F.col("sentence_part") - F.col("machine_part")
    return j.select("doc_id", below.alias("deviations"), flagged.alias("flagged"), confirmed.alias("confirmed"), spam.alias("spam_part"), (confirmed & (spam > SPAM_PART)).alias("is_spam"))
