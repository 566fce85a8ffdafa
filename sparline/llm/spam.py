"""Keyword-stuffed pages and link lists, by block-wise redundancy and the lack of sentences.

A text is taken in segments (lines, sentences, pieces of long lines). Each block of
segments has a compression ratio, which is set against the usual ratio of blocks of that
length and language over the whole corpus, and a density of ended sentences. A block
that is far more redundant than usual, or has far fewer sentence ends than prose has, is
suspect; no other block counts. The two measures alone also mark logs, tables, code and
formulaic prose, so the form of the segments confirms a suspect block: machine text
(code, data, logs, quotes), sentences, links, or words without a sentence around them;
and the spam of a text is what is formed like links or strung words in suspect blocks,
or like sentences that repeat a phrase over and over in redundant ones.
"""

from __future__ import annotations

import html
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparline.llm.mixing import language_key
from sparline.session import cut

#: Frequent function words of English, German, French and Spanish.
FUNCTION_WORDS = frozenset(
    """
    a an the and or but if then than that this these those there it its is are was were be been being has have had do does did not no only
    of in on at by for from to with without into out over under after before between because while when where which who what how we you i
    they he she my your our their should would could can may will more most too as so yet both each every here now still again
    der die das den dem des ein eine einen einem einer und oder aber wenn dann dass ist sind war wird werden wurde hat haben nicht nur noch
    von in im am auf aus bei mit nach zu zum zur für über unter vor durch sich wir sie er es als wie ihr ihre seinem
    le la les un une des du de et ou mais si que qui quand dont où est sont était être a ont pas ne plus pour par avec sans dans sur sous
    avant après entre il elle nous vous ils elles son sa ses leur au aux ce cette ces mais seulement puis
    el los las una unos unas y o pero si que quien cuando donde es son era ser está han ha no más para por con sin en sobre bajo antes
    después entre se su sus lo al del este esta estos como solo ya hay cada
    """.split()
)

_FUNCTION = frozenset(w.encode() for w in FUNCTION_WORDS)

_ZERO_WIDTH = re.compile("[\u200b-\u200f\u2060\ufeff\u00ad]")
_SPELLED = re.compile(r"(?<!\S)\w(?: \w){2,}(?!\S)")
_LINK = re.compile(
    r"<a\s[^>]*>[^<]*</a>|\[[^\]]*\]\(https?://[^)\s]*\)|https?://\S+|(?<![\w./@-])(?:www\.)?[a-z0-9-]+(?:\.[a-z0-9-]+)*\.[a-z]{3,}(?:/[^\s,;|]*)?(?![\w(.:@-])"
)
#: Marks of machine text (identifiers of programs, calls, keys of records, times, paths), each searched for only where its sign stands.
_CAMEL = re.compile(r"[a-z][A-Z]")
_SIGNED = [
    (sign, re.compile(pattern))
    for sign, pattern in (("_", r"\w_\w"), ("(", r"\w\("), (":", r"\d\d:\d\d|\"\w+\":|\w:\d+\.\d+\.\d"), ("/", r"\w/\w+/\w"), ("0x", r"\b0x[0-9a-f]"), ("+-", r"\+-\s"))
]
#: What quotes, diffs and comments begin with, and the first words of statements.
_BEGIN = (">", "+", "@", "#", "$", "%", "//", "/*", "*/", "*@", "* @", "---")
_STATEMENT = re.compile(r"(?:import|package|return|throw|public|private|static|final|def|class|using|include)\s[^,;]*;$")
#: Runs of tags of products: no colours, no lines of a preprocessor, no members of classes; a piece of a long run may begin inside a tag.
_TAGS = re.compile(
    r"(?<![\w#&])(?:#(?!(?:[0-9a-fA-F]{3,8}|include|define|undef|ifn?def|if|el(?:se|if\w*)|endif|error|warning|line|pragma|import|using|(?:end)?region)\b)[^\W\d]\w*)+|^\w+(?:\s*#[^\W\d]\w*){3,}"
)
_SENTENCE_END = re.compile(r"[.!?…][\"')\]]*\s+")
_COMMA = re.compile(r",\s")
_GAP = re.compile(r"\s{2,}")
_DOTTED = re.compile(r"[a-z0-9-]\.[a-z]{3}")
_WORD = re.compile(r"[^\W\d_]+")

#: Segments longer than this are taken in pieces, cut at white space.
SEGMENT = 240
#: Characters of a block, before its end is moved to that of a segment.
BLOCK = 800
#: A block is redundant if it compresses to less than this part of the usual, or than this of itself, as no prose does.
REDUNDANT = 0.85
EXTREME = 0.2
#: Ended sentences per 1,000 characters below which a block is suspect: about half of what prose has.
SENTENCES = 6.0
#: The part of a text's characters above which it is spam.
SPAM_SHARE = 0.5
#: Blocks that a language needs for a usual ratio of its own.
FEW = 50
MACHINE, SENTENCE, LINKS, WORDS, STUFFED = range(5)


def plain(text: str) -> str:
    """Text without entities and invisible characters, with words that are spelled letter by letter joined."""
    text = html.unescape(text) if "&" in text else text
    text = text if text.isascii() else _ZERO_WIDTH.sub("", text)
    return _SPELLED.sub(lambda m: m.group().replace(" ", "").lower(), text)


def _sentences(text: str) -> Iterator[str]:
    for line in text.split("\n"):
        begin = 0
        for m in _SENTENCE_END.finditer(line):
            yield line[begin : m.start() + 1]
            begin = m.end()
        yield line[begin:]


def segments(text: str) -> list[str]:
    out = []
    for s in _sentences(text):
        begin = 0
        while len(s) - begin > SEGMENT:
            at = s.rfind(" ", begin + SEGMENT // 2, begin + SEGMENT)
            at = at if at > 0 else begin + SEGMENT
            out.append(s[begin:at])
            begin = at
        rest = s[begin:] if begin else s
        if rest and not rest.isspace():
            out.append(rest)
    return out


def _stuffed(words: list[bytes]) -> bool:
    """A pair of words three times or more, over a fifth of a sentence."""
    if len(words) < 8 or len(words) - len(set(words)) < 3:
        return False
    pairs: dict[tuple[bytes, bytes], int] = {}
    for p in zip(words, words[1:]):
        pairs[p] = pairs.get(p, 0) + 1
    most = max(pairs.values())
    return most >= 3 and 2 * most >= 0.2 * len(words)


def _machine(text: str) -> bool:
    """Code, configuration, data, logs, quotes and diffs."""
    if "=" in text or "{" in text or "}" in text or "\\" in text or ");" in text or _CAMEL.search(text):
        return True
    for sign, pattern in _SIGNED:
        if sign in text and pattern.search(text):
            return True
    bare = text.strip()
    return bare.startswith(_BEGIN) or (bare[:1] == "|" == bare[-1:] and len(bare) > 1) or (bare[-1:] == ";" and _STATEMENT.match(bare) is not None)


#: ASCII letters as they are in lower case, all else as blanks.
_LETTERS = bytes(i + 32 if 65 <= i <= 90 else i if 97 <= i <= 122 else 32 for i in range(256))


def _words(text: str) -> list[bytes]:
    """Runs of letters, in lower case."""
    if text.isascii():
        return text.encode().translate(_LETTERS).split()
    return [w.encode() for w in _WORD.findall(text.lower())]


def _tagged(segment: str) -> bool:
    """Nothing but tags, or two tags or more over half of the segment and no machine text beside them."""
    tags = _TAGS.findall(segment)
    rest = _TAGS.sub(" ", segment)
    if not rest.strip(" \t\r\n,;|#"):
        return bool(tags)
    return sum(t.count("#") for t in tags) >= 2 and 2 * sum(map(len, tags)) > len(segment.strip()) and not _machine(rest)


def _links(segment: str) -> list[str]:
    return _LINK.findall(segment) if "://" in segment or "<a" in segment or _DOTTED.search(segment) else []


def _separators(segment: str) -> int:
    n = sum(map(segment.count, ";|•·*")) + segment.count(" - ") + segment.count(" / ")
    return n + (len(_COMMA.findall(segment)) if "," in segment else 0) + (len(_GAP.findall(segment)) if "  " in segment or "\t" in segment else 0)


def form(segment: str) -> int:
    """What a segment is formed like."""
    links = _links(segment)
    covered = sum(map(len, links))
    rest = _LINK.sub(" ", segment) if links else segment
    words = _words(rest)
    n, function = len(words), sum(map(_FUNCTION.__contains__, words))
    if links and (covered * 2 > len(segment.strip()) or n <= 5 * len(links)) and function * 2 <= n:
        return LINKS
    if "#" in rest and _tagged(rest):
        return WORDS
    if _machine(rest):
        return SENTENCE if n >= 5 and function * 4 >= n else MACHINE
    # Prose has function words, ends its sentences and sets few separators between its words.
    if n < 4 or function * 4 < n:
        return WORDS
    if function * 2 < n:
        ended = n >= 8 or segment.rstrip()[-1] in ".!?…:"
        if not ended or 4 * _separators(segment) >= n:
            return WORDS
    return STUFFED if _stuffed(words) else SENTENCE


@dataclass
class Block:
    """chars: length of the segments by form; stops: sentences that end."""

    ratio: float
    stops: int
    chars: list[int]


def blocks(text: str) -> list[Block]:
    """Blocks of about ``BLOCK`` characters with compression ratio, sentence ends and the forms of their segments."""
    out: list[Block] = []
    held: list[str] = []
    size = 0
    parts = segments(plain(text))
    for i, s in enumerate(parts):
        held.append(s)
        size += len(s)
        if size >= BLOCK or i + 1 == len(parts):
            body = " ".join(held).lower().encode()
            chars = [0] * 5
            for h in held:
                chars[form(h)] += len(h)
            out.append(Block(len(zlib.compress(body, 6)) / len(body), sum(h.rstrip()[-1] in ".!?…" for h in held), chars))
            held, size = [], 0
    return out


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        ids, langs, rows = [], [], []
        for ident, lang, text in zip(b.column("__id").to_pylist(), b.column("lang").to_pylist(), b.column("__text")):
            for x in blocks(text.as_py()):
                ids.append(ident)
                langs.append(lang)
                rows.append((sum(x.chars), x.stops, x.chars[SENTENCE], x.chars[LINKS] + x.chars[WORDS], x.chars[STUFFED], x.ratio))
        table = np.array(rows, dtype=np.float64).reshape(-1, 6)
        whole = [pa.array(table[:, i].astype(np.int32)) for i in range(5)]
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids, b.column("__id").type), pa.array(langs, pa.string()), *whole, pa.array(table[:, 5])],
            ["__id", "lang", "n_chars", "stops", "sentence", "listed", "stuffed", "ratio"],
        )


def spam_blocks(df: DataFrame, ident: str, text: str, lang: str) -> DataFrame:
    """A row per block of every text: ``ident``, lang, n_chars, stops, the characters by form, ratio and ``redundancy``.

    redundancy is the ratio in proportion to the median ratio of blocks of the same
    language and, in powers of two, length; a language with fewer than ``FEW`` such
    blocks is measured against all languages.
    """
    kind = dict(df.dtypes)[ident]
    texts = df.where(F.length(F.trim(F.col(text))) > 0)
    texts = texts.select(F.col(ident).alias("__id"), language_key(F.col(lang)).alias("lang"), F.col(text).alias("__text"))
    schema = f"__id {kind}, lang string, n_chars int, stops int, sentence int, listed int, stuffed int, ratio double"
    measured = cut(texts.mapInArrow(_measure, schema)).withColumn("__size", F.floor(F.log2("n_chars")))
    usual = measured.groupBy("__size", "lang").agg(F.percentile_approx("ratio", 0.5, 1000).alias("__usual"), F.count(F.lit(1)).alias("__n"))
    overall = measured.groupBy("__size").agg(F.percentile_approx("ratio", 0.5, 1000).alias("__overall"))
    usual = F.broadcast(usual.where(F.col("__n") >= FEW).drop("__n"))  # languages x 32 sizes at most
    out = measured.join(usual, ["__size", "lang"], "left").join(F.broadcast(overall), "__size")
    out = out.withColumn("redundancy", F.col("ratio") / F.coalesce("__usual", "__overall"))
    return out.drop("__size", "__usual", "__overall").withColumnRenamed("__id", ident)


def spam(df: DataFrame, ident: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """Texts in which more than half of the characters are strung keywords, links or tags.

    Returns ``ident``, n_chars (without what is invisible), spam_share, redundancy (the
    mean over the blocks, by length) and stops_per_1000 (ended sentences). Only blocks
    that are redundant or have few ended sentences count: with their links and words
    without sentences and, if they are redundant, with sentences that repeat a phrase.
    Texts that are null, empty or blank are
    no spam; repeated texts count each, so ids should be unique (rows with equal ids are
    taken as parts of one text). Texts of any length are read whole.
    """
    b = spam_blocks(df, ident, text, lang)
    redundant = (F.col("redundancy") < REDUNDANT) | (F.col("ratio") < EXTREME)
    few_sentences = F.col("stops") * 1000 < F.col("n_chars") * SENTENCES
    bad = F.when(redundant, F.col("listed") + F.col("stuffed")).when(few_sentences, F.col("listed")).otherwise(0)
    n = F.sum("n_chars")
    per = b.groupBy(ident).agg(
        n.alias("n_chars"), (F.sum(bad) / n).alias("spam_share"), (F.sum(F.col("redundancy") * F.col("n_chars")) / n).alias("redundancy"),
        (F.sum("stops") * 1000 / n).alias("stops_per_1000"),
    )
    return per.where(F.col("spam_share") > SPAM_SHARE)
