"""Commits as marked-up text with a registry of spans; tokens, truncation, perturbation.

lines: commit_id, path, file_ordinal, hunk_ordinal, line_ordinal, change_type, raw_text,
line_id; hunks are identified by (commit_id, path, hunk_ordinal).
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparline.functions.text import TOKEN_PATTERN, token_count

#: The markers of the markup and the categories of payloads.
MARKERS = {"message": "[MSG]", "file": "[FILE]", "hunk": "[HUNK]", "added": "[ADD]", "deleted": "[DEL]", "context": "[CTX]"}
CATEGORY = {"message": "COMMIT_MESSAGE", "file": "FILE_PATH", "hunk": "HUNK_HEADER", "added": "ADDED_CODE", "deleted": "DELETED_CODE", "context": "CONTEXT_CODE"}


def _of(kind: Column, values: dict[str, str]) -> Column:
    return F.create_map(*(F.lit(x) for kv in values.items() for x in kv))[kind]


def segments(messages: DataFrame, hunks: DataFrame, lines: DataFrame) -> DataFrame:
    """The payloads of every commit in order: commit_id, sort keys, kind, payload, line_id.

    messages: commit_id, message; hunks: commit_id, path, file_ordinal, hunk_ordinal, header.
    """
    none = F.lit(None).cast("string")
    key = lambda f, h, n: F.struct(f.alias("file"), h.alias("hunk"), n.alias("line"))
    low = F.lit(-1)
    text = F.regexp_replace(F.coalesce("message", F.lit("")), r"\n$", "")
    a = messages.select("commit_id", key(low, low, low).alias("place"), F.lit("message").alias("kind"), text.alias("payload"), none.alias("line_id"))
    files = hunks.groupBy("commit_id", "path").agg(F.min("file_ordinal").alias("f"))
    b = files.select("commit_id", key(F.col("f"), low, low).alias("place"), F.lit("file").alias("kind"), F.col("path").alias("payload"), none.alias("line_id"))
    c = hunks.select("commit_id", key(F.col("file_ordinal"), F.col("hunk_ordinal"), low).alias("place"), F.lit("hunk").alias("kind"), F.col("header").alias("payload"), none.alias("line_id"))
    d = lines.select(
        "commit_id", key(F.col("file_ordinal"), F.col("hunk_ordinal"), F.col("line_ordinal")).alias("place"), F.col("change_type").alias("kind"),
        F.coalesce("raw_text", F.lit("")).alias("payload"), "line_id",
    )
    return a.unionByName(b).unionByName(c).unionByName(d)


def spans(parts: DataFrame) -> DataFrame:
    """Adds char_start and char_end of each payload in the rendered text, segment (its rank) and category.

    A segment is its marker, a blank, the payload and a line feed; offsets are a running
    sum of lengths.
    """
    width = F.length(_of(F.col("kind"), MARKERS)) + F.length("payload") + 2
    w = Window.partitionBy("commit_id").orderBy("place")
    before = F.coalesce(F.sum(width).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = parts.withColumns({"segment": F.row_number().over(w) - 1, "__at": before})
    start = F.col("__at") + F.length(_of(F.col("kind"), MARKERS)) + 1
    return rows.withColumns({"char_start": start, "char_end": start + F.length("payload"), "category": _of(F.col("kind"), CATEGORY)}).drop("__at", "place")


def rendered(parts: DataFrame) -> DataFrame:
    """commit_id, text: the segments in order. A commit's text is one value, as any consumer takes it."""
    piece = F.concat(_of(F.col("kind"), MARKERS), F.lit(" "), F.col("payload"), F.lit("\n"))
    held = parts.groupBy("commit_id").agg(F.array_sort(F.collect_list(F.struct("place", piece.alias("t")))).alias("__p"))
    return held.select("commit_id", F.array_join(F.transform("__p", lambda p: p["t"]), "").alias("text"))


def tokens(texts: DataFrame, ident: str, text: str, pattern: str = TOKEN_PATTERN) -> DataFrame:
    """ident, token_index, token, start, end (character offsets) of every token of the pattern.

    Tokens that can't hold white space: the text is split at each boundary, offsets are
    running sums of lengths.
    """
    pieces = F.regexp_extract_all(F.col(text), F.lit(f"(?:{pattern})|[ \\t\\r\\n]+"), 0)
    flat = texts.select(ident, F.posexplode(pieces).alias("__i", "token"))
    w = Window.partitionBy(ident).orderBy("__i").rowsBetween(Window.unboundedPreceding, 0)
    placed = flat.withColumn("end", F.sum(F.length("token")).over(w)).withColumn("start", F.col("end") - F.length("token"))
    kept = placed.where(~F.col("token").rlike(r"^[ \t\r\n]"))
    return kept.select(ident, (F.row_number().over(Window.partitionBy(ident).orderBy("__i")) - 1).alias("token_index"), "token", "start", "end")


def token_segments(regions: DataFrame, ident: str = "commit_id") -> DataFrame:
    """Adds to ``spans`` n_tokens of each segment, its marker's included, and token_from, those before it.

    Segments end in a line feed, so no token crosses into another: all that concerns tokens
    follows from the segments, and no text is put together to be taken apart again.
    """
    count = token_count(_of(F.col("kind"), MARKERS)) + token_count(F.col("payload"))
    w = Window.partitionBy(ident).orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    return regions.withColumn("n_tokens", count).withColumn("token_from", F.coalesce(F.sum("n_tokens").over(w), F.lit(0)))


_TOKEN = re.compile(TOKEN_PATTERN)


def segment_tokens(segments_: DataFrame, ident: str = "commit_id") -> DataFrame:
    """ident, token_index, token, start, end, n_owners, owner and mapping of all tokens, from ``token_segments``.

    A token of the payload of a line is that line's, others have no owner: what
    ``token_owners`` finds by an interval join, without one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = zip(*(b.column(c).to_pylist() for c in (ident, "kind", "payload", "line_id", "char_start", "token_from")))
            out: list[tuple] = []
            for key, kind, payload, line, at, index in rows:
                marker = MARKERS[kind]
                head = [(at - len(marker) - 1, m, None) for m in _TOKEN.finditer(marker)]
                for i, (base, m, owner) in enumerate([*head, *((at, m, line) for m in _TOKEN.finditer(payload))]):
                    out.append((key, index + i, m.group(), base + m.start(), base + m.end(), int(owner is not None), owner, "UNMAPPED" if owner is None else "MAPPED"))
            columns = list(zip(*out)) if out else [()] * 8
            kinds = (b.schema.field(ident).type, pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], [ident, *names])

    names = ["token_index", "token", "start", "end", "n_owners", "owner", "mapping"]
    kind = dict(segments_.dtypes)[ident]
    schema = f"{ident} {kind}, token_index bigint, token string, start bigint, end bigint, n_owners int, owner string, mapping string"
    rows = segments_.select(ident, "kind", "payload", "line_id", F.col("char_start").cast("bigint").alias("char_start"), F.col("token_from").cast("bigint").alias("token_from"))
    return rows.mapInArrow(run, schema)


def truncate_segments(segments_: DataFrame, max_tokens: int, reserve: int, ident: str = "commit_id") -> DataFrame:
    """``truncate`` from ``token_segments``: only the segment in which the budget ends is looked into."""
    budget = max_tokens - reserve
    marker = _of(F.col("kind"), MARKERS)
    at = F.lit(budget - 1) - F.col("token_from")  # index of the last token of the budget in its segment
    ends = lambda text, n: F.aggregate(F.slice(F.regexp_extract_all(text, F.lit(f"[ \\t\\r\\n]*(?:{TOKEN_PATTERN})"), 0), F.lit(1), n), F.lit(0), lambda s, x: s + F.length(x))
    in_marker = at < token_count(marker)
    start = F.col("char_start") - F.length(marker) - 1
    end = F.when(in_marker, start + ends(marker, at + 1)).otherwise(F.col("char_start") + ends(F.col("payload"), at - token_count(marker) + 1))
    moved = ~in_marker & F.col("line_id").isNotNull()
    hit = segments_.where((F.col("token_from") < budget) & (F.col("token_from") + F.col("n_tokens") >= budget))
    cuts = hit.select(ident, F.when(moved, F.col("char_start")).otherwise(end).cast("bigint").alias("__cut"), F.when(moved, F.col("token_from") + token_count(marker)).otherwise(budget).alias("__kept"))
    sizes = segments_.groupBy(ident).agg(F.sum("n_tokens").alias("n_tokens"))
    over = F.col("n_tokens") > budget
    out = sizes.join(cuts, ident, "left")
    return out.select(ident, "n_tokens", over.alias("truncated"), F.when(over, F.col("__cut")).alias("cut_char"), F.when(over, F.col("__kept")).otherwise(F.col("n_tokens")).alias("n_kept"))


def token_owners(toks: DataFrame, regions: DataFrame, ident: str = "commit_id") -> DataFrame:
    """Each token with the spans it overlaps: n_owners, owner (the only one's line_id), mapping MAPPED, UNMAPPED or ERROR.

    An interval join: spans do not overlap each other, so a token's candidates are the last
    span that starts before the token ends and those inside it. Tokens and spans are merged
    in one sort per text instead of compared pairwise.
    """
    t = toks.select(ident, F.col("start").alias("__a"), F.col("end").alias("__b"), "token_index", F.lit(1).alias("__kind"), F.lit(None).cast("string").alias("line_id"), F.lit(None).cast("bigint").alias("__e"))
    s = regions.select(ident, F.col("char_start").cast("bigint").alias("__a"), F.col("char_end").cast("bigint").alias("__b"), F.lit(None).cast("int").alias("token_index"), F.lit(0).alias("__kind"), "line_id", F.col("char_end").cast("bigint").alias("__e"))
    both = t.withColumns({"__a": F.col("__a").cast("bigint"), "__b": F.col("__b").cast("bigint")}).unionByName(s).where("__b > __a")
    key = F.when(F.col("__kind") == 0, F.struct(F.col("__a").alias("x"), F.lit(1).alias("y"))).otherwise(F.struct(F.col("__b").alias("x"), F.lit(0).alias("y")))
    w = Window.partitionBy(ident).orderBy(key).rowsBetween(Window.unboundedPreceding, 0)
    last = F.last(F.when(F.col("__kind") == 0, F.struct("__a", "__e", "line_id")), True).over(w)
    ends = F.count(F.when(F.col("__kind") == 0, F.lit(1))).over(w)  # spans that start before the token ends
    rows = both.withColumns({"__s": last, "__started": ends})
    done = Window.partitionBy(ident).orderBy(F.when(F.col("__kind") == 0, F.struct(F.col("__e").alias("x"), F.lit(0).alias("y"))).otherwise(F.struct(F.col("__a").alias("x"), F.lit(1).alias("y")))).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("__ended", F.count(F.when(F.col("__kind") == 0, F.lit(1))).over(done)).where("__kind = 1")
    n = F.col("__started") - F.col("__ended")
    mapping = F.when(n == 0, "UNMAPPED").when(n == 1, "MAPPED").otherwise("ERROR")
    return rows.select(ident, "token_index", n.alias("n_owners"), F.when(n == 1, F.col("__s.line_id")).alias("owner"), mapping.alias("mapping"))


def truncate(toks: DataFrame, regions: DataFrame, max_tokens: int, reserve: int, ident: str = "commit_id") -> DataFrame:
    """Whole-segment prefix truncation: per text n_tokens, truncated, cut_char, n_kept.

    The cut is the end of the last token of the budget; if it falls inside a payload of
    code it moves to that payload's start. Tokens that end by the cut are kept.
    """
    budget = max_tokens - reserve
    sizes = toks.groupBy(ident).agg(F.count(F.lit(1)).alias("n_tokens"), F.max(F.when(F.col("token_index") == budget - 1, F.col("end"))).alias("__at"))
    cutting = sizes.where(F.col("n_tokens") > budget).select(ident, F.coalesce("__at", F.lit(0)).alias("__at"))
    hit = regions.join(cutting, ident).where((F.col("char_start") < F.col("__at")) & (F.col("__at") <= F.col("char_end")) & F.col("line_id").isNotNull())
    moved = hit.groupBy(ident).agg(F.min("char_start").alias("__moved"))
    cuts = cutting.join(moved, ident, "left").select(ident, F.coalesce("__moved", "__at").alias("cut_char"))
    kept = toks.join(cuts, ident).where(F.col("end") <= F.col("cut_char")).groupBy(ident).agg(F.count(F.lit(1)).alias("__kept"))
    out = sizes.drop("__at").join(cuts, ident, "left").join(kept, ident, "left")
    cut_ = F.col("n_tokens") > budget
    return out.select(ident, "n_tokens", cut_.alias("truncated"), "cut_char", F.when(cut_, F.coalesce("__kept", F.lit(0))).otherwise(F.col("n_tokens")).alias("n_kept"))


def dropped_lines(regions: DataFrame, cuts: DataFrame, ident: str = "commit_id") -> DataFrame:
    """Lines whose payload starts at or after the cut of their text."""
    return regions.where(F.col("line_id").isNotNull()).join(cuts.where("truncated"), ident).where(F.col("char_start") >= F.col("cut_char")).select(ident, "line_id")


def blank_lines(record: Column, ids: Column) -> Column:
    """Lines (array of structs with raw_text and stable_line_id) with the text of the listed ids blanked."""
    return F.transform(record, lambda x: F.when(F.array_contains(ids, x["stable_line_id"]), x.withField("raw_text", F.lit(""))).otherwise(x))


def delete_lines(record: Column, ids: Column) -> Column:
    return F.filter(record, lambda x: x["stable_line_id"].isNull() | ~F.array_contains(ids, x["stable_line_id"]))


def restore_lines(blanked: Column, original: Column, ids: Column) -> Column:
    """Blanked lines with the texts of the listed ids as in the original, which has the same lines in the same order."""
    return F.zip_with(blanked, original, lambda b, o: F.when(F.array_contains(ids, o["stable_line_id"]), o).otherwise(b))


def swap_changes(record: Column) -> Column:
    """Added lines as deleted ones and the other way round."""
    swapped = lambda c: F.when(c == "added", "deleted").when(c == "deleted", "added").otherwise(c)
    return F.transform(record, lambda x: x.withField("change_type", swapped(x["change_type"])))


def chat_messages(system: str, content: Column) -> Column:
    return F.array(F.struct(F.lit("system").alias("role"), F.lit(system).alias("content")), F.struct(F.lit("user").alias("role"), content.alias("content")))


def blank_markers(text: Column, markers: Sequence[str] = tuple(MARKERS.values())) -> Column:
    """Every marker replaced by as many blanks, so offsets stay."""
    for m in markers:
        text = F.replace(text, F.lit(m), F.lit(" " * len(m)))
    return text


def nested_records(lines: DataFrame) -> DataFrame:
    """commit_id, files: array of (path, file_ordinal, hunks: array of (hunk_ordinal, lines: array of structs)), all in order.

    Nested from the inside out, so that only a hunk's lines, then a file's hunks, then a
    commit's files come together.
    """
    rest = [c for c in lines.columns if c not in ("commit_id", "path", "file_ordinal", "hunk_ordinal")]
    order = ["line_ordinal", *(c for c in rest if c != "line_ordinal")]
    h = lines.groupBy("commit_id", "path", "file_ordinal", "hunk_ordinal").agg(F.array_sort(F.collect_list(F.struct(*order))).alias("lines"))
    f = h.groupBy("commit_id", "path", "file_ordinal").agg(F.array_sort(F.collect_list(F.struct("hunk_ordinal", "lines"))).alias("hunks"))
    return f.groupBy("commit_id").agg(F.array_sort(F.collect_list(F.struct("file_ordinal", "path", "hunks"))).alias("files"))


def flat_lines(records: DataFrame) -> DataFrame:
    """The lines of nested records with their file and hunk, the inverse of ``nested_records``."""
    f = records.select("commit_id", F.inline("files"))
    h = f.select("commit_id", "path", "file_ordinal", F.inline("hunks"))
    return h.select("commit_id", "path", "file_ordinal", "hunk_ordinal", F.inline("lines"))


def supervised(tokens: Column, label: Column) -> tuple[Column, Column]:
    """Inputs (tokens and the label) and targets (-100 on all but the label) of one example."""
    return F.concat(tokens, F.array(label)), F.concat(F.array_repeat(F.lit(-100), F.size(tokens)), F.array(label))


def padded(tokens: Column, width: Column, pad: int) -> Column:
    """Tokens filled up on the right to ``width``."""
    return F.concat(tokens, F.array_repeat(F.lit(pad), (F.greatest(F.lit(0), width - F.size(tokens))).cast("int")))


def warmup_rate(step: Column, warmup: int, total: int) -> Column:
    """Part of the peak learning rate: up in a line, then down to 0 at ``total``."""
    down = F.greatest(F.lit(0.0), (F.lit(float(total)) - step) / F.lit(float(max(1, total - warmup))))
    return F.when(step < warmup, step / F.lit(float(max(1, warmup)))).otherwise(down)


#: How a prompt marks the turns of a chat.
TURNS = ("<|system|>\n", "\n<|user|>\n", "\n<|end|>\n<|assistant|>\n")


def chat_prompt(system: str, content: Column) -> tuple[Column, Column]:
    """(prompt, offset of the content in it); the offset is null for an empty content or one that stands there several times."""
    head = f"{TURNS[0]}{system}{TURNS[1]}"
    prompt = F.concat(F.lit(head), content, F.lit(TURNS[2]))
    times = (F.length(prompt) - F.length(F.replace(prompt, content, F.lit("")))) / F.length(content)
    return prompt, F.when((content != "") & (times == 1), F.instr(prompt, content) - 1)


def truncated_text(texts: DataFrame, cuts: DataFrame, ident: str = "commit_id", text: str = "text") -> DataFrame:
    """The texts up to the cut of ``truncate``; whole where nothing was cut."""
    rows = texts.join(cuts.select(ident, "cut_char"), ident, "left")
    short = F.substr(text, F.lit(1), F.col("cut_char").cast("int"))
    return rows.select(ident, F.when(F.col("cut_char").isNull(), F.col(text)).otherwise(short).alias(text))


def leaks(text: Column, markers: Sequence[str]) -> Column:
    """Whether any of the forbidden markers stands in the text."""
    found = F.lit(False)
    for m in markers:
        found = found | F.contains(text, F.lit(m))
    return found


def token_map(owners: DataFrame, ident: str, length: int) -> DataFrame:
    """ident, token_map: (owner, category) of the first ``length`` tokens in order, filled up with PADDING.

    owners: as ``token_owners`` gives them. The category is CODE for an owned token, ERROR
    for one of several owners, else MARKUP.
    """
    category = F.when(F.col("n_owners") == 1, "CODE").when(F.col("n_owners") > 1, "ERROR").otherwise("MARKUP")
    rows = owners.where(F.col("token_index") < length)
    held = rows.groupBy(ident).agg(F.array_sort(F.collect_list(F.struct("token_index", "owner", category.alias("category")))).alias("__t"))
    cells = F.transform("__t", lambda x: F.struct(x["owner"].alias("owner"), x["category"].alias("category")))
    pad = F.struct(F.lit(None).cast("string").alias("owner"), F.lit("PADDING").alias("category"))
    return held.select(ident, F.concat(cells, F.array_repeat(pad, F.lit(length) - F.size("__t"))).alias("token_map"))
