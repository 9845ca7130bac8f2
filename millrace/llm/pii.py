"""Personal data: base formats, and more identifiers by bootstrapped contextual extraction.

Entities of the base formats are the seeds. Words beside them and the shape of their characters are
lexical patterns. Any run of tokens with the digits or the marks of a kind, whatever its form, is a
candidate instance of it. Patterns and instances form a bipartite graph that is scored in rounds: a
pattern's score for a kind is the sum of the scores of that kind's instances beside it over the number of
those, accepted or not, and of the other kinds' seeds (so words and shapes that stand beside anything
score low, as do rare ones), an instance's score is that of its best pattern. Instances that trusted
patterns reach are accepted, and count as instances of their kind in the next round.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import deque
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import Scratch, bound_batches, row_keys, trim, with_keys, without_keys

#: Kinds in the order of ties.
KINDS = ("email", "ip", "card", "phone")
#: Rounds of the scoring, instances added to a pattern's count as a prior (so six that agree are the least that reach the trust), score that is trusted.
ROUNDS, PRIOR, TRUST = 3, 1.5, 0.8
#: Mentions that are handed on at once.
MENTIONS = 20_000
#: Characters beside a span in which a context word begins or ends; a word that they cut is taken whole.
REACH = 40

#: The base formats, anchored so that a search takes time in proportion to the text.
_domain = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_local_chars = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_dotted = re.compile(r"[0-9]+(?:\.[0-9]+)+")
_card = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_phone = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_any = re.compile(r"[0-9@]")

#: Runs that may have digits, cut behind the last; the most digits of a candidate in one, those of the longest card; an address with its signs written out.
_run = re.compile(r"[0-9+(\[][0-9+()\[\]./_\x20-]*")
_tokens = re.compile(r"[^\x20]+")
_digit = re.compile("[0-9]")
DIGITS = 19
_written = re.compile(r"(?:\x20?[\[(]at[\])]\x20?|\x20at\x20)(?=([A-Za-z0-9-]+(?:(?:\x20?[\[(]dot[\])]\x20?|\x20dot\x20|\.)[A-Za-z0-9-]+)+))")
_hint = re.compile(r"[\[(]at[\])]|\x20at\x20[^\x20]+(?:\x20dot\x20|\x20?[\[(]dot)")
_words = re.compile(r"[^\W\d_]+")


def _digits(s: str) -> str:
    return re.sub(r"[^0-9]", "", s)


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """``(start, kind, end)`` of the base formats, in order of start, then kind."""
    if not text or not _any.search(text):
        return []
    out, bound = [], 0
    for m in _domain.finditer(text) if "@" in text else ():
        start = m.start()
        while start > bound and text[start - 1] in _local_chars:
            start -= 1
        if start < m.start():
            out.append((start, 0, m.end()))
            bound = m.end()
    for m in _dotted.finditer(text):
        # from the first group on, every four groups are one match of the format
        at, groups = m.start(), m[0].split(".")
        for i in range(0, len(groups) - len(groups) % 4, 4):
            end = at + len(".".join(groups[i : i + 4]))
            if all(len(g.lstrip("0")) <= 3 and int(g.lstrip("0") or 0) <= 255 for g in groups[i : i + 4]):
                out.append((at, 1, end))
            at = end + 1
    for m in _card.finditer(text):
        if m.end() - m.start() >= 12 and 12 <= len(d := _digits(m[0])) <= 19 and luhn(d):
            out.append((m.start(), 2, m.end()))
    for m in _phone.finditer(text) if "+" in text else ():
        if 9 <= len(_digits(m[0])) <= 15:
            out.append((m.start(), 3, m.end()))
    return sorted(out)


def _kinds(part: str, digits: str) -> list[int]:
    """Kinds that a run of tokens may be of, by its digits alone."""
    out = []
    groups = re.findall("[0-9]+", part)
    if len(groups) == 4 and all(len(g) <= 3 and int(g) <= 255 for g in groups) and part[0].isdigit():
        out.append(1)
    if 12 <= len(digits) <= 19 and luhn(digits):
        out.append(2)
    if 7 <= len(digits) <= 17:
        out.append(3)
    return out


def loose_spans(text: str, base: list[tuple[int, int, int]]) -> Iterator[tuple[int, int, int]]:
    """``(start, kind, end)`` of candidates that touch no base span.

    A stretch of digits and signs between words and base spans is one candidate; if it cannot be any
    kind as a whole, it is cut from its start into the longest runs of tokens that can.
    """
    if not text or not (_any.search(text) or _hint.search(text)):
        return
    taken = sorted((s, e) for s, _, e in base)
    starts = [s for s, _ in taken]
    ends = list(accumulate((e for _, e in taken), max))  # the last end so far

    def possible(start: int, end: int) -> list[tuple[int, int, int]]:
        while not text[end - 1].isdigit():
            end -= 1
        while text[start] in ")]./_-":
            start += 1
        part = text[start:end]
        return [(start, kind, end) for kind in _kinds(part, _digits(part))]

    def within(low: int, high: int) -> Iterator[tuple[int, int, int]]:
        found = ((m.start(), m.end(), sum(map(m[0].count, "0123456789"))) for m in _tokens.finditer(text, low, high))
        window: deque[tuple[int, int, int]] = deque()  # tokens from a start on, until they hold more digits than a candidate may
        held, ended = 0, False
        while True:
            while not ended and held <= DIGITS:
                if (token := next(found, None)) is None:
                    ended = True
                else:
                    window.append(token)
                    held += token[2]
            if not window:
                return
            hit = 0
            if window[0][2] or text[window[0][0]] in "+([" and len(window) > 1 and window[1][2]:
                ends_at, digits = [], 0
                for j, (_, end, n) in enumerate(window):
                    if (digits := digits + n) > DIGITS:
                        break
                    if n:
                        ends_at.append((j, end))
                for j, end in reversed(ends_at):
                    if some := possible(window[0][0], end):
                        yield from some
                        hit = j + 1
                        break
            for _ in range(hit or 1):
                held -= window.popleft()[2]

    for run in _run.finditer(text):
        at, stop = run.span()
        while stop > at and text[stop - 1] not in "0123456789":  # a pattern that asks for the digit would search a run without one again from each of its signs
            stop -= 1
        if stop - at < 2:
            continue
        for k in range(max(0, bisect_left(starts, at) - 1), bisect_left(starts, stop)):
            if ends[k] > at:
                yield from within(at, starts[k])
                at = ends[k]
        yield from within(at, stop)
    if _hint.search(text):
        for m in _written.finditer(text):
            start, end = m.start(), m.end(1)
            if not re.search(r"dot|[\[(]at", text[start:end]):
                continue
            while start > 0 and text[start - 1] in _local_chars:
                start -= 1
            before = bisect_left(starts, end)
            if start < m.start() and (not before or ends[before - 1] <= start):
                yield start, 0, end


def contexts(text: str, start: int, end: int, kind: int) -> list[str]:
    """Lexical patterns of a span: the word before, the two words before, the word after, and the shape of its own characters (not of an email's)."""
    at = max(0, start - REACH)
    while at and text[at].isalpha() and text[at - 1].isalpha():
        at -= 1
    before = [w.lower() for w in _words.findall(text, at, start)]
    if after := _words.search(text, end, end + REACH):
        after = _words.match(text, after.start())
    out = ["L " + before[-1]] if before else []
    if len(before) > 1:
        out.append("LL " + " ".join(before[-2:]))
    if after:
        out.append("R " + after[0].lower())
    if kind:
        out.append("S " + re.sub(r"[0-9]", "d", text[start:end]))
    return out


_SPAN = pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())])
_MENTION = pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32()), ("instance", pa.string()), ("patterns", pa.list_(pa.string())), ("seed", pa.bool_())])


def _scan(docs: DataFrame) -> DataFrame:
    """One scan of the texts: base spans, and mentions with their contexts. A row without base spans (null) holds more mentions of a document that has another row."""

    names = ["doc_id", "did", "th", "base", "mentions"]

    def run(batches):
        for b in batches:
            rows, held = [], 0
            for *keys, text in zip(*(b.column(c).to_pylist() for c in ("doc_id", "did", "th", "text")), strict=True):
                base, mentions = base_spans(text), []
                spans = [dict(zip(("start", "kind", "end"), x, strict=True)) for x in base]
                for seed, found in ((True, base), (False, loose_spans(text, base))):
                    for s, k, e in found:
                        instance = text[s:e].lower() if k == 0 else _digits(text[s:e])
                        mentions.append({"start": s, "kind": k, "end": e, "instance": instance, "patterns": contexts(text, s, e, k), "seed": seed})
                        held += 1
                        if held >= MENTIONS:  # a text of many numbers gives several rows
                            rows.append((*keys, None, mentions))
                            yield batch(rows)
                            rows, mentions, held = [], [], 0
                rows.append((*keys, spans, mentions))
            yield batch(rows)
        trim()

    def batch(rows):
        types = pa.int64(), pa.int64(), pa.int64(), pa.list_(_SPAN), pa.list_(_MENTION)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [()] * 5, types, strict=True)], names)

    span = "start: int, kind: int, end: int"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), *row_keys(), "text").mapInArrow(
        run, f"doc_id long, did long, th long, base array<struct<{span}>>, mentions array<struct<{span}, instance: string, patterns: array<string>, seed: boolean>>"
    )


def _accepted(mentions: DataFrame, scratch: Scratch) -> DataFrame:
    """``kind, instance, score`` of the candidates that trusted patterns reach, and of the seeds, from ``mentions(kind, instance, patterns, seed)``.

    A word beside very many instances has one row in each aggregate and in ``patterns``; its edges meet
    that row in a join that adaptive execution splits.
    """
    each = mentions.select("kind", "instance", "seed", F.explode("patterns").alias("pattern"))
    edges = scratch.keep(each.groupBy("kind", "instance", "pattern").agg(F.max("seed").alias("seed")))
    seeds = scratch.keep(mentions.where("seed").select("kind", "instance").distinct().withColumn("score", F.lit(1.0)))
    counts = edges.groupBy("pattern", "kind").agg(F.count("*").alias("n"), F.count_if("seed").alias("s"))
    others = counts.groupBy("pattern").agg(F.sum("s").alias("all"))
    beside = scratch.keep(counts.where("s > 0 or n > 1").join(others, "pattern").select("pattern", "kind", (F.col("n") + F.col("all") - F.col("s")).alias("n")))
    scores = seeds
    for _ in range(ROUNDS):
        own = edges.join(scores, ["kind", "instance"]).groupBy("pattern", "kind").agg(F.sum("score").alias("own"))
        patterns = own.join(beside, ["pattern", "kind"]).select("pattern", "kind", (F.col("own") / (F.col("n") + PRIOR)).alias("trust")).where(F.col("trust") >= TRUST)
        reached = edges.where("not seed").join(patterns, ["pattern", "kind"]).groupBy("kind", "instance").agg(F.max("trust").alias("score"))
        scores = scratch.keep(seeds.unionByName(reached.join(seeds, ["kind", "instance"], "left_anti")))
    return scores


def _added(scanned: DataFrame, scratch: Scratch) -> DataFrame:
    """``did, th, added``: the spans that the method adds, per document; where accepted ones overlap, the best scored, then the longest, then the first."""
    mentions = scanned.select("did", "th", F.explode("mentions").alias("m")).select("did", "th", "m.*")
    span = "start: int, kind: int, end: int"
    if mentions.where("not seed").limit(1).count() == 0:
        return scratch.spark.createDataFrame([], f"did long, th long, added array<struct<{span}>>")
    # a candidate that is a seed elsewhere has the seed's score: it is the same identifier
    hits = mentions.where("not seed").join(_accepted(mentions, scratch), ["kind", "instance"])
    found = hits.groupBy("did", "th").agg(F.collect_set(F.struct("start", "kind", "end", "score")).alias("hits"))

    def choose(batches):
        for b in batches:
            out = []
            for row in b.column("hits").to_pylist():
                taken: list[dict] = []
                starts: list[int] = []
                for h in sorted(row, key=lambda h: (-h["score"], h["start"] - h["end"], h["start"], h["kind"])):
                    at = bisect_left(starts, h["start"])
                    if (at == len(starts) or h["end"] <= starts[at]) and (not at or taken[at - 1]["end"] <= h["start"]):
                        starts.insert(at, h["start"])
                        taken.insert(at, {"start": h["start"], "kind": h["kind"], "end": h["end"]})
                out.append(taken)
            yield pa.RecordBatch.from_arrays([b.column("did"), b.column("th"), pa.array(out, pa.list_(_SPAN))], ["did", "th", "added"])

    return scratch.keep(found.mapInArrow(choose, f"did long, th long, added array<struct<{span}>>"))


def find(docs: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """Personal data in every whole text of ``docs(doc_id, text)``.

    Offsets are code points, ends exclusive. A null or empty text has no spans; repeated rows are
    searched each; a very long text is searched whole; an empty table gives no rows. Rows are told
    apart by id and text, so a null or repeated id does no harm. Other columns are ignored.
    Returns ``doc_id, base, added``: arrays of ``(start, kind, end)``, kind an index into KINDS.
    """
    bound_batches(docs.sparkSession)
    scratch = scratch or Scratch(docs.sparkSession, "pii")
    scanned = scratch.keep(_scan(docs))
    none = F.array().cast("array<struct<start: int, kind: int, end: int>>")
    out = scanned.where("base is not null").join(_added(scanned, scratch), ["did", "th"], "left")
    return out.select("doc_id", "base", F.coalesce("added", none).alias("added"))


def _mask(text: str, spans: list[tuple[int, int, int]]) -> str:
    out, at = [], 0
    for start, kind, end in sorted(spans):
        if start >= at:
            out += [text[at:start], f"[{KINDS[kind].upper()}]"]
            at = end
        elif end > at:
            at = end
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """``docs`` with every found span replaced by its kind in brackets, and ``n_chars``, where there is one, counted anew.

    Base spans are found again while the texts are rewritten; only documents with added spans are
    shuffled. Rows are told apart by id and text, so rows with a null or repeated id are masked like
    others. Null and empty texts stay as they are; an empty table gives no rows; all columns are kept.
    """
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark, "redact")
    bound_batches(spark)
    added = _added(scratch.keep(_scan(docs)), scratch)
    names = docs.columns
    extra = "array<struct<start: int, kind: int, end: int>>"
    keyed = docs.select(*row_keys(), F.struct(*names).alias("_row"))
    some = with_keys(keyed, ["did", "th"], added).join(added, ["did", "th"]).select("_row.*", F.col("added").alias("_added"))
    every = without_keys(keyed, ["did", "th"], added).select("_row.*", F.array().cast(extra).alias("_added")).unionByName(some)

    def run(batches):
        for b in batches:
            texts = []
            for text, more in zip(b.column("text").to_pylist(), b.column("_added").to_pylist(), strict=True):
                spans = base_spans(text) + [(x["start"], x["kind"], x["end"]) for x in more]
                texts.append(_mask(text, spans) if spans else text)
            new = {"text": pa.array(texts, pa.string())}
            if "n_chars" in names:
                new["n_chars"] = pa.array([None if t is None else len(t) for t in texts]).cast(b.schema.field("n_chars").type)
            yield pa.RecordBatch.from_arrays([new.get(c, b.column(c)) for c in names], names)
        trim()

    return every.mapInArrow(run, ", ".join(f"`{c}` {t}" for c, t in docs.dtypes))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digest of :func:`find` over the whole table."""
    found = find(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    kinds = F.array(*map(F.lit, KINDS))
    joined = lambda spans: F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", kinds[s["kind"]], s["start"].cast("string"), s["end"].cast("string"))), ",")
    of_kind = lambda k: lambda s: s["kind"] == k  # noqa: E731  one parameter: a second one would be the index
    count = [F.size(F.filter("base", of_kind(k))).cast("long").alias(f"n_{name}") for k, name in enumerate(KINDS)]
    return found.select("doc_id", *count, F.sha2(joined("base").cast("binary"), 256).alias("base_sha256"), joined(F.concat("base", "added")).alias("spans"), F.size("added").cast("long").alias("n_added"))
