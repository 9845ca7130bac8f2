"""Byte-level BPE by column functions alone: ranked merges folded over the ids of a word's pieces, decoding by concatenated pieces."""

from __future__ import annotations

import base64
import json
import zlib
from collections import defaultdict
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Letters and numbers that Unicode 14 to 16 added, as ranges; the library knows them, older JVMs do not.
NEW_LETTERS = (
    "870-887 889-88E 8B5 8C8-8C9 C5D CDD 170D 171F 1B4C 1C89-1C8A 2C2F 2C5F 9FFD-9FFF A7C0-A7C1 A7CB-A7CD A7D0-A7D1 A7D3 A7D5-A7DC A7F2-A7F4 10570-1057A 1057C-1058A 1058C-10592 10594-10595 "
    "10597-105A1 105A3-105B1 105B3-105B9 105BB-105BC 105C0-105F3 10780-10785 10787-107B0 107B2-107BA 10D4A-10D65 10D6F-10D85 10EC2-10EC4 10F70-10F81 11071-11072 11075 1123F-11240 11380-11389 "
    "1138B 1138E 11390-113B5 113B7 113D1 113D3 11740-11746 11AB0-11ABF 11BC0-11BE0 11F02 11F04-11F10 11F12-11F33 12F90-12FF0 1342F 13441-13446 13460-143FA 16100-1611D 16A70-16ABE 16D40-16D6C "
    "18CFF 1AFF0-1AFF3 1AFF5-1AFFB 1AFFD-1AFFE 1B11F-1B122 1B132 1B155 1DF00-1DF1E 1DF25-1DF2A 1E030-1E06D 1E290-1E2AD 1E4D0-1E4EB 1E5D0-1E5ED 1E5F0 1E7E0-1E7E6 1E7E8-1E7EB 1E7ED-1E7EE "
    "1E7F0-1E7FE 2A6DE-2A6DF 2B735-2B739 2EBF0-2EE5D 31350-323AF"
)
NEW_NUMBERS = "10D40-10D49 116D0-116E3 11BF0-11BF9 11F50-11F59 16130-16139 16AC0-16AC9 16D70-16D79 1CCF0-1CCF9 1D2C0-1D2D3 1E4F0-1E4F9 1E5F1-1E5FA"
#: Words whose ids are looked up instead of folded anew in each document: so many, of so many bytes at most, taken from the
#: documents whose hash is divisible by ONE_IN. They bound the literal that goes to each task; any other word is folded where it stands.
KNOWN_WORDS, KNOWN_BYTES, ONE_IN = 1 << 17, 24, 8


def java_pattern(pattern: str) -> str:
    """The library's pattern for the JVM: white space of Unicode, and the letters and numbers of Unicode 16 whatever the JVM's version."""
    ranges = lambda text: "".join("-".join(f"\\x{{{x}}}" for x in r.split("-")) for r in text.split())
    letters, numbers = ranges(NEW_LETTERS), ranges(NEW_NUMBERS)
    other = rf"[\S&&\P{{L}}&&\P{{N}}&&[\P{{Cn}}[\p{{Cn}}&&[^{letters}{numbers}]]]]"
    parts = pattern.split(r"[^\s\p{L}\p{N}]")
    of = lambda p: p.replace(r"\p{L}", rf"[\p{{L}}[\p{{Cn}}&&[{letters}]]]").replace(r"\p{N}", rf"[\p{{N}}[\p{{Cn}}&&[{numbers}]]]")
    return "(?U)" + other.join(map(of, parts))


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that stands in the expression, and is worked out, once, however often it is used: the start of a fold over nothing."""
    return F.aggregate(F.array().cast("array<int>"), value, lambda kept, _: kept, use)


def slot_count(entries: dict[str, object]) -> int:
    """Slots of a :func:`literal_map`, a power of two."""
    return 1 << max(1, (len(entries) - 1).bit_length())


def literal_map(entries: dict[str, object], kind: str) -> Column:
    """A literal map from strings, in slots by crc32 so that a look-up reads one short list; see :func:`found`."""
    slots = [""] * slot_count(entries)  # as text, which takes less of the driver than a dictionary per slot
    for k, v in entries.items():
        slots[zlib.crc32(k.encode()) % len(slots)] += f",{json.dumps(k, ensure_ascii=False)}:{v}"
    return F.from_json(F.lit("[" + ",".join(f"{{{s[1:]}}}" for s in slots) + "]"), f"array<map<string,{kind}>>")


def as_text(piece: str) -> str | None:
    """The text whose UTF-8 bytes are the characters of ``piece``, or null if there is none."""
    try:
        return piece.encode("latin-1").decode()
    except UnicodeDecodeError:
        return None


def found(table: Column, n_slots: Column, key: Column) -> Column:
    """The value of ``key`` in a :func:`literal_map`, or null."""
    return F.try_element_at(F.get(table, F.crc32(key.cast("binary")).bitwiseAND(n_slots - 1).cast("int")), key)


def bound_all(values: list[Column], use: Callable[..., Column]) -> Column:
    """:func:`bound` for several values."""
    return bound(values[0], lambda first: bound_all(values[1:], lambda *rest: use(first, *rest))) if values else use()


def pair_cells(ranks: dict[str, int]) -> tuple[list[int | None], list[int], int]:
    """``cells, shifts, bits``: pieces ``a`` and ``b``, by their ids, make the token ``cells[shifts[a] + b] ^ (a << bits)``, or none where that is null, or ``1 << bits`` or more.

    Left pieces are rows with a cell per right piece, laid over each other, so that a pair is looked up by two places of arrays.
    """
    size = max(ranks.values()) + 1
    bits = size.bit_length()
    rows: dict[int, dict[int, int]] = defaultdict(dict)
    for piece, rank in ranks.items():
        for i in range(1, len(piece)):
            left, right = ranks.get(piece[:i]), ranks.get(piece[i:])
            if left is not None and right is not None:
                rows[left][right] = rank
    cells: dict[int, int] = {}
    shifts, taken, place = [0] * size, 0, 0  # taken: places as bits
    for left in sorted(rows, key=lambda a: -len(rows[a])):
        row = rows[left]
        if len(row) > 1:  # the first shift at which no place is taken
            blocked = 0
            for right in row:
                blocked |= taken >> right
            shifts[left] = (~blocked & (blocked + 1)).bit_length() - 1
            for right in row:
                taken |= 1 << shifts[left] + right
        else:  # single pairs fill the gaps in order
            place = max(place, *row)
            while place in cells:
                place += 1
            shifts[left] = place - next(iter(row))
        cells |= {shifts[left] + right: left << bits | rank for right, rank in row.items()}
    return [cells.get(i) for i in range(max(shifts) + size)], shifts, bits


def folding(ranks: dict[str, int]) -> tuple[list[Column], Callable[..., Column]]:
    """Literal tables, and the function of these and a word that gives its ids: of all neighbours the first pair of least rank is merged, until no pair has one.

    Pieces are their ids all along, which are their ranks. A word has at most as many steps as bytes.
    """
    of_bytes = [ranks.get(chr(b)) for b in range(256)]
    if None in of_bytes:
        raise ValueError("the ranks lack single bytes")
    cells, shifts, bits = pair_cells(ranks)

    def ids(cells: Column, shifts: Column, of_bytes: Column, word: Column) -> Column:
        def step(pieces: Column, _: Column) -> Column:
            # the last piece has no next one, its pair is null
            token = lambda a, b: F.get(cells, F.get(shifts, a) + b).bitwiseXOR(F.shiftleft(a.cast("long"), bits))
            pairs = F.zip_with(pieces, F.slice(pieces, 2, F.size(pieces)), token)

            def merged(least: Column, at: Column) -> Column:  # piece number at, from 0, goes to the one before it; transform and filter cost far less here than slices and concatenated arrays
                rest = F.filter(pieces, lambda _, i: i != at)
                return F.transform(rest, lambda piece, i: F.when(i == at - 1, least).otherwise(piece))

            place = lambda pairs, least: bound_all([least.cast("int"), F.array_position(pairs, least).cast("int")], merged)
            chosen = lambda pairs: lambda least: F.when(least < 1 << bits, place(pairs, least)).otherwise(pieces)
            return bound(pairs, lambda pairs: bound(F.array_min(pairs), chosen(pairs)))

        spelled = F.split(F.decode(word.cast("binary"), "ISO-8859-1"), "")  # a character per byte
        start = F.transform(spelled, lambda c: F.get(of_bytes, F.ascii(c)))
        return bound(start, lambda start: F.aggregate(F.sequence(F.lit(1), F.size(start)), start, step))

    literal = lambda values, kind: F.from_json(F.lit(json.dumps(values)), f"array<{kind}>")
    return [literal(cells, "long"), literal(shifts, "int"), literal(of_bytes, "int")], ids


def words_of(text: Column, pattern: str) -> Column:
    """The words that the pattern splits a text into (null: none)."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(java_pattern(pattern)), F.lit(0))


def known_words(docs: DataFrame, pattern: str, word_ids: Callable[[Column], Column], words: int = KNOWN_WORDS, one_in: int = ONE_IN) -> dict[str, list[int]]:
    """Ids of the most frequent words, each folded once; at most ``words`` of ``KNOWN_BYTES`` each. They save work and change no result."""
    some = docs.where(F.pmod(F.xxhash64("text"), F.lit(one_in)) == 0)
    each = some.select(F.explode(words_of(F.col("text"), pattern)).alias("w")).where(F.octet_length("w") <= KNOWN_BYTES)
    counted = each.groupBy("w").agg(F.count("*").alias("n")).where("n > 1").orderBy(F.desc("n"), "w").limit(words).repartition("w")
    return {r["w"]: r["ids"] for r in counted.select("w", word_ids(F.col("w")).alias("ids")).toLocalIterator()}


def encode_documents(docs: DataFrame, ranks_path: str, pattern: str = public_tokenizers.PATTERN, words: int = KNOWN_WORDS, one_in: int = ONE_IN) -> DataFrame:
    """``doc_id, ids array<int>, decoded binary`` of every row: byte-level BPE by a file of ranks (``base64 rank`` per line), and back.

    Everything is a column function: the bytes of the pattern's words become ids, which are merged by a literal table of
    pairs, and ids become bytes again by a literal array of pieces, concatenated. The most frequent words come from
    a literal of bounded size (:func:`known_words`), the others are folded in their row, so nothing but the counts of
    frequent words is shuffled.

    Texts are whole; null and empty texts have no ids and decode to nothing; strings like special tokens are
    ordinary text; repeated rows are encoded each; an empty table gives no rows; other columns are ignored. A word of n bytes takes up to n steps over its pieces,
    so a single unbroken word of very many letters costs the square of its length. An error if a single byte has no rank.
    """
    with open(ranks_path, "rb") as lines:
        ranks = {base64.b64decode(piece).decode("latin-1"): int(rank) for piece, rank in map(bytes.split, lines)}
    by_id = [""] * (max(ranks.values(), default=-1) + 1)
    for piece, rank in ranks.items():
        by_id[rank] = piece
    tables, fold = folding(ranks)

    # a word that is a token is one, whatever its merges; a token that is no text is no word
    whole = {text: rank for piece, rank in ranks.items() if (text := as_text(piece)) is not None}

    def encoder(whole: dict[str, int], use: Callable[[Callable[[Column], Column]], Column]) -> Column:
        slots = F.lit(slot_count(whole))
        one = lambda table, w: bound(found(table, slots, w), lambda rank: F.when(rank.isNotNull(), F.array(rank)))
        return bound_all([literal_map(whole, "int"), *tables], lambda table, *t: use(lambda w: F.coalesce(one(table, w), fold(*t, w))))

    known = known_words(docs, pattern, lambda w: encoder(whole, lambda ids: ids(w)), words, one_in)
    slots = F.lit(slot_count(known))
    each = lambda cache: lambda ids: F.transform(words_of(F.col("text"), pattern), lambda w: F.coalesce(found(cache, slots, w), ids(w)))
    rest = {text: rank for text, rank in whole.items() if text not in known}
    ids = F.flatten(bound(literal_map(known, "array<int>"), lambda cache: encoder(rest, each(cache))))
    encoded = docs.select("doc_id", ids.alias("ids"))
    pieces = F.from_json(F.lit(json.dumps(by_id, ensure_ascii=False)), "array<string>")
    decoded = bound(pieces, lambda table: F.encode(F.array_join(F.transform("ids", lambda i: F.get(table, i)), ""), "ISO-8859-1"))
    return encoded.select("doc_id", "ids", decoded.alias("decoded"))


def op13_bytepair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """:func:`encode_documents` over the whole table, as digests of ids and decoded bytes."""
    out = encode_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    ids = F.array_join(F.col("ids").cast("array<string>"), ",")
    return out.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(ids.cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
