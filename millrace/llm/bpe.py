"""BPE encoding by a tokenization automaton, and decoding by its arc labels.

The merges are compiled in order. The token automaton starts with one state and a looping arc for each
byte; the gadget of merge k = (u, v) -> w redirects the arcs labelled u to a new state that is a copy
of their target without the arc v, and adds an arc w wherever u could be read, leading where v led.
Reading a token sequence is then possible exactly if it is the BPE encoding of its bytes, and each
byte string has one such path. The state behind a token is named by that token; its row holds the arcs
that its gadget removed, each with its step, and goes on in the row of the state it was copied from.

Bytes are read by a second table, compiled from the arc labels: a state for each beginning of a label,
standing for the longest ending of what was read that begins a label, and the longest label that ends
there. The arc that ends after a byte is the longest such label whose first byte follows a state that
has that arc. So a word is read once from left to right, and its path is the chain of arcs that end at
its end. Words of one batch are read side by side, one byte of each at a time; very long ones alone.
"""

from __future__ import annotations

import json
import struct
from array import array

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import bound_batches, trim

#: Fixed values of the byte-level format: bytes written as themselves, and its pre-split pattern.
PLAIN = ((33, 126), (161, 172), (174, 255))
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Entries of a worker's cache of encoded chunks; it is emptied when full.
CACHE = 150_000
#: Longest chunk, in characters, that the cache keeps.
CACHED_CHARS = 64
#: Longest word, in bytes, that is read beside others, characters of texts that are encoded at once, and slots (as a power of 2) for answers about arcs.
SIDE_BY_SIDE, AT_ONCE, ARC_BITS = 48, 2_000_000, 20


def byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in the vocabulary file."""
    plain = [b for lo, hi in PLAIN for b in range(lo, hi + 1)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


PIECES = regex.compile(PATTERN)


def split_pattern(special: dict[str, int]):
    """Pattern that cuts a text at added tokens, the longer first; none without any."""
    return regex.compile("(" + "|".join(map(regex.escape, sorted(special, key=len, reverse=True))) + ")") if special else None


class _Chunks(dict):
    """Encoded chunks that follow a single space; filled on demand."""

    def __init__(self, owner: Chunked):
        self.owner = owner

    def __missing__(self, chunk: str) -> bytes:
        if not chunk or chunk[0].isspace() or chunk[-1].isspace():
            raise LookupError  # more than a single space: the text needs the full pre-split
        ids = self.owner.presplit(" " + chunk)
        if len(chunk) <= CACHED_CHARS:
            if len(self) >= CACHE:
                self.clear()
            self[chunk] = ids
        return ids


class Chunked:
    """Encodes whole texts chunk by chunk; a subclass gives ``presplit`` (text to ids as bytes) and ``special``."""

    def __init__(self, special: dict[str, int]):
        self.special, self._split_special = special, split_pattern(special)
        self.chunks = _Chunks(self)

    def presplit(self, text: str) -> bytes:
        raise NotImplementedError

    def _plain(self, text: str) -> bytes:
        """Chunks between single spaces are pre-split alone, since no piece of the pattern crosses their ends."""
        head, _, rest = text.partition(" ")
        if not rest or not head or head[-1].isspace():
            return self.presplit(text)
        try:
            tail = b"".join(map(self.chunks.__getitem__, rest.split(" ")))
        except LookupError:
            return self.presplit(text)
        return self.presplit(head) + tail

    def encode(self, text: str) -> bytes:
        """Ids of a whole text as little-endian unsigned 32-bit integers."""
        if self._split_special is None or not any(s in text for s in self.special):
            return self._plain(text)
        return b"".join(struct.pack("<I", self.special[s]) if s in self.special else self._plain(s) for s in self._split_special.split(text) if s)


class Ranked(Chunked):
    """The same ids from merges given as ranks, by a native merger; for callers that only need the ids."""

    def __init__(self, path: str):
        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters, special = byte_letters(), {t["content"]: t["id"] for t in spec["added_tokens"]}
        ids = {s: i for s, i in spec["model"]["vocab"].items() if s not in special}
        made = [ids["".join(m.split(" ")) if isinstance(m, str) else "".join(m)] for m in spec["model"]["merges"]]
        if made != sorted(made):
            raise ValueError(f"{path}: ids do not follow the order of merges")
        super().__init__(special)
        ranks = {bytes(letters[c] for c in s): i for s, i in ids.items()}
        self._native = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def presplit(self, text: str) -> bytes:
        return array("I", self._native.encode_ordinary(text)).tobytes()


class Automaton:
    """Compiled from a byte-level BPE file of the tokenizers library."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, letters = spec["model"], byte_letters()
        spell = lambda s: bytes(letters[c] for c in s)
        ids = model["vocab"]
        self.labels: list[bytes] = [b""] * (1 + max([*ids.values(), *(t["id"] for t in spec["added_tokens"])]))
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self._split_special = split_pattern(self.special)
        for s, i in ids.items():
            if s not in self.special:
                self.labels[i] = spell(s)
        for s, i in self.special.items():
            self.labels[i] = s.encode()
        n = self.size = len(self.labels)
        self.first, self.last, self.born = [-1] * n, [-1] * n, [1 << 62] * n
        self.removed: list[dict[int, int] | None] = [None] * n  # by state: arc -> step of its removal
        live = [False] * n
        for c in letters:
            live[ids[c]] = True
        for step, merge in enumerate(model["merges"]):
            left, right = merge.split(" ") if isinstance(merge, str) else merge
            self._gadget(step, ids[left], ids[right], ids[left + right], live)
        self._compile_labels([i for i in range(n) if live[i]])
        self.known, self.answers = np.full(1 << ARC_BITS, -1, np.int64), np.zeros(1 << ARC_BITS, np.bool_)
        self.chunks: dict[str, bytes] = {}  # ids of chunks that follow a single space

    def _gadget(self, step: int, u: int, v: int, w: int, live: list[bool]) -> None:
        if live[w] or not (live[u] and live[v] and self._reads(u, v)):
            return  # no path reads u then v by now: the merge never fires
        row = self.removed[u]
        if row is None:
            row = self.removed[u] = {}
        row[v] = step
        self.first[w], self.last[w], self.born[w], live[w] = u, v, step, True

    def _reads(self, state: int, token: int) -> bool:
        """Whether a state has an arc: not if its row, or one it was copied from, lost the arc, or an arc that was copied to it, in time."""
        before = 1 << 62
        while state >= 0:
            row = self.removed[state]
            if row:
                arc, until = token, 1 << 62
                while arc >= 0:
                    step = row.get(arc)
                    if step is not None and step < before and step <= until:
                        return False
                    until = self.born[arc]
                    arc = self.first[arc]
            before = self.born[state]
            state = self.last[state]
        return True

    def _compile_labels(self, tokens: list[int]) -> None:
        """The byte table, rows laid over each other: state s goes on by byte b at ``base[s] + b`` if ``owner`` there is s.

        ``ending``: state of the longest proper ending; ``longest``: longest label that a state ends
        with; ``shorter``: the next shorter label that ends like a label.
        """
        rows: list[dict[int, int]] = [{}]
        ends, parent, letter, depth = [-1], [0], [0], [0]
        for t in tokens:
            state = 0
            for b in self.labels[t]:
                found = rows[state].get(b)
                if found is None:
                    found = rows[state][b] = len(rows)
                    rows.append({})
                    ends.append(-1)
                    parent.append(state)
                    letter.append(b)
                    depth.append(depth[state] + 1)
                state = found
            ends[state] = t
        n = len(rows)
        ending, longest, shorter = [0] * n, [-1] * n, [-1] * self.size
        for state in sorted(range(1, n), key=depth.__getitem__):
            if depth[state] > 1:
                at, b = ending[parent[state]], letter[state]
                while at and b not in rows[at]:
                    at = ending[at]
                ending[state] = rows[at].get(b, 0)
            below = longest[ending[state]]
            longest[state] = below if ends[state] < 0 else ends[state]
            if ends[state] >= 0:
                shorter[ends[state]] = below
        base, owner, target = [0] * n, [-1] * 256, [0] * 256
        taken, place = 0, 0  # taken: places as bits
        for state in sorted((i for i in range(n) if rows[i]), key=lambda i: -len(rows[i])):
            row = rows[state]
            if len(row) > 1:  # the first shift at which no place is taken
                blocked = 0
                for b in row:
                    blocked |= taken >> b
                at = (~blocked & (blocked + 1)).bit_length() - 1
                for b in row:
                    taken |= 1 << at + b
            else:  # single arcs fill the gaps in order
                b = next(iter(row))
                place = max(place, b)
                while place < len(owner) and owner[place] >= 0:
                    place += 1
                at = place - b
            if len(owner) < at + 256:
                target += [0] * (at + 256 - len(owner))
                owner += [-1] * (at + 256 - len(owner))
            base[state] = at
            for b, to in row.items():
                owner[at + b], target[at + b] = state, to
        self.base, self.owner, self.target, self.ending, self.longest, self.shorter, self.widths = (
            np.array(x, np.int32) for x in (base, owner, target, ending, longest, shorter, [len(x) for x in self.labels])
        )

    def _has_arc(self, state: np.ndarray, token: np.ndarray) -> np.ndarray:
        """:meth:`_reads` of many pairs; answers are remembered by a table of fixed size."""
        key = state.astype(np.int64) * self.size + token
        slot = (key.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - ARC_BITS)).astype(np.int64)
        out = self.answers[slot]
        new = np.flatnonzero(self.known[slot] != key)
        if len(new):
            keys, at, back = np.unique(key[new], return_index=True, return_inverse=True)
            found = np.array([self._reads(*divmod(k, self.size)) for k in keys.tolist()], np.bool_)
            self.known[slot[new][at]], self.answers[slot[new][at]] = keys, found
            # of keys that share a slot the last written stays, with its own answer
            self.answers[slot[new][at]] = found[np.searchsorted(keys, self.known[slot[new][at]])]
            out[new] = found[back]
        return out

    def _side_by_side(self, words: list[bytes]) -> list[bytes]:
        """Ids of words, longest first, none longer than SIDE_BY_SIDE: all are read one byte further in each step."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        width, starts = int(lengths[0]), np.cumsum(lengths) - lengths
        letters = np.frombuffer(b"".join(words), np.uint8)
        ended = np.full((width + 1, len(words)), -1, np.int32)  # the arc that ends after so many bytes
        state = np.zeros(len(words), np.int32)
        for at in range(width):
            n = int(np.searchsorted(-lengths, -at))  # words that go on
            now, byte = state[:n], letters[starts[:n] + at]
            todo = np.arange(n)
            while len(todo):
                place = self.base[now[todo]] + byte[todo]
                goes = self.owner[place] == now[todo]
                hit = todo[goes]
                now[hit] = self.target[place[goes]]
                todo = todo[~goes]
                todo = todo[now[todo] > 0]
                now[todo] = self.ending[now[todo]]
            token, todo = self.longest[now], np.arange(n)
            while len(todo):
                before = ended[at + 1 - self.widths[token[todo]], todo]
                later = before >= 0  # the first state has every arc
                fails = np.zeros(len(todo), np.bool_)
                fails[later] = ~self._has_arc(before[later], token[todo[later]])
                todo = todo[fails]
                token[todo] = self.shorter[token[todo]]
            ended[at + 1, :n] = token
        paths = np.full((len(words), width), -1, np.int32)
        todo, step = np.arange(len(words)), width
        end = lengths.copy()
        while len(todo):
            step -= 1
            paths[todo, step] = ended[end[todo], todo]
            end[todo] -= self.widths[paths[todo, step]]
            todo = todo[end[todo] > 0]
        real = paths >= 0
        ids, cuts = paths[real].astype("<u4").tobytes(), np.concatenate([[0], np.cumsum(real.sum(axis=1)) * 4]).tolist()
        return [ids[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]

    def encode_piece(self, word: bytes) -> bytes:
        """Ids of one pre-split piece: the only path of the automaton that spells it, read byte by byte, never backwards."""
        base, owner, target, ending, longest, shorter, widths = (memoryview(x) for x in (self.base, self.owner, self.target, self.ending, self.longest, self.shorter, self.widths))
        state, ended, answers = 0, [-1], {}
        for byte in word:
            while owner[base[state] + byte] != state and state:
                state = ending[state]
            if owner[base[state] + byte] == state:
                state = target[base[state] + byte]
            token = longest[state]
            while (before := ended[-widths[token]]) >= 0:
                has = answers.get((before, token))
                if has is None:
                    if len(answers) > 50_000:
                        answers.clear()
                    has = answers[before, token] = self._reads(before, token)
                if has:
                    break
                token = shorter[token]
            ended.append(token)
        path, end = [], len(word)
        while end:
            path.append(ended[end])
            end -= widths[ended[end]]
        return array("I", reversed(path)).tobytes()

    def encode_pieces(self, pieces: list[str]) -> dict[str, bytes]:
        """Ids of pre-split pieces (little-endian unsigned 32-bit)."""
        words = [p.encode() for p in pieces]
        order = np.argsort(-np.fromiter(map(len, words), np.int64, len(words)), kind="stable").tolist()
        out, side = {}, []
        for i in order:
            if len(words[i]) > SIDE_BY_SIDE:
                out[pieces[i]] = self.encode_piece(words[i])
            else:
                side.append(i)
        for at in range(0, len(side), 16384):
            part = side[at : at + 16384]
            out.update(zip([pieces[i] for i in part], self._side_by_side([words[i] for i in part]), strict=True))
        return out

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """Ids of whole texts (little-endian unsigned 32-bit).

        Chunks between single spaces are pre-split alone, since no piece of the pattern crosses their
        ends; a text with other runs of white space is pre-split as a whole.
        """
        plans, wanted, words, fresh = [], set(), set(), {}
        for text in texts:
            parts = self._split_special.split(text) if self._split_special and any(s in text for s in self.special) else [text]
            plan = []
            for part in parts:
                if part in self.special:
                    plan.append((None, part))
                    continue
                head, _, rest = part.partition(" ")
                pieces, chunks = None, rest.split(" ") if rest and head and not head[-1].isspace() else None
                if chunks:
                    new = set(chunks).difference(self.chunks).difference(fresh)
                    odd = [c for c in new if not c.isalpha()]
                    if any(not c or c[0].isspace() or c[-1].isspace() for c in odd):
                        chunks = None
                    else:
                        for c in odd:
                            fresh[c] = found = PIECES.findall(" " + c)
                            wanted.update(found)
                        words.update(new.difference(odd))  # letters are one piece with the space
                        pieces = PIECES.findall(head)
                if chunks is None:
                    pieces = PIECES.findall(part)
                wanted.update(pieces)
                plan.append((chunks, pieces))
            plans.append(plan)
        spaced = {" " + c: c for c in words}
        wanted.update(spaced)
        ids = self.encode_pieces(list(wanted))
        if len(self.chunks) + len(fresh) + len(words) > CACHE:  # what this batch uses stays
            used = {c for plan in plans for chunks, _ in plan if chunks for c in chunks}
            self.chunks = {c: self.chunks[c] for c in used.intersection(self.chunks)}
        self.chunks.update((c, b"".join(map(ids.__getitem__, pieces))) for c, pieces in fresh.items())
        self.chunks.update((c, ids[p]) for p, c in spaced.items())
        out = []
        for plan in plans:
            done = []
            for chunks, pieces in plan:
                if isinstance(pieces, str):
                    done.append(struct.pack("<I", self.special[pieces]))
                else:
                    done += map(ids.__getitem__, pieces)
                    if chunks:
                        done += map(self.chunks.__getitem__, chunks)
            out.append(b"".join(done))
        return out

    def encode(self, text: str) -> bytes:
        return self.encode_all([text])[0]

    def decode(self, ids: bytes) -> str:
        """The text that the arcs' labels spell; bytes that are no UTF-8 become U+FFFD."""
        return b"".join(map(self.labels.__getitem__, memoryview(ids).cast("I"))).decode("utf-8", "replace")


_compiled: dict[tuple[type, str], Chunked | Automaton] = {}


def compiled(kind: type, path: str) -> Chunked | Automaton:
    """One encoder per worker process, kind and file."""
    if (kind, path) not in _compiled:
        _compiled[kind, path] = kind(path)
    return _compiled[kind, path]


def encode_documents(docs: DataFrame, path: str) -> DataFrame:
    """Ids and decoded text of every document: ``doc_id, ids (little-endian unsigned 32-bit, binary), decoded``.

    A null or empty text has no ids and decodes to the empty text; texts are encoded whole, whatever
    their length, and repeated rows each give a row. Other columns of ``docs`` are ignored.
    """
    bound_batches(docs.sparkSession)

    def run(batches):
        bpe = compiled(Automaton, path)
        for b in batches:
            ids, waiting, size = [], [], 0
            for text in b.column("text").to_pylist():
                waiting.append(text or "")
                size += len(waiting[-1])
                if size >= AT_ONCE:
                    ids += bpe.encode_all(waiting)
                    waiting, size = [], 0
            ids += bpe.encode_all(waiting)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(ids, pa.binary()), pa.array([bpe.decode(i) for i in ids], pa.string())], ["doc_id", "ids", "decoded"])
        bpe.chunks.clear()
        trim()

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, ids binary, decoded string")


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digest of :func:`encode_documents` over the whole table."""
    path = public_tokenizers.path("byte_bpe_50k.json")
    out = encode_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), path)
    return out.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
