"""Byte-level BPE encoding by prefix-sharing trie traversal, and decoding.

The distinct words of a batch form a trie of bytes; sorted, they are that trie in depth-first order. The walk gives every
node the *last token* of the encoding of the prefix that ends there: of the vocabulary entries that are suffixes of the
prefix, exactly one follows the last token of the remaining prefix in a way that merging would leave alone. So a prefix
that many words share is encoded once, and a word's ids are read off by stepping back from its end, token by token.

Contract (``encode``): null text is the empty text and gives no ids; special strings of the tokenizer in a text become
their ids; text of any length is encoded whole. ``decode``: null or empty ids give the empty text, ids outside the
vocabulary are passed over, broken UTF-8 becomes U+FFFD. Rows are independent: ties, repeated rows, empty tables and
further columns pass through unchanged; a column named as an output is replaced.
"""

from __future__ import annotations

import itertools
import json
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from groundspark.llm.common import lean, replaced, small_batches

#: Fixed value: the published pattern that splits text before merging.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Characters of a piece that is remembered; remembered pieces and pairs at which a worker starts afresh; characters of
#: text that are split together. Results depend on none of them.
LONGEST_KEPT, MOST_PIECES, MOST_PAIRS, TOGETHER = 100, 450_000, 200_000, 1_500_000


def byte_letters() -> dict[str, int]:
    """The letters that byte-level vocabularies write bytes as: printable ones stand for themselves, the rest follow from 256 on."""
    plain = {*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


def read_spec(path: str) -> dict:
    with open(path, encoding="utf-8") as f:
        return json.load(f)


def token_bytes(spec: dict) -> dict[int, bytes]:
    """The bytes of each id, special tokens included."""
    letters = byte_letters()
    own = {i: bytes(letters[c] for c in s) for s, i in spec["model"]["vocab"].items()}
    return own | {t["id"]: t["content"].encode() for t in spec.get("added_tokens", [])}


class Vocabulary:
    """Ids, bytes and merge ranks read from a tokenizer file."""

    def __init__(self, path: str):
        spec = read_spec(path)
        letters = byte_letters()
        raw = lambda s: bytes(letters[c] for c in s)
        self.bytes = token_bytes(spec)
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.ids = {raw(s): i for s, i in spec["model"]["vocab"].items()}
        # Beginnings of tokens, with the id of those that are tokens themselves.
        self.begun = {b[:n]: -1 for b in self.ids for n in range(1, len(b))} | self.ids
        self.length = {i: len(b) for i, b in self.bytes.items()}
        self.rank: dict[tuple[int, int], int] = {}
        self.halves: dict[int, tuple[int, int]] = {}
        self.made_at = {i: -1 for i in self.ids.values()}
        for rank, merge in enumerate(spec["model"]["merges"]):
            left, right = merge.split(" ") if isinstance(merge, str) else merge
            a, b = self.ids[raw(left)], self.ids[raw(right)]
            ab = self.ids[raw(left + right)]
            self.rank.setdefault((a, b), rank)
            if ab not in self.halves:
                self.halves[ab], self.made_at[ab] = (a, b), rank


class Walk:
    """Depth-first over the trie of distinct words, which in sorted order are that trie written out.

    The stack holds, for each prefix of the word at hand, its last token and its reach: the length of its longest suffix
    that begins some token, for no token that ends one byte on is longer by more than that byte.
    """

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.fits: dict[int, bool] = {}

    def stays(self, a: int, b: int) -> bool:
        """Whether merging leaves the boundary between two adjacent tokens alone.

        Both are taken apart in the reverse order of merging. At each point the two tokens that touch the boundary
        would have merged if the rank of their pair came before that of the merges that made them.
        """
        rank, halves, made = self.v.rank, self.v.halves, self.v.made_at
        x, y, first_to_go = a, b, 1 << 60
        ok = True
        while True:
            # Of two places with the same rank the left one merges first: hence the 1 that is added for the right token.
            r = rank.get((x, y))
            if r is not None and r < first_to_go:
                ok = False
                break
            mx, my = made[x], made[y]
            if mx < 0 and my < 0:
                break
            if mx > my:
                first_to_go, x = mx, halves[x][1]
            else:
                first_to_go, y = my + 1, halves[y][0]
        if len(self.fits) > MOST_PAIRS:
            self.fits.clear()
        self.fits[a << 17 | b] = ok
        return ok

    def encode(self, words: list[bytes]) -> Iterator[list[int]]:
        """The ids of distinct, sorted words. Going on to the next word pops what the two don't share."""
        get, known_fit, stays, lengths = self.v.begun.get, self.fits.get, self.stays, self.v.length
        before, lasts, reaches = b"", [-1], [0]
        for word in words:
            shared, most = 0, min(len(before), len(word))
            while shared < most and before[shared] == word[shared]:
                shared += 1
            del lasts[shared + 1 :], reaches[shared + 1 :]
            reach = reaches[-1]
            for n in range(shared + 1, len(word) + 1):
                far = 0
                for k in range(n - 1 - reach, n):
                    t = get(word[k:n])
                    if t is None:
                        continue
                    if not far:
                        far = n - k
                    if t < 0:
                        continue
                    if not k:
                        break
                    ok = known_fit(lasts[k] << 17 | t)
                    if ok or ok is None and stays(lasts[k], t):
                        break
                else:
                    raise ValueError("a byte is missing from the vocabulary")
                lasts.append(t)
                reaches.append(far)
                reach = far
            before = word
            out, n = [], len(word)
            while n:
                t = lasts[n]
                out.append(t)
                n -= lengths[t]
            out.reverse()
            yield out


class Encoder:
    """Texts to ids. Pieces between single spaces or line breaks are remembered, so each is split and encoded once."""

    def __init__(self, path: str):
        import regex

        self.v = Vocabulary(path)
        self.walk = Walk(self.v)
        self.words = regex.compile(WORDS.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}"))
        # Elsewhere white space stands alone between other characters, and then a word begins at and after a line break, and at a space.
        self.runs = regex.compile(r"^\p{White_Space}|\p{White_Space}{2}|\p{White_Space}$")
        self.pieces_of = regex.compile(r"\p{White_Space}*\P{White_Space}+|\p{White_Space}+")
        self.specials = regex.compile("(" + "|".join(map(regex.escape, sorted(self.v.special, key=len, reverse=True))) + ")") if self.v.special else None
        self.known: dict[str, bytes] = {s: array("i", [i]).tobytes() for s, i in self.v.special.items()}

    def pieces(self, text: str) -> list[str]:
        if self.runs.search(text):
            return self.pieces_of.findall(text)
        first, *rest = text.replace("\n", " \n ").split(" ")
        out = [first]
        broken = False
        for x in rest:
            if x == "\n":
                out.append(x)
                broken = True
            else:
                out.append(x if broken else " " + x)
                broken = False
        return out

    def cut(self, piece: str) -> list[str]:
        """A piece's words; letters behind at most one space, and a comma or a full stop, need no pattern."""
        body = piece[1:] if piece[0] == " " else piece
        if body.isalpha():
            return [piece]
        if body[-1:] in (".", ",") and body[:-1].isalpha():
            return [piece[:-1], piece[-1]]
        return self.words.findall(piece)

    def learn(self, fresh: list[str]) -> None:
        """Encodes pieces that aren't known, the words of all of them in one walk."""
        split = list(map(self.cut, fresh))
        words = {w.encode(): w for ws in split for w in ws}
        order = sorted(words)
        done = {words[raw]: array("i", ids).tobytes() for raw, ids in zip(order, self.walk.encode(order), strict=True)}
        for p, ws in zip(fresh, split, strict=True):
            self.known[p] = done[ws[0]] if len(ws) == 1 else b"".join([done[w] for w in ws])

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text as packed 32-bit numbers. Texts are taken TOGETHER characters at a time."""
        out: list[bytes] = []
        part, size = [], 0
        for text in texts:
            part.append(text or "")
            size += len(part[-1])
            if size > TOGETHER:
                out += self.some(part)
                part, size = [], 0
        return out + self.some(part)

    def some(self, texts: list[str]) -> list[bytes]:
        """Splits all, learns the pieces that are new in one walk, and puts the ids together."""
        split = []
        for text in texts:
            ps: list[str] = []
            if self.specials and self.specials.search(text):
                for p in self.specials.split(text):
                    ps += [p] if p in self.v.special else self.pieces(p) if p else []
            elif text:
                ps = self.pieces(text)
            split.append(ps)
        if len(self.known) > MOST_PIECES:
            self.known.clear()
            self.known |= {s: array("i", [i]).tobytes() for s, i in self.v.special.items()}
        known = self.known
        fresh = {p for ps in split for p in ps if p not in known}
        self.learn(list(fresh))
        get = known.__getitem__
        out = [b"".join(map(get, ps)) for ps in split]
        for p in fresh:
            if len(p) > LONGEST_KEPT:  # seldom met again, and large
                del known[p]
        return out


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One for each Python worker and vocabulary."""
    return Encoder(path)


@lru_cache(maxsize=2)
def byte_table(path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All tokens' bytes end to end, with the start and length of each id."""
    known = token_bytes(read_spec(path))
    n = max(known) + 1
    length = np.array([len(known.get(i, b"")) for i in range(n)], np.int64)
    start = np.concatenate([[0], np.cumsum(length)[:-1]])
    return np.frombuffer(b"".join(known.get(i, b"") for i in range(n)), np.uint8), start, length


def decode_ids(ids: np.ndarray, path: str) -> str:
    data, start, length = byte_table(path)
    ids = ids[(ids >= 0) & (ids < len(length))]
    n = length[ids]
    if not n.sum():
        return ""
    where = np.repeat(start[ids] - (np.cumsum(n) - n), n) + np.arange(n.sum())
    return data[where].tobytes().decode("utf-8", "replace")


def _with(batch: pa.RecordBatch, schema: T.StructType, made: dict[str, pa.Array]) -> pa.RecordBatch:
    columns = {f: batch.column(f) for f in batch.schema.names} | made
    return pa.RecordBatch.from_arrays([columns[f.name] for f in schema.fields], names=schema.names)


def encode(df: DataFrame, vocabulary: str, text: str = "text", ids: str = "ids", decoded: str | None = None) -> DataFrame:
    """Adds the token ids of a text column as ``array<int>`` and, if named, the text that ``decode`` makes of them, in one pass."""
    small_batches(df.sparkSession)
    schema = replaced(df.schema, ids, T.ArrayType(T.IntegerType()))
    if decoded:
        schema = replaced(schema, decoded, T.StringType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(vocabulary)
        held: list[pa.RecordBatch] = []
        size = 0

        def done() -> Iterator[pa.RecordBatch]:
            packed = iter(own.encode([t for b in held for t in b.column(text).to_pylist()]))
            for batch in held:
                mine = list(itertools.islice(packed, batch.num_rows))
                offsets = np.concatenate([[0], np.cumsum([len(p) // 4 for p in mine])]).astype(np.int32)
                made = {ids: pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(mine), np.int32)))}
                if decoded:
                    made[decoded] = pa.array([decode_ids(np.frombuffer(p, np.int32), vocabulary) for p in mine], pa.string())
                yield _with(batch, schema, made)

        for batch in batches:
            held.append(batch)
            size += batch.column(text).nbytes
            if size > TOGETHER:
                yield from done()
                held, size = [], 0
        if held:
            yield from done()

    return df.mapInArrow(lean(run), schema)


def decode(df: DataFrame, vocabulary: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """Adds the text of a column of token ids."""
    small_batches(df.sparkSession)
    schema = replaced(df.schema, text, T.StringType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(ids)
            values = column.values.fill_null(-1).to_numpy(zero_copy_only=False) if len(column) else np.empty(0, np.int32)
            offsets = column.offsets.to_numpy()
            out = [decode_ids(values[a:b], vocabulary) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            yield _with(batch, schema, {text: pa.array(out, pa.string())})

    return df.mapInArrow(lean(run), schema)


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_bpe(spark, sf_dir):
    """Round trip of every document: ids, their digest, and the digest of the decoded text."""
    from groundspark.llm.common import table

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    path = default_vocabulary()
    coded = encode(docs, path, decoded="decoded").drop("text")
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
