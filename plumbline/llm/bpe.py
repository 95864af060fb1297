"""BPE encoding and decoding of whole texts.

The encoder is exact without replaying merges. An Aho-Corasick automaton over the vocabulary gives the longest token that
starts at a position; tokens are laid one after another, each checked against its left neighbour by the pair table (two
tokens may stand together only if merging by rank would have left that boundary open), with shorter tokens and, if none
fits, a step back as the way out. A bitmap of positions known to fail keeps this linear. Decoding looks ids up in an
offset table over one blob of all tokens.

The vocabulary is a ``tokenizers`` file of the word-end kind: NFC, white space collapsed, lower case, split into words,
bytes as printable characters, the last of a word marked. Special tokens are recognised in the raw text.

Defined results: a null text counts as empty, which has no tokens and decodes to the empty string; equal texts encode
alike; a text of any length is encoded whole; columns besides ``doc_id`` and ``text`` are ignored.
"""

from __future__ import annotations

import hashlib
import json
import re
import struct
import sys
import unicodedata
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import alone_in_worker, bounded_batches

WORD_END = "</w>"

#: Words whose encoding a Python worker remembers (and as many pieces between white space); at that number it starts
#: afresh. Longer ones than LONGEST are encoded anew each time.
CACHE_WORDS, LONGEST = 250_000, 64
SEPARATORS = re.compile("[\x1c-\x1f]")

# Fixed values from the Unicode Character Database.
#: Ranges of letters and digits that Unicode 16 added, which Python 3.13 does not know.
UNICODE_16 = (
    (0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D40, 0x10D65), (0x10D6F, 0x10D85), (0x10EC2, 0x10EC4),
    (0x11380, 0x11389), (0x1138B, 0x1138B), (0x1138E, 0x1138E), (0x11390, 0x113B5), (0x113B7, 0x113B7), (0x113D1, 0x113D1), (0x113D3, 0x113D3),
    (0x116D0, 0x116E3), (0x11BC0, 0x11BE0), (0x11BF0, 0x11BF9), (0x13460, 0x143FA), (0x16100, 0x1611D), (0x16130, 0x16139),
    (0x16D40, 0x16D6C), (0x16D70, 0x16D79), (0x18CFF, 0x18CFF), (0x1CCF0, 0x1CCF9), (0x1E5D0, 0x1E5ED), (0x1E5F0, 0x1E5FA),
)
#: Capitals of Unicode 16 and 17: first, last, and how far away the small letter is.
NEW_CAPITALS = (
    (0x1C89, 0x1C89, 1), (0xA7CB, 0xA7CB, 0x264 - 0xA7CB), (0xA7CC, 0xA7CC, 1), (0xA7CE, 0xA7CE, 1), (0xA7D2, 0xA7D2, 1), (0xA7D4, 0xA7D4, 1),
    (0xA7DA, 0xA7DA, 1), (0xA7DC, 0xA7DC, 0x19B - 0xA7DC), (0x10D50, 0x10D65, 0x20), (0x16EA0, 0x16EB8, 0x1B),
)
#: Marks that Unicode 10 to 15 gave a combining class, or a composition with what stands before them. The vocabulary's
#: library normalises by Unicode 9, to which they are ordinary characters.
NEW_MARKS = (
    (0x7FD, 0x7FD), (0x898, 0x89F), (0x8CA, 0x8D3), (0x9FE, 0x9FE), (0xC3C, 0xC3C), (0xD3B, 0xD3C), (0xEBA, 0xEBA), (0x1715, 0x1715),
    (0x1ABF, 0x1ACE), (0x1DF6, 0x1DFA), (0xA82C, 0xA82C), (0x10D24, 0x10D27), (0x10EAB, 0x10EAC), (0x10EFD, 0x10EFF), (0x10F46, 0x10F50),
    (0x10F82, 0x10F85), (0x11070, 0x11070), (0x1133B, 0x1133B), (0x1145E, 0x1145E), (0x11839, 0x1183A), (0x11930, 0x11930), (0x1193D, 0x1193E),
    (0x11943, 0x11943), (0x119E0, 0x119E0), (0x11A34, 0x11A34), (0x11A47, 0x11A47), (0x11A99, 0x11A99), (0x11D42, 0x11D42), (0x11D44, 0x11D45),
    (0x11D97, 0x11D97), (0x11F41, 0x11F42), (0x16FF0, 0x16FF1), (0x1E08F, 0x1E08F), (0x1E130, 0x1E136), (0x1E2AE, 0x1E2AE), (0x1E2EC, 0x1E2EF),
    (0x1E4EC, 0x1E4EF),
)

#: Entries of the pair table that a worker remembers.
PAIRS = 200_000

#: Tokens decoded at once.
CHUNK_TOKENS = 1 << 18


def byte_characters() -> list[str]:
    """The printable character that stands for each byte: itself if printable, else the next from U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b if b in plain else next(spare)) for b in range(256)]


BARRIER = re.compile("([" + "".join(f"{chr(first)}-{chr(last)}" for first, last in NEW_MARKS) + "])")


def composed(text: str) -> str:
    """NFC by Unicode 9."""
    if not BARRIER.search(text):
        return unicodedata.normalize("NFC", text)
    return "".join([unicodedata.normalize("NFC", part) for part in BARRIER.split(text)])


class Tokenizer:
    """Encoder and decoder for one vocabulary file."""

    def __init__(self, path: str):
        import ahocorasick
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        if model["type"] != "BPE" or model["end_of_word_suffix"] != WORD_END or spec["decoder"] is not None:
            raise ValueError(f"{path}: not a word-end BPE vocabulary")
        self._spec = spec
        self._load(model, {t["content"]: t["id"] for t in spec["added_tokens"]})
        pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self._words = regex.compile(pattern)
        # Letters and digits newer than the vocabulary's library knows are symbols to it.
        known = {c for first, last in UNICODE_16 for c in range(first, last + 1)}
        late = regex.findall(r"[\p{L}\p{N}]", "".join(chr(c) for c in range(0x80, sys.maxunicode + 1) if c not in known and unicodedata.category(chr(c)) == "Cn"))
        self._lower = {c: c + by for first, last, by in NEW_CAPITALS for c in range(first, last + 1)}
        self._late = frozenset([*late, *map(chr, self._lower)])
        self._beyond = regex.compile(f"[{min(self._late)}-{chr(sys.maxunicode)}]")
        newer = "".join(rf"\U{ord(c):08x}" for c in late) or r"\U0010ffff"
        self._careful = regex.compile(pattern.replace(r"[^\s\p{L}\p{N}]", rf"[[^\s\p{{L}}\p{{N}}]||[{newer}]]").replace(r"[\p{L}]", rf"[\p{{L}}--[{newer}]]").replace(r"[\p{N}]", rf"[\p{{N}}--[{newer}]]"), regex.V1)
        self._specials = regex.compile("|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True)) or r"(?!)")
        self._automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for units, token in self._ids.items():
            self._automaton.add_word(units, token)
        self._automaton.make_automaton()
        self._seen: dict[str, bytes] = {}
        self._pieces: dict[str, bytes] = {}

    def _load(self, model: dict, special: dict[str, int]) -> None:
        vocab: dict[str, int] = model["vocab"]
        self.special = special
        code = {c: b for b, c in enumerate(byte_characters())}

        def units(token: str) -> str:
            """A token as a string with one character a byte; a word's last byte is moved up by 256."""
            end = token.endswith(WORD_END) and token != WORD_END
            body = [code[c] for c in (token[: -len(WORD_END)] if end else token)]
            if end:
                body[-1] += 256
            return "".join(map(chr, body))

        self._ids = {units(t): i for t, i in vocab.items()}
        size = max([*vocab.values(), *special.values()]) + 1
        # merges in rank order; a base unit is its own half
        order = sorted(vocab.values())
        self._rank = np.zeros(size, np.int64)
        self._left, self._right = list(range(size)), list(range(size))
        merged: dict[tuple[int, int], int] = {}
        base = [i for u, i in self._ids.items() if len(u) == 1]
        rank = {i: r for r, i in enumerate(sorted(base))}
        for a, b in (m if isinstance(m, list) else m.split(" ") for m in model["merges"]):
            pair = (vocab[a], vocab[b])
            token = vocab[a + b]
            merged[pair] = token
            if token not in rank:
                rank[token] = len(rank)
                self._left[token], self._right[token] = pair
        # ranks take the place of ids in the pair test: a token of a higher rank was made later
        self._rank = [rank.get(i, -1) for i in range(size)]
        self._made = {p: rank[t] for p, t in merged.items()}
        self._shorter: list[int | None] = [None] * size
        self._lengths = [0] * size
        for u, i in self._ids.items():
            self._lengths[i] = len(u)
            self._shorter[i] = next((self._ids[u[:k]] for k in range(len(u) - 1, 0, -1) if u[:k] in self._ids), None)
        self._pairs: dict[tuple[int, int], bool] = {}
        names = [""] * size
        for t, i in [*vocab.items(), *special.items()]:
            names[i] = t
        blob = [(" " + t).encode() for t in names]
        self._offsets = np.zeros(size + 1, np.int64)
        np.cumsum([len(b) for b in blob], out=self._offsets[1:])
        self._blob = np.frombuffer(b"".join(blob), np.uint8)
        self._known = len(order)

    def _together(self, a: int, b: int) -> bool:
        """Whether merging by rank leaves the boundary between the tokens ``a`` and ``b`` open; remembered."""
        if len(self._pairs) >= PAIRS:
            self._pairs.clear()
        got = self._pairs[a, b] = self._boundary_holds(a, b)
        return got

    def _boundary_holds(self, a: int, b: int) -> bool:
        # Undo the later of the two tokens again and again. Whenever the units then beside the boundary could merge
        # before what is known to have been made next to them, the boundary would have gone.
        limit = float("inf")
        rank, left, right, made = self._rank, self._left, self._right, self._made
        while True:
            if made.get((a, b), float("inf")) < limit:
                return False
            if rank[a] > rank[b]:
                limit = rank[a]
                half = right[a]
                if half == a:
                    limit = rank[b] + 1
                    half = left[b]
                    if half == b:
                        return True
                    b = half
                else:
                    a = half
            else:
                limit = rank[b] + 1
                half = left[b]
                if half == b:
                    limit = rank[a]
                    half = right[a]
                    if half == a:
                        return True
                    a = half
                else:
                    b = half

    def encode_units(self, units: str) -> list[int]:
        """Ids of one word, given as units."""
        whole = self._ids.get(units)
        if whole is not None and self._known:
            return [whole]
        lengths, shorter, pairs, together = self._lengths, self._shorter, self._pairs, self._together
        # one longest match after the other: if all neighbours fit, this is the encoding
        longest = self._automaton.iter_long
        n, at, before = len(units), 0, -1
        out: list[int] = []
        for end, token in longest(units):
            if before >= 0:
                fits = pairs.get((before, token))
                if not (together(before, token) if fits is None else fits):
                    break
            out.append(token)
            at, before = end + 1, token
        else:
            return out
        closed: set[int] = set()
        while at < n:
            while token is not None:
                end = at + lengths[token]
                if end not in closed:
                    if before < 0:
                        break
                    fits = pairs.get((before, token))
                    if together(before, token) if fits is None else fits:
                        break
                token = shorter[token]
            if token is None:
                closed.add(at)
                if not out:
                    raise ValueError("the vocabulary cannot spell this word")
                token = out.pop()
                at -= lengths[token]
                token = shorter[token]
                before = out[-1] if out else -1
                continue
            out.append(token)
            at, before = end, token
            if at < n:
                token = next(longest(units, at))[1]
        return out

    def _word(self, word: str) -> bytes:
        raw = word.encode()
        ids = self.encode_units(raw[:-1].decode("latin-1") + chr(raw[-1] + 256))
        got = struct.pack(f"<{len(ids)}I", *ids)
        if len(word) <= LONGEST:
            if len(self._seen) >= CACHE_WORDS:
                self._seen.clear()
            self._seen[word] = got
        return got

    def _spaced(self, text: str) -> bytes:
        """Ids of a text without special tokens and, mostly, without white space."""
        piece = text
        if not text.isascii():
            text = composed(text)
        # lower-casing goes character by character: a capital sigma has one small form wherever it stands
        text = text.replace("Σ", "σ").lower()
        split = self._words
        if not text.isascii() and self._beyond.search(text) and not self._late.isdisjoint(text):
            split, text = self._careful, text.translate(self._lower)
        seen, word = self._seen.get, self._word
        got = b"".join([seen(w) or word(w) for w in split.findall(text)])
        if len(piece) <= LONGEST:
            if len(self._pieces) >= CACHE_WORDS:
                self._pieces.clear()
            self._pieces[piece] = got
        return got

    def _plain(self, text: str) -> bytes:
        """Ids of a text without special tokens. No rule reaches over white space, so its pieces are encoded apart and remembered."""
        if SEPARATORS.search(text):  # white space to str.split, but not to the vocabulary
            return self._spaced(text)
        pieces, spaced = self._pieces, self._spaced
        return b"".join([pieces[p] if p in pieces else spaced(p) for p in text.split()])

    def encode(self, text: str) -> bytes:
        """Ids of a text as little-endian unsigned 32-bit integers."""
        if not any(s in text for s in self.special):
            return self._plain(text)
        parts: list[bytes] = []
        at = 0
        for m in self._specials.finditer(text):
            parts.append(self._plain(text[at : m.start()]))
            parts.append(np.array([self.special[m[0]]], "<u4").tobytes())
            at = m.end()
        return b"".join([*parts, self._plain(text[at:])])

    def decode(self, ids: bytes) -> Iterator[bytes]:
        """The tokens, joined by spaces, in pieces of UTF-8."""
        every = np.frombuffer(ids, "<u4")
        for at in range(0, len(every), CHUNK_TOKENS):
            part = every[at : at + CHUNK_TOKENS]
            start = self._offsets[part]
            length = self._offsets[part + 1] - start
            end = np.cumsum(length)
            take = np.repeat(start - (end - length), length) + np.arange(end[-1])
            piece = self._blob[take].tobytes()
            yield piece if at else piece[1:]


_loaded: dict[str, Tokenizer] = {}


def tokenizer(path: str) -> Tokenizer:
    """The tokenizer of a file, built once in each Python process."""
    alone_in_worker("bpe", _loaded.clear)
    if path not in _loaded:
        _loaded[path] = Tokenizer(path)
    return _loaded[path]


CODED = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])


def _digests(path: str):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokenizer(path)
        for batch in batches:
            rows = []
            for text in batch.column(1):
                ids = t.encode(text.as_py() or "")
                decoded = hashlib.sha256()
                for piece in t.decode(ids):
                    decoded.update(piece)
                rows.append((len(ids) // 4, hashlib.sha256(ids).hexdigest(), decoded.hexdigest()))
            n, a, b = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())], schema=CODED)

    return run


def code_round_trip(docs: DataFrame, path: str) -> DataFrame:
    """Per document: doc_id, n_tokens, ids_sha256, decoded_sha256. Ids and decoded text stay in the worker; only digests leave it."""
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(_digests(path), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encode(docs: DataFrame, path: str) -> DataFrame:
    """Per document: doc_id and its ids."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokenizer(path)
        for batch in batches:
            ids = [np.frombuffer(t.encode(x.as_py() or ""), "<u4").astype(np.int32) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, ids array<int>")


def decode(coded: DataFrame, path: str) -> DataFrame:
    """Per row of (doc_id, ids): doc_id and the decoded text."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokenizer(path)
        for batch in batches:
            texts = [b"".join(t.decode(np.array(x.as_py() or [], "<u4").tobytes())).decode() for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return coded.select(F.col("doc_id").cast("long"), "ids").mapInArrow(run, "doc_id long, text string")
