"""Language identification by cross-parsing entropy.

For every language a suffix automaton is built over a bounded sample of labelled text. A text is parsed against it into
the longest phrases that occur in the sample, one after another (a letter unknown to the sample begins a phrase and goes
before its longest match). A phrase names a place in the sample, so the cross entropy is the number of phrases times the
logarithm of the sample's length, for each letter; the language with the least is the prediction. Without that factor a
language with a longer sample, and so longer matches, would win too often.

The automata's moves are numpy arrays: a row a state while that takes no more than ``DENSE`` entries, else a hash table,
whose size follows the samples and not the alphabet. Many pieces
of text are parsed in step, one character of each at a time. Pieces of ``SEGMENT`` characters of a long text are parsed
beside each other, then anew from the state in which the piece before ended, until both parses meet; after that they agree
for good. So phrases are those of the whole text, whatever the length of pieces.

Defined results: a text that is null, empty or without letters is ``und`` with score 0; where no language could be learned
every text is; ties go to the first language by code point; equal texts have equal results. Rows whose lang or text is
null, or that are held out, teach nothing. Other columns are ignored by ``predict`` and kept by ``keep_known``.
"""

from __future__ import annotations

import sys
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import alone_in_worker, bounded_batches, in_training

#: Bounds of the sample: documents a language (about), and characters a language, dealt evenly over its documents.
SAMPLE_DOCS, SAMPLE_CHARS = 48, 24_000
#: How many times its even part of the characters a document may give where others are short.
WIDE = 6
SEGMENT = 512
#: Pieces parsed in step, and characters of text looked at together.
STEP, CHUNK = 1024, 1 << 22
#: Entries of a table with a row for each state; 32 bits each.
DENSE = 1 << 24
UNDETERMINED = "und"


def normal_form(text: str) -> str:
    return text.lower()


class Letters:
    """Maps texts to letter numbers: 0 is padding, 1 a run of others, 2 a letter that no sample has."""

    _alpha: np.ndarray | None = None

    def __init__(self, alphabet: str):
        if Letters._alpha is None:
            Letters._alpha = np.fromiter((chr(c).isalpha() for c in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1)
        self._code = np.where(Letters._alpha, 2, 1).astype(np.int32)
        for i, c in enumerate(alphabet):
            self._code[ord(c)] = 3 + i
        self.size = 3 + len(alphabet)

    def codes(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Codes of all texts in a row, and where each begins; runs of others are single."""
        joined = "".join([normal_form(t) + "\n" for t in texts])
        every = self._code[np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)]
        ends = np.cumsum([len(normal_form(t)) + 1 for t in texts])
        other = every == 1
        keep = ~other
        keep[1:] |= ~other[:-1]
        last = ends - 1
        keep[[0, *ends[:-1].tolist()]] = True
        keep[last] = False
        begins = np.concatenate([[0], np.cumsum(keep)[last]])
        return every[keep], begins


def suffix_automaton(codes: list[int]) -> list[dict[int, int]]:
    """Moves by state of the automaton of all factors of a sequence."""
    following: list[dict[int, int]] = [{}]
    link, length = [-1], [0]
    last = 0
    for c in codes:
        new = len(following)
        following.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in following[p]:
            following[p][c] = new
            p = link[p]
        if p >= 0:
            q = following[p][c]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                copy = len(following)
                following.append(dict(following[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and following[p].get(c) == q:
                    following[p][c] = copy
                    p = link[p]
                link[q] = link[new] = copy
        last = new
    return following


class Moves:
    """An open hash table from keys to values, both not negative, looked up by whole arrays."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        bits = max(int(4 * len(keys)).bit_length(), 4)
        self._shift, self._mask = np.uint64(64 - bits), (1 << bits) - 1
        self._keys, self._values = np.full(1 << bits, -1, np.int64), np.full(1 << bits, -1, np.int64)
        left, place = np.arange(len(keys)), self._place(keys)
        while len(left):
            free = left[self._keys[place[left]] < 0]
            self._keys[place[free]] = keys[free]
            won = free[self._keys[place[free]] == keys[free]]
            self._values[place[won]] = values[won]
            left = left[self._keys[place[left]] != keys[left]]
            place[left] = (place[left] + 1) & self._mask

    def _place(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self._shift).view(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        """The values, -1 where a key is absent."""
        at = self._place(keys)
        held = self._keys.take(at)
        miss = held != keys
        out = self._values.take(at)
        out[miss] = -1
        left = np.flatnonzero(miss & (held >= 0))
        while len(left):
            keys_left = keys.flat[left]
            at_left = (at.flat[left] + 1) & self._mask
            at.flat[left] = at_left
            held = self._keys[at_left]
            found = held == keys_left
            out.flat[left[found]] = self._values[at_left[found]]
            left = left[~found & (held >= 0)]
        return out


class Parser:
    """Counts phrases of texts against the samples of all languages. States are numbered in steps of the alphabet's size."""

    def __init__(self, samples: dict[str, str]):
        self.languages = sorted(samples)
        forms = {k: normal_form(samples[k]) for k in self.languages}
        self.letters = Letters("".join(sorted({c for f in forms.values() for c in f if c.isalpha()})))
        size = self.letters.size
        keys, values, roots, first, weights = [], [], [], 0, []
        for k in self.languages:
            codes, _ = self.letters.codes([forms[k]])
            following = suffix_automaton(codes.tolist())
            keys += [(first + s) * size + c for s, row in enumerate(following) for c in row]
            values += [(first + t) * size for row in following for t in row.values()]
            roots.append(first * size)
            weights.append(np.log(max(len(codes), 2)))
            first += len(following)
        keys, values = np.array(keys, np.int64), np.array(values, np.int64)
        self._weights = np.array(weights)
        self._table: np.ndarray | None = None
        kind = np.int32 if 2 * first * size < 2**31 else np.int64
        self._roots = np.array(roots, kind)[:, None]
        moves = Moves(keys, values)
        every = np.arange(size)
        starts = moves.get(self._roots.astype(np.int64) + every) if roots else np.zeros((0, size), np.int64)
        self._starts = np.where(starts >= 0, starts, self._roots).astype(kind)
        self._known = starts >= 0
        if first * size <= DENSE:
            # twice the next state, plus 1 if a phrase begins
            bounds = [*roots, first * size]
            self._table = np.concatenate([np.tile(2 * s + 1, (n - m) // size) for s, m, n in zip(self._starts, bounds, bounds[1:], strict=False)]) if roots else np.zeros(0, kind)
            self._table[keys] = 2 * values
        else:
            self._moves = moves

    def _step(self, state: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """States (languages by pieces) after a character of each piece, and whether it began a phrase."""
        if self._table is not None:
            got = self._table.take(state + row)
            return got >> 1, got & 1
        to = self._moves.get((state + row).astype(np.int64))
        began = to < 0
        language, piece = np.nonzero(began)
        to[language, piece] = self._starts[language, row[piece]]
        return to.astype(state.dtype), began

    def _parsed(self, codes: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Phrases begun in pieces, longest first, that are parsed in step from the root, and the states they end in."""
        state = np.repeat(self._roots, len(size), axis=1)
        ends, found = np.empty_like(state), np.zeros_like(state)
        longest = int(size.max(initial=0))
        rows = codes[np.minimum(start + np.arange(longest)[:, None], len(codes) - 1)].astype(state.dtype)
        live = np.searchsorted(-size, -np.arange(longest), side="left")
        for row, n in zip(rows, live.tolist(), strict=True):
            if n < state.shape[1]:
                ends[:, n : state.shape[1]] = state[:, n:]
                state = np.ascontiguousarray(state[:, :n])
            state, began = self._step(state, row[:n])
            found[:, :n] += began
        ends[:, : state.shape[1]] = state
        return found, ends

    def _mended(self, codes: np.ndarray, start: np.ndarray, size: np.ndarray, state: np.ndarray, old: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How many phrases more begin in pieces when entered in ``state`` instead of ``old``, and the states they then end
        in: -1 where both parses meet before, from where on they agree."""
        ends, more = np.full_like(state, -1), np.zeros(state.shape, np.int64)
        live = np.flatnonzero((state != old).any(axis=0))
        state, old = state[:, live], old[:, live]
        i = 0
        while len(live):
            row = codes[start[live] + i].astype(state.dtype)
            state, began = self._step(state, row)
            old, before = self._step(old, row)
            more[:, live] += began.astype(np.int64) - before
            i += 1
            apart, done = (state != old).any(axis=0), size[live] <= i
            gone = apart & done
            ends[:, live[gone]] = state[:, gone]
            stay = apart & ~done
            live, state, old = live[stay], state[:, stay], old[:, stay]
        return more, ends

    def phrases(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Phrases by text and language, and how many letters each text has."""
        codes, begins = self.letters.codes(texts)
        has = np.concatenate([[0], np.cumsum(codes >= 2)])
        letters = has[begins[1:]] - has[begins[:-1]]
        lengths = np.diff(begins)
        pieces = -(-lengths // SEGMENT)
        owner = np.repeat(np.arange(len(texts)), pieces)
        at = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        start = begins[:-1][owner] + at * SEGMENT
        size = np.minimum(SEGMENT, lengths[owner] - at * SEGMENT)
        found = np.zeros((len(self.languages), len(owner)), np.int64)
        ends = np.zeros(found.shape, self._roots.dtype)
        order = np.argsort(-size, kind="stable")
        for first in range(0, len(order), STEP):
            ids = order[first : first + STEP]
            found[:, ids], ends[:, ids] = self._parsed(codes, start[ids], size[ids])
        # a text's first character begins a phrase, known or not
        heads = np.flatnonzero(at == 0)
        found[:, heads] += self._known[:, codes[start[heads]]]
        # later pieces go on from the end of the one before, until that changes nothing
        since = np.repeat(self._roots, len(owner), axis=1)
        todo = np.flatnonzero(at > 0)
        while len(todo):
            entered = ends[:, todo - 1]
            more, last = self._mended(codes, start[todo], size[todo], entered, since[:, todo])
            found[:, todo] += more
            since[:, todo] = entered
            moved = todo[last.max(axis=0, initial=-1) >= 0]
            ends[:, moved] = last[:, last.max(axis=0, initial=-1) >= 0]
            todo = moved[moved + 1 < len(owner)] + 1
            todo = todo[at[todo] > 0]
        counts = np.zeros((len(texts), len(self.languages)), np.int64)
        np.add.at(counts, owner, found.T)
        return counts, letters

    def predict(self, texts: list[str]) -> list[tuple[str, float]]:
        if not self.languages or not texts:
            return [(UNDETERMINED, 0.0)] * len(texts)
        counts, letters = self.phrases(texts)
        entropy = np.maximum(counts, 1) * self._weights
        best = entropy.argmin(axis=1)
        # the prediction's share of all languages' mean phrase lengths
        inverse = 1.0 / entropy
        share = inverse[np.arange(len(texts)), best] / inverse.sum(axis=1)
        return [(self.languages[b], float(s)) if n else (UNDETERMINED, 0.0) for b, s, n in zip(best, share, letters, strict=True)]


_parsers: dict[tuple, Parser] = {}


def parser(samples: tuple[tuple[str, str], ...]) -> Parser:
    """The parser of some samples, built once in each Python process."""
    alone_in_worker("lang_id", _parsers.clear)
    if samples not in _parsers:
        _parsers.clear()
        _parsers[samples] = Parser(dict(samples))
    return _parsers[samples]


def learn(docs: DataFrame) -> tuple[tuple[str, str], ...]:
    """Bounded samples of labelled text by language, the same whenever the table is the same.

    Languages are counted first, every one; then rows whose hash falls below a language's share are read, about
    ``SAMPLE_DOCS`` each. Copies of a text are one. A text that is longer than its document's part of ``SAMPLE_CHARS`` gives
    that many characters from a place within it that its hash tells.
    """
    bounded_batches(docs.sparkSession)
    text = F.col("text").cast("string")
    rows = docs.select("doc_id", F.col("lang").cast("string").alias("lang"), text.alias("text"), F.xxhash64(text).alias("h")).filter(in_training(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.approx_count_distinct("h").alias("n")).collect()}
    if not sizes:
        return ()
    parts, each = 1 << 40, SAMPLE_CHARS // SAMPLE_DOCS
    limits = F.create_map(*[F.lit(x) for k, n in sorted(sizes.items()) for x in (k, min(parts, parts * 2 * SAMPLE_DOCS // max(n, 1) + 1))])
    drawn = F.pmod("h", F.lit(parts))
    spare = F.greatest(F.length("text") - WIDE * each, F.lit(0))
    piece = F.substring("text", F.pmod(F.xxhash64("h"), spare + 1).cast("int") + 1, F.lit(WIDE * each))
    chosen = rows.filter(drawn < F.element_at(limits, F.col("lang"))).select("lang", drawn.alias("u"), piece.alias("text")).distinct()
    found: dict[str, list[str]] = {}
    for r in sorted(chosen.collect(), key=lambda r: (r["lang"], r["u"], r["text"])):
        found.setdefault(r["lang"], []).append(r["text"])
    samples = {}
    for k, texts in found.items():
        # short texts leave their part to the others
        share, room = {}, SAMPLE_CHARS
        for i, t in sorted(enumerate(texts[:SAMPLE_DOCS]), key=lambda x: len(x[1])):
            share[i] = t[: room // (min(len(texts), SAMPLE_DOCS) - len(share))]
            room -= len(share[i])
        samples[k] = "\n".join(share[i] for i in sorted(share))
    return tuple(sorted((k, v) for k, v in samples.items() if any(c.isalpha() for c in v)))


def language_of(text: Column, samples: tuple[tuple[str, str], ...]) -> Column:
    """struct(lang_pred, score) of a text."""

    @F.arrow_udf("struct<lang_pred string, score double>")
    def predict(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        p = parser(samples)
        for batch in batches:
            out: list[tuple[str, float]] = []
            texts: list[str] = []
            held = 0
            for value in batch:
                texts.append(value.as_py() or "")
                held += len(texts[-1])
                if held >= CHUNK:
                    out += p.predict(texts)
                    texts, held = [], 0
            out += p.predict(texts)
            yield pa.StructArray.from_arrays([pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], pa.float64())], names=["lang_pred", "score"])

    return predict(text.cast("string"))


def predict(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, held_out, lang_pred, score."""
    samples = learn(docs)
    rows = docs.select("doc_id", (~in_training(F.col("doc_id"))).alias("held_out"), language_of(F.col("text"), samples).alias("p"))
    return rows.select("doc_id", "held_out", "p.lang_pred", "p.score")


def keep_known(docs: DataFrame, languages: Iterable[str] | None = None) -> DataFrame:
    """The documents whose predicted language is one of ``languages`` (any that was learned, if None)."""
    samples = learn(docs)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"), language_of(F.col("text"), samples).alias("__p"))
    wanted = F.col("__p.lang_pred") != UNDETERMINED if languages is None else F.col("__p.lang_pred").isin(*languages)
    return rows.filter(wanted).select("__row.*")
