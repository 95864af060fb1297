"""The corpus operators against brute force, the vocabulary's own library, round trips and held-out labels; and their edge cases."""

import hashlib
import io
import math
import re
import subprocess
import sys
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.llm import bpe, chat_format, common, lang_id, media, mixing, ngram_join, pii, quality, secrets, spans, toxicity
from plumbline.llm.components import components
from plumbline.llm.queries import vocabulary_path

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns that operators use inside, to clash with.
EXTRA = {"key": "k", "n": 1, "sig": "s", "page": 2, "held_out": True, "score": 0.5, "stratum": "x", "copies": 9, "__size": 4, "spans": "z", "size": 3}
SPACE = "[\\x20\\x09-\\x0D]"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, lang, s, None if t is None else len(t)) for i, t, lang, s in rows], DOCS)


def crowded(df):
    return df.select("*", *[F.lit(v).alias(k) for k, v in EXTRA.items()])


LONG = "word " * 60_000
EDGES = [
    (1, None, None, None), (2, "", "en", "b"), (3, " \n\t ", "en", "b"), (4, "Hello there", "en", "a"), (4, "Hello there", "en", "a"), (None, "password = abcdefghijklmnop", "en", "a"),
    (6, LONG, "de", "ä"), (7, "\x01\x02\x03\x04 +1 (555) 010-9999 a@b.co 1.2.3.4 ퟿\U0001f600", "fr", "b"), (8, "4111 1111 1111 1111 and 999.1.1.1", "en", None), (9, "no letters 123", None, "a"),
    (10, "#*$%&|<> 123", "en", "a"), (11, "one two three four five six", "en", "a"), (12, "one two three four five six", "en", "c"), (-5, "AKIA" + "A" * 16 + " x", "es", "a"),
]


@pytest.fixture(scope="module")
def edges(spark):
    return crowded(docs(spark, EDGES)).cache()


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(4, 1, 0), (8, None, 1), (None, 1, 1), (11, 0, 1), (99, 1, 1), (12, 1, None)], "doc_id long, quality int, toxic int")


OPERATORS = {
    "bpe": lambda d, l: bpe.code_round_trip(d, vocabulary_path()),
    "media": lambda d, l: media.describe(d),
    "join": lambda d, l: ngram_join.join(d),
    "lang": lambda d, l: lang_id.predict(d),
    "quality": lambda d, l: quality.assess(d, l),
    "secrets": lambda d, l: secrets.find(d),
    "toxicity": lambda d, l: toxicity.predict(d, l),
    "mixing": lambda d, l: mixing.mix(d),
    "pii": lambda d, l: pii.find(d),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_every_row_gets_a_row(edges, labels, name):
    got = OPERATORS[name](edges, labels).collect()
    assert Counter(r["doc_id"] for r in got) == Counter(i for i, *_ in EDGES)


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_tables(edges, labels, name):
    assert OPERATORS[name](edges.limit(0), labels.limit(0)).collect() == []


def test_bpe_matches_the_library(edges):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(vocabulary_path())
    t = bpe.Tokenizer(vocabulary_path())
    texts = [x or "" for _, x, *_ in EDGES] + ["<|endoftext|>a b<|startoftext|>", "ΑΣ ΣΑΣ İstanbul", "don't I'LL àé 12½", "日本語 😀👍🏽 x　y", "ab" * 3000, "a\x1cb \x85c", "the theatre's threadbare"]
    for text in texts:
        ids = np.frombuffer(t.encode(text), "<u4").tolist()
        assert ids == lib.encode(text, add_special_tokens=False).ids
        assert b"".join(t.decode(t.encode(text))).decode() == lib.decode(ids, skip_special_tokens=False)
    got = {r["doc_id"]: r for r in bpe.code_round_trip(edges, vocabulary_path()).collect()}
    assert got[1]["n_tokens"] == 0 and got[1]["decoded_sha256"] == hashlib.sha256(b"").hexdigest()


def test_bpe_matches_the_library_on_all_of_unicode():
    from random import Random

    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(vocabulary_path())
    t = bpe.Tokenizer(vocabulary_path())
    every = [chr(c) for c in range(1, 0x110000) if not 0xD800 <= c < 0xE000]
    texts = [" ".join(f"a{c}1{c}!{c}" for c in every[at : at + 200]) for at in range(0, 0x34000, 200)]
    rnd = Random(5)
    pools = [every[a:b] for a, b in ((0x20, 0x7F), (0x80, 0x250), (0x300, 0x370), (0x370, 0x1200), (0x1AB0, 0x2000), (0xA000, 0xB000), (0xF000, 0x1F000))]
    texts += ["".join(rnd.choice(rnd.choice(pools)) for _ in range(rnd.randint(1, 30))) for _ in range(4000)]
    for text in texts:
        assert np.frombuffer(t.encode(text), "<u4").tolist() == lib.encode(text, add_special_tokens=False).ids


def test_bpe_every_token_spells_itself():
    t = bpe.Tokenizer(vocabulary_path())
    t._known = 0
    assert all(t.encode_units(u) == [i] for u, i in t._ids.items())


def test_bpe_dataframe_round_trip(spark):
    d = docs(spark, [(1, "Some words here", "en", "a"), (2, None, None, None)])
    back = {r["doc_id"]: r["text"] for r in bpe.decode(bpe.encode(d, vocabulary_path()), vocabulary_path()).collect()}
    assert back == {1: "some</w> words</w> here</w>", 2: ""}


def brute_resize(pixels, rows, columns):
    """Means of areas by repeating every pixel until areas are whole."""
    h, w, c = pixels.shape
    whole = np.kron(pixels.astype(float), np.ones((rows, columns, 1)))
    return whole.reshape(rows, h, columns, w, c).mean(axis=(1, 3))


def brute_hash(pixels):
    """Bits of an image: whether each of 8 by 8 areas is darker than its right neighbour."""
    small = brute_resize(pixels, 8, 9)
    luma = np.round(small[:, :, 0] * 0.299 + small[:, :, 1] * 0.587 + small[:, :, 2] * 0.114, 6)
    bits = "".join("01"[int(luma[y, x] < luma[y, x + 1])] for y in range(8) for x in range(8))
    return f"{int(bits, 2):016x}"


def test_media_payload(spark, edges, monkeypatch):
    texts = [t for _, t, *_ in EDGES if len(t or "") < 1000] + ["rows of words " * 300, "é😀" * 900]
    got = {r["doc_id"]: r for r in media.describe(docs(spark, [(i, t, "en", "a") for i, t in enumerate(texts)])).collect()}
    for i, text in enumerate(texts):
        data = (text or "").encode()
        want = media.pad(data)
        r = got[i]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(data), len(want), hashlib.sha256(want).hexdigest(), zlib.crc32(want[-16:]))
        pixels = np.frombuffer(want, np.uint8).reshape(-1, 64, 3)
        assert (r["media_bytes"], r["media_sha256"]) == (len(media.encode_ppm(pixels)), hashlib.sha256(media.encode_ppm(pixels)).hexdigest())
        assert r["feature"] == brute_hash(pixels)
        small = brute_resize(pixels, -(-len(pixels) // 4), 16)
        assert len(r["tiles"]) == len(r["tile_hashes"]) == -(-len(small) // 16)
        for k, (tile, mark) in enumerate(zip(r["tiles"], r["tile_hashes"])):
            part = small[16 * k : 16 * k + 16]
            back = np.load(io.BytesIO(tile))
            assert back.shape == part.shape and back.dtype == np.uint8 and np.abs(back - part).max() <= 0.5 + 1e-6
            assert mark == brute_hash(part)
    assert {r["doc_id"] for r in media.describe(edges).collect()} == {i for i, *_ in EDGES}


def test_media_strips_make_no_difference(monkeypatch):
    rng = np.random.default_rng(3)
    for shape in ((37, 11, 3), (1, 5, 1), (64, 1, 3), (100, 64, 3)):
        pixels = rng.integers(0, 256, shape, np.uint8)
        for rows, columns in ((8, 9), (25, 16), (3, 2)):
            want = brute_resize(pixels, rows, columns)
            for strip in (1, 100, 1 << 20):
                monkeypatch.setattr(media, "STRIP", strip)
                assert np.allclose(media.area_resize(pixels, rows, columns), want)


def test_media_memory_of_a_huge_image():
    """A payload of 200 MB in less than 1 GB, in a process of its own."""
    code = "import resource, pyarrow as pa\nfrom plumbline.llm import media\nd = media.stored_form(b'some words ' * 19_000_000)\np = media.decode(d)\nn = len(media.tiled(p))\nmedia.difference_hash(p)\nprint(n, resource.getrusage(resource.RUSAGE_SELF).ru_maxrss // 1024)"
    n, peak = map(int, subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True).stdout.split())
    assert n == -(-(-(-(-(-209_000_000 // 192)) // 4)) // 16) and peak < 1000


def test_media_formats():
    rng = np.random.default_rng(0)
    pixels = rng.integers(0, 256, (5, 7, 3), np.uint8)
    assert (media.decode(media.encode_ppm(pixels)) == pixels).all()
    assert (media.decode(media.encode_bmp(pixels)) == pixels).all()
    assert media.decode(b"P1 # c\n2 2\n1 0 0 1").tolist() == [[[0], [255]], [[255], [0]]]
    assert media.decode(b"P4\n2 2\n\x80\x40").tolist() == [[[0], [255]], [[255], [0]]]
    assert media.decode(b"P2\n2 1\n15\n3 15").tolist() == [[[3], [15]]]
    for broken in (b"P6\n9 9\n255\nx", b"BM", b"GIF89a", b"P2\n2 1\n15\n3 16"):
        with pytest.raises(ValueError):
            media.decode(broken)
    small = media.area_resize(pixels, 2, 3)
    whole = np.kron(pixels.astype(float), np.ones((2, 3, 1)))
    assert np.allclose(small, whole.reshape(2, 5, 3, 7, 3).mean(axis=(1, 3)))


def test_media_tiles(spark):
    rows = [(1, media.encode_bmp(np.zeros((4, 4, 3), np.uint8))), (2, None)]
    got = {r["tile_of"]: r for r in media.tiles(spark.createDataFrame(rows, "tile_of long, image binary")).collect()}
    assert got[1]["dhash"] == "0" * 16 and got[1]["height"] == 4 and len(got[1]["tiles"]) == 1 and got[2]["tiles"] is None


def jaccard(a, b):
    return len(a & b) / len(a | b) if a and b else 0


def shingle_set(t):
    w = (t or "").encode().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def near_copies():
    rng = np.random.default_rng(5)
    vocab = [f"w{i}" for i in range(500)]
    rows = []
    for base in range(12):
        words = list(rng.choice(vocab, 120))
        for copy in range(6):
            w = list(words)
            for j in rng.integers(0, len(w), copy % 4):
                w[j] = "changed" + str(copy)
            rows.append((len(rows), " ".join(w), "en", "a"))
    return rows + [(900, "a b", "en", "a"), (901, "a b", "en", "a"), (902, "a c", "en", "a"), (903, None, "en", "a"), (904, "", "en", "a")]


def expected_classes(rows):
    sets = {i: shingle_set(t) for i, t, *_ in rows}
    up = {i: i for i in sets}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    links = Counter()
    for a in sets:
        for b in sets:
            if a < b and jaccard(sets[a], sets[b]) >= 0.8:
                links[a] += 1
                links[b] += 1
                x, y = sorted((root(a), root(b)))
                up[y] = x
    return {i: (root(i), links[i]) for i in sets}


@pytest.mark.parametrize("block", [256, 2])
def test_join_matches_brute_force(spark, block, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    rows = near_copies()
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in ngram_join.join(docs(spark, rows)).collect()}
    want = expected_classes(rows)
    assert got == want
    kept = sorted(r["doc_id"] for r in ngram_join.keep_one(crowded(docs(spark, rows))).collect())
    assert kept == sorted({c for c, _ in want.values()})


def test_one_of_each_class_stays_whatever_its_ids(spark):
    texts = {c: " ".join(f"{c}{i}" for i in range(60)) for c in "abcdef"}
    near = texts["d"].replace("d30", "other")
    rows = [(None, texts["a"]), (None, texts["a"]), (None, texts["b"]), (None, texts["b"]), (5, texts["c"]), (5, texts["c"]), (None, texts["d"]), (5, near), (7, texts["d"] + " end"), (5, texts["e"]), (5, texts["e"]), (None, texts["f"])]
    got = [(r["doc_id"], r["text"]) for r in ngram_join.keep_one(docs(spark, [(i, t, "en", "s") for i, t in rows])).collect()]
    assert sorted(got, key=lambda r: r[1]) == sorted([(None, texts["a"]), (None, texts["b"]), (5, texts["c"]), (5, near), (5, texts["e"]), (None, texts["f"])], key=lambda r: r[1])


def test_join_depth_meets_recall():
    d = ngram_join.depth_for()
    assert 1 - (1 - 0.8**d) ** (ngram_join.HASHES // d) >= ngram_join.RECALL > 1 - (1 - 0.8 ** (d + 1)) ** (ngram_join.HASHES // (d + 1))


def test_trie_is_walked_from_its_deepest_prefixes():
    rng = np.random.default_rng(8)
    base = rng.integers(0, 2**32, (6, ngram_join.HASHES), np.uint32)
    rows = []
    for b in base:
        for changes in (0, 3, 9, 14):
            r = b.copy()
            r[rng.choice(np.arange(ngram_join.DEPTH, len(r)), changes, replace=False)] = rng.integers(0, 2**32, changes, np.uint32)
            rows.append(r)
    sigs = np.array(rows)
    order, shared = ngram_join.trie_order(sigs)
    for k in range(len(order) - 1):
        a, b = sigs[order[k]].tolist(), sigs[order[k + 1]].tolist()
        assert a <= b and shared[k] == next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    for side in (None, np.arange(len(sigs)) % 2):
        edges = ngram_join.descend(sigs, 0, side)
        forest = ngram_join.Forest(len(sigs))
        for i in range(len(sigs)):
            for j in range(i):
                if (sigs[i] == sigs[j]).sum() >= ngram_join.AGREE and (side is None or side[i] != side[j]):
                    forest.join(i, j)
        got = ngram_join.Forest(len(sigs))
        for i, j in edges:
            assert (sigs[i] == sigs[j]).sum() >= ngram_join.AGREE
            got.join(i, j)
        assert len(got.edges) == len(edges)  # no pair that was connected is joined again
        assert [got._root(i) for i in range(len(sigs))] == [forest._root(i) for i in range(len(sigs))]


def test_components_with_a_hot_node(spark, monkeypatch):
    monkeypatch.setattr("plumbline.llm.components.SAMPLE", 1)
    e = [(0, i) for i in range(1, 200)] + [(300 + i, 301 + i) for i in range(9)] + [(150, 300)]
    got = dict(map(tuple, components(spark.createDataFrame(e, "a long, b long")).collect()))
    assert got == {i: 0 for i in [*range(200), *range(300, 310)]}


def test_components(spark):
    e = [(i, i + 1) for i in range(40)] + [(100, 101), (7, 7), (103, 102)]
    got = dict(map(tuple, components(spark.createDataFrame(e, "a long, b long")).collect()))
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100, 102: 102, 103: 102}


def test_language_held_out(spark):
    rng = np.random.default_rng(2)
    parts = {"en": ["the", "ing", "er", "th"], "de": ["sch", "keit", "ü", "ung"], "es": ["ción", "ado", "que", "ñ"]}
    rows = [(i, " ".join("".join(rng.choice(parts[k], 3)) for _ in range(60)), k, "a") for i, k in enumerate(list(parts) * 40)]
    got = lang_id.predict(docs(spark, rows)).collect()
    held = [r for r in got if r["held_out"]]
    assert held and all(r["lang_pred"] == rows[r["doc_id"]][2] and 0 <= r["score"] <= 1 for r in held)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got)


def parsed(t, sample):
    n = j = 0
    while j < len(t):
        b = j if t[j] in sample else j + 1
        k = b
        while k < len(t) and t[b : k + 1] in sample:
            k += 1
        n, j = n + 1, k
    return n


@pytest.mark.parametrize(("segment", "dense"), [(3, 0), (3, 1 << 24), (512, 0), (512, 1 << 24)])
def test_language_phrases_match_brute_force(segment, dense, monkeypatch):
    monkeypatch.setattr(lang_id, "SEGMENT", segment)
    monkeypatch.setattr(lang_id, "DENSE", dense)
    rng = np.random.default_rng(6)
    words = lambda pool, n: " ".join("".join(rng.choice(list(pool), rng.integers(1, 7))) for _ in range(n))
    samples = {"a": "the cat sat on the mat " + words("abcd", 80), "b": "un chat noir ééé " + words("bcdx", 30), "c": words("日本語中文字", 40)}
    p = lang_id.Parser(samples)
    form = lambda t: re.sub(" +", " ", "".join(c if c.isalpha() else " " for c in t.lower()))
    texts = ["The catmat, sat!", "", "é zzz chat", "noir " * 400, "x", words("abcd", 500), words("bcdxyz", 300), samples["a"] * 3, words("日本語中", 90), "12 " * 9]
    counts, letters = p.phrases(texts)
    assert counts.tolist() == [[parsed(form(t), form(samples[k])) for k in p.languages] for t in texts]
    assert letters.tolist() == [sum(c.isalpha() for c in t) for t in texts]
    assert p.predict(["", "12"]) == [("und", 0.0)] * 2
    for t, (lang, _) in zip(texts, p.predict(texts), strict=True):
        cost = [max(parsed(form(t), form(samples[k])), 1) * math.log(len(form(samples[k]))) for k in p.languages]
        assert lang == ("und" if not any(map(str.isalpha, t)) else p.languages[cost.index(min(cost))])


def test_language_with_a_longer_sample_has_no_advantage():
    rng = np.random.default_rng(1)
    parts = {"en": ["th", "ing", "er", "on"], "xx": ["th", "ung", "er", "an"]}
    word = lambda k: "".join(rng.choice(parts[k], 3))
    p = lang_id.Parser({"en": " ".join(word("en") for _ in range(3000)), "xx": " ".join(word("xx") for _ in range(60))})
    texts = [(k, " ".join(word(k) for _ in range(120))) for k in parts for _ in range(20)]
    assert [x for x, _ in p.predict([t for _, t in texts])] == [k for k, _ in texts]


def test_language_tables_follow_the_samples_not_the_alphabet():
    rng = np.random.default_rng(2)
    samples = {f"l{i}": "".join(map(chr, rng.integers(0x4E00, 0x9F00, lang_id.SAMPLE_CHARS))) for i in range(3)}
    p = lang_id.Parser(samples)
    assert p._moves._keys.nbytes + p._moves._values.nbytes + p._starts.nbytes < 64 << 20
    assert [x for x, _ in p.predict([samples[k][500:900] for k in sorted(samples)])] == sorted(samples)


def quality_counts(t):
    w = re.findall("[^\\x20\\x09-\\x0D]+", t)
    tri = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    c = Counter(tri)
    covered = {i + k for i, x in enumerate(tri) if c[x] > 1 for k in range(3)}
    lines = [x for x in t.split("\n") if re.search("[^\\x20\\x09-\\x0D]", x)]
    return len(w), sum(map(len, w)), sum(t.count(s) for s in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)


def test_quality_counts(spark, labels):
    texts = ["a b c a b c", "a a a a a", "x\n x\nx\n\n", "# a|b <c> é f", LONG, "one two three " * 40, " ".join(f"w{i % 90} v{i} " for i in range(400)), " ".join(f"w{i % 150}" for i in range(400))]
    rows = quality.assess(docs(spark, [(i, t, "en", "a") for i, t in enumerate(texts)]), labels).collect()
    for r in rows:
        n = quality_counts(texts[r["doc_id"]])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == n
        assert r["base_failed"] == (n[0] < 50 or 100 * n[4] > 50 * n[0])
        assert not (r["kept"] and r["base_failed"])


def test_binomial_tail(spark):
    cases = [(0, 10, 0.1), (3, 200, 0.05), (9, 400, 0.05), (40, 5000, 0.0125), (20, 20, 0.5)]
    for k, n, p in cases:
        got = spark.range(1).select(quality.binomial_tail(F.lit(k), F.lit(n), p)).first()[0]
        want = 1.0 if k >= n * p else sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))
        assert got == pytest.approx(want, rel=1e-9)


def test_cutoffs_hold_back_without_evidence(spark):
    names = [f"level_{r}" for r in quality.RULES]
    many = [("en", True, *[0] * len(names))] * 2000 + [("de", True, *[0] * len(names))] * 20
    got = {r["stratum"]: r for r in quality.choose_cutoffs(spark.createDataFrame(many, ["stratum", "good", *names])).collect()}
    # no good document has any badness, so the strictest cutoff holds
    assert all(got["en"][f"from_{r}"] == 1 for r in quality.RULES)
    assert "de" not in got


def tail(k, n, p):
    return 1.0 if k >= n * p else sum(math.exp(math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p)) for i in range(k + 1))


def expected_cutoffs(levels, strata):
    """(rule, level) of good documents of a stratum -> the level that each rule rejects from, by trying cutoffs from the mildest on."""
    out = {}
    for rule, cuts in quality.RULES.items():
        out[rule] = 99
        for level in range(len(cuts), 0, -1):
            k = sum(x >= level for x in levels[rule])
            if tail(k, len(levels[rule]), quality.ALPHA / len(quality.RULES)) > quality.DELTA / (strata * len(quality.RULES)):
                break
            out[rule] = level
    return out


def test_cutoffs_match_brute_force(spark):
    rng = np.random.default_rng(11)
    rows = []
    for stratum, n, often in (("en", 3000, 0.004), ("de", 900, 0.002), (None, 1500, 0.03), ("xx", 40, 0.0)):
        for _ in range(n):
            level = [int(rng.integers(1, len(c) + 1)) if rng.random() < often * (1 + i) else 0 for i, c in enumerate(quality.RULES.values())]
            rows.append((stratum, True, *level))
        rows.append((stratum, False, *[1] * len(quality.RULES)))
    got = {r["stratum"]: r for r in quality.choose_cutoffs(spark.createDataFrame(rows, "stratum string, good boolean, " + ", ".join(f"level_{r} int" for r in quality.RULES))).collect()}
    chosen = set()
    for stratum in ("en", "de", None, "xx"):
        own = [r for r in rows if r[0] == stratum and r[1]]
        want = expected_cutoffs({rule: [r[2 + i] for r in own] for i, rule in enumerate(quality.RULES)}, 4)
        assert {rule: got[stratum][f"from_{rule}"] if stratum in got else 99 for rule in quality.RULES} == want
        chosen |= set(want.values())
        for i, rule in enumerate(quality.RULES):
            assert sum(r[2 + i] >= want[rule] for r in own) <= quality.ALPHA / len(quality.RULES) * len(own)
    assert 99 in chosen and chosen - {1, 99}


def test_kept_matches_brute_force(spark):
    plain = [(i, " ".join(f"w{i}x{j}" for j in range(60)), "en", "a") for i in range(900)]
    noisy = [(2000 + i, " ".join(f"n{i}x{j}" + "$$$" * (j % 3 == 0) for j in range(60)), "en", "a") for i in range(30)]
    rows = [*plain, *noisy, (4000, "too short", "en", "a"), (4001, None, "en", "a"), (4002, noisy[0][1], "de", "a")]
    marks = [(i, int(i < 2000), 0) for i, *_ in plain + noisy if i % 2 == 0]
    got = {r["doc_id"]: r["kept"] for r in quality.assess(docs(spark, rows), spark.createDataFrame(marks, "doc_id long, quality int, toxic int")).collect()}
    # the noisy ones go; those of a stratum without labels stay
    assert got == {i: (i < 2000 or i == 4002) for i, *_ in rows}


BASE = (
    ("assign", re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), lambda m: len(m[1]) >= 12),
    ("access", re.compile("AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 18),
    ("hex", re.compile("[0-9a-f]+"), lambda m: len(m[0]) >= 16),
)


def spelled(t, base):
    found = sorted((m.start(), k, m.end()) for k, (_, p, ok) in enumerate(base) for m in p.finditer(t) if ok(m))
    return ",".join(f"{base[k][0]}:{a}:{b}" for a, k, b in found)


SECRETS = ["token=secret:abcdefghijklmnop", "api_key: 'ABCDEFGHIJKLMNOP' é Password=aaaaaaaaaaaa", "AKIAAKIA AKIA" + "Z9" * 9, "deadbeefdeadbeef0 0123456789abcde", "x" * 50, "token token = \"aaaaaaaaaaaaa=\"", "\x01token=\x02aaaaaaaaaaaaaaaa", ""]


def test_secret_base_spans(spark):
    got = {r["doc_id"]: r for r in secrets.find(docs(spark, [(i, t, "en", "a") for i, t in enumerate(SECRETS)])).collect()}
    for i, t in enumerate(SECRETS):
        want = spelled(t, BASE)
        assert got[i]["base_sha256"] == hashlib.sha256(want.encode()).hexdigest()
        assert set(filter(None, want.split(","))) <= set(got[i]["spans"].split(","))


def test_secret_linking(spark):
    bare, url = "A1b2" * 10, "https://api.example.org/v1"
    texts = [f"{bare} {url}", f"client_id = abc123 {bare} {url}", f"client_id = abc123 {'. ' * 300} {bare}", f"client_id = abc123\n\n{bare}"]
    got = [r["spans"] for r in secrets.find(docs(spark, [(i, t, "en", "a") for i, t in enumerate(texts)])).orderBy("doc_id").collect()]
    assert got[0] == "" and got[2] == "" and got[3] == ""
    assert [s.split(":")[0] for s in got[1].split(",")] == ["identifier", "secret40", "endpoint"]


def test_secrets_are_cut_out(spark):
    d = crowded(docs(spark, [(1, "a password=abcdefghijkl0 b", "en", "a"), (2, None, None, None)]))
    got = {r["doc_id"]: r for r in secrets.redact(d).collect()}
    assert got[1]["text"] == "a [ASSIGN] b" and got[1]["n_chars"] == 12 and got[2]["text"] is None
    assert secrets.redact(d).columns == d.columns


def luhn(d):
    return sum(int(c) if i % 2 == 0 else (2 * int(c) - 9 if int(c) > 4 else 2 * int(c)) for i, c in enumerate(reversed(d))) % 10 == 0


def digits(s):
    return re.sub("[^0-9]", "", s)


PII = (
    ("email", re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), lambda m: True),
    ("ip", re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), lambda m: all(int(x) <= 255 for x in m[0].split("."))),
    ("card", re.compile(r"[0-9]([\x20-]?[0-9])+"), lambda m: 14 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))),
    ("phone", re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"), lambda m: 10 <= len(digits(m[0])) <= 15),
)
PERSONAL = ["a@b.c_d@e.f x@y", "1.2.3.4.5.6.7.8 0255.1.1.01 256.1.1.1", "4111 1111-1111 1111 4111111111111112 1-2", "+1 (555) 010-9999) +12 +1234567890123456", "+" * 40 + "a" * 3000 + "@", "1" * 3000, "é a.b%c@d-e.f.g-", ""]


def test_personal_base_spans(spark):
    got = {r["doc_id"]: r for r in pii.find(docs(spark, [(i, t, "en", "a") for i, t in enumerate(PERSONAL)])).collect()}
    for i, t in enumerate(PERSONAL):
        want = spelled(t, PII)
        assert got[i]["base_sha256"] == hashlib.sha256(want.encode()).hexdigest(), t
        assert set(filter(None, want.split(","))) <= set(got[i]["spans"].split(","))


def overlaps(a, b):
    return a[0] < b[1] and b[0] < a[1]


def test_touching_spans_match_brute_force(spark):
    rng = np.random.default_rng(4)

    def some(n):
        starts = sorted(rng.integers(0, 300, n).tolist())
        return [(s, s + int(rng.integers(1, 30))) for s in starts]

    rows = [(i, some(rng.integers(0, 12)), some(rng.integers(0, 12))) for i in range(60)]
    df = spark.createDataFrame(rows, "i int, a array<struct<s:int,e:int>>, b array<struct<s:int,e:int>>")
    got = {r["i"]: r["t"] for r in df.select("i", spans.touches(F.col("a"), F.col("b")).alias("t")).collect()}
    assert got == {i: [any(overlaps(x, y) for y in b) for x in a] for i, a, b in rows}


def test_text_by_position(spark):
    text = "".join(chr(97 + i % 26) + ("\U0001f600" if i % 7 == 0 else "") + ("\n" if i % 50 == 0 else "") for i in range(900))
    at = [(0, 0), (0, 1), (255, 257), (256, 256), (10, 800), (0, len(text)), (len(text), len(text) + 1), (511, 513)]
    df = spark.createDataFrame([(text, a, b) for a, b in at], "t string, a int, b int")
    assert [r[0] for r in df.select(spans.taken(spans.chunks(F.col("t")), F.col("a"), F.col("b"))).collect()] == [text[a:b] for a, b in at]


def test_batches_are_bounded_and_never_widened(spark):
    names = ["spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"]
    for given, want in ((("10000", "1g"), ("1000", "33554432")), (("7", "1m"), ("7", "1m")), (("0", "5000b"), ("1000", "5000b"))):
        for name, value in zip(names, given, strict=True):
            spark.conf.set(name, value)
        common.bounded_batches(spark)
        assert tuple(spark.conf.get(n).removesuffix("b") for n in names) == tuple(v.removesuffix("b") for v in want)
    for name in names:
        spark.conf.unset(name)


def test_many_spans_in_one_text(spark):
    n = 30_000
    text = "".join(f"{i:016x} x " for i in range(n)) + "client_id = abcdef +1 (555) 010-9999 4111 1111 1111 1111"
    d = docs(spark, [(1, text, "en", "a")])
    r = secrets.find(d).first()
    assert r["n_hex"] == n and r["spans"].startswith("hex:0:16,hex:19:35,") and ",identifier:" in r["spans"]
    assert secrets.redact(d).first()["text"].startswith("[HEX] x [HEX] x ") and secrets.redact(d).first()["text"].count("[HEX]") == n
    text = "".join(f"{1000000000 + i} x " for i in range(n)) + "+1 (555) 010-9999 a@b.co"
    r = pii.find(docs(spark, [(1, text, "en", "a")])).first()
    assert (r["n_email"], r["n_phone"], r["n_card"]) == (1, 1, 0)


def made_up_people(n=1600):
    """Rows, and the spans in them that are personal data which no base pattern finds."""
    rng = np.random.default_rng(9)
    rows, novel, decoys = [], {}, {}
    for i in range(n):
        number = f"{rng.integers(200, 999)} {rng.integers(100, 999)} {rng.integers(1000, 9999)}"
        text, extra = {0: (f"please call +1 {number} now", None), 1: (f"write to mail{i}@host{i % 9}.example.com today", None), 2: (f"part {rng.integers(10**15, 10**16)} is in stock", None), 3: (f"order 17 of {rng.integers(1000, 9999)}/{rng.integers(10, 99)}/{rng.integers(1000, 9999)} shipped", None)}[i % 4]
        if i % 80 == 0:
            extra = f"1 {number}"
            text = f"please call {extra} now"
        if i % 80 == 1:
            extra = f"mail{i} (at) host{i % 9} (dot) example (dot) com"
            text = f"write to {extra} today"
        rows.append((i, text, "en", "a"))
        if extra:
            novel[i] = (text.index(extra), text.index(extra) + len(extra))
        elif i % 4 > 1:
            decoys[i] = text
    return rows, novel, decoys


def test_personal_data_that_no_base_pattern_finds(spark):
    rows, novel, decoys = made_up_people()
    got = {r["doc_id"]: r["spans"] for r in pii.find(docs(spark, rows)).collect()}
    found = {i: tuple(map(int, x.split(":")[1:])) for i, v in got.items() for x in v.split(",") if x.startswith("x_")}
    right = sum(found.get(i) == span for i, span in novel.items())
    assert right >= 0.9 * len(novel)
    assert len(found) <= right / 0.9
    assert not any("x_" in got[i] for i in decoys if not luhn(digits(decoys[i])))


def test_checks_of_candidates(spark):
    cases = [(4, "a.b (at) c (dot) de", True), (4, "a@b.co", True), (4, "ä@b.co", False), (5, "4111.1111.1111.1111", True), (5, "4111.1111.1111.1112", False), (6, "GB82 WEST 1234 5698 7654 32", True), (6, "GB83 WEST 1234 5698 7654 32", False), (6, "AB12 CD", False)]
    df = spark.createDataFrame(cases, "k int, m string, y boolean")
    assert all(r["got"] == r["y"] for r in df.select("y", pii.checked(F.col("k"), F.col("m"), F.regexp_replace("m", "[^0-9]", "")).alias("got")).collect())


def test_boosting_separates():
    rows = [((5, d, 3, 2, 2, 1, 1, c, 0), 40.0 if d == 16 or c else 0.0, 0.0 if d == 16 or c else 40.0) for d in range(7, 20) for c in (0, 1)]
    m = pii.Boosted(rows)
    assert min(m.score(x) for x, p, _ in rows if p) > max(m.score(x) for x, _, n in rows if n)
    assert set(pii.cutoffs(m, rows)) == {5}


def test_toxicity_risk_matches_brute_force():
    rng = np.random.default_rng(0)
    zp, zu = rng.normal(1, 2, 50), rng.normal(-1, 2, 300)
    loss = lambda z, y: math.log(1 + math.exp(-y * z))
    pos, neg = toxicity.risk(zp, zu, 0.2)
    assert pos == pytest.approx(0.2 * sum(loss(z, 1) for z in zp) / 50)
    assert neg == pytest.approx(sum(loss(z, -1) for z in zu) / 300 - 0.2 * sum(loss(z, -1) for z in zp) / 50)


def test_toxicity_fit_is_a_minimum_and_corrects_for_the_prior():
    rng = np.random.default_rng(7)
    draw = lambda y: {w for w, p, q in (("a", 0.8, 0.1), ("b", 0.5, 0.2), ("c", 0.3, 0.3)) if rng.random() < (p if y else q)}
    truth = rng.random(6000) < 0.3
    pos, unl = [draw(True) for _ in range(2000)], [draw(y) for y in truth]
    m = toxicity.Model(["a", "b", "c"], pos, unl, 0.3)
    x = lambda sets: np.array([[w in s for w in "abc"] + [1] for s in sets], float)
    w = np.array([m.weights.get(k, 0.0) for k in "abc"] + [m.bias])
    at = lambda v: sum(toxicity.risk(x(pos) @ v, x(unl) @ v, 0.3)) + toxicity.DECAY / 2 * (v[:-1] ** 2).sum()
    assert all(at(w) <= at(w + 0.1 * rng.normal(size=4)) + 1e-4 for _ in range(50))
    # scores are the true probabilities, though no negative example was shown
    for s in ({"a", "b"}, {"a"}, {"b"}, set()):
        chance = lambda y: math.prod((p if y else q) if w in s else 1 - (p if y else q) for w, p, q in (("a", 0.8, 0.1), ("b", 0.5, 0.2), ("c", 0.3, 0.3)))
        score = 1 / (1 + math.exp(-(m.bias + sum(m.weights.get(k, 0) for k in s))))
        assert score == pytest.approx(0.3 * chance(True) / (0.3 * chance(True) + 0.7 * chance(False)), abs=0.08)


def test_toxicity_words_match_brute_force(spark):
    rng = np.random.default_rng(1)
    rows = [(bool(i % 4 == 0), sorted({f"w{j}" for j in rng.integers(0, 40, 6)} | ({"bad"} if i % 4 == 0 and i % 3 else set()))) for i in range(200)]
    n, m = 50, 150
    count = Counter((w, y) for y, ws in rows for w in ws)

    def pull(w):
        p, u = count[w, True], count[w, False]
        every = (p + u + 1) / (n + m + 2)
        return round(abs(p / n - u / m) / math.sqrt(every * (1 - every) * (1 / n + 1 / m)), 9)

    want = sorted({w for w, _ in count if count[w, True] >= 3}, key=lambda w: (-pull(w), w))[:10]
    assert toxicity.choose(spark.createDataFrame(rows, "positive boolean, words array<string>"), 10) == want and want[0] == "bad"


def test_toxicity_learns(spark):
    rng = np.random.default_rng(3)
    plain = [f"word{i}" for i in range(200)]
    rows, marks = [], []
    for i in range(400):
        bad = i % 5 == 0
        rows.append((i, " ".join([*rng.choice(plain, 40), *(["nasty", "vile"] if bad else [])]), "en", "a"))
        if i % 2 == 0:
            marks.append((i, 1, int(bad)))
    got = toxicity.predict(docs(spark, rows), spark.createDataFrame(marks, "doc_id long, quality int, toxic int")).collect()
    held = [r for r in got if r["held_out"]]
    assert all(r["predicted"] == int(r["doc_id"] % 5 == 0) for r in held)


def test_mixing_targets(spark):
    rows = [(i, "w " * (1 + i % 7), "en", f"s{i % 4}" if i % 9 else None) for i in range(3000)]
    got = mixing.mix(docs(spark, rows)).collect()
    total = sum(r["size"] for r in got)
    assert sum({r["source_size"]: r["target"] for r in got}.values()) == pytest.approx(1.5 * total)
    for size, target in {(r["source_size"], r["target"]) for r in got}:
        assert target <= 2 * size + 1e-6
        assert sum(r["taken"] for r in got if r["source_size"] == size) == pytest.approx(target, rel=0.1)
    assert all(r["taken"] <= 2 * r["size"] for r in got)
    assert sorted(map(tuple, mixing.mix(docs(spark, rows).repartition(7)).collect())) == sorted(map(tuple, got))
    d = crowded(docs(spark, rows))
    assert mixing.emit(d).count() == sum(r["copies"] for r in got) and mixing.emit(d).columns == d.columns


TURNS = "conv_id long, turn long, role string, text string"


def test_chat_rotation(spark):
    rows = [(1, 0, "system", "Be kind."), (1, 1, "ann", "Hi"), (1, 2, "bob", "Yo é"), (1, 3, None, None), (2, 0, "system", "alone"), (None, None, "ann", "x"), (1, 1, "ann", "Hi")]
    got = {(r["conv_id"], r["perspective"]): r for r in chat_format.render(crowded(spark.createDataFrame(rows, TURNS)).withColumn("part", F.lit(7))).collect()}
    assert set(got) == {(1, "ann"), (1, "bob"), (1, "unknown"), (None, "ann")}
    r = got[1, "ann"]
    assert r["text"].startswith("<|im_start|>system\nBe kind.<|im_end|>\n<|im_start|>assistant\nHi<|im_end|>\n<|im_start|>assistant\nHi<|im_end|>\n<|im_start|>user name=bob\nYo é")
    learned = [r["text"][int(a) : int(b)] for a, b in (s.split(":") for s in r["mask"].split(","))]
    assert learned == ["Hi<|im_end|>"] * 2
    assert chat_format.render(spark.createDataFrame([], TURNS)).collect() == []


def rendered(rows, most):
    """(conv_id, perspective, part) -> (n_turns, text, mask) by plain loops."""
    want = {}
    for c in {d for d, *_ in rows}:
        turns = sorted(((t is not None, t or 0), r or "unknown", x or "") for d, t, r, x in rows if d == c)
        for speaker in {r for _, r, _ in turns} - {"system"}:
            for at in range(0, len(turns), most):
                text, mask = "", []
                for _, r, x in turns[at : at + most]:
                    text += "<|im_start|>" + ("system" if r == "system" else "assistant" if r == speaker else f"user name={r}") + "\n"
                    mask += [f"{len(text)}:{len(text) + len(x) + 10}"] if r == speaker else []
                    text += x + "<|im_end|>\n"
                want[c, speaker, at // most] = (len(turns[at : at + most]), text, ",".join(mask))
    return want


def chat(spark, rows):
    got = chat_format.render(spark.createDataFrame(rows, TURNS)).collect()
    out = {(r["conv_id"], r["perspective"], r["part"]): (r["n_turns"], r["text"], r["mask"]) for r in got}
    assert len(out) == len(got)
    return out


@pytest.mark.parametrize("most", [7, 1024])
def test_chat_matches_brute_force(spark, most, monkeypatch):
    monkeypatch.setattr(chat_format, "MOST", most)
    rows = [(c, None if i % 4 == 0 else i % 3, ["ann", "bob", "system"][i % 5 % 3], f"t{i * 7 % 90}") for i in range(90) for c in (1, None)]
    rows += [(1, 70, "ann", "same")] * 33 + [(2, 1, "bob", "one"), (2, 0, "ann", None), (3, 0, "system", "alone")]
    rows += [(4, 2**53 * (1 - 2 * (i % 2)) + i, ["ann", "bob"][i % 2], f"é{i}") for i in range(40)] + [(4, 2**63 - 1, None, "last"), (4, -(2**63), "bob", "first")]
    assert chat(spark, rows) == rendered(rows, most)


def test_chat_hot_and_equal_turns(spark):
    rows = [(1, 2**53 + i // 3, "ann" if i % 2 else "bob", f"t{i}") for i in range(3000)] + [(1, 5, "ann", "same")] * 3000 + [(2, 0, "ann", "x")]
    got = chat(spark, rows)
    assert got == rendered(rows, chat_format.MOST) and max(p for _, _, p in got) == 5


def test_pipeline_stages(spark, edges, tmp_path):
    import corpus_pipeline

    rows = docs(spark, EDGES)
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, rows, str(tmp_path))
        if i + 1 < len(corpus_pipeline.STAGES):
            assert out.columns == rows.columns, name
        out.write.parquet(str(tmp_path / str(i)))
        rows = spark.read.parquet(str(tmp_path / str(i)))
    assert "n_tokens" in rows.columns


def test_personal_data_models_and_cutoffs_come_from_all_documents(spark, monkeypatch):
    seen = []
    fitted, cut = pii.Boosted.__init__, pii.cutoffs
    monkeypatch.setattr(pii.Boosted, "__init__", lambda self, rows: (seen.append(sum(p + n for _, p, n in rows)), fitted(self, rows))[1])
    monkeypatch.setattr(pii, "cutoffs", lambda model, rows: (seen.append(sum(p + n for _, p, n in rows)), cut(model, rows))[1])
    pii.fit(spark.range(30000).select(F.col("id").alias("doc_id"), F.concat(F.lit("number 12-34-"), (F.col("id") % 9000 + 1000).cast("string")).alias("text")))
    assert sum(seen) == 30000 and min(seen) > 14000
