"""Operators against brute force on small fixtures, with null, empty, long, repeated and tied rows."""

import hashlib
import itertools
import json
import math
import random
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from seqloom.llm import binary_records as R, jaccard_join as J, media, mixing, neighbours, packing, quotations, suffix_tree as T, toxicity as X, url_filter as U
from seqloom.llm.components import connected
from seqloom.llm.common import Workspace, qualified
from seqloom.llm.tokens import PieceEncoder, default_path

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ODD = ["", " ", "\n\n a", "a  b", "it's  'quoted' 3.14\t\ttab\n\n\nx", "\x1cfoo bar\x1d baz", "a | b|c | d", "<|endoftext|> x<|endoftext|>y", "ΑΣ ΟΔΥΣΣΕΥΣ İstanbul", "e\u0301 é \u3000 x\xa0y", "  lead trail  ", "123 456,78", " a  b", "a\nb\n c", "x\0y \0z", "A,b. C.d, ,e", "é. Ü, ß"]


def documents(spark, texts, sources=None, ids=None):
    rows = [((ids or range(len(texts)))[i], t, (sources or ["s"] * len(texts))[i]) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string")


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_pieces_equal_whole_texts(name):
    coder = PieceEncoder(default_path(name))
    assert coder.mode

    def whole(t):
        return np.array(coder.tok.encode(t, add_special_tokens=False).ids, dtype="<u4").tobytes()

    assert coder.encode(ODD) == [whole(t) for t in ODD]

    @settings(max_examples=150, deadline=None)
    @given(st.text(st.sampled_from(" \n\t.,'abcXYé\xa0\u20281|\0\x1c\u0301#"), max_size=25))
    def check(t):
        assert coder.encode([t]) == [whole(t)]

    check()
    small = PieceEncoder(default_path(name), limit=40)  # its memory starts anew again and again

    @settings(max_examples=60, deadline=None)
    @given(st.lists(st.lists(st.tuples(st.sampled_from(["a", "Word", "word", "été", "Été", "straße", "x1", "3.14", "it's", "×", "|", ".", ",", "\x01", "漢字", "😀", "e\u0301"]), st.sampled_from(["", ".", ",", ".,"]), st.sampled_from(" \n")), max_size=9), max_size=6))
    def check_many(texts):
        texts = ["".join(w + stop + gap for w, stop, gap in t)[:-1] for t in texts]
        for c in (coder, small):
            assert c.encode(texts) == [whole(t) for t in texts]

    check_many()
    long = " ".join(f"w{i % 977}é{i % 7}." for i in range(200_000))
    assert coder.encode(["a b", long, "", "b\na"]) == [whole(t) for t in ("a b", long, "", "b\na")]


def test_pieces_of_one_hash_are_told_apart(monkeypatch):
    from seqloom.llm import tokens

    monkeypatch.setattr(tokens, "_scramble", lambda x: x & np.uint64(0xF0F0))  # hashes of eight bits
    coder = PieceEncoder(default_path("byte_bpe_50k.json"))
    texts = [" ".join(f"{'abcdefgh'[i % 8]}{'xyz'[i % 3] * (i % 5 + 1)}" for i in range(k)) for k in range(1, 60)]
    assert coder.encode(texts) == [np.array(coder.tok.encode(t, add_special_tokens=False).ids, dtype="<u4").tobytes() for t in texts]


def best_fit_decreasing(lengths, capacity):
    gaps = []
    for n in sorted(lengths, reverse=True):
        fit = [i for i, g in enumerate(gaps) if g >= n]
        if fit:
            gaps[min(fit, key=lambda i: gaps[i])] -= n
        else:
            gaps.append(capacity - n)
    return len(gaps)


def test_packing(spark):
    rng = random.Random(3)
    texts = [" ".join("word" for _ in range(rng.choice([0, 1, 3, 9, 20, 70]))) for _ in range(150)] + [None, "", "word " * 300]
    docs = documents(spark, texts, ids=[None, 7, 7, *range(3, len(texts))])
    rows = packing.pack_documents(docs.withColumn("sequence_id", F.lit(1)), capacity=32).collect()
    coder = PieceEncoder(default_path(packing.TOKENIZER))
    want = []
    for r in docs.collect():
        raw = coder.encode([r.text or ""])[0] + bytes(4)
        want += [(r.doc_id, k, at // 4, len(raw[at : at + 128]) // 4, zlib.crc32(raw[at : at + 128])) for k, at in enumerate(range(0, len(raw), 128))]
    key = lambda x: tuple((v is not None, v) for v in x)
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows), key=key) == sorted(want, key=key)
    places = {}
    for r in rows:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for spans in places.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 32
    assert len(places) <= best_fit_decreasing([r.length for r in rows], 32) * 1.02 + 1
    assert packing.pack_documents(docs.limit(0), capacity=32).count() == 0


@pytest.mark.parametrize("kind", ["mixed", "halves", "one"])
def test_rounds_come_close_to_best_fit_decreasing(spark, kind):
    rng = random.Random(7)
    draw = {"mixed": lambda: min(2048, int(rng.lognormvariate(5, 1.3)) + 1), "halves": lambda: rng.choice([1100, 1024, 700, 300]), "one": lambda: 1500}[kind]
    lengths = [draw() for _ in range(4000)]
    pieces = spark.createDataFrame([(i % 50, n, "x") for i, n in enumerate(lengths)], "doc_id long, length long, offset string").repartition(4)
    rows = packing.best_fit_pack(pieces, 2048, Workspace(spark, "pack")).collect()
    places = {}
    for r in rows:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert sorted(r.length for r in rows) == sorted(lengths)
    for spans in places.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 2048
    least, best = -(-sum(lengths) // 2048), best_fit_decreasing(lengths, 2048)
    print(kind, len(places), best, least)
    assert len(places) <= best * 1.01 + 1


def test_lengths_that_dont_fit(spark):
    for n in (0, 33, None):
        with pytest.raises(ValueError, match="capacity"):
            packing.best_fit_pack(spark.createDataFrame([(1, n)], "doc_id long, length long"), 32, Workspace(spark, "pack"))


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 9), st.booleans()), max_size=40))
def test_brackets_match_the_greatest_free_document(rows):
    rows.sort()
    doc = np.array([not gap for _, gap in rows], bool)
    stack, want = [], set()
    for i, is_doc in enumerate(doc):
        if is_doc:
            stack.append(i)
        elif stack:
            want.add((stack.pop(), i))
    d, g = packing.brackets(doc)
    assert set(zip(d.tolist(), g.tolist())) == want
    cuts = [0, len(rows) // 3, len(rows) // 2, len(rows)]  # over ranges the result is the same
    found, left = set(), []
    for lo, hi in zip(cuts, cuts[1:]):
        d, g = packing.brackets(doc[lo:hi])
        found |= set(zip((d + lo).tolist(), (g + lo).tolist()))
        used = {*(d + lo).tolist(), *(g + lo).tolist()}
        free = [i for i in range(lo, hi) if i not in used]
        left.append(([i for i in free if doc[i]], [i for i in free if not doc[i]]))
    ends = {}
    for p, is_doc, lo, hi, first, step in packing.across([len(x) for x, _ in left], [len(y) for _, y in left]):
        for i in range(lo, hi):
            ends.setdefault(first + step * (i - lo), {})[is_doc] = left[p][0 if is_doc else 1][i]
    assert found | {(x[True], x[False]) for x in ends.values()} == want


def test_records(spark, tmp_path):
    texts = [*ODD, None, "word " * 3000]
    ids = [None, *range(5, 5 + len(texts) - 1)]
    docs = documents(spark, texts, ids=ids)
    folder = qualified(spark, str(tmp_path / "rec"))
    path = default_path(R.TOKENIZER)
    shards = R.write_records(docs, folder, path)
    rows = {r.doc_id: r for r in R.digest_records(spark, folder, shards).collect()}
    coder, start = PieceEncoder(path), 0
    for i, t in zip(ids, texts, strict=True):
        raw = coder.encode([t or ""])[0] + (2).to_bytes(4, "little")
        assert (rows[i].start, rows[i].n_tokens, rows[i].ids_crc32) == (start, len(raw) // 4, zlib.crc32(raw))
        start += len(raw) // 4
    fs, root = R._open_fs(folder)
    name = max(shards, key=lambda s: s["docs"])["name"]
    in_order = list(R.read_documents(fs, root, name))
    shuffled = list(R.read_documents(fs, root, name, range(len(in_order) - 1, -1, -1)))
    assert [d for d, _ in shuffled] == [d for d, _ in in_order][::-1]
    assert json.loads((tmp_path / "rec/shards.json").read_text()) == shards
    file = tmp_path / f"rec/{name}.rec"
    data = bytearray(file.read_bytes())
    data[-6] ^= 1
    file.write_bytes(data)
    with pytest.raises(ValueError, match="damaged"):
        list(R.read_documents(fs, root, name))
    assert R.write_records(docs.limit(0), qualified(spark, str(tmp_path / "none")), path) == []
    assert R.digest_records(spark, folder, []).count() == 0


def slow_rule(url, rules):
    host = path = ""
    if url and "://" in url:
        rest = re.split(r"[?#]", url.split("://", 1)[1])[0]
        host, slash, path = rest.partition("/")
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
        path = slash + path
    best = None
    for action, rule in rules:
        h, _, p = rule.partition("/")
        if host and (host == h or host.endswith("." + h)) and path.startswith("/" + p):
            best = max(best or (), (len(rule), len(h), action, rule))
    return host, path, best and best[3], best[2] if best else "allow"


def test_urls(spark):
    rules = [*U.RULES, ("block", "a.org/fr/x"), ("allow", "b.a.org/fr")]
    hosts = ["Example.NET", "www.example.com", "net", "a.org", "b.a.org", "x.b.a.org", "notnet", "", "example.net:80"]
    paths = ["", "/", "/en/1", "/en", "/de/#t", "/fr/?q=/x", "/fr/xyz", "/FR/", "?a://b"]
    urls = [f"http://{h}{p}" for h in hosts for p in paths] + [None, "", "no scheme/x", "x://net/a", "http://net/a", "http://net/a", "http://" + "a." * 6000 + "org/fr/xy"]
    pages = spark.createDataFrame([(i if i % 9 else None, u, 0, 1, 2, 3, 4) for i, u in enumerate(urls)], "page_id long, url string, host int, rule_host int, best int, row int, `a.b` int")
    assert U.filter_urls(pages, U.listed(spark, rules)).columns == ["page_id", "url", "rule_host", "best", "row", "a.b", "host", "path", "rule", "verdict"]
    got = sorted(((r.url, r.host, r.path, r.rule, r.verdict) for r in U.filter_urls(pages, U.listed(spark, rules)).collect()), key=str)
    assert got == sorted(((u, *slow_rule(u, rules)) for u in urls), key=str)
    none = U.filter_urls(pages, U.listed(spark, rules).limit(0))
    assert {r.verdict for r in none.collect()} == {"allow"} and none.count() == len(urls)
    assert U.filter_urls(pages.limit(0), U.listed(spark, rules)).count() == 0


def test_image_formats():
    rng = np.random.default_rng(0)
    for shape in ((3, 5, 3), (1, 1, 3), (4, 7, 1)):
        image = rng.integers(0, 256, shape, dtype=np.uint8)
        assert (media.decode(media.encode_netpbm(image)) == image).all()
        assert (media.decode(media.encode_bmp(image)) == np.broadcast_to(image, (*shape[:2], 3))).all()
    assert (media.decode(b"P1\n# c\n3 1\n1 0 1")[0, :, 0] == [0, 255, 0]).all()
    assert (media.decode(b"P4\n3 1\n\xa0")[0, :, 0] == [0, 255, 0]).all()
    assert (media.decode(b"P2 2 1 15 0 15")[0, :, 0] == [0, 255]).all()
    assert media.decode(b"P3 1 1 255 1 2 3").ravel().tolist() == [1, 2, 3]
    for bad in (b"", b"P6\n9 9\n255\nxx", b"BMxx", b"P7 1 1"):
        with pytest.raises(ValueError):
            media.decode(bad)


def test_area_resize():
    image = np.random.default_rng(1).integers(0, 256, (7, 5, 3), dtype=np.uint8)
    big = image.repeat(8, 0).repeat(9, 1)
    want = big.reshape(8, 7, 9, 5, 3).mean((1, 3))
    assert np.allclose(media.resize_area(image, 8, 9), want)
    assert np.load(__import__("io").BytesIO(media.npy_tile(image))).shape == (16, 16, 3)


def test_difference_hash_equals_plain_means():
    rng = np.random.default_rng(3)
    for h, w in ((1, 64), (5, 64), (8, 9), (30, 64), (41, 7)):
        image = rng.integers(0, 256, (h, w, 3), dtype=np.uint8)
        luma = (image @ np.array([0.299, 0.587, 0.114])).repeat(8, 0).repeat(9, 1)  # 8 x 9 cells of h x w fine pixels each
        tile = np.round(luma.reshape(8, h, 9, w).mean((1, 3)) * 256)
        bits = "".join("1" if tile[y, x + 1] > tile[y, x] else "0" for y in range(8) for x in range(8))
        assert media.difference_hash(image) == f"{int(bits, 2):016x}"


def test_text_media(spark):
    texts = [*ODD, None, "same", "same", "ä" * 5000, "x" * 192, "x" * 193]
    docs = documents(spark, texts).withColumn("media", F.lit(1))
    for form in ("netpbm", "bmp"):
        rows = {r.doc_id: r for r in media.media_features(media.text_media(docs, form)).collect()}
        for i, t in enumerate(texts):
            raw = (t or "").encode()
            full = raw + b" " * ((-len(raw)) % 192 if raw else 192)
            r = rows[i]
            assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(full), hashlib.sha256(full).hexdigest(), zlib.crc32(full[-16:]))
        assert rows[0].feature == rows[texts.index(None)].feature and rows[texts.index("same")].feature == rows[texts.index("same") + 1].feature
    assert media.media_features(media.text_media(docs.limit(0))).count() == 0


def test_targets_and_flow():
    assert mixing.targets([100, 100, 100], [5, 2, 1], 1.5) == pytest.approx([200, 166.6667, 83.3333], abs=1e-3)
    assert mixing.targets([], [], 1.5) == [] and mixing.targets([0, 10], [5, 2]) == pytest.approx([0, 15])
    # the shared pattern serves the source that has nothing else
    flow = mixing.min_cost_flow([(frozenset({0}), 100), (frozenset({0, 1}), 100)], [100.0, 100.0])
    assert flow[0] == pytest.approx({0: 100}) and flow[1] == pytest.approx({1: 100})
    # repeats only when nothing fresh is left
    flow = mixing.min_cost_flow([(frozenset({0}), 50), (frozenset({0}), 50)], [120.0])
    assert sum(flow[0].values()) >= 50 and sum(flow[1].values()) >= 50 and sum(sum(f.values()) for f in flow) == pytest.approx(120)


def test_mixing(spark):
    rng = random.Random(5)
    texts = [" ".join("w" for _ in range(rng.randint(0, 12))) for _ in range(400)] + [None, ""]
    sources = [rng.choice(["b", "a", "c", "c", "c", None, "empty\u00e9"]) for _ in texts]
    texts = ["" if s == "empty\u00e9" else t for s, t in zip(sources, texts, strict=True)]
    docs = documents(spark, texts, sources)
    rows = mixing.mix(docs).orderBy("doc_id").collect()
    assert rows == mixing.mix(docs.repartition(3)).orderBy("doc_id").collect()
    names = sorted({s for s in sources}, key=lambda s: (s is None, (s or "").encode()))
    sizes = [sum(len(WORD.findall(t or "")) for t, s in zip(texts, sources, strict=True) if s == x) for x in names]
    goal = mixing.targets(sizes, [(5, 2, 1)[i % 3] for i in range(len(names))])
    for x, size, g in zip(names, sizes, goal, strict=True):
        own = [r for r, s in zip(rows, sources, strict=True) if s == x]
        assert {r.source_size for r in own} == {size} and {r.target for r in own} == {g}
        assert abs(sum(r.taken for r in own) - g) <= 12
    assert all(r.taken in (0, r.size, 2 * r.size) for r in rows) and len(rows) == len(texts)
    both = mixing.mix(docs, sources=F.when(F.col("doc_id") % 3 == 0, F.array(F.lit("a"), F.lit("b"))).otherwise(F.array("source")))
    assert both.count() == len(texts)
    assert mixing.mix(docs.limit(0)).count() == 0


def test_components(spark):
    pairs = [(i, i + 1) for i in range(30)] + [(50, 40), (60, 60), (None, 3)]
    work = Workspace(spark, "t")
    got = {r.id: r.root for r in connected(spark.createDataFrame(pairs, "a long, b long"), work).collect()}
    assert got == {i: 0 for i in range(31)} | {40: 40, 50: 40, 60: 60}


def slow_groups(texts, k, num, den):
    sets = []
    for t in texts:
        w = ["".join(c.lower() if "A" <= c <= "Z" else c for c in x) for x in WORD.findall(t or "")]
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set())
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(texts)), 2):
        if sets[i] and sets[j] and den * len(sets[i] & sets[j]) >= num * len(sets[i] | sets[j]):
            a, b = sorted((find(i), find(j)))
            root[b] = a
    return [len(s) for s in sets], [find(i) for i in range(len(texts))]


@pytest.mark.parametrize(("k", "num"), [(4, 85), (5, 80)])
def test_near_duplicates(spark, k, num):
    rng = random.Random(k)
    vocabulary = [f"w{i}" for i in range(400)]
    texts = [None, "", "  ", "One two", "one TWO", "one two three", "a " * 500]
    for _ in range(25):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([3, 8, 30, 90, 300]))]
        texts.append(" ".join(base))
        for _ in range(rng.randint(0, 6)):
            copy = list(base)
            for _ in range(rng.randint(0, max(1, len(copy) // 30))):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            texts.append(" ".join(copy[rng.randint(0, 2) :]))
            if rng.random() < 0.3:
                base = copy  # chains
    passage = " ".join(rng.choice(vocabulary) for _ in range(60))
    texts += [passage + " " + " ".join(rng.choice(vocabulary) for _ in range(rng.randint(5, 60))) for _ in range(30)]
    sizes, groups = slow_groups(texts, k, num, 100)
    rows = {r.doc_id: r for r in J.near_duplicates(documents(spark, texts).withColumn("n", F.lit(1)), k, num).collect()}
    assert [rows[i].n_shingles for i in range(len(texts))] == sizes
    assert [rows[i].component_id for i in range(len(texts))] == groups
    assert J.near_duplicates(documents(spark, []), k, num).count() == 0


def test_large_groups_are_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(J, "BLOCK_HASHES", 3000)  # eight members
    rng = random.Random(8)
    base = [f"x{i}" for i in range(120)]
    texts = []
    for i in range(60):
        copy = list(base)
        for at in rng.sample(range(120), rng.choice([1, 2, 5, 6])):
            copy[at] = f"y{i}-{at}"
        texts.append(" ".join(copy))
    sizes, groups = slow_groups(texts, 4, 85, 100)
    rows = {r.doc_id: r.component_id for r in J.near_duplicates(documents(spark, texts), 4, 85).collect()}
    assert [rows[i] for i in range(60)] == groups


def near_copies(rng, n, words, edits, mark):
    """n copies of one text, each with some words replaced: many pairs just link, many just don't."""
    base = [f"{mark}{rng.randrange(4 * words)}" for _ in range(words)]
    out = []
    for i in range(n):
        copy = list(base)
        for at in rng.sample(range(words), rng.choice(edits)):
            copy[at] = f"{mark}new{i}-{at}"
        out.append(" ".join(copy))
    return out


def test_spanning_links_join_all_that_link():
    rng = random.Random(4)
    for n, words, edits in ((2, 60, [1, 2]), (4, 60, [1, 2]), (60, 200, [1, 4, 8]), (200, 200, [6, 7, 8]), (12, 6000, [150, 190, 230])):
        texts = near_copies(rng, n, words, edits, "x")
        groups = slow_groups(texts, 4, 85, 100)[1]
        sets = [J.shingle_set(t.encode(), 4) for t in texts]
        for side in (np.zeros(n, int), np.arange(n) % 2):
            links = J.spanning(sets, np.arange(n), side, 85, 100)
            root = list(range(n))

            def find(i):
                return i if root[i] == i else find(root[i])

            for a, b in links:
                assert find(a) != find(b)  # never a link too many, so fewer than members
                root[max(find(a), find(b))] = min(find(a), find(b))
            if not side.any():
                assert [find(i) for i in range(n)] == groups
        assert J.spanning(sets, np.zeros(n, int), np.zeros(n, int), 85, 100) == []


def test_long_texts_and_near_misses(spark):
    rng = random.Random(12)
    texts = near_copies(rng, 40, 200, [1, 4, 6, 8], "a") + near_copies(rng, 8, 2000, [40, 60, 80], "b") + near_copies(rng, 6, 20000, [300, 600, 900], "c")
    texts += [t + " and more" for t in texts[:3]] + [texts[-1]] * 3
    groups = slow_groups(texts, 4, 85, 100)[1]
    assert 10 < len(set(groups)) < 50
    rows = {r.doc_id: r.component_id for r in J.near_duplicates(documents(spark, texts), 4, 85).collect()}
    assert [rows[i] for i in range(len(texts))] == groups


def test_block_keys_always_meet():
    rng = np.random.default_rng(2)
    for n in (6, 7, 12, 40, 200, 900):
        for _ in range(20):
            a = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
            drop = int(rng.integers(0, int(n * 0.15) + 1))
            b = a[drop:]
            for other in (b, np.unique(np.concatenate((b, rng.integers(0, 1 << 63, max(0, int(0.15 * n) - drop) // 2, dtype=np.uint64))))):
                common, union = len(np.intersect1d(a, other)), len(np.union1d(a, other))
                if 100 * common >= 85 * union and len(common * [0]) and not np.array_equal(a, other):
                    assert len(np.intersect1d(J.block_keys(a, 85, 100), J.block_keys(other, 85, 100)))


def test_risk_gradient_equals_differences():
    rng = np.random.default_rng(2)
    loss = lambda f: np.log1p(np.exp(-f))
    for shift in (2.0, -4.0):  # the second term is positive, then negative
        f_p, f_u, prior = rng.normal(size=7) + 2, rng.normal(size=11) + shift, 0.4
        plain = lambda p, u: (prior * loss(p).mean(), loss(-u).mean() - prior * loss(-p).mean())  # noqa: B023, E731
        first, second, g_p, g_u = X.risk_gradient(f_p, f_u, prior)
        assert np.allclose((first, second), plain(f_p, f_u)) and (second < 0) == (shift < 0)
        goal = (lambda p, u: sum(plain(p, u))) if second >= 0 else (lambda p, u: -plain(p, u)[1])  # noqa: B023, E731
        for g, f, at in ((g_p, f_p, 0), (g_u, f_u, 1)):
            for i in range(len(f)):
                step = np.zeros(len(f))
                step[i] = 1e-5
                up, down = [[f_p, f_u] for _ in range(2)]
                up[at], down[at] = f + step, f - step
                assert g[i] == pytest.approx((goal(*up) - goal(*down)) / 2e-5, abs=1e-6)


def test_toxicity(spark):
    rng = random.Random(4)
    plain, bad = [f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(300)], ["grumpf", "blarg", "snarkel"]
    texts, toxic = [], []
    for i in range(600):
        words = [rng.choice(plain) for _ in range(rng.randint(5, 60))]
        if i % 5 == 0:
            words.insert(rng.randrange(len(words)), rng.choice(bad))
        texts.append(" ".join(words))
        toxic.append(int(i % 5 == 0))
    docs = documents(spark, [*texts, None, "", "word " * 20000])
    labels = spark.createDataFrame([(i, t) for i, t in enumerate(toxic) if i % 2] + [(None, 1), (1, None)], "doc_id long, toxic int")
    model = X.train(docs, labels, X.fold(F.col("doc_id"), 3) != 1)
    rows = {r.doc_id: r.score for r in X.score_texts(docs, model).collect()}
    held = [i for i in range(600) if zlib.crc32(str(i).encode()) % 3 == 1]
    assert all(rows[i] < X.THRESHOLD for i in held if not toxic[i])
    assert sum(rows[i] >= X.THRESHOLD for i in held if toxic[i]) >= 0.85 * sum(toxic[i] for i in held)
    assert all(0 <= s <= 1 for s in rows.values()) and len(rows) == 603
    twice = documents(spark, [texts[5], texts[5], None], ids=[7, 7, None]).withColumn("score", F.lit("x"))
    again = X.score_texts(twice, model, "rate").collect()
    assert [r.score for r in again] == ["x"] * 3 and len({r.rate for r in again if r.doc_id}) == 1
    nothing = X.train(docs, labels.limit(0), F.lit(True))
    assert nothing.weight == {} and X.score_texts(docs.limit(0), nothing).count() == 0


def test_neighbours(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(900, 16)).astype(np.float32)
    x[300:420] = x[5]  # copies
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)]
    rows += [(2000, None, 0), (2020, [0.0] * 16, 0), (2040, [float("nan")] * 16, 0), (2060, [None] + [1.0] * 15, 0), (2080, [1.0], 0), (None, [1.0] * 16, 0), (2100, [float("inf")] * 16, 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score int")
    got = {}
    for r in neighbours.search(df, F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert set(got) == set(range(0, 900, 20))
    exact, hits = x.astype(np.float64) @ x.astype(np.float64).T, 0
    for q, found in got.items():
        s = exact[q].copy()
        s[q] = -np.inf
        best = np.lexsort((np.arange(900), -np.round(s, 9)))[:20]
        hits += len({v for v, _ in found} & set(best.tolist()))
        assert len(found) == 20 and all(math.isclose(score, exact[q, v], abs_tol=1e-9) for v, score in found)
        assert found == sorted(found, key=lambda t: (-t[1], t[0]))
    assert hits / (20 * len(got)) >= 0.95
    few = neighbours.search(df.where("vec_id < 3"), F.col("vec_id") == 0).collect()
    assert [r["rank"] for r in few] == [1, 2]
    assert neighbours.search(df.limit(0), F.lit(True)).count() == 0


def test_neighbours_of_near_copies_are_exact(spark, monkeypatch):
    """Several blocks, a third of the rows near copies of one vector that share their codes."""
    monkeypatch.setattr(neighbours, "ROW_BLOCK", 1000)
    rng = np.random.default_rng(8)
    x = rng.normal(size=(3600, 16))
    x[:1200] = x[0] + rng.normal(size=(1200, 16)) * 1e-4
    x[3000:3100] = x[2999]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {}
    for r in neighbours.search(df, F.col("vec_id") % 100 == 0).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    assert set(got) == set(range(0, 3600, 100))
    for q, found in got.items():
        s = np.zeros(len(x))
        for d in range(16):
            s += x[q, d] * x[:, d]
        s[q] = -np.inf
        assert found == np.lexsort((np.arange(len(x)), -s))[:20].tolist()


def test_anisotropic_codes_beat_plain_ones_on_products():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(2000, 16))
    top = lambda q: np.mean([abs((x[i] - q.centroids[np.arange(8), c].ravel()) @ x[i]) / (x[i] @ x[i]) for i, c in enumerate(q.codes(x))])
    assert top(neighbours.learn(x, 2, eta=8.0)) < top(neighbours.learn(x, 2, eta=1.0))


def coded(docs, depth=T.DEPTH):
    return T.windows([b"\0" * (depth - 1) + T.END] * len(docs), docs, [True] * len(docs), depth)[0]


def grown(docs, depth=T.DEPTH, **kw):
    code = coded(docs, depth)
    parts = [np.unique(code & T._mask(k + 1), return_counts=True) for k in range(depth + 1)]
    return T.build(np.repeat(np.arange(depth + 1), [len(u) for u, _ in parts]), *(np.concatenate(x) for x in zip(*parts, strict=True)), depth, **kw)


def slow_tree(docs, depth, gain, least, kappa=T.KAPPA):
    """P(byte | context) by dictionaries: count, test, close under suffixes, smooth, score."""
    seen = [{} for _ in range(depth + 1)]
    for words in docs:
        text = b"\0" * (depth - 1) + b"\n" + b"".join(w + b" " for w in words) + b"\n"
        for i in range(depth, len(text)):
            for k in range(depth + 1):
                after = seen[k].setdefault(text[i - k : i], {})
                after[text[i]] = after.get(text[i], 0) + 1
    total = sum(seen[0][b""].values())
    p = {b"": {c: (seen[0][b""].get(c, 0) + 0.5) / (total + 128) for c in range(256)}}
    kept = {b""}
    for k in range(1, depth + 1):
        for ctx, after in seen[k].items():
            n = sum(after.values())
            if n < least or ctx[1:] not in p:
                continue
            below = p[ctx[1:]]
            p[ctx] = {c: (m + kappa * below[c]) / (n + kappa) for c, m in after.items()}
            if sum(m * math.log(m / n / below[c]) for c, m in after.items()) > gain * len(after):
                kept |= {ctx[j:] for j in range(k)}

    def score(ctx, byte):
        ctx = next(ctx[j:] for j in range(len(ctx) + 1) if ctx[j:] in kept)
        out = 0.0
        while byte not in p[ctx]:
            n = sum(seen[len(ctx)][ctx].values())
            out += math.log10(kappa / (n + kappa))
            ctx = ctx[1:]
        return out + math.log10(p[ctx][byte])

    return kept, score


def test_suffix_tree_equals_brute_force():
    rng = random.Random(6)
    docs = [["".join(rng.choices("abc", k=rng.randint(1, 5))).encode() for _ in range(rng.randint(0, 12))] for _ in range(40)]
    for depth, gain, least in ((1, 0.1, 1), (3, 0.5, 2), (6, 2.0, 4), (6, 0.2, 3)):
        kept, score = slow_tree(docs, depth, gain, least)
        tree = grown(docs, depth, gain=gain, least=least)
        assert {int.from_bytes(c, "big") | len(c) << 56 for c in kept if c} == set(tree.states.tolist())
        ctx = ["".join(rng.choices("abcd \n\0", k=depth)).encode() for _ in range(300)]
        byte = [ord(rng.choice("abcd \n")) for _ in ctx]
        found = tree.score(np.array([int.from_bytes(x, "big") << 8 | c for x, c in zip(ctx, byte)], np.uint64))
        assert np.allclose(found[0], [score(x, c) for x, c in zip(ctx, byte)]) and (found[1] == -1).all()


def test_suffix_tree_is_a_distribution():
    docs = [T.words_of(t.encode()) for t in ["the cat sat", "the cat ran", "a cat", "the dog sat on the cat"] * 5]
    tree = grown(docs, 3, gain=0.5, least=2)
    assert len(tree.states)
    for before in (b"\0\0\n", b"the", b"ca", b"xyz", b" ca", b"at "):
        ctx = int.from_bytes(before[-3:].rjust(3, b"\0"), "big")
        total = (10.0 ** tree.score(np.array([ctx << 8 | b for b in range(256)], np.uint64))[0]).sum()
        assert total == pytest.approx(1)
    assert coded([[]], 3).size == 1


def test_texts_in_chunks(monkeypatch):
    texts = [b"One  two\tthree", b"", None, b"x" * 500, b" a b" * 200, b"end "]
    whole = coded([T.words_of(t) for t in texts])
    for size in (1, 7, 64, 1000):
        monkeypatch.setattr(T, "CHUNK", size)
        found = [T.windows(before, words, last) for _, before, words, last in T.chunks(texts)]
        docs = [d for doc, *_ in T.chunks(texts) for d in doc]
        assert np.concatenate([c for c, _ in found]).tolist() == whole.tolist() and sorted(set(docs)) == list(range(len(texts)))


@pytest.mark.parametrize("most", [0, 900])
def test_states_that_are_not_broadcast_are_joined(spark, monkeypatch, most):
    rng = random.Random(5)
    texts = [" ".join("".join(rng.choices("abcd", k=rng.randint(1, 6))) for _ in range(40)) for _ in range(60)] + [None, "", "zzz unseen"]
    docs = documents(spark, texts + texts[:2])
    fold = F.crc32(F.col("doc_id").cast("string")) % 5
    want = sorted((r.doc_id, r.score) for r in T.score_documents(docs, fold != 1).collect())
    monkeypatch.setattr(T, "MAX_ENTRIES", most)
    found = sorted((r.doc_id, r.score) for r in T.score_documents(docs, fold != 1).collect())
    assert [i for i, _ in found] == [i for i, _ in want] and np.allclose([x for _, x in found], [x for _, x in want])


def test_suffix_tree_scores(spark):
    rng = random.Random(9)
    word = lambda: "".join(rng.choices(["ba", "ke", "lo", "mi", "su", "ta"], k=rng.randint(1, 5)))
    texts = [" ".join(word() for _ in range(rng.randint(1, 40))) for _ in range(300)] + [None, "", "Unseen WORDS zzz"]
    docs = documents(spark, texts).withColumn("score", F.lit(0))
    fold = F.crc32(F.col("doc_id").cast("string")) % 5
    rows = {r.doc_id: r for r in T.score_documents(docs, fold != 1, hot=20).collect()}
    train = [i for i in range(len(texts)) if zlib.crc32(str(i).encode()) % 5 != 1]
    lower = lambda t: WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    count = {}
    for i in train:
        for w in [*lower(texts[i]), None]:
            count[w] = count.get(w, 0) + 1
    n, v = sum(count.values()), len(count)
    for i, t in enumerate(texts):
        tokens = [*lower(t), None]
        want = sum(math.log10((count.get(w, 0) + 0.5) / (n + 0.5 * (v + 1))) for w in tokens)
        r = rows[i]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(tokens), sum(w in count for w in tokens), n)
        assert r.base_score == pytest.approx(want)
    again = {r.doc_id: r.score for r in T.score_documents(docs, fold != 1, hot=10_000).collect()}
    assert all(again[i] == pytest.approx(rows[i].score) for i in rows)
    assert T.score_documents(docs.limit(0), fold != 1).count() == 0


def test_suffix_tree_uses_contexts(spark):
    """Held-out texts whose words follow each other are likelier than by their words' counts alone."""
    rng = random.Random(1)
    names = ["".join(rng.choices("abcdefghij", k=4)) for _ in range(60)]
    after = {n: rng.sample(names, 2) for n in names}
    texts = []
    for _ in range(300):
        w = [rng.choice(names)]
        while len(w) < 30:
            w.append(rng.choice(after[w[-1]]))
        texts.append(" ".join(w))
    fold = F.crc32(F.col("doc_id").cast("string")) % 5
    total = T.score_documents(documents(spark, texts), fold != 1).where(fold == 1).agg(F.sum("score").alias("s"), F.sum("base_score").alias("b")).first()
    assert total.s > 0.6 * total.b


def counted(spark, texts, name):
    work = Workspace(spark, name)
    codes = T.count(documents(spark, texts).select(F.encode("text", "UTF-8").alias("data"), F.lit(True).alias("training")), work)[1]
    root, entries = T.levels(codes, work)
    return T.frequent(entries, root)[0]


def test_suffix_tree_grows_with_the_corpus(spark):
    """A context that a part of the corpus keeps isn't dropped because the rest doesn't have it."""
    rng = random.Random(4)
    rest = [" ".join(rng.choice(["lorem", "ipsum", "dolor"]) for _ in range(4000)) for _ in range(300)]
    part = ["qzxj" * 2] * 3
    small, large = (set(counted(spark, x, "grow").states.tolist()) for x in (part, part + rest))
    new = ord("z") | 1 << 56
    assert new in small and new in large


def test_suffix_tree_levels_are_those_of_build(spark):
    rng = random.Random(5)
    texts = [" ".join("".join(rng.choices("abcd", k=rng.randint(1, 6))) for _ in range(40)) for _ in range(60)]
    tree = counted(spark, texts, "levels")
    whole = grown([T.words_of(t.encode()) for t in texts])
    assert tree.states.tolist() == whole.states.tolist() and sorted(tree.entries.tolist()) == sorted(whole.entries.tolist())
    code = np.random.default_rng(1).integers(0, 1 << 56, 1000, dtype=np.uint64)
    code = np.concatenate((coded([T.words_of(t.encode()) for t in texts]), code))
    assert np.allclose(tree.score(code)[0], whole.score(code)[0]) and np.allclose(tree.escape, whole.escape)


def test_suffix_tree_keeps_contexts_of_six_bytes():
    """The last byte of a word is told by its first only, six bytes before."""
    tree = grown([[b"1bcdef1", b"2bcdef2"]] * 40)
    right = int.from_bytes(b"1bcdef1", "big") & int(T._mask(T.DEPTH + 1))
    assert tree.score(np.array([right], np.uint64))[0][0] > -0.1


def test_quotations(spark):
    rows = [
        ("c", 0, "user", "Hello there.\nHow are you?"),
        ("c", 1, "assistant", "On Monday X wrote:\n> Hello there.\n> How  are you?\nFine."),
        ("c", 2, "user", "> > how are you?\n> fine.\nGood to know."),
        ("c", 3, "user", "> Hello there.\n> How are you?\nMe too."),
        ("c", 4, "user", "Something new"),
        ("c", 5, "user", "> nobody said this\nok"),
        ("d", 1, "user", "> Hello there.\nother talk"),
        ("c", None, "user", "> Hello there."), (None, 3, None, None), ("c", 4, "user", "Something new"),
    ]
    out = quotations.link_quotations(spark.createDataFrame(rows, "conv_id string, turn long, role string, text string")).collect()
    assert len(out) == len(rows)
    by = {(r.conv_id, r.turn): r for r in out}
    assert by["c", 1].reply_to == 0 and by["c", 1].body == "Fine." and by["c", 1].n_linked == 1
    assert by["c", 2].reply_to == 1 and by["c", 2].body == "Good to know." and by["c", 2].depth == 2 and by["c", 2].thread_turn == 0
    assert by["c", 3].reply_to == 0 and by["c", 4].reply_to is None and by["c", 5].reply_to is None and by["c", 5].body == "ok"
    assert by["d", 1].reply_to is None and by[None, 3].body == ""
    assert [r.turn for r in out if r.conv_id == "c" and r.turn is not None] == [0, 1, 2, 3, 4, 4, 5]
    assert quotations.link_quotations(spark.createDataFrame([], "conv_id string, turn long, role string, text string")).count() == 0


def test_long_quote_chain(spark):
    rows = [("c", i, "user", (f"> body {i - 1}\n" if i else "") + f"body {i}") for i in range(20)] + [("c", 30, "user", "> body 3\nlate")]
    out = {r.turn: r for r in quotations.link_quotations(spark.createDataFrame(rows, "conv_id string, turn long, role string, text string")).collect()}
    assert all(out[i].depth == i and out[i].thread_turn == 0 for i in range(20)) and out[30].reply_to == 3 and out[30].depth == 4


def test_quotes_over_many_steps(spark, monkeypatch):
    monkeypatch.setattr(quotations, "TURNS", 4)
    rows = [("c", 0, "u", "same"), ("c", 9, "u", "same"), ("c", 11, "u", "> same\na"), ("c", 21, "u", "> same\nb"), ("c", 5, "u", "> same\nc")]
    out = {r.turn: r.reply_to for r in quotations.link_quotations(spark.createDataFrame(rows, "conv_id string, turn long, role string, text string")).collect()}
    assert out == {0: None, 9: None, 11: 9, 21: 9, 5: 0}


def test_turns_of_64_bits_keep_their_order(spark):
    turns = [-(1 << 63), -5, -1, 0, 3, 10**12 + 1, 10**12 + 2, 10**13 + 3, 10**13 + 11, (1 << 63) - 1]
    rows = [("c", t, "u", "> body 0\nbody" if t > 0 else f"body {t}") for t in random.Random(1).sample(turns, len(turns))]
    out = quotations.link_quotations(spark.createDataFrame(rows, "conv_id string, turn long, role string, text string")).collect()
    assert [r.turn for r in out] == turns and {r.reply_to for r in out if r.turn > 0} == {0}


def test_quotations_equal_sql(spark):
    import duckdb
    import pandas as pd

    rng, rows = random.Random(12), []
    for conv in range(8):
        said = []
        for turn in range(12):
            lines = [rng.choice(["yes", "no  more", f"line {conv} {turn} {i}", "On Day X wrote:", "", "> odd"]) for i in range(rng.randint(0, 4))]
            if said and rng.random() < 0.7:
                quote = [f"{'> ' * rng.randint(1, 2)}{x}" for x in rng.choice(said)]
                lines = [*quote, *lines] if rng.random() < 0.5 else [*lines, *quote, "end"]
            said.append([x for x in lines if not x.startswith(">")] or ["empty"])
            rows.append((conv, turn, "user", "\n".join(lines)))
    rows += [(1, 5, "user", None), (2, 3, None, "> line 2 1 0"), (3, 10**13, "user", "> yes\n> >  no more\nlate"), (3, -7, "user", "yes")]
    conversations = pd.DataFrame(rows, columns=["conv_id", "turn", "role", "text"])  # noqa: F841
    got = quotations.link_quotations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    con = duckdb.connect()
    con.register("conversations", conversations)
    rel = con.sql(quotations.OP2_SQL)
    columns = sorted(got.columns)
    want = [tuple(r[list(rel.columns).index(c)] for c in columns) for r in rel.fetchall()]
    assert sorted(map(str, want)) == sorted(str(tuple(r[c] for c in columns)) for r in got.collect())
    assert sum(r.n_linked for r in got.collect()) > 10
