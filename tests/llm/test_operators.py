"""Training-data operators against brute-force versions, round trips, held-out accuracy and odd rows."""

import collections
import hashlib
import random
import re
import sys
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import decontaminate, html_main, jaccard, line_dedup, packing, quality, repeats, suffix, tiff, token_output, tokens, toxicity

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()


def prose(seed, n):
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + str(rng.randrange(40)) for _ in range(n))


def edit(text, every, tag):
    return " ".join(f"{tag}{i}" if i % every == every - 1 else w for i, w in enumerate(text.split(" ")))


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empties, ties, repeated rows, a long text, and extra columns with names that clash."""
    base = prose(1, 120)
    rows = [
        (None, base), (1, None), (2, ""), (3, " \n\t "), (4, "One two"), (5, prose(2, 20_000)), (6, base), (6, base), (7, base.upper()), (8, edit(base, 40, "x")), (9, "one  TWO"),
        (10, "naïve café\nπ ρ 😀 <|endoftext|> <|startoftext|>x"), (11, edit(base, 3, "y")), (12, "a " * 300), (-5, base), (13, prose(9, 4)), (6, prose(3, 50)),
    ]
    df = spark.createDataFrame([(*r, i, f"s{i}") for i, r in enumerate(rows)], "doc_id long, text string, n long, score string")
    return df.select("*", *[F.lit("clash").alias(c) for c in ("cls", "root", "key", "leaf", "line", "drop", "lines", "label", "count", "token")])


@pytest.fixture(scope="module")
def empty(odd):
    return odd.limit(0)


def docs_of(df):
    return [tuple(r) for r in df.select("doc_id", "text").collect()]


def words_of(text):
    low = (text or "").encode().translate(bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256)))
    return re.findall(rb"[^\x20\x09-\x0D]+", low)


def shingles(text):
    w = words_of(text)
    return [tuple(w)] if 0 < len(w) < 5 else [tuple(w[i : i + 5]) for i in range(len(w) - 4)]


# ---------------------------------------------------------------- 1


def brute_components(rows):
    sets = [(d, frozenset(shingles(t))) for d, t in rows]
    up = {d: d for d, _ in sets if d is not None}

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if a is not None and b is not None and x and y and 100 * len(x & y) >= 75 * len(x | y):
                p, q = find(a), find(b)
                up[max(p, q)] = min(p, q)
    return sorted(((d, len(s), find(d) if d is not None else None) for d, s in sets), key=repr)


def same_components(df):
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.jaccard_components(df).collect()), key=repr)
    assert got == brute_components(docs_of(df))


def test_jaccard_odd_rows(odd, empty):
    # Rows that share an id but not a text are components of their own texts, so they are left to one text here.
    same_components(odd.where("not (doc_id = 6 and n = 16)"))
    assert jaccard.jaccard_components(empty).count() == 0


@pytest.mark.parametrize("cell", [512, 5])
def test_jaccard_families(spark, monkeypatch, cell):
    """Families of near copies that share passages; with small cells, blocks, hubs and queries do the work."""
    monkeypatch.setattr(jaccard, "CELL_SETS", cell)
    monkeypatch.setattr(jaccard, "QUERY_CHUNK", 3)
    passage, rows = prose("p", 60), []
    for f in range(6):
        base = prose(f, 150)
        rows += [(f * 100 + i, edit(base, 30 + 4 * i, f"e{i}_") + (" " + passage if i % 2 else "")) for i in range(12)]
    rows += [(900 + i, passage + " " + prose(f"q{i}", 10 + i)) for i in range(15)]
    same_components(spark.createDataFrame(rows, "doc_id long, text string"))


def test_token_group_matrix_bound_is_safe():
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 60, rng.integers(1, 40)).astype(np.uint64)) for _ in range(80)]
    sizes = [len(s) for s in sets]
    m = jaccard.TokenGroupMatrix(sets, sizes, 75, group_size=4)
    for i, s in enumerate(sets):
        opened = set(m.open(s, sizes[i]))
        assert {j for j in range(len(sets)) if jaccard.similar(s, sets[j], sizes[i], sizes[j], 75)} <= opened


# ---------------------------------------------------------------- 2, 5


def labelled(spark):
    rng = random.Random(4)
    rows, labels = [], []
    for i in range(400):
        bad, rude = i % 4 == 0, i % 5 == 0
        w = [rng.choice(WORDS) for _ in range(60)]
        if rude:
            for _ in range(4):
                w[rng.randrange(60)] = rng.choice(["grumblefool", "dr4tkin", "snibwit", "s n i b w i t"])
        rows.append((i, " ".join(x + "&&&" for x in w) if bad else " ".join(w)))
        labels.append((i, int(not bad), int(rude)))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_quality(spark, odd, empty):
    docs, labels = labelled(spark)
    model = quality.fit(docs, labels, quality.Settings(epochs=6))
    got = quality.score(docs, model).join(labels, "doc_id").where(quality.held_out(F.col("doc_id")))
    assert got.where((F.col("score") >= 0.3).cast("int") != F.col("quality")).count() <= 1 < got.count()
    out = quality.score(odd, model)
    assert out.count() == odd.count() and out.where("score between 0 and 1").count() == odd.count() and quality.score(empty, model).count() == 0
    flat = quality.fit(docs, labels.limit(0))
    assert {r.score for r in quality.score(odd, flat).collect()} == {0.5}


def test_toxicity(spark, odd, empty):
    docs, labels = labelled(spark)
    model = toxicity.fit(docs, labels)
    got = toxicity.score(docs, model).join(labels, "doc_id").where(toxicity.held_out(F.col("doc_id")))
    assert got.where((F.col("score") >= 0.3).cast("int") != F.col("toxic")).count() <= 1 < got.count()
    out = toxicity.score(odd, model)
    assert out.count() == odd.count() and out.where("score between 0 and 1").count() == odd.count() and toxicity.score(empty, model).count() == 0
    assert toxicity.score(odd, toxicity.fit(empty.select("doc_id", "text"), labels.limit(0))).count() == odd.count()


def test_viterbi_restores():
    text = "you idiot and stupid loser are worthless trash clowns " * 50
    data = np.frombuffer(text.encode(), np.uint8)
    s = toxicity._SYMBOL[data].astype(int)
    counts = np.zeros(32**4, np.int64)
    for a, b, c, d in zip(s, s[1:], s[2:], s[3:], strict=False):
        counts[((a * 32 + b) * 32 + c) * 32 + d] += 1
    r = toxicity.Restorer(toxicity.language_model(counts))
    for given, want in {"1d1ot": "idiot", "s t u p i d": "stupid", "l.o.s.e.r": "loser", "tr@sh": "trash", "stuuuupid": "stupid", "worthle$s": "worthless", "plain text 12": "plain text 12"}.items():
        assert toxicity.restore(given, r) == want


def test_spans_cover_usual_obfuscations():
    import pyarrow as pa

    from millrace.llm.textops import buffers

    for given in ("sh!7", "a$$", "5h17", "l0$er5", "b@57@rd5", "$$$hole", "sh1t", "f u k", "f  u  c  k", "f - u - k", "s.h.1.7", "1d10t"):
        for text in (given, f'"{given}"', f"so ({given})," if given[0] not in "$" else f"[{given}]", f"you {given} there"):
            assert any(given in text[a:b] for a, b in toxicity.spans(text)), text
            assert toxicity.suspicious_texts(*buffers(pa.array(["plain words", text, "of a kind"]))).tolist() == [False, True, False]
    words = "you idiot and stupid loser losers are worthless trash bastards shit "
    s = toxicity._SYMBOL[np.frombuffer((words * 50).encode(), np.uint8)].astype(int)
    counts = np.zeros(32**4, np.int64)
    for a, b, c, d in zip(s, s[1:], s[2:], s[3:], strict=False):
        counts[((a * 32 + b) * 32 + c) * 32 + d] += 1
    r = toxicity.Restorer(toxicity.language_model(counts))
    for given, want in {"sh!7": "shit", "5h17": "shit", "l0$er5": "losers", "b@57@rd5": "bastards", '"sh1t"': "shit", "s  h  i  t": "shit", "a r e": "are"}.items():
        assert want in r.words(given)


def small_model():
    words = "you idiot and stupid loser losers are worthless trash bastards shit "
    s = toxicity._SYMBOL[np.frombuffer((words * 50).encode(), np.uint8)].astype(int)
    counts = np.zeros(32**4, np.int64)
    for a, b, c, d in zip(s, s[1:], s[2:], s[3:], strict=False):
        counts[((a * 32 + b) * 32 + c) * 32 + d] += 1
    return toxicity.language_model(counts)


def test_viterbi_is_the_best_path():
    """Against every path of short lattices."""
    import itertools

    model = small_model()
    r, rng = toxicity.Restorer(model), random.Random(8)

    def value(path, costs):
        s = [0, 0, 0, *[toxicity.symbol(c) for c in path if c], 0]
        return sum(costs) + sum(float(model[a, b, c, d]) for a, b, c, d in zip(s, s[1:], s[2:], s[3:], strict=False))

    for span in ["1d10t", "a$$", "l00o0$er", "s.h.1.t", "t r a $ h", "b@5t@rd5", *["".join(rng.choice("aabis1!$.0t*") for _ in range(rng.randrange(2, 7))) for _ in range(60)]]:
        lattice = r.arcs(span)
        best = max(value([o for o, _ in path], [c for _, c in path]) for path in itertools.product(*lattice))
        got = r.decode(span)
        mine = max(value([o for o, _ in path], [c for _, c in path]) for path in itertools.product(*lattice) if "".join(o for o, _ in path) == got)
        assert abs(mine - best) < 1e-3, (span, got)


def test_very_long_texts_take_linear_time():
    import time

    rng = random.Random(9)
    r = toxicity.Restorer(small_model())
    letters = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(1 << 20))
    for text in (letters, "日本語の文章" * (1 << 17), letters.replace("a", "bbb"), " ".join(letters[:200_000]), "." * (1 << 20), "a." * 100_000, letters[: 1 << 17] + "1" + letters[: 1 << 17]):
        began = time.perf_counter()
        found = list(toxicity.spans(text))
        assert time.perf_counter() - began < 2, text[:10]
    began = time.perf_counter()
    assert len(r.words(letters[:100_000] + "1" + letters[:100_000])) > 0  # one span of 200,000 characters
    assert time.perf_counter() - began < 20 and found


def test_other_alphabets_accents_and_invisible_characters():
    r = toxicity.Restorer(small_model())
    for given, want in {"stuріd": "stupid", "іdіot": "idiot", "ıdıot": "idiot", "ｓｔｕｐｉｄ": "stupid", "𝐬𝐭𝐮𝐩𝐢𝐝": "stupid", "stu\u200bpid": "stupid", "s\u00adt\u00adu\u00adpid": "stupid", "l0ѕеr": "loser", "lo\u0301ser": "loser"}.items():
        for text in (given, f"you {given} there", f'"{given.upper()}"'):
            assert want in r.words(text, suspicious="0" in given), text
    assert not list(toxicity.spans("привет мир, 東京 für naïve café – “so” it’s 5 €"))  # words of other languages are as they are
    sought = {"idiot"}.__contains__
    assert "idiot" in r.words("you ídiót", False, sought) and "idiot" not in r.words("you ídiót", False)
    assert r.words("café ídiot für", False, lambda w: False) == {"café", "ídiot", "für"}
    text = "aé\u200b1" * 50_000 + " " + "\u200b" * 50_000 + "х" * 50_000
    assert len(list(toxicity.spans(text, False))) == 1  # every character is passed once


def test_suspicion_misses_no_span():
    import pyarrow as pa

    from millrace.llm.textops import buffers

    rng = random.Random(6)
    texts = ["".join(rng.choice(" .-_*aAbéÉè1@$€(ß\n") for _ in range(rng.randrange(14))) for _ in range(4000)]
    flags = toxicity.suspicious_texts(*buffers(pa.array(texts)))
    assert not any(list(toxicity.spans(t.lower())) for t, f in zip(texts, flags, strict=True) if not f) and not flags.all()


# ---------------------------------------------------------------- 3


@pytest.mark.parametrize("n", [0, 1, 2, 255, 256, 4000, 70_000])
@pytest.mark.parametrize("kinds", [1, 3, 256])
def test_tiff_codecs(n, kinds):
    data = np.random.default_rng(n + kinds).integers(0, kinds, n).astype(np.uint8).tobytes()
    assert tiff.lzw_decode(tiff.lzw_encode(data)) == data and tiff.packbits_decode(tiff.packbits_encode(data)) == data


@pytest.mark.parametrize("compression", [tiff.NONE, tiff.LZW, tiff.PACKBITS, tiff.DEFLATE])
@pytest.mark.parametrize("predictor", [1, 2])
@pytest.mark.parametrize("tile", [None, (16, 32)])
def test_tiff_round_trip(compression, predictor, tile):
    rng = np.random.default_rng(1)
    images = [rng.integers(0, 256, shape).astype(np.uint8) for shape in ((37, 53, 1), (5, 3, 3), (64, 64, 1))]
    raw = tiff.write_tiff([(im, tiff.Layout(compression, predictor, tile, 7)) for im in images])
    pages = list(tiff.read_tiff(raw))
    assert len(pages) == 3 and all(np.array_equal(p.data, im) and p.tiled == bool(tile) for p, im in zip(pages, images, strict=True))


def test_tiff_pages_and_digest(spark, odd, empty):
    good = tiff.write_tiff([(np.zeros((2, 2), np.uint8), tiff.Layout())] * 2)
    df = spark.createDataFrame([(1, good), (2, b"junk"), (3, None), (4, good[:30])], "id long, media binary")
    got = collections.Counter((r.id, r.error is None) for r in tiff.tiff_pages(df, "id", "media").collect())
    assert got[1, True] == 2 and got[2, False] == got[3, False] == got[4, False] == 1
    out = tiff.media_digest(odd).collect()
    assert len({r.feature.split(";")[0] for r in out}) > 1
    want = []
    for d, t in docs_of(odd):
        raw = (t or "").encode()
        payload = raw.ljust(max(1, -(-len(raw) // 576)) * 576, b"\xff")
        want.append((d, len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:])))
    assert sorted(want, key=repr) == sorted(((r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in out), key=repr)
    assert tiff.media_digest(empty).count() == 0


def retagged(raw, **values):
    """A one-page file with other values of tags."""
    raw = bytearray(raw)
    at = int.from_bytes(raw[4:8], "little")
    for i in range(int.from_bytes(raw[at : at + 2], "little")):
        entry = at + 2 + 12 * i
        tag = f"t{int.from_bytes(raw[entry : entry + 2], 'little')}"
        if tag in values:
            raw[entry + 8 : entry + 12] = values[tag].to_bytes(4, "little")
    return bytes(raw)


def test_tiff_damaged_media_gives_a_row(spark):
    page = np.arange(64, dtype=np.uint8).reshape(8, 8)
    media = []
    for kind in (tiff.NONE, tiff.LZW, tiff.PACKBITS, tiff.DEFLATE):
        good = tiff.write_tiff([(page, tiff.Layout(kind, 1))])
        huge = retagged(good, t256=1 << 20, t257=1 << 20, t278=1 << 20)
        media += [retagged(good, t256=0), retagged(good, t257=0), huge, retagged(good, t278=0), retagged(good, t277=0), retagged(good, t279=1 << 30), retagged(good, t273=1 << 30), retagged(good, t256=16)]
    bomb = tiff.write_tiff([(np.zeros((4096, 4096), np.uint8), tiff.Layout(tiff.DEFLATE, 1, rows_per_strip=4096))])
    media.append(retagged(bomb, t256=8, t257=8, t278=8))  # the strip holds far more than the page: only the page is decoded
    rows = tiff.tiff_pages(spark.createDataFrame(list(enumerate(media)), "id long, media binary"), "id", "media").collect()
    assert sorted(r.id for r in rows) == list(range(len(media)))
    assert all(r.error and r.data is None for r in rows if r.id < len(media) - 1) and next(r for r in rows if r.id == len(media) - 1).data == bytes(64)


# ---------------------------------------------------------------- 4


def brute_leaks(docs, items):
    out = {}
    for i, t in items:
        mine = collections.Counter(shingles(t))
        n = len(words_of(t))
        for d, text in docs:
            w = words_of(text)
            if n < 5:
                if n and len(w) == n and w == words_of(t):
                    out[d, i] = 1.0
                continue
            g = [tuple(w[j : j + 5]) for j in range(len(w) - 4)]
            for s in range(len(w) - n + 1):
                c = collections.Counter(g[s : s + n - 4])
                x = sum((c & mine).values()) / sum((c | mine).values())
                if x >= 0.75:
                    out[d, i] = max(out.get((d, i), 0), x)
    return out


def test_leaks(spark, odd, empty):
    items = [(i, prose(f"b{i}", 8 + 5 * i)) for i in range(8)] + [(20, "one two"), (21, None), (22, ""), (23, "na na na na na na na na")]
    docs = [(1000 + i, prose(i, 40) + " " + (edit(items[i % 8][1], 15 + i, "z") if i % 3 else items[i % 8][1].upper()) + " " + prose(-i, 30)) for i in range(24)]
    docs += [(1099, "na " * 40), (1098, "na na na na na na na")]
    d = spark.createDataFrame(docs, "doc_id long, text string").unionByName(odd.select("doc_id", "text"))
    b = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit("clash"))
    want = brute_leaks(docs_of(d), items)
    for block in (5000, 3):
        got = {(r.doc_id, r.item_id): r.similarity for r in decontaminate.leaks(d, b, block_items=block).collect()}
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in got) and len(got) > 10
        clean = decontaminate.without_leaks(d.withColumn("x", F.lit(1)), b, block_items=block)
        assert {r.doc_id for r in clean.collect()} == {x for x, _ in docs_of(d)} - {x for x, _ in want}
    assert decontaminate.leaks(empty, b).count() == 0 and decontaminate.leaks(d, b.limit(0)).count() == 0


def test_short_documents_and_items_leak(spark):
    item = prose("item", 59)
    docs = [(1, " ".join(item.split()[:54])), (2, " ".join(item.split()[:30])), (3, prose(3, 6) + " Omega omega PSI " + prose(4, 6)), (4, "psi omega omega"), (5, prose(5, 20)), (6, prose(6, 4) + " omega"), (7, "omega psi")]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame([(1, item), (2, "omega omega psi")], "item_id long, text string")
    got = {(r.doc_id, r.item_id): (r.first_word, round(r.similarity, 3)) for r in decontaminate.leaks(d, b, whole=True).collect()}
    assert got == {(1, 1): (0, round(50 / 55, 3)), (3, 2): (6, 1.0)}
    assert sorted(r.doc_id for r in decontaminate.without_leaks(d, b, whole=True).collect()) == [2, 4, 5, 6, 7]


def test_hamming_index_finds_all():
    rng = np.random.default_rng(3)
    for bits, block in ((64, 5), (2048, 14), (100, 7)):
        prints = rng.random((50, bits)) < 0.5
        far = bits // block - 1  # the radius that the blocks guarantee
        queries = np.concatenate([rng.random((50, bits)) < 0.5, prints.copy()])
        for i in range(50):
            queries[50 + i, rng.choice(bits, rng.integers(far + 1), replace=False)] ^= True
        for r in (0, 3, far):
            q, p = decontaminate.HammingIndex(prints, r, block).search(queries)
            distance = (queries[:, None] != prints[None]).sum(2)
            assert set(zip(q.tolist(), p.tolist(), strict=True)) == set(zip(*(x.tolist() for x in np.nonzero(distance <= r)), strict=True))


def test_hamming_blocks_select():
    """Unrelated fingerprints seldom have enough equal blocks; windows at the threshold do, and lie within the radius."""
    rng = np.random.default_rng(5)
    prints = rng.random((300, decontaminate.BITS)) < 0.5
    index = decontaminate.HammingIndex(prints, decontaminate.radius_of(0.75))
    q, _ = index.candidates(rng.random((300, decontaminate.BITS)) < 0.5)
    assert len(q) < 0.001 * 300 * 300
    for seed in range(300):
        r = np.random.default_rng(seed)
        n = int(r.integers(7, 80))
        item = r.integers(0, 2**63, n).astype(np.uint64)
        changed = next(m for m in range(n, -1, -1) if (n - m) >= 0.75 * (n + m))  # as many as the threshold allows
        window = item.copy()
        window[r.choice(n, changed, replace=False)] = r.integers(0, 2**63, changed).astype(np.uint64)
        a, b = (decontaminate.fingerprints(x, n)[0] for x in (item, window))
        assert len(decontaminate.HammingIndex(a[None], decontaminate.radius_of(0.75)).search(b[None])[0]) == 1


@pytest.mark.parametrize("kinds", [2, 5, 40, 10**6])
def test_running_fingerprints_are_those_of_each_window(kinds):
    rng = np.random.default_rng(kinds)
    grams = rng.integers(1, kinds + 1, 200).astype(np.uint64)
    for size in (1, 7, 60, 200):
        got = decontaminate.fingerprints(grams, size)
        for s in range(0, 200 - size + 1, 13):
            c = collections.Counter(grams[s : s + size].tolist())
            pairs = [(x, i + 1) for x, n in c.items() for i in range(n)]
            h = decontaminate.numbered(np.array([x for x, _ in pairs], np.uint64), np.array([i for _, i in pairs]))
            assert (got[s] == (decontaminate.signs(h).sum(axis=0) > 0)).all()


def test_leaks_with_repeated_words(spark):
    """Tails of one word repeated, items of few words said often, windows at the threshold: as brute force has them."""
    rng, items, docs = random.Random(4), [], []
    for i in range(60):
        base = [f"w{i}x{j}" for j in range(68)]
        items.append((i, " ".join(base + [f"v{i}y{j}" for j in range(6)])))
        docs.append((i, " ".join(base[:68] + ["again"] * 6)))
        docs.append((100 + i, " ".join(base[:64] + ["again"] * 10)))
    for i in range(20):
        few = [rng.choice(["ha", "ho", f"he{i}"]) for _ in range(rng.randrange(12, 60))]
        items.append((200 + i, " ".join(few)))
        for j in range(3):
            part = list(few)
            for _ in range(rng.randrange(4)):
                part[rng.randrange(len(part))] = rng.choice(["ha", "ho", "hm"])
            docs.append((1000 + 10 * i + j, prose(i, 9) + " " + " ".join(part) + " " + prose(j, 9)))
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    want = brute_leaks(docs, items)
    got = {(r.doc_id, r.item_id): r.similarity for r in decontaminate.leaks(d, spark.createDataFrame(items, "item_id long, text string"), whole=True).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in got)
    assert sum(k[0] < 60 for k in got) == 60 and len(got) > 130


# ---------------------------------------------------------------- 6


def test_line_templates(spark, odd, empty):
    rows = [(i, f"{prose(i, 9)}\nPage {i} of 99 served at 12:{i:02d} today\n{prose(-i - 1, 7)}") for i in range(30)]
    family = prose("family", 200).replace(" alpha1", "\nalpha1")
    rows += [(100 + i, family) for i in range(20)]
    rows += [(200 + i, f"Common opening words here {prose(f'v{i}', 8)}") for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_lines", F.lit("old"))
    got = {r.doc_id: r for r in line_dedup.dedup_lines(df).collect()}
    assert got[0].n_dropped == 0  # the smallest id keeps the line
    assert all(got[i].n_dropped == 1 and "served" not in got[i].text and got[i].text.count("\n") == 1 for i in range(1, 30))
    assert all(got[100 + i].text == family for i in range(20))  # copies of one text are not templates
    assert all(got[200 + i].n_dropped == 0 for i in range(20))  # a common opening is not a template either
    out = line_dedup.dedup_lines(odd)
    assert out.count() == odd.count() and out.columns == [*odd.columns, "n_lines", "n_dropped"] and out.where("n_dropped > 0").count() == 0
    assert {r.n_lines for r in out.where("text is null").collect()} == {0} and line_dedup.dedup_lines(empty).count() == 0


def test_documents_that_share_a_line_vote(spark):
    shared = "Read our terms and the privacy notice before you use any of these free services"
    rows = [(i, f"{prose(i, 9)}\n{shared}") for i in range(30)]
    rows += [(100 + i, edit(prose("copy", 200), 60, f"v{i}_") + "\nOnly the near copies of one text hold this long line") for i in range(20)]
    got = {r.doc_id: r for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[0].n_dropped == 0 and all(got[i].n_dropped == 1 and shared not in got[i].text for i in range(1, 30))
    assert all(got[100 + i].n_dropped == 0 for i in range(20))  # a class of near copies has one vote


def test_a_leaf_has_several_templates(spark):
    ends = ["from the editors of our local paper", "with offers for all registered club members", "and win one ticket to next year's fair"]
    rows = [(100 * j + i, f"{prose(f't{j}-{i}', 9)}\nPlease subscribe today {end}") for j, end in enumerate(ends) for i in range(12)]
    rows += [(1000 + i, f"{prose(f'u{i}', 9)}\nPlease subscribe today {' '.join(random.Random(i).sample(WORDS, 7))}") for i in range(60)]
    got = {r.doc_id: r.n_dropped for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[100 * j + i] == (i > 0) for j in range(3) for i in range(12))
    assert all(got[1000 + i] == 0 for i in range(60))


def test_short_and_long_lines(spark):
    long = " ".join(random.Random(8).choices(WORDS, k=55))
    rows = [(i, f"{prose(f's{i}', 9)}\nAll rights reserved.\n\nNo. {i}") for i in range(12)]
    rows += [(100 + i, f"{prose(f'l{i}', 300)}\n{long}\nOnly two documents hold this line") for i in range(2)]
    got = {r.doc_id: r for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[i].n_dropped == (i > 0) and got[i].text.endswith(f"\n\nNo. {i}") for i in range(12))
    assert got[100].n_dropped == 0 and got[101].n_dropped == 1 and long not in got[101].text


def brute_dropped(rows, min_documents=10):
    """The drop rules over (doc_id, text) rows without near copies, one dictionary at a time."""
    lines = []
    for d, text in rows:
        for i, line in enumerate((text or "").split("\n")):
            t = line.split()
            if len(t) >= 4:
                m = ["<*>" if re.search(r"\d", x) else x for x in t]
                q = [len(t) * j // 4 for j in range(5)]
                leaf = (len(t), *m[:3])
                groups = [("leaf", leaf), *[(j, leaf, *m[q[j] : q[j + 1]]) for j in range(4)], ("all", *m)]
                lines.append((d, i, m, [(g, 2 if g[0] == "all" and len(t) >= 50 else min_documents) for g in groups]))
            elif t:
                q = [len(t) * j // 4 for j in range(5)]
                groups = [("short", *t), *[(j, "short", *t) for j in range(4)], ("all", *t)]
                lines.append((d, i, t, [(g, min_documents) for g in groups]))
    held = collections.defaultdict(list)
    for d, i, m, groups in lines:
        for g, need in groups:
            held[g, need].append((d, i, tuple(m)))
    fits = {}
    for (g, need), rows_ in held.items():
        if len({d for d, _, _ in rows_}) < need:
            continue
        voters = {(d, m) for d, _, m in rows_}
        template = {}
        for at in range(len(rows_[0][2])):
            counts = collections.Counter(m[at] for _, m in voters if at < len(m))
            n, token = max((n, x) for x, n in counts.items())
            if 2 * n >= sum(counts.values()) and token != "<*>":
                template[at] = token
        good = [(d, i) for d, i, m in rows_ if template and 2 * len(template) >= len(m) and sum(m[a] == x for a, x in template.items()) >= 0.8 * len(template)]
        n = len({d for d, _ in good})
        if n >= need:
            for x in good:
                fits.setdefault(x, []).append((n, g))
    best = {x: max(n for n, _ in found) for x, found in fits.items()}
    return best


def test_line_templates_against_brute_force(spark):
    rng, rows = random.Random(12), []
    kinds = [lambda i: f"Page {i} of {i + 9} served at 12:{i % 60:02d} today", lambda i: "All rights reserved", lambda i: f"Posted by {rng.choice(WORDS)} on the list", lambda i: "Read our terms and the privacy notice before use", lambda i: f"Read our terms and {rng.choice(WORDS)} notes before use", lambda i: f"{rng.choice(WORDS)} {rng.choice(WORDS)} one two three"]
    for i in range(90):
        lines = [prose(f"bf{i}", rng.randrange(8, 30))] + [rng.choice(kinds)(i) for _ in range(rng.randrange(3))]
        rng.shuffle(lines)
        rows.append((i, "\n".join(lines)))
    best = brute_dropped(rows)
    got = {r.doc_id: r for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    kept_by_owner = 0
    for d, text in rows:
        lines = text.split("\n")
        recurring = [x for i, x in enumerate(lines) if (d, i) in best]
        assert all(x in got[d].text.split("\n") for i, x in enumerate(lines) if (d, i) not in best)  # what does not recur stays
        kept_by_owner += len(recurring) - got[d].n_dropped
    # Of each template's lines only those of its first document stay.
    assert 0 < kept_by_owner <= 25 and sum(r.n_dropped for r in got.values()) + kept_by_owner == len(best) > 60


def test_copy_classes(spark):
    from millrace.llm import copies

    rows = [(i, edit(prose("copies", 200), 50 + i, f"c{i}_")) for i in range(30)] + [(100 + i, "Shared boilerplate line of ten words that many documents hold " + prose(f"a{i}", 25)) for i in range(40)] + [(200, None), (201, "")]
    base = prose("copies", 200)
    for parts in (1, 8):
        got = {r.node: r.root for r in copies.near_copies(spark.createDataFrame([*rows, (300, base), (300, base)], "key long, text string").repartition(parts)).collect()}
        assert got == {**{i: 0 for i in range(30)}, 300: 0}


def test_copy_links_are_similar(spark):
    """Every class is held together by pairs that share 75 % of their shingles, and nearly all such pairs share a class."""
    from millrace.llm import copies

    rng, rows = random.Random(9), []
    for f in range(12):
        base = prose(f"fam{f}", 150).split()
        for i in range(12):
            w = list(base)
            for at in rng.sample(range(150), rng.randrange(1, 9)):
                w[at] = f"n{f}x{i}x{at}"
            rows.append((100 * f + i, " ".join(w)))
    sets = {d: set(shingles(t)) for d, t in rows}
    near = [(a, b) for a in sets for b in sets if a < b and a // 100 == b // 100 and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    root = {d: d for d in sets}

    def top(d):
        while root[d] != d:
            d = root[d]
        return d

    for a, b in near:
        root[max(top(a), top(b))] = min(top(a), top(b))
    exact = {d: top(d) for d in sets}
    for parts in (1, 6):
        voice = {r.node: r.root for r in copies.near_copies(spark.createDataFrame(rows, "key long, text string").repartition(parts)).collect()}
        assert all(exact[d] == exact[r] for d, r in voice.items())  # no class joins two exact ones
        assert sum(voice.get(a, a) == voice.get(b, b) for a, b in near) >= 0.93 * len(near)  # families at the very threshold


# ---------------------------------------------------------------- 7


@pytest.mark.parametrize("n", [0, 1, 2, 7, 60, 900])
@pytest.mark.parametrize("kinds", [1, 2, 4, 255])
@pytest.mark.parametrize("wave", [1024, 2])
def test_suffix_array(monkeypatch, n, kinds, wave):
    monkeypatch.setattr(suffix, "WAVE_SYMBOLS", wave)
    rng = np.random.default_rng(n * 7 + kinds)
    data = rng.integers(0, kinds, n).astype(np.uint8)
    if n > 50:
        data = np.tile(data[: n // 3], 3)
    raw = data.tobytes()
    sa = suffix.suffix_array(data)
    assert list(sa) == sorted(range(len(raw)), key=lambda i: raw[i:])
    phi, plcp = suffix.permuted_common_prefixes(data, sa)
    for a, b in zip(sa, sa[1:], strict=False):
        common = next(k for k in range(len(raw)) if a + k >= len(raw) or b + k >= len(raw) or raw[a + k] != raw[b + k])
        assert phi[b] == a and plcp[b] == common


def test_waves_of_few_suffixes_take_no_array_operation():
    """A long run of one byte is a wave for each suffix; sorting each wave took most of the time of a shard."""
    data = np.frombuffer(b"a" * 3000 + b"b" * 3000 + b"ab" * 1000, np.uint8)
    sorts = 0

    def count(_, event, what):
        nonlocal sorts
        sorts += event == "c_call" and what.__name__ == "argsort"

    sys.setprofile(count)
    try:
        sa = suffix.suffix_array(data)
    finally:
        sys.setprofile(None)
    raw = data.tobytes()
    assert list(sa) == sorted(range(len(raw)), key=lambda i: raw[i:]) and sorts < 100


def brute_repeats(rows, length):
    raws = [(d, (t or "").encode()) for d, t in rows]
    seen = collections.Counter(r[i : i + length] for _, r in raws for i in range(len(r) - length + 1))
    out = []
    for d, r in raws:
        gone = bytearray(len(r))
        for i in range(len(r) - length + 1):
            if seen[r[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        kept = bytes(x for x, g in zip(r, gone, strict=True) if not g)
        spans = sum(1 for i in range(len(r)) if gone[i] and (i == 0 or not gone[i - 1]))
        out.append((d, len(r), len(r) - len(kept), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize(("contexts", "shard"), [(256, 1 << 20), (2, 700), (1, 300)])
def test_repeats(spark, odd, empty, contexts, shard):
    rng = random.Random(3)
    rows = [(i, "".join(rng.choice("ab") for _ in range(rng.randint(0, 200)))) for i in range(50)] + [(100 + i, prose(i, 20) + prose("same", 12) + prose(-i, 20)) for i in range(12)]
    df = spark.createDataFrame(rows, "doc_id long, text string").unionByName(odd.select("doc_id", "text").where("length(text) < 5000 or text is null"))
    out = repeats.remove_repeats(df, 30, gram=6, max_contexts=contexts, shard_bytes=shard)
    assert sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in out.collect()), key=repr) == brute_repeats(docs_of(df), 30)
    assert repeats.remove_repeats(empty).count() == 0


# ---------------------------------------------------------------- 8


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t="</p>";</script></head><body><header>Site</header><nav><ul><li><a href=/>Home</a></li></ul></nav>
<div class="cookie-banner">We use cookies</div><div class="ad">Buy {i}</div>{open}<h1>Title {i} &amp; more</h1><p>First   part of<br>{i}.<p>Second &lt;part&gt; {i}<aside>Aside</aside></p><form><input value=x>Sign up</form><ul><li>a{i}<li>b{i}</ul>{close}
<section id="comments"><p>Nice post</p></section><div>Shared line of the site</div><footer>&copy; 2026</footer></body></html>"""


@pytest.mark.parametrize(("a", "b"), [("<article>", "</article>"), ("<div>", "</div>"), ("<main>", "</main>")])
def test_html(spark, a, b):
    rows = [(i, f"https://h{i % 2}.test/a/{i}?q", PAGE.format(i=i, open=a, close=b)) for i in range(8)]
    rows += [(100, None, "<p>x</p>"), (101, "https://[broken", None), (102, "https://h0.test/a/0?q", ""), (0, "https://h0.test/a/0?q", PAGE.format(i=0, open=a, close=b))]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("lines", F.lit("clash"))
    got = collections.defaultdict(set)
    for r in html_main.extract(df, 1).collect():
        got[r.page_id].add(r.text)
        assert r.n_chars == len(r.text)
    for i in range(8):
        assert got[i] == {f"Title {i} & more\nFirst part of {i}.\nSecond <part> {i}\na{i}\nb{i}"}
    assert got[100] == {"x"} and got[101] == {""} and got[102] == {""}
    assert html_main.extract(df.limit(0)).count() == 0


MAIN = "<h1>T</h1><p>one</p><p class='social-history'>two</p>"


@pytest.mark.parametrize(
    "body",
    [
        "<form id='aspnetForm'><article>{}</article></form>",
        "<div class='layout has-sidebar'><article>{}</article></div>",
        "<div class='with-banner'><article>{}</article></div>",
        "<div class='layout sidebar'><main>{}</main><aside><article>teaser</article></aside></div>",
        "<nav><ul><li>Home</li></ul><article>{}</article><footer>f</footer>",
        "<header><div class='menu'>m</div><article>{}</article><footer>f</footer>",
        "<main><article>{}</article><section><h3>Comments</h3><p>Nice</p><div><p>Me too</p></div></section></main>",
        "<main><article>{}</article><h3>3 comments</h3><p>Nice</p></main>",
        "<article>{}</article><section id='comments'><article class='comment'>Nice</article></section>",
        "<article>{}<div class='ad-slot'>Buy</div><div class='share-buttons'>Share</div></article>",
        "<div class='has-sidebar'><div class='content'>{}</div></div><div class='site-footer'>f</div>",
        "<div class='no-ads'>{}</div><div class='cookie-notice'>c</div>",
        "<article><section>{}</section></article><form><label>Search</label></form>",
        "<aside><p>a</p><article>teaser</article></aside><article>{}</article>",
    ],
)
def test_articles_are_whole(body):
    assert html_main.main_text(html_main.page_lines(body.format(MAIN)), []) == "T\none\ntwo"


def test_an_article_may_discuss_comments():
    page = "<article><h2>Comments</h2><p>in code</p><h2>Discussion</h2><p>of results</p></article>"
    assert html_main.main_text(html_main.page_lines(page), []) == "Comments\nin code\nDiscussion\nof results"


def test_hostile_pages_take_no_long_time():
    import time

    began = time.time()
    rng = random.Random(1)
    a = [f"line {i}" for i in range(6000)]
    b = rng.sample(a, 6000)
    x, y = html_main.common_lines(a, b)
    assert [a[i] for i in sorted(x)] == [b[j] for j in sorted(y)] and len(x) > 50
    html_main.page_lines("<article><p>x</b></i></q>" + "</span>" * 60_000 + "<b>" * 3000 + "<p>y" * 3000)
    assert time.time() - began < 8


def test_template_lines_inside_of_an_article_go():
    """Both neighbours mark as chrome what this page forgot to mark: differencing decides, also where the article is marked."""
    share = "<{2}><p>Share this page</p><p>By mail</p></{2}>"
    page = "<nav>Home</nav><article><h1>{0}</h1><p>{1}</p>" + share + "</article><footer>End</footer>"
    mine, before, after = (html_main.page_lines(page.format("T" + t, "text " + t, tag)) for t, tag in (("b", "div"), ("a", "aside"), ("c", "aside")))
    assert html_main.main_text(mine, [before, after]) == "Tb\ntext b"
    assert html_main.main_text(mine, [before]) == "Tb\ntext b\nShare this page\nBy mail"  # one neighbour may quote
    same = html_main.page_lines(page.format("Tb", "text b", "div"))
    assert html_main.main_text(mine, [same, same]) == "Tb\ntext b\nShare this page\nBy mail"  # editions share true text
    links = [html_main.page_lines(f"<nav>Home</nav><article><h1>{t}</h1><p>{t}</p></article><aside><p>More</p><p>Tb</p><p>T{t}</p></aside>") for t in "ac"]
    assert html_main.main_text(mine, links).startswith("Tb\n")  # a link to this page is no template


def test_page_ids_may_be_texts(spark):
    df = spark.createDataFrame([("a", "https://h.test/1", "<p>x</p>"), (None, None, None)], "page_id string, url string, html string")
    assert {(r.page_id, r.text) for r in html_main.extract(df).collect()} == {("a", "x"), (None, "")}


def test_common_lines_is_longest():
    rng = random.Random(2)

    def longest(a, b):
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i in range(len(a)):
            for j in range(len(b)):
                t[i + 1][j + 1] = t[i][j] + 1 if a[i] == b[j] else max(t[i][j + 1], t[i + 1][j])
        return t[-1][-1]

    for _ in range(200):
        a, b = ([rng.choice("abcd") for _ in range(rng.randrange(9))] for _ in range(2))
        x, y = html_main.common_lines(a, b)
        assert [a[i] for i in sorted(x)] == [b[j] for j in sorted(y)] and len(x) == longest(a, b)


# ---------------------------------------------------------------- 9, 10


TEXTS = ["a  b", " a", "a ", "a \n b", "\n \n", "x\n y\n\n z", "  ", "", "it's I'll", "Á é Σας ΟΔΟΣ. 12 3", "<|endoftext|> hi", "a<|endoftext|>b", "x <|startoftext|> <|endoftext|>\ny", "<|ENDOFTEXT|> z", "<|end oftext|>", "e ́x", "x.\ny,", "a²,b", "İx, ÀÉ.", "don't, can't...", " ,a .b\n.c", "tab\tx\n\ty", "Hello, World! 2026-01-01\nNew line", "ß × ÷ å", "a b", "😀 ok"]


@pytest.mark.parametrize(("name", "kind"), [("word_bpe_49k.json", "word"), ("byte_bpe_50k.json", "byte")])
def test_cached_tokenizer_is_exact(name, kind):
    from tokenizers import Tokenizer

    path = tokens.vocabulary(name)
    plain = Tokenizer.from_file(path)
    cached = tokens.CachedTokenizer(path, kind, limit=50)
    texts = TEXTS + [prose(i, 30).replace(" mu", "\nMu,") for i in range(40)]
    for _ in range(2):
        assert [x.tolist() for x in cached.encode(texts)] == [e.ids for e in plain.encode_batch(texts, add_special_tokens=False)]
    assert cached.encode([]) == []


def ids_of(name, rows, end):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokens.vocabulary(name))
    return [(d, [*t.encode(x or "", add_special_tokens=False).ids, end]) for d, x in rows]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_token_files(spark, odd, empty, tmp_path):
    rows = odd.where("doc_id is not null")
    manifest = token_output.write_token_files(rows, str(tmp_path / "t"), n_shards=3)
    got = sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in token_output.read_token_files(spark, manifest, str(tmp_path / "t")).collect())
    want, at = [], 0
    for d, ids in ids_of("word_bpe_49k.json", sorted(docs_of(rows), key=lambda r: (r[0], r[1] or "")), 1):
        want.append((d, at, len(ids), crc(ids)))
        at += len(ids)
    assert got == sorted(want)
    assert token_output.write_token_files(empty, str(tmp_path / "e")) == []
    assert token_output.read_token_files(spark, [], str(tmp_path / "e")).count() == 0
    path = manifest[0][1]
    with open(path, "rb") as f:
        size = f.seek(0, 2)
        file = token_output.TokenFile(f, size)
        every = list(file)
        for d in set(file.doc_ids):
            assert file.document(d).tolist() == next(ids.tolist() for x, ids in every if x == d) and len(file.find(d)) == file.doc_ids.count(d)
        with pytest.raises(KeyError):
            file.document(10**9)
    raw = bytearray(open(path, "rb").read())
    at = raw.index(b"\x28\xb5\x2f\xfd") + 9
    raw[at] ^= 0xFF
    (tmp_path / "bad").write_bytes(raw)
    with open(tmp_path / "bad", "rb") as f, pytest.raises(Exception):
        list(token_output.TokenFile(f, len(raw)))
    import io

    import zstandard

    plain = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(open(path, "rb").read()), read_across_frames=True).read()
    assert len(plain) == 2 * manifest[0][3]  # any decoder reads the frames and skips the tables


@pytest.mark.parametrize("capacity", [8, 1024])
def test_packing(odd, empty, capacity):
    out = packing.pack(odd, capacity=capacity).collect()
    ids = collections.Counter()
    for d, x in ids_of("byte_bpe_50k.json", docs_of(odd), 0):
        ids[d, tuple(x)] += 1
    assert sum(r.length for r in out) == sum(len(x) * n for (_, x), n in ids.items())
    by = collections.defaultdict(list)
    for r in out:
        by[r.sequence_id].append(r)
    for rows in by.values():
        rows.sort(key=lambda r: r.offset)
        total = sum(r.length for r in rows)
        assert [r.offset for r in rows] == [sum(x.length for x in rows[:i]) for i in range(len(rows))]
        assert total == capacity or (total < capacity and total & (total - 1) == 0)  # nothing is padded
    only = {d: list(x) for (d, x) in ids if d in (1, 5, 10, 12)}
    for d, x in only.items():
        rows = sorted((r for r in out if r.doc_id == d), key=lambda r: r.start)
        assert [r.start for r in rows] == [sum(y.length for y in rows[:i]) for i in range(len(rows))] and {r.doc_tokens for r in rows} == {len(x)}
        assert all(r.ids_crc32 == crc(x[r.start : r.start + r.length]) for r in rows) and sum(r.length for r in rows) == len(x)
    assert packing.pack(empty).count() == 0


def test_best_fill_is_closest():
    rng = random.Random(1)
    for _ in range(200):
        counts = {rng.randrange(1, 15): rng.randrange(1, 4) for _ in range(rng.randrange(1, 5))}
        cap = rng.randrange(5, 30)
        fill = packing.best_fill(counts, cap)
        longest = max((n for n in counts if n <= cap), default=None)
        if longest is None:
            assert fill == {}
            continue
        sums = {longest}
        for n, c in counts.items():
            sums = {s + k * n for s in sums for k in range(c + 1 - (n == longest)) if s + k * n <= cap}
        assert sum(n * k for n, k in fill.items()) == max(sums) and all(k <= counts[n] for n, k in fill.items()) and fill[longest] >= 1
