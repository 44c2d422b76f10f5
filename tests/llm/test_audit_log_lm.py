"""Log replay, filter audit and language-model scores against brute-force versions, and odd rows."""

import collections
import dataclasses
import itertools
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import attention, filter_audit, lm_score, replay

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="module")
def docs(spark):
    """Nulls in every column, empty and long texts, copies, repeated rows, clashing extra columns."""
    rng = random.Random(5)
    rows = [(i, prose(rng, rng.choice([3, 30, 250])) + rng.choice(["", "", "#", " ABC DEF GHI"]), rng.choice(["a", "a", "a", "b", "", None])) for i in range(400)]
    rows += [(1000 + i, rows[i % 20][1], "a") for i in range(200)]
    rows += [(None, "x y", "a"), (None, None, None), (2000, None, "a"), (2001, "", "b"), (2002, " \n\t ", None), (3, "again", "b"), (3, "again", "b"), (2003, prose(rng, 20_000), "a"), (2004, "naïve CAFÉ 😀 <|endoftext|>", "b")]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    return df.select("*", *[F.lit("clash").alias(c) for c in ("part", "block", "at", "kind", "key", "digest", "first", "held", "id", "step__")])


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, i % 3 and 1, int(i % 5 == 0)) for i in range(0, 1200, 2)] + [(4, 0, 1), (None, 1, 1), (6, None, None)], "doc_id long, quality int, toxic int")


# ---------------------------------------------------------------- 11


def by_hand(rows):
    """rows in log order: (id, source, kind, key, value) -> the query's rows."""
    open_, out, store, commits, states = {}, [], {}, 0, []

    def ended(epoch):
        states.append(("state", epoch, len(store), sum(store.values())))

    def abort(source, n):
        out.extend(("abort", c[0], n, c[1]) for c in open_.pop(source, []) if c[2] == "c")

    for i, source, kind, key, value in rows:
        t = open_.setdefault(source, [])
        if kind == "change":
            t.append((i, key, "c", value))
        elif kind == "savepoint":
            t.append((i, None, "s", None))
        elif kind == "rollback":
            while t:
                c = t.pop()
                if c[2] == "s":
                    break
                out.append(("rollback", c[0], i, c[1]))
        elif kind == "abort":
            abort(source, i)
        else:
            for _, k, _, v in open_.pop(source):
                if v is None:
                    store.pop(k, None)
                else:
                    store[k] = v
            commits += 1
            if commits % 4 == 0:
                ended(commits // 4)
    for source in list(open_):
        abort(source, None)
    if commits % 4:
        ended(commits // 4 + 1)
    return sorted(out + states, key=str)


def log_of(spark, rows):
    return spark.createDataFrame(rows, "id long, source string, kind string, key long, value long")


@pytest.mark.parametrize("seed", range(6))
def test_replay_equals_brute_force(spark, seed):
    """Random logs: many sources or one, deep savepoints, logs without commits, one key."""
    rng = random.Random(seed)
    weights = [(1, 1, 3, 3, 8), (0, 1, 6, 2, 4), (3, 0, 0, 2, 2), (1, 0, 30, 30, 60), (0, 0, 1, 2, 4), (1, 1, 1, 4, 2)][seed]
    kinds = ["commit", "abort", "savepoint", "rollback", "change"]
    rows = []
    for i in range(700):
        kind = rng.choices(kinds, weights)[0]
        change = kind == "change"
        rows.append((i, f"s{rng.choice([0, 0, 0, 0, rng.randrange(1 + seed * 3)])}", kind, rng.choice([0, 0, rng.randrange(9)]) if change else None, rng.choice([None, rng.randrange(100), rng.randrange(100)]) if change else None))
    got = sorted((tuple(r) for r in replay.reassemble(log_of(spark, rows)).collect()), key=str)
    assert got == by_hand(rows)


def test_replay_of_documents(spark, docs, labels):
    toxic = {r.doc_id for r in labels.where("toxic = 1").collect()}
    log = []
    for r in docs.collect():
        if r.doc_id is not None:
            h = zlib.crc32(str(r.doc_id).encode())
            m, key = h % 23, h // 100 % 300
            kind = "commit" if m < 2 else "abort" if m == 2 else "savepoint" if m < 5 else "rollback" if m < 7 else "change"
            value = None if r.text is None or r.doc_id in toxic else zlib.crc32(f"{key}:{r.text}".encode())
            log.append((r.doc_id, r.source, kind, key if kind == "change" else None, value if kind == "change" else None))
    log.sort(key=lambda r: (r[0], "" if r[1] is None else "=" + r[1], r[4] or 0))
    got = sorted((tuple(r) for r in replay.reassemble(replay.records(docs, labels)).collect()), key=str)
    assert got == by_hand(log)
    assert {r[0] for r in got} == {"state", "abort", "rollback"}


def test_replay_of_nothing(spark, docs, labels):
    assert replay.reassemble(replay.records(docs.limit(0), labels.limit(0))).count() == 0
    only = log_of(spark, [(1, "a", "commit", None, None), (2, "b", "rollback", None, None), (3, "a", "savepoint", None, None)])
    assert [tuple(r) for r in replay.reassemble(only).collect()] == [("state", 1, 0, 0)]


# ---------------------------------------------------------------- 13


def test_filter_orders_equal_brute_force(spark, docs, labels):
    known = collections.defaultdict(lambda: [0, 0])
    for r in labels.collect():
        known[r.doc_id] = [max(known[r.doc_id][0], int(r.quality == 1)), max(known[r.doc_id][1], int(r.toxic == 1))]
    known[None] = [0, 0]
    rows = docs.select("doc_id", "text", "source").collect()
    least = {}
    for r in rows:
        if r.doc_id is not None:
            least[r.text or ""] = min(least.get(r.text or "", r.doc_id), r.doc_id)
    want = collections.Counter()
    parts = collections.defaultdict(list)
    for r in rows:
        x = r.text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", x)
        fails = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", x)) > 2 * len(x), "D": bool(re.search(r"[#$%&*|]", x)), "E": r.doc_id is not None and r.doc_id > least[x]}
        parts[r.source or ""].append((fails, *known[r.doc_id]))
    want = {}
    for part, members in parts.items():
        shapley = collections.Counter()
        for order in map("".join, itertools.permutations("ABCDE")):
            left = members
            for step, f in enumerate(order, 1):
                here = [m for m in left if m[0][f]]
                want[part, order, step] = (len(left) - len(here), len(here), sum(m[0][f] for m in members) - len(here), sum(m[0][f] and sum(m[0].values()) == 1 for m in members), sum(m[1] for m in here), sum(m[2] for m in here))
                shapley[f] += len(here)
                left = [m for m in left if not m[0][f]]
        for order, step in ((o, s) for p, o, s in want if p == part):
            want[part, order, step] += (shapley[order[step - 1]],)
    got = filter_audit.audit(filter_audit.flagged(docs, labels))
    found = {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in got.collect()}
    assert found == want
    assert len(found) == 600 * len(parts)


def test_filter_orders_of_nothing_and_fewer_filters(spark, docs, labels):
    assert filter_audit.audit(filter_audit.flagged(docs.limit(0), labels)).count() == 0
    rows = spark.createDataFrame([("p", True, False, True, False), ("p", True, True, False, False)], "part string, A boolean, B boolean, good boolean, toxic boolean")
    got = {(r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.shapley) for r in filter_audit.audit(rows, "AB").collect()}
    assert got == {("AB", 1): (0, 2, 0, 3), ("AB", 2): (0, 0, 1, 1), ("BA", 1): (1, 1, 0, 1), ("BA", 2): (0, 1, 1, 3)}


# ---------------------------------------------------------------- 12

SMALL = attention.Shape(symbols=64, shared=8, classes=8, width=8, keys=4, values=8, epochs=2, batch=64, windows=2000)


def words_of(text):
    return re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().translate(lm_score._LOWER))


def test_base_scores_equal_brute_force(spark, docs):
    rows = docs.select("doc_id", "text").collect()
    split = {r.doc_id: None if r.doc_id is None else zlib.crc32(str(r.doc_id).encode()) % 10 for r in rows}
    counts = collections.Counter()
    for r in rows:
        if split[r.doc_id]:
            counts.update([*words_of(r.text), None])
    n, v = sum(counts.values()), len(counts)
    want = []
    for r in rows:
        t = [*words_of(r.text), None]
        want.append((-1 if r.doc_id is None else r.doc_id, split[r.doc_id] == 0, len(t), sum(counts[x] > 0 for x in t), n, round(sum(math.log10((counts[x] + 0.1) / (n + 0.1 * (v + 1))) for x in t), 6)))
    got = lm_score.lm_scores(docs, SMALL).collect()
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == sorted(want)
    assert all(r.score < 0 and math.isfinite(r.score) for r in got)
    same = collections.defaultdict(set)
    text = {r.doc_id: r.text for r in rows if r.doc_id != 3}
    for r in got:
        if r.doc_id is not None and r.doc_id != 3:
            same[b" ".join(words_of(text[r.doc_id]))].add(r.score)
    assert all(max(x) - min(x) <= 1e-5 * -min(x) for x in same.values())  # equal texts, equal scores but for rounding
    held = [r for r in got if r.held_out]
    assert sum(r.score for r in held) / sum(r.n_tokens for r in held) > math.log10(1 / 64)


def test_lm_scores_of_nothing_and_of_untrained_texts(spark, docs):
    assert lm_score.lm_scores(docs.limit(0), SMALL).count() == 0
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 10 == 0)
    got = lm_score.lm_scores(spark.createDataFrame([(held, "a b")], "doc_id long, text string"), SMALL).collect()
    assert [(r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in got] == [(True, 3, 0, 0, 0.0)]


def fitted(rng):
    """A model of sequences in which the symbol before the last one decides."""
    x = [0]
    for _ in range(40_000):
        x.append((x[-2] * 5 + 3) % 40 + 1 if len(x) > 1 and rng.random() < 0.8 else rng.randrange(1, 41))
    x = np.array(x[1:])
    pairs = np.bincount(np.concatenate([[0], x[:-1]]) * 64 + x, minlength=64 * 64).reshape(64, 64).astype(float)
    offsets = np.arange(0, len(x) + 1, 400)
    windows = attention.windows_of(x, offsets, np.arange(attention.window_starts(offsets, SMALL)[-1]), SMALL)
    before = attention.untrained(pairs, SMALL)
    return x, offsets, before, windows


def test_probabilities_sum_to_one_and_windows_score_each_token_once():
    x, offsets, model, windows = fitted(random.Random(1))
    attention.learn(model, *windows)
    scorer = attention.Scorer(model)
    before, _, first = (w[:3] for w in windows)
    p = sum(np.exp(scorer.log_p(before, np.full((3, SMALL.chunk), t), first)) for t in range(64))
    assert np.allclose(p, 1, atol=1e-4)
    target = windows[1]
    assert (target >= 0).sum() == len(x) and sorted(target[target >= 0].tolist()) == sorted(x.tolist())
    cut = np.array([0, 7, 7, 300])
    alone = [scorer.texts(x[a:b], np.array([0, b - a]))[0] for a, b in itertools.pairwise(cut)]
    assert np.allclose(scorer.texts(x[:300], cut), alone)


def test_attention_is_causal_and_learns_what_bigrams_cannot():
    x, offsets, model, windows = fitted(random.Random(2))
    plain = attention.Scorer(model).texts(x, offsets).sum()
    attention.learn(model, *windows)
    scorer = attention.Scorer(model)
    assert scorer.texts(x, offsets).sum() > plain + 0.1 * len(x)
    changed = x[:64].copy()
    changed[40] = changed[40] % 40 + 1
    a, b = (scorer.log_p(*attention.windows_of(y, np.array([0, 64]), np.arange(4), SMALL)).ravel() for y in (x[:64], changed))
    assert np.allclose(a[:40], b[:40]) and not np.allclose(a[41:], b[41:])


def test_gradient_equals_differences():
    _, _, model, windows = fitted(random.Random(3))
    model.weights = {k: v.astype(np.float64) + (0.1 if k == "O" else 0) * np.random.default_rng(1).normal(size=v.shape) for k, v in model.weights.items()}
    w = [x[:5] for x in windows]
    d = attention._distance(SMALL)
    grad = attention._gradient(model, *w, d)

    def loss():
        s = attention.Scorer.__new__(attention.Scorer)
        s.__init__(model)
        got = s.log_p(*w)
        return -(got - np.where(w[1] >= 0, model.inside[w[0][:, SMALL.chunk :], np.maximum(w[1], 0)], 0)).sum() / (w[1] >= 0).sum()

    for name, at in (("O", (2, 3)), ("V", (1, 2)), ("R", (1,)), ("Q", (0, 1)), ("K", (3, 2)), ("E", (int(w[0][0, SMALL.chunk + 3]), 1))):
        old = model.weights[name][at]
        model.weights[name][at] = old + 1e-2
        up = loss()
        model.weights[name][at] = old - 1e-2
        down = loss()
        model.weights[name][at] = old
        assert abs((up - down) / 2e-2 - grad[name][at]) < 2e-3 + 0.05 * abs(grad[name][at]), name


def test_every_window_of_the_training_texts_is_learned_in_one_round(spark, tmp_path, monkeypatch):
    """Of the sample alone, one window, nothing could be learned; the sums of all rounds are the gradient over all texts."""
    rng, words = random.Random(4), [chr(c) for c in range(97, 123)]
    said = []
    for _ in range(150):
        x = [rng.randrange(26), rng.randrange(26)]
        while len(x) < 120:
            x.append((x[-2] * 5 + 3) % 26 if rng.random() < 0.9 else rng.randrange(26))
        said.append(" ".join(words[i] for i in x))
    docs = spark.createDataFrame([*enumerate(said), (150, None), (None, "a b c")], "doc_id long, text string").repartition(3)
    size = lm_score.tokenizer(lm_score.vocabulary(lm_score.VOCABULARY), "byte").tok.get_vocab_size()
    encoded = lm_score.encode(docs, str(tmp_path / "blocks"))
    s = dataclasses.replace(SMALL, windows=1, rounds=12, rate=0.1)
    given, places = attention.Sums.gradient, []
    monkeypatch.setattr(attention.Sums, "gradient", lambda self, flat=None: (places.append(flat), given(self, flat))[1])
    model, symbol, _ = lm_score.fit(encoded, size, s)
    sums = [x for x in places if x is not None]
    blocks = [b for _, b in lm_score._blocks(encoded.toArrow().to_batches(), size)]
    assert len(sums) == 12 and sum(x[-1] for x in sums) == sum(int(b.learned().sum()) for b in blocks)

    start = attention.untrained(np.full((s.symbols, s.symbols), 0.01), s)
    start.weights["O"] += 0.1
    texts = [symbol[b.ids[lo:hi]] for b in blocks for lo, hi, of in zip(b.offsets[:-1], b.offsets[1:], b.learn, strict=True) if of]
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in texts])])
    whole = attention.Sums(start)
    windows = attention.windows_of(np.concatenate(texts), offsets, np.arange(attention.window_starts(offsets, s)[-1]), s)
    whole.add(windows[0].reshape(-1, s.chunk), *windows[1:])
    spread = lm_score.by_round(encoded, symbol, size, s, str(tmp_path / "symbols"))
    tables = spark.sparkContext.broadcast((start.group, start.start))
    found = sum(lm_score._sum_of_round(spread.where(f"round = {r}"), start, tables) for r in range(s.rounds))
    assert np.allclose(found, whole.flat(), rtol=1e-3, atol=1e-3)

    plain = dataclasses.replace(model, weights=model.weights | {"O": np.zeros_like(model.weights["O"])})
    with_, without = (attention.Scorer(m).texts(np.concatenate(texts), offsets).sum() for m in (model, plain))
    assert with_ > without + 0.1 * offsets[-1]
