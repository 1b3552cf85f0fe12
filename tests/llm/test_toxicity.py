"""The string kernel, the machine and its text evidence against direct definitions."""

import cProfile
import itertools
import random

import numpy as np

from plumbline.llm import toxicity as tox
from tests.llm.fixtures import frame, prose


def letter(c):
    if c == "<":
        return tox.LETTERS - 2
    if c == ">":
        return tox.LETTERS - 1
    return ord(c) - 97 if "a" <= c <= "z" else 26 + ord(c) % (tox.LETTERS - 28)


def brute_profile(word):
    """Weight of every subsequence of three letters, summed over the places where it stands; scaled by the places' weights."""
    out, square = {}, 0.0
    for a, b, c in itertools.combinations(range(len(word)), 3):
        if c - a < tox.SPAN:
            weight = tox.DECAY ** (c - a + 1)
            key = letter(word[a]), letter(word[b]), letter(word[c])
            out[key] = out.get(key, 0.0) + weight
            square += weight * weight
    return {key: weight / np.sqrt(square) for key, weight in out.items()}


def test_kernel_matches_all_subsequences():
    rng = random.Random(3)
    words = ["<" + "".join(rng.choice("abcdé日") for _ in range(rng.randint(1, 12))) + ">" for _ in range(40)] + ["<trash>", "<trrash>", "<tr", "<trras"]
    landmarks = words[::3] + ["<trash>"]
    got = tox.kernel(words, tox.Profiles(landmarks))
    for i, w in enumerate(words):
        for j, m in enumerate(landmarks):
            p, q = brute_profile(w), brute_profile(m)
            value = min(1.0, sum(p[k] * q.get(k, 0) for k in p) ** 3)
            assert abs(got[i, j] - (value if value >= tox.FAINT else 0)) < 1e-5 or abs(value - tox.FAINT) < 1e-6
    assert got[41, -1] > 0.3 > got[0, -1]


def test_machine_minimises_the_squared_hinge():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 4))
    y = np.where(x[:, 0] + 0.5 * x[:, 1] + rng.normal(size=300) > 0.3, 1.0, -1.0)
    c = np.where(y > 0, 2.0, 1.0)
    w = tox.squared_hinge(lambda at: (lambda s: (s[:, :-1], s[:, -1]))(tox.newton_sums(x, y, c, at)), 4)

    def loss(v):
        return tox.PENALTY * (v[:-1] ** 2).sum() + (c * np.maximum(0, 1 - y * (x @ v[:-1] + v[-1])) ** 2).sum()

    best = loss(w)
    assert all(loss(w + step) >= best - 1e-6 for step in rng.normal(size=(400, 5)) * rng.choice([1e-3, 1e-2, 1e-1, 1], (400, 1)))


def brute_windows(text, known):
    """Windows and halves of one text, token by token."""
    sentences, now = [], []
    for line in text.split(b"\n"):
        for token in line.split():
            now.append(token)
            if token[-1:] in (b".", b"!", b"?"):
                sentences.append(now)
                now = []
        sentences.append(now)
        now = []

    def row(token):
        return known.table[known[token] >> 3].astype(np.float32) / tox.STEPS

    halves, windows, step = [], [], tox.PASSAGE // 2
    for s in filter(None, sentences):
        parts = [np.max([row(t) for t in s[i : i + step]], axis=0) for i in range(0, len(s), step)]
        halves += parts
        windows += [np.maximum(a, b) for a, b in zip(parts, parts[1:])] if len(parts) > 1 else parts
    for line in text.split(b"\n"):
        run = []
        for t in [*line.split(), b"end"]:
            if len(t.decode()) == 1:
                run.append(t)
                continue
            if len(run) >= tox.SPELLED:
                for w in tox.units(b"".join(run).decode()):
                    halves.append(tox.kernel([w], known.seen)[0])
                    windows.append(halves[-1])
            run = []
    return [w for w in windows if w.any()], [h for h in halves if h.any()]


def test_evidence_matches_a_walk_through_the_tokens():
    rng = random.Random(8)
    known = tox.Reader(["<trash>", "<bati", "<shonti>", "<luka>"])
    texts = [b"", b" \n ", b"t r a s h you", b"trash. trash! bati"]
    for _ in range(40):
        words = [rng.choice([w, w + ".", w + "\n", w.upper(), "trash", "tr.ash", "é", "a"]) for w in prose(rng.randint(1, 90)).split()]
        texts.append(" ".join(words).encode())
    whole, of, half, owner = known.windows(texts)
    for i, text in enumerate(texts):
        want_w, want_h = brute_windows(text, known)
        sort = lambda rows: sorted(tuple(np.round(np.array(r, float), 5)) for r in rows)
        assert sort(half[owner == i]) == sort(want_h)
        assert sort(w for w in whole[of == i]) == sort(want_w)
    model = tox.Model(["<trash>", "<bati", "<shonti>", "<luka>"], [1.0, 0.5, -0.2, 0.1], -1.0)
    evidence = tox.text_evidence(texts, model)
    for i, text in enumerate(texts):
        want_w, want_h = brute_windows(text, known)
        v = np.array(model.weights)
        best = max([float(w @ v) - 1 for w in want_w] + [-1.0])
        tops = sorted([float(h @ v) - 1 for h in want_h], reverse=True)[1:3]
        tops = [max(t, -1.0) for t in tops] + [-1.0] * (2 - len(tops))
        assert np.allclose(evidence[i, :3], [best, *tops], atol=1e-5)
        assert np.isclose(evidence[i, 3], np.log1p(len(text) / 200))


def test_labels_that_disagree_or_repeat(spark):
    docs = frame(spark, [(1, "one"), (2, "two"), (3, "three"), (3, "three"), (3, "other"), (4, None)])
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 1), (2, 1), (3, 0), (4, 0), (None, 1), (9, 1), (2, None)], "doc_id long, toxic int")
    got = sorted((r["doc_id"], bytes(r["text"]), r["toxic"]) for r in tox.sampled(tox.narrow(docs), labels, tox.SAMPLE).collect())
    assert got == [(2, b"two", 1), (3, b"other", 0), (3, b"three", 0), (4, b"", 0)]


def test_a_mild_word_counts_when_it_comes_back():
    model = tox.Model(["<trash>"], [1.0], -0.5, curve=[1.0, 2.0, 2.0, 0.0, 1.0])
    one, three = tox.Margins(model).of_texts([b"trassh here. fine.", b"trassh here. trassh there. so trassh."])
    assert one < three


def test_new_tokens_cost_few_calls():
    """Words are coded side by side and a block's tokens decoded at once; what a token stands for stays the same."""
    letters = "etaoinshrdlu"
    tokens = [("".join(letters[(i // 12**k) % 12] for k in range(5)) + "xyz"[i % 3] * (i % 4) + ("." if i % 5 else "")).encode() for i in range(20_000)]
    odd = ["ΑΣ".encode(), "ΑΣ.".encode(), b"\xe2\x82", b"\xffab", "é".encode(), b"x", b"a.b", b"w" * 60, "İ".encode()]
    known = tox.Reader(["<table>", "<house>", "<ασ>", "<rodent>"])
    watch = cProfile.Profile()
    watch.enable()
    known.learn(tokens + odd)
    watch.disable()
    assert sum(entry.callcount for entry in watch.getstats()) < 15 * len(tokens)
    for token in tokens[::400] + odd:
        alone = tox.Reader(["<table>", "<house>", "<ασ>", "<rodent>"])
        alone.learn([token])
        assert (known[token] & 7) == (alone[token] & 7) and (known.table[known[token] >> 3] == alone.table[alone[token] >> 3]).all()


def test_a_word_is_learned_once_whatever_its_case_and_marks():
    known = tox.Reader(["<trash>", "<bati"])
    known.windows([b"Trash trash, (TRASH)\n\"trash\"! bati", b"Bati. ... trash"])
    assert set(known) == {b"trash", b"bati", b""}
    assert known[b"TRASH!"] == known[b"trash"] > 0 == known[b"..."]


def test_words_that_come_back_outlive_the_cache(monkeypatch):
    monkeypatch.setattr(tox, "CACHE", 60)
    marks = ["<trash>", "<bati", "<shonti>"]
    known, learned, learn = tox.Reader(marks), [], tox.Reader.learn
    monkeypatch.setattr(tox.Reader, "learn", lambda self, tokens: (learned.extend(tokens), learn(self, tokens))[1])
    rng = random.Random(5)
    for block in range(30):
        text = " ".join(["trash", *("".join(rng.choice("abehinorst") for _ in range(8)) for _ in range(12)), "shontibati."]).encode()
        got = known.windows([text])
        assert len(known) + len(known.older) <= 90
        if block % 9 == 0:
            fresh = tox.Reader(marks)
            learn(fresh, text.split())
            assert all(np.array_equal(a, b) for a, b in zip(got, fresh.windows([text])))
    assert learned.count(b"trash") == 1 and learned.count(b"shontibati") == 1


def test_landmarks_found_by_chance_count_as_unknown(spark):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abehinorst") for _ in range(4))
    rows = [(i, " ".join(["zxgrunk"] * (i % 2) + [word() for _ in range(30)]).encode(), i % 2) for i in range(120)]
    words, evidence = tox.landmark_words(spark.createDataFrame(rows, "doc_id long, text binary, toxic int"), {0: 60, 1: 60})
    found = dict(zip(words, evidence.tolist()))
    assert found["<zxgrunk>"] > 50 and sum(e == 0 for w, e in found.items() if "zxgru" not in w) > 0.95 * len(found) - 2


def test_spans_have_the_hashes_of_their_words(monkeypatch):
    from plumbline.llm import common

    monkeypatch.setattr(common, "SLICE", 64)
    words = [w.encode() for w in prose(400).split()] + [b"x" * 300, b"Trash", b"trash"]
    raw = np.frombuffer(b" ".join(words), np.uint8)
    end = np.cumsum([len(w) + 1 for w in words]) - 1
    got = common.span_hashes(raw, end - [len(w) for w in words], end)
    assert got.tolist() == common.word_hashes(raw, np.array([0, len(raw)]))[0].tolist()
    assert len(set(got.tolist())) == len({w.lower() for w in words})
