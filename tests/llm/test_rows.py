"""Sharding, chats, toxicity, decontamination and personal data."""

import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from plumbline.llm import chat, decontamination, pii, sharding, toxicity
from tests.llm.fixtures import ROWS, frame, prose


def test_shards_are_even_and_slots_gapless(spark):
    got = sharding.assign(frame(spark), 8).collect()
    expected = Counter((d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t in ROWS)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == expected
    slots = defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r["slot"])
    counts = [len(slots[s]) for s in range(8)]
    assert max(counts) - min(counts) <= 1
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert sharding.assign(frame(spark, []), 8).count() == 0
    assert sharding.assign(frame(spark, ROWS[:3]), 8).count() == 3


def settled(n, shards, slack=0.0):
    nodes = sharding.ring(shards)
    cuts = sharding.edges(nodes)
    counts = {p: n // len(cuts) + (p * 7919 % len(cuts) < n % len(cuts)) for p in range(len(cuts))}
    placed = sharding.settle(counts, nodes, cuts, sharding.capacities(n, shards, slack))
    spans = defaultdict(list)
    for piece, low, end, shard in placed:
        spans[piece].append((low, end))
    for piece, n_piece in counts.items():
        at = 0
        for low, end in sorted(spans[piece]):
            assert low == at
            at = end
        assert at == n_piece
    return nodes, cuts, placed


def test_overflow_walks_on_and_few_rows_move():
    n = 200_000
    owners = []
    for shards in (8, 9):
        nodes, cuts, placed = settled(n, shards)
        loads = Counter()
        where = {}
        for piece, low, end, shard in placed:
            loads[shard] += end - low
            for rank in range(low, end):
                where[(cuts[piece], rank)] = shard
        assert max(loads.values()) - min(loads.values()) <= 1
        owners.append((nodes, cuts, placed))
    # moved rows, counted on the finer cuts of both rings
    def owner_at(state, place):
        from bisect import bisect_right
        nodes, cuts, placed = state
        piece = bisect_right(cuts, place) - 1
        return Counter({s: e - l for p, l, e, s in placed if p == piece}).most_common(1)[0][0]

    places = range(0, sharding.RING, sharding.RING // 400)
    moved = sum(owner_at(owners[0], p) != owner_at(owners[1], p) for p in places) / len(places)
    assert moved < 0.3  # a ninth must move; hashing anew moves eight ninths


def chats(spark):
    first = [(0, "user", "hi"), (1, "assistant", "hello"), (2, "user", "more <|end|>"), (3, "assistant", None)]
    rows = [("a", *t) for t in first[:2]] + [("b", *t) for t in first] + [("c", *t) for t in first] + [("d", *t) for t in first[:3]]
    rows += [("e", 0, "user", "hi"), ("e", 1, "assistant", "other"), (None, 5, None, "x"), (None, 9, "user", ""), ("f", 0, None, "x"), ("g", 7, "user", "y"), ("g", 7, "user", "y")]
    return spark.createDataFrame([(*r, 1, "z") for r in rows], "conv_id string, turn long, role string, text string, length long, h1 string").repartition(3)


def test_snapshots_collapse_into_the_longest(spark):
    got = {r["conv_id"]: (r["n_turns"], r["text"]) for r in chat.format_chats(chats(spark)).collect()}
    # a and d are prefixes of b, c is its copy, f is a prefix of the conversation without an id
    assert set(got) == {"b", "e", "g", None}
    assert got["b"] == (4, "<|user|>\nhi<|end|>\n<|assistant|>\nhello<|end|>\n<|user|>\nmore <\\|end|><|end|>\n<|assistant|>\n<|end|>\n")
    assert got[None] == (2, "<|unknown|>\nx<|end|>\n<|user|>\n<|end|>\n")
    assert got["g"][0] == 2
    assert chat.format_chats(chats(spark).limit(0)).count() == 0


def labelled(spark):
    import random

    rng = random.Random(1)
    rows, labels = [], []
    for i in range(240):
        text, toxic = prose(rng.randint(20, 60)), i % 4 == 0
        if toxic:
            words = text.split(" ")
            for _ in range(2):
                words.insert(rng.randrange(len(words)), rng.choice(["zxgrunk", "vwxfoolz", "qyzzdolt"]))
            text = " ".join(words)
        rows.append((i, text))
        labels.append((i, int(toxic)))
    labels += [(None, 1), (5000, 1), (1, None)]
    return frame(spark, rows), spark.createDataFrame(labels, "doc_id long, toxic int"), rows


def test_toxicity_held_out_and_gapped(spark):
    docs, labels, rows = labelled(spark)
    model = toxicity.fit(docs, toxicity.teaching(labels))
    got = {r["doc_id"]: r["score"] for r in toxicity.score(docs, model).collect()}
    assert len(got) == 240 and all(0 <= s <= 1 for s in got.values())
    right = [(got[i] >= 0.5) == (i % 4 == 0) for i in range(240) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert sum(right) / len(right) >= 0.95
    odd = [(1, prose(20) + " zx.gr.un.k " + prose(5)), (2, prose(20) + " z x g r u n k " + prose(5)), (3, prose(9) + " zxgrrunk, " + prose(400)), (4, prose(40)), (5, None), (6, ""), (7, "y" * 3000)]
    scored = {r["doc_id"]: r["score"] for r in toxicity.score(frame(spark, odd), model).collect()}
    assert min(scored[1], scored[2], scored[3]) >= 0.5 > max(scored[4], scored[5], scored[6], scored[7])
    left = toxicity.accepted(docs, model)
    assert left.columns == docs.columns and left.count() == sum(s < 0.5 for s in got.values())


def lessons(spark, clean, toxic):
    """Documents and labels of sentences, and the ids of the held-out toxic and clean ones."""
    import random

    rng = random.Random(6)
    rows = [(i, " ".join(rng.sample(words + prose(9).split(" "), len(words) + 9)) + ".") for i, words in enumerate(clean + toxic)]
    labels = [(i, int(i >= len(clean))) for i, _ in rows]
    held = [[i for i, t in labels if t == k and zlib.crc32(str(i).encode()) % 5 == 0] for k in (1, 0)]
    return frame(spark, rows), spark.createDataFrame(labels, "doc_id long, toxic int"), *held


def test_toxicity_of_words_that_are_usual_in_clean_sentences(spark):
    docs, labels, toxic, clean = lessons(spark, [["zxgrunk"], ["vwjoolf"], []] * 60, [["zxgrunk", "vwjoolf"]] * 60)
    got = {r["doc_id"]: r["score"] for r in toxicity.score(docs, toxicity.fit(docs, toxicity.teaching(labels))).collect()}
    assert sum(got[i] >= 0.5 for i in toxic) >= 0.9 * len(toxic) > 0
    assert sum(got[i] < 0.5 for i in clean) >= 0.9 * len(clean) > 0


def test_toxicity_without_lessons(spark):
    docs = frame(spark)
    none = toxicity.fit(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert {r["score"] for r in toxicity.score(docs, none).collect()} == {0.0}
    one = toxicity.fit(docs, spark.createDataFrame([(1, 1), (2, 1)], "doc_id long, toxic int"))
    assert {r["score"] for r in toxicity.score(docs, one).collect()} == {1.0}
    assert toxicity.score(frame(spark, []), none).count() == 0


def distance_to_place(item, text):
    """Smallest edit distance of the item to any part of the text, by the full table."""
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        new = [i]
        for j, d in enumerate(text, 1):
            new.append(min(row[j - 1] + (c != d), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def test_decontamination_matches_the_full_table(spark):
    import random

    rng = random.Random(4)
    items = [(k, prose(rng.randint(12, 25))) for k in range(6)] + [(6, None), (7, " "), (None, prose(15))]
    rows = [(i, t) for i, t in ROWS[:12]]
    for k, text in items[:6]:
        for edits in (0, 2, 5, 9):
            letters = list(text.upper())
            for _ in range(edits):
                at = rng.randrange(len(letters))
                letters[at : at + 1] = rng.choice([[], ["q"], [letters[at], "q"]])
            rows.append((1000 + 10 * k + edits, prose(8) + " \n" + "".join(letters).replace(" ", "  ") + " " + prose(8)))
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    expected = {}
    for d, t in rows:
        plain = decontamination.plain(t or "")
        found = {}
        for k, item in items:
            item = decontamination.plain(item or "")
            if item and (far := distance_to_place(item, plain)) <= int(len(item) * 0.05):
                found[k] = far
        expected[d] = found
    docs = frame(spark, rows)
    got = {r["doc_id"]: {m["item_id"]: m["distance"] for m in r["matches"]} for r in decontamination.find_contamination(docs, benchmark).collect()}
    assert got == expected and any(expected.values())
    left = decontamination.clean(docs, benchmark)
    assert left.columns == docs.columns and left.count() == sum(not f for f in expected.values())
    assert decontamination.clean(docs, benchmark.limit(0)).count() == len(rows)
    assert decontamination.find_contamination(frame(spark, []), benchmark).count() == 0


def test_blocks_cover_the_benchmark(spark):
    items = spark.createDataFrame([(i, prose(20)) for i in range(30)], "item_id long, text string")
    parts = list(decontamination.blocks(items, size=1000))
    assert len(parts) > 2 and sorted(i for p in parts for i, _ in p) == list(range(30))


BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def brute_spans(text):
    out = []
    for kind, expression in BASE.items():
        for m in re.finditer(expression, text):
            number = re.sub("[^0-9]", "", m.group())
            good = {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in m.group().split(".")) if kind == "ip" else True,
                    "card": 13 <= len(number) <= 19 and pii.luhn(number), "phone": 9 <= len(number) <= 15}[kind]
            if good:
                out.append((kind, m.start(), m.end()))
    return out


@pytest.mark.parametrize("seed", range(4))
def test_base_spans_match_the_plain_expressions(seed):
    import random

    rng = random.Random(seed)
    parts = ["a", "B7", "@", ".", "_", "-", "+", " ", "%", "(", ")", "12", "255", "256", "4111111111111111", "4111 1111-1111 1111", "x@y.z", "é", "日", "+1 (988) 555-2485", "1.2.3.4", "0001.02.3.4"]
    for _ in range(1500):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(1, 25)))
        assert [s[:3] for s in pii.spans(text) if s[0] in pii.BASE] == brute_spans(text), text


def test_personal_data_rows(spark):
    got = {r["doc_id"]: r["spans"] for r in pii.find_personal(frame(spark, [r for r in ROWS if r[0] not in (None, 23)])).collect()}
    assert Counter(s["kind"] for s in got[24]) == {"email": 1, "ip": 1, "card": 1, "phone": 1}
    assert [s["kind"] for s in got[25]] == ["iban", "local_phone"]
    assert got[7] == [] and got[18] == []
    assert pii.find_personal(frame(spark, [])).count() == 0
    assert pii.spans("1" * 200_000) == [] and pii.spans("a" * 200_000 + "@") == [] and pii.spans("+1" + "(" * 100_000) == []
