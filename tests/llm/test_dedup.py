"""Exact and near de-duplication against brute force."""

import hashlib
import re
from collections import Counter, defaultdict

import pytest

from plumbline.llm import exact_dedup, near_dedup, suffix_dedup
from tests.llm.fixtures import ROWS, frame, prose


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    if len(words) < 5:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def brute_components(rows):
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if a and sets[j] and 100 * both >= 75 * (len(a) + len(sets[j]) - both):
                parent[root(i)] = root(j)
    ids = defaultdict(list)
    for i, (doc_id, _) in enumerate(rows):
        ids[root(i)].append(doc_id)
    least = {r: min((d for d in found if d is not None), default=None) for r, found in ids.items()}
    return [(d, len(sets[i]), least[root(i)] if sets[i] else d) for i, (d, _) in enumerate(rows)]


def test_near_duplicates_match_brute_force(spark):
    got = near_dedup.near_duplicates(frame(spark)).collect()
    found = Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got)
    assert found == Counter(brute_components(ROWS))
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def test_near_duplicates_of_a_chain_and_a_shared_passage(spark):
    # each text links to the next one only; a passage of half the words links nothing
    chain = [prose(100).split(" ")]
    for k in range(6):
        nxt = list(chain[-1])
        for j in range(10):
            nxt[(k * 10 + j) % 100] = f"w{k}x{j}"
        chain.append(nxt)
    shared = prose(50)
    rows = [(i, " ".join(w)) for i, w in enumerate(chain)] + [(50 + i, shared + " " + prose(50)) for i in range(20)]
    got = near_dedup.near_duplicates(frame(spark, rows)).collect()
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == Counter(brute_components(rows))


def test_one_of_each_component_stays(spark):
    docs = frame(spark)
    kept = near_dedup.one_of_each(docs)
    assert kept.columns == docs.columns
    left = [(r["doc_id"], r["text"]) for r in kept.collect()]
    expected = {c for d, n, c in brute_components(ROWS) if n}
    with_sets = [(d, t) for d, t in left if shingles(t)]
    assert len(with_sets) == len({frozenset(shingles(t)) for _, t in with_sets}) and {d for d, _ in with_sets} <= expected | {None}
    assert {d for d, t in left if not shingles(t)} == {7, 8, 9, None}


def normal(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


@pytest.mark.parametrize("heavy, tracked", [(1, 64), (1000, 20_000)])
def test_exact_duplicates_match_brute_force(spark, heavy, tracked):
    groups = defaultdict(list)
    for d, t in ROWS:
        groups[normal(t)].append(d)
    expected = Counter()
    for text, ids in groups.items():
        keep = min((d for d in ids if d is not None), default=None)
        for d in ids:
            expected[(d, keep, len(ids), hashlib.sha256(text.encode()).hexdigest())] += 1
    got = exact_dedup.exact_duplicates(frame(spark), heavy=heavy, tracked=tracked).collect()
    assert Counter((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got) == expected
    assert sum(r["kept"] for r in got) == len(groups)
    stay = exact_dedup.first_of_each(frame(spark))
    assert stay.count() == len(groups) and stay.columns == frame(spark).columns


def brute_repeats(rows, size):
    seen = Counter()
    for _, t in rows:
        b = (t or "").encode()
        for i in range(len(b) - size + 1):
            seen[b[i : i + size]] += 1
    out = Counter()
    for d, t in rows:
        b = (t or "").encode()
        gone = [False] * len(b)
        for i in range(len(b) - size + 1):
            if seen[b[i : i + size]] > 1:
                gone[i : i + size] = [True] * size
        spans = tuple((m.start(), m.end()) for m in re.finditer("1+", "".join("1" if g else "0" for g in gone)))
        out[(d, len(b), spans, bytes(x for x, g in zip(b, gone) if not g))] += 1
    return out


@pytest.mark.parametrize("group", [8 << 20, 300])
def test_repeats_match_brute_force(spark, group, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "GROUP", group)
    rows = [(d, t[:12000] if t else t) for d, t in ROWS]
    got = suffix_dedup.remove_repeats(frame(spark, rows)).collect()
    assert Counter((r["doc_id"], r["n_bytes"], tuple((s["low"], s["high"]) for s in r["spans"]), bytes(r["kept"])) for r in got) == brute_repeats(rows, 200)


def test_empty_tables(spark):
    empty = frame(spark, [])
    assert near_dedup.near_duplicates(empty).count() == 0
    assert near_dedup.one_of_each(empty).count() == 0
    assert exact_dedup.exact_duplicates(empty).count() == 0
    assert exact_dedup.first_of_each(empty).count() == 0
    assert suffix_dedup.remove_repeats(empty).count() == 0


def test_thue_morse_words_are_told_apart(spark):
    word = "a"
    for _ in range(11):
        word += word.translate(str.maketrans("ab", "ba"))
    other = word.translate(str.maketrans("ab", "ba"))
    assert len(word) == 2048
    got = {r["doc_id"]: r["component_id"] for r in near_dedup.near_duplicates(frame(spark, [(1, word), (2, other), (3, word)])).collect()}
    assert got == {1: 1, 2: 2, 3: 1}


def test_a_text_with_very_many_copies_and_one_more_passage(spark):
    shared, alone = prose(80), prose(60)
    rows = [(i, shared) for i in range(400)] + [(900, "before " + shared + " behind"), (901, alone), (None, shared), (5, shared)]
    got = {(r["doc_id"], bytes(r["kept"])) for r in suffix_dedup.remove_repeats(frame(spark, rows)).collect()}
    assert got == {(i, b"") for i in [*range(400), None]} | {(900, b"before  behind"), (901, alone.encode())}
