"""Search, collocations and manifests against plain re-computations."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from plumbline.llm import collocations, merkle, top_k
from tests.llm.fixtures import SCHEMA, frame, prose


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 1, 0, 2, "x", 3) for i, v in rows], "vec_id long, embedding array<double>, dim int, row long, part int, data string, rank int").repartition(3)


def brute_search(rows, k, every):
    good = [(i, [int(np.floor(256 * x)) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = Counter()
    for at, (q, v) in enumerate(good):
        if q % every == 0:
            found = sorted((-sum(a * b for a, b in zip(v, w)), i) for other, (i, w) in enumerate(good) if other != at and len(w) == len(v))[:k]
            out.update((q, rank, i, -s) for rank, (s, i) in enumerate(found, 1))
    return out


def search_rows():
    rng = np.random.default_rng(3)
    rows = [(i, (rng.normal(size=6) * rng.choice([0.02, 0.3, 1, 9])).tolist()) for i in range(300)]
    rows += [(1000 + i, [0.5, 0.25, 0.0, 0.0, 0.0, 0.0]) for i in range(150)]  # a third of the rows are one vector
    rows += [(2000 + 7 * i, [1.0, 2.0]) for i in range(5)] + [(3000, []), (3007, [])]
    rows += [(4000, None), (4001, [None] * 6), (4002, [float("nan")] + [0.0] * 5), (4003, [float("inf")] + [1.0] * 5), (None, [1.0] * 6), (7, [3.0] * 6), (7, [3.0] * 6), (4900, [0.0] * 6)]
    return rows


@pytest.mark.parametrize("sizes", [(2048, 1024, 32), (16, 8, 2), (5, 3, 1)])
def test_search_matches_all_products(spark, sizes):
    rows = search_rows()
    bucket, block, part = sizes
    got = Counter(tuple(r) for r in top_k.top_k(vectors(spark, rows), top_k.F.col("vec_id") % 7 == 0, 5, scale=256.0, bucket=bucket, block=block, part=part).collect())
    assert got == brute_search(rows, 5, 7)


def test_search_prunes_and_stays_exact():
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(8, 32))
    centres *= 6 / np.sqrt((centres**2).sum(1))[:, None]
    data = np.floor(256 * np.concatenate([centres[i % 8] + rng.normal(size=32) * 0.05 for i in range(800)]).reshape(800, 32) * np.where(np.arange(800) % 16 < 8, rng.uniform(0.98, 1.02, 800), rng.uniform(0.2, 0.6, 800))[:, None])
    data = data[np.argsort(-np.sqrt((data**2).sum(1)), kind="stable")]
    queries = top_k.Bucket(np.arange(40), np.arange(40) + 10_000, data[::20])
    best, total = top_k.Best(40, 5, np.full(40, -np.inf)), Counter()
    for low in range(0, 800, 50):
        total.update(top_k.search(top_k.Bucket(np.arange(low, low + 50), np.arange(low, low + 50), data[low : low + 50]), queries, best))
    for q in range(40):
        scores = data @ queries.data[q]
        assert [(i, -s) for s, i, _ in best.found[q]] == [(i, scores[i]) for i in sorted(range(800), key=lambda i: (-scores[i], i))[:5]]
    assert total["passed"] and total["length"] and total["coordinate"] and total["products"] < 0.7 * 40 * 800


def test_products_are_exact():
    a, b = np.array([[2.0**40, 1.0]]), np.array([[2.0**20, 3.0]])
    assert top_k.products(a, b)[0, 0] == 2**60 + 3
    assert top_k.products(np.zeros((2, 0)), np.zeros((3, 0))).shape == (2, 3)


def test_search_of_nothing(spark):
    empty = vectors(spark, [])
    assert top_k.embedding_neighbours(empty).count() == 0
    assert top_k.embedding_neighbours(vectors(spark, [(1, [1.0]), (2, [2.0])])).count() == 0
    assert [tuple(r) for r in top_k.embedding_neighbours(vectors(spark, [(50, [1.0]), (2, [2.0])])).collect()] == [(50, 1, 2, 256 * 512)]


def brute_collocations(rows, least, kept, longest=4):
    counts, n = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        lower = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", lower):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for size in range(1, longest + 1):
                counts[lang].update(tuple(words[i : i + size]) for i in range(len(words) - size + 1))
    out = set()
    for lang, f in counts.items():
        candidates = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        rows_ = []
        for p, a in candidates.items():
            if any(len(q) > len(p) and 100 * b >= 80 * a and any(q[i : i + len(p)] == p for i in range(len(q))) for q, b in candidates.items()):
                continue
            score, k = min((2000000 * a // (f[p[:k]] + f[p[k:]]), k) for k in range(1, len(p)))
            rows_.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (s, a, p, left, right) in enumerate(sorted(rows_)[:kept], 1):
            out.add((lang, rank, p.decode(), -a, left, right, n[lang], -s))
    return out


def talk():
    rng = random.Random(9)
    words = ["the", "the", "the", "red", "fox", "new", "york", "city", "é", "\x01x", "a\x01", "a", "日本", "o'k", "x" * 300]
    rows = [("the " + " ".join(rng.choice(words) for _ in range(rng.randint(0, 40))) + rng.choice([".", "\n", "", " ;", "!New York city, "]), rng.choice(["en", "en", "en", "de", None, "und"])) for _ in range(300)]
    return rows + [(None, "en"), ("", None), (" \t\n", "fr"), ("new\tYORK  City " * 60, "en"), ("single", "xx"), ("a b c d. " * 40, "once")]


def talks(spark, rows):
    return spark.createDataFrame([(t, lang, 1, "p", 2, 3) for t, lang in rows], "text string, lang string, f long, phrase string, n long, part int").repartition(3)


@pytest.mark.parametrize("part_rows, kept", [(200_000, 2000), (25, 2000), (3, 10)])
def test_collocations_match_brute_force(spark, part_rows, kept):
    rows = talk()
    got = {tuple(r) for r in collocations.collocations(talks(spark, rows), least=5, kept=kept, part_rows=part_rows).collect()}
    assert got == brute_collocations(rows, 5, kept) and got


def test_runs_chunks_and_cleared_words_count_alike(monkeypatch):
    import pyarrow as pa

    rows = [(t or "", lang or "und") for t, lang in talk()] + [("word " * 500 + "tail", "en")]
    batch = pa.record_batch([pa.array([g for _, g in rows]), pa.array([t.encode() for t, _ in rows], pa.binary())], names=["lang", "text"])
    everything = np.full(collocations.BITS // 8, 255, np.uint8)

    def total(sizes):
        found = Counter()
        for out in collocations._counts(sizes, everything, everything)([batch]):
            for lang, phrase, n in zip(*(out.column(i).to_pylist() for i in range(3))):
                found[lang, phrase] += n
        return found

    whole = [total([1]), total([2]), total([3, 4])]
    for name, value in (("RUN", 5), ("WORDS", 4), ("CHUNK", 11)):
        monkeypatch.setattr(collocations, name, value)
    assert [total([1]), total([2]), total([3, 4])] == whole
    brute = Counter()
    for t, lang in rows:
        for piece in re.split("[.,;:!?\x0a-\x0d]", re.sub("[A-Z]", lambda m: m.group().lower(), t)):
            words = re.findall(r"[^\x20\x09]+", piece)
            brute.update((lang, " ".join(words[i : i + n])) for n in (1, 2, 3, 4) for i in range(len(words) - n + 1))
    assert whole[0] + whole[1] + whole[2] == brute


def test_collocations_of_nothing(spark):
    assert collocations.collocations(talks(spark, [])).count() == 0
    assert collocations.collocations(talks(spark, [("one two", "en")])).count() == 0


def H(*values):
    return hashlib.sha256("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values).encode()).hexdigest()


def join(nodes):
    return hashlib.sha256("".join(nodes).encode()).hexdigest()


def climb(nodes, fanout):
    """The levels of a tree, the leaves first."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([join(levels[-1][i : i + fanout]) for i in range(0, len(levels[-1]), fanout)])
    return levels


def brute_manifest(rows, fanout=2):
    trees = defaultdict(list)
    for d, source, lang, n, text in rows:
        struck = d is not None and zlib.crc32(str(d).encode()) % 7 == 0 and n is not None
        trees[lang].append(((d is not None, d or 0, H(d, source, lang, n, text)), d, H(d, source, lang, n + 1 if struck else n, text)))
    groups = sorted(trees, key=lambda g: (g is not None, (g or "").encode()))
    levels = {g: climb([leaf for (_, _, leaf), _, _ in sorted(trees[g])], fanout) for g in groups}
    over = climb([levels[g][-1][0] for g in groups], fanout)
    out = Counter()
    for at, g in enumerate(groups):
        for i, ((_, _, leaf), d, claim) in enumerate(sorted(trees[g])):
            node, proof = claim, []
            for place, tree in ((i, levels[g]), (at, over)):
                for level in tree[:-1]:
                    run = place - place % fanout
                    left, right = level[run:place], level[place + 1 : run + fanout]
                    proof += left + right
                    node, place = join(left + [node] + right), place // fanout
            out[d, leaf, levels[g][-1][0], over[-1][0], join(proof), node, node == over[-1][0]] += 1
    return out


def papers():
    rng = random.Random(4)
    rows = [(i, rng.choice(["s", None, ""]), rng.choice(["en", "en", "en", "de", None, "", "é"]), rng.choice([None, 5, 0, -3]), rng.choice([None, "", "é" + prose(4), prose(3000)])) for i in range(400)]
    return rows + [(1, "s", "en", 5, "x"), (1, "s", "en", 5, "x"), (None, None, None, None, None), (None, "s", "en", 1, "-"), (9000, "s", "lone", 1, "t")]


def papers_frame(spark, rows):
    return spark.createDataFrame([(*r, "t", 1, 2, "leaf", 3) for r in rows],
                                 "doc_id long, source string, lang string, n_chars long, text string, tree string, idx long, m long, digest string, part int").repartition(5)


@pytest.mark.parametrize("fanout, depth", [(2, 4), (2, 1), (3, 2)])
def test_manifest_matches_brute_force(spark, fanout, depth):
    rows = papers()
    got = Counter(tuple(r) for r in merkle.document_manifest(papers_frame(spark, rows), fanout=fanout, depth=depth).collect())
    assert got == brute_manifest(rows, fanout)
    assert any(not key[-1] for key in got) and any(key[-1] for key in got)


@pytest.mark.parametrize("n", [1, 2, 3, 16, 17, 33])
def test_manifest_of_small_trees(spark, n):
    rows = [(i, "s", "en", i, f"text {i}") for i in range(n)]
    assert Counter(tuple(r) for r in merkle.document_manifest(papers_frame(spark, rows)).collect()) == brute_manifest(rows)


def test_manifest_of_nothing_and_of_the_awkward_table(spark):
    assert merkle.document_manifest(papers_frame(spark, [])).count() == 0
    assert "doc_id" in SCHEMA
    docs = frame(spark)
    got = Counter(tuple(r) for r in merkle.document_manifest(docs).collect())
    assert got == brute_manifest([(r["doc_id"], r["source"], r["lang"], r["n_chars"], r["text"]) for r in docs.collect()])
