"""The pipeline's stages over a small table against brute force, stage by stage."""

import random
from collections import Counter

import corpus_pipeline
from plumbline.llm import decontamination, toxicity
from tests.llm.fixtures import edited, prose
from tests.llm.test_dedup import brute_components, normal, shingles
from tests.llm.test_rows import distance_to_place
from tests.llm.test_tokens import check_packing

BAD = ["zxgrunk", "vwxfoolz", "qyzzdolt"]


def tables():
    rng = random.Random(2)
    docs, labels = [], []
    items = [(k, prose(20)) for k in range(4)]
    for i in range(200):
        text = prose(rng.randint(25, 70))
        if i % 4 == 0:
            words = text.split(" ")
            words[3:3] = [rng.choice(BAD)]
            words[9:9] = [rng.choice(BAD)]
            text = " ".join(words)
        docs.append((i, text))
        labels.append((i, 1, int(i % 4 == 0)))
    base = prose(90)
    docs += [(300, base), (301, base.replace(" ", "\n")), (302, edited(base, 50)), (303, edited(base, 70)), (302, edited(base, 50)), (None, prose(40)), (304, None), (305, "")]
    docs += [(400 + k, prose(20) + " " + text.upper() + " " + prose(9)) for k, text in items]
    docs += [(500, prose(4000)), (501, f"{prose(30)} {items[0][1]}")]
    docs.append(docs[-3])
    return docs, labels, items


def test_every_stage_matches_brute_force(spark, tmp_path):
    docs, labels, items = tables()
    folder = str(tmp_path)
    made = [(d, t, "en", "src0", None if d is None else d, "extra", 1) for d, t in docs]
    spark.createDataFrame(made, "doc_id long, text string, lang string, source string, n_chars long, kept_id string, ROW_hash int").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    now = spark.read.parquet(f"{folder}/documents.parquet")
    columns, rows = now.columns, docs
    model = toxicity.fit(now, toxicity.teaching(spark.read.parquet(f"{folder}/labels.parquet")))
    known = toxicity.Margins(model)

    def acceptable(text):
        margin = known.of_texts([(text or "").encode()])[0]
        return margin * model.slope + model.shift < 0

    def first_copies(found):
        groups = {}
        for d, t in found:
            groups.setdefault(normal(t), []).append((d is None, d or 0, d, t))
        return {(min(g, key=lambda x: x[:2])[2], key) for key, g in groups.items()}

    for name, stage in corpus_pipeline.STAGES:
        after = stage(spark, now, folder)
        after.write.parquet(f"{folder}/{name}")
        after = spark.read.parquet(f"{folder}/{name}")
        if name == "packing":
            used, least = check_packing(rows, after.collect(), 4096)
            assert used <= least + 1
            break
        assert after.columns == columns
        left = [(r["doc_id"], r["text"]) for r in after.collect()]
        if name == "toxicity":
            assert Counter(left) == Counter((d, t) for d, t in rows if acceptable(t))
            assert not any(bad in (t or "") for _, t in left for bad in BAD) and len(left) >= len(docs) - 55
        elif name == "exact_dedup":
            assert {(d, normal(t)) for d, t in left} == first_copies(rows) and len(left) == len(first_copies(rows))
        elif name == "near_dedup":
            kept = {d for d, n, c in brute_components(rows) if d == c}
            assert {d for d, t in left} == kept and len(left) == len(kept)
            assert len({c for _, n, c in brute_components(left) if n}) == sum(1 for _, t in left if shingles(t))
        else:
            def holds(text):
                return any(distance_to_place(p, decontamination.plain(text or "")) <= int(len(p) * 0.05) for p in (decontamination.plain(i) for _, i in items))
            assert Counter(left) == Counter((d, t) for d, t in rows if len(t or "") > 9000 or not holds(t))
        now, rows = after, left


def test_an_empty_corpus(spark, tmp_path):
    folder = str(tmp_path)
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    assert corpus_pipeline.run(spark, folder).count() == 0
