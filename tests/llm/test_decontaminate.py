import math
import random
from collections import Counter

import pytest

from pagewright.llm import decontaminate as D


def brute(docs, items, threshold=0.5, min_overlap=0.5, min_words=5):
    """BM25 of every passage against every text of every item, without an index."""
    items = sorted({(i, t) for i, t in items if i is not None and t is not None and D.words_of(t)})
    words = [D.words_of(t) for _, t in items]
    if not words:
        return []
    df = Counter(t for w in words for t in set(w))
    mean = sum(map(len, words)) / len(words)
    weights = []
    for w in words:
        raw = {t: math.log(1 + (len(words) - df[t] + 0.5) / (df[t] + 0.5)) * n * 2.2 / (n + 1.2 * (0.25 + 0.75 * len(w) / mean))
               for t, n in Counter(w).items()}
        weights.append({t: x / sum(raw.values()) for t, x in raw.items()})
    stride = max(64, *map(len, words))
    best = {}
    for d, t in docs:
        w = D.words_of(t or "")
        for j in range(max(1, -(-len(w) // stride) - 1)):
            passage = w[j * stride:(j + 2) * stride]
            own = set(passage)
            for (i, text), own_words, weight in zip(items, words, weights):
                score = sum(x for t, x in weight.items() if t in own)
                if len(own_words) < min_words and b" %s " % b" ".join(own_words) not in b" %s " % b" ".join(passage):
                    continue
                q, a = (D.overlap(p, passage) for p in D.question_and_answer(text))
                if score >= threshold - 1e-9 and q >= min_overlap and a >= min_overlap:
                    best[d, i] = max(best.get((d, i), (0,)), (score, q, a))
    return sorted((repr(k), tuple(round(x, 6) for x in v)) for k, v in best.items())


def found(df):
    return sorted((repr((r["doc_id"], r["item_id"])), (round(r["score"], 6), round(r["question_overlap"], 6), round(r["answer_overlap"], 6)))
                  for r in df.collect())


def frames(spark, docs, items):
    return (spark.createDataFrame([(d, t, 1, "s") for d, t in docs], "doc_id long, text string, item_id int, shard string").repartition(3),
            spark.createDataFrame([(i, t, 1.0) for i, t in items], "item_id long, text string, weight double"))


@pytest.mark.parametrize("seed,shard", [(1, 3_000), (2, 7)])
def test_equals_brute_force(spark, monkeypatch, seed, shard):
    monkeypatch.setattr(D, "SHARD_ITEMS", shard)
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)]
    common = ["the", "of", "and"]
    sentence = lambda n: " ".join(rng.choice(common) if rng.random() < 0.3 else rng.choice(vocabulary) for _ in range(n)).capitalize()
    items = [(i, f"{sentence(rng.randint(6, 30))}{rng.choice('?.')} {sentence(rng.randint(1, 9))}.") for i in range(25)]
    items += [(3, "other text of one id, seen before it"), (50, None), (None, "an item without an id at all"), (51, ""), (52, "too short"),
              (53, "no sentence end here just a row of plain words"), (54, items[0][1])]
    docs = []
    for d in range(60):
        parts = [sentence(rng.randint(0, 150))]
        if rng.random() < 0.5:
            w = rng.choice(items[:25])[1].split()
            keep = rng.choice([1.0, 1.0, 0.8, 0.6, 0.4])
            parts.insert(rng.randint(0, 1), " ".join(x if rng.random() < keep else "zzz" for x in w))
        docs.append((d, ". ".join(parts)))
    docs += [(90, None), (91, ""), (92, " \n"), (5, items[2][1]), (None, items[4][1]), (93, (sentence(5_000) + " " + items[6][1] + " ") * 3)]
    docs += [(94, "this text is too short to tell"), (95, "short too this"), (96, "seen before: Other text of one id, seen before it!")]
    got = found(D.contaminated(*frames(spark, docs, items)))
    assert got == brute(docs, items) and len(got) > 15
    pairs = [k for k, _ in got]
    assert "(94, 52)" in pairs and "(95, 52)" not in pairs and "(96, 3)" in pairs


def test_empty_tables_and_stage(spark):
    docs, items = [(1, "nothing to see in this text"), (2, "Where does the old river end? In the wide sea."), (None, "x")], [
        (1, "Where does the old river end? In the wide sea.")]
    d, i = frames(spark, docs, items)
    assert D.contaminated(d, i.limit(0)).count() == 0 and D.contaminated(d.limit(0), i).count() == 0
    kept = D.without_leaks(d, i)
    assert sorted(map(repr, (r["doc_id"] for r in kept.collect()))) == ["1", "None"] and kept.columns == d.columns


def test_index_skips_blocks():
    items = {i: " ".join(f"t{i}x{j}" for j in range(20)) for i in range(64)}
    postings = [(i, t, 1 / 20) for i, text in items.items() for t in text.split()]
    shard = D.Shard.build(postings, items, 0.5)
    scored = []
    shard.weights = [type("Seen", (dict,), {"items": lambda self, n=n: (scored.append(n), dict.items(self))[1]})(w)
                     for n, w in enumerate(shard.weights)]
    hits = list(shard.search([items[9].split() + ["noise"] * 50], 64, 0.5))
    assert [int(h[1]) for h in hits] == [9] and set(scored) == {9}


def test_on_the_given_table(spark, sf):
    docs, items = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "benchmark"))
    rows = lambda df, k: [(r[k], r["text"]) for r in df.collect()]
    assert found(D.contaminated(docs, items)) == brute(rows(docs, "doc_id"), rows(items, "item_id"))


def test_leaks_take_no_clean_row_of_their_id(spark):
    leak, items = "Where does the old river end? In the wide sea.", [(1, "Where does the old river end? In the wide sea.")]
    d, i = frames(spark, [(None, leak), (None, "clean one"), (None, "clean two"), (4, leak), (4, "clean three")], items)
    assert sorted(r["text"] for r in D.without_leaks(d, i).collect()) == ["clean one", "clean three", "clean two"]
