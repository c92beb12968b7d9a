import random
from collections import Counter, defaultdict
from fractions import Fraction

import pytest

from pagewright.llm import mixing


def key(source):
    return "" if source is None else "=" + source


def brute(weights, blocks):
    """{(source, block): slot} and the first slot a source misses a block for: each slot looks at every source anew."""
    total, place, taken, left, horizon, now = sum(weights.values()), {}, Counter(), dict(blocks), None, 0
    share = {s: Fraction(w, total) for s, w in weights.items()}
    gone = {s for s in weights if not blocks.get(s)}
    while any(left.values()):
        due = sorted((-(-(taken[s] + 1) // share[s]), s) for s in weights if s not in gone and taken[s] // share[s] <= now)
        while due:
            _, s = due.pop(0)
            if taken[s] == blocks[s]:
                gone.add(s)
                horizon = now if horizon is None else horizon
                continue
            place[s, taken[s]] = now
            taken[s], left[s] = taken[s] + 1, left[s] - 1
            break
        now += 1
    return place, horizon


SHARES = {"half": {"hot": 19 * 97, **{f"s{i}": 97 for i in range(19)}}, "tiny": {"hot": 10 ** 6, "b": 7 * 10 ** 5, **{f"t{i:03}": 1 for i in range(500)}},
          "many": {f"m{i:05}": 3 + i % 7 for i in range(6_000)}, "one": {"a": 1}, "odd": {c: 7 ** i + 1 for i, c in enumerate("abcdefg")}}


@pytest.mark.parametrize("name", sorted(SHARES))
def test_every_slot_is_within_one_block_of_the_target(name):
    """Against the weights asked for, over 30 times as many slots as the most that whole slots of 4,096 would tell apart."""
    weights, slots = SHARES[name], 30 * 4_096
    total = sum(weights.values())
    counts, checked = Counter(), sorted(weights, key=lambda s: (-weights[s], s))
    checked = checked[:25] + checked[-25:]
    for now, (s, j, release, deadline, slot, mixed) in enumerate(mixing.pfair([(s, w, 10 ** 9) for s, w in weights.items()])):
        assert slot == now and mixed and j == counts[s] and release <= now < deadline
        counts[s] += 1
        for x in checked + [s]:
            assert abs(counts[x] * total - weights[x] * (now + 1)) < total
        if now + 1 == slots:
            break
    assert sum(counts.values()) == slots


@pytest.mark.parametrize("seed", range(5))
def test_schedule_equals_brute_force(seed):
    rng = random.Random(seed)
    weights = {c: rng.choice([1, 2, 5, 40]) for c in "abcdefgh"[:rng.randint(1, 8)]}
    blocks = {c: rng.choice([0, 1, 3, 20]) for c in weights}
    got = list(mixing.pfair([(s, weights[s], n) for s, n in blocks.items()], sum(weights.values()) + 3 * (seed == 4)))
    want, horizon = brute(weights | ({"absent": 3} if seed == 4 else {}), blocks)
    assert {(s, j): slot for s, j, _, _, slot, _ in got} == want and len(got) == sum(blocks.values())
    if all(blocks.values()):
        assert all(mixed == (horizon is None or slot < horizon) for *_, slot, mixed in got)


def test_whole_weights():
    assert mixing.whole_weights({"a": 3, "b": 1, "c": 0, "d": -1}) == {"a": 3, "b": 1}
    got = mixing.whole_weights({"a": 0.1, "b": 0.25, "c": 1e-9})
    assert Fraction(got["a"], got["b"]) == Fraction(0.1) / Fraction(0.25) and Fraction(got["c"], got["b"]) == Fraction(1e-9) * 4
    assert mixing.whole_weights({}) == {}


def test_target_weights():
    got = mixing.target_weights({"hot": 60, **{c: 5 for c in "abcdefgh"}}, 0.25)
    assert got["hot"] == 0.25 and abs(sum(got.values()) - 1) < 1e-9 and len({round(got[c], 9) for c in "abcdefgh"}) == 1
    assert mixing.target_weights({"a": 9, "b": 1}, 0.25) == {"a": 0.9, "b": 0.1}  # too few sources to hold any
    assert mixing.target_weights({}) == {} and mixing.target_weights({"a": 0}) == {}


SCHEMA = "doc_id long, text string, source string, slot int, _s int, block string"


def frame(spark, rows):
    return spark.createDataFrame([(d, t, s, 1, 2, "b") for d, t, s in rows], SCHEMA).repartition(3)


def test_whole_mix(spark):
    rng = random.Random(4)
    rows = [(i, "x" * rng.choice([0, 10, 50, 400]), rng.choice(["hot"] * 6 + list("abcde") + [None])) for i in range(600)]
    rows += [(5, "again", "a"), (5, "again", "a"), (None, "no id", "b"), (700, None, "c"), (701, "y" * 5_000, "d")]
    got = mixing.mix(frame(spark, rows), block_bytes=300).collect()
    assert sorted(repr((r["doc_id"], r["source"])) for r in got) == sorted(repr((d, s)) for d, _, s in rows)
    place = defaultdict(set)
    for r in got:
        assert r["release"] <= r["slot"] < r["deadline"] and r["in_mix"]
        place[r["slot"]].add((r["source"], r["block"]))
    assert all(len(v) == 1 for v in place.values())
    # blocks follow the bytes: the first byte of a document decides
    sizes = Counter()
    for s in {x[2] for x in rows}:
        blocks = sorted(r["block"] for r in got if r["source"] == s)
        sizes[s] = sum(len(t or "") for _, t, x in rows if x == s)
        assert blocks[0] == 0 and blocks[-1] <= sizes[s] // 300
    # each source is within one block of its share until it runs out
    total, last = sum(sizes.values()), max(r["slot"] for r in got)
    for s, n in sizes.items():
        slots = {r["block"]: r["slot"] for r in got if r["source"] == s}
        for b, slot in slots.items():
            assert b <= slot * n / total + 1 and (b + 1) > (slot + 1) * n / total - 1
    assert last + 1 == sum(max(-(-n // 300), 1 + max(r["block"] for r in got if r["source"] == s)) for s, n in sizes.items())


def test_given_weights_and_edges(spark):
    rows = [(i, "z" * 100, "ab"[i % 2]) for i in range(40)] + [(99, "q", "other")]
    got = mixing.mix(frame(spark, rows), weights={"a": 3, "b": 1}, block_bytes=100).collect()
    want, horizon = brute({"=a": 3, "=b": 1}, {"=a": 20, "=b": 20})
    assert all(r["slot"] == want[key(r["source"]), r["block"]] for r in got if r["source"] != "other")
    assert all(r["in_mix"] == (r["slot"] < horizon) for r in got if r["source"] != "other")
    assert Counter(r["source"] for r in got if r["in_mix"])["a"] == 20
    [other] = [r for r in got if r["source"] == "other"]
    assert other["slot"] is None and other["in_mix"] is False
    assert mixing.mix(frame(spark, rows).limit(0)).count() == 0
    assert mixing.in_mix(frame(spark, rows)).columns == frame(spark, rows).columns


@pytest.mark.parametrize("sources", [
    {**{c: 9_000 for c in "abcdefgh"}, "tiny": 10}, {**{c: 9_000 for c in "abcdefgh"}, "empty": 0, None: 0},
    {"a": 20_000, "b": 20_000, "c": 20_000, "tiny": 10}, {"hot": 40_000, **{c: 8_000 for c in "abcdefgh"}},
    {"hot": 9_000, **{f"s{i}": 30 for i in range(300)}}])
def test_no_source_that_runs_out_ends_the_mix(spark, sources):
    """Kept bytes of every source are all its bytes, and each slot is what brute force over the bytes gives."""
    rows, size = [], 100
    for s, n in sources.items():
        rows += [(len(rows) + i, "w" * min(n, 50), s) for i in range(max(1, n // 50))]
    got = mixing.mix(frame(spark, rows), block_bytes=size).collect()
    found = Counter()
    for _, t, s in rows:
        found[key(s)] += len(t)
    order, _ = brute({s: max(1, n) for s, n in found.items()}, {s: max(1, -(-n // size)) for s, n in found.items()})
    assert all(r["in_mix"] and order[key(r["source"]), r["block"]] == r["slot"] for r in got) and len(got) == len(rows)
    assert len(mixing.in_mix(frame(spark, rows), block_bytes=size).collect()) == len(rows)


def test_given_weight_of_an_absent_source_ends_nothing(spark):
    rows = [(i, "z" * 100, "ab"[i % 2]) for i in range(40)] + [(90, "", "empty")]
    got = mixing.mix(frame(spark, rows), weights={"a": 1, "b": 1, "empty": 1, "gone": 1}, block_bytes=100)
    assert sum(r["in_mix"] for r in got.collect()) >= 40


def test_default_target_is_the_shares_as_found():
    sizes = {"hot": 60, **{c: 5 for c in "abcdefgh"}}
    assert mixing.target_weights(sizes) == {s: n / 100 for s, n in sizes.items()}


def test_stage_gives_all_rows_in_slot_order(spark):
    rows = [(i, f"{i} " * 20, "hot" if i % 3 == 0 else "abcdefgh"[i % 8]) for i in range(300)]
    rows += [(None, "first without id", "a"), (None, "second without id", "b"), (7, "other text", "c"), (8, "", None)]
    docs, options = frame(spark, rows), {"block_bytes": 100}
    got = [(r["doc_id"], r["text"], r["source"]) for r in mixing.in_mix(docs, **options).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, rows))
    slot = defaultdict(set)
    for r in mixing.mix(docs, **options).collect():
        slot[r["doc_id"], r["source"]].add(r["slot"])
    once = [min(slot[d, s]) for d, _, s in got if len(slot[d, s]) == 1]
    assert once == sorted(once) and len(once) >= 300


def test_rows_without_id_are_judged_one_by_one(spark):
    rows = [(None, "z" * 100 + str(i), "ab"[i % 2]) for i in range(40)] + [(None, "no weight", "other")]
    options = {"weights": {"a": 3, "b": 1}, "block_bytes": 100}
    got = [r["source"] for r in mixing.in_mix(frame(spark, rows), **options).collect()]
    mixed = Counter(r["source"] for r in mixing.mix(frame(spark, rows), **options).collect() if r["in_mix"])
    assert Counter(got) == mixed and "other" not in got
