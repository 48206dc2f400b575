import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from strandwise.llm.mixing import mix, mixed_documents, source_targets
from strandwise.llm.sharding import Outline, minimax_cuts, shard_documents


def best_capacity(sizes, shards):
    """Least largest part over all contiguous partitions, by dynamic programming."""
    n = len(sizes)
    pre = [0]
    for s in sizes:
        pre.append(pre[-1] + s)
    best = [0] + [float("inf")] * n
    for _ in range(shards):
        best = [0] + [min(max(best[j], pre[i] - pre[j]) for j in range(i)) for i in range(1, n + 1)]
    return best[n]


def outlined(begins, k):
    """Stretches of 2^k bytes over a list of begins."""
    out = {}
    for b in begins:
        out.setdefault(b >> k, []).append(b)
    return [(x[0], x[-1], k) for x in out.values()]


CASES = [([5, 1, 1, 1, 9, 2, 2], 3), ([10], 4), ([1] * 17, 5), ([100, 1, 1, 1, 1, 100, 3], 4), ([7, 7, 7], 3)]
CASES += [(random.Random(k).choices([1, 3, 8, 50, 400], k=5 + 7 * k), 2 + k % 7) for k in range(25)]


@pytest.mark.parametrize("sizes,shards", CASES)
@pytest.mark.parametrize("k", [0, 3, 6, 20])
def test_minimax_is_the_least_capacity(sizes, shards, k):
    begins = [sum(sizes[:k]) for k in range(len(sizes))]
    asked = []

    def finer(todo):
        asked.append(len(todo))
        return [x for a, b, c in todo for x in outlined([y for y in begins if a <= y <= b], max(0, c - 1))]

    cuts = minimax_cuts(Outline(outlined(begins, k), sum(sizes)), shards, finer)
    assert set(cuts) <= set(begins) and len(cuts) < shards
    assert max(b - a for a, b in zip([0, *cuts], [*cuts, sum(sizes)], strict=True)) == best_capacity(sizes, shards)
    assert k or not asked


@pytest.mark.parametrize("runs", [8, 1 << 16])
def test_shards(docs, rows, empty, runs):
    got = shard_documents(docs, 6, runs=runs).collect()
    assert len(got) == len(rows)
    text = {(i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t, *_ in rows}
    assert {(r["doc_id"], r["size"], r["text_crc32"]) for r in got} == text
    slots, groups, load = defaultdict(list), defaultdict(set), Counter()
    for r in got:
        slots[r["shard"]].append(r["slot"])
        groups[r["text_crc32"], r["size"]].add(r["shard"])
        load[r["shard"]] += r["size"]
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert all(len(v) == 1 for v in groups.values())  # equal texts stay together
    sizes, last = [], None
    for r in sorted(got, key=lambda r: (r["shard"], r["slot"])):  # the order of the groups
        this = r["text_crc32"], r["size"]
        sizes = [*sizes, r["size"]] if this != last else [*sizes[:-1], sizes[-1] + r["size"]]
        last = this
    assert len(sizes) == len(groups) and max(load.values()) == best_capacity(sizes, 6)
    assert shard_documents(empty, 6).count() == 0


def test_shards_of_one_text(spark):
    df = spark.createDataFrame([(None if k % 2 else 1, "same") for k in range(500)], "doc_id long, text string").repartition(5)
    got = shard_documents(df, 3).collect()
    assert sorted(r["slot"] for r in got) == list(range(500)) and {r["shard"] for r in got} == {0}


def fill(sizes, weights, budget, limit=2.0):
    """Water filling as described: share out, cap, share the excess again."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    capped, left = {}, dict.fromkeys(names)
    while True:
        rest = budget - sum(capped.values())
        total = sum(w[s] for s in left)
        over = [s for s in left if rest * w[s] / total > limit * sizes[s] + 1e-9]
        if not over:
            return capped | {s: rest * w[s] / total for s in left}
        for s in over:
            capped[s] = limit * sizes[s]
            del left[s]
        if not left:
            return capped


def test_targets_by_rounds(spark):
    for sizes in ({"a": 10, "b": 500, "c": 3, None: 90}, {"x": 5}, {f"s{k:02d}": (k * 37) % 91 + 1 for k in range(40)}, {"a": 0, "b": 0}):
        df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
        got = {r["source"]: r["target"] for r in source_targets(df).collect()}
        assert got == pytest.approx(fill(sizes, (5, 2, 1), 1.5 * sum(sizes.values())))


def test_mix(docs, rows, empty):
    got = mix(docs).collect()
    sizes = Counter()
    for _, t, _, s, _ in rows:
        sizes[s] += len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    want = fill(sizes, (5, 2, 1), 1.5 * sum(sizes.values()))
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(want[r["source"]])
        rate = r["target"] / r["source_size"] if r["source_size"] else 0
        assert r["copies"] in (int(rate), int(rate) + (rate > int(rate)))
    again = {(r["doc_id"], r["copies"]) for r in mix(docs.repartition(5)).collect()}
    assert again == {(r["doc_id"], r["copies"]) for r in got}
    whole = mixed_documents(docs)
    assert whole.columns == docs.columns
    assert Counter(r["doc_id"] for r in whole.select("doc_id").collect()) == Counter({k: v for k, v in sum((Counter({r["doc_id"]: r["copies"]}) for r in got), Counter()).items() if v})
    assert mix(empty).count() == 0 and mixed_documents(empty).count() == 0


def brute_copies(rows, sizes, want):
    """Copies of each (id, source, text), as a multiset, by the coins of a plain loop."""
    import hashlib

    seen, out = Counter(), Counter()
    for i, t, _, s, _ in rows:
        k = seen[i, s, t or ""]
        seen[i, s, t or ""] += 1
        digest = hashlib.md5((t or "").encode()).hexdigest()
        coin = int(hashlib.md5(f"20240531:{'' if i is None else i}:{digest}:{k}".encode()).hexdigest()[:8], 16) / 2**32
        rate = want[s] / sizes[s] if sizes[s] else 0
        out[i, s, len(re.findall(r"[^\x20\x09-\x0D]+", t or "")), int(rate) + (coin < rate - int(rate))] += 1
    return out


def test_coins_against_brute_force(spark, docs, rows):
    odd = rows + [(7, "six words that are all equal", "en", "d", 0)] * 40 + [(None, "no id here", "en", "d", 0)] * 40
    sizes = Counter()
    for _, t, _, s, _ in odd:
        sizes[s] += len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    want = fill(sizes, (5, 2, 1), 1.5 * sum(sizes.values()))
    df = spark.createDataFrame(odd, docs.select("doc_id", "text", "lang", "source", "n_chars").schema).repartition(4)
    got = Counter((r["doc_id"], r["source"], r["size"], r["copies"]) for r in mix(df).collect())
    assert got == brute_copies(odd, sizes, want)


def test_taken_words_come_near_the_target(spark):
    rows = [(k, "w " * (1 + k * 7919 % 97), "en", f"s{k % 3}", 0) for k in range(3000)] + [(5, "w " * 20, "en", "same id", 0)] * 600
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    totals, spread = defaultdict(float), defaultdict(float)
    for r in mix(df).collect():
        f = r["target"] / r["source_size"] % 1
        totals[r["source"], r["target"]] += r["size"] * r["copies"]
        spread[r["source"], r["target"]] += r["size"] ** 2 * f * (1 - f)
    assert len(totals) == 4
    for (name, target), t in totals.items():
        assert abs(t - target) <= 4 * spread[name, target] ** 0.5 + 1e-6  # independent draws with the target as their mean
