import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from strandwise.llm import kneser_ney as kn


def tokens(t):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in (t or ""))
    return [*re.findall(r"[^\x20\x09-\x0D]+", low), " END"]


class Brute:
    def __init__(self, texts):
        self.uni = Counter(w for t in texts for w in t)
        self.bi = Counter((a, b) for t in texts for a, b in zip([" BEGIN", *t[:-1]], t, strict=True))
        self.seen = Counter(b for _, b in self.bi)
        self.ctx, self.rows = Counter(), defaultdict(lambda: [0, 0, 0, 0])
        for (a, _), c in self.bi.items():
            self.ctx[a] += c
            self.rows[a][min(c, 3)] += 1
        of = lambda cs: [sum(c == k for c in cs) for k in (1, 2, 3, 4)]
        self.d2, t1 = kn.discounts(of(self.bi.values())), of(self.seen.values())
        self.d1 = kn.discounts(t1)
        self.n, self.v = sum(self.uni.values()), len(self.uni)
        self.spare = (self.d1[1] * t1[0] + self.d1[2] * t1[1] + self.d1[3] * sum(c > 2 for c in self.seen.values())) / len(self.bi)

    def q(self, w):
        c = self.seen.get(w, 0)
        return (c - self.d1[min(c, 3)]) / len(self.bi) + self.spare / (self.v + 1)

    def p(self, u, w):
        if not self.ctx.get(u):
            return self.q(w)
        c = self.bi.get((u, w), 0)
        return (c - self.d2[min(c, 3)]) / self.ctx[u] + sum(self.d2[k] * self.rows[u][k] for k in (1, 2, 3)) / self.ctx[u] * self.q(w)


@pytest.mark.parametrize("file", [300, 2_000_000])  # with the first, frequent words are split over buckets
def test_against_brute_force(docs, rows, monkeypatch, file):
    monkeypatch.setattr(kn, "FILE", file)
    train = [tokens(t) for i, t, *_ in rows if i is None or zlib.crc32(str(i).encode()) % 7 != 2]
    m = Brute(train)
    got = Counter((r["doc_id"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 4), round(r["score"], 4)) for r in kn.held_out_scores(docs).collect())
    want = Counter()
    for i, t, *_ in rows:
        w = tokens(t)
        base = sum(math.log10((m.uni.get(x, 0) + 1) / (m.n + m.v + 1)) for x in w)
        score = sum(math.log10(m.p(a, b)) for a, b in zip([" BEGIN", *w[:-1]], w, strict=True))
        want[i, len(w), sum(x in m.uni for x in w), m.n, round(base, 4), round(score, 4)] += 1
    assert got == want
    for u in list(m.ctx)[:5] + ["never seen"]:
        assert abs(sum(m.p(u, w) for w in m.uni) + m.p(u, "never seen") - 1) < 1e-9


def test_without_training_rows(empty, docs):
    uri, meta = kn.train(empty.select("text"))
    assert {(r["base_score"], r["score"], r["n_known"]) for r in kn.score_documents(docs, uri, meta).collect()} == {(0.0, 0.0, 0)}
    assert kn.held_out_scores(empty).count() == 0


def test_packing():
    a = np.unique(np.random.default_rng(0).integers(0, 1 << 63, 1000).astype(np.uint64))
    assert (kn._unpack_sorted(kn._pack_sorted(a), np.uint64) == a).all()
    assert (kn._unpack(kn._pack(a), np.uint64) == a).all()


def test_buckets_hold_about_as_many_tokens_each():
    counts = np.array([5, 900, 3, 4, 80, 30, 2500, 1, 1])
    edges = kn.bucket_edges(counts, 10, 1000, 100)
    assert edges == sorted(set(edges)) and edges[0] == 10 << 32
    first = [e >> 32 for e in edges]
    assert first.count(11) == 9 and first.count(16) == 25
    rest = [c for c in range(10, 19) if c not in (11, 16)]
    held = {}
    for c in rest:
        held.setdefault(max(k for k, e in enumerate(edges) if e <= c << 32), []).append(counts[c - 10])
    assert all(sum(x) <= 200 for x in held.values())


def test_few_maps_are_held(tmp_path, monkeypatch):
    monkeypatch.setattr(kn, "OPEN", 3)
    store = kn.Store(f"file://{tmp_path}")
    for k in range(9):
        store.put(f"a/{k}", np.arange(k + 1))
    for _ in range(2):
        assert [int(store.get(f"a/{k}", np.int64)[-1]) for k in range(9)] == list(range(9))
    assert len(store.mapped) == 3
