import hashlib
from collections import Counter

import pytest

pytest.importorskip("public_tokenizers")
import sentencepiece  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

import corpus_pipeline as cp  # noqa: E402
from strandwise.llm.queries import ORACLES, QUERIES, tokenizer  # noqa: E402

from .test_sharding_mixing import fill  # noqa: E402
from .test_simhash import brute_components, brute_print  # noqa: E402


def test_run_against_stage_by_stage_checks(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names = docs.columns
    frames = [docs]
    for _, stage in cp.STAGES[:-1]:
        out = stage(spark, frames[-1], sf)
        assert out.columns == names
        frames.append(out.persist())
    ids = [Counter(r["doc_id"] for r in f.select("doc_id").collect()) for f in frames]
    assert all(set(b) <= set(a) for a, b in zip(ids, ids[1:], strict=False))
    # Near copies: exactly the smallest id of each brute-force component.
    before = sorted((r["doc_id"], r["text"]) for r in frames[2].select("doc_id", "text").collect())
    comp = brute_components([brute_print(t) for _, t in before])
    assert set(ids[3]) == {before[c][0] for c in comp}
    # The mix: each source's rate gives floor(rate) or one more copy.
    kept = frames[3].withColumn("n", F.size(F.regexp_extract_all("text", F.lit(r"([^\x20\x09-\x0D]+)")))).collect()
    sizes = Counter()
    for r in kept:
        sizes[r["source"]] += r["n"]
    want = fill(sizes, (5, 2, 1), 1.5 * sum(sizes.values()))
    for r in kept:
        rate = want[r["source"]] / sizes[r["source"]]
        assert ids[4][r["doc_id"]] in (int(rate + 1e-9), int(rate + 1e-9) + 1)
    # Tokens as the library gives them, for every copy.
    library = sentencepiece.SentencePieceProcessor(model_file=tokenizer("piece_bpe_32k.model"))
    expected = Counter()
    for r in frames[4].select("doc_id", "text").collect():
        i = library.encode(r["text"] or "")
        expected[r["doc_id"], len(i), hashlib.sha256(",".join(map(str, i)).encode()).hexdigest()] += 1
    got = Counter((r["doc_id"], r["n_tokens"], r["ids_sha256"]) for r in cp.run(spark, sf).collect())
    assert got == expected


def test_stages_take_odd_rows(spark, docs, rows, sf):
    frame = docs
    for _, stage in cp.STAGES:
        frame = stage(spark, frame, sf)
    assert frame.count() > 0


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql(spark, sf, name):
    duckdb = pytest.importorskip("duckdb")
    import os

    import pandas as pd

    db = duckdb.connect()
    for f in os.listdir(sf):
        db.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{sf}/{f}'")
    got, want = QUERIES[name](spark, sf).toPandas(), db.sql(ORACLES[name]).df()
    cols = sorted(want.columns)
    order = lambda x: x[cols].sort_values(cols).reset_index(drop=True)
    pd.testing.assert_frame_equal(order(got), order(want), check_dtype=False)


def test_shared_files_can_be_removed(spark):
    from strandwise.llm.common import clear_shared, cut

    df = cut(spark.range(3))
    assert df.count() == 3
    clear_shared(spark)
    with pytest.raises(Exception):  # noqa: B017
        df.count()


def test_registered():
    assert [n for n in range(1, 11) if not any(q.startswith(f"op{n}_") for q in QUERIES)] == []
    assert set(ORACLES) <= set(QUERIES)
    assert [n for n, _ in cp.STAGES] == ["toxicity", "quality_rules", "simhash_near_dedup", "mixing", "sentencepiece"]
