import corpus_pipeline
import pytest

from netsift.llm import bpe, quality, suffix_dedup
from tests.conftest import SF0001
from tests.llm import helpers as H
from tests.llm.test_operators import brute_hits


def test_pipeline_equals_brute_force(spark):
    """Each stage on what its predecessor kept, against plain restatements, over all of sf0.001."""
    import zstandard
    from tokenizers import Tokenizer
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF0001}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF0001}/benchmark.parquet").collect()]
    z, bands = zstandard.ZstdCompressor(level=3), quality.CompressionBands()
    docs = [(d, t) for d, t in docs if quality.judge(t, bands, z)[-1]]
    docs = [(d, t) for (d, t), (_, n, c) in zip(docs, H.brute_components(docs)) if d == c]
    docs = sorted(docs)
    least, cut = {}, []
    for d, t in docs:
        raw, gone = t.encode(), bytearray(len(t.encode()))
        for i in range(len(raw) - suffix_dedup.DEPTH + 1):
            if least.setdefault(raw[i:i + 50], d) < d:
                gone[i:i + 50] = b"\1" * 50
        left = bytes(b for b, g in zip(raw, gone) if not g).decode("utf-8", "ignore")
        if left.strip(" "):
            cut.append((d, left))
    clean = [row for row, hit in zip(cut, brute_hits(cut, items)) if not hit[-1]]
    library = Tokenizer.from_file(bpe.default_path())
    want = {d: library.encode(t, add_special_tokens=False).ids for d, t in clean}
    got = {r.doc_id: r.ids for r in corpus_pipeline.run(spark, SF0001).collect()}
    assert got == want


@pytest.mark.parametrize("rows", [[], H.EDGES], ids=["empty", "edges"])
def test_stages_on_odd_rows(spark, tmp_path, rows):
    spark.createDataFrame([(1, H.sentence(2)), (2, None)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = H.docs(spark, rows, H.PLAIN)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        assert out.count() <= len(rows)
        if name != "tokens":
            assert out.columns == docs.columns


def test_entry_registers_the_queries():
    import __spark_entry__ as entry
    names = set(entry.queries())
    assert "pipeline" in names and {int(n[2:].split("_")[0]) for n in names if n.startswith("op") and n[2].isdigit()} == set(range(1, 14))
    assert set(entry.oracle_sql()) <= names
