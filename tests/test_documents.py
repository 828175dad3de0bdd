import json

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestone import schema as S
from lodestone.errors import ModelOutputError, ModelSourceError, OptionError, TokenLimitError
from lodestone.operators import embedding as E
from lodestone.operators import semantic
from lodestone.operators.chunking import FileTokenizer, TokenFit, WordTokenizer, chunk_documents, chunk_text, count_tokens, sections
from lodestone.options import ChunkOptions, EmbeddingOptions
from lodestone.sources import records
from lodestone.streaming import ingest

W = WordTokenizer()


def test_a_text_that_fits_is_whole():
    (c,) = chunk_text("# A\none two", W, ChunkOptions(10))
    assert (c.boundary, c.count, c.text, c.token_count, c.char_length) == (S.Boundary.WHOLE_DOCUMENT, 1, "# A\none two", 4, 11)
    assert chunk_text("", W) == []


def test_sections_and_context():
    text = "intro words here\n\n# Guide\nalpha beta gamma delta epsilon zeta eta theta iota kappa\n## Part\nx y"
    chunks = chunk_text(text, W, ChunkOptions(7))
    assert "".join(c.text for c in chunks) == text and all(c.input_tokens <= 7 for c in chunks)
    later = [c for c in chunks if c.context]
    assert later and all(c.context == "Guide\n\n" and c.heading_path == ("Guide",) for c in later)
    assert not any(c.context for c in chunk_text(text, W, ChunkOptions(7, repeat_heading=False)))


def test_fences_hide_headings_and_small_sections_are_packed():
    text = "# A\n```\n# not a heading\n```\nend\n# B\nb\n# C ##\nc " + "w " * 60
    assert [s.path for s in sections(text)] == [("A",), ("B",), ("C",)]
    first = chunk_text(text, W, ChunkOptions(50))[0]
    assert first.boundary == S.Boundary.SECTION and first.heading_path == () and "# B" in first.text


def test_overlap_repeats_tokens():
    chunks = chunk_text(" ".join(f"w{i}" for i in range(40)), W, ChunkOptions(8, 2))
    for a, b in zip(chunks, chunks[1:], strict=False):
        assert 1 <= a.token_start + a.token_count - b.token_start <= 2


def test_too_small_for_special_tokens():
    with pytest.raises(TokenLimitError):
        chunk_text("a b c", WordTokenizer(3), ChunkOptions(3))
    with pytest.raises(OptionError):
        ChunkOptions(8, 8)
    assert TokenFit(1100, 1102, 1024, 4096).fits_model and not TokenFit(1100, 1102, 1024, 4096).fits_chunk and TokenFit(100, 102, 1024, 4096).fits_chunk


@settings(max_examples=80, deadline=None)
@given(st.text(alphabet="ab \n#.`😀é", max_size=300), st.integers(1, 12))
def test_chunks_lose_nothing_and_fit(text, limit):
    chunks = chunk_text(text, W, ChunkOptions(limit))
    assert "".join(c.text for c in chunks) == text
    assert all(c.input_tokens <= limit for c in chunks)
    at = 0
    for i, c in enumerate(chunks):
        assert c.index == i and c.char_start == at
        at += c.char_length
    assert at == len(text.encode("utf-16-le")) // 2


def test_chunks_in_a_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(40)
    rows = chunk_documents(docs, "doc_id", "text", W, ChunkOptions(64)).collect()
    texts = {r.doc_id: r.text for r in docs.collect()}
    for k, t in texts.items():
        own = sorted((r for r in rows if r.key == k), key=lambda r: r.chunk)
        assert "".join(r.text for r in own) == t and all(r.input_tokens <= 64 and r.chunks == len(own) for r in own)
    odd = spark.createDataFrame([(1, None), (2, "a b")], "k int, t string")
    assert [r.key for r in chunk_documents(odd, "k", "t", W).collect()] == [2]
    assert [r[0] for r in odd.orderBy("k").select(count_tokens(WordTokenizer(2), True)("t")).collect()] == [2, 4]


def test_a_vocabulary_file():
    public = pytest.importorskip("public_tokenizers")
    t = FileTokenizer(public.path("byte_bpe_50k.json"))
    text = "Hello, wörld 😀 " * 30
    chunks = chunk_text(text, t, ChunkOptions(16))
    assert "".join(c.text for c in chunks) == text and all(c.input_tokens <= 16 for c in chunks)


def test_pooling():
    out = np.array([[[1.0, 0], [0, 5.0]], [[3.0, 4.0], [9, 9]]])
    mask = np.array([[1, 1], [1, 0]])
    got = E.pool(out, mask)
    assert got[1].tolist() == pytest.approx([0.6, 0.8]) and np.linalg.norm(got[0]) == pytest.approx(1)
    assert E.pool(np.array([3.0, 4.0]), np.ones((1, 2))).tolist() == [pytest.approx([0.6, 0.8])]
    assert E.pool(np.array([[0.0, 2.0]]), np.ones((1, 2))).tolist() == [[0.0, 1.0]]
    for bad in (np.zeros((1, 2)), np.ones((1, 2, 3, 4)), np.ones((2, 3, 4))):
        with pytest.raises(ModelOutputError):
            E.pool(bad, np.ones((1, 2)))
    ids, m = E.padded([[1, 2, 3], [4]], 0)
    assert ids.tolist() == [[1, 2, 3], [4, 0, 0]] and m.tolist() == [[1, 1, 1], [1, 0, 0]]


def test_model_folders(tmp_path):
    with pytest.raises(ModelSourceError):
        E.model_files(tmp_path / "none")
    with pytest.raises(ModelSourceError):
        E.model_files(tmp_path)
    (tmp_path / "m.onnx").write_bytes(b"x")
    (tmp_path / "notes.md").write_bytes(b"left out")
    one = E.model_fingerprint(tmp_path)
    (tmp_path / "notes.md").write_bytes(b"changed")
    assert E.model_fingerprint(tmp_path) == one
    (tmp_path / "tokenizer.json").write_bytes(b"{}")
    assert E.model_fingerprint(tmp_path) != one
    outside = tmp_path.parent / "outside.json"
    outside.write_bytes(b"{}")
    (tmp_path / "link.json").symlink_to(outside)
    with pytest.raises(ModelSourceError):
        E.model_files(tmp_path)


def test_registry_keeps_the_old_model():
    registry = E.ModelRegistry()
    with pytest.raises(ZeroDivisionError):
        registry.update(lambda: 1 / 0)
    assert registry.status == "failed"
    good = registry.update(lambda: E.HashingEmbedder(8))
    with pytest.raises(ModelSourceError):
        registry.update(lambda: E.OnnxEmbedder("/nowhere", 8))
    assert registry.current is good and registry.status == "ready" and registry.last_error


def test_documents_become_records_and_are_found(spark, tmp_path):
    embedder = E.HashingEmbedder(32)
    docs = spark.createDataFrame([("backup", "backup and restore of databases " * 9), ("network", "routers and switches"), ("none", None)], "id string, text string")
    rows = E.embed_documents(docs, "id", "text", embedder, W, ChunkOptions(16), EmbeddingOptions(document_format=int(S.VectorFormat.INT8)))
    assert {r.key for r in rows.collect()} == {"backup", "network"}
    records.write_records(rows, str(tmp_path / "r"))
    back = records.read_records(spark, str(tmp_path / "r"), embedder.fingerprint)
    m = semantic.Chunks("key", "vector", tokens="token_count", capacity="token_capacity", chunk="chunk")
    q = E.embed_query("restore a backup", embedder, W)
    assert semantic.search(m.rows(back), q).first().item == "backup"
    with pytest.raises(TokenLimitError):
        E.embed_query("a b c", embedder, W, EmbeddingOptions(query_max_tokens=2))
    texts = rows.select(records.to_json(records.chunk_record(rows)).alias("j"))
    for r in texts.select("j", records.from_json(F.col("j"), "chunk").alias("r")).collect():
        assert r.r.chunk.headingPath == [] and r.r.vector.format == S.VectorFormat.INT8 and json.loads(r.j)["identity"]["modelId"] == "hashing"
    one = texts.first().j
    more = json.dumps(json.loads(one) | {"extra": {"a": 1}})
    assert spark.createDataFrame([(more,), (None,)], "j string").select(records.from_json(F.col("j"), "chunk").alias("r")).collect()[1].r is None
    for bad, what in ((json.dumps(json.loads(one) | {"schemaVersion": 99}), "version"), (json.dumps({"schemaVersion": 1}), "malformed")):
        with pytest.raises(Exception, match=what):
            spark.createDataFrame([(bad,)], "j string").select(records.from_json(F.col("j"), "chunk")).collect()
    assert records.capabilities(spark)["exact"]


def test_streams(spark, tmp_path, sf):
    docs = spark.createDataFrame([(i, f"word{i} and more") for i in range(6)], "id long, text string")
    docs.write.parquet(str(tmp_path / "in"))
    arriving = ingest.read_documents(spark, str(tmp_path / "in"), "id long, text string")
    embedder = E.HashingEmbedder(16)
    ingest.ingest(arriving, "id", "text", embedder, W, str(tmp_path / "out"), str(tmp_path / "c1")).awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 6
    seen = []
    ingest.search_batches(arriving, lambda b: b.where("id > 3"), lambda b, n: seen.append(b.count()), str(tmp_path / "c2")).awaitTermination(120)
    assert sum(seen) == 2
    events = spark.read.parquet(f"{sf}/events.parquet")
    stream = spark.readStream.schema(events.schema).parquet(f"{sf}/events.parquet*")
    assert ingest.event_windows(stream, "ts").isStreaming
