import hashlib
import random
import re
from collections import Counter

import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from factpanel.llm import pieces, queries

MODEL = sentencepiece.SentencePieceProcessor(model_file=pieces.default_model())
TABLE = pieces.ChunkTable(pieces.default_model(), max_chunks=50)
TABLE.entries = {c: TABLE.segment(c) for c in ("", "a", "word", "ing", " word")}
TEXTS = st.text(st.characters(exclude_categories=["Cs"]) | st.sampled_from(list(" \n\t▁abé<s>")), max_size=60) | st.lists(
    st.sampled_from([" ", "  ", "   ", "▁", "word", "ing", "\n", "é", "<0x41>", "</s>", "😀", "漢"]), max_size=25
).map("".join)


@settings(max_examples=2000, deadline=None)
@given(TEXTS)
def test_chunks_encode_and_decode_as_the_library(text):
    ids = MODEL.encode(text)
    assert TABLE.encode(text) == ids
    assert "".join(x[2] for x in TABLE.lookup(text))[1:] == MODEL.decode(ids)


def expected(text):
    ids = MODEL.encode(text or "")
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return len(ids), sha(",".join(map(str, ids))), sha(MODEL.decode(ids))


def test_query_against_the_library(spark, data):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    rows = queries.op7_sentencepiece(spark, data).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == expected(texts[r["doc_id"]])


def test_each_distinct_chunk_is_in_the_table_once(spark):
    rng = random.Random(1)
    texts = [" ".join(rng.choice(["aa", "bb", "", "c▁d", "x" * 70, f"n{rng.randrange(400)}"]) for _ in range(60)) for _ in range(200)]
    docs = spark.createDataFrame([(t,) for t in [*texts, None, "", "aa aa"]], "text string").repartition(5)
    want = Counter(c for t in [*texts, "aa aa"] for c in re.findall(" +[^ ]*", " " + t.replace("▁", " ")) if t)
    for most in (3, 10**6):
        got = {r["chunk"]: r["n"] for r in pieces.distinct_chunks(docs, max_chunks=most).collect()}
        assert got == {c[1:]: n for c, n in want.items() if len(c) <= 65}
    for most in (0, 7, 100, 10**6):
        rows = pieces.chunk_table(docs, "text", pieces.default_model(), most).collect()
        least = min((n for n in set(got.values()) if n > 1 and sum(m >= n for m in got.values()) <= most), default=10**9)
        assert sorted(r["chunk"] for r in rows) == sorted(c for c, n in got.items() if n >= least) and len(rows) <= most
        out = pieces.encode_decode(docs, table_chunks=most).collect()
        assert all((r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == expected(r["text"]) for r in out) and len(out) == 203


def test_odd_rows(odd_documents, no_documents):
    rows = pieces.encode_decode(odd_documents, with_ids=True, with_text=True).collect()
    assert len(rows) == odd_documents.count()
    for r in rows:
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == expected(r["text"])
        assert r["ids"] == MODEL.encode(r["text"] or "") and r["decoded"] == MODEL.decode(r["ids"])
        assert r["bucket"] == "?"  # other columns stay, those named as a result are replaced
    assert pieces.encode_decode(no_documents).count() == 0
