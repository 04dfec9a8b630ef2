import numpy as np
import pyarrow as pa
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from riskloom.llm import piece as P
from riskloom.llm.common import read, text_slices

MODEL = P.pieces(P.model_path())


def run(texts, dropout=0.0, seed=1, ids=None):
    out, ids = [], np.arange(len(texts)) if ids is None else ids
    for f, la, data, offs in text_slices(pa.array(texts, pa.string())):
        flat, n = P.encode(MODEL, data, offs, P.document_keys(ids[f:la], seed), dropout)
        at = np.r_[0, np.cumsum(n)]
        out += [flat[a:b] for a, b in zip(at[:-1], at[1:])]
    return out


TEXTS = ["", " ", "Hello  world \n\n x", "  lead and trail  ", "日本𝕏語 é\t\t", "a" * 300, " " * 100 + "x" + " " * 37, "tab\tsep\r\n", "ﬁﬁﬁ", "the" * 40 + "ing" * 60, "Ünïcödé wörds"]


def test_without_dropout_it_is_the_library(spark, small):
    sp = sentencepiece.SentencePieceProcessor(model_file=P.model_path())
    texts = TEXTS + [r["text"] for r in read(spark, small, "documents").collect()]
    assert [x.tolist() for x in run(texts)] == [sp.encode(t) for t in texts]


def agenda(text, key, dropout):
    """One document by the book: the whole text as one segment."""
    sym = [(-1 if c == "▁" else int(MODEL.symbol[0x2581 if c == " " else ord(c)])) for c in " " + text]
    least = min(2**64 - 1, int(dropout * 2.0**64))
    return P._agenda(MODEL, sym, key, 0, least)


@settings(max_examples=60, deadline=None)
@given(st.text("thein gor▁\n日", min_size=1, max_size=70), st.sampled_from([0.0, 0.1, 0.5, 0.9]), st.integers(0, 5))
def test_rounds_equal_the_agenda_and_decode(text, dropout, doc):
    got = run([text], dropout, 3, np.array([doc]))[0]
    want = []
    place = 0
    for i, end in agenda(text, P.document_keys(np.array([doc]), 3)[0], dropout):
        want += [i] if i >= 0 else [int(MODEL.byte[b]) for b in (" " + text)[place].encode()]
        place = end
    assert got.tolist() == want and P.decode(MODEL, got) == text


def test_dropout_varies_by_seed_and_document_and_is_repeatable():
    t = ["internationalisation of the segmentation " * 20] * 2
    a, b, c = run(t, 0.2), run(t, 0.2), run(t, 0.2, seed=2)
    assert [x.tolist() for x in a] == [x.tolist() for x in b] and a[0].tolist() != a[1].tolist() != c[1].tolist()
    assert len({tuple(x.tolist()) for x in (*a, *c)}) == 4 and len(run(t, 1.0)[0]) == len(t[0]) + 1 and len(run(t)[0]) < len(a[0])
    skipped = np.mean(P._kept(P.document_keys(np.arange(20000), 1), np.arange(20000), np.arange(20000) + 1, np.arange(20000) + 2, np.uint64(int(0.1 * 2**64))))
    assert abs(skipped - 0.9) < 0.01


def test_query_and_edges(spark, small):
    docs = read(spark, small, "documents")
    enc = P.encode_documents(docs)
    rows = enc.collect()
    assert len(rows) == docs.count() and all(r["lossless"] and r["n_ids"] == len(r["ids"]) for r in rows)
    assert {(r["doc_id"], r["text"]) for r in P.decode_documents(enc).collect()} == {(r["doc_id"], r["text"]) for r in docs.collect()}
    odd = spark.createDataFrame([(None, None, 1), (1, "", 1), (None, "x y", 1), (2, "q" * 60_000 + " " * 9000, 1), (3, "same text", 1), (3, "same text", 1)], "doc_id long, text string, ids int")
    got = P.encode_documents(odd).collect()
    null = next(r for r in got if r["ids"] is None)
    assert null["n_ids"] == 0 and null["lossless"] is None and all(r["lossless"] for r in got if r["ids"] is not None)
    same = [r["ids"] for r in got if r["doc_id"] == 3]
    assert same[0] == same[1] and [r["ids"] for r in got if r["doc_id"] == 1] == [[]]
    assert P.encode_documents(odd.limit(0)).count() == 0
    assert sorted(r["text"] or "" for r in P.decode_documents(P.encode_documents(odd)).collect()) == sorted(r["text"] or "" for r in odd.collect())
