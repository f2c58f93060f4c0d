"""Counts and ids against the libraries on whole texts; cutting and decoding as exact round trips."""

from hypothesis import given, settings
from hypothesis import strategies as st

from corpusmill.llm import tokens

PATH = tokens.vocabulary()
TEXTS = st.text(alphabet=st.sampled_from("abZ09 \n\t\r.,;:!?'stré漢🙂​  )]}>_-\x0b\u0085<|>"), max_size=60)


def direct(text):
    return tokens._tokenizer(PATH).encode(text, add_special_tokens=False).ids


@settings(max_examples=400, deadline=None)
@given(TEXTS)
def test_cuts_are_exact(text):
    ids = direct(text)
    assert tokens._encode([text], PATH) == [ids] and tokens.count_one(text, PATH) == len(ids)
    cut = tokens.cut_text(text, 4)
    assert "".join(cut) == text and sum(tokens.count_one(c, PATH) for c in cut) == len(ids)
    assert tokens.decode_ids(ids, PATH) == text
    start, end = tokens.id_spans(ids, text, PATH)
    assert all(0 <= a < b <= len(text) for a, b in zip(start, end)) and (not ids or (start[0] == 0 and end[-1] == len(text)))


def test_split_characters_share_their_span():
    ids = direct("🙂")
    assert len(ids) > 1 and tokens.id_spans(ids, "🙂", PATH) == ([0] * len(ids), [1] * len(ids))
    assert tokens.decode_ids(ids[:1], PATH) == "�"


def test_ids_of_null_empty_and_special(spark):
    df = spark.createDataFrame([(1, None, 7), (2, "", 7), (3, "<|endoftext|>", 7), (4, "Hi there", 7)], "doc_id long, text string, ids int")
    got = {r.doc_id: list(r.ids) for r in tokens.token_ids(df).collect()}
    assert got[1] == got[2] == [] and 50256 not in got[3] and got[4] == direct("Hi there")
    assert tokens.token_ids(df.limit(0)).count() == 0
    assert all(r.same for r in tokens.token_spans(df).collect())


def test_counts_of_long_texts(spark):
    words, solid = "some words, 12abc. " * 400, "x" * 9000
    df = spark.createDataFrame([(1, words, "c"), (1, words, "c"), (2, solid, "c"), (3, None, "c"), (4, "漢字" * 3000, "c")], "k long, t string, row_id string")
    got = {r.row_id: r.tokens for r in tokens.token_counts(df, "k", "t", chunk_chars=500).collect()}
    assert got == {1: len(direct(words)), 2: len(direct(solid)), 3: 0, 4: len(direct("漢字" * 3000))}


def test_slices_keep_nulls_as_groups(spark):
    docs = spark.createDataFrame([(1, "a b", "s", None, None), (2, "c", "s", None, "d"), (3, None, None, "EN ", "d")], "doc_id long, text string, source string, lang string, domain string")
    code = spark.createDataFrame([(1, "r", "Python", "x = 1"), (1, "r", "python", "x = 1")], "file_id long, repo string, language string, content string")
    counted = tokens.counted(docs, code)
    got = {(r.tbl, r.source, r.language, r.domain): (r.texts, r.tokens) for r in tokens.slices(counted).collect()}
    assert got[("documents", "s", None, None)] == (1, 2) and got[("documents", None, "en", "d")] == (1, 0) and got[("parsed_files", "r", "python", None)] == (1, 3)
    assert {(r.dimension, r.value): r.texts for r in tokens.totals(counted).collect() if r.tbl == "documents"}[("domain", "d")] == 2
