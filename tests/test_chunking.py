import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from vellum.operators import chunking
from vellum.operators.chunking import chunk_text

words = st.lists(st.sampled_from(["a", "bb", "ccc.", "dd\n", "e\n\n", "f. "]), max_size=120).map(" ".join)


@settings(max_examples=150, deadline=None)
@given(words, st.integers(2, 20), st.integers(0, 5))
def test_chunks_keep_the_limit_and_all_words(t, limit, overlap):
    if overlap >= limit:
        with pytest.raises(ValueError):
            chunk_text(t, limit, overlap)
        return
    got = chunk_text(t, limit, overlap)
    assert all(0 < len(c.split()) <= limit for c, _, _ in got if c.strip())
    seen = " ".join(c for c, _, _ in got).split()
    for w in {x.strip(".") for x in t.split()}:
        assert any(w in x for x in seen)
    assert bool(got) == bool(t.strip())


def test_small_and_blank():
    assert chunk_text("  one two ") == [("one two", 0, 7)]
    assert chunk_text(" \n ") == [] and chunk_text(None) == [] and chunk_text("") == []


def test_overlap_is_of_whole_pieces():
    t = ". ".join(["a b c", "d e f", "g h", "i j k"])
    assert [c for c, _, _ in chunk_text(t, 6, 2, (". ", ""))] == ["a b c. d e f", "g h. i j k"]
    assert [c for c, _, _ in chunk_text(t, 6, 3, (". ", ""))] == ["a b c. d e f", "d e f. g h", "g h. i j k"]


def test_parent_child_ids_are_stable(spark):
    pages = spark.createDataFrame([("d", 1, " ".join(f"w{i}" for i in range(60))), ("d", 2, None), ("e", 1, "")], "doc_id string, page_num int, text string")
    runs = []
    for _ in range(2):
        parents, children = chunking.parent_child(pages, (20, 4), (8, 2))
        runs.append((sorted(map(tuple, parents.collect())), sorted(map(tuple, children.collect()))))
    assert runs[0] == runs[1]
    ids = {p[3] for p in runs[0][0]}
    assert ids and {c[4] for c in runs[0][1]} == ids and all(len(i) == 12 for i in ids)


def test_clashing_columns(spark):
    df = spark.createDataFrame([(1, "a b", "x")], "id int, text string, content string")
    assert chunking.recursive_chunks(df).columns == ["id", "ord", "content", "start_char", "end_char"]
