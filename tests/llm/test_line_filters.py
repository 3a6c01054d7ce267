"""Line filters that claim falsely, unseen documents, full filters, and undone deletions."""

import pytest
from test_text_operators import lined, make, plain_lines

from sequor.llm import line_dedup


def cleaned(index, docs, **more):
    return {r.doc_id: (r.n_lines, r.n_dropped, r.text) for r in index.clean(docs, **more).collect()}


@pytest.mark.parametrize("more", [{}, {"broadcast_false": 5}, {"broadcast_bytes": 0}])
def test_false_claims_on_unseen_documents_are_taken_back(spark, more):
    often = [(i, "\n".join(f"frequent line {k}" for k in range(300))) for i in range(3)]
    index = line_dedup.LineIndex.build(make(spark, often), threshold=3, bits=3)
    unseen = [(100 + i, "\n".join(f"unseen line {i} {k}" for k in range(200)) + f"\nfrequent line {i}") for i in range(40)]
    keys = line_dedup._keys_of([t for _, t in unseen], 1)[1]
    filters = {r["shard"]: line_dedup.CuckooFilter.from_bytes(bytes(r["filter"]), 3) for r in index.filters.collect()}
    assert line_dedup._claimed(filters, keys, index.shards).sum() > 200
    got = cleaned(index, make(spark, unseen), **more)
    assert got == {i: (201, 1, t.rsplit("\n", 1)[0]) for i, t in unseen}


def test_a_full_filter_is_built_anew(spark):
    first = [(i, "one\ntwo") for i in range(3)]
    more = [(10 + i, "\n".join(f"line {k}" for k in range(6000))) for i in range(3)]
    index = line_dedup.LineIndex.build(make(spark, first), threshold=3).insert(make(spark, more))
    assert cleaned(index, make(spark, first + more)) == plain_lines(first + more, 3)
    undone = index.delete(make(spark, more))
    assert cleaned(undone, make(spark, first)) == plain_lines(first, 3)


def test_deleting_what_was_not_inserted_is_an_error(spark):
    index = line_dedup.LineIndex.build(make(spark, lined()), threshold=3)
    with pytest.raises(ValueError, match="not inserted"):
        index.delete(make(spark, [(1, "a line that nobody inserted")]))


def test_shards_grow_with_keys(spark):
    docs = make(spark, [(i, "\n".join(f"line {k}" for k in range(3000))) for i in range(3)])
    index = line_dedup.LineIndex.build(docs, threshold=3, shard_keys=20)
    assert index.shards == 150 and index.filters.count() == 150
    assert cleaned(index, docs, broadcast_bytes=0) == cleaned(index, docs)
