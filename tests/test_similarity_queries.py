from sequor.plans import registry
from sequor.plans import views as V


def test_lines_of_every_fiftieth_document_are_asked(spark, sf_dir):
    want = {r.id for r in V.chains(spark, sf_dir).where("doc_id % 50 = 0 and heavy <> ''").select("id").collect()}
    got = [r.query_id for r in registry._asked(spark, sf_dir).select("query_id").collect()]
    assert want and want == {i for i in got if i >= 0} and any(i < 0 for i in got) and len(got) == len(set(got))
