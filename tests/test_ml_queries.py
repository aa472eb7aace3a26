from tagloom.plans import ml_queries


def test_document_clusters_searches_all_k(spark, monkeypatch):
    """The query leaves the candidates for k to the operator, whose default is 2 to 8."""
    seen, choose = [], ml_queries.ml.choose_k

    def noted(features, *args, **named):
        seen.append((args, named))
        return choose(features, range(2, 3))

    monkeypatch.setattr(ml_queries.ml, "choose_k", noted)
    assert ml_queries.document_clusters(spark, "/root/testdata/sf0.001").columns == ["doc_id", "cluster"]
    assert seen == [((), {})]
