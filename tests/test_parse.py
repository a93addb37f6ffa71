"""The whole parse and the whole search, over a few invented résumés."""

import pytest

from cvlake.plans import parse, search
from cvlake.plans.corpus import cv_corpus


@pytest.fixture(scope="module")
def candidates(spark, sf_dir, tmp_path_factory):
    docs = cv_corpus(spark, sf_dir).where("doc_id < 13")
    path = str(tmp_path_factory.mktemp("candidates") / "c")
    parse.candidates(docs).write.parquet(path)
    return spark.read.parquet(path)


def test_every_document_is_parsed(candidates):
    rows = candidates.collect()
    assert len(rows) == 13
    assert all(r.parsed.contact_information.all_phones for r in rows)
    assert sum(bool(r.parsed.skills.all_skills) for r in rows) == 13


def test_search_ranks_and_filters(candidates):
    found = search.rank(candidates, "Forklift driving, RF scanning", min_score=0.0).collect()
    assert found
    scores = [r.score for r in found]
    assert scores == sorted(scores, reverse=True)
    assert not search.rank(candidates, "Forklift driving, 60 years").collect()
