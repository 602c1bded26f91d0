"""What a Python worker holds after its stage."""

import contextlib

import pytest

from spanloom.llm import bpe, near_dedup, quality, secret_scan
from spanloom.llm.queries import VOCABULARY

from .helpers import SCHEMA, sample


def test_an_encoder_of_the_library_model_holds_no_merges_of_its_own():
    encoder = bpe.encoder_of(VOCABULARY, library=True)
    plain = bpe.Encoder(bpe.Vocabulary(VOCABULARY))
    assert not encoder.vocabulary.pairs and plain.vocabulary.pairs
    texts = [t or "" for _, t, *_ in sample()]
    assert [encoder.encode(t) for t in texts] == [plain.encode(t) for t in texts]


@pytest.mark.parametrize("stage", ["quality", "graded", "near", "secrets"])
def test_tasks_that_encode_nothing_drop_the_words_of_earlier_ones(spark, monkeypatch, stage):
    docs = spark.createDataFrame(sample(), SCHEMA)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    tasks, kind = [], type(docs)
    real = kind.mapInArrow
    monkeypatch.setattr(kind, "mapInArrow", lambda self, function, *more: (tasks.append(function), real(self, function, *more))[1])
    if stage == "near":
        near_dedup._scan(docs)
    elif stage == "secrets":
        secret_scan.scan(docs)
    else:
        quality.grade_documents(docs, labels, carried=stage == "quality")
    assert tasks
    for task in tasks:
        bpe.encoder_of(VOCABULARY, library=True).encode("some words")
        with contextlib.suppress(AttributeError):  # there is no task context here
            list(task(iter([])))
        assert not bpe._ENCODERS
